import random
import re

import numpy as np

from lectern.llm import neardup
from lectern.llm.grayindex import GrayForest, gray_rank
from lectern.llm.shingles import shingle_sets
from lectern.operators.components import components


def brute(rows, words, similarity, least):
    sets = {}
    for key, text in rows:
        found = re.findall(r"[^\W_]+", text.lower()) if text is not None and key is not None else []
        if len(found) >= max(least, words):
            sets[key] = {tuple(found[i : i + words]) for i in range(len(found) - words + 1)}
    keys = sorted(sets)
    return {(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :] if len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]) - 1e-12}, set(keys)


def make(rng, count, vocabulary=400):
    rows, words = [], [f"w{i}" for i in range(vocabulary)]
    for i in range(count):
        if rows and rng.random() < 0.6:
            base = rng.choice(rows)[1].split()
            for _ in range(rng.randrange(0, 6)):
                at = rng.randrange(len(base))
                base[at : at + rng.randrange(0, 2)] = [rng.choice(words)] * rng.randrange(0, 2)
            rows.append((i, " ".join(base) or "w0"))
        else:
            rows.append((i, " ".join(rng.choice(words) for _ in range(rng.randrange(5, 120)))))
    return rows


def test_gray_rank_is_the_inverse_of_the_gray_code():
    codes = np.arange(64, dtype=np.uint64)
    gray = (codes ^ (codes >> np.uint64(1)))[:, None]
    assert (gray_rank(gray)[:, 0] == codes).all()
    rng = np.random.default_rng(1)
    number = rng.integers(0, 2**63, (50, 2)).astype(np.uint64)
    carry = np.concatenate([np.zeros((50, 1), np.uint64), number[:, :1]], axis=1) & np.uint64(1)
    gray = number ^ (number >> np.uint64(1)) ^ (carry << np.uint64(63))
    assert (gray_rank(gray) == number).all()


def test_index_loses_no_pair_within_the_bound():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, (20, 4)).astype(np.uint64)
    codes = base[rng.integers(0, 20, 300)]
    for _ in range(12):
        codes[np.arange(300), rng.integers(0, 4, 300)] ^= np.uint64(1) << rng.integers(0, 63, 300).astype(np.uint64)
    block, size = rng.integers(0, 3, 300), rng.integers(40, 90, 300)
    a, b = GrayForest(block, codes, size).pairs(0.7)
    got = {tuple(sorted(p)) for p in zip(a.tolist(), b.tolist())}
    assert len(got) == len(a)
    want = set()
    for i in range(300):
        for j in range(i + 1, 300):
            far = np.bitwise_count(codes[i] ^ codes[j]).sum()
            low, high = sorted((size[i], size[j]))
            if block[i] == block[j] and far <= 0.3 / 1.7 * (size[i] + size[j]) and low >= 0.7 * high:
                want.add((i, j))
    assert want <= got


def test_words_are_runs_of_letters_and_digits():
    texts = ["Été_deux 3x-y", "", "a", "ΑΒΓ 𝑥y", "one two one two one two"]
    sets = shingle_sets(texts, 1, 1)
    count = [len(set(re.findall(r"[^\W_]+", t.lower()))) for t in texts]
    assert [0 if s is None else len(s) for s in sets] == count
    assert len(shingle_sets(texts, 2, 1)[4]) == 2


def test_pairs_against_brute_force(spark):
    rng = random.Random(7)
    rows = make(rng, 300) + [(1000, None), (1001, ""), (1002, "a b"), (None, "w1 w2 w3 w4 w5 w6 w7")]
    rows += [(5, dict(rows)[5]), (2000, "copy of the same words " * 9), (2001, "COPY, of the same words. " * 9), (2002, "copy of the same words " * 9)]
    df = spark.createDataFrame([(k, t, "x", 1) for k, t in rows], "rowid long, text string, rep string, band int")
    for words, similarity, least in ((3, 0.7, 20), (5, 0.8, 1)):
        links, members = neardup.near_duplicates(df, "rowid", words, similarity, least)
        want, keys = brute(rows, words, similarity, least)
        got = {(r.a, r.b) for r in neardup.expanded(links, members).collect()}
        assert got == want
        assert {r.key for r in members.collect()} == keys
    groups = {r.node: r.component for r in components(links).collect()}
    assert all(groups[r.a] == groups[r.b] for r in links.collect())


def test_a_hot_block_is_cut_into_tiles(spark):
    rng = random.Random(9)
    base = [f"w{i}" for i in range(100)]
    rows = []
    for i in range(90):
        own = list(base)
        for _ in range(rng.randrange(0, 3)):
            own[rng.randrange(100)] = f"v{rng.randrange(999)}"
        rows.append((i, " ".join(own)))
    df = spark.createDataFrame(rows, "rowid long, text string")
    got = {(r.a, r.b) for r in neardup.expanded(*neardup.near_duplicates(df, "rowid", 3, 0.7, tile=16)).collect()}
    assert got == brute(rows, 3, 0.7, 1)[0] and len(got) > 2000


def test_empty_and_chance(spark):
    df = spark.createDataFrame([], "rowid long, text string")
    links, members = neardup.near_duplicates(df)
    assert links.count() == 0 and members.count() == 0 and neardup.expanded(links, members).count() == 0
    for similarity in (0.3, 0.5, 0.7, 0.8, 0.95):
        assert neardup.miss_chance(similarity, neardup.bands_for(similarity)) <= 1e-4 < neardup.miss_chance(similarity, max(1, neardup.bands_for(similarity) // 2))


def test_long_texts_of_different_widths(spark):
    rng = random.Random(11)
    rows = []
    for base in range(6):
        words = [f"{base}w{rng.randrange(10_000)}" for _ in range(rng.choice((240, 262, 500, 1030)))]
        for copy in range(4):
            own = words[: int(len(words) * (1 - 0.07 * copy))]
            own[rng.randrange(len(own))] = "other"
            rows.append((10 * base + copy, " ".join(own)))
    df = spark.createDataFrame(rows, "rowid long, text string")
    got = {(r.a, r.b) for r in neardup.expanded(*neardup.near_duplicates(df, "rowid", 3, 0.7)).collect()}
    assert got == brute(rows, 3, 0.7, 1)[0] and len(got) > 20


def test_folding_and_pruning_of_wide_fingerprints():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 2**63, n).astype(np.uint64)) for n in (200, 300, 3000, 3000)]
    codes = [np.frombuffer(c, np.uint64) for c in neardup._sketch(sets, 2, 3)[2]]
    assert [len(c) * 64 for c in codes] == [256, 512, 4096, 4096]
    for s, c in zip(sets, codes):
        bits = np.bincount(((s >> np.uint64(24)) & np.uint64(255)).astype(int), minlength=256) & 1
        assert (np.unpackbits(neardup.folded(c, 4).view(np.uint8), bitorder="little") == bits).all()
    a, b = GrayForest(np.zeros(2, np.int64), np.stack(codes[2:]), np.array([3000, 3000])).pairs(0.7)
    assert len(a) == 0  # sets of this size that have nothing in common are told apart
