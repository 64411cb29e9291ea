import random

import numpy as np

from lectern.llm import classes, spans
from lectern.llm.fmindex import FMIndex


def brute(rows, least):
    seen = {}
    for doc, text in rows:
        for i in range(len(text or "") - least + 1):
            seen.setdefault(text[i : i + least], set()).add(doc)
    pairs = {(a, b) for docs in seen.values() if len(docs) > 1 for a in docs for b in docs if a < b}
    cover = {}
    for doc, text in rows:
        shared = np.zeros(len(text or ""), bool)
        for i in range(len(text or "") - least + 1):
            if len(seen[text[i : i + least]]) > 1:
                shared[i : i + least] = True
        if shared.any():
            cover[doc] = int(shared.sum())
    return pairs, cover


def check(spark, rows, least, gram, **other):
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, doc string, start int")
    found = spans.shared_spans(df, least=least, gram=gram, **other)
    real = [(d, t) for d, t in dict(rows).items() if d is not None and t is not None]
    pairs, cover = brute(real, least)
    texts = dict(real)
    out = spans.spans(*found).collect()
    assert {(r.doc_a, r.doc_b) for r in out} == pairs
    assert {(r.doc_a, r.doc_b) for r in spans.local_matches(*found).collect()} == pairs
    for r in out:
        a, b = texts[r.doc_a], texts[r.doc_b]
        assert r.length >= least and a[r.start_a : r.start_a + r.length] == b[r.start_b : r.start_b + r.length]
        assert not (r.start_a and r.start_b and a[r.start_a - 1] == b[r.start_b - 1])
        assert a[r.start_a + r.length : r.start_a + r.length + 1] != b[r.start_b + r.length : r.start_b + r.length + 1] or r.start_a + r.length == len(a)
    parts = {r.doc_id: r.shared_chars for r in spans.shared_parts(*found, df).collect()}
    assert parts == cover
    return out


def letters(rng, n, alphabet="abcdefghij klmné𝑥"):
    return "".join(rng.choice(alphabet) for _ in range(n))


def test_planted_spans(spark):
    rng = random.Random(1)
    rows = [(i, letters(rng, rng.randrange(0, 900))) for i in range(60)]
    for size in (39, 40, 41, 60, 200, 399):
        piece = letters(rng, size)
        for d in rng.sample(range(60), 3):
            at = rng.randrange(len(rows[d][1]) + 1)
            rows[d] = (d, rows[d][1][:at] + piece + rows[d][1][at:])
    rows += [(100, rows[3][1]), (101, rows[3][1]), (102, None), (103, ""), (None, rows[3][1]), (100, rows[3][1]), (104, "\0".join(rows[4][1])), (105, "q" + "\0".join(rows[4][1]))]
    assert len(check(spark, rows, 40, 12)) > 10


def test_runs_and_repeats(spark):
    rows = [(1, "-" * 500), (2, "x" + "-" * 130), (3, "ab" * 200), (4, "z" + "ba" * 100), (5, ("-" * 39 + "+") * 5), (6, "only here " * 30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = spans.shared_spans(df, least=40, gram=12)
    assert {(r.doc_a, r.doc_b) for r in spans.local_matches(*found).collect()} == brute(rows, 40)[0]
    assert len(spans.anchors(["-" * 10_000], 200, 64)[0]) < 400


def test_hot_anchor_and_tiles(spark):
    rng = random.Random(5)
    common = letters(rng, 25)
    rows = [(i, letters(rng, 50) + common + letters(rng, 50)) for i in range(60)]
    long = letters(rng, 60)
    rows += [(100 + i, letters(rng, 30) + long + letters(rng, 30)) for i in range(12)]
    check(spark, rows, 40, 12, hot=5, tile=7)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    matches, members = spans.shared_spans(df)
    assert spans.spans(matches, members).count() == 0 and spans.shared_parts(matches, members, df).count() == 0


def test_every_stretch_holds_an_anchor_across_sections(monkeypatch):
    monkeypatch.setattr(spans, "SECTION", 500)
    rng = random.Random(3)
    text = letters(rng, 5000)
    places = []
    for owner, offset, parts in spans._sections([text], 40):
        section, place, _ = spans.anchors(parts, 40, 12)
        places += (place + np.array(offset)[section]).tolist()
    places = np.array(sorted(set(places)))
    for i in range(len(text) - 39):
        assert ((places >= i) & (places + 12 <= i + 40)).any()


def test_matching_statistics_and_places():
    rng = np.random.default_rng(0)
    for sigma, n, cap in ((3, 300, 20), (40, 900, 50)):
        codes = rng.integers(1, sigma, n)
        codes[rng.integers(0, n, 5)] = 0
        codes[200:260], codes[-1] = codes[100:160].copy(), 0
        index, raw = FMIndex(codes, cap), bytes(codes.tolist())
        order = sorted(range(n), key=lambda i: raw[i:])
        assert index.places(np.arange(n + 1)).tolist() == [n, *order]
        end = np.flatnonzero(codes == 0)
        begin = np.concatenate([[0], end[:-1] + 1])
        text, place, low, high, lengths = index.statistics(codes, begin, end, np.full(len(end), 2))
        reported = {}
        for p, a, b in zip(place.tolist(), low.tolist(), high.tolist()):
            got = sorted(index.places(np.arange(a, b)).tolist())
            assert got == [k for k in range(n) if raw[k : k + cap] == raw[p : p + cap]] and len(got) > 1
            reported.setdefault(p, set()).update(got)
        for i in range(n):
            longest = max((m for m in range(1, cap + 1) if 0 not in codes[i : i + m] and i + m < n and raw.find(raw[i : i + m], raw.find(raw[i : i + m]) + 1) >= 0), default=0)
            assert lengths[i] == longest
            # Places that weren't there one character later are reported.
            if longest == cap:
                now = {k for k in range(n) if raw[k : k + cap] == raw[i : i + cap]}
                later = {k - 1 for k in range(n) if raw[k : k + cap] == raw[i + 1 : i + 1 + cap] and 0 not in codes[i + 1 : i + 1 + cap]}
                assert now - later - reported.get(i, set()) in (set(), {i})


def test_a_class_in_most_records(spark):
    rng = random.Random(8)
    common = letters(rng, 80)
    rows = [(i, common + letters(rng, 20) if i % 2 else letters(rng, 20) + common) for i in range(70)]
    check(spark, rows, 40, 12)
    pairs = spark.createDataFrame([(1, 1), (1, 2)], "x long, y long")
    members = spark.createDataFrame([(1, i) for i in range(50)] + [(2, 100), (2, 101)], "class long, member long")
    got = [(r.x, r.y, r.u, r.v) for r in classes.member_pairs(pairs, members, tile=7).collect()]
    assert {x[2:] for x in got if x[1] == 2} == {(u, v) for u in range(50) for v in (100, 101)}
    assert sorted(tuple(sorted(x[2:])) for x in got if x[1] == 1) == [(u, v) for u in range(50) for v in range(u + 1, 50)]
