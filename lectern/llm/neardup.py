"""Near-duplicate texts: pairs whose word-shingle sets reach a Jaccard similarity, and the groups they form.

1. Each text becomes a set of shingles; sets that are equal are one class, whose first key represents it from here on.
2. The index is a hierarchy over the fingerprints of classes. Its uppermost nodes are masked patterns: bands of minimum
   hashes, as many as keep the chance that a pair at the threshold shares none below ``MISSED``. They are spread over tasks,
   and a node too large for one is cut into tiles that meet in pairs.
3. Below, parity fingerprints lie in Gray order, and whole groups are pruned by the differences that add up on the way
   down, without loss. Fingerprints are wide enough for the sizes of the sets; between widths, the wider one is folded.
4. What is left is checked exactly on the shingle sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.classes import member_pairs
from lectern.llm.grayindex import GrayForest
from lectern.llm.shingles import MULTIPLIER, scramble, shingle_sets
from lectern.session import durable

ROWS = 3
#: The chance with which a pair at the threshold may be missed.
MISSED = 1e-4
#: Bits of the narrowest fingerprint. A wider one has twice as many, and so on, at least one for each element of the set.
BITS = 256
TILE = 2048
BATCH = 1 << 17


def bands_for(similarity: float, missed: float = MISSED, rows: int = ROWS) -> int:
    """How many bands of ``rows`` minimum hashes two sets of that similarity share one of, but for a chance of ``missed``."""
    if not 0 < similarity <= 1:
        raise ValueError("a similarity lies above 0 and is at most 1")
    return 1 if similarity == 1 else math.ceil(math.log(missed) / math.log(1 - similarity**rows))


def miss_chance(similarity: float, bands: int, rows: int = ROWS) -> float:
    """The chance that two sets of that similarity share no band."""
    return (1 - similarity**rows) ** bands


def _sketch(sets: list[np.ndarray], bands: int, rows: int) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """For each set: two 64-bit sums that name it, its band keys, and its parity fingerprint as 64-bit words."""
    count = np.array([len(s) for s in sets])
    begin = np.cumsum(count) - count
    every = np.concatenate(sets)
    names = np.stack([np.add.reduceat(scramble(every ^ salt), begin) for salt in scramble(np.arange(1, 3, dtype=np.uint64))], axis=1)
    keys = np.empty((len(sets), bands), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for band in range(bands):
            mixed = np.full(len(sets), band, dtype=np.uint64)
            for row in range(rows):
                salt = scramble(np.array([band * rows + row + 1], dtype=np.uint64) * MULTIPLIER)[0]
                hashed = (every ^ salt) * (salt | np.uint64(1))
                hashed ^= hashed >> np.uint64(29)
                mixed = scramble(mixed * MULTIPLIER + np.minimum.reduceat(hashed * MULTIPLIER, begin))
            keys[:, band] = mixed
    widths = BITS << width_class(count)
    place = np.cumsum(widths) - widths
    # The low bits of a place stay the same when a fingerprint is folded.
    bit = ((every >> np.uint64(24)) & np.repeat(widths - 1, count).astype(np.uint64)).astype(np.int64)
    parity = (np.bincount(np.repeat(place, count) + bit, minlength=int(widths.sum())) & 1).astype(np.uint8)
    words = np.packbits(parity, bitorder="little").view(np.uint64)
    return names, keys, [w.tobytes() for w in np.split(words, place[1:] // 64)]


def width_class(size: np.ndarray) -> np.ndarray:
    """How often ``BITS`` is doubled to have a bit for each of ``size`` elements."""
    return np.ceil(np.log2(np.maximum(1, size / BITS))).astype(np.int64)


def folded(code: np.ndarray, words: int) -> np.ndarray:
    """A fingerprint of more words as one of ``words``: the parity of each bit's places."""
    return np.bitwise_xor.reduce(code.reshape(-1, words), axis=0)


def _texts(batch: pa.RecordBatch) -> list[str]:
    return batch.column("text").to_pylist()


def _parts(texts: list[str], most: int = 4_000_000) -> Iterator[slice]:
    """Slices of ``texts`` with about ``most`` characters each, so that memory follows the slice and not the batch."""
    begin = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= most:
            yield slice(begin, i + 1)
            begin, size = i + 1, 0
    if begin < len(texts):
        yield slice(begin, len(texts))


def sketches(texts: DataFrame, key: str, words: int, least_words: int, bands: int, rows: int = ROWS) -> DataFrame:
    """``key``, ``c1``/``c2`` (the name of the shingle set), ``n`` (its size), ``fp`` and ``keys`` of each text that counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_texts, all_ids = _texts(batch), batch.column("key")
            for part in _parts(all_texts):
                sets = shingle_sets(all_texts[part], words, least_words)
                good = [i for i, s in enumerate(sets) if s is not None]
                if not good:
                    continue
                sets = [sets[i] for i in good]
                names, keys, fp = _sketch(sets, bands, rows)
                yield pa.RecordBatch.from_arrays(
                    [
                        all_ids.slice(part.start, part.stop - part.start).take(pa.array(good)),
                        pa.array(names[:, 0].view(np.int64)),
                        pa.array(names[:, 1].view(np.int64)),
                        pa.array(np.array([len(s) for s in sets], dtype=np.int32)),
                        pa.array(fp, type=pa.binary()),
                        pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, bands, dtype=np.int32)), pa.array(keys.reshape(-1).view(np.int64))),
                    ],
                    names=["key", "c1", "c2", "n", "fp", "keys"],
                )

    slim = texts.filter(F.col("text").isNotNull() & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("key"), "text")
    return slim.mapInArrow(run, "key long, c1 long, c2 long, n int, fp binary, keys array<long>")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole blocks: the rows come sorted by block, and one that a batch cuts is carried over. At most a tile
    pair's rows are carried."""
    held: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        if held.num_rows < BATCH:
            continue
        ids = np.stack([held.column(c).to_numpy() for c in ("band", "t", "s")])
        last = np.flatnonzero((ids[:, 1:] != ids[:, :-1]).any(axis=0))
        if len(last):
            yield held.slice(0, int(last[-1]) + 1)
            held = held.slice(int(last[-1]) + 1)
    if held is not None and held.num_rows:
        yield held


def candidates(classes: DataFrame, similarity: float, tile: int = TILE) -> DataFrame:
    """Pairs ``a < b`` of classes (``rep``, ``n``, ``fp``, ``keys``) that share a band and that the index doesn't prune."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _blocks(batches):
            t, s, own = (table.column(c).to_numpy() for c in ("t", "s", "own"))
            band, rep = table.column("band").to_numpy(), table.column("rep").to_numpy()
            block = np.cumsum(np.concatenate([[0], (band[1:] != band[:-1]) | (t[1:] != t[:-1]) | (s[1:] != s[:-1])]))
            n, codes = table.column("n").to_numpy().astype(np.int64), table.column("fp").to_pylist()
            low, high = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            # A set meets those of its own width; where it can be like narrower ones, it visits them folded.
            width = width_class(n)
            for w in np.unique(width):
                reach = np.flatnonzero((width >= w) & (n * similarity <= (BITS << w)))
                wide = np.stack([folded(np.frombuffer(codes[i], np.uint64), BITS // 64 << int(w)) for i in reach])
                a, b = GrayForest(block[reach], wide, n[reach]).pairs(similarity)
                a, b = reach[a], reach[b]
                # In the meeting of two different tiles, pairs within one tile belong to that tile's own block.
                cross = ((t[a] == s[a]) | (own[a] != own[b])) & (np.minimum(width[a], width[b]) == w)
                low.append(np.minimum(rep[a], rep[b])[cross]), high.append(np.maximum(rep[a], rep[b])[cross])
            once = np.unique(np.stack([np.concatenate(low), np.concatenate(high)], axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(once[:, 0]), pa.array(once[:, 1])], names=["a", "b"])

    keyed = classes.select("rep", F.explode(F.array_distinct("keys")).alias("band"))
    # Most bands are of one class. Counting is a partial aggregate, so a hot band is reduced before the shuffle.
    shared = keyed.groupBy("band").agg(F.count("*").alias("m")).filter("m > 1")
    tiles = F.ceil(F.col("m") / F.lit(tile)).cast("int")
    met = keyed.join(shared, "band").select("band", "rep", tiles.alias("tiles"), F.pmod(F.xxhash64("rep"), tiles).cast("int").alias("own"))
    other = F.explode(F.when(F.col("tiles") > 1, F.sequence(F.lit(0), F.col("tiles") - 1)).otherwise(F.array(F.lit(0)))).alias("other")
    met = met.select("band", "rep", "own", other).select("band", "rep", "own", F.least("own", "other").alias("t"), F.greatest("own", "other").alias("s"))
    met = met.join(classes.select("rep", "n", "fp"), "rep")
    found = met.repartition("band", "t", "s").sortWithinPartitions("band", "t", "s").mapInArrow(search, "a long, b long")
    return found.distinct()


def near_duplicates(
    texts: DataFrame, key: str = "rowid", words: int = 5, similarity: float = 0.8, least_words: int = 1, tile: int = TILE
) -> tuple[DataFrame, DataFrame]:
    """``(links, members)`` of the texts (``key``: long, ``text``) whose sets of distinct sequences of ``words`` words have
    a Jaccard similarity of at least ``similarity``.

    ``members``: ``key`` and ``rep``, the smallest key with an equal shingle set, for every text that counts. ``links``:
    pairs ``a < b`` of such representatives with their ``similarity``. Texts with equal sets are never paired with each
    other one by one: they share a ``rep``. A key that comes repeatedly counts once (its rows have equal content).

    Null, empty and short texts (fewer than ``least_words`` words, or than ``words``) are in neither result; so are null
    keys. Very long texts are handled whole. Empty tables give empty results. Extra columns are ignored.
    """
    sketched = durable(sketches(texts, key, words, least_words, bands_for(similarity)))
    classes = durable(
        sketched.groupBy("c1", "c2").agg(F.min("key").alias("rep"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("keys").alias("keys"))
    )
    members = sketched.select("key", "c1", "c2").distinct().join(classes.select("c1", "c2", "rep"), ["c1", "c2"]).select("key", "rep")
    pairs = durable(candidates(classes, similarity, tile))
    return _checked(pairs, texts, key, words, similarity), members


def _checked(pairs: DataFrame, texts: DataFrame, key: str, words: int, similarity: float) -> DataFrame:
    """The pairs whose shingle sets do reach the similarity. Only texts in a pair are read into sets again."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(all_texts := _texts(batch)):
                hashed = shingle_sets(all_texts[part], words, 1)
                ids = batch.column("key").slice(part.start, part.stop - part.start)
                yield pa.RecordBatch.from_arrays([ids, pa.array([s.tobytes() for s in hashed], type=pa.binary())], names=["key", "shingles"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column("x").to_pylist(), batch.column("y").to_pylist()
            value = np.empty(len(left))
            for i, (x, y) in enumerate(zip(left, right)):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                value[i] = both / (len(x) + len(y) - both)
            good = np.flatnonzero(value >= similarity - 1e-12)
            yield pa.RecordBatch.from_arrays([batch.column("a").take(pa.array(good)), batch.column("b").take(pa.array(good)), pa.array(value[good])], names=["a", "b", "similarity"])

    wanted = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    slim = texts.filter(F.col("text").isNotNull()).select(F.col(key).cast("long").alias("key"), "text").join(wanted, "key", "left_semi")
    shingled = durable(slim.dropDuplicates(["key"]).mapInArrow(sets, "key long, shingles binary"))
    both = pairs.join(shingled.select(F.col("key").alias("a"), F.col("shingles").alias("x")), "a").join(shingled.select(F.col("key").alias("b"), F.col("shingles").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(compare, "a long, b long, similarity double")


def expanded(links: DataFrame, members: DataFrame) -> DataFrame:
    """All pairs of keys, ``a < b``: across linked classes and within each class, however large one is."""
    several = members.groupBy("rep").count().filter("count > 1").select("rep")
    met = links.select(F.col("a").alias("x"), F.col("b").alias("y")).union(several.select("rep", "rep"))
    pairs = member_pairs(met, members.select(F.col("rep").alias("class"), F.col("key").alias("member")))
    return pairs.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"))
