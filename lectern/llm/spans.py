"""Long exact spans shared between records.

A span of at least ``least`` characters is looked for in three steps, none of which loses one:

1. Every stretch of ``least`` characters keeps one anchor: the k-gram with the smallest hash in it. Equal stretches keep
   equal anchors, so text around an anchor that no other record has can't be shared, and is left out.
2. The text around each anchor that records share is a snippet. Equal snippets of an anchor are one class. Snippets are
   spread over shards by their anchor.
3. Each shard has a compressed FM-index of its snippets, and every snippet, also one that stands in several records word for
   word, is streamed against it: backward search gives its matching statistics. Where they reach ``least`` characters, the
   match is reported with its places and followed to both ends.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.classes import member_pairs
from lectern.llm.fmindex import FMIndex
from lectern.llm.shingles import MULTIPLIER, code_points, powers, scramble
from lectern.session import durable

GRAM = 64
HOT = 1000
TILE = 1500
SHARD_SNIPPETS = 3000
SECTION = 1 << 20
PLACE_BITS = 20
PAIRS_AT_ONCE = 1 << 20

_INVERSE = np.uint64(pow(int(MULTIPLIER), -1, 1 << 64))
_ODD = 0x9E375  # spreads places within equal hashes; odd, so that it can be undone
_UNDO = pow(_ODD, -1, 1 << PLACE_BITS)


def gram_hashes(codes: np.ndarray, gram: int) -> np.ndarray:
    """The hash of every ``gram`` consecutive code points."""
    count = len(codes)
    up = powers(count)
    down = np.full(count, _INVERSE, dtype=np.uint64)
    down[0] = 1
    down = np.cumprod(down, dtype=np.uint64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * up, dtype=np.uint64)])
    return scramble((sums[gram:] - sums[:-gram]) * down[: count - gram + 1])


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every ``width`` consecutive values, in a time that doesn't depend on the width."""
    count = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, np.iinfo(values.dtype).max, dtype=values.dtype)
    padded[: len(values)] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(back[:count], ahead[width - 1 : width - 1 + count])


def anchors(sections: list[str], least: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(section, place, hash)`` of the anchors: every ``least`` consecutive characters of a section hold one."""
    sections = [s if len(s) >= least else "" for s in sections]
    size = np.array([len(s) for s in sections], dtype=np.int64)
    nothing = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    if not size.sum():
        return nothing
    width = least - gram + 1
    hashes = gram_hashes(code_points("".join(sections)), gram)
    low = (np.uint64(1) << np.uint64(PLACE_BITS)) - np.uint64(1)
    place = np.arange(len(hashes), dtype=np.uint64)
    # Among equal hashes the place decides, spread at random, so that runs of one character don't keep every place.
    smallest = sliding_minimum((hashes & ~low) | (place * np.uint64(_ODD) & low), width)
    begin = np.cumsum(size) - size
    windows = np.maximum(size - least + 1, 0)
    at = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows) + np.repeat(begin, windows)
    chosen = (smallest[at] & low).astype(np.int64) * _UNDO & int(low)
    chosen = at + ((chosen - at) & int(low))
    chosen = np.unique(chosen)
    section = np.searchsorted(begin + size, chosen, side="right")
    return section, chosen - begin[section], hashes[chosen]


def _sections(texts: list[str], least: int, most: int = 4 * SECTION) -> Iterator[tuple[list[int], list[int], list[str]]]:
    """Batches of ``(text index, offset, section)``; long texts come in sections that overlap by less than a span."""
    owner, offset, parts, size = [], [], [], 0
    for i, text in enumerate(texts):
        for begin in range(0, max(1, len(text) - least + 1), SECTION):
            part = text[begin : begin + SECTION + least - 1]
            owner.append(i), offset.append(begin), parts.append(part)
            size += len(part)
            if size >= most:
                yield owner, offset, parts
                owner, offset, parts, size = [], [], [], 0
    if parts:
        yield owner, offset, parts


def text_anchors(texts: DataFrame, least: int, gram: int) -> DataFrame:
    """``doc``, ``places`` and ``hashes`` of each text of at least ``least`` characters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs = batch.column("doc").to_numpy()
            for owner, offset, parts in _sections(batch.column("text").to_pylist(), least):
                section, place, hashes = anchors(parts, least, gram)
                who = np.array(owner)[section]
                place = place + np.array(offset, dtype=np.int64)[section]
                cut = np.flatnonzero(np.diff(who, prepend=-1))
                ends = np.append(cut, len(who)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(v)) for v in (place.astype(np.int32), hashes.view(np.int64))]
                yield pa.RecordBatch.from_arrays([pa.array(docs[who[cut]]), *lists], names=["doc", "places", "hashes"])

    return texts.filter(F.length("text") >= least).mapInArrow(run, "doc long, places array<int>, hashes array<long>")


def snippets(texts: DataFrame, shared: DataFrame, least: int, gram: int, hot: int) -> DataFrame:
    """``block``, ``doc``, ``place``, ``start``, ``snippet`` around the shared anchors (``doc``, ``place``, ``hash``, ``docs``).

    A snippet holds every span of ``least`` characters around its anchor. The block is the anchor's hash. For an anchor
    in more than ``hot`` records it is made finer without loss: a span around the anchor goes on for at least half of the
    rest to the left or to the right, so the snippet joins two blocks, one for the anchor with its left half and one with
    its right.
    """
    rest = least - gram
    half = rest // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {c: [] for c in ("block", "doc", "place", "start", "snippet")}
            for doc, text, found in zip(*(batch.column(c).to_pylist() for c in ("doc", "text", "found"))):
                for anchor in found:
                    place, block = anchor["place"], anchor["hash"]
                    start = max(0, place - rest)
                    blocks = [block]
                    if anchor["docs"] > hot:
                        contexts = [text[place - half : place + gram] if place >= half else "", text[place : place + gram + half]]
                        blocks = [int(gram_hashes(code_points(c), gram + half).view(np.int64)[0]) for c in contexts if len(c) == gram + half]
                    for b in blocks:
                        out["block"].append(b), out["doc"].append(doc), out["place"].append(place), out["start"].append(start)
                        out["snippet"].append(text[start : place + least])
            yield pa.RecordBatch.from_pydict(out, schema=schema)

    schema = pa.schema([("block", pa.int64()), ("doc", pa.int64()), ("place", pa.int32()), ("start", pa.int32()), ("snippet", pa.string())])
    by_doc = shared.groupBy("doc").agg(F.collect_list(F.struct("place", "hash", "docs")).alias("found"))
    return texts.join(by_doc, "doc").select("doc", "text", "found").mapInArrow(run, "block long, doc long, place int, start int, snippet string")


def shard_matches(parts: list[str], several: np.ndarray, least: int) -> np.ndarray:
    """Rows ``(x, y, place in x, place in y, length)`` of the maximal matches within the snippets of one shard: x < y, or x = y
    for the whole of a snippet that stands in ``several`` records, which finds itself.

    The matching statistics of each snippet are followed from its end to its beginning. Wherever they reach ``least``
    with places that weren't there one character before, all places are reported; so no place is missed.
    """
    codes = code_points("\0".join(parts) + "\0")
    size = np.array([len(p) for p in parts], dtype=np.int64)
    begin = np.cumsum(size + 1) - size - 1
    # A NUL in a text is no separator: it gets a number of its own, and the separators get 0.
    _, numbers = np.unique(codes, return_inverse=True)
    numbers = numbers + 1
    numbers[begin + size] = 0
    index = FMIndex(numbers, least)
    # A snippet's own place counts for one that stands in several records; another needs a second place.
    text, place, low, high, _ = index.statistics(numbers, begin, begin + size, np.where(several, 1, 2))
    out = []
    many = np.cumsum(high - low) // PAIRS_AT_ONCE
    for chunk in np.unique(many):
        part = many == chunk
        width = (high - low)[part]
        row = np.repeat(low[part], width) + np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width)
        x, at_x = np.repeat(text[part], width), np.repeat(place[part], width)
        at_y = index.places(row)
        y = np.searchsorted(begin, at_y, side="right") - 1
        keep = (x < y) | (several[x] & (at_x == at_y))
        x, y, at_x, at_y = x[keep], y[keep], at_x[keep], at_y[keep]
        left, right = _extent(numbers, at_x - 1, at_y - 1, -1), _extent(numbers, at_x + least, at_y + least, 1)
        found = np.stack([x, y, at_x - left - begin[x], at_y - left - begin[y], left + right + least], axis=1)
        out.append(np.unique(found, axis=0))
    return np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 5), np.int64)


def _extent(numbers: np.ndarray, x: np.ndarray, y: np.ndarray, step: int) -> np.ndarray:
    """How far the places ``x`` and ``y`` go on with equal characters in the direction of ``step``, not past a separator."""
    far = np.zeros(len(x), dtype=np.int64)
    live = np.arange(len(x))
    while len(live):
        p, q = x[live] + step * far[live], y[live] + step * far[live]
        inside = (np.minimum(p, q) >= 0) & (np.maximum(p, q) < len(numbers))
        live, p, q = live[inside], p[inside], q[inside]
        live = live[(numbers[p] == numbers[q]) & (numbers[p] > 0)]
        far[live] += 1
    return far


def shared_spans(documents: DataFrame, key: str = "doc_id", text: str = "text", least: int = 200, gram: int = GRAM, hot: int = HOT, tile: int = TILE) -> tuple[DataFrame, DataFrame]:
    """``(matches, members)``: matches between snippet classes, and the places of each class.

    ``members``: ``class_doc``, ``class_place`` (what names a class), ``doc``, ``start`` (of the snippet in the record) and
    ``size``. ``matches``: the names of two classes, ``at_x`` and ``at_y`` within their snippets, and ``length``. Every
    member of a class of several records shares the whole snippet with the others, which is at least ``least`` long, so
    such pairs aren't listed one by one: the class matches itself. ``spans`` and ``shared_parts`` read these two.

    Null texts, null keys and texts shorter than ``least`` share nothing. A record isn't matched with itself, nor a
    repeated row with its like. Very long texts are cut into overlapping sections and lose no span. Runs of one
    character are ordinary text. Extra columns are ignored. An empty table gives empty results.
    """
    texts = documents.filter(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text"))
    found = durable(text_anchors(texts, least, gram))
    every = found.select("doc", F.explode(F.arrays_zip("places", "hashes")).alias("a")).select("doc", F.col("a.places").alias("place"), F.col("a.hashes").alias("hash"))
    # Most anchors are in one record. A hot one is reduced before the shuffle.
    common = every.groupBy("hash").agg(F.min("doc").alias("low"), F.max("doc").alias("high"), F.count("*").alias("docs")).filter("low < high").select("hash", "docs")
    shared = every.join(common, "hash")
    pieces = durable(snippets(texts, shared, least, gram, hot))
    classes = pieces.groupBy("block", "snippet").agg(F.min(F.struct("doc", "place")).alias("name"), F.min("doc").alias("low"), F.max("doc").alias("high"))
    classes = durable(classes.select("block", "snippet", F.col("name.doc").alias("class_doc"), F.col("name.place").alias("class_place"), (F.col("low") < F.col("high")).alias("several")))
    members = pieces.join(classes, ["block", "snippet"]).select("class_doc", "class_place", "doc", "start", F.length("snippet").alias("size"), "several").distinct()

    sizes = classes.groupBy("block").agg(F.count("*").alias("m"), F.max("several").alias("some")).filter("m > 1 or some").drop("some")
    shards = max(1, -(-classes.count() // SHARD_SNIPPETS))
    tiles = F.ceil(F.col("m") / F.lit(tile)).cast("int")
    met = classes.join(sizes, "block").withColumn("tiles", tiles).withColumn("own", F.pmod(F.xxhash64("snippet"), F.col("tiles")).cast("int"))
    other = F.explode(F.when(F.col("tiles") > 1, F.sequence(F.lit(0), F.col("tiles") - 1)).otherwise(F.array(F.lit(0))))
    met = met.withColumn("other", other)
    # Small blocks share a shard; a pair of tiles of a large block has a shard of its own.
    shard = F.when(F.col("tiles") == 1, F.struct(F.pmod(F.col("block"), F.lit(shards)).alias("b"), F.lit(-1).alias("t"), F.lit(-1).alias("s"))).otherwise(
        F.struct(F.col("block").alias("b"), F.least("own", "other").alias("t"), F.greatest("own", "other").alias("s"))
    )

    def match(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates(["class_doc", "class_place"]).sort_values(["class_doc", "class_place"])
        out = shard_matches(rows["snippet"].tolist(), rows["several"].to_numpy(), least)
        doc, place = rows["class_doc"].to_numpy(), rows["class_place"].to_numpy()
        return pd.DataFrame(
            {"x_doc": doc[out[:, 0]], "x_place": place[out[:, 0]], "y_doc": doc[out[:, 1]], "y_place": place[out[:, 1]], "at_x": out[:, 2], "at_y": out[:, 3], "length": out[:, 4]}
        )

    matches = (
        met.select(shard.alias("shard"), "snippet", "class_doc", "class_place", "several")
        .groupBy("shard")
        .applyInPandas(match, "x_doc long, x_place int, y_doc long, y_place int, at_x int, at_y int, length int")
    )
    return matches, members


def _class(doc: str, place: str) -> Column:
    return F.struct(F.col(doc).alias("doc"), F.col(place).alias("place"))


def local_matches(matches: DataFrame, members: DataFrame) -> DataFrame:
    """``doc_a < doc_b``, ``start_a``, ``start_b``, ``length``: every shared stretch as the snippets show it."""
    pairs = matches.select(_class("x_doc", "x_place").alias("x"), _class("y_doc", "y_place").alias("y"), "at_x", "at_y", "length")
    places = members.select(_class("class_doc", "class_place").alias("class"), F.struct("doc", "start").alias("member"))
    every = member_pairs(pairs, places).filter("u.doc <> v.doc")
    first, at_u, at_v = F.col("u.doc") < F.col("v.doc"), F.col("u.start") + F.col("at_x"), F.col("v.start") + F.col("at_y")
    return every.select(
        F.least("u.doc", "v.doc").alias("doc_a"), F.greatest("u.doc", "v.doc").alias("doc_b"), F.when(first, at_u).otherwise(at_v).alias("start_a"), F.when(first, at_v).otherwise(at_u).alias("start_b"), "length"
    )


def merged(intervals: DataFrame, by: list[str], start: str, length: str) -> DataFrame:
    """``by``, ``start`` and ``length`` of the unions of overlapping or touching intervals. A group is one record's or one
    diagonal's own intervals, so it is bounded by the record's length."""
    order = Window.partitionBy(*by).orderBy(start, length)
    end = F.col(start) + F.col(length)
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(reach.isNull() | (F.col(start) > reach), 1).otherwise(0)
    marked = intervals.withColumn("_fresh", fresh).withColumn("_island", F.sum("_fresh").over(order)).withColumn("_end", end)
    return marked.groupBy(*by, "_island").agg(F.min(start).alias(start), F.max("_end").alias("_end")).select(*by, start, (F.col("_end") - F.col(start)).alias(length))


def spans(matches: DataFrame, members: DataFrame) -> DataFrame:
    """The maximal shared passages of each pair of records: ``doc_a``, ``doc_b``, ``start_a``, ``start_b``, ``length``."""
    local = local_matches(matches, members).withColumn("shift", F.col("start_b") - F.col("start_a")).select("doc_a", "doc_b", "shift", "start_a", "length").distinct()
    whole = merged(local, ["doc_a", "doc_b", "shift"], "start_a", "length")
    return whole.select("doc_a", "doc_b", "start_a", (F.col("start_a") + F.col("shift")).alias("start_b"), "length")


def shared_parts(matches: DataFrame, members: DataFrame, documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """For each record with a shared passage: its characters, how many of them stand in another record too, and the share.

    Pairs aren't needed for this: each class's stretches count once for each of its places.
    """
    # A class of one record matches what stands in that same record too; such stretches count only if the other class, or
    # (where a class finds itself) the class, stands in several.
    pair = matches.filter("x_doc <> y_doc")
    twin = matches.filter("x_doc = y_doc")
    several = members.filter("several").select("class_doc", "class_place").distinct()
    x, y = (several.select(F.col("class_doc").alias(f"{s}_doc"), F.col("class_place").alias(f"{s}_place")) for s in "xy")
    by_x, by_y = twin.join(x, ["x_doc", "x_place"], "left_semi"), twin.join(y, ["y_doc", "y_place"], "left_semi")
    of_x, of_y = ("x_doc", "x_place", "at_x", "length"), ("y_doc", "y_place", "at_y", "length")
    stretch = pair.select(*of_x).union(pair.select(*of_y)).union(by_x.select(*of_y)).union(by_y.select(*of_x)).distinct().toDF("class_doc", "class_place", "at", "length")
    places = stretch.join(members, ["class_doc", "class_place"]).select("doc", (F.col("start") + F.col("at")).alias("start"), "length")
    union = merged(places.distinct(), ["doc"], "start", "length").groupBy("doc").agg(F.sum("length").alias("shared_chars"))
    sizes = documents.select(F.col(key).alias("doc"), F.length(text).alias("chars")).filter("chars is not null").dropDuplicates(["doc"])
    return union.join(sizes, "doc").select(F.col("doc").alias(key), "chars", "shared_chars", F.round(F.col("shared_chars") / F.col("chars"), 6).alias("shared_part"))
