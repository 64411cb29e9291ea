"""Chunks of extracted records: normal whitespace, overlapping pieces, stable identities, token windows."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from operator import itemgetter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import normal_whitespace

#: Longest chunk, overlap, and the token windows of the encoder.
LIMIT, OVERLAP = 3500, 400
WINDOW, STRIDE = 224, 192


def _text(c: Column) -> Column:
    """A part of an identity; a missing one is written as ``None``."""
    return F.coalesce(c.cast("string"), F.lit("None"))


def parent_id(document: Column, kind: Column, locator: Column) -> Column:
    key = F.concat_ws("|", _text(document), _text(kind), _text(locator))
    return F.concat(F.lit("parent:"), F.sha1(key.cast("binary")))


def chunk_id(document: Column, kind: Column, locator: Column, part: Column, text: Column) -> Column:
    key = F.concat_ws("|", _text(document), _text(kind), _text(locator), _text(part), _text(text))
    return F.concat(F.lit("chunk:"), F.sha2(key.cast("binary"), 256))


def token_estimate(text: Column) -> Column:
    """A quarter of the characters, halves to even, at least 1."""
    return F.greatest(F.lit(1), F.bround(F.length(text) / 4).cast("int"))


#: After these a text may be cut: a line's end, or a sentence's with the blank behind it.
_ENDS = re.compile(r"\n|\. ")


def _pieces(text: str, limit: int, overlap: int) -> list[tuple[int, int]]:
    """``(start, end)`` of the pieces of a text, before they are stripped. All ends are listed once; each piece takes the last
    one that fits, if it lies in the second half of its space, and else all of its space."""
    ends = [m.span() for m in _ENDS.finditer(text)]
    out, start = [], 0
    while start + limit < len(text):
        last = bisect_right(ends, start + limit, key=itemgetter(1)) - 1
        stop = ends[last][1] if last >= 0 and ends[last][0] >= start + limit // 2 else start + limit
        out.append((start, stop))
        start = max(start + 1, stop - overlap)
    return [*out, (start, len(text))]


def chunks(records: DataFrame, key: list[str], text: str = "text", limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """``key``, ``part_number``, ``part_count``, ``char_start``, ``char_end``, ``token_estimate`` and ``text`` of the chunks
    of each record. Offsets are those of the whitespace-normalised text. Records without text give none, and neither does
    a piece that is blank.

    The texts are read once. Only those beyond the limit go to Python.
    """

    def stripped(t: str) -> list[dict]:
        out = []
        for s, e in _pieces(t, limit, overlap):
            if own := t[s:e].strip():
                first = s + t[s:e].index(own[0])
                out.append({"s": first, "e": first + len(own), "t": own})
        return out

    @F.pandas_udf("array<struct<s: int, e: int, t: string>>")
    def places(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield batch.map(lambda t: stripped(t) if t is not None else None)

    clean = records.select(*key, normal_whitespace(F.col(text)).alias("_t")).filter("_t <> ''")
    cut = clean.withColumn("_p", places(F.when(F.length("_t") > limit, F.col("_t"))))
    whole = F.array(F.struct(F.lit(0).alias("s"), F.length("_t").alias("e"), F.col("_t").alias("t")))
    kept = F.coalesce("_p", whole)
    every = cut.select(*key, kept.alias("_c")).select(*key, F.size("_c").alias("part_count"), F.posexplode("_c").alias("_n", "c"))
    return every.select(
        *key, (F.col("_n") + 1).alias("part_number"), "part_count", F.col("c.s").alias("char_start"), F.col("c.e").alias("char_end"), token_estimate(F.col("c.t")).alias("token_estimate"), F.col("c.t").alias("text")
    )


def token_windows(texts: DataFrame, key: list[str], tokens: Column, window: int = WINDOW, stride: int = STRIDE) -> DataFrame:
    """``key``, ``win_start``, ``win_end`` and ``tokens`` of windows over each text's tokens; the last reaches the end, and a
    text without tokens has one empty window."""
    size = F.size("_t")
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), size - window + stride - 1), F.lit(stride))
    each = texts.select(*key, tokens.alias("_t")).select(*key, "_t", F.explode(F.when(size <= window, F.array(F.lit(0))).otherwise(starts)).alias("win_start"))
    each = each.filter((F.col("win_start") == 0) | (F.col("win_start") - stride + window < size))
    return each.select(*key, "win_start", F.least(F.col("win_start") + window, size).alias("win_end"), F.slice("_t", F.col("win_start") + 1, F.lit(window)).alias("tokens"))
