"""Splitting oversized items at natural boundaries, by balanced targets.

The smallest number of pieces that can hold the text is computed first; their ends are placed at equal lengths and each
is snapped to the strongest boundary near its target. If a piece then breaks a limit, one more piece is planned.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions.columns import set_aside

#: Boundaries, the strongest first. A cut is made at the end of a match.
BOUNDARIES = (
    ("paragraph", re.compile(r"\n[^\S\n]*\n\s*|\r\n\s*\r\n\s*|\f\s*")),
    ("line", re.compile(r"\r\n?|\n")),
    ("sentence", re.compile(r"[.!?…。！？][\"')\]”’]*\s+|[。！？]")),
    ("clause", re.compile(r"[,;:]\s+")),
    ("word", re.compile(r"\s+")),
)
PIECES = "array<struct<start: int, end: int, boundary: string, text: string>>"
COLUMNS = ("piece_no", "piece_count", "piece_start", "piece_end", "piece_boundary", "piece_text")


def _ranked_cuts(text: str, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions in ``[low, high]`` where the text may be cut, and the rank of the boundary there (0 is the strongest)."""
    ranks: dict[int, int] = {}
    for rank, (_, pattern) in enumerate(BOUNDARIES):
        # A little more text on the left, so that a boundary that begins before the window is seen whole.
        for match in pattern.finditer(text, max(0, low - 8), min(len(text), high + 8)):
            if low <= match.end() <= high:
                ranks.setdefault(match.end(), rank)
    at = np.fromiter(ranks, dtype=np.int64, count=len(ranks))
    return at, np.fromiter(ranks.values(), dtype=np.int64, count=len(ranks))


def balanced_cuts(text: str, limit: int, overlap: int) -> list[tuple[int, int, str]]:
    """``(start, end, boundary)`` of the pieces of ``text``, each of at most ``limit`` characters, each beginning
    ``overlap`` characters before the end of the one before. A text within the limit is one piece."""
    size = len(text)
    if size <= limit:
        return [(0, size, "end")]
    count = max(2, -(-(size - overlap) // (limit - overlap)))
    while True:
        length = (size + (count - 1) * overlap) / count
        reach = int(min(limit / 8, (length - overlap) / 4))
        pieces, start = [], 0
        for number in range(1, count):
            target = round(number * length - (number - 1) * overlap)
            low, high = max(start + overlap + 1, target - reach), min(start + limit, target + reach, size - 1)
            if low > high:
                break
            at, rank = _ranked_cuts(text, low, high)
            if len(at):
                best = np.lexsort((at, np.abs(at - target), rank))[0]
                end, kind = int(at[best]), BOUNDARIES[rank[best]][0]
            else:
                end, kind = min(max(target, low), high), "character"
            pieces.append((start, end, kind))
            start = end - overlap
        else:
            if size - start <= limit:
                return [*pieces, (start, size, "end")]
        count += 1


def split_oversized(items: DataFrame, text: str = "text", limit: int = 3500, overlap: int = 400) -> DataFrame:
    """One row for each piece of each item whose ``text`` has more than ``limit`` characters (code points).

    Every input column but the text is kept, and these are added: ``piece_no`` from 1, ``piece_count``, ``piece_start``
    and ``piece_end`` (half-open, in characters of the text), ``piece_boundary`` (paragraph, line, sentence, clause,
    word, character, or end for the last piece) and ``piece_text``. The pieces cover the text; consecutive ones share
    exactly ``overlap`` characters.

    Null and empty texts and those within the limit are no oversized items and give no rows. Repeated rows are each
    split. An extra column named like an added one is kept as ``<name>_input``. Very long texts are cut in time
    proportional to their length; the whole text isn't repeated beside its pieces.
    """
    if not 0 <= overlap < limit / 2:
        raise ValueError("the overlap must be at least 0 and less than half of the limit")

    @F.pandas_udf(PIECES)
    def cut(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield batch.map(lambda t: [{"start": s, "end": e, "boundary": b, "text": t[s:e]} for s, e, b in balanced_cuts(t, limit, overlap)])

    clear = set_aside(items, COLUMNS, keep=[text])
    kept = [c for c in clear.columns if c != text]
    # The length is tested before the text goes to Python; small items never leave the JVM.
    large = clear.filter(F.length(text) > limit)
    return (
        large.select(*kept, cut(text).alias("_pieces"))
        .select(*kept, F.size("_pieces").alias("piece_count"), F.posexplode("_pieces").alias("_pos", "_piece"))
        .select(
            *kept,
            (F.col("_pos") + 1).alias("piece_no"),
            "piece_count",
            F.col("_piece.start").alias("piece_start"),
            F.col("_piece.end").alias("piece_end"),
            F.col("_piece.boundary").alias("piece_boundary"),
            F.col("_piece.text").alias("piece_text"),
        )
    )
