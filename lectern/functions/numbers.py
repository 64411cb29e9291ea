"""Cells of a table as numbers and dates, and sums without rounding error."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NUMBER = r"^\s*[+-]?(\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)([eE][+-]?\d+(_\d+)*)?\s*$"


def number(cell: Column) -> Column:
    """A cell's finite number, or null. Underscores between digits are allowed; ``1d``, hexadecimal and ``NaN`` are not."""
    value = F.when(cell.rlike(NUMBER), F.trim(F.regexp_replace(cell, "_", "")).try_cast("double"))
    return F.when(F.abs(value) < float("inf"), value)


def iso_date(cell: Column, order: str = "iso") -> Column:
    """A cell's date and time in ISO form, or null. Dates with slashes count only if ``order`` is ``mdy`` or ``dmy``. A time
    with a zone keeps it as it is written (``Z`` as ``+00:00``)."""
    if order not in ("iso", "mdy", "dmy"):
        raise ValueError("dates are iso, mdy or dmy")
    shape = F.when(cell.rlike(r"^\d{4}-\d{2}-\d{2}(?:$|[ T])"), cell.try_cast("timestamp_ntz"))
    if order != "iso":
        pattern = "M/d/yyyy" if order == "mdy" else "d/M/yyyy"
        slashed = F.when(cell.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), F.try_to_timestamp(cell, F.lit(pattern)).cast("timestamp_ntz"))
        shape = F.coalesce(slashed, shape)
    zone = F.regexp_replace(F.regexp_extract(cell, r"\d{2}:\d{2}[\d:.]*(Z|[+-]\d{2}:\d{2})$", 1), "^Z$", "+00:00")
    return F.concat(F.date_format(shape, "yyyy-MM-dd'T'HH:mm:ss"), zone)


def partial_sum(values: list[float]) -> list[float]:
    """Numbers that don't overlap and whose sum is exactly that of ``values``."""
    parts: list[float] = []
    for x in values:
        kept = 0
        for y in parts:
            if abs(x) < abs(y):
                x, y = y, x
            high = x + y
            low = y - (high - x)
            if low:
                parts[kept] = low
                kept += 1
            x = high
        parts[kept:] = [x]
    return parts


def exact_sum(df: DataFrame, value: str, by: list[str], name: str = "total") -> DataFrame:
    """The sum of ``value`` for each ``by``, rounded once; null for a group without a number.

    Each task reduces its rows to a few numbers a group with exactly their sum, so a group that holds a third of all
    rows costs its last task only that many numbers for each task before it. NaN and infinities are no numbers. Groups
    of null are a group. An empty table gives no rows.
    """
    kinds = dict(df.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in by)

    def reduce(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple, list[float]] = {}
        names: dict[tuple, tuple] = {}
        for rows in batches:
            groups = rows.groupby(by, dropna=False)["v"] if by else [((), rows["v"])]
            for key, own in groups:
                key = key if isinstance(key, tuple) else (key,)
                same = tuple("" if pd.isna(k) else k for k in key)
                names[same] = key
                finite = [float(x) for x in own if x is not None and math.isfinite(x)]
                sums[same] = partial_sum([*sums.get(same, []), *finite])
        yield pd.DataFrame([(*names[k], s) for k, s in sums.items()], columns=[*by, "parts"])

    def total(rows: pd.DataFrame) -> pd.DataFrame:
        parts = [x for own in rows["parts"] for x in own]
        return rows.head(1)[by].assign(**{name: math.fsum(parts) if parts else None}).astype({name: "float64"})

    slim = df.select(*by, F.col(value).cast("double").alias("v"))
    partial = slim.mapInPandas(reduce, ", ".join(x for x in (schema, "parts array<double>") if x))
    return partial.groupBy(*by).applyInPandas(total, ", ".join(x for x in (schema, f"`{name}` double") if x))
