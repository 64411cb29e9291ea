"""Questions to one table: a range of rows and columns, one filter, one aggregate, a profile and a preview."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.numbers import exact_sum, iso_date, number
from lectern.functions.text import unit_of

#: The operations, and the bounds of a cell range.
OPERATIONS = ("preview", "count", "sum", "mean", "min", "max", "stddev")
MOST_ROWS, MOST_COLUMNS, PREVIEW_ROWS = 2_000_000, 256, 30


def column_letter(index: int) -> str:
    """1 is A, 27 is AA."""
    letters = ""
    while index:
        index, rest = divmod(index - 1, 26)
        letters = chr(65 + rest) + letters
    return letters


def column_index(letters: str) -> int:
    index = 0
    for letter in letters.upper():
        index = index * 26 + ord(letter) - 64
    return index


def cell_range(text: str) -> tuple[int, int, int, int]:
    """First column, first row, last column and last row of ``A1:F500``; empty text is everything within the bounds."""
    import re

    text = text.strip().upper()
    if not text:
        return 1, 1, MOST_COLUMNS, MOST_ROWS
    match = re.fullmatch(r"([A-Z]{1,3})([1-9]\d*):([A-Z]{1,3})([1-9]\d*)", text)
    if not match:
        raise ValueError("use a cell range such as A1:F500")
    c1, r1, c2, r2 = column_index(match[1]), int(match[2]), column_index(match[3]), int(match[4])
    if not (1 <= c1 <= c2 <= MOST_COLUMNS and 1 <= r1 <= r2 <= MOST_ROWS):
        raise ValueError("the range is out of bounds")
    return c1, r1, c2, r2


def in_bounds(cell: Column, kind: str = "number", low: str | float | None = None, high: str | float | None = None, order: str = "iso") -> Column:
    """Whether a cell is a number (or date) within inclusive bounds. One that is neither is outside even without bounds;
    dates compare as ISO text."""
    if kind not in ("number", "date"):
        raise ValueError("a filter is for numbers or dates")
    parsed = number(cell.cast("string")) if kind == "number" else iso_date(cell.cast("string"), order)
    keep = parsed.isNotNull()
    if low is not None:
        keep = keep & (parsed >= F.lit(low))
    if high is not None:
        keep = keep & (parsed <= F.lit(high))
    return keep


def aggregate(rows: DataFrame, cell: str, keep: Column | None = None) -> DataFrame:
    """One row: rows scanned, matched and filtered out, numeric values, and count, mean, min, max and sample deviation.

    Sum, mean, min and max are null without a numeric value, the deviation with fewer than two. The sum here is the plain
    one; ``exact_total`` has the one without rounding error.
    """
    matched = F.coalesce(keep, F.lit(False)) if keep is not None else F.lit(True)
    value = F.when(matched, number(F.col(cell).cast("string")))
    return rows.select(matched.alias("m"), value.alias("v")).agg(
        F.count("*").alias("rows_scanned"),
        F.count_if("m").alias("rows_matched"),
        F.count_if(~F.col("m")).alias("rows_filtered_out"),
        F.count("v").alias("numeric_values"),
        F.sum("v").alias("sum"),
        F.avg("v").alias("mean"),
        F.min("v").alias("min"),
        F.max("v").alias("max"),
        F.stddev_samp("v").alias("stddev"),
    )


def delimited_lines(texts: DataFrame, key: list[str], text: str, separator: str = ",") -> DataFrame:
    """The lines of delimited texts as rows of tables: ``key``, ``row_number`` (from 1), ``cells`` and ``formulas`` (all null).
    Quoted cells may hold separators and doubled quotes; a byte-order mark is no part of a cell. Null texts give none."""
    lines = F.split(F.regexp_replace(F.regexp_replace(F.col(text), "^\ufeff", ""), r"\r\n?", "\n"), "\n")
    sign = "\\t" if separator == "\t" else f"[{separator}]"
    # With a separator in front of the first cell too, no match is empty.
    found = F.regexp_extract_all(F.concat(F.lit(separator), "line"), F.lit(f'{sign}("(?:[^"]|"")*"|(?:(?!{sign}).)*)'), 1)
    plain = F.transform(found, lambda c: F.when(c.startswith('"'), F.replace(F.regexp_replace(c, '^"|"$', ""), F.lit('""'), F.lit('"'))).otherwise(c))
    each = texts.select(*key, F.posexplode(lines).alias("n", "line")).filter("line <> ''")
    return each.select(*key, (F.col("n") + 1).cast("long").alias("row_number"), plain.alias("cells")).withColumn("formulas", F.transform("cells", lambda c: F.lit(None).cast("string")))


def answer(
    rows: DataFrame, key: list[str], column: str, selected: str = "", header: bool = True, where: str | None = None, kind: str = "number", low: str | float | None = None, high: str | float | None = None, order: str = "iso"
) -> DataFrame:
    """One bounded question to each table (``key``) of ``rows`` (``row_number``, ``cells``, ``formulas``): the figures of one column
    over the rows of a cell range that pass one filter.

    ``selected`` is a range such as ``A1:F500``, or empty for all within the bounds; with ``header`` its first row has the
    labels. ``column`` and ``where`` (the filter's column) are letters within the range. One row for each table: ``label``
    and ``unit`` of the column, rows scanned, matched and excluded, numeric values, formulas in the range and how many have
    no cached value, and sum, mean, min, max and sample deviation. Formulas are reported, never evaluated. A row is one
    of partial sums, so a table may be of any size. Bounds that aren't a number or date, or are in the wrong order, and
    columns outside the range are errors. No rows give no tables.
    """
    c1, r1, c2, r2 = cell_range(selected)
    asked, filtered = column_index(column), column_index(where) if where else None
    if not c1 <= asked <= c2 or filtered is not None and not c1 <= filtered <= c2:
        raise ValueError("the column lies outside the range")
    if low is not None and high is not None and low > high:
        raise ValueError("the lower bound is above the upper one")
    inside = rows.filter(F.col("row_number").between(r1, r2))
    is_label = (F.col("row_number") == r1) if header else F.lit(False)
    keep = in_bounds(F.get("cells", F.lit(filtered - 1)), kind, low, high, order) if filtered is not None else F.lit(True)
    body = ~is_label
    matched = body & F.coalesce(keep, F.lit(False))
    within = F.slice(F.arrays_zip(F.col("cells").alias("value"), F.col("formulas").alias("formula")), c1, c2 - c1 + 1)
    formulas = F.filter(within, lambda c: c["formula"].isNotNull())
    value = F.when(matched, number(F.get("cells", F.lit(asked - 1))))
    label = F.max(F.when(is_label, F.get("cells", F.lit(asked - 1)))) if header else F.lit(column.upper())
    slim = inside.select(*key, "row_number", "cells", body.alias("_body"), matched.alias("_matched"), value.alias("_v"), F.size(formulas).alias("_f"), F.size(F.filter(formulas, lambda c: c["value"].isNull())).alias("_empty"))
    out = slim.groupBy(*key).agg(
        label.alias("label"), F.count_if("_body").alias("rows_scanned"), F.count_if("_matched").alias("rows_matched"), F.count_if(F.col("_body") & ~F.col("_matched")).alias("rows_excluded"),
        F.count("_v").alias("numeric_values"), F.sum("_f").alias("formulas"), F.sum("_empty").alias("missing_caches"),
        F.sum("_v").alias("sum"), F.avg("_v").alias("mean"), F.min("_v").alias("min"), F.max("_v").alias("max"), F.stddev_samp("_v").alias("stddev"),
    )
    return out.withColumn("unit", unit_of(F.coalesce("label", F.lit(""))))


def exact_total(rows: DataFrame, cell: str, by: list[str] | None = None, name: str = "total") -> DataFrame:
    """The sum of a column's numbers rounded only once, for each group."""
    return exact_sum(rows.withColumn("_n", number(F.col(cell).cast("string"))), "_n", by or [], name)


def profile(rows: DataFrame, columns: dict[str, str], order: str = "iso") -> DataFrame:
    """For each column (name to header): numeric and filled cells, first and last date, label and unit. One pass."""
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.lit(h).alias("label"), F.col(c).cast("string").alias("cell")) for c, h in columns.items()]))
    each = rows.select(cells.alias("c")).select("c.*").withColumn("date", iso_date(F.col("cell"), order))
    return each.groupBy("column", "label").agg(
        F.count(number(F.col("cell"))).alias("numeric"),
        F.count_if(F.coalesce(F.col("cell") != "", F.lit(False))).alias("nonempty"),
        F.min("date").alias("date_min"),
        F.max("date").alias("date_max"),
        F.first(unit_of(F.col("label"))).alias("unit"),
    )


def preview(rows: DataFrame, order: list[str], keep: Column | None = None, most: int = PREVIEW_ROWS) -> DataFrame:
    """The first matching rows in row order."""
    return (rows.filter(keep) if keep is not None else rows).orderBy(*order).limit(most)
