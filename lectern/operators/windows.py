"""Patterns over ordered rows: rolling extremes, drawdown, differences, gap filling, runs and latest revisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rolling_extremes(df: DataFrame, by: list[str], order: list[str], value: str, rows: int) -> DataFrame:
    """The greatest and smallest value of the ``rows`` rows before, without the row itself."""
    frame = Window.partitionBy(*by).orderBy(*order).rowsBetween(-rows, -1)
    return df.withColumn("rolling_high", F.max(value).over(frame)).withColumn("rolling_low", F.min(value).over(frame))


def drawdown(df: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """The greatest value so far, and how far the row is below it."""
    frame = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("peak", F.max(value).over(frame)).withColumn("drawdown", F.col("peak") - F.col(value))


def differences(df: DataFrame, by: list[str], order: list[str], value: str, lag: int = 1) -> DataFrame:
    """The change of the value since ``lag`` rows before; null for the first rows."""
    before = F.lag(value, lag).over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("change", F.col(value) - before)


def grid_filled(df: DataFrame, by: list[str], time: str, value: str, step: str) -> DataFrame:
    """A row for every step from a group's first to its last, with the last value observed by then.

    Of several values in a step the last counts. A gap is filled from the interval between two observations, not by a
    window over the filled rows: each observation is repeated until the next.
    """
    slot = F.date_trunc(step, F.col(time))
    last = df.groupBy(*by, slot.alias("slot")).agg(F.max_by(value, time).alias(value))
    following = F.lead("slot").over(Window.partitionBy(*by).orderBy("slot"))
    unit = F.expr(f"interval 1 {step}")
    until = F.when(F.col("_next").isNotNull(), F.col("_next") - unit).otherwise(F.col("slot"))
    return last.withColumn("_next", following).withColumn("slot", F.explode(F.sequence(F.col("slot"), until, unit))).drop("_next")


def histogram(df: DataFrame, value: Column, low: float, width: float, bins: int) -> DataFrame:
    """Counts in ``bins`` bins from ``low``; the first and the last are open."""
    number = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor((value - low) / width)))
    return df.filter(value.isNotNull()).select(number.cast("int").alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))


def latest(df: DataFrame, keys: list[str], order: list[str], deleted: Column | None = None) -> DataFrame:
    """The current row of each key of an append-only log: the one with the greatest ``order``; deleted ones are left out.

    A key with very many revisions is reduced before the shuffle.
    """
    rest = [c for c in df.columns if c not in keys]
    gone = F.coalesce(deleted, F.lit(False)) if deleted is not None else F.lit(False)
    row = F.max_by(F.struct(*rest, gone.alias("_gone")), F.struct(*order))
    return df.groupBy(*keys).agg(row.alias("r")).filter("not r._gone").select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest])


def runs(df: DataFrame, by: list[str], order: list[str], state: str) -> DataFrame:
    """Consecutive rows of one state as one row: the state, its first and last order value, and its rows."""
    window = Window.partitionBy(*by).orderBy(*order)
    fresh = F.when(F.lag(state).over(window).eqNullSafe(F.col(state)) & (F.row_number().over(window) > 1), 0).otherwise(1)
    numbered = df.withColumn("_fresh", fresh).withColumn("_run", F.sum("_fresh").over(window))
    ends = [F.min(order[0]).alias("first"), F.max(order[0]).alias("last"), F.count("*").alias("rows")]
    return numbered.groupBy(*by, "_run", state).agg(*ends).drop("_run")


def carried_forward(df: DataFrame, by: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """The last value that isn't null, up to and with the row."""
    frame = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(name, F.last(value, ignorenulls=True).over(frame))
