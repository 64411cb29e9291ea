"""Mixing sources to target weights by systematic sampling.

Within a source, each document's expected copies are summed in order, one random offset is added, and a document is
emitted once for each integer boundary that its own step crosses.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.session import durable, release

SMALL_TABLE = 10_000


def normal_source(source: Column) -> Column:
    """A source's name without blanks around it and in upper case; a blank one is null."""
    name = F.upper(F.trim(source))
    return F.when(name != "", name)


def ranked(records: DataFrame, key: str) -> DataFrame:
    """``records`` (``source``, ``tokens``, ``key``) with ``rank``, from 1 within the source by size, then key. Records
    without a source are ranked among themselves. Columns other than these three are ignored.

    No window runs over a whole source. Rows are range-partitioned by (source, size, key), so that each partition holds
    a stretch of one or few sources; a row's rank is its number in the stretch plus the rows of the source before it,
    which come from a table of one row for each partition and source in it.
    """
    # Equal rows are told apart by where they were read, so that even very many of them don't share one stretch.
    # They are written first: a range partitioning reads its rows twice, and sizes in tokens cost most of all.
    rows = durable(records.select(key, "source", "tokens").withColumn("_row", F.monotonically_increasing_id()))
    stretches = durable(rows.repartitionByRange("source", "tokens", key, "_row").drop("_row").withColumn("_part", F.spark_partition_id()))
    release(rows)
    counts = stretches.groupBy("source", "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("source").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(F.col("source").alias("_source"), F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("source", "_part").orderBy("tokens", key))
    joined = stretches.withColumn("_inside", inside).join(counts, (F.col("_part") == F.col("_p")) & F.col("source").eqNullSafe(F.col("_source")))
    return joined.select(key, "source", "tokens", (F.col("_before") + F.col("_inside")).alias("rank"))


def plan(ranks: DataFrame, targets: DataFrame, all_tokens: int, seed: int = 0) -> DataFrame:
    """One row for each (mix, source) of ``targets``: target share and size, what the source has, expected copies of each
    of its documents, and the random offset.

    Weights are relative within a mix; null or negative ones count as 0, and rows of a mix that name one source are
    taken together. A source's target size is its share of ``budget_ratio`` times all tokens. Expected copies are that
    size over the source's own, at most ``max_repeats`` (null or below 1: once). What a small or absent source can't
    give isn't given to others, which would push their shares further from the target.
    """
    have = ranks.groupBy("source").agg(F.sum("tokens").alias("source_tokens"), F.count("*").alias("source_records"))
    wanted = (
        targets.select("mix_id", normal_source(F.col("source")).alias("source"), F.greatest(F.coalesce("target_weight", F.lit(0.0)), F.lit(0.0)).alias("w"), F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(1)).alias("r"), "budget_ratio")
        .filter(F.col("source").isNotNull())
        .groupBy("mix_id", "source")
        .agg(F.sum("w").alias("w"), F.max("r").alias("max_repeats"), F.max("budget_ratio").alias("budget_ratio"))
    )
    share = F.coalesce(F.try_divide(F.col("w"), F.sum("w").over(Window.partitionBy("mix_id"))), F.lit(0.0))
    joined = wanted.withColumn("target_share", share).join(have, "source", "left")
    target = F.col("target_share") * F.col("budget_ratio") * F.lit(float(all_tokens))
    # On a grid of 2^-20, so that offset + copies * rank is exact where the copies are a whole number.
    offset = F.pmod(F.xxhash64("mix_id", "source", F.lit(seed)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    return joined.select(
        "mix_id",
        "source",
        "target_share",
        target.alias("target_tokens"),
        "max_repeats",
        F.coalesce("source_tokens", F.lit(0)).alias("source_tokens"),
        F.coalesce("source_records", F.lit(0)).alias("source_records"),
        F.coalesce(F.least(target / F.col("source_tokens"), F.col("max_repeats").cast("double")), F.lit(0.0)).alias("copies_each"),
        offset.alias("offset"),
    )


def mix(ranks: DataFrame, planned: DataFrame, key: str) -> DataFrame:
    """``mix_id``, ``source``, ``key``, ``tokens`` and ``copies`` of every chosen record; copies never exceed the maximum.

    Documents are taken in order of size, so the sample is spread evenly over long and short ones and its size stays
    within about one document of the target. A hot source is no trouble: the plan is broadcast if its size is shown
    small, and nothing is grouped by source.
    """
    slim = planned.filter("copies_each > 0").select("mix_id", "source", "copies_each", "offset")
    slim = F.broadcast(slim) if planned.limit(SMALL_TABLE + 1).count() <= SMALL_TABLE else slim
    step = F.floor(F.col("offset") + F.col("copies_each") * F.col("rank")) - F.floor(F.col("offset") + F.col("copies_each") * (F.col("rank") - 1))
    return ranks.join(slim, "source").withColumn("copies", step).filter("copies > 0").select("mix_id", "source", key, "tokens", F.col("copies").cast("int").alias("copies"))


def shares(planned: DataFrame, mixed: DataFrame) -> DataFrame:
    """Target and real share of every (mix, source), absent sources too."""
    got = mixed.groupBy("mix_id", "source").agg(
        F.sum(F.col("tokens") * F.col("copies")).alias("mixed_tokens"), F.count("*").alias("mixed_records"), F.sum("copies").alias("mixed_copies"), F.max("copies").alias("most_copies")
    )
    out = planned.join(got, ["mix_id", "source"], "left").na.fill(0, ["mixed_tokens", "mixed_records", "mixed_copies", "most_copies"])
    real = F.coalesce(F.try_divide(F.col("mixed_tokens"), F.sum("mixed_tokens").over(Window.partitionBy("mix_id"))), F.lit(0.0))
    return out.select(
        "mix_id", "source", F.round("target_share", 6).alias("target_share"), F.round(real, 6).alias("real_share"), F.round("target_tokens", 3).alias("target_tokens"),
        "mixed_tokens", "source_tokens", "source_records", "mixed_records", "mixed_copies", "most_copies", "max_repeats",
        (F.col("copies_each") >= F.col("max_repeats")).alias("exhausted"),
    )
