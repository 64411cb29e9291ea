"""Pairs of members of classes, where one class may hold a large part of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TILE = 1000


def member_pairs(pairs: DataFrame, members: DataFrame, tile: int = TILE) -> DataFrame:
    """The rows of ``pairs`` (classes ``x`` and ``y``, and more columns), each with every member ``u`` of x beside every member
    ``v`` of y. ``members`` has ``class`` and ``member``, each once. Where x is y, each two members meet once, in either order.

    A class of more than ``tile`` members is cut into tiles, and each pair of tiles is a row of its own that is spread by
    all its parts; so no task gets more than its share, however large a class is.
    """
    large = members.groupBy("class").count().filter(F.col("count") > tile).select("class", F.ceil(F.col("count") / tile).cast("int").alias("tiles"))
    own = members.join(large, "class", "left")
    tiled = own.groupBy("class", F.pmod(F.xxhash64("member"), F.coalesce("tiles", F.lit(1))).cast("int").alias("t")).agg(F.collect_list("member").alias("list"))

    def side(df: DataFrame, name: str, tile_name: str) -> DataFrame:
        count = F.coalesce("_tiles", F.lit(1))
        joined = df.join(large.select(F.col("class").alias(name), F.col("tiles").alias("_tiles")), name, "left")
        return joined.withColumn(tile_name, F.explode(F.sequence(F.lit(0), count - 1))).drop("_tiles")

    met = side(side(pairs, "x", "_t"), "y", "_s").filter((F.col("x") != F.col("y")) | (F.col("_t") <= F.col("_s")))
    met = met.join(tiled.select(F.col("class").alias("x"), F.col("t").alias("_t"), F.col("list").alias("_u")), ["x", "_t"])
    met = met.join(tiled.select(F.col("class").alias("y"), F.col("t").alias("_s"), F.col("list").alias("_v")), ["y", "_s"])
    spread = met.repartition("x", "_t", "y", "_s").withColumn("u", F.explode("_u")).drop("_u").withColumn("v", F.explode("_v")).drop("_v")
    return spread.filter((F.col("x") != F.col("y")) | (F.col("_t") != F.col("_s")) | (F.col("u") < F.col("v"))).drop("_t", "_s")
