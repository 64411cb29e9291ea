"""What changed between consecutive full snapshots of a table.

Each row of a snapshot is unpivoted into cells (key, field, value) and one key-presence marker. A cell counts +1 in the
comparison where its snapshot is the later one and -1 where it is the earlier one. Equal cells cancel; what is left
classifies the key: a presence of +1 is an addition, of -1 a deletion, and otherwise the fields whose cells did not
cancel are the changed ones.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PRESENCE = ""
#: As many snapshots are joined by broadcast; more are shuffled.
SMALL_TABLE = 10_000


def normal_path(path: Column) -> Column:
    """Slashes for backslashes, without any leading ``./``. Letters keep their case."""
    return F.regexp_replace(F.translate(path, "\\", "/"), r"^(\./+)+", "")


def normal_hash(digest: Column) -> Column:
    """The hex digits alone: lower case, without blanks and ``sha256:``. Null stays null, and so does an empty one."""
    bare = F.regexp_replace(F.lower(F.trim(digest)), "^sha256:", "")
    return F.when(bare != "", bare)


def latest_rows(df: DataFrame, keys: Sequence[str], order: str, fields: Sequence[str]) -> DataFrame:
    """One row for each ``keys``: the one with the greatest ``order``; among equals, the one with the greatest fields.

    The maximum of a struct is a partial aggregate: a key repeated in very many rows is reduced before the shuffle.
    A null ``order`` is below every other.
    """
    best = F.max(F.struct(F.col(order).alias("o"), *[F.col(f).alias(f"v{i}") for i, f in enumerate(fields)])).alias("best")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col(f"best.v{i}").alias(f) for i, f in enumerate(fields)])


def changes(df: DataFrame, snapshot: str, key: str, fields: Sequence[str], delivered: str | None = None) -> DataFrame:
    """``snapshot_no``, ``key``, ``change`` (``added``, ``deleted`` or ``changed``) and ``changed_fields`` for every delivered
    snapshot after the first, against the delivered one before it.

    ``snapshot`` and ``key`` name columns; rows where either is null are left out, since they belong to no snapshot or
    no record. With ``delivered``, the row of a key with the latest such time counts; without, repeated rows of a key
    count once, and of differing ones that with the greatest fields. A null field equals only null. An empty table and
    a table of one snapshot give no rows. Columns other than the named ones are ignored, whatever their names.

    A third of all rows may share a key: the rows are reduced to one a snapshot before they are unpivoted, so the
    grouped sums see at most as many rows of a key as there are snapshots, times the fields.
    """
    rows = df.filter(F.col(snapshot).isNotNull() & F.col(key).isNotNull()).select(
        F.col(snapshot).alias("_s"),
        F.col(key).alias("_k"),
        (F.col(delivered) if delivered else F.lit(0)).alias("_o"),
        *[F.col(f).cast("string").alias(f"_f{i}") for i, f in enumerate(fields)],
    )
    inner = [f"_f{i}" for i in range(len(fields))]
    rows = latest_rows(rows, ["_s", "_k"], "_o", inner)

    # One row for each delivered snapshot: as many as there were deliveries, so that one window over them is small.
    numbers = rows.select("_s").distinct()
    in_order = Window.orderBy("_s")
    order = numbers.select("_s", F.lead("_s").over(in_order).alias("_next"), F.lag("_s").over(in_order).alias("_before"))
    small = numbers.limit(SMALL_TABLE + 1).count() <= SMALL_TABLE
    rows = rows.join(F.broadcast(order) if small else order, "_s")

    sides = F.array(
        F.when(F.col("_before").isNotNull(), F.struct(F.col("_s").alias("at"), F.lit(1).alias("sign"))),
        F.when(F.col("_next").isNotNull(), F.struct(F.col("_next").alias("at"), F.lit(-1).alias("sign"))),
    )
    cells = F.array(
        F.struct(F.lit(PRESENCE).alias("field"), F.lit("").alias("value")),
        *[F.struct(F.lit(f"{f}").alias("field"), F.col(f"_f{i}").alias("value")) for i, f in enumerate(fields)],
    )
    signed = (
        rows.select("_k", F.explode(F.array_compact(sides)).alias("side"), cells.alias("cells"))
        .select("_k", "side", F.explode("cells").alias("cell"))
        .select(F.col("side.at").alias("_at"), "_k", F.col("cell.field").alias("_field"), F.col("cell.value").alias("_value"), F.col("side.sign").alias("_sign"))
        # One exchange on a prefix of both groupings below: neither of them shuffles again.
        .repartition("_at", "_k")
    )
    left = signed.groupBy("_at", "_k", "_field", "_value").agg(F.sum("_sign").alias("_sum")).filter("_sum <> 0")
    presence = F.sum(F.when(F.col("_field") == PRESENCE, F.col("_sum")).otherwise(0))
    by_key = left.groupBy("_at", "_k").agg(
        presence.alias("_presence"),
        F.array_sort(F.collect_set(F.when(F.col("_field") != PRESENCE, F.col("_field")))).alias("_fields"),
    )
    kind = F.when(F.col("_presence") > 0, "added").when(F.col("_presence") < 0, "deleted").otherwise("changed")
    return by_key.select(
        F.col("_at").alias("snapshot_no"),
        F.col("_k").alias(key),
        kind.alias("change"),
        F.when(F.col("_presence") == 0, F.col("_fields")).otherwise(F.array().cast("array<string>")).alias("changed_fields"),
    )


FILE_FIELDS = (
    "document_id course course_label term content_type folder file_type lecturer review version_family version_label content_hash"
).split()


def archive_changes(sources: DataFrame, fields: Sequence[str] = ("content_hash",)) -> DataFrame:
    """``changes`` of the path list, with paths and hashes written alike."""
    clean = sources.withColumn("path", normal_path(F.col("path"))).withColumn("content_hash", normal_hash(F.col("content_hash")))
    return changes(clean, "snapshot_no", "path", fields, "delivered_at")
