"""Queries of the core's numbered problem (4) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators import snapshots
from lectern.sources.tables import table


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return snapshots.archive_changes(table(spark, folder, "sources")).select("snapshot_no", "path", "change")


def p4_changed_fields(spark: SparkSession, folder: str) -> DataFrame:
    """For each snapshot and field, how many paths changed in it: what wobbles and what really changed."""
    changed = snapshots.archive_changes(table(spark, folder, "sources"), snapshots.FILE_FIELDS)
    return (
        changed.filter("change = 'changed'")
        .select("snapshot_no", F.explode("changed_fields").alias("field"))
        .groupBy("snapshot_no", "field")
        .agg(F.count("*").alias("paths"))
    )


QUERIES = {"p4_found": p4_found, "p4_changed_fields": p4_changed_fields}

_CLEAN = r"""
WITH clean AS (
  SELECT * REPLACE (
    regexp_replace(replace(path, '\', '/'), '^(\./+)+', '') AS path,
    nullif(regexp_replace(lower(trim(content_hash)), '^sha256:', ''), '') AS content_hash)
  FROM sources WHERE path IS NOT NULL AND snapshot_no IS NOT NULL
), latest AS (
  SELECT * FROM clean
  QUALIFY row_number() OVER (PARTITION BY snapshot_no, path ORDER BY delivered_at DESC NULLS LAST, {ties}) = 1
), numbers AS (
  SELECT snapshot_no, lead(snapshot_no) OVER (ORDER BY snapshot_no) AS following FROM (SELECT DISTINCT snapshot_no FROM latest)
), before AS (
  SELECT latest.* EXCLUDE (snapshot_no), following AS snapshot_no FROM latest JOIN numbers USING (snapshot_no) WHERE following IS NOT NULL
), after AS (
  SELECT * FROM latest WHERE snapshot_no > (SELECT min(snapshot_no) FROM latest)
)
"""
_FIELDS = snapshots.FILE_FIELDS

ORACLES = {
    "p4_found": _CLEAN.format(ties="content_hash DESC NULLS LAST")
    + """
SELECT coalesce(a.snapshot_no, b.snapshot_no) AS snapshot_no, coalesce(a.path, b.path) AS path,
  CASE WHEN b.path IS NULL THEN 'added' WHEN a.path IS NULL THEN 'deleted' ELSE 'changed' END AS change
FROM after a FULL JOIN before b ON a.snapshot_no = b.snapshot_no AND a.path = b.path
WHERE a.path IS NULL OR b.path IS NULL OR a.content_hash IS DISTINCT FROM b.content_hash
""",
    "p4_changed_fields": _CLEAN.format(ties=", ".join(f"{f} DESC NULLS LAST" for f in _FIELDS))
    + "SELECT snapshot_no, field, count(*) AS paths FROM ("
    + " UNION ALL ".join(
        f"SELECT a.snapshot_no, '{f}' AS field FROM after a JOIN before b ON a.snapshot_no = b.snapshot_no AND a.path = b.path WHERE a.{f} IS DISTINCT FROM b.{f}"
        for f in _FIELDS
    )
    + ") GROUP BY ALL",
}
