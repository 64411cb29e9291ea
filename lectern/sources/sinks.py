"""Sinks: JSON lines, generations of an index that appear at once or not at all, backups, and reuse of earlier results."""

from __future__ import annotations

import json
from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

POINTER = "CURRENT.json"


def write_json_lines(df: DataFrame, path: str) -> int:
    """Writes one JSON object a row and returns how many; the rows are counted while they are written."""
    from pyspark.sql import Observation

    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("errorifexists").json(path)
    return seen.get["n"]


def _files(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where, jvm


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    """Writes a small file beside the target and renames it over, so that a reader sees the old or the new one."""
    system, where, jvm = _files(spark, path)
    beside = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid4().hex}")
    stream = system.create(beside)
    stream.write(bytearray(text.encode()))
    stream.close()
    system.delete(where, False)
    if not system.rename(beside, where):
        raise OSError(f"could not put {path} in place")


def publish_generation(
    spark: SparkSession, root: str, tables: dict[str, DataFrame], check: Callable[[dict[str, DataFrame]], None] | None = None, partition_by: dict[str, list[str]] | None = None, more: dict | None = None
) -> str:
    """Writes ``tables`` as a new generation below ``root`` and lets the pointer name it once all are written and ``check``
    has accepted what was read back. If anything fails, readers keep the generation they had. ``partition_by`` names the
    columns by which a table lies in folders; ``more`` goes into the report."""
    name = uuid4().hex
    for table, df in tables.items():
        df.write.mode("errorifexists").partitionBy((partition_by or {}).get(table, [])).parquet(f"{root}/generations/{name}/{table}")
    written = {table: spark.read.parquet(f"{root}/generations/{name}/{table}") for table in tables}
    if check:
        check(written)
    report = {**(more or {}), "generation": name, "rows": {table: df.count() for table, df in written.items()}}
    _write_text(spark, f"{root}/{POINTER}", json.dumps(report))
    return name


def open_generation(spark: SparkSession, root: str) -> tuple[dict, dict[str, DataFrame]]:
    """The report and the tables of the generation that the pointer names now."""
    report = json.loads("".join(r.value for r in spark.read.text(f"{root}/{POINTER}").collect()))
    return report, {table: spark.read.parquet(f"{root}/generations/{report['generation']}/{table}") for table in report["rows"]}


def backup(df: DataFrame, path: str) -> int:
    """A copy that never overwrites another, with its rows compared to the original's."""
    df.write.mode("errorifexists").parquet(path)
    copied, rows = df.sparkSession.read.parquet(path).count(), df.count()
    if copied != rows:
        raise OSError(f"{path} has {copied} of {rows} rows")
    return rows


def with_reuse(wanted: DataFrame, done: DataFrame, key: str, make: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """``(all, new)``: results for every key of ``wanted``, made by ``make`` only for keys that ``done`` doesn't have.

    ``new`` is what to append to ``done``. Repeated and null keys are made once or not at all.
    """
    keys = wanted.filter(F.col(key).isNotNull()).dropDuplicates([key])
    new = make(keys.join(done.select(key), key, "left_anti"))
    return done.join(keys.select(key), key, "left_semi").unionByName(new, allowMissingColumns=True), new


def unit_vectors(vectors: DataFrame, vector: str, within: float = 1e-4) -> None:
    """A check for ``publish_generation``: all numbers are finite and all vectors have length 1."""
    length = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    wrong = vectors.filter(~F.coalesce(F.abs(length - 1) < within, F.lit(False))).limit(1).count()
    if wrong:
        raise ValueError("a vector is not finite or not of length 1")


def upload_problems(files: DataFrame, most_bytes: int = 25 * 2**20, most_files: int = 20) -> DataFrame:
    """For each file of an upload (``batch``, ``name``, ``size``, ``sha256``, ``data`` in base64) what is wrong, or null."""
    from pyspark.sql import Window

    content = F.try_to_binary("data", F.lit("base64"))
    order = Window.partitionBy("batch").orderBy("name")
    problem = (
        F.when(~F.coalesce(F.col("name").rlike(r"^[^/\\\x00-\x1f.][^/\\\x00-\x1f]*$"), F.lit(False)), "name")
        .when(content.isNull(), "encoding")
        .when(F.length(content) != F.col("size"), "size")
        .when(F.sha2(content, 256) != F.lower("sha256"), "hash")
        .when(F.sum(F.length(content)).over(order.rowsBetween(Window.unboundedPreceding, 0)) > most_bytes, "batch too large")
        .when(F.row_number().over(order) > most_files, "too many files")
    )
    return files.select("batch", "name", problem.alias("problem"))


LIBRARY = T.StructType(
    [T.StructField("id", T.StringType(), False), T.StructField("kind", T.StringType()), T.StructField("title", T.StringType()), T.StructField("revision", T.IntegerType()), T.StructField("payload", T.StringType()), T.StructField("deleted", T.BooleanType())]
)


def accepted_changes(current: DataFrame, changes: DataFrame) -> DataFrame:
    """Of proposed changes to a log of items (``id``, ``base_revision``, ...) those that build on the item's present
    revision (0 for a new one), with their new ``revision``. Of several for one item the first in order of ``proposed_at``
    wins; the others are conflicts and are left out."""
    latest = current.groupBy("id").agg(F.max("revision").alias("_now"))
    based = changes.join(latest, "id", "left").filter(F.col("base_revision") == F.coalesce("_now", F.lit(0)))
    first = based.groupBy("id").agg(F.min_by(F.struct(*[c for c in based.columns if c not in ("id", "_now")]), "proposed_at").alias("c"))
    return first.select("id", "c.*").withColumn("revision", F.col("base_revision") + 1)
