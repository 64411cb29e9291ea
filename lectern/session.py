"""Session helpers: a local session for tests and benches, and durable cuts of a lineage."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

#: Fixed value: the setting by which Spark removes the shuffle files of a job as soon as its result is written.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A single-machine session for tests and benches. On a cluster, use the session that the cluster gives."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("lectern")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for durable intermediate results.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session, whose executors are this very process, may
    leave it unset; then a temporary folder is made, once a session. On a cluster an unset folder is an error.
    """
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    set_before = context._jsc.sc().getCheckpointDir()
    if set_before.isDefined():
        return set_before.get()
    if not context.master.split("[")[0] == "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-lectern-"))
    return context._jsc.sc().getCheckpointDir().get()


def _own_folder(spark: SparkSession) -> str:
    return f"{checkpoint_dir(spark)}/lectern-{spark.sparkContext.applicationId}"


def durable(df: DataFrame) -> DataFrame:
    """``df`` computed now and written as a table in the shared folder: later uses read it, also after executors are lost.

    The shuffle files of the computation are removed once the table is written. Give the table to ``release`` when it is
    no longer needed; ``clean_up`` removes all that a session has left, at the latest when the program ends.
    """
    spark = df.sparkSession
    folder = _own_folder(spark)
    if folder not in _FOLDERS:
        _FOLDERS.add(folder)
        atexit.register(_last_clean_up, spark)
    place = f"{folder}/{uuid4().hex}"
    before = spark.conf.get(FREE_SHUFFLES, "false")
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        df.write.parquet(place)
    finally:
        spark.conf.set(FREE_SHUFFLES, before)
    written = spark.read.schema(df.schema).parquet(place)
    written.durable_place = place
    return written


_FOLDERS: set[str] = set()


def _last_clean_up(spark: SparkSession) -> None:
    """``clean_up`` at the end of the program, if its session is still there."""
    with contextlib.suppress(Exception):
        clean_up(spark)


def _delete(spark: SparkSession, place: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(place)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(*tables: DataFrame) -> None:
    """Deletes tables that ``durable`` gave. Nothing that still reads them may be run afterwards."""
    for table in tables:
        _delete(table.sparkSession, table.durable_place)


def clean_up(spark: SparkSession) -> None:
    """Deletes every durable table of this session: for the end of a program, when all its results are written."""
    _delete(spark, _own_folder(spark))
