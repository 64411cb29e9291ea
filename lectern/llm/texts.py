"""Inputs of the operators: each usable text of the archive's tables once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.sources.tables import table, with_evidence


def chunk_texts(spark: SparkSession, folder: str, *fields: str, columns: tuple[str, ...] = ()) -> DataFrame:
    """``rowid``, ``text`` and the named evidence fields (and table columns) of every chunk with a text.

    Rows delivered again are still there: a caller drops them where its rows are small (repeats have equal content).
    """
    chunks = with_evidence(table(spark, folder, "chunks"), *fields)
    return chunks.select("rowid", *columns, "e.text", *[F.col(f"e.{f}").alias(f"e_{f}" if f in columns else f) for f in fields])
