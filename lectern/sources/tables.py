"""Readers of the archive's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVIDENCE = (
    "chunk_id string, document_id string, source_path string, source_paths array<string>, course string, term string, "
    "content_role string, record_type string, locator_type string, locator_value string, page_number int, "
    "part_number int, part_count int, token_estimate int, text string, extraction_method string, ocr_confidence double"
)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def with_evidence(chunks: DataFrame, *fields: str) -> DataFrame:
    """``chunks`` with the named fields of its ``evidence`` as a struct column ``e``; rows without a text are left out.

    Evidence that is not valid JSON parses to null, so its ``text`` is null too. Only the named fields are in the
    schema, so the parser skips over the others. ``text`` is always among them.
    """
    wanted = {"text", *fields}
    schema = ", ".join(f for f in _split(EVIDENCE) if f.split()[0] in wanted)
    parsed = chunks.withColumn("e", F.from_json("evidence", schema, {"mode": "PERMISSIVE"}))
    return parsed.filter(F.col("e.text").isNotNull())


def _split(ddl: str) -> list[str]:
    return [f.strip() for f in ddl.split(", ")]
