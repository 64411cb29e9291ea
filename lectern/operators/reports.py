"""Counts and shares that describe an archive and judge a search."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def value_counts(df: DataFrame, fields: dict[str, str]) -> DataFrame:
    """``field``, ``value`` and ``n`` for several fields in one pass; ``fields`` gives what stands for a missing value."""
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.coalesce(F.nullif(F.col(f).cast("string"), F.lit("")), F.lit(d)).alias("value")) for f, d in fields.items()]))
    return df.select(each.alias("f")).select("f.*").groupBy("field", "value").agg(F.count("*").alias("n"))


def duplicate_summary(manifest: DataFrame) -> DataFrame:
    """One row: files, different contents, contents in several files, bytes and GiB."""
    by_content = manifest.groupBy("content_hash").agg(F.count("*").alias("n"), F.sum("size_bytes").alias("bytes"))
    total = F.coalesce(F.sum("bytes"), F.lit(0))
    return by_content.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("file_count"),
        F.count("*").alias("unique_content_count"),
        F.count_if(F.col("n") > 1).alias("duplicate_group_count"),
        total.alias("total_bytes"),
        F.bround(total / F.lit(1024**3), 3).alias("total_gib"),
    )


def largest_groups(df: DataFrame, by: str, most: int = 20) -> DataFrame:
    """The ``most`` values with the most rows; ties in order of the value."""
    return df.groupBy(by).agg(F.count("*").alias("n")).orderBy(F.desc("n"), by).limit(most)


def coverage(sources: DataFrame, searchable: DataFrame, families: dict[str, str]) -> DataFrame:
    """For each value of each family (``course:...`` and so on): sources and those whose document has a chunk. A row counts
    once in each family."""
    flagged = sources.join(searchable.select("document_id").distinct().withColumn("_found", F.lit(True)), "document_id", "left")
    groups = F.explode(F.array(*[F.concat(F.lit(f"{name}:"), F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("none"))) for name, c in families.items()]))
    out = flagged.select(groups.alias("group"), F.coalesce("_found", F.lit(False)).alias("found")).groupBy("group")
    return out.agg(F.count("*").alias("sources"), F.count_if("found").alias("searchable"), F.round(F.avg(F.col("found").cast("int")), 6).alias("coverage"))


def retrieval_quality(hits: DataFrame, expected: DataFrame, case: str, item: str, k: int = 5) -> DataFrame:
    """For each case (``expected``: case, item) the rank of its first expected item among ``hits`` (case, item, ``rank``),
    whether it is within ``k``, and the reciprocal rank (0 if missed)."""
    near = hits.filter(F.col("rank") <= k).join(expected, [case, item], "left_semi").groupBy(case).agg(F.min("rank").alias("first_rank"))
    return expected.select(case).distinct().join(near, case, "left").select(
        case, "first_rank", F.col("first_rank").isNotNull().alias("hit"), F.coalesce(1 / F.col("first_rank"), F.lit(0.0)).alias("reciprocal_rank")
    )


def retrieval_summary(quality: DataFrame) -> DataFrame:
    """One row over ``retrieval_quality``: questions, how many are found, the hit rate, the mean reciprocal rank, and the
    median of the ranks found. No questions give zeros and nulls."""
    return quality.agg(
        F.count("*").alias("questions"), F.count("first_rank").alias("found"), F.round(F.avg(F.col("hit").cast("int")), 6).alias("hit_rate"),
        F.round(F.avg("reciprocal_rank"), 6).alias("mean_reciprocal_rank"), F.percentile("first_rank", 0.5).alias("median_rank"),
    )


def expected_hit(text: Column, contains: Column, locator: Column | None = None, expected_locator: Column | None = None) -> Column:
    """Whether a hit is what a case expects: its text holds the expected words and, where one is expected, its locator is
    that one. A case that expects no words takes any text; a null text holds none."""
    held = contains.isNull() | F.coalesce(F.contains(text, contains), F.lit(False))
    return held if locator is None else held & (expected_locator.isNull() | F.coalesce(locator == expected_locator, F.lit(False)))


def answer_figures(answers: DataFrame) -> DataFrame:
    """One row over answered cases (``expected`` and ``answered``: whether an answer was due and given, ``correct``, ``quotes`` and
    ``exact_quotes``): share of right answers, of right abstentions, and of quotations that are exact. Null where no
    case counts."""
    due, given = F.col("expected"), F.col("answered")
    return answers.agg(
        F.count("*").alias("cases"), F.round(F.avg(F.when(due, (given & F.col("correct")).cast("int"))), 6).alias("answer_accuracy"),
        F.round(F.avg(F.when(~due, (~given).cast("int"))), 6).alias("abstention_accuracy"), F.round(F.try_divide(F.sum("exact_quotes"), F.sum("quotes")), 6).alias("exact_quotation_rate"),
    )


def extraction_status(records: DataFrame, done: DataFrame) -> DataFrame:
    """How many files were extracted now (``complete``), reused from before (``cached``), or failed (``error``). ``records`` has
    ``content_hash`` and ``record_type`` of what an extraction gave, ``done`` the hashes that were there before. A file
    counts once: it failed if all its records are errors."""
    by_file = records.groupBy("content_hash").agg(F.min(F.col("record_type") == "error").alias("failed"))
    known = done.select("content_hash").distinct().withColumn("_before", F.lit(True))
    status = F.when(F.col("failed"), "error").when(F.col("_before"), "cached").otherwise("complete")
    return by_file.join(known, "content_hash", "left").groupBy(status.alias("status")).agg(F.count("*").alias("files"))


def doubtful_extractions(records: DataFrame, least_confidence: float = 70.0) -> DataFrame:
    """The records to look at again, with the ``reason``: an error, no text, issues of an archive, or recognition below
    ``least_confidence``. A null confidence is none."""
    reason = (
        F.when(F.col("record_type") == "error", "error").when(F.coalesce(F.trim("text"), F.lit("")) == "", "empty")
        .when(F.coalesce("issues", F.lit(0)) > 0, "issues").when(F.col("ocr_confidence") < least_confidence, "recognition")
    )
    return records.withColumn("reason", reason).filter("reason is not null")


def regressions(before: DataFrame, now: DataFrame, case: str, good: str) -> DataFrame:
    """Cases that were good before and aren't now, or are missing."""
    return before.filter(good).select(case).join(now.filter(good).select(case), case, "left_anti")


def source_states(manifest: DataFrame, live: DataFrame, path: str, digest: str) -> DataFrame:
    """For each path of the manifest: ``current``, ``changed`` or ``missing`` against the live hashes."""
    now = live.select(F.col(path), F.col(digest).alias("_live"), F.lit(True).alias("_there"))
    state = F.when(F.col("_there").isNull(), "missing").when(F.col(digest).eqNullSafe(F.col("_live")), "current").otherwise("changed")
    return manifest.select(path, digest).join(now, path, "left").select(path, state.alias("state"))


def export_records(sources: DataFrame, filters: Sequence[str]) -> DataFrame:
    """One row a document: its first path, and for each filter the sorted set of its values."""
    sets: list[Column] = [F.array_sort(F.collect_set(F.nullif(F.col(f), F.lit("")))).alias(f"all_{f}") for f in filters]
    return sources.groupBy("document_id").agg(F.min("path").alias("path"), *sets)


def quality(cells: DataFrame, document: str, confidence: str, least: float = 70) -> DataFrame:
    """For each document the mean confidence of its recognised pages, and how many are below ``least``."""
    return cells.groupBy(document).agg(F.bround(F.avg(confidence), 1).alias("mean_confidence"), F.count_if(F.col(confidence) < least).alias("to_review"), F.count("*").alias("pages"))
