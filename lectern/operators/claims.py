"""Claims with quotations against evidence, follow-up questions, and what both need of windows and nested arrays."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import FOLLOW_UP, instruction_like, quote_form

#: Lengths of claims and quotations, and supports of a claim.
CLAIM, QUOTE, SUPPORTS = (1, 1400), (12, 1000), (1, 3)


def checked_claims(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """``id`` and ``accepted`` of each claim (``id``, ``text``, ``kind``, ``supports``: array of source and quote).

    A claim is accepted if its text has 1 to 1,400 characters, its kind is ``answer`` or ``conflict``, it has 1 to 3
    supports, and each support quotes 12 to 1,000 characters that stand in its source's text (``evidence``: ``source``,
    ``document_id``, ``text``), compared in composed form with single blanks, and that don't look like an instruction. A
    conflict needs two different documents. Null or missing parts, and sources that aren't there, reject the claim.
    """
    each = claims.select("id", F.posexplode("supports").alias("n", "s")).select("id", "n", F.col("s.source").alias("source"), F.col("s.quote").alias("quote"))
    joined = each.join(evidence.select("source", "document_id", F.col("text").alias("_text")).dropDuplicates(["source"]), "source", "left")
    held = F.length("quote").between(*QUOTE) & ~instruction_like(F.col("quote")) & F.contains(quote_form(F.col("_text")), quote_form(F.col("quote")))
    by_claim = joined.withColumn("held", F.coalesce(held, F.lit(False))).groupBy("id").agg(F.bool_and("held").alias("held"), F.count("*").alias("supports_n"), F.count_distinct("document_id").alias("documents"))
    size = F.length(F.trim("text"))
    good = size.between(*CLAIM) & F.col("kind").isin("answer", "conflict") & F.col("supports_n").between(*SUPPORTS) & F.col("held") & ((F.col("kind") != "conflict") | (F.col("documents") > 1))
    return claims.select("id", "text", "kind").join(by_claim, "id", "left").select("id", F.coalesce(good, F.lit(False)).alias("accepted"))


def supported_claims(claims: DataFrame, checks: DataFrame) -> DataFrame:
    """Claims whose check (``id``, ``support``, ``answers_question``) says that they are supported and answer the question.
    A claim with several checks has none that counts."""
    once = checks.groupBy("id").agg(F.count("*").alias("n"), F.first("support").alias("support"), F.first("answers_question").alias("answers"))
    return claims.join(once.filter("n = 1 and support = 'supported' and answers"), "id", "left_semi")


def rewritten_questions(turns: DataFrame, conversation: str, turn: str, query: str, most_history: int = 6, most_chars: int = 2000) -> DataFrame:
    """Each question with the earlier ones that it depends on.

    A question with a word that points back is led by the latest earlier question without one (or the first) and the one
    just before, of the last six; its last 2,000 characters are kept. Others stay as they are, without blanks around.
    """
    order = Window.partitionBy(conversation).orderBy(turn)
    before = order.rowsBetween(-most_history, -1)
    points_back = F.col(query).rlike(FOLLOW_UP)
    anchor = F.coalesce(F.last(F.when(~points_back, F.col(query)), ignorenulls=True).over(before), F.first(query).over(before))
    context = F.array_join(F.array_distinct(F.array(anchor, F.last(query).over(before))), " / ")
    led = F.concat(F.lit("Earlier questions: "), context, F.lit("\nCurrent question: "), F.col(query))
    rewritten = F.when(points_back & (F.count("*").over(before) > 0), F.substring(led, F.greatest(F.lit(1), F.length(led) - most_chars + 1), F.lit(most_chars))).otherwise(F.trim(query))
    return turns.withColumn("retrieval_question", rewritten)


def merged_claims(claims: DataFrame) -> DataFrame:
    """Claims that say the same in words, with all their sources."""
    words = F.array_join(F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{N}]+)"), 1), " ")
    return claims.groupBy(words.alias("said")).agg(F.min("text").alias("text"), F.array_sort(F.collect_set("source")).alias("sources"))
