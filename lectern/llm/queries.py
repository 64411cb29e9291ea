"""Queries of the problems 1 to 3 and 5 to 8, and their SQL where SQL can express them over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import mixing, neardup, neighbours, packing, scans, spans, splitting, tokens
from lectern.llm.texts import chunk_texts
from lectern.operators.components import components
from lectern.session import durable
from lectern.sources.tables import table


def p1_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """Every chunk of more than 3,500 characters as pieces, with its locator value."""
    texts = chunk_texts(spark, folder, "locator_value", columns=("locator_value",))
    locator = F.coalesce(F.when(F.trim("locator_value") != "", F.col("locator_value")), F.col("e_locator_value"))
    large = texts.select("rowid", locator.alias("locator_value"), "text").filter(F.length("text") > 3500)
    # Repeats are dropped after the filter: only the few large texts are shuffled.
    return splitting.split_oversized(large.dropDuplicates(["rowid"]))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return p1_pieces(spark, folder).filter("piece_no = 1").select("rowid")


def _pages(spark: SparkSession, folder: str) -> DataFrame:
    texts = chunk_texts(spark, folder, "page_number", "locator_value", "extraction_method", columns=("document_id",))
    scanned = F.coalesce(F.col("extraction_method").contains("ocr"), F.lit(False))
    number = F.coalesce("page_number", F.col("locator_value").try_cast("int"))
    return scans.repaired_pages(texts.filter(scanned).withColumn("page_number", number), texts.filter(~scanned))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return _pages(spark, folder).select(F.col("id").alias("rowid"), F.explode("defects").alias("d")).select("rowid", "d.line_no", "d.defect")


def p2_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Every scanned page as continuous paragraphs."""
    return _pages(spark, folder).select(F.col("id").alias("rowid"), F.col("repaired").alias("text"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    near, keys = neighbours.nearest(table(spark, folder, "vectors"))
    # Pairs are told apart by their ids; the keys, which are long, come last.
    pairs = near.select(F.least("id", "near").alias("a"), F.greatest("id", "near").alias("b")).distinct()
    named = pairs.join(keys.select(F.col("id").alias("a"), F.col("key").alias("x")), "a").join(keys.select(F.col("id").alias("b"), F.col("key").alias("y")), "b")
    return named.select(F.least("x", "y").alias("key_a"), F.greatest("x", "y").alias("key_b"))


def p3_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """The ten neighbours of each key, ranked."""
    near, keys = neighbours.nearest(table(spark, folder, "vectors"))
    named = near.join(keys, "id").join(keys.select(F.col("id").alias("near"), F.col("key").alias("neighbour")), "near")
    return named.select("key", "rank", "neighbour", F.round("sim", 4).alias("similarity"))


def p3_search(spark: SparkSession, folder: str) -> DataFrame:
    """Greedy search on the graph for every vector whose position is divisible by 20."""
    vectors = table(spark, folder, "vectors")
    found, keys = neighbours.search(vectors, vectors.filter("pos % 20 = 0").select(F.col("pos").alias("id")))
    named = found.join(keys.select(F.col("id").alias("q"), F.col("key").alias("query")), "q").join(keys.select(F.col("id").alias("node"), "key"), "node")
    return named.select("query", "rank", "key", F.round("sim", 3).alias("similarity"))


def _alike(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    texts = chunk_texts(spark, folder)
    return neardup.near_duplicates(texts, "rowid", words=3, similarity=0.7, least_words=20)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.expanded(*_alike(spark, folder)).select(F.col("a").alias("rowid_a"), F.col("b").alias("rowid_b"))


def p5_groups(spark: SparkSession, folder: str) -> DataFrame:
    """For each chunk that counts: the smallest chunk of its group, the group's size, the copies with the same words, and
    how many chunks it is alike with."""
    links, members = _alike(spark, folder)
    links, members = durable(links), durable(members)
    copies = members.groupBy("rep").agg(F.count("*").alias("copies"))
    ends = links.select(F.col("a").alias("rep"), F.col("b").alias("other")).union(links.select("b", "a"))
    linked = ends.join(copies.select(F.col("rep").alias("other"), "copies"), "other").groupBy("rep").agg(F.sum("copies").alias("across"))
    group = components(links).select(F.col("node").alias("rep"), "component")
    classes = copies.join(linked, "rep", "left").join(group, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    sizes = classes.groupBy("component").agg(F.sum("copies").alias("group_size"))
    named = members.join(classes.join(sizes, "component"), "rep")
    return named.select(F.col("key").alias("rowid"), F.col("component").alias("group_rowid"), "group_size", "copies", (F.coalesce("across", F.lit(0)) + F.col("copies") - 1).alias("links"))


def _budgets(spark: SparkSession, folder: str) -> list[tuple[int, int, int]]:
    rows = table(spark, folder, "pack_budgets").select("budget_id", "capacity_tokens", "separator_tokens").distinct().collect()
    return sorted((r[0], r[1], r[2] or 0) for r in rows)


def p6_containers(spark: SparkSession, folder: str) -> DataFrame:
    """Which text, or which part of an oversized one, lies in which container of each budget."""
    documents = table(spark, folder, "documents")
    sizes = tokens.sized(documents, "doc_id", tokens.default_vocabulary(spark))
    return packing.pack(sizes, _budgets(spark, folder), "doc_id", shards=packing.shards_for(documents.count()))


def p6_fill(spark: SparkSession, folder: str) -> DataFrame:
    """How well the containers of each budget are filled."""
    return packing.fill(p6_containers(spark, folder), _budgets(spark, folder))


def _mixed(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    documents = table(spark, folder, "documents").withColumn("source", mixing.normal_source(F.col("source")))
    ranks = mixing.ranked(tokens.sized(documents, "doc_id", tokens.default_vocabulary(spark), "source"), "doc_id")
    everything = ranks.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    planned = mixing.plan(ranks.filter("source is not null"), table(spark, folder, "mix_targets"), everything)
    return planned, mixing.mix(ranks, planned, "doc_id")


def p7_records(spark: SparkSession, folder: str) -> DataFrame:
    """The chosen records of each mix with their repeats."""
    return _mixed(spark, folder)[1]


def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Target and real share of each source in each mix."""
    return mixing.shares(*_mixed(spark, folder))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    matches, members = spans.shared_spans(table(spark, folder, "documents"))
    pairs = spans.local_matches(matches, members).select("doc_a", "doc_b").distinct()
    return pairs.select(F.col("doc_a").alias("doc_id_a"), F.col("doc_b").alias("doc_id_b"))


def p8_spans(spark: SparkSession, folder: str) -> DataFrame:
    """The shared passages of each pair of documents, at full length."""
    return spans.spans(*spans.shared_spans(table(spark, folder, "documents")))


def p8_shared_parts(spark: SparkSession, folder: str) -> DataFrame:
    """For each document with a shared passage, the part of its text that stands in others too."""
    documents = table(spark, folder, "documents")
    return spans.shared_parts(*spans.shared_spans(documents), documents)


QUERIES = {
    "p1_found": p1_found,
    "p1_pieces": p1_pieces,
    "p2_found": p2_found,
    "p2_pages": p2_pages,
    "p3_found": p3_found,
    "p3_neighbours": p3_neighbours,
    "p3_search": p3_search,
    "p5_found": p5_found,
    "p5_groups": p5_groups,
    "p6_containers": p6_containers,
    "p6_fill": p6_fill,
    "p7_records": p7_records,
    "p7_shares": p7_shares,
    "p8_found": p8_found,
    "p8_spans": p8_spans,
    "p8_shared_parts": p8_shared_parts,
}

_TEXTS = """
WITH texts AS (
  SELECT DISTINCT rowid, json_extract_string(evidence, '$.text') AS text FROM chunks
  WHERE json_valid(evidence) AND json_extract_string(evidence, '$.text') IS NOT NULL
)
"""
_SPANS = """
WITH w AS (SELECT DISTINCT doc_id, hash(substr(text, i, 200)) AS h
  FROM (SELECT doc_id, text, unnest(generate_series(1, length(text) - 199)) AS i FROM documents WHERE length(text) >= 200))
SELECT DISTINCT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM w a JOIN w b ON a.h = b.h AND a.doc_id < b.doc_id
"""
_ALIKE = (
    _TEXTS.replace("SELECT DISTINCT rowid,", 'SELECT DISTINCT chunks."rowid" AS rid,')
    + """
, words AS (SELECT rid, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM texts),
shingles AS (SELECT DISTINCT rid, unnest(list_transform(generate_series(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS s FROM words WHERE len(w) >= 20),
sizes AS (SELECT rid, count(*) AS n FROM shingles GROUP BY rid),
joint AS (SELECT a.rid AS x, b.rid AS y, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.rid < b.rid GROUP BY a.rid, b.rid)
SELECT x AS rowid_a, y AS rowid_b FROM joint JOIN sizes p ON p.rid = x JOIN sizes q ON q.rid = y WHERE c * 10 >= 7 * (p.n + q.n - c)
"""
)
_GROUPS = (
    _ALIKE.replace("WITH texts", "WITH RECURSIVE texts").replace("SELECT x AS rowid_a, y AS rowid_b FROM joint", ", alike AS (SELECT x, y, c = p.n AND c = q.n AS same FROM joint")
    + """), edges AS (SELECT x, y, same FROM alike UNION ALL SELECT y, x, same FROM alike),
reach(x, y) AS (SELECT rid, rid FROM sizes UNION SELECT r.x, e.y FROM reach r JOIN edges e ON e.x = r.y),
groups AS (SELECT x, min(y) AS group_rowid, count(*) AS group_size FROM reach GROUP BY x),
degrees AS (SELECT x, count(*) AS links, count(*) FILTER (same) AS same FROM edges GROUP BY x)
SELECT g.x AS rowid, group_rowid, group_size, 1 + coalesce(same, 0) AS copies, coalesce(links, 0) AS links FROM groups g LEFT JOIN degrees d ON d.x = g.x
"""
)
_WINDOWS = """
WITH d AS (SELECT doc_id, any_value(text) AS text FROM documents WHERE text IS NOT NULL GROUP BY doc_id),
w AS (SELECT doc_id, i - 1 AS i, hash(substr(text, i, 200)) AS h FROM (SELECT doc_id, text, unnest(generate_series(1, length(text) - 199)) AS i FROM d WHERE length(text) >= 200)),
"""
_PASSAGES = (
    _WINDOWS
    + """p AS (SELECT DISTINCT a.doc_id AS doc_a, b.doc_id AS doc_b, a.i AS i, b.i - a.i AS shift FROM w a JOIN w b ON a.h = b.h AND a.doc_id < b.doc_id),
r AS (SELECT *, i - row_number() OVER (PARTITION BY doc_a, doc_b, shift ORDER BY i) AS run FROM p)
SELECT doc_a, doc_b, min(i) AS start_a, min(i) + shift AS start_b, max(i) - min(i) + 200 AS length FROM r GROUP BY doc_a, doc_b, shift, run
"""
)
_PARTS = (
    _WINDOWS
    + """s AS (SELECT h FROM w GROUP BY h HAVING min(doc_id) < max(doc_id)),
c AS (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS following FROM (SELECT DISTINCT doc_id, i FROM w SEMI JOIN s ON s.h = w.h)),
n AS (SELECT doc_id, sum(least(200, coalesce(following - i, 200)))::BIGINT AS shared_chars FROM c GROUP BY doc_id)
SELECT doc_id, length(text) AS chars, shared_chars, round(shared_chars / length(text), 6) AS shared_part FROM n JOIN d USING (doc_id)
"""
)
ORACLES = {
    "p5_groups": _GROUPS,
    "p8_spans": _PASSAGES,
    "p8_shared_parts": _PARTS,
    "p1_found": _TEXTS.replace("SELECT DISTINCT rowid,", 'SELECT DISTINCT chunks."rowid" AS rowid,') + "SELECT DISTINCT rowid FROM texts WHERE length(text) > 3500",
    "p5_found": _ALIKE,
    "p8_found": _SPANS,
}
