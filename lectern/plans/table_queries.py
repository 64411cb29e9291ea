"""Queries over plain tables: the structured engine, ordered rows, vectors, and the event stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import text
from lectern.functions.numbers import iso_date, number
from lectern.operators import reports, search, stored_index, structured, windows
from lectern.plans.text_queries import _CHUNKS, _STOP, _bm25_sql, _form_sql, chunk_index, documents
from lectern.sources.tables import table
from lectern.streaming.ingest import windows_of_files

TERMS = ["covariance", "residual", "strategy"]


def structured_aggregates(spark: SparkSession, folder: str) -> DataFrame:
    """Count, sum, mean, bounds and deviation of a column for the rows whose other column is in a range."""
    keep = structured.in_bounds(F.col("l_quantity"), "number", 10, 40)
    out = structured.aggregate(table(spark, folder, "lineitem"), "l_extendedprice", keep)
    return out.select("rows_scanned", "rows_matched", "rows_filtered_out", "numeric_values", "min", "max", *[F.round(c, 4).alias(c) for c in ("sum", "mean", "stddev")])


def structured_dates(spark: SparkSession, folder: str) -> DataFrame:
    """The same with a range of dates, for each group."""
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    rows = table(spark, folder, "orders").filter(structured.in_bounds(day, "date", "1995-01-01T00:00:00", "1996-06-30T00:00:00"))
    return rows.groupBy("o_orderpriority").agg(F.count("*").alias("matched"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.round(F.avg("o_totalprice"), 4).alias("mean"))


def exact_totals(spark: SparkSession, folder: str) -> DataFrame:
    """Sums of each flag's prices, rounded once."""
    return structured.exact_total(table(spark, folder, "lineitem"), "l_extendedprice", ["l_returnflag"]).select("l_returnflag", F.round("total", 2).alias("total"))


def column_profile(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "orders").withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd"))
    heads = {"o_orderkey": "Key", "o_totalprice": "Price (USD)", "o_orderdate": "Date", "o_orderstatus": "Status [code]"}
    return structured.profile(rows, heads)


def preview_rows(spark: SparkSession, folder: str) -> DataFrame:
    keep = structured.in_bounds(F.col("l_discount"), "number", 0.05, None)
    return structured.preview(table(spark, folder, "lineitem"), ["l_orderkey", "l_linenumber"], keep).select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")


def cell_values(spark: SparkSession, folder: str) -> DataFrame:
    """What the locators of chunks are as numbers and dates."""
    cells = table(spark, folder, "chunks").select("locator_type", "rowid", "locator_value").distinct()
    value, day = number(F.col("locator_value")), iso_date(F.col("locator_value"))
    return cells.groupBy("locator_type").agg(F.count("*").alias("cells"), F.count(value).alias("numbers"), F.count(day).alias("dates"), F.max(value).alias("largest"))


def rolling_extremes(spark: SparkSession, folder: str) -> DataFrame:
    out = windows.rolling_extremes(table(spark, folder, "events"), ["user_id"], ["ts", "event_id"], "value", 5)
    return out.select("event_id", "rolling_high", "rolling_low")


def drawdowns(spark: SparkSession, folder: str) -> DataFrame:
    out = windows.drawdown(table(spark, folder, "events"), ["user_id"], ["ts", "event_id"], "value")
    return out.groupBy("user_id").agg(F.max("peak").alias("peak"), F.round(F.max("drawdown"), 6).alias("deepest"))


def value_changes(spark: SparkSession, folder: str) -> DataFrame:
    """Changes within each user's events: mean and deviation before and after the middle of the time span."""
    changed = windows.differences(table(spark, folder, "events"), ["user_id"], ["ts", "event_id"], "value").filter("change is not null")
    late = F.when(F.col("ts") >= F.lit("2024-01-15").cast("timestamp_ntz"), "late").otherwise("early")
    return changed.groupBy("event_type", late.alias("sample")).agg(F.count("*").alias("n"), F.round(F.avg("change"), 6).alias("mean"), F.round(F.stddev_samp("change"), 6).alias("stddev"))


def filled_histogram(spark: SparkSession, folder: str) -> DataFrame:
    """Values of each type of event on an hourly grid without gaps, and how they change over 3 hours, in 41 bins."""
    grid = windows.grid_filled(table(spark, folder, "events").select("event_type", "ts", "value"), ["event_type"], "ts", "value", "hour")
    changed = windows.differences(grid, ["event_type"], ["slot"], "value", 3)
    return windows.histogram(changed, F.col("change"), -205.0, 10.0, 41)


def latest_events(spark: SparkSession, folder: str) -> DataFrame:
    """The current row of each user and type in the event log; an error takes the entry away."""
    events = table(spark, folder, "events").select("user_id", "event_type", "event_id", "ts", "value")
    return windows.latest(events, ["user_id", "event_type"], ["ts", "event_id"], F.col("event_type") == "error").select("user_id", "event_type", "event_id", "value")


def activity_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Runs of events of one type within a user's events."""
    runs = windows.runs(table(spark, folder, "events"), ["user_id"], ["ts", "event_id"], "event_type")
    return runs.groupBy("event_type", "rows").agg(F.count("*").alias("runs"))


def carried_values(spark: SparkSession, folder: str) -> DataFrame:
    """For each event the value of the user's last purchase up to it."""
    events = table(spark, folder, "events").withColumn("bought", F.when(F.col("event_type") == "purchase", F.col("value")))
    return windows.carried_forward(events, ["user_id"], ["ts", "event_id"], "bought", "last_bought").select("event_id", "last_bought")


def cosine_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The ten most similar embeddings for every embedding whose id is divisible by 20, exactly."""
    rows = table(spark, folder, "embeddings")
    found = search.similar_rows(rows, rows.filter("vec_id % 20 = 0"), "vec_id", "embedding", 10, block=512)
    return found.select("query", "vec_id", "rank", F.round("cosine", 5).alias("cosine"))


def _semantic(spark: SparkSession, folder: str) -> DataFrame:
    """Each chunk's best window for the vector of the smallest position that is usable."""
    size = F.size("vector") == 384
    finite = F.forall("vector", lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = table(spark, folder, "vectors").filter(size & finite & F.exists("vector", lambda x: x != 0))
    asked = rows.orderBy("pos").select(F.col("vector").alias("asked")).limit(1)  # one row is broadcast
    scored = rows.join(F.broadcast(asked), F.lit(True)).select("pos", "rid", "win_start", "win_end", search.cosine(F.col("vector"), F.col("asked")).alias("cosine"))
    return search.best_windows(scored.withColumn("cosine", F.round("cosine", 5)), "rid", "cosine", "pos", "win_start", "win_end").filter("cosine >= 0.25")


def pooled_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """One vector for each chunk with usable windows: its first and last number."""
    finite = F.forall("vector", lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = table(spark, folder, "vectors").filter((F.size("vector") == 384) & finite & F.exists("vector", lambda x: x != 0))
    out = search.pooled(rows, "rid", "vector")
    return out.select("rid", F.round(F.get("vector", F.lit(0)), 5).alias("first_number"), F.round(F.get("vector", F.lit(383)), 5).alias("last_number"))


def best_windows(spark: SparkSession, folder: str) -> DataFrame:
    return _semantic(spark, folder).select("rid", "cosine", "win_start", "win_end")


def hybrid_search(spark: SparkSession, folder: str) -> DataFrame:
    """Words and a vector together: both ranked lists fused by reciprocal ranks, once for each place, few of a document."""
    index = chunk_index(spark, folder)
    places = index["places"].drop("path")
    lexical = search.ranked(stored_index.bm25(index, "rowid", {"q": TERMS}, {"text": 1.0}), [], "score", "rowid", 200)
    semantic = search.ranked(_semantic(spark, folder).withColumnRenamed("rid", "rowid"), [], "cosine", "rowid", 200)
    sizes = places.groupBy("document_id").agg(F.count("*").alias("size"))
    fused = search.fused(lexical, semantic, "rowid").join(places, "rowid").join(sizes, "document_id")
    top = search.diversified(fused, "rowid", "document_id", ["locator_type", "locator_value"], "size", 10)
    return top.select("rowid", "document_id", "lexical_rank", "semantic_rank", F.round("score", 8).alias("score"))


def event_stream_windows(spark: SparkSession, folder: str) -> DataFrame:
    out = windows_of_files(spark, folder)
    return out.select("window_start", "event_type", "n", F.round("total", 4).alias("total"))


def _title_hits(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """The five best documents for the words of each asked title, and the documents that have the title. Asked are the titles
    of all documents whose id is divisible by 20, against all documents."""
    rows = documents(spark, folder).select("doc_id", text.search_form(F.col("title")).alias("title"), text.search_form(F.col("text")).alias("text"))
    titled = rows.filter("title is not null").select(F.col("title").alias("query"), "doc_id")
    asked = titled.filter("doc_id % 20 = 0").select("query").distinct()
    terms = asked.select("query", text.query_terms(F.col("query")).alias("terms"))
    return search.bm25_ranked(rows, "doc_id", terms, {"title": 4.0, "text": 1.0}, 5), titled.join(asked, "query", "left_semi")


def self_retrieval(spark: SparkSession, folder: str) -> DataFrame:
    """For titles of documents: at which rank a search for the title's words finds a document with that very title."""
    hits, expected = _title_hits(spark, folder)
    return reports.retrieval_quality(hits, expected, "query", "doc_id").select("query", "first_rank", "hit", F.round("reciprocal_rank", 6).alias("reciprocal_rank"))


def retrieval_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Over all questions of ``self_retrieval``: how many are found, mean reciprocal rank and median rank."""
    return reports.retrieval_summary(self_retrieval(spark, folder))


def title_passages(spark: SparkSession, folder: str) -> DataFrame:
    """Of the documents that a title finds, those that hold an expected word: the longest of the title, as the text has it."""
    hits, _ = _title_hits(spark, folder)
    longest = F.element_at(F.array_sort(text.query_terms(F.col("query")), lambda a, b: F.when(F.length(a) != F.length(b), F.length(a) - F.length(b)).when(a < b, -1).when(a > b, 1).otherwise(0)), -1)
    texts = documents(spark, folder).select("doc_id", text.search_form(F.col("text")).alias("text"))
    held = hits.withColumn("wanted", longest).join(texts, "doc_id").withColumn("held", reports.expected_hit(F.col("text"), F.col("wanted")))
    return held.groupBy("query").agg(F.count("*").alias("hits"), F.count_if("held").alias("held"))


QUERIES = {
    f.__name__: f
    for f in (
        structured_aggregates, structured_dates, exact_totals, column_profile, preview_rows, cell_values, rolling_extremes, drawdowns, value_changes, filled_histogram, latest_events,
        activity_runs, carried_values, cosine_topk, pooled_vectors, best_windows, hybrid_search, event_stream_windows, self_retrieval, retrieval_summary, title_passages,
    )
}

_NUMBER = r"^\s*[+-]?(\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)([eE][+-]?\d+(_\d+)*)?\s*$"
_BY_USER = "PARTITION BY user_id ORDER BY ts, event_id"
_SEMANTIC = """
, usable AS (SELECT * FROM vectors WHERE len(vector) = 384 AND len(list_filter(vector, lambda x: NOT isfinite(x))) = 0 AND len(list_filter(vector, lambda x: x <> 0)) > 0),
wanted AS (SELECT vector::DOUBLE[] AS q FROM usable ORDER BY pos LIMIT 1),
scored AS (SELECT pos, rid, win_start, win_end, round(list_inner_product(vector::DOUBLE[], q) / sqrt(list_inner_product(vector::DOUBLE[], vector::DOUBLE[]) * list_inner_product(q, q)), 5) AS cosine FROM usable, wanted),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY rid ORDER BY cosine DESC, pos) = 1)
"""

_TITLES = (
    f"""WITH rows AS (SELECT doc_id, {_form_sql("title")} AS title, {_form_sql("text")} AS text FROM documents)"""
    + _bm25_sql(
        "rows", "doc_id", f"""SELECT DISTINCT title, term FROM (SELECT title, unnest(regexp_extract_all(title, '[\\p{{L}}\\p{{N}}]+')) AS term FROM rows WHERE title IS NOT NULL AND doc_id % 20 = 0)
  WHERE term NOT IN ({_STOP})""", {"title": 4.0, "text": 1.0}
    )
    + """, hits AS (SELECT query, k, row_number() OVER (PARTITION BY query ORDER BY score DESC, k) AS rank FROM scores QUALIFY rank <= 5),
quality AS (SELECT a.title AS query, min(h.rank) AS first_rank FROM (SELECT DISTINCT title FROM rows WHERE title IS NOT NULL AND doc_id % 20 = 0) a
  LEFT JOIN (SELECT query, rank FROM hits JOIN rows ON doc_id = k AND rows.title = query) h ON h.query = a.title GROUP BY 1)
"""
)

ORACLES = {
    "structured_aggregates": """
SELECT count(*) AS rows_scanned, count(*) FILTER (l_quantity BETWEEN 10 AND 40) AS rows_matched, count(*) FILTER (NOT l_quantity BETWEEN 10 AND 40) AS rows_filtered_out,
  count(l_extendedprice) FILTER (l_quantity BETWEEN 10 AND 40) AS numeric_values, min(l_extendedprice) FILTER (l_quantity BETWEEN 10 AND 40) AS "min",
  max(l_extendedprice) FILTER (l_quantity BETWEEN 10 AND 40) AS "max", round(sum(l_extendedprice) FILTER (l_quantity BETWEEN 10 AND 40), 4) AS "sum",
  round(avg(l_extendedprice) FILTER (l_quantity BETWEEN 10 AND 40), 4) AS mean, round(stddev_samp(l_extendedprice) FILTER (l_quantity BETWEEN 10 AND 40), 4) AS stddev
FROM lineitem""",
    "structured_dates": """
SELECT o_orderpriority, count(*) AS matched, round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 4) AS mean FROM orders
WHERE o_orderdate::DATE BETWEEN '1995-01-01' AND '1996-06-30' GROUP BY o_orderpriority""",
    "exact_totals": "SELECT l_returnflag, round(sum(l_extendedprice::DECIMAL(28, 6))::DOUBLE, 2) AS total FROM lineitem GROUP BY l_returnflag",
    "column_profile": """
SELECT 'o_orderkey' AS "column", 'Key' AS label, count(o_orderkey) AS "numeric", count(o_orderkey) AS nonempty, NULL AS date_min, NULL AS date_max, 'unknown' AS unit FROM orders
UNION ALL SELECT 'o_totalprice', 'Price (USD)', count(o_totalprice), count(o_totalprice), NULL, NULL, 'USD' FROM orders
UNION ALL SELECT 'o_orderdate', 'Date', 0, count(o_orderdate), strftime(min(o_orderdate), '%Y-%m-%dT00:00:00'), strftime(max(o_orderdate), '%Y-%m-%dT00:00:00'), 'unknown' FROM orders
UNION ALL SELECT 'o_orderstatus', 'Status [code]', 0, count(o_orderstatus), NULL, NULL, 'code' FROM orders""",
    "preview_rows": "SELECT l_orderkey, l_linenumber, l_quantity, l_discount FROM lineitem WHERE l_discount >= 0.05 ORDER BY l_orderkey, l_linenumber LIMIT 30",
    "cell_values": f"""
WITH c AS (SELECT DISTINCT locator_type, chunks."rowid" AS rid, locator_value FROM chunks),
v AS (SELECT locator_type, CASE WHEN regexp_matches(locator_value, '{_NUMBER}') THEN TRY_CAST(trim(replace(locator_value, '_', '')) AS DOUBLE) END AS n,
  CASE WHEN regexp_matches(locator_value, '^\\d{{4}}-\\d{{2}}-\\d{{2}}($|[ T])') THEN TRY_CAST(locator_value AS TIMESTAMP) END AS d FROM c)
SELECT locator_type, count(*) AS cells, count(n) AS numbers, count(d) AS dates, max(n) AS largest FROM v GROUP BY locator_type""",
    "rolling_extremes": f"""
SELECT event_id, max(value) OVER w AS rolling_high, min(value) OVER w AS rolling_low FROM events WINDOW w AS ({_BY_USER} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)""",
    "drawdowns": f"""
WITH p AS (SELECT user_id, value, max(value) OVER ({_BY_USER}) AS peak FROM events)
SELECT user_id, max(peak) AS peak, round(max(peak - value), 6) AS deepest FROM p GROUP BY user_id""",
    "value_changes": f"""
WITH c AS (SELECT event_type, ts, value - lag(value) OVER ({_BY_USER}) AS change FROM events)
SELECT event_type, CASE WHEN ts >= TIMESTAMP '2024-01-15' THEN 'late' ELSE 'early' END AS "sample", count(*) AS n, round(avg(change), 6) AS mean, round(stddev_samp(change), 6) AS stddev
FROM c WHERE change IS NOT NULL GROUP BY ALL""",
    "filled_histogram": """
WITH h AS (SELECT event_type, date_trunc('hour', ts) AS slot, arg_max(value, ts) AS value FROM events GROUP BY ALL),
g AS (SELECT event_type, unnest(generate_series(min(slot), max(slot), INTERVAL 1 HOUR)) AS slot FROM h GROUP BY event_type),
f AS (SELECT g.event_type, g.slot, last_value(value IGNORE NULLS) OVER (PARTITION BY g.event_type ORDER BY g.slot) AS value FROM g LEFT JOIN h ON h.event_type = g.event_type AND h.slot = g.slot),
c AS (SELECT value - lag(value, 3) OVER (PARTITION BY event_type ORDER BY slot) AS change FROM f)
SELECT greatest(0, least(40, floor((change + 205) / 10)))::INT AS bin, count(*) AS n FROM c WHERE change IS NOT NULL GROUP BY 1""",
    "latest_events": """
SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1 AND event_type <> 'error'""",
    "activity_runs": f"""
WITH m AS (SELECT *, CASE WHEN lag(event_type) OVER ({_BY_USER}) IS NOT DISTINCT FROM event_type THEN 0 ELSE 1 END AS fresh FROM events),
r AS (SELECT user_id, event_type, sum(fresh) OVER ({_BY_USER}) AS run FROM m), c AS (SELECT event_type, count(*) AS n FROM r GROUP BY user_id, run, event_type)
SELECT event_type, n AS "rows", count(*) AS runs FROM c GROUP BY ALL""",
    "carried_values": f"""
SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER ({_BY_USER}) AS last_bought FROM events""",
    "cosine_topk": """
WITH c AS (SELECT q.vec_id AS query, r.vec_id, list_cosine_similarity(q.embedding::DOUBLE[], r.embedding::DOUBLE[]) AS cosine FROM embeddings q, embeddings r WHERE q.vec_id % 20 = 0)
SELECT query, vec_id, row_number() OVER (PARTITION BY query ORDER BY cosine DESC, vec_id) AS rank, round(cosine, 5) AS cosine FROM c QUALIFY rank <= 10""",
    "pooled_vectors": "WITH one AS (SELECT 1)"
    + _SEMANTIC
    + """, unit AS (SELECT rid, list_transform(vector::DOUBLE[], lambda x: x / sqrt(list_inner_product(vector::DOUBLE[], vector::DOUBLE[]))) AS v FROM usable),
each AS (SELECT rid, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM unit), m AS (SELECT rid, i, avg(x) AS x FROM each GROUP BY rid, i),
l AS (SELECT rid, sqrt(sum(x * x)) AS l FROM m GROUP BY rid)
SELECT rid, round(max(x) FILTER (i = 1) / any_value(l), 5) AS first_number, round(max(x) FILTER (i = 384) / any_value(l), 5) AS last_number FROM m JOIN l USING (rid) GROUP BY rid""",
    "best_windows": "WITH one AS (SELECT 1)" + _SEMANTIC + "SELECT rid, cosine, win_start, win_end FROM best WHERE cosine >= 0.25",
    "hybrid_search": _CHUNKS
    + ", rows AS (SELECT rid, document_id, locator_type, locator_value, " + _form_sql("e_text") + " AS text FROM t)"
    + _bm25_sql("rows", "rid", {"q": TERMS}, {"text": 1.0})
    + _SEMANTIC
    + """, lex AS (SELECT k AS rid, row_number() OVER (ORDER BY score DESC, k) AS r FROM scores QUALIFY r <= 200),
sem AS (SELECT rid, row_number() OVER (ORDER BY cosine DESC, rid) AS r FROM best WHERE cosine >= 0.25 QUALIFY r <= 200),
f AS (SELECT coalesce(lex.rid, sem.rid) AS rid, lex.r AS lexical_rank, sem.r AS semantic_rank, coalesce(1 / (60 + lex.r), 0) + coalesce(1 / (60 + sem.r), 0) AS score FROM lex FULL JOIN sem ON lex.rid = sem.rid),
j AS (SELECT f.*, document_id, locator_type, locator_value FROM f JOIN rows USING (rid)),
once AS (SELECT * FROM j QUALIFY row_number() OVER (PARTITION BY document_id, locator_type, locator_value ORDER BY score DESC, rid) = 1),
turns AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY score DESC, rid) > CASE WHEN (SELECT count(*) FROM rows x WHERE x.document_id = once.document_id) > 200 THEN 1 ELSE 4 END AS later FROM once)
SELECT rid AS rowid, document_id, lexical_rank, semantic_rank, round(score, 8) AS score FROM (SELECT * FROM turns ORDER BY later, score DESC, rid LIMIT 10)""",
    "self_retrieval": _TITLES + "SELECT query, first_rank, first_rank IS NOT NULL AS hit, round(coalesce(1 / first_rank, 0), 6) AS reciprocal_rank FROM quality",
    "retrieval_summary": _TITLES
    + """SELECT count(*) AS questions, count(first_rank) AS found, round(count(first_rank) / count(*), 6) AS hit_rate, round(avg(coalesce(1 / first_rank, 0)), 6) AS mean_reciprocal_rank,
  median(first_rank) AS median_rank FROM quality""",
    "title_passages": _TITLES
    + """, wanted AS (SELECT query, arg_max(term, struct_pack(n := length(term), t := term)) AS w FROM asked GROUP BY query)
SELECT query, count(*) AS hits, count(*) FILTER (contains(text, w)) AS held FROM hits JOIN wanted USING (query) JOIN rows ON doc_id = k GROUP BY query""",
    "event_stream_windows": "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
}
