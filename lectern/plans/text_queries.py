"""Queries over texts: documents and the chunks of the archive."""

from __future__ import annotations

import unicodedata
from hashlib import sha256

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import paths, text
from lectern.operators import chunking, claims, reports, search, stored_index, structured
from lectern.plans.archive_queries import _LAST, last_sources
from lectern.session import checkpoint_dir
from lectern.sources.archive import line_blocks
from lectern.sources.tables import table, with_evidence

#: What the example searches ask.
QUESTIONS = {
    "measure": "Which strategy dampens the covariance of the hedged portfolio?",
    "solver": "explain the iterative solver and its residual",
    "ledger": "show the closing price and volume",
}
TERMS = {
    "measure": ["strategy", "dampens", "covariance", "hedged", "portfolio"],
    "solver": ["iterative", "solver", "its", "residual"],
    "ledger": ["closing", "price", "volume"],
}
SIDE_BY_SIDE = ["covariance", "residual"]


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents")


def chunk_rows(spark: SparkSession, folder: str, *fields: str) -> DataFrame:
    """Chunks with a text: ``rowid``, columns, and the evidence fields as ``e_...``. Rows delivered again are still there:
    a query drops them with ``once`` where its rows are narrow, so that texts aren't shuffled for it."""
    rows = with_evidence(table(spark, folder, "chunks"), *fields)
    return rows.select("rowid", "document_id", "locator_type", "locator_value", *[F.col(f"e.{f}").alias(f"e_{f}") for f in ("text", *fields)])


def once(rows: DataFrame) -> DataFrame:
    """Each chunk once; rows of one ``rowid`` are equal."""
    return rows.dropDuplicates(["rowid"])


def whitespace_normalised(spark: SparkSession, folder: str) -> DataFrame:
    clean = text.normal_whitespace(F.col("text"))
    return documents(spark, folder).filter("text is not null").select("doc_id", F.length(clean).alias("chars"), F.sha2(clean.cast("binary"), 256).alias("digest"))


def line_range_blocks(spark: SparkSession, folder: str) -> DataFrame:
    blocks = line_blocks(documents(spark, folder).select("doc_id", "text"), ["doc_id"], "text", 20)
    return blocks.select("doc_id", "line_start", "line_end", "section_title", F.length("text").alias("chars"))


def chunk_split(spark: SparkSession, folder: str) -> DataFrame:
    pieces = chunking.chunks(documents(spark, folder), ["doc_id"])
    parent = chunking.parent_id(F.col("doc_id"), F.lit("document"), F.lit("1"))
    ident = chunking.chunk_id(F.col("doc_id"), F.lit("document"), F.lit("1"), F.col("part_number"), F.col("text"))
    return pieces.select("doc_id", "part_number", "part_count", "char_start", "char_end", "token_estimate", parent.alias("parent_id"), ident.alias("chunk_id"))


def chunk_identities(spark: SparkSession, folder: str) -> DataFrame:
    """How many chunks of each kind have the parent id that their place gives."""
    rows = table(spark, folder, "chunks").select("rowid", "document_id", "parent_id", "locator_type", "locator_value").distinct()
    same = F.col("parent_id").eqNullSafe(chunking.parent_id(F.col("document_id"), F.col("locator_type"), F.col("locator_value")))
    return rows.groupBy("locator_type").agg(F.count("*").alias("chunks"), F.count_if(same).alias("same"), F.count_distinct("parent_id").alias("parents"))


def token_windows(spark: SparkSession, folder: str) -> DataFrame:
    windows = chunking.token_windows(documents(spark, folder).filter("text is not null"), ["doc_id"], text.words(F.lower("text")))
    return windows.select("doc_id", "win_start", "win_end", F.array_join("tokens", " ").alias("window")).select("doc_id", "win_start", "win_end", F.length("window").alias("chars"))


def probe_queries(spark: SparkSession, folder: str) -> DataFrame:
    return documents(spark, folder).select("doc_id", text.probe_query(F.coalesce("title", F.lit("")), F.coalesce("text", F.lit(""))).alias("probe"))


def keyword_lists(spark: SparkSession, folder: str) -> DataFrame:
    return documents(spark, folder).filter("title is not null").select("doc_id", F.array_join(text.keywords(F.col("title")), " ").alias("keywords"))


def question_kinds(spark: SparkSession, folder: str) -> DataFrame:
    first_line = F.substring_index(F.col("text"), ".", 1)
    rows = documents(spark, folder).filter("text is not null").select(text.question_kind(first_line).alias("kind"), text.instruction_like(F.col("text")).alias("instruction"))
    return rows.groupBy("kind", "instruction").agg(F.count("*").alias("n"))


def header_units(spark: SparkSession, folder: str) -> DataFrame:
    """The columns of the tables that chunks hold as lines, with the unit in each header, and how many rows have them."""
    lines = chunk_rows(spark, folder).filter("locator_type = 'line_range'").select("rowid", F.explode(F.split("e_text", "\n")).alias("line"))
    heads = lines.filter(F.col("line").rlike(r"^Date\s*[,|;\t]")).select("rowid", F.explode(F.split("line", r"\s*[,|;\t]\s*")).alias("header"))
    return heads.groupBy("header").agg(F.first(text.unit_of(F.col("header"))).alias("unit"), F.count_distinct("rowid").alias("chunks"))


def ledger_profile(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of the delimited tables within chunks, by year: how many, and count, mean and bounds of the closing value."""
    lines = once(chunk_rows(spark, folder).filter("locator_type = 'line_range'").select("rowid", "e_text")).select(F.explode(F.split("e_text", "\n")).alias("line"))
    cells = lines.select(F.split("line", ",").alias("c")).filter((F.size("c") == 4) & F.get("c", F.lit(0)).rlike(r"^\d{4}-\d{2}-\d{2}$"))
    rows = cells.select(F.substring(F.get("c", F.lit(0)), 1, 4).alias("year"), F.get("c", F.lit(2)).try_cast("double").alias("close"))
    return rows.groupBy("year").agg(F.count("*").alias("n"), F.count("close").alias("numeric"), F.round(F.avg("close"), 6).alias("mean_close"), F.min("close").alias("low"), F.max("close").alias("high"))


def table_answers(spark: SparkSession, folder: str) -> DataFrame:
    """For each chunk that holds a delimited table: the closing values (column C) of its rows within a range of dates."""
    texts = once(chunk_rows(spark, folder).filter((F.col("locator_type") == "line_range") & F.col("e_text").rlike(r"(?m)^\d{4}-\d{2}-\d{2},")).select("rowid", "e_text"))
    rows = structured.delimited_lines(texts, ["rowid"], "e_text")
    out = structured.answer(rows, ["rowid"], "C", "A1:D400", True, "A", "date", "2021-01-01T00:00:00", "2023-12-31T00:00:00")
    return out.select("rowid", "rows_scanned", "rows_matched", "rows_excluded", "numeric_values", "formulas", "min", "max", *[F.round(c, 6).alias(c) for c in ("sum", "mean", "stddev")])


def phrase_filter(spark: SparkSession, folder: str) -> DataFrame:
    found = search.literal_phrase("Must Be Tested Against", "e_text", "e_source_path")
    return once(chunk_rows(spark, folder, "source_path").filter(found).select("rowid", "document_id"))


def quotations(spark: SparkSession, folder: str) -> DataFrame:
    """Titles that stand word for word, as quotations are compared, in the text of their own document."""
    rows = documents(spark, folder).filter("title is not null and text is not null")
    held = F.contains(text.quote_form(F.lower("text")), text.quote_form(F.lower("title")))
    return rows.groupBy(F.coalesce("content_type", F.lit("none")).alias("kind")).agg(F.count("*").alias("titles"), F.count_if(held).alias("quoted"))


def excerpts(spark: SparkSession, folder: str) -> DataFrame:
    long = documents(spark, folder).filter(F.length("text") > 2300)
    best, around = text.best_excerpt(F.col("text"), SIDE_BY_SIDE), text.passage(F.col("text"), SIDE_BY_SIDE)
    return long.select("doc_id", F.sha2(best.cast("binary"), 256).alias("excerpt"), F.sha2(around.cast("binary"), 256).alias("passage"))


def locator_counts(spark: SparkSession, folder: str) -> DataFrame:
    rows = once(chunk_rows(spark, folder).select("rowid", "locator_type", F.length("e_text").alias("chars")))
    return rows.groupBy("locator_type").agg(F.count("*").alias("chunks"), F.sum("chars").alias("chars"), F.max("chars").alias("longest"))


def largest_documents(spark: SparkSession, folder: str) -> DataFrame:
    return reports.largest_groups(table(spark, folder, "chunks").select("rowid", "document_id").distinct(), "document_id")


def recognition_quality(spark: SparkSession, folder: str) -> DataFrame:
    rows = chunk_rows(spark, folder, "ocr_confidence").filter("e_ocr_confidence is not null")
    return reports.quality(once(rows.select("rowid", "document_id", "e_ocr_confidence")), "document_id", "e_ocr_confidence")


def citations(spark: SparkSession, folder: str) -> DataFrame:
    rows = once(chunk_rows(spark, folder, "source_path").filter("e_source_path is not null").drop("e_text"))
    return rows.select("rowid", search.citation(F.col("e_source_path"), F.col("locator_type"), F.col("locator_value")).alias("citation"))


def term_postings(spark: SparkSession, folder: str) -> DataFrame:
    """How many documents have each term in text or title, and how often in all."""
    rows = documents(spark, folder).select("doc_id", F.lower("title").alias("title"), F.lower("text").alias("text"))
    return search.postings(rows, "doc_id", ["title", "text"]).groupBy("term").agg(F.count_distinct("doc_id").alias("documents"), F.sum("tf").alias("occurrences"))


def chunk_index(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The stored index over the chunks of a folder: own path as title, course, term and role as context, and the text, in
    search form. It is made once and read by every search until the chunks change."""

    def make() -> dict[str, DataFrame]:
        rows = chunk_rows(spark, folder, "source_path", "course", "term", "content_role")
        context = F.concat_ws(" ", "e_course", "e_term", "e_content_role")
        title = paths.name(F.coalesce("e_source_path", F.lit("")))
        formed = [text.search_form(c).alias(n) for n, c in (("title", title), ("context", context), ("text", F.col("e_text")))]
        return stored_index.tables(rows.select("rowid", "document_id", "locator_type", "locator_value", F.col("e_source_path").alias("path"), *formed), "rowid", list(search.WEIGHTS), PLACE)

    root = f"{checkpoint_dir(spark)}/{INDEX_ROOT}/{sha256(folder.encode()).hexdigest()}"
    return stored_index.fresh(spark, root, f"{folder}/chunks.parquet", make)


#: Below the shared folder, where indexes of the examples lie.
INDEX_ROOT = "indexes"
PLACE = ("document_id", "locator_type", "locator_value", "path")


def index_statistics(spark: SparkSession, folder: str) -> DataFrame:
    """What the stored index holds: records, distinct terms, postings, and words in each field."""
    index = chunk_index(spark, folder)
    posted = index["postings"].agg(F.count_distinct("term").alias("terms"), F.count("*").alias("postings"), F.sum("title").alias("in_titles"), F.sum("text").alias("in_texts"))  # one row
    return index["corpus"].join(F.broadcast(posted), F.lit(True)).select("records", "terms", "postings", "in_titles", "in_texts", "size_title", "size_context", "size_text")


def bm25_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The ten best chunks for each of several questions."""
    scores = stored_index.bm25(chunk_index(spark, folder), "rowid", TERMS, search.WEIGHTS)
    return search.ranked(scores, ["query"], "score", "rowid", 10).select("query", "rowid", "rank", F.round("score", 6).alias("score"))


def filtered_bm25(spark: SparkSession, folder: str) -> DataFrame:
    """The flagship: the best chunks of lectures of some courses for a question, once for each place, few of a document,
    with their citation. Scores use the statistics of all chunks."""
    index = chunk_index(spark, folder)
    allowed = search.matching_sources(last_sources(spark, folder), {"content_type": ["lecture", "reading"], "review": "not_reviewed"}).select("document_id").distinct()
    sizes = index["places"].groupBy("document_id").agg(F.count("*").alias("size"))
    eligible = index["places"].join(allowed, "document_id", "left_semi")
    scores = stored_index.bm25(index, "rowid", {"measure": TERMS["measure"]}, search.WEIGHTS, eligible).select("rowid", "score")
    best = search.ranked(scores, [], "score", "rowid", 200).join(eligible, "rowid").join(sizes, "document_id")
    top = search.diversified(best, "rowid", "document_id", ["locator_type", "locator_value"], "size", 10)
    return top.select("rowid", "document_id", F.round("score", 6).alias("score"), search.citation(F.col("path"), F.col("locator_type"), F.col("locator_value")).alias("citation"))


def search_form(spark: SparkSession, folder: str) -> DataFrame:
    """Terms of the titles in search form: case, accents, Greek letters and dashes don't tell them apart."""
    rows = documents(spark, folder).filter("title is not null").select(F.explode(text.query_terms(text.search_form(F.col("title")), most=None)).alias("term"))
    return rows.groupBy("term").agg(F.count("*").alias("titles"))


def rank_fusion(spark: SparkSession, folder: str) -> DataFrame:
    """Lists for a whole question and for each of its terms, fused as the static edition does it."""
    rows = documents(spark, folder).select("doc_id", F.lower("title").alias("title"), F.lower("text").alias("text"), F.coalesce("source", F.lit("none")).alias("path"))
    terms = TERMS["measure"]
    scores = search.bm25(rows, "doc_id", {"all": terms} | {t: [t] for t in terms}, {"title": 4.0, "text": 1.0})
    lists = search.ranked(scores, ["query"], "score", "doc_id", 40).join(rows.select("doc_id", "path"), "doc_id")
    weighted = lists.select("doc_id", "path", (F.col("rank") - 1).alias("rank"), F.when(F.col("query") == "all", 3.0).otherwise(1.0).alias("weight"))
    return search.site_fusion(weighted, "doc_id", "path").select("doc_id", "hits", F.round("score", 6).alias("score"))


def claim_checks(spark: SparkSession, folder: str) -> DataFrame:
    """Claims that quote their own document, and the same ones that name the following document as their source."""
    rows = documents(spark, folder).filter(F.length("text") >= 100)
    quote = F.substring("text", 21, 60)
    own = rows.select((F.col("doc_id") * 2).alias("id"), F.col("doc_id").alias("source"), quote.alias("quote"))
    other = rows.select((F.col("doc_id") * 2 + 1).alias("id"), (F.col("doc_id") + 1).alias("source"), quote.alias("quote"))
    support = F.array(F.struct(F.col("source").cast("string").alias("source"), "quote"))
    made = own.union(other).select("id", F.lit("as it is written").alias("text"), F.lit("answer").alias("kind"), support.alias("supports"))
    evidence = documents(spark, folder).select(F.col("doc_id").cast("string").alias("source"), F.col("doc_id").cast("string").alias("document_id"), "text")
    return claims.checked_claims(made, evidence)


def follow_up_questions(spark: SparkSession, folder: str) -> DataFrame:
    """First sentences of a source's documents in order, read as one conversation: those that point back get context."""
    rows = documents(spark, folder).filter("source is not null and length(text) > 0").select("doc_id", "source", F.substring_index(F.col("text"), ".", 1).alias("query"))
    rows = rows.withColumn("talk", F.concat_ws("/", "source", F.floor(F.col("doc_id") / 50).cast("string")))
    out = claims.rewritten_questions(rows, "talk", "doc_id", "query")
    return out.select("doc_id", F.length("retrieval_question").alias("chars"), F.sha2(F.col("retrieval_question").cast("binary"), 256).alias("digest"))


QUERIES = {
    f.__name__: f
    for f in (
        whitespace_normalised, line_range_blocks, chunk_split, chunk_identities, token_windows, probe_queries, keyword_lists, question_kinds, header_units, ledger_profile, table_answers, phrase_filter,
        quotations, excerpts, locator_counts, largest_documents, recognition_quality, citations, term_postings, index_statistics, bm25_topk, filtered_bm25, search_form, rank_fusion, claim_checks, follow_up_questions,
    )
}

_CHUNKS = """
WITH t AS (
  SELECT chunks."rowid" AS rid, any_value(document_id) AS document_id, any_value(locator_type) AS locator_type, any_value(locator_value) AS locator_value,
    any_value(json_extract_string(evidence, '$.text')) AS e_text, any_value(json_extract_string(evidence, '$.source_path')) AS path,
    any_value(json_extract_string(evidence, '$.course')) AS e_course, any_value(json_extract_string(evidence, '$.term')) AS e_term,
    any_value(json_extract_string(evidence, '$.content_role')) AS e_role, any_value(TRY_CAST(json_extract_string(evidence, '$.ocr_confidence') AS DOUBLE)) AS confidence
  FROM chunks WHERE json_valid(evidence) AND json_extract_string(evidence, '$.text') IS NOT NULL GROUP BY 1
)
"""
_SPACE = r"[\s\x1c-\x1f\x{85}\p{Z}]"
_CLEAN = rf"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\x00', '', 'g'), '\r\n?', chr(10), 'g'), '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^{_SPACE}+|{_SPACE}+$', '', 'g')"
_STOP = ", ".join(f"'{w}'" for w in text.STOP_WORDS)
_STOP_ALL = ", ".join(f"'{w}'" for w in text.STOP_WORDS + text.MORE_STOP_WORDS)
#: Distinct elements of a list in the order of their first place.
_FIRSTS = "list_filter({l}, lambda x, i: list_position({l}, x) = i)"
_CITE = "list_last(string_split({p}, '/')) || ' · ' || CASE locator_type WHEN 'pdf_page' THEN 'p.' WHEN 'pptx_slide' THEN 'slide' WHEN 'line_range' THEN 'lines' WHEN 'notebook_cell' THEN 'cell' ELSE locator_type END || ' ' || coalesce(locator_value, '')"


def _bm25_sql(rows: str, key: str, queries: dict[str, list[str]] | str, weights: dict[str, float]) -> str:
    """Scores as SQL: ``scores`` (query, key, score) from the relation ``rows`` with the fields. ``queries`` may be SQL for pairs
    of query and term."""
    pairs = queries if isinstance(queries, str) else "VALUES " + ", ".join(f"('{q}', '{t}')" for q, ts in queries.items() for t in ts)
    fields = " UNION ALL ".join(f"SELECT {key} AS k, {w} AS weight, unnest(regexp_extract_all(coalesce({f}, ''), '[\\p{{L}}\\p{{N}}]+')) AS term FROM {rows}" for f, w in weights.items())
    return f"""
, tokens AS ({fields}), asked(query, term) AS ({pairs}),
sizes AS (SELECT r.{key} AS k, coalesce(n, 0) AS size FROM {rows} r LEFT JOIN (SELECT k, count(*) AS n FROM tokens GROUP BY k) s ON s.k = r.{key}),
corpus AS (SELECT count(*) AS records, avg(size) AS mean_size FROM sizes),
tfs AS (SELECT k, term, sum(weight) AS tf FROM tokens WHERE term IN (SELECT term FROM asked) GROUP BY k, term),
dfs AS (SELECT term, count(*) AS df FROM tfs GROUP BY term),
scores AS (SELECT query, k, sum(greatest(1e-6, ln((records - df + 0.5) / (df + 0.5))) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean_size))) AS score
  FROM tfs JOIN dfs USING (term) JOIN sizes USING (k) JOIN asked USING (term) CROSS JOIN corpus GROUP BY query, k)
"""


#: Mathematical letters with the plain ones that they are compared as, as SQL has no compatibility forms.
_MATH = [(c, unicodedata.normalize("NFKD", c)) for c in map(chr, range(0x1D400, 0x1D6A4)) if len(unicodedata.normalize("NFKD", c)) == 1 and unicodedata.normalize("NFKD", c) != c]


def _form_sql(x: str) -> str:
    """The search form as SQL, for the letters that the tables have."""
    x = f"translate({x}, '{''.join(c for c, _ in _MATH)}', '{''.join(p for _, p in _MATH)}')"
    for letter, name in text.GREEK.items():
        x = f"regexp_replace({x}, '[{letter}{letter.upper()}]', ' {name} ', 'g')"
    return rf"regexp_replace(strip_accents(lower({x})), '[_/\\\-–—]+', ' ', 'g')"


_SEARCHED = (
    _CHUNKS
    + f""", rows AS (SELECT rid, document_id, locator_type, locator_value, path, {_form_sql("list_last(string_split(coalesce(path, ''), '/'))")} AS title,
  {_form_sql("concat_ws(' ', e_course, e_term, e_role)")} AS context, {_form_sql("e_text")} AS text FROM t)"""
)
_TRIMMED = "trim(regexp_replace(trim({x}), '^#+', ''))"

_ONE_BLANK = r"trim(regexp_replace({x}, '[\s\p{{Z}}]+', ' ', 'g'))"

ORACLES = {
    "claim_checks": f"""
WITH q AS (SELECT doc_id, substr(text, 21, 60) AS quote FROM documents WHERE length(text) >= 100),
c AS (SELECT doc_id * 2 AS id, doc_id AS source, quote FROM q UNION ALL SELECT doc_id * 2 + 1, doc_id + 1, quote FROM q)
SELECT id, coalesce(length(quote) BETWEEN 12 AND 1000 AND NOT regexp_matches(quote, '{text.INSTRUCTION}')
  AND contains({_ONE_BLANK.format(x="d.text")}, {_ONE_BLANK.format(x="quote")}), false) AS accepted
FROM c LEFT JOIN documents d ON d.doc_id = c.source""",
    "follow_up_questions": f"""
WITH r AS (SELECT doc_id, source || '/' || (doc_id // 50) AS talk, string_split(text, '.')[1] AS query FROM documents WHERE source IS NOT NULL AND length(text) > 0),
m AS (SELECT *, regexp_matches(query, '{text.FOLLOW_UP}') AS back FROM r),
w AS (SELECT *, coalesce(last_value(CASE WHEN NOT back THEN query END IGNORE NULLS) OVER f, first_value(query) OVER f) AS anchor, last_value(query) OVER f AS prev, count(*) OVER f AS n FROM m
  WINDOW f AS (PARTITION BY talk ORDER BY doc_id ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, 'Earlier questions: ' || anchor || CASE WHEN prev <> anchor THEN ' / ' || prev ELSE '' END || chr(10) || 'Current question: ' || query AS led FROM w),
o AS (SELECT doc_id, CASE WHEN back AND n > 0 THEN substr(led, greatest(1, length(led) - 1999)) ELSE trim(query) END AS x FROM l)
SELECT doc_id, length(x) AS chars, sha256(x) AS digest FROM o""",
    "whitespace_normalised": f"SELECT doc_id, length({_CLEAN}) AS chars, sha256({_CLEAN}) AS digest FROM documents WHERE text IS NOT NULL",
    "line_range_blocks": r"""
WITH l AS (SELECT doc_id, string_split(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '\n$', ''), chr(10)) AS lines FROM documents WHERE length(text) > 0),
b AS (SELECT doc_id, lines, unnest(generate_series(0, len(lines) - 1, 20)) AS s FROM l),
c AS (SELECT doc_id, s + 1 AS line_start, least(s + 20, len(lines)) AS line_end, lines[s + 1:least(s + 20, len(lines))] AS own FROM b),
d AS (SELECT doc_id, line_start, line_end, list_filter(own, lambda x: starts_with(ltrim(x), '#'))[-1] AS head, regexp_replace(array_to_string(own, chr(10)), '^\s+|\s+$', '', 'g') AS text FROM c)
SELECT doc_id, line_start, line_end, last_value(trim(regexp_replace(trim(head), '^#+', '')) IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_start ROWS UNBOUNDED PRECEDING) AS section_title,
  length(text) AS chars FROM d WHERE text <> ''""",
    "chunk_split": f"""
WITH RECURSIVE c AS (SELECT doc_id, {_CLEAN} AS t FROM documents WHERE text IS NOT NULL),
p AS (
  SELECT doc_id, t, 0 AS s, CASE WHEN length(t) <= 3500 THEN length(t) END AS e, 0 AS n FROM c WHERE t <> ''
  UNION ALL
  SELECT doc_id, t, CASE WHEN n = 0 THEN 0 ELSE greatest(s + 1, e - 400) END AS s2,
    CASE WHEN s2 + 3500 >= length(t) THEN length(t) ELSE coalesce(nullif(greatest(
      CASE WHEN strpos(reverse(substr(t, s2 + 1751, 1750)), chr(10)) > 0 THEN s2 + 3500 - strpos(reverse(substr(t, s2 + 1751, 1750)), chr(10)) + 1 ELSE 0 END,
      CASE WHEN strpos(reverse(substr(t, s2 + 1751, 1750)), ' .') > 0 THEN s2 + 3500 - strpos(reverse(substr(t, s2 + 1751, 1750)), ' .') + 1 ELSE 0 END), 0), s2 + 3500) END, n + 1
  FROM p WHERE e IS NULL OR (n > 0 AND e < length(t))
),
q AS (SELECT doc_id, n, s, e, substr(t, s + 1, e - s) AS piece FROM p WHERE e IS NOT NULL),
r AS (SELECT doc_id, n, s + length(piece) - length(regexp_replace(piece, '^{_SPACE}+', '')) AS char_start, regexp_replace(piece, '^{_SPACE}+|{_SPACE}+$', '', 'g') AS own FROM q),
k AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS part_number, count(*) OVER (PARTITION BY doc_id) AS part_count, char_start, char_start + length(own) AS char_end, own FROM r WHERE own <> '')
SELECT doc_id, part_number, part_count, char_start, char_end, greatest(1, round_even(length(own) / 4, 0))::INT AS token_estimate, 'parent:' || sha1(doc_id || '|document|1') AS parent_id,
  'chunk:' || sha256(doc_id || '|document|1|' || part_number || '|' || own) AS chunk_id FROM k""",
    "chunk_identities": """
SELECT locator_type, count(*) AS chunks, count(*) FILTER (parent_id = 'parent:' || sha1(coalesce(document_id, 'None') || '|' || coalesce(locator_type, 'None') || '|' || coalesce(locator_value, 'None'))) AS same,
  count(DISTINCT parent_id) AS parents
FROM (SELECT DISTINCT chunks."rowid", document_id, parent_id, locator_type, locator_value FROM chunks) GROUP BY locator_type""",
    "token_windows": r"""
WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS tokens FROM documents WHERE text IS NOT NULL),
s AS (SELECT doc_id, tokens, unnest(generate_series(0, greatest(0, len(tokens) - 1), 192)) AS win_start FROM w)
SELECT doc_id, win_start::INT AS win_start, least(win_start + 224, len(tokens))::INT AS win_end, length(array_to_string(tokens[win_start + 1:win_start + 224], ' ')) AS chars
FROM s WHERE win_start = 0 OR win_start - 192 + 224 < len(tokens)""",
    "probe_queries": rf"""
WITH w AS (SELECT doc_id, list_filter(regexp_extract_all(lower(concat_ws(' ', coalesce(title, ''), coalesce(text, ''))), '[\p{{L}}\p{{N}}]+'),
  lambda w: length(w) >= 3 AND w NOT IN ({_STOP}) AND NOT regexp_full_match(w, '\p{{N}}+'))[1:4000] AS l FROM documents)
SELECT doc_id, array_to_string(({_FIRSTS.format(l="l")})[1:8], ' ') AS probe FROM w""",
    "keyword_lists": rf"""
WITH w AS (SELECT doc_id, list_filter(regexp_extract_all(lower(title), '[\p{{L}}\p{{N}}][\p{{L}}\p{{N}}''’\-]*'), lambda w: length(w) > 1 AND w NOT IN ({_STOP_ALL})) AS l FROM documents WHERE title IS NOT NULL)
SELECT doc_id, array_to_string({_FIRSTS.format(l="l")}, ' ') AS keywords FROM w""",
    "question_kinds": rf"""
WITH q AS (SELECT string_split(text, '.')[1] AS q, text FROM documents WHERE text IS NOT NULL),
k AS (SELECT regexp_matches(q, '{text.TABLE_WORDS}') AS about, regexp_matches(q, '{text.NUMBER_WORDS}') AS number, regexp_matches(q, '{text.LOOKUP_WORDS}') AS look,
  regexp_matches(text, '{text.INSTRUCTION}') AS instruction FROM q)
SELECT CASE WHEN about AND number THEN 'computation' WHEN about AND look THEN 'structured_lookup' ELSE 'text' END AS kind, instruction, count(*) AS n FROM k GROUP BY ALL""",
    "header_units": _CHUNKS
    + r""", l AS (SELECT rid, unnest(string_split(e_text, chr(10))) AS line FROM t WHERE locator_type = 'line_range'),
h AS (SELECT rid, unnest(regexp_split_to_array(line, '\s*[,|;\t]\s*')) AS header FROM l WHERE regexp_matches(line, '^Date\s*[,|;\t]'))
SELECT header, coalesce(nullif(regexp_extract(header, '[\[(]([^\])]+)[\])]', 1), ''), 'unknown') AS unit, count(DISTINCT rid) AS chunks FROM h GROUP BY header""",
    "ledger_profile": _CHUNKS
    + r""", l AS (SELECT string_split(unnest(string_split(e_text, chr(10))), ',') AS c FROM t WHERE locator_type = 'line_range'),
r AS (SELECT c[1][1:4] AS year, TRY_CAST(c[3] AS DOUBLE) AS close FROM l WHERE len(c) = 4 AND regexp_matches(c[1], '^\d{4}-\d{2}-\d{2}$'))
SELECT year, count(*) AS n, count(close) AS "numeric", round(avg(close), 6) AS mean_close, min(close) AS low, max(close) AS high FROM r GROUP BY year""",
    "phrase_filter": _CHUNKS + "SELECT rid AS rowid, document_id FROM t WHERE contains(lower(e_text), 'must be tested against') OR contains(lower(coalesce(path, '')), 'must be tested against')",
    "quotations": r"""
SELECT coalesce(content_type, 'none') AS kind, count(*) AS titles,
  count(*) FILTER (contains(trim(regexp_replace(lower(text), '[\s\p{Z}]+', ' ', 'g')), trim(regexp_replace(lower(title), '[\s\p{Z}]+', ' ', 'g')))) AS quoted
FROM documents WHERE title IS NOT NULL AND text IS NOT NULL GROUP BY 1""",
    "excerpts": """
WITH d AS (SELECT doc_id, text, lower(text) AS low FROM documents WHERE length(text) > 2300),
s AS (SELECT doc_id, text, low, unnest(generate_series(0, length(text) - 1, 1150)) AS s FROM d),
w AS (SELECT doc_id, text, s, low[s + 1:s + 2300] AS w FROM s),
n AS (SELECT doc_id, text, s, (length(w) - length(replace(w, 'covariance', ''))) / 10 + (length(w) - length(replace(w, 'residual', ''))) / 8 AS n FROM w),
b AS (SELECT doc_id, text, s FROM n QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, s) = 1),
p AS (SELECT doc_id, greatest(0, coalesce(least(nullif(instr(low, 'covariance'), 0), nullif(instr(low, 'residual'), 0)) - 1, length(low)) - 250) AS a FROM d)
SELECT doc_id, sha256(b.text[s + 1:s + 2300]) AS excerpt, sha256(b.text[a + 1:a + 1300]) AS passage FROM b JOIN p USING (doc_id)""",
    "locator_counts": _CHUNKS + "SELECT locator_type, count(*) AS chunks, sum(length(e_text))::BIGINT AS chars, max(length(e_text)) AS longest FROM t GROUP BY locator_type",
    "largest_documents": """SELECT document_id, count(DISTINCT chunks."rowid") AS n FROM chunks GROUP BY document_id ORDER BY n DESC, document_id LIMIT 20""",
    "recognition_quality": _CHUNKS
    + "SELECT document_id, round_even(avg(confidence), 1) AS mean_confidence, count(*) FILTER (confidence < 70) AS to_review, count(*) AS pages FROM t WHERE confidence IS NOT NULL GROUP BY document_id",
    "citations": _CHUNKS + f"SELECT rid AS rowid, {_CITE.format(p='path')} AS citation FROM t WHERE path IS NOT NULL",
    "term_postings": r"""
WITH x AS (SELECT doc_id, unnest(list_concat(regexp_extract_all(coalesce(lower(title), ''), '[\p{L}\p{N}]+'), regexp_extract_all(coalesce(lower(text), ''), '[\p{L}\p{N}]+'))) AS term FROM documents)
SELECT term, count(DISTINCT doc_id) AS documents, count(*) AS occurrences FROM x GROUP BY term""",
    "table_answers": _CHUNKS
    + r"""
, l AS (SELECT rid, unnest(string_split(regexp_replace(e_text, '\r\n?', chr(10), 'g'), chr(10))) AS line, generate_subscripts(string_split(regexp_replace(e_text, '\r\n?', chr(10), 'g'), chr(10)), 1) AS n
  FROM t WHERE locator_type = 'line_range' AND regexp_matches(e_text, '(^|\n)\d{4}-\d{2}-\d{2},')),
c AS (SELECT rid, n, string_split(line, ',') AS c FROM l WHERE line <> '' AND n <= 400),
v AS (SELECT rid, n > 1 AS body, CASE WHEN regexp_matches(c[1], '^\d{4}-\d{2}-\d{2}($|[ T])') THEN TRY_CAST(c[1] AS TIMESTAMP) END AS d, TRY_CAST(c[3] AS DOUBLE) AS x FROM c),
m AS (SELECT *, body AND coalesce(d BETWEEN '2021-01-01' AND '2023-12-31', false) AS m FROM v)
SELECT rid AS rowid, count(*) FILTER (body) AS rows_scanned, count(*) FILTER (m) AS rows_matched, count(*) FILTER (body AND NOT m) AS rows_excluded, count(x) FILTER (m) AS numeric_values, 0 AS formulas,
  min(x) FILTER (m) AS "min", max(x) FILTER (m) AS "max", round(sum(x) FILTER (m), 6) AS "sum", round(avg(x) FILTER (m), 6) AS mean, round(stddev_samp(x) FILTER (m), 6) AS stddev
FROM m GROUP BY rid""",
    "search_form": f"""
WITH t AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all({_form_sql("title")}, '[\\p{{L}}\\p{{N}}]+'))) AS term FROM documents WHERE title IS NOT NULL)
SELECT term, count(*) AS titles FROM t WHERE term NOT IN ({_STOP}) GROUP BY term""",
    "index_statistics": _SEARCHED
    + """, w AS (SELECT rid, regexp_extract_all(title, '[\\p{L}\\p{N}]+') AS a, regexp_extract_all(context, '[\\p{L}\\p{N}]+') AS b, regexp_extract_all(text, '[\\p{L}\\p{N}]+') AS c FROM rows),
p AS (SELECT rid, unnest(list_concat(a, b, c)) AS term FROM w)
SELECT (SELECT count(*) FROM w) AS records, (SELECT count(DISTINCT term) FROM p) AS terms, (SELECT count(*) FROM (SELECT DISTINCT rid, term FROM p)) AS postings,
  sum(len(a))::BIGINT AS in_titles, sum(len(c))::BIGINT AS in_texts, sum(len(a))::BIGINT AS size_title, sum(len(b))::BIGINT AS size_context, sum(len(c))::BIGINT AS size_text FROM w""",
    "bm25_topk": _SEARCHED
    + _bm25_sql("rows", "rid", TERMS, search.WEIGHTS)
    + "SELECT query, k AS rowid, row_number() OVER (PARTITION BY query ORDER BY score DESC, k) AS rank, round(score, 6) AS score FROM scores QUALIFY rank <= 10",
    "filtered_bm25": _SEARCHED
    + _bm25_sql("rows", "rid", {"measure": TERMS["measure"]}, search.WEIGHTS)
    + ", "
    + _LAST.strip().removeprefix("WITH ")
    + f""", hits AS (SELECT r.*, score FROM scores JOIN rows r ON r.rid = k
  WHERE document_id IN (SELECT document_id FROM last WHERE lower(content_type) IN ('lecture', 'reading') AND lower(review) = 'not_reviewed') ORDER BY score DESC, rid LIMIT 200),
once AS (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY document_id, locator_type, locator_value ORDER BY score DESC, rid) = 1),
turns AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY score DESC, rid) > CASE WHEN (SELECT count(*) FROM rows x WHERE x.document_id = once.document_id) > 200 THEN 1 ELSE 4 END AS later FROM once)
SELECT rid AS rowid, document_id, round(score, 6) AS score, {_CITE.format(p="path")} AS citation FROM (SELECT * FROM turns ORDER BY later, score DESC, rid LIMIT 10)""",
    "rank_fusion": """
WITH rows AS (SELECT doc_id, lower(title) AS title, lower(text) AS text, coalesce(source, 'none') AS path FROM documents)"""
    + _bm25_sql("rows", "doc_id", {"all": TERMS["measure"]} | {t: [t] for t in TERMS["measure"]}, {"title": 4.0, "text": 1.0})
    + """, lists AS (SELECT query, k, row_number() OVER (PARTITION BY query ORDER BY score DESC, k) - 1 AS r FROM scores QUALIFY r < 40),
f AS (SELECT k, path, sum(CASE WHEN query = 'all' THEN 3.0 ELSE 1.0 END / (r + 5)) AS score, count(*) AS hits FROM lists JOIN rows ON doc_id = k GROUP BY k, path),
top AS (SELECT * FROM f ORDER BY hits DESC, score DESC, k LIMIT 40),
turn AS (SELECT * FROM top QUALIFY row_number() OVER (PARTITION BY path ORDER BY hits DESC, score DESC, k) <= 2)
SELECT k AS doc_id, hits, round(score, 6) AS score FROM turn ORDER BY hits DESC, turn.score DESC, k LIMIT 6""",
}
