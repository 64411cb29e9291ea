"""Queries over the archive's lists of files: manifest and snapshots of sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import paths
from lectern.operators import reports, search, windows
from lectern.operators.snapshots import normal_hash, normal_path
from lectern.sources.archive import with_canonical
from lectern.sources.tables import table, with_evidence

SUFFIX = r"lower(regexp_extract(list_last(string_split({p}, '/')), '^.+(\.[^.]+)$', 1))"
STEM = r"regexp_replace(list_last(string_split({p}, '/')), '^(.+)\.[^.]+$', '\1')"


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """The manifest without repeated rows."""
    return table(spark, folder, "manifest").drop("source_paths").distinct()


def last_sources(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of the last snapshot: for each path the one delivered last."""
    sources = table(spark, folder, "sources")
    sources = sources.withColumn("path", normal_path(F.col("path"))).withColumn("content_hash", normal_hash(F.col("content_hash")))
    newest = sources.agg(F.max("snapshot_no").alias("snapshot_no"))
    current = sources.join(F.broadcast(newest), "snapshot_no").filter("path is not null")  # one row is broadcast
    order = ["delivered_at", *[c for c in sources.columns if c not in ("path", "delivered_at", "snapshot_no")]]
    return windows.latest(current.select("path", *order), ["path"], order)


_LAST = r"""
WITH clean AS (
  SELECT * REPLACE (
    regexp_replace(replace(path, '\', '/'), '^(\./+)+', '') AS path,
    nullif(regexp_replace(lower(trim(content_hash)), '^sha256:', ''), '') AS content_hash)
  FROM sources WHERE path IS NOT NULL AND snapshot_no = (SELECT max(snapshot_no) FROM sources)
), last AS (
  SELECT * FROM clean
  QUALIFY row_number() OVER (PARTITION BY path ORDER BY delivered_at DESC NULLS LAST, document_id DESC NULLS LAST, course DESC NULLS LAST, course_label DESC NULLS LAST,
    term DESC NULLS LAST, content_type DESC NULLS LAST, folder DESC NULLS LAST, file_type DESC NULLS LAST, lecturer DESC NULLS LAST, review DESC NULLS LAST,
    version_family DESC NULLS LAST, version_label DESC NULLS LAST, content_hash DESC NULLS LAST) = 1
)
"""
_MANIFEST = "WITH m AS (SELECT DISTINCT * EXCLUDE (source_paths) FROM manifest)\n"


def inventory_counts(spark: SparkSession, folder: str) -> DataFrame:
    rows = manifest(spark, folder).withColumn("extension", paths.suffix(F.col("source_path")))
    return reports.value_counts(rows, {"route": "[none]", "extension": "[none]", "term": "[other]", "course": "[program-wide-or-other]"})


def duplicate_summary(spark: SparkSession, folder: str) -> DataFrame:
    return reports.duplicate_summary(manifest(spark, folder))


def canonical_paths(spark: SparkSession, folder: str) -> DataFrame:
    rows = with_canonical(manifest(spark, folder).drop("duplicate_of").filter("content_hash is not null").select("source_path", "content_hash").distinct())
    return rows.select("source_path", F.size("source_paths").alias("paths"), "duplicate_of")


def manifest_context(spark: SparkSession, folder: str) -> DataFrame:
    path = F.col("source_path")
    rows = manifest(spark, folder).select("source_path").distinct()
    return rows.select("source_path", *[c.alias(n) for n, c in paths.context(path).items()], paths.route(path).alias("route"))


def index_metadata(spark: SparkSession, folder: str) -> DataFrame:
    path = F.col("path")
    rows = table(spark, folder, "sources").select(normal_path(path).alias("path")).filter("path is not null").distinct()
    return rows.select("path", *[c.alias(n) for n, c in paths.metadata(path).items()])


def effective_metadata(spark: SparkSession, folder: str) -> DataFrame:
    """The type of each file of the manifest with the term and review that searches filter by."""
    path = F.col("source_path")
    typed = manifest(spark, folder).filter("source_path is not null").withColumn("content_type", paths.metadata(path)["content_type"])
    found = paths.effective(path, F.col("content_type"), F.col("term"), F.col("access_review"))
    return typed.select("source_path", "content_type", *[c.alias(n) for n, c in found.items()]).distinct()


def review_queue(spark: SparkSession, folder: str) -> DataFrame:
    rows = manifest(spark, folder).withColumn("access_review", F.coalesce("access_review", F.lit("not_reviewed")))
    reasons = paths.review_reasons(F.coalesce("route", F.lit("unsupported")), F.col("size_bytes"), F.col("access_review"))
    return rows.select("source_path", F.array_join(reasons, ",").alias("reasons")).filter("reasons <> ''").distinct()


def metadata_filter(spark: SparkSession, folder: str) -> DataFrame:
    found = search.matching_sources(last_sources(spark, folder), {"course": ["qfin7140", "STOC6205"], "content_type": "lecture", "folder": "spring", "review": []})
    return found.select("path", "document_id", "course", "term")


def pinned_sources(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks of pinned sources that also pass a metadata filter; the pins are the first two paths in order."""
    sources = last_sources(spark, folder)
    pins = [r.path for r in sources.select("path").orderBy("path").limit(2).collect()]
    eligible = search.pinned(search.matching_sources(sources, {"file_type": ["pdf", "txt", "pptx", "docx", "py", "ipynb", "xlsx", "csv"]}), pins)
    chunks = table(spark, folder, "chunks").select("rowid", "document_id").distinct()
    return chunks.join(eligible.select("document_id").distinct(), "document_id", "left_semi").groupBy("document_id").agg(F.count("*").alias("chunks"))


def facet_counts(spark: SparkSession, folder: str) -> DataFrame:
    return search.facets(last_sources(spark, folder), table(spark, folder, "chunks"))


def related_versions(spark: SparkSession, folder: str) -> DataFrame:
    return search.related_versions(last_sources(spark, folder)).select("path", "related_path", "version_family")


def alias_texts(spark: SparkSession, folder: str) -> DataFrame:
    return search.alias_texts(last_sources(spark, folder).filter("document_id is not null"))


def source_states(spark: SparkSession, folder: str) -> DataFrame:
    rows = manifest(spark, folder).select(normal_path(F.col("source_path")).alias("path"), normal_hash(F.col("content_hash")).alias("content_hash")).distinct()
    states = reports.source_states(rows, last_sources(spark, folder).select("path", "content_hash"), "path", "content_hash")
    return states.groupBy("state").agg(F.count("*").alias("n"))


def export_records(spark: SparkSession, folder: str) -> DataFrame:
    rows = reports.export_records(last_sources(spark, folder).filter("document_id is not null"), ["course", "term", "content_type", "file_type"])
    return rows.select("document_id", "path", *[F.array_join(f"all_{f}", "|").alias(f) for f in ("course", "term", "content_type", "file_type")])


def first_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """For each current source its document's first chunk, if there is one."""
    first = table(spark, folder, "chunks").groupBy("document_id").agg(F.min_by("chunk_id", "rowid").alias("chunk_id"), F.count_distinct("rowid").alias("chunks"))
    return last_sources(spark, folder).select("path", "document_id").join(first, "document_id", "left").select("path", "chunk_id", F.coalesce("chunks", F.lit(0)).alias("chunks"))


def coverage_groups(spark: SparkSession, folder: str) -> DataFrame:
    searchable = with_evidence(table(spark, folder, "chunks")).filter(F.trim("e.text") != "").select("document_id")
    return reports.coverage(last_sources(spark, folder), searchable, {"course": "course", "content_type": "content_type", "format": "file_type"})


def orphan_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks whose document is in no snapshot, by kind of locator."""
    known = table(spark, folder, "sources").select("document_id").distinct()
    chunks = table(spark, folder, "chunks").select("rowid", "document_id", "locator_type").distinct()
    return chunks.join(known, "document_id", "left_anti").groupBy("locator_type").agg(F.count("*").alias("n"))


def path_history(spark: SparkSession, folder: str) -> DataFrame:
    """For each path the runs of snapshots over which its content stayed the same."""
    clean = table(spark, folder, "sources").select("snapshot_no", normal_path(F.col("path")).alias("path"), normal_hash(F.col("content_hash")).alias("content_hash"), "delivered_at").filter("path is not null")
    rows = windows.latest(clean, ["snapshot_no", "path"], ["delivered_at", "content_hash"])
    return windows.runs(rows, ["path"], ["snapshot_no"], "content_hash").select("path", "content_hash", F.col("first").alias("first_snapshot"), F.col("last").alias("last_snapshot"), F.col("rows").alias("snapshots"))


QUERIES = {
    f.__name__: f
    for f in (
        inventory_counts, duplicate_summary, canonical_paths, manifest_context, index_metadata, effective_metadata, review_queue, metadata_filter, pinned_sources, facet_counts,
        related_versions, alias_texts, source_states, export_records, first_chunks, coverage_groups, orphan_chunks, path_history,
    )
}

_PARTS = "string_split(source_path, '/')"
_ROLES = ", ".join(f"'{r}'" for r in paths.FOLDER_ROLES)
_ROUTE = "CASE " + SUFFIX.format(p="{p}") + " " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in paths.ROUTES.items()) + " ELSE 'unsupported' END"
_TYPES = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in paths.FOLDER_TYPES.items())
_FACETS = " UNION ALL ".join(f"SELECT '{f}' AS field, {f} AS value, document_id FROM last" for f in search.FILTERS)

ORACLES = {
    "inventory_counts": _MANIFEST
    + f"""
SELECT field, value, count(*) AS n FROM (
  SELECT 'route' AS field, coalesce(nullif(route, ''), '[none]') AS value FROM m
  UNION ALL SELECT 'extension', coalesce(nullif({SUFFIX.format(p="source_path")}, ''), '[none]') FROM m
  UNION ALL SELECT 'term', coalesce(nullif(term, ''), '[other]') FROM m
  UNION ALL SELECT 'course', coalesce(nullif(course, ''), '[program-wide-or-other]') FROM m
) GROUP BY ALL""",
    "duplicate_summary": _MANIFEST
    + """
SELECT sum(n)::BIGINT AS file_count, count(*) AS unique_content_count, count(*) FILTER (n > 1) AS duplicate_group_count,
  sum(bytes)::BIGINT AS total_bytes, round(sum(bytes) / 1073741824.0, 3) AS total_gib
FROM (SELECT content_hash, count(*) AS n, sum(size_bytes) AS bytes FROM m GROUP BY content_hash)""",
    "canonical_paths": """
WITH m AS (SELECT DISTINCT source_path, content_hash FROM manifest WHERE content_hash IS NOT NULL)
SELECT source_path, count(*) OVER same AS paths,
  nullif(first_value(source_path) OVER (PARTITION BY content_hash ORDER BY lower(source_path), source_path), source_path) AS duplicate_of
FROM m WINDOW same AS (PARTITION BY content_hash)""",
    "manifest_context": f"""
WITH m AS (SELECT DISTINCT source_path, {_PARTS} AS parts FROM manifest), c AS (
  SELECT *, CASE WHEN regexp_matches(parts[1], '^(Fall|Spring|Summer|Winter) \\d{{4}}$') THEN parts[1] END AS term FROM m
), s AS (SELECT *, CASE WHEN term IS NOT NULL THEN 2 WHEN parts[1] = 'Program-wide' THEN 1 ELSE 0 END AS start FROM c)
SELECT source_path, term, CASE WHEN term IS NOT NULL THEN parts[2] END AS course,
  coalesce(list_filter(list_transform(parts[start + 1:len(parts) - 1], lambda p: lower(p)), lambda p: p IN ({_ROLES}))[1],
    CASE WHEN len(parts) > start + 1 THEN lower(parts[start + 2]) END) AS content_role,
  CASE WHEN len(list_filter(parts, lambda p: lower(p) IN ('solutions', 'assessments'))) > 0 THEN 'review_required' ELSE 'not_reviewed' END AS access_review,
  {_ROUTE.format(p="source_path")} AS route
FROM s""",
    "index_metadata": rf"""
WITH p AS (SELECT DISTINCT regexp_replace(replace(path, '\', '/'), '^(\./+)+', '') AS path FROM sources WHERE path IS NOT NULL),
q AS (SELECT path, string_split(path, '/') AS parts, {STEM.format(p="path")} AS stem, regexp_extract(path, '^(.*)/[^/]*$', 1) AS parent FROM p),
r AS (SELECT *, CASE WHEN parts[1] <> 'Program-wide' AND len(parts) > 1 THEN parts[2] ELSE '' END AS label,
  list_transform(parts[3:len(parts) - 1], lambda x: lower(x)) AS folders FROM q)
SELECT path, string_split(label, ' - ')[1] AS course, label AS course_label,
  CASE WHEN contains(lower(stem), 'solution') OR contains(lower(stem), 'answer key') OR list_contains(folders, 'solutions') THEN 'solution'
    WHEN list_contains(folders, 'assessments') OR regexp_matches(lower(stem), '\b(exam|midterm|quiz)\b') THEN 'assessment'
    WHEN contains(lower(stem), 'syllabus') OR list_contains(folders, 'syllabi') THEN 'syllabus'
    WHEN parts[-1] = 'README.md' THEN 'course_map'
    ELSE coalesce(list_filter(list_transform(folders, lambda f: CASE f {_TYPES} END), lambda t: t IS NOT NULL)[-1], 'other') END AS content_type,
  CASE WHEN parent <> '' THEN parent ELSE '.' END AS folder,
  ltrim({SUFFIX.format(p="path")}, '.') AS file_type,
  CASE WHEN list_position(parts, 'sessions') > 0 AND list_position(parts, 'sessions') < len(parts) - 1
    THEN regexp_replace(parts[list_position(parts, 'sessions') + 1], '^\d{{4}}\s+', '') ELSE '' END AS lecturer,
  substr(sha256(lower(CASE WHEN parent <> '' THEN parent || '/' ELSE '' END || regexp_replace(stem, '\s*\[Ver\s+\d+\]', '', 'gi'))), 1, 24) AS version_family,
  nullif(regexp_extract(stem, '\[Ver\s+(\d+)\]', 1, 'i'), '') AS version_label
FROM r""",
    "review_queue": _MANIFEST
    + """
SELECT DISTINCT source_path, concat_ws(',', CASE WHEN coalesce(route, 'unsupported') = 'unsupported' THEN 'unsupported_extension' END,
  CASE WHEN route LIKE 'legacy\\_%' ESCAPE '\\' THEN 'legacy_office_format' END,
  CASE WHEN route = 'dataset' AND size_bytes >= 5242880 THEN 'large_structured_dataset' END,
  CASE WHEN access_review = 'review_required' THEN 'assessment_or_solution_material' END,
  CASE WHEN route = 'image' THEN 'visual_asset_needs_ocr_or_caption_review' END) AS reasons
FROM m WHERE reasons <> ''""",
    "metadata_filter": _LAST + "SELECT path, document_id, course, term FROM last WHERE lower(course) IN ('qfin7140', 'stoc6205') AND lower(content_type) = 'lecture' AND contains(lower(folder), 'spring')",
    "pinned_sources": _LAST
    + """, pins AS (SELECT path FROM last ORDER BY path LIMIT 2)
SELECT document_id, count(DISTINCT chunks."rowid") AS chunks FROM chunks WHERE document_id IN (
  SELECT document_id FROM last WHERE path IN (SELECT path FROM pins) AND file_type IN ('pdf', 'txt', 'pptx', 'docx', 'py', 'ipynb', 'xlsx', 'csv')) GROUP BY document_id""",
    "facet_counts": _LAST
    + f"""
SELECT field, value, count(DISTINCT document_id) AS documents,
  count(DISTINCT CASE WHEN document_id IN (SELECT document_id FROM chunks) THEN document_id END) AS searchable_documents
FROM ({_FACETS}) WHERE value <> '' GROUP BY field, value""",
    "related_versions": _LAST + "SELECT a.path, b.path AS related_path, a.version_family FROM last a JOIN last b ON a.version_family = b.version_family AND a.document_id <> b.document_id",
    "alias_texts": _LAST
    + """
SELECT document_id, string_agg(list_last(string_split(path, '/')), ' ' ORDER BY path) AS title,
  string_agg(concat_ws(' ', coalesce(course, ''), coalesce(course_label, ''), coalesce(term, ''), coalesce(content_type, ''), coalesce(lecturer, ''), coalesce(folder, '')), ' ' ORDER BY path) AS context
FROM last WHERE document_id IS NOT NULL GROUP BY document_id""",
    "source_states": _LAST
    + r""", m AS (SELECT DISTINCT regexp_replace(replace(source_path, '\', '/'), '^(\./+)+', '') AS path,
  nullif(regexp_replace(lower(trim(content_hash)), '^sha256:', ''), '') AS content_hash FROM manifest)
SELECT CASE WHEN l.path IS NULL THEN 'missing' WHEN m.content_hash IS NOT DISTINCT FROM l.content_hash THEN 'current' ELSE 'changed' END AS state, count(*) AS n
FROM m LEFT JOIN last l ON m.path = l.path GROUP BY 1""",
    "export_records": _LAST
    + "SELECT document_id, min(path) AS path, "
    + ", ".join(f"coalesce(string_agg(DISTINCT nullif({f}, ''), '|' ORDER BY nullif({f}, '')), '') AS {f}" for f in ("course", "term", "content_type", "file_type"))
    + " FROM last WHERE document_id IS NOT NULL GROUP BY document_id",
    "first_chunks": _LAST
    + """, f AS (SELECT document_id, arg_min(chunk_id, chunks."rowid") AS chunk_id, count(DISTINCT chunks."rowid") AS chunks FROM chunks GROUP BY document_id)
SELECT path, chunk_id, coalesce(chunks, 0) AS chunks FROM last LEFT JOIN f USING (document_id)""",
    "coverage_groups": _LAST
    + """, found AS (SELECT DISTINCT document_id FROM chunks WHERE json_valid(evidence) AND trim(json_extract_string(evidence, '$.text')) <> ''),
g AS (SELECT unnest(['course:' || coalesce(nullif(course, ''), 'none'), 'content_type:' || coalesce(nullif(content_type, ''), 'none'), 'format:' || coalesce(nullif(file_type, ''), 'none')]) AS "group",
  document_id IN (SELECT document_id FROM found) AS hit FROM last)
SELECT "group", count(*) AS sources, count(*) FILTER (hit) AS searchable, round(avg(CASE WHEN hit THEN 1 ELSE 0 END), 6) AS coverage FROM g GROUP BY "group" """,
    "orphan_chunks": """
SELECT locator_type, count(*) AS n FROM (SELECT DISTINCT chunks."rowid", document_id, locator_type FROM chunks)
WHERE document_id NOT IN (SELECT document_id FROM sources WHERE document_id IS NOT NULL) GROUP BY locator_type""",
    "path_history": r"""
WITH clean AS (
  SELECT snapshot_no, regexp_replace(replace(path, '\', '/'), '^(\./+)+', '') AS path, nullif(regexp_replace(lower(trim(content_hash)), '^sha256:', ''), '') AS content_hash, delivered_at
  FROM sources WHERE path IS NOT NULL
), rows AS (
  SELECT * FROM clean QUALIFY row_number() OVER (PARTITION BY snapshot_no, path ORDER BY delivered_at DESC NULLS LAST, content_hash DESC NULLS LAST) = 1
), marked AS (
  SELECT *, CASE WHEN row_number() OVER w > 1 AND lag(content_hash) OVER w IS NOT DISTINCT FROM content_hash THEN 0 ELSE 1 END AS fresh FROM rows
  WINDOW w AS (PARTITION BY path ORDER BY snapshot_no)
), runs AS (SELECT *, sum(fresh) OVER (PARTITION BY path ORDER BY snapshot_no) AS run FROM marked)
SELECT path, content_hash, min(snapshot_no) AS first_snapshot, max(snapshot_no) AS last_snapshot, count(*) AS snapshots FROM runs GROUP BY path, run, content_hash""",
}
ORACLES["effective_metadata"] = (
    ORACLES["index_metadata"].replace("FROM sources WHERE path IS NOT NULL", "FROM (SELECT source_path AS path FROM manifest) WHERE path IS NOT NULL").replace("WITH p AS", "WITH typed AS (WITH p AS", 1)
    + f""")
SELECT DISTINCT m.source_path, content_type, coalesce(nullif(term, ''), CASE WHEN string_split(m.source_path, '/')[1] = 'Program-wide' THEN 'Program-wide' END, '') AS term,
  CASE WHEN content_type IN ('solution', 'assessment') OR {SUFFIX.format(p="m.source_path")} = '.zip' THEN 'review_required' ELSE coalesce(access_review, 'not_reviewed') END AS review
FROM manifest m JOIN typed t ON t.path = m.source_path"""
)
