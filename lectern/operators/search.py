"""Retrieval: metadata predicates, BM25, exact cosine, rank fusion, diversification, citations and facets.

Everything is a plan over whole tables. Filters come before ranks, so that a filter never costs candidates; texts are
joined to the few winners only.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import paths
from lectern.functions.text import fold_ascii, words
from lectern.session import durable

#: What sources can be filtered by, and of these the ones that are looked for inside the value.
FILTERS = ("course", "term", "content_type", "lecturer", "folder", "file_type", "review")
PARTIAL = ("folder", "lecturer")
#: Weights of the title, the context and the text; saturation and length of BM25; fusion constant.
WEIGHTS = {"title": 4.0, "context": 0.3, "text": 1.0}
K1, B, LEAST_IDF, FUSION = 1.2, 0.75, 1e-6, 60
UNITS = {"pdf_page": "p.", "pptx_slide": "slide", "line_range": "lines", "notebook_cell": "cell"}


def matching_sources(sources: DataFrame, filters: dict[str, str | Sequence[str]]) -> DataFrame:
    """The rows (aliases) of ``sources`` for which every filter has one of its values. Letter case of A to Z is ignored.

    All filters hold on the same alias. An empty list of values filters nothing; unknown fields and values that aren't
    strings raise an error.
    """
    if unknown := set(filters) - set(FILTERS):
        raise ValueError("unknown filters: " + ", ".join(sorted(unknown)))
    keep = F.lit(True)
    for field, values in filters.items():
        values = [values] if isinstance(values, str) else list(values)
        if not all(isinstance(v, str) for v in values):
            raise ValueError("filters hold strings or lists of strings")
        if not values:
            continue
        own, wanted = fold_ascii(F.col(field)), [_ascii(v) for v in values]
        tests = [F.contains(own, F.lit(v)) for v in wanted] if field in PARTIAL else [own.isin(wanted)]
        any_of = tests[0]
        for test in tests[1:]:
            any_of = any_of | test
        keep = keep & any_of
    return sources.filter(keep)


def _ascii(text: str) -> str:
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def pinned(sources: DataFrame, pins: Sequence[str]) -> DataFrame:
    """The rows of ``sources`` whose path is one of 1 to 12 pinned ones."""
    if not 1 <= len(pins) <= 12:
        raise ValueError("pin 1 to 12 sources")
    return sources.filter(F.col("path").isin(list(pins)))


def literal_phrase(phrase: str, *columns: Column | str) -> Column:
    """Whether any column holds the phrase as it stands, but for the case of A to Z."""
    found = F.lit(False)
    for c in columns:
        found = found | F.coalesce(F.contains(fold_ascii(F.col(c) if isinstance(c, str) else c), F.lit(_ascii(phrase))), F.lit(False))
    return found


def postings(records: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """``key``, ``term``, ``field``, ``tf``: how often each term stands in each field. A text index for many queries.

    Fields are expected in the form that is searched; null fields have no terms.
    """
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), words(F.coalesce(F.col(f), F.lit(""))).alias("terms")) for f in fields]))
    exploded = records.select(key, each.alias("f")).select(key, "f.field", F.explode("f.terms").alias("term"))
    return exploded.groupBy(key, "term", "field").agg(F.count("*").alias("tf"))


def bm25(records: DataFrame, key: str, queries: dict[str, Sequence[str]], weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """``query``, ``key`` and ``score`` (higher is better) of every record that has a term of a query.

    ``queries`` gives each query's terms. A field counts with its weight in the frequency of a term and fully in the length
    of the record. Corpus statistics cover all records of ``records``, whatever is filtered later. Terms that are in more
    than half of the records keep a tiny positive weight. Null fields are empty; no records give no rows.

    One pass over the texts: each record is reduced to its length and the counts of the few query terms, which are
    written down; repeated rows of a key (which are equal) count once, and are dropped only then. No text or posting is
    shuffled. The statistics are sums over the counts, joined back as a single row.
    """
    terms = sorted({t for ts in queries.values() for t in ts})
    if not terms:
        return records.select(F.lit("").alias("query"), key, F.lit(0.0).alias("score")).limit(0)
    split = records.select(key, *[words(F.coalesce(F.col(f), F.lit(""))).alias(f"w_{f}") for f in weights])
    kept = split.select(
        key,
        sum((F.size(f"w_{f}") for f in weights), F.lit(0)).alias("size"),
        *[F.filter(f"w_{f}", lambda w: w.isin(terms)).alias(f"w_{f}") for f in weights],
    )

    def often(field: str, term: str) -> Column:
        return F.size(F.filter(field, lambda w: w == F.lit(term)))

    counts = F.array(*[sum((F.lit(float(v)) * often(f"w_{f}", t) for f, v in weights.items()), F.lit(0.0)) for t in terms])
    counted = durable(kept.select(key, "size", F.when(sum((F.size(f"w_{f}") for f in weights), F.lit(0)) > 0, counts).alias("tf")).dropDuplicates([key]))
    totals = [F.count("*").alias("records"), F.avg("size").alias("mean_size"), *[F.sum(F.when(F.get("tf", F.lit(i)) > 0, 1).otherwise(0)).alias(f"df_{i}") for i in range(len(terms))]]
    corpus = counted.agg(*totals)  # one row
    joined = counted.filter("tf is not null").join(F.broadcast(corpus), F.lit(True))

    def part(i: int) -> Column:
        df = F.col(f"df_{i}")
        idf = F.greatest(F.lit(LEAST_IDF), F.log((F.col("records") - df + 0.5) / (df + 0.5)))
        tf = F.get("tf", F.lit(i))
        return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("size") / F.col("mean_size")))

    place = {t: i for i, t in enumerate(terms)}
    scores = [F.struct(F.lit(q).alias("query"), sum((part(place[t]) for t in dict.fromkeys(ts)), F.lit(0.0)).alias("score")) for q, ts in queries.items() if ts]
    return joined.select(key, F.explode(F.array(*scores)).alias("s")).select("s.query", key, "s.score").filter("score > 0")


def bm25_ranked(records: DataFrame, key: str, asked: DataFrame, weights: dict[str, float] = WEIGHTS, most: int = 5, block: int = 16384) -> DataFrame:
    """``query``, ``key``, ``score`` and ``rank`` of the ``most`` best records for each row of ``asked`` (``query``, ``terms``).

    The scores of ``bm25``, for any number of queries: terms are rows, and no query is a column. ``key`` is unique. Each
    block of records meets each block of queries (of four times as many) in a task of its own, which gives its best for
    each query; so all pairs that share a term are scored, and their number grows with records times queries.
    """

    def weighted(field: str, weight: float) -> Column:
        return F.transform(words(F.coalesce(F.col(field), F.lit(""))), lambda w: F.struct(w.alias("term"), F.lit(float(weight)).alias("n")))

    each = F.concat(*[weighted(f, n) for f, n in weights.items()])
    split = records.select(F.col(key).alias("key"), each.alias("w")).select("key", F.size("w").alias("size"), "w")
    wanted = asked.select(F.explode("terms").alias("term")).distinct()
    counts = split.select("key", "size", F.explode("w").alias("w")).groupBy("key", "size", "w.term").agg(F.sum("w.n").alias("tf"))
    counts = durable(counts.join(wanted, "term", "left_semi"))
    corpus = split.agg(F.count("*").alias("records"), F.avg("size").alias("mean_size"))  # one row
    df = counts.groupBy("term").agg(F.count("*").alias("df"))
    joined = counts.join(df, "term").join(F.broadcast(corpus), F.lit(True))
    idf = F.greatest(F.lit(LEAST_IDF), F.log((F.col("records") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("size") / F.col("mean_size")))
    asking = asked.select("query", F.array_sort(F.array_distinct("terms")).alias("terms"))
    across, down = max(1, -(-asking.count() // (4 * block))), max(1, -(-records.count() // block))
    parts = joined.select("key", "term", part.alias("part"), F.pmod(F.xxhash64("key"), F.lit(down)).alias("d"), F.explode(F.sequence(F.lit(0), F.lit(across - 1))).alias("q"))
    questions = asking.select("query", "terms", F.pmod(F.xxhash64("query"), F.lit(across)).cast("int").alias("q"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(down - 1).cast("long"))).alias("d"))

    def meet(queries: pa.Table, own: pa.Table) -> pa.Table:
        keys, place = np.unique(own.column("key").to_numpy(), return_inverse=True)
        coded = own.column("term").combine_chunks().dictionary_encode()
        code = coded.indices.to_numpy()
        by = np.argsort(code, kind="stable")
        place, value, first = place[by], own.column("part").to_numpy()[by], np.searchsorted(code[by], np.arange(len(coded.dictionary) + 1))
        at = {t: (place[a:b], value[a:b]) for t, a, b in zip(coded.dictionary.to_pylist(), first, first[1:])}
        names, found, scores = [], [], []
        for query, terms in zip(queries.column("query").to_pylist(), queries.column("terms").to_pylist()):
            score = np.zeros(len(keys))
            for term in terms:
                if term in at:
                    score[at[term][0]] += at[term][1]
            hit = np.flatnonzero(score)
            if len(hit) > most:
                hit = hit[score[hit] >= np.partition(score[hit], -most)[-most]]
            hit = hit[np.argsort(-score[hit], kind="stable")[:most]]
            names += [query] * len(hit)
            found.append(keys[hit]), scores.append(score[hit])
        cat = [np.concatenate([np.zeros(0, kind), *x]) for kind, x in ((np.int64, found), (np.float64, scores))]
        return pa.table({"query": pa.array(names, type=pa.string()), "key": cat[0], "score": cat[1]})

    best = questions.groupBy("q", "d").cogroup(parts.groupBy("q", "d")).applyInArrow(meet, "query string, key long, score double")
    return ranked(best, ["query"], "score", "key", most).withColumnRenamed("key", key)


def ranked(scores: DataFrame, by: Sequence[str], score: str, key: str, most: int, name: str = "rank") -> DataFrame:
    """The ``most`` best of each group with their rank from 1; ties go to the smaller key. Each task first keeps its own
    best, so a large group isn't moved whole."""
    order = Window.partitionBy(*by).orderBy(F.desc(score), key)
    return scores.withColumn(name, F.row_number().over(order)).filter(F.col(name) <= most)


def similar_rows(vectors: DataFrame, queries: DataFrame, key: str, vector: str, k: int, block: int = 4096) -> DataFrame:
    """``query``, ``key``, ``cosine``: exactly the ``k`` most similar rows of ``vectors`` for each row of ``queries``.

    Queries and rows are spread over blocks of about ``block`` rows; each block of queries meets each block of rows in
    a task of its own, which gives its k best for each query, and the best of those are the result. Vectors that are null or all zero aren't compared; a row is also
    compared with the query of its own key.
    """

    def usable(c: str) -> Column:
        return F.col(c).isNotNull() & F.exists(c, lambda x: x != 0)

    def search(batch: pa.Table) -> pa.Table:
        asking = np.array(batch.column("asking").to_pylist())
        ids = batch.column("id").to_numpy()
        rows = np.stack([np.asarray(v, dtype=np.float64) for v in batch.column("v").to_pylist()])
        rows /= np.linalg.norm(rows, axis=1, keepdims=True)
        q, r = np.flatnonzero(asking), np.flatnonzero(~asking)
        q, r = q[np.argsort(ids[q])], r[np.argsort(ids[r])]
        out_q, out_r, out_c = [], [], []
        for begin in range(0, len(q), 256) if len(r) else ():
            like = rows[q[begin : begin + 256]] @ rows[r].T
            top = np.argsort(-like, axis=1, kind="stable")[:, :k]
            out_q.append(np.repeat(ids[q[begin : begin + 256]], top.shape[1]))
            out_r.append(ids[r][top].reshape(-1))
            out_c.append(np.take_along_axis(like, top, axis=1).reshape(-1))
        cat = [np.concatenate(x) if x else np.zeros(0, t) for x, t in ((out_q, np.int64), (out_r, np.int64), (out_c, np.float64))]
        return pa.table({"query": cat[0], key: cat[1], "cosine": cat[2]})

    def side(df: DataFrame, asking: bool, own: int, others: int, own_name: str, other_name: str) -> DataFrame:
        own_block = F.pmod(F.xxhash64(key), F.lit(own)).alias(own_name)
        other_block = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(others - 1).cast("long"))).alias(other_name)
        return df.filter(usable(vector)).select(F.col(key).alias("id"), F.col(vector).alias("v"), F.lit(asking).alias("asking"), own_block, other_block)

    of_rows, of_queries = (max(1, -(-df.count() // block)) for df in (vectors, queries))
    rows = side(vectors, False, of_rows, of_queries, "i", "j")
    met = rows.unionByName(side(queries, True, of_queries, of_rows, "j", "i")).groupBy("i", "j").applyInArrow(search, f"query long, `{key}` long, cosine double")
    return ranked(met, ["query"], "cosine", key, k)


def cosine(vector: Column, other: Column) -> Column:
    """The cosine of two arrays, in double precision."""

    def dot(a: Column, b: Column) -> Column:
        return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)

    return dot(vector, other) / F.sqrt(dot(vector, vector) * dot(other, other))


def pooled(vectors: DataFrame, owner: str, vector: str) -> DataFrame:
    """For each owner the mean of its vectors, each first brought to length 1, and the mean again: one vector for a text of
    several windows. Vectors are expected usable and of one length; each number is a partial average, so an owner of very
    many windows is reduced before it is shuffled. A mean of nothing but zeros stays so."""

    def length(v: Column) -> Column:
        return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))

    unit = vectors.select(owner, vector, length(F.col(vector)).alias("_l")).select(owner, F.transform(vector, lambda x: F.try_divide(x.cast("double"), F.col("_l"))).alias("_v"))
    means = unit.select(owner, F.posexplode("_v").alias("_i", "_x")).groupBy(owner, "_i").agg(F.avg("_x").alias("_x"))
    whole = means.groupBy(owner).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_x"))), lambda s: s["_x"]).alias("_v"))  # as long as a vector
    return whole.withColumn("_l", length(F.col("_v"))).select(owner, F.transform("_v", lambda x: F.coalesce(F.try_divide(x, F.col("_l")), F.lit(0.0))).alias(vector))


def first_known(wanted: DataFrame, known: DataFrame, keys: Sequence[str], key: str, value: str) -> DataFrame:
    """``wanted`` with the ``value`` that ``known`` (``key``, ``value``) has for the first of several candidate ``keys``; null if
    it has none. Repeated keys of ``known`` have equal values and count once."""
    one = known.select(key, value).filter(F.col(key).isNotNull()).dropDuplicates([key])
    out = wanted
    for n, c in enumerate(keys):
        out = out.join(one.select(F.col(key).alias(f"_k{n}"), F.col(value).alias(f"_v{n}")), F.col(c) == F.col(f"_k{n}"), "left")
    found = F.coalesce(*[F.col(f"_v{n}") for n in range(len(keys))])
    return out.withColumn(value, found).drop(*[f"_{x}{n}" for n in range(len(keys)) for x in "kv"])


def best_windows(scored: DataFrame, owner: str, score: str, place: str, *columns: str) -> DataFrame:
    """For each owner its best window: the greatest score, and of equals the first place."""
    best = F.max_by(F.struct(*[F.col(c) for c in (score, place, *columns)]), F.struct(F.col(score), -F.col(place))).alias("best")
    return scored.groupBy(owner).agg(best).select(owner, "best.*")


def fused(lexical: DataFrame, semantic: DataFrame, key: str) -> DataFrame:
    """``key`` and ``score``: the sum of 1 / (60 + rank) over the lists (``key``, ``rank``) that have it."""
    left, right = lexical.select(key, F.col("rank").alias("lexical_rank")), semantic.select(key, F.col("rank").alias("semantic_rank"))

    def points(rank: str) -> Column:
        return F.coalesce(1 / (FUSION + F.col(rank)), F.lit(0.0))

    return left.join(right, key, "full").withColumn("score", points("lexical_rank") + points("semantic_rank"))


def diversified(hits: DataFrame, key: str, document: str, locator: Sequence[str], document_size: str, k: int) -> DataFrame:
    """The ``k`` best hits: one for each place of a document, and few of a document before others have had their turn.

    A document gives at most one hit at first if it has more than 200 chunks, otherwise max(2, (k + 2) // 3); further
    ones fill what is left. Ties go to the smaller key.
    """
    order = [F.desc("score"), F.col(key)]
    first = F.row_number().over(Window.partitionBy(document, *locator).orderBy(*order))
    once = hits.withColumn("_place", first).filter("_place = 1").drop("_place")
    turn = F.row_number().over(Window.partitionBy(document).orderBy(*order))
    cap = F.when(F.col(document_size) > 200, 1).otherwise(max(2, (k + 2) // 3))
    return once.withColumn("_later", (turn > cap).cast("int")).orderBy("_later", *order).limit(k).drop("_later")


def site_fusion(lists: DataFrame, key: str, path: str, k: int = 6) -> DataFrame:
    """Hits of several ranked lists (``list``, ``rank`` from 0, ``weight``) fused: more lists first, then the sum of
    weight / (rank + 5); at most two of a path, ``k`` in all."""
    near = lists.filter("rank < 40").groupBy(key, path).agg(F.sum(F.col("weight") / (F.col("rank") + 5)).alias("score"), F.count("*").alias("hits"))
    order = [F.desc("hits"), F.desc("score"), F.col(key)]
    turn = F.row_number().over(Window.partitionBy(path).orderBy(*order))
    return near.orderBy(*order).limit(40).withColumn("_turn", turn).filter("_turn <= 2").drop("_turn").orderBy(*order).limit(k)


def citation(path: Column, kind: Column, value: Column) -> Column:
    """``name · unit value``."""
    return F.concat(paths.name(path), F.lit(" · "), F.coalesce(paths.lookup(kind, UNITS), kind), F.lit(" "), F.coalesce(value, F.lit("")))


def related_versions(sources: DataFrame) -> DataFrame:
    """For each path the other documents' paths of its version family. A row without a family is related to none."""
    one = sources.select("path", "document_id", "version_family").filter("version_family is not null").distinct()
    other = one.select(F.col("path").alias("related_path"), F.col("document_id").alias("related_document_id"), "version_family")
    return one.join(other, "version_family").filter("document_id <> related_document_id")


def facets(sources: DataFrame, searchable: DataFrame, fields: Sequence[str] = FILTERS) -> DataFrame:
    """For each field and value: how many documents have it, and how many of them have a chunk. One pass for all fields."""
    flagged = sources.join(searchable.select("document_id").distinct().withColumn("_found", F.lit(True)), "document_id", "left")
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields]))
    rows = flagged.select("document_id", "_found", each.alias("f")).select("document_id", "_found", "f.*").filter("value is not null and value <> ''")
    return rows.groupBy("field", "value").agg(F.count_distinct("document_id").alias("documents"), F.count_distinct(F.when(F.col("_found"), F.col("document_id"))).alias("searchable_documents"))


def alias_texts(sources: DataFrame) -> DataFrame:
    """``document_id``, ``title`` and ``context``: names and metadata of all paths of a document, in order of the path."""
    context = F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in ("course", "course_label", "term", "content_type", "lecturer", "folder")])
    rows = sources.select("document_id", F.struct("path", paths.name(F.col("path")).alias("name"), context.alias("context")).alias("a")).distinct()
    gathered = rows.groupBy("document_id").agg(F.array_sort(F.collect_list("a")).alias("aliases"))
    return gathered.select(
        "document_id", F.array_join(F.transform("aliases", lambda a: a["name"]), " ").alias("title"), F.array_join(F.transform("aliases", lambda a: a["context"]), " ").alias("context")
    )
