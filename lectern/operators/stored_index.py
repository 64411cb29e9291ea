"""A stored text index: postings by term, so that a question reads its own terms and no text.

Postings lie in folders by a hash of the term (``bucket``), so a query for a few terms prunes all other folders and pushes
the terms down to what is left. The index is a generation (see ``sources.sinks``): it appears whole, with a mark of the
files it was made from, and is made anew when those have changed.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.text import words
from lectern.operators.search import B, K1, LEAST_IDF
from lectern.sources.sinks import open_generation, publish_generation

BUCKETS = 64
#: Raised with every change of what the tables hold, so that no index of another layout is read.
LAYOUT = 2


def tables(records: DataFrame, key: str, fields: Sequence[str], places: Sequence[str]) -> dict[str, DataFrame]:
    """The tables of an index over ``records``: ``postings`` (``term``, ``key``, how often it stands in each field, and the
    record's size in each), ``places`` (``key`` and the named columns, once a record) and ``corpus`` (one row: records, and
    words in each field).

    Fields come in the form that is searched; null ones have no words. Rows of a key that come again are equal and count
    once. Each row is counted by itself, then the greatest count of a key's rows is taken: texts are never shuffled.
    """
    rows = records.withColumn("_row", F.monotonically_increasing_id())
    split = rows.select(key, "_row", *[words(F.coalesce(F.col(f), F.lit(""))).alias(f"w_{f}") for f in fields])
    sized = split.select(key, "_row", *[f"w_{f}" for f in fields], *[F.size(f"w_{f}").alias(f"size_{f}") for f in fields])
    sizes = [f"size_{f}" for f in fields]

    def of_field(field: str, number: int) -> Column:
        return F.transform(f"w_{field}", lambda w: F.struct(w.alias("term"), F.lit(number).alias("field")))

    each = F.concat(*[of_field(f, i) for i, f in enumerate(fields)])
    terms = sized.select(key, "_row", *sizes, F.explode(each).alias("w"))
    counted = terms.groupBy(key, "_row", "w.term", *sizes).agg(*[F.count_if(F.col("w.field") == i).cast("int").alias(f) for i, f in enumerate(fields)])
    postings = counted.groupBy(key, "term").agg(*[F.max(c).alias(c) for c in (*fields, *sizes)])
    lengths = sized.groupBy(key).agg(*[F.max(s).alias(s) for s in sizes])
    corpus = lengths.agg(F.count("*").alias("records"), *[F.sum(s).alias(s) for s in sizes])
    return {
        "postings": postings.withColumn("bucket", _bucket(F.col("term"))).repartition("bucket", F.pmod(F.xxhash64(key), F.lit(16))).sortWithinPartitions("bucket", "term"),
        "places": records.select(key, *places).dropDuplicates([key]),
        "corpus": corpus,
    }


def _of_field(field: str, number: int) -> Column:
    return F.transform(f"w_{field}", lambda w: F.struct(w.alias("term"), F.lit(number).alias("field")))


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def marks(spark: SparkSession, path: str) -> list[list]:
    """The files below ``path`` with their sizes and times, by which a change is noticed."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted([f.getPath().getName(), f.getLen(), f.getModificationTime()] for f in system.listStatus(where))


def fresh(spark: SparkSession, root: str, source: str, make: Callable[[], dict[str, DataFrame]]) -> dict[str, DataFrame]:
    """The tables of the index below ``root``, made by ``make`` if there is none or ``source`` isn't what it was made from."""
    mark = [LAYOUT, marks(spark, source)]
    try:
        report, found = open_generation(spark, root)
        if report.get("mark") == mark:
            return found
    except Exception as problem:  # no index yet
        if "PATH_NOT_FOUND" not in str(problem):
            raise
    publish_generation(spark, root, make(), partition_by={"postings": ["bucket"]}, more={"mark": mark})
    return open_generation(spark, root)[1]


def bm25(index: dict[str, DataFrame], key: str, queries: dict[str, Sequence[str]], weights: dict[str, float], eligible: DataFrame | None = None) -> DataFrame:
    """``query``, ``key`` and ``score`` (higher is better) of every record, or ``eligible`` one, that has a term of a query.

    The scores of ``search.bm25`` over the whole corpus: filters take records away after the statistics. A term is
    counted where a field of ``weights`` has it; the other fields don't count for a record's length either. Queries
    without terms find nothing.
    """
    spark = index["postings"].sparkSession
    terms = sorted({t for ts in queries.values() for t in ts})
    asked = spark.createDataFrame([(q, t) for q, ts in queries.items() for t in dict.fromkeys(ts)], "query string, term string")  # as small as the questions
    buckets = [r[0] for r in asked.select(_bucket(F.col("term"))).distinct().collect()]
    tf = sum((F.lit(float(w)) * F.col(f) for f, w in weights.items()), F.lit(0.0))
    size = sum((F.col(f"size_{f}") for f in weights), F.lit(0))
    own = index["postings"].filter(F.col("bucket").isin(buckets) & F.col("term").isin(terms)).select(key, "term", tf.alias("tf"), size.alias("size")).filter("tf > 0")
    corpus = index["corpus"].select("records", (size / F.col("records")).alias("mean_size"))  # one row
    df = own.groupBy("term").agg(F.count("*").alias("df"))  # a row for each term asked for
    if eligible is not None:
        own = own.join(eligible.select(key), key, "left_semi")
    scored = own.join(F.broadcast(df), "term").join(F.broadcast(corpus), F.lit(True))
    idf = F.greatest(F.lit(LEAST_IDF), F.log((F.col("records") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("size") / F.col("mean_size")))
    return scored.select(key, "term", part.alias("part")).join(F.broadcast(asked), "term").groupBy("query", key).agg(F.sum("part").alias("score")).filter("score > 0")
