from lectern.operators import search
from lectern.plans import table_queries, text_queries

from pyspark.sql import functions as F

FOLDER = "/root/testdata/sf0.001"


def test_many_questions_score_as_few(spark):
    rows = text_queries.documents(spark, FOLDER).select("doc_id", F.lower("title").alias("title"), F.lower("text").alias("text"))
    asked = {"a": ["introduction", "practice", "nowhere"], "b": ["market", "under"], "c": []}
    weights = {"title": 4.0, "text": 1.0}
    few = search.ranked(search.bm25(rows, "doc_id", asked, weights), ["query"], "score", "doc_id", 5)
    many = search.bm25_ranked(rows, "doc_id", spark.createDataFrame(list(asked.items()), "query string, terms array<string>"), weights, 5, block=13)
    found = [{(r.query, r["rank"]): (r.doc_id, round(r.score, 9)) for r in df.collect()} for df in (few, many)]
    assert found[0] == found[1] and len(found[0]) > 5


def test_titles_of_every_twentieth_document_are_asked(spark):
    asked = text_queries.documents(spark, FOLDER).filter("title is not null and doc_id % 20 = 0").select(F.lower("title")).distinct().count()
    assert table_queries.self_retrieval(spark, FOLDER).count() == asked > 2
