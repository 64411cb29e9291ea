import pytest
from pyspark.sql import functions as F

from lectern.functions.text import search_form
from lectern.operators import search, stored_index

WEIGHTS = {"title": 4.0, "text": 1.0}


def records(spark, *more):
    rows = [(1, "alpha beta", "the gamma alpha", "x"), (2, None, "beta beta", "y"), (3, "delta", None, "x"), (4, "", "", "z"), (1, "alpha beta", "the gamma alpha", "x"), *more]
    return spark.createDataFrame(rows, "k long, title string, text string, place string")


def test_scores_are_those_of_one_pass(spark, tmp_path):
    df, queries = records(spark), {"a": ["alpha", "beta"], "b": ["delta", "unknown"], "none": []}
    index = stored_index.tables(df, "k", ["title", "text"], ["place"])
    got = {(r["query"], r.k): round(r.score, 9) for r in stored_index.bm25(index, "k", queries, WEIGHTS).collect()}
    want = {(r["query"], r.k): round(r.score, 9) for r in search.bm25(df, "k", queries, WEIGHTS).collect()}
    assert got == want and len(got) == 3
    some = stored_index.bm25(index, "k", queries, WEIGHTS, df.filter("place = 'y'").select("k"))
    assert [(r["query"], r.k) for r in some.collect()] == [("a", 2)]
    assert {r.k: r.place for r in index["places"].collect()} == {1: "x", 2: "y", 3: "x", 4: "z"}
    empty = stored_index.tables(df.limit(0), "k", ["title", "text"], ["place"])
    assert stored_index.bm25(empty, "k", queries, WEIGHTS).count() == 0


def test_an_index_is_made_once_and_again_when_its_source_changes(spark, tmp_path):
    source, root, made = str(tmp_path / "t"), str(tmp_path / "index"), []
    records(spark).write.parquet(source)

    def make():
        made.append(1)
        return stored_index.tables(spark.read.parquet(source), "k", ["title", "text"], ["place"])

    for _ in range(2):
        assert stored_index.fresh(spark, root, source, make)["places"].count() == 4
    assert len(made) == 1
    records(spark, (9, "new", "new", "w")).write.mode("append").parquet(source)
    index = stored_index.fresh(spark, root, source, make)
    assert len(made) == 2 and index["places"].count() == 5
    plan = stored_index.bm25(index, "k", {"q": ["new"]}, WEIGHTS)
    assert [r.k for r in plan.collect()] == [9] and "PartitionFilters: [isnotnull(bucket" in plan._jdf.queryExecution().toString()


@pytest.mark.parametrize("text, form", [("Café_au-lait", "cafe au lait"), ("β–test", " beta  test"), ("PLAIN/text", "plain text"), ("𝑘² ß", "k2 ss"), (None, None), ("", "")])
def test_search_form(spark, text, form):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(search_form(F.col("t"))).first()[0] == form


def test_first_known_key(spark):
    wanted = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "z"), (None, "y")], "k1 string, k2 string")
    known = spark.createDataFrame([("a", 1), ("x", 2), ("y", 3), ("y", 3), (None, 9)], "key string, v int")
    assert {(r.k1, r.k2): r.v for r in search.first_known(wanted, known, ["k1", "k2"], "key", "v").collect()} == {("a", "x"): 1, ("b", "y"): 3, ("c", "z"): None, (None, "y"): 3}
