from lectern.plans import text_queries


def test_long_titles_count_whole(spark, tmp_path):
    spark.createDataFrame([(1, " ".join(f"word{i}" for i in range(40)))], "doc_id long, title string").write.parquet(f"{tmp_path}/documents.parquet")
    assert text_queries.search_form(spark, str(tmp_path)).count() == 40
