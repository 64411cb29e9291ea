import os

from lectern.session import clean_up, durable, release


def test_durable_tables_are_kept_until_released(spark):
    df = durable(spark.range(100).selectExpr("id % 7 as k", "array(id, null) as l").groupBy("k").agg({"l": "max"}))
    empty = durable(spark.range(0).selectExpr("id", "cast(null as binary) as b"))
    assert df.count() == 7 and df.columns == ["k", "max(l)"] and empty.count() == 0 and empty.columns == ["id", "b"]
    place = df.durable_place.removeprefix("file:")
    assert os.path.isdir(place)
    release(df)
    assert not os.path.exists(place)
    clean_up(spark)
    assert not os.path.exists(os.path.dirname(place))
