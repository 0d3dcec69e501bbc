import datetime as dt

import pytest
from conftest import rows
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from driftline.operators import aggregate, joins, reshape


@pytest.mark.parametrize("how", ["left", "inner"])
def test_attach(spark, how):
    data = spark.createDataFrame([("a", 1), ("a", 2), (None, 3), ("z", 4)], "k string, v int")
    table = spark.createDataFrame([("a", 10.0), (None, 20.0)], "k string, m double")
    got = joins.attach(data, table, ["k"], how)
    want = [("a", 1, 10.0), ("a", 2, 10.0), (None, 3, 20.0)] + ([("z", 4, None)] if how == "left" else [])
    assert [tuple(r.values()) for r in rows(got, "v")] == want
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Cartesian" not in plan and "broadcast" not in plan


def test_attach_after_an_aggregate_of_the_same_rows(spark):
    data = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 5.0)], "k string, v double")
    got = joins.attach(data, data.groupBy("k").agg(F.avg("v").alias("m")), ["k"])
    assert [r["m"] for r in rows(got, "v")] == [2.0, 2.0, 5.0]


def test_one_row_table(spark):
    data = spark.createDataFrame([(1,), (2,)], "v int")
    got = joins.attach(data, data.agg(F.max("v").alias("hi")), [])
    assert [(r["v"], r["hi"]) for r in rows(got, "v")] == [(1, 2), (2, 2)]


def test_suffixes(spark):
    a = spark.createDataFrame([("x", 1.0, 5)], "k string, mean double, only int")
    b = spark.createDataFrame([("x", 2.0)], "k string, mean double")
    got = joins.suffixed_left_join(a, b, ["k"])
    assert got.columns == ["k", "mean.x", "only", "mean.y"] and tuple(got.first()) == ("x", 1.0, 5, 2.0)


def test_weather_join(spark):
    weather = spark.createDataFrame(
        [(dt.datetime(2020, 1, 1, h), float(h)) for h in (0, 12)] + [(dt.datetime(2020, 1, 2, 5), None)],
        "datetime timestamp_ntz, station_temp double")
    days = spark.createDataFrame([(dt.date(2020, 1, d),) for d in (1, 2, 3)], "date date")
    got = rows(joins.weather_join(weather, days, predictor="mean_150"), "date")
    assert [(r["station_temp"], r["mean_150"]) for r in got] == [(6.0, 6.0), (None, None), (None, None)]
    daily = rows(joins.daily_weather(weather), "date")
    assert (daily[0]["station_temp_min"], daily[0]["station_temp_max"], daily[0]["station_temp_n"]) == (0.0, 12.0, 2)


def test_long_and_wide(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0), (2, None, 4.0)], "k int, a double, b double")
    long = reshape.to_long(df, ["k"], ["a", "b"])
    assert rows(reshape.to_wide(long, ["k"], "variable", ["value"], ["a", "b"]), "k") == rows(df, "k")
    two = reshape.to_wide(long.withColumn("w", F.col("value") * 2), ["k"], "variable", ["value", "w"], ["a", "b"])
    assert two.columns == ["k", "value_a", "value_b", "w_a", "w_b"] and rows(two, "k")[0]["w_b"] == 4.0
    twice = long.unionByName(long)
    with pytest.raises(PySparkException):
        reshape.to_wide(twice, ["k"], "variable", ["value"], ["a", "b"]).collect()
    assert rows(reshape.to_wide(twice, ["k"], "variable", ["value"], ["a", "b"], "mean"), "k") == rows(df, "k")


def test_columns(spark):
    df = spark.createDataFrame([], "YEAR int, mlk_temp_150_avg double, mlk_hum_150 double, rlk_temp_0_max double, rlk_temp_neg150_max double")
    assert reshape.pick(df, matches="150", without="neg150|hum") == ["mlk_temp_150_avg"]
    assert reshape.pick(df, contains=["rlk", "temp"], ends="max") == ["rlk_temp_0_max", "rlk_temp_neg150_max"]
    assert reshape.between(df, "mlk_hum_150", "rlk_temp_0_max") == ["mlk_hum_150", "rlk_temp_0_max"]
    assert reshape.between(df, "rlk_temp_0_max")[-1] == "rlk_temp_neg150_max"


def test_other_shapes(spark):
    df = spark.createDataFrame([("a_1", [1, 2], [3, 4]), ("b", [5], [6])], "s string, x array<int>, y array<int>")
    assert [(r["x"], r["y"]) for r in rows(reshape.unnest(df, ["x", "y"]), "x")] == [(1, 3), (2, 4), (5, 6)]
    parts = rows(reshape.separate(df, "s", ["site", "type"]), "site")
    assert [(r["site"], r["type"]) for r in parts] == [("a", "1"), ("b", None)]
    assert reshape.with_extra_label(df.select("s"), "s", "all").count() == 4
    assert reshape.stack(df.select("s"), df.select("x")).columns == ["s", "x"]
    change = spark.createDataFrame([("g", "early", 1.0), ("g", "late", 3.0), ("h", "late", 1.0), ("g", None, 99.0)], "k string, p string, v double")
    got = reshape.early_to_late(change, ["k"], "p", "early", "late", ["v"]).collect()
    assert [tuple(r) for r in got] == [("g", 1.0, 3.0)]


def test_history(spark):
    df = spark.createDataFrame([("a", 2020, 2.0), ("a", 2021, 3.0), ("b", 2020, 1.0)], "k string, y int, v double")
    got = rows(aggregate.against_history(df, ["k"], "v", F.col("y") == 2021), "k")
    assert got == [{"k": "a", "history": 2.0, "current": 3.0, "percent_diff": 50.0}, {"k": "b", "history": 1.0, "current": None, "percent_diff": None}]
    assert aggregate.levels(df, "k").collect()[0].k == "a" and aggregate.distinct_rows(df, ["k"]).count() == 2


def test_pooled_mean_is_not_a_mean_of_means(spark):
    df = spark.createDataFrame([(1.0, 2.0), (None, 6.0)], "a double, b double")
    assert df.agg(aggregate.pooled_mean(["a", "b"])).first()[0] == 3.0
    assert df.filter("false").agg(aggregate.pooled_mean(["a", "b"])).first()[0] is None
