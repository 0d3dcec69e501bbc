import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from driftline.functions import calendar, missing, tails, text
from driftline.operators.reshape import bins, ordered_labels, recode


def one(spark, expr, schema="x double", values=((None,),)):
    return [r[0] for r in spark.createDataFrame(list(values), schema).select(expr).collect()]


def test_nan_becomes_null_and_infinity_on_request(spark):
    df = spark.createDataFrame([(float("nan"), 1), (float("inf"), 2), (2.0, 3)], "x double, k int")
    assert [r["x"] for r in missing.clean_missing(df).orderBy("k").collect()] == [None, float("inf"), 2.0]
    assert [r[0] for r in df.orderBy("k").select(missing.nan_to_null(F.col("x"), infinite=True)).collect()] == [None, None, 2.0]


def test_null_condition_gives_null(spark):
    got = one(spark, missing.if_else(F.col("x") > 1, "a", "b"), values=[(None,), (0.0,), (2.0,)])
    assert got == [None, "b", "a"]


def test_bounds_keep_null(spark):
    assert one(spark, missing.floor_at(F.col("x"), 0.0), values=[(None,), (-1.0,), (2.0,)]) == [None, 0.0, 2.0]
    assert one(spark, missing.cap_at(F.col("x"), 1.0), values=[(None,), (-1.0,), (2.0,)]) == [None, -1.0, 1.0]


def test_membership_of_null(spark):
    assert one(spark, missing.is_in(F.col("x"), [1.0]), values=[(None,), (1.0,)]) == [None, True]
    assert one(spark, missing.is_in(F.col("x"), [1.0], null_is_false=True), values=[(None,), (1.0,)]) == [False, True]


def test_numbers_out_of_text(spark):
    got = one(spark, missing.to_number(F.col("x")), "x string", [("1.5",), (" 2 ",), ("NA",), ("1,2",), ("NaN",), (None,)])
    assert got == [1.5, 2.0, None, None, None, None]


def test_row_mean_skips_null(spark):
    df = spark.createDataFrame([(1.0, 3.0), (None, 3.0), (None, None)], "a double, b double")
    assert [r[0] for r in df.select(missing.row_mean([F.col("a"), F.col("b")])).collect()] == [2.0, 3.0, None]


def test_percent_difference_of_zero_base(spark):
    assert one(spark, missing.percent_difference(F.col("x"), F.lit(0.0)), values=[(1.0,)]) == [None]


@pytest.mark.parametrize("mean,now,want", [(17.6, 31.8, 80.7), (41.6, 45.0, 8.2), (9.03, 7.52, -16.7)])
def test_percent_difference(spark, mean, now, want):
    got = one(spark, missing.percent_difference(F.lit(now), F.lit(mean)))[0]
    assert abs(got - want) < 0.05


def test_rounding(spark):
    assert one(spark, missing.round_even(F.col("x"), 0), values=[(0.5,), (1.5,), (2.5,)]) == [0.0, 2.0, 2.0]
    got = one(spark, missing.signif(F.col("x"), 3), values=[(0.00123456,), (123456.0,), (0.0,), (-9.999,), (None,)])
    assert got[:2] == pytest.approx([0.00123, 123000.0]) and got[2:] == [0.0, -10.0, None]


def test_seasons(spark):
    months = [(m,) for m in (1, 6, 9, 10, None)]
    assert one(spark, calendar.season(F.col("m")), "m int", months) == ["cool", "warm", "warm", "cool", None]
    assert one(spark, calendar.season(F.col("m"), {"warm": (6, 7)}, other="cool"), "m int", months) == [
        "cool", "warm", "cool", "cool", "cool"]


def test_season_year(spark):
    days = [(dt.date(2010, 9, 30),), (dt.date(2010, 10, 1),), (dt.date(2011, 1, 1),), (None,)]
    assert one(spark, calendar.season_year(F.col("d")), "d date", days) == [2010, 2011, 2011, None]


def test_dates(spark):
    got = one(spark, calendar.parse_date(F.col("s")), "s string",
              [("2010-03-04",), ("20100304",), ("2010/3/4",), ("2010-3-4",), ("x",), (None,), ("2010-13-04",)])
    assert got == [dt.date(2010, 3, 4)] * 4 + [None, None, None]
    assert one(spark, calendar.compact_date(F.col("d")), "d date", [(dt.date(2010, 3, 4),)]) == ["20100304"]


def test_series_names(spark):
    df = spark.createDataFrame([("abc_temp_2p5_avg",), ("abc_temp_150_max",), ("abc_temp_0_min",), ("plain",)], "n string")
    n = F.col("n")
    got = df.select(text.name_site(n), text.name_depth(n), text.name_stat(n), text.signed_depth(text.name_depth(n))).collect()
    assert [tuple(r) for r in got] == [
        ("abc", 2.5, "avg", -2.5), ("abc", 150.0, "max", 150.0), ("abc", 0.0, "min", 0.0), ("pla", None, "plain", None)]


def test_labelled_text(spark):
    got = one(spark, text.labelled_text({"Place": F.lit("A"), "Rise": F.bround(F.lit(1.23456), 3)}))[0]
    assert got == "<b>Place:</b> A<br><b>Rise:</b> 1.235"
    assert one(spark, text.labelled_text({"a": F.lit(1), "b": F.lit(None)}, " ", ("", "")))[0] is None


def test_depth_decimals(spark):
    df = spark.createDataFrame([("abc_temp_2p25_avg",), ("abc_temp_12p7_max",)], "n string")
    assert [r[0] for r in df.select(text.name_depth(F.col("n"))).collect()] == [2.25, 12.7]


def test_recode_and_bins(spark):
    df = spark.createDataFrame([("a", 2006), ("b", 2015), ("z", 2030), (None, None)], "s string, y int")
    m = {"a": "A", "b": "A"}
    assert [r.s for r in recode(df, "s", m).collect()] == ["A", "A", "z", None]
    table = spark.createDataFrame(list(m.items()), "from string, to string")
    assert sorted([str(r.t) for r in recode(df, "s", table, "t", keep_unmatched=False).collect()]) == ["A", "A", "None", "None"]
    got = df.select(bins(F.col("y"), [(2006, 2015, "early"), (2016, 2024, "late")]).alias("p")).collect()
    assert [r.p for r in got] == ["early", "early", None, None]
    o = ordered_labels(df, "s", {"b": "Second", "a": "First"}, ["First", "Second"]).collect()
    assert [(r.s, r.s_ord) for r in o] == [("First", 1), ("Second", 2), ("z", None), (None, None)]


# --- tails -------------------------------------------------------------------------------------

# Printed statistics (t, df, p) of published tests.
T_GOLDENS = [(-3.3377, 42.596, 0.001761), (3.6751, 44.703, 0.000634), (-4.668, 67.03, 1.506e-05),
             (-1.5322, 1611.0, 0.1257), (2.2651, 37.458, 0.02938)]


@pytest.mark.parametrize("t,df,p", T_GOLDENS)
def test_t_goldens(spark, t, df, p):
    got = one(spark, tails.t_two_sided(F.lit(t), F.lit(df)))[0]
    assert float(f"{got:.{len(str(p).replace('0.', '').lstrip('0')) if 'e' not in str(p) else 4}g}") == pytest.approx(p, rel=2e-4)


def test_t_closed_forms(spark):
    df = spark.createDataFrame([(0.1,), (1.0,), (7.5,), (60.0,), (0.0,)], "t double")
    t = F.col("t")
    for r in df.select("t", tails.t_two_sided(t, F.lit(1.0)).alias("p1"), tails.t_two_sided(t, F.lit(2.0)).alias("p2"),
                       tails.t_two_sided(t, F.lit(4.0)).alias("p4"), tails.t_two_sided(t, F.lit(1e9)).alias("pn")).collect():
        assert r.p1 == pytest.approx(1 - 2 / math.pi * math.atan(r.t), abs=1e-12, rel=1e-8)
        s = r.t / math.sqrt(2 + r.t**2)
        assert r.p2 == pytest.approx(1 - s, abs=1e-10, rel=1e-7)
        u = r.t / math.sqrt(4 + r.t**2)
        assert r.p4 == pytest.approx(1 - 1.5 * (u - u**3 / 3), abs=1e-9, rel=1e-4)
        assert r.pn == pytest.approx(math.erfc(r.t / math.sqrt(2)), rel=1e-5, abs=1e-300)


def test_t_far_tail_and_missing(spark):
    got = one(spark, tails.t_two_sided(F.col("x"), F.lit(73.336)), values=[(-26.55,), (None,)])
    assert 0 < got[0] < 2.2e-16 and got[1] is None
    assert one(spark, tails.t_two_sided(F.lit(1.0), F.lit(None).cast("double"))) == [None]


def test_f_closed_form(spark):
    df = spark.createDataFrame([(f, d) for f in (0.0, 0.05, 0.7, 1.0, 4.0, 90.0) for d in (1, 3, 50, 20000)], "f double, d int")
    for r in df.select("f", "d", tails.f_two_sided(F.col("f"), F.lit(2), F.col("d")).alias("p")).collect():
        upper = (1 + 2 * r.f / r.d) ** (-r.d / 2)
        assert r.p == pytest.approx(2 * min(upper, 1 - upper), rel=1e-6, abs=1e-12)


def test_f_is_symmetric(spark):
    df = spark.createDataFrame([(1.7, 9, 30), (0.2, 1, 5), (1.0, 1, 1), (1.05, 900, 1200)], "f double, a int, b int")
    for r in df.select(tails.f_two_sided(F.col("f"), F.col("a"), F.col("b")).alias("p"),
                       tails.f_two_sided(1 / F.col("f"), F.col("b"), F.col("a")).alias("q")).collect():
        assert r.p == pytest.approx(r.q, rel=1e-7) and 0 < r.p <= 1
