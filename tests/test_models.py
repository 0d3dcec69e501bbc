"""Trends, two-sample tests, regressions and gap filling against numpy."""

import math

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from driftline.operators import anomaly, gapfill, ranking, twosample
from driftline.operators import trend as tr
from driftline.operators.cleaning import Clamp, clamp_columns
from driftline.operators.gapfill import INTERCEPT, Model


# --- trends ------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def yearly(spark):
    rng = np.random.default_rng(1)
    data = [("noise", y, float(3 + 0.2 * (y - 2000) + rng.normal())) for y in range(2000, 2020)]
    data += [("exact", y, 2.0 * y - 1) for y in range(2000, 2006)]
    data += [("two", 2000, 1.0), ("two", 2001, 4.0), ("one", 2000, 1.0), ("flat", 2000, 1.0), ("flat", 2000, 2.0), ("flat", 2000, 4.0)]
    data += [("none", 2000, None), ("constant", 2000, 5.0), ("constant", 2001, 5.0), ("constant", 2003, 5.0), (None, 1, 1.0), (None, 2, 2.5), (None, 3, 2.0)]
    return spark.createDataFrame(data, "g string, year int, v double"), data


def test_fit_against_numpy(yearly):
    df, data = yearly
    got = {r["g"]: r for r in rows(tr.fit_trend(df, ["g"], "year", "v"), "g")}
    for g in ("noise", None):
        x = np.array([float(y) for k, y, _ in data if k == g])
        v = np.array([z for k, _, z in data if k == g])
        m = np.stack([np.ones_like(x), x - x.mean()], 1)
        beta, rss, *_ = np.linalg.lstsq(m, v, rcond=None)
        se = math.sqrt(rss[0] / (len(x) - 2) / ((x - x.mean()) ** 2).sum())
        r = got[g]
        assert (r["n"], r["df"]) == (len(x), len(x) - 2)
        assert r["slope"] == pytest.approx(beta[1]) and r["intercept"] == pytest.approx(beta[0] - beta[1] * x.mean())
        assert r["se"] == pytest.approx(se) and r["t"] == pytest.approx(beta[1] / se)
        assert r["rss"] == pytest.approx(rss[0])


def test_fit_edges(yearly):
    df, _ = yearly
    got = {r["g"]: r for r in rows(tr.fit_trend(df, ["g"], "year", "v"), "g")}
    assert got["exact"]["slope"] == pytest.approx(2) and got["exact"]["se"] == pytest.approx(0, abs=1e-9)
    assert got["exact"]["p_value"] == pytest.approx(0, abs=1e-9)
    assert got["two"]["slope"] == pytest.approx(3) and got["two"]["se"] is None and got["two"]["p_value"] is None
    for g in ("one", "flat", "none"):
        assert got[g]["slope"] is None and got[g]["p_value"] is None
    assert got["none"]["n"] == 0 and got["constant"]["slope"] == pytest.approx(0)


def test_interval_fdr_and_lines(yearly):
    df, _ = yearly
    fits = tr.add_fdr(tr.add_interval(tr.fit_trend(df, ["g"], "year", "v")))
    got = {r["g"]: r for r in rows(fits, "g")}
    r = got["noise"]
    assert r["ci_upper"] - r["ci_lower"] == pytest.approx(2 * 1.96 * r["se"])
    assert r["sig_ci"] == ("Yes" if r["ci_lower"] > 0 else "No") and got["one"]["sig_ci"] is None and got["one"]["sig_fdr"] is None
    lines = tr.fitted_lines(df, tr.significant(fits), ["g"], "year").filter("g = 'exact'")
    assert [x["mean_pred"] for x in rows(lines, "year")] == pytest.approx([2.0 * y - 1 for y in range(2000, 2006)])


def test_residuals(yearly):
    df, data = yearly
    fits = tr.fit_trend(df.filter("g = 'noise'"), ["g"], "year", "v")
    got = rows(tr.residuals(df, fits, ["g"], "year", "v"), "year")
    x = np.array([y for k, y, _ in data if k == "noise"], float)
    v = np.array([z for k, _, z in data if k == "noise"])
    m = np.stack([np.ones_like(x), x], 1)
    hat = np.diag(m @ np.linalg.inv(m.T @ m) @ m.T)
    res = v - m @ np.linalg.lstsq(m, v, rcond=None)[0]
    s2 = (res**2).sum() / (len(x) - 2)
    for j, r in enumerate(got):
        assert r["resid"] == pytest.approx(res[j], abs=1e-6) and r["hat"] == pytest.approx(hat[j], rel=1e-5)
        assert r["std_resid"] == pytest.approx(res[j] / math.sqrt(s2 * (1 - hat[j])), abs=1e-5)
        assert r["cooksd"] == pytest.approx(res[j] ** 2 / (2 * s2) * hat[j] / (1 - hat[j]) ** 2, abs=1e-5)
        left_out = np.delete(np.arange(len(x)), j)
        b = np.linalg.lstsq(m[left_out], v[left_out], rcond=None)[0]
        s_i = math.sqrt(((v[left_out] - m[left_out] @ b) ** 2).sum() / (len(x) - 3))
        assert r["sigma_without"] == pytest.approx(s_i, rel=1e-5)


def test_drop_edges(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("a", 3), ("b", 1), ("c", 2), ("c", 3)], "g string, y int")
    assert [(r["g"], r["y"]) for r in rows(ranking.drop_edges(df, "y", ["g"], True, True), "g", "y")] == [("a", 2)]
    assert [(r["g"], r["y"]) for r in rows(ranking.drop_edges(df, "y", first=True), "g", "y")] == [("a", 2), ("a", 3), ("c", 2), ("c", 3)]


def test_scaling(spark):
    df = spark.createDataFrame([(1.0, 7.0), (3.0, 7.0), (None, 7.0)], "x double, c double")
    z = ranking.zscores(df, ["x", "c"]).collect()
    assert [r.x for r in z] == pytest.approx([-1 / math.sqrt(2), 1 / math.sqrt(2), None]) and all(r.c is None for r in z)
    assert [r.s for r in ranking.rescale(df, F.col("x"), "s", 4, 10).collect()] == [4.0, 10.0, None]
    assert [r.s for r in ranking.rescale(df, F.col("c"), "s", 4, 10).collect()] == [7.0, 7.0, 7.0]


# --- two samples -------------------------------------------------------------------------------


def test_two_samples(spark):
    rng = np.random.default_rng(5)
    data = [("a", 2020, float(v)) for v in rng.normal(0, 1, 30)] + [("a", 2021, float(v)) for v in rng.normal(6, 4, 12)]
    data += [("b", 2020, float(v)) for v in (1, 2, 3, 4)] + [("b", 2021, float(v)) for v in (2, 3, 4, 5)]
    data += [("single", 2020, 1.0), ("single", 2020, 2.0), ("single", 2020, 4.0), ("single", 2021, 9.0)]
    data += [("empty", 2020, 1.0), ("empty", 2020, 2.0), ("empty", 2021, None)]
    df = spark.createDataFrame(data, "g string, year int, v double")
    got = {r["g"]: r for r in rows(twosample.compare_samples(df, ["g"], "v", F.col("year") == 2021), "g")}
    c = np.array([v for g, y, v in data if g == "a" and y == 2020])
    t = np.array([v for g, y, v in data if g == "a" and y == 2021])
    r = got["a"]
    a, b = c.var(ddof=1) / 30, t.var(ddof=1) / 12
    assert r["t_welch"] == pytest.approx((c.mean() - t.mean()) / math.sqrt(a + b))
    assert r["df_welch"] == pytest.approx((a + b) ** 2 / (a**2 / 29 + b**2 / 11))
    assert r["f"] == pytest.approx(c.var(ddof=1) / t.var(ddof=1)) and r["p_f"] < 0.05 and r["method"] == "welch" and r["t"] < 0
    r = got["b"]
    assert r["p_f"] == pytest.approx(1) and r["method"] == "pooled" and r["df"] == 6
    assert r["t"] == pytest.approx(-1 / math.sqrt(5 / 3 * 0.5))
    r = got["single"]
    assert r["df"] == 2 and r["p_f"] is None and r["t"] == pytest.approx((7 / 3 - 9) / math.sqrt(7 / 3 * (1 + 1 / 3)))
    assert all(got["empty"][k] is None for k in ("t", "df", "p", "f", "p_f"))


def test_baseline(spark):
    df = spark.createDataFrame([(2005, 9.0, 9.0), (2006, 1.0, 3.0), (2006, None, 5.0), (2007, 6.0, None)], "y int, a double, b double")
    yearly = anomaly.yearly_pooled(df, "y", ["a", "b"])
    got = rows(anomaly.baseline_anomaly(yearly, "y", "mean", 2006, 2007, 2007), "y")
    assert got == [{"y": 2007, "mean": 6.0, "baseline": 4.5, "diff": 1.5}]
    ranked = rows(anomaly.ranked_years(df, "y", ["a", "b"], "m", descending=True), "y")
    assert [(r["m"], r["rank"]) for r in ranked] == [(9.0, 1.0), (3.5, 3.0), (6.0, 2.0)]
    assert ranked[0]["prop"] == pytest.approx((9 - 18.5 / 3) / (18.5 / 3))


# --- regressions and filling -------------------------------------------------------------------


@pytest.fixture(scope="module")
def sensor(spark):
    rng = np.random.default_rng(11)
    data = []
    for i in range(900):
        m = i % 3 + 1
        x1, x2, x3 = (float(v) for v in rng.normal(1e6 if m == 3 else 0, 5, 3))
        y = 1 + 2 * x1 - x2 + (0.001 * x3 if m == 2 else 0) + rng.normal()
        data.append((i, m, x1, x2 if i % 13 else None, x3, 2 * x1 - 3, float(y) if i % 4 else None))
    data += [(900 + i, 4, 1.0, 2.0, 3.0, 4.0, None) for i in range(5)]
    data += [(910, 5, 1.0, 2.0, 3.0, 4.0, 8.0), (911, 5, 1.5, None, 3.0, 4.0, None)]
    return spark.createDataFrame(data, "id int, m int, x1 double, x2 double, x3 double, x4 double, y double").repartition(4), data


def lstsq(data, m, cols):
    use = [r for r in data if r[1] == m and r[6] is not None and all(r[2 + c] is not None for c in cols)]
    x = np.array([[r[2 + c] for c in cols] for r in use]).reshape(len(use), len(cols))
    y = np.array([r[6] for r in use])
    mx, my = x.mean(0), y.mean()
    b = np.linalg.lstsq(x - mx, y - my, rcond=None)[0] if cols else np.zeros(0)
    rss = ((y - my - (x - mx) @ b) ** 2).sum()
    return len(use), my - b @ mx if len(cols) else my, b, rss


def test_multiple_regression(sensor):
    df, data = sensor
    got = {r["m"]: r for r in rows(gapfill.fit_models(df, ["m"], [Model("y", ("x1", "x2", "x3"))]), "m")}
    assert set(got) == {1, 2, 3, 5}
    for m in (1, 2, 3):
        n, b0, b, rss = lstsq(data, m, [0, 1, 2])
        r = got[m]
        assert r["n"] == n and r["rss"] == pytest.approx(rss, rel=1e-6)
        assert [r["coef"][c] for c in ("x1", "x2", "x3")] == pytest.approx(list(b), rel=1e-6, abs=1e-9)
        assert r["coef"][INTERCEPT] == pytest.approx(b0, rel=1e-6)
    assert got[5]["coef"] == {INTERCEPT: 8.0, "x1": 0.0, "x2": 0.0, "x3": 0.0} and got[5]["rss"] == 0


def test_aliased_predictor_is_dropped(sensor):
    df, data = sensor
    got = {r["m"]: r for r in rows(gapfill.fit_models(df, ["m"], [Model("y", ("x1", "x4", "x2"))]), "m")}
    n, b0, b, _ = lstsq(data, 1, [0, 1])
    assert got[1]["coef"]["x4"] == 0.0 and got[1]["coef"]["x1"] == pytest.approx(b[0])


def test_backward_selection(sensor):
    df, data = sensor
    got = {r["m"]: r for r in rows(gapfill.fit_models(df, ["m"], [Model("y", ("x1", "x2", "x3"), True)]), "m")}
    for m in (1, 2, 3):
        complete = [r for r in data if r[1] == m and None not in r]
        score = lambda cols: (lambda n, b0, b, rss: n * math.log(rss / n) + 2 * (len(cols) + 1))(*lstsq(complete, m, cols))
        cols, best = [0, 1, 2], score([0, 1, 2])
        while cols:
            trials = [[c for c in cols if c != g] for g in cols]
            s, t = min((score(t), t) for t in trials)
            if s >= best:
                break
            best, cols = s, t
        assert sorted(got[m]["coef"]) == sorted([INTERCEPT] + [f"x{c + 1}" for c in cols])
        assert got[m]["aic"] == pytest.approx(best, rel=1e-6)


def test_fill(sensor):
    df, data = sensor
    models = [Model("y", ("x1", "x2"))]
    fits = gapfill.fit_models(df, ["m"], models)
    got = {r["id"]: r for r in rows(gapfill.fill(df, ["m"], models, fits, "filled_"), "id")}
    for i, m, x1, x2, _, _, y in data:
        if y is not None:
            assert got[i]["y"] == y and not got[i]["filled_y"]
        elif m == 4 or x2 is None:
            assert got[i]["y"] is None and not got[i]["filled_y"]
        else:
            _, b0, b, _ = lstsq(data, m, [0, 1])
            assert got[i]["y"] == pytest.approx(b0 + b[0] * x1 + b[1] * x2, rel=1e-6) and got[i]["filled_y"]
    again = gapfill.fill(gapfill.fill(df, ["m"], models, fits), ["m"], models, fits)
    assert [r["y"] for r in rows(again, "id")] == [got[i]["y"] for i in sorted(got)]


def test_dropped_predictor_may_be_missing(spark):
    data = [(i, float(i), float((i * 37) % 11), float(5 * i)) for i in range(40)] + [(40, 4.0, None, None)]
    df = spark.createDataFrame(data, "id int, a double, b double, y double").withColumn("y", F.col("y") + F.col("id") % 2 * 0.001)
    models = [Model("y", ("a", "b"), True)]
    fits = gapfill.fit_models(df, [], models)
    assert sorted(fits.first()["coef"]) == [INTERCEPT, "a"]
    assert rows(gapfill.fill(df, [], models, fits), "id")[-1]["y"] == pytest.approx(20, abs=0.01)


def test_levels():
    steps = [Model("a", ("x",)), Model("b", ("a", "x")), Model("c", ("x",)), Model("d", ("b", "c"))]
    assert [[m.target for m in level] for level in gapfill.levels(steps)] == [["a", "c"], ["b"], ["d"]]
    # a target that is only filled by a later step is used as it is
    assert [[m.target for m in level] for level in gapfill.levels([Model("p", ("q",)), Model("q", ("x",))])] == [["p", "q"]]
    with pytest.raises(ValueError):
        gapfill.levels([Model("a", ("x",)), Model("a", ("y",))])


def test_cascade_equals_steps_one_by_one(sensor):
    df, _ = sensor
    df = df.withColumn("x2", F.col("x2") * 1.0)
    steps = [Model("x2", ("x1",)), Model("y", ("x1", "x2"), True)]
    after = {"x2": lambda d: clamp_columns(d, "id", [Clamp("x2", None, -2.0, 1e9)])}
    got = rows(gapfill.cascade(df, ["m"], steps, after), "id")
    one = gapfill.fill(df, ["m"], steps[:1], gapfill.fit_models(df, ["m"], steps[:1]))
    one = clamp_columns(one, "id", [Clamp("x2", None, -2.0, 1e9)])
    two = gapfill.fill(one, ["m"], steps[1:], gapfill.fit_models(one, ["m"], steps[1:]))
    want = rows(two, "id")
    assert [r["y"] for r in got] == pytest.approx([r["y"] for r in want]) and all(r["x2"] is None or r["x2"] >= -2 for r in got)


def test_impute_and_single_predictor(sensor):
    df, data = sensor
    mean = np.mean([r[3] for r in data if r[3] is not None])
    got = rows(gapfill.impute_mean(df, "x2"), "id")
    assert all(g["x2"] == pytest.approx(r[3] if r[3] is not None else mean) for g, r in zip(got, data))
    filled = rows(gapfill.fill_from(df, ["m"], ["y", "x1"], "x1"), "id")
    _, b0, b, _ = lstsq(data, 1, [0])
    assert filled[0]["y"] == pytest.approx(b0 + b[0] * data[0][2])


def test_moments_of_patterns(spark):
    """Models of many missing-value patterns, far from zero, against least squares on their complete cases; plans hold no copies of rows and no earlier level."""
    rng = np.random.default_rng(21)
    data = []
    for i in range(400):
        x = [1e6 + float(v) for v in rng.normal(size=3)]
        y = 2 * x[0] - x[1] + 0.5 * x[2] + float(rng.normal()) * 0.1
        data.append((i, None if i % 50 == 0 else i % 2, *[None if rng.random() < 0.25 else v for v in (*x, y)]))
    df = spark.createDataFrame(data, "id int, m int, x1 double, x2 double, x3 double, y double")
    models = [Model("y", ("x1", "x2", "x3")), Model("x3", ("x1",)), Model("x2", ("x3", "x1"))]
    got = {(r["m"], r["target"]): r for r in gapfill.fit_models(df, ["m"], models).collect()}
    at = {"x1": 2, "x2": 3, "x3": 4, "y": 5}
    for m in (None, 0, 1):
        for model in models:
            rows_ = [r for r in data if r[1] == m and all(r[at[c]] is not None for c in (*model.predictors, model.target))]
            r = got.get((m, model.target))
            if len(rows_) <= len(model.predictors) + 1:
                continue
            x = np.array([[r_[at[c]] - 1e6 for c in model.predictors] for r_ in rows_])
            y = np.array([r_[at[model.target]] for r_ in rows_])
            b = np.linalg.lstsq(np.column_stack([np.ones(len(x)), x]), y - y.mean(), rcond=None)[0]
            assert r["n"] == len(rows_)
            for c, v in zip(model.predictors, b[1:]):
                assert r["coef"][c] == pytest.approx(v, rel=1e-6, abs=1e-6)
    steps = [Model("x3", ("x1",)), Model("x2", ("x3", "x1")), Model("y", ("x1", "x2", "x3"), True)]
    plan = gapfill.cascade(df, ["m"], steps)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") <= 2 and "Generate" not in plan
