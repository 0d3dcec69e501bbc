"""Bootstrap, permutation tests, densities, cleaning and clusters."""

import datetime
import hashlib
import math
import tracemalloc

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from driftline import oracle
from driftline.operators import cleaning, clusters, density, resample
from driftline.operators.cleaning import Clamp
from driftline.plans import survey


def test_poisson_counts():
    rng = np.random.default_rng(1)
    table = np.searchsorted(np.array(resample.poisson_limits()), np.arange(1 << 16), "right").astype(np.uint8)
    seeds = rng.integers(0, 2**32, (2, 4000), dtype=np.uint32)
    w = resample.poisson_counts(*seeds, 201, table).astype(float)
    assert w.shape == (4000, 201)
    assert w.mean() == pytest.approx(1, abs=0.005) and w.var() == pytest.approx(1, abs=0.01) and (w == 0).mean() == pytest.approx(math.exp(-1), abs=0.002)
    r = np.corrcoef(w.T)  # replicates are independent of one another
    assert np.abs(r[np.triu_indices(201, 1)]).max() < 0.09
    assert np.array_equal(resample.poisson_counts(seeds[0][5:9], seeds[1][5:9], 200, table), w[5:9, :200])


def test_bootstrap_against_drawn_weights(spark):
    """Sums of every replicate, from weights written out row by row."""
    data = [(None if i % 10 == 0 else "pq"[i % 2], i, i % 3 == 0, None if i % 7 == 0 else float(i * i % 101)) for i in range(300)] + [("r", 300, True, 1.0)]
    df = spark.createDataFrame(data, "g string, id int, late boolean, x double")
    got = {(r["g"], r["rep"]): r["diff"] for r in resample.bootstrap_replicates(df.repartition(3), ["g"], ["x"], F.col("late"), ["id"], 7).collect()}
    limits = resample.poisson_limits()

    def weight(i, rep):
        digest = hashlib.md5(str(i).encode()).hexdigest()
        x = (int(digest[:8], 16) + rep // 2 * resample.STEP) % 2**32
        x = (x ^ x >> 16) * resample.FIRST % 2**32
        x = ((x ^ x >> 15) + int(digest[8:16], 16)) % 2**32 * resample.SECOND % 2**32
        x ^= x >> 16
        return sum(limit <= (x >> 16 * (rep % 2)) % 2**16 for limit in limits)

    for g in (None, "p", "q", "r"):
        for rep in range(7):
            mean = []
            for side in (True, False):
                some = [(weight(i, rep), x) for k, i, late, x in data if k == g and late == side and x is not None]
                n = sum(w for w, _ in some)
                mean.append(sum(w * x for w, x in some) / n if n else None)
            assert got[g, rep] == (pytest.approx(mean[0] - mean[1]) if None not in mean else None)
    assert resample.bootstrap_replicates(df.limit(0), ["g"], ["x"], F.col("late"), ["id"], 7).count() == 0
    assert resample.bootstrap_replicates(df, [], ["x"], F.col("late"), ["id"], 7).count() == 7


def test_bootstrap(spark):
    rng = np.random.default_rng(2)
    data = [("a", i, bool(i % 2), float(rng.normal(3 if i % 2 else 0)), None if i % 5 == 0 else float(i % 7)) for i in range(400)]
    data += [("b", 1000 + i, bool(i % 2), float(rng.normal(0)), None) for i in range(300)] + [("c", 2000, True, 1.0, 1.0)]
    df = spark.createDataFrame(data, "g string, id int, late boolean, x double, y double")
    args = (["g"], ["x", "y"], F.col("late"), ["id"], 400)
    got = {(r["g"], r["metric"]): r for r in rows(resample.bootstrap_interval(df.repartition(7), *args), "g", "metric")}
    again = {(r["g"], r["metric"]): r for r in rows(resample.bootstrap_interval(df.repartition(2), *args, partitions=5), "g", "metric")}
    for k in got:
        for c in ("lower", "upper"):
            assert got[k][c] == (pytest.approx(again[k][c]) if again[k][c] is not None else None)
    r = got["a", "x"]
    late = np.array([d[3] for d in data if d[0] == "a" and d[2]])
    early = np.array([d[3] for d in data if d[0] == "a" and not d[2]])
    gap, se = late.mean() - early.mean(), math.sqrt(late.var() / 200 + early.var() / 200)
    assert r["lower"] == pytest.approx(gap - 1.96 * se, abs=0.05) and r["upper"] == pytest.approx(gap + 1.96 * se, abs=0.05)
    assert r["significant"] and r["linetype"] == "solid" and r["lower"] < gap < r["upper"]
    assert got["c", "x"]["lower"] is None and got["c", "x"]["significant"] is None
    assert resample.bootstrap_replicates(df, ["g"], ["x"], F.col("late"), ["id"], 10).filter("g = 'a' AND metric = 'x'").count() == 10


def test_key_text_tells_keys_apart(spark):
    df = spark.createDataFrame([("a|b", "c"), ("a", "b|c"), (None, "x"), ("x", None), ("\\N", "x")], "p string, q string")
    assert df.select(resample.key_text(["p", "q"])).distinct().count() == 5


def test_density_of_groups_far_apart(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=500)
    df = spark.createDataFrame([("near", float(x)) for x in v] + [("far", float(x + 1e9)) for x in v], "g string, v double")
    peak = {r["g"]: r["max_density"] for r in rows(density.peak_density(density.kernel_density(df, ["g"], "v"), ["g"]), "g")}
    assert peak["far"] == pytest.approx(peak["near"], rel=1e-3)


def test_gap_statistic_without_variation(spark):
    same = spark.createDataFrame([(i, 2.0, 3.0) for i in range(6)], "id int, x double, y double")
    got = rows(clusters.gap_statistic(spark, same, ["x", "y"], ["id"], 2, 2), "k")
    assert [(r["k"], r["log_w"], r["gap"]) for r in got] == [(1, None, None), (2, None, None)]
    assert clusters.gap_statistic(spark, same.limit(0), ["x", "y"], ["id"], 2, 2).count() == 0


@pytest.fixture(scope="module")
def plots(spark):
    """An unbalanced two-factor layout."""
    rng = np.random.default_rng(9)
    data = []
    for i in range(60):
        a, b = "pq"[i % 2], "xyz"[(i * i + i // 7) % 3]
        shift = 1.5 if a == "p" else 0.0
        data.append((f"id{i}", a, b, float(rng.normal(shift)), float(rng.normal())))
    return spark.createDataFrame(data, "id string, a string, b string, u double, v double"), data


def design(data, *factors):
    n = len(data)
    cols = [np.ones(n)]
    for f in factors:
        keys = [tuple(r[i] for i in f) for r in data]
        cols += [np.array([k == level for k in keys], float) for level in sorted(set(keys))[1:]]
    return np.stack(cols, 1)


def fitted_ss(x, y):
    b = np.linalg.lstsq(x, y, rcond=None)[0]
    return ((x @ b - y.mean(0)) ** 2).sum()


def test_permanova_one_factor(plots):
    df, data = plots
    got = {r["term"]: r for r in rows(resample.permanova(df, "id", ["a"], ["u", "v"], 99, blocks=3), "ord")}
    y = np.array([r[3:] for r in data])
    d2 = ((y[:, None] - y[None]) ** 2).sum(-1)
    n = len(data)
    sst = d2.sum() / 2 / n
    within = sum(d2[np.ix_(s, s)].sum() / 2 / len(s) for s in ([i for i in range(n) if data[i][1] == g] for g in "pq"))
    r = got["a"]
    assert r["ss"] == pytest.approx(sst - within) and r["r2"] == pytest.approx(1 - within / sst)
    assert r["f"] == pytest.approx((sst - within) / (within / (n - 2))) and r["df"] == 1
    assert got["residual"]["ss"] == pytest.approx(within) and got["total"]["ss"] == pytest.approx(sst)
    assert 0 < r["p"] < 0.05
    same = {r["term"]: r for r in rows(resample.permanova(df.repartition(5), "id", ["a"], ["u", "v"], 99), "ord")}
    assert same["a"]["p"] == r["p"]


def test_permanova_two_factors_sequential(plots):
    df, data = plots
    got = {r["term"]: r for r in rows(resample.permanova(df, "id", ["a", "b"], ["u", "v"], 49), "ord")}
    y = np.array([r[3:] for r in data])
    s1 = fitted_ss(design(data, (1,)), y)
    s2 = fitted_ss(design(data, (1,), (2,)), y)
    s3 = fitted_ss(design(data, (1, 2)), y)
    sst = ((y - y.mean(0)) ** 2).sum()
    assert got["a"]["ss"] == pytest.approx(s1) and got["b"]["ss"] == pytest.approx(s2 - s1)
    assert got["a:b"]["ss"] == pytest.approx(s3 - s2) and got["residual"]["ss"] == pytest.approx(sst - s3)
    assert [got[t]["df"] for t in ("a", "b", "a:b", "residual", "total")] == [1, 2, 2, 54, 59]
    assert got["b"]["f"] == pytest.approx((s2 - s1) / 2 / ((sst - s3) / 54)) and got["a"]["p"] < 0.1 < got["b"]["p"] <= 1
    plain = {r["term"]: r for r in rows(resample.permanova(df, "id", ["a", "b"], ["u", "v"], 9, interaction=False), "ord")}
    assert "a:b" not in plain and plain["residual"]["ss"] == pytest.approx(sst - s2) and plain["residual"]["df"] == 56


@pytest.mark.parametrize("rows", [1, 2, 3, 7, 60, 1000])
def test_bijection(rows):
    keys = resample.permutation_keys(200)
    to = resample.permuted_numbers(np.arange(rows), rows, keys)
    assert (np.sort(to, axis=1) == np.arange(rows)).all()
    again = resample.permuted_numbers(np.arange(rows)[::-1], rows, keys[5:6])
    assert (again[0][::-1] == to[5]).all()
    if rows == 60:
        seen = np.array([np.bincount(to[:, i], minlength=rows) for i in range(rows)])
        assert ((seen - 200 / 60) ** 2).sum() / (200 / 60) < 60 * 59 + 6 * math.sqrt(2 * 60 * 59)  # every place is equally likely


@pytest.mark.parametrize("held, cells_at_once", [(1 << 22, 1 << 20), (10, 2)])
def test_permuted_sums(plots, monkeypatch, held, cells_at_once):
    """Sums of every permutation, written out; also with few sums held in a task and cells taken in several passes."""
    monkeypatch.setattr(resample, "SUMS_HELD", held)
    monkeypatch.setattr(resample, "CELLS_AT_ONCE", cells_at_once)
    df, data = plots
    cells = resample.cell_bounds(df, ["a", "b"], 3)
    got = {(r["perm"], r["cell"]): r["u"] for r in resample.permuted_sums(df, cells, "id", ["u"], 20, 4).collect()}
    ordered = sorted((r[1], r[2]) for r in data)
    number = {c: i for i, c in enumerate(sorted(set(ordered)))}
    by_id = sorted(data)
    to = resample.permuted_numbers(np.arange(len(data)), len(data), resample.permutation_keys(20))
    for p in range(20):
        want = dict.fromkeys(number.values(), 0.0)
        for i, r in enumerate(by_id):
            want[number[ordered[to[p, i]]]] += r[3]
        for c, v in want.items():
            assert got[p + 1, c] == pytest.approx(v)


def test_two_factors_with_empty_cells_either_way_round(spark):
    rng = np.random.default_rng(12)
    data = [(i, "abcdefg"[int(rng.integers(7))], int(rng.integers(3)), float(rng.normal()), float(rng.normal())) for i in range(90)]
    data = [r for r in data if (r[1], r[2]) not in {("a", 0), ("b", 2), ("c", 1)}]
    df = spark.createDataFrame(data, "id int, p string, q int, u double, v double")
    y = np.array([r[3:] for r in data])
    for one, two in ((1, 2), (2, 1)):
        names = [" pq"[one], " pq"[two]]
        got = {r["term"]: r for r in rows(resample.permanova(df, "id", names, ["u", "v"], 19), "ord")}
        s1, s2, s3 = (fitted_ss(design(data, *f), y) for f in (((one,),), ((one,), (two,)), ((one, two),)))
        assert got[names[0]]["ss"] == pytest.approx(s1) and got[names[1]]["ss"] == pytest.approx(s2 - s1)
        assert got[":".join(names)]["ss"] == pytest.approx(s3 - s2)
        assert [got[t]["df"] for t in (*names, ":".join(names))] == [(6 if one == 1 else 2), (2 if one == 1 else 6), len({r[1:3] for r in data}) - 9]


# --- densities ---------------------------------------------------------------------------------


def test_density_against_direct_sum(spark):
    rng = np.random.default_rng(4)
    data = [("n", float(v)) for v in rng.normal(50, 10, 500)] + [("m", float(v)) for v in np.r_[rng.normal(0, 1, 150), rng.normal(8, 2, 90)]]
    data += [("same", 3.0)] * 4 + [("n", None)]
    df = spark.createDataFrame(data, "g string, v double")
    curves = rows(density.kernel_density(df, ["g"], "v"), "g", "i")
    for g in "nm":
        v = np.array([x for k, x in data if k == g and x is not None])
        bw = 0.9 * min(v.std(ddof=1), np.subtract(*np.quantile(v, [0.75, 0.25])) / 1.34) * len(v) ** -0.2
        c = [r for r in curves if r["g"] == g]
        x, y = np.array([r["x"] for r in c]), np.array([r["y"] for r in c])
        assert len(c) == 512 and (x[0], x[-1]) == pytest.approx((v.min() - 3 * bw, v.max() + 3 * bw))
        direct = np.exp(-(((x[:, None] - v) / bw) ** 2) / 2).sum(1) / (len(v) * bw * math.sqrt(2 * math.pi))
        assert np.abs(y - direct).max() < 1e-3 * direct.max()
        assert np.trapezoid(y, x) == pytest.approx(1, abs=0.01)
    same = [r for r in curves if r["g"] == "same"]
    assert len(same) == 512 and all(math.isfinite(r["y"]) for r in same)
    peak = {r["g"]: r["max_density"] for r in rows(density.peak_density(density.kernel_density(df, ["g"], "v", blocks=4), ["g"]), "g")}
    assert peak["n"] == pytest.approx(max(r["y"] for r in curves if r["g"] == "n"))


def test_normal_curve(spark):
    df = spark.createDataFrame([("a", 2.0, 0.5), ("b", 1.0, None)], "g string, mean double, sd double")
    c = rows(density.normal_curves(df, ["g"]), "i")
    assert len(c) == 200 and c[0]["x"] == pytest.approx(0) and c[-1]["x"] == pytest.approx(4)
    assert c[0]["y"] == pytest.approx(math.exp(-8) / (0.5 * math.sqrt(2 * math.pi)))


# --- cleaning ----------------------------------------------------------------------------------


def test_clean_series(spark):
    rng = np.random.default_rng(8)
    truth = [10 * math.sin(i / 20) for i in range(400)]
    seen = [t + float(rng.normal(0, 0.2)) for t in truth]
    for i in (50, 51, 200, 333):
        seen[i] += 60
    gaps = set(range(100, 110)) | {0, 399}
    data = [("hot", i, None if i in gaps else v) for i, v in enumerate(seen)] + [("b", i, 1.0) for i in range(5)]
    df = spark.createDataFrame(data, "k string, t int, v double").repartition(6)
    for blocks in (None, 5):
        got = [r for r in rows(cleaning.clean_series(df, ["k"], ["t"], "v", blocks=blocks), "k", "t") if r["k"] == "hot"]
        assert len(got) == 400
        assert {r["t"] for r in got if r["cleaned_outlier"]} >= {50, 51, 200, 333}
        assert sum(r["cleaned_outlier"] for r in got) < 12
        assert max(abs(r["cleaned"] - truth[r["t"]]) for r in got) < 2.5
        assert all(r["cleaned"] == r["v"] for r in got if r["v"] is not None and not r["cleaned_outlier"])


def test_clean_columns(spark):
    data = [(i, float(i), None if i == 7 else float(2 * i)) for i in range(30)]
    df = spark.createDataFrame(data, "t int, a double, b double")
    got = rows(cleaning.clean_columns(df, [], "t", ["b"]), "t")
    assert [r["a"] for r in got] == [d[1] for d in data] and [r["b"] for r in got] == pytest.approx([2.0 * i for i in range(30)])


def test_clamps(spark):
    df = spark.createDataFrame([("2006-12-31", 9.0), ("2007-01-01", 9.0), ("2006-01-01", None), ("2006-01-01", -50.0)], "d string, v double")
    df = df.withColumn("d", F.to_date("d"))
    wide = cleaning.clamp_columns(df, "d", [Clamp("v", "2007-01-01", None, 7.0), Clamp("v", None, -40.0, None)])
    assert [r.v for r in wide.collect()] == [7.0, 9.0, None, -40.0]
    rules = spark.createDataFrame([("x", "2007-01-01", None, 7.0), ("x", None, -40.0, None)], "variable string, before string, lo double, hi double")
    rules = rules.withColumn("before", F.to_date("before"))
    long = df.withColumns({"variable": F.lit("x"), "value": F.col("v")}).unionByName(df.withColumns({"variable": F.lit("y"), "value": F.col("v")}))
    got = rows(cleaning.clamp_long(long, "d", rules), "variable")
    assert [r["value"] for r in got[:4]] == [7.0, 9.0, None, -40.0] and [r["value"] for r in got[4:]] == [9.0, 9.0, None, -50.0]


def test_rule_intervals(spark):
    """Random rules and dates against each rule on each row; NULL dates, NULL variables and rules of one end."""
    rng = np.random.default_rng(21)
    day = lambda i: datetime.date(2000, 1, 1) + datetime.timedelta(days=int(i))
    pick = lambda v: None if rng.random() < 0.3 else float(v)
    made = [(("a", "b", None)[i % 3], None if i % 7 == 0 else day(rng.integers(0, 12)), pick(rng.normal(-1)), pick(rng.normal(1))) for i in range(30)]
    data = [(i, ("a", "b", "c", None)[i % 4], None if i % 11 == 0 else day(rng.integers(-2, 15)), None if i % 13 == 0 else float(rng.normal(0, 3))) for i in range(300)]
    rules = spark.createDataFrame(made, "variable string, before date, lo double, hi double")
    got = {r["id"]: r["value"] for r in cleaning.clamp_long(spark.createDataFrame(data, "id int, variable string, d date, value double"), "d", rules).collect()}
    assert len(got) == 300
    for i, variable, d, v in data:
        held = [r for r in made if r[0] == variable and (r[1] is None or (d is not None and d < r[1]))]
        if v is not None:
            v = max([v] + [r[2] for r in held if r[2] is not None])
            v = min([v] + [r[3] for r in held if r[3] is not None])
        assert got[i] == v


# --- clusters ----------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(6)
    data = [(i, "ab"[i % 2], *(float(v) for v in rng.normal(10 * (i % 3) - 10, 1, 2))) for i in range(90)]
    return spark.createDataFrame(data, "id int, g string, x double, y double"), data


@pytest.mark.parametrize("bisecting", [False, True])
def test_clusters(points, bisecting):
    df, _ = points
    got = {(r["id"] % 3, r["cluster"]) for r in clusters.cluster(df, ["x", "y"], 3, bisecting=bisecting).collect()}
    assert len(got) == 3


def plain_squares(y, k, iterations=10):
    """Farthest-first centres and Lloyd's iterations in plain numpy."""
    far = lambda c: max(zip(((y[:, None] - c) ** 2).sum(-1).min(1), y.tolist()))[1]
    c = np.array([far(y.mean(0)[None])])
    while len(c) < k:
        c = np.vstack([c, far(c)])
    for _ in range(iterations):
        near = ((y[:, None] - c) ** 2).sum(-1).argmin(1)
        c = np.array([y[near == j].mean(0) if (near == j).any() else c[j] for j in range(k)])
    return ((y[:, None] - c) ** 2).sum(-1).min(1).sum()


def plain_bits(key, draw, i, d, seed):
    """The generator in whole numbers."""
    digest = hashlib.md5(f"{key}|{seed}".encode()).hexdigest()
    mix = lambda v: int(resample.mixed(np.array([v % 2**32], np.uint32))[0])
    return mix(mix(int(digest[:8], 16) + (draw * d + i) * resample.STEP) + int(digest[8:16], 16))


def test_elbow_and_gap(spark, points):
    df, data = points
    df = df.repartition(4)
    y = np.array([r[2:] for r in data])
    wss = [r["wss"] for r in rows(clusters.elbow(spark, df, ["x", "y"], 4), "k")]
    assert wss[0] == pytest.approx(((y - y.mean(0)) ** 2).sum()) and wss[0] > wss[1] > wss[2]
    assert wss[2] == pytest.approx(sum(((y[k::3] - y[k::3].mean(0)) ** 2).sum() for k in range(3)))
    assert wss == pytest.approx([plain_squares(y, k) for k in range(1, 5)])
    array = df.select(F.array("x", "y").alias("v"))
    assert [r["wss"] for r in rows(clusters.elbow(spark, array, ["v"], 4), "k")] == pytest.approx(wss)

    gap = rows(clusters.gap_statistic(spark, df, ["x", "y"], ["id"], 4, 5), "k")
    axes = np.linalg.eigh((y - y.mean(0)).T @ (y - y.mean(0)))[1]
    z = (y - y.mean(0)) @ axes
    logs = []
    for b in range(1, 6):
        u = np.array([[plain_bits(r[0], b, i, 2, 123) / 2**32 for i in range(2)] for r in data])
        ref = y.mean(0) + (z.min(0) + (z.max(0) - z.min(0)) * u) @ axes.T
        logs.append([np.log(plain_squares(ref, k) / 2) for k in range(1, 5)])
    assert [r["expected"] for r in gap] == pytest.approx(list(np.mean(logs, 0)), rel=1e-6)
    assert [r["se"] for r in gap] == pytest.approx(list(np.std(logs, 0, ddof=1) * np.sqrt(1 + 1 / 5)), rel=1e-4)
    assert max(gap, key=lambda r: r["gap"])["k"] in (3, 4) and gap[2]["gap"] > gap[0]["gap"]


def test_elbow_odd_rows(spark):
    """NULL and NaN rows take no part, equal rows leave centres without rows, an empty table gives none."""
    df = spark.createDataFrame([(1.0, 2.0)] * 4 + [(5.0, 2.0), (None, 1.0), (float("nan"), 1.0)], "x double, y double")
    assert [r["wss"] for r in rows(clusters.elbow(spark, df, ["x", "y"], 3), "k")] == pytest.approx([12.8, 0.0, 0.0])
    assert clusters.elbow(spark, df.limit(0), ["x", "y"], 3).count() == 0


def test_pair_squares(points):
    df, data = points
    got = {r["g"]: r for r in rows(clusters.pair_squares(df, ["g"], ["x", "y"]), "g")}
    for g in "ab":
        y = np.array([r[2:] for r in data if r[1] == g])
        d2 = ((y[:, None] - y[None]) ** 2).sum(-1)[np.triu_indices(len(y), 1)]
        assert got[g]["pairs"] == len(d2) and got[g]["sum_sq"] == pytest.approx(d2.sum()) and got[g]["mean_sq"] == pytest.approx(d2.mean())
    y = np.array([r[2:] for r in data])
    far = {r["g"]: r["distance"] for r in rows(clusters.centroid_distance(df, ["g"], ["x", "y"]), "g")}
    assert far["a"] == pytest.approx(np.linalg.norm(y[::2].mean(0) - y.mean(0)))


def test_draws_of_32_bits():
    """All 32 bits decide a count: as by searching every draw, beyond eight, and with the limits that the survey's SQL has."""
    limits = np.array(resample.poisson_limits(32))
    assert len(limits) == 12 and limits.tolist() == oracle.POISSON_FINE
    coarse = resample.coarse_counts(limits)
    seeds = np.random.default_rng(4).integers(0, 2**32, (2, 20_000), dtype=np.uint32)
    w = resample.fine_counts(*seeds, 201, limits, coarse)
    assert np.array_equal(w, np.searchsorted(limits, resample.random_numbers(*seeds, 201).astype(np.int64), "right"))
    assert w.max() > 8 and w.mean() == pytest.approx(1, abs=0.005) and w.var() == pytest.approx(1, abs=0.01)
    r = np.corrcoef(w.T)
    assert np.abs(r[np.triu_indices(201, 1)]).max() < 0.04


def test_survey_draws_all_bits(spark):
    """A bound of the survey's change is a quantile of replicates whose draws have 32 bits, one for each counter."""
    data = [(i, "ab"[i % 2], "late" if i % 3 == 0 else "early", float(i * i % 101)) for i in range(120)]
    df = spark.createDataFrame(data, "id int, g string, period string, x double")
    got = {r["g"]: r for r in survey.period_change(df, "g", "early", "late", ["x"], ["x"], ["id"], 50).collect()}
    digests = [hashlib.md5(str(i).encode()).hexdigest() for i in range(120)]
    seeds = (np.array([int(d[at : at + 8], 16) for d in digests], np.uint32) for at in (0, 8))
    w = np.searchsorted(np.array(resample.poisson_limits(32)), resample.random_numbers(*seeds, 50).astype(np.int64), "right")
    for g in "ab":
        side = lambda p: np.array([k == g and period == p for _, k, period, _ in data])
        x = np.array([r[3] for r in data])
        mean = lambda p: (w[side(p)] * x[side(p), None]).sum(0) / w[side(p)].sum(0)
        diff = mean("late") - mean("early")
        assert (got[g]["x_lower"], got[g]["x_upper"]) == (pytest.approx(np.quantile(diff, 0.025)), pytest.approx(np.quantile(diff, 0.975)))


def test_rows_go_to_the_first_of_the_nearest_centres():
    """Counts, squares and sums as by definition, also where centres are as near; no array of rows x centres x columns is made."""
    rng = np.random.default_rng(8)
    spans = [slice(0, 1), slice(1, 4), slice(4, 10)]
    y, centres = rng.integers(0, 3, (1000, 40)).astype(float), rng.integers(0, 3, (10, 40)).astype(float)
    centres[6] = centres[5]
    y[:20] = (centres[1] + centres[2]) / 2
    held = np.zeros((10, 42))
    tracemalloc.start()
    clusters._assigned(centres[None], spans)(held, 0, y)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < y.size * len(centres) * 8 / 4
    for span in spans:
        d = ((y[:, None] - centres[None, span]) ** 2).sum(-1)
        near = d.argmin(1)
        for j in range(span.stop - span.start):
            assert held[span.start + j, 0] == (near == j).sum() and held[span.start + j, 2:] == pytest.approx(y[near == j].sum(0))
        assert held[span, 1].sum() == pytest.approx(d.min(1).sum())
