"""Block-wise computations against plain numpy, with forced block boundaries and one group holding most rows."""

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from driftline.operators import aggregate, ordered, ranking
from driftline.operators.cleaning import interpolate
from driftline.operators.ordered import BLOCK, centred_window, distinct_ranks, numbered, ordered_blocks, quantiles, running

BLOCKS = [None, 2, 7]


@pytest.fixture(scope="module")
def skewed(spark):
    """1,200 rows, two thirds in one group, a third of all rows equal in value."""
    rng = np.random.default_rng(3)
    data = []
    for i in range(1200):
        k = "hot" if i % 3 else f"k{i % 15}"
        v = 5.0 if i % 3 == 1 else (None if i % 17 == 0 else float(np.round(rng.normal(0, 10), 1)))
        data.append((i, k, v))
    return spark.createDataFrame(data, "id int, k string, v double").repartition(5), data


def groups(data):
    out = {}
    for i, k, v in data:
        out.setdefault(k, []).append((i, v))
    return {k: sorted(g) for k, g in out.items()}


def test_blocks_follow_the_order(skewed):
    df, _ = skewed
    cut = ordered_blocks(df, ["k"], ["id"], 7)
    assert cut.select(BLOCK).distinct().count() > 3
    edges = cut.groupBy(BLOCK).agg(F.min(F.struct("k", "id")).alias("lo"), F.max(F.struct("k", "id")).alias("hi")).orderBy(BLOCK).collect()
    assert all(tuple(a.hi) < tuple(b.lo) for a, b in zip(edges, edges[1:]))


@pytest.mark.parametrize("blocks", BLOCKS)
def test_running(skewed, blocks):
    df, data = skewed
    got = running(ordered_blocks(df, ["k"], ["id"], blocks), ["k"], ["id"], {
        "s": ("sum", F.col("v"), "up"), "r": ("sum", F.lit(1), "down"), "n": ("sum", F.lit(1), "all"),
        "lo": ("min", F.col("v"), "down"), "hi": ("max", F.col("v"), "up")})
    got = {r["id"]: r for r in rows(got, "id")}
    assert len(got) == 1200
    for g in groups(data).values():
        for j, (i, _) in enumerate(g):
            before = [v for _, v in g[: j + 1] if v is not None]
            after = [v for _, v in g[j:] if v is not None]
            r = got[i]
            assert r["n"] == len(g) and r["r"] == len(g) - j
            assert r["s"] == (pytest.approx(sum(before)) if before else None)
            assert r["hi"] == (max(before) if before else None) and r["lo"] == (min(after) if after else None)


@pytest.mark.parametrize("blocks", BLOCKS)
def test_quantiles(skewed, blocks):
    df, data = skewed
    probs = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.9, "e": 1.0}
    got = {r["k"]: r for r in rows(quantiles(df, ["k"], "v", probs, blocks), "k")}
    for k, g in groups(data).items():
        v = [x for _, x in g if x is not None]
        assert got[k]["n"] == len(v)
        for name, p in probs.items():
            assert got[k][name] == pytest.approx(np.quantile(v, p))
    whole = quantiles(df, [], "v", probs, blocks).first()
    v = [x for _, _, x in data if x is not None]
    assert whole["d"] == pytest.approx(np.quantile(v, 0.9))


@pytest.mark.parametrize("blocks", BLOCKS)
def test_numbers(skewed, blocks):
    df, data = skewed
    got = {r["id"]: r["pos"] for r in rows(numbered(df, ["k"], ["id"], blocks=blocks), "id")}
    for g in groups(data).values():
        assert [got[i] for i, _ in g] == list(range(len(g)))


@pytest.mark.parametrize("blocks", BLOCKS)
def test_average_rank(skewed, blocks):
    df, data = skewed
    up = {r["id"]: r["rank"] for r in rows(ranking.average_rank(df, ["k"], "v", blocks=blocks), "id")}
    down = {r["id"]: r["rank"] for r in rows(ranking.average_rank(df, ["k"], "v", descending=True, blocks=blocks), "id")}
    for g in groups(data).values():
        v = np.array([x for _, x in g if x is not None])
        for i, x in g:
            if x is None:
                assert up[i] is None and down[i] is None
            else:
                assert up[i] == (v < x).sum() + ((v == x).sum() + 1) / 2
                assert down[i] == (v > x).sum() + ((v == x).sum() + 1) / 2


def bh(p):
    p = np.asarray(p, float)
    order = np.argsort(-p, kind="stable")
    adj = np.minimum.accumulate(p[order] * len(p) / np.arange(len(p), 0, -1))
    out = np.empty(len(p))
    out[order] = np.minimum(1, adj)
    return out


@pytest.mark.parametrize("blocks", BLOCKS)
def test_fdr(skewed, blocks):
    df, data = skewed
    df = df.withColumn("p", F.abs("v") / 40)
    got = {r["id"]: r for r in rows(ranking.adjust_fdr(ranking.adjust_fdr(df, "p", "all_", [], blocks), "p", "fam", ["k"], blocks), "id")}
    known = [(i, abs(v) / 40) for i, _, v in data if v is not None]
    for (i, _), want in zip(known, bh([p for _, p in known])):
        assert got[i]["all_"] == pytest.approx(want)
    for g in groups(data).values():
        fam = [(i, abs(v) / 40) for i, v in g if v is not None]
        for (i, _), want in zip(fam, bh([p for _, p in fam])):
            assert got[i]["fam"] == pytest.approx(want)
    assert all(got[i]["all_"] is None for i, _, v in data if v is None)


def test_fdr_by_hand(spark):
    df = spark.createDataFrame([(0.01,), (0.02,), (0.02,), (0.9,), (None,), (0.04,)], "p double")
    got = [r.p_adj for r in ranking.adjust_fdr(df, "p").orderBy(F.col("p").asc_nulls_last()).collect()]
    assert got[:-1] == pytest.approx([1 / 30, 1 / 30, 1 / 30, 0.05, 0.9]) and got[-1] is None


@pytest.mark.parametrize("blocks", BLOCKS)
def test_interpolation(skewed, blocks):
    df, data = skewed
    got = {r["id"]: r["f"] for r in rows(interpolate(df, ["k"], ["id"], "v", "f", blocks=blocks), "id")}
    by_id = {r["id"]: r["f"] for r in rows(interpolate(df, ["k"], ["id"], "v", "f", axis="id", blocks=blocks), "id")}
    for g in groups(data).values():
        at = [j for j, (_, v) in enumerate(g) if v is not None]
        want = np.interp(range(len(g)), at, [g[j][1] for j in at])
        ids = [i for i, _ in g]
        want_id = np.interp(ids, [ids[j] for j in at], [g[j][1] for j in at])
        assert [got[i] for i in ids] == pytest.approx(list(want))
        assert [by_id[i] for i in ids] == pytest.approx(list(want_id))


def test_interpolation_of_nothing(spark):
    df = spark.createDataFrame([(1, None), (2, None)], "t int, v double")
    assert [r.v for r in interpolate(df, [], ["t"], "v").collect()] == [None, None]


@pytest.mark.parametrize("tile", [11, 50, 4096])
def test_centred_window(skewed, tile):
    df, data = skewed
    stages = [lambda w: {"m": F.avg("v").over(w), "n": F.count("v").over(w)}, lambda w: {"mm": F.max("m").over(w)}]
    rows_ = numbered(df.fillna({"v": 0.0}), ["k"], ["id"], blocks=3)
    got = {r["id"]: r for r in rows(centred_window(rows_, ["k"], "pos", 5, stages, tile), "id")}
    assert len(got) == 1200
    for g in groups(data).values():
        v = [x or 0.0 for _, x in g]
        for j, (i, _) in enumerate(g):
            near = v[max(0, j - 5) : j + 6]
            assert got[i]["n"] == len(near) and got[i]["m"] == pytest.approx(np.mean(near))
            means = [np.mean(v[max(0, q - 5) : q + 6]) for q in range(max(0, j - 5), min(len(v), j + 6))]
            assert got[i]["mm"] == pytest.approx(max(means))


@pytest.mark.parametrize("blocks", BLOCKS)
def test_five_numbers(skewed, blocks):
    df, data = skewed
    got = {r["k"]: r for r in rows(aggregate.five_numbers(df, ["k"], "v", blocks=blocks), "k")}
    outliers = aggregate.box_outliers(df, ["k"], "v", blocks=blocks).groupBy("k").count().collect()
    counted = {r["k"]: r["count"] for r in outliers}
    for k, g in groups(data).items():
        v = np.array([x for _, x in g if x is not None])
        q1, med, q3 = np.quantile(v, [0.25, 0.5, 0.75])
        lo, hi = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
        inside = v[(v >= lo) & (v <= hi)]
        r = got[k]
        assert (r["q1"], r["median"], r["q3"]) == pytest.approx((q1, med, q3))
        assert (r["whisker_low"], r["whisker_high"]) == (inside.min(), inside.max())
        assert r["outliers"] == len(v) - len(inside) == counted.get(k, 0)


def test_partitioning_does_not_matter(skewed):
    df, _ = skewed
    one = distinct_ranks(df.repartition(1), ["k"], "v", 3)
    many = distinct_ranks(df.repartition(17), ["k"], "v", 9)
    cols = ["k", "v", "cnt", "below", "total"]
    assert rows(one.select(*cols), "k", "v") == rows(many.select(*cols), "k", "v")


def test_empty(spark):
    df = spark.createDataFrame([], "k string, v double")
    assert quantiles(df, ["k"], "v", {"m": 0.5}).count() == 0
    assert ranking.adjust_fdr(df, "v").count() == 0
    assert ranking.average_rank(df, ["k"], "v").count() == 0


@pytest.mark.parametrize("sketch", [1000, 20])
def test_quantiles_by_brackets(spark, sketch):
    """Ties, NULL keys and values, tiny groups and infinities; a coarse sketch must not change a result."""
    rng = np.random.default_rng(12)
    data = [("wide", float(v)) for v in rng.lognormal(3, 2, 20_000)] + [("ties", float(v)) for v in rng.integers(0, 3, 5_000)]
    data += [(None, float(v)) for v in range(7)] + [("one", 4.0), ("none", None), ("wide", None)] + [("flat", 1.5)] * 500
    data += [("odd", v) for v in [float("-inf"), -1.0, 0.0, 2.0, float("inf")] * 40]
    probs = {"a": 0.0, "b": 0.025, "c": 0.5, "d": 0.975, "e": 1.0}
    df = spark.createDataFrame(data, "g string, v double").repartition(5)
    got = {r["g"]: r for r in ordered.quantiles(df, ["g"], "v", probs, sketch=sketch).collect()}
    want = {g: np.array([v for k, v in data if k == g and v is not None]) for g in ("wide", "ties", None, "one", "flat")}
    assert set(got) == {*want, "odd"} and got["odd"]["n"] == 200 and got["odd"]["c"] == 0.0 and got["odd"]["e"] == float("inf")
    for g, v in want.items():
        assert [got[g][p] for p in probs] == pytest.approx(list(np.quantile(v, list(probs.values()))), rel=1e-12) and got[g]["n"] == len(v)
    whole = ordered.quantiles(df.filter("g = 'wide'"), [], "v", probs, sketch=sketch).collect()
    assert [whole[0][p] for p in probs] == pytest.approx(list(np.quantile(want["wide"], list(probs.values()))), rel=1e-12)


def test_bracket_missed_is_counted_in_full(spark, monkeypatch):
    """A bracket in the wrong place costs a second pass, never the result."""
    data = [(g, float(v)) for g, low in (("a", 0), ("b", 50)) for v in range(low, low + 999)]
    df = spark.createDataFrame(data, "g string, v double")
    monkeypatch.setattr(ordered.F, "percentile_approx", lambda *a: F.array(*[F.lit(3.0)] * 2, *[F.lit(4.0)] * 2))
    got = {r["g"]: (r["n"], r["lo"], r["hi"]) for r in ordered.quantiles(df, ["g"], "v", {"lo": 0.5, "hi": 0.9}).collect()}
    for g, low in (("a", 0), ("b", 50)):
        assert got[g] == (999, *np.quantile(np.arange(low, low + 999), [0.5, 0.9]))


def test_no_range_exchange_of_data_rows(spark):
    """Of 40,000 different values only those in the brackets are ordered."""
    df = spark.range(40_000).select((F.col("id") * 7919 % 40_009).cast("double").alias("v"))
    assert ordered.bracket_counts(df, [], "v", [0.25, 0.75]).count() < 1_200
