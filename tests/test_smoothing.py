"""Smooths of variable span against the definition in plain numpy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftline.operators import cleaning, smoothing


def plain_lines(y, span):
    n = len(y)
    h = max(2, math.floor(0.5 * span * n + 0.5))
    w = min(2 * h + 1, n)
    fit, error = [], []
    for i in range(n):
        low = min(max(i - h, 0), n - w)
        x = np.arange(low, low + w)
        part = np.asarray(y[low:low + w])
        sxx = ((x - x.mean()) ** 2).sum()
        slope = ((x - x.mean()) * part).sum() / sxx if sxx else 0.0
        fit.append(part.mean() + slope * (i - x.mean()))
        left = 1 - 1 / w - ((i - x.mean()) ** 2 / sxx if sxx else 0.0)
        error.append(abs(y[i] - fit[-1]) / left if left > 1e-9 else 0.0)
    return fit, error


def plain_smooth(y, spans=smoothing.SPANS):
    curves, errors = zip(*(plain_lines(y, s) for s in spans))
    means = [plain_lines(e, spans[1])[0] for e in errors]
    best = [spans[min(range(3), key=lambda k: (means[k][i], k))] for i in range(len(y))]
    mixed = []
    for i, s in enumerate(plain_lines(best, spans[1])[0]):
        off = min(max(s, spans[0]), spans[2]) - spans[1]
        share = off / (spans[2] - spans[1]) if off >= 0 else -off / (spans[1] - spans[0])
        mixed.append((1 - share) * curves[1][i] + share * curves[2 if off >= 0 else 0][i])
    return plain_lines(mixed, spans[0])[0]


@pytest.mark.parametrize("blocks", [None, 5])
def test_smooth_equals_plain(spark, blocks):
    rng = np.random.default_rng(3)
    series = {"hot": [float(math.sin(i * i / 4000) * 10 + rng.normal()) for i in range(211)], None: [float(v) for v in rng.normal(size=40)]}
    series |= {f"n{n}": [float(v) for v in rng.normal(size=n)] for n in range(1, 9)}
    data = [(k, i, v) for k, vs in series.items() for i, v in enumerate(vs)] + [("empty", i, None) for i in range(4)]
    df = spark.createDataFrame(data, "k string, t int, v double").repartition(4)
    rows = cleaning.numbered_values(df, ["k"], ["t"], blocks)
    got = {}
    for r in sorted(smoothing.variable_span_smooth(rows, ["k"], "__pos", "__len", "v", "smooth").collect(), key=lambda r: r["t"]):
        got.setdefault(r["k"], []).append(r["smooth"])
    assert got.pop("empty") == [None] * 4
    assert set(got) == set(series)
    for k, vs in series.items():
        assert got[k] == pytest.approx(plain_smooth(vs), abs=1e-9), k


def test_clean_by_span(spark):
    rng = np.random.default_rng(8)
    truth = [10 * math.sin(i / 20) for i in range(400)]
    seen = [t + float(rng.normal(0, 0.2)) for t in truth]
    for i in (50, 51, 200, 333):
        seen[i] += 60
    gaps = set(range(100, 110)) | {0, 399}
    data = [("hot", i, None if i in gaps else v, i) for i, v in enumerate(seen)] + [(None, i, 1.0, -i) for i in range(5)] + [("none", 0, None, 0)]
    df = spark.createDataFrame(data, "k string, t int, v double, other int").repartition(6)
    out = cleaning.clean_series_by_span(df, ["k"], ["t"], "v", blocks=5).collect()
    assert len(out) == 406 and set(out[0].asDict()) == {"k", "t", "v", "other", "cleaned", "cleaned_outlier"}
    hot = [r for r in out if r["k"] == "hot"]
    assert {r["t"] for r in hot if r["cleaned_outlier"]} >= {50, 51, 200, 333}
    assert sum(r["cleaned_outlier"] for r in hot) < 12
    assert max(abs(r["cleaned"] - truth[r["t"]]) for r in hot) < 2.5
    assert all(r["cleaned"] == r["v"] for r in hot if r["v"] is not None and not r["cleaned_outlier"])
    assert [r["cleaned"] for r in out if r["k"] is None] == [1.0] * 5
    assert [r["cleaned"] for r in out if r["k"] == "none"] == [None]


def test_clean_by_span_without_keys_or_rows(spark):
    df = spark.range(30).select(F.col("id").alias("t"), F.when(F.col("id") != 7, 2.0 * F.col("id")).alias("b"))
    got = sorted(cleaning.clean_columns(df, [], "t", ["b"], by_span=True).collect(), key=lambda r: r["t"])
    assert [r["b"] for r in got] == pytest.approx([2.0 * i for i in range(30)])
    assert cleaning.clean_series_by_span(df.limit(0), [], ["t"], "b").collect() == []
