"""Ward trees against merging by definition."""

import numpy as np
import pytest

from driftline.operators import mergetree


def squares(points):
    return ((points - points.mean(0)) ** 2).sum()


def plain_ward(points):
    """Sizes and heights of merges, and the sets after each; every cost from the rows themselves."""
    sets, out = [[i] for i in range(len(points))], []
    while len(sets) > 1:
        cost, i, j = min((squares(points[a + b]) - squares(points[a]) - squares(points[b]), i, j)
                         for i, a in enumerate(sets) for j, b in enumerate(sets) if i < j)
        sets = [s for t, s in enumerate(sets) if t not in (i, j)] + [sets[i] + sets[j]]
        out.append((len(sets[-1]), float(np.sqrt(2 * max(cost, 0))), {frozenset(s) for s in sets}))
    return out


def test_exact_tree_and_cut(spark):
    p = np.random.default_rng(4).normal(size=(30, 2))
    want = plain_ward(p)
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(p)] + [(99, None, 1.0), (98, float("nan"), 1.0), (97, float("inf"), 0.0)],
                               "row int, k0 double, x0 double").repartition(4)
    tree = sorted(mergetree.merge_tree(df, ["k0", "x0"]).collect(), key=lambda r: r["step"])
    assert [r["n"] for r in tree] == [w[0] for w in want]
    assert [r["height"] for r in tree] == pytest.approx([w[1] for w in want])
    assert tree[-1]["wss"] == pytest.approx(squares(p)) and tree[0]["wss"] == pytest.approx(tree[0]["height"] ** 2 / 2)
    for k in (1, 3):
        sets = {}
        for r in mergetree.merge_cut(df, ["k0", "x0"], k).collect():
            sets.setdefault(r["cluster"], set()).add(r["row"])
        assert set(sets) == set(range(k)) and {frozenset(s) for s in sets.values()} == want[len(p) - k - 1][2]


def test_cells_beyond_the_bound(spark):
    rng = np.random.default_rng(5)
    p = np.concatenate([rng.normal(c, 0.3, size=(400, 2)) for c in ((0, 0), (6, 0), (0, 6))])
    df = spark.createDataFrame([(i, i // 400, *map(float, v)) for i, v in enumerate(p)], "i int, true int, x double, y double")
    tree = sorted(mergetree.merge_tree(df, ["x", "y"], cells=64).collect(), key=lambda r: r["step"])
    assert 3 < len(tree) < 64 and tree[-1]["n"] == 1200 and tree[-1]["wss"] == pytest.approx(squares(p))
    within = tree[0]["wss"] - tree[0]["height"] ** 2 / 2
    assert 0 < within < 0.05 * squares(p)
    got = mergetree.merge_cut(df, ["x", "y"], 3, cells=64).collect()
    assert len(got) == 1200 and len({(r["true"], r["cluster"]) for r in got}) == 3


def test_equal_points_few_points_and_none(spark):
    df = spark.createDataFrame([(0.0,)] * 50 + [(-0.0,)] * 10 + [(3.0,)] * 20, "x double")
    tree = mergetree.merge_tree(df, ["x"]).collect()
    assert [(r["a"], r["b"], r["n"]) for r in tree] == [(0, 1, 80)] and tree[0]["wss"] == pytest.approx(60 * 20 / 80 * 9)
    assert sorted((r["x"], r["cluster"]) for r in mergetree.merge_cut(df, ["x"], 3).distinct().collect()) == [(0.0, 0), (3.0, 1)]
    assert mergetree.merge_tree(df.limit(0), ["x"]).collect() == [] and mergetree.merge_cut(df.limit(0), ["x"]).collect() == []
