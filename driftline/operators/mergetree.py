"""Trees of merged clusters (Ward's criterion) for tables of any size.

Merging is sequential, so it runs over a bounded number of cells. A cell is what rows can be summed up to and merged by: their number, mean and
sum of squares. Where the table has few different points, each is a cell and the tree is exact; otherwise cells are those of the
finest halving of the columns' ranges of which few enough hold rows, and the tree is the one that starts from them. Rows get their cluster by their cell.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize

CELLS = 1024  # cells at most; they are what reaches the driver, and all that does
FINEST = 20  # halvings of a column's range that are tried
SLACK = 1.1  # by how much a count estimate may be above the truth

TREE = "step int, a int, b int, height double, n bigint, wss double"


def _complete(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Written rows whose ``cols`` are all finite numbers, as ``row`` beside ``x0, x1, …``; no name of ``df`` meets a helper's."""
    xs = [F.col(c).cast("double") for c in cols]
    rows = df.select(F.struct(*df.columns).alias("row"), *[x.alias(f"x{i}") for i, x in enumerate(xs)])
    for i in range(len(xs)):
        rows = rows.filter(F.col(f"x{i}").isNotNull() & (F.abs(f"x{i}") < float("inf")))
    return materialize(rows)


def _cells(rows: DataFrame, d: int, cells: int) -> tuple[list[Column], np.ndarray, np.ndarray, np.ndarray] | None:
    """Expressions of a row's cell, and of each cell its key, its ``(n, squares)`` and its mean, by mean; ``None`` without rows."""
    x = [F.col(f"x{i}") + F.lit(0.0) for i in range(d)]
    few = rows.select(*x).distinct().limit(cells + 1).count()
    if not few:
        return None
    choices = [x]
    if few > cells:
        ends = rows.agg(*[f(c).alias(f"{n}{i}") for i, c in enumerate(x) for n, f in (("lo", F.min), ("hi", F.max))]).first()

        def halved(b: int) -> list[Column]:
            # halves first: the range of two finite numbers need not be finite
            part = lambda i: ((x[i] / 2 - ends[f"lo{i}"] / 2) / (ends[f"hi{i}"] / 2 - ends[f"lo{i}"] / 2))
            return [F.floor(F.least(part(i) * 2**b, F.lit(2.0**b - 1))).cast("long") if ends[f"hi{i}"] > ends[f"lo{i}"] else F.lit(0).cast("long") for i in range(d)]

        guess = rows.agg(*[F.approx_count_distinct(F.xxhash64(*halved(b))).alias(str(b)) for b in range(FINEST + 1)]).first()
        choices = [halved(b) for b in range(FINEST, -1, -1) if b == 0 or guess[str(b)] <= cells * SLACK]
    for keys in choices:
        named = [k.alias(f"k{i}") for i, k in enumerate(keys)]
        sums = [F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(x)], *[F.var_pop(c).alias(f"v{i}") for i, c in enumerate(x)]]
        found = rows.select(*named, *[c.alias(f"x{i}") for i, c in enumerate(x)]).groupBy(*[f"k{i}" for i in range(d)]).agg(*sums).limit(cells + 1).collect()
        if len(found) <= cells:
            break
    found.sort(key=lambda r: [r[f"m{i}"] for i in range(d)])
    held = np.array([[r["n"], r["n"] * sum(r[f"v{i}"] for i in range(d))] for r in found])
    return keys, [[r[f"k{i}"] for i in range(d)] for r in found], held, np.array([[r[f"m{i}"] for i in range(d)] for r in found])


def ward_merges(n: np.ndarray, means: np.ndarray) -> list[tuple[int, int, float, int]]:
    """``(a, b, height, rows)`` of all merges: ``b`` goes into ``a``, the smaller number, and is no more.

    Each merge is the one that adds least to the sum of squares; a height is the root of twice what it adds, which for two single rows is their distance.
    """
    n, means = n.astype(float).copy(), means.astype(float).copy()
    cost = n[:, None] * n[None] / (n[:, None] + n[None]) * ((means[:, None] - means[None]) ** 2).sum(-1)
    cost[np.tril_indices(len(n))] = np.inf
    out = []
    for _ in range(len(n) - 1):
        a, b = np.unravel_index(np.argmin(cost), cost.shape)
        height = float(np.sqrt(2 * cost[a, b]))
        means[a] = (n[a] * means[a] + n[b] * means[b]) / (n[a] + n[b])
        n[a] += n[b]
        out.append((int(a), int(b), height, int(n[a])))
        cost[b], cost[:, b] = np.inf, np.inf
        n[b] = 0
        there = np.flatnonzero(n)
        fresh = n[a] * n[there] / (n[a] + n[there]) * ((means[a] - means[there]) ** 2).sum(-1)
        cost[there[there < a], a] = fresh[there < a]
        cost[a, there[there > a]] = fresh[there > a]
    return out


def merge_tree(df: DataFrame, cols: Sequence[str], cells: int = CELLS) -> DataFrame:
    """``step, a, b, height, n, wss``: the merges of a tree by Ward's criterion, from 1; at most ``cells - 1`` rows.

    ``a`` and ``b`` number cells in the order of their means; a merged cluster keeps the smaller number. ``n`` counts rows, ``wss`` is the
    sum of squares inside all clusters after the merge. What lies inside cells before the first is part of it: ``wss - height² / 2`` at step 1 is 0
    in an exact tree, else the stated error. Equal points are one cell from the start. Rows with a NULL, NaN or infinite value in ``cols`` are left out.
    """
    found = _cells(_complete(df, cols), len(cols), cells)
    out = []
    if found is not None:
        _, _, held, means = found
        wss = float(held[:, 1].sum())
        for step, (a, b, height, n) in enumerate(ward_merges(held[:, 0], means), 1):
            wss += height * height / 2
            out.append((step, a, b, height, n, wss))
    return df.sparkSession.createDataFrame(out, TREE)


def merge_cut(df: DataFrame, cols: Sequence[str], k: int = 3, cells: int = CELLS) -> DataFrame:
    """Rows of ``df`` with ``cluster``, the tree of :func:`merge_tree` cut into ``k``; a column of that name is replaced.

    Numbers run from 0 in the order of each cluster's first cell; there are fewer than ``k`` if there are fewer cells.
    """
    spark, rows = df.sparkSession, _complete(df.drop("cluster"), cols)
    own = [F.col("row")[c].alias(c) for c in df.columns if c != "cluster"]
    found = _cells(rows, len(cols), cells)
    if found is None:
        return rows.select(*own, F.lit(0).alias("cluster"))
    keys, at, held, means = found
    root = list(range(len(at)))
    for a, b, *_ in ward_merges(held[:, 0], means)[: max(len(at) - k, 0)]:
        root = [a if r == b else r for r in root]
    number = {r: i for i, r in enumerate(sorted(set(root)))}
    names = [f"k{i}" for i in range(len(cols))]
    kind = "double" if isinstance(at[0][0], float) else "bigint"
    table = spark.createDataFrame([(*c, number[r]) for c, r in zip(at, root)], ", ".join(f"{c} {kind}" for c in names) + ", number int")
    # bounded by `cells`
    met = rows.select("row", *[e.alias(c) for e, c in zip(keys, names)]).join(F.broadcast(table), names)
    return met.select(*own, F.col("number").alias("cluster"))
