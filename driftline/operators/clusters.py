"""Groups of similar rows, and how many of them there are.

The number of groups is judged by fits of all sizes at once: one job per iteration assigns the rows to the nearest centres of every fit, and tasks hand on sums per
(table, size, centre). Tables drawn for the gap statistic are further fits of the same job; their rows are functions of (row key, draw) and exist in the tasks only. What
the driver holds are centres and sums, as many as draws, sizes and columns ask for, whatever the number of rows.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml.clustering import BisectingKMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize
from .aggregate import with_scalars
from .resample import STEP, hex_number, key_text, mixed

cloudpickle.register_pickle_by_value(sys.modules[__name__])

FEATURES = "__features"
ROWS_AT_ONCE = 1024  # rows whose distances to the centres are held at a time
ITERATIONS = 10


def with_features(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Feature vector of numeric columns, or of one array column; rows with a NULL are left out."""
    rows = df.dropna(subset=list(cols))
    if len(cols) == 1 and rows.schema[cols[0]].dataType.typeName() == "array":
        return rows.withColumn(FEATURES, array_to_vector(F.col(cols[0]).cast("array<double>")))
    return VectorAssembler(inputCols=list(cols), outputCol=FEATURES).transform(rows)


def cluster(df: DataFrame, cols: Sequence[str], k: int = 3, seed: int = 123, bisecting: bool = False, iterations: int = ITERATIONS) -> DataFrame:
    """Rows with a ``cluster`` number from 0: of the nearest centre of :func:`fits`, or by splitting clusters in two, which replaces merging them one by one.

    Rows with a NULL (or, without ``bisecting``, a NaN) in ``cols`` are left out. ``seed`` matters for ``bisecting`` only: centres start from the rows.
    """
    rows = with_features(df, cols)
    if not bisecting:
        x = vector_to_array(FEATURES)
        rows = rows.filter(~F.exists(x, F.isnan))
        found = fits(points(rows.select(x.alias("x")), ["x"]), [k], iterations)
        if found is None:
            return rows.withColumn("cluster", F.lit(0)).drop(FEATURES)
        far = [F.aggregate(F.zip_with("__x", F.array(*[F.lit(v) for v in c]), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda t, v: t + v) for c in found[0][0].tolist()]
        near = rows.withColumn("__x", x).withColumn("__far", F.array(*far))
        return near.withColumn("cluster", (F.array_position("__far", F.array_min("__far")) - 1).cast("int")).drop(FEATURES, "__x", "__far")
    # the first split moves the centre by a share of its own length, so a centre at zero, as standardised
    # columns have, would never split: shift all rows alike, which leaves every distance as it is
    largest = F.array_max(F.transform(vector_to_array(FEATURES), lambda v: F.abs(v)))
    length = float(rows.agg(F.coalesce(F.max(largest), F.lit(1.0))).first()[0]) or 1.0
    moved = array_to_vector(F.transform(vector_to_array(FEATURES), lambda v: v + F.lit(length)))
    rows = rows.withColumn(FEATURES, moved)
    method = BisectingKMeans(k=k, seed=seed, featuresCol=FEATURES, predictionCol="cluster")
    return method.fit(rows).transform(rows).drop(FEATURES)


def points(df: DataFrame, cols: Sequence[str], row_key: Sequence[str] = (), seed: int = 0) -> DataFrame:
    """``x`` (array of doubles) and two seeds of the row key; rows with a NULL or NaN component are left out. The table is written."""
    wide = len(cols) == 1 and df.schema[cols[0]].dataType.typeName() == "array"
    x = F.col(cols[0]).cast("array<double>") if wide else F.array(*[F.col(c).cast("double") for c in cols])
    digest = F.md5(F.concat(key_text(row_key), F.lit(f"|{seed}"))) if row_key else F.md5(F.lit(""))
    rows = df.select(x.alias("x"), hex_number(F.substring(digest, 1, 8)).alias("s1"), hex_number(F.substring(digest, 9, 8)).alias("s2"))
    rows = rows.filter(F.col("x").isNotNull() & ~F.exists("x", lambda v: v.isNull() | F.isnan(v)))
    # a row with draws is as much work as the draws, so such rows are dealt out to all cores
    return materialize(rows.repartition(df.sparkSession.sparkContext.defaultParallelism) if row_key else rows)


def drawn(first: np.ndarray, second: np.ndarray, draw: int, box: tuple) -> np.ndarray:
    """Rows of reference table ``draw`` (from 1): uniform in the box of ``(mean, axes, low, high)``, whose sides run along the axes."""
    mean, axes, low, high = box
    d = len(mean)
    counters = ((draw * d + np.arange(d)) * STEP % 2**32).astype(np.uint32)
    bits = mixed(mixed(first[None] + counters[:, None]) + second[None])  # column by column, as distances are taken
    return (mean[:, None] + axes @ (low[:, None] + (high - low)[:, None] * (bits / 2.0**32))).T


def _per_task(rows: DataFrame, step: Callable, start: Callable, names: str, out: Callable) -> DataFrame:
    """Each task folds its blocks of ``(x, first, second)`` by ``step`` into what ``start`` makes and hands on the rows of ``out``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(0).flatten().to_numpy().reshape(batch.num_rows, -1)
            if len(np.unique(np.diff(batch.column(0).offsets))) > 1:
                raise ValueError("rows have different numbers of components")
            first, second = (batch.column(i).to_numpy().astype(np.uint32) for i in (1, 2))
            held = start(x.shape[1]) if held is None else held
            for low in range(0, len(x), ROWS_AT_ONCE):
                part = slice(low, low + ROWS_AT_ONCE)
                step(held, x[part], first[part], second[part])
        if held is not None:
            yield out(held)

    return rows.mapInArrow(run, names)


def _totals(rows: DataFrame, tables: Callable, shape: tuple, step: Callable) -> np.ndarray | None:
    """Sums over all rows of an array of ``shape`` (its last side the number of columns plus what ``step`` needs) per table."""

    def out(held: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.arange(held.size, dtype=np.int64)), pa.array(held.ravel())], names=["at", "v"])

    def fold(held, x, first, second):
        for t, points_ in tables(x, first, second):
            step(held[t], t, points_)

    sums = _per_task(rows, fold, lambda d: np.zeros(shape), "at bigint, v double", out).groupBy("at").agg(F.sum("v").alias("v")).collect()
    if not sums:
        return None
    total = np.zeros(int(np.prod(shape)))
    total[[r["at"] for r in sums]] = [r["v"] for r in sums]
    return total.reshape(shape)


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances (centres x rows), summed column by column in memory's order."""
    far = None
    for column, c in zip(np.ascontiguousarray(x.T), centres.T):
        apart = column[None] - c[:, None]
        apart *= apart
        far = apart if far is None else np.add(far, apart, out=far)
    return far


def _farthest(rows: DataFrame, tables: Callable, chosen: list[np.ndarray]) -> np.ndarray:
    """For each table the row farthest from the nearest of its ``chosen`` centres; of rows as far, the one with the largest coordinates."""

    def fold(held, x, first, second):
        for t, y in tables(x, first, second):
            d = _distances(y, chosen[t]).min(0)
            at = np.flatnonzero(d == d.max())
            best = max(([float(d[i])], y[i].tolist()) for i in at)
            held[t] = max(held[t], best) if t in held else best

    def out(held: dict) -> pa.RecordBatch:
        keys = list(held)
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array([held[t][0][0] for t in keys]), pa.array([held[t][1] for t in keys], pa.list_(pa.float64()))],
                                          names=["t", "d", "x"])

    found = _per_task(rows, fold, lambda d: {}, "t int, d double, x array<double>", out)
    best = found.groupBy("t").agg(F.max(F.struct("d", "x")).alias("m")).orderBy("t").collect()
    return np.array([r["m"]["x"] for r in best])


def fits(rows: DataFrame, sizes: Sequence[int], iterations: int = ITERATIONS, samples: int = 0, box: tuple | None = None) -> tuple[np.ndarray, np.ndarray] | None:
    """Centres and within sums of squares of fits of all ``sizes``, of the rows of :func:`points` and of ``samples`` tables drawn from ``box``.

    Centres start at the row farthest from the mean and go on with the row farthest from those before, so they depend on the rows alone; each iteration moves all centres of all fits
    to the mean of their rows, in one job. A centre without rows stays. Arrays are (table, centre, column), one size behind the other, and (table, size).
    """

    def tables(x: np.ndarray, first: np.ndarray, second: np.ndarray):
        yield 0, x
        for t in range(1, samples + 1):
            yield t, drawn(first, second, t, box)

    head = rows.first()
    if head is None:
        return None
    d, n_tables = len(head["x"]), samples + 1
    ends = np.cumsum(sizes)
    spans = [slice(end - k, end) for end, k in zip(ends.tolist(), sizes)]

    def summed(held, t, y):
        held[0] += len(y)
        held[1:] += y.sum(0)

    sums = _totals(rows, tables, (n_tables, d + 1), summed)
    means = sums[:, 1:] / sums[:, :1]
    chosen = [_farthest(rows, tables, list(means[:, None, :]))]
    while len(chosen) < max(sizes):
        chosen.append(_farthest(rows, tables, list(np.stack(chosen, 1))))
    first_centres = np.stack(chosen, 1)
    centres = np.concatenate([first_centres[:, :k] for k in sizes], 1)

    for turn in range(iterations + 1):
        sums = _totals(rows, tables, (n_tables, int(ends[-1]), d + 2), _assigned(centres, spans))
        n = sums[:, :, :1]
        moved = np.where(n > 0, sums[:, :, 2:] / np.maximum(n, 1), centres)
        if turn == iterations or np.allclose(moved, centres, rtol=1e-13, atol=1e-13):
            break
        centres = moved
    squares = np.stack([sums[:, span, 1].sum(1) for span in spans], 1)
    return centres, squares


def _assigned(centres: np.ndarray, spans: list[slice]) -> Callable:
    """Adds to each centre of each fit the number and the coordinates of the rows it is nearest to, of centres as near the first, and to each fit's first centre the squares of all rows."""

    def step(held, t, y):
        far = _distances(y, centres[t])
        mine = np.empty_like(far)
        for span in spans:
            part = far[span]
            near = part.min(0)
            own = part == near
            if np.count_nonzero(own) != len(y):  # some are as near to several
                own = np.arange(len(part))[:, None] == part.argmin(0)
            mine[span] = own
            held[span.start, 1] += near.sum()
        held[:, 0] += mine.sum(1)
        held[:, 2:] += mine @ y

    return step


def reference_box(rows: DataFrame) -> tuple | None:
    """``(mean, axes, low, high)``: the smallest box around the rows of :func:`points` whose sides run along their principal axes."""
    head = rows.first()
    if head is None:
        return None
    d = len(head["x"])
    own = lambda x, first, second: [(0, x)]

    def summed(held, t, y):
        held[0] += len(y)
        held[1:] += y.sum(0)

    sums = _totals(rows, own, (1, d + 1), summed)[0]
    mean = sums[1:] / sums[0]

    def products(held, t, y):
        held += (y - mean).T @ (y - mean)

    axes = np.linalg.eigh(_totals(rows, own, (1, d, d), products)[0])[1]

    def fold(held, x, first, second):
        z = (x - mean) @ axes
        held[0], held[1] = np.minimum(held[0], z.min(0)), np.maximum(held[1], z.max(0))

    out = lambda held: pa.RecordBatch.from_arrays([pa.array(np.arange(d), pa.int32()), pa.array(held[0]), pa.array(held[1])], names=["i", "lo", "hi"])
    ends = _per_task(rows, fold, lambda n: [np.full(n, np.inf), np.full(n, -np.inf)], "i int, lo double, hi double", out)
    ends = ends.groupBy("i").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).orderBy("i").collect()
    return mean, axes, np.array([r["lo"] for r in ends]), np.array([r["hi"] for r in ends])


def elbow(spark: SparkSession, df: DataFrame, cols: Sequence[str], k_max: int = 10, iterations: int = ITERATIONS) -> DataFrame:
    """``k, wss``: within-group sum of squares for 1 … ``k_max`` groups. An empty table gives no rows."""
    found = fits(points(df, cols), range(1, k_max + 1), iterations)
    wss = [] if found is None else found[1][0].tolist()
    return spark.createDataFrame([(k, w) for k, w in enumerate(wss, 1)], "k int, wss double")


def gap_statistic(spark: SparkSession, df: DataFrame, cols: Sequence[str], row_key: Sequence[str], k_max: int = 10,
                  samples: int = 100, seed: int = 123) -> DataFrame:
    """``k, log_w, expected, gap, se`` from ``samples`` reference tables, uniform in the box along the principal axes.

    Where the squares are zero, as for constant columns or as many clusters as distinct rows, there is no logarithm and what needs it is
    NULL. An empty table gives no rows. Rows that share a key draw the same numbers.
    """
    rows = points(df, cols, row_key, seed)
    box = reference_box(rows)
    squares = fits(rows, range(1, k_max + 1), ITERATIONS, samples, box)[1] if box else np.empty((0, 0))
    floor = 1e-12
    out = []
    for i in range(squares.shape[1]):
        seen, ref = squares[0, i], squares[1:, i]
        log_w = math.log(seen / 2) if seen > floor else None
        if log_w is None or not (ref > floor).all():
            out.append((i + 1, log_w, None, None, None))
            continue
        logs = np.log(ref / 2)
        mean, var = float(logs.mean()), float(((logs - logs.mean()) ** 2).sum() / max(samples - 1, 1))
        out.append((i + 1, log_w, mean, mean - log_w, math.sqrt((1 + 1 / samples) * var)))
    return spark.createDataFrame(out, "k int, log_w double, expected double, gap double, se double")


def pair_squares(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """``n, pairs, sum_sq, mean_sq`` per group: squared Euclidean distances over all pairs of its rows.

    Summed over all pairs, squared distances equal n times the squared distances to the mean, so
    no pair is formed: one aggregate, exact for any group size.
    """
    moments = reduce(lambda a, b: a + b, [F.var_pop(c) * F.count(c) for c in cols])
    out = df.dropna(subset=list(cols)).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), moments.alias("__ss"))
    return out.select(
        *keys,
        "n",
        (F.col("n") * (F.col("n") - 1) / 2).cast("long").alias("pairs"),
        (F.col("n") * F.col("__ss")).alias("sum_sq"),
        F.try_divide(2 * F.col("__ss"), F.col("n") - 1).alias("mean_sq"),
    )


def centroid_distance(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """``n, distance`` per group: Euclidean distance of its mean to the mean of all rows."""
    rows = df.dropna(subset=list(cols))
    means = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in cols])
    means = with_scalars(means, rows, **{c: F.avg(c) for c in cols})
    s = F.col("__s")
    gap = reduce(lambda a, b: a + b, [F.pow(F.col(c) - s[c], 2) for c in cols])
    return means.select(*keys, "n", F.sqrt(gap).alias("distance"))
