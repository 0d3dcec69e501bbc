"""Kernel densities and normal curves per group."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tails import let, normal_density
from ..session import materialize
from .joins import attach, null_safe_join
from .ordered import quantiles_of_ranks, ranks_of_counts, value_counts


def bandwidths(counts: DataFrame, keys: Sequence[str], value: str, blocks: int | None = None) -> DataFrame:
    """``n, lo, hi, bw`` per group of counted values; bw is 0.9 times the smaller of sd and IQR / 1.34, times n to the -1/5."""
    cnt, v = F.col("cnt"), F.col(value)
    # deviations from the group's own mean: sums around one centre for all would cancel in a group far from it
    centres = counts.groupBy(*keys).agg((F.sum(cnt * v) / F.sum(cnt)).alias("__mean"))
    d = v - F.col("__mean")
    stats = attach(counts, centres, list(keys)).groupBy(*keys).agg(
        F.sum(cnt).alias("n"), F.min(v).alias("lo"), F.max(v).alias("hi"),
        F.sum(cnt * d).alias("__s1"), F.sum(cnt * d * d).alias("__s2"),
    )
    ranked = ranks_of_counts(counts, keys, value, blocks)
    q = quantiles_of_ranks(ranked, keys, value, {"__q1": 0.25, "__q3": 0.75}).drop("n")
    both = null_safe_join(stats, q, list(keys))
    n = F.col("n")
    spread = F.greatest(F.lit(0.0), F.col("__s2") - F.col("__s1") * F.col("__s1") / n)
    sd = F.coalesce(F.sqrt(F.try_divide(spread, n - 1)), F.lit(0.0))
    iqr = (F.col("__q3") - F.col("__q1")) / 1.34
    width = (
        F.when(F.least(sd, iqr) > 0, F.least(sd, iqr))
        .when(sd > 0, sd)
        .when(F.col("lo") != 0, F.abs(F.col("lo")))
        .otherwise(1.0)
    )
    return both.withColumn("bw", 0.9 * width * F.pow(n.cast("double"), F.lit(-0.2))).select(*keys, "n", "lo", "hi", "bw")


def kernel_density(df: DataFrame, keys: Sequence[str], value: str, points: int = 512, cut: float = 3.0,
                   blocks: int | None = None) -> DataFrame:
    """Gaussian kernel density at ``points`` equally spaced x per group: ``keys, i, x, y``.

    Values are spread linearly over the two nearest of ``points`` grid positions, which reaches 4 bandwidths
    beyond the output range, and only those at most ``points`` sums per group are kept. The kernel
    is applied to the sums inside one row per group, and y is read off linearly between grid positions.
    The data rows are read once, to count equal values.
    """
    last = points - 1
    counts = materialize(value_counts(df, keys, value))
    params = bandwidths(counts, keys, value, blocks).withColumns(
        {
            "x0": F.col("lo") - cut * F.col("bw"),
            "step": (F.col("hi") - F.col("lo") + 2 * cut * F.col("bw")) / last,
            "g0": F.col("lo") - (cut + 4) * F.col("bw"),
            "gstep": (F.col("hi") - F.col("lo") + 2 * (cut + 4) * F.col("bw")) / last,
        }
    ).select(*keys, "n", "bw", "x0", "step", "g0", "gstep")
    rows = attach(counts, params, keys, "inner")
    at = (F.col(value) - F.col("g0")) / F.col("gstep")
    share = at - F.floor(at)
    shape = ["n", "bw", "x0", "step", "g0", "gstep"]
    spread = rows.select(
        *keys,
        *shape,
        F.inline(
            F.array(
                F.struct(F.floor(at).cast("int").alias("ix"), (F.col("cnt") * (1 - share)).alias("w")),
                F.struct((F.floor(at) + 1).cast("int").alias("ix"), (F.col("cnt") * share).alias("w")),
            )
        ),
    )
    bins = spread.groupBy(*keys, *shape, "ix").agg(F.sum("w").alias("w"))
    packed = bins.groupBy(*keys, *shape).agg(F.sort_array(F.collect_list(F.struct("ix", "w"))).alias("bins"))

    z = F.col("gstep") / F.col("bw")
    norm = F.col("n") * F.col("bw") * math.sqrt(2 * math.pi)
    grid = F.transform(
        F.sequence(F.lit(0), F.lit(last)),
        lambda g: F.aggregate(
            F.col("bins"), F.lit(0.0), lambda acc, b: acc + b["w"] * F.exp(-F.pow((g - b["ix"]) * z, 2) / 2)
        ) / norm,
    )

    def curve(dens):
        def point(i):
            x = F.col("x0") + F.col("step") * i
            pos = (x - F.col("g0")) / F.col("gstep")
            left = F.least(F.floor(pos).cast("int"), F.lit(last - 1))
            y0, y1 = F.element_at(dens, left + 1), F.element_at(dens, left + 2)
            return F.struct(i.alias("i"), x.alias("x"), (y0 + (pos - left) * (y1 - y0)).alias("y"))

        return F.transform(F.sequence(F.lit(0), F.lit(last)), point)

    return packed.select(*keys, F.inline(let(grid, curve)))


def peak_density(curves: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Largest density per group."""
    return curves.groupBy(*keys).agg(F.max("y").alias("max_density"))


def normal_curves(stats: DataFrame, keys: Sequence[str], mean: str = "mean", sd: str = "sd", points: int = 200,
                  sigmas: float = 4.0) -> DataFrame:
    """Normal density of each group's mean and sd at ``points`` x over ``sigmas`` sd either side."""
    m, s = F.col(mean), F.col(sd)
    x = m - sigmas * s + F.col("i") * (2 * sigmas / (points - 1)) * s
    return (
        stats.select(*keys, mean, sd)
        .filter(s > 0)
        .withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
        .withColumn("x", x)
        .withColumn("y", normal_density(F.col("x"), m, s))
    )
