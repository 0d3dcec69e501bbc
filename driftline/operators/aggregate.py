"""Grouped summaries."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.missing import floor_at, percent_difference
from .joins import attach, null_safe_join
from .ordered import quantiles


def means(df: DataFrame, keys: Sequence[str], cols: Sequence[str], suffix: str = "") -> DataFrame:
    """Mean of each column per group, ignoring NULL; NULL for a group without values."""
    return df.groupBy(*keys).agg(*[F.avg(c).alias(c + suffix) for c in cols])


def maxima(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.max(c).alias(c) for c in cols])


def long_means(df: DataFrame, keys: Sequence[str], value: str, name: str = "value") -> DataFrame:
    """Mean of a long-form value; groups without any value do not appear."""
    return df.filter(F.col(value).isNotNull()).groupBy(*keys).agg(F.avg(value).alias(name))


def mean_min_max(df: DataFrame, keys: Sequence[str], avg: str, low: str, high: str, prefix: str = "") -> DataFrame:
    """Mean of one column, minimum of a second and maximum of a third in one pass."""
    return df.groupBy(*keys).agg(
        F.avg(avg).alias(f"{prefix}mean"), F.min(low).alias(f"{prefix}min"), F.max(high).alias(f"{prefix}max")
    )


def means_and_sds(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    aggs = [F.avg(c).alias(f"{c}_mean") for c in cols] + [F.stddev_samp(c).alias(f"{c}_sd") for c in cols]
    return df.groupBy(*keys).agg(*aggs)


def pooled_mean(cols: Sequence[str]) -> Column:
    """Aggregate expression: mean of all values of several columns taken together."""
    total = reduce(lambda a, b: a + b, [F.coalesce(F.sum(c), F.lit(0.0)) for c in cols])
    count = reduce(lambda a, b: a + b, [F.count(c) for c in cols])
    return F.try_divide(total, count)


def with_scalars(df: DataFrame, of: DataFrame | None = None, **aggs: Column) -> DataFrame:
    """Every row with the struct column ``__s`` of aggregates over the whole table, or over the table ``of``.

    One scalar subquery, held in one column, so that expressions which use several aggregates share it. The table is
    read for the aggregates and for the rows: write it first where it is itself the result of an aggregate.
    """
    one = (of if of is not None else df).agg(F.struct(*[e.alias(n) for n, e in aggs.items()]).alias("s"))
    return df.withColumn("__s", one.scalar())


def distinct_rows(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.select(*cols).distinct()


def levels(df: DataFrame, col: str) -> DataFrame:
    """Distinct non-NULL values in order."""
    return df.select(col).filter(F.col(col).isNotNull()).distinct().orderBy(col)


def row_counts(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def date_range(df: DataFrame, date: str) -> DataFrame:
    return df.agg(F.min(date).alias("first"), F.max(date).alias("last"))


def five_numbers(df: DataFrame, keys: Sequence[str], value: str, reach: float = 1.5, blocks: int | None = None):
    """Box summary per group: quartiles, fences, whisker ends inside the fences, count of outliers."""
    q = quantiles(df, keys, value, {"q1": 0.25, "median": 0.5, "q3": 0.75}, blocks)
    iqr = F.col("q3") - F.col("q1")
    q = q.withColumns({"fence_low": F.col("q1") - reach * iqr, "fence_high": F.col("q3") + reach * iqr})
    v = F.col(value)
    rows = attach(df.select(*keys, value).filter(v.isNotNull()), q, keys, "inner" if keys else "left")
    inside = (v >= F.col("fence_low")) & (v <= F.col("fence_high"))
    box = ["n", "q1", "median", "q3", "fence_low", "fence_high"]
    return rows.groupBy(*keys).agg(
        *[F.max(c).alias(c) for c in box],
        F.min(F.when(inside, v)).alias("whisker_low"),
        F.max(F.when(inside, v)).alias("whisker_high"),
        F.sum(F.when(inside, F.lit(0)).otherwise(F.lit(1))).alias("outliers"),
    )


def box_outliers(df: DataFrame, keys: Sequence[str], value: str, reach: float = 1.5, blocks: int | None = None):
    """The rows beyond the fences of :func:`five_numbers`."""
    q = quantiles(df, keys, value, {"__q1": 0.25, "__q3": 0.75}, blocks).drop("n")
    v, iqr = F.col(value), F.col("__q3") - F.col("__q1")
    out = (v < F.col("__q1") - reach * iqr) | (v > F.col("__q3") + reach * iqr)
    return attach(df, q, keys, "inner").filter(out).drop("__q1", "__q3")


def threshold_band(df: DataFrame, keys: Sequence[str], value: str, sigmas: float = 3.0, low_limit: float = 0.0):
    """Mean and sample sd per group with a band of ``sigmas`` sd; the lower end never falls below ``low_limit``."""
    stats = df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    return stats.withColumns(
        {
            "thresh_low": floor_at(F.col("mean") - sigmas * F.col("sd"), low_limit),
            "thresh_high": F.col("mean") + sigmas * F.col("sd"),
        }
    )


def flag_outside_band(df: DataFrame, band: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Rows with a flag that is true where the value lies outside its group's band."""
    v = F.col(value)
    b = band.select(*keys, "thresh_low", "thresh_high")
    return attach(df, b, keys).withColumn("outside", (v < F.col("thresh_low")) | (v > F.col("thresh_high")))


def add_deviation(df: DataFrame, value: str, name: str = "prop") -> DataFrame:
    """Deviation of each aggregated row from the mean of all rows, as a share of that mean."""
    mean = F.col("__s.mean")
    rows = with_scalars(df, mean=F.avg(value))
    return rows.withColumn(name, F.try_divide(F.col(value) - mean, mean)).drop("__s")


def against_history(df: DataFrame, keys: Sequence[str], value: str, current: Column, names=("history", "current")):
    """Mean of the current rows, of all others, and the percent difference, in one pass."""
    hist, cur = names
    return (
        df.groupBy(*keys)
        .agg(F.avg(F.when(~current, F.col(value))).alias(hist), F.avg(F.when(current, F.col(value))).alias(cur))
        .withColumn("percent_diff", percent_difference(F.col(cur), F.col(hist)))
    )


def with_history(history: DataFrame, current: DataFrame, keys: Sequence[str], value: str = "mean") -> DataFrame:
    """The two-table form: left join of current means to history means and their percent difference."""
    cur = current.withColumnRenamed(value, "current")
    return null_safe_join(history.withColumnRenamed(value, "history"), cur, list(keys)).withColumn(
        "percent_diff", percent_difference(F.col("current"), F.col("history"))
    )
