"""Ranks, false-discovery adjustment, scaling and edge groups."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .aggregate import with_scalars
from .joins import attach, null_safe_join
from .ordered import distinct_ranks, ordered_blocks, running, value_counts


def average_rank(df: DataFrame, keys: Sequence[str], value: str, name: str = "rank", descending: bool = False,
                 blocks: int | None = None) -> DataFrame:
    """Rank within the group with ties averaged; NULL values get a NULL rank."""
    return average_ranks(df, keys, value, {name: descending}, blocks)


def average_ranks(df: DataFrame, keys: Sequence[str], value: str, names: Mapping[str, bool], blocks: int | None = None) -> DataFrame:
    """Ranks in several directions, ``names`` maps columns to whether they descend, from one index of counted values and one join."""
    ranks = distinct_ranks(df, keys, value, blocks)
    up, down = F.col("below"), F.col("total") - F.col("below") - F.col("cnt")
    middle = (F.col("cnt") + 1) / 2.0
    made = [((down if descending else up) + middle).alias(name) for name, descending in names.items()]
    return null_safe_join(df, ranks.select(*keys, value, *made), [*keys, value])


def adjust_fdr(df: DataFrame, p: str, name: str = "p_adj", family: Sequence[str] = (), blocks: int | None = None):
    """Benjamini-Hochberg adjusted p, over all rows or per family; NULL p stays NULL and does not count."""
    cut = ordered_blocks(value_counts(df, family, p), family, [p], blocks)
    cnt = F.col("cnt")
    ranked = running(cut, family, [p], {"__up": ("sum", cnt, "up"), "__tests": ("sum", cnt, "all")})
    smallest = running(ranked, family, [p], {"__adj": ("min", F.col(p) * F.col("__tests") / F.col("__up"), "down")})
    adjusted = smallest.select(*family, p, F.least(F.lit(1.0), F.col("__adj")).alias(name))
    return null_safe_join(df, adjusted, [*family, p])


def zscores(df: DataFrame, cols: Sequence[str], suffix: str = "") -> DataFrame:
    """Columns minus their mean, divided by their sample sd, over the whole table."""
    stats = {}
    for c in cols:
        stats |= {f"{c}_m": F.avg(c), f"{c}_s": F.stddev_samp(c)}
    s = F.col("__s")
    scaled = {c + suffix: F.try_divide(F.col(c) - s[f"{c}_m"], s[f"{c}_s"]) for c in cols}
    return with_scalars(df, **stats).withColumns(scaled).drop("__s")


def rescale(df: DataFrame, value, name: str, low: float, high: float) -> DataFrame:
    """Linear map of an expression's whole range to ``low`` … ``high``; the middle where the range is empty."""
    s = F.col("__s")
    span = s["hi"] - s["lo"]
    scaled = F.when(span == 0, F.lit((low + high) / 2)).otherwise(F.lit(low) + (value - s["lo"]) / span * (high - low))
    rows = with_scalars(df, lo=F.min(value), hi=F.max(value))
    return rows.withColumn(name, F.when(value.isNotNull(), scaled)).drop("__s")


def drop_edges(df: DataFrame, order: str, keys: Sequence[str] = (), first: bool = True, last: bool = False):
    """Leave out the rows of the first and / or last value of ``order``, overall or per key.

    These are the incomplete years at the ends of a record. Nothing is left where there are too few values.
    ``df`` holds aggregates; it is written, since it is read for the ends and for the rows.
    """
    df = materialize(df)
    ends = [F.min(order).alias("__first"), F.max(order).alias("__last")]
    if keys:
        rows = attach(df, df.groupBy(*keys).agg(*ends), keys)
        lo, hi = F.col("__first"), F.col("__last")
    else:
        rows, lo, hi = with_scalars(df, lo=F.min(order), hi=F.max(order)), F.col("__s.lo"), F.col("__s.hi")
    if first:
        rows = rows.filter(F.col(order) > lo)
    if last:
        rows = rows.filter(F.col(order) < hi)
    return rows.drop("__first", "__last", "__s")
