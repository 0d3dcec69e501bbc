"""Yearly means against a baseline, and ranked years."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.missing import row_mean
from ..session import materialize
from .aggregate import add_deviation, pooled_mean
from .ranking import average_rank


def yearly_pooled(df: DataFrame, year: str, cols: Sequence[str], name: str = "mean") -> DataFrame:
    """Mean of all values of several columns per year."""
    return df.groupBy(year).agg(pooled_mean(cols).alias(name))


def baseline_anomaly(yearly: DataFrame, year: str, value: str, first: int, last: int, target: int | None = None):
    """Yearly rows (or only ``target``) with the mean of the baseline years and the difference to it.

    The baseline runs over ``first`` … ``last`` inclusive and may contain the target.
    """
    base = yearly.filter(F.col(year).between(first, last)).agg(F.avg(value)).scalar()
    rows = yearly.filter(F.col(year) == target) if target is not None else yearly
    return rows.withColumn("baseline", base).withColumn("diff", F.col(value) - F.col("baseline"))


def ranked_years(df: DataFrame, year: str, value, name: str = "value", descending: bool = False,
                 blocks: int | None = None) -> DataFrame:
    """Yearly mean, its deviation from the mean of the yearly means and its rank.

    ``value`` is a column name or a list of names; with a list, each row's mean over them is taken first.
    """
    one = F.col(value) if isinstance(value, str) else row_mean([F.col(c) for c in value])
    yearly = materialize(df.groupBy(year).agg(F.avg(one).alias(name)))
    return average_rank(add_deviation(yearly, name), [], name, descending=descending, blocks=blocks)
