"""Joins of model-level tables onto data rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize


def same_keys(left: DataFrame, right: DataFrame, pairs: Sequence[tuple[str, str]]) -> Column:
    """Null-safe equality on all pairs: a missing key matches a missing key."""
    return reduce(lambda a, b: a & b, [left[l].eqNullSafe(right[r]) for l, r in pairs])


def null_safe_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left", small: bool = False):
    """Equi-join in which NULL keys match each other; keeps the key columns of ``left``.

    Without keys, ``right`` is a table of one row and its values go onto every row.
    """
    if not on:
        row = right.select(F.struct(*right.columns).alias("r")).scalar()
        return left.withColumns({c: row[c] for c in right.columns})
    renamed = right.withColumnsRenamed({k: f"__r_{k}" for k in on})
    side = F.broadcast(renamed) if small else renamed
    cond = same_keys(left, renamed, [(k, f"__r_{k}") for k in on])
    return left.join(side, cond, how).drop(*[f"__r_{k}" for k in on])


def attach(
    rows: DataFrame,
    table: DataFrame,
    on: Sequence[str],
    how: str = "left",
) -> DataFrame:
    """Join an aggregate or a model table to the rows it was made from.

    The table is written once, so it is not computed again and the planner sees its real size: below the session's broadcast
    threshold it goes to the data rows, above it both sides are shuffled, where adaptive execution splits the partition of a hot key.
    """
    return null_safe_join(rows, materialize(table), list(on), how)


def suffixed_left_join(
    left: DataFrame, right: DataFrame, on: Sequence[str], suffixes: tuple[str, str] = (".x", ".y")
) -> DataFrame:
    """Left join of two aggregates; columns both sides have get a suffix each."""
    shared = [c for c in left.columns if c in right.columns and c not in on]
    return null_safe_join(
        left.withColumnsRenamed({c: c + suffixes[0] for c in shared}),
        right.withColumnsRenamed({c: c + suffixes[1] for c in shared}),
        list(on),
    )


def join_coordinates(rows: DataFrame, points: DataFrame, on: str = "site") -> DataFrame:
    """Add point coordinates and keep only rows whose name has a point."""
    return attach(rows, points, [on], "inner").filter(F.col("lat").isNotNull())


def daily_weather(weather: DataFrame, time: str = "datetime", values: Sequence[str] = ("station_temp",)) -> DataFrame:
    """Hourly readings to daily means, with the smallest and largest reading and the reading count.

    Days are those of zone-less timestamps as they stand; instants fall into days of the session time zone.
    """
    aggs = []
    for v in values:
        aggs += [
            F.avg(v).alias(v),
            F.min(v).alias(f"{v}_min"),
            F.max(v).alias(f"{v}_max"),
            F.count(v).alias(f"{v}_n"),
        ]
    return weather.groupBy(F.to_date(time).alias("date")).agg(*aggs)


def weather_join(weather: DataFrame, rows: DataFrame, time: str = "datetime", value: str = "station_temp",
                 date: str = "date", predictor: str | None = None) -> DataFrame:
    """Left join of the daily station mean to dated rows, also under the name ``predictor`` if one is given."""
    daily = daily_weather(weather, time, [value]).select(F.col("date").alias(date), F.col(value))
    out = attach(rows, daily, [date])
    return out.withColumn(predictor, F.col(value)) if predictor else out
