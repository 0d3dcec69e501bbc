"""Interpolation, outlier replacement and clamping of series."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.missing import cap_at, floor_at
from ..session import materialize
from .joins import attach, null_safe_join
from .ordered import BLOCK, centred_window, ordered_blocks, quantiles, running
from .reshape import to_long, to_wide
from .smoothing import variable_span_smooth


# Fixed value: residuals with a smaller interquartile range count as constant, and nothing is replaced.
FLAT = 1e-14


def numbered_values(df: DataFrame, keys: Sequence[str], order: Sequence[str], blocks: int | None) -> DataFrame:
    ordered = ordered_blocks(df, keys, order, blocks)
    one = F.lit(1).cast("long")
    return running(ordered, keys, order, {"__pos": ("sum", one, "up"), "__len": ("sum", one, "all")})


def array_median(values: Column) -> Column:
    ranked = F.sort_array(values)
    low, high = F.floor((F.size(values) - 1) / 2), F.floor(F.size(values) / 2)
    return (F.get(ranked, low.cast("int")) + F.get(ranked, high.cast("int"))) / 2


def array_mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, v: total + v) / F.size(values)


def symmetric_part(values: Column, half_width: int) -> Column:
    """The middle of a frame's values that reaches equally far to both sides, also at the ends of the series."""
    before = F.least(F.lit(half_width), F.col("__pos") - 1).cast("int")
    reach = F.least(before, F.col("__len") - F.col("__pos")).cast("int")
    return F.slice(values, before - reach + 1, 2 * reach + 1)


def interpolate_numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str], axis: str, value: str, name: str):
    """Linear interpolation on rows that already carry a block; see :func:`interpolate`."""
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(axis).cast("double").alias("a"), F.col(value).alias("v")))
    rows = running(df, keys, order, {"__prev": ("max", known, "up"), "__next": ("min", known, "down")})
    a0, v0, a1, v1 = F.col("__prev.a"), F.col("__prev.v"), F.col("__next.a"), F.col("__next.v")
    between = v0 + (v1 - v0) * (F.col(axis).cast("double") - a0) / (a1 - a0)
    filled = (
        F.when(F.col(value).isNotNull(), F.col(value))
        .when(v0.isNull(), v1)
        .when(v1.isNull() | (a0 == a1), v0)
        .otherwise(between)
    )
    return rows.withColumn(name, filled).drop("__prev", "__next")


def interpolate(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str | None = None,
                axis: str | None = None, blocks: int | None = None) -> DataFrame:
    """Fill NULLs linearly between the nearest known values of the series; the ends repeat the nearest one.

    Distance is counted in rows of the series, or along the numeric column ``axis``, which has to
    increase with ``order``.
    """
    rows = numbered_values(df, keys, order, blocks)
    out = interpolate_numbered(rows, keys, order, axis or "__pos", value, name or value)
    return out.drop("__pos", "__len", BLOCK)


def clean_series(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str = "cleaned",
                 half_width: int = 7, reach: float = 3.0, iterations: int = 2, blocks: int | None = None) -> DataFrame:
    """Interpolate gaps, replace outliers, interpolate those: adds ``name`` and the flag ``<name>_outlier``.

    The series is smoothed by a rolling median and a rolling mean of that, each over ``2 * half_width + 1`` rows (fewer
    at the ends, always as many on both sides). A value is an outlier where its residual lies more than ``reach``
    interquartile ranges beyond the quartiles of the series' residuals. This stands in for a super-smoother: results
    are close to those of one, not equal.
    """
    keys = list(keys)
    rows = numbered_values(df, keys, order, blocks).withColumns(
        {"__work": F.col(value).cast("double"), "__out": F.lit(False)}
    )
    for _ in range(iterations):
        rows = interpolate_numbered(rows, keys, order, "__pos", "__work", "__full")
        smooth = centred_window(
            rows, keys, "__pos", half_width,
            [
                lambda w: {"__mid": array_median(symmetric_part(F.collect_list("__full").over(w), half_width))},
                lambda w: {"__smooth": array_mean(symmetric_part(F.collect_list("__mid").over(w), half_width))},
            ],
        )
        # read twice below: for the quartiles and for the rows
        smooth = materialize(smooth.withColumn("__res", F.col("__full") - F.col("__smooth")))
        q = quantiles(smooth, keys, "__res", {"__q1": 0.25, "__q3": 0.75}, blocks).drop("n")
        iqr = F.col("__q3") - F.col("__q1")
        res = F.col("__res")
        outlier = (iqr > FLAT) & ((res < F.col("__q1") - reach * iqr) | (res > F.col("__q3") + reach * iqr))
        rows = (
            attach(smooth, q, keys)
            .withColumn("__hit", F.coalesce(outlier, F.lit(False)))
            .withColumns({"__work": F.when(~F.col("__hit"), F.col("__full")), "__out": F.col("__out") | F.col("__hit")})
            .drop("__full", "__mid", "__smooth", "__res", "__q1", "__q3", "__hit")
        )
    out = interpolate_numbered(rows, keys, order, "__pos", "__work", name)
    return out.withColumn(f"{name}_outlier", F.col("__out") & F.col(value).isNotNull()).drop(
        "__pos", "__len", "__work", "__out", BLOCK
    )


def clean_series_by_span(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str = "cleaned",
                         reach: float = 3.0, iterations: int = 2, blocks: int | None = None) -> DataFrame:
    """:func:`clean_series` against a smooth of variable span, whose windows are shares of a series.

    Only keys, row number and value go through the passes; the other columns are joined once, at the end.
    """
    keys = list(keys)
    numbered = materialize(numbered_values(df, keys, order, blocks))
    own = [*keys, BLOCK, "__pos", "__len"]
    rows = numbered.select(*own, F.col(value).cast("double").alias("__work"), F.lit(False).alias("__out"))
    for _ in range(iterations):
        full = interpolate_numbered(rows, keys, ["__pos"], "__pos", "__work", "__full").drop("__work")
        smooth = variable_span_smooth(full, keys, "__pos", "__len", "__full", "__smooth")
        smooth = smooth.withColumn("__res", F.col("__full") - F.col("__smooth"))
        q = quantiles(smooth, keys, "__res", {"__q1": 0.25, "__q3": 0.75}, blocks).drop("n")
        iqr, res = F.col("__q3") - F.col("__q1"), F.col("__res")
        hit = F.coalesce((iqr > FLAT) & ((res < F.col("__q1") - reach * iqr) | (res > F.col("__q3") + reach * iqr)), F.lit(False))
        # written, so that the next pass neither repeats this one nor stands behind its join by keys
        rows = materialize(attach(smooth, q, keys).select(*own, F.when(~hit, F.col("__full")).alias("__work"), (F.col("__out") | hit).alias("__out")))
    done = interpolate_numbered(rows, keys, ["__pos"], "__pos", "__work", "__done").select(*keys, "__pos", "__done", "__out")
    both = null_safe_join(numbered, materialize(done), [*keys, "__pos"])
    return both.withColumns({name: F.col("__done"), f"{name}_outlier": F.col("__out") & F.col(value).isNotNull()}).drop("__pos", "__len", "__done", "__out", BLOCK)


def clean_columns(df: DataFrame, keys: Sequence[str], order: str, cols: Sequence[str], by_span: bool = False, **options) -> DataFrame:
    """:func:`clean_series`, or :func:`clean_series_by_span`, on columns of a wide table with one row per (keys, order)."""
    keys, cols = list(keys), list(cols)
    long = to_long(df, [*keys, order], cols)
    cleaned = (clean_series_by_span if by_span else clean_series)(long, [*keys, "variable"], [order], "value", **options)
    wide = to_wide(cleaned, [*keys, order], "variable", ["cleaned"], cols).withColumnsRenamed(
        {c: f"__c_{c}" for c in cols} if len(cols) > 0 else {}
    )
    joined = null_safe_join(df, materialize(wide), [*keys, order])
    return joined.withColumns({c: F.col(f"__c_{c}") for c in cols}).drop(*[f"__c_{c}" for c in cols])


# --- clamping ----------------------------------------------------------------------------------


@dataclass(frozen=True)
class Clamp:
    """Bounds of a variable before a date (``None``: always); either bound may be open."""

    variable: str
    before: str | None = None
    low: float | None = None
    high: float | None = None


def clamped(value: Column, date: Column | None, rule: Clamp) -> Column:
    bounded = value
    if rule.low is not None:
        bounded = floor_at(bounded, float(rule.low))
    if rule.high is not None:
        bounded = cap_at(bounded, float(rule.high))
    if rule.before is None:
        return bounded
    return F.when(date < F.to_date(F.lit(rule.before)), bounded).otherwise(value)


def clamp_columns(df: DataFrame, date: str, rules: Sequence[Clamp]) -> DataFrame:
    """Apply rules, in their order, to the columns of a wide table."""
    for r in rules:
        df = df.withColumn(r.variable, clamped(F.col(r.variable), F.col(date), r))
    return df


def clamp_long(df: DataFrame, date: str, rules: DataFrame, variable: str = "variable", value: str = "value"):
    """Apply a rule table ``variable, before, lo, hi`` to a long table; NULL in a rule means open.

    With several rules for one variable and date, the tightest bounds hold. A NULL date is bounded by the rules without a date only. The ends of the rules cut
    the calendar of a variable into intervals, each with its bounds, and a row meets the one interval its date lies in.
    """
    steps = materialize(rule_intervals(rules).withColumnsRenamed({"variable": "__v", "since": "__since", "until": "__until", "lo": "__lo", "hi": "__hi"}))
    day = F.col(date)
    begun = F.col("__since").isNull() | (day >= F.col("__since"))
    inside = F.when(F.col("__until").isNull(), begun | day.isNull()).otherwise(begun & (day < F.col("__until")))
    rows = df.join(steps, df[variable].eqNullSafe(steps["__v"]) & inside, "left")
    v = F.greatest(F.col(value), F.col("__lo"))  # greatest and least skip a NULL bound
    v = F.least(v, F.col("__hi"))
    return rows.withColumn(value, F.when(F.col(value).isNotNull(), v)).drop("__v", "__since", "__until", "__lo", "__hi")


def rule_intervals(rules: DataFrame) -> DataFrame:
    """``variable, since, until, lo, hi``: disjoint intervals of dates, ``until`` exclusive, with the tightest bounds of all rules ``variable, before, lo, hi`` that hold there.

    Rules with one end are merged first, so the window over a variable has one row per date that any of its rules ends on: the calendar bounds it.
    """
    ends = rules.groupBy("variable", "before").agg(F.max("lo").alias("lo"), F.min("hi").alias("hi"))
    by = Window.partitionBy("variable")
    later = by.orderBy(F.col("before").desc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return ends.select("variable", F.lag("before").over(by.orderBy(F.col("before").asc_nulls_last())).alias("since"), F.col("before").alias("until"),
                       F.max("lo").over(later).alias("lo"), F.min("hi").over(later).alias("hi"))
