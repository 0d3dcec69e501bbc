"""Running-line smoothers whose windows are shares of a series, with the share chosen per row by cross-validation.

A window of a fifth of a series cannot be a frame or a tile with halos when one series holds a third of the rows. A line
through a window needs the window's sums only, and those are differences of two running sums. So each row sends its running sums
to the two rows whose windows end beside it, and one aggregate by row number brings both ends together. The windows at the two
ends of a series are the same for many rows; their sums are a small table with one row per series.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .joins import attach
from .ordered import BLOCK, running

# Shares of a series in the narrow, the middle and the wide window.
SPANS = (0.05, 0.2, 0.5)
LEAST_HALF = 2  # rows on either side of the narrowest window


def half_width(length: Column, span: float) -> Column:
    """Rows on either side of a window that holds ``span`` of a series, rounded."""
    return F.greatest(F.lit(LEAST_HALF), F.floor(0.5 * span * length + 0.5)).cast("long")


def running_lines(rows: DataFrame, keys: Sequence[str], pos: str, length: str, fits: dict[str, tuple[str, float]],
                  errors: dict[str, str] | None = None) -> DataFrame:
    """Value at each row of the least-squares line through the rows around it.

    ``rows`` carry a block, a row number ``pos`` from 1 and the ``length`` of their series, and hold no NULL in the fitted columns unless the
    whole series is NULL. ``fits`` maps an output name to (column, span). Near the ends of a series the window is the first or
    last one of full width, so lines there are one-sided. ``errors`` maps a name of ``fits`` to a column for the
    size of the error that the line would make at the row if it had been fitted without it. The result is written.
    """
    keys, errors = list(keys), errors or {}
    p, n = F.col(pos), F.col(length)
    values = list(dict.fromkeys(v for v, _ in fits.values()))
    spans = list(dict.fromkeys(s for _, s in fits.values()))
    sums = {f"__{kind}{i}": (v, kind) for i, v in enumerate(values) for kind in ("s", "m")}
    spec = {c: ("sum", F.col(v).cast("double") * (p if kind == "m" else 1), "up") for c, (v, kind) in sums.items()}
    summed = materialize(running(rows, keys, [pos], spec))
    half = [half_width(n, s) for s in spans]

    def part(to: Column, tag: int, carries: bool) -> Column:
        own = [(F.col(c) if not carries else F.lit(None).cast(rows.schema[c].dataType)).alias(c) for c in rows.columns if c not in (*keys, pos)]
        prefix = [(F.col(c) if carries else F.lit(None).cast("double")).alias(c) for c in sums]
        return F.struct(to.alias("__to"), F.lit(tag).alias("__tag"), *own, *prefix)

    parts = [part(p, 0, False)]
    for i, h in enumerate(half):
        for tag, to in ((2 * i + 1, p - h), (2 * i + 2, p + h + 1)):
            parts.append(F.when((to > h) & (to <= n - h), part(to, tag, True)))
    sent = summed.select(*keys, F.explode(F.array_compact(F.array(*parts))).alias("__x")).select(*keys, "__x.*")
    own = [F.max(c).alias(c) for c in rows.columns if c not in (*keys, pos)]
    ends = [F.max(F.when(F.col("__tag") == tag, F.col(c))).alias(f"{c}_{tag}") for tag in range(1, 2 * len(spans) + 1) for c in sums]
    met = sent.groupBy(*keys, F.col("__to").alias(pos)).agg(*own, *ends)

    at = lambda where, c: F.max(F.when(p == where, F.col(c)))
    edges = []
    for i, h in enumerate(half):
        width = F.least(2 * h + 1, n)
        for c in sums:
            edges += [at(width, c).alias(f"{c}_first{i}"), (at(n, c) - F.coalesce(at(n - width, c), F.lit(0.0))).alias(f"{c}_last{i}")]
    rows_met = attach(met, summed.groupBy(*keys).agg(*edges), keys)

    out = {}
    for name, (value, span) in fits.items():
        i, v = spans.index(span), values.index(value)
        h = half[i]
        width = F.least(2 * h + 1, n)
        low = F.least(F.greatest(p - h, F.lit(1)), n - width + 1)

        def window(c: str) -> Column:
            inner = F.col(f"{c}_{2 * i + 1}") - F.coalesce(F.col(f"{c}_{2 * i + 2}"), F.lit(0.0))
            return F.when(p <= h, F.col(f"{c}_first{i}")).when(p > n - h, F.col(f"{c}_last{i}")).otherwise(inner)

        mid = low + (width - 1) / 2
        spread = width * (width * width - 1) / 12.0
        slope = F.when(width > 1, (window(f"__m{v}") - mid * window(f"__s{v}")) / spread).otherwise(F.lit(0.0))
        out[name] = window(f"__s{v}") / width + slope * (p - mid)
        if name in errors:
            left = 1 - 1 / width - F.when(width > 1, (p - mid) * (p - mid) / spread).otherwise(F.lit(0.0))
            out[errors[name]] = F.when(left > 1e-9, F.abs(F.col(value) - out[name]) / left).otherwise(F.lit(0.0))
    return materialize(rows_met.select(*rows.columns, *[c.alias(k) for k, c in out.items()]))


def variable_span_smooth(rows: DataFrame, keys: Sequence[str], pos: str, length: str, value: str, name: str,
                         spans: Sequence[float] = SPANS) -> DataFrame:
    """Smooth a series by running lines of three spans, the best of which is found per row by leave-one-out errors.

    Errors are smoothed with the middle span; so are the spans that win, and the smooth lies between the curves of the two spans next to the
    result. A last pass takes the narrow span. Rows are as :func:`running_lines` asks, which runs four times.
    """
    narrow, middle, wide = spans
    curves, errors, means = ([f"__{kind}_{i}" for i in range(3)] for kind in ("curve", "error", "mean"))
    fitted = running_lines(rows, keys, pos, length, {c: (value, s) for c, s in zip(curves, spans)}, dict(zip(curves, errors)))
    judged = running_lines(fitted, keys, pos, length, {m: (e, middle) for m, e in zip(means, errors)})
    least = F.least(*means)
    best = F.when(least.isNotNull(), reduce(lambda rest, i: F.when(F.col(means[i]) == least, F.lit(float(spans[i]))).otherwise(rest), (1, 0), F.lit(float(wide))))
    picked = running_lines(judged.withColumn("__best", best).drop(*errors, *means), keys, pos, length, {"__span": ("__best", middle)})
    off = F.least(F.greatest("__span", F.lit(float(narrow))), F.lit(float(wide))) - middle
    share = F.when(off >= 0, off / (wide - middle)).otherwise(-off / (middle - narrow))
    between = (1 - share) * F.col(curves[1]) + share * F.when(off >= 0, F.col(curves[2])).otherwise(F.col(curves[0]))
    mixed = picked.withColumn("__mixed", between).drop(*curves, "__best", "__span")
    return running_lines(mixed, keys, pos, length, {name: ("__mixed", narrow)}).drop("__mixed")
