"""Tail probabilities of Student's t and of F as plain column expressions.

With ``t = sqrt(df) * tan(a)`` the t density becomes ``cos(a) ** (df - 1)``; with
``F = (d2 / d1) * tan(a) ** 2`` the F density becomes ``sin(a) ** (d1 - 1) * cos(a) ** (d2 - 1)``.
Both are log-concave on a finite range, so a tail is the ratio of two Simpson sums and no gamma
function is needed. Each sum runs only over the stretch where the log density lies within
``DROP`` of its largest value there; beyond that, curvature guarantees the rest is
below double precision. That keeps the step count constant for any number of
degrees of freedom. The expressions run once per fitted model, not per data row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

STEPS = 400
DROP = 40.0
HALF_PI = math.pi / 2
TINY = 1e-300


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def simpson(lo: Column, hi: Column, shift: Column, log_f, steps: int = STEPS) -> Column:
    """Simpson's rule for ``exp(log_f(x) - shift)`` between two columns."""

    def rule(s: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            weight = F.when((i == 0) | (i == steps), 1.0).when(i % 2 == 1, 4.0).otherwise(2.0)
            return acc + weight * F.exp(log_f(s["lo"] + s["h"] * i) - s["shift"])

        return F.aggregate(F.sequence(F.lit(0), F.lit(steps)), F.lit(0.0), step) * s["h"] / 3.0

    args = F.struct(lo.alias("lo"), ((hi - lo) / float(steps)).alias("h"), shift.alias("shift"))
    return let(args, rule)


def _log_power(power: Column, v: Column) -> Column:
    return F.when(power == 0, 0.0).otherwise(power * F.log(F.greatest(v, F.lit(TINY))))


def _reach(slope: Column, curvature: Column) -> Column:
    """Distance after which a log density falling with ``slope`` and ``curvature`` has lost DROP."""
    return F.when(curvature == 0, HALF_PI).otherwise(
        2 * DROP / (slope + F.sqrt(slope * slope + curvature * (2 * DROP)))
    )


def t_two_sided(t: Column, df: Column) -> Column:
    """Two-sided p of a t statistic; NULL unless ``df >= 1``."""

    def tail_ratio(s: Column) -> Column:
        power, start = s["df"] - 1.0, s["start"]
        log_f = lambda a: _log_power(power, F.cos(a))
        far = F.least(F.lit(HALF_PI), start + _reach(power * F.tan(start), power))
        half = simpson(F.lit(0.0), F.least(F.lit(HALF_PI), _reach(F.lit(0.0), power)), F.lit(0.0), log_f)
        return F.exp(log_f(start)) * simpson(start, far, log_f(start), log_f) / half

    args = F.struct(df.cast("double").alias("df"), F.atan(F.abs(t) / F.sqrt(df)).alias("start"))
    return F.when((df >= 1) & t.isNotNull(), F.least(F.lit(1.0), let(args, tail_ratio)))


def f_two_sided(f: Column, d1: Column, d2: Column) -> Column:
    """Two-sided p of a variance ratio: twice the smaller tail. NULL unless ``d1, d2 >= 1``."""

    def both_tails(s: Column) -> Column:
        a, b, at, peak = s["a"], s["b"], s["at"], s["peak"]
        log_f = lambda x: _log_power(a, F.sin(x)) + _log_power(b, F.cos(x))
        curvature = F.pow(F.sqrt(a) + F.sqrt(b), 2)
        wide = _reach(F.lit(0.0), curvature)
        fall = F.abs(F.when(a == 0, 0.0).otherwise(a / F.tan(F.greatest(at, F.lit(1e-12)))) - b * F.tan(at))
        near = _reach(fall, curvature)
        lo = lambda x: F.greatest(F.lit(0.0), x)
        hi = lambda x: F.least(F.lit(HALF_PI), x)
        total = simpson(lo(peak - wide), peak, log_f(peak), log_f) + simpson(
            peak, hi(peak + wide), log_f(peak), log_f
        )
        outer = F.when(at >= peak, simpson(at, hi(at + near), log_f(at), log_f)).otherwise(
            simpson(lo(at - near), at, log_f(at), log_f)
        )
        one_side = outer * F.exp(log_f(at) - log_f(peak)) / total
        return F.least(F.lit(1.0), 2.0 * F.least(one_side, 1.0 - one_side))

    a, b = d1.cast("double") - 1.0, d2.cast("double") - 1.0
    args = F.struct(
        a.alias("a"),
        b.alias("b"),
        F.atan(F.sqrt(f * d1 / d2)).alias("at"),
        F.when((a == 0) & (b == 0), HALF_PI / 2).otherwise(F.atan2(F.sqrt(a), F.sqrt(b))).alias("peak"),
    )
    valid = (d1 >= 1) & (d2 >= 1)
    return F.when(valid & (f > 0), let(args, both_tails)).when(valid & (f == 0), 0.0)


def normal_density(x: Column, mean: Column, sd: Column) -> Column:
    z = (x - mean) / sd
    return F.exp(z * z / -2.0) / (sd * math.sqrt(2 * math.pi))
