"""Linear trends per group from one aggregate, with inference as expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.missing import if_else
from ..functions.tails import t_two_sided
from ..session import materialize
from .joins import attach
from .ranking import adjust_fdr

# Fixed value: normal quantile of the 95 % interval.
Z95 = 1.96


def fit_trend(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Least-squares line per group: ``n, slope, intercept, x_mean, sxx, rss, sigma, se, t, df, p_value``.

    Pairs with a NULL are left out. Without spread in x the slope is NULL; with fewer than three pairs
    the error columns are.
    """
    xd, yd = F.col(x).cast("double"), F.col(y).cast("double")
    both = xd.isNotNull() & yd.isNotNull()
    sums = df.groupBy(*keys).agg(
        F.regr_count(yd, xd).alias("n"),
        F.regr_slope(yd, xd).alias("slope"),
        F.regr_intercept(yd, xd).alias("intercept"),
        F.avg(F.when(both, xd)).alias("x_mean"),
        F.regr_sxx(yd, xd).alias("sxx"),
        F.regr_syy(yd, xd).alias("__syy"),
        F.regr_sxy(yd, xd).alias("__sxy"),
    )
    flat = F.col("sxx") == 0
    fitted = sums.withColumns(
        {
            "slope": F.when(~flat, F.col("slope")),
            "intercept": F.when(~flat, F.col("intercept")),
            "rss": F.when(
                ~flat, F.greatest(F.lit(0.0), F.col("__syy") - F.col("__sxy") * F.col("__sxy") / F.col("sxx"))
            ),
            "df": F.when(F.col("n") > 2, (F.col("n") - 2).cast("double")),
        }
    )
    fitted = fitted.withColumn("sigma", F.sqrt(F.col("rss") / F.col("df")))
    fitted = fitted.withColumn("se", F.try_divide(F.col("sigma"), F.sqrt(F.col("sxx"))))
    fitted = fitted.withColumn("t", F.try_divide(F.col("slope"), F.col("se")))
    exact = (F.col("se") == 0) & (F.col("slope") != 0)
    p = F.when(exact, F.lit(0.0)).otherwise(t_two_sided(F.col("t"), F.col("df")))
    return fitted.withColumn("p_value", p).select(
        *keys, "n", "slope", "intercept", "x_mean", "sxx", "rss", "sigma", "se", "t", "df", "p_value"
    )


def add_interval(fits: DataFrame, z: float = Z95) -> DataFrame:
    """Normal interval of the slope and ``sig_ci``: does it exclude zero."""
    out = fits.withColumns(
        {"ci_lower": F.col("slope") - z * F.col("se"), "ci_upper": F.col("slope") + z * F.col("se")}
    )
    return out.withColumn("sig_ci", yes_no((F.col("ci_lower") > 0) | (F.col("ci_upper") < 0)))


def yes_no(test: Column) -> Column:
    return if_else(test, "Yes", "No")


def add_fdr(fits: DataFrame, family: Sequence[str] = (), alpha: float = 0.05, blocks: int | None = None) -> DataFrame:
    """``p_adj`` over all fits (or per family) and ``sig_fdr``. Filter the fits afterwards, not before.

    The fits are written first, so the data rows behind them are read once.
    """
    out = adjust_fdr(materialize(fits), "p_value", "p_adj", family, blocks)
    return out.withColumn("sig_fdr", yes_no(F.col("p_adj") < alpha))


def coefficients(fits: DataFrame, keys: Sequence[str], x: str) -> DataFrame:
    """One row per term: ``keys, term, estimate, std_error, statistic, p_value``; terms are ``(intercept)`` and ``x``."""
    se0 = F.col("sigma") * F.sqrt(F.try_divide(F.lit(1.0), F.col("n")) + F.try_divide(F.col("x_mean") * F.col("x_mean"), F.col("sxx")))
    t0 = F.try_divide(F.col("intercept"), se0)
    row = lambda term, est, se, t, p: F.struct(
        F.lit(term).alias("term"), est.alias("estimate"), se.alias("std_error"), t.alias("statistic"), p.alias("p_value")
    )
    return fits.select(
        *keys,
        F.inline(
            F.array(
                row("(intercept)", F.col("intercept"), se0, t0, t_two_sided(t0, F.col("df"))),
                row(x, F.col("slope"), F.col("se"), F.col("t"), F.col("p_value")),
            )
        ),
    )


def significant(fits: DataFrame, alpha: float = 0.05) -> DataFrame:
    return fits.filter(F.col("p_value") < alpha)


def fitted_lines(points: DataFrame, fits: DataFrame, keys: Sequence[str], x: str, name: str = "mean_pred"):
    """Fitted value at every x of the groups that have a fit."""
    lines = fits.select(*keys, "slope", "intercept")
    return attach(points.select(*keys, x).distinct(), lines, keys, "inner").withColumn(
        name, F.col("intercept") + F.col("slope") * F.col(x)
    )


def residuals(df: DataFrame, fits: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Rows with ``fitted, resid, hat, sigma_without, cooksd, std_resid`` of their group's line."""
    use = fits.select(*keys, "n", "slope", "intercept", "x_mean", "sxx", "rss", "sigma", "df")
    rows = attach(df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()), use, keys, "inner")
    hat = 1.0 / F.col("n") + F.pow(F.col(x) - F.col("x_mean"), 2) / F.col("sxx")
    rows = rows.withColumn("fitted", F.col("intercept") + F.col("slope") * F.col(x))
    rows = rows.withColumns({"resid": F.col(y) - F.col("fitted"), "hat": hat})
    spread = F.col("sigma") * F.sqrt(1 - F.col("hat"))
    rows = rows.withColumn("std_resid", F.try_divide(F.col("resid"), spread))
    left_out = F.col("rss") - F.try_divide(F.col("resid") * F.col("resid"), 1 - F.col("hat"))
    rows = rows.withColumns(
        {
            "sigma_without": F.sqrt(F.greatest(F.lit(0.0), F.try_divide(left_out, F.col("df") - 1))),
            "cooksd": F.col("std_resid") * F.col("std_resid") / 2.0 * F.try_divide(F.col("hat"), 1 - F.col("hat")),
        }
    )
    return rows.drop("n", "slope", "intercept", "x_mean", "sxx", "rss", "sigma", "df")
