"""Tests of one sample against another: variances first, then means."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tails import f_two_sided, t_two_sided


def sample_sums(df: DataFrame, keys: Sequence[str], value: str, current: Column) -> DataFrame:
    """Count, mean and variance of both samples per group in one pass: ``c`` the control rows, ``t`` the current."""
    aggs = []
    for tag, test in (("c", ~current), ("t", current)):
        v = F.when(test, F.col(value).cast("double"))
        aggs += [F.count(v).alias(f"n_{tag}"), F.avg(v).alias(f"mean_{tag}"), F.var_samp(v).alias(f"var_{tag}")]
    return df.groupBy(*keys).agg(*aggs)


def variance_test(sums: DataFrame) -> DataFrame:
    """Adds ``f`` (control over current variance) and the two-sided ``p_f``."""
    out = sums.withColumn("f", F.try_divide(F.col("var_c"), F.col("var_t")))
    return out.withColumn("p_f", f_two_sided(F.col("f"), F.col("n_c") - 1, F.col("n_t") - 1))


def mean_tests(sums: DataFrame) -> DataFrame:
    """Adds both t tests: ``t_welch, df_welch, p_welch`` and ``t_pooled, df_pooled, p_pooled``.

    Control minus current, so t is negative where the current mean is higher. NULL for an empty sample.
    """
    a, b = F.try_divide(F.col("var_c"), F.col("n_c")), F.try_divide(F.col("var_t"), F.col("n_t"))
    gap = F.col("mean_c") - F.col("mean_t")
    df_pooled = (F.col("n_c") + F.col("n_t") - 2).cast("double")
    # a sample of one row has no variance: it adds nothing to the pooled one
    part = lambda s: F.when(F.col(f"n_{s}") > 1, F.col(f"var_{s}") * (F.col(f"n_{s}") - 1)).when(
        F.col(f"n_{s}") == 1, 0.0
    )
    pooled = F.try_divide(part("c") + part("t"), df_pooled)
    se_pooled = F.sqrt(pooled * (F.try_divide(F.lit(1.0), F.col("n_c")) + F.try_divide(F.lit(1.0), F.col("n_t"))))
    out = sums.withColumns(
        {
            "t_welch": F.try_divide(gap, F.sqrt(a + b)),
            "df_welch": F.try_divide(
                F.pow(a + b, 2), a * a / F.nullif(F.col("n_c") - 1, F.lit(0)) + b * b / F.nullif(F.col("n_t") - 1, F.lit(0))
            ),
            "t_pooled": F.try_divide(gap, se_pooled),
            "df_pooled": F.when((F.col("n_c") > 0) & (F.col("n_t") > 0) & (df_pooled > 0), df_pooled),
        }
    )
    return out.withColumns(
        {
            "p_welch": t_two_sided(F.col("t_welch"), F.col("df_welch")),
            "p_pooled": t_two_sided(F.col("t_pooled"), F.col("df_pooled")),
        }
    )


def chosen_test(tests: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Adds ``method, t, df, p``: Welch where the variances differ at ``alpha``, else pooled."""
    differ = F.coalesce(F.col("p_f") < alpha, F.lit(False))
    pick = lambda c: F.when(differ, F.col(f"{c}_welch")).otherwise(F.col(f"{c}_pooled"))
    return tests.withColumns(
        {"method": F.when(differ, "welch").otherwise("pooled"), "t": pick("t"), "df": pick("df"), "p": pick("p")}
    )


def compare_samples(df: DataFrame, keys: Sequence[str], value: str, current: Column, alpha: float = 0.05):
    """Variance test, both mean tests and the choice between them, from one scan."""
    return chosen_test(mean_tests(variance_test(sample_sums(df, keys, value, current))), alpha)
