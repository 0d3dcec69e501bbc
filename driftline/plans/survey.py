"""Survey analyses: change between periods, year against history, site trends on coordinates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.missing import is_in, percent_difference, signif, to_number
from ..functions.text import labelled_text
from ..operators.aggregate import means_and_sds
from ..operators.anomaly import ranked_years
from ..operators.joins import join_coordinates
from ..operators.ranking import rescale
from ..operators.resample import bootstrap_interval
from ..operators.reshape import bins, early_to_late, recode, to_long
from ..operators.trend import fit_trend, yes_no
from ..operators.twosample import compare_samples
from ..session import materialize


def prepare_survey(df: DataFrame, site_map: Mapping[str, str] | DataFrame, ecosystem_map: Mapping[str, str] | DataFrame,
                   periods: Sequence[tuple[int, int, str]], no_data: str = "No Data") -> DataFrame:
    """One spelling per site, its ecosystem, and the period of the year; rows without a site are left out."""
    out = recode(df, "site", site_map)
    out = recode(out, "site", ecosystem_map, "ecosystem", keep_unmatched=False)
    return out.withColumn("period", bins(F.col("year"), periods)).filter(F.col("site") != no_data)


def period_change(df: DataFrame, group: str, early: str, late: str, cols: Sequence[str], metrics: Sequence[str],
                  row_key: Sequence[str], replicates: int = 1000, conf: float = 0.95, partitions: int | None = None, draw_bits: int = 32) -> DataFrame:
    """Early and late means per group with bootstrap bounds and line style of each metric."""
    inside = df.filter(F.col(group).isNotNull() & F.col("period").isin(early, late))
    ci = bootstrap_interval(inside, [group], metrics, F.col("period") == late, row_key, replicates, conf, partitions, draw_bits)
    wide = ci.groupBy(group).agg(
        *[
            F.max(F.when(F.col("metric") == m, F.col(c))).alias(f"{m}_{c}")
            for m in metrics
            for c in ("lower", "upper", "linetype")
        ]
    )
    return early_to_late(inside, [group], "period", early, late, cols, required=metrics[0], flags=wide)


def group_summary(df: DataFrame, keys: Sequence[str], cols: Sequence[str], exclude: Sequence[str] = ()) -> DataFrame:
    """Mean and sample sd per group, leaving out some sites."""
    rows = df.filter(~is_in(F.col("site"), exclude, null_is_false=True)) if exclude else df
    return means_and_sds(rows, keys, cols)


def year_report(df: DataFrame, keys: Sequence[str], value: str, year: str, current: int, alpha: float = 0.05):
    """Mean of the current year, of all others, percent difference, and the tests between them, from one scan."""
    tests = compare_samples(df, keys, value, F.col(year) == current, alpha)
    tests = tests.withColumnsRenamed({"mean_c": "history", "mean_t": "current"})
    out = tests.withColumn("percent_diff", percent_difference(F.col("current"), F.col("history")))
    return out.select(*keys, "history", "current", "percent_diff", "n_c", "n_t", "f", "p_f", "method", "t", "df", "p")


def site_trends(df: DataFrame, points: DataFrame, metrics: Sequence[str], year: str = "year", alpha: float = 0.05):
    """Trend of each metric at each site with coordinates, marker radius and popup text."""
    located = join_coordinates(df, points)
    long = to_long(located, ["site", "lat", "lon", year], metrics, "metric")
    fits = fit_trend(long, ["site", "lat", "lon", "metric"], year, "value")
    fits = materialize(fits.filter(F.col("n") > 0).withColumn("sig", yes_no(F.col("p_value") < alpha)))
    fits = rescale(fits, F.abs(F.col("slope")), "radius", 4.0, 10.0)
    return fits.withColumn("popup", labelled_text({"Site": F.col("site"), "Metric": F.upper("metric"), "Slope": F.bround("slope", 3), "p": signif(F.col("p_value"), 3)}))


def ranked_measurements(df: DataFrame, sites: Sequence[str], zone_map: Mapping[str, str], zone: str, value: str,
                        year: str = "year", site_col: str = "Site", zone_col: str = "Zone") -> DataFrame:
    """Yearly means of a text measurement at chosen sites and in one zone, with deviation and rank."""
    rows = recode(df.filter(F.col(site_col).isin(*sites)), zone_col, zone_map).filter(F.col(zone_col) == zone)
    rows = rows.withColumn(value, to_number(F.col(value)))
    return ranked_years(rows, year, value, value)
