"""Temperature analyses: gap filling of a sensor table, trends by depth and season, seasonal report."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import season, season_year
from ..functions.text import name_depth, name_site, name_stat, signed_depth, title
from ..operators.aggregate import means
from ..operators.cleaning import Clamp, clamp_columns, clean_columns
from ..operators.gapfill import Model, cascade, fill_from, impute_mean
from ..operators.joins import weather_join
from ..operators.ranking import drop_edges
from ..operators.reshape import ordered_labels, pick, stack, to_long, with_extra_label
from ..operators.trend import add_fdr, add_interval, fit_trend, fitted_lines, residuals, significant
from ..session import materialize

# Targets and predictors of the standard cascade for two lakes with air and ground sensors,
# as (target, predictors, stepwise). Every entry applies to the statistics avg, max and min alike;
# STATION is the weather station's daily mean.
STATION = "mean_150"
SENSOR_STEPS = (
    ("mlk_temp_0", ("mlk_temp_150", "rlk_temp_150", STATION), False),
    ("rlk_temp_0", ("mlk_temp_150", "rlk_temp_150", STATION, "mlk_temp_0"), False),
    ("rlk_temp_2p5", ("rlk_temp_0", "rlk_temp_150"), True),
    ("rlk_temp_5", ("rlk_temp_0", "rlk_temp_2p5", "rlk_temp_150"), True),
    ("rlk_temp_10", ("rlk_temp_0", "rlk_temp_2p5", "rlk_temp_5"), True),
    ("rlk_temp_15", ("rlk_temp_0", "rlk_temp_2p5", "rlk_temp_5", "rlk_temp_10"), True),
    ("rlk_temp_20", ("rlk_temp_0", "rlk_temp_2p5", "rlk_temp_5", "rlk_temp_10", "rlk_temp_15"), True),
    ("mlk_temp_20", ("mlk_temp_0", "rlk_temp_2p5", "rlk_temp_5", "rlk_temp_10"), True),
    ("rlk_temp_40", ("rlk_temp_0", "rlk_temp_2p5", "rlk_temp_5", "rlk_temp_10", "rlk_temp_20"), True),
    ("mlk_temp_40", ("mlk_temp_0", "rlk_temp_2p5", "rlk_temp_5", "rlk_temp_10", "mlk_temp_20"), True),
    ("rlk_temp_80", ("rlk_temp_0", "rlk_temp_2p5", "rlk_temp_5", "rlk_temp_10", "rlk_temp_20", "rlk_temp_40"), True),
    ("mlk_temp_80", ("mlk_temp_0", "mlk_temp_20", "mlk_temp_40"), True),
)
STATS = ("avg", "max", "min")

# Series cleaned of outliers, and bounds that hold before a date.
CLEANED_AIR = ("rlk_temp_150_max", "rlk_temp_150_min")
CLEANED_GROUND = ("mlk_temp_0_max", "mlk_temp_0_min", "mlk_temp_40_avg")
AIR_CLAMPS = (Clamp("rlk_temp_150_min", None, -40.0, None),)
GROUND_CLAMPS = (
    Clamp("mlk_temp_40_avg", "2007-01-01", None, 7.0),
    Clamp("mlk_temp_40_max", "2012-01-01", -8.5, 7.0),
    Clamp("rlk_temp_80_avg", "2007-01-01", None, 1.0),
    Clamp("mlk_temp_80_max", "2009-01-01", -6.0, 4.0),
    Clamp("mlk_temp_80_min", "2009-01-01", -6.5, 4.0),
)


def sensor_models(steps=SENSOR_STEPS, stats: Sequence[str] = STATS) -> list[Model]:
    """One model per step and statistic; predictors take the statistic of their target."""
    name = lambda c, s: c if c == STATION else f"{c}_{s}"
    return [Model(f"{t}_{s}", tuple(name(p, s) for p in ps), step) for t, ps, step in steps for s in stats]


def fill_sensor_table(
    sensors: DataFrame,
    weather: DataFrame,
    keys: Sequence[str] = (),
    date: str = "date",
    models: Sequence[Model] | None = None,
    clean_air: Sequence[str] = CLEANED_AIR,
    clean_ground: Sequence[str] = CLEANED_GROUND,
    air_clamps: Sequence[Clamp] = AIR_CLAMPS,
    ground_clamps: Sequence[Clamp] = GROUND_CLAMPS,
    **clean_options,
) -> DataFrame:
    """Fill every temperature of a wide daily sensor table.

    Station means are joined by day and imputed, air temperatures are filled from the station, cleaned and
    floored, then the cascade runs with its cleaning and clamping in between. Models are per calendar month
    (all years together) and per ``keys``, the columns that tell entities apart.
    """
    models = list(models) if models is not None else sensor_models()
    keys, by = list(keys), [*keys, "month"]
    df = impute_mean(weather_join(weather, sensors, date=date, predictor=STATION), STATION)
    df = df.withColumn("month", F.month(date))
    air = pick(df, matches="150", without="neg150|hum|^" + STATION)
    df = fill_from(df, by, air, STATION)
    if clean_air:
        df = clean_columns(df, keys, date, clean_air, **clean_options)
    df = clamp_columns(df, date, air_clamps)

    after: dict[str, Callable[[DataFrame], DataFrame]] = {}
    for target in {m.target for m in models}:
        own = [r for r in ground_clamps if r.variable == target]
        if target in clean_ground or own:
            after[target] = partial(_finish, keys=keys, date=date, target=target, clean=target in clean_ground, own=own,
                                    options=clean_options)
    return cascade(df, by, models, after)


def _finish(df: DataFrame, keys, date, target, clean, own, options) -> DataFrame:
    if clean:
        df = clean_columns(df, keys, date, [target], **options)
    return clamp_columns(df, date, own)


# --- trends ------------------------------------------------------------------------------------


def decode_series(fits: DataFrame, name: str = "variable", site_names: Mapping[str, str] | None = None) -> DataFrame:
    """Site, signed depth and statistic out of the series name."""
    n = F.col(name)
    out = fits.withColumns({"site": name_site(n), "depth": signed_depth(name_depth(n)), "type": name_stat(n)})
    return ordered_labels(out, "site", site_names).drop("site_ord") if site_names else out


def annual_slopes(df: DataFrame, year: str, cols: Sequence[str], first: bool = True, last: bool = False,
                  keys: Sequence[str] = (), blocks: int | None = None) -> DataFrame:
    """Trend of the yearly mean of each column, with interval and FDR over all columns."""
    keys = list(keys)
    yearly = drop_edges(means(df, [*keys, year], cols), year, keys, first, last)
    long = to_long(yearly, [*keys, year], cols)
    return add_fdr(add_interval(fit_trend(long, [*keys, "variable"], year, "value")), blocks=blocks)


def seasonal_slopes(df: DataFrame, date: str, cols: Sequence[str], keys: Sequence[str] = (), first: bool = False,
                    last: bool = False, other: str | None = None, blocks: int | None = None) -> DataFrame:
    """Trend of each column's seasonal mean over season-years; FDR over all seasons and columns."""
    keys = list(keys)
    dated = df.withColumns({"season": season(F.month(date), other=other), "season_year": season_year(F.col(date))})
    # aggregate the wide rows first: the long form is built from season means only
    wide = means(dated, [*keys, "season", "season_year"], cols)
    long = to_long(wide, [*keys, "season", "season_year"], cols).filter(F.col("value").isNotNull())
    if first or last:
        long = drop_edges(long, "season_year", [*keys, "season", "variable"], first, last)
    fits = fit_trend(long, [*keys, "season", "variable"], "season_year", "value")
    return add_fdr(add_interval(fits), blocks=blocks)


def combined_slopes(annual: DataFrame, seasonal: DataFrame, stat: str, labels: Mapping[str, str],
                    site_names: Mapping[str, str] | None = None) -> DataFrame:
    """Annual and seasonal trends of one statistic in one table with ordered period labels.

    ``significant`` is the FDR flag for annual rows and the interval flag for seasonal ones, as in the report;
    both flags are kept as ``sig_fdr`` and ``sig_ci``.
    """
    a = decode_series(annual, site_names=site_names).filter(F.col("type") == stat)
    s = decode_series(seasonal, site_names=site_names).filter(F.col("type") == stat)
    a = a.withColumns({"period": F.lit("Annual"), "significant": F.col("sig_fdr")})
    s = s.withColumns({"period": title(F.col("season")), "significant": F.col("sig_ci")})
    return ordered_labels(stack(a, s), "period", labels)


def seasonal_summary(long: DataFrame, keys: Sequence[str], date: str, stat: str = "stat", value: str = "value",
                     extra: str | None = "annual", other: str | None = None) -> DataFrame:
    """Per season-year: mean of the averages, lowest minimum and highest maximum, with an extra whole-year season.

    Works on the long form directly; no pivot is needed.
    """
    rows = long.withColumns({"season": season(F.month(date), other=other), "season_year": season_year(F.col(date))})
    v, is_stat = F.col(value), lambda s: F.col(stat) == s
    base = rows.groupBy(*keys, "season", "season_year").agg(
        F.sum(F.when(is_stat("avg"), v)).alias("__sum"),
        F.count(F.when(is_stat("avg"), v)).alias("__n"),
        F.min(F.when(is_stat("min"), v)).alias("__min"),
        F.max(F.when(is_stat("max"), v)).alias("__max"),
    )
    # the extra season is made from season sums, not from a second copy of the rows
    if extra is not None:
        base = with_extra_label(base, "season", extra)
    return base.groupBy(*keys, "season", "season_year").agg(
        F.try_divide(F.sum("__sum"), F.sum("__n")).alias("mean_value"),
        F.min("__min").alias("min_value"),
        F.max("__max").alias("max_value"),
    )


def significant_lines(summary: DataFrame, keys: Sequence[str], alpha: float = 0.05) -> DataFrame:
    """Fitted line of every group whose mean has a significant trend over season-years."""
    summary = materialize(summary)
    fits = significant(fit_trend(summary.filter(F.col("mean_value").isNotNull()), keys, "season_year", "mean_value"), alpha)
    return fitted_lines(summary, fits, keys, "season_year")


def significant_residuals(df: DataFrame, keys: Sequence[str], x: str, y: str, alpha: float = 0.05) -> DataFrame:
    """Residual table of the groups with a significant trend; the keys stay on every row.

    ``df`` holds aggregates, such as seasonal means; it is written, since it is read for the fits and for the rows.
    """
    df = materialize(df)
    return residuals(df, significant(fit_trend(df, keys, x, y), alpha), keys, x, y)


def seasonal_regressions(df: DataFrame, date: str, cols: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Trend of every (season, column) without each season's first and last season-year, in one aggregate."""
    return seasonal_slopes(df, date, cols, keys, first=True, last=True)
