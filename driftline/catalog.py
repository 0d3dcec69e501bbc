"""Queries over the standard test tables, one or more per operator.

Each takes a session and a folder of parquet tables and returns a DataFrame. :mod:`driftline.oracle` holds
the SQL each is compared with. The tables contain no NULL, so gaps are made by rule.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sources
from .functions.calendar import compact_date, micros, parse_date, season, season_year
from .functions.missing import floor_at, if_else, percent_difference, round_even, row_mean, signif, to_number
from .functions.text import extract, name_depth, name_site, labelled_text, name_stat, padded, signed_depth, title
from .operators import aggregate as agg
from .operators import anomaly, cleaning, clusters, density, gapfill, joins, mergetree, ordered, ranking, resample, reshape
from .operators import trend as tr
from .operators import twosample
from .plans import survey, temperature
from .session import drop_at_exit, materialize, shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
PERIODS = [(1995, 1997, "1995-1997"), (1998, 2001, "1998-2001")]


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def rnd(c, digits: int = 6) -> Column:
    """Rounded double without negative zero."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, digits) + F.lit(0.0)


def rounded(df: DataFrame, digits: int, *cols: str) -> DataFrame:
    return df.withColumns({c: rnd(c, digits) for c in cols})


def seasons(df: DataFrame, date: str) -> DataFrame:
    return df.withColumns({"season": season(F.month(date)), "season_year": season_year(F.col(date))})


def gap(c: str, key: Column, every: int) -> Column:
    return F.when(key % every != 0, F.col(c))


# --- recoding, selection, reshaping ------------------------------------------------------------


@query
def season_means(spark, sf):
    """Seasonal means of a measure."""
    rows = seasons(table(spark, sf, "lineitem"), "l_shipdate")
    out = rows.groupBy("l_returnflag", "season", "season_year").agg(
        F.count("l_extendedprice").alias("n"), F.avg("l_extendedprice").alias("mean_price")
    )
    return rounded(out, 6, "mean_price")


@query
def column_patterns(spark, sf):
    """Columns chosen by pattern and by range: means of the range, maxima of the pattern."""
    li = table(spark, sf, "lineitem")
    span = reshape.between(li, "l_quantity", "l_tax")
    chosen = reshape.pick(li, starts="l_", matches="price|disc", without="key")
    li = li.withColumn("year", F.year("l_shipdate"))
    out = joins.null_safe_join(
        agg.means(li, ["year"], span, "_mean"), agg.maxima(li, ["year"], chosen), ["year"]
    )
    return rounded(out, 6, *[f"{c}_mean" for c in span])


@query
def name_decode(spark, sf):
    """Site, depth and statistic read out of series names."""
    part = table(spark, sf, "part")
    depth = F.element_at(F.array(*[F.lit(d) for d in ("150", "0", "2p5", "80")]), (F.col("p_partkey") % 4 + 1).cast("int"))
    stat = F.element_at(F.array(*[F.lit(d) for d in ("avg", "max", "min")]), (F.col("p_size") % 3 + 1).cast("int"))
    name = F.when(
        F.col("p_partkey") % 11 == 0, F.concat(F.lower(F.substring("p_type", 1, 3)), F.lit("x"))
    ).otherwise(F.concat_ws("_", F.lower(F.substring("p_type", 1, 3)), F.lit("temp"), depth, stat))
    n = F.col("variable")
    out = part.select(name.alias("variable"), "p_retailprice").withColumns(
        {"site": name_site(n), "depth": signed_depth(name_depth(n)), "type": name_stat(n),
         "unit": extract(n, "_(temp)_"), "label": title(name_site(n))}
    )
    out = out.groupBy("site", "label", "depth", "type", "unit").agg(
        F.count(F.lit(1)).alias("n"), F.avg("p_retailprice").alias("mean_price")
    )
    return rounded(out, 6, "mean_price")


@query
def recode_split(spark, sf):
    """Many-to-one recode by a mapping and by a table, text split, left join that keeps matches only."""
    nation, region = table(spark, sf, "nation"), table(spark, sf, "region")
    parts = reshape.separate(nation, "n_name", ["kind", "number"])
    parts = reshape.recode(parts, "kind", {"NATION": "country"})
    names = reshape.recode(region, "r_name", {"AMERICA": "West", "EUROPE": "North", "ASIA": "East"}, "zone")
    lookup = region.select(F.col("r_name").alias("from"), F.concat(F.lit("r"), F.col("r_regionkey")).alias("to")).filter(
        F.col("r_regionkey") < 3
    )
    names = reshape.recode(names, "r_name", lookup, "code", keep_unmatched=False)
    names = reshape.rename(names, n_regionkey="r_regionkey").filter(F.col("n_regionkey") != 4)
    out = joins.null_safe_join(parts, names, ["n_regionkey"]).filter(F.col("zone").isNotNull())
    return out.select("n_nationkey", "kind", F.col("number").cast("int").alias("number"), "zone", "code")


@query
def period_bins(spark, sf):
    """Integer ranges as labels with display order; NULL outside all ranges."""
    o = table(spark, sf, "orders").withColumn("period", reshape.bins(F.year("o_orderdate"), PERIODS[:1] + [(1999, 2001, "late")]))
    o = reshape.ordered_labels(o, "period", {"late": "Late", "1995-1997": "Early"}, ["Early", "Late"])
    return agg.row_counts(o, ["period", "period_ord"])


@query
def pivot_periods(spark, sf):
    """Means per period side by side."""
    li = table(spark, sf, "lineitem").withColumn("period", reshape.bins(F.year("l_shipdate"), PERIODS))
    out = reshape.early_to_late(li, ["l_returnflag", "l_linestatus"], "period", PERIODS[0][2], PERIODS[1][2], MEASURES)
    return rounded(out, 6, *[c for c in out.columns if c.startswith(tuple(MEASURES))])


@query
def long_to_wide(spark, sf):
    """Yearly means, wide to long and back by another key."""
    o = table(spark, sf, "orders").withColumn("year", F.year("o_orderdate"))
    m = agg.means(o, ["year", "o_orderpriority"], ["o_totalprice"])
    labels = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    wide = reshape.to_wide(m, ["year"], "o_orderpriority", ["o_totalprice"], labels)
    wide = reshape.rename(wide, urgent=labels[0], high=labels[1], medium=labels[2], unspecified=labels[3], low=labels[4])
    long = reshape.to_long(wide, ["year"], ["urgent", "high", "medium", "unspecified", "low"])
    return rounded(long, 6, "value")


@query
def array_positions(spark, sf):
    """Parallel arrays unnested: mean of each position of a vector."""
    e = table(spark, sf, "embeddings")
    e = e.select("label", F.sequence(F.lit(1), F.size("embedding")).alias("i"), F.col("embedding").alias("v"))
    out = reshape.unnest(e, ["i", "v"]).groupBy("i").agg(
        F.count("v").alias("n"), F.avg(F.col("v").cast("double")).alias("mean")
    )
    return rounded(out, 6, "mean")


@query
def stacked_tables(spark, sf):
    """Union by name; columns a table lacks are NULL."""
    c = table(spark, sf, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"), "c_mktsegment")
    s = table(spark, sf, "supplier").select(F.col("s_acctbal").alias("balance"), F.col("s_nationkey").alias("nation"))
    out = reshape.stack(c, s).groupBy("nation", "c_mktsegment").agg(
        F.count(F.lit(1)).alias("n"), F.avg("balance").alias("mean_balance")
    )
    return rounded(out, 6, "mean_balance")


@query
def distinct_levels(spark, sf):
    """Distinct values of three columns in one table, from one scan."""
    named = {"status": F.col("o_orderstatus"), "priority": F.col("o_orderpriority"), "year": F.year("o_orderdate").cast("string")}
    cells = F.array(*[F.struct(F.lit(n).alias("col"), c.alias("level")) for n, c in named.items()])
    return agg.distinct_rows(table(spark, sf, "orders").select(F.inline(cells)).filter(F.col("level").isNotNull()), ["col", "level"])


@query
def date_span(spark, sf):
    """First and last date in the compact form that names an output."""
    span = agg.date_range(table(spark, sf, "lineitem"), "l_shipdate")
    return span.select(compact_date(F.col("first")).alias("first"), compact_date(F.col("last")).alias("last"))


@query
def parsed_dates(spark, sf):
    """Dates and numbers out of text; text that is neither gives NULL."""
    o = table(spark, sf, "orders")
    k = F.col("o_orderkey") % 4
    text = (
        F.when(k == 0, F.date_format("o_orderdate", "yyyy-MM-dd"))
        .when(k == 1, F.date_format("o_orderdate", "yyyyMMdd"))
        .when(k == 2, F.date_format("o_orderdate", "yyyy/MM/dd"))
        .otherwise("no date")
    )
    num = F.when(k == 1, "NA").when(k == 2, "12,5x").otherwise(F.col("o_totalprice").cast("int").cast("string"))
    d = o.select(parse_date(text).alias("d"), to_number(num).alias("v"), k.cast("int").alias("notation"))
    out = d.groupBy("notation", F.year("d").alias("year"), padded(F.month("d")).alias("month")).agg(
        F.count("d").alias("dates"), F.count("v").alias("numbers"), F.avg("v").alias("mean")
    )
    return rounded(out, 6, "mean")


@query
def missing_rules(spark, sf):
    """Conditions, bounds, ratios and rounding in the presence of NULL."""
    o = table(spark, sf, "orders")
    v = gap("o_totalprice", F.col("o_orderkey"), 5)
    o = o.select("o_orderkey", v.alias("v"), (F.col("o_custkey") % 3).cast("double").alias("b"))
    return o.select(
        "o_orderkey",
        if_else(F.col("v") > 150000, "high", "low").alias("side"),
        floor_at(F.col("v"), 100000.0).alias("floored"),
        rnd(percent_difference(F.col("v"), F.col("b"))).alias("pct"),
        round_even(F.col("v") / 1000, 1).alias("even"),
        signif(F.col("v"), 3).alias("sig3"),
    )


# --- summaries ---------------------------------------------------------------------------------


@query
def rowwise_mean(spark, sf):
    """Mean over columns of one row, skipping gaps."""
    li = table(spark, sf, "lineitem")
    k = F.col("l_orderkey") + F.col("l_linenumber")
    cols = {"a": gap("l_quantity", k, 3), "b": gap("l_discount", k, 5), "c": gap("l_tax", k, 2)}
    rows = li.select("l_orderkey", "l_linenumber", "l_partkey", *[e.alias(n) for n, e in cols.items()])
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", rnd(row_mean([F.col(c) for c in "abc"]), 6).alias("row_mean"))


@query
def multi_summary(spark, sf):
    """Mean and sd of several measures, and mean, minimum and maximum of different columns."""
    li = table(spark, sf, "lineitem")
    a = agg.means_and_sds(li, ["l_returnflag"], MEASURES)
    b = agg.mean_min_max(li, ["l_returnflag"], "l_quantity", "l_discount", "l_extendedprice", "mix_")
    out = joins.null_safe_join(a, b, ["l_returnflag"])
    return rounded(out, 6, *[c for c in out.columns if c != "l_returnflag"])


@query
def annual_copy_summary(spark, sf):
    """Seasonal mean, minimum and maximum with an added whole-year season, from the long form."""
    o = table(spark, sf, "orders")
    stat = F.element_at(F.array(F.lit("avg"), F.lit("min"), F.lit("max")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    long = o.select("o_orderpriority", "o_orderdate", stat.alias("stat"), F.col("o_totalprice").alias("value"))
    out = temperature.seasonal_summary(long, ["o_orderpriority"], "o_orderdate")
    return rounded(out, 6, "mean_value", "min_value", "max_value")


@query
def five_number(spark, sf):
    """Exact quartiles, whiskers and outlier counts per group."""
    o = table(spark, sf, "orders").withColumn("year", F.year("o_orderdate"))
    out = agg.five_numbers(o, ["o_orderpriority", "year"], "o_totalprice", 0.75)
    return rounded(out, 6, *[c for c in out.columns if c.startswith(("q", "med", "fence", "whisk"))])


@query
def box_outliers(spark, sf):
    """Rows beyond the whiskers."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    return agg.box_outliers(o, ["o_orderpriority"], "o_totalprice", 0.45)


@query
def exact_quantiles(spark, sf):
    """Exact quantiles of one large group and of several."""
    li = table(spark, sf, "lineitem")
    probs = {"p05": 0.05, "p50": 0.5, "p975": 0.975}
    whole = ordered.quantiles(li, [], "l_extendedprice", probs).withColumn("l_returnflag", F.lit("all"))
    parts = ordered.quantiles(li, ["l_returnflag"], "l_extendedprice", probs)
    return rounded(whole.unionByName(parts), 6, *probs)


@query
def threshold_band(spark, sf):
    """Three-sigma band per group with the number of rows outside."""
    li = table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_extendedprice")
    keys = ["l_returnflag", "l_linestatus"]
    band = materialize(agg.threshold_band(li, keys, "l_extendedprice", 2.0))
    flagged = agg.flag_outside_band(li, band, keys, "l_extendedprice").groupBy(*keys).agg(
        F.sum(F.col("outside").cast("long")).alias("outside")
    )
    out = joins.null_safe_join(band, flagged, keys)
    return rounded(out, 6, "mean", "sd", "thresh_low", "thresh_high")


# --- joins -------------------------------------------------------------------------------------


@query
def daily_rollup_join(spark, sf):
    """Readings rolled up to days and joined to a daily table."""
    ev = table(spark, sf, "events").select(F.col("ts").alias("datetime"), F.col("value").alias("station_temp"))
    days = table(spark, sf, "events").select(F.to_date("ts").alias("date")).distinct().filter(F.dayofmonth("date") % 2 == 0)
    more = days.select(F.date_add("date", 40).alias("date"))
    out = joins.weather_join(ev, days.unionByName(more), "datetime", "station_temp", predictor="mean_150")
    return out.select(F.col("date").cast("string").alias("date"), rnd("station_temp").alias("station_temp"), rnd("mean_150").alias("mean_150"))


@query
def suffixed_join(spark, sf):
    """Left join of two aggregates whose columns share a name."""
    o = table(spark, sf, "orders").withColumn("year", F.year("o_orderdate"))
    mean = lambda cond: o.filter(cond).groupBy("o_orderpriority").agg(F.avg("o_totalprice").alias("mean"), F.count(F.lit(1)).alias("n"))
    out = joins.suffixed_left_join(mean("year < 1998"), mean("year >= 1998 and o_orderpriority <> '2-HIGH'"), ["o_orderpriority"], ("_x", "_y"))
    return rounded(out, 6, "mean_x", "mean_y")


@query
def history_join(spark, sf):
    """Left join of two yearly aggregates with the percent difference."""
    o = table(spark, sf, "orders").withColumn("year", F.year("o_orderdate"))
    hist = o.filter("year <> 2000").groupBy("o_orderpriority").agg(F.avg("o_totalprice").alias("mean"))
    cur = o.filter("year = 2000 and o_orderpriority <> '5-LOW'").groupBy("o_orderpriority").agg(F.avg("o_totalprice").alias("mean"))
    return rounded(agg.with_history(hist, cur, ["o_orderpriority"]), 6, "history", "current", "percent_diff")


# --- ranks and scaling -------------------------------------------------------------------------


@query
def avg_rank(spark, sf):
    """Ranks with ties averaged, both ways, in groups of any size."""
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment", F.floor(F.col("c_acctbal") / 100).alias("step"))
    return ranking.average_ranks(c, ["c_mktsegment"], "step", {"rank_up": False, "rank_down": True})


@query
def ranked_years(spark, sf):
    """Yearly means, their deviation from the overall mean and descending rank."""
    li = table(spark, sf, "lineitem").withColumn("year", F.year("l_shipdate"))
    out = anomaly.ranked_years(li, "year", ["l_discount", "l_tax"], "mean", descending=True)
    return rounded(out, 6, "mean", "prop")


@query
def fdr_adjust(spark, sf):
    """Benjamini-Hochberg over all p values and per family, with ties and gaps."""
    part = table(spark, sf, "part")
    h = (F.col("p_partkey") * 7919 + F.col("p_size") * 104729) % 2000
    p = F.when(h % 13 != 0, F.sqrt(h) / 45)
    rows = part.select("p_partkey", "p_brand", p.alias("p"))
    out = ranking.adjust_fdr(rows, "p", "p_all")
    out = ranking.adjust_fdr(out, "p", "p_family", ["p_brand"])
    return rounded(out, 8, "p", "p_all", "p_family")


@query
def zscore_columns(spark, sf):
    """Standardised group means."""
    out = ranking.zscores(nation_features(spark, sf), ["bal", "size", "spread"])
    return rounded(out, 6, "bal", "size", "spread")


@query
def drop_partial_years(spark, sf):
    """Season-years without the incomplete first and last one, overall and per group."""
    o = seasons(table(spark, sf, "orders"), "o_orderdate")
    m = agg.long_means(o, ["o_orderpriority", "season", "season_year"], "o_totalprice")
    inner = ranking.drop_edges(m, "season_year", ["o_orderpriority", "season"], True, True)
    rest = ranking.drop_edges(m, "season_year", first=True)
    a = inner.select(F.lit("inner").alias("kind"), *m.columns)
    return rounded(a.unionByName(rest.select(F.lit("rest").alias("kind"), *m.columns)), 6, "value")


@query
def rescale_popup(spark, sf):
    """Marker radius and popup text."""
    s = table(spark, sf, "supplier").withColumn("size", F.abs("s_acctbal"))
    s = ranking.rescale(s, F.col("size"), "radius", 4.0, 10.0)
    text = labelled_text({"Site": F.col("s_name"), "Metric": F.lit("HTC"), "Slope": F.bround(F.col("s_acctbal") / 7 + 0.01, 3),
                          "p": signif((F.col("s_suppkey") % 97 + 1) / F.lit(101.0), 3)})
    return s.select("s_suppkey", rnd("radius", 6).alias("radius"), text.alias("popup"))


# --- trends ------------------------------------------------------------------------------------

FIT = ["slope", "se", "p_value", "ci_lower", "ci_upper", "p_adj"]


@query
def seasonal_trend(spark, sf):
    """Seasonal means, edges dropped, trend per group with interval, p and FDR."""
    li = seasons(table(spark, sf, "lineitem"), "l_shipdate")
    m = agg.long_means(li, ["l_returnflag", "season", "season_year"], "l_extendedprice")
    m = ranking.drop_edges(m, "season_year", ["l_returnflag", "season"], True, True)
    fits = tr.add_fdr(tr.add_interval(tr.fit_trend(m, ["l_returnflag", "season"], "season_year", "value")))
    out = fits.select("l_returnflag", "season", "n", "slope", "se", "p_value", "ci_lower", "ci_upper", "sig_ci", "p_adj", "sig_fdr")
    return rounded(out, 5, *FIT)


@query
def annual_trend_long(spark, sf):
    """Trend of the yearly mean of each measure, first and last year left out."""
    li = table(spark, sf, "lineitem").withColumn("year", F.year("l_shipdate"))
    fits = temperature.annual_slopes(li, "year", MEASURES, first=True, last=True)
    out = fits.select("variable", "n", "slope", "se", "p_value", "ci_lower", "ci_upper", "sig_ci", "p_adj", "sig_fdr")
    return rounded(out, 6, *FIT)


@query
def trend_terms(spark, sf):
    """Intercept and slope of every group's line as rows with their errors and p values."""
    rows = yearly_rows(spark, sf)
    out = tr.coefficients(tr.fit_trend(rows, ["l_returnflag"], "year", "value"), ["l_returnflag"], "year")
    return rounded(out, 5, "estimate", "std_error", "statistic", "p_value")


@query
def combined_trends(spark, sf):
    """Annual and seasonal trends in one table with ordered period labels."""
    o = table(spark, sf, "orders").withColumn("year", F.year("o_orderdate"))
    cols = {"abc_temp_150_avg": F.col("o_totalprice"), "abc_temp_2p5_avg": F.col("o_totalprice") * (F.col("o_orderkey") % 3),
            "xyz_temp_80_max": F.sqrt("o_totalprice")}
    o = o.select("year", "o_orderdate", *[e.alias(n) for n, e in cols.items()])
    a = temperature.annual_slopes(o, "year", list(cols))
    s = temperature.seasonal_slopes(o, "o_orderdate", list(cols))
    out = temperature.combined_slopes(a, s, "avg", {"Annual": "Annual", "Cool": "Oct-May", "Warm": "Jun-Sep"}, {"abc": "Alpha"})
    out = out.select("variable", "site", "depth", "period", "period_ord", "n", "slope", "se", "p_value", "p_adj", "significant")
    return rounded(out, 5, "slope", "se", "p_value", "p_adj")


@query
def significant_lines(spark, sf):
    """Fitted values of the groups whose trend is significant."""
    li = table(spark, sf, "lineitem").withColumn("year", F.year("l_shipdate"))
    rows = li.select("l_returnflag", "year", (F.col("l_extendedprice") + (F.col("l_suppkey") % 2) * (F.col("year") - 1990) * 900).alias("v"),
                     (F.col("l_suppkey") % 2).cast("int").alias("odd"))
    fits = tr.significant(tr.fit_trend(rows, ["l_returnflag", "odd"], "year", "v"))
    return rounded(tr.fitted_lines(rows, fits, ["l_returnflag", "odd"], "year"), 4, "slope", "intercept", "mean_pred")


@query
def residual_table(spark, sf):
    """Leverage, residuals and Cook's distance around significant yearly trends."""
    rows = yearly_rows(spark, sf)
    out = temperature.significant_residuals(rows, ["l_returnflag"], "year", "value", alpha=0.9)
    return rounded(out, 5, "value", "fitted", "resid", "hat", "sigma_without", "cooksd", "std_resid")


def yearly_rows(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("year", F.year("l_shipdate"))
    return agg.long_means(li, ["l_returnflag", "year"], "l_extendedprice")


@query
def site_trends(spark, sf):
    """Trend per site and metric for the sites with coordinates, with marker size."""
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders")
    n = table(spark, sf, "nation")
    rows = o.join(c, o.o_custkey == c.c_custkey).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    rows = rows.select(F.col("n_name").alias("site"), F.year("o_orderdate").alias("year"), F.col("o_totalprice").alias("swe"),
                       F.col("c_acctbal").alias("htc"))
    points = n.filter("n_nationkey % 3 <> 0").select(
        F.col("n_name").alias("site"), (F.col("n_nationkey") * -1.25).alias("lon"), (F.col("n_nationkey") + 50.5).alias("lat")
    )
    out = survey.site_trends(rows, points, ["swe", "htc"])
    out = out.select("site", "lat", "lon", "metric", "n", "slope", "se", "p_value", "sig", "radius")
    return rounded(out, 4, "lat", "lon", "slope", "se", "p_value", "radius")


# --- one sample against another ----------------------------------------------------------------


@query
def anomaly_baseline(spark, sf):
    """Pooled yearly mean of two measures against the mean of the baseline years."""
    k = F.col("l_orderkey") + F.col("l_linenumber")
    li = table(spark, sf, "lineitem").select(
        F.year("l_shipdate").alias("year"), gap("l_discount", k, 7).alias("a"), gap("l_tax", k, 3).alias("b")
    )
    yearly = materialize(anomaly.yearly_pooled(li, "year", ["a", "b"]))
    return rounded(anomaly.baseline_anomaly(yearly, "year", "mean", 1996, 2000), 8, "mean", "baseline", "diff")


@query
def year_vs_history_tests(spark, sf):
    """Current year against all others: means, percent difference, F test, chosen t test."""
    o = table(spark, sf, "orders").withColumn("year", F.year("o_orderdate"))
    out = survey.year_report(o, ["o_orderpriority"], "o_totalprice", "year", 2000)
    return rounded(out, 6, "history", "current", "percent_diff", "f", "p_f", "t", "df", "p")


@query
def both_mean_tests(spark, sf):
    """Welch and pooled t tests of two halves of each part brand."""
    p = table(spark, sf, "part")
    sums = twosample.sample_sums(p, ["p_brand"], "p_retailprice", F.col("p_size") > 25)
    out = twosample.mean_tests(twosample.variance_test(sums))
    return rounded(out, 6, *[c for c in out.columns if c not in ("p_brand", "n_c", "n_t")])


# --- resampling --------------------------------------------------------------------------------


@query
def bootstrap_ci(spark, sf):
    """Bootstrap interval of the difference between two periods."""
    o = table(spark, sf, "orders").withColumn("year", F.year("o_orderdate"))
    out = resample.bootstrap_interval(o, ["o_orderpriority"], ["o_totalprice"], F.col("year") >= 1998, ["o_orderkey"])
    return rounded(out, 3, "lower", "upper")


@query
def period_change(spark, sf):
    """Early and late means per group with bootstrap bounds and line styles of two metrics."""
    s = table(spark, sf, "lineitem")
    s = s.select(F.col("l_returnflag").alias("ecosystem"), reshape.bins(F.year("l_shipdate"), PERIODS).alias("period"),
                 F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber").alias("id"),
                 F.col("l_extendedprice").alias("swe"), F.col("l_quantity").alias("htc"))
    out = survey.period_change(s, "ecosystem", PERIODS[0][2], PERIODS[1][2], ["swe", "htc"], ["swe", "htc"], ["id"])
    return rounded(out, 3, *[c for c in out.columns if c.endswith(("early", "late", "lower", "upper"))])


def nation_features(spark, sf):
    """One row per (nation, segment): the size of the nation grid, whatever the scale."""
    c = table(spark, sf, "customer")
    return materialize(
        c.groupBy("c_nationkey", "c_mktsegment").agg(
            F.avg("c_acctbal").alias("bal"),
            F.count(F.lit(1)).cast("double").alias("size"),
            (F.max("c_acctbal") - F.min("c_acctbal")).alias("spread"),
        )
    )


FEATURES = ["bal", "size", "spread"]


def customer_features(spark, sf):
    """One row per customer with standardised balance, number of orders and mean order price."""
    orders = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).cast("double").alias("orders"), F.avg("o_totalprice").alias("price"))
    c = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    c = c.join(orders, F.col("c_custkey") == F.col("o_custkey"), "left")
    zero = lambda x: F.coalesce(x, F.lit(0.0)).alias(x)
    rows = materialize(c.select("c_custkey", "c_mktsegment", "n_regionkey", F.col("c_acctbal").alias("bal"), zero("orders"), zero("price")))
    return ranking.zscores(rows, CUSTOMER_FEATURES)


CUSTOMER_FEATURES = ["bal", "orders", "price"]


@query
def permanova(spark, sf):
    """Permutational analysis of variance by one factor."""
    out = resample.permanova(customer_features(spark, sf), "c_custkey", ["c_mktsegment"], CUSTOMER_FEATURES)
    return rounded(out.drop("ord"), 6, "ss", "r2", "f", "p")


@query
def permanova_two(spark, sf):
    """Two factors and their interaction, cells of different sizes."""
    out = resample.permanova(customer_features(spark, sf), "c_custkey", ["c_mktsegment", "n_regionkey"], CUSTOMER_FEATURES)
    return rounded(out.drop("ord"), 6, "ss", "r2", "f", "p")


# --- densities ---------------------------------------------------------------------------------


@query
def kde_grid(spark, sf):
    """Kernel density per group on 512 points."""
    out = density.kernel_density(table(spark, sf, "customer"), ["c_mktsegment"], "c_acctbal")
    return rounded(rounded(out, 4, "x"), 9, "y")


@query
def kde_peak(spark, sf):
    """Largest density per group."""
    curves = density.kernel_density(table(spark, sf, "lineitem"), ["l_returnflag"], "l_quantity")
    return rounded(density.peak_density(curves, ["l_returnflag"]), 8, "max_density")


@query
def kde_shifted(spark, sf):
    """Largest density of groups that lie far apart."""
    c = table(spark, sf, "customer").select("c_nationkey", (F.col("c_acctbal") + F.col("c_nationkey") * 1e7).alias("v"))
    out = density.peak_density(density.kernel_density(c, ["c_nationkey"], "v"), ["c_nationkey"])
    return rounded(out, 8, "max_density")


@query
def normal_curve(spark, sf):
    """Normal density of each group's mean and sd on 200 points."""
    stats = table(spark, sf, "customer").groupBy("c_mktsegment").agg(
        F.avg("c_acctbal").alias("mean"), F.stddev_samp("c_acctbal").alias("sd")
    )
    out = density.normal_curves(stats, ["c_mktsegment"])
    return rounded(rounded(out.select("c_mktsegment", "i", "x", "y"), 4, "x"), 10, "y")


# --- gaps, outliers, bounds --------------------------------------------------------------------

LINE_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def gappy_lines(spark, sf):
    k = F.col("l_orderkey") * 7 + F.col("l_linenumber") + F.col("l_partkey")
    return table(spark, sf, "lineitem").select(
        *LINE_KEY, F.month("l_shipdate").alias("month"), "l_quantity", "l_discount",
        gap("l_extendedprice", k, 5).alias("price"), gap("l_tax", k, 3).alias("tax"),
        gap("l_quantity", k, 11).alias("qty"),
    )


@query
def monthly_fill_lm(spark, sf):
    """Gaps filled by one line per calendar month."""
    rows = gappy_lines(spark, sf)
    out = gapfill.fill_from(rows, ["month"], ["price"], "l_quantity")
    return out.select(*LINE_KEY, rnd("price", 2).alias("price"))


@query
def mean_imputed(spark, sf):
    """Gaps filled by the overall mean, then summarised by month."""
    out = gapfill.impute_mean(gappy_lines(spark, sf), "tax").groupBy("month").agg(F.avg("tax").alias("tax"))
    return rounded(out, 8, "tax")


@query
def multiple_regression(spark, sf):
    """Regression on two predictors per month from one aggregate."""
    fits = gapfill.fit_models(gappy_lines(spark, sf), ["month"], [gapfill.Model("price", ("l_quantity", "l_discount"))])
    c = F.col("coef")
    out = fits.select("month", "n", c[gapfill.INTERCEPT].alias("b0"), c["l_quantity"].alias("b1"), c["l_discount"].alias("b2"), "rss", "aic")
    out = out.withColumn("rss", F.col("rss") / 1e9)
    return rounded(out, 3, "b0", "b1", "b2", "rss", "aic")


@query
def stepwise_regression(spark, sf):
    """Backward selection by AIC per month: which predictors stay, and their coefficients."""
    fits = gapfill.fit_models(gappy_lines(spark, sf), ["month"], [gapfill.Model("price", ("l_quantity", "l_discount"), True)])
    c = F.col("coef")
    out = fits.select("month", "n", c[gapfill.INTERCEPT].alias("b0"), c["l_quantity"].alias("b1"), c["l_discount"].alias("b2"), "aic")
    return rounded(out, 3, "b0", "b1", "b2", "aic")


@query
def cascade_fill(spark, sf):
    """Three dependent fills, the later ones stepwise, with a bound applied in between."""
    steps = [
        gapfill.Model("price", ("l_quantity",)),
        gapfill.Model("qty", ("price", "l_discount"), True),
        gapfill.Model("tax", ("price", "qty", "l_discount"), True),
    ]
    after = {"price": lambda d: cleaning.clamp_columns(d, "month", [cleaning.Clamp("price", None, 0.0, 1e6)])}
    out = gapfill.cascade(gappy_lines(spark, sf), ["month"], steps, after)
    return out.select(*LINE_KEY, rnd("price", 2).alias("price"), rnd("qty", 2).alias("qty"), rnd("tax", 4).alias("tax"))


SENSOR_SERIES = sorted({c for target, predictors, _ in temperature.SENSOR_STEPS for c in (target, *predictors)} - {temperature.STATION})


def daily_sensors(spark, sf):
    """Wide daily table of the standard cascade's sensors, each fed by the line items of some suppliers, with gaps of four days in forty."""
    l = table(spark, sf, "lineitem").withColumn("day", F.datediff("l_shipdate", F.lit("1992-01-01")))
    wave = F.sin(2 * math.pi * (F.col("day") - 100) / 365.25)
    aggs = []
    for i, name in enumerate(SENSOR_SERIES):
        depth = name_depth_factor(name)
        seen = (F.col("l_suppkey") % len(SENSOR_SERIES) == i) & ((F.col("day") + 17 * i) % 40 >= 4)
        value = F.when(seen, 12 * depth * wave + (F.col("l_quantity") - 25) * depth / 10)
        aggs += [f(value).alias(f"{name}_{s}") for s, f in (("avg", F.avg), ("max", F.max), ("min", F.min))]
    return l.groupBy(F.col("l_shipdate").cast("date").alias("date")).agg(*aggs)


def name_depth_factor(name: str) -> float:
    """How much of the air's swing a sensor shows; less with its depth, which ends its name."""
    depth = float(name.rsplit("_", 1)[1].replace("p", "."))
    return 1.0 if depth == 150 else 0.6 / (1 + depth / 20)


@query
def sensor_fill(spark, sf):
    """The whole gap fill: station join, air fills, outliers, bounds and the cascade of 36 models, most of them stepwise."""
    o = table(spark, sf, "orders")
    wave = F.sin(2 * math.pi * (F.datediff("o_orderdate", F.lit("1992-01-01")) - 100) / 365.25)
    weather = o.select(F.col("o_orderdate").cast("timestamp_ntz").alias("datetime"), (12 * wave + (F.col("o_totalprice") % 1000) / 200 - 2.5).alias("station_temp"))
    out = temperature.fill_sensor_table(materialize(daily_sensors(spark, sf)), weather)
    return out.select("date", *[rnd(f"{c}_{s}", 3).alias(f"{c}_{s}") for c in SENSOR_SERIES for s in temperature.STATS])


@query
def cascade_pair(spark, sf):
    """Two dependent fills, the second one stepwise."""
    steps = [gapfill.Model("price", ("l_quantity",)), gapfill.Model("tax", ("price", "l_discount"), True)]
    out = gapfill.cascade(gappy_lines(spark, sf), ["month"], steps)
    return out.select(*LINE_KEY, rnd("price", 2).alias("price"), rnd("tax", 5).alias("tax"))


@query
def clamp_rules(spark, sf):
    """Date-bounded and unconditional bounds from a rule table on the long form."""
    li = table(spark, sf, "lineitem").select(*LINE_KEY, F.to_date("l_shipdate").alias("date"), *MEASURES)
    long = reshape.to_long(li, [*LINE_KEY, "date"], MEASURES)
    rules = table(spark, sf, "region").select(
        F.element_at(F.array(*[F.lit(c) for c in MEASURES]), (F.col("r_regionkey") % 4 + 1).cast("int")).alias("variable"),
        F.when(F.col("r_regionkey") % 2 == 0, F.make_date(F.lit(1996) + F.col("r_regionkey"), F.lit(1), F.lit(1))).alias("before"),
        F.when(F.col("r_regionkey") != 1, F.lit(0.02)).alias("lo"),
        F.when(F.col("r_regionkey") != 3, F.col("r_regionkey") * 10000 + 20.0).alias("hi"),
    )
    out = cleaning.clamp_long(long, "date", rules)
    out = out.groupBy("variable", F.year("date").alias("year")).agg(
        F.min("value").alias("low"), F.max("value").alias("high"), F.avg("value").alias("mean")
    )
    return rounded(out, 5, "low", "high", "mean")


@query
def clamp_wide(spark, sf):
    """Bounds on the columns of a wide table."""
    li = table(spark, sf, "lineitem").select(*LINE_KEY, F.to_date("l_shipdate").alias("date"), "l_quantity", "l_tax")
    rules = [cleaning.Clamp("l_quantity", "1998-01-01", 5.0, 40.0), cleaning.Clamp("l_tax", None, 0.02, None)]
    return cleaning.clamp_columns(li, "date", rules).select(*LINE_KEY, "l_quantity", "l_tax")


def gappy_events(spark, sf):
    return table(spark, sf, "events").select("user_id", "ts", "event_id", gap("value", F.col("event_id"), 7).alias("value"))


@query
def interpolated_series(spark, sf):
    """Linear interpolation by row, ends repeated."""
    out = cleaning.interpolate(gappy_events(spark, sf), ["user_id"], ["ts", "event_id"], "value")
    return out.select("event_id", "user_id", rnd("value", 5).alias("value"))


@query
def interpolated_by_time(spark, sf):
    """Linear interpolation along time."""
    ev = gappy_events(spark, sf).withColumn("us", micros(F.col("ts")))
    out = cleaning.interpolate(ev, ["user_id"], ["ts", "event_id"], "value", axis="us")
    return out.select("event_id", "user_id", rnd("value", 5).alias("value"))


@query
def clean_series(spark, sf):
    """Outliers against a rolling median replaced by interpolation."""
    ev = gappy_events(spark, sf)
    ev = ev.withColumn("value", F.when(F.col("event_id") % 101 == 0, F.col("value") * 50 + 500).otherwise(F.col("value")))
    out = cleaning.clean_series(ev, ["user_id"], ["ts", "event_id"], "value", half_width=3, iterations=1)
    return out.select("event_id", "user_id", rnd("cleaned", 4).alias("cleaned"), F.col("cleaned_outlier").alias("outlier"))


@query
def clean_series_spans(spark, sf):
    """Outliers against a smooth of variable span replaced by interpolation, twice."""
    ev = gappy_events(spark, sf)
    ev = ev.withColumn("value", F.when(F.col("event_id") % 101 == 0, F.col("value") * 50 + 500).otherwise(F.col("value")))
    out = cleaning.clean_series_by_span(ev, ["user_id"], ["ts", "event_id"], "value")
    return out.select("event_id", "user_id", rnd("cleaned", 6).alias("cleaned"), F.col("cleaned_outlier").alias("outlier"))


# --- text files --------------------------------------------------------------------------------


@query
def field_problems(spark, sf):
    """Orders written as text with spoiled fields; the fields that do not fit, by column and content."""
    o = table(spark, sf, "orders")
    number = F.when(F.col("o_orderkey") % 50 == 3, F.concat(F.lit("n"), (F.col("o_orderkey") % 7).cast("string"))).otherwise(F.col("o_custkey").cast("string"))
    day = F.when(F.col("o_orderkey") % 70 == 5, F.lit("1995-02-31")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    path = f"{shared_folder(spark)}/driftline-{uuid.uuid4().hex}"
    o.select("o_orderkey", number.alias("o_custkey"), day.alias("o_orderdate"), "o_orderstatus").write.option("header", True).csv(path)
    drop_at_exit(spark, path)
    found = sources.field_problems(spark, path, "o_orderkey bigint, o_custkey int, o_orderdate date, o_orderstatus string")
    return found.groupBy("column", "expected", "actual").agg(F.count(F.lit(1)).alias("n"))


# --- clusters ----------------------------------------------------------------------------------


@query
def pair_squares(spark, sf):
    """Squared distances over all pairs of each group, without forming pairs."""
    out = clusters.pair_squares(customer_features(spark, sf), ["c_mktsegment"], CUSTOMER_FEATURES)
    return rounded(out, 6, "sum_sq", "mean_sq")


@query
def centroid_distance(spark, sf):
    """Distance of each group's mean to the overall mean."""
    out = clusters.centroid_distance(customer_features(spark, sf), ["c_mktsegment"], CUSTOMER_FEATURES)
    return rounded(out, 6, "distance")


@query
def kmeans_clusters(spark, sf):
    """Three clusters of the vectors: size of each."""
    out = clusters.cluster(table(spark, sf, "embeddings"), ["embedding"], 3)
    return agg.row_counts(out, ["cluster"])


@query
def split_clusters(spark, sf):
    """Three clusters by splitting in two."""
    rows = ranking.zscores(nation_features(spark, sf), FEATURES)
    return agg.row_counts(clusters.cluster(rows, FEATURES, 3, bisecting=True), ["cluster"])


@query
def ward_tree(spark, sf):
    """Merges of a tree over the standardised (nation, segment) groups, with their heights."""
    out = mergetree.merge_tree(ranking.zscores(nation_features(spark, sf), FEATURES), FEATURES)
    return out.select("step", "a", "b", rnd("height", 5).alias("height"), "n", rnd("wss", 4).alias("wss"))


@query
def ward_cut(spark, sf):
    """The tree cut into three clusters, described by size and means."""
    out = mergetree.merge_cut(ranking.zscores(nation_features(spark, sf), FEATURES), FEATURES, 3)
    return out.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), *[rnd(F.avg(c), 5).alias(c) for c in FEATURES])


@query
def elbow(spark, sf):
    """Within-cluster sum of squares for 1 to 10 clusters."""
    out = clusters.elbow(spark, customer_features(spark, sf), CUSTOMER_FEATURES)
    return rounded(out, 4, "wss")


@query
def gap_statistic(spark, sf):
    """Gap statistic for 1 to 10 clusters."""
    out = clusters.gap_statistic(spark, customer_features(spark, sf), CUSTOMER_FEATURES, ["c_custkey"])
    return rounded(out, 4, "log_w", "expected", "gap", "se")


# --- survey ------------------------------------------------------------------------------------


@query
def survey_summary(spark, sf):
    """Sites recoded to ecosystems, years to periods, missing sites dropped; mean and sd per group without some sites."""
    o = table(spark, sf, "orders").select(
        F.when(F.col("o_orderkey") % 11 != 0, F.col("o_orderpriority")).alias("site"), F.year("o_orderdate").alias("year"),
        F.col("o_totalprice").alias("depth"), (F.col("o_totalprice") / (F.col("o_custkey") % 7 + 1)).alias("swe"),
    )
    sites = {"1-URGENT": "North", "2-HIGH": "North", "3-MEDIUM": "South", "4-NOT SPECIFIED": "No Data"}
    prepared = survey.prepare_survey(o, sites, {"North": "Forest", "South": "Fen"}, PERIODS)
    out = survey.group_summary(prepared, ["ecosystem", "period"], ["depth", "swe"], exclude=["5-LOW"])
    return rounded(out, 4, *[c for c in out.columns if c not in ("ecosystem", "period")])


@query
def needle_ranking(spark, sf):
    """Yearly means of a text measurement at chosen sites and in one zone, with deviation and rank."""
    o = table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("Site"), F.col("o_orderstatus").alias("Zone"), F.year("o_orderdate").alias("year"),
        F.when(F.col("o_orderkey") % 13 == 0, F.lit("NA")).when(F.col("o_orderkey") % 17 == 0, F.lit("1.2.3")).otherwise(F.col("o_totalprice").cast("string")).alias("gmin"),
    )
    out = survey.ranked_measurements(o, ["1-URGENT", "3-MEDIUM"], {"O": "F", "R": "F"}, "F", "gmin")
    return rounded(out, 5, *[c for c in out.columns if c not in ("year",)])
