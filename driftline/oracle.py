"""SQL for the queries of :mod:`driftline.catalog`, with the same column names.

Written for DuckDB over views named like the tables. Queries whose result depends on a library's random
start (clusters) have none.
"""

from __future__ import annotations

from itertools import combinations

ORACLES: dict[str, str] = {}


def rnd(expr: str, digits: int = 6, name: str | None = None) -> str:
    return f"round({expr}, {digits}) + 0.0 AS {name or expr}"


def season(date: str) -> str:
    return f"CASE WHEN month({date}) IN (6, 7, 8, 9) THEN 'warm' ELSE 'cool' END"


def season_year(date: str) -> str:
    return f"CAST(year({date}) + CASE WHEN month({date}) >= 10 THEN 1 ELSE 0 END AS INT)"


# --- tail probabilities by quadrature ----------------------------------------------------------

STEPS = 400
HALF_PI = "(pi() / 2)"


def _log(power: str, v: str) -> str:
    return f"(CASE WHEN {power} = 0 THEN 0.0::DOUBLE ELSE {power} * ln(greatest({v}, 1e-300::DOUBLE)) END)"


def _simpson(lo: str, h: str, shift: str, log_f) -> str:
    x = f"({lo} + {h} * i)"
    w = f"(CASE WHEN i = 0 OR i = {STEPS} THEN 1.0 WHEN i % 2 = 1 THEN 4.0 ELSE 2.0 END)"
    body = f"{w} * exp({log_f(x)} - {shift})"
    return f"(list_sum(list_transform(range(0, {STEPS + 1}), lambda i: {body})) * {h} / 3.0)"


def _reach(slope: str, curv: str) -> str:
    return f"(CASE WHEN {curv} = 0 THEN {HALF_PI} ELSE 80.0 / ({slope} + sqrt({slope} * {slope} + {curv} * 80.0)) END)"


def with_t_p(source: str, t: str, df: str, name: str) -> str:
    """Subquery: all columns of ``source`` and the two-sided p of column ``t`` on ``df`` degrees of freedom."""
    log_f = lambda x: _log("pw_", f"cos({x})")
    return f"""(
  SELECT * EXCLUDE (pw_, a0_, h_, z_, s_),
    CASE WHEN {df} >= 1 AND {t} IS NOT NULL THEN least(1.0::DOUBLE,
      exp(s_) * {_simpson("a0_", "h_", "s_", log_f)} / {_simpson("0.0::DOUBLE", "z_", "0.0", log_f)}) END AS {name}
  FROM (SELECT *, (least({HALF_PI}, a0_ + {_reach("(pw_ * tan(a0_))", "pw_")}) - a0_) / {STEPS}.0 AS h_,
               least({HALF_PI}, {_reach("0.0::DOUBLE", "pw_")}) / {STEPS}.0 AS z_, {_log("pw_", "cos(a0_)")} AS s_
        FROM (SELECT *, CAST({df} AS DOUBLE) - 1.0 AS pw_, atan(abs({t}) / sqrt({df})) AS a0_ FROM {source}) q1_) q2_
)"""


def with_f_p(source: str, f: str, d1: str, d2: str, name: str) -> str:
    """Subquery: all columns of ``source`` and the two-sided p of the variance ratio ``f``."""
    log_f = lambda x: f"({_log('a_', f'sin({x})')} + {_log('b_', f'cos({x})')})"
    fall = f"abs((CASE WHEN a_ = 0 THEN 0.0 ELSE a_ / tan(greatest(at_, 1e-12)) END) - b_ * tan(at_))"
    curv = "power(sqrt(a_) + sqrt(b_), 2)"
    total = f"({_simpson('lo_', '((pk_ - lo_) / 400.0)', 'ps_', log_f)} + {_simpson('pk_', '((hi_ - pk_) / 400.0)', 'ps_', log_f)})"
    up = _simpson("at_", f"((least({HALF_PI}, at_ + near_) - at_) / 400.0)", "as_", log_f)
    down = _simpson("greatest(0.0::DOUBLE, at_ - near_)", "((at_ - greatest(0.0::DOUBLE, at_ - near_)) / 400.0)", "as_", log_f)
    return f"""(
  SELECT * EXCLUDE (a_, b_, at_, pk_, lo_, hi_, near_, ps_, as_, one_),
    CASE WHEN {d1} >= 1 AND {d2} >= 1 AND {f} > 0 THEN least(1.0::DOUBLE, 2.0 * least(one_, 1.0 - one_))
         WHEN {d1} >= 1 AND {d2} >= 1 AND {f} = 0 THEN 0.0::DOUBLE END AS {name}
  FROM (SELECT *, (CASE WHEN at_ >= pk_ THEN {up} ELSE {down} END) * exp(as_ - ps_) / {total} AS one_
  FROM (SELECT *, greatest(0.0::DOUBLE, pk_ - {_reach("0.0::DOUBLE", curv)}) AS lo_,
               least({HALF_PI}, pk_ + {_reach("0.0::DOUBLE", curv)}) AS hi_,
               {_reach(f"({fall})", curv)} AS near_, {log_f("pk_")} AS ps_, {log_f("at_")} AS as_
  FROM (SELECT *, atan(sqrt({f} * {d1} / {d2})) AS at_,
               CASE WHEN a_ = 0 AND b_ = 0 THEN pi() / 4 ELSE atan2(sqrt(a_), sqrt(b_)) END AS pk_
  FROM (SELECT *, CASE WHEN {d1} >= 1 THEN CAST({d1} AS DOUBLE) - 1.0 END AS a_,
               CASE WHEN {d2} >= 1 THEN CAST({d2} AS DOUBLE) - 1.0 END AS b_ FROM {source}) q1_) q2_) q3_) q4_
)"""


def fits(source: str, keys: str, x: str, y: str) -> str:
    """Subquery with the trend of ``y`` on ``x`` per key."""
    both = f"{x} IS NOT NULL AND {y} IS NOT NULL"
    raw = f"""(SELECT {keys}, CAST(regr_count({y}, {x}) AS BIGINT) AS n,
  CASE WHEN regr_sxx({y}, {x}) <> 0 THEN regr_slope({y}, {x}) END AS slope,
  CASE WHEN regr_sxx({y}, {x}) <> 0 THEN regr_intercept({y}, {x}) END AS intercept,
  avg({x}) FILTER ({both}) AS x_mean, regr_sxx({y}, {x}) AS sxx, regr_syy({y}, {x}) AS syy, regr_sxy({y}, {x}) AS sxy
  FROM {source} GROUP BY {keys})"""
    sized = f"""(SELECT *, sqrt(rss / df) AS sigma, CASE WHEN sxx <> 0 THEN sqrt(rss / df) / sqrt(sxx) END AS se
  FROM (SELECT *, CASE WHEN sxx <> 0 THEN greatest(0.0::DOUBLE, syy - sxy * sxy / sxx) END AS rss,
               CASE WHEN n > 2 THEN CAST(n - 2 AS DOUBLE) END AS df FROM {raw} f1_) f2_)"""
    tested = f"(SELECT *, CASE WHEN se <> 0 THEN slope / se END AS t FROM {sized} f3_)"
    return with_t_p(f"{tested} f4_", "t", "df", "p_value")


def interval(source: str) -> str:
    return f"""(SELECT *, CASE WHEN ci_lower > 0 OR ci_upper < 0 THEN 'Yes' WHEN ci_lower IS NOT NULL THEN 'No' END AS sig_ci
  FROM (SELECT *, slope - 1.96 * se AS ci_lower, slope + 1.96 * se AS ci_upper FROM {source} i1_) i2_)"""


def fdr(source: str, p: str = "p_value", name: str = "p_adj", family: str = "") -> str:
    """Subquery: Benjamini-Hochberg over the non-NULL p of each family."""
    part = f"PARTITION BY {family}, {p} IS NULL" if family else f"PARTITION BY {p} IS NULL"
    return f"""(SELECT * EXCLUDE (raw_), CASE WHEN {p} IS NOT NULL THEN least(1.0::DOUBLE,
    min(raw_) OVER ({part} ORDER BY {p} DESC ROWS UNBOUNDED PRECEDING)) END AS {name}
  FROM (SELECT *, {p} * count(*) OVER ({part}) / count(*) OVER ({part} ORDER BY {p} RANGE UNBOUNDED PRECEDING) AS raw_
        FROM {source} b1_) b2_)"""


def fdr_flag(source: str) -> str:
    return f"""(SELECT *, CASE WHEN p_adj < 0.05 THEN 'Yes' WHEN p_adj IS NOT NULL THEN 'No' END AS sig_fdr FROM {fdr(source)} g1_)"""


# --- recoding, selection, reshaping ------------------------------------------------------------

ORACLES["season_means"] = f"""
SELECT l_returnflag, {season("l_shipdate")} AS season, {season_year("l_shipdate")} AS season_year,
       count(*) AS n, {rnd("avg(l_extendedprice)", 6, "mean_price")}
FROM lineitem GROUP BY ALL"""

MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]

ORACLES["column_patterns"] = f"""
SELECT CAST(year(l_shipdate) AS INT) AS year, {", ".join(rnd(f"avg({c})", 6, f"{c}_mean") for c in MEASURES)},
       max(l_extendedprice) AS l_extendedprice, max(l_discount) AS l_discount
FROM lineitem GROUP BY year(l_shipdate)"""

ORACLES["name_decode"] = f"""
WITH v AS (SELECT CASE WHEN p_partkey % 11 = 0 THEN lower(substr(p_type, 1, 3)) || 'x'
    ELSE lower(substr(p_type, 1, 3)) || '_temp_' || (['150', '0', '2p5', '80'])[p_partkey % 4 + 1]
         || '_' || (['avg', 'max', 'min'])[p_size % 3 + 1] END AS variable, p_retailprice FROM part),
d AS (SELECT *, substr(variable, 1, 3) AS site, nullif(regexp_extract(variable, '([^_]+)$', 1), '') AS type,
    TRY_CAST(replace(nullif(regexp_extract(variable, '_([0-9]+p?5?)_', 1), ''), 'p', '.') AS DOUBLE) AS raw,
    nullif(regexp_extract(variable, '_(temp)_', 1), '') AS unit FROM v)
SELECT site, upper(substr(site, 1, 1)) || substr(site, 2) AS label,
       CASE WHEN raw IN (0, 150) THEN raw ELSE -raw END AS depth, type, unit,
       count(*) AS n, {rnd("avg(p_retailprice)", 6, "mean_price")}
FROM d GROUP BY ALL"""

ORACLES["recode_split"] = """
SELECT n_nationkey, CASE split_part(n_name, '_', 1) WHEN 'NATION' THEN 'country' ELSE split_part(n_name, '_', 1) END AS kind,
       CAST(split_part(n_name, '_', 2) AS INT) AS number,
       CASE r_name WHEN 'AMERICA' THEN 'West' WHEN 'EUROPE' THEN 'North' WHEN 'ASIA' THEN 'East' ELSE r_name END AS zone,
       CASE WHEN r_regionkey < 3 THEN 'r' || r_regionkey END AS code
FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_regionkey <> 4"""

ORACLES["period_bins"] = """
SELECT CASE WHEN year(o_orderdate) BETWEEN 1995 AND 1997 THEN 'Early' WHEN year(o_orderdate) BETWEEN 1999 AND 2001 THEN 'Late' END AS period,
       CAST(CASE WHEN year(o_orderdate) BETWEEN 1995 AND 1997 THEN 1 WHEN year(o_orderdate) BETWEEN 1999 AND 2001 THEN 2 END AS INT) AS period_ord,
       count(*) AS n FROM orders GROUP BY ALL"""

EARLY, LATE = "year(l_shipdate) BETWEEN 1995 AND 1997", "year(l_shipdate) BETWEEN 1998 AND 2001"

ORACLES["pivot_periods"] = f"""
SELECT l_returnflag, l_linestatus, {", ".join(
    rnd(f"avg({c}) FILTER ({cond})", 6, f"{c}_{tag}") for c in MEASURES for tag, cond in (("early", EARLY), ("late", LATE)))}
FROM lineitem GROUP BY l_returnflag, l_linestatus
HAVING count(*) FILTER ({EARLY}) > 0 AND count(*) FILTER ({LATE}) > 0"""

ORACLES["long_to_wide"] = f"""
WITH y AS (SELECT DISTINCT CAST(year(o_orderdate) AS INT) AS year FROM orders),
v AS (SELECT * FROM (VALUES ('urgent', '1-URGENT'), ('high', '2-HIGH'), ('medium', '3-MEDIUM'), ('unspecified', '4-NOT SPECIFIED'), ('low', '5-LOW')) t(variable, priority))
SELECT y.year, v.variable, {rnd("avg(o_totalprice)", 6, "value")}
FROM y CROSS JOIN v LEFT JOIN orders ON year(o_orderdate) = y.year AND o_orderpriority = v.priority
GROUP BY y.year, v.variable"""

ORACLES["array_positions"] = f"""
SELECT CAST(i AS INT) AS i, count(v) AS n, {rnd("avg(CAST(v AS DOUBLE))", 6, "mean")}
FROM (SELECT unnest(range(1, len(embedding) + 1)) AS i, unnest(embedding) AS v FROM embeddings) GROUP BY i"""

ORACLES["stacked_tables"] = f"""
SELECT nation, c_mktsegment, count(*) AS n, {rnd("avg(balance)", 6, "mean_balance")}
FROM (SELECT c_nationkey AS nation, c_acctbal AS balance, c_mktsegment FROM customer
      UNION ALL SELECT s_nationkey, s_acctbal, NULL FROM supplier) GROUP BY nation, c_mktsegment"""

ORACLES["distinct_levels"] = """
SELECT DISTINCT 'status' AS col, o_orderstatus AS level FROM orders
UNION ALL SELECT DISTINCT 'priority', o_orderpriority FROM orders
UNION ALL SELECT DISTINCT 'year', CAST(year(o_orderdate) AS VARCHAR) FROM orders"""

ORACLES["date_span"] = "SELECT strftime(min(l_shipdate), '%Y%m%d') AS first, strftime(max(l_shipdate), '%Y%m%d') AS last FROM lineitem"

ORACLES["parsed_dates"] = f"""
WITH d AS (SELECT CASE WHEN o_orderkey % 4 < 3 THEN CAST(o_orderdate AS DATE) END AS d,
    CASE WHEN o_orderkey % 4 IN (0, 3) THEN trunc(o_totalprice) END AS v, CAST(o_orderkey % 4 AS INT) AS notation FROM orders)
SELECT notation, CAST(year(d) AS INT) AS year, strftime(d, '%m') AS month, count(d) AS dates, count(v) AS numbers, {rnd("avg(v)", 6, "mean")}
FROM d GROUP BY ALL"""

ORACLES["missing_rules"] = """
WITH r AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice END AS v, CAST(o_custkey % 3 AS DOUBLE) AS b FROM orders)
SELECT o_orderkey, CASE WHEN v > 150000 THEN 'high' WHEN v IS NOT NULL THEN 'low' END AS side,
       CASE WHEN v IS NOT NULL THEN greatest(v, 100000.0::DOUBLE) END AS floored,
       round(CASE WHEN b <> 0 THEN (v - b) / b * 100 END, 6) + 0.0 AS pct,
       round_even(v / 1000, 1) AS even,
       round_even(v * power(10.0, 2 - floor(log10(v))), 0) / power(10.0, 2 - floor(log10(v))) AS sig3
FROM r"""

# --- summaries ---------------------------------------------------------------------------------

ORACLES["rowwise_mean"] = f"""
WITH r AS (SELECT *, l_orderkey + l_linenumber AS k FROM lineitem),
g AS (SELECT *, [CASE WHEN k % 3 <> 0 THEN l_quantity END, CASE WHEN k % 5 <> 0 THEN l_discount END,
                 CASE WHEN k % 2 <> 0 THEN l_tax END] AS vals FROM r)
SELECT l_orderkey, l_linenumber, l_partkey, {rnd("list_avg(vals)", 6, "row_mean")} FROM g"""

ORACLES["multi_summary"] = f"""
SELECT l_returnflag, {", ".join([rnd(f"avg({c})", 6, f"{c}_mean") for c in MEASURES] + [rnd(f"stddev_samp({c})", 6, f"{c}_sd") for c in MEASURES])},
       {rnd("avg(l_quantity)", 6, "mix_mean")}, {rnd("min(l_discount)", 6, "mix_min")}, {rnd("max(l_extendedprice)", 6, "mix_max")}
FROM lineitem GROUP BY l_returnflag"""

ORACLES["annual_copy_summary"] = f"""
WITH r AS (SELECT o_orderpriority, {season("o_orderdate")} AS season, {season_year("o_orderdate")} AS season_year,
           o_orderkey % 3 AS stat, o_totalprice AS v FROM orders),
u AS (SELECT * FROM r UNION ALL SELECT o_orderpriority, 'annual', season_year, stat, v FROM r)
SELECT o_orderpriority, season, season_year, {rnd("avg(v) FILTER (stat = 0)", 6, "mean_value")},
       {rnd("min(v) FILTER (stat = 1)", 6, "min_value")}, {rnd("max(v) FILTER (stat = 2)", 6, "max_value")}
FROM u GROUP BY o_orderpriority, season, season_year"""


def quartiles(keys: str, value: str, source: str, reach: float) -> str:
    return f"""SELECT *, q1 - {reach} * (q3 - q1) AS fence_low, q3 + {reach} * (q3 - q1) AS fence_high FROM
  (SELECT {keys}, count(*) AS n, quantile_cont({value}, 0.25) AS q1, quantile_cont({value}, 0.5) AS median,
          quantile_cont({value}, 0.75) AS q3 FROM {source} GROUP BY {keys})"""


ORACLES["five_number"] = f"""
WITH o AS (SELECT o_orderpriority, CAST(year(o_orderdate) AS INT) AS year, o_totalprice AS v FROM orders),
q AS ({quartiles("o_orderpriority, year", "v", "o", 0.75)})
SELECT o_orderpriority, year, CAST(any_value(n) AS BIGINT) AS n, {", ".join(rnd(f"any_value({c})", 6, c) for c in ("q1", "median", "q3", "fence_low", "fence_high"))},
       {rnd("min(v) FILTER (v BETWEEN fence_low AND fence_high)", 6, "whisker_low")},
       {rnd("max(v) FILTER (v BETWEEN fence_low AND fence_high)", 6, "whisker_high")},
       count(*) FILTER (v < fence_low OR v > fence_high) AS outliers
FROM o JOIN q USING (o_orderpriority, year) GROUP BY o_orderpriority, year"""

ORACLES["box_outliers"] = f"""
WITH q AS ({quartiles("o_orderpriority", "o_totalprice", "orders", 0.45)})
SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders JOIN q USING (o_orderpriority)
WHERE o_totalprice < fence_low OR o_totalprice > fence_high"""

_Q = ", ".join(rnd(f"quantile_cont(l_extendedprice, {p})", 6, n) for n, p in (("p05", 0.05), ("p50", 0.5), ("p975", 0.975)))
ORACLES["exact_quantiles"] = f"""
SELECT 'all' AS l_returnflag, count(*) AS n, {_Q} FROM lineitem
UNION ALL BY NAME SELECT l_returnflag, count(*) AS n, {_Q} FROM lineitem GROUP BY l_returnflag"""

ORACLES["threshold_band"] = f"""
WITH b AS (SELECT l_returnflag, l_linestatus, avg(l_extendedprice) AS mean, stddev_samp(l_extendedprice) AS sd
           FROM lineitem GROUP BY l_returnflag, l_linestatus),
t AS (SELECT *, greatest(0.0::DOUBLE, mean - 2 * sd) AS thresh_low, mean + 2 * sd AS thresh_high FROM b)
SELECT l_returnflag, l_linestatus, {", ".join(rnd(f"any_value({c})", 6, c) for c in ("mean", "sd", "thresh_low", "thresh_high"))},
       count(*) FILTER (l_extendedprice < thresh_low OR l_extendedprice > thresh_high) AS outside
FROM lineitem JOIN t USING (l_returnflag, l_linestatus) GROUP BY l_returnflag, l_linestatus"""

# --- joins -------------------------------------------------------------------------------------

ORACLES["daily_rollup_join"] = f"""
WITH d AS (SELECT CAST(ts AS DATE) AS date, avg(value) AS v FROM events GROUP BY 1),
days AS (SELECT date FROM d WHERE day(date) % 2 = 0 UNION ALL SELECT CAST(date + 40 AS DATE) FROM d WHERE day(date) % 2 = 0)
SELECT strftime(days.date, '%Y-%m-%d') AS date, {rnd("v", 6, "station_temp")}, {rnd("v", 6, "mean_150")}
FROM days LEFT JOIN d ON days.date = d.date"""

ORACLES["suffixed_join"] = f"""
WITH x AS (SELECT o_orderpriority, avg(o_totalprice) AS m, count(*) AS n FROM orders WHERE year(o_orderdate) < 1998 GROUP BY 1),
y AS (SELECT o_orderpriority, avg(o_totalprice) AS m, count(*) AS n FROM orders WHERE year(o_orderdate) >= 1998 AND o_orderpriority <> '2-HIGH' GROUP BY 1)
SELECT o_orderpriority, {rnd("x.m", 6, "mean_x")}, x.n AS n_x, {rnd("y.m", 6, "mean_y")}, y.n AS n_y FROM x LEFT JOIN y USING (o_orderpriority)"""

ORACLES["history_join"] = f"""
SELECT o_orderpriority, {rnd("h", 6, "history")}, {rnd("c", 6, "current")}, {rnd("(c - h) / h * 100", 6, "percent_diff")}
FROM (SELECT o_orderpriority, avg(o_totalprice) FILTER (year(o_orderdate) <> 2000) AS h,
             avg(o_totalprice) FILTER (year(o_orderdate) = 2000 AND o_orderpriority <> '5-LOW') AS c
      FROM orders GROUP BY o_orderpriority)"""

# --- ranks and scaling -------------------------------------------------------------------------

ORACLES["avg_rank"] = """
WITH s AS (SELECT c_custkey, c_mktsegment, CAST(floor(c_acctbal / 100) AS BIGINT) AS step FROM customer)
SELECT *, rank() OVER (PARTITION BY c_mktsegment ORDER BY step) + (count(*) OVER (PARTITION BY c_mktsegment, step) - 1) / 2.0::DOUBLE AS rank_up,
       rank() OVER (PARTITION BY c_mktsegment ORDER BY step DESC) + (count(*) OVER (PARTITION BY c_mktsegment, step) - 1) / 2.0::DOUBLE AS rank_down
FROM s"""

ORACLES["ranked_years"] = f"""
WITH y AS (SELECT CAST(year(l_shipdate) AS INT) AS year, avg((l_discount + l_tax) / 2) AS m FROM lineitem GROUP BY 1)
SELECT year, {rnd("m", 6, "mean")}, {rnd("(m - avg(m) OVER ()) / avg(m) OVER ()", 6, "prop")},
       rank() OVER (ORDER BY m DESC) + (count(*) OVER (PARTITION BY m) - 1) / 2.0::DOUBLE AS rank FROM y"""

_P = "(SELECT p_partkey, p_brand, CASE WHEN h % 13 <> 0 THEN sqrt(h) / 45 END AS p FROM (SELECT *, (p_partkey * 7919 + p_size * 104729) % 2000 AS h FROM part))"
ORACLES["fdr_adjust"] = f"""
SELECT p_partkey, p_brand, {rnd("p", 8)}, {rnd("p_all", 8)}, {rnd("p_family", 8)}
FROM {fdr(fdr(_P, "p", "p_all"), "p", "p_family", "p_brand")}"""

NATION_FEATURES = """(SELECT c_nationkey, c_mktsegment, avg(c_acctbal) AS bal0, CAST(count(*) AS DOUBLE) AS size0,
  max(c_acctbal) - min(c_acctbal) AS spread0 FROM customer GROUP BY c_nationkey, c_mktsegment)"""
SCALED = f"""(SELECT c_nationkey, c_mktsegment, {", ".join(
    f"({c}0 - avg({c}0) OVER ()) / stddev_samp({c}0) OVER () AS {c}" for c in ("bal", "size", "spread"))} FROM {NATION_FEATURES})"""

ORACLES["zscore_columns"] = f"""
SELECT c_nationkey, c_mktsegment, {rnd("bal", 6)}, {rnd("size", 6)}, {rnd("spread", 6)} FROM {SCALED}"""

ORACLES["drop_partial_years"] = f"""
WITH m AS (SELECT o_orderpriority, {season("o_orderdate")} AS season, {season_year("o_orderdate")} AS season_year,
           avg(o_totalprice) AS v FROM orders GROUP BY ALL),
w AS (SELECT *, min(season_year) OVER (PARTITION BY o_orderpriority, season) AS lo,
      max(season_year) OVER (PARTITION BY o_orderpriority, season) AS hi, min(season_year) OVER () AS lo_all FROM m)
SELECT 'inner' AS kind, o_orderpriority, season, season_year, {rnd("v", 6, "value")} FROM w WHERE season_year > lo AND season_year < hi
UNION ALL SELECT 'rest', o_orderpriority, season, season_year, {rnd("v", 6, "value")} FROM w WHERE season_year > lo_all"""

ORACLES["rescale_popup"] = f"""
SELECT s_suppkey, {rnd("4 + (abs(s_acctbal) - min(abs(s_acctbal)) OVER ()) / (max(abs(s_acctbal)) OVER () - min(abs(s_acctbal)) OVER ()) * 6", 6, "radius")},
  '<b>Site:</b> ' || s_name || '<br><b>Metric:</b> HTC<br><b>Slope:</b> ' || CAST(round_even(s_acctbal / 7 + 0.01, 3) AS VARCHAR)
  || '<br><b>p:</b> ' || CAST(round_even(p * power(10.0, 2 - floor(log10(p))), 0) / power(10.0, 2 - floor(log10(p))) AS VARCHAR) AS popup
FROM (SELECT *, (s_suppkey % 97 + 1) / 101.0::DOUBLE AS p FROM supplier)"""

# --- trends ------------------------------------------------------------------------------------

FIT = ["slope", "se", "p_value", "ci_lower", "ci_upper", "p_adj"]

_MEANS = f"""(SELECT l_returnflag, {season("l_shipdate")} AS season, {season_year("l_shipdate")} AS season_year,
  avg(l_extendedprice) AS value FROM lineitem GROUP BY ALL)"""
_INNER = f"""(SELECT * FROM (SELECT *, min(season_year) OVER (PARTITION BY l_returnflag, season) AS lo,
  max(season_year) OVER (PARTITION BY l_returnflag, season) AS hi FROM {_MEANS} m1_) m2_ WHERE season_year > lo AND season_year < hi)"""
ORACLES["seasonal_trend"] = f"""
SELECT l_returnflag, season, n, {", ".join(rnd(c, 5) for c in FIT)}, sig_ci, sig_fdr
FROM {fdr_flag(interval(fits(f"{_INNER} m3_", "l_returnflag, season", "season_year", "value")))}"""

_YEARLY = f"""(SELECT variable, year, value FROM
  (UNPIVOT (SELECT year(l_shipdate) AS year, {", ".join(f"avg({c}) AS {c}" for c in MEASURES)} FROM lineitem GROUP BY 1)
   ON {", ".join(MEASURES)} INTO NAME variable VALUE value)
  WHERE year > (SELECT year(min(l_shipdate)) FROM lineitem) AND year < (SELECT year(max(l_shipdate)) FROM lineitem))"""
ORACLES["annual_trend_long"] = f"""
SELECT variable, n, {", ".join(rnd(c, 6) for c in FIT)}, sig_ci, sig_fdr
FROM {fdr_flag(interval(fits(f"{_YEARLY} y_", "variable", "year", "value")))}"""

_SERIES = """SELECT 'abc_temp_150_avg' AS variable, o_orderdate, o_totalprice AS v FROM orders
  UNION ALL SELECT 'abc_temp_2p5_avg', o_orderdate, o_totalprice * (o_orderkey % 3) FROM orders
  UNION ALL SELECT 'xyz_temp_80_max', o_orderdate, sqrt(o_totalprice) FROM orders"""
_A = f"""(SELECT variable, year(o_orderdate) AS x, avg(v) AS value FROM ({_SERIES}) WHERE year(o_orderdate) > (SELECT year(min(o_orderdate)) FROM orders) GROUP BY ALL)"""
_S = f"""(SELECT variable, {season("o_orderdate")} AS season, {season_year("o_orderdate")} AS x, avg(v) AS value FROM ({_SERIES}) GROUP BY ALL)"""
_TREND = ", ".join(rnd(c, 5) for c in ("slope", "se", "p_value", "p_adj"))
_DECODED = """variable, CASE substr(variable, 1, 3) WHEN 'abc' THEN 'Alpha' ELSE substr(variable, 1, 3) END AS site,
  CASE WHEN variable LIKE '%_150_%' THEN 150.0::DOUBLE WHEN variable LIKE '%2p5%' THEN -2.5::DOUBLE ELSE -80.0::DOUBLE END AS depth"""
ORACLES["combined_trends"] = f"""
SELECT {_DECODED}, 'Annual' AS period, CAST(1 AS INT) AS period_ord, n, {_TREND}, sig_fdr AS significant
FROM {fdr_flag(interval(fits(f"{_A} a_", "variable", "x", "value")))} WHERE variable LIKE '%avg'
UNION ALL
SELECT {_DECODED}, CASE season WHEN 'cool' THEN 'Oct-May' ELSE 'Jun-Sep' END, CAST(CASE season WHEN 'cool' THEN 2 ELSE 3 END AS INT),
  n, {_TREND}, sig_ci FROM {fdr_flag(interval(fits(f"{_S} s_", "variable, season", "x", "value")))} WHERE variable LIKE '%avg'"""

_SL = """(SELECT l_returnflag, CAST(year(l_shipdate) AS INT) AS year, CAST(l_suppkey % 2 AS INT) AS odd,
  l_extendedprice + (l_suppkey % 2) * (year(l_shipdate) - 1990) * 900 AS v FROM lineitem)"""
ORACLES["significant_lines"] = f"""
WITH f AS (SELECT * FROM {fits(f"{_SL} l_", "l_returnflag, odd", "year", "v")} WHERE p_value < 0.05)
SELECT DISTINCT l_returnflag, odd, r.year, {rnd("slope", 4)}, {rnd("intercept", 4)}, {rnd("intercept + slope * r.year", 4, "mean_pred")}
FROM {_SL} r JOIN f USING (l_returnflag, odd)"""

_YR = "(SELECT l_returnflag, CAST(year(l_shipdate) AS INT) AS year, avg(l_extendedprice) AS value FROM lineitem GROUP BY ALL)"
ORACLES["residual_table"] = f"""
WITH f AS (SELECT * FROM {fits(f"{_YR} y_", "l_returnflag", "year", "value")} WHERE p_value < 0.9),
r AS (SELECT l_returnflag, year, value, intercept + slope * year AS fitted, value - (intercept + slope * year) AS resid,
      1.0 / n + power(year - x_mean, 2) / sxx AS hat, sigma, rss, df FROM {_YR} y2_ JOIN f USING (l_returnflag)),
s AS (SELECT *, resid / (sigma * sqrt(1 - hat)) AS std_resid FROM r)
SELECT l_returnflag, year, {", ".join(rnd(c, 5) for c in ("value", "fitted", "resid", "hat", "std_resid"))},
  {rnd("sqrt(greatest(0.0::DOUBLE, (rss - resid * resid / (1 - hat)) / (df - 1)))", 5, "sigma_without")},
  {rnd("std_resid * std_resid / 2 * hat / (1 - hat)", 5, "cooksd")} FROM s"""

_TERMS_OF = f"(SELECT * EXCLUDE (p_value), p_value AS p1, sigma * sqrt(1.0 / n + x_mean * x_mean / sxx) AS se0 FROM {fits(f'{_YR} y_', 'l_returnflag', 'year', 'value')})"
_WITH_P0 = with_t_p(f"(SELECT *, intercept / se0 AS t0 FROM {_TERMS_OF} e_) e2_", "t0", "df", "p0")
ORACLES["trend_terms"] = f"""
WITH f AS (SELECT * FROM {_WITH_P0})
SELECT l_returnflag, '(intercept)' AS term, {rnd("intercept", 5, "estimate")}, {rnd("se0", 5, "std_error")}, {rnd("t0", 5, "statistic")}, {rnd("p0", 5, "p_value")} FROM f
UNION ALL SELECT l_returnflag, 'year', {rnd("slope", 5)}, {rnd("se", 5)}, {rnd("t", 5)}, {rnd("p1", 5)} FROM f"""

_SITE = """(SELECT n_name AS site, n_nationkey + 50.5::DOUBLE AS lat, n_nationkey * -1.25::DOUBLE AS lon, year(o_orderdate) AS year, m AS metric,
   CASE m WHEN 'swe' THEN o_totalprice ELSE c_acctbal END AS value
 FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
 CROSS JOIN (VALUES ('swe'), ('htc')) t(m) WHERE n_nationkey % 3 <> 0)"""
ORACLES["site_trends"] = f"""
SELECT site, {rnd("lat", 4)}, {rnd("lon", 4)}, metric, n, {rnd("slope", 4)}, {rnd("se", 4)}, {rnd("p_value", 4)},
  CASE WHEN p_value < 0.05 THEN 'Yes' WHEN p_value IS NOT NULL THEN 'No' END AS sig,
  {rnd("4 + (abs(slope) - min(abs(slope)) OVER ()) / (max(abs(slope)) OVER () - min(abs(slope)) OVER ()) * 6", 4, "radius")}
FROM {fits(f"{_SITE} s_", "site, lat, lon, metric", "year", "value")} WHERE n > 0"""

# --- one sample against another ----------------------------------------------------------------

ORACLES["anomaly_baseline"] = f"""
WITH r AS (SELECT year(l_shipdate) AS year, CASE WHEN (l_orderkey + l_linenumber) % 7 <> 0 THEN l_discount END AS a,
           CASE WHEN (l_orderkey + l_linenumber) % 3 <> 0 THEN l_tax END AS b FROM lineitem),
y AS (SELECT CAST(year AS INT) AS year, (coalesce(sum(a), 0) + coalesce(sum(b), 0)) / (count(a) + count(b)) AS m FROM r GROUP BY year),
base AS (SELECT avg(m) AS b FROM y WHERE year BETWEEN 1996 AND 2000)
SELECT year, {rnd("m", 8, "mean")}, {rnd("b", 8, "baseline")}, {rnd("m - b", 8, "diff")} FROM y CROSS JOIN base"""


def sample_sums(keys: str, value: str, current: str, source: str) -> str:
    return f"""(SELECT {keys}, {", ".join(
        f"CAST(count({value}) FILTER ({c}) AS BIGINT) AS n_{s}, avg({value}) FILTER ({c}) AS mean_{s}, var_samp({value}) FILTER ({c}) AS var_{s}"
        for s, c in (("c", f"NOT ({current})"), ("t", current)))} FROM {source} GROUP BY {keys})"""


def mean_tests(source: str) -> str:
    pooled = """((CASE WHEN n_c > 1 THEN var_c * (n_c - 1) WHEN n_c = 1 THEN 0.0 END
      + CASE WHEN n_t > 1 THEN var_t * (n_t - 1) WHEN n_t = 1 THEN 0.0 END) / nullif(n_c + n_t - 2, 0))"""
    stats = f"""(SELECT *, nullif(var_c, 0) / nullif(var_t, 0) AS f,
      CASE WHEN a2_ + b2_ > 0 THEN (mean_c - mean_t) / sqrt(a2_ + b2_) END AS t_welch,
      CASE WHEN a2_ + b2_ > 0 THEN power(a2_ + b2_, 2) / (a2_ * a2_ / nullif(n_c - 1, 0) + b2_ * b2_ / nullif(n_t - 1, 0)) END AS df_welch,
      (mean_c - mean_t) / nullif(sqrt({pooled} * (1.0 / nullif(n_c, 0) + 1.0 / nullif(n_t, 0))), 0) AS t_pooled,
      CASE WHEN n_c > 0 AND n_t > 0 AND n_c + n_t > 2 THEN CAST(n_c + n_t - 2 AS DOUBLE) END AS df_pooled
      FROM (SELECT *, var_c / nullif(n_c, 0) AS a2_, var_t / nullif(n_t, 0) AS b2_ FROM {source} w1_) w2_)"""
    with_f = with_f_p(f"{stats} w3_", "f", "(n_c - 1)", "(n_t - 1)", "p_f")
    with_w = with_t_p(f"{with_f} w4_", "t_welch", "df_welch", "p_welch")
    return with_t_p(f"{with_w} w5_", "t_pooled", "df_pooled", "p_pooled")


_CUR = "year(o_orderdate) = 2000"
ORACLES["year_vs_history_tests"] = f"""
WITH s AS (SELECT *, coalesce(p_f < 0.05, FALSE) AS welch FROM {mean_tests(sample_sums("o_orderpriority", "o_totalprice", _CUR, "orders"))})
SELECT o_orderpriority, {rnd("mean_c", 6, "history")}, {rnd("mean_t", 6, "current")}, {rnd("(mean_t - mean_c) / mean_c * 100", 6, "percent_diff")},
  n_c, n_t, {rnd("f")}, {rnd("p_f")}, CASE WHEN welch THEN 'welch' ELSE 'pooled' END AS method,
  {rnd("CASE WHEN welch THEN t_welch ELSE t_pooled END", 6, "t")}, {rnd("CASE WHEN welch THEN df_welch ELSE df_pooled END", 6, "df")},
  {rnd("CASE WHEN welch THEN p_welch ELSE p_pooled END", 6, "p")} FROM s"""

ORACLES["both_mean_tests"] = f"""
SELECT p_brand, n_c, n_t, {", ".join(rnd(c) for c in ("mean_c", "var_c", "mean_t", "var_t", "f", "p_f", "t_welch", "df_welch",
  "t_pooled", "df_pooled", "p_welch", "p_pooled"))}
FROM {mean_tests(sample_sums("p_brand", "p_retailprice", "p_size > 25", "part"))}"""

# --- resampling --------------------------------------------------------------------------------


# Shares of a Poisson(1) count of at most 0, 1, 2, …, in units of 2^-16.
POISSON = [24109, 48219, 60273, 64292, 65296, 65497, 65531, 65535]
# The same in units of 2^-32, for draws of 32 bits.
POISSON_FINE = [1580030169, 3160060337, 3950075422, 4213413783, 4279248374, 4292415292, 4294609778, 4294923276, 4294962463, 4294966817, 4294967253, 4294967292]
MASK = "4294967295"


def mixed(x: str) -> str:
    """A 32-bit number in which every bit depends on all of ``x``."""
    return mixing_end(mixing_start(x))


def mixing_start(x: str) -> str:
    return f"(((xor({x}, {x} >> 16)) * 2146121005) & {MASK})"


def mixing_end(x: str) -> str:
    last = f"((xor({x}, {x} >> 15) * 1540483477) & {MASK})"
    return f"xor({last}, {last} >> 16)"


def seed(text: str, part: int = 0) -> str:
    return f"CAST('0x' || substr(md5({text}), {8 * part + 1}, 8) AS BIGINT)"


def poisson(draw: str, limits: list[int] = POISSON) -> str:
    whens = " ".join(f"WHEN {draw} < {cut} THEN {k}.0::DOUBLE" for k, cut in enumerate(limits))
    return f"CASE {whens} ELSE {len(limits)}.0::DOUBLE END"


def replicates(source: str, keys: str, metrics: list[str], late: str, row_key: str, count: int, fine: bool = False) -> str:
    """Subquery ``keys, metric, rep, diff`` of bootstrap differences: counter j of a row gives the draws of replicates 2 j and 2 j + 1; ``fine``: of replicate j, with all its 32 bits."""
    x0 = f"((s1 + j * 2654435769) & {MASK})"
    x2 = f"((xor(x1, x1 >> 15) + s2) & {MASK})"
    lanes = " UNION ALL ".join(f"SELECT *, j * 2 + {i} AS rep, {poisson(f'((x >> {16 * i}) & 65535)')} AS w FROM x_" for i in (0, 1))
    if fine:
        lanes = f"SELECT *, j AS rep, {poisson('x', POISSON_FINE)} AS w FROM x_"
    sums = ", ".join(f"sum(w * {m}) / nullif(sum(w) FILTER ({m} IS NOT NULL), 0) AS {m}" for m in metrics)
    per = " UNION ALL ".join(f"SELECT {keys}, '{m}' AS metric, rep, max({m}) FILTER (late_) - max({m}) FILTER (NOT late_) AS diff FROM s_ GROUP BY {keys}, rep" for m in metrics)
    return f"""(WITH r_ AS MATERIALIZED (SELECT {keys}, {", ".join(metrics)}, {late} AS late_, {seed(f"CAST({row_key} AS VARCHAR)")} AS s1, {seed(f"CAST({row_key} AS VARCHAR)", 1)} AS s2 FROM {source}),
      a_ AS (SELECT *, {mixing_start(x0)} AS x1 FROM r_ CROSS JOIN range(0, {count if fine else -(-count // 2)}) g_(j)),
      b_ AS (SELECT * EXCLUDE (x1), {x2} AS y FROM a_),
      c_ AS (SELECT * EXCLUDE (y), ((y * 1540483477) & {MASK}) AS z FROM b_),
      x_ AS (SELECT * EXCLUDE (z, s1, s2), xor(z, z >> 16) AS x FROM c_),
      s_ AS (SELECT {keys}, rep, late_, {sums} FROM ({lanes}) GROUP BY {keys}, rep, late_)
      {per})"""


def bootstrap(reps: str, keys: str) -> str:
    return f"""(SELECT *, lower > 0 OR upper < 0 AS significant, CASE WHEN lower > 0 OR upper < 0 THEN 'solid'
        WHEN lower IS NOT NULL THEN 'dashed' END AS linetype
      FROM (SELECT {keys}, metric, quantile_cont(diff, 0.025) AS lower, quantile_cont(diff, 0.975) AS upper FROM {reps} GROUP BY {keys}, metric))"""


_REP = replicates("orders", "o_orderpriority", ["o_totalprice"], "year(o_orderdate) >= 1998", "o_orderkey", 1000)
ORACLES["bootstrap_ci"] = f"""
SELECT o_orderpriority, metric, {rnd("lower", 3)}, {rnd("upper", 3)}, significant, linetype FROM {bootstrap(_REP, "o_orderpriority")}"""

_SURVEY = """(SELECT l_returnflag AS ecosystem, year(l_shipdate) >= 1998 AS is_late,
  l_orderkey || '-' || l_partkey || '-' || l_suppkey || '-' || l_linenumber AS id, l_extendedprice AS swe, l_quantity AS htc FROM lineitem)"""
_REP = replicates(_SURVEY, "ecosystem", ["swe", "htc"], "is_late", "id", 1000, fine=True)
ORACLES["period_change"] = f"""
WITH b AS (SELECT * FROM {bootstrap(_REP, "ecosystem")})
SELECT ecosystem, {", ".join(rnd(f"any_value({m}_{t})", 3, f"{m}_{t}") for m in ("swe", "htc") for t in ("early", "late"))},
  {", ".join(f"{rnd(f'''max({c}) FILTER (metric = '{m}')''', 3, f'{m}_{c}')}" for m in ("swe", "htc") for c in ("lower", "upper"))},
  {", ".join(f"max(linetype) FILTER (metric = '{m}') AS {m}_linetype" for m in ("swe", "htc"))}
FROM b JOIN (SELECT ecosystem, {", ".join(f"avg({m}) FILTER ({n} is_late) AS {m}_{t}" for m in ("swe", "htc") for t, n in (("early", "NOT"), ("late", "")))}
  FROM {_SURVEY} GROUP BY ecosystem) USING (ecosystem) GROUP BY ecosystem"""

VEC = ("bal", "orders", "price")
_NORMED = ", ".join(f"({c} - avg({c}) OVER ()) / stddev_samp({c}) OVER () AS {c}" for c in VEC)
CUSTOMERS = f"""(SELECT c_custkey AS id, c_mktsegment, n_regionkey, {_NORMED}
  FROM (SELECT c_custkey, c_mktsegment, n_regionkey, c_acctbal AS bal, CAST(count(o_orderkey) AS DOUBLE) AS orders, coalesce(avg(o_totalprice), 0) AS price
    FROM customer JOIN nation ON n_nationkey = c_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL))"""
_SQUARE = " + ".join(f"{c} * {c}" for c in VEC)


def bijection(source: str, rounds: int = 6) -> str:
    """``y`` of ``source`` (``y, a, b, k0 …``) sent through the keyed rounds once, as a pair of digits of which one in turn gets a mix of the other."""
    out = f"(SELECT *, y // b AS l, y % b AS r FROM {source})"
    for t in range(rounds):
        one, other, size = ("l", "r", "a") if t % 2 == 0 else ("r", "l", "b")
        out = f"(SELECT * REPLACE (({one} + {mixing_end('m')}) % {size} AS {one}) FROM (SELECT *, {mixing_start(f'(({other} + k{t}) & {MASK})')} AS m FROM {out}))".replace("SELECT * REPLACE", "SELECT * EXCLUDE (m) REPLACE")
    return f"(SELECT * EXCLUDE (l, r) REPLACE (l * b + r AS y) FROM {out})"


def permuted(source: str, factors: list[str], count: int, walks: int = 6) -> str:
    """CTEs up to ``perms``: permutation 0 as observed; in the others row number i gets the factors of the cell that its image falls into, if factor rows are sorted.

    The pairs of digits are a few more than the rows; a number that comes out too large goes through again, ``walks`` times at most, far more than ever happens.
    """
    f, v = ", ".join(factors), ", ".join(VEC)
    keys = ", ".join(f"""{seed(f"perm || '|{t}'")} AS k{t}""" for t in range(6))
    chain = "".join(f""",
    w{i} AS (SELECT * FROM w{i - 1} WHERE y < n UNION ALL SELECT * FROM {bijection(f"(SELECT * FROM w{i - 1} WHERE y >= n)")})""" for i in range(1, walks + 1))
    return f"""base AS MATERIALIZED (SELECT id, row_number() OVER (ORDER BY id) - 1 AS i, {f}, {", ".join(f"{c} - avg({c}) OVER () AS {c}" for c in VEC)} FROM {source}),
    cells AS MATERIALIZED (SELECT *, CAST(sum(m) OVER (ORDER BY {f}) - m AS BIGINT) AS low FROM (SELECT {f}, count(*) AS m FROM base GROUP BY {f})),
    pairs AS (SELECT n, a, CAST(ceil(n / a) AS BIGINT) AS b FROM (SELECT count(*) AS n, CAST(ceil(sqrt(count(*))) AS BIGINT) AS a FROM base)),
    keyed AS MATERIALIZED (SELECT perm, {keys} FROM range(1, {count + 1}) g(perm)),
    w0 AS (SELECT * FROM {bijection("(SELECT i, i AS y, n, a, b, perm, k0, k1, k2, k3, k4, k5 FROM base CROSS JOIN pairs CROSS JOIN keyed)")}){chain},
    perms AS (SELECT 0 AS perm, {f}, {v} FROM base
      UNION ALL SELECT perm, {", ".join(f"c.{x}" for x in factors)}, {v} FROM (SELECT perm, y, {v} FROM w{walks} JOIN base USING (i)) d ASOF JOIN cells c ON d.y >= c.low)"""


def group_ss(name: str, factors: str) -> str:
    sums = ", ".join(f"sum({c}) AS {c}" for c in VEC)
    return f"""{name} AS (SELECT perm, sum(({_SQUARE}) / n) AS ss, count(*) AS cells
      FROM (SELECT perm, {factors}, count(*) AS n, {sums} FROM perms GROUP BY perm, {factors}) GROUP BY perm)"""


ORACLES["permanova"] = f"""
WITH {permuted(CUSTOMERS, ["c_mktsegment"], 999)}, {group_ss("g", "c_mktsegment")},
tot AS (SELECT sum({_SQUARE}) AS sst, count(*) AS n FROM base),
f AS (SELECT perm, ss, sst, cells - 1 AS df, n - cells AS dfr, n, (ss / (cells - 1)) / ((sst - ss) / (n - cells)) AS f FROM g CROSS JOIN tot),
o AS (SELECT * FROM f WHERE perm = 0),
p AS (SELECT (sum(CASE WHEN f.f >= o.f - 1.5e-8 THEN 1 ELSE 0 END) + 1) / (count(*) + 1) AS p FROM f CROSS JOIN o WHERE f.perm > 0)
SELECT 'c_mktsegment' AS term, CAST(df AS INT) AS df, {rnd("ss", 6)}, {rnd("ss / sst", 6, "r2")}, {rnd("f", 6)}, {rnd("p", 6)} FROM o CROSS JOIN p
UNION ALL SELECT 'residual', CAST(dfr AS INT), {rnd("sst - ss", 6, "ss")}, {rnd("(sst - ss) / sst", 6, "r2")}, NULL, NULL FROM o
UNION ALL SELECT 'total', CAST(n - 1 AS INT), {rnd("sst", 6, "ss")}, 1.0, NULL, NULL FROM o"""


def eliminated(levels: int) -> str:
    """``perm, ss``: what ``levels`` equations (matrix ``g``, right sides ``rhs`` per permutation) explain, one unknown eliminated after another."""
    g = ", ".join(f"sum(v) FILTER (b = {i} AND c = {j}) AS g{i}_{j}" for i in range(levels) for j in range(levels))
    r = ", ".join(f"sum({c}) FILTER (b = {i}) AS {c}{i}" for i in range(levels) for c in VEC)
    out = f"(SELECT *, 0.0::DOUBLE AS ss FROM (SELECT {g} FROM g) CROSS JOIN (SELECT perm, {r} FROM rhs GROUP BY perm))"
    for k in range(levels):
        rest = range(k + 1, levels)
        new = [f"ss + ({' + '.join(f'{c}{k} * {c}{k}' for c in VEC)}) / g{k}_{k} AS ss"]
        new += [f"{c}{i} - g{i}_{k} / g{k}_{k} * {c}{k} AS {c}{i}" for i in rest for c in VEC]
        new += [f"g{i}_{j} - g{i}_{k} * g{k}_{j} / g{k}_{k} AS g{i}_{j}" for i in rest for j in rest]
        out = f"(SELECT perm, {', '.join(new)} FROM {out})"
    return out


# The second factor is eliminated down to one level less than it has, since the rows of its matrix add up to zero.
_TERMS = ("c_mktsegment", "n_regionkey", "c_mktsegment:n_regionkey")
ORACLES["permanova_two"] = f"""
WITH {permuted(CUSTOMERS, ["c_mktsegment", "n_regionkey"], 999)}, {group_ss("ga", "c_mktsegment")}, {group_ss("gc", "c_mktsegment, n_regionkey")},
tot AS (SELECT sum({_SQUARE}) AS sst, count(*) AS n FROM base),
level AS (SELECT n_regionkey, row_number() OVER (ORDER BY n_regionkey) - 1 AS b FROM (SELECT DISTINCT n_regionkey FROM cells)),
sized AS (SELECT c_mktsegment, n_regionkey, b, m, sum(m) OVER (PARTITION BY c_mktsegment) AS ma, sum(m) OVER (PARTITION BY n_regionkey) AS mb FROM cells JOIN level USING (n_regionkey)),
g AS (SELECT x.b, y.b AS c, -sum(x.m * y.m / x.ma) AS v FROM sized x JOIN sized y USING (c_mktsegment) GROUP BY ALL UNION ALL SELECT DISTINCT b, b, CAST(mb AS DOUBLE) FROM sized),
summed AS (SELECT perm, c_mktsegment, n_regionkey, {", ".join(f"sum({c}) AS {c}" for c in VEC)} FROM perms GROUP BY ALL),
of_a AS (SELECT perm, c_mktsegment, {", ".join(f"sum({c}) AS {c}" for c in VEC)} FROM summed GROUP BY ALL),
rhs AS (
  SELECT s.perm, z.b, {", ".join(f"sum(s.{c} - z.m / z.ma * a.{c}) AS {c}" for c in VEC)}
  FROM summed s JOIN sized z USING (c_mktsegment, n_regionkey) JOIN of_a a ON a.perm = s.perm AND a.c_mktsegment = s.c_mktsegment GROUP BY ALL),
gb AS (SELECT perm, ss FROM {eliminated(4)}),
nb AS (SELECT count(*) AS levels FROM level),
w AS (SELECT perm, ga.ss AS s1, gb.ss AS s2, gc.ss - ga.ss - gb.ss AS s3, sst - gc.ss AS sr, sst, n,
      ga.cells - 1 AS d1, levels - 1 AS d2, gc.cells - ga.cells - levels + 1 AS d3, n - gc.cells AS dr
      FROM ga JOIN gb USING (perm) JOIN gc USING (perm) CROSS JOIN tot CROSS JOIN nb),
t AS ({" UNION ALL ".join(f"SELECT perm, '{n}' AS term, d{i} AS df, s{i} AS ss, sst, (s{i} / d{i}) / (sr / dr) AS f FROM w" for i, n in enumerate(_TERMS, 1))}
      UNION ALL SELECT perm, 'residual', dr, sr, sst, NULL FROM w UNION ALL SELECT perm, 'total', n - 1, sst, sst, NULL FROM w),
p AS (SELECT t.term, (sum(CASE WHEN t.f >= o.f - 1.5e-8 THEN 1 ELSE 0 END) + 1) / (count(*) + 1) AS p
      FROM t JOIN t o ON o.perm = 0 AND o.term = t.term WHERE t.perm > 0 AND t.f IS NOT NULL GROUP BY t.term)
SELECT t.term, CAST(df AS INT) AS df, {rnd("ss", 6)}, {rnd("ss / sst", 6, "r2")}, {rnd("f", 6)}, {rnd("p", 6)}
FROM t LEFT JOIN p USING (term) WHERE perm = 0"""

# --- densities ---------------------------------------------------------------------------------


def kde(keys: str, value: str, source: str, points: int) -> str:
    """Subquery ``keys, i, x, y``: linear binning on a grid, Gaussian kernel, linear read-off."""
    last = points - 1
    return f"""(WITH st AS (SELECT {keys}, count(*) AS n, min({value}) AS lo, max({value}) AS hi, coalesce(stddev_samp({value}), 0) AS sd,
      (quantile_cont({value}, 0.75) - quantile_cont({value}, 0.25)) / 1.34 AS iqr FROM {source} GROUP BY {keys}),
    bw AS (SELECT {keys}, n, lo, hi, 0.9 * CASE WHEN least(sd, iqr) > 0 THEN least(sd, iqr) WHEN sd > 0 THEN sd WHEN lo <> 0 THEN abs(lo) ELSE 1.0 END
      * power(n, -0.2) AS bw FROM st),
    gr AS (SELECT *, lo - 3 * bw AS x0, (hi - lo + 6 * bw) / {last} AS step, lo - 7 * bw AS g0, (hi - lo + 14 * bw) / {last} AS gstep FROM bw),
    pt AS (SELECT {keys}, ({value} - g0) / gstep AS u FROM {source} JOIN gr USING ({keys})),
    bn AS (SELECT {keys}, ix, sum(w) AS w FROM (SELECT {keys}, floor(u) AS ix, 1 - (u - floor(u)) AS w FROM pt
      UNION ALL SELECT {keys}, floor(u) + 1, u - floor(u) FROM pt) GROUP BY {keys}, ix),
    dn AS (SELECT gr.{keys}, g.g, sum(bn.w * exp(-power((g.g - bn.ix) * gr.gstep / gr.bw, 2) / 2)) / any_value(gr.n * gr.bw * sqrt(2 * pi())) AS d
      FROM gr CROSS JOIN range(0, {points}) g(g) JOIN bn USING ({keys}) GROUP BY gr.{keys}, g.g),
    px AS (SELECT *, (x - g0) / gstep AS pos FROM (SELECT {keys}, i, x0, step, g0, gstep, x0 + step * i AS x FROM gr CROSS JOIN range(0, {points}) r(i))),
    lf AS (SELECT *, least(floor(pos), {last - 1}) AS l FROM px)
    SELECT lf.{keys}, CAST(i AS INT) AS i, x, a.d + (pos - l) * (b.d - a.d) AS y FROM lf
      JOIN dn a ON a.{keys} = lf.{keys} AND a.g = l JOIN dn b ON b.{keys} = lf.{keys} AND b.g = l + 1)"""


ORACLES["kde_grid"] = f"""
SELECT c_mktsegment, i, {rnd("x", 4)}, {rnd("y", 9)} FROM {kde("c_mktsegment", "c_acctbal", "customer", 512)}"""
ORACLES["kde_shifted"] = f"""
SELECT c_nationkey, {rnd("max(y)", 8, "max_density")}
FROM {kde("c_nationkey", "v", "(SELECT c_nationkey, c_acctbal + c_nationkey * 1e7 AS v FROM customer)", 512)} GROUP BY c_nationkey"""
ORACLES["kde_peak"] = f"""
SELECT l_returnflag, {rnd("max(y)", 8, "max_density")} FROM {kde("l_returnflag", "l_quantity", "lineitem", 512)} GROUP BY l_returnflag"""
ORACLES["normal_curve"] = f"""
WITH s AS (SELECT c_mktsegment, avg(c_acctbal) AS m, stddev_samp(c_acctbal) AS sd FROM customer GROUP BY 1),
g AS (SELECT *, m - 4 * sd + i * (8.0 / 199) * sd AS x FROM s CROSS JOIN range(0, 200) r(i))
SELECT c_mktsegment, CAST(i AS INT) AS i, {rnd("x", 4)}, {rnd("exp(-power((x - m) / sd, 2) / 2) / (sd * sqrt(2 * pi()))", 10, "y")} FROM g"""

# --- gaps, outliers, bounds --------------------------------------------------------------------

KEY = "l_orderkey, l_linenumber, l_partkey, l_suppkey"
GAPPY = f"""(SELECT {KEY}, CAST(month(l_shipdate) AS INT) AS month, l_quantity, l_discount,
  CASE WHEN k % 5 <> 0 THEN l_extendedprice END AS price, CASE WHEN k % 3 <> 0 THEN l_tax END AS tax, CASE WHEN k % 11 <> 0 THEN l_quantity END AS qty
  FROM (SELECT *, l_orderkey * 7 + l_linenumber + l_partkey AS k FROM lineitem))"""

ORACLES["monthly_fill_lm"] = f"""
WITH g AS {GAPPY}, f AS (SELECT month, regr_slope(price, l_quantity) AS b1, regr_intercept(price, l_quantity) AS b0 FROM g GROUP BY month)
SELECT {KEY}, {rnd("coalesce(price, b0 + b1 * l_quantity)", 2, "price")} FROM g LEFT JOIN f USING (month)"""

ORACLES["mean_imputed"] = f"""
WITH g AS {GAPPY} SELECT month, {rnd("avg(coalesce(tax, (SELECT avg(tax) FROM g)))", 8, "tax")} FROM g GROUP BY month"""



def determinant(rows: list[list[str]]) -> str:
    if len(rows) == 1:
        return rows[0][0]
    minors = [[r[:k] + r[k + 1 :] for r in rows[1:]] for k in range(len(rows))]
    return "(" + " ".join(f"{'-' if k % 2 else '+'} {rows[0][k]} * {determinant(m)}" for k, m in enumerate(minors)) + ")"


def backward(source: str, key: str, y: str, xs: list[str]) -> str:
    """Subquery ``key, b0, b1, …``: backward selection by AIC from all predictors ``xs``, by Cramer's rule on the complete cases; a dropped predictor has NULL."""
    k = len(xs)
    subsets = [s for size in range(k, -1, -1) for s in combinations(range(k), size)]
    name = lambda s: "".join(str(i + 1) for i in s) or "0"
    c = lambda i, j: f"c{min(i, j) + 1}{max(i, j) + 1}"
    moments = [f"covar_pop({xs[i]}, {xs[j]}) AS {c(i, j)}" for i in range(k) for j in range(i, k)]
    moments += [f"covar_pop({x}, {y}) AS c{i + 1}y" for i, x in enumerate(xs)] + [f"avg({x}) AS m{i + 1}" for i, x in enumerate(xs)]
    complete = " AND ".join(f"{x} IS NOT NULL" for x in [y, *xs])
    gram = f"(SELECT {key}, count(*) AS n, avg({y}) AS my, var_pop({y}) AS cyy, {', '.join(moments)} FROM {source} WHERE {complete} GROUP BY {key})"
    slopes = []
    for s in subsets[:-1]:
        matrix = [[c(i, j) for j in s] for i in s]
        for at, i in enumerate(s):
            swapped = [r[:at] + [f"c{s[row] + 1}y"] + r[at + 1 :] for row, r in enumerate(matrix)]
            slopes.append(f"{determinant(swapped)} / {determinant(matrix)} AS b{name(s)}_{i + 1}")
    left = lambda s: " ".join(f"- b{name(s)}_{i + 1} * c{i + 1}y" for i in s)
    aics = [f"n * ln(cyy {left(s)}) + {2 * (len(s) + 1)} AS a{name(s)}" for s in subsets]

    def chosen(s) -> str:
        """Name of the subset that selection ends at from ``s``; of equal scores the one without the first predictor wins."""
        if not s:
            return f"'{name(s)}'"
        trials = [tuple(i for i in s if i != gone) for gone in s]
        best = f"least({', '.join('a' + name(t) for t in trials)})" if len(trials) > 1 else f"a{name(trials[0])}"
        rest = " ".join(f"WHEN a{name(t)} = {best} THEN {chosen(t)}" for t in trials)
        return f"CASE WHEN {best} >= a{name(s)} THEN '{name(s)}' {rest} END"

    whens = lambda i: " ".join(f"WHEN '{name(s)}' THEN b{name(s)}_{i + 1}" for s in subsets if i in s)
    picked = ", ".join(f"CASE sel {whens(i)} END AS b{i + 1}" for i in range(k))
    b0 = "my " + " ".join(f"- coalesce(b{i + 1} * m{i + 1}, 0)" for i in range(k))
    scored = f"(SELECT *, {', '.join(aics)} FROM (SELECT *, {', '.join(slopes)} FROM {gram}))"
    ended = f"(SELECT *, {picked} FROM (SELECT *, {chosen(tuple(range(k)))} AS sel FROM {scored}))"
    return f"(SELECT {key}, {b0} AS b0, {', '.join(f'b{i + 1}' for i in range(k))} FROM {ended})"


def filled(source: str, fits: str, key: str, y: str, xs: list[str]) -> str:
    """``source`` with the gaps of ``y`` filled from :func:`backward`."""
    total = " ".join(f"+ CASE WHEN b{i + 1} IS NULL THEN 0 ELSE b{i + 1} * {x} END" for i, x in enumerate(xs))
    return f"(SELECT s_.* REPLACE (coalesce({y}, b0 {total}) AS {y}) FROM {source} s_ LEFT JOIN {fits} f_ USING ({key}))"


def two_predictors(source: str, key: str, y: str, x1: str, x2: str) -> str:
    """Subquery per key: slopes, residual sums and AIC of the model with both predictors, with either and with none."""
    gram = f"""(SELECT {key}, count(*) AS n, avg({x1}) AS m1, avg({x2}) AS m2, avg({y}) AS my,
      var_pop({x1}) AS c11, var_pop({x2}) AS c22, covar_pop({x1}, {x2}) AS c12, covar_pop({x1}, {y}) AS c1y, covar_pop({x2}, {y}) AS c2y,
      var_pop({y}) AS cyy FROM {source} WHERE {y} IS NOT NULL AND {x1} IS NOT NULL AND {x2} IS NOT NULL GROUP BY {key})"""
    slopes = f"""(SELECT *, (c1y * c22 - c2y * c12) / (c11 * c22 - c12 * c12) AS b1, (c2y * c11 - c1y * c12) / (c11 * c22 - c12 * c12) AS b2 FROM {gram})"""
    rss = f"""(SELECT *, n * (cyy - b1 * c1y - b2 * c2y) AS r12, n * (cyy - c1y * c1y / c11) AS r1, n * (cyy - c2y * c2y / c22) AS r2, n * cyy AS r0 FROM {slopes})"""
    return f"""(SELECT *, n * ln(r12 / n) + 6 AS a12, n * ln(r1 / n) + 4 AS a1, n * ln(r2 / n) + 4 AS a2, n * ln(r0 / n) + 2 AS a0 FROM {rss})"""


def stepwise(source: str, key: str, y: str, x1: str, x2: str) -> str:
    """Subquery per key: ``n, b0, b1, b2, aic`` after backward selection; a dropped slope is NULL."""
    return f"""(SELECT *, my - coalesce(b1 * m1, 0) - coalesce(b2 * m2, 0) AS b0 FROM
      (SELECT {key}, n, my, m1, m2, CASE keep WHEN 'both' THEN b1 WHEN 'one' THEN c1y / c11 END AS b1,
         CASE keep WHEN 'both' THEN b2 WHEN 'two' THEN c2y / c22 END AS b2,
         CASE keep WHEN 'both' THEN a12 WHEN 'one' THEN a1 WHEN 'two' THEN a2 ELSE a0 END AS aic
       FROM (SELECT *, CASE WHEN a12 <= least(a1, a2) THEN 'both' WHEN a1 <= a2 THEN CASE WHEN a1 <= a0 THEN 'one' ELSE 'none' END
               ELSE CASE WHEN a2 <= a0 THEN 'two' ELSE 'none' END END AS keep FROM {two_predictors(source, key, y, x1, x2)})))"""


_PRICE = two_predictors(GAPPY, "month", "price", "l_quantity", "l_discount")
ORACLES["multiple_regression"] = f"""
SELECT month, n, {rnd("my - b1 * m1 - b2 * m2", 3, "b0")}, {rnd("b1", 3)}, {rnd("b2", 3)}, {rnd("r12 / 1e9", 3, "rss")}, {rnd("a12", 3, "aic")} FROM {_PRICE}"""
ORACLES["stepwise_regression"] = f"""
SELECT month, n, {rnd("b0", 3)}, {rnd("b1", 3)}, {rnd("b2", 3)}, {rnd("aic", 3)} FROM {stepwise(GAPPY, "month", "price", "l_quantity", "l_discount")}"""

ORACLES["cascade_pair"] = f"""
WITH g AS {GAPPY}, f AS (SELECT month, regr_slope(price, l_quantity) AS s, regr_intercept(price, l_quantity) AS i FROM g GROUP BY month),
h AS (SELECT g.* REPLACE (coalesce(price, i + s * l_quantity) AS price) FROM g LEFT JOIN f USING (month)),
t AS (SELECT * FROM {stepwise("h", "month", "tax", "price", "l_discount")})
SELECT {KEY}, {rnd("price", 2)}, {rnd("coalesce(tax, b0 + coalesce(b1 * price, 0) + coalesce(b2 * l_discount, 0))", 5, "tax")} FROM h LEFT JOIN t USING (month)"""

ORACLES["cascade_fill"] = f"""
WITH g AS {GAPPY}, f AS (SELECT month, regr_slope(price, l_quantity) AS s, regr_intercept(price, l_quantity) AS i FROM g GROUP BY month),
h AS MATERIALIZED (SELECT g.* REPLACE (least(greatest(coalesce(price, i + s * l_quantity), 0), 1e6) AS price) FROM g LEFT JOIN f USING (month)),
q AS MATERIALIZED (SELECT * FROM {filled("h", backward("h", "month", "qty", ["price", "l_discount"]), "month", "qty", ["price", "l_discount"])})
SELECT {KEY}, {rnd("price", 2)}, {rnd("qty", 2)}, {rnd("tax", 4)}
FROM {filled("q", backward("q", "month", "tax", ["price", "qty", "l_discount"]), "month", "tax", ["price", "qty", "l_discount"])}"""

_RULES = f"""(SELECT (['l_quantity', 'l_extendedprice', 'l_discount', 'l_tax'])[r_regionkey % 4 + 1] AS variable,
  CASE WHEN r_regionkey % 2 = 0 THEN make_date(1996 + r_regionkey, 1, 1) END AS before,
  CASE WHEN r_regionkey <> 1 THEN 0.02::DOUBLE END AS lo, CASE WHEN r_regionkey <> 3 THEN r_regionkey * 10000 + 20.0::DOUBLE END AS hi FROM region)"""
ORACLES["clamp_rules"] = f"""
WITH l AS (SELECT row_number() OVER () AS rid, CAST(l_shipdate AS DATE) AS date, {", ".join(MEASURES)} FROM lineitem),
u AS (UNPIVOT l ON {", ".join(MEASURES)} INTO NAME variable VALUE value),
b AS (SELECT rid, any_value(date) AS date, u.variable, any_value(value) AS value, max(lo) AS lo, min(hi) AS hi
      FROM u LEFT JOIN {_RULES} r ON r.variable = u.variable AND (before IS NULL OR date < before) GROUP BY rid, u.variable),
c AS (SELECT variable, year(date) AS year, least(greatest(value, coalesce(lo, value)), coalesce(hi, greatest(value, coalesce(lo, value)))) AS v FROM b)
SELECT variable, CAST(year AS INT) AS year, {rnd("min(v)", 5, "low")}, {rnd("max(v)", 5, "high")}, {rnd("avg(v)", 5, "mean")} FROM c GROUP BY variable, year"""

ORACLES["clamp_wide"] = f"""
SELECT {KEY}, CASE WHEN CAST(l_shipdate AS DATE) < DATE '1998-01-01' THEN least(greatest(l_quantity, 5.0::DOUBLE), 40.0::DOUBLE) ELSE l_quantity END AS l_quantity,
  greatest(l_tax, 0.02::DOUBLE) AS l_tax FROM lineitem"""


def interpolated(source: str, axis: str) -> str:
    """Subquery: ``event_id, user_id, value, filled``, per user along (ts, event_id)."""
    known = f"CASE WHEN value IS NOT NULL THEN {axis} END"
    before = "(PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    after = "(PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
    return f"""(SELECT *, CASE WHEN value IS NOT NULL THEN value WHEN v0 IS NULL THEN v1 WHEN v1 IS NULL OR a0 = a1 THEN v0
        ELSE v0 + (v1 - v0) * ({axis} - a0) / (a1 - a0) END AS filled
      FROM (SELECT *, last_value(value IGNORE NULLS) OVER {before} AS v0, first_value(value IGNORE NULLS) OVER {after} AS v1,
              CAST(last_value({known} IGNORE NULLS) OVER {before} AS DOUBLE) AS a0, CAST(first_value({known} IGNORE NULLS) OVER {after} AS DOUBLE) AS a1
        FROM {source}))"""


_EV = """(SELECT event_id, user_id, ts, CASE WHEN event_id % 7 <> 0 THEN value END AS value, epoch_us(ts) AS us,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM events)"""
ORACLES["interpolated_series"] = f"SELECT event_id, user_id, {rnd('filled', 5, 'value')} FROM {interpolated(_EV, 'pos')}"
ORACLES["interpolated_by_time"] = f"SELECT event_id, user_id, {rnd('filled', 5, 'value')} FROM {interpolated(_EV, 'us')}"

_SPIKY = """(SELECT event_id, user_id, ts, CASE WHEN event_id % 101 = 0 AND event_id % 7 <> 0 THEN value * 50 + 500
   WHEN event_id % 101 = 0 THEN NULL WHEN event_id % 7 <> 0 THEN value END AS value,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM events)"""
ORACLES["clean_series"] = f"""
WITH full_ AS (SELECT event_id, user_id, ts, pos, value AS seen, filled, least(3, pos - 1, count(*) OVER (PARTITION BY user_id) - pos) AS h
  FROM {interpolated(_SPIKY, "pos")}),
mid AS (SELECT a.event_id, median(b.filled) AS mid FROM full_ a JOIN full_ b
  ON a.user_id = b.user_id AND b.pos BETWEEN a.pos - a.h AND a.pos + a.h GROUP BY a.event_id),
sm AS (SELECT a.event_id, avg(m.mid) AS smooth FROM full_ a JOIN full_ b
  ON a.user_id = b.user_id AND b.pos BETWEEN a.pos - a.h AND a.pos + a.h JOIN mid m ON m.event_id = b.event_id GROUP BY a.event_id),
res AS (SELECT full_.*, filled - smooth AS r FROM full_ JOIN sm USING (event_id)),
q AS (SELECT user_id, quantile_cont(r, 0.25) AS q1, quantile_cont(r, 0.75) AS q3 FROM res GROUP BY user_id),
hit AS (SELECT res.*, coalesce(q3 - q1 > 1e-14 AND (r < q1 - 3 * (q3 - q1) OR r > q3 + 3 * (q3 - q1)), FALSE) AS hit FROM res JOIN q USING (user_id)),
again AS (SELECT event_id, user_id, ts, pos, hit, seen, CASE WHEN NOT hit THEN filled END AS value FROM hit)
SELECT event_id, user_id, {rnd("filled", 4, "cleaned")}, hit AND seen IS NOT NULL AS outlier FROM {interpolated("again", "pos")}"""


def _lines(source: str, value: str, span: float, fit: str, error: str = "") -> str:
    """Rows of ``source`` with the line through each row's window, and what it misses the row by when fitted without it."""
    h, wide = f"greatest(2, floor(0.5 * {span} * a.n + 0.5))", f"least(2 * greatest(2, floor(0.5 * {span} * a.n + 0.5)) + 1, a.n)"
    low = f"least(greatest(a.pos - {h}, 1), a.n - {wide} + 1)"
    left = "1 - 1 / w - coalesce(power(pos - xm, 2) / nullif(sxx, 0), 0)"
    line = "ym + coalesce(sxy / nullif(sxx, 0), 0) * (pos - xm)"
    miss = f", CASE WHEN {left} > 1e-9 THEN abs({value} - ({line})) / ({left}) ELSE 0 END AS {error}" if error else ""
    return f"""(SELECT * EXCLUDE (k, w, xm, ym, sxx, sxy), {line} AS {fit}{miss} FROM {source} JOIN (
      SELECT a.event_id AS k, count(*) AS w, avg(b.pos) AS xm, avg(b.{value}) AS ym, regr_sxx(b.{value}, b.pos) AS sxx, regr_sxy(b.{value}, b.pos) AS sxy
      FROM {source} a JOIN {source} b ON a.user_id = b.user_id AND b.pos BETWEEN {low} AND {low} + {wide} - 1 GROUP BY a.event_id) ON k = event_id)"""


def _span_pass(i: int, source: str) -> str:
    """One pass of outlier replacement against the smooth of variable span: ``h{i}`` with what is left as ``value``."""
    steps = [(f"y{i}", f"SELECT event_id, user_id, ts, pos, seen, gone, filled AS y, count(*) OVER (PARTITION BY user_id) AS n FROM {interpolated(source, 'pos')}")]
    for k, (value, span, fit, error) in enumerate([("y", 0.05, "c0", "e0"), ("y", 0.2, "c1", "e1"), ("y", 0.5, "c2", "e2"),
                                                   ("e0", 0.2, "m0", ""), ("e1", 0.2, "m1", ""), ("e2", 0.2, "m2", "")]):
        steps.append((f"f{i}_{k}", f"SELECT * FROM {_lines(steps[-1][0], value, span, fit, error)}"))
    steps.append((f"b{i}", f"SELECT *, CASE least(m0, m1, m2) WHEN m0 THEN 0.05::DOUBLE WHEN m1 THEN 0.2 ELSE 0.5 END AS best FROM {steps[-1][0]}"))
    steps.append((f"s{i}", f"SELECT *, least(greatest(sp, 0.05::DOUBLE), 0.5) - 0.2 AS off FROM {_lines(f'b{i}', 'best', 0.2, 'sp')}"))
    steps.append((f"x{i}", f"SELECT event_id, user_id, ts, pos, seen, gone, y, n, CASE WHEN off >= 0 THEN (1 - off / 0.3) * c1 + off / 0.3 * c2 ELSE (1 + off / 0.15) * c1 - off / 0.15 * c0 END AS z FROM s{i}"))
    steps.append((f"r{i}", f"SELECT *, y - sm AS r FROM {_lines(f'x{i}', 'z', 0.05, 'sm')}"))
    steps.append((f"q{i}", f"SELECT user_id, quantile_cont(r, 0.25) AS q1, quantile_cont(r, 0.75) AS q3 FROM r{i} GROUP BY user_id"))
    hit = "coalesce(q3 - q1 > 1e-14 AND (r < q1 - 3 * (q3 - q1) OR r > q3 + 3 * (q3 - q1)), FALSE)"
    steps.append((f"h{i}", f"SELECT event_id, user_id, ts, pos, seen, gone OR {hit} AS gone, CASE WHEN NOT {hit} THEN y END AS value FROM r{i} JOIN q{i} USING (user_id)"))
    return ",\n".join(f"{name} AS MATERIALIZED ({sql})" for name, sql in steps)


ORACLES["clean_series_spans"] = f"""
WITH start AS (SELECT event_id, user_id, ts, pos, value, value AS seen, FALSE AS gone FROM {_SPIKY}),
{_span_pass(1, "start")},
{_span_pass(2, "h1")}
SELECT event_id, user_id, {rnd("filled", 6, "cleaned")}, gone AND seen IS NOT NULL AS outlier FROM {interpolated("h2", "pos")}"""

# --- clusters ----------------------------------------------------------------------------------

ORACLES["field_problems"] = """
SELECT 'o_custkey' AS "column", 'int' AS expected, 'n' || (o_orderkey % 7) AS actual, count(*) AS n FROM orders WHERE o_orderkey % 50 = 3 GROUP BY ALL
UNION ALL SELECT 'o_orderdate', 'date', '1995-02-31', count(*) FROM orders WHERE o_orderkey % 70 = 5 GROUP BY ALL"""

# Each turn of the recursion merges the two clusters whose union adds least to the sum of squares; ``id`` of the merged one is the smaller.
_PARTS = ("bal", "size", "spread")
_ADDS = f"a.n * b.n / (a.n + b.n) * ({' + '.join(f'power(a.{c} - b.{c}, 2)' for c in _PARTS)})"
_WARD = f"""WITH RECURSIVE start AS (SELECT row_number() OVER (ORDER BY {', '.join(_PARTS)}) - 1 AS id, {', '.join(_PARTS)} FROM {SCALED}),
merged AS (SELECT 0 AS step, id, 1.0::DOUBLE AS n, {', '.join(_PARTS)}, NULL::BIGINT AS ia, NULL::BIGINT AS ib, 0.0::DOUBLE AS adds FROM start
  UNION ALL
  SELECT any_value(step) + 1, CASE WHEN id = best.ib THEN best.ia ELSE id END, sum(n), {', '.join(f'sum(n * {c}) / sum(n)' for c in _PARTS)}, any_value(best.ia), any_value(best.ib), any_value(best.adds)
  FROM merged CROSS JOIN (SELECT a.id AS ia, b.id AS ib, {_ADDS} AS adds FROM merged a JOIN merged b ON a.id < b.id ORDER BY 3, 1, 2 LIMIT 1) best
  GROUP BY CASE WHEN id = best.ib THEN best.ia ELSE id END)"""
ORACLES["ward_tree"] = f"""
{_WARD}, steps AS (SELECT step, ia, ib, any_value(adds) AS adds, CAST(max(CASE WHEN id = ia THEN n END) AS BIGINT) AS n FROM merged WHERE step > 0 GROUP BY ALL)
SELECT CAST(step AS INTEGER) AS step, CAST(ia AS INTEGER) AS a, CAST(ib AS INTEGER) AS b, {rnd("sqrt(2 * adds)", 5, "height")}, n, {rnd("sum(adds) OVER (ORDER BY step)", 4, "wss")} FROM steps"""
ORACLES["ward_cut"] = f"""
{_WARD}
SELECT CAST(row_number() OVER (ORDER BY id) - 1 AS INTEGER) AS cluster, CAST(n AS BIGINT) AS n, {', '.join(rnd(c, 5) for c in _PARTS)}
FROM merged WHERE step = (SELECT max(step) FROM merged) - 2"""

_D2 = " + ".join(f"power(a.{c} - b.{c}, 2)" for c in VEC)
ORACLES["pair_squares"] = f"""
WITH s AS (SELECT * FROM {CUSTOMERS}),
d AS (SELECT a.c_mktsegment, {_D2} AS d2 FROM s a JOIN s b ON a.c_mktsegment = b.c_mktsegment AND a.id < b.id)
SELECT c_mktsegment, (SELECT count(*) FROM s WHERE s.c_mktsegment = d.c_mktsegment) AS n, count(*) AS pairs,
  {rnd("sum(d2)", 6, "sum_sq")}, {rnd("avg(d2)", 6, "mean_sq")} FROM d GROUP BY c_mktsegment"""
ORACLES["centroid_distance"] = f"""
WITH s AS (SELECT * FROM {CUSTOMERS}), o AS (SELECT {", ".join(f"avg({c}) AS {c}" for c in VEC)} FROM s)
SELECT c_mktsegment, count(*) AS n, {rnd("sqrt(" + " + ".join(f"power(avg(s.{c}) - any_value(o.{c}), 2)" for c in VEC) + ")", 6, "distance")}
FROM s CROSS JOIN o GROUP BY c_mktsegment"""

_D2C = " + ".join(f"power(p.{c} - c.{c}, 2)" for c in VEC)
_LARGEST = ", ".join(f"p.{c} DESC" for c in VEC)
_CENTRES, _TURNS = 10, 10


def _farthest(j: int) -> str:
    """Starting centre ``j``: the row farthest from the mean, later from the centres before."""
    before = "mean" if j == 1 else "(" + " UNION ALL ".join(f"SELECT * FROM f{i}" for i in range(1, j)) + ")"
    return f"f{j} AS MATERIALIZED (SELECT {', '.join('p.' + c for c in VEC)} FROM p CROSS JOIN {before} c GROUP BY p.id, {', '.join('p.' + c for c in VEC)} ORDER BY min({_D2C}) DESC, {_LARGEST} LIMIT 1)"


def _turn(t: int) -> str:
    """One iteration: nearest centre of each row in each fit, then the centres' new places."""
    return f"""a{t} AS MATERIALIZED (SELECT k, id, j FROM (SELECT c.k, c.j, p.id, row_number() OVER (PARTITION BY c.k, p.id ORDER BY {_D2C}, c.j) AS o FROM p CROSS JOIN c{t - 1} c) WHERE o = 1),
c{t} AS MATERIALIZED (SELECT c.k, c.j, {', '.join(f'coalesce(avg(p.{c}), any_value(c.{c})) AS {c}' for c in VEC)}
  FROM c{t - 1} c LEFT JOIN a{t} a ON a.k = c.k AND a.j = c.j LEFT JOIN p ON p.id = a.id GROUP BY c.k, c.j)"""


ORACLES["elbow"] = f"""
WITH p AS MATERIALIZED (SELECT id, {', '.join(VEC)} FROM {CUSTOMERS} WHERE {' AND '.join(f'{c} IS NOT NULL' for c in VEC)}),
mean AS MATERIALIZED (SELECT {', '.join(f'avg({c}) AS {c}' for c in VEC)} FROM p),
{', '.join(_farthest(j) for j in range(1, _CENTRES + 1))},
c0 AS MATERIALIZED (SELECT k, j, {', '.join(VEC)} FROM ({' UNION ALL '.join(f'SELECT {j} AS j, * FROM f{j}' for j in range(1, _CENTRES + 1))}) CROSS JOIN (SELECT unnest(range(1, {_CENTRES + 1})) AS k) WHERE j <= k),
{', '.join(_turn(t) for t in range(1, _TURNS + 1))}
SELECT CAST(k AS INT) AS k, {rnd("sum(d)", 4, "wss")} FROM (SELECT c.k, p.id, min({_D2C}) AS d FROM p CROSS JOIN c{_TURNS} c GROUP BY c.k, p.id) GROUP BY k"""



def _vector_far(j: int) -> str:
    before = "mean" if j == 1 else "(" + " UNION ALL ".join(f"SELECT * FROM f{i}" for i in range(1, j)) + ")"
    return f"f{j} AS MATERIALIZED (SELECT p.v FROM p CROSS JOIN {before} c GROUP BY p.id, p.v ORDER BY min(list_distance(p.v, c.v)) DESC, p.v DESC LIMIT 1)"


def _vector_mean(rows: str, keys: str) -> str:
    return f"SELECT {keys} list(m ORDER BY i) AS v FROM (SELECT {keys} i, avg(v[i]) AS m FROM {rows} CROSS JOIN dims GROUP BY {keys} i) GROUP BY ALL"


def _vector_turn(t: int) -> str:
    return f"""a{t} AS MATERIALIZED (SELECT id, v, arg_min(j, d) AS j FROM (SELECT p.id, p.v, c.j, list_distance(p.v, c.v) AS d FROM p CROSS JOIN c{t - 1} c) GROUP BY id, v),
c{t} AS MATERIALIZED ({_vector_mean(f"a{t}", "j,")})"""


ORACLES["kmeans_clusters"] = f"""
WITH p AS MATERIALIZED (SELECT row_number() OVER () AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE embedding IS NOT NULL),
dims AS (SELECT unnest(range(1, (SELECT max(len(v)) FROM p) + 1)) AS i),
mean AS MATERIALIZED ({_vector_mean("p", "")}),
{', '.join(_vector_far(j) for j in (1, 2, 3))},
c0 AS MATERIALIZED ({' UNION ALL '.join(f"SELECT {j} AS j, v FROM f{j}" for j in (1, 2, 3))}),
{', '.join(_vector_turn(t) for t in range(1, _TURNS + 1))}
SELECT CAST(j - 1 AS INT) AS cluster, count(*) AS n FROM (
  SELECT p.id, arg_min(c.j, list_distance(p.v, c.v)) AS j FROM p CROSS JOIN c{_TURNS} c GROUP BY p.id) GROUP BY j"""

# --- survey ------------------------------------------------------------------------------------

ORACLES["survey_summary"] = f"""
WITH s AS (SELECT CASE WHEN o_orderkey % 11 <> 0 THEN o_orderpriority END AS site, year(o_orderdate) AS year, o_totalprice AS depth,
    o_totalprice / (o_custkey % 7 + 1) AS swe FROM orders),
e AS (SELECT CASE WHEN site IN ('1-URGENT', '2-HIGH') THEN 'Forest' WHEN site = '3-MEDIUM' THEN 'Fen' END AS ecosystem,
    CASE WHEN year BETWEEN 1995 AND 1997 THEN '1995-1997' WHEN year BETWEEN 1998 AND 2001 THEN '1998-2001' END AS period, depth, swe
  FROM s WHERE site IS NOT NULL AND site NOT IN ('4-NOT SPECIFIED', '5-LOW'))
SELECT ecosystem, period, {", ".join(rnd(f"avg({c})", 4, f"{c}_mean") for c in ("depth", "swe"))},
  {", ".join(rnd(f"stddev_samp({c})", 4, f"{c}_sd") for c in ("depth", "swe"))} FROM e GROUP BY ecosystem, period"""

ORACLES["needle_ranking"] = f"""
WITH y AS (SELECT CAST(year(o_orderdate) AS INT) AS year, avg(o_totalprice) FILTER (o_orderkey % 13 <> 0 AND o_orderkey % 17 <> 0) AS gmin
  FROM orders WHERE o_orderpriority IN ('1-URGENT', '3-MEDIUM') AND o_orderstatus IN ('O', 'R', 'F') GROUP BY 1),
r AS (SELECT *, gmin / avg(gmin) OVER () - 1 AS prop, CASE WHEN gmin IS NOT NULL THEN rank() OVER (ORDER BY gmin) + (count(*) OVER (PARTITION BY gmin) - 1) / 2.0 END AS rank FROM y)
SELECT year, {rnd("gmin", 5)}, {rnd("prop", 5)}, {rnd("rank", 5)} FROM r"""
