"""Whole analyses on small made-up tables."""

import datetime as dt
import math

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from driftline.operators.aggregate import threshold_band
from driftline.operators.cleaning import Clamp
from driftline.operators.gapfill import Model
from driftline.plans import survey, temperature

START = dt.date(2004, 10, 15)
DAYS = 365 * 3


@pytest.fixture(scope="module")
def station(spark):
    """Hourly readings, every sixth hour."""
    rng = np.random.default_rng(0)
    out = []
    for d in range(DAYS):
        level = 12 * math.sin(2 * math.pi * (d - 100) / 365)
        out += [(dt.datetime.combine(START + dt.timedelta(d), dt.time(h)), float(level + rng.normal())) for h in (0, 6, 12, 18)]
    return spark.createDataFrame([r for r in out if r[0].date() != START + dt.timedelta(5)], "datetime timestamp_ntz, station_temp double")


@pytest.fixture(scope="module")
def sensors(spark):
    rng = np.random.default_rng(1)
    out = []
    for d in range(DAYS):
        day = START + dt.timedelta(d)
        air = 12 * math.sin(2 * math.pi * (d - 100) / 365) + float(rng.normal())
        base = {"mlk_temp_150": air, "rlk_temp_150": air + 1, "mlk_temp_0": 0.5 * air + 2, "rlk_temp_0": 0.4 * air + 1,
                "mlk_temp_20": 0.3 * air, "mlk_temp_40": 0.2 * air - 1}
        row = [day, day.year]
        for j, (name, v) in enumerate(base.items()):
            for s, shift in (("avg", 0.0), ("max", 2.0), ("min", -2.0)):
                missing = 200 + 37 * j <= d < 230 + 37 * j or (day.month == 2 and name == "mlk_temp_20" and s == "max")
                value = v + shift + float(rng.normal(0, 0.1))
                if d == 77 and name == "rlk_temp_150" and s == "max":
                    value += 400.0
                row.append(None if missing else value)
        out.append(tuple(row))
    names = [f"{n}_{s} double" for n in base for s in ("avg", "max", "min")]
    return spark.createDataFrame(out, "date date, YEAR int, " + ", ".join(names))


STEPS = (
    ("mlk_temp_0", ("mlk_temp_150", "rlk_temp_150", temperature.STATION), False),
    ("rlk_temp_0", ("mlk_temp_150", "rlk_temp_150", temperature.STATION, "mlk_temp_0"), False),
    ("mlk_temp_20", ("mlk_temp_0", "rlk_temp_0"), True),
    ("mlk_temp_40", ("mlk_temp_0", "mlk_temp_20"), True),
)


def test_fill_sensor_table(sensors, station):
    out = temperature.fill_sensor_table(
        sensors, station, models=temperature.sensor_models(STEPS), clean_air=("rlk_temp_150_max",), clean_ground=("mlk_temp_0_max",),
        ground_clamps=(Clamp("mlk_temp_40_avg", "2006-01-01", -2.0, 1.0),))
    got, seen = rows(out, "date"), rows(sensors, "date")
    assert len(got) == DAYS
    temps = [c for c in sensors.columns if "_temp_" in c]
    cleaned = {"rlk_temp_150_max", "mlk_temp_0_max", "mlk_temp_40_avg"}
    for g, s in zip(got, seen):
        for c in temps:
            if s[c] is not None and c not in cleaned:
                assert g[c] == s[c]
            if not (c.startswith(("mlk_temp_20_max", "mlk_temp_40_max")) and g["date"].month == 2):
                assert g[c] is not None, (c, g["date"])
    # no observation in any February: no model, so the gap stays
    assert any(g["mlk_temp_20_max"] is None for g in got) and all(
        g["mlk_temp_20_max"] is not None or g["date"].month == 2 for g in got)
    assert got[77]["rlk_temp_150_max"] < 40
    assert all(-2 <= g["mlk_temp_40_avg"] <= 1 for g in got if g["date"] < dt.date(2006, 1, 1))
    for g in got[200:230]:
        assert abs(g["mlk_temp_150_avg"] - g[temperature.STATION]) < 6
    assert got[5]["station_temp"] is None and got[5][temperature.STATION] is not None


def plain_fit(x, y, stepwise):
    """Kept columns and coefficients of least squares; with ``stepwise``, columns go while the criterion falls."""
    def score(cols):
        m = np.column_stack([np.ones(len(y)), *[x[:, c] for c in cols]])
        b = np.linalg.lstsq(m, y, rcond=None)[0]
        return len(y) * math.log(((y - m @ b) ** 2).sum() / len(y)) + 2 * (len(cols) + 1), b

    cols = list(range(x.shape[1]))
    aic, b = score(cols)
    while stepwise and cols:
        low, drop = min((score([c for c in cols if c != d])[0], d) for d in cols)
        if low >= aic:
            break
        cols = [c for c in cols if c != drop]
        aic, b = score(cols)
    return cols, b


def plain_fill(table, month, target, predictors, stepwise):
    out = table[target].copy()
    x = np.column_stack([table[p] for p in predictors])
    for m in range(1, 13):
        known = (month == m) & ~np.isnan(x).any(1) & ~np.isnan(table[target])
        if known.sum():
            cols, b = plain_fit(x[known], table[target][known], stepwise)
            empty = (month == m) & np.isnan(table[target])
            out[empty] = b[0] + x[empty][:, cols] @ b[1:]
    table[target] = out


def test_fill_equals_plain(sensors, station):
    """The whole cascade, without cleaning and bounds, against least squares month by month."""
    models = temperature.sensor_models(STEPS)
    got = rows(temperature.fill_sensor_table(sensors, station, models=models, clean_air=(), clean_ground=(), air_clamps=(), ground_clamps=()), "date")
    seen = rows(sensors, "date")
    number = lambda v: math.nan if v is None else float(v)
    names = [c for c in sensors.columns if "_temp_" in c]
    plain = {c: np.array([number(r[c]) for r in seen]) for c in names}
    month = np.array([r["date"].month for r in seen])
    days = {}
    for r in station.collect():
        days.setdefault(r["datetime"].date(), []).append(r["station_temp"])
    daily = np.array([np.mean(days[r["date"]]) if r["date"] in days else math.nan for r in seen])
    plain[temperature.STATION] = np.where(np.isnan(daily), np.nanmean(daily), daily)
    for c in names:
        if "_temp_150_" in c:
            plain_fill(plain, month, c, [temperature.STATION], False)
    for m in models:
        plain_fill(plain, month, m.target, list(m.predictors), m.stepwise)
    for c in [*names, temperature.STATION]:
        assert [number(r[c]) for r in got] == pytest.approx(plain[c].tolist(), abs=1e-6, nan_ok=True), c


def test_standard_steps():
    models = temperature.sensor_models()
    assert len(models) == 36 and sum(m.stepwise for m in models) == 30
    from driftline.operators.gapfill import levels
    assert [len(x) for x in levels(models)] == [3, 3, 3, 3, 3, 6, 6, 6, 3]
    assert Model("rlk_temp_5_max", ("rlk_temp_0_max", "rlk_temp_2p5_max", "rlk_temp_150_max"), True) in models


def test_slopes(sensors):
    cols = ["mlk_temp_0_avg", "rlk_temp_0_avg", "mlk_temp_20_max"]
    annual = temperature.annual_slopes(sensors, "YEAR", cols)
    assert {r["n"] for r in annual.collect()} == {3}
    seasonal = temperature.seasonal_slopes(sensors, "date", cols)
    assert seasonal.count() == 6
    both = rows(temperature.combined_slopes(annual, seasonal, "avg", {"Annual": "Annual", "Cool": "Oct-May", "Warm": "Jun-Sep"},
                                            {"mlk": "M", "rlk": "R"}), "site", "period_ord")
    assert [(r["site"], r["period"]) for r in both] == [(s, p) for s in "MR" for p in ("Annual", "Oct-May", "Jun-Sep")]
    assert all(r["depth"] == 0 for r in both)
    edges = temperature.seasonal_regressions(sensors, "date", cols)
    assert {(r["season"], r["n"]) for r in edges.collect()} == {("cool", 2), ("warm", 1)}


def test_seasonal_summary(spark):
    data = [("a", dt.date(2010, 11, 1), "avg", 2.0), ("a", dt.date(2011, 1, 1), "avg", 4.0), ("a", dt.date(2011, 7, 1), "avg", 9.0),
            ("a", dt.date(2011, 7, 2), "avg", None), ("a", dt.date(2011, 7, 1), "min", 1.0), ("a", dt.date(2011, 1, 1), "max", 30.0)]
    df = spark.createDataFrame(data, "site string, date date, stat string, value double")
    got = {r["season"]: r for r in rows(temperature.seasonal_summary(df, ["site"], "date"), "season")}
    assert (got["annual"]["mean_value"], got["annual"]["min_value"], got["annual"]["max_value"]) == (5.0, 1.0, 30.0)
    assert got["cool"]["mean_value"] == 3.0 and got["cool"]["min_value"] is None and got["warm"]["season_year"] == 2011


@pytest.fixture(scope="module")
def snow(spark):
    rng = np.random.default_rng(3)
    data = []
    for t, site in enumerate(["Alpha Lake", "alpha", "Beta", "Gamma", "No Data", None, "Elsewhere"]):
        for year in (2006, 2008, 2010, 2018, 2020, 2022, 2030):
            for i in range(10):
                late = 30.0 if year >= 2016 and site in ("Alpha Lake", "alpha") else 0.0
                v = float(rng.normal(100 + late, 5))
                data.append((f"{t}-{year}-{i}", site, year, v / 3, 0.3, v, None if i == 0 else float(rng.normal(2, 0.2))))
    return spark.createDataFrame(data, "id string, site string, year int, depth double, density double, swe double, htc double")


def test_survey(spark, snow):
    prepared = survey.prepare_survey(snow, {"alpha": "Alpha Lake"}, {"Alpha Lake": "Island", "Beta": "Forest", "Gamma": "Forest"},
                                     [(2006, 2015, "early"), (2016, 2024, "late")])
    assert prepared.filter("site = 'No Data' or site is null").count() == 0
    assert prepared.filter("period is null").select("year").distinct().first().year == 2030
    got = {r["ecosystem"]: r for r in rows(survey.period_change(
        prepared, "ecosystem", "early", "late", ["depth", "density", "swe", "htc"], ["swe", "htc"], ["id"], 200), "ecosystem")}
    assert set(got) == {"Island", "Forest"}
    assert got["Island"]["swe_linetype"] == "solid" and got["Island"]["swe_lower"] > 20
    assert got["Island"]["swe_late"] - got["Island"]["swe_early"] == pytest.approx(30, abs=4)
    assert got["Forest"]["swe_lower"] < got["Forest"]["swe_late"] - got["Forest"]["swe_early"] < got["Forest"]["swe_upper"]
    points = spark.createDataFrame([("Alpha Lake", -93.0, 58.0), ("Nowhere", 0.0, 0.0)], "site string, lon double, lat double")
    trends = rows(survey.site_trends(prepared, points, ["swe", "htc"]), "metric")
    assert [(r["site"], r["metric"], r["radius"]) for r in trends] == [("Alpha Lake", "htc", 4.0), ("Alpha Lake", "swe", 10.0)]
    assert "<b>Metric:</b> SWE<br>" in trends[1]["popup"]
    summary = survey.group_summary(prepared, ["ecosystem"], ["depth"], exclude=["Elsewhere"])
    assert {r["ecosystem"] for r in summary.collect()} == {"Island", "Forest"}
    band = threshold_band(prepared, ["ecosystem"], "depth", 1.0)
    assert band.count() > 0


def test_year_report(snow):
    got = {r["site"]: r for r in rows(survey.year_report(snow, ["site"], "swe", "year", 2022), "site")}
    r = got["Alpha Lake"]
    assert r["percent_diff"] == pytest.approx((r["current"] - r["history"]) / r["history"] * 100) and r["t"] < 0 and None in got
    empty = {r["site"]: r for r in rows(survey.year_report(snow, ["site"], "swe", "year", 2025), "site")}
    assert all(v["t"] is None and v["current"] is None and v["history"] is not None for v in empty.values())


def test_ranked_measurements(spark):
    data = [("S1", "F", 2013, "1.0"), ("S1", "R", 2013, "3.0"), ("S1", "F", 2014, "2.0"), ("S2", "F", 2015, "8"), ("S2", "F", 2015, "bad"),
            ("S9", "F", 2013, "99"), ("S1", "X", 2014, "99"), ("S1", None, 2014, "99"), ("S2", "F", 2016, "NA")]
    df = spark.createDataFrame(data, "Site string, Zone string, year int, gmin string")
    got = rows(survey.ranked_measurements(df, ["S1", "S2"], {"R": "F"}, "F", "gmin"), "year")
    assert [(r["year"], r["gmin"], r["rank"]) for r in got] == [(2013, 2.0, 1.5), (2014, 2.0, 1.5), (2015, 8.0, 3.0), (2016, None, None)]
    assert got[2]["prop"] == pytest.approx(1.0)
    assert df.filter(F.col("Site") == "S9").count() == 1
