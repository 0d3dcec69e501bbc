import datetime as dt
import os

import pytest
from conftest import rows
from pyspark.sql import functions as F

from driftline import sources
from driftline.session import shared_folder


def put(path, text):
    path.write_text(text)
    return str(path)


def test_csv(spark, tmp_path):
    path = put(tmp_path / "a.csv", "date,mean.150,x,s\n2010-01-01,1.5,NA,NA\n2010-01-02,NaN,2,b\n")
    df = sources.read_csv(spark, path, "date date, `mean.150` double, x int, s string")
    assert df.columns == ["date", "mean_150", "x", "s"]
    assert [tuple(r) for r in df.collect()] == [(dt.date(2010, 1, 1), 1.5, None, None), (dt.date(2010, 1, 2), None, 2, "b")]
    assert dict(sources.read_csv(spark, path).dtypes)["x"] == "int"


def test_parse_problems(spark, tmp_path):
    put(tmp_path / "a.csv", "k,v\n1,2.0\nx,3.0\n2,y\n3,NA\n")
    put(tmp_path / "b.csv", "k,v\n5,1.0\n6,oops\n")
    got = rows(sources.parse_problems(spark, str(tmp_path), "k int, v double"), "file", "record")
    assert got == [{"file": "a.csv", "record": "2,y"}, {"file": "a.csv", "record": "x,3.0"}, {"file": "b.csv", "record": "6,oops"}]


def test_latest_file(spark, tmp_path):
    for name, v in (("m_20000101_20191231_filled.csv", 1), ("m_20000101_20221010_filled.csv", 2), ("m_20000101_20230101_raw.csv", 3),
                    ("other_20300101.csv", 4), ("m_none_filled.csv", 5)):
        put(tmp_path / name, f"row,v\n1,{v}\n")
    pattern = r"^m_\d{8}_\d{8}_filled\.csv$"
    files = rows(sources.dated_files(spark, str(tmp_path), pattern), "file")
    assert [(r["file"], r["date"]) for r in files] == [
        ("m_20000101_20191231_filled.csv", dt.date(2019, 12, 31)), ("m_20000101_20221010_filled.csv", dt.date(2022, 10, 10))]
    df = sources.latest_dated_file(spark, str(tmp_path), pattern, "row int, v int", drop_first_col=True)
    assert df.columns == ["v"] and df.first().v == 2
    assert sources.most_recent_with_prefix(spark, str(tmp_path), "other_").first().v == 4
    with pytest.raises(FileNotFoundError):
        sources.latest_dated_file(spark, str(tmp_path), "^nothing$")


POINTS = """<?xml version="1.0" encoding="UTF-8"?>
<kml xmlns="http://www.opengis.net/kml/2.2"><Document><name>points</name>
<Placemark><name>Alpha Lake</name><LookAt><longitude>1</longitude></LookAt><styleUrl>#a</styleUrl>
 <Point><coordinates>-93.5,58.25,0</coordinates></Point></Placemark>
<Placemark><name>Beta</name><Camera><longitude>1</longitude></Camera><Point><coordinates> -93.25,57.5,12.5 </coordinates></Point></Placemark>
<Placemark><name>Gamma</name><Point><coordinates>-92,57,0</coordinates></Point></Placemark>
<Placemark><name>Delta</name><Point><coordinates>-91.125,56</coordinates></Point></Placemark>
<Placemark><name>No point</name></Placemark>
</Document></kml>"""


def test_points(spark, tmp_path):
    got = rows(sources.read_points(spark, put(tmp_path / "p.kml", POINTS)), "site")
    assert [(r["site"], r["lon"], r["lat"]) for r in got] == [
        ("Alpha Lake", -93.5, 58.25), ("Beta", -93.25, 57.5), ("Delta", -91.125, 56.0), ("Gamma", -92.0, 57.0)]


def test_dated_sink(spark, tmp_path):
    df = spark.createDataFrame([(dt.date(2004, 10, 15), 1.0), (dt.date(2024, 1, 5), None)], "date date, v double")
    path = sources.write_dated(df, str(tmp_path), "series", fmt="csv")
    assert os.path.basename(path) == "series_20041015_20240105_filled.csv"
    back = sources.read_csv(spark, path, "date date, v double")
    assert rows(back, "date") == rows(df, "date")
    assert rows(spark.read.parquet(sources.write_dated(df, str(tmp_path), "series")), "date") == rows(df, "date")
    again = sources.write_dated(df.repartition(2), str(tmp_path), "series", fmt="csv", mode="overwrite", order=["date"])
    lines = [x for f in sorted(os.listdir(again)) if f.endswith(".csv") for x in open(os.path.join(again, f)).read().split()]
    assert [x for x in lines if x != "date,v"] == ["2004-10-15,1.0", "2024-01-05,NA"]
    with pytest.raises(ValueError):
        sources.write_dated(df.filter("false"), str(tmp_path), "series")
    with pytest.raises(FileExistsError):
        sources.write_dated(df, str(tmp_path), "series")
    assert sorted(os.listdir(tmp_path)) == ["series_20041015_20240105_filled.csv", "series_20041015_20240105_filled.parquet"]


@pytest.mark.parametrize("fmt", ["csv", "parquet"])
def test_source_finds_what_the_sink_wrote(spark, tmp_path, fmt):
    df = spark.createDataFrame([(dt.date(2004, 10, 15), 1.0), (dt.date(2024, 1, 5), None)], "date date, v double")
    sources.write_dated(df.filter("v = 1"), str(tmp_path), "temps", fmt=fmt)
    sources.write_dated(df, str(tmp_path), "temps", fmt=fmt)
    pattern = rf"^temps_\d{{8}}_\d{{8}}_filled\.{fmt}$"
    assert rows(sources.latest_dated_file(spark, str(tmp_path), pattern, "date date, v double"), "date") == rows(df, "date")
    assert sources.most_recent_with_prefix(spark, str(tmp_path), "temps").count() == 2


def test_sink_computes_its_rows_once(spark, tmp_path):
    ran = spark.sparkContext.accumulator(0)
    seen = F.udf(lambda v: (ran.add(1), v)[1], "double").asNondeterministic()
    df = spark.createDataFrame([(dt.date(2020, 1, k), float(k)) for k in range(1, 9)], "date date, v double").withColumn("v", seen("v"))
    sources.write_dated(df, str(tmp_path), "once")
    assert ran.value == 8


def test_checkpoint_dir_comes_from_the_session(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    assert named is None or shared_folder(spark).startswith(("file:" + named, named))


def test_no_local_lineage_cuts():
    base = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for folder, _, files in os.walk(os.path.join(base, "driftline")):
        if os.path.basename(folder) == "llm":  # samples for models are bounded there
            continue
        for f in files:
            if f.endswith(".py"):
                text = open(os.path.join(folder, f)).read()
                assert "localCheckpoint" not in text and "crossJoin" not in text and ".toPandas(" not in text


def test_corrupt_column_is_not_pruned(spark, tmp_path):
    put(tmp_path / "a.csv", "k,v\nx,1\n")
    assert sources.parse_problems(spark, str(tmp_path), "k int, v int").agg(F.count("*")).first()[0] == 1


def test_field_problems(spark, tmp_path):
    """Row numbers go on over the pieces a file is read in; short and long records; two files."""
    bad = {17, 400, 1999, 2000}
    body = "".join(f"{'x' if i in bad else i},{'2021-02-30' if i == 400 else '2021-02-03'},{i / 4}\n" for i in range(1, 2001))
    put(tmp_path / "a.csv", "k,d,v\n" + body)
    put(tmp_path / "b.csv", "k,d,v\n1,2020-01-01,NA\n\n2,2020-01-01\n3,,oops\n4,2020-01-01,1,1\n")
    pieces = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        got = sources.field_problems(spark, str(tmp_path), "k int, d date, v double").collect()
        assert spark.read.csv(str(tmp_path)).rdd.getNumPartitions() > 5
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", pieces)
    a = sorted((r["row"], r["column"], r["expected"], r["actual"]) for r in got if r["file"] == "a.csv")
    assert a == [(17, "k", "int", "x"), (400, "d", "date", "2021-02-30"), (400, "k", "int", "x"), (1999, "k", "int", "x"), (2000, "k", "int", "x")]
    b = sorted(((r["row"], r["column"] or "", r["expected"], r["actual"]) for r in got if r["file"] == "b.csv"))
    assert b == [(2, "", "3 columns", "2,2020-01-01"), (3, "v", "double", "oops"), (4, "", "3 columns", "4,2020-01-01,1,1")]
