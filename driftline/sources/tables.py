"""CSV tables, newest dated file of a folder, point files, and the dated sink."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.calendar import compact_date
from ..functions.missing import clean_missing
from ..operators.joins import attach

CORRUPT = "_corrupt_record"


def read_csv(spark: SparkSession, path, schema: str | T.StructType | None = None, null: str = "NA",
             dotted: str = "_") -> DataFrame:
    """CSV with a header; ``NA`` and empty fields are NULL, NaN in doubles too.

    Give a schema for large inputs: inferring one reads the files twice. Dots in column names, which
    Spark reads as field access, become ``dotted``.
    """
    reader = spark.read.option("header", True).option("nullValue", null).option("mode", "PERMISSIVE")
    df = reader.schema(schema).csv(path) if schema is not None else reader.option("inferSchema", True).csv(path)
    df = df.toDF(*[c.replace(".", dotted) for c in df.columns])
    return clean_missing(df)


def parse_problems(spark: SparkSession, path, schema: str, null: str = "NA") -> DataFrame:
    """Records that do not fit the schema: ``file, record``."""
    full = T.StructType(list(spark.createDataFrame([], schema).schema.fields) + [T.StructField(CORRUPT, T.StringType())])
    df = (
        spark.read.schema(full)
        .option("header", True)
        .option("nullValue", null)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .csv(path)
    )
    # every field has to be parsed for the record to be judged, so the filter refers to all of them
    parsed = reduce(lambda a, b: a + b, [F.col(f"`{f.name}`").isNotNull().cast("int") for f in full.fields[:-1]])
    named = df.select("*", F.col("_metadata.file_name").alias("file"))
    return named.filter(F.col(CORRUPT).isNotNull() & (parsed >= 0)).select("file", F.col(CORRUPT).alias("record"))


def field_problems(spark: SparkSession, path, schema: str, null: str = "NA") -> DataFrame:
    """``file, row, column, expected, actual``: one row per field that is not of its type, and per record with too few or too many fields.

    ``row`` counts the records of a file from 1; header and blank lines are none. A file is read in several pieces, so records are numbered within a piece and the counts of the
    pieces before are added. Of a record with a wrong number of fields, ``column`` is NULL and ``actual`` the record; its fields are judged as well. A field is of its
    type if it can be cast; empty fields and ``null`` always are.
    """
    fields = spark.createDataFrame([], schema).schema.fields
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in fields] + [T.StructField(CORRUPT, T.StringType())])
    options = {"header": True, "nullValue": null, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    piece = [F.col("_metadata.file_path").alias("__path"), F.col("_metadata.file_block_start").alias("__piece")]
    lines = spark.read.schema(text).options(**options).csv(path)
    lines = lines.select("*", *piece, F.col("_metadata.file_name").alias("file"), F.monotonically_increasing_id().alias("__id"))

    pieces = lines.groupBy("__path", "__piece").agg(F.min("__id").alias("__first"), F.count(F.lit(1)).alias("__n"))
    earlier = Window.partitionBy("__path").orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.select("__path", "__piece", "__first", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))

    found = lambda column, expected, actual: F.struct(column.cast("string").alias("column"), F.lit(expected).alias("expected"), actual.alias("actual"))
    judged = []
    for f in fields:
        field, kind = F.col(f"`{f.name}`"), f.dataType.simpleString()
        judged.append(F.when(field.isNotNull() & field.try_cast(kind).isNull(), found(F.lit(f.name), kind, field)))
    judged.append(F.when(F.col(CORRUPT).isNotNull(), found(F.lit(None), f"{len(fields)} columns", F.col(CORRUPT))))
    bad = lines.select("file", "__path", "__piece", "__id", F.array_compact(F.array(*judged)).alias("__bad")).filter(F.size("__bad") > 0)
    numbered = attach(bad, pieces, ["__path", "__piece"], "inner")
    return numbered.select("file", (F.col("__before") + F.col("__id") - F.col("__first") + 1).alias("row"), F.inline("__bad"))


def dated_files(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """Files and written folders in a folder whose name matches, with the last eight-digit date in the name: ``path, file, date``.

    Only names are listed, no content is read; a name that starts with a dot or an underscore is a file system's or writer's own.
    """
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    names = [(str(f.getPath().toString()), f.getPath().getName()) for f in place.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(place)]
    listed = spark.createDataFrame([n for n in names if n[1][0] not in "._"], "path string, file string")
    digits = F.regexp_extract_all("file", F.lit(r"([0-9]{8})"), F.lit(1))
    dates = F.transform(digits, lambda d: F.to_date(F.try_to_timestamp(d, F.lit("yyyyMMdd"))))
    return (
        listed.filter(F.col("file").rlike(pattern))
        .withColumn("date", F.array_max(dates))
        .select("path", "file", "date")
    )


def latest_dated_file(spark: SparkSession, folder: str, pattern: str, schema: str | None = None,
                      drop_first_col: bool = False, null: str = "NA") -> DataFrame:
    """The table whose name matches and carries the newest date; only that one is scanned.

    A name that ends in ``.parquet`` is read as Parquet, with missing values cleaned alike; any other as CSV, be it a file or a folder of part files.
    """
    newest = dated_files(spark, folder, pattern).filter(F.col("date").isNotNull())
    row = newest.orderBy(F.col("date").desc(), F.col("file").desc()).limit(1).first()
    if row is None:
        raise FileNotFoundError(f"no dated file in {folder} matches {pattern}")
    if row["file"].endswith(".parquet"):
        reader = spark.read.schema(schema) if schema else spark.read
        df = clean_missing(reader.parquet(row["path"]))
    else:
        df = read_csv(spark, row["path"], schema, null)
    return df.drop(df.columns[0]) if drop_first_col else df


def most_recent_with_prefix(spark: SparkSession, folder: str, prefix: str, schema: str | None = None) -> DataFrame:
    """The newest dated table whose name starts with ``prefix``."""
    return latest_dated_file(spark, folder, rf"^\Q{prefix}\E.*\.(csv|parquet)$", schema)


def read_points(spark: SparkSession, path, tag: str = "Placemark") -> DataFrame:
    """Named points of an XML map file: ``site, lon, lat``."""
    schema = "name string, Point struct<coordinates: string>"
    parts = F.split(F.trim("Point.coordinates"), ",")
    number = lambda i: F.trim(F.try_element_at(parts, F.lit(i))).try_cast("double")
    return (
        spark.read.option("rowTag", tag)
        .schema(schema)
        .xml(path)
        .filter(F.col("Point").isNotNull())
        .select(F.trim("name").alias("site"), number(1).alias("lon"), number(2).alias("lat"))
    )


def write_dated(df: DataFrame, folder: str, stem: str, date: str = "date", suffix: str = "filled", fmt: str = "parquet",
                mode: str = "errorifexists", order: Sequence[str] = ()) -> str:
    """Write to ``folder/stem_<first>_<last>_suffix`` named by the data's date range; returns the path.

    Parquet by default; ``fmt="csv"`` writes a header and ``NA`` for NULL. The executors write, sorted by ``order``
    across the files if it is given. The rows are computed once: their dates are observed while they are written.
    """
    if mode not in ("errorifexists", "error", "overwrite"):
        raise ValueError("a dated table is written anew: errorifexists or overwrite")
    spark, folder = df.sparkSession, folder.rstrip("/")
    seen = Observation()
    rows = df.observe(seen, compact_date(F.min(date)).alias("a"), compact_date(F.max(date)).alias("b"))
    writer = (rows.orderBy(*order) if order else rows).write
    # the dates are known once all rows are written, so they are written under another name first
    staged = f"{folder}/_{stem}_{uuid.uuid4().hex}"
    if fmt == "csv":
        writer.option("header", True).option("nullValue", "NA").csv(staged)
    else:
        writer.format(fmt).save(staged)
    span = seen.get
    named = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
    files = named(staged).getFileSystem(spark._jsc.hadoopConfiguration())
    path = f"{folder}/{stem}_{span['a']}_{span['b']}_{suffix}.{fmt}"
    try:
        if span["a"] is None:
            raise ValueError("no dates to name the output by")
        if files.exists(named(path)):
            if mode != "overwrite":
                raise FileExistsError(path)
            files.delete(named(path), True)
        if not files.rename(named(staged), named(path)):
            raise OSError(f"could not rename to {path}")
    finally:
        files.delete(named(staged), True)
    return path
