"""Helpers the text operators share: inputs, words, stable remainders, written tables, connected components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize

# ASCII white space; a word is a run of anything else.
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: Column) -> Column:
    """Words of a text in order; none for NULL."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def remainder(doc_id: Column, by: int) -> Column:
    """crc32 of the id as text modulo ``by``; -1 for a NULL id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % by, F.lit(-1))


def sample_by_hash(df: DataFrame, rows: int, key: str = "doc_id") -> DataFrame:
    """At most ``rows`` rows, those with the smallest hash of the key: the same ones wherever and however often it runs."""
    return df.orderBy(F.xxhash64(key), key).limit(rows)


def without_ids(docs: DataFrame, ids: DataFrame, broadcast_ids: int = 1_000_000) -> DataFrame:
    """Rows of ``docs`` whose ``doc_id`` is not among ``ids`` (one column); a NULL id stays. Up to ``broadcast_ids`` ids go to the rows, more are joined by a shuffle."""
    out = materialize(ids.toDF("id").distinct())
    out = F.broadcast(out) if out.count() <= broadcast_ids else out
    return docs.alias("d").join(out.alias("i"), F.col("d.doc_id") == F.col("i.id"), "left_anti")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Smallest id each node of an undirected graph can reach: ``node, component``, for nodes with an edge.

    Large-star / small-star: every round hangs each node's larger neighbours, then its smaller ones, under the smallest id of the
    neighbourhood. All steps are joins and aggregates; each round is written, so neither lineage nor a hub of any degree
    piles up in one task. Ends when a round changes nothing, after a number of rounds that grows with the logarithm of a component's size.
    """
    lo, hi = F.least(a, b).alias("u"), F.greatest(a, b).alias("v")
    now = materialize(edges.filter(F.col(a) != F.col(b)).select(lo, hi).distinct())
    seen = None
    while True:
        both = now.select(F.col("v").alias("x"), F.col("u").alias("y")).unionByName(now.select(F.col("u").alias("x"), F.col("v").alias("y")))
        least = both.groupBy("x").agg(F.min("y").alias("m")).withColumn("m", F.least("m", "x"))
        large = both.filter("y > x").join(least, "x").select(F.col("m").alias("u"), F.col("y").alias("v")).filter("u <> v").distinct()
        # now every edge points down: u < v
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(low, "v").select("m", "u", "v")
        now = materialize(
            small.select(F.col("m").alias("u"), "v").unionByName(small.filter("u <> m").select(F.col("m").alias("u"), F.col("u").alias("v"))).distinct()
        )
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        seen = mark
    return now.select(F.col("v").alias("node"), F.col("u").alias("component")).unionByName(
        now.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct()
    )
