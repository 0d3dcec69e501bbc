"""Benchmark decontamination by spaced-seed hashing, in Spark SQL functions.

A seed is the hash of the words under the set positions of a fixed mask; words under the others may differ. All positions of the test
items are hashed once, all positions of the documents are hashed while they are scanned and looked up, and around each hit the two word sequences are
compared position by position. Equal words add one, unequal ones take two away, and the best stretch decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import table, without_ids

# The positions each mask looks at. Of any eight words in a row, two that differ leave at least one mask or the next place unharmed.
MASKS = [(0, 1, 2, 4, 7), (0, 1, 3, 5, 6), (0, 2, 3, 4, 6)]
SPAN = 8
REACH = 64  # words compared on either side of a hit
LOSS = 2  # what an unequal word takes from a stretch
LEAST_SCORE = 10
LEAST_SHARE = 0.6  # of an item's words, for items too short for LEAST_SCORE
BROADCAST_SEEDS = 200_000  # rows of two longs and an int; more seeds than that are joined by a shuffle


def benchmark_words(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def _seeds(words: str, at: str) -> Column:
    """Hashes of all masks at a position of a word array."""
    return F.array(*[F.xxhash64(F.lit(k), *[F.expr(f"get({words}, {at} + {o})") for o in mask]) for k, mask in enumerate(MASKS)])


def _positions(rows: DataFrame, words: str) -> DataFrame:
    n = f"size({words})"
    return rows.withColumn("at", F.explode(F.expr(f"CASE WHEN {n} >= {SPAN} THEN sequence(0, {n} - {SPAN}) ELSE cast(array() AS array<int>) END")))


def overlaps(docs: DataFrame, items: DataFrame, least_score: int = LEAST_SCORE, least_share: float = LEAST_SHARE,
             broadcast_seeds: int = BROADCAST_SEEDS) -> DataFrame:
    """``doc_id, item_id, score, first_word, item_words`` of every document and test item that share a passage.

    ``score`` is that of the best stretch, ``first_word`` the first word of the document under a hit that leads to a passing stretch. Rows that
    share an id count as one document (or item) and the best of them holds. NULL ids, NULL texts and items of fewer than eight words are in no pair.
    """
    tests = items.filter(F.col("item_id").isNotNull()).select("item_id", benchmark_words(F.col("text")).alias("iw")).distinct()
    hashed = _positions(tests, "iw").select("item_id", "iw", F.col("at").alias("iat"), F.explode(_seeds("iw", "at")).alias("seed"))
    seeds = materialize(hashed)
    n = seeds.count()
    texts = docs.filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", benchmark_words(F.col("text")).alias("dw"))
    probes = _positions(texts, "dw").select("doc_id", "dw", "at", F.explode(_seeds("dw", "at")).alias("seed"))
    hits = seeds.select("seed", "item_id", "iat")
    joined = probes.join(F.broadcast(hits) if n <= broadcast_seeds else hits, "seed")
    # the document's words that face the item's words from `low` on; outside the document nothing is equal
    low = F.greatest(F.col("iat") - REACH, F.lit(0), F.col("iat") - F.col("at"))
    start = F.col("at") - F.col("iat") + F.col("low")
    near = joined.withColumn("low", low).select(
        "doc_id", "item_id", "iat", "low", F.col("at").alias("hit"), F.slice("dw", start + 1, F.col("iat") - F.col("low") + SPAN + REACH).alias("dw")
    )
    near = near.groupBy("doc_id", "item_id", "low", F.xxhash64("dw").alias("h")).agg(F.min(F.struct("hit", "iat", "dw")).alias("r"))
    own = tests.withColumn("item_words", F.size("iw"))
    pairs = near.select("doc_id", "item_id", "low", "r.*").join(F.broadcast(own) if n <= broadcast_seeds else own, "item_id")
    facing = F.slice("iw", F.col("low") + 1, F.col("iat") - F.col("low") + SPAN + REACH)
    equal = pairs.withColumn("eq", F.zip_with("dw", facing, lambda a, b: F.coalesce(a == b, F.lit(False))))
    scored = equal.withColumn("score", F.expr(f"""aggregate(eq, named_struct('now', 0, 'best', 0), (s, e) -> named_struct(
        'now', greatest(0, s.now + if(e, 1, -{LOSS})), 'best', greatest(s.best, s.now + if(e, 1, -{LOSS}))), s -> s.best)"""))
    good = F.col("score") >= F.least(F.lit(least_score), F.ceil(F.col("item_words") * least_share))
    return scored.filter(good).groupBy("doc_id", "item_id").agg(
        F.max("score").alias("score"), F.min("hit").alias("first_word"), F.max("item_words").alias("item_words")
    )


def decontaminate(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """Rows of ``docs`` that share no passage with a test item; a row without id is kept."""
    return without_ids(docs, overlaps(docs, items, **options).select("doc_id"))


def op9_decontamination(spark, sf_dir: str) -> DataFrame:
    """Documents and the benchmark items they hold passages of."""
    return overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP9_SQL = r"""
WITH dw AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents),
iw AS (SELECT DISTINCT item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark),
masks(m, o) AS (VALUES (0, [0, 1, 2, 4, 7]), (1, [0, 1, 3, 5, 6]), (2, [0, 2, 3, 4, 6])),
dp AS (SELECT doc_id, w, unnest(range(0, len(w) - 7)) AS p0 FROM dw WHERE len(w) >= 8),
ip AS (SELECT item_id, w, unnest(range(0, len(w) - 7)) AS p0 FROM iw WHERE len(w) >= 8),
ds AS (SELECT doc_id, p0, m, list_transform(o, lambda x: w[p0 + x + 1]) AS k FROM dp, masks),
im AS (SELECT item_id, p0, m, list_transform(o, lambda x: w[p0 + x + 1]) AS k FROM ip, masks),
hits AS (SELECT DISTINCT doc_id, item_id, ds.p0 AS p0, im.p0 AS q0 FROM ds JOIN im USING (m, k)),
cells AS (
  SELECT doc_id, item_id, p0, q0, unnest(range(greatest(q0 - 64, 0, q0 - p0), q0 + 72)) AS p FROM hits),
eqs AS (
  SELECT c.*, len(i.w) AS n, d.w[p + p0 - q0 + 1] = i.w[p + 1] AS eq
  FROM cells c JOIN dw d USING (doc_id) JOIN iw i USING (item_id)),
sums AS (
  SELECT *, sum(CASE WHEN eq THEN 1 ELSE -2 END) OVER (PARTITION BY doc_id, item_id, p0, q0 ORDER BY p) AS s FROM eqs),
lows AS (
  SELECT *, least(0, min(s) OVER (PARTITION BY doc_id, item_id, p0, q0 ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS l FROM sums),
best AS (SELECT doc_id, item_id, p0, max(n) AS n, max(s - l) AS score FROM lows GROUP BY doc_id, item_id, p0, q0)
SELECT doc_id, item_id, CAST(max(score) AS INTEGER) AS score, CAST(min(p0) AS INTEGER) AS first_word, CAST(max(n) AS INTEGER) AS item_words
FROM best WHERE score >= least(10, ceil(n * 0.6)) GROUP BY doc_id, item_id
"""
