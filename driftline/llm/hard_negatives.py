"""Hard negatives by inner product, found with a multiway hyperplane tree that keeps distance ranges between siblings.

With one more component, the root of what a vector's squared length lacks to the largest one, all vectors have one length, so an inner product with an anchor (whose extra
component is zero) is a distance, and a window of scores is an annulus around the anchor. Each node of the tree has a few split points, vectors of a bounded sample; a row goes to the
nearest one, that is, to one side of the hyperplanes between them. For every split point and every sibling subtree the node stores the least and the largest distance between the
point and the subtree's rows, taken over all rows. A subtree is passed over if, seen from any split point, its range cannot meet the annulus. The rows of the leaves that remain are
scored exactly, so nothing is approximate.

Leaves are dealt in blocks of bounded size, so a leaf of any size is many groups; anchors go to the blocks they have to visit, in chunks of bounded size.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .common import table
from .texts import small_batches

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SAMPLE_ROWS = 4096  # rows the split points are chosen from; all rows are indexed
FANOUT = 8
LEAF_SAMPLE = 48  # a node with so many sample rows or fewer is a leaf
DEPTH = 6
BLOCK_VALUES = 1 << 21  # vector components in a block of rows or a chunk of anchors
SCORES_AT_ONCE = 1 << 21
LARGEST = 1 << 24  # components are kept within this, which keeps every score in 64 bits
FAR = 1 << 62
HIT = "anchor bigint, win int, other bigint, other_id bigint, score bigint"


def vectors(column: pa.ListArray, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


@dataclass
class SplitTree:
    """``points[n]`` are the split points of node ``n``, ``below[n]`` where each leads: a node, or ``-1 - leaf``. ``low, high[n]``: distance of point i to the rows of subtree j."""

    top: float  # largest squared length
    points: list[np.ndarray] = field(default_factory=list)
    below: list[list[int]] = field(default_factory=list)
    low: list[np.ndarray] = field(default_factory=list)
    high: list[np.ndarray] = field(default_factory=list)
    leaves: int = 0

    def lifted(self, x: np.ndarray) -> np.ndarray:
        x = x.astype(float)
        return np.column_stack([x, np.sqrt(np.maximum(self.top - (x * x).sum(axis=1), 0))])

    def distances(self, x: np.ndarray, node: int, length: np.ndarray | float) -> np.ndarray:
        return np.sqrt(np.maximum(np.asarray(length)[..., None] + self.top - 2 * (x @ self.points[node].T), 0))

    def grow(self, x: np.ndarray, depth: int = 0) -> int:
        """Index of the node of these lifted rows, or ``-1 - leaf``; split points are chosen farthest first."""
        at = [0]
        apart = ((x - x[0]) ** 2).sum(axis=1) if len(x) else np.zeros(0)
        if len(x) <= LEAF_SAMPLE or depth == DEPTH or not apart.any():
            self.leaves += 1
            return -self.leaves
        at = [int(apart.argmax())]
        apart = ((x - x[at[0]]) ** 2).sum(axis=1)
        while len(at) < FANOUT and apart.any():
            at.append(int(apart.argmax()))
            apart = np.minimum(apart, ((x - x[at[-1]]) ** 2).sum(axis=1))
        node = len(self.points)
        self.points.append(x[at])
        self.below.append([])
        side = self.distances(x, node, self.top).argmin(axis=1)
        for j in range(len(at)):
            self.below[node].append(self.grow(x[side == j], depth + 1))
        return node

    def descend(self, x: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """Node, its rows' numbers, their distances to its points and their sides, from the root down."""
        x = self.lifted(x)
        todo = [(0, np.arange(len(x)))] if self.points else []
        while todo:
            node, rows = todo.pop()
            apart = self.distances(x[rows], node, self.top)
            side = apart.argmin(axis=1)
            yield node, rows, apart, side
            todo += [(child, rows[side == j]) for j, child in enumerate(self.below[node]) if child >= 0 and (side == j).any()]

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        leaf = np.zeros(len(x), np.int32)
        for node, rows, _, side in self.descend(x):
            to = np.array(self.below[node])[side]
            leaf[rows[to < 0]] = -1 - to[to < 0]
        return leaf

    def spans(self, x: np.ndarray) -> list[tuple[int, int, int, float, float]]:
        """``node, i, j, low, high`` of these rows."""
        out = []
        for node, _, apart, side in self.descend(x):
            for j in range(len(self.below[node])):
                if (side == j).any():
                    held = apart[side == j]
                    out += [(node, i, j, *ends) for i, ends in enumerate(zip(held.min(axis=0).tolist(), held.max(axis=0).tolist()))]
        return out

    def set_spans(self, rows) -> None:
        self.low = [np.full((len(p), len(p)), np.inf) for p in self.points]
        self.high = [np.full((len(p), len(p)), -np.inf) for p in self.points]
        for node, i, j, low, high in rows:
            self.low[node][i, j], self.high[node][i, j] = low, high

    def to_visit(self, x: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Anchors and leaves of which the leaf may hold a score in one of the anchor's windows ``low[a, w] <= score <= high[a, w]``."""
        x = np.column_stack([x.astype(float), np.zeros(len(x))])
        length = (x * x).sum(axis=1)
        slack = 1e-6 * np.sqrt(self.top) + 1e-9
        base = length[:, None] + self.top
        near, far = (np.sqrt(np.maximum(base - 2 * s.astype(float), 0)) for s in (high, low))
        real = low <= high
        anchors, leaves = [], []
        every = np.flatnonzero(real.any(axis=1))
        todo = [(0, every)] if self.points else []
        if not self.points:
            anchors.append(every), leaves.append(np.zeros(len(every), np.int64))
        while todo:
            node, rows = todo.pop()
            d = self.distances(x[rows], node, length[rows])
            for j, child in enumerate(self.below[node]):
                lo, hi = self.low[node][:, j], self.high[node][:, j]
                if np.isinf(lo[0]):
                    continue  # no rows there
                least = np.maximum(np.maximum(d - hi, lo - d), 0).max(axis=1) - slack
                most = (d + hi).min(axis=1) + slack
                meets = (real[rows] & (near[rows] <= most[:, None]) & (far[rows] >= least[:, None])).any(axis=1)
                if child >= 0 and meets.any():
                    todo.append((child, rows[meets]))
                elif child < 0:
                    anchors.append(rows[meets]), leaves.append(np.full(int(meets.sum()), -1 - child))
        return (np.concatenate(anchors), np.concatenate(leaves)) if anchors else (np.empty(0, np.int64), np.empty(0, np.int64))


@dataclass
class Index:
    """Rows with their leaves, the tree, how many blocks each leaf is dealt in, and the length of vectors."""

    rows: DataFrame  # row, id, label, vec, leaf
    tree: SplitTree
    blocks: np.ndarray
    dim: int


def build_index(rows: DataFrame) -> Index:
    """Index ``row, id, label, vec``: the tree is grown from at most ``SAMPLE_ROWS`` rows, all rows are put into it and set its ranges."""
    squares = F.expr("aggregate(vec, 0L, (s, x) -> s + cast(x AS bigint) * x)")
    seen = rows.agg(F.max(F.size("vec")), F.max(squares), F.count(F.lit(1))).first()
    dim, top = max(seen[0] or 0, 1), float(seen[1] or 0)
    # a shorter vector has zeros where others go on
    rows = rows.withColumn("vec", F.concat("vec", F.array_repeat(F.lit(0), F.lit(dim) - F.size("vec"))))
    sample = rows.select("row", "vec").orderBy(F.xxhash64("row"), "row").limit(SAMPLE_ROWS).select("vec").toArrow().column("vec").combine_chunks()
    tree = SplitTree(top)
    tree.grow(tree.lifted(vectors(sample, dim)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tree.leaf_of(vectors(batch.column("vec"), dim)))], names=[*batch.schema.names, "leaf"])

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = tree.spans(vectors(batch.column(0), dim))
            yield pa.RecordBatch.from_pylist([dict(zip(("node", "i", "j", "low", "high"), f)) for f in found], schema)

    schema = pa.schema([("node", pa.int32()), ("i", pa.int32()), ("j", pa.int32()), ("low", pa.float64()), ("high", pa.float64())])
    with small_batches(rows.sparkSession):
        rows = materialize(rows.select("row", "id", "label", "vec").mapInArrow(place, "row bigint, id bigint, label bigint, vec array<int>, leaf int"))
        ends = rows.select("vec").mapInArrow(spans, "node int, i int, j int, low double, high double").groupBy("node", "i", "j").agg(F.min("low"), F.max("high")).collect()
    tree.set_spans(ends)  # as many as the tree has pairs of siblings
    sizes = np.zeros(max(tree.leaves, 1), np.int64)
    for leaf, n in rows.groupBy("leaf").count().collect():
        sizes[leaf] = n
    return Index(rows, tree, -(-sizes // max(1, BLOCK_VALUES // dim)), dim)


def best_in(anchors: pa.Table, rows: pa.Table, same: bool, k: int, dim: int, top: float) -> pa.Table:
    """The ``k`` best rows of a block for each window of each anchor."""
    rows = rows.sort_by([("id", "ascending"), ("row", "ascending")])  # NULL ids come last
    kind = float if top < 2**53 else np.int64  # scores are at most ``top``: exact in either
    x = vectors(rows.column("vec").combine_chunks(), dim).astype(kind)
    q = vectors(anchors.column("vec").combine_chunks(), dim).astype(kind)
    number, label, ids = rows["row"].to_numpy(), rows["label"].to_numpy(), rows["id"]
    own, own_label = anchors["row"].to_numpy(), anchors["label"].to_numpy()
    lows, highs = anchors["low"].to_pylist(), anchors["high"].to_pylist()
    found = []
    step = max(1, SCORES_AT_ONCE // max(1, len(x)))
    for at in range(0, len(q), step):
        scores = (q[at : at + step] @ x.T).astype(np.int64)
        for a, s in enumerate(scores, at):
            usable = ((label == own_label[a]) == same) & (number != own[a]) & (s >= min(lows[a])) & (s <= max(highs[a]))
            some = np.flatnonzero(usable)
            held = s[some]
            for w, (lo, hi) in enumerate(zip(lows[a], highs[a])):
                pick = np.flatnonzero((held >= lo) & (held <= hi))
                if len(pick) > k:
                    pick = pick[held[pick] >= np.partition(held[pick], len(pick) - k)[len(pick) - k]]
                pick = pick[np.argsort(-held[pick], kind="stable")[:k]]
                found += [(a, w, p) for p in some[pick].tolist()]
    a, w, p = (np.array([f[i] for f in found], np.int64) for i in range(3))
    at = np.array([], np.int64) if not found else a
    score = np.einsum("ij,ij->i", q[at], x[p]).astype(np.int64) if found else at
    arrays = [pa.array(own[at]), pa.array(w.astype(np.int32)), pa.array(number[p]), ids.combine_chunks().take(pa.array(p)), pa.array(score)]
    return pa.table(arrays, names=["anchor", "win", "other", "other_id", "score"])


def visit(index: Index, anchors: DataFrame, same: bool, k: int, home: bool) -> DataFrame:
    """Hits of anchors (``row, label, vec, leaf, low, high``) in their own leaves, or in all others that may hold any."""
    tree, blocks, dim, top = index.tree, index.blocks, index.dim, index.tree.top
    chunk_rows = max(1, BLOCK_VALUES // dim)
    chunks = max(1, -(-anchors.count() // chunk_rows))

    def targets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lows, highs = (batch.column(c).to_pylist() for c in ("low", "high"))
            own = batch.column("leaf").to_numpy()
            if home:
                a, leaf = np.arange(len(own)), own
            else:
                wide = max(map(len, lows), default=0)
                low, high = np.full((len(own), wide), FAR), np.full((len(own), wide), -FAR)
                for i, (x, y) in enumerate(zip(lows, highs)):
                    low[i, : len(x)], high[i, : len(y)] = x, y
                a, leaf = tree.to_visit(vectors(batch.column("vec"), dim), low, high)
                a, leaf = a[leaf != own[a]], leaf[leaf != own[a]]
            many = blocks[leaf]
            a, leaf = np.repeat(a, many), np.repeat(leaf, many)
            block = np.arange(len(a)) - np.repeat(np.cumsum(many) - many, many)
            step = max(1, BLOCK_VALUES // 8 // dim)
            for at in range(0, len(a), step):
                part = batch.take(pa.array(a[at : at + step]))
                columns = [part.column(c) for c in ("row", "label", "vec", "low", "high")]
                cell = [pa.array(v[at : at + step].astype(np.int32)) for v in (leaf, block)]
                yield pa.RecordBatch.from_arrays([*columns, *cell], names=["row", "label", "vec", "low", "high", "leaf", "block"])

    sent = anchors.select("row", "label", "vec", "leaf", "low", "high").mapInArrow(
        targets, "row bigint, label bigint, vec array<int>, low array<bigint>, high array<bigint>, leaf int, block int")
    sent = sent.withColumn("chunk", F.pmod(F.xxhash64("row"), F.lit(chunks)))
    many = F.get(F.lit(blocks.tolist()), F.col("leaf"))
    held = index.rows.select("row", "id", "label", "vec", "leaf", F.pmod(F.xxhash64("row"), many).cast("int").alias("block"))
    held = held.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(chunks - 1).cast("bigint"))))

    def score(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        return best_in(anchors, rows, same, k, dim, top) if anchors.num_rows and rows.num_rows else nothing

    nothing = pa.table({"anchor": pa.array([], pa.int64()), "win": pa.array([], pa.int32()), "other": pa.array([], pa.int64()),
                        "other_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})
    cell = ["leaf", "block", "chunk"]
    return materialize(sent.groupBy(cell).cogroup(held.groupBy(cell)).applyInArrow(score, HIT))


def first_k(hits: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("anchor", "win").orderBy(F.col("score").desc(), F.col("other_id").asc_nulls_last(), "other")
    return hits.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= k)


def search(index: Index, anchors: DataFrame, same: bool, k: int) -> DataFrame:
    """``anchor, win, other, other_id, score, place``: the first ``k`` rows of the same or of other labels in each score window ``low .. high`` of each anchor.

    An anchor's own leaf is searched first; a window that is full by then needs only leaves that may hold a better row.
    """
    near = visit(index, anchors, same, k, home=True)
    full = first_k(near, k).groupBy("anchor", "win").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).filter(F.col("n") == k)
    lifted = full.groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("win", "least"))).alias("least"))
    both = anchors.join(lifted, anchors["row"] == lifted["anchor"], "left")
    raised = F.transform("low", lambda lo, i: F.greatest(lo, F.coalesce(F.try_element_at(F.col("least"), i), lo)))
    left = materialize(both.withColumn("low", raised).drop("least", "anchor"))
    return materialize(first_k(near.unionByName(visit(index, left, same, k, home=False)), k))


def mine_negatives(rows: DataFrame, anchors: Column, positives: int = 5, negatives: int = 5, least: int = 80) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` of rows ``id, label, vec`` (whole numbers), of which ``anchors`` picks the queries.

    For each anchor and each of its ``positives`` best other rows of the same label: the first ``negatives`` rows of other labels that score at most as much as the positive and at
    least ``least`` hundredths of it; higher scores first, then smaller ids, NULL ids last. Rows without label or vector take no part; shorter vectors count as filled up with zeros.
    Repeated rows are rows of their own, also as anchors. An empty table, an anchor without positives and a positive below zero give no rows. Other columns are not looked at.
    """
    marked = rows.withColumn("asks", F.coalesce(anchors, F.lit(False)))
    kept = marked.select("id", "label", "vec", "asks").filter(F.col("label").isNotNull() & F.col("vec").isNotNull())
    kept = materialize(kept.withColumn("row", F.monotonically_increasing_id()))
    index = build_index(kept)
    asks = index.rows.join(kept.filter("asks").select("row", F.col("id").alias("anchor_id")), "row")
    asks = materialize(asks.select("row", "anchor_id", "label", "vec", "leaf", F.array(F.lit(-FAR)).alias("low"), F.array(F.lit(FAR)).alias("high")))
    best = search(index, asks, True, positives).select("anchor", F.col("other_id").alias("positive_id"), F.col("score").alias("positive_score"))
    best = materialize(best.filter(F.col("positive_score") >= 0))
    windows = best.groupBy("anchor").agg(F.sort_array(F.collect_set("positive_score")).alias("high"))  # at most ``positives`` of them
    windows = windows.withColumn("low", F.expr(f"transform(high, s -> (s * {int(least)} + 99) div 100)"))
    asks = materialize(asks.drop("low", "high").join(windows, asks["row"] == windows["anchor"]).drop("anchor"))
    found = search(index, asks, False, negatives)
    owners = asks.select("row", "anchor_id", F.posexplode("high").alias("win", "positive_score"))
    pairs = best.join(owners, (best["anchor"] == owners["row"]) & (best["positive_score"] == owners["positive_score"])).select(
        "anchor", "win", "anchor_id", "positive_id", best["positive_score"])
    return pairs.join(found, ["anchor", "win"]).select(
        "anchor_id", "positive_id", F.col("place").alias("rank"), F.col("other_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def whole_numbers(vector: Column, scale: int = 256) -> Column:
    """``floor(scale * x)`` of the components, within ``LARGEST``; NULL for a NULL vector or one with a NULL or non-finite component."""
    good = F.forall(vector, lambda x: F.coalesce(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    part = lambda x: F.greatest(F.lit(-float(LARGEST)), F.least(F.lit(float(LARGEST)), F.lit(float(scale)) * x.cast("double")))
    return F.when(good, F.transform(vector, lambda x: F.floor(part(x)).cast("int")))


def op13_hard_negatives(spark, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector among all vectors."""
    e = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).cast("bigint")
    rows = e.select(F.col("vec_id").alias("id"), label.alias("label"), whole_numbers(F.col("embedding")).alias("vec"))
    return mine_negatives(rows, F.col("id") % 100 == 0)


OP13_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score
  FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) AS r FROM s WHERE same) WHERE r <= 5)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM (
  SELECT p.anchor_id, positive_id, other_id AS negative_id, positive_score, score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score) WHERE rank <= 5
"""
