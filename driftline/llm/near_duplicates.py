"""Near-duplicate documents by bottom-k sketches.

One hash function maps every five-word shingle to a number; a document's sketch is the ``k`` smallest of its numbers. Inverted lists of retained values
generate overlaps, the sketch of two documents' union estimates their similarity and drops what is far below the threshold, and the full
shingle sets decide what is left.

* Documents with equal sets are one representative from the start, so a group of copies of any size is one row.
* A similar pair shares about three quarters of its union sketch, so each sketch is ordered by how rare its values are and only the rare part
  that a pair with ``LEAST_OVERLAP`` of the sketch in common cannot avoid is put into lists. Values everyone has (a common line, a licence) hardly make lists.
* In a list, all members are compared with a few hubs first. Those that prove similar are connected; pairs inside a component need no comparison any
  more. Of documents whose lists still hold several components, the full sets go through the same lists, where length and position bound the overlap
  exactly and not by an estimate: a copy with too many words of its own meets nobody. So a group of near copies costs about its size, and no link between components is lost.
"""

from __future__ import annotations

import hashlib
import sys

import numpy as np
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .common import components, table, without_ids
from .texts import map_texts

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WIDTH = 5
SKETCH = 64
# Share of the union's sketch that must agree. A pair at 0.75 has 0.75 of it in common with a standard error of 0.054: 4.6 errors lower.
LEAST_OVERLAP = 0.5
# Share of one document's sketch that the other's must hold. It is 0.857 for sets of equal size at 0.75, but only 0.75 where one set contains the other,
# with a standard error of 0.054: 4.6 errors lower.
LEAST_SHARED = 0.5
PERCENT = 75
BROADCAST_IDS = 1_000_000  # longs; more ids than that are joined by a shuffle
_MIX = np.uint64(0x9E3779B97F4A7C15)


class _Words(dict):
    """Hash of each word, filled as words turn up."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingle_hashes(texts: list[str], known: dict, width: int = WIDTH) -> list[np.ndarray]:
    """Sorted distinct 63-bit shingle hashes of each text; fewer than ``width`` words make one shingle, no words none."""
    words = [t.encode("utf-8", "replace").lower().split() for t in texts]  # bytes: A-Z and ASCII white space only
    ends = np.cumsum([len(w) for w in words])
    flat = np.fromiter((known[w] for doc in words for w in doc), dtype=np.uint64, count=int(ends[-1]) if len(ends) else 0)
    whole = np.full(max(0, len(flat) - width + 1), width, dtype=np.uint64)
    for j in range(width):
        whole = _mixed(whole, flat[j : len(flat) - width + 1 + j]) if len(whole) else whole
    out = []
    for end, doc in zip(ends, words):
        if len(doc) >= width:
            out.append(np.unique(whole[end - len(doc) : end - width + 1]))
        elif doc:
            one = np.array([len(doc)], dtype=np.uint64)
            for j in range(len(doc)):
                one = _mixed(one, flat[end - len(doc) + j])
            out.append(one)
        else:
            out.append(np.empty(0, dtype=np.uint64))
    return [(x >> np.uint64(1)).astype(np.int64) if len(x) < 2 else np.unique((x >> np.uint64(1)).astype(np.int64)) for x in out]


def _mixed(h: np.ndarray, w) -> np.ndarray:
    h = (h ^ w) * _MIX
    return (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)


def sketches(docs: DataFrame, k: int = SKETCH) -> DataFrame:
    """``doc_id, n_shingles, set_key, sketch`` per row; ``set_key`` digests the whole set."""
    known = _Words()

    def made(texts: list[str]) -> dict:
        sets = shingle_hashes(texts, known)
        return {
            "n_shingles": [len(s) for s in sets],
            "set_key": [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets],
            "sketch": [s[:k] for s in sets],
        }

    return map_texts(docs, made, "n_shingles bigint, set_key binary, sketch array<bigint>")


def _rare_lists(nodes: DataFrame, values: str, least: float) -> DataFrame:
    """``value, doc_id, n, common, pos``: the rare part of each array, only values that several arrays hold.

    A pair that shares ``least`` of an array shares one of its rarest values down to that share, whose positions in order of rarity count from 1.
    ``common`` counts the document's values that others hold too.
    """
    posts = nodes.select("doc_id", "n", F.size(values).alias("size"), F.explode(values).alias("value"))
    often = posts.groupBy("value").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    per_doc = Window.partitionBy("doc_id", "n", "size")
    ranked = posts.join(often, "value").withColumns(
        {"common": F.count(F.lit(1)).over(per_doc), "rank": F.row_number().over(per_doc.orderBy("df", "value"))}
    )
    # values that only this array holds come first in its order
    pos = F.col("size") - F.col("common") + F.col("rank")
    kept = ranked.withColumn("pos", pos).filter(F.col("pos") <= F.col("size") - F.ceil(F.col("size") * least - 1e-9) + 1)
    return materialize(kept.select("value", "doc_id", "n", "common", "pos"))


def _hub_pairs(lists: DataFrame, hubs: list) -> DataFrame:
    """Each list's members with its hubs."""
    chosen = lists.groupBy("value").agg(F.array_distinct(F.array(*hubs)).alias("hubs"))
    met = lists.select("value", "doc_id").join(chosen, "value").select("doc_id", F.explode("hubs").alias("hub"))
    return met.filter("doc_id <> hub").select(F.least("doc_id", "hub").alias("a"), F.greatest("doc_id", "hub").alias("b")).distinct()


def _mixed_lists(lists: DataFrame, comps: DataFrame) -> DataFrame:
    """Members of lists that hold several components, with their component."""
    named = lists.join(comps.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    several = named.groupBy("value").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("value")
    return materialize(named.join(several, "value", "left_semi"))


def _apart(pairs: DataFrame, comps: DataFrame) -> DataFrame:
    """Pairs whose documents are in different components."""
    label = lambda c: comps.select(F.col("node").alias(c), F.col("component").alias(f"c_{c}"))
    both = pairs.join(label("a"), "a", "left").join(label("b"), "b", "left")
    return both.filter(F.coalesce("c_a", "a") != F.coalesce("c_b", "b")).select("a", "b")


def _full_sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``doc_id, set``: all shingle hashes of the documents in ``ids``."""
    ids = materialize(ids.distinct())
    known = _Words()
    texts = docs.select("doc_id", "text").join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id")
    return materialize(map_texts(texts, lambda t: {"set": shingle_hashes(t, known)}, "set array<bigint>"))


def _similar(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` whose full sets are similar enough."""
    met = pairs.join(sets.withColumnsRenamed({"doc_id": "a", "set": "set_a"}), "a").join(sets.withColumnsRenamed({"doc_id": "b", "set": "set_b"}), "b")
    shared = F.size(F.array_intersect("set_a", "set_b"))
    return materialize(met.filter(100 * shared >= percent * (F.size("set_a") + F.size("set_b") - shared)).select("a", "b").distinct())


def _verified(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` that are similar enough: size, then union sketch, then full sets."""
    side = lambda c: nodes.select(F.col("doc_id").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"s_{c}"))
    sized = pairs.join(side("a"), "a").join(side("b"), "b").filter(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    union = F.slice(F.sort_array(F.array_union("s_a", "s_b")), 1, SKETCH)
    agree = F.size(F.array_intersect(F.array_intersect("s_a", "s_b"), union))
    likely = materialize(sized.filter(agree >= F.size(union) * LEAST_OVERLAP).select("a", "b").distinct())
    ids = likely.select(F.col("a").alias("doc_id")).unionByName(likely.select(F.col("b").alias("doc_id")))
    return _similar(likely, _full_sets(docs, ids), percent)


def _links_between(docs: DataFrame, lists: DataFrame, percent: int) -> DataFrame:
    """All links between different components of the documents in ``lists`` (with ``component``), through lists of their full sets."""
    named = lists.select("doc_id", "component").distinct()
    sets = _full_sets(docs, named.select("doc_id"))
    sized = sets.withColumn("n", F.size("set").cast("long"))
    posts = _rare_lists(sized, "set", percent / 100).join(named, "doc_id")
    a, b = (posts.select("value", *[F.col(c).alias(f"{t}_{c}") for c in ("doc_id", "n", "pos", "component")]) for t in "ab")
    need = F.ceil(F.lit(percent) * (F.col("a_n") + F.col("b_n")) / F.lit(100 + percent) - 1e-9)
    room = 1 + F.least(F.col("a_n") - F.col("a_pos"), F.col("b_n") - F.col("b_pos"))
    met = a.join(b, "value").filter((F.col("a_doc_id") < F.col("b_doc_id")) & (F.col("a_component") != F.col("b_component")) & (room >= need))
    met = met.filter(100 * F.least("a_n", "b_n") >= percent * F.greatest("a_n", "b_n"))
    return _similar(materialize(met.select(F.col("a_doc_id").alias("a"), F.col("b_doc_id").alias("b")).distinct()), sets, percent)


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs`` (``doc_id``, ``text``; others are left aside).

    Documents whose sets have ``percent`` of their union in common are linked; ``component_id`` is the smallest id that links reach. NULL, empty and
    blank texts have no shingle and are linked with nothing. A row with NULL id has a NULL component and is kept. Rows that share an id count as one document.
    """
    rows = materialize(sketches(docs.select("doc_id", "text")))
    sets = rows.filter(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    reps = sets.groupBy("set_key").agg(F.min("doc_id").alias("rep"))
    nodes = materialize(
        sets.join(reps.withColumnsRenamed({"set_key": "k"}), (F.col("set_key") == F.col("k")) & (F.col("doc_id") == F.col("rep")))
        .select("doc_id", F.col("n_shingles").alias("n"), "sketch").distinct()
    )
    lists = _rare_lists(nodes, "sketch", LEAST_SHARED)
    by_hash = lambda seed: F.min_by("doc_id", F.xxhash64("doc_id", F.lit(seed)))
    links = _verified(docs, nodes, _hub_pairs(lists, [F.max_by("doc_id", "common"), F.min("doc_id"), by_hash(0)]), percent)
    comps = materialize(components(links))
    lists = _mixed_lists(lists, comps)
    again = _apart(_hub_pairs(lists, [by_hash(s) for s in range(1, 5)]), comps)
    links = links.unionByName(_verified(docs, nodes, again, percent))
    comps = materialize(components(links))
    lists = _mixed_lists(lists.drop("component"), comps)
    links = links.unionByName(_links_between(docs, lists, percent))
    # equal sets, and an id whose rows hold several sets, are links as well
    same = sets.join(reps, "set_key").filter("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    comps = components(links.unionByName(same))
    named = rows.join(comps, rows["doc_id"] == comps["node"], "left").withColumn("component_id", F.coalesce("component", "doc_id"))
    return named.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one document of each component, that of the smallest id."""
    return without_ids(docs, near_duplicates(docs, percent).filter("NOT kept").select("doc_id"))


def op3_near_duplicates(spark, sf_dir: str) -> DataFrame:
    """Components of near duplicates, one row per document."""
    return near_duplicates(table(spark, sf_dir, "documents"))


OP3_SQL = r"""
WITH RECURSIVE
w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
t AS (SELECT doc_id, len(s) AS n, unnest(s) AS sh FROM s),
df AS (SELECT sh, count(*) AS c FROM t GROUP BY sh),
pre AS (
  SELECT doc_id, n, sh FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY c, sh) AS p FROM t JOIN df USING (sh)) WHERE p <= n - ceil(n * 0.75) + 1),
cand AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM pre a JOIN pre b ON a.sh = b.sh AND a.doc_id < b.doc_id AND 4 * least(a.n, b.n) >= 3 * greatest(a.n, b.n)),
link AS (
  SELECT a, b FROM cand JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b
  WHERE 100 * len(list_intersect(x.s, y.s)) >= 75 * (len(x.s) + len(y.s) - len(list_intersect(x.s, y.s)))),
ends AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach(a, b) AS (SELECT a, b FROM ends UNION SELECT r.a, e.b FROM reach r JOIN ends e ON r.b = e.a),
low AS (SELECT a AS doc_id, min(b) AS m FROM reach GROUP BY a)
SELECT s.doc_id, len(s) AS n_shingles, least(s.doc_id, coalesce(m, s.doc_id)) AS component_id, s.doc_id = least(s.doc_id, coalesce(m, s.doc_id)) AS kept
FROM s LEFT JOIN low ON low.doc_id = s.doc_id
"""
