"""Line deduplication by an exact set-similarity join, in Spark SQL functions.

A line is the set of its lower-cased words. Tokens are ordered by rarity: how often they occur in the corpus is counted in a table of fixed size (the
count of a token's hash bucket), the hash breaks ties, so every line sorts its tokens the same way without a join. Two lines that are similar enough must share
a token of their prefixes; the length filter, the positional filter and a parity bitmap of the tokens thin out the pairs a shared prefix token proposes, and the words of
what is left decide. Of similar lines the later ones, by document id and line number, are removed; a line without words
is never one of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import SPACE, table

SIMILARITY = 0.85
BUCKETS = 1 << 20
SINGLE = 4  # rarity level of a bucket that holds one token of the whole corpus
BROADCAST_LINES = 1_000_000  # line numbers of documents to look at again; more than that are joined by a shuffle


def line_words(line: Column) -> Column:
    """Lower-cased words of a line. A line whose only white space is the blank, as nearly all are, is cut without a regular expression."""
    low = F.lower(line)
    other = F.lit(False)
    for space in "\t\n\x0b\x0c\r":
        other = other | F.contains(line, F.lit(space))
    return F.array_remove(F.when(other, F.split(low, SPACE)).otherwise(F.split(low, " ")), "")


def rarity_table(docs: DataFrame) -> DataFrame:
    """One row, one array: for each bucket of token hashes the logarithm of its count, in quarter steps, as a byte; ``SINGLE`` for one token."""
    lines = docs.select(F.explode(F.split("text", "\n")).alias("line"))
    tokens = lines.select(F.explode(line_words(F.col("line"))).alias("w")).select(F.xxhash64("w").bitwiseAND(F.lit(BUCKETS - 1)).alias("bucket"))
    counts = tokens.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    every = docs.sparkSession.range(BUCKETS).select(F.col("id").alias("bucket"), F.lit(0).cast("long").alias("n"))
    full = counts.unionByName(every).groupBy("bucket").agg(F.sum("n").alias("n"))
    level = F.least(F.lit(127), F.floor(4 * F.log2(F.col("n") + 1))).cast("long")
    packed = full.agg(F.sort_array(F.collect_list(F.shiftleft("bucket", 8).bitwiseOR(level))).alias("p"))
    return packed.select(F.expr("transform(p, x -> cast(x & 255 AS tinyint))").alias("rarity"))


def line_sets(docs: DataFrame, rarity: DataFrame, similarity: float) -> DataFrame:
    """``doc_id, line_no, n, k1, k2, parity, skip, prefix`` of every line with a word; ``k1, k2`` digest the token set.

    Tokens that occur once in the corpus come first in a prefix and meet nothing: ``skip`` counts them and ``prefix`` holds the others, as hashes of 32 bits.
    Two tokens of one hash only propose a pair more: similar lines still meet by the first token they share, with its right positions.
    A line so short that only an equal one is similar enough (one word more would already be too much) has no prefix: equal sets meet by ``k1, k2``.
    """
    # A subquery may not stand in a lambda; as a column that is used once it is folded into one, so that no row carries the array.
    level = F.col("__level")
    lines = docs.filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    lines = lines.withColumn("__level", rarity.scalar())
    # the level above, 48 of the hash's bits below; the hash is taken once
    hashes = F.array_distinct(F.transform(line_words(F.col("line")), lambda w: F.xxhash64(w)))
    coded = lambda h: F.shiftleft(F.get(level, h.bitwiseAND(F.lit(BUCKETS - 1)).cast("int")).cast("long"), 48).bitwiseOR(F.shiftrightunsigned(h, 16))
    step = lines.select("doc_id", "line_no", F.sort_array(F.transform(hashes, coded)).alias("t"))
    n = F.size("t")
    prefix = F.slice("t", 1, F.when(n >= (n + 1) * similarity - 1e-9, n - F.ceil(n * similarity - 1e-9) + 1).otherwise(0).cast("int"))
    found = F.struct(
        n.alias("n"),
        F.xxhash64("t").alias("k1"),
        F.xxhash64(F.lit(1), "t").alias("k2"),
        F.expr("aggregate(t, 0L, (a, x) -> a ^ shiftleft(1L, cast(x & 63 AS int)))").alias("parity"),
        prefix.alias("prefix"),
    )
    out = step.select("doc_id", "line_no", F.inline(F.when(n > 0, F.array(found))))
    met = F.filter("prefix", lambda x: F.shiftright(x, 48) > SINGLE)
    short = F.transform(met, lambda x: F.hash(x))
    return out.withColumn("met", short).select("doc_id", "line_no", "n", "k1", "k2", "parity", (F.size("prefix") - F.size("met")).alias("skip"), F.col("met").alias("prefix"))


def _posts(lines: DataFrame, tag: str) -> DataFrame:
    """Prefix tokens of lines with their positions; columns but the token carry ``tag``."""
    out = lines.select("doc_id", "line_no", "n", "parity", "skip", F.posexplode("prefix").alias("pos", "token")).withColumn("pos", F.col("pos") + F.col("skip")).drop("skip")
    return out.withColumnsRenamed({c: f"{tag}_{c}" for c in out.columns if c != "token"})


def _possible(similarity: float) -> Column:
    """Order, length, positional and bitmap filters of an earlier line ``e`` and a later one ``l`` that share a prefix token."""
    need = F.ceil(F.lit(similarity) / (1 + similarity) * (F.col("e_n") + F.col("l_n")) - 1e-9)
    room = 1 + F.least(F.col("e_n") - F.col("e_pos"), F.col("l_n") - F.col("l_pos")) - 1
    before = (F.col("e_doc_id") < F.col("l_doc_id")) | ((F.col("e_doc_id") == F.col("l_doc_id")) & (F.col("e_line_no") < F.col("l_line_no")))
    return (
        before
        & (F.least("e_n", "l_n") >= similarity * F.greatest("e_n", "l_n") - 1e-9)
        & (room >= need)
        & (F.bit_count(F.col("e_parity").bitwiseXOR(F.col("l_parity"))) <= F.col("e_n") + F.col("l_n") - 2 * need)
    )


def _wanted_lines(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``doc_id, line_no, w``: the distinct words of the lines whose numbers ``wanted`` lists by document."""
    met = docs.select("doc_id", "text").join(wanted, "doc_id").withColumn("lines", F.split("text", "\n"))
    there = F.filter("nos", lambda i: i < F.size("lines"))
    cut = F.transform(there, lambda i: F.struct(i.alias("line_no"), F.get("lines", i).alias("line")))
    # "lines" stands in two lambdas, which keeps it a column of its own instead of a text split anew for each number
    return met.select("doc_id", F.inline(cut)).select("doc_id", "line_no", F.array_distinct(line_words(F.col("line"))).alias("w"))


def _similar(docs: DataFrame, pairs: DataFrame, similarity: float) -> DataFrame:
    """``doc_id, line_no`` of the later lines of those pairs whose words are similar enough."""
    pairs = materialize(pairs.select("e_doc_id", "e_line_no", "l_doc_id", "l_line_no").distinct())
    ends = [pairs.select(F.col(f"{t}_doc_id").alias("doc_id"), F.col(f"{t}_line_no").alias("line_no")) for t in "el"]
    ends = ends[0].unionByName(ends[1]).distinct()
    wanted = materialize(ends.groupBy("doc_id").agg(F.collect_list("line_no").alias("nos")))
    few = wanted.agg(F.sum(F.size("nos"))).first()[0] or 0
    few = few <= BROADCAST_LINES
    held = materialize(_wanted_lines(docs, F.broadcast(wanted) if few else wanted))
    side = lambda t: held.withColumnsRenamed({"doc_id": f"{t}_doc_id", "line_no": f"{t}_line_no", "w": f"{t}_w"})
    met = pairs.join(side("e"), ["e_doc_id", "e_line_no"]).join(side("l"), ["l_doc_id", "l_line_no"])
    shared = F.size(F.array_intersect("e_w", "l_w"))
    good = shared >= similarity * (F.size("e_w") + F.size("l_w") - shared) - 1e-9
    return materialize(met.filter(good).select(F.col("l_doc_id").alias("doc_id"), F.col("l_line_no").alias("line_no")).distinct())


def repeated_lines(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``doc_id, line_no`` of every line that is similar to an earlier one.

    Lines with one token set are one line from the start. In each list of a prefix token the earliest line is compared with all others
    first; a line found similar is settled and looks for no further match, though later lines may still match it. So a group of variants costs about its size.
    """
    docs = docs.select("doc_id", "text")
    lines = materialize(line_sets(docs, materialize(rarity_table(docs)), similarity))
    first = F.min(F.struct("doc_id", "line_no", "n", "parity", "skip", "prefix")).alias("f")
    reps = materialize(lines.groupBy("k1", "k2").agg(first, F.count(F.lit(1)).alias("c")).select("k1", "k2", "c", "f.*"))
    # sets of several lines only; written, so that the planner sees how few they are
    firsts = materialize(reps.filter("c > 1").select("k1", "k2", F.col("doc_id").alias("fd"), F.col("line_no").alias("fl")))
    is_first = (F.col("doc_id") == F.col("fd")) & (F.col("line_no") == F.col("fl"))
    copies = lines.select("doc_id", "line_no", "k1", "k2").join(firsts, ["k1", "k2"]).filter(~is_first).select("doc_id", "line_no")
    later = _posts(reps, "l")
    member = F.struct(*[f"l_{c}" for c in ("doc_id", "line_no", "n", "parity", "pos")])
    hubs = later.groupBy("token").agg(F.min(member).alias("h"), F.count(F.lit(1)).alias("df")).filter("df > 1")
    hubs = hubs.select("token", *[F.col(f"h.l_{c}").alias(f"e_{c}") for c in ("doc_id", "line_no", "n", "parity", "pos")])
    settled = _similar(docs, later.join(hubs, "token").filter(_possible(similarity)), similarity)
    opened = reps.join(settled, ["doc_id", "line_no"], "left_anti")
    more = _similar(docs, _posts(reps, "e").join(_posts(opened, "l"), "token").filter(_possible(similarity)), similarity)
    return copies.unionByName(settled).unionByName(more).distinct()


def dedup_lines(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with ``text`` without its repeated lines, and ``removed``, the numbers of those lines from 0 in order.

    A text of which every line repeats becomes empty. A NULL id or text is left as it is; in rows that share an id, a line number goes in all or none.
    Columns ``docs`` has besides stay; a column named ``removed`` is replaced.
    """
    gone = materialize(repeated_lines(docs, similarity).groupBy(F.col("doc_id").alias("id")).agg(F.sort_array(F.collect_list("line_no")).alias("gone")))
    size = gone.agg(F.count(F.lit(1)), F.sum(F.size("gone"))).first()
    docs = docs.drop("removed")
    # the document is one column here, so no name of its columns meets one of the steps
    both = docs.select(F.struct(*docs.columns).alias("doc")).join(F.broadcast(gone) if size[0] + (size[1] or 0) <= BROADCAST_LINES else gone, F.col("doc.doc_id") == F.col("id"), "left")
    both = both.withColumn("lines", F.when(F.col("gone").isNotNull(), F.split("doc.text", "\n")))
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "gone")
    text = F.when(F.col("gone").isNull(), F.col("doc.text")).otherwise(F.array_join(F.transform(left, lambda i: F.get("lines", i)), "\n"))
    own = [text.alias("text") if c == "text" else F.col("doc")[c].alias(c) for c in docs.columns]
    return both.select(*own, F.coalesce("gone", F.expr("cast(array() AS array<int>)")).alias("removed"))


def op10_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Per document its lines, the numbers of the removed ones and the code points that stay."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = dedup_lines(docs.withColumn("n_lines", (F.length(F.coalesce("text", F.lit(""))) - F.length(F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(""))) + 1).cast("long")))
    return done.select("doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"), F.array_join(F.col("removed").cast("array<string>"), ",").alias("removed_lines"),
                       F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("kept_chars"))


OP10_SQL = r"""
WITH split AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
lines AS (SELECT doc_id, i - 1 AS line_no, ls[i] AS line FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM split)),
sets AS (
  SELECT doc_id, line_no, list_sort(list_distinct(list_filter(regexp_split_to_array(lower(line), '[\x20\x09-\x0D]+'), lambda x: x <> ''))) AS w FROM lines),
big AS (SELECT * FROM sets WHERE len(w) > 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY w ORDER BY doc_id, line_no) AS r FROM big),
reps AS (SELECT row_number() OVER (ORDER BY doc_id, line_no) AS id, doc_id, line_no, w, len(w) AS n FROM ranked WHERE r = 1),
tok AS (SELECT id, n, unnest(w) AS t FROM reps),
df AS (SELECT t, count(*) AS c FROM tok GROUP BY t),
pre AS (
  SELECT id, n, t FROM (SELECT id, n, t, row_number() OVER (PARTITION BY id ORDER BY c, t) AS p FROM tok JOIN df USING (t))
  WHERE p <= n - ceil(n * 0.85 - 1e-9) + 1),
cand AS (SELECT DISTINCT a.id AS e, b.id AS l FROM pre a JOIN pre b ON a.t = b.t AND a.id < b.id AND least(a.n, b.n) >= 0.85 * greatest(a.n, b.n) - 1e-9),
near AS (
  SELECT DISTINCT y.doc_id, y.line_no FROM cand JOIN reps x ON x.id = e JOIN reps y ON y.id = l
  WHERE len(list_intersect(x.w, y.w)) >= 0.85 * (x.n + y.n - len(list_intersect(x.w, y.w))) - 1e-9),
gone AS (SELECT doc_id, line_no FROM ranked WHERE r > 1 UNION SELECT doc_id, line_no FROM near),
kept AS (SELECT l.doc_id, sum(length(line)) + count(*) - 1 AS chars FROM lines l ANTI JOIN gone g ON g.doc_id = l.doc_id AND g.line_no = l.line_no GROUP BY l.doc_id),
per AS (SELECT doc_id, count(*) AS n, string_agg(CAST(line_no AS VARCHAR), ',' ORDER BY line_no) AS removed FROM gone GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(len(string_split(d.text, chr(10))), 1) AS BIGINT) AS n_lines, coalesce(per.n, 0) AS n_removed, coalesce(removed, '') AS removed_lines,
  CAST(coalesce(chars, 0) AS BIGINT) AS kept_chars
FROM documents d LEFT JOIN per ON per.doc_id = d.doc_id LEFT JOIN kept ON kept.doc_id = d.doc_id
"""
