"""Line-first quality rules: judge every line, remove those that fail, then reject documents that lose too much.

Built from Spark SQL functions only; a document never leaves its row, so there is no shuffle at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, table, words_of

SYMBOLS = r"[#*$%&|<>]"
WORD = r"[^\x20\x09-\x0D]"
# Phrases of licence, account and navigation lines.
BOILERPLATE = [
    "all rights reserved", "licensed under", "apache license", "terms of use", "terms of service", "privacy policy",
    "cookie policy", "uses cookies", "accept cookies", "enable javascript", "click here", "sign in to", "log in to",
    "subscribe to our", "copyright (c)", "back to top", "skip to content", "spdx-license-identifier",
]
SEPARATORS = 3  # a line with so many | or » between words is a menu or a table row
SYMBOL_SHARE = 0.05  # symbols per code point of a line's words
SHOUTS = 0.5  # words of a line that end in two exclamation or question marks
DISTINCT_SHARE = 0.3  # distinct words of a line of at least REPEAT_WORDS words
REPEAT_WORDS = 10
BOILERPLATE_WORDS = 20  # a longer line that holds one of the phrases is prose about it
HEADING_WORDS = 4  # a line of so few words without closing punctuation is a heading or a button
LOST_SHARE = 0.5  # a document whose failed lines hold more of its words' code points goes


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def line_fails(line: Column, words: Column) -> Column:
    """True for a line that breaks one of the punctuation, navigation or boilerplate rules; a line without words never does."""
    n = F.size(words)
    chars = F.greatest(F.length(F.array_join(words, "")), F.lit(1))
    phrases = "(?i)" + "|".join(p.replace("(", r"\(").replace(")", r"\)") for p in BOILERPLATE)
    return (n > 0) & (
        (_count(line, r"[|»›]") >= SEPARATORS)
        | (_count(line, SYMBOLS) > chars * SYMBOL_SHARE)
        | (_count(line, r"[!?]{2,}(?=[\x20\x09-\x0D]|$)") > n * SHOUTS)
        | ((n >= REPEAT_WORDS) & (F.size(F.array_distinct(words)) < n * DISTINCT_SHARE))
        | ((n <= BOILERPLATE_WORDS) & line.rlike(phrases))
        | ((n <= HEADING_WORDS) & ~line.rlike(r"[.!?…:;\"'”’»)\]][\x20\x09-\x0D]*$"))
    )


def quality_rules(docs: DataFrame, lost_share: float = LOST_SHARE, with_row: bool = False) -> DataFrame:
    """Counts, the verdict and the text without failed lines, one row per row of ``docs`` (``doc_id``, ``text``; others are left aside).

    ``with_row`` adds the whole input row as a struct, ``row``.

    NULL and empty texts have no words and fail the base rule (fewer than 50 words). Equal rows get equal results. ``n_repeat_words`` counts
    the words inside three-word windows whose words occur as a window again: windows are hashed, the hash and the window's position share one
    number, and sorting those puts equal windows side by side, so a text of n words costs n log n whatever repeats in it.
    """
    text = F.coalesce("text", F.lit(""))
    row = [F.struct(*docs.columns).alias("row")] if with_row else []
    step = docs.select("doc_id", *row, text.alias("text"), F.split(text, "\n").alias("lines"), words_of(F.col("text")).alias("w"))
    step = step.withColumns({
        "n": F.size("w"),
        "lined": F.filter("lines", lambda x: x.rlike(WORD)),
        "line_words": F.transform("lines", lambda x: F.array_remove(F.split(x, SPACE), "")),
    })
    step = step.withColumn("bits", F.length(F.bin("n")))
    step = step.withColumn(
        "windows",
        F.sort_array(F.expr("""CASE WHEN n < 3 THEN cast(array() AS array<bigint>) ELSE transform(sequence(0, n - 3),
            i -> shiftleft(xxhash64(get(w, i), get(w, i + 1), get(w, i + 2)), bits) | cast(i AS bigint)) END""")),
    )
    # windows whose shortened hashes meet, by a second hash; where that meets too, the words decide
    step = step.withColumn(
        "met",
        F.sort_array(F.expr("""transform(transform(filter(windows, (x, j) ->
            shiftright(x, bits) = shiftright(get(windows, j - 1), bits) OR shiftright(x, bits) = shiftright(get(windows, j + 1), bits)),
            x -> cast(x & (shiftleft(1L, bits) - 1) AS int)),
            i -> named_struct('h', xxhash64(1L, get(w, i), get(w, i + 1), get(w, i + 2)), 'i', i))""")),
    )
    same = "(x.h = {y}.h AND get(w, x.i) = get(w, {y}.i) AND get(w, x.i + 1) = get(w, {y}.i + 1) AND get(w, x.i + 2) = get(w, {y}.i + 2))"
    before, after = (same.replace("{y}", f"get(met, j {d} 1)") for d in "-+")
    step = step.withColumn("again", F.sort_array(F.expr(f"transform(filter(met, (x, j) -> {before} OR {after}), x -> cast(x.i AS bigint))")))
    step = step.withColumns({
        "n_repeat_words": F.expr("""aggregate(transform(again, (p, j) -> least(3L, coalesce(get(again, j + 1) - p, 3L))), 0L, (a, x) -> a + x)"""),
        "judged": F.transform("lines", lambda x, j: F.struct(x.alias("line"), line_fails(x, F.get("line_words", j)).alias("fails"))),
    })
    step = step.withColumn("clean_lines", F.expr("transform(filter(judged, x -> NOT x.fails), x -> x.line)"))
    word_chars = F.length(F.array_join("w", "")).cast("long")
    left = F.length(F.array_join(words_of(F.array_join("clean_lines", "\n")), "")).cast("long")
    n = F.col("n").cast("long")
    base_failed = (n < 50) | (100 * F.col("n_repeat_words") > 50 * n)
    found = F.struct(
        n.alias("n_words"),
        word_chars.alias("word_chars"),
        _count(F.col("text"), SYMBOLS).cast("long").alias("n_symbols"),
        (F.size("lined") - F.size(F.array_distinct("lined"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        (F.size("lines") - F.size("clean_lines")).cast("long").alias("n_failed_lines"),
        (word_chars - left).alias("lost_chars"),
        F.array_join("clean_lines", "\n").alias("clean_text"),
        base_failed.alias("base_failed"),
        (~base_failed & (word_chars - left <= F.lit(lost_share) * word_chars)).alias("kept"),
    )
    # inline() keeps a later filter on a verdict from being pushed into the steps above, where it would copy whole arrays into lambdas
    return step.select("doc_id", *(["row"] if with_row else []), F.inline(F.array(found)))


def keep_clean(docs: DataFrame, lost_share: float = LOST_SHARE) -> DataFrame:
    """The rows of ``docs`` that pass, all columns, with the failed lines gone from ``text`` and ``n_chars``, where there is one, counted anew."""
    passed = quality_rules(docs, lost_share, with_row=True).filter("kept")
    return passed.select(*[_cleaned(c, docs.schema[c].dataType) for c in docs.columns])


def _cleaned(column: str, kind) -> Column:
    clean = {"text": F.col("clean_text"), "n_chars": F.length("clean_text").cast(kind)}
    return clean.get(column, F.col("row").getField(column)).alias(column)


def op8_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Counts, base verdict and verdict of every document."""
    return quality_rules(table(spark, sf_dir, "documents")).drop("clean_text")


_WORDS = r"list_filter(regexp_split_to_array({}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_PHRASES = "|".join(p.replace("(", r"\(").replace(")", r"\)") for p in BOILERPLATE)
OP8_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, {_WORDS.format("t")} AS w, string_split(t, chr(10)) AS ls FROM d),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS c FROM p),
again AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM g, (VALUES (0), (1), (2)) v(o) WHERE c > 1 GROUP BY doc_id),
l AS (SELECT doc_id, ls[k] AS line FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS k FROM w)),
lw AS (SELECT *, {_WORDS.format("line")} AS w FROM l),
lc AS (SELECT *, len(w) AS n, len(array_to_string(w, '')) AS chars FROM lw),
f AS (
  SELECT *, n > 0 AND (len(regexp_extract_all(line, '[|»›]')) >= 3 OR len(regexp_extract_all(line, '[#*$%&|<>]')) > 0.05 * greatest(chars, 1)
    OR len(list_filter(w, lambda x: regexp_matches(x, '[!?]{{2,}}$'))) > 0.5 * n OR (n >= 10 AND len(list_distinct(w)) < 0.3 * n)
    OR (n <= 20 AND regexp_matches(line, '(?i){_PHRASES}')) OR (n <= 4 AND NOT regexp_matches(line, '[.!?…:;"''”’»)\]][\x20\x09-\x0D]*$'))) AS fails FROM lc),
per AS (SELECT doc_id, count(*) FILTER (n > 0) - count(DISTINCT line) FILTER (n > 0) AS dup, count(*) FILTER (fails) AS failed,
  coalesce(sum(chars) FILTER (fails), 0) AS lost FROM f GROUP BY doc_id),
c AS (
  SELECT w.doc_id, len(w) AS n_words, len(array_to_string(w, '')) AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, dup AS n_dup_lines,
    coalesce(again.n, 0) AS n_repeat_words, failed AS n_failed_lines, CAST(lost AS BIGINT) AS lost_chars FROM w JOIN per USING (doc_id) LEFT JOIN again USING (doc_id))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND lost_chars <= 0.5 * word_chars AS kept FROM c
"""
