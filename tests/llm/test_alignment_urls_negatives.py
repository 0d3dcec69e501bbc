"""Cross-tokenizer alignment, URL filters and hard negatives against brute force, SQL and odd inputs."""

import hashlib
import os

import duckdb
import numpy as np
import pandas as pd
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from driftline.llm import hard_negatives, token_alignment, url_filters

ROOT = "/root/testdata"
SMALL = f"{ROOT}/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(ROOT), reason="no test tables")


# --- alignment ---------------------------------------------------------------------------------

TEXTS = ["", None, "a b", "<|endoftext|> x <s></s> <0x0A>", "it's 'll we'd  x\n\ny \n z", "a　b ▁c", "日本語 テキスト 12３ ²x", "x" * 4000 + " y", " lead", "trail ", "é 𝒳 \x00",
         "plain words, again and again " * 40]


def brute_tokens(texts):
    """Ids and bytes of both sides, by the tokenizers themselves on whole texts."""
    paths = [token_alignment.place(n, None) for n in (token_alignment.TOKENIZER_A, token_alignment.TOKENIZER_B)]
    a = Tokenizer.from_file(paths[0])
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=paths[1])
    spelled = token_alignment.bytes_of_a(paths[0]), token_alignment.bytes_of_b(paths[1])
    out = []
    for t in texts:
        ids = (a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)) if t else ([], [])
        parts = [[s[i] for i in side] for s, side in zip(spelled, ids)]
        whole = t and all(b"".join(p) == b" " + t.encode() for p in parts)
        out.append((ids, parts) if whole else (([], []), ([], [])))
    return out


def brute_alignment(texts):
    counts, rows = {}, []
    for (a, b), parts in brute_tokens(texts):
        ends = [np.cumsum([len(x) for x in p]).tolist() for p in parts]
        starts = [[0, *e[:-1]] for e in ends]
        links = [(x, y) for i, x in enumerate(a) for j, y in enumerate(b) if starts[0][i] < ends[1][j] and starts[1][j] < ends[0][i]] if len(a) < 2000 else None
        if links is None:  # a long text, by a walk along both sides
            links, j = [], 0
            for i, x in enumerate(a):
                while ends[1][j] <= starts[0][i]:
                    j += 1
                k = j
                while k < len(b) and starts[1][k] < ends[0][i]:
                    links.append((x, b[k]))
                    k += 1
        groups, at = [], [0, 0]
        for end in sorted(set(ends[0]) & set(ends[1])):
            upto = [e.index(end) + 1 for e in ends]
            groups.append((a[at[0] : upto[0]], b[at[1] : upto[1]]))
            at = upto
        for link in links:
            counts[link] = counts.get(link, 0) + 1
        rows.append((a, b, groups, links))
    best = {}
    for (_, y), n in counts.items():
        best[y] = max(best.get(y, 0), n)
    out = []
    for a, b, groups, links in rows:
        text = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        out.append((len(a), len(b), len(groups), len(links), sum(counts[link] == best[link[1]] for link in links), sum(counts[link] for link in links),
                    hashlib.sha256(text.encode()).hexdigest() if text else ""))
    return out


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("heavy", [1 << 18, 5])
def test_alignment_against_brute_force(spark, heavy):
    texts = TEXTS + [TEXTS[-1]]
    rows = [(i if i < len(texts) - 1 else i - 1, t, "x", 1) for i, t in enumerate(texts)] + [(None, "a b", "x", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, row string, n_a int").repartition(3)
    got = sorted(tuple(r[c] for c in ["doc_id", *COLUMNS]) if r["doc_id"] is not None else (99, *[r[c] for c in COLUMNS]) for r in token_alignment.align_tokens(df, heavy=heavy).collect())
    want = sorted((99 if r[0] is None else r[0], *w) for r, w in zip(rows, brute_alignment([r[1] for r in rows])))
    assert got == want
    assert token_alignment.align_tokens(df.limit(0)).count() == 0


@needs_tables
def test_alignment_of_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    rows = [(r[0], r[1]) for r in docs.collect()]
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in token_alignment.op11_token_alignment(spark, SMALL).collect()}
    assert got == {i: w for (i, _), w in zip(rows, brute_alignment([t for _, t in rows]))}


def test_pointer_jumping():
    rng = np.random.default_rng(3)
    for _ in range(50):
        n = int(rng.integers(1, 200))
        ends = [np.unique(np.append(rng.integers(1, n + 1, int(rng.integers(1, n + 1))), n)) for _ in range(2)]
        a, b = token_alignment.terminals(*ends)
        common = np.intersect1d(*ends)
        for last, side in zip((a, b), ends):
            assert (ends[1][last] == common[np.searchsorted(common, side)]).all()


def test_groups_of_tokens(spark):
    df = spark.createDataFrame([(1, "tokenizers differ unbelievably"), (2, None)], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in token_alignment.groups_of(token_alignment.encode_both(df)).collect()}
    assert rows[2]["a_groups"] == [] and len(rows[1]["a_groups"]) == len(rows[1]["a_ids"]) and len(rows[1]["b_groups"]) == len(rows[1]["b_ids"])
    assert rows[1]["a_groups"][0] == 0 and rows[1]["a_groups"][-1] == rows[1]["b_groups"][-1] and rows[1]["a_groups"] == sorted(rows[1]["a_groups"])


def test_few_cached_words(spark, monkeypatch):
    """Words beyond the cache are forgotten after a batch; results stay."""
    both = token_alignment.TwoTokenizers(*[token_alignment.place(n, None) for n in (token_alignment.TOKENIZER_A, token_alignment.TOKENIZER_B)])
    texts = [f"word{i} and other{i * 7} words, {i}" for i in range(60)]
    want = brute_tokens(texts)
    monkeypatch.setattr(token_alignment, "CACHED_WORDS", 20)
    for at in range(0, 60, 10):
        sides = both.ids(texts[at : at + 10])
        for side, (ids, ends) in enumerate(sides):
            assert [x.tolist() for x in np.split(ids, ends[:-1])] == [w[0][side] for w in want[at : at + 10]]
    assert len(both.known) <= 60


# --- URL filters -------------------------------------------------------------------------------

PAGES = [
    (1, "http://a.net/x", '<link rel="canonical" href="http://b.net/y">'), (2, "http://b.net/y", None),
    (3, "http://c.net/z/q", "<META content='0; URL=../w' http-equiv=refresh><!-- <link rel=canonical href='http://example.org/en/x'> -->"),
    (4, "https://c.net/w", '<link href=//example.org/es/1 rel="nofollow canonical">'), (5, None, ""), (6, "nohost", None), (7, "http://d.net", "<script><link rel=canonical href=http://x.com/de/></script>"),
    (8, "http://www.b.net/y?utm_source=q&ref=z", ""), (9, "http://e.net/p", "<link rel=canonical href=http://x.com/de/1>"), (10, "http://f.net/", "<link rel=canonical href=http://e.net/p>"),
    (11, "http://f.net/?page=2&ref=x", "<link rel=canonical href=http://g.org/k>"), (12, "http://F.net/?page=2#q", None), (9, "http://e.net/p", None), (None, "HTTP://WWW.Example.ORG/es/", "x"),
    (13, "http://badexample.org/es/1", None), (14, "ftp://u.com?x/fr/", None), (15, "http://k.net/1", "<link rel='canonical' href='#top'><link rel=canonical href='mailto:x@y.com'>"),
    (16, "http://v.com/fr/1", "<link rel=canonical href=http://v.com/de/1>"), (17, "http://both.net/1", "<link rel=canonical href=http://v.com/de/1>"),
]


def pages(spark, rows=PAGES):
    extra = ", component string, node string, alias_of_url string, tag string"
    return spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], "page_id long, url string, html string" + extra)


def test_redirect_equivalence(spark):
    redirects = spark.createDataFrame([("http://h.net/1", "http://b.net/y"), ("http://a.net/x", "http://z.com/de/5"), (None, "http://q.net"), ("x", None)], "a string, b string")
    judged = url_filters.judge_urls(pages(spark), url_filters.RULES, redirects)
    assert judged.columns[:7] == ["page_id", "url", "html", "component", "node", "alias_of_url", "tag"] and judged.count() == len(PAGES)
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in judged.collect()}
    blocked = {1, 2, 3, 4, 8, 9, 10}
    assert {k for k, v in got.items() if v[1] == "block" and v[0] is None} == blocked
    assert got[None] == ("example.org/es/", "block") and got[13] == ("org/", "allow")
    assert got[16] == ("com/fr/", "allow") and got[17] == (None, "allow")  # an allowed alias comes before a blocked one
    assert got[5] == got[6] == got[14] == (None, "allow")
    assert url_filters.judge_urls(pages(spark).limit(0)).count() == 0
    assert url_filters.judge_urls(pages(spark).drop("html"), []).filter("verdict = 'block'").count() == 0


def test_long_chain_of_redirects(spark):
    chain = spark.createDataFrame([(f"http://h{i}.net/", f"http://h{i + 1}.net/") for i in range(60)] + [("http://h60.net/", "http://x.com/de/")], "a string, b string")
    rows = spark.createDataFrame([(i, f"http://h{i}.net/") for i in range(0, 61, 20)], "page_id long, url string")
    assert {r["verdict"] for r in url_filters.judge_urls(rows, redirects=chain).collect()} == {"block"}


def test_urls_against_sql(spark):
    """All but relative links, which the SQL leaves out."""
    rows = [r for r in PAGES if r[0] != 3]
    got = url_filters.judge_urls(pages(spark, rows)).select("page_id", "host", "path", "rule", "verdict").collect()
    con = duckdb.connect()
    frame = pd.DataFrame(rows, columns=["page_id", "url", "html"])  # noqa: F841
    con.execute("CREATE TABLE pages AS SELECT CAST(page_id AS BIGINT) AS page_id, url, html FROM frame")
    assert sorted(map(tuple, got), key=str) == sorted(con.execute(url_filters.OP12_SQL).fetchall(), key=str)


def test_links_are_resolved(spark):
    cases = [("http://a.net/x/y?q", "z", "http://a.net/x/z"), ("http://a.net/x/y", "../../z/./k?p=..", "http://a.net/z/k?p=.."), ("http://a.net", "z", "http://a.net/z"),
             ("http://a.net/x/y", "?k", "http://a.net/x/y?k"), ("http://a.net/x", "javascript:go()", None), ("http://a.net/x", "/w/..", "http://a.net/"), ("http://a.net/x", "HTTPS://B.net/", "HTTPS://B.net/")]
    df = spark.createDataFrame(cases, "url string, link string, want string")
    for r in df.withColumn("got", url_filters.resolved(F.col("link"), F.col("url"))).collect():
        assert r["got"] == r["want"], r


# --- hard negatives ----------------------------------------------------------------------------


def brute_negatives(rows, asks, positives=5, negatives=5, least=80):
    rows = [(i, label, np.array(v, object)) for i, label, v in rows if label is not None and v is not None]
    wide = max((len(v) for _, _, v in rows), default=0)
    rows = [(i, label, np.append(v, [0] * (wide - len(v)))) for i, label, v in rows]
    order = lambda s: (-s[0], s[1] is None, s[1] or 0, s[2])
    out = []
    for at, (i, label, v) in enumerate(rows):
        if not asks(i):
            continue
        scored = [(int((v * w).sum()), j, k, other) for k, (j, other, w) in enumerate(rows) if k != at]
        for score, j, _, _ in sorted([s for s in scored if s[3] == label], key=order)[:positives]:
            hits = sorted([s for s in scored if s[3] != label and least * score <= 100 * s[0] <= 100 * score], key=order)[:negatives]
            out += [(i, j, n + 1, h[1], score, h[0]) for n, h in enumerate(hits)]
    return sorted(out, key=str)


def clustered(seed, n, dim, spread=40):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 100, (12, dim))
    return [(i, int(rng.integers(4)), [int(x) for x in centres[rng.integers(12)] + rng.normal(0, spread, dim)]) for i in range(n)]


@pytest.mark.parametrize("block", [1 << 21, 16 * 20])
def test_negatives_against_brute_force(spark, monkeypatch, block):
    """Recall is one: with leaves in one block and dealt in many, anchors in one chunk and in several."""
    monkeypatch.setattr(hard_negatives, "BLOCK_VALUES", block)
    rows = clustered(5, 700, 16) + [(1000 + i, i % 2, [7] * 16) for i in range(60)]  # one very common vector
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "id long, label long, vec array<int>, row string, leaf int").repartition(4)
    got = hard_negatives.mine_negatives(df, F.col("id") % 20 == 0)
    assert sorted(map(tuple, got.collect()), key=str) == brute_negatives(rows, lambda i: i % 20 == 0)


def test_tree_passes_subtrees_over(spark):
    rows = spark.createDataFrame(clustered(6, 3000, 8, 5), "id long, label long, vec array<int>").withColumn("row", F.col("id"))
    index = hard_negatives.build_index(rows)
    x = np.array([r["vec"] for r in rows.limit(50).collect()])
    top = (x * x).sum(axis=1)[:, None]
    anchors, _ = index.tree.to_visit(x, top * 98 // 100, top * 102 // 100)
    assert index.tree.leaves > 30 and len(anchors) < 0.4 * 50 * index.tree.leaves
    every, _ = index.tree.to_visit(x, top * 0 - (1 << 40), top * 0 + (1 << 40))
    held = index.rows.select("leaf").distinct().count()
    assert len(every) == 50 * held


def test_odd_vectors(spark):
    rows = [(0, 1, [1, 2]), (0, 1, [1, 2]), (None, 1, [3, 3]), (None, 2, [1, 2]), (2, 2, [1]), (3, 2, []), (4, None, [1, 1]), (5, 2, None), (6, 3, [0, 1, 5]), (20, 2, [-4, -4]), (40, 9, [1, 1])]
    df = spark.createDataFrame(rows, "id long, label long, vec array<int>").coalesce(1)
    got = sorted(map(tuple, hard_negatives.mine_negatives(df, F.col("id") % 20 == 0).collect()), key=str)
    assert got == brute_negatives(rows, lambda i: i is not None and i % 20 == 0)
    assert hard_negatives.mine_negatives(df.limit(0), F.col("id") % 20 == 0).count() == 0
    same = spark.createDataFrame([(i, i % 2, [3, 4]) for i in range(200)], "id long, label long, vec array<int>")
    assert hard_negatives.mine_negatives(same, F.col("id") == 0).count() == 25
    vectors = spark.createDataFrame([([0.5, -0.001],), ([float("nan"), 1.0],), ([None, 1.0],), (None,), ([float("inf")],), ([1e30, -1e30],), ([],)], "v array<float>")
    whole = [r[0] for r in vectors.select(hard_negatives.whole_numbers(F.col("v"))).collect()]
    assert whole == [[128, -1], None, None, None, None, [1 << 24, -(1 << 24)], []]
