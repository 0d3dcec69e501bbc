"""Text operators against plain versions, SQL, held-out labels and odd inputs."""

import os
import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from driftline.llm import decontamination, language, line_dedup, near_duplicates, packing, passages, private_data, quality_model, quality_rules, toxicity
from driftline.llm.common import components
from driftline.llm.queries import ORACLES, QUERIES

from . import plain

ROOT = "/root/testdata"
SMALL, HELD = f"{ROOT}/sf0.001", f"{ROOT}/sf0.01"
needs_tables = pytest.mark.skipif(not os.path.isdir(ROOT), reason="no test tables")


def texts_of(spark, folder):
    return [(r[0], r[1]) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


# --- odd inputs: NULL ids and texts, empty and very long texts, repeated rows, ties, clashing columns, no rows at all ---

LONG = " ".join(f"w{i % 4999}" for i in range(60_000))
PROSE = " ".join(f"word{i}" for i in range(80)) + "."
ODD = [(1, PROSE), (1, PROSE), (2, None), (None, PROSE), (3, ""), (4, " \n\t "), (5, LONG), (6, PROSE), (7, "a b"), (8, "For " * 300), (None, None), (9, PROSE.upper())]
CLASHES = ["n", "w", "row", "lines", "score", "group", "sketch", "component", "node", "removed", "seed", "words", "k1", "text_", "__id_", "__id", "__gone", "__lines", "id", "gone", "doc", "lang", "hub"]


def odd(spark, rows=ODD):
    schema = "doc_id long, text string, " + ", ".join(f"{c} string" for c in CLASHES)
    return spark.createDataFrame([(*r, *["x"] * len(CLASHES)) for r in rows], schema)


OPERATORS = {
    "quality_rules": lambda d: quality_rules.quality_rules(d),
    "keep_clean": lambda d: quality_rules.keep_clean(d),
    "trees": lambda d: quality_model.score_quality(d, quality_model.fit_quality(d, d.sparkSession.createDataFrame([(1, 1), (3, 0), (5, None)], "doc_id long, quality int"))),
    "private": lambda d: private_data.find_private(d, private_data.fit_private(d)),
    "near": lambda d: near_duplicates.near_duplicates(d),
    "drop_near": lambda d: near_duplicates.drop_near_duplicates(d),
    "packing": lambda d: packing.pack_documents(d),
    "toxicity": lambda d: toxicity.score_toxicity(d, toxicity.fit_toxicity(d, d.sparkSession.createDataFrame([(1, 1), (3, 0)], "doc_id long, toxic int"))),
    "language": lambda d: language.identify(d, language.fit_languages(d)),
    "passages": lambda d: passages.repeated_passages(d),
    "overlaps": lambda d: decontamination.overlaps(d, d.sparkSession.createDataFrame([(1, PROSE), (2, None), (None, "x"), (3, "")], "item_id long, text string")),
    "lines": lambda d: line_dedup.dedup_lines(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](odd(spark, [])).collect() == []


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(spark, name):
    got = [r.asDict() for r in OPERATORS[name](odd(spark)).collect()]
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    if name == "keep_clean":
        assert sorted(map(str, by)) == ["1", "6", "9", "None"] and len(by[1]) == 2 and by[1][0]["row"] == "x"
    elif name == "near":
        assert len(got) == len(ODD)
        assert {r["component_id"] for i in (1, 6, 9) for r in by[i]} == {1} and all(r["component_id"] is None and r["kept"] for r in by[None])
        assert by[3][0]["n_shingles"] == by[4][0]["n_shingles"] == by[2][0]["n_shingles"] == 0 and by[7][0]["n_shingles"] == 1
    elif name == "drop_near":
        assert sorted(map(str, by)) == ["1", "2", "3", "4", "5", "7", "8", "None"]
    elif name == "passages":
        assert {(r["doc_id"], r["source_id"], r["start"], r["end"], r["whole_copy"]) for r in got} == {(6, 1, 0, 80, True), (9, 1, 0, 80, True)}
    elif name == "overlaps":
        assert sorted((r["doc_id"], r["item_id"], r["score"]) for r in got) == [(1, 1, 80 - 8), (6, 1, 72), (9, 1, 72)] or sorted((r["doc_id"], r["item_id"]) for r in got) == [(1, 1), (6, 1), (9, 1)]
    elif name == "lines":
        assert len(got) == len(ODD) and by[6][0]["text"] == by[9][0]["text"] == "" and by[1][0]["text"] == PROSE and by[2][0]["text"] is None
        assert all(r["text"] in (PROSE, None) for r in by[None]) and by[1][0]["n"] == "x"
    elif name == "packing":
        assert {len(by[i]) for i in (2, 3, 4, 7)} == {1} and by[2][0]["length"] == 1 and len(by[1]) == 2
        assert sum(r["length"] for r in by[5]) > 60_000
    else:
        assert len(got) == len(ODD)
    if "score" in got[0] and name in ("trees", "toxicity", "language"):
        assert all(0 <= r["score"] <= 1 for r in got)
    if name == "language":
        assert {r["lang_pred"] for i in (2, 3, 4) for r in by[i]} == {"und"}


# --- rules, lines, decontamination ---


@needs_tables
def test_rules_equal_plain(spark):
    got = {r["doc_id"]: r for r in quality_rules.op8_quality_rules(spark, SMALL).collect()}
    for i, t in texts_of(spark, SMALL):
        assert tuple(got[i][c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) == plain.counts(t)


def test_rules_on_repeats(spark):
    random.seed(1)
    rows = [(i, " ".join(random.choices("abcde", k=random.randint(0, 120))).replace("a b", "a\nb")) for i in range(60)]
    got = {r["doc_id"]: r["n_repeat_words"] for r in quality_rules.quality_rules(frame(spark, rows)).collect()}
    assert got == {i: plain.counts(t)[4] for i, t in rows}


@needs_tables
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    df = QUERIES[name](spark, SMALL)
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    cur = con.execute(ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(cur.fetchall())
    assert sorted(tuple(r[c] for c in names) for r in df.collect()) == want and want


def test_similar_lines_equal_plain(spark):
    random.seed(2)
    base = [random.choices([f"t{i}" for i in range(400)], k=30) for _ in range(6)]
    rows = []
    for i in range(80):
        lines = []
        for _ in range(4):
            line = list(random.choice(base))
            for _ in range(random.randint(0, 5)):
                line[random.randrange(30)] = f"x{random.randint(0, 50)}"
            lines.append(" ".join(line))
        rows.append((i, "\n".join(lines)))
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(frame(spark, rows)).collect()}
    assert got == dict(plain.dedup_lines(rows))


def test_substituted_benchmark_passages(spark):
    random.seed(3)
    vocabulary = [f"w{i}" for i in range(5000)]
    item = random.choices(vocabulary, k=40)
    rows = []
    for i in range(30):
        body = random.choices(vocabulary, k=200)
        if i % 2:
            part = list(item)
            for at in range(6 + i % 5, 40, 9):
                part[at] = "other"
            body[50:50] = part
        rows.append((i, " ".join(body)))
    found = decontamination.overlaps(frame(spark, rows), spark.createDataFrame([(1, " ".join(item))], "item_id long, text string"))
    assert {r["doc_id"] for r in found.collect()} == {i for i, _ in rows if i % 2}
    shuffled = decontamination.overlaps(frame(spark, rows), spark.createDataFrame([(1, " ".join(item))], "item_id long, text string"), broadcast_seeds=0)
    assert {tuple(r) for r in shuffled.collect()} == {tuple(r) for r in found.collect()}


# --- near duplicates and passages ---


@needs_tables
def test_components_equal_plain(spark):
    docs = texts_of(spark, SMALL)
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates.op3_near_duplicates(spark, SMALL).collect()}
    assert got == plain.components(docs)


def test_group_of_near_copies(spark):
    random.seed(4)
    vocabulary = [f"w{i}" for i in range(3000)]
    base = random.choices(vocabulary, k=150)
    rows = [(1000, " ".join(base))]
    for i in range(120):
        copy = list(base)
        for _ in range(random.randint(0, 7)):
            copy[random.randrange(150)] = random.choice(vocabulary)
        rows.append((i, " ".join(copy)))
    rows += [(2000 + i, " ".join(random.choices(vocabulary, k=150))) for i in range(40)]
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates.near_duplicates(frame(spark, rows)).collect()}
    assert got == plain.components(rows)


def test_nested_sets_meet_in_a_list(spark):
    random.seed(9)
    rows = []
    for g in range(600):  # the longer set holds the shorter one: 0.75 to 0.78 of it
        words = [f"g{g}w{i}" for i in range(504)]
        random.shuffle(words)
        rows += [(2 * g, " ".join(words)), (2 * g + 1, " ".join(words[: 4 + 375 + g % 16]))]
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates.near_duplicates(frame(spark, rows)).collect()}
    assert got == {i: i - i % 2 for i, _ in rows}


def test_connected_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 60)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r["node"]: r["component"] for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


def test_fuzzy_passages(spark):
    random.seed(5)
    vocabulary = [f"w{i}" for i in range(3000)]
    parts = [random.choices(vocabulary, k=80) for _ in range(4)]
    rows, planted = [], {}
    for i in range(40):
        body = random.choices(vocabulary, k=random.randint(60, 200))
        if i % 2:
            p = list(parts[i % 4])
            for _ in range(4 if i > 8 else 0):
                p[random.randrange(80)] = random.choice(vocabulary)
            at = random.randrange(len(body))
            body[at:at] = p
            planted[i] = at
        rows.append((i, " ".join(body)))
    got = {r["doc_id"]: r for r in passages.repeated_passages(frame(spark, rows)).collect()}
    assert set(got) == {i for i in planted if i > 3}
    for i, r in got.items():
        assert abs(r["start"] - planted[i]) <= 8 and abs(r["end"] - planted[i] - 80) <= 8 and r["source_id"] == (1 if i % 4 == 1 else 3)


def test_quoted_sentences_do_not_hide_a_passage(spark):
    random.seed(6)
    vocabulary = [f"w{i}" for i in range(3000)]
    fill = lambda n: random.choices(vocabulary, k=n)
    rows, want = [], set()
    for g in range(20):
        passage = fill(60)
        for k in range(3):
            rows.append((10 * g + k, " ".join(fill(50) + passage[20 * k : 20 * k + 20] + fill(50))))
        for k in (3, 4):
            rows.append((10 * g + k, " ".join(fill(50) + passage + fill(50))))
        want.add((10 * g + 4, 10 * g + 3))
    assert {(r["doc_id"], r["source_id"]) for r in passages.repeated_passages(frame(spark, rows)).collect()} == want


def test_passages_of_lines_that_many_quote(spark):
    random.seed(7)
    vocabulary = [f"w{i}" for i in range(20000)]
    fill = lambda n: random.choices(vocabulary, k=n)
    lines = [fill(20) for _ in range(3)]
    rows = [(i, " ".join(fill(30) + lines[i % 3] + fill(30))) for i in range(240)]
    rows += [(i, " ".join(fill(30) + lines[0] + lines[1] + lines[2] + fill(30))) for i in (300, 301, 302)]
    assert {(r["doc_id"], r["source_id"]) for r in passages.repeated_passages(frame(spark, rows)).collect()} == {(301, 300), (302, 300)}


@pytest.mark.parametrize("identity", [0.8, 0.85, 0.9])
@pytest.mark.parametrize("even", [True, False])
def test_recall_of_fuzzy_passages(spark, identity, even):
    random.seed(8)
    vocabulary = [f"w{i}" for i in range(20000)]
    fill = lambda n: random.choices(vocabulary, k=n)
    rows, want = [], set()
    for g in range(60):
        p = fill(60 + g % 2 * 40)
        q, changed = list(p), round(len(p) * (1 - identity))
        for at in [int((j + 0.5) * len(p) / changed) for j in range(changed)] if even else random.sample(range(3, len(p) - 3), changed):
            q[at] = "other"
        assert passages.common_words(p, q) == len(p) - changed
        rows += [(2 * g, " ".join(fill(40) + p + fill(40))), (2 * g + 1, " ".join(fill(70) + q + fill(40)))]
        want.add((2 * g + 1, 2 * g))
    got = [r for r in passages.repeated_passages(frame(spark, rows)).collect()]
    assert {(r["doc_id"], r["source_id"]) for r in got} == want
    assert all(r["start"] < 95 and r["end"] - r["start"] >= 50 for r in got)


def test_chance_anchor_far_off_does_not_hide_a_passage():
    a = [f"a{i}" for i in range(200)]
    b = [f"b{i}" for i in range(200)]
    a[10:70] = b[20:80] = [f"p{i}" for i in range(60)]
    a[125:129] = b[130:134] = "w x y z".split()
    got = passages.align(a, b, [*range(10, 67), 125], [*range(20, 77), 130])
    assert (10, 70, 20, 80, 60) in got


def test_best_chain_of_anchors():
    x = np.array([0, 6, 12, 13, 20, 26], np.int32)
    y = np.array([50, 56, 62, 10, 70, 76], np.int32)
    assert passages.chain(x, y) == [([0, 6, 12, 20, 26], [50, 56, 62, 70, 76])]
    assert passages.common_words("a b c d".split(), "a x c d".split()) == 3


# --- packing ---


@needs_tables
def test_pieces_and_places(spark):
    import public_tokenizers

    rows = [tuple(r) for r in packing.op4_packing(spark, SMALL).collect()]
    docs = [*texts_of(spark, SMALL)]
    assert {r[:5] for r in rows} == plain.pieces(docs, Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")))
    by = {}
    for r in rows:
        by.setdefault(r[5], []).append((r[6], r[3]))
    for places in by.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 2048
    assert len(by) <= 1.01 * -(-sum(r[3] for r in rows) // 2048) + 1


def test_word_ids_equal_the_tokenizer():
    import public_tokenizers

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    known = packing.WordIds()
    for text in ["It's a dog's LIFE, isn't it?", "ÀÉÎ Straße ñandú 12,345 a1b2", "<|endoftext|> x<|endoftext|>", "日本 é   tab\tx\x0by", "a b 'll've |||!! #$%", "", "İI ſ ﬁ"]:
        assert known.ids(text) == b"".join(i.to_bytes(4, "little") for i in tokenizer.encode(text, add_special_tokens=False).ids)


@pytest.mark.parametrize("seed", range(6))
def test_bound_holds(seed):
    rng = np.random.default_rng(seed)
    lengths = np.sort(rng.integers(1, [200, 2048, 1100, 700, 1400, 2048][seed], 500))[::-1]
    where, offset, bins = packing.best_fit(lengths, 2048)
    fill = np.bincount(where, lengths)
    assert fill.max() <= 2048 and -(-lengths.sum() // 2048) <= packing.bins_needed(lengths, 2048) <= bins


def test_bound_sees_halves():
    assert packing.bins_needed(np.array([1100] * 10), 2048) == 10
    assert packing.bins_needed(np.array([700] * 9), 2048) == 5


def test_several_groups(spark):
    random.seed(6)
    rows = [(i, " ".join(random.choices(["dog", "cat", "house"], k=random.randint(1, 1500)))) for i in range(400)]
    made = packing.pack_documents(frame(spark, rows), group_rows=60).collect()
    assert len(made) == 400 and len({r["sequence_id"] for r in made}) <= -(-sum(r["length"] for r in made) // 2048) + 3


# --- personal data ---


def test_base_spans_equal_finditer():
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    ip = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    random.seed(7)
    for _ in range(4000):
        t = "".join(random.choices("ab1259.@-+ (\n", k=random.randint(0, 40)))
        want = [(0, m.start(), m.end()) for m in email.finditer(t)] + [(1, m.start(), m.end()) for m in ip.finditer(t) if all(int(p) <= 255 for p in m.group().split("."))]
        assert [s for s in private_data.base_spans(t) if s[0] < 2] == want


def test_base_checks():
    found = private_data.base_spans("é 4111 1111 1111 1111, +1 (504) 555-2652, 1.2.3.400 a@b.co 10.0.0.1.")
    assert sorted(found) == [(0, 52, 58), (1, 59, 67), (2, 2, 21), (3, 23, 40)]
    assert private_data.base_spans("9" * 200_000 + "@") == []


def test_likelihood_gradient():
    rng = np.random.default_rng(0)
    k = len(private_data.TAGS)
    scores, tags, trans, start = rng.normal(size=(2, 5, k)), rng.integers(0, k, (2, 5)), rng.normal(size=(k, k)), rng.normal(size=k)
    _, ds, dt, _ = private_data._crf(scores, tags, trans, start)
    for grad, array, at in ((ds, scores, (1, 2, 3)), (dt, trans, (2, 5))):
        moved = array.copy()
        moved[at] += 1e-5
        other = private_data._crf(moved if array is scores else scores, tags, moved if array is trans else trans, start)[0]
        assert abs((other - private_data._crf(scores, tags, trans, start)[0]) / 1e-5 - grad[at]) < 1e-3


def test_tagger_adds_rewritten_forms():
    random.seed(8)
    fill = lambda n: " ".join("".join(random.choices("abcdefghilmnorstu", k=random.randint(2, 9))) for _ in range(n))
    texts = [f"{fill(30)} joe{i}@mail{i}.example.com {fill(20)} +1 (50{i % 10}) 555-26{i % 10}2 {fill(20)} 10.2.{i}.4 {fill(9)} 4111 1111 1111 1111 {fill(9)}" for i in range(80)]
    tagger = private_data.fit_tagger(*private_data.training_windows(texts))
    odd_texts = [f"{fill(20)} {x} {fill(20)}" for x in ("(504) 555-2652", "joe at mail dot com", "4111.1111.1111.1111")]
    base, added = private_data.all_spans(odd_texts + [fill(200)], tagger)
    assert base == [[]] * 4 and sum(bool(a) for a in added[:3]) >= 2 and added[3] == []
    long = private_data.all_spans(["12 " * 3000 + texts[0]], tagger)[0][0]
    assert len(long) == 4


# --- models ---


@needs_tables
def test_quality_held_out(spark):
    truth = {r[0]: r[1] for r in spark.read.parquet(f"{HELD}/labels.parquet").select("doc_id", "quality").collect()}
    rows = [r for r in quality_model.op1_quality_model(spark, HELD).collect() if r["held_out"] and r["doc_id"] in truth]
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in rows]) > 0.97


@needs_tables
def test_toxicity_held_out(spark):
    truth = {r[0]: r[1] for r in spark.read.parquet(f"{HELD}/labels.parquet").select("doc_id", "toxic").collect()}
    rows = [r for r in toxicity.op5_toxicity(spark, HELD).collect() if r["held_out"] and r["doc_id"] in truth]
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in rows]) > 0.93


@needs_tables
def test_language_held_out(spark):
    truth = {r[0]: r[1] for r in spark.read.parquet(f"{HELD}/documents.parquet").select("doc_id", "lang").collect()}
    rows = [r for r in language.op6_language(spark, HELD).collect() if r["held_out"]]
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in rows]) > 0.98


def test_context_probabilities_add_up():
    symbols = language.symbol_map([b"the cat sat on the mat"])
    rows, bits = language.grow([b"the cat sat on the mat", b"a hat"], symbols)
    assert np.allclose(np.exp2(-bits.astype(float)).sum(1), 1, atol=1e-4) and rows.max() < len(bits)


def test_trees_learn_an_interaction():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 3))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    trees = quality_model.fit_trees(x[:1500], y[:1500])
    assert np.mean((trees.scores(x[1500:]) > 0.5) == y[1500:]) > 0.9


def test_nnpu_finds_hidden_positives():
    rng = np.random.default_rng(2)
    hidden = rng.random(3000) < 0.2
    draw = lambda bad: sorted({*(rng.integers(2, 30, 6)), *([int(rng.integers(0, 2))] if bad else [])})
    held = [draw(True) for _ in range(400)] + [draw(b) for b in hidden]
    bias, w = toxicity.fit_nnpu(held, np.arange(3400) < 400, 30, 0.2)
    called = np.array([bias + w[h].sum() > 0 for h in held[400:]])
    assert np.mean(called == hidden) > 0.97


# --- pipeline ---


@needs_tables
def test_pipeline_equals_plain(spark):
    import public_tokenizers

    docs = plain.keep_clean(texts_of(spark, SMALL), quality_rules.BOILERPLATE)
    docs = plain.dedup_lines(docs)
    top = plain.components(docs)
    docs = [(i, t) for i, t in docs if top[i] == i]
    items = [r[0] for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").select("text").collect()]
    docs = [(i, t) for i, t in docs if not any(plain.overlap(t, x) for x in items)]
    got = corpus_pipeline.run(spark, SMALL).collect()
    assert {(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got} == plain.pieces(docs, Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")))


@needs_tables
def test_stages_keep_columns(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SMALL).schema.simpleString() == docs.schema.simpleString()


def test_seeds_in_packed_lists(spark, monkeypatch):
    """Rows are made of repeated seeds only, at ten bytes a seed in the lists; frequent ones come back whole from lists of their own."""
    monkeypatch.setattr(passages, "OFTEN", 20)
    monkeypatch.setattr(passages, "SEEDS_AT_ONCE", 3000)
    rng = np.random.default_rng(8)
    texts = [" ".join(f"w{i}" for i in rng.integers(0, 9 if k % 10 == 0 else 4000, 300)) for k in range(80)]
    texts += ["all of one line " * 30, texts[3], "short", ""]
    docs = frame(spark, [(1000 - 7 * k, t) for k, t in enumerate(texts)])
    lists = passages._seed_lists(docs.repartition(3), 5).collect()
    h, p, _, _ = passages.minimizers(texts, passages._Words())
    assert sum(len(r.h) + len(r.x) for r in lists if r.bucket >= 0) == 8 * sum(len(np.frombuffer(r.x, np.uint16)) for r in lists if r.bucket >= 0)
    assert sum(len(r.x) // 2 for r in lists) == sum(map(len, h)) and any(r.bucket < 0 for r in lists) and any(r.often for r in lists)
    want = {}
    for k, (hs, xs) in enumerate(zip(h, p)):
        for seed, x in zip(hs.view(np.uint64).tolist(), xs.tolist()):
            want.setdefault((seed >> 16, (seed & 0xFFFF) * 5 >> 16), []).append((1000 - 7 * k, x))
    got = spark.createDataFrame(lists, passages._seed_lists(docs, 5).schema).groupBy("bucket").applyInArrow(
        passages._repeated, "doc_id bigint, seed bigint, x int, source_id bigint, n bigint, ys array<int>, often boolean").collect()
    found, far = {}, set()
    for r in got:
        key = ((r.seed % 2**64) >> 16, r.seed & 0xFFFF)
        found.setdefault(key, []).append((r.doc_id, r.x))
        if r.often:
            far.add(key)
            continue
        first = min(want[key])[0]
        assert (r.source_id, r.n) == (first, len(want[key]))
        assert r.ys == ([] if r.doc_id == first else [x for d, x in sorted(want[key]) if d == first])
    assert far and all(sorted(v) == sorted(want[k]) for k, v in found.items())
    assert {k for k, v in want.items() if len({d for d, _ in v}) > 1} <= set(found)
    assert all(len({d for d, _ in want[k]}) > 1 for k in set(found) - far)


def test_common_words_of_long_lists():
    rng = np.random.default_rng(9)
    for n, m in ((0, 5), (70, 90), (200, 60)):
        a, b = (rng.integers(0, 12, k).astype(str).tolist() for k in (n, m))
        row = [0] * (m + 1)
        for x in a:
            last = 0
            for j, z in enumerate(b, 1):
                last, row[j] = row[j], last + 1 if x == z else max(row[j], row[j - 1])
        assert passages.common_words(a, b) == row[-1]


def test_texts_travel_once_for_many_chains(spark):
    from pyspark.sql import functions as F

    rows = [(1000 + i, 1 if i < 1300 else 2 + i % 7, [3, 9 + 8000 * (i % 10 == 0)], [5, 11], 0, 0) for i in range(1500)]
    chains = spark.createDataFrame(rows, "doc_id bigint, source_id bigint, xs array<int>, ys array<int>, a_lo int, b_lo int").repartition(3)
    texts = spark.createDataFrame([(i, f"text {i}") for i in range(1, 9)], "__doc bigint, __text string")
    got = passages._packed(chains, chains, "source_id", texts).withColumn("n", F.size("rows")).collect()
    assert sorted((r["doc_id"], r["source_id"]) for g in got for r in g["rows"]) == sorted(r[:2] for r in rows)
    assert all(g["__text"] == f"text {r['source_id']}" for g in got for r in g["rows"])
    assert len(got) < 200 and max(g["n"] for g in got) <= passages.CHAINS_AT_ONCE
    assert all(g["n"] <= 8 for g in got if g["rows"][0]["xs"][-1] > 8000)


def test_documents_end_where_tables_end():
    ids = [1, 1, 1, 2, 2, 3, 3, 3, 3, 3, 4, 5, 5]
    batches = [pa.RecordBatch.from_pydict({"doc_id": ids[i : i + 2]}) for i in range(0, len(ids), 2)]
    tables = [t.column("doc_id").to_pylist() for t in passages._whole_documents(iter(batches))]
    assert sum(tables, []) == ids
    assert all(a[-1] != b[0] for a, b in zip(tables, tables[1:]))


def test_first_chain_is_the_best():
    """Against values by definition, in time that grows with the square."""
    r = random.Random(5)
    for _ in range(300):
        x, y = ([r.randrange(40) for _ in range(20)] for _ in range(2))
        top = {}
        for i in sorted(range(20), key=lambda i: (x[i], -y[i])):
            top[i] = 400 + max([0, *(v - 3 * (x[i] + y[i] - x[j] - y[j]) for j, v in top.items() if x[j] < x[i] and y[j] < y[i])])
        if max(top.values()) > 400:
            xs, ys = passages.chain(np.array(x), np.array(y))[0]
            assert 400 * len(xs) - 3 * (xs[-1] - xs[0] + ys[-1] - ys[0]) == max(top.values())


def test_prefixes_are_short_hashes(spark, monkeypatch):
    """Prefix tokens take four bytes; tokens that share a hash cost no pair and make none."""
    rnd = random.Random(11)
    rows = []
    for i in range(60):
        words = [f"w{rnd.randrange(200)}" for _ in range(24)]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join([*words[:-1], f"x{i}"]))]
    docs = frame(spark, rows)
    lines = line_dedup.line_sets(docs, line_dedup.rarity_table(docs), 0.85)
    assert lines.schema["prefix"].dataType.simpleString() == "array<int>"
    want = sorted(tuple(r) for r in line_dedup.repeated_lines(docs).collect())
    sets = [(d, set(t.split())) for d, t in rows]
    assert want == sorted((d, 0) for i, (d, w) in enumerate(sets) if any(len(w & v) >= 0.85 * len(w | v) - 1e-9 for _, v in sets[:i]))
    few = line_dedup.line_sets
    crowded = lambda *a: few(*a).withColumn("prefix", line_dedup.F.transform("prefix", lambda x: x % 7))
    monkeypatch.setattr(line_dedup, "line_sets", crowded)
    assert sorted(tuple(r) for r in line_dedup.repeated_lines(docs).collect()) == want


def test_chains_without_equal_words_around_are_not_aligned(spark):
    """Of the chains on one diagonal only those from which a passage can come go on to alignment; whatever alignment finds, the codes let pass."""
    rng = np.random.default_rng(11)
    words, rows, chains = [f"w{i}" for i in range(40)], [], []
    for i in range(300):
        a = rng.choice(words, 130).tolist()
        b = [w if rng.random() > (0.15, 0.25, 1.0)[i % 3] else str(rng.choice(words)) for w in a]
        b[60:66] = a[60:66]
        shift = int(rng.integers(0, 60))
        rows += [(2 * i, " ".join(a)), (2 * i + 1, " ".join([*rng.choice(words, shift).tolist(), *b]).upper())]
        chains.append((2 * i, 2 * i + 1, [60, 61, 62], [60 + shift, 61 + shift, 62 + shift], shift))
    chains.append((0, 1, [60, 62], [61, 64], None))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    table = spark.createDataFrame(chains, "doc_id long, source_id long, xs array<int>, ys array<int>, shift int")
    kept = {(r["doc_id"], tuple(r["xs"])) for r in passages._worth_aligning(table, passages._word_codes(docs), 50, 0.75).collect()}
    text = {d: t.lower().split() for d, t in rows}
    good = set()
    for d, s, xs, ys, _ in chains:
        a0, b0 = max(xs[0] - passages.FLANK, 0), max(ys[0] - passages.FLANK, 0)
        a, b = text[d][a0 : xs[-1] + passages.K + passages.FLANK], text[s][b0 : ys[-1] + passages.K + passages.FLANK]
        if any(e - s >= 50 and m >= 0.75 * max(e - s, f - t) for s, e, t, f, m in passages.align(a, b, [v - a0 for v in xs], [v - b0 for v in ys])):
            good.add((d, tuple(xs)))
    assert len(good) > 60 and good <= kept and (0, (60, 62)) in kept
    assert not [d for d, _ in kept if d // 2 % 3 == 2]


def test_word_codes():
    texts = ["", "a b", "  a\tb\x0bc\n", "éa\xa0x y", "b", "xxx xxx", "ab ba " * 9]
    n, codes = passages._coded(pa.array(["zz", *texts]).slice(1))
    assert n.tolist() == [len(passages.WORD.findall(t)) for t in texts]
    known = {}
    for t, packed in zip(texts, codes):
        assert len(packed) == -(-len(passages.WORD.findall(t)) // 4) + passages.FLANK_BYTES
        for w, code in zip(passages.WORD.findall(t), [b >> k & 3 for b in packed for k in (0, 2, 4, 6)]):
            assert known.setdefault(w, code) == code


def test_chains_of_many_pairs_at_once():
    rng = np.random.default_rng(5)
    rows, want = [], set()
    for pair in range(600):
        k, span = int(rng.integers(1, 12)), int(rng.choice([6, 30, 300]))
        places = {(int(a), int(b)) for a, b in zip(rng.integers(0, span, k), rng.integers(0, span, k))}
        if pair % 2:
            x, y = (np.sort(rng.choice(500, k, replace=False)).tolist() for _ in "xy")
            places = set(zip(x, y if pair % 4 == 1 else [v + 7 for v in x]))
        rows += [(pair // 3, pair, *at) for at in places]
        x, y = (np.array(v) for v in zip(*places))
        want |= {(pair, tuple(a), tuple(b)) for a, b in passages.chain(x, y)}
    batch = pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64() if i < 2 else pa.int32()) for i in range(4)], names=["doc_id", "source_id", "x", "y"])
    got = [r for b in passages._chained(iter([batch.slice(i, 100) for i in range(0, len(rows), 100)])) for r in b.to_pylist()]
    assert {(r["source_id"], tuple(r["xs"]), tuple(r["ys"])) for r in got} == want and len(got) == len(want)
    for r in got:
        by = {b - a for a, b in zip(r["xs"], r["ys"])}
        assert r["shift"] == (by.pop() if len(by) == 1 else None)


def test_written_tables_go_when_done(spark):
    from driftline.session import free, materialize

    table = materialize(spark.range(5))
    folder = table.inputFiles()[0].rpartition("/")[0].removeprefix("file:").replace("///", "/")
    assert os.path.isdir(folder)
    free(spark, table)
    assert not os.path.exists(folder)
