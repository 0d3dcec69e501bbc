"""Alignment of two tokenizations of the same bytes by pointer jumping.

Both tokenizers cut a text's bytes into tokens. Every token points to the farthest-right token of the other side that overlaps it; the one that ends
where its partner ends points to itself. Doubling all pointers of a batch at once, ``next = next[next]``, leads each token to the terminal one of its
group after a number of rounds that grows with the logarithm of the longest group, so groups are the stretches between byte offsets at which tokens of both sides end.

How often two ids overlap is counted over the whole corpus. The counts go back to the documents in two ways that together cover every link: the most frequent id
pairs, at most ``heavy`` of them, travel to the tasks; the others are joined by a shuffle. None of those can be a hot key, since a pair outside the ``heavy`` most
frequent ones holds at most one ``heavy``-th of all links.
"""

from __future__ import annotations

import hashlib
import json
import re
import os
import sys
import types
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import table
from .texts import small_batches

cloudpickle.register_pickle_by_value(sys.modules[__name__])

TOKENIZER_A, TOKENIZER_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
HEAVY = 1 << 18  # id pairs that are sent to the tasks, 17 bytes each
CACHED_WORDS = 400_000  # the first that a task meets, which the frequent ones are among; others are kept for a batch
WORDS_AT_ONCE = 2_000
BYTES_AT_ONCE = 1 << 19  # of text, or 4-byte ids, that a task works on at a time; a longer text is a batch of its own
PAIRS_HELD = 1 << 19  # distinct pairs a task adds up before it passes them on
LEVELS = 4  # steps per doubling in the histogram of counts
# A blank between two characters that are surely no white space: neither tokenizer has a token that goes on across it.
_CUT = re.compile(r"(?<=[\w!-~]) (?=[\w!-~])")
# Words that the byte-level file's split and merges can be applied to directly: ASCII and Latin-1, single line ends inside.
_PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+(?:\n[!-~À-ÖØ-öø-ÿ]+)*")
_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-zÀ-ÖØ-öø-ÿ]+| ?[0-9]+| ?[^\sA-Za-z0-9À-ÖØ-öø-ÿ]+|\n")  # the file's own split, for such words
# The standard printable stand-ins for bytes in byte-level vocabularies.
_KEPT = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_OF = {chr(b): b for b in _KEPT} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in _KEPT)}
_SPELLED = {b: c for c, b in _BYTE_OF.items()}


def place(name: str, path: str | None) -> str:
    if path is None:
        import public_tokenizers

        return public_tokenizers.path(name)
    return path


def bytes_of_a(path: str) -> list[bytes]:
    """Bytes of every id of a byte-level vocabulary file."""
    with open(path, encoding="utf-8") as f:
        stored = json.load(f)
    out = [b""] * (max([*stored["model"]["vocab"].values(), *[t["id"] for t in stored["added_tokens"]]]) + 1)
    for token, i in stored["model"]["vocab"].items():
        out[i] = bytes(_BYTE_OF[c] for c in token) if all(c in _BYTE_OF for c in token) else token.encode()
    return out


def bytes_of_b(path: str) -> list[bytes]:
    """Bytes of every id of a piece vocabulary with byte fallback."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    return [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]


class WordTable:
    """Ids of numbered words, behind one another in one array."""

    def __init__(self, lengths: np.ndarray, held: bytes, starts: np.ndarray):
        self.lengths, self.held, self.starts = lengths, np.frombuffer(held, np.uint8), starts  # bytes of all ids and where each id's begin
        self.ids, self.ends = np.empty(0, np.int32), np.zeros(1, np.int64)

    def add(self, words: list[list[int]]) -> None:
        more = np.fromiter((i for w in words for i in w), np.int32)
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))])
        self.ids = np.concatenate([self.ids, more])

    def cut(self, words: int) -> None:
        self.ends = self.ends[: words + 1]
        self.ids = self.ids[: self.ends[-1]]

    def of(self, numbers: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words in order, and how many there are up to the end of each row of words."""
        n = self.ends[numbers + 1] - self.ends[numbers]
        upto = np.concatenate([[0], np.cumsum(n)])
        return self.ids[strung(self.ends[numbers], n)], upto[rows]

    def spelled(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of ids behind one another and where each ends."""
        n = self.lengths[ids]
        return self.held[strung(self.starts[ids], n)], np.cumsum(n)


def strung(starts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Positions of stretches of ``n`` from ``starts``, one stretch after another."""
    before = np.cumsum(n) - n
    return np.repeat(starts - before, n) + np.arange(int(n.sum()))


class TwoTokenizers:
    """Ids of both sides for texts, put together from those of their words."""

    def __init__(self, a: str, b: str):
        self.paths, self.known = (a, b), None

    def __reduce__(self):
        return (worker_tokenizers, self.paths)

    def load(self):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the process's cores are Spark's to deal out
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(self.paths[0])
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=self.paths[1])
        self.known, self.parts, self.tables = {}, {}, []
        for held in (bytes_of_a(self.paths[0]), bytes_of_b(self.paths[1])):
            n = np.array(list(map(len, held)), np.int64)
            self.tables.append(WordTable(n, b"".join(held), np.cumsum(n) - n))

    def part(self, part: str) -> list[int]:
        ids = [t.id for t in self.a.model.tokenize(part.encode().decode("latin-1").translate(_SPELLED))]
        if len(self.parts) < CACHED_WORDS // 4:
            self.parts[part] = ids
        return ids

    def of_a(self, words: list[str]) -> list[list[int]]:
        """Ids on the byte-level side: plain words by merges of their parts, others through the whole tokenizer."""
        known, out, other = self.parts, [], []
        for i, word in enumerate(words):
            if _PLAIN.fullmatch(word):
                out.append([i for p in _PARTS.findall(" " + word) for i in known.get(p) or self.part(p)])
            else:
                out.append([])
                other.append(i)
        for i, made in zip(other, self.a.encode_batch_fast([" " + words[i] for i in other], add_special_tokens=False)):
            out[i] = made.ids
        return out

    def learn(self, words: list[str]) -> None:
        for at in range(0, len(words), WORDS_AT_ONCE):
            some = words[at : at + WORDS_AT_ONCE]
            self.known.update(zip(some, range(len(self.known), len(self.known) + len(some))))
            for side, ids in zip(self.tables, (self.of_a(some), self.b.encode(some, num_threads=1))):
                side.add(ids)

    def ids(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of all texts on either side and where each text's end; none for an empty text or one that a side does not give back byte by byte."""
        if self.known is None:
            self.load()
        cut = [_CUT.split(t) if t else [] for t in texts]
        words = [w for c in cut for w in c]
        kept = len(self.known)
        self.learn([w for w in dict.fromkeys(words) if w not in self.known])
        numbers = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        rows = np.cumsum([len(c) for c in cut])
        sides = [t.of(numbers, rows) for t in self.tables]
        if len(self.known) > CACHED_WORDS:  # the words of this batch go again
            while len(self.known) > kept:
                self.known.popitem()
            for t in self.tables:
                t.cut(kept)
        text = [b" " + t.encode() if t else b"" for t in texts]
        whole = np.frombuffer(b"".join(text), np.uint8)
        spelled = [t.spelled(ids) for t, (ids, _) in zip(self.tables, sides)]
        if all(np.array_equal(got, whole) for got, _ in spelled):
            return sides
        right = np.ones(len(texts), bool)
        for (got, ends), (_, upto) in zip(spelled, sides):
            at = np.concatenate([[0], ends])[np.concatenate([[0], upto])]
            right &= [got[x:y].tobytes() == t for x, y, t in zip(at[:-1].tolist(), at[1:].tolist(), text)]
        out = []
        for ids, upto in sides:
            n = np.diff(upto, prepend=0)
            out.append((ids[np.repeat(right, n)], np.cumsum(np.where(right, n, 0))))
        return out


def worker_tokenizers(a: str, b: str) -> TwoTokenizers:
    """The tokenizers of this process, with the words they have met: tasks that follow one another in a worker share them."""
    held = sys.modules.setdefault("driftline_worker_tokenizers", types.ModuleType("driftline_worker_tokenizers")).__dict__
    return held.setdefault((a, b), TwoTokenizers(a, b))


def encode_both(docs: DataFrame, a: str | None = None, b: str | None = None, text: str = "text") -> DataFrame:
    """``doc_id, row, a_ids, b_ids`` of every row, written; ``row`` numbers the rows, also those that share an id or have none."""
    both = TwoTokenizers(place(TOKENIZER_A, a), place(TOKENIZER_B, b))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, 1, 1):
                made = [lists(ids, ends) for ids, ends in both.ids(part.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column(0), *made], names=["doc_id", "a_ids", "b_ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    ids = docs.select("doc_id", F.col(text).alias("t")).mapInArrow(run, f"doc_id {kind}, a_ids array<int>, b_ids array<int>")
    with small_batches(docs.sparkSession):
        return materialize(ids.withColumn("row", F.monotonically_increasing_id()))


def lists(values: np.ndarray, ends: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(values.astype(np.int32)))


def by_bytes(batch: pa.RecordBatch, column: int, width: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about ``BYTES_AT_ONCE`` of one string or list column, each of one row at least."""
    held = batch.column(column)
    sizes = (pa.compute.binary_length if width == 1 else pa.compute.list_value_length)(held).fill_null(0).to_numpy(zero_copy_only=False)
    at, size = 0, 0
    for i, s in enumerate(sizes.tolist()):
        if i > at and size + s * width > BYTES_AT_ONCE:
            yield batch.slice(at, i - at)
            at, size = i, 0
        size += s * width
    if batch.num_rows > at:
        yield batch.slice(at)


def flat(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Values and the end of each row's values."""
    ends = np.cumsum(pa.compute.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False))
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), ends


def terminals(a_end: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each token of both sides the B token that ends its group, by doubling pointers, from the tokens' byte ends."""
    n = len(a_end)
    # the first token of the other side that ends no earlier is the farthest-right one that overlaps
    of_a = np.searchsorted(b_end, a_end, "left")
    of_b = np.searchsorted(a_end, b_end, "left")
    follow = np.concatenate([n + of_a, np.where(a_end[of_b] > b_end, of_b, n + np.arange(len(b_end)))]) if n else np.empty(0, np.int64)
    while True:
        further = follow[follow]
        if np.array_equal(further, follow):
            return follow[:n] - n, follow[n:] - n
        follow = further


class Alignment:
    """Groups and links of a batch of rows; the bytes of both sides are the same in every row, so rows lie behind one another."""

    def __init__(self, a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], a_len: np.ndarray, b_len: np.ndarray):
        (self.a, self.a_rows), (self.b, self.b_rows) = a, b
        self.a_end, self.b_end = np.cumsum(a_len[self.a]), np.cumsum(b_len[self.b])
        a_last, b_last = terminals(self.a_end, self.b_end)
        last = np.zeros(len(self.b) + 1, np.int64)
        last[1:][b_last] = 1
        before = np.cumsum(last)
        self.a_group, self.b_group = before[a_last], before[b_last]  # group of each token, from 0
        self.groups = before[self.b_rows]  # groups up to the end of each row

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A and B token of each overlapping pair, and the number of links up to the end of each row."""
        first = np.searchsorted(self.b_end, np.concatenate([[0], self.a_end[:-1]]) if len(self.a) else self.a_end, "right")
        many = np.searchsorted(self.b_end, self.a_end, "left") - first + 1
        at = np.repeat(np.arange(len(self.a)), many)
        upto = np.concatenate([[0], np.cumsum(many)])
        return at, np.arange(len(at)) - np.repeat(upto[:-1], many) + np.repeat(first, many), upto[self.a_rows]


def per_row(upto: np.ndarray) -> np.ndarray:
    return np.diff(upto, prepend=0)


def group_texts(al: Alignment, names: np.ndarray) -> list[str]:
    """``a1,a2|b1;a3|b2`` of every row; ``names`` holds each id's text with a comma, a bar and a semicolon."""
    n_groups = int(al.groups[-1]) if len(al.groups) else 0
    a_in, b_in = np.bincount(al.a_group, minlength=n_groups), np.bincount(al.b_group, minlength=n_groups)
    a_upto, b_upto = np.cumsum(a_in), np.cumsum(b_in)
    spelled = np.empty(len(al.a) + len(al.b), object)
    kind = np.zeros(len(al.a), np.int64)
    kind[a_upto - 1] = 1
    spelled[np.arange(len(al.a)) + (b_upto - b_in)[al.a_group]] = names[3 * al.a + kind]
    kind = np.zeros(len(al.b), np.int64)
    kind[b_upto - 1] = 2
    spelled[np.arange(len(al.b)) + a_upto[al.b_group]] = names[3 * al.b + kind]
    out, at = [], 0
    for end in (al.a_rows + al.b_rows).tolist():
        out.append("".join(spelled[at:end].tolist())[:-1])
        at = end
    return out


def token_lengths(a: str | None, b: str | None) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.array([len(t) for t in held], np.int64) for held in (bytes_of_a(place(TOKENIZER_A, a)), bytes_of_b(place(TOKENIZER_B, b))))


def aligned_batches(batches: Iterator[pa.RecordBatch], lengths: tuple[np.ndarray, np.ndarray]) -> Iterator[tuple[pa.RecordBatch, Alignment]]:
    for batch in batches:
        for part in by_bytes(batch, batch.schema.get_field_index("a_ids"), 4):
            yield part, Alignment(flat(part.column("a_ids")), flat(part.column("b_ids")), *lengths)


def groups_of(tokens: DataFrame, a: str | None = None, b: str | None = None) -> DataFrame:
    """The rows of :func:`encode_both` with ``a_groups`` and ``b_groups``, the number of each token's group within its row, from 0."""
    lengths = token_lengths(a, b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, al in aligned_batches(batches, lengths):
            made, start = [], np.concatenate([[0], al.groups[:-1]])
            for group, ends in ((al.a_group, al.a_rows), (al.b_group, al.b_rows)):
                own = group - np.repeat(start, per_row(ends))
                made.append(lists(own, ends))
            yield pa.RecordBatch.from_arrays([*part.columns, *made], names=[*part.schema.names, "a_groups", "b_groups"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in tokens.schema.fields)
    return tokens.mapInArrow(run, f"{fields}, a_groups array<int>, b_groups array<int>")


def pair_counts(tokens: DataFrame, a: str | None = None, b: str | None = None) -> DataFrame:
    """``b_id, a_id, n, best``: how many links of the corpus join two ids, and whether no id of side A is linked to that B id more often. Written.

    A task adds up its batches before it hands pairs on, so frequent ones are few rows by the time they are shuffled.
    """
    lengths = token_lengths(a, b)
    width = len(lengths[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, found, size = [], [], 0

        def merged():
            codes, at = np.unique(np.concatenate(held), return_inverse=True)
            return codes, np.bincount(at, weights=np.concatenate(found), minlength=len(codes)).astype(np.int64)

        def rows(codes, n):
            for at in range(0, len(codes), 1 << 16):
                c = codes[at : at + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array((c // width).astype(np.int32)), pa.array((c % width).astype(np.int32)), pa.array(n[at : at + (1 << 16)])], names=["b_id", "a_id", "n"])

        for _, al in aligned_batches(batches, lengths):
            x, y, _ = al.links()
            codes, n = np.unique(al.b[y] * width + al.a[x], return_counts=True)
            held.append(codes), found.append(n)
            size += len(codes)
            if size > 2 * PAIRS_HELD:
                codes, n = merged()
                if len(codes) > PAIRS_HELD:
                    yield from rows(codes, n)
                    held, found, size = [], [], 0
                else:
                    held, found, size = [codes], [n], len(codes)
        if held:
            yield from rows(*merged())

    pairs = tokens.select("a_ids", "b_ids").mapInArrow(run, "b_id int, a_id int, n bigint")
    with small_batches(tokens.sparkSession):
        counts = materialize(pairs.groupBy("b_id", "a_id").agg(F.sum("n").alias("n")))
    most = counts.groupBy("b_id").agg(F.max("n").alias("most"))
    return materialize(counts.join(most, "b_id").select("b_id", "a_id", "n", (F.col("n") == F.col("most")).alias("best")))


def heavy_pairs(counts: DataFrame, heavy: int) -> int:
    """The least level of counts (``LEVELS`` to a doubling) such that at most ``heavy`` pairs reach it, from a histogram of at most 256 levels."""
    held = 0
    for level, pairs in sorted(counts.groupBy(level_of_count().alias("level")).count().collect(), reverse=True):
        held += pairs
        if held > heavy:
            return level + 1
    return 0


def level_of_count():
    return F.floor(LEVELS * F.log2("n")).cast("int")


def align_statistics(tokens: DataFrame, counts: DataFrame, a: str | None = None, b: str | None = None, heavy: int = HEAVY) -> DataFrame:
    """Per row of :func:`encode_both`: ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``.

    ``counts`` comes from :func:`pair_counts`, of these rows or of a larger corpus that holds them. At most ``heavy`` pairs pass through the driver to the tasks.
    """
    lengths = token_lengths(a, b)
    width = len(lengths[0])
    names = np.array([f"{i}{end}" for i in range(max(map(len, lengths))) for end in ",|;"], object)
    level = heavy_pairs(counts, heavy)
    known = counts.filter(level_of_count() >= level).select((F.col("b_id").cast("long") * width + F.col("a_id")).alias("code"), "n", "best").toArrow()
    order = np.argsort(known["code"].to_numpy())
    code, n, best = (known[c].to_numpy()[order] for c in ("code", "n", "best"))
    # one more entry, which no pair has, keeps lookups inside
    sent = tokens.sparkSession.sparkContext.broadcast((np.append(code, -1), np.append(n, 0), np.append(best, False)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, n, best = sent.value
        for part, al in aligned_batches(batches, lengths):
            x, y, upto = al.links()
            codes = al.b[y] * width + al.a[x]
            at = np.searchsorted(code[:-1], codes)
            there = code[at] == codes
            sums = [np.concatenate([[0], np.cumsum(np.where(there, c[at], 0))])[upto] for c in (best, n)]
            texts = group_texts(al, names)
            rest = np.cumsum(np.concatenate([[0], ~there]))[upto].astype(np.int32)
            others = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], rest]).astype(np.int32)), pa.array(codes[~there]))
            whole = [per_row(v) for v in (al.a_rows, al.b_rows, al.groups, upto, *sums)]
            digest = [hashlib.sha256(t.encode()).hexdigest() if t else "" for t in texts]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("row"), *(pa.array(v.astype(np.int64)) for v in whole), pa.array(digest), others], names=made)

    columns = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
    made = ["doc_id", "row", *columns, "groups_sha256", "others"]
    kind = tokens.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, row bigint, " + ", ".join(f"{c} bigint" for c in columns) + ", groups_sha256 string, others array<bigint>"
    rows = tokens.select("doc_id", "row", "a_ids", "b_ids").mapInArrow(run, schema)
    with small_batches(tokens.sparkSession):
        rows = materialize(rows)
    sent.unpersist()
    if not level:  # every pair is among those sent
        return rows.drop("row", "others")
    rare = rows.select("row", F.explode("others").alias("code")).groupBy("row", "code").agg(F.count(F.lit(1)).alias("k"))
    rare = rare.select("row", "k", F.floor(F.col("code") / width).cast("int").alias("b_id"), (F.col("code") % width).cast("int").alias("a_id"))
    more = rare.join(counts.filter(level_of_count() < level), ["b_id", "a_id"]).groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("k")).otherwise(0)).alias("more_best"), F.sum(F.col("k") * F.col("n")).alias("more_sum"))
    added = {"n_best": F.col("n_best") + F.coalesce("more_best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("more_sum", F.lit(0))}
    return rows.drop("others").join(more, "row", "left").withColumns(added).drop("row", "more_best", "more_sum")


def align_tokens(docs: DataFrame, a: str | None = None, b: str | None = None, heavy: int = HEAVY, text: str = "text") -> DataFrame:
    """Alignment statistics of every row of ``docs``; ``a`` and ``b`` are paths of a byte-level and a piece vocabulary.

    A NULL or empty text, and one that a side does not give back byte by byte (a text that holds U+2581), has no tokens: zeros and an empty digest. Texts of any
    length are aligned whole. Repeated rows count each; rows with equal or NULL ids stay apart. An empty table gives no rows. Other columns are not looked at.
    """
    tokens = encode_both(docs, a, b, text)
    return align_statistics(tokens, pair_counts(tokens, a, b), a, b, heavy)


def op11_token_alignment(spark, sf_dir: str) -> DataFrame:
    """Groups, links and link counts of two tokenizations of every document."""
    return align_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"))
