"""Best-fit packing of token sequences with certified bin counts.

Documents are tokenized where they lie, cut only if longer than a sequence, and packed in groups of a few thousand pieces by best-fit
decreasing. Dual-feasible functions bound the number of sequences a group needs from below. A group that meets its bound is certified; its open
sequences, and in a group with a gap the worst filled ones as well, hand their pieces over to a new, smaller set of groups that are packed again, until
one group is left or a round no longer saves anything. Only lengths and check sums travel, never tokens.
"""

from __future__ import annotations

import re
import sys
import zlib

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import table
from .texts import map_texts

cloudpickle.register_pickle_by_value(sys.modules[__name__])

CAPACITY = 2048
TOKENIZER = "word_bpe_49k.json"
END = 0  # id that closes a document
GROUP_ROWS = 4_000
RELEASED_PER_GAP = 16  # worst filled sequences that a group hands over for each sequence above its bound
CACHED_WORDS = 500_000
# Words the pieces of which are known without the tokenizer's own normalizer: ASCII and Latin-1 letters, digits and signs that start no special token.
_PLAIN = re.compile(r"[A-Za-z0-9À-ÖØ-öø-ÿ!-/:;=?@\[-`{|}~]+")
_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")  # the tokenizer file's own split, for such words in lower case
_ODD_SPACE = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
# The standard printable stand-ins for bytes in byte-level vocabularies.
_KEPT = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE = {b: chr(b) for b in _KEPT} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in _KEPT)}


class WordIds(dict):
    """Token ids of white-space separated words, as little-endian bytes, filled as words turn up.

    White space never takes part in a token here, so a text's ids are those of its words in order; words outside the plain alphabet
    go through the whole tokenizer, plain ones through its merges only.
    """

    def __init__(self, path: str | None = None):
        super().__init__()
        self.path, self.parts, self.tokenizer = path, {}, None

    def __reduce__(self):
        return (WordIds, (self.path,))

    def load(self):
        from tokenizers import Tokenizer

        if self.path is None:
            import public_tokenizers

            self.path = public_tokenizers.path(TOKENIZER)
        self.tokenizer = Tokenizer.from_file(self.path)
        self.model = self.tokenizer.model

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def part(self, part: str) -> bytes:
        if len(self.parts) > CACHED_WORDS:
            self.parts.clear()
        spelled = part.encode().decode("latin-1").translate(_BYTE)
        value = self.parts[part] = b"".join(t.id.to_bytes(4, "little") for t in self.model.tokenize(spelled))
        return value

    def __missing__(self, word: str) -> bytes:
        if len(self) > CACHED_WORDS:
            self.clear()
        if _PLAIN.fullmatch(word):
            known = self.parts
            value = b"".join(known.get(p) or self.part(p) for p in _PARTS.findall(word.lower()))
        else:
            value = self.whole(word)
        self[word] = value
        return value

    def ids(self, text: str) -> bytes:
        if self.tokenizer is None:
            self.load()
        if _ODD_SPACE.search(text):
            return self.whole(text)
        return b"".join(map(self.__getitem__, text.split()))


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` (and ``ids``) of the pieces of every document, which ends in id 0; a NULL text is an empty one."""
    words = WordIds(tokenizer)

    def cut(texts: list[str]) -> dict:
        out = []
        for text in texts:
            ids = words.ids(text) + END.to_bytes(4, "little")
            rows = []
            for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                part = ids[at : at + 4 * capacity]
                row = {"piece": k, "start": at // 4, "length": len(part) // 4, "ids_crc32": zlib.crc32(part)}
                rows.append(row | {"ids": np.frombuffer(part, dtype="<u4").tolist()} if with_ids else row)
            out.append(rows)
        return {"pieces": out}

    fields = "piece int, start bigint, length bigint, ids_crc32 bigint" + (", ids array<int>" if with_ids else "")
    return map_texts(docs, cut, f"pieces array<struct<{fields}>>").select("doc_id", F.inline("pieces"))


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of each length, taken in the order given (decreasing), and the number of bins: the fullest bin that still has room."""
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_rooms = 0  # bit r: some bin has r left
    bins = 0
    where, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for i, size in enumerate(lengths.tolist()):
        fits = open_rooms >> size
        if fits:
            left = size + (fits & -fits).bit_length() - 1
            b = room[left].pop()
            if not room[left]:
                open_rooms ^= 1 << left
        else:
            b, left, bins = bins, capacity, bins + 1
        where[i], offset[i] = b, capacity - left
        left -= size
        room[left].append(b)
        open_rooms |= 1 << left
    return where, offset, bins


def bins_needed(lengths: np.ndarray, capacity: int) -> int:
    """Lower bound on the bins for these lengths: the best of two families of dual-feasible functions.

    One counts lengths above ``capacity - c`` as whole bins and drops those below ``c``; the other rounds multiples of ``1 / (k + 1)`` of the
    capacity down to multiples of ``1 / k``. No bin's lengths can add up to more than one bin under either.
    """
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    size = np.arange(capacity + 1)
    tail = np.cumsum(count[::-1])[::-1]  # lengths of at least x
    mass = np.concatenate([[0], np.cumsum(count * size)])  # mass[x]: sum of lengths below x
    c = np.arange(1, capacity // 2 + 1)
    cut = capacity * np.append(tail, 0)[capacity - c + 1] + mass[capacity - c + 1] - mass[c]
    best = max(int(mass[-1]), int(cut.max()))
    bound = -(-best // capacity)
    for k in range(1, 21):
        scaled = (k + 1) * size
        even = scaled % capacity == 0
        # in units of 1 / (k * capacity) of a bin
        value = np.where(even, k * size, (scaled // capacity) * capacity)
        bound = max(bound, -(-int((count * value).sum()) // (k * capacity)))
    return bound


def _pack_group(capacity: int, last: bool):
    def pack(rows: pa.Table) -> pa.Table:
        at = rows.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        lengths = at.column("length").to_numpy()
        where, offset, bins = best_fit(lengths, capacity)
        gap = bins - bins_needed(lengths, capacity)
        free = capacity - np.bincount(where, lengths, bins)
        loose = np.argsort(-free, kind="stable")[: 1 + RELEASED_PER_GAP * gap]
        loose = loose[free[loose] > 0]
        settled = np.ones(bins, dtype=bool)
        if not last:
            settled[loose] = False
        for name, values in (("bin", where), ("offset", offset), ("settled", settled[where]), ("gap", np.full(len(where), gap))):
            at = at.append_column(name, pa.array(values))
        return at.select(["doc_id", "piece", "start", "length", "ids_crc32", "group", "bin", "offset", "settled", "gap"])

    return pack


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, group_rows: int = GROUP_ROWS) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``: all rows, gapless in each sequence from 0.

    Pieces of the full length are sequences of their own. Equal rows are packed like any others. ``gap`` tells how far the group that settled a row was
    from its lower bound.
    """
    fields = pieces.select("doc_id", "piece", "start", "length", "ids_crc32")
    doc_type = fields.schema["doc_id"].dataType.simpleString()
    made = f"doc_id {doc_type}, piece int, start bigint, length bigint, ids_crc32 bigint, group bigint, bin bigint, offset bigint, settled boolean, gap bigint"
    out = fields.filter(F.col("length") >= capacity).withColumns(
        {"sequence_id": F.monotonically_increasing_id(), "offset": F.lit(0).cast("long"), "gap": F.lit(0).cast("long")}
    )
    todo = fields.filter(F.col("length") < capacity)
    rows, turn = todo.count(), 0
    while rows:
        turn += 1
        groups = -(-rows // group_rows)
        key = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.lit(turn)), F.lit(groups))
        packed = materialize(todo.withColumn("group", key).groupBy("group").applyInArrow(_pack_group(capacity, groups == 1), made))
        ids = F.shiftleft(F.lit(turn).cast("long"), 57).bitwiseOR(F.shiftleft("group", 24)).bitwiseOR(F.col("bin"))
        out = out.unionByName(packed.filter("settled").select(*fields.columns, ids.alias("sequence_id"), "offset", "gap"))
        todo = packed.filter("NOT settled").select(*fields.columns)
        before, rows = rows, todo.count()
        if rows > before // 2:  # nothing left to gain: pack what is loose once more and let it be
            groups = -(-rows // group_rows)
            packed = materialize(todo.withColumn("group", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.lit(0)), F.lit(groups))).groupBy("group").applyInArrow(_pack_group(capacity, True), made))
            ids = F.shiftleft(F.lit(turn + 1).cast("long"), 57).bitwiseOR(F.shiftleft("group", 24)).bitwiseOR(F.col("bin"))
            return out.unionByName(packed.select(*fields.columns, ids.alias("sequence_id"), "offset", "gap"))
    return out


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, group_rows: int = GROUP_ROWS) -> DataFrame:
    """:func:`token_pieces` of ``docs`` (``doc_id``, ``text``; other columns are left aside) packed by :func:`pack_pieces`."""
    return pack_pieces(materialize(token_pieces(docs, capacity, tokenizer)), capacity, group_rows)


def op4_packing(spark, sf_dir: str) -> DataFrame:
    """Every document's pieces and their places."""
    packed = pack_documents(table(spark, sf_dir, "documents"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
