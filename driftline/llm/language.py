"""Language identification by prediction by partial matching.

Each language has a tree of byte contexts up to three symbols long. A text's code length under a language is the sum over its bytes of
what a coder with that language's frozen counts would spend: the byte in the longest known context, or an escape (method C, with
exclusion of what the longer context has ruled out) and the byte in the next shorter one. The shortest code wins.
"""

from __future__ import annotations

import re
import sys
from dataclasses import dataclass

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remainder, table
from .texts import map_texts, with_labels

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SAMPLE_DOCS = 400  # bound of the documents per language the trees are grown from, whole texts
SYMBOLS = 64
_LETTER = re.compile(r"[^\W\d_]")


def symbol_map(samples: list[bytes]) -> np.ndarray:
    """Byte to symbol: one for white space, digits and other ASCII signs each, the most frequent remaining bytes one each, one for the rest."""
    seen = np.zeros(256, dtype=np.int64)
    for s in samples:
        seen += np.bincount(np.frombuffer(s, dtype=np.uint8), minlength=256)
    table = np.full(256, SYMBOLS - 1, dtype=np.int64)
    own = [b for b in range(256) if b >= 128 or 97 <= b <= 122]
    for i, b in enumerate(sorted(own, key=lambda b: (-seen[b], b))[: SYMBOLS - 4]):
        table[b] = i + 3
    for b in range(128):
        if not 97 <= b <= 122:
            table[b] = 0 if b in b" \t\n\r\x0b\x0c" else 1 if 48 <= b <= 57 else 2
    return table


@dataclass
class ContextTrees:
    """Frozen code lengths. ``rows[l]`` maps three symbols to the row of their longest known context, ``bits[l]`` holds the rows."""

    names: list[str]
    symbols: np.ndarray
    rows: list[np.ndarray]
    bits: list[np.ndarray]

    def lengths(self, texts: list[str]) -> np.ndarray:
        """Bits of each text under each language."""
        coded = [b"   " + t.lower().encode("utf-8", "replace") for t in texts]
        out = np.zeros((len(texts), len(self.names)))
        s = self.symbols[np.frombuffer(b"".join(coded), dtype=np.uint8)]
        context = (s[:-3] * SYMBOLS + s[1:-2]) * SYMBOLS + s[2:-1]
        nxt = s[3:]
        ends = np.cumsum([len(c) for c in coded])
        for k in range(len(self.names)):
            spent = np.concatenate([[0.0], np.cumsum(self.bits[k].ravel()[self.rows[k][context] * SYMBOLS + nxt], dtype=np.float64)])
            out[:, k] = spent[ends - 3] - spent[np.concatenate([[0], ends[:-1]])]
        return out

    def predict(self, texts: list[str]) -> dict:
        if not self.names:
            return {"lang_pred": ["und"] * len(texts), "score": [0.0] * len(texts)}
        bits = self.lengths(texts)
        best = bits.argmin(1)
        share = 1 / np.exp2(-np.minimum(bits - bits.min(1, keepdims=True), 1000)).sum(1)
        known = [bool(_LETTER.search(t)) for t in texts]
        return {
            "lang_pred": [self.names[b] if k else "und" for b, k in zip(best, known)],
            "score": [float(p) if k else 0.0 for p, k in zip(share, known)],
        }


def grow(samples: list[bytes], symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Context rows and code lengths of one language."""
    s = symbols[np.frombuffer(b"   " + b"   ".join(samples), dtype=np.uint8)]
    prob = np.full((1, SYMBOLS), 1 / SYMBOLS)  # below order 0 every symbol is as likely
    for order in range(3):
        key = np.zeros(len(s) - order, dtype=np.int64)
        for i in range(order + 1):
            key = key * SYMBOLS + s[i : len(s) - order + i]
        counts = np.bincount(key, minlength=SYMBOLS ** (order + 1)).reshape(-1, SYMBOLS)
        prob = blend(counts, np.tile(prob, (SYMBOLS, 1))[: len(counts)] if order else prob)
    key = ((s[:-3] * SYMBOLS + s[1:-2]) * SYMBOLS + s[2:-1]) * SYMBOLS + s[3:]
    seen, n = np.unique(key, return_counts=True)
    contexts, where = np.unique(seen // SYMBOLS, return_inverse=True)
    counts = np.zeros((len(contexts), SYMBOLS), dtype=np.int64)
    counts[where, seen % SYMBOLS] = n
    short = prob.shape[0]
    rows = np.arange(SYMBOLS**3, dtype=np.int64) % short  # a context never met is known by its last two symbols
    rows[contexts] = short + np.arange(len(contexts))
    longest = blend(counts, prob[contexts % short])
    return rows.astype(np.int32), (-np.log2(np.concatenate([prob, longest]))).astype(np.float32)


def blend(counts: np.ndarray, shorter: np.ndarray) -> np.ndarray:
    """Probabilities in contexts with these counts, over those of the contexts one symbol shorter."""
    total, kinds = counts.sum(1, keepdims=True), (counts > 0).sum(1, keepdims=True)
    spare = np.maximum(np.where(counts > 0, 0.0, shorter).sum(1, keepdims=True), 1e-12)
    escaped = np.where(kinds == SYMBOLS, 0.0, kinds / np.maximum(total + kinds, 1)) * shorter / spare
    known = counts / np.maximum(total + np.where(kinds == SYMBOLS, 0, kinds), 1)
    return np.where(total == 0, shorter, np.where(counts > 0, known, escaped))


def fit_languages(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> ContextTrees:
    """Trees from at most ``sample_docs`` whole texts per language, those whose ids hash lowest; rows without language or text teach nothing."""
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    names = [r[0] for r in known.select("lang").distinct().orderBy("lang").collect()]
    ids = None
    for name in names:
        part = known.filter(F.col("lang") == name).select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs)
        ids = part if ids is None else ids.unionByName(part)
    if ids is None:
        return ContextTrees([], np.zeros(256, np.int64), [], [])
    rows = with_labels(known, ids.distinct(), ("doc_id", "lang", "text")).toPandas().sort_values(["lang", "doc_id", "text"])
    samples = {n: [t.lower().encode("utf-8", "replace") for t in rows["text"][rows["lang"] == n]] for n in names}
    symbols = symbol_map([s for n in names for s in samples[n]])
    grown = [grow(samples[n], symbols) for n in names]
    return ContextTrees(names, symbols, [g[0] for g in grown], [g[1] for g in grown])


def identify(docs: DataFrame, trees: ContextTrees) -> DataFrame:
    """``doc_id, lang_pred, score`` for every row; ``und`` and 0 where the text is NULL or has no letter."""
    return map_texts(docs, trees.predict, "lang_pred string, score double")


def op6_language(spark, sf_dir: str) -> DataFrame:
    """Language of every document; ids with remainder 2 modulo 4 are held out."""
    docs = table(spark, sf_dir, "documents")
    held = remainder(F.col("doc_id"), 4) == 2
    found = identify(docs, fit_languages(docs.filter(~held)))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score")
