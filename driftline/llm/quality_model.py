"""Quality classifier: histogram gradient-boosted trees over document statistics.

The trees are fitted with numpy on the driver from a bounded sample of labelled rows and flattened into arrays; tasks walk
all trees for a batch of documents with a handful of array operations per level.
"""

from __future__ import annotations

import re
import sys
from dataclasses import dataclass

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remainder, sample_by_hash, table
from .texts import map_texts, with_labels

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SAMPLE_ROWS = 20_000  # bound of the labelled rows the trees are fitted on
STATISTICS = [
    "chars", "words", "word_len", "distinct", "pair_repeats", "triple_repeats", "lines", "line_words", "line_repeats", "closed_lines",
    "upper", "digit", "symbol", "bar", "shout", "comma", "stop", "non_ascii", "space", "top_word", "neighbour_repeats", "long_words",
]
_CLOSED = re.compile(r"[.!?…\"'”’»)\]]$")


def statistics(text: str) -> list[float]:
    """The numbers of ``STATISTICS`` for one whole text; an empty text gives zeros."""
    words = text.split()
    n = len(words)
    if not n:
        return [float(len(text)), *[0.0] * (len(STATISTICS) - 1)]
    raw = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8), minlength=256)
    size = float(raw.sum())
    lines = [x for x in text.split("\n") if x.strip()]
    counts: dict[str, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    pairs = list(zip(words, words[1:]))
    triples = list(zip(words, words[1:], words[2:]))
    count = lambda chars: float(sum(raw[ord(c)] for c in chars))
    return [
        np.log1p(size), np.log1p(n), size / n, len(counts) / n,
        1 - len(set(pairs)) / max(1, len(pairs)), 1 - len(set(triples)) / max(1, len(triples)),
        np.log1p(len(lines)), n / len(lines), 1 - len(set(lines)) / len(lines),
        sum(1 for x in lines if _CLOSED.search(x.rstrip())) / len(lines),
        float(raw[65:91].sum()) / size, float(raw[48:58].sum()) / size, count("#*$%&<>@^~=+\\{}") / n, count("|") / n,
        text.count("!!") / n, count(",") / n, count(".") / n, float(raw[128:].sum()) / size, count(" \t\n\r") / size,
        max(counts.values()) / n, sum(a == b for a, b in pairs) / n, sum(1 for w in counts if len(w) > 20) / len(counts),
    ]


@dataclass
class Trees:
    """Boosted trees of one depth. ``feature`` and ``cut`` hold the inner nodes of all trees in heap order, ``leaf`` their leaves."""

    base: float
    feature: np.ndarray  # trees x (2^depth - 1)
    cut: np.ndarray
    leaf: np.ndarray  # trees x 2^depth

    def scores(self, x: np.ndarray) -> np.ndarray:
        trees, inner = self.feature.shape
        node = np.zeros((len(x), trees), dtype=np.int64)
        at, rows = np.arange(trees), np.arange(len(x))[:, None]
        for _ in range(int(np.log2(inner + 1))):
            node = 2 * node + 1 + (x[rows, self.feature[at, node]] > self.cut[at, node])
        return 1 / (1 + np.exp(-(self.base + self.leaf[at, node - inner].sum(1))))


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 64, ridge: float = 1.0,
              least: float = 3.0) -> Trees:
    """Trees for log loss: columns are cut into quantile bins once, every level is one histogram of gradients per (node, column, bin)."""
    n, width = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(width)]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1)  # bin b: edges[b-1] < x <= edges[b]
    rate_up = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(rate_up / (1 - rate_up)))
    f = np.full(n, base)
    inner = 2**depth - 1
    feature, cut, leaf = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
    column = np.arange(width)
    for t in range(trees):
        p = 1 / (1 + np.exp(-f))
        g, h = p - y, p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, held = 2**level - 1, 2**level
            slot = ((node - first)[:, None] * width + column) * bins + binned
            hist = [np.bincount(slot.ravel(), np.repeat(v, width), held * width * bins).reshape(held, width, bins) for v in (g, h)]
            left_g, left_h = (v.cumsum(2) for v in hist)
            all_g, all_h = left_g[:, :, -1:], left_h[:, :, -1:]
            worth = lambda a, b: a * a / (b + ridge)
            gain = worth(left_g, left_h) + worth(all_g - left_g, all_h - left_h) - worth(all_g, all_h)
            gain[(left_h < least * 0.05) | (all_h - left_h < least * 0.05)] = -1
            best = gain.reshape(held, -1).argmax(1)
            for k in range(held):
                j, b = divmod(int(best[k]), bins)
                if gain[k, j, b] > 1e-9 and b < len(edges[j]):
                    feature[t, first + k], cut[t, first + k] = j, edges[j][b]
            node = 2 * node + 1 + (x[np.arange(n), feature[t, node]] > cut[t, node])
        end = node - inner
        leaf[t] = -rate * np.bincount(end, g, inner + 1) / (np.bincount(end, h, inner + 1) + ridge)
        f += leaf[t, end]
    return Trees(base, feature, cut, leaf)


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", sample_rows: int = SAMPLE_ROWS) -> Trees:
    """Trees from at most ``sample_rows`` labelled documents, those whose ids hash lowest.

    Rows with a NULL id or label teach nothing. Without rows the score is 0.5 everywhere, with one class that class's share.
    """
    known = sample_by_hash(labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).cast("int").alias("y")), sample_rows)
    rows = map_texts(with_labels(docs, known, ("doc_id", "text")), _columns, "x array<double>", keep=("doc_id", "y")).toPandas()
    rows = rows.sort_values(["doc_id", "y"])
    if not len(rows):
        return Trees(0.0, np.zeros((1, 1), np.int64), np.full((1, 1), np.inf), np.zeros((1, 2)))
    return fit_trees(np.array(rows["x"].tolist(), dtype=float), rows["y"].to_numpy(float))


def _columns(texts: list[str]) -> dict:
    return {"x": [statistics(t) for t in texts]}


def score_quality(docs: DataFrame, trees: Trees) -> DataFrame:
    """``doc_id, score`` for every row; a NULL text is scored as the empty one."""

    def scored(texts: list[str]) -> dict:
        return {"score": trees.scores(np.array([statistics(t) for t in texts], dtype=float))}

    return map_texts(docs, scored, "score double")


def op1_quality_model(spark, sf_dir: str) -> DataFrame:
    """Quality score of every document; ids with remainder 1 modulo 3 are held out."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = remainder(F.col("doc_id"), 3) == 1
    scored = score_quality(docs, fit_quality(docs, labels.filter(~held)))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
