"""Toxicity by non-negative positive-unlabelled learning.

Only confirmed toxic documents are taken as labelled; everything else is unlabelled text of which a share, the class prior, is
toxic. The risk of calling unlabelled text clean is corrected by that prior, and where the correction would make it negative, which
only overfitting does, the step goes the other way. The classifier is linear in the words a text holds.
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

POSITIVE_ROWS = 4_000  # bounds of the samples the classifier is fitted on
UNLABELLED_ROWS = 12_000
VOCABULARY = 4_096
LEAST_ROWS = 5  # a word in fewer sampled documents has no weight
LEAST_Z = 5.0  # nor has one whose shares differ by fewer standard errors
_LETTERS = re.compile(r"[^\W\d_]+")


def text_words(text: str) -> set[str]:
    """Distinct runs of letters, in lower case."""
    return set(_LETTERS.findall(text.lower()))


@dataclass
class WordModel:
    bias: float
    weights: dict[str, float]

    def scores(self, texts: list[str]) -> list[float]:
        get = self.weights.get
        f = [self.bias + sum(v for w in text_words(t) if (v := get(w)) is not None) for t in texts]
        return (1 / (1 + np.exp(-np.clip(f, -60, 60)))).tolist()


def choose_words(texts: DataFrame, size: int = VOCABULARY, least_rows: int = LEAST_ROWS, least_z: float = LEAST_Z) -> list[str]:
    """Words whose share of documents differs most between ``set`` 1 and 0, in units of its standard error; Spark counts them."""
    sizes = texts.groupBy("set").count().collect()
    n1, n0 = (max(1, sum(r["count"] for r in sizes if r["set"] == k)) for k in (1, 0))
    words = map_texts(texts, lambda t: {"words": [list(text_words(x)) for x in t]}, "words array<string>", keep=("set",))
    seen = words.select("set", F.explode("words").alias("word")).groupBy("word").agg(F.sum("set").alias("c1"), F.count(F.lit(1)).alias("c"))
    both = F.col("c") / (n1 + n0)
    z = F.abs(F.col("c1") / n1 - (F.col("c") - F.col("c1")) / n0) / F.sqrt(both * (1 - both) * (1 / n1 + 1 / n0) + 1e-12)
    best = seen.filter(F.col("c") >= least_rows).withColumn("z", z).filter(F.col("z") >= least_z).orderBy(F.desc("z"), "word").limit(size)
    return [r["word"] for r in best.collect()]


def fit_nnpu(held: list[list[int]], pos: np.ndarray, width: int, prior: float, steps: int = 400, rate: float = 0.05,
             ridge: float = 1e-4) -> tuple[float, np.ndarray]:
    """Bias and weights under the non-negative risk ``prior * R_p(+) + max(0, R_u(-) - prior * R_p(-))`` with log loss, by full-batch Adam.

    ``held`` lists the word numbers of each document, ``pos`` marks the confirmed ones.
    """
    index = np.array([i for d in held for i in d], dtype=np.int64)
    row = np.repeat(np.arange(len(held)), [len(d) for d in held])
    n_p, n_u = max(1, int(pos.sum())), max(1, int((~pos).sum()))
    w, bias = np.zeros(width), float(np.log(prior / (1 - prior)))
    m, v = np.zeros(width + 1), np.zeros(width + 1)
    for t in range(1, steps + 1):
        f = bias + np.bincount(row, w[index], len(held))
        p = 1 / (1 + np.exp(-f))
        as_clean = np.logaddexp(0, f)  # log loss of calling a document clean
        clean_risk = as_clean[~pos].mean() - prior * as_clean[pos].mean() if pos.any() and not pos.all() else 0.0
        clean = np.where(pos, -prior * p / n_p, p / n_u)
        g = np.where(pos, prior * (p - 1) / n_p, 0.0) + clean if clean_risk >= 0 else -clean
        grad = np.append(np.bincount(index, g[row], width) + ridge * w, g.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        w, bias = w - step[:-1], bias - step[-1]
    return float(bias), w


def fit_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", prior: float | None = None,
                 positive_rows: int = POSITIVE_ROWS, unlabelled_rows: int = UNLABELLED_ROWS) -> WordModel:
    """Model from at most ``positive_rows`` toxic and ``unlabelled_rows`` other documents, those whose ids hash lowest.

    ``prior`` is the share of toxic text; left out, it is that of the given labels. Without a toxic row every score is 0.
    """
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    if prior is None:
        prior = known.agg(F.avg(F.col(label).cast("double"))).first()[0] or 0.0
    toxic = sample_by_hash(known.filter(F.col(label) == 1).select("doc_id").distinct(), positive_rows)
    rest = sample_by_hash(docs.filter(F.col("doc_id").isNotNull()).select("doc_id").distinct(), unlabelled_rows)
    both = toxic.withColumn("set", F.lit(1)).unionByName(rest.withColumn("set", F.lit(0)))
    texts = with_labels(docs, both, ("doc_id", "text"))
    words = choose_words(texts)
    at = {w: i for i, w in enumerate(words)}
    rows = map_texts(texts, lambda t: {"held": [sorted(at[w] for w in text_words(x) if w in at) for x in t]}, "held array<int>", keep=("doc_id", "set"))
    rows = sorted((r["set"], r["doc_id"], list(r["held"])) for r in rows.toLocalIterator())
    pos = np.array([r[0] == 1 for r in rows], dtype=bool)
    if not pos.any():
        return WordModel(-60.0, {})
    bias, w = fit_nnpu([r[2] for r in rows], pos, len(words), float(np.clip(prior, 1e-3, 0.999)))
    return WordModel(bias, dict(zip(words, w.tolist())))


def score_toxicity(docs: DataFrame, model: WordModel) -> DataFrame:
    """``doc_id, score`` for every row; NULL and empty texts hold no word and get the bias alone."""
    return map_texts(docs, lambda texts: {"score": model.scores(texts)}, "score double")


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    """Toxicity score of every document; ids with remainder 0 modulo 5 are held out."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = remainder(F.col("doc_id"), 5) == 0
    scored = score_toxicity(docs, fit_toxicity(docs.filter(~held), labels.filter(~held)))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
