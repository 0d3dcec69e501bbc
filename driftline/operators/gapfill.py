"""Filling gaps by regressions per calendar month, one dependency level at a time.

All models of a level are fitted from one aggregate of the data rows: counts, means and covariances per (key, pattern of missing values). The complete cases of a
model are the patterns in which its columns are present, so its moments are put together from theirs and no data row is copied per model.
What is left per model is a system of a few equations, solved on those rows. Coefficients are written and joined back to the data rows.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .joins import attach

# the solver travels with the plan, so workers need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

INTERCEPT = "(intercept)"
# Fixed value: a predictor counts as a combination of earlier ones below this share of its length.
RANK_TOLERANCE = 1e-7

MODEL_SCHEMA = "coef map<string,double>, rss double, aic double"


@dataclass(frozen=True)
class Model:
    """Regression of ``target`` on ``predictors``, optionally reduced backwards by AIC."""

    target: str
    predictors: tuple[str, ...]
    stepwise: bool = False


def independent(cov: np.ndarray, mean: np.ndarray, n: float, cols: Sequence[int]) -> list[int]:
    """Predictors that are no linear combination of the intercept and the earlier ones."""
    kept: list[int] = []
    for c in cols:
        left = cov[c, c]
        if kept:
            block = cov[np.ix_(kept, kept)]
            left -= cov[c, kept] @ np.linalg.solve(block, cov[kept, c])
        if left > 0 and np.sqrt(left) >= RANK_TOLERANCE * np.sqrt(cov[c, c] + mean[c] ** 2):
            kept.append(c)
    return kept


def solve_subset(cov: np.ndarray, cols: Sequence[int], y: int, n: float) -> tuple[np.ndarray, float]:
    """Slopes on ``cols`` and the residual sum of squares."""
    cols = list(cols)
    if not cols:
        return np.zeros(0), n * cov[y, y]
    slopes = np.linalg.solve(cov[np.ix_(cols, cols)], cov[cols, y])
    return slopes, max(0.0, n * (cov[y, y] - cov[cols, y] @ slopes))


def aic(rss: float, n: float, terms: int) -> float:
    return n * np.log(rss / n) + 2.0 * terms if rss > 0 else -np.inf


def backward(cov: np.ndarray, cols: Sequence[int], y: int, n: float) -> list[int]:
    """Drop the predictor whose removal gives the lowest AIC, as long as that is an improvement."""
    current = list(cols)
    best = aic(solve_subset(cov, current, y, n)[1], n, len(current) + 1)
    while current and np.isfinite(best):
        trials = [[c for c in current if c != gone] for gone in current]
        scores = [aic(solve_subset(cov, t, y, n)[1], n, len(t) + 1) for t in trials]
        i = int(np.argmin(scores))
        if scores[i] >= best:
            break
        current, best = trials[i], scores[i]
    return current


def solve_models(models: Sequence[Model], width: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Function for ``mapInPandas`` over model rows with ``n``, ``mean`` and upper-triangle ``cov``."""
    pairs = list(combinations_with_replacement(range(width + 1), 2))

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        by_target = {m.target: m for m in models}
        for batch in batches:
            coefs, sums, scores = [], [], []
            for target, n, mean, flat in zip(batch["target"], batch["n"], batch["mean"], batch["cov"], strict=True):
                m, n, mean = by_target[target], float(n), np.asarray(mean, float)
                cov = np.zeros((width + 1, width + 1))
                for (i, j), v in zip(pairs, flat, strict=True):
                    cov[i, j] = cov[j, i] = v
                k = len(m.predictors)
                usable = independent(cov, mean, n, range(k))
                kept = backward(cov, usable, width, n) if m.stepwise else usable
                slopes, rss = solve_subset(cov, kept, width, n)
                coef = {INTERCEPT: float(mean[width] - slopes @ mean[kept])}
                # a predictor that is aliased in a full model still has to be present for a prediction
                coef |= {} if m.stepwise else {m.predictors[c]: 0.0 for c in range(k)}
                coef |= {m.predictors[c]: float(s) for c, s in zip(kept, slopes, strict=True)}
                coefs.append(coef)
                sums.append(rss)
                scores.append(aic(rss, n, len(kept) + 1))
            out = batch.drop(columns=["mean", "cov"])
            yield out.assign(coef=coefs, rss=sums, aic=[s if np.isfinite(s) else None for s in scores])

    return solve


def model_columns(models: Sequence[Model]) -> tuple[list[str], list[tuple[int, int]]]:
    """All columns of the models in order, and the pairs of their numbers that stand in one model."""
    columns = list(dict.fromkeys(c for m in models for c in (*m.predictors, m.target)))
    at = columns.index
    pairs = {tuple(sorted((at(a), at(b)))) for m in models for a, b in combinations_with_replacement((*m.predictors, m.target), 2)}
    return columns, sorted(pairs)


def pattern_moments(df: DataFrame, keys: Sequence[str], models: Sequence[Model]) -> DataFrame:
    """``keys, there, n`` and ``m_i`` and ``c_i_j``, means and covariances of the rows of each pattern of present columns.

    Columns are numbered in the order of :func:`model_columns`; only pairs that some model needs are computed.
    """
    columns, pairs = model_columns(models)
    rows = df.select(*keys, *[F.col(c).cast("double").alias(f"__x{i}") for i, c in enumerate(columns)])
    present = F.array(*[F.col(f"__x{i}").isNotNull() for i in range(len(columns))])
    return rows.groupBy(*keys, present.alias("there")).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.avg(f"__x{i}").alias(f"m_{i}") for i in range(len(columns))],
        *[F.covar_pop(f"__x{i}", f"__x{j}").alias(f"c_{i}_{j}") for i, j in pairs],
    )


def fit_models(df: DataFrame, keys: Sequence[str], models: Sequence[Model]) -> DataFrame:
    """Fit all ``models`` per key from one aggregate: ``keys, target, n, coef, rss, aic``.

    Each model uses the rows complete in its target and all its predictors. Groups without such
    a row have no model.
    """
    models = list(models)
    width = max(len(m.predictors) for m in models)
    held = pattern_moments(df, keys, models)
    at = model_columns(models)[0].index
    zero = F.lit(0.0)
    cases = []
    for m in models:
        # shorter models are padded with zeros, which the solver never selects
        slots = [at(p) for p in m.predictors] + [None] * (width - len(m.predictors)) + [at(m.target)]
        mean = F.array(*[zero if i is None else F.col(f"m_{i}") for i in slots])
        cov = [zero if None in (i, j) else F.col(f"c_{min(i, j)}_{max(i, j)}") for i, j in combinations_with_replacement(slots, 2)]
        whole = reduce(lambda x, y: x & y, [F.col("there")[i] for i in slots if i is not None])
        cases.append(F.when(whole, F.struct(F.lit(m.target).alias("target"), mean.alias("mean"), F.array(*cov).alias("cov"))))
    parts = held.select(*keys, "n", F.inline(F.array_compact(F.array(*cases))))
    n = F.sum("n")
    model = Window.partitionBy(*keys, "target")  # rows are patterns of missing values
    both = parts.withColumn("__mean", F.array(*[F.sum(F.col("n") * F.col("mean")[i]).over(model) / n.over(model) for i in range(width + 1)]))
    apart = lambda i: F.col("mean")[i] - F.col("__mean")[i]
    # what a pattern adds to a covariance: its own and the distance of its means from those of all
    added = [F.sum(F.col("n") * (F.col("cov")[k] + apart(i) * apart(j))) / n for k, (i, j) in enumerate(combinations_with_replacement(range(width + 1), 2))]
    sums = both.groupBy(*keys, "target").agg(n.alias("n"), F.first("__mean").alias("mean"), F.array(*added).alias("cov"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sums.schema.fields if f.name not in ("mean", "cov"))
    return sums.mapInPandas(solve_models(models, width), f"{kept}, {MODEL_SCHEMA}")


def prediction(model: Model, coef: Column) -> Column:
    """Predicted value; NULL without a model or where a kept predictor is NULL."""
    total = coef[INTERCEPT]
    for p in model.predictors:
        total = total + F.when(coef[p].isNull(), 0.0).otherwise(coef[p] * F.col(p).cast("double"))
    return total


def fill(df: DataFrame, keys: Sequence[str], models: Sequence[Model], fits: DataFrame, flag: str | None = None):
    """Fill NULL targets by their models; observed values never change.

    ``flag`` names a prefix for boolean columns that tell which values were filled.
    """
    table = fits.groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct("target", "coef"))).alias("__coef")
    )
    rows = attach(df, table, keys)
    filled = {m.target: F.coalesce(F.col(m.target), prediction(m, F.col("__coef")[m.target])) for m in models}
    if flag:
        filled |= {
            f"{flag}{m.target}": F.col(m.target).isNull() & prediction(m, F.col("__coef")[m.target]).isNotNull()
            for m in models
        }
    return rows.withColumns(filled).drop("__coef")


def levels(steps: Sequence[Model]) -> list[list[Model]]:
    """Group the steps so that each one follows those listed before it whose targets it uses."""
    depth: dict[str, int] = {}
    out: list[list[Model]] = []
    for m in steps:
        if m.target in depth:
            raise ValueError(f"two steps for {m.target}")
        level = 1 + max([depth[p] for p in m.predictors if p in depth], default=-1)
        depth[m.target] = level
        while len(out) <= level:
            out.append([])
        out[level].append(m)
    return out


def impute_mean(df: DataFrame, col: str) -> DataFrame:
    """Replace NULL by the mean of the whole column."""
    return df.withColumn(col, F.coalesce(F.col(col).cast("double"), df.agg(F.avg(col)).scalar()))


def fill_from(df: DataFrame, keys: Sequence[str], targets: Sequence[str], predictor: str) -> DataFrame:
    """Fill each target by its line on one predictor per key; the predictor itself is never a target."""
    models = [Model(t, (predictor,)) for t in targets if t != predictor]
    return fill(df, keys, models, fit_models(df, keys, models))


def cascade(df: DataFrame, keys: Sequence[str], steps: Sequence[Model],
            after: Mapping[str, Callable[[DataFrame], DataFrame]] | None = None) -> DataFrame:
    """Run all steps level by level; ``after[target]`` is applied to the table once that target is filled.

    Per level the data rows are read once, for the aggregate, and once to be filled and written, so the next level reads a written table: neither
    fits nor joins of earlier levels are in its plan.
    """
    after = after or {}
    for i, level in enumerate(levels(steps)):
        df = materialize(df) if i else df
        df = fill(df, keys, level, fit_models(df, keys, level))
        for m in level:
            if m.target in after:
                df = after[m.target](df)
    return df
