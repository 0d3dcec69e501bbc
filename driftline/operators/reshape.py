"""Column choice, long and wide forms, recoding."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import split_name
from .joins import attach, null_safe_join

# A longer mapping becomes a table; a map literal is searched from the front for every row.
MAP_LITERALS = 64


# --- choice of columns -------------------------------------------------------------------------


def pick(
    df: DataFrame,
    contains: str | Sequence[str] = (),
    starts: str | Sequence[str] = (),
    ends: str | Sequence[str] = (),
    matches: str | None = None,
    without: str | None = None,
) -> list[str]:
    """Names that meet every given condition; within ``starts`` and ``ends`` any one is enough."""
    listed = lambda x: (x,) if isinstance(x, str) else tuple(x)
    names = [c for c in df.columns if all(part in c for part in listed(contains))]
    if starts:
        names = [c for c in names if c.startswith(listed(starts))]
    if ends:
        names = [c for c in names if c.endswith(listed(ends))]
    if matches:
        names = [c for c in names if re.search(matches, c)]
    if without:
        names = [c for c in names if not re.search(without, c)]
    return names


def between(df: DataFrame, first: str | None = None, last: str | None = None) -> list[str]:
    """Names from ``first`` to ``last`` in table order; an open end reaches to the edge."""
    names = df.columns
    lo = names.index(first) if first else 0
    hi = names.index(last) if last else len(names) - 1
    return names[lo : hi + 1]


# --- long and wide -----------------------------------------------------------------------------


def to_long(df: DataFrame, ids: Sequence[str], cols: Sequence[str], name: str = "variable", value: str = "value"):
    """Wide to long: one row per id row and column, values as double."""
    typed = df.select(*ids, *[F.col(c).cast("double").alias(c) for c in cols])
    return typed.unpivot(list(ids), list(cols), name, value)


def to_wide(df: DataFrame, keys: Sequence[str], name: str, values: Sequence[str], labels: Sequence[str],
            duplicates: str = "error", unlisted: str = "error") -> DataFrame:
    """Long to wide for a known list of labels; a row with another label is an error, or is passed over with ``unlisted="ignore"``.

    With one value column the new columns carry the label, with several ``value_label``. A cell with
    more than one row is an error, or is averaged with ``duplicates="mean"``.
    """
    aggs = []
    for v in values:
        for label in labels:
            cell = F.when(F.col(name) == F.lit(label), F.col(v))
            out = str(label) if len(values) == 1 else f"{v}_{label}"
            if duplicates == "mean":
                aggs.append(F.avg(cell).alias(out))
            else:
                rows = F.count(F.when(F.col(name) == F.lit(label), F.lit(1)))
                clash = F.raise_error(F.lit(f"more than one row for {name}={label}"))
                aggs.append(F.when(rows > 1, clash).otherwise(F.max(cell)).alias(out))
    out = df.groupBy(*keys).agg(*aggs, F.max(~F.col(name).isin(list(labels))).alias("__other"))
    if unlisted == "error":
        clash = F.raise_error(F.lit(f"a label of {name} is not in the list"))
        first = next(c for c in out.columns if c not in keys)
        out = out.withColumn(first, F.when(F.col("__other"), clash).otherwise(F.col(f"`{first}`")))
    return out.drop("__other")


def stack(*dfs: DataFrame) -> DataFrame:
    """Union by column name; columns a table lacks are NULL."""
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    return out


def with_extra_label(df: DataFrame, col: str, extra: str) -> DataFrame:
    """Every row twice: under its own label and under ``extra``; one scan."""
    return df.withColumn(col, F.explode(F.array(F.col(col), F.lit(extra))))


def unnest(df: DataFrame, arrays: Sequence[str]) -> DataFrame:
    """One row per position of several arrays of the same length."""
    rest = [c for c in df.columns if c not in arrays]
    return df.select(*rest, F.inline(F.arrays_zip(*[F.col(a) for a in arrays])))


def separate(df: DataFrame, col: str, parts: Sequence[str | None], sep: str = "_", keep: bool = False) -> DataFrame:
    """Split a text column into several."""
    pieces = split_name(F.col(col), parts, sep)
    out = df.withColumns({f"__p_{n}": e for n, e in pieces.items()})
    if not keep:
        out = out.drop(col)
    return out.drop(*[n for n in pieces if n in out.columns]).withColumnsRenamed({f"__p_{n}": n for n in pieces})


# --- recoding ----------------------------------------------------------------------------------


def recode(df: DataFrame, col: str, mapping: Mapping[str, str] | DataFrame, name: str | None = None, *,
           keep_unmatched: bool = True) -> DataFrame:
    """Many-to-one recode by a mapping, or by a table with columns ``from`` and ``to``.

    Unlisted values stay as they are, or become NULL without ``keep_unmatched``.
    """
    name = name or col
    if isinstance(mapping, DataFrame):
        table = mapping.groupBy(F.col("from").alias("__from")).agg(F.min("to").alias("__to"))
        rows = df.withColumn("__from", F.col(col))
        joined = attach(rows, table, ["__from"])
        to = F.col("__to")
        out = F.coalesce(to, F.col(col)) if keep_unmatched else to
        return joined.withColumn(name, out).drop("__from", "__to")
    if len(mapping) > MAP_LITERALS:
        pairs = df.sparkSession.createDataFrame(list(mapping.items()), ["from", "to"])
        return recode(df, col, pairs, name, keep_unmatched=keep_unmatched)
    to = F.element_at(F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv]), F.col(col))
    return df.withColumn(name, F.coalesce(to, F.col(col)) if keep_unmatched else to)


def bins(c: Column, ranges: Sequence[tuple[int, int, str]]) -> Column:
    """Label of the first integer range that holds the value; NULL outside all."""
    out = None
    for lo, hi, label in ranges:
        test = c.between(lo, hi)
        out = F.when(test, F.lit(label)) if out is None else out.when(test, F.lit(label))
    return out


def ordered_labels(df: DataFrame, col: str, labels: Mapping[str, str], order: Sequence[str] | None = None):
    """Display labels plus an integer order column ``<col>_ord``; unlisted values keep their text and order NULL."""
    shown = list(order) if order else list(dict.fromkeys(labels.values()))
    out = recode(df, col, labels)
    place = F.create_map(*[F.lit(x) for i, label in enumerate(shown) for x in (label, i + 1)])
    return out.withColumn(f"{col}_ord", F.element_at(place, F.col(col)))


def rename(df: DataFrame, **new_old: str) -> DataFrame:
    """``rename(df, new="old")``."""
    return df.withColumnsRenamed({old: new for new, old in new_old.items()})


def early_to_late(df: DataFrame, keys: Sequence[str], period: str, early: str, late: str, cols: Sequence[str],
                  required: str | None = None, flags: DataFrame | None = None) -> DataFrame:
    """Means per period side by side as ``<col>_early`` and ``<col>_late``; groups without both are left out."""
    aggs = []
    for c in cols:
        for tag, label in (("early", early), ("late", late)):
            aggs.append(F.avg(F.when(F.col(period) == label, F.col(c))).alias(f"{c}_{tag}"))
    need = [required] if required else list(cols)
    out = df.filter(F.col(period).isin(early, late)).groupBy(*keys).agg(*aggs)
    for c in need:
        out = out.filter(F.col(f"{c}_early").isNotNull() & F.col(f"{c}_late").isNotNull())
    return null_safe_join(out, flags, list(keys)) if flags is not None else out
