"""Ordered computations over groups of any size.

A window over one large group runs in one task. The operators here cut the ordered rows
into blocks first: rows are range-partitioned by (keys, order), every row keeps the number of
its partition, and the result is written so that the numbers stay fixed. Windows then run per (keys, block).
What has to flow between blocks is small: at most one group reaches into a block from the
block before and at most one from the block after, so the carry table has at most two rows per
block, which bounds its broadcast by the number of shuffle partitions. A range partition whose bounds would
have to be agreed on twice could not be used like this; a written one can.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType
from pyspark.sql.window import WindowSpec

from ..session import materialize
from .joins import attach, null_safe_join

BLOCK = "__block"
SKETCH = 1000  # a quantile sketch is off by one rank in so many; three times that on either side is looked into exactly
AT, PART = "__at", "__part"
# A running aggregate is one of these; each can be continued from the same aggregate of the earlier blocks.
_COMBINE = {"sum": lambda a, b: a + b, "min": F.least, "max": F.greatest}
_AGG = {"sum": F.sum, "min": F.min, "max": F.max}


def ordered_blocks(df: DataFrame, keys: Sequence[str], order: Sequence[str], blocks: int | None = None) -> DataFrame:
    """Rows with a block number that never decreases in (keys, order).

    The rows are written with their numbers. ``blocks`` asks for a number of blocks; without it, adaptive execution decides. Rows
    equal in keys and order share a block, so give ``order`` enough columns, or aggregate equal rows first.
    """
    by = [F.col(c).asc_nulls_first() for c in [*keys, *order]]
    ranged = df.repartitionByRange(blocks, *by) if blocks else df.repartitionByRange(*by)
    return materialize(ranged.withColumn(BLOCK, F.spark_partition_id()))


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    spec: dict[str, tuple[str, Column, str]],
) -> DataFrame:
    """Running aggregates over the ordered rows of each group, of the rows of :func:`ordered_blocks`.

    ``spec`` maps an output name to (``sum`` | ``min`` | ``max``, expression, ``up`` | ``down`` | ``all``). ``up``
    covers the start of the group to the row, ``down`` the row to the end, ``all`` the group. NULLs are skipped.
    """
    keys = list(keys)
    rows = df.withColumns({f"__in_{n}": e for n, (_, e, _) in spec.items()})
    frames = group_frames([*keys, BLOCK], order, 0)
    local = rows.withColumns({f"__loc_{n}": _AGG[kind](f"__in_{n}").over(frames[way]) for n, (kind, _, way) in spec.items()})
    carry = carried(rows, keys, {n: (kind, F.col(f"__in_{n}"), way) for n, (kind, _, way) in spec.items()})
    joined = null_safe_join(local, carry, [*keys, BLOCK], "left", small=True)
    out = {}
    for n, (kind, _, way) in spec.items():
        loc, car = F.col(f"__loc_{n}"), F.col(f"__carry_{n}")
        both = car if way == "all" else _COMBINE[kind](loc, car)
        out[n] = F.when(loc.isNull(), car).when(car.isNull(), loc).otherwise(both)
    return joined.withColumns(out).drop(*[f"__{part}_{n}" for part in ("in", "loc", "carry") for n in spec])


def group_frames(keys: Sequence[str], order: Sequence[str], end: int) -> dict[str, WindowSpec]:
    """Frames from either end of a group to the row (``end`` 0) or to the one before it (-1), and the whole group."""
    up = Window.partitionBy(*keys).orderBy(*[F.col(c).asc_nulls_first() for c in order])
    down = Window.partitionBy(*keys).orderBy(*[F.col(c).desc_nulls_last() for c in order])
    return {
        "up": up.rowsBetween(Window.unboundedPreceding, end),
        "down": down.rowsBetween(Window.unboundedPreceding, end),
        "all": Window.partitionBy(*keys),
    }


def carried(rows: DataFrame, keys: Sequence[str], spec: dict[str, tuple[str, Column, str]]) -> DataFrame:
    """What reaches each block of a group that spans several: ``keys, block, __carry_<name>``, two rows per block at most."""
    totals = rows.groupBy(*keys, BLOCK).agg(*[_AGG[kind](e).alias(f"__tot_{n}") for n, (kind, e, _) in spec.items()])
    frames = group_frames(keys, [BLOCK], -1)
    spanned = F.count(F.lit(1)).over(frames["all"])
    return (
        totals.withColumns(
            {"__parts": spanned}
            | {f"__carry_{n}": _AGG[kind](f"__tot_{n}").over(frames[way]) for n, (kind, _, way) in spec.items()}
        )
        .filter(F.col("__parts") > 1)
        .select(*keys, BLOCK, *[f"__carry_{n}" for n in spec])
    )


def value_counts(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """One row per distinct non-NULL value with the number of rows ``cnt``."""
    return df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("cnt"))


def distinct_ranks(df: DataFrame, keys: Sequence[str], value: str, blocks: int | None = None) -> DataFrame:
    """One row per distinct non-NULL value: ``cnt`` equal rows, ``below`` smaller ones, ``total`` in the group.

    Counting equal values first means that a value which holds most of a group travels as one row.
    """
    return ranks_of_counts(value_counts(df, keys, value), keys, value, blocks)


def ranks_of_counts(counts: DataFrame, keys: Sequence[str], value: str, blocks: int | None = None) -> DataFrame:
    """:func:`distinct_ranks` of values that are already counted."""
    cnt = F.col("cnt")
    ranked = running(
        ordered_blocks(counts, keys, [value], blocks),
        keys,
        [value],
        {"__up": ("sum", cnt, "up"), "total": ("sum", cnt, "all")},
    )
    return ranked.withColumn("below", F.col("__up") - cnt).drop("__up", BLOCK)


def quantiles_of_ranks(ranked: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Quantiles from :func:`distinct_ranks`: the order statistics are picked by a partial aggregate."""
    holds = lambda pos: (F.col("below") <= pos) & (pos < F.col("below") + F.col("cnt"))
    aggs = [F.max("total").alias("n")]
    for name, p in probs.items():
        low = F.floor((F.col("total") - 1) * F.lit(float(p)))
        high = F.least(low + 1, F.col("total") - 1)
        aggs += [
            F.max(F.when(holds(low), F.col(value))).alias(f"__lo_{name}"),
            F.max(F.when(holds(high), F.col(value))).alias(f"__hi_{name}"),
        ]
    result = {}
    for name, p in probs.items():
        at = (F.col("n") - 1) * F.lit(float(p))
        share = at - F.floor(at)
        low, high = F.col(f"__lo_{name}"), F.col(f"__hi_{name}")
        result[name] = F.when(low == high, low).otherwise(low + share * (high - low))  # equal infinities have no difference
    return ranked.groupBy(*keys).agg(*aggs).withColumns(result).select(*keys, "n", *probs)


def quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float], blocks: int | None = None, sketch: int = SKETCH
) -> DataFrame:
    """Exact quantiles per group, linear between the two nearest order statistics; no group is gathered or sorted.

    ``probs`` maps output names to probabilities. Mergeable sketches give each probability a bracket, one counting pass keeps the values inside and
    counts what lies between, and the order statistics come from those counts. A group whose statistic lies outside its bracket, and values
    that are not numbers, are counted value by value and ordered in blocks. A group without a value has no row.
    """
    keys = list(keys)
    if not isinstance(df.schema[value].dataType, NumericType):
        return quantiles_of_counts(ordered_blocks(value_counts(df, keys, value), keys, [value], blocks), keys, value, probs)
    rows = df.filter(F.col(value).isNotNull()).select(*keys, value)
    kept = ordered_blocks(bracket_counts(rows, keys, value, list(probs.values()), sketch), keys, [AT, PART], blocks)
    found = materialize(quantiles_of_counts(kept, keys, value, probs, [AT, PART]))
    missed = reduce(lambda a, b: a | b, [F.col(p).isNull() for p in probs]) & F.col("n").isNotNull()
    if found.filter(missed).isEmpty():
        return found
    rest = null_safe_join(rows, found.filter(missed).select(*keys), keys, "left_semi") if keys else rows
    again = quantiles_of_counts(ordered_blocks(value_counts(rest, keys, value), keys, [value], blocks), keys, value, probs)
    return found.filter(~missed).unionByName(again)


def bracket_counts(rows: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float], sketch: int = SKETCH) -> DataFrame:
    """Counted values of :func:`quantiles`: every value inside a bracket; of a stretch outside, its ends and the number of rows between them.

    The rows between have no ``value``; ``__at, __part`` order all. Whatever the sketch says, the counts are exact.
    """
    v, near = F.col(value), 3.0 / sketch
    ends = [e for p in probs for e in (max(p - near, 0.0), min(p + near, 1.0))]
    edges = rows.groupBy(*keys).agg(F.percentile_approx(value, ends, sketch).alias("__edges"))
    edge = [F.get("__edges", F.lit(i)) for i in range(len(ends))]
    inside = reduce(lambda a, b: a | b, [(v >= lo) & (v <= hi) for lo, hi in zip(edge[::2], edge[1::2])])
    passed = reduce(lambda a, b: a + b, [((v >= e) if i % 2 == 0 else (v > e)).cast("int") for i, e in enumerate(edge)])
    marked = attach(rows, edges, keys, "inner" if keys else "left").select(*keys, v, passed.alias("__passed"), F.when(inside, v).alias("__in"))
    cells = marked.groupBy(*keys, "__passed", "__in").agg(F.count(F.lit(1)).alias("__n"), F.min(value).alias("__lo"), F.max(value).alias("__hi"))
    lo, hi, n, one = F.col("__lo"), F.col("__hi"), F.col("__n"), F.lit(1).cast("long")
    part = lambda x, at, number, cnt: F.struct(x.alias(value), at.alias(AT), F.lit(number).alias(PART), cnt.alias("cnt"))
    flat = lo == hi
    parts = F.array(part(lo, lo, 0, F.when(flat, n).otherwise(one)), part(F.when(flat, lo), lo, 1, F.when(flat, 0 * n).otherwise(n - 2)),
                    part(hi, hi, 2, F.when(flat, 0 * n).otherwise(one)))
    return cells.select(*keys, F.inline(parts)).filter("cnt > 0")


def quantiles_of_counts(cut: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float], order: Sequence[str] = ()) -> DataFrame:
    """:func:`quantiles` of counted values that are already in blocks of ``order``, by default the value itself.

    Of a group that spans several blocks, only the blocks which hold one of its order statistics are looked into.
    """
    cnt = F.col("cnt")
    frames = group_frames(keys, [BLOCK], -1)
    spans = cut.groupBy(*keys, BLOCK).agg(F.sum("cnt").alias("__held")).withColumns(
        {"__before": F.coalesce(F.sum("__held").over(frames["up"]), F.lit(0)), "total": F.sum("__held").over(frames["all"])}
    )
    lows = [F.floor((F.col("total") - 1) * F.lit(float(p))) for p in probs.values()]
    needed = reduce(
        lambda a, b: a | b,
        [(at >= F.col("__before")) & (at < F.col("__before") + F.col("__held")) for low in lows for at in (low, low + 1)],
    )
    rows = attach(cut, spans.filter(needed).drop("__held"), [*keys, BLOCK], "inner")
    up = F.sum("cnt").over(group_frames([*keys, BLOCK], list(order) or [value], 0)["up"])
    return quantiles_of_ranks(rows.withColumn("below", F.col("__before") + up - cnt), keys, value, probs)


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "pos", blocks: int | None = None):
    """Row number from 0 in each group, without a window over a whole group."""
    return running(
        ordered_blocks(df, keys, order, blocks), keys, order, {name: ("sum", F.lit(1).cast("long"), "up")}
    ).withColumn(name, F.col(name) - 1).drop(BLOCK)


def centred_window(
    df: DataFrame,
    keys: Sequence[str],
    pos: str,
    half_width: int,
    stages: Sequence[Callable[[WindowSpec], dict[str, Column]]],
    tile: int = 65_536,
) -> DataFrame:
    """Columns from the ``half_width`` rows on either side of each row, by row number ``pos``.

    Each stage gets the window and returns its columns; a later stage may use those of an earlier one. A group is
    cut into tiles of ``tile`` rows; each tile also gets the rows around it that its frames reach through all
    stages, so every frame of its own rows is complete, no task sees more than a tile, and all stages share one shuffle.
    """
    halo = half_width * len(stages)
    tile = max(tile, 2 * halo)
    own = lambda p: F.floor(p / F.lit(float(tile))).cast("long")
    p = F.col(pos)
    near = F.array_distinct(F.array(own(p), own(p - halo), own(p + halo)))
    out = df.withColumn("__tile", F.explode(near))
    w = Window.partitionBy(*keys, "__tile").orderBy(pos).rangeBetween(-half_width, half_width)
    for stage in stages:
        out = out.withColumns(stage(w))
    return out.filter(F.col("__tile") == own(p)).drop("__tile")
