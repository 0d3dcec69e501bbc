"""Bootstrap intervals and permutation tests whose random numbers come from keys and counters.

A draw is a function of (row key, replicate) or of (row number, permutation), so a result depends neither on the partitioning nor on how often a task
is run, and no drawn row is ever written or shuffled: tasks draw in numpy blocks and hand on sums.
"""

from __future__ import annotations

import hashlib
import math
import sys
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.missing import if_else
from ..session import materialize
from .aggregate import with_scalars
from .joins import null_safe_join
from .ordered import numbered, running, ordered_blocks, BLOCK

# the solver travels with the plan, so workers need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Odd multipliers of the mixing function, and the step between counters.
FIRST, SECOND, STEP = 0x7FEB352D, 0x5BD1E995, 0x9E3779B9
ROWS_AT_ONCE = 256  # rows of a block of draws
SUMS_HELD = 1 << 22  # sums a task keeps before it hands them on
ROUNDS = 6  # of the keyed bijection
UNSURE = 255  # in place of a count that needs all bits of its draw
CELLS_AT_ONCE = 1 << 20  # cell bounds that travel to the tasks; more cells are taken in several passes


def poisson_limits(bits: int = 16) -> list[int]:
    """Upper limits of 0, 1, 2, … for a Poisson(1) count, in units of 2^-bits."""
    limits, mass = [], 0.0
    for k in range(20):
        mass += math.exp(-1.0) / math.factorial(k)
        if round(mass * 2**bits) >= 2**bits:
            break
        limits.append(round(mass * 2**bits))
    return limits


def random_numbers(first: np.ndarray, second: np.ndarray, counters: int) -> np.ndarray:
    """32 bits for each row and counter from two 32-bit seeds a row."""
    x = first[:, None] + np.arange(counters, dtype=np.uint32) * np.uint32(STEP)
    x ^= x >> np.uint32(16)
    x *= np.uint32(FIRST)
    x ^= x >> np.uint32(15)
    x += second[:, None]
    x *= np.uint32(SECOND)
    x ^= x >> np.uint32(16)
    return x


def poisson_counts(first: np.ndarray, second: np.ndarray, replicates: int, counts: np.ndarray) -> np.ndarray:
    """Counts (rows x replicates) from two 32-bit seeds a row: each counter gives 32 bits, which are the draws of two replicates."""
    x = random_numbers(first, second, -(-replicates // 2))
    return counts[x.astype("<u4", copy=False).view("<u2")][:, :replicates]


def coarse_counts(limits: np.ndarray) -> np.ndarray:
    """Count of a 32-bit draw by its upper 16 bits; ``UNSURE`` where a limit lies among the lower ones."""
    steps = np.arange(1 << 16, dtype=np.int64) << 16
    low, high = (np.searchsorted(limits, at, "right") for at in (steps, steps + 0xFFFF))
    return np.where(low == high, low, UNSURE).astype(np.uint8)


def fine_counts(first: np.ndarray, second: np.ndarray, replicates: int, limits: np.ndarray, coarse: np.ndarray) -> np.ndarray:
    """Counts (rows x replicates) from two 32-bit seeds a row: each counter gives the 32-bit draw of one replicate."""
    x = random_numbers(first, second, replicates)
    out = coarse[x >> np.uint32(16)]
    at = np.nonzero(out == UNSURE)
    out[at] = np.searchsorted(limits, x[at].astype(np.int64), "right")
    return out


def key_text(row_key: Sequence[str]) -> Column:
    """One text per row key: parts are escaped and NULL parts marked, so different keys give different texts."""
    part = lambda c: F.coalesce(F.replace(F.replace(F.col(c).cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|")), F.lit("\\N"))
    return F.concat_ws("|", *[part(c) for c in row_key])


def hex_number(digits: Column) -> Column:
    return F.conv(digits, 16, 10).cast("bigint")


def bootstrap_sums(df: DataFrame, keys: Sequence[str], values: Sequence[str], late: Column, row_key: Sequence[str], replicates: int, partitions: int | None,
                   draw_bits: int = 16) -> DataFrame:
    """``keys, rep`` and for each value and side the weighted sum and count, one row per group and replicate and task.

    A task turns each block of rows into a block of counts and multiplies it with the values, group by group.
    """
    m = len(values)
    digest = F.md5(key_text(row_key))
    rows = df.select(*keys, late.alias("__late"), digest.alias("__key"), *[F.col(v).cast("double").alias(f"__v{i}") for i, v in enumerate(values)])
    rows = rows.filter(F.col("__late").isNotNull()).repartition(partitions or df.sparkSession.sparkContext.defaultParallelism, "__key")
    rows = rows.withColumns({"__s1": hex_number(F.substring("__key", 1, 8)), "__s2": hex_number(F.substring("__key", 9, 8))}).drop("__key")
    fields = [rows.schema[k] for k in keys]
    sums = [f"__{kind}{i}_{side}" for side in ("early", "late") for kind in "sn" for i in range(m)]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + ["rep int"] + [f"{c} double" for c in sums])
    if draw_bits not in (16, 32):
        raise ValueError("a draw has 16 or 32 bits")
    limits = np.array(poisson_limits(draw_bits))
    if draw_bits == 16:
        counts = np.searchsorted(limits, np.arange(1 << 16), "right").astype(np.uint8)
        drawn = lambda first, second: poisson_counts(first, second, replicates, counts)
    else:
        coarse = coarse_counts(limits)
        drawn = lambda first, second: fine_counts(first, second, replicates, limits, coarse)
    n_keys = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        owners: dict[tuple, list[pa.Array]] = {}

        def handed_on() -> Iterator[pa.RecordBatch]:
            for key, total in held.items():
                of = [pa.concat_arrays([one]).take(pa.array(np.zeros(replicates, np.int64))) for one in owners[key]]
                yield pa.RecordBatch.from_arrays([*of, pa.array(np.arange(replicates, dtype=np.int32)), *(pa.array(c) for c in total.T)], names=names)

        names = [*keys, "rep", *sums]
        for batch in batches:
            tuples = list(zip(*[batch.column(i).to_pylist() for i in range(n_keys)])) if n_keys else [()] * batch.num_rows
            numbers: dict[tuple, int] = {}
            group = np.array([numbers.setdefault(t, len(numbers)) for t in tuples], np.int64)
            side = batch.column(n_keys).to_numpy(zero_copy_only=False).astype(np.int64)
            part = 2 * group + side
            order = np.argsort(part, kind="stable")
            v = [batch.column(n_keys + 1 + i) for i in range(m)]
            known = np.column_stack([c.is_valid().to_numpy(zero_copy_only=False) for c in v])
            filled = np.column_stack([c.fill_null(0.0).to_numpy(zero_copy_only=False) for c in v])
            columns = np.column_stack([filled, known])[order]
            first, second = (batch.column(n_keys + 1 + m + i).to_numpy().astype(np.uint32)[order] for i in (0, 1))
            part, starts = part[order], {}
            for at, g in enumerate(group.tolist()):
                starts.setdefault(g, at)
            for t, g in numbers.items():
                if t not in held:
                    held[t] = np.zeros((replicates, 4 * m))
                    owners[t] = [batch.column(i).slice(starts[g], 1) for i in range(n_keys)]
            by_number = list(numbers)
            ends = np.flatnonzero(np.diff(part, append=-1)) + 1
            at = 0
            for end in ends.tolist():
                total = held[by_number[part[at] // 2]][:, 2 * m * (part[at] % 2) :][:, : 2 * m]
                for low in range(at, end, ROWS_AT_ONCE):
                    high = min(end, low + ROWS_AT_ONCE)
                    total += drawn(first[low:high], second[low:high]).T.astype(float) @ columns[low:high]
                at = end
            if len(held) * replicates * 4 * m > SUMS_HELD:
                yield from handed_on()
                held.clear(), owners.clear()
        yield from handed_on()

    return rows.select(*keys, "__late", *[f"__v{i}" for i in range(m)], "__s1", "__s2").mapInArrow(run, schema)


def bootstrap_replicates(df: DataFrame, keys: Sequence[str], values: Sequence[str], late: Column,
                         row_key: Sequence[str], replicates: int = 1000, partitions: int | None = None, draw_bits: int = 16) -> DataFrame:
    """Replicated mean differences, late minus early: ``keys, metric, rep, diff``.

    Resampling n rows with replacement is approximated by giving each row an independent Poisson(1) count (to 2^-16, or 2^-32 with ``draw_bits`` of 32),
    which agrees for growing n. A replicate in which a side has no rows is NULL. The rows are never copied
    to one place: each task adds up weighted sums per (group, side, replicate) before the shuffle.
    Rows with the same ``row_key`` would share their counts, so it has to be unique; NULL parts of a key count as a value of their own.
    ``partitions`` is the number of tasks that rows are dealt to, as many as the cluster runs at once if not given.
    """
    sums = bootstrap_sums(df, keys, values, late, row_key, replicates, partitions, draw_bits)
    added = sums.groupBy(*keys, "rep").agg(*[F.sum(c).alias(c) for c in sums.columns[len(keys) + 1 :]])
    mean = lambda i, side: F.try_divide(F.col(f"__s{i}_{side}"), F.col(f"__n{i}_{side}"))
    cells = [F.struct(F.lit(v).alias("metric"), "rep", (mean(i, "late") - mean(i, "early")).alias("diff")) for i, v in enumerate(values)]
    return added.select(*keys, F.inline(F.array(*cells)))


def bootstrap_interval(df: DataFrame, keys: Sequence[str], values: Sequence[str], late: Column,
                       row_key: Sequence[str], replicates: int = 1000, conf: float = 0.95, partitions: int | None = None,
                       draw_bits: int = 16) -> DataFrame:
    """Percentile interval of the mean difference: ``keys, metric, lower, upper, significant, linetype``."""
    reps = bootstrap_replicates(df, keys, values, late, row_key, replicates, partitions, draw_bits)
    tail = (1 - conf) / 2
    # each group holds exactly `replicates` rows, so the exact percentile is bounded
    out = reps.groupBy(*keys, "metric").agg(
        F.percentile("diff", F.lit(tail)).alias("lower"), F.percentile("diff", F.lit(1 - tail)).alias("upper")
    )
    out = out.withColumn("significant", (F.col("lower") > 0) | (F.col("upper") < 0))
    return out.withColumn("linetype", if_else(F.col("significant"), "solid", "dashed"))


# --- permutational analysis of variance --------------------------------------------------------


def permutation_keys(permutations: int) -> np.ndarray:
    """32-bit keys of each permutation's rounds, for permutations from 1."""
    key = lambda p, t: int(hashlib.md5(f"{p}|{t}".encode()).hexdigest()[:8], 16)
    return np.array([[key(p, t) for t in range(ROUNDS)] for p in range(1, permutations + 1)], np.uint32).reshape(-1, ROUNDS)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 32-bit number in which every bit depends on all of ``x``."""
    x = x ^ (x >> np.uint32(16))
    x *= np.uint32(FIRST)
    x ^= x >> np.uint32(15)
    x *= np.uint32(SECOND)
    x ^= x >> np.uint32(16)
    return x


def permuted_numbers(numbers: np.ndarray, rows: int, keys: np.ndarray) -> np.ndarray:
    """Where each of ``numbers`` (below ``rows``) goes under each key: a bijection of 0 .. rows - 1 (permutations x numbers).

    A number is a pair of digits; rounds in turn add a keyed mix of one to the other. The pairs are a few more than the rows, so a number that
    comes out too large is sent through again until it is one of them.
    """
    a = math.isqrt(max(rows - 1, 0)) + 1
    b = -(-rows // a)
    out = np.broadcast_to(numbers.astype(np.int64), (len(keys), len(numbers))).copy()
    again = np.ones(out.shape, bool)
    while again.any():
        which = np.nonzero(again)[0]
        left, right = np.divmod(out[again], b)
        for t in range(ROUNDS):
            k = keys[which, t]
            if t % 2 == 0:
                left = (left + mixed(right.astype(np.uint32) + k)) % a
            else:
                right = (right + mixed(left.astype(np.uint32) + k)) % b
        out[again] = left * b + right
        again = out >= rows
    return out


def cell_bounds(rows: DataFrame, factors: Sequence[str], blocks: int | None = None) -> DataFrame:
    """``factors, n, cell, start``: the cells in order, their number from 0, and how many rows lie before them. Written."""
    cells = materialize(rows.groupBy(*factors).agg(F.count(F.lit(1)).alias("n")))
    one = F.lit(1).cast("bigint")
    cut = running(ordered_blocks(cells, [], list(factors), blocks), [], list(factors), {"__upto": ("sum", F.col("n"), "up"), "__at": ("sum", one, "up")})
    return materialize(cut.select(*factors, "n", (F.col("__at") - 1).alias("cell"), (F.col("__upto") - F.col("n")).alias("start")))


def permuted_sums(rows: DataFrame, cells: DataFrame, row_key: str, features: Sequence[str], permutations: int, blocks: int | None = None) -> DataFrame:
    """``perm, cell, features``: sums per cell after the factor rows were permuted, for permutations from 1.

    Think of the factor rows as sorted: row number j has the factors of the cell that j falls into, so a row with number i that goes to j needs j and the cells' bounds
    alone. Rows are numbered once by ``row_key``; ties are broken somehow. Only sums leave the tasks.
    """
    spaced = numbered(rows.select(row_key, *features), [], [row_key], "__number", blocks).select("__number", *features)
    total, n_cells = cells.agg(F.sum("n"), F.count(F.lit(1))).first()
    if not total or not permutations:
        return rows.sparkSession.createDataFrame([], "perm int, cell bigint, " + ", ".join(f"`{c}` double" for c in features))
    keys = permutation_keys(permutations)
    names = ["perm", "cell", *features]
    tasks = rows.sparkSession.sparkContext.defaultParallelism
    spaced = materialize(spaced).repartition(tasks, "__number")

    def summed(low: int, starts: np.ndarray, end: int):
        width, wide = len(starts), len(features)
        dense = permutations * width * wide <= SUMS_HELD

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = np.zeros((wide, permutations * width)) if dense else None

            def out(cells: np.ndarray, sums) -> pa.RecordBatch:
                ids = [pa.array((cells // width + 1).astype(np.int32)), pa.array(cells % width + low)]
                return pa.RecordBatch.from_arrays([*ids, *(pa.array(s) for s in sums)], names=names)

            for batch in batches:
                for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                    part = batch.slice(at, ROWS_AT_ONCE)
                    to = permuted_numbers(part.column(0).to_numpy(), total, keys)
                    inside = (to >= starts[0]) & (to < end)
                    which, column = np.nonzero(inside)
                    cell = np.searchsorted(starts, to[inside], "right") - 1 + which * width
                    v = [part.column(1 + i).to_numpy()[column] for i in range(wide)]
                    if dense:
                        for i in range(wide):
                            held[i] += np.bincount(cell, weights=v[i], minlength=permutations * width)
                    else:
                        met, place = np.unique(cell, return_inverse=True)
                        yield out(met, [np.bincount(place, weights=x, minlength=len(met)) for x in v])
            if dense:
                yield out(np.arange(permutations * width), held)

        return spaced.mapInArrow(run, "perm int, cell bigint, " + ", ".join(f"`{c}` double" for c in features))

    made = None
    for low in range(0, n_cells, CELLS_AT_ONCE):
        some = cells.filter((F.col("cell") >= low) & (F.col("cell") < low + CELLS_AT_ONCE)).select("start", "n").toArrow()
        order = np.argsort(some["start"].to_numpy())
        starts, sizes = some["start"].to_numpy()[order], some["n"].to_numpy()[order]
        sums = summed(low, starts, int(starts[-1] + sizes[-1]))
        made = sums if made is None else made.unionByName(sums)
    return made.groupBy("perm", "cell").agg(*[F.sum(c).alias(c) for c in features])


def squares(columns: Sequence[str]) -> Column:
    return reduce(lambda x, y: x + y, [F.col(c) * F.col(c) for c in columns])


def term_sums(sums: DataFrame, cells: DataFrame, factors: Sequence[str], features: Sequence[str]) -> DataFrame:
    """``perm, ss1, ss2, ss3, df1, df2, df3`` of two factors and their interaction, sequentially, from sums per (permutation, cell).

    Rows per cell are the same in every permutation, so the normal equations of the factor with fewer levels, after the other one is eliminated by grouped
    aggregates, are set up and inverted once; their size is the number of those levels.
    """
    levels = cells.agg(*[F.count_distinct(F.struct(f)).alias(f"n{i}") for i, f in enumerate(factors)], F.count(F.lit(1)).alias("c")).first()
    big, small = (0, 1) if levels["n0"] >= levels["n1"] else (1, 0)
    first, second = factors[big], factors[small]
    of_small = cells.select(F.col(second).alias("__b")).distinct()
    of_small = numbered(of_small, [], ["__b"], "__level")
    marked = materialize(cells.join(of_small, F.col(second).eqNullSafe(F.col("__b"))).drop("__b"))
    n_big = marked.groupBy(first).agg(F.sum("n").cast("double").alias("__nbig"))
    width = levels[f"n{small}"]

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram = np.zeros((width, width))
        for batch in batches:
            for held, n, whole in zip(*[batch.column(i).to_pylist() for i in range(3)]):
                x = np.zeros(width)
                x[held] = n
                gram += np.diag(x) - np.outer(x, x) / whole
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width)), pa.array(gram.tolist())], names=["b", "row"])

    per_big = marked.groupBy(first).agg(F.collect_list("__level").alias("held"), F.collect_list(F.col("n").cast("double")).alias("n"), F.sum("n").cast("double").alias("whole"))
    gram = per_big.select("held", "n", "whole").mapInArrow(products, "b bigint, row array<double>")
    gram = gram.select("b", F.posexplode("row").alias("c", "v")).groupBy("b", "c").agg(F.sum("v").alias("v")).collect()
    matrix = np.zeros((width, width))
    for b, c, v in gram:
        matrix[b, c] = v
    inverse = np.linalg.pinv(matrix, rcond=1e-10, hermitian=True)
    rank = int(np.linalg.matrix_rank(matrix, tol=1e-10 * max(1.0, np.abs(matrix).max()), hermitian=True))

    met = sums.join(null_safe_join(marked, materialize(n_big), [first]).select("cell", first, "__level", "n", "__nbig"), "cell")
    met = materialize(met.withColumnRenamed(first, "__big"))
    by_big = met.groupBy("perm", "__big").agg(F.first("__nbig").alias("__nbig"), *[F.sum(c).alias(c) for c in features])
    ss_cells = met.groupBy("perm").agg(F.sum(squares(features) / F.col("n")).alias("ss_cells"))
    ss_big = by_big.groupBy("perm").agg(F.sum(squares(features) / F.col("__nbig")).alias("ss_big"))
    means = by_big.select("perm", "__big", *[(F.col(c) / F.col("__nbig")).alias(f"__m_{c}") for c in features])
    apart = null_safe_join(met, means, ["perm", "__big"])
    rhs = apart.groupBy("perm", "__level").agg(
        F.sum("n").cast("double").alias("__ns"), *[F.sum(c).alias(c) for c in features], *[F.sum(F.col(c) - F.col("n") * F.col(f"__m_{c}")).alias(f"__r_{c}") for c in features])
    packed = rhs.groupBy("perm").agg(
        F.sum(squares(features) / F.col("__ns")).alias("ss_small"),
        F.sort_array(F.collect_list(F.struct("__level", F.array(*[F.col(f"__r_{c}") for c in features]).alias("r")))).alias("c"),  # one entry per level of the smaller factor
    ).select("perm", "ss_small", F.col("c.__level").alias("at"), F.col("c.r").alias("r"))

    def explained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for at, r in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                full = np.zeros((width, len(features)))
                full[at] = r
                out.append(float((full * (inverse @ full)).sum()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.float64())], names=["perm", "ss_small", "more"])

    more = packed.mapInArrow(explained, "perm int, ss_small double, more double")
    both = more.join(ss_big, "perm").join(ss_cells, "perm")
    additive = F.col("ss_big") + F.col("more")
    ss1 = F.col("ss_big") if big == 0 else F.col("ss_small")
    df1 = levels["n0"] - 1
    df2 = levels[f"n{big}"] + rank - levels["n0"]
    df3 = levels["c"] - levels[f"n{big}"] - rank
    return both.select("perm", ss1.alias("ss1"), (additive - ss1).alias("ss2"), (F.col("ss_cells") - additive).alias("ss3"),
                       F.lit(df1).alias("df1"), F.lit(df2).alias("df2"), F.lit(df3).alias("df3"))


def permanova(df: DataFrame, row_key: str, factors: Sequence[str], features: Sequence[str], permutations: int = 999,
              interaction: bool = True, blocks: int | None = None) -> DataFrame:
    """Euclidean permutational analysis of variance by one or two factors, sequential terms; cells may be unbalanced or empty.

    Returns ``term, df, ss, r2, f, p`` with rows for the residual and the total. No distance matrix is
    formed: for Euclidean distances all sums of squares follow from group sums. Only sums per (permutation, cell) are shuffled.
    """
    if len(factors) not in (1, 2):
        raise ValueError("one or two factors")
    use = [row_key, *factors, *features]
    rows = df.select(*use).dropna(subset=list(features) + list(factors))
    rows = rows.withColumns({c: F.col(c).cast("double") for c in features})
    centred = with_scalars(rows, **{c: F.avg(c) for c in features})
    rows = materialize(centred.withColumns({c: F.col(c) - F.col("__s")[c] for c in features}).drop("__s"))
    overall = rows.agg(F.sum(squares(features)).alias("sst"), F.count(F.lit(1)).alias("rows"))

    cells = cell_bounds(rows, factors, blocks)
    seen = null_safe_join(rows.groupBy(*factors).agg(*[F.sum(c).alias(c) for c in features]), cells.select(*factors, "cell"), list(factors))
    seen = seen.select(F.lit(0).alias("perm"), "cell", *features)
    sums = materialize(seen.unionByName(permuted_sums(rows, cells, row_key, features, permutations, blocks)))
    if len(factors) == 1:
        # features are centred, so the correction term is zero
        terms = sums.join(cells.select("cell", "n"), "cell").groupBy("perm").agg(
            F.sum(squares(features) / F.col("n")).alias("ss1"), (F.count(F.lit(1)) - 1).cast("int").alias("df1")
        )
        names = list(factors)
    else:
        terms = term_sums(sums, cells, factors, features)
        if not interaction:
            terms = terms.drop("ss3", "df3")
        names = [factors[0], factors[1], f"{factors[0]}:{factors[1]}"][: 3 if interaction else 2]
    k = len(names)
    plus = lambda cols: reduce(lambda x, y: x + y, cols)
    terms = with_scalars(terms, overall, sst=F.max("sst"), rows=F.max("rows"))
    terms = terms.withColumns(
        {
            "sst": F.col("__s.sst"),
            "dft": (F.col("__s.rows") - 1).cast("int"),
            "dfr": (F.col("__s.rows") - 1).cast("int") - plus([F.col(f"df{i + 1}") for i in range(k)]),
        }
    )
    terms = terms.withColumn("ssr", F.col("sst") - plus([F.col(f"ss{i + 1}") for i in range(k)]))
    stat = lambda i: F.try_divide(
        F.try_divide(F.col(f"ss{i}"), F.col(f"df{i}")), F.try_divide(F.col("ssr"), F.col("dfr"))
    )
    long = terms.select(
        "perm",
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(i + 1).alias("ord"), F.lit(name).alias("term"), F.col(f"df{i + 1}").alias("df"),
                        F.col(f"ss{i + 1}").alias("ss"), stat(i + 1).alias("f"),
                    )
                    for i, name in enumerate(names)
                ],
                F.struct(F.lit(k + 1).alias("ord"), F.lit("residual").alias("term"), F.col("dfr").alias("df"),
                         F.col("ssr").alias("ss"), F.lit(None).cast("double").alias("f")),
                F.struct(F.lit(k + 2).alias("ord"), F.lit("total").alias("term"),
                         F.col("dft").alias("df"), F.col("sst").alias("ss"),
                         F.lit(None).cast("double").alias("f")),
            )
        ),
        "sst",
    )
    long = materialize(long)
    seen = long.filter(F.col("perm") == 0)
    drawn = long.filter(F.col("perm") > 0).select(F.col("term").alias("__t"), F.col("f").alias("__f"))
    hits = drawn.join(F.broadcast(seen.select("term", F.col("f").alias("f0"))), F.col("__t") == F.col("term"))
    p = hits.groupBy("__t").agg(
        F.when(
            F.max("f0").isNotNull(),
            (F.sum((F.col("__f") >= F.col("f0") - 1.5e-8).cast("long")) + 1) / (F.count(F.lit(1)) + 1),
        ).alias("p")
    )
    return (
        seen.join(F.broadcast(p), seen["term"] == p["__t"], "left")
        .select("ord", "term", "df", "ss", F.try_divide(F.col("ss"), F.col("sst")).alias("r2"), "f", "p")
    )
