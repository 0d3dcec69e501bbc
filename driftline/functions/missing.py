"""Column helpers that fix how missing values behave.

Spark's ``when`` treats a NULL condition as false, ``greatest`` skips NULLs and a
``NaN`` is an ordinary large value. Statistics code wants the opposite in all three
cases: a missing input gives a missing output.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def nan_to_null(c: Column, infinite: bool = False) -> Column:
    """NaN of a double column becomes NULL, with ``infinite`` infinities do too."""
    odd = F.isnan(c) | (F.abs(c) == F.lit(float("inf"))) if infinite else F.isnan(c)
    return F.when(odd, F.lit(None)).otherwise(c)


def clean_missing(df: DataFrame) -> DataFrame:
    """Apply :func:`nan_to_null` to every float and double column of ``df``."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: nan_to_null(F.col(c)) for c in floats}) if floats else df


def if_else(cond: Column, yes, no) -> Column:
    """Two-way choice whose result is NULL where the condition is NULL."""
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.when(cond, as_col(yes)).when(~cond, as_col(no))


def is_in(c: Column, values: Iterable, *, null_is_false: bool = False) -> Column:
    """Membership test. With ``null_is_false`` a NULL input gives false, not NULL."""
    test = c.isin(*values)
    return F.coalesce(test, F.lit(False)) if null_is_false else test


def floor_at(c: Column, low) -> Column:
    """Element-wise maximum with ``low``; NULL stays NULL."""
    return F.when(c.isNotNull(), F.greatest(c, F.lit(low) if not isinstance(low, Column) else low))


def cap_at(c: Column, high) -> Column:
    """Element-wise minimum with ``high``; NULL stays NULL."""
    return F.when(c.isNotNull(), F.least(c, F.lit(high) if not isinstance(high, Column) else high))


def to_number(c: Column, infinite: bool = False) -> Column:
    """Text to double: anything that is not a number becomes NULL, with ``infinite`` so do infinities."""
    return nan_to_null(F.trim(c).try_cast("double"), infinite)


def row_mean(cols: Iterable[Column]) -> Column:
    """Mean of several columns of one row, ignoring NULLs; NULL if all are NULL."""
    cols = list(cols)
    total = reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0.0)) for c in cols])
    present = reduce(lambda a, b: a + b, [c.isNotNull().cast("int") for c in cols])
    return F.try_divide(total, present)


def percent_difference(value: Column, base: Column) -> Column:
    """``(value - base) / base * 100``; NULL for a zero base."""
    return F.try_divide(value - base, base) * 100


def round_even(c: Column, digits: int) -> Column:
    """Round half to even at ``digits`` decimals."""
    return F.bround(c, digits)


def signif(c: Column, digits: int) -> Column:
    """Round to ``digits`` significant digits; zero stays zero."""
    scale = F.pow(F.lit(10.0), F.lit(digits - 1) - F.floor(F.log10(F.abs(c))))
    return F.when(c == 0, F.lit(0.0)).when(c.isNotNull(), F.bround(c * scale) / scale)
