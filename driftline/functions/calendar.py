"""Dates, seasons and season-years."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .missing import is_in

# The two seasons every report of this kind uses, as month numbers.
SEASONS = {"warm": (6, 7, 8, 9), "cool": (10, 11, 12, 1, 2, 3, 4, 5)}

# Months whose observations count towards the following season-year.
CARRY_MONTHS = (10, 11, 12)

# Year-month-day notations accepted by parse_date.
DATE_FORMATS = ("yyyy-MM-dd", "yyyy/MM/dd", "yyyyMMdd", "yyyy.MM.dd", "yyyy-M-d", "yyyy/M/d")


def parse_date(c: Column, formats: Sequence[str] = DATE_FORMATS) -> Column:
    """First year-month-day notation that fits; NULL if none does."""
    text = F.trim(c.cast("string"))
    return F.coalesce(*[F.to_date(F.try_to_timestamp(text, F.lit(f))) for f in formats])


def season(month: Column, seasons: Mapping[str, Sequence[int]] = SEASONS, *, other: str | None = None) -> Column:
    """Season label of a month number.

    A month outside every season, NULL included, gives NULL, or ``other`` where one is
    named (the two-way form in which everything that is not warm counts as cool).
    """
    choice = None
    for label, months in seasons.items():
        test = is_in(month, months, null_is_false=True)
        choice = F.when(test, F.lit(label)) if choice is None else choice.when(test, F.lit(label))
    return choice.otherwise(F.lit(other)) if other is not None else choice


def season_year(date: Column, carry_months: Sequence[int] = CARRY_MONTHS) -> Column:
    """Year of the season a date belongs to: late months count to the next year."""
    return F.year(date) + F.month(date).isin(*carry_months).cast("int")


def compact_date(date: Column) -> Column:
    """Date as eight digits, zero padded."""
    return F.date_format(date, "yyyyMMdd")


def micros(ts: Column) -> Column:
    """Microseconds of a timestamp on its own clock: a numeric time axis that no session time zone shifts."""
    seconds = F.hour(ts) * 3600 + F.minute(ts) * 60
    parts = F.unix_date(F.to_date(ts)).cast("long") * 86_400 + seconds
    return parts * 1_000_000 + (F.extract(F.lit("SECOND"), ts) * 1_000_000).cast("long")
