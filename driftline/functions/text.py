"""Decoding of metadata kept in column names, and text output."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The number between underscores, with "p" for the decimal point, and the last part.
DEPTH_PATTERN = r"_([0-9]+(?:p[0-9]+)?)_"
LAST_PART_PATTERN = r"([^_]+)$"


def extract(c: Column, pattern: str, group: int = 1) -> Column:
    """Regex group; NULL (not empty text) where nothing matches."""
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def name_site(c: Column, length: int = 3) -> Column:
    """Leading site code of a series name."""
    return F.substring(c, 1, length)


def name_depth(c: Column, pattern: str = DEPTH_PATTERN) -> Column:
    """Depth in a series name as a number: ``x_temp_2p5_avg`` gives 2.5."""
    return F.replace(extract(c, pattern), F.lit("p"), F.lit(".")).try_cast("double")


def name_stat(c: Column, pattern: str = LAST_PART_PATTERN) -> Column:
    """Statistic in a series name: its last part."""
    return extract(c, pattern)


def signed_depth(depth: Column, above: Sequence[float] = (0, 150)) -> Column:
    """Depth as a height: levels listed in ``above`` stay positive, all others go below zero."""
    return F.when(depth.isin(*[float(a) for a in above]), depth).otherwise(-depth)


def split_name(c: Column, parts: Sequence[str | None], sep: str = "_") -> dict[str, Column]:
    """Columns for :meth:`DataFrame.withColumns`, one per named part; ``None`` skips a part."""
    pieces = F.split(c, rf"\Q{sep}\E")
    return {n: F.try_element_at(pieces, F.lit(i + 1)) for i, n in enumerate(parts) if n is not None}


def title(c: Column) -> Column:
    return F.initcap(c)


def padded(c: Column, width: int = 2) -> Column:
    """Integer with leading zeros."""
    return F.lpad(c.cast("int").cast("string"), width, "0")


def labelled_text(fields: Mapping[str, Column], separator: str = "<br>", bold: tuple[str, str] = ("<b>", "</b>")) -> Column:
    """``label: value`` of every field in one text, labels between the ``bold`` marks; NULL if any value is."""
    out = []
    for label, value in fields.items():
        out += [F.lit(separator)] if out else []
        out += [F.lit(f"{bold[0]}{label}:{bold[1]} "), value.cast("string")]
    return F.concat(*out)
