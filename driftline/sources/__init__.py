"""Readers and writers."""
from .tables import (
    dated_files,
    latest_dated_file,
    most_recent_with_prefix,
    parse_problems,
    field_problems,
    read_csv,
    read_points,
    write_dated,
)

__all__ = [
    "dated_files",
    "latest_dated_file",
    "most_recent_with_prefix",
    "parse_problems",
    "field_problems",
    "read_csv",
    "read_points",
    "write_dated",
]
