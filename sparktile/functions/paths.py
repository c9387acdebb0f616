"""Column functions on file paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def stem(name: Column) -> Column:
    """Name without its last suffix; a leading dot alone is not a suffix."""
    return F.regexp_replace(name, r"(?<=.)\.[^.]+$", "")


def extension(name: Column) -> Column:
    """Lower-cased last suffix with its dot, or the empty string."""
    return F.lower(F.regexp_extract(name, r"(?<=.)(\.[^.]+)$", 1))
