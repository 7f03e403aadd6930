"""Validity tests on manifest and catalog fields; null is never valid."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from copyledger.functions import ColumnLike, as_col

# Fixed patterns.
LOWER_SHA1 = r"\A[0-9a-f]{40}\z"
ANY_SHA1 = r"\A[0-9a-fA-F]{40}\z"
SIGNED_INTEGER = r"\A[+-]?[0-9]+\z"


def hash_valid(h: ColumnLike, lower_only: bool = False) -> Column:
    return F.coalesce(as_col(h).rlike(LOWER_SHA1 if lower_only else ANY_SHA1), F.lit(False))


def parse_size(s: ColumnLike) -> Column:
    """Signed 64-bit value of the text, null when it is anything else."""
    text = as_col(s).cast("string")
    return F.when(text.rlike(SIGNED_INTEGER), text.try_cast("bigint"))


def size_valid(s: ColumnLike) -> Column:
    return parse_size(s).isNotNull()
