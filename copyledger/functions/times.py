"""Timestamp expressions over zone-free timestamps, independent of the session zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from copyledger.functions import ColumnLike, as_col

# Fixed pattern: ISO local date-time, seconds and fraction optional.
ISO_LOCAL = r"\A\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?\z"


def parse_ts(text: ColumnLike) -> Column:
    """ISO local date-time to TIMESTAMP_NTZ, null when it does not parse."""
    t = as_col(text).cast("string")
    return F.when(t.rlike(ISO_LOCAL), t.try_cast("timestamp_ntz"))


def whole_seconds(ts: ColumnLike) -> Column:
    return F.substring(as_col(ts).cast("string"), 1, 19).cast("timestamp_ntz")


def format_ts(ts: ColumnLike) -> Column:
    """``YYYY-MM-DD HH:MM:SS``."""
    return F.substring(as_col(ts).cast("timestamp_ntz").cast("string"), 1, 19)


def format_iso(ts: ColumnLike) -> Column:
    """``YYYY-MM-DDTHH:MM:SS``, the manifest form."""
    return F.translate(format_ts(ts), " ", "T")


def elapsed(later: ColumnLike, earlier: ColumnLike) -> Column:
    """Seconds between two timestamps as an exact decimal."""
    return (as_col(later) - as_col(earlier)).cast("interval second").cast("decimal(20,6)")


def delta_days(later: ColumnLike, earlier: ColumnLike) -> Column:
    return F.round(elapsed(later, earlier) / F.lit(86400), 6).cast("decimal(20,6)")


def drift_seconds(later: ColumnLike, earlier: ColumnLike) -> Column:
    return F.round(elapsed(later, earlier), 0).cast("bigint")
