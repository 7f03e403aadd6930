"""Size text and size buckets, in exact integer arithmetic."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from copyledger.functions import ColumnLike, as_col


@dataclass(frozen=True)
class SizeStyle:
    """``units`` holds (exclusive upper limit, divisor, label); the last limit
    is None. ``plain_bytes`` prints the first unit without decimals."""

    units: tuple[tuple[int | None, int, str], ...]
    places: int
    rounded: bool
    plain_bytes: bool


# Thresholds, divisors and labels of the five size formats.
STYLES = {
    "binary": SizeStyle(
        (
            (1024, 1, "B"),
            (1024**2, 1024, "KB"),
            (1024**3, 1024**2, "MB"),
            (1024**4, 1024**3, "GB"),
            (1024**5, 1024**4, "TB"),
            (1024**6, 1024**5, "PB"),
            (None, 1024**6, "EB"),
        ),
        places=3, rounded=True, plain_bytes=True,
    ),
    "si2": SizeStyle(
        ((10**3, 1, "B"), (10**6, 10**3, "KB"), (10**9, 10**6, "MB"), (None, 10**9, "GB")),
        places=2, rounded=True, plain_bytes=False,
    ),
    "iec1": SizeStyle(
        (
            (1024, 1, "B"),
            (1024 * 1000, 1024, "KiB"),
            (1024**2 * 1000, 1024**2, "MiB"),
            (1024**3 * 1000, 1024**3, "GiB"),
            (None, 1024**4, "TiB"),
        ),
        places=1, rounded=False, plain_bytes=False,
    ),
    "si1": SizeStyle(
        (
            (10**3, 1, "B"),
            (10**6, 10**3, "kB"),
            (10**9, 10**6, "MB"),
            (10**12, 10**9, "GB"),
            (10**15, 10**12, "TB"),
            (10**18, 10**15, "PB"),
            (None, 10**18, "EB"),
        ),
        places=1, rounded=True, plain_bytes=False,
    ),
    "si1_trunc": SizeStyle(
        ((10**3, 1, "B"), (10**6, 10**3, "KB"), (10**9, 10**6, "MB"), (10**12, 10**9, "GB"), (None, 10**12, "TB")),
        places=1, rounded=False, plain_bytes=True,
    ),
}
BUCKETS = ((10**3, "< 1KB"), (10**6, "KB"), (10**9, "MB"), (10**12, "GB"), (None, "TB"))


def _big(value: int) -> Column:
    return F.lit(str(value)).cast("decimal(38,0)")


def exact_sum(c: ColumnLike) -> Column:
    """Sum that cannot overflow a 64-bit total; 0 over no rows."""
    return F.coalesce(F.sum(as_col(c).cast("decimal(38,0)")), _big(0))


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def _decimal_text(tally: Column, places: int, negative: Column) -> Column:
    """``tally`` counts units of 10**-places."""
    whole = _div(tally, F.lit(10**places)).cast("string")
    fraction = F.lpad((tally % F.lit(10**places)).cast("string"), places, "0")
    sign = F.when(negative & (tally > 0), F.lit("-")).otherwise(F.lit(""))
    return F.concat(sign, whole, F.lit("."), fraction)


def fixed_ratio(numerator: ColumnLike, divisor: Column, places: int, rounded: bool = True) -> Column:
    """numerator / divisor as text with ``places`` decimals, half-up or cut.

    Works on magnitudes so that negative values behave like positive ones.
    """
    n = as_col(numerator).cast("decimal(38,0)")
    scaled = F.abs(n) * _big(10**places)
    if rounded:
        scaled = (scaled * _big(2) + divisor).cast("decimal(38,0)")
        divisor = (divisor * _big(2)).cast("decimal(38,0)")
    return _decimal_text(_div(scaled, divisor), places, n < 0)


def _fixed_long(n: Column, unit: Column, places: int, rounded: bool) -> Column:
    """:func:`fixed_ratio` in 64-bit arithmetic, for units whose scaled
    remainder fits."""
    magnitude = F.abs(n)
    whole, rest = _div(magnitude, unit), magnitude % unit
    if rounded:
        part = _div(rest * F.lit(2 * 10**places) + unit, unit * F.lit(2))
    else:
        part = _div(rest * F.lit(10**places), unit)
    return _decimal_text(whole * F.lit(10**places) + part, places, n < 0)


def size_text(size: ColumnLike, style: str, total: bool = False) -> Column:
    """Size of one file as text; ``total`` is for sums, which may exceed 64 bits.

    The unit is picked first and divided by once, which keeps the generated
    code small.
    """
    spec = STYLES[style]
    n = as_col(size).cast("decimal(38,0)" if total else "bigint")

    def by_size(values: list[Column]) -> Column:
        limits = [_big(limit) if total else F.lit(limit) for limit, _, _ in spec.units[:-1]]
        chosen = F.when(n < limits[0], values[0])
        for limit, value in zip(limits[1:], values[1:]):
            chosen = chosen.when(n < limit, value)
        return chosen.otherwise(values[-1])

    wide_unit = by_size([_big(unit) for _, unit, _ in spec.units])
    if total:
        number = fixed_ratio(n, wide_unit, spec.places, spec.rounded)
    else:
        unit = by_size([F.lit(unit).cast("bigint") for _, unit, _ in spec.units])
        number = _fixed_long(n, unit, spec.places, spec.rounded)
        starts = [0] + [limit for limit, _, _ in spec.units[:-1]]
        too_wide = [start for start, (_, u, _) in zip(starts, spec.units) if (u + 1) * 2 * 10**spec.places >= 2**63]
        if too_wide:
            number = F.when(n < too_wide[0], number).otherwise(fixed_ratio(n, wide_unit, spec.places, spec.rounded))
    if spec.plain_bytes:
        number = F.when(n < spec.units[0][0], n.cast("string")).otherwise(number)
    label = by_size([F.lit(f" {text}") for _, _, text in spec.units])
    return F.concat(number, label)


def percent_text(part: ColumnLike, whole: ColumnLike, places: int) -> Column:
    """100 * part / whole as text, null when ``whole`` is 0."""
    w = as_col(whole).cast("decimal(38,0)")
    return F.when(w != 0, fixed_ratio(as_col(part).cast("decimal(38,0)") * _big(100), w, places))


def size_bucket(size: ColumnLike) -> Column:
    n = as_col(size)
    text = F.when(n < BUCKETS[0][0], F.lit(BUCKETS[0][1]))
    for limit, label in BUCKETS[1:-1]:
        text = text.when(n < limit, F.lit(label))
    return F.when(n.isNotNull(), text.otherwise(F.lit(BUCKETS[-1][1])))
