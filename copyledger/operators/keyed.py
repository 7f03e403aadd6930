"""Joins and numberings that hold up when one key owns a third of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from copyledger.functions import ColumnLike, as_col
from copyledger.session import ensure_checkpoint_dir

def join_on_groups(
    rows: DataFrame,
    groups: DataFrame,
    keys: Sequence[str],
    how: str = "inner",
    nulls: bool = False,
    in_place: bool = False,
) -> DataFrame:
    """Join ``rows`` to ``groups``, which has one row per ``keys`` value.

    ``groups`` usually leaves a groupBy on the same keys and would be joined in
    place; then adaptive execution cannot split a skewed partition of ``rows``.
    The extra hash key makes both inputs plain shuffle stages, so a hot key is
    split over many tasks while its single group row is re-read by each. With
    ``nulls`` a null key meets the group of its null, as in a groupBy. Rows whose
    keys lie in bounded buckets are joined ``in_place``, without that; rows with
    null keys are then joined apart.
    """
    keys = list(keys)
    if in_place:
        placed = rows.join(groups, keys, how)
        if not nulls:
            return placed
        some = " OR ".join(f"`{c}` IS NULL" for c in keys)
        return placed.unionByName(join_on_groups(rows.where(some), groups.where(some), keys, how, nulls=True))
    left = rows.withColumn("_key_hash", F.xxhash64(*keys))
    if not nulls:
        return left.join(groups.withColumn("_key_hash", F.xxhash64(*keys)), ["_key_hash", *keys], how).drop("_key_hash")
    renamed = [F.col(c).alias(f"_group_{c}" if c in keys else c) for c in groups.columns]
    right = groups.select(F.xxhash64(*keys).alias("_groups_key_hash"), *renamed)
    same = F.col("_key_hash") == F.col("_groups_key_hash")
    for c in keys:
        same = same & F.col(c).eqNullSafe(F.col(f"_group_{c}"))
    return left.join(right, same, how).drop("_key_hash", "_groups_key_hash", *[f"_group_{c}" for c in keys])


def hex_bucket(h: ColumnLike, width: int = 4) -> Column:
    """Order-preserving bucket of a hex digest: its first ``width`` digits.

    Text that stops being lower-case hex earlier keeps its hex prefix plus a
    marker that sorts where the foreign character sorts, so there are never
    more than about 16**width * 1.3 buckets whatever the input holds.
    """
    text = as_col(h)
    prefix = F.regexp_extract(text, rf"\A[0-9a-f]{{0,{width}}}", 0)
    following = F.substr(text, F.length(prefix) + 1, F.lit(1))
    marker = (
        F.when((F.length(prefix) == width) | (following == ""), F.lit(""))
        .when(following < "0", F.lit("/"))
        .when(following < "a", F.lit(":"))
        .otherwise(F.lit("g"))
    )
    return F.coalesce(F.concat(prefix, marker), F.lit(""))


def dense_number(df: DataFrame, bucket: Column, order: Sequence[ColumnLike], name: str, start: int = 1) -> DataFrame:
    """Number rows 'start', 'start'+1, ... in (bucket, order) order without a
    global sort: rank inside each bucket plus the bucket's starting offset.

    ``bucket`` must be order-preserving, even, and of bounded cardinality: the
    offset table has one row per bucket and is broadcast. Where values crowd
    into few buckets, :func:`range_number` gives the same numbers.
    """
    local = df.withColumn("_bucket", bucket).withColumn(
        "_rank", F.row_number().over(W.partitionBy("_bucket").orderBy(*[as_col(c) for c in order]))
    )
    # The last row of a bucket carries its size. Taking whole rows keeps this
    # branch's shuffle equal to the numbered one, so Spark runs it once.
    last = F.max(F.struct("_rank", *df.columns))
    sizes = local.groupBy("_bucket").agg(last["_rank"].cast("bigint").alias("_size"))
    before = W.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("_bucket", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    numbered = local.join(F.broadcast(offsets), "_bucket")
    return numbered.withColumn(name, F.col("_offset") + F.col("_rank") + F.lit(start - 1)).drop(
        "_bucket", "_rank", "_offset"
    )


def _settle(df: DataFrame, order: Sequence[str], ranges: int | None = None) -> DataFrame:
    """Rows sorted by ``order`` over many tasks, with their position ``_pos``,
    rising inside each ``_range``; ranges follow the order too. Written out once,
    as a second evaluation could draw other range borders."""
    ensure_checkpoint_dir(df.sparkSession)
    return (
        df.repartitionByRange(*([] if ranges is None else [ranges]), *order)
        .sortWithinPartitions(*order)
        .withColumn("_pos", F.monotonically_increasing_id())
        .withColumn("_range", F.shiftright("_pos", 33))
        .checkpoint()
    )


def range_number(df: DataFrame, order: Sequence[str], name: str, start: int = 1) -> DataFrame:
    """Number rows 'start', 'start'+1, ... by ``order``, which must end unique,
    however the values are distributed. Costs one write of ``df``."""
    placed = _settle(df, order)
    ranges = placed.groupBy("_range").agg(F.min("_pos").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    offsets = ranges.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    numbered = placed.join(F.broadcast(offsets), "_range")
    position = F.col("_pos") - F.col("_first") + F.col("_before")
    return numbered.withColumn(name, position + F.lit(start)).drop("_pos", "_range", "_first", "_before")


def in_spans(points: DataFrame, spans: DataFrame, ranges: int | None = None) -> DataFrame:
    """Rows of ``points`` whose ``at`` lies in one of the ``spans`` (``first`` to before
    ``behind``), which may nest or overlap; null places lie in none.

    Both are range-sorted together over many tasks (``ranges`` of them, else as
    many as the session shuffles to). A point lies in a span when the furthest end of
    those that began before it is behind it. Spans reach from range to range
    through one row per range, so no point is repeated and no span is a hot key.
    """
    columns = points.columns
    end = F.lit(None).cast("string").alias("_behind")
    marks = spans.select(F.col("first").alias("at"), F.col("behind").alias("_behind"), F.lit(0).alias("_kind"))
    both = points.where("at is not null").select(*columns, end, F.lit(1).alias("_kind"))
    placed = _settle(both.unionByName(marks, allowMissingColumns=True), ["at", "_kind"], ranges)
    earlier = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    reached = placed.groupBy("_range").agg(F.max("_behind").alias("_last")).withColumn("_reach", F.max("_last").over(earlier))
    above = W.partitionBy("_range").orderBy("_pos").rowsBetween(W.unboundedPreceding, -1)
    inside = placed.withColumn("_above", F.max("_behind").over(above)).join(
        F.broadcast(reached.select("_range", "_reach")), "_range"
    )
    return inside.where((F.col("_kind") == 1) & (F.greatest("_above", "_reach") > F.col("at"))).select(*columns)


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """First row of each key. The limit of one is applied before the shuffle
    too, so a hot key sends one row per input task."""
    first = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(first)).where("_rank = 1").drop("_rank")


def rank_in_key(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "rn", ranges: int | None = None
) -> DataFrame:
    """1-based rank of every row inside its key; ``order`` must end unique.

    Rows are range-sorted by key and order over many tasks (``ranges`` of them,
    else as many as the session shuffles to) and written out once, so that the
    ranges are settled and a hot key is split among them. A row's rank counts
    inside its range and key; only the first key of a range can have begun in
    an earlier one, so the counts to add are at most one row per range.
    """
    keys, order = list(keys), list(order)
    placed = _settle(df, [*keys, *order], ranges)
    earlier = W.partitionBy(*keys).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    continued = (
        placed.groupBy(*keys, "_range")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_before", F.sum("_n").over(earlier))
        .where("_before is not null")
        .select(F.col("_range").alias("_r"), "_before", *[F.col(c).alias(f"_key_{i}") for i, c in enumerate(keys)])
    )
    inside = F.row_number().over(W.partitionBy("_range", *keys).orderBy("_pos"))
    same = F.col("_range") == F.col("_r")
    for i, c in enumerate(keys):
        same = same & F.col(c).eqNullSafe(F.col(f"_key_{i}"))
    ranked = placed.withColumn("_inside", inside).join(F.broadcast(continued), same, "left")
    rank = F.col("_inside") + F.coalesce("_before", F.lit(0))
    return ranked.select(*df.columns, rank.cast("bigint").alias(name))
