"""Manifest operators: intersect, purge, select, view, remove, clean, summarise.

A manifest is a DataFrame with the six manifest columns. Keys differ on purpose:
intersect and select scope match on hash only, purge, select groups and remove
on (hash, mime_type), the duplicate listing on (hash, major type).
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from copyledger.functions import mime, paths, sizes, times, validity
from copyledger.operators.catalog import GROUP_KEYS, mime_filter
from copyledger.operators.keyed import in_spans, join_on_groups, top_per_key
from copyledger.schema import MANIFEST_COLUMNS

VIEW_KEYS = ["hash", "major_type"]


def union_manifests(first: DataFrame, *more: DataFrame) -> DataFrame:
    out = first.select(*MANIFEST_COLUMNS)
    for m in more:
        out = out.unionByName(m.select(*MANIFEST_COLUMNS))
    return out


def reference_keys(reference: DataFrame, keys: Iterable[str] = GROUP_KEYS) -> DataFrame:
    return reference.select(*keys).distinct()


def intersect(first: DataFrame, second: DataFrame, majors: Iterable[str] = ()) -> DataFrame:
    """Rows of ``first`` whose hash occurs in ``second``; repeats are kept."""
    rows = mime_filter(first.where(F.col("mime_type").isNotNull()), majors)
    return join_on_groups(rows, reference_keys(second, ["hash"]), ["hash"], "left_semi").select(*first.columns)


# --- purge ---------------------------------------------------------------


def purge_split(reference: DataFrame, target: DataFrame, majors: Iterable[str] = ()) -> DataFrame:
    """Target rows with ``matched``: the key occurs in the reference and the
    major type passes. Everything else is retained."""
    majors = list(majors)
    flags = reference_keys(reference).withColumn("_in_reference", F.lit(True))
    marked = join_on_groups(target, flags, GROUP_KEYS, "left")
    passes = mime.has_major("mime_type", majors) if majors else F.lit(True)
    matched = F.coalesce(F.col("_in_reference") & passes, F.lit(False))
    return marked.select(*target.columns, matched.alias("matched"))


def purge_groups(split: DataFrame) -> DataFrame:
    """Matched rows and bytes per key."""
    return split.where("matched").groupBy(*GROUP_KEYS).agg(
        F.count(F.lit(1)).alias("matched_rows"), sizes.exact_sum("file_size").alias("matched_bytes")
    )


def purge_summary(split: DataFrame, reference: DataFrame) -> DataFrame:
    """One row of totals. ``planned`` counts what a purge would delete."""
    matched = F.col("matched")
    counted = split.select(
        matched.cast("bigint").alias("matched"),
        (~matched).cast("bigint").alias("retained"),
        F.when(matched, F.col("file_size")).alias("size"),
        F.lit(0).cast("bigint").alias("keys"),
    )
    zero = F.lit(0).cast("bigint")
    keys = reference_keys(reference).select(
        zero.alias("matched"), zero.alias("retained"), zero.alias("size"), F.lit(1).cast("bigint").alias("keys")
    )
    totals = counted.unionByName(keys).agg(
        *[F.coalesce(F.sum(c), zero).alias(c) for c in ("matched", "retained", "keys")],
        sizes.exact_sum("size").alias("_bytes"),
    )
    return totals.select(
        "matched",
        F.col("keys").alias("reference_keys"),
        F.col("matched").alias("planned"),
        "retained",
        sizes.size_text("_bytes", "binary", total=True).alias("space_saved"),
    )


# --- select --------------------------------------------------------------


def select_scope(reference: DataFrame, data: DataFrame | None = None, majors: Iterable[str] = ()) -> DataFrame:
    """Candidate rows: data rows whose hash occurs in the reference."""
    data = reference if data is None else data
    rows = mime_filter(data, majors)
    return join_on_groups(rows, reference_keys(reference, ["hash"]), ["hash"], "left_semi").select(*MANIFEST_COLUMNS)


def select_best(scope: DataFrame) -> DataFrame:
    """Best row of each (hash, mime_type) with its group size: oldest first,
    then the higher base path, then the higher file path."""
    order = [F.asc("last_modified"), F.desc_nulls_first("base_path"), F.desc_nulls_first("file_path"), F.asc("file_size")]
    best = top_per_key(scope.select(*MANIFEST_COLUMNS), GROUP_KEYS, order)
    counts = scope.groupBy(*GROUP_KEYS).agg(F.count(F.lit(1)).alias("group_size"))
    return join_on_groups(best, counts, GROUP_KEYS, nulls=True).select(*MANIFEST_COLUMNS, "group_size")


def select_flagged(scope: DataFrame) -> DataFrame:
    """Scope rows with ``is_best``: equal to the best row in all six fields."""
    rest = [c for c in MANIFEST_COLUMNS if c not in GROUP_KEYS]
    best = select_best(scope).select(*GROUP_KEYS, *[F.col(c).alias(f"_best_{c}") for c in rest])
    same = F.lit(True)
    for c in rest:
        same = same & F.col(c).eqNullSafe(F.col(f"_best_{c}"))
    flagged = join_on_groups(scope, best, GROUP_KEYS).withColumn("is_best", same)
    return flagged.select(*MANIFEST_COLUMNS, "is_best")


def unselected(scope: DataFrame) -> DataFrame:
    """Distinct candidate rows that were not selected."""
    return select_flagged(scope).where(~F.col("is_best")).select(*MANIFEST_COLUMNS).distinct()


def select_summary(scope: DataFrame) -> DataFrame:
    """Bytes selected, bytes of distinct unselected rows, rows to delete."""
    distinct_rows = (
        select_flagged(scope).groupBy(*MANIFEST_COLUMNS, "is_best").agg(F.count(F.lit(1)).alias("_n"))
    )
    totals = distinct_rows.agg(
        sizes.exact_sum(F.when(F.col("is_best"), F.col("file_size"))).alias("_selected"),
        sizes.exact_sum(F.when(~F.col("is_best"), F.col("file_size"))).alias("_unselected"),
        F.coalesce(F.sum(F.when(~F.col("is_best"), F.col("_n"))), F.lit(0)).alias("to_delete"),
    )
    return totals.select(
        sizes.size_text("_selected", "binary", total=True).alias("selected_size"),
        sizes.size_text("_unselected", "binary", total=True).alias("unselected_size"),
        "to_delete",
    )


# --- view ----------------------------------------------------------------


def duplicate_groups(df: DataFrame, majors: Iterable[str] = (), drop_unique: bool = False) -> DataFrame:
    """Groups by (hash, major type): size and the MIME type shown in its header,
    taken from the first member in listing order."""
    rows = mime_filter(df, majors).withColumn("major_type", mime.major_type("mime_type"))
    head = F.min(F.struct("last_modified", "base_path", "file_path", "mime_type"))
    groups = rows.groupBy(*VIEW_KEYS).agg(F.count(F.lit(1)).alias("group_count"), head["mime_type"].alias("full_mime"))
    return groups.where("group_count > 1") if drop_unique else groups


def view_summary(df: DataFrame, majors: Iterable[str] = ()) -> DataFrame:
    """Number of groups and items; singletons count whatever is listed."""
    return duplicate_groups(df, majors).agg(
        F.count(F.lit(1)).alias("groups"), F.coalesce(F.sum("group_count"), F.lit(0)).alias("items")
    )


def group_listing(df: DataFrame, majors: Iterable[str] = (), drop_unique: bool = False) -> DataFrame:
    """Members of the duplicate groups, one row each, in listing order. Rows are
    range-sorted on all listing columns instead of gathered per group."""
    majors = list(majors)
    rows = mime_filter(df, majors).withColumn("major_type", mime.major_type("mime_type"))
    members = join_on_groups(
        rows.drop("mime_type"), duplicate_groups(df, majors, drop_unique), VIEW_KEYS
    )
    return members.orderBy(*VIEW_KEYS, "last_modified", "base_path", "file_path").select(
        *VIEW_KEYS,
        "group_count",
        "full_mime",
        "last_modified",
        paths.full_path("base_path", "file_path").alias("full_path"),
    )


# --- remove --------------------------------------------------------------


def expand_targets(targets: DataFrame, inventory: DataFrame, ranges: int | None = None) -> DataFrame:
    """Regular files named by ``targets`` (column ``path``): each target itself,
    or every file below it when it is a directory, found by :func:`in_spans`. The
    target ``/`` names every absolute path; empty and null targets name nothing.
    """
    wanted = targets.select(paths.normalize_path("path").alias("path")).where("path <> ''").distinct()
    first, behind = paths.tree_span("path")
    spans = wanted.select(first.alias("first"), behind.alias("behind"))
    listed = inventory.where("is_regular").select(paths.normalize_path("full_path").alias("path")).distinct()
    return in_spans(listed.withColumn("at", paths.tree_key("path")), spans, ranges).select("path")


def remove_log(manifest: DataFrame, targets: DataFrame, inventory: DataFrame) -> DataFrame:
    """Removal log: every row of the groups the target files belong to, with
    status delete or not_found, plus no_meta for targets the manifest lacks.
    Directories among the targets go through :func:`expand_targets` first.

    Two manifest rows with the same normalized path are an error.
    """
    rows = manifest.select(*MANIFEST_COLUMNS).withColumn("path", paths.full_path("base_path", "file_path"))
    index = (
        rows.groupBy(paths.normalize_path("path").alias("_norm"))
        .agg(F.count(F.lit(1)).alias("_n"), *[F.min(k).alias(k) for k in GROUP_KEYS])
        .where(
            F.when(F.col("_n") == 1, F.lit(True)).otherwise(
                F.raise_error(F.concat(F.lit("duplicate manifest path: "), F.col("_norm"))).cast("boolean")
            )
        )
        .drop("_n")
    )
    wanted = targets.select(paths.normalize_path("path").alias("_norm")).distinct()
    looked_up = wanted.join(index, "_norm", "left")
    # Both uses of the lookup read the same columns, so it is shuffled once.
    no_meta = looked_up.where(F.col("hash").isNull() & F.col("mime_type").isNull()).select(
        F.lit("no_meta").alias("status"),
        F.lit(None).cast("string").alias("hash"),
        F.lit(None).cast("string").alias("mime_type"),
        F.col("_norm").alias("path"),
    )
    keys = looked_up.where(F.col("hash").isNotNull()).select(*GROUP_KEYS).distinct()
    members = join_on_groups(rows, keys, GROUP_KEYS, "left_semi").select(*MANIFEST_COLUMNS, "path").distinct()
    present = inventory.where("is_regular").select(F.col("full_path").alias("path"), F.lit(True).alias("_present"))
    listed = members.join(present, "path", "left").select(
        F.when(F.col("_present"), F.lit("delete")).otherwise(F.lit("not_found")).alias("status"),
        *GROUP_KEYS,
        "path",
    )
    return listed.unionByName(no_meta)


# --- clean ---------------------------------------------------------------


def require_bases(df: DataFrame, live_bases: DataFrame) -> None:
    """Fail when a base path of ``df`` is not among the live ones, or when it is
    marked as not wholly readable (column ``unreadable``, as scans mark it)."""
    marked = F.col("unreadable") if "unreadable" in live_bases.columns else F.lit(0)
    marks = live_bases.groupBy("base_path").agg(F.coalesce(F.max(marked), F.lit(0)).alias("_unreadable"))
    doubtful = df.select("base_path").distinct().join(marks, "base_path", "left").where("coalesce(_unreadable, 1) > 0")
    found = doubtful.orderBy("base_path").limit(10).collect()
    absent = [r.base_path for r in found if r["_unreadable"] is None]
    partly = [f"{r.base_path} ({r['_unreadable']} files)" for r in found if r["_unreadable"]]
    if absent:
        raise ValueError(f"base paths missing or not mounted: {absent}")
    if partly:
        raise ValueError(f"base paths with unreadable files: {partly}")


def clean(manifest: DataFrame, inventory: DataFrame, live_bases: DataFrame, full_check: bool = False) -> DataFrame:
    """Manifest rows with ``reason``: null to keep, else the first failing rule.

    The cheap form tests existence only. MIME types are compared after
    parameters are cut on both sides; times are compared as timestamps.
    Raises when a base path is not among ``live_bases``, or is marked there as not
    wholly readable, so that an unmounted disk is not taken for deleted files.
    """
    require_bases(manifest, live_bases)
    live = inventory.where("is_regular").select(
        F.col("full_path").alias("_path"),
        F.col("file_size").alias("_size"),
        F.col("last_modified").alias("_time"),
        F.col("mime_type").alias("_mime"),
    )
    joined = manifest.withColumn("_path", paths.full_path("base_path", "file_path")).join(live, "_path", "left")
    is_text = dict(manifest.dtypes)["last_modified"] == "string"
    meta_time = times.parse_ts("last_modified") if is_text else F.col("last_modified")
    shown_time = F.col("last_modified") if is_text else times.format_iso("last_modified")

    def mismatch(kind: str, meta, disk):
        return F.concat(F.lit(f"{kind} mismatch (meta="), meta, F.lit(",disk="), disk, F.lit(")"))

    # "_size" and "_time" are never null for a listed file.
    reason = F.when(F.col("_size").isNull(), F.lit("file missing"))
    if full_check:
        meta_mime, disk_mime = mime.mime_clean("mime_type"), mime.mime_clean("_mime")
        reason = (
            reason.when(
                F.col("_size") != F.col("file_size"),
                mismatch("size", F.col("file_size").cast("string"), F.col("_size").cast("string")),
            )
            .when(
                ~times.whole_seconds("_time").eqNullSafe(meta_time),
                mismatch("timestamp", F.coalesce(shown_time, F.lit("")), times.format_iso("_time")),
            )
            .when(meta_mime != disk_mime, mismatch("mime", meta_mime, disk_mime))
        )
    return joined.select(*manifest.columns, reason.alias("reason"))


def clean_summary(cleaned: DataFrame, source: str) -> DataFrame:
    """Examined, kept and removed rows per manifest."""
    return cleaned.groupBy(source).agg(
        F.count(F.lit(1)).alias("examined"),
        F.count_if(F.col("reason").isNull()).alias("kept"),
        F.count_if(F.col("reason").isNotNull()).alias("removed"),
    )


# --- summary and split ---------------------------------------------------


def summary(rows: DataFrame) -> DataFrame:
    """Totals over strictly parsed rows. A bad size or time skips only its metric."""
    ts = times.parse_ts("last_modified")
    totals = rows.agg(
        F.count(F.lit(1)).alias("total_entries"),
        F.count_distinct("hash").alias("unique_hashes"),
        sizes.exact_sum(validity.parse_size("file_size")).alias("_bytes"),
        F.min(ts).alias("oldest"),
        F.max(ts).alias("newest"),
    )
    dup = F.col("total_entries") - F.col("unique_hashes")
    return totals.select(
        "total_entries",
        "unique_hashes",
        dup.alias("duplicated_hashes"),
        F.concat(sizes.percent_text(dup, "total_entries", 1), F.lit("%")).alias("duplicated_pct"),
        F.concat(
            sizes.fixed_ratio("_bytes", F.lit(10**9).cast("decimal(38,0)"), 1), F.lit(" GB")
        ).alias("total_size"),
        times.format_iso("oldest").alias("oldest"),
        times.format_iso("newest").alias("newest"),
    )


def summary_mime(rows: DataFrame, major: bool = True) -> DataFrame:
    """Rows per MIME type or per major type, in name order."""
    key = mime.major_type("mime_type", report=True).alias("major_type") if major else F.col("mime_type")
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("file_count"))
    return counts.orderBy(counts.columns[0])


def summary_size_buckets(rows: DataFrame) -> DataFrame:
    """Rows per size bucket; all five are shown even at 0."""
    bucket = sizes.size_bucket(validity.parse_size("file_size"))
    labels = [label for _, label in sizes.BUCKETS]
    counted = rows.select(bucket.alias("_b")).agg(
        *[F.count_if(F.col("_b") == label).alias(label) for label in labels]
    )
    return counted.unpivot([], labels, "bucket", "file_count")


def split_manifest(rows: DataFrame, by_major: bool = False, majors: Iterable[str] = ()) -> DataFrame:
    """Rows with ``split_key``, the sanitized MIME type or the major type."""
    majors = list(majors)
    major = mime.major_type("mime_type", report=True)
    kept = rows.where(major.isin(majors)) if majors else rows
    return kept.withColumn("split_key", major if by_major else mime.sanitize_mime("mime_type"))
