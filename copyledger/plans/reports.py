"""Duplication and size reports.

Counts and bytes per group already tell what a report needs, so these read the
copy groups instead of ranking every row.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from copyledger.functions import sizes
from copyledger.operators.bucketed import Catalog, per_part
from copyledger.operators.catalog import (
    GROUP_KEYS,
    copy_groups,
    files_primary,
    redundant_rows,
    with_base_paths,
    with_categories,
    with_known_category,
)

REPORT_CATEGORY_COLUMNS = [
    "category", "mime_type", "file_size", "file_name", "file_ext", "base_path", "file_path", "full_path",
]


def _sized_groups(catalog: Catalog, base_paths: DataFrame) -> DataFrame:
    groups = per_part(catalog, lambda part, _: copy_groups(with_base_paths(part, base_paths), ["file_size"]))
    return groups.select(
        *GROUP_KEYS,
        (F.col("copies") - 1).alias("redundant"),
        F.coalesce("primary.file_size", F.lit(0)).cast("decimal(38,0)").alias("primary_bytes"),
        (F.col("bytes") - F.coalesce("primary.file_size", F.lit(0))).cast("decimal(38,0)").alias("redundant_bytes"),
    )


def mime_duplication_summary(catalog: Catalog, base_paths: DataFrame) -> DataFrame:
    """Per MIME type: primaries, redundant copies, their size and share."""
    per_mime = _sized_groups(catalog, base_paths).groupBy("mime_type").agg(
        F.count(F.lit(1)).alias("primary_count"),
        F.sum("redundant").alias("redundant_count"),
        sizes.exact_sum("redundant_bytes").alias("_bytes"),
    )
    total = F.col("primary_count") + F.col("redundant_count")
    return per_mime.orderBy(F.desc("_bytes"), "mime_type").select(
        "mime_type",
        "primary_count",
        "redundant_count",
        sizes.size_text("_bytes", "si2", total=True).alias("redundant_size"),
        F.concat(sizes.percent_text("redundant_count", total, 2), F.lit("%")).alias("pct_duplication"),
    )


def redundant_by_mime(catalog: Catalog, base_paths: DataFrame, by_hash: bool = False) -> DataFrame:
    """Redundant copies and their size per MIME type, optionally per group."""
    keys = GROUP_KEYS if by_hash else ["mime_type"]
    counted = (
        _sized_groups(catalog, base_paths)
        .where("redundant > 0")
        .groupBy(*keys)
        .agg(F.sum("redundant").alias("file_count"), sizes.exact_sum("redundant_bytes").alias("_bytes"))
    )
    return counted.orderBy(F.desc("_bytes"), *keys).select(
        *keys, "file_count", sizes.size_text("_bytes", "iec1", total=True).alias("size_binary")
    )


def category_sizes(catalog: Catalog, base_paths: DataFrame, categories: DataFrame) -> DataFrame:
    """Size of the primaries per known category."""
    primaries = _sized_groups(catalog, base_paths).select("mime_type", "primary_bytes")
    per_mime = primaries.groupBy("mime_type").agg(sizes.exact_sum("primary_bytes").alias("_b"))
    totals = with_known_category(per_mime, categories).groupBy("category").agg(sizes.exact_sum("_b").alias("_bytes"))
    return totals.orderBy(F.desc("_bytes"), "category").select(
        "category", sizes.size_text("_bytes", "si1", total=True).alias("si_pretty")
    )


def category_filter(
    catalog: DataFrame, base_paths: DataFrame, categories: DataFrame, wanted: Iterable[str]
) -> DataFrame:
    """Primaries of the wanted categories. A MIME type decides its category and
    is part of the group key, so the filter may precede the ranking."""
    chosen = categories.where(F.col("category").isin(list(wanted))).select("mime_type")
    rows = catalog.join(chosen, "mime_type", "left_semi")
    return files_primary(rows, base_paths, categories).select(*REPORT_CATEGORY_COLUMNS)


def path_prefix_filter(catalog: DataFrame, base_paths: DataFrame, prefix: str) -> DataFrame:
    """Redundant rows whose full path starts with the literal ``prefix``."""
    rows = redundant_rows(catalog, base_paths).where(F.startswith("full_path", F.lit(prefix)))
    return rows.select("id", *GROUP_KEYS, "full_path")


def most_common(catalog: DataFrame, column: str) -> DataFrame:
    """Bytes and rows per value, most rows first; nulls form a group."""
    counted = catalog.groupBy(column).agg(
        sizes.exact_sum("file_size").alias("total_bytes"), F.count(F.lit(1)).alias("file_count")
    )
    return counted.orderBy(F.desc("file_count"), column)


def common_category(catalog: DataFrame, categories: DataFrame) -> DataFrame:
    """As :func:`most_common`, per category; counted per MIME type first."""
    per_mime = catalog.groupBy("mime_type").agg(
        sizes.exact_sum("file_size").alias("_b"), F.count(F.lit(1)).alias("_n")
    )
    counted = with_categories(per_mime, categories).groupBy("category").agg(
        sizes.exact_sum("_b").alias("total_bytes"), F.sum("_n").alias("file_count")
    )
    return counted.orderBy(F.desc("file_count"), "category")


def files_view_summary(catalog: Catalog, base_paths: DataFrame) -> DataFrame:
    """Primaries, redundants and all visible rows."""
    per_group = per_part(
        catalog,
        lambda part, _: with_base_paths(part, base_paths).groupBy(*GROUP_KEYS).agg(F.count(F.lit(1)).alias("_n")),
    )
    rows = F.coalesce(F.sum("_n"), F.lit(0))
    return per_group.agg(
        F.count(F.lit(1)).alias("primaries"),
        (rows - F.count(F.lit(1))).alias("redundants"),
        rows.alias("total_rows"),
    )
