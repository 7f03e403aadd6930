"""Catalog maintenance as new snapshots: deletes, updates, base path seeding."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from copyledger.functions import sizes, times


def lookup_by_id(catalog: DataFrame, ids: DataFrame, inventory: DataFrame) -> DataFrame:
    """What is known about each requested id (text column ``id``), with status
    found, unknown id or missing file.

    Adaptive execution broadcasts a short list to the catalog, and its hits to the
    inventory, by their measured bytes.
    """
    wanted = ids.select(F.col("id").cast("string").alias("requested")).distinct()
    numeric = F.when(F.col("requested").rlike(r"\A[0-9]+\z"), F.col("requested").try_cast("bigint"))
    numbers = wanted.select(numeric.alias("_id")).where("_id IS NOT NULL")
    hits = catalog.join(numbers, F.col("id") == F.col("_id"), "left_semi")
    rows = hits.select(
        F.col("id").alias("_id"),
        "full_path",
        "mime_type",
        sizes.size_text("file_size", "si1_trunc").alias("size_text"),
        times.format_ts("last_modified").alias("modified"),
    )
    live = inventory.where("is_regular").select("full_path", F.lit(True).alias("_live"))
    hit_paths = hits.select("full_path")
    live = live.join(hit_paths, "full_path", "left_semi")
    found = wanted.withColumn("_id", numeric).join(rows, "_id", "left").join(live, "full_path", "left")
    status = (
        F.when(F.col("full_path").isNull(), "unknown id").when(F.col("_live"), "found").otherwise("missing file")
    )
    return found.select("requested", status.alias("status"), "mime_type", "size_text", "modified", "full_path")


def delete_by_id(catalog: DataFrame, ids: DataFrame, dry_run: bool = False) -> DataFrame:
    """New snapshot without the listed ids; a dry run counts the matches."""
    listed = ids.select("id").distinct()
    if dry_run:
        return catalog.join(listed, "id", "left_semi").agg(F.count(F.lit(1)).alias("would_delete"))
    return catalog.join(listed, "id", "left_anti").select(*catalog.columns)


def delete_by_path(catalog: DataFrame, paths: DataFrame) -> DataFrame:
    return catalog.join(paths.select("full_path").distinct(), "full_path", "left_anti").select(*catalog.columns)


def update_timestamps(catalog: DataFrame, fixes: DataFrame) -> DataFrame:
    """New snapshot with ``last_modified`` replaced for the ids in ``fixes``
    (vault_id, primary_last_modified, line_no); the last line of an id wins.

    Pass the instructions that apply (see ``ts_fix_plan``). One without a valid
    time aborts the update as a whole.
    """
    invalid = F.raise_error(F.concat(F.lit("invalid timestamp for id "), F.col("vault_id").cast("string")))
    checked = F.coalesce("primary_last_modified", invalid.cast("timestamp_ntz"))
    last = (
        fixes.select(F.col("vault_id").alias("id"), checked.alias("_time"), "line_no")
        .groupBy("id")
        .agg(F.max_by("_time", "line_no").alias("_new"))
    )
    merged = catalog.join(last, "id", "left").withColumn("last_modified", F.coalesce("_new", "last_modified"))
    return merged.select(*catalog.columns)


def seed_priority(catalog: DataFrame) -> DataFrame:
    """Base paths in name order, numbered from 1, none of them a vault. The
    window runs over distinct base paths, that is one row per scanned root."""
    bases = catalog.select("base_path").distinct()
    return bases.select(
        "base_path",
        F.row_number().over(W.orderBy("base_path")).alias("priority"),
        F.lit(False).alias("is_vault"),
    )


def seed_base_paths(catalog: DataFrame, base_paths: DataFrame, overlay: DataFrame) -> DataFrame:
    """Register unseen base paths, keep known ones, then apply the configured
    priorities and vault flags. Check the result for shared priorities."""
    unseen = seed_priority(catalog).join(base_paths.select("base_path"), "base_path", "left_anti")
    merged = base_paths.select("base_path", "priority", "is_vault").unionByName(unseen)
    configured = overlay.select(
        "base_path", F.col("priority").alias("_priority"), F.col("is_vault").alias("_is_vault")
    )
    return merged.join(configured, "base_path", "left").select(
        "base_path",
        F.coalesce("_priority", "priority").alias("priority"),
        F.coalesce("_is_vault", "is_vault").alias("is_vault"),
    )
