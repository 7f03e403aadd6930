"""Plans for removals, copies and timestamp repairs.

Nothing here touches user files. An inventory (full_path, is_regular,
is_writable, file_size, last_modified, mime_type) stands for what exists now.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from copyledger.functions import paths, times
from copyledger.operators.bucketed import Catalog, all_rows
from copyledger.operators.catalog import GROUP_KEYS, redundant_rows
from copyledger.operators.keyed import join_on_groups
from copyledger.operators.manifest import require_bases, select_best, select_flagged
from copyledger.schema import MANIFEST_COLUMNS


def redundant_plan(
    catalog: Catalog, base_paths: DataFrame, inventory: DataFrame, live_bases: DataFrame, prefix: str | None = None
) -> DataFrame:
    """Redundant rows with action would-remove, or stale-row when the file is gone.
    Raises when a registered base path is not among ``live_bases`` or is marked there as
    not wholly readable: its files would seem gone."""
    rows = redundant_rows(catalog, base_paths)
    if prefix is not None:
        rows = rows.where(F.startswith("full_path", F.lit(prefix)))
    shown = all_rows(catalog).select("base_path").join(base_paths.select("base_path"), "base_path", "left_semi")
    require_bases(shown, live_bases)
    live = inventory.where("is_regular").select("full_path", F.lit(True).alias("_live"))
    action = F.when(F.col("_live"), "would-remove").otherwise("stale-row")
    return rows.join(live, "full_path", "left").select("id", *GROUP_KEYS, "full_path", action.alias("action"))


def vault_purge_plan(dupes: DataFrame, inventory: DataFrame, vault: str) -> DataFrame:
    """Vault duplicates (``other_full_path``) with the first status that holds."""
    now = inventory.select(F.col("full_path").alias("other_full_path"), "is_regular", "is_writable")
    status = (
        F.when(paths.under("other_full_path", F.lit(vault)), "skipped-in-vault")
        .when(F.col("is_regular").isNull(), "missing")
        .when(~F.col("is_regular"), "not-regular")
        .when(~F.col("is_writable"), "no-permission")
        .otherwise("would-remove")
    )
    return dupes.join(now, "other_full_path", "left").select(*dupes.columns, status.alias("status"))


def plan_status_counts(plan: DataFrame, column: str = "status") -> DataFrame:
    return plan.groupBy(column).agg(F.count(F.lit(1)).alias("row_count"))


def drift_fix_plan(drift: DataFrame, policy: str, inventory: DataFrame | None = None) -> DataFrame:
    """What a policy does with each drift row.

    ``inherit``: the vault copy takes the oldest time; skipped when an inventory
    shows that the vault file is gone. ``remove-oldest``: the oldest copy and
    its row go; with an inventory a missing file only loses its row.
    """
    if policy == "inherit":
        path, row_id, done, gone = "vault_full_path", "vault_id", "set-timestamp", "vault-file-missing"
    elif policy == "remove-oldest":
        path, row_id, done, gone = "oldest_full_path", "oldest_id", "remove-file-and-row", "remove-row"
    else:
        raise ValueError(f"unknown policy: {policy}")
    action = F.lit(done)
    rows = drift
    if inventory is not None:
        rows = drift.join(inventory.select(F.col("full_path").alias(path), F.lit(True).alias("_live")), path, "left")
        action = F.when(F.col("_live"), done).otherwise(gone)
    return rows.select(
        F.col(row_id).alias("id"), F.col(path).alias("full_path"), "target_last_modified", action.alias("action")
    )


def prune_plan(scope: DataFrame) -> DataFrame:
    """Rows that differ from the best row of their group."""
    return select_flagged(scope).where(~F.col("is_best")).select(*MANIFEST_COLUMNS)


def copy_plan(scope: DataFrame, dest: str, dest_inventory: DataFrame) -> DataFrame:
    """Best rows with their destination and a check against what is there.

    Several best rows may map to one destination; the copies are counted per
    destination first, so a crowded one is a single row of the join.
    """
    source = paths.full_path("base_path", "file_path")
    planned = select_best(scope).select(
        source.alias("source_path"),
        paths.copy_target(source, F.lit(dest)).alias("dest_path"),
        "file_size",
        "last_modified",
    )
    crowded = planned.groupBy("dest_path").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    collides = crowded.select("dest_path", F.lit(True).alias("_collides"))
    now = dest_inventory.select(
        F.col("full_path").alias("dest_path"),
        F.col("file_size").alias("_size"),
        F.col("last_modified").alias("_time"),
    )
    status = (
        F.when(F.col("_size").isNull(), "to-copy")
        .when(F.col("_size") != F.col("file_size"), "size-mismatch")
        .when(F.col("_time") != F.col("last_modified"), "timestamp-mismatch")
        .otherwise("verified")
    )
    joined = join_on_groups(planned, collides, ["dest_path"], "left").join(now, "dest_path", "left")
    return joined.select(
        "source_path",
        "dest_path",
        status.alias("status"),
        F.coalesce("_collides", F.lit(False)).alias("collides"),
    )


def ts_fix_plan(fixes: DataFrame, inventory: DataFrame, force: bool = False) -> DataFrame:
    """Timestamp instructions with ``action``: update where the file exists (or
    always, when forced), else skip."""
    live = inventory.select(F.col("full_path").alias("vault_full_path"), F.lit(True).alias("_live"))
    applies = F.lit(True) if force else F.coalesce("_live", F.lit(False))
    return fixes.join(live, "vault_full_path", "left").select(
        *fixes.columns, F.when(applies, "update").otherwise("skip").alias("action")
    )


def ts_fix_counts(plan: DataFrame) -> DataFrame:
    return plan.agg(
        F.count_if(F.col("action") == "update").alias("updated"), F.count_if(F.col("action") == "skip").alias("skipped")
    )


def ts_fix_lines(drift: DataFrame) -> DataFrame:
    """Drift rows as lines of a timestamp instruction file."""
    return drift.select(
        F.concat_ws(
            "\t", F.col("vault_id").cast("string"), times.format_ts("target_last_modified"), "vault_full_path"
        ).alias("value")
    )
