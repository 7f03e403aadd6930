"""Vault questions: duplicates of vault primaries, unvaulted primaries, drift."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from copyledger.functions import times
from copyledger.operators.bucketed import Catalog, per_part
from copyledger.operators.catalog import GROUP_KEYS, copy_groups, with_base_paths, with_categories
from copyledger.operators.keyed import join_on_groups


def vault_dupes(
    catalog: Catalog, base_paths: DataFrame, vault: str, mime_prefix: str | None = None, full: bool = False
) -> DataFrame:
    """Copies outside ``vault`` of the groups whose primary lies in it.

    There is at most one primary per group, so the result stays linear in the
    catalog. Ordered by age difference descending, hash, MIME type.
    """

    def pairs_of(part: DataFrame, in_place: bool) -> DataFrame:
        visible = with_base_paths(part, base_paths)
        if mime_prefix is not None:  # part of the group key
            visible = visible.where(F.startswith("mime_type", F.lit(mime_prefix)))
        originals = (
            copy_groups(visible, ["base_path", "full_path"])
            .where((F.col("primary.base_path") == vault) & (F.col("copies") > 1))
            .select(
                *GROUP_KEYS,
                F.col("primary.full_path").alias("vault_full_path"),
                F.col("primary.last_modified").alias("vault_last_modified"),
            )
        )
        copies = visible.where(F.col("base_path") != vault).select(
            *GROUP_KEYS,
            F.col("full_path").alias("other_full_path"),
            F.col("last_modified").alias("dupe_last_modified"),
            F.col("base_path").alias("other_base_path"),
        )
        return join_on_groups(copies, originals, GROUP_KEYS, in_place=in_place)

    pairs = (
        per_part(catalog, pairs_of)
        .where(F.col("other_full_path") != F.col("vault_full_path"))
        .withColumn("delta_days", times.delta_days("dupe_last_modified", "vault_last_modified"))
        .where("delta_days >= 0")
    )
    # The order key is the full age difference, not its rounded form.
    ordered = pairs.withColumn("_age", times.elapsed("dupe_last_modified", "vault_last_modified")).orderBy(
        F.desc("_age"), *GROUP_KEYS, "other_full_path"
    )
    if full:
        return ordered.select(
            *GROUP_KEYS, "vault_full_path", "vault_last_modified", "dupe_last_modified", "delta_days",
            "other_base_path", "other_full_path",
        )
    return ordered.select(*GROUP_KEYS, "other_full_path")


def unvaulted_primaries(catalog: DataFrame, base_paths: DataFrame, categories: DataFrame, vault: str) -> DataFrame:
    """Image primaries outside ``vault`` that have a younger image copy with the
    same hash inside it, smallest age difference first."""
    visible = with_base_paths(catalog, base_paths)
    image_types = categories.where(F.col("category") == "image").select("mime_type")
    images = visible.join(image_types, "mime_type", "left_semi")
    primaries = (
        copy_groups(images, ["base_path", "full_path", "file_size"])
        .where(F.col("primary.base_path") != vault)
        .select(
            "hash",
            "mime_type",
            F.col("primary.file_size").alias("size_bytes"),
            F.col("primary.id").alias("primary_id"),
            F.col("primary.last_modified").alias("primary_last_modified"),
            F.col("primary.full_path").alias("primary_full_path"),
        )
    )
    vaulted = images.where(F.col("base_path") == vault).select(
        "hash",
        F.col("id").alias("vault_id"),
        F.col("last_modified").alias("vault_last_modified"),
        F.col("full_path").alias("vault_full_path"),
    )
    pairs = join_on_groups(vaulted, primaries, ["hash"]).where("vault_last_modified > primary_last_modified")
    return (
        pairs.withColumn("delta_days", times.delta_days("vault_last_modified", "primary_last_modified"))
        .withColumn("_age", times.elapsed("vault_last_modified", "primary_last_modified"))
        .orderBy("_age", "hash", "primary_id", "vault_id")
        .select(
            "hash", "mime_type", "size_bytes", "delta_days", "vault_id", "primary_id", "vault_last_modified",
            "primary_last_modified", "vault_full_path", "primary_full_path",
        )
    )


def oldest_and_vault_pick(catalog: Catalog, base_paths: DataFrame) -> DataFrame:
    """Per group the oldest copy and the preferred vault copy (priority, id),
    both from one aggregation."""
    return per_part(catalog, lambda part, _: _picks(with_base_paths(part, base_paths)))


def _picks(visible: DataFrame) -> DataFrame:
    oldest = F.min(F.struct("last_modified", "priority", "id", "full_path", "is_vault"))
    pick = F.min(F.when(F.col("is_vault"), F.struct("priority", "id", "full_path", "last_modified")))
    return (
        visible.groupBy(*GROUP_KEYS)
        .agg(oldest.alias("o"), pick.alias("v"))
        .select(
            *GROUP_KEYS,
            F.col("o.id").alias("oldest_id"),
            F.col("o.full_path").alias("oldest_full_path"),
            F.col("o.last_modified").alias("oldest_last_modified"),
            F.col("o.is_vault").alias("oldest_is_vault"),
            F.col("v.id").alias("vault_id"),
            F.col("v.full_path").alias("vault_full_path"),
            F.col("v.last_modified").alias("vault_last_modified"),
            F.col("v.priority").alias("vault_priority"),
        )
    )


def timestamp_drift(catalog: Catalog, base_paths: DataFrame) -> DataFrame:
    """Groups whose oldest copy is outside every vault and older than the
    preferred vault copy."""
    picks = oldest_and_vault_pick(catalog, base_paths)
    return picks.where("NOT oldest_is_vault AND vault_last_modified > oldest_last_modified").select(
        *GROUP_KEYS,
        "oldest_id",
        "oldest_full_path",
        F.col("oldest_last_modified").alias("target_last_modified"),
        "vault_id",
        "vault_full_path",
        "vault_last_modified",
        times.drift_seconds("vault_last_modified", "oldest_last_modified").alias("drift_seconds"),
    )


def drift_worklist(drift: DataFrame) -> DataFrame:
    """Drift rows, largest first, with printable times."""
    return (
        drift.withColumn("target_last_modified", times.format_ts("target_last_modified"))
        .withColumn("vault_last_modified", times.format_ts("vault_last_modified"))
        .orderBy(F.desc("drift_seconds"), *GROUP_KEYS)
    )
