"""The ranked catalog: base paths, categories, copy groups and dispositions."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from copyledger.functions import mime, sizes
from copyledger.operators.bucketed import Catalog, all_rows, per_part
from copyledger.operators.keyed import dense_number, hex_bucket, join_on_groups, range_number, rank_in_key, top_per_key

GROUP_KEYS = ["hash", "mime_type"]
RANK_ORDER = ["last_modified", "priority", "id"]
FILES_COLUMNS = [
    "id", "group_num", "hash", "mime_type", "category", "last_modified", "file_size", "base_path",
    "file_path", "full_path", "file_name", "file_ext", "is_vault", "priority", "disposition",
]

# Documented view families. None keeps every row.
FAMILY_CATEGORIES = {
    "files": None,
    "media": ["image", "video", "audio"],
    "images": ["image"],
    "videos": ["video"],
    "audio": ["audio"],
}


def with_base_paths(catalog: DataFrame, base_paths: DataFrame) -> DataFrame:
    """Attach priority and is_vault; rows of unregistered base paths drop out."""
    return catalog.join(base_paths.select("base_path", "priority", "is_vault"), "base_path")


def with_categories(catalog: DataFrame, categories: DataFrame) -> DataFrame:
    """Attach category, null where the MIME type is not mapped."""
    return catalog.join(categories.select("mime_type", "category"), "mime_type", "left")


def with_known_category(df: DataFrame, categories: DataFrame) -> DataFrame:
    return df.join(categories.select("mime_type", "category"), "mime_type")


def copy_groups(ranked_rows: DataFrame, payload: Sequence[str] = ()) -> DataFrame:
    """One row per (hash, mime_type): copies, bytes and the primary copy.

    A single partially aggregated pass, so a hot group sends one row per input
    task. ``payload`` names further columns of the primary copy to keep. The
    struct makes it a sort aggregation; README gives the times of forms without.
    """
    first = F.min(F.struct(*RANK_ORDER, *payload))
    return ranked_rows.groupBy(*GROUP_KEYS).agg(
        F.count(F.lit(1)).alias("copies"),
        sizes.exact_sum("file_size").alias("bytes"),
        first.alias("primary"),
    )


def number_groups(groups: DataFrame, digests: bool = True) -> DataFrame:
    """Add group_num, the global dense rank by (hash, mime_type).

    Digests spread evenly over their leading digits. ``digests=False`` numbers
    hashes of any shape, at the price of writing the groups out once.
    """
    if not digests:
        return range_number(groups, GROUP_KEYS, "group_num")
    return dense_number(groups, hex_bucket("hash"), GROUP_KEYS, "group_num")


def group_num(catalog: DataFrame, base_paths: DataFrame, digests: bool = True) -> DataFrame:
    groups = with_base_paths(catalog, base_paths).select(*GROUP_KEYS).distinct()
    return number_groups(groups, digests)


def group_size(catalog: Catalog, base_paths: DataFrame) -> DataFrame:
    """Each visible row with the number of copies in its group."""

    def sized(part: DataFrame, in_place: bool) -> DataFrame:
        rows = with_base_paths(part, base_paths)
        counts = rows.groupBy(*GROUP_KEYS).agg(F.count(F.lit(1)).alias("grp_size"))
        return join_on_groups(rows, counts, GROUP_KEYS, nulls=True, in_place=in_place)

    return per_part(catalog, sized)


def rank_in_group(catalog: DataFrame, base_paths: DataFrame, ranges: int | None = None) -> DataFrame:
    return rank_in_key(with_base_paths(catalog, base_paths), GROUP_KEYS, RANK_ORDER, "rn", ranges)


def disposition(is_primary: Column) -> Column:
    return F.when(is_primary, F.lit("primary")).otherwise(F.lit("redundant"))


def primary_ids(visible: DataFrame) -> DataFrame:
    """Ids of the primary copies. Joining them on the unique id is even, while
    joining groups back on (hash, mime_type) would follow the group sizes."""
    return copy_groups(visible).select(F.col("primary.id").alias("id"))


def _marked(visible: DataFrame, in_place: bool) -> DataFrame:
    """Visible rows with ``_primary``, true for the primary copy and null or false else."""
    if in_place:
        groups = copy_groups(visible).select(*GROUP_KEYS, F.col("primary.id").alias("_primary_id"))
        ranked = join_on_groups(visible, groups, GROUP_KEYS, nulls=True, in_place=True)
        return ranked.withColumn("_primary", F.col("id") == F.col("_primary_id")).drop("_primary_id")
    return visible.join(primary_ids(visible).withColumn("_primary", F.lit(True)), "id", "left")


def files(
    catalog: Catalog,
    base_paths: DataFrame,
    categories: DataFrame,
    with_group_num: bool = True,
    digests: bool = True,
) -> DataFrame:
    """Every visible row with its category and disposition.

    ``with_group_num=False`` skips the global numbering; reports that do not
    show it should ask for that. Over a bucketed catalog it needs no shuffle of
    rows but those of crowded groups. For ``digests`` see :func:`number_groups`.
    """
    if with_group_num:
        groups = number_groups(
            per_part(
                catalog,
                lambda part, _: copy_groups(with_base_paths(part, base_paths)).select(
                    *GROUP_KEYS, F.col("primary.id").alias("_primary_id")
                ),
            ),
            digests,
        )
        rows = with_categories(with_base_paths(all_rows(catalog), base_paths), categories)
        ranked = join_on_groups(rows, groups, GROUP_KEYS, nulls=True).withColumn(
            "disposition", disposition(F.col("id") == F.col("_primary_id"))
        )
        return ranked.select(*FILES_COLUMNS)
    marked = per_part(catalog, lambda part, in_place: _marked(with_base_paths(part, base_paths), in_place))
    ranked = with_categories(marked, categories).withColumn("disposition", disposition(F.col("_primary")))
    return ranked.select(*[c for c in FILES_COLUMNS if c != "group_num"])


def files_primary(catalog: Catalog, base_paths: DataFrame, categories: DataFrame) -> DataFrame:
    """Primary rows by per-group limit, without ranking the other copies."""
    order = [F.col(c) for c in RANK_ORDER]
    top = per_part(catalog, lambda part, _: top_per_key(with_base_paths(part, base_paths), GROUP_KEYS, order))
    rows = with_categories(top, categories).withColumn("disposition", F.lit("primary"))
    return rows.select(*[c for c in FILES_COLUMNS if c != "group_num"])


def redundant_rows(catalog: Catalog, base_paths: DataFrame) -> DataFrame:
    """Visible rows that are not the primary of their group."""

    def others(part: DataFrame, in_place: bool) -> DataFrame:
        visible = with_base_paths(part, base_paths)
        if in_place:
            return _marked(visible, True).where("NOT _primary").drop("_primary")
        return visible.join(primary_ids(visible), "id", "left_anti")

    return per_part(catalog, others)


def files_redundant(catalog: Catalog, base_paths: DataFrame, categories: DataFrame) -> DataFrame:
    rows = with_categories(redundant_rows(catalog, base_paths), categories)
    return rows.withColumn("disposition", F.lit("redundant")).select(*[c for c in FILES_COLUMNS if c != "group_num"])


def media_view(
    catalog: DataFrame,
    base_paths: DataFrame,
    categories: DataFrame,
    family: str,
    wanted: str | None = None,
) -> DataFrame:
    """One of the documented views: a family, optionally only its primary or
    redundant rows. A MIME type decides its category and is part of the group
    key, so whole groups are dropped before they are ranked."""
    chosen = FAMILY_CATEGORIES[family]
    if chosen is not None:
        types = categories.where(F.col("category").isin(chosen)).select("mime_type")
        catalog = catalog.join(types, "mime_type", "left_semi")
    if wanted == "primary":
        return files_primary(catalog, base_paths, categories)
    if wanted == "redundant":
        return files_redundant(catalog, base_paths, categories)
    return files(catalog, base_paths, categories, with_group_num=False)


def mime_filter(df: DataFrame, majors: Iterable[str] = ()) -> DataFrame:
    """Keep rows whose major type is in ``majors``; an empty set keeps all."""
    majors = list(majors)
    return df.where(mime.has_major("mime_type", majors)) if majors else df


def write_catalog(catalog: DataFrame, path: str) -> None:
    """Store a snapshot partitioned by base path, time-sorted inside files.

    Rebalancing gathers a base path in few files of even size; a huge one is
    split over many tasks. The sort gives useful time ranges for row-group
    skipping.
    """
    (
        catalog.hint("rebalance", "base_path")
        .sortWithinPartitions("base_path", "last_modified")
        .write.partitionBy("base_path")
        .parquet(path)
    )


def scan_base(catalog: DataFrame, base_path: str) -> DataFrame:
    """Ids and paths of one base path; prunes partitions of a stored catalog."""
    return catalog.where(F.col("base_path") == base_path).select("id", "full_path")
