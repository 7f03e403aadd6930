"""Writing and opening catalogs bucketed by content group."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from copyledger.operators.bucketed import BucketedCatalog
from copyledger.operators.catalog import GROUP_KEYS
from copyledger.operators.keyed import join_on_groups
from copyledger.schema import CATALOG_COLUMNS, CATALOG_SCHEMA

# A group with more rows is kept out of the buckets, as one task reads a bucket.
CROWDED_ROWS = 1_000_000


def write_bucketed(
    catalog: DataFrame, path: str, table: str, buckets: int, crowded_rows: int = CROWDED_ROWS
) -> BucketedCatalog:
    """Store ``catalog`` below the new folder ``path``, in ``buckets`` files sorted by
    (hash, mime_type), and return it opened as ``table``.

    Groups of more than ``crowded_rows`` rows go to a part of their own, in even
    files; there are at most rows / crowded_rows of them. Choose ``buckets`` so that
    a bucket suits one task: a file is written and read by one.
    """
    spark = catalog.sparkSession
    rows = catalog.select(*CATALOG_COLUMNS)
    keys = rows.groupBy(*GROUP_KEYS).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > crowded_rows)
    keys.select(*GROUP_KEYS).write.parquet(f"{path}/crowded_keys")
    crowded = spark.read.schema(keys.select(*GROUP_KEYS).schema).parquet(f"{path}/crowded_keys")
    join_on_groups(rows, crowded, GROUP_KEYS, "left_semi", nulls=True).write.parquet(f"{path}/crowded")
    (
        join_on_groups(rows, crowded, GROUP_KEYS, "left_anti", nulls=True)
        .repartition(buckets, *GROUP_KEYS)
        .sortWithinPartitions(*GROUP_KEYS)
        .write.bucketBy(buckets, *GROUP_KEYS)
        .sortBy(*GROUP_KEYS)
        .option("path", f"{path}/spread")
        .saveAsTable(table)
    )
    # Written last: a folder without it is not a finished catalog.
    layout = spark.range(0, 1, 1, 1).select(F.lit(buckets).alias("buckets"))
    layout.write.parquet(f"{path}/layout")
    return open_bucketed(spark, path, table)


def open_bucketed(spark: SparkSession, path: str, table: str) -> BucketedCatalog:
    """The catalog at ``path``, under the name ``table`` in this session's catalog,
    which must not name another table."""
    buckets = spark.read.schema("buckets int").parquet(f"{path}/layout").first().buckets
    if not spark.catalog.tableExists(table):
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in CATALOG_SCHEMA)
        place = f"{path}/spread".replace("\\", "\\\\").replace("'", "\\'")
        keys = ", ".join(GROUP_KEYS)
        spark.sql(
            f"CREATE TABLE {table} ({columns}) USING parquet CLUSTERED BY ({keys}) SORTED BY ({keys}) "
            f"INTO {buckets} BUCKETS LOCATION '{place}'"
        )
    return BucketedCatalog(spark.table(table), spark.read.schema(CATALOG_SCHEMA).parquet(f"{path}/crowded"))
