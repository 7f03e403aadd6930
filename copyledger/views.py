"""Temporary views under the catalog's SQL names, so that reports written as
SQL text run through ``spark.sql``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from copyledger.functions.sql_functions import register_functions
from copyledger.operators.catalog import FAMILY_CATEGORIES, files, media_view
from copyledger.operators.vault import timestamp_drift


def register_views(spark: SparkSession, catalog: DataFrame, base_paths: DataFrame, categories: DataFrame) -> None:
    """Register the tables, the ranked views, the drift work queue, the media
    families (``<family>``, ``<family>_primary``, ``<family>_redundant``) and
    the path functions. ``length`` is an alias of ``file_size``, which older
    reports use. Only ``files`` carries the global group number."""

    def register(name: str, df: DataFrame) -> None:
        if "file_size" in df.columns:
            df = df.withColumn("length", F.col("file_size"))
        df.createOrReplaceTempView(name)

    catalog.createOrReplaceTempView("hashes")
    base_paths.createOrReplaceTempView("base_paths")
    categories.createOrReplaceTempView("mime_categories")
    for family in FAMILY_CATEGORIES:
        for wanted in (None, "primary", "redundant"):
            name = family if wanted is None else f"{family}_{wanted}"
            register(name, media_view(catalog, base_paths, categories, family, wanted))
    register("files", files(catalog, base_paths, categories))
    timestamp_drift(catalog, base_paths).drop("oldest_id").createOrReplaceTempView("vault_timestamp_drift")
    register_functions(spark)
