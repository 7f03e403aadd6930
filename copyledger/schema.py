"""Fixed schemas of the manifest, the catalog and its two dimensions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from copyledger.functions import paths

MANIFEST_COLUMNS = ["hash", "last_modified", "file_size", "mime_type", "base_path", "file_path"]

MANIFEST_SCHEMA = T.StructType([
    T.StructField("hash", T.StringType()),
    T.StructField("last_modified", T.StringType()),
    T.StructField("file_size", T.LongType()),
    T.StructField("mime_type", T.StringType()),
    T.StructField("base_path", T.StringType()),
    T.StructField("file_path", T.StringType()),
])

CATALOG_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("hash", T.StringType()),
    T.StructField("mime_type", T.StringType()),
    T.StructField("last_modified", T.TimestampNTZType()),
    T.StructField("file_size", T.LongType()),
    T.StructField("base_path", T.StringType()),
    T.StructField("file_path", T.StringType()),
    T.StructField("full_path", T.StringType()),
    T.StructField("file_name", T.StringType()),
    T.StructField("file_ext", T.StringType()),
])
CATALOG_COLUMNS = CATALOG_SCHEMA.names

BASE_PATHS_SCHEMA = T.StructType([
    T.StructField("base_path", T.StringType()),
    T.StructField("priority", T.IntegerType()),
    T.StructField("is_vault", T.BooleanType()),
])

CATEGORIES_SCHEMA = T.StructType([
    T.StructField("mime_type", T.StringType()),
    T.StructField("category", T.StringType()),
])

# Catalog ids start here after a reset (fixed value).
FIRST_ID = 1000001


def with_derived_paths(df: DataFrame) -> DataFrame:
    """Add the three derived catalog columns from base_path and file_path."""
    return df.withColumns({
        "full_path": paths.full_path("base_path", "file_path"),
        "file_name": paths.file_name("file_path"),
        "file_ext": paths.file_ext("file_path"),
    })


def as_catalog(df: DataFrame) -> DataFrame:
    """Project to the catalog column order, deriving the path columns."""
    derived = with_derived_paths(df)
    return derived.select(*[F.col(f.name).cast(f.dataType) for f in CATALOG_SCHEMA])
