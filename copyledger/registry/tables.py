"""Catalogs, manifests and inventories derived from the provided tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from copyledger.functions import times
from copyledger.schema import BASE_PATHS_SCHEMA, CATEGORIES_SCHEMA, MANIFEST_COLUMNS, as_catalog
from copyledger.session import literal_table

REGISTERED = [
    ("/vol/v0", 10, True),
    ("/vol/v1", 20, True),
    ("/vol/v2", 30, False),
    ("/vol/v3", 40, False),
    ("/vol/v4", 50, False),
]
VAULT = "/vol/v0"

# The user's category table of these queries.
MAPPED = [
    ("image/png", "image"),
    ("image/jpeg", "image"),
    ("audio/mpeg", "audio"),
    ("video/mp4", "video"),
    ("text/plain", "text"),
]


# Given explicitly, so that no job has to read file footers first.
SCHEMAS = {
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "pages": "page_id bigint, url string, html string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event columns plus the catalog columns they stand for."""
    e = table(spark, sf_dir, "events")
    mime = (
        F.when(F.col("event_type") == "error", "image/png")
        .when(F.col("event_type") == "click", "video/mp4")
        .when(F.col("event_type") == "view", "application/x-unmapped")
        .otherwise("audio/mpeg")
    )
    content = F.concat_ws(":", F.col("user_id").cast("string"), (F.col("event_id") % 20).cast("string"))
    volume = (F.col("event_id") * 7) % 11 % 6
    return e.select(
        "event_id",
        "user_id",
        "event_type",
        "value",
        (F.col("event_id") + 1000001).alias("id"),
        F.sha1(content.cast("binary")).alias("hash"),
        mime.alias("mime_type"),
        times.whole_seconds("ts").alias("last_modified"),
        F.round(F.col("value") * 100).cast("bigint").alias("file_size"),
        F.concat(F.lit("/vol/v"), volume.cast("string")).alias("base_path"),
        F.concat("event_type", F.lit("/"), F.col("event_id").cast("string"), F.lit(".DAT")).alias("file_path"),
    )


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_catalog(events(spark, sf_dir))


def base_paths(spark: SparkSession) -> DataFrame:
    """``/vol/v5`` stays unregistered."""
    return literal_table(spark, REGISTERED, BASE_PATHS_SCHEMA.names)


def categories(spark: SparkSession) -> DataFrame:
    return literal_table(spark, MAPPED, CATEGORIES_SCHEMA.names)


def manifest(spark: SparkSession, sf_dir: str, volumes: tuple[int, ...] | None = None) -> DataFrame:
    """The whole catalog as a manifest, or the scan of some volumes."""
    rows = catalog(spark, sf_dir).select(*MANIFEST_COLUMNS)
    if volumes is None:
        return rows
    return rows.where(F.col("base_path").isin([f"/vol/v{v}" for v in volumes]))


def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A later scan of the same volumes: late files are absent, some sizes,
    times and types changed, some entries are not regular or not writable."""
    e = events(spark, sf_dir).where("last_modified < timestamp_ntz'2024-01-29 00:00:00'")
    in_days = "last_modified >= timestamp_ntz'2024-01-{:02d} 00:00:00' AND last_modified < timestamp_ntz'2024-01-{:02d} 00:00:00'"
    resized = (F.col("event_type") == "purchase") & (F.col("value") > 80)
    retyped = (F.col("event_type") == "view") & (F.col("value") < 8)
    return e.select(
        F.concat_ws("/", "base_path", "file_path").alias("full_path"),
        (F.col("value") <= 150).alias("is_regular"),
        (~F.expr(in_days.format(5, 7))).alias("is_writable"),
        F.when(resized, F.col("file_size") + 1).otherwise(F.col("file_size")).alias("file_size"),
        F.when(F.expr(in_days.format(10, 12)), F.expr("last_modified + interval 1 second"))
        .otherwise(F.col("last_modified"))
        .alias("last_modified"),
        F.when(retyped, F.lit("application/octet-stream")).otherwise(F.col("mime_type")).alias("mime_type"),
    )


def live_bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog(spark, sf_dir).select("base_path").distinct()


def mounted_bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base paths the later scan found something under."""
    folder = F.regexp_extract("full_path", r"\A(/[^/]+/[^/]+)/", 1)
    return inventory(spark, sf_dir).select(folder.alias("base_path")).distinct()


def faulty_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalog with the faults the health checks look for; paths repeat because
    they are built from the user id."""
    e = events(spark, sf_dir)
    slash_base = (F.col("event_type") == "error") & (F.col("value") < 3)
    slash_file = (F.col("event_type") == "click") & (F.col("value") < 2)
    rows = e.withColumns({
        "hash": F.when(F.col("value").between(20, 21), F.upper("hash")).otherwise(F.col("hash")),
        "file_size": F.when(F.col("value") > 200, -F.col("file_size")).otherwise(F.col("file_size")),
        "base_path": F.when(slash_base, F.concat("base_path", F.lit("/"))).otherwise(F.col("base_path")),
        "file_path": F.concat(
            F.when(slash_file, F.lit("/")).otherwise(F.lit("")), "event_type", F.lit("/"),
            F.col("user_id").cast("string"),
        ),
    })
    return as_catalog(rows)


def faulty_base_paths(spark: SparkSession) -> DataFrame:
    """Adds a registered vault that holds no file."""
    return literal_table(spark, [*REGISTERED, ("/vol/v9", 60, True)], BASE_PATHS_SCHEMA.names)


def manifest_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest lines (source, line_no, value) with malformed ones among them."""
    e = events(spark, sf_dir)
    value = F.col("value")
    size_text = (
        F.when(value.between(30, 31), F.lit("12x"))
        .when(value.between(31, 32), F.concat(F.lit("+"), F.col("file_size").cast("string")))
        .otherwise(F.col("file_size").cast("string"))
    )
    time_text = F.when(value.between(40, 41), F.lit("2024-13-01T00:00:00")).otherwise(
        times.format_iso("last_modified")
    )
    hash_text = F.when(value.between(50, 51), F.substring("hash", 1, 39)).otherwise(
        F.when(value.between(51, 52), F.upper("hash")).otherwise(F.col("hash"))
    )
    name = F.when(value.between(60, 61), F.lit("")).otherwise(F.col("file_path"))
    tail = F.when(value.between(70, 71), F.lit("\textra")).when(value.between(71, 72), F.lit("\t")).otherwise("")
    line = F.concat(
        F.concat_ws("\t", hash_text, time_text, size_text, "mime_type", "base_path", name), tail
    )
    return e.select(F.col("base_path").alias("source"), (F.col("event_id") + 1).alias("line_no"), line.alias("value"))
