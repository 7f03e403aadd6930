"""One query per operator, over the provided tables, with equal SQL text.

Queries without SQL have no plain SQL counterpart; the tests check those
against brute force.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from copyledger.functions import mime, paths, sizes, times, validity
from copyledger.operators import catalog as cat_ops
from copyledger.operators import maintain, manifest, quality, vault
from copyledger.plans import actions, reports
from copyledger.registry import sql, tables
from copyledger.registry.tables import VAULT
from copyledger.schema import MANIFEST_COLUMNS
from copyledger.session import scratch_path
from copyledger.sources import bucketed
from copyledger.sources import categories as category_source
from copyledger.sources import inventory as inventory_source
from copyledger.sources import load, manifest_io
from copyledger.sources.snapshots import StoredCatalog

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, needs: str = "", body: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``body`` is its SQL over the relations in ``needs``."""

    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if body is not None:
            ORACLES[name] = sql.with_relations(needs, body)
        return fn

    return register


def _catalog_args(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return tables.catalog(spark, sf), tables.base_paths(spark)


def _full_args(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return tables.catalog(spark, sf), tables.base_paths(spark), tables.categories(spark)


def _manifest_pair(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Scans of volumes 0-2 and 2-5: volume 2 is in both."""
    return tables.manifest(spark, sf, (0, 1, 2)), tables.manifest(spark, sf, (2, 3, 4, 5))


def _as_bigint(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("bigint") for c in columns})


def _as_double(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("double") for c in columns})


# Seconds to days, rounded half-up to six decimals in integers: a binary
# division would round exact halves either way.
DELTA = "((CAST({} AS BIGINT) * 2000000 + 86400) // 172800) / 1000000.0"
FILES_NO_NUM = """id, hash, mime_type, category, last_modified, file_size, base_path, file_path, full_path,
    file_name, file_ext, is_vault, priority, disposition"""

# --- sources and sinks ---------------------------------------------------


def _in_files(spark, lines):
    """Lines (source, line_no, value) written to one text file per source and read back
    by the readers' own numbering; ``source`` is that of the file."""
    folder = scratch_path(spark, "lines")
    ordered = lines.repartition("source").sortWithinPartitions("source", "line_no")
    ordered.select("value", "source").write.partitionBy("source").text(folder)
    read = manifest_io.read_lines(spark, f"{folder}/*", "\n")
    return read.withColumn("source", _file_source())


def _file_source():
    return F.url_decode(F.url_decode(F.regexp_extract("source", "/source=([^/]+)/", 1)))


@query("manifest_files_strict", "good", """
    SELECT source, hash, last_modified, file_size, mime_type, base_path, file_path FROM good""")
def manifest_files_strict(spark, sf):
    folder = scratch_path(spark, "lines")
    tables.manifest_text(spark, sf).select("value", "source").write.partitionBy("source").text(folder)
    good, _ = manifest_io.read_manifest(spark, f"{folder}/*", mode="strict")
    return good.withColumn("source", _file_source()).select("source", *MANIFEST_COLUMNS)


@query("manifest_records", "lines", """
    SELECT source, CASE WHEN line_no % 3 = 0 THEN '"' || replace(value, '"', '""') || chr(10) || line_no || '"'
                        ELSE replace(value, '"', '') END AS value
    FROM lines""")
def manifest_records(spark, sf):
    """Manifest files of which every third line is quoted and holds a line break."""
    quoted = F.concat(F.lit('"'), F.replace("value", F.lit('"'), F.lit('""')), F.lit("\n"), "line_no", F.lit('"'))
    plain = F.replace("value", F.lit('"'), F.lit(""))
    rows = tables.manifest_text(spark, sf).select("source", F.when(F.col("line_no") % 3 == 0, quoted).otherwise(plain).alias("value"))
    folder = scratch_path(spark, "lines")
    rows.write.partitionBy("source").text(folder)
    return manifest_io.read_records(spark, f"{folder}/*").withColumn("source", _file_source()).select("source", "value")


@query("manifest_parse_strict", "lines", """
    SELECT source, CASE WHEN len(string_split(value, chr(9))) = 6 THEN 'good' ELSE 'bad' END AS verdict,
           count(*) AS line_count
    FROM lines GROUP BY ALL""")
def manifest_parse_strict(spark, sf):
    good, bad = manifest_io.parse_strict(tables.manifest_text(spark, sf))
    both = good.select("source", F.lit("good").alias("verdict")).unionByName(
        bad.select("source", F.lit("bad").alias("verdict"))
    )
    return both.groupBy("source", "verdict").agg(F.count(F.lit(1)).alias("line_count"))


@query("manifest_parse_strict_rows", "good", "SELECT * FROM good")
def manifest_parse_strict_rows(spark, sf):
    return manifest_io.parse_strict(tables.manifest_text(spark, sf))[0]


@query("manifest_parse_failfast", "man", """
    SELECT hash, strftime(last_modified, '%Y-%m-%dT%H:%M:%S') AS last_modified, file_size, mime_type, base_path, file_path
    FROM man""")
def manifest_parse_failfast(spark, sf):
    lines = manifest_io.manifest_lines(tables.manifest(spark, sf))
    return manifest_io.parse_failfast(lines)


@query("manifest_write", "man", """
    SELECT hash, strftime(last_modified, '%Y-%m-%dT%H:%M:%S') AS last_modified, file_size, mime_type, base_path, file_path
    FROM man""")
def manifest_write(spark, sf):
    out = scratch_path(spark, "manifest")
    manifest_io.write_manifest(tables.manifest(spark, sf), out)
    return manifest_io.read_manifest(spark, out).drop("source")


def _write_scans(spark, sf, **scans):
    root = scratch_path(spark, "load")
    for name, volumes in scans.items():
        manifest_io.write_manifest(tables.manifest(spark, sf, volumes), f"{root}/{name}")
    return root


@query("catalog_load", "cat", """
    SELECT 1000000 + row_number() OVER (ORDER BY sha1(full_path), full_path) AS id, hash, mime_type, last_modified,
           file_size, base_path, file_path, full_path, file_name, file_ext
    FROM cat""")
def catalog_load(spark, sf):
    root = _write_scans(spark, sf, a=(0, 1, 2), c=(3, 4, 5))
    return load.load_catalog(spark, [f"{root}/a", f"{root}/c"]).catalog


@query("catalog_load_status", "cat", """
    SELECT 'a' AS name, 'loaded' AS status, count(*) AS row_count FROM cat WHERE base_path IN ('/vol/v0', '/vol/v1', '/vol/v2')
    UNION ALL SELECT 'none', 'skipped', 0
    UNION ALL SELECT 'b', 'failed', count(*) FROM cat WHERE base_path IN ('/vol/v2', '/vol/v3')
    UNION ALL SELECT 'c', 'not reached', count(*) FROM cat WHERE base_path IN ('/vol/v3', '/vol/v4', '/vol/v5')""")
def catalog_load_status(spark, sf):
    root = _write_scans(spark, sf, a=(0, 1, 2), b=(2, 3), c=(3, 4, 5))
    result = load.load_catalog(spark, [f"{root}/{n}" for n in ("a", "none", "b", "c")])
    return result.status.select(F.substring_index("path", "/", -1).alias("name"), "status", "row_count")


@query("assign_ids", "cat", """
    SELECT 5000000 + row_number() OVER (ORDER BY sha1(full_path), full_path) - 1 AS id, full_path FROM cat""")
def assign_ids(spark, sf):
    return load.assign_ids(tables.catalog(spark, sf).select("full_path"), 5000000).select("id", "full_path")


@query("content_inventory", "", """
    SELECT sha1(text) AS hash,
           TIMESTAMP '2024-01-01 00:00:00' + to_seconds((doc_id * 7919) % 31536000) AS last_modified,
           strlen(text) AS file_size, 'text/plain' AS mime_type, '/vol/' || source AS base_path,
           lang || '/' || CAST(doc_id AS VARCHAR) || '.TXT' AS file_path
    FROM documents""")
def content_inventory(spark, sf):
    docs = tables.table(spark, sf, "documents")
    age = F.make_dt_interval(secs=((F.col("doc_id") * 7919) % 31536000).cast("decimal(18,6)"))
    return inventory_source.inventory(
        docs,
        base=F.concat(F.lit("/vol/"), "source"),
        path=F.concat("lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".TXT")),
        body="text",
        mtime=F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + age,
    )


@query("content_inventory_pages", "", """
    SELECT sha1(html) AS hash, TIMESTAMP '2024-01-01 00:00:00' AS last_modified, strlen(html) AS file_size,
           'text/html' AS mime_type, '/web' AS base_path, CAST(page_id AS VARCHAR) || '.html' AS file_path
    FROM pages""")
def content_inventory_pages(spark, sf):
    return inventory_source.inventory(
        tables.table(spark, sf, "pages"),
        base=F.lit("/web"),
        path=F.concat(F.col("page_id").cast("string"), F.lit(".html")),
        body="html",
        mtime=F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"),
        include=["text"],
    )


@query("content_groups", "", """
    SELECT sha1(text) AS hash, count(*) AS copies, max(strlen(text)) AS file_size
    FROM documents GROUP BY ALL HAVING count(*) > 1""")
def content_groups(spark, sf):
    found = content_inventory(spark, sf).groupBy("hash").agg(
        F.count(F.lit(1)).alias("copies"), F.max("file_size").alias("file_size")
    )
    return found.where("copies > 1")


@query("split_by_mime", "good", """
    SELECT 'full' AS split, regexp_replace(mime_type, '[^a-zA-Z0-9]+', '_', 'g') AS split_key, count(*) AS row_count
    FROM good GROUP BY ALL
    UNION ALL
    SELECT 'major', split_part(mime_type, '/', 1), count(*) FROM good
    WHERE split_part(mime_type, '/', 1) IN ('image', 'video') GROUP BY ALL""")
def split_by_mime(spark, sf):
    rows = manifest_io.parse_strict(tables.manifest_text(spark, sf))[0]
    full = manifest.split_manifest(rows).select(F.lit("full").alias("split"), "split_key")
    major = manifest.split_manifest(rows, by_major=True, majors=["image", "video"]).select(
        F.lit("major").alias("split"), "split_key"
    )
    return full.unionByName(major).groupBy("split", "split_key").agg(F.count(F.lit(1)).alias("row_count"))


@query("split_write", "man", """
    SELECT 'all_' || regexp_replace(mime_type, '[^a-zA-Z0-9]+', '_', 'g') || '.meta' AS manifest,
           hash, file_size, base_path, file_path FROM man""")
def split_write(spark, sf):
    out = scratch_path(spark, "split")
    manifest_io.write_split(manifest.split_manifest(tables.manifest(spark, sf)), out, "all")
    stored = spark.read.schema("value string, manifest string").text(out)
    return manifest_io.parse_failfast(stored).select("manifest", "hash", "file_size", "base_path", "file_path")


@query("catalog_scan_by_base", "cat", "SELECT id, full_path FROM cat WHERE base_path = '/vol/v3'")
def catalog_scan_by_base(spark, sf):
    return cat_ops.scan_base(tables.catalog(spark, sf), "/vol/v3")


@query("missing_report_sink", "cat inv", """
    SELECT regexp_replace(split_part(base_path, '/', -1), '[^a-zA-Z0-9._-]', '_', 'g') || '_' || substr(sha1(base_path), 1, 8)
           AS missing_rows, id, full_path
    FROM cat WHERE full_path NOT IN (SELECT full_path FROM inv)""")
def missing_report_sink(spark, sf):
    out = scratch_path(spark, "missing")
    inventory_source.write_missing(reconcile_exists(spark, sf), out)
    stored = spark.read.schema("value string, missing_rows string").text(out)
    return stored.select(
        "missing_rows",
        F.substring_index("value", "\t", 1).cast("bigint").alias("id"),
        F.substring_index("value", "\t", -1).alias("full_path"),
    )


def _id_lines(spark, sf):
    """An id list with a header, padded ids and rows that are no ids."""
    e = tables.events(spark, sf)
    first = (
        F.when(F.col("event_id") == 0, F.lit("id"))
        .when(F.col("event_type") == "view", F.concat(F.lit("x"), F.col("id").cast("string")))
        .when(F.col("event_type") == "error", F.concat(F.lit("  "), F.col("id").cast("string"), F.lit(" \r")))
        .otherwise(F.col("id").cast("string"))
    )
    return e.select(
        F.col("base_path").alias("source"),
        (F.col("event_id") + 1).alias("line_no"),
        F.concat(first, F.lit("\t"), "base_path").alias("value"),
    )


@query("id_list_parse", "ev", """
    SELECT base_path AS source, id FROM ev WHERE event_type <> 'view' AND event_id <> 0""")
def id_list_parse(spark, sf):
    return manifest_io.parse_id_list(_id_lines(spark, sf))[0]


@query("id_list_bad_rows", "ev", """
    SELECT base_path AS source, count(*) FILTER (WHERE event_type = 'view' AND event_id <> 0) AS bad_rows
    FROM ev GROUP BY ALL""")
def id_list_bad_rows(spark, sf):
    return manifest_io.parse_id_list(_id_lines(spark, sf))[1]


@query("id_files_parse", "ev", """
    SELECT base_path AS source, id FROM ev WHERE event_type <> 'view' AND event_id <> 0""")
def id_files_parse(spark, sf):
    return manifest_io.parse_id_list(_in_files(spark, _id_lines(spark, sf)))[0]


@query("id_files_bad_rows", "ev", """
    SELECT base_path AS source, count(*) FILTER (WHERE event_type = 'view' AND event_id <> 0 AND line > 1) AS bad_rows
    FROM (SELECT *, row_number() OVER (PARTITION BY base_path ORDER BY event_id) AS line FROM ev) GROUP BY ALL""")
def id_files_bad_rows(spark, sf):
    return manifest_io.parse_id_list(_in_files(spark, _id_lines(spark, sf)))[1]


def _fix_lines(spark, sf):
    """Timestamp instructions for drift rows: a header, blanks, bad ids, and a
    second instruction for every vault copy some day later."""
    d = vault.timestamp_drift(*_catalog_args(spark, sf))
    first = actions.ts_fix_lines(d).select("value")
    lines = d.select(
        (F.col("vault_id") * 2).alias("line_no"),
        F.concat_ws("\t", F.col("vault_id").cast("string"), times.format_ts("target_last_modified"),
                    F.concat("vault_full_path", F.lit(" \r"))).alias("value"),
    )
    later = d.where("drift_seconds > 86400").select(
        (F.col("vault_id") * 2 + 1).alias("line_no"),
        F.concat_ws("\t", F.concat(F.lit(" "), F.col("vault_id").cast("string")),
                    times.format_ts(F.expr("target_last_modified + interval 1 day")), "vault_full_path").alias("value"),
    )
    noise = first.select(
        F.lit(1).cast("bigint").alias("line_no"), F.concat(F.lit("vault_id\t"), "value").alias("value")
    )
    return lines.unionByName(later).unionByName(noise)


FIXES_SQL = """
    SELECT vault_id * 2 AS line_no, vault_id, target_last_modified AS primary_last_modified, vault_full_path FROM drift
    UNION ALL
    SELECT vault_id * 2 + 1, vault_id, target_last_modified + INTERVAL 1 DAY, vault_full_path
    FROM drift WHERE drift_seconds > 86400"""


@query("ts_fix_files", "drift", f"""
    WITH fixes AS ({FIXES_SQL})
    SELECT (SELECT count(*) FROM drift) + row_number() OVER (ORDER BY line_no) AS line_no, vault_id,
           primary_last_modified, vault_full_path FROM fixes""")
def ts_fix_files(spark, sf):
    """Instructions from a file, which begins with as many skipped lines as there are drift rows."""
    return manifest_io.parse_ts_fixes(_in_files(spark, _fix_lines(spark, sf).withColumn("source", F.lit("fixes"))))



@query("ts_fix_parse", "drift", FIXES_SQL)
def ts_fix_parse(spark, sf):
    return manifest_io.parse_ts_fixes(_fix_lines(spark, sf))


@query("result_tsv", "dupes", "SELECT hash, mime_type, other_full_path FROM dupes")
def result_tsv(spark, sf):
    out = scratch_path(spark, "tsv")
    manifest_io.to_tsv(vault_dupes_short(spark, sf), out)
    return spark.read.schema("hash string, mime_type string, other_full_path string").csv(out, sep="\t")


@query("catalog_reset", "cat", """
    SELECT 1000000 + row_number() OVER (ORDER BY sha1(full_path), full_path) AS id, full_path FROM cat""")
def catalog_reset(spark, sf):
    """Ids of the first load after a reset."""
    out = scratch_path(spark, "reset")
    load.reset_catalog(spark, out)
    start = load.stored_next_id(spark, out)
    return load.assign_ids(tables.catalog(spark, sf).select("full_path"), start).select("id", "full_path")


# --- derived columns -----------------------------------------------------


@query("derive_paths", "ev", """
    SELECT id, '/vol/a b/' || '/' || file_path AS full_path, CAST(event_id AS VARCHAR) || '.DAT' AS file_name,
           'dat' AS file_ext,
           CASE event_type WHEN 'error' THEN '' WHEN 'click' THEN NULL WHEN 'view' THEN 'gz' ELSE NULL END AS ext,
           CASE event_type WHEN 'view' THEN 'gz' END AS ext_report,
           'a_b' AS segment,
           '/vol/x/' || CAST(event_id AS VARCHAR) || '/f.TAR.GZ' AS normalized,
           '/vol/a b/' || file_path AS expected_path,
           '/dest/' || CAST(event_id AS VARCHAR) || '.DAT' AS target
    FROM ev""")
def derive_paths(spark, sf):
    e = tables.events(spark, sf)
    number = F.col("event_id").cast("string")
    odd_name = (
        F.when(F.col("event_type") == "error", F.concat(F.lit("x/"), number, F.lit(".")))
        .when(F.col("event_type") == "click", F.concat(F.lit("x/."), number, F.lit("//")))
        .when(F.col("event_type") == "view", F.concat(F.lit("."), number, F.lit(".TAR.GZ")))
        .otherwise(number)
    )
    winding = F.concat(F.lit("/vol/x/./"), "event_type", F.lit("/../"), number, F.lit("//f.TAR.GZ"))
    base = F.lit("/vol/a b/")
    plain = F.concat("base_path", F.lit("/"), "file_path")
    return e.select(
        "id",
        paths.full_path(base, "file_path").alias("full_path"),
        paths.file_name("file_path").alias("file_name"),
        paths.file_ext("file_path").alias("file_ext"),
        paths.file_ext(odd_name).alias("ext"),
        paths.file_ext(odd_name, trailing_dot_null=True).alias("ext_report"),
        paths.base_segment(base).alias("segment"),
        paths.normalize_path(winding).alias("normalized"),
        paths.expected_full_path(base, F.concat(F.lit("//"), "file_path")).alias("expected_path"),
        paths.copy_target(plain, F.lit("/dest")).alias("target"),
    )


@query("derive_mime", "ev", """
    SELECT id,
           CASE event_type WHEN 'error' THEN '/x' WHEN 'click' THEN 'plain' WHEN 'view' THEN '' ELSE 'IMAGE' END AS major,
           CASE event_type WHEN 'error' THEN '' WHEN 'click' THEN 'plain' WHEN 'view' THEN '' ELSE 'IMAGE' END AS major_report,
           event_type IN ('purchase', 'signup') AS image,
           CASE event_type WHEN 'error' THEN '_x' WHEN 'click' THEN 'plain' WHEN 'view' THEN ''
                           ELSE 'IMAGE_svg_xml_q_1' END AS sanitized,
           CASE event_type WHEN 'error' THEN '/x' WHEN 'click' THEN 'plain' WHEN 'view' THEN ''
                           ELSE 'IMAGE/svg+xml' END AS cleaned,
           event_type IN ('purchase', 'signup') AS valid,
           CASE event_type WHEN 'error' THEN 'image/jpeg' WHEN 'click' THEN 'text/html'
                           WHEN 'view' THEN 'application/octet-stream' ELSE 'video/quicktime' END AS guessed
    FROM ev""")
def derive_mime(spark, sf):
    e = tables.events(spark, sf)

    def per_type(error, click, view, other):
        kind = F.col("event_type")
        return F.when(kind == "error", error).when(kind == "click", click).when(kind == "view", view).otherwise(other)

    m = per_type("/x", "plain", "", "IMAGE/svg+xml; q=1")
    name = F.concat(F.col("event_id").cast("string"), per_type(".JPG", ".a.Htm", "", ".mov"))
    cleaned = mime.mime_clean(m)
    return e.select(
        "id",
        mime.major_type(m).alias("major"),
        mime.major_type(m, report=True).alias("major_report"),
        mime.is_image(m).alias("image"),
        mime.sanitize_mime(m).alias("sanitized"),
        cleaned.alias("cleaned"),
        mime.mime_valid(cleaned).alias("valid"),
        mime.mime_from_name(name).alias("guessed"),
    )


SCALED = """CAST(CASE event_type WHEN 'error' THEN file_size WHEN 'click' THEN file_size * 1000
    WHEN 'view' THEN file_size * 1000000 WHEN 'purchase' THEN file_size * 1000000000
    ELSE file_size * 1000000000000 END AS BIGINT)"""


@query("derive_sizes", "ev", f"""
    SELECT id, {sql.binary('n')} AS text_binary, {sql.si2('n')} AS text_si2, {sql.iec1('n')} AS text_iec1,
           {sql.si1('n')} AS text_si1, {sql.si1_trunc('n')} AS text_si1_trunc,
           CASE WHEN n < 1000 THEN '< 1KB' WHEN n < 1000000 THEN 'KB' WHEN n < 1000000000 THEN 'MB'
                WHEN n < 1000000000000 THEN 'GB' ELSE 'TB' END AS bucket
    FROM (SELECT id, {SCALED} AS n FROM ev)""")
def derive_sizes(spark, sf):
    n = tables.events(spark, sf).select("id", F.expr(SCALED).alias("n"))
    return n.select(
        "id", *[sizes.size_text("n", s).alias(f"text_{s}") for s in sizes.STYLES], sizes.size_bucket("n").alias("bucket")
    )


@query("derive_times", "ev", f"""
    SELECT id, CASE WHEN event_type = 'view' THEN NULL ELSE last_modified END AS parsed,
           strftime(last_modified, '%Y-%m-%d %H:%M:%S') AS printed,
           CAST({DELTA.format("date_diff('second', TIMESTAMP '2024-01-01 00:00:00', last_modified)")} AS DOUBLE) AS age_days,
           date_diff('second', TIMESTAMP '2024-01-01 00:00:00', last_modified) AS age_seconds
    FROM ev""")
def derive_times(spark, sf):
    e = tables.events(spark, sf)
    text = F.when(F.col("event_type") == "view", times.format_ts("last_modified")).otherwise(
        times.format_iso("last_modified")
    )
    origin = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    return e.select(
        "id",
        times.parse_ts(text).alias("parsed"),
        times.format_ts("last_modified").alias("printed"),
        times.delta_days("last_modified", origin).cast("double").alias("age_days"),
        times.drift_seconds("last_modified", origin).alias("age_seconds"),
    )


@query("derive_validity", "good", """
    SELECT source, line_no, regexp_full_match(hash, '[0-9a-fA-F]{40}') AS manifest_hash,
           regexp_full_match(hash, '[0-9a-f]{40}') AS catalog_hash,
           regexp_full_match(file_size, '[+-]?[0-9]+') AS size_ok
    FROM good""")
def derive_validity(spark, sf):
    good, _ = manifest_io.parse_strict(tables.manifest_text(spark, sf))
    return good.select(
        "source",
        "line_no",
        validity.hash_valid("hash").alias("manifest_hash"),
        validity.hash_valid("hash", lower_only=True).alias("catalog_hash"),
        validity.size_valid("file_size").alias("size_ok"),
    )


# --- filters -------------------------------------------------------------


@query("mime_filter", "man", "SELECT * FROM man WHERE split_part(mime_type, '/', 1) IN ('image', 'video')")
def mime_filter(spark, sf):
    return cat_ops.mime_filter(tables.manifest(spark, sf), ["image", "video"])


@query("category_filter", "files", """
    SELECT category, mime_type, file_size, file_name, file_ext, base_path, file_path, full_path
    FROM files WHERE disposition = 'primary' AND category IN ('image', 'audio')""")
def category_filter(spark, sf):
    return reports.category_filter(*_full_args(spark, sf), ["image", "audio"])


@query("primary_only", "files", f"SELECT {FILES_NO_NUM} FROM files WHERE disposition = 'primary'")
def primary_only(spark, sf):
    return cat_ops.files_primary(*_full_args(spark, sf))


@query("redundant_only", "files", f"SELECT {FILES_NO_NUM} FROM files WHERE disposition = 'redundant'")
def redundant_only(spark, sf):
    return cat_ops.files_redundant(*_full_args(spark, sf))


@query("path_prefix_filter", "files", """
    SELECT id, hash, mime_type, full_path FROM files
    WHERE disposition = 'redundant' AND starts_with(full_path, '/vol/v3/p')""")
def path_prefix_filter(spark, sf):
    return reports.path_prefix_filter(*_catalog_args(spark, sf), "/vol/v3/p")


@query("vault_guard", "cat", """
    SELECT id, full_path = '/vol/v1' OR starts_with(full_path, '/vol/v1/') AS guarded FROM cat""")
def vault_guard(spark, sf):
    return tables.catalog(spark, sf).select("id", paths.under("full_path", F.lit("/vol/v1")).alias("guarded"))


@query("lookup_by_id", "ev cat inv", f"""
    WITH req AS (SELECT DISTINCT CASE event_type WHEN 'error' THEN 'id-' || CAST(user_id AS VARCHAR)
                                 WHEN 'view' THEN CAST(user_id + 900000000 AS VARCHAR)
                                 ELSE CAST(user_id + 1000001 AS VARCHAR) END AS requested FROM ev)
    SELECT requested, CASE WHEN c.id IS NULL THEN 'unknown id' WHEN i.full_path IS NOT NULL THEN 'found'
                           ELSE 'missing file' END AS status,
           c.mime_type, {sql.si1_trunc('c.file_size')} AS size_text,
           strftime(c.last_modified, '%Y-%m-%d %H:%M:%S') AS modified, c.full_path
    FROM req LEFT JOIN cat c ON c.id = TRY_CAST(requested AS BIGINT)
             LEFT JOIN inv i ON i.full_path = c.full_path AND i.is_regular""")
def lookup_by_id(spark, sf):
    e = tables.events(spark, sf)
    user = F.col("user_id")
    requested = (
        F.when(F.col("event_type") == "error", F.concat(F.lit("id-"), user.cast("string")))
        .when(F.col("event_type") == "view", (user + 900000000).cast("string"))
        .otherwise((user + 1000001).cast("string"))
    )
    return maintain.lookup_by_id(
        tables.catalog(spark, sf), e.select(requested.alias("id")), tables.inventory(spark, sf)
    )


def _bucketed_args(spark, sf):
    """The catalog stored in buckets, its largest groups kept apart."""
    path = scratch_path(spark, "bucketed")
    table = f"copyledger_{path.rsplit('-', 1)[1]}"
    stored = bucketed.write_bucketed(tables.catalog(spark, sf), path, table, 8, crowded_rows=4)
    return stored, tables.base_paths(spark)


@query("files_bucketed", "files", """
    SELECT id, hash, mime_type, category, full_path, disposition FROM files""")
def files_bucketed(spark, sf):
    files = cat_ops.files(*_bucketed_args(spark, sf), tables.categories(spark), with_group_num=False)
    return files.select("id", "hash", "mime_type", "category", "full_path", "disposition")


@query("vault_dupes_bucketed", "dupes", "SELECT hash, mime_type, other_full_path FROM dupes")
def vault_dupes_bucketed(spark, sf):
    return vault.vault_dupes(*_bucketed_args(spark, sf), VAULT)


@query("media_family", "files", """
    SELECT family, wanted, count(*) AS row_count, CAST(sum(file_size) AS BIGINT) AS total_bytes FROM (
        SELECT v.family, w.wanted, f.file_size
        FROM files f
        JOIN (VALUES ('files', NULL), ('media', 'image'), ('media', 'video'), ('media', 'audio'), ('images', 'image'),
                     ('videos', 'video'), ('audio', 'audio')) v(family, category) ON v.category IS NULL OR v.category = f.category
        JOIN (VALUES ('any'), ('primary'), ('redundant')) w(wanted) ON w.wanted IN ('any', f.disposition))
    GROUP BY ALL""")
def media_family(spark, sf):
    """Rows and bytes of every family and disposition, from one pass over the
    ranked catalog; the per-category totals are then spread over the families."""
    ranked = cat_ops.files(*_full_args(spark, sf), with_group_num=False)
    per_category = ranked.groupBy("category", "disposition").agg(
        F.count(F.lit(1)).alias("_n"), sizes.exact_sum("file_size").alias("_b")
    )
    member = {
        family: F.lit(True) if chosen is None else F.coalesce(F.col("category").isin(chosen), F.lit(False))
        for family, chosen in cat_ops.FAMILY_CATEGORIES.items()
    }
    families = F.array_compact(F.array(*[F.when(test, F.lit(family)) for family, test in member.items()]))
    spread = per_category.withColumn("family", F.explode(families)).withColumn(
        "wanted", F.explode(F.array(F.lit("any"), "disposition"))
    )
    totals = spread.groupBy("family", "wanted").agg(
        F.sum("_n").alias("row_count"), sizes.exact_sum("_b").alias("total_bytes")
    )
    return _as_bigint(totals, "total_bytes")


def _register_view(family: str, wanted: str | None) -> None:
    tests = {"media": "category IN ('image', 'video', 'audio')", "images": "category = 'image'",
             "videos": "category = 'video'", "audio": "category = 'audio'"}
    test = tests[family] + (f" AND disposition = '{wanted}'" if wanted else "")

    @query(f"{family}_{wanted}" if wanted else family, "files", f"SELECT {FILES_NO_NUM} FROM files WHERE {test}")
    def view(spark, sf):
        return cat_ops.media_view(*_full_args(spark, sf), family, wanted)


for _family in ("media", "images", "videos", "audio"):
    for _wanted in (None, "primary", "redundant"):
        _register_view(_family, _wanted)


# --- joins ---------------------------------------------------------------


@query("join_base_paths", "vis", "SELECT id, base_path, priority, is_vault FROM vis")
def join_base_paths(spark, sf):
    rows = cat_ops.with_base_paths(*_catalog_args(spark, sf))
    return rows.select("id", "base_path", "priority", "is_vault")


@query("join_categories", "cat mc", "SELECT id, mime_type, category FROM cat LEFT JOIN mc USING (mime_type)")
def join_categories(spark, sf):
    rows = cat_ops.with_categories(tables.catalog(spark, sf), tables.categories(spark))
    return rows.select("id", "mime_type", "category")


@query("join_category_inner", "files", """
    SELECT id, category, file_size FROM files WHERE disposition = 'primary' AND category IS NOT NULL""")
def join_category_inner(spark, sf):
    cat, bp, mc = _full_args(spark, sf)
    rows = cat_ops.files_primary(cat, bp, mc).drop("category")
    return cat_ops.with_known_category(rows, mc).select("id", "category", "file_size")


@query("manifest_intersect", "man_a man_b", """
    SELECT * FROM man_a WHERE hash IN (SELECT hash FROM man_b) AND split_part(mime_type, '/', 1) IN ('image', 'application')""")
def manifest_intersect(spark, sf):
    a, b = _manifest_pair(spark, sf)
    return manifest.intersect(a, b, ["image", "application"])


@query("manifest_purge", "man_a man_b", """
    SELECT *, (hash, mime_type) IN (SELECT (hash, mime_type) FROM man_a)
              AND split_part(mime_type, '/', 1) IN ('image', 'video') AS matched
    FROM man_b""")
def manifest_purge(spark, sf):
    a, b = _manifest_pair(spark, sf)
    return manifest.purge_split(a, b, ["image", "video"])


@query("manifest_select_scope", "scope", "SELECT * FROM scope")
def manifest_select_scope(spark, sf):
    return manifest.select_scope(*_manifest_pair(spark, sf))


@query("vault_dupes", "dupes", f"""
    SELECT hash, mime_type, vault_full_path, vault_last_modified, dupe_last_modified,
           CAST({DELTA.format('age')} AS DOUBLE) AS delta_days, other_base_path, other_full_path FROM dupes""")
def vault_dupes(spark, sf):
    return _as_double(vault.vault_dupes(*_catalog_args(spark, sf), VAULT, full=True), "delta_days")


@query("vault_dupes_short", "dupes", "SELECT hash, mime_type, other_full_path FROM dupes")
def vault_dupes_short(spark, sf):
    return vault.vault_dupes(*_catalog_args(spark, sf), VAULT)


@query("vault_dupes_images", "dupes", """
    SELECT hash, mime_type, other_full_path FROM dupes WHERE mime_type LIKE 'image%'""")
def vault_dupes_images(spark, sf):
    return vault.vault_dupes(*_catalog_args(spark, sf), VAULT, mime_prefix="image")


@query("unvaulted_primaries", "files", f"""
    SELECT p.hash, p.mime_type, p.file_size AS size_bytes,
           CAST({DELTA.format("date_diff('second', p.last_modified, v.last_modified)")} AS DOUBLE) AS delta_days,
           v.id AS vault_id, p.id AS primary_id, v.last_modified AS vault_last_modified,
           p.last_modified AS primary_last_modified, v.full_path AS vault_full_path, p.full_path AS primary_full_path
    FROM files p JOIN files v ON v.hash = p.hash AND v.base_path = '/vol/v0' AND v.category = 'image'
    WHERE p.disposition = 'primary' AND p.category = 'image' AND p.base_path <> '/vol/v0'
      AND v.last_modified > p.last_modified""")
def unvaulted_primaries(spark, sf):
    return _as_double(vault.unvaulted_primaries(*_full_args(spark, sf), VAULT), "delta_days")


@query("timestamp_drift", "drift", "SELECT * FROM drift")
def timestamp_drift(spark, sf):
    return vault.timestamp_drift(*_catalog_args(spark, sf))


def _removal_targets(spark, sf):
    """Target files spelled with a dot segment, and some no manifest lists."""
    e = tables.events(spark, sf).where("base_path = '/vol/v3' AND event_type = 'purchase'")
    listed = e.select(F.concat("base_path", F.lit("/./"), "file_path").alias("path"))
    return listed.unionByName(e.select(F.concat(F.lit("/vol/none/"), F.col("user_id").cast("string")).alias("path")))


REMOVE_SQL = """
    SELECT CASE WHEN i.full_path IS NULL THEN 'not_found' ELSE 'delete' END AS status, c.hash, c.mime_type,
           c.full_path AS path
    FROM cat c LEFT JOIN inv i ON i.full_path = c.full_path AND i.is_regular
    WHERE (c.hash, c.mime_type) IN (SELECT (hash, mime_type) FROM ev WHERE base_path = '/vol/v3' AND event_type = 'purchase')
    UNION ALL
    SELECT DISTINCT 'no_meta', NULL, NULL, '/vol/none/' || CAST(user_id AS VARCHAR) FROM ev
    WHERE base_path = '/vol/v3' AND event_type = 'purchase'"""


@query("remove_log", "ev cat inv", REMOVE_SQL)
def remove_log(spark, sf):
    return manifest.remove_log(
        tables.manifest(spark, sf), _removal_targets(spark, sf), tables.inventory(spark, sf)
    )


@query("remove_group", "ev cat", """
    SELECT hash, mime_type, full_path AS path FROM cat
    WHERE (hash, mime_type) IN (SELECT (hash, mime_type) FROM ev WHERE base_path = '/vol/v3' AND event_type = 'purchase')""")
def remove_group(spark, sf):
    return remove_log(spark, sf).where("status <> 'no_meta'").select("hash", "mime_type", "path")


@query("remove_targets", "inv", """
    SELECT full_path AS path FROM inv WHERE is_regular AND (starts_with(full_path, '/vol/v3/purchase/')
        OR starts_with(full_path, '/vol/v4/'))""")
def remove_targets(spark, sf):
    """Directories named on the command line, expanded to their files."""
    e = tables.events(spark, sf)
    folders = e.where("base_path = '/vol/v3' AND event_type = 'purchase'").select(
        F.concat("base_path", F.lit("/"), "event_type").alias("path")
    )
    volumes = e.where("base_path = '/vol/v4'").select(F.concat("base_path", F.lit("/.")).alias("path"))
    return manifest.expand_targets(folders.unionByName(volumes), tables.inventory(spark, sf))


@query("reconcile_exists", "cat inv", """
    SELECT id, base_path, full_path FROM cat WHERE full_path NOT IN (SELECT full_path FROM inv)""")
def reconcile_exists(spark, sf):
    return inventory_source.missing_rows(
        tables.catalog(spark, sf), tables.inventory(spark, sf), tables.mounted_bases(spark, sf)
    )


@query("manifest_clean", "cleaned", "SELECT * FROM cleaned")
def manifest_clean(spark, sf):
    rows, now = tables.manifest(spark, sf), tables.inventory(spark, sf)
    return manifest.clean(rows, now, tables.mounted_bases(spark, sf), full_check=True)


@query("manifest_clean_quick", "cleaned", """
    SELECT * REPLACE (CASE WHEN reason = 'file missing' THEN reason END AS reason) FROM cleaned""")
def manifest_clean_quick(spark, sf):
    return manifest.clean(tables.manifest(spark, sf), tables.inventory(spark, sf), tables.mounted_bases(spark, sf))


@query("delete_by_id", "cat inv", "SELECT id, full_path FROM cat WHERE full_path IN (SELECT full_path FROM inv)")
def delete_by_id(spark, sf):
    gone = reconcile_exists(spark, sf)
    return maintain.delete_by_id(tables.catalog(spark, sf), gone).select("id", "full_path")


def _snapshots(spark, sf):
    """The catalog as a stored one of which single base paths are rewritten."""
    store = StoredCatalog(spark, scratch_path(spark, "snapshots"))
    rows = tables.catalog(spark, sf)
    store.create(rows, load.next_id(rows))
    return store


@query("snapshot_delete_by_id", "cat inv", "SELECT id, full_path FROM cat WHERE full_path IN (SELECT full_path FROM inv)")
def snapshot_delete_by_id(spark, sf):
    store = _snapshots(spark, sf)
    store.delete_by_id(reconcile_exists(spark, sf))
    return store.rows().select("id", "full_path")


@query("snapshot_taken_paths", "cat inv", "SELECT full_path FROM cat WHERE full_path IN (SELECT full_path FROM inv)")
def snapshot_taken_paths(spark, sf):
    return _snapshots(spark, sf).taken(tables.inventory(spark, sf))


@query("snapshot_update_timestamp", "cat drift", """
    SELECT c.id, CASE WHEN d.vault_id IS NULL THEN c.last_modified
                      WHEN d.drift_seconds > 86400 THEN d.target_last_modified + INTERVAL 1 DAY
                      ELSE d.target_last_modified END AS last_modified
    FROM cat c LEFT JOIN drift d ON d.vault_id = c.id""")
def snapshot_update_timestamp(spark, sf):
    store = _snapshots(spark, sf)
    store.update_timestamps(ts_fix_parse(spark, sf))
    return store.rows().select("id", "last_modified")


@query("delete_by_id_dry_run", "cat inv", """
    SELECT count(*) AS would_delete FROM cat WHERE full_path NOT IN (SELECT full_path FROM inv)""")
def delete_by_id_dry_run(spark, sf):
    return maintain.delete_by_id(tables.catalog(spark, sf), reconcile_exists(spark, sf), dry_run=True)


@query("delete_by_path", "files cat inv", """
    SELECT id, full_path FROM cat WHERE full_path NOT IN (
        SELECT full_path FROM files WHERE disposition = 'redundant'
        AND full_path NOT IN (SELECT full_path FROM inv WHERE is_regular))""")
def delete_by_path(spark, sf):
    stale = redundant_plan(spark, sf).where("action = 'stale-row'")
    return maintain.delete_by_path(tables.catalog(spark, sf), stale).select("id", "full_path")


@query("update_timestamp", "cat drift", """
    SELECT c.id, CASE WHEN d.vault_id IS NULL THEN c.last_modified
                      WHEN d.drift_seconds > 86400 THEN d.target_last_modified + INTERVAL 1 DAY
                      ELSE d.target_last_modified END AS last_modified
    FROM cat c LEFT JOIN drift d ON d.vault_id = c.id""")
def update_timestamp(spark, sf):
    fixes = ts_fix_parse(spark, sf)
    return maintain.update_timestamps(tables.catalog(spark, sf), fixes).select("id", "last_modified")


# --- aggregations --------------------------------------------------------


@query("manifest_summary", "good", f"""
    SELECT total_entries, unique_hashes, total_entries - unique_hashes AS duplicated_hashes,
           {sql.percent('total_entries - unique_hashes', 'total_entries', 1)} AS duplicated_pct,
           {sql.fixed('bytes', 10**9, 1)} || ' GB' AS total_size, oldest, newest
    FROM (SELECT count(*) AS total_entries, count(DISTINCT hash) AS unique_hashes,
                 sum(TRY_CAST(file_size AS BIGINT)) AS bytes,
                 strftime(min(TRY_CAST(last_modified AS TIMESTAMP)), '%Y-%m-%dT%H:%M:%S') AS oldest,
                 strftime(max(TRY_CAST(last_modified AS TIMESTAMP)), '%Y-%m-%dT%H:%M:%S') AS newest FROM good)""")
def manifest_summary(spark, sf):
    return manifest.summary(manifest_io.parse_strict(tables.manifest_text(spark, sf))[0])


@query("summary_mime_full", "good", "SELECT mime_type, count(*) AS file_count FROM good GROUP BY ALL")
def summary_mime_full(spark, sf):
    return manifest.summary_mime(manifest_io.parse_strict(tables.manifest_text(spark, sf))[0], major=False)


@query("summary_mime_major", "good", """
    SELECT split_part(mime_type, '/', 1) AS major_type, count(*) AS file_count FROM good GROUP BY ALL""")
def summary_mime_major(spark, sf):
    return manifest.summary_mime(manifest_io.parse_strict(tables.manifest_text(spark, sf))[0])


@query("summary_size_buckets", "good", """
    SELECT b.bucket, count(g.n) AS file_count
    FROM (VALUES ('< 1KB', -9223372036854775808, 1000), ('KB', 1000, 1000000), ('MB', 1000000, 1000000000),
                 ('GB', 1000000000, 1000000000000), ('TB', 1000000000000, 9223372036854775807)) b(bucket, lo, hi)
    LEFT JOIN (SELECT TRY_CAST(file_size AS BIGINT) AS n FROM good) g ON g.n >= b.lo AND g.n < b.hi
    GROUP BY ALL""")
def summary_size_buckets(spark, sf):
    return manifest.summary_size_buckets(manifest_io.parse_strict(tables.manifest_text(spark, sf))[0])


@query("mime_duplication_summary", "files", f"""
    SELECT mime_type, primary_count, redundant_count, {sql.si2('bytes')} AS redundant_size,
           {sql.percent('redundant_count', 'total', 2)} AS pct_duplication
    FROM (SELECT mime_type, count(*) FILTER (WHERE disposition = 'primary') AS primary_count,
                 count(*) FILTER (WHERE disposition = 'redundant') AS redundant_count, count(*) AS total,
                 coalesce(sum(file_size) FILTER (WHERE disposition = 'redundant'), 0) AS bytes
          FROM files GROUP BY mime_type)""")
def mime_duplication_summary(spark, sf):
    return reports.mime_duplication_summary(*_catalog_args(spark, sf))


@query("redundant_by_mime", "files", f"""
    SELECT mime_type, file_count, {sql.iec1('bytes')} AS size_binary
    FROM (SELECT mime_type, count(*) AS file_count, sum(file_size) AS bytes
          FROM files WHERE disposition = 'redundant' GROUP BY mime_type)""")
def redundant_by_mime(spark, sf):
    return reports.redundant_by_mime(*_catalog_args(spark, sf))


@query("redundant_by_hash", "files", f"""
    SELECT hash, mime_type, file_count, {sql.iec1('bytes')} AS size_binary
    FROM (SELECT hash, mime_type, count(*) AS file_count, sum(file_size) AS bytes
          FROM files WHERE disposition = 'redundant' GROUP BY hash, mime_type)""")
def redundant_by_hash(spark, sf):
    return reports.redundant_by_mime(*_catalog_args(spark, sf), by_hash=True)


@query("category_sizes", "files", f"""
    SELECT category, {sql.si1('bytes')} AS si_pretty
    FROM (SELECT category, sum(file_size) AS bytes FROM files
          WHERE disposition = 'primary' AND category IS NOT NULL GROUP BY category)""")
def category_sizes(spark, sf):
    return reports.category_sizes(*_full_args(spark, sf))


def _most_common(name: str, column: str) -> None:
    body = f"""
        SELECT {column}, CAST(sum(file_size) AS BIGINT) AS total_bytes, count(*) AS file_count
        FROM cat GROUP BY {column}"""

    @query(name, "cat", body)
    def run(spark, sf):
        return _as_bigint(reports.most_common(tables.catalog(spark, sf), column), "total_bytes")


_most_common("common_mime", "mime_type")
_most_common("common_ext", "file_ext")
_most_common("common_name", "file_name")


@query("common_category", "cat mc", """
    SELECT category, CAST(sum(file_size) AS BIGINT) AS total_bytes, count(*) AS file_count
    FROM cat LEFT JOIN mc USING (mime_type) GROUP BY category""")
def common_category(spark, sf):
    found = reports.common_category(tables.catalog(spark, sf), tables.categories(spark))
    return _as_bigint(found, "total_bytes")


@query("files_view_summary", "files", """
    SELECT count(*) FILTER (WHERE disposition = 'primary') AS primaries,
           count(*) FILTER (WHERE disposition = 'redundant') AS redundants, count(*) AS total_rows FROM files""")
def files_view_summary(spark, sf):
    return reports.files_view_summary(*_catalog_args(spark, sf))


@query("purge_summary", "man_a man_b", f"""
    SELECT matched, reference_keys, matched AS planned, retained, {sql.binary('bytes')} AS space_saved FROM (
        SELECT count(*) FILTER (WHERE m) AS matched, count(*) FILTER (WHERE NOT m) AS retained,
               coalesce(sum(file_size) FILTER (WHERE m), 0) AS bytes,
               (SELECT count(*) FROM (SELECT DISTINCT hash, mime_type FROM man_a)) AS reference_keys
        FROM (SELECT *, (hash, mime_type) IN (SELECT (hash, mime_type) FROM man_a) AS m FROM man_b))""")
def purge_summary(spark, sf):
    a, b = _manifest_pair(spark, sf)
    return manifest.purge_summary(manifest.purge_split(a, b), a)


@query("purge_groups", "man_a man_b", """
    SELECT hash, mime_type, count(*) AS matched_rows, CAST(sum(file_size) AS BIGINT) AS matched_bytes FROM man_b
    WHERE (hash, mime_type) IN (SELECT (hash, mime_type) FROM man_a) GROUP BY ALL""")
def purge_groups(spark, sf):
    groups = manifest.purge_groups(manifest.purge_split(*_manifest_pair(spark, sf)))
    return _as_bigint(groups, "matched_bytes")


@query("select_summary", "best scope", f"""
    SELECT {sql.binary('s')} AS selected_size, {sql.binary('u')} AS unselected_size, d AS to_delete FROM (
        SELECT (SELECT coalesce(sum(file_size), 0) FROM best) AS s,
               (SELECT coalesce(sum(file_size), 0) FROM (SELECT DISTINCT * FROM scope EXCEPT
                       SELECT * EXCLUDE group_size FROM best)) AS u,
               (SELECT count(*) FROM scope) - (SELECT count(*) FROM best) AS d)""")
def select_summary(spark, sf):
    return manifest.select_summary(manifest.select_scope(*_manifest_pair(spark, sf)))


VIEW_SQL = """
    SELECT hash, split_part(mime_type, '/', 1) AS major_type, count(*) AS group_count,
           first(mime_type ORDER BY last_modified, base_path, file_path) AS full_mime
    FROM man GROUP BY ALL"""


@query("duplicate_groups", "man", VIEW_SQL + " HAVING count(*) > 1")
def duplicate_groups(spark, sf):
    return manifest.duplicate_groups(tables.manifest(spark, sf), drop_unique=True)


@query("view_summary", "man", f"""
    SELECT count(*) AS groups, CAST(sum(group_count) AS BIGINT) AS items FROM ({VIEW_SQL})""")
def view_summary(spark, sf):
    return manifest.view_summary(tables.manifest(spark, sf))


@query("plan_status_counts", "dupes inv", """
    SELECT CASE WHEN i.full_path IS NULL THEN 'missing' WHEN NOT is_regular THEN 'not-regular'
                WHEN NOT is_writable THEN 'no-permission' ELSE 'would-remove' END AS status, count(*) AS row_count
    FROM dupes LEFT JOIN inv i ON i.full_path = other_full_path GROUP BY ALL""")
def plan_status_counts(spark, sf):
    return actions.plan_status_counts(vault_purge_plan(spark, sf))


@query("clean_summary", "cleaned", """
    SELECT base_path, count(*) AS examined, count(*) FILTER (WHERE reason IS NULL) AS kept,
           count(*) FILTER (WHERE reason IS NOT NULL) AS removed FROM cleaned GROUP BY base_path""")
def clean_summary(spark, sf):
    return manifest.clean_summary(manifest_clean(spark, sf), "base_path")


# --- numbering and ranking -----------------------------------------------


@query("group_num", "ranked", "SELECT DISTINCT hash, mime_type, group_num FROM ranked")
def group_num(spark, sf):
    return cat_ops.group_num(*_catalog_args(spark, sf))


@query("rank_in_group", "ranked", "SELECT id, hash, mime_type, rn FROM ranked")
def rank_in_group(spark, sf):
    return cat_ops.rank_in_group(*_catalog_args(spark, sf)).select("id", "hash", "mime_type", "rn")


@query("rank_in_group_split", "ranked", "SELECT id, hash, mime_type, rn FROM ranked")
def rank_in_group_split(spark, sf):
    """In so many ranges that groups are split among them."""
    ranked = cat_ops.rank_in_group(*_catalog_args(spark, sf), ranges=64)
    return ranked.select("id", "hash", "mime_type", "rn")


@query("group_num_any_shape", "ranked", "SELECT DISTINCT hash, mime_type, group_num FROM ranked")
def group_num_any_shape(spark, sf):
    return cat_ops.group_num(*_catalog_args(spark, sf), digests=False)


@query("group_size", "ranked", "SELECT id, hash, mime_type, grp_size FROM ranked")
def group_size(spark, sf):
    return cat_ops.group_size(*_catalog_args(spark, sf)).select("id", "hash", "mime_type", "grp_size")


@query("files", "files", "SELECT * FROM files")
def files(spark, sf):
    return cat_ops.files(*_full_args(spark, sf))


@query("files_unnumbered", "files", f"SELECT {FILES_NO_NUM} FROM files")
def files_unnumbered(spark, sf):
    return cat_ops.files(*_full_args(spark, sf), with_group_num=False)


@query("oldest_and_vault_pick", "oldest pick", """
    SELECT * REPLACE (coalesce(vault_id, 0) AS vault_id, coalesce(vault_priority, 0) AS vault_priority)
    FROM oldest LEFT JOIN pick USING (hash, mime_type)""")
def oldest_and_vault_pick(spark, sf):
    """Numbers of absent vault copies read 0, so that they stay integers."""
    picks = vault.oldest_and_vault_pick(*_catalog_args(spark, sf))
    return picks.fillna(0, ["vault_id", "vault_priority"])


@query("manifest_select_best", "best", "SELECT * FROM best")
def manifest_select_best(spark, sf):
    return manifest.select_best(manifest.select_scope(*_manifest_pair(spark, sf)))


@query("seed_priority", "cat", """
    SELECT base_path, CAST(row_number() OVER (ORDER BY base_path) AS INTEGER) AS priority, FALSE AS is_vault
    FROM (SELECT DISTINCT base_path FROM cat)""")
def seed_priority(spark, sf):
    return maintain.seed_priority(tables.catalog(spark, sf))


# --- ordered output ------------------------------------------------------


@query("drift_worklist", "drift", """
    SELECT * REPLACE (strftime(target_last_modified, '%Y-%m-%d %H:%M:%S') AS target_last_modified,
                      strftime(vault_last_modified, '%Y-%m-%d %H:%M:%S') AS vault_last_modified) FROM drift""")
def drift_worklist(spark, sf):
    return vault.drift_worklist(timestamp_drift(spark, sf))


@query("group_listing", "man", f"""
    SELECT g.hash, g.major_type, g.group_count, g.full_mime, m.last_modified, m.base_path || '/' || m.file_path AS full_path
    FROM ({VIEW_SQL} HAVING count(*) > 1) g
    JOIN man m ON m.hash = g.hash AND split_part(m.mime_type, '/', 1) = g.major_type""")
def group_listing(spark, sf):
    return manifest.group_listing(tables.manifest(spark, sf), drop_unique=True)


# --- set operations ------------------------------------------------------


@query("union_manifests", "man_a man_b", "SELECT * FROM man_a UNION ALL SELECT * FROM man_b")
def union_manifests(spark, sf):
    return manifest.union_manifests(*_manifest_pair(spark, sf))


@query("unselected", "best scope", "SELECT DISTINCT * FROM scope EXCEPT SELECT * EXCLUDE group_size FROM best")
def unselected(spark, sf):
    return manifest.unselected(manifest.select_scope(*_manifest_pair(spark, sf)))


@query("distinct_categories", "cat mc", "SELECT DISTINCT category FROM cat JOIN mc USING (mime_type)")
def distinct_categories(spark, sf):
    return category_source.seed_categories(tables.catalog(spark, sf), tables.categories(spark)).select("category").distinct()


@query("distinct_base_paths", "cat", "SELECT DISTINCT base_path FROM cat")
def distinct_base_paths(spark, sf):
    return tables.live_bases(spark, sf)


@query("reference_keys", "man_a", "SELECT DISTINCT hash, mime_type FROM man_a")
def reference_keys(spark, sf):
    return manifest.reference_keys(_manifest_pair(spark, sf)[0])


# --- maintenance plans ---------------------------------------------------

SEEDED_SQL = """
    SELECT base_path, CASE WHEN base_path = '/vol/v5' THEN 50 ELSE priority END AS priority,
           is_vault OR base_path = '/vol/v5' AS is_vault
    FROM (SELECT * FROM bp UNION ALL
          SELECT base_path, n, FALSE FROM (SELECT base_path, CAST(row_number() OVER (ORDER BY base_path) AS INTEGER) AS n
                                           FROM (SELECT DISTINCT base_path FROM cat))
          WHERE base_path NOT IN (SELECT base_path FROM bp))"""


@query("seed_base_paths", "cat bp", SEEDED_SQL)
def seed_base_paths(spark, sf):
    """Adds /vol/v5, whose configured priority collides with /vol/v4's."""
    overlay = spark.createDataFrame([("/vol/v5", 50, True)], "base_path string, priority int, is_vault boolean")
    return maintain.seed_base_paths(*_catalog_args(spark, sf), overlay)


@query("default_categories", "cat", """
    SELECT DISTINCT mime_type, CASE split_part(mime_type, '/', 1) WHEN 'image' THEN 'image' WHEN 'video' THEN 'video'
        WHEN 'audio' THEN 'audio' END AS category
    FROM cat WHERE split_part(mime_type, '/', 1) <> 'application'""")
def default_categories(spark, sf):
    return category_source.default_categories(tables.catalog(spark, sf))


@query("seed_categories", "cat mc", "SELECT DISTINCT mime_type, category FROM cat JOIN mc USING (mime_type)")
def seed_categories(spark, sf):
    return category_source.seed_categories(tables.catalog(spark, sf), tables.categories(spark))


@query("redundant_plan", "files inv", """
    SELECT f.id, f.hash, f.mime_type, f.full_path,
           CASE WHEN i.full_path IS NULL THEN 'stale-row' ELSE 'would-remove' END AS action
    FROM files f LEFT JOIN inv i ON i.full_path = f.full_path AND i.is_regular WHERE disposition = 'redundant'""")
def redundant_plan(spark, sf):
    return actions.redundant_plan(*_catalog_args(spark, sf), tables.inventory(spark, sf), tables.mounted_bases(spark, sf))


@query("vault_purge_plan", "dupes inv", """
    SELECT hash, d.mime_type, other_full_path,
           CASE WHEN i.full_path IS NULL THEN 'missing' WHEN NOT is_regular THEN 'not-regular'
                WHEN NOT is_writable THEN 'no-permission' ELSE 'would-remove' END AS status
    FROM dupes d LEFT JOIN inv i ON i.full_path = other_full_path""")
def vault_purge_plan(spark, sf):
    return actions.vault_purge_plan(vault_dupes_short(spark, sf), tables.inventory(spark, sf), VAULT)


@query("drift_fix_plan", "drift inv", """
    SELECT vault_id AS id, vault_full_path AS full_path, target_last_modified, 'set-timestamp' AS action FROM drift
    WHERE vault_full_path IN (SELECT full_path FROM inv)
    UNION ALL
    SELECT vault_id, vault_full_path, target_last_modified, 'vault-file-missing' FROM drift
    WHERE vault_full_path NOT IN (SELECT full_path FROM inv)
    UNION ALL
    SELECT oldest_id, oldest_full_path, target_last_modified,
           CASE WHEN oldest_full_path IN (SELECT full_path FROM inv) THEN 'remove-file-and-row' ELSE 'remove-row' END
    FROM drift""")
def drift_fix_plan(spark, sf):
    drift, inv = timestamp_drift(spark, sf), tables.inventory(spark, sf)
    return actions.drift_fix_plan(drift, "inherit", inv).unionByName(
        actions.drift_fix_plan(drift, "remove-oldest", inv)
    )


@query("prune_plan", "best scope", "SELECT * FROM scope EXCEPT ALL SELECT * EXCLUDE group_size FROM best")
def prune_plan(spark, sf):
    return actions.prune_plan(manifest.select_scope(*_manifest_pair(spark, sf)))


@query("copy_plan", "best inv", """
    WITH planned AS (SELECT base_path || '/' || file_path AS source_path, '/dest/' || split_part(file_path, '/', -1) AS dest_path,
                            file_size, last_modified FROM best),
         there AS (SELECT '/dest/' || split_part(full_path, '/', -1) AS dest_path, file_size, last_modified FROM inv)
    SELECT source_path, p.dest_path,
           CASE WHEN t.dest_path IS NULL THEN 'to-copy' WHEN t.file_size <> p.file_size THEN 'size-mismatch'
                WHEN t.last_modified <> p.last_modified THEN 'timestamp-mismatch' ELSE 'verified' END AS status,
           count(*) OVER (PARTITION BY p.dest_path) > 1 AS collides
    FROM planned p LEFT JOIN there t USING (dest_path)""")
def copy_plan(spark, sf):
    inv = tables.inventory(spark, sf)
    there = inv.withColumn("full_path", F.concat(F.lit("/dest/"), paths.file_name("full_path")))
    return actions.copy_plan(manifest.select_scope(*_manifest_pair(spark, sf)), "/dest", there)


TS_PLAN_SQL = f"""
    SELECT f.*, CASE WHEN vault_full_path IN (SELECT full_path FROM inv) THEN 'update' ELSE 'skip' END AS action
    FROM ({FIXES_SQL}) f"""


@query("ts_fix_plan", "drift inv", TS_PLAN_SQL)
def ts_fix_plan(spark, sf):
    return actions.ts_fix_plan(ts_fix_parse(spark, sf), tables.inventory(spark, sf))


@query("ts_fix_counts", "drift inv", f"""
    SELECT count(*) FILTER (WHERE action = 'update') AS updated, count(*) FILTER (WHERE action = 'skip') AS skipped
    FROM ({TS_PLAN_SQL})""")
def ts_fix_counts(spark, sf):
    return actions.ts_fix_counts(ts_fix_plan(spark, sf))


# --- health checks -------------------------------------------------------

SHA1_SQL = "'[0-9a-f]{40}'"
EXPECTED_SQL = "rtrim(base_path, '/') || '/' || ltrim(file_path, '/')"
CHECK_SQL = {
    "base_or_file_path_slash_issues": (
        "SELECT id, base_path, file_path, full_path FROM faulty WHERE base_path LIKE '%/' OR file_path LIKE '/%'",
        "id",
    ),
    "missing_base_paths": (
        "SELECT DISTINCT base_path FROM faulty EXCEPT SELECT base_path FROM fbp",
        "base_path",
    ),
    "invalid_hash_format": (
        f"SELECT id, hash FROM faulty WHERE NOT regexp_full_match(hash, {SHA1_SQL})",
        "id",
    ),
    "negative_or_null_file_size": (
        "SELECT id, file_size FROM faulty WHERE file_size IS NULL OR file_size < 0",
        "id",
    ),
    "full_path_mismatch": (
        f"""SELECT id, base_path, file_path, full_path, {EXPECTED_SQL} AS expected_full_path
            FROM faulty WHERE full_path IS DISTINCT FROM {EXPECTED_SQL}""",
        "id",
    ),
    "duplicate_full_path": (
        "SELECT full_path, count(*) AS ct FROM faulty GROUP BY full_path HAVING count(*) > 1",
        "ct DESC, full_path",
    ),
    "vault_base_paths_without_files": (
        "SELECT base_path FROM fbp WHERE is_vault AND base_path NOT IN (SELECT base_path FROM faulty)",
        "base_path",
    ),
    "hashes_not_in_files_view": (
        "SELECT id, base_path, file_path, full_path FROM faulty WHERE base_path NOT IN (SELECT base_path FROM fbp)",
        "id",
    ),
}


def _register_check(name: str, rows: str, order: str) -> None:
    @query(name, "faulty fbp", f"SELECT '{name}' AS check_name, count(*) AS problem_count FROM ({rows})")
    def count(spark, sf):
        return quality.check(tables.faulty_catalog(spark, sf), tables.faulty_base_paths(spark), name)

    @query(f"samples_{name}", "faulty fbp", f"SELECT * FROM ({rows}) ORDER BY {order} LIMIT 50")
    def sample(spark, sf):
        return quality.samples(tables.faulty_catalog(spark, sf), tables.faulty_base_paths(spark), name)


for _name, (_rows, _order) in CHECK_SQL.items():
    _register_check(_name, _rows, _order)


@query("health_checks", "faulty fbp", " UNION ALL ".join(
    f"SELECT '{n}' AS check_name, count(*) AS problem_count FROM ({rows})" for n, (rows, _) in CHECK_SQL.items()
) + " UNION ALL SELECT 'duplicate_base_path_priority', 0")
def health_checks(spark, sf):
    return quality.run_checks(tables.faulty_catalog(spark, sf), tables.faulty_base_paths(spark))


@query("duplicate_base_path_priority", "cat bp", f"""
    SELECT 'duplicate_base_path_priority' AS check_name, count(*) AS problem_count
    FROM (SELECT priority FROM ({SEEDED_SQL}) GROUP BY priority HAVING count(*) > 1)""")
def duplicate_base_path_priority(spark, sf):
    return quality.check(tables.catalog(spark, sf), seed_base_paths(spark, sf), "duplicate_base_path_priority")


@query("duplicate_priority_paths", "cat bp", f"""
    SELECT priority, base_path FROM ({SEEDED_SQL})
    QUALIFY count(*) OVER (PARTITION BY priority) > 1""")
def duplicate_priority_paths(spark, sf):
    return quality.duplicate_priority_paths(seed_base_paths(spark, sf))


@query("id_high_water", "cat", """
    SELECT 'id_high_water' AS check_name, max(id) AS max_id, CAST(1000001 AS BIGINT) AS next_id,
           CASE WHEN 1000001 <= max(id) THEN 1::BIGINT ELSE 0::BIGINT END AS problem_count FROM cat""")
def id_high_water(spark, sf):
    """A catalog stored with a next id that its rows have passed."""
    out = scratch_path(spark, "ids")
    load.store_next_id(spark, out, 1000001)
    return quality.id_high_water(tables.catalog(spark, sf), load.stored_next_id(spark, out))


@query("manifest_validate_files", "lines", """
    WITH numbered AS (
        SELECT source, row_number() OVER (PARTITION BY source ORDER BY line_no) AS line_no, string_split(value, chr(9)) AS p
        FROM lines)
    SELECT source, line_no, 'column_count' AS error, CAST(len(p) AS VARCHAR) AS found FROM numbered WHERE len(p) <> 6
    UNION ALL
    SELECT source, line_no, 'invalid_hash', p[1] FROM numbered
    WHERE len(p) = 6 AND NOT regexp_full_match(p[1], '[0-9a-fA-F]{40}')
    UNION ALL
    SELECT source, line_no, 'invalid_size', p[3] FROM numbered
    WHERE len(p) = 6 AND NOT regexp_full_match(p[3], '[+-]?[0-9]+')""")
def manifest_validate_files(spark, sf):
    return quality.validate_lines(_in_files(spark, tables.manifest_text(spark, sf)))


@query("manifest_validate", "lines", """
    SELECT source, line_no, 'column_count' AS error, CAST(len(p) AS VARCHAR) AS found
    FROM (SELECT *, string_split(value, chr(9)) AS p FROM lines) WHERE len(p) <> 6
    UNION ALL
    SELECT source, line_no, 'invalid_hash', p[1] FROM (SELECT *, string_split(value, chr(9)) AS p FROM lines)
    WHERE len(p) = 6 AND NOT regexp_full_match(p[1], '[0-9a-fA-F]{40}')
    UNION ALL
    SELECT source, line_no, 'invalid_size', p[3] FROM (SELECT *, string_split(value, chr(9)) AS p FROM lines)
    WHERE len(p) = 6 AND NOT regexp_full_match(p[3], '[+-]?[0-9]+')""")
def manifest_validate(spark, sf):
    return quality.validate_lines(tables.manifest_text(spark, sf))
