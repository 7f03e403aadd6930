"""Reading and writing tab-separated manifests and instruction files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from copyledger.operators.keyed import join_on_groups
from copyledger.schema import MANIFEST_COLUMNS

# A quoted record of more characters is malformed: its quote was never meant to open.
RECORD_CHARS = 16 * 1024 * 1024


def read_lines(spark: SparkSession, paths: str | Sequence[str], line_sep: str | None = None) -> DataFrame:
    """Text lines with their file (``source``) and 1-based ``line_no``.

    Lines end at LF, CR LF or CR unless ``line_sep`` names the only terminator.
    Files are read in splits. A row's position inside its split plus the line
    counts of the file's earlier splits gives the line number, so no file has
    to be read by a single task.
    """
    raw = spark.read.text(paths, lineSep=line_sep).select(
        F.col("_metadata.file_path").alias("source"),
        F.col("_metadata.file_block_start").alias("_split"),
        F.monotonically_increasing_id().alias("_pos"),
        "value",
    )
    earlier = W.partitionBy("source").orderBy("_split").rowsBetween(W.unboundedPreceding, -1)
    splits = (
        raw.groupBy("source", "_split")
        .agg(F.min("_pos").alias("_first"), F.count(F.lit(1)).alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    )
    return raw.join(splits, ["source", "_split"]).select(
        "source", (F.col("_pos") - F.col("_first") + F.col("_before") + 1).alias("line_no"), "value"
    )


def read_records(spark: SparkSession, paths: str | Sequence[str], max_chars: int = RECORD_CHARS) -> DataFrame:
    """Records (``source``, ``value``) of files whose quoted fields may hold line breaks.

    A record ends at the first line end behind an even number of quotes. Files are
    read in splits: the quotes of the earlier splits of a file tell whether a split
    begins inside quotes. Splits without an odd line that begin outside are passed
    on as they are; in the others lines are put in order, and only the lines of
    broken records meet again. Records left open at the end of a file or of over
    ``max_chars`` characters have a null value and are never gathered.
    Line ends inside quotes stay as written.
    """
    text = spark.read.text(paths, lineSep="\n")
    raw = text.select(
        F.col("_metadata.file_path").alias("source"),
        F.col("_metadata.file_block_start").alias("_split"),
        F.monotonically_increasing_id().alias("_pos"),
        "value",
        (F.regexp_count("value", F.lit('"')) % 2).alias("_odd"),
    )
    earlier = W.partitionBy("source").orderBy("_split").rowsBetween(W.unboundedPreceding, -1)
    turn = F.when(F.col("_odd") == 1, F.col("_pos"))
    splits = (
        raw.groupBy("source", "_split")
        .agg(F.sum("_odd").alias("_odds"), F.max(turn).alias("_turn"))
        .withColumn("_before", F.coalesce(F.sum("_odds").over(earlier), F.lit(0)))
        .withColumn("_from_split", F.last(F.when(F.col("_odds") > 0, F.col("_split")), True).over(earlier))
        .withColumn("_from_pos", F.last("_turn", True).over(earlier))
        .drop("_turn")
    )
    placed = raw.join(splits, ["source", "_split"])
    quiet = (F.col("_before") % 2 == 0) & (F.col("_odds") == 0)
    # A split, not a file, is what one group of this window holds.
    above = W.partitionBy("source", "_split").orderBy("_pos").rowsBetween(W.unboundedPreceding, -1)
    lines = (
        placed.where(~quiet)
        .withColumn("_inside", (F.col("_before") + F.coalesce(F.sum("_odd").over(above), F.lit(0))) % 2 == 1)
        .withColumn("_own", F.last(turn, True).over(above))
    )
    here = ~F.col("_inside") | F.col("_own").isNotNull()
    opened = {
        "_at_split": F.when(here, F.col("_split")).otherwise(F.col("_from_split")),
        "_at_pos": F.when(~F.col("_inside"), F.col("_pos")).otherwise(F.coalesce("_own", "_from_pos")),
    }
    parts = lines.where("_inside or _odd = 1").withColumns(opened)
    keys = ["source", *opened]
    sizes = parts.groupBy(*keys).agg((F.sum(F.length("value")) + F.count(F.lit(1))).alias("_n"), F.sum("_odd").alias("_quotes"))
    whole = (F.col("_n") <= max_chars) & (F.col("_quotes") == 2)
    ordered = F.sort_array(F.collect_list(F.struct("_split", "_pos", "value")))
    joined = (
        join_on_groups(parts, sizes.where(whole).select(*keys), keys)
        .groupBy(*keys)
        .agg(F.array_join(ordered["value"], "\n").alias("value"))
    )
    records = (
        placed.where(quiet)
        .select("source", "value")
        .unionByName(lines.where("not _inside and _odd = 0").select("source", "value"))
        .unionByName(joined.select("source", "value"))
        .unionByName(sizes.where(~whole).select("source", F.lit(None).cast("string").alias("value")))
    )
    return records.withColumn("value", F.regexp_replace("value", r"\r\z", ""))


def _fields(parts: Column) -> list[Column]:
    return [F.get(parts, F.lit(i)).alias(name) for i, name in enumerate(MANIFEST_COLUMNS)]


def parse_strict(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, bad): trailing empty fields count, good lines have exactly six.

    Good rows keep all six fields as text; bad rows keep the line.
    """
    parts = F.split("value", "\t", -1)
    other = [c for c in lines.columns if c != "value"]
    good = lines.where(F.size(parts) == 6).select(*other, *_fields(parts))
    bad = lines.where(F.size(parts) != 6)
    return good, bad


def parse_failfast(lines: DataFrame) -> DataFrame:
    """Typed rows; trailing empty fields are dropped before counting and the
    first malformed line or size aborts the query."""
    parts = F.split(F.rtrim("value", F.lit("\t")), "\t", -1)
    size = F.get(parts, F.lit(2))
    well_formed = (F.size(parts) == 6) & size.rlike(r"\A[+-]?[0-9]+\z") & size.try_cast("bigint").isNotNull()
    checked = lines.where(
        F.when(well_formed, F.lit(True)).otherwise(
            F.raise_error(F.concat(F.lit("invalid manifest line: "), F.col("value"))).cast("boolean")
        )
    )
    other = [c for c in lines.columns if c != "value"]
    return checked.select(*other, *_fields(parts)).withColumn("file_size", F.col("file_size").try_cast("bigint"))


def read_manifest(spark: SparkSession, paths: str | Sequence[str], mode: str = "failfast"):
    """``failfast`` gives typed rows, ``strict`` the pair (good, bad)."""
    lines = spark.read.text(paths).select(F.col("_metadata.file_path").alias("source"), "value")
    return parse_strict(lines) if mode == "strict" else parse_failfast(lines)


def manifest_lines(df: DataFrame) -> DataFrame:
    """One unquoted tab-joined line per row."""
    fields = [F.col(c).cast("string") for c in MANIFEST_COLUMNS]
    if dict(df.dtypes)["last_modified"] != "string":
        fields[1] = F.translate(F.substring(fields[1], 1, 19), " ", "T")
    return df.select(F.concat_ws("\t", *[F.coalesce(f, F.lit("")) for f in fields]).alias("value"))


def write_manifest(df: DataFrame, path: str) -> None:
    manifest_lines(df).write.text(path)


def write_split(split: DataFrame, path: str, prefix: str) -> None:
    """One folder per split key, named ``manifest=<prefix>_<key>.meta``."""
    name = F.concat(F.lit(f"{prefix}_"), F.col("split_key"), F.lit(".meta"))
    lines = split.select(
        F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in MANIFEST_COLUMNS]).alias("value"),
        name.alias("manifest"),
    )
    lines.hint("rebalance", "manifest").write.partitionBy("manifest").text(path)


def to_tsv(df: DataFrame, path: str, columns: Sequence[str] | None = None) -> None:
    """Header-less tab-separated result. Values are written unquoted."""
    chosen = df.select(*columns) if columns else df
    chosen.write.csv(path, sep="\t", quote="", escape="", emptyValue="", nullValue="")


# --- instruction files ---------------------------------------------------


def parse_id_list(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ids, bad counts per source) of lines (``source``, ``line_no``, ``value``).

    The first column counts, without blanks and carriage returns. A
    non-numeric first line of a file is its header and is not counted as bad.
    """
    field = F.translate(F.substring_index("value", "\t", 1), "\r", "")
    cleaned = lines.withColumn("_id", F.trim(field, F.lit(" \t")))
    numeric = F.col("_id").rlike(r"\A[0-9]+\z")
    ids = cleaned.where(numeric).select("source", F.col("_id").try_cast("bigint").alias("id"))
    bad = cleaned.groupBy("source").agg(F.count_if(~numeric & (F.col("line_no") > 1)).alias("bad_rows"))
    return ids, bad


def read_id_list(spark: SparkSession, paths: str | Sequence[str]) -> tuple[DataFrame, DataFrame]:
    return parse_id_list(read_lines(spark, paths, "\n"))


def parse_ts_fixes(lines: DataFrame) -> DataFrame:
    """Timestamp instructions (line_no, vault_id, primary_last_modified,
    vault_full_path). Blank, header and non-numeric lines are skipped."""
    parts = F.split(F.translate("value", "\r", ""), "\t", -1)
    field = [F.trim(F.coalesce(F.get(parts, F.lit(i)), F.lit("")), F.lit(" \t")) for i in range(3)]
    return lines.where(field[0].rlike(r"\A[0-9]+\z")).select(
        "line_no",
        field[0].try_cast("bigint").alias("vault_id"),
        field[1].try_cast("timestamp_ntz").alias("primary_last_modified"),
        field[2].alias("vault_full_path"),
    )


def read_ts_fixes(spark: SparkSession, path: str) -> DataFrame:
    return parse_ts_fixes(read_lines(spark, path, "\n"))
