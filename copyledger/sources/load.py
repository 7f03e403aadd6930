"""Loading manifest files into the catalog."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from copyledger.functions import paths as path_fn
from copyledger.operators.keyed import dense_number
from copyledger.schema import CATALOG_COLUMNS, CATALOG_SCHEMA, FIRST_ID, MANIFEST_COLUMNS, as_catalog
from copyledger.sources.manifest_io import read_records
from copyledger.session import existing_paths, literal_table, scratch_path


class LoadResult(NamedTuple):
    """``next_id`` is the first id a later load may use, to be stored with the
    catalog (:func:`store_next_id`) and handed to that load as ``start``."""

    catalog: DataFrame
    status: DataFrame
    next_id: int


def assign_ids(df: DataFrame, start: int = FIRST_ID) -> DataFrame:
    """Dense ids from ``start`` in sha1(full_path) order: even, repeatable and
    without a global sort."""
    digest = df.withColumn("_digest", F.sha1(F.col("full_path").cast("binary")))
    numbered = dense_number(digest, F.substring("_digest", 1, 4), ["_digest", "full_path"], "id", start)
    return numbered.drop("_digest")


def next_id(catalog: DataFrame) -> int:
    """First id a load may use: above every id in use."""
    return catalog.agg(F.coalesce(F.max("id") + 1, F.lit(FIRST_ID)).alias("n")).first()["n"]


def _marks(path: str) -> str:
    return f"{path.rstrip('/')}.next_id"


def store_next_id(spark: SparkSession, path: str, value: int) -> None:
    """Record beside the catalog at ``path`` that ids below ``value`` are given
    out. Marks are only added, so an id stays taken after its row is deleted."""
    mark = spark.range(value, value + 1, 1, 1).select(F.col("id").alias("next_id"))
    mark.write.mode("append").parquet(_marks(path))


def stored_next_id(spark: SparkSession, path: str) -> int:
    """First free id of the catalog at ``path``; the first id where none is recorded."""
    marks = _marks(path)
    if not existing_paths(spark, [marks]):
        return FIRST_ID
    return spark.read.schema("next_id bigint").parquet(marks).agg(F.max("next_id")).first()[0] or FIRST_ID


def csv_fields(line: Column) -> Column:
    """Fields of a tab-delimited CSV line; null when a quote is left open.

    A quote opens or closes quoting anywhere in a field, and a doubled quote
    inside quotes stands for one. An unquoted empty field is null, a quoted
    one is ''. Lines without quotes, nearly all, are simply split.
    """
    quoted = F.regexp_extract_all(
        F.concat(line, F.lit("\t")), F.lit(r'((?:[^\t"]|"(?:[^"]|"")*+")*+)\t'), F.lit(1)
    )

    def unquote(field: Column) -> Column:
        inner = F.regexp_replace(field, r'"((?:[^"]|"")*+)"', "$1")
        return F.when(field != "", F.replace(inner, F.lit('""'), F.lit('"')))

    quotes = F.length(line) - F.length(F.replace(line, F.lit('"'), F.lit("")))
    plain = F.transform(F.split(line, "\t", -1), lambda f: F.when(f != "", f))
    return F.when(quotes == 0, plain).when(quotes % 2 == 0, F.transform(quoted, unquote))


def _placed(rows: DataFrame, uris: Sequence[str]) -> DataFrame:
    """``rows`` with ``_file``: the position of the argument that names their file
    (``_source``) or the closest folder above it. Only names as deep as some
    argument are looked up."""
    by_depth: dict[int, list[tuple[str, int]]] = {}
    for i, uri in enumerate(uris):
        name = uri.rstrip("/")
        by_depth.setdefault(name.count("/"), []).append((name, i))
    found = []
    for depth in sorted(by_depth, reverse=True):
        # One row per argument.
        named = literal_table(rows.sparkSession, by_depth[depth], ["_name", f"_at_{depth}"])
        above = rows.withColumn("_name", F.substring_index("_source", "/", depth + 1))
        rows = above.join(F.broadcast(named), "_name", "left").drop("_name")
        found.append(f"_at_{depth}")
    nowhere = F.raise_error(F.concat(F.col("_source"), F.lit(" lies below none of the arguments"))).cast("int")
    return rows.withColumn("_file", F.coalesce(*found, nowhere)).drop("_source", *found)


def _read_files(spark: SparkSession, uris: Sequence[str], paths: Sequence[str], multiline: bool) -> DataFrame:
    """Rows of all files with ``_file``, their position in ``paths``, and
    ``_broken``. Quoted fields follow CSV rules with a tab delimiter."""
    if multiline:
        # Blank lines are no records, broken ones have no value.
        records = read_records(spark, list(paths)).where(F.coalesce("value", F.lit("broken")) != "")
    else:
        records = spark.read.text(list(paths)).select(F.col("_metadata.file_path").alias("source"), "value")
    source = F.regexp_replace("source", r"\Afile:/+", "/").alias("_source")
    return typed_rows(_placed(records.select(source, "value"), uris))


def typed_rows(lines: DataFrame) -> DataFrame:
    """Manifest rows of ``lines`` (value and others) with their types, and
    ``_broken`` for those that no load accepts."""
    other = [c for c in lines.columns if c != "value"]
    raw = lines.select(*other, csv_fields(F.col("value")).alias("_f"))
    text = {c: F.get("_f", F.lit(i)) for i, c in enumerate(MANIFEST_COLUMNS)}
    return _typed(raw, text, F.size("_f") != len(MANIFEST_COLUMNS), other)


def _typed(raw: DataFrame, text: dict[str, Column], broken: Column, other: list[str]) -> DataFrame:
    types = {f.name: f.dataType.simpleString() for f in CATALOG_SCHEMA}
    typed = {c: text[c].try_cast(types[c]) for c in MANIFEST_COLUMNS}
    broken = broken | (F.length(text["hash"]) > 40)
    for c in MANIFEST_COLUMNS:
        broken = broken | typed[c].isNull()
    return raw.select(
        *other, *[v.alias(c) for c, v in typed.items()], F.coalesce(broken, F.lit(True)).alias("_broken")
    )


def load_catalog(
    spark: SparkSession,
    paths: Sequence[str],
    existing: DataFrame | None = None,
    start: int | None = None,
    multiline: bool = False,
    taken: Callable[[DataFrame], DataFrame] | None = None,
) -> LoadResult:
    """Append manifest files to ``existing`` and report a status per file.

    Absent files are skipped. The first file with a malformed row, an empty
    field or a full path that is already taken fails as a whole and ends the
    load; files before it stay loaded, later ones are not reached. Ids begin at
    ``start``, the stored next id; without it, above the ids ``existing`` holds.

    Rows are parsed once and kept, typed, in the shared folder; later steps read
    the columns they need from there. ``taken`` may stand for ``existing``: it gets
    the arriving paths (``full_path``) and returns the distinct ones in use, and the
    result then holds the loaded rows alone. With ``multiline`` a quoted field may hold
    line breaks and blank lines are skipped; files are still read in splits.
    """
    uris = existing_paths(spark, paths)
    present = list(uris)
    absent = [p for p in paths if p not in uris]
    status_schema = "position int, path string"
    listed = spark.createDataFrame(list(enumerate(present)), status_schema)
    skipped = spark.createDataFrame([(None, p) for p in absent], status_schema)
    first_id = start if start is not None else (FIRST_ID if existing is None else next_id(existing))
    if not present:
        empty = spark.createDataFrame([], CATALOG_SCHEMA)
        status = skipped.select("path", F.lit("skipped").alias("status"), F.lit(0).cast("bigint").alias("row_count"))
        return LoadResult(existing if existing is not None else empty, status, first_id)

    parsed = scratch_path(spark, "parsed")
    read = _read_files(spark, list(uris.values()), present, multiline)
    read.write.parquet(parsed)
    rows = spark.read.schema(read.schema).parquet(parsed)
    per_path = (
        rows.withColumn("full_path", path_fn.full_path("base_path", "file_path"))
        .groupBy("full_path", "_file")
        .agg(F.count(F.lit(1)).alias("_n"), F.max("_broken").alias("_broken"))
    )
    earliest = F.min("_file").over(W.partitionBy("full_path"))
    clash = (F.col("_n") > 1) | (F.col("_file") > F.col("_earliest"))
    if existing is not None or taken is not None:
        arriving = rows.select(path_fn.full_path("base_path", "file_path").alias("full_path"))
        # A small load is broadcast to the catalog instead of shuffling it.
        used = [] if existing is None else [existing.select("full_path").join(arriving, "full_path", "left_semi")]
        used += [] if taken is None else [taken(arriving)]
        in_use = used[0] if len(used) == 1 else used[0].unionByName(used[1]).distinct()
        in_use = in_use.withColumn("_taken", F.lit(True))
        per_path = per_path.join(in_use, "full_path", "left")
        clash = clash | F.coalesce(F.col("_taken"), F.lit(False))
    verdicts = (
        per_path.withColumn("_earliest", earliest)
        .groupBy("_file")
        .agg(F.sum("_n").alias("row_count"), F.max(F.col("_broken") | clash).alias("_fails"))
    )
    # One row per input file; read once, so the load and its report agree.
    outcome = {r["_file"]: r for r in verdicts.collect()}
    stop = min((i for i, r in outcome.items() if r["_fails"]), default=len(present))

    state = (
        F.when(F.col("position") < stop, "loaded").when(F.col("position") == stop, "failed").otherwise("not reached")
    )
    counts = spark.createDataFrame(
        [(i, r["row_count"]) for i, r in outcome.items()], "position int, row_count bigint"
    )
    status = (
        listed.join(counts, "position", "left")
        .select("path", state.alias("status"), F.coalesce("row_count", F.lit(0)).alias("row_count"))
        .unionByName(
            skipped.select("path", F.lit("skipped").alias("status"), F.lit(0).cast("bigint").alias("row_count"))
        )
    )
    accepted = rows.where(F.col("_file") < stop).select(*MANIFEST_COLUMNS)
    derived = as_catalog(accepted.withColumn("id", F.lit(None).cast("bigint"))).drop("id")
    loaded = assign_ids(derived, first_id).select(*CATALOG_COLUMNS)
    merged = loaded if existing is None else existing.select(*CATALOG_COLUMNS).unionByName(loaded)
    taken_ids = sum(r["row_count"] for i, r in outcome.items() if i < stop)
    return LoadResult(merged, status, first_id + taken_ids)


def reset_catalog(spark: SparkSession, path: str | None = None) -> DataFrame:
    """An empty catalog, also stored at ``path``; ids restart at the first id."""
    empty = spark.createDataFrame([], CATALOG_SCHEMA)
    if path is not None:
        empty.write.mode("overwrite").parquet(path)
        first = spark.range(FIRST_ID, FIRST_ID + 1, 1, 1).select(F.col("id").alias("next_id"))
        first.write.mode("overwrite").parquet(_marks(path))
    return empty
