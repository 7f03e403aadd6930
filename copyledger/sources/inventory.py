"""Content inventory: hashing file bodies, and reconciling a catalog with it."""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple
from urllib.parse import quote

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from copyledger.functions import ColumnLike, as_col, mime, paths, times
from copyledger.operators.manifest import require_bases
from copyledger.session import scratch_path

# Bytes read at a time when a file is hashed.
CHUNK = 8 * 1024 * 1024


def inventory(
    content: DataFrame,
    base: ColumnLike,
    path: ColumnLike,
    body: ColumnLike,
    mtime: ColumnLike,
    mime_type: ColumnLike | None = None,
    include: Iterable[str] = (),
) -> DataFrame:
    """Manifest rows of a content table. The major-type filter sits below the
    hash, so excluded bodies are never hashed. One scan, no shuffle."""
    kind = mime.mime_clean(mime_type) if mime_type is not None else mime.mime_from_name(path)
    include = list(include)
    rows = content.where(mime.major_type(kind).isin(include)) if include else content
    data = as_col(body)
    return rows.select(
        F.sha1(data.cast("binary")).alias("hash"),
        times.whole_seconds(mtime).alias("last_modified"),
        F.octet_length(data).cast("bigint").alias("file_size"),
        kind.alias("mime_type"),
        as_col(base).alias("base_path"),
        as_col(path).alias("file_path"),
    )


def _glob_for(include: list[str]) -> str | None:
    """File-name pattern of the extensions the wanted majors can have, any
    case; None when files with unknown extensions are wanted too."""
    if not include or mime.DEFAULT_MIME.split("/")[0] in include:
        return None
    wanted = [e for e, m in mime.EXTENSION_MIME.items() if m.split("/")[0] in include]
    any_case = ["".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in e) for e in wanted]
    return "*.{" + ",".join(any_case) + "}" if any_case else None


def _list_folders(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Entries of each folder: subfolders and regular files, links not followed.
    A folder that cannot be opened fails the listing, as its files would seem
    deleted; an entry that vanished meanwhile is left out."""
    for batch in batches:
        for folder in batch["folder"]:
            rows = []
            with os.scandir(folder) as entries:
                for e in entries:
                    try:
                        is_dir = e.is_dir(follow_symlinks=False)
                        if is_dir or e.is_file(follow_symlinks=False):
                            info = e.stat(follow_symlinks=False)
                            rows.append((e.path, is_dir, info.st_size, info.st_mtime_ns // 10**9))
                    except FileNotFoundError:
                        continue
                    if len(rows) >= 10_000:
                        yield pd.DataFrame(rows, columns=["path", "is_dir", "length", "mtime"])
                        rows = []
            yield pd.DataFrame(rows, columns=["path", "is_dir", "length", "mtime"])


class Scan(NamedTuple):
    """What a scan found. ``marks`` says for each scanned base path how many files
    were seen and how many of them could not be read; those are in ``errors``."""

    rows: DataFrame
    errors: DataFrame
    marks: DataFrame


def _digest(opened: Callable) -> tuple[str | None, str | None]:
    """SHA-1 of a file, read a chunk at a time, or the error that prevented it."""
    digest = hashlib.sha1()
    try:
        with opened() as f:
            while chunk := f.read(CHUNK):
                digest.update(chunk)
    except OSError as e:
        return None, f"{type(e).__name__}: {e.strerror or e}"
    return digest.hexdigest(), None


def _hash_files(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        found = [_digest(lambda: open(path, "rb")) for path in batch["path"]]
        yield batch.assign(hash=[h for h, _ in found], error=[e for _, e in found])


def _store(location: str) -> tuple[fs.FileSystem, str]:
    """File system of a store location, written as it is or with options after a
    question mark, and the path in it."""
    return fs.FileSystem.from_uri(quote(re.sub(r"\As3[an]:", "s3:", location), safe="/:@?&=,"))


def _list_prefixes(location: str):
    """As :func:`_list_folders`, of a store. Only a local one has links to pass over."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, _ = _store(location)
        links = os.path.islink if isinstance(store, fs.LocalFileSystem) else lambda path: False
        for batch in batches:
            for folder in batch["folder"]:
                found = store.get_file_info(fs.FileSelector(folder))
                rows = [
                    (i.path, i.type == fs.FileType.Directory, i.size or 0, (i.mtime_ns or 0) // 10**9)
                    for i in found
                    if i.type in (fs.FileType.Directory, fs.FileType.File) and not links(i.path)
                ]
                for start in range(0, len(rows), 10_000):
                    yield pd.DataFrame(rows[start : start + 10_000], columns=["path", "is_dir", "length", "mtime"])

    return run


def _hash_objects(location: str):
    """As :func:`_hash_files`, of a store."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, _ = _store(location)
        for batch in batches:
            found = [_digest(lambda: store.open_input_stream(path)) for path in batch["path"]]
            yield batch.assign(hash=[h for h, _ in found], error=[e for _, e in found])

    return run


def _tasks(spark: SparkSession, wanted: int) -> int:
    return max(wanted, spark.sparkContext.defaultParallelism)


def walk(spark: SparkSession, root: str, lister: Callable = _list_folders) -> DataFrame:
    """Every regular file below ``root``: path, length, mtime (epoch seconds).

    ``root`` lies on a mount that all executors share. Folders are listed one
    level at a time on the executors, and each level is written to the shared
    folder, so a lost executor repeats only its own listing. Spark's file
    sources are not used because they leave out empty files and dotfiles.
    """
    out = scratch_path(spark, "walk")
    folders, n, depth = spark.createDataFrame([(root,)], "folder string"), 1, 0
    while n:
        listed = folders.repartition(_tasks(spark, n // 1000), "folder").mapInPandas(
            lister, "path string, is_dir boolean, length bigint, mtime bigint"
        )
        listed.write.parquet(f"{out}/level={depth}")
        folders = spark.read.parquet(f"{out}/level={depth}").where("is_dir").select(F.col("path").alias("folder"))
        n, depth = folders.count(), depth + 1
    return spark.read.parquet(out).where("NOT is_dir").select("path", "length", "mtime")


def _hashed(spark: SparkSession, root: str, include: list[str]) -> DataFrame:
    """Manifest rows of the files below ``root``, with ``error`` where one could not be
    read. A root with a scheme is a store, reached through its own client."""
    in_store = "://" in root
    lister, hasher = (_list_prefixes(root), _hash_objects(root)) if in_store else (_list_folders, _hash_files)
    top = _store(root)[1].rstrip("/") if in_store else root
    files = walk(spark, top, lister).withColumn(
        "relative", F.ltrim(F.substring("path", len(top) + 1, 2**31 - 1), F.lit("/"))
    )
    kind = mime.mime_from_name("relative")
    if include:
        files = files.where(mime.major_type(kind).isin(include))
    load = files.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("b")).first()
    tasks = _tasks(spark, max(load["n"] // 20_000, load["b"] // (8 * 1024**3)))
    hashed = files.repartition(tasks, "path").mapInPandas(
        hasher, "path string, length bigint, mtime bigint, relative string, hash string, error string"
    )
    return hashed.select(
        "hash",
        F.timestamp_seconds("mtime").cast("timestamp_ntz").alias("last_modified"),
        F.col("length").alias("file_size"),
        kind.alias("mime_type"),
        F.lit(re.sub(r"\Afile:/+", "/", root)).alias("base_path"),
        F.col("relative").alias("file_path"),
        "error",
    )


def scan(spark: SparkSession, root: str, include: Iterable[str] = ()) -> Scan:
    """Scan every file below ``root``, on a shared mount or in a store (a location with
    a scheme, as ``s3://bucket/prefix``), once, into the shared folder.

    As :func:`scan_files`, and with the files that could not be read as ``errors``
    (base_path, file_path, error). A file that vanished before it was read is
    neither. Hand ``marks`` to whatever concludes from a file's absence: a scan
    with unreadable files is refused there.
    """
    root = root.rstrip("/") or "/"
    out, seen = scratch_path(spark, "scan"), Observation()
    gone = F.startswith(F.coalesce("error", F.lit("")), F.lit("FileNotFoundError"))
    found = _hashed(spark, root, list(include)).where(~gone)
    found.observe(
        seen, F.count(F.lit(1)).alias("files"), F.count_if(F.col("error").isNotNull()).alias("unreadable")
    ).write.parquet(out)
    stored = spark.read.schema(found.schema).parquet(out)
    marks = [(re.sub(r"\Afile:/+", "/", root), seen.get["files"], seen.get["unreadable"])]
    return Scan(
        stored.where("error IS NULL").drop("error"),
        stored.where("error IS NOT NULL").select("base_path", "file_path", "error"),
        spark.createDataFrame(marks, "base_path string, files bigint, unreadable bigint"),
    )


def scan_files(
    spark: SparkSession, root: str, include: Iterable[str] = (), keep_unreadable: bool = False
) -> DataFrame:
    """Manifest rows of every file below ``root`` on a shared mount.

    MIME types come from file names, and only wanted files are opened. Times
    are in the session time zone, to the second. Hashing is spread by files and
    bytes; a file is read in chunks by one task, whatever its size. Files that
    cannot be read are left out, or with ``keep_unreadable`` are rows without a
    hash, so that they count as present; :func:`scan` reports them. A root or
    folder that cannot be opened is an error.
    """
    found = _hashed(spark, root.rstrip("/") or "/", list(include)).drop("error")
    return found if keep_unreadable else found.where("hash IS NOT NULL")


def scan_store(spark: SparkSession, root: str, include: Iterable[str] = ()) -> DataFrame:
    """Manifest rows of the objects below a store location that Arrow has a client
    for (S3, GCS, Azure, HDFS, file), as :func:`scan_files` gives them for a mount.

    Prefixes are listed level by level on the executors; a prefix's own names are
    held by one task. Objects are read as streams, a chunk at a time, whatever their
    size; empty ones and names with a dot or underscore first are included.
    """
    return scan_files(spark, root if "://" in root else f"file://{root}", include)


def scan_binary(spark: SparkSession, root: str, include: Iterable[str] = ()) -> DataFrame:
    """Manifest rows of the objects below a location that only Spark reaches, hashed
    in the JVM.

    The file source leaves out empty objects and names that start with a dot or
    underscore, and an object must fit in 2 GB; elsewhere use :func:`scan_store`.
    """
    include = list(include)
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    glob = _glob_for(include)
    found = (reader.option("pathGlobFilter", glob) if glob else reader).load(root)
    base = F.lit(re.sub(r"\Afile:/+", "/", root).rstrip("/"))
    local = F.regexp_replace("path", r"\Afile:/+", "/")
    return inventory(
        found,
        base=base,
        path=F.substr(local, F.length(base) + 2),
        body="content",
        mtime=F.col("modificationTime").cast("timestamp_ntz"),
        include=include,
    )


def missing_rows(catalog: DataFrame, inventory_now: DataFrame, live_bases: DataFrame) -> DataFrame:
    """Catalog rows whose path is gone. All base paths must be live first, so
    that an unmounted disk is not taken for a deletion, and wholly readable where
    ``live_bases`` are the marks of a :func:`scan`."""
    require_bases(catalog, live_bases)
    present = inventory_now.select("full_path")
    return catalog.join(present, "full_path", "left_anti").select("id", "base_path", "full_path")


def write_missing(missing: DataFrame, path: str) -> None:
    """One folder per base path, labelled by its last segment plus a digest so
    that equal last segments do not mix; id and path, tab-separated."""
    label: Column = F.concat_ws("_", paths.base_segment("base_path"), F.substring(F.sha1("base_path"), 1, 8))
    lines = missing.select(F.concat_ws("\t", F.col("id").cast("string"), "full_path"), label.alias("missing_rows"))
    lines.hint("rebalance", "missing_rows").write.partitionBy("missing_rows").text(path)
