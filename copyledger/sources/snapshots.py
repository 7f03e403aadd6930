"""A stored catalog that is changed one base path at a time.

Rows lie in folders that are never written again, one per base path and change. A
snapshot lists the folders that make up the catalog; it is a small file that appears
under its number at once, so readers see a change wholly or not at all. Folders of
base paths that a change does not touch are listed again, not rewritten.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterable, Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from copyledger.operators import maintain
from copyledger.schema import CATALOG_COLUMNS, CATALOG_SCHEMA
from copyledger.session import ensure_checkpoint_dir
from copyledger.sources import load, path_filter

# Filters that a snapshot lists before they are made anew as one.
MAX_FILTERS = 32


class Snapshot(NamedTuple):
    """``folders`` of every base path, relative to the catalog's own folder, and the
    ``filters`` that together cover all their paths: folder and number of blocks."""

    number: int
    next_id: int
    folders: dict[str, list[str]]
    filters: list[list] | None = None


class SnapshotConflict(RuntimeError):
    """Another writer has stored the next snapshot first; nothing was changed."""


def _label(base_path: str) -> str:
    return hashlib.sha1(base_path.encode("utf-8", "surrogatepass")).hexdigest()


class StoredCatalog:
    """The catalog at ``path``; changes return the snapshot they made.

    A change reads and writes only base paths that hold a matching row. Base paths
    are one row per scanned root, and the driver holds one entry for each. Of two
    changes made from one snapshot the second fails with :class:`SnapshotConflict`
    (where the file system renames without overwriting, as HDFS does). Earlier
    snapshots stay readable until their folders are removed.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        home = self._path(self.path)
        self._fs = home.getFileSystem(spark._jsc.hadoopConfiguration())
        self._context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(
            self._fs.makeQualified(home).toUri(), spark._jsc.hadoopConfiguration()
        )

    # --- snapshots ---------------------------------------------------------

    def numbers(self) -> list[int]:
        folder = self._path(f"{self.path}/snapshots")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("_"))

    def snapshot(self, number: int | None = None) -> Snapshot:
        """The numbered snapshot, by default the latest one."""
        stored = self.numbers()
        if not stored:
            raise FileNotFoundError(f"no catalog at {self.path}")
        number = stored[-1] if number is None else number
        text = "".join(r.value for r in self.spark.read.text(self._file(number), wholetext=True).collect())
        return Snapshot(**json.loads(text))

    def _file(self, number: int) -> str:
        return f"{self.path}/snapshots/{number:010d}.json"

    def _store(self, snapshot: Snapshot) -> Snapshot:
        own = f"{self.path}/snapshots/_{_label(json.dumps(snapshot))}.json"
        out = self._fs.create(self._path(own), True)
        out.write(bytearray(json.dumps(snapshot._asdict()).encode()))
        out.close()
        keep = self.spark.sparkContext._gateway.new_array(getattr(self.spark._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            self._context.rename(self._path(own), self._path(self._file(snapshot.number)), keep)
        except Exception as e:
            if self._fs.exists(self._path(self._file(snapshot.number))):
                raise SnapshotConflict(f"snapshot {snapshot.number} of {self.path} exists already") from e
            raise
        return snapshot

    # --- reading -----------------------------------------------------------

    def rows(self, bases: Iterable[str] | None = None, snapshot: Snapshot | None = None) -> DataFrame:
        """Rows of the catalog, or of some base paths: only their folders are read."""
        snapshot = snapshot or self.snapshot()
        wanted = snapshot.folders if bases is None else {b: snapshot.folders.get(b, []) for b in set(bases)}
        folders = [f"{self.path}/{f}" for found in wanted.values() for f in found]
        if not folders:
            return self.spark.createDataFrame([], CATALOG_SCHEMA)
        return self.spark.read.schema(CATALOG_SCHEMA).parquet(*folders)

    # --- changes -----------------------------------------------------------

    def create(self, catalog: DataFrame, next_id: int) -> Snapshot:
        """Store a first snapshot; ``next_id`` is the first id a load may use."""
        folders = self._write(catalog, 1)
        return self._store(Snapshot(1, next_id, folders, self._filter(folders, [])))

    def append(self, rows: DataFrame, next_id: int, now: Snapshot | None = None) -> Snapshot:
        """Add loaded rows (see ``load.load_catalog``) to the latest snapshot, or to
        ``now``; no stored row is written, and none read but to make filters anew."""
        now = now or self.snapshot()
        added = self._write(rows, now.number + 1)
        folders = {b: [*now.folders.get(b, []), *added.get(b, [])] for b in now.folders | added}
        filters = now.filters if now.filters is not None and len(now.filters) < MAX_FILTERS else None
        filters = self._filter(folders, []) if filters is None else self._filter(added, filters)
        return self._store(Snapshot(now.number + 1, max(now.next_id, next_id), folders, filters))

    def load(self, paths: Sequence[str], multiline: bool = False) -> load.LoadResult:
        """Load manifest files as :func:`load.load_catalog` does and append what was
        accepted, the rows of the result. Stored paths are asked through the filters."""
        now = self.snapshot()
        result = load.load_catalog(
            self.spark, paths, start=now.next_id, multiline=multiline, taken=lambda arriving: self.taken(arriving, now)
        )
        self.append(result.catalog, result.next_id, now)
        return result

    def taken(self, paths: DataFrame, snapshot: Snapshot | None = None) -> DataFrame:
        """Distinct ``full_path`` of ``paths`` that the catalog holds.

        The filters rule out nearly all new paths. Those left are compared with the
        stored ones, of which only base paths above them are read; when none is
        left no stored path is read. Filters keep the paths of deleted rows until
        they are made anew, which only costs a comparison.
        """
        snapshot = snapshot or self.snapshot()
        if snapshot.filters is None:
            return self.rows(snapshot=snapshot).select("full_path").join(paths, "full_path", "left_semi").distinct()
        stored = [(self.spark.read.parquet(f"{self.path}/{folder}"), blocks) for folder, blocks in snapshot.filters]
        ensure_checkpoint_dir(self.spark)
        hits = path_filter.maybe_known(paths, stored).checkpoint()
        above = F.expr("transform(sequence(1, length(full_path) - length(replace(full_path, '/', ''))), "
                       "i -> substring_index(full_path, '/', i))")  # fmt: skip
        named = hits.where("full_path like '%/%'").select(F.explode(above).alias("base_path")).distinct()
        bases = self.spark.createDataFrame([(b,) for b in snapshot.folders], "base_path string")
        # One row per base path, as in the snapshot.
        reached = [r.base_path for r in bases.join(named, "base_path", "left_semi").collect()]
        if not reached:
            return hits.limit(0)
        return self.rows(reached, snapshot).select("full_path").join(hits, "full_path", "left_semi").distinct()

    def delete_by_id(self, ids: DataFrame) -> Snapshot:
        return self._change(ids, "id", lambda rows: maintain.delete_by_id(rows, ids))

    def delete_by_path(self, paths: DataFrame) -> Snapshot:
        return self._change(paths, "full_path", lambda rows: maintain.delete_by_path(rows, paths))

    def update_timestamps(self, fixes: DataFrame) -> Snapshot:
        """New times by id, as :func:`maintain.update_timestamps`."""
        ids = fixes.select(F.col("vault_id").alias("id"))
        return self._change(ids, "id", lambda rows: maintain.update_timestamps(rows, fixes))

    def drop_bases(self, bases: Iterable[str]) -> Snapshot:
        now, gone = self.snapshot(), set(bases)
        return self._store(now._replace(number=now.number + 1, folders={b: f for b, f in now.folders.items() if b not in gone}))

    def _change(self, listed: DataFrame, column: str, change: Callable[[DataFrame], DataFrame]) -> Snapshot:
        """Rewrite the base paths with a row whose ``column`` is listed."""
        now = self.snapshot()
        hit = self.rows(snapshot=now).select(column, "base_path").join(listed.select(column).distinct(), column, "left_semi")
        touched = [r.base_path for r in hit.select("base_path").distinct().collect()]
        if not touched:
            return now
        written = self._write(change(self.rows(touched, now)), now.number + 1)
        # A base path that has lost all its rows is listed no more.
        kept = {b: f for b, f in now.folders.items() if b not in touched}
        return self._store(now._replace(number=now.number + 1, folders=kept | written))

    def _filter(self, folders: dict[str, list[str]], earlier: list[list]) -> list[list]:
        """``earlier`` filters and a new one over the paths in ``folders``."""
        stored = [f"{self.path}/{f}" for found in folders.values() for f in found]
        if not stored:
            return earlier
        rows = self.spark.read.schema(CATALOG_SCHEMA).parquet(*stored)
        blocks = path_filter.blocks_for(rows.count())
        folder = f"filters/{self.spark.range(0, 1, 1, 1).select(F.uuid()).first()[0]}"
        path_filter.build(rows, blocks).write.parquet(f"{self.path}/{folder}")
        return [*earlier, [folder, blocks]]

    def _write(self, rows: DataFrame, number: int) -> dict[str, list[str]]:
        """Rows in new folders, and those folders by base path. A huge base path is
        written by many tasks. The folder's name is drawn, so that writers that meet
        do not mix."""
        token = self.spark.range(0, 1, 1, 1).select(F.uuid()).first()[0]
        folder = f"rows/{number:010d}-{token}"
        labelled = rows.select(*CATALOG_COLUMNS).withColumn("base", F.sha1(F.col("base_path").cast("binary")))
        (
            labelled.hint("rebalance", "base")
            .sortWithinPartitions("base", "last_modified")
            .write.partitionBy("base")
            .parquet(f"{self.path}/{folder}")
        )
        home = self._path(f"{self.path}/{folder}")
        labels = {s.getPath().getName() for s in self._fs.listStatus(home) if s.isDirectory()}
        schema = "base_path string, base string"
        found = self.spark.read.schema(schema).parquet(f"{self.path}/{folder}").distinct().collect() if labels else []
        return {r.base_path: [f"{folder}/base={r.base}"] for r in found}
