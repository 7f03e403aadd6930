"""Changes of a stored catalog rewrite only the base paths they touch."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from copyledger.operators import maintain
from copyledger.registry import tables
from copyledger.schema import CATALOG_SCHEMA
from copyledger.sources import load, manifest_io, path_filter, snapshots
from copyledger.sources.snapshots import SnapshotConflict, StoredCatalog


@pytest.fixture
def stored(spark, sf, tmp_path):
    catalog = tables.catalog(spark, sf)
    store = StoredCatalog(spark, f"{tmp_path}/catalog")
    store.create(catalog, load.next_id(catalog))
    return store, catalog


def rows_of(df):
    return sorted(map(str, df.select(*CATALOG_SCHEMA.names).collect()))


def files(store):
    return {p: os.stat(p).st_mtime_ns for p in glob.glob(f"{store.path}/rows/**/*.parquet", recursive=True)}


def test_deletes_and_updates(spark, stored):
    store, catalog = stored
    assert rows_of(store.rows()) == rows_of(catalog)
    first = files(store)
    ids = catalog.where("base_path = '/vol/v1' AND id % 5 = 0").select("id")
    after = store.delete_by_id(ids.unionByName(ids).union(spark.sql("SELECT -1L")))
    expected = maintain.delete_by_id(catalog, ids)
    assert rows_of(store.rows()) == rows_of(expected)
    new = files(store)
    assert {p: t for p, t in new.items() if p in first} == first  # nothing is written again
    assert len({os.path.dirname(p) for p in set(new) - set(first)}) == 1  # one base path is new
    before = store.snapshot(1)
    assert {b for b in before.folders if before.folders[b] != after.folders[b]} == {"/vol/v1"}

    paths = catalog.where("base_path IN ('/vol/v2', '/vol/v3')").where(F.col("id") % 2 == 0).select("full_path")
    assert set(store.delete_by_path(paths).folders) == set(before.folders)
    expected = maintain.delete_by_path(expected, paths)
    fixes = expected.where("base_path = '/vol/v4'").select(
        F.col("id").alias("vault_id"), F.expr("timestamp_ntz'2020-02-02 00:00:00'").alias("primary_last_modified"), F.lit(1).alias("line_no")
    )
    store.update_timestamps(fixes.cache())
    expected = maintain.update_timestamps(expected, fixes)
    assert rows_of(store.rows()) == rows_of(expected)
    assert rows_of(store.rows(snapshot=before)) == rows_of(catalog)
    assert store.numbers() == [1, 2, 3, 4]


def test_a_base_path_can_lose_all_rows(spark, stored):
    store, catalog = stored
    gone = store.delete_by_id(catalog.where("base_path = '/vol/v0'").select("id"))
    assert "/vol/v0" not in gone.folders
    assert rows_of(store.rows()) == rows_of(catalog.where("base_path <> '/vol/v0'"))
    store.drop_bases(["/vol/v1", "/none"])
    assert rows_of(store.rows()) == rows_of(catalog.where("base_path NOT IN ('/vol/v0', '/vol/v1')"))
    store.delete_by_path(catalog.select("full_path"))
    assert store.rows().count() == 0 and store.snapshot().folders == {}


def test_only_wanted_base_paths_are_read(spark, stored):
    store, catalog = stored
    some = store.rows(["/vol/v1", "/none"])
    assert rows_of(some) == rows_of(catalog.where("base_path = '/vol/v1'"))
    assert len({os.path.dirname(f) for f in some.inputFiles()}) == 1
    assert store.rows([]).count() == 0
    same = store.delete_by_id(spark.sql("SELECT -1L AS id"))
    assert same.number == 1 and store.numbers() == [1]


def test_loads_are_appended(spark, stored, tmp_path):
    store, catalog = stored
    odd = "/vol/it's odd/%2F=é"
    lines = spark.createDataFrame(
        [("a" * 40, "2024-01-01T00:00:00", 1, "image/png", odd, "x"), ("b" * 40, "2024-01-01T00:00:00", 2, "image/png", "/vol/v1", "new")],
        "hash string, last_modified string, file_size bigint, mime_type string, base_path string, file_path string",
    )
    manifest_io.write_manifest(lines, f"{tmp_path}/new.meta")
    result = load.load_catalog(spark, [f"{tmp_path}/new.meta"], existing=store.rows(), start=store.snapshot().next_id)
    taken = store.snapshot().next_id
    before = files(store)
    store.append(result.catalog.where(F.col("id") >= taken), result.next_id)
    assert {p: t for p, t in files(store).items() if p in before} == before
    assert rows_of(store.rows()) == rows_of(result.catalog)
    assert store.snapshot().next_id == taken + 2
    assert store.rows([odd]).count() == 1


def manifest(spark, tmp_path, name, *rows):
    schema = "hash string, last_modified string, file_size bigint, mime_type string, base_path string, file_path string"
    lines = [("a" * 40, "2024-01-01T00:00:00", 1, "image/png", base, file) for base, file in rows]
    manifest_io.write_manifest(spark.createDataFrame(lines, schema), f"{tmp_path}/{name}")
    return f"{tmp_path}/{name}"


def test_loads_ask_filters(spark, stored, tmp_path, monkeypatch):
    store, catalog = stored
    read = []
    plain = store.rows
    monkeypatch.setattr(store, "rows", lambda bases=None, snapshot=None: read.append(bases) or plain(bases, snapshot))
    new = [manifest(spark, tmp_path, "1", ("/vol/v1", "new"), ("/else", "x")), manifest(spark, tmp_path, "2", ("/vol", "v1/it's"))]
    result = store.load(new)
    assert [r.status for r in result.status.collect()] == ["loaded", "loaded"] and result.catalog.count() == 3
    assert read == []  # no stored path was read
    now = store.snapshot()
    assert len(now.filters) == 2 and now.next_id == result.next_id
    # The same path by way of another base path, and a file after the failing one.
    clash = [manifest(spark, tmp_path, "3", ("/vol/v1", "it's"), ("/else", "y")), manifest(spark, tmp_path, "4", ("/else", "z"))]
    expected = load.load_catalog(spark, clash, existing=plain(), start=now.next_id)
    again = store.load(clash)
    assert sorted(again.status.collect()) == sorted(expected.status.collect())
    assert read and all("/vol" in b and "/else" not in b for b in read)
    assert rows_of(plain()) == rows_of(expected.catalog)
    # A deleted path is free again, though the filter still knows it.
    store.delete_by_path(spark.createDataFrame([("/vol/v1/it's",)], "full_path string"))
    assert {r.status for r in store.load(clash).status.collect()} == {"loaded"}
    assert store.load([f"{tmp_path}/none"]).status.first().status == "skipped"


def test_filters_are_made_anew(spark, stored, tmp_path, monkeypatch):
    store, catalog = stored
    monkeypatch.setattr(snapshots, "MAX_FILTERS", 2)
    for i in range(2):
        store.load([manifest(spark, tmp_path, f"{i}", ("/n", f"{i}"))])
    assert len(store.snapshot().filters) == 1
    every = store.rows().select("full_path")
    assert store.taken(every).count() == every.count() == catalog.count() + 2
    bare = store.snapshot()._replace(filters=None)
    some = spark.sql("SELECT '/n/1' AS full_path UNION ALL SELECT '/n/1' UNION ALL SELECT null UNION ALL SELECT '' UNION ALL SELECT 'q'")
    assert [r[0] for r in store.taken(some, bare).collect()] == [r[0] for r in store.taken(some).collect()] == ["/n/1"]


def test_filter_is_sharp(spark):
    known = spark.range(20_000).selectExpr("concat('/a/', id) AS full_path")
    blocks = path_filter.blocks_for(20_000)
    built = [(path_filter.build(known, blocks), blocks)]
    assert path_filter.maybe_known(known, built).count() == 20_000
    foreign = spark.range(50_000).selectExpr("concat('/b/', id) AS full_path")
    assert path_filter.maybe_known(foreign, built).count() <= 25
    assert path_filter.maybe_known(known, []).count() == 0
    assert [path_filter.blocks_for(n) for n in (0, 1, 8, 9, 16, 100)] == [1, 1, 1, 1, 2, 16]


def test_two_writers(spark, stored):
    store, catalog = stored
    other = StoredCatalog(spark, store.path)
    seen = other.snapshot()
    store.drop_bases(["/vol/v1"])
    other.snapshot = lambda number=None: seen  # still at the first snapshot
    with pytest.raises(SnapshotConflict):
        other.delete_by_id(catalog.where("base_path = '/vol/v2'").select("id"))
    assert rows_of(store.rows()) == rows_of(catalog.where("base_path <> '/vol/v1'"))


def test_an_empty_catalog(spark, tmp_path):
    store = StoredCatalog(spark, f"{tmp_path}/none")
    with pytest.raises(FileNotFoundError):
        store.rows()
    store.create(spark.createDataFrame([], CATALOG_SCHEMA), 7)
    assert store.rows().count() == 0 and store.snapshot().next_id == 7
    with pytest.raises(SnapshotConflict):
        store.create(spark.createDataFrame([], CATALOG_SCHEMA), 7)
