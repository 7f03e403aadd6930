"""Manifest files, loads, inventories and instruction files."""

import hashlib
import os

import pytest
from pyspark.sql import functions as F

from copyledger.operators import catalog as cat_ops
from copyledger.operators import manifest
from copyledger.plans import actions
from copyledger.schema import CATALOG_COLUMNS, CATALOG_SCHEMA, FIRST_ID, as_catalog
from copyledger.sources import categories, inventory, load, manifest_io
from copyledger.streaming.incremental import load_stream, read_loaded

H = "0123456789abcdef0123456789abcdef0123456"


def line(i, path, base="/b", size="5", when="2024-01-01T00:00:00", mime="text/plain"):
    return "\t".join([H + str(i), when, size, mime, base, path])


def write(path, lines):
    path.write_text("".join(f"{x}\n" for x in lines), encoding="utf-8")
    return str(path)


# --- manifests -----------------------------------------------------------


def test_strict_and_failfast_disagree_on_tabs(spark, tmp_path):
    empty_last = write(tmp_path / "empty.tsv", [line(1, "")])
    extra_tabs = write(tmp_path / "tabs.tsv", [line(2, "f") + "\t\t"])
    short = write(tmp_path / "short.tsv", ["a\tb\tc\td\te"])

    good, bad = manifest_io.read_manifest(spark, [empty_last, extra_tabs, short], mode="strict")
    assert [r.file_path for r in good.collect()] == [""]
    assert bad.count() == 2

    with pytest.raises(Exception, match="invalid manifest line"):
        manifest_io.read_manifest(spark, empty_last).collect()
    assert [r.file_path for r in manifest_io.read_manifest(spark, extra_tabs).collect()] == ["f"]
    for path in (short, write(tmp_path / "size.tsv", [line(3, "f", size="1x")])):
        with pytest.raises(Exception, match="invalid manifest line"):
            manifest_io.read_manifest(spark, path).count()


def test_quotes_are_written_raw_and_misread_by_the_load(spark, tmp_path):
    path = write(tmp_path / "q.tsv", [line(1, 'a"b'), line(2, '"c"')])
    back = str(tmp_path / "back")
    manifest_io.write_manifest(manifest_io.read_manifest(spark, path), back)
    assert sorted(r.value for r in spark.read.text(back).collect()) == sorted([line(1, 'a"b'), line(2, '"c"')])
    # the open quote fails the load; quotes that close are dropped
    assert [r.status for r in load.load_catalog(spark, [path]).status.collect()] == ["failed"]
    closed = write(tmp_path / "c.tsv", [line(2, '"c"'), line(3, 'd"e"f')])
    loaded = load.load_catalog(spark, [closed]).catalog
    assert {r.file_path for r in loaded.collect()} == {"c", "def"}


def test_line_numbers_over_many_splits(spark, tmp_path):
    a = write(tmp_path / "a.tsv", [f"{i}-{'x' * (i % 50)}" for i in range(1, 401)])
    b = write(tmp_path / "b.tsv", [f"{i}-" for i in range(1, 31)])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        lines = manifest_io.read_lines(spark, [a, b])
        assert spark.read.text(a).rdd.getNumPartitions() > 5
        rows = lines.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(rows) == 430
    assert all(int(r.value.split("-")[0]) == r.line_no for r in rows)


def test_split_folders(spark, tmp_path):
    path = write(tmp_path / "m.tsv", [line(1, "a"), line(2, "b", mime="image/svg+xml"), "bad"])
    good, _ = manifest_io.read_manifest(spark, path, mode="strict")
    out = str(tmp_path / "out")
    manifest_io.write_split(manifest.split_manifest(good), out, "m")
    assert {d for d in os.listdir(out) if d.startswith("manifest=")} == {
        "manifest=m_text_plain.meta", "manifest=m_image_svg_xml.meta",
    }
    major = manifest.split_manifest(good, by_major=True, majors=["image"])
    assert [(r.split_key, r.file_path) for r in major.collect()] == [("image", "b")]


def test_to_tsv_is_unquoted(spark, tmp_path):
    out = str(tmp_path / "tsv")
    manifest_io.to_tsv(spark.createDataFrame([('a"b', None, 3)], "p string, q string, n int"), out)
    assert [r.value for r in spark.read.text(out).collect()] == ['a"b\t\t3']


# --- loads ---------------------------------------------------------------


def test_csv_fields(spark):
    cases = {
        "a\tb": ["a", "b"], "a\t": ["a", None], "": [None], '""\tb': ["", "b"], '"a\tb"\tc': ["a\tb", "c"],
        '"a""b"': ['a"b'], 'a""b': ["ab"], '""""': ['"'], '"x"y"z"\t': ["xyz", None], '"a': None, 'a"b\tc': None,
        'p"q""r"\t"s"': ['pq"r', "s"],
    }
    df = spark.createDataFrame([(v,) for v in cases], "v string")
    got = {r.v: r.f for r in df.select("v", load.csv_fields(F.col("v")).alias("f")).collect()}
    assert got == cases


def test_load_stops_at_the_first_failing_file(spark, tmp_path):
    first = write(tmp_path / "1.tsv", [line(1, "a"), line(2, "B/x.TXT")])
    second = write(tmp_path / "2.tsv", [line(3, "c")])
    clash = write(tmp_path / "3.tsv", [line(4, "d"), line(5, "c")])
    later = write(tmp_path / "4.tsv", [line(6, "e")])
    absent = str(tmp_path / "none.tsv")
    result = load.load_catalog(spark, [first, absent, second, clash, later])
    status = {os.path.basename(r.path): (r.status, r.row_count) for r in result.status.collect()}
    assert status == {
        "1.tsv": ("loaded", 2), "2.tsv": ("loaded", 1), "none.tsv": ("skipped", 0), "3.tsv": ("failed", 2),
        "4.tsv": ("not reached", 1),
    }
    assert result.catalog.schema.names == CATALOG_SCHEMA.names
    rows = {r.file_path: r for r in result.catalog.collect()}
    assert set(rows) == {"a", "B/x.TXT", "c"}
    assert rows["B/x.TXT"].file_name == "x.TXT" and rows["B/x.TXT"].file_ext == "txt"
    assert sorted(r.id for r in rows.values()) == [FIRST_ID, FIRST_ID + 1, FIRST_ID + 2]

    more = load.load_catalog(spark, [later], existing=result.catalog)
    assert {r.id: r.file_path for r in more.catalog.collect()}[FIRST_ID + 3] == "e"
    again = load.load_catalog(spark, [second], existing=result.catalog)
    assert [r.status for r in again.status.collect()] == ["failed"]
    assert again.catalog.count() == 3


def test_load_takes_folders_and_odd_names(spark, tmp_path):
    folder = tmp_path / "some scans"
    (folder / "more").mkdir(parents=True)
    write(folder / "a b.tsv", [line(1, "a")])
    write(folder / "c%20d.tsv", [line(2, "b")])
    single = write(tmp_path / "é.tsv", [line(3, "c"), line(4, "a")])
    result = load.load_catalog(spark, [str(folder), single])
    status = {os.path.basename(r.path): (r.status, r.row_count) for r in result.status.collect()}
    assert status == {"some scans": ("loaded", 2), "é.tsv": ("failed", 2)}
    assert {r.file_path for r in result.catalog.collect()} == {"a", "b"}


@pytest.mark.parametrize(
    "text",
    [
        line(1, "a", size=""), line(1, "a", when="yesterday"), line(1, "a", size="1.5"), line(1, ""), "x\ty",
        line(1, "a") + "\textra", line(11, "a"), "", line(1, '"a'),
    ],
)
def test_malformed_rows_fail_the_file(spark, tmp_path, text):
    path = write(tmp_path / "m.tsv", [line(2, "ok"), text])
    result = load.load_catalog(spark, [path])
    assert [r.status for r in result.status.collect()] == ["failed"]
    assert result.catalog.count() == 0


def test_ids_match_a_global_numbering(spark, sf):
    from copyledger.registry import tables

    df = tables.catalog(spark, sf).select("full_path")
    got = {r.full_path: r.id for r in load.assign_ids(df).collect()}
    order = sorted(got, key=lambda p: hashlib.sha1(p.encode()).hexdigest())
    assert [got[p] for p in order] == list(range(FIRST_ID, FIRST_ID + len(order)))


def test_reset(spark, tmp_path):
    out = str(tmp_path / "cat")
    load.reset_catalog(spark, out)
    stored = spark.read.parquet(out)
    assert stored.count() == 0 and stored.schema.names == CATALOG_SCHEMA.names
    assert load.next_id(stored) == FIRST_ID


def test_stream_loads_only_new_files(spark, tmp_path):
    source, out, ck = tmp_path / "in", str(tmp_path / "cat"), str(tmp_path / "ck")
    source.mkdir()
    write(source / "1.tsv", [line(1, "a"), line(2, "b")])
    load_stream(spark, str(source), out, ck).awaitTermination(120)
    write(source / "2.tsv", [line(3, "c.TXT")])
    load_stream(spark, str(source), out, ck).awaitTermination(120)
    rows = {r.file_path: (r.id, r.batch) for r in read_loaded(spark, out).collect()}
    assert rows["c.TXT"] == (FIRST_ID + 2, 1)
    assert sorted(i for i, _ in rows.values()) == [FIRST_ID, FIRST_ID + 1, FIRST_ID + 2]
    assert load.stored_next_id(spark, out) == FIRST_ID + 3
    write(source / "3.tsv", [line(4, "a")])
    with pytest.raises(Exception, match="already in the catalog"):
        load_stream(spark, str(source), out, ck).awaitTermination(120)
    assert read_loaded(spark, out).count() == 3


@pytest.mark.parametrize("text", [line(5, "t", when="yesterday"), line(5, ""), line(5, '"t')])
def test_stream_refuses_what_a_load_refuses(spark, tmp_path, text):
    source = tmp_path / "in"
    source.mkdir()
    write(source / "1.tsv", [line(1, "a"), text])
    with pytest.raises(Exception, match="invalid manifest lines"):
        load_stream(spark, str(source), str(tmp_path / "cat"), str(tmp_path / "ck")).awaitTermination(120)


def test_ids_of_deleted_rows_are_not_used_again(spark, tmp_path):
    first = load.load_catalog(spark, [write(tmp_path / "1.tsv", [line(1, "a"), line(2, "b")])])
    out = str(tmp_path / "cat")
    assert load.stored_next_id(spark, out) == FIRST_ID
    first.catalog.where(F.col("id") <= FIRST_ID).write.parquet(out)
    load.store_next_id(spark, out, first.next_id)
    kept = spark.read.parquet(out)
    start = load.stored_next_id(spark, out)
    more = load.load_catalog(spark, [write(tmp_path / "2.tsv", [line(3, "c")])], existing=kept, start=start)
    assert sorted(r.id for r in more.catalog.collect()) == [FIRST_ID, FIRST_ID + 2]
    assert more.next_id == FIRST_ID + 3
    load.store_next_id(spark, out, FIRST_ID + 1)
    assert load.stored_next_id(spark, out) == start
    load.reset_catalog(spark, out)
    assert load.stored_next_id(spark, out) == FIRST_ID


# --- inventory -----------------------------------------------------------


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "root dir"
    (root / "sub" / ".deep").mkdir(parents=True)
    (root / "none").mkdir()
    bodies = {
        "a.TXT": b"hello", "sub/b.png": b"\x89PNG\x00", "sub/c": b"", "sub/d.Jpg": b"x" * 5000, ".bashrc": b"#",
        "sub/.deep/_e.jpg": b"e",
    }
    for name, body in bodies.items():
        (root / name).write_bytes(body)
        os.utime(root / name, (1704067200.75, 1704067200.75))
    (root / "link").symlink_to(root / "a.TXT")
    return str(root), bodies


def test_scan_files(spark, tree, monkeypatch):
    root, bodies = tree
    rows = {r.file_path: r for r in inventory.scan_files(spark, root).collect()}
    assert set(rows) == set(bodies)
    for name, body in bodies.items():
        r = rows[name]
        assert r["hash"] == hashlib.sha1(body).hexdigest()
        assert (r.file_size, r.base_path) == (len(body), root)
        assert str(r.last_modified) == "2024-01-01 00:00:00"
    assert {n: r.mime_type for n, r in rows.items()} == {
        "a.TXT": "text/plain", "sub/b.png": "image/png", "sub/c": "application/octet-stream", "sub/d.Jpg": "image/jpeg",
        ".bashrc": "application/octet-stream", "sub/.deep/_e.jpg": "image/jpeg",
    }
    images = inventory.scan_files(spark, root + "/", include=["image"])
    assert {r.file_path for r in images.collect()} == {"sub/b.png", "sub/d.Jpg", "sub/.deep/_e.jpg"}


def test_scan_reports_unreadable_files(spark, tree, monkeypatch):
    """One file that cannot be read is named, and the scan is refused wherever a
    missing file would count as deleted."""
    root, bodies = tree
    whole = inventory.scan(spark, root)
    assert {r.file_path for r in whole.rows.collect()} == set(bodies)
    assert whole.errors.count() == 0 and [tuple(r) for r in whole.marks.collect()] == [(root, len(bodies), 0)]

    hashed = inventory._hash_files

    def failing(batches):
        for batch in hashed(batches):
            for end, error in ("sub/c", "PermissionError: Permission denied"), ("a.TXT", "FileNotFoundError: gone"):
                hit = batch["path"].str.endswith(end)
                batch.loc[hit, "hash"], batch.loc[hit, "error"] = None, error
            yield batch

    monkeypatch.setattr(inventory, "_hash_files", failing)
    partly = inventory.scan(spark, root)
    assert {r.file_path for r in partly.rows.collect()} == set(bodies) - {"sub/c", "a.TXT"}
    assert [tuple(r) for r in partly.errors.collect()] == [(root, "sub/c", "PermissionError: Permission denied")]
    assert [tuple(r) for r in partly.marks.collect()] == [(root, len(bodies) - 1, 1)]
    none = inventory.scan(spark, root, include=["video"])
    assert [tuple(r) for r in none.marks.collect()] == [(root, 0, 0)]

    manifest_rows = whole.rows
    now = partly.rows.select(
        F.concat_ws("/", "base_path", "file_path").alias("full_path"), F.lit(True).alias("is_regular"), "file_size",
        "last_modified", "mime_type",
    )
    catalog = load.assign_ids(as_catalog(manifest_rows.withColumn("id", F.lit(0))).drop("id")).select(*CATALOG_COLUMNS)
    bases = spark.createDataFrame([(root, 1, False)], "base_path string, priority int, is_vault boolean")
    for concluded in [
        lambda marks: inventory.missing_rows(catalog, now, marks),
        lambda marks: manifest.clean(manifest_rows, now, marks),
        lambda marks: actions.redundant_plan(catalog, bases, now, marks),
    ]:
        with pytest.raises(ValueError, match=r"unreadable files: .*\(1 files\)"):
            concluded(partly.marks)
        with pytest.raises(ValueError, match="missing or not mounted"):
            concluded(whole.marks.where("false"))
        concluded(whole.marks).collect()
    assert {r.full_path for r in inventory.missing_rows(catalog, now, whole.marks).collect()} == {
        f"{root}/sub/c", f"{root}/a.TXT"
    }


def test_scan_store_equals_scan_files(spark, tree):
    """Empty objects, dot and underscore names and odd characters included."""
    root, _ = tree
    for name in "empty", "_under", "sp ace%20é", "sub/.dot/x":
        os.makedirs(os.path.dirname(f"{root}/{name}"), exist_ok=True)
        with open(f"{root}/{name}", "wb") as f:
            f.write(b"" if name == "empty" else name.encode())
    for include in ([], ["image"]):
        mounted = inventory.scan_files(spark, root, include).collect()
        assert sorted(map(str, inventory.scan_store(spark, f"file://{root}/", include).collect())) == sorted(map(str, mounted))
    scanned = inventory.scan(spark, f"file://{root}")
    assert scanned.rows.count() == 10 and scanned.errors.count() == 0
    assert [tuple(r) for r in scanned.marks.collect()] == [(root, 10, 0)]


def test_objects_are_hashed_as_streams(tmp_path, monkeypatch):
    import pandas as pd

    monkeypatch.setattr(inventory, "CHUNK", 1000)
    body = bytes(range(256)) * 50
    (tmp_path / "large").write_bytes(body)
    batch = pd.DataFrame({"path": [f"{tmp_path}/large", f"{tmp_path}/none"]})
    (found,) = inventory._hash_objects(f"file://{tmp_path}")([batch])
    assert found["hash"].tolist() == [hashlib.sha1(body).hexdigest(), None]
    assert found["error"][0] is None and found["error"][1].startswith("FileNotFoundError")


def test_scan_binary_opens_only_wanted_objects(spark, tree):
    root, bodies = tree
    images = inventory.scan_binary(spark, f"file://{root}", include=["image"])
    rows = {r.file_path: r for r in images.collect()}
    assert set(rows) == {"sub/b.png", "sub/d.Jpg"}
    assert rows["sub/d.Jpg"]["hash"] == hashlib.sha1(bodies["sub/d.Jpg"]).hexdigest()
    assert rows["sub/d.Jpg"].base_path == root
    assert len(images.inputFiles()) == 2


def test_default_categories(spark):
    types = ["image/png", "image/never-seen", "audio/mpeg", "application/pdf", "application/zip", "text/csv", "text/plain",
             "application/x-unmapped", "IMAGE/PNG", "odd", "", None]
    table = spark.createDataFrame([(t,) for t in types * 2], "mime_type string")
    found = {r.mime_type: r.category for r in categories.default_categories(table).collect()}
    assert found == {
        "image/png": "image", "image/never-seen": "image", "audio/mpeg": "audio", "application/pdf": "document",
        "application/zip": "archives", "text/csv": "spreadsheet", "text/plain": "text",
    }
    own = spark.createDataFrame([("text/plain", "notes"), ("odd", "mine"), ("absent", "x")], "mime_type string, category string")
    found |= {"text/plain": "notes", "odd": "mine"}
    assert {r.mime_type: r.category for r in categories.default_categories(table, own).collect()} == found
    fixed = categories.fixed_categories(spark)
    assert fixed.count() == len(categories.TYPE_CATEGORIES) == fixed.select("mime_type").distinct().count()


def test_missing_rows_need_all_bases(spark):
    rows = [(1, "/m/a", "/m/a/x"), (2, "/m/a", "/m/a/y"), (3, "/n/a", "/n/a/z")]
    cat = spark.createDataFrame(rows, "id bigint, base_path string, full_path string")
    inv = spark.createDataFrame([("/m/a/x",)], "full_path string")
    live = spark.createDataFrame([("/m/a",), ("/n/a",)], "base_path string")
    gone = inventory.missing_rows(cat, inv, live)
    assert {r.id for r in gone.collect()} == {2, 3}
    with pytest.raises(ValueError, match="/n/a"):
        inventory.missing_rows(cat, inv, live.where("base_path = '/m/a'"))


def test_missing_reports_keep_equal_segments_apart(spark, tmp_path):
    rows = [(2, "/m/a", "/m/a/y"), (3, "/n/a", "/n/a/z")]
    out = str(tmp_path / "missing")
    inventory.write_missing(spark.createDataFrame(rows, "id bigint, base_path string, full_path string"), out)
    folders = [d for d in os.listdir(out) if d.startswith("missing_rows=a_")]
    assert len(folders) == 2
    ids, bad = manifest_io.read_id_list(spark, [f"{out}/{d}" for d in folders])
    assert {r.id for r in ids.collect()} == {2, 3}
    assert {r.bad_rows for r in bad.collect()} == {0}


def test_stored_catalog_prunes_base_paths(spark, sf, tmp_path, final_plan):
    from copyledger.registry import tables

    out = str(tmp_path / "cat")
    cat_ops.write_catalog(tables.catalog(spark, sf), out)
    stored = spark.read.parquet(out)
    one = cat_ops.scan_base(stored, "/vol/v3")
    plan = final_plan(one)
    assert "PartitionFilters: [isnotnull(base_path" in plan
    assert "ReadSchema: struct<id:bigint,full_path:string>" in plan
    assert one.count() == tables.catalog(spark, sf).where("base_path = '/vol/v3'").count()


def test_filters_reach_the_scan(spark, sf, tmp_path, final_plan):
    from copyledger.plans import reports
    from copyledger.registry import tables

    out = str(tmp_path / "flat")
    tables.catalog(spark, sf).write.parquet(out)
    stored, bases = spark.read.parquet(out), tables.base_paths(spark)
    plan = final_plan(cat_ops.mime_filter(stored, ["image"]))
    assert "StringStartsWith(mime_type,image/)" in plan
    plan = final_plan(reports.path_prefix_filter(stored, bases, "/vol/v3/p"))
    assert "StringStartsWith(full_path,/vol/v3/p)" in plan
    plan = final_plan(reports.mime_duplication_summary(stored, bases))
    assert "file_path" not in plan and "full_path" not in plan and plan.count("FileScan") == 1


# --- instruction files ---------------------------------------------------


def test_id_list(spark, tmp_path):
    with_header = write(tmp_path / "h.tsv", ["id\tpath", " 7 \tx", "8\r\ty", "bad\tz", "", "9"])
    without = write(tmp_path / "n.tsv", ["1\tx", "-2\ty", "3x"])
    ids, bad = manifest_io.read_id_list(spark, [with_header, without])
    assert {r.id for r in ids.collect()} == {7, 8, 9, 1}
    assert {os.path.basename(r.source): r.bad_rows for r in bad.collect()} == {"h.tsv": 2, "n.tsv": 2}


def test_ts_fixes(spark, tmp_path):
    path = write(
        tmp_path / "f.tsv",
        ["vault_id\tprimary_last_modified\tvault_full_path", "", "5\t2024-01-02 03:04:05\t/v/a \r", "x\t\t", " 6\t2024-01-01 00:00:00"],
    )
    rows = {r.vault_id: r for r in manifest_io.read_ts_fixes(spark, path).collect()}
    assert set(rows) == {5, 6}
    assert (rows[5].line_no, str(rows[5].primary_last_modified), rows[5].vault_full_path) == (3, "2024-01-02 03:04:05", "/v/a")
    assert rows[6].vault_full_path == ""


def test_read_categories(spark, tmp_path):
    path = write(tmp_path / "c.tsv", ["image/png\timage", "text/x\ttext"])
    assert {tuple(r) for r in categories.read_categories(spark, path).collect()} == {("image/png", "image"), ("text/x", "text")}
    held = spark.createDataFrame([("image/png",), ("foo",), ("IMAGE/PNG",), ("image/zzz",)], "mime_type string")
    seeded = categories.seed_categories(held, categories.read_categories(spark, path))
    assert [tuple(r) for r in seeded.collect()] == [("image/png", "image")]


def test_session_settings(spark):
    from copyledger.session import configure, shared_dir

    keys = ["spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes"]
    before = {k: spark.conf.get(k) for k in keys}
    try:
        configure(spark, 10**14)
        assert spark.conf.get("spark.sql.shuffle.partitions") == str(10**14 // (128 * 1024 * 1024))
        configure(spark, 1)
        assert spark.conf.get("spark.sql.shuffle.partitions") == "200"
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        assert shared_dir(spark) == named


def test_quoted_line_breaks_load_on_demand(spark, tmp_path):
    broken = 'h1\t2020-01-01T00:00:00\t1\ttext/plain\t/b\t"a\nb ""c"""'
    path = write(tmp_path / "1.tsv", [broken, line(2, "d")])
    assert [r.status for r in load.load_catalog(spark, [path]).status.collect()] == ["failed"]
    result = load.load_catalog(spark, [path], multiline=True)
    assert [(r.status, r.row_count) for r in result.status.collect()] == [("loaded", 2)]
    assert 'a\nb "c"' in {r.file_path for r in result.catalog.collect()}
    short = write(tmp_path / "2.tsv", [broken, "h\t2020-01-01T00:00:00\t1"])
    assert [r.status for r in load.load_catalog(spark, [short], multiline=True).status.collect()] == ["failed"]


def test_files_belong_to_the_closest_argument(spark, tmp_path):
    inner = tmp_path / "in" / "deep"
    inner.mkdir(parents=True)
    write(tmp_path / "in" / "1.tsv", [line(1, "a"), line(2, "b")])
    write(inner / "2.tsv", [line(3, "c")])
    other = write(tmp_path / "3.tsv", [line(4, "d")])
    result = load.load_catalog(spark, [f"{tmp_path}/in/", str(inner), other])
    counts = {r.path: (r.status, r.row_count) for r in result.status.collect()}
    assert counts[f"{tmp_path}/in/"] == ("loaded", 2) and counts[str(inner)] == ("loaded", 1)
    assert counts[other] == ("loaded", 1)
