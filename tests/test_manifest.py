"""Manifest operators, plans and health checks on small hand-made inputs."""

import random

import pytest
from pyspark.sql import functions as F

from copyledger.operators import maintain, manifest, quality
from copyledger.plans import actions, reports
from copyledger.schema import BASE_PATHS_SCHEMA, as_catalog

SCHEMA = "hash string, last_modified string, file_size bigint, mime_type string, base_path string, file_path string"
T0, T1 = "2024-01-01T00:00:00", "2024-01-01T00:00:01"


@pytest.fixture(scope="module")
def man(spark):
    def make(*rows):
        return spark.createDataFrame(list(rows), SCHEMA)

    return make


@pytest.fixture(scope="module")
def inv(spark):
    def make(*rows):
        df = spark.createDataFrame(
            list(rows), "full_path string, is_regular boolean, is_writable boolean, file_size bigint, t string, mime_type string"
        )
        return df.withColumn("last_modified", F.col("t").cast("timestamp_ntz")).drop("t")

    return make


def paths_of(df):
    return sorted(r.file_path for r in df.collect())


def test_intersect_matches_on_hash_only_and_keeps_repeats(man):
    a = man(("h", T0, 1, "image/png", "/b", "1"), ("h", T0, 1, "image/png", "/b", "1"), ("k", T0, 1, "x/y", "/b", "2"))
    b = man(("h", T1, 9, "text/plain", "/c", "9"), ("h", T1, 9, "text/plain", "/c", "8"))
    assert paths_of(manifest.intersect(a, b)) == ["1", "1"]
    assert paths_of(manifest.intersect(a, b, ["text"])) == []


def test_purge_against_itself_matches_all(man):
    rows = man(("h", T0, 1024, "image/png", "/b", "1"), ("h", T0, 1024, "text/plain", "/b", "2"))
    everything = manifest.purge_split(rows, rows)
    assert [r.matched for r in everything.collect()] == [True, True]
    images = manifest.purge_split(rows, rows, ["image"])
    assert {r.file_path: r.matched for r in images.collect()} == {"1": True, "2": False}
    row = manifest.purge_summary(images, rows).first()
    assert row.asDict() == {"matched": 1, "reference_keys": 2, "planned": 1, "retained": 1, "space_saved": "1.000 KB"}


def test_purge_summary_of_nothing(man):
    none = man().limit(0)
    assert manifest.purge_summary(manifest.purge_split(none, none), none).first().space_saved == "0 B"


def test_select_prefers_old_then_higher_paths(man):
    rows = man(
        ("h", T1, 1, "m/x", "/z", "z"), ("h", T0, 1, "m/x", "/a", "z"), ("h", T0, 1, "m/x", "/b", "a"),
        ("h", T0, 1, "m/x", "/b", "b"), ("h", T0, 1, "m/x", "/b", "b"), ("h", T0, 7, "m/y", "/a", "other"),
    )
    scope = manifest.select_scope(rows)
    best = {(r.base_path, r.file_path): r.group_size for r in manifest.select_best(scope).collect()}
    assert best == {("/b", "b"): 5, ("/a", "other"): 1}
    # the repeated best row is neither pruned nor unselected
    assert paths_of(actions.prune_plan(scope)) == ["a", "z", "z"]
    assert paths_of(manifest.unselected(scope)) == ["a", "z", "z"]
    row = manifest.select_summary(scope).first()
    assert (row.selected_size, row.unselected_size, row.to_delete) == ("8 B", "3 B", 3)


def test_view_groups_by_major_type(man):
    rows = man(
        ("h", T1, 1, "image/png", "/b", "1"), ("h", T0, 1, "image/gif", "/b", "2"), ("h", T0, 1, "text/plain", "/b", "3"),
    )
    groups = {r.major_type: (r.group_count, r.full_mime) for r in manifest.duplicate_groups(rows).collect()}
    assert groups == {"image": (2, "image/gif"), "text": (1, "text/plain")}
    listed = manifest.group_listing(rows, drop_unique=True).collect()
    assert [r.full_path for r in listed] == ["/b/2", "/b/1"]
    assert tuple(manifest.view_summary(rows).first()) == (2, 3)


def test_remove_log(spark, man, inv):
    rows = man(
        ("h", T0, 1, "m/x", "/b", "1"), ("h", T0, 1, "m/x", "/c", "2"), ("h", T0, 1, "m/y", "/c", "3"),
    )
    live = inv(("/b/1", True, True, 1, "2024-01-01 00:00:00", "m/x"))
    targets = spark.createDataFrame([("/b/./1",), ("/none/x",)], "path string")
    log = {(r.status, r.path) for r in manifest.remove_log(rows, targets, live).collect()}
    assert log == {("delete", "/b/1"), ("not_found", "/c/2"), ("no_meta", "/none/x")}
    twice = man(("h", T0, 1, "m/x", "/b", "1"), ("k", T0, 1, "m/x", "/b/.", "1"))
    with pytest.raises(Exception, match="duplicate manifest path"):
        manifest.remove_log(twice, targets, live).collect()


def test_expand_targets(spark, inv):
    live = inv(*[(p, p != "/d/pipe", True, 1, "2024-01-01 00:00:00", "m/x") for p in
                 ["/d/a", "/d/sub/b", "/dx/c", "/d/pipe", "/e"]])
    targets = spark.createDataFrame([("/d/",), ("/e",), ("/d/sub",)], "path string")
    assert sorted(r.path for r in manifest.expand_targets(targets, live).collect()) == ["/d/a", "/d/sub/b", "/e"]


@pytest.mark.parametrize("ranges", [1, 7])
def test_targets_of_any_name_and_depth(spark, inv, ranges):
    rng = random.Random(8)
    letters = ["a", "b", "-", ".x", " ", "a!", "\x01", "\x02", "\x02a", "é", "\U0001f642"]
    names = lambda: "/" + "/".join(rng.choice(letters) for _ in range(rng.randrange(1, 5)))
    files = sorted({names() for _ in range(600)})
    live = inv(*[(p, True, True, 1, "2024-01-01 00:00:00", "m/x") for p in files])
    for chosen in ([names() for _ in range(25)], ["/a", "/a/a", "/a"], ["/"], ["", None], ["/none"]):
        found = manifest.expand_targets(spark.createDataFrame([(c,) for c in chosen], "path string"), live, ranges)
        expected = [p for p in files if any(c and (p == c or p.startswith(c.rstrip("/") + "/")) for c in chosen)]
        assert sorted(r.path for r in found.collect()) == expected


def test_clean_reports_the_first_failing_rule(man, inv):
    rows = man(
        ("h", T0, 1, "m/x", "/b", "gone"), ("h", T0, 1, "m/x", "/b", "pipe"), ("h", T0, 1, "m/x", "/b", "size"),
        ("h", T0, 1, "m/x", "/b", "time"), ("h", T0, 1, "m/x", "/b", "mime"), ("h", T0, 1, "m/x; q=1", "/b", "same"),
        ("h", "junk", 1, "m/x", "/b", "junk"),
    )
    live = inv(
        ("/b/pipe", False, True, 1, "2024-01-01 00:00:00", "m/x"), ("/b/size", True, True, 2, "2024-01-01 00:00:09", "m/z"),
        ("/b/time", True, True, 1, "2024-01-01 00:00:01", "m/z"), ("/b/mime", True, True, 1, "2024-01-01 00:00:00", "m/z"),
        ("/b/same", True, True, 1, "2024-01-01 00:00:00", "m/x"), ("/b/junk", True, True, 1, "2024-01-01 00:00:00", "m/x"),
    )
    bases = rows.select("base_path").distinct()
    reasons = {r.file_path: r.reason for r in manifest.clean(rows, live, bases, full_check=True).collect()}
    assert reasons == {
        "gone": "file missing", "pipe": "file missing", "size": "size mismatch (meta=1,disk=2)",
        "time": f"timestamp mismatch (meta={T0},disk={T1})", "mime": "mime mismatch (meta=m/x,disk=m/z)", "same": None,
        "junk": f"timestamp mismatch (meta=junk,disk={T0})",
    }
    quick = manifest.clean(rows, live, bases)
    with pytest.raises(ValueError, match="not mounted"):
        manifest.clean(rows, live, bases.where("false"))
    assert {r.file_path for r in quick.where("reason IS NOT NULL").collect()} == {"gone", "pipe"}
    counts = manifest.clean_summary(quick, "base_path").first()
    assert tuple(counts) == ("/b", 7, 5, 2)


def test_summary_skips_only_the_bad_metric(man, spark):
    rows = spark.createDataFrame(
        [("h", T0, "999", "a/b", "/b", "1"), ("h", "2024-13-01T00:00:00", "1x", "a", "/b", "2"), ("k", T1, "1000", "/x", "/b", "3")],
        SCHEMA.replace("bigint", "string"),
    )
    row = manifest.summary(rows).first()
    assert tuple(row) == (3, 2, 1, "33.3%", "0.0 GB", T0, T1)
    assert [tuple(r) for r in manifest.summary_mime(rows).collect()] == [("", 1), ("a", 2)]
    buckets = {r.bucket: r.file_count for r in manifest.summary_size_buckets(rows).collect()}
    assert buckets == {"< 1KB": 1, "KB": 1, "MB": 0, "GB": 0, "TB": 0}
    empty = manifest.summary(rows.limit(0)).first()
    assert (empty.total_entries, empty.duplicated_pct, empty.oldest) == (0, None, None)


def test_copy_plan(man, inv, spark):
    rows = man(
        ("h", T0, 1, "m/x", "/a/b/c", "d/1"), ("k", T0, 1, "m/x", "/a/b", "1"), ("m", T0, 1, "m/x", "/z", "1"),
        ("n", T0, 1, "m/x", "/a/b/c", "2"),
    ).withColumn("last_modified", F.col("last_modified").cast("timestamp_ntz"))
    there = inv(("/out/d/1", True, True, 1, "2024-01-01 00:00:00", "m/x"), ("/out/2", True, True, 5, "2024-01-01 00:00:00", "m/x"))
    got = {r.source_path: (r.dest_path, r.status, r.collides) for r in actions.copy_plan(rows, "/out", there).collect()}
    assert got == {
        "/a/b/c/d/1": ("/out/d/1", "verified", False), "/a/b/1": ("/out/1", "to-copy", True),
        "/z/1": ("/out/1", "to-copy", True), "/a/b/c/2": ("/out/2", "size-mismatch", False),
    }


@pytest.fixture(scope="module")
def small_catalog(spark):
    rows = [
        (1, "a" * 40, "image/png", "2024-01-02", 10, "/v0", "x"), (2, "a" * 40, "image/png", "2024-01-01", 10, "/v1", "x"),
        (3, "a" * 40, "image/gif", "2024-01-01", 10, "/v1", "y"), (4, "b" * 40, "image/png", "2024-01-01", 5, "/nope", "z"),
        (5, "c" * 40, "image/png", "2024-01-01", 5, "/v1", "t"), (6, "c" * 40, "image/png", "2024-01-01", 5, "/v0", "t"),
        (7, "d" * 40, "image/png", "2024-01-01", 5, "/v1", "s"), (8, "d" * 40, "image/png", "2024-01-01", 5, "/v1", "r"),
    ]
    df = spark.createDataFrame(
        rows, "id bigint, hash string, mime_type string, t string, file_size bigint, base_path string, file_path string"
    )
    return as_catalog(df.withColumn("last_modified", F.col("t").cast("timestamp_ntz")))


@pytest.fixture(scope="module")
def small_bases(spark):
    return spark.createDataFrame([("/v0", 10, True), ("/v1", 20, False), ("/empty", 30, True)], BASE_PATHS_SCHEMA)


def test_ranking_ties(small_catalog, small_bases):
    from copyledger.operators.catalog import primary_ids, with_base_paths

    ids = {r.id for r in primary_ids(with_base_paths(small_catalog, small_bases)).collect()}
    # equal time: lower priority wins (6), then lower id (7); MIME type splits groups (3)
    assert ids == {2, 3, 6, 7}
    assert tuple(reports.files_view_summary(small_catalog, small_bases).first()) == (4, 3, 7)


def test_drift_policies(small_catalog, small_bases, inv):
    from copyledger.operators.vault import timestamp_drift

    drift = timestamp_drift(small_catalog, small_bases)
    row = drift.first()
    assert drift.count() == 1 and (row.oldest_id, row.vault_id, row.drift_seconds) == (2, 1, 86400)
    assert actions.drift_fix_plan(drift, "inherit").first().action == "set-timestamp"
    nothing = inv(("/q", True, True, 1, "2024-01-01 00:00:00", "m/x"))
    assert actions.drift_fix_plan(drift, "inherit", nothing).first().action == "vault-file-missing"
    assert actions.drift_fix_plan(drift, "remove-oldest", nothing).first().action == "remove-row"
    with pytest.raises(ValueError):
        actions.drift_fix_plan(drift, "other")


def test_vault_purge_plan_order(spark, inv):
    names = ["/v0", "/v0/in", "/v0x/out", "/gone", "/pipe", "/ro", "/ok"]
    dupes = spark.createDataFrame([(n,) for n in names], "other_full_path string")
    t = "2024-01-01 00:00:00"
    live = inv(("/v0x/out", True, True, 1, t, ""), ("/pipe", False, False, 1, t, ""), ("/ro", True, False, 1, t, ""), ("/ok", True, True, 1, t, ""))
    plan = actions.vault_purge_plan(dupes, live, "/v0")
    assert {r.other_full_path: r.status for r in plan.collect()} == {
        "/v0": "skipped-in-vault", "/v0/in": "skipped-in-vault", "/v0x/out": "would-remove", "/gone": "missing",
        "/pipe": "not-regular", "/ro": "no-permission", "/ok": "would-remove",
    }


def test_updates_last_line_wins(spark, small_catalog):
    fixes = spark.createDataFrame(
        [(3, 1, "2020-01-01"), (9, 1, "2021-01-01"), (4, 2, "2022-01-01"), (1, 77, "2000-01-01")], "line_no bigint, vault_id bigint, t string"
    ).withColumn("primary_last_modified", F.col("t").cast("timestamp_ntz"))
    updated = {r.id: str(r.last_modified)[:4] for r in maintain.update_timestamps(small_catalog, fixes).collect()}
    assert len(updated) == 8 and (updated[1], updated[2], updated[3]) == ("2021", "2022", "2024")


def test_updates_abort_on_an_invalid_time(spark, small_catalog):
    fixes = spark.createDataFrame([(1, 1, None)], "line_no bigint, vault_id bigint, primary_last_modified timestamp_ntz")
    with pytest.raises(Exception, match="invalid timestamp for id 1"):
        maintain.update_timestamps(small_catalog, fixes).collect()


def test_ts_fix_plan_force(spark, inv):
    fixes = spark.createDataFrame([(1, "/a"), (2, "/b")], "vault_id bigint, vault_full_path string")
    live = inv(("/a", True, True, 1, "2024-01-01 00:00:00", ""))
    assert {r.vault_id: r.action for r in actions.ts_fix_plan(fixes, live).collect()} == {1: "update", 2: "skip"}
    assert tuple(actions.ts_fix_counts(actions.ts_fix_plan(fixes, live, force=True)).first()) == (2, 0)


def test_lookup(spark, small_catalog, inv):
    ids = spark.createDataFrame([("1",), ("2",), ("99",), ("x1",), ("1",)], "id string")
    live = inv(("/v0/x", True, True, 1, "2024-01-01 00:00:00", ""))
    got = {r.requested: (r.status, r.size_text) for r in maintain.lookup_by_id(small_catalog, ids, live).collect()}
    assert got == {"1": ("found", "10 B"), "2": ("missing file", "10 B"), "99": ("unknown id", None), "x1": ("unknown id", None)}


def test_seed_base_paths_finds_collisions(spark, small_catalog, small_bases):
    overlay = spark.createDataFrame([("/nope", 20, True)], BASE_PATHS_SCHEMA)
    seeded = maintain.seed_base_paths(small_catalog, small_bases, overlay)
    assert {r.base_path: (r.priority, r.is_vault) for r in seeded.collect()} == {
        "/v0": (10, True), "/v1": (20, False), "/empty": (30, True), "/nope": (20, True),
    }
    shared = quality.duplicate_priority_paths(seeded)
    assert [tuple(r) for r in shared.collect()] == [(20, "/nope"), (20, "/v1")]


def test_checks_are_silent_on_clean_data_and_find_seeded_faults(spark, small_catalog, small_bases):
    registered = small_catalog.where("base_path <> '/nope'")
    used = small_bases.where("base_path <> '/empty'")
    assert {r.problem_count for r in quality.run_checks(registered, used).collect()} == {0}
    found = {r.check_name: r.problem_count for r in quality.run_checks(small_catalog, small_bases).collect()}
    assert {k for k, n in found.items() if n} == {
        "missing_base_paths", "vault_base_paths_without_files", "hashes_not_in_files_view",
    }
    broken = as_catalog(
        small_catalog.limit(0).unionByName(spark.createDataFrame(
            [(1, "A" * 40, "m/x", None, -1, "/v0/", "/x", "", "", ""), (2, None, "m/x", None, None, "/v0", "y", "", "", ""),
             (3, "b" * 39, "m/x", None, 0, "/v0", "y", "", "", "")], small_catalog.schema))
    )
    counts = {r.check_name: r.problem_count for r in quality.run_checks(broken, small_bases).collect()}
    assert counts["invalid_hash_format"] == 3 and counts["negative_or_null_file_size"] == 2
    assert counts["base_or_file_path_slash_issues"] == 1 and counts["duplicate_full_path"] == 1
    assert counts["full_path_mismatch"] == 1 and counts["missing_base_paths"] == 1
    for name in quality.CHECKS:
        assert quality.samples(broken, small_bases, name).count() <= 50
        assert quality.check(broken, small_bases, name).first().problem_count == counts[name]
    assert quality.id_high_water(small_catalog, 9).first().problem_count == 0
    assert quality.id_high_water(small_catalog, 8).first().problem_count == 1


def test_validate_lines(spark):
    good = "a" * 40
    lines = [
        "\t".join([good.upper(), "junk", "+5", "", "", ""]), "\t".join([good[:39], "", " 5", "", "", ""]), "x\ty",
        "\t".join([good, "", "1", "", "", "", ""]),
    ]
    df = spark.createDataFrame([("m", i + 1, v) for i, v in enumerate(lines)], "source string, line_no bigint, value string")
    got = {(r.line_no, r.error, r.found) for r in quality.validate_lines(df).collect()}
    assert got == {(2, "invalid_hash", good[:39]), (2, "invalid_size", " 5"), (3, "column_count", "2"), (4, "column_count", "7")}


def test_validate_manifest_files(spark, tmp_path):
    good = "a" * 40
    path = tmp_path / "m.tsv"
    path.write_text("\t".join([good, "", "1", "", "", ""]) + "\n" + "x\n")
    absent = str(tmp_path / "none.tsv")
    got = {(r.source.rsplit("/", 1)[1], r.line_no, r.error) for r in quality.validate_manifest(spark, [str(path), absent]).collect()}
    assert got == {("m.tsv", 2, "column_count"), ("none.tsv", None, "no_such_file")}
    assert quality.validate_manifest(spark, [absent]).count() == 1
