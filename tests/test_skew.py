"""Hot keys: results stay exact and the work is split."""

import random

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from copyledger.operators import catalog as c
from copyledger.operators import keyed, manifest, vault
from copyledger.operators.manifest import select_best, select_flagged
from copyledger.schema import BASE_PATHS_SCHEMA, as_catalog

HOT = "a" * 40


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows share one hash, and many of those one time."""
    rnd = random.Random(7)
    rows = []
    for i in range(6000):
        hot = i % 3 == 0
        digest = HOT if hot else f"{rnd.randrange(900):04x}" * 10
        second = 0 if hot and i % 2 else rnd.randrange(40)
        rows.append((i + 1, digest, "image/png", f"2024-01-01 00:00:{second:02d}", i, f"/v{i % 4}", f"f{i}"))
    df = spark.createDataFrame(
        rows, "id bigint, hash string, mime_type string, t string, file_size bigint, base_path string, file_path string"
    )
    return as_catalog(df.withColumn("last_modified", F.col("t").cast("timestamp_ntz")).drop("t")).cache()


@pytest.fixture(scope="module")
def bases(spark):
    return spark.createDataFrame(
        [("/v0", 40, True), ("/v1", 30, True), ("/v2", 20, False)], BASE_PATHS_SCHEMA
    )


def windowed(catalog, bases):
    """The plain window formulation, as brute force."""
    rows = catalog.join(bases, "base_path")
    part = W.partitionBy("hash", "mime_type")
    return rows.select(
        "id",
        F.row_number().over(part.orderBy("last_modified", "priority", "id")).alias("rn"),
        F.count(F.lit(1)).over(part).alias("n"),
        F.dense_rank().over(W.orderBy("hash", "mime_type")).alias("g"),
    )


def as_set(df, *columns):
    rows = [tuple(r) for r in df.select(*columns).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("ranges", [None, 1, 50, 1000])
def test_rank_in_group(skewed, bases, ranges):
    got = c.rank_in_group(skewed, bases, ranges=ranges)
    assert as_set(got, "id", "rn") == as_set(windowed(skewed, bases), "id", "rn")


def test_rank_in_key_with_null_keys_and_a_split_hot_key(spark):
    key = F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 3 == 1, F.col("id").cast("string"))
    rows = spark.range(3000).select("id", key.alias("k"))
    ranked = keyed.rank_in_key(rows, ["k"], ["id"], ranges=40)
    expected = rows.withColumn("rn", F.row_number().over(W.partitionBy("k").orderBy("id")))
    assert as_set(ranked, "k", "id", "rn") == as_set(expected, "k", "id", "rn")
    assert keyed.rank_in_key(rows.where("id < 0"), ["k"], ["id"]).count() == 0


def test_files_equals_window_form(skewed, bases, spark):
    mc = spark.createDataFrame([("image/png", "image")], "mime_type string, category string")
    expected = {(i, g, "primary" if rn == 1 else "redundant") for i, rn, n, g in as_set(
        windowed(skewed, bases), "id", "rn", "n", "g")}
    assert as_set(c.files(skewed, bases, mc), "id", "group_num", "disposition") == expected
    any_shape = c.files(skewed, bases, mc, digests=False)
    assert as_set(any_shape, "id", "group_num", "disposition") == expected
    plain = as_set(c.files(skewed, bases, mc, with_group_num=False), "id", "disposition")
    assert plain == {(i, d) for i, _, d in expected}
    assert as_set(c.files_primary(skewed, bases, mc), "id") == {(i,) for i, d in plain if d == "primary"}
    assert as_set(c.files_redundant(skewed, bases, mc), "id") == {(i,) for i, d in plain if d == "redundant"}


def test_group_size(skewed, bases):
    expected = as_set(windowed(skewed, bases), "id", "n")
    assert as_set(c.group_size(skewed, bases), "id", "grp_size") == expected


@pytest.fixture
def tight(spark):
    """Thresholds under which a few hundred rows already count as skew."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2KB",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_hot_group_joins_are_split(spark, tight, skewed, bases, final_plan):
    spread = skewed.repartition(8, "id")
    mc = spark.createDataFrame([("image/png", "image")], "mime_type string, category string")
    half = spread.where("id % 2 = 0")
    for df in (
        c.files(spread, bases, mc),
        c.group_size(spread, bases),
        manifest.intersect(spread, half),
        manifest.purge_split(half, spread),
        select_flagged(spread),
        manifest.group_listing(spread),
        vault.vault_dupes(spread, bases, "/v1"),
    ):
        assert "SortMergeJoin(skew=true)" in final_plan(df)


def test_large_base_path_table_is_joined_by_shuffle(spark, tight, skewed, bases, final_plan):
    """One base path holds half of the rows and the table is too long to broadcast."""
    expected = as_set(c.with_base_paths(skewed, bases), "id", "priority")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    many = bases.unionByName(
        spark.range(100).select(
            F.concat(F.lit("/other"), F.col("id")).alias("base_path"),
            (F.col("id") + 1000).cast("int").alias("priority"),
            F.lit(False).alias("is_vault"),
        )
    )
    hot = skewed.repartition(8, "id")
    joined = c.with_base_paths(hot, many)
    plan = final_plan(joined)
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin(skew=true)" in plan and "BroadcastHashJoin" not in plan
    assert as_set(joined, "id", "priority") == expected


def test_primaries_are_limited_before_the_shuffle(skewed, bases, spark, final_plan):
    mc = spark.createDataFrame([("image/png", "image")], "mime_type string, category string")
    plan = final_plan(c.files_primary(skewed, bases, mc))
    assert plan.count("WindowGroupLimit") == 2


def test_only_bucket_sizes_meet_in_one_task(skewed, bases, final_plan):
    plan = final_plan(c.group_num(skewed, F.broadcast(bases)))
    assert plan.count("Exchange SinglePartition") == 1
    # what arrives there is one row per bucket, and the group shuffle is reused
    below = plan[plan.index("Exchange SinglePartition"):].splitlines()[1]
    assert "_bucket" in below and "Aggregate" in below
    assert "ReusedExchange" in plan


@pytest.mark.parametrize("start", [1, 1000001])
def test_dense_number(spark, start):
    rnd = random.Random(3)
    values = {f"{rnd.randrange(16**8):08x}" for _ in range(3000)} | {"", "zz", "0!", "Abc", "é"}
    df = spark.createDataFrame([(v,) for v in values], "h string").repartition(7)
    got = {r["h"]: r["n"] for r in keyed.dense_number(df, keyed.hex_bucket("h"), ["h"], "n", start).collect()}
    assert got == {v: i + start for i, v in enumerate(sorted(values, key=lambda v: v.encode()))}
    ranged = {r["h"]: r["n"] for r in keyed.range_number(df, ["h"], "n", start).collect()}
    assert ranged == got


def test_vault_questions_against_brute_force(skewed, bases):
    rows = [r.asDict() for r in skewed.join(bases, "base_path").collect()]
    groups = {}
    for r in rows:
        groups.setdefault((r["hash"], r["mime_type"]), []).append(r)
    primaries = {k: min(g, key=lambda r: (r["last_modified"], r["priority"], r["id"])) for k, g in groups.items()}
    dupes = {
        r["full_path"] for k, g in groups.items() if primaries[k]["base_path"] == "/v1"
        for r in g if r["base_path"] != "/v1"
    }
    assert as_set(vault.vault_dupes(skewed, bases, "/v1"), "other_full_path") == {(p,) for p in dupes}
    drift = set()
    for k, g in groups.items():
        vaulted = [r for r in g if r["is_vault"]]
        if vaulted and not primaries[k]["is_vault"]:
            pick = min(vaulted, key=lambda r: (r["priority"], r["id"]))
            if pick["last_modified"] > primaries[k]["last_modified"]:
                drift.add((primaries[k]["id"], pick["id"]))
    assert drift and as_set(vault.timestamp_drift(skewed, bases), "oldest_id", "vault_id") == drift


def test_selection_against_brute_force(skewed):
    scope = skewed.select("hash", "last_modified", "file_size", "mime_type", "base_path", "file_path")
    groups = {}
    for r in scope.collect():
        groups.setdefault((r.hash, r.mime_type), []).append(r)
    best = set()
    for members in groups.values():
        oldest = min(m.last_modified for m in members)
        top = max((m.base_path, m.file_path) for m in members if m.last_modified == oldest)
        best.add((*top, len(members)))
    assert as_set(select_best(scope), "base_path", "file_path", "group_size") == best
    flagged = as_set(select_flagged(scope).where("is_best"), "base_path", "file_path")
    assert flagged == {b[:2] for b in best}


def test_null_keys_form_groups(spark, bases):
    """Catalogs from elsewhere may hold rows without a hash or type; both forms of
    ``files`` keep them, grouped as nulls."""
    rows = [(i, None if i % 3 == 0 else HOT, None if i % 2 else "image/png", i % 4, f"/v{i % 4}", f"f{i}") for i in range(1, 60)]
    df = spark.createDataFrame(rows, "id bigint, hash string, mime_type string, s int, base_path string, file_path string")
    times = F.timestamp_seconds(F.col("s") + 1_700_000_000).cast("timestamp_ntz")
    table = as_catalog(df.withColumn("last_modified", times).withColumn("file_size", F.col("id")))
    mc = spark.createDataFrame([("image/png", "image")], "mime_type string, category string")
    expected = {(i, "primary" if rn == 1 else "redundant") for i, rn in as_set(windowed(table, bases), "id", "rn")}
    assert as_set(c.files(table, bases, mc, with_group_num=False), "id", "disposition") == expected
    for digests in (True, False):
        numbered = as_set(c.files(table, bases, mc, digests=digests), "id", "disposition", "group_num")
        assert {(i, d) for i, d, _ in numbered} == expected
        assert {g for *_, g in numbered} == {1, 2, 3, 4}
    assert as_set(c.group_size(table, bases), "id", "grp_size") == as_set(windowed(table, bases), "id", "n")


def test_best_rows_by_plain_descending_order(spark):
    rows = [(h, t, s, "a/b", b, f) for h in ("x", None) for t in ("1", "2", None) for s in (1, None)
            for b in ("", "b", "ba", "é", None) for f in ("z", "z/", None)]
    scope = spark.createDataFrame(
        rows, "hash string, last_modified string, file_size bigint, mime_type string, base_path string, file_path string"
    ).repartition(5)
    for best in select_best(scope).collect():
        assert best.group_size == 90
        assert tuple(best)[1:6] == (None, None, "a/b", None, None)
    plain = select_best(scope.na.drop()).collect()
    assert [tuple(r) for r in plain] == [("x", "1", 1, "a/b", "é", "z/", 16)]
