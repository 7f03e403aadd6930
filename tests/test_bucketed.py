"""Bucketed catalogs: the same answers, without a shuffle of the rows."""

import pytest
from pyspark.sql import functions as F

from copyledger.operators import catalog as c
from copyledger.operators import vault
from copyledger.operators.bucketed import BucketedCatalog, all_rows
from copyledger.plans import reports
from copyledger.registry import tables
from copyledger.sources.bucketed import open_bucketed, write_bucketed


@pytest.fixture(scope="module")
def parts(spark, sf, tmp_path_factory):
    """A catalog with null keys, plain and bucketed, one large group kept apart."""
    i = F.col("id")
    plain = tables.catalog(spark, sf)
    hot = plain.where(i % 3 == 0).withColumns({"hash": F.lit("f" * 40), "mime_type": F.lit("image/png")})
    rest = plain.where(i % 3 != 0).withColumn("hash", F.when(i % 7 != 0, F.col("hash")))
    rows = hot.unionByName(rest)
    path = str(tmp_path_factory.mktemp("stored")) + "/it's"
    rows.write.parquet(f"{path}-rows")
    rows = spark.read.parquet(f"{path}-rows")
    return rows, write_bucketed(rows, path, "bucketed_test", 4, crowded_rows=50), path


def rows_of(df):
    return sorted(map(str, df.collect()))


def test_same_answers(spark, parts):
    rows, stored, _ = parts
    bp, mc = tables.base_paths(spark), tables.categories(spark)
    assert rows_of(all_rows(stored)) == rows_of(rows)
    assert 0 < stored.crowded.count() < rows.count()
    for question in [
        lambda x: c.files(x, bp, mc, with_group_num=False),
        lambda x: c.files(x, bp, mc),
        lambda x: c.files_primary(x, bp, mc),
        lambda x: c.files_redundant(x, bp, mc),
        lambda x: c.group_size(x, bp).select("id", "grp_size"),
        lambda x: vault.vault_dupes(x, bp, tables.VAULT, full=True),
        lambda x: vault.vault_dupes(x, bp, tables.VAULT, mime_prefix="image"),
        lambda x: vault.oldest_and_vault_pick(x, bp),
        lambda x: vault.timestamp_drift(x, bp),
        lambda x: reports.mime_duplication_summary(x, bp),
        lambda x: reports.redundant_by_mime(x, bp, by_hash=True),
        lambda x: reports.category_sizes(x, bp, mc),
        lambda x: reports.files_view_summary(x, bp),
    ]:
        assert rows_of(question(stored)) == rows_of(question(rows))


def test_opened_again(spark, parts):
    rows, stored, path = parts
    again = open_bucketed(spark, path, "bucketed_test_again")
    assert rows_of(all_rows(again)) == rows_of(rows)
    assert "Exchange" not in plan(spark, c.copy_groups(visible(spark, again)))


def visible(spark, stored):
    return c.with_base_paths(stored.spread.where("hash IS NOT NULL"), tables.base_paths(spark))


def plan(spark, df):
    text = df._jdf.queryExecution().executedPlan().toString()
    return text.replace("BroadcastExchange", "")


def test_groups_without_a_shuffle(spark, parts):
    rows, stored, _ = parts
    bp = tables.base_paths(spark)
    assert "Exchange" in plan(spark, c.copy_groups(c.with_base_paths(rows, bp)))
    only = BucketedCatalog(stored.spread.where("hash IS NOT NULL"), stored.crowded.where("false"))
    assert "Exchange" not in plan(spark, c.copy_groups(visible(spark, stored)))
    assert "Exchange" not in plan(spark, c.top_per_key(visible(spark, stored), c.GROUP_KEYS, [F.col("id")]))
    assert "Exchange" not in plan(spark, vault._picks(visible(spark, stored)))
    assert "Exchange" not in plan(spark, c.join_on_groups(
        visible(spark, stored), c.copy_groups(visible(spark, stored)), c.GROUP_KEYS, in_place=True))
    # One shuffle is left, of sums per type and part.
    summary = plan(spark, reports.mime_duplication_summary(only, bp))
    assert "hashpartitioning(hash" not in summary.split("Union")[0]
