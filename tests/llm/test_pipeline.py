"""The registered queries and the pipeline as a whole."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from copyledger.llm import queries
from copyledger.session import shared_dir


def test_entry_lists_everything():
    names = set(entry.queries())
    assert set(queries.QUERIES) | {"pipeline"} <= names
    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{i}" for i in range(1, 14)}


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for table in ("documents", "pages"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    expected = con.execute(queries.ORACLES[name]).df()
    got = queries.QUERIES[name](spark, sf).toPandas()[list(expected.columns)]
    order = lambda df: df.sort_values(list(expected.columns)).astype(str).to_numpy().tolist()
    assert order(got) == order(expected)


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    packed = corpus_pipeline.run(spark, sf).collect()
    kept = {r.doc_id for r in packed}
    assert 0.6 * docs.count() < len(kept) < docs.count()
    assert kept <= {r.doc_id for r in docs.select("doc_id").collect()}
    good = spark.read.parquet(f"{sf}/labels.parquet").where("quality = 0").select("doc_id").collect()
    assert len(kept & {r.doc_id for r in good}) <= 0.2 * len(good)


NAMES = ["row_key", "_row_key", "__row_key", "_doc", "doc", "_drops", "_ends", "_new", "key", "keep", "owner", "leader", "bucket"]


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES[:4]], ids=lambda s: s.__name__)
def test_stages_keep_columns_of_any_name(spark, sf, stage):
    """Columns that bear the names of a stage's own come through with their values."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(40)
    named = docs.select("*", *[F.concat(F.lit(f"{n} of "), "doc_id").alias(n) for n in NAMES])
    rows = stage(spark, named, sf).collect()
    assert rows and rows[0].__fields__ == named.columns
    assert all(r[n] == f"{n} of {r.doc_id}" for r in rows for n in NAMES)


def test_run_leaves_only_stages(spark, sf):
    folder = shared_dir(spark)
    before = set(os.listdir(f"{folder}/copyledger")) if os.path.isdir(f"{folder}/copyledger") else set()
    corpus_pipeline.run(spark, sf)
    left = {n.split("-")[0] for n in set(os.listdir(f"{folder}/copyledger")) - before}
    assert left == {"pipeline"}
