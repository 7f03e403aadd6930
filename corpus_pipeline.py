"""From raw documents to packed training sequences."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from copyledger.llm.common import disposable, importable, read_table
from copyledger.llm.lines import line_stage
from copyledger.llm.minhash import minhash_stage
from copyledger.llm.packing import packing_stage
from copyledger.llm.quality import quality_stage
from copyledger.llm.substrings import substring_stage
from copyledger.session import scratch_path

STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_stage),
    ("lines", line_stage),
    ("minhash", minhash_stage),
    ("substrings", substring_stage),
    ("packing", packing_stage),
]

# The fitted classifier, sketches and packing have no SQL; tests/llm compares the
# stages with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is written to the shared folder and read
    back as input of the next. What a stage settled on its way goes once it is written."""
    importable(spark)
    docs = read_table(spark, sf_dir, "documents")
    folder = scratch_path(spark, "pipeline")
    for name, stage in STAGES:
        path = f"{folder}/{name}"
        with disposable(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
