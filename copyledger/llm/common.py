"""Helpers the operators of this subpackage share."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable, Iterator, Sequence
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import copyledger
from copyledger.session import scratch_path

# Text that one step of a task works on at a time, in characters.
BLOCK_CHARS = 4_000_000


def importable(spark: SparkSession) -> None:
    """Lets Python workers of a local session import this package from where the
    driver has it; on a cluster it is deployed with the job."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(copyledger.__file__)))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_arrow(df: DataFrame, function: Callable, schema: str) -> DataFrame:
    """``mapInArrow`` whose workers can import this package."""
    importable(df.sparkSession)
    return df.mapInArrow(function, schema)


def settled(df: DataFrame) -> DataFrame:
    """``df`` written as a Parquet table to the shared folder and read back, so that
    later steps neither repeat its work nor depend on lost executors, and read
    only the columns they need in as many tasks as its size asks for."""
    path = scratch_path(df.sparkSession, "settled")
    if _DISPOSABLE:
        _DISPOSABLE[-1].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_DISPOSABLE: list[list[str]] = []


@contextmanager
def disposable(spark: SparkSession) -> Iterator[None]:
    """Deletes, at its end, the tables that were settled within; what was made from
    them has to be written by then."""
    _DISPOSABLE.append([])
    try:
        yield
    finally:
        for path in _DISPOSABLE.pop():
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def unused(columns: Sequence[str], *names: str) -> list[str]:
    """``names``, lengthened until none of ``columns`` is called so."""
    taken = {c.lower() for c in columns}
    free = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        free.append(name)
        taken.add(name.lower())
    return free


def join_on_digest(rows: DataFrame, groups: DataFrame, key: str) -> DataFrame:
    """``join_on_groups`` for one long ``key`` that is a hash itself: inputs are
    shuffled for the join, so a hot key can be split, without a second hash in
    every row."""
    renamed = groups.withColumnRenamed(key, "_digest")
    return rows.join(renamed, F.col(key).bitwiseXOR(F.lit(1)) == F.col("_digest").bitwiseXOR(F.lit(1))).drop("_digest")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_blocks(batches: Iterable[pa.RecordBatch], text: str = "text") -> Iterator[tuple[dict[str, list], list[str]]]:
    """Columns and texts (null as empty) of consecutive rows, at most about
    BLOCK_CHARS characters at a time; a longer text makes a block of its own."""
    for batch in batches:
        columns = {name: batch.column(i).to_pylist() for i, name in enumerate(batch.schema.names)}
        texts = [t or "" for t in columns.pop(text)]
        start, size = 0, 0
        for i, t in enumerate(texts):
            if i > start and size + len(t) > BLOCK_CHARS:
                yield {k: v[start:i] for k, v in columns.items()}, texts[start:i]
                start, size = i, 0
            size += len(t)
        if start < len(texts):
            yield {k: v[start:] for k, v in columns.items()}, texts[start:]
