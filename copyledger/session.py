"""Session helpers."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


PARTITION_BYTES = 128 * 1024 * 1024


def configure(spark: SparkSession, input_bytes: int | None = None) -> SparkSession:
    """Session settings the operators are written for.

    Adaptive execution splits hot partitions and merges small ones, so with
    ``input_bytes`` the shuffle starts from partitions that fit in memory
    (200 at least) and shrinks where little data arrives.
    """
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(PARTITION_BYTES),
        # join_on_groups relies on joins being shuffled on all of their keys.
        "spark.sql.requireAllClusterKeysForCoPartition": "true",
    }
    if input_bytes is not None:
        settings["spark.sql.shuffle.partitions"] = str(max(input_bytes // PARTITION_BYTES, 200))
    for key, value in settings.items():
        spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor can reach, for checkpoints and exchange files.

    The cluster names it in ``spark.checkpoint.dir``. Only where nothing is
    configured and the session is local (tests) a fresh temporary folder is
    used; elsewhere that is an error, as executors would not share it.
    """
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="copyledger-"))
    return sc.getCheckpointDir()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new, not yet existing path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/copyledger/{label}-{uuid.uuid4().hex}"


def literal_table(spark: SparkSession, rows: list[tuple], columns: list[str]) -> DataFrame:
    """A few constant rows as an inline table of one partition."""
    structs = [F.struct(*[F.lit(v).alias(c) for c, v in zip(columns, row)]) for row in rows]
    return spark.range(0, 1, 1, 1).select(F.inline(F.array(*structs)))


def without_file_scheme(uri: str) -> str:
    """Local files without their scheme, whose slashes Spark and Hadoop write
    differently; other locations unchanged."""
    return re.sub(r"\Afile:/+", "/", uri)


def existing_paths(spark: SparkSession, paths: Sequence[str]) -> dict[str, str]:
    """Qualified location of every path that exists, in argument order."""
    conf = spark._jsc.hadoopConfiguration()
    found = {}
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        fs = path.getFileSystem(conf)
        if fs.exists(path):
            found[p] = without_file_scheme(fs.makeQualified(path).toUri().toString())
    return found
