"""Loading manifest files as they arrive.

Each micro-batch becomes one folder of the catalog. A batch that is run again
after a failure overwrites its own folder and sees only earlier ones, so rows
and ids come out the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from copyledger.schema import CATALOG_COLUMNS, CATALOG_SCHEMA, as_catalog
from copyledger.session import existing_paths
from copyledger.sources.load import assign_ids, next_id, typed_rows

_STORED = CATALOG_SCHEMA.simpleString()[len("struct<"):-1].replace(":", " ") + ", batch bigint"


def read_loaded(spark: SparkSession, catalog_dir: str) -> DataFrame:
    """The catalog written so far, with the batch each row came in."""
    return spark.read.schema(_STORED).parquet(catalog_dir)


def _append(batch: DataFrame, batch_id: int, catalog_dir: str) -> None:
    spark = batch.sparkSession
    # The rules of a batch load: what that refuses, no stream takes in.
    bad = [r["line"] for r in batch.where("_broken").select("line").limit(5).collect()]
    if bad:
        raise ValueError(f"invalid manifest lines: {bad}")
    rows = as_catalog(batch.drop("_broken", "line").withColumn("id", F.lit(None).cast("bigint"))).drop("id")
    if batch_id == 0:
        earlier = spark.createDataFrame([], _STORED)
    else:
        earlier = read_loaded(spark, catalog_dir).where(F.col("batch") < batch_id)
    repeated = rows.groupBy("full_path").count().where("count > 1").select("full_path")
    # The batch is broadcast when small, so the catalog is scanned, not shuffled.
    taken = earlier.select("full_path").join(rows.select("full_path"), "full_path", "left_semi")
    clashes = [r["full_path"] for r in repeated.unionByName(taken).limit(5).collect()]
    if clashes:
        raise ValueError(f"full paths already in the catalog: {clashes}")
    # Marks of this batch, from a run that failed later, are not looked at.
    marks = f"{catalog_dir.rstrip('/')}.next_id"
    first = next_id(earlier)
    if existing_paths(spark, [marks]):
        known = spark.read.schema("next_id bigint, batch bigint").parquet(marks)
        first = max(first, known.where(F.col("batch") < batch_id).agg(F.max("next_id")).first()[0] or first)
    numbered = assign_ids(rows, first).select(*CATALOG_COLUMNS)
    folder = f"{catalog_dir.rstrip('/')}/batch={batch_id}"
    numbered.write.mode("overwrite").parquet(folder)
    taken_ids = spark.read.schema(CATALOG_SCHEMA).parquet(folder).agg((F.max("id") + 1).alias("next_id"))
    mark = taken_ids.where("next_id is not null").withColumn("batch", F.lit(batch_id).cast("bigint"))
    mark.write.mode("append").parquet(marks)


def load_stream(spark: SparkSession, manifests: str, catalog_dir: str, checkpoint: str) -> StreamingQuery:
    """Load every manifest file below ``manifests`` that was not loaded yet,
    then stop. A malformed line or a full path that is taken fails the batch."""
    lines = spark.readStream.schema("value string").text(manifests)
    return (
        typed_rows(lines.select("value", F.col("value").alias("line")))
        .writeStream.foreachBatch(lambda batch, batch_id: _append(batch, batch_id, catalog_dir))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
