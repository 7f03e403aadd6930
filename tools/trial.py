"""Time catalog operators on generated rows, a third of them in one content group:
python tools/trial.py folder [million rows] [bucketed] [operator ...]. The rows are kept in
``folder`` and used again."""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from copyledger.operators import catalog, vault
from copyledger.operators.bucketed import all_rows
from copyledger.plans import reports
from copyledger.schema import as_catalog
from copyledger.session import configure, literal_table
from copyledger.sources.bucketed import open_bucketed, write_bucketed


def generated(spark: SparkSession, rows: int):
    """A third of the rows in one group; the others in groups of about three copies."""
    i = F.col("id")
    content = F.when(i % 3 == 0, F.lit(-1)).otherwise(F.pmod(F.xxhash64("id"), F.lit(max(rows * 2 // 9, 1))))
    seconds = F.pmod(F.xxhash64(i, F.lit(1)), F.lit(10_000_000))
    return as_catalog(spark.range(0, rows, 1, 32).select(
        "id",
        F.sha1(content.cast("string").cast("binary")).alias("hash"),
        F.when(i % 3 == 0, "text/plain").when(content % 2 == 0, "image/png").otherwise("video/mp4").alias("mime_type"),
        F.timestamp_seconds(seconds + 1_700_000_000).cast("timestamp_ntz").alias("last_modified"),
        (i % 100_000).alias("file_size"),
        F.concat(F.lit("/vol/v"), (F.xxhash64("id", F.lit(2)) % 5).cast("string")).alias("base_path"),
        F.concat(F.lit("folder/of/files/"), i.cast("string"), F.lit(".dat")).alias("file_path"),
    ))


def main(folder: str, millions: str = "10", *wanted: str) -> None:
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", "64")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    configure(spark)
    path = f"{folder}/catalog-{millions}m"
    if not os.path.exists(f"{path}/_SUCCESS"):
        generated(spark, int(float(millions) * 1_000_000)).write.parquet(path)
    rows = spark.read.parquet(path)
    if "bucketed" in wanted:
        wanted = tuple(w for w in wanted if w != "bucketed")
        if os.path.exists(f"{path}-bucketed/layout/_SUCCESS"):
            rows = open_bucketed(spark, f"{path}-bucketed", "trial")
        else:
            start = time.perf_counter()
            rows = write_bucketed(rows, f"{path}-bucketed", "trial", 64)
            print(json.dumps({"write_bucketed": round(time.perf_counter() - start, 1)}))
    bases = literal_table(spark, [(f"/vol/v{n}", 10 * (n + 5), n == 0) for n in range(-4, 5)], ["base_path", "priority", "is_vault"])
    types = literal_table(spark, [("image/png", "image"), ("video/mp4", "video")], ["mime_type", "category"])
    operators = {
        "files_unnumbered": lambda: catalog.files(rows, bases, types, with_group_num=False),
        "files": lambda: catalog.files(rows, bases, types),
        "mime_duplication_summary": lambda: reports.mime_duplication_summary(rows, bases),
        "vault_dupes": lambda: vault.vault_dupes(rows, bases, "/vol/v0"),
        "timestamp_drift": lambda: vault.timestamp_drift(rows, bases),
        "oldest_and_vault_pick": lambda: vault.oldest_and_vault_pick(rows, bases),
        "unvaulted_primaries": lambda: vault.unvaulted_primaries(rows, bases, types, "/vol/v0"),
    }
    all_rows(rows).write.format("noop").mode("overwrite").save()  # files into memory
    took = {}
    for name in wanted or operators:
        times = []
        for _ in range(2):
            start = time.perf_counter()
            operators[name]().write.format("noop").mode("overwrite").save()
            times.append(round(time.perf_counter() - start, 1))
        took[name] = min(times)
    print(json.dumps({"rows": all_rows(rows).count(), "seconds": took}))


if __name__ == "__main__":
    main(*sys.argv[1:])
