"""Line deduplication with levelled sorted runs of line hashes."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from copyledger.llm.common import map_arrow, read_table, settled, shuffle_partitions, text_blocks, unused
from copyledger.operators.keyed import join_on_groups

MIN_CHARS, MIN_DOCS = 40, 5
BATCHES, FANOUT = 4, 3
_BLANKS = " \t\n\x0b\x0c\r"


def line_key(line: str, least: int) -> bytes | None:
    """Hash of the stripped line with A-Z lower-cased; None below ``least`` code points."""
    key = line.strip(_BLANKS)
    return xxhash.xxh3_128_digest(key.encode("utf-8", "surrogatepass").lower()) if len(key) >= least else None


def line_keys(docs: DataFrame, least: int) -> DataFrame:
    """(row_key, doc_id, key): the distinct keys of every row of docs (row_key, doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols, texts in text_blocks(batches):
            rows, ids, keys = [], [], []
            for row, doc_id, text in zip(cols["row_key"], cols["doc_id"], texts):
                own = {line_key(line, least) for line in text.split("\n")} - {None}
                rows += [row] * len(own)
                ids += [doc_id] * len(own)
                keys += own
            yield pa.record_batch(
                [pa.array(rows, pa.int64()), pa.array(ids, pa.int64()), pa.array(keys, pa.binary())],
                ["row_key", "doc_id", "key"],
            )

    return docs.select("row_key", "doc_id", "text").transform(map_arrow, run, "row_key long, doc_id long, key binary")


class LineRuns:
    """Runs of (key, n_docs, owner), each a table bucketed and sorted by key.

    A batch is joined against every run bucket by bucket, without moving or
    sorting the run. New runs enter level 0; FANOUT runs of a level are merged
    into one of the next, so there are few of them and each entry is rewritten
    once a level.
    """

    def __init__(self, spark: SparkSession, fanout: int = FANOUT):
        self.spark, self.fanout = spark, fanout
        self.buckets = shuffle_partitions(spark)
        self.levels: list[list[str]] = []

    def names(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def _write(self, rows: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        dealt = rows.select("key", "n_docs", "owner").repartition(self.buckets, "key")
        dealt.write.bucketBy(self.buckets, "key").sortBy("key").saveAsTable(name)
        return name

    def _merged(self, names: list[str]) -> DataFrame:
        """Sorted runs merged by key, bucket by bucket. Not a union: its bucketed
        inputs would be taken as dealt by key after they are no longer."""
        rows = self.spark.table(names[0])
        for name in names[1:]:
            other = self.spark.table(name).select("key", F.col("n_docs").alias("n"), F.col("owner").alias("o"))
            rows = rows.join(other, "key", "full").select(
                "key",
                (F.coalesce("n_docs", F.lit(0)) + F.coalesce("n", F.lit(0))).alias("n_docs"),
                F.greatest("owner", "o").alias("owner"),
            )
        return rows

    def add(self, batch: DataFrame) -> None:
        """Add (key, n_docs, owner), one row per key. Only a key that no run holds
        keeps its owner, so owners come from the earliest batch."""
        batch = settled(batch)
        fresh = batch
        for name in self.names():
            fresh = fresh.join(self.spark.table(name).select("key"), "key", "left_anti")
        counts = batch.select("key", "n_docs", F.lit(None).cast("long").alias("owner"))
        owners = fresh.select("key", F.lit(0).cast("long").alias("n_docs"), "owner")
        both = counts.unionByName(owners).groupBy("key").agg(F.sum("n_docs").alias("n_docs"), F.max("owner").alias("owner"))
        self._enter(0, self._write(both))

    def _enter(self, level: int, name: str) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)
        if len(self.levels[level]) >= self.fanout:
            names, self.levels[level] = self.levels[level], []
            merged = self._write(self._merged(names))
            self._drop(names)
            self._enter(level + 1, merged)

    def total(self) -> DataFrame | None:
        return self._merged(self.names()) if self.names() else None

    def _drop(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def clear(self) -> None:
        self._drop(self.names())
        self.levels = []


_REBUILT = T.StructType(
    [
        T.StructField("text", T.StringType()),
        T.StructField("n_lines", T.LongType()),
        T.StructField("n_dropped", T.LongType()),
    ]
)


@F.arrow_udf(_REBUILT)
def _rebuilt(texts: pa.Array, drops: pa.Array, least: pa.Array) -> pa.Array:
    kept, lines, dropped = [], [], []
    for text, gone, chars in zip(texts, drops.to_pylist(), least.to_pylist()):
        parts = (text.as_py() or "").split("\n")
        lines.append(len(parts))
        if gone:
            gone = set(gone)
            parts = [p for p in parts if line_key(p, chars) not in gone]
        dropped.append(lines[-1] - len(parts))
        kept.append("\n".join(parts))
    return pa.StructArray.from_arrays(
        [pa.array(kept, pa.string()), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())],
        ["text", "n_lines", "n_dropped"],
    )


def dedup_lines(
    docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES
) -> DataFrame:
    """``docs`` with ``text`` rebuilt from the lines that stay, and n_lines, n_dropped.

    Lines end at \\n. A line's key is the line without white space around it,
    A-Z lower-cased. Keys of at least ``min_chars`` code points in at least
    ``min_docs`` documents lose all lines except in the largest doc_id.

    Documents arrive in ``batches`` of falling doc_id. Each batch is reduced to
    its keys, anti-joined with the sorted runs of the earlier ones, so that the
    first batch with a key names its owner, and added as a run of its own.

    Null or empty text is one empty line and comes back as an empty text. Rows
    with the same doc_id count once; a null doc_id counts for nothing and owns
    nothing, but its lines are judged. Other columns are kept; columns named
    n_lines or n_dropped are replaced.
    """
    spark = docs.sparkSession
    columns = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    row_key, drop, new = unused(columns, "_row_key", "_drops", "_new")
    keyed = docs.select(*columns, F.xxhash64("doc_id", "text").alias(row_key))
    lines = settled(line_keys(keyed.select("doc_id", "text", F.col(row_key).alias("row_key")), min_chars))

    cuts = lines.agg(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)], 1000)).first()[0]
    runs = LineRuns(spark)
    upper = None
    for lower in [*sorted(set(cuts or []), reverse=True), None]:
        part = lines.where("doc_id is not null")
        if lower is not None:
            part = part.where(F.col("doc_id") >= lower)
        if upper is not None:
            part = part.where(F.col("doc_id") < upper)
        counted = part.select("key", "doc_id").distinct().groupBy("key")
        runs.add(counted.agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("owner")))
        upper = lower
    frequent = settled(runs.total().where(F.col("n_docs") >= min_docs).select("key", "owner"))
    runs.clear()

    drops = (
        join_on_groups(lines, frequent, ["key"])
        .where("doc_id is null or doc_id <> owner")
        .select("row_key", "key")
        .groupBy(F.col("row_key").alias(row_key))
        .agg(F.collect_set("key").alias(drop))
    )
    rebuilt = keyed.join(drops, row_key, "left").withColumn(new, _rebuilt("text", drop, F.lit(min_chars)))
    text = {"text": F.col(f"{new}.text").alias("text")}
    return rebuilt.select(*[text.get(c, F.col(c)) for c in columns], f"{new}.n_lines", f"{new}.n_dropped")


def op2_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP2_SQL = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents
), keyed AS (
  SELECT doc_id, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), frequent AS (
  SELECT key, max(doc_id) AS owner FROM keyed WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), numbered AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts,
    unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS n FROM documents
), judged AS (
  SELECT n.doc_id, n.n, n.parts[n.n] AS line, f.key IS NOT NULL AND n.doc_id <> f.owner AS gone
  FROM numbered n LEFT JOIN frequent f
    ON f.key = translate(trim(n.parts[n.n], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Frequent lines removed; ``n_chars`` follows the new text."""
    rows = dedup_lines(docs).drop("n_lines", "n_dropped")
    return rows.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)
