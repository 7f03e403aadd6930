"""Nearest vectors by cosine through an inverted multi-index."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from copyledger.llm.common import importable, map_arrow, read_table, settled
from copyledger.operators.keyed import join_on_groups

NEAREST = 5
QUERY_EVERY = 50
# Centroids of each half, fitted on so many vectors at most.
CENTROIDS = 64
SAMPLE = 20_000
ROUNDS = 10
# Share of the index that a query's cells hold, and vectors they hold at least.
SHARE = 0.45
AT_LEAST = 1_000
# Bytes of vectors that one task compares with as many queries.
BLOCK_BYTES = 8_000_000
# Scores closer than this are computed again in one fixed order of additions.
_SLACK = 1e-9
_CELLS = 1 << 22


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vec_id, size, v): vectors that have a direction, as bytes of doubles."""
    for batch in batches:
        ids, lists = batch.column(0).cast(pa.int64()), batch.column(1)
        length = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        valid = ids.is_valid().to_numpy(zero_copy_only=False) & (length > 0)
        out_rows, out_values = [], []
        for size in np.unique(length[valid]):
            rows = np.flatnonzero(valid & (length == size))
            flat = lists.take(pa.array(rows)).flatten().cast(pa.float64(), safe=False)
            x = flat.fill_null(np.nan).to_numpy(zero_copy_only=False).reshape(-1, size) + 0.0
            good = np.isfinite(x).all(axis=1) & x.any(axis=1)
            out_rows.append(rows[good])
            out_values += [r.tobytes() for r in x[good]]
        rows = np.concatenate([*out_rows, np.empty(0, np.int64)]).astype(np.int64)
        yield pa.record_batch(
            [ids.take(pa.array(rows)), pa.array(length[rows].astype(np.int32)), pa.array(out_values, pa.binary())],
            ["vec_id", "size", "v"],
        )


def matrix(values: pa.Array | pa.ChunkedArray, size: int) -> np.ndarray:
    return np.frombuffer(b"".join(values.to_pylist()), "<f8").reshape(-1, size)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled first, so that no square leaves the doubles."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return (x * x).sum(axis=1)[:, None] - 2 * x @ centroids.T + (centroids * centroids).sum(axis=1)


def fit(x: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = 12) -> np.ndarray:
    """k-means centroids, drawn first from distinct rows; fewer where rows are fewer."""
    x = np.unique(x, axis=0)
    centroids = x[np.random.default_rng(seed).permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        nearest = distances(x, centroids).argmin(axis=1)
        size = np.bincount(nearest, minlength=len(centroids))
        total = np.zeros_like(centroids)
        np.add.at(total, nearest, x)
        centroids = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], centroids)
    return centroids


def halves(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return x[:, : x.shape[1] // 2], x[:, x.shape[1] // 2 :]


def traverse(first: np.ndarray, second: np.ndarray, sizes: np.ndarray, wanted: float) -> Iterator[tuple[int, int]]:
    """Cells (c1, c2) by ascending sum of the two distances, until they hold ``wanted``
    vectors; all cells where there are fewer."""
    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    da, db, sizes = first[a].tolist(), second[b].tolist(), sizes[np.ix_(a, b)].tolist()
    a, b = a.tolist(), b.tolist()
    heap, held = [(da[0] + db[0], 0, 0)], 0
    while heap and held < wanted:
        _, i, j = heapq.heappop(heap)
        if sizes[i][j]:
            held += sizes[i][j]
            yield a[i], b[j]
        # Every pair is reached once: to the right along a row, down its first column.
        if j + 1 < len(db):
            heapq.heappush(heap, (da[i] + db[j + 1], i, j + 1))
        if j == 0 and i + 1 < len(da):
            heapq.heappush(heap, (da[i + 1] + db[0], i + 1, 0))


def _quantised(books: tuple[np.ndarray, np.ndarray], size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = unit(matrix(batch.column("v"), size))
                cells = [distances(h, c).argmin(axis=1).astype(np.int32) for h, c in zip(halves(x), books)]
                yield pa.record_batch([*batch.columns, *map(pa.array, cells)], [*batch.schema.names, "c1", "c2"])

    return run


def _visits(books: tuple[np.ndarray, np.ndarray], size: int, sizes: np.ndarray, wanted: float):
    """Per query and first half's centroid: the second half's centroids to look at,
    as bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            x = unit(matrix(batch.column("v"), size))
            near = [distances(h, c) for h, c in zip(halves(x), books)]
            rows, centroids, bits = [], [], []
            for i in range(len(x)):
                looked = np.zeros(sizes.shape, bool)
                for c1, c2 in traverse(near[0][i], near[1][i], sizes, wanted):
                    looked[c1, c2] = True
                some = np.flatnonzero(looked.any(axis=1))
                rows += [i] * len(some)
                centroids += some.tolist()
                bits += [r.tobytes() for r in np.packbits(looked[some], axis=1)]
            taken = batch.take(pa.array(rows, pa.int64()))
            yield pa.record_batch(
                [*taken.columns, pa.array(centroids, pa.int32()), pa.array(bits, pa.binary())],
                [*batch.schema.names, "c1", "cells"],
            )

    return run


def _compared(size: int, nearest: int):
    """Queries against the vectors of one block: the best of every query."""

    def best(q: np.ndarray, x: np.ndarray, rough: np.ndarray, ids: list[list[int]]) -> list[tuple[float, int]]:
        """First ``nearest`` (score, vec_id) of one query among visited vectors."""
        order = np.argpartition(-rough, nearest - 1)[:nearest] if len(rough) > nearest else np.arange(len(rough))
        close = np.flatnonzero(rough >= rough[order].min() - _SLACK)
        close = close[np.isfinite(rough[close])]
        exact = (x[close] * q).sum(axis=1)
        found = [(-s, i) for s, c in zip(exact.tolist(), close.tolist()) for i in ids[c]]
        return heapq.nsmallest(nearest, found)

    def run(key: tuple, entries: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[tuple[int, int, int, float]] = []
        if entries.num_rows and queries.num_rows:
            x, q = unit(matrix(entries["v"], size)), unit(matrix(queries["v"], size))
            c2, ids = entries["c2"].to_numpy(), entries["ids"].to_pylist()
            bits = np.frombuffer(b"".join(queries["cells"].to_pylist()), np.uint8).reshape(len(q), -1)
            looked = np.unpackbits(bits, axis=1).astype(bool)
            own, mark = queries["q_id"].to_pylist(), queries["q_hash"].to_pylist()
            step = max(1, _CELLS // len(x))
            for lo in range(0, len(q), step):
                rough = q[lo : lo + step] @ x.T
                rough[~looked[lo : lo + step][:, c2]] = -np.inf
                for i, row in enumerate(rough, lo):
                    if np.isfinite(row.max()):
                        out += [(own[i], mark[i], v, -s) for s, v in best(q[i], x, row, ids)]
        columns = list(zip(*out)) or [[]] * 4
        types = [pa.int64(), pa.int64(), pa.int64(), pa.float64()]
        return pa.table([pa.array(c, t) for c, t in zip(columns, types)], ["q_id", "q_hash", "vec_id", "score"])

    return run


def _by_centroid(counts: dict[int, int]) -> Column:
    """Value of ``counts`` at c1, at most one for each centroid; 0 elsewhere."""
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x).cast("int") for kv in counts.items() for x in kv]), F.col("c1")), F.lit(0))


def _search(
    classes: DataFrame, asked: DataFrame, size: int, keep: int, centroids: int, sample: int, share: float, at_least: int
) -> DataFrame | None:
    """(q_id, q_hash, vec_id, score): the ``keep`` nearest of every vector in
    ``asked`` among ``classes``, all of one size."""
    fitted = classes.orderBy(F.xxhash64("v"), "v").select("v").limit(sample).toArrow()
    x = unit(matrix(fitted["v"], size))
    books = tuple(fit(h, centroids) for h in halves(x))
    index = settled(map_arrow(classes, _quantised(books, size), "v binary, ids array<long>, c1 int, c2 int"))

    sizes = np.zeros((len(books[0]), len(books[1])), np.int64)
    for r in index.groupBy("c1", "c2").agg(F.count(F.lit(1)).alias("n")).collect():  # centroids squared at most
        sizes[r.c1, r.c2] = r.n
    wanted = max(at_least, share * sizes.sum())
    visits = settled(
        map_arrow(asked, _visits(books, size, sizes, wanted), "q_id long, q_hash long, v binary, c1 int, cells binary")
    )
    # Blocks of a centroid's vectors meet blocks of the queries that look there.
    rows = max(1, BLOCK_BYTES // (8 * size))
    in_blocks = lambda n: math.ceil(n / rows)
    held = {int(c): in_blocks(n) for c, n in enumerate(sizes.sum(axis=1).tolist()) if n}
    looking = {r.c1: in_blocks(r["count"]) for r in visits.groupBy("c1").count().collect()}
    if not looking:
        return None
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    entries = (
        index.withColumn("block", F.pmod(F.xxhash64("v"), _by_centroid(held)).cast("int"))
        .withColumn("queries", _by_centroid(looking))
        .where("queries > 0")
        .select("c1", "block", every(F.col("queries")).alias("part"), "c2", "v", "ids")
    )
    queries = visits.withColumn("part", F.pmod(F.xxhash64("v"), _by_centroid(looking)).cast("int")).select(
        "c1", every(_by_centroid(held)).alias("block"), "part", "q_id", "q_hash", "v", "cells"
    )
    keys = ["c1", "block", "part"]
    return (
        entries.groupBy(*keys)
        .cogroup(queries.groupBy(*keys))
        .applyInArrow(_compared(size, keep), "q_id long, q_hash long, vec_id long, score double")
    )


def nearest_vectors(
    vectors: DataFrame, is_query: Column, nearest: int = NEAREST, centroids: int = CENTROIDS, sample: int = SAMPLE,
    share: float = SHARE, at_least: int = AT_LEAST,
) -> DataFrame:
    """(query_id, rank, vec_id, score): for every row of ``vectors`` (vec_id,
    embedding) that ``is_query`` holds for, the ``nearest`` found rows by cosine in
    double precision; equal cosines by smaller vec_id.

    Both halves of the unit vectors are quantised by k-means, fitted on ``sample``
    vectors at most (those of least hash); every vector is indexed under its pair of
    centroids. A query takes pairs by summed distance from a heap until their cells
    hold ``share`` of the index, ``at_least`` vectors in any case, and all vectors in
    those cells are compared exactly. Blocks of vectors under one centroid meet
    blocks of the queries that look there, both bounded in bytes, so a crowded
    centroid is spread over tasks. The driver holds the sample, the centroids and the
    number of vectors in each cell.

    Equal vectors are indexed once with the first ``nearest + 1`` of their ids, which
    are all that can be returned. Vectors that are null, empty or zero or hold null
    or non-finite components take no part, nor do rows without a vec_id. Vectors of
    different sizes are searched apart. A row never finds its own vec_id; identical
    rows count once, and one vec_id with several vectors asks with each of them.
    Fewer than ``nearest`` others: all are returned. An empty table gives no rows;
    other columns are read only by ``is_query``.
    """
    spark = vectors.sparkSession
    importable(spark)
    typed = "vec_id long, size int, v binary"
    raw = settled(map_arrow(vectors.select("vec_id", "embedding"), _vectors, typed).distinct())
    asking = map_arrow(vectors.where(is_query).select("vec_id", "embedding"), _vectors, typed).distinct()
    first_ids = W.partitionBy("size", "v").orderBy("vec_id")
    classes = settled(
        raw.withColumn("place", F.row_number().over(first_ids))
        .where(F.col("place") <= nearest + 1)
        .groupBy("size", "v")
        .agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    )
    members = settled(asking)
    asked = settled(
        members.groupBy("size", "v").agg(F.min("vec_id").alias("q_id")).withColumn("q_hash", F.xxhash64("v"))
    )
    found = None
    for r in asked.select("size").distinct().orderBy("size").collect():
        part = _search(
            classes.where(F.col("size") == r.size).select("v", "ids"),
            asked.where(F.col("size") == r.size).select("q_id", "q_hash", "v"),
            r.size, nearest + 1, centroids, sample, share, at_least,
        )
        if part is not None:
            found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    order = W.partitionBy("q_id", "q_hash").orderBy(F.desc("score"), "vec_id")
    tops = (
        found.withColumn("place", F.row_number().over(order))
        .where(F.col("place") <= nearest + 1)
        .groupBy("q_id", "q_hash")
        .agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("far"), F.col("vec_id").alias("near_id")))).alias("near"))
    )
    named = join_on_groups(members, asked.select("v", "q_id", "q_hash"), ["v"]).select("vec_id", "q_id", "q_hash")
    others = F.slice(F.filter("near", lambda x: x["near_id"] != F.col("vec_id")), 1, nearest)
    return (
        join_on_groups(named, tops, ["q_id", "q_hash"])
        .select(F.col("vec_id").alias("query_id"), F.posexplode(others).alias("place", "x"))
        .select(
            "query_id",
            (F.col("place") + 1).cast("int").alias("rank"),
            F.col("x.near_id").alias("vec_id"),
            (-F.col("x.far")).alias("score"),
        )
    )


def op12_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_vectors(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % QUERY_EVERY == 0)
