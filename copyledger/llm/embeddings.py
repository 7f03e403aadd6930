"""Near-duplicate vectors: cross-polytope hashing after fast Hadamard rotations,
multiprobe buckets, verified pairs, connected components."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from copyledger.llm.common import map_arrow, read_table, settled
from copyledger.llm.components import connected_components
from copyledger.operators.keyed import join_on_groups

COSINE = 0.95
PROBES = 3
# Vectors of one bucket that are compared with each other in one task.
BLOCK = 4096
_PAIRS = 100_000


def tables_of(depth: int) -> int:
    """Hash tables for codes of ``depth`` corners: a code of more corners misses more
    near pairs in each table, so that recall asks for more tables."""
    return 4 + 2 ** (depth + 1)


@lru_cache(maxsize=8)
def _signs(dim: int, n: int) -> np.ndarray:
    return np.random.default_rng(dim).choice([-1.0, 1.0], size=(n, 3, dim)).astype(np.float32)


def rotate(x: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """Three rounds of sign flips and fast Hadamard transforms; rows of ``x`` have
    a power of two columns."""
    n, dim = x.shape
    for flips in signs:
        x = x * flips
        half = 1
        while half < dim:
            x = x.reshape(n, -1, 2, half)
            x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(n, dim)
            half *= 2
        x = x / np.float32(math.sqrt(dim))
    return x


def buckets(unit: np.ndarray, tables: int, depth: int, probes: int) -> np.ndarray:
    """Bucket codes [vector, table, 1 + probes] of unit vectors: the own bucket
    first, then the likeliest others. A code joins ``depth`` closest polytope
    corners; a probe replaces the corner that was nearest to being another."""
    n, dim = unit.shape
    size = 1 << max(0, (dim - 1).bit_length())
    padded = np.zeros((n, size), np.float32)
    padded[:, :dim] = unit
    signs = _signs(size, tables * depth)
    out = np.empty((n, tables, 1 + probes), np.uint64)
    row = np.arange(n)
    for t in range(tables):
        corners, runners, gaps = [], [], []
        for k in range(depth):
            y = rotate(padded, signs[t * depth + k])
            order = np.argpartition(-np.abs(y), min(probes, size - 1), axis=1)[:, : probes + 1]
            mags = np.take_along_axis(np.abs(y), order, axis=1)
            best = np.argsort(-mags, axis=1, kind="stable")
            order, mags = np.take_along_axis(order, best, axis=1), np.take_along_axis(mags, best, axis=1)
            code = (2 * order + (np.take_along_axis(y, order, axis=1) < 0)).astype(np.uint64)
            corners.append(code[:, 0])
            runners.append(code[:, 1:])
            gaps.append(mags[:, :1] - mags[:, 1:])
        own = np.zeros(n, np.uint64)
        for c in corners:
            own = own * np.uint64(2 * size) + c
        out[:, t, 0] = own
        gap = np.concatenate(gaps, axis=1)
        chosen = np.argsort(gap, axis=1, kind="stable")[:, :probes]
        width = runners[0].shape[1]
        for p in range(probes):
            at = chosen[:, p] if p < chosen.shape[1] else chosen[:, 0]
            level, nth = at // max(width, 1), at % max(width, 1)
            code = np.zeros(n, np.uint64)
            for k in range(depth):
                code = code * np.uint64(2 * size) + np.where(level == k, runners[k][row, nth], corners[k])
            out[:, t, 1 + p] = code
    return out


def _unit(raw: np.ndarray) -> np.ndarray:
    x = raw.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Valid vectors as bytes of doubles; the others as null."""
    for batch in batches:
        values = []
        for v in batch.column(1).to_pylist():
            if v and None not in v:
                x = np.array(v, "<f8") + 0.0
                values.append(x.tobytes() if np.isfinite(x).all() and x.any() else None)
            else:
                values.append(None)
        yield pa.record_batch([batch.column(0).cast(pa.int64()), pa.array(values, pa.binary())], ["vec_id", "v"])


def _entries(tables: int, depth: int, probes: int):
    """One row per vector and bucket: its own (base) and those it probes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                part = batch.slice(lo, 4096)
                raw, ids = part.column(1).to_pylist(), part.column(0).to_numpy()
                by_size: dict[int, list[int]] = {}
                for i, v in enumerate(raw):
                    by_size.setdefault(len(v), []).append(i)
                for size, rows in by_size.items():
                    unit = _unit(np.frombuffer(b"".join([raw[i] for i in rows]), "<f8").reshape(len(rows), -1))
                    codes = buckets(unit, tables, depth, probes).reshape(len(rows), -1)
                    n = codes.shape[1]
                    table = np.tile(np.repeat(np.arange(tables), 1 + probes), len(rows))
                    base = np.tile(np.arange(n) % (1 + probes) == 0, len(rows))
                    yield pa.record_batch(
                        [
                            pa.array(np.repeat(ids[rows], n)),
                            pa.array(table * 2**20 + size // 8, pa.int32()) if size // 8 < 2**20 else pa.array(table, pa.int32()),
                            pa.array(codes.reshape(-1).view(np.int64)),
                            pa.array(base),
                        ],
                        ["vec_id", "tab", "code", "base"],
                    )

    return run


def _met(codes: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First table and bucket in which two vectors meet: the own bucket of ``i`` if
    ``j`` holds or probes it, else the own bucket of ``j``."""
    first, where = np.full(len(i), codes.shape[1]), np.zeros(len(i), np.uint64)
    for t in range(codes.shape[1] - 1, -1, -1):
        a, b = codes[i, t], codes[j, t]
        here, there = (a[:, :1] == b).any(axis=1), (b[:, :1] == a).any(axis=1)
        first[here | there] = t
        where[here | there] = np.where(here, a[:, 0], b[:, 0])[here | there]
    return first, where


def _links(tables: int, depth: int, probes: int, cosine: float):
    """Per bucket block: linked pairs that meet here first, as a count for each
    vector (other null) and as edges that connect them (count 0)."""

    def group(table: int, code: int, block: np.ndarray, ids: np.ndarray, base: np.ndarray, side: np.ndarray, copies: np.ndarray, unit: np.ndarray):
        n = len(ids)
        total = np.zeros(n, np.int64)
        edges: list[tuple[int, int]] = []
        root = np.arange(n)
        codes = None
        step = max(1, _PAIRS // n)
        for lo in range(0, n, step):
            hi = min(n, lo + step)
            near = unit[lo:hi] @ unit.T >= cosine
            near &= np.arange(lo, hi)[:, None] < np.arange(n)
            near &= base[lo:hi, None] | base
            if block[0] != block[1]:
                near &= side[lo:hi, None] != side
            else:
                near &= ids[lo:hi, None] != ids
            i, j = np.nonzero(near)
            if not len(i):
                continue
            i = i + lo
            if codes is None:
                codes = buckets(unit, tables, depth, probes)
            swap = ids[i] > ids[j]
            i, j = np.where(swap, j, i), np.where(swap, i, j)
            first, where = _met(codes, i, j)
            mine = (first == table) & (where.view(np.int64) == code)
            i, j = i[mine], j[mine]
            np.add.at(total, i, copies[j])
            np.add.at(total, j, copies[i])
            for a, b in zip(i.tolist(), j.tolist()):
                ra, rb = a, b
                while root[ra] != ra:
                    root[ra] = root[root[ra]]
                    ra = root[ra]
                while root[rb] != rb:
                    root[rb] = root[root[rb]]
                    rb = root[rb]
                if ra != rb:
                    root[max(ra, rb)] = min(ra, rb)
                    edges.append((a, b))
        hit = np.flatnonzero(total)
        a = [int(ids[x]) for x, _ in edges]
        b = [int(ids[y]) for _, y in edges]
        return ids[hit].tolist() + a, [None] * len(hit) + b, total[hit].tolist() + [0] * len(a)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["tab", "code", "b1", "b2", "vec_id", "base", "side", "copies", "v"]
        held = None
        keep: list[list] = [[], [], []]

        def finish(rows: dict) -> None:
            if len(rows["vec_id"]) > 1 and any(rows["base"]):
                unit = _unit(np.frombuffer(b"".join(rows["v"]), "<f8").reshape(len(rows["v"]), -1))
                out = group(
                    int(rows["tab"][0]) >> 20, int(rows["code"][0]), (rows["b1"][0], rows["b2"][0]), np.array(rows["vec_id"]),
                    np.array(rows["base"]), np.array(rows["side"]), np.array(rows["copies"]), unit,
                )
                for have, new in zip(keep, out):
                    have += new

        for batch in batches:
            rows = {n: batch.column(n).to_pylist() for n in names}
            if held:
                rows = {n: held[n] + rows[n] for n in names}
            keys = list(zip(rows["tab"], rows["code"], rows["b1"], rows["b2"]))
            start = 0
            for i in range(1, len(keys)):
                if keys[i] != keys[start]:
                    finish({n: rows[n][start:i] for n in names}) if i - start > 1 else None
                    start = i
            held = {n: rows[n][start:] for n in names} if keys else None
            if keep[0]:
                yield pa.record_batch([pa.array(c, pa.int64()) for c in keep], ["u", "v", "n"])
                keep = [[], [], []]
        if held:
            finish(held)
        yield pa.record_batch([pa.array(c, pa.int64()) for c in keep], ["u", "v", "n"])

    return run


def near_vectors(
    vectors: DataFrame, cosine: float = COSINE, tables: int | None = None, probes: int = PROBES, depth: int | None = None
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of ``vectors`` (vec_id, embedding).

    Two vectors link where their cosine, in double precision, is at least
    ``cosine``. Candidates share a bucket in one of ``tables`` hash tables, as
    own bucket of one and own or probed bucket of the other; ``depth`` corners
    make a code, as many as keep random buckets small for the number of
    vectors, and ``tables`` grow with them. Equal vectors form one class, compared once and counted by its
    copies. A bucket block holds at most about 2 * BLOCK vectors; larger
    buckets are compared block by block. A pair is counted in the first table
    where it meets, so no list of pairs is ever made.

    Null, empty or zero vectors and those with null or non-finite components link
    with nothing; so do vectors of different sizes. Rows repeating a vec_id are
    vectors of their own; a null vec_id never links and gets component_id null,
    kept. Other columns are ignored.
    """
    raw = settled(vectors.select("vec_id", "embedding").transform(map_arrow, _vectors, "vec_id long, v binary"))
    valid = raw.where("v is not null and vec_id is not null")
    classes = settled(
        valid.groupBy("v")
        .agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
        .withColumn("id", F.xxhash64("v"))
    )
    if depth is None:
        n, dim = classes.agg(F.count(F.lit(1)), F.max(F.length("v"))).first()
        depth = max(1, round(math.log(max(n, 2)) / math.log(max(dim or 8, 32) / 4)))
    if tables is None:
        tables = tables_of(depth)

    own = classes.select(F.col("id").alias("vec_id"), "v", "copies")
    entries = own.select("vec_id", "v").transform(
        map_arrow, _entries(tables, depth, probes), "vec_id long, tab int, code long, base boolean"
    )
    entries = settled(entries.distinct())
    sizes = (
        entries.groupBy("tab", "code")
        .agg(F.count(F.lit(1)).alias("m"), F.max("base").alias("any_base"))
        .where("m > 1 and any_base")
        .select("tab", "code", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks"))
    )
    # Block x of a bucket meets every block y: rows go to (min, max) of both.
    mine = F.pmod(F.xxhash64("vec_id"), "blocks").cast("int")
    dealt = (
        join_on_groups(entries, sizes, ["tab", "code"])
        .withColumn("side", mine)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("tab", "code", F.least("side", "other").alias("b1"), F.greatest("side", "other").alias("b2"), "vec_id", "base", "side")
    )
    full = dealt.join(own, "vec_id")
    keys = ["tab", "code", "b1", "b2"]
    found = settled(
        full.select(*keys, "vec_id", "base", "side", "copies", "v")
        .repartition(*keys)
        .sortWithinPartitions(*keys)
        .transform(map_arrow, _links(tables, depth, probes, cosine), "u long, v long, n long")
    )
    counts = found.where("v is null").groupBy(F.col("u").alias("id")).agg(F.sum("n").alias("n"))
    linked = connected_components(found.where("v is not null").select("u", "v"))
    rooted = settled(
        classes.select("v", "id", "rep", "copies")
        .join(linked, "id", "left")
        .join(counts, "id", "left")
        .select(
            "v",
            "rep",
            F.coalesce("component", "id").alias("root"),
            (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"),
        )
    )
    smallest = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    placed = join_on_groups(rooted, smallest, ["root"]).select("v", "n_links", "component_id")
    alone = raw.where("v is null or vec_id is null").select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")
    )
    return (
        join_on_groups(valid, placed, ["v"])
        .select("vec_id", "n_links", "component_id")
        .unionByName(alone)
        .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
    )


def op6_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(read_table(spark, sf_dir, "embeddings"))
