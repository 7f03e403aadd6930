"""MinHash near-duplicates: universal hash minima, banding, signature and set
verification, components of the verified links."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from copyledger.llm.common import join_on_digest, map_arrow, read_table, settled, text_blocks, unused
from copyledger.llm.components import connected_components
from copyledger.llm.shingles import shingle_set, word_hashes, words_of
from copyledger.operators.keyed import join_on_groups

BANDS, ROWS, WIDTH = 24, 5, 5
_STEP = 4096
# Members compared with one leader in one task.
STAR_BLOCK = 512
# Classes of one bucket that are compared with each other in one task, and the
# bytes of their sets.
BUCKET_BLOCK, BLOCK_BYTES = 1024, 32_000_000
# Pairs are compared by set unless their signatures agree by this many standard
# deviations less than those of a pair just similar enough would on average.
SLACK = 5


def universal(n: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Factors (odd) and addends of ``n`` multiply-shift hash functions."""
    draw = np.random.default_rng(seed)
    a = draw.integers(0, 2**64, n, dtype=np.uint64) | np.uint64(1)
    return a, draw.integers(0, 2**64, n, dtype=np.uint64)


def signature(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Minimum of every hash function over the set, 32 bits each."""
    least = np.full(len(a), 2**32 - 1, np.uint64)
    for i in range(0, len(shingles), _STEP):
        hashed = (shingles[i : i + _STEP, None] * a + b) >> np.uint64(32)
        least = np.minimum(least, hashed.min(axis=0))
    return least.astype("<u4")


def _signatures(bands: int, rows: int, width: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = universal(bands * rows)
        for cols, texts in text_blocks(batches):
            words = [words_of(t) for t in texts]
            keys, sizes, sigs = [], [], []
            for ws, hashes in zip(words, word_hashes(words)):
                shingles = shingle_set(hashes, width)
                keys.append(xxhash.xxh3_128_digest(b" ".join(ws)) if ws else None)
                sizes.append(len(shingles))
                sigs.append(signature(shingles, a, b).tobytes() if len(shingles) else None)
            yield pa.record_batch(
                [
                    *(pa.array(cols[c], pa.int64()) for c in ("doc_id", "row_key")), pa.array(keys, pa.binary()),
                    pa.array(sizes, pa.int64()), pa.array(sigs, pa.binary()),
                ],
                ["doc_id", "row_key", "key", "n_shingles", "sig"],
            )

    return run


def _sets(width: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols, texts in text_blocks(batches):
            hashes = word_hashes([words_of(t) for t in texts])
            sets = [shingle_set(h, width).astype("<u8").tobytes() for h in hashes]
            yield pa.record_batch([pa.array(cols["row_key"], pa.int64()), pa.array(sets, pa.binary())], ["id", "value"])

    return run


def _agree(least: int) -> Callable:
    """At least so many of the minima agree."""

    def test(x: bytes, y: bytes) -> bool:
        return int((np.frombuffer(x, "<u4") == np.frombuffer(y, "<u4")).sum()) >= least

    return test


def _overlap(percent: int) -> Callable:
    """Intersection of the full sets at least ``percent`` of their union."""

    def test(x: bytes, y: bytes) -> bool:
        a, b = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
        common = len(np.intersect1d(a, b, assume_unique=True))
        return 100 * common >= percent * (len(a) + len(b) - common)

    return test


def star_compare(pairs: DataFrame, values: DataFrame, test: Callable) -> DataFrame:
    """Pairs (leader, member) whose ``values`` (id, value) pass ``test``.

    A leader's value goes once to each block of about STAR_BLOCK members,
    and members stream past it: no task holds more than one leader's value,
    and a leader of very many members is split over many tasks.
    """
    counts = pairs.groupBy("leader").agg(F.ceil(F.count(F.lit(1)) / STAR_BLOCK).alias("blocks"))
    dealt = join_on_groups(pairs, counts, ["leader"]).select(
        "leader", "member", F.pmod(F.xxhash64("member"), "blocks").alias("block")
    )
    members = dealt.join(values, dealt.member == values.id).select("leader", "block", "member", "value")
    heads = (
        counts.select("leader", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
        .join(values, F.col("leader") == F.col("id"))
        .select("leader", "block", F.lit(None).cast("long").alias("member"), "value")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = value = None
        for batch in batches:
            leaders, members = [], []
            for lead, member, v in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
                if member is None:
                    head, value = lead, v.as_py()
                elif lead == head and test(value, v.as_py()):
                    leaders.append(lead)
                    members.append(member)
            yield pa.record_batch([pa.array(leaders, pa.int64()), pa.array(members, pa.int64())], ["leader", "member"])

    return (
        heads.unionByName(members)
        .repartition("leader", "block")
        .sortWithinPartitions("leader", "block", F.col("member").asc_nulls_first())
        .transform(map_arrow, run, "leader long, member long")
    )


def _common(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of some sets, by products of their incidence
    matrix over the shingles that two of them share."""
    n = len(sets)
    values, column, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(n), [len(s) for s in sets])
    shared = seen[column] > 1
    place = np.cumsum(seen > 1) - 1
    row, column = row[shared], place[column[shared]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    total = np.zeros((n, n), np.float32)
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, _STEP):
        i, j = np.searchsorted(column, [lo, lo + _STEP])
        part = np.zeros((n, _STEP), np.float32)
        part[row[i:j], column[i:j] - lo] = 1
        total += part @ part.T
    return total


def _grouped(keys: list[str], handle: Callable[[list[dict]], list[tuple]], names: list[str]) -> Callable:
    """What ``handle`` finds in each run of rows with equal ``keys``, as longs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            found: list[tuple] = []
            for row in batch.to_pylist():
                if held and any(held[0][c] != row[c] for c in keys):
                    found += handle(held)
                    held = []
                held.append(row)
            yield out(found)
        yield out(handle(held))

    def out(found: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array([f[i] for f in found], pa.int64()) for i in range(len(names))], names)

    return run


def _apart(rows: list[dict]) -> np.ndarray:
    """Pairs (i < j by component) of different components that this task compares."""
    _, part = np.unique(np.array([r["component"] for r in rows]), return_inverse=True)
    apart = part[:, None] < part
    if rows[0]["b1"] != rows[0]["b2"]:
        side = np.array([r["side"] for r in rows])
        apart &= side[:, None] != side
    return apart


def _suspects(percent: int, bands: int, rows_: int, least: int) -> Callable:
    """Classes of a block with a partner whose signature agrees in at least ``least``
    minima, whose set is not too large or too small, and with which they agree in
    no earlier band, so that a pair is looked at in one bucket. Pairs with the
    leader of the bucket are known by then."""

    def handle(rows: list[dict]) -> list[tuple]:
        if len(rows) < 2:
            return []
        sigs = np.stack([np.frombuffer(r["value"], "<u4") for r in rows])
        sizes = np.array([r["n_shingles"] for r in rows], np.int64)
        led = np.array([r["rep"] == r["leader"] for r in rows])
        open_ = _apart(rows) & ~led[:, None] & ~led
        open_ &= 100 * np.minimum(sizes[:, None], sizes) >= percent * np.maximum(sizes[:, None], sizes)
        band, suspect = rows[0]["band"], np.zeros(len(rows), bool)
        for i in np.flatnonzero(open_.any(axis=1)).tolist():
            others = np.flatnonzero(open_[i])
            same = sigs[others] == sigs[i]
            near = same.sum(axis=1) >= least
            earlier = same[near].reshape(-1, bands, rows_)[:, :band].all(axis=2).any(axis=1)
            meets = others[near][~earlier]
            suspect[meets] = True
            suspect[i] |= len(meets) > 0
        return [tuple(rows[i][c] for c in _PLACE) for i in np.flatnonzero(suspect).tolist()]

    return _grouped(_BLOCK, handle, _PLACE)


def _bucket_links(percent: int) -> Callable:
    """Links between different components inside each block, as edges that connect
    what they connect."""

    def handle(rows: list[dict]) -> list[tuple]:
        if len(rows) < 2:
            return []
        sets = [np.frombuffer(r["value"], "<u8") for r in rows]
        sizes = np.array([len(s) for s in sets], np.float32)
        common = _common(sets)
        near = 100 * common >= percent * (sizes[:, None] + sizes - common)
        near &= _apart(rows)
        root: dict[int, int] = {r["component"]: r["component"] for r in rows}
        found = []
        for i, j in zip(*np.nonzero(near)):
            a, b = rows[i]["component"], rows[j]["component"]
            while root[a] != a:
                a = root[a]
            while root[b] != b:
                b = root[b]
            if a != b:
                root[max(a, b)] = min(a, b)
                found.append((rows[i]["rep"], rows[j]["rep"]))
        return found

    return _grouped(_BLOCK, handle, ["u", "v"])


# A block of a bucket, and a class in it.
_BLOCK = ["bucket", "b1", "b2"]
_PLACE = [*_BLOCK, "side", "rep", "component"]


def mixed_links(
    shared: DataFrame, components: DataFrame, sigs: DataFrame, sets: Callable[[DataFrame], DataFrame],
    percent: int, bands: int, rows: int, least: int,
) -> DataFrame:
    """Verified links between classes that share a bucket but no component yet.

    ``shared`` (bucket, band, leader, rep, n_shingles) are buckets of several classes,
    each compared with its leader. The others' signatures meet in one task a bucket,
    or in one for each two blocks of it, and mark the classes whose sets are still
    to be compared; these meet in the same blocks, and only connecting edges leave
    them, never the pairs. A block holds about BUCKET_BLOCK classes and no
    more than about BLOCK_BYTES of sets.
    """
    placed = shared.join(components, shared.rep == components.id, "left").select(
        *shared.columns, F.coalesce("component", "rep").alias("component")
    )
    mixed = (
        placed.groupBy("bucket")
        .agg(
            F.min("component").alias("a"), F.max("component").alias("b"), F.count(F.lit(1)).alias("n"),
            F.sum("n_shingles").alias("size"),
        )
        .where("a < b and n > 2")
        .select("bucket", F.ceil(F.greatest(F.col("n") / BUCKET_BLOCK, F.col("size") * 8 / BLOCK_BYTES)).cast("int").alias("blocks"))
    )
    open_ = (
        join_on_digest(placed, mixed, "bucket")
        .withColumn("side", F.pmod(F.xxhash64("rep"), "blocks").cast("long"))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks").cast("long") - 1)))
        .withColumn("b1", F.least("side", "other"))
        .withColumn("b2", F.greatest("side", "other"))
        .select(*_PLACE, "band", "leader", "n_shingles")
    )

    def dealt(places: DataFrame, values: DataFrame) -> DataFrame:
        full = places.join(values, places.rep == values.id).drop("id")
        return full.repartition(*_BLOCK).sortWithinPartitions(*_BLOCK)

    suspects = settled(
        dealt(open_, sigs).transform(
            map_arrow, _suspects(percent, bands, rows, least), ", ".join(f"{c} long" for c in _PLACE)
        )
    )
    wanted = sets(suspects.select(F.col("rep").alias("row_key")).distinct())
    return dealt(suspects, wanted).transform(map_arrow, _bucket_links(percent), "u long, v long")


def _row_key() -> Column:
    """Identifies a row: the hash of doc_id and text."""
    return F.xxhash64("doc_id", "text")


def _components(docs: DataFrame, percent: int, bands: int, rows: int, width: int) -> DataFrame:
    """Rows of ``minhash_components`` with their row_key. Classes of equal words go by the
    row_key of their first row, as a doc_id may stand on rows of different words."""
    texts = docs.select("doc_id", "text", _row_key().alias("row_key"))
    table = settled(
        texts.transform(
            map_arrow, _signatures(bands, rows, width), "doc_id long, row_key long, key binary, n_shingles long, sig binary"
        )
    )
    known = table.where("key is not null and doc_id is not null")
    first = F.min(F.struct("doc_id", "row_key"))
    reps = settled(
        known.groupBy("key")
        .agg(first.alias("first"), F.count(F.lit(1)).alias("copies"))
        .select("key", F.col("first.doc_id").alias("least"), F.col("first.row_key").alias("rep"), "copies")
    )

    band = F.xxhash64(F.col("band"), F.substring("sig", F.col("band") * (4 * rows) + 1, 4 * rows))
    own = known.join(reps, "key").where("row_key = rep").select("rep", "copies", "n_shingles", "sig")
    entries = settled(
        own.withColumn("band", F.explode(F.sequence(F.lit(0), F.lit(bands - 1)))).select(
            band.alias("bucket"), "band", "rep", "copies", "n_shingles"
        )
    )
    # A text that was copied often is likely what the others were made from.
    order = F.struct((-F.col("copies")).alias("c"), F.col("rep").alias("rep"))
    leaders = (
        entries.groupBy("bucket")
        .agg(F.min(order).alias("top"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select("bucket", F.col("top.rep").alias("leader"))
    )
    # Most classes are alone in their buckets; later steps read the others only.
    shared = settled(join_on_digest(entries.drop("copies"), leaders, "bucket"))
    stars = settled(shared.where("leader <> rep").select("leader", F.col("rep").alias("member")).distinct())
    sigs = known.select(F.col("row_key").alias("id"), F.col("sig").alias("value"))
    share = percent / 100
    slack = SLACK * math.sqrt(share * (1 - share) / (bands * rows))
    least = math.floor(max(0.0, share - slack) * bands * rows)

    def sets(wanted: DataFrame) -> DataFrame:
        needed = texts.join(wanted, "row_key").select("row_key", "text")
        return needed.transform(map_arrow, _sets(width), "id long, value binary")

    close = settled(star_compare(stars, sigs, _agree(least)))
    ends = close.select(F.explode(F.array("leader", "member")).alias("row_key")).distinct()
    links = settled(
        star_compare(close, sets(ends), _overlap(percent)).select(F.col("leader").alias("u"), F.col("member").alias("v"))
    )
    linked = connected_components(links)
    more = settled(mixed_links(shared, linked, sigs, sets, percent, bands, rows, least))
    if not more.isEmpty():
        linked = connected_components(links.unionByName(more))

    rooted = reps.join(linked, reps.rep == linked.id, "left").select("key", "least", F.coalesce("component", "rep").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    placed = join_on_groups(rooted, named, ["root"]).select("key", "component_id")
    return (
        join_on_groups(known.select("doc_id", "row_key", "key", "n_shingles"), placed, ["key"])
        .select("doc_id", "row_key", "n_shingles", "component_id")
        .unionByName(
            table.where("key is null or doc_id is null").select(
                "doc_id", "row_key", "n_shingles", F.col("doc_id").alias("component_id")
            )
        )
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )

def minhash_components(
    docs: DataFrame, percent: int = 85, bands: int = BANDS, rows: int = ROWS, width: int = WIDTH
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of ``docs`` (doc_id, text).

    Texts are compared by their sets of ``width``-word shingles and linked where
    100 * intersection >= ``percent`` * union, checked on the full sets. Texts of
    equal words form one class first; its smallest doc_id stands for it. In each
    band bucket every class is compared with one leader, by signature and then by
    set; after that, classes of a bucket in different components are compared with
    each other, by signature and then by set, so that no candidate link is lost
    and a large group of near copies sends each set to a few tasks instead of all
    its pairs. At a similarity of 0.85 a pair shares no bucket with probability 8e-7,
    at 0.80 with 7e-5; signatures rule out a pair of 0.85 or 0.80 by mistake with 1e-6.

    Null and empty texts have an empty set, link with nothing and are kept. A
    null doc_id takes no part: component_id is null and the row is kept. Rows
    repeating a doc_id are each placed by their own words. Other columns are
    ignored.
    """
    return _components(docs, percent, bands, rows, width).drop("row_key")


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_components(read_table(spark, sf_dir, "documents"))


def minhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, at a similarity of 0.8."""
    (row_key,) = unused(docs.columns, "_row_key")
    gone = _components(docs, 80, BANDS, ROWS, WIDTH).where("not kept").select("doc_id", F.col("row_key").alias(row_key))
    keyed = docs.select("*", _row_key().alias(row_key))
    return keyed.join(gone.distinct(), ["doc_id", row_key], "left_anti").select(docs.columns)
