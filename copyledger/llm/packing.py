"""Packing documents into sequences of bounded length: a configuration linear
program over the histogram of piece lengths, solved by multiplicative weights
whose pricing step is a knapsack by dynamic programming, then rounded."""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from copyledger.llm.common import map_arrow, read_table, settled, shuffle_partitions, text_blocks
from copyledger.llm.tokens import chunks_of, load, tokenizer_path

CAPACITY = 2048
ROUNDS = 600
# Rate at which met demand loses weight, exponent of the length in a weight, and
# the part of the scarcest demand that a round meets.
ETA, LONG_FIRST, STEP = 0.05, 1.05, 1.0
# Sizes that one pricing step chooses from.
PRICED = 256
# Distinct chunks a worker process remembers before it starts anew.
REMEMBERED = 1_000_000
_PIECES = "doc_id long, row_key long, piece int, start long, length long, ids_crc32 long"


@lru_cache(maxsize=2)
def _known(path: str) -> dict[str, bytes]:
    return {}


def _coded(texts: list[list[str]], path: str) -> dict[str, bytes]:
    """Ids of every chunk as little-endian 32-bit integers."""
    known = _known(path)
    if len(known) > REMEMBERED:
        known.clear()
    new = list({c for chunks in texts for c in chunks if c not in known})
    for i in range(0, len(new), 50_000):
        part = new[i : i + 50_000]
        for chunk, e in zip(part, load(path).encode_batch_fast(part, add_special_tokens=False)):
            known[chunk] = np.array(e.ids, "<u4").tobytes()
    return known


def document_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, with_ids: bool = False) -> DataFrame:
    """Pieces of at most ``capacity`` tokens of ``docs`` (doc_id, text). Texts never
    split a token run across white space, so the ids of equal chunks are looked up."""
    path = tokenizer_path(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([end_id], "<u4").tobytes()
        for cols, texts in text_blocks(batches):
            split = [chunks_of(t) for t in texts]
            known = _coded(split, path)
            out = []
            for doc_id, key, chunks in zip(cols["doc_id"], cols["row_key"], split):
                ids = b"".join([known[c] for c in chunks]) + end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    row = (doc_id, key, piece, at // 4, len(part) // 4, zlib.crc32(part))
                    out.append(row + ((np.frombuffer(part, "<u4").tolist(),) if with_ids else ()))
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            names = ["doc_id", "row_key", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                types, names = [*types, pa.list_(pa.int32())], [*names, "ids"]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    keyed = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("row_key"))
    return keyed.transform(map_arrow, run, _PIECES + (", ids array<int>" if with_ids else ""))


def price(weights: np.ndarray, most: np.ndarray, sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Copies of each size, at most ``most``, of the greatest total weight that
    fit into ``capacity``: a bounded knapsack with copies in powers of two."""
    value = np.zeros(capacity + 1)
    steps = []
    for k in np.flatnonzero((most > 0) & (weights > 0)):
        left, times = int(most[k]), 1
        while left > 0:
            take = min(times, left)
            room = take * int(sizes[k])
            if room > capacity:
                break
            tried = value[: capacity + 1 - room] + take * weights[k]
            better = tried > value[room:] + 1e-15
            np.copyto(value[room:], tried, where=better)
            steps.append((k, take, room, better))
            left -= take
            times *= 2
    copies = np.zeros(len(sizes), np.int64)
    at = capacity
    for k, take, room, better in reversed(steps):
        if at >= room and better[at - room]:
            copies[k] += take
            at -= room
    return copies


def solve(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = ROUNDS) -> list[tuple[np.ndarray, float]]:
    """Configurations and fractional amounts that cover ``demand``.

    Multiplicative weights for the covering program: a size weighs less the
    more of its demand is met; each round adds the configuration of the
    greatest weight, by an amount that meets the part STEP of the scarcest demand in it.
    """
    met = np.zeros(len(sizes))
    most = np.minimum(np.ceil(demand), capacity // sizes).astype(np.int64)
    # A little more than the length itself, so that of two full configurations
    # the one of long pieces comes first and short ones are left to fill gaps.
    base = (sizes / capacity) ** LONG_FIRST
    found: dict[bytes, list] = {}
    for turn in range(rounds):
        open_ = np.flatnonzero(met < 1)
        # Evenly spread over the open sizes, others in each round.
        spread = (np.linspace(0, len(open_), PRICED, endpoint=False) + turn).astype(int)
        some = np.unique(open_[spread % len(open_)]) if len(open_) else open_
        weights = np.zeros(len(sizes))
        weights[some] = base[some] * np.exp(-ETA * met[some])
        config = price(weights, most, sizes, capacity)
        used = config > 0
        if not used.any():
            break
        amount = float(np.min(demand[used] / config[used])) * STEP
        met[used] += amount * config[used] / demand[used]
        entry = found.setdefault(config.tobytes(), [config, 0.0])
        entry[1] += amount
    return [(c, x) for c, x in found.values()]


@dataclass
class Plan:
    """Where the rank-th piece of a length goes. Sorted by (length, first rank)."""

    length: np.ndarray
    first: np.ndarray
    copies: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    sequences: int

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = self.length * 2**44 + self.first
        at = np.searchsorted(key, length * 2**44 + rank, side="right") - 1
        inner = rank - self.first[at]
        return (
            self.sequence[at] + inner // self.copies[at],
            self.offset[at] + inner % self.copies[at] * self.length[at],
        )


def best_fit(sizes: np.ndarray, left: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """Best-fit decreasing over a histogram: configurations (index: copies) and how
    often each is used. All pieces of a length, and all sequences with the same
    contents, move together."""
    by_room: dict[int, list[tuple[int, tuple]]] = {}
    rooms: list[int] = []

    def add(room: int, count: int, contents: tuple) -> None:
        if room not in by_room:
            by_room[room] = []
            bisect.insort(rooms, room)
        by_room[room].append((count, contents))

    for k in np.flatnonzero(left)[::-1].tolist():
        size, n = int(sizes[k]), int(left[k])
        while n:
            at = bisect.bisect_left(rooms, size)
            if at == len(rooms):
                room, count, contents = capacity, n, ()
            else:
                room = rooms[at]
                count, contents = by_room[room].pop()
                if not by_room[room]:
                    del by_room[room], rooms[at]
            copies = min(room // size, n)
            times = min(count, n // copies)
            if contents and times < count:
                add(room, count - times, contents)
            add(room - copies * size, times, (contents, k, copies))
            n -= times * copies
    found = []
    for groups in by_room.values():
        for count, contents in groups:
            config = {}
            while contents:
                contents, k, copies = contents
                config[k] = config.get(k, 0) + copies
            found.append((config, count))
    return found


def make_plan(lengths: dict[int, int], capacity: int = CAPACITY, rounds: int = ROUNDS) -> Plan:
    """Rounded solution for the histogram ``lengths`` (length: pieces). Amounts are
    rounded down and never exceed what is left; the rest goes largest first to
    the sequence it fits best.
    The work depends on the capacity, not on the number of pieces."""
    full = lengths.get(capacity, 0)
    sizes = np.array(sorted(s for s, n in lengths.items() if n > 0 and s < capacity), np.int64)
    left = np.array([lengths[int(s)] for s in sizes], np.int64)
    taken = np.zeros(len(sizes), np.int64)
    rows: list[tuple[int, int, int, int, int]] = []
    sequences = full
    if full:
        rows.append((capacity, 0, 1, 0, 0))

    def use(config: np.ndarray, times: int) -> None:
        nonlocal sequences
        offset = 0
        for k in np.flatnonzero(config)[::-1]:
            rows.append((int(sizes[k]), int(taken[k]), int(config[k]), sequences, offset))
            offset += int(config[k] * sizes[k])
            taken[k] += times * config[k]
            left[k] -= times * config[k]
        sequences += times

    if len(sizes):
        for config, amount in solve(sizes, left.astype(float), capacity, rounds):
            used = config > 0
            times = min(int(amount), int((left[used] // config[used]).min()))
            if times:
                use(config, times)
    for config, times in best_fit(sizes, left, capacity):
        use(np.array([config.get(k, 0) for k in range(len(sizes))], np.int64), times)
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return Plan(*table.T, sequences)


def pack_documents(
    docs: DataFrame, tokenizer: str = "word_bpe_49k.json", capacity: int = CAPACITY, end_id: int = 0
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of ``docs``
    (doc_id, text): ids of the whole text, then ``end_id``, cut into pieces of
    ``capacity``, and the place of each piece in a sequence of at most
    ``capacity`` tokens.

    The histogram of lengths, at most ``capacity`` rows, is all that the driver
    sees. A piece finds its place by its rank among the pieces of its length,
    counted in cells of (length, hash), so that a length of very many pieces is
    spread over tasks. Full pieces are sequences of their own.

    Null and empty texts are one piece of one token. Rows keep their doc_id, null
    or repeated. Repeated rows are packed each; other columns are ignored. An
    empty table packs to an empty result.
    """
    spark = docs.sparkSession
    pieces = settled(document_pieces(docs, tokenizer, end_id, capacity))
    lengths = {r.length: r.n for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = make_plan(lengths, capacity)

    cells = max(16, shuffle_partitions(spark))
    dealt = pieces.withColumn("cell", F.pmod(F.xxhash64("row_key", "piece"), F.lit(cells)))
    order = ["row_key", "doc_id", "piece"]
    ranked = dealt.withColumn("rank", F.row_number().over(W.partitionBy("length", "cell").orderBy(*order)) - 1)
    before = W.partitionBy("length").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        dealt.groupBy("length", "cell")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("length", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    )
    placed = ranked.join(offsets, ["length", "cell"])
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy()
            sequence, offset = plan.place(length, batch.column("rank").to_numpy())
            if (length == capacity).any():
                sequence = np.where(length == capacity, batch.column("rank").to_numpy(), sequence)
                offset = np.where(length == capacity, 0, offset)
            columns = [batch.column(n) for n in names[:5]] + [pa.array(sequence), pa.array(offset)]
            yield pa.record_batch(columns, names)

    return placed.select(*names[:5], (F.col("rank") + F.col("earlier")).cast("long").alias("rank")).transform(
        map_arrow, run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )


def packed_sequences(docs: DataFrame, packed: DataFrame, tokenizer: str = "word_bpe_49k.json",
                     capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """(sequence_id, ids) of a packing: the token ids of each sequence in order.
    Needs distinct doc_ids that are not null."""
    pieces = document_pieces(docs, tokenizer, end_id, capacity, with_ids=True)
    members = packed.join(pieces.select("doc_id", "piece", "ids"), ["doc_id", "piece"])
    gathered = members.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("m"))
    return gathered.select("sequence_id", F.flatten(F.col("m.ids")).alias("ids"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read_table(spark, sf_dir, "documents"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that are left, packed."""
    return pack_documents(docs)
