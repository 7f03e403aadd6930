"""Substring deduplication: content-defined chunks cut by a gear rolling hash and
deduplicated by digest."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from copyledger.llm.common import join_on_digest, map_arrow, read_table, settled, text_blocks, unused
from copyledger.operators.keyed import join_on_groups

# A border lies where the gear hash of the last WINDOW bytes is the least (the
# rightmost on ties) of any WIDE consecutive units, so every WIDE units hold one.
# A chunk starts at each border and ends at the first one that is MIN_CHUNK bytes or
# MIN_UNITS units on, whichever comes first. Of 51 words of one letter four begin
# too early for their hash to lie inside, and 4 + WIDE + MIN_UNITS + WIDE = 52 is
# one more than the last border needs: a whole chunk fits into any 51 words.
WINDOW, WIDE, MIN_CHUNK, MIN_UNITS = 8, 12, 112, 24
# Spans of fewer bytes than MIN_CHUNK are removed if they have so many words.
MIN_WORDS = 50
# Units are words. Where a word goes on for over LONG bytes, as in scripts without
# blanks, they are the least hashes of any WINDOW consecutive bytes.
LONG = 32
_GEAR = np.random.default_rng(20).integers(0, 2**32, 256, dtype=np.uint32)
# The ends of a removed span shrink to white space no further away than this.
_REACH = 64
_BLANKS = b" \t\n\r\x0b\x0c"
_BLANK = np.isin(np.arange(256), list(_BLANKS))
# Units of a passage that may lie before its first and behind its last whole chunk.
_BEFORE, _AFTER = WINDOW // 2 + WIDE, 2 * WIDE


def _gear(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Gear hash of the WINDOW bytes before each place."""
    rolled = np.zeros(len(at), np.uint32)
    for i in range(WINDOW):
        inside = at > i
        rolled[inside] += _GEAR[data[at[inside] - 1 - i]] << np.uint32(i * 32 // WINDOW)
    return (rolled ^ (rolled >> np.uint32(15))) * np.uint32(0x2C1B3C6D)


def _least(hashes: np.ndarray, wide: int) -> np.ndarray:
    """Indices of the least hash, the rightmost on ties, of any ``wide`` in a row."""
    wide = min(wide, len(hashes))
    if not wide:
        return np.empty(0, np.int64)
    back = np.lib.stride_tricks.sliding_window_view(hashes, wide)[:, ::-1].argmin(axis=1)
    return np.unique(np.arange(len(back)) + wide - 1 - back)


def units(data: np.ndarray) -> np.ndarray:
    """Places where words begin, and those that divide long ones."""
    edge = np.diff(np.concatenate([[True], _BLANK[data], [True]]).astype(np.int8))
    begins, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    more = [begins]
    for i in np.flatnonzero(ends - begins > LONG).tolist():
        places = np.arange(begins[i] + LONG, ends[i])
        more.append(places[_least(_gear(data, places), WINDOW)])
    return np.sort(np.concatenate(more)) if len(more) > 1 else begins


def _chunks(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and digests of the chunks of a text, and its units."""
    data = np.frombuffer(raw, np.uint8)
    places = units(data)
    cuts = np.unique(np.concatenate([[0], places[_least(_gear(data, places), WIDE)], [len(raw)]])).astype(np.int64)
    rank = np.searchsorted(places, cuts)
    to = np.minimum(np.searchsorted(cuts, cuts + MIN_CHUNK), np.searchsorted(rank, rank + MIN_UNITS))
    whole = to < len(cuts)
    starts, ends = cuts[whole], cuts[to[whole]]
    view = memoryview(raw)
    digest = xxhash.xxh3_64_intdigest
    digests = np.array([digest(view[a:b]) for a, b in zip(starts.tolist(), ends.tolist())], np.uint64)
    return starts, ends, digests.view(np.int64), places


def chunks(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and digests of the chunks of a text. They overlap, so that a
    passage is covered whatever stands before it; an insertion only changes the
    chunks it touches."""
    return _chunks(raw)[:3]


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of a document; ``at`` holds 31 bits of its text's hash and the number
    of the chunk, so that neighbours in one text differ by one."""
    for cols, texts in text_blocks(batches):
        for lo in range(0, len(texts), 500):
            raws = [t.encode("utf-8", "surrogatepass") for t in texts[lo : lo + 500]]
            own = [chunks(raw)[2] for raw in raws]
            ids = np.repeat(np.array(cols["doc"][lo : lo + 500], np.int64), [len(o) for o in own])
            at = [((xxhash.xxh3_64_intdigest(raw) >> 33) << 32) + np.arange(len(o)) for raw, o in zip(raws, own)]
            columns = [np.concatenate(own), ids, np.concatenate(at).astype(np.int64)]
            yield pa.record_batch([pa.array(c) for c in columns], ["digest", "doc", "at"])


def _open_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeated chunks of each document that have no repeated one next to them on
    one side (-1 before, 1 behind)."""
    for batch in batches:
        found = []
        for doc, hits in zip(batch.column(0).to_pylist(), batch.column(1)):
            at, digests, owners = (hits.values.field(k).to_numpy() for k in ("at", "digest", "owner"))
            for side in (-1, 1):
                bare = ~np.isin(at + side, at)
                found += {(doc, d, o, side) for d, o in zip(digests[bare].tolist(), owners[bare].tolist())}
        yield pa.record_batch([pa.array([f[i] for f in found], pa.int64()) for i in range(4)], ["doc", "digest", "owner", "side"])


def _surroundings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What stands on one side of the wanted chunks, at their first and last places:
    in a periodic text one of them has the most of it on that side."""
    for cols, texts in text_blocks(batches):
        digests, sides, beside = [], [], []
        for text, wanted in zip(texts, cols["wanted"]):
            raw = text.encode("utf-8", "surrogatepass")
            starts, ends, own, places = _chunks(raw)
            last = {d: i for i, d in enumerate(own.tolist())}
            first = {d: len(own) - 1 - i for i, d in enumerate(reversed(own.tolist()))}
            for digest, side in {(w["digest"], w["side"]) for w in wanted if w["digest"] in first}:
                for i in {first[digest], last[digest]}:
                    a, b = int(starts[i]), int(ends[i])
                    if side < 0:
                        k = int(np.searchsorted(places, a)) - _BEFORE
                        beside.append(raw[int(places[k]) if k > 0 else 0 : a])
                    else:
                        k = int(np.searchsorted(places, b)) + _AFTER
                        beside.append(raw[b : int(places[k]) if k < len(places) else len(raw)])
                    digests.append(digest)
                    sides.append(side)
        yield pa.record_batch(
            [pa.array(digests, pa.int64()), pa.array(sides, pa.int64()), pa.array(beside, pa.binary())], ["digest", "side", "beside"]
        )


def _same(x: bytes, y: bytes) -> int:
    """Length of the common beginning."""
    return next((i for i, (a, b) in enumerate(zip(x, y)) if a != b), min(len(x), len(y)))


def spans(raw: bytes, repeated: np.ndarray, beside: dict[tuple[int, int], list[bytes]]) -> list[tuple[int, int]]:
    """Byte spans to remove: chunks with a ``repeated`` digest, extended as far as
    the text equals what stands ``beside`` them (by digest and side) in the
    document that has them first, joined where they touch and cut to whole words."""
    starts, ends, digests = chunks(raw)
    found: list[list[int]] = []
    for i in np.flatnonzero(np.isin(digests, repeated)).tolist():
        a, b, digest = int(starts[i]), int(ends[i]), int(digests[i])
        a -= max((_same(raw[max(0, a - len(x)) : a][::-1], x[::-1]) for x in beside.get((digest, -1), ())), default=0)
        b += max((_same(raw[b : b + len(x)], x) for x in beside.get((digest, 1), ())), default=0)
        while found and a <= found[-1][1]:
            last = found.pop()
            a, b = min(a, last[0]), max(b, last[1])
        found.append([a, b])
    cut = [_words(raw, a, b) for a, b in found]
    return [(a, b) for a, b in cut if b - a >= MIN_CHUNK or b > a and len(raw[a:b].split()) > MIN_WORDS]


def _words(raw: bytes, a: int, b: int) -> tuple[int, int]:
    """A span shrunk to the words and the blanks behind them that it holds whole,
    or else to whole code points."""
    start = next((i for i in range(a, min(b, a + _REACH) + 1) if i == 0 or raw[i - 1] in _BLANKS), None)
    if start is None:
        while a < b and raw[a] & 0xC0 == 0x80:
            a += 1
        start = a
    a = start
    end = next((i for i in range(b, max(a, b - _REACH) - 1, -1) if i == len(raw) or raw[i] in _BLANKS or i and raw[i - 1] in _BLANKS), None)
    if end is None:
        while b > a and b < len(raw) and raw[b] & 0xC0 == 0x80:
            b -= 1
        end = b
    return a, end


_REBUILT = T.StructType(
    [
        T.StructField("text", T.StringType()),
        T.StructField("n_chunks", T.LongType()),
        T.StructField("n_spans", T.LongType()),
        T.StructField("removed_bytes", T.LongType()),
    ]
)


@F.arrow_udf(_REBUILT)
def _rebuilt(texts: pa.Array, drops: pa.Array, ends: pa.Array) -> pa.Array:
    out, counts = [], []
    for text, gone, beside in zip(texts, drops, ends):
        text, gone = text.as_py() or "", gone.as_py()
        if not gone:
            out.append(text)
            counts.append((0, 0, 0))
            continue
        raw = text.encode("utf-8", "surrogatepass")
        known = {(e["digest"], e["side"]): e["beside"] for e in beside.as_py() or ()}
        cut = spans(raw, np.array(gone, np.int64), known)
        parts, at = [], 0
        for a, b in cut:
            parts.append(raw[at:a])
            at = b
        parts.append(raw[at:])
        out.append(b"".join(parts).decode("utf-8", "surrogatepass"))
        counts.append((len(gone), len(cut), sum(b - a for a, b in cut)))
    columns = [pa.array([c[i] for c in counts], pa.int64()) for i in range(3)]
    return pa.StructArray.from_arrays([pa.array(out, pa.string()), *columns], ["text", "n_chunks", "n_spans", "removed_bytes"])


def dedup_substrings(docs: DataFrame) -> DataFrame:
    """``docs`` with ``text`` rid of passages that a smaller doc_id holds too, and
    n_chunks (repeated chunks), n_spans and removed_bytes.

    A passage of over MIN_WORDS words is found wherever it stands, as it holds a
    whole chunk; so is one of MIN_CHUNK bytes that happens to hold one. Spans reach
    to where the text parts from that of the smallest doc_id with the chunk, less
    words cut in two; shorter spans of fewer words stay. Digests have 64 bits.

    Null text comes back empty. Rows of one doc_id count as one document, so
    their common passages stay; all rows with a null doc_id count as one that
    comes last. Passages repeated only inside one document stay. Other columns
    are kept; columns named like the three counts are replaced.
    """
    counts = ["n_chunks", "n_spans", "removed_bytes"]
    columns = [c for c in docs.columns if c not in counts]
    doc, drop, end, new = unused(columns, "_doc", "_drops", "_ends", "_new")
    keyed = docs.select(*columns, F.coalesce("doc_id", F.lit(2**63 - 1)).alias(doc))
    found = keyed.select(F.col(doc).alias("doc"), "text").transform(map_arrow, _occurrences, "digest long, doc long, at long")
    owners = (
        found.groupBy("digest")
        .agg(F.min("doc").alias("owner"), F.max("doc").alias("last"))
        .where("owner < last")
        .select("digest", "owner")
    )
    hits = settled(
        join_on_digest(found, owners, "digest")
        .where("doc > owner")
        .groupBy("doc")
        .agg(F.collect_list(F.struct("at", "digest", "owner")).alias("hits"))
    )
    open_ends = settled(hits.transform(map_arrow, _open_ends, "doc long, digest long, owner long, side long"))
    wanted = (
        open_ends.select("owner", "digest", "side")
        .distinct()
        .groupBy(F.col("owner").alias("doc"))
        .agg(F.collect_list(F.struct("digest", "side")).alias("wanted"))
    )
    beside = (
        keyed.select(F.col(doc).alias("doc"), "text")
        .join(wanted, "doc")
        .select("text", "wanted")
        .transform(map_arrow, _surroundings, "digest long, side long, beside binary")
        .groupBy("digest", "side")
        .agg(F.collect_set("beside").alias("beside"))
    )
    ends = (
        join_on_groups(open_ends, beside, ["digest", "side"])
        .groupBy(F.col("doc").alias(doc))
        .agg(F.collect_list(F.struct("digest", "side", "beside")).alias(end))
    )
    drops = hits.select(F.col("doc").alias(doc), F.array_distinct("hits.digest").alias(drop)).join(ends, doc, "left")
    rebuilt = keyed.join(drops, doc, "left").withColumn(new, _rebuilt("text", drop, end))
    text = {"text": F.col(f"{new}.text").alias("text")}
    return rebuilt.select(*[text.get(c, F.col(c)) for c in columns], *[F.col(f"{new}.{c}").alias(c) for c in counts])


def op7_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_substrings(docs).select("doc_id", "n_chunks", "n_spans", "removed_bytes", "text")


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages repeated across documents removed; ``n_chars`` follows the text."""
    rows = dedup_substrings(docs).withColumn("n_chars", F.length("text").cast("long"))
    return rows.select(docs.columns)
