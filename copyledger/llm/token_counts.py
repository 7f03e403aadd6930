"""Token counts without token ids: every distinct piece of text is counted once
and the counts are joined to the frequencies of the documents."""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from copyledger.llm.common import map_arrow, read_table, shuffle_partitions, text_blocks
from copyledger.llm.tokens import load, tokenizer_path, units_of

# Distinct pre-tokens a task remembers; beyond it the table starts anew, and a
# pre-token may be counted again.
REMEMBERED = 1_000_000
MAX_BUCKETS = 256
_PACKET = "block binary, bucket int, words binary, lengths binary, postings binary"
_FIELDS = ["block", "bucket", "words", "lengths", "postings"]


def _frequencies(path: str, buckets: int):
    """Rows (block of documents, bucket of pre-tokens) with the pre-tokens of the
    block in that bucket, and for each its documents and frequencies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        specials = [t.content for t in load(path).get_added_tokens_decoder().values()]
        pack = zstandard.ZstdCompressor(level=1).compress
        for number, (cols, texts) in enumerate(text_blocks(batches)):
            n = len(texts)
            extra = np.zeros(n, "<i8")
            units = []
            for i, t in enumerate(texts):
                parts = [t]
                for s in specials:
                    if s in t:
                        extra[i] += sum(p.count(s) for p in parts)
                        parts = [q for p in parts for q in p.split(s)]
                units.append(units_of(t) if len(parts) == 1 else [u for p in parts for u in units_of(p)])
            sizes = np.array([len(t.encode("utf-8", "surrogatepass")) for t in texts], "<i8")
            ids = np.array([d if d is not None else 0 for d in cols["doc_id"]], "<i8")
            null = np.array([d is None for d in cols["doc_id"]], "<i8")
            digest = xxhash.xxh3_128(ids.tobytes() + sizes.tobytes())
            digest.update(f"{TaskContext.get().partitionId()}-{number}")
            block = digest.digest()
            rows = [(block, -1, pack(np.stack([ids, null, sizes, extra]).tobytes()), b"", b"")]

            flat = pa.array(list(itertools.chain.from_iterable(units)), pa.string()).dictionary_encode()
            words = [w.encode() for w in flat.dictionary.to_pylist()]
            code = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            owner = np.repeat(np.arange(n), [len(u) for u in units])
            pairs, freq = np.unique(code * n + owner, return_counts=True)
            word, doc = pairs // n, pairs % n
            place = np.array([zlib.crc32(w) % buckets for w in words], np.int64)
            order = np.argsort(place[word], kind="stable")
            word, doc, freq = word[order], doc[order], freq[order]
            cuts = np.searchsorted(place[word], np.arange(buckets + 1))
            for b in range(buckets):
                lo, hi = cuts[b], cuts[b + 1]
                if lo == hi:
                    continue
                used, n_docs = np.unique(word[lo:hi], return_counts=True)
                own = [words[i] for i in used]
                rows.append(
                    (
                        block,
                        b,
                        pack(b"".join(own)),
                        pack(np.stack([np.array([len(w) for w in own]), n_docs]).astype("<u4").tobytes()),
                        pack(np.stack([doc[lo:hi], freq[lo:hi]]).astype("<u4").tobytes()),
                    )
                )
            yield pa.record_batch(
                [pa.array(c, t) for c, t in zip(zip(*rows), [pa.binary(), pa.int32(), *[pa.binary()] * 3])], _FIELDS
            )

    return run


def _products(path: str):
    """Replaces the pre-tokens of each packet by their summed piece counts per
    document of the block. A pre-token of the bucket is counted once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load(path)
        unpack = zstandard.ZstdDecompressor().decompress
        pack = zstandard.ZstdCompressor(level=1).compress
        pieces: dict[bytes, int] = {}
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["bucket"] < 0:
                    out.append((row["block"], -1, row["words"]))
                    continue
                lengths, n_docs = np.frombuffer(unpack(row["lengths"]), "<u4").reshape(2, -1)
                ends = np.cumsum(lengths.astype(np.int64))
                joined = unpack(row["words"])
                words = [joined[e - k : e] for e, k in zip(ends.tolist(), lengths.tolist())]
                new = [w for w in words if w not in pieces]
                if new:
                    if len(pieces) + len(new) > REMEMBERED:
                        pieces.clear()
                        new = words
                    coded = tokenizer.encode_batch_fast([w.decode() for w in new], add_special_tokens=False)
                    pieces.update(zip(new, map(len, coded)))
                per_word = np.array([pieces[w] for w in words], np.int64)
                doc, freq = np.frombuffer(unpack(row["postings"]), "<u4").reshape(2, -1)
                sums = np.bincount(doc, weights=freq * np.repeat(per_word, n_docs)).astype("<i8")
                out.append((row["block"], row["bucket"], pack(sums.tobytes())))
            yield pa.record_batch(
                [pa.array([r[i] for r in out], t) for i, t in enumerate([pa.binary(), pa.int32(), pa.binary()])],
                ["block", "bucket", "value"],
            )

    return run


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per document; the packet with the documents comes first in a block."""
    unpack = zstandard.ZstdDecompressor().decompress
    head = total = None

    def rows() -> pa.RecordBatch:
        ids, null, sizes, extra = head
        return pa.record_batch(
            [pa.array(ids, pa.int64(), mask=null.astype(bool)), pa.array(sizes), pa.array(total + extra)],
            ["doc_id", "n_bytes", "n_tokens"],
        )

    for batch in batches:
        for row in batch.to_pylist():
            values = np.frombuffer(unpack(row["value"]), "<i8")
            if row["bucket"] < 0:
                if head is not None:
                    yield rows()
                head = values.reshape(4, -1)
                total = np.zeros(head.shape[1], np.int64)
            else:
                total[: len(values)] += values
    if head is not None:
        yield rows()


def token_counts(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", limit: int = 1024) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of ``docs`` (doc_id, text), as the
    byte-level BPE file ``tokenizer`` gives them; no token id is ever made for
    a document.

    A block of documents sends each of its distinct pre-tokens once, with a
    compressed list of the documents and frequencies, to the task that owns the
    pre-token; there its pieces are counted once and multiplied in. What
    travels back is one number per document and bucket. A pre-token here is a
    run without white space with the blank before it, or a run of white space:
    the finer pre-tokens of the file never reach across these. Very frequent
    ones add one list per block, never more than the block has documents.

    Null and empty texts have no bytes and no tokens. Rows keep their doc_id,
    null or repeated, one result for each row. A special token's string inside a
    text is one token. Other columns are ignored.
    """
    path = tokenizer_path(tokenizer)
    buckets = min(shuffle_partitions(docs.sparkSession), MAX_BUCKETS)
    packets = docs.select("doc_id", "text").transform(map_arrow, _frequencies(path, buckets), _PACKET)
    # Blocks alternate between tasks of a bucket where there are more tasks; the
    # rows that describe blocks only pass through and go to all tasks in turn.
    spread = max(1, shuffle_partitions(docs.sparkSession) // MAX_BUCKETS)
    turn = F.xxhash64("block")
    task = F.when(F.col("bucket") < 0, F.pmod(turn, F.lit(buckets * spread))).otherwise(
        F.col("bucket") * spread + F.pmod(turn, F.lit(spread))
    )
    dealt = packets.repartitionById(buckets * spread, task.cast("int"))
    products = dealt.transform(map_arrow, _products(path), "block binary, bucket int, value binary")
    counts = (
        products.repartition("block")
        .sortWithinPartitions("block", "bucket")
        .transform(map_arrow, _sums, "doc_id long, n_bytes long, n_tokens long")
    )
    return counts.withColumn("over_limit", F.col("n_tokens") > limit)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read_table(spark, sf_dir, "documents"))
