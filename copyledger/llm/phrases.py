"""Collocations: phrases whose words stand together more often than by chance."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from copyledger.llm.arrow import Partials, blocks
from copyledger.llm.common import importable, map_arrow, read_table, settled
from copyledger.llm.shingles import mix
from copyledger.operators.keyed import join_on_groups

PIECE_BREAKS = r"[.,;:!?\x0A-\x0D]"
WORD_BREAKS = r"[\x20\x09]+"
LONGEST = 5
MIN_COUNT = 100
TOP_PHRASES = 2000
# A window of this many words starts a chunk where its hash is 0 modulo SPACING, and
# neighbouring chunks share it: a phrase of LONGEST words lies whole in one.
TRIGGER = LONGEST - 1
SPACING = 16
# Bits that mark frequent shorter phrases; their size (8 MB) does not grow with data.
FILTER_BITS = 1 << 26
# Chunks are shorter lines than documents; a phrase step holds more columns a word.
CHUNK_BYTES = 4_000_000

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def _hashes(words: pa.Array, seed: int = 0) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(w, seed) for w in words.cast(pa.binary()).to_pylist()], np.uint64)


def _joined(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` words from every position on, where so many follow."""
    size = max(len(hashes) - n + 1, 0)
    out = hashes[:size].copy()
    for k in range(1, n):
        out = mix(out * _MULTIPLIER + hashes[k : k + size])
    return out


def _lines(words: pa.Array, first: np.ndarray, length: np.ndarray) -> pa.Array:
    """The ``length`` words from every ``first`` on, joined by blanks."""
    offsets = np.append(0, np.cumsum(length))
    taken = np.arange(offsets[-1]) + np.repeat(first - offsets[:-1], length)
    return pc.binary_join(pa.LargeListArray.from_arrays(pa.array(offsets), words.take(pa.array(taken))), " ")


def _chunks(block: pa.RecordBatch) -> pa.Table:
    """(lang, chunk, own, n): chunks of the block's pieces. Phrases that start in the
    first ``own`` words belong to the chunk, later ones to the next chunk."""
    text = pc.ascii_lower(pc.fill_null(block.column("text"), ""))
    pieces = pc.split_pattern_regex(text, PIECE_BREAKS)
    row_of = pc.list_parent_indices(pieces).to_numpy()
    split = pc.split_pattern_regex(pieces.flatten(), WORD_BREAKS)
    words, piece = split.flatten(), pc.list_parent_indices(split)
    whole = pc.greater(pc.binary_length(words), 0)
    words, piece = words.filter(whole), piece.filter(whole).to_numpy()
    encoded = words.dictionary_encode()
    windows = _joined(_hashes(encoded.dictionary)[encoded.indices.to_numpy()], TRIGGER)

    start = np.ones(len(words), bool)
    start[1:] = piece[1:] != piece[:-1]
    inside = piece[: len(windows)] == piece[TRIGGER - 1 :]
    start[: len(windows)] |= inside & (windows % np.uint64(SPACING) == 0)
    first = np.flatnonzero(start)
    following = np.append(first[1:], len(words))
    ends_piece = np.ones(len(first), bool)
    ends_piece[:-1] = piece[first[1:]] != piece[first[:-1]]
    own = following - first
    return pa.table({
        "lang": block.column("lang").take(pa.array(row_of[piece[first]])),
        "chunk": _lines(words, first, own + np.where(ends_piece, 0, TRIGGER)),
        "own": pa.array(own),
        "n": pa.array(np.ones(len(first), np.int64)),
    })


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = Partials(["lang", "chunk", "own"], ["n"], held=400_000)
    for block in blocks(batches, "text"):
        yield from held.add(_chunks(block))
    yield from held.finish()


class _Words:
    """Words of the chunks of one language, in order: where they stand, numbers and hashes."""

    def __init__(self, lang: str, rows: pa.Table):
        split = pc.split_pattern(rows["chunk"].combine_chunks(), " ")
        self.texts, self.chunk = split.flatten(), pc.list_parent_indices(split).to_numpy()
        length = pc.list_value_length(split).to_numpy().astype(np.int64)
        self.ends = np.cumsum(length)
        self.own_ends = self.ends - length + rows["own"].to_numpy()
        self.n = rows["n"].to_numpy()
        encoded = self.texts.dictionary_encode()
        self.distinct, self.ids = encoded.dictionary, encoded.indices.to_numpy().astype(np.int64)
        self.hashes = _hashes(self.distinct, xxhash.xxh3_64_intdigest(lang.encode()))[self.ids]

    def marked(self, size: int, marks: np.ndarray) -> np.ndarray:
        """Whether the phrase of ``size`` words from a position on may be frequent."""
        slots = _joined(self.hashes, size) & np.uint64(8 * len(marks) - 1)
        return (marks[slots >> np.uint64(3)] >> (slots & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _counted(lang: str, rows: pa.Table, size: int, marks: np.ndarray | None) -> pa.Table:
    """(lang, phrase, hash, n) of the phrases of ``size`` words that belong to chunks
    of one language, where both shorter phrases are marked."""
    words = _Words(lang, rows)
    ids, distinct = words.ids, words.distinct
    at = np.arange(len(ids))
    alive = (at < words.own_ends[words.chunk]) & (at + size <= words.ends[words.chunk])
    if marks is not None:
        frequent = words.marked(size - 1, marks)
        both = frequent[:-1] & frequent[1:]
        alive[: len(both)] &= both
        alive[len(both) :] = False
    at = at[alive]
    key = ids[at]
    for k in range(1, size):  # exact: a pair of numbers becomes one small number
        pair = pa.array(key * len(distinct) + ids[at + k]).dictionary_encode()
        key = pair.indices.to_numpy().astype(np.int64)
    found = pa.table({"key": key, "n": words.n[words.chunk[at]], "at": at})
    found = found.group_by("key", use_threads=False).aggregate([("n", "sum"), ("at", "min")])
    at = found["at_min"].to_numpy()
    texts = [distinct.take(pa.array(ids[at + k])) for k in range(size)]
    phrase = pc.binary_join_element_wise(*texts, " ") if size > 1 else texts[0]
    every = _joined(words.hashes, size)
    return pa.table({
        "lang": pa.array([lang] * len(at), pa.string()),
        "phrase": phrase,
        "hash": pa.array(every[at].view(np.int64) if len(at) else np.empty(0, np.int64)),
        "n": found["n_sum"],
    })


def _by_lang(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, pa.Table]]:
    for block in blocks(batches, "chunk", CHUNK_BYTES):
        rows = pa.Table.from_batches([block])
        for lang in pc.unique(rows["lang"]).to_pylist():
            yield lang, rows.filter(pc.equal(rows["lang"], lang))


def _level(size: int, marked):
    """Partial counts of the phrases of ``size`` words; words come with their total per
    language under the empty phrase."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Partials(["lang", "phrase", "hash"], ["n"])
        marks = None if marked is None else np.frombuffer(marked.value, np.uint8)
        for lang, rows in _by_lang(batches):
            found = _counted(lang, rows, size, marks)
            yield from held.add(found)
            if size == 1:
                whole = [[lang], [""], [0], [pc.sum(found["n"]).as_py() or 0]]
                yield from held.add(pa.table([pa.array(c, t) for c, t in zip(whole, found.schema.types)], found.schema.names))
        yield from held.finish()

    return run


def _runs(marked):
    """Chunks cut down to runs of three words and more whose neighbours are marked as
    frequent pairs; longer frequent phrases lie whole in one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Partials(["lang", "chunk", "own"], ["n"], held=400_000)
        marks = np.frombuffer(marked.value, np.uint8)
        for lang, rows in _by_lang(batches):
            words = _Words(lang, rows)
            linked = np.zeros(len(words.ids) + 1, bool)  # with the next word; framed by False
            linked[1:-1] = words.marked(2, marks) & (words.chunk[1:] == words.chunk[:-1])
            first = np.flatnonzero(linked[1:] & ~linked[:-1])
            end = np.flatnonzero(linked[:-1] & ~linked[1:]) + 1
            own = np.minimum(words.own_ends[words.chunk[first]], end) - first
            long = (end - first > 2) & (own > 0)
            first, end, own = first[long], end[long], own[long]
            yield from held.add(
                pa.table({
                    "lang": pa.array([lang] * len(first), pa.string()),
                    "chunk": _lines(words.texts, first, end - first),
                    "own": pa.array(own),
                    "n": pa.array(words.n[words.chunk[first]]),
                })
            )
        yield from held.finish()

    return run


def _marks(frequent: DataFrame, filter_bits: int) -> bytes | None:
    """Bits of the phrases in ``frequent``, or None without any. The driver holds
    filter_bits / 8 bytes, however many phrases there are."""
    slot = F.col("hash").bitwiseAND(F.lit(filter_bits - 1)) + 1
    parts = (
        frequent.groupBy(F.bitmap_bucket_number(slot).alias("part"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits"))
        .collect()
    )
    if not parts:
        return None
    bits = np.zeros(filter_bits // 8, np.uint8)
    for part in parts:
        piece = np.frombuffer(part.bits, np.uint8)
        start = (part.part - 1) * len(piece)
        bits[start : start + len(piece)] = piece[: len(bits) - start]
    return bits.tobytes()


def _scored(phrases: DataFrame, words: DataFrame) -> DataFrame:
    """Candidates with their lowest-scoring cut. Every cut looks both its parts up; a
    part of very many candidates is split over tasks."""
    parts = phrases.select("lang", F.col("phrase").alias("part"), F.col("f").alias("part_f"))
    split = F.split("phrase", " ")
    cuts = (
        phrases.where("words > 1")
        .select("lang", "phrase", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
        .withColumn("left", F.array_join(F.slice(split, F.lit(1), F.col("k")), " "))
        .withColumn("right", F.array_join(F.slice(split, F.col("k") + 1, F.size(split)), " "))
    )
    with_left = join_on_groups(cuts.withColumn("part", F.col("left")), parts, ["lang", "part"]).withColumnRenamed("part_f", "l")
    with_both = join_on_groups(
        with_left.withColumn("part", F.col("right")), parts, ["lang", "part"]
    ).withColumnRenamed("part_f", "r")
    exact = lambda c: F.col(c).cast("decimal(19,0)")
    # 1000 * a * n and l * r stay below 10**38; a score is at most 1000 * n / MIN_COUNT.
    scored = join_on_groups(with_both, words, ["lang"]).select(
        "lang", "phrase", "a", "k", "l", "r", "n",
        ((exact("a") * 1000).cast("decimal(19,0)") * exact("n")).cast("decimal(38,0)").alias("_over"),
        (exact("l") * exact("r")).cast("decimal(38,0)").alias("_under"),
    ).withColumn("score", F.expr("_over div _under"))
    # The score is kept as its cut's place: lowest score, then smallest k.
    lowest = F.min_by(F.struct("l", "r", "score"), F.struct("score", "k"))
    return (
        scored.groupBy("lang", "phrase", "a", "n")
        .agg(lowest.alias("cut"))
        .select("lang", "phrase", "a", "n", "cut.l", "cut.r", "cut.score")
    )


def collocations(
    documents: DataFrame, min_count: int = MIN_COUNT, top: int = TOP_PHRASES, filter_bits: int = FILTER_BITS
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of ``documents`` (text, lang).

    Texts, A-Z lower-cased, are cut into pieces at ``.,;:!?`` and line breaks, and
    pieces into words at blanks and tabs. Per language, phrases of 2 to 5 words with
    ``a >= min_count`` occurrences within pieces are candidates; a cut into parts
    with counts l and r gives floor(1000 a n / (l r)), n the words of the language.
    The lowest cut counts, then the one with fewest words first. A candidate inside
    a longer one with as many occurrences is dropped. Returned are the first ``top``
    of each language by score and a descending, phrase ascending in UTF-8 bytes.

    Prefix-free parsing: windows of four words whose hash triggers it begin a chunk,
    and the chunk before ends with the same window. Distinct chunks with their
    frequency in the parse form the dictionary, a table. Phrases are counted inside
    distinct chunks, weighted by frequency; one that starts in the shared window
    belongs to the later chunk, so each occurrence counts once.

    Counting goes by length. A phrase can only be frequent if the phrases without its
    last and first word are, so those are marked by hash in a bitmap of
    ``filter_bits`` bits (a power of two) that tasks test. The bitmap has a fixed
    size: with very many frequent phrases it keeps out less, and never a frequent
    one. From three words on, the dictionary is cut down to runs of marked pairs.
    Counts are of words, not of hashes, and exact; products use decimals, so
    words of a language must stay below 10**16.

    Null or empty text has no words; null lang is ``und`` (an empty one is itself); rows that
    repeat a doc_id count each. Texts of any length are parsed whole. An empty table,
    and a language without candidates, give no rows. Other columns are not read.
    """
    spark = documents.sparkSession
    importable(spark)
    read = documents.select("text", F.coalesce("lang", F.lit("und")).alias("lang"))
    typed = "lang string, chunk string, own long, n long"
    together = lambda chunks: settled(chunks.groupBy("lang", "chunk", "own").agg(F.sum("n").alias("n")))
    dictionary = together(map_arrow(read, _parse, typed))
    levels, marked = [], None
    for size in range(1, LONGEST + 1):
        counted = (
            dictionary.transform(map_arrow, _level(size, marked), "lang string, phrase string, hash long, n long")
            .groupBy("lang", "phrase", "hash")
            .agg(F.sum("n").alias("f"))
            .where((F.col("f") >= min_count) | (F.col("phrase") == ""))
        )
        levels.append(settled(counted.withColumn("words", F.lit(size))))
        bits = _marks(levels[-1].where("phrase <> ''"), filter_bits) if size < LONGEST else None
        if bits is None:
            break
        marked = spark.sparkContext.broadcast(bits)
        if size == 2:
            dictionary = together(map_arrow(dictionary, _runs(marked), typed))
    words = levels[0].where("phrase = ''").select("lang", F.col("f").alias("n"))
    phrases = reduce(DataFrame.unionByName, levels).where("phrase <> ''").select("lang", "phrase", "words", "f")

    # Counts only fall with length, so a longer phrase with as many occurrences exists
    # if and only if one that is a word longer does.
    split = F.split("phrase", " ")
    shorter = F.array(
        F.array_join(F.slice(split, F.lit(1), F.col("words") - 1), " "),
        F.array_join(F.slice(split, F.lit(2), F.col("words") - 1), " "),
    )
    inside = (
        phrases.where("words > 2").select("lang", F.explode(shorter).alias("phrase"), F.col("f").alias("a")).distinct()
    )
    kept = settled(_scored(phrases, words)).join(inside, ["lang", "phrase", "a"], "left_anti")
    order = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return (
        kept.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= top)
        .select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
    )


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read_table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents
),
pieces AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w
  FROM (SELECT lang, unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM d)
),
sizes AS (SELECT unnest(range(1, 6)) AS m),
grams AS (
  SELECT lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i : i + m - 1], ' '))) AS phrase
  FROM pieces, sizes WHERE m <= len(w)
),
f AS (SELECT lang, m, phrase, count(*) AS f FROM grams GROUP BY ALL),
words AS (SELECT lang, sum(f) AS n FROM f WHERE m = 1 GROUP BY lang),
candidates AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE m > 1 AND f >= 100),
halves AS (
  SELECT lang, m, phrase, a, k, array_to_string(w[1 : k], ' ') AS x, array_to_string(w[k + 1 : m], ' ') AS y
  FROM (SELECT *, unnest(range(1, m)) AS k FROM candidates)
),
cuts AS (
  SELECT h.lang, h.m, h.phrase, h.a, h.k, x.f AS l, y.f AS r, n,
    (1000::HUGEINT * h.a * n::HUGEINT) // (x.f::HUGEINT * y.f) AS score
  FROM halves h JOIN f x ON x.lang = h.lang AND x.phrase = h.x JOIN f y ON y.lang = h.lang AND y.phrase = h.y
  JOIN words ON words.lang = h.lang
),
scored AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
kept AS (
  SELECT * FROM scored s WHERE NOT EXISTS (
    SELECT 1 FROM candidates c WHERE c.lang = s.lang AND c.m > s.m AND 100 * c.a >= 100 * s.a
      AND contains(' ' || c.phrase || ' ', ' ' || s.phrase || ' '))
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank,
  phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score
FROM kept QUALIFY rank <= 2000
"""
