"""How far the sources of a language differ in their words, with exact integers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from copyledger.llm.arrow import Partials, blocks
from copyledger.llm.common import importable, map_arrow, read_table, settled
from copyledger.operators.keyed import join_on_groups

# What stands between terms, once A-Z are lower-cased.
BREAKS = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
SCALE = 1_000_000_000
MIN_DOCS = 3
TOP_TERMS = 200
# Counts in a shard of a language, sources whose rows one task fills, and cells of
# the matrix it works on at a time.
SHARD_ROWS = 50_000
SOURCE_BLOCK = 256
CELLS = 1_000_000
# Text whose terms a counting step holds at a time, in bytes.
BLOCK_BYTES = 2_000_000


def _counted(block: pa.RecordBatch) -> pa.Table:
    """(lang, source, term, n, docs) of the rows of one block, by numbers: one sort of
    (term, row) in which the rows of a group stand together."""
    split = pc.split_pattern_regex(pc.ascii_lower(pc.fill_null(block.column("text"), "")), BREAKS)
    terms, rows = split.flatten(), pc.list_parent_indices(split)
    whole = pc.greater(pc.binary_length(terms), 0)
    terms, rows = terms.filter(whole).dictionary_encode(), rows.filter(whole)
    langs, sources = block.column("lang").dictionary_encode(), block.column("source").dictionary_encode()
    width = max(1, len(sources.dictionary))
    group = langs.indices.to_numpy().astype(np.int64) * width + sources.indices.to_numpy()
    order = np.argsort(group, kind="stable")
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    bits = len(order).bit_length()
    key = terms.indices.to_numpy().astype(np.int64) << bits
    key |= place[rows.to_numpy()]
    key.sort()
    term, of = key >> bits, group[order][key & ((1 << bits) - 1)]
    fresh = np.ones(len(key), bool)  # a term's first occurrence in a row
    fresh[1:] = key[1:] != key[:-1]
    starts = np.ones(len(key), bool)
    starts[1:] = (term[1:] != term[:-1]) | (of[1:] != of[:-1])
    starts = np.flatnonzero(starts)
    n = np.diff(starts, append=len(key))
    docs = np.diff(np.append(0, np.cumsum(fresh))[np.append(starts, len(key))])
    term, of = term[starts].astype(np.int32), of[starts]
    return pa.table({
        "lang": pa.DictionaryArray.from_arrays(pa.array((of // width).astype(np.int32)), langs.dictionary),
        "source": pa.DictionaryArray.from_arrays(pa.array((of % width).astype(np.int32)), sources.dictionary),
        "term": pa.DictionaryArray.from_arrays(pa.array(term), terms.dictionary),
        "n": n.astype(np.int64),
        "docs": docs.astype(np.int64),
    })


def _partial_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = Partials(["lang", "source", "term"], ["n", "docs"])
    for block in blocks(batches, "text", BLOCK_BYTES):
        yield from held.add(_counted(block))
    yield from held.finish()


def share(count: np.ndarray, whole: np.ndarray | int) -> np.ndarray:
    """1 + floor(SCALE * count / whole) for 0 < count <= whole < 2**53, exactly: digits
    are divided out three at a time where the product would pass 64 bits."""
    if np.max(whole, initial=0) < 2**33:
        return 1 + SCALE * count // whole
    digits, rest = np.zeros_like(count), count
    for _ in range(3):
        rest = rest * 1000
        digits, rest = digits * 1000 + rest // whole, rest % whole
    return 1 + digits


def _divergences(top: int, cells: int):
    """Per shard of a language and block of its sources: parts of the pair sums, and
    the block's strongest terms of the shard."""

    def run(key: tuple, counts: pa.Table, groups: pa.Table) -> pa.Table:
        lang, own_block = key[0].as_py(), key[2].as_py()
        sources = groups["source"].combine_chunks()
        wholes = groups["total"].to_numpy() + groups["vocabulary"].to_numpy()
        own = np.flatnonzero(groups["own_block"].to_numpy() == own_block)
        lang_whole = int(groups["lang_total"][0].as_py() + groups["vocabulary"][0].as_py())
        terms = pc.unique(counts["term"])
        terms = terms.take(pc.sort_indices(terms))  # by bytes
        term = pc.index_in(counts["term"], value_set=terms).to_numpy()
        source = pc.index_in(counts["source"], value_set=sources).to_numpy()
        order = np.argsort(term, kind="stable")
        term, source, n = term[order], source[order], counts["n"].to_numpy()[order]

        sums = np.zeros((len(own), len(sources)), np.int64)
        best = [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in own]
        step = max(1, cells // len(sources))
        for lo in range(0, len(terms), step):
            hi = min(lo + step, len(terms))
            a, b = np.searchsorted(term, [lo, hi])
            matrix = np.zeros((len(sources), hi - lo), np.int64)
            matrix[source[a:b], term[a:b] - lo] = n[a:b]
            p = share(matrix + 1, wholes[:, None])
            q = share(matrix.sum(axis=0) + 1, lang_whole)
            for i, s in enumerate(own):
                gap = p[s] - p
                sums[i] += (gap * gap // p).sum(axis=1)
                high = np.flatnonzero((matrix[s] > 0) & (p[s] > q))
                values, ids = best[i]
                values = np.concatenate([values, (p[s, high] - q[high]) ** 2 // q[high]])
                ids = np.concatenate([ids, high + lo])
                first = np.lexsort((ids, -values))[:top]
                best[i] = values[first], ids[first]

        others = [np.flatnonzero(np.arange(len(sources)) != s) for s in own]
        pair_of = np.repeat(own, len(sources) - 1)
        pair_item = np.concatenate([*others, np.empty(0, np.int64)]).astype(np.int64)
        pair_value = np.concatenate([*[sums[i, o] for i, o in enumerate(others)], np.empty(0, np.int64)])
        term_of = np.repeat(own, [len(v) for v, _ in best])
        term_item = np.concatenate([*[ids for _, ids in best], np.empty(0, np.int64)]).astype(np.int64)
        term_value = np.concatenate([*[v for v, _ in best], np.empty(0, np.int64)])
        items = [sources.take(pa.array(pair_item)), terms.take(pa.array(term_item))]
        rows = len(pair_of) + len(term_of)
        return pa.table({
            "lang": pa.array([lang] * rows, pa.string()),
            "source": sources.take(pa.array(np.concatenate([pair_of, term_of]).astype(np.int64))),
            "part": pa.array(["pair"] * len(pair_of) + ["term"] * len(term_of), pa.string()),
            "item": pa.chunked_array([x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in items], pa.string()),
            "value": pa.array(np.concatenate([pair_value, term_value]).astype(np.int64)),
        })

    return run


def source_divergence(
    documents: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP_TERMS, shard_rows: int = SHARD_ROWS,
    source_block: int = SOURCE_BLOCK, cells: int = CELLS,
) -> DataFrame:
    """(lang, source, part, item, value, rank) of ``documents`` (text, lang, source).

    A term is a run of ASCII letters and characters beyond ASCII, A-Z lower-cased. A
    language keeps the terms found in at least ``min_docs`` of its rows. With a
    group's ``count`` of a kept term, its total N over kept terms and their number
    V, ``p = 1 + floor(10**9 * (count + 1) / (N + V))``, and the distance of p to q
    is ``floor((p - q)**2 / q)``. Part ``pair``: every other source of the language,
    distances summed over kept terms. Part ``term``: the first ``top`` terms that the
    source has more than its language. Ranks by value descending, item ascending.

    Tasks count terms in Arrow and merge what they hold; Spark sums those parts by
    (lang, source, term). Kept counts are dealt by term into shards of about
    ``shard_rows`` counts, and each shard is compared as a matrix of sources by
    terms, ``cells`` at a time, for ``source_block`` of its sources per task. So no
    task holds a language, a source or all pairs of sources.

    Every row is a document of its own, also where a doc_id is null or repeats. Null
    text, lang and source are read as empty; a group without terms has count 0
    throughout; where V is 0, pairs have value 0. An empty table gives no rows. Other
    columns are not read. Totals must stay below 2**53 words a language, pair sums
    below 2**63.
    """
    spark = documents.sparkSession
    importable(spark)
    empty = F.lit("")
    read = documents.select(
        F.coalesce("text", empty).alias("text"),
        F.coalesce("lang", empty).alias("lang"),
        F.coalesce("source", empty).alias("source"),
    )
    counts = (
        read.transform(map_arrow, _partial_counts, "lang string, source string, term string, n long, docs long")
        .groupBy("lang", "source", "term")
        .agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    )
    of_term = W.partitionBy("lang", "term")
    kept = settled(
        counts.withColumn("lang_docs", F.sum("docs").over(of_term))
        .withColumn("first", (F.col("source") == F.min("source").over(of_term)).cast("int"))
        .where(F.col("lang_docs") >= min_docs)
        .select("lang", "source", "term", "n", "first")
    )
    found = kept.groupBy("lang", "source").agg(
        F.sum("n").alias("total"), F.sum("first").alias("first"), F.count(F.lit(1)).alias("rows")
    )
    # All groups, also those without kept terms.
    groups = settled(
        read.select("lang", "source").distinct().join(found, ["lang", "source"], "left").na.fill(0, ["total", "first", "rows"])
    )
    langs = groups.groupBy("lang").agg(
        F.sum("total").alias("lang_total"),
        F.sum("first").alias("vocabulary"),
        F.greatest(F.lit(1), F.ceil(F.sum("rows") / shard_rows)).cast("int").alias("shards"),
        F.ceil(F.count(F.lit(1)) / source_block).cast("int").alias("source_blocks"),
    )
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    dealt = (
        join_on_groups(kept, langs.select("lang", "shards", "source_blocks"), ["lang"])
        .withColumn("shard", F.pmod(F.xxhash64("term"), "shards").cast("int"))
        .select("lang", "shard", every("source_blocks").alias("block"), "source", "term", "n")
    )
    rows = (
        join_on_groups(groups.select("lang", "source", "total"), langs, ["lang"])
        .withColumn("own_block", F.pmod(F.xxhash64("source"), "source_blocks").cast("int"))
        .withColumn("shard", every("shards"))
        .select("lang", "shard", every("source_blocks").alias("block"), "source", "total", "own_block", "lang_total", "vocabulary")
    )
    keys = ["lang", "shard", "block"]
    parts = settled(
        dealt.groupBy(*keys)
        .cogroup(rows.groupBy(*keys))
        .applyInArrow(_divergences(top, cells), "lang string, source string, part string, item string, value long")
    )
    ranked = F.row_number().over(W.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    pairs = (
        parts.where("part = 'pair'")
        .groupBy("lang", "source", "part", "item")
        .agg(F.sum("value").alias("value"))
        .withColumn("rank", ranked)
    )
    terms = parts.where("part = 'term'").withColumn("rank", ranked).where(F.col("rank") <= top)
    return pairs.unionByName(terms)


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(read_table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents
),
words AS (
  SELECT row, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
),
kept AS (SELECT lang, term, count(*) AS n FROM words GROUP BY ALL HAVING count(DISTINCT row) >= 3),
found AS (SELECT w.lang, w.source, term, count(*) AS n FROM words w JOIN kept USING (lang, term) GROUP BY ALL),
langs AS (SELECT lang, count(*) AS v, sum(n) AS n FROM kept GROUP BY lang),
pairs_of AS (SELECT DISTINCT lang, source FROM d),
totals AS (
  SELECT p.lang, p.source, coalesce(sum(n), 0) AS n FROM pairs_of p LEFT JOIN found USING (lang, source) GROUP BY ALL
),
cells AS (
  SELECT t.lang, t.source, k.term, coalesce(f.n, 0) AS c,
    1 + (1000000000::HUGEINT * (coalesce(f.n, 0) + 1)) // (t.n + l.v)::HUGEINT AS p,
    1 + (1000000000::HUGEINT * (k.n + 1)) // (l.n + l.v)::HUGEINT AS q
  FROM totals t JOIN langs l USING (lang) JOIN kept k USING (lang)
  LEFT JOIN found f ON f.lang = t.lang AND f.source = t.source AND f.term = k.term
),
pair_sums AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
  FROM cells a JOIN cells b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
),
parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
  FROM pairs_of a JOIN pairs_of b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pair_sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q)) // q FROM cells WHERE c > 0 AND p > q
),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM parts
)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank
FROM ranked WHERE part = 'pair' OR rank <= 200
"""
