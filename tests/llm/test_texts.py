"""Token counts, BPE, packing and lines against the libraries and plain Python."""

import gc
import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from copyledger.llm import bpe, lines, packing, token_counts
from copyledger.llm.tokens import chunks_of, tokenizer_path, units_of

BLANKS = " \t\n\x0b\x0c\r"


def texts_of(spark, sf):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]


def library(name):
    return Tokenizer.from_file(tokenizer_path(name))


@pytest.mark.parametrize("odd", [False, True])
def test_token_counts(spark, sf, docs, odd_rows, odd):
    rows = odd_rows if odd else texts_of(spark, sf)
    byte = library("byte_bpe_50k.json")
    expected = Counter((d, len((t or "").encode()), len(byte.encode(t or "", add_special_tokens=False).ids)) for d, t in rows)
    found = token_counts.token_counts(docs(*rows)).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in found) == expected
    assert all(r.over_limit == (r.n_tokens > 1024) for r in found)


@pytest.mark.parametrize("odd", [False, True])
def test_bpe_round_trip(spark, sf, docs, odd_rows, odd):
    rows = odd_rows if odd else texts_of(spark, sf)
    word = library("word_bpe_49k.json")

    def digests(d, t):
        ids = word.encode(t or "", add_special_tokens=False).ids
        digits, decoded = " ".join(map(str, ids)), word.decode(ids, skip_special_tokens=False)
        return d, len(ids), hashlib.sha256(digits.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()

    assert Counter(map(tuple, bpe.round_trip(docs(*rows)).collect())) == Counter(digests(d, t) for d, t in rows)
    coded = bpe.encode(docs(*rows))
    assert Counter((r.doc_id, tuple(r.ids)) for r in coded.collect()) == Counter(
        (d, tuple(word.encode(t or "", add_special_tokens=False).ids)) for d, t in rows
    )
    texts = Counter((d, word.decode(word.encode(t or "", add_special_tokens=False).ids, skip_special_tokens=False)) for d, t in rows)
    assert Counter(map(tuple, bpe.decode(coded).collect())) == texts


def test_segment_tree_merges_leftmost_lowest_rank_first():
    merges = bpe.merges_of(tokenizer_path("word_bpe_49k.json"))

    def plain(symbols):
        while True:
            ranked = [(merges.ranks[p][0], i) for i, p in enumerate(zip(symbols, symbols[1:])) if p in merges.ranks]
            if not ranked:
                return symbols
            i = min(ranked)[1]
            symbols = [*symbols[:i], merges.ranks[symbols[i], symbols[i + 1]][1], *symbols[i + 2 :]]

    rng = np.random.default_rng(0)
    words = ["".join(rng.choice(list("etaoinshr"), rng.integers(1, 40))) for _ in range(200)] + ["a" * 63, "ab" * 31]
    coded = [merges.symbols(w) for w in words]
    expected = [plain(c) for c in coded]
    assert [bpe.merge_word(c, merges) for c in coded] == expected
    assert bpe.merge_words(coded, merges) == expected


def test_bpe_chunks_with_special_strings():
    path = tokenizer_path("word_bpe_49k.json")
    special = max(bpe.merges_of(path).special, key=len)
    odd = ["plain", f"a{special}b", special, "\x00", f"{special}{special}Été", "don't", "plain,", "x" * 200, "42", "a\x1cb"]
    word = library("word_bpe_49k.json")
    for chunks in (odd, odd[:1], [c for c in odd if special not in c], []):
        assert bpe.encode_chunks(chunks, path) == [word.encode(c, add_special_tokens=False).ids for c in chunks]


def test_new_chunks_are_encoded_without_searches_for_cycles():
    path, seen = tokenizer_path("word_bpe_49k.json"), []
    fill = bpe._remembered(path, lambda ids: (len(ids), bytes(len(ids))))
    fill([["warm"]])
    note = lambda phase, info: seen.append(phase)
    gc.callbacks.append(note)
    try:
        known = fill([[f"w{i}x" for i in range(20_000)]])
    finally:
        gc.callbacks.remove(note)
    assert len(known) == 20_001
    assert seen.count("start") <= 2  # one is due afterwards
    assert gc.isenabled()
    with pytest.raises(TypeError):
        fill([[None]])
    assert gc.isenabled()


def test_pieces_rejoin():
    text = "  a b\x1cc\r\n\n d\xa0e　f  "
    assert "".join(units_of(text)) == text
    assert chunks_of(text) == ["a", "b\x1cc", "d", "e", "f"]


@pytest.mark.parametrize("odd", [False, True])
def test_packing(spark, sf, docs, odd_rows, odd):
    rows = odd_rows if odd else texts_of(spark, sf)
    word, expected = library("word_bpe_49k.json"), Counter()
    for d, t in rows:
        ids = word.encode(t or "", add_special_tokens=False).ids + [0]
        for piece, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048]
            expected[d, piece, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    packed = packing.pack_documents(docs(*rows)).collect()
    assert Counter(tuple(r)[:5] for r in packed) == expected
    sequences = defaultdict(list)
    for r in packed:
        sequences[r.sequence_id].append((r.offset, r.length))
    for places in sequences.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 2048
    assert len(sequences) <= 1.02 * sum(r.length for r in packed) / 2048 + 2


def test_packed_sequences_hold_the_tokens(docs):
    table = docs((1, "one two three"), (2, "four"), (3, " ".join(["five"] * 3000)))
    packed = packing.pack_documents(table)
    ids = [i for r in packing.packed_sequences(table, packed).collect() for i in r.ids]
    word = library("word_bpe_49k.json")
    assert Counter(ids) == Counter(
        i for t in ("one two three", "four", " ".join(["five"] * 3000)) for i in [*word.encode(t, add_special_tokens=False).ids, 0]
    )


def test_plan_is_near_the_bound():
    rng = np.random.default_rng(1)
    lengths = Counter(rng.integers(1, 2048, 20_000).tolist())
    lengths[2048] = 700
    plan = packing.make_plan(lengths)
    assert plan.sequences <= 1.005 * sum(k * n for k, n in lengths.items()) / 2048 + 1


def kept_lines(rows, least=40, most=5):
    holders = defaultdict(set)
    key = lambda line: line.strip(BLANKS).translate({c: c + 32 for c in range(65, 91)})
    for d, t in rows:
        for line in (t or "").split("\n"):
            if d is not None:
                holders[key(line)].add(d)
    out = Counter()
    for d, t in rows:
        parts = (t or "").split("\n")
        kept = [p for p in parts if len(key(p)) < least or len(holders[key(p)]) < most or max(holders[key(p)]) == d]
        out[d, "\n".join(kept), len(parts), len(parts) - len(kept)] += 1
    return out


@pytest.mark.parametrize("odd", [False, True])
def test_lines(spark, sf, docs, odd_rows, odd):
    rows = texts_of(spark, sf)
    if odd:
        line = "  A line of well over forty characters, met in many documents \t"
        rows = odd_rows + [(i, f"{line}\nown {i}\n{line.lower()}") for i in range(20, 90)] + [(None, line), (89, line)]
    table = docs(*rows)
    found = lines.dedup_lines(table)
    assert found.columns == [*table.columns, "n_lines", "n_dropped"]
    assert Counter((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in found.collect()) == kept_lines(rows)


def test_runs_are_compacted(spark):
    runs = lines.LineRuns(spark, fanout=2)
    for batch in range(5):
        keys = spark.range(batch, batch + 10).select(
            F.col("id").cast("string").cast("binary").alias("key"), F.lit(1).cast("long").alias("n_docs"), F.lit(100 - batch).cast("long").alias("owner")
        )
        runs.add(keys)
    assert [len(level) for level in runs.levels] == [1, 0, 1]
    total = {r.key.decode(): (r.n_docs, r.owner) for r in runs.total().collect()}
    assert total == {str(i): (min(i, 4) - max(0, i - 9) + 1, 100 - max(0, i - 9)) for i in range(14)}
    runs.clear()


def test_empty_tables(docs):
    none = docs()
    for result in (
        token_counts.token_counts(none), bpe.round_trip(none), packing.pack_documents(none), lines.dedup_lines(none),
    ):
        assert result.count() == 0
