"""BPE encoding and decoding. Merges are found with a segment tree over the
ranks of adjacent pairs: its root names the leftmost pair of the lowest rank,
and a merge updates three leaves and their ancestors."""

from __future__ import annotations

import gc
import hashlib
import json
import re
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from copyledger.llm.common import map_arrow, read_table, text_blocks
from copyledger.llm.tokens import chunks_of, load, tokenizer_path

# Distinct chunks a worker process remembers before it starts anew.
REMEMBERED = 800_000
_NONE = np.int64(2**62)
_PLACE_BITS = 24
# Longer words are merged one at a time.
_TOGETHER = 64
# What the file's pre-tokenizer makes of printable lower-case ASCII; other text goes to the
# library's.
_PLAIN = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")


class Merges:
    """Vocabulary and ranked merges of a BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.ids: dict[str, int] = dict(model["vocab"])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in (self.ids | self.special).items()}
        self.ranks: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (left, right) in enumerate(model["merges"]):
            merged = left + right
            self.ranks[self.ids[left], self.ids[right]] = (rank, self.ids[merged])
        pairs = np.array([(a << 32) | b for a, b in self.ranks], np.int64)
        values = np.array(list(self.ranks.values()), np.int64).reshape(-1, 2)
        order = np.argsort(pairs)
        self._pairs, self._rank, self._merged = pairs[order], values[order, 0], values[order, 1]

    def symbols(self, word: str) -> list[int]:
        parts = list(word)
        parts[-1] += self.suffix
        return [self.ids[p] for p in parts]

    def lookup(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks of pairs, _NONE where they do not merge, and the merged ids."""
        pair = (left.astype(np.int64) << 32) | right
        at = np.minimum(np.searchsorted(self._pairs, pair), len(self._pairs) - 1)
        found = (self._pairs[at] == pair) & (left >= 0) & (right >= 0)
        return np.where(found, self._rank[at], _NONE), self._merged[at]


def merge_word(symbols: list[int], merges: Merges) -> list[int]:
    """Ids of one word. Every merge costs the logarithm of its length."""
    n = len(symbols)
    if n < 2:
        return symbols
    size = 1 << (n - 2).bit_length() if n > 2 else 1
    none = (1 << 62, 0)
    tree: list[tuple[int, int]] = [none] * (2 * size)
    symbols = list(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))

    def key(i: int) -> tuple[int, int]:
        j = after[i]
        hit = merges.ranks.get((symbols[i], symbols[j])) if j < n else None
        return (hit[0], i) if hit else none

    def update(i: int, value: tuple[int, int]) -> None:
        i += size
        tree[i] = value
        while i > 1:
            i >>= 1
            tree[i] = min(tree[2 * i], tree[2 * i + 1])

    for i in range(n - 1):
        tree[size + i] = key(i)
    for i in range(size - 1, 0, -1):
        tree[i] = min(tree[2 * i], tree[2 * i + 1])
    while tree[1] is not none and tree[1][0] < none[0]:
        i = tree[1][1]
        j = after[i]
        symbols[i] = merges.ranks[symbols[i], symbols[j]][1]
        symbols[j] = -1
        after[i] = after[j]
        if after[j] < n:
            before[after[j]] = i
        if j < n - 1:
            update(j, none)
        if i < n - 1:
            update(i, key(i))
        if before[i] >= 0:
            update(before[i], key(before[i]))
    return [s for s in symbols if s >= 0]


def merge_words(words: Sequence[list[int]], merges: Merges) -> list[list[int]]:
    """Ids of many words of at most _TOGETHER symbols: one segment tree per word,
    all of them advanced by one merge at a time."""
    width = max(map(len, words))
    leaves = 1 << max(0, (width - 2)).bit_length() if width > 2 else 1
    count = len(words)
    sym = np.full((count, width + 2), -1, np.int64)  # two closing columns hold nothing
    lengths = np.fromiter(map(len, words), np.int64, count)
    filled = np.arange(width + 2) < lengths[:, None]
    sym[filled] = np.fromiter(chain.from_iterable(words), np.int64, int(lengths.sum()))
    after = np.tile(np.arange(1, width + 3), (count, 1))
    before = np.tile(np.arange(-1, width + 1), (count, 1))
    after[:, width:] = width
    tree = np.full((count, 2 * leaves), _NONE, np.int64)
    places = np.arange(width - 1)
    if width > 1:
        rank, _ = merges.lookup(sym[:, : width - 1], sym[:, 1:width])
        tree[:, leaves : leaves + width - 1] = np.where(rank < _NONE, (rank << _PLACE_BITS) | places, _NONE)
    span = leaves
    while span > 1:
        span //= 2
        tree[:, span : 2 * span] = np.minimum(tree[:, 2 * span : 4 * span : 2], tree[:, 2 * span + 1 : 4 * span : 2])

    def update(rows: np.ndarray, at: np.ndarray, value: np.ndarray) -> None:
        inside = (at >= 0) & (at < leaves)
        rows, node = rows[inside], at[inside] + leaves
        tree[rows, node] = value[inside]
        top = leaves
        while top > 1:
            node >>= 1
            top //= 2
            tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])

    def keys(rows: np.ndarray, at: np.ndarray) -> np.ndarray:
        rank, _ = merges.lookup(sym[rows, at], sym[rows, after[rows, at]])
        return np.where(rank < _NONE, (rank << _PLACE_BITS) | at, _NONE)

    rows = np.flatnonzero(tree[:, 1] < _NONE)
    while len(rows):
        i = tree[rows, 1] & ((1 << _PLACE_BITS) - 1)
        j = after[rows, i]
        _, merged = merges.lookup(sym[rows, i], sym[rows, j])
        sym[rows, i] = merged
        sym[rows, j] = -1
        k = after[rows, j]
        after[rows, i] = k
        before[rows, k] = i
        update(rows, j, np.full(len(rows), _NONE))
        update(rows, i, keys(rows, i))
        h = before[rows, i]
        has = h >= 0
        update(rows[has], h[has], keys(rows[has], h[has]))
        rows = rows[tree[rows, 1] < _NONE]
    ids = sym[sym >= 0].tolist()
    ends = np.cumsum((sym >= 0).sum(axis=1)).tolist()
    return [ids[a:b] for a, b in zip([0, *ends], ends)]


@lru_cache(maxsize=2)
def merges_of(path: str) -> Merges:
    return Merges(path)


def encode_chunks(chunks: Sequence[str], path: str) -> list[list[int]]:
    """Ids of distinct chunks without white space, by the file's normalizer and
    pre-tokenizer and the merges above."""
    merges, tokenizer = merges_of(path), load(path)
    whole = " ".join(chunks)
    special = {s: i for s, i in merges.special.items() if s in whole}
    cut = {n: _around(c, special) for n, c in enumerate(chunks) if any(s in c for s in special)} if special else {}
    if cut:
        pieces = [p for n, c in enumerate(chunks) for p in cut.get(n, (c,)) if isinstance(p, str)]
        whole = " ".join(pieces)
    else:
        pieces = chunks
    # One call for all pieces: the blanks between them stay as they are.
    normal = tokenizer.normalizer.normalize_str(whole).split(" ") if pieces else []
    split = tokenizer.pre_tokenizer.pre_tokenize_str
    words = [
        _PLAIN.findall(t) if t.isascii() and t.isprintable() else [w for w, _ in split(t)] for t in normal
    ]
    distinct: dict[str, list[int]] = dict.fromkeys(chain.from_iterable(words))
    groups: dict[int, list[str]] = {}
    for word in distinct:
        groups.setdefault(len(word).bit_length() if len(word) <= _TOGETHER else 0, []).append(word)
    for size, group in groups.items():
        coded = [merges.symbols(w) for w in group]
        ids = merge_words(coded, merges) if size else [merge_word(s, merges) for s in coded]
        distinct.update(zip(group, ids))
    # Most pieces are one word, whose list is shared.
    coded = [distinct[w[0]] if len(w) == 1 else [i for p in w for i in distinct[p]] for w in words]
    if not cut:
        return coded
    of_piece = iter(coded)
    return [
        [i for p in cut[n] for i in ((p,) if isinstance(p, int) else next(of_piece))] if n in cut else next(of_piece)
        for n in range(len(chunks))
    ]


def _around(text: str, special: dict[str, int]) -> list[int | str]:
    """``text`` with the leftmost, then longest, special strings replaced by ids."""
    found: list[int | str] = []
    while text:
        hits = [(text.find(s), -len(s), s) for s in special if s in text]
        if not hits:
            found.append(text)
            break
        at, _, s = min(hits)
        if at:
            found.append(text[:at])
        found.append(special[s])
        text = text[at + len(s) :]
    return found


@contextmanager
def _uncollected() -> Iterator[None]:
    """Without the search for reference cycles, which goes through all remembered
    chunks again and again while many small lists are made; none of them has a cycle."""
    enabled = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if enabled:
            gc.enable()


def _remembered(path: str, value: Callable[[list[int]], object]) -> Callable[[list[list[str]]], dict]:
    """A table from chunks to what ``value`` makes of their ids, filled as
    chunks turn up and emptied when it holds REMEMBERED of them."""
    known: dict[str, object] = {}

    def fill(texts: list[list[str]]) -> dict:
        if len(known) > REMEMBERED:
            known.clear()
        with _uncollected():
            new = list({c for chunks in texts for c in chunks if c not in known})
            known.update(zip(new, map(value, encode_chunks(new, path))))
        return known

    return fill


@lru_cache(maxsize=2)
def _strings(path: str) -> Callable[[list[list[str]]], dict]:
    tokens = {i: t.encode() for i, t in merges_of(path).tokens.items()}
    digits = {i: b"%d" % i for i in tokens}

    def value(ids: list[int]) -> tuple[int, bytes, bytes]:
        if len(ids) == 1:
            return 1, digits[ids[0]], tokens[ids[0]]
        return len(ids), b" ".join([digits[i] for i in ids]), b" ".join([tokens[i] for i in ids])

    return _remembered(path, value)


@lru_cache(maxsize=2)
def _numbers(path: str) -> Callable[[list[list[str]]], dict]:
    return _remembered(path, lambda ids: ids)


def _digests(path: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols, texts in text_blocks(batches):
            split = [chunks_of(t) for t in texts]
            known = _strings(path)(split)
            out = []
            for doc_id, chunks in zip(cols["doc_id"], split):
                parts = [p for c in chunks if (p := known[c])[0]]
                counts, ids, decoded = zip(*parts) if parts else ((), (), ())
                out.append((
                    doc_id, sum(counts), hashlib.sha256(b" ".join(ids)).hexdigest(), hashlib.sha256(b" ".join(decoded)).hexdigest()
                ))
            yield pa.record_batch(
                [pa.array(c, t) for c, t in zip(zip(*out), [pa.int64(), pa.int64(), pa.string(), pa.string()])],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return run


def encode(docs: DataFrame, tokenizer: str = "word_bpe_49k.json") -> DataFrame:
    """``docs`` (doc_id, text) as (doc_id, ids array<int>): ids of the whole text
    without added special tokens. Null and empty texts give an empty array; other
    columns are ignored; rows keep their doc_id, null or repeated. Special
    strings inside a text give their own id."""
    path = tokenizer_path(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols, texts in text_blocks(batches):
            split = [chunks_of(t) for t in texts]
            known = _numbers(path)(split)
            ids = [[i for c in chunks for i in known[c]] for chunks in split]
            yield pa.record_batch(
                [pa.array(cols["doc_id"], pa.int64()), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"]
            )

    return docs.select("doc_id", "text").transform(map_arrow, run, "doc_id long, ids array<int>")


def decode(coded: DataFrame, tokenizer: str = "word_bpe_49k.json") -> DataFrame:
    """(doc_id, ids) as (doc_id, text): the tokens joined by blanks, special ones
    kept. Ids that are null or unknown are left out; a null list gives an empty
    text."""
    path = tokenizer_path(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = merges_of(path).tokens
        for batch in batches:
            texts = [" ".join([tokens[i] for i in ids or () if i in tokens]) for ids in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return coded.select("doc_id", "ids").transform(map_arrow, run, "doc_id long, text string")


def round_trip(docs: DataFrame, tokenizer: str = "word_bpe_49k.json") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of :func:`encode` and
    :func:`decode` without building the lists: each task keeps the digits and the
    decoded tokens of every distinct chunk. Same treatment of odd rows."""
    return docs.select("doc_id", "text").transform(
        map_arrow, _digests(tokenizer_path(tokenizer)), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(read_table(spark, sf_dir, "documents"))
