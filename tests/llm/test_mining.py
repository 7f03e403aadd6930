"""Phrases, neighbours and source divergence against brute force."""

import math
import os
import random
import re
import subprocess
import sys
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from copyledger.llm import divergence, neighbours, phrases
from copyledger.llm.arrow import Partials, blocks

LOWER = {c: c + 32 for c in range(65, 91)}


@pytest.fixture
def texts(spark):
    """Documents whose other columns bear names that the operators use themselves."""

    def make(rows):
        full = [(t, d, g, s, 1, "p", "h", 2) for d, t, g, s in rows]
        schema = "text string, doc_id long, lang string, source string, n long, phrase string, term string, rank int"
        return spark.createDataFrame(full, schema).repartition(3)

    return make


def mixed_rows(odd_rows, seed):
    rng = random.Random(seed)
    words = ["the", "OLD", "man", "and", "sea", "Été", "x-1", "ſ", "İ", "\x00b", "a"]
    rows = [(i, t, rng.choice(["en", "de", None, ""]), rng.choice(["s1", "s2", None, ""])) for i, t in odd_rows]
    for i in range(120):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ". ", "\n", "\x0b", "!"]) for _ in range(60))
        rows.append((1000 + i, text, rng.choice(["en", "en", "de", None]), rng.choice(["s1", "s2", "s3", None])))
    rows += [(2000 + i, "the old man and the sea, again and again", "en", "s1") for i in range(40)]  # copies
    rows += [(3000, "a " * 5000, "en", "s9"), (3001, "12 34", "xx", "s1"), (3002, "lone words", "xx", "s2")]
    return rows


def phrases_by_hand(rows, least, top):
    f, total = defaultdict(Counter), Counter()
    for _, text, lang, _ in rows:
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            words = [w for w in re.split("[ \t]+", piece) if w]
            total["und" if lang is None else lang] += len(words)
            for m in range(1, 6):
                f["und" if lang is None else lang].update(tuple(words[i : i + m]) for i in range(len(words) - m + 1))
    out = []
    for lang, counts in f.items():
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        longest = Counter()  # most occurrences of a longer candidate around a phrase
        for c, b in candidates.items():
            for m in range(2, len(c)):
                for i in range(len(c) - m + 1):
                    longest[c[i : i + m]] = max(longest[c[i : i + m]], b)
        scored = []
        for p, a in candidates.items():
            inside = p in longest and 100 * longest[p] >= 100 * a
            if not inside:
                score, k = min((1000 * a * total[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, total[lang], -s))
    return sorted(out)


@pytest.mark.parametrize("least, top, filter_bits", [(3, 2000, 1 << 26), (5, 7, 1 << 15), (2, 2000, 1 << 8)])
def test_phrases(texts, odd_rows, least, top, filter_bits):
    rows = mixed_rows(odd_rows, least)
    found = phrases.collocations(texts(rows), least, top, filter_bits)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, found.collect())) == phrases_by_hand(rows, least, top)


def test_phrases_in_small_blocks(texts, odd_rows, monkeypatch):
    """Chunks of any cut: every word starts one, or hardly any does."""
    rows = mixed_rows(odd_rows, 8)
    expected = phrases_by_hand(rows, 3, 2000)
    assert expected
    batch = texts(rows).select("text", F.coalesce("lang", F.lit("und")).alias("lang")).toArrow().combine_chunks().to_batches()[0]
    for spacing in (1, 3, 10**9):
        monkeypatch.setattr(phrases, "SPACING", spacing)
        parsed = Counter()
        for block in blocks([batch], "text", 500):
            for r in phrases._chunks(block).to_pylist():
                words = r["chunk"].split(" ")
                for i in range(r["own"]):
                    parsed.update((r["lang"], " ".join(words[i : i + m])) for m in range(1, 6) if i + m <= len(words))
        for lang, _, phrase, a, *_ in expected:
            assert parsed[lang, phrase] == a


def test_phrase_scores_pass_64_bits(spark):
    big = 4 * 10**12
    levels = [("en", "a", 1, big), ("en", "b", 1, big), ("en", "a b", 2, big - 7), ("en", "b a", 2, 100)]
    table = spark.createDataFrame(levels, "lang string, phrase string, words int, f long")
    words = spark.createDataFrame([("en", 3 * big)], "lang string, n long")
    found = {r.phrase: r.score for r in phrases._scored(table, words).collect()}
    assert found == {p: 1000 * a * 3 * big // (big * big) for _, p, m, a in levels if m == 2}


def test_phrases_of_nothing(texts):
    assert phrases.collocations(texts([(1, "a b", "en", "s")]).where("false")).count() == 0
    assert phrases.collocations(texts([(1, None, None, None), (2, "one", "en", "s")])).count() == 0


def divergences_by_hand(rows, least, top):
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        found = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", (text or "").translate(LOWER))
        counts[lang, source].update(found)
        docs[lang].update(set(found))
    out = []
    for lang, sources in groups.items():
        terms = [t for t, n in docs[lang].items() if n >= least]
        share = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c[x] for x in terms) + len(terms)) for t in terms}
        p = {s: share(counts[lang, s]) for s in sources}
        q = share(sum((counts[lang, s] for s in sources), Counter()))
        far = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            pairs = sorted((-sum(far(p[s][t], p[o][t]) for t in terms), o.encode()) for o in sources if o != s)
            strong = sorted(
                (-far(p[s][t], q[t]), t.encode()) for t in terms if counts[lang, s][t] > 0 and p[s][t] > q[t]
            )[:top]
            out += [(lang, s, "pair", o.decode(), -v, i) for i, (v, o) in enumerate(pairs, 1)]
            out += [(lang, s, "term", t.decode(), -v, i) for i, (v, t) in enumerate(strong, 1)]
    return sorted(out)


@pytest.mark.parametrize(
    "least, top, sizes", [(3, 200, {}), (1, 3, {"shard_rows": 7, "source_block": 2, "cells": 5}), (10**6, 5, {"shard_rows": 1})]
)
def test_divergence(texts, odd_rows, least, top, sizes):
    rows = mixed_rows(odd_rows, 13)
    found = divergence.source_divergence(texts(rows), least, top, **sizes)
    assert found.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, found.collect())) == divergences_by_hand(rows, least, top)


def test_divergence_of_nothing(texts):
    assert divergence.source_divergence(texts([(1, "a", "en", "s")]).where("false")).count() == 0
    assert divergence.source_divergence(texts([(1, None, None, None)])).count() == 0


def test_share_is_exact():
    rng = random.Random(1)
    for top in (10**3, 2**33 - 1, 2**52):
        whole = np.array([rng.randrange(1, top) for _ in range(300)])
        count = np.array([rng.randrange(1, w + 1) for w in whole.tolist()])
        expected = [1 + 10**9 * c // w for c, w in zip(count.tolist(), whole.tolist())]
        assert divergence.share(count, whole).tolist() == expected


def test_counted_in_blocks_of_any_size(odd_rows):
    import pyarrow as pa

    rows = [(text, lang or "", source or "") for _, text, lang, source in mixed_rows(odd_rows, 3)]
    batch = pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], ["text", "lang", "source"])
    expected, docs = Counter(), Counter()
    for text, *group in rows:
        found = Counter(re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", (text or "").translate(LOWER)))
        for term, n in found.items():
            expected[*group, term] += n
            docs[*group, term] += 1
    for limit in (1, 500, 10**9):
        counts, in_docs = Counter(), Counter()
        for block in blocks(iter([batch]), "text", limit):
            for r in divergence._counted(block).to_pylist():
                counts[r["lang"], r["source"], r["term"]] += r["n"]
                in_docs[r["lang"], r["source"], r["term"]] += r["docs"]
        assert counts == expected
        assert in_docs == docs


PEAK = """
import random, pyarrow as pa
from copyledger.llm.divergence import _partial_counts
rng = random.Random(5)
words = [f"{'abcdefgh'[i % 8]}{chr(97 + i // 8 % 26)}{chr(97 + i // 208 % 26)}{chr(97 + i // 5408)}" for i in range(40_000)]
def batches():
    for _ in range(8):
        texts = [" ".join(rng.choices(words, k=400)) for _ in range(1000)]
        yield pa.record_batch([texts, ["en"] * 1000, [f"s{i % 20}" for i in range(1000)]], ["text", "lang", "source"])
rows = sum(sum(b["n"].to_pylist()) for b in _partial_counts(batches()))
print(rows, pa.default_memory_pool().max_memory() / 1e6)
"""


def test_counting_holds_little_memory():
    """3.2 million words: 105 MB, where full strings took 191."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(divergence.__file__))))
    env = os.environ | {"PYTHONPATH": os.pathsep.join([root, os.environ.get("PYTHONPATH", "")])}
    said = subprocess.run([sys.executable, "-c", PEAK], env=env, capture_output=True, text=True, check=True).stdout.split()
    assert int(said[0]) == 8 * 1000 * 400
    assert float(said[1]) < 150


def test_partials_of_dictionaries():
    import pyarrow as pa

    held, out, expected, rng = Partials(["k", "j"], ["n"], held=100), Counter(), Counter(), random.Random(4)
    given = []
    for _ in range(60):
        rows = [(rng.choice("abcdef"), f"{rng.randrange(50)}", rng.randrange(9)) for _ in range(40)]
        for k, j, n in rows:
            expected[k, j] += n
        k, j, n = map(list, zip(*rows))
        given += held.add(pa.table({"k": pa.array(k).dictionary_encode(), "j": pa.array(j).dictionary_encode(), "n": n}))
    for b in [*given, *held.finish()]:
        assert b.schema.types == [pa.string(), pa.string(), pa.int64()]
        for r in b.to_pylist():
            out[r["k"], r["j"]] += r["n"]
    assert out == expected


def test_partials():
    import pyarrow as pa

    rng = random.Random(3)
    rows = [(rng.choice("abcdef"), rng.randrange(50), rng.randrange(9)) for _ in range(3000)]
    held, out = Partials(["k", "j"], ["n"], held=100), Counter()
    batches = []
    for i in range(0, 3000, 40):
        k, j, n = zip(*rows[i : i + 40])
        batches += held.add(pa.table({"k": list(k), "j": list(j), "n": list(n)}))
    for b in [*batches, *held.finish()]:
        for r in b.to_pylist():
            out[r["k"], r["j"]] += r["n"]
    expected = Counter()
    for k, j, n in rows:
        expected[k, j] += n
    assert out == expected


def neighbours_by_hand(rows, every, nearest):
    good = {}
    for i, v in rows:
        if i is not None and v and None not in v and np.isfinite(v).all() and any(v):
            x = np.array(v, "f8") / max(map(abs, v))  # no square leaves the doubles
            good[i, tuple(v)] = x / np.linalg.norm(x)
    out = {}
    for (i, v), x in good.items():
        if i % every == 0:
            others = [(-round(float(x @ y), 12), j) for (j, w), y in good.items() if j != i and len(w) == len(v)]
            out.setdefault(i, []).append(sorted(set(others))[:nearest])
    return out


def vectors(spark, rows):
    full = [(e, i, 1, 2.0, "c", [3]) for i, e in rows]
    return spark.createDataFrame(full, "embedding array<double>, vec_id long, label int, score double, v string, cells array<int>")


def test_neighbours_exact(spark):
    """With the whole index in reach, the same rows as brute force: odd rows, ties,
    many equal vectors and vectors of another size."""
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(1, 200)]
    same = rng.normal(size=6).tolist()
    rows += [(i, same) for i in range(-40, 0)] + [(300 + i, [2 * x for x in same]) for i in range(9)]
    rows += [(400, None), (401, []), (405, [0.0] * 6), (410, [1.0, None, 2.0, 3.0, 4.0, 5.0]), (None, same)]
    rows += [(415, [math.nan] * 6), (420, [math.inf, 1.0, 1.0, 1.0, 1.0, 1.0]), (425, [1e300] * 6), (430, [1e-300] * 6)]
    rows += [(500, [1.0, 2.0]), (501, [2.0, 1.0]), (505, [3.0, 1.0])]
    rows += [rows[3], rows[3], (600, rows[5][1])]
    found = neighbours.nearest_vectors(vectors(spark, rows), F.col("vec_id") % 5 == 0, at_least=10**6, centroids=8).collect()
    got = defaultdict(list)
    for r in sorted(found, key=lambda r: (r.query_id, r.rank)):
        got[r.query_id].append((-round(r.score, 12), r.vec_id))
    expected = {i: lists[0] for i, lists in neighbours_by_hand(rows, 5, 5).items()}
    assert dict(got) == {i: near for i, near in expected.items() if near}
    assert all([r.rank for r in found if r.query_id == i] == list(range(1, len(near) + 1)) for i, near in got.items())


def test_neighbours_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(5)
    centre = rng.normal(size=8)
    rows = [(i, (centre + 0.01 * rng.normal(size=8)).tolist()) for i in range(300)]  # a crowded cell
    rows += [(300 + i, rng.normal(size=8).tolist()) for i in range(300)]
    table, query = vectors(spark, rows), F.col("vec_id") % 7 == 0
    whole = sorted(map(tuple, neighbours.nearest_vectors(table, query, centroids=4, share=0.3, at_least=1).collect()))
    monkeypatch.setattr(neighbours, "BLOCK_BYTES", 8 * 8 * 20)
    monkeypatch.setattr(neighbours, "_CELLS", 100)
    blocked = sorted(map(tuple, neighbours.nearest_vectors(table, query, centroids=4, share=0.3, at_least=1).collect()))
    assert [r[:3] for r in blocked] == [r[:3] for r in whole]


def test_neighbours_recall(spark):
    """On directions without any structure, the hardest input."""
    rng = np.random.default_rng(6)
    rows = [(i, v) for i, v in enumerate(rng.normal(size=(4000, 32)).tolist())]
    found = neighbours.nearest_vectors(vectors(spark, rows), F.col("vec_id") % 40 == 0, at_least=1).collect()
    expected = neighbours_by_hand(rows, 40, 5)
    hits = sum(r.vec_id in {i for _, i in expected[r.query_id][0]} for r in found)
    assert len(found) == 500 and hits >= 450


def test_traversal_order():
    rng = np.random.default_rng(7)
    first, second, sizes = rng.random(6), rng.random(5), rng.integers(0, 3, (6, 5))
    cells = list(neighbours.traverse(first, second, sizes, 10**9))
    assert sorted(cells) == sorted(zip(*map(np.ndarray.tolist, np.nonzero(sizes))))
    sums = [first[a] + second[b] for a, b in cells]
    assert sums == sorted(sums)
    some = list(neighbours.traverse(first, second, sizes, 7))
    assert some == cells[: len(some)] and sum(sizes[c] for c in some) >= 7 > sum(sizes[c] for c in some[:-1])


def test_neighbours_of_nothing(spark):
    table = vectors(spark, [(1, [1.0, 2.0]), (5, None)])
    for part in (table, table.where("false")):
        found = neighbours.nearest_vectors(part, F.col("vec_id") % 5 == 0)
        assert found.columns == ["query_id", "rank", "vec_id", "score"] and found.count() == 0
    alone = neighbours.nearest_vectors(vectors(spark, [(5, [1.0, 2.0])]), F.col("vec_id") % 5 == 0)
    assert alone.count() == 0
