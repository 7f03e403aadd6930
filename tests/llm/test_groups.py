"""Near-duplicates, passages, fingerprints, urls and quality against brute force."""

import hashlib
import itertools
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from copyledger.llm import components, embeddings, imatch, minhash, quality, substrings, urls


def roots(n, pairs):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(0, i) for i in range(300, 400)] + [(7, 7)]
    expected = dict(enumerate(roots(400, edges)))
    table = spark.createDataFrame([*edges, *edges[:5], (None, 3)], "u long, v long")
    found = {r.id: r.component for r in components.connected_components(table).collect()}
    assert found == {i: expected[i] for e in edges if e[0] != e[1] for i in e}
    assert components.connected_components(table.where("false")).count() == 0


def shingles(text):
    words = re.findall("[^\x20\x09-\x0d]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_minhash(spark, docs, odd_rows):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(3000)]
    base = [[rng.choice(words) for _ in range(120)] for _ in range(6)]
    rows = [r for r in odd_rows if r[0] is not None]
    for i in range(150):
        copy = list(base[i % 6])
        for _ in range(rng.randrange(4)):
            copy[rng.randrange(120)] = rng.choice(words)
        rows.append((100 + i, " ".join(copy)))
    sets = [shingles(t) for _, t in rows]
    pairs = [
        (a, b) for a, b in itertools.combinations(range(len(rows)), 2)
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])
    ]
    least = defaultdict(lambda: 10**9)
    root = roots(len(rows), pairs)
    for i, r in enumerate(root):
        least[r] = min(least[r], rows[i][0])
    expected = Counter((rows[i][0], len(sets[i]), least[r], rows[i][0] == least[r]) for i, r in enumerate(root))
    assert Counter(map(tuple, minhash.minhash_components(docs(*rows)).collect())) == expected
    unnamed = minhash.minhash_components(docs((None, "a b"), (None, None))).collect()
    assert all(r.component_id is None and r.kept for r in unnamed)
    assert minhash.minhash_components(docs()).count() == 0


@pytest.mark.parametrize("block, size", [(1024, 32_000_000), (8, 32_000_000), (1024, 10_000)])
def test_minhash_links_beside_the_leader(spark, docs, monkeypatch, block, size):
    """Families around the similarity that counts: most links join members that
    are not linked to the leaders of their buckets."""
    monkeypatch.setattr(minhash, "BUCKET_BLOCK", block)
    monkeypatch.setattr(minhash, "BLOCK_BYTES", size)
    draw = np.random.default_rng(9)
    rows = []
    for family in range(6):
        base = [f"f{family}w{i}" for i in range(160)]
        for member in range(20):
            words = list(base)
            for at in draw.choice(160, draw.integers(1, 5), replace=False).tolist():
                words[at] = f"m{member}v{at}" if draw.random() < 0.7 else f"v{at}"
            rows.append((100 * family + member, " ".join(words)))
    sets = {i: {tuple(t.split()[j : j + 5]) for j in range(156)} for i, t in rows}
    least = {i: i for i in sets}
    linked = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    for _ in sets:
        for a, b in linked:
            least[a] = least[b] = min(least[a], least[b])
    assert len(set(least.values())) > 12
    found = {r.doc_id: r.component_id for r in minhash.minhash_components(docs(*rows)).collect()}
    assert found == least


def test_minhash_places_rows_of_one_doc_id_by_their_own_words(spark, docs):
    rng = random.Random(13)
    a, b, c = (" ".join(f"w{rng.randrange(3000)}" for _ in range(120)) for _ in range(3))
    near = b.rsplit(" ", 1)[0]
    rows = [(3, a), (5, a), (5, b), (5, c), (2, near), (9, f"{c} more")]
    found = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.minhash_components(docs(*rows)).collect()}
    assert found == {
        (3, 116, 3, True), (5, 116, 3, False), (5, 116, 2, False), (5, 116, 5, True), (2, 115, 2, True), (9, 117, 5, False),
    }
    left = minhash.minhash_stage(spark, docs(*rows), "").collect()
    assert sorted((r.doc_id, r.text) for r in left) == sorted([(3, a), (5, c), (2, near)])


def test_vectors(spark):
    rng = np.random.default_rng(4)
    centers = rng.normal(size=(20, 64))
    rows = [(i, (centers[i % 20] + rng.normal(size=64) * 0.12).tolist()) for i in range(400)]
    rows += [(500 + i, rows[3][1]) for i in range(30)]
    odd = [(900, None), (901, []), (902, [0.0] * 64), (903, [float("nan")] * 64), (904, [None] * 64), (905, [1.0, 2.0]), (906, [1e200] * 64)]
    x = np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.95
    np.fill_diagonal(near, False)
    table = spark.createDataFrame([(*r, 1) for r in rows + odd], "vec_id long, embedding array<double>, code int").repartition(3)
    found = {r.vec_id: r for r in embeddings.near_vectors(table).collect()}
    links = sum(found[i].n_links for i, _ in rows)
    assert 0.98 * near.sum() <= links <= near.sum()
    ids = [i for i, _ in rows]
    for i, root in enumerate(roots(len(rows), zip(*np.nonzero(near)))):
        assert found[ids[i]].component_id == ids[root] and found[ids[i]].kept == (i == root)
    assert all(found[i].n_links == 0 and found[i].kept for i, _ in odd)
    assert embeddings.near_vectors(table.where("false")).count() == 0


def test_blocks_of_large_buckets_find_the_same(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(i, (np.ones(16) + rng.normal(size=16) * 0.1).tolist()) for i in range(120)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole = sorted(map(tuple, embeddings.near_vectors(table).collect()))
    monkeypatch.setattr(embeddings, "BLOCK", 25)
    assert sorted(map(tuple, embeddings.near_vectors(table).collect())) == whole


@pytest.mark.parametrize("depth", [2, 3, 4])
def test_recall_stays_with_depth(depth):
    rng = np.random.default_rng(9)
    for dim in (64, 256):
        x, y = rng.normal(size=(2, 1000, dim))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        y -= (x * y).sum(axis=1, keepdims=True) * x
        y = 0.95 * x + math.sqrt(1 - 0.95**2) * y / np.linalg.norm(y, axis=1, keepdims=True)
        tables = embeddings.tables_of(depth) if hasattr(embeddings, "tables_of") else embeddings.TABLES
        codes = embeddings.buckets(np.concatenate([x, y]), tables, depth, embeddings.PROBES)
        first, _ = embeddings._met(codes, np.arange(1000), np.arange(1000, 2000))
        assert (first < tables).mean() >= 0.9995


def prose(rng, n):
    return " ".join("".join(rng.choice("bcdfg") + rng.choice("aeiou") for _ in range(rng.randrange(1, 5))) for _ in range(n))


def test_substrings(docs, odd_rows):
    rng = random.Random(6)
    passage = prose(rng, 70)
    clean = [(i, prose(rng, 200)) for i in range(20, 40)]
    shared = [(i, f"{prose(rng, 60)} {passage} {prose(rng, 60 + i)}") for i in range(40, 60)]
    rows = [r for r in odd_rows if r[0] != 8] + clean + shared
    table = docs(*rows)
    result = substrings.dedup_substrings(table)
    assert result.columns == [*table.columns, "n_chunks", "n_spans", "removed_bytes"]
    found = {r.doc_id: r for r in result.collect()}
    for doc_id, text in [*clean, shared[0], *[r for r in odd_rows if r[0] in range(1, 10) and r[0] != 8]]:
        assert found[doc_id].text == (text or "") and found[doc_id].removed_bytes == 0
    for doc_id, text in shared[1:]:
        left = found[doc_id].text
        assert passage not in left and found[doc_id].n_spans == 1
        assert 0.6 * len(passage) <= len(text) - len(left) <= len(passage) + 1
    assert substrings.dedup_substrings(docs()).count() == 0


def test_chunks_resist_insertions():
    rng = random.Random(7)
    text = prose(rng, 2000).encode()
    changed = text[:5000] + b" something new " + text[5000:]
    before, after = set(substrings.chunks(text)[2].tolist()), set(substrings.chunks(changed)[2].tolist())
    assert len(before - after) < 0.06 * len(before)


def passages(rng):
    """51 words each: of one to four letters, prose, and of few distinct words."""
    short = [" ".join("".join(rng.choices("abcdefghij", k=n)) for _ in range(51)) for n in (1, 2, 3, 4) for _ in range(15)]
    few = [" ".join(rng.choices([prose(rng, 1) for _ in range(k)], k=51)) for k in (2, 5, 10, 19) for _ in range(5)]
    periodic = [" ".join((w * 51)[:51]) for w in (["la"], ["la", "lo"], ["one", "two", "three"], ["x"])]
    return short + few + periodic + [prose(rng, 51) for _ in range(40)]


def test_passages_of_51_words_hold_a_common_chunk():
    rng = random.Random(16)
    for passage in passages(rng):
        one, two = (set(substrings.chunks(f"{prose(rng, n)} {passage} {prose(rng, 60)}".encode())[2].tolist()) for n in (33, 48))
        assert one & two, passage


def test_passages_of_51_words_go_to_their_ends(docs):
    rng = random.Random(17)
    rows, held = [], {}
    for i, passage in enumerate(passages(rng)):
        parts = [(f"{prose(rng, 40 + k)} {k}", f"{k} {prose(rng, 40)}") for k in range(2)]
        rows += [(1000 * k + i, f"{a} {passage} {b}") for k, (a, b) in enumerate(parts)]
        held[1000 + i] = " ".join(parts[1])
    found = {r.doc_id: r.text for r in substrings.dedup_substrings(docs(*rows)).collect()}
    assert all(found[i] == text for i, text in rows if i < 1000)
    assert {i: found[i] for i in held} == held


def test_fingerprints(docs, odd_rows):
    rng = random.Random(8)
    rows = [r for r in odd_rows if r[0] not in (None, 7)] + [(i, prose(rng, 80)) for i in range(20, 60)] + [(7, "x y"), (7, "x y"), (60, "x y")]
    found = imatch.edited_fingerprints(docs(*rows)).collect()
    assert len(found) == len(rows)
    order = sorted({(d, t or "") for d, t in rows}, reverse=True)
    for r in found:
        i = next(i for i, (d, _) in enumerate(order) if d == r.doc_id)
        text, following = order[i][1], order[(i + 1) % len(order)][1]
        half = len(text) // 2
        assert r.n_chars == len(text)
        assert r.edited_sha256 == hashlib.sha256((text[: len(text) - half] + following[:half]).encode()).hexdigest()
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    prints = {r.doc_id: r.fingerprint for r in found}
    assert prints[7] == prints[60] and prints[1] == prints[2]
    long = [r for r in found if 20 <= r.doc_id < 60]
    assert np.mean([r.near_edited for r in long]) > np.mean([r.near_next for r in long])
    assert imatch.edited_fingerprints(docs((None, "a"), (None, None))).count() == 2
    assert imatch.edited_fingerprints(docs()).count() == 0


def test_url_rules_and_aliases(spark):
    link = '<link href="%s" REL="canonical">'
    pages = [
        (1, "http://A.Example.org/es/x?q", ""), (2, "https://x.com/de/1", ""), (3, "https://alias.net/1", link % "http://x.com/de/1#top"),
        (4, "https://alias2.net/", '<meta http-equiv="refresh" content="0; url=https://alias.net/1">'),
        (5, "https://x.org/", link % "http://x.com/de/9"), (6, "http://mixed.net/", link % "https://x.org/"),
        (7, None, None), (8, "no scheme", link % "http://x.com/de/1"), (9, "http://free.net/a/../b", link % "/c"), (9, "http://free.net/a/../b", ""),
        (10, "http://example.org/en/12", ""), (11, "http://example.org/en/2", ""), (12, "http://notexample.org/es/", ""), (13, "", ""),
        (14, "http://given.net/", ""),
    ]
    table = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, verdict string")
    given = spark.createDataFrame([("http://given.net/", "http://alias2.net/"), (None, "http://x.com/de/1")], "source string, target string")
    found = urls.url_verdicts(table, redirects=given).collect()
    assert len(found) == len(pages)
    verdicts = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in found}
    assert verdicts == {
        1: ("a.example.org", "/es/x", "example.org/es/", "block"), 2: ("x.com", "/de/1", "com/de/", "block"),
        3: ("alias.net", "/1", None, "block"), 4: ("alias2.net", "/", None, "block"), 5: ("x.org", "/", "org/", "allow"),
        6: ("mixed.net", "/", None, "allow"), 7: ("", "", None, "allow"), 8: ("", "", None, "allow"),
        9: ("free.net", "/a/../b", None, "allow"), 10: ("example.org", "/en/12", "example.org/en/1", "block"),
        11: ("example.org", "/en/2", "org/", "allow"), 12: ("notexample.org", "/es/", "org/", "allow"), 13: ("", "", None, "allow"),
        14: ("given.net", "/", None, "block"),
    }
    assert urls.url_verdicts(table.where("false")).count() == 0


def test_url_links_of_all_forms(spark):
    base = "http://a.net/f/g/page.html?x=1"
    html = (
        '<link rel="alternate canonical" href="index.html"><link rel=canonical href="../up"><link rel="canonical" href="?p=1&amp;q=2">'
        "<link href='./' rel='canonical next'><link rel=canonical href=/r/./s/../t><link rel=canonical href='#top'>"
        '<link rel="canonical" href="mailto:x@y.z"><link rel="noncanonical" href="no"><link rel="canonical" href="../../../z/..">'
        '<meta http-equiv="refresh" content="0; url=next?u=http://b.net/"><meta http-equiv=refresh content="1;url=//c.net/">'
    )
    pages = spark.createDataFrame([(base, html), ("http://bare.net", '<link rel=canonical href="x">'), ("none", '<link rel=canonical href="x">')], "url string, html string")
    found = sorted((r.source, r.target) for r in urls.page_links(pages).collect())
    ends = ["f/g/index.html", "f/up", "f/g/page.html?p=1&q=2", "f/g/", "r/t", "", "f/g/next?u=http://b.net/"]
    assert found == sorted([(base, f"http://a.net/{e}") for e in ends] + [(base, "http://c.net/"), ("http://bare.net", "http://bare.net/x")])


def test_quality_on_held_out_labels(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "labels"))
    hidden = F.pmod(F.xxhash64("doc_id", F.lit("test")), F.lit(3)) == 0
    scored = quality.quality_scores(docs, labels.where(~hidden))
    rows = scored.join(labels.where(hidden), "doc_id").collect()
    assert len(rows) > 80
    assert np.mean([r.keep == (r.quality == 1) for r in rows]) > 0.95
    assert np.mean([r.keep for r in rows if r.quality == 1]) > 0.98


def test_quality_without_usable_labels(spark, docs, odd_rows):
    labels = spark.createDataFrame([(4, 1, 0), (5, None, 0), (None, 0, 0), (4, 1, 1)], "doc_id long, quality int, toxic int")
    for known in (labels, labels.where("false")):
        rows = quality.quality_scores(docs(*odd_rows), known).collect()
        assert len(rows) == len(odd_rows) and all(r.keep and r.score is None for r in rows)
    assert quality.quality_scores(docs(), labels).count() == 0
