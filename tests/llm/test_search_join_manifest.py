"""Jaccard join, ranked search and Merkle manifest against brute-force versions, with nulls,
empty and very long texts, ties, repeated rows, empty tables and clashing column names."""

import collections
import hashlib
import itertools
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from snipflow.llm import jaccard_join, merkle, ranked_search

SCHEMA = "doc_id bigint, text string, lang string, key string, items string, n bigint, rep bigint, score bigint"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(n, seed, of=400):
    r = random.Random(seed)
    return [f"{r.choice('bcdfgklm')}{r.choice('aeiou')}{r.randrange(of)}" for _ in range(n)]


def texts():
    r = random.Random(3)
    out = [None, "", " \n ", "one", "One", "one two three", "é à ü ö " * 9]
    base = words(90, 1)
    for i in range(40):                       # near copies of one text at many distances
        t = base.copy()
        for _ in range(i % 14):
            t[r.randrange(len(t))] = f"w{r.randrange(10**6)}"
        out.append(" ".join(t))
    for i in range(60):                       # short texts of few words: frequent shingles
        out.append(" ".join(r.choice("abc") for _ in range(r.randrange(4, 30))))
    out += [" ".join(words(60, 9)), " ".join(words(60, 9)).upper(), " ".join(words(190_000, 5, 10**6))]
    return out


def rows():
    t = texts()
    out = [(i, x, [None, "en", "fr", "de"][i % 4], "k", "z", i, i, i) for i, x in enumerate(t)]
    return out + [out[8], out[8], (8, t[20], "en", "k", "z", 0, 0, 0), (None, t[9], "en", "k", "z", 0, 0, 0)]


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# ------------------------------------------------------------ Jaccard join

def shingles(text, width):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i:i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()


def components(data, width, threshold):
    sets = [shingles(r[1], width) for r in data]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    named = [i for i, r in enumerate(data) if r[0] is not None]
    for i, j in itertools.combinations(named, 2):
        same = len(sets[i] & sets[j])
        if sets[i] and sets[j] and 100 * same >= threshold * (len(sets[i]) + len(sets[j]) - same):
            a, b = find(data[i][0]), find(data[j][0])
            parent[max(a, b)] = min(a, b)
    return collections.Counter((r[0], len(s), None if r[0] is None else find(r[0])) for r, s in zip(data, sets))


@pytest.mark.parametrize("threshold,chunk", [(85, 200_000), (85, 150), (60, 200_000)])
def test_jaccard_join_equals_all_pairs(frame, monkeypatch, threshold, chunk):
    monkeypatch.setattr(jaccard_join, "CHUNK_ITEMS", chunk)
    got = jaccard_join.similar_documents(frame, threshold=threshold).collect()
    assert collections.Counter(map(tuple, got)) == components(rows(), 4, threshold)


def test_jaccard_join_of_nothing(empty, spark):
    assert jaccard_join.similar_documents(empty).collect() == []
    blank = spark.createDataFrame([(1, None), (2, ""), (None, "a b c d e")], "doc_id bigint, text string")
    assert sorted(map(tuple, jaccard_join.similar_documents(blank).collect()), key=str) == sorted(
        [(1, 0, 1), (2, 0, 2), (None, 2, None)], key=str)


@pytest.mark.parametrize("threshold", [50, 70, 85, 95])
@pytest.mark.parametrize("limits", [(0, 0), (1, 3), (2, 5), (10**9, 10**9)])
def test_similar_sets_share_an_index_key(monkeypatch, threshold, limits):
    monkeypatch.setattr(jaccard_join, "RARE", limits[0])
    monkeypatch.setattr(jaccard_join, "COMMON", limits[1])
    r = random.Random(threshold)
    token = [r.getrandbits(64) for _ in range(400)]
    for size in (2, 3, 5, 8, 13, 31, 33, 64, 150):
        base = r.sample(range(400), size)
        sets = [set(base)]
        for _ in range(14):
            s = set(base)
            for x in r.sample(base, r.randrange(0, max(1, size // 3) + 1)):
                s.discard(x)
            s.update(r.sample(range(400), r.randrange(0, max(1, size // 5) + 1)))
            sets.append(s or set(base))
        df = collections.Counter(x for s in sets for x in s)
        keys = []
        for s in sets:
            own = sorted(s)
            keys.append(set(jaccard_join.index_keys(np.array([token[x] for x in own], np.uint64),
                                                    np.array([df[x] for x in own]), threshold).tolist()))
        for i, j in itertools.combinations(range(len(sets)), 2):
            same = len(sets[i] & sets[j])
            if sets[i] != sets[j] and 100 * same >= threshold * (len(sets[i]) + len(sets[j]) - same):
                assert keys[i] & keys[j], (size, i, j)


# ------------------------------------------------------------ ranked search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ITEM_SCHEMA = "item_id string, text string, rank int, doc_id bigint"


def items():
    t = texts()
    return [("a", " ".join(t[10].split()[:30]), 0, 0), ("b", "A b, c; b!", 0, 0), ("c", None, 0, 0), ("d", "", 0, 0), ("e", "?? --", 0, 0),
            ("f", "nowhere", 0, 0), (None, "one", 0, 0), ("g", t[-1][:3000], 0, 0), ("b", "A b, c; b!", 1, 1), ("b", "é two", 0, 0)]


def ranked(data, queries, k):
    docs = [(r[0], collections.Counter(TERM.findall((r[1] or "").translate(LOWER)))) for r in data]
    docs = [(i, c, sum(c.values())) for i, c in docs if c]
    n_docs, total = len(docs), sum(n for _, _, n in docs)
    df = collections.Counter(t for _, c, _ in docs for t in c)
    out = collections.Counter()
    for item, text in {(q[0], q[1]) for q in queries if q[1] is not None}:
        times = collections.Counter(TERM.findall(text.translate(LOWER)))
        found = []
        for doc, c, n in docs:
            m = 75 + 25 * n * n_docs // total
            score = sum(x * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m))
                        for t, x in times.items() if t in c)
            if score:
                found.append((-score, doc is None, doc))
        for rank, (score, _, doc) in enumerate(sorted(found, key=lambda x: (x[0], x[1], x[2] or 0))[:k]):
            out[item, rank + 1, doc, -score] += 1
    return out


@pytest.mark.parametrize("k,pass_bytes,postings", [(20, 16 << 20, 1 << 20), (3, 500, 50)])
def test_search_equals_full_scores(spark, frame, monkeypatch, k, pass_bytes, postings):
    monkeypatch.setattr(ranked_search, "PASS_BYTES", pass_bytes)
    monkeypatch.setattr(ranked_search, "BLOCK_POSTINGS", postings)
    got = ranked_search.search(frame, spark.createDataFrame(items(), ITEM_SCHEMA), k=k).collect()
    assert collections.Counter(map(tuple, got)) == ranked(rows(), items(), k)


def test_search_of_nothing(spark, frame, empty):
    some = spark.createDataFrame(items(), ITEM_SCHEMA)
    assert ranked_search.search(empty, some).collect() == []
    assert ranked_search.search(frame, some.limit(0)).collect() == []


def test_search_stops_early_and_keeps_ties():
    r = np.random.default_rng(1)
    docs, terms = 5000, 3
    doc, term = np.repeat(np.arange(docs), terms), np.tile(np.arange(terms), docs)
    quality = np.repeat(r.permutation(docs), terms) // 4 * 4          # four documents tie on each score
    lists = ranked_search.ImpactLists(doc, term, quality.astype(np.int64) + 1, docs, terms)
    ids = r.permutation(docs).astype(np.int64)
    nothing = (np.zeros(0, np.int64), np.zeros(0, np.int64))
    factors = np.array([5, 7, 1], np.int64)
    best, read = lists.search(np.arange(terms), factors, ids, nothing, 10)
    score = (quality[::terms].astype(np.int64) + 1) * factors.sum()
    want = sorted(zip((-score).tolist(), ids.tolist()))[:10]
    assert list(zip((-best[0]).tolist(), best[1].tolist())) == want
    assert read < docs * terms / 20
    again, _ = lists.search(np.arange(terms), factors, ids, nothing, 10)   # nothing stays marked
    assert (again[1] == best[1]).all()
    # a bar from an earlier block ends the search in the first round
    high = (np.full(10, 10**9, np.int64), np.arange(10))
    kept, read = lists.search(np.arange(terms), factors, ids, high, 10)
    assert (kept[0] == high[0]).all() and read <= terms * ranked_search.FIRST_DEPTH


# ------------------------------------------------------------ Merkle manifest

def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(digests):
    """(last node, path of (left, right) per leaf)."""
    paths, spans = [[] for _ in digests], [[i] for i in range(len(digests))]
    while len(digests) > 1:
        runs = [list(range(a, min(a + 8, len(digests)))) for a in range(0, len(digests), 8)]
        for run in runs:
            for x in run:
                left, right = ("".join(digests[y] for y in run if (y < x) == side and y != x) for side in (True, False))
                for leaf in spans[x]:
                    paths[leaf].append((left, right))
        spans = [[leaf for x in run for leaf in spans[x]] for run in runs]
        digests = [h(*[digests[x] for x in run]) for run in runs]
    return digests[0], paths


def manifests(data):
    leaves = [(r[2], r[0], h(field(r[0]), field(r[2]), field(r[1])), h(field(r[0]), field(r[2]), field(r[1] and r[1].translate(LOWER)))) for r in data]
    groups = collections.defaultdict(list)
    for x in leaves:
        groups[x[0]].append(x)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        groups[g].sort(key=lambda x: (x[1] is not None, x[1] or 0, x[2]))
        trees[g] = tree([x[2] for x in groups[g]])
    root, above = tree([trees[g][0] for g in order])
    out = collections.Counter()
    for k, g in enumerate(order):
        for x, path in zip(groups[g], trees[g][1]):
            path = path + above[k]
            at = x[3] if x[1] is not None and x[1] % 2 else x[2]
            for a, b in path:
                at = h(a, at, b)
            out[x[1], x[2], trees[g][0], root, h(*[a + b for a, b in path]), at] += 1
    return out


def manifest(df):
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    fields = [F.col("doc_id"), F.col("lang"), F.col("text")]
    altered = F.when(F.col("doc_id") % 2 == 1, merkle.leaf_hash(F.col("doc_id"), F.col("lang"), lower))
    out = merkle.manifest(df, fields, F.col("doc_id"), F.col("lang"), altered)
    return out.select("id", "leaf", "subroot", "root", merkle.proof_hash(F.col("path")), merkle.folded(F.col("altered"), F.col("path")))


@pytest.mark.parametrize("part", [250_000, 7])
def test_manifest_equals_recursion(frame, monkeypatch, part):
    monkeypatch.setattr(merkle, "PART_ROWS", part)
    assert collections.Counter(map(tuple, manifest(frame).collect())) == manifests(rows())


@pytest.mark.parametrize("data", [
    [],
    [(1, "A", "en")],
    [(None, None, None), (None, None, None), (3, "x", None)],
    [(i, "T", f"é{i % 70:02d}") for i in range(80)],
    [(i, "B" * (i % 3), "en") for i in range(65)],
], ids=["none", "one", "nulls", "many groups", "one group"])
def test_manifest_shapes(spark, data):
    df = spark.createDataFrame(data, "doc_id bigint, text string, lang string")
    got = collections.Counter(map(tuple, manifest(df).collect()))
    assert got == (manifests(data) if data else collections.Counter())
