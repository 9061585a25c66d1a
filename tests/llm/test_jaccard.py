import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from demandspark.llm import jaccard
from demandspark.llm.components import components

from edge import DOC_SCHEMA, edge_docs, edge_rows, empty_docs, prose


def shingles(text):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    return frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows):
    """Sorted (id, class id, links) of all rows."""
    sets = [shingles(r[1]) for r in rows]
    root = list(range(len(rows)))
    links = [0] * len(rows)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                links[i] += 1
                links[j] += 1
                root[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return Counter((r[0], least.get(find(i)), links[i]) for i, r in enumerate(rows))


def result(df):
    return Counter((r["doc_id"], r["class_id"], r["n_links"]) for r in jaccard.near_duplicate_classes(df).collect())


def test_edge_rows(spark):
    assert result(edge_docs(spark)) == brute(edge_rows())
    assert jaccard.near_duplicate_classes(empty_docs(spark)).count() == 0


def near_copies(n, seed, words=150):
    r = random.Random(seed)
    base = prose(seed, words).split()
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(r.randrange(6)):
            w[r.randrange(len(w))] = f"new{r.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def test_near_copies_in_small_tiles(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "TILE_ROWS", 7)
    monkeypatch.setattr(jaccard, "TILE_TEXTS", 5)
    texts = near_copies(60, 1) + near_copies(9, 2, 40) + [prose(100 + i, 80) for i in range(40)] + [prose(100, 80)] * 5
    # a common passage must not chain texts that are otherwise different
    texts += [prose(5, 30) + " " + prose(300 + i, 60) for i in range(30)]
    rows = [(i, t, "en", "a", len(t)) for i, t in enumerate(texts)]
    random.Random(3).shuffle(rows)
    assert result(spark.createDataFrame(rows, DOC_SCHEMA)) == brute(rows)


def test_depth_meets_the_target():
    depth = jaccard.match_depth(0.8, 0.9999)
    assert 1 - (1 - 0.8 ** depth) ** jaccard.TREES >= 0.9999
    assert depth == jaccard.MAX_DEPTH or 1 - (1 - 0.8 ** (depth + 1)) ** jaccard.TREES < 0.9999


def test_verify_counts_exactly():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.choice(200, 60)).astype(np.uint64) for _ in range(30)]
    sets += [np.union1d(s[2:], np.array([999], np.uint64)) for s in sets]
    got = jaccard._verify(sets, np.zeros(60), False, 0.8)
    for i in range(60):
        for j in range(i + 1, 60):
            inter = len(np.intersect1d(sets[i], sets[j]))
            assert got[i, j] == (5 * inter >= 4 * (len(sets[i]) + len(sets[j]) - inter))


def test_surplus_keeps_one_of_each(spark):
    gone = jaccard.surplus(jaccard.near_duplicate_classes(edge_docs(spark)))
    kept = {r[0] for r in edge_rows()} - {r["doc_id"] for r in gone.collect()}
    assert 1 in kept and not {2, 3} & kept and {4, 5, 6, 7, None} <= kept


@pytest.mark.parametrize("edges", [[], [(1, 2)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 30)] + [(50, 51), (51, 52)],
                                   [(3, 1), (1, 3), (3, 3), (None, 2), (9, 7), (8, 7), (8, 3)]])
def test_components(spark, edges):
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = {x for a, b in edges if None not in (a, b) and a != b for x in (a, b)}
    root = {x: x for x in nodes}
    for _ in nodes:
        for a, b in edges:
            if None not in (a, b) and a != b:
                root[a] = root[b] = min(root[a], root[b])
    assert got == root


def test_forest_of_a_dense_tile_stays_small():
    """4,096 rows that are all alike: one edge less than rows, without a list of their 8 million pairs."""
    import tracemalloc

    import numpy as np
    tracemalloc.start()
    forest = jaccard.Forest(4096)
    for i in range(4096):
        forest.link(i, np.arange(i + 1, 4096))
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert len(forest.a) == 4095 and len(set(forest.label.tolist())) == 1
    assert peak < 50_000_000


def test_forest_joins_as_the_pairs_do():
    import numpy as np
    rng = np.random.default_rng(3)
    pairs = {tuple(sorted(p)) for p in rng.integers(0, 60, (40, 2)).tolist() if p[0] != p[1]}
    forest = jaccard.Forest(60)
    for i in range(60):
        forest.link(i, np.array(sorted(b for a, b in pairs if a == i), int))

    def groups(edges):
        root = list(range(60))
        for a, b in edges:
            x, y = root[a], root[b]
            root = [x if r == y else r for r in root]
        return {frozenset(i for i in range(60) if root[i] == r) for r in root}

    assert groups(pairs) == groups(zip(forest.a, forest.b)) and set(zip(forest.a, forest.b)) <= pairs
