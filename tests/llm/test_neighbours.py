import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from demandspark.llm import neighbours

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, k, is_query):
    ok = {i: np.array(v, np.float32).astype(float) for i, v, _ in rows
          if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    out = {}
    for q in ok:
        if is_query(q):
            s = []
            for i, v in ok.items():
                if i != q and len(v) == len(ok[q]):
                    s.append((-(v @ ok[q]) / (np.sqrt(v @ v) * np.sqrt(ok[q] @ ok[q])), i))
            out[q] = sorted(s)[:k]
    return out


def test_recall_and_scores(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(3000, 24))
    rows = [(i, v[i].tolist(), 0) for i in range(3000)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {}
    for r in neighbours.nearest(df, F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r["query_id"], []).append(r)
    want = brute(rows, 5, lambda i: i % 50 == 0)
    assert set(got) == set(want)
    hits = sum(len({x["vec_id"] for x in got[q]} & {i for _, i in want[q]}) for q in want)
    assert hits / (5 * len(want)) >= 0.97
    for q, rows_ in got.items():
        rows_.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in rows_] == [1, 2, 3, 4, 5]
        assert all(a["score"] >= b["score"] for a, b in zip(rows_, rows_[1:]))
        true = dict((i, -s) for s, i in brute(rows_and(rows, q), 3000, lambda i: i == q)[q])
        assert all(abs(r["score"] - true[r["vec_id"]]) < 1e-12 for r in rows_)


def rows_and(rows, q):
    return rows


def test_several_shards_and_blocks(spark, monkeypatch):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(900, 16))
    df = spark.createDataFrame([(i, v[i].tolist(), 0) for i in range(900)], SCHEMA)
    monkeypatch.setattr(neighbours, "QUERY_BLOCK", 7)
    entries = neighbours.distinct_vectors(df, "vec_id", "embedding", 6)
    index = neighbours.build_index(entries, shard_rows=200)
    assert index.count() == 5
    queries = df.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").cast("array<double>").alias("v"))
    found = {}
    for r in neighbours.search_index(index, queries, 6).collect():
        found.setdefault(r["qid"], set()).add(r["vid"])
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    hit = [len(found[q] & set(np.argsort(-(u @ u[q]))[:6].tolist())) for q in range(0, 900, 20)]
    assert sum(hit) / (6 * 45) > 0.95


def test_edge_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 0), (50, [2.0, 0.0], 0), (1, [1.0, 0.0], 0), (2, [1.0, 0.0], 0), (2, [1.0, 0.0], 0),
            (3, [0.0, 1.0], 0), (4, [0.0, 0.0], 0), (5, None, 0), (6, [nan, 1.0], 0), (7, [inf, 1.0], 0),
            (8, [None, 1.0], 0), (9, [], 0), (100, [0.0, 0.0], 0), (150, [1.0, 2.0, 3.0], 0), (10, [-1.0, 1e-20], 0),
            (11, [3e38, 3e38], 0), (None, [1.0, 1.0], 0)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("v", "vid", "ids", "qid", "dim", "shard", "rank", "h", "score")})
    got = {}
    for r in neighbours.nearest(df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert got == {0: [1, 2, 50, 11, 3], 50: [0, 1, 2, 11, 3]}
    assert neighbours.nearest(df.filter("false"), F.col("vec_id") % 50 == 0).count() == 0


def test_copies_are_found_if_the_search_misses_the_own_vector(spark, monkeypatch):
    rng = np.random.default_rng(8)
    v = rng.normal(size=(60, 8))
    df = spark.createDataFrame([(i, v[i % 20].tolist(), 0) for i in range(60)], SCHEMA)
    search = neighbours.search_index
    monkeypatch.setattr(neighbours, "search_index", lambda *a: search(*a).filter("qid % 20 <> vid"))
    got = {}
    for r in neighbours.nearest(df, F.col("vec_id") < 60).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert all(len(got[q]) == 5 and got[q][:2] == [i for i in range(q % 20, 60, 20) if i != q] for q in range(60))


def test_many_copies_of_one_vector(spark):
    rng = np.random.default_rng(6)
    v = rng.normal(size=(400, 8))
    rows = [(i, v[i if i % 3 else 0].tolist(), 0) for i in range(400)]
    got = {}
    for r in neighbours.nearest(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    for q, nearest in brute(rows, 5, lambda i: i % 50 == 0).items():
        if q % 3 == 0:
            assert got[q] == [i for i in range(0, 400, 3) if i != q][:5]
        else:
            assert len(set(got[q]) & {i for _, i in nearest}) >= 4


@pytest.mark.parametrize("size", [1e200, 1e-200, 1e-310, 1.0])
def test_very_large_and_small_components(spark, size):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(40, 4))
    df = spark.createDataFrame([(i, (v * size).tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = neighbours.nearest(df, F.col("vec_id") % 10 == 0, k=3).collect()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    for q in range(0, 40, 10):
        s = unit @ unit[q]
        s[q] = -2
        mine = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert len(mine) == 3 and all(np.isfinite(r["score"]) for r in mine)
        if size > 1e-300:      # subnormal numbers have lost digits
            assert [r["vec_id"] for r in mine] == np.argsort(-s)[:3].tolist()
            assert np.allclose([r["score"] for r in mine], np.sort(s)[::-1][:3], atol=1e-12)


def test_recall_on_clustered_vectors_in_several_shards(spark, monkeypatch):
    build = neighbours.build_index
    monkeypatch.setattr(neighbours, "build_index", lambda entries: build(entries, 1500))
    rng = np.random.default_rng(10)
    centres = rng.normal(size=(60, 16))
    x = centres[rng.integers(0, 60, 4500)] + rng.normal(0, 0.05, (4500, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = neighbours.nearest(df, F.col("vec_id") % 50 == 0, k=5).collect()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = 0
    for q in range(0, 4500, 50):
        s = unit @ unit[q]
        s[q] = -2
        hits += len(set(np.argsort(-s)[:5].tolist()) & {r["vec_id"] for r in got if r["query_id"] == q})
    assert hits >= 0.9 * 5 * 90
