"""Isolation forest (ANO3; Liu, Ting and Zhou, 2008), grown and scored on Spark.

* Sampling: row r belongs to tree t's sample when ``xxhash64(row_id, t, seed)``
  falls under a threshold chosen for about 1.2 x ``max_samples`` rows per
  tree; each tree then keeps its ``max_samples`` smallest hashes (a window per
  tree over at most a few hundred rows).  No tree reads more than its sample.
* Growing: ``groupBy(tree).applyInPandas`` builds each tree with a numpy
  random state seeded by (seed, tree); the forest is a table of at most
  n_trees x (2 x max_samples) nodes -- bounded, independent of the data size
  -- and is broadcast to the scorers.
* Scoring: ``mapInPandas`` walks every row down every tree (vectorised per
  batch) and turns the mean path length into the anomaly score
  ``2 ** (-E[h] / c(max_samples))``.
* Cut: a row is an anomaly when its score exceeds the (1 - contamination)
  quantile of all scores, computed exactly by the distributed sort-and-rank.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from demandspark.operators import ranking
from demandspark.session import cut_lineage

NODE_SCHEMA = "tree int, node int, feature int, threshold double, left int, right int, size long"
FEATURES = ("demand", "temperature", "humidity", "windSpeed")


def _c(n: float) -> float:
    """Average path length of an unsuccessful binary-search-tree search over n points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (np.log(n - 1.0) + np.euler_gamma) - 2.0 * (n - 1.0) / n


def _grow(x: np.ndarray, rng: np.random.RandomState, max_depth: int) -> list[tuple]:
    """Nodes (id, feature, threshold, left, right, size); leaves have feature -1."""
    nodes: list[list] = []

    def build(idx: np.ndarray, depth: int) -> int:
        me = len(nodes)
        nodes.append([me, -1, 0.0, -1, -1, len(idx)])
        if depth >= max_depth or len(idx) <= 1:
            return me
        sub = x[idx]
        lo, hi = sub.min(axis=0), sub.max(axis=0)
        usable = np.nonzero(hi > lo)[0]
        if len(usable) == 0:
            return me
        f = int(usable[rng.randint(len(usable))])
        thr = float(rng.uniform(lo[f], hi[f]))
        left = idx[sub[:, f] < thr]
        right = idx[sub[:, f] >= thr]
        nodes[me][1], nodes[me][2] = f, thr
        nodes[me][3] = build(left, depth + 1)
        nodes[me][4] = build(right, depth + 1)
        return me

    build(np.arange(len(x)), 0)
    return [tuple(n) for n in nodes]


def fit(df: DataFrame, cols: Sequence[str] = FEATURES, n_trees: int = 100, max_samples: int = 256,
        seed: int = 42, key: str = "row_id") -> DataFrame:
    """Grow the forest; returns the node table (NODE_SCHEMA)."""
    cols = list(cols)
    data = df.na.drop(subset=cols).select(key, *[F.col(c).cast("double").alias(c) for c in cols])
    n = data.count()
    psi = int(min(max_samples, n))
    frac = min(1.0, 1.2 * psi / max(n, 1) + 50.0 / max(n, 1))
    limit = min(int(frac * 2 ** 63), 2 ** 63 - 1)
    trees = F.filter(F.sequence(F.lit(0), F.lit(n_trees - 1)),
                     lambda t: F.xxhash64(F.col(key), t, F.lit(seed)).bitwiseAND(F.lit(2 ** 63 - 1)) <= F.lit(limit))
    member = data.select("*", F.explode(trees).alias("tree"))
    member = member.withColumn("_h", F.xxhash64(F.col(key), F.col("tree"), F.lit(seed + 1)))
    member = member.withColumn("_rk", F.row_number().over(Window.partitionBy("tree").orderBy("_h", key)))
    sample = member.filter(F.col("_rk") <= psi).drop("_h", "_rk")
    max_depth = int(np.ceil(np.log2(max(psi, 2))))

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        t = int(pdf["tree"].iloc[0])
        rng = np.random.RandomState((seed * 1_000_003 + t) % (2 ** 32))
        x = pdf.sort_values(key)[cols].to_numpy(dtype=np.float64)
        nodes = _grow(x, rng, max_depth)
        out = pd.DataFrame(nodes, columns=["node", "feature", "threshold", "left", "right", "size"])
        out.insert(0, "tree", t)
        return out.astype({"tree": "int32", "node": "int32", "feature": "int32", "left": "int32",
                           "right": "int32", "size": "int64"})

    return sample.groupBy("tree").applyInPandas(grow, NODE_SCHEMA)


def score(df: DataFrame, forest: DataFrame, cols: Sequence[str] = FEATURES, max_samples: int = 256,
          key: str = "row_id") -> DataFrame:
    """(row_id, score) for every complete row; higher means more isolated."""
    cols = list(cols)
    nodes = forest.orderBy("tree", "node").collect()  # bounded: n_trees x (2 x max_samples) rows
    by_tree: dict[int, np.ndarray] = {}
    for r in nodes:
        by_tree.setdefault(r["tree"], []).append((r["feature"], r["threshold"], r["left"], r["right"], r["size"],
                                                  _c(r["size"])))  # a leaf's correction, looked up per row
    packed = {t: np.array(v, dtype=np.float64) for t, v in by_tree.items()}
    bc = df.sparkSession.sparkContext.broadcast(packed)
    n_sample = max(2, min(max_samples, int(max(v[0, 4] for v in packed.values()))))
    cn = _c(n_sample)

    def walk(it):
        forest_ = bc.value
        for pdf in it:
            x = pdf[cols].to_numpy(dtype=np.float64)
            total = np.zeros(len(x))
            for tree in forest_.values():
                node = np.zeros(len(x), dtype=np.int64)
                depth = np.zeros(len(x))
                active = tree[node, 0] >= 0
                while active.any():
                    f = tree[node[active], 0].astype(np.int64)
                    thr = tree[node[active], 1]
                    go_left = x[active, f] < thr
                    node[active] = np.where(go_left, tree[node[active], 2], tree[node[active], 3]).astype(np.int64)
                    depth[active] += 1
                    active = tree[node, 0] >= 0
                total += depth + tree[node, 5]
            mean = total / len(forest_)
            yield pd.DataFrame({key: pdf[key].to_numpy(), "score": np.power(2.0, -mean / cn)})

    data = df.na.drop(subset=cols).select(key, *[F.col(c).cast("double").alias(c) for c in cols])
    return data.mapInPandas(walk, f"{key} long, score double")


def forest_anomalies(df: DataFrame, cols: Sequence[str] = FEATURES, contamination: float = 0.01,
                     n_trees: int = 100, max_samples: int = 256, seed: int = 42,
                     key: str = "row_id") -> DataFrame:
    """ANO3 as a detector: (row_id, 'isolation_forest') for the ``contamination`` share of
    rows with the highest scores."""
    cols = [c for c in cols if c in df.columns]
    # read by the quantile and by the filter; written once, so that no cache outlives the call
    scores = cut_lineage(score(df, fit(df, cols, n_trees, max_samples, seed, key), cols, max_samples, key))
    cut = ranking.first_row(ranking.quantiles_wide(scores, ["score"], [1.0 - contamination],
                                                   fmt="cut"))["cut"]
    return scores.filter(F.col("score") > F.lit(cut)).select(key, F.lit("isolation_forest").alias("detector"))
