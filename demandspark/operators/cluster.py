"""K-Means, K selection, Ward's hierarchy and quick silhouettes (CLU1-3, CLU7, CLU10, CLU11).

K-Means restarts and the K sweep are fitted together by ``kmeans_batch``:
every Lloyd iteration is one distributed pass producing per-centre sums for
all models, so the data is never gathered and never re-read per model; only
centres (models x k x d numbers) live on the driver.  Labels are assigned by
a JVM-side nearest-centre expression.  The hierarchy is that of ``ward``.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandspark.operators import kmeans_batch, ward


@dataclass
class KMeansFit:
    k: int
    centres: np.ndarray
    cost: float
    seed: int
    iterations: int = 0


def _fits(df: DataFrame, jobs: Sequence[tuple[int, int]], features: str, max_iter: int, tol: float):
    raw = kmeans_batch.fit_many(df, jobs, features, max_iter, tol)
    return [KMeansFit(r["k"], r["centres"], r["cost"], r["seed"], r["iterations"]) for r in raw], raw


def kmeans(df: DataFrame, k: int, n_init: int = 10, seed: int = 42, features: str = "features",
           max_iter: int = 300, tol: float = 1e-4) -> KMeansFit:
    """CLU1: best of ``n_init`` k-means++ starts by within-cluster sum of squares.

    All starts are fitted together (one data pass per iteration); ``tol`` is
    relative to the mean feature variance, as in the reference.
    """
    fits, _ = _fits(df, [(k, seed + i) for i in range(max(1, n_init))], features, max_iter, tol)
    return min(fits, key=lambda f: (f.cost, f.seed))


def assign(fit: KMeansFit, df: DataFrame, label: str = "label", features: str = "features") -> DataFrame:
    """Nearest-centre labels for every row."""
    return df.withColumn(label, kmeans_batch.nearest_centre(features, fit.centres))


def centres(fit: KMeansFit, spark) -> DataFrame:
    """The k centres as a (cluster, features) frame."""
    rows = [(i, Vectors.dense([float(v) for v in c])) for i, c in enumerate(fit.centres)]
    return spark.createDataFrame(rows, ["cluster", "features"])


def silhouette_fast(df: DataFrame, label: str = "label", features: str = "features") -> float | None:
    """CLU10: MLlib's linear-time silhouette on squared Euclidean distance."""
    if df.select(label).distinct().limit(2).count() < 2:
        return None
    ev = ClusteringEvaluator(featuresCol=features, predictionCol=label,
                             metricName="silhouette", distanceMeasure="squaredEuclidean")
    return float(ev.evaluate(df))


def kmeans_sweep(df: DataFrame, ks: Sequence[int] = range(2, 15), n_init: int = 10, seed: int = 42,
                 features: str = "features", silhouette=None, max_iter: int = 300,
                 tol: float = 1e-4, return_fits: bool = False):
    """CLU2: (k, ssd, silhouette) per K.

    Every (K, start) model is fitted in the same passes over the data, and the
    squared-Euclidean silhouettes of the K winners come from one more pass
    (CLU10's definition).  ``silhouette(frame, label)`` substitutes another score.
    With ``return_fits`` the best fit per K comes back too, so a caller does
    not refit the chosen K.
    """
    spark = df.sparkSession
    jobs = [(int(k), seed + i) for k in ks for i in range(max(1, n_init))]
    fits, raw = _fits(df, jobs, features, max_iter, tol)
    best: dict[int, int] = {}
    for i, f in enumerate(fits):
        if f.k not in best or (f.cost, f.seed) < (fits[best[f.k]].cost, fits[best[f.k]].seed):
            best[f.k] = i
    order = sorted(best)
    if silhouette is None:
        scores = kmeans_batch.silhouette_many(df, [raw[best[k]] for k in order], features)
    else:
        scores = [silhouette(assign(fits[best[k]], df, "_k", features), "_k") for k in order]
    rows = [(k, fits[best[k]].cost, s) for k, s in zip(order, scores)]
    sweep = spark.createDataFrame(rows, "k int, ssd double, silhouette double")
    return (sweep, {k: fits[best[k]] for k in order}) if return_fits else sweep


def choose_k(sweep: DataFrame, ref_offset: int = 1) -> DataFrame:
    """CLU3: ``best_k`` has the highest silhouette (ties -> smallest K);
    ``reference_rule_k`` is the reference's 'one above the best' rule
    (``ref_offset``), clipped to the swept range."""
    best = sweep.agg(F.min_by("k", F.struct(-F.col("silhouette"), F.col("k"))).alias("best_k"),
                     F.max("k").alias("_hi"))
    return best.select("best_k", F.least(F.col("best_k") + ref_offset, F.col("_hi")).alias("reference_rule_k"))


def hierarchical(df: DataFrame, k: int = 5, features: str = "features", label: str = "hierarchical_cluster",
                 max_features: int = ward.MAX_FEATURES) -> DataFrame:
    """CLU7: Ward's hierarchy cut to k clusters, labels 1..min(k, distinct points) from the largest on.

    Exact while the table has at most ``max_features`` distinct points; beyond
    that the merges are over that many clustering features.
    """
    return ward.fit(df, features, max_features).label(df, k, features, label)


def compare_algorithms(rows: Sequence[tuple[str, int, float | None, int]], spark) -> DataFrame:
    """CLU11: (algorithm, clusters, silhouette, noise points) for each method."""
    return spark.createDataFrame(list(rows), "algorithm string, clusters int, silhouette double, noise int")
