"""Scaling, feature assembly and PCA (ML1-ML6).

A fitted scaler is a handful of numbers (mean and population std per column);
it is computed in one distributed ``agg`` and kept as a small model that can
be saved, reloaded and applied as column expressions (no UDF, no collect of
data).  PCA uses MLlib, whose covariance is a d x d Gramian summed across
partitions (d = number of features, here at most a few dozen).
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandspark.operators import ranking

# The clustering feature list.
CLUSTER_FEATURES = ("demand", "temperature", "humidity", "windSpeed", "hour", "day_of_week", "month")
# The cluster endpoint's features, kept when present.
ENDPOINT_FEATURES = ("hour", "day_of_week", "demand", "temperature")


@dataclass
class ScalerModel:
    """Per-column mean and population standard deviation (ML2)."""
    cols: list[str]
    mean: dict[str, float] = field(default_factory=dict)
    std: dict[str, float] = field(default_factory=dict)

    def transform(self, df: DataFrame, suffix: str = "") -> DataFrame:
        """``(x - mean) / std``; a constant column (std 0) maps to 0."""
        out = {}
        for c in self.cols:
            m, s = self.mean[c], self.std[c]
            centred = F.col(c).cast("double") - F.lit(m)
            out[f"{c}{suffix}"] = centred / F.lit(s) if s else centred * F.lit(0.0)
        return df.withColumns(out)

    def to_json(self) -> str:
        return json.dumps({"cols": self.cols, "mean": self.mean, "std": self.std})

    @classmethod
    def from_json(cls, text: str) -> "ScalerModel":
        d = json.loads(text)
        return cls(d["cols"], d["mean"], d["std"])


def fit_scaler(df: DataFrame, cols: Sequence[str]) -> ScalerModel:
    """ML2: statistics from the training frame only (one aggregate row)."""
    cols = list(cols)
    row = ranking.first_row(df.agg(*[e for c in cols for e in
                                     (F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}"))]))
    return ScalerModel(cols, {c: float(row[f"m_{c}"] or 0.0) for c in cols},
                       {c: float(row[f"s_{c}"] or 0.0) for c in cols})


def standardize(df: DataFrame, cols: Sequence[str], suffix: str = "") -> DataFrame:
    """ML1: mean 0, population std 1 (constant column -> 0)."""
    return fit_scaler(df, cols).transform(df, suffix)


def present(df: DataFrame, cols: Sequence[str]) -> list[str]:
    return [c for c in cols if c in df.columns]


def assemble(df: DataFrame, cols: Sequence[str], out: str = "features",
             handle_invalid: str = "skip") -> DataFrame:
    """ML6: feature columns -> one vector column (rows with NULLs skipped by default)."""
    return VectorAssembler(inputCols=list(cols), outputCol=out,
                           handleInvalid=handle_invalid).transform(df)


@dataclass
class PcaResult:
    scores: DataFrame           # input columns + pc1..pck
    explained_pct: list[float]  # explained variance ratio in percent
    loadings: DataFrame         # (feature, pc1..pck)
    model: object


def pca(df: DataFrame, cols: Sequence[str], k: int = 2, features: str = "features") -> PcaResult:
    """ML3: principal components of already standardised ``cols``.

    Signs are fixed so that the largest-magnitude loading of each component is
    positive (eigenvectors are only defined up to sign).
    """
    cols = list(cols)
    data = df if features in df.columns else assemble(df, cols, features)
    model = PCA(k=k, inputCol=features, outputCol="_pca").fit(data)
    pc = model.pc.toArray()  # d x k, d = len(cols): tiny
    signs = [1.0 if pc[abs(pc[:, j]).argmax(), j] >= 0 else -1.0 for j in range(k)]
    arr = vector_to_array("_pca")
    scores = model.transform(data).withColumns({f"pc{j + 1}": arr[j] * F.lit(signs[j]) for j in range(k)}).drop("_pca")
    spark = df.sparkSession
    rows = [(c, *[float(pc[i, j] * signs[j]) for j in range(k)]) for i, c in enumerate(cols)]
    loadings = spark.createDataFrame(rows, ["feature", *[f"pc{j + 1}" for j in range(k)]])
    explained = [float(v) * 100.0 for v in model.explainedVariance.toArray()]
    return PcaResult(scores, explained, loadings, (model, signs))


def project(result: PcaResult, centres: DataFrame, features: str = "features") -> DataFrame:
    """ML5: cluster centres (already in scaled feature space) into PCA space."""
    model, signs = result.model
    out = model.setInputCol(features).setOutputCol("_pca").transform(centres)
    arr = vector_to_array("_pca")
    return out.withColumns({f"pc{j + 1}": arr[j] * F.lit(s) for j, s in enumerate(signs)}).drop("_pca")
