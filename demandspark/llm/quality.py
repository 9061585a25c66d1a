"""Quality classifier: regularised quadratic discriminant analysis (operator 3).

Every whole text becomes a vector of transformed document statistics.  Class
means and covariances come from one grouped aggregation over all labelled
training rows; each covariance is shrunk towards the pooled one and towards a
multiple of the identity.  A score is the logistic function of the difference
of the two Mahalanobis log-densities plus the log prior ratio, computed with
Cholesky factors that are inverted once per model.

Edge cases: null and empty texts have the statistics of the empty text and get
a score like any other; rows of ``labels`` with a null label or without a
document are not used, repeated label rows count as often as they occur; with
no or one class in the training rows every score is the smoothed share of
label 1; repeated rows are scored alike; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandspark.llm.common import id_bucket, written

FEATURES = ("log_words", "mean_word", "std_word", "upper", "symbols", "rare_symbols", "digits", "exclaim", "pipes",
            "distinct_words", "distinct_pairs", "repeated_next", "top_word", "word_final_symbol", "short_words",
            "spaces")
POOLED_SHARE = 0.1     # shrinkage towards the pooled covariance
IDENTITY_SHARE = 0.02  # shrinkage towards the mean variance
HELD_OUT_MODULUS = 5
THRESHOLD = 0.3
# Characters of ordinary prose besides letters and digits
_PROSE = frozenset(".,;:'\"!?-()’“”«»¿¡")


def _share(part: float, whole: float) -> float:
    """A share, transformed to stable variance: the arcsine of its square root."""
    return math.asin(math.sqrt(min(1.0, part / whole))) if whole else 0.0


def statistics(text: str) -> list[float]:
    """The transformed statistics of one text, in the order of ``FEATURES``."""
    words = text.split()
    n, nw = len(text), len(words)
    if not nw:
        return [0.0] * len(FEATURES)
    lengths = np.fromiter(map(len, words), np.int64, nw)
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    low = np.bincount(np.minimum(code, 128), minlength=129)
    # ASCII is counted from the table; other characters one distinct kind at a time
    upper, digits = int(low[65:91].sum()), int(low[48:58].sum())
    alnum, blank = upper + digits + int(low[97:123].sum()), int(low[32] + low[9:14].sum())
    rare = sum(int(low[c]) for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in _PROSE)
    exclaim, pipes = int(low[33]), int(low[124])
    if low[128]:
        kinds, counts = np.unique(code[code >= 128], return_counts=True)
        for c, k in zip(kinds.tolist(), counts.tolist()):
            ch = chr(c)
            if ch.isalnum():
                alnum += k
                upper += k * ch.isupper()
                digits += k * ch.isdigit()
            elif ch.isspace():
                blank += k
            elif ch not in _PROSE:
                rare += k
    solid = max(n - blank, 1)
    ids: dict[str, int] = {}
    idx = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, nw)
    pairs = idx[:-1] * len(ids) + idx[1:]
    distinct_pairs = len(np.unique(pairs)) if nw > 1 else 1
    end_symbol = sum(1 for w in words if not w[-1].isalnum() and w[-1] not in ".,")
    return [
        math.log1p(nw), math.log1p(float(lengths.mean())), math.log1p(float(lengths.std())),
        _share(upper, alnum), _share(solid - alnum, solid), _share(rare, solid), _share(digits, solid),
        _share(exclaim, solid), _share(pipes, solid),
        math.log1p(len(ids)) / math.log1p(nw), math.log1p(distinct_pairs) / math.log1p(max(nw - 1, 1)),
        _share(int((idx[:-1] == idx[1:]).sum()), nw), _share(int(np.bincount(idx).max()), nw),
        _share(end_symbol, nw), _share(int((lengths <= 3).sum()), nw), _share(blank, n)]


def document_statistics(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, x): the statistics of every whole text."""
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [statistics(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.list_(pa.float64()))], names=["id", "x"])

    return (df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
            .mapInArrow(run, f"id {id_type}, x array<double>"))


@dataclass(frozen=True)
class QuadraticModel:
    """Class means, inverted Cholesky factors and log terms; ``prior`` is the share of label 1."""
    prior: float
    means: tuple[np.ndarray, np.ndarray] | None = None
    factors: tuple[np.ndarray, np.ndarray] | None = None
    constants: tuple[float, float] | None = None

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of ``x``."""
        if self.means is None:
            return np.full(len(x), self.prior)
        density = [c - 0.5 * (((x - m) @ f.T) ** 2).sum(axis=1)
                   for m, f, c in zip(self.means, self.factors, self.constants)]
        return 1.0 / (1.0 + np.exp(-np.clip(density[1] - density[0], -60, 60)))


def fit(labelled: DataFrame, x_col: str = "x", label_col: str = "label", pooled_share: float = POOLED_SHARE,
        identity_share: float = IDENTITY_SHARE) -> QuadraticModel:
    """Fit on all rows of ``labelled``; only the sums of each class reach the driver."""
    d = len(FEATURES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {0: np.zeros(1 + d + d * d), 1: np.zeros(1 + d + d * d)}
        for batch in batches:
            labels = np.array(batch.column(1).to_pylist())
            x = np.array(batch.column(0).to_pylist(), dtype=float).reshape(-1, d)
            for label in (0, 1):
                part = x[labels == label]
                sums[label] += np.concatenate([[len(part)], part.sum(axis=0), (part.T @ part).ravel()])
        for label, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([label] * len(total)), pa.array(range(len(total))),
                                              pa.array(total)], names=["label", "i", "v"])

    rows = (labelled.filter(F.col(label_col).isin(0, 1)).select(x_col, F.col(label_col).cast("int"))
            .mapInArrow(run, "label long, i long, v double").groupBy("label", "i").agg(F.sum("v").alias("v")).collect())
    total = np.zeros((2, 1 + d + d * d))
    for r in rows:
        total[r["label"], r["i"]] = r["v"]
    n = total[:, 0]
    prior = float((n[1] + 1) / (n.sum() + 2))
    if n.min() < 2:
        return QuadraticModel(prior)
    means = total[:, 1:1 + d] / n[:, None]
    scatter = total[:, 1 + d:].reshape(2, d, d) - n[:, None, None] * means[:, :, None] * means[:, None, :]
    pooled = scatter.sum(axis=0) / n.sum()
    factors, constants = [], []
    for k in (0, 1):
        cov = (1 - pooled_share) * scatter[k] / n[k] + pooled_share * pooled
        cov = (1 - identity_share) * cov + identity_share * (np.trace(cov) / d + 1e-9) * np.eye(d)
        chol = np.linalg.cholesky((cov + cov.T) / 2)
        factors.append(np.linalg.inv(chol))
        constants.append(float(np.log((n[k] + 1) / (n.sum() + 2)) - np.log(np.diag(chol)).sum()))
    return QuadraticModel(prior, (means[0], means[1]), tuple(factors), tuple(constants))


def scored(features: DataFrame, model: QuadraticModel) -> DataFrame:
    """(id, score) of every row of ``features``."""
    id_type = features.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column(1).to_pylist(), dtype=float).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x))], names=["id", "score"])

    return features.select("id", "x").mapInArrow(run, f"id {id_type}, score double")


def held_out(id_col: Column, modulus: int = HELD_OUT_MODULUS) -> Column:
    return id_bucket(id_col, modulus) == 0


def train(features: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> QuadraticModel:
    """Fit on the labelled rows of ``features`` (id, x) that are not held out."""
    truth = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("label")).filter(
        F.col("label").isNotNull() & ~held_out(F.col("id")))
    return fit(features.join(truth, "id"))


def keep(df: DataFrame, model: QuadraticModel, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``df`` with a score of ``threshold`` or more, scored where they are read (no join, no shuffle)."""
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([statistics(t or "") for t in batch.column(at).to_pylist()]).reshape(-1, len(FEATURES))
            yield batch.filter(pa.array(model.score(x) >= threshold))

    return df.mapInArrow(run, df.schema)


def classify(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             label_col: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """(id, held_out, score, predicted) of every row; learns from the rows that are not held out."""
    features = written(document_statistics(df, id_col, text_col), "quality-features")
    out = scored(features, train(features, labels, id_col, label_col))
    return out.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score",
                      (F.col("score") >= threshold).cast("int").alias("predicted"))
