"""Forecast features, splits, folds, baselines and metrics (FC1-FC6, MET1-MET3).

Lags, rolling means and the 24-row-ahead target are row offsets within each
city ordered by (local_time, row_id), computed with the chunked windows of
``windows`` (bounded partitions whatever the city skew).  Positional splits
use the distributed global row index instead of a single-partition window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandspark.functions import scalars as S
from demandspark.operators import ranking, reshape, windows

# Candidate feature columns, kept when present.
WEATHER_FEATURES = ("temperature", "humidity", "windSpeed", "pressure", "precipIntensity", "cloudCover")
TEMPORAL_FEATURES = ("hour", "day_of_week", "month", "is_weekend", "is_peak_hour")
LAGS = (1, 24, 48, 168)
ROLLING = (6, 12, 24, 48)
TARGET = "target_demand"
ORDER = ("local_time", "row_id")


def feature_columns(df: DataFrame) -> list[str]:
    base = [c for c in (*WEATHER_FEATURES, *TEMPORAL_FEATURES) if c in df.columns]
    return base + [f"demand_lag_{n}" for n in LAGS] + [f"demand_rolling_{n}" for n in ROLLING]


def prepare_features(df: DataFrame, city: str | None = None, horizon: int = 24,
                     by: Sequence[str] = ("city",), chunk_rows: int = windows.DEFAULT_CHUNK_ROWS,
                     keep_unknown: bool = False) -> DataFrame:
    """FC1: FLT1 -> lags + rolling means -> drop incomplete rows -> target ``horizon`` rows ahead.

    The target is taken on the frame *after* the incomplete rows are dropped, as
    the reference does, so it is ``horizon`` complete rows ahead.  The newest
    ``horizon`` rows have no target; ``keep_unknown`` keeps them, with a NULL
    target, for forecasts of hours that have not happened yet.
    """
    data = reshape.filter_city(df, city)
    keep = [c for c in ("row_id", *by, "local_time", "demand", *WEATHER_FEATURES, *TEMPORAL_FEATURES)
            if c in data.columns]
    data = data.select(*keep)
    feats = windows.lags_and_rolling(data, "demand", by, ORDER, LAGS, ROLLING, chunk_rows)
    feats = feats.na.drop(subset=[c for c in feats.columns if c not in by])
    out = windows.lead_target(feats, "demand", horizon, by, ORDER, TARGET, chunk_rows)
    return out if keep_unknown else out.filter(F.col(TARGET).isNotNull())


def time_split(df: DataFrame, test_size: float = 0.2, order: Sequence[str] = ORDER) -> DataFrame:
    """FC2: the first ``int(n * (1 - test_size))`` rows in time order are train.

    Adds ``position`` and ``is_train``.
    """
    idx = ranking.global_row_index(df, list(order), "position")
    n = idx.count()
    cut = int(n * (1 - test_size))
    return idx.withColumn("is_train", F.col("position") < cut)


def time_series_folds(df: DataFrame, n_splits: int = 3, position: str = "position") -> DataFrame:
    """FC3: expanding folds; fold i trains on everything before its test block of n // (n_splits+1) rows.

    Returns (fold, role, rows...) in long form; ``position`` must be 0-based contiguous.
    """
    n = df.count()
    size = n // (n_splits + 1)
    parts = []
    for i in range(n_splits):
        end_train = n - (n_splits - i) * size
        pos = F.col(position)
        parts.append(df.filter(pos < end_train).withColumns({"fold": F.lit(i), "role": F.lit("train")}))
        parts.append(df.filter((pos >= end_train) & (pos < end_train + size))
                     .withColumns({"fold": F.lit(i), "role": F.lit("test")}))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def baseline_lag24(test: DataFrame) -> DataFrame:
    """FC5: prediction = the unscaled 24-row lag (the reference's 'same hour yesterday')."""
    return test.select("row_id", F.lit("baseline").alias("model"), F.col(TARGET).alias("actual"),
                       F.col("demand_lag_24").alias("prediction"))


def seasonal_naive(test: DataFrame) -> DataFrame:
    """FC6: demand at t as the forecast of t + horizon."""
    return test.select("row_id", F.lit("seasonal_naive").alias("model"), F.col(TARGET).alias("actual"),
                       F.col("demand").alias("prediction"))


EPS = 2.220446049250313e-16


def metrics(pred: DataFrame, by: Sequence[str] = ("model",), actual: str = "actual",
            prediction: str = "prediction") -> DataFrame:
    """MET1: MAE, RMSE and MAPE (percent; denominator floored at machine epsilon)."""
    err = F.col(actual) - F.col(prediction)
    return pred.groupBy(*by).agg(
        F.avg(F.abs(err)).alias("mae"),
        F.sqrt(F.avg(err * err)).alias("rmse"),
        (F.avg(F.abs(err) / F.greatest(F.abs(F.col(actual)), F.lit(EPS))) * 100).alias("mape"))


def endpoint_mape(pred: DataFrame, by: Sequence[str] = ("model",), actual: str = "actual",
                  prediction: str = "prediction") -> DataFrame:
    """MET2: the endpoint's signed-division MAPE; rows with a zero actual are skipped."""
    ratio = S.safe_div(F.col(actual) - F.col(prediction), F.col(actual))
    return pred.groupBy(*by).agg((F.avg(F.abs(ratio)) * 100).alias("mape"))


def comparison_table(metric_frames: Sequence[DataFrame]) -> DataFrame:
    """MET3: every model's metrics next to each other, best MAE first."""
    out = metric_frames[0]
    for m in metric_frames[1:]:
        out = out.unionByName(m, allowMissingColumns=True)
    return out.orderBy("mae", "model")
