"""Anomaly detection (ANO1, ANO2, ANO4, ANO5); the isolation forest (ANO3) is in ``iforest``.

Detectors return a long table (row_id, detector): a row flagged by several
detectors appears once per detector, and ``combine`` de-duplicates by row_id.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandspark.functions import scalars as S
from demandspark.operators import windows

# Physical limits (column, low, high); NULL means no bound.
RANGE_RULES = (
    ("temperature", -50.0, 130.0),
    ("humidity", 0.0, 100.0),
    ("windSpeed", 0.0, 150.0),
    ("demand", 0.0, None),
)

ZSCORE_COLUMNS = ("demand", "temperature", "humidity", "windSpeed")
ZSCORE_THRESHOLD = 3.0
SPIKE_THRESHOLD = 0.5


def range_violation(col: str, lo: float | None, hi: float | None):
    """FLT4: ``x < lo OR x > hi``."""
    c = F.col(col)
    cond = F.lit(False)
    if lo is not None:
        cond = cond | (c < lo)
    if hi is not None:
        cond = cond | (c > hi)
    return cond


def range_anomalies(df: DataFrame, key: str = "row_id") -> DataFrame:
    """ANO1: rows outside physical limits, as (row_id, detector)."""
    return _flagged(df, range_flags(df), key)


def zscore_anomalies(df: DataFrame, cols: Sequence[str] = ZSCORE_COLUMNS, by: str | None = "city",
                     threshold: float = ZSCORE_THRESHOLD, key: str = "row_id") -> DataFrame:
    """ANO2: rows whose group z-score exceeds ``threshold``."""
    z = windows.group_zscore(df, cols, [by] if by else None)
    return _flagged(z, zscore_flags(z, cols, threshold), key)


def range_flags(df: DataFrame) -> dict:
    """Detector name -> condition of every range rule whose column is present."""
    return {f"range_{c}": range_violation(c, lo, hi) for c, lo, hi in RANGE_RULES if c in df.columns}


def zscore_flags(z: DataFrame, cols: Sequence[str], threshold: float) -> dict:
    return {f"zscore_{c}": F.col(f"{c}_zscore") > threshold for c in cols if f"{c}_zscore" in z.columns}


def _flagged(df: DataFrame, flags: dict, key: str) -> DataFrame:
    """(key, detector) rows of all true flags, in one pass over ``df``."""
    if not flags:
        raise ValueError("no detector applies to this frame")
    names = F.filter(F.array(*[F.when(cond, F.lit(name)) for name, cond in flags.items()]), lambda x: x.isNotNull())
    return df.select(key, F.explode(names).alias("detector"))


def spike_days(df: DataFrame, value: str = "demand", by: str = "city", ts: str = "local_time",
               threshold: float = SPIKE_THRESHOLD, cross_city: bool = False) -> DataFrame:
    """Days whose mean moved by more than ``threshold`` against the previous day.

    A zero previous mean counts as a spike when the day's mean is not zero
    (the reference's division gives +-inf there).
    """
    d = windows.daily_pct_change(df, value, by, ts, cross_city, keep_previous=True)
    pct = F.col(f"{value}_pct_change")
    prev_zero = (F.col("previous_mean") == 0) & (F.col(f"{value}_mean") != 0)
    return d.filter((pct > threshold) | (pct < -threshold) | prev_zero).drop("previous_mean")


def spike_anomalies(df: DataFrame, value: str = "demand", by: str = "city", ts: str = "local_time",
                    threshold: float = SPIKE_THRESHOLD, cross_city: bool = False,
                    key: str = "row_id") -> DataFrame:
    """ANO4: every row of a spike day (a left-semi join on (city, date))."""
    days = spike_days(df, value, by, ts, threshold, cross_city).select(by, "date")
    rows = df.withColumn("date", S.date_part(ts)).join(days, [by, "date"], "left_semi")
    return rows.select(key, F.lit("spike").alias("detector"))


def combine(detections: Sequence[DataFrame], key: str = "row_id") -> DataFrame:
    """SET2 + SET3: union of detector outputs, one row per (row_id, detector)."""
    return _union(list(detections), key).dropDuplicates([key, "detector"])


def detect_anomalies(df: DataFrame, include_forest: bool = False, key: str = "row_id",
                     cross_city: bool = False, **forest_args) -> DataFrame:
    """ANO5: long (row_id, detector) table of all detectors.

    Range rules, z-scores and spike days are flags of one pass over the rows;
    the city statistics and the spike days are small tables joined to it.  A
    (row, detector) pair occurs once when ``key`` is unique.
    """
    z = windows.group_zscore(df, ZSCORE_COLUMNS, ["city"])
    days = spike_days(df, cross_city=cross_city).select("city", "date", F.lit(True).alias("_spike"))
    z = windows.attach_group_stat(z.withColumn("date", S.date_part("local_time")), days, ["city", "date"])
    flags = {**range_flags(df), **zscore_flags(z, ZSCORE_COLUMNS, ZSCORE_THRESHOLD), "spike": F.col("_spike")}
    rows = _flagged(z, flags, key)
    if include_forest:
        from demandspark.operators import iforest
        rows = rows.unionByName(iforest.forest_anomalies(df, key=key, **forest_args))
    return rows


def anomaly_rows(df: DataFrame, detections: DataFrame, key: str = "row_id") -> DataFrame:
    """The flagged rows, once each (JN2 semi join)."""
    return df.join(detections.select(key).distinct(), key, "left_semi")


def detector_counts(detections: DataFrame) -> DataFrame:
    return detections.groupBy("detector").agg(F.count(F.lit(1)).alias("rows"))


def _union(parts: list[DataFrame], key: str) -> DataFrame:
    if not parts:
        raise ValueError("no detector applies to this frame")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
