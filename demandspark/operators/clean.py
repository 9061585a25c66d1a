"""Cleaning and repair (PRJ5, CLN1-CLN3, REP1-REP3).

Group statistics (city medians, similar-hour means) are small tables joined
back on their keys; global statistics (overall medians, min/max, q01/q99)
are one bounded row read back as literals, the way a fitted scaler is.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandspark.functions import scalars as S
from demandspark.operators import ranking, rollup
from demandspark.session import cut_lineage

# Columns the min-max step never scales.
NORMALIZE_EXCLUDE = ("hour", "day_of_week", "month", "year", "day", "is_weekend", "is_peak_hour")

REPAIR_WEATHER = ("temperature", "humidity", "windSpeed")


def drop_sparse_columns(df: DataFrame, max_null_pct: float = 50.0) -> DataFrame:
    """PRJ5: drop columns with more than ``max_null_pct`` percent NULLs (one scan)."""
    prof = rollup.null_profile(df).filter(F.col("null_pct") > max_null_pct).select("column")
    drop = [r["column"] for r in prof.collect()]  # at most one row per column
    return df.drop(*drop)


def impute_median(df: DataFrame, cols: Sequence[str] | None = None, by: str | None = "city",
                  method: str = "exact") -> DataFrame:
    """CLN1: NULLs -> the group median, then -> the overall median of the filled column.

    Only columns that contain NULLs are touched.  The overall median is taken
    after the group fill, as the reference does.
    """
    cols = list(cols or rollup.numeric_columns(df, exclude=[by] if by else []))
    nulls = ranking.first_row(df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols]))
    cols = [c for c in cols if nulls[c] > 0]
    if not cols:
        return df
    out = df
    if by and by in df.columns:
        med = ranking.medians(df, cols, by=[by], method=method)
        out = ranking.join_groups(out, med, [by]).withColumns(
            {c: F.coalesce(F.col(c), F.col(f"{c}_median")) for c in cols}
        ).drop(*[f"{c}_median" for c in cols])
    overall = ranking.first_row(ranking.medians(out, cols, method=method))
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(overall[f"{c}_median"]).cast("double"))
                            for c in cols})


def impute_mode(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """CLN2: string NULLs -> the column's mode (smallest of the most frequent)."""
    cols = list(cols or rollup.string_columns(df))
    if not cols:
        return df
    long = df.select(*cols).unpivot([], cols, "column", "value")   # all columns in one pass
    modes = {r["column"]: r["mode"] for r in ranking.mode(long, "value", ["column"], "mode").collect()}
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in modes.items()})


def handle_missing_values(df: DataFrame, by: str = "city") -> DataFrame:
    """PRJ5 -> CLN1 -> CLN2, the reference's missing-value stage."""
    out = drop_sparse_columns(df)
    numeric = rollup.numeric_columns(out, exclude=["row_id"])
    out = impute_median(out, numeric, by)
    return impute_mode(out, rollup.string_columns(out, exclude=[by]))


def min_max(df: DataFrame, cols: Sequence[str] | None = None,
            exclude: Sequence[str] = NORMALIZE_EXCLUDE, suffix: str = "_normalized") -> DataFrame:
    """CLN3: ``<c>_normalized = (x - min) / (max - min)`` per column; constant column -> 0."""
    cols = list(cols or rollup.numeric_columns(df, exclude=[*exclude, "row_id"]))
    stats = ranking.first_row(df.agg(*[e for c in cols for e in
                                       (F.min(c).alias(f"lo_{c}"), F.max(c).alias(f"hi_{c}"))]))
    out = {}
    for c in cols:
        lo, hi = stats[f"lo_{c}"], stats[f"hi_{c}"]
        if lo is None:
            out[f"{c}{suffix}"] = F.lit(None).cast("double")
            continue
        rng = float(hi) - float(lo)
        scaled = (F.col(c) - F.lit(float(lo))) / F.lit(rng) if rng != 0 else F.lit(0.0)
        out[f"{c}{suffix}"] = F.when(F.col(c).isNotNull(), scaled.cast("double"))
    return df.withColumns(out)


# --- repair -----------------------------------------------------------------------------

def handle_anomalies(df: DataFrame, detections: DataFrame, key: str = "row_id",
                     city: str = "city", method: str = "exact") -> DataFrame:
    """REP3 = REP1 + REP2 on a frame with calendar parts (hour, day_of_week).

    A flagged row's weather value outside that column's global [q01, q99] is
    set to the city median (REP1).  A flagged row's demand outside its own
    [q01, q99] becomes the mean demand of unflagged rows with the same (city,
    hour, day_of_week), else the city median (REP2).  All statistics come from
    the pre-repair frame.
    """
    # read by the repair and by the similar-hour means: written once
    flagged = cut_lineage(detections.select(key).distinct().withColumn("_flag", F.lit(True)))
    cols = [c for c in (*REPAIR_WEATHER, "demand") if c in df.columns]
    if not cols:
        return df
    qs = ranking.first_row(ranking.quantiles_wide(df, cols, [0.01, 0.99], method=method))
    med = ranking.medians(df, cols, by=[city], method=method)
    out = ranking.join_groups(df.join(flagged, key, "left"), med, [city])
    is_flag = F.coalesce(F.col("_flag"), F.lit(False))

    def outside(c):
        lo, hi = qs[f"{c}_q01"], qs[f"{c}_q99"]
        return is_flag & ((F.col(c) < F.lit(lo)) | (F.col(c) > F.lit(hi)))

    repl = {c: F.when(outside(c), F.col(f"{c}_median")).otherwise(F.col(c))
            for c in cols if c != "demand"}
    if "demand" in cols:
        keys = [city, "hour", "day_of_week"]
        similar = (df.join(flagged, key, "left_anti").groupBy(*keys)
                   .agg(F.avg("demand").alias("_similar")))
        out = ranking.join_groups(out, similar, keys)
        repl["demand"] = F.when(outside("demand"),
                                F.coalesce(F.col("_similar"), F.col("demand_median"))
                                ).otherwise(F.col("demand"))
    out = out.withColumns(repl)
    return out.drop("_flag", "_similar", *[f"{c}_median" for c in cols])


def engineer_features(df: DataFrame, ts: str = "local_time") -> DataFrame:
    """FN4-FN14: calendar parts, season, weekend, time of day, ratio, peak flag."""
    t = F.col(ts)
    out = df.withColumns({"hour": S.hour(t), "day_of_week": S.day_of_week(t), "day_name": S.day_name(t),
                          "month": F.month(t), "year": F.year(t), "day": F.dayofmonth(t)})
    out = out.withColumns({"season": S.season("month"), "is_weekend": S.is_weekend("day_of_week"),
                           "time_of_day": S.time_of_day("hour")})
    if "demand" in df.columns and "temperature" in df.columns:
        out = out.withColumn("temp_demand_ratio", S.temp_demand_ratio("demand", "temperature"))
    if "demand" in df.columns:
        out = out.withColumn("is_peak_hour", S.is_peak_hour("hour"))
    return out
