"""Aggregations (AGG1-AGG15): calendar rollups, describe, null profile, stats.

All are ``groupBy().agg()`` with declarative aggregates, so Spark runs a
partial (map-side) aggregate before the shuffle; a hot key only sends one
partial row per map task.  Holistic statistics (quantiles, mode) go through
``ranking`` instead of buffering whole groups.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from demandspark.functions import scalars as S
from demandspark.operators import ranking

_STAT = {
    "mean": F.avg, "min": F.min, "max": F.max, "sum": F.sum, "std": F.stddev_samp,
    "count": F.count,
}

# The rollup statistics of the daily and weekly tables.
DAILY_STATS = {
    "demand": ["mean", "min", "max", "sum", "std"],
    "temperature": ["mean", "min", "max", "std"],
    "humidity": ["mean", "min", "max"],
    "windSpeed": ["mean", "max"],
}
WEEKLY_STATS = {
    "demand": ["mean", "min", "max", "sum", "std"],
    "temperature": ["mean", "min", "max", "std"],
    "humidity": ["mean"],
    "windSpeed": ["mean"],
}


def stat_exprs(df: DataFrame, spec: Mapping[str, Sequence[str]]) -> list:
    """``col_stat`` aggregate columns for the columns of ``spec`` present in ``df``."""
    return [_STAT[s](c).alias(f"{c}_{s}") for c, stats in spec.items() if c in df.columns
            for s in stats]


def daily_rollup(df: DataFrame, by: Sequence[str] = ("city",), ts: str = "local_time",
                 spec: Mapping[str, Sequence[str]] = DAILY_STATS) -> DataFrame:
    """AGG1: statistics by (city, date)."""
    return df.groupBy(*by, S.date_part(ts).alias("date")).agg(*stat_exprs(df, spec))


def weekly_rollup(df: DataFrame, by: Sequence[str] = ("city",), ts: str = "local_time",
                  iso_year: bool = False,
                  spec: Mapping[str, Sequence[str]] = WEEKLY_STATS) -> DataFrame:
    """AGG2: statistics by (city, year, ISO week).

    The reference pairs the ISO week with the *calendar* year (2021-01-01 ->
    2021/53); ``iso_year=True`` uses the ISO year instead.
    """
    t = F.col(ts)
    year = F.year(F.date_add(F.to_date(t), 3 - F.weekday(t))) if iso_year else F.year(t)
    return df.groupBy(*by, year.alias("year"), S.iso_week(t).alias("week")).agg(*stat_exprs(df, spec))


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    """PRJ4 (numbers): numeric columns minus ``exclude``."""
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.NumericType) and f.name not in exclude]


def string_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    """PRJ4 (strings)."""
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.StringType) and f.name not in exclude]


DESCRIBE_QS = (0.25, 0.5, 0.75)


def describe(df: DataFrame, cols: Sequence[str] | None = None, by: Sequence[str] = (),
             method: str = "exact") -> DataFrame:
    """AGG3/AGG4: count, mean, std, min, 25/50/75 %, max per column (and group)."""
    by = list(by)
    cols = list(cols or numeric_columns(df, exclude=by))
    long = ranking.to_long(df, by, cols)
    basic = long.groupBy(*by, "column").agg(
        F.count("value").alias("count"), F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"), F.min("value").alias("min"),
        F.max("value").alias("max"))
    qs = ranking.quantiles(df, cols, DESCRIBE_QS, by, method)
    qwide = qs.groupBy(*by, "column").agg(
        *[F.max(F.when(F.col("q") == q, F.col("value"))).alias(f"p{int(q * 100)}")
          for q in DESCRIBE_QS])
    return basic.join(qwide, [*by, "column"], "left")


def describe_grouping_sets(df: DataFrame, value: str, keys: Sequence[str]) -> DataFrame:
    """AGG4 in one pass: count/mean/std/min/max of ``value`` for each key separately."""
    name, shown = F.lit(None).cast("string"), F.lit(None).cast("string")
    for k in reversed(list(keys)):
        name = F.when(F.grouping(k) == 0, F.lit(k)).otherwise(name)
        shown = F.when(F.grouping(k) == 0, F.col(k).cast("string")).otherwise(shown)
    out = df.groupingSets([[F.col(k)] for k in keys], *keys).agg(
        name.alias("group_by"), shown.alias("group_value"), F.count(value).alias("count"), F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"))
    return out.select("group_by", "group_value", "count", "mean", "std", "min", "max")


def describe_by_each(df: DataFrame, value: str, keys: Sequence[str], method: str = "exact") -> DataFrame:
    """AGG4 with quartiles: ``describe`` of ``value`` for each key separately, in one long table."""
    out = None
    for k in keys:
        part = describe(df, [value], [k], method)
        part = part.select(F.lit(k).alias("group_by"), F.col(k).cast("string").alias("group_value"),
                           *[c for c in part.columns if c not in (k, "column")])
        out = part if out is None else out.unionByName(part)
    return out


def null_profile(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """AGG5: (column, null_count, null_pct) in one scan."""
    cols = list(cols or df.columns)
    wide = df.agg(F.count(F.lit(1)).alias("_n"),
                  *[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    long = wide.unpivot(["_n"], cols, "column", "null_count")
    return long.select("column", "null_count",
                       (S.safe_div(F.col("null_count") * 100.0, F.col("_n"))).alias("null_pct"))


def value_counts(df: DataFrame, col: str, by: Sequence[str] = (), normalize: bool = False) -> DataFrame:
    """AGG10: counts per value (per group), optionally as percent of the group."""
    by = list(by)
    counts = df.groupBy(*by, col).agg(F.count(F.lit(1)).alias("count"))
    if not normalize:
        return counts
    totals = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_total")) if by else None
    if totals is not None:
        counts = counts.join(totals, by)
    else:
        total = df.count()
        counts = counts.withColumn("_total", F.lit(total))
    return counts.withColumn("pct", S.safe_div(F.col("count") * 100.0, F.col("_total"))).drop("_total")


def share(cond, name: str):
    """AGG11: percent of rows meeting ``cond`` (an aggregate expression)."""
    return (F.avg(F.when(cond, 1.0).otherwise(0.0)) * 100.0).alias(name)


def extent(df: DataFrame, ts: str = "local_time", by: Sequence[str] = ()) -> DataFrame:
    """AGG15: first and last timestamp and row count."""
    aggs = [F.min(ts).alias("start"), F.max(ts).alias("end"), F.count(F.lit(1)).alias("rows")]
    return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)


def distinct_values(df: DataFrame, col: str, approx: bool = False) -> DataFrame:
    """AGG14: the sorted distinct values (the count is ``.count()`` or ``approx``)."""
    if approx:
        return df.agg(F.approx_count_distinct(col).alias(f"n_{col}"))
    return df.select(col).distinct()


# --- mergeable rollup states (AGG1, AGG2) --------------------------------------------------

def calendar_keys(kind: str, ts: str = "local_time", by: Sequence[str] = ("city",)) -> list:
    """The key columns of the ``daily`` or ``weekly`` rollup."""
    t = F.col(ts)
    if kind == "daily":
        return [*[F.col(c) for c in by], S.date_part(ts).alias("date")]
    if kind == "weekly":
        return [*[F.col(c) for c in by], F.year(t).alias("year"), F.weekofyear(t).alias("week")]
    raise ValueError("kind must be daily or weekly")


def rollup_state(df: DataFrame, kind: str, measures: Sequence[str], ts: str = "local_time",
                 by: Sequence[str] = ("city",)) -> DataFrame:
    """Per key and measure the state (n, sum, m2, lo, hi) from which every rollup statistic follows.

    ``m2`` is the sum of squared distances from the mean.
    """
    def state(c: str):
        n = F.count(c)
        return F.struct(n.alias("n"), F.coalesce(F.sum(F.col(c).cast("double")), F.lit(0.0)).alias("sum"),
                        F.coalesce(F.var_pop(c) * n, F.lit(0.0)).alias("m2"), F.min(F.col(c).cast("double")).alias("lo"),
                        F.max(F.col(c).cast("double")).alias("hi")).alias(c)
    return df.groupBy(*calendar_keys(kind, ts, by)).agg(*[state(c) for c in measures])


def merge_states(states: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """One state per key from several tables of states (a key has at most one row in each).

    Counts and sums add up, ranges widen, and squared distances add with the
    shift between the means (Chan, Golub and LeVeque, 1979).
    """
    out = states[0]
    for s in states[1:]:
        out = out.unionByName(s)
    measures = [c for c in out.columns if c not in keys]

    def both(a, b):
        n = a["n"] + b["n"]
        gap = F.try_divide(a["sum"], a["n"]) - F.try_divide(b["sum"], b["n"])
        shift = F.coalesce(gap * gap * a["n"] * F.try_divide(b["n"], n), F.lit(0.0))
        return F.struct(n.alias("n"), (a["sum"] + b["sum"]).alias("sum"), (a["m2"] + b["m2"] + shift).alias("m2"),
                        F.least(a["lo"], b["lo"]).alias("lo"), F.greatest(a["hi"], b["hi"]).alias("hi"))

    def merged(c: str):
        # as many entries as tables of states, in the order of their values so that sums repeat exactly
        parts = F.sort_array(F.collect_list(c))
        return F.aggregate(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), F.get(parts, F.lit(0)), both).alias(c)
    return out.groupBy(*keys).agg(*[merged(c) for c in measures])


def finish_states(states: DataFrame, keys: Sequence[str], spec: Mapping[str, Sequence[str]]) -> DataFrame:
    """The rollup table (``col_stat`` columns) of a table of states."""
    def stat(c: str, name: str):
        s = F.col(c)
        some = s["n"] > 0
        return {"count": s["n"], "sum": F.when(some, s["sum"]), "mean": F.try_divide(s["sum"], s["n"]), "min": s["lo"], "max": s["hi"],
                "std": F.when(s["n"] > 1, F.sqrt(F.greatest(s["m2"], F.lit(0.0)) / (s["n"] - 1)))}[name].alias(f"{c}_{name}")
    return states.select(*keys, *[stat(c, name) for c, stats in spec.items() if c in states.columns for name in stats])


KEYS = {"daily": ["city", "date"], "weekly": ["city", "year", "week"]}


def add_hours(new: DataFrame, base: str, measures: Sequence[str] = tuple(DAILY_STATS), ts: str = "local_time") -> dict[str, DataFrame]:
    """Merge new rows into the daily and weekly states stored under ``base`` and commit both together.

    Only the new rows and the stored states are read.  Returns the finished
    daily and weekly tables.
    """
    from demandspark.sources import io
    spark = new.sparkSession
    stored = io.committed_tables(spark, base)
    merged = {}
    for kind, keys in KEYS.items():
        states = [rollup_state(new, kind, measures, ts)]
        if stored:
            states.append(spark.read.parquet(stored[kind]))
        merged[kind] = merge_states(states, keys)
    paths = io.commit_tables(merged, base)
    spec = {"daily": DAILY_STATS, "weekly": WEEKLY_STATS}
    return {kind: finish_states(spark.read.parquet(paths[kind]), KEYS[kind], spec[kind]) for kind in KEYS}
