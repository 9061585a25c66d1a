"""Reshape (RSH1-RSH7), set operations (SET1, SET3), joins (JN1, JN7, JN8),
projections (PRJ1-PRJ4), filters (FLT1-FLT6) and sampling (SMP1)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandspark.functions import scalars as S
from demandspark.operators import ranking

# Weekday names, Monday = 0.
WEEKDAY_NAMES = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")


# --- reshape ------------------------------------------------------------------------------

def melt(df: DataFrame, id_cols: Sequence[str], value_cols: Sequence[str] | None = None,
         var_name: str = "city", value_name: str = "demand") -> DataFrame:
    """RSH1: wide city columns -> (ids..., city, demand)."""
    value_cols = list(value_cols or [c for c in df.columns if c not in id_cols])
    return df.unpivot(list(id_cols), value_cols, var_name, value_name)


def pivot_mean(df: DataFrame, row: str, col: str, value: str, values: Sequence) -> DataFrame:
    """RSH2/RSH5: mean of ``value`` for each (row, col) cell; ``values`` lists the columns."""
    return df.groupBy(row).pivot(col, list(values)).agg(F.avg(value))


def crosstab(df: DataFrame, row: str, col: str, values: Sequence) -> DataFrame:
    """RSH3: counts per (row, col), zero where a pair never occurs."""
    out = df.groupBy(row).pivot(col, list(values)).count()
    return out.fillna(0, subset=[str(v) for v in values])


def crosstab_row_share(df: DataFrame, row: str, col: str) -> DataFrame:
    """RSH4 (long form): share of each col value within its row value."""
    counts = df.groupBy(row, col).agg(F.count(F.lit(1)).alias("count"))
    totals = df.groupBy(row).agg(F.count(F.lit(1)).alias("_total"))
    return (counts.join(totals, row)
            .withColumn("share", S.safe_div(F.col("count"), F.col("_total"))).drop("_total"))


def calendar_matrix(df: DataFrame, label: str = "label", values: Sequence[int] = range(1, 13),
                    ts: str = "local_time") -> DataFrame:
    """RSH6: day-of-month x month -> most common label (ties -> lowest)."""
    cal = df.withColumns({"month": F.month(ts), "day": F.dayofmonth(ts)})
    common = ranking.mode(cal, label, by=["month", "day"], name="_label")
    return common.groupBy("day").pivot("month", list(values)).agg(F.first("_label"))


def to_metric_table(df: DataFrame, fmt: str = "%.4f") -> DataFrame:
    """RSH7: a one-row table of statistics -> (metric, value) strings."""
    cols = df.columns
    as_str = df.select(*[(F.format_string(fmt, F.col(c).cast("double"))
                          if dict(df.dtypes)[c] in ("double", "float") else F.col(c).cast("string")).alias(c)
                         for c in cols])
    return as_str.unpivot([], cols, "metric", "value")


# --- set operations ----------------------------------------------------------------------

def union_by_name(frames: Sequence[DataFrame]) -> DataFrame:
    """SET1: concatenate by column name; a column missing from a frame becomes NULL."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def distinct_rows(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """SET3."""
    return df.dropDuplicates(list(subset)) if subset else df.distinct()


# --- joins -----------------------------------------------------------------------------

def merge_weather(demand: DataFrame, weather: DataFrame, normalise_city: bool = True,
                  keys: Sequence[str] = ("city", "local_time")) -> DataFrame:
    """JN1: demand LEFT JOIN weather on (city, local_time); right duplicates fan out.

    With ``normalise_city`` the city key is lower-cased and '_' becomes ' ' on
    both sides, so a file-stem city ('san_antonio') meets a column-name city
    ('san antonio'); the demand side keeps its own spelling.  The join strategy
    is left to AQE (broadcast only when the weather side is measured small).
    """
    keys = list(keys)
    wcols = [c for c in weather.columns if c not in keys]
    clash = [c for c in wcols if c in demand.columns]
    d = demand.drop(*clash)
    if normalise_city:
        d = d.withColumn("_ck", S.city_key("city"))
        w = weather.withColumn("_ck", S.city_key("city")).drop("city")
        on = ["_ck", *[k for k in keys if k != "city"]]
        return d.join(w, on, "left").drop("_ck")
    return d.join(weather, keys, "left")


def map_lookup(c: str | Column, mapping: Mapping) -> Column:
    """JN7: small fixed map (cluster id -> name, weekday -> name) as a map literal."""
    pairs = [x for k, v in mapping.items() for x in (F.lit(k), F.lit(v))]
    return F.element_at(F.create_map(*pairs), S.col(c))


def weekday_name(dow: str | Column) -> Column:
    return map_lookup(dow, dict(enumerate(WEEKDAY_NAMES)))


def attach_labels(rows: DataFrame, labels: DataFrame, key: str = "row_id") -> DataFrame:
    """JN8: labels back onto full rows by key (never by position)."""
    return rows.join(labels, key, "left")


# --- projections, filters, sampling ---------------------------------------------------------

def rename(df: DataFrame, old: str, new: str) -> DataFrame:
    """PRJ1."""
    return df.withColumnRenamed(old, new)


def with_constant(df: DataFrame, name: str, value) -> DataFrame:
    """PRJ2."""
    return df.withColumn(name, F.lit(value))


def select_present(df: DataFrame, cols: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """PRJ3: keep the listed columns that exist (plus ``keep``)."""
    present = [c for c in cols if c in df.columns]
    return df.select(*keep, *present)


def filter_city(df: DataFrame, city: str | None) -> DataFrame:
    """FLT1: lower-cased city equality; None or 'all' keeps every city."""
    if city is None or city.lower() == "all":
        return df
    return df.filter(F.lower(F.col("city")) == city.lower())


def filter_time(df: DataFrame, start, end, ts: str = "local_time") -> DataFrame:
    """FLT2: inclusive ``start <= ts <= end`` (pushed down to the Parquet scan)."""
    return df.filter(F.col(ts).between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")))


def drop_nulls(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """FLT3."""
    return df.na.drop(subset=list(subset) if subset else None)


def filter_in(df: DataFrame, col: str, values: Sequence) -> DataFrame:
    """FLT5."""
    return df.filter(F.col(col).isin(list(values)))


def exclude_noise(df: DataFrame, label: str = "label") -> DataFrame:
    """FLT6: drop DBSCAN noise (label -1)."""
    return df.filter(F.col(label) != -1)


def sample_exact(df: DataFrame, n: int, seed: int = 42, key: str = "row_id",
                 strict: bool = True) -> DataFrame:
    """SMP1: exactly ``n`` rows chosen by a seeded hash of the key (repeatable).

    ``orderBy(...).limit(n)`` plans as TakeOrderedAndProject: each task keeps
    its n best rows and one task merges them, so memory is bounded by n per
    task (n is the sample size, the feature).  With ``strict`` it raises when
    fewer than ``n`` rows exist, as the reference does.
    """
    if strict:
        sample_size_check(df, n)
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), F.col(key)).limit(n)


def sample_size_check(df: DataFrame, n: int) -> None:
    total = df.count()
    if total < n:
        raise ValueError(f"cannot take a sample of {n} from {total} rows")

