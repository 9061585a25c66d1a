"""Window operators (WIN1-WIN7).

Row-offset windows (lags, leads, rolling means) are the reference's
``shift``/``rolling`` over a per-city series.  A plain
``Window.partitionBy('city')`` would put a whole city -- possibly a third of
all rows -- into one task, so the series is cut into fixed-size chunks of a
global row index instead: each chunk is one window partition, and the ``back``
rows before it (``ahead`` rows after it) are copied in as halo rows, read by
the frame but not emitted.  The result equals the per-city window exactly,
with partitions of bounded size whatever the skew.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from demandspark.functions import scalars as S
from demandspark.operators import ranking
from demandspark.session import cut_lineage

DEFAULT_CHUNK_ROWS = 1_000_000

WindowExprs = Mapping[str, Callable[[Window], Column]]


def chunked_window(df: DataFrame, by: Sequence[str], order: Sequence[str], exprs: WindowExprs,
                   back: int = 0, ahead: int = 0, chunk_rows: int = DEFAULT_CHUNK_ROWS,
                   keep_index: str | None = None, index: str | None = None) -> DataFrame:
    """Evaluate row-offset window ``exprs`` over (by ordered by order) with bounded partitions.

    Each entry of ``exprs`` maps an output name to ``fn(w) -> Column`` where
    ``w`` is the window spec to use; frames may look at most ``back`` rows
    behind and ``ahead`` rows ahead.  ``index`` names an existing 0-based
    global position in (by, order) order -- e.g. from an earlier call on the
    same rows -- and saves the sort.
    """
    if back >= chunk_rows or ahead >= chunk_rows:
        raise ValueError("chunk_rows must exceed the window reach")
    by, order = list(by), list(order)
    if index:
        idx = df.withColumnRenamed(index, "_gi") if index != "_gi" else df
        if keep_index is None and index != "_gi":
            keep_index = index
        # base and halo branches both read this frame: written once, and dropped with its last reader
        idx = cut_lineage(idx)
    else:
        idx = ranking.global_row_index(df, [*by, *order], "_gi")
    chunk = F.floor(F.col("_gi") / chunk_rows)
    pos = F.col("_gi") % chunk_rows
    parts = [idx.withColumns({"_chunk": chunk, "_core": F.lit(True)})]
    if back:
        parts.append(idx.filter(pos >= chunk_rows - back)
                     .withColumns({"_chunk": chunk + 1, "_core": F.lit(False)}))
    if ahead:
        parts.append(idx.filter(pos < ahead).withColumns({"_chunk": chunk - 1, "_core": F.lit(False)}))
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    w = Window.partitionBy(*by, "_chunk").orderBy("_gi")
    out = u.withColumns({name: fn(w) for name, fn in exprs.items()}).filter(F.col("_core"))
    if keep_index:
        out = out.withColumnRenamed("_gi", keep_index)
    return out.drop("_chunk", "_core", *([] if keep_index else ["_gi"]))


def lag_expr(value: str, n: int) -> Callable[[Window], Column]:
    return lambda w: F.lag(value, n).over(w)


def lead_expr(value: str, n: int) -> Callable[[Window], Column]:
    return lambda w: F.lead(value, n).over(w)


def rolling_mean_expr(value: str, n: int) -> Callable[[Window], Column]:
    """Mean of the last ``n`` rows including the current one; NULL until ``n`` non-NULL values."""
    def build(w: Window) -> Column:
        frame = w.rowsBetween(-(n - 1), 0)
        return F.when(F.count(value).over(frame) == n, F.avg(value).over(frame))
    return build


def lags_and_rolling(df: DataFrame, value: str = "demand", by: Sequence[str] = ("city",),
                     order: Sequence[str] = ("local_time", "row_id"),
                     lags: Sequence[int] = (1, 24, 48, 168),
                     windows: Sequence[int] = (6, 12, 24, 48),
                     chunk_rows: int = DEFAULT_CHUNK_ROWS) -> DataFrame:
    """WIN1 + WIN3: ``<value>_lag_<n>`` and ``<value>_rolling_<n>`` in one shuffle."""
    exprs = {f"{value}_lag_{n}": lag_expr(value, n) for n in lags}
    exprs.update({f"{value}_rolling_{n}": rolling_mean_expr(value, n) for n in windows})
    back = max([*lags, *[n - 1 for n in windows], 0])
    return chunked_window(df, by, order, exprs, back=back, chunk_rows=chunk_rows)


def lead_target(df: DataFrame, value: str = "demand", horizon: int = 24,
                by: Sequence[str] = ("city",), order: Sequence[str] = ("local_time", "row_id"),
                name: str = "target_demand", chunk_rows: int = DEFAULT_CHUNK_ROWS) -> DataFrame:
    """WIN2: the value ``horizon`` rows ahead within the group."""
    return chunked_window(df, by, order, {name: lead_expr(value, horizon)}, ahead=horizon,
                          chunk_rows=chunk_rows)


def group_zscore(df: DataFrame, cols: Sequence[str], by: Sequence[str] | None = ("city",)) -> DataFrame:
    """WIN4: ``<c>_zscore = |x - mean| / std`` (sample std) per group, overall without groups.

    Group statistics are a (declarative, partially aggregated) ``groupBy`` joined
    back on the keys, not an unbounded window: no task holds a whole group.
    """
    cols = [c for c in cols if c in df.columns]
    by = [b for b in (by or []) if b in df.columns]
    aggs = [e for c in cols for e in (F.avg(c).alias(f"_m_{c}"), F.stddev_samp(c).alias(f"_s_{c}"))]
    if by:
        stats = df.groupBy(*by).agg(*aggs)
        out = attach_group_stat(df, stats, by)
    else:
        lit = ranking.first_row(df.agg(*aggs))
        out = df.withColumns({k: F.lit(v).cast("double") for k, v in lit.items()})
    out = out.withColumns({f"{c}_zscore": F.abs(S.safe_div(F.col(c) - F.col(f"_m_{c}"), F.col(f"_s_{c}")))
                           for c in cols})
    return out.drop(*[f"_{k}_{c}" for c in cols for k in ("m", "s")])


def attach_group_stat(df: DataFrame, stats: DataFrame, by: Sequence[str],
                      broadcast_groups: int = ranking.BROADCAST_GROUPS) -> DataFrame:
    """WIN5/JN5: a per-group statistic brought back to every row of the group."""
    return ranking.join_groups(df, stats, by, "left", broadcast_groups)


def daily_pct_change(df: DataFrame, value: str = "demand", by: str = "city",
                     ts: str = "local_time", cross_city: bool = False, keep_previous: bool = False) -> DataFrame:
    """WIN6: daily mean and its change against the previous day of the same city.

    ``cross_city=True`` reproduces the reference's single sorted series: a
    city's first day is compared with the previous city's last day.
    ``keep_previous`` keeps the mean compared with, as ``previous_mean``.
    """
    daily = df.groupBy(by, S.date_part(ts).alias("date")).agg(F.avg(value).alias(f"{value}_mean"))
    m = F.col(f"{value}_mean")
    prev = F.lag(m, 1).over(Window.partitionBy(by).orderBy("date"))
    daily = daily.withColumn("_prev", prev)
    if cross_city:
        last = daily.groupBy(by).agg(F.max_by(m, F.col("date")).alias("_last"))
        # one row per city: a window over the city list is tiny
        last = last.withColumn("_prev_city_last", F.lag("_last", 1).over(Window.orderBy(by))).drop("_last")
        daily = (daily.join(last, by, "left")
                 .withColumn("_prev", F.coalesce(F.col("_prev"), F.col("_prev_city_last")))
                 .drop("_prev_city_last"))
    daily = daily.withColumn(f"{value}_pct_change", S.safe_div(m - F.col("_prev"), F.col("_prev")))
    return daily.withColumnRenamed("_prev", "previous_mean") if keep_previous else daily.drop("_prev")
