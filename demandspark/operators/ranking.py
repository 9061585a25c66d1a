"""Order-based building blocks that stay distributed under skew.

* ``global_row_index`` (WIN7): a 0-based position in a total order without a
  single-partition window.  The frame is range-partitioned by ``orderBy``;
  each partition numbers its rows (``monotonically_increasing_id`` keeps the
  in-partition position in its low 33 bits); a table with one row per
  partition -- its size is bounded by the partition count, not by the data --
  turns the counts into offsets and is broadcast back.
* ``quantiles`` (AGG6/AGG7): exact linear-interpolated quantiles by group.  A
  sketch brackets each rank; one more pass counts what lies below the bracket
  and ranks the few values inside it.  No task holds a whole group (unlike
  ``percentile()``, whose buffer holds every distinct value) and the data is
  neither sorted nor copied.
* ``mode`` (AGG8): count per (group, value) with partial aggregation, then
  ``min_by`` over (-count, value): the smallest of the most frequent values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from demandspark.session import cut_lineage

_LOW_BITS = (1 << 33) - 1


def global_row_index(df: DataFrame, order_cols: Sequence[str | Column],
                     name: str = "row_index") -> DataFrame:
    """Add a 0-based position of each row in the total order ``order_cols``.

    ``order_cols`` should make the order total (end it with a unique key) for
    the result to be repeatable.  The numbered, sorted frame is written with a
    reliable checkpoint: the count job and the numbering must read the very
    same partitions (AQE may coalesce a re-planned sort differently), and the
    cut lineage survives executor loss.
    """
    ordered = df.orderBy(*order_cols).withColumn("_mid", F.monotonically_increasing_id())
    ordered = cut_lineage(ordered)
    pid = F.shiftright(F.col("_mid"), 33)
    per_part = ordered.groupBy(pid.alias("_pid")).agg(F.count(F.lit(1)).alias("_n"))
    offsets = per_part.select(
        "_pid",
        F.coalesce(F.sum("_n").over(Window.orderBy("_pid").rowsBetween(
            Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"))
    return (ordered.withColumn("_pid", pid)
            .join(F.broadcast(offsets), "_pid")
            .withColumn(name, F.col("_off") + F.col("_mid").bitwiseAND(F.lit(_LOW_BITS)))
            .drop("_pid", "_off", "_mid"))


def to_long(df: DataFrame, by: Sequence[str], cols: Sequence[str],
            name: str = "column", value: str = "value") -> DataFrame:
    """Unpivot ``cols`` (cast to double) to (by..., column, value), NULLs dropped."""
    base = df.select(*by, *[F.col(c).cast("double").alias(c) for c in cols])
    return (base.unpivot(list(by), list(cols), name, value)
            .filter(F.col(value).isNotNull()))


BROADCAST_GROUPS = 100_000   # group rows, a few numbers each, that are sent to every task


def join_groups(df: DataFrame, stats: DataFrame, by: Sequence[str], how: str = "left",
                broadcast_groups: int = BROADCAST_GROUPS) -> DataFrame:
    """Bring one row per group back to the rows of the group.

    The statistics are written first (computed once) and counted: up to
    ``broadcast_groups`` are broadcast, so rows are not shuffled on a key that
    few groups share.  Beyond that the join shuffles, and the adaptive skew join
    splits hot groups; the result is the same.
    """
    stats = cut_lineage(stats)
    return df.join(F.broadcast(stats) if stats.count() <= broadcast_groups else stats, list(by), how)


def quantiles(df: DataFrame, cols: Sequence[str], qs: Sequence[float],
              by: Sequence[str] = (), method: str = "exact",
              accuracy: int = 10000) -> DataFrame:
    """Long result (by..., column, q, value): linear-interpolated quantiles over non-NULLs.

    ``method='exact'`` first brackets each quantile by two values of a sketch
    whose rank error is at most n / ``accuracy``, then counts the rows below the
    bracket and the distinct values inside it, about 8 n / ``accuracy`` rows (all
    of a group of up to ``accuracy`` rows), which are ranked by their counts: two
    passes with partial aggregation, no sort and no copy of the data.  ``method='approx'`` returns the sketch's
    values, for inputs where an exact answer is not needed.
    """
    by = list(by)
    qs = [float(q) for q in qs]
    long = to_long(df, by, cols)
    if method == "approx":
        est = long.groupBy(*by, "column").agg(
            F.percentile_approx("value", qs, accuracy).alias("_vals"))
        return (est.select(*by, "column", F.posexplode("_vals").alias("_i", "value"))
                .withColumn("q", F.element_at(F.array(*[F.lit(q) for q in qs]), F.col("_i") + 1))
                .drop("_i"))
    keys = by + ["column"]
    margin = 4.0 / accuracy   # the sketch's error and the ranks next to the quantile's place
    ends = [p for q in qs for p in (max(0.0, q - margin), min(1.0, q + margin))]
    sketch = long.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min("value").alias("_min"),
                                     F.max("value").alias("_max"),
                                     F.percentile_approx("value", ends, accuracy).alias("_ends"))
    few = F.col("_n") <= accuracy
    spans = [F.struct(F.lit(q).alias("q"),
                      F.when(few | F.lit(ends[2 * i] <= 0), F.col("_min")).otherwise(F.col("_ends")[2 * i]).alias("lo"),
                      F.when(few | F.lit(ends[2 * i + 1] >= 1), F.col("_max")).otherwise(F.col("_ends")[2 * i + 1]).alias("hi"))
             for i, q in enumerate(qs)]
    sketch = sketch.select(*keys, "_n", F.array(*spans).alias("_spans"))
    # below a bracket the value is dropped: those rows add up to one count per task
    hit = F.filter("_spans", lambda s: F.col("value") <= s["hi"])
    seen = join_groups(long, sketch, keys, "inner").select(
        *keys, "_n", F.explode(F.transform(hit, lambda s: F.struct(
            s["q"].alias("q"), F.when(F.col("value") >= s["lo"], F.col("value")).alias("value")))).alias("_h"))
    counts = seen.groupBy(*keys, F.col("_h.q").alias("q"), F.col("_h.value").alias("value")).agg(
        F.count(F.lit(1)).alias("_c"), F.max("_n").alias("_n"))
    w = Window.partitionBy(*keys, "q").orderBy(F.col("value").asc_nulls_first())
    counts = counts.withColumn("_cum", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    pos = F.col("q") * (F.col("_n") - 1)
    at = lambda rank: F.min(F.when(F.col("value").isNotNull() & (F.col("_cum") > rank), F.col("value")))
    found = counts.groupBy(*keys, "q").agg(
        at(F.floor(pos)).alias("_lo"), at(F.ceil(pos)).alias("_hi"), F.max(pos - F.floor(pos)).alias("_frac"),
        F.max(F.when(F.col("value").isNull(), F.col("_c") > F.floor(pos)).otherwise(F.lit(False))).alias("_missed"))
    value = F.col("_lo") + F.col("_frac") * (F.col("_hi") - F.col("_lo"))
    return found.select(*keys, "q", F.when(F.col("_missed") | F.col("_hi").isNull(), F.raise_error(
        F.lit("the sketch's bracket misses the quantile"))).otherwise(value).cast("double").alias("value"))


def quantiles_wide(df: DataFrame, cols: Sequence[str], qs: Sequence[float],
                   by: Sequence[str] = (), method: str = "exact",
                   fmt: str = "{col}_q{pct}") -> DataFrame:
    """One row per group, one column per (column, q), named by ``fmt``."""
    long = quantiles(df, cols, qs, by, method)
    by = list(by)
    aggs = [F.max(F.when((F.col("column") == c) & (F.col("q") == float(q)), F.col("value")))
            .alias(fmt.format(col=c, q=q, pct=_pct(q))) for c in cols for q in qs]
    if by:
        return long.groupBy(*by).agg(*aggs)
    return long.agg(*aggs)


def medians(df: DataFrame, cols: Sequence[str], by: Sequence[str] = (),
            method: str = "exact") -> DataFrame:
    return quantiles_wide(df, cols, [0.5], by, method, fmt="{col}_median")


def _pct(q: float) -> str:
    return f"{round(q * 100):02d}"


def mode(df: DataFrame, col: str, by: Sequence[str] = (), name: str | None = None) -> DataFrame:
    """Most frequent non-NULL value per group; ties -> the smallest value."""
    by = list(by)
    counts = df.filter(F.col(col).isNotNull()).groupBy(*by, col).agg(F.count(F.lit(1)).alias("_c"))
    pick = F.min_by(F.col(col), F.struct((-F.col("_c")).alias("a"), F.col(col).alias("b")))
    out = counts.groupBy(*by).agg(pick.alias(name or f"{col}_mode")) if by else \
        counts.agg(pick.alias(name or f"{col}_mode"))
    return out


def first_row(df: DataFrame) -> dict:
    """Collect a one-row statistics frame (bounded size) as a dict of literals."""
    rows = df.limit(2).collect()
    if len(rows) != 1:
        raise ValueError(f"expected one statistics row, got {len(rows)}")
    return rows[0].asDict()
