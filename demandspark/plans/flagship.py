"""Flagship job: the preprocessing program's daily rollup and the demand spikes in it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from demandspark.operators import anomaly, rollup
from demandspark.sources import fixtures as fx


def spike_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily statistics of every (city, day) whose mean demand moved by more than 50 %."""
    panel = fx.demand_panel(spark, sf_dir)
    daily = rollup.daily_rollup(panel)
    spikes = anomaly.spike_days(panel).select("city", "date", "demand_pct_change")
    return (daily.join(spikes, ["city", "date"])
            .select("city", F.col("date").cast("string").alias("date"), "demand_pct_change",
                    *[c for c in daily.columns if c not in ("city", "date")]))
