"""Helpers shared by the query modules."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from demandspark.functions.scalars import oracle_round
from demandspark.plans.registry import r4

SQL_FN = {"mean": "avg", "min": "min", "max": "max", "sum": "sum", "std": "stddev_samp",
          "count": "count"}


def round_doubles(df: DataFrame) -> DataFrame:
    """Apply the oracle rounding to every double column (presentation of checked queries)."""
    return df.select(*[oracle_round(F.col(f"`{f.name}`")).alias(f.name)
                       if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f"`{f.name}`")
                       for f in df.schema.fields])


def date_str(c: str = "date") -> F.Column:
    return F.col(c).cast("string").alias(c)


def sql_stats(spec: Mapping[str, Sequence[str]]) -> str:
    return ",\n       ".join(
        (f"CAST(count({c}) AS BIGINT) AS {c}_{s}" if s == "count" else
         f"{r4(f'{SQL_FN[s]}({c})')} AS {c}_{s}")
        for c, stats in spec.items() for s in stats)
