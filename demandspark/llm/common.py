"""Helpers of the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from demandspark.session import scratch_path


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet under the shared checkpoint folder and read it back.

    Cuts the lineage with a table that survives lost executors; the schema is
    passed on so that an empty table reads back as well.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row (bound as a lambda variable)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def by_bytes(batch: pa.RecordBatch, column: int, limit: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``limit`` bytes of a text column (one row at least)."""
    ends = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False))
    lo = 0
    while lo < batch.num_rows:
        before = int(ends[lo - 1]) if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def fresh(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def id_bucket(id_col: Column, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus`` (a null id counts as the empty text)."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % modulus


def without(df: DataFrame, dropped: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` without the rows of ``dropped`` (id and row_key, the hash of id and text).

    The dropped rows are written first, so that the planner knows their size
    when it decides between a broadcast and a shuffle.
    """
    gone = written(dropped.select(F.col(id_col).alias("__id"), F.col("row_key").alias("__key")).distinct(), "dropped")
    return df.join(gone, df[id_col].eqNullSafe(gone["__id"])
                   & (F.xxhash64(df[id_col], df[text_col]) == gone["__key"]), "left_anti")
