"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandspark.llm.common import written


def components(edges: DataFrame, src: str = "a", dst: str = "b") -> DataFrame:
    """(node, root) for every node of ``edges``; the root is the least node of the component.

    Each step links neighbours to the least node they know (Kiveris et al.,
    2014), so a star of any size is a grouped minimum and one join, and the
    number of rounds grows with the logarithm of the longest path.  Every round
    is a written table.  Loops and null ends are ignored.
    """
    e = edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).filter(
        f"{src} is not null and {dst} is not null and u <> v").distinct()
    e = written(e, "edges")
    before = _mark(e)
    while before[0]:
        both = e.union(e.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.join(least, "u").filter("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(e.join(least.withColumnRenamed("u", "v"), "v")
                        .filter("u <> m").select("u", F.col("m").alias("v"))).distinct())
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(down, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(down.select("u", "m")).distinct())
        e = written(small, "edges")
        after = _mark(e)
        if after == before:
            break
        before = after
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _mark(e: DataFrame) -> tuple:
    """Count and order-free checksum of the edges."""
    r = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % 1_000_003), F.bit_xor(F.xxhash64("u", "v"))).first()
    return tuple(r)
