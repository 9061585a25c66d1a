"""Removal of repeated three-line windows (operator 2), in DataFrame functions only.

Every run of three consecutive lines is a window, known by a 128-bit hash.  A
window that occurs more than once in the corpus keeps its first occurrence, in
the order of (id, text hash, line number); the lines that its later
occurrences cover are removed, overlapping spans merged.  The first occurrence
of each line therefore always stays.

Edge cases: a null text stays null and has no lines; texts of fewer than three
lines have no window; windows of three empty lines are left alone; rows with
the same id and text count as one row and get the same result, as do rows with
a null id (which sort first); other columns are passed over.

Skew: occurrences are counted with partial aggregation, and the join of the
windows with the repeated hashes may split a hot hash (the adaptive skew join),
since nothing above it needs the hash's rows together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandspark.llm.common import fresh, let

WINDOW = 3


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_windows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per window: _id, _key (hash of id and text), pos and the hash (a, b)."""
    ident, text = F.col(id_col), F.col(text_col)
    empty = F.xxhash64(F.lit(""))

    def windows(h: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(1), F.size(h) - (window - 1)),
            lambda i: F.struct(
                (i - 1).alias("pos"),
                F.xxhash64(*[F.element_at(h, i + k) for k in range(window)]).alias("a"),
                F.xxhash64(F.lit(window), *[F.element_at(h, i + window - 1 - k) for k in range(window)]).alias("b"),
                F.greatest(*[F.element_at(h, i + k) != empty for k in range(window)]).alias("any")))

    base = df.select(ident.alias("_id"), F.xxhash64(ident, text).alias("_key"), _lines(text).alias("l"))
    return (base.filter(F.size("l") >= window)
            .select("_id", "_key", F.inline(let(F.transform("l", lambda x: F.xxhash64(x)), windows)))
            .filter("any").drop("any"))


def covered_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per row with removals: _id, _key and the sorted line numbers (from 0) covered by later occurrences."""
    windows = line_windows(df, id_col, text_col, window)
    place = F.struct("_id", "_key", "pos")
    repeated = (windows.groupBy("a", "b").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n"))
                .filter("n > 1").drop("n"))
    later = windows.join(repeated, ["a", "b"]).filter(~place.eqNullSafe(F.col("first")))
    return (later.select("_id", "_key", F.explode(F.sequence("pos", F.col("pos") + (window - 1))).alias("line"))
            .groupBy("_id", "_key").agg(F.array_sort(F.collect_set("line")).alias("_covered")))


def merged_spans(lines: Column) -> Column:
    """Sorted line numbers as an array of (start, end) spans, end exclusive."""
    def spans(c: Column) -> Column:
        starts = F.filter(c, lambda x, i: (i == 0) | (F.get(c, i - 1) != x - 1))
        ends = F.filter(c, lambda x, i: (i == F.size(c) - 1) | (F.get(c, i + 1) != x + 1))
        return F.zip_with(starts, ends, lambda s, e: F.struct(s.alias("start"), (e + 1).alias("end")))
    return let(lines, spans)


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                prefix: str = "") -> DataFrame:
    """``df`` with the repeated lines removed from the text, and three columns more.

    ``n_lines`` and ``n_removed`` count lines (0 for a null text), ``removed``
    holds the merged spans; ``prefix`` goes before their names.  Columns of
    ``df`` with those names are replaced.
    """
    added = [f"{prefix}{c}" for c in ("n_lines", "n_removed", "removed")]
    own = [c for c in df.columns if c not in added]
    ident, key, lines = (fresh(df, c) for c in ("__ident", "__key", "__covered"))
    hit = covered_lines(df, id_col, text_col, window).toDF(ident, key, lines)
    joined = df.join(hit, df[id_col].eqNullSafe(hit[ident]) & (F.xxhash64(df[id_col], df[text_col]) == hit[key]), "left")
    covered = F.col(lines)
    text = F.col(text_col)

    def keep(lines: Column) -> Column:
        rest = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), covered)
        return F.array_join(F.transform(rest, lambda i: F.get(lines, i)), "\n")

    cut = F.when(covered.isNull(), text).otherwise(let(_lines(text), keep))
    none = F.array().cast("array<struct<start:int,end:int>>")
    return joined.select(
        *[(cut.alias(c) if c == text_col else F.col(f"`{c}`")) for c in own],
        F.when(text.isNull(), 0).otherwise(F.size(_lines(text))).alias(added[0]),
        F.coalesce(F.size(covered), F.lit(0)).alias(added[1]),
        F.coalesce(merged_spans(covered), none).alias(added[2]))
