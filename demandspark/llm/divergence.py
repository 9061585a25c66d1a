"""Divergence audit of sources by pair-task sparse merges (operator 11).

1. Tasks count terms per (lang, source) and Spark adds the counts up; the
   vocabulary of a language is the terms of at least ``MIN_DOCS`` of its
   documents.  Kept terms get ids: a block by hash, sized by the vocabulary,
   and a number within it.
2. Every (lang, source) group has, per block, its sorted (term id, count)
   arrays (empty ones included).  Sources of a language are dealt into chunks;
   a task holds two chunks of one block and merges the arrays of every
   unordered pair of their groups: a galloping intersection finds the terms
   that both hold, terms of one side alone meet the other side's price of an
   absent term, and terms that neither holds are priced by their number.
   Each pair's price counts for both directions.  Spark adds the blocks up.
3. The terms that set a group apart from its language are ranked in Spark SQL.

A price is p = 1 + floor(10^9 (count + 2) / (N + 2 V)); two prices differ by
floor((p - q)^2 / (p + q)).  All of it is integer arithmetic; prices of counts
too large for 64 bits are computed with Python integers.

Terms are runs of ASCII letters and characters beyond ASCII; only A-Z are
lower-cased.

Edge cases: a null text, language or source is ''; a group without terms, and
every group of a language without kept terms, has pairs of value 0 in the
latter case and is priced as absent throughout in the former; a source alone in its language
has no pairs; repeated rows count as often as they occur; ties rank by the
UTF-8 bytes of the item; ids are not read; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from demandspark.llm.common import shuffle_partitions, written

MIN_DOCS = 10
TOP_TERMS = 10
UNIT = 10**9
BLOCK_TERMS = 32_768       # term ids of a block, about
CHUNK_SOURCES = 16         # groups of a chunk, about
HELD_TERMS = 200_000       # distinct (group, term) counts a task holds before it passes them on
GALLOP = 256               # needles looked up together

_OTHER = bytes(b for b in range(128) if not (65 <= b <= 90 or 97 <= b <= 122))
_TERMS = bytes.maketrans(_OTHER + bytes(range(65, 91)), b" " * len(_OTHER) + bytes(range(97, 123)))


def term_counts(df: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, term, n, docs); every group also has a row with a null term."""
    schema = "lang string, source string, term string, n long, docs long"

    def rows(held: dict) -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in held.items():
            terms = [None, *n]
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(terms)), pa.array([source] * len(terms)), pa.array(terms, pa.string()),
                 pa.array([0, *n.values()], pa.int64()), pa.array([0, *[docs[t] for t in n]], pa.int64())],
                names=["lang", "source", "term", "n", "docs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple[Counter, Counter]] = {}
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                for lang, source, text in zip(*[c.to_pylist() for c in part.columns]):
                    if (lang, source) not in held:
                        held[lang, source] = Counter(), Counter()
                    n, docs = held[lang, source]
                    terms = text.translate(_TERMS).split(b" ")
                    n.update(terms)
                    docs.update(set(terms))
                    n.pop(b"", None)
                if sum(len(n) for n, _ in held.values()) > HELD_TERMS:
                    yield from rows(held)
                    held = {}
        yield from rows(held)

    def text(c: str):
        return F.coalesce(F.col(c).cast("string"), F.lit(""))

    return df.select(text(lang_col).alias("lang"), text(source_col).alias("source"),
                     text(text_col).cast("binary").alias("text")).mapInArrow(run, schema)


def gallop(short: np.ndarray, long: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions in ``short`` and in ``long`` (both sorted and distinct) of the values that both hold.

    Each run of needles doubles a step from where the last run ended until the
    step passes the run, and searches only the span so found.
    """
    at = np.empty(len(short), np.int64)
    start = 0
    for lo in range(0, len(short), GALLOP):
        needles = short[lo:lo + GALLOP]
        step = len(needles)
        while start + step < len(long) and long[start + step - 1] < needles[-1]:
            step *= 2
        at[lo:lo + GALLOP] = start + np.searchsorted(long[start:start + step], needles)
        start = int(at[min(lo + GALLOP, len(short)) - 1])
    inside = at < len(long)
    inside[inside] = long[at[inside]] == short[inside]
    return np.flatnonzero(inside), at[inside]


def prices(counts: np.ndarray, total: int) -> np.ndarray:
    """1 + floor(10^9 (count + 2) / total), exactly."""
    if len(counts) and int(counts.max()) + 2 > (2**63 - 1) // UNIT:
        distinct, which = np.unique(counts, return_inverse=True)
        return np.array([1 + UNIT * (int(c) + 2) // total for c in distinct], np.int64)[which]
    return 1 + UNIT * (counts.astype(np.int64) + 2) // total


def gaps(p, q):
    """floor((p - q)^2 / (p + q)); prices are at most 10^9 + 1, so 64 bits hold it."""
    return (p - q) * (p - q) // (p + q)


def merge_pair(a: tuple, b: tuple, size: int) -> int:
    """The summed gaps of two groups over a block of ``size`` terms; a group is (ids, prices, price of an absent term)."""
    if len(a[0]) > len(b[0]):
        a, b = b, a
    (ids_a, price_a, none_a), (ids_b, price_b, none_b) = a, b
    in_a, in_b = gallop(ids_a, ids_b)
    alone_a, alone_b = np.ones(len(ids_a), bool), np.ones(len(ids_b), bool)
    alone_a[in_a], alone_b[in_b] = False, False
    absent = size - len(ids_a) - len(ids_b) + len(in_a)
    return int(gaps(price_a[in_a], price_b[in_b]).sum() + gaps(price_a[alone_a], none_b).sum()
               + gaps(none_a, price_b[alone_b]).sum()) + absent * int(gaps(none_a, none_b))


def _vocabulary(terms: DataFrame, langs: DataFrame, min_docs: int, block_terms: int) -> tuple[DataFrame, DataFrame]:
    """(lang, term, total, block, id) of the kept terms, and (lang, v, total_n, blocks) of every language."""
    kept = written(terms.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs"))
                   .filter(F.col("docs") >= min_docs).drop("docs"), "vocabulary")
    sizes = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("total").alias("total_n"))
    langs = written(langs.join(sizes, "lang", "left").na.fill(0, ["v", "total_n"])
                    .withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("v") / block_terms)).cast("int")), "langs")
    dealt = kept.join(langs.select("lang", "blocks"), "lang").withColumn(
        "block", F.pmod(F.xxhash64("term"), "blocks").cast("int")).drop("blocks")
    numbered = dealt.withColumn("id", F.row_number().over(Window.partitionBy("lang", "block").orderBy("term")))
    return numbered, langs


def _pair_values(kept: DataFrame, groups: DataFrame, langs: DataFrame, vocabulary: DataFrame,
                 chunk_sources: int) -> DataFrame:
    """(lang, a, b, value) of every unordered pair of sources of a language."""
    arrays = kept.groupBy("lang", "source", "block").agg(F.sort_array(F.collect_list(F.struct("id", "n"))).alias("terms"))
    sizes = vocabulary.groupBy("lang", "block").agg(F.count(F.lit(1)).alias("size"))
    many = groups.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / chunk_sources).cast("int").alias("chunks"))
    # a row per group and block, with or without terms
    rows = (groups.join(langs.select("lang", "v", "blocks"), "lang").join(many, "lang")
            .select("lang", "source", (F.col("group_n") + 2 * F.col("v")).alias("total"), "chunks",
                    F.pmod(F.xxhash64("source"), "chunks").cast("int").alias("chunk"),
                    F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
            .join(arrays, ["lang", "source", "block"], "left").join(sizes, ["lang", "block"], "left"))
    tile = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1),
                       lambda y: F.struct(F.least("chunk", y).alias("tx"), F.greatest("chunk", y).alias("ty")))
    tiles = rows.select("lang", "block", "source", "total", "chunk", F.coalesce("size", F.lit(0)).alias("size"),
                        F.col("terms.id").alias("ids"), F.col("terms.n").alias("counts"), F.inline(tile))

    def run(key: tuple, t: pa.Table) -> pa.Table:
        lang, cross, size = key[0].as_py(), key[2].as_py() != key[3].as_py(), t.column("size")[0].as_py()
        names, chunk, totals = (t.column(c).to_pylist() for c in ("source", "chunk", "total"))
        none = np.zeros(0, np.int64)
        groups = []
        for ids, counts, total in zip(t.column("ids"), t.column("counts"), totals):
            ids, counts = ((x.values.to_numpy(zero_copy_only=False).astype(np.int64) if x.is_valid else none)
                           for x in (ids, counts))
            groups.append((ids, prices(counts, max(total, 1)), int(prices(np.zeros(1, np.int64), max(total, 1))[0])))
        a, b, value = [], [], []
        for i in range(len(names)):
            for j in range(i + 1, len(names)):
                if not cross or chunk[i] != chunk[j]:
                    a.append(names[i])
                    b.append(names[j])
                    value.append(merge_pair(groups[i], groups[j], size))
        return pa.table([pa.array([lang] * len(a), pa.string()), pa.array(a, pa.string()), pa.array(b, pa.string()),
                         pa.array(value, pa.int64())], names=["lang", "a", "b", "value"])

    # all rows of a tile in one task, and tiles spread by their whole key
    dealt = tiles.repartition(shuffle_partitions(tiles.sparkSession), "lang", "block", "tx", "ty")
    merged = dealt.groupBy("lang", "block", "tx", "ty").applyInArrow(run, "lang string, a string, b string, value long")
    # chunks may meet in either order in other blocks
    return merged.groupBy("lang", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(
        F.sum("value").alias("value"))


def audit(df: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
          min_docs: int = MIN_DOCS, top_terms: int = TOP_TERMS, block_terms: int = BLOCK_TERMS,
          chunk_sources: int = CHUNK_SOURCES) -> DataFrame:
    """lang, source, part (``pair`` or ``term``), item, value and rank, as the module says."""
    counts = written(term_counts(df, text_col, lang_col, source_col).groupBy("lang", "source", "term").agg(
        F.sum("n").alias("n"), F.sum("docs").alias("docs")), "term-counts")
    names = counts.filter("term is null").select("lang", "source")
    terms = counts.filter("term is not null")
    vocabulary, langs = _vocabulary(terms, names.select("lang").distinct(), min_docs, block_terms)
    vocabulary = written(vocabulary, "numbered-terms")
    kept = written(terms.drop("docs").join(vocabulary, ["lang", "term"]), "kept-counts")
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("group_n"))
    groups = written(names.join(sums, ["lang", "source"], "left").na.fill(0, ["group_n"]), "groups")

    def price(count: str, total) -> F.Column:
        return F.expr(f"1 + (cast({UNIT} as decimal(10, 0)) * cast({count} + 2 as decimal(20, 0))) div ({total})")

    apart = (kept.join(groups, ["lang", "source"]).join(langs, "lang")
             .withColumns({"p": price("n", "group_n + 2 * v"), "q": price("total", "total_n + 2 * v")})
             .filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"),
                                     F.expr("((p - q) * (p - q)) div (p + q)").alias("value")))
    pairs = _pair_values(kept, groups, langs, vocabulary, chunk_sources)
    both = pairs.select("lang", F.lit("pair").alias("part"), "value", F.inline(F.array(
        F.struct(F.col("a").alias("source"), F.col("b").alias("item")),
        F.struct(F.col("b").alias("source"), F.col("a").alias("item")))))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return (both.withColumn("rank", rank).select(columns)
            .unionByName(apart.withColumn("rank", rank).filter(F.col("rank") <= top_terms).select(columns)))
