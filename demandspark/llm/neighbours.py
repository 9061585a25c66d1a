"""Approximate nearest neighbours by HNSW graphs per shard (operator 4).

Equal vectors are first merged into one entry that keeps its smallest ids (as
many as a result can use), so copies neither crowd a graph nor fill a task.
The distinct vectors are dealt into shards of bounded size; each shard gets a
hierarchical navigable small-world graph, stored as flat neighbour arrays in a
written table.  Blocks of queries search every shard, and the best candidates
of all shards are merged and scored exactly in double precision.

Edge cases: vectors that are null, empty, zero or hold null or non-finite
components take no part; vectors are compared with those of the same length
only; a repeated id counts as one row if its vector is equal (otherwise each of
its vectors takes part under that id); with fewer candidates than asked for,
all are returned; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from demandspark.llm.common import let, written

SHARD_ROWS = 8192
QUERY_BLOCK = 4096         # queries of one search task
DEGREE = 16                # links per vector in the upper levels, twice as many at level 0
BUILD_BEAM = 96
SEARCH_BEAM = 96
INSERT_BLOCK = 128


class Hnsw:
    """A navigable small-world hierarchy over unit vectors, with flat neighbour arrays.

    ``links[l]`` has one row of neighbour positions for each vector, -1 where
    there is none; vectors that are not in level ``l`` have an empty row.
    """

    def __init__(self, vectors: np.ndarray, levels: np.ndarray, links: list[np.ndarray]):
        self.vectors, self.levels, self.links = vectors, levels, links

    @staticmethod
    def build(vectors: np.ndarray, seed: int = 17) -> "Hnsw":
        n = len(vectors)
        draws = np.random.default_rng(seed).random(n)
        levels = np.minimum((-np.log(draws + 1e-12) / np.log(DEGREE)).astype(np.int64), 4)
        order = np.argsort(-levels, kind="stable")   # upper levels first: the entry point never changes
        vectors, levels = vectors[order], levels[order]
        # rows have room for twice the links that are kept, so that few insertions have to thin one out
        links = [np.full((n, 2 * Hnsw.kept(lv)), -1, np.int32) for lv in range(int(levels.max()) + 1)]
        graph = Hnsw(vectors, levels, links)
        graph.order = order
        start = 0
        while start < n:
            # small blocks first, so that a block is never large against the graph it joins
            stop = min(n, start + max(1, min(INSERT_BLOCK, start // 2)))
            graph._insert(start, stop)
            start = stop
        return graph

    @staticmethod
    def kept(level: int) -> int:
        """Links of a vector that are kept when its row is thinned out."""
        return DEGREE * (2 if level == 0 else 1)

    def _insert(self, start: int, stop: int) -> None:
        block = np.arange(start, stop)
        entry = np.zeros(len(block), np.int64)
        for level in range(len(self.links) - 1, -1, -1):
            mine = self.levels[block] >= level
            if start:
                beam = BUILD_BEAM if mine.any() else 1
                ids, sims = self._beam(self.vectors[block], entry, level, beam, start)
                entry = np.where(ids[:, 0] >= 0, ids[:, 0], entry)
            else:
                ids = np.zeros((len(block), 0), np.int64)
                sims = np.zeros((len(block), 0))
            if not mine.any():
                continue
            # vectors of the block also see each other
            inner = self.vectors[block] @ self.vectors[block].T
            allowed = mine[:, None] & mine[None, :] & (block[None, :] < block[:, None])
            inner = np.where(allowed, inner, -np.inf)
            ids = np.concatenate([ids, np.where(allowed, block[None, :], -1)], axis=1)
            sims = np.concatenate([sims, inner], axis=1)
            for row in np.flatnonzero(mine):
                found = ids[row][np.argsort(-sims[row], kind="stable")]
                found = found[found >= 0]
                chosen = self._spread(block[row], found, self.kept(level))
                self._set(level, block[row], chosen)
                for other in chosen:
                    self._add(level, other, block[row])

    def _spread(self, node: int, found: np.ndarray, most: int) -> np.ndarray:
        """Of candidates from near to far, those nearer to the node than to one already chosen; then the rest."""
        if len(found) <= most:
            return found
        found = found[:4 * most]
        v = self.vectors[found]
        to_node = v @ self.vectors[node]
        among = v @ v.T
        chosen: list[int] = []
        shadow = np.full(len(found), -np.inf)
        for i in range(len(found)):
            if shadow[i] <= to_node[i]:
                chosen.append(i)
                if len(chosen) == most:
                    break
                np.maximum(shadow, among[i], out=shadow)
        if len(chosen) < most:
            taken = set(chosen)
            chosen += [i for i in range(len(found)) if i not in taken][:most - len(chosen)]
        return found[chosen]

    def _set(self, level: int, node: int, chosen: np.ndarray) -> None:
        row = self.links[level][node]
        row[:] = -1
        row[:len(chosen)] = chosen

    def _add(self, level: int, node: int, new: int) -> None:
        row = self.links[level][node]
        free = np.flatnonzero(row < 0)
        if len(free):
            row[free[0]] = new
            return
        found = np.append(row, new)
        found = found[np.argsort(-(self.vectors[found] @ self.vectors[node]), kind="stable")]
        self._set(level, node, self._spread(node, found, self.kept(level)))

    def _beam(self, queries: np.ndarray, entry: np.ndarray, level: int, beam: int,
              limit: int) -> tuple[np.ndarray, np.ndarray]:
        """Best-first search of all queries at once; ids (-1: none) and similarities, best first."""
        q = len(queries)
        rows = np.arange(q)
        seen = np.zeros((q, limit), bool)
        ids = np.full((q, beam), -1, np.int64)
        sims = np.full((q, beam), -np.inf)
        open_ = np.zeros((q, beam), bool)
        ids[:, 0], sims[:, 0], open_[:, 0] = entry, np.einsum("qd,qd->q", queries, self.vectors[entry]), True
        seen[rows, entry] = True
        links = self.links[level]
        active = rows
        while len(active):
            best = np.argmax(np.where(open_[active], sims[active], -np.inf), axis=1)
            going = open_[active, best]
            active, best = active[going], best[going]
            if not len(active):
                break
            open_[active, best] = False
            near = links[ids[active, best]].astype(np.int64)
            ok = (near >= 0) & (near < limit)
            ok &= ~seen[active[:, None], np.where(ok, near, 0)]
            near = np.where(ok, near, 0)
            r, c = np.nonzero(ok)
            seen[active[r], near[r, c]] = True
            new = np.where(ok, np.einsum("qmd,qd->qm", self.vectors[near], queries[active]), -np.inf)
            all_sims = np.concatenate([sims[active], new], axis=1)
            all_ids = np.concatenate([ids[active], np.where(ok, near, -1)], axis=1)
            all_open = np.concatenate([open_[active], ok], axis=1)
            top = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
            ids[active] = np.take_along_axis(all_ids, top, 1)
            sims[active] = np.take_along_axis(all_sims, top, 1)
            open_[active] = np.take_along_axis(all_open, top, 1) & np.isfinite(sims[active])
        by = np.argsort(-sims, axis=1, kind="stable")
        return np.take_along_axis(ids, by, 1), np.take_along_axis(sims, by, 1)

    def search(self, queries: np.ndarray, k: int, beam: int = SEARCH_BEAM) -> np.ndarray:
        """Positions (in the stored order) of the ``k`` nearest found for each query, -1 where there are fewer."""
        entry = np.zeros(len(queries), np.int64)
        n = len(self.vectors)
        for level in range(len(self.links) - 1, 0, -1):
            entry = self._beam(queries, entry, level, 1, n)[0][:, 0]
        return self._beam(queries, entry, 0, max(beam, k), n)[0][:, :k]


def _unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=1, keepdims=True)   # no overflow in the squares
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def valid(vector: Column) -> Column:
    """Whether a vector takes part: not null or empty, all components finite, not zero."""
    v = vector.cast("array<double>")
    finite = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0.0), F.lit(False))


def distinct_vectors(df: DataFrame, id_col: str, vector_col: str, keep: int) -> DataFrame:
    """One row per distinct valid vector: v (doubles), vid (smallest id), ids (its ``keep`` smallest ids).

    The row-number limit is applied before the shuffle as well, so a vector
    that a third of all rows share sends a few rows per task.
    """
    rows = df.filter(valid(F.col(vector_col))).select(
        F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).filter("id is not null")
    by = Window.partitionBy("h", "v").orderBy("id")
    first = (rows.withColumn("h", F.xxhash64("v"))
             .withColumn("rank", F.dense_rank().over(by)).filter(F.col("rank") <= keep))
    return (first.groupBy("h", "v").agg(F.array_sort(F.collect_set("id")).alias("ids"))
            .select("v", F.get("ids", F.lit(0)).alias("vid"), "ids"))


def build_index(entries: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per shard and vector length: dim, shard, vids, vectors, levels and the flat links of each level."""
    total = entries.groupBy(F.size("v").alias("dim")).count().agg(F.max("count")).first()[0] or 0
    shards = max(1, -(-total // shard_rows))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vid")
        unit = _unit(np.array(pdf["v"].tolist(), float))
        graph = Hnsw.build(unit)
        return pd.DataFrame({
            "dim": [int(key[0])], "shard": [int(key[1])], "vids": [pdf["vid"].to_numpy()[graph.order]],
            "vectors": [graph.vectors.ravel()], "links": [[x.ravel() for x in graph.links]]})

    dealt = entries.select("v", "vid", F.size("v").alias("dim"),
                           F.pmod(F.xxhash64("vid"), F.lit(shards)).alias("shard"))
    return dealt.groupBy("dim", "shard").applyInPandas(
        run, "dim long, shard long, vids array<long>, vectors array<double>, links array<array<int>>")


def search_index(index: DataFrame, queries: DataFrame, k: int, beam: int = SEARCH_BEAM) -> DataFrame:
    """Candidates (qid, vid): the ``k`` nearest distinct vectors of each shard for every query (qid, v)."""
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    last = index.agg(F.max("shard")).first()[0] or 0
    asked = queries.select("qid", "v", F.size("v").cast("long").alias("dim"),
                           F.pmod(F.xxhash64("qid"), F.lit(blocks)).alias("block"),
                           F.explode(F.sequence(F.lit(0), F.lit(last)).cast("array<bigint>")).alias("shard"))
    copies = index.select("*", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<bigint>")).alias("block"))

    def run(graph: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(graph) or not len(asked):
            return pd.DataFrame({"qid": np.zeros(0, np.int64), "vid": np.zeros(0, np.int64)})
        row = graph.iloc[0]
        vids = np.asarray(row["vids"])
        n = len(vids)
        built = Hnsw(np.asarray(row["vectors"], float).reshape(n, -1), None,
                     [np.asarray(x, np.int32).reshape(n, -1) for x in row["links"]])
        unit = _unit(np.array(asked["v"].tolist(), float))
        out = []
        for lo in range(0, len(unit), 256):
            found = built.search(unit[lo:lo + 256], min(k, n), beam)
            qid = np.repeat(asked["qid"].to_numpy()[lo:lo + 256], found.shape[1])
            ok = found.ravel() >= 0
            out.append(pd.DataFrame({"qid": qid[ok], "vid": vids[found.ravel()[ok]]}))
        return pd.concat(out)

    keys = ["dim", "shard", "block"]
    return copies.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(run, "qid long, vid long")


def _scaled(v: Column) -> Column:
    """The vector times a power of two that brings its largest component near 1, so that no square over- or underflows.

    A power of two changes no digit, so cosines stay what they are.
    """
    def by_largest(m: Column) -> Column:
        power = F.pow(F.lit(2.0), F.greatest(F.least(-F.floor(F.log2(m)), F.lit(1000)), F.lit(-1000)).cast("double"))
        return F.transform(v, lambda x: x * power)
    return let(F.array_max(F.transform(v, lambda x: F.abs(x))), by_largest)


def _cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision of two scaled vectors."""
    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def nearest(df: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding",
            beam: int = SEARCH_BEAM) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest rows found for every query row, without itself."""
    entries = written(distinct_vectors(df, id_col, vector_col, k + 1), "ann-entries")
    index = written(build_index(entries), "ann-index")
    queries = written(df.filter(is_query & valid(F.col(vector_col))).select(
        F.col(id_col).cast("long").alias("qid"), F.col(vector_col).cast("array<double>").alias("v")).distinct(),
        "ann-queries")
    # the query's own vector holds its copies: always a candidate, even if the search does not reach it
    own = (queries.withColumn("h", F.xxhash64("v")).join(entries.withColumn("h", F.xxhash64("v")), ["h", "v"])
           .select("qid", "vid"))
    found = search_index(index, queries, k + 1, beam).unionByName(own).distinct()
    scored = (found.join(entries.select("vid", _scaled(F.col("v")).alias("cv"), "ids"), "vid")
              .join(queries.select("qid", _scaled(F.col("v")).alias("v")), "qid")
              .select(F.col("qid").alias("query_id"), F.explode("ids").alias("vec_id"), _cosine(F.col("v"), F.col("cv")).alias("score"))
              .filter("vec_id <> query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score")))
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (scored.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
