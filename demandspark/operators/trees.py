"""Regression trees, forests and second-order boosting, all models of a search grown together (FC4, FC8-FC10, FC14).

Rows are binned once into at most 256 bins a feature (cuts from quantile
sketches) and kept as packed blocks.  Every job is one tree: a tree of a forest, or
the tree of one boosting round of one model; jobs of all candidates and folds
are grown by the same passes, level by level:

* a level pass sums histograms (rows, weight, weighted residual) per (job, node,
  feature, bin) in every task, Spark adds them up and picks the best split of
  each node, and only the splits reach the driver;
* nodes of at most ``SMALL_ROWS`` rows are set aside; when no larger one is
  left, one more pass deals their rows by (job, node) and grows the rest of
  each subtree in one bounded group.

A node's gain is (GL^2/(HL+l) + GR^2/(HR+l) - G^2/(H+l)) / 2 - gamma with G the
weighted residuals and H the weights (the squared error's hessian), a leaf is
G/(H+l): the regularised second-order objective; with l = gamma = 0 it is the
variance reduction of ordinary regression trees.  Ties go to the first feature
and the lowest cut.

Candidates share work: a forest of fewer or shallower trees is the front or the
top of a larger one (nodes keep their values), and fewer boosting rounds are
the first rounds of more.  Folds are prefixes in time, so a fold is a limit on the
row's position.  Draws (Poisson weights of a forest, subsamples of boosting) hash the
row's position and the tree's seed, so results do not depend on partitions.

The driver and the tasks hold the models, as MLlib does; their size is checked
(``MAX_MODEL_BYTES``).  Rows with a null or NaN target are not trained on; a
missing feature value goes to the right of every split.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandspark.session import scratch_path

BINS = 256
SMALL_ROWS = 20_000        # rows of a node whose subtree one task finishes
ROWS_PER_BLOCK = 10_000
ROWS_PER_TASK = 200_000
KEEP_ROUNDS = 10           # boosting rounds between two writings of the predictions so far
ROW_JOBS_PER_PASS = 2_000_000_000   # rows times forest trees of one pass, about
HIST_BYTES = 128_000_000   # histograms a task holds before it passes them on
MAX_MODEL_BYTES = 1 << 30
UNLIMITED = 10**6
NO_LIMIT = 2**63 - 1

_POISSON = np.cumsum(np.exp(-1.0) / np.concatenate([[1.0], np.cumprod(np.arange(1.0, 12.0))]))


@dataclass
class Tree:
    """Nodes in flat arrays; children of node k are ``left[k]`` and the next one, leaves have feature -1."""
    feature: np.ndarray = field(default_factory=lambda: np.full(1, -1, np.int16))
    cut: np.ndarray = field(default_factory=lambda: np.zeros(1, np.uint8))
    left: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int32))
    value: np.ndarray = field(default_factory=lambda: np.zeros(1))

    def nodes(self, bins: np.ndarray, depth: int = UNLIMITED) -> np.ndarray:
        """The node that each row ends in after at most ``depth`` splits."""
        at = np.zeros(len(bins), np.int32)
        rows = np.arange(len(bins))
        while depth > 0 and len(rows):
            rows = rows[self.feature[at[rows]] >= 0]
            here = at[rows]
            at[rows] = self.left[here] + (bins[rows, self.feature[here]] > self.cut[here])
            depth -= 1
        return at

    def predict(self, bins: np.ndarray, depth: int = UNLIMITED) -> np.ndarray:
        return self.value[self.nodes(bins, depth)]

    def graft(self, at: int, other: "Tree") -> None:
        """Replace leaf ``at`` by another tree."""
        base = len(self.feature) - 1
        for name in ("feature", "cut", "left", "value"):
            mine, new = getattr(self, name), getattr(other, name)
            if name == "left":
                new = np.where(other.feature >= 0, new + base, 0).astype(np.int32)
            mine = np.concatenate([mine, new[1:]])
            mine[at] = new[0]
            setattr(self, name, mine)

    def nbytes(self) -> int:
        return len(self.feature) * 15


@dataclass(frozen=True)
class Growth:
    """What a tree may do: depth, rows of a node to split, rows and weight of a child, penalties."""
    max_depth: int = UNLIMITED
    min_split: int = 2
    min_rows: int = 1
    min_weight: float = 0.0
    penalty: float = 0.0
    gamma: float = 0.0


@dataclass
class Job:
    """One tree to grow over the rows before ``limit``: weights by ``sampling``, residuals of boosting model ``model``."""
    growth: Growth
    limit: int
    seed: int
    sampling: float | None       # None: Poisson weights; otherwise the share of rows drawn
    model: int | None            # row of the blocks' predictions, None: residuals from ``centre``
    centre: float = 0.0
    since: list = field(default_factory=list)     # (step, tree) grown since the predictions were written
    tree: Tree = field(default_factory=Tree)
    open: dict = field(default_factory=dict)      # node -> (rows at most, depth)

    def rows(self, pos: np.ndarray, y: np.ndarray, bins: np.ndarray, f: np.ndarray | None):
        """(rows, weights, residuals) of the job's sample in a block."""
        w = weights(pos, self.seed, self.sampling)
        rows = np.flatnonzero((pos < self.limit) & (w > 0))
        base = self.centre if self.model is None else f[self.model][rows]
        r = y[rows] - base
        for step, tree in self.since:
            r = r - step * tree.predict(bins[rows])
        return rows, w[rows], r


def weights(pos: np.ndarray, seed: int, sampling: float | None) -> np.ndarray:
    """Poisson(1) weights, or 1 for a drawn share of the rows, from hashes of position and seed."""
    if sampling is not None and sampling >= 1:
        return np.ones(len(pos))
    with np.errstate(over="ignore"):
        h = pos.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed + 1) * np.uint64(0xBF58476D1CE4E5B9)
        for k, m in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            h = (h ^ (h >> np.uint64(k))) * np.uint64(m)
    u = ((h ^ (h >> np.uint64(31))) >> np.uint64(11)) / 2.0**53
    return np.searchsorted(_POISSON, u, side="right").astype(float) if sampling is None else (u < sampling).astype(float)


def split_gain(gl, hl, g, h, growth: Growth):
    """The gain of splitting (g, h) into (gl, hl) and the rest; -inf where a child is too light."""
    gr, hr = g - gl, h - hl
    with np.errstate(divide="ignore", invalid="ignore"):
        both = gl * gl / (hl + growth.penalty) + gr * gr / (hr + growth.penalty)
        gain = (both - g * g / (h + growth.penalty)) / 2 - growth.gamma
        # rounding is no gain, and must not decide between equal ones
        ok = (hl > 0) & (hr > 0) & (hl >= growth.min_weight) & (hr >= growth.min_weight) & (gain > 1e-10 * both)
    return np.where(ok, gain, -np.inf).astype(np.float32).astype(float)


def grow(bins: np.ndarray, w: np.ndarray, r: np.ndarray, growth: Growth, depth: int = 0) -> Tree:
    """The whole (sub)tree of a bounded number of rows, all nodes of a level at once."""
    tree = Tree()
    tree.value = np.array([(w * r).sum() / max(w.sum() + growth.penalty, 1e-300)])
    at = np.zeros(len(w), np.int64)
    level = np.array([0])
    while len(level) and depth < growth.max_depth:
        rank = np.full(len(tree.feature), -1)
        rank[level] = np.arange(len(level))
        rows = np.flatnonzero(rank[at] >= 0)
        node = rank[at[rows]]
        n, h, g = (np.bincount(node, x, len(level)) for x in (None, w[rows], (w * r)[rows]))
        best = np.full(len(level), -np.inf)
        feature, cut = np.full(len(level), -1), np.zeros(len(level), np.int64)
        for j in range(bins.shape[1]):
            key = node * BINS + bins[rows, j]
            order = np.argsort(key, kind="stable")
            key, who = key[order], node[order]
            start = np.searchsorted(who, np.arange(len(level)))
            sums = [np.cumsum(np.concatenate([[0.0], x]))
                    for x in (np.ones(len(rows)), w[rows][order], (w * r)[rows][order])]
            # left of a cut: everything up to the last row of a bin
            last = np.flatnonzero(key != np.append(key[1:], -1))
            mine = who[last]
            nl, hl, gl = (s[last + 1] - s[start[mine]] for s in sums)
            gain = split_gain(gl, hl, g[mine], h[mine], growth)
            gain[(nl < growth.min_rows) | (n[mine] - nl < growth.min_rows) | (n[mine] < growth.min_split)] = -np.inf
            if not len(last):
                continue
            first = np.searchsorted(mine, np.arange(len(level)))
            top = np.maximum.reduceat(gain, first)
            place = np.flatnonzero(gain == top[mine])
            where = place[np.searchsorted(mine[place], np.arange(len(level)))]
            better = top > best
            best[better], feature[better], cut[better] = top[better], j, key[last[where[better]]] % BINS
        split = np.flatnonzero(np.isfinite(best))
        parents = level[split]
        size = len(tree.feature)
        tree.feature[parents], tree.cut[parents] = feature[split], cut[split]
        tree.left[parents] = size + 2 * np.arange(len(split))
        for name, fill in (("feature", -1), ("cut", 0), ("left", 0), ("value", 0.0)):
            a = getattr(tree, name)
            setattr(tree, name, np.concatenate([a, np.full(2 * len(split), fill, a.dtype)]))
        moved = np.isin(at, parents)
        here = at[moved]
        at[moved] = tree.left[here] + (bins[moved, tree.feature[here]] > tree.cut[here])
        level = np.arange(size, len(tree.feature))
        hh, gg = np.bincount(at, w, len(tree.feature))[size:], np.bincount(at, w * r, len(tree.feature))[size:]
        tree.value[size:] = gg / np.maximum(hh + growth.penalty, 1e-300)
        depth += 1
    return tree


def cuts_of(df: DataFrame, features: Sequence[str]) -> list[np.ndarray]:
    """Up to 255 cuts a feature, from one pass of quantile sketches; a row is left of a cut if its value is at most it."""
    levels = F.array(*[F.lit((k + 1) / BINS) for k in range(BINS - 1)])
    found = df.agg(*[F.percentile_approx(F.col(c).cast("double"), levels, F.lit(10_000)).alias(f"q{i}")
                     for i, c in enumerate(features)]).first()
    return [np.unique(np.array(q or [], float)) for q in found]


def bin_rows(x: np.ndarray, cuts: Sequence[np.ndarray]) -> np.ndarray:
    out = np.empty(x.shape, np.uint8)
    for j, c in enumerate(cuts):
        out[:, j] = np.searchsorted(c, x[:, j], side="left")
    return out


_BLOCK = "pos binary, y binary, bins binary, f binary"


def _blocks(df: DataFrame, features: Sequence[str], target: str, position: str, cuts: list[np.ndarray], rows: int) -> DataFrame:
    """The binned rows in packed blocks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS_PER_BLOCK):
                cols = [c.to_numpy(zero_copy_only=False) for c in batch.slice(lo, ROWS_PER_BLOCK).columns]
                x = np.column_stack(cols[2:]).astype(float)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([v], pa.binary()) for v in (cols[0].astype("<i8").tobytes(), cols[1].astype("<f8").tobytes(),
                                                          bin_rows(x, cuts).tobytes(), b"")], names=["pos", "y", "bins", "f"])

    return df.select(F.col(position).cast("long"), F.col(target).cast("double"), *[F.col(c).cast("double") for c in features]
                     ).repartition(max(1, -(-rows // ROWS_PER_TASK))).mapInArrow(run, _BLOCK)


def _unpacked(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[tuple]:
    for batch in batches:
        for pos, y, bins, f in zip(*[c.to_pylist() for c in batch.columns]):
            pos = np.frombuffer(pos, "<i8")
            yield (pos, np.frombuffer(y, "<f8"), np.frombuffer(bins, np.uint8).reshape(len(pos), d),
                   np.frombuffer(f, "<f8").reshape(-1, len(pos)) if f else None)


class Grower:
    """Grows lists of jobs over one table of blocks."""

    def __init__(self, blocks: DataFrame, d: int, small_rows: int = SMALL_ROWS):
        self.blocks, self.d, self.small_rows = blocks, d, small_rows
        self.spark = blocks.sparkSession
        self.parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))

    def grow(self, jobs: list[Job], rows: int) -> None:
        """Grow the trees of all jobs (``rows``: training rows in all)."""
        for job in jobs:
            job.open = {0: (min(rows, job.limit), 0)}
        while self._large(jobs):
            self._level(jobs)
        self._finish(jobs)
        size = sum(job.tree.nbytes() for job in jobs)
        if size > MAX_MODEL_BYTES:
            raise ValueError(f"trees of {size} bytes: limit the depth or ask for more rows to split")

    def _large(self, jobs: list[Job]) -> bool:
        return any(n > self.small_rows for job in jobs for n, _ in job.open.values())

    def _level(self, jobs: list[Job]) -> None:
        """Split the open nodes of more than ``small_rows`` rows once, from histograms that Spark adds up."""
        d, limit, shared = self.d, self.small_rows, self.spark.sparkContext.broadcast(jobs)

        def histograms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[tuple, np.ndarray] = {}

            def out() -> pa.RecordBatch:
                keys = list(held)
                return pa.RecordBatch.from_arrays(
                    [*[pa.array([k[i] for k in keys], pa.int32()) for i in range(3)],
                     pa.array([held[k].tobytes() for k in keys], pa.binary())], names=["job", "node", "feature", "hist"])

            for pos, y, bins, f in _unpacked(batches, d):
                for k, job in enumerate(shared.value):
                    large = [node for node, (n, _) in job.open.items() if n > limit]
                    if not large:
                        continue
                    rows, w, r = job.rows(pos, y, bins, f)
                    at = job.tree.nodes(bins[rows])
                    rank = np.full(len(job.tree.feature), -1)
                    rank[large] = np.arange(len(large))
                    here = rank[at]
                    ours = here >= 0
                    here, own, w, r = here[ours], bins[rows[ours]], w[ours], r[ours]
                    for j in range(d):
                        key = here * BINS + own[:, j]
                        h = np.stack([np.bincount(key, x, len(large) * BINS) for x in (None, w, w * r)], axis=1)
                        for i, node in enumerate(large):
                            part = h[i * BINS:(i + 1) * BINS]
                            if (k, node, j) in held:
                                held[k, node, j] += part
                            else:
                                held[k, node, j] = part.copy()
                if len(held) * BINS * 24 > HIST_BYTES:
                    yield out()
                    held = {}
            if held:
                yield out()

        def best(key: tuple, t: pa.Table) -> pa.Table:
            h = np.zeros((BINS, 3))
            for x in t.column("hist").to_pylist():
                h += np.frombuffer(x).reshape(BINS, 3)
            growth = shared.value[key[0].as_py()].growth
            left, total = np.cumsum(h, axis=0), h.sum(axis=0)
            gain = split_gain(left[:, 2], left[:, 1], total[2], total[1], growth)
            gain[(left[:, 0] < growth.min_rows) | (total[0] - left[:, 0] < growth.min_rows) | (total[0] < growth.min_split)] = -np.inf
            cut = int(np.argmax(gain))
            row = {"job": key[0].as_py(), "node": key[1].as_py(), "feature": key[2].as_py(), "cut": cut,
                   "gain": float(gain[cut]), "left": left[cut].tolist(), "total": total.tolist()}
            return pa.Table.from_pylist([row], schema=pa.schema(
                [("job", pa.int32()), ("node", pa.int32()), ("feature", pa.int32()), ("cut", pa.int32()),
                 ("gain", pa.float64()), ("left", pa.list_(pa.float64())), ("total", pa.list_(pa.float64()))]))

        sums = self.blocks.mapInArrow(histograms, "job int, node int, feature int, hist binary")
        split = sums.groupBy("job", "node", "feature").applyInArrow(
            best, "job int, node int, feature int, cut int, gain double, left array<double>, total array<double>")
        # one row a node: as many as the level has nodes
        found = split.groupBy("job", "node").agg(F.max_by(
            F.struct("feature", "cut", "gain", "left", "total"), F.struct("gain", -F.col("feature"))).alias("b")).collect()
        for job in jobs:
            for node in [k for k, (n, _) in job.open.items() if n > limit]:
                job.open[node] = (-1, job.open[node][1])
        for row in found:
            job, b = jobs[row["job"]], row["b"]
            depth = job.open[row["node"]][1]
            total, left = np.array(b["total"]), np.array(b["left"])
            value = [x[2] / max(x[1] + job.growth.penalty, 1e-300) for x in (total, left, total - left)]
            job.tree.value[row["node"]] = value[0]
            if np.isfinite(b["gain"]) and depth < job.growth.max_depth:
                job.tree.graft(row["node"], Tree(np.array([b["feature"], -1, -1], np.int16), np.array([b["cut"], 0, 0], np.uint8),
                                                 np.array([1, 0, 0], np.int32), np.array(value)))
                child = int(job.tree.left[row["node"]])
                if depth + 1 < job.growth.max_depth:
                    job.open[child], job.open[child + 1] = (int(left[0]), depth + 1), (int(total[0] - left[0]), depth + 1)
        for job in jobs:
            job.open = {k: v for k, v in job.open.items() if v[0] >= 0}

    def _finish(self, jobs: list[Job]) -> None:
        """Grow the subtrees below the open nodes, each in one group of at most ``small_rows`` rows."""
        d, shared = self.d, self.spark.sparkContext.broadcast(jobs)

        def rows_of_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for pos, y, bins, f in _unpacked(batches, d):
                cols: list[list] = [[] for _ in range(6)]
                for k, job in enumerate(shared.value):
                    if not job.open:
                        continue
                    rows, w, r = job.rows(pos, y, bins, f)
                    at = job.tree.nodes(bins[rows])
                    for node in np.unique(at).tolist():
                        if node in job.open:
                            ours = at == node
                            mine = rows[ours]
                            for c, v in zip(cols, (k, node, pos[mine].tobytes(), w[ours].tobytes(), r[ours].tobytes(),
                                                   bins[mine].tobytes())):
                                c.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
                    cols, [pa.int32(), pa.int32(), *[pa.binary()] * 4])], names=["job", "node", "pos", "w", "r", "bins"])

        def subtree(key: tuple, t: pa.Table) -> pa.Table:
            pos, w, r, bins = (np.frombuffer(b"".join(t.column(c).to_pylist()), dtype) for c, dtype in (
                ("pos", "<i8"), ("w", "<f8"), ("r", "<f8"), ("bins", np.uint8)))
            job = shared.value[key[0].as_py()]
            order = np.argsort(pos, kind="stable")     # sums then do not depend on the order of arrival
            got = grow(bins.reshape(-1, d)[order], w[order], r[order], job.growth, job.open[key[1].as_py()][1])
            return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([key[1].as_py()], pa.int32()),
                             *[pa.array([x.tobytes()], pa.binary()) for x in (got.feature, got.cut, got.left, got.value)]],
                            names=["job", "node", "feature", "cut", "left", "value"])

        dealt = self.blocks.mapInArrow(rows_of_nodes, "job int, node int, pos binary, w binary, r binary, bins binary")
        # (a given number of partitions is not coalesced, so small subtrees still spread over the cores)
        found = dealt.repartition(self.parts, "job", "node").groupBy("job", "node").applyInArrow(
            subtree, "job int, node int, feature binary, cut binary, left binary, value binary")
        for row in found.collect():     # the trees, whose size ``grow`` checks
            jobs[row["job"]].tree.graft(row["node"], Tree(*[np.frombuffer(bytes(row[c]), t).copy() for c, t in (
                ("feature", np.int16), ("cut", np.uint8), ("left", np.int32), ("value", float))]))
        for job in jobs:
            job.open = {}


@dataclass
class TreeModel:
    """A fitted ensemble: ``base`` plus ``step`` times the trees' predictions (averaged in a forest)."""
    kind: str
    features: list[str]
    params: dict
    cuts: list[np.ndarray]
    trees: list[Tree]
    base: float
    step: float
    depth: int = UNLIMITED

    def predict_bins(self, bins: np.ndarray) -> np.ndarray:
        out = np.zeros(len(bins))
        for t in self.trees:
            out += t.predict(bins, self.depth)
        scale = 1 / len(self.trees) if self.kind == "random_forest" and self.trees else self.step
        return self.base + scale * out

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with a prediction column."""
        shared = df.sparkSession.sparkContext.broadcast(self)

        @F.pandas_udf("double")
        def predicted(*cols: pd.Series) -> pd.Series:
            m = shared.value
            x = np.column_stack([c.to_numpy(float) for c in cols])
            return pd.Series(m.predict_bins(bin_rows(x, m.cuts)))

        return df.withColumn("prediction", predicted(*[F.col(c).cast("double") for c in self.features]))

    def to_json(self) -> str:
        return json.dumps({**{k: getattr(self, k) for k in ("kind", "features", "params", "base", "step", "depth")},
                           "cuts": [c.tolist() for c in self.cuts],
                           "trees": [[x.tolist() for x in (t.feature, t.cut, t.left, t.value)] for t in self.trees]})

    @staticmethod
    def from_json(text: str) -> "TreeModel":
        m = json.loads(text)
        trees = [Tree(np.array(a, np.int16), np.array(b, np.uint8), np.array(c, np.int32), np.array(v, float))
                 for a, b, c, v in m.pop("trees")]
        return TreeModel(**{**m, "cuts": [np.array(c, float) for c in m["cuts"]], "trees": trees})


#: What a kind's trees are grown with beside the candidate's parameters.  Fixed values: the usual
#: defaults of second-order boosting (penalty 1, no split cost, child weight of at least 1, depth 6).
DEFAULTS = {"random_forest": {"numTrees": 100, "maxDepth": None},
            "gradient_boosting": {"maxIter": 100, "stepSize": 0.1, "maxDepth": 3},
            "boosted_subsampled": {"maxIter": 100, "stepSize": 0.3, "maxDepth": 6, "regLambda": 1.0, "gamma": 0.0,
                                   "minChildWeight": 1.0}}


def _growth(params: Mapping) -> Growth:
    depth = params.get("maxDepth")
    return Growth(UNLIMITED if depth is None else depth, params.get("minSplit", 2), params.get("minInstancesPerNode", 1),
                  params.get("minChildWeight", 0.0), params.get("regLambda", 0.0), params.get("gamma", 0.0))


@dataclass
class Request:
    """A model to fit on the rows before ``limit`` (all rows if None)."""
    kind: str
    params: Mapping
    limit: int | None = None


def fit_many(train: DataFrame, features: Sequence[str], requests: Sequence[Request], target: str,
             position: str = "position", seed: int = 42, small_rows: int = SMALL_ROWS) -> list[TreeModel]:
    """Fit all requested models over shared passes; ``position`` numbers the rows and orders the limits.

    Without training rows every prediction is 0.
    """
    features = list(features)
    train = train.filter(F.col(target).isNotNull() & ~F.isnan(F.col(target).cast("double")))
    limits = sorted({r.limit for r in requests if r.limit is not None})
    means = train.agg(F.count(F.lit(1)).alias("n"), F.avg(target).alias("mean"),
                      *[F.avg(F.when(F.col(position) < x, F.col(target))).alias(f"m{i}") for i, x in enumerate(limits)]).first()
    rows = means["n"]
    mean = {None: means["mean"] or 0.0, **{x: means[f"m{i}"] or 0.0 for i, x in enumerate(limits)}}
    cuts = cuts_of(train, features)
    spark = train.sparkSession

    def written(df: DataFrame) -> DataFrame:
        path = scratch_path(spark, "tree-blocks")
        df.write.parquet(path)
        return spark.read.schema(_BLOCK).parquet(path)

    grower = Grower(written(_blocks(train, features, target, position, cuts, rows)), len(features), small_rows)
    full = [{**DEFAULTS[r.kind], **r.params} for r in requests]
    out: list[TreeModel | None] = [None] * len(requests)
    _forests(grower, requests, full, out, features, cuts, mean, rows, seed)
    _boosted(grower, written, requests, full, out, features, cuts, mean, rows, seed)
    return out


def _forests(grower, requests, full, out, features, cuts, mean, rows, seed) -> None:
    """Forests that differ only in the number and depth of their trees are cut from the largest."""
    shared: dict[tuple, list[int]] = {}
    for i, r in enumerate(requests):
        if r.kind == "random_forest":
            rest = tuple(sorted((k, v) for k, v in full[i].items() if k not in ("numTrees", "maxDepth")))
            shared.setdefault((r.limit, rest), []).append(i)
    forests = []
    for (limit, _), members in shared.items():
        depths = [full[i]["maxDepth"] for i in members]
        deepest = {**full[members[0]], "maxDepth": None if None in depths else max(depths)}
        trees = max(full[i]["numTrees"] for i in members)
        forests.append((members, [Job(_growth(deepest), NO_LIMIT if limit is None else limit, seed * 1000 + t, None, None,
                                      mean[limit]) for t in range(trees)]))
    jobs = [job for _, js in forests for job in js]
    step = max(1, ROW_JOBS_PER_PASS // max(rows, 1))
    for lo in range(0, len(jobs), step):
        grower.grow(jobs[lo:lo + step], rows)
    for members, js in forests:
        for i in members:
            depth = full[i]["maxDepth"]
            out[i] = TreeModel("random_forest", features, dict(full[i]), cuts, [j.tree for j in js[:full[i]["numTrees"]]],
                               mean[requests[i].limit], 1.0, UNLIMITED if depth is None else depth)


def _boosted(grower, written, requests, full, out, features, cuts, mean, rows, seed) -> None:
    """One pass set a round for all boosted models; those that differ only in rounds are one model."""
    shared: dict[tuple, list[int]] = {}
    for i, r in enumerate(requests):
        if r.kind != "random_forest":
            rest = tuple(sorted((k, v) for k, v in full[i].items() if k != "maxIter"))
            shared.setdefault((r.kind, r.limit, rest), []).append(i)
    models = [{"limit": limit, "params": full[members[0]], "rounds": max(full[i]["maxIter"] for i in members),
               "trees": [], "members": members} for (_, limit, _), members in shared.items()]
    if not models:
        return
    d, bases = len(features), [mean[m["limit"]] for m in models]

    def with_predictions(blocks: DataFrame, since: list[list]) -> DataFrame:
        """The blocks with the predictions of all models so far."""
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for pos, y, bins, f in _unpacked(batches, d):
                new = np.repeat(np.array(bases)[:, None], len(pos), axis=1) if f is None else f.copy()
                for k, trees in enumerate(since):
                    for step, tree in trees:
                        new[k] += step * tree.predict(bins)
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (pos, y, bins, new)],
                                                 names=["pos", "y", "bins", "f"])
        return written(blocks.mapInArrow(run, _BLOCK))

    plain = grower.blocks
    grower.blocks = with_predictions(plain, [[] for _ in models])
    since: list[list] = [[] for _ in models]
    for t in range(max(m["rounds"] for m in models)):
        if t and t % KEEP_ROUNDS == 0:
            grower.blocks = with_predictions(grower.blocks, since)
            since = [[] for _ in models]
        live = [k for k, m in enumerate(models) if t < m["rounds"]]
        jobs = [Job(_growth(models[k]["params"]), NO_LIMIT if models[k]["limit"] is None else models[k]["limit"],
                    seed * 1000 + t, models[k]["params"].get("subsamplingRate", 1.0), k, since=since[k]) for k in live]
        grower.grow(jobs, rows)
        for k, job in zip(live, jobs):
            models[k]["trees"].append(job.tree)
            since[k] = [*since[k], (models[k]["params"]["stepSize"], job.tree)]
    grower.blocks = plain
    for m in models:
        for i in m["members"]:
            out[i] = TreeModel(requests[i].kind, features, dict(full[i]), cuts, m["trees"][:full[i]["maxIter"]],
                               mean[m["limit"]], full[i]["stepSize"])


def squared_errors(test: DataFrame, models: Sequence[TreeModel], ranges: Sequence[tuple[int, int]], target: str,
                   position: str = "position") -> list[float]:
    """Each model's mean squared error over the rows of its position range, all in one pass."""
    shared = test.sparkSession.sparkContext.broadcast((list(models), list(ranges)))
    features = models[0].features

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted, spans = shared.value
        for batch in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            bins = bin_rows(np.column_stack(cols[2:]).astype(float), fitted[0].cuts)
            n, sums = [], []
            for model, (lo, hi) in zip(fitted, spans):
                rows = np.flatnonzero((cols[0] >= lo) & (cols[0] < hi))
                n.append(len(rows))
                sums.append(float(((cols[1][rows] - model.predict_bins(bins[rows])) ** 2).sum()))
            yield pa.RecordBatch.from_arrays([pa.array(range(len(n)), pa.int32()), pa.array(n, pa.int64()), pa.array(sums, pa.float64())],
                                             names=["model", "n", "sse"])

    got = (test.filter(F.col(target).isNotNull())
           .select(F.col(position).cast("long"), F.col(target).cast("double"), *[F.col(c).cast("double") for c in features])
           .mapInArrow(run, "model int, n long, sse double").groupBy("model").agg((F.sum("sse") / F.sum("n")).alias("mse")).collect())
    mse = {r["model"]: r["mse"] for r in got}     # one number a model
    return [mse.get(i) if mse.get(i) is not None else float("inf") for i in range(len(models))]


@dataclass
class TreeEstimator:
    """One model as an estimator, for callers that fit a single one."""
    kind: str
    features: Sequence[str]
    params: Mapping
    target: str
    seed: int = 42

    def fit(self, df: DataFrame) -> TreeModel:
        position = next((c for c in ("position", "row_id") if c in df.columns), None)
        if position is None:
            position = "position"
            df = df.withColumn(position, F.xxhash64(*self.features, self.target))
        return fit_many(df, self.features, [Request(self.kind, self.params)], self.target, position, self.seed)[0]
