"""N-gram Jaccard join by MinHash LSH bands of fixed depth (operator 7).

1. Every text becomes the set of hashes of its five-word shingles; texts with
   equal sets form a *set class* (one representative, a number of copies), so
   groups of copies are never paired.
2. Each class has one MinHash signature, read as ``TREES`` bands of
   ``MAX_DEPTH`` values.  How long a prefix of a band must match follows from
   the threshold and the target recall alone, by a closed formula; it is not
   shortened from the data, and no trie is built or sorted.  Classes with the
   same hashed prefix in a band (a node) are candidates; longer matches are
   among them.
3. Within a node, pairs whose signatures agree far less than the threshold
   asks for are set aside (``SLACK`` standard errors, part of the target
   recall), and the rest is written as a spanning forest, not as pairs.  Its
   connected components are the groups to verify, so that texts which only
   share a common passage do not chain.
4. Each group is verified exactly: shingle sets meet in tiles of bounded size,
   which count links and return a spanning forest of the verified links.  Their
   components are the classes of the result.

Nodes and groups of any size are split into tiles, pairs of chunks of bounded
size; no pair becomes a row.

Words are runs of letters and digits, lower-cased.  Edge cases: a text of one
to four words has one shingle, all its words; a null text or a text without
words has no shingle, is in a class of its own and has no links; repeated rows
count as copies of each other; a null id is kept, and a class is named by its
least id that is not null; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandspark.llm.common import shuffle_partitions, written
from demandspark.llm.components import components

SHINGLE = 5
THRESHOLD = 0.8
TREES = 24
MAX_DEPTH = 6
TARGET_RECALL = 0.9999
SLACK = 5.5                 # standard errors below the threshold at which a signature still counts
TILE_ROWS = 2048            # signatures of one chunk of a trie node
TILE_TEXTS = 1024           # shingle sets of one chunk of a group
TILE_BYTES = 4_000_000      # bytes of shingles of one chunk of a group, about
CACHED_WORDS = 200_000

_WORD = re.compile(r"[^\W_]+")
_MIX = np.random.default_rng(20240607).integers(1, 2**63, size=(SHINGLE + TREES * MAX_DEPTH), dtype=np.uint64) | np.uint64(1)
_hashes: dict[str, int] = {}


def match_depth(threshold: float, target_recall: float, trees: int = TREES, max_depth: int = MAX_DEPTH) -> int:
    """The longest prefix with which the forest finds pairs at ``threshold`` with the target recall."""
    depth = max_depth
    while depth > 1 and 1 - (1 - threshold ** depth) ** trees < target_recall:
        depth -= 1
    return depth


def shingle_set(text: str, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``size`` words."""
    words = _WORD.findall(text.lower())
    if not words:
        return np.zeros(0, np.uint64)
    if len(_hashes) > CACHED_WORDS:
        _hashes.clear()
    # (a set minus a dict's keys would walk the whole dict)
    for w in set(words):
        if w not in _hashes:
            _hashes[w] = xxhash.xxh3_64_intdigest(w)
    h = np.fromiter((_hashes[w] for w in words), np.uint64, len(words))
    n = max(len(h) - size + 1, 1)
    s = np.full(n, min(len(h), size), np.uint64)   # a short text differs from a longer one that starts alike
    for k in range(min(size, len(h))):
        s = (s ^ h[k:k + n]) * _MIX[k]
        s ^= s >> np.uint64(29)
    return np.unique(s)


def _signature(s: np.ndarray) -> np.ndarray:
    """MinHash values, 32 bits each."""
    best = np.full(TREES * MAX_DEPTH, 2**32 - 1, np.uint64)
    for lo in range(0, len(s), 2048):
        block = s[lo:lo + 2048] ^ (s[lo:lo + 2048] >> np.uint64(32))
        best = np.minimum(best, ((block[None, :] * _MIX[SHINGLE:, None]) >> np.uint64(32)).min(axis=1))
    return best.astype(np.uint32)


def _per_row(df: DataFrame, id_col: str, text_col: str, compute: Callable[[str], tuple | None], fields: list[tuple]) -> DataFrame:
    """(id, key, *fields) by ``compute``, key being the hash of id and text; rows that give None are left out."""
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                got = [compute(t or "") for t in part.column(2).to_pylist()]
                keep = [i for i, g in enumerate(got) if g is not None]
                at = pa.array(keep, pa.int64())
                cols = zip(*[got[i] for i in keep]) if keep else [[] for _ in fields]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(at), part.column(1).take(at),
                     *[pa.array(list(c), t) for c, (_, t, _) in zip(cols, fields)]],
                    names=["id", "key", *[f for f, _, _ in fields]])
        # the worker goes on to other tasks and stages
        _hashes.clear()
        pa.default_memory_pool().release_unused()

    schema = f"id {id_type}, key long, " + ", ".join(f"{f} {sql}" for f, _, sql in fields)
    return df.select(F.col(id_col).alias("id"), F.xxhash64(id_col, text_col).alias("key"),
                     F.col(text_col).alias("text")).mapInArrow(run, schema)


def _class_key(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes())


def signatures(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, cls, sig, low) of every row; cls, the 128-bit hash of the shingle set, is null without shingles.

    ``low`` holds the low byte of each MinHash value.
    """
    def compute(text: str) -> tuple:
        s = shingle_set(text)
        if not len(s):
            return None, None, None
        sig = _signature(s)
        return _class_key(s), sig.tobytes(), sig.astype(np.uint8).tobytes()
    return _per_row(df, id_col, text_col, compute, [(c, pa.binary(), "binary") for c in ("cls", "sig", "low")])


def _nodes(classes: DataFrame, depth: int) -> DataFrame:
    """(node, cls): the trie node of each class in each tree at ``depth``, as a 64-bit hash of its path."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cls, sig = batch.column(0), batch.column(1)
            values = np.frombuffer(b"".join(sig.to_pylist()), np.uint32).reshape(-1, TREES, MAX_DEPTH)
            path = np.broadcast_to(np.arange(1, TREES + 1, dtype=np.uint64), values.shape[:2]).copy()
            for k in range(depth):
                path = (path ^ values[:, :, k]) * _MIX[k]
                path ^= path >> np.uint64(31)
            rows = np.repeat(np.arange(len(cls)), TREES)
            yield pa.RecordBatch.from_arrays([pa.array(path.ravel().view(np.int64)), cls.take(pa.array(rows))],
                                             names=["node", "cls"])
    return classes.select("cls", "sig").mapInArrow(run, "node long, cls binary")


def _tiles(df: DataFrame, key: str, chunks: Column) -> DataFrame:
    """Deal each key's rows into chunks by hash and copy each row to the tiles (pairs of chunks) it is part of."""
    chunked = df.withColumn("chunk", F.pmod(F.xxhash64("cls"), chunks)).withColumn("chunks", chunks)
    tile = F.transform(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1),
                       lambda y: F.struct(F.least("chunk", y).alias("tx"), F.greatest("chunk", y).alias("ty")))
    n = shuffle_partitions(df.sparkSession)
    return (chunked.select("*", F.inline(tile)).drop("chunks")
            .repartition(n, key, "tx", "ty").sortWithinPartitions(key, "tx", "ty"))


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The runs of equal (first column, tx, ty) of a sorted stream, as tables."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = list(zip(batch.column(0).to_pylist(), batch.column("tx").to_pylist(), batch.column("ty").to_pylist()))
        start = 0
        for i in range(len(keys) + 1):
            if i < len(keys) and keys[i] == last:
                continue
            if i > start:
                held.append(batch.slice(start, i - start))
            if i < len(keys):
                if held:
                    yield pa.Table.from_batches(held)
                held, last, start = [], keys[i], i
    if held:
        yield pa.Table.from_batches(held)


class Forest:
    """A spanning forest of pairs that arrive row by row, as one label a node and at most one edge less than nodes."""

    def __init__(self, n: int):
        self.label = np.arange(n)
        self.a: list[int] = []
        self.b: list[int] = []

    def link(self, i: int, others: np.ndarray) -> None:
        """Join node ``i`` with ``others``; of each tree so joined one edge is kept."""
        labels, first = np.unique(self.label[others], return_index=True)
        new = labels != self.label[i]
        if new.any():
            self.a += [i] * int(new.sum())
            self.b += others[first[new]].tolist()
            self.label[np.isin(self.label, labels[new])] = self.label[i]


def candidate_groups(classes: DataFrame, threshold: float, target_recall: float) -> DataFrame:
    """(cls, grp) of every class with a candidate partner."""
    depth = match_depth(threshold, target_recall)
    # the share of equal values has this standard error at the threshold
    values = TREES * MAX_DEPTH
    floor = max(0.0, threshold - SLACK * (threshold * (1 - threshold) / values) ** 0.5) * values
    nodes = _nodes(classes, depth)
    crowded = nodes.groupBy("node").count().filter("count > 1")
    members = nodes.join(crowded, "node")
    members = members.join(classes.select("cls", "low"), "cls")
    tiles = _tiles(members, "node", F.ceil(F.col("count") / TILE_ROWS)).select("node", "tx", "ty", "chunk", "cls", "low")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches):
            cls = t.column("cls").to_pylist()
            n = len(cls)
            if n < 2:
                continue
            sig = np.frombuffer(b"".join(t.column("low").to_pylist()), np.uint8).reshape(n, values)
            chunk = np.array(t.column("chunk").to_pylist())
            cross = t.column("tx")[0].as_py() != t.column("ty")[0].as_py()
            forest = Forest(n)
            for i in range(n - 1):
                same = (sig[i + 1:] == sig[i]).sum(axis=1) >= floor
                if cross:
                    same &= chunk[i + 1:] != chunk[i]
                forest.link(i, np.flatnonzero(same) + i + 1)
            if forest.a:
                yield pa.RecordBatch.from_arrays([pa.array([cls[x] for x in forest.a], pa.binary()),
                                                  pa.array([cls[y] for y in forest.b], pa.binary())], names=["a", "b"])

    links = written(tiles.mapInArrow(run, "a binary, b binary"), "candidate-links")
    return components(links).select(F.col("node").alias("cls"), F.col("root").alias("grp"))


def _verify(sets: list[np.ndarray], left: np.ndarray, cross: bool, threshold: float) -> np.ndarray:
    """Boolean matrix of the pairs with Jaccard similarity at or above the threshold (upper triangle)."""
    n = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(n), size)
    _, code, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = count[code] > 1
    code, owner = code[shared], owner[shared]
    order = np.argsort(code, kind="stable")
    code, owner = code[order], owner[order]
    column = np.cumsum(np.concatenate([[0], code[1:] != code[:-1]])) if len(code) else code
    both = np.zeros((n, n), np.float32)
    width = max(64, 4_000_000 // n)
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        part = slice(np.searchsorted(column, lo), np.searchsorted(column, lo + width))
        m = np.zeros((n, min(width, int(column[-1]) + 1 - lo)), np.float32)
        m[owner[part], column[part] - lo] = 1
        both += m @ m.T
    linked = np.empty((n, n), bool)
    for lo in range(0, n, 256):
        part = both[lo:lo + 256]
        linked[lo:lo + 256] = part >= (threshold - 1e-6) * (size[lo:lo + 256, None] + size[None, :] - part)
    linked &= np.triu(np.ones((n, n), bool), 1)
    if cross:
        linked &= left[:, None] != left[None, :]
    return linked


def verified_links(df: DataFrame, classes: DataFrame, groups: DataFrame, id_col: str, text_col: str,
                   threshold: float) -> DataFrame:
    """Per tile: (cls, links) counts, weighted by copies, and (a, b) edges of a spanning forest of the links."""
    wanted = written(classes.join(groups, "cls").select("cls", "grp", "rep", "copies"), "candidates")

    def compute(text: str) -> tuple | None:
        s = shingle_set(text)
        return (_class_key(s), s.tobytes()) if len(s) else None

    reps = wanted.select("rep").distinct()
    texts = df.join(reps, F.col(id_col).eqNullSafe(F.col("rep")), "left_semi")
    sets = _per_row(texts, id_col, text_col, compute,
                    [("cls", pa.binary(), "binary"), ("shingles", pa.binary(), "binary")])
    # a repeated id may bring other texts along: only wanted classes stay, once each
    sets = sets.groupBy("cls").agg(F.max("shingles").alias("shingles")).join(wanted, "cls")
    sets = written(sets.select("grp", "cls", "copies", "shingles"), "candidate-sets")
    sizes = sets.groupBy("grp").agg(F.greatest(F.ceil(F.count(F.lit(1)) / TILE_TEXTS),
                                               F.ceil(F.sum(F.octet_length("shingles")) / TILE_BYTES)).alias("n"))
    tiles = _tiles(sets.join(sizes, "grp"), "grp", F.col("n")).select(
        "grp", "tx", "ty", "chunk", "cls", "copies", "shingles")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches):
            cls = t.column("cls").to_pylist()
            if len(cls) < 2:
                continue
            sets = [np.frombuffer(x, np.uint64) for x in t.column("shingles").to_pylist()]
            copies = np.array(t.column("copies").to_pylist(), np.float64)
            cross = t.column("tx")[0].as_py() != t.column("ty")[0].as_py()
            linked = _verify(sets, np.array(t.column("chunk").to_pylist()), cross, threshold)
            links = (linked @ copies + linked.T @ copies).astype(np.int64)
            forest = Forest(len(cls))
            for i, row in enumerate(linked):
                forest.link(i, np.flatnonzero(row))
            hit = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays(
                [pa.array([cls[i] for i in hit] + [cls[x] for x in forest.a], pa.binary()),
                 pa.array([None] * len(hit) + [cls[y] for y in forest.b], pa.binary()),
                 pa.array(links[hit].tolist() + [0] * len(forest.a), pa.int64())], names=["a", "b", "links"])

    return written(tiles.mapInArrow(run, "a binary, b binary, links long"), "verified-links")


def near_duplicate_classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                           threshold: float = THRESHOLD, target_recall: float = TARGET_RECALL) -> DataFrame:
    """One row per row: id, class_id (least id of its class of linked texts), n_links and row_key.

    ``n_links`` counts the other rows whose shingle sets are at least
    ``threshold`` similar, copies included; ``row_key`` is the hash of id and
    text, which tells rows with one id apart.
    """
    rows = written(signatures(df, id_col, text_col), "signatures")
    classes = written(rows.filter("cls is not null").groupBy("cls").agg(
        F.min(F.struct(F.col("id").isNull().alias("unknown"), "id", "sig", "low")).alias("r"),
        F.count(F.lit(1)).alias("copies")).select("cls", F.col("r.id").alias("rep"), "r.sig", "r.low", "copies"), "classes")
    groups = candidate_groups(classes, threshold, target_recall)
    found = verified_links(df, classes, groups, id_col, text_col, threshold)
    links = found.filter("b is null").groupBy(F.col("a").alias("cls")).agg(F.sum("links").alias("links"))
    roots = components(found.filter("b is not null"))
    named = (classes.select("cls", "rep", "copies").join(roots.withColumnRenamed("node", "cls"), "cls", "left")
             .withColumn("root", F.coalesce("root", "cls")))
    least = named.groupBy("root").agg(F.min("rep").alias("class_id"))
    result = named.join(least, "root").join(links, "cls", "left").select(
        "cls", "class_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    linked = rows.select("id", "key", "cls").join(result, "cls").select("id", "key", "class_id", "n_links")
    alone = rows.filter("cls is null").select("id", "key", F.col("id").alias("class_id"), F.lit(0).alias("n_links"))
    return linked.unionByName(alone).select(F.col("id").alias(id_col), "class_id", F.col("n_links").cast("long").alias("n_links"),
                                            F.col("key").alias("row_key"))


def surplus(classes: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows that do not stand for their class: those without its least id.

    Rows with the same id and text count as one row.  A class whose ids are all
    null keeps its rows.
    """
    return classes.filter(~F.col(id_col).eqNullSafe(F.col("class_id")))
