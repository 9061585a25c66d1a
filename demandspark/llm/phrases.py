"""Phrase collocation mining by Rabin-Karp fingerprints (operator 12).

1. Normalised texts are written with the number of a *block*: texts of one
   language and of bounded size together.
2. Census: in each block, prefix sums of a polynomial over the bytes give every
   word's hash, and prefix sums over the word hashes give the fingerprint of
   every run of 1 to 4 words, all in numpy.  The block's distinct fingerprints
   and their counts are dealt by their leading bits into buckets, as packed
   arrays that point to their block.  A bucket adds the counts up and sends the
   fingerprints that may be frequent back to the blocks that they occur in.
3. Only those runs are materialised: each block is read again with its own
   frequent fingerprints, occurrences are compared with the text (so that
   colliding fingerprints fall apart), and buckets of packed phrases add the
   blocks' counts up by text, exactly.
4. Cuts, scores and the removal of phrases inside longer ones are joins and
   grouped aggregates over the frequent phrases.

The census keeps 32 bits of a fingerprint beside its bucket and counts up to
the threshold, so it may let too many fingerprints through, never too few.

A-Z are lower-cased; texts split at ``[.,;:!?\\x0A-\\x0D]`` into pieces, and
those at blanks and tabs into words.

Edge cases: a null text has no words; a null language is ``und``; a text of any
length is counted whole (it may span blocks, which are cut between pieces, and
one longer piece is a block of its own); repeated rows count as often as they
occur; ties rank by counts, then by the phrase's UTF-8 bytes; languages without
candidates, and an empty table, give no rows; ids and other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from demandspark.llm.common import written

LONGEST = 4
MIN_COUNT = 30
TOP = 2000
INSIDE_SHARE = 80          # percent of its occurrences that a phrase has inside a longer one when it is dropped
SCALE = 2_000_000
UNKNOWN = "und"
BLOCK_BYTES = 4_000_000
HELD_BLOCKS = 4            # blocks' worth of texts a task holds until a block is whole
BUCKET_KEYS = 3_000_000    # fingerprints of a bucket, about
KEY_BITS = 32              # of a fingerprint that the census keeps beside the bucket's

_SPLITS = b".,;:!?\n\x0b\x0c\r"
_CLEAN = bytes.maketrans(_SPLITS + b"\t" + bytes(range(65, 91)), b"\n" * len(_SPLITS) + b" " + bytes(range(97, 123)))
# Rabin-Karp bases: odd, so that powers can be undone modulo 2^64
_BYTE_BASE, _WORD_BASE = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
_BYTES = np.random.default_rng(20250212).integers(1, 2**63, size=256, dtype=np.uint64)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _base_powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^0..n and its inverses, modulo 2^64; kept for the worker, at most for the longest block met."""
    if base not in _powers or len(_powers[base][0]) <= n:
        size = max(n, BLOCK_BYTES // 4) + 1
        _powers[base] = tuple(np.concatenate([[np.uint64(1)], np.full(size, b % 2**64, np.uint64)]).cumprod(dtype=np.uint64)
                              for b in (base, pow(base, -1, 2**64)))
    powers, inverses = _powers[base]
    return powers[:n], inverses[:n + 1]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def _prefixes(values: np.ndarray, powers: np.ndarray) -> np.ndarray:
    """Sums of values[i] * base^i over every prefix, modulo 2^64."""
    out = np.empty(len(values) + 1, np.uint64)
    out[0] = 0
    np.cumsum(values * powers, out=out[1:])
    return out


class Block:
    """The words of a block: byte spans, hashes and pieces."""

    def __init__(self, lang: str, body: bytes):
        self.seed = np.uint64(xxhash.xxh3_64_intdigest(lang))
        self.body = np.frombuffer(body, np.uint8)
        end = self.body == 10
        blank = end | (self.body == 32)
        edge = np.flatnonzero(np.diff(np.concatenate([[True], blank, [True]]).astype(np.int8)))
        self.start, self.stop = edge[::2], edge[1::2]
        self.piece = np.concatenate([[0], np.cumsum(end)])[self.start] if len(edge) else self.start

    def word_hashes(self) -> np.ndarray:
        """Rabin-Karp hashes of the words, from prefix sums over slices of the bytes."""
        out = np.empty(len(self.start), np.uint64)
        step = max(BLOCK_BYTES // 4, int((self.stop - self.start).max(initial=1)))
        lo = 0
        while lo < len(out):
            at = int(self.start[lo])
            hi = int(np.searchsorted(self.stop, at + step, side="right"))
            body = self.body[at:int(self.stop[hi - 1])]
            powers, inverses = _base_powers(_BYTE_BASE, len(body))
            sums = _prefixes(_BYTES[body], powers)
            a, b = self.start[lo:hi] - at, self.stop[lo:hi] - at
            out[lo:hi] = _mixed((sums[b] - sums[a]) * inverses[a] + (b - a).astype(np.uint64))
            lo = hi
        return out

    def fingerprints(self, words: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(length, first words, fingerprints) of the runs of 1 to ``LONGEST`` words inside pieces."""
        powers, inverses = _base_powers(_WORD_BASE, len(words))
        sums = _prefixes(words, powers)
        for n in range(1, LONGEST + 1):
            at = np.arange(max(len(words) - n + 1, 0))
            at = at[self.piece[at] == self.piece[at + n - 1]]
            yield n, at, _mixed(((sums[at + n] - sums[at]) * inverses[at] ^ self.seed) + np.uint64(n))

    def codes(self, words: np.ndarray) -> np.ndarray:
        """A number per word, equal exactly for words of equal text (hashes are compared with the text)."""
        _, first, code = np.unique(words, return_index=True, return_inverse=True)
        size = self.stop - self.start
        like = first[code]
        same = size == size[like]
        for lo in range(0, len(words), 200_000):
            part = np.flatnonzero(same[lo:lo + 200_000]) + lo
            length = size[part]
            offset = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
            equal = (self.body[np.repeat(self.start[part], length) + offset]
                     == self.body[np.repeat(self.start[like[part]], length) + offset])
            same[part] = np.logical_and.reduceat(equal, np.cumsum(length) - length) if len(part) else True
        if not same.all():
            text = [self.body[a:b].tobytes() for a, b in zip(self.start, self.stop)]
            number = {w: i for i, w in enumerate(dict.fromkeys(text))}
            code = np.array([number[w] for w in text])
        return code

    def phrase(self, at: int, n: int) -> bytes:
        return b" ".join([self.body[self.start[i]:self.stop[i]].tobytes() for i in range(at, at + n)])


def blocks(df: DataFrame, text_col: str = "text", lang_col: str = "lang", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(block, lang, body, n_words): normalised texts, pieces ended by line feeds, dealt to blocks of about ``block_bytes``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        current: dict[str, list[int]] = {}     # the open block of each language, and its bytes
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                rows = []
                for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    text = text.translate(_CLEAN)
                    at = 0
                    while at < len(text):
                        # a long text is cut at the end of a piece
                        end = len(text)
                        if end - at > block_bytes:
                            cut = text.rfind(b"\n", at, at + block_bytes)
                            cut = text.find(b"\n", at) if cut < 0 else cut
                            end = cut + 1 if cut >= 0 else end
                        if lang not in current or current[lang][1] >= block_bytes:
                            number += 1
                            current[lang] = [number, 0]
                        current[lang][1] += end - at
                        body = text[at:end]
                        rows.append((current[lang][0], lang, body, len(body.split())))
                        at = end
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
                        zip(*rows), (pa.int64(), pa.string(), pa.binary(), pa.int64()))], names=["block", "lang", "body", "n_words"])

    return df.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN)).alias("lang"),
                     F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text")
                     ).mapInArrow(run, "block long, lang string, body binary, n_words long")


def _planes(keys: np.ndarray) -> bytes:
    """Sorted 32-bit keys as differences, byte plane by byte plane, which the shuffle compresses well."""
    return np.diff(keys, prepend=np.uint32(0)).view(np.uint8).reshape(-1, 4).T.tobytes()


def _keys(planes: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, -1).T).view("<u4").ravel().cumsum(dtype=np.uint32)


def _census(table: DataFrame, bits: int, min_count: int) -> DataFrame:
    """(bucket, block, keys, counts): the distinct fingerprints of every block by bucket (a block may have several rows)."""
    shift = np.uint64(64 - KEY_BITS - bits)

    def counted(number: int, lang: str, bodies: list[bytes]) -> pa.RecordBatch:
        b = Block(lang, b"\n".join(bodies))
        found = [fp >> shift for _, _, fp in b.fingerprints(b.word_hashes())]
        keys, counts = np.unique(np.concatenate(found), return_counts=True)
        counts = np.minimum(counts, min_count).astype(np.uint8)
        bucket = (keys >> np.uint64(KEY_BITS)).astype(np.int64)
        low = keys.astype(np.uint32)
        cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
        ends = [*cuts[1:].tolist(), len(keys)]
        return pa.RecordBatch.from_arrays(
            [pa.array(bucket[cuts]), pa.array(np.full(len(cuts), number)),
             pa.array([_planes(low[i:j]) for i, j in zip(cuts.tolist(), ends)], pa.binary()),
             pa.array([counts[i:j].tobytes() for i, j in zip(cuts.tolist(), ends)], pa.binary())],
            names=["bucket", "block", "keys", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # texts of a block that came so far; languages may alternate
        held: dict[tuple[int, str], list[bytes]] = {}
        sizes: dict[tuple[int, str], int] = {}
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                for number, lang, body in zip(*[c.to_pylist() for c in batch.slice(lo, 256).columns]):
                    key = number, lang
                    held.setdefault(key, []).append(body)
                    sizes[key] = sizes.get(key, 0) + len(body)
                while sum(sizes.values()) > HELD_BLOCKS * BLOCK_BYTES:
                    key = max(sizes, key=sizes.get)
                    sizes.pop(key)
                    yield counted(*key, held.pop(key))
        for key, bodies in held.items():
            yield counted(*key, bodies)

    return table.select("block", "lang", "body").mapInArrow(run, "bucket long, block long, keys binary, counts binary")


def _frequent(census: DataFrame, min_count: int) -> DataFrame:
    """(block, bucket, keys): of every block, the fingerprints that all blocks together hold often enough."""
    def run(t: pa.Table) -> pa.Table:
        own = [_keys(k) for k in t.column("keys").to_pylist()]
        # the count in the low byte: one sort brings equal keys together
        all_ = np.concatenate([(k.astype(np.uint64) << np.uint64(8)) | np.frombuffer(c, np.uint8)
                               for k, c in zip(own, t.column("counts").to_pylist())])
        all_.sort()
        key = (all_ >> np.uint64(8)).astype(np.uint32)
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        frequent = key[first[np.add.reduceat((all_ & np.uint64(255)).astype(np.int64), first) >= min_count]]
        back = [k[_among(k, frequent)] for k in own]
        hit = [i for i, k in enumerate(back) if len(k)]
        return pa.table([t.column("block").take(pa.array(hit, pa.int64())), t.column("bucket").take(pa.array(hit, pa.int64())),
                         pa.array([_planes(back[i]) for i in hit], pa.binary())], names=["block", "bucket", "keys"])

    return census.groupBy("bucket").applyInArrow(run, "block long, bucket long, keys binary")


def _among(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Which values are in the sorted array."""
    if not len(ordered):
        return np.zeros(len(values), bool)
    at = np.searchsorted(ordered, values)
    at[at == len(ordered)] = 0
    return ordered[at] == values


def exact_runs(block: Block, wanted: np.ndarray, shift: int) -> Iterator[tuple[int, list[bytes], list[int]]]:
    """(length, phrases, counts) of the block's runs whose shifted fingerprint is among the sorted ``wanted``.

    Runs count as one phrase only if their words have equal text.
    """
    words = block.word_hashes()
    code = block.codes(words)
    for n, at, fp in block.fingerprints(words):
        hit = _among(fp >> np.uint64(shift), wanted)
        at, fp = at[hit], fp[hit]
        _, first, which, count = np.unique(fp, return_index=True, return_inverse=True, return_counts=True)
        like = at[first][which]
        if not all(np.array_equal(code[at + k], code[like + k]) for k in range(n)):
            # fingerprints collide: runs are told apart by their words
            _, first, count = np.unique(np.stack([code[at + k] for k in range(n)]), axis=1,
                                        return_index=True, return_counts=True)
        yield n, [block.phrase(i, n) for i in at[first].tolist()], count.tolist()


def _materialised(table: DataFrame, frequent: DataFrame, bits: int) -> DataFrame:
    """(bucket, lang, phrases, counts): by block and bucket of phrases, the runs of frequent fingerprints as text and their exact counts.

    The phrases of a row are packed, one a line, so that rows grow with blocks and buckets and not with the phrases of every block.
    """
    shift = 64 - KEY_BITS - bits
    names = ["bucket", "lang", "phrases", "counts"]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        lang = left.column("lang")[0].as_py() if left.num_rows else ""
        phrases, counts = [], []
        if left.num_rows and right.num_rows:
            wanted = np.unique(np.concatenate([(np.uint64(b) << np.uint64(KEY_BITS)) | _keys(k).astype(np.uint64) for b, k in zip(
                right.column("bucket").to_pylist(), right.column("keys").to_pylist())]))
            for _, found, count in exact_runs(Block(lang, b"\n".join(left.column("body").to_pylist())), wanted, shift):
                phrases += found
                counts += count
        bucket = np.fromiter(map(zlib.crc32, phrases), np.int64, len(phrases)) & ((1 << bits) - 1)
        order = np.argsort(bucket, kind="stable")
        cuts = np.flatnonzero(np.diff(bucket[order], prepend=-1)).tolist()
        parts = [order[i:j] for i, j in zip(cuts, [*cuts[1:], len(order)])]
        number = np.array(counts, "<i8")
        return pa.table([pa.array(bucket[[p[0] for p in parts]] if parts else [], pa.int64()), pa.array([lang] * len(parts), pa.string()),
                         pa.array([b"\n".join([phrases[i] for i in p.tolist()]) for p in parts], pa.binary()),
                         pa.array([number[p].tobytes() for p in parts], pa.binary())], names=names)

    return (table.select("block", "lang", "body").groupBy("block")
            .cogroup(frequent.groupBy("block")).applyInArrow(run, "bucket long, lang string, phrases binary, counts binary"))


def _counted(found: DataFrame, min_count: int) -> DataFrame:
    """(lang, n, phrase, f) of the phrases that all blocks together hold ``min_count`` times; equal ones have one bucket."""
    def run(t: pa.Table) -> pa.Table:
        each = [p.split(b"\n") for p in t.column("phrases").to_pylist()]
        sums = pa.table([pa.array(np.repeat(np.arange(t.num_rows), [len(p) for p in each])),
                         pa.array([x for p in each for x in p], pa.string()),
                         pa.array(np.frombuffer(b"".join(t.column("counts").to_pylist()), "<i8"))], names=["row", "phrase", "f"])
        lang = t.column("lang").combine_chunks().dictionary_encode()
        sums = sums.set_column(0, "lang", lang.indices.take(sums.column("row").combine_chunks()))
        sums = sums.group_by(["lang", "phrase"]).aggregate([("f", "sum")])
        sums = sums.filter(pc.greater_equal(sums.column("f_sum"), min_count))
        words = pc.add(pc.count_substring(sums.column("phrase"), " "), 1)
        return pa.table([lang.dictionary.take(sums.column("lang").combine_chunks()), words.cast(pa.int32()), sums.column("phrase"),
                         sums.column("f_sum")], names=["lang", "n", "phrase", "f"])

    return found.groupBy("bucket").applyInArrow(run, "lang string, n int, phrase string, f long")


def frequent_phrases(table: DataFrame, min_count: int = MIN_COUNT, bucket_keys: int = BUCKET_KEYS) -> DataFrame:
    """(lang, n, phrase, f) of every run of 1 to ``LONGEST`` words that occurs ``min_count`` times or more (255 at most)."""
    words = table.agg(F.sum("n_words")).first()[0] or 0
    bits = max(0, int(np.ceil(np.log2(max(1.0, LONGEST * words / bucket_keys)))))
    census = _census(table, bits, min_count)
    frequent = _frequent(census, min_count)
    return _counted(_materialised(table, frequent, bits), min_count)


def scored(frequent: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, score) of the runs of two words or more, by their lowest-scoring cut."""
    counts = frequent.select("lang", "phrase", "f")
    cut = F.transform(F.sequence(F.lit(1), F.col("n") - 1), lambda k: F.struct(
        k.alias("cut"), F.array_join(F.slice("w", F.lit(1), k), " ").alias("first"),
        F.array_join(F.slice("w", k + 1, F.col("n") - k), " ").alias("rest")))
    cuts = (frequent.filter("n >= 2").withColumn("w", F.split("phrase", " ", -1))
            .select("lang", "phrase", F.col("f").alias("a"), F.inline(cut)))
    left = counts.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l"))
    right = counts.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    priced = cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"]).withColumn(
        "score", F.expr(f"({SCALE}bd * cast(a as decimal(20, 0))) div (cast(l as decimal(20, 0)) + r)"))
    best = priced.groupBy("lang", "phrase").agg(F.min(F.struct("score", "cut", "a", "l", "r")).alias("b"))
    return best.select("lang", "phrase", "b.a", "b.l", "b.r", "b.score")


def inside_longer(frequent: DataFrame) -> DataFrame:
    """(lang, phrase, longer): the largest count of a longer run that holds the phrase."""
    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.col("n") - 1), lambda m: F.transform(
        F.sequence(F.lit(1), F.col("n") - m + 1), lambda p: F.array_join(F.slice("w", p, m), " "))))
    return (frequent.filter("n >= 3").withColumn("w", F.split("phrase", " ", -1))
            .select("lang", F.explode(F.array_distinct(spans)).alias("phrase"), "f")
            .groupBy("lang", "phrase").agg(F.max("f").alias("longer")))


def collocations(df: DataFrame, text_col: str = "text", lang_col: str = "lang", min_count: int = MIN_COUNT,
                 top: int = TOP, block_bytes: int = BLOCK_BYTES, bucket_keys: int = BUCKET_KEYS) -> DataFrame:
    """The first ``top`` phrases of every language: lang, rank, phrase, a, l, r, n and score."""
    table = written(blocks(df, text_col, lang_col, block_bytes), "phrase-blocks")
    frequent = written(frequent_phrases(table, min_count, bucket_keys), "frequent-phrases")
    kept = scored(frequent).join(inside_longer(frequent), ["lang", "phrase"], "left").filter(
        F.col("longer").isNull() | (100 * F.col("longer") < INSIDE_SHARE * F.col("a")))
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)
    sizes = table.groupBy("lang").agg(F.sum("n_words").alias("n"))
    return ranked.join(sizes, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", *[F.col(c).cast("long").alias(c) for c in ("a", "l", "r", "n", "score")])
