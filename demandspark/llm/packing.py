"""Best-fit packing with certified bin counts (operator 1).

``tokenised_pieces`` encodes every text and cuts only documents longer than
the capacity.  ``pack`` deals the pieces by hash into partitions of bounded
size, packs each by best-fit decreasing and certifies it: when a lower bound
from dual feasible functions equals the number of bins, no packing of that
partition is better.  Partitions with a gap put the documents of their bins
that have room into a common pool, which is dealt anew (into fewer partitions
as it shrinks) and packed again, until all are certified, one partition is left
or a round saves no bin; every other round saves one at least, so it ends.

Edge cases: a null text is the empty text (one end token); repeated rows are
packed as often as they occur (dealt by a row number written with the
pieces); a null id is kept; an empty table gives an empty result; other columns
of the input are ignored.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandspark.llm.common import by_bytes, written

CAPACITY = 4096
END_ID = 1
GROUP_ROWS = 20_000        # pieces packed by one task
BLOCK_BYTES = 6_000_000    # bytes of text encoded at once, about
CACHED_WORDS = 400_000     # words a worker remembers; the cache is emptied when it is full
MAX_VOCABULARY_BYTES = 64_000_000

TAILS = (".", ",")         # tokens of their own wherever they end a word
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def load_vocabulary(path: str) -> str:
    """The tokenizer file's text; its size is checked because tasks receive it as a broadcast."""
    if os.path.getsize(path) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path} is larger than {MAX_VOCABULARY_BYTES} bytes")
    with open(path, encoding="utf-8") as f:
        return f.read()


class WordEncoder:
    """Encodes texts word by word; known words and their ids are kept as Arrow arrays.

    Valid for tokenizers whose tokens never contain white space: a text may
    then be cut at blanks and line ends, and each part encoded alone.
    """

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_str(vocabulary)
        vocab = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocab.values()) + 1, bool)
        self.ends_word[[i for token, i in vocab.items() if token.endswith("</w>")]] = True
        self.forget()

    def forget(self) -> None:
        """Drop all learnt words and give their memory back."""
        # the words, their ids one after the other, and where each word's ids end
        self.words = pa.array(["", *TAILS], pa.string())
        ids = self._each(list(TAILS))
        self.ids = np.concatenate(ids)
        self.ends = np.cumsum([0, 0, *[len(x) for x in ids]])
        pa.default_memory_pool().release_unused()

    def _add(self, words: pa.Array, ids: np.ndarray, lengths: np.ndarray) -> None:
        self.words = pa.concat_arrays([self.words, words])
        self.ids = np.concatenate([self.ids, ids])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(lengths, dtype=np.int64)])

    def _gather(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of numbered words one after the other, and where each word's ids end (from 0)."""
        lists = pa.LargeListArray.from_arrays(pa.array(self.ends, pa.int64()), pa.array(self.ids, pa.uint32()))
        taken = lists.take(pa.array(numbers, pa.int64()))
        ends = taken.offsets.to_numpy()
        return taken.flatten().to_numpy(), ends - ends[0]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and where each text's ids end (from 0, one more than texts).

        Arrow splits the texts, numbers their distinct words and finds the known ones; ids are
        gathered back by number.
        """
        parts = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        words = parts.flatten().dictionary_encode()
        if len(self.words) > CACHED_WORDS:
            self.forget()
        known = pc.index_in(words.dictionary, value_set=self.words)
        if known.null_count:
            self._learn(words.dictionary.filter(known.is_null()))
            known = pc.index_in(words.dictionary, value_set=self.words)
        ids, ends = self._gather(known.to_numpy()[words.indices.to_numpy()])
        return ids.astype("<u4", copy=False), ends[parts.offsets.to_numpy() - parts.offsets[0].as_py()]

    def _learn(self, new: pa.Array) -> None:
        """Append words that are not known yet.

        A word of letters is encoded without the stop or comma that ends it, a token of its own,
        and in lower case if it is ASCII; these stems are known words as well.
        """
        tail = pc.fill_null(pc.index_in(pc.utf8_slice_codeunits(new, -1), value_set=pa.array(TAILS)), -1)
        stem = pc.if_else(pc.greater_equal(tail, 0), pc.utf8_slice_codeunits(new, 0, -1), new)
        stem = pc.if_else(pc.string_is_ascii(stem), pc.ascii_lower(stem), stem)
        plain = pc.utf8_is_alpha(stem)
        odd = new.filter(pc.invert(plain))
        each = self._each(odd.to_pylist())
        stems = stem.filter(plain).unique()
        stems = stems.filter(pc.is_null(pc.index_in(stems, value_set=self.words)))
        self._add(stems, *self._plain(stems.to_pylist()))
        if each:
            self._add(odd, np.concatenate(each), np.array([len(x) for x in each]))
        rest = pc.and_(plain, pc.not_equal(stem, new))
        pairs = np.empty((pc.sum(rest).as_py() or 0, 2), np.int64)
        pairs[:, 0] = pc.index_in(stem.filter(rest), value_set=self.words).to_numpy()
        pairs[:, 1] = tail.filter(rest).to_numpy() + 1     # word 0 is empty, the tails come next
        ids, ends = self._gather(pairs.ravel())
        self._add(new.filter(rest), ids, np.diff(ends[::2]))

    def _each(self, parts: list[str]) -> list[np.ndarray]:
        out = []
        for start in range(0, len(parts), 5_000):
            out += [np.array(enc.ids, "<u4") for enc in self.tokenizer.encode_batch_fast(
                parts[start:start + 5_000], add_special_tokens=False)]
        return out

    def _plain(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their numbers of words of letters, many at once.

        As each word has a token that ends it, as many ends as words part them exactly.
        """
        ids, lengths = [np.zeros(0, "<u4")], [np.zeros(0, np.int64)]
        lines = [parts[at:at + 256] for at in range(0, len(parts), 256)]
        for at in range(0, len(lines), 64):
            encoded = self.tokenizer.encode_batch_fast([" ".join(x) for x in lines[at:at + 64]], add_special_tokens=False)
            for words, enc in zip(lines[at:at + 64], encoded):
                line = np.array(enc.ids, "<u4")
                ends = np.flatnonzero(self.ends_word[line]) + 1
                if len(ends) != len(words):
                    each = self._each(words)
                    line, ends = np.concatenate(each), np.cumsum([len(x) for x in each])
                ids.append(line)
                lengths.append(np.diff(ends, prepend=0))
        return np.concatenate(ids), np.concatenate(lengths)


_encoders: dict[int, WordEncoder] = {}


def tokenised_pieces(df: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text",
                     capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 (and ids with ``with_ids``)."""
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(load_vocabulary(vocabulary_path))
    end = np.array([end_id], dtype="<u4").tobytes()
    schema = PIECES + (", ids array<long>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = zlib.crc32(shared.value[:100_000].encode()) ^ len(shared.value)
        encoder = _encoders.get(key) or _encoders.setdefault(key, WordEncoder(shared.value))
        for batch in batches:
            for part in by_bytes(batch, 1, BLOCK_BYTES):
                rows = []
                ids, ends = encoder.encode(part.column(1).fill_null(""))
                for doc, lo, hi in zip(part.column(0).to_pylist(), ends[:-1].tolist(), ends[1:].tolist()):
                    own = ids[lo:hi].tobytes() + end
                    for k, at in enumerate(range(0, hi - lo + 1, capacity)):
                        cut = own[4 * at:4 * (at + capacity)]
                        rows.append((doc, k, at, len(cut) // 4, zlib.crc32(cut)) +
                                    ((np.frombuffer(cut, "<u4").astype(np.int64),) if with_ids else ()))
                cols = list(zip(*rows))
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(cols, types)],
                                                 names=names[:len(cols)])
        # the worker goes on to other tasks and stages
        encoder.forget()

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")
                     ).mapInArrow(run, schema)


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of each size, and the number of bins.

    Open bins are stacked by free space; an integer with one bit per free
    space that has a bin finds the tightest one in constant time.
    """
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    filled = 0
    count = 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fits = filled >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = open_bins[room].pop()
            if not open_bins[room]:
                filled &= ~(1 << room)
        else:
            b, room = count, capacity
            count += 1
        bins[i], offsets[i] = b, capacity - room
        left = room - size
        if left:
            open_bins[left].append(b)
            filled |= 1 << left
    return bins, offsets, count


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """The best of two families of dual feasible functions (and of the total size).

    Each maps sizes so that whatever fits one bin sums to at most one bin;
    hence the rounded-up sum bounds every packing from below.
    """
    if not len(sizes):
        return 0
    hist = np.bincount(sizes, minlength=capacity + 1).astype(np.int64)
    x = np.arange(capacity + 1, dtype=np.int64)
    count, total = np.cumsum(hist), np.cumsum(hist * x)
    # threshold family: sizes over capacity - k count as a full bin, sizes under k as nothing
    k = np.arange(0, capacity // 2 + 1)
    big = count[capacity] - count[capacity - k]
    middle = total[capacity - k] - np.where(k > 0, total[np.maximum(k - 1, 0)], 0)
    best = int(np.max(-(-(big * capacity + middle) // capacity)))
    # rounding family: x(q + 1)/C rounded down to a multiple of 1/q unless it is whole
    for q in range(1, 31):
        scaled = x * (q + 1)
        whole = scaled % capacity == 0
        value = np.where(whole, x * q, (scaled // capacity) * capacity)   # in units of 1 / (q * capacity)
        best = max(best, int(-(-int((hist * value).sum()) // (q * capacity))))
    return best


_PACKED = ("row long, doc_id long, piece int, start long, length long, ids_crc32 long, "
           "sequence_id long, offset long, free long, bins long, bound long")


def _packed(pieces: DataFrame, groups: int, round_no: int, capacity: int) -> DataFrame:
    """Deal the pieces into ``groups`` partitions by hash and pack each."""

    pieces = pieces.select("row", "doc_id", "piece", "start", "length", "ids_crc32")
    columns = pieces.columns

    def run(key: tuple, t: pa.Table) -> pa.Table:
        t = t.select(columns).sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"),
                                       ("row", "ascending")])
        sizes = t.column("length").to_numpy()
        bins, offsets, count = best_fit_decreasing(sizes, capacity)
        free = capacity - np.bincount(bins, weights=sizes, minlength=count).astype(np.int64)
        added = {"sequence_id": (round_no << 48) + (key[0].as_py() << 24) + bins, "offset": offsets, "free": free[bins],
                 "bins": np.full(len(bins), count), "bound": np.full(len(bins), lower_bound(sizes, capacity))}
        for name, values in added.items():
            t = t.append_column(name, pa.array(values, pa.int64()))
        return t

    dealt = F.pmod(F.xxhash64("row", F.lit(round_no)), F.lit(groups))
    return pieces.groupBy(dealt.alias("grp")).applyInArrow(run, _PACKED)


def pack(pieces: DataFrame, capacity: int = CAPACITY, group_rows: int = GROUP_ROWS,
         max_rounds: int | None = None) -> DataFrame:
    """Pack pieces (lengths 1 to ``capacity``) into sequences of at most ``capacity``.

    Rounds end by the rule above, or after ``max_rounds`` if it is given.

    Returns the piece columns with sequence_id and offset (gapless from 0 in
    each sequence), and ``certified``: whether the piece's partition reached
    its lower bound.
    """
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    # numbers the rows once, in a written table: a recomputed task could number them otherwise
    pieces = written(pieces.withColumn("row", F.monotonically_increasing_id()), "pieces")
    n = pieces.count()
    groups = max(1, -(-n // group_rows))
    current = written(_packed(pieces, groups, 0, capacity), "packed-0")
    done: list[DataFrame] = []
    for round_no in count(1) if max_rounds is None else range(1, max_rounds + 1):
        gap = F.col("bins") > F.col("bound")
        pool = current.filter(gap & (F.col("free") > 0))
        stats = pool.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("sequence_id").alias("bins")).first()
        fewer = max(1, -(-stats["n"] // group_rows))
        if stats["bins"] < 2 or groups == 1:
            break
        again = written(_packed(pool, fewer, round_no, capacity), f"packed-{round_no}")
        if again.agg(F.count_distinct("sequence_id").alias("b")).first()["b"] >= stats["bins"]:
            break
        done.append(current.filter(~(gap & (F.col("free") > 0))))
        current, groups = again, fewer
    out = current
    for part in done:
        out = out.unionByName(part)
    return out.select(*columns, (F.col("bins") == F.col("bound")).alias("certified"))


def pack_documents(df: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text",
                   capacity: int = CAPACITY) -> DataFrame:
    """Tokenise and pack all documents of ``df``; the texts are read and encoded once."""
    return pack(tokenised_pieces(df, vocabulary_path, id_col, text_col, capacity), capacity)
