"""Byte-level BPE encoding and decoding by DuckDB recursive queries (operator 6).

Inside each task a text is cut by the pre-tokenisation pattern; words not met
before are encoded by one recursive query: the token-position rows of every
word join the merge table, each word contracts its leftmost pair of minimum
rank, and words without a mergeable pair leave the recursion.  Decoding joins
token-position rows with the vocabulary and concatenates the bytes by an
ordered aggregation.  Spark partitions the work; a DuckDB connection lives in a
Python worker, holds only the vocabulary and sees blocks of bounded size.

Words of more than ``LONG_WORD`` bytes are first cut where no token of the
vocabulary that occurs in the word spans the cut: no merge can cross such a
place, whatever the vocabulary, so the parts are words of their own.  A part
that is still longer (a run of one letter, say) contracts all occurrences of
its minimum-rank pair (from the left, not overlapping) in each round, which
gives the same tokens because a merge never creates a pair of lower rank than
its own under a trained vocabulary; its recursion is cut into queries of
``ROUND_ROWS`` rows, of which only the last state goes on.  So neither the
length of a word nor the number of its rounds is bounded by memory.

Edge cases: a null text is the empty text, which has no ids; a repeated row is
encoded like any other; ids outside the vocabulary raise an error when
decoded; other columns are ignored.
"""

from __future__ import annotations

import base64
import os
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LONG_WORD = 256            # bytes
CACHED_WORDS = 700_000     # words and blank-led chunks a worker remembers; emptied when full
BLOCK_CHARS = 2_000_000    # characters of text encoded at once
BLOCK_TOKENS = 500_000     # tokens decoded at once
ROUND_ROWS = 1_000_000     # token-position rows that the rounds of one query on a long part may keep
QUERY_WORDS = 20_000       # words of one recursive query
SLICE_ROWS = 512           # rows of an Arrow batch that become Python objects at once
MEMORY_LIMIT = "400MB"
MAX_VOCABULARY_BYTES = 64_000_000
_WHITE = "\t-\r \x85\xa0  -     　"  # Unicode White_Space
_CHUNK = re.compile(f"[{_WHITE}]*[^{_WHITE}]+|[{_WHITE}]+")

_ENCODE = """
WITH RECURSIVE state(word, tokens, step) AS (
  SELECT word, tokens, 0 FROM words
  UNION ALL
  SELECT s.word, list_concat(list_append(s.tokens[:b.at - 1], b.merged), s.tokens[b.at + 2:]), s.step + 1
  FROM (SELECT word, best >> 20 AS merged, best & 1048575 AS at
        FROM (SELECT pair.word, min(merge.rank * 1048576 + pair.at) AS best
              FROM (SELECT word, unnest(range(1, len(tokens))) AS at,
                           unnest(tokens[:-2]) * 16777216 + unnest(tokens[2:]) AS key FROM state) pair
              JOIN merge ON merge.key = pair.key GROUP BY pair.word)) b
  JOIN state s ON s.word = b.word)
SELECT word, arg_max(tokens, step) AS tokens FROM state GROUP BY word"""

_ENCODE_LONG = """
WITH RECURSIVE state(word, pos, token, step) AS (
  SELECT word, pos, token, 0 FROM letters
  UNION ALL
  SELECT word, pos, CASE WHEN hit THEN rank ELSE token END, step + 1 FROM (
    SELECT *, coalesce(lag(hit) OVER (PARTITION BY word ORDER BY pos), false) AS absorbed FROM (
      SELECT *, low AND (row_number() OVER (PARTITION BY word, run ORDER BY pos)) % 2 = 1 AS hit FROM (
        SELECT *, sum(CASE WHEN low THEN 0 ELSE 1 END) OVER (PARTITION BY word ORDER BY pos) * 2
                  + CASE WHEN low THEN 1 ELSE 0 END AS run FROM (
          SELECT *, rank IS NOT NULL AND rank = min(rank) OVER (PARTITION BY word) AS low,
                 min(rank) OVER (PARTITION BY word) AS least FROM (
            SELECT p.word, p.pos, p.token, p.step, merge.rank
            FROM (SELECT *, lead(token) OVER (PARTITION BY word ORDER BY pos) AS next FROM state) p
            LEFT JOIN merge ON merge.key = p.token * 16777216 + p.next
            WHERE p.step < {rounds}))
        WHERE least IS NOT NULL)))
  WHERE NOT absorbed)
SELECT pos, token, step FROM state WHERE step = (SELECT max(step) FROM state) ORDER BY pos"""

_DECODE = """
SELECT text, unhex(string_agg(bytes, '' ORDER BY pos)) AS decoded
FROM tokens JOIN vocabulary ON vocabulary.id = tokens.id GROUP BY text"""


class ByteBpe:
    """A vocabulary in a private in-memory DuckDB, with caches of encoded words."""

    def __init__(self, rank_file: bytes, pattern: str):
        import duckdb
        import regex
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, rank_file.splitlines())}
        self.pattern = regex.compile(pattern)
        self.byte_ids = np.array([self.ranks[bytes([i])] for i in range(256)], np.int64)
        # every way to cut a token into two tokens is a pair that merges into it
        pairs = [(self.ranks[t[:i]], self.ranks[t[i:]], r) for t, r in self.ranks.items()
                 for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks]
        left, right, rank = (np.array(c, np.int64) for c in zip(*pairs))
        # temp_directory '' keeps DuckDB from spilling to a local folder; blocks are bounded instead
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": MEMORY_LIMIT, "temp_directory": ""})
        self._fill("merge", {"key": left * 16777216 + right, "rank": rank})
        self._fill("vocabulary", {"id": list(self.ranks.values()), "bytes": [t.hex() for t in self.ranks]})
        self.known_ids = np.zeros(max(self.ranks.values()) + 1, bool)
        self.known_ids[list(self.ranks.values())] = True
        self.words: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}
        self.ordered: list[bytes] = []
        self.longest = max(map(len, self.ranks))

    def _fill(self, name: str, columns: dict) -> None:
        self.db.register("filling", pa.table(columns))
        self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM filling")
        self.db.unregister("filling")

    def _query(self, sql: str, **tables: pa.Table) -> pa.Table:
        for name, table in tables.items():
            self.db.register(name, table)
        try:
            return self.db.sql(sql).to_arrow_table()
        finally:
            for name in tables:
                self.db.unregister(name)

    def encode_words(self, words: list[str]) -> None:
        """Put the ids of ``words`` (little-endian unsigned 32-bit) into the cache."""
        short, long = [], []
        for w in words:
            b = w.encode("utf-8")
            r = self.ranks.get(b)
            if r is not None:
                self.words[w] = np.array([r], "<u4").tobytes()
            else:
                (short if len(b) <= LONG_WORD else long).append((w, b))
        for at in range(0, len(short), QUERY_WORDS):
            part = short[at:at + QUERY_WORDS]
            self.words.update(zip([w for w, _ in part], self._encode_short([b for _, b in part])))
        for w, b in long:
            parts = self._parts(b)
            ids = {p: np.array([self.ranks[p]], "<u4").tobytes() for p in set(parts) if p in self.ranks}
            rest = sorted(set(parts) - set(ids))
            ids.update((p, self._encode_long(p)) for p in rest if len(p) > LONG_WORD)
            rest = [p for p in rest if len(p) <= LONG_WORD]
            for at in range(0, len(rest), QUERY_WORDS):
                ids.update(zip(rest[at:at + QUERY_WORDS], self._encode_short(rest[at:at + QUERY_WORDS])))
            self.words[w] = b"".join([ids[p] for p in parts])

    def _encode_short(self, part: list[bytes]) -> list[bytes]:
        """The ids of each part by one recursive query."""
        letters, offsets = self._letters(part)
        tokens = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(letters))
        result = self._query(_ENCODE, words=pa.table({"word": np.arange(len(part), dtype=np.int32), "tokens": tokens}))
        found = result.column("tokens").combine_chunks()
        flat, ends = found.values.to_numpy().astype("<u4"), found.offsets.to_numpy().tolist()
        out = [b""] * len(part)
        for k, w in enumerate(result.column("word").to_pylist()):
            out[w] = flat[ends[k]:ends[k + 1]].tobytes()
        return out

    def _parts(self, word: bytes) -> list[bytes]:
        """The word cut at every place that no token occurring in it spans."""
        if not self.ordered:
            self.ordered = sorted(self.ranks)
        ordered, seen = self.ordered, {}
        reach, start, out = 1, 0, []
        for i in range(len(word)):
            if i and i >= reach:
                out.append(word[start:i])
                start = i
            window = word[i:i + self.longest]
            n = seen.get(window)
            if n is None:
                # the longest token from here: prefixes grow while some token starts with them
                n = 1
                for k in range(2, len(window) + 1):
                    at = bisect_left(ordered, window[:k])
                    if at == len(ordered) or not ordered[at].startswith(window[:k]):
                        break
                    if len(ordered[at]) == k:
                        n = k
                if len(seen) < 1000:
                    seen[window] = n
            reach = max(reach, i + n)
        return [*out, word[start:]]

    def _encode_long(self, word: bytes) -> bytes:
        letters, _ = self._letters([word])
        while True:
            rounds = max(1, ROUND_ROWS // len(letters))
            found = self._query(_ENCODE_LONG.format(rounds=rounds), letters=pa.table(
                {"word": np.zeros(len(letters), np.int32), "pos": np.arange(len(letters)), "token": letters}))
            letters = found.column("token").to_numpy().astype(np.int64)
            if found.column("step")[0].as_py() < rounds:
                return letters.astype("<u4").tobytes()

    def _letters(self, part: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        offsets = np.concatenate([[0], np.cumsum([len(b) for b in part])])
        return self.byte_ids[np.frombuffer(b"".join(part), np.uint8)], offsets

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        if len(self.words) + len(self.chunks) > CACHED_WORDS:
            self.words, self.chunks = {}, {}
        # no match of the pattern crosses from a non-blank to a blank, so chunks can be cut there
        cut = [_CHUNK.findall(t) for t in texts]
        # (a set minus a dict's keys would walk the whole dict)
        new = [c for c in set().union(*cut) if c not in self.chunks]
        split = [self.pattern.findall(c) for c in new]
        self.encode_words(sorted(w for w in set().union(*split) if w not in self.words))
        words, chunks = self.words, self.chunks
        for c, parts in zip(new, split):
            chunks[c] = b"".join([words[w] for w in parts])
        return [b"".join([chunks[c] for c in cs]) for cs in cut]

    def decode(self, ids: list[bytes]) -> list[bytes]:
        """The bytes of each id sequence."""
        lengths = np.array([len(x) // 4 for x in ids])
        flat = np.frombuffer(b"".join(ids), "<u4").astype(np.int64)
        if len(flat) and (flat.max() >= len(self.known_ids) or not self.known_ids[flat].all()):
            raise ValueError("ids outside the vocabulary")
        out = [b""] * len(ids)
        found = self._query(_DECODE, tokens=pa.table({"text": np.repeat(np.arange(len(ids)), lengths),
                                                      "pos": np.arange(len(flat)), "id": flat}))
        for k, b in zip(found.column("text").to_pylist(), found.column("decoded").to_pylist()):
            out[k] = b
        return out


_models: dict[tuple, ByteBpe] = {}


def _model(rank_file: bytes, pattern: str) -> ByteBpe:
    key = (hash(rank_file), pattern)
    if key not in _models:
        _models[key] = ByteBpe(rank_file, pattern)
    return _models[key]


def load_ranks(path: str) -> bytes:
    """The rank file's bytes; its size is checked because tasks receive it as a broadcast."""
    if os.path.getsize(path) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path} is larger than {MAX_VOCABULARY_BYTES} bytes")
    with open(path, "rb") as f:
        return f.read()


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(lo, SLICE_ROWS)


def _blocks(values: list, sizes: list[int], limit: int) -> Iterator[slice]:
    """Slices of consecutive values whose sizes sum to about ``limit`` at most (one value at least)."""
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield slice(start, i)
            start, total = i, 0
        total += n
    if values:
        yield slice(start, len(values))


def encode(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids): the ids of every whole text as little-endian unsigned 32-bit integers."""
    shared = df.sparkSession.sparkContext.broadcast(load_ranks(ranks_path))
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(shared.value, pattern)
        for batch in _slices(batches):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for part in _blocks(texts, [len(t) for t in texts], BLOCK_CHARS):
                ids = pa.array(model.encode(texts[part]), pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0)[part], ids], names=["id", "ids"])

    return (df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
            .mapInArrow(run, f"id {id_type}, ids binary").withColumnRenamed("id", id_col))


def decode(df: DataFrame, ranks_path: str, pattern: str, ids_col: str = "ids",
           decoded_col: str = "decoded") -> DataFrame:
    """``df`` with the ids replaced by the bytes that they stand for."""
    shared = df.sparkSession.sparkContext.broadcast(load_ranks(ranks_path))
    others = [c for c in df.columns if c not in (ids_col, decoded_col)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(shared.value, pattern)
        for batch in _slices(batches):
            ids = [x or b"" for x in batch.column(batch.num_columns - 1).to_pylist()]
            for part in _blocks(ids, [len(x) // 4 for x in ids], BLOCK_TOKENS):
                decoded = pa.array(model.decode(ids[part]), pa.binary())
                yield pa.RecordBatch.from_arrays([*[c[part] for c in batch.columns[:-1]], decoded],
                                                 names=[*others, decoded_col])

    rows = df.select(*others, ids_col)
    return rows.mapInArrow(run, df.select(*others).schema.add(decoded_col, "binary"))


def round_trip(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id",
               text_col: str = "text") -> DataFrame:
    """Encode every whole text and decode its ids: id, n_tokens and the SHA-256 of ids and of decoded bytes."""
    ids = encode(df, ranks_path, pattern, id_col, text_col)
    ids = ids.select(id_col, (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
                     F.sha2("ids", 256).alias("ids_sha256"), "ids")
    return decode(ids, ranks_path, pattern).select(id_col, "n_tokens", "ids_sha256",
                                                   F.sha2("decoded", 256).alias("decoded_sha256"))
