import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from demandspark.llm import packing
from demandspark.llm.common import by_bytes

from edge import edge_docs, edge_rows, empty_docs

PATH = public_tokenizers.path("word_bpe_49k.json")


def expected(rows, capacity):
    tok = Tokenizer.from_file(PATH)
    out = Counter()
    for doc, text, *_ in rows:
        ids = tok.encode(text or "", add_special_tokens=False).ids + [1]
        for k, at in enumerate(range(0, len(ids), capacity)):
            cut = ids[at:at + capacity]
            out[(doc, k, at, len(cut), zlib.crc32(np.array(cut, "<u4").tobytes()))] += 1
    return out


@pytest.mark.parametrize("capacity", [4096, 64])
def test_pieces_and_sequences(spark, capacity):
    rows = packing.pack_documents(edge_docs(spark), PATH, capacity=capacity).collect()
    assert Counter(tuple(r)[:5] for r in rows) == expected(edge_rows(), capacity)
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity


def test_empty_table(spark):
    assert packing.pack_documents(empty_docs(spark), PATH).count() == 0


def test_rounds_save_bins_and_lose_nothing(spark):
    rng = np.random.default_rng(5)
    sizes = rng.integers(30, 60, 4000)
    pieces = spark.createDataFrame([(i, 0, 0, int(s), 0) for i, s in enumerate(sizes)], packing.PIECES)
    once = packing.pack(pieces, 100, group_rows=50, max_rounds=0)
    more = packing.pack(pieces, 100, group_rows=50, max_rounds=4)
    bins = [df.select("sequence_id").distinct().count() for df in (once, more)]
    assert bins[1] <= bins[0] and bins[1] >= packing.lower_bound(sizes, 100)
    assert sorted(r[0] for r in more.select("doc_id").collect()) == list(range(4000))
    total = more.groupBy("sequence_id").sum("length").agg({"sum(length)": "max"}).first()[0]
    assert total <= 100


def test_rounds_go_on_while_they_save_bins(spark, monkeypatch):
    """Dealing that saves one bin a round, until it is down to six."""
    rounds = []

    def dealt(pool, groups, round_no, capacity):
        rounds.append(groups)
        bins = max(12 - round_no, 6)
        return pool.select("row", "doc_id", "piece", "start", "length", "ids_crc32",
                           (F.col("doc_id") % bins + F.lit(round_no << 48)).alias("sequence_id"), F.lit(0).cast("long").alias("offset"),
                           F.lit(1).cast("long").alias("free"), F.lit(9).cast("long").alias("bins"), F.lit(1).cast("long").alias("bound"))
    monkeypatch.setattr(packing, "_packed", dealt)
    pieces = spark.createDataFrame([(i, 0, 0, 1, 0) for i in range(24)], packing.PIECES)
    out = packing.pack(pieces, 100, group_rows=4)
    assert len(rounds) == 8 and set(rounds) == {6}     # the last one saves none
    assert out.count() == 24 and out.select("sequence_id").distinct().count() == 6
    assert packing.pack(pieces, 100, group_rows=24).select("sequence_id").distinct().count() == 12   # one partition


def exact_bins(sizes, capacity):
    """Least number of bins, by trying all placements."""
    best = len(sizes)

    def place(i, loads):
        nonlocal best
        if len(loads) >= best:
            return
        if i == len(sizes):
            best = len(loads)
            return
        for k in range(len(loads)):
            if loads[k] + sizes[i] <= capacity:
                loads[k] += sizes[i]
                place(i + 1, loads)
                loads[k] -= sizes[i]
        place(i + 1, loads + [sizes[i]])
    place(0, [])
    return best


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=8))
def test_bound_never_exceeds_the_optimum(sizes):
    sizes = sorted(sizes, reverse=True)
    best = exact_bins(sizes, 20)
    assert packing.lower_bound(np.array(sizes), 20) <= best
    bins, offsets, count = packing.best_fit_decreasing(np.array(sizes), 20)
    assert best <= count
    assert max(np.bincount(bins, weights=sizes)) <= 20


def test_a_quarter_of_a_million_words_is_learnt_once(monkeypatch):
    """Text of several megabytes is one block, and its words are still known when they come again."""
    encoder = packing.WordEncoder(packing.load_vocabulary(public_tokenizers.path("word_bpe_49k.json")))
    learnt = []
    each = packing.WordEncoder._learn
    monkeypatch.setattr(packing.WordEncoder, "_learn", lambda self, new: (learnt.append(len(new)), each(self, new)))
    letters = "bcdfghjklmnprstvwxyz"
    words = ["".join(letters[i // 20**k % 20] for k in range(5)) for i in range(0, 500_000, 2)]
    batch = pa.RecordBatch.from_arrays([pa.array([" ".join(words[i::50]) for i in range(50)] * 3)], names=["text"])
    parts = list(by_bytes(batch, 0, packing.BLOCK_BYTES))
    assert len(parts) == 1
    ids, ends = encoder.encode(parts[0].column(0))
    again, again_ends = encoder.encode(parts[0].column(0))
    assert learnt == [len(words)]
    assert np.array_equal(ids, again) and np.array_equal(ends, again_ends)
    assert ids[:ends[1]].tolist() == encoder.tokenizer.encode(batch.column(0)[0].as_py(), add_special_tokens=False).ids
