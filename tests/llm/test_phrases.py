import random
import re
from collections import Counter

import numpy as np
import pytest

from demandspark.llm import phrases as ph

from edge import DOC_SCHEMA, edge_docs, edge_rows, empty_docs

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, min_count, top):
    out = []
    for lang in {r[2] if r[2] is not None else "und" for r in rows}:
        f, n = Counter(), 0
        for r in rows:
            if (r[2] if r[2] is not None else "und") != lang:
                continue
            for piece in re.split(r"[.,;:!?\x0a-\x0d]", (r[1] or "").translate(LOWER)):
                w = re.findall(r"[^\x20\x09]+", piece)
                n += len(w)
                for k in range(1, 5):
                    f.update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
        cands = {p: a for p, a in f.items() if len(p) > 1 and a >= min_count}
        found = []
        for p, a in cands.items():
            score, cut = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            if not any(len(q) > len(p) and 100 * b >= 80 * a and any(q[i:i + len(p)] == p for i in range(len(q)))
                       for q, b in cands.items()):
                found.append((score, a, " ".join(p), f[p[:cut]], f[p[cut:]]))
        found.sort(key=lambda x: (-x[0], -x[1], x[2].encode()))
        out += [(lang, k + 1, p, a, l, r, n, s) for k, (s, a, p, l, r) in enumerate(found[:top])]
    return sorted(out)


def corpus():
    r = random.Random(5)
    words = "the The of and to Été straße a-b c_d x y z 漢字 it's".split()
    rows = [(i, "".join(r.choice(words) + r.choice([" ", "  ", "\t", ". ", ",", "\n", " ", " "]) for _ in range(r.randint(0, 120))),
             r.choice(["en", "de", None, ""]), "s", 1) for i in range(80)]
    rows += [(200 + i, "alpha beta gamma delta; alpha beta", "en", "s", 1) for i in range(12)] + [(300, None, "en", "s", 1)]
    return rows + rows[:3]


COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


@pytest.mark.parametrize("block_bytes,bucket_keys", [(ph.BLOCK_BYTES, ph.BUCKET_KEYS), (300, 50)])
def test_against_brute_force(spark, block_bytes, bucket_keys):
    rows = corpus()
    df = spark.createDataFrame(rows, DOC_SCHEMA).repartition(3)
    out = ph.collocations(df, min_count=5, top=40, block_bytes=block_bytes, bucket_keys=bucket_keys)
    assert sorted(tuple(r) for r in out.select(COLUMNS).collect()) == brute(rows, 5, 40)


def test_edge_rows(spark):
    got = sorted(tuple(r) for r in ph.collocations(edge_docs(spark), min_count=3, block_bytes=1000).select(COLUMNS).collect())
    assert got == brute(edge_rows(), 3, ph.TOP)
    assert ph.collocations(empty_docs(spark)).count() == 0


@pytest.mark.parametrize("mask", [0, 3])
def test_colliding_hashes_fall_apart(monkeypatch, mask):
    """With hashes of no or two bits nearly everything collides, and the text still decides."""
    text = " ".join(t.lower() for _, t, *_ in corpus() if t).encode().translate(ph._CLEAN)
    monkeypatch.setattr(ph, "_mixed", lambda x: x & np.uint64(mask))
    got = {}
    for n, found, counts in ph.exact_runs(ph.Block("en", text), np.arange(4, dtype=np.uint64), 0):
        assert len(set(found)) == len(found)
        got.update(zip(found, counts))
    want = Counter()
    for piece in text.split(b"\n"):
        w = piece.split()
        for k in range(1, 5):
            want.update(b" ".join(w[i:i + k]) for i in range(len(w) - k + 1))
    assert got == want


def test_keys_survive_packing():
    keys = np.unique(np.random.default_rng(0).integers(0, 2**32, 1000, dtype=np.uint64)).astype(np.uint32)
    assert np.array_equal(ph._keys(ph._planes(keys)), keys)
    assert len(ph._keys(ph._planes(keys[:0]))) == 0


def test_word_hash_is_free_of_place():
    long = b"word " * 3 + b"other" + b"\n" + b"x" * 5000 + b" word"
    b = ph.Block("en", long)
    h = b.word_hashes()
    assert h[0] == h[1] == h[2] == h[5] and len(set(h.tolist())) == 3


def test_rows_grow_with_blocks_and_not_with_their_phrases(spark):
    """Phrases travel packed: a block gives one row a bucket, however many frequent phrases it holds."""
    r = random.Random(9)
    rows = [(i, " ".join(f"w{r.randrange(60)}" for _ in range(400)), r.choice(["en", "de"]), "s", 1) for i in range(40)]
    table = ph.blocks(spark.createDataFrame(rows, DOC_SCHEMA).repartition(2), block_bytes=4000).cache()
    bits = 2
    packed = ph._materialised(table, ph._frequent(ph._census(table, bits, 3), 3), bits)
    found = {(x.lang, x.phrase): x.f for x in ph._counted(packed, 3).collect()}
    want = {lang: Counter() for lang in ("en", "de")}
    for _, text, lang, *_ in rows:
        w = text.split()
        for k in range(1, 5):
            want[lang].update(" ".join(w[i:i + k]) for i in range(len(w) - k + 1))
    assert found == {(lang, p): f for lang in want for p, f in want[lang].items() if f >= 3}
    assert packed.count() <= 4 * table.select("block").distinct().count() < len(found)
