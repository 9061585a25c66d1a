import re
from collections import Counter

import numpy as np
import pytest

from demandspark.llm import divergence as dv

from edge import DOC_SCHEMA, edge_docs, edge_rows, empty_docs, prose

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, min_docs):
    """(lang, source, part, item, value, rank) by the definition, over all terms of every pair."""
    docs = [(r[2] or "", r[3] or "", TERM.findall((r[1] or "").translate(LOWER))) for r in rows]
    out = []
    for lang in {d[0] for d in docs}:
        freq, total, groups = Counter(), Counter(), {}
        for _, source, words in (d for d in docs if d[0] == lang):
            freq.update(set(words))
            groups.setdefault(source, Counter()).update(words)
        voc = [t for t, n in freq.items() if n >= min_docs]
        for c in groups.values():
            total.update({t: c[t] for t in voc})

        def price(c):
            n = sum(c[t] for t in voc)
            return {t: 1 + 10**9 * (c[t] + 2) // (n + 2 * len(voc)) for t in voc}

        def gap(p, q):
            return (p - q) ** 2 // (p + q)

        prices, whole = {s: price(c) for s, c in groups.items()}, price(total)
        for s, p in prices.items():
            pairs = [(h, sum(gap(p[t], q[t]) for t in voc)) for h, q in prices.items() if h != s]
            terms = [(t, gap(p[t], whole[t])) for t in voc if groups[s][t] and p[t] > whole[t]]
            for part, items, top in (("pair", pairs, None), ("term", terms, 10)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (item, value) in enumerate(items[:top])]
    return sorted(out)


def rows_of_sources():
    rows = []
    for i in range(60):
        text = prose(i, 20 + i) + (" Straße ÉTÉ été ab1cd AbC-abc" if i % 3 == 0 else "")
        rows.append((i, text, ["en", "de", None][i % 3], f"s{i % 7}" if i % 5 else None, 1))
    rows += [(100, "lonely words", "fr", "only", 1), (101, None, "en", "blank", 1), (102, "Zz zz", "xx", "a", 1), (103, "zZ", "xx", "b", 1)]
    return rows + rows[:4]


@pytest.mark.parametrize("blocks", [(dv.BLOCK_TERMS, dv.CHUNK_SOURCES), (5, 2)])
def test_against_brute_force(spark, blocks):
    rows = rows_of_sources()
    df = spark.createDataFrame(rows, DOC_SCHEMA).repartition(4)
    out = dv.audit(df, min_docs=3, block_terms=blocks[0], chunk_sources=blocks[1])
    got = sorted(tuple(r) for r in out.select("lang", "source", "part", "item", "value", "rank").collect())
    assert got == brute(rows, 3)


def test_edge_rows(spark):
    rows = edge_rows()
    got = sorted(tuple(r) for r in dv.audit(edge_docs(spark), min_docs=2).collect())
    assert got == brute([(r[0], r[1], "" if r[2] is None else r[2], "" if r[3] is None else r[3]) for r in rows], 2)
    assert dv.audit(empty_docs(spark)).count() == 0


def test_gallop():
    rng = np.random.default_rng(1)
    for n, m in ((0, 5), (5, 0), (1, 4000), (700, 3000), (3000, 3000), (2, 2)):
        a = np.unique(rng.integers(0, 6000, n)) if n else np.zeros(0, np.int64)
        b = np.unique(rng.integers(0, 6000, m)) if m else np.zeros(0, np.int64)
        i, j = dv.gallop(a, b)
        assert np.array_equal(a[i], b[j]) and np.array_equal(a[i], np.intersect1d(a, b))


def test_prices_beyond_64_bits():
    counts = np.array([0, 10**10, 3 * 10**17], np.int64)
    total = 10**18 + 7
    assert dv.prices(counts, total).tolist() == [1 + 10**9 * (int(c) + 2) // total for c in counts]
