from pyspark.sql import functions as F

from demandspark.llm import line_dedup

from edge import edge_docs, edge_rows, empty_docs


def brute(rows):
    """Text and number of removed lines of each distinct (id, text), in the operator's order."""
    seen, covered = {}, {}
    order = sorted({(r[0] is not None, r[0] or 0, r[1]) for r in rows if r[1] is not None}, key=lambda k: k[:2])
    for key in order:
        lines = key[2].split("\n")
        for p in range(len(lines) - 2):
            w = tuple(lines[p:p + 3])
            if w == ("", "", ""):
                continue
            if seen.setdefault(w, (key, p)) != (key, p):
                covered.setdefault(key, set()).update({p, p + 1, p + 2})
    out = {}
    for key in order:
        lines = key[2].split("\n")
        gone = covered.get(key, set())
        out[key] = ("\n".join(x for i, x in enumerate(lines) if i not in gone), len(gone))
    return out


def test_against_brute_force(spark):
    rows = edge_rows()
    want = brute(rows)
    got = line_dedup.dedup_lines(edge_docs(spark)).select("doc_id", "text", "n_lines", "n_removed", "removed", "lang").collect()
    assert len(got) == len(rows)
    texts = sorted((str(r["doc_id"]), str(r["text"]), r["n_removed"]) for r in got)
    expected = sorted((str(r[0]), *([str(None), 0] if r[1] is None else
                                    want[(r[0] is not None, r[0] or 0, r[1])])) for r in rows)
    assert texts == expected
    for r in got:
        assert sum(s["end"] - s["start"] for s in r["removed"]) == r["n_removed"]
        assert r["n_removed"] <= r["n_lines"]


def test_repeated_lines_of_one_document_stay_once(spark):
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(edge_docs(spark)).collect()}
    assert got[8] == "x\ny\nz"
    assert got[9] == "\n\n\n\n"


def test_other_columns_pass(spark):
    out = line_dedup.dedup_lines(edge_docs(spark))
    assert out.filter(F.col("score") != "clash").count() == 0


def test_empty_table(spark):
    assert line_dedup.dedup_lines(empty_docs(spark)).count() == 0
