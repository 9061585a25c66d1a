import numpy as np

from demandspark.llm import quality

from edge import edge_docs, edge_rows, empty_docs, prose

LABELS = "doc_id long, quality int, toxic int"


def labelled(spark, n=400):
    rows, labels = [], []
    for i in range(n):
        good = i % 4 != 0
        text = prose(i, 60) if good else " ".join(w.upper() + "!!" for w in prose(i, 5).split() * 12)
        rows.append((i, text, "en", "a", len(text)))
        labels.append((i, int(good), 0))
    return (spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"),
            spark.createDataFrame(labels, LABELS))


def test_held_out_accuracy(spark):
    docs, labels = labelled(spark)
    got = quality.classify(docs, labels).join(labels, "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert 40 < len(held) < 120
    assert np.mean([r["predicted"] == r["quality"] for r in held]) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)


def test_matches_direct_formula(spark):
    docs, labels = labelled(spark, 120)
    features = quality.document_statistics(docs)
    model = quality.train(features, labels)
    x = {r["id"]: np.array(r["x"]) for r in features.collect()}
    rows = [r for r in labels.collect() if __import__("zlib").crc32(str(r["doc_id"]).encode()) % 5]
    d = len(quality.FEATURES)
    by = [np.array([x[r["doc_id"]] for r in rows if r["quality"] == k]) for k in (0, 1)]
    pooled = sum((b - b.mean(0)).T @ (b - b.mean(0)) for b in by) / len(rows)
    logs = []
    for b in by:
        cov = 0.9 * (b - b.mean(0)).T @ (b - b.mean(0)) / len(b) + 0.1 * pooled
        cov = 0.98 * cov + 0.02 * (np.trace(cov) / d + 1e-9) * np.eye(d)
        diff = np.array([x[i] for i in sorted(x)]) - b.mean(0)
        logs.append(np.log((len(b) + 1) / (len(rows) + 2)) - 0.5 * np.linalg.slogdet(cov)[1]
                    - 0.5 * np.einsum("nd,de,ne->n", diff, np.linalg.inv(cov), diff))
    want = 1 / (1 + np.exp(-np.clip(logs[1] - logs[0], -60, 60)))
    assert np.allclose(model.score(np.array([x[i] for i in sorted(x)])), want, atol=1e-6)


def test_edge_rows(spark):
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 0), (4, None, 0), (99, 1, 1), (None, 1, 0)], LABELS)
    got = quality.classify(edge_docs(spark), labels).collect()
    assert len(got) == len(edge_rows())
    assert all(r["score"] is not None and r["held_out"] is not None for r in got)
    none = quality.classify(edge_docs(spark), labels.filter("false")).collect()
    assert {r["score"] for r in none} == {0.5}
    assert quality.classify(empty_docs(spark), labels).count() == 0


def test_keep_agrees_with_classify(spark):
    docs, labels = labelled(spark, 80)
    model = quality.train(quality.document_statistics(docs), labels)
    kept = {r["doc_id"] for r in quality.keep(docs, model).collect()}
    assert kept == {r["doc_id"] for r in quality.classify(docs, labels).filter("predicted = 1").collect()}
