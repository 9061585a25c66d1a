import corpus_pipeline
from demandspark.llm import language, queries
from demandspark.llm.common import written

from conftest import SF_SMALL
from edge import DOC_SCHEMA, edge_docs, edge_rows, empty_docs, prose
from test_jaccard import brute as brute_classes
from test_line_dedup import brute as brute_lines

ORDER = ["quality_classifier", "language_id", "line_dedup", "jaccard_join", "best_fit_packing"]


def labels_dir(spark, tmp_path):
    spark.createDataFrame([(1, 1, 0), (3, 1, 0), (7, 1, 0), (11, 0, 0), (12, 1, 0)],
                          "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path)


def test_stage_names():
    assert [name for name, _ in corpus_pipeline.STAGES] == ORDER


def test_stages_on_edge_rows(spark, tmp_path):
    sf_dir = labels_dir(spark, tmp_path)
    docs = edge_docs(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = written(stage(spark, docs, sf_dir), name)
        assert out.columns == docs.columns, name
        assert out.count() <= docs.count()
        # each stage also takes the edge rows directly
        assert stage(spark, edge_docs(spark), sf_dir).count() <= len(edge_rows())
        docs = out
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).count() >= docs.count()


def test_stages_on_an_empty_table(spark, tmp_path):
    sf_dir = labels_dir(spark, tmp_path)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty_docs(spark), sf_dir).count() == 0


def test_run_on_the_small_tables(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    out = corpus_pipeline.run(spark, SF_SMALL)
    ids = {r[0] for r in out.select("doc_id").distinct().collect()}
    assert ids < {r[0] for r in docs.select("doc_id").collect()}
    # labelled clean texts go only as copies: line dedup and the join keep one of each text
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF_SMALL}/labels.parquet").collect()}
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    kept_texts = {text[i] for i in ids}
    bad = [i for i, q in labels.items() if q == 0 and i in ids]
    assert len(bad) <= 1
    lost = [i for i, q in labels.items() if q == 1 and i not in ids and text[i] not in kept_texts]
    assert len(lost) <= 0.08 * len(labels)


def test_stages_against_brute_force(spark, tmp_path):
    """Each stage on all its predecessor kept, with near copies, repeated passages and one labelled class of junk."""
    rows = [(i, prose(i, 40 + i % 30), "en", "s", 1) for i in range(60)]
    passage = "\n".join(prose(100 + k, 12) for k in range(4))
    rows += [(100 + i, f"{prose(200 + i, 50)}\n{passage}\n{prose(300 + i, 20)}", "en", "s", 1) for i in range(8)]
    rows += [(200 + i, prose(5, 400).replace("with", f"with{i}", 1), "en", "s", 1) for i in range(6)]     # near copies
    rows += [(300 + i, " ".join(f"{w}***" for w in prose(400 + i, 40).split()), "en", "s", 1) for i in range(12)]
    spark.createDataFrame([(r[0], int(r[0] < 300), 0) for r in rows], "doc_id long, quality int, toxic int").write.parquet(
        str(tmp_path / "labels.parquet"))
    docs = spark.createDataFrame(rows, DOC_SCHEMA).repartition(3)
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, str(tmp_path)), f"brute-{name}")
        kept[name] = docs.collect()
    # 1: the rows that the classifier predicts to be good
    good = {r["doc_id"] for r in kept["quality_classifier"]}
    assert good >= {r[0] for r in rows if r[0] < 300} and not good & set(range(300, 312))
    # 2: rows with an identified language
    second = [tuple(r) for r in kept["language_id"]]
    names = {r["doc_id"]: r for r in language.identify_documents(spark.createDataFrame(
        [tuple(r) for r in kept["quality_classifier"]], DOC_SCHEMA)).collect()}
    assert {r[0] for r in second} == {i for i, r in names.items() if r["lang"] != "und" and r["confidence"] >= 0.5}
    # 3: texts without the later windows
    want = brute_lines(second)
    texts = {r["doc_id"]: r["text"] for r in kept["line_dedup"]}
    assert texts == {k[1]: t for k, (t, gone) in want.items() if gone < len(k[2].split("\n")) or not gone}
    assert any(gone for _, gone in want.values())
    # 4: the least id of every class of near duplicates
    classes = brute_classes([(i, t) for i, t in texts.items()])
    assert {r["doc_id"] for r in kept["jaccard_join"]} == {i for i, c, _ in classes if i == c}
    assert len([i for i in texts if 200 <= i < 206]) == 6 and len([r for r in kept["jaccard_join"] if 200 <= r["doc_id"] < 206]) == 1
    # 5: every document packed
    assert {r["doc_id"] for r in kept["best_fit_packing"]} == {r["doc_id"] for r in kept["jaccard_join"]}


def test_every_operator_has_one_query():
    names = [n for n in queries.QUERIES if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert "pipeline" in queries.QUERIES
