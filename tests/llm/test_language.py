import numpy as np

from demandspark.llm import language

from edge import edge_docs, edge_rows, empty_docs

EN = "the quick brown fox and the lazy dog are with the other animals of this forest "
DE = "der schnelle braune fuchs und der faule hund sind mit den anderen tieren dieses waldes "


def training(spark):
    rows = [(i, (EN if i % 2 else DE) * 3, "en" if i % 2 else "de", "s", 1) for i in range(20)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_profiles_against_direct_counts(spark):
    langs, table = language.profiles(training(spark))
    assert langs == ["de", "en", "und"]
    count = np.bincount(language.trigram_buckets(EN * 3), minlength=language.BUCKETS) * 10 + 0.1
    assert np.allclose(table[1], np.log(count / count.sum()))
    assert np.allclose(table[2], -np.log(language.BUCKETS))


PAGES = [
    (1, "https://a.example.de/x", f"<html lang='de'><body><nav>{EN}</nav><article>{DE}</article></body></html>"),
    (2, "https://b.example.com/x", f"<html lang=en-US><body><p>{EN}</p></body></html>"),
    (3, "https://b.example.com/y", f"<html lang='de'><body><p>{EN}</p></body></html>"),     # declared wrongly
    (4, "https://b.example.com/z", "<html><body></body></html>"),                            # no text: the host decides
    (5, None, None),
    (6, "not a url", ""),
    (7, "https://c.example.de/", f"<html><script>{EN}</script><body>{DE}</body></html>"),
    (7, "https://c.example.de/", f"<html><script>{EN}</script><body>{DE}</body></html>"),
] + [(100 + i, "https://b.example.com/p", f"<html lang='en'><body>{EN}</body></html>") for i in range(12)]


def test_pages(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("lang", language.F.lit("clash"))
    got = {r["page_id"]: r for r in language.identify_pages(pages, training(spark)).collect()}
    assert len(got) == len({p[0] for p in PAGES})
    assert [got[i]["lang"] for i in (1, 2, 3, 4, 7)] == ["de", "en", "en", "en", "de"]
    assert got[1]["declared"] == "de" and got[1]["suffix"] == "de" and got[1]["host"] == "a.example.de"
    assert got[5]["host"] == "-" and got[5]["lang"] is not None


def test_fusion_against_direct_formula(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    langs, table = language.profiles(training(spark))
    rows = language.page_evidence(pages).collect()
    ll = np.array([table[:, language.trigram_buckets(r["body"] or "")].sum(axis=1) * language.TEMPER for r in rows])
    flat = np.array([0, 0, np.log(language.UND_PRIOR)])

    def soft(a):
        e = np.exp(a - a.max(axis=-1, keepdims=True))
        return e / e.sum(axis=-1, keepdims=True)

    post = soft(ll + flat)
    key = {c: np.array([r[c] or "-" for r in rows]) for c in ("declared", "suffix", "host")}
    total = post.sum(0) + 0.5
    want = []
    for i in range(len(rows)):
        suffix = post[key["suffix"] == key["suffix"][i]].sum(0) + language.SUFFIX_WEIGHT * total / total.sum()
        host = post[key["host"] == key["host"][i]].sum(0) - post[i]
        mine = post[key["declared"] == key["declared"][i]].sum(0)
        declared = np.log((mine + mine.sum() / total.sum() * language.DECLARED_WEIGHT + 1e-6)
                          / (total + language.DECLARED_WEIGHT))
        want.append(soft(np.log(np.maximum(host, 0) + language.HOST_WEIGHT * suffix / suffix.sum()) + declared + ll[i]))
    want = np.array(want)
    got = {(r["id"], r["lang"]): r["confidence"] for r in language.identify(
        language.page_evidence(pages), langs, table, "id", "body", "declared", "suffix", "host").collect()}
    for r, p in zip(rows, want):
        assert abs(got[(r["id"], langs[int(p.argmax())])] - p.max()) < 1e-4


def test_documents(spark):
    rows = language.identify_documents(edge_docs(spark)).collect()
    assert len(rows) == len(edge_rows())
    assert all(r["lang"] is not None and 0 <= r["confidence"] <= 1 for r in rows)
    assert language.identify_documents(empty_docs(spark)).count() == 0


def test_noise_is_rejected_and_prose_is_kept(spark):
    rng = np.random.default_rng(1)
    noise = "".join(chr(int(c)) for c in rng.integers(0x21, 0x2fff, 600) if not 0xd800 <= c < 0xe000)
    docs = training(spark).union(spark.createDataFrame([(900, noise, "en", "s", 1)], training(spark).schema))
    langs, table = language.profiles(training(spark))
    out = language.identify(docs, langs, table, "doc_id", "text", "lang", None, "source")
    assert [r["doc_id"] for r in language.rejected(out).collect()] == [900]
