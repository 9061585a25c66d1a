import re

from pyspark.sql import functions as F

from demandspark.llm import quality_rules as q

from edge import DOC_SCHEMA, edge_docs, edge_rows, empty_docs

WORD = re.compile(r"[^\x20\x09-\x0d]+")


def brute(text):
    """The contract's base values of one text, from its own wording."""
    words = WORD.findall(text or "")
    windows = {}
    for i in range(len(words) - 4):
        windows.setdefault(tuple(words[i:i + 5]), []).append(i)
    covered = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(5)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)),
            len(covered))


def test_against_brute_force(spark):
    extra = [(100 + i, t, "en", "a", 1) for i, t in enumerate([
        "a b c d e a b c d e", "a a a a a a a", "a b c d e f a b c d e", "a b c d", "x y z w v u x y z w v u x y z w v",
        "one\x0btwo\x0cthree\rfour\tfive  six\n\nseven", "| a | b | # * $ % & < >\nx\nx\n \t\nx", " ", "a b c d",
        "1 2 3 4 5 6 7 8 9 10 11 12", "\U0001f642 " * 12, "- a b\n- c d\n- e f\n- g h\n- i j k l"])]
    df = spark.createDataFrame(edge_rows() + extra, DOC_SCHEMA).repartition(3)
    got = q.verdicts(df).join(df.select("doc_id", "text"), "doc_id").collect()
    texts = {}
    for r in edge_rows() + extra:
        texts.setdefault(r[0], set()).add(r[1])
    for r in got:
        want = brute(r["text"])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (r["base_failed"] and r["kept"])


def test_rows_and_clashing_names(spark):
    rows = edge_rows()
    out = q.verdicts(edge_docs(spark).withColumns({c: F.lit("clash") for c in ("m", "failures", "kept", "n_words")}))
    assert out.count() == len(rows)
    assert out.filter("doc_id is null").count() == sum(r[0] is None for r in rows)
    empty = out.filter("n_words = 0").collect()
    assert empty and all(r["base_failed"] and not r["kept"] and r["failures"] == 1 for r in empty)


def test_every_rule_can_fail(spark):
    texts = ["a b", "a b c d e " * 5, "# # " + "word " * 12, "x y\n" * 9 + "p q r s t u", "a b c d e f g h i j k",
             " ".join("b" * (20 + i) for i in range(12)), " ".join(str(10**6 + i) for i in range(12)),
             "\n".join(f"word{i} next" for i in range(9)), "\n".join(f"- item{i}." for i in range(9)),
             " ".join(f"w{i}" for i in range(100_001))]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["failures"] for r in q.ledger(df).collect()}
    for k in range(len(q.RULES)):
        assert got[k] & (1 << k), q.RULES[k]


def test_policies_and_ablations(spark):
    bits = [0, 1, 2, 3, 4, 4, 12, 1 << 9]
    ledger = spark.createDataFrame([(i, b) for i, b in enumerate(bits)], "doc_id long, failures long")
    for name, rules in q.POLICIES.items():
        m = q.mask(rules)
        kept = q.apply_policy(ledger, name).filter("kept").count()
        assert kept == sum(not b & m for b in bits)
    for r in q.ablations(ledger).collect():
        m, bit = q.mask(q.POLICIES[r["policy"]]), q.mask([r["rule"]])
        assert r["failed"] == sum(bool(b & bit) for b in bits)
        assert r["dropped_alone"] == sum(b & m == bit for b in bits)
        assert r["dropped"] == sum(bool(b & m) for b in bits)
        assert r["rows"] == len(bits) and not r["fails_all"]


def test_empty_table(spark):
    assert q.verdicts(empty_docs(spark)).count() == 0
    assert q.ablations(q.ledger(empty_docs(spark))).agg(F.sum("rows")).first()[0] == 0


def test_one_pass_without_python_or_shuffle(spark):
    docs = spark.range(10).select(F.col("id").alias("doc_id"), F.lit("some text").alias("text"))
    plan = q.verdicts(docs)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Exchange"))
