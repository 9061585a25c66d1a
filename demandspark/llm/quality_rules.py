"""Quality rules as a bitmask ledger (operator 13), in DataFrame functions only.

``ledger`` measures every text once and evaluates every rule once: a row holds
the measurements and one integer whose bit k says that rule k failed.  Policies
are versioned sets of rules (masks); ``apply_policy`` turns the stored bits
into verdicts without reading a text again, and ``ablations`` counts, per
policy and rule, the rows that the rule fails, that it alone drops, and that
are dropped in all, from the bits alone: rows are first counted by bit pattern
(at most 2 to the number of rules), so nothing else is shuffled.

Words are runs of characters other than blanks and U+0009 to U+000D.  A word
counts as repeated if one of the five-word windows over it occurs at least
twice in its text; windows are compared by 64-bit hashes (within one text).

Edge cases: a null text counts as the empty one, has no words and fails
``few_words`` only, as do texts of blanks; a null id is kept; repeated rows get a row
each; a very long text is one row, measured whole; an empty table gives an empty
ledger; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandspark.llm.common import let

WINDOW = 5
BLANKS = "\t\n\x0b\f\r"                # besides the space
SYMBOLS = "#*$%&|<>"
ENDS = ".!?\"'…。！？"  # what a sentence may end with

#: The rules in the order of their bits: name and failing condition over the measurements.
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", "n_words < 10"),
    ("repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("repeated_lines", "100 * n_dup_lines > 30 * n_lines"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 15 * n_words"),
    ("digits", "100 * n_digits > 30 * word_chars"),
    ("few_lines_end", "n_lines >= 5 and 100 * n_ended_lines < 10 * n_lines"),
    ("bullets", "n_lines >= 5 and 100 * n_bullet_lines > 90 * n_lines"),
    ("long_text", "n_words > 100000"),
)
BASE = ("few_words", "repeated_windows")
#: Versions of the filter: which rules drop a row.
POLICIES: Mapping[str, tuple[str, ...]] = {
    "base": BASE,
    "v1": (*BASE, "symbols", "repeated_lines"),
    "v2": (*BASE, "symbols", "repeated_lines", "short_words", "long_words", "digits", "few_lines_end", "bullets"),
}
CURRENT = "v2"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_digits",
            "n_ended_lines", "n_bullet_lines")


def mask(rules: Sequence[str]) -> int:
    """The bits of the named rules."""
    names = [name for name, _ in RULES]
    return sum(1 << names.index(r) for r in set(rules))


def _occurrences(text: Column, chars: str) -> Column:
    """How many characters of ``text`` are among ``chars`` (ASCII)."""
    rest = text
    for c in chars:
        rest = F.replace(rest, F.lit(c), F.lit(""))
    return F.octet_length(text) - F.octet_length(rest)


def _repeated(h: Column, window: int) -> Column:
    """Words covered by windows of word hashes that occur twice or more."""
    def covered(g: Column) -> Column:
        def starts(s: Column) -> Column:
            twin = F.transform(s, lambda e, j: F.when(
                (e["g"] == F.get(s, j - 1)["g"]) | (e["g"] == F.get(s, j + 1)["g"]), e["at"]))
            return F.sort_array(F.array_compact(twin))

        def cover(p: Column) -> Column:
            lengths = F.transform(p, lambda a, j: F.least(F.lit(window), F.coalesce(F.get(p, j + 1), a + window) - a))
            return F.aggregate(lengths, F.lit(0), lambda total, n: total + n)

        places = F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("g"), i.alias("at"))))
        # most texts repeat nothing, and counting distinct hashes is cheaper than sorting them
        return F.when(F.size(F.array_distinct(g)) == F.size(g), 0).otherwise(let(let(places, starts), cover))

    windows = F.transform(F.sequence(F.lit(0), F.size(h) - window),
                          lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(window)]))
    return F.when(F.size(h) < window, 0).otherwise(let(windows, covered))


def measure(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id and the measurements of every row."""
    def of_words(words: Column) -> Column:
        hashes = F.transform(words, lambda w: F.xxhash64(w))
        return F.struct(F.size(words).alias("n_words"), let(hashes, lambda h: _repeated(h, WINDOW)).alias("n_repeat_words"))

    def of_lines(lines: Column) -> Column:
        bare = F.transform(lines, lambda x: F.btrim(x, F.lit(" " + BLANKS)))
        return F.struct(
            F.size(lines).alias("n_lines"),
            (F.size(lines) - F.size(F.array_distinct(lines))).alias("n_dup_lines"),
            let(bare, lambda b: F.struct(
                F.size(F.filter(b, lambda x: F.right(x, F.lit(1)).isin(*ENDS))).alias("ended"),
                F.size(F.filter(b, lambda x: F.left(x, F.lit(1)).isin("-", "*", "•"))).alias("bullets"))).alias("b"))

    def of_text(t: Column) -> Column:
        spaced = t
        for c in BLANKS:
            spaced = F.replace(spaced, F.lit(c), F.lit(" "))
        lines = F.filter(F.split(t, "\n", -1), lambda x: F.btrim(x, F.lit(" " + BLANKS)) != "")
        return F.struct(
            let(F.array_remove(F.split(spaced, " ", -1), ""), of_words).alias("w"),
            let(lines, of_lines).alias("l"),
            (F.char_length(t) - _occurrences(t, " " + BLANKS)).alias("word_chars"),
            _occurrences(t, SYMBOLS).alias("n_symbols"),
            _occurrences(t, "0123456789").alias("n_digits"))

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    m = df.select(F.col(id_col), let(text, of_text).alias("m"))
    found = {"n_words": "m.w.n_words", "word_chars": "m.word_chars", "n_symbols": "m.n_symbols",
             "n_dup_lines": "m.l.n_dup_lines", "n_repeat_words": "m.w.n_repeat_words", "n_lines": "m.l.n_lines",
             "n_digits": "m.n_digits", "n_ended_lines": "m.l.b.ended", "n_bullet_lines": "m.l.b.bullets"}
    return m.select(id_col, *[F.col(found[c]).cast("long").alias(c) for c in MEASURES])


def ledger(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
           rules: Sequence[tuple[str, str]] = RULES) -> DataFrame:
    """The measurements and ``failures``, whose bit k is set where rule k fails."""
    bits = F.lit(0).cast("long")
    for k, (_, condition) in enumerate(rules):
        bits = bits + F.when(F.expr(condition), F.lit(1 << k)).otherwise(F.lit(0)).cast("long")
    return measure(df, id_col, text_col).withColumn("failures", bits)


def apply_policy(entries: DataFrame, policy: str = CURRENT, kept_col: str = "kept") -> DataFrame:
    """The ledger with the verdict of one policy, from the stored bits."""
    return entries.withColumn(kept_col, F.col("failures").bitwiseAND(F.lit(mask(POLICIES[policy]))) == 0)


def ablations(entries: DataFrame, policies: Mapping[str, Sequence[str]] = POLICIES) -> DataFrame:
    """Per policy and each of its rules: rows failing it, rows it alone drops, rows dropped, rows in all.

    ``fails_all`` says that the rule fails on every row (its bit is in the
    conjunction of all bits).  An empty ledger gives zero counts.
    """
    names = [name for name, _ in RULES]
    table = [F.struct(F.lit(p).alias("policy"), F.lit(r).alias("rule"), F.lit(1 << names.index(r)).cast("long").alias("bit"),
                      F.lit(mask(rules)).cast("long").alias("mask")) for p, rules in policies.items() for r in rules]
    patterns = entries.groupBy("failures").agg(F.count(F.lit(1)).alias("n"))
    spark = entries.sparkSession
    rules = spark.range(1).select(F.inline(F.array(*table)))
    hit = F.col("failures").bitwiseAND(F.col("mask"))
    fails = F.col("failures").bitwiseAND(F.col("bit")) != 0

    def total(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0)).cast("long")

    # at most one row a bit pattern meets the fixed list of rules
    return rules.join(F.broadcast(patterns), F.lit(True), "left").groupBy("policy", "rule").agg(
        total(fails).alias("failed"), total(hit == F.col("bit")).alias("dropped_alone"),
        total(hit != 0).alias("dropped"), total(F.col("n").isNotNull()).alias("rows"),
        F.coalesce(F.bit_and("failures").bitwiseAND(F.first("bit")) != 0, F.lit(False)).alias("fails_all"))


def verdicts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", policy: str = CURRENT) -> DataFrame:
    """The ledger of every row with ``base_failed`` (rules of the base policy) and ``kept`` (those and the policy's)."""
    out = apply_policy(ledger(df, id_col, text_col), policy, "passes")
    base = F.col("failures").bitwiseAND(F.lit(mask(BASE))) != 0
    return out.select("*", base.alias("base_failed"), (~base & F.col("passes")).alias("kept")).drop("passes")
