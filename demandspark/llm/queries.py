"""The registered queries of the training-data operators and their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from demandspark.llm import (byte_bpe, divergence, fingerprints, jaccard, language, licences, line_dedup, maxent,
                             neighbours, packing, phrases, quality, quality_rules)
from demandspark.sources.fixtures import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


@_query("op1_best_fit_packing")
def best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, sf_dir, "documents"),
                                  public_tokenizers.path("word_bpe_49k.json"))


LINE_DEDUP_SQL = """
WITH lines AS (
  SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL),
win AS (
  SELECT doc_id, p, l[p + 1] || chr(10) || l[p + 2] || chr(10) || l[p + 3] AS w
  FROM (SELECT doc_id, l, unnest(range(0, len(l) - 2)) AS p FROM lines WHERE len(l) >= 3)
  WHERE l[p + 1] <> '' OR l[p + 2] <> '' OR l[p + 3] <> ''),
later AS (
  SELECT doc_id, p FROM (SELECT *, row_number() OVER (PARTITION BY w ORDER BY doc_id, p) AS k FROM win) WHERE k > 1),
covered AS (
  SELECT doc_id, list_sort(list(DISTINCT line)) AS c
  FROM (SELECT doc_id, unnest(range(p, p + 3)) AS line FROM later) GROUP BY doc_id),
kept AS (
  SELECT doc_id, string_agg(l[i], chr(10) ORDER BY i) AS text
  FROM (SELECT lines.doc_id, l, c, unnest(range(1, len(l) + 1)) AS i FROM lines JOIN covered USING (doc_id))
  WHERE NOT list_contains(c, i - 1) GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(len(string_split(d.text, chr(10))), 0) AS INTEGER) AS n_lines,
       CAST(coalesce(len(c), 0) AS INTEGER) AS n_removed,
       CASE WHEN c IS NULL THEN d.text ELSE coalesce(kept.text, '') END AS text
FROM documents d LEFT JOIN covered ON covered.doc_id = d.doc_id LEFT JOIN kept ON kept.doc_id = d.doc_id"""


@_query("op2_line_dedup", LINE_DEDUP_SQL)
def line_dedup_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", "text")


@_query("op3_quality_classifier")
def quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


@_query("op4_nearest_neighbours")
def nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


@_query("op5_language_id")
def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify_pages(read_table(spark, sf_dir, "pages"),
                                   read_table(spark, sf_dir, "documents")).drop("row_key")


@_query("op6_byte_bpe")
def byte_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(read_table(spark, sf_dir, "documents"),
                               public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


@_query("op7_jaccard_join")
def jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicate_classes(read_table(spark, sf_dir, "documents")).drop("row_key")


def _licence_sql() -> str:
    known = ", ".join(f"('{sid}', '{s}')" for sid, s in licences.SENTENCES)
    names = "''"
    for k, (name, ids) in enumerate(licences.RULES):
        # each rule sees what the rules before it left
        pattern = "|" + "||".join(ids) + "|"
        names += f" || CASE WHEN contains(s{k}, '{pattern}') THEN '{name} ' ELSE '' END"
    steps = ", ".join(f"s{k} AS (SELECT *, replace(s{k}, '{'|' + '||'.join(ids) + '|'}', '#') AS s{k + 1} FROM "
                      f"{f's{k - 1}' if k else 'ids'})" for k, (_, ids) in enumerate(licences.RULES))
    return f"""
WITH known(sid, sentence) AS (VALUES {known}),
raw AS (
  SELECT doc_id, unnest(s) AS raw, unnest(range(len(s))) AS pos FROM (
    SELECT doc_id, string_split(regexp_replace(text, '([.!?:;])[ \\t\\r]+', '\\1' || chr(10), 'g'), chr(10)) AS s
    FROM documents)),
hits AS (
  SELECT doc_id, count(*) AS n, string_agg(sid, ' ' ORDER BY pos) AS ids,
         string_agg('|' || sid || '|', '' ORDER BY pos) AS seq
  FROM raw JOIN known ON known.sentence = trim(regexp_replace(lower(raw), '[^a-z0-9]+', ' ', 'g'))
  GROUP BY doc_id),
ids AS (
  SELECT d.doc_id, coalesce(n, 0) AS n, coalesce(ids, '') AS ids, coalesce(seq, '') AS s0
  FROM documents d LEFT JOIN hits ON hits.doc_id = d.doc_id),
{steps}
SELECT doc_id, CAST(n AS INTEGER) AS n_known, ids AS sentence_ids,
       array_to_string(list_sort(list_distinct(string_split(trim({names}), ' '))), ' ') AS licences
FROM s{len(licences.RULES) - 1}"""


@_query("op8_licence_scan", _licence_sql())
def licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan_licences(read_table(spark, sf_dir, "documents"))


@_query("op9_fingerprints")
def fingerprint_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_fingerprints(read_table(spark, sf_dir, "documents"))


@_query("op10_maxent_scores")
def maxent_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent.score_texts(read_table(spark, sf_dir, "documents"))


DIVERGENCE_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, coalesce(text, '') AS text, coalesce(lang, '') AS lang,
                  coalesce(source, '') AS source FROM documents),
word AS (SELECT r, lang, source, unnest(regexp_extract_all(
           translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
voc AS (SELECT lang, term, CAST(count(*) AS HUGEINT) AS n FROM word GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
size AS (SELECT lang, count(*) AS v, sum(n) AS n FROM voc GROUP BY lang),
grp AS (SELECT DISTINCT lang, source FROM d),
cnt AS (SELECT lang, source, term, CAST(count(*) AS HUGEINT) AS n FROM word JOIN voc USING (lang, term) GROUP BY ALL),
total AS (SELECT lang, source, sum(n) AS n FROM cnt GROUP BY ALL),
price AS (SELECT grp.lang, grp.source, voc.term, coalesce(cnt.n, 0) AS c,
            1 + (1000000000 * (coalesce(cnt.n, 0) + 2)) // (coalesce(total.n, 0) + 2 * size.v) AS p,
            1 + (1000000000 * (voc.n + 2)) // (size.n + 2 * size.v) AS q
          FROM grp JOIN voc ON voc.lang = grp.lang JOIN size ON size.lang = grp.lang
          LEFT JOIN total ON total.lang = grp.lang AND total.source = grp.source
          LEFT JOIN cnt ON cnt.lang = grp.lang AND cnt.source = grp.source AND cnt.term = voc.term),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
          FROM price a JOIN price b ON b.lang = a.lang AND b.term = a.term AND b.source <> a.source GROUP BY ALL),
parts AS (
  SELECT g.lang, g.source, 'pair' AS part, h.source AS item, coalesce(value, 0) AS value
  FROM grp g JOIN grp h ON h.lang = g.lang AND h.source <> g.source
  LEFT JOIN pairs ON pairs.lang = g.lang AND pairs.source = g.source AND pairs.item = h.source
  UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q)) // (p + q) FROM price WHERE c > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM parts)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM ranked WHERE part = 'pair' OR rank <= 10"""


@_query("op11_source_divergence", DIVERGENCE_SQL)
def source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(read_table(spark, sf_dir, "documents"))


PHRASES_SQL = """
WITH piece AS (
  SELECT row_number() OVER () AS piece, lang, piece AS body FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(string_split(regexp_replace(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[.,;:!?\\x0A-\\x0D]', chr(10), 'g'), chr(10))) AS piece FROM documents)),
word AS (SELECT lang, list_filter(string_split(replace(body, chr(9), ' '), ' '), lambda x: x <> '') AS w FROM piece),
gram AS (
  SELECT lang, k, array_to_string(w[p:p + k - 1], ' ') AS phrase FROM (
    SELECT lang, k, w, unnest(range(1, len(w) - k + 2)) AS p FROM word, range(1, 5) r(k) WHERE len(w) >= k)),
size AS (SELECT lang, count(*) AS n FROM gram WHERE k = 1 GROUP BY lang),
f AS (SELECT lang, k, phrase, CAST(count(*) AS HUGEINT) AS f FROM gram GROUP BY ALL HAVING count(*) >= 30),
cand AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k >= 2),
cut AS (
  SELECT c.lang, c.phrase, c.a, cut, l.f AS l, r.f AS r, (2000000 * c.a) // (l.f + r.f) AS score
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM cand) c
  JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:c.cut], ' ')
  JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[c.cut + 1:], ' ')),
scored AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inner_ AS (
  SELECT lang, array_to_string(w[p:p + m - 1], ' ') AS phrase, max(a) AS longer FROM (
    SELECT lang, w, a, m, unnest(range(1, k - m + 2)) AS p FROM cand, range(2, 4) r(m) WHERE m < k) GROUP BY ALL),
kept AS (
  SELECT s.* FROM scored s LEFT JOIN inner_ i ON i.lang = s.lang AND i.phrase = s.phrase
  WHERE i.longer IS NULL OR 100 * i.longer < 80 * s.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT ranked.lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l,
       CAST(r AS BIGINT) AS r, CAST(score AS BIGINT) AS score, CAST(n AS BIGINT) AS n
FROM ranked JOIN size ON size.lang = ranked.lang WHERE rank <= 2000"""


@_query("op12_phrase_mining", PHRASES_SQL)
def phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(read_table(spark, sf_dir, "documents"))


RULES_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, unnest(w) AS word, unnest(range(len(w))) AS pos FROM (
        SELECT r, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w FROM d)),
words AS (SELECT r, count(*) AS n_words, sum(length(word)) AS word_chars FROM w GROUP BY r),
win AS (
  SELECT r, pos, word || ' ' || w2 || ' ' || w3 || ' ' || w4 || ' ' || w5 AS win FROM (
    SELECT *, lead(word, 1) OVER o AS w2, lead(word, 2) OVER o AS w3, lead(word, 3) OVER o AS w4, lead(word, 4) OVER o AS w5 FROM w
    WINDOW o AS (PARTITION BY r ORDER BY pos)) WHERE w5 IS NOT NULL),
twice AS (SELECT r, win FROM win GROUP BY r, win HAVING count(*) > 1),
rep AS (SELECT r, count(DISTINCT pos) AS n_repeat_words FROM (
          SELECT win.r, unnest(range(win.pos, win.pos + 5)) AS pos FROM win JOIN twice USING (r, win)) GROUP BY r),
line AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d),
lines AS (
  SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines,
         count(*) FILTER (WHERE regexp_matches(line, '[.!?"''…。！？][\\x20\\x09-\\x0D]*$')) AS n_ended_lines,
         count(*) FILTER (WHERE regexp_matches(line, '^[\\x20\\x09-\\x0D]*[-*•]')) AS n_bullet_lines
  FROM line WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY r),
m AS (
  SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines,
         len(regexp_extract_all(text, '[0-9]')) AS n_digits, coalesce(n_ended_lines, 0) AS n_ended_lines,
         coalesce(n_bullet_lines, 0) AS n_bullet_lines
  FROM d LEFT JOIN words ON words.r = d.r LEFT JOIN rep ON rep.r = d.r LEFT JOIN lines ON lines.r = d.r),
ledger AS (SELECT *, {bits} AS failures FROM m)
SELECT doc_id, {measures}, CAST(failures AS BIGINT) AS failures,
       failures & {base} <> 0 AS base_failed, failures & {kept} = 0 AS kept FROM ledger"""


@_query("op13_quality_rules", RULES_SQL.format(
    bits=" + ".join(f"CASE WHEN {condition} THEN {1 << k} ELSE 0 END"
                    for k, (_, condition) in enumerate(quality_rules.RULES)),
    measures=", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in quality_rules.MEASURES),
    base=quality_rules.mask(quality_rules.BASE),
    kept=quality_rules.mask({*quality_rules.BASE, *quality_rules.POLICIES[quality_rules.CURRENT]})))
def quality_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.verdicts(read_table(spark, sf_dir, "documents"))


QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL is not None:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
