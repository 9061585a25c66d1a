"""Language identification by Bayesian fusion of evidence (operator 5).

Four kinds of evidence meet in one posterior over the languages of a training
table and ``und`` (no language):

- the text: hashed character trigrams under profiles counted over all training
  texts; ``und`` is the uniform distribution over the buckets.  Neighbouring
  trigrams are not independent, so the log-likelihood is tempered;
- the language that the markup declares, under P(declared | language);
- the address suffix and the host: the prior of a page is its host's language
  distribution, smoothed towards its suffix's, which is smoothed towards the
  whole table's.  A page's own contribution is left out of its host's counts.

The tables of the last two are grouped aggregations of the text posteriors.

Edge cases: null and empty texts have no text evidence and are decided by the
rest; a null host, suffix or declaration is a value of its own ("-"); every
row gives one row; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from demandspark.llm.common import written

BUCKETS = 1 << 16
TEMPER = 0.2
HOST_WEIGHT = 5.0      # pseudo-pages of the suffix in a host's prior
SUFFIX_WEIGHT = 20.0   # pseudo-pages of the whole table in a suffix's prior
DECLARED_WEIGHT = 20.0  # pseudo-pages of the overall share in P(declared | language)
UND = "und"
UND_PRIOR = 1e-3
MIN_CONFIDENCE = 0.5


def trigram_buckets(text: str) -> np.ndarray:
    """Bucket of every character trigram of the lower-cased text, blanks collapsed and padded."""
    text = " " + " ".join(text.lower().split()) + " "
    if len(text) < 3:
        return np.zeros(0, np.int64)
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    h = c[:-2] * np.uint32(2654435761) + c[1:-1] * np.uint32(2246822519) + c[2:] * np.uint32(3266489917)
    h ^= h >> np.uint32(15)
    h *= np.uint32(2246822519)
    return (h >> np.uint32(16)).astype(np.int64)


def profiles(training: DataFrame, text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages and their log-probabilities by bucket, counted over all training rows.

    Languages are two- or three-letter codes, so their number is bounded, and
    so is the table (languages x 65,536 buckets).
    """
    code = F.lower(F.regexp_extract(F.trim(F.col(lang_col)), r"^([A-Za-z]{2,3})(?:[-_].*)?$", 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part: dict[str, list[np.ndarray]] = {}
                rows = batch.slice(lo, 256)
                for text, lang in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist()):
                    part.setdefault(lang, []).append(trigram_buckets(text))
                for lang, found in part.items():
                    total = counts.setdefault(lang, np.zeros(BUCKETS, np.int64))
                    total += np.bincount(np.concatenate(found), minlength=BUCKETS)
        for lang, total in counts.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at),
                                              pa.array(total[at])], names=["lang", "bucket", "n"])

    rows = (training.select(F.col(text_col), code.alias("lang")).filter(f"lang <> '' and {text_col} is not null")
            .mapInArrow(run, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
            .groupBy("lang").agg(F.collect_list(F.struct("bucket", "n")).alias("cells")).collect())
    langs = sorted(r["lang"] for r in rows)
    table = np.full((len(langs) + 1, BUCKETS), 0.0)
    for r in rows:
        table[langs.index(r["lang"]), [c["bucket"] for c in r["cells"]]] = [c["n"] for c in r["cells"]]
    smooth = table[:-1] + 0.1
    table[:-1] = np.log(smooth / smooth.sum(axis=1, keepdims=True))
    table[-1] = -np.log(BUCKETS)
    return langs + [UND], table


def text_likelihoods(df: DataFrame, table: np.ndarray, columns: list[str], text_col: str = "text") -> DataFrame:
    """``columns`` and ``ll``, the tempered log-likelihood of the text by language."""
    shared = df.sparkSession.sparkContext.broadcast(np.ascontiguousarray(table.T.astype(np.float32)))
    schema = df.select(*columns).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_bucket = shared.value
        for batch in batches:
            ll = [(by_bucket[trigram_buckets(t or "")].sum(axis=0, dtype=np.float64) * TEMPER)
                  for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(ll, pa.list_(pa.float64()))],
                                             names=[*batch.schema.names[:-1], "ll"])

    return (df.select(*columns, F.col(text_col).alias("__text"))
            .mapInArrow(run, schema.add("ll", T.ArrayType(T.DoubleType()))))


def _normalised(a: Column) -> Column:
    """exp(a) scaled to sum 1, without overflow."""
    top = F.array_max(a)
    e = F.transform(a, lambda x: F.exp(x - top))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda s, y: s + y))


def identify(df: DataFrame, langs: list[str], table: np.ndarray, id_col: str, text_col: str = "text",
             declared_col: str | None = None, suffix_col: str | None = None, host_col: str | None = None) -> DataFrame:
    """One row per row: id, declared, suffix, host, text_lang, lang, confidence (its posterior) and row_key.

    ``row_key`` is the hash of id and text, which tells rows with one id apart.
    """
    k = len(langs)
    named = {"declared": declared_col, "suffix": suffix_col, "host": host_col}
    base = df.select(F.col(id_col).alias("id"), F.xxhash64(id_col, text_col).alias("row_key"),
                     F.col(text_col).alias("body"),
                     *[(F.coalesce(F.nullif(F.lower(F.trim(F.col(c).cast("string"))), F.lit("")), F.lit("-"))
                        if c else F.lit("-")).alias(name) for name, c in named.items()])
    rows = text_likelihoods(base, table, ["id", "row_key", "declared", "suffix", "host"], "body")
    flat = F.array(*[F.lit(0.0 if lang != UND else float(np.log(UND_PRIOR))) for lang in langs])
    rows = written(rows.select("*", _normalised(F.zip_with("ll", flat, lambda a, b: a + b)).alias("post")),
                   "language-likelihoods")

    def counts(*keys: str) -> DataFrame:
        return rows.groupBy(*keys).agg(F.array(*[F.sum(F.get("post", F.lit(i))) for i in range(k)]).alias("c"))

    total = (counts().first() or {"c": None})["c"]
    total = np.array([x or 0.0 for x in total]) + 0.5
    share = F.array(*[F.lit(float(x)) for x in total / total.sum()])
    by_suffix = counts("suffix").select("suffix", F.zip_with("c", share, lambda c, p: c + p * SUFFIX_WEIGHT).alias("cs"))
    by_suffix = by_suffix.select("suffix", F.transform("cs", lambda x: x / F.aggregate(
        "cs", F.lit(0.0), lambda s, y: s + y)).alias("p_suffix"))
    by_host = counts("host").select("host", F.col("c").alias("c_host"))
    # P(declared | language), with the declaration's overall share as the smoothing base
    n_all = float(total.sum())
    lang_total = F.array(*[F.lit(float(x)) for x in total])
    by_declared = counts("declared").select("declared", F.col("c").alias("cd"), F.aggregate(
        "c", F.lit(0.0), lambda s, y: s + y).alias("nd"))
    by_declared = by_declared.select("declared", F.zip_with("cd", lang_total, lambda c, t: F.log(
        (c + F.col("nd") / n_all * DECLARED_WEIGHT + 1e-6) / (t + DECLARED_WEIGHT))).alias("l_declared"))

    joined = rows.join(by_suffix, "suffix").join(by_declared, "declared").join(by_host, "host")
    own = F.zip_with("c_host", "post", lambda c, p: F.greatest(c - p, F.lit(0.0)))
    prior = F.zip_with(own, "p_suffix", lambda c, p: F.log(c + p * HOST_WEIGHT))
    evidence = F.zip_with(F.zip_with(prior, "l_declared", lambda a, b: a + b), "ll", lambda a, b: a + b)
    names = F.array(*[F.lit(x) for x in langs])
    best = lambda a: F.get(names, (F.array_position(a, F.array_max(a)) - 1).cast("int"))
    fused = joined.select("id", "row_key", "declared", "suffix", "host", best(F.col("post")).alias("text_lang"),
                          _normalised(evidence).alias("p"))
    return fused.select(F.col("id").alias(id_col), "declared", "suffix", "host", "text_lang",
                        best(F.col("p")).alias("lang"), F.array_max("p").alias("confidence"), "row_key")


# --- pages -----------------------------------------------------------------------------------------------
_SILENT = re.compile(r"<(script|style|nav|noscript|template|head|footer|aside)\b.*?</\1\s*>|<!--.*?-->", re.S | re.I)
_MAIN = re.compile(r"<(article|main)\b[^>]*>(.*?)</\1\s*>", re.S | re.I)
_TAG = re.compile(r"<[^>]*>")


def visible_text(html: str | None) -> str:
    """Text of the article or main element if there is one, else of the body, without tags."""
    from html import unescape
    html = html or ""
    main = "\n".join(m[2] for m in _MAIN.finditer(html))
    return unescape(_TAG.sub(" ", _SILENT.sub(" ", main or html)))


def page_evidence(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, body text, declared language (html lang, else content-language), address suffix and host of each page."""
    host = F.lower(F.regexp_extract(F.col(url_col), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1))
    lang = F.regexp_extract(F.col(html_col), r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]{2,3})\b", 1)
    meta = F.regexp_extract(F.col(html_col), r"(?i)<meta\b[^>]*content-language[^>]*content\s*=\s*[\"']?([A-Za-z]{2,3})\b", 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = pa.array([visible_text(h) for h in batch.column(4).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], text], names=["id", "declared", "suffix", "host", "body"])

    id_type = pages.schema[id_col].dataType.simpleString()
    return pages.select(
        F.col(id_col).alias("id"), F.when(lang != "", lang).otherwise(meta).alias("declared"),
        F.regexp_extract(host, r"\.([a-z]{2,24})$", 1).alias("suffix"), host.alias("host"),
        F.col(html_col).alias("html")).mapInArrow(
            run, f"id {id_type}, declared string, suffix string, host string, body string")


def identify_pages(pages: DataFrame, training: DataFrame, id_col: str = "page_id", url_col: str = "url",
                   html_col: str = "html") -> DataFrame:
    """Languages of web pages, with text profiles learnt from ``training`` (text, lang)."""
    langs, table = profiles(training)
    evidence = page_evidence(pages, id_col, url_col, html_col)
    return identify(evidence, langs, table, "id", "body", "declared", "suffix", "host").withColumnRenamed("id", id_col)


def identify_documents(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Languages of documents: ``lang`` is their declaration, ``source`` their host."""
    langs, table = profiles(docs)
    return identify(docs, langs, table, id_col, "text", "lang", None, "source")


def rejected(identified: DataFrame, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """Rows without a language of sufficient confidence."""
    return identified.filter((F.col("lang") == UND) | (F.col("confidence") < min_confidence))
