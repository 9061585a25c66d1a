"""The corpus pipeline: documents in, packed training sequences out.

``STAGES`` lists the stages in order; each takes (spark, docs, sf_dir) and
returns a DataFrame, which is written as Parquet and read again as the next
stage's documents.  All but the last return the columns of the documents, and
any further columns as they are.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from demandspark.llm import jaccard, language, line_dedup, packing, quality
from demandspark.llm.common import without, written
from demandspark.sources.fixtures import read_table

#: A quadratic discriminant over document statistics has no SQL form.  tests/llm/test_pipeline.py holds the third and
#: fourth stage's rows against brute force, the first two against their operators' own results, the last by its ids.
ORACLE_SQL = None


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the quality classifier rejects."""
    features = written(quality.document_statistics(docs), "quality-features")
    model = quality.train(features, read_table(spark, sf_dir, "labels"))
    return quality.keep(docs, model)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents without an identifiable language."""
    return without(docs, language.rejected(language.identify_documents(docs)))


def unique_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove later occurrences of three-line windows, and documents of which no line is left.

    ``n_chars`` follows the text.
    """
    prefix = max(docs.columns, key=len) + "_"
    out = line_dedup.dedup_lines(docs, prefix=prefix)
    removed = F.col(f"`{prefix}n_removed`")
    out = out.filter((removed < F.col(f"`{prefix}n_lines`")) | (removed == 0))
    n_chars = F.char_length("text").cast(docs.schema["n_chars"].dataType)
    return out.withColumn("n_chars", F.when(removed > 0, n_chars).otherwise(F.col("n_chars"))).select(
        *[f"`{c}`" for c in docs.columns])


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document, that of the least id, of each group of near duplicates."""
    return without(docs, jaccard.surplus(jaccard.near_duplicate_classes(docs)))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the documents into sequences of 4096 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_classifier", good_quality),
    ("language_id", known_language),
    ("line_dedup", unique_lines),
    ("jaccard_join", one_of_each),
    ("best_fit_packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents of ``sf_dir``."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
