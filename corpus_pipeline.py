"""From raw documents to packed sequences (counted as part of marlinspike.llm).

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept,
and returns a DataFrame that is written as Parquet and read again as the next
stage's documents.  All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marlinspike.llm import decontaminate, ngram_jaccard, packing, pii, quality_classifier
from marlinspike.llm.shared import Scratch, prepare, table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the quality classifier rejects."""
    prepare(spark)
    return quality_classifier.keep_good(docs, table(spark, sf_dir, "labels"))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each group of near duplicates."""
    prepare(spark)
    return ngram_jaccard.keep_first(docs, ngram_jaccard.jaccard_components(docs))


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a passage of the benchmark."""
    prepare(spark)
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Put the kind of personal data in its place."""
    return pii.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokenise and pack what is left."""
    prepare(spark)
    return packing.pack(docs)


STAGES = [
    ("quality_classifier", keep_good),
    ("ngram_jaccard", keep_one_of_each),
    ("decontamination", keep_uncontaminated),
    ("pii", redact),
    ("packing", pack),
]

#: SQL expresses neither the classifiers nor the tokenizer; the pipeline is tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for number, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = scratch.write(docs, name)
    return docs
