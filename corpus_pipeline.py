"""From raw documents to packed training sequences: five stages, each one operator of tessella.llm.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes what a stage returns as Parquet in the shared
folder and hands the table to the next. All stages but the last return the columns of documents, and further ones of any
name as they are. An empty table goes through all stages and gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import decontamination, langid, nearcopies, packing, secrets
from tessella.llm.common import keep_last, materialise, remainder, setup, table, written

#: Posterior probability that a document's language must have at least.
LANGUAGE_SCORE = 0.5
#: Jaccard similarity of the five-word shingles from which on two documents are near copies.
SIMILARITY = 0.8


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with a language: rejects texts without letters, of no learned language with enough probability, or
    that the best language explains no better than chance. Null and empty texts go; ids may be null or repeat."""
    setup(spark)
    return langid.keep(docs, langid.train(docs.filter(remainder(docs["doc_id"], 3) != 1)), LANGUAGE_SCORE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies (0.8 of the five-word shingles): that with the least doc_id, null
    ids last. Texts without words are copies of each other; of rows with the same id one stays, chosen by place."""
    setup(spark)
    return nearcopies.keep_similar(docs, SIMILARITY)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark passage. Null and empty texts hold none; each row is judged by itself."""
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secret_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in texts by a mark; n_chars follows. Null and empty texts stay so, and n_chars of a null text."""
    setup(spark)
    return secrets.redact(docs).withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into training sequences, a row for each piece; a null text is a document of its end id alone."""
    setup(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("benchmark_leaks", benchmark_leaks),
    ("secret_spans", secret_spans),
    ("sequences", sequences),
]

#: Classification, fingerprints and token ids are no SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, since = table(spark, sf_dir, "documents"), written()
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
        keep_last(spark, since)  # what the stage has read and made on the way
    return docs
