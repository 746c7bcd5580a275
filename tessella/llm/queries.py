"""The corpus operators' queries: each applies one operator to its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tessella.llm import decontamination, langid, lattice, packing, repetition, secrets, sequence_files, simhash, substrings, urls
from tessella.llm.common import remainder, table

TOKENIZER, PIECES = "word_bpe_49k.json", "piece_bpe_32k.model"


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, radius=4)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), similarity=0.8)


def op3_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.deduplicate(table(spark, sf_dir, "documents"), length=100)


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = remainder(docs["doc_id"], 3) == 1
    return langid.predict(docs, langid.train(docs.filter(~held_out)), held_out)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.quality(table(spark, sf_dir, "documents"))


def op6_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return lattice.score(docs, remainder(docs["doc_id"], 7) == 2, public_tokenizers.path(PIECES))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), end_id=1)


def op8_sequence_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence_files.write_and_read(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), end_id=1)


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op10_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_decontamination": op2_decontamination,
    "op3_substrings": op3_substrings,
    "op4_language": op4_language,
    "op5_quality": op5_quality,
    "op6_lattice": op6_lattice,
    "op7_packing": op7_packing,
    "op8_sequence_files": op8_sequence_files,
    "op9_secrets": op9_secrets,
    "op10_urls": op10_urls,
    "pipeline": pipeline,
}
ORACLES: dict[str, str] = {}
