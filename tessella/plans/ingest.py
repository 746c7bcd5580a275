"""Queries on sources and sinks: files, pushed documents, settings, upserts of the catalog and streams of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import catalog, chunking
from tessella.plans.corpus import CHUNKS, PAGES, corpus
from tessella.plans.fixtures import TABLES, cte, frame
from tessella.sources import files
from tessella.sources.corpus import hierarchy
from tessella.sources.store import scratch
from tessella.streaming import events as streams


def mine_inline(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = [(f"src/f{i}{ext}", text) for i, ext, text in TABLES["fx_code"][1]]
    return files.mined(files.inline(spark, documents)).select("path", "strategy", "slug", F.col("chunk_index").cast("long").alias("chunk_index"), F.col("token_count").cast("long").alias("token_count"))


def mine_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = corpus(spark, sf_dir).table("documents").select(F.concat(F.lit("corpus/"), "lang", F.lit("/"), "doc_id", F.lit(".txt")).alias("path"), "text")
    rows = docs.withColumn("strategy", F.lit("lines"))
    return chunking.chunk_lines(rows, "text", 5).groupBy("path").agg(F.count("*").alias("chunks"), F.sum("token_count").alias("tokens"))


def wings_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = corpus(spark, sf_dir)
    wings, _ = hierarchy(c.pages)
    have = spark.createDataFrame([(1, "en"), (2, "nl")], "id long, name string")
    return catalog.get_or_create(have, wings.withColumnRenamed("wing", "name"), ["name"]).select("name", F.col("id").isin(1, 2).alias("kept"))


def rooms_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, rooms = hierarchy(corpus(spark, sf_dir).pages)
    have = rooms.limit(0).select(F.lit(0).cast("long").alias("id"), "wing", "room")
    return catalog.get_or_create(have, rooms, ["wing", "room"]).select("wing", "room")


def agents_registered(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = corpus(spark, sf_dir).table("conversations")
    seen = turns.select(F.col("role").alias("agent_id"), F.concat(F.lit("agent-"), "role").alias("wing"), F.lit("memory").alias("room"), F.struct("conv_id", "turn").alias("seq"))
    have = spark.createDataFrame([("user", "old", "old"), ("robot", "agent-robot", "memory")], "agent_id string, wing string, room string")
    return catalog.upsert(have, seen, ["agent_id"], "seq").select("agent_id", "wing", "room")


def described(spark: SparkSession, sf_dir: str) -> DataFrame:
    entities = frame(spark, "fx_entities").select("id", "name", F.map_filter(F.create_map(F.lit("mode"), "mode", F.lit("status"), "status"), lambda k, v: v.isNotNull()).alias("metadata"))
    new = spark.createDataFrame([(1, "serves orders"), (2, "")], "id long, description string")
    out = catalog.merge_description(entities, new)
    return catalog.missing_description(out).select("id", "name")


def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as a stream of files: each batch is chunked and appended under its number, so a repeated one replaces itself."""
    folder = scratch(spark, "ingest")
    docs = spark.readStream.schema("doc_id long, text string, lang string, source string, n_chars long").parquet(f"{sf_dir}/document[s].parquet")

    def upsert(batch: DataFrame, number: int) -> None:
        chunking.chunk_lines(batch.select("doc_id", "text"), "text", 5).select("doc_id", "chunk_index", "token_count").write.mode("overwrite").parquet(f"{folder}/chunks/batch={number}")

    streams.ingest(docs, upsert, f"{folder}/checkpoint")
    return spark.read.parquet(f"{folder}/chunks").groupBy("doc_id").agg(F.count("*").alias("chunks"), F.sum("token_count").alias("tokens"))


QUERIES = {f.__name__: f for f in (mine_inline, mine_documents, wings_upsert, rooms_upsert, agents_registered, described, stream_ingest)}
ORACLES = {
    "mine_documents": f"WITH {CHUNKS} SELECT 'corpus/' || wing || '/' || page_id || '.txt' AS path, count(*) AS chunks, sum(token_count)::BIGINT AS tokens FROM chunks GROUP BY wing, page_id",
    "wings_upsert": f"WITH {PAGES} SELECT name, name IN ('en', 'nl') AS kept FROM (SELECT DISTINCT wing AS name FROM pgs UNION SELECT unnest(['en', 'nl']))",
    "rooms_upsert": f"WITH {PAGES} SELECT DISTINCT wing, room FROM pgs",
    "agents_registered": "SELECT DISTINCT role AS agent_id, 'agent-' || role AS wing, 'memory' AS room FROM conversations UNION SELECT 'robot', 'agent-robot', 'memory'",
    "described": f"WITH {cte('fx_entities')} SELECT id, name FROM fx_entities WHERE id <> 1",
    "stream_ingest": f"WITH {CHUNKS} SELECT page_id AS doc_id, count(*) AS chunks, sum(token_count)::BIGINT AS tokens FROM chunks GROUP BY page_id",
}
