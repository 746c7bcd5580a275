"""The corpus as a hierarchy: wings (domains), rooms (topics), pages (files) and chunks, over a folder of tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators.chunking import chunk_lines
from tessella.operators.index import Index
from tessella.sources.store import stored

#: A chunk's id is its page's id times this, plus its index; a page of more chunks is refused (see chunk_id).
CHUNKS_IN_PAGE = 1_000_000


def chunk_id(page: Column, index: Column) -> Column:
    """Ids that never meet: the query fails on a page of more than CHUNKS_IN_PAGE chunks."""
    return F.when(index < CHUNKS_IN_PAGE, page * CHUNKS_IN_PAGE + index).otherwise(F.raise_error(F.lit("a page of more than CHUNKS_IN_PAGE chunks")).cast("long"))


@dataclass
class Corpus:
    """Views on the documents: language is the wing, source the room; texts carry no time, so an hour each is given."""

    spark: SparkSession
    sf_dir: str
    max_lines: int = 5

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @property
    def pages(self) -> DataFrame:
        docs = self.table("documents")
        return docs.select(F.col("doc_id").alias("page_id"), F.col("lang").alias("wing"), F.col("source").alias("room"), F.timestamp_seconds(F.unix_timestamp(F.lit("2024-01-01 00:00:00").cast("timestamp")) + F.col("doc_id") * 3600).alias("created_at"), "text", "n_chars")

    @property
    def chunks(self) -> DataFrame:
        out = chunk_lines(self.pages, "text", self.max_lines)
        return out.select(chunk_id(F.col("page_id"), F.col("chunk_index")).alias("chunk_id"), "page_id", "wing", "room", "created_at", "chunk_index", "chunk_text", "token_count")

    def store(self, name: str, make: Callable[[], DataFrame], partition: tuple[str, ...] = (), of: tuple[str, ...] = ("documents",)) -> DataFrame:
        """A table made of the folder's tables `of`, written once."""
        return stored(self.spark, [f"{self.sf_dir}/{t}.parquet" for t in of], f"{name}-{self.max_lines}", make, partition)

    @property
    def stored_chunks(self) -> DataFrame:
        return self.store("chunks", lambda: self.chunks)

    @property
    def index(self) -> Index:
        return Index.over(self.stored_chunks, self.store)

    @property
    def embeddings(self) -> DataFrame:
        """(chunk_id, embedding) of the first chunks of those pages that have a vector."""
        return self.table("embeddings").select((F.col("vec_id") * CHUNKS_IN_PAGE).alias("chunk_id"), F.col("vec_id").alias("page_id"), "embedding")


def hierarchy(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Wings (wing) and rooms (wing, room) that pages belong to."""
    rooms = pages.select("wing", "room").distinct()
    return rooms.select("wing").distinct(), rooms


def migrate(pages: DataFrame, chunks: DataFrame, wing_room) -> tuple[DataFrame, DataFrame]:
    """Pages (id, source_path, ...) with the wing and room that `wing_room` gives, and their chunks by the real page id."""
    moved = pages.withColumn("place", wing_room(F.col("source_path"))).select("*", F.col("place.wing").alias("wing"), F.col("place.room").alias("room")).drop("place")
    return moved, chunks.join(moved.select(F.col("id").alias("page_id")), "page_id", "left_semi")

