"""A full-text index: postings by term and a few numbers of each chunk, written once, read by each query."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions.text import terms
from tessella.operators.search import B, K1, query_words, scoped

#: Folders that postings are dealt to by their term; a query reads those of its words.
BUCKETS = 64
PLACES = ["chunk_id", "page_id", "wing", "room", "created_at", "chunk_index"]


def places(chunks: DataFrame) -> DataFrame:
    """(place columns, terms) of each chunk: what a search needs to know of a chunk besides its postings."""
    return chunks.select(*PLACES, F.size(terms(F.col("chunk_text"))).cast("long").alias("terms"))


def postings(chunks: DataFrame, buckets: int = BUCKETS, parts: int | None = None) -> DataFrame:
    """(bucket, term, chunk_id, n, terms, wing, room, created_at): how often a term stands in a chunk of so many terms.

    Rows are sorted by bucket, term and chunk over all files, so a frequent term lies in several files and a query's
    filter on terms passes over most row groups. To be written with partition=["bucket"].
    """
    rows = chunks.select("chunk_id", "wing", "room", "created_at", terms(F.col("chunk_text")).alias("t"))
    each = rows.select("chunk_id", "wing", "room", "created_at", F.size("t").cast("long").alias("terms"), F.explode("t").alias("term"))
    counted = each.groupBy("term", "chunk_id", "wing", "room", "created_at", "terms").agg(F.count("*").alias("n"))
    placed = counted.select(bucket_of(F.col("term"), buckets).alias("bucket"), "term", "chunk_id", "n", "terms", "wing", "room", "created_at")
    order = ["bucket", "term", "chunk_id"]
    dealt = placed.repartitionByRange(parts, *order) if parts else placed.repartitionByRange(*order)
    return dealt.sortWithinPartitions(*order)


def bucket_of(term, buckets: int = BUCKETS):
    return F.pmod(F.crc32(term.cast("binary")), F.lit(buckets)).cast("int")


@dataclass
class Index:
    """Postings and places as stored; `make` and `store` say how they are made where they are not there yet."""

    places: DataFrame
    postings: DataFrame
    buckets: int = BUCKETS

    @classmethod
    def over(cls, chunks: DataFrame, store: Callable[..., DataFrame], buckets: int = BUCKETS) -> Index:
        """store(name, make, partition) -> DataFrame writes a table unless it is there."""
        return cls(store("places", lambda: places(chunks), ()), store("postings", lambda: postings(chunks, buckets), ("bucket",)), buckets)

    def keyword_search(self, query: str, k: int = 20, **scope: str | None) -> DataFrame:
        """The k chunks of the scope with all query words that are best by BM25, ties by id: (place columns, score).

        Reads the postings of the query's words and the numbers of chunks; no text. Statistics are those of the scope.
        """
        words = query_words(query)
        inside = scoped(self.places, **scope)
        if not words:
            return inside.drop("terms").withColumn("score", F.lit(0.0)).limit(0)
        from zlib import crc32

        buckets = sorted({crc32(w.encode()) % self.buckets for w in words})
        found = scoped(self.postings.filter(F.col("bucket").isin(buckets) & F.col("term").isin(words)), **scope)
        total = inside.agg(F.count("*").alias("total"), F.avg("terms").alias("mean")).first()
        holding = {r["term"]: r["d"] for r in found.groupBy("term").agg(F.count("*").alias("d")).collect()}  # a row a word
        if len(holding) < len(words):
            return inside.drop("terms").withColumn("score", F.lit(0.0)).limit(0)
        score = F.lit(0.0)
        for i, w in enumerate(words):
            d = holding[w]
            idf = math.log(1 + (total["total"] - d + 0.5) / (d + 0.5))
            score = score + F.lit(idf) * F.col(f"f{i}") * (K1 + 1) / (F.col(f"f{i}") + K1 * (1 - B + B * F.col("terms") / F.lit(total["mean"])))
        counts = [F.sum(F.when(F.col("term") == w, F.col("n"))).alias(f"f{i}") for i, w in enumerate(words)]
        hits = found.groupBy("chunk_id", "terms").agg(*counts, F.count("*").alias("words")).filter(F.col("words") == len(words))
        best = hits.select("chunk_id", score.alias("score")).orderBy(F.desc("score"), "chunk_id").limit(k)
        return inside.drop("terms").join(F.broadcast(best), "chunk_id").orderBy(F.desc("score"), "chunk_id")  # k rows

    def matching(self, query: str) -> DataFrame:
        """(chunk_id, wing, room) of the chunks that hold all words."""
        words = query_words(query)
        from zlib import crc32

        found = self.postings.filter(F.col("bucket").isin(sorted({crc32(w.encode()) % self.buckets for w in words})) & F.col("term").isin(words))
        return found.groupBy("chunk_id", "wing", "room").agg(F.count("*").alias("words")).filter(F.col("words") == len(words)).drop("words")
