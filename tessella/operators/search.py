"""Search over chunks: exact vectors, words, their fusion by rank, recency, reranking and propagation over the graph."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.text import cosine, dot, hours_to_days, norm, strip, terms, vector

K1, B, RRF = 1.2, 0.75, 60
#: Most rows of a result list; fused lists and what is joined to them are at most a few times as long.
MOST = 10_000
#: Links, and relations, of a result list's entities that are held on the driver at most.
MOST_LINKS = 100_000


def scoped(chunks: DataFrame, wing: str | None = None, room: str | None = None, after: str | None = None, before: str | None = None) -> DataFrame:
    """Chunks of a wing and room, created in [after, before); all of it reaches the scan."""
    for name, value in (("wing", wing), ("room", room)):
        chunks = chunks.filter(F.col(name) == value) if value is not None else chunks
    chunks = chunks.filter(F.col("created_at") >= F.lit(after).cast("timestamp")) if after else chunks
    return chunks.filter(F.col("created_at") < F.lit(before).cast("timestamp")) if before else chunks


def vector_search(rows: DataFrame, query: Sequence[float], k: int = 20, key: str = "chunk_id", embedding: str = "embedding") -> DataFrame:
    """The k rows most like the query by cosine, ties by id; rows without a vector, or of another size, are passed over.

    One pass and a top-k: each task sends k rows on.
    """
    q = [float(x) for x in query]
    length = sum(x * x for x in q) ** 0.5
    e = F.col(embedding)
    known = rows.filter(e.isNotNull() & (F.size(e) == len(q)))
    score = dot(e, vector(q), len(q)) / (norm(e, len(q)) * F.lit(length))
    return known.withColumn("score", score).drop(embedding).orderBy(F.desc("score"), key).limit(k)


def keyword_search(chunks: DataFrame, query: str, k: int = 20, key: str = "chunk_id", text: str = "chunk_text", with_text: bool = True) -> DataFrame:
    """The k chunks with all query words that are best by BM25, ties by id.

    For chunks without an index (see index.Index): two passes over the texts. The corpus statistics (chunks, mean length,
    chunks that have each word) are one row, made by partial aggregation when this is called; nothing is shuffled.
    """
    words = query_words(query)
    if not words:
        return chunks.withColumn("score", F.lit(0.0)).limit(0)
    given = chunks.select(F.struct(*chunks.columns).alias("row"), terms(F.col(text)).alias("t"))
    counted = given.select("row", F.size("t").alias("n"), *(F.size(F.filter("t", _is(w))).alias(f"f{i}") for i, w in enumerate(words)))
    stats = counted.agg(F.count("*").alias("total"), F.avg("n").alias("mean"), *(F.count_if(F.col(f"f{i}") > 0).alias(f"d{i}") for i in range(len(words)))).first()
    score = F.lit(0.0)
    for i in range(len(words)):
        f, d = F.col(f"f{i}"), stats[f"d{i}"]
        idf = math.log(1 + (stats["total"] - d + 0.5) / (d + 0.5))
        score = score + F.lit(idf) * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("n") / F.lit(stats["mean"])))
    hits = counted.filter(" and ".join(f"f{i} > 0" for i in range(len(words))))
    kept = [c for c in chunks.columns if with_text or c != text]
    return hits.select(*(F.col("row")[c].alias(c) for c in kept), score.alias("score")).orderBy(F.desc("score"), key).limit(k)


def _is(word: str) -> Callable[[Column], Column]:
    return lambda x: x == word


def _words(query: str) -> list[str]:
    return [w for w in "".join(c if c.isalnum() else " " for c in query.lower()).split() if w]


def query_words(query: str) -> list[str]:
    """A query's different words, sorted."""
    return sorted(set(_words(query)))


def listed(results: DataFrame) -> DataFrame:
    """A result list as rows of the plan, so that what uses it more than once does not search again.

    Lists are made by limit() with at most MOST rows; longer ones are refused.
    """
    rows = results.limit(MOST + 1).collect()
    if len(rows) > MOST:
        raise ValueError("a result list has at most MOST rows")
    return results.sparkSession.createDataFrame(rows, results.schema)


def held(rows: DataFrame, most: int = MOST_LINKS) -> DataFrame:
    """Rows as part of the plan if there are at most `most`, else as they are: the same rows, made once or each time."""
    some = rows.limit(most + 1).collect()
    return rows if len(some) > most else rows.sparkSession.createDataFrame(some, rows.schema)


def fuse(vectors: DataFrame, words: DataFrame, k: int = 20, rrf: int = RRF, boost: Column | None = None, key: str = "chunk_id") -> DataFrame:
    """Reciprocal rank fusion of two result lists with `score`; an absent rank is the list's length plus one.

    `boost` multiplies a fused score, from the columns of either list. Both lists are short (see MOST).
    """

    def ranked(df: DataFrame, name: str) -> DataFrame:
        return df.select(key, F.row_number().over(Window.orderBy(F.desc("score"), key)).alias(name))

    other = [c for c in vectors.columns if c in words.columns and c not in (key, "score")]
    seen = vectors.select(key, *other).unionByName(words.select(key, *other)).dropDuplicates([key])
    sizes = vectors.agg(F.count("*").alias("nv")).crossJoin(words.agg(F.count("*").alias("nw")))
    both = ranked(vectors, "rv").join(ranked(words, "rw"), key, "full_outer").crossJoin(F.broadcast(sizes))
    score = 1 / (rrf + F.coalesce("rv", F.col("nv") + 1)) + 1 / (rrf + F.coalesce("rw", F.col("nw") + 1))
    out = both.select(key, "rv", "rw", score.alias("score")).join(seen, key)
    out = out if boost is None else out.withColumn("score", F.col("score") * boost)
    return out.orderBy(F.desc("score"), key).limit(k)


def recency(now: str, days: Column | int = 7, weight: float = 1.5, stale_days: int | None = None, stale_penalty: float = 1.0) -> Column:
    """Factor for rows created at most `days` before now, and, if wanted, for those older than `stale_days`."""
    days = F.lit(days) if isinstance(days, int) else days
    t = F.lit(now).cast("timestamp")
    out = F.when(F.col("created_at") >= t - F.make_dt_interval(days), F.lit(weight))
    if stale_days is not None:
        out = out.when(F.col("created_at") < t - F.make_dt_interval(F.lit(stale_days)), F.lit(stale_penalty))
    return out.otherwise(F.lit(1.0))


@dataclass
class Request:
    query: str
    embedding: Sequence[float] | None = None
    top_k: int = 20
    wing: str | None = None
    room: str | None = None
    after: str | None = None
    before: str | None = None
    temporal_boost: bool = False
    recent_days: int = 7
    recent_weight: float = 1.5
    now: str = "2024-01-31 00:00:00"
    hybrid: bool = True


def search(chunks: DataFrame, embeddings: DataFrame, r: Request, index=None) -> DataFrame:
    """Hybrid search, or vector search alone, as the request says; each list is twice as long as the result.

    With an index (index.Index over the same chunks) no text is read.
    """
    if r.top_k * 2 > MOST:
        raise ValueError("result lists are for reading, not for exports")
    scope = {"wing": r.wing, "room": r.room, "after": r.after, "before": r.before}
    rows = scoped(chunks, **scope)
    places = rows.drop("chunk_text", "token_count") if index is None else scoped(index.places, **scope).drop("terms")
    vectors = vector_search(places.join(embeddings.select("chunk_id", "embedding"), "chunk_id"), r.embedding, 2 * r.top_k) if r.embedding is not None else places.withColumn("score", F.lit(0.0)).limit(0)
    if not r.hybrid:
        return vectors.limit(r.top_k)
    words = keyword_search(rows, r.query, 2 * r.top_k, with_text=False).drop("token_count") if index is None else index.keyword_search(r.query, 2 * r.top_k, **scope)
    return fuse(listed(vectors), listed(words), r.top_k, boost=recency(r.now, r.recent_days, r.recent_weight) if r.temporal_boost else None)


def wake(chunks: DataFrame, embeddings: DataFrame, query: str, embedding: Sequence[float], hours: int = 48, wing: str | None = None, now: str = "2024-01-31 00:00:00", index=None) -> DataFrame:
    """What to know after so many hours: ten results with recent ones favoured."""
    return search(chunks, embeddings, Request(query, embedding, 10, wing, temporal_boost=True, recent_days=hours // 24 + 1, now=now), index)


def rerank(results: DataFrame, query: str, scorer: Callable[[str, list[str]], list[float] | None], k: int, passages: int = 10, chars: int = 200) -> DataFrame:
    """Orders the first `passages` results by a scorer's answers (0 to 10), the others after them as if they had 10.

    A scorer that fails or answers for another number of passages leaves the order as it is.
    """
    order = Window.orderBy(F.desc("score"), "chunk_id")
    results = listed(results)  # at most MOST rows
    first = results.withColumn("place", F.row_number().over(order)).withColumn("passage", F.substring("chunk_text", 1, chars))

    def run(frames):
        pdf = pd.concat(list(frames)).sort_values("place", kind="stable")
        try:
            given = scorer(query, pdf["passage"].head(passages).tolist())
            if given is None or len(given) != min(passages, len(pdf)):
                raise ValueError("no score for each passage")
            pdf["rerank"] = [x / 10 for x in given] + [1.0] * (len(pdf) - len(given))
        except Exception:
            pdf["rerank"] = 0.0
        yield pdf[["chunk_id", "place", "rerank", "score"]]

    return first.select("chunk_id", "place", "passage", "score").coalesce(1).mapInPandas(run, "chunk_id long, place int, rerank double, score double").orderBy(F.desc("rerank"), "place").limit(k)


def rerank_all(results: DataFrame, query: str, scorer: Callable[[str, list[str]], list[float] | None], k: int, chars: int = 500) -> DataFrame:
    """Orders all results by a scorer's answers on their first characters; a scorer that fails leaves the order as it is."""
    return rerank(results, query, scorer, k, passages=MOST, chars=chars)


def word_overlap(query: str, passages: list[str]) -> list[float]:
    """A scorer without a model: ten times the share of query words in a passage."""
    q = set(_words(query))
    return [10 * len(q & set(_words(p))) / max(1, len(q)) for p in passages]


def page_rank(vertices: DataFrame, edges: DataFrame, iterations: int = 3, damping: float = 0.85, keep: Callable[[DataFrame, str], DataFrame] | None = None) -> DataFrame:
    """(id, rank) after some rounds over undirected distinct neighbours; the base is 1 - damping, the start 1 / N.

    Vertices without neighbours get the base. Each round is a join and a sum by vertex. `keep` writes a table and reads
    it back, so that the edges are made once.
    """
    near = edges.select(F.col("source").alias("a"), F.col("target").alias("b")).filter("a <> b")
    near = near.union(near.select("b", "a")).distinct()
    near = near.join(vertices.select(F.col("id").alias("a")), "a", "left_semi").join(vertices.select(F.col("id").alias("b")), "b", "left_semi").select("a", "b")
    near = near if keep is None else keep(near, "near")  # read in every round
    degree = near.groupBy("a").agg(F.count("*").alias("degree"))
    n = vertices.agg(F.count("*").alias("n"))
    rank = vertices.select("id").crossJoin(F.broadcast(n)).select("id", (1 / F.col("n")).alias("rank"))
    for _ in range(iterations):
        sent = near.join(degree, "a").join(rank.withColumnRenamed("id", "a"), "a").select("b", (F.col("rank") / F.col("degree")).alias("part"))
        got = sent.groupBy(F.col("b").alias("id")).agg(F.sum("part").alias("sum"))
        rank = vertices.select("id").join(got, "id", "left").select("id", (F.lit(1 - damping) + damping * F.coalesce("sum", F.lit(0.0))).alias("rank"))
    return rank


def propagate(results: DataFrame, links: DataFrame, relations: DataFrame, k: int, entity: float = 0.3, relation: float = 0.2, iterations: int = 3, damping: float = 0.85) -> DataFrame:
    """Results (chunk_id, score) re-scored by the entities they share: links (chunk_id, entity), relations (source, target).

    Only the links of the result's chunks and the relations among their entities are read on; where those are few, they
    are put into the plan as rows.
    """
    results = listed(results)
    own = held(links.filter(F.col("chunk_id").isin([r["chunk_id"] for r in results.select("chunk_id").collect()])).select("chunk_id", "entity").distinct())
    ids = own.select("entity").distinct()
    among = relations.select("source", "target").join(ids.withColumnRenamed("entity", "source"), "source", "left_semi").join(ids.withColumnRenamed("entity", "target"), "target", "left_semi").distinct()
    relations = held(among)
    shared = own.groupBy("entity").agg(F.countDistinct("chunk_id").alias("n"))
    boosts = own.join(shared, "entity").groupBy("chunk_id").agg(F.max(1 + (F.col("n") - 1) * 0.1).alias("boost"))
    ranks = page_rank(shared.select(F.col("entity").alias("id")), relations, iterations, damping)
    top = ranks.agg(F.max("rank").alias("top"))
    scaled = ranks.crossJoin(F.broadcast(top)).select(F.col("id").alias("entity"), F.when(F.col("top") > 0, F.col("rank") / F.col("top")).otherwise(F.lit(0.0)).alias("rank"))
    means = own.join(scaled, "entity").groupBy("chunk_id").agg(F.avg("rank").alias("mean"))
    out = results.join(boosts, "chunk_id", "left").join(means, "chunk_id", "left").withColumns({"boost": F.coalesce("boost", F.lit(1.0)), "mean": F.coalesce("mean", F.lit(0.0))})
    combined = F.col("score") * (1 - entity - relation) + relation * F.col("mean") * F.col("boost") + entity * (F.col("boost") - 1)
    return out.withColumn("combined", combined).orderBy(F.desc("combined"), "chunk_id").limit(k)


def inverted_file(rows: DataFrame, cells: int = 16, rounds: int = 4, sample: int = 20_000, key: str = "chunk_id") -> tuple[DataFrame, list[list[float]]]:
    """Assigns each vector to the nearest of some centres, fitted on a bounded sample: (rows with `cell`, centres)."""
    import numpy as np

    fitted = rows.select("embedding", key).orderBy(F.xxhash64(key)).limit(sample)
    x = np.array([r[0] for r in fitted.collect()], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    centres = x[: min(cells, len(x))].copy()
    for _ in range(rounds):
        cell = (x @ centres.T).argmax(1)
        for i in range(len(centres)):
            if (cell == i).any():
                centres[i] = x[cell == i].mean(0)
                centres[i] /= np.linalg.norm(centres[i])
    scores = F.array(*(dot(F.col("embedding"), vector(c)) for c in centres.tolist()))  # not unrolled: so many would not compile as one method
    return rows.withColumn("__s", scores).withColumn("cell", F.array_position("__s", F.array_max("__s")) - 1).drop("__s"), centres.tolist()


def inverted_search(indexed: DataFrame, centres: list[list[float]], query: Sequence[float], k: int = 20, probes: int = 4) -> DataFrame:
    """Vector search in the `probes` cells nearest to the query; with the index written by cell, other cells are not read."""
    order = sorted(range(len(centres)), key=lambda i: -sum(a * b for a, b in zip(centres[i], query)))
    return vector_search(indexed.filter(F.col("cell").isin(*order[:probes])), query, k).drop("cell")


def inverted_search_all(indexed: DataFrame, centres: list[list[float]], queries: DataFrame, k: int = 20, probes: int = 4, key: str = "chunk_id", block: int = 20_000) -> DataFrame:
    """The k rows most like each query (query_id, embedding) by cosine, ties by id: (query_id, key, score), the same as without an index.

    The `probes` nearest cells give a k-th best score; then every other cell is searched that could still hold a better
    row: none is closer to the query than the angle to the cell's centre less the cell's widest angle. A cell of more
    than `block` rows is dealt to several tasks; each returns k rows for a query at most.
    """
    import numpy as np
    import pyarrow as pa

    fields, kind = f"query_id long, {key} long, score double", "embedding array<double>"
    c = np.array(centres, float).reshape(len(centres), -1)

    def unit(column: pa.ChunkedArray) -> np.ndarray:
        x = np.array(column.to_pylist(), float).reshape(len(column), -1)
        return x / np.linalg.norm(x, axis=1, keepdims=True)

    def angle(cos: np.ndarray) -> np.ndarray:
        return np.arccos(np.clip(cos, -1, 1))

    def widths(batches):
        for b in batches:
            cell = b.column(0).to_numpy().astype(np.int64)
            yield pa.RecordBatch.from_pydict({"cell": cell, "width": angle((unit(b.column(1)) * c[cell]).sum(1)), "n": np.ones(len(cell), np.int64)})

    known = lambda df: df.filter(F.col("embedding").isNotNull() & (F.size("embedding") == c.shape[1])).withColumn("embedding", F.col("embedding").cast("array<double>"))
    rows = known(indexed).select(F.col(key).cast("long").alias(key), F.col("cell").cast("long").alias("cell"), "embedding")
    # one row a cell
    cells = {r.cell: r for r in rows.select("cell", "embedding").mapInArrow(widths, "cell long, width double, n long").groupBy("cell").agg(F.max("width").alias("width"), F.sum("n").alias("n")).collect()}
    held = sorted(cells)
    if not held:
        return queries.sparkSession.createDataFrame([], fields)
    width, blocks = np.array([cells[i].width for i in held]), {i: -(-cells[i].n // block) for i in held}

    def reach(batches):
        for b in batches:
            if not len(b):
                continue
            away = angle(unit(b.column(1)) @ c[held].T)
            place = away.argsort(1).argsort(1)
            best = np.cos(np.maximum(away - width, 0))
            n, at = len(b), np.repeat(np.arange(len(b)), len(held))
            yield pa.RecordBatch.from_pydict({"query_id": b.column(0).take(pa.array(at)), "embedding": b.column(1).take(pa.array(at)), "cell": np.tile(np.array(held, np.int64), n), "place": place.ravel().astype(np.int64), "best": best.ravel()})

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        found = {"query_id": [], key: [], "score": []}
        if left.num_rows and right.num_rows:
            ids, x = left.column(key).to_numpy(), unit(left.column("embedding"))
            for q, v in zip(right.column("query_id").to_pylist(), unit(right.column("embedding"))):
                s = x @ v
                first = np.lexsort((ids, -s))[:k]
                found["query_id"] += [q] * len(first)
                found[key] += ids[first].tolist()
                found["score"] += s[first].tolist()
        return pa.table(found, schema=pa.schema([("query_id", pa.int64()), (key, pa.int64()), ("score", pa.float64())]))

    of = F.element_at(F.create_map(*(F.lit(x) for i in held for x in (i, blocks[i]))), F.col("cell"))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64(key), of))

    def searched(asked: DataFrame) -> DataFrame:
        spread = asked.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), of.cast("long") - 1)))
        return dealt.groupBy("cell", "block").cogroup(spread.groupBy("cell", "block")).applyInArrow(score, fields)

    def best(found: DataFrame) -> DataFrame:
        return found.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), key))).filter(F.col("place") <= k)

    asked = known(queries).select(F.col("query_id").cast("long").alias("query_id"), "embedding").mapInArrow(reach, f"query_id long, {kind}, cell long, place long, best double")
    near = best(searched(asked.filter(F.col("place") < probes)))
    least = near.filter(F.col("place") == k).select("query_id", F.col("score").alias("least"))
    # rounding must not close a cell
    far = asked.filter(F.col("place") >= probes).join(least, "query_id", "left").filter(F.col("least").isNull() | (F.col("best") >= F.col("least") - 1e-9)).drop("least")
    return best(near.drop("place").union(searched(far))).drop("place")


__all__ = ["Request", "cosine", "fuse", "hours_to_days", "inverted_file", "inverted_search", "inverted_search_all", "keyword_search", "page_rank", "propagate", "recency", "rerank", "rerank_all", "scoped", "search", "strip", "vector_search", "wake", "word_overlap"]
