"""Queries on the catalog, on chunking and on search."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import text as X
from tessella.operators import catalog, chunking, search
from tessella.operators.search import Request
from tessella.plans.fixtures import cte, frame
from tessella.sources.corpus import Corpus, migrate

NOW, WORDS, AFTER, BEFORE = "2024-01-31 00:00:00", "the of", "2024-01-05 00:00:00", "2024-01-20 00:00:00"

PAGES = "pgs AS (SELECT doc_id AS page_id, lang AS wing, source AS room, TIMESTAMP '2024-01-01' + to_hours(doc_id) AS created_at, text, n_chars FROM documents)"
CHUNKS = (
    PAGES
    + r""",
rws AS (SELECT page_id, wing, room, created_at, string_split(text, chr(10)) AS l FROM pgs),
grp AS (SELECT *, unnest(range(0, CAST((len(l) - 1) // 5 + 1 AS BIGINT))) AS g FROM rws),
raw AS (SELECT page_id, wing, room, created_at, g, regexp_replace(array_to_string(l[g * 5 + 1 : g * 5 + 5], chr(10)), '^\s+|\s+$', '', 'g') AS chunk_text FROM grp),
chunks AS (SELECT page_id * 1000000 + row_number() OVER (PARTITION BY page_id ORDER BY g) - 1 AS chunk_id, page_id, wing, room, created_at, row_number() OVER (PARTITION BY page_id ORDER BY g) - 1 AS chunk_index, g * 5 + 1 AS start, chunk_text, length(chunk_text) // 4 + 1 AS token_count FROM raw WHERE chunk_text <> '')"""
)
CHUNKS_IN_SCOPE = CHUNKS.replace("chunks AS (", "every_chunk AS (") + f", chunks AS (SELECT * FROM every_chunk WHERE wing = 'en' AND created_at >= TIMESTAMP '{AFTER}' AND created_at < TIMESTAMP '{BEFORE}')"
EMBEDDED = "emb AS (SELECT vec_id * 1000000 AS chunk_id, vec_id AS page_id, embedding FROM embeddings)"
QUERY_VECTOR = "q AS (SELECT embedding AS qv FROM embeddings WHERE vec_id = 0)"
VECTORS = f"{EMBEDDED}, {QUERY_VECTOR}, vec AS (SELECT c.chunk_id, c.page_id, c.wing, c.room, c.created_at, c.chunk_index, list_cosine_similarity(e.embedding::DOUBLE[], q.qv::DOUBLE[]) AS score FROM chunks c JOIN emb e USING (chunk_id), q)"
TERMS = "tok AS (SELECT chunk_id, page_id, wing, room, created_at, list_filter(regexp_split_to_array(lower(chunk_text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS t FROM chunks)"
_bm = lambda f, d: f"ln(1 + (total - {d} + 0.5) / ({d} + 0.5)) * {f} * 2.2 / ({f} + 1.2 * (0.25 + 0.75 * n / a))"
BM25 = f"""{TERMS},
cnt AS (SELECT chunk_id, page_id, wing, room, created_at, len(t) AS n, len(list_filter(t, lambda x: x = 'of')) AS f0, len(list_filter(t, lambda x: x = 'the')) AS f1 FROM tok),
sts AS (SELECT count(*) AS total, avg(n) AS a, count(*) FILTER (f0 > 0) AS d0, count(*) FILTER (f1 > 0) AS d1 FROM cnt),
bm AS (SELECT chunk_id, page_id, wing, room, created_at, {_bm("f0", "d0")} + {_bm("f1", "d1")} AS score FROM cnt, sts WHERE f0 > 0 AND f1 > 0)"""


def rrf(boost: str = "1.0", k: int = 20) -> str:
    return f"""tv AS (SELECT *, row_number() OVER (ORDER BY score DESC, chunk_id) AS rv FROM vec QUALIFY rv <= {2 * k}),
tk AS (SELECT *, row_number() OVER (ORDER BY score DESC, chunk_id) AS rw FROM bm QUALIFY rw <= {2 * k}),
hyb AS (SELECT coalesce(tv.chunk_id, tk.chunk_id) AS chunk_id, coalesce(tv.wing, tk.wing) AS wing, coalesce(tv.room, tk.room) AS room, rv, rw,
 (1.0::DOUBLE / (60 + coalesce(rv, (SELECT count(*) FROM tv) + 1)) + 1.0::DOUBLE / (60 + coalesce(rw, (SELECT count(*) FROM tk) + 1))) * CASE WHEN coalesce(tv.created_at, tk.created_at) >= {boost} THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END AS score
 FROM tv FULL OUTER JOIN tk ON tv.chunk_id = tk.chunk_id ORDER BY score DESC, chunk_id LIMIT {k})"""


NEVER = "TIMESTAMP '9999-01-01'"


def corpus(spark: SparkSession, sf_dir: str) -> Corpus:
    return Corpus(spark, sf_dir)


def query_vector(c: Corpus) -> list[float]:
    return list(c.table("embeddings").filter("vec_id = 0").first()["embedding"])


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


# catalog


def stats_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = corpus(spark, sf_dir)
    return catalog.totals(c.pages, c.stored_chunks, c.embeddings.join(c.pages.select("page_id"), "page_id", "left_semi"))


def list_wings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.wings(corpus(spark, sf_dir).pages)


def list_rooms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.rooms(corpus(spark, sf_dir).pages, "en")


def list_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = corpus(spark, sf_dir)
    return catalog.page_list(c.pages, c.stored_chunks, "src3", limit=20, offset=5)


def wing_room_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.rollup(corpus(spark, sf_dir).pages).select("wing", "room", "pages", "chars", F.col("level").cast("long").alias("level"))


def wing_top_rooms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.top_rooms(corpus(spark, sf_dir).pages).withColumn("place", F.col("place").cast("long"))


def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = corpus(spark, sf_dir)
    ev = c.table("events")
    existing = ev.select("user_id").distinct().withColumns({"event_type": F.lit("none"), "value": F.lit(0.0)})
    return rounded(catalog.upsert(existing, ev.select("user_id", "event_type", "value", F.col("event_id").alias("seq")), ["user_id"], "seq"), "value")


def delete_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = frame(spark, "fx_entities").filter("type = 'concept'").select("id")
    return catalog.without(frame(spark, "fx_relations"), gone, source_id="id", target_id="id").select("source_id", "target_id", "type", "weight")


def facts_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frame(spark, "fx_facts").withColumns({c: F.col(c).cast("timestamp") for c in ("valid_from", "valid_to")})
    return catalog.as_of(f, "2024-01-10 00:00:00").select("fact_id", "fact_text")


# chunking


def _chunks(df: DataFrame) -> DataFrame:
    return df.select(*(F.col(c).cast("long").alias(c) for c in ("doc_id", "chunk_index", "start", "token_count")), F.md5("chunk_text").alias("digest"))


def chunk_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(chunking.chunk_lines(corpus(spark, sf_dir).table("documents").select("doc_id", "text"), max_lines=5))


def chunk_stride(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(chunking.chunk_stride(corpus(spark, sf_dir).table("documents").select("doc_id", "text"), size=1500, overlap=100))


def chunk_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = chunking.chunk_turns(corpus(spark, sf_dir).table("conversations"), 4)
    return out.select("conv_id", F.col("chunk_index").cast("long"), "n_turns", F.md5("chunk_text").alias("digest"), "token_count")


def _by_strategy(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _chunks(chunking.chunk_texts(corpus(spark, sf_dir).table("documents").select("doc_id", "text"), "text", name))

    return run


def chunk_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = frame(spark, "fx_code").withColumn("path", F.concat(F.lit("f"), "ext")).withColumnRenamed("chunk_id", "doc_id")
    return _chunks(chunking.chunk_texts(code, "text", X.strategy(F.col("path"))))


def token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).table("documents").select("doc_id", X.token_estimate(F.col("text")).alias("tokens"))


def detect_strategy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, "fx_paths").select("path", X.strategy(F.col("path")).alias("strategy"))


def path_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("path")
    return frame(spark, "fx_paths").select("path", X.suffix(p).alias("suffix"), X.stem(p).alias("stem"), X.wing_of(p)["wing"].alias("wing"), X.wing_of(p)["room"].alias("room"))


def migrated_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = corpus(spark, sf_dir).table("pages").select(F.col("page_id").alias("id"), F.regexp_replace("url", r"^[a-z]+://", "").alias("source_path"))
    moved, _ = migrate(pages, pages.select(F.col("id").alias("page_id")), X.wing_of)
    return moved.groupBy("wing", "room").agg(F.count("*").alias("pages"))


# search


def vector_topk(spark: SparkSession, sf_dir: str, wing: str | None = None, after: str | None = None, before: str | None = None) -> DataFrame:
    c = corpus(spark, sf_dir)
    out = search.search(c.stored_chunks, c.embeddings, Request("", query_vector(c), 20, wing, after=after, before=before, hybrid=False), c.index)
    return rounded(out.select("chunk_id", "wing", "room", "score"), "score")


def keyword_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(corpus(spark, sf_dir).index.keyword_search(WORDS, 20).select("chunk_id", "wing", "room", "score"), "score")


def keyword_bm25_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same without an index."""
    return rounded(search.keyword_search(corpus(spark, sf_dir).chunks, WORDS, 20, with_text=False).select("chunk_id", "wing", "room", "score"), "score")


def keyword_bm25_scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(corpus(spark, sf_dir).index.keyword_search(WORDS, 20, wing="en", after=AFTER, before=BEFORE).select("chunk_id", "wing", "room", "score"), "score")


def keyword_match_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).index.matching(WORDS).groupBy("wing").agg(F.count("*").alias("chunks"))


def index_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the index holds: chunks and occurrences of each term."""
    return corpus(spark, sf_dir).index.postings.groupBy("term").agg(F.count("*").alias("chunks"), F.sum("n").alias("occurrences"))


def _hybrid(**given) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        c = corpus(spark, sf_dir)
        out = search.search(c.stored_chunks, c.embeddings, Request(WORDS, query_vector(c), 20, now=NOW, **given), c.index)
        return rounded(out.select("chunk_id", "wing", "room", F.col("rv").cast("long").alias("rv"), F.col("rw").cast("long").alias("rw"), "score"), "score", digits=9)

    return run


def with_text(c: Corpus, results: DataFrame) -> DataFrame:
    """The texts of a result list's chunks: a short list, sent to where the texts are."""
    return c.stored_chunks.select("chunk_id", "chunk_text").join(F.broadcast(search.listed(results)), "chunk_id")


def wake_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = corpus(spark, sf_dir)
    return rounded(search.wake(c.stored_chunks, c.embeddings, WORDS, query_vector(c), 48, now=NOW, index=c.index).select("chunk_id", "score"), "score", digits=9)


def rerank_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = corpus(spark, sf_dir)
    best = with_text(c, c.index.keyword_search(WORDS, 20)).select("chunk_id", "chunk_text", "score")
    return rounded(search.rerank(best, WORDS, search.word_overlap, 10).select("chunk_id", F.col("place").cast("long").alias("place"), "rerank"), "rerank")


def vector_ivf(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = corpus(spark, sf_dir)
    indexed, centres = search.inverted_file(c.embeddings, cells=16)
    queries = c.table("embeddings").filter(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("query_id"), "embedding")
    return rounded(search.inverted_search_all(indexed, centres, queries, 20, probes=4).select("query_id", "chunk_id", "score"), "score")


def result_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = corpus(spark, sf_dir)
    best = with_text(c, c.index.keyword_search(WORDS, 20))
    return best.select("chunk_id", X.preview(F.col("chunk_text"), 150).alias("preview"), F.md5(X.highlight(F.col("chunk_text"), WORDS)).alias("marked"), X.first_of(F.lit(""), F.col("room")).alias("label"), F.round("score", 3).alias("score"))


def _top(source: str, where: str = "", columns: str = "chunk_id, wing, room, round(score, 6) AS score", k: int = 20) -> str:
    return f"SELECT {columns} FROM (SELECT * FROM {source} {where} ORDER BY score DESC, chunk_id LIMIT {k})"


QUERIES = {
    "stats_global": stats_global, "list_wings": list_wings, "list_rooms": list_rooms, "list_pages": list_pages, "wing_room_rollup": wing_room_rollup, "wing_top_rooms": wing_top_rooms, "upsert_latest": upsert_latest, "delete_cascade": delete_cascade, "facts_as_of": facts_as_of,
    "chunk_lines": chunk_lines, "chunk_stride": chunk_stride, "chunk_turns": chunk_turns, "chunk_markdown": _by_strategy("markdown"), "chunk_code": _by_strategy("code"), "chunk_plain": _by_strategy("plain"), "chunk_dispatch": chunk_dispatch, "token_estimate": token_estimate, "detect_strategy": detect_strategy, "path_parts": path_parts, "migrated_pages": migrated_pages,
    "vector_topk": vector_topk, "vector_topk_wing": lambda s, d: vector_topk(s, d, wing="en"), "vector_topk_time": lambda s, d: vector_topk(s, d, after=AFTER, before=BEFORE), "keyword_bm25": keyword_bm25, "keyword_bm25_scan": keyword_bm25_scan, "keyword_bm25_scoped": keyword_bm25_scoped, "index_postings": index_postings, "keyword_match_all": keyword_match_all, "hybrid_rrf": _hybrid(), "hybrid_rrf_recent": _hybrid(temporal_boost=True, recent_days=14), "wake_context": wake_context, "rerank_scores": rerank_scores, "vector_ivf": vector_ivf, "result_preview": result_preview,
}

_digest = "SELECT doc_id, chunk_index, start, length(x) // 4 + 1 AS token_count, md5(x) AS digest FROM "
ORACLES = {
    "stats_global": f"WITH {CHUNKS}, {EMBEDDED} SELECT *, CASE WHEN chunks = 0 THEN 0 ELSE embedded * 100 // chunks END AS embedding_percent FROM (SELECT count(DISTINCT wing) AS wings, count(DISTINCT (wing, room)) AS rooms, count(*) AS pages, (SELECT count(*) FROM chunks) AS chunks, (SELECT count(*) FROM emb WHERE page_id IN (SELECT page_id FROM pgs)) AS embedded FROM pgs)",
    "list_wings": f"WITH {PAGES} SELECT wing, count(DISTINCT room) AS rooms, count(*) AS pages FROM pgs GROUP BY wing",
    "list_rooms": f"WITH {PAGES} SELECT wing, room, count(*) AS pages FROM pgs WHERE wing = 'en' GROUP BY wing, room",
    "list_pages": f"WITH {CHUNKS} SELECT page_id, wing, room, (SELECT count(*) FROM chunks c WHERE c.page_id = p.page_id) AS chunk_count FROM (SELECT * FROM pgs WHERE room = 'src3' ORDER BY page_id LIMIT 20 OFFSET 5) p",
    "wing_room_rollup": f"WITH {PAGES} SELECT wing, room, count(*) AS pages, sum(n_chars)::BIGINT AS chars, CAST(grouping(wing) * 2 + grouping(room) AS BIGINT) AS level FROM pgs GROUP BY ROLLUP (wing, room)",
    "wing_top_rooms": f"WITH {PAGES} SELECT wing, room, pages, row_number() OVER (PARTITION BY wing ORDER BY pages DESC, room) AS place FROM (SELECT wing, room, count(*) AS pages FROM pgs GROUP BY wing, room) QUALIFY place <= 5",
    "upsert_latest": "SELECT user_id, arg_max(event_type, event_id) AS event_type, round(arg_max(value, event_id), 6) AS value FROM events GROUP BY user_id",
    "delete_cascade": f"WITH {cte('fx_entities', 'fx_relations')} SELECT * FROM fx_relations WHERE source_id NOT IN (SELECT id FROM fx_entities WHERE type = 'concept') AND target_id NOT IN (SELECT id FROM fx_entities WHERE type = 'concept')",
    "facts_as_of": f"WITH {cte('fx_facts')} SELECT fact_id, fact_text FROM fx_facts WHERE valid_from <= '2024-01-10 00:00:00' AND (valid_to IS NULL OR '2024-01-10 00:00:00' < valid_to)",
    "chunk_lines": f"WITH {CHUNKS} SELECT page_id AS doc_id, chunk_index, start, token_count, md5(chunk_text) AS digest FROM chunks",
    "chunk_stride": f"{_digest}(SELECT doc_id, start // 1400 AS chunk_index, start, substr(text, start + 1, 1500) AS x FROM (SELECT doc_id, text, unnest(range(0, greatest(length(text) - 100, 1)::BIGINT, 1400)) AS start FROM documents WHERE text <> ''))",
    "chunk_turns": "SELECT conv_id, turn // 4 AS chunk_index, count(*) AS n_turns, md5(string_agg(role || ': ' || text, chr(10) ORDER BY turn)) AS digest, length(string_agg(role || ': ' || text, chr(10) ORDER BY turn)) // 4 + 1 AS token_count FROM conversations GROUP BY ALL",
    "token_estimate": "SELECT doc_id, length(text) // 4 + 1 AS tokens FROM documents",
    "keyword_bm25": f"WITH {CHUNKS}, {BM25} {_top('bm')}",
    "keyword_bm25_scan": f"WITH {CHUNKS}, {BM25} {_top('bm')}",
    "keyword_bm25_scoped": f"WITH {CHUNKS_IN_SCOPE}, {BM25} {_top('bm')}",
    "index_postings": f"WITH {CHUNKS}, {TERMS} SELECT term, count(DISTINCT chunk_id) AS chunks, count(*) AS occurrences FROM (SELECT chunk_id, unnest(t) AS term FROM tok) GROUP BY term",
    "result_preview": f"WITH {CHUNKS}, {BM25} SELECT chunk_id, translate(substr(chunk_text, 1, 150), chr(10), ' ') AS preview, md5(regexp_replace(chunk_text, '(?i)(the|of)', '<em>\\1</em>', 'g')) AS marked, room AS label, round(score, 3) AS score FROM (SELECT * FROM bm ORDER BY score DESC, chunk_id LIMIT 20) JOIN (SELECT chunk_id, chunk_text FROM chunks) USING (chunk_id)",
    "rerank_scores": f"WITH {CHUNKS}, {BM25}, best AS (SELECT chunk_id, chunk_text, row_number() OVER (ORDER BY score DESC, chunk_id) AS place FROM (SELECT * FROM bm ORDER BY score DESC, chunk_id LIMIT 20) JOIN (SELECT chunk_id, chunk_text FROM chunks) USING (chunk_id)), scored AS (SELECT chunk_id, place, CASE WHEN place > 10 THEN 1.0::DOUBLE ELSE round(len(list_intersect(['the', 'of'], regexp_split_to_array(lower(substr(chunk_text, 1, 200)), '[^\\p{{L}}\\p{{N}}]+'))) / 2.0::DOUBLE, 6) END AS rerank FROM best) SELECT * FROM scored ORDER BY rerank DESC, place LIMIT 10",
    "keyword_match_all": f"WITH {CHUNKS}, {TERMS} SELECT wing, count(*) AS chunks FROM tok WHERE list_contains(t, 'the') AND list_contains(t, 'of') GROUP BY wing",
    "vector_topk": f"WITH {CHUNKS}, {VECTORS} {_top('vec')}",
    "vector_topk_wing": f"WITH {CHUNKS}, {VECTORS} {_top('vec', 'WHERE wing = ' + chr(39) + 'en' + chr(39))}",
    "vector_topk_time": f"WITH {CHUNKS}, {VECTORS} {_top('vec', f"WHERE created_at >= TIMESTAMP '{AFTER}' AND created_at < TIMESTAMP '{BEFORE}'")}",
    "hybrid_rrf": f"WITH {CHUNKS}, {VECTORS}, {BM25}, {rrf(NEVER)} SELECT chunk_id, wing, room, rv, rw, round(score, 9) AS score FROM hyb",
    "hybrid_rrf_recent": f"WITH {CHUNKS}, {VECTORS}, {BM25}, {rrf("TIMESTAMP '2024-01-17'")} SELECT chunk_id, wing, room, rv, rw, round(score, 9) AS score FROM hyb",
    "wake_context": f"WITH {CHUNKS}, {VECTORS}, {BM25}, {rrf("TIMESTAMP '2024-01-28'", 10)} SELECT chunk_id, round(score, 9) AS score FROM hyb",
    "detect_strategy": f"WITH {cte('fx_paths')} SELECT path, CASE regexp_extract(lower(path), '[^/](\\.[^./]+)$', 1) WHEN '.md' THEN 'markdown' WHEN '.py' THEN 'code' WHEN '.java' THEN 'code' WHEN '.sql' THEN 'sql' WHEN '.yaml' THEN 'config' WHEN '.json' THEN 'config' WHEN '.log' THEN 'lines' ELSE 'plain' END AS strategy FROM fx_paths",
}
