"""Queries on extraction, names, the knowledge graph and its hygiene."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella import schema
from tessella.api import Tessella
from tessella.functions import text as X
from tessella.operators import evaluation, extraction, graph, hygiene, resolution, search
from tessella.plans.corpus import CHUNKS, NOW, WORDS, corpus, rounded
from tessella.plans.corpus import BM25, VECTORS, NEVER, query_vector, rrf
from tessella.plans.fixtures import cte, frame

_words = lambda xs: "(" + ", ".join(f"'{x}'" for x in xs) + ")"
MENTIONS = "ment AS (SELECT chunk_id, wing, unnest(range(0, len(m)::BIGINT)) AS place, unnest(m) AS name FROM (SELECT chunk_id, wing, regexp_extract_all(chunk_text, '[A-Z][a-z]{5,}') AS m FROM chunks))"
LINKS = f"{MENTIONS}, lnk AS (SELECT chunk_id, name, count(*) / max(count(*)) OVER (PARTITION BY chunk_id) AS relevance FROM ment GROUP BY chunk_id, name)"
EDGES = "edg AS (SELECT source, target, count(*) AS weight FROM (SELECT name AS source, lead(name) OVER (PARTITION BY chunk_id ORDER BY place) AS target FROM ment) WHERE target IS NOT NULL GROUP BY source, target)"
STAR_SQL = """star AS (SELECT 'c' || c_custkey AS source, 'n' || c_nationkey AS target, 'lives_in' AS type FROM customer UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, 'sits_in' FROM supplier UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 'part_of' FROM nation)"""


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored entities: (name, mentions, chunks, type)."""
    return Tessella(spark, sf_dir).entities


def _linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored links: (chunk_id, name, relevance), sorted by chunk, so that few chunks are few row groups."""
    return Tessella(spark, sf_dir).links


def _adjacent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored relations: (source, target, weight), sorted by source."""
    return Tessella(spark, sf_dir).relations


def star(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph of customers and suppliers, their nations and regions: (source, target, type)."""
    c = corpus(spark, sf_dir)
    edge = lambda t, a, b, x, y, kind: c.table(t).select(F.concat(F.lit(a), F.col(x)).alias("source"), F.concat(F.lit(b), F.col(y)).alias("target"), F.lit(kind).alias("type"))
    return edge("customer", "c", "n", "c_custkey", "c_nationkey", "lives_in").unionAll(edge("supplier", "s", "n", "s_suppkey", "s_nationkey", "sits_in")).unionAll(edge("nation", "n", "r", "n_nationkey", "n_regionkey", "part_of"))


# extraction


def extract_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.entities(frame(spark, "fx_code"), "chunk_id", "text").select("chunk_id", "name", "type")


def extract_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.imports(frame(spark, "fx_code"), "chunk_id", "text")


def classify_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = extraction.classify(F.col("text"), F.col("ext"))
    return frame(spark, "fx_code").select("chunk_id", kind.alias("kind"), extraction.mode_for(kind).alias("mode"))


def classify_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = corpus(spark, sf_dir).chunks.select("wing", extraction.classify(F.col("chunk_text"), F.lit("")).alias("kind"))
    return rows.groupBy("wing", "kind").agg(F.count("*").alias("chunks"))


def relations_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.relations(frame(spark, "fx_code"), "chunk_id", "text", "ext")


def relations_yaml(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations_code(spark, sf_dir).filter("type = 'configures'").select("chunk_id", "source", "target", "weight")


def relations_python(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = frame(spark, "fx_code").filter("ext = '.py'")
    return extraction.relations(rows, "chunk_id", "text", "ext").select("chunk_id", "source", "target", "weight")


def relations_maven(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.relations(frame(spark, "fx_code").filter("ext = '.xml'"), "chunk_id", "text", "ext").select("chunk_id", "source", "target", "weight")


def llm_json_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.from_answers(frame(spark, "fx_answers"), "id", "raw")[0].select("id", "name", "type")


def llm_json_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.from_answers(frame(spark, "fx_answers"), "id", "raw")[1].select("id", "source", "target", "type")


def score_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, "fx_scores").select("id", F.posexplode(X.parse_scores(F.col("raw"), F.col("n").cast("int"))).alias("place", "score")).select("id", F.col("place").cast("long").alias("place"), "score")


def hybrid_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    regex = frame(spark, "fx_existing").select(F.lit(1).alias("id"), "name", "type")
    llm = frame(spark, "fx_detections").select(F.lit(1).alias("id"), "name", "type").distinct()
    return extraction.hybrid(regex, llm, "id").select("name", "type")


def name_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, "fx_names").select("name", X.name_valid(F.col("name")).alias("valid"))


def name_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, "fx_names").select("name", evaluation.name_class(F.col("name")).alias("class"))


def resolve_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, "fx_names").select("name", resolution.resolve(F.col("name")).alias("resolved"), resolution.changed(F.col("name")).alias("changed"))


def canonicalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, "fx_names").select("name", resolution.canonical(F.col("name")).alias("canonical"))


def camel_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, "fx_names").select("name", F.array_join(X.camel_split(F.col("name")), "|").alias("parts"))


def fuzzy_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(resolution.similar(frame(spark, "fx_names"), ["order", "orders", "AuditService", "KYC", "missing"]), "score")


# graph


def graph_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _names(spark, sf_dir)


def graph_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_linked(spark, sf_dir), "relevance")


def graph_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _adjacent(spark, sf_dir)


def graph_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = frame(spark, "fx_code").withColumn("chunk_text", F.col("text"))
    found = extraction.entities(code, "chunk_id", "text")
    entities, linked, relations = graph.build(code, found, extraction.relations(code, "chunk_id", "text", "ext"), resolution.resolve)
    counted = linked.groupBy(F.col("entity_id").alias("id")).agg(F.count("*").alias("chunks"))
    out = relations.groupBy(F.col("source_id").alias("id")).agg(F.count("*").alias("outgoing"))
    return entities.join(counted, "id", "left").join(out, "id", "left").select("name", "type", F.coalesce("chunks", F.lit(0)).alias("chunks"), F.coalesce("outgoing", F.lit(0)).alias("outgoing"))


def bulk_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = frame(spark, "fx_entities").select("name", "type", F.col("id").alias("ord"))
    names = frame(spark, "fx_entities").select("id", "name")
    r = frame(spark, "fx_relations").join(names.select(F.col("id").alias("source_id"), F.col("name").alias("source")), "source_id").withColumn("target", F.when(F.col("target_id") == 3, "order").otherwise("unknown name"))
    _, relations, _ = graph.bulk_import(e, r.select("source", "target", "type", "weight"), e.select("name", F.lit(1).alias("chunk_id")))
    return relations.select("source", "target", "type", "weight")


def graph_stats_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.type_counts(_names(spark, sf_dir))


def graph_top_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.top_degrees(graph_relations(spark, sf_dir))


def star_top_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.top_degrees(star(spark, sf_dir))


def entity_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _names(spark, sf_dir).select("name", "type")
    return graph.with_chunk_counts(graph.find(e, "TION", limit=15), _linked(spark, sf_dir), most=1000)


def entity_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, relations = corpus(spark, sf_dir), _adjacent(spark, sf_dir)
    name = graph.top_degrees(relations, 1).first()["id"]
    return graph.detail(_names(spark, sf_dir), relations, _linked(spark, sf_dir), c.stored_chunks, name, 5)


def relations_of_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = star(spark, sf_dir)
    both = [graph.relations_of(s, "n3", d).agg(F.count("*").alias("n")).select(F.lit(d).alias("direction"), "n") for d in ("outgoing", "incoming", "both")]
    return both[0].unionAll(both[1]).unionAll(both[2])


def related_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(graph.related_chunks(_linked(spark, sf_dir), 0, 20), "relevance")


def subgraph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.subgraph(star(spark, sf_dir), "n3", 2, 50)[0].withColumn("depth", F.col("depth").cast("long"))


def subgraph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.subgraph(star(spark, sf_dir), "n3", 2, 50)[1]


def subgraph_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.to_json(*graph.subgraph(star(spark, sf_dir), "r1", 1, 20), "r1")


def neighbour_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(graph.neighbours(_names(spark, sf_dir), _adjacent(spark, sf_dir), _linked(spark, sf_dir)), "radius")


def pagerank3(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = star(spark, sf_dir)
    vertices = s.select(F.col("source").alias("id")).union(s.select("target")).distinct()
    return rounded(search.page_rank(vertices, s), "rank")


def propagate_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = corpus(spark, sf_dir)
    results = search.search(c.stored_chunks, c.embeddings, search.Request(WORDS, query_vector(c), 20), c.index).select("chunk_id", "score")
    out = search.propagate(results, _linked(spark, sf_dir).select("chunk_id", F.col("name").alias("entity")), _adjacent(spark, sf_dir), 20)
    return rounded(out.select("chunk_id", "score", "boost", "mean", "combined"), "score", "boost", "mean", "combined")


# hygiene


def consensus_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = hygiene.consensus(frame(spark, "fx_detections"))
    return rounded(v.select("name", "type", "score", F.array_join("confirmed_by", ",").alias("confirmed"), F.array_join("rejected_by", ",").alias("rejected"), "status"), "score")


def consensus_three(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(hygiene.consensus(frame(spark, "fx_detections"), ("regex", "hybrid-7b", "1.5b")).select("name", "score", "status"), "score")


def learning_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = hygiene.consensus(frame(spark, "fx_detections"))
    once = hygiene.learned(spark.createDataFrame([], schema.ENTITY_LEARNING), v, NOW)
    return hygiene.learned(once, v.filter("name in ('alpha', 'gamma')"), NOW).select("entity_name", "status", F.col("eval_count").cast("long").alias("eval_count"))


def filter_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = hygiene.consensus(frame(spark, "fx_detections"))
    learning = hygiene.learned(spark.createDataFrame([], schema.ENTITY_LEARNING), v, NOW)
    return hygiene.without_rejected(frame(spark, "fx_detections").select(F.upper("name").alias("name")).distinct(), learning)


def edge_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hygiene.edge_entities(_names(spark, sf_dir).select("name"), _linked(spark, sf_dir), 3, 50)


def enrich_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = corpus(spark, sf_dir)
    return hygiene.context(_linked(spark, sf_dir), c.stored_chunks).select("name", F.md5("context").alias("digest"))


def enrich_describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = corpus(spark, sf_dir)
    contexts = hygiene.context(_linked(spark, sf_dir), c.stored_chunks)
    return hygiene.enrich(contexts, lambda name, text: f"{name} in {len(text)} characters")


def merge_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hygiene.merge_entities(frame(spark, "fx_existing"), frame(spark, "fx_incoming")).withColumn("modes_seen", F.array_join("modes_seen", ","))


def merge_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = frame(spark, "fx_relations").select(F.col("source_id").alias("source"), F.col("target_id").alias("target"), "type", "weight")
    return rounded(hygiene.merge_relations(r.filter("source < 3"), r, "7b"), "weight")


def _fused(spark: SparkSession):
    e = frame(spark, "fx_entities")
    mapping = hygiene.fusion(e, resolution.resolve)
    return mapping, hygiene.fuse(e, frame(spark, "fx_links"), frame(spark, "fx_relations"), mapping)


def fuse_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fused(spark)[0]


def fuse_apply_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fused(spark)[1][1]


def fuse_apply_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fused(spark)[1][2]


def prune_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hygiene.sparse_noise(frame(spark, "fx_entities"), frame(spark, "fx_links"))


def prune_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = frame(spark, "fx_entities").withColumn("created_at", F.col("created_at").cast("timestamp"))
    return hygiene.orphans(e, frame(spark, "fx_links"), frame(spark, "fx_relations"), NOW).select("id", "name")


def lower_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = frame(spark, "fx_entities").withColumn("metadata", F.map_filter(F.create_map(F.lit("mode"), "mode", F.lit("status"), "status"), lambda k, v: v.isNotNull()))
    return hygiene.lowered(e, frame(spark, "fx_links"))


QUERIES = {f.__name__: f for f in (extract_regex, extract_imports, classify_chunk, classify_corpus, relations_code, relations_yaml, relations_python, relations_maven, llm_json_parse, llm_json_relations, score_parse, hybrid_extraction, name_valid, name_class, resolve_alias, canonicalize, camel_parts, fuzzy_scan, graph_entities, graph_links, graph_relations, graph_build, bulk_import, graph_stats_types, graph_top_degree, star_top_degree, entity_search, entity_detail, relations_of_entity, related_chunks, subgraph_nodes, subgraph_edges, subgraph_json, neighbour_graph, pagerank3, propagate_rerank, consensus_votes, consensus_three, learning_table, filter_rejected, edge_entities, enrich_context, enrich_describe, merge_entities, merge_relations, fuse_plan, fuse_apply_links, fuse_apply_relations, prune_sparse, prune_orphans, lower_weight)}

KIND = "CASE WHEN name LIKE '%er' THEN 'class' WHEN name LIKE '%ing' THEN 'function' ELSE 'concept' END"
_weights = "(VALUES " + ", ".join(f"('{m}', {w}::DOUBLE)" for m, w in schema.MODE_WEIGHTS.items()) + ") AS w(mode, weight)"


def _votes(modes: tuple[str, ...]) -> str:
    total = sum(schema.MODE_WEIGHTS.get(m, 0.5) for m in modes)
    return f"""{cte("fx_detections")}, votes AS (SELECT name, mode, min(seq) AS seq FROM fx_detections WHERE found GROUP BY name, mode),
verdict AS (SELECT v.name, sum(coalesce(w.weight, 0.5::DOUBLE)) / {total}::DOUBLE AS score, list_sort(list(v.mode)) AS yes, min(v.seq) AS seq FROM votes v LEFT JOIN {_weights} USING (mode) GROUP BY v.name),
judged AS (SELECT *, CASE WHEN round(score, 9) >= 0.65 THEN 'confirmed' WHEN round(score, 9) >= 0.35 THEN 'uncertain' WHEN round(score, 9) >= 0.15 THEN 'suspicious' ELSE 'rejected' END AS status FROM verdict)"""


def _pagerank(vertices: str, near: str, prefix: str = "") -> str:
    """Chained steps: `near` has (a, b) both ways; the last step is {prefix}r3 (id, rank)."""
    steps = [f"{prefix}deg AS (SELECT a, count(*) AS d FROM {near} GROUP BY a)", f"{prefix}r0 AS (SELECT id, 1.0::DOUBLE / (SELECT count(*) FROM {vertices}) AS rank FROM {vertices})"]
    for i in range(3):
        steps.append(f"{prefix}r{i + 1} AS (SELECT v.id, 0.15::DOUBLE + 0.85::DOUBLE * coalesce(s.x, 0.0::DOUBLE) AS rank FROM {vertices} v LEFT JOIN (SELECT e.b AS id, sum(r.rank / g.d) AS x FROM {near} e JOIN {prefix}r{i} r ON r.id = e.a JOIN {prefix}deg g ON g.a = e.a GROUP BY e.b) s USING (id))")
    return ", ".join(steps)


_bfs = f"""{STAR_SQL}, both_ways AS (SELECT source AS id, target AS nxt FROM star UNION ALL SELECT target, source FROM star),
d1 AS (SELECT DISTINCT nxt AS id FROM both_ways WHERE id = 'n3' AND nxt <> 'n3' ORDER BY id LIMIT 49),
d2 AS (SELECT DISTINCT nxt AS id FROM both_ways WHERE id IN (SELECT id FROM d1) AND nxt NOT IN (SELECT id FROM d1) AND nxt <> 'n3' ORDER BY id LIMIT (49 - (SELECT count(*) FROM d1))),
nodes AS (SELECT 'n3' AS id, 0::BIGINT AS depth UNION ALL SELECT id, 1 FROM d1 UNION ALL SELECT id, 2 FROM d2)"""
_alias = "CASE lower(name) " + " ".join(f"WHEN '{a}' THEN '{c}'" for a, c in schema.ALIASES.items()) + " END"
_resolved = f"lower(CASE WHEN {_alias} = lower(name) THEN name ELSE coalesce({_alias}, name) END)"
_fusion = f"""{cte("fx_entities")}, named AS (SELECT *, {_resolved} AS canonical, CASE type WHEN 'class' THEN 0 WHEN 'function' THEN 1 WHEN 'module' THEN 2 WHEN 'api' THEN 3 WHEN 'concept' THEN 4 ELSE 5 END AS p FROM fx_entities),
mapping AS (SELECT id, first_value(id) OVER (PARTITION BY canonical ORDER BY p, id) AS keeper, canonical FROM named QUALIFY count(*) OVER (PARTITION BY canonical) >= 2), gone AS (SELECT * FROM mapping WHERE id <> keeper)"""

ORACLES = {
    "name_valid": f"WITH {cte('fx_names')} SELECT name, length(name) BETWEEN 2 AND 80 AND lower(name) NOT IN {_words(schema.GENERIC)} AND regexp_matches(name, '[a-zA-Z0-9_]') AS valid FROM fx_names",
    "llm_json_parse": f"WITH {cte('fx_answers')}, j AS (SELECT id, TRY_CAST(nullif(regexp_extract(raw, '(?s)\\{{.*\\}}'), '') AS JSON) AS j FROM fx_answers), e AS (SELECT id, unnest(from_json(j->'$.entities', '[{{\"name\":\"VARCHAR\",\"type\":\"VARCHAR\"}}]')) AS e FROM j WHERE j IS NOT NULL) SELECT id, e.name AS name, e.type AS type FROM e WHERE length(e.name) BETWEEN 2 AND 80 AND lower(e.name) NOT IN {_words(schema.GENERIC)} AND e.type <> 'variable'",
    "relations_yaml": f"WITH {cte('fx_code')} SELECT chunk_id, unnest(regexp_extract_all(text, '\\$\\{{(\\w+(?:\\.\\w+)+)\\}}', 1)) AS source, 'config' AS target, 0.4::DOUBLE AS weight FROM fx_code WHERE ext = '.yaml'",
    "relations_maven": f"WITH {cte('fx_code')} SELECT chunk_id, unnest(regexp_extract_all(text, '<dependency>\\s*<groupId>([^<]+)</groupId>\\s*<artifactId>([^<]+)</artifactId>', 2)) AS source, unnest(regexp_extract_all(text, '<dependency>\\s*<groupId>([^<]+)</groupId>\\s*<artifactId>([^<]+)</artifactId>', 1)) AS target, 0.8::DOUBLE AS weight FROM fx_code WHERE ext = '.xml'",
    "graph_entities": f"WITH {CHUNKS}, {MENTIONS} SELECT name, count(*) AS mentions, count(DISTINCT chunk_id) AS chunks, {KIND} AS type FROM ment GROUP BY name",
    "graph_links": f"WITH {CHUNKS}, {LINKS} SELECT chunk_id, name, round(relevance, 6) AS relevance FROM lnk",
    "graph_relations": f"WITH {CHUNKS}, {MENTIONS}, {EDGES} SELECT * FROM edg",
    "graph_stats_types": f"WITH {CHUNKS}, {MENTIONS} SELECT type, count(*) AS n FROM (SELECT DISTINCT name, {KIND} AS type FROM ment) GROUP BY type",
    "graph_top_degree": f"WITH {CHUNKS}, {MENTIONS}, {EDGES} SELECT id, count(*) AS degree FROM (SELECT source AS id FROM edg UNION ALL SELECT target FROM edg WHERE source <> target) GROUP BY id ORDER BY degree DESC, id LIMIT 10",
    "star_top_degree": f"WITH {STAR_SQL} SELECT id, count(*) AS degree FROM (SELECT source AS id FROM star UNION ALL SELECT target FROM star WHERE source <> target) GROUP BY id ORDER BY degree DESC, id LIMIT 10",
    "entity_search": f"WITH {CHUNKS}, {LINKS} SELECT name, {KIND} AS type, least(count(*), 1000) AS chunks FROM lnk WHERE name ILIKE '%TION%' GROUP BY name ORDER BY length(name), name LIMIT 15",
    "relations_of_entity": f"WITH {STAR_SQL} SELECT 'outgoing' AS direction, count(*) AS n FROM star WHERE source = 'n3' UNION ALL SELECT 'incoming', count(*) FROM star WHERE target = 'n3' UNION ALL SELECT 'both', count(*) FROM star WHERE source = 'n3' OR target = 'n3'",
    "related_chunks": f"WITH {CHUNKS}, {LINKS} SELECT chunk_id, count(DISTINCT name) AS shared, round(avg(relevance), 6) AS relevance FROM lnk WHERE chunk_id <> 0 AND name IN (SELECT name FROM lnk WHERE chunk_id = 0) GROUP BY chunk_id ORDER BY count(DISTINCT name) DESC, avg(relevance) DESC, chunk_id LIMIT 20",
    "subgraph_nodes": f"WITH {_bfs} SELECT * FROM nodes",
    "subgraph_edges": f"WITH {_bfs} SELECT DISTINCT s.* FROM star s JOIN nodes a ON a.id = s.source JOIN nodes b ON b.id = s.target WHERE least(a.depth, b.depth) < 2",
    "neighbour_graph": f"WITH {CHUNKS}, {LINKS}, {EDGES}, f AS (SELECT DISTINCT name FROM ment ORDER BY name LIMIT 30) SELECT source, target, round(5 + 3 * sqrt((SELECT count(*) FROM lnk WHERE lnk.name = source)), 6) AS radius FROM edg WHERE source IN (SELECT name FROM f)",
    "pagerank3": f"WITH {STAR_SQL}, near AS (SELECT source AS a, target AS b FROM star UNION SELECT target, source FROM star), vs AS (SELECT DISTINCT a AS id FROM near), {_pagerank('vs', 'near')} SELECT id, round(rank, 6) AS rank FROM r3",
    "propagate_rerank": f"""WITH {CHUNKS}, {VECTORS}, {BM25}, {rrf(NEVER)}, {LINKS}, {EDGES},
own AS (SELECT DISTINCT chunk_id, name AS entity FROM lnk WHERE chunk_id IN (SELECT chunk_id FROM hyb)), shr AS (SELECT entity AS id, count(DISTINCT chunk_id) AS n FROM own GROUP BY entity),
near AS (SELECT source AS a, target AS b FROM edg WHERE source <> target AND source IN (SELECT id FROM shr) AND target IN (SELECT id FROM shr) UNION SELECT target, source FROM edg WHERE source <> target AND source IN (SELECT id FROM shr) AND target IN (SELECT id FROM shr)), {_pagerank("shr", "near")},
mns AS (SELECT chunk_id, max(1 + (n - 1) * 0.1::DOUBLE) AS boost, avg(rank / (SELECT max(rank) FROM r3)) AS mean FROM own JOIN shr ON shr.id = own.entity JOIN r3 ON r3.id = own.entity GROUP BY chunk_id),
fin AS (SELECT chunk_id, score, coalesce(boost, 1.0::DOUBLE) AS boost, coalesce(mean, 0.0::DOUBLE) AS mean FROM hyb LEFT JOIN mns USING (chunk_id))
SELECT chunk_id, round(score, 6) AS score, round(boost, 6) AS boost, round(mean, 6) AS mean, round(score * 0.5 + 0.2::DOUBLE * mean * boost + 0.3::DOUBLE * (boost - 1), 6) AS combined FROM fin""",
    "consensus_votes": f"WITH {_votes(tuple(schema.MODE_WEIGHTS))} SELECT j.name, d.type, round(score, 6) AS score, array_to_string(yes, ',') AS confirmed, array_to_string(list_filter({sorted(schema.MODE_WEIGHTS)}, lambda m: NOT list_contains(yes, m)), ',') AS rejected, status FROM judged j JOIN fx_detections d ON d.seq = j.seq AND d.found",
    "consensus_three": f"WITH {_votes(('regex', 'hybrid-7b', '1.5b'))} SELECT name, round(score, 6) AS score, status FROM judged",
    "learning_table": f"WITH {_votes(tuple(schema.MODE_WEIGHTS))} SELECT name AS entity_name, status, CASE WHEN name IN ('alpha', 'gamma') THEN 2 ELSE 1 END::BIGINT AS eval_count FROM judged",
    "filter_rejected": f"WITH {_votes(tuple(schema.MODE_WEIGHTS))} SELECT DISTINCT upper(name) AS name FROM fx_detections WHERE lower(name) NOT IN (SELECT name FROM judged WHERE status = 'rejected')",
    "edge_entities": f"WITH {CHUNKS}, {LINKS} SELECT name, count(*) AS links FROM lnk GROUP BY name HAVING count(*) <= 3 ORDER BY links, name LIMIT 50",
    "enrich_context": f"WITH {CHUNKS}, {LINKS}, best AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY relevance DESC, chunk_id) AS place FROM lnk QUALIFY place <= 3) SELECT name, md5(substr(string_agg(substr(chunk_text, 1, 500), chr(10) || '---' || chr(10) ORDER BY place), 1, 1500)) AS digest FROM best JOIN chunks USING (chunk_id) GROUP BY name",
    "merge_relations": f"WITH {cte('fx_relations')}, r AS (SELECT source_id AS source, target_id AS target, type, weight FROM fx_relations) SELECT source, target, type, CASE WHEN source < 3 THEN weight ELSE round(weight * 0.7::DOUBLE, 6) END AS weight FROM r",
    "merge_entities": f"WITH {cte('fx_existing', 'fx_incoming')}, u AS (SELECT *, 0 AS seq FROM fx_existing UNION ALL SELECT *, 1 FROM fx_incoming), k AS (SELECT *, CASE mode WHEN 'regex' THEN 1.0 WHEN 'hybrid-7b' THEN 0.9 WHEN 'hybrid-1.5b' THEN 0.8 WHEN '7b' THEN 0.7 ELSE 0.5 END AS w FROM u) SELECT name, first(type ORDER BY w DESC, seq) AS type, first(mode ORDER BY w DESC, seq) AS mode, array_to_string(list_sort(list_distinct(list(mode))), ',') AS modes_seen FROM k GROUP BY name",
    "fuse_plan": f"WITH {_fusion} SELECT id, keeper, canonical FROM gone",
    "fuse_apply_links": f"WITH {_fusion}, {cte('fx_links')} SELECT coalesce(g.keeper, l.entity_id) AS entity_id, chunk_id, max(relevance) AS relevance FROM fx_links l LEFT JOIN gone g ON g.id = l.entity_id GROUP BY 1, 2",
    "fuse_apply_relations": f"WITH {_fusion}, {cte('fx_relations')} SELECT coalesce(a.keeper, source_id) AS source_id, coalesce(b.keeper, target_id) AS target_id, type, max(weight) AS weight FROM fx_relations r LEFT JOIN gone a ON a.id = source_id LEFT JOIN gone b ON b.id = target_id WHERE coalesce(a.keeper, source_id) <> coalesce(b.keeper, target_id) GROUP BY 1, 2, 3",
    "prune_sparse": f"WITH {cte('fx_entities', 'fx_links')}, l AS (SELECT e.id, name, count(chunk_id) AS links FROM fx_entities e LEFT JOIN fx_links ON entity_id = e.id GROUP BY e.id, name HAVING count(chunk_id) < 2) SELECT * FROM (SELECT *, CASE WHEN lower(name) IN {_words(schema.STOP_ENTITIES)} THEN 'stop-word' WHEN regexp_full_match(name, '[a-z]{{2,4}}') THEN 'too-short' WHEN regexp_full_match(name, '[0-9.]+') THEN 'numeric' WHEN links = 1 AND name = lower(name) AND regexp_matches(name, '[a-z]') AND length(name) < 5 THEN 'weak-noise' END AS reason FROM l) WHERE reason IS NOT NULL",
    "prune_orphans": f"WITH {cte('fx_entities', 'fx_links', 'fx_relations')} SELECT id, name FROM fx_entities WHERE created_at < '2024-01-01 00:00:00' AND id NOT IN (SELECT entity_id FROM fx_links) AND id NOT IN (SELECT source_id FROM fx_relations UNION SELECT target_id FROM fx_relations)",
    "lower_weight": f"WITH {cte('fx_entities', 'fx_links')} SELECT id, name, 0.3::DOUBLE AS weight, 'pruned' AS status FROM fx_entities WHERE mode IN ('1.5b', '7b') AND status IS DISTINCT FROM 'pruned' AND id NOT IN (SELECT entity_id FROM fx_links WHERE relevance < 0.5)",
}
