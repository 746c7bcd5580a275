"""Queries of extraction, graph building, cleaning and storing over a whole corpus of code.

The test tables hold no code, so each customer is written as a Java class, each supplier as a Python module, each part as
a Maven dependency and each nation as a YAML file. What the operators find again by their patterns is held against SQL
that states it from the tables' columns.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella import schema
from tessella.functions import text as X
from tessella.operators import catalog, engine, evaluation, extraction, graph, hygiene, models, resolution, search
from tessella.operators.search import Request
from tessella.plans.corpus import BM25, CHUNKS, NOW, PAGES, WORDS, corpus, rounded
from tessella.plans.fixtures import cte, frame
from tessella.plans.graph import LINKS, _adjacent, _fusion, _linked
from tessella.plans.graph import ORACLES as _graph
from tessella.sources import files, store
from tessella.sources.corpus import hierarchy

JAVA = """package com.seg{n};
import com.shop.n{n}.Nation{n};

@Service
public class Customer{k} extends Party{r} implements Payer, Buyer {{
  @Autowired
  private Nation{n} home;
  private Ledger ledger = new Ledger();
@GetMapping("/customers/{k}")
public String show{k}(int id) {{ return ""; }}
}}
"""
PYTHON = """from nation{n} import Nation{n}
import ledger

def load_supplier{k}(path):
    return path

class Supplier{k}(Nation{n}):
    pass
"""
MAVEN = "<dependency>\n  <groupId>org.size{n}</groupId>\n  <artifactId>part{k}</artifactId>\n</dependency>\n"
YAML = "region: ${{region{n}.name}}\n"
#: (table, key, other column, its name in ids, template, suffix, wing)
KINDS = (("customer", "c_custkey", "c_nationkey", 0, JAVA, ".java", "shop"), ("supplier", "s_suppkey", "s_nationkey", 1, PYTHON, ".py", "depot"), ("part", "p_partkey", "p_size", 2, MAVEN, ".xml", "shop"), ("nation", "n_nationkey", "n_regionkey", 3, YAML, ".yaml", "depot"))
SOURCES = tuple(k[0] for k in KINDS)


def filled(template: str, k: Column, n: Column) -> Column:
    """A template with its places as a column."""
    values, out = {"k": k.cast("string"), "n": n.cast("string"), "r": F.pmod(k, F.lit(5)).cast("string")}, []
    for part in re.split(r"(\{[knr]\})", template):
        out.append(values[part[1]] if re.fullmatch(r"\{[knr]\}", part) else F.lit(part.replace("{{", "{").replace("}}", "}")))
    return F.concat(*out)


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, path, wing, chunk_text) of the corpus of code."""
    c, out = corpus(spark, sf_dir), None
    for table, key, other, number, template, suffix, wing in KINDS:
        k = F.col(key).cast("long")
        rows = c.table(table).select((F.lit(number).cast("long") * 1_000_000_000 + k).alias("page_id"), F.concat(F.lit(f"{wing}/{table}/f"), k.cast("string"), F.lit(suffix)).alias("path"), F.lit(wing).alias("wing"), filled(template, k, F.col(other)).alias("chunk_text"))
        out = rows if out is None else out.unionAll(rows)
    return out


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(chunk_id, page_id, chunk_text), stored: a file is one chunk."""
    return corpus(spark, sf_dir).store("code-chunks", lambda: pages(spark, sf_dir).select((F.col("page_id") * 10).alias("chunk_id"), "page_id", "chunk_text"), of=SOURCES)


def with_ext(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks with the suffix of their page's path."""
    return chunks(spark, sf_dir).join(pages(spark, sf_dir).select("page_id", X.suffix(F.col("path")).alias("ext")), "page_id")


def extracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(chunk_id, ord, name, type) of names and then imports."""
    rows = chunks(spark, sf_dir)
    imported = extraction.imports(rows, "chunk_id", "chunk_text").distinct().select("chunk_id", F.lit(1 << 29).cast("long").alias("ord"), "name", "type")
    return extraction.entities(rows, "chunk_id", "chunk_text").select("chunk_id", "ord", "name", "type").unionByName(imported)


def built(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The stored graph of the corpus of code: entities, links, relations. What extraction finds is stored before: once for all three."""
    c, memo = corpus(spark, sf_dir), []

    def parts(i: int) -> DataFrame:
        if not memo:
            found = c.store("code-found", lambda: extracted(spark, sf_dir), of=SOURCES)
            inferred = c.store("code-inferred", lambda: extraction.relations(with_ext(spark, sf_dir), "chunk_id", "chunk_text", "ext"), of=SOURCES)
            memo.extend(graph.build(chunks(spark, sf_dir), found, inferred, resolution.resolve))
        return memo[i]

    return tuple(c.store(f"code-{name}", lambda i=i: parts(i), of=SOURCES) for i, name in enumerate(("entities", "links", "relations")))


# extraction and building


def extract_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.entities(chunks(spark, sf_dir), "chunk_id", "chunk_text").select("chunk_id", "name", "type")


def imports_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.imports(chunks(spark, sf_dir), "chunk_id", "chunk_text")


def relations_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.relations(with_ext(spark, sf_dir), "chunk_id", "chunk_text", "ext")


def classify_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_ext(spark, sf_dir)
    kind = extraction.classify(F.col("chunk_text"), F.col("ext"))
    return rows.select(kind.alias("kind")).groupBy("kind", extraction.mode_for(F.col("kind")).alias("mode")).agg(F.count("*").alias("chunks"))


def full_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extraction over all chunks: names by type, each name once with its first type, and where they stand."""
    found = extracted(spark, sf_dir).withColumn("name", F.col("name"))
    first = graph.first_types(found, ["chunk_id", "ord"])
    return found.groupBy("name").agg(F.countDistinct("chunk_id").alias("n")).join(first, "name").groupBy("type").agg(F.count("*").alias("names"), F.sum("n").alias("mentions"))


def graph_build_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    entities, linked, relations = built(spark, sf_dir)
    by = linked.groupBy(F.col("entity_id").alias("id")).agg(F.count("*").alias("chunks"))
    out = relations.groupBy(F.col("source_id").alias("id")).agg(F.count("*").alias("outgoing"))
    into = relations.groupBy(F.col("target_id").alias("id")).agg(F.count("*").alias("incoming"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return entities.join(by, "id", "left").join(out, "id", "left").join(into, "id", "left").select("name", "type", zero("chunks"), zero("outgoing"), zero("incoming"))


def graph_build_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A build that is kept to the first chunks by id."""
    rows = chunks(spark, sf_dir)
    entities, linked, _ = graph.build(rows, extracted(spark, sf_dir), extraction.relations(with_ext(spark, sf_dir), "chunk_id", "chunk_text", "ext"), resolution.resolve, most=25)
    return entities.join(linked.select(F.col("entity_id").alias("id"), "chunk_id"), "id").select("name", "chunk_id")


def relations_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of the stored graph by name, each once with the weight that was given last."""
    entities, _, relations = built(spark, sf_dir)
    names = lambda c, n: entities.select(F.col("id").alias(c), F.col("name").alias(n))
    return relations.join(names("source_id", "source"), "source_id").join(names("target_id", "target"), "target_id").select("source", "target", "type", "weight")


def first_name(texts: list[str]) -> list[str]:
    """Stands for a model that extracts: the first long capitalised word, as JSON in a fence."""
    found = [re.search("[A-Z][a-z]{5,}", t) for t in texts]
    return [f'```json\n{{"entities": [{{"name": "{m[0]}", "type": "class"}}, {{"name": "data", "type": "concept"}}], "relations": []}}\n```' if m else "no JSON" for m in found]


def extract_llm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities by a model's answers on all chunks of at least 100 characters, cut to 1,500."""
    e = engine.Engine().register("extract", "first-name", first_name)
    answered = e.extract(corpus(spark, sf_dir).stored_chunks.select("chunk_id", "chunk_text"), "chunk_text")
    return extraction.from_answers(answered, "chunk_id", "raw")[0].select("chunk_id", "name", "type")


# lists, lookups, samples


def entity_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = corpus(spark, sf_dir).table("customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("type"))
    return graph.listing(e, "BUILDING", limit=25, offset=10)


def entity_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, _, _ = built(spark, sf_dir)
    return graph.lookup(e, "Customer7").unionByName(graph.lookup(e, "no such name")).select("name", "type")


def chunk_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = corpus(spark, sf_dir).index.keyword_search(WORDS, 5)
    out = graph.of_chunks(_linked(spark, sf_dir), [r["chunk_id"] for r in first.collect()])  # five ids
    return rounded(out.withColumn("place", F.col("place").cast("long")), "relevance")


def links_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links whose relevance is given anew: events are the incoming ones, the last of a (user, type) counts."""
    e = corpus(spark, sf_dir).table("events")
    kind = F.ascii("event_type").cast("long")
    have = e.select(F.col("user_id").alias("entity_id"), F.lit(1).cast("long").alias("chunk_id")).distinct().withColumn("relevance", F.lit(1.0))
    return rounded(graph.relink(have, e.select(F.col("user_id").alias("entity_id"), kind.alias("chunk_id"), F.col("value").alias("relevance"), F.col("event_id").alias("seq"))), "relevance")


def chunk_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.sample(corpus(spark, sf_dir).stored_chunks.filter(F.length("chunk_text") > 80), 50, "chunk_id", seed=7).select("chunk_id", "wing")


def chunk_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.first_chunks(corpus(spark, sf_dir).stored_chunks).select("chunk_id", F.md5("chunk_text").alias("digest"))


# stored hierarchy


def _hierarchy(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Wings and rooms with ids, one wing and one room without pages among them."""
    wings, rooms = hierarchy(corpus(spark, sf_dir).pages)
    none = spark.createDataFrame([("empty", "none")], "wing string, room string")
    w = catalog.get_or_create(spark.createDataFrame([], "id long, name string"), wings.union(none.select("wing")).toDF("name"), ["name"])
    r = catalog.get_or_create(spark.createDataFrame([], "id long, wing string, room string"), rooms.union(none), ["wing", "room"])
    return w, r.join(w.select(F.col("id").alias("wing_id"), F.col("name").alias("wing")), "wing")


def stored_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages and chunks appended to stored tables, and read as chunks, pages, rooms and wings joined."""
    c = corpus(spark, sf_dir)
    wings, rooms = _hierarchy(spark, sf_dir)
    given = c.pages.join(rooms, ["wing", "room"]).select(F.col("page_id").alias("id"), F.col("id").alias("room_id"), F.concat(F.lit("doc-"), "page_id").alias("slug"), F.concat("wing", F.lit("/"), "room").alias("source_path"), F.lit("text").alias("source_kind"))
    folder = store.scratch(spark, "hierarchy")
    p = store.append(given, f"{folder}/pages", schema.PAGES)
    k = store.append(c.stored_chunks.select(F.col("chunk_id").alias("id"), "page_id", "chunk_index", "chunk_text", "token_count", X.terms(F.col("chunk_text")).alias("terms"), "created_at"), f"{folder}/chunks", schema.CHUNKS)
    rows = catalog.joined(k, p, rooms.select("id", "wing_id", F.col("room").alias("name")), wings)
    return rows.groupBy("wing", "room").agg(F.countDistinct("page_id").alias("pages"), F.count("*").alias("chunks"), F.sum("token_count").alias("tokens"), F.count("page_created_at").alias("dated"))


def wings_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    wings, _ = _hierarchy(spark, sf_dir)
    return catalog.wings(corpus(spark, sf_dir).pages, wings.select(F.col("name").alias("wing")))


def rooms_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, rooms = _hierarchy(spark, sf_dir)
    return catalog.rooms(corpus(spark, sf_dir).pages, all_rooms=rooms.select("wing", "room"))


def report_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report written as lines of JSON, and read back."""
    path = f"{store.scratch(spark, 'report')}/types"
    store.save_json(full_extract(spark, sf_dir), path)
    return spark.read.schema("type string, names long, mentions long").json(path)


# cleaning


def learn_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on all names with one to three links, each looked for again in all of its chunks."""
    e, linked, _ = built(spark, sf_dir)
    named = linked.join(e.select(F.col("id").alias("entity_id"), "name"), "entity_id")
    again = lambda rows: extraction.entities(rows, "chunk_id", "chunk_text")
    v = hygiene.learn_from_graph(e.select("name", "type"), named, chunks(spark, sf_dir), again, n=None, most=3, texts=None)
    return rounded(v.select("name", "type", "score", "status"), "score")


def fuse_cross_wing(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = frame(spark, "fx_entities")
    return hygiene.fusion(e, resolution.resolve, e.select("id", "wing"))


def fuse_timed(spark: SparkSession, sf_dir: str) -> DataFrame:
    report, _ = hygiene.timed_fusion(frame(spark, "fx_entities"), frame(spark, "fx_links"), frame(spark, "fx_relations"), resolution.resolve)
    return spark.createDataFrame([(k, int(v)) for k, v in report.items() if k != "runtime_ms"], "what string, n long")


# models and search


def observer_suspicious(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.plans.operations import calls

    return models.suspicious(calls(spark, sf_dir))


def models_configured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles from settings, written and read back."""
    given = corpus(spark, sf_dir).table("supplier").select(F.col("s_name").alias("name"), F.lit("hashing").alias("driver"), F.lit("embed, rerank").alias("capabilities"), F.lit(None).cast("string").alias("intelligence"), F.lit(None).cast("string").alias("cost_tier"), F.element_at(F.array(*(F.lit(x) for x in ("fast", "slow", "batch", None))), (F.pmod("s_suppkey", F.lit(4)) + 1).cast("int")).alias("speed_tier"), F.when(F.col("s_suppkey") % 10 == 0, 77.0).alias("avg_latency_ms"))
    rows = models.from_config(given).withColumn("capabilities", F.map_from_arrays("capabilities", F.transform("capabilities", lambda x: F.lit(True))))
    path = f"{store.scratch(spark, 'profiles')}/models"
    files.save_profiles(rows, path)
    out = files.profiles(spark, path)
    return out.select("name", "intelligence", "cost_tier", "speed_tier", "avg_latency_ms", F.size("capabilities").cast("long").alias("capabilities"))


def latency_cold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timings of each kind of event, a user's first one being cold."""
    e = corpus(spark, sf_dir).table("events")
    first = e.groupBy("user_id", "event_type").agg(F.min("event_id").alias("event_id")).withColumn("cold", F.lit(True))
    rows = e.join(first, ["user_id", "event_type", "event_id"], "left").select("event_type", F.coalesce("cold", F.lit(False)).alias("cold"), F.col("value").alias("ms"))
    return rounded(evaluation.latency(rows, "event_type", "cold"), "avg_ms", "min_ms", "max_ms")


def softmax_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events as shares by the softmax of their values."""
    e = corpus(spark, sf_dir).table("events")
    return rounded(e.select("event_id", X.softmax(F.col("value"), Window.partitionBy("user_id"), 50.0).alias("share")), "share")


def driver_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = corpus(spark, sf_dir).table("supplier").select(F.element_at(F.array(*(F.lit(x) for x in ("ollama", "vllm", "openai"))), (F.pmod("s_suppkey", F.lit(3)) + 1).cast("int")).alias("driver"), F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("http://localhost:"), "s_suppkey")).alias("url"))
    return rows.groupBy("driver", X.cost_of(F.col("driver"), F.col("url")).alias("cost")).agg(F.count("*").alias("n"))


def search_command(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole command: a query's vector by a driver, both lists, and propagation over the stored graph."""
    c = corpus(spark, sf_dir)
    vector = list(c.table("embeddings").filter("vec_id = 0").first()["embedding"])
    out = engine.command(c.stored_chunks, c.embeddings, c.index, Request(WORDS, top_k=20, now=NOW), lambda texts: [vector for _ in texts], _linked(spark, sf_dir).select("chunk_id", F.col("name").alias("entity")), _adjacent(spark, sf_dir))
    return rounded(out.select("chunk_id", "score"), "score")


QUERIES = {f.__name__: f for f in (extract_corpus, imports_corpus, relations_corpus, classify_code, full_extract, graph_build_corpus, graph_build_first, relations_merged, extract_llm, entity_list, entity_lookup, chunk_entities, links_upsert, chunk_sample, chunk_first, stored_hierarchy, wings_all, rooms_all, report_json, learn_graph, fuse_cross_wing, fuse_timed, observer_suspicious, models_configured, latency_cold, softmax_rows, driver_costs, search_command)}

# what the files state, from the tables' columns
_cus = "SELECT c_custkey * 10 AS chunk_id, c_custkey AS k, c_nationkey AS n FROM customer"
_sup = "SELECT (1000000000 + s_suppkey) * 10 AS chunk_id, s_suppkey AS k, s_nationkey AS n FROM supplier"
_par = "SELECT (2000000000 + p_partkey) * 10 AS chunk_id, p_partkey AS k, p_size AS n FROM part"
_nat = "SELECT (3000000000 + n_nationkey) * 10 AS chunk_id, n_nationkey AS k, n_regionkey AS n FROM nation"
NAMES = f"""names AS (
 SELECT chunk_id, 0 AS ord, 'Customer' || k AS name, 'class' AS type FROM ({_cus})
 UNION ALL SELECT chunk_id, 6, 'show' || k, 'function' FROM ({_cus}) UNION ALL SELECT chunk_id, 9, 'com.seg' || n, 'module' FROM ({_cus})
 UNION ALL SELECT chunk_id, 11, '/customers/' || k, 'api' FROM ({_cus}) UNION ALL SELECT chunk_id, 14, 'ledger', 'variable' FROM ({_cus})
 UNION ALL SELECT chunk_id, 0, 'Supplier' || k, 'class' FROM ({_sup}) UNION ALL SELECT chunk_id, 8, 'load_supplier' || k, 'function' FROM ({_sup}))"""
IMPORTS = f"""imps AS (SELECT chunk_id, 'Nation' || n AS name, 'class' AS type FROM ({_cus}) UNION ALL SELECT chunk_id, 'n' || n, 'module' FROM ({_cus}))"""
RELATIONS = f"""rels AS (
 SELECT chunk_id, 'Customer' || k AS source, 'Party' || (k % 5) AS target, 'extends' AS type, 1.0::DOUBLE AS weight FROM ({_cus})
 UNION ALL SELECT chunk_id, 'Customer' || k, unnest(['Payer', 'Buyer']), 'implements', 1.0 FROM ({_cus})
 UNION ALL SELECT chunk_id, 'Nation' || n, 'home', 'depends_on', 1.0 FROM ({_cus})
 UNION ALL SELECT chunk_id, '/customers/' || k, 'GET', 'serves_path', 1.0 FROM ({_cus}) UNION ALL SELECT chunk_id, 'show' || k, '/', 'serves_path', 0.8 FROM ({_cus})
 UNION ALL SELECT chunk_id, 'Customer' || k, 'service', 'is_a', 0.9 FROM ({_cus})
 UNION ALL SELECT chunk_id, 'Nation' || n, 'home', 'has_field', 0.7 FROM ({_cus}) UNION ALL SELECT chunk_id, 'Ledger', 'ledger', 'has_field', 0.7 FROM ({_cus})
 UNION ALL SELECT chunk_id, 'Nation' || n, 'n' || n, 'imports', 0.6 FROM ({_cus})
 UNION ALL SELECT chunk_id, 'Nation' || n, 'nation' || n, 'imports', 0.5 FROM ({_sup}) UNION ALL SELECT chunk_id, 'ledger', 'ledger', 'imports', 0.5 FROM ({_sup})
 UNION ALL SELECT chunk_id, 'part' || k, 'org.size' || n, 'depends_on', 0.8 FROM ({_par})
 UNION ALL SELECT chunk_id, 'region' || n || '.name', 'config', 'configures', 0.4 FROM ({_nat}))"""
# YAML files are too short to be looked at
GRAPH = f"""{NAMES}, {IMPORTS}, {RELATIONS}, found AS (SELECT * FROM names UNION ALL SELECT chunk_id, 1000, name, type FROM imps),
edges AS (SELECT * FROM rels WHERE type <> 'configures'),
every AS (SELECT * FROM found UNION ALL SELECT chunk_id, 2000, source, 'class' FROM edges UNION ALL SELECT chunk_id, 2001, target, 'module' FROM edges),
ents AS (SELECT name, arg_min(type, chunk_id * 10000 + ord) AS type FROM every GROUP BY name),
lnks AS (SELECT DISTINCT name, chunk_id FROM found), eds AS (SELECT source, target, type, arg_max(weight, chunk_id) AS weight FROM edges GROUP BY source, target, type)"""
BUILT = f"WITH {GRAPH} SELECT name, type, (SELECT count(*) FROM lnks l WHERE l.name = e.name) AS chunks, (SELECT count(*) FROM eds d WHERE d.source = e.name) AS outgoing, (SELECT count(*) FROM eds d WHERE d.target = e.name) AS incoming FROM ents e"
TYPES = f"WITH {GRAPH}, t AS (SELECT name, arg_min(type, chunk_id * 10000 + ord) AS type, count(DISTINCT chunk_id) AS n FROM found GROUP BY name) SELECT type, count(*) AS names, sum(n)::BIGINT AS mentions FROM t GROUP BY type"
_calls = "calls AS (SELECT user_id AS model, event_id AS seq, value AS latency_ms, event_type <> 'error' AS success, (event_id % 7)::DOUBLE AS entities, event_id % 5 <> 0 AS json_valid FROM events)"

ORACLES = {
    "extract_corpus": f"WITH {NAMES} SELECT chunk_id, name, type FROM names",
    "imports_corpus": f"WITH {IMPORTS} SELECT * FROM imps",
    "relations_corpus": f"WITH {RELATIONS} SELECT * FROM rels",
    "classify_code": "SELECT 'code' AS kind, 'regex' AS mode, (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) AS chunks UNION ALL SELECT 'config', '1.5b', (SELECT count(*) FROM part) + (SELECT count(*) FROM nation)",
    "full_extract": TYPES,
    "report_json": TYPES,
    "graph_build_corpus": BUILT,
    "graph_build_first": f"WITH {GRAPH} SELECT name, chunk_id FROM lnks WHERE chunk_id IN (SELECT chunk_id FROM ({_cus}) ORDER BY chunk_id LIMIT 25)",
    "relations_merged": f"WITH {GRAPH} SELECT * FROM eds",
    "extract_llm": f"WITH {CHUNKS} SELECT chunk_id, name, 'class' AS type FROM (SELECT chunk_id, regexp_extract(substr(chunk_text, 1, 1500), '[A-Z][a-z]{{5,}}') AS name FROM chunks WHERE length(chunk_text) >= 100) WHERE name <> '' AND length(name) <= 80 AND lower(name) NOT IN ({', '.join(repr(x) for x in schema.GENERIC)})",
    "entity_list": "SELECT c_custkey AS id, c_name AS name, c_mktsegment AS type FROM customer WHERE c_mktsegment = 'BUILDING' ORDER BY c_custkey LIMIT 25 OFFSET 10",
    "entity_lookup": "SELECT 'Customer7' AS name, 'class' AS type",
    "links_upsert": "SELECT DISTINCT user_id AS entity_id, 1::BIGINT AS chunk_id, 1.0::DOUBLE AS relevance FROM events UNION ALL SELECT user_id, ascii(event_type)::BIGINT, round(arg_max(value, event_id), 6) FROM events GROUP BY 1, 2",
    "chunk_sample": f"WITH {CHUNKS} SELECT chunk_id, wing FROM chunks WHERE length(chunk_text) > 80 ORDER BY md5('7:' || chunk_id), chunk_id LIMIT 50",
    "chunk_first": f"WITH {CHUNKS} SELECT chunk_id, md5(chunk_text) AS digest FROM chunks WHERE length(chunk_text) > 80 ORDER BY page_id, chunk_index LIMIT 100",
    "stored_hierarchy": f"WITH {CHUNKS} SELECT wing, room, count(DISTINCT page_id) AS pages, count(*) AS chunks, sum(token_count)::BIGINT AS tokens, count(*) AS dated FROM chunks GROUP BY wing, room",
    "wings_all": f"WITH {PAGES} SELECT wing, count(DISTINCT room) AS rooms, count(*) AS pages FROM pgs GROUP BY wing UNION ALL SELECT 'empty', 0, 0",
    "rooms_all": f"WITH {PAGES} SELECT wing, room, count(*) AS pages FROM pgs GROUP BY wing, room UNION ALL SELECT 'empty', 'none', 0",
    "learn_graph": f"WITH {GRAPH}, few AS (SELECT name FROM lnks GROUP BY name HAVING count(*) <= 3), k AS (SELECT e.name, e.type, e.name IN (SELECT name FROM names) AS again FROM ents e JOIN few USING (name)) SELECT name, type, CASE WHEN again THEN round(1.0::DOUBLE / 4.85::DOUBLE, 6) ELSE 0.0 END AS score, CASE WHEN again THEN 'suspicious' ELSE 'rejected' END AS status FROM k",
    "fuse_cross_wing": f"WITH {_fusion.split('mapping AS')[0]}wide AS (SELECT canonical FROM named GROUP BY canonical HAVING count(DISTINCT wing) > 1), m AS (SELECT id, first_value(id) OVER (PARTITION BY canonical ORDER BY p, id) AS keeper, canonical FROM named WHERE canonical IN (SELECT canonical FROM wide)) SELECT id, keeper, canonical FROM m WHERE id <> keeper",
    "fuse_timed": f"WITH {_fusion}, {cte('fx_links', 'fx_relations')}, l AS (SELECT DISTINCT coalesce(g.keeper, entity_id) AS e, chunk_id FROM fx_links LEFT JOIN gone g ON g.id = entity_id), r AS (SELECT DISTINCT coalesce(a.keeper, source_id) AS s, coalesce(b.keeper, target_id) AS t, type FROM fx_relations LEFT JOIN gone a ON a.id = source_id LEFT JOIN gone b ON b.id = target_id WHERE coalesce(a.keeper, source_id) <> coalesce(b.keeper, target_id)) SELECT 'duplicates' AS what, (SELECT count(*) FROM gone) AS n UNION ALL SELECT 'entities_before', count(*) FROM fx_entities UNION ALL SELECT 'entities_after', count(*) - (SELECT count(*) FROM gone) FROM fx_entities UNION ALL SELECT 'links_before', count(*) FROM fx_links UNION ALL SELECT 'links_after', count(*) FROM l UNION ALL SELECT 'relations_before', count(*) FROM fx_relations UNION ALL SELECT 'relations_after', count(*) FROM r",
    "observer_suspicious": f"WITH {_calls}, w AS (SELECT model, seq, row_number() OVER o AS n, avg(latency_ms) OVER (o ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS recent, avg(latency_ms) OVER (o ROWS BETWEEN 19 PRECEDING AND 5 PRECEDING) AS before FROM calls WINDOW o AS (PARTITION BY model ORDER BY seq)), l AS (SELECT model, arg_max(n >= 10 AND coalesce(recent > 2 * before, false), seq) AS latency FROM w GROUP BY model), s AS (SELECT model, count(*) AS c, count(*) FILTER (NOT success) AS e, count(*) FILTER (NOT json_valid) AS b, list_reduce(list_prepend(0.0::DOUBLE, list(entities ORDER BY seq)), lambda s, x: s * 0.9::DOUBLE + x * 0.1::DOUBLE) AS m FROM calls GROUP BY model), r AS (SELECT model, latency, c >= 10 AND m < 0.5 AS entities, c >= 20 AND e > 0.1 * c AS errors, c >= 10 AND b > 0.2 * c AS json FROM s JOIN l USING (model)) SELECT *, latency OR entities OR errors OR json AS suspicious FROM r",
    "models_configured": "SELECT s_name AS name, 'medium' AS intelligence, 'low' AS cost_tier, CASE s_suppkey % 4 WHEN 0 THEN 'fast' WHEN 1 THEN 'slow' WHEN 2 THEN 'batch' ELSE 'medium' END AS speed_tier, CASE WHEN s_suppkey % 10 = 0 THEN 77.0::DOUBLE ELSE CASE s_suppkey % 4 WHEN 0 THEN 50.0::DOUBLE WHEN 1 THEN 5000.0::DOUBLE WHEN 2 THEN 15000.0::DOUBLE ELSE 1000.0::DOUBLE END END AS avg_latency_ms, 2::BIGINT AS capabilities FROM supplier",
    "latency_cold": "WITH f AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) = 1 AS cold FROM events) SELECT event_type, cold, count(*) AS n, round(avg(value), 6) AS avg_ms, round(min(value), 6) AS min_ms, round(max(value), 6) AS max_ms FROM f GROUP BY event_type, cold",
    "softmax_rows": "SELECT event_id, round(exp((value - max(value) OVER w) / 50) / sum(exp(value / 50)) OVER w * exp(max(value) OVER w / 50), 6) AS share FROM events WINDOW w AS (PARTITION BY user_id)",
    "driver_costs": "SELECT driver, cost, count(*) AS n FROM (SELECT CASE s_suppkey % 3 WHEN 0 THEN 'ollama' WHEN 1 THEN 'vllm' ELSE 'openai' END AS driver, CASE WHEN s_suppkey % 3 < 2 OR s_suppkey % 2 = 0 THEN 'free' ELSE 'medium' END AS cost FROM supplier) GROUP BY ALL",
    "search_command": f"SELECT chunk_id, combined AS score FROM ({_graph['propagate_rerank']})",
    "chunk_entities": f"WITH {CHUNKS}, {BM25}, {LINKS} SELECT chunk_id, name, round(relevance, 6) AS relevance, row_number() OVER (PARTITION BY chunk_id ORDER BY relevance DESC, name) AS place FROM lnk WHERE chunk_id IN (SELECT chunk_id FROM bm ORDER BY score DESC, chunk_id LIMIT 5)",
}
