"""The knowledge graph: building it from chunks, and questions to it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NAME = r"[A-Z][a-z]{5,}"


def mentions(chunks: DataFrame, pattern: str = NAME) -> DataFrame:
    """(chunk_id, place, name) of names in texts, in order."""
    return chunks.select("chunk_id", F.posexplode(F.regexp_extract_all("chunk_text", F.lit(pattern), F.lit(0))).alias("place", "name"))


def links(found: DataFrame) -> DataFrame:
    """(chunk_id, name, relevance): a name's mentions in a chunk by those of the chunk's most frequent name."""
    n = found.groupBy("chunk_id", "name").agg(F.count("*").alias("n"))
    return n.select("chunk_id", "name", (F.col("n") / F.max("n").over(Window.partitionBy("chunk_id"))).alias("relevance"))


def adjacent(found: DataFrame) -> DataFrame:
    """(source, target, weight): names that follow each other in a chunk, and how often; linear in the mentions."""
    after = found.withColumn("target", F.lead("name").over(Window.partitionBy("chunk_id").orderBy("place")))
    return after.filter("target is not null").groupBy(F.col("name").alias("source"), "target").agg(F.count("*").alias("weight"))


def first_types(found: DataFrame, order: list[str]) -> DataFrame:
    """(name, type): the type that a name was first seen with, by the order columns."""
    return found.groupBy("name").agg(F.min_by("type", F.struct(*order)).alias("type"))


def kind_of(name: Column) -> Column:
    return F.when(name.endswith("er"), "class").when(name.endswith("ing"), "function").otherwise("concept")


def eligible(chunks: DataFrame, min_chars: int = 80, most: int | None = None) -> DataFrame:
    """Chunks that extraction looks at: longer than some characters; with `most`, the first so many by id."""
    rows = chunks.filter(F.length("chunk_text") > min_chars)
    return rows if most is None else rows.orderBy("chunk_id").limit(most)


def build(chunks: DataFrame, extracted: DataFrame, inferred: DataFrame, resolve, min_chars: int = 80, most: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entities (id, name, type), links (entity_id, chunk_id, relevance) and relations (source_id, target_id, type, weight).

    `extracted` has (chunk_id, ord, name, type), `inferred` (chunk_id, source, target, type, weight), `resolve` maps a
    name column to its canonical one. The first chunk and place decide on a name's type. Names that only relations
    know are classes as sources and modules as targets; edges with an empty end are dropped; of edges given more than
    once the last chunk's weight stays.
    """
    looked_at = eligible(chunks, min_chars, most).select("chunk_id")
    found = extracted.join(looked_at, "chunk_id", "left_semi").withColumn("name", resolve(F.col("name")))
    edges = inferred.join(looked_at, "chunk_id", "left_semi").filter("source <> '' and target <> ''")
    ends = edges.select("chunk_id", F.lit(1 << 30).alias("ord"), F.col("source").alias("name"), F.lit("class").alias("type")).unionByName(edges.select("chunk_id", F.lit((1 << 30) + 1).alias("ord"), F.col("target").alias("name"), F.lit("module").alias("type")))
    entities = first_types(found.select("chunk_id", "ord", "name", "type").unionByName(ends), ["chunk_id", "ord"]).select(F.xxhash64("name").alias("id"), "name", "type")
    linked = found.select(F.xxhash64("name").alias("entity_id"), "chunk_id").distinct().withColumn("relevance", F.lit(1.0))
    relations = edges.groupBy("source", "target", "type").agg(F.max_by("weight", "chunk_id").alias("weight")).select(F.xxhash64("source").alias("source_id"), F.xxhash64("target").alias("target_id"), "type", "weight")
    return entities, linked, relations


def bulk_import(entities: DataFrame, relations: DataFrame, linked: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows by name -> rows by id; relations (source, target, type, weight) and links (name, chunk_id) of unknown names are dropped."""
    ids = entities.groupBy("name").agg(F.min_by("type", "ord").alias("type")).select(F.xxhash64("name").alias("id"), "name", "type")
    named = lambda c, i: ids.select(F.col("name").alias(c), F.col("id").alias(i))
    rel = relations.join(named("source", "source_id"), "source").join(named("target", "target_id"), "target")
    return ids, rel.select("source_id", "target_id", "source", "target", "type", "weight"), linked.join(named("name", "entity_id"), "name").select("entity_id", "name", "chunk_id")


def degrees(relations: DataFrame) -> DataFrame:
    """(id, degree): relations that begin or end at an entity; one that does both counts once."""
    ends = relations.select(F.col("source").alias("id")).union(relations.filter("source <> target").select("target"))
    return ends.groupBy("id").agg(F.count("*").alias("degree"))


def top_degrees(relations: DataFrame, n: int = 10) -> DataFrame:
    return degrees(relations).orderBy(F.desc("degree"), "id").limit(n)


def type_counts(entities: DataFrame) -> DataFrame:
    return entities.groupBy("type").agg(F.count("*").alias("n"))


def relations_of(relations: DataFrame, entity, direction: str = "both") -> DataFrame:
    out, into = F.col("source") == entity, F.col("target") == entity
    return relations.filter({"outgoing": out, "incoming": into, "both": out | into}[direction])


def listing(entities: DataFrame, kind: str | None = None, limit: int = 100, offset: int = 0, key: str = "id") -> DataFrame:
    """Entities by id, of one type if wanted: a page of the list."""
    rows = entities if kind is None else entities.filter(F.col("type") == kind)
    return rows.orderBy(key).offset(offset).limit(limit)


def lookup(entities: DataFrame, value, key: str = "name") -> DataFrame:
    """The entity of a name or an id; no row if there is none."""
    return entities.filter(F.col(key) == value).limit(1)


def of_chunks(linked: DataFrame, chunk_ids) -> DataFrame:
    """(chunk_id, name, relevance) of some chunks' entities, the most relevant first within a chunk: all chunks at once."""
    rows = linked.filter(F.col("chunk_id").isin(list(chunk_ids)))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("chunk_id").orderBy(F.desc("relevance"), "name")))


def relink(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Links (entity_id, chunk_id, relevance) after incoming ones (also seq): the last relevance of a link overwrites it."""
    rows = existing.withColumn("seq", F.lit(None).cast("long")).unionByName(incoming.withColumn("seq", F.col("seq").cast("long")))
    return rows.groupBy("entity_id", "chunk_id").agg(F.max_by("relevance", F.struct(F.col("seq").isNotNull(), "seq")).alias("relevance"))


def find(entities: DataFrame, query: str, kind: str | None = None, limit: int = 20) -> DataFrame:
    """Entities whose name holds the query in any case (with % and _ as wildcards), the shortest names first."""
    rows = entities.filter(F.col("name").ilike(f"%{query}%"))
    rows = rows if kind is None else rows.filter(F.col("type") == kind)
    return rows.orderBy(F.length("name"), "name").limit(limit)


def with_chunk_counts(entities: DataFrame, linked: DataFrame, most: int | None = None) -> DataFrame:
    """Adds `chunks`, the number of links; for a short list of entities only their links are counted."""
    counted = linked.groupBy("name").agg(F.count("*").alias("chunks"))
    n = F.coalesce("chunks", F.lit(0))
    return entities.join(counted, "name", "left").withColumn("chunks", n if most is None else F.least(n, F.lit(most)))


def detail(entities: DataFrame, relations: DataFrame, linked: DataFrame, chunks: DataFrame, name: str, limit: int = 50) -> DataFrame:
    """Rows (part, text, value) on one entity: its type, its relations with arrows, previews of its best chunks.

    An unknown name is answered by rows of part `maybe` with names that hold it.
    """
    me = entities.filter(F.col("name") == name)
    own = me.select(F.lit("entity").alias("part"), F.col("name").alias("text"), F.col("type").alias("value"))
    rel = relations_of(relations, name).select(F.lit("relation").alias("part"), F.when(F.col("source") == name, F.concat(F.lit("→ "), "target")).otherwise(F.concat(F.lit("← "), "source")).alias("text"), F.col("weight").cast("string").alias("value"))
    best = linked.filter(F.col("name") == name).orderBy(F.desc("relevance"), "chunk_id").limit(limit)
    shown = chunks.join(F.broadcast(best), "chunk_id").select(F.lit("chunk").alias("part"), F.translate(F.substring("chunk_text", 1, 150), "\n", " ").alias("text"), F.col("chunk_id").cast("string").alias("value"))
    maybe = find(entities, name).join(F.broadcast(me.agg(F.count("*").alias("n"))), F.expr("n = 0")).select(F.lit("maybe").alias("part"), F.col("name").alias("text"), F.col("type").alias("value"))
    return own.unionAll(rel).unionAll(shown).unionAll(maybe)


def related_chunks(linked: DataFrame, chunk_id: int, limit: int = 20, depth: int = 1, relations: DataFrame | None = None) -> DataFrame:
    """Chunks by the number of entities shared with one chunk, then by mean relevance; deeper, entities grow by relations."""
    mine = linked.filter(F.col("chunk_id") == chunk_id).select("name").distinct()
    for _ in range(depth - 1):
        both = relations.select("source", "target").union(relations.select("target", "source")).toDF("name", "next")
        mine = mine.union(both.join(mine, "name", "left_semi").select("next")).distinct()
    others = linked.filter(F.col("chunk_id") != chunk_id).join(mine, "name", "left_semi")
    return others.groupBy("chunk_id").agg(F.countDistinct("name").alias("shared"), F.avg("relevance").alias("relevance")).orderBy(F.desc("shared"), F.desc("relevance"), "chunk_id").limit(limit)


def subgraph(relations: DataFrame, start, max_depth: int = 2, max_nodes: int = 50) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, depth) around a vertex and edges (source, target, type) among them, by breadth-first search.

    Each level keeps the least ids as far as `max_nodes` goes, so what is broadcast has at most that many rows. Edges
    have both ends among the nodes, one of them at a depth below max_depth.
    """
    spark = relations.sparkSession
    nodes = spark.createDataFrame([(start, 0)], f"id {relations.schema['source'].dataType.simpleString()}, depth int")
    both = relations.select("source", "target").union(relations.select("target", "source")).toDF("id", "next")
    for depth in range(1, max_depth + 1):
        last = nodes.filter(F.col("depth") == depth - 1)
        new = both.join(F.broadcast(last.select("id")), "id", "left_semi").select(F.col("next").alias("id")).distinct().join(F.broadcast(nodes.select("id")), "id", "left_anti")
        kept = new.orderBy("id").limit(max_nodes).withColumn("depth", F.lit(depth))
        nodes = nodes.unionByName(kept).orderBy("depth", "id").limit(max_nodes)
    near = F.broadcast(nodes)
    edges = relations.select("source", "target", "type").distinct()
    edges = edges.join(near.select(F.col("id").alias("source"), F.col("depth").alias("a")), "source").join(near.select(F.col("id").alias("target"), F.col("depth").alias("b")), "target")
    return nodes, edges.filter(F.least("a", "b") < max_depth).select("source", "target", "type")


def to_json(nodes: DataFrame, edges: DataFrame, centre) -> DataFrame:
    """One row: the subgraph as JSON {center, nodes, edges}."""
    n = nodes.agg(F.sort_array(F.collect_list(F.struct("depth", "id"))).alias("nodes"))
    e = edges.agg(F.sort_array(F.collect_list(F.struct("source", "target", "type"))).alias("edges"))
    return n.crossJoin(e).select(F.to_json(F.struct(F.lit(centre).alias("center"), "nodes", "edges")).alias("json"))


def to_ascii(nodes: DataFrame, edges: DataFrame, centre, descriptions: dict | None = None) -> str:
    """The subgraph as a tree of text, by depth; at most `max_nodes` rows are collected."""
    descriptions = descriptions or {}
    depth = {r["id"]: r["depth"] for r in nodes.collect()}
    arrows = {}
    for r in edges.collect():
        arrows.setdefault(r["source"], []).append(f"→ {r['target']} [{r['type']}]")
        arrows.setdefault(r["target"], []).append(f"← {r['source']} [{r['type']}]")
    out = []
    for node in sorted(depth, key=lambda n: (depth[n], str(n))):
        text = str(descriptions.get(node, ""))[:60]
        out.append("  " * depth[node] + f"{'*' if node == centre else '-'} {node}" + (f": {text}" if text else ""))
        out += ["  " * (depth[node] + 1) + a for a in sorted(arrows.get(node, []))]
    return "\n".join(out)


def neighbours(entities: DataFrame, relations: DataFrame, linked: DataFrame, n: int = 30) -> DataFrame:
    """Edges of the first n entities by name, with the radius that a drawing gives to their source."""
    first = entities.orderBy("name").limit(n).select(F.col("name").alias("source"))
    counted = with_chunk_counts(first.withColumnRenamed("source", "name"), linked).select(F.col("name").alias("source"), (5 + 3 * F.sqrt("chunks")).alias("radius"))
    return relations.join(F.broadcast(counted), "source").select("source", "target", "radius")
