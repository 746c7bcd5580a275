"""Keeping the graph clean: votes on names, merging, fusing, pruning and describing entities."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella import schema
from tessella.functions.text import rank_of

# Shares of the votes from which on a name has a status.
CONFIRMED, UNCERTAIN, SUSPICIOUS = 0.65, 0.35, 0.15


def status_of(score: Column) -> Column:
    return F.when(score >= CONFIRMED, "confirmed").when(score >= UNCERTAIN, "uncertain").when(score >= SUSPICIOUS, "suspicious").otherwise("rejected")


def consensus(detections: DataFrame, modes: Sequence[str] = tuple(schema.MODE_WEIGHTS)) -> DataFrame:
    """Verdicts on names: the share of the available modes' weights that found a name, and who did and who did not.

    detections: (name, type, mode, found, seq). Votes that found nothing don't count; the first found type stays.
    """
    votes = detections.filter("found").groupBy("name", "mode").agg(F.min(F.struct("seq", "type")).alias("first"))
    by_name = votes.groupBy("name").agg(F.min("first").alias("first"), F.sum(rank_of(F.col("mode"), schema.MODE_WEIGHTS, schema.DEFAULT_WEIGHT)).alias("sum"), F.sort_array(F.collect_set("mode")).alias("confirmed_by"))  # at most one value a mode
    return judged(by_name.select("name", "first.type", "sum", "confirmed_by"), modes)


def judged(votes: DataFrame, modes: Sequence[str]) -> DataFrame:
    """Verdicts on names by their votes (name, type, sum of weights, confirmed_by)."""
    total = sum(schema.MODE_WEIGHTS.get(m, schema.DEFAULT_WEIGHT) for m in modes)
    every = F.array(*(F.lit(m) for m in sorted(modes)))
    score = F.col("sum") / F.lit(total)
    return votes.select("name", "type", score.alias("score"), "confirmed_by", F.array_except(every, "confirmed_by").alias("rejected_by"), status_of(F.round(score, 9)).alias("status"))


def learned(existing: DataFrame, verdicts: DataFrame, at: str) -> DataFrame:
    """The learning table after some verdicts: the latest score and lists stay, eval_count goes up by one."""
    new = verdicts.select(F.col("name").alias("entity_name"), F.col("type").alias("entity_type"), F.col("score").cast("float").alias("consensus_score"), "status", "confirmed_by", "rejected_by", F.lit(at).cast("timestamp").alias("last_evaluated_at"), F.lit(1).alias("eval_count"))
    both = existing.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    keys, rest = ["entity_name", "entity_type"], ["consensus_score", "status", "confirmed_by", "rejected_by", "last_evaluated_at"]
    return both.groupBy(*keys).agg(F.max_by(F.struct(*rest), "__new").alias("r"), F.sum("eval_count").cast("int").alias("eval_count")).select(*keys, *(f"r.{c}" for c in rest), "eval_count")


def edge_entities(entities: DataFrame, links: DataFrame, most: int = 3, n: int | None = 200) -> DataFrame:
    """Entities (name) with few links, the fewest first: what to look at again. Without n all of them, in no order."""
    counted = links.groupBy("name").agg(F.count("*").alias("links"))
    rows = entities.join(counted, "name", "left").withColumn("links", F.coalesce("links", F.lit(0))).filter(F.col("links") <= most)
    return rows if n is None else rows.orderBy("links", "name").limit(n)


def context(links: DataFrame, chunks: DataFrame, n: int = 3, each: int = 500, most: int = 1500) -> DataFrame:
    """(name, context): the texts of each entity's most relevant chunks, cut and joined.

    Chunks are picked before texts are joined, so what moves is at most n texts for an entity.
    """
    best = links.withColumn("place", F.row_number().over(Window.partitionBy("name").orderBy(F.desc("relevance"), "chunk_id"))).filter(F.col("place") <= n)
    texts = best.join(chunks.select("chunk_id", F.substring("chunk_text", 1, each).alias("text")), "chunk_id")
    rows = F.sort_array(F.collect_list(F.struct("place", "text")))
    return texts.groupBy("name").agg(F.substring(F.array_join(F.transform(rows, lambda x: x["text"]), "\n---\n"), 1, most).alias("context"))


def enrich(contexts: DataFrame, describe: Callable[[str, str], str], least: int = 5) -> DataFrame:
    """(name, description) by a model's function of (name, context); shorter answers and failures are left out."""

    def run(frames):
        for pdf in frames:
            out = []
            for name, text in zip(pdf["name"], pdf["context"]):
                try:
                    out.append(describe(name, text))
                except Exception:
                    out.append(None)
            yield pd.DataFrame({"name": pdf["name"], "description": out})

    return contexts.select("name", "context").mapInPandas(run, "name string, description string").filter(F.length(F.trim("description")) > least)


def learn_from_graph(entities: DataFrame, links: DataFrame, chunks: DataFrame, extract: Callable[[DataFrame], DataFrame], n: int | None = None, most: int = 3, texts: int | None = None, mode: str = "regex", modes: Sequence[str] = tuple(schema.MODE_WEIGHTS)) -> DataFrame:
    """Verdicts on entities (name, type) with few links: each is looked for again in its chunks.

    `extract` gives (chunk_id, name) of chunks (chunk_id, chunk_text). Entities without chunks get no verdict; a name that
    is found again has the vote of `mode` among the available `modes`, one that is not found anywhere a score of 0.
    With n, the n entities with the fewest links are looked for; without it all of them, and nothing is sent to all tasks.
    With `texts`, only so many chunks of an entity are read, the first by id; without it all of them.
    """
    picked = edge_entities(entities.select("name", "type"), links, most, n).filter("links > 0")
    places = most if texts is None else min(texts, most)  # no entity that is looked for has more than `most` links
    first = lambda rows: rows.withColumn("place", F.row_number().over(Window.partitionBy("name").orderBy("chunk_id"))).filter(F.col("place") <= places)
    if n is None:
        near = first(links).join(picked, "name")  # of a frequent name, only the first rows of each task move
        read = chunks.select("chunk_id", "chunk_text").join(near.select("chunk_id"), "chunk_id", "left_semi")
    else:
        near = first(links.join(F.broadcast(picked), "name"))  # n names at most
        read = chunks.select("chunk_id", "chunk_text").join(F.broadcast(near.select("chunk_id").distinct()), "chunk_id")
    again = extract(read).select("chunk_id", "name", F.lit(True).alias("again"))
    looked = near.select("chunk_id", "name", "type").join(again, ["chunk_id", "name"], "left")
    by_name = looked.groupBy("name").agg(F.min("type").alias("type"), F.max(F.coalesce("again", F.lit(False))).alias("found"))
    weight, none = schema.MODE_WEIGHTS.get(mode, schema.DEFAULT_WEIGHT), F.array().cast("array<string>")
    votes = by_name.select("name", "type", F.when(F.col("found"), weight).otherwise(0.0).alias("sum"), F.when(F.col("found"), F.array(F.lit(mode))).otherwise(none).alias("confirmed_by"))
    return judged(votes, modes)  # found or not, from one pass


def merge_weight(mode: Column) -> Column:
    return rank_of(mode, schema.MERGE_WEIGHTS, schema.DEFAULT_WEIGHT)


def effective_weight(weight: Column, mode: Column) -> Column:
    return F.least(F.coalesce(weight, F.lit(schema.DEFAULT_WEIGHT)), merge_weight(mode))


def merge_entities(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """(name, type, mode) sets by name: the heavier mode's row stays, the existing one of equally heavy; all modes are kept."""
    rows = existing.select("name", "type", "mode", F.lit(0).alias("seq")).unionByName(incoming.select("name", "type", "mode", F.lit(1).alias("seq")))
    best = F.max_by(F.struct("type", "mode"), F.struct(merge_weight(F.col("mode")), -F.col("seq"), "type")).alias("best")
    return rows.groupBy("name").agg(best, F.sort_array(F.collect_set("mode")).alias("modes_seen")).select("name", "best.type", "best.mode", "modes_seen")


def merge_relations(existing: DataFrame, incoming: DataFrame, mode: str) -> DataFrame:
    """Existing relations, and those incoming ones that are new, at their weight times the mode's."""
    key = ["source", "target", "type"]
    new = incoming.dropDuplicates(key).join(existing.select(key), key, "left_anti")
    return existing.select(*key, "weight").unionByName(new.select(*key, (F.col("weight") * schema.MERGE_WEIGHTS.get(mode, schema.DEFAULT_WEIGHT)).alias("weight")))


def without_rejected(entities: DataFrame, learning: DataFrame) -> DataFrame:
    bad = learning.filter(F.col("status") == "rejected").select(F.lower("entity_name").alias("__low")).distinct()
    return entities.withColumn("__low", F.lower("name")).join(bad, "__low", "left_anti").drop("__low")


def fusion(entities: DataFrame, resolve: Callable[[Column], Column], places: DataFrame | None = None) -> DataFrame:
    """(id, keeper, canonical) of entities that another one with the same resolved name replaces.

    The best type stays, of equal types the least id. With `places` (id, wing), only names in more than one wing fuse.
    """
    named = entities.withColumn("canonical", F.lower(resolve(F.col("name"))))
    if places is not None:
        wide = named.select("id", "canonical").join(places, "id").groupBy("canonical").agg(F.countDistinct("wing").alias("wings")).filter("wings > 1")
        named = named.join(wide, "canonical", "left_semi")
    first = F.min(F.struct(rank_of(F.col("type"), schema.TYPE_PRIORITY, 5).alias("p"), F.col("id").alias("id"))).alias("first")
    keepers = named.groupBy("canonical").agg(first, F.count("*").alias("n")).filter("n >= 2").select("canonical", F.col("first.id").alias("keeper"))
    return named.join(keepers, "canonical").filter("id <> keeper").select("id", "keeper", "canonical")


def fuse(entities: DataFrame, links: DataFrame, relations: DataFrame, mapping: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All three tables after a fusion: links and relations go over to the keepers, once each; no relation of a keeper to itself stays."""
    to = mapping.select("id", "keeper")
    moved = links.join(to.withColumnRenamed("id", "entity_id"), "entity_id", "left").select(F.coalesce("keeper", "entity_id").alias("entity_id"), "chunk_id", "relevance")
    linked = moved.groupBy("entity_id", "chunk_id").agg(F.max("relevance").alias("relevance"))
    ends = relations
    for end in ("source_id", "target_id"):
        ends = ends.join(to.withColumnsRenamed({"id": end, "keeper": f"k_{end}"}), end, "left").withColumn(end, F.coalesce(f"k_{end}", end)).drop(f"k_{end}")
    fused = ends.filter("source_id <> target_id").groupBy("source_id", "target_id", "type").agg(F.max("weight").alias("weight"))
    return entities.join(mapping.select("id"), "id", "left_anti"), linked, fused


def timed_fusion(entities: DataFrame, links: DataFrame, relations: DataFrame, resolve: Callable[[Column], Column], places: DataFrame | None = None, dry_run: bool = False) -> tuple[dict, tuple[DataFrame, DataFrame, DataFrame]]:
    """A scheduled fusion: what it did (duplicates, rows before and after, milliseconds), and the three tables after it.

    A dry run tells what would be done and leaves the tables as they are.
    """
    began = time.perf_counter()
    mapping = fusion(entities, resolve, places)
    after = fuse(entities, links, relations, mapping)
    report = {"duplicates": mapping.count()}
    for name, old, new in zip(("entities", "links", "relations"), (entities, links, relations), after):
        report[f"{name}_before"], report[f"{name}_after"] = old.count(), new.count()
    report["runtime_ms"] = (time.perf_counter() - began) * 1000
    return report, (entities, links, relations) if dry_run else after


def sparse_noise(entities: DataFrame, links: DataFrame, least: int = 2) -> DataFrame:
    """(id, name, links, reason) of entities with few links whose names say nothing."""
    counted = links.groupBy(F.col("entity_id").alias("id")).agg(F.count("*").alias("links"))
    rows = entities.join(counted, "id", "left").withColumn("links", F.coalesce("links", F.lit(0))).filter(F.col("links") < least)
    name, low = F.col("name"), F.lower("name")
    lower_only = (name == low) & name.rlike(r"(?U)\p{Ll}")
    reason = F.when(low.isin(*schema.STOP_ENTITIES), "stop-word").when(name.rlike(r"^[a-z]{2,4}$"), "too-short").when(name.rlike(r"^[0-9.]+$"), "numeric").when((F.col("links") == 1) & lower_only & (F.length("name") < 5), "weak-noise")
    return rows.withColumn("reason", reason).filter("reason is not null").select("id", "name", "links", "reason")


def orphans(entities: DataFrame, links: DataFrame, relations: DataFrame, now: str, days: int = 30) -> DataFrame:
    """Entities older than some days without links and relations."""
    ends = relations.select(F.col("source_id").alias("id")).union(relations.select("target_id")).distinct()
    old = entities.filter(F.unix_timestamp("created_at") < F.unix_timestamp(F.lit(now).cast("timestamp")) - days * 86400)
    return old.join(links.select(F.col("entity_id").alias("id")).distinct(), "id", "left_anti").join(ends, "id", "left_anti")


def lowered(entities: DataFrame, links: DataFrame, to: float = 0.3) -> DataFrame:
    """(id, name, weight, status): entities of the weakest modes without a weak link are set to a low weight."""
    mode = F.try_element_at("metadata", F.lit("mode"))
    marked = F.try_element_at("metadata", F.lit("status"))
    weak = links.filter(F.col("relevance") < 0.5).select(F.col("entity_id").alias("id")).distinct()
    rows = entities.filter(mode.isin("1.5b", "7b") & ~marked.eqNullSafe(F.lit("pruned")))
    return rows.join(weak, "id", "left_anti").select("id", "name", F.lit(to).alias("weight"), F.lit("pruned").alias("status"))
