"""Catalog queries over wings, rooms, pages and chunks, and snapshot upserts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def percent(part: Column, whole: Column) -> Column:
    """Whole percents, rounded down; 0 of nothing."""
    return F.when(whole == 0, F.lit(0)).otherwise(F.floor(part * 100 / whole)).cast("long")


def totals(pages: DataFrame, chunks: DataFrame, embedded: DataFrame) -> DataFrame:
    """One row: numbers of wings, rooms, pages, chunks, chunks with a vector, and their whole percents."""
    p = pages.agg(F.countDistinct("wing").alias("wings"), F.countDistinct("wing", "room").alias("rooms"), F.count("*").alias("pages"))
    c = chunks.agg(F.count("*").alias("chunks"))
    e = embedded.agg(F.count("*").alias("embedded"))
    return p.crossJoin(c).crossJoin(e).withColumn("embedding_percent", percent(F.col("embedded"), F.col("chunks")))  # one row each


def wings(pages: DataFrame, all_wings: DataFrame | None = None) -> DataFrame:
    """(wing, rooms, pages); wings without pages only if `all_wings` names them."""
    counted = pages.groupBy("wing").agg(F.countDistinct("room").alias("rooms"), F.count("*").alias("pages"))
    return counted if all_wings is None else all_wings.join(counted, "wing", "left").fillna(0, ["rooms", "pages"])


def rooms(pages: DataFrame, wing: str | None = None, all_rooms: DataFrame | None = None) -> DataFrame:
    """(wing, room, pages); rooms without pages only if `all_rooms` names them."""
    inside = lambda df: df if wing is None else df.filter(F.col("wing") == wing)
    counted = inside(pages).groupBy("wing", "room").agg(F.count("*").alias("pages"))
    return counted if all_rooms is None else inside(all_rooms).join(counted, ["wing", "room"], "left").fillna(0, ["pages"])


def joined(chunks: DataFrame, pages: DataFrame, rooms: DataFrame, wings: DataFrame) -> DataFrame:
    """Stored chunks with their page's, room's and wing's names, over the four stored tables; rooms and wings are small."""
    p = pages.select(F.col("id").alias("page_id"), "room_id", "slug", "source_path", F.col("created_at").alias("page_created_at"))
    r = rooms.select(F.col("id").alias("room_id"), "wing_id", F.col("name").alias("room"))
    w = wings.select(F.col("id").alias("wing_id"), F.col("name").alias("wing"))
    return chunks.join(p, "page_id").join(r, "room_id").join(w, "wing_id").drop("room_id", "wing_id")


def page_list(pages: DataFrame, chunks: DataFrame, room: str, limit: int = 100, offset: int = 0) -> DataFrame:
    """Pages of a room by id with their numbers of chunks; chunks are counted for these pages only."""
    page = pages.filter(F.col("room") == room).select("page_id", "wing", "room").orderBy("page_id").offset(offset).limit(limit)
    counted = chunks.join(F.broadcast(page.select("page_id")), "page_id", "left_semi").groupBy("page_id").agg(F.count("*").alias("chunk_count")) if limit <= 10_000 else chunks.groupBy("page_id").agg(F.count("*").alias("chunk_count"))
    return page.join(counted, "page_id", "left").select("page_id", "wing", "room", F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"))


def rollup(pages: DataFrame) -> DataFrame:
    """Pages and characters by wing and room, by wing, and in all."""
    return pages.rollup("wing", "room").agg(F.count("*").alias("pages"), F.sum("n_chars").alias("chars"), F.grouping_id().alias("level"))


def top_rooms(pages: DataFrame, n: int = 5) -> DataFrame:
    counted = rooms(pages)
    return counted.withColumn("place", F.row_number().over(Window.partitionBy("wing").orderBy(F.desc("pages"), "room"))).filter(F.col("place") <= n)


def upsert(existing: DataFrame, incoming: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """A new snapshot in which the latest row of each key stays: of incoming rows the last by `order`, else the existing.

    Both need the same columns besides `order`, which only incoming rows have.
    """
    rows = existing.withColumn(order, F.lit(None).cast(incoming.schema[order].dataType)).unionByName(incoming)
    rest = [c for c in rows.columns if c not in keys]
    last = F.max_by(F.struct(*rest), F.struct(F.col(order).isNotNull(), F.col(order))).alias("row")
    return rows.groupBy(*keys).agg(last).select(*keys, *(f"row.{c}" for c in rest if c != order))


def get_or_create(existing: DataFrame, names: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Existing rows (id, *keys) and new ones for keys that have none; a new id is a hash of the key, the same every time."""
    new = names.select(*keys).distinct().join(existing.select(*keys), list(keys), "left_anti")
    return existing.unionByName(new.select(F.xxhash64(*keys).alias("id"), *keys), allowMissingColumns=True)


def without(rows: DataFrame, gone: DataFrame, **on: str) -> DataFrame:
    """Rows none of whose columns refers to an id that is gone: without(relations, ids, source_id="id", target_id="id")."""
    for column, key in on.items():
        rows = rows.join(gone.select(F.col(key).alias(column)).distinct(), column, "left_anti")
    return rows


def merge_description(entities: DataFrame, described: DataFrame) -> DataFrame:
    """Puts (id, description) into the metadata maps of entities; keeps all other keys."""
    added = entities.join(described.select("id", F.col("description").alias("__new")), "id", "left")
    old = F.map_filter(F.coalesce("metadata", F.create_map().cast("map<string,string>")), lambda k, v: k != "description")
    return added.withColumn("metadata", F.when(F.col("__new").isNotNull(), F.map_concat(old, F.create_map(F.lit("description"), F.col("__new")))).otherwise(F.col("metadata"))).drop("__new")


def missing_description(entities: DataFrame) -> DataFrame:
    value = F.try_element_at("metadata", F.lit("description"))
    return entities.filter(F.coalesce(value, F.lit("")) == "")


def as_of(facts: DataFrame, at: Column | str) -> DataFrame:
    """Facts that hold at a time: from valid_from on, before valid_to if there is one."""
    t = F.lit(at).cast("timestamp") if isinstance(at, str) else at
    return facts.filter((F.col("valid_from") <= t) & (F.col("valid_to").isNull() | (t < F.col("valid_to"))))
