"""What the corpus operators share: reading, scratch tables, Arrow helpers and components of a link graph."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Upper bound of one Arrow batch sent to a Python worker.
BATCH_ROWS, BATCH_BYTES = 8192, 6 << 20


def setup(spark: SparkSession) -> SparkSession:
    """Lets Python workers find this package and keeps Arrow batches small enough for long texts."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return setup(spark).read.parquet(f"{sf_dir}/{name}.parquet")


_written: list[str] = []


def scratch_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; a temporary folder only where none is set (local tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = f"file://{tempfile.gettempdir()}/tessella-scratch"
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return path.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one, which is deleted when the session's process ends."""
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    _written.append(path)
    return path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: cuts the lineage and survives lost executors.

    The table is deleted when the session's process ends, if release() or keep_last() hasn't done so before.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder through Hadoop's file systems, so that any store works."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def release(spark: SparkSession, since: int = 0) -> None:
    """Deletes the scratch tables written in this session from number `since` on; no DataFrame may need them any more."""
    while len(_written) > since:
        delete(spark, _written.pop())


def keep_last(spark: SparkSession, since: int) -> None:
    """Deletes the scratch tables from number `since` on but for the last one, which no longer needs them."""
    last = _written.pop()
    release(spark, since)
    _written.append(last)


def written() -> int:
    return len(_written)


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def map_batches(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    return df.mapInArrow(f, schema)


def batch(names: list[str], *columns: object) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names)


def remainder(id_col: Column, n: int) -> Column:
    """crc32 of an id's decimal text, modulo n; null for a null id."""
    return F.crc32(id_col.cast("string").cast("binary")) % n


def text_bytes(df: DataFrame, text: str = "text") -> int:
    """Bytes of all texts: one pass over one column."""
    return df.agg(F.coalesce(F.sum(F.octet_length(text).cast("long")), F.lit(0))).first()[0]


def ordered_ids(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, bool]:
    """docs as (ord, doc_id, text) with a unique `ord` in doc_id order, and whether ord is not simply doc_id.

    Where ids are unique and not null, ord is doc_id: no shuffle of texts. Otherwise rows are numbered in the order
    (doc_id with null first, text), so repeated rows get neighbouring numbers; ties between identical rows are free.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    clash = rows.groupBy("doc_id").count().filter("doc_id is null or count > 1").limit(1).count()
    if not clash:
        return rows.select(F.col("doc_id").alias("ord"), "doc_id", "text"), False
    from pyspark.sql import Window

    digest = F.coalesce(F.xxhash64("text"), F.lit(0))
    keyed = materialise(rows.select("doc_id", "text", digest.alias("h")).repartitionByRange(F.col("doc_id").asc_nulls_first(), F.col("h")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "h", "text").select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("local")), "ordered")
    # one row for each partition: a running total of so few rows fits one task
    sizes = keyed.groupBy("part").agg(F.count("*").alias("n"), F.min("local").alias("first"))
    before = sizes.select("part", "first", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    return keyed.join(F.broadcast(before), "part").select((F.col("local") - F.col("first") + F.col("before")).alias("ord"), "doc_id", "text"), True


def hubs(keys: DataFrame, on: list[str]) -> list:
    """Keys (longs) of more than 1,000 rows and more than a 20,000th of all, with the tasks to spread each over: 20,000 at most."""
    counted = keys.groupBy(*on).agg(F.count("*").alias("n"))
    total = counted.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    limit = max(1000, total // 20_000)
    return counted.filter(F.col("n") > limit).select(*on, F.ceil(F.col("n") / limit).cast("long").alias("salts")).collect() if total > limit else []


def hub_join(rows: DataFrame, per_key: DataFrame, on: list[str], heavy: list | None = None) -> DataFrame:
    """rows joined with per_key, which has one row for each key; a key with very many rows is spread over several tasks.

    `heavy` are these keys, as hubs() gives them, where they have been counted already.
    """
    heavy = hubs(rows, on) if heavy is None else heavy
    if not heavy:
        return rows.join(per_key.hint("merge"), on)
    salts = F.broadcast(rows.sparkSession.createDataFrame(heavy, ", ".join(f"{c} long" for c in [*on, "salts"])))
    others = [c for c in rows.columns if c not in on]
    dealt = rows.join(salts, on, "left").withColumn("salt", F.when(F.col("salts").isNotNull(), F.pmod(F.xxhash64(*others), "salts")).otherwise(0)).drop("salts")
    copies = per_key.join(salts, on, "left").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")
    return dealt.join(copies.hint("merge"), [*on, "salt"]).drop("salt")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of links (a, b) of longs: rows (node, root), root the least node reachable, roots left out.

    Alternating large-star and small-star steps (Kiveris et al. 2014): O(log n) rounds. A node's least neighbour comes
    from a partial aggregation, and a hub's links are joined with it in several tasks. The rounds' links are written to
    the shared folder; nothing is collected but two numbers to see when links stop to change, and a bounded list of hubs.
    """
    since = written()
    links = materialise(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "links")
    seen = None
    while True:
        state = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            break
        seen = state
        both = links.union(links.select("b", "a"))
        heavy = hubs(both.select("a"), ["a"])  # a node has no more links in what follows
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = hub_join(both.filter("b > a"), least, ["a"], heavy).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = hub_join(large, low, ["a"], heavy).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").union(low.select("a", F.col("m").alias("b"))).distinct()
        links = materialise(small, "links")
    keep_last(edges.sparkSession, since)
    return links.select(F.col("a").alias("node"), F.col("b").alias("root"))


def group_starts(keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys begins in a sorted array."""
    return np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
