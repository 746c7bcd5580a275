"""Derived tables that are written once and read by many queries, in the folder that all executors share."""

from __future__ import annotations

import hashlib
import re
import tempfile
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder only where none is set and driver and executors are one process."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = f"file://{tempfile.gettempdir()}"
    return path.rstrip("/")


def file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one, which is deleted when the session's process ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    fs, at = file_system(spark, path)
    fs.deleteOnExit(at)
    return path


def written(df: DataFrame, name: str, partition: Sequence[str] = ()) -> DataFrame:
    """df as a Parquet table below the shared folder, read back: made once, whatever reads it."""
    path = scratch(df.sparkSession, name)
    df.write.partitionBy(*partition).parquet(path) if partition else df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def state(spark: SparkSession, path: str) -> str:
    """What tells whether the files below a path are the same as before: their names, lengths and times."""
    fs, at = file_system(spark, path)
    files, found = fs.listFiles(at, True), []
    while files.hasNext():
        f = files.next()
        found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return hashlib.sha256(repr(sorted(found)).encode()).hexdigest()


_tables: dict[tuple[str, str, str], DataFrame] = {}


def stored(spark: SparkSession, sources: Sequence[str], name: str, make: Callable[[], DataFrame], partition: Sequence[str] = ()) -> DataFrame:
    """The table `name` made of files below the paths `sources`: written on first use, anew if these files have changed."""
    key = (spark.sparkContext.applicationId, name, "|".join(state(spark, p) for p in sources))
    if key not in _tables:
        _tables[key] = written(make(), name, partition)
    return _tables[key]


def save_json(df: DataFrame, path: str) -> None:
    """A report or profiles as lines of JSON; nulls are kept as such."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def append(df: DataFrame, path: str, schema: str) -> DataFrame:
    """Appends rows to a stored table; columns that df lacks are null, created_at is now where it is missing."""
    kept = df if "created_at" in df.columns else df.withColumn("created_at", F.current_timestamp())
    fields = df.sparkSession.createDataFrame([], schema).schema
    out = kept.select(*(F.col(f.name).cast(f.dataType).alias(f.name) if f.name in kept.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in fields))
    out.write.mode("append").parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)
