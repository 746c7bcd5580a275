"""Streams of events: windows with watermarks, incremental ingest, and running metrics of models."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessella.sources.store import scratch

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def read(spark: SparkSession, path: str, schema: str = EVENTS, late: str = "1 hour") -> DataFrame:
    """Event files as a stream with a watermark; time zones are the session's (UTC)."""
    return spark.readStream.schema(schema).parquet(path).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def tumbling(events: DataFrame, width: str = "1 day") -> DataFrame:
    return events.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sliding(events: DataFrame, width: str = "6 hours", step: str = "3 hours") -> DataFrame:
    return events.groupBy(F.window("ts", width, step).alias("w")).agg(F.count("*").alias("n"), F.max("value").alias("top"))


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    return events.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))


def drain(stream: DataFrame, mode: str = "complete", checkpoint: str | None = None) -> DataFrame:
    """Runs a stream over all input there is and returns its result, for batch use and tests.

    Each batch is written below the shared folder under its number, so a repeated one replaces itself; of a complete
    stream the last batch is the result, of others all batches are. No result passes through the driver.
    """
    folder, numbers = scratch(stream.sparkSession, "stream"), []

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")
        numbers.append(number)

    query = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", checkpoint or f"{folder}-checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    if query.exception():
        raise RuntimeError(str(query.exception()))
    reader = stream.sparkSession.read.schema(stream.schema)
    if not numbers:
        return stream.sparkSession.createDataFrame([], stream.schema)
    return reader.parquet(*(f"{folder}/batch={n}" for n in (numbers[-1:] if mode == "complete" else numbers)))


def ingest(documents: DataFrame, upsert: Callable[[DataFrame, int], None], checkpoint: str):
    """Pushed documents, batch by batch, into an upsert; a repeated batch has the same number, so it can be told."""
    query = documents.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


OBSERVED = "model string, calls long, recent_ms double, before_ms double, ewma double, errors long, bad_json long, probe boolean, suspicious boolean"
STATE = "calls long, errors long, bad_json long, ewma double, last array<double>, wait long, since long"


def observe(calls: DataFrame, alpha: float = 0.1, first: int = 50, most: int = 400) -> DataFrame:
    """Running metrics of each model (model, seq, latency_ms, success, entities, json_valid): its last 20 latencies, errors and mean.

    `probe` tells whether the calls since the last probe reached the wait, which doubles with each probe up to a limit;
    `suspicious` whether one of the rules of models.suspicious holds after the batch.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, errors, bad, mean, last, wait, since = state.get if state.exists else (0, 0, 0, 0.0, [], first, 0)
        last, probe = list(last), False
        rows = pd.concat(list(frames)).sort_values("seq")
        for ms, ok, found, valid in zip(rows["latency_ms"], rows["success"], rows["entities"], rows["json_valid"]):
            n, since, errors, bad, mean = n + 1, since + 1, errors + (not ok), bad + (not valid), mean * (1 - alpha) + alpha * float(found)
            last = [*last, float(ms)][-20:]
            if since >= wait:
                probe, since, wait = True, 0, min(2 * wait, most)
        state.update((n, errors, bad, mean, last, wait, since))
        recent, before = sum(last[-5:]) / len(last[-5:]), sum(last[:-5]) / len(last[:-5]) if last[:-5] else None
        odd = len(last) >= 10 and recent > 2 * before or n >= 10 and (mean < 0.5 or bad > 0.2 * n) or n >= 20 and errors > 0.1 * n
        yield pd.DataFrame({"model": [key[0]], "calls": [n], "recent_ms": [recent], "before_ms": [before], "ewma": [mean], "errors": [errors], "bad_json": [bad], "probe": [probe], "suspicious": [odd]})

    return calls.groupBy("model").applyInPandasWithState(run, OBSERVED, STATE, "update", GroupStateTimeout.NoTimeout)
