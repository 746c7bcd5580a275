"""Queries on model choice, observation, evaluation and streams."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella import schema
from tessella.functions import text as X
from tessella.operators import engine, evaluation, extraction, models
from tessella.plans.corpus import CHUNKS, corpus, rounded
from tessella.plans.fixtures import cte, frame
from tessella.streaming import events as streams

# model choice


def _profiles(spark: SparkSession) -> DataFrame:
    return models.with_latency(frame(spark, "fx_models"), frame(spark, "fx_health"))


def model_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.select(frame(spark, "fx_capabilities"), _profiles(spark)).withColumn("position", F.col("position").cast("long"))


def model_rank_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.select(frame(spark, "fx_capabilities"), _profiles(spark), 3).withColumn("position", F.col("position").cast("long"))


def model_relax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.relax(frame(spark, "fx_capabilities")).drop("candidates")


def model_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    ms = F.col("avg_latency_ms")
    return _profiles(spark).select("name", ms, X.speed_of(ms).alias("tier"))


# observation: events as calls of models


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as calls: the user is the model, the value the latency, an error a failure."""
    e = corpus(spark, sf_dir).table("events")
    return e.select(F.col("user_id").alias("model"), F.col("event_id").alias("seq"), F.col("value").alias("latency_ms"), (F.col("event_type") != "error").alias("success"), F.pmod("event_id", F.lit(7)).cast("double").alias("entities"), (F.pmod("event_id", F.lit(5)) != 0).alias("json_valid"))


def observer_rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = models.rolling(calls(spark, sf_dir)).select("model", "seq", "recent", "before", "doubled")
    return rounded(out, "recent", "before")


def observer_anomaly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.rates(calls(spark, sf_dir))


def observer_ewma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(models.ewma(calls(spark, sf_dir)), "ewma")


def oscillation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = calls(spark, sf_dir)
    last = rows.withColumn("k", F.row_number().over(Window.partitionBy("model").orderBy(F.desc("seq")))).filter("k <= 5")
    five = last.groupBy("model").agg(F.sort_array(F.collect_list(F.struct("seq", X.speed_of(F.col("latency_ms") * 100).alias("tier")))).alias("h"))  # five rows a model
    return five.select("model", models.oscillating(F.transform("h", lambda x: x["tier"]), F.size("h")).alias("oscillating"))


def probe_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = calls(spark, sf_dir).groupBy("model").agg(F.avg(F.col("success").cast("double")).alias("accuracy"))
    return by.select("model", X.intelligence_of(F.col("accuracy") - 0.3).alias("level"))


def cache_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = corpus(spark, sf_dir).table("events").select((F.col("event_type") == "view").alias("hit"))
    return models.hit_rate(e)


def embed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine.Engine().register("embed", "hashing", engine.hashing_embedder(64))
    out = e.embed(corpus(spark, sf_dir).chunks.select("chunk_id", "chunk_text"), "chunk_text", 64)
    return rounded(out.select("chunk_id", F.size("embedding").cast("long").alias("size"), X.norm(F.col("embedding"), 64).alias("norm")), "norm", digits=3)


#: Texts with the names that an extractor has to find.
GOLDEN = (
    ("public class OrderService { }", ["OrderService"]), ("class Ledger extends Book {}\nclass Page {}", ["Ledger", "Page"]), ("def load_rows(path):\n    pass", ["load_rows"]),
    ("package com.shop.pay;", ["com.shop.pay"]), ('@GetMapping("/api/v1/list")', ["/api/v1/list"]), ("the quick brown fox", ["Fox", "Animal", "Quick"]),
)


def probe_extractor(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(GOLDEN)], "sample long, text string")
    samples = spark.createDataFrame([(i, n) for i, (_, names) in enumerate(GOLDEN) for n in names], "sample long, name string")
    found = extraction.entities(texts, "sample", "text").select(F.lit("regex").alias("model"), "sample", "name")
    times = spark.createDataFrame([("regex", 5.0), ("regex", 7.0)], "model string, ms double")
    return rounded(engine.probe(samples, found, times), "accuracy")


# evaluation


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = corpus(spark, sf_dir)
    docs = c.table("documents").select("doc_id", "lang", "n_chars")
    return docs.join(c.table("labels"), "doc_id")


def eval_prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _labelled(spark, sf_dir)
    found = rows.filter("n_chars > 500").select("doc_id", F.lit("long").alias("mode")).unionByName(rows.filter("n_chars > 2000").select("doc_id", F.lit("longer").alias("mode")))
    return evaluation.against_gold(found, rows.filter("quality = 1"), ["doc_id"], "mode")


def eval_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.pivot(_labelled(spark, sf_dir), "lang", "quality", [0, 1]).select("lang", F.col("0").alias("low"), F.col("1").alias("high"))


def eval_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _labelled(spark, sf_dir)
    out = evaluation.noise_samples(rows.filter("n_chars > 500"), rows.filter("quality = 1"), ["doc_id"], "lang")
    return out.withColumn("place", F.col("place").cast("long"))


def eval_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _labelled(spark, sf_dir)
    return evaluation.overlap(rows.filter("n_chars > 500"), rows.filter("quality = 1"), ["doc_id"])


def gold_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.gold_set(_labelled(spark, sf_dir), F.col("quality") + F.col("toxic") == 1, ["doc_id"])


def eval_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = corpus(spark, sf_dir).table("events").select("event_type", F.col("value").alias("ms"))
    return rounded(evaluation.latency(e, "event_type"), "avg_ms", "min_ms", "max_ms")


# streams

#: As a pattern, since a file stream reads folders and patterns only.
EVENT_FILES = "{}/event[s].parquet"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.read(spark, EVENT_FILES.format(sf_dir))


def _window(df: DataFrame) -> DataFrame:
    return df.withColumns({"start": F.date_format("w.start", "yyyy-MM-dd HH:mm:ss"), "end": F.date_format("w.end", "yyyy-MM-dd HH:mm:ss")}).drop("w")


def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_window(streams.drain(streams.tumbling(_events(spark, sf_dir)))), "total", digits=4)


def stream_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_window(streams.drain(streams.sliding(_events(spark, sf_dir)))), "top", digits=4)


def stream_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _window(streams.drain(streams.sessions(_events(spark, sf_dir))))


def stream_observer(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.readStream.schema(streams.EVENTS).parquet(EVENT_FILES.format(sf_dir))
    rows = e.select(F.col("user_id").cast("string").alias("model"), F.col("event_id").alias("seq"), F.col("value").alias("latency_ms"), (F.col("event_type") != "error").alias("success"), F.pmod("event_id", F.lit(7)).cast("double").alias("entities"), (F.pmod("event_id", F.lit(5)) != 0).alias("json_valid"))
    return rounded(streams.drain(streams.observe(rows), "update").groupBy("model").agg(*(F.max_by(c, "calls").alias(c) for c in ("errors", "ewma", "recent_ms")), F.max("calls").alias("calls")), "ewma", "recent_ms")


QUERIES = {f.__name__: f for f in (model_select, model_rank_n, model_relax, model_latency, observer_rolling, observer_anomaly, observer_ewma, oscillation, probe_levels, embed_chunks, probe_extractor, cache_hits, eval_prf, eval_pivot, eval_noise, eval_overlap, gold_set, eval_latency, stream_tumbling, stream_sliding, stream_session, stream_observer)}

_case = lambda column, table, default: f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in table.items()) + f" ELSE {default} END"
_profile = f"""{cte("fx_models", "fx_health", "fx_capabilities")}, prof AS (SELECT m.* REPLACE (least(coalesce(avg_latency_ms, {_case("speed_tier", models.LATENCY, 1000.0)}::DOUBLE), h.latency_ms) AS avg_latency_ms) FROM fx_models m LEFT JOIN fx_health h USING (name))"""
_rank = lambda c: _case(c, schema.INTELLIGENCE, 0)
_price = lambda c: _case(c, schema.COST, 0)
_select = f"""{_profile}, cand AS (SELECT capability, min_intelligence AS mi, max_cost AS mc, max_latency_ms AS ml, objective, unnest(candidates) AS name, unnest(range(0, len(candidates)::BIGINT)) AS place FROM fx_capabilities),
fit AS (SELECT c.*, {_rank("p.intelligence")} AS i, {_price("p.cost_tier")} AS co, p.avg_latency_ms AS ms, p.oscillating AS os, {_rank("coalesce(mi, 'low')")} AS ri, {_price("coalesce(mc, 'free')")} AS rc FROM cand c JOIN prof p USING (name) WHERE p.healthy),
judged AS (SELECT *, i >= ri AND co <= rc AND ms <= coalesce(ml, 99999) AND NOT os AS strict, i >= CASE WHEN mi IS NULL THEN ri ELSE greatest(ri - 1, 0) END AND co <= CASE WHEN mc IS NULL THEN rc ELSE least(rc + 1, 3) END AND ms <= coalesce(ml * 3, 99999) AND NOT os AS relaxed FROM fit),
ranked AS (SELECT *, row_number() OVER (PARTITION BY capability ORDER BY strict DESC, CASE objective WHEN 'speed' THEN ms WHEN 'quality' THEN -i ELSE co END, place) AS position, bool_or(strict) OVER (PARTITION BY capability) AS any_strict FROM judged WHERE strict OR relaxed)"""
_calls = "calls AS (SELECT user_id AS model, event_id AS seq, value AS latency_ms, event_type <> 'error' AS success, (event_id % 7)::DOUBLE AS entities, event_id % 5 <> 0 AS json_valid FROM events)"
_lab = "lab AS (SELECT d.doc_id, d.lang, d.n_chars, l.quality, l.toxic FROM documents d JOIN labels l USING (doc_id))"
_win = lambda s, e: f"strftime({s}, '%Y-%m-%d %H:%M:%S') AS start, strftime({e}, '%Y-%m-%d %H:%M:%S') AS \"end\""
ORACLES = {
    "model_select": f"WITH {_select} SELECT capability, position, name, CASE WHEN strict THEN 'strict' ELSE 'relaxed' END AS how FROM ranked WHERE (strict OR NOT any_strict) AND position <= 1",
    "model_rank_n": f"WITH {_select} SELECT capability, position, name, CASE WHEN strict THEN 'strict' ELSE 'relaxed' END AS how FROM ranked WHERE (strict OR NOT any_strict) AND position <= 3",
    "model_relax": f"WITH {cte('fx_capabilities')} SELECT capability, CASE min_intelligence WHEN 'very_high' THEN 'high' WHEN 'high' THEN 'medium' WHEN 'medium' THEN 'low' WHEN 'low' THEN 'low' END AS min_intelligence, CASE max_cost WHEN 'free' THEN 'low' WHEN 'low' THEN 'medium' WHEN 'medium' THEN 'high' WHEN 'high' THEN 'high' END AS max_cost, max_latency_ms * 3 AS max_latency_ms, objective FROM fx_capabilities",
    "model_latency": f"WITH {_profile} SELECT name, avg_latency_ms, CASE WHEN avg_latency_ms < 100 THEN 'fast' WHEN avg_latency_ms < 2000 THEN 'medium' WHEN avg_latency_ms < 10000 THEN 'slow' ELSE 'batch' END AS tier FROM prof",
    "observer_rolling": f"WITH {_calls}, w AS (SELECT model, seq, row_number() OVER o AS n, avg(latency_ms) OVER (o ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS recent, avg(latency_ms) OVER (o ROWS BETWEEN 19 PRECEDING AND 5 PRECEDING) AS before FROM calls WINDOW o AS (PARTITION BY model ORDER BY seq)) SELECT model, seq, round(recent, 6) AS recent, round(before, 6) AS before, n >= 10 AND coalesce(recent > 2 * before, false) AS doubled FROM w",
    "observer_anomaly": f"WITH {_calls}, s AS (SELECT model, count(*) AS calls, count(*) FILTER (NOT success) AS errors, count(*) FILTER (NOT json_valid) AS bad_json FROM calls GROUP BY model) SELECT *, calls >= 20 AND errors > 0.1 * calls AS error_anomaly, calls >= 10 AND bad_json > 0.2 * calls AS json_anomaly FROM s",
    "observer_ewma": f"WITH {_calls} SELECT model, round(list_reduce(list_prepend(0.0::DOUBLE, list(entities ORDER BY seq)), lambda s, x: s * 0.9::DOUBLE + x * 0.1::DOUBLE), 6) AS ewma FROM calls GROUP BY model",
    "oscillation": f"WITH {_calls}, l AS (SELECT model, count(*) OVER (PARTITION BY model) AS n, row_number() OVER (PARTITION BY model ORDER BY seq DESC) AS k, CASE WHEN latency_ms * 100 < 100 THEN 0 WHEN latency_ms * 100 < 2000 THEN 1 WHEN latency_ms * 100 < 10000 THEN 2 ELSE 3 END AS v FROM calls) SELECT model, max(n) >= 2 AND count(DISTINCT v) FILTER (k <= 5) >= 3 AS oscillating FROM l GROUP BY model",
    "probe_levels": f"WITH {_calls}, a AS (SELECT model, avg(success::INT::DOUBLE) - 0.3::DOUBLE AS x FROM calls GROUP BY model) SELECT model, CASE WHEN x >= 0.6 THEN 'very_high' WHEN x >= 0.5 THEN 'high' WHEN x >= 0.3 THEN 'medium' ELSE 'low' END AS level FROM a",
    "embed_chunks": f"WITH {CHUNKS} SELECT chunk_id, 64::BIGINT AS size, CASE WHEN regexp_matches(chunk_text, '[\\p{{L}}\\p{{N}}]') THEN 1.0 ELSE 0.0 END::DOUBLE AS norm FROM chunks",
    "cache_hits": "SELECT round(avg((event_type = 'view')::INT::DOUBLE), 3) AS hit_rate FROM events",
    "eval_prf": f"WITH {_lab}, f AS (SELECT 'long' AS mode, doc_id, quality FROM lab WHERE n_chars > 500 UNION ALL SELECT 'longer', doc_id, quality FROM lab WHERE n_chars > 2000), c AS (SELECT mode, count(*) FILTER (quality = 1) AS tp, count(*) FILTER (quality <> 1) AS fp FROM f GROUP BY mode), d AS (SELECT *, (SELECT count(*) FROM lab WHERE quality = 1) - tp AS fn FROM c), e AS (SELECT *, tp::DOUBLE / (tp + fp) AS p, tp::DOUBLE / (tp + fn) AS r FROM d) SELECT mode, tp, fp, fn, round(p, 4) AS precision, round(r, 4) AS recall, round(2 * p * r / (p + r), 4) AS f1 FROM e",
    "eval_pivot": f"WITH {_lab} SELECT lang, count(*) FILTER (quality = 0) AS low, count(*) FILTER (quality = 1) AS high FROM lab GROUP BY lang",
    "eval_noise": f"WITH {_lab} SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS place FROM lab WHERE n_chars > 500 AND quality <> 1 QUALIFY place <= 8",
    "eval_overlap": f"WITH {_lab} SELECT count(*) FILTER (n_chars > 500 AND quality <> 1) AS only_a, count(*) FILTER (n_chars <= 500 AND quality = 1) AS only_b, count(*) FILTER (n_chars > 500 AND quality = 1) AS both FROM lab",
    "gold_set": f"WITH {_lab} SELECT DISTINCT doc_id FROM lab WHERE quality + toxic = 1",
    "eval_latency": "SELECT event_type, count(*) AS n, round(avg(value), 6) AS avg_ms, round(min(value), 6) AS min_ms, round(max(value), 6) AS max_ms FROM events GROUP BY event_type",
    "stream_tumbling": f"SELECT event_type, count(*) AS n, round(sum(value), 4) AS total, {_win('date_trunc($$day$$, ts)', 'date_trunc($$day$$, ts) + INTERVAL 1 DAY')} FROM events GROUP BY event_type, date_trunc($$day$$, ts)",
    "stream_sliding": f"SELECT count(*) AS n, round(max(value), 4) AS top, {_win('s', 's + INTERVAL 6 HOUR')} FROM (SELECT value, unnest([time_bucket(INTERVAL 3 HOUR, ts, TIMESTAMP '2000-01-01'), time_bucket(INTERVAL 3 HOUR, ts, TIMESTAMP '2000-01-01') - INTERVAL 3 HOUR]) AS s FROM events) GROUP BY s",
    "stream_session": f"WITH a AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS brk FROM events), b AS (SELECT user_id, ts, sum(brk) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM a) SELECT user_id, count(*) AS n, {_win('min(ts)', 'max(ts) + INTERVAL 30 MINUTE')} FROM b GROUP BY user_id, k",
}

