"""Choosing models by constraints, and watching how they do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella import schema
from tessella.functions.text import rank_of

# Latency that a speed tier stands for, in milliseconds.
LATENCY = {"fast": 50.0, "medium": 1000.0, "slow": 5000.0, "batch": 15000.0}
# Constraints of capabilities that state none.
MIN_INTELLIGENCE, MAX_COST, MAX_LATENCY = "low", "free", 99999.0


def with_latency(profiles: DataFrame, health: DataFrame | None = None) -> DataFrame:
    """Profiles with a latency: their own or their tier's, and a measured one (name, latency_ms) if that is lower."""
    hint = rank_of(F.col("speed_tier"), LATENCY, LATENCY["medium"])
    known = profiles.withColumn("avg_latency_ms", F.coalesce(F.col("avg_latency_ms").cast("double"), hint))
    if health is None:
        return known
    return known.join(health.select("name", F.col("latency_ms").alias("__h")), "name", "left").withColumn("avg_latency_ms", F.least("avg_latency_ms", "__h")).drop("__h")


def satisfies(intelligence: Column, cost: Column, latency: Column) -> Column:
    return (rank_of(F.col("intelligence"), schema.INTELLIGENCE) >= intelligence) & (rank_of(F.col("cost_tier"), schema.COST) <= cost) & (F.col("avg_latency_ms") <= latency) & ~F.coalesce("oscillating", F.lit(False))


def _limits(relaxed: bool) -> tuple[Column, Column, Column]:
    i, c, ms = (F.col(x) for x in ("min_intelligence", "max_cost", "max_latency_ms"))
    ri, rc = rank_of(F.coalesce(i, F.lit(MIN_INTELLIGENCE)), schema.INTELLIGENCE), rank_of(F.coalesce(c, F.lit(MAX_COST)), schema.COST)
    rl = F.coalesce(ms.cast("double"), F.lit(MAX_LATENCY))
    if not relaxed:
        return ri, rc, rl
    # one step each, where a capability states a limit
    return F.when(i.isNotNull(), F.greatest(ri - 1, F.lit(0))).otherwise(ri), F.when(c.isNotNull(), F.least(rc + 1, F.lit(3))).otherwise(rc), F.when(ms.isNotNull(), rl * 3).otherwise(rl)


def relax(capabilities: DataFrame) -> DataFrame:
    """Constraints one step wider: a lower intelligence, three times the latency, the next cost tier."""
    i, c, ms = _limits(True)
    name = lambda rank, table: F.element_at(F.array(*(F.lit(k) for k in table)), (rank + 1).cast("int"))
    return capabilities.withColumns({"min_intelligence": F.when(F.col("min_intelligence").isNotNull(), name(i, schema.INTELLIGENCE)), "max_cost": F.when(F.col("max_cost").isNotNull(), name(c, schema.COST)), "max_latency_ms": F.when(F.col("max_latency_ms").isNotNull(), ms)})


def candidates(capabilities: DataFrame, profiles: DataFrame) -> DataFrame:
    """Each capability's candidates that are known, healthy and allowed, in strict or relaxed form, by its objective.

    capabilities: (capability, min_intelligence, max_cost, max_latency_ms, objective, candidates array<string>).
    Profiles and capabilities are a dimension: some rows for each model that a site runs.
    """
    listed = capabilities.select("*", F.posexplode("candidates").alias("place", "name")).drop("candidates")
    known = profiles if "healthy" in profiles.columns else profiles.withColumn("healthy", F.lit(True))
    both = listed.join(known, "name").filter(F.coalesce("healthy", F.lit(True)))
    fit = both.withColumn("strict", satisfies(*_limits(False))).withColumn("relaxed", satisfies(*_limits(True))).filter("strict or relaxed")
    order = F.when(F.col("objective") == "speed", F.col("avg_latency_ms")).when(F.col("objective") == "quality", -rank_of(F.col("intelligence"), schema.INTELLIGENCE)).otherwise(rank_of(F.col("cost_tier"), schema.COST).cast("double"))
    return fit.withColumn("position", F.row_number().over(Window.partitionBy("capability").orderBy(F.desc("strict"), order.cast("double"), "place")))


def select(capabilities: DataFrame, profiles: DataFrame, n: int = 1) -> DataFrame:
    """(capability, position, name, how): the best n models, strict ones if there are any, else relaxed ones."""
    found = candidates(capabilities, profiles)
    some = F.max(F.col("strict").cast("int")).over(Window.partitionBy("capability")) == 1
    return found.withColumn("some", some).filter("strict or not some").filter(F.col("position") <= n).select("capability", "position", "name", F.when(F.col("strict"), "strict").otherwise("relaxed").alias("how"))


# observation: calls (model, seq, latency_ms, success, entities, json_valid)

def rolling(calls: DataFrame) -> DataFrame:
    """Calls with the mean latency of the last 5, that of up to 15 before them, and whether the former has doubled."""
    order = Window.partitionBy("model").orderBy("seq")
    out = calls.withColumns({"n": F.row_number().over(order), "recent": F.avg("latency_ms").over(order.rowsBetween(-4, 0)), "before": F.avg("latency_ms").over(order.rowsBetween(-19, -5))})
    return out.withColumn("doubled", (F.col("n") >= 10) & F.coalesce(F.col("recent") > 2 * F.col("before"), F.lit(False)))


def ewma(calls: DataFrame, alpha: float = 0.1) -> DataFrame:
    """(model, ewma) of entity counts from 0, in call order: a sum weighted by the number of calls that followed."""
    after = F.row_number().over(Window.partitionBy("model").orderBy(F.desc("seq"))) - 1  # a few numbers a call, sorted within a model's task
    weighted = calls.withColumn("w", alpha * F.pow(F.lit(1 - alpha), after) * F.col("entities").cast("double"))
    return weighted.groupBy("model").agg(F.sum("w").alias("ewma"))


def rates(calls: DataFrame) -> DataFrame:
    """(model, calls, errors, bad_json, anomalies): more than a tenth of errors after 20 calls, a fifth of bad JSON after 10."""
    out = calls.groupBy("model").agg(F.count("*").alias("calls"), F.count_if(~F.col("success")).alias("errors"), F.count_if(~F.col("json_valid")).alias("bad_json"))
    many, bad = (F.col("calls") >= 20) & (F.col("errors") > 0.1 * F.col("calls")), (F.col("calls") >= 10) & (F.col("bad_json") > 0.2 * F.col("calls"))
    return out.withColumns({"error_anomaly": many, "json_anomaly": bad})


def suspicious(calls: DataFrame, alpha: float = 0.1) -> DataFrame:
    """(model, latency, entities, errors, json, suspicious): which rules hold after a model's last call.

    Latency doubled over the window of 20 (10 calls at least); the running mean of entities below 0.5 after 10 calls; more
    than a tenth of errors after 20; more than a fifth of bad JSON after 10.
    """
    last = rolling(calls).groupBy("model").agg(F.max_by("doubled", "seq").alias("latency"))
    r = rates(calls).join(ewma(calls, alpha), "model").join(last, "model")
    out = r.select("model", "latency", ((F.col("calls") >= 10) & (F.col("ewma") < 0.5)).alias("entities"), F.col("error_anomaly").alias("errors"), F.col("json_anomaly").alias("json"))
    return out.withColumn("suspicious", F.col("latency") | F.col("entities") | F.col("errors") | F.col("json"))


def from_config(configs: DataFrame) -> DataFrame:
    """Profiles of configured models (name, driver, capabilities: comma-separated, intelligence, cost_tier, speed_tier, avg_latency_ms).

    What is not given is as for a model of medium speed and low cost; a speed tier stands for a latency.
    """
    given = configs.withColumns({"speed_tier": F.coalesce("speed_tier", F.lit("medium")), "cost_tier": F.coalesce("cost_tier", F.lit("low")), "intelligence": F.coalesce("intelligence", F.lit("medium"))})
    listed = F.transform(F.split(F.coalesce("capabilities", F.lit("")), ","), F.trim)
    return with_latency(given.withColumn("capabilities", F.filter(listed, lambda x: x != "")))


def backoff(calls: int, first: int = 50, most: int = 400) -> list[int]:
    """Calls after which a model is probed again: the wait doubles up to a limit."""
    out, wait, at = [], first, 0
    while at + wait <= calls:
        at += wait
        out.append(at)
        wait = min(wait * 2, most)
    return out


def oscillating(history: Column, probes: Column) -> Column:
    """Whether the last five probes gave three levels or more."""
    return (probes >= 2) & (F.size(F.array_distinct(F.slice(history, F.greatest(F.size(history) - 4, F.lit(1)), F.lit(5)))) >= 3)


def hit_rate(calls: DataFrame) -> DataFrame:
    return calls.agg(F.round(F.coalesce(F.avg(F.col("hit").cast("double")), F.lit(0.0)), 3).alias("hit_rate"))
