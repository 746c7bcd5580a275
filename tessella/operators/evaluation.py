"""How good extraction and rules are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def scores(counts: DataFrame, digits: int = 4) -> DataFrame:
    """Precision, recall and F1 from tp, fp and fn; 0 where undefined."""
    tp, fp, fn = (F.col(x).cast("double") for x in ("tp", "fp", "fn"))
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return counts.withColumns({"precision": F.round(p, digits), "recall": F.round(r, digits), "f1": F.round(ratio(2 * p * r, p + r), digits)})


def against_gold(found: DataFrame, gold: DataFrame, keys: list[str], by: str) -> DataFrame:
    """(by, tp, fp, fn, precision, recall, f1): rows found by each mode against one gold set."""
    hits = found.select(by, *keys).distinct().join(gold.select(*keys).distinct().withColumn("g", F.lit(1)), keys, "left")
    counted = hits.groupBy(by).agg(F.count("g").alias("tp"), F.count_if(F.col("g").isNull()).alias("fp"))
    size = gold.select(*keys).distinct().agg(F.count("*").alias("size"))
    return scores(counted.crossJoin(F.broadcast(size)).withColumn("fn", F.col("size") - F.col("tp")).drop("size"))


def gold_set(found: DataFrame, valid: Column, keys: list[str]) -> DataFrame:
    return found.filter(valid).select(*keys).distinct()


# Names that are noise, names that are valid, and patterns that make a name valid. Names of a few
# organisations and products of no public standing are left out; callers add what they need.
NOISE = [
    r"^\d+分钟$", r"^\d+次", r"^[\d.]+%$", r"^\d+\.?\d*$", r"^[<>≥≤]", r"^K6_", r"^[A-Z_]{6,}$", r"^Google Chrome$", r"^Safari$", r"^360浏览器$",
    r"^Java 编程方法论", r"^Remove Assignments", r"^Split Variable$", r"^Split Temp$", r"^Episodic$", r"^Procedural$", r"^http://", r"^\d+\.\d+\.\d+\.\d+",
    r"^sleep$", r"^assert$", r"^candidate\(s\)", r"^data$", r"^channel$", r"^exclude$", r"^Admin@123$", r"^localhost$", r"^\d{5}$", r"^Math\.", r"^TimeUnit\.",
    r"^fence\.", r"^\.env\.",
]
KEYWORDS = [
    r"KYC", r"Buyer", r"Seller", r"买方", r"卖方", r"Contract", r"WBS", r"ADR", r"DDD", r"CI", r"CD", r"API", r"HTTP", r"REST", r"JWT", r"Token", r"Auth",
    r"WeCom|WeChat", r"Gateway", r"Postgres|PostgreSQL", r"Dashboard", r"驾驶舱", r"看板", r"Observable", r"RxJava", r"SseEmitter", r"Reactive", r"PagerDuty",
    r"Grafana", r"Loki", r"Prometheus", r"Kubernetes", r"Docker", r"git", r"openssl", r"cron", r"schedule", r"smoke.test", r"Context", r"Propagation",
    r"Rerank", r"Embedding", r"Hybrid", r"Vector", r"Semantic", r"Cache", r"Maintenance", r"Verification", r"Summary", r"Trigger", r"i18n", r"spike",
    r"Bearer", r"Basic Auth", r"Chunk", r"Embedder", r"\w+门禁", r"\w+评审", r"GitHub Actions", r"Docker Compose", r"Long or Volatile", r"Data Flow",
    r"Value Completeness", r"Feature Completeness",
]
VALID_NAMES = ["Status", "Signal", "Preconditions", "Steps", "Overview", "sustainability", "Cancel/Refund", "Standalone"]


def name_class(name: Column, noise: list[str] = NOISE, keywords: list[str] = KEYWORDS, valid: list[str] = VALID_NAMES) -> Column:
    """valid or noise: by noise patterns, listed names, keywords, and the shape of an identifier or a short CJK name."""
    any_of = lambda patterns: name.rlike("(?U)" + "|".join(f"(?:{p})" for p in patterns))
    shape = (F.length(name) >= 3) & name.rlike("^[a-zA-Z][a-zA-Z0-9]+$") | F.length(name).between(2, 20) & name.rlike("[一-鿿]")
    return F.when(any_of(noise), "noise").when(name.isin(valid) | any_of(keywords) | shape, "valid").otherwise("noise")


def pivot(found: DataFrame, by: str, column: str, values: list[str]) -> DataFrame:
    """Counts by mode and type, a column for each type."""
    return found.groupBy(by).pivot(column, values).agg(F.count(F.lit(1))).fillna(0)


def noise_samples(found: DataFrame, gold: DataFrame, keys: list[str], by: str, n: int = 8) -> DataFrame:
    extra = found.select(by, *keys).distinct().join(gold.select(*keys), keys, "left_anti")
    return extra.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(*keys))).filter(F.col("place") <= n)


def overlap(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """(only_a, only_b, both) numbers of distinct rows."""
    rows = a.select(*keys).distinct().withColumn("a", F.lit(1)).join(b.select(*keys).distinct().withColumn("b", F.lit(1)), keys, "full_outer")
    return rows.agg(F.count_if(F.col("b").isNull()).alias("only_a"), F.count_if(F.col("a").isNull()).alias("only_b"), F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("both"))


def latency(timings: DataFrame, *by: str) -> DataFrame:
    """Number, mean, least and greatest of timings (ms) by some columns: a query's, or whether a cache was cold."""
    return timings.groupBy(*by).agg(F.count("*").alias("n"), F.avg("ms").alias("avg_ms"), F.min("ms").alias("min_ms"), F.max("ms").alias("max_ms"))


def sample(rows: DataFrame, n: int, key: str, seed: int = 0) -> DataFrame:
    """n rows that look random, the same in every run: those with the least hash of seed and key."""
    return rows.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), key).limit(n)


def first_chunks(chunks: DataFrame, n: int = 100, min_chars: int = 80) -> DataFrame:
    """The first chunks by page and index that are longer than some characters."""
    return chunks.filter(F.length("chunk_text") > min_chars).orderBy("page_id", "chunk_index").limit(n)
