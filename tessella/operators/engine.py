"""Models as functions: a registry of drivers by capability, batched calls on columns, probes, and a query cache.

A driver is a function from a list of texts to a list of answers. It runs in Python workers, one Arrow batch at a time;
what fails for a batch is tried for each text by itself, and a text that fails alone has a neutral answer.
"""

from __future__ import annotations

import hashlib
import hmac
import os
import time
from collections import OrderedDict
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions.text import intelligence_of, speed_of
from tessella.operators import search

Driver = Callable[[list[str]], list[Any]]


def hashing_embedder(size: int = 64) -> Driver:
    """Vectors of hashed words, of length 1: the same text has the same vector everywhere.

    Words whose signs cancel in every place are counted without signs, so only a text without a word has length 0.
    """

    def run(texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v = [0.0] * size
            hashes = [int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little") for word in "".join(c if c.isalnum() else " " for c in text.lower()).split()]
            for h in hashes:
                v[h % size] += 1.0 if h >> 63 else -1.0
            if hashes and not any(v):
                for h in hashes:
                    v[h % size] += 1.0
            n = sum(x * x for x in v) ** 0.5
            out.append([x / n for x in v] if n else v)
        return out

    return run


def answers(driver: Driver, texts: Sequence[str | None], neutral: Any, batch: int) -> list[Any]:
    """A driver's answers in order: by batches, else one by one, else neutral."""
    out: list[Any] = []
    for i in range(0, len(texts), batch):
        part = [t or "" for t in texts[i : i + batch]]
        try:
            got = list(driver(part))
            if len(got) != len(part):
                raise ValueError("an answer for each text is needed")
        except Exception:
            got = []
            for t in part:
                try:
                    got.append(list(driver([t]))[0])
                except Exception:
                    got.append(neutral)
        out += got
    return out


@dataclass
class Engine:
    """Capabilities (embed, extract, rerank, generate) and the drivers that serve them, the first healthy one first."""

    drivers: dict[str, dict[str, Driver]] = field(default_factory=dict)
    health: dict[str, Callable[[], bool]] = field(default_factory=dict)

    def register(self, capability: str, name: str, driver: Driver, health: Callable[[], bool] | None = None) -> Engine:
        self.drivers.setdefault(capability, {})[name] = driver
        if health:
            self.health[name] = health
        return self

    def models(self, capability: str | None = None) -> list[tuple[str, str]]:
        return [(c, n) for c, by in self.drivers.items() for n in by if capability in (None, c)]

    def healthy(self, name: str) -> bool:
        try:
            return bool(self.health.get(name, lambda: True)())
        except Exception:
            return False

    def driver(self, capability: str, name: str | None = None) -> Driver:
        known = self.drivers.get(capability, {})
        for n in [name] if name else known:
            if n in known and self.healthy(n):
                return known[n]
        raise LookupError(f"no healthy model for {capability}")

    def profile(self, name: str, golden: Sequence[tuple[str, Sequence[str]]]) -> dict:
        """A model's profile by probing its extractor: share of texts with half of their names found, and mean latency."""
        hits, times = 0, []
        for text, names in golden:
            began = time.perf_counter()
            found = answers(self.drivers["extract"][name], [text], [], 1)[0]
            times.append((time.perf_counter() - began) * 1000)
            hits += 2 * len(set(found) & set(names)) >= len(set(names))
        return {"name": name, "confidence": hits / max(1, len(golden)), "avg_latency_ms": sum(times) / max(1, len(times)), "probe_count": 1}

    def get(self, capability: str, golden: Sequence[tuple[str, Sequence[str]]], known: dict[str, dict]) -> dict:
        """The profile of the capability's first healthy model: a known one, else by probing, which makes it known."""
        for name in self.drivers.get(capability, {}):
            if self.healthy(name):
                return known.setdefault(name, self.profile(name, golden) if name not in known else {})
        raise LookupError(f"no healthy model for {capability}")

    def call(self, df: DataFrame, capability: str, text: str, output: str, kind: str, neutral: Any, name: str | None = None, batch: int = 16) -> DataFrame:
        """df with a column of answers of a SQL type; texts stay in the tasks that hold them."""
        driver = self.driver(capability, name)

        @F.pandas_udf(kind)
        def run(frames: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for s in frames:
                yield pd.Series(answers(driver, s.tolist(), neutral, batch))

        return df.withColumn(output, run(F.col(text)))

    def embed(self, df: DataFrame, text: str, size: int, output: str = "embedding", name: str | None = None, batch: int = 16) -> DataFrame:
        return self.call(df, "embed", text, output, "array<float>", [0.0] * size, name, batch)

    def extract(self, df: DataFrame, text: str, output: str = "raw", name: str | None = None, least: int = 100, most: int = 1500) -> DataFrame:
        """Raw answers on texts of at least `least` characters, cut to `most`; others are empty."""
        cut = df.withColumn("__cut", F.when(F.length(text) >= least, F.substring(text, 1, most)))
        return self.call(cut, "extract", "__cut", output, "string", "", name).withColumn(output, F.when(F.col("__cut").isNull(), "").otherwise(F.col(output))).drop("__cut")

    def generate(self, df: DataFrame, prompt: str, output: str = "answer", name: str | None = None) -> DataFrame:
        return self.call(df, "generate", prompt, output, "string", "", name)


def probe(samples: DataFrame, found: DataFrame, latency_ms: DataFrame) -> DataFrame:
    """(model, accuracy, intelligence, avg_latency_ms, speed_tier): a sample is hit if half of its expected names are found.

    samples: (sample, name); found: (model, sample, name); latency_ms: (model, ms) of each call.
    """
    expected = samples.distinct().groupBy("sample").agg(F.count("*").alias("expected"))
    hits = found.select("model", "sample", "name").distinct().join(samples.distinct(), ["sample", "name"], "left_semi").groupBy("model", "sample").agg(F.count("*").alias("hits"))
    hit = hits.join(expected, "sample").groupBy("model").agg(F.count_if(F.col("hits") * 2 >= F.col("expected")).alias("n"))
    score = latency_ms.select("model").distinct().join(hit, "model", "left").withColumn("accuracy", F.coalesce("n", F.lit(0)) / F.lit(max(1, expected.count())))
    times = latency_ms.groupBy("model").agg(F.avg("ms").alias("avg_latency_ms"))
    return score.join(times, "model").select("model", "accuracy", intelligence_of(F.col("accuracy")).alias("intelligence"), "avg_latency_ms", speed_of(F.col("avg_latency_ms")).alias("speed_tier"))


class QueryCache:
    """The last vectors of queries on the driver, by their normalised text."""

    def __init__(self, size: int = 256):
        self.size, self.kept, self.hits, self.misses = size, OrderedDict(), 0, 0

    def get(self, query: str, embed: Driver) -> Sequence[float]:
        key = query.strip().lower()
        if key in self.kept:
            self.hits += 1
            self.kept.move_to_end(key)
            return self.kept[key]
        self.misses += 1
        self.kept[key] = embed([query])[0]
        if len(self.kept) > self.size:
            self.kept.popitem(last=False)
        return self.kept[key]

    def stats(self) -> dict:
        calls = self.hits + self.misses
        return {"size": len(self.kept), "hits": self.hits, "misses": self.misses, "hit_rate": round(self.hits / calls, 3) if calls else 0.0}


def command(chunks: DataFrame, embeddings: DataFrame, index, request, driver: Driver, links: DataFrame | None = None, relations: DataFrame | None = None, scorer=None, cache: QueryCache | None = None) -> DataFrame:
    """A whole search: the query's vector, both lists fused, reranked if a scorer is given, spread over the graph if one is.

    Rows have the last step's score as `score` and the chunk's text; `links` are (chunk_id, entity), `relations` (source,
    target). A reranked result's score is the scorer's; equal ones keep their order.
    """
    from dataclasses import replace

    vector = (cache or QueryCache()).get(request.query, driver)
    found = search.listed(search.search(chunks, embeddings, replace(request, embedding=list(vector)), index))
    if scorer is not None:
        texts = chunks.select("chunk_id", "chunk_text").join(F.broadcast(found), "chunk_id")
        ranked = search.rerank(texts, request.query, scorer, request.top_k)
        found = search.listed(ranked.select("chunk_id", F.col("rerank").alias("score")))
    if links is not None:
        found = search.propagate(found.select("chunk_id", "score"), links, relations, request.top_k).select("chunk_id", F.col("combined").alias("score"))
    best = F.broadcast(search.listed(found.select("chunk_id", "score")))
    return chunks.select("chunk_id", "page_id", "wing", "room", "chunk_text").join(best, "chunk_id").orderBy(F.desc("score"), "chunk_id")


@dataclass
class Access:
    """Who may ask: a token if access is guarded, from the settings or the environment; an agent is kept to its wing."""

    enabled: bool = False
    token: str = ""
    variable: str = "TESSELLA_TOKEN"

    def allows(self, given: str | None) -> bool:
        wanted = self.token or os.environ.get(self.variable, "")
        return not self.enabled or bool(wanted) and hmac.compare_digest((given or "").removeprefix("Bearer ").encode(), wanted.encode())

    def request(self, request, agent_id: str | None = None, token: str | None = None):
        """The request with the agent's wing as its scope; refused without the right token, or for another agent's wing."""
        from dataclasses import replace

        if not self.allows(token):
            raise PermissionError("a valid token is needed")
        wing = wing_of_agent(agent_id, request.wing)
        if agent_id and wing and wing.startswith("agent-") and wing != f"agent-{agent_id}":
            raise PermissionError("an agent's memory is its own")
        return replace(request, wing=wing)


def wing_of_agent(agent_id: str | None, wing: str | None = None) -> str | None:
    """The wing that an agent's requests are kept to, unless they name one."""
    return wing or (f"agent-{agent_id}" if agent_id else None)
