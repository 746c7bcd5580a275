"""Sources: files by folder and pattern, inline documents, other databases, model profiles, and settings."""

from __future__ import annotations

import os
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field, fields
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.text import stem, strategy, strip
from tessella.operators.chunking import chunk_texts

# What a scan takes without patterns, and the folders that it passes over.
EXTENSIONS = ["md", "mdx", "markdown", "txt", "py", "java", "js", "ts", "vue", "jsx", "tsx", "go", "rs", "sql", "yaml", "yml", "json", "xml", "toml", "html", "css", "sh"]
IGNORED = ("node_modules", "target", "dist", ".git", "__pycache__", ".venv", "venv")


@dataclass
class Source:
    """A named place to read from."""

    name: str
    path: str
    kind: str = "filesystem"
    wing: str | None = None
    room: str = "files"
    patterns: Sequence[str] = ()
    ignore: Sequence[str] = IGNORED


def scan(spark: SparkSession, source: Source) -> DataFrame:
    """(path, wing, room, strategy, text) of the files below a source; blank files and ignored folders are left out.

    Bytes that are no UTF-8 become the replacement character. The wing is the folder's name unless the source has one.
    """
    globs = list(source.patterns) or [f"*.{e}" for e in EXTENSIONS]
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "{" + ",".join(globs) + "}").load(source.path)
    ignored = "/(" + "|".join(f"\\Q{x}\\E" for x in source.ignore) + ")/"
    text = F.make_valid_utf8(F.col("content").cast("string"))
    wing = source.wing or os.path.basename(source.path.rstrip("/"))
    rows = files.filter(~F.col("path").rlike(ignored)) if source.ignore else files
    return rows.select("path", F.lit(wing).alias("wing"), F.lit(source.room).alias("room"), strategy(F.col("path")).alias("strategy"), text.alias("text")).filter(strip(F.col("text")) != "")


def scan_all(spark: SparkSession, sources: Iterable[Source]) -> DataFrame:
    out = None
    for s in sources:
        rows = scan(spark, s)
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise ValueError("no source")
    return out


def inline(spark: SparkSession, documents: Sequence[tuple[str, str]], wing: str = "obsidian", room: str = "notes") -> DataFrame:
    """Pushed documents (path, content) in the form of scan()."""
    rows = spark.createDataFrame(list(documents), "path string, text string")
    return rows.select("path", F.lit(wing).alias("wing"), F.lit(room).alias("room"), strategy(F.col("path")).alias("strategy"), "text").filter(strip(F.col("text")) != "")


def mined(files: DataFrame, max_chars: int = 2000) -> DataFrame:
    """Chunks of scanned files, each by its strategy, with the page's slug."""
    return chunk_texts(files.withColumn("slug", stem(F.col("path"))), "text", F.col("strategy"), max_chars).drop("text")


def database(spark: SparkSession, url: str, table: str, key: str | None = None, bounds: tuple[int, int] | None = None, parts: int = 16) -> DataFrame:
    """A table of another database by JDBC, read in ranges of a numeric key if one is given."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table)
    if key and bounds:
        reader = reader.options(partitionColumn=key, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=parts)
    return reader.load()


PROFILE = "name string, driver string, base_url string, capabilities map<string,boolean>, intelligence string, confidence double, speed_tier string, avg_latency_ms double, quality string, cost_tier string, probe_count int, oscillating boolean, history array<struct<intelligence:string,accuracy:double>>"


def profiles(spark: SparkSession, path: str) -> DataFrame:
    """Model profiles: JSON files of one profile each, or of one a line."""
    return spark.read.schema(PROFILE).json(path)


def save_profiles(rows: DataFrame, path: str) -> None:
    """Writes profiles, one a line; columns that a profile does not have are left out."""
    known = [f.name for f in rows.sparkSession.createDataFrame([], PROFILE).schema]
    rows.select(*(c for c in rows.columns if c in known)).write.mode("overwrite").json(path)


@dataclass
class Settings:
    """Settings by section; keys that no section knows are ignored."""

    search: dict = field(default_factory=lambda: {"hybrid_search": True, "rrf_k": 60, "top_k": 20, "recent_days": 7, "recent_weight": 1.5, "stale_days": None, "stale_penalty": 1.0})
    graph: dict = field(default_factory=lambda: {"entity_weight": 0.3, "relation_weight": 0.2, "iterations": 3, "damping": 0.85})
    extraction: dict = field(default_factory=lambda: {"mode": "regex", "llm_min_chars": 100})
    sources: list = field(default_factory=list)


def settings(path: str | None = None, variable: str = "TESSELLA_CONFIG") -> Settings:
    """From a YAML or JSON file: the path given, or the environment's, or one in the current or home folder."""
    import json

    places = [path, os.environ.get(variable), "tessella.yaml", str(Path.home() / ".tessella.yaml")]
    found = next((p for p in places if p and Path(p).is_file()), None)
    out = Settings()
    if found is None:
        return out
    text = Path(found).read_text()
    try:
        given = json.loads(text)
    except ValueError:
        given = simple_yaml(text)
    for f in fields(out):
        if isinstance(given.get(f.name), dict):
            known = getattr(out, f.name)
            known.update({k: v for k, v in given[f.name].items() if k in known})
        elif f.name == "sources" and isinstance(given.get("sources"), list):
            known = {x.name for x in fields(Source)}
            out.sources = [Source(**{k: v for k, v in s.items() if k in known}) for s in given["sources"]]
    return out


def simple_yaml(text: str) -> dict:
    """Sections of `key: value` lines and lists of such, which is all that settings need."""
    import json

    def value(x: str):
        x = x.strip()
        try:
            return json.loads(x)
        except ValueError:
            return {"true": True, "false": False, "null": None, "~": None, "": None}.get(x.lower(), x.strip("'\""))

    out: dict = {}
    section, item = None, None
    for line in text.split("\n"):
        line = line.split(" #")[0].rstrip()
        if not line or line.lstrip().startswith("#"):
            continue
        key, found, rest = line.strip().removeprefix("- ").partition(":")
        if not line[0].isspace() and not line.startswith("-"):
            section, item = key, None
            out[section] = value(rest) if rest.strip() else {}
        elif line.strip().startswith("- "):
            if not isinstance(out[section], list):
                out[section] = []
            item = {key: value(rest)} if found else value(key)
            out[section].append(item)
        elif isinstance(item, dict):
            item[key] = value(rest)
        elif isinstance(out[section], dict):
            out[section][key] = value(rest)
    return out
