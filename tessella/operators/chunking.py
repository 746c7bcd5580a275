"""Chunking: one text into many chunks. Lines, headings, strides and turns are plain column expressions; the chunkers
that carry a state from line to line run as Arrow-batched functions on one text at a time."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.text import strip, token_estimate

CHUNK = "array<struct<text:string,boundary:string,start:int>>"


def exploded(df: DataFrame, chunks: Column) -> DataFrame:
    """One row for each chunk of an array<struct<text, start>>: chunk_index counts from 0."""
    return df.select("*", F.posexplode(chunks).alias("chunk_index", "chunk")).withColumns({"chunk_text": F.col("chunk.text"), "start": F.col("chunk.start"), "token_count": token_estimate(F.col("chunk.text"))}).drop("chunk")


def line_groups(text: Column, max_lines: int = 50) -> Column:
    """Groups of lines, blank ones left out; `start` is the first line's number, from 1."""
    lines = F.split(text, "\n", -1)
    groups = F.transform(F.sequence(F.lit(0), F.floor((F.size(lines) - 1) / max_lines).cast("int")), lambda i: F.struct(strip(F.array_join(F.slice(lines, i * max_lines + 1, F.lit(max_lines)), "\n")).alias("text"), (i * max_lines + 1).alias("start")))
    return F.filter(groups, lambda g: g["text"] != "")


def chunk_lines(df: DataFrame, text: str = "text", max_lines: int = 50) -> DataFrame:
    return exploded(df, line_groups(F.col(text), max_lines))


def chunk_stride(df: DataFrame, text: str = "text", size: int = 1500, overlap: int = 100) -> DataFrame:
    """Windows of a fixed size; the last one ends with the text. Empty texts have none."""
    at = F.when(F.length(text) > 0, F.sequence(F.lit(0), F.greatest(F.length(text) - overlap - 1, F.lit(0)), F.lit(size - overlap))).otherwise(F.array().cast("array<int>"))
    return exploded(df, F.transform(at, lambda i: F.struct(F.substring(F.col(text), i + 1, F.lit(size)).alias("text"), i.alias("start"))))


def chunk_headings(df: DataFrame, text: str = "text") -> DataFrame:
    """Sections between headings of the second and third level, in column expressions only."""
    sections = F.transform(F.split(F.col(text), r"(?m)(?<=\n|\A)(?=#{2,3}\s)", -1), lambda s: F.struct(strip(s).alias("text"), F.lit(0).alias("start")))
    return exploded(df, F.filter(sections, lambda s: s["text"] != ""))


def chunk_turns(turns: DataFrame, turns_in_chunk: int = 4) -> DataFrame:
    """Conversations (conv_id, turn, role, text) in chunks of consecutive turns, one line for each."""
    key = F.floor(F.col("turn") / turns_in_chunk)
    lines = F.sort_array(F.collect_list(F.struct("turn", F.concat_ws(": ", "role", "text").alias("line"))))
    return turns.groupBy("conv_id", key.alias("chunk_index")).agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("chunk_text"), F.count("*").alias("n_turns")).withColumn("token_count", token_estimate(F.col("chunk_text")))


def markdown(text: str, max_chars: int = 2000) -> list[tuple[str, str, int]]:
    """(text, boundary, first line): a new chunk at each heading of level 2 or 3, and where max_chars is reached."""
    out, held, size, first = [], [], 0, 0

    def close(boundary: str, following: int) -> None:
        nonlocal held, size, first
        whole = "\n".join(held).strip()
        if whole:
            out.append((whole, boundary, first))
        held, size, first = [], 0, following

    for i, line in enumerate(text.split("\n")):
        if re.match(r"#{2,3}\s", line):
            close("heading", i)
            size = -1  # a heading counts its own length only
        held.append(line)
        size += len(line) + 1
        if size >= max_chars:
            close("size", i + 1)
    close("end", 0)
    return out


def code(text: str, max_chars: int = 3000, min_chars: int = 100) -> list[tuple[str, str, int]]:
    """(text, boundary, first line): a new chunk at each definition in the first column; imports go before the first."""
    lines = text.split("\n")
    n = next((i for i, x in enumerate(lines) if x.strip() and not re.match(r"(import|from)\s", x)), len(lines))
    preamble, held, first, out = lines[:n], [], n, []

    def close(boundary: str, following: int) -> None:
        nonlocal held, first, preamble
        whole = "\n".join([*preamble, *held]).strip()
        if whole and (any(x.strip() for x in held) or boundary == "end"):
            out.append((whole, boundary, first))
            preamble = []
        held, first = [], following

    for i in range(n, len(lines)):
        if held and re.match(r"(async\s+)?(def|class)\s+\w+", lines[i]):
            close("definition", i)
        held.append(lines[i])
        if len(held) > 2 and sum(len(x) + 1 for x in held) >= max_chars:
            close("size", i + 1)
    close("end", 0)
    if len(out) > 1 and len(out[-1][0]) < min_chars:
        last = out.pop()
        out[-1] = (f"{out[-1][0]}\n{last[0]}", out[-1][1], out[-1][2])
    return out


def plain(text: str, max_chars: int = 1500, overlap: int = 100) -> list[tuple[str, str, int]]:
    """(text, boundary, offset): windows that end after a paragraph or else a sentence, if one ends in their second half."""
    if len(text) <= max_chars:
        return [(text.strip(), "whole", 0)] if text.strip() else []
    out, start = [], 0
    while start < len(text):
        end, boundary = start + max_chars, "size"
        if end < len(text):
            ends = {name: text.rfind(mark, start + max_chars // 2, end) for mark, name in (("\n\n", "paragraph"), (". ", "sentence"))}
            boundary = next((name for name, at in ends.items() if at >= 0), "size")
            end = ends[boundary] + 1 if boundary in ends else end
        if text[start:end].strip():
            out.append((text[start:end].strip(), boundary, start))
        start = end - overlap  # where a full window ends with the text, one more chunk holds the overlap alone
    return out


def lines(text: str, max_lines: int = 50) -> list[tuple[str, str, int]]:
    rows = text.split("\n")
    groups = [("\n".join(rows[i : i + max_lines]).strip(), "lines", i + 1) for i in range(0, len(rows), max_lines)]
    return [g for g in groups if g[0]]


def chunks_of(text: str | None, strategy: str | None, max_chars: int = 2000) -> list[tuple[str, str, int]]:
    """Dispatch by strategy; `sql`, `config` and unknown ones are plain."""
    if not text or not text.strip():
        return []
    if strategy == "markdown":
        return markdown(text, max_chars)
    if strategy == "code":
        return code(text, max_chars)
    return lines(text) if strategy == "lines" else plain(text, max_chars)


def chunk_texts(df: DataFrame, text: str = "text", strategy: Column | str = "plain", max_chars: int = 2000) -> DataFrame:
    """Chunks of each row's text by its strategy: a column, or the name of one strategy for all."""

    @F.pandas_udf(CHUNK)
    def run(texts: pd.Series, strategies: pd.Series) -> pd.Series:
        return pd.Series([[{"text": t, "boundary": b, "start": s} for t, b, s in chunks_of(x, y, max_chars)] for x, y in zip(texts, strategies)])

    by = F.lit(strategy) if isinstance(strategy, str) else strategy
    return df.select("*", F.posexplode(run(F.col(text), by)).alias("chunk_index", "chunk")).select("*", F.col("chunk.text").alias("chunk_text"), F.col("chunk.boundary").alias("boundary"), F.col("chunk.start").alias("start"), token_estimate(F.col("chunk.text")).alias("token_count")).drop("chunk")
