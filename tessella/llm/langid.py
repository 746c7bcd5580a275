"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts n-grams in one Arrow pass over a bounded sample of labelled rows and sums them by (language, bucket):
at most 2**BITS rows for each language reach the driver. Scoring sends the log-probability matrix to the workers once.
There the texts of a batch are one sparse matrix of documents by buckets, in the order in which the n-grams stand, and
its product with the log-probability matrix is one gather and one sum by document. No shuffle of texts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import as_bytes, batch, map_batches

BITS, GRAMS = 16, (1, 2, 3, 4)
#: Labelled rows that training reads at most: those with the least hash of their id.
SAMPLE = 6000
CHUNK = 1 << 18
UNKNOWN = "und"

_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Whether a code point is a letter."""
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letters[0]


def folded(text: str) -> tuple[np.ndarray, bool]:
    """A text as code points with a space in front: lower-cased letters, all else a word boundary, runs of them once; whether it has a letter."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    is_letter = letters()[codes]
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]
    return np.concatenate(([32], np.where(is_letter, codes, 32)[keep])).astype(np.uint64), bool(is_letter.any())


def grams(codes: np.ndarray, of: np.ndarray | None = None, most: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, buckets) of the n-grams that begin before place `most`, for each size; none crosses a change of `of`."""
    h = np.zeros(len(codes), np.uint64)
    for n in range(1, max(GRAMS) + 1):
        if len(codes) < n:
            return
        h = (h[: len(codes) - n + 1] + codes[n - 1 :] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        if n in GRAMS:
            at = np.arange(len(h)) if of is None else np.flatnonzero(of[: len(h)] == of[n - 1 :])
            at = at if most is None else at[:most]
            yield at, (h[at] >> np.uint64(64 - 16 - BITS) & np.uint64((1 << BITS) - 1)).astype(np.int64)


def features(text: str) -> Iterator[np.ndarray]:
    """Buckets of a text's n-grams, in chunks."""
    codes, _ = folded(text)
    for i in range(0, len(codes), CHUNK):
        for _, ids in grams(codes[i : i + CHUNK + max(GRAMS) - 1], most=CHUNK):
            yield ids


@dataclass
class Model:
    classes: list[str]
    log_prob: np.ndarray  # buckets x classes
    prior: np.ndarray

    def totals(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each text: log probabilities by class, the number of n-grams, and whether it has a letter."""
        total, n, lettered = np.zeros((len(texts), len(self.classes))), np.zeros(len(texts), np.int64), np.zeros(len(texts), bool)
        held, docs, size = [], [], 0

        def flush() -> None:
            codes, of = np.concatenate(held), np.repeat(docs, [len(x) for x in held])
            for at, ids in grams(codes, of):
                owner = of[at]
                first = np.flatnonzero(np.concatenate((owner[:1] >= 0, owner[1:] != owner[:-1])))
                if len(first):
                    total[owner[first]] += np.add.reduceat(self.log_prob[ids], first, axis=0, dtype=np.float64)
                    n[owner[first]] += np.diff(np.append(first, len(owner)))

        for i, t in enumerate(texts):
            codes, lettered[i] = folded(t.decode("utf-8", "replace")) if t else (None, False)
            if not lettered[i]:
                continue
            if len(codes) > CHUNK:  # a very long text by itself, in parts
                for j in range(0, len(codes), CHUNK):
                    for _, ids in grams(codes[j : j + CHUNK + max(GRAMS) - 1], most=CHUNK):
                        total[i] += self.log_prob[ids].sum(0, dtype=np.float64)
                        n[i] += len(ids)
                continue
            if size + len(codes) > CHUNK and held:
                flush()
                held, docs, size = [], [], 0
            held.append(codes)
            docs.append(i)
            size += len(codes)
        if held:
            flush()
        return total, n, lettered

    def score(self, texts: list[bytes | None]) -> list[tuple[str, float, float]]:
        """(language, its posterior probability, fit) of each text; `und` and 0 without a letter or a learned language.

        The fit is the mean log probability of the text's n-grams in that language, less that of buckets drawn at random:
        below 0 the language explains the text no better than chance, whatever its share against the other languages.
        """
        if not self.classes:
            return [(UNKNOWN, 0.0, 0.0)] * len(texts)
        total, n, lettered = self.totals(texts)
        whole = total + self.prior
        best = whole.argmax(1)
        rows = np.arange(len(texts))
        p = 1 / np.exp(whole - whole[rows, best][:, None]).sum(1)
        fit = total[rows, best] / np.maximum(n, 1) + math.log(1 << BITS)
        return [(self.classes[k], x, f) if ok else (UNKNOWN, 0.0, 0.0) for k, x, f, ok in zip(best.tolist(), p.tolist(), fit.tolist(), lettered.tolist())]


def train(labelled: DataFrame, sample: int = SAMPLE, smoothing: float = 0.5, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learns from at most `sample` rows (plus rows of equal hash) of labelled rows with a language and an id."""
    rows = labelled.select(F.xxhash64(F.col(id_col).cast("long")).alias("h"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).filter("lang is not null and text is not null")
    last = rows.select("h").orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    if last is None:
        return Model([], np.zeros((1 << BITS, 0), np.float32), np.zeros(0))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        docs: dict[str, int] = {}
        for b in batches:
            for t, lang in zip(as_bytes(b.column(0)), b.column(1).to_pylist()):
                into = sums.setdefault(lang, np.zeros(1 << BITS, np.int64))
                docs[lang] = docs.get(lang, 0) + 1
                for ids in features(t.decode("utf-8", "replace")):
                    into += np.bincount(ids, minlength=1 << BITS)
        for lang, s in sums.items():
            at = np.flatnonzero(s)
            yield batch(["lang", "bucket", "n"], pa.array([lang] * (len(at) + 1), pa.string()), np.append(at, -1), np.append(s[at], docs[lang]))

    counted = map_batches(rows.filter(F.col("h") <= last).select("text", "lang"), count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    classes = sorted(set(counted["lang"]))
    matrix, prior = np.full((1 << BITS, len(classes)), smoothing), np.zeros(len(classes))
    col = counted["lang"].map({c: i for i, c in enumerate(classes)}).to_numpy()
    bucket, n = counted["bucket"].to_numpy(), counted["n"].to_numpy()
    matrix[bucket[bucket >= 0], col[bucket >= 0]] += n[bucket >= 0]
    prior[col[bucket < 0]] = n[bucket < 0]
    return Model(classes, np.log(matrix / matrix.sum(0)).astype(np.float32), np.log(prior / prior.sum()))


def predict(docs: DataFrame, model: Model, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for each row.

    Null texts and texts without a letter are `und` with score 0, and so is every text if no language was learned;
    a null id is kept and counts as not held out; ties go to the first language by name; extra columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded: 2**BITS rows of one float for each language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scored = shared.value.score(as_bytes(b.column(2)))
            yield batch(["doc_id", "held_out", "lang_pred", "score"], b.column(0), b.column(1), pa.array([x for x, _, _ in scored], pa.string()), pa.array([p for _, p, _ in scored], pa.float64()))

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(text_col).cast("string"))
    return map_batches(rows, run, "doc_id long, held_out boolean, lang_pred string, score double")


def keep(docs: DataFrame, model: Model, least: float, fit: float = 0.0, text_col: str = "text") -> DataFrame:
    """docs without the rows whose text has no letter, or no learned language with at least `least` probability, or none
    that explains its n-grams better than chance by more than `fit` (natural log units an n-gram).

    Null and empty texts have no letter and go, and so does every text if no language was learned. Ids aren't read and
    may be null or repeat; repeated rows stay or go together; an empty table gives no rows; columns of any name stay.
    """
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scored = shared.value.score(as_bytes(b.column(at)))
            yield b.filter(pa.array([lang != UNKNOWN and p >= least and f > fit for lang, p, f in scored], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
