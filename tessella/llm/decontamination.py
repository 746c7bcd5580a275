"""Benchmark decontamination: windows of a benchmark item's size that are within a few word edits of it.

Texts and items become sequences of lower-cased words without ASCII punctuation. For each item size n, every window of
n words is looked at where the document is read, at a document's end also shorter ones; nothing is shuffled. A window
within k edits of an item shares at least n - 1 - 2k of its word pairs (each edit spoils two), so windows with fewer
pairs of the benchmark are passed over without loss; where that number is below one, all windows are taken. The others
and the items are put through the CGK embedding (Chakraborty, Goldenberg and Koucky 2016): a random walk of 3n steps
that copies the current symbol and steps on by a random bit of (step, symbol), after which few edits are few differing
positions. Bit sampling makes LSH keys of some positions of each walk; a window and an item that share a key are
compared by their exact edit distance. How many walks and positions are taken follows from the item's length, the edits
and a target recall: pairs at the threshold are made at random, and the agreement of their walks gives the recall.

The benchmark is the query set: its distinct texts are read in blocks of bounded size, and each block is matched against
all documents, one pass for each block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import as_bytes, batch, map_batches

MIN_WORDS, SIMILARITY, RECALL = 5, 0.8, 0.98
#: Tables of a walk; numbers of walks and positions that are tried, the cheapest first.
SETS = 8
DESIGNS = ((12, 3), (12, 2), (24, 2), (12, 1), (24, 1), (48, 1), (96, 1), (192, 1))
#: Words of items in a block; words of documents that are looked at together.
BLOCK_WORDS, CHUNK = 250_000, 1 << 21
#: Windows that are embedded together.
ROWS = 2048
SCHEMA = "doc_id long, item_id long, n_items long, start_word long, n_words long, edits long, similarity double"

_table = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def words_of(text: bytes | None) -> list[bytes]:
    if not text:
        return []
    return (text if text.isascii() else text.decode("utf-8", "replace").lower().encode()).translate(_table).split()


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def walks_of(rows: np.ndarray, walks: int) -> np.ndarray:
    """CGK embeddings of sequences of one length (a matrix of symbols), all walks side by side: (step, walk, sequence)."""
    count, n = rows.shape
    padded = np.concatenate([rows.astype(np.uint64), np.zeros((count, 1), np.uint64)], axis=1).ravel()
    last, begin = 3 * n, np.arange(count) * (n + 1)
    seeds = np.random.default_rng(n).integers(0, 1 << 62, (walks, 1)).astype(np.uint64)
    walked = np.empty((last, walks, count), np.uint64)
    i = np.zeros((walks, count), np.int64)
    for j in range(last):
        symbol = walked[j] = padded[begin + i]
        # a random bit of (walk, step, symbol)
        bit = (symbol + seeds) * _A + np.uint64((j + 1) * 0x2545F4914F6CDD1D & (1 << 64) - 1)
        i += ((bit ^ (bit >> np.uint64(29))) * _B >> np.uint64(63)).astype(np.int64)
        np.minimum(i, n, out=i)
    return walked


def keys(rows: np.ndarray, walks: int, positions: int, sets: int = SETS) -> np.ndarray:
    """LSH keys of sequences of one length (a matrix of symbols): a row for each table."""
    count, n = rows.shape
    walked = walks_of(rows, walks)
    # positions that each table looks at: in the first 2n steps, as walks have mostly come to the end then
    chosen = np.random.default_rng(n + 1).random((walks, sets, 2 * n)).argsort(axis=2)[:, :, :positions]
    out = np.broadcast_to(np.arange(walks * sets, dtype=np.uint64).reshape(walks, sets, 1), (walks, sets, count))
    for p in range(chosen.shape[2]):
        out = mix(out * _A + walked[chosen[:, :, p], np.arange(walks)[:, None]] + np.uint64(1))
    return out.reshape(walks * sets, count)


@cache
def design(n: int, edits: int, recall: float, pairs: int = 200) -> tuple[int, int]:
    """(walks, positions): the cheapest that find pairs of n words at `edits` edits with the probability `recall`.

    Pairs are made at random, half of them by replacing words and half by dropping and adding as well. A table finds a
    pair with the probability that its positions agree, which is taken from the pair's walks.
    """
    rng = np.random.default_rng(7)
    a, b = np.empty((pairs, n), np.int64), np.empty((pairs, n), np.int64)
    for i in range(pairs):
        x = rng.integers(1, 1 << 40, n)
        moved = edits // 4 if i % 2 else 0
        y = x.copy()
        y[rng.choice(n, edits - 2 * moved, replace=False)] = rng.integers(1, 1 << 40, edits - 2 * moved)
        y = np.delete(y, rng.choice(n, moved, replace=False))
        a[i], b[i] = x, np.insert(y, np.sort(rng.integers(0, len(y) + 1, moved)), rng.integers(1, 1 << 40, moved))
    most = min(max(w for w, _ in DESIGNS), 24)
    x, y = walks_of(a, most)[: 2 * n], walks_of(b, most)[: 2 * n]
    agree = ((x == y) & (x > 0)).mean(0)  # (walk, pair)
    for walks, positions in DESIGNS:
        # more walks than were made are as good as those on average
        miss = np.log1p(-np.minimum(agree[: min(walks, most)] ** positions, 1 - 1e-12)).sum(0) * SETS * max(1, walks / most)
        if 1 - np.exp(miss).mean() >= recall:
            return walks, positions
    return DESIGNS[-1]


def design_for(n: int, edits: int, recall: float) -> tuple[int, int]:
    """The design of the next length of a geometric row, so that a benchmark of many lengths needs few of them."""
    if n <= 20:
        return design(n, edits, recall)
    of = math.ceil(20 * 1.1 ** math.ceil(math.log(n / 20, 1.1) - 1e-9))
    return design(of, min(of, math.ceil(edits * of / n)), recall)


def distances(a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Edit distances of the rows of two matrices of symbols, row by row; of a's rows the first `length` symbols count."""
    n, col = b.shape[1], np.arange(b.shape[1] + 1)
    d = np.tile(col, (len(a), 1))
    out = np.full(len(a), n)
    for i in range(a.shape[1]):
        new = np.empty_like(d)
        new[:, 0] = i + 1
        new[:, 1:] = np.minimum(d[:, :-1] + (a[:, i, None] != b), d[:, 1:] + 1)
        d = np.minimum.accumulate(new - col, axis=1) + col
        np.copyto(out, d[:, n], where=length == i + 1)
    return out


@dataclass
class Items:
    """A block of benchmark items: distinct word sequences with the least id and the number of items that have them."""

    similarity: float = SIMILARITY
    recall: float = RECALL
    vocab: dict[bytes, int] = field(default_factory=dict)
    rows: dict[int, list[tuple[int, int, list[int]]]] = field(default_factory=dict)  # by length: (id, items, symbols)

    def add(self, words: list[bytes], item_id: int | None, n: int) -> None:
        self.rows.setdefault(len(words), []).append((item_id, n, [self.vocab.setdefault(w, len(self.vocab) + 1) for w in words]))

    def ready(self) -> Items:
        self.matrix = {n: np.array([r[2] for r in rows], np.int64) for n, rows in self.rows.items()}
        self.edits = {n: int(n * (1 - self.similarity) + 1e-9) for n in self.rows}
        # of each word pair: the lengths of items that have it, as bits (lengths that share a bit pass more windows on)
        self.bit = {n: i % 64 for i, n in enumerate(sorted(self.matrix))}
        self.seen = np.zeros(1 << 22, np.uint64)
        for n, m in self.matrix.items():
            np.bitwise_or.at(self.seen, self.pair((m[:, :-1] << 32 | m[:, 1:]).ravel()), np.uint64(1 << self.bit[n]))
        self.designs = {n: design_for(n, k, self.recall) for n, k in self.edits.items()}
        self.tables = {}
        for n, m in self.matrix.items():
            k = np.concatenate([keys(m[i : i + ROWS], *self.designs[n]) for i in range(0, len(m), ROWS)], axis=1)
            order = np.argsort(k, axis=None, kind="stable")
            self.tables[n] = k.ravel()[order], order % len(m)  # a key tells its table, so all tables are one
        return self

    @staticmethod
    def pair(x: np.ndarray) -> np.ndarray:
        return (mix(x.astype(np.uint64) * _A) >> np.uint64(42)).astype(np.int64)

    def match(self, symbols: np.ndarray, end: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(start, length, number of the item among those of its length, edits) of all matching windows."""
        out = []
        if not len(symbols):
            return out
        both = np.flatnonzero((symbols[:-1] > 0) & (symbols[1:] > 0))
        lengths = np.zeros(len(symbols) - 1, np.uint64)
        lengths[both] = self.seen[self.pair(symbols[both] << 32 | symbols[both + 1])]
        at = np.flatnonzero(lengths)  # the places of pairs that some item has
        lengths = lengths[at]
        for n in sorted(self.matrix):
            k = self.edits[n]
            need = n - 1 - 2 * k
            if need < 1:  # too many edits for a pair to be left for sure
                start = np.arange(len(symbols))
                start = start[start + n - k <= end[start]]
            else:
                hits = at[(lengths >> np.uint64(self.bit[n]) & np.uint64(1)).astype(bool)]
                if len(hits) < need:
                    continue
                # windows with enough pairs begin at most n - 2 words before the first of `need` pairs in a row
                dense = hits[: len(hits) - need + 1][hits[need - 1 :] - hits[: len(hits) - need + 1] <= n - 2]
                if not len(dense):
                    continue
                start = np.unique((dense[:, None] - np.arange(n - 1)).ravel())
                start = start[start >= 0]
                start = start[start + n - k <= end[start]]
                last = np.minimum(start + n, end[start]) - 1
                start = start[np.searchsorted(hits, last) - np.searchsorted(hits, start) >= need]
            rows = max(64, min(ROWS, (1 << 20) // (n * self.designs[n][0])))  # bounds what the walks hold
            for i in range(0, len(start), rows):
                out += self.verify(symbols, start[i : i + rows], end, n)
        return out

    def verify(self, symbols: np.ndarray, start: np.ndarray, end: np.ndarray, n: int) -> list[tuple[int, int, int, int]]:
        places, stop = start[:, None] + np.arange(n), end[start]
        windows = np.where(places < stop[:, None], symbols[np.minimum(places, len(symbols) - 1)], 0)
        length = np.minimum(stop - start, n)
        (table, items), k = self.tables[n], keys(windows, *self.designs[n]).ravel()
        low, high = np.searchsorted(table, k, "left"), np.searchsorted(table, k, "right")
        at = np.flatnonzero(high > low)
        size, out = len(self.matrix[n]), []
        both = [np.zeros(0, np.int64)]
        many = (high - low)[at]
        cuts = np.searchsorted(np.cumsum(many), np.arange(1 << 20, int(many.sum()), 1 << 20))  # bounds what is held at once
        for part, m in zip(np.split(at, cuts), np.split(many, cuts)):
            item = items[np.repeat(low[part], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)]
            both.append(np.unique(np.repeat(part % len(start), m) * size + item))
        both = np.unique(np.concatenate(both))
        for i in range(0, len(both), 4096):
            w, item = both[i : i + 4096] // size, both[i : i + 4096] % size
            d = distances(windows[w], self.matrix[n][item], length[w])
            ok = d <= self.edits[n]
            out += zip(start[w[ok]].tolist(), [n] * int(ok.sum()), item[ok].tolist(), d[ok].tolist())
        return out


def blocks(benchmark: DataFrame, id_col: str, text_col: str, similarity: float, recall: float, min_words: int) -> Iterator[Items]:
    """The benchmark's distinct word sequences in blocks; those of fewer than `min_words` words can't be told from prose."""

    def normal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = [words_of(t) for t in as_bytes(b.column(1))]
            yield batch(["id", "words", "n"], b.column(0), pa.array([b" ".join(w) for w in words], pa.binary()), pa.array([len(w) for w in words], pa.int64()))

    rows = map_batches(benchmark.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")), normal, "id long, words binary, n long")
    distinct = rows.filter(F.col("n") >= max(1, min_words)).groupBy("words").agg(F.min("id").alias("id"), F.count("*").alias("many"))
    held: list[tuple[list[bytes], int | None, int]] = []
    size = 0
    for r in distinct.orderBy(F.col("id").asc_nulls_last(), "words").toLocalIterator():
        held.append((bytes(r["words"]).split(b" "), r["id"], r["many"]))
        size += len(held[-1][0])
        if size >= BLOCK_WORDS:
            yield filled(held, similarity, recall)
            held, size = [], 0
    if held:
        yield filled(held, similarity, recall)


def filled(held: list, similarity: float, recall: float) -> Items:
    items = Items(similarity, recall)
    for row in held:
        items.add(*row)
    return items.ready()


def matches(texts: list[bytes | None], items: Items) -> Iterator[tuple[int, int, int, int, int]]:
    """(number of the text, start word, length, item, edits), texts put together to be looked at."""
    get, i = items.vocab.get, 0
    while i < len(texts):
        parts, sizes, first = [], [], i
        while i < len(texts) and (not parts or sum(sizes) < CHUNK):
            words = words_of(texts[i])
            parts.append(np.fromiter((get(w, 0) for w in words), np.int64, len(words)))
            sizes.append(len(words))
            i += 1
        ends = np.cumsum(sizes)
        end = np.repeat(ends, sizes)
        for start, n, item, edits in items.match(np.concatenate(parts), end):
            doc = int(np.searchsorted(ends, start, "right"))
            yield first + doc, start - int(ends[doc] - sizes[doc]), n, item, edits


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row for each (row of docs, benchmark text) that match: the best window, the earliest of equally good ones.

    A window has the item's number of words, or fewer where the document ends. `recall` is the probability that a pair
    at the threshold is found; a pair that is returned has the similarity for sure. Benchmark texts that are equal after
    normalising are one item: the least id and their number. Null and empty texts match nothing, nor do items of fewer
    than `min_words` words. Ids may be null or repeat: each row is looked at by itself. Empty tables give no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string"))
    out = empty(docs.sparkSession)
    for items in blocks(benchmark, item_col, item_text, similarity, recall, min_words):
        out = out.union(map_batches(rows, finder(docs.sparkSession, items), SCHEMA))
    return out


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def finder(spark: SparkSession, items: Items):
    shared, names = spark.sparkContext.broadcast(items), [x.split()[0] for x in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        for b in batches:
            ids, best = b.column(0).to_pylist(), {}
            for doc, start, n, item, edits in matches(as_bytes(b.column(1)), items):
                best[doc, n, item] = min(best.get((doc, n, item), (edits, start)), (edits, start))
            rows = [(ids[doc], *items.rows[n][item][:2], start, n, edits, 1 - edits / n) for (doc, n, item), (edits, start) in sorted(best.items())]
            yield batch(names, *(pa.array(list(c), pa.float64() if k == "similarity" else pa.int64()) for k, c in zip(names, zip(*rows) if rows else [()] * 7)))

    return run


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL, min_words: int = MIN_WORDS, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """docs without the rows that match a benchmark item (as in `contaminated`); all columns as they are.

    Null and empty texts match nothing and stay; ids aren't read; repeated rows stay or go together; an empty benchmark
    leaves docs as they are, empty docs give no rows; columns of any name are passed on.
    """
    at = docs.columns.index(text_col)
    for items in blocks(benchmark, item_col, item_text, similarity, recall, min_words):
        shared = docs.sparkSession.sparkContext.broadcast(items)  # a block of the benchmark, bounded by BLOCK_WORDS

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                bad = {m[0] for m in matches(as_bytes(b.column(at)), shared.value)}
                yield b.filter(pa.array([i not in bad for i in range(b.num_rows)], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
