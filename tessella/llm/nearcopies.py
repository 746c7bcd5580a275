"""Near copies by multi-index hashing of long SimHash fingerprints, decided by the exact Jaccard similarity of shingles.

Plan: shingle sets' fingerprints of 64 bits a seed (one Arrow pass) -> distinct sets (partial aggregation, so a text
copied a billion times is one row) -> a row for each segment of a fingerprint, dealt by the segment's number and its
first `coarse` bits -> in each group the Hamming balls of the segment's other bits, enumerated where they are looked
up, and complete distances of what meets -> exact similarity of each candidate pair -> components of the links.

The number and width of segments follow from the number of documents, so that a group holds about 2**16 fingerprints and
a ball's bucket a few dozens at any size. Enough segments are taken for two sets at the threshold to share one, and to
lie within the distance looked for, with the probability `recall`.

Large groups of near copies cost little more than their size, and no pair is left out. A fingerprint with fewer than
`FAN` partners in a bucket is paired with all of them. The others are dense: at first they are paired with the `HUBS`
fingerprints nearest to the centre of what lies around them, the bitwise majority, which joins most of what belongs
together. These pairs are verified and joined. Then the dense fingerprints are looked at again, for pairs that have not
been joined yet and that could still be similar: a set whose shingles mostly occur in no other dense set can't be.
Groups that are too large for a task are dealt to blocks, the first time with the same few pivots in each, the second
time as pairs of blocks. What remains quadratic are pairs just below the similarity in one group of near copies.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import as_bytes, batch, components, hub_join, hubs, keep_last, map_batches, materialise, written
from tessella.llm.simhash import shingle_set, signature

#: 64-bit words of a fingerprint that complete distances are taken over; bits of a segment that a ball is made of.
CHECK, REST, RADIUS = 4, 12, 2
#: Fingerprints in a group as planned; partners in a bucket that make a fingerprint dense; hubs that it is paired with;
#: rows of a bucket that are compared all at once; pivots of a group that is dealt to blocks.
GROUP, FAN, HUBS, SMALL, PIVOTS = 1 << 16, 6, 3, 32, 16
#: Shingles in a cell of dense fingerprints.
BLOCK = 1 << 22
ROWS = "key long, rest int, node long, size int, " + ", ".join(f"c{i} long" for i in range(CHECK))


@dataclass(frozen=True)
class Layout:
    """How fingerprints are cut: `segments` of `coarse` + REST bits; pairs of up to `distance` of 64 * CHECK bits are compared."""

    coarse: int
    segments: int
    distance: int
    similarity: float
    group: int = GROUP
    fan: int = FAN

    @property
    def width(self) -> int:
        return self.coarse + REST

    @property
    def words(self) -> int:
        return max(CHECK, -(-self.width * self.segments // 64))


def layout(n: int, similarity: float, recall: float = 0.99, group: int = GROUP, fan: int = FAN) -> Layout:
    """For n documents. Two sets of the similarity differ in a bit with the probability angle / pi of their vectors."""
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    at_most = lambda k, bits: sum(math.comb(bits, e) * p**e * (1 - p) ** (bits - e) for e in range(k + 1))
    coarse = max(4, math.ceil(math.log2(max(n, 1) / group)))
    share = (1 - p) ** coarse * at_most(RADIUS, REST)
    segments = math.ceil(math.log(1 - recall) / math.log(1 - share))
    distance = next(k for k in range(64 * CHECK) if at_most(k, 64 * CHECK) >= 1 - (1 - recall) / 2)
    return Layout(coarse, segments, distance, similarity, group, fan)


def segment(words: np.ndarray, s: int, plan: Layout) -> tuple[np.ndarray, np.ndarray]:
    """(coarse bits, other bits) of segment s of fingerprints, a row of words each."""
    word, shift = divmod(s * plan.width, 64)
    v = words[:, word] >> np.uint64(shift)
    if shift + plan.width > 64:
        v = v | words[:, word + 1] << np.uint64(64 - shift)
    return (v & np.uint64((1 << plan.coarse) - 1)).astype(np.int64), (v >> np.uint64(plan.coarse) & np.uint64((1 << REST) - 1)).astype(np.int32)


def spread(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(32))


def emit(nodes: DataFrame, plan: Layout, hot: dict[int, int]) -> DataFrame:
    """Rows (ROWS) of the nodes (node, size, sig): the key is segment, coarse bits and, in a hot group (its rows), a block."""
    names = [x.split()[0] for x in ROWS.split(", ")]
    hot_keys = np.array(sorted(hot), np.int64)
    hot_rows = np.array([hot[k] for k in sorted(hot)], np.int64)

    def dealt(key: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(key with block, number of the node) with pivots in all blocks of their group."""
        every = np.arange(len(key))
        if not len(hot_keys):
            return key, every
        at = np.minimum(np.searchsorted(hot_keys, key), len(hot_keys) - 1)
        n = np.where(hot_keys[at] == key, hot_rows[at], 1)
        blocks, h = -(-n // plan.group), spread(node)
        block = (h >> np.uint64(8)).astype(np.int64) % blocks
        pivot = np.flatnonzero((blocks > 1) & ((h % n.astype(np.uint64)) < PIVOTS))
        more = [np.delete(np.arange(blocks[i]), block[i]) for i in pivot.tolist()]
        again = np.repeat(pivot, [len(m) for m in more])
        return np.concatenate([key | block, key[again] | np.concatenate([np.zeros(0, np.int64), *more])]), np.concatenate([every, again])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node, size = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)
            words = np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint64).reshape(len(node), -1)
            for i in range(0, len(node), 2048):
                part, of = words[i : i + 2048], slice(i, i + 2048)
                keys, rests, at = [], [], []
                for s in range(plan.segments):
                    coarse, rest = segment(part, s, plan)
                    key, number = dealt(s << 52 | coarse << 26, node[of])
                    keys.append(key)
                    rests.append(rest[number])
                    at.append(number)
                at = np.concatenate(at)
                yield batch(names, np.concatenate(keys), np.concatenate(rests), node[of][at], size[of][at], *(np.ascontiguousarray(part[at, c]).view(np.int64) for c in range(CHECK)))

    return map_batches(nodes.select("node", "size", "sig"), run, ROWS)


def hot_groups(nodes: DataFrame, plan: Layout) -> dict[int, int]:
    """Rows of each group that is far larger than planned: 2**20 groups at most, by the limit."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = np.frombuffer(b"".join(b.column(0).to_pylist()), np.uint64).reshape(b.num_rows, -1)
            found, n = np.unique(np.concatenate([s << 52 | segment(words, s, plan)[0] << 26 for s in range(plan.segments)]), return_counts=True)
            yield batch(["key", "n"], found, n)

    counted = map_batches(nodes.select("sig"), keys, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    limit = max(4 * plan.group, nodes.count() * plan.segments >> 20)
    return {r["key"]: r["n"] for r in counted.filter(F.col("n") > limit).collect()}


def groups_of(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[np.ndarray]]:
    """The columns of each group of batches that are sorted by their first `keys` columns."""
    held, last = [], None
    for b in batches:
        columns = [b.column(i).to_numpy(zero_copy_only=False) for i in range(b.num_columns)]
        change = np.zeros(max(b.num_rows - 1, 0), bool)
        for k in columns[:keys]:
            change |= k[1:] != k[:-1]
        bounds = [0, *(np.flatnonzero(change) + 1).tolist(), b.num_rows]
        for s, e in zip(bounds, bounds[1:]):
            if s == e:
                continue
            key = tuple(int(k[s]) for k in columns[:keys])
            if held and key != last:
                yield [np.concatenate(c) for c in zip(*held)]
                held = []
            last = key
            held.append([c[s:e] for c in columns])
    if held:
        yield [np.concatenate(c) for c in zip(*held)]


def balls(rest: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(value, cleared bits, number of the row), sorted by value and row: up to RADIUS set bits are cleared, so two values meet at their AND."""
    values, cleared, rows = [], [], []
    for c in range(RADIUS + 1):
        for bits in combinations(range(REST), c):
            m = sum(1 << x for x in bits)
            at = np.flatnonzero(rest & m == m).astype(np.int32)
            values.append(rest[at] & ~m)
            cleared.append(np.full(len(at), c, np.int8))
            rows.append(at)
    values, cleared, rows = map(np.concatenate, (values, cleared, rows))
    order = np.lexsort((rows, values))
    return values[order], cleared[order], rows[order]


class Group:
    """Fingerprints of one group, in the order of their nodes, and which pairs of them are candidates."""

    def __init__(self, rest: np.ndarray, node: np.ndarray, size: np.ndarray, words: list[np.ndarray], plan: Layout, label: np.ndarray | None = None, shared: np.ndarray | None = None):
        order = np.argsort(node, kind="stable")
        self.node, self.size, self.plan = node[order], size[order].astype(np.float64), plan
        self.shared = None if shared is None else shared[order].astype(np.float64)
        self.words = [w[order].view(np.uint64) for w in words]
        self.label = None if label is None else label[order]
        self.value, self.cleared, self.row = balls(rest[order])
        self.bounds = np.concatenate(([0], np.flatnonzero(self.value[1:] != self.value[:-1]) + 1, [len(self.value)]))

    def near(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Of rows a and b, position by position (or all against all, by broadcasting): whether they are to be compared."""
        d = np.bitwise_count(self.words[0][a] ^ self.words[0][b]).astype(np.int16)
        for w in self.words[1:]:
            d += np.bitwise_count(w[a] ^ w[b])
        return (d <= self.plan.distance) & self.could(a, b)

    def could(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether two sets can have the similarity by their sizes, and by how many of their shingles another set has."""
        x, y, t = self.size[a], self.size[b], self.plan.similarity
        if self.shared is None:
            return np.minimum(x, y) >= t * np.maximum(x, y) - 1e-6
        both = np.minimum(self.shared[a], self.shared[b])
        return both >= t * (x + y - both) - 1e-6

    def small(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Candidates of the small buckets, each row compared with the next, the second next, ...; and the dense rows.

        Pairs of two dense rows are left out. With labels all pairs whose labels differ are given.
        """
        length = np.diff(self.bounds)
        few = np.repeat(length <= SMALL, length)
        v, c, r = self.value[few], self.cleared[few], self.row[few]
        a, b, step = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 1
        at = np.arange(len(v))
        while len(at := at[at + step < len(v)]) and len(at := at[v[at] == v[at + step]]):
            x = at[c[at] + c[at + step] <= RADIUS]
            if self.label is not None:
                x = x[self.label[r[x]] != self.label[r[x + step]]]
            for s in range(0, len(x), 1 << 18):
                part = x[s : s + (1 << 18)]
                ok = self.near(r[part], r[part + step])
                a.append(part[ok])
                b.append(part[ok] + step)
            step += 1
        a, b = map(np.concatenate, (a, b))
        dense = np.zeros(len(v), bool)
        if self.label is None:
            dense = np.bincount(a, minlength=len(v)) + np.bincount(b, minlength=len(v)) >= self.plan.fan
            keep = ~(dense[a] & dense[b])
            a, b = a[keep], b[keep]
        return r[a], r[b], r[dense]

    def large(self) -> list[np.ndarray]:
        """(rows, cleared bits) of each large bucket."""
        return [slice(s, e) for s, e in zip(self.bounds[:-1].tolist(), self.bounds[1:].tolist()) if e - s > SMALL]

    def partners(self, r: np.ndarray, c: np.ndarray, step: int = 512) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs of a bucket's rows (positions): all of those that are not dense; and which rows are dense."""
        a, b, dense = [], [], np.zeros(len(r), bool)
        for i in range(0, len(r), step):
            rows = np.arange(i, min(i + step, len(r)))
            found, xs, ys = np.zeros(len(rows), np.int64), [], []
            left = np.arange(len(rows))
            for j in range(0, len(r), step):
                cols = np.arange(j, min(j + step, len(r)))
                hit = self.near(r[rows[left]][:, None], r[cols][None]) & (c[rows[left]][:, None] + c[cols][None] <= RADIUS) & (rows[left][:, None] != cols[None])
                x, y = np.nonzero(hit)
                xs.append(left[x])
                ys.append(cols[y])
                found[left] += hit.sum(1)
                left = left[found[left] < self.plan.fan]
                if not len(left):
                    break
            x, y = np.concatenate(xs), np.concatenate(ys)
            few = found[x] < self.plan.fan
            a.append(rows[x[few]])
            b.append(y[few])
            dense[rows] = found >= self.plan.fan
        return np.concatenate(a), np.concatenate(b), dense

    def hubs(self, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A group's dense rows, each with the hubs of what lies around the row that comes first of them."""
        a, b = [r[:0]], [r[:0]]
        while len(r):
            near = self.near(r, np.full(len(r), r[0]))
            near[0] = True
            members, r = r[near], r[~near]
            bits = np.unpackbits(np.stack([w[members] for w in self.words], 1).view(np.uint8).reshape(len(members), -1), axis=1)
            away = (bits != (bits.mean(0) > 0.5)).sum(1)
            best = members[np.lexsort((self.node[members], away))[:HUBS]]
            x, y = np.repeat(members, len(best)), np.tile(best, len(members))
            ok = (x != y) & self.near(x, y)
            a.append(x[ok])
            b.append(y[ok])
        return np.concatenate(a), np.concatenate(b)

    def across(self, at: slice, step: int = 1024) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All candidates of a bucket whose labels differ."""
        by = np.argsort(self.label[self.row[at]], kind="stable")
        r, c = self.row[at][by], self.cleared[at][by]
        names = self.label[r]
        for i in range(0, len(r), step):
            for j in range(i, len(r), step):
                x, y = slice(i, i + step), slice(j, j + step)
                if names[i] == names[min(j + step, len(r)) - 1]:
                    continue  # sorted: all of both blocks are joined already
                hit = (names[x][:, None] != names[y][None]) & (c[x][:, None] + c[y][None] <= RADIUS) & (names[x][:, None] < names[y][None])
                if hit.any():
                    p, q = np.nonzero(hit & self.near(r[x][:, None], r[y][None]))
                    if len(p):
                        yield r[x][p], r[y][q]

    def pairs(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Different pairs of nodes, the lesser one first; pivots may stand twice in a group."""
        x, y = np.minimum(self.node[a], self.node[b]), np.maximum(self.node[a], self.node[b])
        if not len(x):
            return x, y
        order = np.lexsort((y, x))
        x, y = x[order], y[order]
        new = np.concatenate(([True], (x[1:] != x[:-1]) | (y[1:] != y[:-1]))) & (x != y)
        return x[new], y[new]


#: The bits of a key that hold a hot group's block.
BLOCKS = (1 << 26) - 1
FOUND = "a long, b long, " + ROWS


def first_pairs(rows: DataFrame, plan: Layout, hot: dict[int, int]) -> DataFrame:
    """Candidate pairs (a, b), and (a is null) the dense rows, which may be in more of them, and all of groups in blocks."""
    names = [x.split()[0] for x in FOUND.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), *[pa.int64()] * CHECK]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, rest, node, size, *words in groups_of(batches, 1):
            if len(key) < 2:
                continue
            g = Group(rest, node, size, words, plan)
            a, b, dense = g.small()
            xs, ys, crowded = [a], [b], np.zeros(len(key), bool)
            crowded[dense] = True
            for at in g.large():
                r, c = g.row[at], g.cleared[at]
                a, b, dense = g.partners(r, c)
                xs.append(r[a])
                ys.append(r[b])
                crowded[r[dense]] = True
            a, b = np.concatenate(xs), np.concatenate(ys)
            one = ~(crowded[a] & crowded[b])  # two dense rows meet again, whatever bucket made them so
            around, hub = g.hubs(np.flatnonzero(crowded))
            a, b = g.pairs(np.concatenate([a[one], around]), np.concatenate([b[one], hub]))
            if int(key[0]) & ~BLOCKS in hot:
                crowded[:] = True
            if len(a):
                yield batch(names, a, b, *(pa.nulls(len(a), k) for k in kinds[2:]))
            order = np.argsort(node, kind="stable")
            again = order[crowded]
            if len(again):
                yield batch(names, *(pa.nulls(len(again), k) for k in kinds[:2]), key[again] & ~BLOCKS, rest[again], node[again], size[again], *(w[again] for w in words))

    return map_batches(rows.repartition("key").sortWithinPartitions("key"), run, FOUND)


def rest_links(rows: DataFrame, joined: DataFrame, sets: DataFrame, plan: Layout, block: int) -> DataFrame:
    """Links (a, b) of rows (ROWS and shared, each once) of one key whose nodes are not joined yet: rows (node, root) in `joined`.

    A key's rows are cut into cells of about `block` shingles: some for what is joined and large, others for the rest.
    Each pair of cells that could hold such a link is a group, so no task has more than two cells and their sets
    (node, shingles). There candidates are compared at once, unless a link has joined them before: no pair leaves a task.
    """

    def hash_of(column: str, n: Column) -> Column:
        return F.pmod(F.xxhash64(column), n)

    labelled = materialise(rows.join(joined.hint("merge"), "node", "left").withColumn("part", F.coalesce("root", "node")).drop("root"), "labelled")
    sizes = labelled.groupBy("key", "part").agg(F.sum("size").alias("n"))
    own = F.col("n") >= block
    totals = sizes.groupBy("key").agg(F.count("*").alias("parts"), F.coalesce(F.sum(F.when(~own, F.col("n"))), F.lit(0)).alias("others")).filter("parts > 1")
    whole = sizes.filter(own).withColumnRenamed("n", "of_part")
    mine = F.col("of_part").isNotNull()
    cut = hub_join(labelled, totals, ["key"]).join(whole, ["key", "part"], "left")
    cell = F.struct(mine.alias("own"), F.when(mine, F.col("part")).otherwise(F.lit(0)).alias("of"), F.when(mine, hash_of("node", F.ceil(F.col("of_part") / block).cast("long"))).otherwise(hash_of("node", F.greatest(F.ceil(F.col("others") / block).cast("long"), F.lit(1)))).alias("block"))
    cut = cut.select(*labelled.columns, cell.alias("cell"))
    cells = cut.select("key", "cell").distinct()
    x, y = (cells.withColumnRenamed("cell", n) for n in "xy")
    pairs = x.join(y, "key").filter("x <= y and not (x.own and y.own and x.of = y.of)").withColumn("pair", F.xxhash64("x", "y"))
    of_cell = pairs.select("key", "pair", F.explode(F.array_distinct(F.array("x", "y"))).alias("cell"))
    dealt = cut.join(of_cell, ["key", "cell"]).join(sets.hint("merge"), "node")  # a node is in a group for each segment and pair of cells

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, part, rest, node, size, shared, *words, held in groups_of(batches, 2):
            g = Group(rest, node, size, words, plan, part, shared)
            held, root, found = held[np.argsort(node, kind="stable")], {}, []

            def find(p: int) -> int:
                while (q := root.get(p, p)) != p:
                    p = q
                return p

            def link(a: np.ndarray, b: np.ndarray) -> None:
                for i, j in zip(a.tolist(), b.tolist()):
                    p, q = find(int(g.label[i])), find(int(g.label[j]))
                    if p != q and jaccard(held[i], held[j]) >= plan.similarity - 1e-12:
                        root[max(p, q)] = min(p, q)
                        found.append((int(g.node[i]), int(g.node[j])))

            link(*g.small()[:2])
            for at in g.large():
                for a, b in g.across(at):
                    link(a, b)
            if found:
                yield batch(["a", "b"], *(pa.array(list(c), pa.int64()) for c in zip(*found)))

    columns = ["key", "pair", "part", "rest", "node", "size", "shared", *(f"c{i}" for i in range(CHECK)), "shingles"]
    return map_batches(dealt.select(columns).repartition("key", "pair").sortWithinPartitions("key", "pair"), run, "a long, b long")


def jaccard(a: bytes, b: bytes) -> float:
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    both = np.sort(np.concatenate([x, y]), kind="stable")  # two sorted runs are merged
    shared = int((both[1:] == both[:-1]).sum())
    return shared / max(1, len(x) + len(y) - shared)


def shingle_sets(nodes: DataFrame, texts: DataFrame, shingle: int) -> DataFrame:
    """(node, shingles) of the nodes; texts are (node, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield batch(["node", "shingles"], b.column(0), pa.array([shingle_set(t, shingle).tobytes() for t in as_bytes(b.column(1))], pa.binary()))

    return materialise(map_batches(texts.join(nodes.select("node").hint("merge"), "node").select("node", "text"), run, "node long, shingles binary"), "sets")


def verified(pairs: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The pairs (a, b) whose shingle sets have the similarity, counted exactly."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = b.column(2), b.column(3)
            yield b.select(["a", "b"]).filter(pa.array([jaccard(x[i].as_py(), y[i].as_py()) >= similarity - 1e-12 for i in range(b.num_rows)], pa.bool_()))

    pairs = materialise(pairs.distinct(), "pairs")
    sets = shingle_sets(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), texts, shingle)
    left = hub_join(pairs, sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), ["a"])
    both = hub_join(left, sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), ["b"], hubs(pairs.select("b"), ["b"]))
    return materialise(map_batches(both.select("a", "b", "x", "y"), compare, "a long, b long"), "similar")


def lone_shingles(sets: DataFrame) -> DataFrame:
    """(node, alone): how many of a set's shingles are in no other of the sets, where there are any. Linear: a row for each shingle."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held = [np.frombuffer(x, np.int64) for x in b.column(1).to_pylist()]
            yield batch(["node", "shingle"], np.repeat(b.column(0).to_numpy(zero_copy_only=False), [len(x) for x in held]), np.concatenate([np.zeros(0, np.int64), *held]))

    each = map_batches(sets.select("node", "shingles"), rows, "node long, shingle long")
    return each.groupBy("shingle").agg(F.count("*").alias("n"), F.min("node").alias("node")).filter("n = 1").groupBy("node").agg(F.count("*").alias("alone"))


def similar_links(nodes: DataFrame, texts: DataFrame, plan: Layout, shingle: int, block: int) -> DataFrame:
    """Links (a, b) of nodes (node, size, sig) whose components are those of all candidate pairs that have the similarity."""
    hot = hot_groups(nodes, plan)
    found = materialise(first_pairs(emit(nodes, plan, hot), plan, hot), "first")
    links = verified(found.filter("a is not null").select("a", "b"), texts, shingle, plan.similarity)
    again = found.filter("a is null").drop("a", "b").distinct()
    if not again.limit(1).count():
        return links
    sets = shingle_sets(again.select("node").distinct(), texts, shingle)
    again = again.join(lone_shingles(sets).hint("merge"), "node", "left").withColumn("shared", (F.col("size") - F.coalesce("alone", F.lit(0))).cast("int")).drop("alone").filter(F.col("shared") >= F.ceil(F.col("size") * plan.similarity - 1e-6))
    return links.union(materialise(rest_links(again, components(links), sets, plan, block), "rest"))


PLACE = "__place"


def free_name(columns: list[str], name: str = PLACE) -> str:
    while name in columns:
        name += "_"
    return name


def keep_similar(docs: DataFrame, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, recall: float = 0.99, group: int = GROUP, fan: int = FAN, block: int = BLOCK) -> DataFrame:
    """docs without near copies: of each group the row with the least id stays, with all its columns.

    Two texts are linked if the Jaccard similarity of their sets of shingles is `similarity` or more, counted exactly; a
    group is what is connected by such links. Texts without words, null and empty ones included, are alike: one of them
    stays. Fingerprints only decide which texts are compared; a pair at the threshold is with the probability `recall`.
    Null ids come last; of rows with the same id one stays, chosen by place. An empty table gives no rows.
    """
    since = written()
    clash = bool(docs.groupBy(id_col).count().filter(F.col(id_col).isNull() | (F.col("count") > 1)).limit(1).count())
    place = free_name(docs.columns)
    rows = materialise(docs.withColumn(place, F.monotonically_increasing_id()), "placed") if clash else docs.withColumn(place, F.col(id_col).cast("long"))
    plan = layout(docs.count(), similarity, recall, group, fan)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            digests, sizes, sigs = [], [], []
            for t in as_bytes(b.column(2)):
                x = shingle_set(t, shingle)
                digest, *words = signature(x, plan.words)
                digests.append(digest)
                sizes.append(len(x))
                sigs.append(np.array(words, np.int64).tobytes())
            yield batch(["place", "given", "digest", "size", "sig"], b.column(0), b.column(1), pa.array(digests, pa.int64()), pa.array(sizes, pa.int32()), pa.array(sigs, pa.binary()))

    texts = rows.select(F.col(place).cast("long").alias("place"), F.col(id_col).cast("long").alias("given"), F.col(text_col).cast("string").alias("text"))
    signed = map_batches(texts, sign, "place long, given long, digest long, size int, sig binary")
    order = F.struct(F.col("given").isNull().alias("last"), "given", "place")
    nodes = materialise(signed.groupBy("digest", "size", "sig").agg(F.min(order).alias("first")).withColumn("node", F.col("first.place")), "nodes")
    # a set of fewer shingles than that is like no other set: one shingle more or less is too much
    searched = nodes.filter(F.col("size") >= math.ceil(similarity / (1 - similarity) - 1e-9)) if similarity < 1 else nodes.limit(0)
    links = similar_links(searched, texts.select(F.col("place").alias("node"), "text"), plan, shingle, block)
    root = components(links).select("node", "root")
    stay = nodes.select("node", "first").join(root, "node", "left").groupBy(F.coalesce("root", "node").alias("group")).agg(F.min("first").alias("first")).select(F.col("first.place").alias(place))
    stay = materialise(stay, "stay")
    if not clash:
        keep_last(docs.sparkSession, since)
    return rows.join(stay, place, "left_semi").select(docs.columns)
