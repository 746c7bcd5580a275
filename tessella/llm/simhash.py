"""SimHash near-duplicates by multi-index hashing.

Plan: fingerprints (one Arrow pass, no shuffle) -> distinct fingerprints (partial aggregation, so a text copied a
billion times is one row) -> each fingerprint's segments with their small Hamming balls -> segment tables matched by a
shuffle on (segment, value) -> complete distances -> components of the links -> one row per document.

The number of segments follows from the number of fingerprints (three of 21 bits, two of 32 from about 1.3e8 on), so
buckets of chance stay small at any size. With `segments` = m and `radius` = r = m*q + a, two fingerprints within r bits agree within q bits in one of the first
a + 1 segments or within q - 1 bits in another one (Norouzi, Punjani and Fleet 2012). Balls are enumerated downwards
only: both sides clear up to q set bits and meet at the AND of their segments, which halves the probes.

A bucket is compared in blocks inside one task, which returns only a spanning forest of its links, never its pairs.
A bucket of more than `bucket` rows isn't compared in one task. Up to a radius of 4 its fingerprints go to an exact
linear route, in which two fingerprints within 2*h bits share a point within h bits of both, and each point links its
fingerprints to the least. Beyond, a fingerprint has too many points (679,121 within 4 bits), so the bucket is cut into
blocks, and each pair of blocks is a group of its own.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import as_bytes, batch, components, hub_join, keep_last, map_batches, materialise, written

CHUNK = 1 << 16
#: Buckets of up to so many rows are compared row by row, all at once; in larger ones only a spanning forest is kept.
SMALL = 48


def hashed(text: bytes | None, shingle: int, seed: int) -> Iterator[np.ndarray]:
    """Hashes of one text's shingles, in parts: words split at ASCII white space, A-Z lower-cased; fewer words than a shingle has are one."""
    words = text.lower().split() if text else []
    if not words:
        return
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.zeros(len(words), np.int64)
    np.cumsum(lengths[:-1] + 1, out=starts[1:])
    ends = (starts + lengths)[min(shingle, len(words)) - 1 :]
    n, h = len(ends), xxhash.xxh64_intdigest
    for i in range(0, n, CHUNK):
        yield np.array([h(joined[a:b], seed) for a, b in zip(starts[i : min(n, i + CHUNK)].tolist(), ends[i : i + CHUNK].tolist())], np.uint64)


def majority(parts: Iterable[np.ndarray]) -> int:
    """The bits that more than half of the hashes have, as a signed long; no hash: 0."""
    n, ones = 0, np.zeros(64, np.int64)
    for hashes in parts:
        n += len(hashes)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int32)
    return int(np.packbits((ones * 2 > n).astype(np.uint8), bitorder="little").view(np.int64)[0])


def fingerprint(text: bytes | None, shingle: int = 4, seed: int = 42) -> int:
    """64-bit SimHash of one text, repeats counted; no word: 0."""
    return majority(hashed(text, shingle, seed))


def shingle_set(text: bytes | None, shingle: int, seed: int = 42) -> np.ndarray:
    """Sorted hashes of a text's different shingles."""
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *hashed(text, shingle, seed)]))


def mixed(hashes: np.ndarray, seed: int) -> np.ndarray:
    """Other hashes of the same shingles, without reading the text again (the finaliser of SplitMix64)."""
    x = hashes ^ np.uint64(seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def signature(shingles: np.ndarray, seeds: int) -> list[int]:
    """What names a shingle set, then a SimHash of it for each of some seeds."""
    parts = [shingles[i : i + CHUNK] for i in range(0, len(shingles), CHUNK)]
    return [int(np.uint64(xxhash.xxh64_intdigest(shingles.tobytes())).astype(np.int64)), *(majority(mixed(x, seed) for x in parts) for seed in range(seeds))]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, fp0) for each row: the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield batch(["doc_id", "fp0"], b.column(0), pa.array([fingerprint(t, shingle, seed) for t in as_bytes(b.column(1))], pa.int64()))

    return map_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string")), run, "doc_id long, fp0 long")


def segments_of(segments: int, radius: int) -> list[tuple[int, int, int]]:
    """(shift, width, ball radius) of each segment; a segment that needs no search (radius below 0) is left out."""
    if not 2 <= segments <= 32:
        raise ValueError("a segment's number and value share one 64-bit key: 2 to 32 segments")
    q, a = divmod(radius, segments)
    widths = [64 // segments + (i < 64 % segments) for i in range(segments)]
    return [(sum(widths[:i]), w, q if i <= a else q - 1) for i, w in enumerate(widths) if i <= a or q]


def balls(fps: np.ndarray, segments: int, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows (key, cleared bits, fingerprint); the key holds the segment's number in its top bits."""
    keys, cleared, owner = [], [], []
    for s, (shift, width, q) in enumerate(segments_of(segments, radius)):
        value = (fps >> np.uint64(shift)) & np.uint64((1 << width) - 1)
        for c in range(q + 1):
            for bits in combinations(range(width), c):
                m = np.uint64(sum(1 << x for x in bits))
                has = (value & m) == m
                keys.append((value[has] & ~m) | np.uint64(s << 58))
                cleared.append(np.full(int(has.sum()), c, np.int8))
                owner.append(fps[has])
    return np.concatenate(keys), np.concatenate(cleared), np.concatenate(owner)


def forest(fps: np.ndarray, cleared: np.ndarray, within: int, radius: int, block: int = 2048) -> tuple[np.ndarray, np.ndarray]:
    """Links (child, parent) that join what one bucket's rows link: distance <= radius, cleared bits together <= within."""
    n = len(fps)
    root = np.arange(n)

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for i in range(0, n, block):
        for j in range(i, n, block):
            near = np.bitwise_count(fps[i : i + block, None] ^ fps[None, j : j + block]) <= radius
            near &= cleared[i : i + block, None] + cleared[None, j : j + block] <= within
            if i == j:
                near &= np.tri(*near.shape, -1, dtype=bool).T
            if near.any():
                # a block's links by rows: each row links to its first match, and matches of one row to each other
                for a in np.flatnonzero(near.any(1)).tolist():
                    ra = find(i + a)
                    hits = np.flatnonzero(near[a]) + j
                    for c in hits[root[hits] != ra].tolist():
                        rc = find(c)
                        if rc != ra:
                            root[max(ra, rc)] = ra = min(ra, rc)
    parents = np.array([find(x) for x in range(n)], np.int64)
    child = np.flatnonzero(parents != np.arange(n))
    return fps[child], fps[parents[child]]


def segments_for(n: int, radius: int, rows: int = 64) -> int:
    """The most segments that leave about `rows` of n fingerprints to a segment's value: two or three, so that a ball is small."""
    bits = max(1.0, np.log2(max(n, 1) / rows))
    return int(min(max(64 // bits, 2), 3, radius + 1))


def links(fps: DataFrame, segments: int | None = None, radius: int = 4, bucket: int = 20_000) -> DataFrame:
    """Links (a, b) of distinct fingerprints (column fp) whose components are those of all pairs within `radius` bits.

    The number of segments follows from the number of fingerprints where it isn't given, so buckets of chance stay small.
    """
    segments = segments or segments_for(fps.count(), radius)
    within = [q for _, _, q in segments_of(segments, radius)]
    names = ["a", "b", "hot", "key", "cleared"]

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            all_fps = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for i in range(0, len(all_fps), 4096):
                k, c, f = balls(all_fps[i : i + 4096], segments, radius)
                yield batch(["key", "cleared", "fp"], k.view(np.int64), c, f.view(np.int64))

    def small(k: np.ndarray, c: np.ndarray, f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All links within groups of a few rows, by comparing each row with the next, the second next, ..."""
        limit = np.array(within)[(k.view(np.uint64) >> np.uint64(58)).astype(np.int64)]
        a, b, d = [], [], 1
        while d < len(k) and (same := k[d:] == k[:-d]).any():
            same &= (c[d:] + c[:-d] <= limit[d:]) & (np.bitwise_count(f[d:] ^ f[:-d]) <= radius) & (f[d:] != f[:-d])
            at = np.flatnonzero(same)
            a.append(f[at])
            b.append(f[at + d])
            d += 1
        return (np.concatenate(a), np.concatenate(b)) if a else (f[:0], f[:0])

    def groups(k: np.ndarray, c: np.ndarray, f: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Compares whole buckets: the small ones together, the others one by one."""
        bounds = group_bounds(k)
        size = np.diff(bounds)
        large = np.flatnonzero(size > SMALL)
        rest = np.repeat(size <= SMALL, size)
        found = [small(k[rest], c[rest], f[rest])]
        for g in large.tolist():
            s, e = int(bounds[g]), int(bounds[g + 1])
            if e - s > bucket:
                yield passed(k[s:e], c[s:e], f[s:e])
            else:
                found.append(forest(f[s:e], c[s:e], within[int(k[s]) >> 58 & 63], radius))
        a, b = (np.concatenate(x) for x in zip(*found))
        if len(a):
            yield batch(names, a.view(np.int64), b.view(np.int64), np.zeros(len(a), bool), np.zeros(len(a), np.int64), np.zeros(len(a), np.int8))

    def passed(k: np.ndarray, c: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
        """Rows of a bucket that is too large for one task."""
        return batch(names, f.view(np.int64), f.view(np.int64), np.ones(len(f), bool), k, c.astype(np.int8))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        hot = None  # the key of a bucket that is too large, whose rows pass through
        for x in batches:
            k, c, f = (x.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            c, f = c.astype(np.int16), f.view(np.uint64)
            if hot is not None:
                n = int(np.searchsorted(k, hot, "right"))
                yield passed(k[:n], c[:n], f[:n])
                k, c, f = k[n:], c[n:], f[n:]
                hot = hot if not len(k) else None
            held.append((k, c, f))
            if sum(len(h[0]) for h in held) >= 1 << 16:
                k, c, f = (np.concatenate(h) for h in zip(*held))
                last = int(np.searchsorted(k, k[-1], "left"))  # the last bucket may go on
                yield from groups(k[:last], c[:last], f[:last]) if last else ()
                k, c, f = k[last:], c[last:], f[last:]
                if len(k) > bucket:
                    hot = k[0]
                    yield passed(k, c, f)
                    k, c, f = k[:0], c[:0], f[:0]
                held = [(k, c, f)]
        k, c, f = (np.concatenate(h) for h in zip(*held)) if held else (np.zeros(0, np.int64),) * 3
        if len(k):
            yield from groups(k, c, f)

    rows = map_batches(fps.select("fp"), probe, "key long, cleared tinyint, fp long")
    found = materialise(map_batches(rows.repartition("key").sortWithinPartitions("key"), compare, "a long, b long, hot boolean, key long, cleared tinyint"), "near")
    out = found.filter("not hot").select("a", "b")
    hot = found.filter("hot").select("key", "cleared", F.col("a").alias("fp"))
    if hot.limit(1).count():
        out = out.union(through_midpoints(hot.select(F.col("fp").alias("a")).distinct(), radius) if radius <= 4 else by_block_pairs(hot, within, radius, bucket))
    return out


def by_block_pairs(rows: DataFrame, within: list[int], radius: int, size: int) -> DataFrame:
    """Links of the buckets in rows (key, cleared, fp): each is cut into blocks of about `size` rows, and a group holds two blocks."""

    def compare(group: pa.Table) -> pa.Table:
        k, c, f = (group.column(n).to_numpy() for n in ("key", "cleared", "fp"))
        a, b = forest(f.view(np.uint64), c.astype(np.int16), within[int(k[0]) >> 58 & 63], radius)
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    # at least two blocks, so that rows of one block meet in the pairs that it is in
    counts = rows.groupBy("key").agg(F.greatest(F.ceil(F.count("*") / size), F.lit(2)).cast("long").alias("blocks"))
    placed = rows.join(counts, "key").withColumn("block", F.pmod(F.xxhash64("fp"), "blocks"))
    return dealt(placed, F.col("block"), F.col("blocks")).groupBy("key", "x", "y").applyInArrow(compare, "a long, b long")


def dealt(rows: DataFrame, block: Column, blocks: Column) -> DataFrame:
    """Each row once for each pair (x, y) of different blocks that holds the row's block."""
    other = F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1))
    return rows.withColumn("other", other).filter(F.col("other") != block).withColumns({"x": F.least(block, "other"), "y": F.greatest(block, "other")}).drop("other")


def group_bounds(keys: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]))


def through_midpoints(fps: DataFrame, radius: int) -> DataFrame:
    """Links of fingerprints (column a) within `radius` bits, in linear work: each shares a point within half of it.

    For an odd radius the halves are rounded up on one side: a point counts for a pair only if the two parts sum up to
    `radius` at most, so both the points of the lower half and those of the upper half are kept apart by `d`.
    """
    low, high = radius // 2, radius - radius // 2

    def points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks = [(sum(1 << x for x in bits), c) for c in range(high + 1) for bits in combinations(range(64), c)]
        m = np.array([x for x, _ in masks], np.uint64)
        far = np.array([c > low for _, c in masks])
        for b in batches:
            f = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for i in range(0, len(f), 64):
                part = f[i : i + 64]
                yield batch(["point", "far", "a"], (part[:, None] ^ m[None]).ravel().view(np.int64), np.tile(far, len(part)), np.repeat(part, len(m)).view(np.int64))

    rows = map_batches(fps.select("a"), points, "point long, far boolean, a long")
    hub = rows.groupBy("point").agg(F.min(F.when(~F.col("far"), F.col("a"))).alias("b")).filter("b is not null")
    return rows.join(hub, "point").filter("a <> b").select("a", "b").distinct()


def grouped(distinct: DataFrame, segments: int | None, radius: int) -> DataFrame:
    """(fp0, root) of distinct fingerprints: root names the component."""
    since = written()
    roots = components(links(distinct.select(F.col("fp0").alias("fp")), segments, radius))
    keep_last(distinct.sparkSession, since)
    return distinct.select("fp0").join(roots.withColumnRenamed("node", "fp0"), "fp0", "left").select("fp0", F.coalesce("root", "fp0").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, segments: int | None = None, radius: int = 4) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of docs.

    component_id is the least doc_id reachable over links of `radius` bits or fewer. Null or wordless texts have the
    fingerprint 0 and are linked like any other; a null doc_id counts as no id in the minimum (component_id is null
    only if a component has no id at all); repeated rows are returned as often as given; an empty table gives no rows.
    """
    found = materialise(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    # least ids are aggregated by fingerprint before anything is joined: copies of a text meet as one row of each task
    first = materialise(found.groupBy("fp0").agg(F.min("doc_id").alias("first")), "distinct")
    rooted = materialise(first.join(grouped(first, segments, radius), "fp0"), "rooted")
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = hub_join(rooted, least, ["root"]).select("fp0", "component_id")
    return hub_join(found, named, ["fp0"]).select("doc_id", F.lower(F.lpad(F.hex("fp0"), 16, "0")).alias("fingerprint"), "component_id")
