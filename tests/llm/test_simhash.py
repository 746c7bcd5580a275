import random

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from tessella.llm import simhash
from tessella.llm.common import hub_join
from tests.llm import corpus


def brute_fp(text, k=4):
    w = [x for x in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if x]
    if not w:
        return 0
    s = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, radius):
    """{fingerprint: the least fingerprint of its component}"""
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    u = sorted(root)
    for i, a in enumerate(u):
        for b in u[i + 1 :]:
            if bin(a ^ b).count("1") <= radius:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {f: find(f) for f in u}


@given(st.text(alphabet="aB é\t\n\u00a0x", max_size=60))
def test_fingerprint(text):
    assert simhash.fingerprint(text.encode()) & (1 << 64) - 1 == brute_fp(text)


def check(rows, got, radius=4):
    fps = [brute_fp(r[1]) for r in rows]
    comp = brute_components(fps, radius)
    least = {}
    for r, f in zip(rows, fps):
        c = comp[f]
        least[c] = min((x for x in (least.get(c), r[0]) if x is not None), default=None)
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(((r[0], f"{f:016x}", least[comp[f]]) for r, f in zip(rows, fps)), key=key)


@pytest.mark.parametrize("rows", [corpus.rows(), corpus.odd_rows(), []])
def test_near_duplicates(spark, rows):
    check(rows, simhash.near_duplicates(spark.createDataFrame(rows, corpus.SCHEMA).repartition(3)).collect())


@pytest.mark.parametrize(("segments", "radius", "bucket"), [(3, 4, 20_000), (2, 4, 20_000), (4, 8, 20_000), (3, 5, 3), (3, 4, 2), (2, 2, 9)])
def test_links(spark, segments, radius, bucket):
    r = np.random.default_rng(3)
    centres = r.integers(0, 1 << 63, 12, np.int64)
    fps = set(r.integers(0, 1 << 63, 60, np.int64).tolist())
    for c in centres.tolist():
        for _ in range(20):
            x = c
            for b in r.choice(63, r.integers(0, 6), replace=False).tolist():
                x ^= 1 << b
            fps.add(x)
    df = spark.createDataFrame([(f,) for f in fps], "fp long").repartition(4)
    edges = [(a, b) for a, b in simhash.links(df, segments, radius, bucket).collect()]
    assert all(bin(a ^ b).count("1") <= radius for a, b in edges)
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    assert {f: find(f) for f in fps} == brute_components(fps, radius)


@pytest.mark.parametrize("bucket", [2, 9])
def test_links_of_hot_buckets_beyond_midpoints(spark, monkeypatch, bucket):
    monkeypatch.setattr(simhash, "through_midpoints", lambda *a: pytest.fail("679,121 points for each fingerprint"))
    test_links(spark, 4, 8, bucket)


def test_components(spark):
    r = np.random.default_rng(5)
    edges = [(int(a), int(b)) for a, b in r.integers(0, 400, (260, 2))] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, i) for i in range(2001, 2300)]
    got = {x.node: x.root for x in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    assert got == {x: find(x) for x in root if find(x) != x}


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(0, 1 << 12), min_size=2, max_size=40, unique=True), st.integers(0, 3))
def test_forest(values, radius):
    fps = np.array(values, np.uint64)
    a, b = simhash.forest(fps, np.zeros(len(fps), np.int16), 0, radius, block=7)
    assert len(a) == len(fps) - len(set(brute_components(values, radius).values()))


def test_segments_follow_the_count():
    assert [simhash.segments_for(n, 4) for n in (0, 10**5, 10**8, 10**9, 10**11)] == [3, 3, 3, 2, 2]


def test_hub_join(spark):
    """Keys with most of the rows are dealt to several tasks; nothing is lost or made twice."""
    rows = [(1 if i % 3 else i, i) for i in range(9000)]
    df, one = spark.createDataFrame(rows, "k long, v long"), spark.createDataFrame([(k, k * 2) for k in {k for k, _ in rows if k % 2}], "k long, w long")
    got = sorted(map(tuple, hub_join(df, one, ["k"]).select("k", "v", "w").collect()))
    assert got == sorted((k, v, 2 * k) for k, v in rows if k % 2)
