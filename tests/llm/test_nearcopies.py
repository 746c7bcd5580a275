import random

import numpy as np
import pytest

from tessella.llm import nearcopies
from tessella.llm.simhash import shingle_set, signature
from tests.llm import corpus


def brute_similar(texts, similarity=0.8, k=5):
    """{position: the least position of its group} over all pairs."""
    words = [(t or "").lower().split() for t in texts]
    sets = [{tuple(w[i : i + k]) for i in range(max(len(w) - k, 0) + 1)} if w else set() for w in words]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a == sets[j] or len(a & sets[j]) / max(len(a | sets[j]), 1) >= similarity:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(sets))]


def edited(r, base, n):
    out = list(base)
    for at in r.sample(range(len(base)), n):
        out[at] = f"edit{r.randrange(10**6)}"
    return " ".join(out)


def clusters(r, sizes=((40, 2), (25, 9), (30, 5), (1, 0)), words=120):
    """Groups of a text and edits of it; with many edits some pairs of a group are below the threshold."""
    texts = []
    for size, most in sizes:
        base = [f"w{r.randrange(3000)}" for _ in range(words)]
        texts += [edited(r, base, r.randint(0, most)) for _ in range(size)]
    return texts


def kept(spark, texts, **options):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    return {x.doc_id for x in nearcopies.keep_similar(df, **options).collect()}


def test_recall_at_production_parameters(spark):
    """Pairs from 0.8 up are found, pairs below never linked, whatever their fingerprints."""
    r, texts = random.Random(11), []
    for _ in range(400):
        base = [f"w{r.randrange(30000)}" for _ in range(r.choice([40, 150, 400]))]
        texts += [" ".join(base), edited(r, base, max(1, round(len(base) * r.choice([0.005, 0.01, 0.02, 0.025, 0.03, 0.04]))))]
    root = brute_similar(texts)
    alone = {i for i in range(len(texts)) if root[i] == i}
    got = kept(spark, texts)
    assert alone <= got, "no document below the threshold goes"
    assert 100 < len(texts) - len(alone) < 400
    assert len(got - alone) <= 0.03 * (len(texts) - len(alone)), "near copies go"


@pytest.mark.parametrize("options", [{}, {"fan": 1, "block": 400}, {"group": 8, "fan": 1, "block": 400}, {"group": 4, "fan": 2}, {"fan": 30, "block": 800}])
def test_groups(spark, options):
    """Whole groups of near copies are joined, also in crowded buckets, and where a group is dealt to blocks."""
    texts = clusters(random.Random(7))
    expected = {i for i, g in enumerate(brute_similar(texts)) if i == g}
    got = kept(spark, texts, recall=0.9999, **options)
    assert got == expected and len(expected) > 3


def test_blocks_are_used(spark):
    texts = clusters(random.Random(8), ((300, 2),))
    plan = nearcopies.layout(300, 0.8, 0.9999, group=8)
    sets = [shingle_set(t.encode(), 5) for t in texts]
    rows = [(i, len(x), bytearray(np.array(signature(x, plan.words)[1:], np.int64).tobytes())) for i, x in enumerate(sets)]
    nodes = spark.createDataFrame(rows, "node long, size int, sig binary").repartition(3)
    hot = nearcopies.hot_groups(nodes, plan)
    assert hot and all(n > 32 for n in hot.values())
    keys = [x.key for x in nearcopies.emit(nodes, plan, hot).select("key").collect()]
    assert max(np.bincount([k & nearcopies.BLOCKS for k in keys if k & ~nearcopies.BLOCKS in hot]).tolist()) < len(keys) / 4


def test_layout():
    """Groups and buckets stay bounded as documents grow, and the shares of pairs found hold."""
    for n in (0, 1000, 10**6, 10**9, 5 * 10**10):
        plan = nearcopies.layout(n, 0.8)
        assert n / 2**plan.coarse <= nearcopies.GROUP and plan.words * 64 >= plan.segments * plan.width
        assert plan.coarse <= 26 and plan.segments < 2048
    assert nearcopies.layout(15 * 10**6, 0.8).segments < 40


@pytest.mark.parametrize("rows", [corpus.rows(), corpus.odd_rows(), []])
def test_keep_similar(spark, rows):
    df = spark.createDataFrame(rows, corpus.SCHEMA).repartition(3).withColumnRenamed("ord", nearcopies.PLACE)
    got = nearcopies.keep_similar(df)
    assert got.schema == df.schema
    groups = {}
    for r, g in zip(rows, brute_similar([x[1] for x in rows])):
        groups.setdefault(g, []).append(r[0])
    key = lambda x: (x is not None, x)
    out = got.collect()
    assert sorted((r.doc_id for r in out), key=key) == sorted((min(g, key=lambda x: (x is None, x or 0)) for g in groups.values()), key=key)
    assert all(r[nearcopies.PLACE] in (7, None) for r in out)


def test_very_long_text(spark):
    """A text of more shingles than are hashed at once, and its near copy."""
    r = random.Random(4)
    base = [f"w{r.randrange(10**6)}" for _ in range(70_000)]
    assert kept(spark, [" ".join(base), edited(r, base, 900), "another text"]) == {0, 2}
