import hashlib
import random

import pytest

from tessella.llm import substrings
from tests.llm import corpus


def brute(rows, length):
    seen, out = set(), []
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        b = (r[1] or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            x = b[p : p + length]
            if x in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(x)
        kept = bytes(c for c, g in zip(b, gone) if not g)
        runs = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((r[0], len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def repetitive(seed):
    r = random.Random(seed)
    vocab = corpus.words(r, 40, "abcdé")
    base = [" ".join(r.choice(vocab) for _ in range(r.randint(30, 200))) for _ in range(10)]
    rows = []
    for i in range(70):
        t = " ".join(r.choice(vocab) for _ in range(r.randint(0, 60)))
        for _ in range(r.randint(0, 4)):
            x = r.choice(base)
            a = r.randint(0, len(x))
            t += x[a : a + r.randint(0, 500)]
        t = "a" * r.randint(50, 2000) + t if i % 9 == 0 else "ab c" * r.randint(50, 300) if i % 11 == 0 else t
        rows.append((i * 2, t))
    return [*rows, (1, None), (3, ""), (5, rows[4][1]), (7, rows[4][1][:-1]), (9, "\0" * 300 + rows[6][1])]


key = lambda r: tuple((x is not None, x) for x in r)


@pytest.mark.parametrize(("seed", "block"), [(1, 4096), (2, 2), (3, 5)])
def test_against_brute_force(spark, seed, block):
    rows = repetitive(seed)
    got = substrings.deduplicate(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), block=block).collect()
    assert sorted(map(tuple, got), key=key) == sorted(brute(rows, 100), key=key)


@pytest.mark.parametrize(("length", "anchor"), [(30, 8), (50, 20)])
def test_other_lengths(spark, length, anchor):
    rows = repetitive(4)
    got = substrings.deduplicate(spark.createDataFrame(rows, "doc_id long, text string"), length, anchor).collect()
    assert sorted(map(tuple, got), key=key) == sorted(brute(rows, length), key=key)


@pytest.mark.parametrize("rows", [corpus.odd_rows(), []])
def test_odd_rows(spark, rows):
    got = substrings.deduplicate(spark.createDataFrame(rows, corpus.SCHEMA)).collect()
    assert sorted(map(tuple, got), key=key) == sorted(brute(rows, 100), key=key)


def test_pieces_of_a_long_text(monkeypatch):
    text = " ".join(corpus.words(random.Random(2), 3000)).encode()
    whole = [tuple(x.tolist()) for x in next(substrings.phrases(text))]
    monkeypatch.setattr(substrings, "PIECE", 1000)
    starts = [(s, t) for low, high, trigger in substrings.phrases(text) for a, b, t in zip(low, high, trigger) for s in range(a, b + 1)]
    assert starts == [(s, t) for a, b, t in zip(*whole) for s in range(a, b + 1)]
