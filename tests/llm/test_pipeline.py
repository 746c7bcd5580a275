import random
import zlib

import numpy as np

import corpus_pipeline
from tessella.llm import decontamination, langid, secrets
from tessella.llm.common import remainder
from tests.llm import corpus
from tests.llm import test_nearcopies as nearcopies
from tests.llm import test_rowwise as rowwise

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def prepared(spark, path):
    r = random.Random(3)
    vocab = corpus.words(r, 300)
    prose = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    docs = [(i, prose(r.randint(60, 150)), "en", "s", 0) for i in range(40)]
    passage = prose(25)
    near = docs[5][1].split()
    near[7] = "edited"
    docs += [(100, docs[3][1], "en", "s", 0), (101, " ".join(near), "en", "s", 0), (102, f"{prose(30)} {passage} {prose(30)}", "en", "s", 0)]
    docs += [(103, f"{prose(40)} password = abcdef123456 {prose(9)}", "en", "s", 0), (104, "12 34 !!", "en", "s", 0), (105, None, "en", "s", 0), (106, "", None, None, None)]
    docs = [(*d[:4], len(d[1]) if d[1] is not None else None) for d in docs]
    spark.createDataFrame(docs, COLUMNS).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return docs


def test_stages(spark, tmp_path):
    docs = prepared(spark, tmp_path)
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    df, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, df, str(tmp_path))
        if name != names[-1]:
            assert out.columns == df.columns and [f.dataType for f in out.schema] == [f.dataType for f in df.schema]
        out.write.parquet(f"{tmp_path}/{name}")
        df = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = {r.doc_id: r for r in df.collect()}
    clean = set(range(40))
    assert set(kept["language"]) == clean | {100, 101, 102, 103}
    assert set(kept["near_duplicates"]) == clean | {102, 103}
    assert set(kept["benchmark_leaks"]) == set(kept["secret_spans"]) == clean | {103}
    secret = kept["secret_spans"][103]
    assert "abcdef123456" not in secret.text and secret.n_chars == len(secret.text)
    assert all(kept["secret_spans"][i].text == docs[i][1] for i in clean)
    assert set(kept["sequences"]) == clean | {103}
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == clean | {103}


def brute_stages(docs, items, model):
    """{stage: {doc_id: text}} of documents with different ids, by plain rules."""
    out, left = {}, {}
    for i, text, *_ in docs:
        if any(map(str.isalpha, text or "")):
            _, p, fit = rowwise.brute_posterior(model, text)
            if p >= 0.5 and fit > 0:
                left[i] = text
    out["language"] = left
    ids = sorted(left)
    root = nearcopies.brute_similar([left[i] for i in ids])
    out["near_duplicates"] = left = {i: left[i] for k, i in enumerate(ids) if root[k] == k}
    norm = lambda t: decontamination.words_of(t.encode())
    leaks = set()
    for x in items:
        n, k = len(norm(x)), int(len(norm(x)) * 0.2 + 1e-9)
        for i, t in left.items():
            w = norm(t)
            if any(rowwise.edits(w[s : s + n], norm(x)) <= k for s in range(len(w) - n + k + 1)):
                leaks.add(i)
    out["benchmark_leaks"] = left = {i: t for i, t in left.items() if i not in leaks}
    grammar, clean = secrets.learn(), {}
    for i, t in left.items():
        covered, made = set(), ""
        for _, s, e in rowwise.brute_base(t) + rowwise.brute_format(t, grammar):
            covered |= set(range(s, e))
        for at, c in enumerate(t):
            made += c if at not in covered else "" if at - 1 in covered else "[secret]"
        clean[i] = made
    out["secret_spans"] = clean
    return out


def test_against_brute_force(spark, tmp_path):
    r = random.Random(21)
    vocab = corpus.words(r, 400)
    prose = lambda n: [r.choice(vocab) for _ in range(n)]
    items = [" ".join(prose(r.randint(12, 30))) for _ in range(6)]
    texts = []
    for k in range(150):
        w = prose(r.randint(5, 120))
        kind = k % 6
        if kind == 1 and texts:
            w = r.choice(texts).split()
            for _ in range(r.choice([0, 0, 1, 2, 4])):
                w[r.randrange(len(w))] = f"edit{k}"
        elif kind == 2:
            x = r.choice(items).split()
            for _ in range(r.randint(0, max(0, len(x) // 12))):
                x[r.randrange(len(x))] = "other"
            w[5:5] = x
        elif kind == 3:
            w.insert(3, r.choice(["token=abcdef123456", "AKIA" + "Z7" * 9, "deadbeef" * 4, "ghp_" + "aB3" * 12]))
        texts.append(" ".join(w))
    texts += ["12 34", "", "q w", None]
    docs = [(i, t, "en", "s", len(t) if t is not None else None) for i, t in enumerate(texts)]
    df = spark.createDataFrame(docs, COLUMNS).repartition(3)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    model = langid.train(df.filter(remainder(df["doc_id"], 3) != 1))
    expected, rows = brute_stages(docs, items, model), df
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = spark.createDataFrame(stage(spark, rows, str(tmp_path)).collect(), COLUMNS)
        assert {x.doc_id: x.text for x in rows.collect()} == expected[name], name
    assert 0 < len(expected["benchmark_leaks"]) < len(expected["near_duplicates"]) < len(expected["language"]) < len(docs)
    ids = {i: rowwise.plain_ids(t) + [1] for i, t in expected["secret_spans"].items()}
    got = {}
    for p in corpus_pipeline.run(spark, str(tmp_path)).collect():
        got.setdefault(p.doc_id, []).append((p.start, p.length, p.ids_crc32))
    for i, x in ids.items():
        x = np.array(x, "<u4")
        assert [(s, n, zlib.crc32(x[s : s + n].tobytes())) for s, n, _ in sorted(got[i])] == sorted(got[i]) and sum(n for _, n, _ in got[i]) == len(x)
    assert got.keys() == ids.keys()


def test_empty(spark, tmp_path):
    spark.createDataFrame([], COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names and [n for n in names if n.startswith("op1_")] and all(any(q.startswith(f"op{i}_") for q in names) for i in range(1, 11))
