import os

import pytest

from tessella.api import Tessella
from tessella.operators import search
from tessella.operators.engine import Access
from tessella.plans import graph

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def base(spark):
    vector = list(spark.read.parquet(f"{SF}/embeddings.parquet").filter("vec_id = 0").first()["embedding"])
    return Tessella(spark, SF, embedder=lambda texts: [vector for _ in texts])


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_catalog(base):
    s = base.status().first()
    assert s["pages"] == 200 and s["chunks"] == base.corpus.chunks.count()
    assert sum(r.pages for r in base.wings().collect()) == 200 == sum(r.pages for r in base.rooms().collect())
    assert {r.wing for r in base.rooms("en").collect()} == {"en"} and base.pages("src3", 2, 1).count() <= 2


def test_search(base, spark):
    found = base.search("the of", 5).collect()
    assert len(found) == 5 and [r.score for r in found] == sorted((r.score for r in found), reverse=True)
    assert {r.wing for r in base.search("the of", 5, wing="en").collect()} == {"en"}
    spread = base.search("the of", use_graph=True).collect()
    expected = graph.QUERIES["propagate_rerank"](spark, SF).collect()
    assert [(r.chunk_id, round(r.score, 6)) for r in spread] == [(r.chunk_id, r.combined) for r in expected]
    assert base.search("the of", 5, scorer=search.word_overlap).first().score == 1.0
    assert base.wake("the of").count() <= 10
    s = base.cache_stats().first()
    assert s["size"] == 1 and s["misses"] == 1 and s["hits"] >= 4


def test_access(base, spark):
    guarded = Tessella(spark, SF, embedder=base.embedder, access=Access(True, "secret"))
    with pytest.raises(PermissionError):
        guarded.search("the of")
    assert guarded.search("the of", agent="a1", token="secret").count() == 0, "an agent without pages finds nothing"
    assert guarded.search("the of", 3, wing="en", agent="a1", token="Bearer secret").count() == 3


def test_graph(base, spark):
    types, top = base.graph_stats(3)
    assert sum(r.n for r in types.collect()) == base.entities.count() and top.count() == 3
    name = top.first()["id"]
    assert {r.part for r in base.entity(name, 2).collect()} == {"entity", "relation", "chunk"}
    assert base.entity("Nosuchname").count() == 0 and base.find(name[:5]).count() >= 1
    assert base.list_entities("class", 3, 1).count() <= 3 and base.related(0, 5).count() <= 5 and base.uncertain(7).count() == 7
    assert f'"center":"{name}"' in base.subgraph(name, 1, 5).first()["json"]
