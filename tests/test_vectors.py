"""k-NN against brute force, on both ways of computing it."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfmark.operators import knn as kn
from shelfmark.operators.embed import embed
from shelfmark.operators.requests import refused_requests, semantic_search

DIM = 8


def vectors(n, seed):
    rng = np.random.default_rng(seed)
    rows = rng.normal(size=(n, DIM)).astype(np.float32)
    rows[n // 2 :: 3] = rows[0]  # a third of the second half are copies
    rows[1] = 0
    return rows


def brute(queries, rows, parts, qparts, k):
    out = {}
    unit = lambda m: m / np.where((s := np.linalg.norm(m, axis=1, keepdims=True)) == 0, 1, s)
    scores = np.round(unit(queries.astype(float)) @ unit(rows.astype(float)).T, 12)
    for q in range(len(queries)):
        ids = [i for i in range(len(rows)) if qparts is None or parts[i] == qparts[q]]
        out[q] = sorted(ids, key=lambda i: (-scores[q, i], i))[:k]
    return out


@pytest.mark.parametrize("cells", [False, True])
@pytest.mark.parametrize("part", [None, "topic"])
def test_knn(spark, cells, part):
    rows, queries = vectors(300, 1), vectors(12, 2)
    topics = [f"t{i % 3}" for i in range(300)]
    v = spark.createDataFrame(
        [(i, r.tolist(), topics[i]) for i, r in enumerate(rows)], "id long, embedding array<float>, topic string"
    ).repartition(5)
    q = spark.createDataFrame(
        [(i, r.tolist(), topics[i]) for i, r in enumerate(queries)], "qid long, embedding array<float>, topic string"
    )
    size = {"max_query_values": 4 * DIM, "cell_values": 100 * DIM} if cells else {}
    got = kn.knn(q, v, 7, part=part, **size).collect()
    found = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        found.setdefault(r.qid, []).append(r.id)
    assert found == brute(queries, rows, topics, topics if part else None, 7)


def test_string_ids_and_bad_dimension(spark):
    v = spark.createDataFrame(
        [("b", [1.0, 0.0]), ("a", [1.0, 0.0]), ("c", [1.0]), ("d", None)], "id string, embedding array<float>"
    )
    q = spark.createDataFrame([("q", [2.0, 0.0])], "qid string, embedding array<float>")
    got = kn.knn(q, v, 5, dim=2).orderBy("rank").collect()
    assert [(r.id, r.score) for r in got] == [("a", 1.0), ("b", 1.0)]
    fits, rejected = kn.check_dim(v, 2)
    assert fits.count() == 2 and rejected.count() == 2


def test_odd_vectors_push_nothing_out(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0])] + [(i, [1.0, float(i)]) for i in range(1, 9)] + [(20, [nan, 1.0]), (21, [inf, 0.0])]
    v = spark.createDataFrame(rows, "id long, embedding array<float>")
    q = spark.createDataFrame([(1, [1.0, 0.0], 3), (1, [1.0, 0.0], 3), (2, [0.0, 1.0], 30)], "qid int, embedding array<float>, n int")
    got = kn.knn(q, v, limit_col="n").collect()
    assert sorted((r.qid, r.id) for r in got) == [(1, 1), (1, 2), (1, 3)] + [(2, i) for i in range(1, 9)]


def test_embed_models(spark):
    df = spark.createDataFrame([("good",), ("bad",), ("",)], "t string")

    def factory():
        def model(texts):
            if "bad" in texts:
                raise ValueError("no")
            return [[float(len(t))] if t else [] for t in texts]

        return model

    got = {r.t: r.embedding for r in embed(df, "t", factory).collect()}
    assert got == {"good": [4.0], "bad": None, "": None}
    with pytest.raises(Exception, match="no embedding for text: bad"):
        embed(df.filter("t = 'bad'"), "t", factory, on_error="fail").collect()


def test_semantic_search(spark):
    docs = embed(
        spark.createDataFrame(
            [("a", "river bank", "geo"), ("b", "quantum wave", "phys"), ("c", "river", "phys")],
            "id string, text string, topic string",
        ), "text", dim=32,
    )
    asked = spark.createDataFrame(
        [(1, "river bank", "", "", 1), (2, "river bank", "", "phys", 0), (3, "", "", "", 0),
         (4, "x", "AAAA", "", 0)],
        "qid int, query string, embedding string, topic string, limit int",
    )
    got = semantic_search(asked, docs, dim=32).orderBy("qid", "rank").collect()
    assert [(r.qid, r.id) for r in got] == [(1, "a"), (2, "c"), (2, "b")]
    refused = refused_requests(asked, 32).orderBy("qid").collect()
    assert [tuple(r) for r in refused] == [(3, "no_query"), (4, "wrong_vector")]


def test_scroll(spark):
    v = spark.createDataFrame([("b", "x"), ("a", "x"), ("c", "y")], "id string, topic string")
    got = kn.scroll_topic(v, spark.createDataFrame([("x",)], "topic string"), 1).collect()
    assert [(r.id, r.score) for r in got] == [("a", 1.0)]
