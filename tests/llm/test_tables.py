import math

import brute
import numpy as np
import pytest

from shelfmark.llm import embedding_dedup, kd_shards, quotations
from shelfmark.llm.components import components


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 200), (200, 300), (7, 7), (None, 3)] + [(500, k) for k in range(501, 520)]
    found = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {i: 1 for i in range(2, 41)} | {200: 100, 300: 100} | {k: 500 for k in range(501, 520)}
    assert found == want


def test_shards(spark):
    rows = brute.corpus(31, 300, 80) + [(1000 + i, "copy of a text " * 20) for i in range(80)] + [(5000, "x " * 3000)]
    rows = [(d, t, ["en", "de", None][d % 3], f"s{d % 7}") for d, t in rows] + [(None, "null id", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    found = kd_shards.shard_documents(docs, shards=5).toPandas()
    assert len(found) == len(rows)
    sizes = {(d, len((t or "").encode()) + 16) for d, t, _, _ in rows if d is not None}
    assert {(int(d), s) for d, s in zip(found.doc_id, found["size"], strict=True) if d == d} == sizes
    bytes_of = found.groupby("shard")["size"].sum()
    assert len(bytes_of) == 5 and bytes_of.max() - bytes_of.min() < 2 * 6016
    for _, shard in found.groupby("shard"):
        assert sorted(shard.slot) == list(range(len(shard)))


def test_shards_of_little(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    assert kd_shards.shard_documents(docs).count() == 0
    one = spark.createDataFrame([(1, None, None, None)] * 3, docs.schema)
    found = kd_shards.shard_documents(one).collect()
    assert [r["size"] for r in found] == [16] * 3


@pytest.mark.parametrize("block", [4, 1024])
def test_vectors(spark, block):
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((6, 16))
    rows = []
    for i in range(240):
        v = centres[i % 6] + rng.standard_normal(16) * rng.choice([0.02, 0.1, 0.14, 1.0])
        rows.append((i, [float(np.float32(x)) for x in v * rng.uniform(0.5, 3)], i % 6 % 4))
    rows += [(300 + i, rows[0][1], 0) for i in range(9)] + [(400, rows[0][1], None), (401, rows[0][1], 1)]
    bad = [None, [], [0.0] * 16, [math.nan] * 16, [math.inf] + [1.0] * 15, [None] + [1.0] * 15, [1.0, 2.0]]
    rows += [(500 + i, v, 0) for i, v in enumerate(bad)] + [(None, rows[0][1], 0)]
    vectors = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, label int, bucket string, n int")
    found = embedding_dedup.near_vectors(vectors, block=block).collect()
    good = [(i, np.array(v), c) for i, v, c in rows if i is not None and c is not None and i < 500]
    links, root = {i: 0 for i, _, _ in good}, {i: i for i, _, _ in good}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, x, la in good:
        for b, y, lb in good:
            if a < b and la == lb and x @ y / math.sqrt((x @ x) * (y @ y)) >= 0.98:
                links[a] += 1
                links[b] += 1
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    assert len(found) == len(rows)
    got = {r["vec_id"]: r for r in found}
    assert sum(got[i]["n_links"] for i in links) >= 0.9 * sum(links.values()) > 500
    assert all(got[i]["n_links"] <= links[i] for i in links)
    assert sum(got[i]["component_id"] == find(i) for i in links) >= 0.9 * len(links)
    for i in [400, *range(500, 507)]:
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True)
    assert got[None]["n_links"] == 0
    assert embedding_dedup.near_vectors(vectors.limit(0)).count() == 0


def test_quotations(spark):
    mail = [
        (1, 0, "a", "Hello  there\nhow are you"),
        (1, 1, "b", "Fine.\n> Hello there\n> how are YOU"),
        (1, 2, "a", "Good\n> Fine.\n> > Hello there\n> > how are you\nbye"),
        (1, 3, "c", "> how are you\npart quoted"),
        (1, 4, "c", "> never said"),
        (2, 0, "a", "Hello  there\nhow are you"),
        (2, 1, "b", None),
        (2, 2, "b", "same"),
        (2, 5, "b", "same"),
        (2, 5, "b", "same"),
        (2, 9, "b", "x\n>same"),
        (None, 1, "z", "> same"),
        (3, None, "z", ""),
    ]
    found = quotations.link_quotations(spark.createDataFrame([(*m, 7) for m in mail], "conv_id long, turn long, role string, text string, level int"))
    rows = sorted(found.collect(), key=lambda r: (r["conv_id"] is None, r["conv_id"], r["turn"] or -1, r["position"]))
    assert len(rows) == len(mail)
    by = {(r["conv_id"], r["turn"]): r for r in rows}
    assert [by[1, t]["reply_to"] for t in range(5)] == [None, 0, 1, 0, None]
    assert [by[1, t]["body"] for t in range(5)] == ["Hello  there\nhow are you", "Fine.", "Good\nbye", "part quoted", ""]
    assert [by[1, t]["root"] for t in range(5)] == [0, 0, 0, 0, 4]
    assert [by[1, t]["depth"] for t in range(5)] == [0, 1, 2, 1, 0]
    assert [by[1, t]["position"] for t in range(5)] == [0, 1, 2, 3, 0]
    assert (by[1, 2]["n_quotes"], by[1, 2]["n_linked"]) == (2, 2)
    assert (by[1, 4]["n_quotes"], by[1, 4]["n_linked"]) == (1, 0)
    assert by[2, 9]["reply_to"] == 5 and by[None, 1]["reply_to"] is None
    for r in rows:
        if r["reply_to"] is not None:
            assert by[r["conv_id"], r["reply_to"]]["position"] < r["position"]


def test_quotations_round_trip_and_empty(spark):
    turns = [(c, t, "user", f"line {c} {t}\n\nmore é") for c in range(3) for t in range(40)]
    talk = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    found = quotations.link_quotations(quotations.as_replies(talk)).collect()
    assert sorted((r["conv_id"], r["turn"], r["role"], r["body"]) for r in found) == turns
    assert all(r["position"] == r["depth"] == r["turn"] for r in found)
    assert quotations.link_quotations(talk.limit(0)).count() == 0
