"""The quality classifier: held-out accuracy, counting against plain Python, and odd inputs."""

import random

import numpy as np
import pyarrow as pa
import pytest

from shelfmark.llm import quality


def texts(n, seed=4):
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 7))) for _ in range(400)]
    rows = []
    for i in range(n):
        own = rnd.choices(words, k=rnd.randint(20, 80))
        good = rnd.random() < 0.7
        if not good:
            own = [w + rnd.choice(["###", "!!", " |"]) if rnd.random() < 0.4 else w for w in own]
        rows.append((i, " ".join(own), int(good)))
    return rows


def query(spark, monkeypatch, docs, labels):
    tables = {
        "documents": spark.createDataFrame([(*d, "x", 2.0) for d in docs], "doc_id long, text string, score string, features double"),
        "labels": spark.createDataFrame([(*lab, 0) for lab in labels], "doc_id long, quality int, toxic int"),
    }
    monkeypatch.setattr(quality, "table", lambda _, __, name: tables[name])
    found = quality.op13_quality(spark, "")
    assert found.columns == ["doc_id", "held_out", "score", "predicted"]
    return found.toPandas()


def test_held_out(spark, monkeypatch):
    rows = texts(900)
    odd = [(None, "null id"), (2000, None), (2001, ""), (2002, " \n"), (2003, "word " * 300_000), (5, rows[5][1])]
    labels = [(i, q) for i, _, q in rows] + [(None, 1), (3, None), (3, rows[3][2])]
    found = query(spark, monkeypatch, [r[:2] for r in rows] + odd, labels)
    assert len(found) == len(rows) + len(odd)
    assert found.score.between(0, 1).all() and ((found.score >= 0.5) == (found.predicted == 1)).all()
    truth = {i: q for i, _, q in rows}
    held = found[found.held_out & found.doc_id.isin(truth)]
    assert len(held) > 200
    assert (held.predicted == held.doc_id.map(truth)).mean() > 0.95
    again = query(spark, monkeypatch, [r[:2] for r in rows] + odd, labels)
    assert sorted(again.score) == pytest.approx(sorted(found.score))


def test_without_labels(spark, monkeypatch):
    docs = [(1, "a b"), (2, None)]
    assert set(query(spark, monkeypatch, docs, []).score) == {0.5}
    assert set(query(spark, monkeypatch, docs, [(1, 1), (2, 1), (3, 1), (4, 1)]).score) == {1.0}
    assert len(query(spark, monkeypatch, [], [(1, 1), (2, 0)])) == 0


def test_words():
    runs = quality.Runs(pa.array(["Ab1,, ..x é", None, "", "ab", "ab"]))
    data = runs.data.tobytes()
    spans = [data[i:j] for i, j in zip(runs.begin, runs.end, strict=True)]
    assert spans == [b"Ab", b"1", b",,", b"..", b"x", "é".encode(), b"ab", b"ab"]
    assert runs.counts().tolist() == [6, 0, 0, 1, 1]
    assert runs.hashes[-1] == runs.hashes[-2] and len(set(runs.hashes.tolist())) == 7


def test_contexts_equal_a_count(spark):
    rows = [(i, t) for i, t, _ in texts(40, 9)] + [(50, None), (51, "lone")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = quality.context_sums(docs)
    place, sign = quality.index_vectors()
    want = np.zeros_like(found)
    for _, text in rows:
        own = quality.Runs(pa.array([text])).rows()
        for i, r in enumerate(own):
            want[r, quality.DIM] += 1
            for j in range(max(0, i - quality.SPAN), min(len(own), i + quality.SPAN + 1)):
                if j != i:
                    np.add.at(want[r], place[own[j]], sign[own[j]].astype(np.int64))
    assert (found == want).all()


def test_pooling_in_stretches():
    rnd = np.random.default_rng(1)
    sums = rnd.integers(0, 50, (quality.ROWS, quality.DIM + 1))
    words = quality.WordVectors.of(sums)
    batch = pa.array(["a b c " * 50, None, "x", "", "y z " * 70, "end"])
    runs = quality.Runs(batch)
    whole = words.pooled(batch)
    for i, (lo, hi) in enumerate(zip(runs.starts[:-1], runs.starts[1:], strict=True)):
        rows = runs.rows()[lo:hi]
        if len(rows):
            w = words.weights[rows][:, None].astype(float)
            mean = (w * words.vectors[rows]).sum(axis=0) / w.sum()
            assert np.allclose(whole[i, : quality.DIM], mean, atol=1e-6)
        else:
            assert not whole[i].any()
    parts = list(quality._stretches(runs.starts, np.flatnonzero(runs.counts()), step=64))
    assert parts[0][0] == 0 and parts[-1][1] == runs.starts[-1] and len(parts) > 3
    assert [list(m) for _, _, m in parts][:2] == [[0], [0]]


def test_temperature():
    rnd = np.random.default_rng(2)
    z = rnd.standard_normal(4000) * 2
    y = (rnd.random(4000) < 1 / (1 + np.exp(-z))).astype(float)
    assert quality.fit_temperature(z * 5, y) == pytest.approx(5, rel=0.2)
