"""Whitening against numpy, on vectors with gaps and faults."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfmark.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, row int, component string, n int"


def frame(spark, vectors):
    return spark.createDataFrame([(i, v, 1, "c", 2) for i, v in vectors], SCHEMA)


def query(spark, monkeypatch, vectors):
    monkeypatch.setattr(whitening, "table", lambda *a: frame(spark, vectors))
    found = whitening.op12_whitening(spark, "")
    assert found.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    return found.toPandas()


def test_equals_numpy(spark, monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK", 64)  # several blocks both ways
    rnd = np.random.default_rng(5)
    mixed = rnd.standard_normal((300, 70)) @ np.diag(np.linspace(1, 9, 70)) @ rnd.standard_normal((70, 70))
    mixed = mixed.astype(np.float32)
    vectors = [(i if i % 50 else None, v.tolist()) for i, v in enumerate(mixed)] + [(7, mixed[7].tolist())]
    bad = [None, [], [None] * 70, [float("nan")] * 70, [float("inf")] + [0.0] * 69, [1.0] * 3]
    found = query(spark, monkeypatch, vectors + [(1000 + i, v) for i, v in enumerate(bad)])
    x = np.floor(64 * np.array([v for _, v in vectors], dtype=float)).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(axis=0)
    centred = x - s / n
    values, parts = np.linalg.eigh(centred.T @ centred / n)
    values, parts = values[::-1][:32], parts[:, ::-1][:, :32]
    want = np.abs(centred @ parts / np.sqrt(values))
    assert len(found) == n * 32 and set(found.n) == {n} and (found.identity_error < 1e-9).all()
    shares = found.drop_duplicates("component").sort_values("component").explained
    assert np.allclose(shares, values / np.trace(centred.T @ centred / n), rtol=1e-9)
    deviation = ((n * x - s) ** 2).sum(axis=1)
    got = found[found.vec_id == 13].sort_values("component")
    assert np.allclose(got.whitened.abs(), want[13], atol=1e-8) and set(got.deviation) == {deviation[13]}
    assert sorted(found[found.component == 1].deviation) == sorted(deviation)


def test_few_and_flat(spark, monkeypatch):
    assert len(query(spark, monkeypatch, [])) == 0
    assert len(query(spark, monkeypatch, [(1, None)])) == 0
    one = query(spark, monkeypatch, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])
    assert len(one) == 4 and one.whitened.isna().all() and set(one.deviation) == {0} and set(one.identity_error) == {0.0}
    flat = query(spark, monkeypatch, [(i, [float(i), 5.0]) for i in range(4)]).sort_values("vec_id")
    assert flat[flat.component == 1].whitened.abs().tolist() == pytest.approx([1.5 / 1.25**0.5, 0.5 / 1.25**0.5] * 1 + [0.5 / 1.25**0.5, 1.5 / 1.25**0.5])
    assert flat[flat.component == 2].whitened.isna().all()


def test_deviation_beyond_64_bits(spark):
    rows = [(i, [3e38 * (-1) ** i, 1.0]) for i in range(2)] + [(2, [0.0, 1.0])]
    found = whitening.whiten(frame(spark, rows).select("vec_id", "embedding")).where("component = 1")
    got = {r["vec_id"]: r["deviation"] for r in found.collect()}
    top = whitening.LARGEST
    x = np.array([[top, 64], [-top, 64], [0, 64]], dtype=object) + 1_000_000
    want = [int(sum((3 * a - t) ** 2 for a, t in zip(r, x.sum(axis=0), strict=True))) for r in x]
    assert got == {i: (w if w < 2**63 else None) for i, w in enumerate(want)}


def test_other_columns_and_components(spark):
    rows = [(i, [float(i), float(i * i % 5), 1.0 * (i % 3)]) for i in range(9)]
    table = frame(spark, rows).select("vec_id", F.col("embedding").alias("v"), "row")
    found = whitening.whiten(table, "v", components=2)
    assert found.columns == ["vec_id", "row", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert found.count() == 18
