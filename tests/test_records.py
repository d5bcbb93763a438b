"""Upserts, the known-url check and reports against row-at-a-time replays."""

import random

from pyspark.sql import functions as F

from shelfmark.operators import ingest, records


def replay_upsert(current, batch):
    rows = dict(current)
    for i, u in batch:
        rows = {k: v for k, v in rows.items() if k != i and v != u}
        rows[i] = u
    return rows


def table(spark, rows, names="id string, url string"):
    return spark.createDataFrame(rows, names)


def test_upsert_equals_replay(spark):
    rng = random.Random(1)
    for _ in range(3):
        current = {f"i{k}": f"u{k}" for k in rng.sample(range(8), 5)}
        batch = [(f"i{rng.randint(0, 8)}", f"u{rng.randint(0, 8)}") for _ in range(12)]
        df = table(spark, [(*r, n) for n, r in enumerate(batch)], "id string, url string, seq int")
        old = table(spark, list(current.items())).withColumn("seq", F.lit(-1))
        got = records.upsert_sources(old, df)
        assert {r.id: r.url for r in got.collect()} == replay_upsert(current, batch)
        again = records.upsert_sources(got, df)
        assert {r.id: r.url for r in again.collect()} == replay_upsert(
            replay_upsert(current, batch), batch
        )


def replay_ingest(current, files):
    rows, outcome = dict(current), {}
    for path, i, u in files:
        holder = next((k for k, v in rows.items() if v == u), None)
        outcome[path] = holder
        if holder is None:
            rows[i] = u
    return outcome


def test_known_urls_equal_replay(spark):
    rng = random.Random(5)
    for replay in (0, ingest.REPLAYED, ingest.REPLAYED):
        current = {f"i{k}": f"u{k}" for k in rng.sample(range(6), 3)}
        files = [
            (f"p{n:03d}", f"i{rng.randint(0, 6)}", f"u{rng.randint(0, 6)}") for n in range(25)
        ]
        df = table(spark, files, "path string, id string, url string")
        routed = ingest.drop_known_urls(df, table(spark, list(current.items())), replay)
        got = {r.path: r.existing_id for r in routed.collect()}
        assert got == replay_ingest(current, files)


def test_long_chain(spark, monkeypatch):
    """Each file frees the url of the next, 200 times; the number of tables written does not follow the chain."""
    written = []
    real = ingest.materialise
    monkeypatch.setattr(ingest, "materialise", lambda df, name: written.append(name) or real(df, name))
    counts = []
    for n in (3, 200):
        files = [(f"p{k:04d}a", f"i{k}", f"u{k}") for k in range(n)] + [(f"p{k:04d}b", f"i{k}", f"u{k + 1}") for k in range(n)]
        df = table(spark, sorted(files), "path string, id string, url string")
        got = {r.path: r.existing_id for r in ingest.drop_known_urls(df, table(spark, [(f"i{n}", "u0")])).collect()}
        assert got == replay_ingest({f"i{n}": "u0"}, sorted(files))
        counts.append(len(written))
        written.clear()
    assert counts[0] == counts[1]


def test_freed_url(spark):
    files = [("a", "X", "u1"), ("b", "X", "u2"), ("c", "Y", "u1")]
    df = table(spark, files, "path string, id string, url string")
    empty = table(spark, [])
    routed = ingest.drop_known_urls(df, empty)
    assert {r.outcome for r in routed.collect()} == {"processed"}
    rows = records.upsert_sources(
        empty.withColumn("path", F.lit("")), df, seq="path"
    )
    assert {(r.id, r.url) for r in rows.collect()} == {("X", "u2"), ("Y", "u1")}


def test_delete_lookup_list(spark):
    rows = table(spark, [("a", "x"), ("b", "x"), ("c", "y")], "id string, topic string")
    left = records.delete_ids(rows, table(spark, [("a",), ("zz",)], "id string"))
    assert sorted(r.id for r in left.collect()) == ["b", "c"]
    assert records.lookup(table(spark, [("a",)], "id string"), left, "id").count() == 0
    assert [r.id for r in records.list_by_topic(rows, "x", 1).collect()] == ["a"]
    assert records.list_by_topic(rows, "").count() == 0
    assert records.list_by_topic(rows).count() == 3


def test_health_and_info(spark):
    info = table(spark, [], "key string, value string")
    row = records.health(table(spark, [("a", "u")]), table(spark, []), info).first()
    assert tuple(row) == ("ok", 1, 0, "unknown")
    info = records.set_info(info, table(spark, [("version", "v1")], "key string, value string"))
    info = records.set_info(info, table(spark, [("version", "v2")], "key string, value string"))
    assert records.health(table(spark, []), table(spark, []), info).first().version == "v2"
    got = records.get_info(info, table(spark, [("version",), ("x",)], "key string")).collect()
    assert {(r.key, r.value) for r in got} == {("version", "v2"), ("x", "")}
