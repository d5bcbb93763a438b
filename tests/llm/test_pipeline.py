import re

import brute
import pytest

import corpus_pipeline
from shelfmark.llm import registry, toxicity


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    rows = [(d, t, "en", "s", 5, "x") for d, t in brute.corpus(41, 60, 100)]
    rows += [(100 + i, f"you plonker and snarfle number {i} " * 3, "en", "s", 5, "x") for i in range(30)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, _doc string"
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/documents.parquet")
    marks = [(d, int(d >= 100)) for d, *_ in rows]
    spark.createDataFrame(marks, "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = docs.columns
    at = docs
    held = {r["doc_id"]: r["text"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, at, sf)
        if name == "packing":
            assert {r["doc_id"] for r in out.collect()} == set(held)
            break
        assert out.columns == names
        got = {r["doc_id"]: r["text"] for r in out.collect()}
        if name == "toxicity":
            assert set(got) == {d for d in held if d < 100}
        elif name == "exact_dedup":
            first = {}
            for d, t in sorted(held.items()):
                first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), d)
            assert set(got) == set(first.values())
        elif name == "jaccard_join":
            classes = brute.jaccard_components(list(held.items()), 5, 80)
            assert set(got) == {d for d, _, c in classes if d == c}
        else:
            want = brute.repeats(held.items())
            assert set(got) == set(held)
            assert {d: len(brute.words_of(t)) for d, t in got.items()} == {d: n - gone for d, (n, gone, _) in want.items()}
        held = got
        at = spark.createDataFrame(out.collect(), out.schema)


def test_run_and_registry(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 0
    assert {int(re.match(r"op(\d+)_", q)[1]) for q in registry.queries()} == set(range(1, 14))
    assert set(registry.oracle_sql()) <= set(registry.queries())
    assert toxicity.fold(3) is not None
