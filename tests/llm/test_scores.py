import math
import zlib
from collections import Counter

import brute
import numpy as np
import pyarrow as pa
import pytest

from shelfmark.llm import maxent, toxicity


def test_base_scores(spark):
    rows = brute.corpus(21, 60, 120) + [(500, "unseen-word " * 3), (None, "null id")]
    found = maxent.scores(brute.docs_frame(spark, rows)).collect()
    tokens = {d: [w.lower() for w in brute.words_of(t)] + [None] for d, t in rows}
    held = {d: zlib.crc32(("" if d is None else str(d)).encode()) % 10 == 0 for d in tokens}
    counts = Counter(t for d, ts in tokens.items() if not held[d] for t in ts)
    total, distinct = sum(counts.values()), len(counts)
    assert len(found) == len(rows)
    for r in found:
        own = tokens[r["doc_id"]]
        base = sum(math.log10((counts[t] + 0.1) / (total + 0.1 * (distinct + 1))) for t in own)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9)
        assert (r["held_out"], r["n_tokens"], r["train_tokens"]) == (held[r["doc_id"]], len(own), total)
        assert r["n_known"] == sum(counts[t] > 0 for t in own)
        assert math.isfinite(r["score"]) and r["score"] < 0


def test_model_learns_order(spark):
    """Texts that follow a rule are likelier than the same words out of order, also held-out ones."""
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(40)]
    rows = []
    for d in range(300):
        at, text = int(rng.integers(40)), []
        for _ in range(80):
            text.append(words[at])
            at = (at + int(rng.integers(1, 4))) % 40
        rows.append((d, " ".join(text)))
    found = maxent.scores(spark.createDataFrame(rows, "doc_id long, text string")).where("held_out").toPandas()
    assert len(found) > 10 and (found.score > found.base_score).all()


def test_probabilities_sum_to_one(spark):
    rows = [(d, t) for d, t in brute.corpus(22, 40, 60)]
    texts = spark.createDataFrame([(i % 2, t) for i, (_, t) in enumerate(rows)], "part long, text string")
    model, counts = maxent.train(texts)
    tokens = maxent.Tokens(pa.array(["w abc", "x"]))
    ids = model.find(tokens.hashes)
    p = model.class_probabilities(model.features(tokens, model.last_anchor(tokens, ids)))
    assert np.allclose(p.sum(axis=1), 1, atol=1e-5)
    held = min(maxent.PAIRED, model.size)
    norms = model.pair_norms()
    for before in range(3):
        inside = np.exp(model.prior[:held] + model.pairs[before, :held] - norms[before, model.class_of[:held]])
        sums = np.bincount(model.class_of[:held], weights=inside)
        assert np.allclose(sums[sums > 0], 1, atol=1e-4)


def test_no_training_text(spark):
    found = maxent.scores(brute.docs_frame(spark, [])).collect()
    assert found == []


INSULTS = ["grobnik", "plonker", "snarfle", "wazzock"]


@pytest.fixture(scope="module")
def labelled(spark):
    rng = np.random.default_rng(9)
    words = ["".join(rng.choice(list("aeioulmnrst"), rng.integers(2, 8))) for _ in range(400)]
    rows, marks = [], []
    for d in range(500):
        sentences = [" ".join(rng.choice(words, 9)) + "." for _ in range(6)]
        toxic = d % 5 == 0
        if toxic:
            for w in rng.choice(INSULTS, 2, replace=False):
                sentences[int(rng.integers(6))] += f" You {w} and more."
        rows.append((d, " ".join(sentences)))
        marks.append((d, int(toxic)))
    marks += [(None, 1), (7000, 1), (3, None)]
    return (
        spark.createDataFrame([*rows, (900, None), (901, ""), (902, "word " * 20000)], "doc_id long, text string"),
        spark.createDataFrame(marks, "doc_id long, toxic int"),
    )


def test_toxicity(spark, labelled):
    docs, labels = labelled
    machine = toxicity.train(docs, labels.where(toxicity.fold(3) != 1))
    found = toxicity.scored(docs, machine, "score").join(labels.where("toxic is not null"), "doc_id").toPandas()
    held = found[found.doc_id.map(lambda d: zlib.crc32(str(d).encode()) % 3 == 1)]
    assert ((held.score >= 0.7) == (held.toxic == 1)).mean() > 0.97
    texts = ["you plonker, you snarfle", "you p l o n k e r and s-n-a-r-f-l-e", "you plonkker, you snar.fle", "a b c d", "", None]
    bad, spaced, inserted, letters, empty, none = toxicity._scores(machine, pa.array(texts))
    assert min(bad, spaced, inserted) >= 0.7 and max(letters, empty, none) < 0.7 and empty == none
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns
    gone = {r["doc_id"] for r in docs.select("doc_id").subtract(kept.select("doc_id")).collect()}
    assert len(gone ^ {d for d in range(500) if d % 5 == 0}) <= 5


def test_toxicity_inside_long_words(spark, labelled):
    docs, labels = labelled
    machine = toxicity.train(docs, labels)
    clean = [w.lower() for w in docs.where("doc_id = 1").first()["text"].replace(".", "").split()]
    for mark in ",-/_.":
        joined = mark.join([*clean, "plonker", *clean, "snarfle", *clean])
        glued, spelt = "x" * 60 + "plonker" + "x" * 90 + "snarfle", " ".join("mulo" * 12 + "plonker" + "mulo" * 24 + "snarfle")
        plain, other, glued, spelt = toxicity._scores(machine, pa.array([joined, mark.join(clean * 3), glued, spelt]))
        letters = mark.join([*clean, *"plonker", *clean, *"snarfle", *clean])
        assert min(plain, glued, spelt, toxicity._scores(machine, pa.array([letters]))[0]) >= 0.7 > other
    run = "x" * 3_000_000
    assert toxicity._scores(machine, pa.array([run + "plonker" + run + "snarfle"]))[0] >= 0.7 > toxicity._scores(machine, pa.array([run]))[0]


def test_toxicity_learns_inside_sentences_without_spaces(spark):
    rng = np.random.default_rng(5)
    signs = [chr(c) for c in range(0x4E00, 0x4F00)]
    rows, marks = [], []
    for d in range(300):
        text = "".join(rng.choice(signs, 60))
        toxic = d % 4 == 0
        rows.append((d, text[:30] + ("傻瓜笨蛋" if toxic else "") + text[30:]))
        marks.append((d, int(toxic)))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int")
    found = toxicity.scored(docs, toxicity.train(docs, labels), "score").collect()
    assert sum((r["score"] >= 0.7) == (r["doc_id"] % 4 == 0) for r in found) >= 290


def test_toxicity_many_kinds(spark):
    """A hundred kinds of insults, each in a hundredth of the toxic texts."""
    rng = np.random.default_rng(6)
    words = ["".join(rng.choice(list("aeioulmnrst"), rng.integers(2, 8))) for _ in range(400)]
    kinds = ["".join(rng.choice(list("bcdfghjkpqvwxyz"), 7)) for _ in range(100)]
    rows, marks = [], []
    for d in range(4000):
        text = list(rng.choice(words, 20))
        if d % 4 == 0:
            text[5] = kinds[d // 4 % 100]
        rows.append((d, " ".join(text)))
        marks.append((d, int(d % 4 == 0)))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int")
    found = toxicity.scored(docs, toxicity.train(docs, labels), "score").collect()
    assert sum((r["score"] >= 0.7) == (r["doc_id"] % 4 == 0) for r in found) >= 3900


def test_toxicity_few_texts(spark):
    docs = spark.createDataFrame([(1, "you plonker"), (2, "you there"), (3, "over there")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0)], "doc_id long, toxic int")
    first, *others = [r["score"] for r in toxicity.scored(docs, toxicity.train(docs, labels), "score").orderBy("doc_id").collect()]
    assert first > max(others)


def test_kernel_counts_subsequences():
    known = toxicity.Landmarks([b"abcd"])
    same, gapped, other = known.kernel([b"abcd", b"abxcd", b"dcba"])[:, 0]
    assert same > gapped > 0 and other == 0


def test_toxicity_without_labels(spark, labelled):
    docs, labels = labelled
    assert toxicity.train(docs, labels.limit(0)) is None
    assert toxicity.train(docs.limit(0), labels) is None
    assert {r["__llm_score"] for r in toxicity.scored(docs, None).collect()} == {0.0}


def test_toxicity_ranks_by_how_words_begin(spark):
    rng = np.random.default_rng(5)
    parts = ["en", "ver", "heit", "ung", "tz", "schen", "lich", "keit", "ge", "ie"]

    def word(before="", after=""):
        return before + "".join(rng.choice(parts, 2)) + after

    def text(marks):
        words = [word() for _ in range(60)] + [word(after="achlich") + rng.choice(parts) for _ in range(6)]
        return " ".join(rng.permutation([*words, *[word("achlich") for _ in range(marks)]]))

    toxic = [int(i % 8 == 0) for i in range(480)]
    rows = [(i, text(4 if t else int(i % 7 == 1))) for i, t in enumerate(toxic)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, t) for i, t in enumerate(toxic) if i < 320], "doc_id long, toxic int")
    found = toxicity.scored(docs, toxicity.train(docs, labels), "score").where("doc_id >= 320").collect()
    marked = [r["score"] for r in found if toxic[r["doc_id"]]]
    clean = [r["score"] for r in found if not toxic[r["doc_id"]]]
    assert np.mean([m > c for m in marked for c in clean]) > 0.95
