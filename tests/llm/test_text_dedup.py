import hashlib
import os
import re

import brute
import numpy as np
import pyarrow as pa
import pytest

from shelfmark.llm import exact_dedup, jaccard_join, substring_dedup
from shelfmark.plans.shared import shared_folder


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def test_exact_groups(spark):
    rows = brute.corpus(1, 50) + [(100, "one two"), (101, "One"), (101, "One"), (None, "One"), (None, "only null")]
    found = exact_dedup.duplicate_groups(brute.docs_frame(spark, rows), heavy=4, tracked=8).collect()
    groups = {}
    for doc, text in rows:
        groups.setdefault(hashlib.sha256(normal(text).encode()).hexdigest(), []).append(doc)
    assert len(found) == len(rows)
    for r in found:
        members = groups[r["digest"]]
        ids = [m for m in members if m is not None]
        assert r["keep_id"] == (min(ids) if ids else None)
        assert r["group_size"] == len(members)
    for digest, members in groups.items():
        assert sum(r["kept"] for r in found if r["digest"] == digest) == 1, members


def test_exact_keeps_whole_rows(spark):
    rows = brute.corpus(2, 40) + [(7, "One"), (3, "One"), (3, "One")]
    docs = brute.docs_frame(spark, rows)
    kept = exact_dedup.keep_first(docs, heavy=4, tracked=8)
    assert kept.columns == docs.columns
    least = {}
    for doc, text in rows:
        least[normal(text)] = min(doc, least.get(normal(text), doc))
    assert sorted((r["doc_id"], normal(r["text"])) for r in kept.collect()) == sorted((d, t) for t, d in least.items())


def test_exact_same_both_ways(spark):
    docs = brute.docs_frame(spark, brute.corpus(3, 40))
    shuffled = exact_dedup.duplicate_groups(docs, heavy=1, tracked=1).drop("row")
    mapped = exact_dedup.duplicate_groups(docs, heavy=64, tracked=64).drop("row")
    assert sorted(shuffled.collect(), key=str) == sorted(mapped.collect(), key=str)


@pytest.mark.parametrize("seed", [4, 5])
def test_repeats(spark, seed):
    rows = brute.corpus(seed, 50, 150) + [(99, "w " * 3000), (98, " ".join(map(str, range(3000))) * 2)]
    docs = brute.docs_frame(spark, rows).repartition(3, "doc_id")
    found = substring_dedup.remove_repeats(docs)
    want = brute.repeats(rows)
    got = {
        r["doc_id"]: (r["__llm_words"], r["__llm_removed"], hashlib.sha256(r["__llm_kept"].encode()).hexdigest())
        for r in found.collect()
    }
    assert got == want
    assert sum(w[1] for w in want.values()) > 100


def test_repeats_in_documents(spark):
    long = " ".join(f"w{i}" for i in range(30))
    rows = [(1, long), (2, "x \n" + long + " y"), (3, "short  text"), (None, long), (4, None)]
    docs = spark.createDataFrame([(*r, "en", 5) for r in rows], "doc_id long, text string, lang string, n_chars long")
    out = {r["doc_id"]: r for r in substring_dedup.drop_repeats(docs).collect()}
    assert out[1]["text"] == long and out[2]["text"] == "x y" and out[2]["n_chars"] == 3
    assert out[3]["text"] == "short  text" and out[3]["n_chars"] == 5
    assert out[None]["text"] == "" and out[4]["text"] is None


def test_repeats_by_row(spark):
    """Rows without or with the same doc_id keep their own passages."""
    passage = " ".join(f"w{i}" for i in range(45))
    part = " ".join(passage.split()[5:30])
    own = [" ".join(f"{c}{i}" for i in range(30)) for c in "abcd"]
    rows = [(1, passage), (None, f"{own[0]} {passage}"), (None, own[1]), (None, "short"), (7, f"{own[2]} {part}"), (7, own[3])]
    found = substring_dedup.drop_repeats(brute.docs_frame(spark, rows)).collect()
    want = [(1, passage), (None, own[0]), (None, own[1]), (None, "short"), (7, own[2]), (7, own[3])]
    assert sorted(((r["doc_id"], r["text"]) for r in found), key=str) == sorted(want, key=str)


@pytest.mark.parametrize(("width", "of"), [(4, 85), (5, 80)])
def test_jaccard(spark, width, of):
    rows = brute.corpus(6, 70, 120)
    base = [f"w{i}" for i in range(400)]
    for k in range(12):  # near copies around the border, and a chain of them
        rows.append((200 + k, " ".join(base[: 400 - 9 * k] + [f"z{k}{i}" for i in range(3 * k)])))
        rows.append((300 + k, " ".join(base[10 * k : 10 * k + 160])))
    # Rows that share a doc_id or have none are documents of their own; one text is very long.
    rows += [(7, rows[80][1]), (7, "other words here and there"), (None, rows[81][1]), (None, "alone without a number"), (None, None), (400, "long " + " ".join(f"v{i}" for i in range(60_000)))]
    found = jaccard(spark, rows, width, of)
    assert found == sorted(brute.jaccard_components(rows, width, of), key=str)


def jaccard(spark, rows, width, of):
    docs = brute.docs_frame(spark, rows).repartition(3, "doc_id")
    named = jaccard_join._named(jaccard_join.numbered_rows(docs), width, of)
    return sorted(((r["doc_id"], r["size"], r["component_id"]) for r in named.collect()), key=str)


def test_jaccard_rows_of_one_id(spark):
    """Sets of different sizes under one doc_id."""
    a, b = (" ".join(f"{c}{i}" for i in range(n)) for c, n in (("a", 50), ("b", 30)))
    rows = [(7, a), (7, b), (8, b), (9, a)]
    assert jaccard(spark, rows, 4, 85) == [(7, 27, 7), (7, 47, 7), (8, 27, 7), (9, 47, 7)]
    kept = jaccard_join.keep_one(brute.docs_frame(spark, rows)).collect()
    assert sorted((r["doc_id"], r["text"]) for r in kept) == [(7, a), (7, b)]


def test_jaccard_split_clusters(spark, monkeypatch):
    """Overlapping texts whose buckets split, in many small cells."""
    monkeypatch.setattr(jaccard_join, "BLOCK_SETS", 4)
    base = [f"w{i}" for i in range(600)]
    rows = [(k, " ".join(base[4 * k : 4 * k + 100])) for k in range(90)] + [(100 + k, " ".join(base[7 * k : 7 * k + 60])) for k in range(60)]
    assert jaccard(spark, rows, 4, 85) == sorted(brute.jaccard_components(rows, 4, 85), key=str)


def test_jaccard_first_in_blocks(spark, monkeypatch):
    """Many near copies of one text are compared with it in several blocks; each set travels in six bytes a feature."""
    monkeypatch.setattr(jaccard_join, "BLOCK_SETS", 3)
    base = [f"w{i}" for i in range(300)]
    rows = [(k, " ".join([*base[: 300 - k], f"z{k}"])) for k in range(40)] + [(90, " ".join(base[::-1]))]
    assert jaccard(spark, rows, 4, 85) == sorted(brute.jaccard_components(rows, 4, 85), key=str)
    values = np.array([0, 1, 2**48 - 1, 2**40 + 7], dtype=np.uint64)
    raw = jaccard_join.packed(values).tobytes()
    assert len(raw) == 24 and (jaccard_join.unpacked([raw[:6], raw[6:], b""]) == values).all()


def test_jaccard_sketches(spark, monkeypatch):
    """Sketches differ in no more bits than sets in features, so no link is lost; texts that only share parts are not sent to be compared."""
    base, sent = [f"w{i}" for i in range(400)], {}
    texts = [" ".join([*base[:n], *(f"z{n}{i}" for i in range(m))]) for n in (3, 60, 66, 68, 120, 127, 131, 135, 262, 300) for m in (0, 1, 9)] + [""]
    f = jaccard_join.Features(pa.array(texts), 4)
    sets, sketches = [set(x.tolist()) for x in np.split(f.values, f.starts[1:-1])], f.sketches().to_pylist()
    assert all(len(x) * 64 >= n and len(x) * 32 < max(n, 33) for x, n in zip(sketches, map(len, sets), strict=True))
    rows = [(x, y) for x in range(len(sets)) for y in range(len(sets))]
    ends = [(x, y, len(sets[x]), len(sets[y]), sketches[x], sketches[y]) for x, y in rows if sets[x] and sets[y]]
    pairs = spark.createDataFrame(ends, "a int, b int, size_a long, size_b long, sketch_a array<long>, sketch_b array<long>")
    may = {(r["a"], r["b"]) for r in pairs.where(jaccard_join.may_link(85)).collect()}
    assert may >= {(x, y) for x, y, *_ in ends if 100 * len(sets[x] & sets[y]) >= 85 * len(sets[x] | sets[y])}
    assert len(may) < len(ends) / 2

    def counted(df, name, **options):
        out = write(df, name, **options)
        sent[name] = out.count()
        return out

    write = jaccard_join.written
    monkeypatch.setattr(jaccard_join, "written", counted)
    rows = [(k, " ".join([*base[:120], *(f"z{k}-{i}" for i in range(60))])) for k in range(40)]
    assert jaccard(spark, rows, 4, 85) == [(k, 177, k) for k, _ in sorted(rows, key=lambda r: str((r[0], 177, r[0])))]
    assert sent["met"] >= 39 and sent["first-places"] == sent.get("cell-places", 0) == 0


def test_jaccard_leaves_its_result_only(spark):
    """The tables of the steps are gone when the components are written."""
    before = set(os.listdir(shared_folder(spark)))
    rows = [(k, " ".join(f"w{i}" for i in range(k, k + 60))) for k in range(20)]
    assert len(jaccard(spark, rows, 4, 85)) == 20
    left = set(os.listdir(shared_folder(spark))) - before
    assert sorted(name.rsplit("-", 1)[0] for name in left) == ["components", "numbered-rows"]


def test_jaccard_keep_one(spark):
    text = " ".join(f"w{i}" for i in range(200))
    rows = [(5, text), (2, text + " more"), (9, "other"), (None, text), (3, None), (4, ""), (None, ""), (None, "twice"), (None, "twice")]
    docs = brute.docs_frame(spark, rows)
    kept = jaccard_join.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted(
        [(2, text + " more"), (9, "other"), (3, None), (4, ""), (None, ""), (None, "twice")], key=str
    )


def test_bands_lose_no_pair():
    bands = jaccard_join.Bands(85, 3000)
    for r in range(1, 3000, 7):
        for s in (r, r * 100 // 85):
            b, c = bands.band(np.array([r, s]))
            assert c - b in (0, 1)
            assert (r + s) * 15 // 185 <= bands.differ[c]


def test_empty_tables(spark):
    docs = brute.docs_frame(spark, [])
    assert exact_dedup.duplicate_groups(docs).count() == 0
    assert exact_dedup.keep_first(docs).count() == 0
    assert substring_dedup.remove_repeats(docs).count() == 0
    assert jaccard(spark, [], 4, 85) == []
    assert jaccard_join.keep_one(docs).count() == 0


def test_roots(spark, monkeypatch):
    """Trees of parents, as first links are, need no round of stars; their paths shorten by halves."""
    from shelfmark.llm import components

    steps = []
    write = components.written
    monkeypatch.setattr(components, "written", lambda df, name: steps.append(name) or write(df, name))
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 200), (200, 300)] + [(500, k) for k in range(501, 520)]
    found = {r["id"]: r["component"] for r in components.roots(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {i: 1 for i in range(2, 41)} | {200: 100, 300: 100} | {k: 500 for k in range(501, 520)}
    assert len(steps) <= 8 and set(steps) == {"parents"}
    assert components.roots(spark.createDataFrame([], "a long, b long")).count() == 0


def test_jaccard_steps(spark, monkeypatch):
    """Links of a set with its first are joined without rounds of stars, and cells join components by name."""
    steps = []
    stars = jaccard_join.components
    monkeypatch.setattr(jaccard_join, "components", lambda edges: steps.append(edges.count()) or stars(edges))
    base = [f"w{i}" for i in range(300)]
    rows = [(k, " ".join([*base[: 300 - k], f"z{k}"])) for k in range(12)] + [(90, " ".join(base[::-1]))]
    assert jaccard(spark, rows, 4, 85) == sorted(brute.jaccard_components(rows, 4, 85), key=str)
    assert steps == []
    rows = [(k, " ".join(base[4 * k : 4 * k + 100])) for k in range(50)]
    assert jaccard(spark, rows, 4, 85) == sorted(brute.jaccard_components(rows, 4, 85), key=str)
    assert len(steps) in (0, 1, 2) and all(n < 50 for n in steps[1:])
