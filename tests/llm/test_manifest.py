"""The Merkle manifest against row-at-a-time hashing, and proofs of chosen leaves."""

import hashlib
import random
import zlib

from pyspark.sql import functions as F

from shelfmark.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def h(*inputs):
    return hashlib.sha256("".join(inputs).encode()).hexdigest()


def leaf(row, lower=False):
    values = list(row)
    if lower and row[4] is not None:
        values[4] = "".join(c.lower() if "A" <= c <= "Z" else c for c in row[4])
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        last = out[-1]
        out.append([h(*last[i : i + 8]) for i in range(0, len(last), 8)])
    return out


def siblings(tree, at):
    out = []
    for level in tree[:-1]:
        first = at // 8 * 8
        out.append((level[first:at], level[at + 1 : first + 8]))
        at //= 8
    return out


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    names = sorted(groups, key=lambda x: b"" if x is None else b"=" + x.encode())
    for g in groups.values():
        g.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    trees = {n: levels([leaf(r) for r in groups[n]]) for n in names}
    top = levels([trees[n][-1][0] for n in names])
    out = []
    for place, name in enumerate(names):
        for at, r in enumerate(groups[name]):
            path = siblings(trees[name], at) + siblings(top, place)
            touched = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            folded = leaf(r, lower=touched)
            for left, right in path:
                folded = h(*left, folded, *right)
            proof = h(*[s for left, right in path for s in left + right])
            own, root = trees[name][-1][0], top[-1][0]
            out.append((r[0], leaf(r), own, root, proof, folded, folded == root))
    return sorted(out, key=str)


def rows_of(n):
    rnd = random.Random(n)
    rows = []
    for i in range(n):
        lang = rnd.choice(["en", "en", "en", "", "é", None, f"x{i % 9}"])
        rows.append((rnd.randrange(n), rnd.choice(["s", None, ""]), lang, rnd.choice([None, i]), rnd.choice([None, "", "Aé Z", "lower", "W" * i])))
    return rows + [rows[0]] * 20 + [(None, None, None, None, None)] * 10


def query(spark, monkeypatch, rows, extra=False):
    docs = spark.createDataFrame(rows, SCHEMA)
    if extra:
        docs = docs.withColumns({"leaf": F.lit("x"), "tree": F.lit(1), "digest": F.lit("y"), "rank": F.lit(None).cast("string")})
    monkeypatch.setattr(merkle, "table", lambda *a: docs)
    found = merkle.op11_merkle(spark, "")
    assert found.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted((tuple(r) for r in found.collect()), key=str)


def test_equals_brute_force(spark, monkeypatch):
    rows = rows_of(300) + [(10_000 + i, "s", "long", 1, "Text " * 5) for i in range(70)] + [(9, "s", "en", 5, "Word " * 200_000)]
    found = query(spark, monkeypatch, rows, extra=True)
    assert found == brute(rows)
    assert {r[-1] for r in found} == {True, False}


def test_little(spark, monkeypatch):
    assert query(spark, monkeypatch, []) == []
    for rows in ([(3, "s", "en", 1, "A")], [(3, "s", None, 1, "A"), (3, "s", None, 1, "A")], [(i, None, f"l{i:02}", 1, "a") for i in range(9)]):
        assert query(spark, monkeypatch, rows) == brute(rows)


def test_proofs_of_chosen_leaves(spark):
    rows = [(i, "s", "en" if i % 4 else "de", i, f"text {i}") for i in range(200)]
    manifest = merkle.build(spark.createDataFrame(rows, SCHEMA))
    asked = spark.createDataFrame([("=en", 77, "a"), ("=de", 0, "b"), ("=de", 49, "c"), ("=en", 150, "none"), ("=fr", 0, "none")], "tree string, rank long, name string")
    found = {r["name"]: r for r in merkle.prove(manifest, asked).withColumn("folded", merkle.fold(F.col("digest"))).collect()}
    assert set(found) == {"a", "b", "c"}
    english = [r for r in rows if r[2] == "en"]
    assert found["a"]["digest"] == leaf(english[77])
    assert [len(r["path"]) for r in (found["a"], found["b"])] == [4, 3]
    assert all(r["folded"] == r["root"] for r in found.values())
    # A record is stored once and is what its digest says.
    for r in manifest.records.collect():
        assert h(*r["children"]) == r["digest"]
