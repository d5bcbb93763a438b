"""Column transforms against golden rows and independent Python."""

import base64
import hashlib
import struct
import unicodedata

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shelfmark.functions import extract, vectors
from shelfmark.functions.ids import rekey_ulid
from shelfmark.functions.text import tokens, trim_blanks
from shelfmark.functions.vectors import cosine, decode_embedding, hashed_embedding, unit_length
from shelfmark.operators import requests
from shelfmark.operators.ingest import classify_sources


def column(spark, values, expr, kind="string"):
    df = spark.createDataFrame(list(enumerate(values)), f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("v"))).collect()]


def test_tokens(spark):
    got = column(spark, ["Café life, x86-64 a_b", "Ấ ß ø ﬁ ½ 日本語", "", None], tokens)
    assert got[0] == ["cafe", "life", "x86", "64", "a", "b"]
    assert got[1] == [unicodedata.normalize("NFC", "ấ"), "ß", "ø", "ﬁ", "½", "日本語"]
    assert got[2:] == [[], []]


def test_trim(spark):
    texts = ["\t a b \n", "\u0085x ", "", "　 "]
    assert column(spark, texts, trim_blanks) == ["a b", "x", "", ""]


def crockford(text):
    digits = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"
    if len(text) != 26 or not text.isascii():
        return text
    upper = text.upper().replace("O", "0").replace("I", "1").replace("L", "1")
    if any(c not in digits for c in upper):
        return text
    n = 0
    for c in upper:
        n = n * 32 + digits.index(c)
    h = f"{n % 2**128:032x}"
    return "-".join((h[:8], h[8:12], h[12:16], h[16:20], h[20:]))


def test_ulid(spark):
    import random

    rng = random.Random(7)
    texts = [
        "01KBCVQXJS3QK3JCRGTWBFH2A6", "01kbcvqxjs3qk3jcrgtwbfh2a6", "O1KBCVQXJS3QK3JCRGTWBFH2A6",
        "7" + "Z" * 25, "Z" * 26, "0" * 26, "019ad9bb-f659-1de6-3933-10d716f88946",
        "01KBCVQXJS3QK3JCRGTWBFH2AU", "src-1", "a/b.md", "ı" * 26, "",
    ] + ["".join(rng.choices("0123456789ABCDEFGHJKMNPQRSTVWXYZoilabz", k=26)) for _ in range(200)]
    got = column(spark, texts, rekey_ulid)
    assert got == [crockford(t) for t in texts]
    assert got[0] == "019ad9bb-f659-1de6-3933-10d716f88946"
    assert column(spark, got, rekey_ulid) == got


def test_decode_embedding(spark):
    values = [1.5, -2.25, struct.unpack("<f", struct.pack("<f", 0.1))[0], 1e-42, -0.0, float("inf")]
    data = base64.b64encode(struct.pack("<6f", *values)).decode()
    got = column(spark, ["AADAPwAAEMDNzMw9gqj7Nw==", "YWJjZGU=", "@@@", "", data], decode_embedding)
    assert got[0][:2] == [1.5, -2.25] and struct.pack("<f", got[0][3]) == struct.pack("<f", 3e-5)
    assert got[1:4] == [None, None, []]
    assert struct.pack("<6f", *got[4]) == struct.pack("<6f", *values)


def test_cosine(spark):
    pairs = [([1.0, 2.0], [2.0, 1.0]), ([1.0], [1.0, 2.0]), ([0.0, 0.0], [1.0, 2.0])]
    df = spark.createDataFrame(pairs, "a array<float>, b array<float>")
    assert [r[0] for r in df.select(cosine("a", "b")).collect()] == pytest.approx([0.8, 0, 0])


def test_hashed_embedding(spark):
    for dim in (1, 5, 64, 100):
        got = column(
            spark, ["a b a quantum", ""], lambda c: unit_length(hashed_embedding(c, dim))
        )
        assert len(got[0]) == dim and got[1] is None
        length = sum(x * x for x in got[0])
        assert length == pytest.approx(1.0, abs=1e-5) or (dim == 1 and length == 0)


def test_slots_are_counted_by_batch(spark):
    """Signed counts of places from one table of distinct terms, as a count in Python gives them."""
    texts = [["a", "b", "a"], [], None, [f"t{n % 37}" for n in range(500)]]
    for dim in (1, 5, 64):
        want = []
        for terms in texts:
            counts = [0] * dim
            for t in terms or []:
                slot = int(hashlib.md5(t.encode()).hexdigest()[:8], 16) % (2 * dim)
                counts[slot // 2] += 1 if slot % 2 == 0 else -1
            want.append(counts if terms else None)
        assert vectors.slot_counts(pa.array(texts, pa.list_(pa.string())), dim).to_pylist() == want
        got = column(spark, [None if t is None else " ".join(t) for t in texts], lambda c: hashed_embedding(c, dim))
        assert got == want


def front_matter(spark, contents, **options):
    df = spark.createDataFrame(list(enumerate(contents)), "i int, content string")
    parsed = extract.extract_front_matter(
        extract.split_front_matter(df), extract.ARTICLE_STRINGS, extract.ARTICLE_LISTS, **options
    )
    return parsed.orderBy("i").collect()


def test_split_front_matter(spark):
    got = front_matter(
        spark,
        ["---\nid: 1\n---\n  hi \n", "  ---\nid: 1\n---\nhi", "---\nid: 1\nhi",
         "---\ntitle: a---b\n---\nx", "---\nid: [\n---\nx"],
    )
    assert [(r.fm_text, r.body) for r in got] == [
        ("\nid: 1\n", "hi"), (None, "  ---\nid: 1\n---\nhi"), (None, "---\nid: 1\nhi"),
        ("\ntitle: a", "b\n---\nx"), ("\nid: [\n", "x"),
    ]
    assert got[0].fm.id == "1" and got[3].fm.title == "a" and got[1].fm.id == ""
    assert got[4].fm.parse_error and got[4].fm.id == ""


HEADS = [
    "id: 0010\ntitle: 'it''s'\ntags:\n- a\n- \"b c\"\nyear: 2020\nok: True\nday: 2024-01-02\n",
    "# note\nid: x\n\ntags: [a, 'b c', 3]\nnested: [1, x]\nnone: ~\n",
    "title: >\n  two\n  lines\ntags: []\nmap: {a: 1}\n",
    "title: a # note\nsummary: \"q\\\"q\"\n",
    "title: [a]\nid: k\n",
    "tags: a\nid: k\n",
    "id: a\nid: b\n",
    "title: a: b\n",
    "- a\n- b\n",
    "id: -5\ntitle: http://x.y/z\nauthor: null\n",
    "title:\n  key: value\nid: z\n",
    "draft: yes\nh: 0x1F\no: 0o17\nn: 1.50\nm: 10.0\nday: 2024-01-02\n",
    "draft: yes\nh: 0x1F\no: 0o17\nn: 1.50\nm: 10.0\nday: 2024-01-02\nmore:\n  day: 2024-01-02\n  on: [yes, 0x1F]\n",
]


def test_front_matter_matches_yaml(spark):
    """The native reading equals the YAML reader wherever the native one takes a document."""
    native = front_matter(spark, [f"---\n{h}---\nbody" for h in HEADS], yaml_fallback=False)
    mixed = front_matter(spark, [f"---\n{h}---\nbody" for h in HEADS])
    assert sum(r.fm.parse_error != "front matter is not flat" for r in native) >= 6
    for head, own, both in zip(HEADS, native, mixed):
        try:
            want = extract._load_yaml(head, extract.ARTICLE_STRINGS, extract.ARTICLE_LISTS)
        except Exception:
            assert both.fm.parse_error
            continue
        rows = [both] if own.fm.parse_error == "front matter is not flat" else [own, both]
        for row in rows:
            got = row.fm.asDict()
            assert bool(got.pop("parse_error")) == bool(want["parse_error"]), head
            assert got.pop("rest") == want["rest"], head
            assert got == {k: want[k] for k in got}, head
    assert native[0].fm.rest["day"] == '"2024-01-02T00:00:00Z"'
    values = {"draft": '"yes"', "h": "31", "o": "15", "n": "1.5", "m": "10", "day": '"2024-01-02T00:00:00Z"'}
    assert native[-2].fm.rest == values
    nested = '{"day":"2024-01-02T00:00:00Z","on":["yes",31]}'
    assert mixed[-1].fm.rest == values | {"more": nested}


def test_article_fields(spark):
    rows = [
        ("x.md", "x\n# A b \n# C"), ("n.x.md", "# \n# C"), ("n.md", "## C"),
        ("a/b/c.md", "---\ntitle: T\nextra: \"q\"\n---\nhello"), ("d/e.md", "---\ncategory: own\n---\n"),
    ]
    df = spark.createDataFrame([(p, p, c) for p, c in rows], "path string, rel_path string, content string")
    got = {r.path: r for r in extract.normalize_articles(df).collect()}
    assert [got[p].title for p, _ in rows] == ["A b", "n.x", "n", "T", "e"]
    assert [got[p].category for p, _ in rows] == ["", "", "", "a/b", "d"]
    assert got["a/b/c.md"].meta_json == (
        '{"author":"","category":"a/b","extra":"q","id":"","summary":"","tags":null,"title":"T"}'
    )
    assert '"category":"own"' in got["d/e.md"].meta_json
    assert got["n.md"].id == "n.md"


def test_embedding_text(spark):
    bodies = ["a" * 999 + "é", "a" * 1000, "", "é" * 600]
    got = column(
        spark, bodies, lambda b: extract.embedding_text(F.lit("T"), F.lit(""), b)
    )
    assert got == ["T " + "a" * 999 + "�", "T " + "a" * 1000, "T", "T " + "é" * 500]


def test_topics(spark):
    names = ["quantum--ex-1.md", "nodash.md", "--x.md", "A.MD", "a--b.MD"]
    got = column(spark, ["in/" + n for n in names], lambda p: extract.source_topic(F.lit(""), p))
    assert got == ["quantum", "nodash", "", "A.MD", "a"]
    assert column(spark, ["q--x.md"], lambda p: extract.source_topic(F.lit("r"), p)) == ["r"]


def test_tags_round_trip(spark):
    for tags in (["a", 'b"c', "é"], [], None):
        df = spark.createDataFrame([(tags,)], "t array<string>")
        out = df.select(extract.tags_from_json(extract.tags_to_json("t"))).first()[0]
        assert out == tags


def test_limits(spark):
    assert column(spark, [None, 0, -1, 7], requests.search_limit, "int") == [10, 10, 10, 7]
    assert column(spark, [None, "0", "-1", "x", "7", " 7"], requests.list_limit) == [100] * 4 + [7, 100]


def test_classify(spark):
    rows = [("bad", "u", "s"), (None, "", ""), (None, "u", ""), (None, "u", " ")]
    df = spark.createDataFrame(rows, "parse_error string, url string, summary string")
    got = [(r.outcome, r.reason) for r in classify_sources(df).collect()]
    assert got == [
        ("error", "malformed"), ("skipped", "no_url"), ("skipped", "no_summary"), ("processed", ""),
    ]


def test_routes(spark):
    rows = [("q", "AAAA", "", 3), ("q", "", "t", None), ("", None, "", 0)]
    df = spark.createDataFrame(rows, "query string, embedding string, topic string, limit int")
    got = [(r.route, r.limit) for r in requests.route_requests(df).collect()]
    assert got == [("vector", 3), ("text", 10), ("rejected", 10)]
