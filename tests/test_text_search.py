"""Text search against SQLite's full-text index over the same rows."""

import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from shelfmark.operators import text_index as ti

FIELDS = ("summary", "title", "topic")
GOLDEN = [
    ("a", "quantum wave function quantum", "Quantum", "physics"),
    ("b", "the café near the river bank", "Café life", "culture"),
    ("c", "river bank flows", "River", "geo"),
    ("d", "nothing here at all", "Other", "misc"),
]


def random_rows(n=60):
    rng = random.Random(3)
    words = "alpha beta gamma delta alphabet été x86 Σοφός naïve river bank the the the of".split()

    def text(most):
        return " ".join(rng.choices(words, k=rng.randint(0, most)))

    return [(f"r{i:03d}", text(40), text(5), rng.choice(["geo", "river", ""])) for i in range(n)]


def sqlite_hits(rows, match):
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE f USING fts5(summary, title, topic, id UNINDEXED)")
    con.executemany("INSERT INTO f(id, summary, title, topic) VALUES (?, ?, ?, ?)", rows)
    found = con.execute("SELECT id, -rank FROM f WHERE f MATCH ?", (match,)).fetchall()
    con.close()
    return {i: score for i, score in found}


def frame(spark, rows):
    return spark.createDataFrame(rows, "id string, summary string, title string, topic string")


@pytest.fixture(scope="module")
def indexes(spark, tmp_path_factory):
    """Stored indexes of both sets of rows, in small ranges."""
    made = {"random": random_rows(), "golden": GOLDEN}
    return {
        name: ti.write_index(ti.build_index(frame(spark, rows), FIELDS, range_docs=8), str(tmp_path_factory.mktemp(name) / "i"), buckets=4)
        for name, rows in made.items()
    }


def spark_hits(spark, index, query, **options):
    queries = spark.createDataFrame([(1, query)], "qid int, query string")
    got = ti.search(queries, index, k=1000, **options).orderBy("rank").collect()
    return {r.doc_id: r.score for r in got}


CASES = [
    ("river bank", "river bank", {}),
    ("the", "the", {}),
    ("river OR alpha", "river alpha", {"mode": "any"}),
    ("river river", "river river", {}),
    ("alpha NOT beta", "alpha", {"exclude": "beta"}),
    ('"river bank"', "river bank", {"mode": "phrase"}),
    ('"the the"', "the the", {"mode": "phrase"}),
    ('"alpha"', "alpha", {"mode": "phrase"}),
    ("alph*", "alph", {"mode": "prefix"}),
    ("alph* riv*", "alph riv", {"mode": "prefix"}),
    ("title : river", "river", {"fields": ["title"]}),
    ("^river", "river", {"at_start": True}),
    ("NEAR(alpha beta, 3)", "alpha beta", {"near": 3}),
    ("NEAR(river bank the, 2)", "river bank the", {"near": 2}),
    ("NEAR(gamma naive, 0)", "gamma naive", {"near": 0}),
    ("ete", "Été", {}),
    ("missing river", "missing river", {}),
]


GROUPS = {}
for match, query, options in CASES:
    GROUPS.setdefault(str(options), (options, []))[1].append((match, query))


@pytest.mark.parametrize("options,cases", GROUPS.values(), ids=GROUPS)
def test_equals_sqlite(spark, indexes, options, cases):
    """Queries with the same options are one search."""
    options = dict(options)
    exclude = options.pop("exclude", None)
    queries = spark.createDataFrame([(n, query) for n, (_, query) in enumerate(cases)], "qid int, query string")
    if exclude is not None:
        queries = queries.withColumn("exclude", F.lit(exclude))
    # With and without ruling out ranges, where a search of this size would not.
    got = ti.search(queries, indexes["random"], k=1000, prune_above=0 if len(cases) > 2 else ti.PRUNE_ABOVE, **options).collect()
    for n, (match, _) in enumerate(cases):
        found = {r.doc_id: r.score for r in got if r.qid == n}
        assert found == pytest.approx(sqlite_hits(random_rows(), match), abs=2e-6)


def test_units_of_several_kinds(spark, indexes):
    cases = [
        ('alpha AND "river bank"', "alpha", None, ["river bank"], None, None),
        ('riv* AND "the the" AND "of"', None, "riv", ["the the", "of", "--"], None, None),
        ('(alpha AND bet*) NOT "the the"', "alpha", "bet", None, None, ["the the"]),
        ('("the the" NOT gamma) NOT "river bank"', "", None, ["the the"], "gamma", ["--", "river bank"]),
        ("the AND the", "the the", None, [], None, []),
        (None, "--", None, None, "the", None),
        (None, "missing", "riv", None, None, None),
    ]
    schema = "qid int, query string, prefix string, phrases array<string>, exclude string, exclude_phrases array<string>"
    queries = spark.createDataFrame([(n, *c[1:]) for n, c in enumerate(cases)], schema)
    got = ti.match(queries, indexes["random"], k=1000).collect()
    for n, (query, *_) in enumerate(cases):
        want = sqlite_hits(random_rows(), query) if query else {}
        assert {r.doc_id: r.score for r in got if r.qid == n} == pytest.approx(want, abs=2e-6)
    assert {n for n, *_ in enumerate(cases) if any(r.qid == n for r in got)} == {0, 1, 2, 3, 4}


def test_golden_scores(spark, indexes):
    golden = indexes["golden"]
    assert spark_hits(spark, golden, "QUANTUM") == {"a": 1.353783}
    assert spark_hits(spark, golden, "cafe") == {"b": 1.051311}
    assert spark_hits(spark, golden, "river bank") == {"c": 0.000003, "b": 0.000002}
    assert spark_hits(spark, golden, "cafe bank", near=4) == {"b": 0.732107}
    assert spark_hits(spark, golden, "cafe bank", near=2) == {}
    assert spark_hits(spark, golden, "bank river", mode="phrase") == {}
    assert spark_hits(spark, golden, "--") == {}


def test_stored_index_equals_built(spark, indexes, tmp_path):
    built = ti.build_index(frame(spark, random_rows()), FIELDS, range_docs=30)
    ti.write_index(built, str(tmp_path / "index"), buckets=3)
    again = ti.read_index(spark, str(tmp_path / "index"))
    assert (again.buckets, again.fields) == (3, FIELDS)
    for _, query, options in [CASES[0], CASES[5], CASES[9], CASES[10], CASES[13]]:
        want = spark_hits(spark, indexes["random"], query, **options)
        assert spark_hits(spark, again, query, **options) == want
        assert spark_hits(spark, built, query, **options) == want


def test_index_rows(spark, indexes):
    """A block holds a term's documents of one range; every range lists all its documents."""
    index = indexes["random"]
    words = {i: [ti_tokens(t) for t in texts] for i, *texts in random_rows()}
    of_range = {}
    for r in index.postings.collect():
        entries = list(zip(r.docs, r.tfs, r.lens, r.places, strict=True))
        assert r.docs == sorted(r.docs) and r.n == len(entries)
        assert r.max_tf == max(r.tfs) and r.min_len == min(r.lens)
        if r.term == ti.EVERY_DOC:
            of_range[r.range] = set(r.docs)
            assert r.n_occurrences == sum(r.lens)
            continue
        assert r.n_occurrences == sum(r.tfs)
        for doc, tf, length, places in entries:
            own = [n << 32 | p for n, field in enumerate(words[doc]) for p, w in enumerate(field) if w == r.term]
            assert (places, tf, length) == (own, len(own), sum(map(len, words[doc])))
    assert sorted(d for docs in of_range.values() for d in docs) == sorted(words)
    assert index.terms.filter("term != ''").count() == len({w for f in words.values() for t in f for w in t})
    assert {r.doc_id: r.n_tokens for r in index.doc_stats.collect()} == {i: sum(map(len, f)) for i, f in words.items()}
    occurrences = sum(len(t) for f in words.values() for t in f)
    assert index.postings.count() < 0.8 * occurrences


def ti_tokens(text):
    return text.lower().translate(str.maketrans("éï", "ei")).split()


def test_skips_ranges(spark, tmp_path):
    """Ranges whose bound is below the best documents found are not opened, and no result is lost."""
    rng = random.Random(8)
    rows = [(f"d{i:04d}", " ".join(["common"] * rng.randint(1, 3) + ["filler"] * rng.randint(20, 60)), "", "") for i in range(600)]
    rows += [(f"x{i}", "common rare rare", "", "") for i in range(12)]
    index = ti.write_index(ti.build_index(frame(spark, rows), FIELDS, range_docs=6), str(tmp_path / "i"), buckets=2)
    queries = spark.createDataFrame([(1, "common rare", 5), (2, "common", 3), (3, "rare filler", 700)], "qid int, query string, limit int")
    opened = []
    real = ti.open_ranges

    def counted(ranges, *args):
        rest = real(ranges, *args)
        per = {r.qid: r.n for r in rest.groupBy("qid").agg(F.count("*").alias("n")).collect()}
        every = {r.qid: r.n for r in ranges.groupBy("qid").agg(F.count("*").alias("n")).collect()}
        opened.append({q: (per.get(q, 0) + ti.FIRST_RANGES, every[q]) for q in every})
        return rest

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(ti, "open_ranges", counted)
        got = ti.search(queries, index, mode="any", limit_col="limit", prune_above=0).collect()
    read, every = opened[0][1]
    assert every > 80 and read < every / 2
    for qid, match, k in ((1, "common OR rare", 5), (2, "common", 3), (3, "rare OR filler", 700)):
        scores = sqlite_hits(rows, match)
        best = sorted(scores, key=lambda i: (-round(scores[i], 12), i))[:k]
        assert [r.doc_id for r in sorted(got, key=lambda r: r["rank"]) if r.qid == qid] == best


def test_prefix_terms(spark, indexes):
    """From the dictionary alone; short prefixes reach terms of several bins."""
    asked = ["a", "al", "alp", "alpha", "alphabets", "r", "x8", "σο", "", "q"]
    prefixes = spark.createDataFrame([(p,) for p in asked], "prefix string")
    found = ti.prefix_terms(indexes["random"], prefixes)
    words = {w for _, *texts in random_rows() for t in texts for w in ti_tokens(t)}
    assert sorted((r.prefix, r.term) for r in found.collect()) == sorted((p, w) for p in asked if p for w in words if w.startswith(p))
    assert "places" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_close_stretches(spark):
    """One pass over merged places against the rule tried on every start."""
    rng = random.Random(5)
    rows = []
    for _ in range(60):
        units = rng.randint(1, 4)
        places = sorted(rng.sample(range(60), rng.randint(units, 20)))
        rows.append((units, rng.randint(1, 12), [(p, rng.randrange(units)) for p in places]))
    df = spark.createDataFrame(rows, "units int, span int, events array<struct<place:bigint,unit:int>>")
    for span in sorted({r[1] for r in rows}):
        for r in df.filter(F.col("span") == span).withColumn("found", ti.close_stretches(F.col("events"), F.col("units"), span)).collect():
            events = [(e.place, e.unit) for e in r.events]
            starts = [p for p, _ in events if len({u for q, u in events if p <= q <= p + span}) == r.units]
            want = {q for q, _ in events if any(p <= q <= p + span for p in starts)}
            assert {q for q, _ in events if any(s.lo <= q <= s.hi for s in r.found)} == want


def test_limits_and_ranks(spark, indexes):
    index = indexes["random"]
    queries = spark.createDataFrame(
        [(1, "the", 3), (2, "alpha", 1000), (3, "--", 5)], "qid int, query string, limit int"
    )
    got = ti.search(queries, index, limit_col="limit").orderBy("qid", "rank").collect()
    # The order is SQLite's, also for a term of most rows, whose scores all show as 0.000002.
    wanted = sqlite_hits(random_rows(), "the")
    order = sorted(wanted, key=lambda i: (-round(wanted[i], 12), i))
    assert list(spark_hits(spark, index, "the")) == order
    assert [r.doc_id for r in got if r.qid == 1] == order[:3]
    assert len([r for r in got if r.qid == 2]) == len(spark_hits(spark, index, "alpha"))
    plan = ti.search(queries, index, k=3, mode="phrase")._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan and "Python" not in plan


def test_no_documents(spark):
    index = ti.build_index(frame(spark, []), FIELDS)
    for options in ({}, {"mode": "any"}, {"mode": "phrase"}, {"mode": "prefix"}, {"near": 3}):
        assert spark_hits(spark, index, "alpha beta", **options) == {}


def test_build_tasks_follow_the_text(spark, monkeypatch):
    """The more text, the more tasks index it; and blocks do not depend on how rows come in batches, also of odd ids."""
    monkeypatch.setattr(ti, "TASK_BYTES", 100, raising=False)
    rows = random_rows(90)
    rows += [("r005", "river river", "the", None), (None, "bank", None, None), (None, "the bank", "of", ""), ("empty", None, None, None)]
    docs = frame(spark, rows)
    size = sum(len((t or "").encode()) for _, *texts in rows for t in texts)
    built = ti.build_index(docs, FIELDS, range_docs=8)
    assert built.postings.rdd.getNumPartitions() >= size / 100 > 100
    few = ti.build_postings(docs, FIELDS, F.pmod(F.xxhash64("id"), F.lit(12)), "id", 2)
    plain = {(r.term, r.range): r for r in few.collect()}
    monkeypatch.setattr(ti, "RANGE_DOCS", 8)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        assert {(r.term, r.range): r for r in few.collect()} == plain
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    every = {d: (tf, n, places) for r in plain.values() if r.term == ti.EVERY_DOC for d, tf, n, places in zip(r.docs, r.tfs, r.lens, r.places, strict=True)}
    assert len(every) == 92 and every[None] == (2, 3, []) and every["empty"] == (1, 0, [])
    bank = {d: places for r in plain.values() if r.term == "bank" for d, places in zip(r.docs, r.places, strict=True)}
    assert bank[None] == [0, 1]
    river = {d: places for r in plain.values() if r.term == "river" for d, places in zip(r.docs, r.places, strict=True)}
    assert river["r005"] == sorted(river["r005"]) and 0 in river["r005"] and 1 in river["r005"]


def test_scores_stay_in_their_range(spark, indexes):
    """Hits of any term are summed where the blocks of a range lie; only the best of them are shuffled, also with limits."""
    queries = spark.createDataFrame([(1, "river bank the", 3), (2, "of gamma", 0), (3, "alpha", None)], "qid int, query string, limit int")
    found = ti.search(queries, indexes["random"], mode="any", limit_col="limit")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    assert not [line for line in plan.splitlines() if "Exchange hashpartitioning(qid" in line and "doc_id" in line.split("ENSURE")[0]]
    best = sqlite_hits(random_rows(), "river OR bank OR the")
    ids = sorted(best, key=lambda i: (-round(best[i], 12), i))[:3]
    assert [(r.qid, r.doc_id) for r in found.orderBy("rank").collect()] == [(1, i) for i in ids]


def test_blocks_are_stored_where_they_are_made(spark):
    """Only the texts are shuffled; their blocks, which are much larger, are not."""
    index = ti.build_index(frame(spark, random_rows(20)), FIELDS, range_docs=4)
    stored = ti.by_bucket(index.postings, 2)
    plan = stored._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
    rows = stored.select("bucket", "term", F.spark_partition_id().alias("task")).collect()
    for task in {r.task for r in rows}:
        mine = [(r.bucket, r.term) for r in rows if r.task == task]
        assert mine == sorted(mine)


def test_only_asked_blocks_travel(spark, indexes, monkeypatch):
    """Beside many ranges only blocks of asked terms are joined; blocks meet prefixes by bin, not by a table of the terms found."""
    index, steps, opened = indexes["random"], {}, []
    write, look = ti.materialise, ti._open

    def noted(df, name, *more):
        steps[name] = df
        return write(df, name, *more)

    monkeypatch.setattr(ti, "materialise", noted)
    monkeypatch.setattr(ti, "_open", lambda *given: opened.append(look(*given)) or opened[-1])
    rows = random_rows()
    assert sorted(spark_hits(spark, index, "river bank")) == sorted(sqlite_hits(rows, "river bank"))
    assert sorted(spark_hits(spark, index, "river bank", mode="phrase")) == sorted(sqlite_hits(rows, '"river bank"'))
    assert len(opened) == 2
    for blocks in opened:
        assert "LeftSemi" in blocks._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(spark_hits(spark, index, "alph t b", mode="prefix")) == sorted(sqlite_hits(rows, "alph* t* b*"))
    assert "prefix-terms" not in steps
    found = {(r.prefix, r.bin) for r in steps["prefix-bins"].collect()}
    assert found == {("alph", "alp"), ("t", "the"), ("b", "ban"), ("b", "bet")}


def test_dictionary_is_not_shuffled(spark, tmp_path):
    """Terms of queries that come from a large table meet a larger dictionary by a broadcast, as their size is known."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    rows = [(f"d{i}", " ".join(f"w{j}" for j in range(200 * i, 200 * i + 200))) for i in range(400)]
    index = ti.write_index(ti.build_index(spark.createDataFrame(rows, "id string, text string"), ["text"]), str(tmp_path / "index"), 2)
    queries = spark.range(3_000_000).selectExpr("id % 3 as qid", "concat('w', 500 * (id % 3)) as query").distinct()
    plans, write = {}, ti.materialise

    def noted(df, name, *more):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return write(df, name, *more)

    spark.conf.set(key, "20k")
    ti.materialise = noted
    try:
        found = sorted((r["qid"], r["doc_id"]) for r in ti.search(queries, index).collect())
        matched = sorted((r["qid"], r["doc_id"]) for r in ti.match(queries, index).collect())
    finally:
        ti.materialise = write
        spark.conf.set(key, before)
    assert found == matched == [(0, "d0"), (1, "d2"), (2, "d5")]
    assert "SortMergeJoin" not in plans["asked"]
