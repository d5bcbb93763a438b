"""Queries over the given tables, one or more per operator, and the same in SQL.

The documents stand for articles and sources, benchmark texts for queries, embeddings for stored
vectors and labels for batches of keys.  Every query reads its tables whole.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import oracle
from .functions import extract
from .functions.ids import rekey_ulid
from .functions.vectors import cosine
from .operators import ingest, knn, records, requests, text_index
from .operators.embed import embed
from .plans import jobs
from .plans.shared import shared_folder, spread_input
from .plans.store import Store
from .sources import scan

DIM = 64
_SMOKE = "/root/testdata/sf0.001"
_URL = "https://example.org/"


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    return spread_input(_table(spark, sf, "documents"), "doc_id")


# --- documents as articles and sources ----------------------------------------------------


def _first_line(text: str = "text"):
    return F.substring_index(text, "\n", 1)


def _rest(text: str = "text"):
    return F.substr(F.col(text), F.length(_first_line(text)) + 2)


def _markdown(docs: DataFrame) -> DataFrame:
    """Documents as article files: front matter in several styles, some without or malformed."""
    header = (
        F.when(F.col("source") == "src3", F.lit(""))
        .when(
            F.col("source") == "src7",
            F.concat(F.lit("---\nid: a-"), "doc_id", F.lit("\ntags: [x\n---\n\n")),
        )
        .when(
            F.col("lang") == "en",
            F.concat(
                F.lit("---\nid: a-"), "doc_id", F.lit("\ntitle: Note "), "doc_id",
                F.lit("\nauthor: 'O''Hara'\nsummary: \"About: "), "source",
                F.lit("\"\ntags: [en, \"x y\"]\nyear: "), "n_chars",
                F.lit("\ndraft: true\n---\n\n"),
            ),
        )
        .when(
            F.col("lang") == "fr",
            F.concat(
                F.lit("---\nid: a-"), "doc_id", F.lit("\ntitle:\ntags:\n  - fr\n  - "), "source",
                F.lit("\ncategory: own\n---\n# Titre "), "doc_id", F.lit(" \n\n"),
            ),
        )
        .when(
            F.col("lang") == "de",
            F.concat(
                F.lit("---\ntitle: Ding "), "doc_id",
                F.lit("\nsummary: >\n  two\n  lines\ntags: [de]\n---\n"),
            ),
        )
        .otherwise(F.lit("---\nauthor: ~\nlisted: [1, b]\n---\n"))
    )
    path = F.concat("source", F.lit("/"), "lang", F.lit("/doc."), "doc_id", F.lit(".md"))
    return docs.select(
        "doc_id", path.alias("path"), path.alias("rel_path"), F.concat(header, "text").alias("content")
    )


def _articles(spark, sf) -> DataFrame:
    return extract.normalize_articles(_markdown(_documents(spark, sf)))


def _front_matter(spark, sf):
    rows = extract.extract_front_matter(
        extract.split_front_matter(_markdown(_documents(spark, sf))),
        ("id", "title", "author", "summary"),
        ("tags",),
    )
    fm = F.col("fm")
    return rows.select(
        "doc_id",
        *[fm[name].alias(name) for name in ("id", "title", "author", "summary")],
        extract.tags_to_json(fm["tags"]).alias("tags"),
        F.array_join(F.array_sort(F.map_keys(fm["rest"])), ",").alias("rest_keys"),
        fm["parse_error"].isNotNull().alias("malformed"),
        F.md5("body").alias("body_md5"),
    )


def _article_rows(spark, sf):
    return _articles(spark, sf).select(
        "path", "id", "title", "category", extract.tags_to_json("tags").alias("tags")
    )


def _meta_json(spark, sf):
    meta = F.col("meta_json")
    keys = ("id", "title", "author", "summary", "category", "year", "draft")
    return _articles(spark, sf).select(
        "path", *[F.get_json_object(meta, f"$.{key}").alias(key) for key in keys],
        F.get_json_object(meta, "$.tags").alias("tags"),
        F.get_json_object(meta, "$.listed").alias("listed"),
    )


def _tags_text(spark, sf):
    articles = _articles(spark, sf).select("path", "tags")
    stored = articles.withColumn("tags_json", extract.tags_to_json("tags"))
    return stored.select(
        "path", "tags_json",
        F.coalesce(F.array_join(extract.tags_from_json("tags_json"), " "), F.lit("")).alias("tags_text"),
    )


def _embed_text(spark, sf):
    text = extract.embedding_text(F.col("title"), F.col("summary"), F.col("content"))
    return _articles(spark, sf).select("path", text.alias("text"))


def _inbox(docs: DataFrame) -> DataFrame:
    """Documents as source files; equal texts share a url, some have no url or no summary."""
    url = F.when(F.col("source") == "src2", F.lit("")).otherwise(F.concat(F.lit(_URL), F.md5("text")))
    related = F.when(F.col("lang") == "en", F.concat(F.lit("\nrelated_article: on-"), "source")).otherwise("")
    body = F.when(F.col("source") == "src4", F.lit(" \n ")).otherwise(F.col("text"))
    head = F.when(
        F.col("source") == "src7", F.concat(F.lit("---\nid: [\n---\n"), body)
    ).otherwise(
        F.concat(
            F.lit("---\nid: s-"), "doc_id", F.lit("\nurl: "), url, related, F.lit("\nlanguage: "),
            "lang", F.lit("\n---\n"), body,
        )
    )
    path = F.concat("lang", F.lit("/"), "source", F.lit("--"), F.lpad(F.col("doc_id").cast("string"), 12, "0"), F.lit(".md"))
    return docs.select("doc_id", path.alias("path"), head.alias("content"))


def _sources(docs: DataFrame) -> DataFrame:
    """Documents as source rows, one per text: the first document with it gives the id."""
    return docs.groupBy("text").agg(F.min(F.struct("doc_id", "lang", "source")).alias("d")).select(
        F.concat(F.lit("s-"), "d.doc_id").alias("id"),
        F.concat(F.lit(_URL), F.md5("text")).alias("url"),
        _first_line().alias("title"),
        F.col("d.source").alias("topic"),
        F.col("text").alias("summary"),
        F.col("d.lang").alias("language"),
        F.lit("").alias("model"),
        F.lit("2025-01-01T00:00:00Z").alias("created_at"),
        F.array(F.col("d.lang")).alias("tags"),
    )


def _labelled(spark, sf) -> DataFrame:
    return _documents(spark, sf).join(_table(spark, sf, "labels").select("doc_id").distinct(), "doc_id", "left_semi")


def _classified(spark, sf) -> DataFrame:
    rows = extract.normalize_sources(_inbox(_documents(spark, sf)), now="2025-01-01T00:00:00Z")
    return ingest.classify_sources(rows)


def _outcomes(spark, sf) -> DataFrame:
    taken, others = ingest.route_files(_classified(spark, sf), _sources(_labelled(spark, sf)))
    others = others.drop("url")
    return taken.select(*others.columns).unionByName(others)


def _source_fields(spark, sf):
    rows = extract.normalize_sources(_inbox(_documents(spark, sf)), now="2025-01-01T00:00:00Z")
    return rows.select(
        "path", "id", "url", "topic", "language", "created_at", F.md5("summary").alias("summary_md5")
    )


# --- text search --------------------------------------------------------------------------

_INDEXES: dict[tuple, text_index.TextIndex] = {}


def _index(spark: SparkSession, sf: str, kind: str) -> text_index.TextIndex:
    """The stored index of a corpus, built on first use in a session."""
    key = (spark.sparkContext.applicationId, sf, kind)
    if key not in _INDEXES:
        docs = _table(spark, sf, "documents")
        if kind == "article":
            built = text_index.build_index(docs, {"title": _first_line(), "content": _rest()}, "doc_id")
        else:
            fields = {"summary": F.col("text"), "title": _first_line(), "topic": F.col("source")}
            built = text_index.build_index(docs, fields, "doc_id")
        _INDEXES[key] = text_index.write_index(built, f"{shared_folder(spark)}/{kind}-index-{uuid.uuid4().hex}")
    return _INDEXES[key]


def _text_queries(spark, sf) -> DataFrame:
    return _table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))


def _search(**options) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark, sf):
        return text_index.search(_text_queries(spark, sf), _index(spark, sf, "article"), **options)

    return run


def _search_excluding(spark, sf):
    queries = _text_queries(spark, sf).withColumn(
        "exclude", F.element_at(text_index.tokens("query"), -1)
    )
    return text_index.search(queries, _index(spark, sf, "article"), mode="any")


def _search_limits(spark, sf):
    """Each query with its own limit, by the length of its text."""
    queries = _text_queries(spark, sf).withColumn(
        "limit", requests.search_limit((F.length("query") / 50).cast("int") - 3)
    )
    return text_index.search(queries, _index(spark, sf, "article"), mode="any", limit_col="limit")


def _search_near(spark, sf):
    """Two words of each text, close to each other."""
    words = F.slice(text_index.tokens("query"), 2, 2)
    queries = _text_queries(spark, sf).withColumn("query", F.array_join(words, " "))
    return text_index.search(queries, _index(spark, sf, "article"), near=6)


def _match(spark, sf):
    """A term, a phrase and the beginning of a word of each text, without what holds another phrase of it."""
    words = text_index.tokens("query")
    queries = _text_queries(spark, sf).select(
        "qid", F.element_at(words, 3).alias("query"), F.substring(F.element_at(words, 4), 1, 2).alias("prefix"),
        F.array(F.array_join(F.slice(words, 1, 2), " ")).alias("phrases"),
        F.array(F.array_join(F.slice(words, 5, 2), " ")).alias("exclude_phrases"),
    )
    return text_index.match(queries, _index(spark, sf, "article"))


def _prefix_terms(spark, sf):
    """Terms of the dictionary by the beginnings of words, of one to five characters."""
    words = _text_queries(spark, sf).select(F.explode(text_index.tokens("query")).alias("w"))
    prefixes = words.select(F.explode(F.sequence(F.lit(1), F.lit(5))).alias("n"), "w").filter("length(w) >= n")
    found = text_index.prefix_terms(_index(spark, sf, "article"), prefixes.select(F.expr("substring(w, 1, n)").alias("prefix")))
    return found.groupBy("prefix").agg(F.count("*").alias("n"), F.min("term").alias("first"), F.max("term").alias("last"))


def _search_sources(spark, sf):
    names = _table(spark, sf, "documents").select("source").distinct()
    queries = names.select(F.col("source").alias("qid"), F.col("source").alias("query"))
    return text_index.search(queries, _index(spark, sf, "source"))


def _search_entities(spark, sf):
    hits = text_index.search(_text_queries(spark, sf), _index(spark, sf, "article"))
    stored = _table(spark, sf, "documents").select(
        F.col("doc_id").alias("id"), _first_line().alias("title"),
        F.col("source").alias("summary"), F.array("lang").alias("tags"),
    )
    found = requests.article_results(text_index.search_entities(hits, stored))
    return found.withColumn("tags", extract.tags_to_json("tags"))


def _term_stats(spark, sf):
    return text_index.term_stats(text_index.occurrences(_documents(spark, sf), {"text": F.col("text")}, "doc_id"))


def _doc_stats(spark, sf):
    return text_index.doc_stats(_documents(spark, sf), {"text": F.col("text")}, "doc_id").withColumn(
        "n_tokens", F.col("n_tokens").cast("long")
    )


def _corpus_stats(spark, sf):
    stats = text_index.corpus_stats(
        text_index.doc_stats(_documents(spark, sf), {"text": F.col("text")}, "doc_id")
    )
    return stats.withColumn("mean_tokens", F.round("mean_tokens", 4))


# --- vectors ------------------------------------------------------------------------------


def _vectors(spark, sf) -> DataFrame:
    return _table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


def _centroids(vectors: DataFrame) -> DataFrame:
    """Mean vector of every label."""
    cells = vectors.select("label", F.posexplode("embedding").alias("pos", "x"))
    means = cells.groupBy("label", "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return means.groupBy("label").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda c: c["x"].cast("float"))
        .alias("embedding")
    ).withColumn("qid", F.col("label"))


def _knn_all(spark, sf):
    vectors = _vectors(spark, sf)
    return knn.knn(_centroids(vectors), vectors, 10)


def _knn_part(spark, sf):
    vectors = _vectors(spark, sf)
    return knn.knn(_centroids(vectors), vectors, 10, part="label")


def _scroll(spark, sf):
    vectors = _vectors(spark, sf)
    return knn.scroll_topic(vectors, vectors.select("label").distinct(), 10, part="label").select(
        "label", "id", "score", "rank"
    )


def _pair_cosine(spark, sf):
    vectors = _vectors(spark, sf)
    pairs = vectors.join(_centroids(vectors).select("label", F.col("embedding").alias("mean")), "label")
    return pairs.select("id", F.round(cosine("embedding", "mean"), 6).alias("score"))


def _decode(spark, sf):
    """The 32 hex digits of an md5 are base64 of 24 bytes, that is, 6 floats of any kind."""
    texts = _documents(spark, sf).select("doc_id", F.md5("text").alias("encoded"))
    rows = requests.decode_embeddings(texts, "encoded", "v")
    cells = rows.select("doc_id", F.posexplode("v").alias("pos", "x"))
    return cells.select(
        "doc_id", "pos",
        F.when(F.isnan("x"), "nan").when(F.col("x") == 0, "zero")
        .when(F.abs("x") == float("inf"), "inf").otherwise("number").alias("kind"),
        F.when(F.isnan("x") | (F.abs("x") == float("inf")) | (F.col("x") == 0), None)
        .otherwise(F.signum("x")).alias("sign"),
        F.when(F.isnan("x") | (F.abs("x") == float("inf")) | (F.col("x") == 0), None)
        .otherwise(F.round(F.log2(F.abs(F.col("x").cast("double"))), 6)).alias("log2"),
    )


def _embedded(spark, sf) -> DataFrame:
    return embed(_documents(spark, sf).select("doc_id", "source", "text"), "text", dim=DIM)


def _embed_docs(spark, sf):
    cells = _embedded(spark, sf).select("doc_id", F.posexplode("embedding").alias("slot", "x"))
    return cells.filter("x != 0").select("doc_id", "slot", F.round(F.col("x").cast("double"), 6).alias("x"))


def _embed_strict(spark, sf):
    """All texts with a term embedded as one batch, of which none may fail."""
    docs = _documents(spark, sf).select("doc_id", "text").filter(F.size(text_index.tokens("text")) > 0)
    return embed(docs, "text", dim=DIM, on_error="fail").select("doc_id", F.size("embedding").alias("dim"))


def _semantic(spark, sf):
    asked = _table(spark, sf, "benchmark").select(
        F.col("item_id").alias("qid"), F.col("text").alias("query"), F.lit("").alias("embedding"),
        F.lit("").alias("topic"), F.lit(0).alias("limit"),
    )
    stored = _embedded(spark, sf).select(
        F.col("doc_id").alias("id"), "embedding", F.col("source").alias("topic")
    )
    return requests.semantic_search(asked, stored, dim=DIM)


def _mixed_requests(spark, sf) -> DataFrame:
    """Requests with and without topic, with limits on both sides of the default, some not to be answered."""
    kind = F.col("item_id") % 5
    return _table(spark, sf, "benchmark").select(
        F.col("item_id").alias("qid"),
        F.when(kind == 4, "").otherwise(F.col("text")).alias("query"),
        F.when(kind == 3, "AAAA").otherwise("").alias("embedding"),
        F.when(kind == 1, F.concat(F.lit("src"), F.col("item_id") % 20)).otherwise("").alias("topic"),
        ((F.col("item_id") * 7) % 40 - 4).cast("int").alias("limit"),
    )


def _semantic_limits(spark, sf):
    stored = _embedded(spark, sf).select(
        F.col("doc_id").alias("id"), "embedding", F.col("source").alias("topic")
    )
    return requests.semantic_search(_mixed_requests(spark, sf), stored, dim=DIM)


@F.pandas_udf(StringType())
def _encoded(vectors: pd.Series) -> pd.Series:
    """Vectors as clients send them: base64 of little-endian 32-bit floats."""
    return vectors.map(lambda v: base64.b64encode(np.asarray(v, dtype="<f4").tobytes()).decode())


def _vector_requests(spark, sf):
    """Searches by an encoded vector, some within a topic, each with its own limit."""
    vectors = _vectors(spark, sf)
    asked = _centroids(vectors).select(
        "qid", F.lit("not asked").alias("query"), _encoded("embedding").alias("embedding"),
        F.when(F.col("label") % 2 == 1, F.col("label").cast("string")).otherwise("").alias("topic"),
        (F.col("label") + 3).cast("int").alias("limit"),
    )
    stored = vectors.select("id", "embedding", F.col("label").cast("string").alias("topic"))
    return requests.semantic_search(asked, stored, dim=DIM)


def _refused(spark, sf):
    return requests.refused_requests(_mixed_requests(spark, sf), DIM)


def _payloads(spark, sf):
    rows = _sources(_documents(spark, sf)).withColumn("embedding", F.array(F.lit(1.0)))
    points = requests.source_vectors(rows)
    names = ("id", "url", "title", "topic", "language", "model", "created_at")
    return points.select("uuid", *[requests.read_payload(n).alias(n) for n in names])


def _ulids(spark, sf):
    ulid = F.concat(F.lit("0"), F.substring(F.upper(F.md5("text")), 1, 25))
    return _documents(spark, sf).select("doc_id", rekey_ulid(ulid).alias("uuid"))


# --- records ------------------------------------------------------------------------------


def _colliding(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.concat_ws("-", "lang", "n_chars").alias("id"), F.md5("text").alias("url"),
        F.col("source").alias("topic"), F.col("doc_id").alias("seq"),
    )


def _upsert(upsert: Callable, second: str):
    def run(spark, sf):
        docs = _table(spark, sf, "documents")
        first = _colliding(_labelled(spark, sf)).withColumnRenamed("url", second)
        every = _colliding(docs).withColumnRenamed("url", second)
        current = upsert(first.limit(0), first)
        return upsert(current, every)

    return run


def _upsert_vectors(spark, sf):
    """Points with vector and payload; the stored half is older than the batch."""
    rows = _vectors(spark, sf).select(
        F.concat(F.lit("v-"), F.md5(F.col("label").cast("string"))).alias("uuid"),
        "id", F.col("id").alias("seq"), "embedding", F.struct("label").alias("payload"),
    )
    stored = rows.filter("id % 2 = 0").withColumn("embedding", F.array(F.lit(0.0).cast("float")))
    first = F.round(F.get("embedding", F.lit(0)).cast("double"), 4)
    return records.upsert_vectors(stored, rows).select(
        "uuid", "id", "seq", "payload.label", first.alias("first_value"), F.size("embedding").alias("n")
    )


def _rejected_vectors(spark, sf):
    """Some vectors cut short, some with a number that is none."""
    odd = (
        F.when(F.col("id") % 7 == 0, F.slice("embedding", 1, 3))
        .when(F.col("id") % 11 == 0, F.transform("embedding", lambda x: x * F.lit(float("nan")).cast("float")))
        .otherwise(F.col("embedding"))
    )
    rows = _vectors(spark, sf).withColumn("embedding", odd)
    return knn.check_dim(rows, DIM)[1].select("id")


def _failing_model():
    """A model that fails on texts whose length divides by five."""

    def model(texts: list[str]) -> list:
        if any(len(t) % 5 == 0 for t in texts):
            raise ValueError("no vector")
        return [[1.0, float(len(t))] for t in texts]

    return model


def _failed_embeddings(spark, sf):
    rows = embed(_documents(spark, sf).select("doc_id", "text"), "text", _failing_model)
    return rows.select("doc_id", F.col("embedding").isNotNull().alias("embedded"), F.get("embedding", F.lit(1)).cast("long").alias("n"))


def _article_payloads(spark, sf):
    rows = _articles(spark, sf).withColumn("embedding", F.array(F.lit(1.0)))
    names = ("id", "title", "path", "category")
    return requests.article_vectors(rows).select("uuid", *[requests.read_payload(n).alias(n) for n in names])


def _source_results(spark, sf):
    rows = _sources(_documents(spark, sf)).withColumn("embedding", F.array(F.lit(1.0)))
    hits = requests.source_vectors(rows).select(
        F.col("payload.topic").alias("qid"), F.col("uuid").alias("id"), "payload",
        F.length("payload.summary").cast("double").alias("score"), F.lit(1).alias("rank"),
    )
    return requests.source_results(hits).drop("summary")


def _store_cycle(spark, sf):
    """Records stored, some stored again under another url, some deleted; rows with vector and index entry."""
    store = Store(spark, f"{shared_folder(spark)}/store-{uuid.uuid4().hex}", parts=4, buckets=4)
    docs = _documents(spark, sf).select(
        "doc_id", F.concat(F.lit("s-"), "doc_id").alias("id"), F.concat(F.lit(_URL), F.md5("text")).alias("url"),
        _first_line().alias("title"), F.col("source").alias("topic"), F.col("text").alias("summary"),
        F.col("lang").alias("language"), F.lit("").alias("model"), F.lit("").alias("created_at"),
        F.lit(None).cast("array<string>").alias("tags"),
    )
    now = "2025-01-01T00:00:00Z"
    jobs.store_records(store, docs, "doc_id", dim=DIM, now=now)
    moved = docs.filter("doc_id % 3 = 0").withColumn("url", F.concat(F.lit(_URL + "new/"), "doc_id"))
    jobs.store_records(store, moved, "doc_id", dim=DIM, now=now)
    jobs.delete_sources(store, docs.filter("doc_id % 5 = 0").select("id"))
    points = store.read("source_vectors").groupBy(F.col("payload.id").alias("id")).agg(F.count("*").alias("vectors"))
    entries = store.index("source").doc_stats.groupBy(F.col("doc_id").alias("id")).agg(F.count("*").alias("entries"))
    return store.read("sources").select("id", "url").join(points, "id", "full").join(entries, "id", "full")


def _new_store(spark, name: str) -> Store:
    return Store(spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}", parts=4, buckets=2)


_INDEX_RUNS: dict[tuple, tuple[DataFrame, Store]] = {}


def _index_run(spark, sf) -> tuple[DataFrame, Store]:
    """All articles indexed with vectors, after the labelled ones; done once in a session."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _INDEX_RUNS:
        store, docs = _new_store(spark, "articles"), _markdown(_documents(spark, sf))
        labelled = docs.join(_table(spark, sf, "labels").select("doc_id").distinct(), "doc_id", "left_semi")
        jobs.index_articles(store, labelled, version="first")
        _INDEX_RUNS[key] = jobs.index_articles(store, docs, embeddings=True, version="second", dim=DIM), store
    return _INDEX_RUNS[key]


def _index_report(spark, sf):
    report, store = _index_run(spark, sf)
    version = records.get_info(store.read("info"), spark.range(1).select(F.lit("version").alias("key")))
    return report.select("name", "n", F.lit("").alias("value")).union(
        version.select(F.col("key").alias("name"), F.lit(1).cast("long"), "value")
    )


def _indexed_articles(spark, sf):
    store = _index_run(spark, sf)[1]
    points = store.read("article_vectors").groupBy(F.col("payload.id").alias("id")).agg(F.count("*").alias("vectors"))
    entries = store.index("article").doc_stats.select(F.col("doc_id").alias("id"), F.col("n_tokens").cast("long"))
    rows = store.read("articles").select("id", "path", "title")
    return rows.join(points, "id", "full").join(entries, "id", "full")


def _ingest_run(spark, sf):
    """Outcomes of an inbox on an empty store, and of every file stored its row's and its index entry's figures."""
    store = _new_store(spark, "inbox")
    outcomes = jobs.ingest_sources(store, _inbox(_documents(spark, sf)), dim=DIM, now="2025-01-01T00:00:00Z")
    entries = store.index("source").doc_stats.select(F.col("doc_id").alias("id"), F.col("n_tokens").cast("long"))
    points = store.read("source_vectors").select("payload.id", F.size("embedding").alias("dim"))
    rows = store.read("sources").select("id", "url", "topic", F.lit("").alias("reason")).join(entries, "id", "full").join(points, "id", "full")
    stored = _inbox_ids(spark, sf).join(rows, "id").drop("reason")
    return outcomes.join(stored, "path", "full")


def _inbox_ids(spark, sf) -> DataFrame:
    files = _inbox(_documents(spark, sf))
    return files.filter(~F.col("path").contains("/src7-")).select("path", F.concat(F.lit("s-"), "doc_id").alias("id"))


def _json_lines(spark, lines) -> str:
    path = f"{shared_folder(spark)}/lines-{uuid.uuid4().hex}"
    lines.write.text(path)
    return path


def _json_records(spark, sf):
    """Records as JSON lines, those of one source cut off; what cannot be decoded is given by its text."""
    docs = _documents(spark, sf)
    record = F.to_json(F.struct(
        F.concat(F.lit("s-"), "doc_id").alias("id"), F.md5("text").alias("url"), F.col("text").alias("summary"),
        F.when(F.col("lang") != "en", F.col("source")).alias("topic"), F.array("lang").alias("tags"),
    ))
    lines = docs.select(F.when(F.col("source") == "src7", F.concat(F.lit('{"id": "s-'), "doc_id")).otherwise(record).alias("value"))
    rows, bad = scan.read_source_records(spark, _json_lines(spark, lines))
    return rows.select(
        "id", "url", "topic", "model", F.md5("summary").alias("summary_md5"), extract.tags_to_json("tags").alias("tags"),
        F.lit(None).cast("string").alias("bad"),
    ).union(bad.select(*[F.lit(None).cast("string")] * 6, "value"))


def _json_requests(spark, sf):
    """Search requests as JSON lines; a limit that is no number makes a line undecodable."""
    asked = _table(spark, sf, "benchmark")
    kind = F.col("item_id") % 4
    line = F.concat(
        F.lit('{"query": '), F.to_json(F.array(F.md5("text"))).substr(2, 34), F.lit(', "topic": "t'), F.col("item_id"),
        F.when(kind == 0, '"').when(kind == 1, '", "limit": "many"').otherwise(F.concat(F.lit('", "limit": '), F.col("item_id"))), F.lit("}"),
    )
    rows, bad = scan.read_search_requests(spark, _json_lines(spark, asked.select(line.alias("value"))))
    return rows.select("query", "topic", F.col("limit").cast("long").alias("limit"), F.lit(True).alias("valid")).union(
        bad.select(F.lit(None), "value", F.lit(None), F.lit(False))
    )


def _delete(spark, sf):
    docs = _table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "source")
    return records.delete_ids(docs, _table(spark, sf, "labels").select(F.col("doc_id").alias("id")))


def _lookup_id(spark, sf):
    rows = _sources(_table(spark, sf, "documents")).select("id", "url", "topic")
    keys = _table(spark, sf, "labels").select(F.concat(F.lit("s-"), "doc_id").alias("id"))
    return records.lookup(keys, rows, "id")


def _lookup_url(spark, sf):
    rows = _sources(_table(spark, sf, "documents")).select("id", "url", "topic")
    keys = _labelled(spark, sf).select(F.concat(F.lit(_URL), F.md5("text")).alias("url"))
    return records.lookup(keys, rows, "url")


def _lookup_articles(spark, sf):
    rows = _articles(spark, sf).select("id", "path", "title")
    keys = _table(spark, sf, "labels").select(F.concat(F.lit("a-"), "doc_id").alias("id"))
    return records.lookup(keys, rows, "id")


def _list_topics(spark, sf):
    docs = _table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("topic"))
    return records.list_by_topics(docs, docs.select("topic"), requests.DEFAULT_SEARCH)


def _list_all(spark, sf):
    docs = _table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("topic"))
    return records.list_by_topic(docs)


def _counts(spark, sf):
    return records.counts(
        sources=_sources(_table(spark, sf, "documents")), articles=_table(spark, sf, "documents")
    )


def _info(spark, sf) -> DataFrame:
    """Rows per document source as recorded values, replaced by those of the labelled ones."""
    def tally(docs):
        return docs.groupBy(F.col("source").alias("key")).agg(F.count("*").cast("string").alias("value"))

    return records.set_info(tally(_table(spark, sf, "documents")), tally(_labelled(spark, sf)))


def _get_info(spark, sf):
    names = _table(spark, sf, "documents").select("source").union(
        _table(spark, sf, "documents").select("lang")
    )
    return records.get_info(_info(spark, sf), names.distinct().withColumnRenamed("source", "key"))


def _health(spark, sf):
    info = _table(spark, sf, "documents").agg(F.max("doc_id").cast("string").alias("value")).select(
        F.lit("version").alias("key"), "value"
    )
    return records.health(_sources(_table(spark, sf, "documents")), _table(spark, sf, "documents"), info)


def _dry_run(spark, sf):
    return ingest.dry_run(_classified(spark, sf))


def _valid_records(spark, sf):
    kept, rejected = ingest.validate_records(
        _table(spark, sf, "documents").select(
            "doc_id",
            F.when(F.col("source") == "src2", "").otherwise(F.col("source")).alias("url"),
            F.col("text").alias("summary"),
        )
    )
    return kept.select("doc_id", F.lit(True).alias("valid")).union(rejected.select("doc_id", F.lit(False)))


def _routes(spark, sf):
    rows = _table(spark, sf, "documents").select(
        "doc_id",
        F.when(F.col("lang") == "fr", "").otherwise(F.col("source")).alias("query"),
        F.when(F.col("lang") == "de", F.md5("text")).otherwise("").alias("embedding"),
        F.lit("").alias("topic"),
        (F.col("n_chars") - 1000).cast("int").alias("limit"),
    )
    return requests.route_requests(rows).select(
        "doc_id", "route", F.col("limit").cast("long").alias("limit"),
        requests.list_limit(F.substring_index("embedding", "a", 1)).cast("long").alias("list_limit"),
    )


_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "bm25_all": _search(),
    "bm25_any": _search(mode="any"),
    "bm25_exclude": _search_excluding,
    "bm25_limits": _search_limits,
    "phrase": _search(mode="phrase"),
    "prefix": _search(mode="prefix"),
    "field_filter": _search(mode="any", fields=["title"]),
    "field_start": _search(mode="any", at_start=True),
    "near": _search(near=40),
    "near_words": _search_near,
    "prefix_terms": _prefix_terms,
    "mixed_units": _match,
    "source_text_search": _search_sources,
    "article_results": _search_entities,
    "term_stats": _term_stats,
    "doc_stats": _doc_stats,
    "corpus_stats": _corpus_stats,
    "knn_all": _knn_all,
    "knn_label": _knn_part,
    "scroll_label": _scroll,
    "pair_cosine": _pair_cosine,
    "decode_vectors": _decode,
    "embed_docs": _embed_docs,
    "embed_strict": _embed_strict,
    "semantic_search": _semantic,
    "semantic_limits": _semantic_limits,
    "refused_requests": _refused,
    "vector_requests": _vector_requests,
    "payloads": _payloads,
    "ulid_to_uuid": _ulids,
    "front_matter": _front_matter,
    "article_rows": _article_rows,
    "meta_json": _meta_json,
    "tags_text": _tags_text,
    "embed_text": _embed_text,
    "source_fields": _source_fields,
    "ingest_outcomes": _outcomes,
    "ingest_report": lambda spark, sf: ingest.run_report(_outcomes(spark, sf)),
    "ingest_totals": lambda spark, sf: ingest.run_totals(_outcomes(spark, sf)),
    "consumed_files": lambda spark, sf: ingest.consumed_files(_outcomes(spark, sf)),
    "dry_run": _dry_run,
    "valid_records": _valid_records,
    "request_routes": _routes,
    "upsert_two_keys": _upsert(records.upsert_sources, "url"),
    "upsert_articles": _upsert(records.upsert_articles, "path"),
    "upsert_vectors": _upsert_vectors,
    "rejected_vectors": _rejected_vectors,
    "failed_embeddings": _failed_embeddings,
    "article_payloads": _article_payloads,
    "source_results": _source_results,
    "store_cycle": _store_cycle,
    "index_report": _index_report,
    "indexed_articles": _indexed_articles,
    "ingest_run": _ingest_run,
    "json_records": _json_records,
    "json_requests": _json_requests,
    "delete_ids": _delete,
    "lookup_id": _lookup_id,
    "lookup_url": _lookup_url,
    "lookup_articles": _lookup_articles,
    "list_topics": _list_topics,
    "list_all": _list_all,
    "counts": _counts,
    "info": _info,
    "info_get": _get_info,
    "health": _health,
}


def entry(spark: SparkSession) -> DataFrame:
    """Ranked text search of all benchmark texts over all documents."""
    return _QUERIES["bm25_any"](spark, _SMOKE)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return oracle.oracle_sql()
