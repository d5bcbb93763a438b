"""Search requests: routing, defaults and the searches they lead to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import rekey_ulid
from ..functions.text import with_once
from ..functions.vectors import decode_embedding
from ..plans.shared import materialise
from .embed import DEFAULT_DIM, embed
from .knn import check_dim, knn, with_payload

DEFAULT_SEARCH = 10
DEFAULT_LIST = 100


def search_limit(limit: Column | str) -> Column:
    """A positive limit as given, else 10."""
    limit = F.col(limit) if isinstance(limit, str) else limit
    return F.when(limit > 0, limit).otherwise(DEFAULT_SEARCH)


def list_limit(text: Column | str) -> Column:
    """A positive number as given, else 100; the limit comes as text."""
    text = F.col(text) if isinstance(text, str) else text
    number = F.when(text.rlike(r"\A[+-]?[0-9]+\z"), text.try_cast("int"))
    return F.when(number > 0, number).otherwise(DEFAULT_LIST)


def route_requests(requests: DataFrame) -> DataFrame:
    """Add route ('vector', 'text' or 'rejected') and the limit to use; a given vector wins."""
    given = {n: F.coalesce(n, F.lit("")) for n in ("query", "embedding", "topic")}
    return requests.withColumns(
        {
            "route": F.when(given["embedding"] != "", "vector")
            .when(given["query"] != "", "text")
            .otherwise("rejected"),
            "topic": given["topic"],
            "limit": search_limit("limit"),
        }
    )


def decode_embeddings(df: DataFrame, col: str, out: str = "embedding") -> DataFrame:
    """Decode a base64 column to vectors; a text that is none gets null and a decode_error."""
    return with_once(df, out, decode_embedding(col)).withColumn(
        "decode_error", F.when(F.col(out).isNull(), F.lit("invalid embedding"))
    )


def article_requests(requests: DataFrame) -> DataFrame:
    """Text queries for the article index; embedding and topic play no part there."""
    return requests.filter(F.coalesce("query", F.lit("")) != "").select(
        "qid", "query", search_limit("limit").alias("limit")
    )


def _asked(requests: DataFrame, model, dim: int | None) -> DataFrame:
    """Requests with the vector to search for; null where there is none."""
    routed = route_requests(requests.dropDuplicates(["qid"]))
    given = decode_embeddings(routed.filter(F.col("route") == "vector"), "embedding", "vector").drop(
        "decode_error"
    )
    made = embed(routed.filter(F.col("route") == "text"), "query", model, dim or DEFAULT_DIM, out="vector")
    none = routed.filter(F.col("route") == "rejected").withColumn("vector", F.lit(None).cast("array<float>"))
    asked = given.unionByName(made).unionByName(none)
    return asked.select("qid", F.col("vector").alias("embedding"), "topic", "limit", "route")


def refused_requests(requests: DataFrame, dim: int, model=None) -> DataFrame:
    """(qid, reason) of the requests that get no answer.

    Reasons: no_query (neither text nor vector), no_vector (no vector for the text), wrong_vector (not
    decodable, of another dimension, or with numbers that are not finite).
    """
    return check_dim(_asked(requests, model, dim), dim)[1].select(
        "qid",
        F.when(F.col("route") == "rejected", "no_query")
        .when(F.col("route") == "text", "no_vector")
        .otherwise("wrong_vector")
        .alias("reason"),
    )


def semantic_search(requests: DataFrame, vectors: DataFrame, model=None, dim: int | None = None) -> DataFrame:
    """Source search for requests (qid, query, embedding, topic, limit), each with its own limit.

    Encoded vectors are decoded, other queries embedded, once; then one k-NN job for the requests of
    any topic and one for those that name a topic, where there are such.  `vectors` holds id, embedding,
    topic.  `refused_requests` names the requests that get no answer.
    """
    asked = materialise(_asked(requests, model, dim).filter(F.col("embedding").isNotNull()), "asked")
    anywhere = knn(asked.filter("topic = ''"), vectors, dim=dim, limit_col="limit")
    in_topic = knn(asked.filter("topic != ''"), vectors, part="topic", dim=dim, limit_col="limit")
    return anywhere.unionByName(in_topic)


def source_search(requests: DataFrame, vectors: DataFrame, model=None, dim: int | None = None) -> DataFrame:
    """Result rows of a source search over stored vectors (uuid, embedding, payload)."""
    points = vectors.select(F.col("uuid").alias("id"), "embedding", "payload", read_payload("topic").alias("topic"))
    return source_results(with_payload(semantic_search(requests, points, model, dim), points))


# --- payloads and result shapes -----------------------------------------------------------


def source_vectors(sources: DataFrame) -> DataFrame:
    """(sources with embedding) to vector rows: uuid, embedding, payload."""
    names = ("id", "url", "title", "topic", "summary", "language", "model", "created_at")
    return sources.select(
        rekey_ulid("id").alias("uuid"), "embedding", F.struct(*names).alias("payload")
    )


def article_vectors(articles: DataFrame) -> DataFrame:
    names = ("id", "title", "path", "summary", "tags", "category")
    return articles.select(
        rekey_ulid("id").alias("uuid"), "embedding", F.struct(*names).alias("payload")
    )


def read_payload(name: str) -> Column:
    """A payload field as text, '' where missing."""
    return F.coalesce(F.col(f"payload.{name}"), F.lit(""))


def source_results(hits: DataFrame) -> DataFrame:
    """Result rows of a source search: point id, original id, score and payload fields."""
    names = ("url", "title", "topic", "summary", "language", "model", "created_at")
    return hits.select(
        "qid",
        F.col("id"),
        read_payload("id").alias("source_id"),
        "score",
        *[read_payload(name).alias(name) for name in names],
        "rank",
    )


def article_results(hits: DataFrame) -> DataFrame:
    """Result rows of an article search: id, title, summary and tags."""
    return hits.select("qid", "rank", "id", "title", "summary", "tags")
