"""Declared shapes of the records and stored tables."""

from __future__ import annotations

from pyspark.sql import types as T


def _strings(*names: str) -> list[T.StructField]:
    return [T.StructField(name, T.StringType()) for name in names]


_TAGS = T.StructField("tags", T.ArrayType(T.StringType()))
_EMBEDDING = T.StructField("embedding", T.ArrayType(T.FloatType()))

DOCUMENT = T.StructType(_strings("path", "rel_path", "content"))

# Front matter keys of each kind of document; every other key goes to `rest`.
ARTICLE_STRINGS = ("id", "title", "author", "summary")
ARTICLE_LISTS = ("tags",)
SOURCE_STRINGS = (
    "id", "slug", "title", "url", "type", "related_article", "created", "summary", "model",
    "language",
)
SOURCE_LISTS = ("tags", "people", "orgs", "places")

SOURCE = T.StructType(
    [
        *_strings("id", "url", "title", "topic", "summary", "language", "model", "created_at"),
        _TAGS,
    ]
)
ARTICLE = T.StructType([*_strings("id", "title", "path", "author", "summary"), _TAGS,
                        *_strings("meta_json")])
# With the text that the index is built from.
STORED_ARTICLE = T.StructType([*ARTICLE.fields, *_strings("content")])
SEARCH_REQUEST = T.StructType(
    [*_strings("query", "embedding", "topic"), T.StructField("limit", T.IntegerType())]
)
INFO = T.StructType(_strings("key", "value"))

SOURCE_PAYLOAD = T.StructType(
    _strings("id", "url", "title", "topic", "summary", "language", "model", "created_at")
)
ARTICLE_PAYLOAD = T.StructType(
    [*_strings("id", "title", "path", "summary"), _TAGS, *_strings("category")]
)
SOURCE_VECTOR = T.StructType(
    [*_strings("uuid"), _EMBEDDING, T.StructField("payload", SOURCE_PAYLOAD)]
)
ARTICLE_VECTOR = T.StructType(
    [*_strings("uuid"), _EMBEDDING, T.StructField("payload", ARTICLE_PAYLOAD)]
)

# Fields of the text indexes, in the order of their numbers.
FIELDS = {"source": ("summary", "title", "topic"), "article": ("content", "title", "summary", "tags")}

POSTING = T.StructType(
    [
        *_strings("term"),
        T.StructField("range", T.LongType()),
        T.StructField("n", T.IntegerType()),
        T.StructField("n_occurrences", T.LongType()),
        T.StructField("max_tf", T.IntegerType()),
        T.StructField("min_len", T.IntegerType()),
        T.StructField("docs", T.ArrayType(T.StringType())),
        T.StructField("tfs", T.ArrayType(T.IntegerType())),
        T.StructField("lens", T.ArrayType(T.IntegerType())),
        T.StructField("places", T.ArrayType(T.ArrayType(T.LongType()))),
        T.StructField("bucket", T.IntegerType()),
    ]
)
TERM = T.StructType(
    [*_strings("term", "bin"), T.StructField("n_docs", T.LongType()), T.StructField("n_occurrences", T.LongType())]
)
