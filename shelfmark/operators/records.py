"""Stored records: upsert under two unique keys, deletes, lookups, lists and counts."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .joins import spread_join, top_k

DEFAULT_LIST = 100
SOURCE_KEYS = ("id", "url")
ARTICLE_KEYS = ("id", "path")


def last_rows(batch: DataFrame, keys: Sequence[str], seq: str) -> DataFrame:
    """Rows of a batch that no later row replaces, that is, shares any of the keys with.

    Only (key, seq) pairs are grouped, partly before the shuffle, so a key on a third of the rows
    is no burden; the wide rows are then picked by their unique `seq`.
    """
    return batch.join(_last_seqs(batch, keys, seq), seq, "left_semi")


def _last_seqs(batch: DataFrame, keys: Sequence[str], seq: str) -> DataFrame:
    latest = [batch.groupBy(key).agg(F.max(seq).alias(seq)).select(seq) for key in keys]
    return reduce(lambda a, b: a.join(b, seq, "left_semi"), latest)


def lost_seqs(batch: DataFrame, keys: Sequence[str], seq: str) -> DataFrame:
    """The `seq` of the rows that `last_rows` leaves out, null apart.

    Often few: written, so that their size is known, they go to the wide rows, which are then not shuffled.
    """
    given = batch.select(seq).filter(F.col(seq).isNotNull()).distinct()
    return given.join(_last_seqs(batch, keys, seq), seq, "left_anti")


def untouched_rows(current: DataFrame, batch: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Stored rows that share no key with the batch."""
    return reduce(
        lambda rows, key: rows.join(batch.select(key).distinct(), key, "left_anti"), keys, current
    )


def replaced_rows(current: DataFrame, batch: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Stored rows that share some key with the batch."""
    marked = [
        current.join(batch.select(key).distinct(), key, "left_semi").select(*current.columns)
        for key in keys
    ]
    return reduce(DataFrame.union, marked).dropDuplicates([keys[0]])


def upsert(current: DataFrame, batch: DataFrame, keys: Sequence[str], seq: str) -> DataFrame:
    """Insert or replace, row after row in the order of `seq` (unique), under every key.

    The end state in one step: stored rows without a key in the batch, and of the batch the rows
    that no later one replaces.
    """
    return untouched_rows(current, batch, keys).unionByName(
        last_rows(batch, keys, seq).select(*current.columns)
    )


def upsert_sources(current: DataFrame, batch: DataFrame, seq: str = "seq") -> DataFrame:
    return upsert(current, batch, SOURCE_KEYS, seq)


def upsert_articles(current: DataFrame, batch: DataFrame, seq: str = "seq") -> DataFrame:
    return upsert(current, batch, ARTICLE_KEYS, seq)


def upsert_vectors(current: DataFrame, batch: DataFrame, seq: str = "seq") -> DataFrame:
    return upsert(current, batch, ("uuid",), seq)


def delete_ids(table: DataFrame, ids: DataFrame, on: str = "id") -> DataFrame:
    """Rows whose id is not among `ids` (column id); unknown ids are no error."""
    return table.join(ids.select(F.col("id").alias(on)).distinct(), on, "left_anti")


def lookup(keys: DataFrame, table: DataFrame, on: str) -> DataFrame:
    """Stored rows for a table of keys; keys without a row drop out."""
    return table.join(keys.select(on).distinct(), on, "left_semi")


def list_by_topic(sources: DataFrame, topic: str | None = None, limit: int = DEFAULT_LIST) -> DataFrame:
    """First sources of a topic by id; of all topics if none is given."""
    rows = sources if topic is None else sources.filter(F.col("topic") == topic)
    return rows.orderBy("id").limit(limit if limit > 0 else DEFAULT_LIST)


def list_by_topics(sources: DataFrame, topics: DataFrame, limit: int = DEFAULT_LIST) -> DataFrame:
    """First sources by id of each of many topics; every topic is cut before the shuffle."""
    rows = spread_join(sources, topics.select("topic").distinct(), ["topic"], ["id"], "left_semi")
    return top_k(rows, ["topic"], [F.col("id")], limit if limit > 0 else DEFAULT_LIST, ["id"])


def counts(**tables: DataFrame) -> DataFrame:
    """One row per table: its name and number of rows."""
    return reduce(
        DataFrame.union,
        [t.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
         for name, t in tables.items()],
    )


def health(sources: DataFrame, articles: DataFrame, info: DataFrame) -> DataFrame:
    """One row: status, both counts and the recorded version, else 'unknown'."""
    none = F.lit(None)
    parts = [
        sources.select(F.lit(1).alias("s"), none.cast("int").alias("a"), none.cast("string").alias("v")),
        articles.select(none.cast("int"), F.lit(1), none.cast("string")),
        info.filter(F.col("key") == "version").select(none.cast("int"), none.cast("int"), "value"),
    ]
    return reduce(DataFrame.union, parts).agg(
        F.lit("ok").alias("status"),
        F.count("s").alias("source_count"),
        F.count("a").alias("article_count"),
        F.coalesce(F.max("v"), F.lit("unknown")).alias("version"),
    )


def set_info(info: DataFrame, changes: DataFrame) -> DataFrame:
    """Key-value rows with the changed keys replaced."""
    return info.join(changes.select("key"), "key", "left_anti").select("key", "value").unionByName(
        changes.select("key", "value")
    )


def get_info(info: DataFrame, keys: DataFrame) -> DataFrame:
    """Value of every asked key, '' where none is set."""
    return keys.join(info, "key", "left").select(
        "key", F.coalesce("value", F.lit("")).alias("value")
    )


def running(df: DataFrame, key: str, seg: str, order: str, value: str, forward: bool) -> DataFrame:
    """Add `<value>_near`: the nearest earlier (or later) value of the same key that is not null.

    Rows come in segments of bounded size that are ordered among each other, so the window runs
    inside one segment of a key and a second one over a single row per segment; no task gets a
    whole hot key.
    """
    pick, nearest = (F.last, F.max_by) if not forward else (F.first, F.min_by)
    ahead = (1, Window.unboundedFollowing) if forward else (Window.unboundedPreceding, -1)
    inner = Window.partitionBy(key, seg).orderBy(order).rowsBetween(*ahead)
    outer = Window.partitionBy(key).orderBy(seg).rowsBetween(*ahead)
    edges = (
        df.groupBy(key, seg)
        .agg(nearest(value, F.when(F.col(value).isNotNull(), F.col(order))).alias("_edge"))
        .withColumn("_carry", pick("_edge", ignorenulls=True).over(outer))
        .drop("_edge")
    )
    return (
        df.withColumn("_own", pick(value, ignorenulls=True).over(inner))
        .join(edges, [key, seg])
        .withColumn(f"{value}_near", F.coalesce("_own", "_carry"))
        .drop("_own", "_carry")
    )
