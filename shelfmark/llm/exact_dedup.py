"""Exact duplicates with a split of heavy hitters, in DataFrame operations only.

Texts are equal when identical after each run of white space (0x20, 0x09 to 0x0D) became one
space; null counts as empty.  A Misra-Gries sketch (Spark's `approx_top_k`) names digests that may
be frequent.  Their true counts and winners are worked out with map-side sums, at most `heavy` rows,
and broadcast: rows of frequent digests never pass a shuffle.  All others do.  The sketch decides
only which way a row goes, never the result.

Of equal texts the row with the smallest doc_id stays (null last); of rows equal in both, one.
An empty table gives an empty result; extra columns do no harm.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WHITE, table, written

HEAVY = 1024
TRACKED = 8192


def text_digest(text="text"):
    """SHA-256 of the text with every run of white space made one space; null counts as empty."""
    return F.sha2(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), f"[{WHITE}]+", " "), 256)


def heavy_digests(digests: DataFrame, heavy: int = HEAVY, tracked: int = TRACKED) -> DataFrame:
    """At most `heavy` digests that may be frequent, by Misra-Gries counters."""
    top = digests.agg(F.expr(f"approx_top_k(digest, {heavy}, {tracked})").alias("top"))
    return (
        top.select(F.explode("top").alias("top"))
        .where("top.item is not null and top.count > 1")
        .select(F.col("top.item").alias("digest"))
    )


def _order():
    return [F.col("doc_id").asc_nulls_last(), F.col("row")]


def duplicate_groups(docs: DataFrame, heavy: int = HEAVY, tracked: int = TRACKED) -> DataFrame:
    """(doc_id, row, digest, keep_id, group_size, kept) for every row; `row` tells rows apart."""
    digests = written(
        docs.select(
            "doc_id",
            F.monotonically_increasing_id().alias("row"),
            text_digest().alias("digest"),
        ),
        "digests",
    )
    frequent = F.broadcast(written(heavy_digests(digests, heavy, tracked), "heavy"))
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    winners = (
        digests.join(frequent, "digest")
        .groupBy("digest")
        .agg(F.min(place).alias("first"), F.count("*").alias("group_size"))
    )
    by_map = digests.join(F.broadcast(winners), "digest").select(
        "doc_id", "row", "digest",
        F.col("first.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("first.row")).alias("kept"),
    )
    group = Window.partitionBy("digest")
    by_shuffle = (
        digests.join(frequent, "digest", "left_anti")
        .withColumn("first", F.min(place).over(group))
        .select(
            "doc_id", "row", "digest",
            F.col("first.doc_id").alias("keep_id"),
            F.count("*").over(group).alias("group_size"),
            (F.col("row") == F.col("first.row")).alias("kept"),
        )
    )
    return by_map.unionByName(by_shuffle)


def keep_first(docs: DataFrame, heavy: int = HEAVY, tracked: int = TRACKED) -> DataFrame:
    """The documents without exact duplicates, whole rows.

    Ties in doc_id go to the row that is smallest in the other columns.
    """
    names = docs.columns
    digest, others = "__llm_digest", [c for c in names if c != "doc_id"]
    marked = docs.withColumn(digest, text_digest())
    ids = written(marked.select("doc_id", F.col(digest).alias("digest")), "digests")
    frequent = F.broadcast(written(heavy_digests(ids, heavy, tracked), "heavy"))
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")
    winners = (
        ids.join(frequent, "digest")
        .groupBy(F.col("digest").alias(digest))
        .agg(F.min(place).alias("__llm_first"))
    )
    # Map side: of a frequent text only rows with the winner's id are left, and of those one.
    stay = marked.join(F.broadcast(winners), digest).where(F.col("doc_id").eqNullSafe(F.col("__llm_first.doc_id")))
    row = F.struct(*[F.col(f"`{c}`") for c in names])
    by_map = stay.groupBy(digest).agg(F.min(row).alias("__llm_row")).select("__llm_row.*")
    order = [F.col("doc_id").asc_nulls_last(), *[F.col(f"`{c}`") for c in others]]
    by_shuffle = (
        marked.join(frequent.withColumnRenamed("digest", digest), digest, "left_anti")
        .withColumn("__llm_place", F.row_number().over(Window.partitionBy(digest).orderBy(*order)))
        .where("__llm_place = 1")
    )
    return by_map.unionByName(by_shuffle.select(*[f"`{c}`" for c in names]))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_groups(table(spark, sf_dir, "documents")).select(
        "doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256")
    )


ORACLE = {
    "op4_exact_dedup": r"""
        WITH d AS (
            SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
            FROM documents)
        SELECT doc_id, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
               count(*) OVER (PARTITION BY text_sha256) AS group_size,
               doc_id = min(doc_id) OVER (PARTITION BY text_sha256) AS kept, text_sha256
        FROM d"""
}
