"""Shards by a k-d tree over document metadata, with equal bytes in every leaf.

The tree is cut level by level.  In every node the widest dimension is cut at the weighted quantile
that leaves each side the bytes of its leaves (the median where both sides have as many).  Quantiles
come from histograms that Spark sums by (node, bin), refined twelve bits at a time; the driver sees only
bins, at most 4096 a node.  The table of points (numbers only, no texts) is rewritten once a level.

Dimensions: size (logarithmic), place in the corpus (doc_id), language and source (hashed).  Equal texts
form a group that shares the metadata of its first row, and so lies in one leaf.  A group above
`piece` times a leaf's bytes is cut into pieces by doc_id, since it could not be balanced whole.

Null texts have no bytes, null metadata is a value of its own, repeated rows count as often as they
occur, an empty table gives an empty result and extra columns do no harm.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bit_hash, table, written

DIMENSIONS = ("at_size", "at_id", "at_lang", "at_source")
KEY_BITS, STEP_BITS = 60, 12
SLOT_ROWS = 1 << 16


def _points(docs: DataFrame, shards: int, piece: float) -> tuple[DataFrame, dict] | None:
    """Rows with size, checksum, coordinates of 30 bits and a tie number of 30 bits."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = written(
        docs.select(
            "doc_id",
            (F.octet_length(text) + 16).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.md5(text.cast("binary")).alias("digest"),
            "lang",
            "source",
        ),
        "shard-rows",
    )
    total = rows.agg(F.sum("size"), F.max("size"), F.min("doc_id"), F.max("doc_id")).first()
    if total[0] is None:
        return None
    bytes_all, largest, low, high = total
    low, high = low or 0, high or 0
    groups = rows.groupBy(F.col("digest")).agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "lang", "source")).alias("first"),
        F.sum("size").alias("group_size"),
    )
    scale = (1 << 30) - 1
    pieces = F.ceil(F.col("group_size") / F.lit(max(1.0, bytes_all / shards * piece)))
    with_group = rows.select("doc_id", "size", "text_crc32", "digest").join(groups, "digest")
    points = with_group.select(
        "doc_id", "size", "text_crc32",
        (F.log2(F.col("size")) / math.log2(largest + 1) * scale).cast("long").alias("at_size"),
        F.coalesce(
            ((F.col("first.doc_id") - low) / max(1, high - low) * scale).cast("long"), F.lit(0)
        ).alias("at_id"),
        bit_hash("first.lang", bits=30).alias("at_lang"),
        bit_hash("first.source", bits=30).alias("at_source"),
        (
            bit_hash("digest", bits=16) * (1 << 14)
            + F.when(pieces > 1, F.pmod(F.xxhash64("doc_id"), F.least(pieces, F.lit(1 << 14)))).otherwise(0)
        ).alias("tie"),
    )
    return written(points, "shard-points"), {"bytes": bytes_all}


def _of_node(values: list) -> Column:
    """The entry of a list that belongs to the row's node."""
    return F.element_at(F.lit(values), F.col("node") + 1)


def _key(widest: list[int]) -> Column:
    """The coordinate along the node's widest dimension, ties behind it."""
    along = F.element_at(F.array(*DIMENSIONS), _of_node(widest) + 1)
    return along * (1 << 30) + F.col("tie")


def place_in_tree(points: DataFrame, shards: int, tolerance: int) -> DataFrame:
    """The points with `node`, the number of the leaf each lies in.

    A node is named by its first leaf; its cut leaves the bytes of half its leaves, rounded down, below.
    A bin of one row or at most `tolerance` bytes is not refined.
    """
    placed = points.withColumn("node", F.lit(0))
    open_nodes = {0: shards} if shards > 1 else {}
    while open_nodes:
        widest, prefixes = [0] * shards, [-1] * shards
        cuts, halves = [1 << KEY_BITS] * shards, [0] * shards
        want = {}
        spans = (
            placed.groupBy("node")
            .agg(F.sum("size").alias("bytes"), *[(F.max(d) - F.min(d)).alias(d) for d in DIMENSIONS])
            .collect()
        )
        for r in spans:
            k = r["node"]
            if k in open_nodes:
                widest[k] = max(range(len(DIMENSIONS)), key=lambda d: r[DIMENSIONS[d]])
                want[k] = r["bytes"] * (open_nodes[k] // 2) / open_nodes[k]
                prefixes[k] = 0
        shift = KEY_BITS - STEP_BITS
        while want and shift >= 0:
            bins: dict[int, list] = {k: [] for k in want}
            sums = (
                placed.select("node", _key(widest).alias("key"), _of_node(prefixes).alias("prefix"), "size")
                .where(F.shiftright("key", shift + STEP_BITS) == F.col("prefix"))
                .groupBy("node", F.shiftright("key", shift).alias("bin"))
                .agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
                .collect()
            )
            for r in sums:
                bins[r["node"]].append((r["bin"], r["bytes"], r["rows"]))
            for k in list(want):
                for b, size, rows in sorted(bins[k]):  # noqa: B007
                    if want[k] <= size:
                        break
                    want[k] -= size
                cuts[k] = (b if want[k] * 2 < size else b + 1) << shift
                prefixes[k] = b
                if size <= tolerance or rows == 1:
                    del want[k]
                    prefixes[k] = -1
            shift -= STEP_BITS
        below = {}
        for k, n in open_nodes.items():
            halves[k] = n // 2
            below |= {k: n // 2, k + n // 2: n - n // 2}
        open_nodes = {k: n for k, n in below.items() if n > 1}
        above = _key(widest) >= _of_node(cuts)
        placed = written(
            placed.withColumn("node", F.col("node") + F.when(above, _of_node(halves)).otherwise(0)), "shard-level"
        )
    return placed


def slots(rows: DataFrame, shard: str, order: list[str], per_bucket: int = SLOT_ROWS) -> DataFrame:
    """Adds `slot`, gapless from 0 within each shard, without a shard ever passing through one task.

    Rows are numbered inside hash buckets of about `per_bucket` rows; buckets are then lined up.
    """
    rows = rows.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(max(1, rows.count() // per_bucket))))
    counts = rows.groupBy(shard, "_bucket").agg(F.count("*").alias("_rows"))
    before = Window.partitionBy(shard).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(shard, "_bucket", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_first"))
    inside = Window.partitionBy(shard, "_bucket").orderBy(*order)
    return (
        rows.withColumn("_place", F.row_number().over(inside) - 1)
        .join(counts, [shard, "_bucket"])
        .withColumn("slot", (F.col("_first") + F.col("_place")).cast("long"))
        .drop("_bucket", "_place", "_first")
    )


def shard_documents(docs: DataFrame, shards: int = 40, piece: float = 0.005, tolerance: float = 0.0005) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) for every row; shards are numbered along the tree."""
    made = _points(docs, shards, piece)
    if made is None:
        return docs.select(
            "doc_id",
            F.lit(0).cast("long").alias("size"),
            F.lit(0).cast("long").alias("text_crc32"),
            F.lit(0).alias("shard"),
            F.lit(0).cast("long").alias("slot"),
        ).limit(0)
    points, total = made
    leaves = place_in_tree(points, shards, int(total["bytes"] / shards * tolerance))
    leaves = leaves.select("doc_id", "size", "text_crc32", F.col("node").cast("int").alias("shard"))
    return slots(leaves, "shard", ["doc_id", "text_crc32"])


def op2_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
