"""Equi-joins and top-k that hold up when one key owns a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEAST_PARTS, MOST_PARTS = 8, 64


def sub_key(cols: Sequence[str], parts: int) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(parts)).cast("int")


def key_parts(df: DataFrame) -> int:
    """Parts of a hot key: more where a shuffle has more partitions, within bounds, as lookups are copied."""
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return min(MOST_PARTS, max(LEAST_PARTS, partitions // 8))


def spread_join(
    wide: DataFrame,
    lookup: DataFrame,
    on: Sequence[str],
    spread_by: Sequence[str],
    how: str = "inner",
    parts: int | None = None,
) -> DataFrame:
    """Join `wide`, where one key may hold a third of the rows, to `lookup`.

    Every key of `wide` is parted by the hash of `spread_by` and `lookup` is copied once per
    part, so no task gets a whole hot key.  No broadcast is forced: Spark broadcasts `lookup`
    when its measured size is under the session's threshold and shuffles otherwise.
    """
    parts = parts or key_parts(wide)
    return wide.withColumn("_part", sub_key(spread_by, parts)).join(
        lookup.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))),
        [*on, "_part"],
        how,
    ).drop("_part")


def top_k(
    rows: DataFrame,
    by: Sequence[str],
    order: Sequence[Column],
    k: int | None,
    spread_by: Sequence[str],
    limit_col: str | None = None,
    rank_col: str = "rank",
) -> DataFrame:
    """Best rows of every group with their rank.

    With a fixed `k` Spark cuts every group to k rows before the shuffle.  A limit read from a
    column cannot be cut there, so groups are first cut in parts, then as a whole.
    """
    final = Window.partitionBy(*by).orderBy(*order)
    if limit_col is None:
        return rows.withColumn(rank_col, F.row_number().over(final)).filter(F.col(rank_col) <= k)
    in_part = Window.partitionBy(*by, "_part").orderBy(*order)
    return (
        rows.withColumn("_part", sub_key(spread_by, 64))
        .withColumn(rank_col, F.row_number().over(in_part))
        .filter(F.col(rank_col) <= F.col(limit_col))
        .drop("_part")
        .withColumn(rank_col, F.row_number().over(final))
        .filter(F.col(rank_col) <= F.col(limit_col))
    )
