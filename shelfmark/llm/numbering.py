"""Numbers for rows without a window over all of them or over a hot group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

_SEGMENT = 33  # monotonically_increasing_id() holds the partition above these bits


def numbered(df: DataFrame, name: str, order: Sequence[str] = (), by: Sequence[str] = ()) -> DataFrame:
    """The rows with `name`: 0, 1, 2, ... within each group of `by`, ascending by `order`, nulls first.

    Rows are dealt out by ranges of (by, order), so that a hot group is many tasks' work, and written with
    their place in their task; a table with one row per task and group tells where each task's rows of a
    group begin.  `by` holds no nulls.  Rows equal in `by` and `order` are numbered in any way, once.
    Without `order` rows keep the parts they come in.
    """
    keys = [*by, *order]
    if keys:
        df = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    at, segment, first = f"__{name}_at", f"__{name}_segment", f"__{name}_first"
    rows = written(df.withColumn(at, F.monotonically_increasing_id()), "numbered")
    rows = rows.withColumn(segment, F.shiftrightunsigned(at, _SEGMENT))
    parts = rows.groupBy(*by, segment).agg(F.min(at).alias(first), F.count("*").alias("__n"))
    earlier = Window.partitionBy(*by).orderBy(segment).rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("__n").over(earlier), F.lit(0)) - F.col(first)
    starts = parts.select(*by, segment, start.alias("__start"))
    return rows.join(starts, [*by, segment]).withColumn(name, F.col(at) + F.col("__start")).drop(at, segment, "__start")
