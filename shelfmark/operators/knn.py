"""Exact cosine k-nearest-neighbour search, many queries per job.

A query batch of checked size is sent to every task and the vectors are scanned once, each task
keeping k rows per query.  A larger batch is parted, and cells of (part of the queries, part of
the vectors), all of bounded size, are computed apart.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .joins import spread_join, top_k

# Scores are ranked to RANK_DIGITS and given to SCORE_DIGITS.
SCORE_DIGITS, RANK_DIGITS = 6, 12
# Float values of a query batch that one task may hold (32 MB), and vectors of a cell.
MAX_QUERY_VALUES = 8_000_000
CELL_VALUES = 16_000_000
_BLOCK = 4096


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    """Rows scaled to length 1; a zero vector stays zero and so scores 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    rows = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(norms == 0, 1.0, norms)


def _ids(column) -> np.ndarray:
    values = column.to_numpy(zero_copy_only=False) if isinstance(column, pa.Array) else column.to_numpy()
    return values.astype(str) if values.dtype == object else values


class _Best:
    """The best (score, id) per query so far, as many as it asks for; equal scores go to the lower id."""

    def __init__(self, queries: pa.Table, dim: int, with_group: bool):
        self.qids = queries["qid"]
        self.matrix = _matrix(queries["embedding"], dim)
        self.most = queries["most"].to_numpy()
        self.groups: dict = {None: np.arange(len(self.matrix))}
        if with_group:
            names = _ids(queries["part"])
            self.groups = {g: np.flatnonzero(names == g) for g in np.unique(names)}
        self.with_group = with_group
        self.scores = [np.empty(0)] * len(self.matrix)
        self.ids: list = [None] * len(self.matrix)
        self.dim = dim

    def add(self, vectors) -> None:
        for start in range(0, vectors.num_rows, _BLOCK):
            self._add_block(vectors.slice(start, _BLOCK))

    def _add_block(self, vectors) -> None:
        ids, matrix = _ids(vectors["id"]), _matrix(vectors["embedding"], self.dim)
        if not self.with_group:
            self._add_rows(self.groups[None], ids, matrix)
            return
        # Each topic's queries are multiplied with the rows of that topic only.
        names = _ids(vectors["part"])
        order = np.argsort(names, kind="stable")
        borders = np.flatnonzero(np.append(True, names[order][1:] != names[order][:-1]))
        for rows in np.split(order, borders[1:]):
            asked = self.groups.get(names[rows[0]])
            if asked is not None:
                self._add_rows(asked, ids[rows], matrix[rows])

    def _add_rows(self, asked: np.ndarray, ids: np.ndarray, matrix: np.ndarray) -> None:
        products = np.round(self.matrix[asked] @ matrix.T, RANK_DIGITS)
        for q, scores in zip(asked.tolist(), products, strict=True):
            mine, k = ids, int(self.most[q])
            full = len(self.scores[q]) >= k
            if not len(scores) or (full and scores.max() < self.scores[q][-1]):
                continue
            if len(scores) > k:
                keep = scores >= np.partition(scores, -k)[-k]
                scores, mine = scores[keep], mine[keep]
            if self.ids[q] is not None:
                scores = np.concatenate([self.scores[q], scores])
                mine = np.concatenate([self.ids[q], mine])
            order = np.lexsort((mine, -scores))[:k]
            self.scores[q], self.ids[q] = scores[order], mine[order]

    def rows(self, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        held = [q for q, ids in enumerate(self.ids) if ids is not None]
        if not held:
            return
        take = np.repeat(held, [len(self.ids[q]) for q in held])
        yield from pa.table(
            [
                self.qids.take(pa.array(take)).cast(schema.field("qid").type),
                pa.array(np.concatenate([self.ids[q] for q in held])).cast(schema.field("id").type),
                pa.array(np.concatenate([self.scores[q] for q in held])),
            ],
            schema=schema,
        ).to_batches()


def _arrow_schema(result: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(result)


def vector_dim(vectors: DataFrame) -> int | None:
    """Dimension of most of the stored vectors; of equally frequent ones the larger."""
    sizes = vectors.select(F.size("embedding").alias("n")).filter("n > 0").groupBy("n").count()
    first = sizes.orderBy(F.desc("count"), F.desc("n")).first()
    return first["n"] if first else None


def check_dim(vectors: DataFrame, dim: int) -> tuple[DataFrame, DataFrame]:
    """Vectors of the wanted dimension with finite numbers only, and rejected ones."""
    odd = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    fits = F.coalesce((F.size("embedding") == dim) & ~odd, F.lit(False))
    return vectors.filter(fits), vectors.filter(~fits)


def knn(
    queries: DataFrame,
    vectors: DataFrame,
    k: int = 10,
    part: str | None = None,
    dim: int | None = None,
    max_query_values: int = MAX_QUERY_VALUES,
    cell_values: int = CELL_VALUES,
    limit_col: str | None = None,
) -> DataFrame:
    """Nearest rows of `vectors` (id, embedding) for each of `queries` (qid, embedding).

    `k` rows a query, or as many as its `limit_col` says.  With `part`, a column of both (a topic or
    category), a query is matched with rows of its own part only, before the best are taken.  Of queries
    with the same qid one counts.  Rows and queries that `check_dim` rejects take no part; without `dim`
    the most frequent dimension counts.  Returns qid, id, score, rank; scores equal to 12 digits are
    ties, which go to the lower id.
    """
    dim = dim or vector_dim(vectors)
    result = T.StructType(
        [
            T.StructField("qid", queries.schema["qid"].dataType),
            T.StructField("id", vectors.schema["id"].dataType),
            T.StructField("score", T.DoubleType()),
        ]
    )
    if dim is None:
        return vectors.sparkSession.createDataFrame([], result.add("rank", "integer"))
    grouped = part is not None
    extra = [F.col(part).alias("part")] if grouped else []
    most = F.col(limit_col).cast("int") if limit_col else F.lit(k)
    asked = check_dim(queries, dim)[0].dropDuplicates(["qid"]).select("qid", "embedding", most.alias("most"), *extra)
    scanned = check_dim(vectors, dim)[0].select("id", "embedding", *extra)
    arrow = _arrow_schema(result)

    at_once = max(1, max_query_values // dim)
    batch = asked.limit(at_once + 1).toArrow()
    if batch.num_rows <= at_once:
        if not batch.num_rows:
            return vectors.sparkSession.createDataFrame([], result.add("rank", "integer"))
        if grouped:
            names = pc.unique(batch["part"]).to_pylist()
            if len(names) <= 1000:
                scanned = scanned.filter(F.col("part").isin(names))
        shared = scanned.sparkSession.sparkContext.broadcast(batch)

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = _Best(shared.value, dim, grouped)
            for vectors in batches:
                best.add(vectors)
            yield from best.rows(arrow)

        local = scanned.mapInArrow(scan, result)
    else:
        local = _by_cells(asked, scanned, dim, grouped, result, at_once, max(1, cell_values // dim))
    order = [F.col("score").desc(), F.col("id")]
    if limit_col is None:
        best = top_k(local, ["qid"], order, k, ["id"])
    else:
        best = top_k(local.join(asked.select("qid", "most"), "qid"), ["qid"], order, None, ["id"], limit_col="most")
    return best.select("qid", "id", F.round("score", SCORE_DIGITS).alias("score"), "rank")


def _by_cells(asked, scanned, dim, grouped, result, cell_queries, cell_vectors) -> DataFrame:
    """Grid of query parts and vector parts; ids are unique, so their hash fills parts evenly."""
    across = math.ceil(asked.count() / cell_queries * 1.2)
    down = math.ceil(scanned.count() / cell_vectors * 1.2) or 1

    def copies(df: DataFrame, key: str, own: str, own_parts: int, other: str, parts: int):
        return df.withColumn(own, F.pmod(F.xxhash64(key), F.lit(own_parts)).cast("int")).withColumn(
            other, F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
        )

    arrow = _arrow_schema(result)

    def cell(queries: pa.Table, vectors: pa.Table) -> pa.Table:
        best = _Best(queries, dim, grouped)
        best.add(vectors)
        return pa.Table.from_batches(best.rows(arrow), schema=arrow)

    left = copies(asked, "qid", "x", across, "y", down).groupBy("x", "y")
    right = copies(scanned, "id", "y", down, "x", across).groupBy("x", "y")
    return left.cogroup(right).applyInArrow(cell, result)


def with_payload(hits: DataFrame, vectors: DataFrame) -> DataFrame:
    """Put the payload beside the k best; only after ranking, so wide rows move for hits alone."""
    return hits.join(vectors.select("id", "payload"), "id")


def scroll_topic(vectors: DataFrame, topics: DataFrame, k: int, part: str = "topic") -> DataFrame:
    """First k rows by id of every asked topic, each with score 1."""
    rows = spread_join(vectors, topics.select(part).distinct(), [part], ["id"], "left_semi")
    return top_k(rows, [part], [F.col("id")], k, ["id"]).withColumn("score", F.lit(1.0))
