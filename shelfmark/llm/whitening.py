"""Whitening of vectors by their principal components, on MLlib's distributed block matrices.

A vector's entry c counts as x = floor(64 c) + 1000000.  Rows are numbered without gaps and centred exactly,
(n x - S) / n with whole numbers above the line, then stored as an IndexedRowMatrix and cut into blocks of
BLOCK rows.  Transposed blocks times blocks give the scatter matrix; the middle dimension is split over many
tasks, whose partial products are summed on the map side.  Its eigenvectors are worked out on the driver, as the
matrix is as large as a vector is long, whatever the number of rows.  A second block product projects the rows.

Vectors that are null or hold null, NaN or infinite entries are dropped, and so are vectors of another length than most
(the longer, of lengths equally frequent) and empty ones.  Entries beyond 2**31 / 64 count as that.  Components without
variance beyond rounding have null for `whitened` and do not count in `identity_error`.  Every row with a valid
vector counts, rows that share a vec_id or hold none too.  `deviation` is exact; beyond 64 bits it is null.  An empty
table gives an empty result; extra columns do no harm.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written
from .numbering import numbered

SCALE, SHIFT, LARGEST = 64, 1_000_000, 1 << 31
COMPONENTS = 32
BLOCK = 2048


@dataclass(frozen=True)
class Whitening:
    """Number of vectors, sums per dimension, eigenvalues and eigenvectors (by columns) of the covariance."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray

    def usable(self) -> np.ndarray:
        """Which components vary beyond rounding."""
        return self.values > self.values.max(initial=0.0) * len(self.values) * np.finfo(float).eps


def whole_vectors(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """The rows with a valid vector, which is given as long numbers in `__x`."""
    sound = F.forall(
        column, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) != float("inf"))
    )
    rows = vectors.where(F.col(column).isNotNull() & (F.size(column) > 0) & sound)
    lengths = rows.groupBy(F.size(column).alias("d")).agg(F.count("*").alias("n"))
    length = lengths.agg(F.max(F.struct("n", "d"))["d"]).scalar()

    def whole(c):
        scaled = F.floor(c.cast("double") * SCALE)
        return F.least(F.greatest(scaled, F.lit(-LARGEST)), F.lit(LARGEST)) + F.lit(SHIFT).cast("long")

    return rows.where(F.size(column) == length).withColumn("__x", F.transform(column, whole))


def _blocks(rows: DataFrame, n: int, dim: int, column) -> BlockMatrix:
    """Rows (row, array of doubles) as blocks of a matrix, kept on the executors' disks, as each product reads them often."""
    features = rows.select(F.col("row").cast("long").alias("index"), array_to_vector(column).alias("vector"))
    matrix = IndexedRowMatrix(MLUtils.convertVectorColumnsFromML(features, "vector"), n, dim)
    return matrix.toBlockMatrix(BLOCK, BLOCK).persist(StorageLevel.DISK_ONLY)


def _product(a: BlockMatrix, b: BlockMatrix, splits: int = 1) -> BlockMatrix:
    """a b, the middle dimension split over tasks, for which the Python class has no argument."""
    product = a._java_matrix_wrapper.call("multiply", b._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(product, a.rowsPerBlock, b.colsPerBlock)


def _scatter(blocks: BlockMatrix) -> np.ndarray:
    """The blocks' transpose times themselves, as large as a row is long."""
    rows_of_blocks = -(-blocks.numRows() // BLOCK)
    return _product(blocks.transpose(), blocks, max(1, min(rows_of_blocks, 256))).toLocalMatrix().toArray()


def _as_blocks(spark: SparkSession, matrix: np.ndarray) -> BlockMatrix:
    parts = [
        ((i // BLOCK, j // BLOCK), DenseMatrix(*part.shape, part.ravel(order="F")))
        for i in range(0, matrix.shape[0], BLOCK)
        for j in range(0, matrix.shape[1], BLOCK)
        for part in [matrix[i : i + BLOCK, j : j + BLOCK]]
    ]
    return BlockMatrix(spark.sparkContext.parallelize(parts, 1), BLOCK, BLOCK, *matrix.shape)


def _difference(n: int, sums: list[int]):
    """n x - S of a row, exact."""
    return F.zip_with("__x", F.array(*[F.lit(s).cast("long") for s in sums]), lambda x, s: F.lit(n).cast("long") * x - s)


def sums_of(rows: DataFrame) -> tuple[int, list[int]]:
    """Number of rows (row, __x) and their sums per dimension."""
    cells = rows.select(F.posexplode("__x").alias("pos", "x"))
    sums = cells.groupBy("pos").agg(F.sum("x").alias("s"), F.count("*").alias("n")).orderBy("pos").collect()
    return (sums[0]["n"] if sums else 0), [r["s"] for r in sums]


def centred_blocks(rows: DataFrame, n: int, sums: list[int]) -> BlockMatrix:
    """Rows (row, __x), numbered without gaps, less their mean."""
    return _blocks(rows, n, len(sums), F.transform(_difference(n, sums), lambda v: v.cast("double") / n))


def fit(blocks: BlockMatrix, n: int, sums: list[int]) -> Whitening:
    """The components of the centred rows' covariance."""
    covariance = _scatter(blocks) / n
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    return Whitening(n, sums, np.maximum(values[::-1], 0.0), vectors[:, ::-1])


def project(spark: SparkSession, blocks: BlockMatrix, model: Whitening, components: int) -> DataFrame:
    """(row, whitened): the rows on the first components, each over its deviation; 0 for components without any."""
    k = min(components, len(model.values))
    usable = model.usable()[:k]
    scale = np.where(usable, 1 / np.sqrt(np.where(usable, model.values[:k], 1.0)), 0.0)
    projected = _product(blocks, _as_blocks(spark, model.vectors[:, :k] * scale)).toIndexedRowMatrix()
    # The matrix's rows as a table of the JVM; its own `rows` would pass through Python.
    found = callMLlibFunc("getIndexedRows", projected._java_matrix_wrapper._java_model)
    return found.select(F.col("index").alias("row"), vector_to_array("vector").alias("whitened"))


def identity_error(projected: DataFrame, model: Whitening, components: int) -> float:
    """Largest entry by which the covariance of the projected rows departs from the identity."""
    k = min(components, len(model.values))
    cells = projected.select(F.posexplode("whitened").alias("pos", "x"))
    means = [r["m"] for r in cells.groupBy("pos").agg(F.avg("x").alias("m")).orderBy("pos").collect()]
    centred = F.zip_with("whitened", F.array(*[F.lit(float(m)) for m in means]), lambda x, m: x - m)
    covariance = _scatter(_blocks(projected, model.n, k, centred)) / model.n
    use = model.usable()[:k]
    return float(np.abs(covariance - np.eye(k))[np.ix_(use, use)].max(initial=0.0))


def _deviation(rows: DataFrame, model: Whitening):
    """Sum over dimensions of (n x - S) squared, in whole numbers: longs where no row can exceed them."""
    ends = rows.select(F.posexplode("__x").alias("pos", "x")).groupBy("pos").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    most = sum(
        max(abs(model.n * v - model.sums[r["pos"]]) for v in (r["lo"], r["hi"])) ** 2 for r in ends.collect()
    )
    if most < 2**63:
        return F.aggregate(_difference(model.n, model.sums), F.lit(0).cast("long"), lambda a, v: a + v * v)
    total = F.aggregate(
        _difference(model.n, model.sums), F.lit(0).cast("decimal(38,0)"),
        lambda a, v: (a + v.cast("decimal(19,0)") * v.cast("decimal(19,0)")).cast("decimal(38,0)"),
    )
    return F.when(total < F.lit(str(2**63)).cast("decimal(38,0)"), total).try_cast("long")


def whiten(vectors: DataFrame, column: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """Rows of `vectors` with component, n, deviation, whitened, explained and identity_error."""
    names = [c for c in vectors.columns if c != column]
    sound = written(whole_vectors(vectors, column).select(F.struct(*[f"`{c}`" for c in names]).alias("__own"), "__x"), "vectors")
    rows = written(numbered(sound, "row"), "vector-rows")
    n, sums = sums_of(rows)
    if not n:
        given = "component int, n long, deviation long, whitened double, explained double, identity_error double"
        empty = vectors.select(*names).limit(0)
        return empty.select("*", *[F.lit(None).cast(kind).alias(c) for c, kind in (g.split() for g in given.split(", "))])
    blocks = centred_blocks(rows, n, sums)
    model = fit(blocks, n, sums)
    projected = written(project(vectors.sparkSession, blocks, model, components), "projected")
    error = identity_error(projected, model, components)
    k, trace = min(components, len(model.values)), float(model.values.sum())
    explained = F.array(*[F.lit(float(v / trace) if trace else 0.0) for v in model.values[:k]])
    usable = F.array(*[F.lit(bool(u)) for u in model.usable()[:k]])
    kept = rows.select("row", "__own", _deviation(rows, model).alias("deviation"))
    return (
        kept.join(projected, "row")
        .select("__own", "deviation", F.posexplode("whitened").alias("__pos", "__value"))
        .select(
            "__own.*", (F.col("__pos") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation",
            F.when(F.get(usable, F.col("__pos")), F.col("__value")).alias("whitened"),
            F.get(explained, F.col("__pos")).alias("explained"), F.lit(error).alias("identity_error"),
        )
    )


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
