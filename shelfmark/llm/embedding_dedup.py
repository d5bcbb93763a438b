"""Near-duplicate vectors by p-stable hashing, checked by exact cosines.

A vector is scaled to length one and projected on `PROJECTIONS` Gaussian directions per table; shifted and
cut into steps of `WIDTH`, the projections name its bucket.  Vectors at cosine 0.98 are 0.2 apart; with
width 1.2 a projection keeps them together with probability 0.87, a table of 6 with 0.42, one of the 8
tables with 0.988; at larger cosines more.  Only vectors of equal label share buckets.

Equal vectors of a label are one class, counted, never paired.  A bucket of more than `BLOCK` classes is
compared in cells of two blocks, so no task holds more than two blocks at once.  Cells give link counts
and, of the links, a forest; a pair found in several tables counts in the first.

Null labels, vectors that are null, empty or zero or hold null or non-finite components, and null vec_ids
link with nothing; different lengths never link.  Rows that share a vec_id keep a row each; other rows count
them by row.  An empty table gives an empty result; extra columns do no harm.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forest, grouped, mix, table, written
from .components import components

TABLES, PROJECTIONS, WIDTH = 8, 6, 1.2
BLOCK = 1024
SEED = 20


def _matrix(column) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(lengths), -1) if len(lengths) else np.zeros((0, 0))


def _buckets(vectors: np.ndarray, labels: np.ndarray, tables: int, projections: int, width: float) -> np.ndarray:
    """Bucket numbers of vectors of one dimension, a column per table."""
    dim = vectors.shape[1]
    random = np.random.default_rng([SEED, dim])
    directions = random.standard_normal((dim, tables * projections))
    shifts = random.uniform(0, width, tables * projections)
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    steps = np.floor((unit @ directions + shifts) / width).astype(np.int64).view(np.uint64)
    out = np.empty((len(vectors), tables), dtype=np.uint64)
    for t in range(tables):
        key = mix(labels.astype(np.int64).view(np.uint64) + np.uint64((t + 1) * 1_000_003 + dim * 7919))
        for p in range(projections):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + steps[:, t * projections + p])
        out[:, t] = key
    return out.view(np.int64)


def _classes(vectors: DataFrame) -> DataFrame:
    """(label, vector, id, n): the usable distinct vectors with their smallest vec_id and number of rows."""
    unusable = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = (
        vectors.select("vec_id", F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("vector"))
        .where("vec_id is not null and label is not null and vector is not null")
        .where(~unusable & F.exists("vector", lambda x: x != 0))
    )
    return usable.groupBy("label", "vector").agg(F.min("vec_id").alias("id"), F.count("*").alias("n"))


def _hashed(classes: DataFrame, tables: int, projections: int, width: float) -> DataFrame:
    def run(batches):
        for batch in batches:
            lengths = np.asarray(pc.list_value_length(batch["vector"]))
            labels = batch["label"].to_numpy(zero_copy_only=False)
            found = np.zeros((len(lengths), tables), dtype=np.int64)
            for dim in np.unique(lengths):
                rows = np.flatnonzero(lengths == dim)
                found[rows] = _buckets(_matrix(batch["vector"].take(pa.array(rows))), labels[rows], tables, projections, width)
            offsets = pa.array(np.arange(len(lengths) + 1, dtype=np.int32) * tables)
            lists = pa.ListArray.from_arrays(offsets, pa.array(found.ravel()))
            yield pa.RecordBatch.from_arrays(
                [batch["id"], batch["n"], batch["vector"], lists], names=["id", "n", "vector", "buckets"]
            )

    return classes.select("id", "n", "label", "vector").mapInArrow(run, "id long, n long, vector array<double>, buckets array<long>")


def _cell(cell: pa.Table, least: float):
    """Links within one cell: per class the rows it links with, and edges."""
    ids, n = (cell[c].to_numpy() for c in ("id", "n"))
    t = cell["table"][0].as_py()
    x = _matrix(cell["vector"])
    norms = np.sqrt((x * x).sum(axis=1))
    cosine = (x @ x.T) / (norms[:, None] * norms[None, :])
    side = cell["side"].to_numpy()
    one_block = cell["i"][0].as_py() == cell["j"][0].as_py()
    p, q = np.nonzero(np.triu(cosine >= least, 1))
    if not one_block:
        across = side[p] != side[q]
        p, q = p[across], q[across]
    if t and len(p):
        buckets = _matrix(cell["buckets"])[:, :t]
        first = ~(buckets[p] == buckets[q]).any(axis=1)
        p, q = p[first], q[first]
    if not len(p):
        return None
    linked = np.bincount(p, weights=n[q], minlength=len(ids)) + np.bincount(q, weights=n[p], minlength=len(ids))
    touched = np.flatnonzero(linked)
    root, leaf = forest(len(ids), p, q)
    return (
        np.concatenate([ids[touched], ids[leaf]]),
        np.concatenate([np.full(len(touched), -1), ids[root]]),
        np.concatenate([linked[touched].astype(np.int64), np.zeros(len(leaf), np.int64)]),
        np.concatenate([np.ones(len(touched), bool), np.zeros(len(leaf), bool)]),
    )


def _links(cells: DataFrame, least: float) -> DataFrame:
    """(a, b, n, counted): link counts of a, or an edge from a to b; cells come one after the other."""

    def run(batches):
        for cell in grouped(batches, ("bucket", "i", "j")):
            found = _cell(cell, least) if cell.num_rows > 1 else None
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], names=["a", "b", "n", "counted"])

    return cells.mapInArrow(run, "a long, b long, n long, counted boolean")


def near_vectors(
    vectors: DataFrame, least: float = 0.98, tables: int = TABLES, projections: int = PROJECTIONS,
    width: float = WIDTH, block: int = BLOCK,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row."""
    classes = written(_classes(vectors), "vector-classes")
    hashed = written(_hashed(classes, tables, projections, width), "vector-buckets")
    places = hashed.select("id", F.posexplode("buckets").alias("table", "bucket"))
    sizes = places.groupBy("bucket").agg(F.count("*").alias("m")).where("m > 1")
    sizes = sizes.select("bucket", F.ceil(F.col("m") / block).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    member = places.join(sizes, "bucket").withColumn("own", own)
    # A class goes to the cells of its block with every block; the smaller block comes first.
    cells = member.select("id", "table", "bucket", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    cells = cells.select(
        "id", "table", "bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
        (F.col("own") <= F.col("other")).alias("side"),
    )
    cells = cells.join(hashed, "id").repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    found = written(_links(cells, least), "vector-links")
    counts = found.where("counted").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("linked"))
    component = components(found.where("not counted"))
    per_class = written(
        classes.join(counts, "id", "left").join(component, "id", "left").select(
            "label", "vector",
            (F.coalesce("linked", F.lit(0)) + F.col("n") - 1).alias("n_links"),
            F.coalesce("component", "id").alias("component_id"),
        ),
        "vector-results",
    )
    # Rows of equal vectors meet their class by label and a hash first, so a hot class can be split by Spark.
    keyed = vectors.select(
        "vec_id", F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("vector")
    )
    found = keyed.join(per_class, ["label", "vector"], "left")
    usable = F.col("vec_id").isNotNull() & F.col("component_id").isNotNull()
    own_id = F.when(usable, F.col("component_id")).otherwise(F.col("vec_id"))
    return found.select(
        "vec_id",
        F.when(usable, F.col("n_links")).otherwise(0).cast("long").alias("n_links"),
        own_id.cast("long").alias("component_id"),
        F.coalesce(F.col("vec_id") == own_id, F.lit(True)).alias("kept"),
    )


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
