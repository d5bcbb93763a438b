"""Incremental ingest: new inbox files, read as a stream, come to the same rows as one batch run over them.

Which file of a url is stored depends on the order of paths, and files arrive in any order.  The stream therefore
only lands new files, in micro-batches of bounded size; when it has caught up, all landed files that are not settled yet
are ingested together.  So neither the size nor the borders of micro-batches choose a url's file.

Spark's file sources pass over folders with hidden names; each of those is a stream of its own beside the root's.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.embed import DEFAULT_DIM
from ..operators.ingest import HELD, NO_VECTOR
from ..plans.jobs import ingest_sources
from ..plans.shared import materialise
from ..plans.store import Store
from ..schemas import DOCUMENT
from ..sources.scan import _MARKDOWN, _root_uri, as_documents, hidden_folders, path_exists

_LANDED = "path string, rel_path string, content string, stream string, batch long"
_OUTCOMES = "path string, outcome string, reason string, existing_id string, stream string, batch long, run int"


def read_inbox_stream(spark: SparkSession, root: str, folder: str | None = None, files_per_batch: int = 100_000) -> DataFrame:
    """New markdown files as (path, rel_path, content) below `root`, or in one of its folders with a hidden name."""
    files = (
        spark.readStream.schema("value string")
        .option("wholetext", True)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", _MARKDOWN)
        .option("maxFilesPerTrigger", files_per_batch)
        .format("text")
        .load(folder or root)
    )
    return as_documents(files, _root_uri(spark, root))


def _table(store: Store, name: str, schema: str) -> DataFrame:
    path = f"{store.root}/inbox_{name}"
    if not path_exists(store.spark, path):
        return store.spark.createDataFrame([], schema)
    return store.spark.read.schema(schema).parquet(path)


def inbox_outcomes(store: Store) -> DataFrame:
    """(path, outcome, reason, existing_id, stream, batch, run) of every file of every run."""
    return _table(store, "outcomes", _OUTCOMES)


def open_files(store: Store) -> DataFrame:
    """Landed files, of each path the last version, that have no final outcome."""
    landed = _table(store, "landed", _LANDED)
    settled = inbox_outcomes(store).filter(~F.col("reason").isin(NO_VECTOR, HELD)).select("path", "stream", "batch")
    last = landed.groupBy("path", "stream").agg(F.max("batch").alias("batch"))
    return landed.join(last.join(settled, ["path", "stream", "batch"], "left_anti"), ["path", "stream", "batch"], "left_semi")


def land(store: Store, root: str, checkpoint: str, files_per_batch: int = 100_000) -> None:
    """Copy what is new in the inbox to the store; a micro-batch that is done again replaces its own rows."""
    spark = store.spark
    if not path_exists(spark, root):
        return
    for folder in [None, *hidden_folders(spark, root)]:
        key = hashlib.md5((folder or "").encode()).hexdigest()

        def write(batch: DataFrame, number: int, key: str = key) -> None:
            rows = batch.select(*DOCUMENT.names, F.lit(key).alias("stream"), F.lit(number).alias("batch"))
            writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            writer.partitionBy("stream", "batch").parquet(f"{store.root}/inbox_landed")

        query = (
            read_inbox_stream(spark, root, folder, files_per_batch)
            .writeStream.foreachBatch(write)
            .option("checkpointLocation", f"{checkpoint.rstrip('/')}/{key}")
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()


def ingest_sources_stream(
    store: Store,
    root: str,
    checkpoint: str,
    model=None,
    dim: int = DEFAULT_DIM,
    now: str | None = None,
    files_per_batch: int = 100_000,
) -> DataFrame:
    """Land what is new in the inbox and ingest it with the files still open; returns this run's outcomes.

    The checkpoint remembers the files read, the store those that are not settled.  A run that breaks off is made good by
    the next: files it stored are known by then.
    """
    land(store, root, checkpoint, files_per_batch)
    docs = materialise(open_files(store), "inbox")
    run = 1 + (inbox_outcomes(store).agg(F.max("run")).first()[0] or 0)
    outcomes = ingest_sources(store, docs.select(*DOCUMENT.names), model, dim, now)
    found = materialise(
        outcomes.join(docs.select("path", "stream", "batch"), "path").withColumn("run", F.lit(run)), "inbox-outcomes"
    )
    found.write.mode("append").parquet(f"{store.root}/inbox_outcomes")
    return found
