"""Tables written to the folder all executors share, to cut lineage between steps of a job."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession

_CHECKPOINT_DIR = "spark.checkpoint.dir"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
COMPACT = "zstd"  # what stored tables and large steps are compressed with: a third less than Spark's own choice for texts
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers of the session, once, so that they need no installation."""
    application = spark.sparkContext.applicationId
    if application in _SHIPPED:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    name = os.path.basename(package)
    archive = os.path.join(tempfile.mkdtemp(prefix=f"{name}-"), f"{name}.zip")
    with zipfile.ZipFile(archive, "w") as files:
        for folder, _, found in os.walk(package):
            for file in found:
                if file.endswith(".py"):
                    path = os.path.join(folder, file)
                    files.write(path, os.path.join(name, os.path.relpath(path, package)))
    spark.sparkContext.addPyFile(archive)
    _SHIPPED.add(application)


def shared_folder(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; a temporary folder only for local sessions without one."""
    folder = spark.conf.get(_CHECKPOINT_DIR, None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"set {_CHECKPOINT_DIR} to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="shelfmark-")
        spark.conf.set(_CHECKPOINT_DIR, folder)
    return f"{folder.rstrip('/')}/shelfmark/{spark.sparkContext.applicationId}"


def materialise(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write a step's result once and go on from the files."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def brief_shuffles(spark: SparkSession) -> Iterator[None]:
    """Inside, the shuffle files of a query go as soon as it has ended; made for queries that are run once."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


@contextlib.contextmanager
def steps(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Gives a function that writes a step's result, as `materialise` does; all of them are removed at the end.

    What goes on after the end must not read them.
    """
    folder = f"steps-{uuid.uuid4().hex}"

    def step(df: DataFrame, name: str) -> DataFrame:
        with brief_shuffles(spark):
            # Made anew here, so that its query sees the setting.
            return materialise(df.select("*"), f"{folder}/{name}", COMPACT)

    try:
        yield step
    finally:
        remove_folder(spark, f"{shared_folder(spark)}/{folder}")


def move_folders(spark: SparkSession, source: str, target: str) -> None:
    """Put the folders in `source` in place of those of the same names in `target`; goes on with what a broken call left."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(source).getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(path(target))
    for found in files.listStatus(path(source)):
        if found.isDirectory():
            to = path(target, found.getPath().getName())
            files.delete(to, True)
            if not files.rename(found.getPath(), to):
                raise OSError(f"{found.getPath()} could not be moved to {to}")


def remove_folder(spark: SparkSession, path: str) -> None:
    """Remove a folder that a run of this library wrote for its own use."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def spread_input(df: DataFrame, key: str) -> DataFrame:
    """Spread a scan with fewer splits than cores, as of one small file, before costly work.

    Inputs of many splits pass unchanged, so no large table is shuffled for it.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df
