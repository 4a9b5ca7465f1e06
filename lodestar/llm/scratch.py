"""Tables that cut a plan's lineage, in the folder that the cluster shares.

The folder is the session's spark.checkpoint.dir. Where that is unset, a temporary
folder is made and set, once, but only on a local master, as in tests: on a cluster
other machines could not read it, so that is an error.
"""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


_SCOPES: list[list[tuple[DataFrame, str]]] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this application."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the whole cluster shares")
        base = f"file://{tempfile.mkdtemp(prefix='lodestar-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/lodestar-{spark.sparkContext.applicationId}"


def written(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Write `df` as a Parquet table in the shared folder and read it back.

    The files survive lost executors and go when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    fs, place = _file_system(spark, path)
    fs.deleteOnExit(place)
    table = spark.read.schema(df.schema).parquet(path)
    if _SCOPES:
        _SCOPES[-1].append((table, path))
    return table


def _file_system(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


@contextmanager
def scope() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables written within go at its end, but for those handed to the function it gives."""
    made: list[tuple[DataFrame, str]] = []
    kept: list[DataFrame] = []

    def keep(table: DataFrame) -> DataFrame:
        kept.append(table)
        return table

    _SCOPES.append(made)
    try:
        yield keep
    finally:
        _SCOPES.remove(made)
        for table, path in made:
            if not any(table is k for k in kept):
                fs, place = _file_system(table.sparkSession, path)
                fs.delete(place, True)
            elif _SCOPES:
                _SCOPES[-1].append((table, path))


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files go at the end of each query that runs within, where Spark knows how.

    For work in written steps, each of which reads tables and none another's shuffles.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    if before is not None:
        spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is not None:
            spark.conf.set(key, before)


def free(spark: SparkSession) -> None:
    """Let Spark's cleaner see which plans are gone, so that their shuffle files go now and not at the driver's next full collection."""
    gc.collect()
    spark._jvm.System.gc()
