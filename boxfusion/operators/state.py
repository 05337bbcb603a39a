"""Lineage cuts of iterative operators, and tables held on disk while they are read again."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def cut(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by a checkpoint in the folder that the cluster names in ``spark.checkpoint.dir``; where none
    is named, in one of this machine's own, but only if all runs on it."""
    spark, sc = df.sparkSession, df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="boxfusion-"))
    return df.checkpoint()


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder for ``name`` in the folder that the cluster shares for checkpoints; one of this machine's own only where
    all runs on it."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if shared is None and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{shared or tempfile.mkdtemp(prefix='boxfusion-')}/{name}-{uuid.uuid4().hex}"


#: Files of a query's shuffles go when the query ends, not when the driver next collects garbage.
SWEEP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def swept(spark: SparkSession) -> Iterator[None]:
    """Queries that run within leave no files of shuffles."""
    before = spark.conf.get(SWEEP)
    spark.conf.set(SWEEP, "true")
    try:
        yield
    finally:
        spark.conf.set(SWEEP, before)


def write(df: DataFrame, path: str, form: str = "parquet", **options: str) -> None:
    """Writes ``df`` at ``path``; the files of its shuffles are removed when it stands."""
    with swept(df.sparkSession):
        df.write.format(form).options(**options).save(path)


def hold(df: DataFrame, path: str, **options: str) -> DataFrame:
    """``df`` written at ``path`` and read again: less disk than a checkpoint, as columns are packed and files of shuffles
    do not stay."""
    write(df, path, compression="zstd", **options)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Removes a folder of Spark's own making, in whatever file system it is."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
