"""Word patterns and the lineage cut that the text operators share."""

from __future__ import annotations

import os
import tempfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that part words: blank, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = " \t\n\x0b\x0c\r"
GAP = r"[\x20\x09-\x0D]+"
LOWER = "abcdefghijklmnopqrstuvwxyz"

#: Rows of an Arrow batch that goes to Python; a batch of very long texts must fit a worker.
BATCH_ROWS = 512


def shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints: the one that the cluster names in ``spark.checkpoint.dir``; where
    none is named, as in tests, one of its own on this machine, but only if all runs on it."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    return sc.getCheckpointDir()


def remove_folder(spark: SparkSession, path: str) -> None:
    """Removes a folder of Spark's own making, in whatever file system it is."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def without(docs: DataFrame, gone: DataFrame, id_col: str, most_sent: int = 1_000_000) -> DataFrame:
    """``docs`` without those whose id, as a long, is in ``gone`` (one column, distinct); rows without an id stay.

    Up to ``most_sent`` ids go to every task, so that texts are not shuffled; beyond, both meet by id."""
    gone = cut(gone.toDF("__gone__"))
    if gone.limit(most_sent + 1).count() <= most_sent:
        gone = F.broadcast(gone)
    return docs.join(gone, F.col(f"`{id_col}`").cast("long") == F.col("__gone__"), "left_anti")


def refuse_reserved(df: DataFrame) -> None:
    """Column names in double underscores are the operators' own."""
    if taken := [c for c in df.columns if c.startswith("__") and c.endswith("__")]:
        raise ValueError(f"columns of reserved names: {', '.join(taken)}")


def cut(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by a checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def arrow_rows(spark: SparkSession) -> None:
    """Bounds Arrow batches by rows, so that what Python holds follows from the longest texts, and
    lets Python workers on this machine import this package from where the driver has it."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    env, root = spark.sparkContext.environment, str(Path(__file__).resolve().parents[2])
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [env.get("PYTHONPATH", ""), root]))


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is evaluated once even if ``body`` names it inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def before_each(values: Column, fold) -> Column:
    """For each of an array of ints what ``fold`` (of two Columns, from 0) makes of those before it."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(values, zero, lambda acc, x: F.struct(fold(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])


def stripped(text: Column) -> Column:
    """``text`` without blanks at its ends; null gives ''."""
    return F.trim(F.coalesce(text, F.lit("")), F.lit(BLANKS))


def words(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of ``text``; none if it is null."""
    return let(stripped(text), lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, GAP)))


def count_words(text: Column) -> Column:
    t = stripped(text)
    return F.when(t == "", F.lit(0)).otherwise(F.size(F.split(t, GAP))).cast("long")
