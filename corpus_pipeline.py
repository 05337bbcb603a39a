"""The corpus pipeline: stages over documents, each written as Parquet and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxfusion.llm import decontaminate, mixing, pii, quality_rules, simhash
from boxfusion.llm.common import remove_folder, shared_folder


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that fail go; documents that the rules reject go, among them null, empty and blank texts."""
    return quality_rules.clean(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that of the least id."""
    return simhash.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold half of a benchmark item's template windows, or 13 tokens of it on end, go."""
    return decontaminate.remove(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data give way to their kind."""
    out = pii.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with size, taken and copies."""
    return mixing.mixture(docs)


STAGES = [("quality_rules", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("pii", personal_data), ("mixing", mix_sources)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that are left of documents.  Each stage's result is written in the shared folder, and removed when the
    next one stands; the last one written stays for the result to be read from.

    Null, empty and blank texts go in the first stage; rows without an id stay throughout; an empty table gives no
    rows; columns of any name pass, but for those in double underscores, which are refused, and for size,
    taken and copies, which the last stage sets."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
            if k:
                remove_folder(spark, f"{folder}/{k - 1}")
    return docs


#: Near duplicates and fitted models are beyond SQL; tests hold rules, near duplicates and mix of ``run`` each against
#: brute force or SQL over what the stage before left, and decontamination and personal data against patterns.
ORACLE_SQL = None
