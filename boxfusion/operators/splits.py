"""Splits that keep scenes whole, and folds."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boxfusion.operators.ranking import running


def token_split(tokens: list[str], share: float = 0.7, seed: int = 42) -> tuple[list[str], list[str]]:
    """Sorted, shuffled by ``seed``, cut at int(n * share)."""
    order = sorted(tokens)
    random.Random(seed).shuffle(order)
    cut = int(len(order) * share)
    return order[:cut], order[cut:]


def scene_split(frames: DataFrame, shares: dict[str, int], scene: str = "scene_id", parts: int = 10) -> DataFrame:
    """``frames`` with ``split``: the scene's number mod ``parts`` falls in one of the runs of ``shares``."""
    at = F.pmod(F.col(scene) if dict(frames.dtypes)[scene] in ("int", "bigint") else F.xxhash64(scene), F.lit(parts))
    out, low = None, 0
    for name, n in shares.items():
        low += n
        out = F.when(at < low, name) if out is None else out.when(at < low, name)
    return frames.withColumn("split", out)


def group_folds(rows: DataFrame, group: str = "scene_id", folds: int = 5) -> DataFrame:
    """(group, n, fold): groups by falling size, of equals the least, each to the fold that has least so far (of equals
    the first), so that no group crosses folds.  One row for each group meets in one task, in the order of sizes."""
    n = rows.groupBy(group).agg(F.count("*").alias("n"))
    in_order = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("less"), F.col(group).alias("group"))))
    none = F.struct(F.array(*[F.lit(0).cast("long")] * folds).alias("sizes"), F.array().cast("array<int>").alias("to"))

    def step(acc, g):
        at = (F.array_position(acc["sizes"], F.array_min(acc["sizes"])) - 1).cast("int")
        sizes = F.transform(acc["sizes"], lambda x, k: x - F.when(k == at, g["less"]).otherwise(0))
        return F.struct(sizes.alias("sizes"), F.concat(acc["to"], F.array(at)).alias("to"))

    one = n.agg(in_order.alias("groups"))
    dealt = F.arrays_zip("groups", F.aggregate("groups", none, step, lambda acc: acc["to"]).alias("to"))
    return one.select(F.explode(dealt).alias("x")).select(F.col("x.groups.group").alias(group), (-F.col("x.groups.less")).alias("n"), F.col("x.to").alias("fold"))


def stratified_folds(rows: DataFrame, key: list[str], label: str = "label", folds: int = 3, seed: int = 42) -> DataFrame:
    """``rows`` with ``fold``, each label dealt evenly in the order of a hash of the key."""
    return folds_by(rows.withColumn("__hash", F.xxhash64(F.lit(seed), *key)), ["__hash", *key], label, folds).drop("__hash")


def folds_by(rows: DataFrame, order: list[str], label: str = "label", folds: int = 3) -> DataFrame:
    """``rows`` with ``fold``, each label dealt evenly, by falling values of a hash, the first of ``order``, then its rest."""
    out = running(rows, [label], F.shiftright(order[0], 52), [F.col(order[0]).desc(), *map(F.col, order[1:])], {"__at": F.lit(1)})
    return out.withColumn("fold", ((F.col("__at") - 1) % folds).cast("int")).drop("__at")
