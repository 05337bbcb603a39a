"""Greedy one-to-one matching of predictions to ground truth within frame and class."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxfusion.functions.geometry import distance, intersection, iou


def match(preds: DataFrame, gts: DataFrame, keys: list[str], per: tuple[str, ...] = (), score: str = "score", order: tuple[str, ...] = ("expert_ord", "box_pos"), gt_pos: str = "gt_pos", metric: str = "iou", threshold: float | None = None, strict: bool = False, last_wins: bool = True, frame: list[str] | None = None) -> DataFrame:
    """``preds`` with ``matched`` (gt_pos or null) and ``label`` (1 if matched).

    In the order of falling score, then ``order``, each prediction takes the best ground truth of its
    ``keys`` that is still free, by overlap (at least ``threshold``, 0.5) or center distance (at most,
    2.0; below if ``strict``).  Of equals the last wins, or the first.  ``per``: columns of ``preds``
    whose values are matched each by itself, as one ground truth may confirm a box of every expert.
    ``frame``: those of ``keys`` by which both tables meet, where they are dealt by these already and need not be
    shuffled again; ``keys``, if not given."""
    frame = keys if frame is None else frame
    within = [k for k in keys if k not in frame]
    given = [*keys, *per]
    threshold = threshold if threshold is not None else 0.5 if metric == "iou" else 2.0
    fields = ["x", "y"] + (["w", "l"] if metric == "iou" else [])
    rest = [c for c in preds.columns if c not in given]
    item = F.struct((-F.col(score)).alias("s"), *order, *fields, F.struct(*rest).alias("row"))
    p = preds.groupBy(*keys, *per).agg(F.sort_array(F.collect_list(item)).alias("p"))
    g = gts.groupBy(*frame).agg(F.collect_list(F.struct(F.col(gt_pos).cast("long").alias("pos"), *fields, *[F.col(k).alias(f"__{k}") for k in within])).alias("g"))

    def best(c: Column, used: Column) -> Column:
        free = F.filter(F.col("g"), lambda t: ~F.array_contains(used, t["pos"]))
        sign = 1 if last_wins else -1
        if metric == "iou":
            shared = F.transform(free, lambda t: F.struct(t.alias("t"), intersection(c, t).alias("n")))
            scored = F.transform(shared, lambda x: F.struct(iou(c, x["t"], inter=x["n"]).alias("v"), (sign * x["t"]["pos"]).alias("t")))
            fit = F.filter(scored, lambda t: (t["v"] > threshold) if strict else (t["v"] >= threshold))
        else:
            scored = F.transform(free, lambda t: F.struct((-distance(c, t)).alias("v"), (sign * t["pos"]).alias("t")))
            fit = F.filter(scored, lambda t: (-t["v"] < threshold) if strict else (-t["v"] <= threshold))
        return sign * F.array_max(fit)["t"]

    def step(acc: Column, c: Column) -> Column:
        def take(m: Column) -> Column:
            return F.struct(F.when(m.isNull(), acc["used"]).otherwise(F.concat(acc["used"], F.array(m))).alias("used"), F.concat(acc["out"], F.array(m)).alias("out"))

        return F.get(F.transform(F.array(best(c, acc["used"])), take), F.lit(0))

    zero = F.struct(F.array().cast("array<bigint>").alias("used"), F.array().cast("array<bigint>").alias("out"))
    found = F.when(F.col("g").isNull(), F.transform("p", lambda c: F.lit(None).cast("bigint"))).otherwise(F.aggregate("p", zero, step, lambda acc: acc["out"]))
    met = p.join(g, frame, "left")
    if within:
        met = met.withColumn("g", F.filter("g", lambda t: reduce(lambda a, b: a & b, [t[f"__{k}"] == F.col(k) for k in within])))
    rows = met.select(*given, F.explode(F.arrays_zip(F.transform("p", lambda c: c["row"]).alias("row"), found.alias("m"))).alias("z"))
    return rows.select(*[F.col(c) if c in given else F.col("z.row")[c].alias(c) for c in preds.columns], F.col("z.m").alias("matched"), F.col("z.m").isNotNull().cast("int").alias("label"))
