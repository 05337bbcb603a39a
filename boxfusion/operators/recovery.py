"""Which sources recover each ground truth, as one bit mask, and what follows from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxfusion.operators.matching import match

MOST_SOURCES = 63


def masks(preds: DataFrame, gts: DataFrame, keys: list[str], sources: int, source: str = "source", order: tuple[str, ...] = ("box_pos",), gt_pos: str = "gt_pos", threshold: float = 2.0, frame: list[str] | None = None) -> DataFrame:
    """(keys, gt_pos, found): bit k of ``found`` is set if a box of source k (0 to ``sources`` - 1) takes the ground truth.

    Each source is matched by itself, by center distance below ``threshold``.  Every ground truth has a row, of 0
    if none finds it; boxes of other sources, or of none, find nothing; an empty table of boxes gives zeros.
    ``frame``: those of ``keys`` by which boxes are dealt once, to meet their ground truth; ``keys``, if not given."""
    if not 0 < sources <= MOST_SOURCES:
        raise ValueError(f"1 to {MOST_SOURCES} sources")
    known = preds.filter(F.col(source).between(0, sources - 1)).repartition(*(frame or keys))
    took = match(known, gts, keys, (source,), order=order, gt_pos=gt_pos, metric="center", threshold=threshold, strict=True, last_wins=False, frame=frame).filter("matched is not null")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col(source).cast("int"))
    each = took.select(*keys, F.col("matched").alias(gt_pos), bit.alias("found"))
    return gts.select(*keys, F.col(gt_pos).cast("long").alias(gt_pos), F.lit(0).cast("long").alias("found")).unionByName(each).groupBy(*keys, gt_pos).agg(F.bit_or("found").alias("found"))


def has(k: int) -> Column:
    return F.col("found").bitwiseAND(1 << k) != 0


def counts(found: DataFrame, experts: int, fused: int | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, n_gt, n_none, n_one, n_all; with the source ``fused`` also n_fused, fused_unique: of those found by one expert
    only, fused_new: of those found by none, fused_lost: found by an expert but not fused).

    One row, of zeros if there is no ground truth, or one for each of ``by``."""
    k = F.bit_count(F.col("found").bitwiseAND((1 << experts) - 1))
    out = [F.count("*").alias("n_gt"), F.count_if(k == 0).alias("n_none"), F.count_if(k == 1).alias("n_one"), F.count_if(k == experts).alias("n_all")]
    if fused is not None:
        f = has(fused)
        out += [F.count_if(f).alias("n_fused"), F.count_if(f & (k == 1)).alias("fused_unique"), F.count_if(f & (k == 0)).alias("fused_new"), F.count_if(~f & (k > 0)).alias("fused_lost")]
    return found.groupBy(*by).agg(*out)


def by_source(found: DataFrame, sources: int) -> DataFrame:
    """(source, n_gt, recovered, only: by no other source, recall): one row for each source."""
    one = [F.struct(F.lit(k).alias("source"), F.count("*").alias("n_gt"), F.count_if(has(k)).alias("recovered"), F.count_if(F.col("found") == (1 << k)).alias("only")) for k in range(sources)]
    each = found.agg(*[c.alias(f"c{k}") for k, c in enumerate(one)]).select(F.inline(F.array(*[f"c{k}" for k in range(sources)])))
    return each.withColumn("recall", F.when(F.col("n_gt") > 0, F.col("recovered") / F.col("n_gt")))


def overlaps(found: DataFrame, sources: int) -> DataFrame:
    """(a, b, both, only_a, only_b, either) for each pair a < b of sources: sizes of the sets of ground truth."""
    pairs = [(a, b) for a in range(sources) for b in range(a + 1, sources)]
    sizes = lambda a, b: {"both": has(a) & has(b), "only_a": has(a) & ~has(b), "only_b": ~has(a) & has(b), "either": has(a) | has(b)}
    one = found.agg(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), *[F.count_if(c).alias(n) for n, c in sizes(a, b).items()]).alias(f"p{a}_{b}") for a, b in pairs])
    return one.select(F.inline(F.array(*[f"p{a}_{b}" for a, b in pairs])))
