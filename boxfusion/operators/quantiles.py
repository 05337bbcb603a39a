"""Exact quantiles of columns of any length.

A rank is sought by range histograms: rows are counted in BUCKETS equal ranges between the least and the greatest value, and the
range that holds the rank, between its own least and greatest value, is parted again, until it holds one value or few
enough to sort.  All columns and ranks are sought together; a round gives one row for each to the driver."""

from __future__ import annotations

import math

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 4096
#: So many values are sorted in one array.
FEW = 4096


def select_ranks(values: DataFrame, wanted: dict[str, set[int]]) -> dict[tuple[str, int], float]:
    """The values of the given ranks, from 0, of each column; ``values``: c, v, finite."""
    found: dict[tuple[str, int], float] = {}
    ends = {r["c"]: r for r in values.groupBy("c").agg(F.min("v").alias("low"), F.max("v").alias("high"), F.count("*").alias("n")).collect()}
    open_ = [(c, k, k, ends[c]["low"], ends[c]["high"], ends[c]["n"]) for c, ranks in wanted.items() for k in ranks]
    while True:
        found |= {(c, k): low for c, k, _, low, high, _ in open_ if low == high}
        open_ = [o for o in open_ if o[3] < o[4]]
        if not open_:
            return found
        asked = values.sparkSession.createDataFrame(open_, "c string, k long, rank long, low double, high double, size long")
        inside = values.join(F.broadcast(asked), "c").filter(F.col("v").between(F.col("low"), F.col("high")))  # a row for each rank
        few = inside.filter(F.col("size") <= FEW).groupBy("c", "k").agg(F.get(F.sort_array(F.collect_list("v")), F.any_value("rank").cast("int")).alias("v"))
        # halves, as the whole width may be beyond a double
        at = F.least(F.floor((F.col("v") / 2 - F.col("low") / 2) / (F.col("high") / 2 - F.col("low") / 2) * BUCKETS), F.lit(BUCKETS - 1))
        parts = inside.filter(F.col("size") > FEW).groupBy("c", "k", "rank", at.alias("b")).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
        before = F.coalesce(F.sum("n").over(Window.partitionBy("c", "k").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        parts = parts.withColumn("rank", F.col("rank") - before).filter((F.col("rank") >= 0) & (F.col("rank") < F.col("n")))
        found |= {(r["c"], r["k"]): r["v"] for r in (few.collect() if any(o[5] <= FEW for o in open_) else [])}
        open_ = [(r["c"], r["k"], r["rank"], r["low"], r["high"], r["n"]) for r in (parts.collect() if any(o[5] > FEW for o in open_) else [])]


def quantiles(rows: DataFrame, columns: list[str], at: list[float]) -> dict[tuple[str, float], float | None]:
    """For each column and each share of ``at`` the quantile, linear between the values around it; null without values.

    Nulls do not count; infinite values lie at the ends and NaN above all."""
    # what is held has a row for each of ``rows``, which are taken as they are if they are held already
    wide = rows.select(*[F.col(c).cast("double").alias(c) for c in columns])
    wide = wide if rows.is_cached else wide.persist(StorageLevel.MEMORY_AND_DISK)
    values = wide.select(F.inline(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).alias("v")) for c in columns]))).filter("v is not null")
    try:
        inf = float("inf")
        counts = {r["c"]: r for r in values.groupBy("c").agg(F.count("*").alias("n"), F.count_if(F.col("v") == -inf).alias("least"), F.count_if(F.abs("v") < inf).alias("finite"), F.count_if(F.isnan("v")).alias("nan")).collect()}
        wanted: dict[str, set[int]] = {}
        for c, r in counts.items():
            ranks = {math.floor(p * (r["n"] - 1)) + up for p in at for up in (0, 1)}
            wanted[c] = {k - r["least"] for k in ranks if r["least"] <= k < r["least"] + r["finite"]}
        held = select_ranks(values.filter(F.abs("v") < inf), {c: k for c, k in wanted.items() if k})

        def value(c: str, k: int) -> float:
            r = counts[c]
            if k < r["least"]:
                return -inf
            return held[c, k - r["least"]] if k < r["least"] + r["finite"] else math.nan if k >= r["n"] - r["nan"] else inf

        def quantile(c: str, p: float) -> float | None:
            if c not in counts:
                return None
            h = p * (counts[c]["n"] - 1)
            low, share = math.floor(h), h - math.floor(h)
            a = value(c, low)
            b = value(c, low + 1) if share else a
            return a if a == b else a + (b - a) * share

        return {(c, p): quantile(c, p) for c in columns for p in at}
    finally:
        if not rows.is_cached:
            wide.unpersist()
