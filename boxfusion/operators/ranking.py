"""Running sums in the order of a value over groups of any size."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges of a value between 0 and 1 that a group is parted into.
PARTS = 4096


def part_of(value: Column) -> Column:
    """The range in which ``value`` lies, in its order: a greater value never lies in a lesser range; NaN above all."""
    return F.when(F.isnan(value), F.lit(2**62)).otherwise(F.floor(F.greatest(F.lit(-1e14), F.least(F.lit(1e14), value)) * PARTS).cast("long"))


def running(rows: DataFrame, by: list[str], part: Column, order: list[Column], sums: dict[str, Column], totals: tuple[str, ...] = (), lows: dict[str, Column] | None = None) -> DataFrame:
    """``rows`` with, for each of ``sums``, its running sum within ``by`` up to and with the row, by falling ``part`` and
    then in ``order``, for each of ``totals`` the sum of the whole group as ``total_<name>``, and for each of ``lows`` the
    least value of the rows before.

    ``part`` must agree with ``order``.  Sums of the parts, few rows, are summed up first, so that rows are
    sorted within parts only and a group of any size fills many tasks."""
    lows = lows or {}
    given = rows.withColumns({"__part": part} | {f"__{k}": v for k, v in (sums | lows).items()})
    parts = given.groupBy(*by, "__part").agg(*[F.sum(f"__{k}").alias(k) for k in sums], *[F.min(f"__{k}").alias(k) for k in lows])
    before = Window.partitionBy(*by).orderBy(F.col("__part").desc()).rowsBetween(Window.unboundedPreceding, -1)
    heads = parts.select(
        *[F.col(c).alias(f"__head_{c}") for c in [*by, "__part"]],
        *[F.coalesce(F.sum(k).over(before), F.lit(0)).alias(f"__before_{k}") for k in sums],
        *[F.sum(k).over(Window.partitionBy(*by)).alias(f"total_{k}") for k in totals],
        *[F.min(k).over(before).alias(f"__before_{k}") for k in lows],
    )
    met = given.join(heads, reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__head_{c}")) for c in [*by, "__part"]]))
    upto = Window.partitionBy(*by, "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    earlier = upto.rowsBetween(Window.unboundedPreceding, -1)
    found = {k: F.col(f"__before_{k}") + F.coalesce(F.sum(f"__{k}").over(upto), F.lit(0)) for k in sums}
    out = met.withColumns(found | {k: F.least(f"__before_{k}", F.min(f"__{k}").over(earlier)) for k in lows})
    return out.select(*rows.columns, *[k for k in (*sums, *lows) if k not in rows.columns], *[f"total_{k}" for k in totals])
