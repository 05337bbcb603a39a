"""Distances to a rasterised area, as a distance transform over blocks of cells with halos."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Cells along the side of a block: a row of the transform holds at most 64 x 64 and its halo.
BLOCK = 64


def _squares(on: np.ndarray, halo: int) -> np.ndarray:
    """Squared distance, in cells, of each inner cell of a block to the nearest cell of ``on``, which has a halo
    around it; beyond ``halo`` a large number."""
    far = 4 * (halo + 1)
    wide = on.shape[1]
    at = np.arange(wide)
    left = at - np.maximum.accumulate(np.where(on, at, -far), axis=1)
    right = np.minimum.accumulate(np.where(on, at, wide + far)[:, ::-1], axis=1)[:, ::-1] - at
    along = np.minimum(np.minimum(left, right), far)[:, halo : wide - halo] ** 2
    inner = on.shape[0] - 2 * halo
    return np.minimum.reduce([along[k : k + inner] + (k - halo) ** 2 for k in range(2 * halo + 1)])


def distance_tiles(mask: DataFrame, of: str = "map_id", cell: float = 0.5, reach: float = 8.0, block: int = BLOCK, asked: DataFrame | None = None) -> DataFrame:
    """(of, ix, iy, distance) of each cell whose center is at most ``reach`` from the center of a cell of ``mask``
    (of, ix, iy): 0 on the mask, elsewhere the exact distance.

    A block sends each neighbour the cells that lie within reach of it, so that no task holds more than a
    block and its halo, however large or crowded a map is.  Repeated cells count once; rows with a null are
    no cells; an empty mask gives no rows.  ``asked`` (of, ix, iy): only these cells, each once; the cells around a
    mask are many more than its own, so that those who ask for few should name them."""
    halo = int(reach / cell + 1e-9)
    if not 0 < halo <= block:
        raise ValueError(f"reach must be of 1 to {block} cells")
    side = block + 2 * halo

    place = F.pmod("iy", F.lit(block)) * block + F.pmod("ix", F.lit(block))

    def packed(cells: DataFrame, name: str) -> DataFrame:
        known = cells.filter(F.col(of).isNotNull() & F.col("ix").isNotNull() & F.col("iy").isNotNull())
        return known.groupBy(of, F.floor(F.col("ix") / block).alias("bx"), F.floor(F.col("iy") / block).alias("by")).agg(F.collect_set(place.cast("int")).alias(name))

    blocks = packed(mask, "cells")

    def sent(dx: int, dy: int) -> Column:
        """The cells as the block at (dx, dy) from here sees them, numbered within its halo."""

        def near(c: Column, d: int) -> Column:
            return F.lit(True) if d == 0 else c < halo if d < 0 else c >= block - halo

        def seen(c: Column) -> Column:
            return (F.floor(c / block) - dy * block + halo) * side + c % block - dx * block + halo

        kept = F.filter("cells", lambda c: near(c % block, dx) & near(F.floor(c / block), dy))
        return F.struct((F.col("bx") + dx).alias("bx"), (F.col("by") + dy).alias("by"), F.transform(kept, lambda c: seen(c).cast("int")).alias("cells"))

    around = F.array(*[sent(dx, dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1)])
    met = blocks.select(of, F.inline(F.filter(around, lambda x: F.size(x["cells"]) > 0)))
    met = met.groupBy(of, "bx", "by").agg(F.flatten(F.collect_list("cells")).alias("cells"))
    met = met.withColumn("asked", F.lit(None).cast("array<int>")) if asked is None else met.join(packed(asked, "asked"), [of, "bx", "by"])

    def transformed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, bx, by, cells, some in zip(b[of], b["bx"], b["by"], b["cells"], b["asked"], strict=True):
                on = np.zeros(side * side, dtype=bool)
                on[cells] = True
                squares = _squares(on.reshape(side, side), halo)
                if some is None:
                    iy, ix = np.nonzero(squares <= halo * halo)
                else:
                    iy, ix = np.divmod(some, block)
                    near = squares[iy, ix] <= halo * halo
                    iy, ix = iy[near], ix[near]
                yield pd.DataFrame({of: name, "ix": bx * block + ix, "iy": by * block + iy, "distance": np.sqrt(squares[iy, ix]) * cell})

    return met.mapInPandas(transformed, f"`{of}` {mask.schema[of].dataType.simpleString()}, ix long, iy long, distance double")
