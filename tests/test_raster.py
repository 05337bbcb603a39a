"""The distance transform over blocks against distances to all cells."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from boxfusion.operators.features import drivable_distance
from boxfusion.operators.raster import distance_tiles

CELLS = "map_id string, ix long, iy long"


def plain(cells: set[tuple[int, int]], reach: int) -> dict[tuple[int, int], float]:
    on = np.array(sorted(cells))
    out = {}
    for ix in range(on[:, 0].min() - reach, on[:, 0].max() + reach + 1):
        for iy in range(on[:, 1].min() - reach, on[:, 1].max() + reach + 1):
            d = ((on - (ix, iy)) ** 2).sum(1).min()
            if d <= reach**2:
                out[ix, iy] = float(np.sqrt(d))
    return out


@pytest.mark.parametrize(("block", "reach"), [(4, 4), (8, 3), (64, 5)])
def test_blocks_give_the_distances_to_all_cells(spark, block, reach):
    r = np.random.default_rng(block)
    maps = {"a": {(int(x), int(y)) for x, y in r.integers(-20, 21, (25, 2))}, "b": {(0, 0)}, "c": {(x, 7) for x in range(-9, 9)}}
    rows = [(k, *c) for k, v in maps.items() for c in v]
    mask = spark.createDataFrame(rows + rows[:9] + [("a", None, 1), ("a", 1, None), (None, 1, 1)], CELLS)
    got = distance_tiles(mask, cell=1.0, reach=float(reach), block=block).collect()
    assert len(got) == len({(x.map_id, x.ix, x.iy) for x in got})
    for k, v in maps.items():
        mine = {(x.ix, x.iy): x.distance for x in got if x.map_id == k}
        want = plain(v, reach)
        assert mine.keys() == want.keys()
        assert all(abs(mine[c] - want[c]) < 1e-12 for c in want)


def test_crowded_blocks_empty_masks_and_reach(spark):
    full = spark.range(64 * 64).select(F.lit("a").alias("map_id"), (F.col("id") % 64).alias("ix"), F.floor(F.col("id") / 64).alias("iy"))
    got = distance_tiles(full.unionAll(full), reach=1.0)
    assert got.filter("distance = 0").count() == 64 * 64
    # two cells on each side, and of each corner's 2 x 2 those within the circle
    assert got.filter("distance > 0").count() == 4 * 64 * 2 + 4 * 1
    assert distance_tiles(spark.createDataFrame([], CELLS)).count() == 0
    with pytest.raises(ValueError, match="reach"):
        distance_tiles(full, reach=40.0)


def test_ladder_over_the_transform(spark):
    tiles = distance_tiles(spark.createDataFrame([("a", 0, 0)], CELLS))
    at = spark.createDataFrame([("a", 0.2, 0.2), ("a", 1.6, 0.0), ("a", 2.0, 0.4), ("a", 2.6, 0.0), ("a", 8.4, 0.0), ("a", 8.6, 0.0), ("b", 0.0, 0.0)], "map_id string, x double, y double")
    got = {(r.map_id, r.x): r.dist_to_drivable_area for r in drivable_distance(at, tiles, "map_id").collect()}
    assert got == {("a", 0.2): 0.0, ("a", 1.6): 2.0, ("a", 2.0): 2.0, ("a", 2.6): 8.0, ("a", 8.4): 8.0, ("a", 8.6): 16.0, ("b", 0.0): -1.0}


def test_asked_cells_alone_are_told(spark):
    r = np.random.default_rng(5)
    mask = [(int(m), int(x), int(y)) for m, x, y in zip(r.integers(0, 2, 40), r.integers(-90, 90, 40), r.integers(-90, 90, 40))]
    asked = [(int(m), int(x), int(y)) for m, x, y in zip(r.integers(0, 3, 600), r.integers(-110, 110, 600), r.integers(-110, 110, 600))]
    frame = lambda rows: spark.createDataFrame(rows, "map_id int, ix long, iy long")
    every = {(x["map_id"], x["ix"], x["iy"]): x["distance"] for x in distance_tiles(frame(mask)).collect()}
    some = distance_tiles(frame(mask), asked=frame([*asked, asked[0], (0, None, 1)])).collect()
    assert len(some) == len(set(asked) & set(every)) > 0
    assert all(every[x["map_id"], x["ix"], x["iy"]] == x["distance"] for x in some)
