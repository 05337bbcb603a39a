"""Distances to an area that is rasterised from the boxes themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxfusion.operators import features, raster
from boxfusion.plans import fixtures as X
from boxfusion.plans.queries import query

#: Scenes lie 20 m apart along a map, frames of a scene across it; the fourth map has no area.
AT = """
SELECT box_key, scene_id, CAST(scene_id % 5 AS INT) AS map_id, x + CAST(scene_id*20 AS DOUBLE) - CAST(100 AS DOUBLE) AS x,
  y + CAST((frame_idx % 8)*40 AS DOUBLE) - CAST(100 AS DOUBLE) AS y, w, l FROM {boxes}
"""
#: The cells under every 29th box.
COVERED = "box_key % 29 = 0 AND map_id <> 4"


def covered(at: DataFrame, cell: float = 0.5) -> DataFrame:
    """(map_id, ix, iy) under the boxes ``at``."""
    return at.withColumn("c", F.explode(features.cells(cell))).select("map_id", F.col("c.cx").alias("ix"), F.col("c.cy").alias("iy"))


@query(
    """SELECT placed.box_key, round(d, 9) AS distance, CAST(CASE WHEN placed.map_id NOT IN (SELECT map_id FROM mask) THEN -1 WHEN d IS NULL THEN 16 WHEN d = 0 THEN 0 WHEN d <= 2 THEN 2 ELSE 8 END AS DOUBLE) AS dist_to_drivable_area
       FROM placed LEFT JOIN near ON placed.map_id = near.map_id AND floor(placed.x/0.5) = near.ix AND floor(placed.y/0.5) = near.iy""",
    placed=AT.format(boxes="boxes"),
    mask=f"""SELECT DISTINCT map_id, ix, unnest(range(CAST(floor((y - w/2)/0.5) AS BIGINT), CAST(floor((y + w/2)/0.5) AS BIGINT) + 1)) AS iy
             FROM (SELECT *, unnest(range(CAST(floor((x - l/2)/0.5) AS BIGINT), CAST(floor((x + l/2)/0.5) AS BIGINT) + 1)) AS ix FROM placed WHERE {COVERED})""",
    near="""SELECT c.map_id, c.ix, c.iy, sqrt(min((c.ix - m.ix)*(c.ix - m.ix) + (c.iy - m.iy)*(c.iy - m.iy)))*0.5 AS d
            FROM (SELECT map_id, ix, iy, unnest(range(ix - 16, ix + 17)) AS mx FROM (SELECT DISTINCT map_id, CAST(floor(x/0.5) AS BIGINT) AS ix, CAST(floor(y/0.5) AS BIGINT) AS iy FROM placed)) c
            JOIN mask m ON c.map_id = m.map_id AND c.mx = m.ix
            WHERE (c.ix - m.ix)*(c.ix - m.ix) + (c.iy - m.iy)*(c.iy - m.iy) <= 256 GROUP BY c.map_id, c.ix, c.iy""",
)
def drivable_mask_distance(spark: SparkSession, d: str) -> DataFrame:
    """The ladder over a distance transform of a mask, with the distance itself up to 8 m, read off where a box is."""
    at = spark.sql(AT, boxes=X.boxes(spark, d))
    mask = covered(at.filter(COVERED))
    asked = at.select("map_id", F.floor(F.col("x") / 0.5).alias("ix"), F.floor(F.col("y") / 0.5).alias("iy"))
    out = features.drivable_distance(at, raster.distance_tiles(mask, asked=asked), "map_id", scenes=mask, keep="distance")
    return out.select("box_key", F.round("distance", 9).alias("distance"), "dist_to_drivable_area")
