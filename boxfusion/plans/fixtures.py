"""Box tables derived from the star-schema tables, by SQL that Spark and the oracle share.

Only integer arithmetic and exact binary fractions, so that both engines agree to the bit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BOXES = """
SELECT box_key, scene_id, min(frame_idx) AS frame_idx, expert_ix, class_ix, x, y, w, l, s AS score
FROM (SELECT ((l_orderkey*10 + l_linenumber)*100000 + l_partkey)*10000 + l_suppkey AS box_key,
        l_suppkey AS scene_id,
        CAST(year(l_shipdate)*12 + month(l_shipdate) AS INT) AS frame_idx,
        CAST(l_partkey % 5 AS INT) AS expert_ix,
        CAST(floor(l_partkey/5) % 3 AS INT) AS class_ix,
        CAST((l_orderkey % 24)*0.5 AS DOUBLE) AS x, CAST((l_partkey % 24)*0.5 AS DOUBLE) AS y,
        CAST(1.5 + (l_partkey % 4)*0.5 AS DOUBLE) AS w, CAST(3.0 + (l_orderkey % 5)*0.5 AS DOUBLE) AS l,
        CAST((l_orderkey*31 + l_linenumber*17) % 1000 AS DOUBLE)/1000 AS s
      FROM {lineitem}) q
GROUP BY box_key, scene_id, expert_ix, class_ix, x, y, w, l, s
"""

GT = """
SELECT scene_id, frame_idx, class_ix,
       row_number() OVER (PARTITION BY scene_id, frame_idx ORDER BY box_key) AS gt_pos,
       x + CASE WHEN box_key % 7 = 0 THEN CAST(9.0 AS DOUBLE) ELSE CAST(0.25 AS DOUBLE) END AS x, y, w, l
FROM {boxes} WHERE box_key % 3 = 0 AND frame_idx % 17 <> 0
"""

GT_FRAMES = "SELECT DISTINCT scene_id, frame_idx FROM {boxes} WHERE frame_idx % 17 <> 0"

#: Slots lie 20 m apart, so that tracks cannot be confused.
DETS = """
SELECT scene, cls, slot, frame_idx, det_id,
       CAST(slot*20 + (det_id*7 % 5)*0.25 AS DOUBLE) AS x, CAST(0 AS DOUBLE) AS y,
       CAST(1.5 AS DOUBLE) AS w, CAST(4.0 AS DOUBLE) AS l,
       CAST((det_id*37) % 1000 AS DOUBLE)/1000 AS score
FROM (SELECT scene, cls, slot, frame_idx, max(event_id) AS det_id
      FROM (SELECT event_id, CAST(user_id % 10 AS INT) AS scene, event_type AS cls,
                   CAST(event_id % 4 AS INT) AS slot,
                   CAST((day(ts)-1)*4 + floor(hour(ts)/6) AS INT) AS frame_idx
            FROM {events}) q
      GROUP BY scene, cls, slot, frame_idx) d
"""

#: Half-metre tiles with the distance to a disk of radius 5 m; every seventh scene has no map.
TILES = """
SELECT s.scene_id, i.ix, j.iy, greatest(CAST(0 AS DOUBLE), sqrt((i.ix*0.5)*(i.ix*0.5) + (j.iy*0.5)*(j.iy*0.5)) - 5) AS distance
FROM (SELECT DISTINCT scene_id FROM {boxes} WHERE scene_id % 7 <> 0) s
CROSS JOIN (SELECT DISTINCT CAST(floor(x/0.5) AS BIGINT) AS ix FROM {boxes}) i
CROSS JOIN (SELECT DISTINCT CAST(floor(y/0.5) AS BIGINT) AS iy FROM {boxes}) j
"""

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(BOXES, lineitem=table(spark, sf_dir, "lineitem"))


def gt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(GT, boxes=boxes(spark, sf_dir))


def gt_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(GT_FRAMES, boxes=boxes(spark, sf_dir))


def dets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(DETS, events=table(spark, sf_dir, "events"))


def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    # each scene's 24 x 24 tiles, which is the fixture's extent
    scenes = boxes(spark, sf_dir).filter("scene_id % 7 <> 0").select("scene_id").distinct()
    at = scenes.selectExpr("scene_id", "explode(sequence(0L, 23L)) AS ix").selectExpr("scene_id", "ix", "explode(sequence(0L, 23L)) AS iy")
    return at.selectExpr("*", "greatest(0.0D, sqrt((ix*0.5D)*(ix*0.5D) + (iy*0.5D)*(iy*0.5D)) - 5) AS distance")


def sql(**names: str) -> str:
    """WITH clauses of the fixtures for the oracle."""
    parts = {"boxes": BOXES.format(lineitem="lineitem"), "gt": GT.format(boxes="boxes"), "gt_frames": GT_FRAMES.format(boxes="boxes"), "dets": DETS.format(events="events"), "tiles": TILES.format(boxes="boxes")}
    return "WITH RECURSIVE " + ",\n".join(f"{k} AS ({v})" for k, v in (parts | names).items())
