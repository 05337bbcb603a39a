"""Tracking where tracks contest boxes, and insertion where real and inserted boxes stand in the way."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from boxfusion.operators import tracking
from boxfusion.plans import fixtures as X
from boxfusion.plans.queries import AB, TRACK, nms_sql, query, rounded

#: Slots 2.5 m apart, within each other's gate of 4 m and overlapping where boxes stray.
_CROWD = "SELECT scene, cls, frame_idx, det_id, slot*2.5 + (det_id*7 % 9)*0.25 AS x, y, w, l, score FROM {dets} WHERE det_id % 5 <> 2"


def crowd(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.sql(_CROWD, dets=X.dets(spark, d))
    return rows.withColumn("x", F.col("x").cast("double"))


#: Frame by frame, with the open tracks of each scene and class as a list; pairs by distance, track and box.
_TRACKS = {
    "crowd": _CROWD.format(dets="dets").replace("AS x,", "::DOUBLE AS x,").replace("slot*2.5 + (det_id*7 % 9)*0.25 ::DOUBLE", "(slot*2.5 + (det_id*7 % 9)*0.25)::DOUBLE"),
    "fr": "SELECT *, row_number() OVER (PARTITION BY scene, cls ORDER BY frame_idx) AS n FROM (SELECT scene, cls, frame_idx, list({'k': det_id, 'x': x} ORDER BY det_id) AS dets FROM crowd GROUP BY ALL)",
    "tk": """SELECT DISTINCT scene, cls, CAST(0 AS BIGINT) AS n, []::STRUCT(id BIGINT, x DOUBLE, seen INT)[] AS open, CAST(0 AS BIGINT) AS fresh, []::STRUCT(k BIGINT, x DOUBLE)[] AS dets, []::BIGINT[] AS ids, CAST(0 AS INT) AS frame_idx FROM crowd
      UNION ALL
      SELECT scene, cls, n,
        list_concat([{'id': act[i].id, 'x': CASE WHEN list_contains(p.ut, i) THEN dets[p.ud[list_position(p.ut, i)]].x ELSE act[i].x END, 'seen': CASE WHEN list_contains(p.ut, i) THEN frame_idx ELSE act[i].seen END} FOR i IN range(1, len(act) + 1)],
                    [{'id': fresh + k - 1, 'x': dets[fresh_ones[k]].x, 'seen': frame_idx} FOR k IN range(1, len(fresh_ones) + 1)]),
        fresh + len(fresh_ones), dets,
        [CASE WHEN list_contains(p.ud, j) THEN act[p.ut[list_position(p.ud, j)]].id ELSE fresh + list_position(fresh_ones, j) - 1 END FOR j IN range(1, len(dets) + 1)], frame_idx
      FROM (SELECT *, [j FOR j IN range(1, len(dets) + 1) IF NOT list_contains(p.ud, j)] AS fresh_ones
        FROM (SELECT *, list_reduce([{'ut': [q.t], 'ud': [q.d]} FOR q IN list_sort(flatten([[{'far': abs(dets[j].x - act[i].x), 't': i, 'd': j} FOR j IN range(1, len(dets) + 1)] FOR i IN range(1, len(act) + 1)])) IF q.far <= 4.0],
            lambda a, q: CASE WHEN list_contains(a.ut, q.ut[1]) OR list_contains(a.ud, q.ud[1]) THEN a ELSE {'ut': list_concat(a.ut, q.ut), 'ud': list_concat(a.ud, q.ud)} END, {'ut': []::BIGINT[], 'ud': []::BIGINT[]}) AS p
          FROM (SELECT tk.scene, tk.cls, fr.n, tk.fresh, fr.dets, fr.frame_idx, [t FOR t IN tk.open IF fr.frame_idx - t.seen <= 2] AS act FROM tk JOIN fr ON tk.scene = fr.scene AND tk.cls = fr.cls AND fr.n = tk.n + 1)))""",
    "tracked": "SELECT c.*, t.id, count(*) OVER w AS hit_count, min({'f': c.frame_idx, 'k': c.det_id}) OVER w AS first FROM (SELECT scene, cls, unnest(dets).k AS det_id, unnest(ids) AS id FROM tk WHERE n > 0) t JOIN crowd c USING (scene, cls, det_id) WINDOW w AS (PARTITION BY t.scene, t.cls, t.id)",
}


@query("SELECT det_id, CAST(hit_count AS INT) AS hit_count, first.k AS first_det FROM tracked", **_TRACKS)
def crowd_tracks(spark: SparkSession, d: str) -> DataFrame:
    """Each box's track, told by the track's first box."""
    t = tracking.track(crowd(spark, d), gate=4.0, **TRACK)
    w = Window.partitionBy("scene", "cls", "track_id")
    return t.select("det_id", "hit_count", F.min(F.struct("frame_idx", "det_id")).over(w)["det_id"].alias("first_det"))


_GAPS = _TRACKS | {
    "cand": """SELECT scene, cls, frame_idx + 1 AS frame_idx, (x + x2)/2 AS x, y, w, l, least(score, score2)*0.5 AS made, det_id AS box_key, -row_number() OVER (ORDER BY first, frame_idx, det_id) AS score
        FROM (SELECT *, lead(frame_idx) OVER w AS f2, lead(x) OVER w AS x2, lead(score) OVER w AS score2 FROM tracked WINDOW w AS (PARTITION BY scene, cls, id ORDER BY frame_idx)) WHERE f2 = frame_idx + 2""",
    "free": f"SELECT a.*, NOT EXISTS (SELECT 1 FROM crowd b WHERE a.scene = b.scene AND a.cls = b.cls AND a.frame_idx = b.frame_idx AND {AB} >= 0.3) AS free FROM cand a",
    "unreal": "SELECT * FROM free WHERE free",
    **nms_sql("unreal", "scene, cls, frame_idx", "ins"),
}


@query("SELECT scene, cls, CAST(frame_idx AS INT) AS frame_idx, det_id, x, round(made, 6) AS score FROM (SELECT *, box_key AS det_id FROM ins)", **_GAPS)
def crowd_interpolate(spark: SparkSession, d: str) -> DataFrame:
    """Boxes for skipped frames that neither a real box nor one inserted before stands in the way of."""
    t = tracking.track(crowd(spark, d), gate=4.0, **TRACK)
    return rounded(tracking.interpolate(t, **TRACK).select("scene", "cls", "frame_idx", "det_id", "x", "score"), "score")


@query("SELECT count(*) AS candidates, count(*) FILTER (NOT free) AS on_real, count(*) FILTER (free) - (SELECT count(*) FROM ins) AS on_inserted FROM free", **_GAPS)
def crowd_dropped(spark: SparkSession, d: str) -> DataFrame:
    """How many boxes for skipped frames there are, and how many give way to real boxes and to boxes inserted before."""
    t = tracking.track(crowd(spark, d), gate=4.0, **TRACK)
    return tracking.insertions(t, **TRACK).agg(F.count("*").alias("candidates"), F.count_if(F.col("verdict") == "real").alias("on_real"), F.count_if(F.col("verdict") == "inserted").alias("on_inserted"))


_CHAIN = """
SELECT CAST(o_orderkey AS STRING) AS token, CAST(o_custkey AS STRING) AS scene_token, coalesce(CAST(lead(o_orderkey) OVER w AS STRING), '') AS next, row_number() OVER w = 1 AS is_first
FROM {orders} WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)
"""


@query("SELECT CAST(o_custkey AS VARCHAR) AS scene_token, CAST(o_orderkey AS VARCHAR) AS sample_token, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS INT) AS frame_idx FROM orders WHERE o_orderkey % 3 <> 0")
def scene_order(spark: SparkSession, d: str) -> DataFrame:
    """Customers as scenes, whose orders point to the next one each."""
    chain = spark.sql(_CHAIN, orders=X.table(spark, d, "orders"))
    scenes = chain.filter("is_first").selectExpr("scene_token AS token", "token AS first_sample_token")
    return tracking.scene_frames(chain.drop("is_first"), scenes, chain.filter("CAST(token AS BIGINT) % 3 <> 0").selectExpr("token AS sample_token"))
