"""Further registered queries: poses, labels, joins, evaluation and reports, over the same fixtures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxfusion.config import FusionConfig
from boxfusion.functions import geometry as G
from boxfusion.operators import analytics, cleaning, dataset, features, matching, metrics, scoring
from boxfusion.plans import fixtures as X
from boxfusion.plans.queries import _BY_CENTER, _GATED, _PEERS, BY, FRAME, KEY, KEYS, ORDER, ap_sql, query, rounded
from boxfusion.schemas import CLASS_IDS, evaluated_class, lookup
from boxfusion.sources import metadata, sinks

# -- geometry and names ---------------------------------------------------------------------------

_CATEGORY = "CASE box_key % 7 WHEN 0 THEN 'vehicle.bus.bendy' WHEN 1 THEN 'human.pedestrian.stroller' WHEN 2 THEN 'movable_object.trafficcone' WHEN 3 THEN 'static_object.bicycle_rack' WHEN 4 THEN 'car' WHEN 5 THEN 'vehicle.bicycle' END"


@query(f"SELECT box_key, CASE c WHEN 'vehicle.bus.bendy' THEN 'bus' WHEN 'movable_object.trafficcone' THEN 'traffic_cone' WHEN 'vehicle.bicycle' THEN 'bicycle' END AS class_name FROM (SELECT box_key, {_CATEGORY} AS c FROM boxes)")
def evaluated_category(spark: SparkSession, d: str) -> DataFrame:
    return X.boxes(spark, d).select("box_key", evaluated_class(F.expr(_CATEGORY)).alias("class_name"))


_NAMES = "CASE CAST(box_key % 11 AS INT) " + " ".join(f"WHEN {k} THEN '{n}'" for n, k in CLASS_IDS.items()) + " ELSE 'unknown' END"


@query(f"SELECT box_key, {_NAMES} AS class_name FROM boxes")
def class_names(spark: SparkSession, d: str) -> DataFrame:
    name = lookup({k: n for n, k in CLASS_IDS.items()}, (F.col("box_key") % 11).cast("int"), "unknown")
    return X.boxes(spark, d).select("box_key", name.alias("class_name"))


@query("SELECT box_key, round(cos(t)*x - sin(t)*y + 1.5, 6) + 0.0 AS ex, round(sin(t)*x + cos(t)*y - 0.5, 6) + 0.0 AS ey, score + 1.75 AS ez FROM (SELECT *, CAST(expert_ix * 0.25 AS DOUBLE) AS t FROM boxes)")
def sensor_to_ego(spark: SparkSession, d: str) -> DataFrame:
    sensor = (F.lit(1.5), F.lit(-0.5), F.lit(1.75), (F.col("expert_ix") * 0.25).cast("double"))
    x, y, z = G.sensor_to_ego(F.col("x"), F.col("y"), F.col("score"), sensor)
    out = rounded(X.boxes(spark, d).select("box_key", x.alias("ex"), y.alias("ey"), z.alias("ez")), "ex", "ey")
    return out.withColumns({c: F.col(c) + 0.0 for c in ("ex", "ey")})


@query(
    """SELECT box_key, CAST(k AS INT) AS k, round(x + cos(t)*u*l - sin(t)*v*w, 6) + 0.0 AS cx, round(y + sin(t)*u*l + cos(t)*v*w, 6) + 0.0 AS cy
       FROM (SELECT *, CAST(class_ix * 0.5 AS DOUBLE) AS t FROM boxes), (VALUES (0, 0.5::DOUBLE, 0.5::DOUBLE), (1, 0.5, -0.5), (2, -0.5, -0.5), (3, -0.5, 0.5), (4, 0.5, 0.0)) c(k, u, v)"""
)
def box_corners(spark: SparkSession, d: str) -> DataFrame:
    at = G.corners(F.col("x"), F.col("y"), F.col("w"), F.col("l"), (F.col("class_ix") * 0.5).cast("double"))
    out = X.boxes(spark, d).select("box_key", F.posexplode(at).alias("k", "p")).select("box_key", "k", F.col("p.x").alias("cx"), F.col("p.y").alias("cy"))
    return rounded(out, "cx", "cy").withColumns({c: F.round(c, 6) + 0.0 for c in ("cx", "cy")})


@query("SELECT box_key, round(greatest(0, least(1, (x - 6 + 3)/8)), 6) AS shade FROM boxes")
def height_shade(spark: SparkSession, d: str) -> DataFrame:
    return rounded(X.boxes(spark, d).select("box_key", G.height_shade(F.col("x") - 6).alias("shade")), "shade")


_MOVING = "SELECT *, 1.5 + (box_key % 3)*0.25 AS h, (box_key % 7)*0.5 AS vx, (box_key % 5)*0.5 - 1 AS vy FROM {boxes}"


@query("SELECT box_key, CAST(h AS DOUBLE) AS box_height, round(sqrt(vx*vx + vy*vy), 6) AS vel_magnitude FROM moving", moving=_MOVING.format(boxes="boxes"))
def height_and_speed(spark: SparkSession, d: str) -> DataFrame:
    """The two features that the static fixture lacks."""
    rows = spark.sql(_MOVING, boxes=X.boxes(spark, d)).withColumns({c: F.col(c).cast("double") for c in ("h", "vx", "vy")})
    out = features.feature_vector(rows, FRAME, KEY, scene="scene_id", **BY)
    return rounded(out.select("box_key", "box_height", "vel_magnitude"), "vel_magnitude")


# -- scoring, joins and cleaning --------------------------------------------------------------------


@query(f"SELECT box_key, round(CASE WHEN p IS NULL THEN score ELSE greatest(0, least(1, (1/(1 + exp(-p/{FusionConfig().global_tau})))*p + (1 - 1/(1 + exp(-p/{FusionConfig().global_tau})))*score)) END, 6) AS gated FROM gated", peers=_PEERS, gated=_GATED)
def gate_scores_global(spark: SparkSession, d: str) -> DataFrame:
    """One temperature for all classes."""
    rows = features.peer_features(X.boxes(spark, d), FRAME, KEY, **BY)
    n, s = F.col("n_peer_overlaps"), F.col("score")
    p = scoring.blend(0.2 + 0.5 * s + 0.1 * n / (1 + n), 0.1 + 0.8 * F.col("max_class_score"), F.when(F.col("class_ix") < 2, F.lit(0.75)))
    out = scoring.gated(rows.withColumn("routed", p), class_col="class_ix", per_class=False)
    return rounded(out.select("box_key", F.col("score").alias("gated")), "gated")


@query("SELECT box_key, CAST(score >= 0.5 AS INT) AS label FROM boxes")
def hard_labels(spark: SparkSession, d: str) -> DataFrame:
    return X.boxes(spark, d).select("box_key", scoring.hard_label(F.col("score")).alias("label"))


_ALL_FRAMES = "SELECT scene_id, frame_idx FROM {boxes} UNION SELECT scene_id, CAST(-1 AS INT) FROM {boxes}"


@query("SELECT scene_id, frame_idx, box_key, score FROM all_frames LEFT JOIN (SELECT * FROM boxes WHERE score > 0.5) USING (scene_id, frame_idx)", all_frames=_ALL_FRAMES.format(boxes="boxes"))
def frames_with_boxes(spark: SparkSession, d: str) -> DataFrame:
    boxes = X.boxes(spark, d)
    frames = spark.sql(_ALL_FRAMES, boxes=boxes)
    return dataset.with_frames(boxes.filter("score > 0.5"), frames, FRAME).select(*FRAME, "box_key", "score")


@query("SELECT (SELECT count(*) FROM (SELECT DISTINCT scene_id, frame_idx FROM boxes ANTI JOIN gt USING (scene_id, frame_idx))) AS only_first, (SELECT count(*) FROM (SELECT DISTINCT scene_id, frame_idx FROM gt ANTI JOIN boxes USING (scene_id, frame_idx))) AS only_second")
def frame_sets(spark: SparkSession, d: str) -> DataFrame:
    return dataset.same_frames(X.boxes(spark, d), X.gt(spark, d), FRAME)


@query("SELECT CAST(c_custkey AS VARCHAR) AS sample_token, CAST(r_regionkey AS VARCHAR) AS map_token FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_regionkey <> 3")
def map_of_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Customers as samples, nations as scenes, regions as logs; one region has no map."""
    samples = X.table(spark, d, "customer").selectExpr("CAST(c_custkey AS STRING) AS token", "CAST(c_nationkey AS STRING) AS scene_token")
    scenes = X.table(spark, d, "nation").selectExpr("CAST(n_nationkey AS STRING) AS token", "CAST(n_regionkey AS STRING) AS log_token")
    maps = X.table(spark, d, "region").filter("r_regionkey <> 3").selectExpr("CAST(r_regionkey AS STRING) AS token", "array(CAST(r_regionkey AS STRING)) AS log_tokens")
    return metadata.map_of_tokens(samples, scenes, maps)


@query("SELECT CAST(c_custkey AS VARCHAR) AS sample_token, CAST(n_nationkey AS VARCHAR) AS scene_token FROM customer JOIN nation ON c_nationkey = n_nationkey")
def scene_of_tokens(spark: SparkSession, d: str) -> DataFrame:
    rows = X.table(spark, d, "customer").selectExpr("CAST(c_custkey AS STRING) AS sample_token")
    scenes = X.table(spark, d, "customer").selectExpr("CAST(c_custkey AS STRING) AS sample_token", "CAST(c_nationkey AS STRING) AS scene_token")
    return metadata.with_scene(rows, scenes).select("sample_token", "scene_token")


@query("SELECT quantile_cont(w, 0.5) AS low, quantile_cont(l, 0.5) AS high, quantile_cont(w, 0.5) < quantile_cont(l, 0.5) AS ok FROM boxes")
def median_gate(spark: SparkSession, d: str) -> DataFrame:
    return analytics.median_gate(X.boxes(spark, d), "w", "l")


_FAR = "SELECT box_key, CASE WHEN box_key % 997 = 0 THEN 1000 + x ELSE 1 + x END AS dist_from_ego FROM {boxes}"


@query("SELECT box_key, round(least(dist_from_ego, cap), 6) AS dist_from_ego FROM far, (SELECT 3*quantile_cont(dist_from_ego, 0.99) AS cap FROM far)", far=_FAR.format(boxes="boxes"))
def winsorise_tail(spark: SparkSession, d: str) -> DataFrame:
    """Three times the quantile 0.99, as the cleaning has it."""
    return rounded(cleaning.winsorise(spark.sql(_FAR, boxes=X.boxes(spark, d))), "dist_from_ego")


# -- evaluation and reports -------------------------------------------------------------------------


def _threshold(t: float) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return rounded(metrics.detection_ap(X.boxes(spark, d), X.gt(spark, d), FRAME, "class_ix", order=ORDER, thresholds=(t,)), "ap")

    run.__name__ = f"detection_eval_{str(t).replace('.', '_')}"
    query(f"SELECT class_ix, CAST({t} AS DOUBLE) AS threshold, round(coalesce(sum(greatest(p - 0.1, 0))/90/0.9, 0), 6) AS ap FROM ng LEFT JOIN gd USING (class_ix) GROUP BY class_ix", **ap_sql(t))(run)


for _t in (0.5, 1.0, 4.0):
    _threshold(_t)


_NAMED = "CASE class_ix WHEN 0 THEN 'car' WHEN 1 THEN 'pedestrian' ELSE 'barrier' END"
_MADE = "(box_key % 5)*0.5 AS yaw, (box_key % 4)*0.25 AS vx, (box_key % 3)*0.5 AS vy, CASE box_key % 3 WHEN 0 THEN '' WHEN 1 THEN 'moving' ELSE 'parked' END AS attribute"


@query(
    f"""SELECT p.box_key, round(sqrt((p.x - g.x)*(p.x - g.x) + (p.y - g.y)*(p.y - g.y)), 6) AS trans_err,
       round(1 - least(p.w, g.w)*least(p.l, g.l)*1.5/(p.w*p.l*1.5 + g.w*g.l*2 - least(p.w, g.w)*least(p.l, g.l)*1.5), 6) AS scale_err,
       round(abs(CASE WHEN p.name = 'barrier' THEN turn - pi()*floor((turn + pi()/2)/pi()) ELSE turn - 2*pi()*floor((turn + pi())/(2*pi())) END), 6) AS orient_err,
       round(sqrt((p.vx - g.vx)*(p.vx - g.vx) + (p.vy - g.vy)*(p.vy - g.vy)), 6) AS vel_err, CASE WHEN g.attribute <> '' THEN CAST(p.attribute <> g.attribute AS DOUBLE) END AS attr_err
       FROM (SELECT *, {_NAMED} AS name, {_MADE} FROM m WHERE label = 1) p
       JOIN (SELECT * EXCLUDE (box_key), {_MADE} FROM (SELECT *, gt_pos*7 + scene_id AS box_key FROM gt)) g ON p.scene_id = g.scene_id AND p.frame_idx = g.frame_idx AND p.class_ix = g.class_ix AND p.matched = g.gt_pos,
       LATERAL (SELECT p.yaw - g.yaw AS turn)""",
    **_BY_CENTER,
)
def box_errors(spark: SparkSession, d: str) -> DataFrame:
    """The five errors of boxes matched by center."""
    made = ["CAST((box_key % 5)*0.5 AS DOUBLE) AS yaw", "CAST((box_key % 4)*0.25 AS DOUBLE) AS vx", "CAST((box_key % 3)*0.5 AS DOUBLE) AS vy", _MADE.split(", ", 3)[3]]
    preds, gts = X.boxes(spark, d), X.gt(spark, d)
    met = matching.match(preds, gts, KEYS, ("expert_ix",), order=ORDER, metric="center", threshold=2.0).filter("label = 1").select("box_key", "matched")
    p = preds.join(met, "box_key").selectExpr(*FRAME, "class_ix", "box_key", "matched", f"{_NAMED} AS class_name", *"xywl", "CAST(1.5 AS DOUBLE) AS h", *made)
    g = gts.withColumn("box_key", F.col("gt_pos") * 7 + F.col("scene_id")).selectExpr(*FRAME, "class_ix", "gt_pos AS matched", *"xywl", "CAST(2.0 AS DOUBLE) AS h", *made)
    g = g.withColumnsRenamed({c: f"{c}_gt" for c in ("x", "y", "w", "l", "h", "yaw", "vx", "vy", "attribute")})
    errors = metrics.box_errors(p.join(g, [*FRAME, "class_ix", "matched"]))
    return rounded(errors.select("box_key", *metrics.ERRORS), "trans_err", "scale_err", "orient_err", "vel_err")


@query(f"SELECT box_key FROM (SELECT *, {_NAMED} AS name, CAST(frame_idx % 60 AS DOUBLE) AS ego_x FROM boxes) WHERE sqrt((x - ego_x)*(x - ego_x) + (y - 3)*(y - 3)) < CASE name WHEN 'car' THEN 50 WHEN 'pedestrian' THEN 40 ELSE 30 END")
def boxes_in_range(spark: SparkSession, d: str) -> DataFrame:
    boxes = X.boxes(spark, d).withColumn("class_name", F.expr(_NAMED))
    ego = boxes.select(*FRAME).distinct().selectExpr(*FRAME, "CAST(frame_idx % 60 AS DOUBLE) AS ego_x", "CAST(3 AS DOUBLE) AS ego_y")
    return metrics.in_range(boxes, ego, FRAME).select("box_key")


_FOLDS = "SELECT class_ix, CAST(scene_id % 5 AS INT) AS fold, avg(score) AS gap FROM {boxes} GROUP BY class_ix, CAST(scene_id % 5 AS INT)"


@query("SELECT class_ix, round(avg(gap), 6) AS mean, round(stddev_samp(gap), 6) AS std, round(min(gap), 6) AS low, round(max(gap), 6) AS high, max(gap) - min(gap) > 0.3 AS unstable FROM folds GROUP BY class_ix", folds=_FOLDS.format(boxes="boxes"))
def gap_summary(spark: SparkSession, d: str) -> DataFrame:
    return rounded(analytics.gap_summary(spark.sql(_FOLDS, boxes=X.boxes(spark, d)), "class_ix"), "mean", "std", "low", "high")


@query("SELECT printf('%-24s', 'expert ' || expert_ix) AS model, printf('%.4f', max(score)) AS top, printf('%.4f', min(w)) AS least FROM boxes GROUP BY expert_ix")
def model_comparison(spark: SparkSession, d: str) -> DataFrame:
    per = X.boxes(spark, d).groupBy("expert_ix").agg(F.max("score").alias("top"), F.min("w").alias("least"))
    return sinks.comparison(per.select(F.concat(F.lit("expert "), F.col("expert_ix").cast("string")).alias("model"), "top", "least"))
