"""The registered queries and their SQL, over the fixture tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxfusion.functions import geometry as G
from boxfusion.operators import analytics, cleaning, dataset, features, matching, metrics, nms, scoring, splits, tracking
from boxfusion.plans import fixtures as X
from boxfusion.schemas import canonical_class
from boxfusion.sources.submissions import problem

FRAME, KEY, ORDER = ["scene_id", "frame_idx"], ["box_key"], ("box_key",)
BY = {"expert": "expert_ix", "class_col": "class_ix"}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, **ctes: str):
    """Registers a query under its function's name; ``sql`` selects from the fixtures and ``ctes``."""

    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = f"{X.sql(**ctes)}\n{sql}"
        return f

    return register


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


IOU = "(CASE WHEN greatest(0.0::DOUBLE, least({a}.x + {a}.l/2, {b}.x + {b}.l/2) - greatest({a}.x - {a}.l/2, {b}.x - {b}.l/2)) * greatest(0.0::DOUBLE, least({a}.y + {a}.w/2, {b}.y + {b}.w/2) - greatest({a}.y - {a}.w/2, {b}.y - {b}.w/2)) > 0 THEN (greatest(0.0::DOUBLE, least({a}.x + {a}.l/2, {b}.x + {b}.l/2) - greatest({a}.x - {a}.l/2, {b}.x - {b}.l/2)) * greatest(0.0::DOUBLE, least({a}.y + {a}.w/2, {b}.y + {b}.w/2) - greatest({a}.y - {a}.w/2, {b}.y - {b}.w/2))) / ({a}.w*{a}.l + {b}.w*{b}.l - greatest(0.0::DOUBLE, least({a}.x + {a}.l/2, {b}.x + {b}.l/2) - greatest({a}.x - {a}.l/2, {b}.x - {b}.l/2)) * greatest(0.0::DOUBLE, least({a}.y + {a}.w/2, {b}.y + {b}.w/2) - greatest({a}.y - {a}.w/2, {b}.y - {b}.w/2))) ELSE 0 END)"
DIST = "sqrt(({a}.x - {b}.x)*({a}.x - {b}.x) + ({a}.y - {b}.y)*({a}.y - {b}.y))"
AB = IOU.format(a="a", b="b")

# -- scalar functions ---------------------------------------------------------------------------

_RAW = "CASE WHEN box_key % 11 = 0 THEN 'vehicle.bus.rigid' WHEN box_key % 11 = 1 THEN 'human.pedestrian.child' WHEN box_key % 11 = 2 THEN 'unicycle' WHEN box_key % 11 = 3 THEN '' ELSE 'car' END"


@query(f"SELECT box_key, CASE WHEN raw = 'car' THEN 'car' WHEN raw = 'vehicle.bus.rigid' THEN 'bus' WHEN raw = 'human.pedestrian.child' THEN 'pedestrian' END AS class_name FROM (SELECT box_key, {_RAW} AS raw FROM boxes)")
def class_canonicalise(spark: SparkSession, d: str) -> DataFrame:
    return X.boxes(spark, d).select("box_key", canonical_class(F.expr(_RAW)).alias("class_name"))


_FLAWS = """
SELECT box_key, CASE WHEN box_key % 13 = 0 THEN '' ELSE 'tok' END AS sample_token,
  CASE WHEN box_key % 17 = 1 THEN 'map' ELSE 'global' END AS coord_frame,
  CASE WHEN box_key % 19 = 2 THEN 'unicycle' WHEN box_key % 19 = 3 THEN 'vehicle.car' ELSE 'bus' END AS class_name,
  CASE WHEN box_key % 23 = 3 THEN -w WHEN box_key % 23 = 4 THEN 0*w ELSE w END AS w,
  CASE WHEN box_key % 29 = 5 THEN score + 1 WHEN box_key % 29 = 6 THEN -score - 1 ELSE score END AS score, l
FROM {boxes}
"""


@query(
    """SELECT box_key, CASE WHEN sample_token = '' THEN 'empty token' WHEN coord_frame = 'map' THEN 'unknown frame' WHEN NOT w > 0 THEN 'size'
       WHEN NOT (score BETWEEN 0 AND 1) THEN 'score' WHEN class_name = 'unicycle' THEN 'unknown class' END AS problem FROM flaws""",
    flaws=_FLAWS.format(boxes="boxes"),
)
def box_validate(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.sql(_FLAWS, boxes=X.boxes(spark, d))
    zero = F.lit(0.0)
    made = rows.select("box_key", "sample_token", F.lit("expert").alias("expert"), "coord_frame", F.array(zero, zero, zero).alias("translation"), F.array("w", "l", F.lit(1.5)).alias("size"), F.array(F.lit(1.0), zero, zero, zero).alias("rotation"), F.array(zero, zero).alias("velocity"), F.col("class_name").alias("detection_name"), F.col("score").alias("detection_score"))
    return made.select("box_key", problem().alias("problem"))


_TURN = "(frame_idx % 628) / 100.0 - 3.14"


@query(f"SELECT box_key, round(atan2(2*(cos(t/2)*sin(t/2)), 1 - 2*(sin(t/2)*sin(t/2))), 6) AS yaw FROM (SELECT box_key, CAST({_TURN} AS DOUBLE) AS t FROM boxes)")
def quat_yaw(spark: SparkSession, d: str) -> DataFrame:
    t = F.expr(f"CAST({_TURN} AS DOUBLE)")
    return rounded(X.boxes(spark, d).select("box_key", G.yaw(F.cos(t / 2), F.lit(0.0), F.lit(0.0), F.sin(t / 2)).alias("yaw")), "yaw")


@query(
    """SELECT box_key, round(cos(t)*(x - 3) + sin(t)*(y - 2), 6) + 0.0 AS ego_x, round(-sin(t)*(x - 3) + cos(t)*(y - 2), 6) + 0.0 AS ego_y, round(0.5 - t, 6) AS ego_yaw
       FROM (SELECT *, CAST(expert_ix * 0.25 AS DOUBLE) AS t FROM boxes)"""
)
def global_to_ego(spark: SparkSession, d: str) -> DataFrame:
    t = (F.col("expert_ix") * 0.25).cast("double")
    e = G.to_ego(F.col("x"), F.col("y"), F.lit(0.0), F.lit(0.5), (F.lit(3.0), F.lit(2.0), F.lit(0.0), t))
    out = rounded(X.boxes(spark, d).select("box_key", e["x"].alias("ego_x"), e["y"].alias("ego_y"), e["yaw"].alias("ego_yaw")), "ego_x", "ego_y", "ego_yaw")
    return out.withColumns({c: F.col(c) + 0.0 for c in ("ego_x", "ego_y")})


@query("SELECT box_key, -y + 10 AS tx, x + 20 AS ty, CAST(2.0 AS DOUBLE) AS tz, round(atan2(sin(0.25 + 1.5707963267948966), cos(0.25 + 1.5707963267948966)), 6) AS tyaw FROM boxes")
def rigid_transform(spark: SparkSession, d: str) -> DataFrame:
    """A quarter turn and a shift."""
    m = F.array(*[F.array(*[F.lit(float(v)) for v in row]) for row in ((0, -1, 0, 10), (1, 0, 0, 20), (0, 0, 1, 2), (0, 0, 0, 1))])
    i = F.array(*[F.array(*[F.lit(float(r == c)) for c in range(4)]) for r in range(4)])
    x, y, z = G.transform_point(m, F.col("x"), F.col("y"), F.lit(0.0))
    return rounded(X.boxes(spark, d).select("box_key", x.alias("tx"), y.alias("ty"), z.alias("tz"), G.compose_yaw(F.lit(0.25), i, m).alias("tyaw")), "tyaw")


@query(f"SELECT a.box_key, b.box_key AS other_key, {AB} AS iou FROM boxes a JOIN boxes b USING (scene_id, frame_idx) WHERE a.box_key < b.box_key AND {AB} > 0")
def pair_iou(spark: SparkSession, d: str) -> DataFrame:
    a = X.boxes(spark, d)
    b = a.select(*FRAME, F.col("box_key").alias("other_key"), *[F.col(c).alias(f"{c}2") for c in "xywl"])
    return a.join(b, FRAME).filter("box_key < other_key").withColumn("iou", G.iou(None, None, "2")).filter("iou > 0").select("box_key", "other_key", "iou")


# -- features -----------------------------------------------------------------------------------

_PEERS = f"""
SELECT box_key, CAST(count(b2) AS INT) AS n_peer_overlaps, coalesce(max(i), 0) AS max_peer_iou, coalesce(avg(s2), 0) AS mean_peer_score, coalesce(var_pop(s2), 0) AS score_variance,
  CASE WHEN any_value(n_active) > 1 THEN count(DISTINCT e2) / (any_value(n_active) - 1) ELSE 0 END AS expert_agreement, coalesce(avg(CAST(same AS DOUBLE)), -1) AS class_agreement, CAST(any_value(n_active) AS INT) AS n_active_experts
FROM boxes JOIN (SELECT scene_id, frame_idx, count(DISTINCT expert_ix) AS n_active FROM boxes GROUP BY ALL) USING (scene_id, frame_idx)
LEFT JOIN (SELECT a.box_key, b.box_key AS b2, {AB} AS i, b.score AS s2, b.expert_ix AS e2, a.class_ix = b.class_ix AS same
  FROM boxes a JOIN boxes b USING (scene_id, frame_idx) WHERE a.expert_ix <> b.expert_ix AND {AB} >= 0.1) USING (box_key)
GROUP BY box_key
"""
_PEER_COLUMNS = ("max_peer_iou", "mean_peer_score", "score_variance", "expert_agreement", "class_agreement")
_ROUND_PEERS = ", ".join(f"round({c}, 12) AS {c}" for c in _PEER_COLUMNS)


@query(f"SELECT box_key, n_peer_overlaps, {_ROUND_PEERS} FROM peers", peers=_PEERS)
def peer_features(spark: SparkSession, d: str) -> DataFrame:
    out = features.peer_features(X.boxes(spark, d), FRAME, KEY, **BY)
    return rounded(out.select("box_key", "n_peer_overlaps", *_PEER_COLUMNS), *_PEER_COLUMNS, digits=12)


@query("SELECT box_key, max(score) OVER (PARTITION BY scene_id, frame_idx, class_ix) AS max_class_score, n_active_experts FROM boxes JOIN peers USING (box_key)", peers=_PEERS)
def class_max_score(spark: SparkSession, d: str) -> DataFrame:
    return features.peer_features(X.boxes(spark, d), FRAME, KEY, **BY).select("box_key", "max_class_score", "n_active_experts")


_LADDER = """
SELECT b.box_key, CAST(CASE WHEN k.scene_id IS NULL THEN -1 WHEN coalesce(t.distance, 1e9) <= 0 THEN 0 WHEN coalesce(t.distance, 1e9) <= 2 THEN 2 WHEN coalesce(t.distance, 1e9) <= 8 THEN 8 ELSE 16 END AS DOUBLE) AS dist_to_drivable_area
FROM boxes b LEFT JOIN (SELECT DISTINCT scene_id FROM tiles) k USING (scene_id)
LEFT JOIN tiles t ON t.scene_id = b.scene_id AND t.ix = floor(b.x/0.5) AND t.iy = floor(b.y/0.5)
"""


@query("SELECT * FROM ladder", ladder=_LADDER)
def drivable_distance(spark: SparkSession, d: str) -> DataFrame:
    return features.drivable_distance(X.boxes(spark, d), X.tiles(spark, d), "scene_id").select("box_key", "dist_to_drivable_area")


_VECTOR = f"""
SELECT box_key, expert_ix AS expert_id, score AS detection_score, round(sqrt(x*x + y*y), 6) AS dist_from_ego, w AS box_width, l AS box_length, CAST(0 AS DOUBLE) AS vel_magnitude, n_peer_overlaps, {_ROUND_PEERS},
  n_peer_overlaps AS n_spatial_overlaps, max(score) OVER (PARTITION BY scene_id, frame_idx, class_ix) AS max_class_score, n_active_experts, dist_to_drivable_area
FROM boxes JOIN peers USING (box_key) JOIN ladder USING (box_key)
"""


@query(_VECTOR, peers=_PEERS, ladder=_LADDER)
def feature_vector(spark: SparkSession, d: str) -> DataFrame:
    out = features.feature_vector(X.boxes(spark, d), FRAME, KEY, tiles=X.tiles(spark, d), scene="scene_id", **BY)
    names = [c for c in features.FEATURES if c != "box_height"]
    return rounded(rounded(out.select("box_key", *names), "dist_from_ego"), *_PEER_COLUMNS, digits=12)


# -- scoring ------------------------------------------------------------------------------------

_TAU = "CASE class_ix WHEN 0 THEN 0.8 WHEN 1 THEN 1.0 ELSE 1.2 END"
#: Stand-ins for two routers, linear in the features; class 2 has none.
_ROUTED = "CASE WHEN class_ix < 2 THEN 0.75*(0.2 + 0.5*score + 0.1*n_peer_overlaps/(1 + n_peer_overlaps)) + 0.25*(0.1 + 0.8*max_class_score) END"
_GATED = f"""
SELECT *, CASE WHEN p IS NULL THEN score ELSE greatest(0, least(1, (1/(1 + exp(-p/tau)))*p + (1 - 1/(1 + exp(-p/tau)))*score)) END AS gated
FROM (SELECT *, CAST({_ROUTED} AS DOUBLE) AS p, CAST({_TAU} AS DOUBLE) AS tau FROM (SELECT *, max(score) OVER (PARTITION BY scene_id, frame_idx, class_ix) AS max_class_score FROM boxes JOIN peers USING (box_key))) q
"""


def _gated(spark: SparkSession, d: str) -> DataFrame:
    rows = features.peer_features(X.boxes(spark, d), FRAME, KEY, **BY)
    n, s = F.col("n_peer_overlaps"), F.col("score")
    first, second = 0.2 + 0.5 * s + 0.1 * n / (1 + n), 0.1 + 0.8 * F.col("max_class_score")
    known = F.when(F.col("class_ix") < 2, F.lit(0.75))
    tau = F.when(F.col("class_ix") == 0, 0.8).when(F.col("class_ix") == 1, 1.0).otherwise(1.2)
    return rows.withColumn("gated", scoring.gate(s, scoring.blend(first, second, known), tau))


@query("SELECT box_key, round(gated, 6) AS gated FROM gated", peers=_PEERS, gated=_GATED)
def gate_scores(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_gated(spark, d).select("box_key", "gated"), "gated")


_THR = "CASE class_ix WHEN 0 THEN 0.488 WHEN 1 THEN 0.365 ELSE 0.232 END"


@query(f"SELECT box_key, score FROM boxes WHERE score >= {_THR}")
def threshold_filter(spark: SparkSession, d: str) -> DataFrame:
    named = X.boxes(spark, d).withColumn("class_name", F.element_at(F.array(F.lit("car"), F.lit("truck"), F.lit("trailer")), F.col("class_ix") + 1))
    return scoring.over_threshold(named).select("box_key", "score")


# -- suppression --------------------------------------------------------------------------------


def nms_sql(source: str, keys: str, name: str) -> dict[str, str]:
    """Recursive: rank by rank, the kept ranks of each group."""
    using = keys.replace(" ", "")
    on = " AND ".join(f"r.{k} = c.{k}" for k in using.split(","))
    return {
        f"{name}_r": f"SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY score DESC, box_key) AS rk FROM {source}",
        f"{name}_clash": f"SELECT {', '.join(f'a.{k}' for k in using.split(','))}, b.rk, list(a.rk) AS by FROM {name}_r a JOIN {name}_r b ON {' AND '.join(f'a.{k} = b.{k}' for k in using.split(','))} AND a.rk < b.rk WHERE {AB} >= 0.3 GROUP BY ALL",
        f"{name}_n": f"SELECT {keys}, max(rk) AS n FROM {name}_r GROUP BY ALL",
        f"{name}_fold": f"SELECT {keys}, n, CAST(1 AS BIGINT) AS rk, [CAST(1 AS BIGINT)] AS kept FROM {name}_n UNION ALL SELECT {', '.join(f'r.{k}' for k in using.split(','))}, r.n, r.rk + 1, CASE WHEN c.by IS NOT NULL AND list_has_any(r.kept, c.by) THEN r.kept ELSE list_append(r.kept, r.rk + 1) END FROM {name}_fold r LEFT JOIN {name}_clash c ON {on} AND c.rk = r.rk + 1 WHERE r.rk < r.n",
        name: f"SELECT b.* FROM {name}_r b JOIN (SELECT {keys}, unnest(kept) AS rk FROM {name}_fold WHERE rk = n) USING ({keys}, rk)",
    }


_NMS = nms_sql("boxes", "scene_id, frame_idx, class_ix", "kept")


@query("SELECT box_key, class_ix, score FROM kept", **_NMS)
def nms_class_aware(spark: SparkSession, d: str) -> DataFrame:
    return nms.suppress(X.boxes(spark, d), FRAME, "class_ix", order=ORDER).select("box_key", "class_ix", "score")


@query("SELECT box_key, class_ix, score FROM kept", **nms_sql("boxes", "scene_id, frame_idx", "kept"))
def nms_agnostic(spark: SparkSession, d: str) -> DataFrame:
    return nms.suppress(X.boxes(spark, d), FRAME, None, order=ORDER).select("box_key", "class_ix", "score")


@query("SELECT box_key, score FROM kept QUALIFY row_number() OVER (PARTITION BY scene_id, frame_idx ORDER BY score DESC, class_ix, box_key) <= 5", **_NMS)
def nms_cap(spark: SparkSession, d: str) -> DataFrame:
    """The five best of each frame."""
    kept = nms.suppress(X.boxes(spark, d), FRAME, "class_ix", order=ORDER)
    return nms.cap(kept, FRAME, order=("class_ix", "box_key"), most=5).select("box_key", "score")


# -- matching -----------------------------------------------------------------------------------


def match_sql(name: str, keys: str, per: str, value: str, fits: str, best: str, preds: str = "boxes", gts: str = "gt") -> dict[str, str]:
    """Recursive: prediction by prediction, the ground truth that is taken.  ``value``: of a and b."""
    ks, ps = keys.split(", "), [p for p in per.split(", ") if p]
    group = ", ".join(ks + ps)
    same = lambda a, b, names: " AND ".join(f"{a}.{k} = {b}.{k}" for k in names)
    return {
        f"{name}_p": f"SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY score DESC, box_key) AS rk FROM {preds}",
        f"{name}_c": f"SELECT {', '.join(f'a.{k}' for k in ks + ps)}, a.rk, list(b.gt_pos ORDER BY {best}) AS want FROM {name}_p a JOIN {gts} b ON {same('a', 'b', ks)} WHERE {value} {fits} GROUP BY ALL",
        f"{name}_n": f"SELECT {group}, max(rk) AS n FROM {name}_p GROUP BY ALL",
        f"{name}_f": f"SELECT {group}, n, CAST(0 AS BIGINT) AS rk, CAST([] AS BIGINT[]) AS used, CAST(NULL AS BIGINT) AS took FROM {name}_n UNION ALL SELECT {', '.join(f'z.{k}' for k in ks + ps)}, z.n, z.rk, CASE WHEN z.pick IS NULL THEN z.used ELSE list_append(z.used, z.pick) END, z.pick FROM (SELECT {', '.join(f'r.{k}' for k in ks + ps)}, r.n, r.rk + 1 AS rk, r.used, list_filter(c.want, lambda g: NOT list_contains(r.used, g))[1] AS pick FROM {name}_f r LEFT JOIN {name}_c c ON {same('r', 'c', ks + ps)} AND c.rk = r.rk + 1 WHERE r.rk < r.n) z",
        name: f"SELECT p.*, f.took AS matched, CAST(CASE WHEN f.took IS NULL THEN 0 ELSE 1 END AS INT) AS label FROM {name}_p p JOIN {name}_f f ON {same('p', 'f', ks + ps)} AND p.rk = f.rk",
    }


_CLASS = "scene_id, frame_idx, class_ix"
_GD = DIST.format(a="a", b="b")
_BY_IOU = match_sql("m", _CLASS, "expert_ix", AB, ">= 0.5", f"{AB} DESC, b.gt_pos DESC")
_BY_CENTER = match_sql("m", _CLASS, "expert_ix", _GD, "<= 2.0", f"{_GD}, b.gt_pos DESC")
_RECOVER = match_sql("m", _CLASS, "", _GD, "< 2.0", f"{_GD}, b.gt_pos")
_RECOVER_EACH = match_sql("m", _CLASS, "expert_ix", _GD, "< 2.0", f"{_GD}, b.gt_pos")
KEYS = [*FRAME, "class_ix"]


@query("SELECT box_key, matched, label FROM m", **_BY_IOU)
def match_iou(spark: SparkSession, d: str) -> DataFrame:
    return matching.match(X.boxes(spark, d), X.gt(spark, d), KEYS, ("expert_ix",), order=ORDER).select("box_key", "matched", "label")


@query("SELECT box_key, matched, label FROM m", **_BY_CENTER)
def match_center(spark: SparkSession, d: str) -> DataFrame:
    return matching.match(X.boxes(spark, d), X.gt(spark, d), KEYS, ("expert_ix",), order=ORDER, metric="center").select("box_key", "matched", "label")


@query("SELECT scene_id, frame_idx, matched AS gt_pos, box_key FROM m WHERE matched IS NOT NULL", **_RECOVER)
def recovery_match(spark: SparkSession, d: str) -> DataFrame:
    out = matching.match(X.boxes(spark, d), X.gt(spark, d), KEYS, order=ORDER, metric="center", strict=True, last_wins=False)
    return out.filter("matched is not null").select(*FRAME, F.col("matched").alias("gt_pos"), "box_key")


@query(
    """SELECT count(*) AS n_gt, count(*) FILTER (coalesce(k, 0) = 0) AS n_none, count(*) FILTER (k = 1) AS n_one, count(*) FILTER (k = 5) AS n_all
       FROM gt LEFT JOIN (SELECT scene_id, frame_idx, matched AS gt_pos, count(DISTINCT expert_ix) AS k FROM m WHERE matched IS NOT NULL GROUP BY ALL) USING (scene_id, frame_idx, gt_pos)""",
    **_RECOVER_EACH,
)
def complementarity(spark: SparkSession, d: str) -> DataFrame:
    """How many experts recover each ground truth."""
    gt = X.gt(spark, d)
    got = matching.match(X.boxes(spark, d), gt, KEYS, ("expert_ix",), order=ORDER, metric="center", strict=True, last_wins=False).filter("matched is not null")
    k = got.groupBy(*FRAME, F.col("matched").alias("gt_pos")).agg(F.count_distinct("expert_ix").alias("k"))
    k = gt.join(k, [*FRAME, "gt_pos"], "left").select(F.coalesce("k", F.lit(0)).alias("k"))
    return k.agg(F.count("*").alias("n_gt"), F.count_if(F.col("k") == 0).alias("n_none"), F.count_if(F.col("k") == 1).alias("n_one"), F.count_if(F.col("k") == 5).alias("n_all"))


@query(
    "SELECT expert_ix, count(*) AS n_boxes, CAST(sum(label) AS BIGINT) AS recovered, round(sum(label) / count(*), 6) AS precision FROM m GROUP BY expert_ix",
    **({"good": "SELECT * FROM boxes WHERE score >= 0.35"} | match_sql("m", _CLASS, "expert_ix", _GD, "< 2.0", f"{_GD}, b.gt_pos", preds="good")),
)
def recovery_by_source(spark: SparkSession, d: str) -> DataFrame:
    good = X.boxes(spark, d).filter("score >= 0.35")
    got = matching.match(good, X.gt(spark, d), KEYS, ("expert_ix",), order=ORDER, metric="center", strict=True, last_wins=False)
    return got.groupBy("expert_ix").agg(F.count("*").alias("n_boxes"), F.sum("label").alias("recovered"), F.round(F.sum("label") / F.count("*"), 6).alias("precision"))


# -- router rows and what is computed from them -------------------------------------------------

_INSIDE = {"inside": "SELECT b.* FROM boxes b SEMI JOIN gt_frames USING (scene_id, frame_idx)"}
_ROWS = _INSIDE | {"peers": _PEERS} | match_sql("m", _CLASS, "expert_ix", AB, ">= 0.5", f"{AB} DESC, b.gt_pos DESC", preds="inside")
_ROWS["rows"] = "SELECT m.box_key, m.scene_id, m.frame_idx, m.expert_ix, m.class_ix AS class_id, m.label, m.score AS detection_score, sqrt(m.x*m.x + m.y*m.y) AS dist_from_ego, m.w AS box_width, m.l AS box_length, p.* EXCLUDE (box_key), max(m.score) OVER (PARTITION BY m.scene_id, m.frame_idx, m.class_ix) AS max_class_score FROM m JOIN peers p USING (box_key)"
NUMERIC = ["detection_score", "dist_from_ego", "box_width", "box_length", "n_peer_overlaps", "max_peer_iou", "mean_peer_score", "score_variance", "expert_agreement", "class_agreement", "max_class_score", "n_active_experts"]


def router_rows(spark: SparkSession, d: str, boxes: DataFrame | None = None) -> DataFrame:
    """``boxes``: those of the fixture, where they are held."""
    boxes = X.boxes(spark, d) if boxes is None else boxes
    out = dataset.build(boxes, spark.sql(X.GT, boxes=boxes), spark.sql(X.GT_FRAMES, boxes=boxes), FRAME, KEY, "class_ix", "expert_ix", ORDER)
    return out.withColumn("class_id", F.col("class_ix"))


@query(f"SELECT box_key, class_id, label, {', '.join(f'round(CAST({c} AS DOUBLE), 12) AS {c}' for c in NUMERIC)} FROM rows", **_ROWS)
def router_dataset(spark: SparkSession, d: str) -> DataFrame:
    return router_rows(spark, d).select("box_key", "class_id", "label", *[F.round(F.col(c).cast("double"), 12).alias(c) for c in NUMERIC])


@query("SELECT DISTINCT scene_id, frame_idx FROM boxes ANTI JOIN gt_frames USING (scene_id, frame_idx)")
def frames_without_gt(spark: SparkSession, d: str) -> DataFrame:
    return dataset.frames_without_gt(X.boxes(spark, d), X.gt_frames(spark, d), FRAME)


@query("SELECT scene_id, frame_idx, CASE WHEN scene_id % 10 < 6 THEN 'fit' WHEN scene_id % 10 < 8 THEN 'calibration' ELSE 'test' END AS split FROM (SELECT DISTINCT scene_id, frame_idx FROM boxes)")
def scene_split(spark: SparkSession, d: str) -> DataFrame:
    return splits.scene_split(X.boxes(spark, d).select(*FRAME).distinct(), {"fit": 6, "calibration": 2, "test": 2})


_DEALT = {
    "sized": "SELECT scene_id, n, row_number() OVER (ORDER BY n DESC, scene_id) AS k FROM (SELECT scene_id, count(*) AS n FROM boxes GROUP BY scene_id)",
    "dealt": """SELECT CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS scene_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS INT) AS fold, [0, 0, 0, 0, 0]::BIGINT[] AS sizes
        UNION ALL SELECT s.k, s.scene_id, s.n, CAST(list_position(d.sizes, list_min(d.sizes)) - 1 AS INT),
          [d.sizes[i] + CASE WHEN i = list_position(d.sizes, list_min(d.sizes)) THEN s.n ELSE 0 END FOR i IN range(1, 6)] FROM dealt d JOIN sized s ON s.k = d.k + 1""",
}


@query("SELECT scene_id, n, fold FROM dealt WHERE k > 0", **_DEALT)
def group_kfold(spark: SparkSession, d: str) -> DataFrame:
    return splits.group_folds(X.boxes(spark, d))


# -- tracking -----------------------------------------------------------------------------------

#: Tracks are islands: a gap of more than two frames begins a new one.
_ISLANDS = {
    "isl": "SELECT *, sum(CASE WHEN gap IS NULL OR gap > 2 THEN 1 ELSE 0 END) OVER (PARTITION BY scene, cls, slot ORDER BY frame_idx) AS run FROM (SELECT *, frame_idx - lag(frame_idx) OVER (PARTITION BY scene, cls, slot ORDER BY frame_idx) AS gap FROM dets)",
    "hits": "SELECT *, CAST(count(*) OVER (PARTITION BY scene, cls, slot, run) AS INT) AS hit_count FROM isl",
    "gaps": "SELECT scene, cls, slot, frame_idx + 1 AS frame_idx, (x + x2)/2 AS x, least(score, score2)*0.5 AS score, least(score, score2)*0.9 AS score9 FROM (SELECT *, lead(frame_idx) OVER w AS f2, lead(x) OVER w AS x2, lead(score) OVER w AS score2 FROM isl WINDOW w AS (PARTITION BY scene, cls, slot, run ORDER BY frame_idx)) WHERE f2 = frame_idx + 2",
}
TRACK = {"scene": "scene", "class_col": "cls", "order": ("det_id",)}


@query("SELECT det_id, hit_count FROM hits", **_ISLANDS)
def track_hits(spark: SparkSession, d: str) -> DataFrame:
    return tracking.track(X.dets(spark, d), gate=4.0, **TRACK).select("det_id", "hit_count")


@query("SELECT det_id, round(CASE WHEN hit_count = 1 THEN score*0.7 ELSE least(1, score*1.1) END, 6) AS score FROM hits", **_ISLANDS)
def track_rescore(spark: SparkSession, d: str) -> DataFrame:
    t = tracking.track(X.dets(spark, d), gate=4.0, **TRACK)
    return rounded(t.select("det_id", tracking.rescored(F.col("score"), F.col("hit_count"), 0.7, 1.1).alias("score")), "score")


@query("SELECT scene, cls, slot, CAST(frame_idx AS INT) AS frame_idx, x, round(score, 6) AS score FROM gaps", **_ISLANDS)
def track_interpolate(spark: SparkSession, d: str) -> DataFrame:
    t = tracking.track(X.dets(spark, d), gate=4.0, **TRACK)
    return rounded(tracking.interpolate(t, **TRACK).select("scene", "cls", "slot", "frame_idx", "x", "score"), "score")


@query(
    """SELECT scene, cls, slot, frame_idx, x, round(CASE WHEN hit_count = 1 AND cls <> 'click' THEN score*0.7 ELSE score END, 6) AS score, false AS inserted FROM hits
       UNION ALL SELECT scene, cls, slot, CAST(frame_idx AS INT), x, round(score9, 6), true FROM gaps WHERE cls <> 'click'""",
    **_ISLANDS,
)
def temporal_refine(spark: SparkSession, d: str) -> DataFrame:
    out = tracking.refine(X.dets(spark, d), gate=4.0, excluded=("click",), **TRACK)
    return rounded(out.select("scene", "cls", "slot", "frame_idx", "x", "score", "inserted"), "score")


# -- cleaning and analysis ----------------------------------------------------------------------

_DIRTY = """
SELECT box_key, class_ix + CASE WHEN box_key % 31 = 0 THEN 9 ELSE 0 END AS class_id, expert_ix,
  CASE WHEN box_key % 37 = 0 THEN CAST('infinity' AS DOUBLE) WHEN box_key % 37 = 1 THEN CAST('nan' AS DOUBLE) ELSE x END AS dist_from_ego,
  CASE WHEN box_key % 41 = 0 THEN score + 1 WHEN box_key % 41 = 1 THEN CAST('nan' AS DOUBLE) ELSE score END AS detection_score,
  CASE WHEN box_key % 43 = 0 THEN -w ELSE w END AS box_width, l AS box_length
FROM {boxes}
"""


@query(
    """SELECT count(*) AS n_before, count(*) FILTER (NOT a) AS dropped_finite, count(*) FILTER (a AND NOT b) AS dropped_score, count(*) FILTER (a AND b AND NOT c) AS dropped_dimensions, count(*) FILTER (a AND b AND c AND NOT e) AS dropped_known, count(*) FILTER (a AND b AND c AND e) AS n_after
       FROM (SELECT NOT isinf(dist_from_ego) AS a, detection_score >= 0 AND detection_score <= 1 AND NOT isnan(detection_score) AS b, box_width > 0 AND box_length > 0 AS c, class_id BETWEEN 0 AND 9 AS e FROM dirty)""",
    dirty=_DIRTY.format(boxes="boxes"),
)
def clean_filters(spark: SparkSession, d: str) -> DataFrame:
    return cleaning.summary(spark.sql(_DIRTY, boxes=X.boxes(spark, d)))


@query("SELECT count(*) FILTER (isnan(dist_from_ego)) AS dist_from_ego, count(*) FILTER (isnan(detection_score)) AS detection_score FROM dirty", dirty=_DIRTY.format(boxes="boxes"))
def missing_counts(spark: SparkSession, d: str) -> DataFrame:
    return cleaning.missing_counts(spark.sql(_DIRTY, boxes=X.boxes(spark, d)).select("dist_from_ego", "detection_score"))


@query("SELECT box_key, round(least(x*x*x, cap), 6) AS dist_from_ego FROM boxes, (SELECT 3*quantile_cont(x*x*x, 0.5) AS cap FROM boxes)")
def winsorise_distance(spark: SparkSession, d: str) -> DataFrame:
    rows = X.boxes(spark, d).select("box_key", F.expr("x*x*x").alias("dist_from_ego"))
    return rounded(cleaning.winsorise(rows, at=0.5), "dist_from_ego")


@query("SELECT class_id, n, round(tp_rate, 6) AS tp_rate FROM (SELECT CAST(unnest(range(10)) AS INT) AS class_id) LEFT JOIN (SELECT class_id, count(*) AS n, avg(label) AS tp_rate FROM rows GROUP BY class_id) USING (class_id)", **_ROWS)
def tp_rate_by_class(spark: SparkSession, d: str) -> DataFrame:
    classes = spark.range(10).select(F.col("id").cast("int").alias("class_id"))
    return rounded(analytics.rate_by_class(router_rows(spark, d), classes), "tp_rate")


@query("SELECT expert_ix, count(*) AS n, round(avg(label), 6) AS tp_rate FROM rows GROUP BY expert_ix", **_ROWS)
def tp_rate_by_expert(spark: SparkSession, d: str) -> DataFrame:
    return rounded(analytics.rate_by(router_rows(spark, d), "expert_ix"), "tp_rate")


@query("SELECT expert_ix, " + ", ".join(f"round(avg(label) FILTER (class_id = {k}), 6) AS class_{k}" for k in range(3)) + " FROM rows GROUP BY expert_ix", **_ROWS)
def tp_rate_pivot(spark: SparkSession, d: str) -> DataFrame:
    return rounded(analytics.rate_pivot(router_rows(spark, d), "expert_ix", "class_id", [0, 1, 2]), "class_0", "class_1", "class_2")


@query("SELECT CAST(CASE WHEN expert_agreement < 0.2 THEN 0 WHEN expert_agreement < 0.4 THEN 1 WHEN expert_agreement < 0.6 THEN 2 WHEN expert_agreement < 0.8 THEN 3 ELSE 4 END AS INT) AS bin, count(*) AS n, round(avg(label), 6) AS tp_rate FROM rows GROUP BY 1", **_ROWS)
def agreement_bins(spark: SparkSession, d: str) -> DataFrame:
    return rounded(analytics.agreement_bins(router_rows(spark, d)), "tp_rate")


_PAIRS = [(a, b) for i, a in enumerate(NUMERIC) for b in NUMERIC[i + 1 :]]


@query(" UNION ALL ".join(f"SELECT '{c}' AS feature, round(corr({c}, label), 6) AS r, coalesce(abs(corr({c}, label)) >= 0.3, false) AS strong FROM rows" for c in NUMERIC), **_ROWS)
def feature_corr(spark: SparkSession, d: str) -> DataFrame:
    return rounded(analytics.label_correlations(router_rows(spark, d), NUMERIC), "r")


@query("SELECT a, b, round(r, 6) AS r, abs(r) > 0.9999 AS duplicate FROM (" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM rows" for a, b in _PAIRS) + ") WHERE abs(r) >= 0.65", **_ROWS)
def redundant_pairs(spark: SparkSession, d: str) -> DataFrame:
    return rounded(analytics.redundant(router_rows(spark, d), NUMERIC), "r")


@query("SELECT CAST(least(floor(score/(1.0::DOUBLE/60)), 59) AS INT) AS bin, count(*) AS n, round(count(*)/(sum(count(*)) OVER ()*(1.0::DOUBLE/60)), 6) AS density FROM boxes GROUP BY 1")
def score_histogram(spark: SparkSession, d: str) -> DataFrame:
    return rounded(analytics.histogram(X.boxes(spark, d), "score"), "density")


@query("SELECT class_id, count(*) AS n, CAST(sum(label) AS BIGINT) AS positives, round((count(*) - sum(label))/greatest(sum(label), 1), 6) AS weight FROM rows GROUP BY class_id", **_ROWS)
def class_weights(spark: SparkSession, d: str) -> DataFrame:
    return rounded(analytics.class_weights(router_rows(spark, d)), "weight")


@query("SELECT count(*) AS n, CAST(sum(label) AS BIGINT) AS positives, round(avg(label), 6) AS positive_rate, count(DISTINCT scene_id) AS frames, count(DISTINCT expert_ix) AS experts, count(DISTINCT class_id) AS classes FROM rows", **_ROWS)
def dataset_summary(spark: SparkSession, d: str) -> DataFrame:
    return rounded(analytics.dataset_summary(router_rows(spark, d), "scene_id", "expert_ix"), "positive_rate")


@query("SELECT scene_id, frame_idx, count(*) AS count FROM boxes GROUP BY ALL ORDER BY count DESC, scene_id, frame_idx LIMIT 3")
def top_frames(spark: SparkSession, d: str) -> DataFrame:
    """A top-k report."""
    return analytics.top_frames(X.boxes(spark, d), FRAME)


_CURVE = {
    "st": "SELECT class_id, detection_score AS s, sum(label) AS t, count(*) AS n FROM rows GROUP BY ALL",
    "cu": "SELECT *, sum(t) OVER w AS tp, sum(n) OVER w AS seen, sum(t) OVER (PARTITION BY class_id) AS pos, sum(n) OVER (PARTITION BY class_id) AS total FROM st WINDOW w AS (PARTITION BY class_id ORDER BY s DESC)",
}


@query("SELECT class_id, CAST(max(total) AS BIGINT) AS n, CAST(max(pos) AS BIGINT) AS positives, round(sum(t/pos*tp/seen), 6) AS ap FROM cu GROUP BY class_id", **_ROWS, **_CURVE)
def average_precision(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.average_precision(router_rows(spark, d), ["class_id"], "detection_score"), "ap")


@query("SELECT class_id, round(sum(t*((total - pos) - (seen - tp) + (n - t)/2)/(pos*(total - pos))), 6) AS auc FROM cu GROUP BY class_id", **_ROWS, **_CURVE)
def roc_auc(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.roc_auc(router_rows(spark, d), ["class_id"], "detection_score"), "auc")


_SPLIT_AP = {
    "sp": "SELECT class_id, scene_id % 10 < 6 AS fit, detection_score AS s, sum(label) AS t, count(*) AS n FROM rows GROUP BY ALL",
    "sc": "SELECT *, sum(t) OVER w AS tp, sum(n) OVER w AS seen, sum(t) OVER (PARTITION BY class_id, fit) AS pos FROM sp WINDOW w AS (PARTITION BY class_id, fit ORDER BY s DESC)",
    "sa": "SELECT class_id, fit, sum(t/pos*tp/seen) AS ap FROM sc GROUP BY ALL",
}


@query(
    "SELECT class_id, round(a.ap, 6) AS train_ap, round(b.ap, 6) AS eval_ap, CASE WHEN a.ap - b.ap > 0.15 THEN 'overfitting risk' WHEN a.ap < 0.3 AND b.ap < 0.3 THEN 'underfitting risk' ELSE 'OK' END AS diagnosis FROM sa a JOIN sa b USING (class_id) WHERE a.fit AND NOT b.fit",
    **_ROWS,
    **_SPLIT_AP,
)
def gap_diagnosis(spark: SparkSession, d: str) -> DataFrame:
    ap = metrics.average_precision(router_rows(spark, d).withColumn("fit", F.col("scene_id") % 10 < 6), ["class_id", "fit"], "detection_score")
    both = ap.groupBy("class_id").agg(F.max(F.when(F.col("fit"), F.col("ap"))).alias("train_ap"), F.max(F.when(~F.col("fit"), F.col("ap"))).alias("eval_ap")).filter("train_ap is not null and eval_ap is not null")
    return rounded(both.withColumn("diagnosis", scoring.diagnosis(F.col("train_ap"), F.col("eval_ap"))), "train_ap", "eval_ap")


@query(
    """SELECT class_id, round(f, 6) AS fused_value, CAST(expert_ix AS VARCHAR) AS best_expert, round(r, 6) AS best_value, round(f - r, 6) AS delta, f - r > 0 AS won
       FROM (SELECT class_id, expert_ix, avg(label) AS r, avg(avg(label)) OVER (PARTITION BY class_id) AS f, row_number() OVER (PARTITION BY class_id ORDER BY avg(label) DESC, CAST(expert_ix AS VARCHAR)) AS k FROM rows GROUP BY class_id, expert_ix) WHERE k = 1""",
    **_ROWS,
)
def best_expert_delta(spark: SparkSession, d: str) -> DataFrame:
    """The mean over experts stands for the fused result."""
    each = router_rows(spark, d).groupBy("class_id", F.col("expert_ix").cast("string").alias("expert")).agg(F.avg("label").alias("ap"))
    fused = each.groupBy("class_id").agg(F.avg("ap").alias("ap")).select("class_id", F.lit("fused").alias("expert"), "ap")
    return rounded(analytics.best_expert(each.unionByName(fused)), "fused_value", "best_value", "delta")


_DESCRIBE = ("detection_score", "max_peer_iou", "dist_from_ego")


@query(
    " UNION ALL ".join(
        f"SELECT '{c}' AS feature, CAST(count({c}) AS DOUBLE) AS count, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, min({c}) AS min, round(quantile_cont({c}, 0.25), 6) AS p25, round(quantile_cont({c}, 0.5), 6) AS p50, round(quantile_cont({c}, 0.75), 6) AS p75, round(max({c}), 6) AS max FROM rows"
        for c in _DESCRIBE
    ),
    **_ROWS,
)
def describe(spark: SparkSession, d: str) -> DataFrame:
    return rounded(analytics.describe(router_rows(spark, d), list(_DESCRIBE)), "mean", "std", "p25", "p50", "p75", "max")


def _ap_of(s: str) -> str:
    steps = f"SELECT class_id, {s} AS s, sum(label) AS t, count(*) AS n FROM rows GROUP BY ALL"
    upto = "SELECT *, sum(t) OVER w AS tp, sum(n) OVER w AS seen, sum(t) OVER (PARTITION BY class_id) AS pos FROM st WINDOW w AS (PARTITION BY class_id ORDER BY s DESC)"
    return f"(WITH st AS ({steps}), cu AS ({upto}) SELECT class_id, sum(t/pos*tp/seen) AS ap FROM cu GROUP BY class_id)"


@query(
    f"SELECT class_id, n, round(positive_rate, 6) AS positive_rate, round(a.ap, 6) AS detection_score_ap, round(b.ap, 6) AS max_peer_iou_ap FROM (SELECT class_id, count(*) AS n, avg(label) AS positive_rate FROM rows GROUP BY class_id) JOIN {_ap_of('detection_score')} a USING (class_id) JOIN {_ap_of('round(max_peer_iou, 9)')} b USING (class_id) WHERE positive_rate > 0",
    **_ROWS,
)
def router_table(spark: SparkSession, d: str) -> DataFrame:
    rows = router_rows(spark, d).withColumn("max_peer_iou", F.round("max_peer_iou", 9))
    return rounded(analytics.router_table(rows, ["detection_score", "max_peer_iou"]), "positive_rate", "detection_score_ap", "max_peer_iou_ap")


# -- whole pipelines ----------------------------------------------------------------------------


def ap_sql(t: float) -> dict[str, str]:
    ctes = match_sql("m", _CLASS, "", _GD, f"< {t}", f"{_GD}, b.gt_pos")
    ctes["ng"] = "SELECT class_ix, count(*) AS n_gt FROM gt GROUP BY class_ix"
    ctes["pr"] = "SELECT class_ix, n_gt, sum(label) OVER w AS tp, count(*) OVER w AS seen FROM m JOIN ng USING (class_ix) WINDOW w AS (PARTITION BY class_ix ORDER BY score DESC, scene_id, frame_idx, box_key ROWS UNBOUNDED PRECEDING)"
    ctes["pt"] = "SELECT class_ix, n_gt, tp, arg_min(tp/seen, seen) AS f, arg_max(tp/seen, seen) AS l FROM pr GROUP BY ALL"
    ctes["sg"] = "SELECT class_ix, tp/n_gt AS r1, f, l, lag(tp/n_gt) OVER w AS r0, lag(l) OVER w AS p0 FROM pt WINDOW w AS (PARTITION BY class_ix ORDER BY tp)"
    ctes["gd"] = "SELECT class_ix, k, CASE WHEN k/100 = r1 THEN l WHEN r0 IS NULL THEN f ELSE p0 + (f - p0)*(k/100 - r0)/(r1 - r0) END AS p FROM sg, (SELECT unnest(range(11, 101)) AS k) WHERE k/100 <= r1 AND (r0 IS NULL OR k/100 > r0)"
    return ctes


@query(f"SELECT class_ix, CAST(2.0 AS DOUBLE) AS threshold, round(coalesce(sum(greatest(p - 0.1, 0))/90/0.9, 0), 6) AS ap FROM ng LEFT JOIN gd USING (class_ix) GROUP BY class_ix", **ap_sql(2.0))
def detection_eval(spark: SparkSession, d: str) -> DataFrame:
    out = metrics.detection_ap(X.boxes(spark, d), X.gt(spark, d), FRAME, "class_ix", order=ORDER, thresholds=(2.0,))
    return rounded(out, "ap")


_DRAFT = {"peers": _PEERS, "gated": _GATED, "over": f"SELECT * EXCLUDE (score), round(gated, 9) AS score FROM gated WHERE gated >= {_THR}"}


@query("SELECT box_key, scene_id, frame_idx, class_ix, score FROM kept", **_DRAFT, **nms_sql("over", "scene_id, frame_idx, class_ix", "kept"))
def draft_labels(spark: SparkSession, d: str) -> DataFrame:
    """Features, gate, threshold, suppression, cap: the labels of each frame."""
    rows = _gated(spark, d).withColumn("class_name", F.element_at(F.array(F.lit("car"), F.lit("truck"), F.lit("trailer")), F.col("class_ix") + 1))
    over = scoring.over_threshold(rows.withColumn("score", F.col("gated"))).withColumn("score", F.round("score", 9))
    kept = nms.suppress(over, FRAME, "class_ix", order=ORDER)
    return nms.cap(kept, FRAME, order=("class_ix", "box_key")).select("box_key", *FRAME, "class_ix", "score")


from boxfusion.plans import crowd_nms_queries, crowd_queries, evaluation_queries, more_queries, raster_queries, recovery_queries, submission_queries, training_queries  # noqa: E402, F401 - register further queries
