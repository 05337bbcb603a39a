"""The detection evaluation from boxes and ground truth to one score, for each expert."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxfusion.operators import evaluation
from boxfusion.plans import fixtures as X
from boxfusion.plans.queries import _CLASS, _GD, FRAME, ORDER, match_sql, query, rounded

ERRORS = evaluation.ERRORS
NAMED = "CASE class_ix WHEN 0 THEN 'car' WHEN 1 THEN 'traffic_cone' ELSE 'barrier' END"
#: What the fixture lacks; every fourth truth has no attribute.
MADE = {
    "yaw": "CAST((box_key % 5)*0.5 AS DOUBLE)", "vx": "CAST((box_key % 4)*0.25 AS DOUBLE)", "vy": "CAST((box_key % 3)*0.5 AS DOUBLE)",
    "attribute": "CASE box_key % 4 WHEN 0 THEN '' WHEN 1 THEN 'moving' ELSE 'parked' END",
}
_MADE = ", ".join(f"{v} AS {k}" for k, v in MADE.items())


def per_class(spark: SparkSession, d: str) -> DataFrame:
    """(expert_ix, class_name, aps, errors) over all frames."""
    made = [f"{v} AS {k}" for k, v in MADE.items()]
    preds = X.boxes(spark, d).selectExpr(*FRAME, "box_key", "expert_ix", f"{NAMED} AS class_name", *"xywl", "CAST(1.5 AS DOUBLE) AS h", *made, "score")
    gts = X.gt(spark, d).selectExpr("*", "gt_pos*7 + scene_id AS box_key").selectExpr(*FRAME, "gt_pos", f"{NAMED} AS class_name", *"xywl", "CAST(2.0 AS DOUBLE) AS h", *made)
    found = evaluation.with_errors(evaluation.verdicts(preds, gts, [*FRAME, "class_name"], ("expert_ix",), order=ORDER, at=2.0))
    n_gt = gts.groupBy("class_name").agg(F.count("*").alias("n_gt"))
    return evaluation.evaluate(found, n_gt, ["expert_ix", "class_name"], [*FRAME, *ORDER], "class_name", at=2.0, errors=ERRORS)


def _curve_sql(k: int, t: float) -> dict[str, str]:
    """The curve of a threshold by windows over whole classes: precision and confidence at the levels."""
    by = "expert_ix, class_ix"
    return match_sql(f"m{k}", _CLASS, "expert_ix", _GD, f"< {t}", f"{_GD}, b.gt_pos") | {
        f"pr{k}": f"SELECT {by}, n_gt, score, sum(label) OVER w AS tp, count(*) OVER w AS seen FROM m{k} JOIN ng USING (class_ix) WINDOW w AS (PARTITION BY {by} ORDER BY score DESC, scene_id, frame_idx, box_key ROWS UNBOUNDED PRECEDING)",
        f"pt{k}": f"SELECT {by}, n_gt, tp, arg_min(tp/seen, seen) AS f, arg_max(tp/seen, seen) AS l, arg_min(score, seen) AS cf, arg_max(score, seen) AS cl FROM pr{k} GROUP BY ALL",
        f"sg{k}": f"SELECT {by}, tp/n_gt AS r1, f, l, cf, cl, lag(tp/n_gt) OVER w AS r0, lag(l) OVER w AS p0, lag(cl) OVER w AS c0 FROM pt{k} WINDOW w AS (PARTITION BY {by} ORDER BY tp)",
        f"gd{k}": f"""SELECT {by}, k, CASE WHEN k/100 = r1 THEN l WHEN r0 IS NULL THEN f ELSE p0 + (f - p0)*(k/100 - r0)/(r1 - r0) END AS p,
            CASE WHEN k/100 = r1 THEN cl WHEN r0 IS NULL THEN cf ELSE c0 + (k/100 - r0)/(r1 - r0)*(cf - c0) END AS c
            FROM sg{k}, (SELECT unnest(range(11, 101)) AS k) WHERE k/100 <= r1 AND (r0 IS NULL OR k/100 > r0)""",
        f"ap{k}": f"SELECT {by}, sum(greatest(p - 0.1, 0))/90/0.9 AS ap{k} FROM gd{k} GROUP BY {by}",
    }


_EVAL: dict[str, str] = {"ng": "SELECT class_ix, count(*) AS n_gt FROM gt GROUP BY class_ix"}
for _k, _t in enumerate(evaluation.THRESHOLDS):
    _EVAL |= _curve_sql(_k, _t)
_EVAL["tpe"] = f"""
SELECT p.expert_ix, p.class_ix, p.score, row_number() OVER w AS rn, sqrt((p.x - g.x)*(p.x - g.x) + (p.y - g.y)*(p.y - g.y)) AS trans_err,
  1 - least(p.w, g.w)*least(p.l, g.l)*1.5/(p.w*p.l*1.5 + g.w*g.l*2 - least(p.w, g.w)*least(p.l, g.l)*1.5) AS scale_err,
  abs(CASE WHEN p.class_ix = 2 THEN turn - pi()*floor((turn + pi()/2)/pi()) ELSE turn - 2*pi()*floor((turn + pi())/(2*pi())) END) AS orient_err,
  sqrt((p.vx - g.vx)*(p.vx - g.vx) + (p.vy - g.vy)*(p.vy - g.vy)) AS vel_err, CASE WHEN g.attribute <> '' THEN CAST(p.attribute <> g.attribute AS DOUBLE) END AS attr_err
FROM (SELECT *, {_MADE} FROM m2 WHERE label = 1) p
JOIN (SELECT * EXCLUDE (box_key), {_MADE} FROM (SELECT *, gt_pos*7 + scene_id AS box_key FROM gt)) g ON p.scene_id = g.scene_id AND p.frame_idx = g.frame_idx AND p.class_ix = g.class_ix AND p.matched = g.gt_pos,
LATERAL (SELECT p.yaw - g.yaw AS turn) WINDOW w AS (PARTITION BY p.expert_ix, p.class_ix ORDER BY p.score DESC, p.scene_id, p.frame_idx, p.box_key)
"""
_EVAL["tpm"] = "SELECT expert_ix, class_ix, score, rn, " + ", ".join(
    f"CASE WHEN count({e}) OVER a = 0 THEN 1 WHEN count({e}) OVER w = 0 THEN 0 ELSE sum({e}) OVER w / count({e}) OVER w END AS {e}" for e in ERRORS
) + " FROM tpe WINDOW a AS (PARTITION BY expert_ix, class_ix), w AS (PARTITION BY expert_ix, class_ix ORDER BY rn)"
#: At a confidence: the first of the true positives of the nearest score at or below it, and the last of the nearest above.
_STRUCT = ", ".join(f"'{e}': {e}" for e in (*ERRORS, "score"))
_EVAL["lohi"] = f"""SELECT d.expert_ix, d.class_ix, d.k, any_value(d.c) AS c, arg_max({{{_STRUCT}}}, t.score*1e9 - t.rn) FILTER (t.score <= d.c) AS lo, arg_min({{{_STRUCT}}}, t.score*1e9 - t.rn) FILTER (t.score > d.c) AS hi
FROM gd2 d JOIN tpm t USING (expert_ix, class_ix) WHERE d.c > 0 GROUP BY ALL"""
_EVAL["errs"] = "SELECT expert_ix, class_ix, " + ", ".join(
    f"avg(CASE WHEN lo IS NULL THEN hi.{e} WHEN hi IS NULL OR lo.score = c THEN lo.{e} ELSE lo.{e} + (c - lo.score)/(hi.score - lo.score)*(hi.{e} - lo.{e}) END) AS {e}" for e in ERRORS
) + " FROM lohi GROUP BY expert_ix, class_ix"
_NAN = {"orient_err": "class_ix = 1", "vel_err": "class_ix > 0", "attr_err": "class_ix > 0"}
_EVAL["per"] = (
    "SELECT expert_ix, class_ix, " + ", ".join(f"coalesce(ap{k}, 0) AS ap{k}" for k in range(4)) + ", "
    + ", ".join(f"CASE WHEN {_NAN.get(e, 'false')} THEN CAST('NaN' AS DOUBLE) ELSE coalesce({e}, 1) END AS {e}" for e in ERRORS)
    + " FROM (SELECT DISTINCT expert_ix, class_ix FROM boxes) " + " ".join(f"LEFT JOIN ap{k} USING (expert_ix, class_ix)" for k in range(4)) + " LEFT JOIN errs USING (expert_ix, class_ix)"
)


@query(f"SELECT expert_ix, {NAMED} AS class_name, " + ", ".join(f"round({c}, 6) AS {c}" for c in (*(f"ap{k}" for k in range(4)), *ERRORS)) + " FROM per", **_EVAL)
def detection_evaluation(spark: SparkSession, d: str) -> DataFrame:
    """Precision at four thresholds and the five errors of each expert and class."""
    out = per_class(spark, d)
    return rounded(out.select("expert_ix", "class_name", *[F.get("aps", F.lit(k)).alias(f"ap{k}") for k in range(4)], *ERRORS), *[f"ap{k}" for k in range(4)], *ERRORS)


@query(
    f"""SELECT expert_ix, round(m, 6) AS mean_ap, {", ".join(f"round({e}, 6) AS {e}" for e in ERRORS)}, round((5*m + {" + ".join(f"1 - least(1, coalesce({e}, 1))" for e in ERRORS)})/10, 6) AS nds
       FROM (SELECT expert_ix, avg((ap0 + ap1 + ap2 + ap3)/4) AS m, {", ".join(f"avg({e}) FILTER (NOT isnan({e})) AS {e}" for e in ERRORS)} FROM per GROUP BY expert_ix)""",
    **_EVAL,
)
def detection_score(spark: SparkSession, d: str) -> DataFrame:
    """One score for each expert, from boxes and ground truth; errors that mean nothing do not count."""
    return rounded(evaluation.score(per_class(spark, d), ("expert_ix",)), "mean_ap", *ERRORS, "nds")
