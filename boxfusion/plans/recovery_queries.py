"""What experts and their fused boxes recover, from one matching; gaps between training and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxfusion.operators import analytics, nms, recovery
from boxfusion.plans import fixtures as X
from boxfusion.plans.queries import _CLASS, _GD, _NMS, _ROWS, FRAME, KEYS, ORDER, match_sql, query, rounded, router_rows

FUSED = 5
_BOTH = _NMS | {"pooled": f"SELECT * FROM boxes UNION ALL SELECT * REPLACE (CAST({FUSED} AS INT) AS expert_ix) FROM (SELECT * EXCLUDE (rk) FROM kept)"}
_FOUND = _BOTH | match_sql("m", _CLASS, "expert_ix", _GD, "< 2.0", f"{_GD}, b.gt_pos", preds="pooled")
_FOUND["found"] = """SELECT scene_id, frame_idx, gt_pos, any_value(class_ix) AS class_ix, list_sort(list(DISTINCT expert_ix) FILTER (expert_ix IS NOT NULL)) AS finders
    FROM gt LEFT JOIN (SELECT scene_id, frame_idx, class_ix, matched AS gt_pos, expert_ix FROM m WHERE matched IS NOT NULL) USING (scene_id, frame_idx, class_ix, gt_pos) GROUP BY ALL"""
_FOUND["sets"] = f"SELECT *, coalesce(len(list_filter(finders, lambda e: e < {FUSED})), 0) AS k, coalesce(list_contains(finders, {FUSED}), false) AS fused FROM found"


def found(spark: SparkSession, d: str) -> DataFrame:
    """The boxes kept of all experts' are the fused source."""
    boxes = X.boxes(spark, d)
    kept = nms.suppress(boxes, FRAME, "class_ix", order=ORDER).select(*boxes.columns).withColumn("expert_ix", F.lit(FUSED))
    return recovery.masks(boxes.unionByName(kept), X.gt(spark, d), KEYS, FUSED + 1, "expert_ix", ORDER, frame=FRAME)


@query(
    """SELECT class_ix, count(*) AS n_gt, count(*) FILTER (k = 0) AS n_none, count(*) FILTER (k = 1) AS n_one, count(*) FILTER (k = 5) AS n_all, count(*) FILTER (fused) AS n_fused,
       count(*) FILTER (fused AND k = 1) AS fused_unique, count(*) FILTER (fused AND k = 0) AS fused_new, count(*) FILTER (NOT fused AND k > 0) AS fused_lost FROM sets GROUP BY class_ix""",
    **_FOUND,
)
def recovery_counts(spark: SparkSession, d: str) -> DataFrame:
    return recovery.counts(found(spark, d), FUSED, FUSED, ("class_ix",))


@query(
    """SELECT CAST(source AS INT) AS source, (SELECT count(*) FROM gt) AS n_gt, count(*) FILTER (list_contains(finders, source)) AS recovered, count(*) FILTER (finders = [source]) AS only,
       round(count(*) FILTER (list_contains(finders, source)) / (SELECT count(*) FROM gt), 6) AS recall FROM sets, (SELECT unnest(range(6)) AS source) GROUP BY source""",
    **_FOUND,
)
def recovery_sources(spark: SparkSession, d: str) -> DataFrame:
    return rounded(recovery.by_source(found(spark, d), FUSED + 1), "recall")


@query(
    """SELECT CAST(a AS INT) AS a, CAST(b AS INT) AS b, count(*) FILTER (ina AND inb) AS both, count(*) FILTER (ina AND NOT inb) AS only_a, count(*) FILTER (inb AND NOT ina) AS only_b, count(*) FILTER (ina OR inb) AS either
       FROM (SELECT a, b, coalesce(list_contains(finders, a), false) AS ina, coalesce(list_contains(finders, b), false) AS inb FROM sets, (SELECT unnest(range(6)) AS a) x, (SELECT unnest(range(6)) AS b) y WHERE a < b) GROUP BY a, b""",
    **_FOUND,
)
def recovery_overlaps(spark: SparkSession, d: str) -> DataFrame:
    return recovery.overlaps(found(spark, d), FUSED + 1)


#: Three models over one row: its score, its peers' overlap, and their mean.
MODELS = {"score": "round(detection_score, 9)", "peers": "round(max_peer_iou, 9)", "blend": "round((detection_score + max_peer_iou) / 2, 9)"}


def _curves(rows: str, by: str) -> dict[str, str]:
    """Average precision (ap) and area (auc) of each group of ``by`` and model, from (by, model, s, label)."""
    return {
        "st": f"SELECT {by}, model, s, sum(label) AS t, count(*) AS n FROM {rows} GROUP BY ALL",
        "cu": f"SELECT *, sum(t) OVER w AS tp, sum(n) OVER w AS seen, sum(t) OVER g AS pos, sum(n) OVER g AS total FROM st WINDOW w AS (PARTITION BY {by}, model ORDER BY s DESC), g AS (PARTITION BY {by}, model)",
        "mt": f"SELECT {by}, model, CAST(max(total) AS BIGINT) AS n, sum(CASE WHEN pos > 0 THEN t/pos*tp/seen END) AS ap, sum(CASE WHEN pos > 0 AND total > pos THEN t*((total - pos) - (seen - tp) + (n - t)/2)/(pos*(total - pos)) END) AS auc FROM cu GROUP BY ALL",
    }


_LONG = {"long": " UNION ALL ".join(f"SELECT class_id, scene_id, label, '{m}' AS model, {e} AS s FROM rows" for m, e in MODELS.items())}
_GAPS = _ROWS | _LONG | {"sides": "SELECT *, scene_id % 10 < 6 AS fit FROM long"} | _curves("sides", "class_id, fit")
_GAPS["gaps"] = """SELECT class_id, a.model, a.n AS n_train, b.n AS n_eval, a.ap AS train_ap, b.ap AS eval_ap, a.ap - b.ap AS gap_ap, a.auc AS train_auc, b.auc AS eval_auc,
    CASE WHEN a.ap - b.ap > 0.15 THEN 'overfitting risk' WHEN a.ap < 0.3 AND b.ap < 0.3 THEN 'underfitting risk' ELSE 'OK' END AS diagnosis
    FROM mt a JOIN mt b USING (class_id, model) WHERE a.fit AND NOT b.fit AND b.ap IS NOT NULL"""
_SHOWN = ("train_ap", "eval_ap", "gap_ap", "train_auc", "eval_auc")


def long(spark: SparkSession, d: str) -> DataFrame:
    models = F.array(*[F.struct(F.lit(m).alias("model"), F.expr(e).alias("score")) for m, e in MODELS.items()])
    return router_rows(spark, d).select("class_id", "scene_id", "label", F.inline(models))


def gaps(spark: SparkSession, d: str) -> DataFrame:
    return analytics.gap_table(long(spark, d).withColumn("fit", F.col("scene_id") % 10 < 6), "fit")


@query(f"SELECT class_id, model, n_train, n_eval, {', '.join(f'round({c}, 6) AS {c}' for c in _SHOWN)}, diagnosis FROM gaps", **_GAPS)
def gap_table(spark: SparkSession, d: str) -> DataFrame:
    return rounded(gaps(spark, d), *_SHOWN)


@query("SELECT count(*) FILTER (diagnosis = 'overfitting risk') AS n_overfitting, count(*) FILTER (diagnosis = 'underfitting risk') AS n_underfitting, count(*) FILTER (diagnosis = 'OK') AS n_ok, count(*) AS n_pairs FROM gaps", **_GAPS)
def gap_flags(spark: SparkSession, d: str) -> DataFrame:
    return analytics.gap_flags(gaps(spark, d))


_FOLDS = _ROWS | _LONG | {"sides": "SELECT class_id, label, model, s, f AS fold, scene_id % 5 <> f AS fit FROM long, (SELECT unnest(range(5)) AS f)"} | _curves("sides", "class_id, fold, fit")
_FOLDS["gaps"] = "SELECT class_id, model, a.ap - b.ap AS gap FROM mt a JOIN mt b USING (class_id, fold, model) WHERE a.fit AND NOT b.fit AND b.ap IS NOT NULL"


@query(
    "SELECT class_id, model, round(avg(gap), 6) AS mean, round(stddev_samp(gap), 6) AS std, round(min(gap), 6) AS low, round(max(gap), 6) AS high, max(gap) - min(gap) > 0.3 AS unstable FROM gaps GROUP BY class_id, model",
    **_FOLDS,
)
def cv_gap_summary(spark: SparkSession, d: str) -> DataFrame:
    """Five folds of scenes: each row is evaluated in its own and trains the others."""
    # rows of one fold and score are one before they are told to all folds
    own = long(spark, d).groupBy("class_id", "model", "score", (F.col("scene_id") % 5).alias("own")).agg(F.sum("label").alias("label"), F.count("*").alias("rows"))
    folds = own.withColumn("fold", F.explode(F.array(*map(F.lit, range(5))))).withColumn("fit", F.col("own") != F.col("fold"))
    each = analytics.gap_table(folds, "fit", ["class_id", "fold", "model"], count="rows")
    out = analytics.gap_summary(each, ["class_id", "model"], "gap_ap")
    return rounded(out, "mean", "std", "low", "high")


_WINS = _ROWS | {"sides": "SELECT class_id, CAST(expert_ix AS VARCHAR) AS model, round(detection_score, 9) AS s, label FROM rows UNION ALL SELECT class_id, 'fused', round((detection_score + max_peer_iou)/2, 9), label FROM rows"} | _curves("sides", "class_id")
_WINS["wins"] = """SELECT class_id, max(ap) FILTER (model = 'fused') AS f, max(ap) FILTER (model <> 'fused') AS r FROM mt GROUP BY class_id"""


@query("SELECT count(*) AS n, count(*) FILTER (f - r > 0) AS n_won, round(avg(f - r), 6) AS mean_delta, round(min(f - r), 6) AS least_delta, round(max(f - r), 6) AS greatest_delta FROM wins WHERE f IS NOT NULL AND r IS NOT NULL", **_WINS)
def fused_wins(spark: SparkSession, d: str) -> DataFrame:
    """In how many classes the blend of all rows ranks better than the best expert's score ranks its own."""
    from boxfusion.operators.metrics import average_precision

    rows = router_rows(spark, d)
    each = F.array(F.struct(F.col("expert_ix").cast("string").alias("expert"), F.expr(MODELS["score"]).alias("score")), F.struct(F.lit("fused").alias("expert"), F.expr(MODELS["blend"]).alias("score")))
    ap = average_precision(rows.select("class_id", "label", F.inline(each)), ["class_id", "expert"], "score")
    return rounded(analytics.wins(analytics.best_expert(ap)), "mean_delta", "least_delta", "greatest_delta")
