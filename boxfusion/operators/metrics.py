"""Ranking metrics and the detection evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxfusion.operators import evaluation
from boxfusion.operators.evaluation import ERRORS, THRESHOLDS, box_errors  # noqa: F401
from boxfusion.operators.ranking import part_of, running
from boxfusion.schemas import lookup


def curve(rows: DataFrame, by: list[str], score: str = "score", label: str = "label", count: str | None = None) -> DataFrame:
    """Per distinct score of each group: tp and fp at that threshold, and the totals.  ``count``: a column for how many
    rows a row stands for, ``label`` then being how many of them are positive."""
    steps = rows.groupBy(*by, score).agg(F.sum(label).alias("t"), (F.sum(count) if count else F.count("*")).alias("n"))
    out = running(steps, by, part_of(F.col(score)), [F.col(score).desc()], {"tp": F.col("t"), "seen": F.col("n")}, ("tp", "seen"))
    return out.withColumnsRenamed({"total_tp": "positives", "total_seen": "rows"})


def average_precision(rows: DataFrame, by: list[str], score: str = "score", label: str = "label", count: str | None = None) -> DataFrame:
    """Sum over thresholds of the gain in recall times precision; null without positives.  ``count``: as of ``curve``."""
    c = curve(rows, by, score, label, count)
    return c.groupBy(*by).agg(F.max("rows").alias("n"), F.max("positives").alias("positives"), F.sum(F.when(F.col("positives") > 0, F.col("t") / F.col("positives") * F.col("tp") / F.col("seen"))).alias("ap"))


def roc_auc(rows: DataFrame, by: list[str], score: str = "score", label: str = "label") -> DataFrame:
    """The chance that a positive scores above a negative, ties counted half; null if either lacks."""
    c = curve(rows, by, score, label)
    negatives = F.col("rows") - F.col("positives")
    fp, own = F.col("seen") - F.col("tp"), F.col("n") - F.col("t")
    # positives of this score beat the negatives of lesser scores and half of those of their own
    won = F.col("t") * (negatives - fp + own / 2)
    return c.groupBy(*by).agg(F.sum(F.when((F.col("positives") > 0) & (negatives > 0), won / (F.col("positives") * negatives))).alias("auc"))


def ranking_figures(rows: DataFrame, by: list[str], score: str = "score", label: str = "label", count: str | None = None) -> DataFrame:
    """(by, n, positives, ap, auc): ``average_precision`` and ``roc_auc`` by one curve."""
    c = curve(rows, by, score, label, count)
    positives, negatives = F.col("positives"), F.col("rows") - F.col("positives")
    won = F.col("t") * (negatives - (F.col("seen") - F.col("tp")) + (F.col("n") - F.col("t")) / 2)
    ap = F.sum(F.when(positives > 0, F.col("t") / positives * F.col("tp") / F.col("seen")))
    auc = F.sum(F.when((positives > 0) & (negatives > 0), won / (positives * negatives)))
    return c.groupBy(*by).agg(F.max("rows").alias("n"), F.max("positives").alias("positives"), ap.alias("ap"), auc.alias("auc"))


RANGES = {"car": 50.0, "truck": 50.0, "bus": 50.0, "trailer": 50.0, "construction_vehicle": 50.0, "pedestrian": 40.0, "motorcycle": 40.0, "bicycle": 40.0, "traffic_cone": 30.0, "barrier": 30.0}


def detection_ap(preds: DataFrame, gts: DataFrame, frame: list[str], class_col: str = "class_name", model: tuple[str, ...] = (), order: tuple[str, ...] = ("expert_ord", "box_pos"), thresholds: tuple[float, ...] = THRESHOLDS, min_recall: float = 0.1, min_precision: float = 0.1) -> DataFrame:
    """(model, class, threshold, ap): nearest free ground truth of the frame within the threshold, in
    the order of score over all frames; precision at 101 recalls, from which ``min_precision`` is
    taken and the recalls up to ``min_recall`` are left out.

    A match depends on nothing outside its frame and class, so frames are folded by themselves and
    only their verdicts are ranked together."""
    n_gt = gts.groupBy(class_col).agg(F.count("*").alias("n_gt"))
    found = evaluation.verdicts(preds, gts, [*frame, class_col], model, order=order, thresholds=thresholds)
    every = n_gt.select(class_col)
    if model:  # models, like classes and thresholds, are few
        named = preds.agg(F.collect_set(F.struct(*model)).alias("m")).scalar()
        every = every.withColumn("m", F.explode(named)).select("m.*", class_col)
    by = [*model, class_col]
    each = evaluation.evaluate(found, n_gt, by, [*frame, *order], class_col, thresholds, min_recall=min_recall, min_precision=min_precision, every=every)
    return each.select(*by, F.explode(F.arrays_zip(F.array(*map(F.lit, thresholds)).alias("threshold"), F.col("aps").alias("ap"))).alias("z")).select(*by, "z.threshold", "z.ap")


def tp_errors(verdicts: DataFrame, by: list[str], tie: list[str], class_col: str = "class_name", errors: tuple[str, ...] = ERRORS, min_recall: float = 0.1) -> DataFrame:
    """(by, error columns): the mean over recalls above ``min_recall`` of each error's running mean, read
    off at the confidence of the recall; 1 where that recall is not reached, NaN where undefined.

    verdicts: by, score, label, n_gt and, where label is 1, the errors."""
    rows = verdicts.withColumn("hits", F.array(F.when(F.col("label") == 1, F.lit(0))))
    n_gt = verdicts.groupBy(class_col).agg(F.max("n_gt").alias("n_gt"))
    found = evaluation.evaluate(rows.drop("n_gt"), n_gt, by, tie, class_col, (2.0,), 2.0, errors, min_recall)
    return found.drop("aps")


def detection_score(ap: DataFrame, errors: DataFrame, model: tuple[str, ...] = ()) -> DataFrame:
    """(model, mean_ap, one mean for each error, nds): classes for which an error is undefined do not
    count in its mean.  ap: as of detection_ap; errors: as of tp_errors."""
    names = [e for e in ERRORS if e in errors.columns]
    one = [] if model else [F.lit(0).alias("__all__")]
    a = ap.groupBy(*model, *one).agg(F.avg("ap").alias("mean_ap"))
    e = errors.groupBy(*model, *one).agg(*[F.avg(F.when(~F.isnan(n), F.col(n))).alias(n) for n in names])
    key = list(model) or ["__all__"]
    both = a.join(e, key)
    total = sum((1 - F.least(F.lit(1.0), F.coalesce(n, F.lit(1.0))) for n in names), F.lit(0.0))
    return both.withColumn("nds", (5 * F.col("mean_ap") + total) / (5 + len(names))).drop("__all__")


def in_range(boxes: DataFrame, ego: DataFrame, frame: list[str], class_col: str = "class_name") -> DataFrame:
    """Boxes within their class's range of the ego pose (frame, ego_x, ego_y)."""
    met = boxes.join(ego.select(*frame, "ego_x", "ego_y"), frame)
    near = F.sqrt(F.pow(F.col("x") - F.col("ego_x"), 2) + F.pow(F.col("y") - F.col("ego_y"), 2)) < lookup(RANGES, F.col(class_col), 50.0)
    return met.filter(near).drop("ego_x", "ego_y")
