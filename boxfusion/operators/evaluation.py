"""Detection evaluation as one plan: match, rank, interpolate, average.

A frame's predictions of a class are folded once, with what is taken at each distance threshold as state.  Verdicts are ranked
by model and class within ranges of the score (``ranking.running``), so that a class fills many tasks.  A recall level
lies between a true positive and the row before it, whose precision follows from the running sums and whose score is the
least before it; so levels are read off row by row, without a pass over a class's curve in one task.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxfusion.functions.geometry import distance
from boxfusion.operators.ranking import part_of, running
from boxfusion.operators.state import cut

THRESHOLDS = (0.5, 1.0, 2.0, 4.0)
#: Errors of matched boxes, and the classes for which each means nothing.
ERRORS = ("trans_err", "scale_err", "orient_err", "vel_err", "attr_err")
UNDEFINED = {"orient_err": ("traffic_cone",), "vel_err": ("traffic_cone", "barrier"), "attr_err": ("traffic_cone", "barrier")}


def verdicts(preds: DataFrame, gts: DataFrame, keys: list[str], model: tuple[str, ...] = (), score: str = "score", order: tuple[str, ...] = ("expert_ord", "box_pos"), gt_pos: str = "gt_pos", thresholds: tuple[float, ...] = THRESHOLDS, at: float | None = None) -> DataFrame:
    """``preds`` with ``hits``, for each threshold the gt_pos that the prediction takes or null, and ``gt``, the ground truth
    that it takes at the threshold ``at`` (null without ``at``).

    In the order of falling score, then ``order``, a prediction takes the nearest ground truth of its ``keys`` that is free
    at the threshold and nearer than it; of equally near ones the first.  Thresholds do not see each other's choices."""
    item = F.struct((-F.col(score)).alias("s"), *order, "x", "y", F.struct("*").alias("row"))
    # dealt by the keys at which the ground truth is met, so that groups of models need no shuffle of their own
    p = preds.repartition(*keys).groupBy(*keys, *model).agg(F.sort_array(F.collect_list(item)).alias("p"))
    truth = F.struct("*") if at is not None else F.struct(gt_pos)
    g = gts.groupBy(*keys).agg(F.collect_list(F.struct(F.col(gt_pos).cast("long").alias("pos"), "x", "y", truth.alias("row"))).alias("g"))
    most, n = max(thresholds), len(thresholds)
    limits = F.array(*map(F.lit, thresholds))

    def step(acc: Column, c: Column) -> Column:
        def take(near: Column) -> Column:
            best = lambda used, t: F.array_min(F.filter(near, lambda d: (d["d"] < t) & ~F.array_contains(used, d["pos"])))["pos"]
            return F.zip_with(acc["used"], limits, best)

        def note(picks: Column) -> Column:
            used = F.zip_with(acc["used"], picks, lambda u, m: F.when(m.isNull(), u).otherwise(F.concat(u, F.array(m))))
            return F.struct(used.alias("used"), F.concat(acc["out"], F.array(picks)).alias("out"))

        near = F.filter(F.transform("g", lambda t: F.struct(distance(c, t).alias("d"), t["pos"].alias("pos"))), lambda d: d["d"] < most)
        once = lambda value, body: F.get(F.transform(F.array(value), body), F.lit(0))
        return once(once(near, take), note)

    zero = F.struct(F.array_repeat(F.array().cast("array<bigint>"), n).alias("used"), F.array().cast("array<array<bigint>>").alias("out"))
    none = F.transform("p", lambda c: F.array_repeat(F.lit(None).cast("bigint"), n))
    hits = F.when(F.col("g").isNull(), none).otherwise(F.aggregate("p", zero, step, lambda acc: acc["out"]))
    found = p.join(g, keys, "left").select("p", "g", hits.alias("h"))
    chosen = lambda h: F.get(F.filter("g", lambda t: t["pos"] == F.get(h, F.lit(thresholds.index(at)))), F.lit(0))["row"] if at is not None else F.lit(None)
    rows = found.select(F.explode(F.zip_with("p", "h", lambda c, h: F.struct(c["row"].alias("row"), h.alias("hits"), chosen(h).alias("gt")))).alias("z"))
    return rows.select("z.row.*", "z.hits", "z.gt")


def box_errors(pairs: DataFrame, class_col: str = "class_name") -> DataFrame:
    """``pairs`` of a prediction and its ground truth (columns with suffix _gt) with ERRORS: distance, one
    minus the overlap of aligned sizes, least turn (a barrier looks alike both ways), speed
    difference, and whether attributes differ (null where the truth has none)."""
    g = lambda c: F.col(f"{c}_gt")
    inter = F.least("w", g("w")) * F.least("l", g("l")) * F.least("h", g("h"))
    union = F.col("w") * F.col("l") * F.col("h") + g("w") * g("l") * g("h") - inter
    period = F.when(F.col(class_col) == "barrier", F.lit(math.pi)).otherwise(F.lit(2 * math.pi))
    turn = F.pmod(F.col("yaw") - g("yaw") + period / 2, period) - period / 2
    return pairs.withColumns(
        {
            "trans_err": F.sqrt(F.pow(F.col("x") - g("x"), 2) + F.pow(F.col("y") - g("y"), 2)),
            "scale_err": 1 - inter / union,
            "orient_err": F.abs(turn),
            "vel_err": F.sqrt(F.pow(F.col("vx") - g("vx"), 2) + F.pow(F.col("vy") - g("vy"), 2)),
            "attr_err": F.when(g("attribute") == "", None).otherwise((F.col("attribute") != g("attribute")).cast("double")),
        }
    )


def with_errors(found: DataFrame, class_col: str = "class_name") -> DataFrame:
    """``verdicts`` with the errors of what is matched, null elsewhere."""
    names = ("x", "y", "w", "l", "h", "yaw", "vx", "vy", "attribute")
    pairs = found.withColumns({f"{c}_gt": F.col(f"gt.{c}") for c in names})
    out = box_errors(pairs, class_col)
    return out.withColumns({e: F.when(F.col("gt").isNotNull(), F.col(e)) for e in ERRORS}).drop(*[f"{c}_gt" for c in names])


def ranked(rows: DataFrame, by: list[str], tie: list[str], hits: dict[str, Column], errors: tuple[str, ...] = (), of: str | None = None) -> DataFrame:
    """``rows`` (by, score, n_gt and more) with running sums in the order of falling score, then ``tie``: tp_<name> for each of
    ``hits``, seen, and for the errors of the hit ``of`` sum_<e> and n_<e>; their totals; and the least score of all rows
    before, and of those that ``of`` counts."""
    sums = {f"tp_{k}": v for k, v in hits.items()} | {"seen": F.lit(1)}
    sums |= {f"sum_{e}": F.coalesce(e, F.lit(0.0)) for e in errors} | {f"n_{e}": F.col(e).isNotNull().cast("int") for e in errors}
    lows = {"above": F.col("score")} | ({"tp_above": F.when(hits[of] == 1, F.col("score"))} if of else {})
    return running(rows, by, part_of(F.col("score")), [F.col("score").desc(), *map(F.col, tie)], sums, tuple(sums), lows)


def levels(run: DataFrame, by: list[str], names: list[str], min_recall: float, keep: tuple[str, ...] = ()) -> DataFrame:
    """(by, t, k, precision, confidence, keep) at the recalls k / 100 above ``min_recall`` that the t-th hit of ``names``
    reaches, linear between the rows of the curve; of rows of one recall the last counts from there on.

    A level below a true positive's recall, and not below that of the row before it, lies between these two; the last
    level, if the last recall is one, is the last row's.  All hits are read off in one pass."""
    of = F.array(*[F.struct(F.lit(t).alias("t"), F.col(f"tp_{k}").alias("tp"), F.col(f"hit_{k}").alias("hit")) for t, k in enumerate(names)])
    is_last, first = F.col("seen") == F.col("total_seen"), round(100 * min_recall) + 1
    rows = run.select(*by, "n_gt", "seen", "above", "score", is_last.alias("is_last"), *[c for c in keep if c != "score"], F.explode(of).alias("e")).select("*", "e.*").drop("e")
    tp, seen, n = F.col("tp"), F.col("seen"), F.col("n_gt")
    r0, r1 = (tp - 1) / n, tp / n
    low, high = F.greatest(F.lit(first), F.floor(100 * r0)).cast("int"), F.least(F.lit(100), F.ceil(100 * r1)).cast("int")
    level = lambda end: lambda k: F.struct(k.alias("k"), F.lit(end).alias("end"))
    none = F.array().cast("array<int>")
    inner = F.when((F.col("hit") == 1) & (low <= high), F.filter(F.sequence(low, high), lambda k: (k / 100 < r1) & ((k / 100 >= r0) | (seen == 1)))).otherwise(none)
    end = F.when(F.col("is_last") & (tp > 0), F.filter(F.array(F.round(100 * r1).cast("int")), lambda k: (k >= first) & (k / 100 == r1))).otherwise(none)
    at = F.explode(F.concat(F.transform(inner, level(False)), F.transform(end, level(True))))
    rows = rows.filter((F.col("hit") == 1) | F.col("is_last")).select("*", at.alias("at")).select("*", "at.*")
    alone = F.col("end") | (seen == 1)  # before the first row its own values hold
    share = (F.col("k") / 100 - r0) / (r1 - r0)
    between = lambda a, b: F.when(alone, b).otherwise(a + share * (b - a))
    before = F.when(seen > 1, (tp - 1) / (seen - 1))
    return rows.select(*by, "t", "k", between(before, tp / seen).alias("precision"), between(F.col("above"), F.col("score")).alias("confidence"), *keep)


def evaluate(
    rows: DataFrame, n_gt: DataFrame, by: list[str], tie: list[str], class_col: str, thresholds: tuple[float, ...] = THRESHOLDS, at: float | None = None,
    errors: tuple[str, ...] = (), min_recall: float = 0.1, min_precision: float = 0.1, every: DataFrame | None = None,
) -> DataFrame:
    """(by, aps, errors): precision averaged over the recalls above ``min_recall``, for each threshold, and the mean, over the
    recalls that are reached with some confidence, of each error's running mean at that confidence, linear between the true
    positives of the threshold ``at``; a row for each of ``every`` (by), or of those with predictions.

    rows: by, tie, score, hits (as of ``verdicts``) and, where matched at ``at``, the errors.  n_gt: class, n_gt.  Unknown
    errors do not count; the running mean is 0 before the first known one, and 1 throughout if none is known.  Where no
    recall is reached precision is 0 and errors are 1; errors that mean nothing for a class are NaN."""
    names = [str(k) for k in range(len(thresholds))]
    of = str(thresholds.index(at)) if errors else None
    flat = rows.join(n_gt.select(class_col, "n_gt"), class_col, "left").withColumns({f"hit_{k}": F.get("hits", F.lit(int(k))).isNotNull().cast("int") for k in names})
    flat = flat.select(*by, *[c for c in tie if c not in (*by, "score")], "score", "n_gt", *[f"hit_{k}" for k in names], *errors)
    flat = cut(flat)  # read by the ranking twice and for what is there, but matched once
    run = ranked(flat.filter("n_gt is not null"), by, tie, {k: F.col(f"hit_{k}") for k in names}, errors, of)
    mean = lambda e, s, n: F.when(F.col(f"total_n_{e}") == 0, F.lit(1.0)).otherwise(F.when(n > 0, s / n).otherwise(F.lit(0.0)))
    own = {e: mean(e, F.col(f"sum_{e}"), F.col(f"n_{e}")) for e in errors}
    prior = {e: mean(e, F.col(f"sum_{e}") - F.coalesce(e, F.lit(0.0)), F.col(f"n_{e}") - F.col(e).isNotNull().cast("int")) for e in errors}
    run = run.withColumns({f"own_{e}": v for e, v in own.items()} | {f"prior_{e}": v for e, v in prior.items()}) if errors else run
    if errors:  # read by the levels and at the scores of true positives; nothing else lies on a level
        run = cut(run.filter(reduce(lambda a, b: a | b, [F.col(f"hit_{k}") == 1 for k in names]) | (F.col("seen") == F.col("total_seen"))))
    keep = ("score", "tp_above", *[f"own_{e}" for e in errors], *[f"prior_{e}" for e in errors]) if errors else ()
    grid = levels(run, by, names, min_recall, keep)
    same = lambda a, b, names: reduce(lambda x, y: x & y, [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in names])
    if errors:
        # at the very score of true positives the first of them counts
        firsts = run.filter(F.col(f"hit_{of}") == 1).groupBy(*by, "score").agg(F.min_by(F.struct(*[f"own_{e}" for e in errors]), f"tp_{of}").alias("first"))
        grid = grid.alias("g").join(firsts.alias("f"), same("g", "f", by) & (F.col("g.confidence") == F.col("f.score")) & (F.col("g.t") == int(of)), "left").select("g.*", "f.first")

    def read(e: str) -> Column:
        own_, conf = F.col(f"own_{e}"), F.col("confidence")
        share = (conf - F.col("score")) / (F.col("tp_above") - F.col("score"))
        inside = F.col("tp_above").isNotNull() & (conf > F.col("score")) & (F.col("tp_above") > F.col("score"))
        value = F.when(F.col("first").isNotNull(), F.col(f"first.own_{e}")).when(inside, own_ + share * (F.col(f"prior_{e}") - own_)).otherwise(own_)
        return F.when((F.col("t") == int(of)) & (conf > 0), value)

    gain = F.greatest(F.col("precision") - min_precision, F.lit(0.0))
    share_of = (100 - round(100 * min_recall)) * (1 - min_precision)
    found = grid.groupBy(*by).agg(F.array(*[F.coalesce(F.sum(F.when(F.col("t") == int(k), gain)), F.lit(0.0)) / share_of for k in names]).alias("aps"), *[F.avg(read(e)).alias(e) for e in errors])
    every = flat.select(*by).distinct() if every is None else every
    out = every.alias("v").join(found.alias("w"), same("v", "w", by), "left").select("v.*", "w.aps", *[F.col(f"w.{e}") for e in errors])
    undefined = {e: F.col(class_col).isin(*UNDEFINED[e]) if e in UNDEFINED else F.lit(False) for e in errors}
    columns = {"aps": F.coalesce("aps", F.array_repeat(F.lit(0.0), len(names)))}
    return out.withColumns(columns | {e: F.when(undefined[e], F.lit(float("nan"))).otherwise(F.coalesce(e, F.lit(1.0))) for e in errors})


def score(per_class: DataFrame, model: tuple[str, ...] = (), errors: tuple[str, ...] = ERRORS) -> DataFrame:
    """(model, mean_ap, errors, nds) of ``evaluate``'s rows: errors that are NaN for a class do not count in the mean; the score
    weighs mean precision five times and each error, at most 1, once."""
    mean_ap = F.avg(F.aggregate("aps", F.lit(0.0), lambda a, x: a + x) / F.size("aps"))
    found = per_class.groupBy(*model).agg(mean_ap.alias("mean_ap"), *[F.avg(F.when(~F.isnan(e), F.col(e))).alias(e) for e in errors])
    total = sum((1 - F.least(F.lit(1.0), F.coalesce(e, F.lit(1.0))) for e in errors), F.lit(0.0))
    return found.withColumn("nds", (5 * F.col("mean_ap") + total) / (5 + len(errors)))
