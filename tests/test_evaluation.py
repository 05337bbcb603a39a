"""The detection evaluation against a plain computation with numpy, frame by frame and box by box."""

from __future__ import annotations

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from boxfusion.operators import evaluation

COLUMNS = "frame string, box_pos int, expert string, class_name string, x double, y double, w double, l double, h double, yaw double, vx double, vy double, attribute string, score double"
GT = "frame string, gt_pos int, class_name string, x double, y double, w double, l double, h double, yaw double, vx double, vy double, attribute string"


def running_mean(x: list[float]) -> np.ndarray:
    x = np.array(x, float)
    if np.isnan(x).all():
        return np.ones(len(x))
    n = np.cumsum(~np.isnan(x))
    return np.divide(np.nancumsum(x), n, out=np.zeros(len(x)), where=n != 0)


def plain(preds: list[dict], gts: list[dict], expert: str, name: str) -> tuple[list[float], dict[str, float]]:
    mine = sorted((p for p in preds if p["expert"] == expert and p["class_name"] == name), key=lambda p: (-p["score"], p["frame"], p["box_pos"]))
    truth = [g for g in gts if g["class_name"] == name]
    aps, errors = [], dict.fromkeys(evaluation.ERRORS, 1.0)
    grid = np.arange(101) / 100
    for t in evaluation.THRESHOLDS:
        used, tp, found = set(), [], []
        for p in mine:
            near = [(math.sqrt((g["x"] - p["x"]) ** 2 + (g["y"] - p["y"]) ** 2), g["gt_pos"], k) for k, g in enumerate(truth) if g["frame"] == p["frame"] and k not in used]
            hit = min(near, default=(math.inf,)) 
            tp.append(hit[0] < t)
            if tp[-1]:
                used.add(hit[2])
                found.append((p, truth[hit[2]]))
        if not any(tp):
            aps.append(0.0)
            continue
        seen, hits = np.arange(1, len(tp) + 1), np.cumsum(tp)
        recall, precision, conf = hits / len(truth), hits / seen, np.array([p["score"] for p in mine])
        at = np.interp(grid, recall, precision, right=0)
        aps.append(float(np.maximum(at[11:] - 0.1, 0).mean() / 0.9))
        if t != 2.0:
            continue
        level = np.interp(grid, recall, conf, right=0)
        last = int(np.nonzero(level)[0][-1]) if level.any() else 0
        if last < 11:
            continue
        own = np.array([p["score"] for p, _ in found])
        for e in evaluation.ERRORS:
            values = running_mean([one_error(p, g, e, name) for p, g in found])
            errors[e] = float(np.interp(level[::-1], own[::-1], values[::-1])[::-1][11 : last + 1].mean())
    return aps, {e: math.nan if name in evaluation.UNDEFINED.get(e, ()) else v for e, v in errors.items()}


def one_error(p: dict, g: dict, e: str, name: str) -> float:
    if e == "trans_err":
        return math.sqrt((p["x"] - g["x"]) ** 2 + (p["y"] - g["y"]) ** 2)
    if e == "scale_err":
        inter = math.prod(min(p[c], g[c]) for c in "wlh")
        return 1 - inter / (math.prod(p[c] for c in "wlh") + math.prod(g[c] for c in "wlh") - inter)
    if e == "orient_err":
        period = math.pi if name == "barrier" else 2 * math.pi
        return abs((p["yaw"] - g["yaw"] + period / 2) % period - period / 2)
    if e == "vel_err":
        return math.sqrt((p["vx"] - g["vx"]) ** 2 + (p["vy"] - g["vy"]) ** 2)
    return math.nan if g["attribute"] == "" else float(p["attribute"] != g["attribute"])


@pytest.mark.parametrize(("seed", "steps"), [(1, 20), (2, 1000), (3, 4)])
def test_equals_plain_evaluation(spark, seed, steps):
    """Scores with many ties, with few, and nearly all alike; a class that no truth has an attribute of; an expert that finds nothing."""
    r = random.Random(seed)
    made = lambda: {"x": r.randrange(60) / 4, "y": r.randrange(8) / 4, "w": r.choice([1.0, 2.0]), "l": r.choice([3.0, 4.0]), "h": 1.5, "yaw": r.uniform(-4, 4), "vx": r.random(), "vy": 0.0}
    gts, preds = [], []
    for f, name in itertools.product(range(12), ["car", "barrier", "traffic_cone", "bus"]):
        truth = [{"frame": f"f{f}", "gt_pos": k, "class_name": name, **made(), "attribute": "" if name == "bus" else r.choice(["", "moving", "parked"])} for k in range(r.randrange(1, 6))]
        gts += truth
        for expert in ("a", "b", "none"):
            for g in truth:
                if r.random() < 0.8:
                    preds.append({**g, "x": g["x"] + (90 if expert == "none" else r.randrange(-8, 9) / 4), "w": made()["w"], "yaw": g["yaw"] + r.random(), "attribute": "moving", "expert": expert, "box_pos": len(preds), "score": r.randrange(0, steps) / steps})
    names = lambda s: [c.split()[0] for c in s.split(", ")]
    p = spark.createDataFrame([tuple(x[c] for c in names(COLUMNS)) for x in preds], COLUMNS)
    g = spark.createDataFrame([tuple(x[c] for c in names(GT)) for x in gts], GT)
    found = evaluation.with_errors(evaluation.verdicts(p, g, ["frame", "class_name"], ("expert",), order=("box_pos",), at=2.0))
    n_gt = g.groupBy("class_name").agg(F.count("*").alias("n_gt"))
    out = evaluation.evaluate(found, n_gt, ["expert", "class_name"], ["frame", "box_pos"], "class_name", at=2.0, errors=evaluation.ERRORS)
    rows = {(x["expert"], x["class_name"]): x for x in out.collect()}
    assert len(rows) == 12
    for (expert, name), x in rows.items():
        aps, errors = plain(preds, gts, expert, name)
        assert list(x["aps"]) == pytest.approx(aps, abs=1e-9), (expert, name)
        assert [x[e] for e in evaluation.ERRORS] == pytest.approx([errors[e] for e in evaluation.ERRORS], abs=1e-9, nan_ok=True), (expert, name)
    total = {x["expert"]: x["nds"] for x in evaluation.score(out, ("expert",)).collect()}
    assert total["none"] == 0.0 and 0 < total["a"] < 1
