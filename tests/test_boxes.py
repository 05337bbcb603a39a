"""Hand-made cases for each operator, and brute force for the greedy ones."""

from __future__ import annotations

import json
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from boxfusion import schemas
from boxfusion.config import FusionConfig
from boxfusion.functions import geometry as G
from boxfusion.operators import analytics, cleaning, dataset, features, matching, metrics, nms, scoring, splits, tracking
from boxfusion.plans import pipeline
from boxfusion.sources import metadata, sinks, submissions


def boxes(spark, rows):
    """rows: dicts; defaults make a car of 2 by 4 m."""
    base = dict(sample_token="t", expert="ssn", expert_ord=0, x=0.0, y=0.0, z=0.0, w=2.0, l=4.0, h=1.5, qw=1.0, qx=0.0, qy=0.0, qz=0.0, vx=0.0, vy=0.0, class_name="car", score=0.9, attribute="", coord_frame="global", yaw=0.0)
    full = [{**base, "box_pos": k, **r} for k, r in enumerate(rows)]
    for r in full:
        r["class_id"] = schemas.CLASS_IDS.get(r["class_name"], -1)
    names = [f.split()[0] for f in schemas.BOXES.split(", ")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in full], schemas.BOXES)


def iou(a, b):
    dx = min(a.x + a.l / 2, b.x + b.l / 2) - max(a.x - a.l / 2, b.x - b.l / 2)
    dy = min(a.y + a.w / 2, b.y + b.w / 2) - max(a.y - a.w / 2, b.y - b.w / 2)
    i = max(0.0, dx) * max(0.0, dy)
    return i / (a.w * a.l + b.w * b.l - i) if i > 0 else 0.0


def random_boxes(spark, n=160, seed=1, **fixed):
    r = random.Random(seed)
    rows = [dict(x=r.randint(0, 12) * 1.0, y=r.randint(0, 8) * 1.0, score=r.randint(0, 20) / 20, class_name=r.choice(("car", "bus")), sample_token=r.choice("ab"), expert=r.choice(("ssn", "centerpoint", "voxelnext"))) | fixed for _ in range(n)]
    order = {"ssn": 0, "centerpoint": 1, "voxelnext": 2}
    return boxes(spark, [x | {"expert_ord": order[x["expert"]]} for x in rows])


def test_overlap(spark):
    df = boxes(spark, [dict(w=2.0, l=2.0)]).select(G.iou(None, F.struct(F.lit(1.0).alias("x"), F.lit(0.0).alias("y"), F.lit(2.0).alias("w"), F.lit(2.0).alias("l"))).alias("v"))
    assert df.first()["v"] == pytest.approx(2 / 6)
    assert spark.range(1).select(G.yaw(F.lit(math.cos(math.pi / 4)), F.lit(0.0), F.lit(0.0), F.lit(math.sin(math.pi / 4))).alias("v")).first()["v"] == pytest.approx(math.pi / 2)


def test_geometry_of_views(spark):
    r = spark.range(1).select(
        G.corners(F.lit(0.0), F.lit(0.0), F.lit(2.0), F.lit(4.0), F.lit(0.0)).alias("c"), G.height_shade(F.lit(1.0)).alias("h"), F.array(*G.sensor_to_ego(F.lit(1.0), F.lit(0.0), F.lit(0.0), (F.lit(1.0), F.lit(2.0), F.lit(3.0), F.lit(math.pi / 2)))).alias("p"),
        F.array(*[G.drivable_ladder(F.lit(v)) for v in (0.0, 1.5, 7.0, 90.0)], G.drivable_ladder(F.lit(None).cast("double"))).alias("d"), F.array(*[G.bin_label(F.lit(v)) for v in (0.0, 0.2, 1.0, 1.5)]).alias("b"),
    ).first()
    assert [tuple(c) for c in r["c"]] == [(2.0, 1.0), (2.0, -1.0), (-2.0, -1.0), (-2.0, 1.0), (2.0, 0.0)]
    assert r["h"] == 0.5 and r["p"] == pytest.approx([1.0, 3.0, 3.0])
    assert r["d"] == [0.0, 2.0, 8.0, 16.0, -1.0] and r["b"] == [0, 1, 4, None]


def test_classes(spark):
    names = ["car", "vehicle.bus.bendy", "human.pedestrian.stroller", "static_object.bicycle_rack", "boat", ""]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r["c"] for r in df.select(schemas.canonical_class(F.col("n")).alias("c")).collect()] == ["car", "bus", "pedestrian", "bicycle", None, None]
    assert [r["c"] for r in df.select(schemas.evaluated_class(F.col("n")).alias("c")).collect()] == [None, "bus", None, None, None, None]
    assert len(schemas.EVALUATED_CATEGORIES) == 14


@pytest.mark.parametrize("aware", [True, False])
def test_suppression_equals_brute_force(spark, aware):
    df = random_boxes(spark)
    want = set()
    for _, g in df.toPandas().groupby(["sample_token", "class_name"] if aware else ["sample_token"]):
        kept = []
        for b in g.sort_values(["score", "expert_ord", "box_pos"], ascending=[False, True, True]).itertuples():
            if all(iou(k, b) < 0.3 for k in kept):
                kept.append(b)
        want |= {k.box_pos for k in kept}
    got = nms.suppress(df, ["sample_token"], "class_name" if aware else None)
    assert {r["box_pos"] for r in got.collect()} == want
    assert nms.cap(got, ["sample_token"], most=5).groupBy("sample_token").count().agg(F.max("count")).first()[0] == 5
    assert nms.suppress(df.limit(0), ["sample_token"]).count() == 0


@pytest.mark.parametrize(("metric", "strict", "last"), [("iou", False, True), ("center", False, True), ("center", True, False)])
def test_matching_equals_brute_force(spark, metric, strict, last):
    preds = random_boxes(spark, 120, 2)
    gts = random_boxes(spark, 60, 3).withColumnRenamed("box_pos", "gt_pos")
    g, got = gts.toPandas(), matching.match(preds, gts, ["sample_token", "class_name"], ("expert",), metric=metric, strict=strict, last_wins=last)
    for _, p in got.toPandas().groupby(["sample_token", "class_name", "expert"]):
        used = set()
        for b in p.sort_values(["score", "expert_ord", "box_pos"], ascending=[False, True, True]).itertuples():
            best = None
            for t in g[(g.sample_token == b.sample_token) & (g.class_name == b.class_name)].sort_values("gt_pos").itertuples():
                if t.gt_pos in used:
                    continue
                d = math.hypot(b.x - t.x, b.y - t.y)
                v = iou(b, t) if metric == "iou" else -d
                ok = v >= 0.5 if metric == "iou" else (d < 2.0 if strict else d <= 2.0)
                if ok and (best is None or v > best[0] or (v == best[0] and last)):
                    best = (v, t.gt_pos)
            if best:
                used.add(best[1])
            assert (None if math.isnan(b.matched) else b.matched) == (best[1] if best else None)


def test_features(spark):
    rows = [dict(expert="ssn", score=0.8), dict(expert="centerpoint", score=0.6, x=0.5), dict(expert="centerpoint", score=0.2, class_name="bus", x=-0.5), dict(expert="voxelnext", score=0.5, x=100.0)]
    out = {r["box_pos"]: r for r in features.feature_vector(boxes(spark, rows), ["sample_token"], ["box_pos"]).collect()}
    a, far = out[0], out[3]
    assert (a["n_peer_overlaps"], a["class_agreement"], a["expert_agreement"], a["n_active_experts"]) == (2, 0.5, 0.5, 3)
    assert a["mean_peer_score"] == pytest.approx(0.4) and a["score_variance"] == pytest.approx(0.04) and a["max_class_score"] == 0.8
    assert (far["class_agreement"], far["max_peer_iou"], far["expert_agreement"], far["dist_to_drivable_area"], far["expert_id"]) == (-1.0, 0.0, 0.0, -1.0, 4)


def test_grid_join_finds_the_same_pairs(spark):
    df = random_boxes(spark, 200, 5)
    plain = features.peer_pairs(df, ["sample_token"], ["box_pos"])
    grid = features.peer_pairs(df, ["sample_token"], ["box_pos"], cell=3.0)
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, grid.collect()))


def test_gate_and_thresholds(spark):
    df = boxes(spark, [dict(score=0.5), dict(score=0.5, class_name="bus")])
    routed = scoring.route(df, {"car": F.lit(0.9)})
    out = {r["class_name"]: r["score"] for r in scoring.gated(routed).collect()}
    w = 1 / (1 + math.exp(-0.9 / 0.8))
    assert out["bus"] == 0.5 and out["car"] == pytest.approx(w * 0.9 + (1 - w) * 0.5)
    assert {r["class_name"] for r in scoring.over_threshold(df).collect()} == {"car", "bus"}
    assert scoring.over_threshold(df.withColumn("score", F.lit(0.4))).count() == 1
    assert df.select(scoring.diagnosis(F.lit(0.9), F.lit(0.5))).first()[0] == "overfitting risk"
    assert df.select(scoring.hard_label(F.lit(0.5))).first()[0] == 1


def scene(spark, xs, **more):
    """One box a frame; None leaves a frame empty."""
    return boxes(spark, [dict(sample_token=f"f{k}", x=float(x), box_pos=0) | more for k, x in enumerate(xs) if x is not None]).withColumns({"scene_token": F.lit("s"), "frame_idx": F.substring("sample_token", 2, 9).cast("int")})


def test_tracking(spark):
    one = tracking.track(scene(spark, [0, 1, None, 2]))
    assert {r["hit_count"] for r in one.collect()} == {3}
    assert sorted(r["hit_count"] for r in tracking.track(scene(spark, [0, None, None, 0])).collect()) == [1, 1]
    made = tracking.interpolate(one, discount=0.5).collect()
    assert len(made) == 1 and (made[0]["x"], made[0]["frame_idx"], made[0]["score"], made[0]["expert"]) == (1.5, 2, 0.45, "ssn_track_interp")
    kept = tracking.refine(scene(spark, [0, None, None, 0]), excluded=())
    assert [r["score"] for r in kept.collect()] == pytest.approx([0.63, 0.63])
    assert tracking.refine(scene(spark, [0, None, 0])).filter("inserted").count() == 0  # cars stay as they are
    crowd = scene(spark, [0, None, 0], class_name="bus").unionByName(scene(spark, [None, 0.2], class_name="bus", box_pos=1, x=50.0).withColumn("x", F.lit(0.2)).withColumn("frame_idx", F.lit(1)).filter("false"))
    assert tracking.refine(crowd).filter("inserted").count() == 1


def test_crowded_tracking_equals_naive(spark):
    r = random.Random(4)
    rows = [dict(sample_token=f"f{k}", x=r.random() * 12, y=r.random() * 3, class_name="bicycle", box_pos=j) for k in range(25) for j in range(r.randint(0, 6))]
    df = boxes(spark, rows).withColumns({"scene_token": F.lit("s"), "frame_idx": F.substring("sample_token", 2, 9).cast("int")})
    got = tracking.track(df).toPandas()
    tracks, of = [], {}
    for k in range(25):
        now = got[got.frame_idx == k].sort_values("box_pos")
        pairs = sorted((math.hypot(t[0] - b.x, t[1] - b.y), ti, bi) for ti, t in enumerate(tracks) for bi, b in enumerate(now.itertuples()))
        used_t, used_b = {}, {}
        for d, ti, bi in pairs:
            if d <= 2.5 and ti not in used_t and bi not in used_b:
                used_t[ti], used_b[bi] = bi, ti
        nxt = []
        for ti, t in enumerate(tracks):
            if ti in used_t:
                continue
            t[2] += 1
            nxt += [t] if t[2] <= 1 else []
        for bi, b in enumerate(now.itertuples()):
            t = tracks[used_b[bi]] if bi in used_b else [0, 0, 0, object()]
            t[:3] = [b.x, b.y, 0]
            of[k, b.box_pos] = t[3]
            nxt.append(t)
        tracks = sorted(nxt, key=lambda t: [id(x) for x in tracks].index(id(t)) if id(t) in [id(x) for x in tracks] else 10**6)
    ids = {}
    for b in got.itertuples():
        ids.setdefault(b.track_id, set()).add(of[b.frame_idx, b.box_pos])
    assert all(len(v) == 1 for v in ids.values()) and len(ids) == len(set(of.values()))


def test_scene_order(spark):
    samples = spark.createDataFrame([("a", "b", "s"), ("b", "c", "s"), ("c", "d", "s"), ("d", "", "s"), ("z", "", "u")], "token string, next string, scene_token string")
    scenes = spark.createDataFrame([("s", "a"), ("u", "z")], "token string, first_sample_token string")
    tokens = spark.createDataFrame([("a",), ("c",), ("d",)], "sample_token string")
    assert sorted(map(tuple, tracking.scene_frames(samples, scenes, tokens).collect())) == [("s", "a", 0), ("s", "c", 1), ("s", "d", 2)]


def submission(path, results):
    path.write_text(json.dumps({"meta": {"use_lidar": True}, "results": results}))
    return str(path)


def raw(**more):
    return {"sample_token": "x", "translation": [1, 2, 0.5], "size": [2, 4, 1.5], "rotation": [1, 0, 0, 0], "velocity": [0, 0], "detection_name": "vehicle.car", "detection_score": 0.9, "attribute_name": "vehicle.moving"} | more


def test_submissions(spark, tmp_path):
    p = submission(tmp_path / "a.json", {"t1": [raw(), raw(detection_score=0.2)], "t2": [], "t3": [raw(detection_name="bus")]})
    b, f = submissions.read_submission(spark, p, "ssn", score_threshold=0.2)
    assert f.count() == 3 and {r["class_name"] for r in b.collect()} == {"car", "bus"} and b.count() == 3
    assert submissions.read_submission(spark, p, "ssn", tokens=spark.createDataFrame([("t2",)], "sample_token string"))[1].count() == 1
    bad = submission(tmp_path / "b.json", {"t": [raw(detection_score=1.5), raw(size=[0, 1, 1]), raw(detection_name="boat"), {k: v for k, v in raw().items() if k != "velocity"}, raw()]})
    assert submissions.read_submission(spark, bad, "ssn", strict=False)[0].count() == 1
    assert sorted(r["problem"] for r in submissions.read_flawed(spark, bad, "ssn").collect()) == ["missing velocity", "score", "size", "unknown class"]
    with pytest.raises(Exception, match="b.json"):
        submissions.read_submission(spark, bad, "ssn", score_threshold=1.0)[0].count()
    (tmp_path / "c.json").write_text("{}")
    with pytest.raises(Exception, match="no results"):
        submissions.read_submission(spark, str(tmp_path / "c.json"), "ssn")[0].count()
    out = tmp_path / "deep" / "out.json"
    assert sinks.save_submission(b, f, str(out)) == 3
    back = json.loads(out.read_text())
    assert back["meta"]["use_lidar"] and back["results"]["t2"] == [] and back["results"]["t1"][0]["translation"] == [1, 2, 0.5]
    again, frames = submissions.read_submission(spark, str(out), "ssn")
    assert again.count() == 3 and frames.count() == 3


def test_ground_truth_and_points(spark, tmp_path):
    eye = [[float(r == c) for c in range(4)] for r in range(4)]
    moved = [[0.0, -1.0, 0.0, 10.0], [1.0, 0.0, 0.0, 0.0], [0.0, 0.0, 1.0, 0.0], [0.0, 0.0, 0.0, 1.0]]
    rows = [{"token": "t", "ego2global": moved, "lidar_points": {"lidar2ego": eye, "lidar_path": "a/b/s.bin", "num_pts_feats": None}, "instances": [{"bbox_3d": [1.0, 2.0, 0.0, 4.0, 2.0, 1.5, 0.0], "bbox_label_3d": 0, "bbox_3d_isvalid": None}, {"bbox_3d": [0.0] * 7, "bbox_label_3d": 99, "bbox_3d_isvalid": True}, {"bbox_3d": [0.0] * 7, "bbox_label_3d": 1, "bbox_3d_isvalid": False}]}, {"token": "u", "ego2global": eye, "lidar_points": {"lidar2ego": eye, "lidar_path": "x", "num_pts_feats": 4}, "instances": []}]
    gt, frames = metadata.ground_truth(metadata.records(spark, rows))
    g = gt.collect()
    assert len(g) == 1 and frames.count() == 2 and (g[0]["x"], g[0]["y"], g[0]["w"], g[0]["l"]) == (8.0, 1.0, 2.0, 4.0) and g[0]["yaw"] == pytest.approx(math.pi / 2)
    assert [(r["path"], r["columns"]) for r in metadata.lidar_info(metadata.records(spark, rows), "/d").collect()][0] == ("/d/samples/LIDAR_TOP/s.bin", 5)
    np.arange(10, dtype=np.float32).tofile(tmp_path / "five.bin")
    np.arange(8, dtype=np.float32).tofile(tmp_path / "four.bin")
    pts = metadata.read_points(spark, str(tmp_path / "*.bin")).toPandas()
    assert len(pts) == 4 and (pts[pts.path.str.contains("four")].ring == 0).all()
    assert metadata.in_view(metadata.read_points(spark, str(tmp_path / "*.bin")), 4.5).count() == 2


def test_manifests(spark, tmp_path):
    (tmp_path / "s.json").write_text('{"test_tokens": ["a", "b"], "fit_tokens": ["c"]}')
    (tmp_path / "m.json").write_text('{"a": "s1", "b": "s1"}')
    assert {tuple(r) for r in metadata.read_split(spark, str(tmp_path / "s.json")).collect()} == {("a", "test"), ("b", "test"), ("c", "fit")}
    scenes = metadata.read_scene_map(spark, str(tmp_path / "m.json"))
    assert metadata.with_scene(spark.createDataFrame([("a",)], "sample_token string"), scenes).count() == 1
    with pytest.raises(Exception, match="no scene"):
        metadata.with_scene(spark.createDataFrame([("z",)], "sample_token string"), scenes).collect()


def test_dataset(spark):
    preds = boxes(spark, [dict(score=0.9), dict(score=0.8), dict(score=0.7, expert="centerpoint"), dict(sample_token="none")])
    gts = spark.createDataFrame([("t", 0, "car", 0.0, 0.0, 2.0, 4.0)], "sample_token string, gt_pos int, class_name string, x double, y double, w double, l double")
    frames = spark.createDataFrame([("t",)], "sample_token string")
    out = dataset.build(preds, gts, frames, ["sample_token"], ["sample_token", "expert", "box_pos"]).collect()
    assert {(r["box_pos"], r["label"]) for r in out} == {(0, 1), (1, 0), (2, 1)}
    r = dataset.same_frames(preds, frames, ["sample_token"]).first()
    assert tuple(r) == (1, 0)
    assert dataset.label_boxes(preds, gts, ["sample_token"], criterion="config").filter("label = 1").count() == 2
    a, b = splits.token_split([f"tok_{k}" for k in range(100)])
    assert len(a) == 70 and not set(a) & set(b) and splits.token_split([f"tok_{k}" for k in range(100)]) == (a, b)


def test_metrics(spark):
    rows = spark.createDataFrame([(1, 0.9, 1), (1, 0.8, 0), (1, 0.7, 1), (1, 0.7, 0), (1, 0.1, 1)], "c int, score double, label int")
    ap = metrics.average_precision(rows, ["c"]).first()["ap"]
    assert ap == pytest.approx(1 / 3 * 1 + 1 / 3 * 2 / 4 + 1 / 3 * 3 / 5)
    assert metrics.roc_auc(rows, ["c"]).first()["auc"] == pytest.approx((2 + 0.5) / 6)
    gts = spark.createDataFrame([("t", k, "car", 10.0 * k, 0.0) for k in range(4)], "sample_token string, gt_pos int, class_name string, x double, y double")
    preds = boxes(spark, [dict(x=0.0, score=0.9), dict(x=10.4, score=0.8), dict(x=25.0, score=0.7), dict(x=30.0, score=0.6)])
    assert {r["expert"]: r["ap"] for r in metrics.detection_ap(preds.unionByName(preds.limit(1).withColumn("expert", F.lit("other"))), gts, ["sample_token"], model=("expert",), thresholds=(4.0,)).collect()}.keys() == {"ssn", "other"}
    got = {r["threshold"]: r["ap"] for r in metrics.detection_ap(preds, gts, ["sample_token"], thresholds=(0.5,)).collect()}
    rec, prec = np.array([0.25, 0.5, 0.5, 0.75]), np.array([1, 1, 2 / 3, 3 / 4])
    p = np.interp(np.linspace(0, 1, 101), rec, prec, right=0)[11:]
    assert got[0.5] == pytest.approx(np.maximum(p - 0.1, 0).mean() / 0.9)


def test_detection_errors(spark):
    v = spark.createDataFrame([("car", s, l, 4, e) for s, l, e in ((0.9, 1, 0.1), (0.8, 0, None), (0.7, 1, 0.3), (0.5, 1, 0.2))], "class_name string, score double, label int, n_gt int, trans_err double")
    got = metrics.tp_errors(v, ["class_name"], ["score"], errors=("trans_err",)).first()["trans_err"]
    conf, rec = np.array([0.9, 0.8, 0.7, 0.5]), np.array([0.25, 0.25, 0.5, 0.75])
    c = np.interp(np.linspace(0, 1, 101), rec, conf, right=0)
    err = np.interp(c[::-1], conf[[0, 2, 3]][::-1], np.array([0.1, 0.2, 0.2])[::-1])[::-1]
    last = np.nonzero(c)[0][-1]
    assert got == pytest.approx(err[11 : last + 1].mean())
    ap = spark.createDataFrame([("car", 0.5)], "class_name string, ap double")
    s = metrics.detection_score(ap, spark.createDataFrame([("car", 0.2, float("nan"))], "class_name string, trans_err double, vel_err double")).first()
    assert s["mean_ap"] == 0.5 and s["nds"] == pytest.approx((2.5 + 0.8 + 0.0) / 7)


def test_cleaning(spark):
    inf, nan = float("inf"), float("nan")
    rows = spark.createDataFrame([(0.5, 1.0, 1.0, 0, "ssn"), (0.5, inf, 1.0, 0, "ssn"), (nan, 1.0, 1.0, 0, "ssn"), (0.5, 1.0, 0.0, 0, "ssn"), (0.5, 1.0, nan, 0, "ssn"), (0.5, 1.0, 1.0, 10, "ssn"), (0.5, 1.0, 1.0, 0, "other")], "detection_score double, dist_from_ego double, box_width double, class_id int, model_name string")
    assert cleaning.clean(rows, experts=("ssn",)).count() == 2
    assert tuple(cleaning.summary(rows, experts=("ssn",)).first()) == (7, 1, 1, 1, 2, 2)
    h = analytics.clipped_histogram(spark.range(100).select(F.col("id").cast("double").alias("v")), "v", 10)
    assert h.agg(F.sum("n")).first()[0] == 100
    assert analytics.median_gate(spark.createDataFrame([(1.0, 2.0)], "box_width double, box_length double")).first()["ok"]
    log = spark.createDataFrame([("t1", 1.0), ("t2", 5.0), ("t3", 5.0), ("t4", None)], "ts string, ram double")
    assert tuple(analytics.log_summary(log, ["ram"]).first()) == ("ram", 5.0, "t2")


def training_rows(spark, n=400):
    r = np.random.default_rng(0)
    x = r.normal(size=(n, 2))
    y = (x[:, 0] + 0.5 * r.normal(size=n) > 0.8).astype(int)
    return spark.createDataFrame(pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "label": y, "class_id": 0, "k": np.arange(n)}))


def test_trees(spark, tmp_path):
    from boxfusion.operators.ml import trees

    rows = training_rows(spark)
    out = trees.train(rows, ["a", "b"], {"car": 0, "bus": 3}, rows.filter("k % 4 = 0"), calibrated=("car",), key=["k"], most_rounds=5, depth=3, patience=3)
    assert out["bus"] is None and 1 <= out["car"].rounds <= 5
    p = trees.predict(rows, out["car"], ["a", "b"])
    assert metrics.average_precision(p.withColumn("g", F.lit(1)), ["g"], "p").first()["ap"] > 0.6
    trees.save(out, str(tmp_path / "r"))
    back = trees.load(str(tmp_path / "r"))
    assert back["bus"] is None and back["car"].calibration == pytest.approx(out["car"].calibration)


def test_neural(spark, tmp_path):
    from boxfusion.operators.ml import neural

    # a transformer whose layers add nothing reads the norm of its own token
    w = neural.initial_transformer(2, d=4, layers=1)
    for k in ("out_weight", "out_bias", "linear2_weight", "linear2_bias"):
        w["layers"][0][k] = np.zeros_like(w["layers"][0][k])
    c = w["cls"]
    want = ((c - c.mean()) / np.sqrt(c.var() + 1e-5)) @ w["head_weight"][0]
    assert neural.transformer(np.ones((3, 2)), w, heads=2) == pytest.approx([want] * 3)
    full = neural.initial_transformer(2, d=4, layers=2)
    mean, std = neural.scaling(training_rows(spark), ["a", "b"])
    router = neural.NeuralRouter("transformer", full, mean, std, 2, (np.array([0.0, 1.0]), np.array([0.1, 0.9])))
    rows = training_rows(spark, 50).withColumn("class_name", F.when(F.col("k") < 25, "car").otherwise("bus"))
    got = neural.predict(rows, {"car": router}, ["a", "b"]).toPandas().sort_values("k")
    assert got.p.isna().sum() == 25 and got.p[got.k < 25].between(0.1, 0.9).all()
    assert got.p.to_numpy()[:25] == pytest.approx(router.predict(got[["a", "b"]].to_numpy()[:25]))
    neural.save({"car": router, "bus": None}, str(tmp_path / "n"))
    back = neural.load(str(tmp_path / "n"))
    assert back["bus"] is None and back["car"].predict(np.ones((2, 2))) == pytest.approx(router.predict(np.ones((2, 2))))
    knots = neural.isotonic(spark.createDataFrame([(0.1, 0), (0.4, 1), (0.5, 0), (0.9, 1)], "p double, label int"))
    v = spark.createDataFrame([(0.05,), (0.45,), (0.95,)], "p double").select(neural.calibrated(F.col("p"), knots).alias("v")).toPandas().v
    assert v.to_numpy() == pytest.approx(np.interp([0.05, 0.45, 0.95], *knots)) and v.is_monotonic_increasing
    score = neural.train_perceptron(training_rows(spark), ["a", "b"], (4,), 50)
    assert metrics.average_precision(score(training_rows(spark)).withColumn("g", F.lit(1)), ["g"], "p").first()["ap"] > 0.6


def test_pipeline(spark):
    df = boxes(spark, [dict(sample_token="f0", score=0.9), dict(sample_token="f0", score=0.6, x=0.2, expert="centerpoint"), dict(sample_token="f0", class_name="bus", x=30.0), dict(sample_token="f2", class_name="bus", x=31.0)])
    frames = spark.createDataFrame([(f"f{k}", "s", k) for k in range(3)], "sample_token string, scene_token string, frame_idx int")
    route = lambda rows, name: rows.withColumn(name, F.lit(0.8))
    out = pipeline.run(df, frames, route, route, FusionConfig()).collect()
    assert len(out) == 4 and sum(r["inserted"] for r in out) == 1
    new = next(r for r in out if r["inserted"])
    assert (new["sample_token"], new["x"], new["class_name"]) == ("f1", 30.5, "bus")


def test_causal_stream(spark, tmp_path):
    from boxfusion.streaming.causal import track_stream

    scene(spark, [0, 1, None, 2]).coalesce(1).write.parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    q = track_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("tracked").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r["hits"] for r in spark.table("tracked").collect()) == [1, 2, 3]


def test_running_sums_over_many_parts(spark):
    """Ties, negative, great and undefined values, and a null group, against one sort."""
    import random

    from boxfusion.operators.ranking import part_of, running

    r = random.Random(3)
    rows = [(r.choice(("a", "b", None)), r.choice((0.5, r.random(), -2.0, 1e20, r.random() / 1e5, float("nan"))), k, r.randint(0, 3)) for k in range(2000)]
    df = spark.createDataFrame(rows, "g string, s double, k int, v int")
    got = {x["k"]: (x["t"], x["total_t"]) for x in running(df, ["g"], part_of(F.col("s")), [F.col("s").desc(), F.col("k")], {"t": F.col("v")}, ("t",)).collect()}
    for g in ("a", "b", None):
        t, mine = 0, sorted((x for x in rows if x[0] == g), key=lambda x: (0 if x[1] != x[1] else 1, -x[1] if x[1] == x[1] else 0, x[2]))
        for x in mine:
            t += x[3]
            assert got[x[2]] == (t, sum(y[3] for y in mine))


def test_perceptron_gradients_and_training(spark):
    from boxfusion.operators.ml import fitting

    r = np.random.default_rng(1)
    w, x, y = fitting.initial(3, (5, 4), 2), r.normal(size=(12, 3)), r.integers(0, 2, 12).astype(float)

    def at(changed):  # the loss with the batch's own figures
        z = x
        for layer in changed["layers"]:
            z = z @ layer["weight"].T + layer["bias"]
            z = np.maximum((z - z.mean(axis=0)) / np.sqrt(z.var(axis=0) + 1e-5) * layer["scale"] + layer["shift"], 0)
        z = (z @ changed["head_weight"].T + changed["head_bias"])[:, 0]
        return np.mean(np.where(y > 0, 3.0 * np.logaddexp(0, -z), np.logaddexp(0, z)))

    for p, g in zip(fitting.parameters(w), fitting.gradients(w, x, y, 3.0), strict=True):
        k = np.unravel_index(np.argmax(np.abs(g)), g.shape)
        old = p[k]
        p[k] = old + 1e-5
        up = at(w)
        p[k] = old - 1e-5
        down = at(w)
        p[k] = old
        assert (up - down) / 2e-5 == pytest.approx(g[k], rel=1e-3, abs=1e-6)
    assert [v.tolist() for v in fitting.rising(np.array([0.1, 0.2, 0.3, 0.4]), np.array([0.0, 1.0, 0.0, 1.0]))] == [[0.1, 0.2, 0.3, 0.4], [0.0, 0.5, 0.5, 1.0]]
    a = r.normal(size=(3000, 2))
    rows = spark.createDataFrame([(float(p), float(q), int(p * q > 0.8)) for p, q in a], "a double, b double, label int")
    router = fitting.fit_perceptron(rows, ["a", "b"], (16, 8), batch=256, rate=1e-2)
    assert ((router.predict(a) >= 0.5) == (a[:, 0] * a[:, 1] > 0.8)).mean() > 0.95
    assert fitting.fit_perceptron(rows.limit(10), ["a", "b"]) is None
