"""Submissions by byte ranges and in shards."""

from __future__ import annotations

import json
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from boxfusion.sources import splits


def made(seed: int, n: int) -> dict[str, list[dict]]:
    r, out = random.Random(seed), {}
    for k in range(n):
        boxes = [{"sample_token": "another", "translation": [j, 2.0, r.random()], "size": [2, 4, 1.5], "rotation": [1, 0, 0, 0], "velocity": [0, 0], "detection_name": r.choice(["car", "bus"]), "detection_score": r.random(), "attribute_name": "vehicle.moving"} for j in range(r.choice([0, 0, 1, 3, 9]))]
        out[f'tok "{k}" [x], é'] = boxes
    return out


@pytest.mark.parametrize("size", ["200b", "1k", "128m"])
@pytest.mark.parametrize("form", [{}, {"indent": 2}, {"separators": (",", ":")}])
def test_ranges_of_any_size_give_all_boxes(spark, tmp_path, size, form):
    """Tokens without boxes, boxes over many ranges, any white space, meta before and after."""
    results = made(4, 40)
    results["long"] = [b | {"detection_score": 0.5} for b in made(5, 60)['tok "1" [x], é'] or made(6, 9)['tok "3" [x], é'] or [{"detection_score": 0.5}]] * 30
    doc = {"meta": {"use_lidar": True}, "results": results} if form else {"results": results, "meta": {"use_lidar": True}}
    (tmp_path / "a.json").write_text(json.dumps(doc, **form))
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "1b")
        rows = splits.read_ranges(spark, str(tmp_path / "a.json")).collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    found: dict = {}
    for x in rows:
        found.setdefault(x["sample_token"].replace('\\"', '"').replace("\\u00e9", "é"), []).append((x["box_pos"], x["body"]))
    assert found.keys() == results.keys()
    for token, boxes in results.items():
        got = sorted(b for b in found[token] if b[1] is not None)
        assert [k for k, _ in got] == list(range(len(boxes))) and [json.loads("{" + b + "}") for _, b in got] == boxes
        assert boxes or found[token] == [(None, None)]


def test_shards_are_one_object(spark, tmp_path):
    boxes = spark.range(40).selectExpr(
        "concat('t', cast(id % 7 as string)) sample_token", "cast(id as int) box_pos", "0 expert_ord", "cast(id as double) x", "0D y", "0D z", "1D w", "2D l", "1D h", "1D qw", "0D qx", "0D qy", "0D qz", "0D vx", "0D vy", "'car' class_name", "cast(id as double) / 40 score", "cast(null as string) attribute"
    )
    frames = spark.createDataFrame([(f"t{k}",) for k in range(9)], "sample_token string")
    splits.save_shards(boxes, frames, str(tmp_path / "s"), meta={"use_map": True})
    doc = json.loads("".join(p.read_text() for p in sorted((tmp_path / "s").glob("part-*"))))
    assert list(doc["results"]) == sorted(f"t{k}" for k in range(9)) and doc["results"]["t8"] == [] and doc["meta"]["use_map"] and not doc["meta"]["use_radar"]
    assert sum(map(len, doc["results"].values())) == 40 and doc["results"]["t0"][0]["attribute_name"] == ""
    good, bad, tokens = splits.read_submission(spark, str(tmp_path / "s"), "x", 3, score_threshold=0.5)
    assert (good.count(), bad.count(), tokens.count(), good.select("expert_ord").distinct().collect()[0][0]) == (20, 0, 9, 3)
    (tmp_path / "n.json").write_text('{"meta": {}}')
    with pytest.raises(ValueError, match="no results"):
        splits.read_submission(spark, str(tmp_path / "n.json"), "x")
    Path(tmp_path / "e.json").write_text('{"results": {"": [], "a": []}}')
    with pytest.raises(Exception, match="empty token"):
        splits.read_submission(spark, str(tmp_path / "e.json"), "x")[2].filter(F.col("sample_token") != "zz").collect()


def test_a_submission_is_read_in_few_passes(spark):
    from boxfusion.plans import queries as Q
    from tests.conftest import DATA

    plan = Q.QUERIES["submission_roundtrip"](spark, f"{DATA}/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [value") <= 3


def test_bodies_of_boxes_are_not_shuffled(spark, tmp_path):
    """ranges are told apart within their tasks, tokens meet columns instead of bodies, shards are packed."""
    from boxfusion.plans import queries as Q
    from tests.conftest import DATA

    (tmp_path / "a.json").write_text(json.dumps({"results": made(4, 40)}))
    rows = splits.read_ranges(spark, str(tmp_path / "a.json"))
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "500b")
        with pytest.raises(Exception, match="byte ranges"):
            rows.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    found = Q.QUERIES["submission_roundtrip"](spark, f"{DATA}/sf0.001")
    plan = found._jdf.queryExecution()
    assert plan.optimizedPlan().toString().count("Relation [value") == 1
    assert all(f.endswith(".gz") for f in found.inputFiles() if "/shards/" in f)
    dealt = [line for line in plan.executedPlan().toString().split("\n") if "Exchange" in line]
    assert dealt and not any("body" in line or "value" in line for line in dealt)


def test_shards_take_frames_once_and_boxes_of_frames_only(spark, tmp_path):
    one = "concat('t', cast(id as string)) sample_token, cast(id as int) box_pos, 0 expert_ord, 0D x, 0D y, 0D z, 1D w, 2D l, 1D h, 1D qw, 0D qx, 0D qy, 0D qz, 0D vx, 0D vy, 'car' class_name, 0.5D score, cast(null as string) attribute"
    frames = spark.createDataFrame([("t0",), ("t1",), ("t1",), ("t8",), ("t8",), (None,)], "sample_token string")
    boxes = spark.sql(f"SELECT {one} FROM range(4)")
    splits.save_shards(boxes.unionByName(boxes), frames, str(tmp_path / "s"), shards=3)
    doc = json.loads("".join(p.read_text() for p in sorted((tmp_path / "s").glob("part-*"))))
    assert {k: len(v) for k, v in doc["results"].items()} == {"t0": 2, "t1": 2, "t8": 0}
