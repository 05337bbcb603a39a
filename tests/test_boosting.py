"""Boosted trees against plain computations with numpy, other partitionings and odd tables."""

from __future__ import annotations

from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from boxfusion.operators.ml import boosting
from tests.conftest import DATA

FEATURES = ["f0", "f1", "f2"]


def table(spark, n: int = 1500):
    """Two classes; a label that two features decide between them, with a tenth of the rows against it; gaps in a feature."""
    u = spark.range(n).select("id", *[(F.pmod(F.xxhash64("id", F.lit(k)), F.lit(41)) / 20 - 1).alias(f"f{k}") for k in range(3)])
    true = (F.col("f0") * F.col("f1") > 0.1) != (F.col("id") % 10 == 3)
    return u.select("id", (F.col("id") % 2).cast("int").alias("class_id"), "f0", "f1", F.when(F.col("id") % 11 > 0, F.col("f2")).alias("f2"), true.cast("int").alias("label"))


def same(a: dict, b: dict) -> None:
    assert a.keys() == b.keys()
    for k in a:
        assert (a[k].rounds, a[k].held_ap) == (b[k].rounds, b[k].held_ap)
        for x, y in zip(sum(a[k].models, []), sum(b[k].models, []), strict=True):
            assert all(np.array_equal(getattr(x, n), getattr(y, n)) for n in ("feature", "bin", "missing_left", "value"))


def plain_tree(x, g, h, depth, l2=2.0, least=1.0, step=0.3):
    """Values of the rows by exhaustive search over features, cuts at seen values and sides of missing ones."""
    score = lambda m: g[m].sum() ** 2 / (h[m].sum() + l2)

    def grow(rows, level):
        best = (1e-6, None)
        for f in range(x.shape[1]) if level < depth else ():
            for with_missing in (False, True):
                for c in np.unique(x[~np.isnan(x[:, f]), f]):
                    left = rows & (np.where(np.isnan(x[:, f]), with_missing, x[:, f] <= c))
                    right = rows & ~left
                    gain = round(score(left) + score(right) - score(rows), 9) if min(h[left].sum(), h[right].sum()) >= least else 0
                    if gain > best[0]:
                        best = (gain, left)
        if best[1] is None:
            return np.where(rows, -step * g[rows].sum() / (h[rows].sum() + l2), 0)
        return grow(best[1], level + 1) + grow(rows & ~best[1], level + 1)

    return grow(np.ones(len(x), bool), 0)


def test_trees_are_those_of_exhaustive_search(spark):
    rows = table(spark, 400).withColumn("held", F.lit(False)).withColumn("class_id", F.lit(1))
    forest = boosting.train(rows, FEATURES, key=["id"], held="held", fallback=3, depth=3, step=0.3, share=1.0, columns=1.0, bins=200)[1]
    assert forest.rounds == len(forest.models[0]) == 3
    r = rows.orderBy("id").toPandas()
    x, y = r[FEATURES].to_numpy(float), r.label.to_numpy(float)
    w, z = np.where(y > 0, (len(y) - y.sum()) / y.sum(), 1.0), np.zeros(len(y))
    for k in range(3):
        p = 1 / (1 + np.exp(-z))
        g, h = (np.round(v * boosting.GRID) / boosting.GRID for v in (w * (p - y), w * p * (1 - p)))
        z = z + plain_tree(x, g, h, 3)
        assert np.allclose(forest.margin(forest.binned(x), rounds=k + 1), z, atol=1e-9), k


def test_trees_do_not_depend_on_partitions(spark):
    found = [boosting.train(table(spark, 900).repartition(n), FEATURES, key=["id"], calibrated=(1,), rounds=4, patience=9, block=2, depth=2) for n in (1, 7)]
    same(*found)
    assert found[0][1].calibration == pytest.approx(found[1][1].calibration, rel=1e-9)


def plain_ap(y, s):
    order = np.argsort(-s, kind="stable")
    y, s = y[order], s[order]
    ends = np.append(np.flatnonzero(np.diff(s)), len(s) - 1)
    tp = y.cumsum()[ends]
    return float((np.diff(tp, prepend=0) / y.sum() * tp / (ends + 1)).sum())


def test_rounds_by_the_best_head_and_calibration_out_of_fold(spark):
    rows = table(spark).withColumn("held", F.col("id") % 5 == 0)
    forests = boosting.train(rows, FEATURES, key=["id"], held="held", calibrated=(0,), rounds=12, patience=3, block=4, depth=3, step=0.5)
    r = rows.toPandas()
    for k, f in forests.items():
        some = r[(r.class_id == k) & r.held]
        bins, y = f.binned(some[FEATURES].to_numpy(float)), some.label.to_numpy(float)
        aps = np.round([plain_ap(y, f.margin(bins, rounds=n + 1)) for n in range(len(f.held_ap))], 9)
        assert np.allclose(aps, f.held_ap, atol=2e-9)
        assert f.rounds == int(np.argmax(aps)) + 1
        assert len(aps) == len(f.models[0]) == 12 or len(aps) - f.rounds >= 3
    assert forests[1].calibration is None and len(forests[1].models) == 1

    f = forests[0]
    ready = boosting.prepare(rows, FEATURES, "class_id", ["id"], "label", "held", 42, 3).filter("by = 0 and not held").toPandas()
    assert sorted(ready.groupby(["y", "fold"]).size().groupby("y").agg(lambda n: n.max() - n.min())) <= [1, 1]
    bins = f.binned(np.stack([np.asarray(v, float) for v in ready.x]))
    p = np.select([ready.fold == k for k in range(3)], [1 / (1 + np.exp(-f.margin(bins, k + 1))) for k in range(3)])
    y = ready.y.to_numpy()
    target = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    a, b = f.calibration
    off = 1 / (1 + np.exp(-(a * p + b))) - target
    assert abs(off.sum()) < 1e-5 and abs((off * p).sum()) < 1e-5  # where the loss is least
    for k in range(3):  # a fold's model has not seen it
        assert not np.allclose(f.margin(bins, 0), f.margin(bins, k + 1))

    scored = boosting.predict(rows, forests, FEATURES, raw="raw").toPandas()
    mine = scored[scored.class_id == 0]
    z = f.margin(f.binned(mine[FEATURES].to_numpy(float)))
    assert np.allclose(mine.raw, 1 / (1 + np.exp(-z)))
    assert np.allclose(mine.p, 1 / (1 + np.exp(-(a * mine.raw + b))))
    assert ((scored.p >= 0.5) == (scored.label == 1)).mean() > 0.8
    held = mine[mine.held]
    assert ((held.p - held.label) ** 2).mean() <= ((held.raw - held.label) ** 2).mean() + 0.002


def test_odd_tables(spark):
    rows = table(spark, 400)
    odd = spark.createDataFrame(
        [(-1, None, 0.1, 0.1, 0.1, 1), (-2, 0, 0.1, 0.1, 0.1, None), (-3, 7, 0.1, 0.1, 0.1, 1), (-4, 0, float("nan"), float("inf"), None, 1), (-4, 0, float("nan"), float("inf"), None, 1)],
        "id long, class_id int, f0 double, f1 double, f2 double, label int",
    )
    every = rows.unionByName(odd)
    forests = boosting.train(every, FEATURES, key=["id"], fallback=2, rounds=2, depth=2)
    assert forests.keys() == {0, 1}
    scored = {r["id"]: r["p"] for r in boosting.predict(every, forests, FEATURES).filter("id < 0").collect()}
    assert scored[-1] is scored[-3] is None and all(0 < scored[k] < 1 for k in (-2, -4))
    empty = rows.filter("id < 0")
    assert boosting.train(empty, FEATURES, key=["id"]) == {}
    assert boosting.predict(empty, forests, FEATURES).count() == 0
    assert boosting.train(rows.filter("label = 1"), FEATURES, key=["id"]) == {}
    blank = rows.withColumn("f2", F.lit(None).cast("double"))
    assert all(2 not in t.feature for f in boosting.train(blank, FEATURES, key=["id"], rounds=2, depth=2).values() for t in f.models[0])
    with pytest.raises(ValueError, match="bins"):
        boosting.train(rows, FEATURES, bins=1)
    with pytest.raises(ValueError, match="there already"):
        boosting.predict(rows.withColumn("p", F.lit(1)), forests, FEATURES)


def test_router_report(spark):
    from boxfusion.plans import queries as Q

    got = {(r["class_id"], r["held_out"]): r for r in Q.QUERIES["boosted_router_report"](spark, f"{DATA}/sf0.001").collect()}
    assert len(got) == 6
    for (k, _), r in got.items():
        assert 1 <= r["best_round"] <= r["rounds"] <= 30
        assert r["calibrated"] == (k == 2)
        assert (r["brier"] < r["brier_raw"]) if k == 2 else (r["brier"] == r["brier_raw"])
    assert all(got[k, False]["auc"] > 0.55 for k in range(3))


def test_rows_go_to_a_level_as_blocks(spark, monkeypatch):
    """blocks of one class hold all rows once, as bytes; sums over them are those row by row."""
    monkeypatch.setattr(boosting, "BLOCK", 64)
    rows = table(spark, 900)
    forests = boosting.train(rows, FEATURES, key=["id"], calibrated=(1,), rounds=2, depth=3)
    ready = boosting.prepare(rows, FEATURES, "class_id", ["id"], "label", None, 42, 3)
    blocks = boosting.blocks_of(ready.coalesce(2), forests, 900)
    held = [boosting.unpacked(r) for r in blocks.collect()]
    assert len(held) < 30 and sum(len(b["h"]) for b in held) == 900
    plain = ready.toPandas()
    assert sorted(h for b in held for h in b["h"].tolist()) == sorted(plain.h)

    for f in forests.values():
        for trees in f.models:
            trees.append(trees[-1])
        f.done = 0
    got = boosting.level_sums(blocks, forests, 2, 7, 0.8)
    for k, f in forests.items():
        mine = plain[plain.by == k]
        bins = f.binned(np.stack([np.asarray(v, float) for v in mine.x]))
        drawn = f.drawn(mine.h.to_numpy(), 7, len(f.models[0]), 0.8) & ~mine.held.to_numpy()
        want = np.zeros(got[k].shape)
        for m, trees in enumerate(f.models):
            for row, y, fold, use in zip(bins, mine.y, mine.fold, drawn, strict=True):
                if not use or m > 0 and fold == m - 1:
                    continue
                walk = []
                for t in trees:
                    at = 0
                    for level in range(3):
                        walk.append((t, level, at))
                        if t.feature[at] >= 0:
                            b = row[t.feature[at]]
                            at = 2 * at + (1 if (t.missing_left[at] if b == boosting.MISSING else b <= t.bin[at]) else 2)
                    walk.append((t, 3, at))
                z = sum(t.value[at] for t, level, at in walk[:-4] if level == 3)
                at = walk[-2][2] - 3  # the last tree's place before its third level
                if at < 0:
                    continue
                p, w = 1 / (1 + np.exp(-z)), f.positive if y > 0 else 1.0
                for k_, b in enumerate(row):
                    want[m, at, k_, -1 if b == boosting.MISSING else b] += np.round(np.array([w * (p - y), w * p * (1 - p)]) * boosting.GRID) / boosting.GRID
        assert np.allclose(got[k], want, atol=1e-5) and np.abs(want).sum() > 0


def test_disk_of_training(spark, tmp_path, monkeypatch):
    """rows are kept as packed blocks only, of one table of margins and the next; folds are dealt by hashes and
    bins; nothing stays."""
    kept, tables = [], []
    real = boosting.hold

    def hold(df, path, **options):
        assert "x" not in df.columns
        out = real(df, path, **options)
        folder = Path(path).parent
        tables.append((df.columns, sorted(p.name for p in folder.iterdir())))
        kept.append(folder)
        return out

    monkeypatch.setattr(boosting, "hold", hold)
    monkeypatch.setattr(boosting, "scratch", lambda spark, name: str(tmp_path / name))
    rows = table(spark, 900)
    forests = boosting.train(rows, FEATURES, key=["id"], calibrated=(1,), rounds=6, patience=9, block=2, depth=2)
    assert len(forests[1].models[0]) == 6 and forests[1].calibration
    assert all(len(held) <= 2 for _, held in tables) and [c for c, _ in tables if "steps" in c] == []
    assert len(kept) == 4 and not any(f.exists() for f in kept)  # blocks, moved on twice, and what calibrates

    ready = boosting.prepare(rows, FEATURES, "class_id", ["id"], "label", None, 42, 3).toPandas()
    blocks = boosting._packed_rows(boosting._flat(rows, FEATURES, "class_id", ["id"], "label", None, 42), forests, 900, 3, 42)
    plan = blocks._jdf.queryExecution().executedPlan().toString()
    assert not any(" x#" in line or "[x#" in line for line in plan.split("\n") if "Exchange" in line)
    found = [(r["by"], boosting.unpacked(r)) for r in blocks.collect()]
    fold = {h: k for by, b in found if by == 1 for h, k in zip(b["h"].tolist(), b["fold"].tolist(), strict=True)}
    assert fold == dict(zip(*(ready[ready.by == 1][c] for c in ("h", "fold")), strict=True)) and sum(len(b["h"]) for _, b in found) == len(ready)


def test_equal_scores_are_told_once(spark):
    """F2: steps of rows held out come as counts; their precision is that of the rows."""
    from boxfusion.operators.metrics import average_precision

    rows = table(spark, 900)
    forests = boosting.train(rows, FEATURES, key=["id"], rounds=2, depth=2)
    ready = boosting.prepare(rows, FEATURES, "class_id", ["id"], "label", None, 42, 3)
    for f in forests.values():
        f.done = 0
    told = boosting._steps(boosting.blocks_of(ready, forests, 900), forests).cache()
    held = ready.filter("held").toPandas()
    assert told.count() < 2 * len(held) and told.filter("at = 1").agg(F.sum("n")).first()[0] == len(held)
    got = {(r["by"], r["at"]): r["ap"] for r in average_precision(told, ["by", "at"], "score", "y", "n").collect()}
    for k, f in forests.items():
        some = held[held.by == k]
        bins = f.binned(np.stack([np.asarray(v, float) for v in some.x]))
        for n in range(2):
            assert got[k, n] == pytest.approx(plain_ap(some.y.to_numpy(), f.margin(bins, rounds=n + 1)))


def test_report_keeps_counts_only(spark, tmp_path, monkeypatch):
    """of scored rows the report keeps counts of equal probabilities; rows and boxes go."""
    from boxfusion.plans import queries as Q
    from boxfusion.plans import training_queries as T

    monkeypatch.setattr(T, "scratch", lambda spark, name: str(tmp_path / name))
    got = Q.QUERIES["boosted_router_report"](spark, f"{DATA}/sf0.001")
    assert [p.name for p in (tmp_path / "boosted").iterdir()] == ["scored"]
    assert not {"box_key", "label"} & set(spark.read.parquet(str(tmp_path / "boosted" / "scored")).columns)
    n = {(r["class_id"], r["held_out"]): r["n"] for r in got.collect()}
    held = F.pmod(F.xxhash64(F.lit(42), "box_key"), F.lit(10)) == 0
    assert n == {(r["class_id"], r["h"]): r["count"] for r in Q.router_rows(spark, f"{DATA}/sf0.001").groupBy("class_id", held.alias("h")).count().collect()}
