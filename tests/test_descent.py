"""Gradients against finite differences, sums against other partitionings, and training on a table."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from boxfusion.operators.ml import descent, fitting
from boxfusion.operators.ml.neural import initial_transformer, perceptron, predict, transformer


def example(kind: str, n: int = 15):
    r = np.random.default_rng(3)
    x, y = r.normal(size=(n, 3)), r.integers(0, 2, n).astype(float)
    if kind == "transformer":
        w = initial_transformer(3, d=8, layers=2, factor=2, seed=1)
    else:
        w = fitting.initial(3, (5, 4), 2)
        for layer in w["layers"]:
            layer["mean"], layer["var"] = r.normal(size=len(layer["mean"])), r.uniform(0.5, 2, len(layer["var"]))
    return descent.Fit(kind, descent.moved(kind, w, descent.flat(kind, w) + r.normal(0, 0.1, descent.flat(kind, w).size)), 2, 3.0, 0.01), x, y


@pytest.mark.parametrize("kind", ["perceptron", "transformer"])
def test_gradients_are_finite_differences(kind):
    fit, x, y = example(kind)
    loss, gradient, _ = fit.sums(x, y)
    z = perceptron(x, fit.w) if kind == "perceptron" else transformer(x, fit.w, 2)
    assert np.isclose(loss, np.where(y > 0, 3 * np.logaddexp(0, -z), np.logaddexp(0, z)).sum())
    values = descent.flat(kind, fit.w)
    places = np.random.default_rng(0).permutation(len(values))[:300]
    for k in places:
        step = np.zeros_like(values)
        step[k] = 1e-6
        ends = [descent.Fit(kind, descent.moved(kind, fit.w, values + s * step), 2, 3.0, 0.01).sums(x, y)[0] for s in (1, -1)]
        assert np.isclose((ends[0] - ends[1]) / 2e-6, gradient[k], rtol=1e-4, atol=1e-5), k
    halves = [fit.sums(x[:6], y[:6]), fit.sums(x[6:], y[6:])]
    for one, (a, b) in zip(fit.sums(x, y), zip(*halves, strict=True), strict=True):
        assert np.allclose(one, np.add(a, b))


def test_steps_are_clipped_and_plateaus_end_training():
    fit, x, y = example("perceptron")
    big = fit.sums(x, y)[1] * 1e6
    fit.step(big, 0.0, 1.0)
    assert np.linalg.norm(fit.first) <= 0.1 * 1.000001
    for held in (1.0, 0.5, 0.49999, 0.6, 0.7, 0.8, 0.9):
        fit.judge(held, 5, 3)
    assert (fit.best_loss, fit.rate, fit.done) == (0.5, 0.005, True)


def table(spark, n: int = 2400):
    u = spark.range(n).select("id", *[(F.pmod(F.xxhash64("id", F.lit(k)), F.lit(2000)) / 1000 - 1).alias(f"f{k}") for k in range(3)])
    return u.select("id", (F.col("id") % 2).cast("int").alias("class_id"), "f0", "f1", F.when(F.col("id") % 11 > 0, F.col("f2")).alias("f2"), (F.col("f0") * F.col("f1") > 0.1).cast("int").alias("label"))


@pytest.mark.parametrize("kind", ["perceptron", "transformer"])
def test_loss_does_not_depend_on_partitions(spark, kind):
    shape = {"hidden": (6, 4)} if kind == "perceptron" else {"d": 8, "layers": 1, "factor": 2}
    found = [descent.train(table(spark, 600).repartition(n), ["f0", "f1", "f2"], key=["id"], kind=kind, shape=shape, epochs=3)[1] for n in (1, 8)]
    assert found[0].keys() == found[1].keys() == {0, 1}
    for k in (0, 1):
        assert len(found[0][k].losses) == 3
        assert np.allclose(found[0][k].losses, found[1][k].losses, rtol=1e-9)
        assert np.allclose(found[0][k].held_losses, found[1][k].held_losses, rtol=1e-9)


def test_training_learns_and_odd_rows(spark):
    rows = table(spark)
    odd = spark.createDataFrame([(-1, None, 0.1, 0.1, 0.1, 1), (-2, 0, 0.1, 0.1, float("nan"), None), (-3, 7, 0.1, 0.1, 0.1, 1)], "id long, class_id int, f0 double, f1 double, f2 double, label int")
    routers, fits = descent.train(rows.unionByName(odd), ["f0", "f1", "f2"], key=["id"], shape={"hidden": (16, 8)}, epochs=25, rate=0.05, batches=2)
    assert routers.keys() == {0, 1}
    for f in fits.values():
        assert f.best_loss < 0.7 * f.held_losses[0]
    scored = predict(descent.filled(rows, routers, ["f0", "f1", "f2"]), routers, ["f0", "f1", "f2"], "class_id").select("label", "p").toPandas()
    assert ((scored.p >= 0.5) == (scored.label == 1)).mean() > 0.8
    assert scored.p.between(0, 1).all()
    assert descent.train(rows.limit(0), ["f0"], key=["id"]) == ({}, {})
    with pytest.raises(ValueError, match="kind"):
        descent.train(rows, ["f0"], kind="forest")


def test_router_query_beats_its_score_on_held_out_rows(spark):
    from boxfusion.operators.metrics import roc_auc
    from boxfusion.plans import queries as Q
    from tests.conftest import DATA

    got = Q.QUERIES["perceptron_router"](spark, f"{DATA}/sf0.001")
    rows = Q.router_rows(spark, f"{DATA}/sf0.001")
    assert got.count() == rows.count() and got.filter("p is null or p < 0 or p > 1").count() == 0
    held = got.filter("held_out").join(rows.select("box_key", "detection_score"), "box_key")
    assert 300 < held.count() < 900
    by = lambda c: {r.class_id: r.auc for r in roc_auc(held, ["class_id"], c).collect()}
    mine, score = by("p"), by("detection_score")
    assert sum(mine.values()) > sum(score.values()) + 0.3, (mine, score)


def test_rows_go_to_a_step_as_blocks(spark, monkeypatch):
    """F8: blocks of one class hold all rows once, as bytes, and their sums are those of the rows."""
    monkeypatch.setattr(descent, "BLOCK", 50)
    rows = descent.prepare(table(spark, 600).na.fill(0.0), ["f0", "f1", "f2"], "class_id", ["id"], "label", 2, 42)
    blocks = descent.blocks_of(rows.coalesce(2), 600)
    held = blocks.collect()
    assert len(held) < 30 and sum(len(r["y"]) // 8 for r in held) == 600
    fit = example("perceptron")[0]
    got = descent.pass_sums(blocks, {0: fit, 1: fit})
    plain = rows.toPandas()
    for k in (0, 1):
        parts = []
        for apart in (False, True):
            mine = plain[(plain.by == k) & (plain.held == apart)]
            parts.append((fit.sums(np.stack(mine.x), mine.y.to_numpy()), len(mine)))
        (loss, gradient, seen), n = parts[0]
        want = np.concatenate([gradient, [loss, n, parts[1][0][0], parts[1][1]], seen])
        assert np.allclose(got[k], want)
