"""Quantiles by histograms and suppression by rounds against plain computations."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from boxfusion.operators import crowded, nms, quantiles


def test_quantiles_equal_numpy(spark, monkeypatch):
    """Ties, outliers, values of all magnitudes, and infinite, missing and no values; few buckets make many rounds."""
    monkeypatch.setattr(quantiles, "BUCKETS", 256)
    monkeypatch.setattr(quantiles, "FEW", 5)
    r = random.Random(1)
    n = 300
    columns = {
        "ties": [float(r.randrange(5)) for _ in range(n)], "wide": [r.choice([-1, 1]) * 10 ** r.uniform(-300, 300) for _ in range(n)], "huge": [r.uniform(-1.7e308, 1.7e308) for _ in range(n)],
        "one": [3.5] * n, "holes": [r.random() if r.random() < 0.5 else None for _ in range(n)], "ends": [r.choice([-math.inf, math.inf, 1.0, 2.0]) for _ in range(n)], "none": [None] * n,
    }
    df = spark.createDataFrame(list(zip(*columns.values(), strict=True)), ", ".join(f"{c} double" for c in columns)).repartition(5)
    at = [0.0, 0.25, 0.99]
    found = quantiles.quantiles(df, list(columns), at)
    for c, values in columns.items():
        known = np.sort([v for v in values if v is not None])
        for p in at:
            if not len(known):
                assert found[c, p] is None
                continue
            h = p * (len(known) - 1)
            a, b = known[math.floor(h)], known[math.ceil(h)]
            want = a if a == b else a + (b - a) * (h - math.floor(h))
            assert found[c, p] == want or (math.isnan(want) and math.isnan(found[c, p])) or found[c, p] == pytest.approx(want, rel=1e-12), (c, p)


def test_crowded_suppression_equals_greedy(spark):
    """10,000 boxes of one frame, and ties of scores; the fold and a plain loop keep the same."""
    r = random.Random(5)
    rows = [(k, r.randrange(1000) / 1000, r.randrange(400) / 2, r.randrange(400) / 2, r.choice([1.0, 2.0, 3.0]), r.choice([2.0, 4.0, 9.0]), r.choice("ab")) for k in range(10_000)]
    df = spark.createDataFrame([("f", *x) for x in rows], "frame string, k int, score double, x double, y double, w double, l double, class_name string").repartition(6)
    found = {x["k"] for x in crowded.suppress(df, ["frame"], order=("k",), cell=6.0).select("k").collect()}
    kept: list[tuple] = []
    for b in sorted(rows, key=lambda b: (-b[1], b[0])):
        over = False
        for a in kept:
            if a[6] == b[6] and abs(a[2] - b[2]) < 9 and abs(a[3] - b[3]) < 3:
                dx = min(a[2] + a[5] / 2, b[2] + b[5] / 2) - max(a[2] - a[5] / 2, b[2] - b[5] / 2)
                dy = min(a[3] + a[4] / 2, b[3] + b[4] / 2) - max(a[3] - a[4] / 2, b[3] - b[4] / 2)
                inter = max(0.0, dx) * max(0.0, dy)
                over |= inter > 0 and inter / (a[4] * a[5] + b[4] * b[5] - inter) >= 0.3
        if not over:
            kept.append(b)
    assert found == {b[0] for b in kept} and 0 < len(found) < 10_000
    small = df.filter("k < 800")
    assert {x["k"] for x in nms.suppress(small, ["frame"], order=("k",)).select("k").collect()} == {x["k"] for x in crowded.suppress(small, ["frame"], order=("k",)).select("k").collect()}
    assert crowded.suppress(df.limit(0), ["frame"], order=("k",)).count() == 0
