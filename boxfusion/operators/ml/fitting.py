"""Training of perceptron routers: numpy, on a bounded sample of one class's rows.

Weighted cross entropy, batch norm, Adam with weight decay; a tenth of the rows is held out, on which
the rate is halved when the loss stalls, training stops, the best weights are kept, and an isotonic
calibration is fitted."""

from __future__ import annotations

import copy

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxfusion.operators.ml.neural import NeuralRouter, perceptron


def initial(features: int, hidden: tuple[int, ...], seed: int) -> dict:
    r = np.random.default_rng(seed)
    sizes = [features, *hidden]
    spread = lambda n_out, n_in: r.normal(0, np.sqrt(2 / n_in), (n_out, n_in))
    layers = [{"weight": spread(b, a), "bias": np.zeros(b), "mean": np.zeros(b), "var": np.ones(b), "scale": np.ones(b), "shift": np.zeros(b)} for a, b in zip(sizes, sizes[1:], strict=False)]
    return {"layers": layers, "head_weight": spread(1, sizes[-1]), "head_bias": np.zeros(1)}


def loss(w: dict, x: np.ndarray, y: np.ndarray, positive: float) -> float:
    z = perceptron(x, w)
    return float(np.mean(np.where(y > 0, positive * np.logaddexp(0, -z), np.logaddexp(0, z))))


def gradients(w: dict, x: np.ndarray, y: np.ndarray, positive: float, drop: float = 0.0, r: np.random.Generator | None = None, momentum: float = 0.1) -> list[np.ndarray]:
    """Of ``parameters``, over one batch, by whose figures layers are normalised; running figures follow."""
    held = []
    for layer in w["layers"]:
        z = x @ layer["weight"].T + layer["bias"]
        mean, var = z.mean(axis=0), z.var(axis=0)
        layer["mean"] += momentum * (mean - layer["mean"])
        layer["var"] += momentum * (var * len(z) / max(1, len(z) - 1) - layer["var"])
        root = np.sqrt(var + 1e-5)
        even = (z - mean) / root
        out = even * layer["scale"] + layer["shift"]
        on = out > 0
        keep = (r.random(out.shape) >= drop) / (1 - drop) if drop and r is not None else 1.0
        held.append((x, even, root, on * keep))
        x = np.maximum(out, 0) * keep
    z = (x @ w["head_weight"].T + w["head_bias"])[:, 0]
    p = 1 / (1 + np.exp(-np.clip(z, -60, 60)))
    back = (np.where(y > 0, positive * (p - 1), p) / len(y))[:, None]
    found = [back.T @ x, back.sum(axis=0)]
    back = back @ w["head_weight"]
    for layer, (before, even, root, on) in zip(reversed(w["layers"]), reversed(held), strict=True):
        back = back * on
        shift, scale = back.sum(axis=0), (back * even).sum(axis=0)
        flat = back * layer["scale"]
        flat = (flat - flat.mean(axis=0) - even * (flat * even).mean(axis=0)) / root
        found = [flat.T @ before, flat.sum(axis=0), scale, shift, *found]
        back = flat @ layer["weight"]
    return found


def parameters(w: dict) -> list[np.ndarray]:
    return [*(layer[k] for layer in w["layers"] for k in ("weight", "bias", "scale", "shift")), w["head_weight"], w["head_bias"]]


def rising(p: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the rising step-wise means of ``y`` by ``p``: neighbours that fall are pooled."""
    at, inverse = np.unique(p, return_inverse=True)
    n = np.bincount(inverse).astype(float)
    blocks: list[list[float]] = []
    for k, (total, size) in enumerate(zip(np.bincount(inverse, y), n, strict=True)):
        blocks.append([total, size, k, k])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            total, size, _, last = blocks.pop()
            blocks[-1][0] += total
            blocks[-1][1] += size
            blocks[-1][3] = last
    ends = [(at[int(k)], b[0] / b[1]) for b in blocks for k in dict.fromkeys(b[2:])]
    return np.array([x for x, _ in ends]), np.array([v for _, v in ends])


def fit_perceptron(
    rows: DataFrame, features: list[str], hidden: tuple[int, ...] = (256, 128, 64), label: str = "label", most: int = 1_000_000, epochs: int = 30, batch: int = 4096, rate: float = 1e-3, decay: float = 1e-4,
    drop: float = 0.2, patience: int = 5, stall: int = 3, min_positives: int = 20, seed: int = 42,
) -> NeuralRouter | None:
    """A router from the rows of one class, at most ``most`` of them by the least hash of their features; None with
    too few positives."""
    order = F.xxhash64(F.lit(seed), *features, label)
    took = rows.select(*[F.col(f).cast("double").alias(f) for f in features], F.col(label).cast("double").alias("__label__"), order.alias("__hash__")).orderBy("__hash__").limit(most).toPandas()
    y = took["__label__"].to_numpy()
    if y.sum() < min_positives:
        return None
    x, positive = took[features].to_numpy(float), float((len(y) - y.sum()) / max(1.0, y.sum()))
    r = np.random.default_rng(seed)
    apart = r.random(len(y)) < 0.1
    fit, held = (~apart, apart) if 0 < apart.sum() < len(y) else (np.ones(len(y), bool),) * 2
    mean, std = x[fit].mean(axis=0), x[fit].std(axis=0)
    x = (x - mean) / np.where(std == 0, 1, std)
    w = initial(len(features), hidden, seed)
    first, second = ([np.zeros_like(p) for p in parameters(w)] for _ in range(2))
    best, best_loss, since, stalled, steps = copy.deepcopy(w), np.inf, 0, 0, 0
    places = np.flatnonzero(fit)
    for _ in range(epochs):
        r.shuffle(places)
        for at in range(0, len(places), batch):
            some = places[at : at + batch]
            if len(some) < 2:  # no figures to normalise by
                continue
            steps += 1
            for p, g, m, v in zip(parameters(w), gradients(w, x[some], y[some], positive, drop, r), first, second, strict=True):
                g = g + decay * p
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= rate * (m / (1 - 0.9**steps)) / (np.sqrt(v / (1 - 0.999**steps)) + 1e-8)
        now = loss(w, x[held], y[held], positive)
        if now < best_loss - 1e-4 * abs(best_loss if np.isfinite(best_loss) else 0):
            best, best_loss, since, stalled = copy.deepcopy(w), now, 0, 0
            continue
        since, stalled = since + 1, stalled + 1
        if stalled > stall:
            rate, stalled = rate / 2, 0
        if since >= patience:
            break
    knots = rising(1 / (1 + np.exp(-perceptron(x[held], best))), y[held])
    return NeuralRouter("perceptron", best, mean, std, knots=knots)
