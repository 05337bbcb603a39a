"""Boosted trees for all classes at once: each level of a round is one Spark job.

Features are cut into bins.  A task adds up slopes and curvatures of its rows by class, model, node, feature and bin;
the vectors are added in the JVM, first in groups of tasks and then for each class, and the driver, which picks the
splits, gets one vector for each class: models x nodes of a level x features x bins x 2 numbers, whatever the rows.

A class has a model of all rows to fit and, where it is calibrated, one without each fold.  They grow side by side, so
that rounds, early stopping and out-of-fold calibration need no further training: a shorter ensemble is the head of a
longer one.  Slopes are rounded to a grid on which sums of doubles are exact, so that trees do not depend on how rows
are parted, nor on tasks that run again.

Rows lie in blocks of one class, each column's values as bytes side by side and bins feature by feature, so that a level
costs a task some passes over bytes and no object for each row."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from boxfusion.functions.geometry import sigmoid
from boxfusion.operators.metrics import average_precision
from boxfusion.operators.splits import folds_by, stratified_folds
from boxfusion.operators.state import hold, remove, scratch, swept

#: Groups of tasks whose vectors are added first; steps of the grid of slopes (sums of 2^26 rows are exact).
GROUPS, GRID = 32, 2.0**20
#: The bin of missing values, after at most as many others.
MOST_BINS, MISSING = 254, 255
#: Rows of a block, and of a task's blocks.
BLOCK, TASK = 1 << 14, 1 << 18
#: Columns of a block beside ``by``.
PACKED = {"bins": np.uint8, "y": np.uint8, "held": np.bool_, "fold": np.int16, "h": np.int64, "margins": np.float64}


@dataclass
class Tree:
    """A full binary tree by place; ``feature`` is -1 at leaves; a row goes left if its bin is at most ``bin``."""

    depth: int
    feature: np.ndarray = field(init=False)
    bin: np.ndarray = field(init=False)
    missing_left: np.ndarray = field(init=False)
    value: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        size = 2 ** (self.depth + 1) - 1
        self.feature, self.bin = np.full(size, -1), np.zeros(size, int)
        self.missing_left, self.value = np.zeros(size, bool), np.zeros(size)

    def places(self, bins: np.ndarray, levels: int | None = None) -> np.ndarray:
        """Where each row of ``bins`` stands after so many levels."""
        ends, at = self._ends(bins, self.depth if levels is None else levels)
        return ends[at]

    def values(self, bins: np.ndarray) -> np.ndarray:
        ends, at = self._ends(bins, self.depth)
        return self.value[ends][at]

    def _ends(self, bins: np.ndarray, levels: int) -> tuple[np.ndarray, np.ndarray]:
        """The places after so many levels, by the turns that lead there, and each row's turns as one number; rows at
        leaves turn left.  Nodes are passed one by one, each over whole columns of ``bins``."""
        column = bins.T
        at = np.zeros(len(bins), np.uint8 if levels <= 8 else np.uint32)
        ends = np.zeros(1, int)
        for level in range(levels):
            right = np.zeros(len(bins), bool)
            for turns, k in enumerate(ends):
                if self.feature[k] < 0:
                    continue
                b = column[self.feature[k]]
                on = b > self.bin[k]
                if self.missing_left[k]:
                    on &= b != MISSING
                right |= on & (at == turns) if level else on
            at = 2 * at + right
            ends = np.stack([np.where(self.feature[ends] >= 0, 2 * ends + side, ends) for side in (1, 2)], axis=1).ravel()
        return ends, at

    def split(self, level: int, sums: np.ndarray, allowed: np.ndarray, l2: float, least: float, step: float) -> bool:
        """Splits the nodes of ``level`` by sums (node, feature, bin, slope or curvature), the last bin being the missing
        values'; of equal gains the first feature, missing values to the right and the lowest bin win."""
        total = sums[:, 0].sum(axis=1)
        if level == 0:
            self.value[0] = -step * total[0, 0] / (total[0, 1] + l2)
        below = sums[:, :, :-1].cumsum(axis=2)
        left = np.stack([below, below + sums[:, :, -1:]], axis=2)  # node, feature, side of missing values, bin
        right = total[:, None, None, None] - left
        score = lambda s: s[..., 0] ** 2 / (s[..., 1] + l2)
        gain = score(left) + score(right) - score(total)[:, None, None, None]
        gain = np.where((left[..., 1] >= least) & (right[..., 1] >= least) & allowed[None, :, None, None], gain, 0)
        each = np.round(gain.reshape(len(gain), -1), 9)
        grew = False
        for node, k in enumerate(each.argmax(axis=1)):
            if each[node, k] <= 1e-6:
                continue
            f, side, b = np.unravel_index(k, gain.shape[1:])
            at = 2**level - 1 + node
            self.feature[at], self.bin[at], self.missing_left[at], grew = f, b, side == 1, True
            for child, s in ((2 * at + 1, left[node, f, side, b]), (2 * at + 2, right[node, f, side, b])):
                self.value[child] = -step * s[0] / (s[1] + l2)
        return grew


@dataclass
class Forest:
    """One class's ensembles: that of all rows, then those without each fold.

    ``done``: rounds that the rows' margins hold; ``rounds``: of the best average precision on rows held out (``held_ap``,
    by round), else all."""

    edges: list[np.ndarray]
    positive: float
    models: list[list[Tree]]
    done: int = 0
    rounds: int = 0
    held_ap: list[float] = field(default_factory=list)
    calibration: tuple[float, float] | None = None
    ended: bool = False

    @property
    def width(self) -> int:
        """Bins of a feature, with that of missing values."""
        return max(map(len, self.edges)) + 2

    def judge(self, aps: list[float], patience: int) -> None:
        """Of precisions equal to 9 digits, as sums differ beyond, the first round counts."""
        self.held_ap += [round(v, 9) for v in aps]
        best = int(np.argmax(self.held_ap))
        self.rounds, self.ended = best + 1, len(self.held_ap) - 1 - best >= patience

    def binned(self, x: np.ndarray) -> np.ndarray:
        known = [np.where(np.isnan(v), MISSING, np.searchsorted(e, v)) for v, e in zip(x.T, self.edges, strict=True)]
        return np.array(known, np.uint8).reshape(len(self.edges), len(x)).T

    def margin(self, bins: np.ndarray, model: int = 0, rounds: int | None = None) -> np.ndarray:
        return sum((t.values(bins) for t in self.models[model][: self.rounds if rounds is None else rounds]), np.zeros(len(bins)))

    def drawn(self, hashes: np.ndarray, seed: int, at: int, share: float) -> np.ndarray:
        """The rows of a round, by the hash of their key."""
        h = hashes.astype(np.uint64) ^ np.uint64((seed * 1_000_003 + at + 1) * 0x9E3779B97F4A7C15 % 2**64)
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return (h >> np.uint64(40)).astype(float) < share * 2**24

    def sums(self, level: int, some: dict[str, np.ndarray], seed: int, share: float) -> np.ndarray:
        """Sums over a block of all models' last trees for the nodes of ``level``: (model, node, feature, bin, 2)."""
        n, width, first = 2**level, self.width, 2**level - 1
        out = np.zeros((len(self.models), n, len(self.edges), width, 2))
        use = self.drawn(some["h"], seed, len(self.models[0]), share) & ~some["held"]
        for m, trees in enumerate(self.models):
            mine = np.flatnonzero(use if m == 0 else use & (some["fold"] != m - 1))
            column, truth = some["bins"].T[:, mine], some["y"][mine]
            z = some["margins"][mine, m] + sum((t.values(column.T) for t in trees[self.done : -1]), np.zeros(len(mine)))
            p, w = 1 / (1 + np.exp(-np.clip(z, -60, 60))), np.where(truth > 0, self.positive, 1.0)
            g, h = np.round(w * (p - truth) * GRID) / GRID, np.round(w * p * (1 - p) * GRID) / GRID
            at = trees[-1].places(column.T, level) - first
            if level and (at < 0).any():
                here = np.flatnonzero(at >= 0)
                column, g, h, at = column[:, here], g[here], h[here], at[here]
            at = at * width
            for f, b in enumerate(column):
                cell = at + np.where(b == MISSING, np.uint8(width - 1), b)
                for k, v in enumerate((g, h)):
                    out[m, :, f, :, k] = np.bincount(cell, weights=v, minlength=n * width).reshape(n, width)
        return out


def unpacked(row: object) -> dict[str, np.ndarray]:
    """A block's columns; of bins and margins, a row for each of its rows."""
    out = {c: np.frombuffer(getattr(row, c), kind) for c, kind in PACKED.items()}
    n = len(out["h"])
    return out | {"bins": out["bins"].reshape(-1, n).T, "margins": out["margins"].reshape(n, -1)}


def packed(some: dict[str, np.ndarray]) -> dict[str, bytes]:
    return {c: np.asarray(some[c].T if c == "bins" else some[c], kind).tobytes() for c, kind in PACKED.items()}


def _bytes(rows: np.ndarray) -> pa.Array:
    """Each row's bytes as one value."""
    n, width = rows.shape
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(n + 1, dtype=np.int32) * np.int32(width)), pa.py_buffer(np.ascontiguousarray(rows).tobytes())])


def _rows(values: pa.Array) -> np.ndarray:
    """What ``_bytes`` was given."""
    n = len(values)
    ends = np.frombuffer(values.buffers()[1], np.int32)[values.offset : values.offset + n + 1]
    return np.frombuffer(values.buffers()[2], np.uint8)[ends[0] : ends[-1]].reshape(n, -1)


def _of_class(batch: pa.RecordBatch) -> Iterator[tuple[object, np.ndarray]]:
    """Each class of a batch and where its rows are."""
    by = batch.column("by")
    for k in pc.unique(by).to_pylist():
        yield k, np.flatnonzero(pc.equal(by, pa.scalar(k, by.type)).to_numpy(zero_copy_only=False))


def binned(rows: DataFrame, forests: dict) -> DataFrame:
    """``rows`` of the classes of ``forests``, with ``bins``, a byte for each feature, instead of ``x``."""
    rest = [f for f in rows.schema if f.name != "x"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                bins = np.empty(x.shape, np.uint8)
                for k, mine in _of_class(batch):
                    bins[mine] = forests[k].binned(x[mine])
                yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in rest], _bytes(bins)], [*[f.name for f in rest], "bins"])

    return rows.filter(F.col("by").isin(list(forests))).mapInArrow(run, StructType([*rest, StructField("bins", BinaryType())]))


def blocks_of(rows: DataFrame, forests: dict, count: int) -> DataFrame:
    """Blocks of ``rows`` (as of ``prepare``, or with ``bins`` already; ``count`` of them), whose margins are 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}

        def blocks(some: list) -> pa.RecordBatch:
            out = []
            for k in some:
                b = {c: np.concatenate([piece[c] for piece in held[k]]) for c in ("y", "held", "fold", "h", "bins")}
                out.append(packed(b | {"margins": np.zeros((len(b["h"]), len(forests[k].models)))}))
                del held[k]
            return pa.RecordBatch.from_arrays([pa.array(some, kind), *[pa.array([b[c] for b in out], pa.binary()) for c in PACKED]], ["by", *PACKED])

        for batch in batches:
            kind = batch.column("by").type
            whole = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("y", "held", "fold", "h")} | {"bins": _rows(batch.column("bins"))} if batch.num_rows else {}
            for k, mine in _of_class(batch):
                held.setdefault(k, []).append({c: v[mine] for c, v in whole.items()})
            if full := [k for k, some in held.items() if sum(len(b["h"]) for b in some) >= BLOCK]:
                yield blocks(full)
        if held:
            yield blocks(list(held))

    at = rows.filter(F.col("by").isin(list(forests))) if "bins" in rows.columns else binned(rows, forests)
    made = at.mapInArrow(run, f"by {rows.schema['by'].dataType.simpleString()}, " + ", ".join(f"{c} binary" for c in PACKED))
    return made.repartition(max(1, -(-count // TASK)))  # as many tasks a step as rows ask for


def level_sums(rows: DataFrame, forests: dict, level: int, seed: int, share: float) -> dict:
    """By class: the sums of ``Forest.sums`` over the blocks ``rows``."""
    shared = rows.sparkSession.sparkContext.broadcast(forests)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict = {}
        for b in batches:
            for row in b.itertuples():
                found = shared.value[row.by].sums(level, unpacked(row), seed, share)
                total[row.by] = total[row.by] + found if row.by in total else found
        if total:
            yield pd.DataFrame({"by": list(total), "sums": [v.ravel() for v in total.values()]})

    kind = rows.schema["by"].dataType.simpleString()
    at = rows.filter(F.col("by").isin(list(forests)))
    each = at.mapInPandas(run, f"by {kind}, sums array<double>").select("by", (F.spark_partition_id() % GROUPS).alias("part"), array_to_vector("sums").alias("v"))
    for keys in (["by", "part"], ["by"]):
        each = each.groupBy(*keys).agg(Summarizer.metrics("sum").summary(F.col("v")).alias("v")).select(*keys, F.col("v.sum").alias("v"))
    out = {}
    for r in each.select("by", vector_to_array("v").alias("v")).collect():  # one row for each class
        f = forests[r["by"]]
        out[r["by"]] = np.array(r["v"]).reshape(len(f.models), 2**level, len(f.edges), f.width, 2)
    shared.unpersist()
    return out


def _moved_on(rows: DataFrame, forests: dict) -> DataFrame:
    """Blocks of the classes of ``forests`` whose margins hold all trees."""

    def moved(row: object) -> dict:
        f, some = forests[row.by], unpacked(row)
        margins = some["margins"].copy()
        for m, trees in enumerate(f.models):
            for t in trees[f.done :]:
                margins[:, m] += t.values(some["bins"])
        return {"by": row.by} | packed(some | {"margins": margins})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield pd.DataFrame([moved(row) for row in b.itertuples()])

    return rows.filter(F.col("by").isin(list(forests))).mapInPandas(run, rows.schema)


def _steps(rows: DataFrame, forests: dict) -> DataFrame:
    """(by, at, score, n, y): for each round that the margins of the blocks ``rows`` do not hold yet, margins of rows held
    out, how many rows have them and how many of these are positive; a batch's equal margins are one row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for k, some in b.groupby("by"):
                f, blocks = forests[k], [unpacked(row) for row in some.itertuples()]
                apart = [np.flatnonzero(x["held"]) for x in blocks]
                y = np.concatenate([x["y"][at] for x, at in zip(blocks, apart, strict=True)])
                if not len(y):
                    continue
                bins = np.concatenate([x["bins"][at] for x, at in zip(blocks, apart, strict=True)])
                z = np.concatenate([x["margins"][at, 0] for x, at in zip(blocks, apart, strict=True)])
                for at, t in enumerate(f.models[0][f.done :]):
                    z = z + t.values(bins)
                    score, which = np.unique(z, return_inverse=True)
                    yield pd.DataFrame({"by": k, "at": at, "score": score, "n": np.bincount(which), "y": np.bincount(which, weights=y).astype(int)})

    at = rows.filter(F.col("by").isin(list(forests))).select("by", "bins", "y", "held", "fold", "h", "margins")
    return at.mapInPandas(run, f"by {rows.schema['by'].dataType.simpleString()}, at int, score double, n long, y long")


def prepare(rows: DataFrame, features: list[str], by: str, key: list[str], label: str, held: str | None, seed: int, folds: int) -> DataFrame:
    """(by, x, y, held, h, fold): rows to fit dealt evenly into folds by class and label, rows held out with fold -1."""
    flat = _flat(rows, features, by, key, label, held, seed).withColumn("__kind", F.struct("by", "y", "held"))
    return stratified_folds(flat, ["h", "x"], "__kind", folds, seed).withColumn("fold", F.when(F.col("held"), -1).otherwise(F.col("fold"))).drop("__kind")


def _flat(rows: DataFrame, features: list[str], by: str, key: list[str], label: str, held: str | None, seed: int) -> DataFrame:
    """(by, x, y, held, h)."""
    known = rows.filter(F.col(by).isNotNull() & F.col(label).isNotNull())
    value = [F.col(f).cast("double") for f in features]
    hashed = F.xxhash64(F.lit(seed), *key)
    apart = F.coalesce(F.col(held).cast("boolean"), F.lit(False)) if held else F.pmod(hashed, F.lit(10)) == 0
    return known.select(F.col(by).alias("by"), F.array(*[F.when(~F.isnan(v), v) for v in value]).alias("x"), F.col(label).cast("double").alias("y"), apart.alias("held"), hashed.alias("h"))


def _packed_rows(flat: DataFrame, forests: dict, count: int, folds: int, seed: int) -> DataFrame:
    """Blocks of ``flat`` with the folds of ``prepare``.  Only classes with models by fold are shuffled for these, as hashes
    and bins; the others' folds, of no use, are 0."""
    several = [k for k, f in forests.items() if len(f.models) > 1]
    one = {k: f for k, f in forests.items() if k not in several}
    apart = lambda fold: F.when(F.col("held"), -1).otherwise(fold)
    parts = []
    if one:
        parts.append(binned(flat, one).withColumn("fold", apart(F.lit(0))))
    if several:
        hashed = binned(flat.withColumn("__hash", F.xxhash64(F.lit(seed), "h", "x")), {k: forests[k] for k in several}).withColumn("__kind", F.struct("by", "y", "held"))
        parts.append(folds_by(hashed, ["__hash", "h", "bins"], "__kind", folds).withColumn("fold", apart(F.col("fold"))).drop("__hash", "__kind"))
    return blocks_of(reduce(DataFrame.unionByName, parts), forests, count)


def train(
    rows: DataFrame, features: list[str], by: str = "class_id", key: list[str] | None = None, label: str = "label", held: str | None = None, calibrated: tuple = (), rounds: int = 500, fallback: int = 150, patience: int = 40,
    depth: int = 6, step: float = 0.05, l2: float = 2.0, least: float = 1.0, share: float = 0.8, columns: float = 0.8, bins: int = 64, folds: int = 3, block: int = 10, min_positives: int = 20, seed: int = 42,
) -> dict[object, Forest]:
    """A forest for each class with ``min_positives`` positives and a negative among the rows to fit.

    held: a column that marks rows held out, else a tenth by the key's hash.  They choose the number of rounds by average
    precision, judged after each ``block`` of rounds for all of its heads in one plan; a class ends ``patience`` rounds
    after its best one.  A class without a positive held out has ``fallback`` rounds.  Classes of ``calibrated`` get slope
    and intercept over the probabilities that the models without a row's fold give it, at the chosen number of rounds.

    Bins end at quantiles (each within 1 / 10,000 of its rank).  Missing and NaN features go to the side that gains more.
    Labels are 0 or 1; rows without class or label are left out; repeated rows count as often as they come; an empty table
    gives no forests.

    ``rows`` are read up to four times, so that a long plan is to be held before.  What is kept of them are packed blocks;
    of these there are at most two tables at a time, that of the margins before and that of the next."""
    if not 2 <= bins <= MOST_BINS:
        raise ValueError(f"2 to {MOST_BINS} bins")
    spark = rows.sparkSession
    ready = _flat(rows, features, by, key or [*features, label], label, held, seed)
    fit = ~F.col("held")
    ends = [k / bins for k in range(1, bins)]
    figures = ready.groupBy("by").agg(
        F.count("*").alias("every"), F.count_if(fit).alias("n"), F.sum(F.when(fit, F.col("y"))).alias("positives"), F.sum(F.when(F.col("held"), F.col("y"))).alias("held_positives"),
        F.array(*[F.coalesce(F.percentile_approx(F.when(fit, F.get("x", F.lit(k))), ends), F.array().cast("array<double>")) for k in range(len(features))]).alias("edges"),
    )
    forests, limits, count = {}, {}, 0
    for r in figures.orderBy("by").collect():  # one row for each class, in an order that columns are drawn by
        count += r["every"]
        positives = r["positives"] or 0
        if positives < min_positives or positives == r["n"]:
            continue
        models = 1 + (folds if r["by"] in calibrated else 0)
        forests[r["by"]] = Forest([np.unique(np.array(e, float)) for e in r["edges"]], (r["n"] - positives) / positives, [[] for _ in range(models)])
        limits[r["by"]] = rounds if r["held_positives"] else fallback
    if not forests:
        return {}

    folder = scratch(spark, "boosting")
    try:
        _grow(_packed_rows(ready, forests, count, folds, seed), forests, limits, folder, len(features), rounds, patience, depth, step, l2, least, share, columns, block, seed)
    finally:
        remove(spark, folder)
    return forests


def _grow(blocks: DataFrame, forests: dict, limits: dict, folder: str, width: int, rounds: int, patience: int, depth: int, step: float, l2: float, least: float, share: float, columns: float, block: int, seed: int) -> None:
    """Grows ``forests`` over ``blocks``, held in ``folder``."""
    spark, few = blocks.sparkSession, str(TASK // BLOCK)
    ready, at = hold(blocks, f"{folder}/0", maxRecordsPerFile=few), 0
    draw = np.random.default_rng(seed)
    while going := {k: f for k, f in forests.items() if not f.ended}:
        for _ in range(block):
            mine = {k: f for k, f in going.items() if len(f.models[0]) < limits[k]}
            if not mine:
                break
            chosen = {k: np.isin(np.arange(width), draw.permutation(width)[: max(1, round(columns * width))]) for k in mine}
            for f in mine.values():
                for trees in f.models:
                    trees.append(Tree(depth))
            for level in range(depth):
                grew = set()
                for k, sums in level_sums(ready, mine, level, seed, share).items():
                    for trees, s in zip(forests[k].models, sums, strict=True):
                        if trees[-1].split(level, s, chosen[k], l2, least, step):
                            grew.add(k)
                if not grew:
                    break
        aps: dict = {}
        with swept(spark):
            for r in average_precision(_steps(ready, going), ["by", "at"], "score", "y", "n").orderBy("at").collect():  # one row for each class and round
                aps.setdefault(r["by"], []).append(r["ap"] or 0.0)
        for k, f in going.items():
            f.rounds = len(f.models[0])
            if limits[k] == rounds and k in aps:
                f.judge(aps[k], patience)
            f.ended = f.ended or len(f.models[0]) >= limits[k]
        if not all(f.ended for f in forests.values()):
            kept = {k: f for k, f in forests.items() if not f.ended or len(f.models) > 1}
            ready, at = hold(_moved_on(ready, kept), f"{folder}/{at + 1}", maxRecordsPerFile=few), at + 1
            remove(spark, f"{folder}/{at - 1}")
            for f in kept.values():
                f.done = len(f.models[0])
    for k, ab in calibrate(ready, {k: f for k, f in forests.items() if len(f.models) > 1}, folder).items():
        forests[k].calibration = ab


def calibrate(ready: DataFrame, forests: dict, folder: str, rounds: int = 50) -> dict[object, tuple[float, float]]:
    """By class: slope and intercept of a logistic curve over out-of-fold probabilities, to targets drawn in from 0 and 1
    by (n + 1) / (n + 2); Newton steps, each one aggregate over what ``folder`` holds for them."""
    if not forests:
        return {}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for row in b.itertuples():
                some = unpacked(row)
                z = np.zeros(len(some["y"]))
                for fold in np.unique(some["fold"][~some["held"]]):
                    mine = np.flatnonzero(some["fold"] == fold)
                    z[mine] = forests[row.by].margin(some["bins"].T[:, mine].T, int(fold) + 1)
                p = 1 / (1 + np.exp(-np.clip(z, -60, 60)))
                yield pd.DataFrame({"by": row.by, "y": some["y"].astype(float), "p": p})[~some["held"]]

    kind = ready.schema["by"].dataType.simpleString()
    out = hold(ready.filter(F.col("by").isin(list(forests))).mapInPandas(run, f"by {kind}, y double, p double"), f"{folder}/calibrated")
    n = {r["by"]: (r["n1"], r["n0"]) for r in out.groupBy("by").agg(F.sum("y").alias("n1"), F.sum(1 - F.col("y")).alias("n0")).collect()}
    at = {k: np.array([0.0, np.log((n1 + 1) / (n0 + 1))]) for k, (n1, n0) in n.items()}
    best, move, before = dict(at), {k: np.zeros(2) for k in n}, {k: np.inf for k in n}
    open_ = set(n)
    for _ in range(rounds):
        if not open_:
            break
        named = F.create_map(*[v for k in open_ for v in (F.lit(k), F.array(*map(F.lit, [*at[k].tolist(), float((n[k][0] + 1) / (n[k][0] + 2)), float(1 / (n[k][1] + 2))])))])
        w = F.element_at(named, F.col("by"))
        z, target = F.get(w, F.lit(0)) * F.col("p") + F.get(w, F.lit(1)), F.when(F.col("y") > 0, F.get(w, F.lit(2))).otherwise(F.get(w, F.lit(3)))
        some = out.filter(F.col("by").isin(list(open_))).select("by", "p", z.alias("z"), target.alias("t")).withColumn("q", sigmoid(F.col("z")))
        d, v = F.col("q") - F.col("t"), F.col("q") * (1 - F.col("q"))
        loss = F.greatest("z", F.lit(0.0)) - F.col("t") * F.col("z") + F.log1p(F.exp(-F.abs("z")))
        sums = some.groupBy("by").agg(F.sum(loss).alias("loss"), F.sum(d * F.col("p")).alias("ga"), F.sum(d).alias("gb"), F.sum(v * F.col("p") ** 2).alias("aa"), F.sum(v * F.col("p")).alias("ab"), F.sum(v).alias("bb"))
        for r in sums.collect():  # one row for each class
            k = r["by"]
            if r["loss"] > before[k] + 1e-9 * abs(before[k]):  # too far: half the way
                move[k] = move[k] / 2
            else:
                best[k], before[k] = at[k], r["loss"]
                move[k] = -np.linalg.solve(np.array([[r["aa"], r["ab"]], [r["ab"], r["bb"]]]) + 1e-9 * np.eye(2), np.array([r["ga"], r["gb"]]))
            at[k] = best[k] + move[k]
            if np.abs(move[k]).max() < 1e-8:
                open_.discard(k)
    return {k: (float(a), float(b)) for k, (a, b) in best.items()}


def predict(rows: DataFrame, forests: dict[object, Forest], features: list[str], class_col: str = "class_id", name: str = "p", raw: str | None = None) -> DataFrame:
    """``rows`` with the calibrated probability of their class's forest, null without one; ``raw``: a column for that before
    calibration.  The columns ``name`` and ``raw`` must be new."""
    if taken := {name, raw} & set(rows.columns):
        raise ValueError(f"columns {sorted(taken)} are there already")

    def score(by: pd.Series, x: pd.DataFrame) -> pd.Series:
        p = pd.Series(np.nan, index=by.index)
        for k, at in by.groupby(by).groups.items():
            if k in forests:
                bins = forests[k].binned(x.loc[at].to_numpy(float))
                p[at] = 1 / (1 + np.exp(-np.clip(forests[k].margin(bins), -60, 60)))
        return p

    value = [F.col(f).cast("double") for f in features]
    p = F.pandas_udf(score, "double")(F.col(class_col), F.struct(*[F.when(~F.isnan(v), v).alias(f"x{k}") for k, v in enumerate(value)]))
    out = rows.withColumn("__raw", p).withColumn("__raw", F.when(~F.isnan("__raw"), F.col("__raw")))
    better = F.col("__raw")
    for k, f in forests.items():
        if f.calibration:
            better = F.when(F.col(class_col) == k, sigmoid(f.calibration[0] * F.col("__raw") + f.calibration[1])).otherwise(better)
    out = out.withColumn(name, better)
    return out.withColumnRenamed("__raw", raw) if raw else out.drop("__raw")
