"""Quality classifier by weak labels.

Heuristic labelers vote on each text for good or bad quality, or abstain.  They overlap, and none is
right always; expectation-maximisation over the counts of vote patterns estimates how each
votes on good and on bad texts and the posterior of each pattern.  Posteriors are the labels from which a linear scorer over
hashed features of the words is trained; it alone scores the texts."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows

LABELERS = ("length", "symbols", "bars", "capitals", "repeats", "runs", "variety", "endings", "word_length", "function_words")
#: Frequent short words of English, French, German and Spanish prose.
FUNCTION_WORDS = frozenset("the of and to in is that it for was a be with as by this are on at from le la les de des et un une en que qui est dans pour par au du sur pas avec der die das und ist von den mit dem im zu nicht ein eine als auch el los las y es por con se una para no del su al lo".split())
SYMBOLS = frozenset("#*$%&|<>")
ENDINGS = re.compile(r"[.!?:;…]+[\"'”’»)]*$")
BUCKETS = 1 << 16


def votes(text: str | None) -> tuple[int, ...]:
    """Of each labeler: 1 good, -1 bad, 0 no opinion."""
    words = (text or "").split()
    n = len(words)
    if not n:
        return (-1, *(0,) * (len(LABELERS) - 1))
    symbols = sum(1 for w in words if not SYMBOLS.isdisjoint(w))
    bars = words.count("|")
    upper = sum(1 for w in words if len(w) > 1 and w.isupper())
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    repeated = sum(c for c in windows.values() if c > 1)
    same = sum(map(str.__eq__, words, words[1:]))
    distinct = len(set(words))
    lines = [x for x in map(str.strip, text.split("\n")) if x]
    ended = sum(1 for x in lines if ENDINGS.search(x))
    mean = sum(map(len, words)) / n
    common = sum(1 for w in words if w.lower() in FUNCTION_WORDS)

    def vote(good: bool, bad: bool) -> int:
        return 1 if good else -1 if bad else 0

    return (
        vote(n >= 40, n < 3),
        vote(symbols <= 0.15 * n, True),
        vote(bars <= 0.1 * n, True),
        vote(upper <= 0.3 * n, True),
        vote(repeated <= 0.3 * n, True) if n >= 10 else 0,
        vote(same <= 0.2 * n, True) if n >= 10 else 0,
        vote(distinct >= 0.3 * n, distinct < 0.15 * min(n, 2000)) if n >= 30 else 0,
        vote(ended >= 0.8 * len(lines), ended < 0.4 * len(lines)),
        vote(3 <= mean <= 9, mean < 2 or mean > 12),
        vote(common >= 0.12 * n, common < 0.04 * n) if n >= 20 else 0,
    )


#: Labelers that look for one fault: most bad texts, which have others, pass them.
ONE_SIDED = ("symbols", "bars", "capitals", "repeats", "runs")
#: Where expectation-maximisation starts: chances of the votes -1 and 1, if cast, on bad and on good texts.
START = {True: ((0.25, 0.75), (0.02, 0.98)), False: ((0.45, 0.55), (0.06, 0.94))}


def accuracies(counts: dict[tuple[int, ...], int], rounds: int = 100, prior: float = 20.0) -> tuple[np.ndarray, float, dict[tuple[int, ...], float]]:
    """By expectation-maximisation: the chances of each labeler's votes -1 and 1, if it votes, on bad (0)
    and on good (1) texts, the share of good texts, and the posterior of each pattern.  The start counts as
    ``prior`` texts of either kind, so that the two kinds keep their meaning."""
    patterns = np.array(sorted(counts), int).reshape(-1, len(LABELERS))
    n = np.array([counts[tuple(p)] for p in patterns.tolist()], float)
    start = np.array([START[x in ONE_SIDED] for x in LABELERS]).transpose(1, 0, 2)
    chance, share = start + 1e-4, 0.8
    cast = np.stack([patterns == v for v in (-1, 1)], axis=2)
    post = np.full(len(n), 0.5)
    for _ in range(rounds):
        bad, good = ((cast * np.log(chance[k])).sum(axis=(1, 2)) for k in (0, 1))
        post = 1 / (1 + np.exp(np.clip(bad - good + math.log((1 - share) / share), -500, 500)))
        for k, weight in ((0, n * (1 - post)), (1, n * post)):
            seen = (weight[:, None, None] * cast).sum(axis=0) + prior * start[k] + 1e-2
            chance[k] = seen / seen.sum(axis=1, keepdims=True)
        share = float(np.clip((n * post).sum() / n.sum(), 0.05, 0.95))
    return chance, share, dict(zip(map(tuple, patterns.tolist()), post.tolist(), strict=True))


class Hasher:
    """Hashed features of texts: shapes of words and of pairs of neighbours, and words of up to four
    letters, as shares of a text's words; and two of its own, how many words equal the one before and
    how few are distinct."""

    def __init__(self, most: int = 300_000) -> None:
        self.most, self.of = most, {}

    @staticmethod
    def shape(w: str) -> str:
        head = "X" if w[0].isupper() else "x" if w[0].isalpha() else "9" if w[0].isdigit() else w[0]
        body = "X" if len(w) > 1 and w.isupper() else "9" if any(c.isdigit() for c in w) else "x"
        return f"{head}{body}{min(len(w) // 4, 4)}{w[-1] if not w[-1].isalnum() else ''}{'!' if not SYMBOLS.isdisjoint(w) else ''}"

    def features(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        from xxhash import xxh32_intdigest

        words = (text or "").split()
        if len(self.of) > self.most:
            self.of = {}
        ids = []
        for w in words:
            k = self.of.get(w)
            if k is None:
                s = self.shape(w)
                self.of[w] = k = (xxh32_intdigest(s.encode("utf-8", "surrogatepass")), xxh32_intdigest(b"w" + w.lower().encode("utf-8", "surrogatepass")) % BUCKETS if len(w) <= 4 else -1)
            ids.append(k)
        a = np.array(ids, np.int64).reshape(-1, 2)
        size = np.int64(min(14, int(math.log2(len(words) + 1))))
        pairs = (a[:-1, 0] * 31 + a[1:, 0]) % BUCKETS
        all_ids = np.r_[a[:, 0] % BUCKETS, pairs, a[a[:, 1] >= 0, 1]]
        index, count = np.unique(all_ids, return_counts=True)
        n = max(1, len(words))
        same, distinct = sum(map(str.__eq__, words, words[1:])) / n, len(set(words)) / min(n, 2000)
        return np.r_[index, (size * 7919 + 17) % BUCKETS, BUCKETS, BUCKETS + 1], np.r_[np.sqrt(count / n), 1.0, math.sqrt(same), 1 - min(1.0, distinct)]


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float
    chance: np.ndarray
    share: float


def train(rows: list[tuple[np.ndarray, np.ndarray, float]], rounds: int = 12, rate: float = 0.5, decay: float = 1e-5, seed: int = 3) -> tuple[np.ndarray, float]:
    """Logistic weights by stochastic steps with per-weight rates; labels are probabilities."""
    w, g, bias, gb = np.zeros(BUCKETS + 2), np.full(BUCKETS + 2, 1e-2), 0.0, 1e-2
    pick = np.random.default_rng(seed)
    for _ in range(rounds):
        for k in pick.permutation(len(rows)):
            i, v, y = rows[k]
            e = 1 / (1 + math.exp(-max(-30.0, min(30.0, float(w[i] @ v) + bias)))) - y
            d = e * v + decay * w[i]
            g[i] += d * d
            gb += e * e
            w[i] -= rate * d / np.sqrt(g[i])
            bias -= rate * e / math.sqrt(gb)
    return w, bias


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = 4000) -> Model | None:
    """Accuracies from the votes on all rows; the scorer from at most ``most`` of them, those of the
    least hash of the id, whole texts.  None for an empty table."""
    arrow_rows(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[tuple[int, ...]] = Counter()
        for b in batches:
            seen.update(map(votes, b.column(0).to_pylist()))
        yield pa.RecordBatch.from_arrays([pa.array(map(list, seen), pa.list_(pa.int32())), pa.array(seen.values(), pa.int64())], ["votes", "n"])

    # 3 ** 10 patterns at most
    counts = {tuple(r["votes"]): r["n"] for r in docs.select(F.col(text_col).cast("string").alias("t")).mapInArrow(count, "votes array<int>, n long").groupBy("votes").agg(F.sum("n").alias("n")).collect()}
    if not counts:
        return None
    chance, share, posterior = accuracies(counts)

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for b in batches:
            out = [(*map(list, hasher.features(t)), posterior[votes(t)]) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.list_(pa.int32())), pa.array([x[1] for x in out], pa.list_(pa.float32())), pa.array([x[2] for x in out], pa.float64())], ["i", "v", "y"])

    ids = docs.select(F.col(id_col).alias("id")).filter(F.col("id").isNotNull()).distinct().orderBy(F.xxhash64("id"), "id").limit(most)
    sample = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t")).join(F.broadcast(ids), "id").select("t")  # ``most`` ids
    # at most BUCKETS features a row, a few hundred as a rule
    rows = [(np.array(r["i"], np.int64), np.array(r["v"]), r["y"]) for r in sample.mapInArrow(featurise, "i array<int>, v array<float>, y double").toLocalIterator()]
    weights, bias = train(rows)
    return Model(weights.astype(np.float32), bias, chance, share)


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: its id and score, 0 to 1, higher for better texts.

    Null, empty and blank texts score 0; rows are independent; an empty table gives no rows."""
    arrow_rows(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, hasher = shared.value, Hasher()
        for b in batches:
            out = []
            for t in b.column(1).to_pylist():
                if m is None or not t or t.isspace():
                    out.append(0.0)
                    continue
                i, v = hasher.features(t)
                out.append(1 / (1 + math.exp(-max(-30.0, min(30.0, float(m.weights[i] @ v) + m.bias)))))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.float64())], ["id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, "id long, score double").withColumnRenamed("id", id_col)
