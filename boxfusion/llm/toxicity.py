"""Toxicity by a subsequence string kernel, Nyström landmarks and a support vector machine.

The kernel compares character strings by the subsequences of three characters that they share, each
weighted by ``DECAY`` to the number of characters skipped, up to two at a time: insults with gaps or
inserted characters stay near the plain ones.  Landmarks span the feature space; in it a linear
machine is trained on the sentences of labelled texts, as bags of strings: a toxic text has a
sentence with an insulting string, which one is for the machine to find; a sentence of another text
has none.  It starts from strings that tell toxic texts from others, takes in the string of the greatest
margin in each toxic text, and all strings of other texts that it takes for insults, until neither
changes; insults with a character inserted or parted by marks stand beside the plain ones as virtual examples.
As kernel and machine are linear in the subsequences, the machine comes down to one weight for each of
them, so scoring a string costs the same whatever the number of landmarks.

A text's score is a logistic of the three greatest margins in it, learned from the labelled texts and,
so that one insult is enough, from the sentence of each that has the greatest margin."""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, cut

DECAY, REACH = 0.5, 3
SYMBOLS = 48
START = "\ue000"
LOOKALIKE = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a"}
PIECE, STEP = 24, 12
#: Weight of all strings that an insult may be disguised as, of its own.
VIRTUAL = 1.0
#: Margins of a text that its score takes, and words at which a sentence without an end is cut.
TOP, SENTENCE = 3, 40
SENTENCE_END = re.compile(r"(?<=[.!?\n])\s+")
SPLIT = re.compile(r"[^\w]+|_+")


class _Codes(dict):
    """Codes of characters: 1 for a word's start, 2 to 27 for a to z, to 47 for other letters, 0 else."""

    def __missing__(self, point: int) -> str:
        c = LOOKALIKE.get(chr(point), chr(point))
        code = 1 if c == START else ord(c) - 95 if "a" <= c <= "z" else 28 + (ord(c) * 2654435761 >> 13) % 20 if unicodedata.category(c)[0] == "L" else 0
        self[point] = out = chr(code)
        return out


CODES = _Codes()


def triples(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word, subsequence and weight of all subsequences of ``words``."""
    flat, begin = _flat(words)
    of = np.repeat(np.arange(len(words)), np.diff(np.r_[begin, len(flat)]))
    out = []
    for d1 in range(1, REACH + 1):
        for d2 in range(1, REACH + 1):
            n = max(0, len(flat) - d1 - d2)
            a, b, c = flat[:n], flat[d1 : d1 + n], flat[d1 + d2 : d1 + d2 + n]
            i = np.flatnonzero((a > 0) & (b > 0) & (c > 0))
            out.append((of[i], (a[i] * SYMBOLS + b[i]) * SYMBOLS + c[i], np.full(len(i), DECAY ** (d1 + d2 - 2))))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _flat(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all words, parted so that no subsequence joins two, and where each begins."""
    gap = "\x00" * REACH
    text = "".join([w + gap for w in words])
    flat = np.frombuffer(text.translate(CODES).encode("latin-1"), np.uint8).astype(np.int64)
    return flat, np.cumsum([0, *(len(w) + REACH for w in words)])[:-1]


def phi(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The kernel's features, (word, subsequence, value), each once, scaled so that K(x, x) = 1."""
    w, s, v = triples(words)
    key, place = np.unique(w * SYMBOLS**3 + s, return_inverse=True)
    value = np.bincount(place, v, len(key))
    word = key // SYMBOLS**3
    norm = np.sqrt(np.bincount(word, value * value, len(words)))
    return word, key % SYMBOLS**3, value / np.maximum(norm[word], 1e-12)


def kernel(x: list[str], z: list[str]) -> np.ndarray:
    w, s, v = phi(z)
    dense = np.zeros((SYMBOLS**3, len(z)), np.float32)
    dense[s, w] = v
    out = np.zeros((len(x), len(z)), np.float32)
    for at in range(0, len(x), 1000):  # what is held does not grow with x
        w, s, v = phi(x[at : at + 1000])
        if len(w):
            begin = np.flatnonzero(np.r_[True, w[1:] != w[:-1]])
            out[at + w[begin]] = np.add.reduceat(dense[s] * v[:, None].astype(np.float32), begin)
    return out.astype(float)


@dataclass(frozen=True)
class Model:
    """``subsequence``: the machine's weights; ``bias``; ``text``: the logistic's, the last its constant."""

    subsequence: np.ndarray
    bias: float
    text: tuple[float, ...] = (0.0,) * (TOP + 1)

    def margins(self, words: list[str]) -> np.ndarray:
        """Exact for words that come near to being positive, else an upper bound."""
        if not words:
            return np.empty(0)
        flat, begin = _flat(words)
        total, square = np.zeros(len(flat)), np.zeros(len(flat))
        for d1 in range(1, REACH + 1):
            for d2 in range(1, REACH + 1):
                n = max(0, len(flat) - d1 - d2)
                a, b, c = flat[:n], flat[d1 : d1 + n], flat[d1 + d2 : d1 + d2 + n]
                weight = DECAY ** (d1 + d2 - 2) * ((a > 0) & (b > 0) & (c > 0))
                total[:n] += weight * self.subsequence[(a * SYMBOLS + b) * SYMBOLS + c]
                square[:n] += weight * weight
        m = np.add.reduceat(total, begin) / np.sqrt(np.maximum(np.add.reduceat(square, begin), 1e-12)) + self.bias
        near = np.flatnonzero(m > -0.5)
        if len(near):  # subsequences that occur twice in a word make its norm larger
            w, s, v = phi([words[k] for k in near])
            m[near] = np.bincount(w, v * self.subsequence[s], len(near)) + self.bias
        return m


def tokens(text: str | None) -> list[str]:
    """Lower-case words; runs of three or more single characters also as one word."""
    words = (text or "").lower().split()
    run: list[str] = []
    more = []
    for w in [*words, ""]:
        if len(w) == 1:
            run.append(w)
        elif run:
            if len(run) >= 3:
                more.append("".join(run))
            run = []
    return words + more


def pieces(word: str) -> list[str]:
    """What is compared of a word: the whole, its parts between other characters, and overlapping
    windows of what is long."""
    parts = [p for p in SPLIT.split(word) if p]
    out = [word] if len(parts) != 1 else parts
    out = [*out, *(p for p in parts if len(p) >= 3)] if len(parts) > 1 else out
    return [START + p if not at else p for x in out for at in range(0, max(1, len(x) - STEP), STEP) for p in [x[at : at + PIECE]]]


class Scorer:
    """Margins of words, remembered."""

    def __init__(self, model: Model, most: int = 300_000) -> None:
        self.model, self.most, self.of = model, most, {}

    def learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.of]
        if not new:
            return
        if len(self.of) + len(new) > self.most:
            self.of, new = {}, list(words)
        for at in range(0, len(new), 20_000):
            some = new[at : at + 20_000]
            parts = [pieces(w) for w in some]
            begin = np.cumsum([0, *map(len, parts)])[:-1]
            m = np.maximum.reduceat(self.model.margins([p for ps in parts for p in ps]), begin)
            self.of.update(zip(some, m.tolist(), strict=True))

    def features(self, texts: list[str | None]) -> np.ndarray:
        """Per text: its ``TOP`` greatest margins, of different words, from -1 to 1."""
        lists = [set(tokens(t)) for t in texts]
        out = np.full((len(texts), TOP), -1.0)
        for k, words in enumerate(lists):
            self.learn(words)
            m = np.fromiter(map(self.of.__getitem__, words), float, len(words))
            top = np.sort(m[np.argpartition(m, -TOP)[-TOP:]] if len(m) > TOP else m)[::-1]
            out[k, : len(top)] = np.clip(top, -1, 1)
        return out

    def best_sentence(self, text: str | None) -> np.ndarray:
        """The features of that sentence of ``text`` whose are greatest: it holds the word of the greatest margin."""
        each = [set(tokens(x)) for x in sentences(text)]
        self.learn(set().union(*each))
        most = max((self.of[w] for ws in each for w in ws), default=None)
        tops = [sorted((self.of[w] for w in ws), reverse=True)[:TOP] for ws in each if any(self.of[w] == most for w in ws)]
        out = np.full(TOP, -1.0)
        if tops:
            top = max(tops)
            out[: len(top)] = np.clip(top, -1, 1)
        return out


def sentences(text: str | None) -> list[str]:
    """Up to an end mark or line feed, at most ``SENTENCE`` words each."""
    words = [x.split() for x in SENTENCE_END.split(text or "")]
    return [" ".join(w[k : k + SENTENCE]) for w in words for k in range(0, len(w), SENTENCE)]


def squared_hinge(x: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float = 4.0, rounds: int = 30) -> np.ndarray:
    """The linear machine of least |w|^2 / 2 + c * sum of weighted squared hinge losses, by Newton steps;
    the last column of ``x`` is the bias."""
    w = np.zeros(x.shape[1])
    ridge = np.eye(x.shape[1])
    ridge[-1, -1] = 1e-3
    for _ in range(rounds):
        on = 1 - y * (x @ w) > 0
        xs, ws = x[on], (c * weight)[on]
        new = np.linalg.solve(ridge + 2 * (xs * ws[:, None]).T @ xs, 2 * (xs * ws[:, None]).T @ y[on])
        if np.abs(new - w).max() < 1e-9:
            break
        w = new
    return w


def cover(places: list[tuple[str, int]], times: int = 5) -> list[str]:
    """Of the words of ``places`` (word, text), those that mark texts: the word that most texts lack
    comes next, until each text has ``times`` of them or no word is new to two texts.  What merely
    recurs among copies of a text that insults mark already is left out."""
    of: dict[str, set[int]] = {}
    for w, i in places:
        of.setdefault(w, set()).add(i)
    had: dict[int, int] = {}
    out = []
    while of:
        gain = {w: sum(had.get(i, 0) < times for i in ids) for w, ids in of.items()}
        best = max(gain, key=lambda w: (gain[w], w))
        if gain[best] < 2:
            break
        out.append(best)
        for i in of.pop(best):
            had[i] = had.get(i, 0) + 1
        of = {w: ids for w, ids in of.items() if gain[w] >= 2}
    return out


def disguised(word: str) -> list[str]:
    """``word`` with a letter put in at each inner place, with one letter of it twice, and parted by marks."""
    if len(word) < 4 or not word.isalpha():
        return []
    pick = np.random.default_rng(list(word.encode()))
    letters = "".join(chr(97 + k) for k in pick.integers(0, 26, len(word)))
    twice = int(pick.integers(1, len(word)))
    put_in = [f"{word[:k]}{letters[k]}{word[k:]}" for k in range(1, len(word))]
    return [*put_in, word[:twice] + word[twice - 1 :], *(f"{word[:k]}{m}{word[k:]}" for k, m in ((1, "*"), (len(word) // 2, "-"))), ".".join(word)]


def train_words(positive: dict[str, int], negative: dict[str, int], landmarks: int = 320, seed: int = 11) -> Model:
    """The machine from strings and in how many texts they are: ``positive`` ones, each with those it may be
    ``disguised`` as, and ``negative`` ones; a string may be both."""
    pick = np.random.default_rng(seed)
    some = lambda xs, n: [xs[k] for k in sorted(pick.choice(len(xs), min(n, len(xs)), replace=False))]
    virtual: dict[str, float] = {}
    for w, n in positive.items():
        if w not in negative:
            found = disguised(w.removeprefix(START))
            virtual |= {START + v: n * VIRTUAL / len(found) for v in found if START + v not in negative}
    z = list(dict.fromkeys(some(list(positive), landmarks // 4) + some(list(virtual), landmarks // 2) + some(list(negative), landmarks // 4)))
    values, vectors = np.linalg.eigh(kernel(z, z))
    keep = values > 1e-3
    root = vectors[:, keep] / np.sqrt(values[keep])
    x = kernel([*positive, *virtual, *negative], z) @ root
    y = np.r_[np.ones(len(positive) + len(virtual)), -np.ones(len(negative))]
    weight = np.array([*positive.values(), *virtual.values(), *negative.values()], float)
    w = squared_hinge(np.c_[x, np.ones(len(x))], y, weight)
    wz, sz, vz = phi(z)
    beta = root @ w[:-1]
    return Model(np.bincount(sz, vz * beta[wz], SYMBOLS**3), float(w[-1]))


def logistic(x: np.ndarray, y: np.ndarray, decay: float = 1.0) -> np.ndarray:
    x = np.c_[x, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + decay * np.eye(len(w)), x.T @ (y - p) - decay * w)
    return w


def fit(docs: DataFrame, labels: DataFrame, training, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most: int = 2500, rounds: int = 4, least: int = 3) -> Model | float:
    """The model from labelled rows for which ``training`` (a Column of the id) holds: at most
    ``most`` of either label, by the least hash of the id, whole texts.

    The machine starts from the strings that ``cover`` toxic texts, among those behind ``least`` different words
    in as many of them (not behind one in copies of a text), and ten times as often there as in others, against a
    sample of the other texts' strings.  In each of
    at most ``rounds`` rounds, all strings of other texts that it takes for insults join these, and
    the string of the greatest margin in each toxic text, if positive and not as frequent elsewhere, joins the insults.

    Without rows of both labels, or insulting strings, the share of label 1 (0.5 if none)."""
    known = labels.filter(training & F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).distinct()
    order = F.xxhash64("id"), F.col("id")
    chosen = known.filter("y = 1").orderBy(*order).limit(most).unionByName(known.filter("y = 0").orderBy(*order).limit(most))
    # at most 2 * most ids of two numbers each: small whatever the input
    rows = cut(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), "id").repartition(F.xxhash64("id", "text")))
    n = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    share = n.get(1, 0) / max(1, sum(n.values())) if n else 0.5
    if len(n) < 2:
        return share
    arrow_rows(docs.sparkSession)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, y, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                said = tokens(t)
                first = dict(reversed(list(zip(said, ["", *said], strict=False))))  # each with what stands before it
                words = {p: crc32(before.encode("utf-8", "surrogatepass")) for w, before in first.items() for p in pieces(w)}
                yield pa.RecordBatch.from_arrays([pa.array([i] * len(words), pa.int64()), pa.array([y] * len(words), pa.int32()), pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64())], ["id", "y", "word", "before"])

    numbers = rows.select(F.xxhash64("id").alias("id"), "y", "text")
    words = numbers.mapInArrow(split, "id long, y int, word string, before long").filter(F.length("word") >= 2)
    seen = words.groupBy("word").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    ratio = ((F.col("pos") + 0.5) / n[1]) / ((F.col("neg") + 0.5) / n[0])
    seen = cut(seen.withColumn("ratio", ratio))
    toxic = cut(words.filter("y = 1").select("id", "word", "before").join(seen.filter("ratio >= 2").select("word", "pos", "neg", "ratio"), "word"))
    where = toxic.filter(F.col("pos") >= least).filter("ratio >= 10").select("word", "id", "before", "pos", "neg").collect()  # strings of at most ``most`` texts
    places: dict[str, set[int]] = {}
    for r in where:
        places.setdefault(r["word"], set()).add(r["before"])
    counts = {r["word"]: (r["pos"], r["neg"]) for r in where}
    positive = {w: counts[w][0] for w in cover(sorted((r["word"], r["id"]) for r in where if len(places[r["word"]]) >= least))}
    if not positive:
        return share
    other = seen.filter("neg > 0").select("word", "neg")
    negative = {r["word"]: r["neg"] for r in other.orderBy(F.xxhash64("word"), "word").limit(6000).collect()}  # the others are sought for what it takes for insults
    negative |= {w: counts[w][1] for w in positive if counts[w][1]}
    for k in range(rounds):
        model = train_words(positive, negative)
        if k == rounds - 1:
            break
        taken = {r["word"]: r["neg"] for r in _margins(other.select("neg", "word"), model).filter("m > -0.5").orderBy("word").collect() if r["word"] not in negative}
        best = _margins(toxic.select("id", "pos", "word"), model).groupBy("id").agg(F.max(F.struct("m", "word", "pos")).alias("b")).filter("b.m > 0").select("b.word", "b.pos").distinct()
        new = {r["word"]: r["pos"] for r in best.orderBy("word").collect() if r["word"] not in positive}
        if not taken and not new:
            break
        negative |= taken
        positive |= new
    found = _bags(numbers.select("y", "text"), model).collect()
    w = logistic(np.array([r["f"] for r in found]), np.array([r["y"] for r in found], float))
    return Model(model.subsequence, model.bias, tuple(w.tolist()))


def _bags(rows: DataFrame, model: Model) -> DataFrame:
    """(y, f) for each text of ``rows`` (y, text), and for its sentence of the greatest margin."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for b in batches:
            texts = b.column(1).to_pylist()
            f = np.r_[scorer.features(texts), np.array([scorer.best_sentence(t) for t in texts]).reshape(-1, TOP)]
            y = pa.concat_arrays([b.column(0)] * 2)
            yield pa.RecordBatch.from_arrays([y, pa.array(f.tolist(), pa.list_(pa.float64()))], ["y", "f"])

    return rows.mapInArrow(run, "y int, f array<double>")


def _margins(rows: DataFrame, model: Model) -> DataFrame:
    """``rows``, the last of whose columns is a string, with its margin ``m``."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = shared.value.margins(b.column(b.num_columns - 1).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(m, pa.float64())], [*b.schema.names, "m"])

    return rows.mapInArrow(run, ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema), "m double"]))


def features(rows: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """``keep`` (numbers) and f, the features of ``text``."""
    arrow_rows(rows.sparkSession)
    shared = rows.sparkSession.sparkContext.broadcast(model)
    fields = [f for f in rows.schema if f.name in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for b in batches:
            f = scorer.features(b.column(len(keep)).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(f.tolist(), pa.list_(pa.float64()))], [*keep, "f"])

    return rows.select(*keep, "text").mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "f array<double>"]))


def score(docs: DataFrame, model: Model | float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: its id and score, 0 to 1.

    Null and empty texts score as texts without a word; rows are independent; an empty table gives
    no rows.  Scores follow from the text alone."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    if not isinstance(model, Model):
        return rows.select(F.col("id").alias(id_col), F.lit(float(model)).alias("score"))
    z = sum((F.get("f", F.lit(k)) * w for k, w in enumerate(model.text[:-1])), F.lit(model.text[-1]))
    return features(rows, model, ["id"]).select(F.col("id").alias(id_col), (1 / (1 + F.exp(-z))).alias("score"))
