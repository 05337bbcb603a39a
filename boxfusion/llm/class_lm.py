"""Brown class-based n-gram language model.

Exchange clustering assigns the most frequent words, the seeds, to classes so that the mutual information
of neighbouring classes is greatest.  Every other word then joins the class to which its own neighbours, counted over all
training texts, add most: by itself if it occurs ``least`` times, else with all rare words of its
shape and ending.  A text's probability is the product of class transitions, smoothed toward class
frequencies, and of word emissions, smoothed by an added fraction of a count.

Counts cover all training texts.  Of the counts, those of at most ``head`` words go to every task, and only
these have a class of their own; the words of a text that are not among them are joined with the table of all counts, so the
vocabulary may grow without bound."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, cut

SHAPES = 6
#: Hashes of endings: rare words of one shape and ending have one class.
ENDINGS = 256
KINDS = SHAPES * ENDINGS
#: Words that a task counts before it passes the counts on.
HELD = 300_000
#: Longer words don't go to every task.
HEAD_BYTES = 64


def tokens(text: bytes | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; the end comes on top."""
    return (text or b"").lower().split()


def shape(w: bytes) -> int:
    """The shape of a word."""
    if w[-1] == 46:
        return 1
    if w[-1] == 44:
        return 2
    if w.isalpha():
        return 4
    if any(48 <= c < 58 for c in w):
        return 0
    return 5 if w.isascii() else 3


def kind(w: bytes) -> int:
    """Shape and ending of a word."""
    return shape(w) * ENDINGS + crc32(w.rstrip(b".,")[-3:]) % ENDINGS


def word_counts(docs: DataFrame, text_col: str) -> DataFrame:
    """(word, kind, c) over all rows of ``docs``; words are UTF-8."""
    arrow_rows(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            words = list(held)
            batch = pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(map(kind, words), pa.int32()), pa.array(held.values(), pa.int64())], ["word", "kind", "c"])
            held.clear()
            return batch

        for b in batches:
            for t in b.column(0).cast(pa.binary()):
                held.update(tokens(t.as_py()))
                if len(held) > HELD:
                    yield out()
        yield out()

    parts = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t")).mapInArrow(run, "word binary, kind int, c long")
    return parts.groupBy("word", "kind").agg(F.sum("c").alias("c"))


def exchange(pairs: np.ndarray, movable: int, classes: int, sweeps: int = 8) -> np.ndarray:
    """Classes of the items whose neighbour counts are ``pairs``: the first ``movable`` are dealt at
    random to ``classes`` classes and each moves to the class that most raises the sum of n log n over class
    pairs less that over classes, until none moves; the others keep classes of their own."""
    n, k = len(pairs), classes + len(pairs) - movable
    of = np.r_[np.random.default_rng(classes).integers(0, classes, movable), classes + np.arange(n - movable)]
    one = np.zeros((n, k))
    one[np.arange(n), of] = 1
    right, left = pairs @ one, pairs.T @ one  # of each item, by the class that follows, that precedes
    table = one.T @ right

    def h(x: np.ndarray) -> np.ndarray:
        return x * np.log(np.maximum(x, 1e-12))

    for _ in range(sweeps):
        moved = 0
        for w in range(movable):
            a, r, c, self_pair = of[w], right[w].copy(), left[w].copy(), pairs[w, w]
            # without w: its own row and column leave class a
            base = table.copy()
            base[a] -= r
            base[:, a] -= c
            base[a, a] += self_pair
            r[a] -= self_pair  # neighbours other than w itself
            c[a] -= self_pair
            row, col = h(base + r) - h(base), h(base + c[:, None]) - h(base)
            b = np.arange(classes)
            gain = row[b].sum(axis=1) + col[:, b].sum(axis=0) - row[b, b] - col[b, b]
            gain += h(base[b, b] + r[b] + c[b] + self_pair) - h(base[b, b])
            # w follows and precedes words of every class, whichever class it joins
            out, into = (base.sum(axis=1) + c)[b], (base.sum(axis=0) + r)[b]
            gain -= h(out + r.sum() + self_pair) - h(out) + h(into + c.sum() + self_pair) - h(into)
            best = int(np.argmax(gain))
            if best != a and gain[best] > gain[a] + 1e-9:
                moved += 1
                table = base
                table[best] += r
                table[:, best] += c
                table[best, best] += self_pair
                right[:, a] -= pairs[:, w]
                right[:, best] += pairs[:, w]
                left[:, a] -= pairs[w]
                left[:, best] += pairs[w]
                of[w] = best
        if not moved:
            break
    return of


@dataclass(frozen=True)
class Head:
    """What goes to every task: the head's words by falling count, their counts, classes and log10
    emissions; the class of each kind; log10 transitions (the last class is the end and, as
    predecessor, the beginning)."""

    words: list[bytes]
    counts: np.ndarray
    classes: np.ndarray
    emission: np.ndarray
    of_kind: np.ndarray
    transition: np.ndarray
    base: float
    end_count: int

    def lookup(self) -> dict[bytes, int]:
        return {w: k for k, w in enumerate(self.words)}


@dataclass(frozen=True)
class Model:
    """``norm``: of each class, what its smoothed counts are divided by."""

    counts: DataFrame
    train_tokens: int
    distinct: int
    head: Head
    norm: list[float]
    added: float


def fit(docs: DataFrame, training: Column, text_col: str = "text", head: int = 300_000, seeds: int = 512, clusters: int = 64, least: int = 8, added: float = 0.5, prior: float = 5.0) -> Model:
    """The model from the rows of ``docs`` for which ``training`` holds (null does not).

    Null and empty texts have the end only; repeated rows count as often as they stand; an empty table
    gives a model that knows no word.  Other columns have no bearing."""
    rows = docs.filter(F.coalesce(training, F.lit(False))).select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    n_docs = rows.count()
    counts = cut(word_counts(rows, "text"))
    by_kind = {r["kind"]: (r["n"], r["v"]) for r in counts.groupBy("kind").agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()}  # KINDS at most
    total, distinct = sum(n for n, _ in by_kind.values()) + n_docs, sum(v for _, v in by_kind.values()) + (n_docs > 0)

    # the head: words of the highest count levels, as many levels as make at most ``head`` words
    level = F.floor(F.log2("c") * 16)
    short = counts.filter(F.length("word") <= HEAD_BYTES)
    lowest, left = None, head
    for r in sorted(short.groupBy(level.alias("level")).count().collect(), key=lambda r: -r["level"]):
        left -= r["count"]
        if left < 0:
            break
        lowest = r["level"]
    top = sorted(((r["c"], bytes(r["word"]), r["kind"]) for r in short.filter(level >= lowest).collect()), key=lambda x: (-x[0], x[1])) if lowest is not None else []
    words, c = [w for _, w, _ in top], np.array([n for n, _, _ in top], np.float64)
    kinds = np.array([k for _, _, k in top], np.int64)

    # items: words of their own, then kinds
    m, own = min(seeds, len(words)), max(min(seeds, len(words)), int((c >= least).sum()))
    ids = cut(_items(rows, words[:own]))
    items = own + KINDS
    seed = np.r_[np.arange(m), m + kinds[m:own] // ENDINGS, m + np.arange(KINDS) // ENDINGS]
    pairs = _pairs(ids, seed, m + SHAPES)
    of = np.r_[exchange(pairs[:-1, :-1], m, clusters), clusters + SHAPES]
    k = clusters + SHAPES
    one = np.zeros((len(of), k + 1))
    one[np.arange(len(of)), of] = 1
    classes = np.r_[of[seed], k]  # of each item, and of the end
    classes[m:-1] = _joined(ids, classes, one.T @ pairs @ one, m, items)
    table = _pairs(ids, classes[:-1], k).astype(float)
    class_count = table.sum(axis=0)
    share = (class_count + 1) / (class_count.sum() + k + 1)
    transition = np.log10((table + prior * share) / (table.sum(axis=1, keepdims=True) + prior))

    of_kind = classes[own:-1]
    of_word = np.r_[classes[:own], of_kind[kinds[own:]]]
    # words of their own count in their class, all others in that of their kind
    n, v = np.zeros(KINDS), np.zeros(KINDS)
    for x, (a, b) in by_kind.items():
        n[x], v[x] = a, b
    n -= np.bincount(kinds[:own], c[:own], KINDS)
    v -= np.bincount(kinds[:own], minlength=KINDS)
    in_class = np.bincount(of_kind, n + added * v, k) + np.bincount(of_word[:own], c[:own] + added, k) + added
    emission = np.log10((c + added) / in_class[of_word]) if len(words) else np.empty(0)
    return Model(counts, total, distinct, Head(words, c, of_word, emission, of_kind, transition, float(total + distinct + 1), n_docs), in_class.tolist(), added)


def _items(rows: DataFrame, words: list[bytes]) -> DataFrame:
    """(items) of each text of ``rows``: places in ``words``, or behind them the kinds of other words."""
    shared = rows.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = {w: k for k, w in enumerate(shared.value)}.get
        own = len(shared.value)
        for b in batches:
            out = []
            for t in b.column(0).cast(pa.binary()):
                out.append(np.array([k if (k := at(w)) is not None else own + kind(w) for w in tokens(t.as_py())], np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.int32()))], ["items"])

    return rows.select("text").mapInArrow(run, "items array<int>")


def _sequences(b: pa.RecordBatch, of: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Items of all texts of a batch one after another, each text between ends (item -1), and their classes."""
    at = np.asarray(b.column(0).offsets, np.int64)
    flat = np.asarray(b.column(0).values, np.int64)[at[0] : at[-1]]
    place = np.arange(len(flat)) + np.repeat(np.arange(len(at) - 1), np.diff(at)) + 1
    items = np.full(len(flat) + len(at), -1, np.int64)
    items[place] = flat
    return items, np.where(items < 0, end, of[items])


def _pairs(ids: DataFrame, of: np.ndarray, size: int) -> np.ndarray:
    """Counts of neighbours by ``of`` each item; last the end (as predecessor the beginning)."""
    shared = ids.sparkSession.sparkContext.broadcast(of)
    n = size + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(n * n, np.int64)
        for b in batches:
            x = _sequences(b, shared.value, size)[1]
            seen += np.bincount(x[:-1] * n + x[1:], minlength=n * n) if len(x) > 1 else 0
        pair = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(seen[pair])], ["pair", "c"])

    out = np.zeros(n * n)
    for r in ids.mapInArrow(run, "pair long, c long").groupBy("pair").agg(F.sum("c").alias("c")).collect():
        out[r["pair"]] = r["c"]
    return out.reshape(n, n)


def _joined(ids: DataFrame, classes: np.ndarray, table: np.ndarray, first: int, items: int) -> np.ndarray:
    """The class for each item from ``first`` on to which its neighbours, by the ``classes`` so far, add
    most; ``table``: of class pairs, the end last, which no item joins.  Items that never occur keep their class."""
    n = len(table)
    # what a neighbour of class c adds if the item precedes it (0) or follows it (1)
    table = table + 0.1
    mutual = np.log(table * table.sum() / (table.sum(axis=1, keepdims=True) * table.sum(axis=0, keepdims=True)))
    gain = np.r_[mutual[:-1].T, mutual[:, :-1]]
    shared = ids.sparkSession.sparkContext.broadcast((classes[:-1], gain))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> pa.RecordBatch:
            key, c = np.unique(np.concatenate(held), return_counts=True) if held else (np.empty(0, np.int64),) * 2
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(key // (2 * n)), pa.array((key % (2 * n)).astype(np.int32)), pa.array(c)], ["item", "place", "c"])

        for b in batches:
            item, x = _sequences(b, shared.value[0], n - 1)
            at = np.flatnonzero(item >= first)
            held += [item[at] * 2 * n + x[at + 1], (item[at] * 2 + 1) * n + x[at - 1]]
            size += 2 * len(at)
            if size > 4_000_000:
                yield out()
                size = 0
        yield out()

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.asarray(b.column(1).offsets, np.int64)
            each = b.column(1).values.slice(at[0], at[-1] - at[0]).flatten()
            place, c = (np.asarray(x) for x in each)
            total = np.add.reduceat(shared.value[1][place] * c[:, None], at[:-1] - at[0]) if len(c) else np.empty((0, n - 1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(total.argmax(axis=1), pa.int32())], ["item", "class"])

    counted = ids.mapInArrow(count, "item long, place int, c long").groupBy("item", "place").agg(F.sum("c").alias("c"))
    of = classes[first:-1].copy()
    for r in counted.groupBy("item").agg(F.collect_list(F.struct("place", "c")).alias("each")).mapInArrow(best, "item long, class int").collect():  # one row for each item
        of[r["item"] - first] = r["class"]
    return of


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: its id, n_tokens (words and the end), n_known (those seen in training),
    base_score (log10 under add-one word frequencies) and score (log10 under the model).

    Null and empty texts have one token, the end; ids may be of any type, and null; rows with equal ids are scored each by itself; an
    empty table gives no rows."""
    arrow_rows(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model.head)
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"row long, id {id_type}, key binary, class int, n long, n_tokens long, n_known long, base double, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = shared.value
        at, base = head.lookup().get, np.log10((head.counts + 1) / head.base)
        last = len(head.transition) - 1
        known_end = head.end_count > 0
        for b in batches:
            rows: list[tuple] = []
            for row, i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.binary()).to_pylist(), strict=True):
                w = tokens(t)
                k = np.array([at(x, -1) for x in w], np.int64)
                out = np.flatnonzero(k < 0)
                known = k[k >= 0]
                c = np.empty(len(w) + 2, np.int64)
                c[0] = c[-1] = last
                c[1:-1] = head.classes[k] if len(head.classes) else 0  # those not in the head follow
                rest = Counter(w[j] for j in out)
                classes = {x: int(head.of_kind[kind(x)]) for x in rest}
                c[out + 1] = [classes[w[j]] for j in out]
                rows.append((row, i, b" " + str(row).encode(), None, None, len(w) + 1, len(known) + known_end, float(base[known].sum() + np.log10((head.end_count + 1) / head.base)), float(head.emission[known].sum() + head.transition[c[:-1], c[1:]].sum())))
                rows.extend((row, None, x, classes[x], n, None, None, None, None) for x, n in rest.items())
                if len(rows) > 50_000:
                    yield _batch(rows, b.schema.field(1).type)
                    rows = []
            if rows:
                yield _batch(rows, b.schema.field(1).type)

    def _batch(rows: list[tuple], id_kind: pa.DataType) -> pa.RecordBatch:
        kinds = (pa.int64(), id_kind, pa.binary(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["row", "id", "key", "class", "n", "n_tokens", "n_known", "base", "score"])

    texts = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    # keys that begin with a blank are no words: the rows of whole texts pass the join as they are
    parts = texts.mapInArrow(run, schema).join(model.counts.select(F.col("word").alias("key"), "c"), "key", "left")
    c, norm = F.coalesce("c", F.lit(0)), F.element_at(F.array(*map(F.lit, model.norm)), F.col("class") + 1)
    word = F.col("n").isNotNull()
    parts = parts.select(
        "row", "id", "n_tokens",
        F.when(word, F.when(c > 0, F.col("n")).otherwise(0)).otherwise(F.col("n_known")).alias("n_known"),
        F.when(word, F.col("n") * F.log10((c + 1) / F.lit(model.head.base))).otherwise(F.col("base")).alias("base"),
        F.when(word, F.col("n") * F.log10((c + F.lit(model.added)) / norm)).otherwise(F.col("score")).alias("score"),
    )
    whole = parts.groupBy("row").agg(F.max("id").alias(id_col), F.max("n_tokens").alias("n_tokens"), F.sum("n_known").alias("n_known"), F.sum("base").alias("base_score"), F.sum("score").alias("score"))
    return whole.select(id_col, "n_tokens", "n_known", "base_score", "score")
