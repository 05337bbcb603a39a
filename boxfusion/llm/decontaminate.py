"""Benchmark decontamination by template windows.

Texts become templates: numbers, names and units turn into typed placeholders.  Windows of template
tokens of documents and benchmark items meet in a hash join.  Windows of one item at one distance
between the two texts form an alignment; its placeholders must be filled consistently, so that one
value of the item always stands for one value of the document, which tells re-parameterised
questions from texts that happen to share a pattern.  Windows that hold a value that stands for
several do not count, unless they are verbatim."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import arrow_rows, cut, refuse_reserved, without

NUMBER = re.compile(r"[+-]?[0-9][0-9.,:/]*")
MEASURE = re.compile(r"([$€£¥]?)([+-]?[0-9][0-9.,:/]*)([a-zA-Z%°µ²³/]{0,6})")
UNITS = frozenset("mm cm m km in ft yd mi mg g kg lb lbs oz t ml l cl dl gal s sec min h hr hrs ms kb mb gb tb hz khz mhz ghz w kw kwh mw v a n j kj cal kcal pa kpa bar °c °f c f k % percent usd eur gbp dollars euros pounds cents meters metres miles kilometers kilograms grams liters litres hours minutes seconds days weeks months years".split())
EDGE = "\"'“”‘’«»()[]{}<>.,;:!?…*#$%&|"
SENTENCE_ENDS = frozenset(".!?:;\"”»)…")
LITERAL, NUM, NAME, UNIT = 0, 1, 2, 3
#: Tokens of one window, and how many of them must be literal.
WINDOW, LEAST_LITERAL = 8, 4
#: Tokens of an unbroken run of windows that tell a copy, whatever share of the item they are.
RUN = 13
#: Sets hashes of exact windows apart from those of template windows.
EXACT = np.uint64(0xD6E8FEB86659FD93)
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
SCHEMA = "doc long, place int, hash long, slots array<string>"


def member(sorted_values: np.ndarray, x: np.ndarray) -> np.ndarray:
    k = np.searchsorted(sorted_values, x)
    return sorted_values[np.minimum(k, len(sorted_values) - 1)] == x if len(sorted_values) else np.zeros(len(x), bool)


class Tokens:
    """Template tokens of words, remembered: the hash and kind of each word amid a sentence and at
    its beginning, and whether it ends one."""

    def __init__(self, known: np.ndarray | None = None, most: int = 400_000) -> None:
        self.known, self.most = known, most
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.table = np.empty((1024, 7), np.uint64)  # hash and kind, amid and at the beginning; ends; both known
        self.filled = 0
        self.new: tuple[list[int], ...] = ([], [], [], [], [])

    def add(self, word: str) -> int:
        if word.islower() and word.isalpha() and word not in UNITS:  # most words
            h = name_h = xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
            kind = name = LITERAL
            ends = False
        else:
            core = word.strip(EDGE) or word
            low = core.lower()
            kind = name = LITERAL
            token, name_token = low, None
            plain = core.isalpha()
            m = None if plain else MEASURE.fullmatch(core)
            if m and (m[1] or not m[3] or m[3].lower() in UNITS):
                kind = name = NUM
                token = f"<num{m[1]}{'u' if m[3] else ''}>"
            elif len(low) > 2 and low in UNITS:
                kind = name = UNIT
                token = "<unit>"
            elif core[0].isupper() and core[1:].islower():
                name, name_token = NAME, "<name>"
            h = xxh64_intdigest(token.encode("utf-8", "surrogatepass"))
            name_h = xxh64_intdigest(name_token.encode()) if name_token else h
            ends = word[-1] in SENTENCE_ENDS
        new = self.new
        new[0].append(h)
        new[1].append(name_h)
        new[2].append(kind)
        new[3].append(name)
        new[4].append(ends)
        self.place[word] = k = len(self.place)
        return k

    def of(self, text: str) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Words, hashes of their template tokens, kinds, and whether the tokens are known."""
        words = text.split()
        if len(self.place) > self.most:
            self.clear()
        get, add = self.place.get, self.add
        at = np.fromiter([k if (k := get(w)) is not None else add(w) for w in words], np.int64, len(words))
        if n := len(self.new[0]):
            while self.filled + n > len(self.table):
                self.table = np.concatenate([self.table, np.empty_like(self.table)])
            for column, held in enumerate(self.new):
                self.table[self.filled : self.filled + n, column] = held
                held.clear()
            for column in (0, 1):
                self.table[self.filled : self.filled + n, 5 + column] = 1 if self.known is None else member(self.known, self.table[self.filled : self.filled + n, column])
            self.filled += n
        t = self.table[at]
        first = np.r_[True, t[:-1, 4] > 0] if len(at) else np.empty(0, bool)
        return words, np.where(first, t[:, 0], t[:, 1]), np.where(first, t[:, 2], t[:, 3]).astype(np.int8), np.where(first, t[:, 5], t[:, 6]) > 0


def window_hashes(tokens: np.ndarray, n: int) -> np.ndarray:
    h = np.full(max(0, len(tokens) - n + 1), np.uint64(n))
    for k in range(n):
        h = (h ^ (h >> np.uint64(29))) * MULTIPLIER + tokens[k : k + len(h)]
    return h


def exact_hashes(words: list[str], n: int) -> np.ndarray:
    """Hashes of the windows of ``n`` words as they are, but for case and edges."""
    h = [xxh64_intdigest((w.strip(EDGE) or w).lower().encode("utf-8", "surrogatepass")) for w in words]
    return window_hashes(np.array(h, np.uint64), n) ^ EXACT


def places(kinds: np.ndarray, n: int) -> np.ndarray:
    """Where windows of ``n`` tokens with enough literal ones begin."""
    literal = np.r_[0, np.cumsum(kinds == LITERAL)]
    return np.flatnonzero(literal[n:] - literal[:-n] >= min(LEAST_LITERAL, n))


def needs_exact(kinds: np.ndarray, window: int) -> bool:
    """Whether an item of these tokens is one window, whose first token may be a name elsewhere, or has
    no window with enough literal tokens."""
    return len(kinds) <= window or not len(places(kinds, window))


def windows(texts: DataFrame, id_col: str, text_col: str, lengths: list[int] | None, window: int, only: tuple[np.ndarray, np.ndarray] | None = None, exact: list[int] | None = None) -> DataFrame:
    """(doc, place, hash, slots) for all windows with enough literal tokens of each text; if ``only``
    (token hashes, window hashes; both sorted) is given, for those found in it.  ``lengths``: of the
    windows; None takes one length for each text, ``window`` or all its words if it has fewer, and
    adds exact windows where ``needs_exact``, and a single window as it is amid a sentence.
    ``exact``: lengths of exact windows to add otherwise."""
    arrow_rows(texts.sparkSession)
    shared = texts.sparkSession.sparkContext.broadcast(only)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        tokens = Tokens(known and known[0])
        for b in batches:
            out: list[list] = [[], [], [], []]
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if not text:
                    continue
                words, h, kinds, good = tokens.of(text)
                for n in lengths or [min(window, len(h))]:
                    if not 0 < n <= len(h):
                        continue
                    runs = np.r_[0, np.cumsum(good)]
                    at = places(kinds, n)
                    at = at[runs[at + n] - runs[at] == n]
                    if not len(at):
                        continue
                    v = window_hashes(h, n)[at]
                    if known is not None:
                        keep = member(known[1], v)
                        at, v = at[keep], v[keep]
                    for p, x in zip(at.tolist(), v.view(np.int64).tolist(), strict=True):
                        out[0].append(doc)
                        out[1].append(p)
                        out[2].append(x)
                        out[3].append([f"{kinds[k]}{words[k].strip(EDGE)}" for k in range(p, p + n) if kinds[k] != LITERAL])
                if lengths is None and 0 < len(h) <= window:
                    _, h2, kinds2, _ = tokens.of(f"x {text}")  # the first word amid a sentence
                    if h2[1] != h[0] and len(places(kinds2[1:], len(h))):
                        slots = [f"{k}{w.strip(EDGE)}" for k, w in zip(kinds2[1:].tolist(), words, strict=True) if k != LITERAL]
                        for column, x in zip(out, (doc, 0, int(window_hashes(h2[1:], len(h)).view(np.int64)[0]), slots), strict=True):
                            column.append(x)
                for n in (exact or []) if lengths is not None else [min(window, len(h))] if len(h) and needs_exact(kinds, window) else []:
                    v = exact_hashes(words, n)
                    at = np.flatnonzero(member(known[1], v)) if known is not None else np.arange(len(v))
                    for p in at.tolist():
                        for column, x in zip(out, (doc, p, int(v[p : p + 1].view(np.int64)[0]), []), strict=True):
                            column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.list_(pa.string()))], ["doc", "place", "hash", "slots"])

    return texts.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, SCHEMA)


def _vocabulary(benchmark: DataFrame, text_col: str) -> np.ndarray:
    """Hashes of the template tokens of ``benchmark``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens()
        for b in batches:
            for t in b.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(np.union1d(tokens.of(t or "")[1], tokens.of(f"x {t or ''}")[1][1:]).view(np.int64), pa.int64())], ["token"])

    rows = benchmark.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "token long").distinct().collect()
    return np.sort(np.array([r["token"] for r in rows], np.int64).view(np.uint64))


def judge(windows: list[tuple[int, list[str], list[str]]]) -> tuple[list[int], bool]:
    """Of the windows (place in the item, its slots, the document's slots) of one alignment: the places
    that count, and whether the slots of all map one to one.

    Windows that hold a value of the item that stands for several are left out, but never verbatim
    ones.  Several values of the item may stand for one."""
    stands: dict[str, set[str]] = defaultdict(set)
    back: dict[str, set[str]] = defaultdict(set)
    for _, theirs, mine in windows:
        for x, y in zip(theirs, mine, strict=True):
            stands[x].add(y)
            back[y].add(x)
    places = {p for p, theirs, mine in windows if theirs == mine or all(len(stands[x]) == 1 for x in theirs)}
    return sorted(places), all(len(v) == 1 for v in (*stands.values(), *back.values()))


def longest_run(places: list[int]) -> int:
    """How many of the sorted ``places`` follow one another at most."""
    most = n = 0
    for k, p in enumerate(places):
        n = n + 1 if k and p == places[k - 1] + 1 else 1
        most = max(most, n)
    return most


def _judged(met: DataFrame) -> DataFrame:
    """(doc, item, places, slots, consistent, longest) for each alignment; it has no more windows than the item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [judge([(w["item_place"], w["item_slots"], w["slots"]) for w in x]) for x in b.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x[0] for x in found], pa.list_(pa.int32())), b.column(2), pa.array([x[1] for x in found], pa.bool_()), pa.array([longest_run(x[0]) for x in found], pa.int32())], ["doc", "item", "places", "slots", "consistent", "longest"])

    each = met.groupBy("doc", "item", "lag").agg(F.max(F.size("slots")).alias("slots"), F.collect_set(F.struct("item_place", "item_slots", "slots")).alias("windows"))
    return each.select("doc", "item", "slots", "windows").mapInArrow(run, "doc long, item long, places array<int>, slots int, consistent boolean, longest int")


def _lengths(benchmark: DataFrame, text_col: str, window: int) -> tuple[list[int], list[int]]:
    """Lengths of the items' windows, and of those of items that need exact ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens()
        for b in batches:
            found = {(min(window, len(kinds)), needs_exact(kinds, window)) for kinds in (tokens.of(t or "")[2] for t in b.column(0).to_pylist()) if len(kinds)}
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int32()), pa.array([x[1] for x in found], pa.bool_())], ["n", "exact"])

    rows = benchmark.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "n int, exact boolean").distinct().collect()
    return sorted({r["n"] for r in rows}), sorted({r["n"] for r in rows if r["exact"]})


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, most_windows: int = 2_000_000) -> DataFrame:
    """(doc, item, matched, item_windows, coverage, slots, consistent, run): for each document and item that
    share template windows, the item's windows found with consistent slots, and whether the slots of
    all alignments map one to one; ``run``: tokens of the longest run of such windows in one alignment.

    Benchmarks of up to ``most_windows`` distinct windows are sent to the tasks, which then leave
    out windows that cannot join; beyond it all windows of the documents join.  Null and empty texts
    have no windows; items of fewer than ``window`` words are one window; items of one window, or
    without a window of enough literal tokens, are also found word for word; equal ids count as one
    document; empty tables give no rows."""
    items = cut(windows(benchmark, item_col, item_text_col, None, window).withColumnsRenamed({"doc": "item", "place": "item_place", "slots": "item_slots"}))
    lengths, exact = _lengths(benchmark, item_text_col, window)  # at most ``window`` of either
    only = None
    hashes = items.select("hash").distinct()
    if hashes.limit(most_windows + 1).count() <= most_windows:
        only = _vocabulary(benchmark, item_text_col), np.sort(np.array([r["hash"] for r in hashes.collect()], np.int64).view(np.uint64))
    total = items.groupBy("item").agg(F.countDistinct("item_place").alias("item_windows"))
    met = windows(docs, id_col, text_col, lengths or [window], window, only, exact).join(items, "hash").withColumn("lag", F.col("place") - F.col("item_place"))
    met = cut(met.filter(F.size("slots") == F.size("item_slots")))
    found = _judged(met).select("doc", "item", "slots", "consistent", "longest", F.explode_outer("places").alias("place")).groupBy("doc", "item")
    found = found.agg(F.countDistinct("place").alias("matched"), F.max("slots").alias("slots"), F.bool_and("consistent").alias("consistent"), F.max("longest").alias("longest"))
    return found.join(total, "item").select("doc", "item", "matched", "item_windows", (F.col("matched") / F.col("item_windows")).alias("coverage"), "slots", "consistent", (F.col("longest") + (window - 1)).alias("run"))


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5, run: int = RUN, **more: object) -> DataFrame:
    """``matches`` that cover at least ``least`` of an item's windows, or ``run`` tokens of it on end."""
    return matches(docs, benchmark, id_col, text_col, **more).filter((F.col("coverage") >= least) | (F.col("run") >= run))


def remove(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5, **more: object) -> DataFrame:
    """``docs`` without the contaminated ones; documents without an id stay.

    Null and empty texts stay; documents of one id go together; empty tables take nothing away."""
    refuse_reserved(docs)
    return without(docs, contaminated(docs, benchmark, id_col, text_col, least, **more).select("doc").distinct(), id_col)
