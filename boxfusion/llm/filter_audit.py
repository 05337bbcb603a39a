"""Which filter removes what, in every order of five filters.

A row is told by the set of filters that it fails, a number below 32.  For each such set and each of the 120 orders a table
has the step at which the row goes, so that tasks only look up and count (``tally``); the counts of all tasks are summed.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, cut, refuse_reserved

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in itertools.permutations(FILTERS)]
STEPS = len(FILTERS) + 1
CELLS = len(ORDERS) * STEPS
#: Parts whose counts a task holds at a time; beyond, it passes them on.
MOST_HELD = 64
MARKS = frozenset(b"#$%&*|")
_KIND = np.zeros(256, np.uint8)  # 1 for A-Z, 2 for bytes that go on a character
_KIND[65:91], _KIND[0x80:0xC0] = 1, 2


def lookup_table() -> np.ndarray:
    """[failed filters as bits, order]: the step, from 1, at which a row goes; 0 if it stays."""
    place = np.array([[o.index(f) + 1 for f in FILTERS] for o in ORDERS])
    failed = (np.arange(32)[:, None] >> np.arange(5)) & 1
    step = np.where(failed[:, None, :] == 1, place[None], STEPS).min(axis=2)
    return np.where(step == STEPS, 0, step)


def failures(text: bytes) -> int:
    """The filters A to D that ``text`` fails, as bits: under 200 words; distinct words under half of all; A-Z over 3 % of
    code points; a symbol of MARKS."""
    words = text.split()
    kinds = np.bincount(_KIND[np.frombuffer(text, np.uint8)], minlength=3)
    failed = [len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * int(kinds[1]) > 3 * (len(text) - int(kinds[2])), not MARKS.isdisjoint(text)]
    return sum(1 << k for k, f in enumerate(failed) if f)


def judged(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(part, mask, good, toxic) of each row of ``docs``: its part ('' where null), the filters that it fails and whether it
    is labelled of good quality or toxic.

    E: a row of a smaller id has the same text; texts meet by a hash of 128 bits, and only their least ids join back.  A
    null text is empty, and equal to empty ones; a row without an id is never a repetition and has no label; of several labels
    of an id any 1 counts, nulls don't; rows of one id and text are no repetitions of each other."""
    refuse_reserved(docs)
    arrow_rows(docs.sparkSession)
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        for b in batches:
            found = b.column(2).to_pylist()
            digests = np.frombuffer(b"".join(map(xxh3_128_digest, found)), np.int64).reshape(-1, 2)
            masks = pa.array([failures(t) for t in found], pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), masks, pa.array(digests[:, 0].copy()), pa.array(digests[:, 1].copy())], ["id", "part", "mask", "d1", "d2"])

    kind = texts.schema["id"].dataType.simpleString()
    marks = cut(texts.mapInArrow(run, f"id {kind}, part string, mask int, d1 long, d2 long"))
    # cut, as only a join of two plain shuffles is split where a text has a large share of all rows
    first = cut(marks.groupBy("d1", "d2").agg(F.min("id").alias("first"), F.count("*").alias("n")).filter("n > 1").select("d1", "d2", "first"))
    tags = labels.select(F.col(id_col).alias("id"), (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic")).filter("id is not null")
    tags = cut(tags.groupBy("id").agg(F.max("good").alias("good"), F.max("toxic").alias("toxic")))
    again = F.when(F.col("id") > F.col("first"), F.lit(16)).otherwise(F.lit(0))
    whole = marks.join(first, ["d1", "d2"], "left").select("id", "part", (F.col("mask") + again).alias("mask")).join(tags, "id", "left")
    return whole.select("part", "mask", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))


def tally(rows: DataFrame) -> DataFrame:
    """(part, counts) of ``rows`` (part, mask, good, toxic): rows by order and step, then so the good and so the toxic ones,
    then rows by mask.  Tasks count by themselves; their counts are summed place by place."""
    arrow_rows(rows.sparkSession)
    table = lookup_table()
    at_order = np.arange(len(ORDERS)) * STEPS

    def counts(part: np.ndarray, n: int, mask: np.ndarray) -> np.ndarray:
        at = part[:, None] * CELLS + at_order + table[mask]
        return np.bincount(at.ravel(), minlength=n * CELLS).reshape(n, CELLS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.list_(pa.int64()))], ["part", "counts"])

        for b in batches:
            if not b.num_rows:
                continue
            names = pc.dictionary_encode(b.column(0))
            part, n, mask = np.asarray(names.indices, np.int64), len(names.dictionary), np.asarray(b.column(1), np.int64)
            good, toxic = (np.asarray(c.to_numpy(zero_copy_only=False), bool) for c in b.columns[2:])
            by_mask = np.bincount(part * 32 + mask, minlength=n * 32).reshape(n, 32)
            found = np.concatenate([counts(part, n, mask), counts(part[good], n, mask[good]), counts(part[toxic], n, mask[toxic]), by_mask], axis=1)
            for name, row in zip(names.dictionary.to_pylist(), found, strict=True):
                held[name] = held[name] + row if name in held else row
            if len(held) > MOST_HELD:
                yield told()
                held = {}
        if held:
            yield told()

    each = rows.mapInArrow(run, "part string, counts array<long>").select("part", F.posexplode("counts").alias("at", "n"))
    summed = each.groupBy("part", "at").agg(F.sum("n").alias("n"))
    return summed.groupBy("part").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "n"))), lambda x: x["n"]).alias("counts"))


def audit(rows: DataFrame) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of ``rows``
    (part, mask, good, toxic): a row for each part, order and step, zeros included; none if there are no rows."""
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    which = np.array([[FILTERS.index(f) for f in o] for o in ORDERS])  # [order, step - 1]: the filter
    has = (np.arange(32)[:, None] >> np.arange(5)) & 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, counts in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                c = np.array(counts, np.int64)
                went, good, toxic = c[: 3 * CELLS].reshape(3, len(ORDERS), STEPS)
                by_mask = c[3 * CELLS :]
                removed = went[:, 1:]
                shapley = np.zeros(len(FILTERS), np.int64)
                np.add.at(shapley, which, removed)
                kept = by_mask.sum() - np.cumsum(removed, axis=1)
                columns = (kept, removed, (by_mask @ has)[which] - removed, by_mask[1 << np.arange(5)][which], good[:, 1:], toxic[:, 1:], shapley[which])
                n = len(ORDERS) * len(FILTERS)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * n, pa.string()), pa.array(np.repeat(ORDERS, len(FILTERS)).tolist(), pa.string()), pa.array(np.tile(np.arange(1, STEPS), len(ORDERS)), pa.int32())]
                    + [pa.array(np.ascontiguousarray(x).ravel().astype(np.int64)) for x in columns],
                    ["part", "filter_order", "step", *names],
                )

    return tally(rows).mapInArrow(run, "part string, filter_order string, step int, " + ", ".join(f"{n} long" for n in names))
