"""MinHash near-duplicates: bands of many universal hash minima propose, signatures verify, full sets confirm.

Of each distinct set of shingles BANDS * ROWS minima are taken, each of a universal hash (a * x + b) mod p; sets that agree
in all ROWS minima of a band meet.  Where they meet, their signatures, one bit of each of 128 minima, must differ in few
bits.  Components of what is left are clusters, within which links are confirmed on the full sets (``confirmed``), and
components of the links, by large-star and small-star in turn, are the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, cut
from .simhash import components, gray_rank, links, shingle_hashes, similar, stars, tree_of

#: A pair of similarity 0.85 meets in no band with the chance (1 - 0.85 ** ROWS) ** BANDS = 2.4e-7.
BANDS, ROWS = 26, 5
PRIME = (1 << 31) - 1
BITS = 128
#: Differing bits up to which signatures agree: 9.6 on average at a similarity of 0.85, 3.0 their standard deviation.
APART = 28
#: Members and shingles of a block of a cluster.
BLOCK, BLOCK_SHINGLES = 512, 1 << 20
#: Members of clusters that are told to all tasks by id; if there are more, texts join them.
MOST_SENT = 1_000_000
#: Edges of a task when components are sought.
EDGES = 200_000

_R = np.random.default_rng(13)
FACTOR, SHIFT = _R.integers(1, PRIME, BANDS * ROWS, np.uint64), _R.integers(0, PRIME, BANDS * ROWS, np.uint64)
MIX = _R.integers(0, 1 << 63, ROWS, np.uint64) * np.uint64(2) + np.uint64(1)


def minima(h: np.ndarray) -> np.ndarray:
    """The least value of each hash over ``h``, none empty; p stands for 0 as well, alike in all sets."""
    p, s = np.uint64(PRIME), np.uint64(31)
    x = (h ^ (h >> np.uint64(32))) & p
    least = np.full(len(FACTOR), np.iinfo(np.uint64).max)
    for at in range(0, len(x), 1024):  # a long text's values are not held at once
        v = x[at : at + 1024, None] * FACTOR + SHIFT
        v = (v & p) + (v >> s)
        least = np.minimum(least, ((v & p) + (v >> s)).min(axis=0))
    return least


def signature(least: np.ndarray) -> np.ndarray:
    """One bit of each of the first 128 minima, as two words: sets of similarity J agree in each with the chance (1 + J) / 2."""
    mixed = least[:BITS] * np.uint64(0x9E3779B97F4A7C15)
    return np.packbits((mixed >> np.uint64(63)).astype(np.uint8), bitorder="little").view(np.uint64)


def bands(least: np.ndarray) -> np.ndarray:
    """One value for each band, equal if its minima are."""
    v = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)
    for column, m in zip(least.reshape(BANDS, ROWS).T, MIX, strict=True):
        v = (v ^ (v >> np.uint64(29)) ^ column) * m
    return v ^ (v >> np.uint64(32))


def prints(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(id, n_shingles, key, more, rank, s1, s2, bands): key and more are equal for equal sets; rank: the signature's place
    in Gray order; bands: null for the empty set."""
    arrow_rows(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        for b in batches:
            sizes, keys, signs, found = [], [], [], []
            for t in b.column(1).to_pylist():
                h = np.unique(shingle_hashes(t, shingle))
                sizes.append(len(h))
                keys.append(xxh3_128_digest(h.tobytes()))
                least = minima(h) if len(h) else None
                signs.append(np.zeros(2, np.uint64) if least is None else signature(least))
                found.append(None if least is None else bands(least).view(np.int64))
            key = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)
            s = np.array(signs, np.uint64).reshape(-1, 2)
            longs = (np.array(sizes, np.int64), key[:, 0], key[:, 1], gray_rank(s[:, 0]).view(np.int64), s[:, 0].copy().view(np.int64), s[:, 1].copy().view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(np.ascontiguousarray(x)) for x in longs), pa.array(found, pa.list_(pa.int64()))], ["id", "n_shingles", "key", "more", "rank", "s1", "s2", "bands"])

    schema = "id long, n_shingles long, key long, more long, rank long, s1 long, s2 long, bands array<long>"
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def members(docs: DataFrame, clusters: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(cluster, id, size, shingles): the full sets of the documents of ``clusters`` (id, component_id)."""
    named = clusters.select("id", F.col("component_id").alias("cluster"))
    if clusters.limit(MOST_SENT + 1).count() <= MOST_SENT:  # texts stay where they are
        named = F.broadcast(named)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).join(named, "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [np.unique(shingle_hashes(t, shingle)).view(np.int64) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([len(x) for x in sets], pa.int64()), pa.array(sets, pa.list_(pa.int64()))], ["cluster", "id", "size", "shingles"])

    return texts.select("cluster", "id", "text").mapInArrow(run, "cluster long, id long, size long, shingles array<long>").filter("size > 0")


def _sets(t: pa.Table) -> tuple[np.ndarray, list[np.ndarray]]:
    t = t.combine_chunks()
    return t.column("id").to_numpy(), [np.asarray(x.values, np.int64) for x in t.column("shingles")]


def blocks_of(rows: DataFrame, block: int | None = None) -> DataFrame:
    """(cluster, blocks): into how many blocks, of ``block`` members (BLOCK), each cluster's ``rows`` are dealt."""
    n = F.greatest(F.count("*") / (block or BLOCK), F.sum("size") / BLOCK_SHINGLES)
    return rows.groupBy("cluster").agg(F.ceil(n).cast("int").alias("blocks"))


def told(rows: DataFrame) -> DataFrame:
    """``rows``, if few, for all tasks, so that the sets that they meet are not shuffled."""
    return F.broadcast(rows) if rows.limit(MOST_SENT + 1).count() <= MOST_SENT else rows


def dealt(rows: DataFrame) -> DataFrame:
    return rows.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))


def confirmed(sets: DataFrame, least: float, block: int | None = None) -> DataFrame:
    """(src, dst): stars that hold together what links of a similarity of ``least`` hold together within clusters.

    A cluster is dealt into blocks, and its first member, the hub, comes to each of them: in one round all that hangs together
    with the hub within a block is found, which in a group of near copies is nearly all.  Only members beyond the hub's
    component are then held against the whole cluster, block by block; a link that no block has has one of these at an end."""

    def within(t: pa.Table) -> pa.Table:
        ids, held = _sets(t)
        order = np.argsort(ids, kind="stable")
        src, dst = similar(ids[order], [held[k] for k in order], least)
        return pa.table({"cluster": pa.array(np.full(len(src), t.column("cluster")[0].as_py(), np.int64)), "src": pa.array(src), "dst": pa.array(dst)})

    def between(t: pa.Table) -> pa.Table:
        beyond = t.column("beyond").to_numpy(zero_copy_only=False)
        ids, held = _sets(t)
        flat, token = np.unique(np.concatenate(held), return_inverse=True)
        size = np.array([len(x) for x in held])
        start = np.r_[0, np.cumsum(size)]
        i, j = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for k in np.flatnonzero(beyond):
            mark = np.zeros(len(flat), np.int64)
            mark[token[start[k] : start[k + 1]]] = 1
            both = np.add.reduceat(mark[token], start[:-1])
            hit = np.flatnonzero(both / (size + size[k] - both) >= least)
            i.append(np.full(len(hit), k))
            j.append(hit)
        used, place = np.unique(ids, return_inverse=True)
        src, dst = stars(used, place[np.concatenate(i)], place[np.concatenate(j)])
        return pa.table({"src": pa.array(src), "dst": pa.array(dst)})

    many = cut(blocks_of(sets, block).filter("blocks > 1"))
    several = told(many)
    rows = dealt(sets.join(several, "cluster", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))))
    hubs = rows.filter("id = cluster and blocks > 1").withColumn("to", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).filter("to <> block").withColumn("block", F.col("to"))
    met = rows.select("cluster", "block", "id", "shingles").unionByName(hubs.select("cluster", "block", "id", "shingles"))
    first = cut(met.groupBy("cluster", "block").applyInArrow(within, "cluster long, src long, dst long"))
    if not many.limit(1).count():
        return first.select("src", "dst")
    # the hub has the least id of its cluster, so the stars of its component point to it
    reached = cut(first.filter("dst = cluster").join(several, "cluster", "left_semi").select(F.col("src").alias("id")).distinct())
    rest = rows.filter("blocks > 1 and id <> cluster").select("cluster", "id", "size", "shingles").join(told(reached), "id", "left_anti")
    rest = cut(rest.select("cluster", "id", "size", "shingles"))
    against = cut(blocks_of(rest, block))
    few = told(against)
    left = dealt(rest.join(few, "cluster")).join(told(many.withColumnRenamed("blocks", "whole")), "cluster").withColumn("own", F.explode(F.sequence(F.lit(0), F.col("whole") - 1)))
    right = dealt(sets.join(several, "cluster")).join(told(against.withColumnRenamed("blocks", "parts")), "cluster").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    pairs = left.select("cluster", F.col("block").alias("part"), "own", "id", "shingles", F.lit(True).alias("beyond")).unionByName(right.select("cluster", "part", F.col("block").alias("own"), "id", "shingles", F.lit(False).alias("beyond")))
    return first.select("src", "dst").unionByName(pairs.groupBy("cluster", "part", "own").applyInArrow(between, "src long, dst long"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, least: float = 0.85) -> DataFrame:
    """Per row of ``docs``: its id, n_shingles (distinct shingles of ``shingle`` words) and component_id, the least id reached by
    links of a Jaccard similarity of at least ``least``.

    Equal sets meet in one node first, so that copies cost nothing further.  A text of fewer words has its whole sequence as
    one shingle; null, empty and blank texts have none and are linked with nothing; very long texts are taken whole.  Rows of one id are
    one document to the links, and stay rows; rows without an id are linked to nothing of their own, and have the
    component of equal sets, else null.  Ids must be whole numbers; other columns are not read; an empty table gives no rows."""
    if dict(docs.dtypes)[id_col] not in ("bigint", "int", "smallint", "tinyint"):
        raise ValueError(f"{id_col} must be a whole number")
    found = cut(prints(docs, id_col, text_col, shingle))
    nodes = cut(found.filter("id is not null and bands is not null").groupBy("key", "more").agg(F.min(F.struct("id", "rank", "s1", "s2", "bands")).alias("n")).select("key", "more", "n.*"))
    tree = cut(tree_of(nodes.select(F.explode("bands").alias("bucket"), "rank", "s1", "s2", "id")))
    # the signature's first word stands for the code: its differing bits are among the signature's
    near = components(links(tree, APART, APART), rows_a_task=EDGES)
    clusters = cut(near.unionByName(near.select(F.col("component_id").alias("id"), "component_id")).distinct())
    held = components(confirmed(cut(members(docs, clusters, id_col, text_col, shingle)), least), rows_a_task=EDGES)
    named = nodes.join(held, "id", "left").select("key", "more", F.coalesce("component_id", "id").alias("component_id"))
    whole = found.select("id", "n_shingles", "key", "more").join(named, ["key", "more"], "left")
    return whole.select(F.col("id").alias(id_col), "n_shingles", F.coalesce("component_id", "id").alias("component_id"))
