"""SimHash near-duplicates: fingerprints linked through a Gray-order hierarchical index.

The index, from the top: masked patterns, each a choice of the fingerprint's bits; under each pattern
and value of its bits, leaves of fingerprints in the order of their Gray rank, each with the mask of
the bits that all its members share; within a leaf, groups of 16 with their masks.  Differing bits
add up on the way down, and a group whose shared bits differ too much goes whole.  A value that a
third of all fingerprints share becomes many leaves, spread over tasks.

The patterns are all choices of blocks, under one of which any pair of few differing bits agrees, so
that no link is lost (``block_patterns``).  For ``copies`` this index proposes the texts whose fingerprints
differ in few bits.  At a word similarity of 0.8 some ten bits differ, at which no such choice is
selective: what lies beyond is proposed by bands of MinHashes, indexed the same way over sketches of
one-bit MinHashes.  Each link is verified by the exact similarity of the shingle sets before it counts.

Only links that hold components together leave a leaf, a star for each of its components, so that
no group yields all its pairs; components then come from joining stars until nothing changes.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, cut, refuse_reserved, without
from .common import cut as checkpointed

BITS = 64
LEAF, GROUP, SKETCH = 512, 16, 128
#: MinHashes of a band.  A pair of similarity J meets with the chance 1 - (1 - J ** BAND) ** (SKETCH / BAND),
#: all but 5e-8 at 0.8.
BAND = 4
#: Differing bits of sketches up to which a pair is a candidate: at a similarity of 0.8 they are 12.8 on
#: average, 3.4 their standard deviation.
APART = 30
#: Documents of a block, in which links are verified.
BLOCK = 512
#: Buckets of several leaves that are told to all tasks; if there are more, leaves meet by bucket.
MOST_SENT = 500_000
#: Edges of a task when components are sought.
EDGES = 200_000


def shingle_hashes(text: str | None, n: int, seed: int = 42) -> np.ndarray:
    """XXH64 of the ``n``-word shingles of ``text`` with A-Z lower-cased, repeats included; of the whole
    sequence if it has fewer words; none if it is null or has no word."""
    from xxhash import xxh64_intdigest

    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return np.empty(0, np.uint64)
    shingles = map(b" ".join, zip(*(w[k:] for k in range(n)), strict=False)) if len(w) >= n else [b" ".join(w)]
    return np.fromiter((xxh64_intdigest(s, seed) for s in shingles), np.uint64)


def simhash(h: np.ndarray) -> int:
    """The bits set in over half of ``h``; 0 if there is none."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(h), 4096):  # a long text's bits are not held at once
        ones += np.unpackbits(h[at : at + 4096, None].view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << int(b) for b in np.flatnonzero(2 * ones > len(h)))


def fingerprint(text: str | None, n: int = 4) -> int:
    return simhash(shingle_hashes(text, n))


def minhashes(h: np.ndarray) -> np.ndarray:
    """SKETCH MinHashes of the set of ``h``."""
    r = np.random.default_rng(SKETCH)
    factor, shift = r.integers(0, 1 << 31, SKETCH, np.uint32) * np.uint32(2) + np.uint32(1), r.integers(0, 1 << 32, SKETCH, np.uint32)
    least = np.full(SKETCH, np.uint32(0xFFFFFFFF))
    x = (h >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(x), 2048):
        least = np.minimum(least, (x[at : at + 2048, None] * factor + shift).min(axis=0))
    return least


def sketch(least: np.ndarray) -> np.ndarray:
    """One bit of each of the MinHashes ``least``, as two words: two texts of similarity J agree in each
    with the chance (1 + J) / 2."""
    mixed = least * np.uint32(0x9E3779B1)
    return np.packbits((mixed >> np.uint32(31)).astype(np.uint8), bitorder="little").view(np.uint64)


def band_hashes(least: np.ndarray) -> np.ndarray:
    """One value for each band of MinHashes, equal if the bands are."""
    v = np.arange(SKETCH // BAND, dtype=np.uint64)
    for column in least.reshape(-1, BAND).T:
        v = (v ^ (v >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + column
    return v ^ (v >> np.uint64(32))


def _signed(values: list[int] | np.ndarray) -> np.ndarray:
    return np.asarray(values, np.uint64).view(np.int64)


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int = 4) -> DataFrame:
    """(id, code, s1, s2): bits as signed longs; the sketch is 0."""
    arrow_rows(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes = pa.array(_signed([fingerprint(t, shingle) for t in b.column(1).to_pylist()]))
            none = pa.array(np.zeros(len(codes), np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), codes, none, none], ["id", "code", "s1", "s2"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "id long, code long, s1 long, s2 long")


def shingle_sets(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(id, key, more, code, rank, s1, s2, bands): ``key`` and ``more`` are equal for equal shingle sets; then the
    fingerprint, the Gray rank of the sketch's first word, the sketch, and the hashes of the bands, null if there is no
    shingle."""
    arrow_rows(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_intdigest

        for b in batches:
            keys, codes, sketches, bands = [], [], [], []
            for t in b.column(1).to_pylist():
                every = shingle_hashes(t, shingle)
                codes.append(simhash(every))
                h = np.unique(every)
                digest = xxh3_128_intdigest(h.tobytes())
                keys.append((digest >> 64, digest & (1 << 64) - 1))
                least = minhashes(h) if len(h) else None
                sketches.append((0, 0) if least is None else sketch(least))
                bands.append(None if least is None else band_hashes(least).view(np.int64))
            (key, more), (s1, s2) = (np.array(x, np.uint64).reshape(-1, 2).T.copy() for x in (keys, sketches))
            columns = [pa.array(_signed(x)) for x in (key, more, codes, gray_rank(s1), s1, s2)]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns, pa.array(bands, pa.list_(pa.int64()))], ["id", "key", "more", "code", "rank", "s1", "s2", "bands"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "id long, key long, more long, code long, rank long, s1 long, s2 long, bands array<long>")


def block_patterns(blocks: int, most: int) -> list[list[int]]:
    """All choices of blocks - most of near-equal blocks: any pair of at most ``most`` differing bits
    agrees under one of them."""
    edges = [BITS * k // blocks for k in range(blocks + 1)]
    return [[b for k in c for b in range(edges[k], edges[k + 1])] for c in itertools.combinations(range(blocks), blocks - most)]


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """The rank of each code among all in Gray order."""
    x = codes.astype(np.uint64)
    for s in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(s))
    return x


def shared(codes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For the runs of ``codes`` that begin at ``starts``: the mask of the bits that all have alike,
    and those bits."""
    all_set, any_set = np.bitwise_and.reduceat(codes, starts), np.bitwise_or.reduceat(codes, starts)
    return ~(all_set ^ any_set), all_set


def alike(x: np.ndarray, y: np.ndarray, most: int, apart: int | None) -> np.ndarray:
    """Whether fingerprints (first column) differ in at most ``most`` bits and, if ``apart`` is given,
    sketches (the others) in at most that many."""
    ok = np.bitwise_count(x[..., 0] ^ y[..., 0]) <= most
    if apart is not None:
        ok &= np.bitwise_count(x[..., 1] ^ y[..., 1]).astype(np.int16) + np.bitwise_count(x[..., 2] ^ y[..., 2]) <= apart
    return ok


def near(a: np.ndarray, b: np.ndarray, most: int, apart: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``a`` and ``b`` (rows of code and sketch, each in Gray order) of pairs that are alike:
    groups of both are compared by their shared bits, and only what remains is by members."""
    if not len(a) or not len(b):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    sa, sb = np.arange(0, len(a), GROUP), np.arange(0, len(b), GROUP)
    (ma, va), (mb, vb) = shared(a[:, 0], sa), shared(b[:, 0], sb)
    ga, gb = np.nonzero(np.bitwise_count((va[:, None] ^ vb) & ma[:, None] & mb) <= most)
    found = []
    for at in range(0, len(ga), 4096):
        i = sa[ga[at : at + 4096], None] + np.arange(GROUP)
        j = sb[gb[at : at + 4096], None] + np.arange(GROUP)
        x, y = a[np.minimum(i, len(a) - 1)], b[np.minimum(j, len(b) - 1)]
        near_codes = (np.bitwise_count(x[:, :, None, 0] ^ y[:, None, :, 0]) <= most) & (i < len(a))[:, :, None] & (j < len(b))[:, None, :]
        k, p, q = np.nonzero(near_codes)
        i, j = i[k, p], j[k, q]
        ok = alike(a[i], b[j], most, apart)
        found.append((i[ok], j[ok]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, np.int64),) * 2


def stars(ids: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For pairs (i, j) of places in ``ids``: each id that is linked, with the least of its component."""
    low = ids.copy()
    while True:  # least ids spread along links, and jump
        before = low.copy()
        m = np.minimum(low[i], low[j])
        np.minimum.at(low, i, m)
        np.minimum.at(low, j, m)
        if len(i):
            order = np.argsort(ids, kind="stable")
            low = low[order[np.searchsorted(ids, low, sorter=order)]]
        if (low == before).all():
            keep = low != ids
            return ids[keep], low[keep]


def dealt(nodes: DataFrame, patterns: list[list[int]]) -> DataFrame:
    """(bucket, rank, s1, s2, id): each row of ``nodes`` under each pattern.  ``bucket``: the pattern and
    the value of its bits; ``rank``: in Gray order, from which the code can be had back."""
    fields = ("bucket", "rank", "s1", "s2", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            code, s1, s2, ids = (np.asarray(c, np.int64) for c in b.columns)
            u = code.view(np.uint64)
            rank = gray_rank(u).view(np.int64)
            for k, bits in enumerate(patterns):
                value = np.full(len(u), np.uint64(k << 40))
                for at, bit in enumerate(bits):
                    value |= (u >> np.uint64(bit) & np.uint64(1)) << np.uint64(at)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (value.view(np.int64), rank, s1, s2, ids)], list(fields))

    return nodes.select("code", "s1", "s2", "id").mapInArrow(run, ", ".join(f"{f} long" for f in fields))


def leaves(rows: DataFrame, alone: bool = True) -> DataFrame:
    """Of sorted ``rows`` (bucket, rank, s1, s2, id): leaves of at most LEAF members of one bucket, with
    a number of their own, the mask and the bits of what they share; rows: code and sketch of each
    member, one after another.  To be written before it is used twice, as numbers follow from tasks.

    alone: whether the only member of a bucket has a leaf, which links it to nothing; members of a task's first and last
    bucket always have one, as these may go on in other tasks."""
    schema = "bucket long, leaf long, mask long, bits long, rows array<long>, ids array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = [np.empty(0, np.int64)] * 5
        number = TaskContext.get().partitionId() << 40
        first = before = None
        for b in itertools.chain(batches, [None]):
            if b is not None:
                held = [np.concatenate([h, np.asarray(b.column(k), np.int64)]) for k, h in enumerate(held)]
            bucket = held[0]
            if not len(bucket):
                continue
            starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
            ends = np.r_[starts[1:], len(bucket)]
            cuts = np.unique(np.concatenate([starts, *(np.arange(s, e, LEAF) for s, e in zip(starts, ends, strict=True) if e - s > LEAF)]))
            last = len(bucket) if b is None else cuts[-1]  # the last leaf may go on
            begin = cuts[cuts < last]
            own, size = bucket[begin], np.diff(np.r_[begin, last])
            if len(begin) and not alone:
                first = own[0] if first is None else first
                after = own[-1] if b is None else bucket[last]
                keep = (size > 1) | (own == first) | (own == np.r_[own[0] if before is None else before, own[:-1]]) | (own == np.r_[own[1:], after])
                before = own[-1]
                kept = np.repeat(keep, size)
                held = [np.r_[x[:last][kept], x[last:]] for x in held]
                own, size = own[keep], size[keep]
                last, begin = int(size.sum()), np.cumsum(size) - size
            if len(begin):
                rank = held[1][:last].view(np.uint64)
                code = (rank ^ (rank >> np.uint64(1))).view(np.int64)
                mask, bits = shared(code, begin)
                at = np.r_[begin, last].astype(np.int32)
                flat = np.stack([code, held[2][:last], held[3][:last]], axis=1).ravel()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own), pa.array(number + np.arange(len(begin))), pa.array(mask), pa.array(bits), pa.ListArray.from_arrays(pa.array(at * 3), pa.array(flat)), pa.ListArray.from_arrays(pa.array(at), pa.array(held[4][:last]))],
                    ["bucket", "leaf", "mask", "bits", "rows", "ids"],
                )
                number += len(begin)
            held = [x[last:] for x in held]

    return rows.mapInArrow(run, schema)


def index(nodes: DataFrame, patterns: list[list[int]]) -> DataFrame:
    """The leaves of all ``nodes`` (code, s1, s2, id), whose codes must be distinct."""
    return tree_of(dealt(nodes, patterns))


def tree_of(rows: DataFrame) -> DataFrame:
    """The leaves of ``rows`` (bucket, rank, s1, s2, id), which are dealt by ranges of bucket and rank, so
    that one bucket may fill many tasks.  The only members of their buckets are left out."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return leaves(rows.repartitionByRange(n, "bucket", "rank").sortWithinPartitions("bucket", "rank"), alone=False)


def links(tree: DataFrame, most: int = 4, apart: int | None = None, most_sent: int = 0) -> DataFrame:
    """(src, dst): stars over what is alike within leaves, and between leaves of one bucket whose shared
    bits differ in at most ``most``.  most_sent: up to so many buckets of several leaves are told to the tasks, so that
    leaves that are alone in theirs are not shuffled."""

    def rows_of(values: np.ndarray) -> np.ndarray:
        return np.asarray(values, np.int64).view(np.uint64).reshape(-1, 3)

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.asarray(b.column(1).offsets, np.int64)
            low, high = at[0], at[-1]
            c, k = rows_of(np.asarray(b.column(0).values)[low * 3 : high * 3]), np.asarray(b.column(1).values, np.int64)[low:high]
            size = np.diff(at)
            leaf = np.repeat(np.arange(len(size)), size)
            small = (size <= GROUP)[leaf]
            found = [(np.empty(0, np.int64),) * 2]
            for d in range(1, min(GROUP, len(leaf))):  # leaves of one group, all together
                i = np.flatnonzero(small[:-d] & (leaf[:-d] == leaf[d:]))
                i = i[alike(c[i], c[i + d], most, apart)]
                found.append((i, i + d))
            for n in np.flatnonzero(size > GROUP):
                s, e = at[n] - low, at[n + 1] - low
                i, j = near(c[s:e], c[s:e], most, apart)
                found.append((i[i < j] + s, j[i < j] + s))
            i, j = (np.concatenate(x) for x in zip(*found, strict=True))
            # ids of different leaves may be equal; they are one document all the same
            used, place = np.unique(k[np.r_[i, j]], return_inverse=True)
            src, dst = stars(used, place[: len(i)], place[len(i) :])
            yield pa.RecordBatch.from_arrays([pa.array(src), pa.array(dst)], ["src", "dst"])

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                ids = np.r_[np.asarray(r["ids"], np.int64), np.asarray(r["other_ids"], np.int64)]
                i, j = near(rows_of(r["rows"]), rows_of(r["other_rows"]), most, apart)
                src, dst = stars(ids, i, j + len(r["ids"]))
                yield pa.RecordBatch.from_arrays([pa.array(src), pa.array(dst)], ["src", "dst"])

    own = tree.filter(F.size("ids") > 1).select("rows", "ids").mapInArrow(within, "src long, dst long")
    many = tree.groupBy("bucket").count().filter("count > 1").select("bucket")
    if most_sent:
        many = cut(many.coalesce(8))
        if many.limit(most_sent + 1).count() <= most_sent:
            many = F.broadcast(many)
            tree = tree.join(many, "bucket", "left_semi")
    heads = tree.select("bucket", "leaf", "mask", "bits").join(many, "bucket")
    others = heads.select("bucket", F.col("leaf").alias("other"), F.col("mask").alias("other_mask"), F.col("bits").alias("other_bits"))
    differ = F.bit_count(F.col("bits").bitwiseXOR(F.col("other_bits")).bitwiseAND(F.col("mask")).bitwiseAND(F.col("other_mask")))
    pairs = heads.join(others, "bucket").filter((F.col("leaf") < F.col("other")) & (differ <= most)).select("bucket", "leaf", "other")
    body = tree.select("bucket", "leaf", "rows", "ids")
    joined = pairs.join(body, ["bucket", "leaf"]).join(body.select("bucket", F.col("leaf").alias("other"), F.col("rows").alias("other_rows"), F.col("ids").alias("other_ids")), ["bucket", "other"])
    return own.unionByName(joined.select("rows", "ids", "other_rows", "other_ids").mapInArrow(across, "src long, dst long"))


def components(edges: DataFrame, most_rounds: int = 60, rows_a_task: int | None = None) -> DataFrame:
    """(id, component_id) for all ends of ``edges`` (src, dst): the least id reachable.

    Large-star and small-star steps in turn, until the edges stay as they are.  rows_a_task: a round's edges lie in as many
    partitions as follows from their count in the round before, and eight at least, so that few edges are few files."""
    parts = None

    def state(e: DataFrame) -> tuple:
        r = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)")).alias("h")).first()
        return r["n"], r["h"]

    def cut(df: DataFrame) -> DataFrame:
        return checkpointed(df.coalesce(parts) if parts else df)

    edges = cut(edges.filter("src <> dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct())
    before = state(edges)
    for _ in range(most_rounds):
        if rows_a_task is not None:
            parts = max(8, -(-2 * before[0] // rows_a_task))
        # the least neighbours are written first: only a join of two plain shuffles is split where a node
        # has a large share of all edges
        both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        least = cut(both.groupBy("src").agg(F.min("dst").alias("least")))
        # large star: greater neighbours go to the least
        large = cut(both.join(least, "src").filter("dst > src").select(F.col("dst").alias("src"), F.least("src", "least").alias("dst")).distinct())
        # small star: lesser neighbours and the node itself go to the least
        least = cut(large.groupBy("src").agg(F.min("dst").alias("least")))
        small = large.join(least, "src").filter("dst <> least").select(F.col("dst").alias("src"), F.col("least").alias("dst"))
        edges = cut(small.unionByName(least.select("src", F.col("least").alias("dst"))).distinct())
        now = state(edges)
        if now == before:
            return edges.select(F.col("src").alias("id"), F.col("dst").alias("component_id"))
        before = now
    raise RuntimeError(f"components still change after {most_rounds} rounds")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, most: int = 4) -> DataFrame:
    """Per row of ``docs``: its id, ``code`` (the fingerprint) and ``component_id``, the least id
    that links of at most ``most`` differing bits reach.  All links are found.

    Equal fingerprints meet in one node first, so copies cost nothing further.  Null, empty and
    blank texts have fingerprint 0 and are linked as any other; repeated ids give repeated rows; rows
    without an id are linked to nothing of their own; an empty table gives no rows."""
    prints = cut(fingerprints(docs, id_col, text_col, shingle))
    nodes = cut(prints.filter("id is not null").groupBy("code").agg(F.min(F.struct("id", "s1", "s2")).alias("n")).select("code", "n.*"))
    tree = cut(index(nodes, block_patterns(most + 2, most)))
    found = components(links(tree, most))
    named = nodes.join(found, "id", "left").select("code", F.coalesce("component_id", "id").alias("component_id"))
    return prints.select("id", "code").join(named, "code", "left").select(F.col("id").alias(id_col), "code", "component_id")


def similar(ids: np.ndarray, sets: list[np.ndarray], least: float) -> tuple[np.ndarray, np.ndarray]:
    """Stars over the components of ``sets`` (each of distinct values, none empty) by links of a Jaccard
    similarity of at least ``least``: every set that is reached is held against all that are not."""
    size = np.array([len(x) for x in sets])
    flat, token = np.unique(np.concatenate(sets), return_inverse=True)
    start = np.r_[0, np.cumsum(size)]
    rest, rest_token = np.arange(len(sets)), token
    src, dst = [], []

    def leave(go: np.ndarray) -> None:
        nonlocal rest, rest_token
        rest_token = rest_token[np.repeat(~go, size[rest])]
        rest = rest[~go]

    while len(rest) > 1:
        seed = int(rest[0])
        leave(np.arange(len(rest)) == 0)
        queue = [seed]
        while queue and len(rest):
            x = queue.pop()
            held = np.zeros(len(flat), np.int64)
            held[token[start[x] : start[x + 1]]] = 1
            both = np.add.reduceat(held[rest_token], np.r_[0, np.cumsum(size[rest])[:-1]])
            hit = both / (size[x] + size[rest] - both) >= least
            if hit.any():
                queue += rest[hit].tolist()
                src.append(ids[rest[hit]])
                dst.append(np.full(int(hit.sum()), ids[seed]))
                leave(hit)
    none = np.empty(0, np.int64)
    return np.concatenate([none, *src]), np.concatenate([none, *dst])


def proposed(nodes: DataFrame, most: int) -> DataFrame:
    """(src, dst): stars over ``nodes`` (code, id and more) whose fingerprints differ in at most ``most`` bits; equal ones
    meet first, under their least id."""
    none = F.lit(0).cast("long")
    firsts = cut(nodes.groupBy("code").agg(F.min("id").alias("id")).select("code", none.alias("s1"), none.alias("s2"), "id"))
    equal = nodes.join(firsts.select("code", F.col("id").alias("dst")), "code").filter("id <> dst").select(F.col("id").alias("src"), "dst")
    return equal.unionByName(links(cut(index(firsts, block_patterns(most + 2, most))), most, most_sent=MOST_SENT))


def copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, least: float = 0.8, most: int = 4) -> DataFrame:
    """Per row of ``docs``: its id and ``component_id``, the least id reached by links of texts whose sets
    of ``shingle``-word shingles have a Jaccard similarity of at least ``least``.

    Equal sets meet in one node.  The index of fingerprints proposes the pairs of at most ``most`` differing bits, bands of
    MinHashes and sketches those beyond; their components are the clusters within which every link is verified.  Ids and odd texts as in ``near_duplicates``."""
    from .minhash import confirmed, members  # which builds on this module

    prints = cut(shingle_sets(docs, id_col, text_col, shingle))
    nodes = cut(prints.filter("id is not null").groupBy("key", "more").agg(F.min(F.struct("id", "code", "rank", "s1", "s2", "bands")).alias("n")).select("key", "more", "n.*"))
    alike_ = proposed(nodes.filter("bands is not null").select("code", "id"), most)
    tree = cut(tree_of(nodes.filter("bands is not null").select(F.explode("bands").alias("bucket"), "rank", "s1", "s2", "id")))
    # the sketch's first word stands for the fingerprint: its differing bits are among the sketch's
    near_ = components(alike_.unionByName(links(tree, APART, APART, MOST_SENT)), rows_a_task=EDGES)
    clusters = cut(near_.unionByName(near_.select(F.col("component_id").alias("id"), "component_id")).distinct())
    found = components(confirmed(cut(members(docs, clusters, id_col, text_col, shingle)), least, BLOCK), rows_a_task=EDGES)
    named = nodes.join(found, "id", "left").select("key", "more", F.coalesce("component_id", "id").alias("component_id"))
    return prints.select("id", "key", "more").join(named, ["key", "more"], "left").select(F.col("id").alias(id_col), "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **more: object) -> DataFrame:
    """``docs`` with one document of each group of ``copies``, that of the least id.

    Rows without an id stay, as nothing can name them; of rows with the same id one stays."""
    refuse_reserved(docs)
    found = copies(docs, id_col, text_col, **more)
    by_id = cut(found.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.count_if(F.col(id_col) == F.col("component_id")).alias("n")))
    kept = without(docs, by_id.filter("n = 0").select("id"), id_col)
    if by_id.filter("n > 1").limit(1).count():
        kept = kept.filter(F.col(id_col).isNotNull()).dropDuplicates([id_col]).unionByName(docs.filter(F.col(id_col).isNull()))
    return kept


def hex_code(code: Column) -> Column:
    """16 lower-case hexadecimal digits."""
    return F.lpad(F.lower(F.hex(code)), 16, "0")
