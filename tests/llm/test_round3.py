"""Filter audit, sessions and MinHash near-duplicates: brute force, crowds and odd tables."""

from __future__ import annotations

import collections
import datetime
import functools
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from boxfusion.llm import filter_audit, minhash, sessions

T0 = datetime.datetime(2024, 1, 1)
CLICKS = "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, client_id long, kind string, value double, us long, bucket long, c string"


# -- filter audit -----------------------------------------------------------------------------------


def test_lookup_table_is_first_failure():
    table = filter_audit.lookup_table()
    assert table.shape == (32, 120) and len(set(filter_audit.ORDERS)) == 120
    for mask, (k, order) in itertools.product(range(32), enumerate(filter_audit.ORDERS)):
        failed = [i + 1 for i, f in enumerate(order) if mask >> "ABCDE".index(f) & 1]
        assert table[mask, k] == (failed[0] if failed else 0)


def plain_failures(text: str) -> str:
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    tests = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), "D": bool(re.search(r"[#$%&*|]", text))}
    return "".join(k for k, v in tests.items() if v)


def plain_audit(docs: list[tuple], labels: list[tuple]) -> dict[tuple, tuple]:
    rows = []
    for i, text, lang in docs:
        text = text or ""
        again = i is not None and any(j is not None and j < i and (u or "") == text for j, u, _ in docs)
        tags = [(q, t) for j, q, t in labels if j is not None and j == i]
        rows.append((lang or "", plain_failures(text) + ("E" if again else ""), any(q == 1 for q, _ in tags), any(t == 1 for _, t in tags)))
    out = {}
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        shapley: collections.Counter = collections.Counter()
        for order in filter_audit.ORDERS:
            left = mine
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                fails = sum(f in r[1] for r in mine)
                shapley[f] += len(gone)
                out[part, order, step] = (len(left), len(gone), fails - len(gone), sum(r[1] == f for r in mine), sum(r[2] for r in gone), sum(r[3] for r in gone))
        for order, step in itertools.product(filter_audit.ORDERS, range(1, 6)):
            out[part, order, step] += (shapley[order[step - 1]],)
    return out


def test_audit_of_odd_tables_equals_brute_force(spark):
    r = random.Random(2)
    word = lambda: r.choice(["a", "B", "ça", "c%", "日本", "word", f"w{r.random()}"])
    texts = [None, "", " \t\n", "x" * 70_000, "A B C " * 90, *(" ".join(word() for _ in range(r.choice([3, 150, 199, 200, 260]))) for _ in range(12)), " ".join(f"w{k}" for k in range(250))]
    docs = [(k // 2 if k % 7 else None, r.choice(texts), r.choice(["en", "de", None, ""])) for k in range(120)]
    labels = [(k, r.choice([None, 0, 1]), r.choice([None, 0, 1])) for k in [*range(0, 60, 2), 4, 4, 8]] + [(None, 1, 1)]
    table = spark.createDataFrame([(*d, 7, "x", 1, True) for d in docs], "doc_id long, text string, lang string, mask int, part string, first long, good boolean")
    tags = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = filter_audit.audit(filter_audit.judged(table.repartition(5), tags)).collect()
    assert {(x[0], x[1], x[2]): tuple(x[3:]) for x in found} == plain_audit(docs, labels)
    assert filter_audit.audit(filter_audit.judged(table.limit(0), tags.limit(0))).count() == 0


def test_audit_of_many_parts(spark, monkeypatch):
    """More parts than a task holds."""
    rows = spark.range(3000).selectExpr("cast(id % 300 as string) part", "cast(id % 32 as int) mask", "id % 3 = 0 good", "id % 5 = 0 toxic")
    found = filter_audit.audit(rows.repartition(3))
    assert found.count() == 300 * 600
    assert {tuple(r) for r in found.groupBy("part").agg(F.count_if(F.col("removed") < 0).alias("n"), F.max(F.col("kept") + F.col("removed")).alias("m")).select("n", "m").distinct().collect()} == {(0, 10)}


# -- sessions ---------------------------------------------------------------------------------------


def micro(t: datetime.datetime) -> int:
    d = t - datetime.datetime(1970, 1, 1)
    return (d.days * 86400 + d.seconds) * 1_000_000 + d.microseconds


def plain_sessions(rows: list[tuple]) -> set[tuple]:
    once = {}
    for i, ts, arrived, client, kind, value, *_ in rows:
        if None in (i, ts, client):
            continue
        v = value if value is not None and abs(value) < float("inf") else None
        late = arrived is not None and micro(arrived) - micro(ts) > 3_600_000_000
        row = (micro(ts), client, late, kind == "purchase" and v is not None and v >= 60, 0 if v is None else int(np.floor(100 * v + 0.5)), i)
        once[i] = min(once.get(i, row), row)
    out = set()
    for client in {r[1] for r in once.values()}:
        mine = sorted((r[0], r[5], r[2], r[3], r[4]) for r in once.values() if r[1] == client)
        timely, found = [r for r in mine if not r[2]], []
        for k, r in enumerate(timely):
            p = timely[k - 1] if k else None
            why = None if p is None else "end" if p[3] else "gap" if r[0] - p[0] >= 300_000_000 else "length" if r[0] - found[-1]["c"][0][0] > 7_200_000_000 else None
            if p is None or why:
                if found:
                    found[-1]["why"] = why
                found.append({"c": [], "why": None, "late": 0})
            found[-1]["c"].append(r)
        for r in mine:
            if r[2] and (of := [s for s in found if s["c"][0][0] <= r[0]]):
                of[-1]["late"] += 1
        for s in found:
            c = s["c"]
            out.add((client, c[0][1], c[0][0], c[-1][0], len(c), s["late"], sum(x[4] for x in c), s["why"] or ("end" if c[-1][3] else "none"), ",".join(str(x[1]) for x in c)))
    return out


def found_sessions(df) -> set[tuple]:
    rows = sessions.sessions(df).withColumn("path", sessions.joined_path(F.col("path"))).collect()
    out = {tuple(r) for r in rows}
    assert len(out) == len(rows)
    return out


def crowd(seed: int, clients: int, n: int, dense: float) -> list[tuple]:
    r, rows = random.Random(seed), []
    for client, t in itertools.product(range(clients), [0]):
        for _ in range(n):
            t += r.choice([0, 0, 30, 60, 100, 200, 290, 299]) if r.random() < dense else r.choice([300, 301, 4000, 90000])
            late = r.random() < 0.05
            at = T0 + datetime.timedelta(seconds=t, microseconds=r.choice([0, 0, 1, 999999]))
            rows.append((len(rows), at, at + datetime.timedelta(seconds=4000 if late else 1), client, "purchase" if r.random() < 0.005 else "click", r.choice([None, 1.005, 70.0, -3.2]) if client else 1.0, 1, 2, "x"))
    return rows


@pytest.mark.parametrize(("segment", "fan", "dense"), [(4, 32, 0.97), (1, 2, 0.9995), (1, 3, 1.0)])
def test_sessions_equal_brute_force(spark, monkeypatch, segment, fan, dense):
    """Islands of days, of which one or two hours make a segment, are cut as if clicks were read in order."""
    monkeypatch.setattr(sessions, "greedy", functools.partial(sessions.greedy, segment=segment, fan=fan))
    rows = crowd(5, 3, 1500, dense)
    assert found_sessions(spark.createDataFrame(rows, CLICKS).repartition(7)) == plain_sessions(rows)


def test_sessions_of_odd_tables(spark):
    t = lambda m, us=0: T0 + datetime.timedelta(minutes=m, microseconds=us)
    nan, inf = float("nan"), float("inf")
    clicks = [
        (1, t(0), t(0), 1, "click", nan), (1, t(0), t(0), 1, "click", nan), (2, t(0), None, 1, None, inf), (3, t(4, 59_999_999), t(5), 1, "purchase", nan), (4, t(9, 59_999_999), t(70, 0), 1, "purchase", 60.0),
        (5, t(9, 59_999_999), t(10), 1, "click", 1.005), (6, t(5), t(66), 1, "click", 9.0), (7, t(500), t(561), 1, "click", 9.0), (8, t(-90), t(9), 1, "x", 1.0), (None, t(1), t(1), 1, "x", 1.0), (9, None, t(1), 1, "x", 1.0),
        (10, t(1), t(1), None, "x", 1.0), (11, t(3), t(3), 2, "purchase", 61.0), (11, t(2), t(2), 2, "click", 61.0), (12, t(0), t(90), 3, "x", 1.0), (13, datetime.datetime(1969, 12, 31, 23, 59, 59, 5), None, 4, "purchase", 1e300),
    ]
    rows = [(*c, 1, 2, "x") for c in clicks]
    assert found_sessions(spark.createDataFrame(rows, CLICKS).repartition(3)) == {r if r[0] != 4 else (*r[:6], 0, *r[7:]) for r in plain_sessions(rows)}
    assert sessions.sessions(spark.createDataFrame([], CLICKS)).count() == 0
    with pytest.raises(ValueError, match="click_id"):
        sessions.sessions(spark.createDataFrame([], CLICKS.replace("click_id long", "click_id string")))


def test_edges_of_session_length(spark):
    """Exactly 120 minutes go on, a microsecond more does not; exactly 5 minutes part."""
    at = [*range(0, 7201, 240), 7200.000001, 7200.000002]
    rows = [(k, T0 + datetime.timedelta(seconds=s), T0 + datetime.timedelta(seconds=s), 1, "click", 1.0, 1, 2, "x") for k, s in enumerate(at)]
    found = sorted(found_sessions(spark.createDataFrame(rows, CLICKS)), key=lambda r: r[2])
    assert [(r[4], r[7]) for r in found] == [(31, "length"), (2, "none")]
    rows = [(k, T0 + datetime.timedelta(seconds=300 * k), None, 1, "click", 1.0, 1, 2, "x") for k in range(3)]
    assert [r[7] for r in sorted(found_sessions(spark.createDataFrame(rows, CLICKS)), key=lambda r: r[2])] == ["gap", "gap", "none"]


# -- MinHash near-duplicates ------------------------------------------------------------------------


def plain_components(docs: list[tuple]) -> dict[int, int]:
    sets = {}
    for i, t in docs:
        w = [x.lower() for x in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
        sets.setdefault(i, []).append(frozenset(" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset())
    low = {i: i for i in sets}
    pairs = [(a, b) for a, b in itertools.combinations(sets, 2) if any(x and y and 100 * len(x & y) >= 85 * len(x | y) for x in sets[a] for y in sets[b])]
    while any(low[a] != low[b] for a, b in pairs):
        for a, b in pairs:
            low[a] = low[b] = min(low[a], low[b])
    return low


def near_copies(seed: int, families: int, each: int) -> list[tuple]:
    r, out = random.Random(seed), []
    for f in range(families):
        base = [f"w{r.randrange(400)}" for _ in range(r.choice([60, 120, 200]))]
        for _ in range(each):
            w = list(base)
            for _ in range(r.randrange(6)):
                w[r.randrange(len(w))] = f"new{r.randrange(10**6)}"
            out.append((len(out) * 7 % 100_003, " ".join(w)))
    return out


@pytest.mark.parametrize("block", [512, 7])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, block):
    """Families around the threshold; small blocks make every cluster many."""
    monkeypatch.setattr(minhash, "BLOCK", block)
    docs = near_copies(3, 6, 40)
    found = minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(5)).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == plain_components(docs)


def test_edge_of_similarity(spark):
    """17 shingles of 20 are enough, 16 of 19 are not."""
    a = [f"a{k}" for k in range(21)]
    docs = [(1, " ".join(a)), (2, " ".join([*a[:21], "b1", "b2", "b3"]))]
    docs += [(11, " ".join(f"c{k}" for k in range(20))), (12, " ".join([*(f"c{k}" for k in range(20)), "d1", "d2", "d3"]))]
    found = {r["doc_id"]: (r["component_id"], r["n_shingles"]) for r in minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert found == {1: (1, 17), 2: (1, 20), 11: (11, 16), 12: (12, 19)}


def test_near_duplicates_of_odd_tables(spark):
    long_ = " ".join(f"w{k % 5000}" for k in range(60_000))
    docs = [(5, None), (6, ""), (7, " \t\n"), (8, "one two"), (3, "ONE\ttwo"), (9, "one two three"), (10, long_), (2, long_ + " end"), (2, long_ + " end"), (None, "one two"), (None, "alone"), (None, None), (12, "é日 x")]
    table = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in docs], "doc_id long, text string, key string, id long, n_shingles int")
    found = collections.Counter(tuple(r) for r in minhash.near_duplicates(table).collect())
    assert found == collections.Counter([(5, 0, 5), (6, 0, 6), (7, 0, 7), (8, 1, 3), (3, 1, 3), (9, 1, 9), (10, 5000, 2), (2, 5001, 2), (2, 5001, 2), (None, 1, 3), (None, 1, None), (None, 0, None), (12, 1, 12)])
    assert minhash.near_duplicates(table.limit(0)).count() == 0
    with pytest.raises(ValueError, match="doc_id"):
        minhash.near_duplicates(table.withColumn("doc_id", F.lit("x")))


def test_signatures_agree_by_similarity():
    r = np.random.default_rng(1)
    pool = r.integers(0, 1 << 63, 3000, np.uint64)
    for share in (0.5, 0.85, 0.95):
        a, b = pool[:1000], np.r_[pool[: round(2000 * share / (1 + share))], pool[2000 : 3000 - round(2000 * share / (1 + share))]]
        same = (minhash.minima(a) == minhash.minima(b)).mean()
        assert abs(same - share) < 0.13
        apart = np.bitwise_count(minhash.signature(minhash.minima(a)) ^ minhash.signature(minhash.minima(b))).sum()
        assert abs(apart - 64 * (1 - share)) < 18
