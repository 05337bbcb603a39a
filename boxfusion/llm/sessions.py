"""Sessions of clicks: hard islands by windows, overlong islands by greedy cutting, every group bounded.

A client may hold a third of all clicks, so no window spans a client's clicks.  Windows run over one client's clicks of
one hour (``BUCKET_US``) and leave *pieces*, runs of clicks without a hard break; then windows over a client's hours, of
which there are as many as the table's span of time has, tell which pieces continue one another.  Pieces that stand
alone are sessions; pieces that continue are merged by island; only islands longer than a session may be are cut
greedily, in Arrow, one segment of a few session lengths to a group.

Where a cut falls depends on all cuts before it.  A segment's effect is a monotone step function from the last session
start before it to the last one in it; functions are composed as a tree of ``FAN``, and the starts are handed down it, so
that an island of any length is cut exactly and no task sees more than ``FAN`` functions.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .common import arrow_rows, cut

MINUTE = 60_000_000
#: One client's clicks of so many microseconds meet in one window.
BUCKET_US = 60 * MINUTE
#: A segment is so many longest sessions, in whole hours; so many functions are composed at a time.
SEGMENT, FAN = 4, 32
NEVER = -(1 << 62)
KEYS = ("client", "island_us", "island_id")


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of the date and time that ``ts`` shows, whatever the session's zone is."""
    seconds = (F.date_part(F.lit("SECOND"), ts) * 1_000_000).cast("long")
    return F.unix_date(ts.cast("date")).cast("long") * (1440 * MINUTE) + F.hour(ts).cast("long") * (60 * MINUTE) + F.minute(ts).cast("long") * MINUTE + seconds


def cents(value: Column) -> Column:
    """Whole cents of ``value``, half up; 0 where it is null, NaN, infinite or beyond a long."""
    return F.when(F.abs(value) < 9e16, F.floor(100 * value + 0.5)).otherwise(F.lit(0)).cast("long")


def pieces(rows: DataFrame, gap_us: int) -> DataFrame:
    """(client, bucket, run, runs, us, ids, cents, late, first_us, first_id, last_us, last_final): runs of one client's
    clicks of one hour without a hard break.  late: the times of late clicks from the run's first click on; run 0 has those before
    the hour's first click and no clicks.

    rows: client, click_id, us, late, final, cents."""
    rows = rows.withColumn("bucket", F.floor(F.col("us") / BUCKET_US))
    hour = Window.partitionBy("client", "bucket").orderBy("us", "late", "click_id")
    before = F.last(F.when(~F.col("late"), F.struct("us", "final")), ignorenulls=True).over(hour.rowsBetween(Window.unboundedPreceding, -1))
    begins = ~F.col("late") & (F.col("b").isNull() | F.col("b.final") | (F.col("us") - F.col("b.us") >= gap_us))
    runs = rows.withColumn("b", before).withColumn("begins", F.coalesce(begins, F.lit(False)).cast("int"))
    runs = runs.withColumn("run", F.sum("begins").over(hour.rowsBetween(Window.unboundedPreceding, 0)))
    click = F.when(~F.col("late"), F.struct("us", "click_id", "cents", "final"))
    found = runs.groupBy("client", "bucket", "run").agg(F.sort_array(F.collect_list(click)).alias("c"), F.collect_list(F.when(F.col("late"), F.col("us"))).alias("late"))
    last = F.try_element_at("c", F.lit(-1))
    return found.select(
        "client", "bucket", "run", F.col("c.us").alias("us"), F.col("c.click_id").alias("ids"), F.col("c.cents").alias("cents"), "late",
        F.get("c", F.lit(0))["us"].alias("first_us"), F.get("c", F.lit(0))["click_id"].alias("first_id"), last["us"].alias("last_us"), last["final"].alias("last_final"),
    )


def placed(found: DataFrame, gap_us: int) -> DataFrame:
    """``found`` (pieces) with island_us and island_id (the first click of the piece's island), end_us (the island's last
    click), closing (why the island ends, where the piece ends it) and whole (no other piece belongs to it).

    Late clicks before an hour's first click go to the island before them; before any, they drop out."""
    hours = found.groupBy("client", "bucket").agg(
        F.min(F.when(F.col("run") > 0, F.struct("run", "first_us", "last_us"))).alias("head"),
        F.max(F.when(F.col("run") > 0, F.struct("run", "first_us", "first_id", "last_us", "last_final"))).alias("tail"),
        F.max("run").alias("runs"), F.min("run").alias("least"),
    )
    by = Window.partitionBy("client").orderBy("bucket")
    back, on = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(1, Window.unboundedFollowing)
    hours = hours.withColumn("before", F.last("tail", ignorenulls=True).over(back))
    joined = F.coalesce(~F.col("before.last_final") & (F.col("head.first_us") - F.col("before.last_us") < gap_us), F.lit(False))
    hours = hours.withColumn("joined", joined)
    hours = hours.withColumns({"next_joined": F.lead("joined", 1, False).over(by), "next_early": F.coalesce(F.lead("least").over(by) == 0, F.lit(False))})
    opened = F.when((F.col("runs") > 1) | ((F.col("runs") == 1) & ~F.col("joined")), F.struct("tail.first_us", "tail.first_id"))
    closes = F.when((F.col("runs") > 1) | ((F.col("runs") == 1) & ~F.col("next_joined")), F.col("head.last_us"))
    hours = hours.select(
        F.col("client").alias("c"), F.col("bucket").alias("h"), "runs", "joined", "next_joined", "next_early", F.col("before.last_us").alias("before_us"), F.col("head.last_us").alias("head_us"),
        F.last(opened, ignorenulls=True).over(back).alias("carried"), F.first(closes, ignorenulls=True).over(on).alias("carried_end"),
        (F.max(F.when(F.col("runs") > 0, F.col("bucket"))).over(Window.partitionBy("client")) > F.col("bucket")).alias("more"),
    )
    met = found.join(hours, (F.col("client") == F.col("c")) & (F.col("bucket") == F.col("h")))
    run, last = F.col("run"), F.col("run") == F.col("runs")
    follows = (run == 0) | ((run == 1) & F.col("joined"))
    island = F.when(follows, F.col("carried")).otherwise(F.struct("first_us", "first_id"))
    head_end = F.when((F.col("runs") == 1) & F.col("next_joined"), F.col("carried_end")).otherwise(F.col("head_us"))
    end = F.when(run == 0, F.when(F.col("joined"), head_end).otherwise(F.col("before_us"))).when(last & F.col("next_joined"), F.col("carried_end")).otherwise(F.col("last_us"))
    met = met.withColumns({"island": island, "end_us": end}).filter("island is not null")
    closing = F.when((run > 0) & (F.col("last_us") == F.col("end_us")), F.when(F.col("last_final"), F.lit("end")).when(~last | F.col("more"), F.lit("gap")).otherwise(F.lit("none")))
    whole = ~follows & ~(last & (F.col("next_joined") | F.col("next_early")))
    return met.select(*found.columns, F.col("island.first_us").alias("island_us"), F.col("island.first_id").alias("island_id"), "end_us", closing.alias("closing"), whole.alias("whole"))


# -- overlong islands -------------------------------------------------------------------------------


def step(at: np.ndarray, out: np.ndarray, x: np.ndarray, longest: int) -> np.ndarray:
    """The last session start after a segment, for each last start ``x`` before it: that of the first click beyond
    ``x + longest``, or ``x`` itself if there is none."""
    k = np.searchsorted(at, x + longest, side="right")
    return np.where(k < len(at), np.append(out, 0)[k], x)


def step_function(us: np.ndarray, begin: int, longest: int) -> tuple[np.ndarray, np.ndarray, bool]:
    """The function of a segment of sorted ``us`` that begins at ``begin``, as (at, out), and whether a start before the
    segment may be the last one still after it."""
    to = np.searchsorted(us, us + longest, side="right")
    out = us.copy()
    for k in range(len(us) - 1, -1, -1):
        if to[k] < len(us):
            out[k] = out[to[k]]
    n = np.searchsorted(us, max(begin, int(us[0])) + longest, side="right") + 1  # later clicks are no one's first
    at, out = us[:n], out[:n]
    keep = np.r_[out[1:] != out[:-1], True]
    return at[keep], out[keep], bool(us[-1] <= begin + longest)


def composed(first: tuple, then: tuple, longest: int) -> tuple:
    at, out, open_ = first
    out = step(then[0], then[1], out, longest)
    if open_:  # starts that pass the first one by meet the second one's clicks
        at, out = np.r_[at, then[0]], np.r_[out, then[1]]
    keep = np.r_[out[1:] != out[:-1], True] if len(out) else np.empty(0, bool)
    return at[keep], out[keep], open_ and then[2]


def _values(column: pa.ChunkedArray) -> np.ndarray:
    """All values of a column of lists, one after another."""
    return np.concatenate([np.empty(0, np.int64), *(np.asarray(c.flatten(), np.int64) for c in column.chunks)])


def greedy(over: DataFrame, longest: int, segment: int = SEGMENT, fan: int = FAN) -> DataFrame:
    """``over`` (pieces of overlong islands) cut into sessions: (KEYS, start_us, first_us, us, ids, cents, late, closing), a
    row for each session and segment; start_us is unique within the island."""
    width = segment * longest
    width += -width % BUCKET_US
    place = lambda us: F.floor(us / width)
    # late clicks count where the island still has clicks
    at = place(F.least(F.col("bucket") * BUCKET_US, F.col("end_us"))) - place(F.col("island_us"))
    over = over.withColumns({"node": at, "nodes": place(F.col("end_us")) - place(F.col("island_us")) + 1})
    over = over.withColumn("begin", (F.col("node") + place(F.col("island_us"))) * width)
    key_fields = [over.schema[k] for k in KEYS]
    arrow_rows(over.sparkSession)

    def fields(*more: str) -> StructType:
        return StructType([*(StructField(f.name, f.dataType) for f in key_fields), *StructType.fromDDL(", ".join(more))])

    def key_of(t: pa.Table) -> dict:
        return {k: t.column(k)[:1] for k in KEYS}

    def keyed(key: dict, rows: list[dict], schema: pa.Schema) -> pa.Table:
        one = {k: v[0].as_py() for k, v in key.items()}
        return pa.Table.from_pylist([one | r for r in rows], schema=schema)

    def arrow(t: pa.Table, **more: pa.DataType) -> pa.Schema:
        return pa.schema([(k, t.schema.field(k).type) for k in KEYS] + list(more.items()))

    longs = pa.list_(pa.int64())
    shape = {"node": pa.int64(), "at": longs, "out": longs, "open": pa.bool_()}

    def chart(t: pa.Table) -> pa.Table:
        us = np.sort(_values(t.column("us")))
        rows = []
        if len(us):
            at, out, open_ = step_function(us, t.column("begin")[0].as_py(), longest)
            rows = [{"node": t.column("node")[0].as_py(), "at": at, "out": out, "open": open_}]
        return keyed(key_of(t), rows, arrow(t, **shape))

    def functions_of(t: pa.Table) -> list[tuple[int, tuple]]:
        return [(r["node"], (np.array(r["at"], np.int64), np.array(r["out"], np.int64), r["open"])) for r in t.sort_by("node").select(["node", "at", "out", "open"]).to_pylist()]

    def merge(t: pa.Table) -> pa.Table:
        fs = functions_of(t)
        f = fs[0][1]
        for _, g in fs[1:]:
            f = composed(f, g, longest)
        return keyed(key_of(t), [{"node": fs[0][0] // fan, "at": f[0], "out": f[1], "open": f[2]}], arrow(t, **shape))

    def hand_down(t: pa.Table) -> pa.Table:
        x, rows = np.array([t.column("x")[0].as_py()]), []
        for node, (at, out, _) in functions_of(t):
            rows.append({"node": node, "x": int(x[0])})
            x = step(at, out, x, longest)
        return keyed(key_of(t), rows, arrow(t, node=pa.int64(), x=pa.int64()))

    func, given = fields("node long", "at array<long>", "out array<long>", "open boolean"), fields("node long", "x long")
    levels = [cut(over.filter("nodes > 1").select(*KEYS, "node", "begin", "us").groupBy(*KEYS, "node").applyInArrow(chart, func))]
    while levels[-1].filter("node > 0").limit(1).count():
        levels.append(cut(levels[-1].groupBy(*KEYS, F.floor(F.col("node") / fan).alias("up")).applyInArrow(merge, func)))
    starts = levels[-1].select(*KEYS, "node", F.lit(NEVER).cast("long").alias("x"))
    for level in levels[-2::-1]:
        met = level.withColumn("up", F.floor(F.col("node") / fan)).join(starts.withColumnRenamed("node", "up"), [*KEYS, "up"])
        starts = cut(met.groupBy(*KEYS, "up").applyInArrow(hand_down, given))
    over = over.join(starts, [*KEYS, "node"], "left").withColumn("x", F.coalesce("x", F.lit(NEVER)))

    def sessions_of(t: pa.Table) -> pa.Table:
        t = t.sort_by([("bucket", "ascending"), ("run", "ascending")])
        us, ids, money, late, x = _values(t.column("us")), _values(t.column("ids")), _values(t.column("cents")), _values(t.column("late")), t.column("x")[0].as_py()
        closing = next((c for c in reversed(t.column("closing").to_pylist()) if c), None)
        begin, k = [], 0 if x == NEVER else int(np.searchsorted(us, x + longest, side="right"))
        while k < len(us):
            begin.append(k)
            k = int(np.searchsorted(us, us[k] + longest, side="right"))
        edges = sorted({0, *begin, len(us)}) if len(us) else [0, 0]
        names = ([] if begin[:1] == [0] else [x]) + [int(us[b]) for b in begin]
        belongs = np.maximum(np.searchsorted(np.array(names), late, side="right") - 1, 0)
        rows = [
            {"start_us": names[n], "first_us": int(us[a]) if b > a else None, "us": us[a:b], "ids": ids[a:b], "cents": money[a:b], "late": late[belongs == n], "closing": closing if n == len(names) - 1 else None}
            for n, (a, b) in enumerate(zip(edges, edges[1:], strict=False))
        ]
        return keyed(key_of(t), rows, arrow(t, start_us=pa.int64(), first_us=pa.int64(), us=longs, ids=longs, cents=longs, late=longs, closing=pa.string()))

    out = fields("start_us long", "first_us long", "us array<long>", "ids array<long>", "cents array<long>", "late array<long>", "closing string")
    return over.select(*KEYS, "node", "bucket", "run", "us", "ids", "cents", "late", "closing", "x").groupBy(*KEYS, "node").applyInArrow(sessions_of, out)


# -- sessions ---------------------------------------------------------------------------------------


def sessions(
    clicks: DataFrame, client: str = "client_id", click: str = "click_id", ts: str = "ts", arrived: str = "arrived_at", value: str = "value", final: Column | None = None,
    gap_us: int = 5 * MINUTE, longest_us: int = 120 * MINUTE, late_us: int = 60 * MINUTE,
) -> DataFrame:
    """(client, session_id, start_us, end_us, n_clicks, n_late, value_cents, closed_by, path): the sessions of ``clicks``, a
    row each; path: its clicks' ids in order.

    A client's timely clicks, by time and then id, continue the session unless the one before is ``final`` (by default a
    purchase of 60 or more), or is ``gap_us`` or more earlier, or the session's first is over ``longest_us`` earlier.
    Clicks that arrive over ``late_us`` after their time join none; they count for the session that began last before them.

    Rows without client, id (a whole number) or time drop out; of rows of one id that of least time, then least in client and
    the other columns, is taken.  A null arrival is timely; null, NaN and infinite values are worth 0 and never final; ties in time
    go by id; other columns are not read, so their names may clash; an empty table gives no rows."""
    if dict(clicks.dtypes)[click] not in ("bigint", "int", "smallint", "tinyint"):
        raise ValueError(f"{click} must be a whole number")
    if longest_us < BUCKET_US or not 0 < gap_us < BUCKET_US:
        raise ValueError("sessions must be allowed an hour at least, and gaps be shorter than an hour")
    known = F.when(F.abs(value) < float("inf"), F.col(value))
    if final is None:
        final = (F.col("kind") == "purchase") & (known >= 60)
    at, here = micros(F.col(ts)), micros(F.col(arrived))
    rows = clicks.filter(F.col(client).isNotNull() & F.col(click).isNotNull() & F.col(ts).isNotNull())
    rows = rows.select(F.col(click).cast("long").alias("click_id"), F.struct(at.alias("us"), F.col(client).alias("client"), F.coalesce(here - at > late_us, F.lit(False)).alias("late"), F.coalesce(final, F.lit(False)).alias("final"), cents(known).alias("cents")).alias("r"))
    once = rows.groupBy("click_id").agg(F.min("r").alias("r")).select("click_id", "r.*")
    found = placed(cut(pieces(once, gap_us)), gap_us)
    long_ = F.col("end_us") - F.col("island_us") > longest_us
    parts = cut(found.filter(~F.col("whole") | long_).withColumn("long", long_))
    short = parts.filter("not long").select(*KEYS, F.col("island_us").alias("start_us"), "first_us", "us", "ids", "cents", "late", "closing")
    both = short.unionByName(greedy(parts.filter("long"), longest_us)) if parts.filter("long").limit(1).count() else short
    piece = F.struct(F.coalesce("first_us", F.lit((1 << 63) - 1)).alias("o"), "us", "ids")
    total = F.sum(F.aggregate("cents", F.lit(0).cast("long"), lambda a, x: a + x))
    merged = both.groupBy(*KEYS, "start_us").agg(F.sort_array(F.collect_list(piece)).alias("p"), total.alias("value_cents"), F.sum(F.size("late")).alias("n_late"), F.coalesce(F.max("closing"), F.lit("length")).alias("closed_by"))
    merged = merged.select("client", F.flatten("p.us").alias("us"), F.flatten("p.ids").alias("ids"), "value_cents", "n_late", "closed_by")
    alone = found.filter(F.col("whole") & ~long_).select("client", "us", "ids", F.aggregate("cents", F.lit(0).cast("long"), lambda a, x: a + x).alias("value_cents"), F.size("late").cast("long").alias("n_late"), F.col("closing").alias("closed_by"))
    return alone.unionByName(merged).select(
        F.col("client").alias(client), F.get("ids", F.lit(0)).alias("session_id"), F.get("us", F.lit(0)).alias("start_us"), F.element_at("us", -1).alias("end_us"),
        F.size("ids").cast("long").alias("n_clicks"), "n_late", "value_cents", "closed_by", F.col("ids").alias("path"),
    )


def joined_path(path: Column) -> Column:
    return F.array_join(F.transform(path, lambda i: i.cast("string")), ",")
