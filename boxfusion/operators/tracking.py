"""Offline tracking over the frames of a scene, and what follows from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boxfusion.functions.geometry import clip, iou
from boxfusion.operators.state import cut
from boxfusion.schemas import TRACK_GATES, lookup

DEFAULT_GATE = 4.0


def scene_frames(samples: DataFrame, scenes: DataFrame, tokens: DataFrame | None = None) -> DataFrame:
    """(scene_token, sample_token, frame_idx): each scene's samples from its first along ``next``, those
    of ``tokens`` only, numbered among these; scenes of which none is left drop out.

    samples: token, next, scene_token; scenes: token, first_sample_token.  A pointer chase doubles its stride in
    each round, so long scenes take a logarithm of rounds."""
    step = samples.select(F.col("token").alias("sample_token"), F.when(F.col("next") != "", F.col("next")).alias("jump"))
    step = cut(step.withColumn("behind", F.col("jump").isNotNull().cast("long")))  # how many samples follow
    while step.filter("jump is not null").limit(1).count():
        far = step.select(F.col("sample_token").alias("jump"), F.col("jump").alias("far"), F.col("behind").alias("more"))
        step = cut(step.join(far, "jump", "left").select("sample_token", F.col("far").alias("jump"), (F.col("behind") + F.coalesce("more", F.lit(0))).alias("behind")))
    named = samples.select(F.col("token").alias("sample_token"), "scene_token").join(scenes.select(F.col("token").alias("scene_token"), "first_sample_token"), "scene_token")
    first = step.select(F.col("sample_token").alias("first_sample_token"), F.col("behind").alias("most"))
    chain = step.join(named, "sample_token").join(first, "first_sample_token").filter(F.col("behind") <= F.col("most"))
    if tokens is not None:
        chain = chain.join(tokens.select("sample_token").distinct(), "sample_token", "left_semi")
    w = Window.partitionBy("scene_token").orderBy(F.col("behind").desc())
    return chain.select("scene_token", "sample_token", (F.row_number().over(w) - 1).cast("int").alias("frame_idx"))


def greedy_pairs(tracks: list[tuple[float, float]], found: list[tuple[float, float]], gate: float) -> list[tuple[int, int]]:
    """Pairs within ``gate`` by rising distance, each end once; equals by place of track, then of box."""
    reach = sorted((((tx - x) ** 2 + (ty - y) ** 2) ** 0.5, t, d) for t, (tx, ty) in enumerate(tracks) for d, (x, y) in enumerate(found))
    out, used_t, used_d = [], set(), set()
    for dist, t, d in reach:
        if dist <= gate and t not in used_t and d not in used_d:
            used_t.add(t)
            used_d.add(d)
            out.append((t, d))
    return out


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is evaluated once however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def nearest_first(pairs: Column) -> Column:
    """(t, d), the ends that are taken from sorted ``pairs`` of t and d, each end once."""
    zero = F.struct(F.array().cast("array<int>").alias("t"), F.array().cast("array<int>").alias("d"))

    def take(acc: Column, p: Column) -> Column:
        taken = F.array_contains(acc["t"], p["t"]) | F.array_contains(acc["d"], p["d"])
        return F.when(taken, acc).otherwise(F.struct(F.concat(acc["t"], F.array(p["t"])).alias("t"), F.concat(acc["d"], F.array(p["d"])).alias("d")))

    return F.aggregate(pairs, zero, take)


def track(boxes: DataFrame, scene: str = "scene_token", frame: str = "frame_idx", class_col: str = "class_name", order: tuple[str, ...] = ("expert_ord", "box_pos"), gate: float | dict[str, float] | None = None, max_misses: int = 1) -> DataFrame:
    """``boxes`` with track_id, unique within scene and class, and hit_count, the track's boxes.

    Each frame's boxes go to the nearest open track of their class by its last seen place, within the
    class's gate; a track ends when it misses more than ``max_misses`` frames, with boxes or without.  A scene's boxes
    of one class, some forty frames, are folded frame by frame with the open tracks as state, in the JVM."""
    reach = F.lit(gate) if isinstance(gate, int | float) else lookup(TRACK_GATES if gate is None else gate, F.col(class_col).cast("string"), DEFAULT_GATE)
    item = F.struct(frame, *order, "x", "y", F.struct("*").alias("row"))
    grouped = boxes.groupBy(scene, class_col).agg(F.sort_array(F.collect_list(item)).alias("items")).withColumn("gate", reach.cast("double"))
    kind = dict(boxes.dtypes)[frame]
    zero = F.struct(F.array().cast(f"array<struct<id:bigint,x:double,y:double,seen:{kind}>>").alias("open"), F.lit(0).cast("bigint").alias("fresh"), F.array().cast("array<bigint>").alias("ids"))

    def step(acc: Column, now: Column) -> Column:
        def at(k: Column, track_id: Column, found: Column) -> Column:
            d = F.get(found, k)
            return F.struct(track_id.cast("bigint").alias("id"), d["x"].cast("double").alias("x"), d["y"].cast("double").alias("y"), now.alias("seen"))

        def matched(found: Column, active: Column) -> Column:
            def apart(t: Column, ti: Column) -> Column:
                dist = lambda d: F.sqrt((d["x"] - t["x"]) * (d["x"] - t["x"]) + (d["y"] - t["y"]) * (d["y"] - t["y"]))
                return F.transform(found, lambda d, di: F.struct(dist(d).alias("far"), ti.alias("t"), di.alias("d")))

            pairs = F.array_sort(F.filter(F.flatten(F.transform(active, apart)), lambda p: p["far"] <= F.col("gate")))
            return let(nearest_first(pairs), lambda picks: after(found, active, picks))

        def after(found: Column, active: Column, picks: Column) -> Column:
            alone = F.filter(F.transform(found, lambda d, di: di), lambda di: ~F.array_contains(picks["d"], di))
            return let(alone, lambda new: moved(found, active, picks, new))

        def moved(found: Column, active: Column, picks: Column, new: Column) -> Column:
            def id_of(d: Column, di: Column) -> Column:
                n = F.array_position(picks["d"], di)
                return F.when(n > 0, F.get(active, F.get(picks["t"], (n - 1).cast("int")))["id"]).otherwise(acc["fresh"] + F.array_position(new, di) - 1)

            def place(t: Column, ti: Column) -> Column:
                n = F.array_position(picks["t"], ti)
                return F.when(n > 0, at(F.get(picks["d"], (n - 1).cast("int")), t["id"], found)).otherwise(t)

            opened = F.transform(new, lambda di, k: at(di, acc["fresh"] + k, found))
            return F.struct(F.concat(F.transform(active, place), opened).alias("open"), (acc["fresh"] + F.size(new)).alias("fresh"), F.concat(acc["ids"], F.transform(found, id_of)).alias("ids"))

        # frames without boxes age tracks too
        active = F.filter(acc["open"], lambda t: now - t["seen"] <= max_misses + 1)
        found = F.filter("items", lambda i: i[frame] == now)
        return let(found, lambda f: let(active, lambda a: matched(f, a)))

    frames = F.array_distinct(F.transform("items", lambda i: i[frame]))
    ids = F.aggregate(frames, zero, step, lambda acc: acc["ids"])
    rows = grouped.select(F.explode(F.zip_with("items", ids, lambda i, t: F.struct(i["row"].alias("row"), t.alias("id")))).alias("z"))
    out = rows.select("z.row.*", F.col("z.id").alias("track_id"))
    return out.withColumn("hit_count", F.count("*").over(Window.partitionBy(scene, class_col, "track_id")).cast("int"))


def rescored(score: Column, hits: Column, orphan_penalty: float = 1.0, boost: float = 1.0, boost_from: int = 2) -> Column:
    return clip(F.when(hits == 1, score * orphan_penalty).when(hits >= boost_from, score * boost).otherwise(score))


def insertions(tracks: DataFrame, scene: str = "scene_token", frame: str = "frame_idx", class_col: str = "class_name", order: tuple[str, ...] = ("expert_ord", "box_pos"), discount: float = 0.5, threshold: float = 0.3, frames: DataFrame | None = None, expert: str | None = "expert") -> DataFrame:
    """Boxes for frames that a track skips, one at a time: the mean of both neighbours' places, sizes
    and velocities, all else from the earlier one, the score their lesser one times ``discount``; and ``verdict``:
    'real' where a real box of the frame and class overlaps by ``threshold``, 'inserted' where one inserted before
    does, else 'kept'.

    Each frame's insertions follow the tracks' first boxes, and see its real boxes and earlier insertions together.
    ``frames`` (scene, frame and more columns) names the frames that exist."""
    means = [c for c in ("x", "y", "z", "w", "l", "h", "vx", "vy") if c in tracks.columns]
    w = Window.partitionBy(scene, class_col, "track_id").orderBy(frame)
    first = F.min(F.struct(frame, *order)).over(Window.partitionBy(scene, class_col, "track_id"))
    nxt = F.lead(F.struct("*")).over(w)
    gaps = tracks.withColumns({"__n__": nxt, "__first__": first}).filter(F.col(f"__n__.{frame}") - F.col(frame) == 2)
    new = gaps.withColumns({**{c: (F.col(c) + F.col(f"__n__.{c}")) / 2 for c in means}, "score": clip(F.least("score", "__n__.score") * discount), "__gap__": F.col(frame), frame: (F.col(frame) + 1).cast(dict(tracks.dtypes)[frame])})
    if expert and expert in tracks.columns and dict(tracks.dtypes)[expert] == "string":
        new = new.withColumn(expert, F.concat(F.col(expert), F.lit("_track_interp")))
    keys = [scene, frame, class_col]
    if frames is not None:
        extra = [c for c in frames.columns if c not in (scene, frame)]
        new = new.drop(*extra).join(frames, [scene, frame]).select(*tracks.columns, "__first__", "__gap__")
    shape = F.struct(*[F.col(c).cast("double").alias(c) for c in "xywl"])
    item = F.struct(F.col("__first__").alias("first"), F.col("__gap__").alias("gap"), *order, shape.alias("at"), F.struct(*tracks.columns).alias("row"))
    grouped = new.drop("__n__").groupBy(*keys).agg(F.sort_array(F.collect_list(item)).alias("items"))
    real = tracks.groupBy(*keys).agg(F.collect_list(shape).alias("real"))
    met = grouped.join(real, keys, "left").withColumn("real", F.coalesce("real", F.array().cast("array<struct<x:double,y:double,w:double,l:double>>")))
    zero = F.struct(F.array().cast("array<struct<x:double,y:double,w:double,l:double>>").alias("kept"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, c: Column) -> Column:
        over = lambda those: F.exists(those, lambda k: iou(k, c["at"]) >= threshold)
        verdict = F.when(over(F.col("real")), F.lit("real")).when(over(acc["kept"]), F.lit("inserted")).otherwise(F.lit("kept"))
        note = lambda v: F.struct(F.when(v == "kept", F.concat(acc["kept"], F.array(c["at"]))).otherwise(acc["kept"]).alias("kept"), F.concat(acc["out"], F.array(v)).alias("out"))
        return let(verdict, note)

    verdicts = F.aggregate("items", zero, step, lambda acc: acc["out"])
    rows = met.select(F.explode(F.zip_with("items", verdicts, lambda i, v: F.struct(i["row"].alias("row"), v.alias("verdict")))).alias("z"))
    return rows.select("z.row.*", "z.verdict")


def interpolate(tracks: DataFrame, scene: str = "scene_token", frame: str = "frame_idx", class_col: str = "class_name", order: tuple[str, ...] = ("expert_ord", "box_pos"), discount: float = 0.5, threshold: float = 0.3, frames: DataFrame | None = None, expert: str | None = "expert") -> DataFrame:
    """The ``insertions`` that nothing stands in the way of."""
    return insertions(tracks, scene, frame, class_col, order, discount, threshold, frames, expert).filter("verdict = 'kept'").drop("verdict")


def refine(boxes: DataFrame, scene: str = "scene_token", frame: str = "frame_idx", class_col: str = "class_name", order: tuple[str, ...] = ("expert_ord", "box_pos"), orphan_penalty: float = 0.7, discount: float = 0.9, excluded: tuple[str, ...] = ("car", "bicycle"), threshold: float = 0.3, gate: float | dict[str, float] | None = None, frames: DataFrame | None = None) -> DataFrame:
    """``boxes`` with orphans' scores lowered, then boxes for skipped frames (inserted = true).
    Interpolation starts from the scores as they were; ``excluded`` classes stay as they are."""
    tracks = track(boxes, scene, frame, class_col, order, gate)
    skip = F.col(class_col).isin(*excluded) if excluded else F.lit(False)
    old = tracks.withColumn("score", F.when(skip, F.col("score")).otherwise(rescored(F.col("score"), F.col("hit_count"), orphan_penalty))).withColumn("inserted", F.lit(False))
    new = interpolate(tracks.filter(~skip), scene, frame, class_col, order, discount, threshold, frames).withColumn("inserted", F.lit(True))
    return old.unionByName(new)


def gates(class_col: str = "class_name") -> Column:
    return lookup(TRACK_GATES, F.col(class_col), DEFAULT_GATE)
