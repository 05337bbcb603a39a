"""Submissions of detectors: one JSON object of tokens and their boxes, checked and flattened."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from boxfusion.functions.geometry import yaw
from boxfusion.schemas import CLASS_IDS, COORDINATE_FRAMES, SUBMISSION, UNKNOWN_CLASS, canonical_class, lookup

REQUIRED = ("sample_token", "translation", "size", "rotation", "velocity", "detection_name", "detection_score")


def missing_field(row: Column | None = None) -> Column:
    """The first required field that is null."""
    at = (lambda n: F.col(n)) if row is None else (lambda n: row[n])
    out = None
    for n in REQUIRED:
        why = F.lit(f"missing {n}")
        out = F.when(at(n).isNull(), why) if out is None else out.when(at(n).isNull(), why)
    return out


def problem() -> Column:
    """Why a row with the columns of a submitted box, expert and coord_frame is no box; null if it is."""
    score, size = F.col("detection_score"), F.col("size")

    def length(name: str, n: int) -> Column:
        return F.coalesce(F.size(name) != n, F.lit(True))

    return (
        F.when(F.coalesce(F.col("sample_token"), F.lit("")) == "", "empty token")
        .when(F.coalesce(F.col("expert"), F.lit("")) == "", "empty expert")
        .when(~F.coalesce(F.col("coord_frame").isin(*COORDINATE_FRAMES), F.lit(False)), "unknown frame")
        .when(length("translation", 3), "translation")
        .when(length("size", 3), "size")
        .when(length("rotation", 4), "rotation")
        .when(length("velocity", 2), "velocity")
        .when(~F.coalesce(F.forall(size, lambda v: v > 0), F.lit(False)), "size")
        .when(score.isNull() | F.isnan(score) | ~score.between(0, 1), "score")
        .when(canonical_class(F.col("detection_name")).isNull(), "unknown class")
    )


def read_submission(spark: SparkSession, path: str, expert: str, expert_ord: int = 0, frame: str = "global", score_threshold: float = 0.0, tokens: DataFrame | None = None, strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """(boxes, frames) of a submission; frames holds every token, also those without a box.

    The token of the map counts, not the box's own.  Required fields are checked before scores are.
    ``tokens`` (sample_token) keeps those tokens only.  strict: a flawed box fails the query; else
    it drops out, and ``read_flawed`` tells why."""
    rows = _exploded(spark, path, tokens)
    frames = rows.select("sample_token").distinct()
    boxes = _with_problem(rows.filter("b is not null"), expert, frame)
    if strict:
        boxes = boxes.filter(F.when(F.col("missing").isNotNull(), F.raise_error(F.concat_ws(" ", F.lit(path), "token", "missing"))).otherwise(F.lit(True)))
        boxes = boxes.filter(F.col("detection_score") >= score_threshold)
        boxes = boxes.filter(F.when(F.col("problem").isNotNull(), F.raise_error(F.concat_ws(" ", F.lit(path), "token", "problem"))).otherwise(F.lit(True)))
    else:
        boxes = boxes.filter("missing is null and problem is null").filter(F.col("detection_score") >= score_threshold)
    return flatten(boxes.withColumn("expert_ord", F.lit(expert_ord))), frames


def read_flawed(spark: SparkSession, path: str, expert: str, frame: str = "global") -> DataFrame:
    """(sample_token, box_pos, problem) of flawed boxes."""
    rows = _with_problem(_exploded(spark, path, None).filter("b is not null"), expert, frame)
    return rows.select("sample_token", "box_pos", F.coalesce("missing", "problem").alias("problem")).filter("problem is not null")


def _exploded(spark: SparkSession, path: str, tokens: DataFrame | None) -> DataFrame:
    raw = spark.read.schema(SUBMISSION).option("multiLine", True).option("mode", "FAILFAST").json(path)
    # within explode, as a filter before it would give way to the not-null check that explode implies
    rows = raw.select(F.explode(F.coalesce("results", F.raise_error(F.lit(f"{path} has no results")))).alias("sample_token", "boxes"))
    rows = rows.filter(F.when(F.col("sample_token") == "", F.raise_error(F.lit(f"{path} has an empty token"))).otherwise(F.lit(True)))
    if tokens is not None:
        rows = rows.join(tokens.select("sample_token").distinct(), "sample_token", "left_semi")
    return rows.select("sample_token", F.posexplode_outer("boxes").alias("box_pos", "b"))


def _with_problem(rows: DataFrame, expert: str, frame: str) -> DataFrame:
    fields = [n for n in REQUIRED[1:]] + ["attribute_name"]
    flat = rows.select("sample_token", "box_pos", missing_field(F.col("b")).alias("missing"), *[F.col(f"b.{n}").alias(n) for n in fields], F.lit(expert).alias("expert"), F.lit(frame).alias("coord_frame"))
    return flat.withColumns({"problem": problem(), "token": F.col("sample_token")})


def flatten(rows: DataFrame) -> DataFrame:
    """Scalar columns, as all operators take them."""
    at = lambda c, k: F.get(F.col(c), F.lit(k))
    name = canonical_class(F.col("detection_name"))
    q = [at("rotation", k) for k in range(4)]
    columns = {**{c: at("translation", k) for k, c in enumerate("xyz")}, **{c: at("size", k) for k, c in enumerate("wlh")}, **dict(zip(("qw", "qx", "qy", "qz"), q, strict=True)), "vx": at("velocity", 0), "vy": at("velocity", 1)}
    return rows.select("sample_token", "expert", F.col("expert_ord").cast("int").alias("expert_ord"), F.col("box_pos").cast("int").alias("box_pos"), *[v.alias(k) for k, v in columns.items()], name.alias("class_name"), lookup(CLASS_IDS, name, UNKNOWN_CLASS).alias("class_id"), F.col("detection_score").alias("score"), F.col("attribute_name").alias("attribute"), "coord_frame", yaw(*q).alias("yaw"))


def read_experts(spark: SparkSession, paths: dict[str, str], **more: object) -> tuple[DataFrame, DataFrame]:
    """The boxes of all experts in one table, in the order of ``paths``, and the union of their frames."""
    boxes = frames = None
    for k, (expert, path) in enumerate(paths.items()):
        b, f = read_submission(spark, path, expert, k, **more)
        boxes, frames = (b, f) if boxes is None else (boxes.unionByName(b), frames.unionByName(f))
    return boxes, frames.distinct()
