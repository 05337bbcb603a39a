"""Ground truth, sensors, manifests, point clouds and the tables of scenes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxfusion.functions.geometry import compose_yaw, transform_point
from boxfusion.schemas import CLASS_IDS, GROUND_TRUTH, lookup

#: The order of labels in ground-truth files.
LABELS = tuple(CLASS_IDS)


def read_ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """Raw records, as JSON lines; other formats make them with GROUND_TRUTH as schema."""
    return spark.read.schema(GROUND_TRUTH).json(path)


def records(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """Raw records that a trusted converter has read on the driver, of a pickle for instance."""
    return spark.createDataFrame(rows, GROUND_TRUTH)


def ground_truth(raw: DataFrame, labels: tuple[str, ...] = LABELS) -> tuple[DataFrame, DataFrame]:
    """(gt, gt_frames) of raw records, in the global frame.

    Invalid instances and unknown labels drop out; a frame without any is still a frame of gt_frames.
    A record's length and width change places: sizes are width, length, height from here on."""
    rows = raw.select("token", "ego2global", F.col("lidar_points.lidar2ego").alias("lidar2ego"), F.posexplode("instances").alias("gt_pos", "i"))
    rows = rows.filter(F.coalesce("i.bbox_3d_isvalid", F.lit(True)))
    name = lookup(dict(enumerate(labels)), F.col("i.bbox_label_3d"))
    at = [F.get("i.bbox_3d", F.lit(k)) for k in range(7)]
    ego = transform_point(F.col("lidar2ego"), *at[:3])
    x, y, z = transform_point(F.col("ego2global"), *ego)
    gt = rows.select(F.col("token").alias("sample_token"), F.col("gt_pos").cast("int").alias("gt_pos"), name.alias("class_name"), x.alias("x"), y.alias("y"), z.alias("z"), at[4].alias("w"), at[3].alias("l"), at[5].alias("h"), compose_yaw(at[6], F.col("lidar2ego"), F.col("ego2global")).alias("yaw"))
    return gt.filter("class_name is not null"), raw.select(F.col("token").alias("sample_token")).distinct()


def lidar_info(raw: DataFrame, root: str) -> DataFrame:
    """(sample_token, path, lidar2ego, ego2global, columns): the sweep's file under ``root``."""
    name = F.regexp_extract("lidar_points.lidar_path", r"([^/]+)$", 1)
    return raw.select(F.col("token").alias("sample_token"), F.concat(F.lit(f"{root.rstrip('/')}/samples/LIDAR_TOP/"), name).alias("path"), F.col("lidar_points.lidar2ego").alias("lidar2ego"), "ego2global", F.coalesce("lidar_points.num_pts_feats", F.lit(5)).alias("columns"))


def points_of(content: bytes) -> np.ndarray:
    """x, y, z, intensity and ring; a dump of four columns gets a ring of 0."""
    flat = np.frombuffer(content, np.float32)
    if len(flat) % 5 == 0:
        return flat.reshape(-1, 5)
    four = flat[: len(flat) // 4 * 4].reshape(-1, 4)
    return np.hstack([four, np.zeros((len(four), 1), np.float32)])


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """(path, x, y, z, intensity, ring) of binary dumps."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p, c in zip(b["path"], b["content"], strict=True):
                yield pd.DataFrame(points_of(bytes(c)), columns=["x", "y", "z", "intensity", "ring"]).assign(path=p)[["path", "x", "y", "z", "intensity", "ring"]]

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, x float, y float, z float, intensity float, ring float")


def in_view(points: DataFrame, reach: float = 50.0) -> DataFrame:
    return points.filter((F.abs("x") <= reach) & (F.abs("y") <= reach))


def read_router_rows(spark: SparkSession, paths: dict[str, str], schema: str, parquet: bool = False) -> DataFrame:
    """Router rows of several files with the name of their ``split``."""
    out = None
    for split, path in paths.items():
        rows = (spark.read.parquet(path) if parquet else spark.read.schema(schema).csv(path, header=True)).withColumn("split", F.lit(split))
        out = rows if out is None else out.unionByName(rows)
    return out


def read_split(spark: SparkSession, path: str) -> DataFrame:
    """(sample_token, split) of a manifest whose keys are <split>_tokens."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,array<string>>").alias("m"))
    return raw.select(F.explode("m").alias("k", "tokens")).select(F.explode("tokens").alias("sample_token"), F.regexp_replace("k", "_tokens$", "").alias("split"))


def read_scene_map(spark: SparkSession, path: str) -> DataFrame:
    """(sample_token, scene_token) of a flat JSON object."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", "map<string,string>")).alias("sample_token", "scene_token"))


def with_scene(rows: DataFrame, scenes: DataFrame) -> DataFrame:
    """``rows`` with their scene; a token without one fails the query."""
    met = rows.join(scenes, "sample_token", "left")
    return met.filter(F.when(F.col("scene_token").isNull(), F.raise_error(F.concat(F.lit("no scene for token "), "sample_token"))).otherwise(F.lit(True)))


def read_tables(spark: SparkSession, root: str, names: tuple[str, ...] = ("scene", "sample", "log", "map")) -> dict[str, DataFrame]:
    """Normalised JSON tables, one array of rows each."""
    return {n: spark.read.option("multiLine", True).json(f"{root.rstrip('/')}/{n}.json") for n in names}


def map_of_tokens(samples: DataFrame, scenes: DataFrame, maps: DataFrame) -> DataFrame:
    """(sample_token, map_token): sample, scene, log, map; tokens without a map are absent."""
    logs = maps.select(F.col("token").alias("map_token"), F.explode("log_tokens").alias("log_token"))
    return samples.select(F.col("token").alias("sample_token"), "scene_token").join(scenes.select(F.col("token").alias("scene_token"), "log_token"), "scene_token").join(logs, "log_token").select("sample_token", "map_token")


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """Metric files, one row each; an absent path fails."""
    return spark.read.option("multiLine", True).json(path)
