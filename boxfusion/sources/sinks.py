"""Files: submissions, router rows, metrics, tables for people."""

from __future__ import annotations

import json
import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def submitted() -> Column:
    """A box as submissions have it; one of unknown velocity is written without."""
    return F.struct(
        "sample_token", F.array("x", "y", "z").alias("translation"), F.array("w", "l", "h").alias("size"), F.array("qw", "qx", "qy", "qz").alias("rotation"), F.when(F.col("vx").isNotNull(), F.array("vx", "vy")).alias("velocity"),
        F.col("class_name").alias("detection_name"), F.col("score").alias("detection_score"), F.coalesce("attribute", F.lit("")).alias("attribute_name"),
    )


def submission_rows(boxes: DataFrame, frames: DataFrame, order: tuple[str, ...] = ("expert_ord", "box_pos")) -> DataFrame:
    """(sample_token, boxes): one JSON array for each frame, empty where it has no box."""
    rows = boxes.select("sample_token", F.struct((-F.col("score")).alias("s"), *order, submitted().alias("box")).alias("r"))
    by = rows.groupBy("sample_token").agg(F.to_json(F.transform(F.sort_array(F.collect_list("r")), lambda r: r["box"])).alias("boxes"))
    return frames.select("sample_token").distinct().join(by, "sample_token", "left").select("sample_token", F.coalesce("boxes", F.lit("[]")).alias("boxes"))


def save_submission(boxes: DataFrame, frames: DataFrame, path: str, order: tuple[str, ...] = ("expert_ord", "box_pos"), lidar: bool = True, camera: bool = False, radar: bool = False, maps: bool = False, external: bool = False) -> int:
    """Writes the one JSON object that evaluators read, frame by frame as the driver gets them, and gives
    the number of frames.  For other uses write ``submission_rows``."""
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    meta = {"use_lidar": lidar, "use_camera": camera, "use_radar": radar, "use_map": maps, "use_external": external}
    n = 0
    with open(path, "w") as f:
        f.write(f'{{"meta": {json.dumps(meta)}, "results": {{')
        for r in submission_rows(boxes, frames, order).orderBy("sample_token").toLocalIterator():
            f.write(f"{', ' if n else ''}{json.dumps(r['sample_token'])}: {r['boxes']}")
            n += 1
        f.write("}}")
    return n


def save_router_rows(rows: DataFrame, path: str, frame: tuple[str, ...] = ("sample_token",), expert: str = "expert", order: tuple[str, ...] = ("box_pos",), csv: bool = False) -> None:
    """In a total order, so that the same rows give the same files."""
    out = rows.orderBy(*frame, expert, *order).write.mode("overwrite")
    out.csv(path, header=True) if csv else out.parquet(path)


def append_metrics(metrics: DataFrame, path: str) -> None:
    """One write for each model, so that a later failure loses none."""
    metrics.write.mode("append").json(path)


def comparison(metrics: DataFrame, name: str = "model", digits: int = 4) -> DataFrame:
    """Fixed-width text of the scalars of each model, best mean first."""
    scalars = [c for c, k in metrics.dtypes if k == "double"]
    return metrics.select(F.format_string("%-24s", F.col(name)).alias(name), *[F.format_string(f"%.{digits}f", F.col(c)).alias(c) for c in scalars]).orderBy(F.col(scalars[0]).desc(), name)
