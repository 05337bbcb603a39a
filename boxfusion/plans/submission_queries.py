"""Submissions out and in: boxes written in the format of evaluators and read back, flawed ones among them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from boxfusion.operators.state import hold, remove, scratch
from boxfusion.plans import fixtures as X
from boxfusion.plans.queries import query
from boxfusion.schemas import canonical_class
from boxfusion.sources import splits

#: Boxes of a shard, about.
SHARD = 1 << 19

_ROWS = """
SELECT concat('s', CAST(scene_id AS STRING), '-', CAST(frame_idx AS STRING)) AS sample_token, box_key, x, y, l,
  CASE WHEN box_key % 23 = 3 THEN -w WHEN box_key % 23 = 4 THEN 0*w ELSE w END AS w,
  CASE WHEN box_key % 19 = 2 THEN 'unicycle' WHEN box_key % 19 = 3 THEN 'vehicle.car' ELSE 'bus' END AS class_name,
  CASE WHEN box_key % 29 = 5 THEN score + 1 ELSE score END AS score, CASE WHEN box_key % 31 = 7 THEN NULL ELSE CAST(0.5 AS DOUBLE) END AS vx
FROM {boxes}
"""
_FRAMES = "SELECT DISTINCT sample_token FROM {rows} UNION SELECT DISTINCT concat('empty-', CAST(scene_id AS STRING)) FROM {boxes}"
_KEPT = "substring(sample_token, length(sample_token)) <> '7'"


@query(
    f"""SELECT 'box' AS kind, sample_token, CAST(box_pos AS INT) AS box_pos, CASE WHEN class_name = 'bus' THEN 'bus' ELSE 'car' END AS class_name, score, x, w, CAST(NULL AS VARCHAR) AS problem FROM judged WHERE problem IS NULL AND score >= 0.25
        UNION ALL SELECT 'flaw', sample_token, CAST(box_pos AS INT), NULL, NULL, NULL, NULL, problem FROM judged WHERE problem IS NOT NULL
        UNION ALL SELECT 'frame', sample_token, NULL, NULL, NULL, NULL, NULL, NULL FROM frames WHERE {_KEPT}""",
    rows=_ROWS.format(boxes="boxes").replace("AS STRING", "AS VARCHAR"),
    frames=_FRAMES.format(rows="rows", boxes="boxes").replace("AS STRING", "AS VARCHAR"),
    judged=f"""SELECT *, CASE WHEN vx IS NULL THEN 'missing velocity' WHEN NOT w > 0 THEN 'size' WHEN score > 1 THEN 'score' WHEN class_name = 'unicycle' THEN 'unknown class' END AS problem
        FROM (SELECT *, row_number() OVER (PARTITION BY sample_token ORDER BY score DESC, box_key) - 1 AS box_pos FROM rows) WHERE {_KEPT}""",
)
def submission_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Written as shards in the shared folder and read by byte ranges, with a threshold and a set of tokens.

    Boxes and frames are held as Parquet, shards are packed (one after another they are still one JSON object, by zcat)."""
    path = scratch(spark, "submission")
    boxes = hold(X.boxes(spark, d).drop("expert_ix", "class_ix"), f"{path}/boxes")
    rows = spark.sql(_ROWS, boxes=boxes)
    frames = hold(spark.sql(_FRAMES, rows=rows, boxes=boxes), f"{path}/frames")
    zero = F.lit(0.0)
    full = rows.withColumns({"z": zero, "h": F.lit(1.5), "qw": F.lit(1.0), "qx": zero, "qy": zero, "qz": zero, "vy": zero, "attribute": F.lit(None).cast("string")})
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    splits.save_shards(full, frames, f"{path}/shards", ("box_key",), shards=max(n, -(-boxes.count() // SHARD)), compression="gzip")
    remove(spark, f"{path}/boxes")
    rows = splits.judged(spark, f"{path}/shards", "fused")
    null = lambda k: F.lit(None).cast(k)

    def row(kind: str, pos: Column, **known: Column) -> Column:
        given = {"class_name": null("string"), "score": null("double"), "x": null("double"), "w": null("double"), "problem": null("string")} | known
        return F.struct(F.lit(kind).alias("kind"), "sample_token", pos.alias("box_pos"), *[v.alias(k) for k, v in given.items()])

    box = row("box", F.col("box_pos"), class_name=canonical_class(F.col("detection_name")), score=F.col("detection_score"), x=F.get("translation", F.lit(0)), w=F.get("size", F.lit(0)))
    flaw = row("flaw", F.col("box_pos"), problem=F.col("problem"))
    good = F.col("box_pos").isNotNull() & F.col("problem").isNull() & (F.col("detection_score") >= 0.25)
    # all in one pass over the files; a token's first box, or its only row without one, tells the frame
    each = F.array(F.when(good, box), F.when(F.col("problem").isNotNull(), flaw), F.when(F.coalesce("box_pos", F.lit(0)) == 0, row("frame", null("int"))))
    told = rows.select(F.explode(F.filter(each, lambda r: r.isNotNull())).alias("r")).select("r.*")
    return splits.of_tokens(told, frames.filter(_KEPT)).select(told.columns)
