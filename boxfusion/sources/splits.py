"""Submissions of any size: one JSON object of tokens and boxes, read by byte ranges and written in shards.

A box holds no braces but its own, so that a file parts at every closing brace, wherever a byte range begins.  What
stands before a box's opening brace tells the tokens that begin there; a box without one belongs to the token before it.
Within a byte range that is the last one seen, as its task reads it from head to end; at its head it is the last one of
the ranges before, which a first pass tells: a row for each range.  Boxes are not shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from boxfusion.operators.state import scratch, write  # noqa: F401
from boxfusion.schemas import SUBMISSION
from boxfusion.sources.sinks import submitted
from boxfusion.sources.submissions import REQUIRED, flatten, missing_field, problem

TOKEN = re.compile(r'"((?:[^"\\]|\\.)*)"\s*:\s*\[', re.ASCII)
RESULTS = re.compile(r'"results"\s*:\s*\{', re.ASCII)
BOXES = "sample_token string, box_pos int, body string"
#: Columns that a written box is made of.
WRITTEN = ("x", "y", "z", "w", "l", "h", "qw", "qx", "qy", "qz", "vx", "vy", "class_name", "score", "attribute")


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Of each run of a batch's rows from one byte range: the range, each row's text and body (null if it is no box), and the
    places and tokens of the rows in which tokens begin."""
    for batch in batches:
        if not batch.num_rows:
            continue
        value, file, start = (batch.column(c) for c in ("value", "file", "start"))
        codes = pc.dictionary_encode(file)
        new = np.flatnonzero(np.diff(codes.indices.to_numpy()) | np.diff(start.to_numpy())) + 1
        parts = pc.split_pattern(value, "{", max_splits=1, reverse=True)
        ends, flat = parts.offsets.to_numpy(), parts.values
        head = flat.take(pa.array(ends[:-1]))
        trimmed = pc.ascii_rtrim(head, characters=" \t\r\n")
        is_box = pc.and_(pa.array(np.diff(ends) == 2), pc.or_(pc.ends_with(trimmed, "["), pc.ends_with(trimmed, ",")))
        body = pc.if_else(is_box, flat.take(pa.array(ends[1:] - 1)), pa.scalar(None, flat.type))
        seen = pc.if_else(is_box, head, value)
        at = np.flatnonzero(pc.match_substring(seen, '"').to_numpy(zero_copy_only=False))
        found = [(k, t) for k, text in zip(at.tolist(), seen.take(pa.array(at)).to_pylist(), strict=True) if (t := TOKEN.findall(text))]
        bounds = [0, *new.tolist(), batch.num_rows]
        for low, high in zip(bounds[:-1], bounds[1:], strict=True):
            key = (file[low].as_py(), start[low].as_py())
            yield key, value.slice(low, high - low), body.slice(low, high - low), [(k - low, t) for k, t in found if low <= k < high]


def _range_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each byte range: the token that is open at its end, how many boxes it has by then (without a token, those of
    the range), and whether results begin in it."""
    ends: dict = {}
    for key, value, body, found in _pieces(batches):
        token, boxes, results = ends.get(key, (None, 0, False))
        is_box = pc.is_valid(body).to_numpy(zero_copy_only=False)
        if found:
            token, boxes = found[-1][1][-1], int(is_box[found[-1][0] :].sum())
        else:
            boxes += int(is_box.sum())
        if not results:
            some = value.filter(pc.match_substring(value, '"results"'))
            results = any(RESULTS.search(v) for v in some.to_pylist())
        ends[key] = (token, boxes, results)
    if ends:
        columns = [*zip(*ends), *zip(*ends.values())]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()), strict=True)], ["file", "start", "token", "boxes", "results"])


def read_ranges(spark: SparkSession, path: str) -> DataFrame:
    """(sample_token, box_pos, body) of the submission at ``path``, a file or a folder of shards: each box's JSON, and for a
    token without boxes one row with nulls.

    Tokens, names and attributes must not hold braces; a token is to occur once."""
    lines = spark.read.option("lineSep", "}").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    ends = lines.mapInArrow(_range_ends, "file string, start long, token string, boxes long, results boolean").collect()  # one row for each range
    if not any(r["results"] for r in ends):
        raise ValueError(f"{path} has no results")
    before, token, boxes = {}, None, 0
    for r in sorted(ends, key=lambda r: (r["file"], r["start"])):
        before[r["file"], r["start"]] = (token, boxes)
        token, boxes = (token, boxes + r["boxes"]) if r["token"] is None else (r["token"], r["boxes"])
    known = spark.sparkContext.broadcast(before)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, token, boxes = None, None, 0
        for key, _, body, found in _pieces(batches):
            if key != at:
                if key not in known.value:
                    raise RuntimeError(f"the byte ranges of {path} have changed since it was first read")
                at, (token, boxes) = key, known.value[key]
            is_box = pc.is_valid(body).to_numpy(zero_copy_only=False)
            opened = np.array([k for k, _ in found], int)
            count = is_box.cumsum()
            # by the token that is open: the one brought along, then those of this piece; boxes that it has before
            first = np.concatenate([[-boxes], count[opened] - is_box[opened]])
            which = np.searchsorted(opened, np.arange(len(is_box)), side="right")
            names = pa.array([token, *[t[-1] for _, t in found]], pa.string())
            box = np.flatnonzero(is_box)
            # every token of a row but the last has no box; the last has none if none follows
            empty = [t for k, every in found for t in (every[:-1] if is_box[k] else every)]
            tokens = pa.concat_arrays([names.take(pa.array(which[box])), pa.array(empty, pa.string())])
            place = pa.concat_arrays([pa.array((count - 1 - first[which])[box], pa.int32()), pa.nulls(len(empty), pa.int32())])
            yield pa.RecordBatch.from_arrays([tokens, place, pa.concat_arrays([body.take(pa.array(box)).cast(pa.string()), pa.nulls(len(empty), pa.string())])], ["sample_token", "box_pos", "body"])
            if len(count):
                token, boxes = names[len(found)].as_py(), int(count[-1] - first[-1])

    return lines.mapInArrow(run, BOXES)


def judged(spark: SparkSession, path: str, expert: str, frame: str = "global", tokens: DataFrame | None = None) -> DataFrame:
    """Every box of a submission of any size in one pass, with ``problem``, and for a token without boxes one row without
    box_pos; ``tokens`` (sample_token) are kept only."""
    rows = read_ranges(spark, path)
    rows = rows.filter(F.when(F.col("sample_token") == "", F.raise_error(F.lit(f"{path} has an empty token"))).otherwise(F.lit(True)))
    kind: StructType = SUBMISSION["results"].dataType.valueType.elementType
    parsed = rows.withColumn("b", F.from_json(F.concat(F.lit("{"), "body", F.lit("}")), kind))
    names = [*REQUIRED[1:], "attribute_name"]
    is_box = F.col("body").isNotNull()
    flat = parsed.select("sample_token", "box_pos", F.when(is_box, missing_field(F.col("b"))).alias("missing"), *[F.col(f"b.{n}").alias(n) for n in names], F.lit(expert).alias("expert"), F.lit(frame).alias("coord_frame"))
    out = flat.withColumn("problem", F.when(F.col("box_pos").isNotNull(), F.coalesce("missing", problem())))
    return out if tokens is None else of_tokens(out, tokens)


def of_tokens(rows: DataFrame, tokens: DataFrame) -> DataFrame:
    """``rows`` of ``tokens`` (sample_token).  An inner join, as a semi join would give way to what ``rows`` is made of, and
    whole bodies would be shuffled instead of the columns that are asked for."""
    return rows.join(tokens.select("sample_token").distinct(), "sample_token")


def read_submission(spark: SparkSession, path: str, expert: str, expert_ord: int = 0, frame: str = "global", score_threshold: float = 0.0, tokens: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(boxes, flawed, frames) of a submission of any size: boxes as all operators take them, of ``score_threshold`` or
    more; flawed ones (sample_token, box_pos, problem) whatever their score; every token, also those without a box.  Each
    reads the submission by itself; ``judged`` gives all of it in one pass.

    ``tokens`` (sample_token) are kept only.  The token of the map counts, not the box's own."""
    rows = judged(spark, path, expert, frame, tokens)
    flat = rows.filter("box_pos is not null").withColumn("expert_ord", F.lit(expert_ord))
    boxes = flatten(flat.filter("problem is null").filter(F.col("detection_score") >= score_threshold))
    return boxes, flat.filter("problem is not null").select("sample_token", "box_pos", "problem"), rows.select("sample_token").distinct()


def save_shards(boxes: DataFrame, frames: DataFrame, path: str, order: tuple[str, ...] = ("expert_ord", "box_pos"), meta: dict[str, bool] | None = None, shards: int | None = None, compression: str | None = None) -> None:
    """Writes a submission as a folder of text files by ranges of the token, which one after another, in the order of their
    names, are the one JSON object that evaluators read; ``read_submission`` reads the folder as it is.

    ``shards``: how many, else as Spark's shuffles have partitions; ``compression``: by Spark's name of it ("gzip").  Boxes
    are shuffled once, as columns, and written box by box in the order of a sort, so that no array holds a token's boxes."""
    flags = {"use_lidar": True, "use_camera": False, "use_radar": False, "use_map": False, "use_external": False} | (meta or {})
    head = '{"meta": {' + ", ".join(f'"{k}": {str(bool(v)).lower()}' for k, v in flags.items()) + '}, "results": {'
    ends = frames.agg(F.min("sample_token").alias("first"), F.max("sample_token").alias("last")).first()
    if ends["first"] is None:
        raise ValueError("a submission needs a frame")
    given = boxes.select("sample_token", (-F.col("score")).alias("__s"), *order, *[c for c in WRITTEN if c not in order], F.lit(True).alias("__box"))
    rows = given.unionByName(frames.select("sample_token", F.lit(False).alias("__box")), allowMissingColumns=True)
    n = shards or int(boxes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.filter("sample_token is not null").repartitionByRange(n, "sample_token")
    # a token's frame comes before its boxes, and counts once however often it comes; boxes without a frame go
    here = Window.partitionBy("sample_token").orderBy("__box", "__s", *order, *[c for c in WRITTEN if c not in order])
    rows = rows.withColumns({"__frame": ~F.first("__box").over(here), "__after": F.lag("__box").over(here), "__next": F.lead("__box").over(here)})
    rows = rows.filter(F.col("__frame") & (F.col("__box") | F.coalesce("__next", F.lit(True))))
    quoted = F.expr("regexp_extract(to_json(array(sample_token)), '^.(.*).$', 1)")
    is_first, is_last = F.col("sample_token") == ends["first"], F.col("sample_token") == ends["last"]
    opening = F.concat(F.when(is_first, F.lit(head)).otherwise(F.lit(", ")), quoted, F.lit(": ["))
    text = F.when(F.col("__box"), F.concat(F.when(F.col("__after"), F.lit(", ")).otherwise(F.lit("")), F.to_json(submitted()))).otherwise(opening)
    closing = F.when(F.col("__next").isNotNull(), F.lit("")).when(is_last, F.lit("]}}")).otherwise(F.lit("]"))
    write(rows.select(F.concat(text, closing).alias("value")), path, "text", **({"compression": compression} if compression else {}))
