"""License scans: MinHash bands over overlapping text windows retrieve templates, exact containment of
word shingles verifies them.

A window is ``WINDOW`` shingles, and windows begin at every half of that, so that every run of
WINDOW / 2 shingles lies whole in one.  Its sketch is MinHash by one permutation: the range of the
shingle hash is cut into ``BINS`` bins, and the least hash of each bin is a band of one row.
Templates are sketched in parts of at most WINDOW / 2 shingles.  A shingle that part and window
share is missed only if another of the window's shingles has a lesser hash in its bin, so the
chance that a contained part of k shingles collides is at least 1 - (WINDOW / 2 / BINS) ** k:
0.998 for a single one.

All of it is done within the row by built-in functions; only rows with a collision leave it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let
from .license_templates import TEMPLATES

SHINGLE, WINDOW, BIN_BITS = 5, 16, 12
BINS = 1 << BIN_BITS
#: Templates are literals of the plan: more or longer ones are refused.
MOST_TEMPLATES, MOST_SHINGLES = 2000, 512
NO_LONGS = "array<bigint>"


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return let(F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " ")), lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, " ")))


def shingles(w: Column, n: int = SHINGLE) -> Column:
    return F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(n)]))).otherwise(F.array().cast(NO_LONGS))


def sketch(hashes: Column) -> Column:
    """The least of ``hashes`` in each bin."""
    return let(F.sort_array(hashes), lambda s: F.filter(s, lambda x, i: (i == 0) | (F.shiftright(x, 64 - BIN_BITS) != F.shiftright(F.get(s, i - 1), 64 - BIN_BITS))))


def template_table(spark: SparkSession, templates: tuple[tuple[str, str], ...]) -> DataFrame:
    """(template_id, license, shingles, bands) of templates with a shingle at least."""
    if len(templates) > MOST_TEMPLATES:
        raise ValueError(f"at most {MOST_TEMPLATES} templates")
    rows = spark.createDataFrame([(k, name, text) for k, (name, text) in enumerate(templates)], "template_id int, license string, text string")
    half = WINDOW // 2
    parts = lambda h: F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(0), F.size(h) - 1, F.lit(half)), lambda s: sketch(F.slice(h, s + 1, half)))))
    hashed = rows.select("template_id", "license", F.explode(F.array(shingles(tokens(F.col("text"))))).alias("hashes")).filter(F.size("hashes") > 0)
    return hashed.select("template_id", "license", F.array_distinct("hashes").alias("shingles"), F.explode(F.array(let(F.col("hashes"), parts))).alias("bands"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: tuple[tuple[str, str], ...] = TEMPLATES, least: float = 0.8) -> DataFrame:
    """(id, template_id, license, containment, position) for each document and template of whose
    shingles at least the share ``least`` lies in the text around one window; ``position``: of the
    first token of the first such window.

    Null and empty texts, and templates of fewer than five words, match nothing; equal ids count as
    one document; an empty table gives no rows."""
    known = template_table(docs.sparkSession, templates).collect()  # one row for each template
    longest = max((len(r["shingles"]) for r in known), default=0)
    if longest > MOST_SHINGLES:
        raise ValueError(f"at most {MOST_SHINGLES} shingles in a template")
    bands = sorted({b for r in known for b in r["bands"]})

    def hits(h: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(h) - WINDOW // 2 - 1, F.lit(0)), F.lit(WINDOW // 2))
        found = F.transform(starts, lambda s: F.struct(s.alias("start"), F.filter(sketch(F.slice(h, s + 1, WINDOW)), lambda x: x.isin(bands)).alias("bands")))
        first = lambda x: F.greatest(x["start"] - longest, F.lit(0))
        near = F.transform(F.filter(found, lambda x: F.size(x["bands"]) > 0), lambda x: F.struct(x["start"].alias("start"), x["bands"].alias("bands"), F.slice(h, first(x) + 1, WINDOW + 2 * longest).alias("around")))
        return F.when(F.size(h) > 0, near)

    rows = docs.select(F.col(id_col).alias("id"), F.explode(let(tokens(F.col(text_col)), lambda w: let(shingles(w), hits))).alias("x"))
    if not bands:
        rows = rows.limit(0)
    table = docs.sparkSession.createDataFrame([(r["template_id"], r["license"], b, r["shingles"]) for r in known for b in r["bands"]], "template_id int, license string, band bigint, shingles array<bigint>")
    # MOST_TEMPLATES rows of at most MOST_SHINGLES bands at the very most
    met = rows.select("id", "x.start", "x.around", F.explode("x.bands").alias("band")).join(F.broadcast(table), "band")
    share = F.size(F.array_intersect("shingles", "around")) / F.size("shingles")
    each = met.select("id", "template_id", "license", "start", share.alias("containment")).filter(F.col("containment") >= least)
    return each.groupBy("id", "template_id", "license").agg(F.max("containment").alias("containment"), F.min("start").alias("position")).withColumnRenamed("id", id_col)
