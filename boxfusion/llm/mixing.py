"""Mixing sources to target weights: hash-threshold histograms.

Every document has a fixed 36-bit hash.  The sizes of a source's documents are summed by hash
bucket; running sums tell up to which bucket the budget reaches, and only the bucket on the
boundary is looked at again, twice, by further bits.  What remains is one hash threshold for each
source, so that documents are chosen by a filter: they are not sorted, and thresholds are nested,
that of a larger budget being no lower.  Budgets beyond one pass over a source give whole copies of it and
a threshold for the remainder.

Whole documents leave a gap at the threshold.  Unless ``fill`` is off, one document beyond it, of the
size that fits best, closes the gap; it is the one document that a mix of a larger budget may lack.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import count_words, cut, refuse_reserved

#: Bits of the hash that each round of histograms resolves.
LEVELS = (10, 13, 13)


def row_hash(key: Column, text: Column | None = None) -> Column:
    """36 bits that depend on ``key`` and ``text`` alone, equal in every engine that has MD5."""
    parts = [F.coalesce(c.cast("string"), F.lit("")) for c in (key, text) if c is not None]
    return F.conv(F.substring(F.md5(F.concat_ws(" ", *parts)), 1, 9), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...], most: float) -> DataFrame:
    """Of ``sizes`` (source, source_size), one row a source: its target.  Sources by code point, null
    last, take ``weights`` in turn and share the sum of all sizes; a target stops at ``most`` times
    its source's size, and the excess goes to the others by weight until none is above.

    That ends where each target is min(most * size, level * weight); the level follows from running
    sums over sources in the order of most * size / weight.  There is one row for each source."""
    turn = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    by_ratio = Window.orderBy((F.col("cap") / F.col("w")), F.col("source").asc_nulls_last())
    before, everything = by_ratio.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    return (
        sizes.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), turn + 1).cast("double"))
        .withColumn("cap", F.lit(float(most)) * F.col("source_size"))
        .withColumn("free", F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("level", F.col("free") / (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0))))
        .withColumn("at", F.row_number().over(by_ratio))
        .withColumn("first", F.min(F.when(F.col("cap") >= F.col("level") * F.col("w"), F.struct("at", "level"))).over(everything))
        .select("source", "source_size", F.when(F.col("at") < F.coalesce(F.col("first.at"), F.col("at") + 1), F.col("cap")).otherwise(F.col("first.level") * F.col("w")).alias("target"))
    )


def boundary(histogram: DataFrame) -> DataFrame:
    """Of ``histogram`` (key, need, bucket, words), the bucket of each key in which the running sum
    passes ``need``, with what is still needed from it."""
    upto = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    return (
        histogram.withColumn("before", F.coalesce(F.sum("words").over(upto), F.lit(0)))
        .filter((F.col("before") <= F.col("need")) & (F.col("before") + F.col("words") > F.col("need")))
        .select("key", "bucket", (F.col("need") - F.col("before")).alias("need"), "words")
    )


def _key(source: Column) -> Column:
    return F.when(source.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), source))


def _sizes(docs: DataFrame, id_col: str, text_col: str, source_col: str, size: Column | None) -> tuple[Column, Column, Column]:
    """Key of the source, size and hash of a row of ``docs``."""
    words = F.coalesce(size.cast("long"), F.lit(0)) if size is not None else count_words(F.col(text_col).cast("string"))
    return _key(F.col(source_col).cast("string")), words, row_hash(F.col(id_col), F.col(text_col) if text_col in docs.columns else None)


def plan_mix(slim: DataFrame, weights: tuple[float, ...], most: int, fill: bool = True) -> tuple[DataFrame, DataFrame]:
    """Of ``slim`` (key, source, size, hash): the first histogram (key, bucket, words), and for each key
    source_size, target, copies (whole ones), limit (hashes below it are taken once more) and extra
    (so is this one hash; -1 if none)."""
    shift = sum(LEVELS) - LEVELS[0]
    first = cut(slim.groupBy("key", "source", F.shiftright("hash", shift).alias("bucket")).agg(F.sum("size").alias("words")))
    totals = first.groupBy("source").agg(F.sum("words").alias("source_size"))
    # copies: the 1e-9 keeps a ratio of 3 from turning into 2.999...
    copies = F.when(F.col("source_size") > 0, F.least(F.lit(most), F.floor(F.col("target") / F.col("source_size") + F.lit(1e-9)))).otherwise(F.lit(0)).cast("long")
    plan = source_targets(totals, weights, most).withColumn("key", _key(F.col("source"))).withColumn("copies", copies)
    plan = cut(plan.withColumn("need", F.greatest(F.lit(0.0), F.col("target") - F.col("copies") * F.col("source_size"))).drop("source"))

    edge = boundary(first.join(plan.filter(F.col("copies") < most).select("key", "need"), "key").select("key", "need", "bucket", "words"))
    for width in LEVELS[1:]:
        shift -= width
        edge = edge.select("key", "need", F.col("bucket").alias("upper"))
        inside = slim.withColumn("upper", F.shiftright("hash", shift + width)).join(edge, ["key", "upper"])
        edge = boundary(inside.groupBy("key", "need", "upper", F.shiftright("hash", shift).alias("bucket")).agg(F.sum("size").alias("words")))
    if not fill:  # the document on the boundary is taken if that comes nearer to the target
        edge = edge.select("key", (F.col("bucket") + (2 * F.col("need") >= F.col("words")).cast("long")).alias("limit"), F.lit(-1).cast("long").alias("extra"))
    else:
        # below the boundary's last bucket all are taken; then that one of the rest that comes nearest to
        # what is missing.  Sources are parted by bucket again, so that none meets in one task
        edge = cut(edge.select("key", F.col("bucket").alias("limit"), F.col("need").alias("rest")))
        place = F.shiftright("hash", sum(LEVELS) - LEVELS[0])
        beyond = first.select("key", "bucket").join(edge, "key").filter(F.col("bucket") >= F.shiftright("limit", sum(LEVELS) - LEVELS[0]))
        open_ = slim.withColumn("bucket", place).join(beyond, ["key", "bucket"]).filter(F.col("hash") >= F.col("limit"))
        open_ = open_.groupBy("key", "hash", "rest").agg(F.sum("size").alias("words")).filter(F.abs(F.col("words") - F.col("rest")) < F.col("rest"))
        extra = open_.groupBy("key").agg(F.min(F.struct(F.abs(F.col("words") - F.col("rest")).alias("off"), "hash")).alias("e")).select("key", F.col("e.hash").alias("extra"))
        edge = edge.join(extra, "key", "left")
    everything = F.when((F.col("need") > 0) & (F.col("copies") < most), F.lit(1 << sum(LEVELS))).otherwise(F.lit(0))
    plan = plan.join(edge, "key", "left").withColumns({"limit": F.coalesce("limit", everything), "extra": F.coalesce("extra", F.lit(-1))})
    return first, cut(plan.drop("need", "rest"))


def _met(rows: DataFrame, first: DataFrame, plan: DataFrame, most_sent: int) -> DataFrame:
    """``rows`` (__key__, __bucket__ and others) with their source's plan: it goes to every task if it has at most
    ``most_sent`` sources, else rows meet it by source and hash bucket, so that those of a hot source do so in many tasks."""
    plan = plan.select(*[F.col(c).alias(f"__{c}__") for c in plan.columns])
    if plan.limit(most_sent + 1).count() <= most_sent:
        return rows.join(F.broadcast(plan), "__key__")
    return rows.join(first.select(F.col("key").alias("__key__"), F.col("bucket").alias("__bucket__")).join(plan, "__key__"), ["__key__", "__bucket__"])


def _copies() -> Column:
    once_more = (F.col("__hash__") < F.col("__limit__")) | (F.col("__hash__") == F.col("__extra__"))
    return F.col("__copies__") + once_more.cast("long")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (1, 2, 3), most: int = 3, size: Column | None = None, most_sent: int = 20_000, fill: bool = True) -> DataFrame:
    """Per row of ``docs``: its id, size (words unless ``size`` is given), source_size, target and
    taken, the words that the mix takes of it, repeats counted.

    Null texts and sizes count 0; a null source is a source of its own, an empty one another; rows of equal id and text are
    taken together or not at all; an empty table gives no rows.  Each source's taken words differ
    from its target by at most half the words of the document on the boundary, and with ``fill`` as a rule by far
    less, since of all documents beyond it the one that fills the gap best is taken too.  Without
    ``fill`` a mix of a larger budget holds all that one of a smaller budget holds.  No document is taken
    more than ``most`` times.  Columns of any other name have no bearing."""
    key, words, place = _sizes(docs, id_col, text_col, source_col, size)
    slim = cut(docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), key.alias("key"), words.alias("size"), place.alias("hash")))
    first, plan = plan_mix(slim, weights, most, fill)
    rows = slim.select("id", "size", F.col("key").alias("__key__"), F.col("hash").alias("__hash__"), F.shiftright("hash", sum(LEVELS) - LEVELS[0]).alias("__bucket__"))
    found = _met(rows, first, plan, most_sent)
    return found.select(F.col("id").alias(id_col), "size", F.col("__source_size__").alias("source_size"), F.col("__target__").alias("target"), (F.col("size") * _copies()).cast("long").alias("taken"))


def mixture(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (1, 2, 3), most: int = 3, size: Column | None = None, most_sent: int = 20_000, fill: bool = True) -> DataFrame:
    """The rows of ``docs`` that the mix takes, with ``size``, ``taken`` and ``copies`` (taken / size).
    Rows of size 0 go; columns of ``docs`` of these names give way; names in double underscores as
    ``__key__`` are reserved and refused.  Nulls, ties, repeated rows and empty tables as in ``mix``.

    The plan goes to every task if it has at most ``most_sent`` sources, so that texts are not
    shuffled; else rows meet it by source and hash bucket."""
    refuse_reserved(docs)
    key, words, place = _sizes(docs, id_col, text_col, source_col, size)
    slim = cut(docs.select(F.col(source_col).cast("string").alias("source"), key.alias("key"), words.alias("size"), place.alias("hash")))
    first, plan = plan_mix(slim, weights, most, fill)
    rows = docs.withColumns({"__key__": key, "__size__": words, "__hash__": place, "__bucket__": F.shiftright(place, sum(LEVELS) - LEVELS[0])})
    met = _met(rows, first, plan, most_sent).withColumn("__taken__", _copies()).filter("__size__ > 0 and __taken__ > 0")
    new = {"size": F.col("__size__"), "taken": F.col("__size__") * F.col("__taken__"), "copies": F.col("__taken__")}
    return met.select(*[F.col(f"`{c}`") for c in docs.columns if c not in new], *[v.alias(k) for k, v in new.items()])
