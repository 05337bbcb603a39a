"""Quality rules, line first: each line is judged by rules on punctuation, navigation, symbols,
shouting and boilerplate; lines that fail go, and a document that loses too much text goes too.
Built-in functions only, within the row: there is no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, GAP, let, refuse_reserved, words

SYMBOLS = "#*$%&|<>"
#: What any stock phrase has in it, in lower case.
HINT = r"(?:all rights reserved|terms of (?:use|service)|privacy policy|cookie|javascript|click here|sign (?:in|up)|log ?in|subscribe|newsletter|(?:licensed|released) under|copyright)"
#: Phrases, between characters that are neither letters nor digits, that mark a line as boilerplate; and
#: others that do so only in a line without a sentence's end, or one that speaks to the reader.
_WHOLE = r"(?:^|[^\p{L}\p{N}])(?:%s)(?:$|[^\p{L}\p{N}])"
STOCK = _WHOLE % r"all rights reserved|click here|(?:licensed|released) under (?:cc by|[^.]{0,60}licen[cs]e)|copyright (?:©|\(c\)|[0-9]{4})|(?:accept|uses?|using) cookies|(?:enable|requires?) javascript|subscribe to our"
TOPIC = _WHOLE % r"terms of (?:use|service)|privacy policy|cookies?|javascript|sign (?:in|up)|log ?in|subscribe|newsletter|copyright"
READER = _WHOLE % r"please|our|your?|this (?:web)?(?:site|page)"
END_MARKS = ".!?…。！？"
#: A line that ends so is a sentence's end, a heading or a list's head.
SENTENCE_END = r"""[.!?:;…。！？]["'”’»)\]]*$"""


def lines_of(text: Column) -> Column:
    """Lines with a word, in order."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: F.trim(x, F.lit(BLANKS)) != "")


def count_of(line: Column, chars: str) -> Column:
    return F.length(line) - F.length(F.translate(line, chars, ""))


def line_passes(line: Column, min_words: int = 3, max_open_words: int = 40, max_symbols: float = 0.3, max_bars: float = 0.2) -> Column:
    """The verdict on one line that has a word.

    Navigation: bars part many of its words, or it is a word or two without a sentence's end.
    Symbols: nearly a third of the words hold one.  Shouting: eight words or more, all capitals.
    Punctuation: many words, no sentence's end and hardly an end mark within.  Boilerplate: a short line with a stock
    phrase, or with a phrase that is a topic as well and a second sign."""
    return let(
        F.trim(line, F.lit(BLANKS)),
        lambda t: let(
            F.size(F.split(t, GAP)),
            lambda n: ~(
                (count_of(t, SYMBOLS) > max_symbols * n)
                | ((count_of(t, "|") >= 2) & (count_of(t, "|") > max_bars * n))
                | ((n >= 8) & (F.upper(t) == t) & (F.lower(t) != t))
                | (((n < min_words) | ((n > max_open_words) & (max_open_words * count_of(t, END_MARKS) < n))) & ~t.rlike(SENTENCE_END))
                | ((n <= 30) & F.lower(t).rlike(HINT) & (F.lower(t).rlike(STOCK) | (F.lower(t).rlike(TOPIC) & (~t.rlike(SENTENCE_END) | F.lower(t).rlike(READER)))))
            ),
        ),
    )


def repeated_words(hashes: Column) -> Column:
    """Words in windows of three that occur twice or more; ``hashes``: of the windows, in order."""
    by_hash = F.sort_array(F.transform(hashes, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))

    def covered(s: Column) -> Column:
        twice = F.filter(s, lambda e, i: ((i > 0) & (F.get(s, i - 1)["h"] == e["h"])) | F.coalesce(F.get(s, i + 1)["h"] == e["h"], F.lit(False)))
        return F.aggregate(
            F.sort_array(F.transform(twice, lambda e: e["p"])),
            F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n")),
            lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(F.lit(3), p - acc["last"])).alias("n")),
            lambda acc: acc["n"],
        )

    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(let(by_hash, covered))


def window_hashes(w: Column, n: int = 3) -> Column:
    return F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(n)]))).otherwise(F.array().cast("array<bigint>"))


def verdict(text: Column, min_words: int = 50, max_repeat: float = 0.5, max_lost: float = 0.5) -> Column:
    """The figures of one text as a struct, with ``base_failed``, ``kept`` and ``clean_text``."""
    measured = let(
        words(text),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            let(window_hashes(w), repeated_words).alias("n_repeat_words"),
        ),
    )
    by_line = let(
        lines_of(text),
        lambda ls: let(
            F.filter(ls, lambda x: line_passes(x)),
            lambda ok: F.struct(
                (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"),
                F.length(F.array_join(ls, "")).cast("long").alias("line_chars"),
                F.array_join(ok, "\n").alias("clean_text"),
                F.length(F.array_join(ok, "")).cast("long").alias("clean_chars"),
            ),
        ),
    )

    def judged(m: Column, l: Column) -> Column:  # noqa: E741
        failed = (m["n_words"] < min_words) | (100 * m["n_repeat_words"] > F.lit(100 * max_repeat).cast("long") * m["n_words"])
        return F.struct(
            m["n_words"].alias("n_words"), m["word_chars"].alias("word_chars"), count_of(text, SYMBOLS).cast("long").alias("n_symbols"),
            l["n_dup_lines"].alias("n_dup_lines"), m["n_repeat_words"].alias("n_repeat_words"), failed.alias("base_failed"),
            (~failed & (l["line_chars"] - l["clean_chars"] <= max_lost * l["line_chars"])).alias("kept"), l["clean_text"].alias("clean_text"),
        )

    return let(measured, lambda m: let(by_line, lambda l: judged(m, l)))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits: float) -> DataFrame:
    """Per row of ``docs`` its id, figures, ``base_failed``, ``kept`` and ``clean_text``, the lines
    that pass joined by line feeds.

    A document is kept if it has ``min_words`` words, no more than ``max_repeat`` of them lie in
    repeated windows of three, and the failing lines hold no more than ``max_lost`` of its
    characters.  Null and empty texts have no words and are not kept; rows are judged one by one, so
    repeated rows and ties have no bearing; an empty table gives no rows.  Window hashes have 64
    bits."""
    v = verdict(F.coalesce(F.col(text_col).cast("string"), F.lit("")), **limits)
    return docs.select(F.col(id_col), F.inline(F.array(v)))


def clean(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars", **limits: float) -> DataFrame:
    """The rows of ``docs`` that are kept, with the failing lines out of ``text_col``; ``length_col``,
    if there is such a column, follows.  Texts in which no line fails stay as they are.

    Null, empty and blank texts are not kept; rows are judged one by one, so repeated rows and ties
    have no bearing and nulls in other columns stay; an empty table gives no rows; other columns of any
    name pass, but for the reserved ``__kept__``, which is refused."""
    refuse_reserved(docs)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    # the generator evaluates the verdict once, which a filter on it would do twice
    kept = F.filter(F.array(verdict(text, **limits)), lambda v: v["kept"])
    hold = "__kept__"
    out = docs.select("*", F.explode(F.transform(kept, lambda v: v["clean_text"])).alias(hold))
    blank = F.translate(F.col(hold), "\n", "") == F.translate(text, "\n", "")
    out = out.withColumn(text_col, F.when(blank, F.col(text_col)).otherwise(F.col(hold)))
    if length_col in docs.columns:
        out = out.withColumn(length_col, F.length(text_col).cast(docs.schema[length_col].dataType))
    return out.drop(hold)
