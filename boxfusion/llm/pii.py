"""Personal data by weak supervision.

Patterns propose spans.  Five labelers vote on each of them: format, checksum, gazetteer, context
and boundary.  Expectation-maximisation over the counts of vote patterns estimates how reliable
each labeler is and how likely each pattern is to be personal data; posterior counts then train a
naive Bayes classifier over features of the span and its surroundings, which decides.  Spans of the
base kinds that meet their definition always stay.

Only built-in functions touch the rows.  The driver sees one table, of counts by kind, votes and
features, whose size is bounded by their numbers of values."""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import before_each, let, refuse_reserved

#: In the order of the spans string: the base kinds, then those of the method.
KINDS = ("email", "ip", "card", "phone", "account", "ssn", "iban", "secret", "name")
BASE = KINDS[:4]

# The base patterns.  Possessive repeats and looks behind give the leftmost matches of the plain
# patterns without trying each place of a long run anew.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Whole runs of 13 to 19 digits; those of 16 to 19 that pass the checksum are cards.
DIGITS = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}+(?![\x20-]?[0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
SECRET = r"(?<![A-Za-z0-9])[A-Fa-f0-9]{32,128}+(?![A-Za-z0-9])"
NAME = r"(?<![A-Za-z])(?:Mr|Mrs|Ms|Dr|Prof)\.?\x20[A-Z][a-z]++(?:\x20[A-Z][a-z]++)?"

OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"
IP_VALID = rf"^{OCTET}\.{OCTET}\.{OCTET}\.{OCTET}$"
IP_RESERVED = r"^0*(?:0|10|127|255|192\.0*168|169\.0*254)\."
TLDS = ("com", "org", "net", "edu", "gov", "io", "info", "de", "fr", "es", "it", "nl", "uk", "eu", "us", "ca", "au", "in", "cn", "jp", "br", "ru", "ch", "at", "be", "se", "pl", "example", "test")
DIAL_CODES = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "52", "54", "55", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91")
FIRST_NAMES = tuple("""
aaron adam ahmed alan albert alex alexander alice amanda amy ana andrea andrew angela ann anna anne anthony antonio arthur
barbara benjamin bernd betty brian bruno camille carl carlos carol caroline catherine cecile charles charlotte chloe chris christian christine claire
claudia claus daniel david deborah denise dennis diana diego donald donna dorothy edward elena elisabeth elizabeth emily emma eric erik
eva fatima felix fernando frances francisco frank fritz gabriel george gerhard gloria grace hannah hans harold heather heidi helen helga
henri henry hugo ibrahim ines isabel jack jacob jacques james jan jane javier jean jennifer jessica joan johannes john jonathan
jose joseph juan judith julia julie karen karl kate katharina kevin klaus laura lena leo linda lisa louis lucas lucia luis
luise marc margaret maria marie mark martin mary matthew michael miguel monica nancy nicole nina olivia oscar pablo patricia paul
""".split())
#: Lengths of account numbers by country, as their registry gives them.
IBAN_LENGTHS = {"AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GR": 27, "HR": 21, "HU": 28, "IE": 22, "IS": 26, "IT": 27, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MT": 31, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SE": 24, "SI": 19, "SK": 24, "TR": 26}
#: What the words before a span say for each kind, and against it.
CUES = {
    "email": r"(?:e-?mail|mail|contact|write|address)", "ip": r"(?:host|server|address|\bip\b)", "card": r"(?:card|visa|credit|payment)", "phone": r"(?:phone|tel|call|mobile|fax|contact)",
    "account": r"(?:account|card|bank|credit|visa)", "ssn": r"(?:ssn|social)", "iban": r"(?:iban|account|bank)", "secret": r"(?:token|key|secret|passw|credential)", "name": r"(?:name|contact|dear|by)",
}
COUNTERS = {"secret": r"(?:sha-?[0-9]*|md5|commit|digest|checksum|hash|revision|etag)"}
COUNTER = r"(?:version|release|build|isbn|issn|doi|order|part|serial|invoice|figure|table|section|chapter|page|\bv\.?)"
#: How far before a span a cue may stand, and a counter, which must be next to it.
NEAR_CUE, NEXT_TO = r"[^\n]{0,24}$", r"(?:\s+(?:no|number|id)\b)?[\s.:#=\"']*$"

LABELERS = ("format", "checksum", "gazetteer", "context", "boundary")
SPAN = "array<struct<kind:int,start:int,end:int,votes:array<int>,features:array<string>>>"


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _vote(yes: Column, no: Column | None = None) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0) if no is not None else F.when(yes, 1).otherwise(0)


def _iban_rest(m: Column) -> Column:
    """The rest by 97 of the number that an account number stands for; 1 if it is right."""
    c = F.regexp_replace(m, "[^A-Z0-9]", "")
    turned = F.split(F.concat(F.substring(c, 5, 64), F.substring(c, 1, 4)), "")
    value = lambda x: F.ascii(x) - F.when(x.rlike("[0-9]"), 48).otherwise(55)
    return F.aggregate(F.filter(turned, lambda x: x != ""), F.lit(0), lambda acc, x: (acc * F.when(value(x) < 10, 10).otherwise(100) + value(x)) % 97)


def _votes(kind: int, m: Column, before: Column, after: Column) -> Column:
    """Of each labeler: 1 for personal data, -1 against, 0 if it can't tell, as where nearly all spans are alike."""
    name = KINDS[kind]
    none = F.lit(0)
    bounded = ~F.substring(before, -1, 1).rlike("[A-Za-z0-9]$") & ~after.rlike("^[A-Za-z0-9]")
    low = F.lower(before)
    against = low.rlike(COUNTER + NEXT_TO)
    votes = {"format": none, "checksum": none, "gazetteer": none, "context": _vote(low.rlike(CUES[name] + NEAR_CUE) & ~against, against), "boundary": -_vote(~bounded)}
    if name == "email":
        votes |= {"format": -_vote(F.length(m) > 254), "gazetteer": _vote(F.lower(F.substring_index(m, ".", -1)).isin(*TLDS))}
    elif name == "ip":
        votes |= {"checksum": _vote(~m.rlike(IP_RESERVED), m.rlike(IP_RESERVED))}
    elif name == "card":
        pass  # the kind itself takes the checksum
    elif name == "phone":
        votes |= {"gazetteer": _vote(m.rlike(r"^\+[17]") | F.regexp_extract(m, r"^\+([0-9]{1,2})", 1).isin(*DIAL_CODES))}
    elif name == "account":  # they have no checksum in common
        votes |= {"format": -_vote(m.rlike(r"(?:[\x20-][0-9]{1,2}){5}"))}
    elif name == "ssn":
        off = m.rlike("^(?:000|666|9)|-00-|-0000$")
        votes |= {"format": _vote(~off, off)}
    elif name == "iban":
        right = _iban_rest(m) == 1
        lengths = F.str_to_map(F.lit(",".join(f"{c}:{n}" for c, n in IBAN_LENGTHS.items())))
        listed = F.coalesce(F.element_at(lengths, F.substring(m, 1, 2)).cast("int") == F.length(F.regexp_replace(m, " ", "")), F.lit(False))
        votes |= {"checksum": _vote(right, ~right), "gazetteer": _vote(listed, ~listed)}
    elif name == "secret":
        against = low.rlike(COUNTERS["secret"] + NEXT_TO)
        votes |= {"format": -_vote(~m.rlike("[0-9]") | ~m.rlike("[A-Fa-f]")), "context": _vote(low.rlike(CUES[name] + NEAR_CUE) & ~against, against)}
    elif name == "name":
        first = F.lower(F.regexp_extract(m, r"\x20([A-Z][a-z]+)", 1))
        street = F.concat(m, after).rlike(r"\x20(?:Street|St|Road|Rd|Avenue|Ave|Boulevard|Blvd|Lane|Drive)(?:[^a-z]|$)")
        votes |= {"format": _vote(m.rlike(r"\x20[A-Z][a-z]+\x20[A-Z][a-z]+$") & ~street, street), "gazetteer": _vote(F.array_contains(F.split(F.lit(" ".join(FIRST_NAMES)), " "), first))}
    return F.array(*[votes[x].cast("int") for x in LABELERS])


def _shape(c: Column) -> Column:
    return F.when(c == "", "edge").when(c.rlike("[A-Za-z]"), "letter").when(c.rlike("[0-9]"), "digit").when(c.rlike(r"\s"), "blank").otherwise("other")


def _features(kind: int, m: Column, before: Column, after: Column, votes: Column) -> Column:
    """What the classifier sees: length, digits, surroundings, and what its checksum, listing and cues are."""
    name = KINDS[kind]
    size, share = F.length(m), 4 * F.length(_digits(m)) / F.length(m)
    parts = (
        ("length", F.when(size < 12, "s").when(size < 17, "m").when(size < 24, "l").otherwise("x")),
        ("digits", F.floor(share).cast("string")),
        ("before", _shape(F.substring(before, -1, 1))),
        ("after", _shape(F.substring(after, 1, 1))),
        *((x, F.get(votes, LABELERS.index(x)).cast("string")) for x in ("format", "checksum", "gazetteer", "context")),
    )
    return F.array(*[F.concat(F.lit(f"{name} {k} "), v) for k, v in parts])


def _spans(text: Column, pattern: str, kind, ok, trigger: Column) -> Column:
    """Matches of ``pattern`` in order that are ``ok``: what lies between the matches and the matches
    themselves add up to their places, in code points.  ``kind`` makes spans of all of them."""

    def each(s: Column) -> Column:
        starts = before_each(F.zip_with(F.slice(s["gaps"], F.lit(1), F.size(s["found"])), s["found"], lambda g, m: F.length(g) + F.length(m)), lambda a, b: a + b)

        def part(at: Column, i: Column) -> Column:
            m, gap = F.get(s["found"], i), F.get(s["gaps"], i)
            return F.struct(m.alias("m"), F.substring(gap, -40, 40).alias("before"), F.substring(F.get(s["gaps"], i + 1), 1, 4).alias("after"), (at + F.length(gap)).alias("start"))

        right = F.filter(F.transform(starts, part), lambda x: ok(x["m"]))
        return kind(F.transform(right, lambda x: F.struct(*[x[c].alias(c) for c in ("m", "before", "after", "start")], (x["start"] + F.length(x["m"])).alias("end"))))

    found = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"))
    return F.when(trigger, let(found, each)).otherwise(F.array().cast(SPAN))


def _as(kind: int):
    """Of parts (m, before, after, start, end): spans of ``kind``."""

    def make(parts: Column) -> Column:
        voted = F.transform(parts, lambda x: F.struct(x.alias("x"), _votes(kind, x["m"], x["before"], x["after"]).alias("votes")))
        return F.transform(voted, lambda y: F.struct(F.lit(kind).alias("kind"), y["x"]["start"].alias("start"), y["x"]["end"].alias("end"), y["votes"].alias("votes"), _features(kind, y["x"]["m"], y["x"]["before"], y["x"]["after"], y["votes"]).alias("features")))

    return make


def candidates(text: Column) -> Column:
    """All proposed spans of ``text`` with votes and features, by kind and start; spans of other kinds
    than the base ones are left out where they overlap a base span."""
    some_digit = text.rlike("[0-9]")
    n = lambda m: F.length(_digits(m))
    is_card = lambda m: (n(m) >= 16) & F.call_function("luhn_check", _digits(m))

    def cards_and_accounts(parts: Column) -> Column:
        return F.concat(_as(2)(F.filter(parts, lambda x: is_card(x["m"]))), _as(4)(F.filter(parts, lambda x: ~is_card(x["m"]))))

    any_match = lambda m: F.lit(True)
    found = F.concat(
        _spans(text, EMAIL, _as(0), any_match, F.contains(text, F.lit("@"))),
        _spans(text, IP, _as(1), lambda m: m.rlike(IP_VALID), some_digit & text.rlike(r"[0-9]\.[0-9]")),
        _spans(text, DIGITS, cards_and_accounts, any_match, text.rlike(r"[0-9](?:[\x20-]?[0-9]){12}")),
        _spans(text, PHONE, _as(3), lambda m: n(m).between(8, 15), text.rlike(r"\+[0-9]")),
        _spans(text, SSN, _as(5), any_match, text.rlike(r"[0-9]{3}-[0-9]{2}-")),
        _spans(text, IBAN, _as(6), any_match, text.rlike(r"[A-Z]{2}[0-9]{2}")),
        _spans(text, SECRET, _as(7), any_match, text.rlike(r"[A-Fa-f0-9]{32}")),
        _spans(text, NAME, _as(8), any_match, F.contains(text, F.lit("Mr")) | F.contains(text, F.lit("Ms")) | F.contains(text, F.lit("Dr")) | F.contains(text, F.lit("Prof"))),
    )

    def settle(spans: Column) -> Column:
        base = F.filter(spans, lambda s: s["kind"] < len(BASE))
        return let(base, lambda b: F.filter(spans, lambda s: (s["kind"] < len(BASE)) | ~F.exists(b, lambda x: (x["start"] < s["end"]) & (s["start"] < x["end"]))))

    return let(found, lambda f: F.when(F.size(f) == 0, f).otherwise(F.sort_array(settle(f))))


@lru_cache(16)
def _candidates(application: str, text_col: str) -> Column:
    """``candidates`` of a column, null for empty; made once, as that takes the driver thousands of calls."""
    return candidates(F.coalesce(F.col(text_col), F.lit("")))


@dataclass(frozen=True)
class Model:
    """What fitting gives: reliability of each labeler, share of personal data by kind, and log odds
    of the classifier's features; kinds that were not seen are taken as personal data."""

    reliability: dict[str, float] = field(default_factory=dict)
    prior: dict[str, float] = field(default_factory=dict)
    weights: dict[str, float] = field(default_factory=dict)

    def keeps(self, kind: Column, features: Column) -> Column:
        """Whether the classifier takes a span for personal data; base kinds stay in any case."""
        odds = F.element_at(F.expr("map(" + ", ".join(f"{k}, {math.log(self.prior.get(n, 0.5) / (1 - self.prior.get(n, 0.5)))!r}D" for k, n in enumerate(KINDS)) + ")"), kind)
        if self.weights:
            table = F.expr("map(" + ", ".join(f"'{f}', {w!r}D" for f, w in sorted(self.weights.items())) + ")")
            odds = odds + F.aggregate(features, F.lit(0.0), lambda acc, f: acc + F.coalesce(F.element_at(table, f), F.lit(0.0)))
        return (kind < len(BASE)) | (odds >= 0)


def fit(docs: DataFrame, text_col: str = "text", rounds: int = 50) -> Model:
    """Labeler reliabilities and the classifier, from the candidates of all rows of ``docs``.

    Null and empty texts have none; repeated rows count as often as they stand; without candidates the model
    keeps what it is shown.  Other columns have no bearing."""
    spans = docs.select(F.explode(_candidates(docs.sparkSession.sparkContext.applicationId, text_col)).alias("s")).select("s.kind", "s.votes", "s.features")
    counts = [(KINDS[r["kind"]], tuple(r["votes"]), tuple(r["features"]), r["count"]) for r in spans.groupBy("kind", "votes", "features").count().collect()]
    right = dict.fromkeys(LABELERS, 0.8)
    seen = sorted({c[0] for c in counts}, key=KINDS.index)
    start = 0.6  # a pattern is right more often than not; spans on which no labeler votes keep to that
    prior = dict.fromkeys(seen, start)

    def posterior(kind: str, votes: tuple[int, ...]) -> float:
        if not any(votes):
            return start
        z = math.log(prior[kind] / (1 - prior[kind]))
        z += sum(v * math.log(right[x] / (1 - right[x])) for x, v in zip(LABELERS, votes, strict=True))
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))

    for _ in range(rounds):
        agree = {x: [4.0, 5.0] for x in LABELERS}  # the start counts as five votes, four of them right
        of = {k: [3.0, 5.0] for k in seen}
        for kind, votes, _, n in counts:
            if not any(votes):
                continue
            p = posterior(kind, votes)
            of[kind][0] += n * p
            of[kind][1] += n
            for x, v in zip(LABELERS, votes, strict=True):
                if v:
                    agree[x][0] += n * (p if v > 0 else 1 - p)
                    agree[x][1] += n
        right = {x: min(0.99, max(0.55, a / b)) for x, (a, b) in agree.items()}  # better than chance
        prior = {k: min(0.99, max(0.01, a / b)) for k, (a, b) in of.items()}

    weights: dict[str, list[float]] = {}
    for kind, votes, features, n in counts:
        p = posterior(kind, votes)
        for f in features:
            w = weights.setdefault(f, [0.0, 0.0])
            w[0] += n * p
            w[1] += n * (1 - p)
    mass = {k: [sum(n * posterior(kk, v) for kk, v, _, n in counts if kk == k), sum(n * (1 - posterior(kk, v)) for kk, v, _, n in counts if kk == k)] for k in seen}
    # smoothed by one span of average kind, so that rare features tell nothing
    share = {k: x / max(1e-9, x + y) for k, (x, y) in mass.items()}

    def weight(kind: str, a: float, b: float) -> float:
        p = min(0.999, max(0.001, share[kind]))
        return math.log((a + p) / (mass[kind][0] + p)) - math.log((b + 1 - p) / (mass[kind][1] + 1 - p))

    odds = {f: weight(f.split()[0], a, b) for f, (a, b) in weights.items()}
    return Model(right, {k: min(0.99, max(0.01, p)) for k, p in share.items()}, odds)


def find(docs: DataFrame, model: Model | None = None, text_col: str = "text", name: str = "spans") -> DataFrame:
    """``docs`` with a column ``name``: personal data of each text as an array of (kind, start, end),
    by kind and start, code points, end exclusive; ``kind`` is a place in KINDS.

    Null and empty texts have none; rows are independent, so repeats have no bearing; an empty
    table keeps its columns.  ``model``: fitted on ``docs`` if None."""
    model = model or fit(docs, text_col)
    found = F.filter(_candidates(docs.sparkSession.sparkContext.applicationId, text_col), lambda s: model.keeps(s["kind"], s["features"]))
    return docs.withColumn(name, F.transform(found, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))))


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == KINDS.index(kind))).cast("long")


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, model: Model | None = None, text_col: str = "text") -> DataFrame:
    """``docs`` with each span of personal data in ``text_col`` replaced by its kind in angle brackets;
    of overlapping spans the first names the whole.

    Null texts stay null and empty ones empty; rows are independent, so repeats have no bearing; an empty table
    keeps its columns; columns of any other name pass, but for the reserved ``__spans__``, which is refused."""
    refuse_reserved(docs)
    tags = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])
    text = F.col(text_col)

    def rewrite(spans: Column) -> Column:
        by_start = F.sort_array(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

        def parts(ordered: Column) -> Column:
            def part(reached: Column, i: Column) -> Column:  # how far the spans before it reach
                x = F.get(ordered, i)
                gap = F.substring(text, reached + 1, x["start"] - reached)
                return F.when(x["start"] >= reached, F.concat(gap, F.get(tags, x["kind"]))).otherwise("")

            ends = F.transform(ordered, lambda s: s["end"])
            return F.concat(F.array_join(F.transform(before_each(ends, F.greatest), part), ""), F.substring(text, F.array_max(ends) + 1, F.length(text)))

        return F.when(F.size(spans) == 0, text).otherwise(let(by_start, parts))

    hold = "__spans__"
    return find(docs, model, text_col, hold).withColumn(text_col, F.when(text.isNotNull(), rewrite(F.col(hold)))).drop(hold)
