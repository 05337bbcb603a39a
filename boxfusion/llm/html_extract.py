"""Main text of web pages as a maximum-scoring subsequence.

A page is a sequence of tags and of blocks of words.  Each word has the score of its block: log odds,
learned from labelled pages, of the tags and class names around it, of its links, length and
punctuation.  Each tag has a negative score, learned from the same pages.  One linear scan finds the
contiguous region of the greatest sum, which then becomes the innermost container around it: short or
linked blocks of an article (headings, lists, tables, captions) stay whatever their own score.  Left
out are elements in it whose tag and class names, by the labelled pages, hold no main text: menus,
asides, footers, forms, notices, adverts, comments."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows

TOKEN = re.compile(r"""<!--|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s>/]*+)((?:"[^"]*+"|'[^']*+'|[^'">])*+)>|<(/?)([a-zA-Z][^\s>/]*+)([^>]*+)>""")
ATTRIBUTE = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
NAME_PART = re.compile(r"[a-z]+|[A-Z][a-z]*")
COMMENT_END = re.compile(r"--!?>")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text of the page, up to their end tag.
OPAQUE = frozenset("script style title textarea noscript template iframe svg math object canvas audio video".split())
#: The same, but a tag that such an element can't hold ends it too.
CONTROLS = frozenset("select option button".split())
BEYOND_CONTROL = re.compile(r"<(?=/?(?:option|select|datalist|button|form|fieldset|body|html|article|main|section|nav|header|footer|aside|p|h[1-6]|ul|ol|table)\b)", re.I)
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements that a new one of the same kind ends, and what an open one of theirs is not looked for beyond.
SELF_ENDING = frozenset("p li dt dd tr td th".split())
BARRIERS = frozenset("ul ol dl table div article section main aside td th".split())
#: Elements that end an open paragraph.
ENDS_PARAGRAPH = frozenset("address article aside blockquote center details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre search section summary table ul".split())

CONTAINERS = frozenset(("div", "article", "main", "section"))
#: Elements that by themselves tell nothing on whether they belong to the main text.
NEUTRAL = (INLINE | ENDS_PARAGRAPH | SELF_ENDING | frozenset("html head body caption colgroup tbody thead tfoot hgroup".split())) - frozenset("aside footer form fieldset header nav menu dialog search".split())


@dataclass
class Element:
    """A CONTAINERS element, or one of some evidence: its name, features other than of NEUTRAL tags, and
    the tokens that it holds, from ``begin`` to before ``end``."""

    name: str
    evidence: tuple[str, ...]
    begin: int
    end: int = 0


@dataclass
class Block:
    """Words between block-level tags."""

    text: str
    words: int
    features: tuple[str, ...]
    box: int = -1  # the innermost CONTAINERS element around it, by its number
    alien: int = -1  # the innermost element around it that is none of a main text


class _Open:
    """An open element, with what holds for all open ones up to it."""

    __slots__ = ("alien", "box", "element", "features", "name")

    def __init__(self, name: str, features: tuple[str, ...], element: Element | None, box: int, alien: int) -> None:
        self.name, self.features, self.element, self.box, self.alien = name, features, element, box, alien


def parse(html: str, weights: Weights | None = None) -> tuple[list[Block | int], list[Element]]:
    """The page as blocks, and between them the number of tags; and its elements in order.

    With ``weights``, features that it doesn't know are left out, so that what is held for a block
    does not grow with the depth of its elements, and elements that it takes for none of a main
    text are told to their blocks.  End tags are as good as optional: what a page leaves open is closed where
    HTML implies it, and an element without an end never takes the rest of the page with it, but for a
    script or style."""
    out: list[Block | int] = []
    elements: list[Element] = []
    root = _Open("", (), None, -1, -1)
    stack: list[_Open] = [root]
    opened: Counter[str] = Counter()
    chunks: list[str] = []
    around = root
    begun = False
    tags = linked = 0
    endless: set[str] = set()
    at, end = 0, len(html)
    last_tag = html.rfind(">") + 1

    def flush() -> None:
        nonlocal tags, linked, begun
        text = " ".join("".join(chunks).split())
        if text:
            if tags:
                out.append(tags)
                tags = 0
            n = text.count(" ") + 1
            out.append(Block(text, n, _block_features(around.features, text, n, linked), around.box, around.alien))
        chunks.clear()
        linked, begun = 0, False

    def add(raw: str) -> None:
        nonlocal linked, around, begun
        if raw:
            text = unescape(raw) if "&" in raw else raw
            chunks.append(text)
            if opened["a"]:
                linked += len(text.split())
            if not begun and not text.isspace():
                around, begun = stack[-1], True

    def close(k: int) -> None:
        """The open elements from the ``k``-th on end."""
        for x in stack[k:]:
            opened[x.name] -= 1
            if x.element is not None:
                x.element.end = len(out)
        del stack[k:]

    def last(name: str, barriers: frozenset[str]) -> int:
        """The place of the innermost open ``name`` that no barrier hides, or 0."""
        if opened[name] > 0:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name == name:
                    return k
                if stack[k].name in barriers:
                    break
        return 0

    while at < end:
        m = TOKEN.search(html, at, last_tag) if at < last_tag else None
        if not m:
            add(html[at:])
            break
        add(html[at : m.start()])
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            if m[0] == "<!--":  # <!--> and <!---> are whole comments
                done = COMMENT_END.search(html, at - 2)
                at = done.end() if done else end
            continue
        tags += 1
        if name not in INLINE:
            flush()
        attributes = m[3] or m[6] or ""
        if m[1] or m[4]:
            if opened[name] > 0:
                if name not in INLINE:
                    close(last(name, frozenset()))
                else:  # misplaced ends of inline elements close nothing around them
                    k = last(name, frozenset())
                    if all(x.name in INLINE for x in stack[k + 1 :]):
                        close(k)
                    else:
                        opened[name] -= 1
                        del stack[k]
        elif name in OPAQUE or name in CONTROLS:
            raw = name in ("script", "style")
            if attributes.endswith("/") and not raw:
                continue
            done = None if name in endless else re.compile(rf"</{re.escape(name)}\b[^>]*+>", re.I).search(html, at)
            if done is None:  # nor will a later one have an end
                endless.add(name)
            if name in CONTROLS:
                beyond = None if "<" in endless else BEYOND_CONTROL.search(html, at, done.start() if done else end)
                if beyond is None and done is None:
                    endless.add("<")
                at = beyond.start() if beyond else done.end() if done else at
            elif done:
                at = done.end()
            elif raw:
                at = end
            elif name in ("title", "textarea"):
                at = next_tag if (next_tag := html.find("<", at)) >= 0 else end
        elif name not in VOID:
            if name in ENDS_PARAGRAPH and (k := last("p", BARRIERS)):
                close(k)
            if name in SELF_ENDING and (k := last(name, BARRIERS - {name})):
                close(k)
            top = stack[-1]
            inside = opened["article"] > 0 or opened["main"] > 0
            found = _tag_features(name, attributes, inside)
            evidence = tuple(f for f in found if f.removesuffix(" inside") not in NEUTRAL) if name not in INLINE else ()
            box, alien, element = top.box, top.alien, None
            if name in CONTAINERS or evidence:
                element = Element(name, evidence, len(out))
                if name in CONTAINERS:
                    box = len(elements)
                if weights is not None and weights.alien(evidence):
                    alien = len(elements)
                elements.append(element)
            if weights is not None:
                found = tuple(f for f in found if f in weights.of)
            new = tuple(f for f in dict.fromkeys(found) if f not in top.features)
            stack.append(_Open(name, top.features + new if new else top.features, element, box, alien))
            opened[name] += 1
    flush()
    close(1)
    if tags:
        out.append(tags)
    return out, elements


def _tag_features(name: str, attributes: str, inside: bool) -> tuple[str, ...]:
    found = () if name in INLINE else (f"{name} inside" if inside and name in ("header", "section", "div") else name,)
    if "=" in attributes:
        found += tuple(f".{w.lower()}" for m in ATTRIBUTE.finditer(attributes) for w in NAME_PART.findall(m[1] or m[2] or m[3] or ""))
    return found


def _block_features(around: tuple[str, ...], text: str, words: int, linked: int) -> tuple[str, ...]:
    return (*around, "linked" if 2 * linked > words else "unlinked", "long" if words >= 12 else "short", "ended" if text[-1] in ".!?…" else "open")


@dataclass(frozen=True)
class Weights:
    of: dict[str, float]
    bias: float
    tag: float
    element: dict[str, float]

    def block(self, b: Block) -> float:
        """Of each word of ``b``."""
        return max(-3.0, min(3.0, self.bias + sum(self.of.get(f, 0.0) for f in b.features)))

    def alien(self, evidence: tuple[str, ...]) -> bool:
        """Whether an element of this ``evidence`` is none of a main text, wherever it stands."""
        return bool(evidence) and sum(self.element.get(f, 0.0) for f in dict.fromkeys(evidence)) < -1


def train(pages: list[str], mark: str = "\u2060") -> Weights:
    """From labelled pages, in which ``mark`` begins each block of the main text: a logistic regression of features on whether a block lies
    in the main text, and the log odds of a tag there, both scaled to words; and the log odds of an
    element's evidence, by whether it holds main text."""
    rows: list[tuple[str, ...]] = []
    label: list[bool] = []
    words, tags = Counter(), Counter()
    holds, lacks = Counter(), Counter()
    for html in pages:
        waiting, last = 0, False
        tokens, elements = parse(html)
        marked = np.cumsum([0, *(isinstance(b, Block) and mark in b.text for b in tokens)])
        for x in elements:
            (holds if marked[x.end] > marked[x.begin] else lacks).update(set(x.evidence))
        for b in tokens:
            if not isinstance(b, Block):
                waiting = b
                continue
            inside = mark in b.text
            rows.append(b.features)
            label.append(inside)
            words[inside] += b.words
            tags[inside and last] += waiting
            waiting, last = 0, inside
    names = sorted({f for r in rows for f in r})
    column = {f: k for k, f in enumerate(names)}
    x, y = np.zeros((len(rows), len(names) + 1)), np.array(label, float)
    x[:, -1] = 1
    for k, r in enumerate(rows):
        x[k, [column[f] for f in r]] = 1
    w = np.zeros(x.shape[1])
    for _ in range(25):  # Newton steps, with a little weight decay
        p = 1 / (1 + np.exp(-x @ w))
        w += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(len(w)), x.T @ (y - p) - 0.05 * w)
    rate = {k: (tags[k] + 1) / (words[k] + tags[k] + 1) for k in (True, False)}
    evidence = {f: math.log((holds[f] + 1) / (lacks[f] + 1)) for f in sorted({*holds, *lacks})}
    return Weights(dict(zip(names, w[:-1].tolist(), strict=True)), float(w[-1]), max(-0.5, min(-0.05, 0.1 * math.log(rate[True] / rate[False]))), evidence)


def best_region(scores: list[float]) -> tuple[int, int]:
    """The contiguous region of the greatest sum, (0, 0) if none is positive; of equals the first."""
    best = total = 0.0
    where, start = (0, 0), 0
    for k, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, k
        total += s
        if total > best:
            best, where = total, (start, k + 1)
    return where


#: Elements that hold all of a page's text, whatever their names.
WHOLE = ("html", "body", "main", "article")


def by_text(tokens: list, elements: list[Element], w: Weights) -> list[float]:
    """Scores of the words of each token for a page in which no region is positive, as nothing around its text has a known
    name: blocks count by length, end and links alone, against the mean of the page's blocks, and what stands in an element
    that holds no main text stays negative.  All are negative if no block is prose: unlinked, of 12 words or more, and ended."""
    told = lambda b: b.features[-3:]
    outside = lambda b: b.alien >= 0 and elements[b.alien].name not in WHOLE
    blocks = [t for t in tokens if isinstance(t, Block)]
    if not any(told(b) == ("unlinked", "long", "ended") and not outside(b) for b in blocks):
        return [-1.0] * len(tokens)
    value = lambda b: -3.0 if outside(b) else sum(w.of.get(f, 0.0) for f in told(b))
    mean = sum(map(value, blocks)) / len(blocks)
    return [max(-3.0, min(3.0, value(t) - mean + 0.01)) if isinstance(t, Block) else w.tag for t in tokens]


def extract(html: str | None, weights: Weights | None = None) -> str:
    """The main text; '' for null, empty or wordless pages, or if no block scores positive and none is prose."""
    if not html:
        return ""
    w = weights or default_weights()
    tokens, elements = parse(html, w)
    for scores in (lambda: [w.block(t) if isinstance(t, Block) else w.tag for t in tokens], lambda: by_text(tokens, elements, w)):
        each = scores()
        start, end = best_region([s * (t.words if isinstance(t, Block) else t) for s, t in zip(each, tokens, strict=True)])
        good = [k for k in range(start, end) if isinstance(tokens[k], Block) and each[k] > 0]
        if good:
            break
    else:
        return ""
    # an advert amid a text may cost more than what stands beyond it brings, and headings or lists may
    # score little: the region grows to the article, else the innermost container, that holds it, but for aliens in that
    around = [n for n, x in enumerate(elements) if x.name in CONTAINERS and x.begin <= good[0] and good[-1] < x.end]
    home = max((n for n in around if elements[n].name == "article"), default=max(around, default=-1))
    whole = home >= 0 and (elements[home].name in ("article", "main") or sum(w.element.get(f, 0.0) for f in elements[home].evidence) > 1)
    first, last = (elements[home].begin, elements[home].end) if home >= 0 else (start, end)
    text = []
    for k in range(first, last):
        t = tokens[k]
        # what scores badly beyond the region, in a container of its own, belongs only to an article
        if isinstance(t, Block) and t.alien <= home and (each[k] > 0 or start <= k < end or whole or t.box == home):
            text.append(t.text)
    return " ".join(text)


@lru_cache(1)
def default_weights() -> Weights:
    from .html_labelled import pages

    return train(pages())


def main_text(pages: DataFrame, html_col: str = "html", text_col: str = "text", weights: Weights | None = None) -> DataFrame:
    """``pages`` with a column ``text_col``, the main text of the whole ``html_col``.

    Rows are independent: ties, repeats and other columns have no bearing; an empty table keeps its
    columns; null pages give ''.  A text's blocks are joined by one blank in page order."""
    arrow_rows(pages.sparkSession)
    w = weights or default_weights()

    @F.arrow_udf("string")
    def run(html: pa.Array) -> pa.Array:
        return pa.array([extract(h, w) for h in html.to_pylist()], pa.string())

    return pages.withColumn(text_col, run(F.col(html_col).cast("string")))
