"""Main text of pages: hand cases, pages of a rule that training does not share, and the query against brute force."""

from __future__ import annotations

import html
import random
import re
import time

import pandas as pd
import pytest

from boxfusion.llm import html_extract, queries
from tests.conftest import DATA

SF = f"{DATA}/sf0.001"
LINE = "The river runs under the old bridge and past the market, where people buy bread."

#: What stands amid an article, and what of it is main text.
AMID = {
    "<svg viewBox='0'/>": "", "<iframe src=x />": "", "<object data=x>": "", "<video src=x>": "", "<canvas>": "", "<button>Go": "", "<button>Go</button>": "", "<svg><title>i</title></svg>": "",
    "<math><mi>x</mi></math>": "", "<title>T": "", "<template><p>x</p></template>": "", "<noscript><img></noscript>": "", "<hr>": "", "<!---->": "", "<!-->": "", "<!-- a > b -->": "",
    "<datalist><option value=a><option value=b></datalist>": "", "<select><option>a<option>b</select>": "", "<form><input><button>Go</form>": "", "<div class='ad'>Buy now this.</div>": "",
    "<aside><p>Other things that we wrote before.</p></aside>": "", "<footer>Posted in news</footer>": "", "<div class=comments><p>I liked it.</p></div>": "", "<nav><a href=/>Up</a></nav>": "",
    "<h2>Results</h2>": "Results", "<pre>x = 1</pre>": "x = 1", "<ul><li>Two eggs</li><li>Milk</ul>": "Two eggs Milk", "<figure><img src=x><figcaption>Old bridge</figcaption></figure>": "Old bridge",
    "<details><summary>More</summary></details>": "More", "<table><caption>T1</caption><thead><tr><th>Year<th>Size</thead><tr><td>1<td>2</table>": "T1 Year Size 1 2", "<dl><dt>A<dd>B</dl>": "A B",
    "<section><h3>In</h3><p>Short.</p></section>": "In Short.", "<a href=x>A link of its own</a>": "A link of its own", "<p><a href=x>A link</a></p>": "A link", "<span><div>One</span></div>": "One",
    "<a href=x><div>One</a></div>": "One", "<p class=notice>Mind the gap<div>One</div>": "One", "<blockquote>Quote</blockquote>": "Quote", "<p>a&nbsp;&lt;b&gt;&#x41;\n\t c</p>": "a <b>A c",
}


@pytest.mark.parametrize("amid", AMID)
def test_nothing_of_an_article_is_lost(amid):
    page = f"<html><head><title>T</title></head><body><nav><a href=/>Home</a></nav><article><h1>Head</h1><p>{LINE}</p>{amid}<p>{LINE}</p></article><footer>All of us.</footer></body></html>"
    assert html_extract.extract(page) == " ".join(x for x in ("Head", LINE, AMID[amid], LINE) if x)


@pytest.mark.parametrize("page", [f"<head><title>T</title><p>{LINE}</p>", f"<head><title>T</title><article><p>{LINE}</article>", f"<title>T</title><p>{LINE}", f"<!DOCTYPE html><p>{LINE}<script>var a = '<p>no</p>'", f"<p>{LINE}<style>p {{"])
def test_optional_tags(page):
    assert html_extract.extract(page) == LINE


def made_pages(n: int, seed: int) -> list[tuple[str, str]]:
    """(html, main text), of words, layouts and blocks that the labelled pages do not have."""
    r = random.Random(seed)
    word = lambda: "".join(r.choices("abcdeghiklmnoprstu", k=r.randint(2, 9)))
    say = lambda a, b, end=".": " ".join(word() for _ in range(r.randint(a, b))).capitalize() + end
    out = []
    for _ in range(n):
        want: list[str] = []

        def block(tag: str, text: str, want: list[str] = want) -> str:
            want.append(text)
            return f"<{tag}>{html.escape(text)}</{tag}>"

        def part() -> str:
            k = r.randrange(9)
            if k < 4:
                return block("p", say(12, 70))
            if k == 4:
                return block("h2", say(1, 4, ""))
            if k == 5:
                return "<ul>" + "".join(block("li", say(1, 9, "")) for _ in range(r.randint(1, 4))) + "</ul>"
            if k == 6:
                return "<figure><img src=a.png>" + block("figcaption", say(2, 6, "")) + "</figure>"
            if k == 7:
                return "<table><tr>" + block("th", word()) + block("th", word()) + "</tr><tr>" + block("td", "7") + block("td", word()) + "</tr></table>"
            return block("pre", f"{word()} = {word()}") + '<div class="ad-box"><p>' + say(8, 14) + "</p></div>"

        head = block("h1", say(2, 7, ""))
        body = block("p", say(30, 60)) + "".join(part() for _ in range(r.randint(2, 12))) + block("p", say(20, 60))
        main = r.choice(('<article class="hentry">{}{}</article>', '<main><article id="a1"><header>{}</header><section>{}</section></article></main>', '<div id="page"><div class="main-content">{}{}</div></div>')).format(head, body)
        links = "".join(f'<li><a href="/{word()}">{say(1, 3, "")}</a></li>' for _ in range(r.randint(3, 9)))
        above = r.choice((f"<nav><ul>{links}</ul></nav>", f'<div class="site-menu"><ul>{links}</ul></div>', f'<header class="site-header"><p>{say(3, 8)}</p><ul>{links}</ul></header>'))
        below = r.choice((f"<aside><h3>{say(1, 3, '')}</h3><p>{say(10, 40)}</p></aside>", f'<section id="comments"><p>{say(10, 50)}</p><p>{say(5, 40)}</p></section>', ""))
        out.append((f"<!DOCTYPE html><html><head><title>{say(2, 5, '')}</title></head><body>{above}{main}{below}<footer><p>{say(4, 30)}</p></footer></body></html>", " ".join(want)))
    return out


def test_pages_of_another_rule(spark, tmp_path):
    """The query over them, repeated rows, null and empty pages, and a column of a clashing name."""
    made = made_pages(150, 5)
    rows = [(k, f"u{k}", h, "x") for k, (h, _) in enumerate(made)] + [(0, "u0", made[0][0], "x"), (200, None, None, None), (201, "v", "", None), (None, None, " ", None)]
    spark.createDataFrame(rows, "page_id long, url string, html string, text string").write.parquet(str(tmp_path / "pages.parquet"))
    got = queries.op1_html_text(spark, str(tmp_path)).collect()
    want = {k: t for k, (_, t) in enumerate(made)} | {200: "", 201: "", None: ""}
    assert len(got) == len(rows) and all(x["n_chars"] == len(x["text"]) for x in got)
    assert all(x["text"] == want[x["page_id"]] for x in got)


def test_query_equals_brute_force(spark):
    """On the given pages the article is what its tags hold."""
    pages = pd.read_parquet(f"{SF}/pages.parquet").set_index("page_id").html
    for x in queries.op1_html_text(spark, SF).collect():
        inner = re.search(r"<article>(.*)</article>", pages[x["page_id"]], re.S)[1]
        inner = re.sub(r"<!--.*?-->|<script>.*?</script>|<style>.*?</style>|<div class=\"ad\">.*?</div>", " ", inner, flags=re.S)
        assert x["text"] == " ".join(html.unescape(re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", inner))).split())


@pytest.mark.parametrize("part", ["<div>x", "<p>x", "<b>x", "<div class=a{}>x", "<button>x", "<span><div></span>x", "<a><div></a>x", "</b><b><i>", "<a ", "<a '>", "<svg>", "<option>", "<select>", "<!--"])
def test_time_is_linear(part):
    began = time.perf_counter()
    html_extract.extract("".join(part.replace("{}", str(k)) for k in range(50_000)))
    assert time.perf_counter() - began < 6


@pytest.mark.parametrize("paragraphs", [1, 6, 40])
@pytest.mark.parametrize("tag", ["div", "section", "td"])
def test_pages_of_unknown_names(tag, paragraphs):
    """Articles in elements of any class or none, in the body itself, in text parted by line breaks, below a body with classes."""
    r = random.Random(paragraphs)
    word = lambda: r.choice("stone river walked evening people under bridge carried letters slowly toward harbour where ships waited".split())
    ps = [" ".join(word() for _ in range(23)).capitalize() + "." for _ in range(paragraphs)]
    inner, want = "<h1>A heading</h1>" + "".join(f"<p>{p}</p>" for p in ps), "A heading " + " ".join(ps)
    nav = "<nav><ul>" + "".join(f'<li><a href="/{k}">Link {k}</a></li>' for k in range(5)) + "</ul></nav>"
    page = lambda x, body="": f"<html><head><title>T</title></head><body{body}>{nav}{x}<footer><p>Contact us by mail or phone at any time of day.</p></footer></body></html>"
    names = "post entry story blog page container wrapper prose mw-parser-output x1 layout-2 columns center inner box node region copy reading post-12".split()
    for name in [None, *names]:
        made = f'<{tag} class="{name}">{inner}</{tag}>' if name else f"<{tag}>{inner}</{tag}>"
        assert html_extract.extract(page(f"<table><tr>{made}</tr></table>" if tag == "td" else made)) == want, name
    assert html_extract.extract(page(inner)) == want
    assert html_extract.extract(page("<div>" + "<br><br>".join(ps) + "</div>")) == " ".join(ps)
    assert html_extract.extract(page(f"<article>{inner}</article>", ' class="has-sidebar no-banner"')) == want
    assert html_extract.extract(page("")) == "" == html_extract.extract(f"<nav>{ps[0]}</nav>")
