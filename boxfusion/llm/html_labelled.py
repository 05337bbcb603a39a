"""Labelled pages from which HTML extraction learns its weights: layouts with a main text amid menus,
headers, footers, sidebars, notices, adverts, forms and reader comments.  They are made by a rule,
so that each kind of surrounding meets each kind of main text."""

from __future__ import annotations

import random

WORDS = "river market winter letter garden teacher machine window history music village science open early quiet second public found carry build watch known light under north between".split()
MENUS = ("<nav>{links}</nav>", '<div class="menu">{links}</div>', '<ul id="nav" class="navbar">{links}</ul>', '<div class="breadcrumb">{links}</div>', '<div role="navigation">{links}</div>', '<div class="topnav toolbar">{links}</div>', '<div class="pagination pager">{links}</div>', '<ul class="breadcrumbs">{links}</ul>', "<menu>{links}</menu>")
HEADERS = ("<header><h2>{title}</h2>{links}</header>", '<div id="header"><h1>{title}</h1><p>{short}</p></div>', '<div class="masthead top">{short}</div>')
ASIDES = (
    "<aside><h3>{title}</h3><p>{text}</p>{links}</aside>", '<div class="sidebar"><h3>{title}</h3><p>{text}</p></div>', '<div class="related widget">{links}</div>',
    '<div class="ad">{text}</div>', '<div class="advert banner"><p>{text}</p></div>', '<div id="ads" class="sponsored promo">{short}</div>', '<section class="promo">{text}</section>',
    '<div class="cookie notice"><p>{text}</p></div>', '<div id="consent" class="alert banner">{text}</div>', '<div class="newsletter popup"><p>{text}</p></div>', '<div role="banner" class="notice">{text}</div>',
    '<form action="/s"><label>{short}</label><input name="q"><p>{short}</p></form>', '<form class="signup login"><fieldset><legend>{title}</legend><p>{text}</p></fieldset></form>', '<div class="share social">{links}</div>',
    '<div class="recommended popular">{links}</div>', '<div class="trending"><p>{text}</p></div>', '<div class="sponsor advertisement">{text}</div>', '<div class="gdpr cookies">{text}</div>', '<div class="modal overlay"><p>{text}</p></div>', "<dialog><p>{text}</p></dialog>",
    '<div class="subscribe subscription"><h3>{title}</h3><p>{text}</p></div>', '<div class="disclaimer"><p>{text}</p></div>', '<div class="search"><p>{short}</p></div>', '<div class="sharing"><p>{short}</p>{links}</div>',
)
COMMENTS = ('<div class="comments"><h3>{title}</h3><div class="comment"><p>{text}</p></div><p>{text}</p></div>', '<section id="comments"><ol class="commentlist"><li><p>{text}</p></li></ol></section>', '<div id="respond" class="discussion replies"><p>{text}</p></div>', '<div id="disqus" class="reactions"><div class="reply"><p>{text}</p></div></div>')
FOOTERS = ("<footer>{short} {text}</footer>", '<div id="footer"><p>{text}</p>{links}</div>', '<footer class="bottom legal"><p>{text}</p></footer>', '<div class="copyright">{short}</div>', '<div class="colophon"><p>{text}</p></div>')
MAINS = ("<article>{main}</article>", "<main><article>{main}</article></main>", '<div id="content">{main}</div>', '<div class="post entry"><div class="entry content">{main}</div></div>', "<main>{main}</main>", '<article class="story"><header><h1>{head}</h1></header>{main}</article>', '<section class="article body text">{main}</section>', '<div role="main">{main}</div>')


MARK = "\u2060"


def pages(n: int = 400, seed: int = 7) -> list[str]:
    """Pages in which MARK begins each block of the main text."""
    r = random.Random(seed)

    def say(low: int, high: int, end: str = ".") -> str:
        return " ".join(r.choice(WORDS) for _ in range(r.randint(low, high))).capitalize() + end

    def fill(layout: str) -> str:
        links = "<ul>" + "".join(f'<li><a href="/{k}">{say(1, 2, "")}</a></li>' for k in range(r.randint(2, 7))) + "</ul>"
        return layout.format(links=links, title=say(2, 5, ""), short=say(2, 6, ""), text=say(5, 40))

    out = []
    for _ in range(n):
        layout, head = r.choice(MAINS), MARK + say(3, 9, r.choice(("", ".")))
        parts = [MARK + say(1, 90, r.choice((".", ".", ".", "!"))) for _ in range(r.randint(3, 9))]
        title = [] if "{head}" in layout else [head]
        body = "".join(f"<h1>{t}</h1>" for t in title) + "".join(f"<{'p' if r.random() < 0.85 else r.choice(('h2', 'blockquote', 'pre', 'li', 'td'))}>{p}" + "</p>" * (r.random() < 0.9) for p in parts)
        if r.random() < 0.4:  # an advert, form or notice amid the main text
            at = body.rindex("<", 0, len(body) // 2 + 30) if body.startswith("<h1>") else 0
            while at and not body[at:].startswith(("<p>", "<h2>")):
                at = body.rfind("<", 0, at)
            body = body[: max(at, 0)] + fill(r.choice(ASIDES)) + body[max(at, 0) :]
        aside = [fill(x) for x in r.sample(ASIDES, r.randint(2, 5))]
        cut = r.randint(0, len(aside))
        before = [fill(r.choice(MENUS)), *([fill(r.choice(HEADERS))] if r.random() < 0.6 else []), *aside[:cut]]
        after = [*aside[cut:], *([fill(r.choice(COMMENTS))] if r.random() < 0.6 else []), fill(r.choice(FOOTERS))]
        out.append(f"<html><head><title>{head[1:]}</title></head><body>{''.join(before)}{layout.format(main=body, head=head)}{''.join(after)}</body></html>")
    return out
