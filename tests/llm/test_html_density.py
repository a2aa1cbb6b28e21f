"""Operator 1: the article is whole whatever its parts are called, and densities find it without telling elements."""

import math
import re

import pytest

from serion.llm import html_extract
from serion.llm.storage import table
from tests.llm.test_operators import SF

_P = "<p>" + "word " * 40 + "</p>"


def _page(inside, wrap):
    return f"<body><nav><a href=x>menu</a></nav><{wrap}>{_P}{inside}{_P}</{wrap}><footer>foot</footer></body>"


@pytest.mark.parametrize("wrap", ["article", "main", "div", "div class=post"])
@pytest.mark.parametrize(
    "inside",
    ['<h2 id="Related">KEPT</h2>', '<section id="related-work"><p>KEPT by all</p></section>', '<p class="form">KEPT</p>', '<p>a <span class="share-price">KEPT</span></p>', '<p>a <i class="promotion">KEPT</i></p>', '<p id="comments-on-method">KEPT</p>'],
)
def test_names_drop_no_text(inside, wrap):
    got = html_extract.main_text(_page(inside, wrap).replace("</div class=post>", "</div>"))
    assert "KEPT" in got
    assert "menu" not in got
    assert "foot" not in got


def test_asides_of_an_article_stay():
    assert "KEPT" in html_extract.main_text(_page("<aside>KEPT</aside>", "article"))
    assert "GONE" not in html_extract.main_text(_page("<aside><a href=y>GONE</a></aside>", "article"))
    assert "GONE" not in html_extract.main_text(f"<body><aside>GONE</aside><article>{_P}</article></body>")
    assert "GONE" not in html_extract.main_text(_page("<div class=comments><p>GONE " + "so true " * 90 + "</p></div>", "article"))


@pytest.mark.parametrize("outer", ["%s", "<div>%s</div>", "<article>%s</article>"])
@pytest.mark.parametrize("inner", ["%s", "<p>%s</p>"])
def test_short_sections_beside_a_long_one_stay(outer, inner):
    parts = [" ".join(f"w{k}x{i}" for i in range(n)) for k, n in enumerate((200, 15, 15))]
    sections = "".join(f'<div class="s{k}">{inner % x}</div>' for k, x in enumerate(parts))
    if outer == "%s" and inner == "<p>%s</p>":  # with furniture of another make beside them
        sections = "<div><a href=a>one</a> <a href=b>two</a></div>" + sections + "<div>(c) nobody</div>"
    assert html_extract.main_text(f"<body>{outer % sections}</body>") == " ".join(parts)


def _plain(article):
    import html

    blocks = re.split(r"</?(?:p|h1|br)\b[^>]*>", article)
    return " ".join(x for x in (" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in blocks) if x)


@pytest.mark.parametrize(("classes", "least"), [(True, 0.92), (False, 0.92)])
def test_pages_without_telling_elements(spark, monkeypatch, classes, least):
    """nav, article, footer and the like made div: densities tell them apart unless the article is shorter than its footer."""
    pages = [r.html for r in table(spark, SF, "pages").collect()]
    want = [_plain(re.search(r"<article>(.*?)</article>", p, re.S)[1]) for p in pages]
    plain = [re.sub(r"<(/?)(?:article|nav|footer|header|form)\b", r"<\1div", p) for p in pages]
    if not classes:
        plain = [re.sub(r' class="[^"]*"', "", p) for p in plain]
    share = lambda: sum(map(lambda p, w: html_extract.main_text(p) == w, plain, want)) / len(pages)
    assert share() >= least
    monkeypatch.setattr(html_extract, "_density", lambda *_: 0.0)
    assert share() == 0


class _Node:
    def __init__(self, tag, *children):
        self.tag, self.children = tag, children

    def html(self):
        return f"<{self.tag}>" + "".join(c if isinstance(c, str) else c.html() for c in self.children) + f"</{self.tag}>"


def _measures(n):
    """(characters, tags with its own, link characters, link tags) of a node, as the definition says."""
    c = k = lc = lk = 0
    for x in n.children:
        if isinstance(x, str):
            c += len("".join(x.split()))
        else:
            a, b, d, e = _measures(x)
            c, k, lc, lk = c + a, k + b, lc + d, lk + e
    return (c, k + 1, c, k + 1) if n.tag == "a" else (c, k + 1, lc, lk)


def _density(n, share):
    c, k, lc, lk = _measures(n)
    if not c:
        return 0.0
    base = c * lc / max(c - lc, 1) + share * c + math.e
    return c / k * math.log(max(c / max(lc, 1) * k / max(lk, 1), 1) + 1) / math.log(base)


def test_densities_sums_and_threshold_as_defined(monkeypatch):
    """The measures that decide, against a recursive version on a tree."""
    d = lambda *x: _Node("div", *x)
    p = lambda *x: _Node("p", *x)
    tree = d(d(_Node("a", "one"), _Node("a", "two three")), d(d(p("some words " * 9), p("more ", _Node("a", "link"), " text" * 20)), d(p("x" * 50))), d("tail"))
    seen = []
    real = html_extract._density
    monkeypatch.setattr(html_extract, "_density", lambda *a: seen.append(real(*a)) or seen[-1])
    html_extract.main_text(tree.html())
    c, _, lc, _ = _measures(tree)
    order, todo = [], [tree]
    while todo:
        n = todo.pop(0)
        order.append(n)
        todo = [x for x in n.children if isinstance(x, _Node)] + todo
    assert seen[1:] == pytest.approx([_density(n, lc / c) for n in order])
