"""Operator 1: main text of web pages by composite text density.

Method. A page becomes a tree of elements. Each node's composite density is its
characters per tag (its own tag and those below, without marks of running text),
adjusted by its share of link characters and link tags against the body's own
share; a node's density sum is the sum over its children. The subtree of the
largest density sum is the main text; the least density on its path to the body is
the threshold. A subtree beside that path belongs to the text, too, if it is alike (the
same tag, paragraphs inside or none like its neighbour on the path, text rather than
links), however short; if all its path reaches the threshold and its density sum is a
quarter of the largest one; or if it is a first heading. Inside a chosen subtree, link
lists below the threshold are left out, and where the body itself is chosen, all
containers below it. If the choice lies in an article or main element, or such elements
hold most of its text, their borders are taken.

What elements, classes, ids and roles say is evidence only, and only of elements that
hold parts of a page: headings, running text and, but for unmistakable words,
paragraphs are never judged by their names. Script, style and controls hold no text. A
nav, footer, form or the like, a name that is a furniture word, or a compound that
begins or ends with an unmistakable one, marks a subtree: it is left out, unless it
holds the page (the unmarked text elsewhere is less than a 30th of its own). Inside an
article or main element a furniture word that is not unmistakable only breaks a tie:
such a part is left out if its density does not reach the threshold. Asides there, and
other compounds with a furniture word anywhere, are left out only if they are mostly
links, and are no text of their own outside the chosen one.

The text of the taken subtrees is written block by block in page order: character
references decoded, white space inside a block turned into one space, trimmed,
blocks joined by one space.

Defined cases: a null or empty page gives the empty text; unclosed, misnested and
unknown elements are accepted as browsers do; text outside any element counts as
the body's; pages of any length are parsed whole, without recursion; repeated
pages are handled one by one.
"""

from __future__ import annotations

import html as references
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from serion.llm.words import byte_runs

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is not markup.
RAW = frozenset("script style title textarea xmp iframe noembed noframes".split())
#: Elements that begin and end a block of text.
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: An open p ends where one of these begins.
CLOSES_P = BLOCK - frozenset("br body html caption tbody td tfoot th thead tr li dd dt summary".split())
#: An open element ends where one of these begins, up to the nearest of the barriers.
CLOSES = {"li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "a": ({"a"}, {"td", "th", "table"})}
#: Marks within running text: they are no tags of their own and no subtrees to choose.
INLINE = frozenset("abbr b bdi bdo big br cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements that hold no text of a page.
HARD = frozenset("script style title textarea xmp iframe noembed noframes head noscript template button select option input svg canvas object audio video map".split())
#: Elements that are strong evidence for furniture (a header outside articles, too; an aside inside is weak).
FURNITURE = frozenset("nav footer aside form menu dialog fieldset label".split())
#: Words of class, id or role that mark furniture.
FURNITURE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments disqus complementary contentinfo cookie cookies consent disclaimer dialog footer form header masthead menu modal nav navbar navigation newsletter notice notices notification popup promo promoted promotion related reply replies respond search share sharing sidebar sidebars signup skip social sponsor sponsored sponsors subscribe subscription toolbar topbar widget widgets".split()
)
#: Those that mark a compound as its first or last word, and inside articles, too.
UNMISTAKABLE = frozenset("ad ads advert adverts advertisement breadcrumb breadcrumbs comment comments cookie cookies disqus footer menu nav navbar navigation newsletter sidebar sponsor sponsored".split())
#: Words by which a compound speaks of a layout or of the text itself.
LAYOUT_WORDS = frozenset("no not non with without has have is hide show toggle js".split())
TEXT_WORDS = frozenset("content article story entry post body text".split())
#: Elements that are main text by definition, whatever their class.
TRUSTED = frozenset(("html", "body", "article", "main"))
#: Elements that hold parts of a page.
CONTAINERS = frozenset("div section ul ol dl table center td".split())
#: Elements whose names are evidence.
NAMED = CONTAINERS | FURNITURE | frozenset("header li figure details".split())
#: Paragraphs and headings: what a part of the text is made of.
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre".split())
#: Unmarked text elsewhere, as a share of a marked subtree's, below which the mark is void.
STRONG_SHARE = 1 / 30
#: Density sum of a further subtree of the text, as a share of the largest.
FURTHER_SHARE = 1 / 4

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*"|'[^']*')*+[^>]*)>|<[/a-zA-Z][^>]*\Z|</[^>]*>""",
    re.S,
)
_MARKED = re.compile(r"""(?:^|[\s"'])(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class _Tree:
    """Elements in page order; a parent's number is below its children's."""

    def __init__(self) -> None:
        self.tag, self.parent, self.cut, self.mark = ["body"], [0], [False], [0]
        self.leaves: list[tuple[int, int, str]] = []  # element, block, text


def _token_mark(token: str) -> int:
    """3: an unmistakable word or a compound that begins or ends with one; 2: another furniture word; 1: another compound with one."""
    word = token.lower()
    if word in FURNITURE_WORDS:
        return 3 if word in UNMISTAKABLE else 2
    parts = [w.lower() for w in _WORDS.findall(token)]
    if len(parts) < 2 or FURNITURE_WORDS.isdisjoint(parts) or not LAYOUT_WORDS.isdisjoint(parts):
        return 0
    return 3 if (parts[0] in UNMISTAKABLE or parts[-1] in UNMISTAKABLE) and TEXT_WORDS.isdisjoint(parts) else 1


def _mark(tag: str, attributes: str, in_article: bool) -> int:
    """Evidence for furniture: 0 none, 1 for links only, 2 below the threshold only, 3 strong."""
    if tag in FURNITURE or tag == "header" and not in_article:
        return 1 if tag == "aside" and in_article else 3
    if tag in TRUSTED or not attributes or tag not in NAMED and tag != "p":
        return 0
    tokens = [x for m in _MARKED.finditer(attributes) for x in (m[1] or m[2] or m[3] or "").split()]
    if tag == "p":
        return 3 * any(x.lower() in UNMISTAKABLE for x in tokens)
    found = max(map(_token_mark, tokens), default=0)
    return 3 if found == 2 and not in_article else found


def _parse(page: str) -> _Tree:
    t = _Tree()
    stack, open_ = [0], {"body": 1}
    articles, block, at = 0, 0, 0

    def close(down_to: int) -> None:
        nonlocal articles
        while len(stack) > down_to:
            tag = t.tag[stack.pop()]
            open_[tag] -= 1
            articles -= tag in ("article", "main")

    def find(tags: set[str], barriers: set[str]) -> int:
        for k in range(len(stack) - 1, 0, -1):
            tag = t.tag[stack[k]]
            if tag in tags:
                return k
            if tag in barriers:
                break
        return 0

    def text(to: int) -> None:
        if to > at:
            t.leaves.append((stack[-1], block, page[at:to]))

    while m := _TOKEN.search(page, at):
        text(m.start())
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag in BLOCK:
                block += 1
            if open_.get(tag) and tag not in ("body", "html"):
                k = len(stack) - 1
                while t.tag[stack[k]] != tag:
                    k -= 1
                close(k)
            continue
        if tag in BLOCK:
            block += 1
        if tag in ("html", "body"):
            continue
        if tag in CLOSES_P and open_.get("p") and (k := find({"p"}, {"td", "th", "table", "button", "object"})):
            close(k)
        if tag in CLOSES and (k := find(*CLOSES[tag])):
            close(k)
        t.tag.append(tag)
        t.parent.append(stack[-1])
        t.cut.append(t.cut[stack[-1]] or tag in HARD)
        t.mark.append(_mark(tag, m[3], articles > 0))
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>|\Z", re.I).search(page, at)
            at = end.end()
        elif tag not in VOID and not m[3].endswith("/"):
            stack.append(len(t.tag) - 1)
            open_[tag] = open_.get(tag, 0) + 1
            articles += tag in ("article", "main")
        elif tag in VOID or tag in BLOCK:
            pass
        else:  # a slash does not close other elements
            stack.append(len(t.tag) - 1)
            open_[tag] = open_.get(tag, 0) + 1
    text(len(page))
    return t


def _density(c: int, tags: int, link_c: int, link_tags: int, share: float) -> float:
    """Composite density of one node; share: link characters of the body per character."""
    if not c:
        return 0.0
    base = c * link_c / max(c - link_c, 1) + share * c + math.e
    ratio = c / max(link_c, 1) * tags / max(link_tags, 1)
    return c / tags * math.log(max(ratio, 1.0) + 1) / math.log(base)


def _cut_furniture(t: _Tree, leaves: list[tuple[int, int, str]]) -> None:
    """Cuts strongly marked subtrees, the outer ones first, but those that hold the page."""
    n = len(t.tag)
    plain, link = [0] * n, [False] * n  # own characters outside links and outside marked elements below
    for e in range(1, n):
        link[e] = t.tag[e] == "a" or link[t.parent[e]]
    for e, _, x in leaves:
        if not link[e]:
            plain[e] += len("".join(x.split()))
    for e in range(n - 1, 0, -1):
        if t.mark[e] < 3:
            plain[t.parent[e]] += plain[e]
    elsewhere = plain[0]
    for e in range(1, n):
        if t.cut[t.parent[e]]:
            t.cut[e] = True
        elif t.mark[e] == 3 and not t.cut[e]:
            if elsewhere < plain[e] * STRONG_SHARE:
                elsewhere += plain[e]
            else:
                t.cut[e] = True


def _chosen(t: _Tree, leaves: list[tuple[int, int, str]]) -> list[bool]:
    """Which elements' own text is main text."""
    n = len(t.tag)
    chars, tags, link_chars, link_tags = [0] * n, [0] * n, [0] * n, [0] * n
    for e, _, x in leaves:
        chars[e] += len("".join(x.split()))
    for e in range(n - 1, 0, -1):
        if t.cut[e]:
            continue
        p = t.parent[e]
        if t.tag[e] == "a":
            link_chars[e], link_tags[e] = chars[e], tags[e] + 1
        chars[p] += chars[e]
        tags[p] += tags[e] + (t.tag[e] not in INLINE)
        link_chars[p] += link_chars[e]
        link_tags[p] += link_tags[e]
    share = link_chars[0] / max(chars[0], 1)
    density = [_density(chars[e], tags[e] + 1, link_chars[e], link_tags[e], share) for e in range(n)]
    sums, above = [0.0] * n, list(range(n))
    for e in range(1, n):
        if t.tag[e] in INLINE:  # its own children count for what holds it
            above[e] = above[t.parent[e]]
        else:
            sums[above[t.parent[e]]] += density[e]
    # the largest density sum at or below each node
    best = list(range(n))
    for e in range(n - 1, 0, -1):
        p = t.parent[e]
        if sums[best[e]] > sums[best[p]]:
            best[p] = best[e]
    top = best[0]
    path = [top]
    while path[-1]:
        path.append(t.parent[path[-1]])
    threshold = min(density[e] for e in path)
    taken = [False] * n
    # the borders of articles
    around = [e for e in path if t.tag[e] in ("article", "main")]
    inner: list[int] = []
    root = around[-1] if around else top
    if not around:
        within, covered = [e == top for e in range(n)], [False] * n
        for e in range(1, n):
            p = t.parent[e]
            within[e] = within[e] or within[p]
            covered[e] = covered[p] or t.tag[p] in ("article", "main")
            if t.tag[e] in ("article", "main") and within[e] and not covered[e] and not t.cut[e]:
                inner.append(e)
        if 2 * sum(chars[e] - link_chars[e] for e in inner) < chars[top] - link_chars[top]:
            inner = []
    for e in inner or [root]:
        taken[e] = True
    # other subtrees of the text
    paragraphs = [t.tag[e] in PARAGRAPHS and not t.cut[e] and chars[e] > 0 for e in range(n)]
    for e in range(n - 1, 0, -1):
        paragraphs[t.parent[e]] = paragraphs[t.parent[e]] or paragraphs[e]
    on_path, reached = {t.parent[e]: e for e in path if e}, [density[0] >= threshold] + [False] * (n - 1)
    for e in range(1, n):
        p = t.parent[e]
        reached[e] = reached[p] and density[e] >= threshold and density[e] > 0
        beside = on_path.get(p)  # the path's own child of p
        if inner or beside is None or e == beside or t.mark[e] or not chars[e]:
            continue
        alike = t.tag[e] == t.tag[beside] and t.tag[e] in CONTAINERS and paragraphs[e] == paragraphs[beside] and 2 * link_chars[e] < chars[e]
        if alike or t.tag[e] == "h1":
            taken[e] = True
        elif reached[e] and sums[best[e]] >= FURTHER_SHARE * sums[top] > 0:
            taken[best[e]] = True
    trusted = bool(inner) or t.tag[root] in ("article", "main")
    widest = max((e for e in range(1, n) if t.parent[e] == 0 and t.tag[e] in CONTAINERS), key=lambda e: chars[e], default=0)
    for e in range(1, n):
        if not taken[e] and taken[t.parent[e]]:
            linked, sparse = 2 * link_chars[e] > chars[e], density[e] < threshold
            like = 2 * chars[widest] >= chars[0] and t.tag[e] == t.tag[widest] and paragraphs[e] == paragraphs[widest]
            alone = root == 0 and t.parent[e] == 0 and chars[e] < chars[0] / 2 and not like
            low = not trusted and t.tag[e] in CONTAINERS and sparse and (linked or alone)
            weak = t.mark[e] == 2 and sparse or t.mark[e] == 1 and linked
            taken[e] = not low and not weak
    return taken


def main_text(page: str | None) -> str:
    """The main text of one page."""
    if not page:
        return ""
    t = _parse(page)
    leaves = [(e, b, references.unescape(x)) for e, b, x in t.leaves if not t.cut[e]]
    _cut_furniture(t, leaves)
    leaves = [x for x in leaves if not t.cut[x[0]]]
    taken = _chosen(t, leaves)
    blocks: list[str] = []
    last, part = -1, []
    for e, b, x in leaves:
        if not taken[e]:
            continue
        if b != last and part:
            blocks.append(" ".join("".join(part).split()))
            part = []
        last = b
        part.append(x)
    if part:
        blocks.append(" ".join("".join(part).split()))
    return " ".join(x for x in blocks if x)


def extract_pages(df: DataFrame, *, keep: tuple[str, ...] = ("page_id", "url"), html_col: str = "html") -> DataFrame:
    """The columns ``keep`` and (text, n_chars) per row."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, end in byte_runs(b.column(0)):
                part = b.slice(first, end - first)
                texts = [main_text(x.as_py()) for x in part.column(0)]
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], [*part.schema.names[1:], "text", "n_chars"])

    names = [f"k{i}" for i in range(len(keep))]
    kinds = ", ".join(f"{n} {df.schema[c].dataType.simpleString()}" for n, c in zip(names, keep, strict=True))
    got = df.select(F.col(html_col).alias("html"), *[F.col(c).alias(n) for n, c in zip(names, keep, strict=True)]).mapInArrow(task, f"{kinds}, text string, n_chars long")
    return got.select(*[F.col(n).alias(c) for n, c in zip(names, keep, strict=True)], "text", "n_chars")
