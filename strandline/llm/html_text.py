"""Main text of web pages by composite text density.

Every element gets its characters per tag, adjusted by how much of both are links.
The element whose children's densities sum up highest holds the main text; the least
density on its way up to the body is the threshold that neighbours of that way need
to belong to it. An article or main around that element widens it to its own borders,
and neighbours then are measured by its density. Elements that are no text of the page (scripts, menus, adverts,
comments and so on) are cut off before; forms, and elements that only their class, id
or role names so, stay where they hold an article or much of the page's text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html import unescape
from math import e, log

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from strandline.llm.common import small_batches

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title xmp noframes noembed".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - frozenset("body html td th tr tbody thead tfoot".split())
#: What a start tag ends, and how far up that reaches.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
P_SCOPE = frozenset("td th table caption button object body html".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that are never main text.
CUT = RAW | frozenset("head nav header footer aside form button select option input label menu dialog object canvas audio video svg math map".split())
#: Elements that are cut as those that CUT_WORDS name.
WEAK = frozenset({"form"})
#: Share of the page's text outside links up to which an element is cut by name; share of text in articles above which larger ones are, too.
NAMED_SHARE, MAIN_SHARE = 0.3, 0.1
#: Words in class, id or role that tell the same.
CUT_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert popup modal newsletter subscribe subscription signup login sidebar aside complementary widget widgets related recommended recommendations share sharing social comment comments reply replies respond discussion disqus feedback nav navbar navigation menu menubar breadcrumb breadcrumbs header masthead footer contentinfo copyright legal toolbar pagination pager search".split()
)
#: Words that say nothing in such a name.
PLAIN_WORDS = frozenset("area block box container inner item items list panel section wrap wrapper".split())
MAIN = frozenset({"article", "main"})
#: Share of the main element's density that text beside it needs, and of its density sum, which articles don't need.
BESIDE, BESIDE_SUM = 0.5, 0.25
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>")
#: Once a quote of a tag never ends, the rest of the page is read without regard to quotes.
TAG_START = re.compile("</?[a-zA-Z]")
PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
#: Elements nest so deep at most, as in browsers; deeper ones become neighbours.
DEPTH = 512
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|([^\s=\"'/>]+)")
WORD_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
SPACES = re.compile(r"\s+")


@dataclass
class Page:
    """Elements in page order; ``tokens`` are texts and block borders with the element they are in."""

    tag: list[str] = field(default_factory=list)
    parent: list[int] = field(default_factory=list)
    cut: list[bool] = field(default_factory=list)
    #: 1 if an element's name tells that it is no text, 2 if it tells nothing else.
    named: list[int] = field(default_factory=list)
    tokens: list[tuple[int, str | None]] = field(default_factory=list)

    def add(self, tag: str, parent: int, cut: bool, named: int = 0) -> int:
        self.tag.append(tag)
        self.parent.append(parent)
        self.cut.append(cut)
        self.named.append(named)
        return len(self.tag) - 1


def _noise(tag: str, attributes: str, inside_main: bool) -> tuple[bool, int]:
    """Whether an element is never text of the page, and whether its name tells so."""
    if tag == "header" and inside_main:
        return False, 0
    if tag in CUT - WEAK:
        return True, 0
    named = 2 if tag in WEAK else 0
    if not attributes or tag in ("html", "body"):
        return False, named
    for name, double, single, bare, lone in ATTRIBUTE.findall(attributes):
        key, value = (name or lone).lower(), double or single or bare
        if tag not in MAIN and (key == "hidden" or (key == "aria-hidden" and value.lower() == "true") or (key == "style" and re.search(r"display\s*:\s*none", value, re.I))):
            return True, 0
        if key in ("class", "id", "role") and not (tag in HEADINGS and inside_main):
            for one in value.split():
                words = {w.lower() for w in WORD_PARTS.findall(one)}
                if CUT_WORDS & words:
                    named = max(named, 2 if words <= CUT_WORDS | PLAIN_WORDS else 1)
    return False, named


def cut_named(page: Page) -> None:
    """Cuts elements that their name tells to be none of the text.

    One that holds an article or main stays. So does one with much of the page's
    text outside links, unless a tenth of that text is in articles and outside such
    elements. Within an article, one with much of the article's text stays unless its
    name tells nothing else.
    """
    n = len(page.tag)
    size, holds, linked, in_main, in_named = [0] * n, [False] * n, [False] * n, [0] * n, [False] * n
    for i in range(n - 1, 0, -1):
        holds[page.parent[i]] |= not page.cut[i] and (holds[i] or page.tag[i] in MAIN)
    weak = [bool(page.named[i]) and not holds[i] and page.tag[i] not in MAIN for i in range(n)]
    for i in range(1, n):
        up = page.parent[i]
        # The outermost article or main around an element.
        linked[i], in_main[i] = page.tag[i] == "a" or linked[up], in_main[up] or (i if page.tag[i] in MAIN else 0)
        in_named[i] = in_named[up] or weak[i]
    main = 0
    for i, text in page.tokens:
        if text and not page.cut[i] and not linked[i]:
            size[i] += (k := len("".join(text.split())))
            main += k if in_main[i] and not in_named[i] else 0
    for i in range(n - 1, 0, -1):
        size[page.parent[i]] += size[i]
    most = size[0] if main > MAIN_SHARE * size[0] else NAMED_SHARE * size[0]
    for i in range(1, n):
        bound = NAMED_SHARE * size[in_main[i]] if in_main[i] and page.named[i] == 1 else most
        page.cut[i] = page.cut[i] or page.cut[page.parent[i]] or (weak[i] and size[i] <= bound)


def parse(html: str) -> Page:
    """Elements and texts of a page. Missing, crossed and unknown tags are mended as browsers do for blocks."""
    page = Page()
    stack = [page.add("body", -1, False)]
    main_depth = 0

    def pop_to(depth: int) -> None:
        nonlocal main_depth
        while len(stack) > depth:
            tag = page.tag[stack.pop()]
            main_depth -= tag in MAIN
            if tag in BLOCK:
                page.tokens.append((stack[-1], None))

    def end_open(tags: set[str] | frozenset[str], scope: set[str] | frozenset[str]) -> None:
        for depth in range(len(stack) - 1, 0, -1):
            tag = page.tag[stack[depth]]
            if tag in tags:
                pop_to(depth)
                return
            if tag in scope:
                return

    at, n, tags = 0, len(html), TAG
    while at < n:
        mark = html.find("<", at)
        if mark < 0:
            mark = n
        if mark > at:
            page.tokens.append((stack[-1], html[at:mark]))
        if mark == n:
            break
        if html.startswith("<!--", mark):
            end = html.find("-->", mark + 4)
            at = n if end < 0 else end + 3
            continue
        if html.startswith(("<!", "<?"), mark):
            end = html.find(">", mark)
            at = n if end < 0 else end + 1
            continue
        if not TAG_START.match(html, mark):
            page.tokens.append((stack[-1], "<"))
            at = mark + 1
            continue
        found = tags.match(html, mark)
        if not found and tags is TAG:
            tags = PLAIN_TAG
            found = tags.match(html, mark)
        if not found:
            break  # a tag that never ends
        at = found.end()
        closing, tag, attributes = found[1], found[2].lower(), found[3]
        if tag in ("html", "body"):
            continue
        if closing:
            for depth in range(len(stack) - 1, 0, -1):
                if page.tag[stack[depth]] == tag:
                    pop_to(depth)
                    break
            continue
        if tag in CLOSES_P:
            end_open({"p"}, P_SCOPE)
        if tag in ENDS:
            end_open(*ENDS[tag])
        if tag in ("body", "nav", "article", "div", "main", "section", "p") and len(stack) > 1 and page.tag[stack[-1]] == "head":
            pop_to(len(stack) - 1)
        if tag in BLOCK:
            page.tokens.append((stack[-1], None))
        cut, named = _noise(tag, attributes, main_depth > 0)
        node = page.add(tag, stack[-1], page.cut[stack[-1]] or cut, named)
        if tag in RAW:
            end = re.compile(f"</{re.escape(tag)}(?=[\\s/>])", re.I).search(html, at)
            close = html.find(">", end.end()) if end else -1
            at = n if close < 0 else close + 1
        elif tag == "br":
            page.tokens.append((node, " "))
        elif len(stack) < DEPTH and (tag in BLOCK - VOID or tag not in VOID and not attributes.endswith("/")):
            stack.append(node)
            main_depth += tag in MAIN
    cut_named(page)
    return page


def densities(page: Page) -> tuple[list[float], list[float]]:
    """Composite density of every element that isn't cut off, and the sum of its children's."""
    n = len(page.tag)
    chars, tags, link_chars, link_tags, linked = [0] * n, [0] * n, [0] * n, [0] * n, [False] * n
    for i in range(n):
        linked[i] = page.tag[i] == "a" or (i > 0 and linked[page.parent[i]])
    for i, text in page.tokens:
        if text and not page.cut[i]:
            size = len("".join(text.split()))
            chars[i] += size
            link_chars[i] += size if linked[i] else 0
    for i in range(n - 1, 0, -1):
        if not page.cut[i]:
            up = page.parent[i]
            chars[up] += chars[i]
            tags[up] += tags[i] + 1
            link_chars[up] += link_chars[i]
            link_tags[up] += link_tags[i] + linked[i]
    density, total = [0.0] * n, [0.0] * n
    share = link_chars[0] / max(chars[0], 1)
    for i in range(n - 1, -1, -1):
        c, t = chars[i], max(tags[i], 1)
        if c and not page.cut[i]:
            lc, lt = max(link_chars[i], 1), max(link_tags[i], 1)
            # The logarithm's base is e or more, so pages without links have one too.
            base = log(c / max(c - link_chars[i], 1) * link_chars[i] + share * c + e) + e - 1
            density[i] = max(0.0, c / t * log(max(c / lc * (t / lt), 1e-9)) / log(base)) if link_chars[i] < c else 0.0
        if i:
            total[page.parent[i]] += density[i]
    return density, total


def beside(page: Page, main: int, density: list[float], total: list[float]) -> list[int]:
    """Blocks beside the way from an article or main to the body that are text like it.

    They are as dense as a share of it and hold an element whose density sum is a
    share of the highest in it; other parts of a split article need the first only.
    A name that tells otherwise leaves them out, of an article as well.
    """
    peak = total[:]
    for i in range(len(peak) - 1, 0, -1):
        if not page.cut[i]:
            peak[page.parent[i]] = max(peak[page.parent[i]], peak[i])
    way = {main}
    up = main
    while up:
        up = page.parent[up]
        way.add(up)
    out = []
    for i in range(1, len(page.tag)):
        if page.cut[i] or page.named[i] or i in way or page.parent[i] not in way - {main} or page.tag[i] not in BLOCK:
            continue
        if density[i] >= BESIDE * density[main] and (page.tag[i] in MAIN or peak[i] >= BESIDE_SUM * peak[main]):
            out.append(i)
    return out


def main_elements(page: Page) -> list[int]:
    """Elements whose whole subtrees are the main text, in page order."""
    density, total = densities(page)
    best = max(range(len(total)), key=lambda i: (total[i], -i))
    if total[best] <= 0:
        return [0]
    path = [best]
    while path[-1]:
        path.append(page.parent[path[-1]])
    threshold = min(density[i] for i in path)
    whole = next((i for i in reversed(path) if page.tag[i] in MAIN), None)
    if whole is not None:
        return sorted({whole, *beside(page, whole, density, total)})
    on_path, roots = set(path), {best}
    for i in range(1, len(page.tag)):
        # Beside the way to the body: headings, and elements as dense as the way is.
        if not page.cut[i] and page.parent[i] in on_path and i not in on_path and page.parent[i] != best and (density[i] >= threshold or page.tag[i] in ("h1", "h2")) and page.tag[i] in BLOCK:
            roots.add(i)
    if 0 in path[1:] and any(t.strip() for i, t in page.tokens if t and i in on_path - {best} and not page.cut[i]):
        return [0]
    return sorted(roots)


def main_text(html: str | None) -> str:
    """Blocks of the main text, joined by empty lines; white space inside a block is one space."""
    if not html:
        return ""
    page = parse(html)
    inside = [False] * len(page.tag)
    for i in main_elements(page):
        inside[i] = True
    for i in range(1, len(page.tag)):
        inside[i] = inside[i] or inside[page.parent[i]]
    # In a header inside an article only headings belong to it.
    header = [False] * len(page.tag)
    for i in range(1, len(page.tag)):
        header[i] = page.tag[i] not in HEADINGS and (page.tag[i] == "header" or header[page.parent[i]])
        if page.tag[page.parent[i]] in HEADINGS and not header[page.parent[i]]:
            header[i] = False
    blocks: list[str] = []
    open_: list[str] = []

    def close() -> None:
        text = SPACES.sub(" ", unescape("".join(open_))).strip()
        if text:
            blocks.append(text)
        open_.clear()

    for i, text in page.tokens:
        if text is None:
            close()
        elif inside[i] and not page.cut[i] and not header[i]:
            open_.append(text)
    close()
    return "\n\n".join(blocks)


@pandas_udf(StringType())
def _main_text(pages: pd.Series) -> pd.Series:
    return pages.map(main_text)


def extract(pages: DataFrame) -> DataFrame:
    """One row per row of ``pages``: page_id, url, text, n_chars.

    Reads these and ``html``. Null and empty pages, and pages of menus only, give an
    empty text. Text without any tag is one block. Repeated rows are independent.
    """
    small_batches(pages.sparkSession)
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    return pages.select("page_id", "url", _main_text(html).alias("text")).withColumn("n_chars", F.length("text").cast("long"))
