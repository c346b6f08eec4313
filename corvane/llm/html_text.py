"""Main text of web pages from the events of the standard library's streaming HTML parser.

Parser events give lines (the text of one block), each with its characters outside links, its tags and its container.
The text-to-tag ratios of the lines are smoothed with a Gaussian and split into two clusters by a threshold. Lines weigh
by their smoothed ratio and length, and the content's region is found from the page inwards: a container is entered
while it holds all but a tenth of the weight. Within the region parts without a line above the threshold go if they are
mostly links, and at page level anyway; lines of at least half the threshold that stand beside the region, in its wrapper
itself, join it.

Names and kinds of elements break ties only. Weight in menus, footers, adverts, forms or comments does not count beside
other containers, and an article or main element is entered though up to ``TIE`` times its weight stands beside it.
Within the region only forms, menus, asides and containers named for adverts, comments, sharing and the like go.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm._common import table

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text is never shown as text of the page.
SILENT = frozenset("script style noscript template svg math button select textarea iframe object canvas audio video head".split())
SUSPECT = frozenset("nav footer aside form dialog menu".split())
#: These never wrap the content, however much text they hold.
NEVER = frozenset("nav footer aside menu header".split())
CONTENT = frozenset(("article", "main"))
#: Containers that may be the root of the content.
ROOTS = frozenset("html body article main section div form center fieldset".split())
CONTAINER = frozenset("html body article main section div ul ol dl table tbody thead tfoot blockquote figure details center header hgroup fieldset".split()) | SILENT | SUSPECT
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
BLOCK = frozenset("p li dt dd tr pre figcaption address summary caption hr option legend".split()) | CONTAINER | HEADING
SPACE = frozenset(("br", "td", "th"))
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
#: A container is entered if what stands beside it weighs that much of it at most; beside an article or main element
#: that holds the weight of all such, up to so many times its weight.
REST, TIE = 0.1, 64
_NOISE = re.compile(
    r"(?:ads?|adv|advert\w*|adsense|banner|promo\w*|sponsor\w*|sidebar\w*|nav|navbar|navigation|menu\w*|breadcrumbs?|foot|footer\w*|masthead|topbar|comments?|commentlist|discussion\w*|replies|respond|disqus\w*|cookies?|consent|gdpr|notices?|notifications?|alerts?|newsletter\w*|subscri\w+|signup|share|sharing|social\w*|related\w*|recommend\w*|popups?|modal|overlay|toolbar|paginat\w+|pager|widgets?|copyright|login|skiplinks?|outbrain|taboola)"
)
#: Names that are never the content's own, and words that may stand beside them in a name.
_STRONG = re.compile(r"(?:ads?|adv|advert\w*|adsense|sponsor\w*|comments?|commentlist|discussions?|replies|respond|disqus\w*|cookies?|consent|gdpr|newsletter\w*|subscri\w+|signup|share|sharing|sharethis|addthis|breadcrumbs?|paginat\w+|pager|skiplinks?|outbrain|taboola)")
_PLAIN = re.compile(r"(?:a|the|this|in|on|box|block|blocks|list|section|area|wrap|wrapper|container|content|inner|outer|holder|unit|slot|thread|form|bar|button|buttons|link|links|icon|icons|tools|social|post|page|entry|top|bottom|left|right|[a-z]?\d+)")
_PAGE_HEAD = frozenset(("header", "site-header", "page-header", "siteheader", "pageheader"))
_NOT = frozenset("has have no not with without is hide show".split())
_HIDDEN = re.compile(r"display\s*:\s*none")


def names_noise(name: str, inside: bool) -> bool:
    """Whether a class or id name stands for something that is not content: a part of it does, and it does not begin
    with a word such as "has" or "no". ``inside``: the element is within an article or main element."""
    if not inside and name in _PAGE_HEAD:
        return True
    parts = re.split(r"[-_]+", name)
    return parts[0] not in _NOT and (bool(_NOISE.fullmatch("".join(parts))) or any(map(_NOISE.fullmatch, parts)))


def names_strongly(name: str) -> bool:
    """Whether a name stands for nothing but what an article itself does not have: adverts, comments, sharing, …."""
    parts = [x for x in re.split(r"[-_]+", name) if x]
    strong = [bool(_STRONG.fullmatch(x)) for x in parts]
    return bool(_STRONG.fullmatch("".join(parts))) or (any(strong) and all(s or _PLAIN.fullmatch(x) for s, x in zip(strong, parts)))


def _signs(tag: str, attrs: list[tuple[str, str | None]], inside: bool) -> tuple[bool, bool, bool]:
    """Of an element: whether it is not shown, whether it is suspect, and whether it is so within content too."""
    hidden, suspect, strong = tag in SILENT, tag in SUSPECT or (tag == "header" and not inside), tag in SUSPECT
    for name, value in attrs:
        value = (value or "").lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and _HIDDEN.search(value)):
            hidden = hidden or tag not in ("html", "body")
        elif name == "role":
            suspect, strong = suspect or value in ROLES, strong or value in ROLES
        elif name in ("class", "id") and tag not in ("html", "body"):
            suspect = suspect or any(names_noise(n, inside) for n in value.split())
            strong = strong or (tag in CONTAINER and any(map(names_strongly, value.split())))
    return hidden, suspect, strong


class _Lines(HTMLParser):
    """Lines (text, tags in it, characters in links, container, whether a heading) and containers, of which number 0 is
    the page: parent (always of a lower number), tag, whether suspect by its own signs, whether so within content too, and
    whether within content."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, int, bool]] = []
        self.parent, self.tag, self.suspect, self.strong, self.inside = [0], ["html"], [False], [False], [False]
        self.open: list[tuple[str, int]] = [("", 0)]  # tag and container, -1 if it is not shown
        self.names: Counter[str] = Counter()
        self.silent = 0
        self.text: list[str] = []
        self.tags = self.linked = 0
        self.in_link = self.heading = False

    def end_line(self):
        if self.text:
            line = " ".join("".join(self.text).split())
            if line:
                self.lines.append((line, self.tags, min(self.linked, len(line)), self.open[-1][1], self.heading))
            self.text = []
        self.tags = self.linked = 0
        self.heading = False

    def handle_starttag(self, tag, attrs):
        if tag in BLOCK:
            self.end_line()
            self.heading = tag in HEADING
        at = self.open[-1][1]
        inside = at >= 0 and self.inside[at]
        hidden, suspect, strong = _signs(tag, attrs, inside) if (attrs or tag in CONTAINER) and tag not in VOID else (False, False, False)
        if tag in CONTAINER or hidden or suspect:
            number = -1
            if self.silent or hidden:
                self.silent += 1
            else:
                number = len(self.parent)
                self.parent.append(at)
                self.tag.append(tag)
                self.suspect.append(suspect)
                self.strong.append(strong)
                self.inside.append(inside or (tag in CONTENT and not suspect))
            self.open.append((tag, number))
            self.names[tag] += 1
        elif not self.silent:
            self.tags += 1
            if tag in SPACE:
                self.text.append(" ")
        if tag == "a":
            self.in_link = True

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag == "a":
            self.in_link = False
        if tag in SPACE and not self.silent:
            self.text.append(" ")
        if not self.names[tag]:  # of no container
            if tag in BLOCK:
                self.end_line()
            return
        # the end of an inline element does not close containers around it
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i][0] == tag:
                if tag in BLOCK or self.open[-1][0] in BLOCK:
                    self.end_line()
                while len(self.open) > i:
                    name, number = self.open.pop()
                    self.names[name] -= 1
                    self.silent -= number < 0
                return
            if tag not in CONTAINER and self.open[i][0] in CONTAINER:
                return

    def handle_data(self, data):
        if not self.silent:
            self.text.append(data)
            if self.in_link:
                self.linked += len("".join(data.split()))


def smoothed(values: list[float], sigma: float = 1.0) -> list[float]:
    """Gaussian smoothing with a kernel of three sigma on either side, normalised at the ends."""
    reach = max(1, math.ceil(3 * sigma))
    kernel = [math.exp(-(k * k) / (2 * sigma * sigma)) for k in range(-reach, reach + 1)]
    out = []
    for i in range(len(values)):
        low, high = max(0, i - reach), min(len(values), i + reach + 1)
        weights = kernel[low - i + reach : high - i + reach]
        out.append(sum(w * v for w, v in zip(weights, values[low:high])) / sum(weights))
    return out


def threshold(values: list[float]) -> float:
    """Of two clusters (2-means in one dimension, from the least and greatest value): the middle of their centres."""
    low, high = min(values), max(values)
    for _ in range(20):
        middle = (low + high) / 2
        below, above = [v for v in values if v < middle], [v for v in values if v >= middle]
        new = (sum(below) / len(below) if below else low, sum(above) / len(above) if above else high)
        if new == (low, high):
            break
        low, high = new
    return (low + high) / 2


def ratios(page: _Lines) -> list[float]:
    """Text-to-tag ratio of each line, on a logarithmic scale, smoothed. Text in links does not count, before the lines
    are smoothed (for their neighbours) and after (for themselves)."""
    own = [1 - line[2] / len(line[0]) for line in page.lines]
    raw = [math.log1p(w * len(line[0]) / (1 + line[1])) for w, line in zip(own, page.lines)]
    return [w * v for w, v in zip(own, smoothed(raw))]


def _sums(page: _Lines, values: list[float]) -> list[float]:
    """By container: the sum of the values of all lines within it."""
    out = [0.0] * len(page.parent)
    for (_, _, _, c, _), v in zip(page.lines, values):
        out[c] += v
    for c in range(len(out) - 1, 0, -1):
        out[page.parent[c]] += out[c]
    return out


def suspects(page: _Lines) -> list[bool]:
    """By container: whether it or one around it is suspect. One that wraps the content is not: it holds nine tenths
    of the page's text outside links, or most of it in an article or main element."""
    text = _sums(page, [len(t) - linked for t, _, linked, _, _ in page.lines])
    best = [0.0] * len(text)  # text of the largest article or main element within
    for c in range(len(text) - 1, 0, -1):
        if page.tag[c] in CONTENT and not page.suspect[c]:
            best[c] = max(best[c], text[c])
        best[page.parent[c]] = max(best[page.parent[c]], best[c])
    out = [False]
    for c in range(1, len(text)):
        wraps = (page.tag[c] not in NEVER and text[c] >= 0.9 * text[0]) or (2 * text[c] > text[0] and 2 * best[c] > text[c])
        out.append(out[page.parent[c]] or (page.suspect[c] and not wraps))
    return out


def region(page: _Lines, weight: list[float], above: list[bool], suspect: list[bool]) -> int:
    """The container of the content, from the page inwards by the weight of lines that are not suspect: of those above
    the threshold, but that an article's other lines count for a tie."""
    parent, tag = page.parent, page.tag
    fair = [0.0 if suspect[line[3]] else w for line, w in zip(page.lines, weight)]
    high = _sums(page, [w if a else 0.0 for w, a in zip(fair, above)])
    all_, own = _sums(page, fair), _sums(page, [w if page.inside[line[3]] else 0.0 for line, w in zip(page.lines, fair)])
    children: list[list[int]] = [[] for _ in parent]
    for c in range(1, len(parent)):
        if all_[c] and tag[c] in ROOTS and not suspect[c]:
            children[parent[c]].append(c)
    root = 0
    while children[root]:
        articles = [c for c in children[root] if own[c] and not (page.inside[root])]
        c = max(children[root], key=lambda c: (c in articles, own[c] if articles else high[c]))
        if articles:  # all articles but a quarter, and no more than a tie beside them
            enter = own[root] - own[c] <= own[c] / 4 and all_[root] - own[root] <= TIE * own[c]
        else:
            enter = high[root] - high[c] <= REST * high[c] and not (page.inside[root] and tag[c] not in CONTENT)
        if not enter:
            break
        root = c
    return root


def content_lines(page: _Lines) -> list[int]:
    """Numbers of the lines of the content."""
    lines, parent = page.lines, page.parent
    suspect = suspects(page)
    ratio = ratios(page)
    cut = threshold(ratio)
    above = [r >= cut and r > 0 for r in ratio]
    weight = [(len(line[0]) - line[2]) * r for line, r in zip(lines, ratio)]
    if not any(weight[i] and not suspect[line[3]] for i, line in enumerate(lines)):
        return []
    root = region(page, weight, above, suspect)
    votes = _sums(page, [float(a) for a in above])
    length, linked = _sums(page, [len(line[0]) for line in lines]), _sums(page, [line[2] for line in lines])
    top = page.tag[root] in ("html", "body")
    within, gone = [c == root for c in range(len(parent))], [False] * len(parent)
    for c in range(root + 1, len(parent)):
        up = parent[c]
        within[c] = within[up]
        bare = not votes[c] and (2 * linked[c] > length[c] or (top and up == root and not page.inside[c]))
        gone[c] = gone[up] or bare or (within[up] and (page.strong[c] or (top and suspect[c])))
    # an article's paragraph may be one link; elsewhere lines of links go
    kept = [i for i, line in enumerate(lines) if within[line[3]] and not gone[line[3]] and (above[i] or page.inside[line[3]] or line[2] <= 0.7 * len(line[0]))]
    if not kept:
        return []
    first, last, wrapper = kept[0], kept[-1], parent[root]
    beside = lambda i: lines[i][3] == wrapper and wrapper != root and page.tag[wrapper] not in ("html", "body") and 2 * ratio[i] >= cut and not suspect[wrapper]
    while first and (beside(first - 1) or (lines[first - 1][4] and not suspect[lines[first - 1][3]])):  # headings right before it, too
        first -= 1
        kept.insert(0, first)
    while last + 1 < len(lines) and beside(last + 1):
        last += 1
        kept.append(last)
    return kept


def main_text(html: str | None) -> str:
    """The article of a page: its blocks, joined by two line feeds; empty if there is none."""
    if not html:
        return ""
    page = _Lines()
    page.feed(html)
    page.close()
    page.end_line()
    return "\n\n".join([page.lines[i][0] for i in content_lines(page)]) if page.lines else ""


def extract(column: Column) -> Column:
    @F.pandas_udf("string")
    def of(pages: pd.Series) -> pd.Series:
        return pd.Series([main_text(p) for p in pages], dtype=object)

    return of(column.cast("string"))


def page_texts(pages: DataFrame, *, id_col: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text and n_chars (code points) of each page; the text of a null or empty page is empty.

    Repeated rows are extracted each; other columns are ignored; an empty table gives no rows. Tag soup is read as the
    standard parser reads it, whole.
    """
    own = pages.select(F.col(id_col).alias("page_id"), F.col(url).alias("url"), extract(F.col(html)).alias("text"))
    return own.withColumn("n_chars", F.length("text").cast("long"))


def op9_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_texts(table(spark, sf_dir, "pages"))
