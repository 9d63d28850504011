"""Main text of web pages by composite text density.

Every node gets its characters per tag, adjusted for links; a node's density sum adds its children's densities. The
least density on the path from the node of greatest sum up to the body is the threshold; under every node that reaches
it the subtree of greatest sum is content, as is all that stands between in the smallest element around it. Elements that by
their kind are no article text (scripts, menus, asides) are no nodes; text in forms and in elements of telling names counts
as link text in the densities, unless they hold the bulk of the page, and what of it stands in the content is left out.
"""

from __future__ import annotations

import re
from html import unescape
from math import e, log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pretokens import text_runs

TOKEN = re.compile(
    r"<!--(?:.*?-->|.*)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*>"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)[^>]*(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
# Kinds of HTML elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript iframe xmp noembed noframes template".split())
BLOCK = frozenset(
    "address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td"
    " tfoot th thead title tr ul".split()
)
NOT_TEXT = frozenset(
    "head script style title textarea noscript iframe template svg canvas object audio video nav footer aside button"
    " select menu dialog".split()
)
#: Cut like a named element: a page may stand in one form as a whole.
FORMS = frozenset(("form", "fieldset"))
#: Formatting inside a block: no node of its own, so it doesn't thin the block's density.
INLINE = frozenset("abbr b bdi bdo big br cite code dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var wbr".split())
#: A start tag of the key ends open elements of the value, up to the nearest element that bounds them.
ENDS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "tbody": {"tr", "td", "th", "thead", "tbody"}, "body": {"head"},
}
BOUNDS = frozenset("ul ol dl select table div article section main body".split())
ENDS_P = BLOCK - {"br", "option", "head", "html", "body", "title", "td", "th", "tr", "tbody", "thead", "tfoot", "legend"}
WORDS = (
    r"(?:ads?|adsense|advert\w*|sponsor\w*|promo\w*|banner\w*|sidebar|side|widget\w*|menu|nav|navbar|navigation|breadcrumbs?"
    r"|footer|masthead|comments?|replies|reply|disqus|cookies?|consent|gdpr|notice|notices|popup|modal|overlay|newsletter|subscribe|signup|login"
    r"|social|share|sharing|related|recommended|pagination|pager|toolbar|search)"
)
NAMES = re.compile(rf"(?:^|[\s_-]){WORDS}(?:$|[\s_-])", re.I)
WHOLE = re.compile(rf"(?:^|\s){WORDS}(?:$|\s)", re.I)
#: Such a name tells what stands in an element, not what it is.
HAS = re.compile(r"(?:has|with|no|without)[_-]", re.I)
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
HOLDERS = frozenset(("html", "body", "article", "main"))


#: How surely an element is no article text: not at all; by one of its names or as a form; by its whole name; always.
TEXT, MAYBE, NAMED, NEVER = range(4)


def _not_text(tag: str, attributes: str, inside: bool) -> int:
    """How surely an element is no article text; inside: it stands in an article."""
    if tag in NOT_TEXT or tag == "header" and not inside:
        return NEVER
    form = MAYBE if tag in FORMS else TEXT
    if not attributes or tag in HOLDERS:
        return form
    named = {k.lower(): a or b or c for k, a, b, c in ATTRIBUTE.findall(attributes)}
    style = named.get("style", "").replace(" ", "").lower()
    hidden = re.search(r"(?:^|\s)hidden(?:\s|=|$)", ATTRIBUTE.sub(" ", attributes), re.I) or "hidden" in named or named.get("aria-hidden") == "true"
    if hidden or "display:none" in style or "visibility:hidden" in style:
        return NEVER
    role = named.get("role", "").lower()
    if role in ROLES:
        return MAYBE if role == "form" else NAMED
    names = [named.get("class", ""), named.get("id", "")]
    if not any(map(NAMES.search, names)):
        return form
    other = any(HAS.match(x) or not NAMES.search(x) for x in " ".join(names).split())
    return MAYBE if other and not any(map(WHOLE.search, names)) else NAMED


class Page:
    """Nodes in page order, the first being the root; texts with their nodes; None between texts parts blocks."""

    def __init__(self, html: str):
        self.tags, self.parents, self.marks, self.texts = ["html"], [-1], [TEXT], []
        self.stack, self.open, at = [0], {}, 0  # open: for each tag, the places in the stack of its open elements
        while m := TOKEN.search(html, at):
            if m.start() > at:
                self.texts.append((self.stack[-1], html[at : m.start()]))
            at = m.end()
            if m[1]:
                self.texts.append((self.stack[-1], m[1]))
            if not m[3]:
                continue
            tag = m[3].lower()
            if tag in BLOCK:
                self.texts.append(None)
            if m[2]:
                if self._last((tag,)) > 0:
                    self._cut(self._last((tag,)))
                continue
            inside = self._last(("article", "main")) > 0
            if tag == "html" or tag in INLINE and not (m[4] and _not_text(tag, m[4], inside)):
                continue
            self._end(("p",) if tag in ENDS_P else (), BOUNDS)
            self._end(ENDS.get(tag, ()), BOUNDS - {tag})
            node = len(self.tags)
            self.tags.append(tag)
            self.parents.append(self.stack[-1])
            self.marks.append(_not_text(tag, m[4], self._last(("article", "main")) > 0))
            if tag in RAW:
                close = re.compile(rf"</{re.escape(tag)}(?:[\s/>]|\Z)", re.I).search(html, at)
                at = close.start() if close else len(html)
            elif tag not in VOID and not m[4].endswith("/") or tag in BLOCK and tag not in VOID:
                self.open.setdefault(tag, []).append(len(self.stack))
                self.stack.append(node)
        if at < len(html):
            self.texts.append((self.stack[-1], html[at:]))

    def _last(self, tags) -> int:
        """Place in the stack of the innermost open element of these tags, 0 if none is open."""
        return max((held[-1] for t in tags if (held := self.open.get(t))), default=0)

    def _cut(self, place: int) -> None:
        """Ends the open elements from this place on: each is ended once, however often end tags come."""
        for node in reversed(self.stack[place:]):
            self.open[self.tags[node]].pop()
        del self.stack[place:]

    def _end(self, tags, bounds: frozenset[str]) -> None:
        found = self._last(tags)
        if found and found >= self._last(bounds):
            self._cut(found)


def _kept(page: Page, linked: list[bool]) -> list[bool]:
    """The nodes that are not cut.

    A form or named element stays if it holds a main or most of the text out of links, and no greater article stands
    elsewhere: it is a wrapper. If its whole name says that it is no text (comments may outweigh the article), it must
    also hold an article or main greater than any other.
    """
    n, tags, parents, marks = len(page.tags), page.tags, page.parents, page.marks
    never, above = [False] * n, [-1] * n  # above: the nearest marked element, itself included
    for i in range(n):
        never[i] = marks[i] == NEVER or i > 0 and never[parents[i]]
        above[i] = i if marks[i] else above[parents[i]] if i else -1
    size, own, last, greatest, mains = [0] * n, [0] * n, list(range(n)), [0] * n, [False] * n
    for t in page.texts:
        if t and not never[t[0]] and not linked[t[0]]:
            size[t[0]] += len("".join(t[1].split()))
    own[:] = size  # own: without marked elements in it
    for i in range(n - 1, 0, -1):
        p = parents[i]
        size[p] += size[i]
        own[p] += own[i] if not marks[i] else 0
        last[p] = max(last[p], last[i])
        mains[i] = (mains[i] or tags[i] == "main") and not never[i]
        greatest[i] = max(greatest[i], own[i] if tags[i] in ("article", "main") else 0)
        mains[p] = mains[p] or mains[i]
        greatest[p] = max(greatest[p], greatest[i])
    total = size[tags.index("body") if "body" in tags else 0]
    articles = [i for i in range(1, n) if tags[i] in ("article", "main") and own[i]]

    kept = [True] * n
    for i in range(1, n):
        kept[i] = kept[parents[i]]
        if not kept[i] or not marks[i]:
            continue
        kept[i] = False
        if marks[i] < NEVER and (2 * size[i] > total or mains[i]):
            # Articles elsewhere that are not cut; for a form or part of a name, not those around it.
            seen = [a for a in articles if not i <= a <= last[i] and (above[a] < 0 or above[a] < i and kept[above[a]])]
            other = max((own[a] for a in seen if marks[i] == NAMED or not a < i <= last[a]), default=0)
            kept[i] = greatest[i] > other or marks[i] == MAYBE and greatest[i] == other
    return kept


def main_text(html: str) -> str:
    """The text of the content subtrees: blocks in page order, one space between."""
    page = Page(html)
    n, tags, parents = len(page.tags), page.tags, page.parents
    linked = [False] * n
    for i in range(1, n):
        linked[i] = linked[parents[i]] or tags[i] == "a"
    # Elements of telling names may hold the article itself: they count if nothing else is left.
    named = [not k for k in _kept(page, linked)]
    kept = [True] * n
    for i in range(1, n):
        kept[i] = kept[parents[i]] and page.marks[i] != NEVER
    if not any(t and kept[t[0]] and not named[t[0]] and t[1].strip() for t in page.texts):
        named = [False] * n
        if not any(t and kept[t[0]] and t[1].strip() for t in page.texts):
            for i in range(1, n):
                kept[i] = kept[parents[i]] and tags[i] not in NOT_TEXT
    linked = [a or b for a, b in zip(linked, named, strict=True)]
    chars, link_chars, below, link_tags = [0] * n, [0] * n, [0] * n, [0] * n
    for t in page.texts:
        if t and kept[t[0]]:
            size = len("".join(t[1].split()))
            chars[t[0]] += size
            link_chars[t[0]] += size if linked[t[0]] else 0
    for i in range(n - 1, 0, -1):
        if kept[i]:
            p = parents[i]
            chars[p] += chars[i]
            link_chars[p] += link_chars[i]
            below[p] += below[i] + 1
            link_tags[p] += link_tags[i] + (tags[i] == "a" or named[i])
    body = tags.index("body") if "body" in tags else 0
    ratio = link_chars[body] / max(chars[body], 1)

    density = [0.0] * n
    for i in range(n):
        if kept[i] and chars[i]:
            c, t, lc, lt = chars[i], max(below[i], 1), max(link_chars[i], 1), max(link_tags[i], 1)
            base = log(c / max(c - link_chars[i], 1) * lc + ratio * c + e)
            free = (c + (link_chars[i] == 0)) / lc * t / lt  # over 1 without links, even for one character
            density[i] = c / t * log(max(free, 1.0)) / log(base)
    sums = [0.0] * n
    for i in range(1, n):
        sums[parents[i]] += density[i]
    best = list(range(n))
    for i in range(n - 1, 0, -1):
        if sums[best[i]] > sums[best[parents[i]]]:
            best[parents[i]] = best[i]

    node = best[body]
    threshold = density[node]
    while node != body and node > 0:
        node = parents[node]
        threshold = min(threshold, density[node])
    content = [False] * n
    for i in range(n):
        if density[i] and density[i] >= threshold:
            content[best[i]] = True
    # Short blocks between content are content: all below the node where the content meets, unless that is the body.
    held = [int(c) for c in content]
    for i in range(n - 1, 0, -1):
        held[parents[i]] += held[i]
    meet = max((i for i in range(n) if held[i] == held[0]), default=0)
    content[meet] = content[meet] or held[0] > 0 and meet not in (0, body)
    for i in range(1, n):
        content[i] = content[i] or content[parents[i]]
    blocks, words = [], []
    for t in (*page.texts, None):
        if t is None:
            blocks.append(" ".join(unescape("".join(words)).split()))
            words = []
        elif content[t[0]] and kept[t[0]] and not named[t[0]]:
            words.append(t[1])
    return " ".join(b for b in blocks if b)


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The main text of every page: page_id, url, text, n_chars (code points).

    A map over rows: no shuffle, memory bounded by a row's page. Null or empty html, and pages without article text,
    give an empty text; null ids and urls and repeated rows stay as they are; other columns are ignored; an empty table
    gives an empty result. Broken markup never fails: unknown end tags are ignored, open elements end with the page. Pages
    of any length are taken whole; the time grows with their length, whatever is nested or left open in them.
    """

    def run(parts):
        for part in parts:
            for some, html in text_runs(pa.StructArray.from_arrays(part.columns[:2], ["id", "url"]), part.column(2)):
                texts = list(map(main_text, html))
                columns = [pa.array([r["id"] for r in some], pa.int64()), pa.array([r["url"] for r in some], pa.string())]
                columns += [pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())]
                yield pa.record_batch(columns, names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).cast("long"), F.col(url_col), F.col(html_col))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def query(spark, sf_dir: str) -> DataFrame:
    from .common import read

    return extract_pages(read(spark, sf_dir, "pages"))
