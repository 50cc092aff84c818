"""Main text of web pages by composite text density.

Every DOM node gets a density: its characters per tag, adjusted for the
characters and tags of links against the body's.  The node whose children's
densities have the largest sum carries the article.  The smallest density on
its path from the body is the threshold: the first node on that path, from the
body on, whose density exceeds it is the selected subtree.  Densities are those
of the whole page, menus and notices included; what is furniture (menus,
headers, footers, sidebars, notices, adverts, forms, reader comments, told by
element, role or class) can't carry the article and is left out of the selected
subtree's text.

Reading a page is linear in its length, whatever it holds.
"""

from __future__ import annotations

import html
import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import known, through

#: Fixed values of HTML: elements without content, and those that start a block.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section "
    "summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that are no text of the article.
DROPPED = set(
    "applet aside audio button canvas datalist dialog embed footer form head iframe input map menu nav noscript object "
    "script select style svg template textarea title video".split()
)
#: Elements whose content is not markup; it is no text of the page either.
RAW = set("script style textarea title noscript iframe template xmp".split())
#: An open element of the value is closed by a start of the key.
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "optgroup": {"option", "optgroup"},
    "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "tbody"},
}
#: Where the search for an element to close ends.
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}}
ROLES = set("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
HINTS = (
    r"(?:ads?|advert\w*|advertisement|sponsor\w*|promo\w*|banner|sidebar\w*|side-?bar|widget\w*|comments?|"
    r"commentlist|respond|replies|disqus\w*|discussion|cookies?|consent|gdpr|notices?|notification|alert|popup|modal|"
    r"overlay|newsletter|subscribe|signup|nav|navbar|navigation|menu|breadcrumbs?|pagination|pager|toolbar|share|sharing|"
    r"social|related|recommended|footer|masthead|site-?header|page-?header|topbar|skip-?link)"
)
#: A class or id that names furniture begins or ends with a hint.
HINTED = re.compile(rf"{HINTS}(?:$|[_-])|.*[_-]{HINTS}$", re.S)
#: Those that tell of a page's layout or state don't name what the element is.
STATE = re.compile(r"(?:^|[_-])(?:has|is|no|not|with|without|show|hide)[_-]|[_-](?:open|opened|closed|enabled|disabled|active|on|off)$")
WHOLE = {"article", "main", "body", "html"}
#: A class or id has no more characters than this where it is matched: longer ones name nothing.
LONGEST_NAME = 200

NAME = re.compile(r"[a-zA-Z][^\s/>]*")
#: What ends a tag, or starts a quoted value in it.
IN_TAG = re.compile(r">|=\s*([\"'])")
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
#: Lists, tables and divisions with as large a share of their characters in links, and as many links, are menus where
#: no other text stands beside the links: a paragraph or a list of references has words around them.
INSIDE_LINKS, MENU_LINKS = 0.9, 3


def _judged(tag: str, attributes: str, in_article: bool) -> tuple[bool, bool]:
    """Whether the element is furniture, and whether a class or id hints that it is."""
    if tag in DROPPED or tag == "header" and not in_article:
        return True, False
    if not attributes or tag in WHOLE:
        return False, False
    found = {}
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        found.setdefault(name.lower(), html.unescape(a or b or c))
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or found.get("role", "").lower() in ROLES:
        return True, False
    if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", "").lower()):
        return True, False
    names = f"{found.get('class', '')} {found.get('id', '')}".lower().split()
    return False, any(len(n) <= LONGEST_NAME and HINTED.match(n) and not STATE.search(n) for n in names)


def tokens(source: str):
    """(begin, end, slash, name, attributes) of each tag and comment; a comment has no name.

    A tag that the page's end cuts off reaches to the end.  Each search that
    fails once can't succeed further on, so it isn't made again.
    """
    at, size, absent = 0, len(source), set()

    def find(what: str, begin: int) -> int:
        if what in absent:
            return -1
        found = source.find(what, begin)
        if found < 0:
            absent.add(what)
        return found

    while (begin := source.find("<", at)) >= 0:
        after = source[begin + 1 : begin + 2]
        if source.startswith("<!--", begin):
            end = find("-->", begin + 4)
            at = size if end < 0 else end + 3
            yield begin, at, False, "", ""
        elif after in ("!", "?"):
            end = find(">", begin)
            at = size if end < 0 else end + 1
            yield begin, at, False, "", ""
        elif name := NAME.match(source, begin + 1 + (after == "/")):
            k = name.end()
            while stop := IN_TAG.search(source, k) if ">" not in absent else None:
                k = stop.end()
                if not stop[1]:
                    break
                quote = find(stop[1], k)
                if quote >= 0:
                    k = quote + 1
            if stop is None:
                absent.add(">")
                k = size
            yield begin, k, after == "/", name[0].lower(), source[name.end() : k - 1] if stop else ""
            at = k
        else:
            at = begin + 1


class Page:
    """The nodes of a page in document order, its furniture, and its texts with their node and block."""

    def __init__(self, source: str):
        self.tags, self.parents, self.ends = ["body"], [-1], [0]
        self.texts: list[tuple[int, int, str]] = []
        self.furniture, self.hinted = [False], []
        stack, blocks = [0], [0]  # open nodes; for each the depth of the nearest block
        depths: dict[str, list[int]] = {"body": [0]}  # of the open nodes of each tag
        block, at = 0, 0

        def close(depth: int) -> None:
            nonlocal block
            while len(stack) > depth:
                node = stack.pop()
                blocks.pop()
                depths[self.tags[node]].pop()
                self.ends[node] = len(self.tags) - 1
                block += self.tags[node] in BLOCKS

        def innermost(tags) -> int:
            return max((depths[t][-1] for t in tags if depths.get(t)), default=0)

        def node(tag: str) -> int:
            self.tags.append(tag)
            self.parents.append(stack[-1])
            self.ends.append(len(self.tags) - 1)
            self.furniture.append(False)
            return len(self.tags) - 1

        raw_end = None
        for begin, end, slash, tag, attributes in tokens(source):
            if raw_end is not None:  # within an element whose content is no markup
                if not (slash and tag == raw_end):
                    at = end
                    continue
                raw_end, at = None, begin
            if begin > at:
                self.texts.append((stack[-1], block, source[at:begin]))
            elif begin < at:
                continue
            at = end
            if not tag or tag in ("html", "body") or end == len(source) and not source.endswith(">"):
                continue
            if slash:
                if depths.get(tag):
                    close(depths[tag][-1])
                continue
            if tag in BLOCKS:  # a block ends an open paragraph
                if self.tags[stack[blocks[-1]]] == "p":
                    close(blocks[-1])
                block += 1
            if tag in CLOSES:
                while (depth := innermost(CLOSES[tag])) and depth > innermost(SCOPES.get(tag, ("table", "select"))):
                    close(depth)
            if tag in VOID:
                if tag == "br":
                    self.texts.append((stack[-1], block, " "))
                self.furniture[node(tag)] = tag in DROPPED
                continue
            own = node(tag)
            self.furniture[own], hinted = _judged(tag, attributes, bool(depths.get("article")))
            if hinted:
                self.hinted.append(own)
            if tag in RAW:
                if f"</{tag}" in source[end : end + 64].lower() or re.compile(rf"</{tag}(?=[\s/>])", re.I).search(source, end):
                    raw_end = tag
                else:
                    at = len(source)
            blocks.append(len(stack) if tag in BLOCKS else blocks[-1])
            depths.setdefault(tag, []).append(len(stack))
            stack.append(own)
        if raw_end is None and at < len(source):
            self.texts.append((stack[-1], block, source[at:]))
        close(0)
        self._count()
        self._leave_out()

    def _count(self) -> None:
        """Characters other than white space, characters in links, tags and links of each node."""
        n = len(self.tags)
        self.chars, self.link_chars, self.inner, self.links = [0] * n, [0] * n, [0] * n, [0] * n
        in_link = [False] * n
        for k in range(1, n):
            in_link[k] = self.tags[k] == "a" or in_link[self.parents[k]]
        for node, _, piece in self.texts:
            size = sum(map(len, html.unescape(piece).split()))
            self.chars[node] += size
            self.link_chars[node] += size * in_link[node]
        for k in range(n - 1, 0, -1):
            p = self.parents[k]
            self.chars[p] += self.chars[k]
            self.link_chars[p] += self.link_chars[k]
            self.inner[p] += self.inner[k] + 1
            self.links[p] += self.links[k] + (self.tags[k] == "a")

    def _leave_out(self) -> None:
        """Hinted elements are furniture, but none that holds main, without one the largest article, or without either most of the text.

        What stands in furniture is furniture.
        """
        n = len(self.tags)
        plain = lambda k: self.chars[k] - self.link_chars[k]
        articles = [k for k in range(n) if self.tags[k] == "article"]
        held = [k for k in range(n) if self.tags[k] == "main"] or ([max(articles, key=lambda k: (plain(k), -k))] if articles else [])
        holds = [0] * n
        for k in held:
            holds[k] = 1
        for k in range(n - 1, 0, -1):
            holds[self.parents[k]] += holds[k]
        for k in self.hinted:
            self.furniture[k] |= not holds[k] and (bool(held) or 2 * plain(k) <= plain(0))
        for k in range(1, n):
            self.furniture[k] |= self.furniture[self.parents[k]]

    def densities(self) -> tuple[list[float], list[float]]:
        """Composite text density of each node, and its sum over each node's children."""
        n = len(self.tags)
        body = self.link_chars[0] / max(self.chars[0], 1)
        density, sums = [0.0] * n, [0.0] * n
        for k in range(n):
            if self.chars[k]:
                c, t = self.chars[k], max(self.inner[k], 1)
                lc, lt, rest = max(self.link_chars[k], 1), max(self.links[k], 1), max(self.chars[k] - self.link_chars[k], 1)
                base = math.log(c / rest * lc + body * c + math.e)
                density[k] = max(c / t * math.log(max(c / lc * t / lt, 1.0)) / math.log(base), 0.0)
        for k in range(1, n):
            sums[self.parents[k]] += density[k]
        return density, sums

    def selected(self) -> int | None:
        """The node whose subtree is the article; None without one.

        Of equal sums a node that is or stands in an article or main comes
        first, then the denser, then the earlier.
        """
        density, sums = self.densities()
        marked = [False] * len(self.tags)
        for k in range(len(self.tags)):
            marked[k] = self.tags[k] in ("article", "main") or k > 0 and marked[self.parents[k]]
        fit = [k for k in range(len(self.tags)) if not self.furniture[k] and (sums[k] > 0 or density[k] > 0)]
        if not fit:
            return None
        best = max(fit, key=lambda k: (sums[k], marked[k], density[k], -k))
        path = [best]
        while self.parents[path[-1]] >= 0:
            path.append(self.parents[path[-1]])
        threshold = min(density[k] for k in path)
        return next((k for k in reversed(path) if density[k] > threshold), best)

    def article(self) -> str:
        """The blocks of the selected subtree without its furniture, in page order, joined by single spaces."""
        chosen = self.selected()
        if chosen is None:
            return ""
        out = self._menus(chosen)
        blocks: dict[int, list[str]] = {}
        for node, block, piece in self.texts:
            if chosen <= node <= self.ends[chosen] and not out[node]:
                blocks.setdefault(block, []).append(piece)
        done = (" ".join(html.unescape("".join(pieces)).split()) for pieces in blocks.values())
        return " ".join(b for b in done if b)

    def _menus(self, chosen: int) -> list[bool]:
        """Furniture, and what within the subtree is made of links alone."""
        out = list(self.furniture)
        for k in range(chosen + 1, self.ends[chosen] + 1):
            menu = self.tags[k] in ("ul", "ol", "div", "section", "table") and self.links[k] >= MENU_LINKS
            out[k] = out[k] or out[self.parents[k]] or menu and self.link_chars[k] > INSIDE_LINKS * self.chars[k]
        return out


def main_text(source: str | None) -> str:
    """The article's text; empty for a null, empty or textless page."""
    return Page(source).article() if source else ""


def _extract(pages: list) -> dict:
    texts = [main_text(p.decode("utf-8", "replace")) for p in known(pages)]
    return {"text": texts, "n_chars": [len(t) for t in texts]}


def extract_text(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html, ...) to (page_id, url, text, n_chars), a row per row.

    Defined cases: a null or empty html, and a page whose text is all
    furniture, give an empty text; a page cut off within a tag is read up to
    it; of nodes with equal sums the first in page order is taken; nulls in
    page_id and url pass through, repeated rows are extracted each; an empty
    table gives an empty result.  Further columns are ignored.
    """
    narrow = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return through(narrow, "text string, n_chars long", lambda: _extract, column="html")
