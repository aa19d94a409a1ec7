"""Main text of a page by composite text density.

Every DOM node gets its characters per tag, adjusted by its links; a node's sum of its children's
densities points at the subtree with most of the text. The least density on the path from that
node to the body is the threshold: nodes at or above it give their own best subtrees. What is kept
brings the whole <article> around it and those beside that, and the densest subtree also its <main>.

Menus, headers, footers, side bars, adverts, notices, forms and reader comments are left out where
the page says that it has one: by tag, by role, or by a class or id that is the very name of one of
them. Density alone cannot tell an advert or a reader's comment from a paragraph. But a form or box
with such a name stays, without its controls, if it holds most of the text and no heading or article
is outside it. Reading a page takes time in proportion to its length, closed or unclosed its tags.
"""

from __future__ import annotations

import heapq
import html as entities
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_batch, small_batches

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp template svg math noembed noframes object canvas audio video".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSED_BY = {
    "p": frozenset("address article aside blockquote center details dialog dir div dl dt dd fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main menu nav ol p pre section table tbody td th tr ul".split()),
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "option": frozenset(["option", "optgroup"]),
    "tr": frozenset(["tr", "tbody", "tfoot"]), "td": frozenset(["td", "th", "tr", "tbody", "tfoot"]), "th": frozenset(["td", "th", "tr", "tbody", "tfoot"]), "head": frozenset(["body"]),
}
SCOPES = frozenset("html body table ul ol dl td th article section div nav aside main footer header select".split())
LEFT_OUT = frozenset("head nav header footer aside form button select menu dialog fieldset datalist optgroup option label legend input".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form status".split())
#: What a class or id calls the parts that are to be left out.
WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsored banner menu menus nav navbar navigation breadcrumb breadcrumbs pagination header footer "
    "sidebar sidebars aside widget widgets notice notices cookie cookies consent popup form search newsletter comment comments respond reply replies hidden".split()
)
CONTAINERS = ("article", "main")

#: Parts of compound classes and ids that say where or what a box is, not what it is about: main-nav, ad-slot, comments-area.
PLACES = frozenset(
    "site main page global local primary secondary left right top bottom upper lower inner outer first last area list box block bar container wrapper wrap section region row col column "
    "item items content body text inline slot unit zone panel buttons button link links icon icons default mobile desktop small large sticky fixed posts post article thread count title footer".split()
)

_TAG = re.compile(r"/?[a-zA-Z][^\s/>]*")
_END_OR_QUOTE = re.compile(r">|=\s*[\"']")
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")


KEPT, MARKED, OUT = 0, 1, 2


def _word(token: str) -> bool:
    """Whether a class or id is one of WORDS, or is made of them and PLACES alone. In has-sidebar or popular-science the word is only a part."""
    parts = [w for w in re.split(r"[^a-z]+", token) if w]
    return any(w in WORDS for w in parts) and all(w in WORDS or w in PLACES for w in parts)


def _left_out(tag: str, attributes: str) -> int:
    """OUT, or MARKED for what may yet turn out to be the wrapper of the whole page: forms and boxes with a word."""
    if tag in LEFT_OUT and tag != "form":
        return OUT
    mark = MARKED if tag == "form" else KEPT
    if not attributes.strip() or tag in ("html", "body", *CONTAINERS):
        return mark
    at = {m[0].lower(): m[1] or m[2] or m[3] for m in _ATTRIBUTE.findall(attributes)}
    role = at.get("role", "").lower()
    if "hidden" in at or at.get("aria-hidden", "").lower() == "true" or role in ROLES and role != "form" or re.search(r"display\s*:\s*none", at.get("style", "")):
        return OUT
    return MARKED if role == "form" or any(map(_word, f"{at.get('class', '')} {at.get('id', '')}".lower().split())) else mark


class Scanner:
    """Tags of a page from left to right, each character looked at a bounded number of times."""

    def __init__(self, html: str):
        self.html, self.at, self.quotes = html, 0, True

    def _end(self, at: int) -> int:
        """Where the tag ends whose name ends at `at`: its > outside quoted values, or any > once a quote has not been closed; -1 without one."""
        pos = at
        while self.quotes and (m := _END_OR_QUOTE.search(self.html, pos)):
            if m[0] == ">":
                return m.start()
            close = self.html.find(m[0][-1], m.end())
            if close < 0:
                break
            pos = close + 1
        self.quotes = False
        return self.html.find(">", at)

    def tags(self):
        """(begin, end, name with its slash, attributes) of each tag; for comments and the like the name is empty. What follows an unclosed one is text, or no more if it is a comment."""
        html = self.html
        while (at := html.find("<", self.at)) >= 0:
            self.at = at + 1
            if html.startswith("<!--", at):
                end = html.find("-->", at + 2)
                self.at = len(html) if end < 0 else end + 3
                yield at, self.at, "", ""
            elif m := _TAG.match(html, at + 1):
                if (end := self._end(m.end())) < 0:
                    return
                self.at = end + 1
                yield at, end + 1, m[0].lower(), html[m.end() : end]
            elif html[at + 1 : at + 2] in ("!", "?", "/"):
                if (end := html.find(">", at)) < 0:
                    return
                self.at = end + 1
                yield at, end + 1, "", ""

    def skip_raw(self, name: str) -> None:
        """Go on after the end tag of a raw element, or at the end of the page."""
        m = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(self.html, self.at)
        end = self.html.find(">", m.end()) if m else -1
        self.at = len(self.html) if end < 0 else end + 1


class Page:
    """Nodes of a page in document order (parents first) and its stretches of text."""

    def __init__(self, html: str):
        self.tag, self.parent, self.mark = ["html"], [0], [KEPT]
        self.parts: list[tuple[int, str | None]] = []  # (node, text); None for the edge of a block
        stack, at, open_tags = [0], 0, Counter()
        scopes = [Counter()]  # what is open in each scope; only the innermost one's can be closed by another tag than a scope's
        blocks = [0]  # of each element of the stack, the depth of the nearest that is not inline

        def text(end: int) -> None:
            if end > at:
                self.parts.append((stack[-1], entities.unescape(html[at:end])))

        def close(tag: str) -> None:
            if not (open_tags if tag in SCOPES else scopes[-1])[tag]:
                return
            last = None
            while last != tag:
                last = self.tag[stack.pop()]
                blocks.pop()
                open_tags[last] -= 1
                if last in SCOPES:
                    scopes.pop()
                else:
                    scopes[-1][last] -= 1
                if last not in INLINE:
                    self.parts.append((stack[-1], None))

        scanner = Scanner(html)
        for begin, end, name, attributes in scanner.tags():
            text(begin)
            at = end
            if not name:
                continue
            if name[0] == "/":
                close(name[1:])
                continue
            while len(stack) > 1 and name in CLOSED_BY.get(self.tag[stack[-1]], ()):
                close(self.tag[stack[-1]])
            if name in CLOSED_BY["p"] and open_tags["p"]:  # inline elements left open inside a paragraph end with it
                if self.tag[stack[blocks[-1]]] == "p":
                    close("p")
            if name not in INLINE:
                self.parts.append((stack[-1], None))
            if name == "br":
                self.parts.append((stack[-1], " "))
            self.tag.append(name)
            self.parent.append(stack[-1])
            self.mark.append(OUT if name in RAW else _left_out(name, attributes))
            if name in RAW:
                if not attributes.endswith("/"):
                    scanner.skip_raw(name)
                    at = scanner.at
            elif name not in VOID and not (attributes.endswith("/") and name not in CLOSED_BY["p"]):
                blocks.append(blocks[-1] if name in INLINE else len(stack))
                stack.append(len(self.tag) - 1)
                open_tags[name] += 1
                if name in SCOPES:
                    scopes.append(Counter())
                else:
                    scopes[-1][name] += 1
        text(len(html))

        n = len(self.tag)
        self.out, self.boxed, self.inside = [False] * n, [False] * n, [False] * n  # inside: below what is left out and is no header
        for i in range(1, n):
            self._settle(i)
        if MARKED in self.mark:
            self._keep_wrappers()

    def _settle(self, i: int) -> None:
        """Whether a node is left out, from its parent. A heading in the header of an article, the article's own title, is not."""
        p = self.parent[i]
        title = self.tag[i] in HEADINGS and self.tag[p] == "header" and self.boxed[p] and not self.inside[p]
        self.out[i] = self.out[p] and not title or self.mark[i] != KEPT
        self.boxed[i] = self.boxed[p] or self.tag[i] in CONTAINERS
        self.inside[i] = self.inside[p] or self.out[i] and self.tag[i] != "header"

    def _keep_wrappers(self) -> None:
        """Keep a marked box that holds most of the page's text outside links, if what is outside it has no heading and no article; then one within it, and so on.

        A node is looked at again only when it is kept after all.
        """
        n = len(self.tag)
        gone, own, text = [False] * n, [0] * n, [0] * n
        for i in range(1, n):
            gone[i] = gone[self.parent[i]] or self.mark[i] == OUT or self.tag[i] == "a"
        for i, t in self.parts:
            if t and not gone[i]:
                own[i] += len(t.strip())
        text[:] = own
        for i in range(n - 1, 0, -1):
            text[self.parent[i]] += text[i]
        children: list[list[int]] = [[] for _ in range(n)]
        for i in range(1, n):
            children[self.parent[i]].append(i)
        told = lambda i: text[i] and not self.out[i] and (self.tag[i] in HEADINGS or self.tag[i] in CONTAINERS)
        if any(told(i) for i in range(n)):
            return
        kept = sum(x for x, out in zip(own, self.out, strict=True) if not out)
        boxes = [(-text[i], i) for i in range(1, n) if self.mark[i] == MARKED and not self.out[self.parent[i]]]
        heapq.heapify(boxes)
        while boxes and -boxes[0][0] > kept:
            _, best = heapq.heappop(boxes)
            self.mark[best] = KEPT
            todo, found = [best], False
            while todo:
                i = todo.pop()
                self._settle(i)
                if not self.out[i]:
                    kept += own[i]
                    found = found or bool(told(i))
                elif self.mark[i] == MARKED and not self.out[self.parent[i]]:
                    heapq.heappush(boxes, (-text[i], i))
                if not self.out[i] or self.tag[i] == "header" and not self.inside[i]:
                    todo += children[i]
            if found:
                return

    def densities(self) -> tuple[list[int], list[float], list[float]]:
        """(characters, link-adjusted density, sum of the children's densities) of each node, of what is not left out."""
        n = len(self.tag)
        chars, tags, link_chars, link_tags, total = [0] * n, [0] * n, [0] * n, [0] * n, [0.0] * n
        linked = [False] * n
        for i in range(1, n):
            linked[i] = linked[self.parent[i]] or self.tag[i] == "a"
        for i, t in self.parts:
            if t and not self.out[i]:
                chars[i] += (c := len(t.strip()))
                link_chars[i] += c * linked[i]
        for i in range(n - 1, 0, -1):
            if not self.out[i]:
                p = self.parent[i]
                chars[p] += chars[i]
                tags[p] += tags[i] + 1
                link_chars[p] += link_chars[i]
                link_tags[p] += link_tags[i] + (self.tag[i] == "a")
        share = link_chars[0] / max(1, chars[0])
        density = [0.0] * n
        for i in range(n):
            if chars[i] and not self.out[i]:
                c, t, lc, lt = chars[i], max(1, tags[i]), link_chars[i], link_tags[i]
                base = math.log(c / max(1, c - lc) * lc + share * c + math.e)
                density[i] = c / t * math.log(max(c / max(1, lc) * t / max(1, lt), 1.0)) / max(math.log(base), 1.0) if base > 1 else 0.0
        for i in range(1, n):
            total[self.parent[i]] += density[i]
        return chars, density, total

    def content(self) -> list[bool]:
        """Which nodes are part of the main text."""
        n = len(self.tag)
        chars, density, total = self.densities()
        best = list(range(n))
        for i in range(n - 1, 0, -1):
            if not self.out[i] and total[best[i]] > total[best[self.parent[i]]]:
                best[self.parent[i]] = best[i]
        target = best[0]
        path = [target]
        while path[-1]:
            path.append(self.parent[path[-1]])
        body = [i for i in path if self.tag[i] != "html"] or path
        threshold = min(density[i] for i in body)
        keep = [False] * n
        for i in range(n):
            if not self.out[i] and chars[i] and density[i] >= threshold:
                keep[best[i]] = True
            if self.tag[i] in HEADINGS and self.parent[i] in (target, self.parent[target]):
                keep[i] = True
        keep[target] = True
        box = next((i for i in path if self.tag[i] in CONTAINERS), 0)
        keep[box] = keep[box] or box > 0
        article = list(range(n))  # of each node, the nearest article around it
        for i in range(1, n):
            article[i] = i if self.tag[i] == "article" else article[self.parent[i]]
        kept = {article[i] for i in range(n) if keep[i] and article[i] and not self.out[i]}
        beside = {self.parent[i] for i in kept}
        for i in range(1, n):
            keep[i] = keep[i] or i in kept or self.tag[i] == "article" and self.parent[i] in beside
        for i in range(1, n):
            keep[i] = (keep[i] or keep[self.parent[i]]) and not self.out[i]
        return keep


def main_text(html: str | None) -> str:
    """Blocks in page order, parted by an empty line; white space inside a block is one space. Null gives no text."""
    if not html:
        return ""
    page = Page(html)
    keep, blocks, now = page.content(), [], []
    for i, t in page.parts:
        if t is None:
            blocks.append("".join(now))
            now = []
        elif keep[i]:
            now.append(t)
    blocks.append("".join(now))
    return "\n\n".join(x for b in blocks if (x := " ".join(b.split())))


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every row, from the whole html; null or empty html gives an empty text, an empty table no rows."""
    small_batches(pages.sparkSession, 500, 8 << 20)

    def run(b: pa.RecordBatch) -> dict:
        texts = [main_text(x) for x in b.column(2).to_pylist()]
        return {"page_id": b.column(0), "url": b.column(1), "text": texts, "n_chars": list(map(len, texts))}

    return by_batch(pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).alias("html")), run, "page_id long, url string, text string, n_chars long")
