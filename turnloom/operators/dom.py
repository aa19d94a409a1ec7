"""HTML as a table of nodes.

A scanner (the one step that needs Python) gives every element a pre-order number, the number of the
last node below it, and what its ancestors are; all questions of containment are then comparisons
and windows over these numbers. It keeps the page's text once, and of every node the span of it that is
its own (a span index): text is cut for exactly the elements that the questions ask about, as other
wrappers, nested deep, would repeat the page at every depth. Whether a label is short is told by its span.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Columns of `dom_nodes`. `marks`: what the node or an ancestor is (see marks_of); `own_marks`: what the node itself is; `code`: of
#: innermost pre, inline code, command and terminal nodes; `span_from`, `span_to`: the node's code points in the page's text.
NODES = (
    "doc_id long, node_id int, parent_id int, subtree_end int, depth int, tag string, attrs map<string,string>, text string, inner_text string, "
    "marks array<string>, own_marks array<string>, prev_text string, sibling_text string, upper_language string, above_marks array<string>, ancestors array<int>, code string, span_from int, span_to int"
)

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote details dialog dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section summary table td th tr ul".split())
SILENT = frozenset("script style template noscript".split())
ENDS_P = BLOCKS - {"summary", "td", "th", "tr", "li", "dd", "dt"}
ENDED_BY = {"p": ENDS_P, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
ENDS = {tag: {name for name, by in ENDED_BY.items() if tag in by} for tag in set().union(*ENDED_BY.values())}  # what a tag may end
LIMITS = frozenset("ul ol table div section article main body html details nav form blockquote".split())
TEXT_TAGS = frozenset("a article button code figcaption h1 h2 h3 h4 h5 h6 label li option p pre summary td textarea th title".split())
NESTING, LEVELS = ("li", "td", "th"), 8  # of these, those that hold others this deep bring no text; they are told by their span
#: Attributes, or their beginnings, that make an element one that questions ask about, whatever its tag.
ASKED = ("data-", "aria-", "role")
CLIMB = 14
BATCH_ROWS, BATCH_CHARS = 5_000, 8 << 20  # of nodes that are given to Spark at once
SHORT = 80  # code points of a label near code
BLANKS = " \t\n\r\u00a0"


def marks_of(tag: str, at: dict[str, str]) -> list[str]:
    """What an element is, for the questions that ask whether it stands in such a one."""
    test, classes = at.get("data-testid", ""), at.get("class", "").split()
    name = at.get("class", "")
    rules = {
        "pre": tag == "pre", "code": tag == "code", "nav": tag == "nav", "form": tag == "form",
        "toolbar": at.get("role") == "toolbar" or "data-message-action-bar" in at,
        "editor": at.get("id") == "code-block-viewer" or "cm-editor" in classes,
        "execution": test == "tool-execution" or "data-tool-execution" in at,
        "cited": "citation" in test or "search-result" in test or "data-citation" in at,
        "attachment": "attachment" in test or "file-download" in test or "group/file-tile" in name or "group/artifact-row" in name,
        "artifact_row": "group/artifact-row" in name,
        "tile": (at.get("role") == "group" and "aria-label" in at) or "group/file-tile" in name,
        "command": "data-tool-command" in at,
        "file_icon": test == "library-file-icon" or "data-library-file-icon-kind" in at or "data-default-action" in at,
        "message_edge": "data-message-author-role" in at or (tag in ("article", "section") and "data-turn" in at),
        "prose": "markdown" in classes or "prose" in classes,
        "turn_like": "conversation-turn" in test or (tag in ("article", "section") and "data-turn" in at),
        "main": tag == "main",
        "header": tag == "header",
        "render_count": "data-test-render-count" in at,
        "streaming": "data-is-streaming" in at,
        "user_message": test in ("user-message", "human-message") or "font-user-message" in classes,
        "assistant_message": "font-claude-response" in classes or test in ("ai-message", "message-assistant") or "data-is-streaming" in at,
    }
    return [k for k, v in rules.items() if v]


def clean(text: str) -> str:
    text = re.sub(r"[ \t]+\n", "\n", text.replace("\u00a0", " "))
    return re.sub(r"\n{4,}", "\n\n\n", re.sub(r"\n[ \t]+", "\n", text)).strip()


class Scanner(HTMLParser):
    """Nodes of one page, in document order, and its text as pieces of (first node open, text)."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.nodes: list[dict] = []
        self.stack: list[int] = []
        self.open_tags: Counter[str] = Counter()
        self.pieces: list[str] = []
        self.shown: list[str] = []

    def _open(self, tag: str, attrs: list) -> None:
        if any(self.open_tags[name] for name in ENDS.get(tag, ())):
            for i in reversed(self.stack):
                name = self.nodes[i]["tag"]
                if tag in ENDED_BY.get(name, ()):
                    self.handle_endtag(name)
                    break
                if name in LIMITS:
                    break
        at: dict[str, str] = {}
        for k, v in attrs:
            at.setdefault(k, v if v is not None else "")
        parent = self.stack[-1] if self.stack else None
        own = marks_of(tag, at)
        above = self.nodes[parent]["marks"] if parent is not None else []
        if tag in BLOCKS or tag == "br":
            self.shown.append("\n")
        i = len(self.nodes)
        self.nodes.append({
            "node_id": i, "parent_id": parent, "subtree_end": i, "depth": len(self.stack), "tag": tag, "attrs": at, "own_marks": own, "above_marks": above, "marks": sorted({*own, *above}),
            "from": len(self.pieces), "shown_from": len(self.shown), "to": len(self.pieces), "shown_to": len(self.shown), "silent": tag in SILENT or (parent is not None and self.nodes[parent]["silent"]),
        })

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self._open(tag, attrs)
        if tag not in VOID:
            self.stack.append(len(self.nodes) - 1)
            self.open_tags[tag] += 1

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if not self.open_tags[tag]:
            return
        while self.stack:
            i = self.stack.pop()
            self.open_tags[self.nodes[i]["tag"]] -= 1
            self._close(i)
            if self.nodes[i]["tag"] == tag:
                break

    def _close(self, i: int) -> None:
        n = self.nodes[i]
        n["subtree_end"], n["to"], n["shown_to"] = len(self.nodes) - 1, len(self.pieces), len(self.shown)
        if n["tag"] in BLOCKS:
            self.shown.append("\n")

    def handle_data(self, data: str) -> None:
        self.pieces.append(data)
        self.shown.append("" if self.stack and self.nodes[self.stack[-1]]["silent"] else data)

    def scan(self, html: str) -> list[dict]:
        self.feed(html)
        self.close()
        while self.stack:
            self._close(self.stack.pop())
        self._index()
        for n in self.nodes:
            asked = n["tag"] in TEXT_TAGS or n["own_marks"] or "markdown" in n["attrs"].get("class", "") or any(k.startswith(ASKED) for k in n["attrs"])
            asked = asked and not (n["tag"] in NESTING and n["node_id"] in self.outer and not n["own_marks"])
            if n["tag"] == "pre" and not n["own_marks"][1:] and n["node_id"] not in self.wanted_pre:
                asked = False
            n["text"], n["inner_text"] = (self._text(n), self._inner(n)) if asked else (None, None)
            n["span_from"], n["span_to"] = self.chars[n["from"]], self.chars[n["to"]]
            n["code"] = self._code(n)
            self._labels(n)
            n["ancestors"], up = None, n["parent_id"]
            if n["tag"] == "pre":  # from the inside out, as far as a tool's panel may reach
                n["ancestors"] = []
                while up is not None and len(n["ancestors"]) < CLIMB:
                    n["ancestors"].append(up)
                    up = self.nodes[up]["parent_id"]
        return self.nodes

    def _index(self) -> None:
        """Code points before each piece, visible ones before each piece shown, each node's place among its siblings, and where code stands."""
        self.chars = list(accumulate(map(len, self.pieces), initial=0))
        self.visible = list(accumulate((len(p) - sum(map(p.count, BLANKS)) for p in self.shown), initial=0))
        self.children: dict[int | None, list[int]] = {}
        self.place, self.inner = [], {}
        for n in self.nodes:
            own = self.children.setdefault(n["parent_id"], [])
            self.place.append(len(own))
            own.append(n["node_id"])
        self.codes = [n["node_id"] for n in self.nodes if n["tag"] == "code"]
        self.lines = [n["node_id"] for n in self.nodes if "cm-line" in n["attrs"].get("class", "").split()]
        self.outer, right = set(), {t: [] for t in NESTING}  # list items and cells that hold others LEVELS deep
        for n in reversed(self.nodes):
            if n["tag"] in NESTING:
                later, levels = right[n["tag"]], 0  # (node, levels in it) of those after this one that no other holds, the next on top
                while later and later[-1][0] <= n["subtree_end"]:
                    levels = max(levels, later.pop()[1])
                later.append((n["node_id"], levels + 1))
                if levels >= LEVELS:
                    self.outer.add(n["node_id"])
        pre = [n["node_id"] for n in self.nodes if n["tag"] == "pre"]
        self.leaves = {i for i, after in zip(pre, [*pre[1:], len(self.nodes)]) if after > self.nodes[i]["subtree_end"]}
        self.wanted_pre, outer = set(self.leaves), []  # also the nearest pre around each innermost one
        for i in pre:
            while outer and self.nodes[outer[-1]]["subtree_end"] < i:
                outer.pop()
            if i in self.leaves and outer:
                self.wanted_pre.add(outer[-1])
            outer.append(i)

    def _text(self, n: dict) -> str:
        return "".join(self.pieces[n["from"] : n["to"]])

    def _inner(self, n: dict) -> str:
        if (i := n["node_id"]) not in self.inner:
            self.inner[i] = clean(re.sub(r"\n{3,}", "\n\n", "".join(self.shown[n["shown_from"] : n["shown_to"]])))
        return self.inner[i]

    def _code(self, n: dict) -> str | None:
        """Text of the first code below (or its own); of editor lines, if there are any, joined by line ends."""
        inline = n["tag"] == "code" and "pre" not in n["marks"]
        if not (inline or n["node_id"] in self.leaves or "data-tool-command" in n["attrs"] or "data-terminal-output" in n["attrs"]):
            return None
        at = bisect_right(self.codes, n["node_id"])
        if at < len(self.codes) and self.codes[at] <= n["subtree_end"]:
            n = self.nodes[self.codes[at]]
        lines = self.lines[bisect_right(self.lines, n["node_id"]) : bisect_right(self.lines, n["subtree_end"])]
        return re.sub("\r\n?", "\n", "\n".join(self._text(self.nodes[i]) for i in lines) if lines else self._text(n))

    def _short(self, i: int) -> str | None:
        """The text of a node, if it is a label: SHORT or less. Most that are longer are told by their span."""
        n = self.nodes[i]
        if self.visible[n["shown_to"]] - self.visible[n["shown_from"]] > SHORT:
            return None
        return t if (t := self._inner(n)) and len(t) <= SHORT else None

    def _labels(self, n: dict) -> None:
        """Texts near a block of code: that just before it, else a short one among its parent's first five; and a language above it."""
        n["prev_text"] = n["sibling_text"] = n["upper_language"] = None
        if n["tag"] != "pre" or n["parent_id"] is None:
            return
        siblings, place = self.children[n["parent_id"]], self.place[n["node_id"]]
        n["prev_text"] = self._short(siblings[place - 1]) if place else None
        n["sibling_text"] = next((t for i in siblings[:5] if i != n["node_id"] and (t := self._short(i))), None)
        up = n["parent_id"]
        for _ in range(2):
            if up is None:
                break
            at = self.nodes[up]["attrs"]
            n["upper_language"] = n["upper_language"] or at.get("data-language") or at.get("data-lang") or at.get("data-code-language")
            up = self.nodes[up]["parent_id"]


def scan(html: str | None) -> list[dict]:
    return Scanner().scan(html) if html else []


def dom_nodes(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """NODES of every page; null and empty pages have none."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(NODES))
    names = [f.name for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, size = [], 0
            for k, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for n in scan(text):
                    rows.append({c: k if c == "doc_id" else list(n[c].items()) if c == "attrs" else n[c] for c in names})
                    size += len(n["text"] or "") + len(n["inner_text"] or "") + len(n["code"] or "")
                    if len(rows) >= BATCH_ROWS or size >= BATCH_CHARS:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return pages.select(F.col(key).cast("long"), html).mapInArrow(run, NODES)


def attr(name: str) -> Column:
    return F.col("attrs")[name]


def has(name: str) -> Column:
    return F.map_contains_key("attrs", name)


def test_id() -> Column:
    return F.coalesce(attr("data-testid"), F.lit(""))


def within(mark: str, own: bool = True) -> Column:
    """Whether the node (if `own`) or an ancestor has a mark."""
    return F.array_contains("marks" if own else "above_marks", mark)


def is_(mark: str) -> Column:
    return F.array_contains("own_marks", mark)


def outermost(nodes: DataFrame, *by: str) -> DataFrame:
    """The nodes that no other node of the frame contains (of the same `by`): a running maximum, not a join of all pairs."""
    before = F.max("subtree_end").over(Window.partitionBy("doc_id", *by).orderBy("node_id").rowsBetween(Window.unboundedPreceding, -1))
    return nodes.withColumn("_b", before).filter("_b IS NULL OR _b < node_id").drop("_b")


def inside(nodes: DataFrame, holders: DataFrame, columns: list[str], itself: bool = True) -> DataFrame:
    """`nodes` with `columns` of the holder (of a frame of disjoint nodes) that each stands in; null where there is none."""
    held = holders.select("doc_id", "node_id", F.struct(F.col("node_id").alias("_from"), F.col("subtree_end").alias("_to"), *columns).alias("_h"), F.lit(0).alias("_first"))
    both = nodes.withColumn("_h", F.lit(None).cast(held.schema["_h"].dataType)).withColumn("_first", F.lit(1)).unionByName(held, allowMissingColumns=True)
    w = Window.partitionBy("doc_id").orderBy("node_id", "_first").rowsBetween(Window.unboundedPreceding, 0)
    rows = both.withColumn("_h", F.last("_h", ignorenulls=True).over(w)).filter("_first = 1")
    ok = (F.col("_h._to") >= F.col("node_id")) & (F.lit(itself) | (F.col("_h._from") < F.col("node_id")))
    return rows.select(*nodes.columns, *[F.when(ok, F.col(f"_h.{c}")).alias(c) for c in columns])
