"""Rewriting of markup, and turns as whole records.

Three rewritings of a page's tree share one parser: sanitising, Markdown, and local addresses.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Callable, Generator, Iterator
from html.parser import HTMLParser
from urllib.parse import unquote, urljoin

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_text, fnv1a32
from ..functions.urls import SECRET_KEY
from ..shared import materialise
from . import extract as X
from . import turns as U
from .dom import ENDED_BY, LIMITS, VOID, attr, has

#: What a kept page must not contain.
FORBIDDEN = frozenset("script style link meta object embed base template".split())
FORBIDDEN_IN_SVG = frozenset("foreignobject animate set".split())
RISKY_ATTRIBUTES = frozenset("nonce integrity srcdoc action formaction ping autofocus autoplay form style srcset".split())
ADDRESSES = ("href", "src", "poster", "xlink:href")
UNREAD = frozenset("script style noscript svg template".split())

_PAIR = re.compile(r"(&amp;|[?&])([^=&#\s]+)=([^&#\s]*)", re.I)
_SECRET = re.compile(SECRET_KEY, re.I)
_BAD_PERCENT = re.compile(r"%(?![0-9A-Fa-f]{2})")


def redacted(url: str) -> str:
    """As `redact_url`, for one address inside a page."""
    if not re.match("(?i)https?:", url):
        return url

    def pair(m: re.Match) -> str:
        if _BAD_PERCENT.search(m[2]):
            return f"{m[1]}redacted=REDACTED"
        return f"{m[1]}{m[2]}=REDACTED" if _SECRET.match(unquote(m[2])) else m[0]

    return _PAIR.sub(pair, url)


def absolute(base: str | None, url: str) -> str:
    if re.match(r"(?i)[a-z][a-z0-9+.-]*:", url):
        return url
    try:
        return urljoin(base or "", url)
    except ValueError:
        return url


class Node:
    __slots__ = ("attrs", "children", "tag")

    def __init__(self, tag: str, attrs: dict[str, str | None]):
        self.tag, self.attrs, self.children = tag, attrs, []

    def text(self) -> str:
        """All text below, without recursion."""
        out, todo = [], [self]
        while todo:
            n = todo.pop()
            if isinstance(n, str):
                out.append(n)
            else:
                todo += reversed(n.children)
        return "".join(out)


class _Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("", {})
        self.stack = [self.root]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        for n in reversed(self.stack[1:]):
            if tag in ENDED_BY.get(n.tag, ()):
                self.handle_endtag(n.tag)
                break
            if n.tag in LIMITS:
                break
        at: dict[str, str | None] = {}
        for k, v in attrs:
            at.setdefault(k, v)
        node = Node(tag, at)
        self.stack[-1].children.append(node)
        if tag not in VOID:
            self.stack.append(node)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.stack[-1].tag == tag:
            self.stack.pop()

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag == tag:
                del self.stack[i:]
                return

    def handle_data(self, data: str) -> None:
        self.stack[-1].children.append(data)


def parse(html: str) -> Node:
    t = _Tree()
    t.feed(html)
    t.close()
    return t.root


def walked(step: Generator):
    """The value of a generator that yields generators of its own kind for their values: recursion on a stack of its own, so no page is too deep."""
    stack, value = [step], None
    while stack:
        try:
            stack.append(stack[-1].send(value))
            value = None
        except StopIteration as end:
            stack.pop()
            value = end.value
    return value


def written(node: Node) -> str:
    out: list[str] = []
    stack: list[tuple[Node | str, str]] = [(node, "")]  # what is next, or the end of a tag; and its parent's tag
    while stack:
        now, inside = stack.pop()
        if isinstance(now, str):
            out.append(now if inside in ("script", "style", ">") else now.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;"))
            continue
        if now.tag:
            at = "".join(f" {k}" if v is None else f' {k}="{entities.escape(v, quote=False).replace(chr(34), "&quot;")}"' for k, v in now.attrs.items())
            out.append(f"<{now.tag}{at}>")
            if now.tag in VOID:
                continue
            stack.append((f"</{now.tag}>", ">"))
        stack += [(c, now.tag) for c in reversed(now.children)]
    return "".join(out)


def sanitise(node: Node, base: str | None = None) -> Node:
    """A copy without what runs, loads or gives away: active elements, handlers, styles, secret values."""
    return walked(_sanitised(node, base, False))


def _sanitised(node: Node, base: str | None, in_svg: bool) -> Generator:
    out = Node(node.tag, {})
    for k, v in node.attrs.items():
        if k.startswith("on") or k in RISKY_ATTRIBUTES:
            continue
        if k in ADDRESSES and v is not None:
            url = absolute(base, v)
            if re.match("(?i)(javascript|vbscript):", url) or (k != "src" and re.match("(?i)data:", url)):
                continue
            v = redacted(url)
        out.attrs[k] = v
    for c in node.children:
        if isinstance(c, str):
            out.children.append(c)
        elif c.tag in FORBIDDEN or (in_svg and c.tag in FORBIDDEN_IN_SVG) or (c.tag == "input" and (c.attrs.get("type") or "").lower() in ("password", "hidden")):
            continue
        elif c.tag == "iframe":
            src = c.attrs.get("src")
            placeholder = Node("div", {})
            placeholder.children.append(f"[iframe: {redacted(absolute(base, src))}]" if src else "[iframe]")
            out.children.append(placeholder)
        else:
            out.children.append((yield _sanitised(c, base, in_svg or c.tag == "svg")))
    return out


def fenced(text: str, language: str) -> str:
    tick = "`" * max([3, *(len(m) + 1 for m in re.findall("`+", text))])
    tag = re.sub(r"[^\w+.#-]", "", language)
    return f"{tick}{'' if tag == 'text' else tag}\n{text}{'' if text.endswith(chr(10)) else chr(10)}{tick}"


class _Markdown:
    def __init__(self, base: str | None):
        self.base, self.kept = base, []

    def address(self, url: str | None) -> str:
        return redacted(absolute(self.base, url)).replace(")", "%29") if url else ""

    def block(self, node: Node) -> str:
        code = next((c for c in _all(node) if c.tag == "code"), node)
        m = re.search(r"(?i)(?:language-|lang-)([a-z0-9_+#.-]+)", f"{node.attrs.get('class') or ''} {code.attrs.get('class') or ''}")
        language = m[1].lower() if m else next((x.attrs[a] for x in (node, code) for a in ("data-language", "data-lang", "data-code-language") if x.attrs.get(a)), "text")
        self.kept.append(fenced(re.sub("\r\n?", "\n", code.text()), language))
        return f"\n\n\x00{len(self.kept) - 1}\x00\n\n"

    def _every(self, children: list[Node | str], depth: int) -> Generator:
        out = []
        for c in children:
            out.append(c.replace("\x00", "") if isinstance(c, str) else (yield self.of(c, depth)))
        return "".join(out)

    def of(self, node: Node, depth: int = 0) -> Generator:
        tag = node.tag
        if tag in UNREAD:
            return ""
        if tag == "pre":
            return self.block(next((c for c in _all(node) if c.tag == "pre" and not any(x.tag == "pre" for x in _all(c))), node))
        if tag == "code":
            return "`" + node.text().replace("`", "\\`") + "`"
        if tag in ("ul", "ol"):
            items = []
            for x in node.children:
                if isinstance(x, Node) and x.tag == "li":
                    items.append((yield self._every(x.children, depth + 1)).strip())
            return "\n" + "\n".join("  " * depth + (f"{i}. " if tag == "ol" else "- ") + x for i, x in enumerate(items, 1)) + "\n"
        if tag == "table":
            rows = [[c.text().strip().replace("|", "\\|").replace("\n", "<br>") for c in r.children if isinstance(c, Node)] for r in _all(node) if r.tag == "tr"]
            lines = [f"| {' | '.join(r)} |" for r in rows]
            return "\n" + "\n".join([*lines[:1], f"| {' | '.join('---' for _ in rows[0])} |", *lines[1:]]) + "\n" if rows else ""
        inner = yield self._every(node.children, depth)
        if re.fullmatch("h[1-6]", tag):
            return f"\n{'#' * int(tag[1])} {inner.strip()}\n\n"
        if tag in ("p", "div", "section", "article"):
            return inner + "\n"
        if tag == "img":
            src = self.address(node.attrs.get("src"))
            return f"![{re.sub(r'([\\`*_{}\[\]()#+.!|>-])', r'\\\1', node.attrs.get('alt') or 'imagen')}]({src})" if src else ""
        if tag == "a":
            href = self.address(node.attrs.get("href"))
            return f"[{inner.strip() or href}]({href})" if href else inner
        if tag == "blockquote":
            return "\n" + "\n".join("> " + x for x in inner.strip().split("\n")) + "\n"
        if tag == "button" or node.attrs.get("role") == "button":
            return (inner.strip() or node.attrs.get("aria-label") or "") + "\n"
        return {"br": "\n", "hr": "\n---\n"}.get(tag) or (f"**{inner}**" if tag in ("strong", "b") else f"*{inner}*" if tag in ("em", "i") else inner)


def _all(node: Node) -> Iterator[Node]:
    """The nodes below, in document order."""
    stack = [c for c in reversed(node.children) if isinstance(c, Node)]
    while stack:
        yield (now := stack.pop())
        stack += [c for c in reversed(now.children) if isinstance(c, Node)]


def to_markdown(html: str | None, base: str | None = None) -> str:
    """Headings, lists, tables, quotes, links, images and fenced code; at most three line ends in a row outside code."""
    if not html:
        return ""
    m = _Markdown(base)
    text = re.sub(r"\n{4,}", "\n\n\n", walked(m.of(parse(html)))).strip()
    text = re.sub(r"\n{3,}(?=\x00)|(?<=\x00)\n{3,}", "\n\n", text)
    return re.sub("\x00(\\d+)\x00", lambda x: m.kept[int(x[1])], text)


def with_local_urls(html: str | None, paths: dict[str, str], base: str | None = None) -> str:
    """Archived addresses as local paths; other sources taken out and kept, redacted, beside; links open apart."""
    if not html:
        return ""
    root = parse(html)
    for n in _all(root):
        for k in [k for k in ADDRESSES if n.attrs.get(k)]:
            value = n.attrs[k]
            url = absolute(base, value)
            local = paths.get(url) or paths.get(redacted(url)) or (value if value in paths.values() else None)
            if local:
                n.attrs[k] = local
            elif k in ("src", "poster") or n.tag == "use":
                del n.attrs[k]
                n.attrs["data-original-url"] = redacted(url)
                if n.tag == "img" and not n.attrs.get("alt"):
                    n.attrs["alt"] = "Recurso no archivado"
            else:
                n.attrs[k] = redacted(url)
        if n.tag == "a":
            n.attrs["rel"], n.attrs["target"] = "noopener noreferrer", "_blank"
    return written(root)


def _with_text(df: DataFrame, columns: list[str], name: str, f: Callable[..., str]) -> DataFrame:
    """`df` with a string column made by f of some columns, in Arrow batches."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StringType, StructType

    rows = df.withColumn(name, F.lit(None).cast("string")) if name not in df.columns else df
    schema = StructType([x for x in rows.schema])
    schema[name].dataType, at = StringType(), rows.columns.index(name)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [f(*x) for x in zip(*(b.column(c).to_pylist() for c in columns), strict=True)]
            made = list(b.columns)
            made[at] = pa.array(got, pa.string())
            yield pa.RecordBatch.from_arrays(made, schema=arrow)

    return rows.mapInArrow(run, schema)


def sanitized(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """Pages with `clean`: the sanitised markup; null as empty."""
    return _with_text(pages, [html, url], "clean", lambda h, u: written(sanitise(parse(h), u)) if h else "")


def markdown(pages: DataFrame, html: str = "html") -> DataFrame:
    return _with_text(pages, [html], "markdown", to_markdown)


def local_urls(pages: DataFrame, html: str = "html", pairs: str = "pairs") -> DataFrame:
    """Pages with `local`, by each page's own pairs (array of structs url, path)."""
    return _with_text(pages, [html, pairs], "local", lambda h, p: with_local_urls(h, {x["url"]: x["path"] for x in p or []}))


def by_page(nodes: DataFrame) -> DataFrame:
    """Nodes dealt out by their page, once, and kept so: every window, join and group within pages reads them where they lie."""
    n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return nodes.repartition(n, "doc_id").persist(StorageLevel.MEMORY_AND_DISK)


def turn_facts(parts: dict[str, DataFrame]) -> DataFrame:
    """The facts of each turn as one ordered array for each kind: all kinds are one stream of tagged rows, and one group per turn gathers them."""
    stream = None
    for name, rows in parts.items():
        columns = [c for c in rows.columns if c not in (*X.TURN, "index")]
        tagged = rows.select(*X.TURN, F.struct("index", F.struct(*columns).alias("f")).alias(name))
        stream = tagged if stream is None else stream.unionByName(tagged, allowMissingColumns=True)
    got = stream.groupBy(*X.TURN).agg(*[F.array_sort(F.collect_list(name)).alias(name) for name in parts])
    return got.select(*X.TURN, *[F.transform(name, lambda x: x["f"]).alias(name) for name in parts])


def turn_snapshots(nodes: DataFrame, platforms: DataFrame, base: Column) -> DataFrame:
    """A record per turn of each page: identity, role, texts, and arrays of its facts.

    Pages are scanned once and dealt out once (see `by_page`); what follows stays within a page. Give nodes that `by_page` has kept to share them.
    """
    if not nodes.storageLevel.useDisk:
        nodes = by_page(nodes)
    turns = materialise(U.turn_elements(nodes, platforms), "turn-elements")
    named = U.identified(turns, nodes, platforms).filter("has_material")
    placed = U.nearest_turn(nodes, turns).filter("turn_node IS NOT NULL").persist(StorageLevel.MEMORY_AND_DISK)
    runs = materialise(X.tool_executions(placed), "tool-executions")
    facts = turn_facts({
        "code_blocks": X.code_blocks(placed, runs), "tool_executions": runs.drop("command_node", "output_nodes"), "expandables": X.expandables(placed), "activities": X.activities(placed),
        "links": X.links(placed, base), "files": X.linked_files(placed, base), "media": X.media(placed, base), "interactive": X.interactive(placed),
    })
    text, every = clean_text(F.col("inner_text")), clean_text(F.col("text"))
    out = named.select("doc_id", F.col("node_id").alias("turn_node"), "turn_id", "role", "model", U.order_hint().alias("order_hint"), text.alias("text"), F.when(text != every, every).alias("all_text"), every.alias("_every"), "mounted")
    out = out.join(facts, list(X.TURN), "left").withColumns({c: F.coalesce(c, F.array().cast(facts.schema[c].dataType)) for c in facts.columns if c not in X.TURN})
    states = F.array_join(F.transform("expandables", lambda e: F.concat(F.coalesce(e["label"], F.lit("null")), F.lit(":"), e["expanded"].cast("string"))), "|")
    print_ = F.concat_ws("|", "role", "_every", F.array_join(F.transform("code_blocks", lambda b: b["hash"]), ","), states)
    return out.withColumn("dom_fingerprint", fnv1a32(print_)).drop("_every")


def page_summary(nodes: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Preview counts per page. Expandables are counted as nodes here, not as distinct ones. Nodes kept by `by_page` are scanned once for all."""
    total = lambda c: F.sum(F.size(c)).cast("long")
    got = snapshots.groupBy("doc_id").agg(F.count("*").alias("turns"), F.count_if("mounted").alias("mounted_turns"), total("code_blocks").alias("code_blocks"), total("tool_executions").alias("tool_executions"), total("media").alias("media"), total("files").alias("files"))
    shells = U.turn_shells(nodes).groupBy("doc_id").agg(F.count("*").alias("persistent_shells"))
    details = nodes.filter("tag = 'details'").select("doc_id", F.col("node_id").alias("parent_id"), F.lit(True).alias("_d"))
    rows = nodes.join(details, ["doc_id", "parent_id"], "left")
    open_ = (has("aria-expanded") & ((F.col("tag") == "button") | F.coalesce(attr("role") == "button", F.lit(False)))) | ((F.col("tag") == "summary") & F.col("_d").isNotNull())
    expandables = rows.groupBy("doc_id").agg(F.count_if(open_).alias("expandables"))
    return got.join(shells, "doc_id", "left").join(expandables, "doc_id", "left").withColumn("persistent_shells", F.coalesce("persistent_shells", F.lit(0)))
