"""Queries over pages as tables of nodes: real pages, and pages made from conversations whose facts must come back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import escape_html
from ..operators import dom as D
from ..operators import extract as X
from ..operators import markup as K
from ..operators import turns as U
from ..shared import materialise, new_path
from ..sources.bundles import register
from .catalog import given, query

FNV_OF = "printf('%08x', CAST(list_reduce(list_transform(string_split({0}, ''), lambda x: CAST(unicode(x) AS bigint)), lambda h, c: (xor(h, c) * 16777619) & 4294967295, CAST(2166136261 AS bigint)) AS bigint))"
BASE = "https://chatgpt.com/c/x"


def made(spark, sf_dir) -> DataFrame:
    """(conv_id, html): a page per conversation. A turn has its text; each third a code block, the next of three one of editor lines labelled by a div, 1 of 4 a tool panel, each second a link, 2 of 4 a picture, 3 of 4 buttons."""
    rows, t = given(spark, sf_dir, "conversations"), F.col("turn")
    n = t.cast("string")
    code = F.concat(F.lit('<p>Example in</p><pre><code class="language-python">print('), n, F.lit(")\nx = 1</code></pre>"))
    editor = F.concat(F.lit('<div class="box"><div class="flex">bash</div><pre><div class="cm-scroller"><div class="cm-line">echo '), n, F.lit('</div><div class="cm-line">ls</div></div></pre></div>'))
    tool = F.concat(
        F.lit('<details open><summary>Ran code</summary><div data-tool-execution data-tool-name="Python"><pre data-tool-command><code>python run.py '), n, F.lit("</code></pre><div><pre>out "), n, F.lit("</pre></div></div></details>")
    )
    link = F.concat(F.lit('<a href="/files/'), n, F.lit('.pdf?token=s">Report '), n, F.lit('</a><a href="/files/'), n, F.lit('.pdf?token=t">Report '), n, F.lit("</a><a href='javascript:x()'>no</a>"))
    picture = F.concat(F.lit('<img src="https://img.example.org/'), n, F.lit('.png" alt="Picture" width="30"><img src="https://img.example.org/'), n, F.lit('.png"><img src="/favicon.ico">'))
    buttons = F.concat(F.lit('<button aria-expanded="false" data-testid="thinking-'), n, F.lit('">Thought</button><div role="toolbar"><button>Copy</button></div><button disabled>Go</button><div role="group" aria-label="Notes '), n, F.lit('.txt"><span data-default-action></span></div>'))
    when = lambda c, x: F.when(c, x).otherwise("")
    section = F.concat(
        F.lit('<section data-testid="conversation-turn-'), n, F.lit('" data-turn="'), "role", F.lit('" data-message-model-slug="model-'), (t % 2).cast("string"), F.lit('"><div class="text"><p class="said">'), escape_html(F.col("text")), F.lit("</p></div>"),
        when(t % 3 == 0, code), when(t % 3 == 1, editor), when(t % 4 == 1, tool), when(t % 2 == 0, link), when(t % 4 == 2, picture), when(t % 4 == 3, buttons), F.lit("</section>"),
    )
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", section.alias("s")))), lambda x: x["s"]), "\n")
    head = F.concat(F.lit("<!doctype html><html><head><title>Talk "), F.col("conv_id").cast("string"), F.lit(" - ChatGPT</title></head><body><main>"))
    return rows.groupBy("conv_id").agg(F.concat(head, body, F.lit("</main></body></html>")).alias("html"))


def nodes(spark, sf_dir) -> DataFrame:
    return D.dom_nodes(made(spark, sf_dir), "conv_id")


def turns(spark, sf_dir, n: DataFrame | None = None) -> DataFrame:
    return U.turn_mixed(nodes(spark, sf_dir) if n is None else n)


def placed(spark, sf_dir) -> DataFrame:
    n = nodes(spark, sf_dir)
    return U.nearest_turn(n, U.turn_shells(n))


def keyed(rows: DataFrame, n: DataFrame, *columns: str) -> DataFrame:
    """Facts under conv_id and the turn's number instead of node numbers."""
    own = U.turn_shells(n).select("doc_id", F.col("node_id").alias("turn_node"), F.regexp_extract(D.test_id(), r"(\d+)$", 1).cast("long").alias("turn"))
    return rows.join(own, ["doc_id", "turn_node"]).select(F.col("doc_id").alias("conv_id"), "turn", *columns)


def kept(df: DataFrame) -> DataFrame:
    return materialise(df, "kept")


def facts(spark, sf_dir, f, *columns: str) -> DataFrame:
    """The facts that f finds in nodes under their turns; pages are scanned and dealt out once, and read where they lie."""
    n = K.by_page(nodes(spark, sf_dir))
    return keyed(f(U.nearest_turn(n, U.turn_shells(n)).persist()), n, *columns)


@query("dom_nodes", "SELECT page_id AS doc_id, CAST(len(regexp_extract_all(regexp_replace(html, '<(script|style|title)>[^<]*', '<\\1>', 'g'), '<p>')) AS bigint) AS paragraphs, CAST(len(regexp_extract_all(html, '<a ')) AS bigint) AS anchors, regexp_extract(html, '<html lang=\"([^\"]*)\"', 1) AS lang, array_to_string(list_transform(regexp_extract_all(html, '<a [^>]*>([^<]*)', 1), lambda x: x), '|') AS anchor_texts, array_to_string(regexp_extract_all(html, '<a href=\"([^\"]*)', 1), '|') AS anchor_hrefs FROM pages")
def dom_nodes(spark, sf_dir):
    rows = D.dom_nodes(given(spark, sf_dir, "pages"))
    return rows.groupBy("doc_id").agg(F.count_if(F.col("tag") == "p").alias("paragraphs"), F.count_if(F.col("tag") == "a").alias("anchors"), F.max(F.when(F.col("tag") == "html", D.attr("lang"))).alias("lang"), *[F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("tag") == "a", F.struct("node_id", c.alias("x"))))), lambda x: x["x"]), "|").alias(k) for k, c in (("anchor_texts", F.col("text")), ("anchor_hrefs", D.attr("href")))])


@query("document_order", "SELECT page_id AS doc_id, 1 AS html, CAST(len(regexp_extract_all(html, '<a ')) AS bigint) AS anchors, true AS ascending FROM pages")
def document_order(spark, sf_dir):
    rows = D.dom_nodes(given(spark, sf_dir, "pages"))
    rows = U.document_order(rows.unionByName(rows.filter("tag = 'a'")))
    return rows.groupBy("doc_id").agg(F.count_if(F.col("tag") == "html").cast("int").alias("html"), F.count_if(F.col("tag") == "a").alias("anchors"), (F.max("position") + 1 == F.count("*")).alias("ascending"))


@query("conversation_title", "SELECT DISTINCT conv_id AS doc_id, 'Talk ' || conv_id AS title FROM conversations")
def conversation_title(spark, sf_dir):
    ids = given(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.lit("chatgpt").alias("platform")).distinct()
    return U.conversation_title(nodes(spark, sf_dir), ids)


TURNS_SQL = "SELECT conv_id AS doc_id, 'conversation-turn-' || turn AS test_id FROM conversations"


def _named(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", D.test_id().alias("test_id"))


query("turn_shells", TURNS_SQL)(lambda spark, sf: _named(U.turn_shells(nodes(spark, sf))))
query("turn_elements", TURNS_SQL)(lambda spark, sf: _named(U.turn_elements(n := kept(nodes(spark, sf)), n.select("doc_id", F.lit("chatgpt").alias("platform")).distinct())))


@query("turn_mixed", "SELECT conv_id AS doc_id, CASE WHEN turn % 2 = 0 THEN 'conversation-turn-' || turn ELSE '' END AS test_id FROM conversations WHERE turn % 2 = 0 OR role <> 'system'")
def turn_mixed(spark, sf_dir):
    """Every second turn has no shell: a role node, with another inside that must not count."""
    rows = given(spark, sf_dir, "conversations")
    n = F.col("turn").cast("string")
    part = F.when(F.col("turn") % 2 == 0, F.concat(F.lit('<section data-testid="conversation-turn-'), n, F.lit('"><div data-message-author-role="user">in a shell</div></section>'))).otherwise(F.concat(F.lit('<div data-message-author-role="'), "role", F.lit('"><i data-message-author-role="'), "role", F.lit('">x</i></div>')))
    html = rows.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", part.alias("s")))), lambda x: x["s"]), "").alias("html"))
    return _named(U.turn_mixed(D.dom_nodes(html, "conv_id")))


@query("turn_claude", "SELECT conv_id AS doc_id, CAST(turn AS varchar) AS count, CASE WHEN turn % 2 = 0 THEN 'user' ELSE 'assistant' END AS role FROM conversations")
def turn_claude(spark, sf_dir):
    """A container per turn with one of the same role inside, and an empty container that is no turn."""
    rows, n = given(spark, sf_dir, "conversations"), F.col("turn").cast("string")
    message = F.when(F.col("turn") % 2 == 0, '<div data-testid="user-message">hi</div>').otherwise('<div class="font-claude-response">hello</div>')
    part = F.concat(F.lit('<div data-test-render-count="'), n, F.lit('"><div data-test-render-count="inner">'), message, F.lit('</div></div><div data-test-render-count="9"><p>nothing</p></div>'))
    html = rows.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", part.alias("s")))), lambda x: x["s"]), "").alias("html"))
    got = D.dom_nodes(html, "conv_id")
    return U.detect_role(U.turn_claude(got), got).select("doc_id", D.attr("data-test-render-count").alias("count"), "role")


@query("turn_generic", "SELECT conv_id AS doc_id, CAST(count(*) AS bigint) AS turns FROM conversations GROUP BY conv_id")
def turn_generic(spark, sf_dir):
    rows = given(spark, sf_dir, "conversations")
    html = rows.groupBy("conv_id").agg(F.concat(F.lit('<article class="out">x</article><main><article class="empty"> </article>'), F.array_join(F.collect_list(F.concat(F.lit('<article class="a">'), escape_html(F.col("text")), F.lit("</article>"))), ""), F.lit("</main>")).alias("html"))
    return U.turn_generic(D.dom_nodes(html, "conv_id")).groupBy("doc_id").agg(F.count("*").alias("turns"))


@query("detect_role", "SELECT conv_id AS doc_id, turn, CASE WHEN role = 'system' THEN 'unknown' ELSE role END AS role FROM conversations")
def detect_role(spark, sf_dir):
    n = nodes(spark, sf_dir)
    return U.detect_role(U.turn_shells(n), n).select("doc_id", U.order_hint().cast("long").alias("turn"), "role")


CONTENT_SQL = FNV_OF.format("text")


@query("stable_turn_id", f"SELECT conv_id AS doc_id, CASE WHEN turn % 3 = 0 THEN 'chatgpt:data-message-id:m' || turn WHEN turn % 3 = 1 THEN 'chatgpt:turn:t' || turn ELSE 'chatgpt:content:' || CASE WHEN role = 'system' THEN 'unknown' ELSE role END || ':' || {CONTENT_SQL} END AS turn_id FROM conversations")
def stable_turn_id(spark, sf_dir):
    rows, n, k = given(spark, sf_dir, "conversations"), F.col("turn").cast("string"), F.col("turn") % 3
    own = F.when(k == 0, F.concat(F.lit(' data-turn-id="user" data-message-id="m'), n, F.lit('"'))).otherwise("")
    inner = F.when(k == 1, F.concat(F.lit('<i data-turn-id="t'), n, F.lit('"></i>'))).otherwise("")
    part = F.concat(F.lit('<article data-turn="'), "role", F.lit('"'), own, F.lit(">"), inner, escape_html(F.col("text")), F.lit("</article>"))
    html = rows.groupBy("conv_id").agg(F.array_join(F.collect_list(part), "").alias("html"))
    got = D.dom_nodes(html, "conv_id")
    found = U.detect_role(got.filter("tag = 'article'"), got)
    return U.stable_turn_id(found, got, F.lit("chatgpt")).select("doc_id", "turn_id")


query("order_hint", "SELECT conv_id AS doc_id, 'conversation-turn-' || turn AS test_id, CAST(turn AS int) AS order_hint FROM conversations")(
    lambda spark, sf: U.turn_shells(nodes(spark, sf)).select("doc_id", D.test_id().alias("test_id"), U.order_hint().alias("order_hint"))
)
query("model_slug", "SELECT conv_id AS doc_id, turn, 'model-' || (turn % 2) AS model FROM conversations")(
    lambda spark, sf: U.model_slug(U.turn_shells(n := nodes(spark, sf)), n).select("doc_id", U.order_hint().cast("long").alias("turn"), "model")
)


@query("nearest_turn", "SELECT conv_id AS doc_id, turn, text FROM conversations")
def nearest_turn(spark, sf_dir):
    n = nodes(spark, sf_dir)
    rows = U.nearest_turn(n, U.turn_shells(n)).filter(D.attr("class") == "said")
    return keyed(rows.select("doc_id", "turn_node", "text"), n, "text").withColumnRenamed("conv_id", "doc_id")


def hollow(spark, sf_dir) -> DataFrame:
    """Turns that are empty, hold only a picture, or hold text, by number."""
    rows = given(spark, sf_dir, "conversations")
    inner = F.when(F.col("turn") % 3 == 0, escape_html(F.col("text"))).when(F.col("turn") % 3 == 1, "<video></video>").otherwise("<div></div>")
    html = rows.groupBy("conv_id").agg(F.array_join(F.collect_list(F.concat(F.lit('<section data-testid="conversation-turn-'), F.col("turn").cast("string"), F.lit('">'), inner, F.lit("</section>"))), "").alias("html"))
    n = D.dom_nodes(html, "conv_id")
    return U.with_material(U.turn_shells(n), n).select("doc_id", U.order_hint().cast("long").alias("turn"), "has_material", "mounted")


query("has_material", "SELECT conv_id AS doc_id, turn FROM conversations WHERE turn % 3 < 2")(lambda spark, sf: hollow(spark, sf).filter("has_material").select("doc_id", "turn"))
query("turn_mounted", "SELECT conv_id AS doc_id, turn FROM conversations WHERE turn % 3 = 0")(lambda spark, sf: hollow(spark, sf).filter("mounted").select("doc_id", "turn"))


CODE_SQL = """(SELECT conv_id, turn, 0 AS ord, 'code' AS kind, 'python' AS language, 'print(' || turn || ')' || chr(10) || 'x = 1' AS text, 'pre' AS source, 'Example in' AS label FROM conversations WHERE turn % 3 = 0
    UNION ALL SELECT conv_id, turn, 0, 'shell_code', 'bash', 'echo ' || turn || chr(10) || 'ls', 'pre', 'bash' FROM conversations WHERE turn % 3 = 1
    UNION ALL SELECT conv_id, turn, 1, 'tool_command', 'python', 'python run.py ' || turn, 'pre', 'Python' FROM conversations WHERE turn % 4 = 1 UNION ALL SELECT conv_id, turn, 2, 'tool_output', 'text', 'out ' || turn, 'pre', 'Python · salida visible' FROM conversations WHERE turn % 4 = 1)"""


def ran(n: DataFrame) -> DataFrame:
    return X.tool_executions(n)


@query("code_text", f"SELECT conv_id, turn, text AS code FROM {CODE_SQL} c")
def code_text(spark, sf_dir):
    return facts(spark, sf_dir, lambda n: X.code_texts(n).filter("tag = 'pre'"), "code")


@query("leaf_pre", "SELECT conv_id, turn, CAST(CASE WHEN turn % 3 < 2 THEN 1 ELSE 0 END + CASE WHEN turn % 4 = 1 THEN 2 ELSE 0 END AS bigint) AS leaves FROM conversations WHERE turn % 3 < 2 OR turn % 4 = 1")
def leaf_pre(spark, sf_dir):
    return facts(spark, sf_dir, lambda n: X.leaf_pre(n)).groupBy("conv_id", "turn").agg(F.count("*").alias("leaves"))


@query("code_language", "SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN 'python' ELSE 'bash' END AS language FROM conversations WHERE turn % 3 < 2")
def code_language(spark, sf_dir):
    return facts(spark, sf_dir, lambda n: X.code_language(X.leaf_pre(n).filter("NOT array_contains(marks, 'execution')"), n), "language")


@query(
    "classify_code",
    "SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'shell_code' WHEN 1 THEN 'shell_code' ELSE 'code' END AS kind FROM conversations",
)
def classify_code(spark, sf_dir):
    t = F.col("turn") % 4
    text = F.when(t == 0, F.concat(F.lit("$ git status # in the terminal "), "text")).when(t == 1, "x = 1").when(t == 2, "git status").otherwise("terminal of an airport")
    return given(spark, sf_dir, "conversations").select("conv_id", "turn", X.classify_code(text, F.when(t == 1, "zsh").otherwise("text"), F.lit("")).alias("kind"))


@query("tool_executions", f"SELECT conv_id, turn, 0 AS index, 'Python' AS tool, 'python run.py ' || turn AS command, 'python' AS command_language, 'out ' || turn AS output, 'output_visible' AS status, {FNV_OF.format("concat('Python', chr(10), 'python run.py ', turn, chr(10), 'out ', turn)")} AS hash, 'out ' || turn AS outputs, 'combined_visible_output' AS output_kind, CAST(NULL AS int) AS exit_code, 'visible_tool_panel' AS source, CAST(CASE WHEN turn % 3 < 2 THEN 1 ELSE 0 END AS int) AS command_block_index, CAST(CASE WHEN turn % 3 < 2 THEN 2 ELSE 1 END AS varchar) AS output_block_indices FROM conversations WHERE turn % 4 = 1")
def tool_executions(spark, sf_dir):
    rows = facts(spark, sf_dir, ran, "index", "tool", "command", "command_language", "output", "status", "hash", "outputs", "output_kind", "exit_code", "source", "command_block_index", "output_block_indices")
    return rows.withColumns({"outputs": F.array_join("outputs", "|"), "output_block_indices": F.array_join(F.col("output_block_indices").cast("array<string>"), "|")})


@query("code_blocks", f"SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id, turn ORDER BY ord) - 1 AS int) AS index, CAST(row_number() OVER (PARTITION BY conv_id, turn ORDER BY ord) - 1 AS int) AS pre_index, kind, language, label, text, source, {FNV_OF.format('concat(kind, chr(10), language, chr(10), text)')} AS hash FROM {CODE_SQL} c")
def code_blocks(spark, sf_dir):
    return facts(spark, sf_dir, lambda n: X.code_blocks(n, kept(ran(n))), "index", "pre_index", "kind", "language", "label", "text", "source", "hash")


@query("expandables", "SELECT conv_id, turn, 'Ran code' AS label, true AS expanded FROM conversations WHERE turn % 4 = 1 UNION ALL SELECT conv_id, turn, 'Thought', false FROM conversations WHERE turn % 4 = 3")
def expandables(spark, sf_dir):
    return facts(spark, sf_dir, X.expandables, "label", "expanded")


@query("activities", "SELECT conv_id, turn, 'expandable' AS type, 'Ran code' AS text, true AS expanded, CAST(NULL AS varchar) AS test_id FROM conversations WHERE turn % 4 = 1 UNION ALL SELECT conv_id, turn, 'expandable', 'Thought', NULL, 'thinking-' || turn FROM conversations WHERE turn % 4 = 3")
def activities(spark, sf_dir):
    return facts(spark, sf_dir, X.activities, "type", "text", "expanded", "test_id")


@query("media", "SELECT conv_id, turn, 'image' AS kind, false AS decorative, 'https://img.example.org/' || turn || '.png' AS url, 'Picture' AS alt, CAST(30 AS int) AS width FROM conversations WHERE turn % 4 = 2 UNION ALL SELECT conv_id, turn, 'image', true, 'https://chatgpt.com/favicon.ico', NULL, NULL FROM conversations WHERE turn % 4 = 2")
def media(spark, sf_dir):
    return facts(spark, sf_dir, lambda n: X.media(n, F.lit(BASE)), "kind", "decorative", "url", "alt", "width")


@query("links", "SELECT conv_id, turn, 'Report ' || turn AS text, 'https://chatgpt.com/files/' || turn || '.pdf?token=s' AS href, 'https://chatgpt.com/files/' || turn || '.pdf?token=REDACTED' AS href_for_metadata FROM conversations WHERE turn % 2 = 0")
def links(spark, sf_dir):
    return facts(spark, sf_dir, lambda n: X.links(n, F.lit(BASE)), "text", "href", "href_for_metadata")


@query(
    "linked_files",
    "SELECT conv_id, turn, 'https://chatgpt.com/files/' || turn || '.pdf?token=s' AS href, 'Report ' || turn AS text, 'linked_file' AS kind FROM conversations WHERE turn % 2 = 0 UNION ALL SELECT conv_id, turn, 'https://chatgpt.com/files/' || turn || '.pdf?token=t', 'Report ' || turn, 'linked_file' FROM conversations WHERE turn % 2 = 0 UNION ALL SELECT conv_id, turn, NULL, 'Notes ' || turn || '.txt', 'ui_attachment' FROM conversations WHERE turn % 4 = 3",
)
def linked_files(spark, sf_dir):
    return facts(spark, sf_dir, lambda n: X.linked_files(n, F.lit(BASE)), "href", "text", "kind")


@query("ui_file_tiles", "SELECT conv_id, turn, 'Notes ' || turn || '.txt' AS name, 'ui_attachment' AS kind FROM conversations WHERE turn % 4 = 3")
def ui_file_tiles(spark, sf_dir):
    return facts(spark, sf_dir, X.ui_file_tiles, "name", "kind")


@query("interactive", "SELECT conv_id, turn, 'summary' AS tag, 'Ran code' AS text, false AS disabled FROM conversations WHERE turn % 4 = 1 UNION ALL SELECT conv_id, turn, 'button', 'Thought', false FROM conversations WHERE turn % 4 = 3 UNION ALL SELECT conv_id, turn, 'button', 'Go', true FROM conversations WHERE turn % 4 = 3")
def interactive(spark, sf_dir):
    return facts(spark, sf_dir, X.interactive, "tag", "text", "disabled")


@query("disclosure_candidates", "SELECT conv_id, turn, label, label = 'thought' AS likely FROM conversations, (VALUES ('thought'), ('copy'), ('go')) v(label) WHERE turn % 4 = 3")
def disclosure_candidates(spark, sf_dir):
    return facts(spark, sf_dir, lambda n: X.disclosure_candidates(n).withColumn("label", F.lower("label")), "label", "likely")


def snapshots(spark, sf_dir, n: DataFrame | None = None) -> DataFrame:
    ids = given(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.lit("chatgpt").alias("platform")).distinct()
    return K.turn_snapshots(nodes(spark, sf_dir) if n is None else n, ids, F.lit(BASE))


@query(
    "turn_snapshot",
    """SELECT conv_id AS doc_id, 'chatgpt:data-testid:conversation-turn-' || turn AS turn_id, CASE WHEN role = 'system' THEN 'unknown' ELSE role END AS role, 'model-' || (turn % 2) AS model, CAST(turn AS int) AS order_hint, CAST(CASE WHEN turn % 3 < 2 THEN 1 ELSE 0 END + CASE WHEN turn % 4 = 1 THEN 2 ELSE 0 END AS int) AS code_blocks, CAST(CASE WHEN turn % 4 = 1 THEN 1 ELSE 0 END AS int) AS tool_executions,
    CAST(CASE WHEN turn % 4 IN (1, 3) THEN 1 ELSE 0 END AS int) AS expandables, CAST(CASE WHEN turn % 4 IN (1, 3) THEN 1 ELSE 0 END AS int) AS activities, CAST(CASE WHEN turn % 2 = 0 THEN 1 ELSE 0 END AS int) AS links, CAST(CASE WHEN turn % 2 = 0 THEN 2 WHEN turn % 4 = 3 THEN 1 ELSE 0 END AS int) AS files, CAST(CASE WHEN turn % 4 = 2 THEN 2 ELSE 0 END AS int) AS media,
    concat_ws('|', CASE WHEN turn % 3 = 0 THEN 'code:python:print(' || turn || ')' || chr(10) || 'x = 1' WHEN turn % 3 = 1 THEN 'shell_code:bash:echo ' || turn || chr(10) || 'ls' END, CASE WHEN turn % 4 = 1 THEN 'tool_command:python:python run.py ' || turn || '|tool_output:text:out ' || turn END) AS codes, CASE WHEN turn % 4 = 1 THEN 'Python:output_visible:python run.py ' || turn || ':out ' || turn ELSE '' END AS runs,
    CASE WHEN turn % 2 = 0 THEN 'Report ' || turn || '=https://chatgpt.com/files/' || turn || '.pdf?token=s' ELSE '' END AS hrefs, CASE WHEN turn % 4 = 2 THEN 'https://img.example.org/' || turn || '.png|https://chatgpt.com/favicon.ico' ELSE '' END AS pictures, CASE turn % 4 WHEN 1 THEN 'Ran code:true' WHEN 3 THEN 'Thought:false' ELSE '' END AS states FROM conversations""",
)
def turn_snapshot(spark, sf_dir):
    rows = snapshots(spark, sf_dir)
    told = lambda c, f: F.array_join(F.transform(c, f), "|")
    texts = {
        "codes": told("code_blocks", lambda b: F.concat_ws(":", b["kind"], b["language"], b["text"])), "runs": told("tool_executions", lambda e: F.concat_ws(":", e["tool"], e["status"], e["command"], e["output"])),
        "hrefs": told("links", lambda x: F.concat_ws("=", x["text"], x["href"])), "pictures": told("media", lambda x: x["url"]), "states": told("expandables", lambda x: F.concat_ws(":", x["label"], x["expanded"].cast("string"))),
    }
    return rows.select("doc_id", "turn_id", "role", "model", "order_hint", *[F.size(c).alias(c) for c in ("code_blocks", "tool_executions", "expandables", "activities", "links", "files", "media")], *[c.alias(k) for k, c in texts.items()])


#: All text of a turn as `made` writes it, and the hashes of its code.
WHOLE_SQL = """trim(text) || CASE turn % 3 WHEN 0 THEN 'Example inprint(' || turn || ')' || chr(10) || 'x = 1' WHEN 1 THEN 'bashecho ' || turn || 'ls' ELSE '' END || CASE WHEN turn % 4 = 1 THEN 'Ran codepython run.py ' || turn || 'out ' || turn ELSE '' END ||
    CASE WHEN turn % 2 = 0 THEN 'Report ' || turn || 'Report ' || turn || 'no' ELSE '' END || CASE WHEN turn % 4 = 3 THEN 'ThoughtCopyGo' ELSE '' END"""
HASHES_SQL = f"""concat_ws(',', CASE WHEN turn % 3 = 0 THEN {FNV_OF.format("concat('code', chr(10), 'python', chr(10), 'print(', turn, ')', chr(10), 'x = 1')")} WHEN turn % 3 = 1 THEN {FNV_OF.format("concat('shell_code', chr(10), 'bash', chr(10), 'echo ', turn, chr(10), 'ls')")} END,
    CASE WHEN turn % 4 = 1 THEN {FNV_OF.format("concat('tool_command', chr(10), 'python', chr(10), 'python run.py ', turn)")} || ',' || {FNV_OF.format("concat('tool_output', chr(10), 'text', chr(10), 'out ', turn)")} END)"""
PRINT_SQL = f"concat_ws('|', CASE WHEN role = 'system' THEN 'unknown' ELSE role END, {WHOLE_SQL}, {HASHES_SQL}, CASE turn % 4 WHEN 1 THEN 'Ran code:true' WHEN 3 THEN 'Thought:false' ELSE '' END)"


@query("dom_fingerprint", f"SELECT conv_id AS doc_id, 'chatgpt:data-testid:conversation-turn-' || turn AS turn_id, {FNV_OF.format('print')} AS dom_fingerprint FROM (SELECT conv_id, turn, {PRINT_SQL} AS print FROM conversations) p")
def dom_fingerprint(spark, sf_dir):
    return snapshots(spark, sf_dir).select("doc_id", "turn_id", "dom_fingerprint")


@query(
    "page_summary",
    """SELECT conv_id AS doc_id, count(*) AS turns, count(*) AS mounted_turns, count(*) AS persistent_shells, CAST(sum(CASE WHEN turn % 3 < 2 THEN 1 ELSE 0 END + CASE WHEN turn % 4 = 1 THEN 2 ELSE 0 END) AS bigint) AS code_blocks, count(*) FILTER (turn % 4 = 1) AS tool_executions,
    CAST(sum(CASE WHEN turn % 4 = 2 THEN 2 ELSE 0 END) AS bigint) AS media, CAST(sum(CASE WHEN turn % 2 = 0 THEN 2 WHEN turn % 4 = 3 THEN 1 ELSE 0 END) AS bigint) AS files, count(*) FILTER (turn % 4 IN (1, 3)) AS expandables FROM conversations GROUP BY conv_id""",
)
def page_summary(spark, sf_dir):
    n = K.by_page(nodes(spark, sf_dir))
    return K.page_summary(n, snapshots(spark, sf_dir, n))


@query("sanitize_html", "SELECT page_id, false AS active, CAST(len(regexp_extract_all(html, '<a ')) AS bigint) AS anchors, CAST(len(regexp_extract_all(html, '<li>')) AS bigint) AS items FROM pages")
def sanitize_html(spark, sf_dir):
    rows = K.sanitized(given(spark, sf_dir, "pages"))
    active = F.col("clean").rlike(r"(?i)<(script|style|meta|link)|\son\w+=|track\(")
    count = lambda p: F.size(F.regexp_extract_all("clean", F.lit(p), F.lit(0))).cast("long")
    return rows.select("page_id", active.alias("active"), count("<a ").alias("anchors"), count("<li>").alias("items"))


@query("html_to_markdown", "SELECT conv_id, '# Turn ' || turn || chr(10) || chr(10) || 'Hello **bold** and `x`' || chr(10) || chr(10) || '- one' || chr(10) || '- two' || chr(10) || chr(10) || '> said' || chr(10) || chr(10) || '```python' || chr(10) || 'print(' || turn || ')' || chr(10) || '```' AS markdown, turn FROM conversations")
def html_to_markdown(spark, sf_dir):
    rows, n = given(spark, sf_dir, "conversations"), F.col("turn").cast("string")
    html = F.concat(F.lit("<h1>Turn "), n, F.lit("</h1>Hello <b>bold</b> and <code>x</code><br><ul><li>one</li><li>two</li></ul><blockquote>said</blockquote><pre><code class=\"language-python\">print("), n, F.lit(")</code></pre>"))
    got = K.markdown(rows.select(F.struct("conv_id", "turn").alias("k"), F.col("conv_id"), "turn", html.alias("html")))
    return got.select("conv_id", "turn", "markdown")


@query(
    "rewrite_local_urls",
    """SELECT conv_id, turn, '<img src="assets/001-a.png"><img data-original-url="https://x.example/b.png?token=REDACTED" alt="Recurso no archivado"><a href="https://y.example/?sig=REDACTED" rel="noopener noreferrer" target="_blank">' || turn || '</a>' AS html FROM conversations""",
)
def rewrite_local_urls(spark, sf_dir):
    rows, n = given(spark, sf_dir, "conversations"), F.col("turn").cast("string")
    html = F.concat(F.lit('<img src="https://x.example/a.png"><img src="https://x.example/b.png?token=1"><a href="https://y.example/?sig=2">'), n, F.lit("</a>"))
    pairs = F.array(F.struct(F.lit("https://x.example/a.png").alias("url"), F.lit("assets/001-a.png").alias("path")))
    return K.local_urls(rows.select("conv_id", "turn", html.alias("html"), pairs.alias("pairs"))).select("conv_id", "turn", F.col("local").alias("html"))


def stored(rows: DataFrame, name: str) -> DataFrame:
    """Entries (conv_id, name, bytes) written as bundles and read back."""
    register(spark := rows.sparkSession)
    rows.repartition("conv_id").write.format("turnloom_bundles").mode("append").save(to := new_path(spark, name))
    return spark.read.format("turnloom_bundles").load(to)


@query("read_turn_html", "SELECT conv_id, CAST(count(*) AS bigint) AS turns, min(turn) AS first FROM conversations GROUP BY conv_id")
def read_turn_html(spark, sf_dir):
    """Stored pages, as bytes of HTML in bundles."""
    got = stored(made(spark, sf_dir).select("conv_id", F.lit("page.html").alias("name"), F.encode("html", "UTF-8").alias("bytes")), "turn-html")
    shells = U.turn_shells(D.dom_nodes(got.select("conv_id", F.decode("bytes", "UTF-8").alias("html")), "conv_id"))
    return shells.groupBy(F.col("doc_id").alias("conv_id")).agg(F.count("*").alias("turns"), F.min(U.order_hint()).cast("long").alias("first"))


@query("read_conversation_json", "SELECT conv_id, turn + 1 AS ordinal, role, text FROM conversations")
def read_conversation_json(spark, sf_dir):
    """Exported documents, as bytes of JSON in bundles, read under a schema."""
    from ..sources import read_conversation_documents
    from .files import documents

    got = stored(documents(spark, sf_dir).select("conv_id", F.lit("conversation.json").alias("name"), F.encode("document", "UTF-8").alias("bytes")), "conversation-json")
    rows = read_conversation_documents(got.select(F.decode("bytes", "UTF-8").alias("document")), "document", "conversation_id long, turns array<struct<ordinal: long, role: string, text: string>>")
    return rows.select(F.col("conversation_id").alias("conv_id"), F.explode("turns").alias("t")).select("conv_id", "t.*")


@query("read_resource_blobs", "SELECT conv_id, url, CAST(octet_length(encode(body)) AS bigint) AS size, sha256(body) AS sha256 FROM {blobs} b")
def read_resource_blobs(spark, sf_dir):
    """Resources as bytes under their addresses; size and hash are those of the bytes that come back."""
    got = stored(given(spark, sf_dir, "blobs").select("conv_id", F.col("url").alias("name"), F.encode("body", "UTF-8").alias("bytes")), "blobs")
    return got.select("conv_id", F.col("name").alias("url"), F.octet_length("bytes").cast("long").alias("size"), F.sha2("bytes", 256).alias("sha256"))
