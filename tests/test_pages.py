"""Pages as nodes: code of editors, labels of any element, and time in proportion to the page."""

from __future__ import annotations

import time

from pyspark.sql import functions as F

from turnloom.operators import dom, extract, markup, turns

FOUR = """<section data-testid="conversation-turn-1" data-turn="assistant"><div><div class="flex">python</div><pre><div class="cm-line">import os</div><div class="cm-line">x = 1</div></pre></div>
<pre><code><span class="cm-line">a</span><span class="cm-line">b</span></code></pre><div><span>too long a label %s</span><p>json</p><pre>{}\r\n</pre></div><pre><pre class="lang-go">inner<code>go run</code></pre> outer</pre></section>""" % ("x" * 90)


def placed(spark, html):
    nodes = markup.by_page(dom.dom_nodes(spark.createDataFrame([(1, html), (2, None), (3, "")], "page_id long, html string")))
    return turns.nearest_turn(nodes, turns.turn_shells(nodes)).filter("turn_node IS NOT NULL")


def test_editor_lines_and_labels_of_plain_elements(spark):
    nodes = placed(spark, FOUR)
    rows = extract.code_blocks(nodes, extract.tool_executions(nodes)).orderBy("index").collect()
    assert [(r.pre_index, r.text, r.language, r.label) for r in rows] == [(0, "import os\nx = 1", "python", "python"), (1, "a\nb", "python", "python\n\nimport os\n\nx = 1"), (2, "{}\n", "json", "json"), (3, "go run", "go", None)]


def test_a_tool_run_in_full(spark):
    html = '<section data-testid="conversation-turn-1"><pre>before</pre><div data-tool-execution data-tool-name="Bash"><pre data-tool-command><code>bash x.sh</code></pre><div><pre>one</pre><pre>two</pre></div></div></section>'
    (r,) = extract.tool_executions(placed(spark, html)).collect()
    assert (r.tool, r.command, r.command_language, r.output, r.outputs, r.status) == ("Bash", "bash x.sh", "bash", "one\n\ntwo", ["one", "two"], "output_visible")
    assert (r.output_kind, r.exit_code, r.source, r.command_block_index, r.output_block_indices) == ("combined_visible_output", None, "visible_tool_panel", 1, [2, 3])


def test_spans_are_the_texts():
    for n in (found := dom.scan("<div>a<p>bé<b>c</b></p><script>no</script>d</div>")):
        assert n["text"] is None or n["text"] == "abécnod"[n["span_from"] : n["span_to"]]
    assert (found[0]["span_from"], found[0]["span_to"]) == (0, 7)


def test_time_in_proportion_to_the_page():
    for unit in ("<div>x", "<pre>x", "<div><pre>x</pre>", "<b>x", "<div class=flex>python<pre>x", "<ul><li>x"):
        took = []
        for n in (5_000, 20_000):
            began = time.process_time()
            assert len(dom.scan(unit * n)) >= n
            took.append(time.process_time() - began)
        assert took[1] < 12 * took[0] + 0.5, unit


def test_snapshots_share_one_scan(spark):
    pages = spark.createDataFrame([(i, FOUR.replace("turn-1", f"turn-{i}")) for i in range(5)], "page_id long, html string")
    nodes = markup.by_page(dom.dom_nodes(pages))
    platforms = nodes.select("doc_id", F.lit("chatgpt").alias("platform")).distinct()
    got = markup.turn_snapshots(nodes, platforms, F.lit("https://x.example/")).orderBy("doc_id").collect()
    assert [(r.doc_id, r.order_hint, len(r.code_blocks), r.links) for r in got] == [(i, i, 4, []) for i in range(5)]
    (summary,) = markup.page_summary(nodes, markup.turn_snapshots(nodes, platforms, F.lit("https://x.example/"))).filter("doc_id = 3").collect()
    assert (summary.turns, summary.code_blocks, summary.persistent_shells) == (1, 4, 1)
