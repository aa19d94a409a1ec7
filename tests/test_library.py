"""Known answers of the operators, and properties that hold for any input."""

from __future__ import annotations

import random
import time
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from turnloom import shared, sources
from turnloom.functions import binary as B
from turnloom.functions import text as T
from turnloom.functions import urls as U
from turnloom.operators import archive, bundle, dom, extract, markup, merge, refs
from turnloom.operators import turns as Tu
from turnloom.plans import render
from turnloom.streaming import live


def values(spark, column, rows, schema="x string"):
    return [r[0] for r in spark.createDataFrame([(x,) if not isinstance(x, tuple) else x for x in rows], schema).select(column).collect()]


def test_text(spark):
    assert values(spark, T.clean_text(F.col("x")), [" a \n\n\n\n\n b\u00a0c ", None, "\u3000x\u00a0"]) == ["a\n\n\nb c", "", "x"]
    assert values(spark, T.fnv1a32(F.col("x")), ["abc", "", None, "é😀" * 3000]) == ["1a47e90b", "811c9dc5", "811c9dc5", _fnv("é😀" * 3000)]
    assert values(spark, T.fence_code(F.col("x"), F.lit("py!")), ["a```b"]) == ["````py\na```b\n````"]
    assert values(spark, T.safe_file_name(F.col("x")), ['a<b>:"c', " x  y ", "", None]) == ["a_b___c", "x y", "archivo", "archivo"]
    assert values(spark, T.visible_name(F.col("x")), ["C:\\d/Re.TXT", "", None]) == ["re.txt", None, None]
    assert values(spark, T.visible_name(F.col("x"), match_unnamed=True), [""]) == ["archivo"]
    assert values(spark, T.escape_html(F.col("x")), ["<a href='x'>&amp;"]) == ["&lt;a href=&#039;x&#039;&gt;&amp;amp;"]
    assert values(spark, T.file_id_of(F.col("x")), ["sediment://file_a1", "see file_abcdefgh.", "file_short", None]) == ["file_a1", "file_abcdefgh", None, None]


def _fnv(s: str) -> str:
    h, b = 2166136261, s.encode("utf-16-le")
    for i in range(0, len(b), 2):
        h = ((h ^ int.from_bytes(b[i : i + 2], "little")) * 16777619) & 0xFFFFFFFF
    return f"{h:08x}"


def test_redaction_leaves_no_secret_and_is_idempotent(spark):
    text = "at moz-extension://1234-abcd/content.js:12 see https://x.example/?sig=secret Bearer eySECRET token=abc; api_key: k"
    once = values(spark, T.redact_text(F.col("x")), [text])[0]
    assert not any(s in once for s in ("secret", "eySECRET", "1234-abcd", "abc;", ": k")) and "content.js:12" in once
    assert values(spark, T.redact_text(F.col("x")), [once]) == [once]
    assert values(spark, T.redact_text(F.col("x"), strict=True), ['token = "abc"']) == ['token = "[omitido]"']
    urls = ["https://h/p?%74oken=1&a=2", "http://h/?x=1&amp;SIG=2#key=3", "https://h/?%zz=1&b=2", "ftp://h/?token=1", None, ""]
    safe = ["https://h/p?%74oken=REDACTED&a=2", "http://h/?x=1&amp;SIG=REDACTED#key=3", "https://h/?redacted=REDACTED&b=2", "ftp://h/?token=1", "", ""]
    assert values(spark, U.redact_url(F.col("x")), urls) == safe and values(spark, U.redact_url(F.col("x")), safe) == safe
    assert [markup.redacted(u or "") for u in urls] == safe


def test_file_links(spark):
    cases = [
        ("https://firefox-source-docs.example.org/dom/xray_vision.html", False, False), ("https://example.org/guide.htm", False, False), ("https://example.org/report.html", True, True), ("sandbox:/mnt/data/prototype.html", False, True),
        ("https://example.org/report.pdf", False, True), ("https://github.com/org/repo/blob/main/README.md", False, False), ("https://chatgpt.com/backend-api/file.html", False, False), ("javascript:x.pdf", True, False), ("", True, False), ("https://x/%zz.pdf", False, False),
    ]
    rows = spark.createDataFrame(cases, "url string, download boolean, expected boolean")
    assert [r["got"] for r in rows.select(U.is_file_link(F.col("url"), F.col("download")).alias("got")).collect()] == [c[2] for c in cases]


def test_addresses_are_resolved_as_by_the_standard_library(spark):
    rng, part = random.Random(3), ["a", "b.html", "..", ".", "c d", "é"]
    bases = ["https://h.example/", "https://h.example/x/y/z.html?q=1#f", "http://h.example:80/x/", "https://h.example"]
    rows = [(rng.choice(["", "/", "", "./", "../"]) + "/".join(rng.choices(part, k=rng.randint(1, 5))) + rng.choice(["", "/", "?k=1/../2", "#f/..", "?"]), rng.choice(bases)) for _ in range(400)]
    rows += [("?k=1", bases[1]), ("#top", bases[1]), ("//other.example/p", bases[0]), ("mailto:x", bases[0])]
    got = values(spark, U.absolute_url(F.col("x"), F.col("b")), rows, "x string, b string")
    wrong = [(r, g, w) for r, g in zip(rows, got, strict=True) if g != (w := urljoin(r[1], r[0])) and g != w.removesuffix("?") and not (r[0].endswith("?") and g.removesuffix("?") == w)]
    assert not wrong
    assert values(spark, U.absolute_url(F.col("x"), F.col("b")), [("a/b", None), ("", "https://h/"), (None, "https://h/"), ("x", "nothing")], "x string, b string") == ["a/b", "", "", "x"]


def test_bytes(spark):
    assert values(spark, B.sha256_hex(F.col("x")), ["abc"]) == ["ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"]
    ramp = bytearray(i * 7 % 256 for i in range(80_001))
    df = spark.createDataFrame([(ramp,)], "x binary")
    back = df.select(B.decode_data_url(B.encode_data_url(F.col("x"), F.lit("image/png"))).alias("d")).first()["d"]
    assert back["mime"] == "image/png" and back["bytes"] == ramp and back["error"] is None
    got = [r[0] for r in spark.createDataFrame([("data:,a%20b+é",), ("data:x",), ("data:;base64,***",), (None,)], "x string").select(B.decode_data_url(F.col("x"))).collect()]
    assert bytes(got[0]["bytes"]) == "a b+é".encode("latin-1") and got[0]["mime"] == "image/jpeg" and all(g["error"] for g in got[1:])
    cases = [(b"\x89PNG\r\n\x1a\n..", "image/png", "a.PNG", None, True), (b"nope", "image/png", "a.png", None, False), (b"PK\x03\x04", "", "a.docx", None, True), (b"%PDF-1", "", "a.pdf", 6, True), (b"%PDF-1", "", "a.pdf", 7, False), (b"<p>", "text/html", "a.txt", None, False), (b"<p>", "text/html", "a.html", None, True)]
    rows = spark.createDataFrame([(bytearray(c[0]), *c[1:]) for c in cases], "b binary, m string, n string, e long, ok boolean")
    assert all((r["error"] is None) == r["ok"] for r in rows.withColumn("error", B.resource_error(F.col("b"), F.col("m"), F.col("n"), F.col("e"))).collect())


@pytest.mark.parametrize(("hints", "missing", "status"), [([1, 2, 4], [3], "gaps_detected"), ([0, 1], [], "no_internal_gaps_observed"), ([None], [], "indices_unavailable"), ([5], [], "no_internal_gaps_observed"), ([0, 200_000], [], "no_internal_gaps_observed")])
def test_continuity(spark, hints, missing, status):
    r = merge.turn_continuity(spark.createDataFrame([(1, h) for h in hints], "conv_id long, order_hint int")).first()
    assert (r["missing"], r["status"], r["complete_conversation_verified"], r["expected_total"]) == (missing, status, False, None)


def test_merge_does_not_depend_on_input_order(spark):
    rng = random.Random(1)
    rows = [(c, f"t{rng.randint(0, 5)}", s, rng.choice([1.0, 2.0, 2.0])) for c in range(4) for s in range(30)]
    best = {}
    for c, t, s, x in rows:
        if (c, t) not in best or (x, s) >= best[c, t]:
            best[c, t] = (x, s)
    for _ in range(2):
        rng.shuffle(rows)
        got = merge.merge_captures(spark.createDataFrame(rows, "conv_id long, turn_id string, capture_seq int, score double")).collect()
        assert {(r["conv_id"], r["turn_id"]): (r["score"], r["capture_seq"]) for r in got} == best


def test_order_of_turns_without_hints_and_relabelled_tiles(spark):
    turns = [(1, "a", 0, None), (1, "b", 1, 7), (1, "c", 2, None), (1, "d", 3, 5), (2, "x", 1, None), (2, "y", 0, None)]
    got = merge.order_turns(spark.createDataFrame(turns, "conv_id long, turn_id string, scan_order int, order_hint int"))
    of = {(r["conv_id"], r["turn_id"]): r["ordinal"] for r in got.collect()}
    assert [k[1] for k in sorted(of, key=lambda k: (k[0], of[k]))] == ["a", "d", "b", "c", "y", "x"]
    tiles = spark.createDataFrame([(1, "d", 1, "Turno 99 de 99 · vista 1", 99), (1, "gone", 2, "old", 4)], "conv_id long, turn_id string, tile int, label string, turn_ordinal int")
    rows = {r["turn_id"]: r for r in merge.evidence_labels(tiles, got).collect()}
    assert rows["d"]["turn_ordinal"] == 2 and rows["d"]["label"] == "Turno 2 de 4 · vista 1" and rows["d"]["capture_turn_ordinal"] == 99 and rows["gone"]["label"] == "old" and rows["gone"]["turn_ordinal"] is None


PAGE = """<main><section data-testid="conversation-turn-1" data-turn="user"><p>See <a download href="data:text/plain;base64,QQ==">a.txt</a></p><img src="data:image/png;base64,AA=="></section>
<section data-testid="conversation-turn-2" data-turn="assistant"><div class="markdown"><details open><summary>Ran</summary><div><pre>Python <pre class="x" data-tool-command><code>print(1)
print(2)</code></pre></pre><div><pre>1
2</pre></div></div></details><p>Use this in a shell command:</p><pre><code class="language-bash">ls -l</code></pre><button>Copy</button></div></section></main>"""


def test_a_page_of_two_turns(spark, tmp_path):
    dom.dom_nodes(spark.createDataFrame([(1, PAGE), (2, None), (3, "")], "page_id long, html string")).write.parquet(str(tmp_path / "nodes"))
    nodes = spark.read.parquet(str(tmp_path / "nodes"))
    turns = Tu.turn_mixed(nodes)
    assert turns.count() == 2 and [r["role"] for r in Tu.detect_role(turns, nodes).orderBy("node_id").collect()] == ["user", "assistant"]
    placed = Tu.nearest_turn(nodes, turns)
    runs = extract.tool_executions(placed).collect()
    assert [(r["tool"], r["command"], r["output"], r["status"]) for r in runs] == [("Python", "print(1)\nprint(2)", "1\n2", "output_visible")]
    kinds = [r["kind"] for r in extract.code_blocks(placed, extract.tool_executions(placed)).orderBy("index").collect()]
    assert kinds == ["tool_command", "tool_output", "shell_code"]
    base = F.lit("https://chatgpt.com/")
    assert extract.media(placed, base).count() == 1 and [r["kind"] for r in extract.linked_files(placed, base).collect()] == ["linked_file"]
    mixed = '<main><section data-testid="conversation-turn-1" data-turn="user"><p>A</p></section><div data-message-author-role="user" data-message-id="o">x</div><article data-testid="conversation-turn-4" data-turn="assistant"><p>B</p></article></main>'
    assert Tu.turn_mixed(dom.dom_nodes(spark.createDataFrame([(1, mixed)], "page_id long, html string"))).count() == 3


def test_markup():
    html = '<div onclick="x()"><script>a</script><p style="x">Hi <b>you</b><iframe src="https://f/?token=1"></iframe><input type=password value=s><a href="javascript:x">j</a><img src="/i.png?sig=1" srcset=y></p><svg><animate/></svg></div>'
    safe = markup.written(markup.sanitise(markup.parse(html), "https://h/d/"))
    assert safe == '<div><p>Hi <b>you</b><div>[iframe: https://f/?token=REDACTED]</div><a>j</a><img src="https://h/i.png?sig=REDACTED"></p><svg></svg></div>'
    inner = safe.replace("<p>", "<span>").replace("</p>", "</span>")  # a div ends a paragraph when it is read again
    assert markup.written(markup.sanitise(markup.parse(inner), "https://h/d/")) == inner
    table = "<table><tr><th>a</th><th>b|c</th></tr><tr><td>1</td><td>2</td></tr></table><ol><li>x<ul><li>y</li></ul></li></ol>"
    assert markup.to_markdown(table) == "| a | b\\|c |\n| --- | --- |\n| 1 | 2 |\n\n1. x\n  - y"
    assert markup.to_markdown("<div>" * 5000 + "deep") == "deep"


def test_bundles(spark):
    rows = spark.createDataFrame([(1, "a", bytearray(b"x")), (1, "a", bytearray(b"x")), (2, "../bad", bytearray(b"y")), (3, "ok", bytearray(b"zz"))], "conv_id long, path string, data binary")
    assert {r["conv_id"]: r["ok"] for r in bundle.bundle_check(rows).collect()} == {1: False, 2: False, 3: True}
    lines = bundle.manifest(rows)
    assert {(r["conv_id"], r["status"]) for r in bundle.verify_bundle(rows, lines).collect()} == {(1, "repeated_entry"), (2, "bad_path"), (3, "ok")}
    good = rows.filter("conv_id = 3").withColumn("stored_crc", F.crc32("data") + 1)
    assert bundle.verify_bundle(good, lines.filter("conv_id = 3")).first()["status"] == "wrong_crc"
    files = bundle.manifest_files(lines.filter("conv_id = 3")).collect()
    assert [f["path"] for f in files] == ["integrity.json", "SHA256SUMS.txt"] and files[1]["data"].endswith("  ok\n")


def test_the_ledger_keeps_to_the_budget(spark):
    rng = random.Random(2)
    rows = [(c, s, rng.choice([None, rng.randint(1, 60)]), rng.choice([None, None, "bad"])) for c in range(30) for s in range(1, 15)]
    got = archive.archive_budget(spark.createDataFrame(rows, "conv_id long, seq int, size long, error string"), 200).collect()
    assert len(got) == len(rows)
    for c in range(30):
        total = 0
        for r in sorted((r for r in got if r["conv_id"] == c), key=lambda r: r["seq"]):
            valid = r["size"] is not None and r["error"] is None
            expected = "budget_exceeded" if total >= 200 else "archived" if valid and total + r["size"] <= 200 else "failed"
            total += r["size"] if expected == "archived" else 0
            assert r["status"] == expected
        assert total <= 200


def test_branches(spark):
    nodes = [(1, "a", None, "c"), (1, "b", "a", "c"), (1, "c", "b", "c"), (1, "side", "a", "c"), (2, "x", "y", "x"), (2, "y", "x", "x"), (3, "q", None, None), (3, "p", "q", None), (4, "z", "gone", "z")]
    got = refs.active_branch(spark.createDataFrame(nodes, "conv_id long, node_id string, parent_id string, current_node string")).orderBy("conv_id", "position").collect()
    assert [(r["conv_id"], r["node_id"]) for r in got] == [(1, "a"), (1, "b"), (1, "c"), (2, "y"), (2, "x"), (3, "p"), (3, "q"), (4, "z")]


def test_streams_give_the_batch_result(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, f"2024-01-01 00:{i // 60:02d}:{i % 60:02d}", f"t{rng.randint(0, 4)}", rng.choice("AB"), False) for i in range(600)]
    every = spark.createDataFrame(rows, "event_id long, at string, turn_id string, signature string, empty boolean").selectExpr("event_id", "CAST(at AS timestamp) AS ts", "turn_id", "signature", "empty")
    for k in range(3):
        every.filter(F.col("event_id").between(200 * k, 200 * k + 199)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(every.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).withWatermark("ts", "10 minutes")

    def to_end(df, name):
        df.writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"{name}-state")).trigger(availableNow=True).start().awaitTermination()
        return {r["event_id"] for r in spark.read.parquet(str(tmp_path / name)).collect()}

    assert to_end(live.stream_dedupe(stream), "dedupe") == {r["event_id"] for r in live.live_dedupe(every).collect()}
    batch = {r["event_id"]: r["ts"] for r in live.live_debounce(every, "3 seconds").collect()}
    got = to_end(live.live_debounce(stream, "3 seconds"), "debounce")
    assert got <= set(batch) and all(str(batch[e]) >= "2024-01-01 00:0" for e in set(batch) - got)  # bursts open at the watermark wait


def test_entry_and_queries_match():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 100


def test_pages_of_any_depth_keep_their_structure():
    deep = "<div>" * 5000 + "x" + "</div>" * 5000
    assert markup.written(markup.sanitise(markup.parse(deep))) == deep
    assert markup.to_markdown(f"<blockquote>{deep}</blockquote>").strip() == "> x"
    assert markup.with_local_urls("<p>" * 1 + "<i>" * 3000 + '<a href="https://x.example/">y</a>' + "</i>" * 3000 + "</p>", {}).count("<i>") == 3000
    nested = markup.to_markdown("<ul><li>a<ul><li>b<ol><li>c</li></ol></li></ul></li></ul>")
    assert nested.split("\n") == ["- a", "  - b", "    1. c"]


def test_sanitised_text_has_nothing_active():
    html = (
        '<p onclick="x()" style="color:red" class="k">a &lt; b</p><script>1</script><a href="javascript:x()">j</a><a href="/p?token=1&a=2">r</a><img src="data:image/png;base64,AA" srcset="x">'
        '<input type="hidden" value="s"><input type="text" value="t"><iframe src="https://f.example/?sig=9"></iframe><iframe></iframe><svg><animate/><path d="M0"/></svg><object>o</object>'
    )
    clean = markup.written(markup.sanitise(markup.parse(html), "https://h.example/"))
    assert clean == (
        '<p class="k">a &lt; b</p><a>j</a><a href="https://h.example/p?token=REDACTED&amp;a=2">r</a><img src="data:image/png;base64,AA">'
        '<input type="text" value="t"><div>[iframe: https://f.example/?sig=REDACTED]</div><div>[iframe]</div><svg><path d="M0"></path></svg>'
    )


def test_wrappers_bring_no_text_and_deep_pages_scan_in_linear_time():
    begin = time.process_time()
    nodes = dom.scan("<div class=a>" * 20_000 + "words " * 2000 + "<p>end</p>")
    assert time.process_time() - begin < 20 and len(nodes) == 20_001
    assert sum(len(n["text"] or "") for n in nodes) < 100 and nodes[-1]["text"] == "end"
    lists = dom.scan("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>")
    assert [(n["tag"], n["text"], n["depth"]) for n in lists if n["tag"] == "li"] == [("li", "a", 1), ("li", "bc", 1), ("li", "c", 3), ("li", "d", 1)]


def test_files_of_one_page_document_or_resource_each_are_read(spark, tmp_path):
    (tmp_path / "a.html").write_text("<p>one\ntwo</p>")
    (tmp_path / "d.json").write_text('{"title": "t",\n "turns": [{"role": "user"}]}')
    got = sources.read_turn_html(spark, f"{tmp_path}/a.html").collect()
    assert [r["html"] for r in got] == ["<p>one\ntwo</p>"] and got[0]["path"].endswith("a.html")
    assert [r.asDict(True) for r in sources.read_conversation_json(spark, f"{tmp_path}/d.json", "title string, turns array<struct<role: string>>").collect()] == [{"title": "t", "turns": [{"role": "user"}]}]
    assert [(bytes(r["bytes"]), r["size"]) for r in sources.read_resource_blobs(spark, f"{tmp_path}/a.html").collect()] == [(b"<p>one\ntwo</p>", 14)]


def test_sandbox_links_keep_their_places_however_many(spark):
    parts = [" ".join(f"[l{i}](sandbox:/mnt/data/{p}-{i}.txt)" for i in range(1500)) for p in range(2)]
    rows = spark.createDataFrame([(1, 0, "m", "assistant", parts)], "conv_id long, seq long, message_id string, role string, parts array<string>")
    got = refs.sandbox_links(rows).orderBy("pos").collect()
    assert len({r["pos"] for r in got}) == 3000 and [r["filename"] for r in got] == [f"{p}-{i}.txt" for p in range(2) for i in range(1500)]


def test_a_report_without_archive_and_source_layer(spark):
    turns = spark.createDataFrame([(1, "user", [], [], [], [], [], [], [])], "conv_id long, role string, code_blocks array<int>, tool_executions array<int>, activities array<int>, expandables array<int>, media array<int>, links array<int>, files array<struct<href: string, kind: string, archive_status: string>>")
    conversations = spark.createDataFrame([(1, "T", "P", "U", "D", ["w"])], "conv_id long, title string, platform_label string, source_url string, exported_at string, warnings array<string>")
    continuity = spark.createDataFrame([(1, [2, 3])], "conv_id long, missing array<int>")
    none = spark.createDataFrame([], "conv_id long, total_bytes long, source_status string, references_found long, visible_references_matched long, download_urls_resolved long")
    report = render.render_report(merge.summarize_turns(turns), continuity, conversations, merge.completeness(turns), none, none).first()["report"].split("\n")
    assert report[3:9] == ["Título: T", "Plataforma: P", "URL: U", "Exportado: D", "", "Turnos: 1 (1 usuario, 0 asistente, 0 sin clasificar)"]
    assert "Bytes archivados: 0" in report and "Enriquecimiento ChatGPT: no aplicable" in report and "Índices de turno omitidos dentro del tramo observado: 2, 3" in report and report[-2:] == ["- w", ""]


@pytest.mark.parametrize(("at", "refused"), [("spark://host:7077", True), ("yarn", True), ("local-cluster[3,2,1024]", True), ("local", False), ("local[8]", False)])
def test_the_shared_folder_must_be_named_on_a_cluster(at, refused):
    class Conf:
        def get(self, key):
            return None

    class Context:
        master, found = at, None

        def getConf(self):
            return Conf()

        def getCheckpointDir(self):
            return self.found

        def setCheckpointDir(self, path):
            self.found = path

    session = type("Session", (), {"sparkContext": Context()})()
    if refused:
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            shared.shared_dir(session)
    else:
        assert shared.shared_dir(session).startswith("file:///")
