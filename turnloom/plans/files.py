"""Queries of documents, bundles, archives and their logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import archive as A
from ..operators import bundle as Bu
from ..operators import merge as M
from ..shared import new_path
from . import render as R
from .catalog import ORACLE, given, query
from .merging import HINTS_SQL, MISSING_SQL, hinted, populated
from .scalars import HTML_SQL, ROLE_SQL

HEAD_SQL = "'# Conversation ' || conv_id || chr(10) || chr(10) || 'Plataforma: ChatGPT' || chr(10) || 'Captura: 2026-01-01T00:00:00.000Z' || chr(10) || 'Turnos conservados: '"


def conversations(spark, sf_dir) -> DataFrame:
    ids = given(spark, sf_dir, "conversations").select("conv_id").distinct()
    warnings = F.when(F.col("conv_id") % 3 == 0, F.array(F.lit("first"), F.lit("second"))).otherwise(F.array().cast("array<string>"))
    return ids.select("conv_id", F.concat(F.lit("Conversation "), "conv_id").alias("title"), F.lit("ChatGPT").alias("platform_label"), F.concat(F.lit("https://chatgpt.com/c/"), "conv_id").alias("source_url"), F.lit("2026-01-01T00:00:00.000Z").alias("exported_at"), warnings.alias("warnings"))


def shown(spark, sf_dir) -> DataFrame:
    """Turns with one file each; every fourth has a local copy, the second of four no address."""
    rows = given(spark, sf_dir, "files").join(given(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), ["conv_id", "turn"])
    local = F.when(F.col("turn") % 4 == 0, F.concat(F.lit("files/001-"), "name"))
    return rows.select("conv_id", (F.col("turn") + 1).alias("ordinal"), "role", "text", F.when(F.col("turn") % 2 == 0, F.concat(F.lit("**md** "), "text")).alias("markdown"), F.array(F.struct("href", "name", local.alias("local_path"), (F.col("turn") * 7001 + 5).alias("size"))).alias("files"))


TURN_SQL = """'## ' || (turn + 1) || '. ' || {role} || chr(10) || chr(10) || CASE WHEN turn % 2 = 0 THEN '**md** ' ELSE '' END || text || chr(10) || chr(10) || '### Archivos' || chr(10) || chr(10) ||
    CASE WHEN turn % 4 = 0 THEN '[' || name || '](files/001-' || replace(name, ' ', '%20') || ')' WHEN turn % 4 = 1 THEN name || ' — referencia sin copia local' ELSE '[' || name || '](' || href || ') — sin copia local' END || chr(10) || chr(10) || '---' || chr(10)""".format(role=ROLE_SQL)
SIZE_SQL = "CASE WHEN {0} < 10000 THEN CAST({0} AS varchar) ELSE replace(format('{{:,}}', {0}), ',', '.') END"
SHOWN_SQL = "(SELECT f.conv_id, f.turn, f.role, f.href, f.name, c.text FROM {files} f JOIN conversations c ON c.conv_id = f.conv_id AND c.turn = f.turn)"


@query(
    "render_markdown",
    f"""SELECT conv_id, {HEAD_SQL} || count(*) || '. La cobertura completa no está certificada.' || chr(10) || chr(10) || string_agg(part, chr(10) ORDER BY turn) ||
    CASE WHEN conv_id % 3 = 0 THEN chr(10) || '## Advertencias' || chr(10) || chr(10) || '- first' || chr(10) || '- second' || chr(10) ELSE '' END AS markdown FROM (SELECT conv_id, turn, {TURN_SQL} AS part FROM {SHOWN_SQL} s) t GROUP BY conv_id""",
)
def render_markdown(spark, sf_dir):
    return R.render_markdown(shown(spark, sf_dir), conversations(spark, sf_dir))


PAGE_SQL = f"""'<!doctype html><html lang="es"><head><meta charset="utf-8"><meta http-equiv="Content-Security-Policy" content="{R.POLICY.replace("'", "''")}"><title>Conversation ' || conv_id || '</title><style>{R.STYLE}</style></head><body><main class="wrap"><h1>Conversation ' || conv_id || '</h1>'"""


def page_sql(linked: str) -> str:
    """SQL of a page whose files are list items by an expression."""
    return f"""SELECT conv_id, {PAGE_SQL} || string_agg('<section class="turn ' || role || '" id="turn-' || (turn + 1) || '"><h2>' || (turn + 1) || '. ' || {ROLE_SQL} || '</h2><pre>' || {HTML_SQL.format("text")} || '</pre><ul>' ||
    {linked} || '</ul></section>', chr(10) ORDER BY turn) || '</main></body></html>' AS html"""


NO_COPY_SQL = "'<li>' || name || ' — <strong>sin copia local</strong></li>'"
BUDGET = 60  # bytes that a single page may hold in the query


@query(
    "render_html",
    f"""{page_sql(f"""CASE WHEN turn % 4 = 0 THEN '<li><a download="' || name || '" href="files/001-' || name || '">' || name || '</a> — ' || {SIZE_SQL.format("(turn * 7001 + 5)")} || ' bytes</li>' ELSE {NO_COPY_SQL} END""")} FROM {SHOWN_SQL} s GROUP BY conv_id""",
)
def render_html(spark, sf_dir):
    return R.render_html(shown(spark, sf_dir), conversations(spark, sf_dir))


COPY_SQL = "'body ' || conv_id || '/' || name || repeat('.', CAST(conv_id % 40 AS int))"


@query(
    "render_html_single",
    f"""{page_sql(f"""CASE WHEN total <= {BUDGET} THEN '<li><a download="' || name || '" href="data:text/plain;base64,' || base64(encode(copy)) || '">' || name || '</a> — ' || {SIZE_SQL.format("(turn * 7001 + 5)")} || ' bytes</li>' ELSE {NO_COPY_SQL} END""")}
    FROM (SELECT *, CASE WHEN turn % 4 = 0 THEN sum(CASE WHEN turn % 4 = 0 THEN octet_length(encode(copy)) ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) END AS total FROM (SELECT *, {COPY_SQL} AS copy FROM {SHOWN_SQL} s) c) t GROUP BY conv_id""",
)
def render_html_single(spark, sf_dir):
    """Pages with the bytes of their files inside, as far as each page's budget goes."""
    rows = shown(spark, sf_dir)
    files = rows.filter((F.col("ordinal") - 1) % 4 == 0).select("conv_id", F.explode("files").alias("f")).select("conv_id", "f.*").dropDuplicates(["conv_id", "local_path"])
    copy = F.encode(F.concat(F.lit("body "), "conv_id", F.lit("/"), "name", F.repeat(F.lit("."), (F.col("conv_id") % 40).cast("int"))), "UTF-8")
    resources = files.select("conv_id", "local_path", F.lit("text/plain").alias("mime"), copy.alias("bytes")).withColumn("size", F.octet_length("bytes"))
    return R.render_html(R.inlined(rows, resources, BUDGET), conversations(spark, sf_dir), single=True)


def coded(spark, sf_dir) -> DataFrame:
    rows = given(spark, sf_dir, "conversations")
    runs = F.when(F.col("turn") % 2 == 1, F.array(F.struct(F.lit("Python").alias("tool"), F.concat(F.lit("print("), "turn", F.lit(")")).alias("command"), F.lit("python").alias("command_language"), F.col("role").alias("output"), F.lit("output_visible").alias("status"))))
    block = lambda kind, language, text: F.struct(F.lit(kind).alias("kind"), F.lit(language).cast("string").alias("language"), text.alias("text"))
    blocks = F.array(block("code", "sql", F.concat(F.lit("select "), "turn")), block("inline_code", None, F.lit("x")), block("shell_code", None, F.lit("ls")))
    return rows.select("conv_id", (F.col("turn") + 1).alias("ordinal"), runs.alias("tool_executions"), blocks.alias("code_blocks"))


FENCE = "repeat('`', 3)"


@query(
    "render_commands",
    f"""SELECT conv_id, '# Comandos y código — Conversation ' || conv_id || chr(10) || chr(10) || '{R.COMMANDS_PREFACE}' || chr(10) || chr(10) || '{R.RUNS_HEADING}' || chr(10) || chr(10) || coalesce((SELECT string_agg('### ' || n || '. Turno ' || (turn + 1) || ' · Python' || chr(10) || chr(10) || 'Estado de captura: output_visible' || chr(10) || chr(10) || '#### Comando / entrada' || chr(10) || chr(10) ||
    {FENCE} || 'python' || chr(10) || 'print(' || turn || ')' || chr(10) || {FENCE} || chr(10) || chr(10) || '#### Salida visible' || chr(10) || chr(10) || {FENCE} || chr(10) || role || chr(10) || {FENCE} || chr(10), chr(10) ORDER BY turn)
    FROM (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations WHERE turn % 2 = 1) r WHERE r.conv_id = c.conv_id), 'No se identificaron paneles de ejecución.' || chr(10)) || chr(10) || '{R.CODE_HEADING}' || chr(10) || chr(10) ||
    string_agg('### ' || (2 * i - 1) || '. Turno ' || (turn + 1) || ' · sql' || chr(10) || chr(10) || {FENCE} || 'sql' || chr(10) || 'select ' || turn || chr(10) || {FENCE} || chr(10) || chr(10) || '### ' || (2 * i) || '. Turno ' || (turn + 1) || ' · texto' || chr(10) || chr(10) || {FENCE} || chr(10) || 'ls' || chr(10) || {FENCE} || chr(10), chr(10) ORDER BY turn) AS document
    FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations) c GROUP BY conv_id""",
)
def render_commands(spark, sf_dir):
    return R.render_commands(coded(spark, sf_dir), conversations(spark, sf_dir))


@query(
    "render_report",
    f"""SELECT s.conv_id, array_to_string(['{R.BANNER}', repeat('=', {len(R.BANNER)}), '', 'Título: Conversation ' || s.conv_id, 'Plataforma: ChatGPT', 'URL: https://chatgpt.com/c/' || s.conv_id, 'Exportado: 2026-01-01T00:00:00.000Z', '',
    'Turnos: ' || s.n || ' (' || s.u || ' usuario, ' || s.a || ' asistente, ' || s.x || ' sin clasificar)', 'Bloques de código: ' || s.c, 'Ejecuciones/CLI detectadas: ' || s.e, 'Actividades/herramientas: ' || s.act, 'Desplegables: ' || s.ex, 'Medios detectados: ' || s.m,
    'Archivos/adjuntos visibles detectados: ' || s.n, 'Archivos con URL resoluble: ' || s.r, 'Tarjetas de archivo sin href detectadas: ' || s.t, 'Enlaces: ' || s.l, 'Eventos capturados en vivo: ' || s.ev, 'Recursos archivados: ' || s.ar, 'Capturas visuales de respaldo: ' || s.vs, 'Bytes archivados: ' || coalesce(b.bytes, 0),
    'Enriquecimiento ChatGPT: ' || CASE WHEN s.conv_id % 3 = 0 THEN 'no aplicable' ELSE 'complete' END, '{R.UNCERTIFIED}', 'Índices de turno omitidos dentro del tramo observado: ' || CASE WHEN len({MISSING_SQL}) > 0 THEN array_to_string({MISSING_SQL}, ', ') ELSE '{R.NO_GAPS}' END, '{R.NOT_INFERRED}',
    'Archivos sin copia local: ' || s.un, 'Referencias de archivo encontradas en capa fuente: ' || CASE WHEN s.conv_id % 3 = 0 THEN 0 ELSE s.n END, 'Referencias visibles emparejadas: ' || CASE WHEN s.conv_id % 3 = 0 THEN 0 ELSE s.ev END, 'URLs de descarga resueltas: ' || CASE WHEN s.conv_id % 3 = 0 THEN 0 ELSE s.rd END, '',
    'ADVERTENCIAS', '------------', CASE WHEN s.conv_id % 3 = 0 THEN '- first' || chr(10) || '- second' ELSE 'Ninguna.' END, ''], chr(10)) AS report
    FROM (SELECT conv_id, count(*) AS n, count(*) FILTER (role = 'user') AS u, count(*) FILTER (role = 'assistant') AS a, count(*) FILTER (role = 'system') AS x, CAST(sum(turn % 3) AS bigint) AS c, CAST(sum(turn % 2) AS bigint) AS e, CAST(sum(turn % 5) AS bigint) AS act, CAST(sum(turn % 4) AS bigint) AS ex,
    CAST(sum(turn % 6) AS bigint) AS m, count(*) FILTER (turn % 4 <> 1) AS r, count(*) FILTER (turn % 4 = 1) AS t, CAST(sum(turn % 7) AS bigint) AS l, count(*) FILTER (turn % 2 = 0) AS ev, count(*) FILTER (turn % 8 = 0) + 1 AS ar, CAST(sum((turn * 3 + conv_id) % 15 + 1) AS bigint) AS vs,
    count(*) FILTER (turn % 4 <> 0) AS un, count(*) FILTER (turn % 4 = 0) AS rd FROM conversations GROUP BY conv_id) s JOIN {HINTS_SQL} h ON h.conv_id = s.conv_id
    LEFT JOIN (SELECT conv_id, CAST(sum(octet_length(encode(body))) AS bigint) AS bytes FROM {{blobs}} x GROUP BY conv_id) b ON b.conv_id = s.conv_id""",
)
def render_report(spark, sf_dir):
    from .merging import summarize_turns

    turns = populated(spark, sf_dir)
    stored = given(spark, sf_dir, "blobs").groupBy("conv_id").agg(F.sum(F.octet_length("body")).alias("total_bytes"))
    layer = given(spark, sf_dir, "files").filter("conv_id % 3 <> 0").groupBy("conv_id").agg(F.lit("complete").alias("source_status"), F.count("*").alias("references_found"), F.count_if(F.col("turn") % 2 == 0).alias("visible_references_matched"), F.count_if(F.col("turn") % 4 == 0).alias("download_urls_resolved"))
    return R.render_report(summarize_turns(spark, sf_dir), M.turn_continuity(hinted(spark, sf_dir)), conversations(spark, sf_dir), M.completeness(turns), stored, layer)


@query(
    "render_raw_turn",
    f"""SELECT conv_id, printf('raw/turn-%04d-%s.html', turn + 1, role) AS path, '<!doctype html><meta charset="utf-8"><meta http-equiv="Content-Security-Policy" content="{R.RAW_POLICY.replace("'", "''")}"><title>Turno ' || (turn + 1) || '</title><p>' || {HTML_SQL.format("text")} || '</p><img src="../assets/1.png">' AS data FROM conversations WHERE turn % 3 <> 2""",
)
def render_raw_turn(spark, sf_dir):
    from ..functions.text import escape_html

    rows = given(spark, sf_dir, "conversations")
    raw = F.when(F.col("turn") % 3 != 2, F.concat(F.lit("<p>"), escape_html(F.col("text")), F.lit('</p><img src="assets/1.png">')))
    return R.render_raw_turn(rows.select("conv_id", (F.col("turn") + 1).alias("ordinal"), "role", raw.alias("raw_html")))


@query(
    "rewrite_markdown_urls",
    "SELECT conv_id, turn, '[a](files/1.txt) ' || text || ' ![b](assets/2.png) https://c.example/3' AS value FROM conversations",
)
def rewrite_markdown_urls(spark, sf_dir):
    rows = given(spark, sf_dir, "conversations")
    body = F.concat(F.lit("[a](https://a.example/1?x=1) "), "text", F.lit(" ![b](https://b.example/2) https://c.example/3"))
    pairs = F.array(*[F.struct(F.lit(u).alias("url"), F.lit(p).alias("path")) for u, p in (("https://a.example/1?x=1", "files/1.txt"), ("https://b.example/2", "assets/2.png"))])
    return rows.select("conv_id", "turn", R.rewrite_markdown_urls(body, pairs).alias("value"))


DOCUMENT_SQL = """SELECT c.conv_id, '{"schema":"conversation-export","schemaVersion":"1.3","conversation_id":' || c.conv_id || ',"summary":{"user_turns":' || count(*) FILTER (role = 'user') || '},"turns":[' ||
    string_agg('{"ordinal":' || (turn + 1) || ',"role":"' || role || '","text":' || to_json(text) || '}', ',' ORDER BY turn) || ']}' AS document FROM conversations c GROUP BY c.conv_id"""


def documents(spark, sf_dir) -> DataFrame:
    rows = given(spark, sf_dir, "conversations")
    summary = rows.groupBy("conv_id").agg(F.count_if(F.col("role") == "user").alias("user_turns"))
    return R.conversation_document(rows.select("conv_id", (F.col("turn") + 1).alias("ordinal"), "role", "text"), {"summary": summary})


query("conversation_document", DOCUMENT_SQL)(documents)


@query(
    "write_conversation_json",
    """SELECT conv_id, turn + 1 AS ordinal, role, CASE WHEN turn % 4 = 1 THEN NULL WHEN turn % 4 = 0 THEN 'https://files.example.org/' || conv_id || '/' || turn || '.txt?sig=REDACTED' ELSE href END AS href FROM {files} f""",
)
def write_conversation_json(spark, sf_dir):
    """Published turns carry redacted addresses only: written as a JSON document, and read back."""
    from ..functions.urls import redact_url
    from ..sources import read_conversation_documents

    rows = given(spark, sf_dir, "files").select("conv_id", (F.col("turn") + 1).alias("ordinal"), "role", F.when(F.col("href").isNotNull(), redact_url(F.col("href"))).alias("href"))
    back = read_conversation_documents(R.conversation_document(rows, {}), "document", "conversation_id long, turns array<struct<ordinal: long, role: string, href: string>>")
    return back.select(F.col("conversation_id").alias("conv_id"), F.explode("turns").alias("t")).select("conv_id", "t.*")


def entries(spark, sf_dir) -> DataFrame:
    return given(spark, sf_dir, "entries").withColumn("data", F.encode("data", "UTF-8"))


@query("manifest", "SELECT conv_id, path, CAST(octet_length(encode(data)) AS bigint) AS bytes, sha256(data) AS sha256 FROM {entries} e")
def manifest(spark, sf_dir):
    return Bu.manifest(entries(spark, sf_dir))


@query(
    "bundle_entries",
    f"""SELECT conv_id, path, CAST(octet_length(encode(data)) AS bigint) AS bytes, sha256(data) AS sha256 FROM (SELECT conv_id, path, data FROM {{entries}} e
    UNION ALL SELECT conv_id, 'conversation.json', document FROM ({DOCUMENT_SQL}) d UNION ALL SELECT conv_id, 'turn-coverage.txt', array_to_string({MISSING_SQL}, ',') FROM {HINTS_SQL} h) u""",
)
def bundle_entries(spark, sf_dir):
    document = documents(spark, sf_dir).select("conv_id", F.lit("conversation.json").alias("path"), F.encode("document", "UTF-8").alias("data"))
    coverage = M.turn_continuity(hinted(spark, sf_dir)).select("conv_id", F.lit("turn-coverage.txt").alias("path"), F.encode(F.array_join(F.col("missing").cast("array<string>"), ","), "UTF-8").alias("data"))
    return Bu.manifest(Bu.bundle_entries([entries(spark, sf_dir), document, coverage]))


FULL_SQL = f"""SELECT c.conv_id, '{{"schema":"conversation-export","schemaVersion":"1.3","conversation_id":' || c.conv_id || ',"exporter":{{"name":"turnloom","version":"1"}},"metadata":{{"platformLabel":"ChatGPT","title":"Conversation ' || c.conv_id || '","sourceUrl":"https://chatgpt.com/c/' || c.conv_id ||
    '","exportedAt":"2026-01-01T00:00:00.000Z","options":' || CASE WHEN c.conv_id % 2 = 0 THEN '{{"eventLog":true,"limit":' || c.conv_id || '}}' ELSE '["raw",null]' END || '}},"summary":{{"user_turns":' || count(*) FILTER (c.role = 'user') || ',"turns":' || count(*) || '}},"completeness":{{"certifiedComplete":false,"unresolvedFiles":' ||
    count(*) FILTER (c.turn % 4 <> 0) || '}},"turnCoverage":{{"missing":[' || coalesce(max(h.missing), '') || ']}},"archivedResources":[' || coalesce(string_agg('{{"localPath":"files/' || c.turn || '.txt","size":' || octet_length(encode(c.text)) || ',"sha256":"' || sha256(c.text) || '"}}', ',' ORDER BY c.turn) FILTER (c.turn % 4 = 0), '') ||
    '],"sessionEvents":[' || coalesce(string_agg('{{"turnId":"t' || c.turn || '","signature":"' || c.role || '"}}', ',' ORDER BY c.turn DESC) FILTER (c.turn % 3 = 1), '') || '],"diagnostics":[{{"detectedTurns":' || count(*) || ',"kind":"export-start"}},{{"kind":"turn-continuity","missing":' || coalesce(max(h.n), 0) || '}}],"warnings":[' ||
    CASE WHEN c.conv_id % 3 = 0 THEN '"first","second"' ELSE '' END || '],"turns":[' || string_agg('{{"ordinal":' || (c.turn + 1) || ',"role":"' || c.role || '","text":' || to_json(c.text) || ',"markdown":' || to_json('**md** ' || c.text) || '}}', ',' ORDER BY c.turn) || ']}}' AS document
    FROM conversations c LEFT JOIN (SELECT conv_id, array_to_string({MISSING_SQL}, ',') AS missing, len({MISSING_SQL}) AS n FROM {HINTS_SQL} h) h ON h.conv_id = c.conv_id GROUP BY c.conv_id"""


@query("conversation_document_full", FULL_SQL)
def conversation_document_full(spark, sf_dir):
    """All sections of an exported document; the options, which differ by producer, as a VARIANT."""
    rows = given(spark, sf_dir, "conversations")
    ids = conversations(spark, sf_dir)
    per = rows.groupBy("conv_id").agg(F.count_if(F.col("role") == "user").alias("user_turns"), F.count("*").alias("turns"), F.count_if(F.col("turn") % 4 != 0).alias("unresolvedFiles"))
    options = F.parse_json(F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit('{"limit": '), "conv_id", F.lit(', "eventLog": true}'))).otherwise('["raw", null]'))
    gaps = M.turn_continuity(hinted(spark, sf_dir)).select("conv_id", "missing")
    frames = {
        "exporter": ids.select("conv_id", F.lit("turnloom").alias("name"), F.lit("1").alias("version")),
        "metadata": ids.select("conv_id", F.col("platform_label").alias("platformLabel"), "title", F.col("source_url").alias("sourceUrl"), F.col("exported_at").alias("exportedAt"), options.alias("options")),
        "summary": per.select("conv_id", "user_turns", "turns"), "completeness": per.select("conv_id", F.lit(False).alias("certifiedComplete"), "unresolvedFiles"),
        "turnCoverage": ids.select("conv_id").join(gaps, "conv_id", "left").select("conv_id", F.coalesce("missing", F.array().cast(gaps.schema["missing"].dataType)).alias("missing")),
    }
    text = F.encode("text", "UTF-8")
    start = per.select("conv_id", F.lit(0).alias("at"), F.to_json(F.struct(F.lit("export-start").alias("kind"), F.col("turns").alias("detectedTurns"))).alias("r"))
    continuity = frames["turnCoverage"].select("conv_id", F.lit(1).alias("at"), F.to_json(F.struct(F.lit("turn-continuity").alias("kind"), F.size("missing").alias("missing"))).alias("r"))
    lists = {
        "archivedResources": rows.filter("turn % 4 = 0").select("conv_id", F.col("turn").alias("at"), F.concat(F.lit("files/"), "turn", F.lit(".txt")).alias("localPath"), F.octet_length(text).alias("size"), F.sha2(text, 256).alias("sha256")),
        "sessionEvents": rows.filter("turn % 3 = 1").select("conv_id", (-F.col("turn")).alias("at"), F.concat(F.lit("t"), "turn").alias("turnId"), F.col("role").alias("signature")),
        "diagnostics": start.unionByName(continuity).select("conv_id", "at", F.col("r").alias("json")),
        "warnings": ids.select("conv_id", F.posexplode("warnings").alias("at", "value")),
    }
    turns = rows.select("conv_id", (F.col("turn") + 1).alias("ordinal"), "role", "text", F.concat(F.lit("**md** "), "text").alias("markdown"))
    return R.conversation_document(turns, frames, lists=lists)


FORMATS = ("zip", "json", "html", "markdown")


@query(
    "export_format",
    "SELECT conv_id, 'zip' AS format, path, CAST(octet_length(encode(data)) AS bigint) AS size, sha256(data) AS sha256 FROM {entries} e UNION ALL SELECT conv_id, 'json', 'conversation.json', octet_length(encode(document)), sha256(document) FROM (" + DOCUMENT_SQL + ") d UNION ALL SELECT conv_id, 'html', 'conversation.html', octet_length(encode(html)), sha256(html) FROM ("
    + ORACLE["render_html"] + ") h UNION ALL SELECT conv_id, 'markdown', 'conversation.md', octet_length(encode(markdown)), sha256(markdown) FROM (" + ORACLE["render_markdown"] + ") m",
)
def export_format(spark, sf_dir):
    """Four formats, each written as bundles and read back."""
    from ..sources.bundles import register

    register(spark)
    every, markdown, html = given(spark, sf_dir, "entries"), render_markdown(spark, sf_dir), render_html(spark, sf_dir)
    out = None
    for f in FORMATS:
        rows = R.export(f, markdown, html, documents(spark, sf_dir), every).select("conv_id", F.col("path").alias("name"), F.encode("data", "UTF-8").alias("bytes"))
        rows.write.format("turnloom_bundles").mode("append").save(to := new_path(spark, f"export-{f}"))
        back = spark.read.format("turnloom_bundles").load(to).select("conv_id", F.lit(f).alias("format"), F.col("name").alias("path"), F.octet_length("bytes").cast("long").alias("size"), F.sha2("bytes", 256).alias("sha256"))
        out = back if out is None else out.unionByName(back)
    return out


def broken(spark, sf_dir) -> DataFrame:
    """Entries of which every 7th has other bytes of the same length, and every 11th is there twice."""
    rows = given(spark, sf_dir, "conversations").join(entries(spark, sf_dir).withColumn("turn", F.substring("path", 7, 4).cast("long")), ["conv_id", "turn"])
    k = F.col("conv_id") * 10 + F.col("turn")
    changed = rows.select("conv_id", "path", F.when(k % 7 == 0, F.encode(F.translate("text", "abcdeo", "bcdefa"), "UTF-8")).otherwise(F.col("data")).alias("data"), k.alias("k"))
    return changed.unionByName(changed.filter("k % 11 = 0")).drop("k")


@query(
    "bundle_check",
    """SELECT conv_id, count(*) AS entries, count(*) - count(DISTINCT turn) AS repeated, CAST(0 AS bigint) AS bad_paths, CAST(max(n) AS bigint) AS largest, CAST(sum(n) AS bigint) AS total_bytes, count(*) = count(DISTINCT turn) AS ok FROM (SELECT conv_id, turn, octet_length(encode(text)) AS n FROM conversations
    UNION ALL SELECT conv_id, turn, octet_length(encode(text)) FROM conversations WHERE (conv_id * 10 + turn) % 11 = 0) t GROUP BY conv_id""",
)
def bundle_check(spark, sf_dir):
    return Bu.bundle_check(broken(spark, sf_dir))


@query(
    "verify_bundle",
    """SELECT conv_id, concat('turns/', lpad(CAST(turn AS string), 4, '0'), '.md') AS path, CASE WHEN (conv_id * 10 + turn) % 11 = 0 THEN 'repeated_entry' WHEN turn = 5 THEN 'not_covered' WHEN (conv_id * 10 + turn) % 7 = 0 AND translate(text, 'abcdeo', 'bcdefa') <> text THEN 'wrong_hash' ELSE 'ok' END AS status FROM conversations
    UNION ALL SELECT DISTINCT conv_id, 'lost.md', 'missing_entry' FROM conversations""",
)
def verify_bundle(spark, sf_dir):
    described = Bu.manifest(entries(spark, sf_dir)).filter("path <> 'turns/0005.md'")
    lost = described.groupBy("conv_id").agg(F.lit("lost.md").alias("path"), F.lit(1).cast("long").alias("bytes"), F.lit("00").alias("sha256"))
    return Bu.verify_bundle(broken(spark, sf_dir), described.unionByName(lost))


def requests(spark, sf_dir) -> DataFrame:
    rows = given(spark, sf_dir, "files")
    files = rows.select("conv_id", F.col("turn").alias("ordinal"), F.lit(0).alias("pos"), F.col("href").alias("url"), "name", F.lit(None).cast("long").alias("expected"))
    media = rows.filter("turn % 3 = 0").select(
        "conv_id", F.col("turn").alias("ordinal"), F.lit(0).alias("pos"), F.concat(F.lit("https://img.example.org/"), F.col("turn") % 2, F.lit(".png")).alias("url"), F.lit("image").alias("kind"), F.lit(None).cast("string").alias("name"), (F.col("turn") % 6 == 3).alias("decorative")
    )
    return A.resource_requests(media, files)


FIRSTS_SQL = """(SELECT *, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY phase, turn) AS int) AS seq FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, url ORDER BY phase, turn) AS r FROM (
    SELECT conv_id, 0 AS phase, turn, 'https://img.example.org/' || (turn % 2) || '.png' AS url, 'image' AS kind, NULL AS name FROM conversations WHERE turn % 3 = 0 AND turn % 6 <> 3 UNION ALL SELECT conv_id, 1, turn, href, 'file', name FROM {files} f WHERE href IS NOT NULL) e) q WHERE r = 1)"""


@query("resource_requests", f"SELECT conv_id, seq, url, kind, name, CAST(NULL AS bigint) AS expected FROM {FIRSTS_SQL} x")
def resource_requests(spark, sf_dir):
    return requests(spark, sf_dir)


def facts(spark, sf_dir) -> DataFrame:
    return A.blob_facts(given(spark, sf_dir, "blobs").withColumn("bytes", F.encode("body", "UTF-8")))


def validated(spark, sf_dir) -> DataFrame:
    return A.with_validation(requests(spark, sf_dir), facts(spark, sf_dir))


VALID_SQL = f"""(SELECT x.*, b.mime, CAST(octet_length(encode(b.body)) AS bigint) AS size, sha256(b.body) AS sha256, CASE WHEN b.url IS NULL THEN 'no such resource' WHEN regexp_matches(x.name, '[.]pdf$') AND NOT starts_with(b.body, '%PDF-') THEN 'no PDF head' END AS error FROM {FIRSTS_SQL} x LEFT JOIN {{blobs}} b ON b.url = x.url)"""


@query("validate_resource", f"SELECT conv_id, seq, size, error FROM {VALID_SQL} v")
def validate_resource(spark, sf_dir):
    return validated(spark, sf_dir).select("conv_id", "seq", "size", "error")


CAP = 600
BUDGET_SQL = f"""WITH RECURSIVE v AS (SELECT * FROM {VALID_SQL} w), f AS (SELECT conv_id, CAST(0 AS int) AS seq, CAST('' AS varchar) AS status, CAST(0 AS bigint) AS total FROM (SELECT DISTINCT conv_id FROM v) d
    UNION ALL SELECT v.conv_id, v.seq, CASE WHEN f.total >= {CAP} THEN 'budget_exceeded' WHEN v.size IS NULL OR v.error IS NOT NULL OR f.total + v.size > {CAP} THEN 'failed' ELSE 'archived' END,
    CASE WHEN f.total >= {CAP} OR v.size IS NULL OR v.error IS NOT NULL OR f.total + v.size > {CAP} THEN f.total ELSE f.total + v.size END FROM f JOIN v ON v.conv_id = f.conv_id AND v.seq = f.seq + 1)"""


@query("archive_budget", BUDGET_SQL + " SELECT conv_id, seq, status FROM f WHERE seq > 0")
def archive_budget(spark, sf_dir):
    return A.archive_budget(validated(spark, sf_dir), CAP).select("conv_id", "seq", "status")


def ledger(spark, sf_dir, cap: int = CAP) -> DataFrame:
    return A.resource_ledger(A.archive_budget(validated(spark, sf_dir), cap))


LEDGER_SQL = f"""{BUDGET_SQL} SELECT v.conv_id, v.seq, v.url, replace(v.url, '?sig=1', '?sig=REDACTED') AS url_for_metadata, f.status, CASE WHEN f.status = 'archived' THEN 'files/' || printf('%03d', CAST(sum(CASE WHEN f.status = 'archived' THEN 1 ELSE 0 END) OVER (PARTITION BY v.conv_id ORDER BY v.seq) AS bigint)) || '-' || v.name END AS local_path,
    CASE WHEN f.status = 'archived' THEN v.size END AS size, CASE WHEN f.status = 'archived' THEN v.sha256 END AS sha256, CASE WHEN f.status = 'failed' THEN coalesce(v.error, 'over the limit of resources') END AS error FROM f JOIN v ON v.conv_id = f.conv_id AND v.seq = f.seq"""


@query("resource_ledger", LEDGER_SQL)
def resource_ledger(spark, sf_dir):
    return ledger(spark, sf_dir)


def filed(spark, sf_dir) -> DataFrame:
    return A.file_archive_status(given(spark, sf_dir, "files"), ledger(spark, sf_dir))


@query(
    "file_archive_status",
    f"""WITH l AS ({LEDGER_SQL}) SELECT x.conv_id, x.turn, CASE WHEN l.local_path IS NOT NULL THEN 'archived' WHEN x.href IS NULL THEN 'unresolved' ELSE 'not_archived' END AS archive_status, l.local_path,
    CASE WHEN l.local_path IS NULL THEN 'Archivo sin copia local: ' || x.name || ' (' || CASE WHEN x.href IS NULL THEN 'unresolved' ELSE 'not_archived' END || ').' END AS warning FROM {{files}} x LEFT JOIN l ON l.conv_id = x.conv_id AND l.url = x.href AND l.status = 'archived'""",
)
def file_archive_status(spark, sf_dir):
    return filed(spark, sf_dir).select("conv_id", "turn", "archive_status", "local_path", "warning")


@query(
    "archived_lookup",
    f"""WITH l AS ({LEDGER_SQL}) SELECT x.conv_id, x.turn, l.local_path AS found_path FROM (SELECT conv_id, turn, CASE WHEN turn % 8 = 0 THEN replace(href, 'sig=1', 'sig=REDACTED') ELSE href END AS href FROM {{files}} y) x LEFT JOIN l ON l.conv_id = x.conv_id AND l.status = 'archived' AND (l.url = x.href OR l.url_for_metadata = x.href OR l.local_path = x.href)""",
)
def archived_lookup(spark, sf_dir):
    from ..functions.urls import redact_url

    rows = given(spark, sf_dir, "files").withColumn("href", F.when(F.col("turn") % 8 == 0, redact_url(F.col("href"))).otherwise(F.col("href")))
    return A.archived_lookup(rows, ledger(spark, sf_dir)).select("conv_id", "turn", "found_path")


@query(
    "warnings_log",
    f"""WITH l AS ({LEDGER_SQL}) SELECT conv_id, 'budget' AS stage, CAST(seq AS bigint) AS seq, 'Se alcanzó el límite total de recursos (200 MB).' AS text FROM l WHERE status = 'budget_exceeded'
    UNION ALL SELECT conv_id, 'archive', seq, 'No se pudo archivar ' || url_for_metadata || ' (' || error || ').' FROM l WHERE status = 'failed'
    UNION ALL SELECT x.conv_id, 'files', x.turn, 'Archivo sin copia local: ' || x.name || ' (' || CASE WHEN x.href IS NULL THEN 'unresolved' ELSE 'not_archived' END || ').' FROM {{files}} x LEFT JOIN l ON l.conv_id = x.conv_id AND l.url = x.href AND l.status = 'archived' WHERE l.url IS NULL
    UNION ALL SELECT conv_id, 'coverage', 0, 'Faltan índices de turno: ' || array_to_string({MISSING_SQL}, ', ') FROM {HINTS_SQL} h WHERE len({MISSING_SQL}) > 0""",
)
def warnings_log(spark, sf_dir):
    """Messages of coverage, budget, archive and missing copies, with their stage and order."""
    book = ledger(spark, sf_dir)
    budget = book.filter("status = 'budget_exceeded'").select("conv_id", F.lit("budget").alias("stage"), F.col("seq").cast("long").alias("seq"), A.budget_warning(F.col("status"), 200).alias("text"))
    failed = book.filter("status = 'failed'").select("conv_id", F.lit("archive").alias("stage"), F.col("seq").cast("long").alias("seq"), F.concat(F.lit("No se pudo archivar "), "url_for_metadata", F.lit(" ("), "error", F.lit(").")).alias("text"))
    missing = filed(spark, sf_dir).filter("warning IS NOT NULL").select("conv_id", F.lit("files").alias("stage"), F.col("turn").alias("seq"), F.col("warning").alias("text"))
    gaps = M.turn_continuity(hinted(spark, sf_dir)).filter(F.size("missing") > 0).select("conv_id", F.lit("coverage").alias("stage"), F.lit(0).cast("long").alias("seq"), F.concat(F.lit("Faltan índices de turno: "), F.array_join(F.col("missing").cast("array<string>"), ", ")).alias("text"))
    return budget.unionByName(failed).unionByName(missing).unionByName(gaps)


@query(
    "diagnostics_log",
    f"""SELECT conv_id, list(kind || ':' || n ORDER BY stage) AS records FROM (SELECT conv_id, 0 AS stage, 'export-start' AS kind, count(*) AS n FROM conversations GROUP BY conv_id UNION ALL SELECT conv_id, 1, 'mounted-window-sweep', count(DISTINCT turn) FROM conversations GROUP BY conv_id
    UNION ALL SELECT conv_id, 2, 'turn-continuity', len({MISSING_SQL}) FROM {HINTS_SQL} h) d GROUP BY conv_id""",
)
def diagnostics_log(spark, sf_dir):
    """Typed records of all stages as one ordered list per conversation."""
    rows = given(spark, sf_dir, "conversations").groupBy("conv_id")
    start = rows.agg(F.count("*").alias("n")).select("conv_id", F.lit(0).alias("stage"), F.lit("export-start").alias("kind"), "n")
    sweep = rows.agg(F.count_distinct("turn").alias("n")).select("conv_id", F.lit(1).alias("stage"), F.lit("mounted-window-sweep").alias("kind"), "n")
    gaps = M.turn_continuity(hinted(spark, sf_dir)).select("conv_id", F.lit(2).alias("stage"), F.lit("turn-continuity").alias("kind"), F.size("missing").cast("long").alias("n"))
    every = start.unionByName(sweep).unionByName(gaps).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("stage", F.concat("kind", F.lit(":"), "n").alias("record")))).alias("r"))
    return every.select("conv_id", F.col("r.record").alias("records"))
