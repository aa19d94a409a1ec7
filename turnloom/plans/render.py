"""Documents of conversations: expressions per turn, then one ordered concatenation per conversation.

Input turns: conv_id, ordinal, role, model, text, markdown, files (structs with href, name, local_path),
tool_executions and code_blocks where a document shows them. `conversations`: conv_id, title,
platform_label, exported_at, and warnings (array) where there are any.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.binary import encode_data_url
from ..functions.text import escape_html, fence_code, role_label, text_or_empty

#: The policy that keeps a written page from running or loading anything.
POLICY = "default-src 'none'; img-src 'self' data: blob:; media-src 'self' data: blob:; style-src 'unsafe-inline'; script-src 'none'; object-src 'none'; base-uri 'none'; form-action 'none'"
RAW_POLICY = "default-src 'none'; img-src 'self' data:; media-src 'self' data:; style-src 'unsafe-inline'; script-src 'none'; object-src 'none'; form-action 'none'; base-uri 'none'"
STYLE = "body{margin:0;font-family:sans-serif}.wrap{max-width:70rem;margin:auto;padding:2rem}.turn{border:1px solid #889;border-radius:1rem;margin:1rem 0;padding:1rem}pre{white-space:pre-wrap}"


def joined(turns: DataFrame, part: Column, name: str, separator: str = "\n") -> DataFrame:
    """(conv_id, name): the parts of a conversation's turns in order."""
    got = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", part.alias("part")))).alias("p"))
    return got.select("conv_id", F.array_join("p.part", separator).alias(name))


def file_line(f: Column) -> Column:
    """A link to the local copy, else to the address, else the name alone; what has no copy says so."""
    label = F.coalesce(F.nullif(f["name"], F.lit("")), F.lit("archivo"))
    local = F.replace(F.replace(F.replace(f["local_path"], F.lit(" "), F.lit("%20")), F.lit("("), F.lit("%28")), F.lit(")"), F.lit("%29"))
    return (
        F.when(f["local_path"].isNotNull(), F.concat(F.lit("["), label, F.lit("]("), local, F.lit(")")))
        .when(f["href"].isNotNull() & (f["href"] != ""), F.concat(F.lit("["), label, F.lit("]("), f["href"], F.lit(") — sin copia local")))
        .otherwise(F.concat(label, F.lit(" — referencia sin copia local")))
    )


def turn_markdown() -> Column:
    files = F.when(F.size("files") > 0, F.concat(F.lit("### Archivos\n\n"), F.array_join(F.transform("files", file_line), "\n"), F.lit("\n"))).otherwise("")
    body = F.coalesce(F.nullif(F.col("markdown"), F.lit("")), text_or_empty(F.col("text")))
    return F.concat(F.lit("## "), F.col("ordinal"), F.lit(". "), role_label(F.col("role")), F.lit("\n\n"), body, F.lit("\n\n"), files, F.lit("\n---\n"))


def render_markdown(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """(conv_id, markdown): title, platform, number of turns, the turns, then warnings."""
    count = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    rows = joined(turns, turn_markdown(), "body").join(count, "conv_id").join(conversations, "conv_id")
    warnings = F.when(F.size("warnings") > 0, F.concat(F.lit("\n## Advertencias\n\n"), F.array_join(F.transform("warnings", lambda w: F.concat(F.lit("- "), w)), "\n"), F.lit("\n"))).otherwise("")
    head = F.concat(F.lit("# "), "title", F.lit("\n\nPlataforma: "), "platform_label", F.lit("\nCaptura: "), "exported_at", F.lit("\nTurnos conservados: "), "n", F.lit(". La cobertura completa no está certificada.\n\n"))
    return rows.select("conv_id", F.concat(head, "body", warnings).alias("markdown"))


def shown_size(n: Column) -> Column:
    """A number of bytes as Spanish writes it: groups of three from five digits on."""
    return F.when(n < 10_000, n.cast("string")).otherwise(F.replace(F.format_number(n, 0), F.lit(","), F.lit(".")))


def turn_html(single: bool = False) -> Column:
    """A turn's section. Files with a copy link to it (`local_path`, or `data_url` in a single page) and tell its `size`."""
    o, role = F.col("ordinal").cast("string"), F.col("role")
    file = lambda f: F.when(
        (f["data_url"] if single else f["local_path"]).isNotNull(),
        F.concat(F.lit('<li><a download="'), escape_html(f["name"]), F.lit('" href="'), escape_html(f["data_url"] if single else f["local_path"]), F.lit('">'), escape_html(f["name"]), F.lit("</a> — "), shown_size(f["size"]), F.lit(" bytes</li>")),
    ).otherwise(F.concat(F.lit("<li>"), escape_html(f["name"]), F.lit(" — <strong>sin copia local</strong></li>")))
    files = F.when(F.size("files") > 0, F.concat(F.lit("<ul>"), F.array_join(F.transform("files", file), ""), F.lit("</ul>"))).otherwise("")
    return F.concat(
        F.lit('<section class="turn '), escape_html(role), F.lit('" id="turn-'), o, F.lit('"><h2>'), o, F.lit(". "), escape_html(role_label(role)), F.lit("</h2><pre>"), escape_html(F.col("text")), F.lit("</pre>"), files, F.lit("</section>")
    )


def inlined(turns: DataFrame, resources: DataFrame, budget: int) -> DataFrame:
    """Turns whose files bear `data_url`, the bytes of their copy, as far as the page's budget of bytes goes.

    `resources`: conv_id, local_path, mime, size, bytes. What fits is settled on sizes alone, each copy once, in reading order; a copy
    that does not fit leaves room for smaller ones after it only if they fit as the sum stands. Only bytes that fit move.
    """
    files = turns.select("conv_id", "ordinal", F.posexplode("files").alias("pos", "f")).select("conv_id", "ordinal", "pos", "f.*")
    wanted = files.filter("local_path IS NOT NULL").groupBy("conv_id", "local_path").agg(F.min(F.struct("ordinal", "pos")).alias("at"))
    sized = wanted.join(resources.select("conv_id", "local_path", F.col("size").alias("_n")), ["conv_id", "local_path"])
    total = F.sum("_n").over(Window.partitionBy("conv_id").orderBy("at", "local_path").rowsBetween(Window.unboundedPreceding, 0))
    fits = sized.withColumn("_sum", total).filter(F.col("_sum") <= budget).select("conv_id", "local_path")
    urls = resources.join(fits, ["conv_id", "local_path"], "left_semi").select("conv_id", "local_path", encode_data_url(F.col("bytes"), F.col("mime")).alias("data_url"))
    got = files.join(urls, ["conv_id", "local_path"], "left").groupBy("conv_id", "ordinal").agg(F.array_sort(F.collect_list(F.struct("pos", F.struct("href", "name", "local_path", "size", "data_url").alias("f")))).alias("l"))
    return turns.drop("files").join(got.select("conv_id", "ordinal", F.col("l.f").alias("files")), ["conv_id", "ordinal"], "left").withColumn("files", F.coalesce("files", F.array()))


def render_html(turns: DataFrame, conversations: DataFrame, single: bool = False) -> DataFrame:
    """(conv_id, html): one escaped page without scripts, under a policy that allows none; `single`: with its files inside (see `inlined`)."""
    rows = joined(turns, turn_html(single), "body").join(conversations, "conv_id")
    title = escape_html(F.col("title"))
    head = F.concat(F.lit(f'<!doctype html><html lang="es"><head><meta charset="utf-8"><meta http-equiv="Content-Security-Policy" content="{POLICY}"><title>'), title, F.lit(f"</title><style>{STYLE}</style></head><body><main class=\"wrap\"><h1>"), title, F.lit("</h1>"))
    return rows.select("conv_id", F.concat(head, "body", F.lit("</main></body></html>")).alias("html"))


#: What precedes commands, and the headings.
COMMANDS_PREFACE = "Los paneles de herramientas se identifican por su estructura DOM. La salida combinada no permite distinguir stdout de stderr ni confirmar un código de salida."
RUNS_HEADING, CODE_HEADING = "## Paneles de ejecución identificados", "## Otros bloques de código (incluye ejemplos; no implica ejecución)"


def render_commands(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """(conv_id, document): tool runs numbered across turns, then other code; inline code and the runs' own blocks are left out."""
    every = F.array_sort(F.collect_list(F.struct("ordinal", "tool_executions", "code_blocks")))
    got = turns.groupBy("conv_id").agg(every.alias("t"))
    runs = F.flatten(F.transform("t", lambda t: F.transform(F.coalesce(t["tool_executions"], F.array()), lambda e: F.struct(t["ordinal"].alias("o"), e.alias("e")))))
    shown = lambda b: ~b["kind"].isin("inline_code", "tool_command", "tool_output")
    blocks = F.flatten(F.transform("t", lambda t: F.transform(F.filter(F.coalesce(t["code_blocks"], F.array()), shown), lambda b: F.struct(t["ordinal"].alias("o"), b.alias("b")))))

    def run(x: Column, i: Column) -> Column:
        e = x["e"]
        return F.concat(F.lit("### "), i + 1, F.lit(". Turno "), x["o"], F.lit(" · "), e["tool"], F.lit("\n\nEstado de captura: "), e["status"], F.lit("\n\n#### Comando / entrada\n\n"), fence_code(e["command"], e["command_language"]), F.lit("\n\n#### Salida visible\n\n"), fence_code(e["output"], F.lit("text")), F.lit("\n"))

    def block(x: Column, i: Column) -> Column:
        b = x["b"]
        return F.concat(F.lit("### "), i + 1, F.lit(". Turno "), x["o"], F.lit(" · "), F.coalesce(F.nullif(b["language"], F.lit("")), F.lit("texto")), F.lit("\n\n"), fence_code(b["text"], b["language"]), F.lit("\n"))

    made = got.select("conv_id", F.array_join(F.transform(runs, run), "\n").alias("r"), F.array_join(F.transform(blocks, block), "\n").alias("b")).join(conversations.select("conv_id", "title"), "conv_id")
    head = F.concat(F.lit("# Comandos y código — "), "title", F.lit(f"\n\n{COMMANDS_PREFACE}\n\n{RUNS_HEADING}\n\n"))
    shown_runs = F.when(F.col("r") == "", "No se identificaron paneles de ejecución.\n").otherwise(F.col("r"))
    return made.select("conv_id", F.concat(head, shown_runs, F.lit(f"\n{CODE_HEADING}\n"), F.when(F.col("b") == "", "").otherwise(F.concat(F.lit("\n"), "b"))).alias("document"))


#: Labels of the report, and the columns that they show, in order.
REPORT = (
    ("Bloques de código", "code_blocks"), ("Ejecuciones/CLI detectadas", "terminal_executions"), ("Actividades/herramientas", "activities"), ("Desplegables", "expandables"), ("Medios detectados", "media"),
    ("Archivos/adjuntos visibles detectados", "linked_files"), ("Archivos con URL resoluble", "resolved_files"), ("Tarjetas de archivo sin href detectadas", "ui_attachments"), ("Enlaces", "links"),
    ("Eventos capturados en vivo", "live_events"), ("Recursos archivados", "archived_resources"), ("Capturas visuales de respaldo", "visual_snapshots"), ("Bytes archivados", "total_bytes"), ("Enriquecimiento ChatGPT", "source_status"),
)
REFERENCES = (("Referencias de archivo encontradas en capa fuente", "references_found"), ("Referencias visibles emparejadas", "visible_references_matched"), ("URLs de descarga resueltas", "download_urls_resolved"))
UNCERTIFIED = "Cobertura completa de la conversación: no certificada"
NO_GAPS = "ninguno detectado; no certifica extremos ni paneles"
NOT_INFERRED = "stdout/stderr/códigos de salida: no se infieren del texto de salida"
BANNER = "INFORME DE EXPORTACIÓN"


def render_report(summary: DataFrame, continuity: DataFrame, conversations: DataFrame, completeness: DataFrame, archive: DataFrame, source_layer: DataFrame) -> DataFrame:
    """(conv_id, report): what was captured, how much of it, what is missing, and the warnings.

    `archive`: conv_id, total_bytes; `source_layer`: conv_id, source_status and the counts of REFERENCES.
    A conversation without a row there has 0 bytes and references, and no status.
    """
    rows = summary.join(continuity.select("conv_id", "missing"), "conv_id").join(conversations, "conv_id").join(completeness.select("conv_id", "unresolved_files"), "conv_id")
    rows = rows.join(archive.select("conv_id", "total_bytes"), "conv_id", "left").join(source_layer.select("conv_id", "source_status", *[c for _, c in REFERENCES]), "conv_id", "left")
    shown = {"source_status": F.coalesce("source_status", F.lit("no aplicable"))}
    line = lambda label, c: F.concat(F.lit(f"{label}: "), shown.get(c, F.coalesce(F.col(c).cast("string"), F.lit("0"))))
    missing = F.when(F.size("missing") > 0, F.array_join(F.col("missing").cast("array<string>"), ", ")).otherwise(NO_GAPS)
    warnings = F.when(F.size("warnings") > 0, F.array_join(F.transform("warnings", lambda w: F.concat(F.lit("- "), w)), "\n")).otherwise("Ninguna.")
    head = [line("Título", "title"), line("Plataforma", "platform_label"), line("URL", "source_url"), line("Exportado", "exported_at")]
    turns = F.concat(F.lit("Turnos: "), "turns", F.lit(" ("), "user_turns", F.lit(" usuario, "), "assistant_turns", F.lit(" asistente, "), "unknown_turns", F.lit(" sin clasificar)"))
    lines = [
        F.lit(BANNER), F.lit("=" * len(BANNER)), F.lit(""), *head, F.lit(""), turns, *[line(*x) for x in REPORT], F.lit(UNCERTIFIED), F.concat(F.lit("Índices de turno omitidos dentro del tramo observado: "), missing),
        F.lit(NOT_INFERRED), line("Archivos sin copia local", "unresolved_files"), *[line(*x) for x in REFERENCES], F.lit(""), F.lit("ADVERTENCIAS"), F.lit("------------"), warnings, F.lit(""),
    ]
    return rows.select("conv_id", F.array_join(F.array(*lines), "\n").alias("report"))


def render_raw_turn(turns: DataFrame) -> DataFrame:
    """(conv_id, path, data): one safe page per turn that has sanitised HTML; local paths go up one folder."""
    path = F.format_string("raw/turn-%04d-%s.html", F.col("ordinal").cast("long"), "role")
    local = F.regexp_replace("raw_html", r'(src|href|poster)="(assets|files)\/', '$1="../$2/')
    page = F.concat(F.lit(f'<!doctype html><meta charset="utf-8"><meta http-equiv="Content-Security-Policy" content="{RAW_POLICY}"><title>Turno '), F.col("ordinal"), F.lit("</title>"), local)
    return turns.filter(F.col("raw_html").isNotNull() & (F.col("raw_html") != "")).select("conv_id", path.alias("path"), page.alias("data"))


def rewrite_markdown_urls(body: Column, pairs: Column) -> Column:
    """Each url of the pairs (array of structs url, path) replaced by its local path, one after the other."""
    return F.aggregate(F.coalesce(pairs, F.array()), text_or_empty(body), lambda b, p: F.replace(b, p["url"], p["path"]))


def conversation_document(turns: DataFrame, frames: dict[str, DataFrame], schema: str = "conversation-export", version: str = "1.3", lists: dict[str, DataFrame] | None = None) -> DataFrame:
    """(conv_id, document): a JSON document per conversation with its turns in order.

    `frames` (a row per conv_id) add their columns as objects under their names; `lists` (rows with `at`, their place) as arrays of objects, or of
    values if they have one column `value`, or of records of any keys if it is `json`; a conversation without rows has an empty array.
    Such records, and columns of frames, are of type VARIANT: what only some producers write needs no column of its own.
    """
    columns = [c for c in turns.columns if c not in ("conv_id", "ordinal")]
    out = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", F.struct(*columns).alias("t")))).alias("_t"))
    out = out.withColumn("turns", F.transform("_t", lambda x: F.struct(x["ordinal"].alias("ordinal"), *[x["t"][c].alias(c) for c in columns]))).drop("_t")
    for name, df in frames.items():
        of = [c for c in df.columns if c != "conv_id"]
        out = out.join(df.select("conv_id", F.struct(*of).alias(name)), "conv_id", "left")
    for name, df in (lists or {}).items():
        of = [c for c in df.columns if c not in ("conv_id", "at")]
        value = F.col(of[0]) if of in (["value"], ["json"]) else F.struct(*of)
        got = df.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("at", value.alias("v")))).alias("_l"))
        got = got.select("conv_id", (F.transform("_l.v", F.parse_json) if of == ["json"] else F.col("_l.v")).alias(name))
        out = out.join(got, "conv_id", "left").withColumn(name, F.coalesce(name, F.array().cast(got.schema[name].dataType)))
    return out.select("conv_id", F.to_json(F.struct(F.lit(schema).alias("schema"), F.lit(version).alias("schemaVersion"), F.col("conv_id").alias("conversation_id"), *frames, *(lists or {}), "turns")).alias("document"))


def export(format_: str, markdown: DataFrame, html: DataFrame, documents: DataFrame, entries: DataFrame) -> DataFrame:
    """(conv_id, path, data) of the format asked for: html, json, markdown, or the whole bundle; any other value is the bundle."""
    if format_ == "markdown":
        return markdown.select("conv_id", F.lit("conversation.md").alias("path"), F.col("markdown").alias("data"))
    if format_ == "html":
        return html.select("conv_id", F.lit("conversation.html").alias("path"), F.col("html").alias("data"))
    if format_ == "json":
        return documents.select("conv_id", F.lit("conversation.json").alias("path"), F.col("document").alias("data"))
    return entries.select("conv_id", "path", "data")
