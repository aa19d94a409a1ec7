"""Facts of a turn: code, tool runs, links, files, media, controls and activity.

Each function takes nodes that carry `turn_node` (see `nearest_turn`) and gives a row per fact, with
its position `pos` in the turn. `index` counts from 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import FILE_PATTERN, clean_text, fnv1a32, text_or_empty
from ..functions.urls import absolute_url, is_file_link, redact_url
from .dom import attr, has, inside, is_, test_id, within
from .turns import first_below

#: Languages looked for in a label, in this order; tool names; words of shells and of commands.
LANGUAGES = ("python", "bash", "shell", "sh", "zsh", "javascript", "typescript", "json", "html", "css", "sql", "powershell", "yaml", "xml", "rust", "go", "java", "c", "c++", "c#", "text")
TOOL = r"(?i)^(?:Python|Bash|Shell|Terminal|Console|Computer|Node(?:\.js)?|Container|container\.(?:exec|feed_chars)|python(?:_user_visible)?(?:\.exec)?|JavaScript tool|Herramienta)(?:\s*\d+)?$"
SHELLS = ("bash", "shell", "sh", "zsh", "powershell", "terminal", "console")
COMMAND_LINE = (
    r"(?im)(^|\n)\s*(?:\$\s*)?(?:bash|sh|zsh|python3?|node|npm|npx|pnpm|yarn|git|curl|wget|cd|ls|cat|sed|awk|grep|find|docker|kubectl|pip3?|uv|cargo|go|make|cmake|pwsh|powershell)\b"
)
SHELL_WORDS = r"(?i)\b(command|comando|cli|terminal|shell|bash|powershell)\b"
DULL_BUTTONS = r"(?iU)\b(copy|copiar|share|compartir|switch model|cambiar modelo|more actions|más acciones|open image|abrir imagen|download|descargar|edit message|editar mensaje|show more|show less|pro feedback|feedback|valorar)\b"
RISKY_LABEL = (
    r"(?iU)^(?:copy|copiar|clipboard|portapapeles|share|compartir|edit(?: message)?|editar|retry|reintentar|regenerate|regenerar|delete|eliminar|download|descargar|open file|abrir archivo|"
    r"switch model|cambiar modelo|more actions|más acciones|menu|menú|like|dislike)\b"
)
DISCLOSING_TEST = "thinking|reasoning|tool|execution|activity|artifact|computer|analysis|code|terminal|result"
DISCLOSING_WORDS = (
    r"(?iU)\b(show|hide|expand|collapse|details?|thinking|reasoning|analysis|activity|tool|python|terminal|code|result|output|ver|mostrar|ocultar|expandir|contraer|detalles?|actividad|herramienta|"
    r"resultado|salida|pensando|razonamiento)\b"
)
FILE_BUTTON = r"(?i)(?:descargar|download|\bxpi\b|\bzip\b|sha-?256|exporter|archivo|file)"
ACTIVITY_TESTS = "tool|thinking|reasoning|execution|artifact|computer"
MOST_CONTROLS, MOST_ACTIVITY = 200, 200_000
TURN = ("doc_id", "turn_node")


def _first_of(rows: DataFrame, *key: Column | str, order: str = "node_id") -> DataFrame:
    """The first row of each key in its turn."""
    w = Window.partitionBy(*TURN, *key).orderBy(order)
    return rows.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def _indexed(rows: DataFrame, order: str = "node_id") -> DataFrame:
    return rows.withColumn("index", F.row_number().over(Window.partitionBy(*TURN).orderBy(order)) - 1)


def code_texts(nodes: DataFrame) -> DataFrame:
    """pre, code and command nodes with `code`: the text of the first code below, or their own; editor lines joined; line ends as LF."""
    blocks = nodes.filter(F.col("tag").isin("pre", "code") | has("data-tool-command") | has("data-terminal-output"))
    return blocks.withColumn("code", F.coalesce("code", F.lit("")))


def leaf_pre(nodes: DataFrame) -> DataFrame:
    """pre nodes without a pre inside; `outer_pre` is whether one stands around."""
    pre = nodes.filter("tag = 'pre'").withColumn("_next", F.lead("node_id").over(Window.partitionBy("doc_id").orderBy("node_id")))
    return pre.filter("_next IS NULL OR _next > subtree_end").drop("_next").withColumn("outer_pre", within("pre", own=False))


def label_near() -> Column:
    return F.coalesce(F.nullif("prev_text", F.lit("")), "sibling_text", F.lit(""))


def code_language(blocks: DataFrame, nodes: DataFrame) -> DataFrame:
    """`language`: a class, then a data attribute (of the block, its code, two parents), then a word of the label nearby, else text."""
    rows = first_below(blocks, nodes.filter("tag = 'code'"), _class=attr("class"), _data=F.coalesce(*[F.nullif(attr(a), F.lit("")) for a in ("data-language", "data-lang", "data-code-language")]))
    classes = F.concat_ws(" ", attr("class"), "_class")
    named = F.lower(F.regexp_extract(classes, r"(?i)(?:language-|lang-)([a-z0-9_+#.-]+)", 1))
    own = F.coalesce(*[F.nullif(attr(a), F.lit("")) for a in ("data-language", "data-lang", "data-code-language")], "_data", "upper_language")
    label = F.lower(label_near())
    word = F.coalesce(*[F.when(label.rlike(rf"(?i)\b{x.replace('+', '[+]')}\b"), x) for x in LANGUAGES], F.lit("text"))
    return rows.withColumn("language", F.coalesce(F.nullif(named, F.lit("")), F.lower(own), word)).drop("_class", "_data")


def classify_code(text: Column, language: Column, label: Column) -> Column:
    """shell_code for a shell's language, or for a line that is a command where a word speaks of a shell; else code."""
    first = F.array_join(F.slice(F.split(clean_text(text), "\n"), 1, 16), "\n")
    language = F.lower(text_or_empty(language))
    shell = F.lit(False)
    for x in SHELLS:
        shell = shell | language.contains(x)
    told = F.concat_ws(" ", text_or_empty(label), first).rlike(SHELL_WORDS)
    return F.when(shell | (first.rlike(COMMAND_LINE) & told), "shell_code").otherwise("code")


def tool_executions(nodes: DataFrame) -> DataFrame:
    """Tool panels: a command editor of a known tool, and what the panel shows as its output.

    A panel is the nearest element around the command that also holds other leaf blocks. It counts if it
    holds no second command, its outputs stand in another branch without a code element, it is no
    prose, and no message begins on the way; or, without outputs, if it is an execution by its own
    marks. Columns: index, tool, command, command_language, output, outputs, output_kind, status, exit_code
    (pages do not tell it: null), source, command_block_index and output_block_indices (places among the
    turn's leaf blocks), command_node, output_nodes, hash.
    """
    leaves = code_texts(leaf_pre(nodes)).withColumn("command_like", within("editor") | is_("command"))
    leaves = first_below(leaves, nodes.filter("tag = 'code'"), _has_code=F.lit(True))
    leaf = F.struct(F.col("node_id").alias("n"), F.col("command_like").alias("c"), F.coalesce("_has_code", F.lit(False)).alias("k"), F.col("code").alias("t"))
    per_turn = leaves.filter("turn_node IS NOT NULL").groupBy(*TURN).agg(F.array_sort(F.collect_list(leaf)).alias("leaves"))
    commands = leaves.filter("command_like AND turn_node IS NOT NULL").select(*TURN, F.col("node_id").alias("command_node"), F.col("subtree_end").alias("_ce"), F.col("code").alias("command"), F.posexplode("ancestors").alias("step", "at"))
    around = nodes.filter("turn_node IS NOT NULL").select(*TURN, F.col("node_id").alias("at"), F.col("subtree_end").alias("e"), "own_marks", attr("data-tool-name").alias("tool_name"), "text")
    rows = commands.join(around, [*TURN, "at"]).filter("at <> turn_node").join(per_turn, list(TURN))
    climb = Window.partitionBy(*TURN, "command_node").orderBy("step")
    rows = rows.withColumn("branch", F.coalesce(F.lag("at").over(climb), "command_node")).withColumn("branch_end", F.coalesce(F.lag("e").over(climb), "_ce"))
    outer = F.first(F.when(F.array_contains("own_marks", "pre"), F.struct("at", "e")), ignorenulls=True).over(climb.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rows = rows.withColumn("_in", F.filter("leaves", lambda x: x["n"].between(F.col("at"), F.col("e")))).withColumn("_o", outer)
    others = F.filter("_in", lambda x: (x["n"] != F.col("command_node")) & ~F.coalesce(x["n"].between(F.col("_o.at"), F.col("_o.e")), F.lit(False)))
    rows = rows.withColumn("_others", others).withColumn("_editors", F.size(F.filter("_in", lambda x: x["c"])))
    execution = F.array_contains("own_marks", "execution")
    stop = F.array_contains("own_marks", "message_edge") | (F.col("_editors") > 1) | (F.size("_others") > 0) | execution
    separate = F.forall("_others", lambda x: ~x["n"].between(F.col("branch"), F.col("branch_end")))
    plain = F.forall("_others", lambda x: ~x["c"] & ~x["k"])
    edge = F.array_contains("own_marks", "message_edge") | (F.col("_editors") > 1)
    outputs_ok = (F.size("_others") > 0) & separate & plain & ~F.array_contains("own_marks", "prose")
    matched = ~edge & F.when(F.size("_others") > 0, outputs_ok).otherwise(execution)
    first = rows.filter(stop).groupBy(*TURN, "command_node").agg(F.min_by(F.struct("command", matched.alias("ok"), "_others", F.transform("leaves", lambda x: x["n"]).alias("all")), "step").alias("f"))
    # The tool's name: of the execution's marks, else what an outer block says beside the command.
    named = rows.groupBy(*TURN, "command_node").agg(
        F.min_by("tool_name", F.when(execution, F.col("step"))).alias("_tool"), F.bool_or(execution).alias("_explicit"), F.min_by(F.struct("text", "command"), F.when(F.array_contains("own_marks", "pre"), F.col("step"))).alias("_outer")
    )
    whole, command = clean_text(F.col("_outer.text")), clean_text(F.col("_outer.command"))
    at = F.instr(whole, command)
    beside = F.when(F.col("_outer").isNotNull(), F.substring(clean_text(F.when((at > 0) & (command != ""), F.concat(F.substring(whole, F.lit(1), at - 1), F.lit(" "), F.substring(whole, at + F.length(command), F.length(whole)))).otherwise(whole)), 1, 120))
    tool = F.coalesce(F.when(F.col("_explicit"), F.nullif("_tool", F.lit(""))), beside, F.lit(""))
    got = first.filter("f.ok").join(named, [*TURN, "command_node"]).withColumn("tool", tool).filter(F.col("tool").rlike(TOOL) & (F.trim("f.command") != ""))
    output = F.array_join(F.transform("f._others", lambda x: x["t"]), "\n\n")
    kind = F.when(F.col("command").rlike(r"^\s*(?:bash|sh|zsh)\b"), "bash").when(F.col("tool").rlike("(?i)^python"), "python").when(F.col("tool").rlike("(?i)bash|shell|terminal"), "sh").otherwise("text")
    status = F.when(F.size("output_nodes") == 0, "output_not_visible").when(F.col("output") != "", "output_visible").otherwise("empty_output_panel")
    out = got.select(*TURN, "command_node", "tool", F.col("f.command").alias("command"), output.alias("output"), F.transform("f._others", lambda x: x["n"]).alias("output_nodes"), F.col("f.all").alias("_all"), F.transform("f._others", lambda x: x["t"]).alias("outputs"))
    out = _indexed(out.withColumn("command_language", kind).withColumn("status", status), "command_node")
    place = lambda n: (F.array_position("_all", n) - 1).cast("int")
    out = out.withColumns({
        "output_kind": F.lit("combined_visible_output"), "exit_code": F.lit(None).cast("int"), "source": F.lit("visible_tool_panel"), "command_block_index": place(F.col("command_node")),
        "output_block_indices": F.transform("output_nodes", place),
    })
    return out.withColumn("hash", fnv1a32(F.concat_ws("\n", "tool", "command", "output"))).drop("_all")


def code_blocks(nodes: DataFrame, executions: DataFrame) -> DataFrame:
    """Leaf blocks (kinds by their part in a tool run; `pre_index`: their place among the turn's), then inline code, then explicit command or terminal nodes; repeats are kept."""
    texts = code_texts(nodes).filter("turn_node IS NOT NULL AND code <> ''")
    role = executions.select("doc_id", F.col("command_node").alias("node_id"), F.lit("tool_command").alias("_kind"), F.col("command_language").alias("_language"), F.col("tool").alias("_label")).unionByName(
        executions.select("doc_id", F.explode("output_nodes").alias("node_id"), F.lit("tool_output").alias("_kind"), F.lit("text").alias("_language"), F.concat("tool", F.lit(" · salida visible")).alias("_label"))
    )
    numbered = leaf_pre(nodes).filter("turn_node IS NOT NULL").withColumn("pre_index", F.row_number().over(Window.partitionBy(*TURN).orderBy("node_id")) - 1)
    leaf = code_language(code_texts(numbered).filter("code <> ''"), nodes).join(role, ["doc_id", "node_id"], "left")
    label, none = F.coalesce("_label", F.nullif(label_near(), F.lit(""))), F.lit(None).cast("int").alias("pre_index")
    parts = [
        leaf.select(*TURN, "node_id", "pre_index", F.lit(0).alias("phase"), F.coalesce("_kind", classify_code(F.col("code"), F.col("language"), label_near())).alias("kind"), F.coalesce("_language", "language").alias("language"), label.alias("label"), "code", F.lit("pre").alias("source")),
        texts.filter((F.col("tag") == "code") & ~within("pre")).select(*TURN, "node_id", none, F.lit(1).alias("phase"), F.lit("inline_code").alias("kind"), F.lit(None).cast("string").alias("language"), F.lit(None).cast("string").alias("label"), "code", F.lit("code").alias("source")),
    ]
    loose = first_below(texts.filter((has("data-tool-command") | has("data-terminal-output")) & ~within("pre")), nodes.filter("tag = 'pre'"), _pre=F.lit(True)).filter("_pre IS NULL")
    parts.append(loose.select(*TURN, "node_id", none, F.lit(2).alias("phase"), F.lit("code").alias("kind"), F.lit("text").alias("language"), F.lit(None).cast("string").alias("label"), "code", F.lit("explicit_monospace_fallback").alias("source")))
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    index = F.row_number().over(Window.partitionBy(*TURN).orderBy("phase", "node_id")) - 1
    told = F.when(F.col("source") == "code", F.col("code")).when(F.col("source") == "pre", F.concat_ws("\n", "kind", "language", "code")).otherwise(F.col("code"))
    return rows.withColumn("index", index).withColumn("hash", fnv1a32(told)).drop("phase", "node_id").withColumnRenamed("code", "text")


def _label() -> Column:
    return F.coalesce(F.nullif("inner_text", F.lit("")), F.nullif(attr("aria-label"), F.lit("")), attr("title"), F.lit(""))


def _with_details(nodes: DataFrame) -> DataFrame:
    """Summaries of details, with whether these are open."""
    details = nodes.filter("tag = 'details'").select("doc_id", F.col("node_id").alias("parent_id"), has("open").alias("_open"))
    return nodes.join(details, ["doc_id", "parent_id"], "left")


def expandables(nodes: DataFrame) -> DataFrame:
    """Disclosures, distinct by label, state and target, the first kept."""
    rows = _with_details(nodes.filter("turn_node IS NOT NULL"))
    button = (((F.col("tag") == "button") | (attr("role") == "button")) & has("aria-expanded")) | ((F.col("tag") == "button") & has("data-state"))
    summary = (F.col("tag") == "summary") & F.col("_open").isNotNull()
    expanded = F.when(F.col("tag") == "summary", F.coalesce("_open", F.lit(False))).when(has("aria-expanded"), attr("aria-expanded") == "true").otherwise(F.coalesce(attr("data-state") == "open", F.lit(False)))
    rows = rows.filter(F.coalesce(button, F.lit(False)) | summary).withColumn("label", _label()).withColumn("expanded", expanded).withColumn("aria_controls", F.nullif(attr("aria-controls"), F.lit("")))
    rows = _indexed(_first_of(rows, "label", "expanded", F.coalesce("aria_controls", F.lit(""))))
    return rows.select(*TURN, "index", F.nullif("label", F.lit("")).alias("label"), "expanded", "aria_controls", F.nullif(attr("data-state"), F.lit("")).alias("data_state"))


def activities(nodes: DataFrame) -> DataFrame:
    """Status, disclosure and tool nodes outside toolbars, distinct by type, text and test id."""
    rows = _with_details(nodes.filter("turn_node IS NOT NULL"))
    expandable = ((F.col("tag") == "button") & has("aria-expanded")) | ((F.col("tag") == "summary") & F.col("_open").isNotNull())
    status = F.coalesce(attr("role") == "status", F.lit(False)) | F.coalesce(attr("aria-live").isin("polite", "assertive"), F.lit(False))
    rows = rows.filter((expandable | status | test_id().rlike(ACTIVITY_TESTS)) & ~within("toolbar"))
    text = F.coalesce(F.nullif("inner_text", F.lit("")), attr("aria-label"), F.lit(""))
    dull = (F.col("tag") == "button") & has("aria-expanded") & F.lower(clean_text(F.concat_ws(" ", text_or_empty(attr("aria-label")), text))).rlike(DULL_BUTTONS)
    kind = F.when(expandable, "expandable").when(F.coalesce(attr("role") == "status", F.lit(False)) | has("aria-live"), "status").otherwise("tool_or_activity")
    rows = rows.withColumn("value", text).filter((F.col("value") != "") & (F.length("value") <= MOST_ACTIVITY) & ~dull).withColumn("type", kind).withColumn("test_id", F.nullif(attr("data-testid"), F.lit("")))
    rows = _indexed(_first_of(rows, "type", "value", F.coalesce("test_id", F.lit(""))))
    open_ = F.when(F.coalesce(attr("aria-expanded") == "true", F.lit(False)) | F.coalesce("_open", F.lit(False)), True)
    return rows.select(*TURN, "index", "type", F.col("value").alias("text"), open_.alias("expanded"), "test_id", F.nullif(attr("aria-label"), F.lit("")).alias("aria_label"))


def media(nodes: DataFrame, base: Column) -> DataFrame:
    """Images, video, audio and sources by absolute URL, the first kept; favicons are decorative."""
    kinds = F.create_map(*[F.lit(x) for kv in (("img", "image"), ("video", "video"), ("audio", "audio"), ("source", "source")) for x in kv])
    rows = nodes.filter("turn_node IS NOT NULL AND tag IN ('img', 'video', 'audio', 'source')").withColumn("url", absolute_url(F.coalesce(F.nullif(attr("src"), F.lit("")), attr("poster")), base))
    rows = _indexed(_first_of(rows.filter("url <> ''"), "url"))
    decorative = F.col("url").rlike(r"(?i)\/s2\/favicons(?:[?#]|$)|favicon\.(?:ico|png)")
    none = lambda a: F.nullif(attr(a), F.lit(""))
    return rows.select(*TURN, "index", kinds[F.col("tag")].alias("kind"), decorative.alias("decorative"), "url", redact_url(F.col("url")).alias("url_for_metadata"), none("alt").alias("alt"), none("title").alias("title"), attr("width").try_cast("int").alias("width"), attr("height").try_cast("int").alias("height"))


def _anchors(nodes: DataFrame, base: Column) -> DataFrame:
    rows = nodes.filter((F.col("tag") == "a") & has("href")).withColumn("href", absolute_url(attr("href"), base))
    return rows.filter((F.col("href") != "") & ~F.col("href").rlike("(?i)^javascript:")).withColumn("href_for_metadata", redact_url(F.col("href")))


def links(nodes: DataFrame, base: Column) -> DataFrame:
    """Links distinct by redacted address and text, the first kept."""
    rows = _anchors(nodes, base).withColumn("label", text_or_empty(F.col("inner_text")))
    rows = _indexed(_first_of(rows, "href_for_metadata", "label"))
    return rows.select(*TURN, "index", F.nullif("label", F.lit("")).alias("text"), "href", "href_for_metadata", F.nullif(attr("title"), F.lit("")).alias("title"), F.nullif(attr("download"), F.lit("")).alias("download_name"))


def ui_file_tiles(nodes: DataFrame) -> DataFrame:
    """Files that only controls show: attachment tiles, artifact rows, buttons that speak of a file."""
    rows = nodes.filter("turn_node IS NOT NULL")
    icons = first_below(rows.filter(is_("tile")), rows.filter(is_("file_icon")), _icon=F.lit(True))
    name = clean_text(F.coalesce(F.nullif(attr("aria-label"), F.lit("")), F.element_at(F.split(text_or_empty(F.col("inner_text")), "\n"), 1)))
    signal = F.col("_icon").isNotNull() | text_or_empty(attr("class")).contains("group/file-tile")
    tiles = icons.withColumn("name", name).filter(signal & F.col("name").rlike(FILE_PATTERN))
    part = lambda df, phase, kind, source, named: df.select(*TURN, "node_id", F.lit(phase).alias("phase"), "name", F.lit(kind).alias("kind"), F.lit(source).alias("source"), F.when(F.lit(named), F.col("name")).alias("download_name"))
    label = clean_text(attr("aria-label"))
    openers = rows.filter((F.col("tag") == "button") & within("artifact_row", own=False) & label.rlike(FILE_PATTERN) & ~label.rlike(r"(?i)^download\b")).withColumn("name", label)
    held = inside(openers, rows.filter(is_("artifact_row")).withColumn("_row", F.col("node_id")), ["_row"])
    artifacts = held.withColumn("_r", F.row_number().over(Window.partitionBy("doc_id", "_row").orderBy("node_id"))).filter("_r = 1").drop("_r", "_row")
    text = clean_text(F.coalesce(F.nullif("text", F.lit("")), attr("aria-label")))
    buttons = rows.filter((F.col("tag") == "button") & F.array_contains(F.split(text_or_empty(attr("class")), r"\s+"), "behavior-btn") & ~within("pre") & ~within("code")).withColumn("name", text).filter(F.col("name").rlike(FILE_BUTTON))
    every = part(tiles, 0, "ui_attachment", "visible_file_tile", True).unionByName(part(artifacts, 1, "generated_artifact", "visible_artifact_row", True))
    every = _first_of(every, "kind", "name")
    more = _first_of(part(buttons, 2, "file_button_reference", "visible_behavior_button", False), "name").join(every.select(*TURN, "name").distinct(), [*TURN, "name"], "left_anti")
    return every.unionByName(more)


def linked_files(nodes: DataFrame, base: Column) -> DataFrame:
    """Links that are files, distinct by address, then files of controls."""
    anchors = _anchors(nodes.filter("turn_node IS NOT NULL"), base).filter(is_file_link(F.col("href"), has("download"), within("cited"), within("attachment")))
    files = _first_of(anchors, "href").select(*TURN, "node_id", F.lit(-1).alias("phase"), F.nullif("inner_text", F.lit("")).alias("text"), "href", "href_for_metadata", F.nullif(attr("download"), F.lit("")).alias("download_name"), F.lit("linked_file").alias("kind"), F.lit("anchor").alias("source"))
    tiles = ui_file_tiles(nodes).select(*TURN, "node_id", "phase", F.col("name").alias("text"), F.lit(None).cast("string").alias("href"), F.lit(None).cast("string").alias("href_for_metadata"), "download_name", "kind", "source")
    index = F.row_number().over(Window.partitionBy(*TURN).orderBy("phase", "node_id")) - 1
    return files.unionByName(tiles).withColumn("index", index).drop("phase", "node_id")


def interactive(nodes: DataFrame, most: int = MOST_CONTROLS) -> DataFrame:
    """The first controls of a turn that say something, outside toolbars unless they expand."""
    control = F.col("tag").isin("button", "input", "textarea", "select", "summary") | F.coalesce(attr("role") == "button", F.lit(False))
    text = F.coalesce(F.nullif("inner_text", F.lit("")), F.nullif(attr("aria-label"), F.lit("")), attr("placeholder"), F.lit(""))
    rows = nodes.filter(F.col("turn_node").isNotNull() & control & (~within("toolbar") | has("aria-expanded"))).withColumn("value", text).filter((F.col("value") != "") | (text_or_empty(attr("aria-expanded")) != ""))
    none = lambda a: F.nullif(attr(a), F.lit(""))
    disabled = has("disabled") | F.coalesce(attr("aria-disabled") == "true", F.lit(False))
    return _indexed(rows).filter(F.col("index") < most).select(*TURN, "index", "tag", none("role").alias("role"), F.nullif("value", F.lit("")).alias("text"), none("aria-label").alias("aria_label"), none("aria-expanded").alias("aria_expanded"), none("aria-pressed").alias("aria_pressed"), disabled.alias("disabled"))


def disclosure_candidates(nodes: DataFrame) -> DataFrame:
    """`likely` of buttons and disclosures: closed, harmless by place and label, and with a known target, test id or label, or in a turn."""
    targets = nodes.filter(text_or_empty(attr("id")) != "").select("doc_id", attr("id").alias("_target"), F.lit(True).alias("_known")).distinct()
    rows = nodes.filter((F.col("tag") == "button") | F.coalesce(attr("role") == "button", F.lit(False))).withColumn("_target", attr("aria-controls")).join(targets, ["doc_id", "_target"], "left")
    label = clean_text(F.concat_ws(" ", text_or_empty(attr("aria-label")), text_or_empty(attr("title")), text_or_empty(F.col("inner_text"))))
    place = within("toolbar") | within("nav") | within("form") | within("artifact_row")
    kind = (text_or_empty(attr("aria-haspopup")) != "") | F.array_contains(F.split(text_or_empty(attr("class")), r"\s+"), "behavior-btn") | test_id().rlike("copy|clipboard")
    risky = has("disabled") | F.coalesce(attr("aria-disabled") == "true", F.lit(False)) | place | kind | label.rlike(RISKY_LABEL)
    closed = F.coalesce(attr("aria-expanded") == "false", F.lit(False)) | F.coalesce(attr("data-state") == "closed", F.lit(False))
    known = F.col("_known").isNotNull() | F.lower(test_id()).rlike(DISCLOSING_TEST) | label.rlike(DISCLOSING_WORDS)
    fallback = within("turn_like") & (has("aria-expanded") | has("data-state"))
    return rows.select(*TURN, "node_id", label.alias("label"), (~risky & closed & (known | fallback)).alias("likely"))
