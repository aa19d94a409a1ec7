"""Turns of a page: which nodes they are, who speaks, and what they are called."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clean_text, fnv1a32, text_or_empty
from .dom import attr, has, inside, is_, outermost, test_id, within

#: Own attributes that name a turn, in order, and descendants that do, with their labels.
ID_ATTRIBUTES = ("data-turn-id", "data-message-id", "data-testid", "data-test-render-count", "id", "data-id")
ID_DESCENDANTS = (("data-message-id", "message"), ("data-turn-id", "turn"), ("data-testid", "testid"), ("data-test-render-count", "render"))
#: Words of an accessible name that tell who speaks.
USER_WORDS = r"(?U)\b(user|you|usuario|tú)\b"
ASSISTANT_WORDS = r"(?U)\b(assistant|chatgpt|claude|asistente)\b"
MATERIAL_TAGS = ("img", "video", "audio", "canvas", "pre", "code")
MATERIAL_TESTS = "tool|thinking|reasoning|artifact"
ID_TEXT = 12_000


def _section() -> Column:
    return F.col("tag").isin("section", "article")


def turn_shells(nodes: DataFrame) -> DataFrame:
    """The outermost nodes of the five selectors of persistent turns."""
    numbered = _section() & test_id().startswith("conversation-turn-")
    return outermost(nodes.filter(numbered | (has("data-turn-id-container") & has("data-turn")) | (_section() & has("data-turn") & has("data-turn-id"))))


def turn_mixed(nodes: DataFrame) -> DataFrame:
    """Shells, and the outermost nodes with a role that stand in no shell, once each in document order."""
    shells = turn_shells(nodes)
    both = ("user", "assistant")
    role = nodes.filter(((F.col("tag") == "article") & attr("data-turn").isin(*both)) | attr("data-message-author-role").isin(*both))
    loose = inside(role, shells.withColumn("shell", F.col("node_id")), ["shell"]).filter("shell IS NULL").drop("shell")
    return shells.unionByName(outermost(loose)).dropDuplicates(["doc_id", "node_id"])


def _message() -> Column:
    return is_("user_message") | is_("assistant_message") | F.exists(F.split(text_or_empty(attr("class")), r"\s+"), lambda c: c.isin("standard-markdown", "progressive-markdown"))


def turn_claude(nodes: DataFrame) -> DataFrame:
    """Render containers with message content, without those that one of the same role contains; else message nodes, lifted to their container."""
    boxes = nodes.filter(has("data-test-render-count"))
    with_message = first_below(boxes, nodes.filter(_message()), _m=_true(_message())).filter(is_("user_message") | F.col("_m")).drop("_m")
    found = outermost(detect_role(with_message, nodes), "role").drop("role")
    plain = nodes.filter(is_("user_message") | (is_("assistant_message") & ~is_("streaming")) | (within("streaming", own=False) & F.array_contains(F.split(text_or_empty(attr("class")), r"\s+"), "standard-markdown")))
    missing = plain.join(found.select("doc_id").distinct(), "doc_id", "left_anti")
    lifted = inside(missing, outermost(boxes).withColumn("box", F.col("node_id")), ["box"])
    lifted = lifted.select("doc_id", F.coalesce("box", "node_id").alias("node_id")).distinct()
    return found.unionByName(nodes.join(lifted, ["doc_id", "node_id"], "left_semi"))


def turn_generic(nodes: DataFrame) -> DataFrame:
    wanted = (F.col("tag") == "article") | has("data-message-author-role") | test_id().contains("message")
    return nodes.filter(within("main", own=False) & wanted & (text_or_empty(F.col("inner_text")) != ""))


def turn_elements(nodes: DataFrame, platforms: DataFrame) -> DataFrame:
    """By the page's platform (doc_id, platform): mixed turns, containers, or generic ones; generic also where the platform's way finds none."""
    tagged = nodes.join(platforms, "doc_id")
    own = turn_mixed(tagged.filter("platform = 'chatgpt'")).unionByName(turn_claude(tagged.filter("platform = 'claude'")))
    rest = turn_generic(tagged).join(own.select("doc_id").distinct(), "doc_id", "left_anti")
    return own.unionByName(rest).drop("platform")


def first_below(turns: DataFrame, nodes: DataFrame, **values: Column) -> DataFrame:
    """`turns` (nested or not) with the first non-null of each value among the nodes below.

    One pass from the end of each page keeps the nearest node that has the value; it counts if the
    turn's interval reaches it. No turn is joined with its nodes.
    """
    kinds = {k: F.struct(F.col("node_id").alias("n"), v.alias("v")) for k, v in values.items()}
    asked = nodes.select("doc_id", "node_id", F.lit(1).alias("_asked"), *[F.when(v.isNotNull(), kinds[k]).alias(k) for k, v in values.items()])
    marked = turns.select("doc_id", "node_id", F.lit(0).alias("_asked"), *[F.lit(None).cast(asked.schema[k].dataType).alias(k) for k in values])
    w = Window.partitionBy("doc_id").orderBy(F.desc("node_id"), "_asked").rowsBetween(Window.unboundedPreceding, 0)
    seen = marked.unionByName(asked).select("doc_id", "node_id", "_asked", *[F.last(k, ignorenulls=True).over(w).alias(k) for k in values]).filter("_asked = 0").drop("_asked")
    rows = turns.join(seen.dropDuplicates(["doc_id", "node_id"]), ["doc_id", "node_id"], "left")
    return rows.select(*turns.columns, *[F.when(F.col(f"{k}.n") <= F.col("subtree_end"), F.col(f"{k}.v")).alias(k) for k in values])


def _some(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def _true(c: Column) -> Column:
    return F.when(c, True)


def _role_values() -> dict[str, Column]:
    return {"_nested": _some(F.lower(attr("data-message-author-role"))), "_user": _true(is_("user_message")), "_assistant": _true(is_("assistant_message"))}


def _role() -> Column:
    direct = F.lower(F.coalesce(F.nullif(attr("data-turn"), F.lit("")), F.nullif(attr("data-message-author-role"), F.lit("")), attr("data-role"), F.lit("")))
    nested, name = text_or_empty(F.col("_nested")), F.lower(text_or_empty(attr("aria-label")))
    return (
        F.when(direct.contains("user") | direct.contains("human"), "user").when(direct.contains("assistant") | direct.contains("ai"), "assistant")
        .when(nested.contains("user"), "user").when(nested.contains("assistant"), "assistant")
        .when(is_("user_message") | F.coalesce("_user", F.lit(False)), "user").when(is_("assistant_message") | F.coalesce("_assistant", F.lit(False)), "assistant")
        .when(name.rlike(USER_WORDS), "user").when(name.rlike(ASSISTANT_WORDS), "assistant").otherwise("unknown")
    )


def detect_role(turns: DataFrame, nodes: DataFrame) -> DataFrame:
    """`role` of each turn by ordered rules: own attributes, the first role below, message classes, words of its name, unknown."""
    asked = nodes.filter(has("data-message-author-role") | is_("user_message") | is_("assistant_message"))
    return first_below(turns, asked, **(values := _role_values())).withColumn("role", _role()).drop(*values)


def _id_values() -> dict[str, Column]:
    value = {a: attr(a) if a != "data-testid" else F.when(test_id().startswith("conversation-turn-"), test_id()) for a, _ in ID_DESCENDANTS}
    return {f"_{label}": _some(value[a]) for a, label in ID_DESCENDANTS}


def _turn_id(platform: Column) -> Column:
    own = [F.when(text_or_empty(attr(a)).isin("", "user", "assistant"), None).otherwise(F.concat(platform, F.lit(f":{a}:"), attr(a))) for a in ID_ATTRIBUTES]
    nested = [F.concat(platform, F.lit(f":{label}:"), F.col(f"_{label}")) for _, label in ID_DESCENDANTS]
    text = clean_text(F.col("text"))
    content = F.when(text != "", F.concat(platform, F.lit(":content:"), "role", F.lit(":"), fnv1a32(F.substring(text, 1, ID_TEXT))))
    return F.coalesce(*own, *nested, content, F.concat(platform, F.lit(":node:"), F.col("node_id")))


def stable_turn_id(turns: DataFrame, nodes: DataFrame, platform: Column) -> DataFrame:
    """`turn_id`: own attributes in order, then descendants', then a hash of role and text, then the node's number. Needs `role`."""
    asked = nodes.filter(has("data-message-id") | has("data-turn-id") | test_id().startswith("conversation-turn-") | has("data-test-render-count"))
    return first_below(turns, asked, **(values := _id_values())).withColumn("turn_id", _turn_id(platform)).drop(*values)


def order_hint() -> Column:
    n = F.regexp_extract(test_id(), r"^conversation-turn-(\d+)$", 1)
    count = F.when(text_or_empty(attr("data-test-render-count")).rlike(r"^\d+$"), attr("data-test-render-count"))
    return F.coalesce(F.nullif(n, F.lit("")), count).try_cast("int")


def _model_values() -> dict[str, Column]:
    return {"_model": _some(attr("data-message-model-slug"))}


def _model() -> Column:
    return F.coalesce(F.nullif(attr("data-message-model-slug"), F.lit("")), "_model")


def model_slug(turns: DataFrame, nodes: DataFrame) -> DataFrame:
    """`model`: the turn's own slug or the first below it."""
    return first_below(turns, nodes.filter(has("data-message-model-slug")), **_model_values()).withColumn("model", _model()).drop("_model")


def _material_values() -> dict[str, Column]:
    material = F.col("tag").isin(*MATERIAL_TAGS) | test_id().rlike(MATERIAL_TESTS)
    mounted = has("data-message-author-role") | is_("prose") | F.col("tag").isin("pre", "img") | test_id().rlike(MATERIAL_TESTS)
    return {"_material": _true(material), "_mounted": _true(mounted)}


def _material() -> dict[str, Column]:
    text = clean_text(F.col("text")) != ""
    return {"has_material": text | F.coalesce("_material", F.lit(False)), "mounted": text | F.coalesce("_mounted", F.lit(False))}


def with_material(turns: DataFrame, nodes: DataFrame) -> DataFrame:
    """`has_material`: text, or media, code or a tool below; `mounted`: text, or one of the nodes that show that content has come."""
    values = _material_values()
    asked = nodes.filter(F.coalesce(*values.values()).isNotNull())
    return first_below(turns, asked, **values).withColumns(_material()).drop(*values)


def identified(turns: DataFrame, nodes: DataFrame, platforms: DataFrame) -> DataFrame:
    """`role`, `turn_id`, `model`, `has_material` and `mounted` of each turn, as the functions above give them, from one pass over the pages."""
    values = _role_values() | _id_values() | _model_values() | _material_values()
    asked = nodes.filter(F.coalesce(*[v.cast("string") for v in values.values()]).isNotNull())
    rows = first_below(turns, asked, **values).join(platforms, "doc_id").withColumn("role", _role())
    return rows.withColumn("turn_id", _turn_id(F.col("platform"))).withColumns({"model": _model(), **_material()}).drop(*values)


def nearest_turn(nodes: DataFrame, turns: DataFrame) -> DataFrame:
    """`turn_node`: the turn that each node stands in, or is."""
    return inside(nodes, turns.withColumn("turn_node", F.col("node_id")), ["turn_node"])


def document_order(nodes: DataFrame) -> DataFrame:
    """`position`, from 0, of distinct nodes in document order."""
    w = Window.partitionBy("doc_id").orderBy("node_id")
    return nodes.dropDuplicates(["doc_id", "node_id"]).withColumn("position", F.row_number().over(w) - 1)


def conversation_title(nodes: DataFrame, platforms: DataFrame) -> DataFrame:
    """(doc_id, title): the first header candidate under 250 characters, by platform; else the page's title without its suffix; else a word for it."""
    rows = nodes.join(platforms, "doc_id")
    text, claude = text_or_empty(F.col("inner_text")), F.col("platform") == "claude"
    h1 = F.col("tag") == "h1"
    rank = F.when(claude & (test_id() == "chat-header"), 0).when(h1 & within("main", own=False), 1).when(h1 & within("header", own=False), 2).when(~claude & test_id().contains("conversation-title"), 3)
    usable = rank.isNotNull() & (text != "") & (F.length(text) < 250)
    page = clean_text(F.regexp_replace(F.col("text"), r"(?iU)\s*[|–—-]\s*(ChatGPT|Claude).*$", ""))
    got = rows.withColumn("_rank", rank).groupBy("doc_id").agg(F.min_by(text, F.when(usable, F.struct("_rank", "node_id"))).alias("head"), F.bool_or(usable).alias("any"), F.min_by(page, F.when(F.col("tag") == "title", F.col("node_id"))).alias("page"))
    return got.select("doc_id", F.coalesce(F.when(F.col("any"), F.col("head")), F.nullif("page", F.lit("")), F.lit("Conversación")).alias("title"))
