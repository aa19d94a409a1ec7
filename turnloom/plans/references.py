"""Queries of conversation graphs, file references and their evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import refs as R
from ..sources import read_source_json
from .catalog import INPUTS, given, query

INPUTS["graph"] = """SELECT c.conv_id, concat('n', c.turn) AS node_id, CASE WHEN c.turn > 0 THEN concat('n', c.turn - 1) WHEN c.conv_id % 10 = 0 THEN concat('n', m.last) ELSE NULL END AS parent_id, CASE WHEN c.conv_id % 7 = 0 THEN NULL ELSE concat('n', m.last) END AS current_node FROM {conversations} c JOIN (SELECT conv_id, max(turn) AS last FROM {conversations} GROUP BY conv_id) m ON m.conv_id = c.conv_id
    UNION ALL SELECT conv_id, 'side', 'n0', CASE WHEN conv_id % 7 = 0 THEN NULL ELSE concat('n', max(turn)) END FROM {conversations} GROUP BY conv_id"""
INPUTS["messages"] = """SELECT conv_id, turn, CAST(turn AS int) AS seq, concat('m', conv_id, '-', turn) AS message_id, role, text FROM {conversations}"""


def messages(spark, sf_dir) -> DataFrame:
    """Messages with a sandbox link on even turns, an attachment on every third, an asset on 1 of 4, a citation on 2 of 5."""
    rows, t = given(spark, sf_dir, "messages"), F.col("turn")
    link = F.concat("text", F.lit(" [Label "), "turn", F.lit("](sandbox:/mnt/data/out/part%20(1)-"), "turn", F.lit(".txt) end"))
    bad = F.concat(F.lit("[bad](sandbox:/mnt/data/x%zz.txt) "), "text")
    parts = F.array(F.when(t % 2 == 0, link).when(t % 5 == 1, bad).otherwise(F.col("text")))
    kind = "array<struct<id:string,name:string,mime:string,size:bigint,type:string>>"
    item = lambda id_, name, size, type_: F.struct(id_.alias("id"), name.alias("name"), F.lit("text/plain").alias("mime"), size.alias("size"), F.lit(type_).cast("string").alias("type"))
    attachment = item(F.concat(F.lit("file_attached-"), t % 6, F.lit("-x")), F.when(t % 2 == 0, F.concat(F.lit("Report "), t % 3, F.lit(".txt"))), F.col("seq") * 10, None)
    asset = item(F.concat(F.lit("file-service://file_asset"), "turn"), F.lit(None).cast("string"), F.lit(5), "image_asset")
    cited = item(F.concat(F.lit("file_attached-"), t % 6, F.lit("-x")), F.concat(F.lit("part (1)-"), t - 2, F.lit(".txt")), F.lit(None), None)
    some = lambda cond, x: F.when(cond, F.array(x)).otherwise(F.array()).cast(kind)
    return rows.select("conv_id", "turn", "seq", "message_id", "role", "text", parts.alias("parts"), some(t % 3 == 0, attachment).alias("attachments"), some(t % 4 == 1, asset).alias("assets"), some(t % 5 == 2, cited).alias("citations"))


@query(
    "read_source_json",
    "SELECT conv_id AS conversation_id, node_id, parent_id, concat('hello ', node_id) AS part FROM {graph} g",
)
def read_source_json_(spark, sf_dir):
    nodes = given(spark, sf_dir, "graph")
    message = F.struct(F.col("node_id").alias("id"), F.struct(F.array(F.concat(F.lit("hello "), "node_id")).alias("parts")).alias("content"))
    one = nodes.groupBy("conv_id").agg(F.to_json(F.struct(F.max("current_node").alias("current_node"), F.map_from_entries(F.collect_list(F.struct("node_id", F.struct(F.col("node_id").alias("id"), F.col("parent_id").alias("parent"), message.alias("message"))))).alias("mapping"))).alias("json"))
    return read_source_json(one.withColumnRenamed("conv_id", "conversation_id")).select("conversation_id", "node_id", "parent_id", F.col("message.content.parts")[0].alias("part"))


@query(
    "active_branch",
    """SELECT conv_id, node_id, CAST(substr(node_id, 2) AS bigint) AS position FROM {graph} g WHERE current_node IS NOT NULL AND node_id <> 'side'
    UNION ALL SELECT conv_id, node_id, row_number() OVER (PARTITION BY conv_id ORDER BY node_id) - 1 FROM {graph} g WHERE current_node IS NULL""",
)
def active_branch(spark, sf_dir):
    return R.active_branch(given(spark, sf_dir, "graph"))


LINKS_SQL = """(SELECT conv_id, seq, 0 AS pos, message_id, role, 'Label ' || turn AS label, 'part (1)-' || turn || '.txt' AS filename, 'sandbox:/mnt/data/out/part%20(1)-' || turn || '.txt' AS sandbox_path, true AS decoded FROM {messages} m WHERE turn % 2 = 0 AND role IN ('user', 'assistant')
    UNION ALL SELECT conv_id, seq, 0, message_id, role, 'bad', 'x%zz.txt', 'sandbox:/mnt/data/x%zz.txt', false FROM {messages} m WHERE turn % 2 = 1 AND turn % 5 = 1 AND role IN ('user', 'assistant'))"""


@query("sandbox_links", f"SELECT * FROM {LINKS_SQL} l")
def sandbox_links(spark, sf_dir):
    return R.sandbox_links(messages(spark, sf_dir))


@query("safe_sandbox_path", "SELECT conv_id, turn, turn % 3 = 0 AS safe FROM conversations")
def safe_sandbox_path(spark, sf_dir):
    t = F.col("turn") % 3
    path = F.when(t == 0, F.concat(F.lit("sandbox:/mnt/data/a..b/"), "turn")).when(t == 1, "sandbox:/mnt/data/../etc").otherwise("/tmp/x")
    return given(spark, sf_dir, "conversations").select("conv_id", "turn", R.safe_sandbox_path(path).alias("safe"))


REFS_SQL = """(SELECT conv_id, seq, 0 AS phase, 0 AS pos, 'file_attached-' || (turn % 6) || '-x' AS file_id, CASE WHEN turn % 2 = 0 THEN 'Report ' || (turn % 3) || '.txt' END AS name, CAST(seq * 10 AS bigint) AS size, 'attachment' AS type, message_id, role, 'message_metadata_attachment' AS source FROM {messages} m WHERE turn % 3 = 0
    UNION ALL SELECT conv_id, seq, 1, 0, 'file_asset' || turn, NULL, 5, 'image_asset', message_id, role, 'message_content_asset' FROM {messages} m WHERE turn % 4 = 1
    UNION ALL SELECT conv_id, seq, 2, 0, 'file_attached-' || (turn % 6) || '-x', 'part (1)-' || (turn - 2) || '.txt', NULL, 'citation_file', message_id, role, 'message_metadata_citation' FROM {messages} m WHERE turn % 5 = 2)"""


@query("file_refs", f"SELECT * FROM {REFS_SQL} r")
def file_refs(spark, sf_dir):
    return R.file_refs(messages(spark, sf_dir))


BY_ID_SQL = f"""(SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, file_id ORDER BY name IS NULL, CASE WHEN name IS NULL THEN -seq ELSE seq END, CASE WHEN name IS NULL THEN -phase ELSE phase END) AS rn FROM {REFS_SQL} r) q WHERE rn = 1)"""


@query("file_refs_by_id", f"SELECT * FROM {BY_ID_SQL} b")
def file_refs_by_id(spark, sf_dir):
    return R.file_refs_by_id(R.file_refs(messages(spark, sf_dir)))


def evidence(spark, sf_dir) -> DataFrame:
    files = given(spark, sf_dir, "files").filter("turn % 2 = 1").select("conv_id", "name", F.lit(None).cast("string").alias("href"))
    media = given(spark, sf_dir, "conversations").filter("turn % 8 = 1").select("conv_id", F.lit("Photo.PNG").alias("name"), F.concat(F.lit("https://x.example/file_asset"), "turn").alias("url"))
    media = media.withColumn("url", F.concat(F.lit("file-service://file_asset"), F.element_at(F.split("url", "asset"), -1)))
    return R.visible_evidence(files, media)


EVIDENCE_SQL = """(SELECT DISTINCT conv_id, 'name' AS kind, lower(name) AS key FROM {files} f WHERE turn % 2 = 1 UNION ALL SELECT DISTINCT conv_id, 'name', 'photo.png' FROM conversations WHERE turn % 8 = 1 UNION ALL SELECT DISTINCT conv_id, 'id', 'file_asset' || turn FROM conversations WHERE turn % 8 = 1)"""


@query("visible_evidence", f"SELECT * FROM {EVIDENCE_SQL} e")
def visible_evidence(spark, sf_dir):
    return evidence(spark, sf_dir)


def matched(spark, sf_dir) -> DataFrame:
    m = messages(spark, sf_dir)
    return R.match_refs(R.file_refs_by_id(R.file_refs(m)), evidence(spark, sf_dir), R.sandbox_links(m))


MATCHED_SQL = f"""(SELECT b.*, CASE WHEN EXISTS (SELECT 1 FROM {EVIDENCE_SQL} e WHERE e.conv_id = b.conv_id AND e.kind = 'id' AND e.key = b.file_id) THEN 'id' WHEN EXISTS (SELECT 1 FROM {EVIDENCE_SQL} e WHERE e.conv_id = b.conv_id AND e.kind = 'name' AND e.key = lower(b.name)) THEN 'name'
    WHEN EXISTS (SELECT 1 FROM {LINKS_SQL} l WHERE l.conv_id = b.conv_id AND lower(l.filename) = lower(b.name)) THEN 'sandbox' END AS "by" FROM {BY_ID_SQL} b)"""


@query("match_refs", f'SELECT conv_id, file_id, name, "by" FROM {MATCHED_SQL} m WHERE "by" IS NOT NULL')
def match_refs(spark, sf_dir):
    return matched(spark, sf_dir).select("conv_id", "file_id", "name", "by")


def downloads(spark, sf_dir) -> DataFrame:
    refs = R.file_refs_by_id(R.file_refs(messages(spark, sf_dir))).filter("seq % 4 <> 3")
    return refs.select("conv_id", "file_id", F.concat(F.lit("https://dl.example/"), "file_id", F.lit("?sig=s&n=1")).alias("download_url"), F.concat("file_id", F.lit(".bin")).alias("file_name"), F.lit(9).cast("long").alias("file_size"))


def resolved(spark, sf_dir) -> DataFrame:
    return R.resolve_refs(matched(spark, sf_dir), downloads(spark, sf_dir))


RESOLVED_SQL = f"""(SELECT m.*, seq % 4 <> 3 AS resolved, CASE WHEN seq % 4 = 3 THEN 'no download for this file' END AS error, CASE WHEN seq % 4 <> 3 THEN 'https://dl.example/' || file_id || '?sig=REDACTED&n=1' END AS href_for_metadata, coalesce(name, CASE WHEN seq % 4 <> 3 THEN file_id || '.bin' END, file_id) AS visible_name FROM {MATCHED_SQL} m WHERE "by" IS NOT NULL)"""


@query("resolve_refs", f"SELECT conv_id, file_id, resolved, error, href_for_metadata, visible_name FROM {RESOLVED_SQL} r")
def resolve_refs(spark, sf_dir):
    return resolved(spark, sf_dir).select("conv_id", "file_id", "resolved", "error", "href_for_metadata", "visible_name")


def turn_files(spark, sf_dir) -> DataFrame:
    rows = given(spark, sf_dir, "files").filter("turn % 2 = 1")
    return rows.select("conv_id", F.col("turn").alias("ordinal"), "turn_id", "name", F.col("name").alias("text"), F.lit(None).cast("string").alias("href"), "kind", F.lit(None).cast("string").alias("file_id"), F.lit("visible").alias("source"))


GOOD_SQL = f"(SELECT conv_id, lower(visible_name) AS key, max(file_id) AS file_id FROM {RESOLVED_SQL} r WHERE resolved GROUP BY conv_id, lower(visible_name))"


@query(
    "apply_ref_to_files",
    f"""SELECT f.conv_id, f.turn AS ordinal, f.name, CASE WHEN g.file_id IS NOT NULL THEN 'https://dl.example/' || g.file_id || '?sig=s&n=1' END AS href, f.kind, g.file_id, CASE WHEN g.file_id IS NOT NULL THEN 'visible+resolved' ELSE 'visible' END AS source FROM {{files}} f LEFT JOIN {GOOD_SQL} g ON g.conv_id = f.conv_id AND g.key = lower(f.name) WHERE f.turn % 2 = 1
    UNION ALL SELECT r.conv_id, min(t.turn), arg_min(l.filename, t.turn), 'https://dl.example/' || r.file_id || '?sig=s&n=1', 'sandbox_attachment', r.file_id, 'visible_sandbox_link+resolved' FROM {RESOLVED_SQL} r JOIN {LINKS_SQL} l ON l.conv_id = r.conv_id AND lower(l.filename) = lower(r.visible_name) JOIN {{messages}} t ON t.conv_id = r.conv_id AND t.role = l.role AND contains(t.text || ' Label ' || t.turn, l.label)
    WHERE r.resolved AND NOT EXISTS (SELECT 1 FROM {{files}} f WHERE f.conv_id = r.conv_id AND f.turn % 2 = 1 AND lower(f.name) = lower(r.visible_name)) GROUP BY r.conv_id, r.file_id""",
)
def apply_ref_to_files(spark, sf_dir):
    m = messages(spark, sf_dir)
    turns = m.select("conv_id", F.col("turn").alias("ordinal"), "role", F.concat("text", F.lit(" Label "), "turn").alias("text"))
    return R.apply_refs_to_files(turn_files(spark, sf_dir).drop("turn_id", "text"), resolved(spark, sf_dir), R.sandbox_links(m), turns)


def generated(spark, sf_dir) -> DataFrame:
    m = messages(spark, sf_dir)
    links = R.sandbox_links(m)
    turns = m.select("conv_id", F.when(F.col("turn") % 4 == 0, F.concat(F.lit("chatgpt:message:"), "message_id")).otherwise(F.concat(F.lit("t"), "turn")).alias("turn_id"), "role", F.when(F.col("turn") % 8 == 2, F.concat(F.lit('<p data-message-id="'), "message_id", F.lit('">'))).alias("raw_html"))
    files = m.filter("turn % 8 = 6").select("conv_id", F.concat(F.lit("t"), "turn").alias("turn_id"), F.concat(F.lit("Label "), "turn").alias("text"), F.lit("other").alias("name"))
    got = links.filter("seq % 3 <> 1").select("conv_id", "message_id", "sandbox_path", F.lit("https://dl.example/x?token=1").alias("download_url"))
    return R.match_generated_links(links, turns, files, got)


GENERATED_SQL = f"""(SELECT conv_id, seq, label, CASE WHEN seq % 4 = 0 THEN 'chatgpt:message:' || message_id WHEN seq % 8 IN (2, 6) THEN 't' || seq END AS turn_id,
    CASE WHEN NOT (seq % 2 = 0) THEN 'unmatched_or_ambiguous_dom' WHEN seq % 3 <> 1 THEN 'download_url_resolved' ELSE 'unresolved' END AS status FROM {LINKS_SQL} l)"""


@query("match_generated_links", f"SELECT * FROM {GENERATED_SQL} g")
def match_generated_links(spark, sf_dir):
    return generated(spark, sf_dir).select("conv_id", "seq", "label", "turn_id", "status")


@query("unresolved_generated", f"SELECT conv_id, count(*) FILTER (status <> 'download_url_resolved') AS unresolved FROM {GENERATED_SQL} g GROUP BY conv_id")
def unresolved_generated(spark, sf_dir):
    return R.unresolved_generated(generated(spark, sf_dir))


@query(
    "source_layer_status",
    f"""SELECT c.conv_id, coalesce(r.n, 0) AS references_found, coalesce(m.n, 0) AS visible_references_matched, coalesce(d.n, 0) AS download_urls_resolved, coalesce(g.n, 0) AS sandbox_links_found, coalesce(g.u, 0) AS unresolved,
    CASE WHEN c.conv_id % 5 = 4 THEN 'not_applicable' WHEN c.conv_id % 5 = 3 THEN 'no_conversation_id' WHEN c.conv_id % 11 = 0 THEN 'failed' WHEN coalesce(g.u, 0) > 0 THEN 'partial' ELSE 'ok' END AS status FROM (SELECT DISTINCT conv_id FROM conversations) c
    LEFT JOIN (SELECT conv_id, count(*) AS n FROM {BY_ID_SQL} b GROUP BY conv_id) r ON r.conv_id = c.conv_id LEFT JOIN (SELECT conv_id, count(*) AS n FROM {MATCHED_SQL} b WHERE "by" IS NOT NULL GROUP BY conv_id) m ON m.conv_id = c.conv_id
    LEFT JOIN (SELECT conv_id, count(*) FILTER (resolved) AS n FROM {RESOLVED_SQL} b GROUP BY conv_id) d ON d.conv_id = c.conv_id LEFT JOIN (SELECT conv_id, count(*) AS n, count(*) FILTER (status <> 'download_url_resolved') AS u FROM {GENERATED_SQL} b GROUP BY conv_id) g ON g.conv_id = c.conv_id""",
)
def source_layer_status(spark, sf_dir):
    ids = given(spark, sf_dir, "conversations").select("conv_id").distinct()
    k = F.col("conv_id") % 5
    conversations = ids.select("conv_id", F.when(k == 4, "claude").otherwise("chatgpt").alias("platform"), F.when(k != 3, F.concat(F.lit("c-"), "conv_id")).alias("source_id"), (F.col("conv_id") % 11 == 0).alias("failed"))
    m = messages(spark, sf_dir)
    got = R.source_layer_status(conversations, R.file_refs_by_id(R.file_refs(m)), matched(spark, sf_dir), resolved(spark, sf_dir), generated(spark, sf_dir))
    return got.drop("platform", "source_id", "failed")
