"""Queries of merging, ordering, coverage and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import merge as M
from .catalog import given, query

SCORE_SQL = "CAST(length(text) + 0.25 * length('**' || role || '** ' || text) + 2 * CASE WHEN turn % 3 = 0 THEN length(role) + 4 ELSE 0 END + 600 * (turn % 2) + 400 * (turn % 4) + 250 * (turn % 3) + 80 * (turn % 5) AS double)"


def scored(rows: DataFrame) -> DataFrame:
    """Captures with arrays made from their turn number, and their score."""

    def made(n) -> F.Column:
        return F.slice(F.array(*[F.lit(i) for i in range(5)]), F.lit(1), n)

    code = F.when(F.col("turn") % 3 == 0, F.array(F.col("role"), F.lit("code"))).otherwise(F.array().cast("array<string>"))
    rows = rows.withColumn("markdown", F.concat(F.lit("**"), "role", F.lit("** "), "text")).withColumn("code_texts", code)
    counts = [F.size(made((F.col("turn") % k).cast("int"))) for k in (2, 4, 3, 5)]
    return rows.withColumn("score", M.snapshot_score(F.col("text"), F.col("markdown"), F.col("code_texts"), *counts))


def merged(spark, sf_dir) -> DataFrame:
    return M.merge_captures(scored(given(spark, sf_dir, "captures")))


def ordered(spark, sf_dir) -> DataFrame:
    return M.order_turns(M.scan_order(merged(spark, sf_dir)))


MERGED_SQL = f"""(SELECT * FROM (SELECT *, {SCORE_SQL} AS score, row_number() OVER (PARTITION BY conv_id, turn_id ORDER BY {SCORE_SQL} DESC, capture_seq DESC) AS rn, min(capture_seq) OVER (PARTITION BY conv_id, turn_id) AS first_seq FROM {{captures}} c) m WHERE rn = 1)"""
SCANNED_SQL = f"(SELECT *, dense_rank() OVER (PARTITION BY conv_id ORDER BY first_seq, turn_id) - 1 AS scan_order FROM {MERGED_SQL} s)"
ORDERED_SQL = f"""(SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY anchor NULLS FIRST, order_hint IS NULL, scan_order, turn_id) AS ordinal FROM
    (SELECT *, coalesce(order_hint, last_value(order_hint IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY scan_order, turn_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS anchor FROM {SCANNED_SQL} t) u)"""
HINTS_SQL = "(SELECT conv_id, list_sort(list(DISTINCT CAST(turn AS int))) AS observed, count(*) AS captured_turns FROM {gaps} g GROUP BY conv_id)"
MISSING_SQL = "CASE WHEN len(observed) > 1 AND observed[-1] - observed[1] < 100000 THEN list_filter(range(observed[1], observed[-1] + 1), lambda i: NOT list_contains(observed, i)) ELSE [] END"


@query("snapshot_score", f"SELECT conv_id, turn_id, capture_seq, {SCORE_SQL} AS score FROM {{captures}} c")
def snapshot_score(spark, sf_dir):
    return scored(given(spark, sf_dir, "captures")).select("conv_id", "turn_id", "capture_seq", "score")


@query("merge_captures", f"SELECT conv_id, turn_id, capture_seq, first_seq, score, text FROM {MERGED_SQL} m")
def merge_captures(spark, sf_dir):
    return merged(spark, sf_dir).select("conv_id", "turn_id", "capture_seq", "first_seq", "score", "text")


@query("merge_evicted", f"SELECT conv_id, turn_id, capture_seq, source FROM {MERGED_SQL} m WHERE length(text) > 0")
def merge_evicted(spark, sf_dir):
    rows = scored(given(spark, sf_dir, "captures"))
    together = M.with_evicted(rows.filter("source = 'mounted'"), rows.filter("source = 'evicted'"), F.length("text") > 0)
    return M.merge_captures(together).select("conv_id", "turn_id", "capture_seq", "source")


@query("scan_order", f"SELECT conv_id, turn_id, CAST(scan_order AS int) AS scan_order FROM {SCANNED_SQL} t")
def scan_order(spark, sf_dir):
    return M.scan_order(merged(spark, sf_dir)).select("conv_id", "turn_id", F.col("scan_order").cast("int"))


@query("order_turns", f"SELECT conv_id, list(turn_id ORDER BY ordinal) AS turns FROM {ORDERED_SQL} t GROUP BY conv_id")
def order_turns(spark, sf_dir):
    rows = ordered(spark, sf_dir).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "turn_id"))).alias("t"))
    return rows.select("conv_id", F.col("t.turn_id").alias("turns"))


@query("turn_ordinal", f"SELECT conv_id, turn_id, order_hint, CAST(ordinal AS int) AS ordinal FROM {ORDERED_SQL} t")
def turn_ordinal(spark, sf_dir):
    return ordered(spark, sf_dir).select("conv_id", "turn_id", "order_hint", "ordinal")


def hinted(spark, sf_dir) -> DataFrame:
    return given(spark, sf_dir, "gaps").withColumn("order_hint", F.col("turn").cast("int"))


@query(
    "turn_continuity",
    f"SELECT conv_id, observed, captured_turns, {MISSING_SQL} AS missing, CASE WHEN len({MISSING_SQL}) > 0 THEN 'gaps_detected' ELSE 'no_internal_gaps_observed' END AS status, false AS complete_conversation_verified, CAST(NULL AS int) AS expected_total FROM {HINTS_SQL} h",
)
def turn_continuity(spark, sf_dir):
    return M.turn_continuity(hinted(spark, sf_dir))


@query(
    "continuity_gaps",
    "SELECT conv_id, h + 1 AS gap_from, n - 1 AS gap_to FROM (SELECT conv_id, CAST(turn AS int) AS h, lead(CAST(turn AS int)) OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM {gaps} g) t WHERE n - h > 1",
)
def continuity_gaps(spark, sf_dir):
    return M.continuity_gaps(hinted(spark, sf_dir))


COVERAGE_SQL = "(SELECT conv_id, turn_id, count(*) AS captures, coalesce(arg_max(bottom, tile) <= arg_max(height, tile) - 24, false) AS reached_bottom FROM {tiles} t GROUP BY conv_id, turn_id)"


@query("visual_coverage", f"SELECT *, NOT reached_bottom AS limited FROM {COVERAGE_SQL} c")
def visual_coverage(spark, sf_dir):
    return M.visual_coverage(given(spark, sf_dir, "tiles"))


KEPT_SQL = "(SELECT conv_id, concat('t', turn) AS turn_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS int) AS ordinal, CAST(count(*) OVER (PARTITION BY conv_id) AS bigint) AS n FROM {gaps} g)"


def kept(spark, sf_dir) -> DataFrame:
    rows = hinted(spark, sf_dir).withColumn("turn_id", F.concat(F.lit("t"), "turn")).withColumn("scan_order", F.col("turn"))
    return M.order_turns(rows)


@query(
    "coverage_warnings",
    f"""SELECT conv_id, 'gaps' AS kind, CAST(NULL AS int) AS ordinal, array_to_string({MISSING_SQL}, ', ') AS detail FROM {HINTS_SQL} h WHERE len({MISSING_SQL}) > 0
    UNION ALL SELECT c.conv_id, 'limited', k.ordinal, c.turn_id FROM {COVERAGE_SQL} c LEFT JOIN {KEPT_SQL} k ON k.conv_id = c.conv_id AND k.turn_id = c.turn_id WHERE NOT reached_bottom""",
)
def coverage_warnings(spark, sf_dir):
    return M.coverage_warnings(M.turn_continuity(hinted(spark, sf_dir)), M.visual_coverage(given(spark, sf_dir, "tiles")), kept(spark, sf_dir))


@query(
    "evidence_labels",
    f"""SELECT t.conv_id, t.turn_id, t.tile, t.label AS capture_label, t.turn_ordinal AS capture_turn_ordinal, k.ordinal AS turn_ordinal,
    CASE WHEN k.ordinal IS NOT NULL THEN 'Turno ' || k.ordinal || ' de ' || k.n || ' · vista ' || t.tile ELSE t.label END AS label FROM {{tiles}} t LEFT JOIN {KEPT_SQL} k ON k.conv_id = t.conv_id AND k.turn_id = t.turn_id""",
)
def evidence_labels(spark, sf_dir):
    return M.evidence_labels(given(spark, sf_dir, "tiles"), kept(spark, sf_dir)).drop("bottom", "height")


@query(
    "evidence_stride",
    "SELECT conv_id, ordinal FROM (SELECT conv_id, turn AS ordinal, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM {conversations} c) t WHERE n <= 4 OR i = 0 OR i = n - 1 OR i % greatest(1, ceil(n / 4.0)) = 0",
)
def evidence_stride(spark, sf_dir):
    return M.evidence_stride(given(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("ordinal")), most=4)


@query(
    "evidence_selection",
    """WITH RECURSIVE t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, CAST(turn AS int) AS ordinal, CAST((turn * 3 + conv_id) % 15 + 1 AS int) AS tiles, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations),
    f AS (SELECT conv_id, CAST(0 AS bigint) AS i, CAST(0 AS int) AS ordinal, CAST(0 AS int) AS allowed, CAST(20 AS int) AS rest FROM (SELECT DISTINCT conv_id FROM conversations) d
    UNION ALL SELECT t.conv_id, t.i, t.ordinal, CAST(least(t.tiles, greatest(1, least(12, CASE WHEN t.n <= 20 THEN greatest(1, f.rest // (t.n - t.i + 1)) ELSE 1 END)), f.rest) AS int),
    CAST(f.rest - least(t.tiles, greatest(1, least(12, CASE WHEN t.n <= 20 THEN greatest(1, f.rest // (t.n - t.i + 1)) ELSE 1 END)), f.rest) AS int) FROM f JOIN t ON t.conv_id = f.conv_id AND t.i = f.i + 1)
    SELECT conv_id, ordinal, allowed FROM f WHERE i > 0""",
)
def evidence_selection(spark, sf_dir):
    rows = given(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("ordinal"), ((F.col("turn") * 3 + F.col("conv_id")) % 15 + 1).alias("tiles"))
    return M.evidence_selection(rows, most=20)


@query(
    "unmounted_shells",
    "SELECT c.conv_id, count(*) AS detected, count(g.turn) AS visited, count(*) - count(g.turn) AS missed FROM conversations c LEFT JOIN {gaps} g ON g.conv_id = c.conv_id AND g.turn = c.turn GROUP BY c.conv_id",
)
def unmounted_shells(spark, sf_dir):
    return M.unmounted_shells(given(spark, sf_dir, "conversations").withColumnRenamed("turn", "turn_id"), given(spark, sf_dir, "gaps").withColumnRenamed("turn", "turn_id"))


@query(
    "capture_passes",
    "SELECT conv_id, capture_seq AS pass, CAST(max(turn) + 1 AS int) AS steps, count(DISTINCT turn_id) AS captured_turns, bool_or(turn >= 3) AS reached_bottom, max(turn) + 1 >= 320 AS limit_reached, NOT bool_or(turn >= 3) AS warn FROM {captures} c GROUP BY conv_id, capture_seq",
)
def capture_passes(spark, sf_dir):
    rows = given(spark, sf_dir, "captures").select("conv_id", F.col("capture_seq").alias("pass"), (F.col("turn") + 1).cast("int").alias("step"), "turn_id", (F.col("turn") >= 3).alias("at_bottom"))
    return M.capture_passes(rows)


def populated(spark, sf_dir) -> DataFrame:
    """One row a turn with the arrays that summaries count, sized by the turn number."""
    rows = given(spark, sf_dir, "files").withColumn("role", F.when(F.col("role") == "system", "unknown").otherwise(F.col("role")))

    def n(k: int) -> F.Column:
        return F.when(F.col("turn") % k > 0, F.transform(F.sequence(F.lit(1), (F.col("turn") % k).cast("int")), lambda i: i)).otherwise(F.array().cast("array<int>"))

    status = F.when(F.col("href").isNull(), "unresolved").when(F.col("turn") % 4 == 0, "archived").otherwise("not_archived")
    files = F.array(F.struct("href", "kind", "name", status.alias("archive_status")))
    return rows.select("conv_id", "turn", "turn_id", "role", n(3).alias("code_blocks"), n(2).alias("tool_executions"), n(5).alias("activities"), n(4).alias("expandables"), n(6).alias("media"), n(7).alias("links"), files.alias("files"))


@query(
    "summarize_turns",
    """SELECT conv_id, count(*) AS turns, count(*) FILTER (role = 'user') AS user_turns, count(*) FILTER (role = 'assistant') AS assistant_turns, count(*) FILTER (role = 'system') AS unknown_turns,
    CAST(sum(turn % 3) AS bigint) AS code_blocks, CAST(sum(turn % 2) AS bigint) AS terminal_executions, CAST(sum(turn % 2) AS bigint) AS tool_executions, CAST(sum(turn % 5) AS bigint) AS activities, CAST(sum(turn % 4) AS bigint) AS expandables,
    CAST(sum(turn % 6) AS bigint) AS media, count(*) AS linked_files, count(*) FILTER (turn % 4 <> 1) AS resolved_files, count(*) FILTER (turn % 4 = 1) AS ui_attachments, CAST(sum(turn % 7) AS bigint) AS links,
    count(*) FILTER (turn % 2 = 0) AS live_events, count(*) FILTER (turn % 8 = 0) + 1 AS archived_resources, CAST(sum((turn * 3 + conv_id) % 15 + 1) AS bigint) AS visual_snapshots FROM conversations GROUP BY conv_id""",
)
def summarize_turns(spark, sf_dir):
    """Evicted captures count as live events, and every tile as a picture."""
    return M.summarize_turns(populated(spark, sf_dir), given(spark, sf_dir, "captures").filter("source = 'evicted'"), given(spark, sf_dir, "blobs"), given(spark, sf_dir, "tiles"))


@query("completeness", "SELECT conv_id, count(*) FILTER (turn % 4 <> 0) AS unresolved_files, false AS certified_complete FROM conversations GROUP BY conv_id")
def completeness(spark, sf_dir):
    return M.completeness(populated(spark, sf_dir))


def missing_report(spark, sf_dir) -> DataFrame:
    """Per conversation: captures merged and ordered, missing turns and what is there."""
    turns = ordered(spark, sf_dir)
    facts = turns.groupBy("conv_id").agg(F.count("*").alias("turns"), F.count_if(F.col("role") == "user").alias("user_turns"), F.sum(F.length("text")).alias("characters"), F.max("ordinal").alias("last_ordinal"))
    return facts.join(M.turn_continuity(turns).select("conv_id", "missing", "status"), "conv_id")


query(
    "missing_report",
    f"""SELECT conv_id, turns, user_turns, characters, last_ordinal, CASE WHEN len(observed) > 1 THEN list_filter(range(observed[1], observed[-1] + 1), lambda i: NOT list_contains(observed, i)) ELSE [] END AS missing,
    CASE WHEN len(observed) = 0 THEN 'indices_unavailable' WHEN len(observed) > 1 AND len(observed) < observed[-1] - observed[1] + 1 THEN 'gaps_detected' ELSE 'no_internal_gaps_observed' END AS status FROM
    (SELECT conv_id, count(*) AS turns, count(*) FILTER (role = 'user') AS user_turns, CAST(sum(length(text)) AS bigint) AS characters, CAST(max(ordinal) AS int) AS last_ordinal, coalesce(list_sort(list(DISTINCT order_hint) FILTER (order_hint IS NOT NULL)), []) AS observed FROM {ORDERED_SQL} t GROUP BY conv_id) r""",
)(missing_report)
