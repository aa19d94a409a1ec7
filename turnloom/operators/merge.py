"""Merging repeated captures of a turn, ordering turns, and reporting what is missing.

All steps group or window by the conversation, so one shuffle by it serves them in a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import text_or_empty

#: Weights of a capture's parts, and the caps on evidence tiles.
WEIGHTS = {"activities": 600, "media": 400, "files": 250, "expandables": 80}
MARKDOWN_WEIGHT, CODE_WEIGHT = 0.25, 2
MAX_TILES, MAX_TILES_PER_TURN, BOTTOM_MARGIN, MAX_SPAN = 240, 12, 24, 100_000


def snapshot_score(text: Column, markdown: Column, code_texts: Column, activities: Column, media: Column, files: Column, expandables: Column) -> Column:
    """How much a capture holds. `code_texts` is an array of strings, the next four are counts; nulls count as none."""
    code = F.coalesce(F.aggregate(code_texts, F.lit(0).cast("long"), lambda n, t: n + F.length(text_or_empty(t))), F.lit(0))
    counts = zip((activities, media, files, expandables), WEIGHTS.values(), strict=True)
    score = F.length(text_or_empty(text)) + F.length(text_or_empty(markdown)) * MARKDOWN_WEIGHT + code * CODE_WEIGHT
    for n, weight in counts:
        score = score + F.coalesce(n, F.lit(0)) * weight
    return score.cast("double")


def merge_captures(captures: DataFrame, score: Column | str = "score") -> DataFrame:
    """Of each (conv_id, turn_id) the capture of the highest score, the later one on ties, with `first_seq`.

    Rows without a turn_id are no turns. The winner is found on narrow rows; wide ones join back.
    """
    rows = captures.filter("turn_id IS NOT NULL").repartition("conv_id").withColumn("score", F.col(score) if isinstance(score, str) else score)
    w = Window.partitionBy("conv_id", "turn_id")
    ranked = rows.withColumn("_rank", F.row_number().over(w.orderBy(F.desc("score"), F.desc("capture_seq")))).withColumn("first_seq", F.min("capture_seq").over(w))
    return ranked.filter("_rank = 1").drop("_rank")


def with_evicted(captures: DataFrame, evicted: DataFrame, has_content: Column) -> DataFrame:
    """Captures and, where they hold something, snapshots of turns that had left the page."""
    return captures.unionByName(evicted.filter(has_content), allowMissingColumns=True)


def scan_order(turns: DataFrame) -> DataFrame:
    """`scan_order`: 0-based rank of first sight in the conversation."""
    return turns.withColumn("scan_order", F.dense_rank().over(Window.partitionBy("conv_id").orderBy("first_seq", "turn_id")) - 1)


def order_turns(turns: DataFrame) -> DataFrame:
    """`ordinal`, from 1: by order hint; a turn without one follows what was seen before it.

    A total order: the hint or else the last hint seen, turns with a hint first, then scan order, then id.
    """
    seen = Window.partitionBy("conv_id").orderBy("scan_order", "turn_id")
    anchored = turns.withColumn("_anchor", F.coalesce("order_hint", F.last("order_hint", ignorenulls=True).over(seen.rowsBetween(Window.unboundedPreceding, 0))))
    w = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("_anchor"), F.col("order_hint").isNull(), "scan_order", "turn_id")
    return anchored.withColumn("ordinal", F.row_number().over(w)).drop("_anchor")


def turn_continuity(turns: DataFrame) -> DataFrame:
    """Per conversation: hints observed and missing between the first and the last, captured turns, and one of three statuses."""
    hints = F.array_sort(F.collect_set("order_hint"))
    got = turns.groupBy("conv_id").agg(hints.alias("observed"), F.count("*").alias("captured_turns"))
    lo, hi = F.element_at("observed", 1), F.element_at("observed", -1)
    missing = F.when((F.size("observed") > 1) & (hi - lo < MAX_SPAN), F.array_except(F.sequence(lo, hi), "observed")).otherwise(F.array().cast("array<int>"))
    got = got.withColumn("missing", missing)
    status = F.when(F.size("observed") == 0, "indices_unavailable").when(F.size("missing") > 0, "gaps_detected").otherwise("no_internal_gaps_observed")
    return got.withColumn("status", status).withColumn("complete_conversation_verified", F.lit(False)).withColumn("expected_total", F.lit(None).cast("int"))


def continuity_gaps(turns: DataFrame) -> DataFrame:
    """(conv_id, gap_from, gap_to): missing hints as ranges, whatever their span."""
    w = Window.partitionBy("conv_id").orderBy("order_hint")
    rows = turns.filter("order_hint IS NOT NULL").select("conv_id", "order_hint").distinct().withColumn("_next", F.lead("order_hint").over(w))
    return rows.filter("_next - order_hint > 1").select("conv_id", (F.col("order_hint") + 1).alias("gap_from"), (F.col("_next") - 1).alias("gap_to"))


def coverage_warnings(continuity: DataFrame, coverage: DataFrame, turns: DataFrame) -> DataFrame:
    """(conv_id, kind, ordinal, detail): one row for gaps, one for each distinct turn of limited coverage; no ordinal if it was not kept."""
    gaps = continuity.filter(F.size("missing") > 0).select("conv_id", F.lit("gaps").alias("kind"), F.lit(None).cast("int").alias("ordinal"), F.array_join(F.col("missing").cast("array<string>"), ", ").alias("detail"))
    limited = coverage.filter("limited").select("conv_id", "turn_id").distinct().join(turns.select("conv_id", "turn_id", "ordinal"), ["conv_id", "turn_id"], "left")
    return gaps.unionByName(limited.select("conv_id", F.lit("limited").alias("kind"), F.col("ordinal").cast("int").alias("ordinal"), F.col("turn_id").alias("detail")))


def evidence_stride(items: DataFrame, most: int = MAX_TILES) -> DataFrame:
    """Of a conversation with over `most` items: the first, the last, and every ceil(total / most)-th."""
    w = Window.partitionBy("conv_id")
    rows = items.withColumn("_i", F.row_number().over(w.orderBy("ordinal")) - 1).withColumn("_n", F.count("*").over(w))
    stride = F.greatest(F.lit(1), F.ceil(F.col("_n") / most))
    return rows.filter((F.col("_n") <= most) | (F.col("_i") == 0) | (F.col("_i") == F.col("_n") - 1) | (F.col("_i") % stride == 0)).drop("_i", "_n")


def evidence_selection(tiles: DataFrame, most: int = MAX_TILES, per_turn: int = MAX_TILES_PER_TURN) -> DataFrame:
    """`allowed` tiles of each turn (conv_id, ordinal, tiles): a fair share of what earlier turns left, at most `per_turn`.

    Each turn depends on the ones before it: a fold over the conversation's narrow (ordinal, tiles).
    """
    turns = F.array_sort(F.collect_list(F.struct(F.col("ordinal").cast("int").alias("ordinal"), F.col("tiles").cast("int").alias("tiles"))))
    start = F.struct(F.lit(most).alias("left"), F.lit(0).alias("done"), F.array().cast("array<struct<ordinal:int,allowed:int>>").alias("out"))

    def step(acc: Column, t: Column) -> Column:
        turns_left = F.greatest(F.lit(1), F.col("_n") - acc["done"])
        share = F.when(F.col("_n") <= most, F.greatest(F.lit(1), F.floor(acc["left"] / turns_left).cast("int"))).otherwise(1)
        allowed = F.least(t["tiles"], F.greatest(F.lit(1), F.least(F.lit(per_turn), share)), acc["left"]).cast("int")
        return F.struct((acc["left"] - allowed).cast("int").alias("left"), (acc["done"] + 1).alias("done"), F.concat(acc["out"], F.array(F.struct(t["ordinal"].alias("ordinal"), allowed.alias("allowed")))).alias("out"))

    got = tiles.groupBy("conv_id").agg(turns.alias("_t")).withColumn("_n", F.size("_t"))
    return got.select("conv_id", F.explode(F.aggregate("_t", start, step)["out"]).alias("t")).select("conv_id", "t.ordinal", "t.allowed")


def visual_coverage(tiles: DataFrame) -> DataFrame:
    """Per turn: captures, whether the last photographed tile reaches the bottom, limited if not."""
    last = F.max_by(F.struct("bottom", "height"), "tile")
    got = tiles.groupBy("conv_id", "turn_id").agg(F.count("*").alias("captures"), last.alias("_l"))
    reached = F.coalesce(F.col("_l.bottom") <= F.col("_l.height") - BOTTOM_MARGIN, F.lit(False))
    return got.select("conv_id", "turn_id", "captures", reached.alias("reached_bottom"), (~reached).alias("limited"))


def evidence_labels(tiles: DataFrame, turns: DataFrame) -> DataFrame:
    """Tiles under the final ordinal of their turn; the label and ordinal of the capture are kept beside."""
    final = turns.select("conv_id", "turn_id", F.col("ordinal").alias("_o"), F.count("*").over(Window.partitionBy("conv_id")).alias("_n"))
    label = F.format_string("Turno %d de %d · vista %d", F.col("_o").cast("long"), F.col("_n"), F.coalesce(F.nullif(F.col("tile"), F.lit(0)), F.lit(1)).cast("long"))
    rows = tiles.withColumnRenamed("label", "capture_label").withColumnRenamed("turn_ordinal", "capture_turn_ordinal").join(final, ["conv_id", "turn_id"], "left")
    ordinal = F.when(F.col("turn_id").isNull(), F.col("capture_turn_ordinal")).otherwise(F.col("_o"))
    return rows.withColumn("label", F.when(F.col("_o").isNotNull(), label).otherwise(F.col("capture_label"))).withColumn("turn_ordinal", ordinal.cast("int")).drop("_o", "_n")


def unmounted_shells(shells: DataFrame, captures: DataFrame) -> DataFrame:
    """Per conversation: persistent turns detected, and those that never gave a capture."""
    got = shells.select("conv_id", "turn_id").distinct().join(captures.select("conv_id", "turn_id", F.lit(1).alias("_c")).distinct(), ["conv_id", "turn_id"], "left")
    return got.groupBy("conv_id").agg(F.count("*").alias("detected"), F.count("_c").alias("visited"), F.count_if(F.col("_c").isNull()).alias("missed"))


def capture_passes(rows: DataFrame) -> DataFrame:
    """Per pass over a conversation: steps, captured turns, bottom reached, limit reached, and whether to warn."""
    got = rows.groupBy("conv_id", "pass").agg(F.max("step").alias("steps"), F.count_distinct("turn_id").alias("captured_turns"), F.bool_or("at_bottom").alias("reached_bottom"))
    return got.withColumn("limit_reached", F.col("steps") >= 320).withColumn("warn", ~F.col("reached_bottom"))


def summarize_turns(turns: DataFrame, events: DataFrame | None = None, resources: DataFrame | None = None, snapshots: DataFrame | None = None) -> DataFrame:
    """Counts per conversation, from the sizes of each turn's arrays (columns code_blocks, tool_executions, activities, expandables, media, files, links).

    Live events, archived resources and pictures of the screen are rows (with conv_id) of their own frames; without a row or frame they are 0.
    """

    def total(c: str) -> Column:
        return F.sum(F.greatest(F.size(c), F.lit(0))).cast("long")

    def having(f) -> Column:
        return F.sum(F.coalesce(F.size(F.filter("files", f)), F.lit(0))).cast("long")

    out = turns.groupBy("conv_id").agg(
        F.count("*").alias("turns"), *[F.count_if(F.col("role") == r).alias(f"{r}_turns") for r in ("user", "assistant", "unknown")],
        total("code_blocks").alias("code_blocks"), total("tool_executions").alias("terminal_executions"), total("tool_executions").alias("tool_executions"),
        total("activities").alias("activities"), total("expandables").alias("expandables"), total("media").alias("media"), total("files").alias("linked_files"),
        having(lambda f: f["href"].isNotNull() & (f["href"] != "")).alias("resolved_files"),
        having(lambda f: f["kind"].isin("ui_attachment", "generated_artifact")).alias("ui_attachments"), total("links").alias("links"),
    )
    for name, rows in (("live_events", events), ("archived_resources", resources), ("visual_snapshots", snapshots)):
        if rows is not None:
            out = out.join(rows.groupBy("conv_id").agg(F.count("*").alias(name)), "conv_id", "left")
        out = out.withColumn(name, F.coalesce(name, F.lit(0).cast("long")) if rows is not None else F.lit(0).cast("long"))
    return out


def completeness(turns: DataFrame) -> DataFrame:
    """Files without a local copy; completeness is never certified."""
    open_ = F.size(F.filter("files", lambda f: ~f["archive_status"].eqNullSafe(F.lit("archived"))))
    return turns.groupBy("conv_id").agg(F.sum(F.greatest(F.coalesce(open_, F.lit(0)), F.lit(0))).cast("long").alias("unresolved_files")).withColumn("certified_complete", F.lit(False))
