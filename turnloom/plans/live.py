"""Queries of live changes. The stream runs over the events' files to their end, and its written result is read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.urls import navigation_key
from ..shared import new_path
from ..streaming import live as L
from ..streaming import stateful as S
from .catalog import given, query

GAP = "30 minutes"
DEDUPED_SQL = "(SELECT * FROM (SELECT *, lag(signature) OVER (PARTITION BY turn_id ORDER BY ts, event_id) AS before FROM {changes} c) d WHERE before IS NULL OR before <> signature)"


@query(
    "live_debounce",
    """SELECT turn_id, min(ts) AS began, arg_max(event_id, (ts, event_id)) AS event_id, max(ts) AS ts, arg_max(signature, (ts, event_id)) AS signature, arg_max(empty, (ts, event_id)) AS empty, count(*) AS changes FROM
    (SELECT *, sum(fresh) OVER (PARTITION BY turn_id ORDER BY ts, event_id) AS burst FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY turn_id ORDER BY ts, event_id) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM {changes} c) a) b GROUP BY turn_id, burst""",
)
def live_debounce(spark, sf_dir):
    return L.live_debounce(given(spark, sf_dir, "changes"), GAP)


@query("live_dedupe", f"SELECT turn_id, event_id, signature FROM {DEDUPED_SQL} d")
def live_dedupe(spark, sf_dir):
    return L.live_dedupe(given(spark, sf_dir, "changes")).select("turn_id", "event_id", "signature")


@query("live_filter_empty", f"SELECT turn_id, event_id, signature FROM {DEDUPED_SQL} d WHERE NOT empty")
def live_filter_empty(spark, sf_dir):
    return L.live_filter_empty(given(spark, sf_dir, "changes")).select("turn_id", "event_id", "signature")


@query("live_log_cap", f"SELECT turn_id, event_id, signature FROM {DEDUPED_SQL} d WHERE NOT empty ORDER BY ts DESC, event_id DESC LIMIT 1000")
def live_log_cap(spark, sf_dir):
    return L.live_log_cap(L.live_filter_empty(given(spark, sf_dir, "changes"))).select("turn_id", "event_id", "signature")


@query(
    "evicted_cap",
    "SELECT turn_id, event_id, signature FROM (SELECT turn_id, arg_min(event_id, (ts, event_id)) AS event_id, min((ts, event_id)) AS first, arg_max(signature, (ts, event_id)) AS signature FROM {changes} c GROUP BY turn_id) t ORDER BY first DESC LIMIT 600",
)
def evicted_cap(spark, sf_dir):
    return L.evicted_cap(given(spark, sf_dir, "changes"))


FNV = "printf('%08x', CAST(list_reduce(list_transform(string_split({0}, ''), lambda x: CAST(unicode(x) AS bigint)), lambda h, c: (xor(h, c) * 16777619) & 4294967295, CAST(2166136261 AS bigint)) AS bigint))"


@query("live_signature", f"SELECT conv_id, turn, {FNV.format("concat('PRE:::', text, chr(10), 'BUTTON:tool-', turn, ':true:', role)")} AS value FROM conversations")
def live_signature(spark, sf_dir):
    piece = lambda tag, test_id, expanded, text: F.struct(F.lit(tag).alias("tag"), test_id.alias("test_id"), F.lit(expanded).cast("string").alias("expanded"), text.alias("text"))
    none = F.lit(None).cast("string")
    pieces = F.array(piece("pre", none, None, F.col("text")), piece("div", none, None, F.lit("")), piece("button", F.concat(F.lit("tool-"), "turn"), "true", F.col("role")))
    return given(spark, sf_dir, "conversations").select("conv_id", "turn", L.live_signature(pieces).alias("value"))


def tabs(rows: DataFrame) -> DataFrame:
    """Changes with the tab and the page that it shows: a tab goes to another page now and then, and comes back to it."""
    return rows.select(F.concat(F.lit("tab"), F.col("turn_id").cast("long") % 50).alias("tab"), navigation_key(F.concat(F.lit("HTTPS://Chat.example/c/"), F.floor(F.unix_seconds("ts") / 86_400) % 2, F.lit("?tab="), "event_id")).alias("page"), "turn_id", "event_id", "ts", "signature", "empty")


@query(
    "stream_reset_on_navigation",
    """SELECT tab, page, turn_id, event_id FROM (SELECT *, lag(signature) OVER (PARTITION BY tab, visit, turn_id ORDER BY ts, event_id) AS before FROM
    (SELECT *, sum(fresh) OVER (PARTITION BY tab ORDER BY ts, event_id) AS visit FROM (SELECT *, CASE WHEN lag(page) OVER (PARTITION BY tab ORDER BY ts, event_id) = page THEN 0 ELSE 1 END AS fresh FROM
    (SELECT 'tab' || (user_id % 50) AS tab, 'https://chat.example/c/' || CAST(floor(epoch(ts) / 86400) AS bigint) % 2 AS page, CAST(user_id AS varchar) AS turn_id, event_id, ts, event_type AS signature FROM events) a) b) c) d
    WHERE (before IS NULL OR before <> signature) AND epoch_ms(ts) <= (SELECT epoch_ms(max(ts)) - 600000 FROM events)""",
)
def stream_reset_on_navigation(spark, sf_dir):
    """A stream to the end of its input: what the watermark has passed by then has come out."""
    return _written(S.stream_navigation(tabs(changes_stream(spark, sf_dir)), silent=None), "stream-navigation").select("tab", "page", "turn_id", "event_id")


@query("stream_evicted")
def stream_evicted(spark, sf_dir):
    """Removed turns of each tab, at most 2 in: the exact queue, as a stream. A test holds it against a sequential reading."""
    return S.evicted_state(_written(S.stream_evicted(tabs(changes_stream(spark, sf_dir)), "tab", 2), "stream-evicted"))


@query("stream_live_chain")
def stream_live_chain(spark, sf_dir):
    """Changed signatures of a visit that hold something, the last of each burst: one stream with two stateful operators. A test holds it against the batch chain."""
    return _written(S.live_chain(tabs(changes_stream(spark, sf_dir)), gap=GAP), "stream-chain")


def _written(stream: DataFrame, name: str) -> DataFrame:
    """What a stream in append mode gives until its input ends, read back under its schema."""
    to = new_path(stream.sparkSession, name)
    stream.writeStream.outputMode("append").format("parquet").option("path", f"{to}/rows").option("checkpointLocation", f"{to}/state").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{to}/rows")


def changes_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events' files as a stream of changes, with a watermark."""
    S.with_rocksdb(spark)
    path = f"{sf_dir}/events.parquet"
    rows = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path}*")  # a pattern, so that a single file will do
    rows = rows.selectExpr("event_id", "CAST(ts AS timestamp) AS ts", "CAST(user_id AS string) AS turn_id", "event_type AS signature", "event_type = 'view' AS empty", "value AS score")
    return rows.withWatermark("ts", "10 minutes")


@query("stream_merge_captures", "SELECT turn_id, arg_max(event_id, (value, ts, event_id)) AS event_id, arg_max(ts, (value, ts, event_id)) AS ts, max(value) AS score FROM (SELECT CAST(user_id AS string) AS turn_id, event_id, CAST(ts AS timestamp) AS ts, value FROM events) e GROUP BY turn_id")
def stream_merge_captures(spark, sf_dir):
    """A stream in update mode to the end of its input: each micro-batch's updates are written, and the last per turn is its state."""
    to = new_path(spark, "stream-merge")

    def write(df: DataFrame, batch: int) -> None:
        df.withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(f"{to}/rows/part={batch}")  # a batch that runs again replaces its rows

    run = L.running_merge(changes_stream(spark, sf_dir)).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{to}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return L.latest_of_updates(spark.read.parquet(f"{to}/rows").drop("part"))
