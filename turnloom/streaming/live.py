"""Live changes of turns: debounce, drop repeats, cap; as batch expressions and as streams of the same result.

`changes`: turn_id (which includes the conversation: another page is another key), ts (timestamp),
event_id (breaks ties), signature, and `empty` (no activity, code or tool run).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.text import fnv1a32, text_or_empty
from ..functions.urls import navigation_key

#: The debounce, and the caps of the log, of removed turns, and of a signature's pieces.
DEBOUNCE, MAX_EVENTS, MAX_EVICTED, MAX_PIECES, MAX_PIECE = "900 milliseconds", 1_000, 600, 80, 3_000


def live_debounce(changes: DataFrame, gap: str = DEBOUNCE) -> DataFrame:
    """Of each burst of a turn, the last change and the number of changes; a burst ends `gap` after its last change.

    Also a stream's form, under a watermark and in append mode: a burst comes out when the
    watermark passes its end.
    """
    last = F.max_by(F.struct("event_id", "ts", "signature", "empty"), F.struct("ts", "event_id"))
    got = changes.groupBy("turn_id", F.session_window("ts", gap).alias("w")).agg(last.alias("l"), F.count("*").alias("changes"))
    return got.select("turn_id", F.col("w.start").alias("began"), "l.event_id", "l.ts", "l.signature", "l.empty", "changes")


def live_signature(pieces: Column) -> Column:
    """FNV-1a of the first pieces (array of structs tag, test_id, expanded, text) whose text is not empty."""
    some = F.slice(F.filter(pieces, lambda p: text_or_empty(p["text"]) != ""), 1, MAX_PIECES)
    line = lambda p: F.concat(F.upper(p["tag"]), F.lit(":"), text_or_empty(p["test_id"]), F.lit(":"), text_or_empty(p["expanded"]), F.lit(":"), F.substring(p["text"], 1, MAX_PIECE))
    return fnv1a32(F.array_join(F.transform(some, line), "\n"))


def live_dedupe(changes: DataFrame) -> DataFrame:
    """Changes whose signature differs from the turn's one before: A, B, A keeps all three."""
    before = F.lag("signature").over(Window.partitionBy("turn_id").orderBy("ts", "event_id"))
    return changes.withColumn("_before", before).filter("NOT (signature <=> _before)").drop("_before")


def live_filter_empty(changes: DataFrame) -> DataFrame:
    """Deduplicated changes that hold something: an empty one counts as the turn's last signature first."""
    return live_dedupe(changes).filter("NOT empty")


def live_log_cap(changes: DataFrame, most: int = MAX_EVENTS, key: str | None = None) -> DataFrame:
    """The newest `most` changes: of all (a limit, taken per task first), or of each `key`."""
    order = [F.desc("ts"), F.desc("event_id")]
    if key is None:
        return changes.orderBy(*order).limit(most)
    return changes.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("_r") <= most).drop("_r")


def evicted_cap(changes: DataFrame, most: int = MAX_EVICTED) -> DataFrame:
    """The `most` turns inserted last, each with its last snapshot; seeing a turn again keeps its place."""
    first, last = F.min(F.struct("ts", "event_id")), F.max_by("signature", F.struct("ts", "event_id"))
    return changes.groupBy("turn_id").agg(first.alias("first"), last.alias("signature")).orderBy(F.desc("first")).limit(most).select("turn_id", "first.event_id", "signature")


def per_navigation(changes: DataFrame, url: str = "url") -> DataFrame:
    """Changes whose turn_id includes the page's origin and path, so that another page starts with no state."""
    return changes.withColumn("turn_id", F.concat(navigation_key(F.col(url)), F.lit("#"), "turn_id"))


def running_merge(captures: DataFrame) -> DataFrame:
    """The richest capture of each turn so far, the later on ties. As a stream: update mode, a state of one row per turn."""
    best = F.max_by(F.struct("event_id", "ts", "score"), F.struct("score", "ts", "event_id"))
    return captures.groupBy("turn_id").agg(best.alias("b")).select("turn_id", "b.event_id", "b.ts", "b.score")


def stream_dedupe(changes: DataFrame, keep: str = "1 hour") -> DataFrame:
    """`live_dedupe` of a stream: a turn's state is its last signature, dropped when the turn has been silent for `keep`.

    Changes of a micro-batch are taken in order of time; `changes` needs a watermark on `ts`, which
    also tells how long a turn has been silent.
    """
    silent = int(pd.Timedelta(keep).total_seconds() * 1000)
    zone = changes.sparkSession.conf.get("spark.sql.session.timeZone")

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        last = state.get[0] if state.exists else None
        kept = rows["signature"] != rows["signature"].shift(fill_value=last)
        state.update((rows["signature"].iloc[-1],))
        last_ms = int(rows["ts"].iloc[-1].tz_localize(zone, ambiguous=False, nonexistent="shift_forward").timestamp() * 1000)
        state.setTimeoutTimestamp(max(last_ms, state.getCurrentWatermarkMs()) + silent)
        yield rows[kept][["turn_id", "event_id", "ts", "signature", "empty"]]

    return changes.groupBy("turn_id").applyInPandasWithState(run, "turn_id string, event_id long, ts timestamp, signature string, empty boolean", "signature string", "append", GroupStateTimeout.EventTimeTimeout)


def latest_of_updates(written: DataFrame, key: str = "turn_id", batch: str = "batch") -> DataFrame:
    """The state that a stream in update mode has reached, from its batches as written."""
    columns = [c for c in written.columns if c not in (key, batch)]
    return written.groupBy(key).agg(F.max_by(F.struct(*columns), batch).alias("_s")).select(key, "_s.*")
