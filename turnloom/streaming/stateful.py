"""Live streams whose state must be exact: removed turns, pages that change, and the whole chain.

Each is a processor for transformWithState (the state store must be RocksDB, see `with_rocksdb`).
Rows of a key wait in map state until the watermark passes them, and are then taken in order of
(ts, event_id), however the micro-batches mixed them; a timer at the first waiting row wakes the key.
Rows travel, wait and are taken many at a time, as Arrow batches in one cell, since each call of the
state and each row of a processor's input costs far more than a row's own work.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .live import MAX_EVICTED, live_debounce

STORE = "spark.sql.streaming.stateStore.providerClass"
#: Rows of a task that are dealt out to their keys at once, of a key that are sorted at once, of a cell, and of a key that are taken at once.
DEALT, RUN, PIECE, TAKEN = 200_000, 400_000, 4_096, 100_000


def with_rocksdb(spark: SparkSession) -> None:
    """Streams started from here on keep their state in RocksDB, which these processors need. Streams keep the store they began with."""
    spark.conf.set(STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _arrow(columns: str) -> pa.Schema:
    """The schema of waiting rows: us (event time in microseconds), event_id, and the columns."""
    types = {"string": pa.string(), "boolean": pa.bool_()}
    named = [x.split() for x in columns.split(", ")]
    return pa.schema([("us", pa.int64()), ("event_id", pa.int64()), *((n, types[t]) for n, t in named)])


def _cells(rows: pa.Table) -> Iterator[tuple[int, bytes]]:
    """The rows in cells of PIECE rows at most: the first's time, and an Arrow batch without its schema."""
    for lo in range(0, len(rows), PIECE):
        some = rows.slice(lo, PIECE).combine_chunks().to_batches()[0]
        yield some.column(0)[0].as_py(), some.serialize().to_pybytes()


def _table(cells: list[bytes], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_batches([pa.ipc.read_record_batch(pa.py_buffer(c), schema) for c in cells], schema).combine_chunks()


def _in_order(rows: pa.Table) -> pa.Table:
    """By time and event_id (null: last); what shares both, by the other columns."""
    us, ids = rows["us"].to_numpy(), pc.fill_null(rows["event_id"], np.iinfo(np.int64).max).to_numpy()
    order = np.lexsort((ids, us))
    us, ids = us[order], ids[order]
    if ((us[1:] == us[:-1]) & (ids[1:] == ids[:-1])).any():
        return rows.sort_by([(c, "ascending") for c in rows.column_names])
    return rows.take(pa.array(order))


def _codes(column: pa.ChunkedArray) -> tuple[np.ndarray, list]:
    """A number for each value (null is one, too), and the values by number."""
    d = column.combine_chunks().dictionary_encode("encode")
    return d.indices.to_numpy(), d.dictionary.to_pylist()


class InOrder(StatefulProcessor):
    """Takes the rows of a key in order of time. Subclasses say what rows do (`take`) and may drop their state when the key has been silent.

    A row that is older than the watermark up to which its key's rows were taken is late, and left out, unless the key has been forgotten since.
    """

    #: Columns that wait, beside the time and event_id, and the columns of the rows that come out.
    waits: str
    columns: tuple[str, ...]
    silent_ms: int | None = None

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "us long, number long", "rows binary")
        # The timer's time, the last row's time, the watermark up to which rows were taken, and the number of the next cell.
        self.at = handle.getValueState("at", "timer long, seen long, taken long, next long")

    def load(self):
        """The key's own state, for as long as rows are taken."""
        raise NotImplementedError

    def take(self, state, key: tuple, rows: pa.Table, silent: np.ndarray) -> dict[str, object]:
        """The columns that come out for rows in order; `silent` marks those before which the key has been silent for too long."""
        raise NotImplementedError

    def store(self, state) -> None:
        """What `load` gave, with what the rows changed."""

    def drop(self) -> None:
        """Forget everything but the waiting rows."""

    def _wake(self, timer: int | None, ms: int) -> int:
        """The timer's time, so that the key wakes once the watermark has reached `ms`."""
        if timer is not None:
            if timer <= ms:
                return timer
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(ms)
        return ms

    def _wait(self, rows: pa.Table, number: int) -> int:
        for us, cell in _cells(rows):
            self.waiting.updateValue((us, number), (cell,))
            number += 1
        return number

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        schema = _arrow(self.waits)
        timer, seen, taken, number = self.at.get() if self.at.exists() else (None, None, None, 0)
        first, held, n = None, [], 0

        def wait() -> None:
            nonlocal first, number
            run = _table(held, schema)
            if taken is not None:
                run = run.filter(pa.array(run["us"].to_numpy() // 1000 > taken))
            if len(run):
                run = _in_order(run)
                us = run["us"][0].as_py()
                first = us if first is None else min(first, us)
                number = self._wait(run, number)

        for frame in rows:
            for cell, k in zip(frame["rows"], frame["n"], strict=True):
                held.append(cell)
                n += k
                if n >= RUN:
                    wait()
                    held, n = [], 0
        if held:
            wait()
        if first is not None:
            self.at.update((self._wake(timer, first // 1000), seen, taken, number))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        schema, mark = _arrow(self.waits), timerValues.getCurrentWatermarkInMs()
        _, seen, _, number = self.at.get()
        cells = sorted(self.waiting.keys())
        due = [c for c in cells if c[0] // 1000 <= mark]
        rest = cells[len(due)][0] // 1000 if len(due) < len(cells) else None
        state, pending, held = self.load(), schema.empty_table(), []
        for i, cell in enumerate(due):
            held, after = [*held, cell], due[i + 1] if i + 1 < len(due) else None
            if after is not None and len(held) * PIECE < TAKEN:
                continue
            got = _table([self.waiting.getValue(c)[0] for c in held], schema)
            for c in held:
                self.waiting.removeKey(c)
            pending, held = _in_order(pa.concat_tables([pending, got])), []
            us = pending["us"].to_numpy()
            # No later cell has a row before the first of the next one; what shares that time waits for it.
            ready = int(np.searchsorted(us, (mark + 1) * 1000 if after is None else after[0]))
            if not ready:
                continue
            ms = us[:ready] // 1000
            if self.silent_ms is None:
                silent = np.zeros(ready, bool)
            else:
                silent = np.diff(ms, prepend=ms[0] if seen is None else seen) > self.silent_ms
            out = self.take(state, key, pending.slice(0, ready), silent)
            seen, pending = int(ms[-1]), pending.slice(ready)
            if len(out["event_id"]):
                yield pd.DataFrame({c: out[c] for c in self.columns})
        if len(pending):
            number, left = self._wait(pending, number), pending["us"][0].as_py() // 1000
            rest = left if rest is None else min(rest, left)
        self.store(state)
        until = None if self.silent_ms is None or seen is None else seen + self.silent_ms
        if until is not None and until < mark:
            self.drop()
            seen = until = None
        if rest is not None or until is not None:
            timer = self._wake(None, min(x for x in (rest, until and until + 1) if x is not None))
        else:
            timer = None
        if timer is None and seen is None:
            self.at.clear()
        else:
            self.at.update((timer, seen, None if seen is None else mark, number))


class EvictionQueue(InOrder):
    """The `most` turns of a page inserted last. A turn that is seen again keeps its place while it is in; once out, it comes back as the newest."""

    waits = "turn_id string, signature string"
    columns = ("page", "turn_id", "place", "event_id", "signature", "gone", "us")  # noqa: RUF012

    def __init__(self, most: int):
        self.most = most

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.queue = handle.getMapState("queue", "place long", "turn_id string")

    def load(self):
        """The queue as it was, and places by turn, the oldest first."""
        before = {k[0]: v[0] for k, v in self.queue.iterator()}
        return before, {before[place]: place for place in sorted(before)}

    def take(self, state, key, rows, silent):
        _, places = state
        after = max(places.values(), default=-1) + 1  # the newest turn is in
        codes, turns = _codes(rows["turn_id"])
        row, turn_of, place_of, gone = [], [], [], []
        for i, turn in enumerate([turns[c] for c in codes.tolist()]):
            place = places.get(turn)
            row.append(i)
            turn_of.append(turn)
            gone.append(False)
            if place is not None:
                place_of.append(place)
                continue
            places[turn] = after
            place_of.append(after)
            after += 1
            if len(places) > self.most:  # a dict keeps the order in which turns came in
                out = next(iter(places))
                row.append(i)
                turn_of.append(out)
                place_of.append(places.pop(out))
                gone.append(True)
        at = pa.array(row)
        signature = rows["signature"].take(at).to_pandas().to_numpy(object)
        signature[np.array(gone)] = None
        ids = rows["event_id"].take(at).to_pandas(integer_object_nulls=True)
        return {"page": key[0], "turn_id": turn_of, "place": place_of, "event_id": ids, "signature": signature, "gone": gone, "us": rows["us"].take(at).to_numpy()}

    def store(self, state) -> None:
        before, places = state
        now = {place: turn for turn, place in places.items()}
        for place in before.keys() - now.keys():
            self.queue.removeKey((place,))
        for place in now.keys() - before.keys():
            self.queue.updateValue((place,), (now[place],))


def _timed(changes: DataFrame, key: str, columns: str) -> DataFrame:
    """The changes of each key, many to a cell (n rows): key, n, rows. Changes without a time are left out, as no watermark passes them."""
    schema = _arrow(columns)
    rows = changes.filter("ts IS NOT NULL").select(key, F.unix_micros("ts").alias("us"), F.col("event_id").cast("long").alias("event_id"), *schema.names[2:])

    def dealt(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        every = pa.Table.from_batches(held).combine_chunks()
        codes, keys = _codes(every[key])
        order = np.argsort(codes, kind="stable")
        every, ends = every.select(schema.names).cast(schema).take(pa.array(order)), np.cumsum(np.bincount(codes, minlength=len(keys)))
        of, sizes, cells = [], [], []
        for k, (lo, hi) in enumerate(zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)):
            for at, (_, cell) in enumerate(_cells(every.slice(lo, hi - lo))):
                of.append(keys[k])
                sizes.append(min(PIECE, hi - lo - at * PIECE))
                cells.append(cell)
        return pa.RecordBatch.from_arrays([pa.array(of, held[0].schema.field(key).type), pa.array(sizes, pa.int64()), pa.array(cells, pa.binary())], [key, "n", "rows"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= DEALT:
                yield dealt(held)
                held, n = [], 0
        if n:
            yield dealt(held)

    return rows.mapInArrow(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, n long, rows binary")


def stream_evicted(changes: DataFrame, page: str = "page", most: int = MAX_EVICTED) -> DataFrame:
    """What happens to the removed turns of each page, as a log: (page, turn_id, place, event_id, signature, gone, us). `changes` needs a watermark on ts.

    us: microseconds of the change by which the turn was seen, or another took its place.
    """
    out = "page string, turn_id string, place long, event_id long, signature string, gone boolean, us long"
    return _timed(changes, page, EvictionQueue.waits).groupBy(page).transformWithStateInPandas(EvictionQueue(most), outputStructType=out, outputMode="append", timeMode="EventTime")


def evicted_state(log: DataFrame) -> DataFrame:
    """(page, turn_id, place, event_id, signature) of the turns that are in, from the log. A turn's last stay has its largest place, and ends when it is gone."""
    ends = log.groupBy("page", "turn_id").agg(F.max(2 * F.col("place") + F.col("gone").cast("long")).alias("end")).filter("end % 2 = 0")  # numbers only: most of the log is of stays that ended
    stays = ends.select(F.col("page").alias("p"), F.col("turn_id").alias("t"), F.expr("end div 2").alias("place"))
    rows = log.join(stays, (log["page"].eqNullSafe(stays["p"])) & (log["turn_id"].eqNullSafe(stays["t"])) & (log["place"] == stays["place"]), "left_semi")
    latest = rows.groupBy("page", "turn_id").agg(F.max_by(F.struct("place", "event_id", "signature"), F.struct("us", "event_id")).alias("l"))
    return latest.select("page", "turn_id", "l.*")


class Navigation(InOrder):
    """Changed signatures of the turns of the page that a tab shows. Another page, or long silence, drops all that is known of the turns."""

    waits = "page string, turn_id string, signature string, empty boolean"
    columns = ("tab", "page", "turn_id", "event_id", "ts", "signature", "empty")  # noqa: RUF012

    def __init__(self, silent_ms: int | None):
        self.silent_ms = silent_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.page = handle.getValueState("page", "page string")
        self.last = handle.getMapState("last", "turn_id string", "signature string")

    def drop(self) -> None:
        self.page.clear()
        self.last.clear()

    def load(self):
        """The page as a tuple; whether it is another than before; turns whose signature is known here, and those that changed."""
        return {"page": tuple(self.page.get()) if self.page.exists() else None, "fresh": False, "last": {}, "changed": set()}

    def _known(self, state, turn) -> tuple | None:
        """The turn's last signature as a tuple, if it has one on this visit."""
        if turn not in state["last"] and not state["fresh"]:
            got = self.last.getValue((turn,)) if self.last.containsKey((turn,)) else None
            state["last"][turn] = None if got is None else tuple(got)
        return state["last"].get(turn)

    def take(self, state, key, rows, silent):
        (page, pages), (turn, turns), (signature, signatures) = (_codes(rows[c]) for c in ("page", "turn_id", "signature"))
        fresh = silent.copy()
        fresh[1:] |= page[1:] != page[:-1]
        fresh[0] |= state["page"] != (pages[page[0]],)
        visit = np.cumsum(fresh)
        one = visit * len(turns) + turn  # a turn on a visit
        order = np.argsort(one, kind="stable")
        begins = np.diff(one[order], prepend=-1) != 0
        keep = np.empty(len(one), bool)
        keep[order] = begins | (np.diff(signature[order], prepend=-1) != 0)
        for i in order[begins & (visit[order] == 0)].tolist():  # the visit goes on
            keep[i] = self._known(state, turns[turn[i]]) != (signatures[signature[i]],)
        if visit[-1]:
            state |= {"page": (pages[page[-1]],), "fresh": True, "last": {}, "changed": set()}
        ends = order[np.append(begins[1:], True)]
        for i in ends[visit[ends] == visit[-1]].tolist():
            name, value = turns[turn[i]], (signatures[signature[i]],)
            if state["last"].get(name) != value:
                state["last"][name] = value
                state["changed"].add(name)
        out = rows.filter(pa.array(keep)).to_pandas(integer_object_nulls=True)
        return {"tab": key[0], **{c: out[c] for c in self.columns[1:] if c != "ts"}, "ts": out["us"].to_numpy().astype("datetime64[us]")}

    def store(self, state) -> None:
        if state["fresh"]:
            self.last.clear()
            self.page.update(state["page"])
        for turn in state["changed"]:
            self.last.updateValue((turn,), state["last"][turn])


def stream_navigation(changes: DataFrame, tab: str = "tab", page: str = "page", silent: str | None = "1 hour") -> DataFrame:
    """(tab, page, turn_id, event_id, ts, signature, empty): changes that differ from the turn's one before on the same visit of a page.

    The state of a tab is its page and a signature for each of that page's turns; it goes when the page changes, and when the tab has been silent
    for `silent` of event time. `changes` needs a watermark on ts. The session's time zone must be UTC.
    """
    spark = changes.sparkSession
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        raise ValueError("set spark.sql.session.timeZone to UTC: rows that come back from state bear times without a zone")
    out = "tab string, page string, turn_id string, event_id long, ts timestamp, signature string, empty boolean"
    rows = _timed(changes.withColumnRenamed(page, "page"), tab, Navigation.waits)
    silent_ms = None if silent is None else int(pd.Timedelta(silent).total_seconds() * 1000)
    return rows.groupBy(tab).transformWithStateInPandas(Navigation(silent_ms), outputStructType=out, outputMode="append", timeMode="EventTime", eventTimeColumnName="ts")


def navigated(changes: DataFrame, tab: str = "tab", page: str = "page") -> DataFrame:
    """`stream_navigation` of a table: visits are runs of rows of one page in a tab; within them, a turn's changed signatures. Silence is not looked at."""
    from pyspark.sql import Window

    order = Window.partitionBy(tab).orderBy("ts", "event_id")
    fresh = F.when(F.lag(page).over(order) == F.col(page), 0).otherwise(1)
    visits = changes.withColumn("_fresh", fresh).withColumn("_visit", F.sum("_fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    before = F.lag("signature").over(Window.partitionBy(tab, "_visit", "turn_id").orderBy("ts", "event_id"))
    return visits.withColumn("_before", before).filter("NOT (signature <=> _before)").drop("_fresh", "_visit", "_before")


def live_chain(changes: DataFrame, tab: str = "tab", page: str = "page", gap: str = "900 milliseconds", silent: str | None = None) -> DataFrame:
    """The chain of a live page as one stream under one watermark: per visit, changed signatures; those that hold something; of each burst of a turn, the last.

    Two stateful operators in a row, in append mode: the event times of the first are the second's, so a burst comes out when the watermark has passed its end in both.
    """
    kept = stream_navigation(changes, tab, page, silent).filter("NOT empty")
    keyed = kept.withColumn("turn_id", F.concat_ws("#", "tab", "page", "turn_id"))
    return live_debounce(keyed, gap)
