"""Streams with exact state against a reading of the rows one by one."""

from __future__ import annotations

import random
from types import SimpleNamespace

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from turnloom.shared import new_path
from turnloom.streaming import live
from turnloom.streaming import stateful as S

SCHEMA = "tab string, page string, turn_id string, event_id long, ts timestamp, signature string, empty boolean"


def rows_of(n=1500, seed=1):
    rng, t, out = random.Random(seed), 0, []
    page = {"a": 0, "b": 0}
    for i in range(n):
        t += rng.choice([0, 1, 200, 900, 1000, 5000])
        tab = rng.choice("ab")
        if rng.random() < 0.03:
            page[tab] = rng.randint(0, 2)
        out.append((tab, f"p{page[tab]}", f"t{int(rng.expovariate(0.08)) % 60}", i, t, rng.choice("xyz"), rng.random() < 0.2))
    return out


def streamed(spark, rows, f, watermark="30 seconds"):
    """The output of a stream over files in which rows are mixed, but none is later than the watermark allows; a last row closes it."""
    S.with_rocksdb(spark)
    to = new_path(spark, "stream-test")
    frame = lambda r: spark.createDataFrame(r, SCHEMA.replace("ts timestamp", "ts long")).withColumn("ts", F.timestamp_millis("ts")).coalesce(1)
    rng = random.Random(5)
    mixed = sorted(rows, key=lambda r: r[4] + rng.random() * 25_000)
    for at in range(0, len(mixed), 400):
        frame(mixed[at : at + 400]).write.mode("append").parquet(f"{to}/in")
    frame([("end", "end", "end", 10**9, rows[-1][4] + 10**8, "end", True)]).write.mode("append").parquet(f"{to}/in")
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{to}/in").withWatermark("ts", watermark)
    q = f(source).writeStream.outputMode("append").format("parquet").option("path", f"{to}/out").option("checkpointLocation", f"{to}/state").trigger(availableNow=True).start()
    q.awaitTermination(240)
    assert q.exception() is None
    return spark.read.parquet(f"{to}/out"), q


@pytest.fixture(scope="module")
def rows():
    return rows_of()


def test_removed_turns_come_back_as_the_newest(spark, rows):
    log, _ = streamed(spark, rows, lambda s: S.stream_evicted(s, "tab", 20))
    want = {}
    for tab, _, turn, event, _, signature, _ in sorted(rows, key=lambda r: (r[4], r[3])):
        kept = want.setdefault(tab, {})
        kept[turn] = (event, signature)  # a dict keeps the place of a key that is in it
        if len(kept) > 20:
            del kept[next(iter(kept))]
    got = S.evicted_state(log).filter("page <> 'end'").orderBy("page", "place").collect()
    assert [(r.page, r.turn_id, r.event_id, r.signature) for r in got] == [(tab, t, *v) for tab in sorted(want) for t, v in want[tab].items()]


def one_by_one(rows):
    page, last, out = {}, {}, []
    for tab, p, turn, event, ts, signature, empty in sorted(rows, key=lambda r: (r[4], r[3])):
        if page.get(tab) != p:
            page[tab], last[tab] = p, {}
        if last[tab].get(turn) != signature:
            last[tab][turn] = signature
            out.append((tab, p, turn, event, signature, empty, ts))
    return out


def test_another_page_starts_anew_and_state_stays_bounded(spark, rows):
    got, q = streamed(spark, rows, lambda s: S.stream_navigation(s, silent=None))
    want = sorted(r[:6] for r in one_by_one(rows))
    assert sorted((r.tab, r.page, r.turn_id, r.event_id, r.signature, r.empty) for r in got.filter("tab <> 'end'").collect()) == want
    batch = S.navigated(spark.createDataFrame(rows, SCHEMA.replace("ts timestamp", "ts long")))
    assert sorted((r.tab, r.page, r.turn_id, r.event_id, r.signature, r.empty) for r in batch.collect()) == want
    # A tab's state: its page, a timer, and a signature for each turn of the page; at most 60 turns.
    state = max(p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"])
    assert state < 3 * (60 + 8) + 1600 and q.recentProgress[-1]["stateOperators"][0]["numRowsTotal"] <= 3 * (60 + 8)


def test_silent_tabs_are_forgotten(spark, rows):
    got, q = streamed(spark, rows, lambda s: S.stream_navigation(s, silent="10 minutes"))
    assert got.filter("tab <> 'end'").count() == len(one_by_one(rows))  # no tab is silent for as long before the end
    assert q.recentProgress[-1]["stateOperators"][0]["numRowsTotal"] <= 6  # the closing row waits; both tabs are gone
    first, second = rows[:300], [(*r[:4], r[4] + 700_000, *r[5:]) for r in rows[300:600]]  # silence in between
    got, _ = streamed(spark, first + second, lambda s: S.stream_navigation(s, silent="10 minutes"))
    assert got.filter("tab <> 'end'").count() == len(one_by_one(first)) + len(one_by_one(second))


def test_the_chain_equals_the_batch_chain(spark, rows):
    got, _ = streamed(spark, rows, lambda s: S.live_chain(s))
    table = spark.createDataFrame([(r[0], r[1], r[2], r[3], r[6], r[4], r[5]) for r in one_by_one(rows)], "tab string, page string, turn_id string, event_id long, ms long, signature string, empty boolean")
    table = table.withColumn("ts", F.timestamp_millis("ms")).filter("NOT empty").withColumn("turn_id", F.concat_ws("#", "tab", "page", "turn_id"))
    key = lambda df: sorted((r.turn_id, r.event_id, r.signature, r.changes) for r in df.filter("turn_id NOT LIKE 'end%'").collect())
    assert key(got) == key(live.live_debounce(table, "900 milliseconds"))


def at_once(spark, rows, f):
    """The output of a stream over one file, whose times are microseconds; a last row closes it."""
    S.with_rocksdb(spark)
    to = new_path(spark, "stream-test")
    rows = [*rows, ("end", "end", "end", 10**9, rows[-1][4] + 10**11, "end", True)]
    spark.createDataFrame(rows, SCHEMA.replace("ts timestamp", "ts long")).withColumn("ts", F.timestamp_micros("ts")).coalesce(1).write.parquet(f"{to}/in")
    q = f(spark.readStream.schema(SCHEMA).parquet(f"{to}/in").withWatermark("ts", "30 seconds")).writeStream.outputMode("append").format("parquet").option("path", f"{to}/out").option("checkpointLocation", f"{to}/state").trigger(availableNow=True).start()
    q.awaitTermination(240)
    assert q.exception() is None
    return spark.read.parquet(f"{to}/out"), q


def backwards(n):
    """Rows whose event_id falls as time goes on, three to a millisecond."""
    return [("a", f"p{i // 500}", f"t{i * 7 % 11}", 10**6 - i, 10**12 + i * 333, "xyz"[i * i % 3], False) for i in range(n)]


def test_many_rows_of_a_tab_wait_in_few_rows_of_state_and_go_by_time(spark):
    rows = backwards(2000)
    got, q = at_once(spark, rows, lambda s: S.stream_navigation(s, silent=None))
    assert sorted((r.tab, r.page, r.turn_id, r.event_id, r.signature, r.empty) for r in got.collect()) == sorted(r[:6] for r in one_by_one(rows))
    assert [r.us for r in got.orderBy("ts").select(F.unix_micros("ts").alias("us")).limit(3).collect()] == [r[6] for r in one_by_one(rows)[:3]]
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]) < 100


class Handle:
    """The state of one key and its timers, in dicts."""

    def __init__(self):
        self.timers = set()
        self.registerTimer, self.deleteTimer = self.timers.add, self.timers.discard

    def getMapState(self, *_):  # noqa: N802
        d = {}
        return SimpleNamespace(updateValue=d.__setitem__, getValue=d.get, containsKey=d.__contains__, removeKey=d.pop, keys=lambda: iter(list(d)), iterator=lambda: iter(list(d.items())), clear=d.clear)

    def getValueState(self, *_):  # noqa: N802
        v = []
        return SimpleNamespace(exists=lambda: bool(v), get=lambda: v[0], update=lambda x: v.__setitem__(slice(None), [x]), clear=v.clear)


@pytest.mark.parametrize("silent_ms", [None, 5000])
def test_rows_are_taken_in_steps_across_sorted_runs(monkeypatch, silent_ms):
    """Cells of 7 rows, in runs of 50 that overlap, taken 20 at a time, while the watermark goes on: as one by one."""
    for name, n in (("PIECE", 7), ("RUN", 50), ("TAKEN", 20)):
        monkeypatch.setattr(S, name, n)
    rows, rng = [r for r in rows_of(3000, 3) if r[0] == "a"], random.Random(4)
    rows = [(*r[:4], r[4] * 1000 + rng.randrange(1000), *r[5:]) for r in rows]
    ordered = sorted(rows, key=lambda r: (r[4], r[3]))
    mixed, got = sorted(rows, key=lambda r: r[4] + rng.random() * 25_000_000), []
    nav, handle = S.Navigation(silent_ms), Handle()
    nav.init(handle)
    for at in range(0, len(mixed), 400):
        some = mixed[at : at + 400] + ([mixed[0]] if at and silent_ms is None else [])  # the first row once more, too late
        table = pa.table(list(zip(*((r[4], r[3], r[1], r[2], r[5], r[6]) for r in some), strict=True)), schema=S._arrow(nav.waits))
        cells = [c for _, c in S._cells(table)]
        frame = pd.DataFrame({"n": [min(7, len(table) - 7 * i) for i in range(len(cells))], "rows": cells})
        assert not list(nav.handleInputRows(("a",), iter([frame[:9], frame[9:]]), None))
        mark = rows[-1][4] if at + 400 >= len(mixed) else max(r[4] for r in mixed[: at + 400]) // 1000 - 30_000
        for due in [t for t in sorted(handle.timers) if t <= mark]:
            got += list(nav.handleExpiredTimer(("a",), SimpleNamespace(getCurrentWatermarkInMs=lambda mark=mark: mark), None))
            handle.timers.discard(due)
    seen = [] if silent_ms is None else [i for i in range(1, len(ordered)) if ordered[i][4] // 1000 - ordered[i - 1][4] // 1000 > silent_ms]
    parts = [ordered[i:j] for i, j in zip([0, *seen], [*seen, len(ordered)], strict=True)]
    want = [(r[0], r[1], r[2], r[3], r[6] // 1000, r[6] % 1000, r[4], r[5]) for part in parts for r in one_by_one(part)]
    out = pd.concat(got)
    assert len(got) > 20 and [(r.tab, r.page, r.turn_id, r.event_id, r.ts.value // 10**6, r.ts.value // 1000 % 1000, r.signature, r.empty) for r in out.itertuples()] == want


def test_removed_turns_go_by_time_whatever_their_event_ids(spark):
    rows, kept = backwards(2000), {}
    log, q = at_once(spark, rows, lambda s: S.stream_evicted(s, "tab", 4))
    for _, _, turn, event, _, signature, _ in rows:
        kept[turn] = (event, signature)
        if len(kept) > 4:
            del kept[next(iter(kept))]
    assert [(r.turn_id, r.event_id, r.signature) for r in S.evicted_state(log).orderBy("place").collect()] == [(t, *v) for t, v in kept.items()]
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]) < 100


def test_the_chain_keeps_microseconds(spark):
    rows = [r for r in backwards(1200) if int(r[2][1:]) < 5]
    got, q = at_once(spark, rows, lambda s: S.live_chain(s, gap="2 milliseconds"))
    table = spark.createDataFrame([(r[0], r[1], r[2], r[3], r[6], r[4], r[5]) for r in one_by_one(rows)], "tab string, page string, turn_id string, event_id long, us long, signature string, empty boolean")
    table = table.withColumn("ts", F.timestamp_micros("us")).withColumn("turn_id", F.concat_ws("#", "tab", "page", "turn_id"))
    key = lambda df: sorted((r.turn_id, r.event_id, r.ts, r.signature, r.changes) for r in df.collect())
    assert key(got) == key(live.live_debounce(table, "2 milliseconds")) and got.count() > 100
    assert max(p["stateOperators"][-1]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]) < 100
