"""Sums over the subtrees of a forest by time-forward processing.

A node has a key (c, d, p) and, unless it is a top, its parent's key, which is smaller: in d, and in
the order of keys. The order of keys cuts the forest into shards. Within a shard, nodes come sorted
in reverse level order (greatest d first, by Spark's external sort), and each sends its totals to its
parent through a priority queue that spills, so that a node finds what its children sent at the head.
A node whose parent lies in another shard is a shard root. Roots of one shard under one parent are
one node of a smaller forest, which has its sums found the same way; what it finds goes to the
parents, and a second pass through the shards adds it on the way up.

Memory of a task: the queue's bound, and an entry for each node of its shard that is a parent of nodes elsewhere.
"""

from __future__ import annotations

import heapq
import pickle
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

MOST = 500_000  # entries of a queue in memory
DIGITS = 1 << 20  # shards of one level, which a contracted node's p tells apart
LEVELS = 3  # of forests of shard roots that are sharded again; the next one is a single shard
KEY, UP = ("c", "d", "p"), ("uc", "ud", "up")


class SpillingQueue:
    """Tuples in ascending order; beyond `most` of them, sorted runs in temporary files that are read back as they are needed."""

    def __init__(self, most: int = MOST):
        self.most, self.heap, self.runs, self.heads = most, [], [], []

    def push(self, item: tuple) -> None:
        heapq.heappush(self.heap, item)
        if len(self.heap) > self.most:
            self._spill()

    def _spill(self) -> None:
        self.heap.sort()
        f = tempfile.TemporaryFile()
        for at in range(0, len(self.heap), 1000):
            pickle.dump(self.heap[at : at + 1000], f, pickle.HIGHEST_PROTOCOL)
        f.seek(0)
        self.heap = []
        self.runs.append(self._read(f))
        self._next(len(self.runs) - 1)

    @staticmethod
    def _read(f) -> Iterator[tuple]:
        with f:
            while True:
                try:
                    yield from pickle.load(f)
                except EOFError:
                    return

    def _next(self, k: int) -> None:
        if (item := next(self.runs[k], None)) is not None:
            heapq.heappush(self.heads, (item, k))

    def peek(self) -> tuple | None:
        if self.heads and (not self.heap or self.heads[0][0] < self.heap[0]):
            return self.heads[0][0]
        return self.heap[0] if self.heap else None

    def pop(self) -> tuple:
        if self.heads and (not self.heap or self.heads[0][0] < self.heap[0]):
            item, k = heapq.heappop(self.heads)
            self._next(k)
            return item
        return heapq.heappop(self.heap)


def _swept(rows: Iterator[tuple], most: int, totals: bool) -> Iterator[tuple]:
    """Rows (shard, d, c, p, given, ud, uc, up, cross, v, w) of whole shards in reverse level order, `given` ones (a sum from elsewhere, or a mark) before their node.

    With `totals`, (0, shard, c, d, p, None, None, None, v, w) of each node. Otherwise (1, shard, parent's key, None, None, None, v, w) of each shard
    root, and (2, shard, a mark's key, its root's parent's key or nulls, 0, 0) of each mark.
    """
    queue, shard, same, found = SpillingQueue(most), None, {}, {}

    def told() -> Iterator[tuple]:
        for m in same:
            top = m
            while same[top] != top:
                top = same[top]
            yield (2, shard, *m, *found[top], 0, 0)

    for now, d, c, p, given, ud, uc, up, cross, v, w in rows:
        if now != shard:
            yield from told()
            queue, shard, same, found = SpillingQueue(most), now, {}, {}
        key = (-d, -c, -p)
        if given:
            if not totals:
                same[c, d, p] = (c, d, p)
            queue.push((*key, v, w, (c, d, p)))
            continue
        mark = None
        while (head := queue.peek()) is not None and head[:3] == key:
            *_, more_v, more_w, other = queue.pop()
            v, w = v + more_v, w + more_w
            if not totals and other:
                if mark:
                    same[other] = mark  # both have the same root from here on
                else:
                    mark = other
        if totals:
            yield (0, shard, c, d, p, None, None, None, v, w)
        if ud is None or cross:
            if mark:
                found[mark] = (uc, ud, up)
            if cross and not totals:
                yield (1, shard, uc, ud, up, None, None, None, v, w)
        else:
            queue.push((-ud, -uc, -up, v, w, mark or ()))
    yield from told()


OUT = "kind int, shard int, c long, d long, p long, uc long, ud long, up long, v long, w long"


def _sweep(nodes: DataFrame, given: DataFrame, n: int, most: int, totals: bool) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(OUT))
    columns = ("shard", "d", "c", "p", "given", "ud", "uc", "up", "cross", "v", "w")
    none = {k: F.lit(None).cast("long") for k in UP}
    both = nodes.withColumn("given", F.lit(0)).select(*columns).unionByName(given.withColumns({**none, "given": F.lit(1), "cross": F.lit(False)}).select(*columns))
    order = (F.col("shard"), F.col("d").desc(), F.col("c").desc(), F.col("p").desc(), F.col("given").desc())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(b.column(k).to_pylist() for k in range(len(columns))), strict=True))
        out = []
        for r in _swept(rows, most, totals):
            out.append(r)
            if len(out) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)

    return both.repartitionById(n, F.col("shard")).sortWithinPartitions(*order).mapInArrow(run, OUT)


def _struct(*names: str) -> Column:
    return F.struct(*[F.col(k).alias(a) for k, a in zip(names, "abc", strict=True)])


def subtree_sums(forest: DataFrame, shards: int | None = None, most: int = MOST, level: int = 0) -> DataFrame:
    """(c, d, p, v, w): the sums of v and of w over each node's subtree, itself included.

    `forest`: c, d, p, uc, ud, up, v, w (longs, no other columns); a top has null uc, ud, up. Keys are distinct, every
    named parent is there, ud < d, and (uc, ud, up) < (c, d, p). An empty forest gives no rows.
    """
    spark = forest.sparkSession
    n = 1 if level > LEVELS else shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialise(forest.repartitionByRange(n, *KEY).withColumn("shard", F.spark_partition_id()), "forest")
    firsts = sorted(ranged.groupBy("shard").agg(F.min(_struct(*KEY)).alias("k")).collect())  # a row per shard
    if not firsts:
        return forest.select(*KEY, "v", "w")
    keys = F.array(*[F.struct(*[F.lit(x).cast("long").alias(a) for x, a in zip(r["k"], "abc", strict=True)]) for r in firsts])
    ids = F.array(*[F.lit(r["shard"]) for r in firsts])
    own = F.element_at(keys, F.array_position(ids, F.col("shard")).cast("int"))
    nodes = ranged.withColumn("cross", F.coalesce(_struct(*UP) < own, F.lit(False)) & F.col("ud").isNotNull())
    shard_of = lambda k: F.element_at(ids, F.size(F.filter(keys, lambda x: x <= k)))
    away = nodes.filter("cross").select(*[F.col(u).alias(k) for u, k in zip(UP, KEY, strict=True)]).distinct()
    given = away.withColumns({"shard": shard_of(_struct(*KEY)), "v": F.lit(0).cast("long"), "w": F.lit(0).cast("long")})
    if len(firsts) > 1:
        swept = materialise(_sweep(nodes, given, n, most, False), "shard-roots")
        roots = swept.filter("kind = 1").groupBy("shard", *KEY).agg(F.sum("v").alias("v"), F.sum("w").alias("w"))
        marks = swept.filter("kind = 2").select(*KEY, F.col("shard").alias("at"), *UP)
        named = lambda p, shard: F.col(p) * DIGITS + F.col(shard)
        smaller = roots.join(marks, list(KEY)).select("c", "d", named("p", "shard").alias("p"), "uc", "ud", F.when(F.col("ud").isNotNull(), named("up", "at")).alias("up"), "v", "w")
        got = subtree_sums(materialise(smaller, "contracted"), max(1, n // 4), most, level + 1)
        sums = got.groupBy("c", "d", F.floor(F.col("p") / DIGITS).cast("long").alias("p")).agg(F.sum("v").alias("v"), F.sum("w").alias("w"))
        given = sums.withColumn("shard", shard_of(_struct(*KEY)))
    return _sweep(nodes, given, n, most, True).select(*KEY, "v", "w")
