"""Scoring texts by context-tree weighting over bytes, learnt from the whole corpus.

A byte is eight binary decisions, each at a node (the bits before it) of each context of 0 to DEPTH
bytes. A context's node has Krichevsky-Trofimov estimates from the training counts, and the tree
mixes all depths: weighted = (own + product of the longer contexts' weighted) / 2. The chance of a
byte given DEPTH bytes before it follows from the counts alone, so it is computed once for each
distinct run of DEPTH + 1 bytes, also for runs that training lacks.

Jobs: every task counts the words (by their 64-bit hash) and runs of its chunk of documents. Those
that fall into the same group are one row of a chunk, packed; a run's group follows from its last
three context bytes, so a group has whole subtrees of the tree. FAN chunks' rows of a group are
summed to one, FAN of these to one again, up to the corpus, with more groups at each step, so a row
stays small however large the corpus or hot a group is. The top rows are weighed group by group;
the levels above are summed by context and node, the two top levels (at most 256 x 255 nodes) on
the driver. Counts and chances then go down the way they came: each row gets those of its own words
and runs from the one row that it was summed into, until each chunk has its own and is scored.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from math import log, pi

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, new_path, read_file, small_batches, write_file

DEPTH, CHUNK_BYTES, BLOCK_BYTES = 5, 8 << 20, 1 << 20
FAN = 128  # rows of a group that are summed to one
GROUP_BITS, MORE_BITS = 10, 3  # groups of a chunk and of the first sums, and how many times more (both powers of two) at each further step
TOP = 3  # context bytes that decide a run's group
RUNS, WORDS, TEXTS = 0, 1, 2  # kinds of rows
LOG_PI = log(pi)


def log_gamma_half(n: np.ndarray) -> np.ndarray:
    """log gamma(n + 1/2) of whole numbers."""
    return _log_gamma(n + 0.5)


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """log gamma for x >= 1/2, by Stirling's series after a shift to x + 8."""
    shift = np.zeros_like(x)
    for k in range(8):
        shift += np.log(x + k)
    z = x + 8
    return (z - 0.5) * np.log(z) - z + 0.5 * log(2 * pi) + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - shift


def log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov block probability of a zeros and b ones."""
    return log_gamma_half(a) + log_gamma_half(b) - _log_gamma(a + b + 1.0) - LOG_PI


class Level:
    """Distinct (context of `depth` bytes, byte) rows with their counts, and the eight binary nodes of each."""

    def __init__(self, rows: np.ndarray, counts: np.ndarray):
        self.rows = rows  # the context, latest byte highest, then the byte; ascending
        self.node, self.zeros, self.ones, self.first = [], [], [], []
        for k in range(8):
            prefix = rows >> np.uint64(8 - k)
            starts = np.flatnonzero(np.r_[True, prefix[1:] != prefix[:-1]])
            bit = (rows >> np.uint64(7 - k)) & np.uint64(1) == 1
            self.first.append(starts)
            self.node.append(np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(rows)])))
            self.ones.append(np.add.reduceat(np.where(bit, counts, 0.0), starts))
            self.zeros.append(np.add.reduceat(np.where(bit, 0.0, counts), starts))


def weigh(rows: np.ndarray, counts: np.ndarray, depth: int, least: int) -> tuple[Level, list[np.ndarray], np.ndarray]:
    """(the level of contexts of `least` bytes, log weighted of its nodes per bit, chances per row and bit).

    `rows` are distinct contexts of `depth` bytes with a byte, ascending; the chances mix depths `least` to `depth`.
    """
    level = Level(rows, counts)
    weighted = [log_kt(z, o) for z, o in zip(level.zeros, level.ones, strict=True)]
    bit = [(rows >> np.uint64(7 - k)) & np.uint64(1) == 1 for k in range(8)]
    chance = np.stack([(np.where(b, o[g], z[g]) + 0.5) / (z[g] + o[g] + 1) for b, z, o, g in zip(bit, level.zeros, level.ones, level.node, strict=True)])
    of = np.arange(len(rows))  # each given row's row of the level
    for d in range(depth - 1, least - 1, -1):
        shorter = (level.rows >> np.uint64(16) << np.uint64(8)) | (level.rows & np.uint64(255))  # without the oldest byte
        up, inverse = np.unique(shorter, return_inverse=True)
        low = Level(up, np.bincount(inverse, counts, len(up)))
        counts = np.bincount(inverse, counts, len(up))
        of = inverse[of]
        new = []
        for k in range(8):
            own = log_kt(low.zeros[k], low.ones[k])
            longer = np.bincount(low.node[k][inverse[level.first[k]]], weighted[k], len(own))
            new.append(np.logaddexp(own, longer) - log(2))
            share = 1 / (1 + np.exp(np.clip(longer - own, -700, 700)))
            g = low.node[k][of]
            kt = (np.where(bit[k], low.ones[k][g], low.zeros[k][g]) + 0.5) / (low.zeros[k][g] + low.ones[k][g] + 1)
            chance[k] = share[g] * kt + (1 - share[g]) * chance[k]
        level, weighted = low, new
    return level, weighted, chance


def runs(body: bytes, depth: int = DEPTH) -> np.ndarray:
    """Of each byte of `body` after its first `depth`: the bytes before it, latest highest, then itself, as one number."""
    a = np.frombuffer(body, np.uint8).astype(np.uint64)
    n = len(a) - depth
    out = a[depth:].copy()
    for d in range(1, depth + 1):
        out |= a[depth - d : depth - d + n] << np.uint64(8 * (depth - d + 1))
    return out


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def body(w: list[bytes], depth: int = DEPTH) -> bytes:
    """A text as it is scored: its words parted by a space, a line feed as its end, line feeds before it."""
    return b"\n" * depth + b" ".join(w) + b"\n"


COUNTED = "kind int, group int, id long, keys binary, counts binary"


def packed(a: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a).tobytes())


def unpacked(b: bytes, kind: str) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(b), kind)


def bits_of(step: int) -> int:
    """Bits of the groups after `step` sums; chunks are step 0."""
    return GROUP_BITS + MORE_BITS * max(0, step - 1)


def placed(kind: int, keys: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, place): the order of ascending keys by place, then key, and the places in it; a group is the highest bits of a place (32 bits)."""
    if kind == WORDS:  # hashes already
        return np.arange(len(keys)), keys >> np.uint64(32)
    context = keys >> np.uint64(8 * (depth + 1 - TOP))
    firsts = np.flatnonzero(np.r_[True, context[1:] != context[:-1]]) if len(keys) else np.zeros(0, int)
    size, place = np.diff(np.r_[firsts, len(keys)]), (context[firsts] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
    by = np.argsort(place, kind="stable")
    firsts, size = firsts[by], size[by]
    return np.repeat(firsts - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(len(keys)), np.repeat(place[by], size)


def grouped(kind: int, keys: np.ndarray, counts: np.ndarray, depth: int, bits: int) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """(groups, keys of each, counts of each) of ascending keys."""
    order, place = placed(kind, keys, depth)
    group = (place >> np.uint64(32 - bits)).astype(np.int64)
    firsts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else np.zeros(0, int)
    if not len(firsts):
        return group, [], []
    return group[firsts], np.split(keys[order], firsts[1:]), np.split(counts[order], firsts[1:])


def hashed(names: list[bytes]) -> np.ndarray:
    """64-bit hashes of words: among a billion words, the chance that any two share one is 1 in 37."""
    from xxhash import xxh64_intdigest

    return np.fromiter(map(xxh64_intdigest, names), np.uint64, len(names))


def count(docs: DataFrame, key: str = "doc_id", text: str = "text", depth: int = DEPTH) -> DataFrame:
    """COUNTED rows of every chunk (id): the counts in training of its words and of its runs, and where its documents lie (keys of the kind TEXTS: a path).

    Training: documents whose crc32(id as text) mod 10 is not 0; a null id is in training. A
    document's end is the word of one line feed. Written once, so chunks stay as they are whatever
    is computed again; a task that runs twice leaves files that no row names.
    """
    spark = docs.sparkSession
    small_batches(spark, 500, 8 << 20)
    to = new_path(spark, "chunks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        part, nth = TaskContext.get().partitionId(), 0
        rows: tuple[list, list, list] = ([], [], [])
        size, met, uniques = 0, Counter(), []
        types = [("kind", pa.int32()), ("group", pa.int32()), ("id", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())]

        def out() -> Iterator[pa.RecordBatch]:
            nonlocal nth, rows, size, met, uniques
            chunk = (part << 24) + nth
            table = pa.table({"doc_id": pa.array(rows[0], pa.int64()), "held": pa.array(rows[1], pa.bool_()), "text": pa.array(rows[2], pa.large_binary())})
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema) as w:
                w.write_table(table)
            path = write_file(f"{to}/{part:06d}-{nth:05d}-{uuid.uuid4().hex}.zst", zstandard.ZstdCompressor(level=1).compress(sink.getvalue().to_pybytes()))
            yield batch(TEXTS, chunk, np.zeros(1, int), [path.encode()], [None])
            words_, at = np.unique(hashed(list(met)), return_inverse=True)
            yield batch(WORDS, chunk, *of(WORDS, words_, np.bincount(at, list(met.values()), len(words_)).astype(np.int64)))
            every, at = np.unique(np.concatenate([u for u, _ in uniques]), return_inverse=True)
            yield batch(RUNS, chunk, *of(RUNS, every, np.bincount(at, np.concatenate([c for _, c in uniques])).astype(np.int64)))
            nth, rows, size, met, uniques = nth + 1, ([], [], []), 0, Counter(), []

        def of(kind: int, keys: np.ndarray, counts: np.ndarray) -> tuple:
            groups, k, c = grouped(kind, keys, counts, depth, bits_of(0))
            return groups, [packed(x) for x in k], [packed(x) for x in c]

        def batch(kind: int, chunk: int, groups: np.ndarray, keys: list, counts: list) -> pa.RecordBatch:
            n = len(groups)
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, (_, t) in zip((np.full(n, kind), groups, np.full(n, chunk), keys, counts), types, strict=True)], schema=pa.schema(types))

        def add_runs(bodies: list[bytes], train: bool) -> None:
            if bodies:
                u, c = np.unique(np.concatenate([runs(b, depth) for b in bodies]), return_counts=True)
                uniques.append((u, c * train))

        for b in batches:
            bodies, seen = {True: [], False: []}, 0
            for k, held, t in zip(*(c.to_pylist() for c in b.columns), strict=True):
                w = words(t)
                for column, x in zip(rows, (k, held, b" ".join(w)), strict=True):
                    column.append(x)
                if held:
                    met.update(dict.fromkeys(w, 0))
                    met.setdefault(b"\n", 0)
                else:
                    met.update(w)
                    met[b"\n"] += 1
                bodies[not held].append(body(w, depth))
                seen += len(bodies[not held][-1])
                if seen >= BLOCK_BYTES:
                    for train in (True, False):
                        add_runs(bodies[train], train)
                    size, bodies, seen = size + seen, {True: [], False: []}, 0
            for train in (True, False):
                add_runs(bodies[train], train)
            size += seen
            if size >= CHUNK_BYTES:
                yield from out()
        if rows[0]:
            yield from out()

    held = F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 10 == 0, F.lit(False))
    return materialise(docs.select(F.col(key).cast("long"), held, F.col(text)).mapInArrow(run, COUNTED), "counted")


SUMMED = "kind int, group int, id long, size long, known long, total long, keys binary, counts binary"


def _parent(parts: int) -> Column:
    return F.pmod(F.xxhash64("id"), F.lit(parts)).cast("long")


def sums(counted: DataFrame, chunks: int, depth: int = DEPTH) -> list[tuple[DataFrame, int]]:
    """The tables of each step with the number of ids they are summed into: the chunks first; the last has a row for each kind and group.

    size: distinct keys of a row, known: those with a count, total: sum of the counts.
    """
    def adder(bits: int):
        def add(rows: pa.Table) -> pa.Table:
            kind, parent = rows["kind"][0].as_py(), rows["id"][0].as_py()
            keys, inverse = np.unique(np.concatenate([unpacked(b, "<u8") for b in rows["keys"].to_pylist()]), return_inverse=True)
            counts = np.bincount(inverse, np.concatenate([unpacked(b, "<i8") for b in rows["counts"].to_pylist()])).astype(np.int64)
            groups, keys, counts = grouped(kind, keys, counts, depth, bits)
            m = len(groups)
            return pa.table({
                "kind": pa.array(np.full(m, kind), pa.int32()), "group": pa.array(groups, pa.int32()), "id": pa.array(np.full(m, parent), pa.int64()), "size": pa.array(list(map(len, keys)), pa.int64()),
                "known": pa.array([int((c > 0).sum()) for c in counts], pa.int64()), "total": pa.array([int(c.sum()) for c in counts], pa.int64()), "keys": [packed(k) for k in keys], "counts": [packed(c) for c in counts],
            })

        return add

    steps, at, parts = [], counted.filter(F.col("kind") != TEXTS), chunks
    while parts != 1 or not steps:
        parts = max(1, -(-parts // FAN))
        steps.append((at, parts))
        children = at.select("kind", "group", _parent(parts).alias("id"), "keys", "counts")
        at = materialise(children.groupBy("kind", "group", "id").applyInArrow(adder(bits_of(len(steps))), SUMMED), "sums")
    return [*steps, (at, 0)]


def chances(top: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(group, keys, lp): log10 of the chance of each run's last byte after the others, for the rows of runs of the last sums.

    Runs are weighed twice, for the levels above and for themselves: that takes less than to keep eight numbers for each.
    """
    spark = top.sparkSession
    facts = top.agg(F.sum("size").alias("n"), F.count("*").alias("rows")).first()
    tasks = max(1, min(int(facts["rows"]), 16 + int(facts["n"] or 0) // 200_000, 20_000))
    top = top.select("group", "keys", "counts").repartition(tasks, "group")
    code = "group int, context int, node int"  # a node of a context of two bytes

    def nodes(rows: np.ndarray, k: int) -> np.ndarray:
        return (np.uint64(1 << k) | ((rows & np.uint64(255)) >> np.uint64(8 - k))).astype(np.int64)

    def subtrees(keys: bytes, counts: bytes) -> tuple[np.ndarray, Level, list[np.ndarray], np.ndarray]:
        r, n = unpacked(keys, "<u8"), unpacked(counts, "<i8").astype(np.float64)
        order = np.argsort(r)
        return r[order], *weigh(r[order], n[order], depth, TOP)

    def summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for group, keys, counts in zip(*(c.to_pylist() for c in b.columns), strict=True):
                _, level, weighted, _ = subtrees(keys, counts)
                for k in range(8):
                    first = level.rows[level.first[k]]
                    at = (first >> np.uint64(16)).astype(np.int64) * 256 + nodes(first, k)
                    kept, inverse = np.unique(at, return_inverse=True)
                    w, z, o = (np.bincount(inverse, x) for x in (weighted[k], level.zeros[k], level.ones[k]))
                    yield pa.RecordBatch.from_pydict({"group": np.full(len(kept), group, np.int32), "context": (kept // 256).astype(np.int32), "node": (kept % 256).astype(np.int32), "w": w, "z": z, "o": o})

    parts = materialise(top.mapInArrow(summary, f"{code}, w double, z double, o double"), "nodes")
    two = parts.groupBy("context", "node").agg(*[F.sum(c).alias(c) for c in "wzo"])

    def mixed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            w, z, o = (b.column(c).to_numpy() for c in "wzo")
            own = log_kt(z, o)
            share = 1 / (1 + np.exp(np.clip(w - own, -700, 700)))
            yield pa.RecordBatch.from_pydict({"context": b.column("context"), "node": b.column("node"), "z": z, "o": o, "share": share, "up": np.logaddexp(own, w) - log(2)})

    two = materialise(two.mapInArrow(mixed, "context int, node int, z double, o double, share double, up double"), "contexts")
    last = F.shiftright("context", 8).alias("last")
    got = two.groupBy(last, "node").agg(F.sum("up").alias("w"), F.sum("z").alias("z"), F.sum("o").alias("o")).collect()  # 256 x 255 rows at most
    w, z, o = (np.zeros((256, 256)) for _ in range(3))
    for x in got:
        w[x["last"], x["node"]], z[x["last"], x["node"]], o[x["last"], x["node"]] = x["w"], x["z"], x["o"]
    own = log_kt(z, o)
    share1 = 1 / (1 + np.exp(np.clip(w - own, -700, 700)))
    up = np.logaddexp(own, w) - log(2)
    z0, o0, w0 = z.sum(0), o.sum(0), up.sum(0)
    share0 = 1 / (1 + np.exp(np.clip(w0 - log_kt(z0, o0), -700, 700)))
    shared = spark.sparkContext.broadcast((share1, z, o, share0, z0, o0))  # 2 MB
    above = parts.select("group", "context", "node").join(two.drop("up"), ["context", "node"])

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        r, _, _, chance = subtrees(left["keys"][0].as_py(), left["counts"][0].as_py())
        share1, z, o, share0, z0, o0 = shared.value
        known = right["context"].to_numpy().astype(np.int64) * 256 + right["node"].to_numpy()
        order = np.argsort(known)
        known, share2, z2, o2 = known[order], *(right[c].to_numpy()[order] for c in ("share", "z", "o"))
        x, two, total = (r & np.uint64(255)).astype(np.int64), (r >> np.uint64(8 * (depth - 1))).astype(np.int64), np.zeros(len(r))
        last = two >> 8
        for k in range(8):
            node, bit = (1 << k) | (x >> (8 - k)), (x >> (7 - k)) & 1 == 1
            at = np.searchsorted(known, two * 256 + node)
            kt2 = (np.where(bit, o2[at], z2[at]) + 0.5) / (z2[at] + o2[at] + 1)
            kt1 = (np.where(bit, o[last, node], z[last, node]) + 0.5) / (z[last, node] + o[last, node] + 1)
            kt0 = (np.where(bit, o0[node], z0[node]) + 0.5) / (z0[node] + o0[node] + 1)
            s2, s1, s0 = share2[at], share1[last, node], share0[node]
            total += np.log10(s0 * kt0 + (1 - s0) * (s1 * kt1 + (1 - s1) * (s2 * kt2 + (1 - s2) * chance[k])))
        return pa.table({"group": pa.array([left["group"][0].as_py()], pa.int32()), "keys": [packed(r)], "lp": [packed(total.astype("<f4"))]})

    return top.groupBy("group").cogroup(above.groupBy("group")).applyInArrow(finish, "group int, keys binary, lp binary")


def handed_down(steps: list[tuple[DataFrame, int]], values: DataFrame) -> DataFrame:
    """(kind, group, id, keys, values) of the chunks: of their runs the chances, of their words the counts in the corpus, in the order of the keys.

    `values` has those of the last sums; each step's rows look theirs up in the row that they were summed into.
    """
    kinds = {RUNS: "<f4", WORDS: "<i8"}

    def look_up(left: pa.Table, right: pa.Table) -> pa.Table:
        kind = kinds[left["kind"][0].as_py()]
        keys, of = (np.concatenate([unpacked(b, t) for b in right[c].to_pylist()]) for c, t in (("keys", "<u8"), ("values", kind)))
        order = np.argsort(keys)
        keys, of = keys[order], of[order]
        found = [packed(of[np.searchsorted(keys, unpacked(b, "<u8"))]) for b in left["keys"].to_pylist()]
        return pa.table({"kind": left["kind"], "group": left["group"], "id": left["own"], "keys": left["keys"], "values": pa.array(found, pa.binary())})

    for step in range(len(steps) - 2, -1, -1):
        rows, parts = steps[step]
        left = rows.select("kind", "group", F.col("id").alias("own"), _parent(parts).alias("id"), "keys")
        right = values.withColumn("group", F.shiftright("group", bits_of(step + 1) - bits_of(step)))
        values = left.groupBy("kind", "group", "id").cogroup(right.groupBy("kind", "group", "id")).applyInArrow(look_up, "kind int, group int, id long, keys binary, values binary")
        if step:
            values = materialise(values, "values")
    return values


class Chances:
    """Looks runs up: by one probe of a table, and by bisection for those whose place another run has."""

    def __init__(self, run: np.ndarray, lp: np.ndarray):
        order = np.argsort(run)
        self.run, self.lp = run[order], lp[order]
        self.shift = np.uint64(64 - max(8, min(23, int(len(run)).bit_length() + 2)))
        self.keys, self.values = np.zeros(1 << (64 - int(self.shift)), np.uint64), np.zeros(1 << (64 - int(self.shift)))
        at = self._place(self.run)
        self.keys[at], self.values[at] = self.run, self.lp

    def _place(self, r: np.ndarray) -> np.ndarray:
        return (r * np.uint64(0x9E3779B97F4A7C15)) >> self.shift

    def of(self, r: np.ndarray) -> np.ndarray:
        at = self._place(r)
        out, other = self.values[at], np.flatnonzero(self.keys[at] != r)
        out[other] = self.lp[np.searchsorted(self.run, r[other])]
        return out


def score(docs: DataFrame, key: str = "doc_id", text: str = "text", depth: int = DEPTH) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte of every row.

    A null or empty text is its end alone. Repeated rows each come out and each count in training.
    An empty table gives no rows. Chances travel as 32-bit floats: of a score, about 1 part in 10 million.
    """
    if not TOP <= depth <= 6:
        raise ValueError(f"depth is {TOP} to 6 bytes")
    counted = count(docs, key, text, depth)
    chunks = counted.filter(F.col("kind") == TEXTS).count()
    steps = sums(counted, chunks, depth)
    top = steps[-1][0]
    total = top.filter(F.col("kind") == WORDS).agg(F.sum("total").alias("tokens"), F.sum("known").alias("words")).first()
    tokens, kinds = int(total["tokens"] or 0), int(total["words"] or 0)
    base = float(np.log10(tokens + 0.1 * (kinds + 1)))
    lp = chances(top.filter(F.col("kind") == RUNS), depth).select(F.lit(RUNS).alias("kind"), "group", F.lit(0).cast("long").alias("id"), "keys", F.col("lp").alias("values"))
    known = top.filter(F.col("kind") == WORDS).select("kind", "group", "id", "keys", F.col("counts").alias("values"))
    found = handed_down(steps, materialise(lp.unionByName(known), "values"))
    # A chunk knows its words from its texts, so only their counts travel.
    found = found.select("kind", "group", "id", F.when(F.col("kind") == RUNS, F.col("keys")).alias("keys"), "values")
    facts = found.unionByName(counted.filter(F.col("kind") == TEXTS).select("kind", "group", "id", "keys", F.col("counts").alias("values")))

    def run(rows: pa.Table) -> pa.Table:
        import zstandard

        of = {k: rows.filter(pa.compute.equal(rows["kind"], k)).sort_by("group") for k in (RUNS, WORDS, TEXTS)}
        chance = Chances(*(np.concatenate([unpacked(b, t) for b in of[RUNS][c].to_pylist()]) for c, t in (("keys", "<u8"), ("values", "<f4"))))
        counts = np.concatenate([unpacked(b, "<i8") for b in of[WORDS]["values"].to_pylist()])
        with pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(read_file(of[TEXTS]["keys"][0].as_py().decode()))) as f:
            texts = f.read_all()
        del of, rows
        split = [[*b.split(), b"\n"] for b in texts["text"].to_pylist()]
        names = list(set().union(*split))
        kept, at = np.unique(hashed(names), return_inverse=True)
        if len(kept) != len(counts):
            raise ValueError("the words of a chunk differ from those counted")
        c_of = dict(zip(names, counts[at].tolist(), strict=True))
        n_tokens, n_known, sums_, scores, sizes = [], [], [], [], []
        for b, w in zip(texts["text"].to_pylist(), split, strict=True):
            c = np.fromiter(map(c_of.__getitem__, w), np.int64, len(w))
            n_tokens.append(len(w))
            n_known.append(int((c > 0).sum()))
            sums_.append(float(np.log10(c + 0.1).sum()))
            a = b"\n" * depth + b + b"\n"
            sizes.append(len(a) - depth)
            scores.append(sum(float(chance.of(runs(a[lo : lo + BLOCK_BYTES + depth], depth)).sum()) for lo in range(0, len(a) - depth, BLOCK_BYTES)))
        n = np.array(n_tokens, np.int64)
        return pa.table({"doc_id": texts["doc_id"], "held_out": texts["held"], "n_tokens": n, "n_known": np.array(n_known, np.int64), "base_score": np.array(sums_, np.float64) - n * base, "score": np.array(scores, np.float64), "n_bytes": np.array(sizes, np.int64)})

    spread = facts.repartition(max(1, min(4 * chunks, 20_000)), "id")  # so that few tasks get more than one of few chunks
    made = spread.groupBy("id").applyInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, n_bytes long")
    return made.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score", "n_bytes", (-F.col("score") / F.col("n_bytes") * float(np.log2(10))).alias("bits_per_byte"))
