"""Packing documents into sequences of equal capacity by Martello and Toth's dominance reduction, then best fit.

Only the number of pieces of each length matters to a packing, and there are at most `capacity`
lengths. So the plan is made on that histogram, on the driver, with counts as large as they may
be; pieces then take their places by their rank within their length, in parallel.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import by_batch, materialise, small_batches
from .tokens import byte_ids, word_ids

CAPACITY = 2048
ROWS_A_GROUP = 1 << 20  # about so many pieces of one length are ranked by one task


def reduced(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[tuple[int, ...], int]], dict[int, int]]:
    """((lengths of a sequence, number of such sequences) fixed for good, histogram of the pieces left).

    From the longest piece j down. A set with j dominates when every other set that j
    could be in packs no more, piece by piece, so it is fixed for good:
    - {j}, if nothing fits beside it;
    - {j, k}, k the longest that fits: if k fills the rest exactly, if no two pieces fit beside
      j, or if no three do and k is at least as long as any two that do;
    - {j, k, l}, l the longest that fits beside both: if no three pieces fit beside j, and of no two
      that do is the shorter longer than l.
    Some packing of as few sequences as can be has all the sets that are fixed.
    """
    left, lengths, out = dict(histogram), sorted(x for x, n in histogram.items() if n > 0), []
    if lengths and not 0 < lengths[0] <= lengths[-1] <= capacity:
        raise ValueError("lengths must be from 1 to the capacity")

    def take(of: tuple[int, ...], times: int) -> None:
        out.append((of, times))
        for x in of:
            left[x] -= times
        for x in set(of):
            if not left[x]:
                lengths.pop(bisect_left(lengths, x))

    def longest(most: int, *used: int) -> int:
        """The longest piece up to `most` besides those used; 0 if there is none."""
        at = bisect_right(lengths, most) - 1
        while at >= 0 and left[lengths[at]] <= used.count(lengths[at]):
            at -= 1
        return lengths[at] if at >= 0 else 0

    def longest_shorter(rest: int, j: int) -> int:
        """The longest piece that fits in the rest together with one at least as long; 0 if there is none."""
        for at in range(bisect_right(lengths, rest // 2) - 1, -1, -1):
            x = lengths[at]
            n = left[x] - (x == j)
            other = next((y for y in lengths[at + 1 : at + 3] if left[y] > (y == j)), rest)
            if n > 1 or n and x + other <= rest:
                return x
        return 0

    def two_longest(rest: int, j: int) -> int:
        """The greatest total of two pieces that fit in the rest beside j; 0 if none do."""
        best, hi = 0, bisect_right(lengths, rest) - 1
        lo = 0
        while lo <= hi:
            a, b = lengths[lo], lengths[hi]
            need = 2 if a == b else 1
            ok_a, ok_b = left[a] - (a == j) >= need, left[b] - (b == j) >= (2 if a == b else 1)
            if a + b > rest or not ok_b:
                hi -= 1
            else:
                if ok_a:
                    best = max(best, a + b)
                lo += 1
        return best

    def three_fit(rest: int, j: int) -> bool:
        some: list[int] = []
        for x in lengths[:4]:
            some += [x] * min(3, left[x] - (x == j))
        return len(some) >= 3 and sum(some[:3]) <= rest

    at = len(lengths) - 1
    while at >= 0:
        at = min(at, len(lengths) - 1)
        if at < 0:
            break
        j = lengths[at]
        rest = capacity - j
        k = longest(rest, j)
        if not k:
            take((j,), left[j])
        elif k == rest or (pair := two_longest(rest, j)) == 0 or k >= pair and not three_fit(rest, j):
            take((j, k), left[j] // 2 if j == k else min(left[j], left[k]))
        elif not three_fit(rest, j) and (l := longest(rest - k, j, k)) and longest_shorter(rest, j) <= l:
            of = (j, k, l)
            take(of, min(left[x] // of.count(x) for x in of))
        else:
            at -= 1  # nothing dominates; best fit has it
            continue
        at = min(at, len(lengths) - 1)

    return out, {x: n for x, n in left.items() if n}


def best_fit(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit decreasing, where each length fills all the sequences of the least sufficient rest at once."""
    left = dict(histogram)
    rests: list[int] = []  # of open sequences, ascending
    open_at: dict[int, list[list]] = {}
    for j in sorted(left, reverse=True):
        n = left[j]
        while n:
            i = bisect_left(rests, j)
            if i < len(rests):
                groups = open_at[r := rests[i]]
                of, times = groups.pop()
                if not groups:
                    rests.pop(i)
                    del open_at[r]
                used = min(n, times)
                if times > used:
                    if r not in open_at:
                        insort(rests, r)
                    open_at.setdefault(r, []).append([of, times - used])
            else:  # as many of one length in each new sequence as fit
                each = min(n, capacity // j)
                used, of, r = n // each, (j,) * (each - 1), capacity - (each - 1) * j
                n -= used * (each - 1)
            now = (*of, j)
            if r - j not in open_at:
                insort(rests, r - j)
            open_at.setdefault(r - j, []).append([now, used])
            n -= used
    return [(tuple(of), times) for groups in open_at.values() for of, times in groups]


def reduce_and_fit(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, number of such sequences), for all pieces of the histogram: reduction, then best fit of what is left."""
    fixed, left = reduced(histogram, capacity)
    return fixed + best_fit(left, capacity)


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY, kind: str = "byte", key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: documents longer than the capacity cut into full pieces, the first one shorter.

    A null or empty text is the end id alone. Repeated rows each come out. An empty table gives no rows.
    """
    small_batches(docs.sparkSession, 1000, 8 << 20)
    end = np.array([end_id], "<u4").tobytes()

    def cut(b: pa.RecordBatch) -> dict:
        out: dict[str, list] = {x: [] for x in ("doc_id", "piece", "start", "length", "ids_crc32")}
        for k, x in zip(b.column(0).to_pylist(), (byte_ids if kind == "byte" else word_ids)(tokenizer, b.column(1).to_pylist()), strict=True):
            x += end
            n = len(x) // 4
            at = [0, *range(n % capacity or capacity, n, capacity), n]
            for i, (p, q) in enumerate(zip(at, at[1:], strict=False)):
                for name, v in zip(out, (k, i, p, q - p, zlib.crc32(x[4 * p : 4 * q])), strict=True):
                    out[name].append(v)
        return out

    return by_batch(docs.select(F.col(key).cast("long"), F.col(text)), cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """`cut` with sequence_id and offset: sequences hold `capacity` ids at most, gapless from 0.

    `cut` needs columns doc_id, piece, ids_crc32 and length, and should be a written table: it is
    read four times. Rows equal in these share their ranks in any way. An empty one gives none.
    However many pieces have one length, about ROWS_A_GROUP of them are ranked together.
    """
    salts = {r["length"]: -(-r["count"] // ROWS_A_GROUP) for r in cut.groupBy("length").count().collect()}  # capacity rows at most
    every = F.broadcast(cut.sparkSession.createDataFrame(list(salts.items()), "length long, _salts long"))
    salted = cut.join(every, "length").withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("_salts")).cast("int")).drop("_salts")
    counts = salted.groupBy("length", "_salt").count().collect()  # a row for ROWS_A_GROUP pieces, and capacity rows
    histogram: dict[int, int] = {}
    first: dict[tuple[int, int], int] = {}
    for r in sorted(counts, key=lambda r: (r["length"], r["_salt"])):
        first[r["length"], r["_salt"]] = histogram.get(r["length"], 0)
        histogram[r["length"]] = histogram.get(r["length"], 0) + r["count"]
    # Of each length: the ranks at which another sequence pattern, and place in it, begins.
    begin: dict[int, list[int]] = {x: [] for x in histogram}
    place: dict[int, list[tuple[int, int]]] = {x: [] for x in histogram}
    met, sequence = dict.fromkeys(histogram, 0), 0
    for of, times in reduce_and_fit(histogram, capacity):
        at = 0
        for x in of:
            begin[x].append(met[x])
            place[x].append((sequence, at))
            met[x] += times
            at += x
        sequence += times
    plan = {x: (np.array(begin[x], np.int64), np.array(place[x], np.int64).reshape(-1, 2)) for x in histogram}
    base = cut.sparkSession.createDataFrame([(*k, v) for k, v in first.items()], "length long, _salt int, _first long")
    shared = cut.sparkSession.sparkContext.broadcast(plan)  # bounded by the capacity, not by the rows
    w = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("_r", F.row_number().over(w) - 1).join(F.broadcast(base), ["length", "_salt"])
    ranked = ranked.select(*[F.col(c) for c in cut.columns], (F.col("_first") + F.col("_r")).cast("long").alias("_rank"))
    names = [f.name for f in cut.schema]

    def seat(b: pa.RecordBatch) -> dict:
        rank, length = b.column("_rank").to_numpy(), b.column("length").to_numpy()
        ids, offs = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
        for x in np.unique(length):
            of = length == x
            starts, at = shared.value[int(x)]
            i = np.searchsorted(starts, rank[of], "right") - 1
            ids[of], offs[of] = at[i, 0] + rank[of] - starts[i], at[i, 1]
        return {c: b.column(c) for c in names} | {"sequence_id": ids, "offset": offs}

    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema)
    return by_batch(ranked, seat, f"{ddl}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY, kind: str = "byte", key: str = "doc_id", text: str = "text") -> DataFrame:
    """Tokenise once, keep only the narrow table of pieces, and pack it. Nulls, repeats and empty tables as in `pieces`."""
    return pack(materialise(pieces(docs, tokenizer, end_id, capacity, kind, key, text), "pieces"), capacity)
