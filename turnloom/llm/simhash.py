"""SimHash near duplicates by pigeonring filtering.

A 64-bit fingerprint has four segments of 16 bits on a ring. Fingerprints that differ in three
bits at most have a segment from which the differences, summed over one, two, three and four
segments in turn, stay within the proportional budgets 3l/4: at most 0, 1, 2 and 3. So candidates
share that segment and (at most one bit may differ in the second) one half of the next. They meet
under those 24 bits, and a chain that breaks its budget ends the check before the full count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_batch, materialise, small_batches

SEED, WIDTH, MOST = 42, 3, 3
BLOCK = 1024  # fingerprints of a hot bucket that are compared with as many others at once
SMALL = 48  # up to here every linked pair of a bucket is an edge; beyond, as few edges as connect it


def hashes(text: str | None, width: int = WIDTH) -> list[int]:
    """XXH64 of the word shingles, repeats included; of all words if they are fewer; none without words."""
    from xxhash import xxh64_intdigest as digest

    words = (text or "").encode().lower().split()
    if len(words) <= width:
        return [digest(b" ".join(words), SEED)] if words else []
    line, ends, at = b" ".join(words), [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    begins = [0, *(e + 1 for e in ends)]
    return [digest(line[i:j], SEED) for i, j in zip(begins, ends[width - 1 :], strict=False)]


def fingerprint_of(h: list[int]) -> int:
    """The bits set in over half of the hashes, as a signed 64-bit integer."""
    a, ones = np.array(h, "<u8"), np.zeros(64, np.int64)
    for at in range(0, len(a), 65_536):
        some = a[at : at + 65_536]
        ones += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(a), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """doc_id, fp (signed), text_hash of each whole text; a text that is null or has no word has fingerprint zero."""
    small_batches(docs.sparkSession, 500)

    def run(b: pa.RecordBatch) -> dict:
        return {"doc_id": b.column(0), "fp": [fingerprint_of(hashes(t, width)) for t in b.column(1).to_pylist()], "text_hash": b.column(2)}

    return by_batch(docs.select(F.col(key).cast("long"), F.col(text), F.xxhash64(text)), run, "doc_id long, fp long, text_hash long")


def _bits(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def chained(a: np.ndarray, b: np.ndarray, start: np.ndarray, most: int = MOST) -> np.ndarray:
    """Whether the differences of a and b keep their budgets from segment `start` on, all the way round."""
    x, ok, total = a ^ b, np.ones(len(a), bool), np.zeros(len(a), np.uint8)
    for step in range(4):
        at = (16 * ((start + step) % 4)).astype(np.uint64)
        total = total + _bits((x >> at) & np.uint64(0xFFFF))
        ok &= total <= (step + 1) * most // 4
        if not ok.any():
            break
    return ok


def _edges(fp: np.ndarray, start: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """As few pairs as connect what is linked within one bucket."""
    left = fp
    while len(left):
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            near = chained(left, np.broadcast_to(front[0], left.shape), np.full(len(left), start))
            yield np.repeat(front[:1], near.sum()), left[near]
            front, left = np.concatenate([front[1:], left[near]]), left[~near]


def links(fps: DataFrame) -> DataFrame:
    """Edges (u, v) that connect all fingerprints of column `fp` (distinct) as all pairs of at most three differing bits would.

    A bucket over 2 x BLOCK fingerprints is parted further by the budgets that its 24 bits leave:
    one bit at most differs in the second segment's other half, so one of its two parts is equal,
    and two at most in the third segment, so one of its three parts is. What is still as large is
    dealt into blocks, and each pair of blocks is a group of its own, so no group is larger whatever
    the bucket is.
    """
    seg = [F.shiftrightunsigned("fp", 16 * i).bitwiseAND(0xFFFF) for i in range(4)]
    keys = [F.lit((2 * i + half) << 24) + seg[i] * 256 + (F.shiftright(seg[(i + 1) % 4], 8 * half).bitwiseAND(0xFF)) for i in range(4) for half in (0, 1)]
    keyed = fps.select("fp", F.explode(F.array(*keys)).alias("key"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    sized, hot = keyed.join(sizes, "key"), F.col("n") > 2 * BLOCK
    half, start = F.shiftright("key", 24).bitwiseAND(1).cast("int"), F.shiftright("key", 25).cast("int")
    turned = F.when(start == 0, F.col("fp"))  # the segments from the bucket's on
    for i in (1, 2, 3):
        turned = turned.when(start == i, F.shiftrightunsigned("fp", 16 * i).bitwiseOR(F.shiftleft("fp", 64 - 16 * i)))
    other = F.when(half == 0, F.shiftrightunsigned("turned", 24)).otherwise(F.shiftrightunsigned("turned", 16)).bitwiseAND(255)
    third = F.shiftrightunsigned("turned", 32).bitwiseAND(0xFFFF)
    seconds = [(p, F.shiftright(other, 4 * p).bitwiseAND(15)) for p in (0, 1)]
    thirds = [(0, third.bitwiseAND(31)), (1, F.shiftright(third, 5).bitwiseAND(31)), (2, F.shiftright(third, 10))]
    parts = [F.lit(1 + (3 * p + q) << 10).cast("long") + a * 64 + b for p, a in seconds for q, b in thirds]
    parted = sized.filter(hot).withColumn("turned", turned).select("key", "fp", F.explode(F.array(*parts)).alias("part"))
    large = parted.groupBy("key", "part").agg(F.count("*").alias("n")).filter("n > 1")
    dealt = sized.filter(~hot).select("key", "fp", F.lit(0).cast("long").alias("part"), F.lit(1).alias("nb"))
    dealt = dealt.unionByName(parted.join(large, ["key", "part"]).select("key", "fp", "part", F.when(hot, F.ceil(F.col("n") / BLOCK)).otherwise(1).cast("int").alias("nb")))
    own = F.pmod(F.xxhash64("fp", "key"), F.col("nb")).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), F.col("nb") - 1), lambda o: F.least(o, F.col("own")).cast("long") * F.col("nb") + F.greatest(o, F.col("own")))
    dealt = dealt.withColumn("own", own).select("key", "fp", "part", F.explode(blocks).alias("pair")).select("key", "fp", (F.shiftleft("part", 40) + F.col("pair")).alias("block"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)]
        for b in _with_end(batches):
            if b is not None:
                new = [b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy().view(np.uint64)]
                kept = [np.concatenate(x) for x in zip(kept, new, strict=True)]
            key, block, fp = kept
            if not len(key):
                continue
            cut = len(key) if b is None else int(np.flatnonzero((key == key[-1]) & (block == block[-1]))[0])
            kept = [x[cut:] for x in kept]
            key, block, fp = key[:cut], block[:cut], fp[:cut]
            us, vs = [], []
            firsts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (block[1:] != block[:-1])]) if cut else np.zeros(0, int)
            sizes = np.diff(np.r_[firsts, cut])
            size = np.repeat(sizes, sizes)
            group = np.repeat(np.arange(len(firsts)), sizes)
            some = size <= SMALL
            g, f, s = group[some], fp[some], (key[some] >> 25) if cut else key
            for step in range(1, SMALL):
                same = np.flatnonzero(g[step:] == g[:-step])
                if not len(same):
                    break
                near = same[chained(f[same], f[same + step], s[same])]
                us.append(f[near])
                vs.append(f[near + step])
            for i in np.flatnonzero(sizes > SMALL):
                at = slice(firsts[i], firsts[i] + sizes[i])
                for u, v in _edges(fp[at], int(key[firsts[i]] >> 25)):
                    us.append(u)
                    vs.append(v)
            if us and sum(map(len, us)):
                yield pa.RecordBatch.from_pydict({"u": np.concatenate(us).view(np.int64), "v": np.concatenate(vs).view(np.int64)})

    spread = dealt.select("key", F.col("block").cast("long").alias("block"), "fp").repartition("key", "block").sortWithinPartitions("key", "block")
    return spread.mapInArrow(run, "u long, v long").distinct()


def _with_end(batches):
    yield from batches
    yield None


def components(edges: DataFrame) -> DataFrame:
    """(node, root): root is the least node that `edges` (u, v) reach; nodes without an edge are absent.

    Large and small stars in turn, each round a written table, until the edges stay as they are.
    """
    at, before = materialise(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges"), None
    while True:
        now = at.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if now == before or not now["n"]:
            break
        before = now
        both = at.union(at.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e")).select(F.col("e.v").alias("u"), F.col("e.m").alias("v"))
        at = materialise(small.filter("u <> v").distinct(), "edges")
    return at.select(F.col("u").alias("node"), F.col("v").alias("root")).union(at.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fp, component_id of every row; component_id is the least doc_id reachable over links.

    Copies share a fingerprint, so linking sees each once. A group without any doc_id has a null
    component_id. Repeated rows each come out. An empty table gives an empty result.
    """
    rows = materialise(fingerprints(docs, key, text), "fingerprints")
    return rows.join(_rooted(rows).select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def _rooted(rows: DataFrame) -> DataFrame:
    """(fp, root, component_id) of distinct fingerprints; a group has the root of its own."""
    fps = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    of = components(links(fps))
    rooted = fps.join(of.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rooted.join(named, "root").select("fp", "root", "component_id")


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The document of the least id of each group, once.

    Rows that share an id but no group each stay; of those in one group, the text of the least
    hash. Rows without an id are kept: no name tells which to keep.
    """
    rows = materialise(fingerprints(docs, key, text), "fingerprints")
    named = rows.filter("doc_id IS NOT NULL").join(_rooted(rows), "fp").groupBy("root").agg(F.min(F.struct("doc_id", "text_hash")).alias("k"))
    own = "kept"  # a column of its own, whatever the documents' are called
    while any(c.startswith(own) for c in docs.columns):
        own += "_"
    keep = named.select(F.col("k.doc_id").alias(f"{own}1"), F.col("k.text_hash").alias(f"{own}2")).distinct()
    hashed = docs.withColumn(f"{own}3", F.xxhash64(text))
    kept = hashed.join(keep, (F.col(key) == F.col(f"{own}1")) & (F.col(f"{own}3") == F.col(f"{own}2")), "left_semi")
    return kept.dropDuplicates([key, f"{own}3"]).drop(f"{own}3").unionByName(docs.filter(F.col(key).isNull()))
