"""The prefix trie of conversations, with totals of its subtrees by time-forward processing.

A node is a distinct sequence of first turns. It is known by 128 bits: the exclusive or, over its
turns, of two hashes of each turn with its place. Running values of a conversation are found in
blocks of its turns and carried from block to block, so no conversation has to fit into one task.
A node's smallest member and its depth tell it from all others, and its parent's are never greater;
that order shards the trie (see time_forward).

Turns are ordered by their number (null first), then by role, then by a hash of the text; equal rows
are turns of their own. Null roles and texts are empty. Rows without a conversation belong to none
and go. An empty table gives no nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, small_batches
from .time_forward import subtree_sums

BLOCK = 1024  # turns of a conversation that meet in a group
GROUP = 100  # conversations that share the first turns of the first of them
NODE = ("depth", "ka", "kb")


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, ordinal from 0, a, b, n_chars) of every turn; a and b are two hashes of role and text. No texts are shuffled."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    rows = conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text("role").alias("role"), F.xxhash64(text("role"), text("text")).alias("a"),
        F.xxhash64(F.lit("b"), text("text"), text("role")).alias("b"), F.char_length(text("text")).cast("long").alias("n_chars"), F.monotonically_increasing_id().alias("row"),
    )
    order = [F.asc("conv_id"), F.asc_nulls_first("turn"), F.asc("role"), F.asc("a"), F.asc("b"), F.asc("row")]
    n = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = materialise(rows.repartitionByRange(n, *order).withColumn("part", F.spark_partition_id()), "turns")
    edge = parts.groupBy("part", "conv_id").agg(F.count("*").alias("n"))
    edges = edge.groupBy("part").agg(F.min(F.struct("conv_id", "n")).alias("first"), F.max(F.struct("conv_id", "n")).alias("last")).orderBy("part").collect()  # a row per partition
    before, offsets = {}, []
    for r in edges:
        for conv, size in {(r["first"]["conv_id"], r["first"]["n"]), (r["last"]["conv_id"], r["last"]["n"])}:
            if before.get(conv):
                offsets.append((r["part"], conv, before[conv]))
            before[conv] = before.get(conv, 0) + size
    place = F.row_number().over(Window.partitionBy("part", "conv_id").orderBy(*order[1:])) - 1
    started = conversations.sparkSession.createDataFrame(offsets, "part int, conv_id long, before long")
    got = parts.withColumn("place", place).join(F.broadcast(started), ["part", "conv_id"], "left")
    return materialise(got.select("conv_id", (F.col("place") + F.coalesce("before", F.lit(0))).alias("ordinal"), "a", "b", "n_chars"), "ordered")


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations that take their first turns from the first of their hundred.

    (turns, ends): turns are (conv_id, depth from 1, a, b, n_chars, length), ends (conv_id, length) of every conversation, those
    without a turn included. h = crc32(conv_id) % 6: the first h turns come from conversation c - c % 100 (rounded down), the rest are c's own after its first h.
    """
    turns = ordered_turns(conversations)
    shared = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6
    base = F.col("conv_id") - F.pmod("conv_id", F.lit(GROUP))
    heads = turns.filter((F.pmod("conv_id", F.lit(GROUP)) == 0) & (F.col("ordinal") < 5)).groupBy(F.col("conv_id").alias("base")).agg(F.array_sort(F.collect_list(F.struct("ordinal", "a", "b", "n_chars"))).alias("head"))
    each = turns.groupBy("conv_id").agg(F.count("*").alias("n")).select("conv_id", "n", shared.cast("int").alias("h"), base.alias("base")).join(heads, "base", "left")
    head = F.slice(F.coalesce("head", F.array().cast(heads.schema["head"].dataType)), F.lit(1), F.col("h"))
    each = each.select("conv_id", "n", "h", head.alias("head")).withColumn("k", F.size("head"))
    ends = materialise(each.withColumn("length", F.col("k") + F.greatest(F.col("n") - F.col("h"), F.lit(0))), "conversations")
    given = ends.select("conv_id", "length", F.posexplode("head").alias("at", "t")).select("conv_id", (F.col("at") + 1).cast("long").alias("depth"), "t.a", "t.b", "t.n_chars", "length")
    blocks = ends.filter("n > h").select("conv_id", "h", "k", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - F.col("h") - 1) / BLOCK))).alias("block"))
    own = turns.withColumn("_at", F.col("ordinal") - shared).filter("_at >= 0").withColumn("block", F.floor(F.col("_at") / BLOCK)).join(blocks, ["conv_id", "block"])
    own = own.select("conv_id", (F.col("_at") + F.col("k") + 1).alias("depth"), "a", "b", "n_chars", "length")
    return given.unionByName(own), ends.select("conv_id", "length")


def paths(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, ka, kb, pa, pb, n_chars, length): the node that each turn leads to, and its parent."""
    block = F.floor(F.col("depth") / BLOCK)
    rows = turns.withColumns({"x": F.xxhash64("depth", "a"), "y": F.xxhash64("depth", "b"), "block": block})
    w = Window.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    rows = materialise(rows.select("conv_id", "depth", "block", "length", "n_chars", "x", "y", F.bit_xor("x").over(w).alias("ka"), F.bit_xor("y").over(w).alias("kb")), "paths")
    long = rows.filter(F.col("length") >= BLOCK)
    each = long.groupBy("conv_id", "block").agg(F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"))
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = each.select("conv_id", "block", *[F.coalesce(F.bit_xor(k).over(before), F.lit(0)).cast("long").alias(f"c{k}") for k in "xy"])
    long = long.join(carried, ["conv_id", "block"]).withColumns({"ka": F.col("ka").bitwiseXOR(F.col("cx")), "kb": F.col("kb").bitwiseXOR(F.col("cy"))})
    rows = rows.filter(F.col("length") < BLOCK).unionByName(long.drop("cx", "cy"))
    return rows.select("conv_id", "depth", "ka", "kb", F.col("ka").bitwiseXOR(F.col("x")).alias("pa"), F.col("kb").bitwiseXOR(F.col("y")).alias("pb"), "n_chars", "length")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids of one node that stand together, joined by commas, a row per run and batch."""
    for b in batches:
        out, last = [], None
        for *node, conv in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if node != last:
                out.append((*node, conv, []))
                last = node
            out[-1][-1].append(str(conv))
        if out:
            *keys, ids = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([*[pa.array(k, pa.int64()) for k in keys], pa.array([",".join(x) for x in ids])], names=[*NODE, "first", "ids"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's runs, fed to it one after another."""
    node, h, first = None, None, True
    for b in batches:
        out = []
        for *now, ids in zip(*(b.column(k).to_pylist() for k in (0, 1, 2, 4)), strict=True):
            if now != node:
                if node:
                    out.append((*node, h.hexdigest()))
                node, h, first = now, hashlib.sha256(), True
            h.update((ids if first else "," + ids).encode())
            first = False
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], names=[*NODE, "ends_sha256"])
    if node:
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*node, h.hexdigest())], names=[*NODE, "ends_sha256"])


def ends_digests(ends: DataFrame) -> DataFrame:
    """(depth, ka, kb, ends_sha256) of the conversations that end at each node, from (depth, ka, kb, conv_id). A node's ids are
    sorted over as many tasks as they need and packed there; the last task reads packed runs, as a digest has to."""
    key = "depth long, ka long, kb long"
    n = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    packed = ends.select(*NODE, "conv_id").repartitionByRange(n, *NODE, "conv_id").sortWithinPartitions(*NODE, "conv_id").mapInArrow(_runs, f"{key}, first long, ids string")
    return packed.repartition(*NODE).sortWithinPartitions(*NODE, "first").mapInArrow(_digests, f"{key}, ends_sha256 string")


def prefix_trie(turns: DataFrame, ends: DataFrame, shards: int | None = None) -> DataFrame:
    """Every node of the trie of `turns` and `ends` (as `rebuilt` gives them): conv_id, depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256. The root has depth 0."""
    small_batches(turns.sparkSession, 10_000)
    path = paths(turns)
    zero = F.lit(0).cast("long")
    none = F.lit(None).cast("long")
    met = path.groupBy(*NODE).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.first("n_chars").alias("n_chars"), F.first("pa").alias("pa"), F.first("pb").alias("pb"))
    root = ends.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).filter("n_convs > 0")
    root = root.select(zero.alias("depth"), zero.alias("ka"), zero.alias("kb"), "conv_id", "n_convs", zero.alias("n_chars"), none.alias("pa"), none.alias("pb"))
    nodes = materialise(met.unionByName(root), "nodes")
    children = nodes.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("pa").alias("ka"), F.col("pb").alias("kb")).agg(F.count("*").alias("n_children"))
    above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("ka").alias("pa"), F.col("kb").alias("pb"), F.col("conv_id").alias("parent_conv_id"))
    last = path.filter("depth = length").select(*NODE, "conv_id").unionByName(ends.filter("length = 0").select(zero.alias("depth"), zero.alias("ka"), zero.alias("kb"), "conv_id"))
    digests = ends_digests(last)
    told = nodes.join(children, list(NODE), "left").join(digests, list(NODE), "left").join(above, ["depth", "pa", "pb"], "left")
    told = materialise(told.select("conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", zero).alias("n_children"), F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"), "n_chars"), "told")
    up = F.when(F.col("depth") > 0, F.col("depth") - 1)
    forest = told.select(
        F.col("conv_id").alias("c"), F.col("depth").alias("d"), zero.alias("p"), F.col("parent_conv_id").alias("uc"), up.alias("ud"), F.when(F.col("depth") > 0, zero).alias("up"),
        F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("v"), ((F.col("n_convs") - 1) * F.col("n_chars")).alias("w"),
    )
    sums = subtree_sums(forest, shards).select(F.col("c").alias("conv_id"), F.col("d").alias("depth"), F.col("v").alias("n_leaves"), F.col("w").alias("saved_tokens"))
    return told.join(sums, ["conv_id", "depth"]).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
