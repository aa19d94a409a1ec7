"""Sharding by fixed virtual slots.

A record hashes into one of thousands of slots for good. Bytes are summed per slot, and a stored,
versioned map says which shard owns a slot; rebalancing edits the latest version (moves slots) and
stores the edited map as the next, never the hash. Only the map and the slot sums, both bounded by
the number of slots, reach the driver.

The hash takes key and text together: equal texts are not kept together, as a group of them may
hold a third of all rows, which no shard could take at near equal bytes.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise

SLOTS = 8192


def virtual_slot(key: str, text: str, slots: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key), F.crc32(F.col(text).cast("binary"))), F.lit(slots)).cast("int")


def slotted(df: DataFrame, key: str = "doc_id", text: str = "text", slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, vslot of every row: no text goes on from here.

    A null text has size 8 and crc 0; a null key is hashed like any other; the text joins the
    hash, so rows that repeat a key spread unless they are equal throughout.
    """
    t = F.col(text)
    return df.select(
        F.col(key).alias("doc_id"),
        (F.coalesce(F.octet_length(t), F.lit(0)) + 8).cast("long").alias("size"),
        F.coalesce(F.crc32(t.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        virtual_slot(key, text, slots).alias("vslot"),
    )


def first_map(slots: int, shards: int) -> list[int]:
    """Version 0: slots dealt in turn."""
    return [s % shards for s in range(slots)]


def rebalance(old: list[int], weights: list[int], shards: int) -> list[int]:
    """The edited map: shards above the mean release slots (large ones first, never below the
    mean), and the released ones go, large first, to the lightest shard. Slots that need not
    move stay. Shards beyond those of `old` start empty, so growing moves slots to them."""
    new, load = list(old), [0] * shards
    for s, w in enumerate(weights):
        load[old[s]] += w
    mean, free = sum(load) / shards, []
    for s in sorted(range(len(new)), key=lambda s: (-weights[s], s)):
        if weights[s] and load[new[s]] - weights[s] >= mean - min(weights[s] / 2, mean / 1000):
            load[new[s]] -= weights[s]
            free.append(s)
    heap = [(x, k) for k, x in enumerate(load)]
    heapq.heapify(heap)
    for s in free:  # still large first
        x, k = heapq.heappop(heap)
        new[s] = k
        heapq.heappush(heap, (x + weights[s], k))
    return new


MAP = "vslot int, shard int, bytes long, version int"


def store_map(spark: SparkSession, maps: str, version: int, shards: list[int], weights: list[int]) -> None:
    """Store a version of the map in the folder `maps`: the shard of each slot, and the bytes it was weighed with."""
    rows = list(zip(range(len(shards)), shards, weights, strict=True))
    spark.createDataFrame(rows, "vslot int, shard int, bytes long").coalesce(1).write.parquet(f"{maps}/version={version}")


def create_map(spark: SparkSession, maps: str, shards: int, slots: int = SLOTS) -> None:
    """Version 0 in a new folder: slots dealt in turn, not weighed yet."""
    store_map(spark, maps, 0, first_map(slots, shards), [0] * slots)


def load_map(spark: SparkSession, maps: str, version: int | None = None) -> DataFrame:
    """MAP of one version, the latest unless it is named."""
    every = spark.read.schema(MAP).parquet(maps)
    if version is None:
        version = every.agg(F.max("version")).first()[0]
    return every.filter(F.col("version") == version)


def moved(spark: SparkSession, maps: str, old: int, new: int) -> DataFrame:
    """vslot, source, target, bytes of the slots that changed hands from one version to another."""
    a = load_map(spark, maps, old).select("vslot", F.col("shard").alias("source"))
    b = load_map(spark, maps, new).select("vslot", F.col("shard").alias("target"), "bytes")
    return a.join(b, "vslot").filter("source <> target")


def edit_map(sums: dict[int, int], spark: SparkSession, maps: str, shards: int) -> DataFrame:
    """The next version: the latest, read back from `maps`, rebalanced by the bytes of each slot and stored."""
    last = sorted(load_map(spark, maps).collect(), key=lambda r: r["vslot"])  # a row per slot
    weights = [sums.get(s, 0) for s in range(len(last))]
    version = last[0]["version"] + 1
    store_map(spark, maps, version, rebalance([r["shard"] for r in last], weights, shards), weights)
    return load_map(spark, maps, version)


def assign(df: DataFrame, maps: str, shards: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard, slot, virtual_slot of every row, by the next version of the map in the folder `maps`.

    The folder has been made by create_map; the latest version is edited so that `shards` shards
    get near equal bytes, and rows are placed by what was stored. `slot` is the place in the shard,
    gapless, by virtual slot and then key. The window runs per virtual slot, so no task sees a
    shard. Rows equal in all columns are ordered among themselves in any way. An empty table gives
    no rows and a map of no bytes.
    """
    spark = df.sparkSession
    slots = load_map(spark, maps).count()
    rows = materialise(slotted(df, key, text, slots), "slotted")
    sums = {r["vslot"]: (int(r["bytes"]), int(r["rows"])) for r in rows.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).collect()}  # a row per slot
    shard = {r["vslot"]: r["shard"] for r in edit_map({s: b for s, (b, _) in sums.items()}, spark, maps, shards).collect()}
    first, at = [], [0] * shards
    for s in range(slots):
        first.append((s, shard[s], at[shard[s]]))
        at[shard[s]] += sums.get(s, (0, 0))[1]
    first_row = F.broadcast(spark.createDataFrame(first, "vslot int, shard int, first_row long"))  # `slots` rows
    w = Window.partitionBy("vslot").orderBy("doc_id", "text_crc32", "size")
    placed = rows.withColumn("r", F.row_number().over(w) - 1)
    return placed.join(first_row, "vslot").select("doc_id", "size", "text_crc32", "shard", (F.col("first_row") + F.col("r")).alias("slot"), F.col("vslot").alias("virtual_slot"))


def write_shards(df: DataFrame, path: str, maps: str, key: str = "doc_id", text: str = "text") -> None:
    """Write the records under path/_shard=N, in files of whole virtual slots, by the latest version of the map in `maps`.

    Columns named _shard or _virtual_slot of the input are replaced.
    """
    of = load_map(df.sparkSession, maps)
    keyed = df.withColumn("_virtual_slot", virtual_slot(key, text, of.count()))
    shards = F.broadcast(of.select(F.col("vslot").alias("_virtual_slot"), F.col("shard").alias("_shard")))
    keyed.drop("_shard").join(shards, "_virtual_slot").repartition("_shard", "_virtual_slot").write.partitionBy("_shard").parquet(path)
