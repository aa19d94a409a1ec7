"""Bundles of entries (conv_id, path, data), their manifest and its verification."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What one archive can hold, and the entries that a manifest can't describe.
MOST_ENTRIES, MOST_BYTES = 65_535, 0xFFFFFFFF
OWN_ENTRIES = ("integrity.json", "SHA256SUMS.txt")


def bundle_entries(frames: list[DataFrame]) -> DataFrame:
    """The entries of all kinds as one frame of (conv_id, path, data binary)."""
    return reduce(DataFrame.unionByName, [f.select("conv_id", "path", F.col("data").cast("binary").alias("data")) for f in frames])


def bad_path(path: Column) -> Column:
    return F.coalesce(path, F.lit("")).eqNullSafe(F.lit("")) | path.startswith("/") | F.exists(F.split(path, "/"), lambda x: x == "..")


def bundle_check(entries: DataFrame) -> DataFrame:
    """Per conversation: entries, repeated names, bad paths, largest size and total, and whether an archive can hold them."""
    size = F.octet_length("data")
    got = entries.groupBy("conv_id").agg(
        F.count("*").alias("entries"), (F.count("*") - F.count_distinct("path")).alias("repeated"), F.count_if(bad_path(F.col("path"))).alias("bad_paths"), F.max(size).cast("long").alias("largest"), F.sum(size).alias("total_bytes")
    )
    return got.withColumn("ok", (F.col("entries") <= MOST_ENTRIES) & (F.col("repeated") == 0) & (F.col("bad_paths") == 0) & (F.col("total_bytes") <= MOST_BYTES))


def manifest(entries: DataFrame) -> DataFrame:
    """(conv_id, path, bytes, sha256) of every entry: bytes go no further than this."""
    return entries.select("conv_id", "path", F.octet_length("data").cast("long").alias("bytes"), F.sha2(F.col("data").cast("binary"), 256).alias("sha256"))


def manifest_files(rows: DataFrame) -> DataFrame:
    """(conv_id, path, data): the manifest as JSON and as lines of checksums."""
    got = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("path", "bytes", "sha256"))).alias("entries"))
    document = F.to_json(F.struct(F.lit("SHA-256").alias("algorithm"), F.lit("all_other_entries_except_integrity_and_SHA256SUMS").alias("scope"), "entries"))
    lines = F.concat(F.array_join(F.transform("entries", lambda e: F.concat(e["sha256"], F.lit("  "), e["path"])), "\n"), F.lit("\n"))
    files = F.array(F.struct(F.lit(OWN_ENTRIES[0]).alias("path"), document.alias("data")), F.struct(F.lit(OWN_ENTRIES[1]).alias("path"), lines.alias("data")))
    return got.select("conv_id", F.explode(files).alias("f")).select("conv_id", "f.path", "f.data")


def verify_bundle(entries: DataFrame, described: DataFrame) -> DataFrame:
    """(conv_id, path, status) of every entry and every line of the manifest.

    ok, bad_path, repeated_entry, repeated_in_manifest, wrong_size, wrong_hash, missing_entry or
    not_covered; the manifest's own two files are left out. Where `entries` has stored_crc, wrong_crc.
    """
    crc = F.col("stored_crc") if "stored_crc" in entries.columns else F.lit(None).cast("long")
    real = entries.filter(~F.col("path").isin(*OWN_ENTRIES) | F.col("path").isNull())
    facts = real.select("conv_id", F.coalesce("path", F.lit("")).alias("path"), F.octet_length("data").cast("long").alias("bytes"), F.sha2(F.col("data").cast("binary"), 256).alias("sha256"), (crc != F.crc32(F.col("data").cast("binary"))).alias("bad_crc"))
    facts = facts.groupBy("conv_id", "path").agg(F.count("*").alias("n"), F.max("bytes").alias("bytes"), F.max("sha256").alias("sha256"), F.bool_or("bad_crc").alias("bad_crc"))
    lines = described.groupBy("conv_id", "path").agg(F.count("*").alias("m"), F.max("bytes").alias("m_bytes"), F.max("sha256").alias("m_sha256"))
    both = facts.join(lines, ["conv_id", "path"], "full")
    status = (
        F.when(bad_path(F.col("path")), "bad_path").when(F.col("n") > 1, "repeated_entry").when(F.col("m") > 1, "repeated_in_manifest").when(F.col("n").isNull(), "missing_entry").when(F.col("m").isNull(), "not_covered")
        .when(F.col("bad_crc"), "wrong_crc").when(F.col("bytes") != F.col("m_bytes"), "wrong_size").when(F.col("sha256") != F.col("m_sha256"), "wrong_hash").otherwise("ok")
    )
    return both.select("conv_id", "path", status.alias("status"))
