"""Requests for resources, their archive under a byte budget, and the ledger of what became of each."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.binary import resource_error
from ..functions.text import archive_path, guess_extension
from ..functions.urls import basename_of_url, redact_url


def resource_requests(media: DataFrame, files: DataFrame) -> DataFrame:
    """(conv_id, seq, url, kind, name, expected): media of all turns that decorate nothing, then files; the first of each URL.

    Inputs have conv_id, ordinal, pos, url, kind, name, and files `expected` (bytes) where known.
    """
    every = media.filter(~F.coalesce("decorative", F.lit(False))).select("conv_id", F.lit(0).alias("phase"), "ordinal", "pos", "url", "kind", "name", F.lit(None).cast("long").alias("expected"))
    every = every.unionByName(files.select("conv_id", F.lit(1).alias("phase"), "ordinal", "pos", "url", F.lit("file").alias("kind"), "name", F.col("expected").cast("long").alias("expected")))
    order = ["phase", "ordinal", "pos"]
    first = every.filter(F.col("url").isNotNull() & (F.col("url") != "")).withColumn("_r", F.row_number().over(Window.partitionBy("conv_id", "url").orderBy(*order))).filter("_r = 1")
    return first.withColumn("seq", F.row_number().over(Window.partitionBy("conv_id").orderBy(*order))).select("conv_id", "seq", "url", "kind", "name", "expected")


def blob_facts(blobs: DataFrame) -> DataFrame:
    """(url, mime, size, sha256, head): what joins need of resource bytes; the bytes stay where they are."""
    return blobs.select("url", "mime", F.octet_length("bytes").cast("long").alias("size"), F.sha2("bytes", 256).alias("sha256"), F.substring("bytes", 1, 8).alias("head"))


def _first_fit(rows: pa.Table, cap: int) -> pa.Table:
    """`rows` with their status. Sequential: each decision depends on what was kept before."""
    rows, total, status = rows.sort_by("seq"), 0, []
    for size, error in zip(rows["size"].to_pylist(), rows["error"].to_pylist(), strict=True):
        if total >= cap:
            status.append("budget_exceeded")
        elif size is None or error is not None or total + size > cap:
            status.append("failed")
        else:
            status.append("archived")
            total += size
    return rows.append_column("status", pa.array(status, pa.string()))


def archive_budget(sized: DataFrame, cap: int) -> DataFrame:
    """`status` of requests (conv_id, seq, size, error): archived, failed or budget_exceeded, first fit in order under `cap` bytes.

    Where all that is valid fits, a window sum shows it and nothing else runs; only the other
    conversations' narrow rows are folded one after the other, in the same shuffle.
    """
    valid = F.col("error").isNull() & F.col("size").isNotNull()
    total = F.sum(F.when(valid, F.col("size")).otherwise(0)).over(Window.partitionBy("conv_id"))
    rows = sized.withColumn("_total", total)
    easy = rows.filter(F.col("_total") < cap).withColumn("status", F.when(valid, "archived").otherwise("failed")).drop("_total")
    hard = rows.filter(F.col("_total") >= cap).drop("_total")
    return easy.unionByName(hard.groupBy("conv_id").applyInArrow(lambda t: _first_fit(t, cap), easy.schema))


def with_validation(requests: DataFrame, facts: DataFrame) -> DataFrame:
    """Requests with size, mime, sha256 and `error` (null: valid; a missing blob is an error)."""
    name = F.coalesce(F.nullif(F.col("name"), F.lit("")), basename_of_url(F.col("url"), ""))
    rows = requests.join(facts, "url", "left")
    # The head is enough for the checks of content; sizes are compared as counted.
    checked = resource_error(F.col("head"), F.col("mime"), name, F.lit(None).cast("long"))
    wrong = F.when((F.col("expected") > 0) & (F.col("size") != F.col("expected")), F.concat(F.lit("unexpected size: "), "size", F.lit(", expected "), "expected"))
    return rows.withColumn("error", F.when(F.col("size").isNull(), "no such resource").otherwise(F.coalesce(wrong, checked)))


def resource_ledger(decided: DataFrame) -> DataFrame:
    """One row per request: redacted url, status, local path (numbered by what was archived), size and sha256, or the error."""
    archived = F.col("status") == "archived"
    n = F.sum(archived.cast("int")).over(Window.partitionBy("conv_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    ext = guess_extension(F.col("mime"), F.col("url"))
    fallback = F.concat("kind", F.lit("-"), F.lpad(F.col("_n").cast("string"), 3, "0"), ext)
    name = F.coalesce(F.nullif(F.col("name"), F.lit("")), basename_of_url(F.col("url"), fallback))
    rows = decided.withColumn("_n", n)
    path = archive_path(F.col("kind"), F.col("_n"), name, ext)
    too_large = F.when((F.col("status") == "failed") & F.col("error").isNull(), "over the limit of resources").otherwise(F.col("error"))
    return rows.select(
        "conv_id", "seq", "url", redact_url(F.col("url")).alias("url_for_metadata"), "status", F.when(archived, path).alias("local_path"), F.when(archived, F.col("size")).alias("size"),
        F.when(archived, F.col("sha256")).alias("sha256"), F.when(F.col("status") == "failed", too_large).alias("error"),
    )


def file_archive_status(files: DataFrame, ledger: DataFrame) -> DataFrame:
    """Files (conv_id, href, ...) with archive_status, local_path, and a warning where there is no copy."""
    kept = ledger.filter("status = 'archived'").select("conv_id", F.col("url").alias("href"), "local_path")
    rows = files.join(kept, ["conv_id", "href"], "left")
    status = F.when(F.col("local_path").isNotNull(), "archived").when(F.coalesce("href", F.lit("")) == "", "unresolved").otherwise("not_archived")
    rows = rows.withColumn("archive_status", status)
    label = F.coalesce(F.nullif(F.col("name"), F.lit("")), F.lit("sin nombre"))
    return rows.withColumn("warning", F.when(F.col("local_path").isNull(), F.concat(F.lit("Archivo sin copia local: "), label, F.lit(" ("), "archive_status", F.lit(")."))))


def archived_lookup(files: DataFrame, ledger: DataFrame) -> DataFrame:
    """Files with the local path of their resource: by URL, else by redacted URL, else by local path: three equi joins, not one of ORs."""

    def by(column: str, key: str, out: str) -> DataFrame:
        return ledger.filter("status = 'archived'").groupBy("conv_id", F.col(column).alias(key)).agg(F.min("local_path").alias(out))

    rows = files.join(by("url", "href", "_a"), ["conv_id", "href"], "left").join(by("url_for_metadata", "href", "_b"), ["conv_id", "href"], "left").join(by("local_path", "href", "_c"), ["conv_id", "href"], "left")
    return rows.withColumn("found_path", F.coalesce("_a", "_b", "_c")).drop("_a", "_b", "_c")


def budget_warning(status: Column, limit_mb: int) -> Column:
    return F.when(status == "budget_exceeded", f"Se alcanzó el límite total de recursos ({limit_mb} MB).")
