"""WARC files with a Zstandard dictionary.

Each file starts with a skippable frame (magic 0x184D2A5D) that holds a dictionary trained from the
file's own records; then each record is a frame of its own, compressed with it. So a record is read
with the dictionary and its own bytes only, and the file is read by any tool of this format.
Of records with equal payloads, one is a response and the others revisit it.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, new_path, read_file, small_batches, write_file

SKIPPABLE = 0x184D2A5D
FILE_BYTES, DICTIONARY_BYTES, TRAINING_BYTES, LEVEL = 16 << 20, 64 << 10, 2 << 20, 3
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_uri(page_id: int | None, sha1: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{sha1}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, sha1: str, revisit: int | None, is_revisit: bool) -> bytes:
    """A WARC/1.1 record. A revisit's block is the HTTP head alone, whose Content-Length stays that of the full payload.

    A url that a head line cannot hold as it is (null, or with white space beside or inside it) stands in X-Page-URL, too: base64, or a dash for null.
    """
    uri = re.sub(r"\s+", "%20", (url or "").strip())
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = {
        "WARC-Type": "revisit" if is_revisit else "response", "WARC-Record-ID": record_uri(page_id, sha1), "WARC-Date": "1970-01-01T00:00:00Z",
        "WARC-Target-URI": uri, "WARC-Payload-Digest": f"sha1:{sha1}", "Content-Type": "application/http; msgtype=response",
        "X-Page-ID": "" if page_id is None else str(page_id),
    }
    if uri != url:
        head["X-Page-URL"] = "-" if url is None else "=" + base64.b64encode(url.encode()).decode()
    if is_revisit:
        head |= {"WARC-Profile": PROFILE, "WARC-Refers-To": record_uri(revisit, sha1), "X-Refers-To-Page-ID": "" if revisit is None else str(revisit)}
    block = http if is_revisit else http + payload
    lines = "".join(f"{k}: {v}\r\n" for k, v in [*head.items(), ("Content-Length", len(block))])
    return f"WARC/1.1\r\n{lines}\r\n".encode() + block + b"\r\n\r\n"


def url_of(head: dict[str, str]) -> str | None:
    """The url of a record's page, as it was given."""
    kept = head.get("x-page-url")
    return head["warc-target-uri"] if kept is None else None if kept == "-" else base64.b64decode(kept[1:]).decode()


def parse(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """(WARC head, HTTP head, body) of one record; names in lower case."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    n = int(fields["content-length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError("the record's length is wrong")
    http, _, body = rest[:n].partition(b"\r\n\r\n")
    return fields, {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in http.decode().split("\r\n")[1:])}, body


def pack_file(records: list[bytes]) -> tuple[bytes, list[tuple[int, int]]]:
    """(bytes of a file, place and size of each record's frame).

    The dictionary is trained from records spread evenly over the file, up to TRAINING_BYTES, the first 128 KiB
    of each; with too few to train from, it is the raw content of the first ones. Records are written whole.
    """
    import zstandard

    total = sum(map(len, records))
    every = max(1, -(-total // TRAINING_BYTES))
    some = [r[: 128 << 10] for r in records[::every]]
    try:
        trained = zstandard.train_dictionary(DICTIONARY_BYTES, some).as_bytes() if len(some) >= 16 else b""
    except zstandard.ZstdError:
        trained = b""
    trained = trained or b"".join(some)[:DICTIONARY_BYTES]
    out = [struct.pack("<II", SKIPPABLE, len(trained)) + trained]
    compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(trained), write_checksum=True, write_content_size=True)
    at, places = len(out[0]), []
    for r in records:
        out.append(compressor.compress(r))
        places.append((at, len(out[-1])))
        at += len(out[-1])
    return b"".join(out), places


def unpack_file(data: bytes, places: list[tuple[int, int]] | None = None) -> Iterator[bytes]:
    """The records of a file; without `places`, frame after frame."""
    import zstandard

    magic, n = struct.unpack_from("<II", data)
    if magic != SKIPPABLE:
        raise ValueError("no dictionary frame")
    trained = zstandard.ZstdCompressionDict(data[8 : 8 + n])
    tool = zstandard.ZstdDecompressor(dict_data=trained)
    if places is not None:
        for at, size in places:
            yield tool.decompress(data[at : at + size])
        return
    rest = data[8 + n :]
    while rest:
        one = tool.decompressobj()
        yield one.decompress(rest)
        rest = one.unused_data


def classified(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", least: int = 0) -> DataFrame:
    """page_id, url, payload, sha1 (hex), is_revisit, refers_to of every row, null html as an empty payload.

    Which record is a response is settled on digests alone; payloads move once, by their page. Of
    rows that repeat the largest page_id with the same payload, the first by URL is the response.
    A row without an id never is, if another has the same payload and an id. An empty table gives no rows.
    """
    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.encode(F.coalesce(html, F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("sha1", F.sha1("payload"))
    of = rows.select("page_id", "sha1")
    last = of.groupBy("sha1").agg(F.max("page_id").alias("last"))
    ids = of.distinct().join(last, "sha1").select(F.coalesce("page_id", F.lit(-1)).alias("k"), F.col("page_id").isNull().alias("none"), F.col("sha1").alias("s"), "last")
    joined = rows.join(ids, (F.coalesce("page_id", F.lit(-1)) == F.col("k")) & (F.col("page_id").isNull() == F.col("none")) & (F.col("sha1") == F.col("s")))
    nth = F.row_number().over(Window.partitionBy("k", "none", "s").orderBy("url"))
    again = ~(F.col("page_id").eqNullSafe(F.col("last")) & (F.col("nth") == 1)) & (F.octet_length("payload") >= least)
    return joined.withColumn("nth", nth).withColumn("is_revisit", again).select("page_id", "url", "payload", "sha1", "is_revisit", F.when(F.col("is_revisit"), F.col("last")).alias("refers_to"))


def write_warcs(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", least: int = 0) -> DataFrame:
    """Write a record per row into .warc.zst files in the shared folder; returns the index of records.

    Columns: path, at, size (of the record's frame), dictionary (size of the leading frame).
    A task that runs twice leaves files that the index does not name.
    """
    spark = pages.sparkSession
    small_batches(spark, 500, 8 << 20)
    to = new_path(spark, "warc")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n, records, size = TaskContext.get().partitionId(), 0, [], 0

        def out() -> pa.RecordBatch:
            data, places = pack_file(records)
            path = write_file(f"{to}/{part:06d}-{n:05d}-{uuid.uuid4().hex}.warc.zst", data)
            first = places[0][0]
            return pa.RecordBatch.from_pydict({"path": [path] * len(places), "at": [p[0] for p in places], "size": [p[1] for p in places], "dictionary": [first] * len(places)})

        for b in batches:
            for p, u, body, s, again, to_id in zip(*(c.to_pylist() for c in b.columns), strict=True):
                records.append(record(p, u, body, base64.b32encode(bytes.fromhex(s)).decode(), to_id, again))
                size += len(records[-1])
                if size >= FILE_BYTES:
                    yield out()
                    n, records, size = n + 1, [], 0
        if records:
            yield out()

    return materialise(classified(pages, key, url, html, least).mapInArrow(write, "path string, at long, size long, dictionary long"), "warc-index")


def read_warcs(index: DataFrame) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to of every record that the index names.

    A file is a group of its own, of about FILE_BYTES before compression at most (or one record), and
    each record is read at its place; up to 10,000 tasks read files.
    """
    kept = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    schema = pa.schema(list(zip(kept, [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()], strict=True)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, places in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                data, rows = read_file(path), []
                for r in unpack_file(data, [(p["at"], p["size"]) for p in places]):
                    head, http, body = parse(r)
                    sha1 = head["warc-payload-digest"].removeprefix("sha1:")
                    n = int(http["content-length"])
                    if head["warc-type"] == "response" and (len(body) != n or digest(body) != sha1):
                        raise ValueError(f"{path}: a payload differs from its digest")
                    to = head.get("x-refers-to-page-id")
                    rows.append(dict(zip(kept, (int(x) if (x := head["x-page-id"]) else None, url_of(head), n, sha1, head["warc-type"], int(to) if to else None), strict=True)))
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    files = index.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("at", "size"))).alias("places"))
    n = index.select("path").distinct().count()
    return files.repartitionByRange(max(1, min(n, 10_000)), "path").mapInArrow(read, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long")
