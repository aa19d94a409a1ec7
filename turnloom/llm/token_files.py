"""Token files of directly addressable codes.

An id is cut into 8-bit chunks, low chunk first. Level k holds chunk k of every id that has one,
a bitmap says which ids continue in level k + 1, and a rank directory (ones before each 512 bits)
finds an id's place there. Any token is read by itself: one chunk, one bit and one rank per level.

A file holds whole documents of one run of ascending ids:

    b"DAC1", levels u32, documents u64, tokens u64, has-id bitmap, ids i64[documents],
    ends u64[documents]; then per level: entries u64, chunks u8[], bitmap u8[], ranks u64[]
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import filesystem, materialise, new_path, small_batches, write_file
from .tokens import byte_ids, word_ids

BLOCK = 512


def encode(keys: list[int | None], ends: np.ndarray, ids: np.ndarray) -> bytes:
    """The bytes of a file. `ends`: of each document, the number of ids up to its end."""
    levels, left = [], ids.astype(np.uint32)
    while True:
        more = left > 255
        bits = np.packbits(more, bitorder="little")
        ones = np.add.reduceat(more, np.arange(0, len(more), BLOCK), dtype=np.uint64) if len(more) else np.zeros(0, np.uint64)
        ranks = np.concatenate([np.zeros(1, np.uint64), np.cumsum(ones, dtype=np.uint64)])[: max(1, len(ones))]
        levels.append(b"".join([np.uint64(len(left)).tobytes(), left.astype(np.uint8).tobytes(), bits.tobytes(), ranks.astype("<u8").tobytes()]))
        left = left[more] >> 8
        if not len(left):
            break
    known = np.array([k is not None for k in keys], bool)
    head = [b"DAC1", np.uint32(len(levels)).tobytes(), np.array([len(keys), len(ids)], "<u8").tobytes(), np.packbits(known, bitorder="little").tobytes(), np.array([k or 0 for k in keys], "<i8").tobytes(), ends.astype("<u8").tobytes()]
    return b"".join([*head, *levels])


class TokenFile:
    """Reads a file in place; `f` is any seekable file. Only the head is read at once."""

    def __init__(self, f):
        self.f = f
        head = f.read(24)
        if head[:4] != b"DAC1":
            raise ValueError("not a token file")
        n, self.tokens = (int(x) for x in np.frombuffer(head, "<u8", 2, 8))
        known = np.unpackbits(np.frombuffer(f.read((n + 7) // 8), np.uint8), bitorder="little")[:n]
        self.keys = [int(k) if x else None for k, x in zip(np.frombuffer(f.read(8 * n), "<i8"), known, strict=True)]
        self.ends = np.frombuffer(f.read(8 * n), "<u8").astype(np.int64)
        self.levels = []
        at = 24 + (n + 7) // 8 + 16 * n
        for _ in range(int(np.frombuffer(head, "<u4", 1, 4)[0])):
            f.seek(at)
            m = int(np.frombuffer(f.read(8), "<u8")[0])
            chunks, bits, ranks = at + 8, at + 8 + m, at + 8 + m + (m + 7) // 8
            self.levels.append((m, chunks, bits, ranks))
            at = ranks + 8 * max(1, -(-m // BLOCK))

    def _at(self, place: int, size: int) -> bytes:
        self.f.seek(place)
        return self.f.read(size)

    def token(self, i: int) -> int:
        """Token i alone, by one chunk and one rank in each of its levels."""
        if not 0 <= i < self.tokens:
            raise IndexError(i)
        out = 0
        for k, (_, chunks, bits, ranks) in enumerate(self.levels):
            out |= self._at(chunks + i, 1)[0] << (8 * k)
            block = i // BLOCK
            some = np.unpackbits(np.frombuffer(self._at(bits + block * BLOCK // 8, i // 8 - block * BLOCK // 8 + 1), np.uint8), bitorder="little")
            if not some[i - block * BLOCK]:
                return out
            i = int(np.frombuffer(self._at(ranks + 8 * block, 8), "<u8")[0]) + int(some[: i - block * BLOCK].sum())
        return out

    def all(self) -> np.ndarray:
        """Every id of the file."""
        out = None
        for m, chunks, bits, _ in reversed(self.levels):
            low = np.frombuffer(self._at(chunks, m), np.uint8).astype("<u4")
            if out is not None and len(out):
                more = np.unpackbits(np.frombuffer(self._at(bits, (m + 7) // 8), np.uint8), bitorder="little")[:m].astype(bool)
                low[more] |= out << 8
            out = low
        return out


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int, kind: str = "word", key: str = "doc_id", text: str = "text", most: int = 4_000_000) -> DataFrame:
    """Write whole texts (null: empty) as token files in ascending order of the key, nulls first; returns the files' table.

    Files lie in the shared folder and have names of their own attempt, so a task that runs twice
    leaves a file that no row names. A file has about `most` ids at most, but whole documents.
    Columns: part, file, path, documents, tokens, start (ids in all files before it).
    """
    spark = docs.sparkSession
    small_batches(spark, 1000, 8 << 20)
    to = new_path(spark, "tokens")
    end = np.array([end_id], "<u4").tobytes()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, files, keys, ids, size = TaskContext.get().partitionId(), 0, [], [], 0

        def out() -> pa.RecordBatch:
            every = np.frombuffer(b"".join(ids), "<u4")
            path = write_file(f"{to}/{part:06d}-{files:05d}-{uuid.uuid4().hex}.dac", encode(keys, np.cumsum([len(x) // 4 for x in ids]), every))
            return pa.RecordBatch.from_pylist([{"part": part, "file": files, "path": path, "documents": len(keys), "tokens": len(every)}])

        for b in batches:
            for k, x in zip(b.column(0).to_pylist(), (byte_ids if kind == "byte" else word_ids)(tokenizer, b.column(1).to_pylist()), strict=True):
                keys.append(k)
                ids.append(x + end)
                size += len(x) // 4 + 1
                if size >= most:
                    yield out()
                    files, keys, ids, size = files + 1, [], [], 0
        if keys:
            yield out()

    ordered = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"), F.crc32(F.col(text).cast("binary")).alias("c"))
    ordered = ordered.repartitionByRange(F.col("k").asc_nulls_first(), "c").sortWithinPartitions(F.col("k").asc_nulls_first(), "c").select("k", "t")
    files = materialise(ordered.mapInArrow(write, "part long, file long, path string, documents long, tokens long"), "token-files")
    before, at = [], 0
    for r in files.groupBy("part").agg(F.sum("tokens").alias("n")).orderBy("part").collect():  # a row per task
        before.append((r["part"], at))
        at += r["n"]
    first = spark.createDataFrame(before, "part long, before long")
    w = Window.partitionBy("part").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    return files.join(F.broadcast(first), "part").withColumn("start", F.col("before") + F.coalesce(F.sum("tokens").over(w), F.lit(0))).drop("before")


def read_tokens(files: DataFrame) -> DataFrame:
    """Per document of the files: doc_id, start, n_tokens, ids_crc32, and path and place in its file."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                fs, at = filesystem(r["path"])
                with fs.open_input_file(at) as f:
                    x = TokenFile(f)
                    every = x.all()
                begins = np.concatenate([[0], x.ends[:-1]]).astype(np.int64)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array(x.keys, pa.int64()), "start": r["start"] + begins, "n_tokens": x.ends - begins,
                    "ids_crc32": pa.array([zlib.crc32(every[i:j].tobytes()) for i, j in zip(begins, x.ends, strict=True)], pa.int64()),
                    "path": [r["path"]] * len(begins), "place": begins,
                })

    n = max(1, files.count())
    spread = files.repartitionByRange(min(n, 10_000), "part", "file")
    return spread.select("path", "start").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long, path string, place long")
