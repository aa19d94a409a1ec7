"""Entries of many conversations (documents, pages, resources) as few large files: a data source with a commit protocol.

`df.write.format("turnloom_bundles").mode("append").save(path)` for rows (conv_id, name, bytes). Each task writes packs of
about PACK_BYTES and an index of its own, under names that no other attempt has; the commit of the job writes one small
manifest that names the indexes of the attempts that count. What a lost or repeated task leaves is in no manifest, so it
is never read. `spark.read.format("turnloom_bundles").load(path)` gives (conv_id, name, bytes, size, sha256): the reader
deals runs of neighbouring entries to its partitions and leaves out what a filter on conv_id excludes before any byte of
an entry is read. Register once per session with `register(spark)`.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

SCHEMA = "conv_id long, name string, bytes binary, size long, sha256 string"
PACK_BYTES, RUN_BYTES, BATCH_BYTES = 64 << 20, 32 << 20, 8 << 20
INDEX = pa.schema([("conv_id", pa.int64()), ("name", pa.string()), ("pack", pa.string()), ("at", pa.int64()), ("size", pa.int64()), ("sha256", pa.string())])
ENTRIES = pa.schema([("conv_id", pa.int64()), ("name", pa.string()), ("bytes", pa.binary()), ("size", pa.int64()), ("sha256", pa.string())])  # SCHEMA, as Arrow has it
MANIFESTS = "_manifests"


def _fs(path: str):
    import os

    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/").rstrip("/")
    if "://" not in path:
        return fs.LocalFileSystem(), os.path.abspath(path)
    found, at = fs.FileSystem.from_uri(path)
    return found, at.rstrip("/")


@dataclass
class Written(WriterCommitMessage):
    index: str | None
    rows: int


@dataclass
class Run(InputPartition):
    """Entries of packs, as (conv_id, name, pack, at, size, sha256)."""

    entries: list


class BundleWriter(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        import hashlib

        import pyarrow.parquet as pq

        fs, root = _fs(self.path)
        fs.create_dir(root, recursive=True)
        mine, rows, pack, at, out = uuid.uuid4().hex, [], None, 0, None
        for b in iterator:
            for conv, name, data in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("conv_id", "name", "bytes")), strict=True):
                data = data or b""
                if out is None or at >= PACK_BYTES:
                    if out:
                        out.close()
                    pack, at = f"{mine}-{uuid.uuid4().hex[:8]}.pack", 0
                    out = fs.open_output_stream(f"{root}/{pack}", compression=None)
                out.write(data)
                rows.append((conv, name, pack, at, len(data), hashlib.sha256(data).hexdigest()))
                at += len(data)
        if out is None:
            return Written(None, 0)
        out.close()
        table = pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), INDEX.types, strict=True)], schema=INDEX).sort_by("conv_id")
        pq.write_table(table, f"{root}/{mine}.index.parquet", filesystem=fs)
        return Written(f"{mine}.index.parquet", len(rows))

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = _fs(self.path)
        fs.create_dir(f"{root}/{MANIFESTS}", recursive=True)
        name = uuid.uuid4().hex
        with fs.open_output_stream(f"{root}/{MANIFESTS}/.{name}", compression=None) as f:
            f.write(json.dumps([m.index for m in messages if m and m.index]).encode())
        fs.move(f"{root}/{MANIFESTS}/.{name}", f"{root}/{MANIFESTS}/{name}.json")

    def abort(self, messages: list[Written | None]) -> None:
        """Nothing is named by a manifest, so nothing is read."""


class BundleReader(DataSourceReader):
    def __init__(self, path: str):
        self.path, self.filters = path, []

    def pushFilters(self, filters: list[Filter]):  # noqa: N802
        for f in filters:
            if isinstance(f, EqualTo | In | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual) and f.attribute == ("conv_id",):
                self.filters.append(f)
            else:
                yield f

    def _condition(self):
        import pyarrow.compute as pc

        c, all_of = pc.field("conv_id"), None
        for f in self.filters:
            one = (
                c.isin(list(f.value)) if isinstance(f, In) else c == f.value if isinstance(f, EqualTo) else c > f.value if isinstance(f, GreaterThan) else c >= f.value if isinstance(f, GreaterThanOrEqual)
                else c < f.value if isinstance(f, LessThan) else c <= f.value
            )
            all_of = one if all_of is None else all_of & one
        return all_of

    def partitions(self) -> list[Run]:
        """The index is read on the driver a file at a time; it holds no bytes of entries."""
        import pyarrow.parquet as pq
        from pyarrow.fs import FileSelector

        fs, root = _fs(self.path)
        named = []
        for info in sorted(fs.get_file_info(FileSelector(f"{root}/{MANIFESTS}", allow_not_found=True)), key=lambda i: i.path):
            if info.path.endswith(".json"):
                with fs.open_input_file(info.path) as f:
                    named += json.loads(f.read())
        runs, now, size = [], [], 0
        for name in named:
            rows = pq.read_table(f"{root}/{name}", filesystem=fs, filters=self._condition()).sort_by([("pack", "ascending"), ("at", "ascending")])
            for r in zip(*(c.to_pylist() for c in rows.columns), strict=True):
                if now and size + r[4] > RUN_BYTES:
                    runs.append(Run(now))
                    now, size = [], 0
                now.append(r)
                size += r[4]
        return [*runs, Run(now)]

    def read(self, partition: Run) -> Iterator[pa.RecordBatch]:
        fs, root = _fs(self.path)
        schema, rows, size, open_, f = ENTRIES, [], 0, None, None
        for conv, name, pack, at, n, sha in partition.entries:
            if pack != open_:
                if f:
                    f.close()
                open_, f = pack, fs.open_input_file(f"{root}/{pack}")
            f.seek(at)
            rows.append((conv, name, f.read(n), n, sha))
            size += n
            if size >= BATCH_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
                rows, size = [], 0
        if f:
            f.close()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


class Bundles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "turnloom_bundles"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> BundleReader:
        return BundleReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> BundleWriter:
        if overwrite:
            raise ValueError("bundles are appended to: take a new path")
        return BundleWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Bundles)
