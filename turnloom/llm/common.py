"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..shared import dropped_shuffles, materialise, new_path, shared_dir  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 1000, size: int = 16 << 20) -> None:
    """Bound what an Arrow batch holds, whatever the length of the texts. The session keeps these settings: Spark reads them when a plan runs."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def by_batch(df: DataFrame, f: Callable[[pa.RecordBatch], dict | None], schema: str) -> DataFrame:
    """mapInArrow for a function from a batch to a dict of columns."""
    names = [x.strip().split()[0] for x in schema.split(",")]
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows and (out := f(b)) is not None:
                yield pa.RecordBatch.from_arrays([pa.array(out[n], arrow.field(n).type) for n in names], schema=arrow)

    return df.mapInArrow(run, schema)


def filesystem(path: str):
    """(file system, path in it) for a URI or a plain path, for the few files that a task writes or reads by itself."""
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        path = os.path.abspath(path)
        return fs.LocalFileSystem(), path
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path)


def write_file(path: str, data: bytes) -> str:
    fs, at = filesystem(path)
    fs.create_dir(os.path.dirname(at), recursive=True)
    with fs.open_output_stream(at, compression=None) as f:
        f.write(data)
    return path


def read_file(path: str) -> bytes:
    fs, at = filesystem(path)
    with fs.open_input_file(at) as f:
        return f.read()
