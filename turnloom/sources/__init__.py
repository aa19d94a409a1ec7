"""Sources: exported documents, stored turn pages, conversation graphs and resource bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import SOURCE_GRAPH


def read_conversation_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Exported documents, one per file, under an explicit schema. Where there are millions, pack them first (write_packed)."""
    return spark.read.schema(schema).json(path, multiLine=True)


def write_packed(df: DataFrame, path: str, *by: str) -> None:
    """Many small documents, pages or resources as rows of few files, those of one `by` together: their ids are a column, so nothing lists a file for each."""
    df.repartition(*by).write.parquet(path)


def read_packed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What `write_packed` wrote, under an explicit schema."""
    return spark.read.schema(schema).parquet(path)


def read_conversation_documents(df: DataFrame, column: str, schema: str) -> DataFrame:
    """Documents that are cells of a table, under an explicit schema."""
    return df.select(F.from_json(column, schema).alias("_d")).select("_d.*")


def read_turn_html(spark: SparkSession, path: str) -> DataFrame:
    """(path, html): one stored page per file. Where there are millions, pack them first (write_packed)."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("html"))


def read_source_json(df: DataFrame, column: str = "json") -> DataFrame:
    """(conversation_id, current_node, node_id, parent_id, message): the nodes of conversation graphs. Malformed JSON gives no nodes."""
    rows = df.select("conversation_id", F.from_json(column, SOURCE_GRAPH).alias("g"))
    nodes = rows.select("conversation_id", F.col("g.current_node").alias("current_node"), F.explode(F.map_entries("g.mapping")).alias("n"))
    return nodes.select("conversation_id", "current_node", F.col("n.key").alias("node_id"), F.col("n.value.parent").alias("parent_id"), F.col("n.value.message").alias("message"))


def read_resource_blobs(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, size) of stored resources, one per file. Where there are millions, pack them first (write_packed)."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("content").alias("bytes"), F.col("length").alias("size"))
