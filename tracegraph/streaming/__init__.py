"""Graphs of inputs that keep arriving.

Parsing is stateless and runs on a file stream. A graph is finished by a rebuild of its whole input in
foreachBatch: a span that arrives after its graph was built leads to the graph's rebuild, never to a patch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.storage import settled
from ..plans.build import build_graphs
from ..plans.document import documents
from ..sources import reader


def stream_inputs(spark: SparkSession, path: str, pattern: str = "*.jsonl") -> DataFrame:
    """(graph_key, content) of files as they appear below path."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", pattern).load(path)
    return files.select(F.col("path").alias("graph_key"), "content")


def stream_graphs(spark: SparkSession, path: str, out: str, checkpoint: str, adapter: str | None = None, pattern: str = "*.jsonl") -> StreamingQuery:
    """Writes a Parquet row (graph_key, document) for each new input, a folder a batch so that a retry replaces its own."""

    def finish(batch: DataFrame, number: int) -> None:
        rows = settled(reader.parsed(batch, adapter))
        graphs = build_graphs(reader.spans_of(rows), graphs=reader.graphs_of(rows), malformed=reader.malformed_of(rows)).settled()
        documents(graphs).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream_inputs(spark, path, pattern).writeStream.foreachBatch(finish).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
