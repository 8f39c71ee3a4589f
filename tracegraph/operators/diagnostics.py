"""What could not be mapped, as rows; nothing is dropped without one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import json_text
from ..schema import DIAGNOSTICS
from .edges import unpaired

COLUMNS = [c.split()[0] for c in DIAGNOSTICS.split(", ")]


def _rows(df: DataFrame, code: str, message: Column, source: Column | None = None, node: str | None = "node_id", level: str = "warning", adapter: Column | None = None) -> DataFrame:
    null = F.lit(None).cast("string")
    values = ["graph_key", F.lit(code), F.lit(level), message, F.col(node) if node else null, null if source is None else source, null if adapter is None else adapter]
    return df.select(*[(F.col(v) if isinstance(v, str) else v).alias(c) for v, c in zip(values, COLUMNS)])


def of_spans(ided: DataFrame) -> DataFrame:
    """The adapter's own remarks, with the node they are about."""
    d = ided.select("graph_key", "node_id", "adapter_id", F.explode("diagnostics").alias("d"))
    return d.select("graph_key", "d.code", "d.level", "d.message", "node_id", "d.source_json", F.col("adapter_id").alias("adapter")).select(*COLUMNS)


def foreign_traces(ided: DataFrame, traces: DataFrame) -> DataFrame:
    """traces: majority_trace() of the inputs."""
    most = traces.withColumnRenamed("trace_id", "majority")
    strange = ided.where(F.col("trace_id").isNotNull()).join(most, "graph_key").where(~F.col("trace_id").eqNullSafe(F.col("majority")))
    said = F.concat(F.lit("the record is of trace "), F.col("trace_id"), F.lit(", most of the input of "), F.col("majority"))
    return _rows(strange, "multi_trace_input", said, json_text(F.col("trace_id")), adapter=F.col("adapter_id"))


def backward_time(ided: DataFrame) -> DataFrame:
    both = F.to_json(F.array("started_at", "ended_at"))
    return _rows(ided.where("ended_at < started_at"), "nonmonotonic_time", F.lit("the end is before the start; both are kept"), both, adapter=F.col("adapter_id"))


def duplicate_source_ids(ided: DataFrame) -> DataFrame:
    """Span ids that several records claim, where the input was not refused for it."""
    many = ided.where(F.col("span_id").isNotNull() & ~F.col("unique")).groupBy("graph_key", "span_id").agg(F.first("adapter_id").alias("adapter_id"))
    said = F.concat(F.lit("several records have the span id "), F.col("span_id"))
    return _rows(many, "duplicate_source_id", said, json_text(F.col("span_id")), node=None, adapter=F.col("adapter_id"))


def orphans(parents: DataFrame) -> DataFrame:
    said = F.concat(F.lit("the parent "), F.col("parent_id"), F.lit(" is not in this input"))
    return _rows(parents.where(F.col("ref_node").isNull()), "orphan_parent", said, json_text(F.col("parent_id")), adapter=F.col("adapter_id"))


def unpaired_calls(sides: DataFrame) -> DataFrame:
    source = json_text(F.col("call_id"))
    asked = _rows(unpaired(sides, "requester"), "unpaired_call", F.concat(F.lit("nothing here answers call "), F.col("call_id")), source, adapter=F.col("adapter_id"))
    return asked.unionByName(_rows(unpaired(sides, "fulfiller"), "unpaired_result", F.concat(F.lit("nothing here asks for call "), F.col("call_id")), source, adapter=F.col("adapter_id")))


def missing_starts(nodes: DataFrame) -> DataFrame:
    return _rows(nodes.where(F.col("started_at").isNull()), "missing_timestamp", F.lit("without a start the node is in no temporal edge"), level="info")


def cycles(found: DataFrame) -> DataFrame:
    said = F.lit("the parent and call_result edges have a cycle; the nodes on it and after it are ordered by start and id")
    return _rows(found, "ordering_cycle", said, F.col("cycle"), node=None)


def ordered(diagnostics: DataFrame) -> list[Column]:
    """The canonical order; what a diagnostic is about breaks ties."""
    return [F.col("code"), F.coalesce("node_id", F.lit("")), F.col("message"), F.coalesce("source_json", F.lit(""))]
