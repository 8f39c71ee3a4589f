"""From spans to graphs: all graphs of all inputs in one lazy plan, and the queries over them.

A refused input (two records with one id, no adapter) is a row of `graphs` with its error; it never costs another
input its graph.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, replace
from functools import cached_property
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import has_content
from ..functions.storage import settled, stored
from ..operators import annotate, diagnostics as diag, edges as edge, identity, order, traverse
from ..schema import ANNOTATIONS, DuplicateNodeIdError, STATED_KINDS, error_of
from ..sources import reader
from ..sources.registry import Registry

Kinds = str | Iterable[str] | None


def selector(kinds: Kinds) -> list[str] | None:
    return None if kinds is None else [kinds] if isinstance(kinds, str) else [str(k) for k in kinds]


@dataclass(frozen=True)
class TraceGraphs:
    """Graphs as DataFrames that share graph_key: nodes (with pos), edges, diagnostics, graphs, annotations."""

    nodes_df: DataFrame
    edges_df: DataFrame
    diagnostics_df: DataFrame
    graphs_df: DataFrame
    annotations_df: DataFrame

    @property
    def spark(self) -> SparkSession:
        return self.nodes_df.sparkSession

    def settled(self) -> TraceGraphs:
        """The same graphs as written tables: later queries start from them and not from the telemetry."""
        return TraceGraphs(*map(settled, (self.nodes_df, self.edges_df, self.diagnostics_df, self.graphs_df, self.annotations_df)))

    # -- selection -------------------------------------------------------------------------------------

    def nodes(self, kind: Kinds = None, annotated: tuple | None = None) -> DataFrame:
        """Nodes of these kinds; annotated: (namespace, key, value) that they carry. Unknown kinds select nothing."""
        out, kinds = self.nodes_df, selector(kind)
        if kinds is not None:
            out = out.where(F.col("kind").isin(kinds))
        if annotated is not None:
            out = out.join(annotate.nodes_with(self.annotations_df, *annotated), ["graph_key", "node_id"], "left_semi")
        return out

    def edges(self, kind: Kinds = None, warrant: Kinds = None) -> DataFrame:
        out = self.edges_df
        for column, chosen in (("kind", selector(kind)), ("warrant", selector(warrant))):
            if chosen is not None:
                out = out.where(F.col(column).isin(chosen))
        return out

    def node(self, node_id: str) -> DataFrame:
        return self.nodes_df.where(F.col("node_id") == node_id)

    def count(self) -> DataFrame:
        return self.nodes_df.groupBy("graph_key").agg(F.count(F.lit(1)).alias("n"))

    def topo_order(self) -> DataFrame:
        return self.nodes_df.select("graph_key", "pos", "node_id").orderBy("graph_key", "pos")

    def with_content(self, side: str = "inputs") -> DataFrame:
        return self.nodes_df.where(has_content(F.col(side)))

    def _around(self, node_id: str, kinds: Kinds, at: str, to: str) -> DataFrame:
        e = self.edges(kinds).where(F.col(at) == node_id)
        first = e.groupBy("graph_key", F.col(to).alias("node_id")).agg(F.min(F.struct("kind", "src", "dst", "basis")).alias("_k"))
        return first.orderBy("graph_key", "_k").drop("_k")

    def children(self, node_id: str, edge_kinds: Kinds = "parent") -> DataFrame:
        return self._around(node_id, edge_kinds, "src", "dst")

    def parents(self, node_id: str, edge_kinds: Kinds = "parent") -> DataFrame:
        return self._around(node_id, edge_kinds, "dst", "src")

    def roots(self) -> DataFrame:
        below = self.edges("parent").select("graph_key", F.col("dst").alias("node_id"))
        return self.nodes_df.join(below, ["graph_key", "node_id"], "left_anti")

    # -- traversal -------------------------------------------------------------------------------------

    def _starts(self, node_id: str | DataFrame) -> DataFrame:
        """Starts (graph_key, start): a frame of them, or an id in each graph that has it as an end of an edge."""
        if isinstance(node_id, DataFrame):
            return node_id
        ends = self.edges_df.select("graph_key", F.explode(F.array("src", "dst")).alias("start"))
        return ends.where(F.col("start") == node_id).distinct()

    def descendants(self, node_id: str | DataFrame, edge_kinds: Kinds = "parent") -> DataFrame:
        return traverse.breadth_first(self.edges_df, self._starts(node_id), selector(edge_kinds))

    def ancestors(self, node_id: str | DataFrame, edge_kinds: Kinds = "parent") -> DataFrame:
        return traverse.breadth_first(self.edges_df, self._starts(node_id), selector(edge_kinds), backward=True)

    def reachable(self, node_id: str | DataFrame, edge_kinds: Kinds = None) -> DataFrame:
        return traverse.breadth_first(self.edges_df, self._starts(node_id), selector(edge_kinds))

    def paths(self, src: str, dst: str, edge_kinds: Kinds = None, max_length: int | None = None) -> DataFrame:
        return traverse.simple_paths(self.edges_df, src, dst, selector(edge_kinds), max_length)

    # -- projection and annotation ---------------------------------------------------------------------

    def subgraph(self, edge_kinds: Kinds) -> TraceGraphs:
        """All nodes, and the edges of these kinds; edge counts follow."""
        return replace(self, edges_df=self.edges(edge_kinds))

    def one(self, graph_key: str) -> TraceGraphs:
        own = lambda df: df.where(F.col("graph_key") == graph_key)
        return TraceGraphs(*map(own, (self.nodes_df, self.edges_df, self.diagnostics_df, self.graphs_df, self.annotations_df)))

    def annotate(self, node_id: str, namespace: str, key: str, value) -> TraceGraphs:
        """These graphs with the value at (namespace, node, key), in each graph that has the node."""
        text = annotate.checked_value(namespace, value)
        at = self.nodes_df.where(F.col("node_id") == node_id).select("graph_key", F.lit(namespace).alias("namespace"), "node_id", F.lit(key).alias("key"), F.lit(text).alias("value_json"))
        if at.isEmpty():
            raise ValueError(f"there is no node {node_id!r}")
        return replace(self, annotations_df=annotate.replaced(self.annotations_df, at))

    def annotate_all(self, entries: DataFrame, order: str) -> TraceGraphs:
        """These graphs with all entries (ANNOTATIONS columns and one to order by); of one key's the last by order. ValueError, and
        nothing is taken, if any has what annotate() refuses; `annotate.refusals` lists those."""
        made = settled(annotate.canonical_values(entries))
        for r in annotate.refusals(made, self.nodes_df).limit(1).collect():
            raise ValueError(f"{r['refused']}: {r['namespace']!r}, node {r['node_id']!r} of {r['graph_key']!r}, key {r['key']!r}")
        return replace(self, annotations_df=annotate.replaced(self.annotations_df, annotate.latest(made, order)))

    def annotations(self) -> DataFrame:
        return self.annotations_df.orderBy("graph_key", "namespace", "node_id", "key")

    def annotations_of(self, namespace: str) -> DataFrame:
        return annotate.of_nodes(self.annotations_df, namespace)

    def diagnostics(self) -> DataFrame:
        return self.diagnostics_df.orderBy("graph_key", *diag.ordered(self.diagnostics_df))

    @cached_property
    def meta(self) -> DataFrame:
        """graphs with node_count, edge_count and diagnostic_count, of what these graphs hold now."""
        out = self.graphs_df
        for name, df in (("node", self.nodes_df), ("edge", self.edges_df), ("diagnostic", self.diagnostics_df)):
            n = df.groupBy("graph_key").agg(F.count(F.lit(1)).alias(f"{name}_count"))
            out = out.join(n, "graph_key", "left").na.fill(0, [f"{name}_count"])
        return out


def accepted(spans: DataFrame, *, adapter: str = "tables", version: str = "0.1.0", graphs: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, bool]:
    """(spans with node ids of the inputs that are not refused, the table of graphs, majority traces, refused inputs, whether spans are
    joined or dealt for it): all that tells which graphs there are, and none of their edges. See build_graphs."""
    null = lambda kind="string": F.lit(None).cast(kind)
    if graphs is None:
        graphs = spans.select("graph_key").distinct().select(
            "graph_key", null().alias("source_digest"), F.lit(adapter).alias("adapter_id"), F.lit(version).alias("adapter_version"),
            null("double").alias("declared_confidence"), null().alias("error_code"), null().alias("error_message"),
        )
        spans = spans.withColumn("adapter_id", F.lit(adapter)).withColumn("adapter_version", F.lit(version))
    elif "adapter_id" not in spans.columns:
        spans = spans.join(graphs.where("error_code is null").select("graph_key", "adapter_id", "adapter_version"), "graph_key")
    traces = stored(identity.majority_trace(spans), "traces")
    odd = identity.any_odd(spans)
    ided = identity.identified(spans, traces, F.col("adapter_id"), odd)
    clash = identity.collisions(ided)
    refused = stored(clash.groupBy("graph_key").agg(F.min("node_id").alias("id")), "refused")
    clashes = not refused.isEmpty()
    if clashes:
        ided = ided.join(refused, "graph_key", "left_anti")
    said = F.concat(F.lit("two records resolve to the node id "), F.col("id"))
    stated = graphs.join(refused, "graph_key", "left").join(traces, "graph_key", "left")
    code = F.coalesce("error_code", F.when(F.col("id").isNotNull(), "duplicate_node_id"))
    graphs = stated.withColumn("error_code", code).withColumn("error_message", F.coalesce("error_message", said)).withColumn("trace_id", F.coalesce("trace_id", F.lit("")))
    types = F.when(F.col("error_code") == "duplicate_node_id", "DuplicateNodeIdError").when(F.col("error_code") == "unknown_adapter", "UnknownAdapterError")
    return ided, graphs.withColumn("error_type", types.when(F.col("error_code").isNotNull(), "AdapterSelectionError")).drop("id"), traces, refused, odd or clashes


def build_graphs(
    spans: DataFrame, *, adapter: str = "tables", version: str = "0.1.0", temporal: bool = True, graphs: DataFrame | None = None,
    malformed: DataFrame | None = None, slices: int | None = None, written: bool = False,
) -> TraceGraphs:
    """All graphs of spans (see schema.SPANS). graphs: a row an input, with its adapter or its refusal; spans that have the columns
    adapter_id and adapter_version themselves are all of inputs that are not refused. malformed: diagnostics of unreadable lines;
    temporal=False leaves out the derived edges and what is said about them; slices: see edges.siblings; written: spans are a written table."""
    ided, graphs, traces, refused, moved = accepted(spans, adapter=adapter, version=version, graphs=graphs)
    if moved or not written:
        ided = stored(ided, "spans")  # many branches read it
    nodes = ided.select(
        "graph_key", "node_id", "kind", "name", "operation", "started_at", "ended_at", "status", "status_note", "inputs", "outputs", "usage",
        "attributes_json", "raw_json", F.col("span_id").alias("source_id"), "adapter_id", "adapter_version", "dialect_note", "record_index",
    )
    parents = edge.parents(ided)
    sides = edge.call_sides(ided)
    parent = edge.parent_edges(parents)
    calls = edge.call_result_edges(sides)
    late = edge.temporal_edges(nodes, parent, slices) if temporal else None
    edges = edge.all_edges(parent, calls, edge.data_edges(ided, sides), edge.link_edges(ided), late)
    place, cycle = order.positions(nodes.select("graph_key", "node_id", "started_at"), parent.unionByName(calls))
    found = [diag.of_spans(ided), diag.foreign_traces(ided, traces), diag.backward_time(ided), diag.duplicate_source_ids(ided), diag.orphans(parents), diag.unpaired_calls(sides), diag.cycles(cycle)]
    if temporal:
        found.append(diag.missing_starts(nodes))
    if malformed is not None:
        found.append(malformed.join(refused, "graph_key", "left_anti"))
    said = found[0]
    for more in found[1:]:
        said = said.unionByName(more)
    empty = spans.sparkSession.createDataFrame([], ANNOTATIONS)
    return TraceGraphs(nodes.join(place, ["graph_key", "node_id"]), edges, said, graphs, empty)


def build_all(spark: SparkSession, *sources: str | bytes | Path, adapter: str | None = None, temporal: bool = True, registry: Registry | None = None) -> TraceGraphs:
    """The graphs of all sources; refused ones are rows of graphs."""
    rows = stored(reader.parsed(reader.inputs(spark, *sources), adapter, registry), "parsed")  # the parse runs once
    return build_graphs(reader.spans_of(rows), graphs=reader.graphs_of(rows), malformed=reader.malformed_of(rows), temporal=temporal, written=True)


def build(spark: SparkSession, source: str | bytes | Path, *, adapter: str | None = None, temporal: bool = True, registry: Registry | None = None) -> TraceGraphs:
    """The graph of one source, settled; raises what refuses it."""
    out = build_all(spark, source, adapter=adapter, temporal=temporal, registry=registry).settled()
    for r in out.graphs_df.where("error_code is not null").limit(1).collect():
        raise error_of(r["error_code"], r["error_message"])
    return out


__all__ = ["TraceGraphs", "build", "build_all", "build_graphs", "selector", "DuplicateNodeIdError", "STATED_KINDS"]
