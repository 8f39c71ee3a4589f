"""Tallies of one or many graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..schema import NODE_KINDS, NO_NODE, NOT_HERE, UNNAMED


def tallies(nodes: DataFrame, edges: DataFrame, diagnostics: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by..., what, label, n): nodes by kind, edges by kind and warrant, payloads by state, diagnostics by code.

    The nodes are read once: kind, input and output state are grouping sets of one aggregate."""
    by = by or []
    wide = nodes.select(*by, "kind", F.col("inputs.state").alias("i"), F.col("outputs.state").alias("o"))
    sets = [[*map(F.col, by), F.col(c)] for c in ("kind", "i", "o")]
    g = wide.groupingSets(sets, *map(F.col, by), F.col("kind"), F.col("i"), F.col("o")).agg(
        F.count(F.lit(1)).alias("n"), F.grouping("kind").alias("gk"), F.grouping("i").alias("gi")
    )
    what = F.when(F.col("gk") == 0, "nodes").when(F.col("gi") == 0, "inputs").otherwise("outputs")
    out = g.select(*by, what.alias("what"), F.coalesce("kind", "i", "o").alias("label"), "n")
    label = F.concat(F.col("kind"), F.lit(" ("), F.col("warrant"), F.lit(")"))
    out = out.unionByName(edges.groupBy(*by, label.alias("label")).agg(F.count(F.lit(1)).alias("n")).withColumn("what", F.lit("edges")))
    out = out.unionByName(diagnostics.groupBy(*by, F.col("code").alias("label")).agg(F.count(F.lit(1)).alias("n")).withColumn("what", F.lit("diagnostics")))
    return out.select(*by, "what", "label", F.col("n").cast("long").alias("n"))


def counts(graphs: DataFrame) -> DataFrame:
    """One row: given, built, unbuildable, distinct_trace_ids."""
    built = F.col("error_code").isNull()
    return graphs.agg(
        F.count(F.lit(1)).alias("given"), F.count_if(built).alias("built"), F.count_if(~built).alias("unbuildable"), F.countDistinct(F.when(built, F.col("trace_id"))).alias("distinct_trace_ids")
    )


def node_kinds(nodes: DataFrame) -> DataFrame:
    """(kind, n) for every kind there is, zeros too."""
    all_kinds = nodes.sparkSession.createDataFrame([(k,) for k in NODE_KINDS], "kind string")
    n = nodes.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
    return all_kinds.join(n, "kind", "left").select("kind", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def diagnostic_counts(diagnostics: DataFrame) -> DataFrame:
    return diagnostics.groupBy("code").agg(F.count(F.lit(1)).alias("n"))


def tools(nodes: DataFrame) -> DataFrame:
    """(operation, calls, errors, ok, unset) of tool nodes that name one."""
    of = lambda s: F.count_if(F.col("status") == s)
    named = nodes.where("kind = 'tool' and operation is not null")
    return named.groupBy("operation").agg(F.count(F.lit(1)).alias("calls"), of("error").alias("errors"), of("ok").alias("ok"), of("unset").alias("unset"))


def models(nodes: DataFrame) -> DataFrame:
    return nodes.where("kind = 'llm' and operation is not null").groupBy("operation").agg(F.count(F.lit(1)).alias("n"))


def askers(nodes: DataFrame, diagnostics: DataFrame, code: str = "unpaired_call") -> DataFrame:
    """(asker, n): which model's requests were left open; what was asked for is not in the graph."""
    some = diagnostics.where(F.col("code") == code).select("graph_key", "node_id")
    known = nodes.select("graph_key", "node_id", "operation", "kind")
    name: Column = (
        F.when(F.col("node_id").isNull(), NO_NODE)
        .when(F.col("kind").isNull(), NOT_HERE)
        .otherwise(F.coalesce(F.nullif("operation", F.lit("")), F.format_string(UNNAMED, F.col("kind"))))
    )
    return some.join(known, ["graph_key", "node_id"], "left").groupBy(name.alias("asker")).agg(F.count(F.lit(1)).alias("n"))


def failures(graphs: DataFrame) -> DataFrame:
    return graphs.where(F.col("error_code").isNotNull()).select("graph_key", "error_code", "error_type", "error_message").orderBy("graph_key")


SHAPES = ("tool_call", "no_tool_call", "parallel", "failing", "nested", "retrieves")
VARIED = "varied_tools"


def shapes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_key, tools, and a boolean for each of SHAPES): what each graph shows; parallel: a node asked for several calls that were answered."""
    n = nodes.groupBy("graph_key").agg(
        F.sort_array(F.collect_set(F.when(F.col("kind") == "tool", F.col("operation")))).alias("tools"), F.bool_or(F.col("status") == "error").alias("failing"),
        (F.count_if(F.col("kind") == "agent") > 1).alias("nested"), F.bool_or(F.col("kind") == "retriever").alias("retrieves"),
        F.bool_or(F.col("kind") == "tool").alias("tool_call"), (~F.bool_or(F.col("kind") == "tool")).alias("no_tool_call"),
    )
    fan = edges.where("kind = 'call_result'").groupBy("graph_key", "src").agg(F.count(F.lit(1)).alias("c")).groupBy("graph_key").agg((F.max("c") > 1).alias("parallel"))
    return n.join(fan, "graph_key", "left").withColumn("parallel", F.coalesce("parallel", F.lit(False)))


def coverage(shapes_: DataFrame) -> DataFrame:
    """(shape, graphs): how many graphs show each shape, zeros too. Tools are varied if the graphs use more than one between
    them; then each graph with a tool shows it."""
    used = shapes_.select(F.explode("tools").alias("tool")).agg((F.countDistinct("tool") > 1).alias("many"))
    one = shapes_.agg(*[F.count_if(F.col(c)).alias(c) for c in SHAPES], F.count_if(F.size("tools") > 0).alias("with_tools"))
    both = one.crossJoin(used).withColumn(VARIED, F.when(F.col("many"), F.col("with_tools")).otherwise(F.lit(0).cast("long")))  # a row each
    return both.select(*SHAPES, VARIED).unpivot([], [*SHAPES, VARIED], "shape", "graphs")


def showing(shapes_: DataFrame) -> DataFrame:
    """(shape, graph_key): the graphs behind each count of coverage()."""
    each = shapes_.select("graph_key", "tools", F.explode(F.array(*[F.when(F.col(c), F.lit(c)) for c in SHAPES])).alias("shape"))
    out = each.where("shape is not null").select("shape", "graph_key")
    used = shapes_.select(F.explode("tools").alias("tool")).agg((F.countDistinct("tool") > 1).alias("many")).where("many")
    varied = shapes_.where(F.size("tools") > 0).crossJoin(F.broadcast(used)).select(F.lit(VARIED).alias("shape"), "graph_key")  # by one row, or none
    return out.unionByName(varied)


def missing(shapes_: DataFrame, wanted=(*SHAPES, VARIED)) -> DataFrame:
    """(shape): those wanted that no graph shows."""
    return coverage(shapes_).where(F.col("shape").isin(*wanted) & (F.col("graphs") == 0)).select("shape")


def usage_up_the_tree(nodes: DataFrame, descendants: DataFrame) -> DataFrame:
    """(graph_key, start, input_tokens, output_tokens): what a start and all below it used, as reported."""
    u = nodes.where(F.col("usage").isNotNull()).select("graph_key", "node_id", "usage.input_tokens", "usage.output_tokens")
    below = descendants.select("graph_key", "start", "node_id").unionByName(descendants.select("graph_key", "start", F.col("start").alias("node_id")).distinct())
    return below.join(u, ["graph_key", "node_id"]).groupBy("graph_key", "start").agg(F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"))
