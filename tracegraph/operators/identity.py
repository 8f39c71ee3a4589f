"""Node ids: a span's own id where it is unique in its input, else one derived from its source key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import derived_id
from ..schema import DERIVED_PREFIX


def majority_trace(spans: DataFrame) -> DataFrame:
    """(graph_key, trace_id): the most frequent trace id of each input, the least of equals; null if it has none."""
    counts = spans.groupBy("graph_key", "trace_id").agg(F.count("trace_id").alias("n"))
    return counts.groupBy("graph_key").agg(F.min_by("trace_id", F.when(F.col("trace_id").isNotNull(), F.struct(-F.col("n"), F.col("trace_id")))).alias("trace_id"))


def any_odd(spans: DataFrame) -> bool:
    """Whether any span may have no id of its own: none is given, or two have ids of one hash."""
    claims = spans.groupBy(F.xxhash64("graph_key", "span_id").alias("h")).agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.col("span_id").isNull()).alias("none"))
    return not claims.where("n > 1 or none").isEmpty()


def identified(spans: DataFrame, traces: DataFrame, adapter: Column, odd: bool | None = None) -> DataFrame:
    """spans with node_id and unique (whether span_id names this span alone). traces: majority_trace() of the inputs.

    adapter: a column of the adapter's id, a literal or of spans itself. Claims are counted at once, by hashes of ids: where no two are
    equal, no span has to move (odd: what any_odd() says of them, where it is known). Else the claims of an id are counted beside its spans, and those whose id is derived meet their input's trace."""
    if not (any_odd(spans) if odd is None else odd):
        return spans.select("*", F.lit(True).alias("unique"), F.col("span_id").alias("node_id"))
    n = F.count(F.lit(1)).over(W.partitionBy("graph_key", "span_id"))
    counted = spans.select("*", ((n == 1) & F.col("span_id").isNotNull()).alias("unique"))
    own = counted.where("unique").select("*", F.col("span_id").alias("node_id"))
    rest = counted.where("not unique").join(traces.withColumnRenamed("trace_id", "_majority"), "graph_key", "left")
    made = rest.select(*counted.columns, derived_id(adapter, F.col("_majority"), F.col("source_key")).alias("node_id"))
    return own.unionByName(made)


def collisions(ided: DataFrame) -> DataFrame:
    """(graph_key, node_id): ids that two records of an input resolve to; such an input is refused. A span id that names one span
    alone can meet a derived id only, and so only where it looks like one."""
    met = ided.where(~F.col("unique") | F.col("node_id").startswith(DERIVED_PREFIX))
    return met.groupBy("graph_key", "node_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("graph_key", "node_id")


def references(ided: DataFrame) -> DataFrame:
    """(graph_key, ref, ref_node): what a span id refers to; ids claimed twice refer to nothing."""
    return ided.where("unique").select("graph_key", F.col("span_id").alias("ref"), F.col("node_id").alias("ref_node"))
