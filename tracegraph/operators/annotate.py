"""Annotations: (graph_key, namespace, node_id, key) -> JSON value, kept beside the graph and never in a node."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions import canonical_json

RESERVED = "tracegraph"
KEY = ["graph_key", "namespace", "node_id", "key"]


def checked_value(namespace: str, value) -> str:
    """The value as JSON text; ValueError for a namespace or value that is not allowed."""
    if not namespace:
        raise ValueError("an annotation needs a namespace")
    if namespace == RESERVED or namespace.startswith(f"{RESERVED}."):
        raise ValueError(f"the namespace {namespace!r} is reserved")
    try:
        return canonical_json(value)
    except (TypeError, ValueError) as error:
        raise ValueError(f"the value is no JSON: {error}") from error


def canonical_values(entries: DataFrame) -> DataFrame:
    """entries with value_json as canonical JSON text; null where it is none."""
    schema = entries.schema
    at = entries.columns.index("value_json")

    def one(text):
        try:
            return None if text is None else canonical_json(json.loads(text))
        except (ValueError, RecursionError):
            return None

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            yield batch.set_column(at, "value_json", pa.array([one(x) for x in batch.column(at).to_pylist()], pa.string()))

    return entries.mapInArrow(run, schema)


def refusals(entries: DataFrame, nodes: DataFrame) -> DataFrame:
    """entries (canonical) that annotate() would refuse, with the reason in `refused`."""
    space = F.coalesce("namespace", F.lit(""))
    reason = (
        F.when(space == "", "an annotation needs a namespace").when((space == RESERVED) | space.startswith(f"{RESERVED}."), "the namespace is reserved")
        .when(F.col("value_json").isNull(), "the value is no JSON").when(F.col("_known").isNull(), "there is no such node")
    )
    known = nodes.select("graph_key", "node_id", F.lit(True).alias("_known"))
    return entries.join(known, ["graph_key", "node_id"], "left").withColumn("refused", reason).where("refused is not null").drop("_known")


def latest(entries: DataFrame, order: str) -> DataFrame:
    """One entry a key, the last by `order`."""
    rank = F.row_number().over(W.partitionBy(*KEY).orderBy(F.col(order).desc()))
    return entries.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def replaced(old: DataFrame, new: DataFrame) -> DataFrame:
    """old with the entries of new, which win where both have a key."""
    return old.join(new, KEY, "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def of_nodes(entries: DataFrame, namespace: str) -> DataFrame:
    """(graph_key, node_id, values map<key, json>) of a namespace."""
    pairs = F.array_sort(F.collect_list(F.struct("key", "value_json")))
    return entries.where(F.col("namespace") == namespace).groupBy("graph_key", "node_id").agg(F.map_from_entries(pairs).alias("values"))


def nodes_with(entries: DataFrame, namespace: str, key: str, value) -> DataFrame:
    """(graph_key, node_id) whose value is equal as canonical JSON, so 1 and true differ."""
    same = (F.col("namespace") == namespace) & (F.col("key") == key) & (F.col("value_json") == canonical_json(value))
    return entries.where(same).select("graph_key", "node_id").distinct()
