"""Edges: what the telemetry states (parent, call_result, data, link) and the order of siblings (temporal).

Every join is on ids that the input declares, within one input; nothing is matched by name, time or value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..schema import CALL_BASIS, PARENT_BASIS, RECEIVED_BASIS, TEMPORAL_BASIS, TIED_BASIS, WARRANTS
from .identity import references


def _edges(df: DataFrame, src: str, dst: str, kind: str, basis: Column, adapter: Column | None) -> DataFrame:
    return df.select(
        "graph_key", F.col(src).alias("src"), F.col(dst).alias("dst"), F.lit(kind).alias("kind"), F.lit(WARRANTS[kind]).alias("warrant"),
        basis.alias("basis"), (F.lit(None).cast("string") if adapter is None else adapter).alias("adapter"),
    )


GROUP = 1_000_000  # siblings that one task sorts, about
_ROWS = 500_000  # spans of a task where graphs stay whole


def sizes_of(nodes: DataFrame) -> tuple[int, int]:
    """(nodes of the largest graph, all nodes), from counts that are summed before they move."""
    n = nodes.groupBy("graph_key").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n"), F.sum("n")).first()
    return n[0] or 0, n[1] or 0


def parts_for(spark: SparkSession, rows: int) -> int:
    """Tasks for graphs that are dealt whole: those of any shuffle, and more where tasks would get more than `_ROWS` spans."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // _ROWS))


def _met(ided: DataFrame, columns: list[str], sizes: tuple[int, int]) -> DataFrame:
    """(graph_key, columns, parent_id, ref_node): every span with the node that its parent_id names; ref_node null: none, or not in the input.

    Where graphs have `GROUP` spans at most, spans are dealt by graph, once: each goes to the id it names as its parent, and to its own id
    to tell that it is there, within its task; so siblings are then where they are sorted. In larger graphs ids are joined."""
    child = F.col("parent_id").isNotNull()
    refs = references(ided)
    if sizes[0] > GROUP:
        stated = ided.where(child).select("graph_key", *columns, "parent_id").join(refs.withColumnRenamed("ref", "parent_id"), ["graph_key", "parent_id"], "left")
        rest = ided.where(~child).select("graph_key", *columns, "parent_id", F.lit(None).cast("string").alias("ref_node"))
        return stated.select(*rest.columns).unionByName(rest)
    own = F.col("unique") & F.col("span_id").isNotNull()  # see identity.references: its id then is its node's
    each = ided.select("graph_key", *columns, "parent_id", F.when(own, F.col("span_id")).alias("own")).repartition(parts_for(ided.sparkSession, sizes[1]), "graph_key")
    both = F.explode(F.when(child, F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(True)))).alias("span")  # itself, and what tells of it
    rows = each.select("graph_key", *columns, "parent_id", "own", both)
    tells = F.when(child, ~F.col("span")).otherwise(True) & F.col("own").isNotNull()
    slim = [F.when(F.col("span"), F.col(c)).alias(c) for c in columns]
    at = F.when(F.col("span"), F.coalesce("parent_id", "own")).otherwise(F.col("own"))
    rows = rows.select("graph_key", *slim, "span", F.when(F.col("span"), F.col("parent_id")).alias("parent_id"), at.alias("at"), tells.alias("tells"))
    here = F.bool_or("tells").over(W.partitionBy("graph_key", "at"))
    found = rows.where("span or tells").select("*", here.alias("here")).where("span")
    return found.select("graph_key", *columns, "parent_id", F.when(F.col("here"), F.col("parent_id")).alias("ref_node"))


def parents(ided: DataFrame) -> DataFrame:
    """(graph_key, node_id, parent_id, ref_node): spans that state a parent; ref_node null: it is not in the input."""
    return _met(ided, ["node_id", "adapter_id"], sizes_of(ided)).where("parent_id is not null")


def placed(ided: DataFrame, sizes: tuple[int, int] | None = None) -> DataFrame:
    """(graph_key, node_id, started_at, parent): every span with its parent in the input, null at the root."""
    return _met(ided, ["node_id", "started_at"], sizes or sizes_of(ided)).withColumnRenamed("ref_node", "parent").drop("parent_id")


def parent_edges(parents_: DataFrame) -> DataFrame:
    return _edges(parents_.where(F.col("ref_node").isNotNull()), "ref_node", "node_id", "parent", F.lit(PARENT_BASIS), F.col("adapter_id"))


def call_sides(ided: DataFrame) -> DataFrame:
    """(graph_key, call_id, call_role, node_id): a row for each call that a span asks for or answers."""
    return ided.where(F.col("call_role").isNotNull()).select("graph_key", F.explode("call_ids").alias("call_id"), "call_role", "node_id", "adapter_id")


def call_result_edges(sides: DataFrame) -> DataFrame:
    """Every requester of a call to every fulfiller of it; once, however many calls they share."""
    asked = sides.where("call_role = 'requester'").select("graph_key", "call_id", F.col("node_id").alias("src"), "adapter_id")
    answered = sides.where("call_role = 'fulfiller'").select("graph_key", "call_id", F.col("node_id").alias("dst"))
    once = asked.join(answered, ["graph_key", "call_id"]).groupBy("graph_key", "src", "dst").agg(F.min("adapter_id").alias("adapter_id"))
    return _edges(once, "src", "dst", "call_result", F.lit(CALL_BASIS), F.col("adapter_id"))


def unpaired(sides: DataFrame, role: str) -> DataFrame:
    """The sides of this role whose call has no other side."""
    other = sides.where(F.col("call_role") != role).select("graph_key", "call_id")
    return sides.where(F.col("call_role") == role).join(other, ["graph_key", "call_id"], "left_anti")


def link_edges(ided: DataFrame) -> DataFrame:
    """To the node a link names, or to the id itself where it lies outside the input."""
    each = ided.select("graph_key", "node_id", "adapter_id", F.explode("links").alias("link"))
    each = each.select("graph_key", "node_id", "adapter_id", F.col("link.span_id").alias("ref"), F.col("link.basis").alias("basis"))
    hit = each.join(references(ided), ["graph_key", "ref"], "left").withColumn("to", F.coalesce("ref_node", "ref"))
    return _edges(hit, "node_id", "to", "link", F.col("basis"), F.col("adapter_id"))


def data_edges(ided: DataFrame, sides: DataFrame) -> DataFrame:
    """Declared data edges, and from whatever answered a call to the spans that were shown its result."""
    refs = references(ided)
    each = ided.select("graph_key", "adapter_id", F.explode("data_edges").alias("e")).select("graph_key", "adapter_id", "e.src", "e.dst", "e.basis")
    for end in ("src", "dst"):
        hit = refs.select("graph_key", F.col("ref").alias(end), F.col("ref_node").alias(f"{end}_node"))
        each = each.join(hit, ["graph_key", end], "left")
    declared = each.withColumn("from", F.coalesce("src_node", "src")).withColumn("to", F.coalesce("dst_node", "dst"))
    shown = ided.select("graph_key", "node_id", "adapter_id", F.explode("received_call_ids").alias("call_id"))
    made = sides.where("call_role = 'fulfiller'").select("graph_key", "call_id", F.col("node_id").alias("maker"))
    given = shown.join(made, ["graph_key", "call_id"]).where("maker <> node_id")
    return _edges(declared, "from", "to", "data", F.col("basis"), F.col("adapter_id")).unionByName(
        _edges(given, "maker", "node_id", "data", F.lit(RECEIVED_BASIS), F.col("adapter_id"))
    )


def slices_for(nodes: DataFrame, parent: DataFrame) -> int:
    """How many slices the largest group of siblings wants; from counts alone, which are summed before they move. No group has more
    nodes than its graph, so the groups themselves are counted only where a graph is that large."""
    largest = lambda df, *by: df.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    every = largest(nodes, "graph_key")
    if every <= GROUP:
        return 1
    rooted = nodes.join(parent.select("graph_key", F.col("dst").alias("node_id")), ["graph_key", "node_id"], "left_anti")
    return max(1, -(-max(largest(parent, "graph_key", "src"), largest(rooted, "graph_key")) // GROUP))


def siblings_of(ided: DataFrame, slices: int | None = None) -> DataFrame:
    """siblings() of spans with ids: their parents are found, and they are sorted, in one go."""
    sizes = sizes_of(ided)
    at = placed(ided, sizes)
    if slices is None:
        slices = 1 if sizes[0] <= GROUP else max(1, -(-(at.groupBy("graph_key", "parent").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0) // GROUP))
    return siblings(at, None, slices, starts=ided, together=sizes[0] <= GROUP)


def siblings(nodes: DataFrame, parent: DataFrame | None, slices: int | None = 1, starts: DataFrame | None = None, together: bool = False) -> DataFrame:
    """(graph_key, node_id, next_id, tied): each node with a start and the sibling after it, by start and id.

    nodes: graph_key, node_id, started_at. parent: graph_key, src, dst edges; nodes without one are siblings at
    the root. With slices > 1 each group of siblings is also cut at that many quantiles of all starts, so that one
    huge group is sorted by many tasks; the last of a slice meets the first of the next. None: as many as slices_for says.
    parent None: nodes have a column parent (see placed). starts: what the quantiles are taken from, the nodes by default. together: a graph
    lies in one task already, so slices meet there.
    """
    slices = slices_for(nodes, parent) if slices is None else slices
    nodes = nodes.where(F.col("started_at").isNotNull())
    known = nodes.select("graph_key", "node_id", "started_at")
    if parent is None:
        placed = nodes.select(*known.columns, "parent")
    else:
        placed = known.join(parent.select("graph_key", F.col("dst").alias("node_id"), F.col("src").alias("parent")), ["graph_key", "node_id"], "left")
    group, order = ["graph_key", "parent"], ["started_at", "node_id"]
    me = F.struct(*order)
    if slices <= 1:
        after = F.lead(me).over(W.partitionBy(*group).orderBy(*order))
        out = placed.withColumn("after", after)
    else:
        (bounds,) = (known if starts is None else starts.where(F.col("started_at").isNotNull())).agg(F.percentile_approx("started_at", [i / slices for i in range(1, slices)])).first()
        cuts = F.array(*map(F.lit, sorted(set(bounds)))) if bounds else F.expr("cast(array() as array<double>)")
        cut_up = placed.withColumn("slice", F.size(F.filter(cuts, lambda b: b <= F.col("started_at"))))
        near = cut_up.withColumn("near", F.lead(me).over(W.partitionBy(*group, "slice").orderBy(*order)))
        if together:
            beyond = F.min(me).over(W.partitionBy(*group).orderBy("slice").rangeBetween(1, W.unboundedFollowing))
            return _following(near.withColumn("after", F.coalesce("near", beyond)))
        firsts = cut_up.groupBy(*group, "slice").agg(F.min(me).alias("first"))
        following = firsts.withColumn("beyond", F.lead("first").over(W.partitionBy(*group).orderBy("slice"))).select(
            *[F.col(c).alias(f"_{c}") for c in (*group, "slice")], "beyond"
        )
        same = (F.col("graph_key") == F.col("_graph_key")) & F.col("parent").eqNullSafe(F.col("_parent")) & (F.col("slice") == F.col("_slice"))
        out = near.join(following, same).withColumn("after", F.coalesce("near", "beyond"))
    return _following(out)


def _following(out: DataFrame) -> DataFrame:
    found = out.where(F.col("after").isNotNull())
    return found.select("graph_key", "node_id", F.col("after.node_id").alias("next_id"), (F.col("started_at") == F.col("after.started_at")).alias("tied"))


def temporal_edges(nodes: DataFrame, parent: DataFrame, slices: int | None = 1) -> DataFrame:
    return _temporal(siblings(nodes, parent, slices))


def temporal_of(ided: DataFrame, slices: int | None = None) -> DataFrame:
    """temporal_edges() of spans with ids; see siblings_of."""
    return _temporal(siblings_of(ided, slices))


def _temporal(pairs: DataFrame) -> DataFrame:
    return _edges(pairs, "node_id", "next_id", "temporal", F.when(F.col("tied"), TIED_BASIS).otherwise(TEMPORAL_BASIS), None)


def all_edges(parent: DataFrame, calls: DataFrame, data: DataFrame, links: DataFrame, temporal: DataFrame | None) -> DataFrame:
    """One row for each (src, dst, kind, basis): a node has one parent and one sibling after it at most, and call_result_edges
    gives a pair once, so only the others can repeat."""
    once = ["graph_key", "src", "dst", "kind", "basis"]
    out = parent.unionByName(calls).unionByName(data.unionByName(links).dropDuplicates(once))
    return out if temporal is None else out.unionByName(temporal)
