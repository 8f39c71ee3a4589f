"""Traversal over edges (graph_key, src, dst, kind, basis): breadth first by frontier, simple paths by growing them.

Each level is a join of the frontier with the edges; what is visited is written to the shared folder, so the
plan stays short however deep the graph. Closures are made on demand, never stored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.storage import settled, stored


def _of(edges: DataFrame, kinds) -> DataFrame:
    return edges if kinds is None else edges.where(F.col("kind").isin(*kinds))


MERGED = 16  # tables of levels that a plan holds


def _chains(e: DataFrame, starts: DataFrame) -> DataFrame | None:
    """(graph_key, start, chain array<string>): what each start reaches, in order, where a node leads to one other at most; None where
    some node leads to several.

    e: graph_key, at, to. What a node reaches is the next node and what that reaches, so it is found for the nodes that are next to
    any start first (far fewer, where many starts share them), and so on up; each start then meets its next node's chain once.
    Edges and starts meet in one aggregate."""
    null = F.lit(None).cast("string")
    both = e.select("graph_key", "at", "to", F.lit(False).alias("is")).unionByName(starts.select("graph_key", F.col("start").alias("at"), null.alias("to"), F.lit(True).alias("is")))
    known = both.groupBy("graph_key", "at").agg(F.min("to").alias("to"), F.max("to").alias("other"), F.bool_or("is").alias("is"))
    known = stored(known, "nexts")
    if not known.where("to < other").isEmpty():
        return None
    nexts = known.where("to is not null").select("graph_key", "at", "to")
    nexts = stored(nexts.join(nexts.select("graph_key", F.col("to").alias("at")).distinct(), ["graph_key", "at"], "left_semi"), "inner")  # all that rounds ask for
    rounds = [known.where("is").select("graph_key", F.col("at").alias("start"), "to")]
    count = rounds[0].count()
    while True:
        above = rounds[-1].where("to is not null").select("graph_key", F.col("to").alias("start")).distinct()
        found = stored(above.join(nexts.withColumnRenamed("at", "start"), ["graph_key", "start"], "left"), "nexts")
        n = found.count()
        if not n:
            chains = None
            break
        if 2 * n > count:  # they share too little: each on its own
            rows = _levels(nexts.select("graph_key", "at", "to", F.struct("to").alias("k")), found.select("graph_key", "start"))
            each = rows.groupBy("graph_key", "start").agg(F.transform(F.sort_array(F.collect_list(F.struct("depth", "node_id"))), lambda x: x["node_id"]).alias("chain"))
            chains = found.select("graph_key", "start").join(each, ["graph_key", "start"], "left")
            break
        rounds.append(found)
        count = n
    while rounds:
        own = rounds.pop()
        if chains is None:  # none of them leads on
            chains = own.select("graph_key", "start", F.expr("cast(null as array<string>)").alias("chain"))
            continue
        further = chains.select("graph_key", F.col("start").alias("to"), F.col("chain").alias("further"))
        on = F.concat(F.array("to"), F.coalesce("further", F.expr("cast(array() as array<string>)")))
        chain = F.when(F.col("to").isNotNull(), F.filter(on, lambda x: x != F.col("start")))  # on a cycle the last is the start itself
        chains = own.join(further, ["graph_key", "to"], "left").select("graph_key", "start", chain.alias("chain"))
        if rounds:
            chains = stored(chains, "chains")
    return chains


def breadth_first(edges: DataFrame, starts: DataFrame, kinds=("parent",), backward: bool = False, max_depth: int | None = None) -> DataFrame:
    """(graph_key, start, node_id, depth, rank): what each start (graph_key, start) reaches, itself excluded.

    rank is the place in a queue that takes the edges of a node by (kind, src, dst, basis). Towards the sources a node mostly has one
    edge; then starts share chains (see _chains). Else the edges are written once, by the node that a level asks for; a level is
    written once too, and read again to tell what is visited."""
    a, b = ("dst", "src") if backward else ("src", "dst")
    e = _of(edges, kinds).select("graph_key", F.col(a).alias("at"), F.col(b).alias("to"), F.struct("kind", "src", "dst", "basis").alias("k"))
    chains = _chains(e, starts) if backward and max_depth is None else None
    if chains is not None:
        each = chains.select("graph_key", "start", F.posexplode("chain").alias("rank", "node_id"))
        return each.select("graph_key", "start", "node_id", (F.col("rank") + 1).alias("depth"), F.col("rank").cast("long").alias("rank"))
    e = stored(e.groupBy("graph_key", "at", "to").agg(F.min("k").alias("k")), "edges")
    return _levels(e, starts.select("graph_key", "start").distinct(), max_depth)


def _levels(e: DataFrame, start: DataFrame, max_depth: int | None = None) -> DataFrame:
    """breadth_first() over written edges (graph_key, at, to, k), a level of all starts at a time."""
    frontier = stored(start.select("*", F.col("start").alias("node_id"), F.lit(0).alias("depth"), F.lit(0).cast("long").alias("rank")), "level")
    levels, depth = [frontier], 0
    while max_depth is None or depth < max_depth:
        depth += 1
        if len(levels) > MERGED:
            levels = [stored(_all(levels), "level")]
        step = frontier.select("graph_key", "start", F.col("node_id").alias("at"), "rank").join(e, ["graph_key", "at"])
        step = step.groupBy("graph_key", "start", F.col("to").alias("node_id")).agg(F.min(F.struct("rank", "k")).alias("o"))
        new = step.join(_all(levels).select("graph_key", "start", "node_id"), ["graph_key", "start", "node_id"], "left_anti")
        order = W.partitionBy("graph_key", "start").orderBy("o")
        frontier = stored(new.select("graph_key", "start", "node_id", F.lit(depth).alias("depth"), F.row_number().over(order).cast("long").alias("rank")), "level")
        if frontier.isEmpty():
            break
        levels.append(frontier)
    found = _all(levels)
    # a level's ranks begin where those before it end: counts a level, not a sort of all
    counts = found.groupBy("graph_key", "start", "depth").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(W.partitionBy("graph_key", "start").orderBy("depth").rowsBetween(W.unboundedPreceding, -1))
    base = counts.withColumn("base", F.coalesce(before, F.lit(0)) - 2).drop("n")
    out = found.where("depth > 0").join(base, ["graph_key", "start", "depth"])
    return out.select("graph_key", "start", "node_id", "depth", (F.col("rank") + F.col("base")).alias("rank"))


def _all(levels: list[DataFrame]) -> DataFrame:
    out = levels[0]
    for more in levels[1:]:
        out = out.unionByName(more)
    return out


def simple_paths(edges: DataFrame, src: str, dst: str, kinds=None, max_length: int | None = None) -> DataFrame:
    """(graph_key, path array<string>, rank): all paths without repeated nodes, in the order of a depth-first search.

    Their number is exponential by nature. max_length: only paths of that many edges or fewer; else all, however long."""
    e = _of(edges, kinds).select("graph_key", F.col("src").alias("at"), F.col("dst").alias("to"), F.struct("kind", "src", "dst", "basis").alias("k"))
    e = settled(e.groupBy("graph_key", "at", "to").agg(F.min("k").alias("k")))
    live = settled(e.where((F.col("at") == src) & (F.col("to") != src)).select("graph_key", F.array("at", "to").alias("path"), F.array("k").alias("ranks")))
    arrived = lambda paths: paths.where(F.element_at("path", -1) == dst)
    found, length = [arrived(live)], 1
    while max_length is None or length < max_length:
        going = live.where(F.element_at("path", -1) != dst)
        step = going.withColumn("at", F.element_at("path", -1)).join(e, ["graph_key", "at"]).where(~F.array_contains("path", F.col("to")))
        live = settled(step.select("graph_key", F.concat("path", F.array("to")).alias("path"), F.concat("ranks", F.array("k")).alias("ranks")))
        length += 1
        if live.isEmpty():
            break
        found.append(arrived(live))
        if len(found) > MERGED:
            found = [settled(_all(found))]
    order = W.partitionBy("graph_key").orderBy("ranks")
    return _all(found).select("graph_key", "path", (F.row_number().over(order) - 1).cast("long").alias("rank"))
