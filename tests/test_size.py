"""How much the plans move, on small tables: what grows faster than its input fails here."""

import random

import pytest

from tracegraph.operators import traverse


def _reached(edges, start):
    out, at, depth = [], start, 0
    seen = {start}
    while (at := edges.get(at)) is not None and at not in seen:
        seen.add(at)
        depth += 1
        out.append((start, at, depth, depth - 1))
    return out


def test_ancestors_share_what_is_above_them(spark, monkeypatch):
    """Where a node has one parent, no level holds a row for each start; cycles, starts above starts and starts outside are right too."""
    rng, edges = random.Random(3), {}
    for g in "ab":
        edges[g] = {f"n{i}": f"n{i // 3}" for i in range(1, 60)} | {f"l{i}": f"n{rng.randrange(60)}" for i in range(300)} | {"c0": "c1", "c1": "c2", "c2": "c0", "d": "c1", "s": "s"}
    starts = [(g, n) for g in "ab" for n in [*edges[g], "n0", "nowhere"]] * 2
    rows = [(g, p, n, "parent", "") for g, es in edges.items() for n, p in es.items()]
    e = spark.createDataFrame(rows + rows[:50], "graph_key string, src string, dst string, kind string, basis string")
    held = []
    monkeypatch.setattr(traverse, "_levels", lambda e, start, *more, f=traverse._levels: (held.append(start.count()), f(e, start, *more))[1])
    got = traverse.breadth_first(e, spark.createDataFrame(starts, "graph_key string, start string"), backward=True).collect()
    want = [(g, *r) for g, n in set(starts) for r in _reached(edges[g], n)]
    assert sorted(map(tuple, got)) == sorted(want)
    assert sum(held) < len(set(starts)) / 4
    twice = e.unionByName(spark.createDataFrame([("a", "m", "n5", "parent", "")], e.schema))
    some = traverse.breadth_first(twice, spark.createDataFrame([("a", "n5")], "graph_key string, start string"), backward=True)
    assert sorted((r["node_id"], r["depth"], r["rank"]) for r in some.collect()) == [("m", 1, 0), ("n0", 2, 2), ("n1", 1, 1)]


def _fleet(spark, inputs, records, text="x"):
    line = lambda i: '{"span_id": "s%d", "trace_id": "t", "start_time": %d, "name": "%s", "attributes": {"openinference.span.kind": "TOOL", "spare": %d}}' % (i, i, text, i)
    content = "\n".join(map(line, range(records))).encode()
    return spark.createDataFrame([(f"g{i}", bytearray(content)) for i in range(inputs)], "graph_key string, content binary").coalesce(1)


def _python_rows(df):
    """Rows of the largest Arrow batch that a task gets or gives, by a plan of one more step."""

    def count(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_pydict({"rows": [batch.num_rows], "bytes": [batch.nbytes]})

    return df.mapInArrow(count, "rows long, bytes long")


def test_small_inputs_share_batches(spark, monkeypatch):
    from tracegraph.sources import reader

    made = []
    monkeypatch.setattr(reader, "_arrow", lambda rows, schema, f=reader._arrow: (made.append(len(rows)), f(rows, schema))[1])
    reader.parsed(_fleet(spark, 40, 1))  # the session's workers have their own copy; the generator is run here instead
    import pyarrow as pa

    source = pa.RecordBatch.from_pydict({"graph_key": [f"g{i}" for i in range(300)], "content": [b'{"x": 1}'] * 300})
    taken = []

    class Frame:
        def select(self, *_):
            return self

        def mapInArrow(self, run, schema):
            taken.extend(run([source]))

    reader.parsed(Frame())
    assert made == [300] and sum(b.num_rows for b in taken) == 300  # 300 refusals in one batch, not a batch each


def test_documents_do_not_come_as_whole_batches(spark):
    """A document is a row of a batch of some MB at most, and its parts come to its task as rows of their own."""
    import json

    from tracegraph import build_graphs
    from tracegraph.plans import document
    from tracegraph.sources import reader

    rows = reader.parsed(_fleet(spark, 60, 40, "x" * 2000))
    g = build_graphs(reader.spans_of(rows), graphs=reader.graphs_of(rows))
    widest = max(r["bytes"] for r in _python_rows(document._items(g).where("part = 1")).collect())
    assert widest / 10_000 < 10_000  # a row is a node, whatever the size of its graph
    made = {r["graph_key"]: json.loads(r["document"]) for r in document.documents(g).collect()}
    assert len(made) == 60
    for d in made.values():
        assert document.validate(d) == [] and [n["id"] for n in d["nodes"]] == [f"s{i}" for i in range(40)]
        assert (d["meta"]["node_count"], d["meta"]["edge_count"], d["meta"]["diagnostic_count"]) == (40, 39, 40)
    assert {(r["problems"], r["canonical"]) for r in document.checked(g).collect()} == {(0, True)}


def test_the_table_of_graphs_needs_no_edges(spark, monkeypatch):
    from tracegraph.operators import edges, order
    from tracegraph.plans import build
    from tracegraph.sources import reader

    for module, name in ((edges, "temporal_edges"), (order, "positions")):
        monkeypatch.setattr(module, name, lambda *_, **__: pytest.fail("no edge is asked for"))
    rows = reader.parsed(_fleet(spark, 3, 2))
    _, graphs, _, _, _ = build.accepted(reader.spans_of(rows), graphs=reader.graphs_of(rows))
    assert sorted((r["graph_key"], r["trace_id"], r["error_code"]) for r in graphs.collect()) == [(f"g{i}", "t", None) for i in range(3)]


def test_parents_and_siblings_are_found_where_graphs_lie(spark, monkeypatch):
    """Spans move once, by graph; orphans, spans without ids, ids claimed twice and large graphs give what joins give."""
    from tracegraph.operators import edges

    rng, rows = random.Random(7), []
    for g in "abc":
        for i in range(80):
            sid = None if rng.random() < 0.1 else f"s{rng.randrange(40)}" if rng.random() < 0.2 else f"s{i}"
            rows.append((g, sid, f"{i}", rng.choice([None, f"s{rng.randrange(90)}", "gone"]), float(rng.randrange(9)) if rng.random() < 0.9 else None))
    claims = {(r[0], r[1]): sum(1 for x in rows if x[:2] == r[:2]) for r in rows}
    rows = [(g, s, s if s and claims[g, s] == 1 else f"d{k}", bool(s) and claims[g, s] == 1, p, t, "x") for g, s, k, p, t in rows]
    ided = spark.createDataFrame(rows, "graph_key string, span_id string, node_id string, unique boolean, parent_id string, started_at double, adapter_id string")
    known = {(r[0], r[1]) for r in rows if r[3]}
    place = {(r[0], r[2]): r[4] if (r[0], r[4]) in known else None for r in rows}
    groups: dict = {}
    for r in rows:
        if r[5] is not None:
            groups.setdefault((r[0], place[r[0], r[2]]), []).append((r[5], r[2]))
    want = sorted((g, a[1], b[1], a[0] == b[0]) for (g, _), x in groups.items() for a, b in zip(sorted(x), sorted(x)[1:]))
    stated = sorted((r[0], r[2], r[4], place[r[0], r[2]] or "") for r in rows if r[4] is not None)
    for group in (edges.GROUP, 1):
        monkeypatch.setattr(edges, "GROUP", group)
        got = edges.parents(ided).select("graph_key", "node_id", "parent_id", "ref_node").collect()
        assert sorted((*r[:3], r[3] or "") for r in got) == stated
        for slices in (None, 1, 5):
            assert sorted(map(tuple, edges.siblings_of(ided, slices).collect())) == want
    monkeypatch.setattr(edges, "GROUP", 1000)
    for slices in (None, 5):
        plan = edges.temporal_of(ided, slices)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1


def test_order_moves_nodes_once(spark, monkeypatch):
    """Graphs that fit a task are ordered there; the order is Kahn's for trees, late parents, shared targets, cycles and void edges."""
    from tracegraph.operators import order

    rng, nodes, pairs, want = random.Random(11), [], [], {}
    for g in map(str, range(30)):
        own = [(float(rng.randrange(6)), f"n{i}") for i in range(8)]
        tree = int(g) % 3
        es = [(f"n{rng.randrange(3)}", f"n{i}") for i in range(3, 8)] if tree else [(f"n{rng.randrange(8)}", f"n{rng.randrange(9)}") for _ in range(6)]
        es += [("gone", "n1")] * (tree == 2)
        nodes += [(g, i, t) for t, i in own]
        pairs += [(g, a, b, "parent") for a, b in es]
        done, rest = order.kahn(own, es)
        want |= {(g, n): k for k, n in enumerate(done + rest)}
    ns = spark.createDataFrame(nodes, "graph_key string, node_id string, started_at double")
    es = spark.createDataFrame(pairs, "graph_key string, src string, dst string, kind string")
    for group in (1, 1_000_000):
        monkeypatch.setattr(order, "GROUP", group)
        place, _ = order.positions(ns, es)
        assert {(r["graph_key"], r["node_id"]): r["pos"] for r in place.collect()} == want
    monkeypatch.setattr(order, "_joined", lambda *_: pytest.fail("graphs fit a task"))
    order.positions(ns, es)
