"""Building: each relation with a case where it holds and one where a field is missing."""

import json
import random

import pytest

import tracegraph as T
from tracegraph.operators.order import kahn
from tracegraph.plans.document import differences, documents, problems, unaccounted
from tracegraph.plans.fleet import report, table
from tracegraph.schema import AdapterSelectionError, DuplicateNodeIdError, UnknownAdapterError
from tracegraph.sources import reader
from tracegraph.sources.registry import Registry


def span(i, kind="TOOL", parent=None, start=None, trace="t1", attributes=None, **more):
    a = {"openinference.span.kind": kind} | (attributes or {})
    return {"trace_id": trace, "span_id": i, "parent_id": parent, "name": i, "start_time": start, "end_time": None, "attributes": a} | more


def lines(*records):
    return "\n".join(r if isinstance(r, str) else json.dumps(r) for r in records).encode()


def asks(*ids):
    return {f"llm.output_messages.0.message.tool_calls.{n}.tool_call.id": i for n, i in enumerate(ids)}


FLEET = {
    "calls": lines(
        span("a", "AGENT", start=1.0), span("l", "LLM", "a", 2.0, attributes=asks("c1", "c2") | {"llm.model_name": "m", "llm.token_count.prompt": 3, "llm.token_count.cached": 1}),
        span("x", "TOOL", "a", 3.0, attributes={"tool.name": "f", "tool_call.id": "c1"}, status="OK"), span("y", "TOOL", "a", 3.0, attributes={"tool.name": "g", "tool_call.id": "c9"}),
        span("z", "LLM", "a", 4.0, attributes={"llm.input_messages.0.message.role": "tool", "llm.input_messages.0.message.tool_call_id": "c1", "llm.input_messages.1.message.tool_calls.0.tool_call.id": "c1"}),
    ),
    "odd": lines(
        span("p", "CHAIN", "gone", 5.0, end_time=4.0, links=[{"span_id": "q"}, {"span_id": "far"}, 7]), "", "{broken", span("q", "NEW", "p", None, trace="t2"), '["no object"]',
        span(None, "TOOL", "p", 6.0, trace=None, attributes={"input.value": "{bad", "input.mime_type": "application/json", "output.value": "__REDACTED__"}, extra=1),
    ),
    "cycle": lines(span("b", "CHAIN", "a", 2.0), span("a", "CHAIN", "b", 1.0), span("c", "CHAIN", "a", 0.5), span("d", "CHAIN", "d", 0.1), span("e", "CHAIN", None, 9.0)),
    "late": lines(span("r", "CHAIN", None, 9.0), span("s", "TOOL", "r", 1.0), span("t", "TOOL", "s", 0.5), span("u", "TOOL", "t", 0.2), span("v", "CHAIN", None, 0.1)),
    "twice": lines(span("a"), span("a")),
    "strange": b'{"x": 1}',
    "array": json.dumps([span("a", "AGENT", start=1.0)]).encode(),
    "cut": b'[{"x": 1}',
}


@pytest.fixture(scope="module")
def rows(spark):
    source = spark.createDataFrame([(k, bytearray(v)) for k, v in FLEET.items()], "graph_key string, content binary")
    return reader.parsed(source).persist()


def graphs_of(rows, **more):
    return T.build_graphs(reader.spans_of(rows), graphs=reader.graphs_of(rows), malformed=reader.malformed_of(rows), **more).settled()


@pytest.fixture(scope="module")
def fleet(rows):
    return graphs_of(rows)


@pytest.fixture(scope="module")
def docs(fleet):
    return {r["graph_key"]: json.loads(r["document"]) for r in documents(fleet).collect()}


def edges(d, kind):
    return [(e["src"], e["dst"]) for e in d["edges"] if e["kind"] == kind]


def codes(d):
    return sorted(x["code"] for x in d["diagnostics"])


def test_calls(docs):
    d = docs["calls"]
    assert edges(d, "call_result") == [("l", "x")]
    assert edges(d, "data") == [("x", "z")]
    assert edges(d, "parent") == [("a", x) for x in "lxyz"]
    assert edges(d, "temporal") == [("l", "x"), ("x", "y"), ("y", "z")]
    assert [e["basis"][-5:] for e in d["edges"] if e["kind"] == "temporal"] == ["ering", "e_id)", "ering"]
    assert [c for c in codes(d) if c.startswith("unpaired")] == ["unpaired_call", "unpaired_result"]
    assert d["nodes"][1]["usage"] == {"input_tokens": 3, "output_tokens": None, "total_tokens": None, "extra": {"cached": 1}}
    assert T.validate(d) == []


def test_odd_input(docs):
    d = docs["odd"]
    want = ["malformed_record", "missing_timestamp", "missing_timestamp", "multi_trace_input", "nonmonotonic_time", "orphan_parent", "payload_parse_failed", "unknown_span_kind", "unknown_span_kind", "unmapped_attributes"]
    assert codes(d) == want
    assert edges(d, "link") == [("p", "far"), ("p", "q")]
    derived = [n for n in d["nodes"] if n["id"].startswith("sw_")]
    assert len(derived) == 2 and {n["outputs"]["state"] for n in derived} == {"redacted", "absent"}
    assert {n["attributes"].get("reported_kind") for n in d["nodes"]} == {None, "NEW"}
    assert T.validate(d) == []


def test_order(docs):
    assert [n["id"] for n in docs["cycle"]["nodes"]] == ["e", "d", "c", "a", "b"]
    assert codes(docs["cycle"]) == ["ordering_cycle"]
    assert [n["id"] for n in docs["late"]["nodes"]] == ["v", "r", "s", "t", "u"]


def test_kahn_is_the_key_order_without_backward_edges():
    rng = random.Random(5)
    for _ in range(300):
        keys = [(rng.choice([1.0, 2.0, float("inf")]), f"n{i}") for i in range(rng.randint(1, 8))]
        pairs = [(a, b) for a in keys for b in keys if a < b and rng.random() < 0.3]
        assert kahn(keys, [(a[1], b[1]) for a, b in pairs]) == ([k[1] for k in sorted(keys)], [])


def test_refusals_cost_no_other_graph(fleet, docs, spark):
    got = {r["graph_key"]: (r["error_code"], r["error_type"]) for r in fleet.graphs_df.collect()}
    assert got["twice"] == ("duplicate_node_id", "DuplicateNodeIdError")
    assert got["strange"][0] == got["cut"][0] == "adapter_unconfident"
    assert set(docs) == set(FLEET) - {"twice", "strange", "cut"}
    with pytest.raises(DuplicateNodeIdError):
        T.build(spark, FLEET["twice"])
    with pytest.raises(AdapterSelectionError):
        T.build(spark, FLEET["strange"])
    with pytest.raises(UnknownAdapterError):
        T.build(spark, FLEET["calls"], adapter="none")


def test_report(fleet):
    r = report(fleet)
    assert r["traces"] == {"given": 8, "built": 5, "unbuildable": 3, "distinct_trace_ids": 1}
    assert r["node_kinds"]["embedding"] == 0 and r["tools"]["f"] == {"calls": 1, "errors": 0, "ok": 1, "unset": 0}
    assert r["unfulfilled_calls"]["by_model"] == {"m": 1} and r["unfulfilled_results"] == 1
    assert any("duplicate_node_id" in line for line in table(r))


def test_nothing_is_lost_and_rules_hold(rows, fleet):
    assert unaccounted(reader.spans_of(rows), fleet).count() == 0
    assert problems(fleet).count() == 0


def test_partitioning_does_not_matter(spark, fleet):
    keep = [k for k in FLEET if k != "odd"]
    shuffled = {k: b"\n".join(random.Random(3).sample(FLEET[k].split(b"\n"), len(FLEET[k].split(b"\n")))) for k in keep}
    for n in (5,):
        source = spark.createDataFrame([(k, bytearray(shuffled[k])) for k in keep], "graph_key string, content binary").repartition(n)
        other = graphs_of(reader.parsed(source))
        from dataclasses import replace

        own = replace(fleet, nodes_df=fleet.nodes_df.where("graph_key <> 'odd'"), edges_df=fleet.edges_df.where("graph_key <> 'odd'"), diagnostics_df=fleet.diagnostics_df.where("graph_key <> 'odd'"))
        assert differences(own, other).count() == 0


def test_selection_and_traversal(fleet):
    ids = lambda df, c="node_id": [r[c] for r in df.collect()]
    g = fleet.one("calls")
    assert ids(g.children("a")) == ["l", "x", "y", "z"] and ids(g.parents("x")) == ["a"]
    assert sorted(ids(g.nodes(["llm"]))) == ["l", "z"] and ids(g.nodes("nothing")) == []
    assert ids(g.descendants("a").orderBy("rank")) == ["l", "x", "y", "z"]
    assert ids(g.ancestors("z")) == ["a"]
    assert sorted(ids(g.reachable("l"))) == ["x", "y", "z"]
    assert [r["path"] for r in g.paths("l", "z").orderBy("rank").collect()] == [["l", "x", "z"], ["l", "x", "y", "z"]]
    assert g.paths("l", "l").count() == 0
    assert sorted(ids(fleet.one("cycle").descendants("a"))) == ["b", "c"]
    sub = g.subgraph("parent")
    assert sub.edges().count() == 4 and sub.meta.where("error_code is null").first()["edge_count"] == 4
    assert ids(fleet.one("odd").node("far")) == []


def test_annotations(fleet):
    g = fleet.one("calls").annotate("x", "me", "k", {"v": 1}).annotate("x", "me", "k", 2).annotate("y", "me", "k", True)
    assert [(r["node_id"], r["value_json"]) for r in g.annotations().collect()] == [("x", "2"), ("y", "true")]
    assert [r["node_id"] for r in g.nodes(annotated=("me", "k", 2)).collect()] == ["x"]
    for bad in (("x", "", "k", 1), ("x", "tracegraph", "k", 1), ("nobody", "me", "k", 1), ("x", "me", "k", object())):
        with pytest.raises(ValueError):
            g.annotate(*bad)
    assert T.to_document(g)["annotations"] == [{"namespace": "me", "node_id": "x", "key": "k", "value": 2}, {"namespace": "me", "node_id": "y", "key": "k", "value": True}]


def test_annotations_in_bulk(fleet, spark):
    g = fleet.one("calls")
    rows = [("calls", "me", "x", "k", str(i), i) for i in range(6)] + [("calls", "me", "y", "k", '{"b": 1, "a": [2]}', 0)]
    columns = "graph_key string, namespace string, node_id string, key string, value_json string, at int"
    got = g.annotate_all(spark.createDataFrame(rows, columns).repartition(4), "at")
    assert [(r["node_id"], r["value_json"]) for r in got.annotations().collect()] == [("x", "5"), ("y", '{"a":[2],"b":1}')]
    for bad in (("calls", "me", "nobody", "k", "1", 0), ("calls", "tracegraph.x", "x", "k", "1", 0), ("calls", None, "x", "k", "1", 0), ("calls", "me", "x", "k", "not json", 0)):
        with pytest.raises(ValueError):
            g.annotate_all(spark.createDataFrame([*rows, bad], columns), "at")


def test_call_edges_are_unique(spark):
    """Two nodes that share two calls have one edge."""
    record = lambda i, role, ids: {"graph_key": "g", "span_id": i, "source_key": i, "kind": "tool", "call_ids": ids, "call_role": role, "started_at": 1.0}
    from pyspark.sql.types import StructType
    from tracegraph.schema import SPANS

    schema = StructType.fromDDL(SPANS)
    rows = [record("a", "requester", ["c1", "c2"]), record("b", "fulfiller", ["c1", "c2"]), record("d", "fulfiller", ["c2"])]
    spans = spark.createDataFrame([tuple(r.get(f.name) for f in schema.fields) for r in rows], schema)
    g = T.build_graphs(spans, temporal=False).settled()
    assert sorted((e["src"], e["dst"]) for e in g.edges("call_result").collect()) == [("a", "b"), ("a", "d")] and problems(g).count() == 0


def test_paths_are_read_as_they_are(spark, tmp_path):
    for name in ("_hidden.jsonl", ".dot.jsonl", "run[1].jsonl", "a{b}c*.jsonl", "plain.jsonl"):
        (tmp_path / name).write_bytes(FLEET["calls"])
        assert T.build(spark, str(tmp_path / name)).nodes().count() == 5
    assert T.build_all(spark, f"{tmp_path}/*.jsonl").graphs_df.count() == 3 and T.build_all(spark, str(tmp_path)).graphs_df.count() == 3
    assert T.build_all(spark, tmp_path / "_hidden.jsonl", tmp_path / "plain.jsonl", FLEET["late"]).graphs_df.count() == 3


def test_shapes(fleet):
    from tracegraph.operators import rollup

    made = rollup.shapes(fleet.nodes_df, fleet.edges_df)
    got = {r["shape"]: r["graphs"] for r in rollup.coverage(made).collect()}
    assert got == {"tool_call": 3, "no_tool_call": 2, "parallel": 0, "failing": 0, "nested": 0, "retrieves": 0, "varied_tools": 1}
    shown = sorted((r["shape"], r["graph_key"]) for r in rollup.showing(made).collect())
    assert [g for s, g in shown if s == "varied_tools"] == ["calls"] and [g for s, g in shown if s == "no_tool_call"] == ["array", "cycle"]
    assert {r["shape"] for r in rollup.missing(made).collect()} == {"parallel", "failing", "nested", "retrieves"}


def test_paths_longer_than_any_limit(spark):
    from tracegraph.operators import traverse

    chain = spark.createDataFrame([("g", f"n{i}", f"n{i + 1}", "parent", "") for i in range(70)], "graph_key string, src string, dst string, kind string, basis string")
    (row,) = traverse.simple_paths(chain, "n0", "n70").collect()
    assert len(row["path"]) == 71 and traverse.simple_paths(chain, "n0", "n70", max_length=69).count() == 0


def test_validate_finds_what_is_planted(docs):
    good = docs["calls"]
    plant = [
        {"nodes": good["nodes"][1:]}, {"edges": good["edges"][::-1]}, {"edges": good["edges"] + good["edges"][-1:]}, {"schema_version": "9"}, {"nodes": [{"id": ["x"]}]},
        {"meta": good["meta"] | {"path": "/x"}}, {"meta": None}, {"edges": [good["edges"][0] | {"warrant": "derived"}, *good["edges"][1:]]}, {"diagnostics": 3},
    ]
    for bad in plant:
        assert T.validate(good | bad), bad
    assert T.validate([]) and T.validate({})


def test_registry():
    class A:
        id, version = "a", "1"

        def detect(self, sample):
            return 0.7

    class B(A):
        id = "b"

    class C(A):
        id = "c"

        def detect(self, sample):
            raise ValueError

    r = Registry()
    code = lambda f: pytest.raises(AdapterSelectionError, f).value.code
    assert code(lambda: r.detect([])) == "no_adapters_registered"
    a = r.register(A())
    assert r.register(a) is a and r.detect([1]) == (a, 0.7)
    assert code(lambda: r.register(A())) == "duplicate_adapter_id"
    r.register(B())
    assert code(lambda: r.detect([])) == "adapter_ambiguous"
    r.register(C())
    assert code(lambda: r.detect([])) == "adapter_detect_failed"


def test_command_line(tmp_path, capsys, spark, monkeypatch):
    from tracegraph import cli

    monkeypatch.setattr(cli, "_spark", lambda: spark)
    (tmp_path / "in.jsonl").write_bytes(FLEET["calls"])
    out = str(tmp_path / "out.json")
    assert cli.main(["build", str(tmp_path / "in.jsonl"), "-o", out]) == 0
    assert cli.main(["validate", out]) == 0 and cli.main(["inspect", out]) == 0
    said = capsys.readouterr().out
    said = [line.split() for line in said.splitlines()]
    assert ["5", "nodes"] in said and ["1", "call_result", "(explicit)"] in said
    (tmp_path / "bad").write_bytes(FLEET["twice"])
    assert cli.main(["build", str(tmp_path / "bad")]) == 1 and cli.main(["validate", str(tmp_path / "bad")]) == 1
    assert cli.main(["adapters"]) == 0 and cli.main(["build", str(tmp_path / "none")]) == 1


def test_stream(spark, tmp_path):
    from tracegraph.streaming import stream_graphs

    (tmp_path / "in").mkdir()
    for k in ("calls", "late"):
        (tmp_path / "in" / f"{k}.jsonl").write_bytes(FLEET[k])
    q = stream_graphs(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state"))
    q.awaitTermination(180)
    assert q.exception() is None
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_order_of_large_graphs(spark):
    """In rounds as by a heap: random graphs, with parallel edges, ties of starts, edges against the keys, and cycles."""
    import random

    from pyspark.sql import functions as F
    from tracegraph.operators import order

    rng, nodes, edges = random.Random(7), [], []
    for g in range(12):
        n = rng.randint(2, 40)
        nodes += [(f"g{g}", f"n{i}", None if rng.random() < 0.1 else float(rng.randint(0, 15))) for i in range(n)]
        for _ in range(rng.randint(1, 2 * n)):
            a, b = sorted(rng.sample(range(n), 2))
            edges.append((f"g{g}", f"n{a}", f"n{b}", "parent") if g % 3 or rng.random() < 0.9 else (f"g{g}", f"n{b}", f"n{a}", "parent"))
        edges.append((f"g{g}", "n0", "nowhere", "parent"))
    nodes = spark.createDataFrame(nodes, "graph_key string, node_id string, started_at double")
    edges = spark.createDataFrame(edges, "graph_key string, src string, dst string, kind string")
    want, got = order.positions(nodes, edges), order.positions(nodes, edges, largest=1)
    for a, b in zip(want, got):
        assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    assert 0 < want[1].count() < 12 and nodes.count() == got[0].select("graph_key", "pos").distinct().where(F.col("pos") >= 0).count()


def test_graph_in_hand(fleet):
    """One graph as Python values, equal to its document."""
    g = T.Graph.of(fleet.one("calls").annotate("x", "me", "k", {"v": 1}))
    assert [n.id for n in g.nodes] == ["a", "l", "x", "y", "z"] and len(g) == g.meta.node_count == 5
    llm = g.node("l")
    assert llm.kind is T.NodeKind.LLM and llm.usage == T.Usage(3, None, None, {"cached": 1}) and llm.inputs.state is T.PayloadState.ABSENT and not llm.inputs.has_content
    assert {e.warrant for e in g.edges if e.kind == T.EdgeKind.TEMPORAL} == {T.Warrant.DERIVED} and g.node("nobody") is None
    assert g.annotations.get("me", "x", "k") == {"v": 1} and g.annotations.for_node("x", "me") == {"k": {"v": 1}} and len(g.annotations) == 1
    assert {d.level for d in g.diagnostics} <= set(T.DiagnosticLevel) and [a.value for a in g.annotations] == [{"v": 1}]
    assert set(T.__all__) <= set(dir(T))
