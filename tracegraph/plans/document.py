"""Graphs as canonical JSON documents, back from them, and what is wrong with one."""

from __future__ import annotations

import json
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import canonical_json
from ..operators.diagnostics import ordered
from ..schema import EDGE_KINDS, ENGINE_VERSION, NODE_KINDS, SCHEMA_VERSION, WARRANTS
from .build import TraceGraphs

ROOT_KEYS = ("annotations", "diagnostics", "edges", "meta", "nodes", "schema_version", "trace_id")
FORBIDDEN_META = ("built_at", "hostname", "username", "path", "source_path")


def _value(text: str | None) -> Any:
    return None if text is None else json.loads(text)


def _payload(p: dict | None) -> dict:
    p = p or {}
    return {"state": p.get("state"), "mime": p.get("mime"), "value": _value(p.get("value_json")), "raw": p.get("raw")}


_NODE = (
    "node_id", "kind", "name", "operation", "started_at", "ended_at", "status", "status_note", "inputs", "outputs", "usage", "attributes_json",
    "raw_json", "source_id", "adapter_id", "adapter_version", "dialect_note",
)
_META = ("trace_id", "adapter_id", "adapter_version", "declared_confidence", "source_digest")
_PARTS = ("meta", "nodes", "edges", "diagnostics", "annotations")


def _node(n: dict) -> dict:
    usage = n["usage"]
    if usage is not None:
        usage = dict(usage) | {"extra": dict(usage["extra"] or [])}
    same = ("kind", "name", "operation", "started_at", "ended_at", "status", "status_note")
    return {"id": n["node_id"], **{k: n[k] for k in same}} | {
        "inputs": _payload(n["inputs"]),
        "outputs": _payload(n["outputs"]),
        "usage": usage,
        "attributes": _value(n["attributes_json"]) or {},
        "raw": {"source": _value(n["raw_json"]), "source_id": n["source_id"]},
        "provenance": {k: n[k] for k in ("adapter_id", "adapter_version", "dialect_note")},
    }


_quoted = json.encoder.encode_basestring


def _string(x: str | None) -> str:
    return "null" if x is None else _quoted(x)


def _json(text: str | None) -> str:
    return "null" if text is None else canonical_json(json.loads(text))


def _edge(src, dst, kind, warrant, basis, adapter) -> str:
    return f'{{"adapter":{_string(adapter)},"basis":{_string(basis)},"dst":{_string(dst)},"kind":{_string(kind)},"src":{_string(src)},"warrant":{_string(warrant)}}}'


def _diagnostic(code, level, message, node_id, source_json, adapter) -> str:
    return f'{{"adapter":{_string(adapter)},"code":{_string(code)},"level":{_string(level)},"message":{_string(message)},"node_id":{_string(node_id)},"source":{_json(source_json)}}}'


def _annotation(namespace, node_id, key, value_json) -> str:
    return f'{{"key":{_string(key)},"namespace":{_string(namespace)},"node_id":{_string(node_id)},"value":{_json(value_json)}}}'


def _values(a) -> list:
    """An Arrow array as Python values: as to_pylist(), by whole columns."""
    import pyarrow as pa

    if a.null_count == len(a):
        return [None] * len(a)
    if pa.types.is_string(a.type):
        return a.to_numpy(zero_copy_only=False).tolist()
    if pa.types.is_struct(a.type):
        names = [a.type.field(i).name for i in range(a.type.num_fields)]
        rows = zip(*map(_values, a.flatten()))
        return [dict(zip(names, row)) if there else None for row, there in zip(rows, a.is_valid().to_pylist())]
    return a.to_pylist()


def _text(m: dict, parts: dict[str, list[str]]) -> str:
    """A document of its meta and the texts of its parts; the keys in order."""
    adapter = {"id": m["adapter_id"], "version": m["adapter_version"], "declared_confidence": m["declared_confidence"]}
    counts = {f"{k}_count": len(parts[f"{k}s"]) for k in ("node", "edge", "diagnostic")}
    whole = {
        "schema_version": SCHEMA_VERSION, "trace_id": m["trace_id"] or "",
        "meta": {"engine_version": ENGINE_VERSION, "adapters": [adapter], "source_digest": m["source_digest"]} | counts,
    }
    texts = {k: canonical_json(v) for k, v in whole.items()} | {k: f"[{','.join(parts[k])}]" for k in _PARTS[1:]}
    return "{" + ",".join(f'"{k}":{texts[k]}' for k in ROOT_KEYS) + "}"


def _items(graphs: TraceGraphs) -> DataFrame:
    """A row for each part of a document: graph_key, part, pos, what it is (v0 to v5) and for nodes and meta their columns; the rows of a
    graph follow each other in canonical order."""
    c, null = F.col, lambda kind="string": F.lit(None).cast(kind)
    types = {f.name: f.dataType for f in graphs.nodes_df.schema.fields} | {f.name: f.dataType for f in graphs.graphs_df.schema.fields if f.name in _META}
    wide = list(dict.fromkeys(_NODE + _META))

    def of(df: DataFrame, part: str, values: list[str], columns: tuple[str, ...] = (), order: list | None = None) -> DataFrame:
        pos = c("pos").cast("long") if part == "nodes" else null("long")
        keys = [k.cast("string") for k in order or []]
        return df.select(
            "graph_key", F.lit(_PARTS.index(part)).alias("part"), pos.alias("pos"), *[(keys[i] if i < len(keys) else null()).alias(f"o{i}") for i in range(4)],
            *[(c(values[i]) if i < len(values) else null()).alias(f"v{i}") for i in range(6)], *[(c(x) if x in columns else null(types[x])).alias(x) for x in wide],
        )

    said, noted = graphs.diagnostics_df, graphs.annotations_df
    out = of(graphs.graphs_df.where("error_code is null"), "meta", [], _META)
    out = out.unionByName(of(graphs.nodes_df, "nodes", [], _NODE))
    out = out.unionByName(of(graphs.edges_df, "edges", ["src", "dst", "kind", "warrant", "basis", "adapter"], order=[c("kind"), c("src"), c("dst"), c("basis")]))
    out = out.unionByName(of(said, "diagnostics", ["code", "level", "message", "node_id", "source_json", "adapter"], order=ordered(said)))
    out = out.unionByName(of(noted, "annotations", ["namespace", "node_id", "key", "value_json"], order=[c("namespace"), c("node_id"), c("key")]))
    order = ["graph_key", "part", "pos", *(f"o{i}" for i in range(4)), *(f"v{i}" for i in range(6))]
    return out.repartition("graph_key").sortWithinPartitions(*order).drop(*(f"o{i}" for i in range(4)))


_BYTES = 1 << 22  # of documents handed on at a time


def _written(graphs: TraceGraphs, each, schema: str) -> DataFrame:
    """each(graph_key, text) of each document as a row of schema. A task holds one document and a batch of parts, however many there are."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))
    makers = (None, None, _edge, _diagnostic, _annotation)

    def write(batches):
        import pyarrow as pa

        at, metas, parts, held, size = None, [], {}, [], 0

        def texts():
            return [_text(m, parts) for m in metas]

        for batch in batches:
            place = {x: _values(batch.column(x)) for x in batch.schema.names}
            keys, kinds = place["graph_key"], place["part"]
            values = list(zip(*(place[f"v{i}"] for i in range(6))))
            rows = {0: list(zip(*(place[x] for x in _META))), 1: list(zip(*(place[x] for x in _NODE)))}
            runs = [0, *(i for i in range(1, len(kinds)) if kinds[i] != kinds[i - 1] or keys[i] != keys[i - 1]), len(kinds)] if kinds else [0]
            for a, b in zip(runs, runs[1:]):
                key, part = keys[a], kinds[a]
                if key != at or not parts:
                    for text in texts():
                        held.append(each(at, text))
                        size += len(text)
                    if size >= _BYTES:
                        yield pa.RecordBatch.from_pylist(held, arrow)
                        held, size = [], 0
                    at, metas, parts = key, [], {k: [] for k in _PARTS}
                if part == 0:
                    metas += [dict(zip(_META, row)) for row in rows[0][a:b]]
                elif part == 1:
                    parts["nodes"] += [canonical_json(_node(dict(zip(_NODE, row)))) for row in rows[1][a:b]]
                elif metas:
                    make = makers[part]
                    n = 4 if part == 4 else 6
                    parts[_PARTS[part]] += [make(*v[:n]) for v in values[a:b]]
        held += [each(at, text) for text in texts()]
        if held:
            yield pa.RecordBatch.from_pylist(held, arrow)

    return _items(graphs).mapInArrow(write, schema)


def documents(graphs: TraceGraphs) -> DataFrame:
    """(graph_key, document): the canonical JSON text of each graph that was built, all parts in canonical order."""
    return _written(graphs, lambda key, text: {"graph_key": key, "document": text}, "graph_key string, document string")


def checked(graphs: TraceGraphs) -> DataFrame:
    """(graph_key, problems, canonical): each document as documents() has it, read again by the task that wrote it: how much is wrong with
    it, and whether it is written the one canonical way."""

    def check(key: str, text: str) -> dict:
        value = json.loads(text)
        return {"graph_key": key, "problems": len(validate(value)), "canonical": canonical_json(value) == text}

    return _written(graphs, check, "graph_key string, problems long, canonical boolean")


def to_document(graphs: TraceGraphs) -> dict:
    (row,) = documents(graphs).collect()
    return json.loads(row["document"])


def dumps(graphs: TraceGraphs) -> bytes:
    """Canonical bytes of the one graph that graphs holds."""
    (row,) = documents(graphs).collect()
    return (row["document"] + "\n").encode()


def dump(graphs: TraceGraphs, path: str | Path) -> None:
    Path(path).write_bytes(dumps(graphs))


def write_documents(graphs: TraceGraphs, path: str) -> None:
    """A canonical document a line, for any number of graphs."""
    documents(graphs).select("document").write.text(path)


def read_documents(spark: SparkSession, *paths: str) -> DataFrame:
    """(graph_key, document) of files that each hold a graph document (an object with schema_version)."""
    files = spark.read.text(list(paths), wholetext=True).select(F.input_file_name().alias("graph_key"), F.col("value").alias("document"))
    return files.where(F.get_json_object("document", "$.schema_version").isNotNull())


def is_document(content: bytes) -> dict | None:
    """The document that content is, or None."""
    try:
        value = json.loads(content.decode("utf-8", "replace"))
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) and "schema_version" in value else None


def validate(document: Any) -> list[str]:
    """All that is wrong with a document, in sentences; empty for a good one. Never raises."""
    if not isinstance(document, dict):
        return ["the document is no object"]
    out = [f"{k} is missing" for k in ROOT_KEYS if k not in document]
    if out:
        return out
    if document["schema_version"] != SCHEMA_VERSION:
        out.append(f"schema_version is {document['schema_version']!r}; this engine writes {SCHEMA_VERSION!r}")
    nodes, edges, notes = (document[k] for k in ("nodes", "edges", "diagnostics"))
    if not all(isinstance(x, list) for x in (nodes, edges, notes)):
        return [*out, "nodes, edges and diagnostics must be arrays"]
    text = lambda x: canonical_json(x)  # noqa: E731  hashable and ordered, whatever it is
    ids = [text(n.get("id")) for n in nodes if isinstance(n, dict) and n.get("id") is not None]
    if len(ids) < len(nodes):
        out.append("a node is no object or has no id")
    if len(set(ids)) < len(ids):
        out.append("node ids are not unique")
    known, kept = set(ids), [e for e in edges if isinstance(e, dict)]
    if len(kept) < len(edges):
        out.append("an edge is no object")
    for e in kept:
        name = f"edge {e.get('kind')!r} from {e.get('src')!r} to {e.get('dst')!r}"
        if text(e.get("src")) not in known:
            out.append(f"{name} starts outside the graph")
        if e.get("kind") != "link" and text(e.get("dst")) not in known:
            out.append(f"{name} ends outside the graph")
        if e.get("kind") not in EDGE_KINDS:
            out.append(f"{name} has no known kind")
        elif e.get("warrant") != WARRANTS[e["kind"]]:
            out.append(f"{name} has the warrant {e.get('warrant')!r}")
    out += [f"node {n.get('id')!r} has no known kind" for n in nodes if isinstance(n, dict) and n.get("kind") not in NODE_KINDS]
    word = lambda x: x if isinstance(x, str) else "" if x is None else text(x)
    keys = [tuple(word(e.get(k)) for k in ("kind", "src", "dst", "basis")) for e in kept]
    if keys != sorted(keys):
        out.append("edges are not in the order of kind, src, dst, basis")
    if len(set(keys)) < len(keys):
        out.append("edges are not unique by src, dst, kind, basis")
    said = [tuple(word(d.get(k)) for k in ("code", "node_id", "message")) for d in notes if isinstance(d, dict)]
    if said != sorted(said):
        out.append("diagnostics are not in the order of code, node_id, message")
    meta = document["meta"]
    if not isinstance(meta, dict):
        return [*out, "meta is no object"]
    for name, items in (("node", nodes), ("edge", edges), ("diagnostic", notes)):
        if meta.get(f"{name}_count") != len(items):
            out.append(f"meta.{name}_count is {meta.get(f'{name}_count')!r} and there are {len(items)}")
    return out + [f"meta.{k} must not be there" for k in FORBIDDEN_META if k in meta]


def problems(graphs: TraceGraphs) -> DataFrame:
    """(graph_key, problem): the rules of a document as joins over all graphs at once, for what cannot be collected."""
    n, e = graphs.nodes_df.select("graph_key", "node_id"), graphs.edges_df
    out = n.groupBy("graph_key", "node_id").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("graph_key", F.concat(F.lit("node ids are not unique: "), "node_id").alias("problem"))
    for end, rule, word in (("src", F.lit(True), "starts"), ("dst", F.col("kind") != "link", "ends")):
        lost = e.where(rule).join(n.withColumnRenamed("node_id", end), ["graph_key", end], "left_anti")
        out = out.unionByName(lost.select("graph_key", F.concat_ws(" ", F.lit("edge"), "kind", "src", "dst", F.lit(f"{word} outside the graph")).alias("problem")))
    wrong = ~F.coalesce(F.create_map(*[F.lit(x) for kv in WARRANTS.items() for x in kv])[F.col("kind")] == F.col("warrant"), F.lit(False))
    out = out.unionByName(e.where(wrong).select("graph_key", F.concat_ws(" ", F.lit("edge"), "kind", "src", "dst", F.lit("has a wrong kind or warrant")).alias("problem")))
    twice = e.groupBy("graph_key", "src", "dst", "kind", "basis").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    return out.unionByName(twice.select("graph_key", F.concat_ws(" ", F.lit("edge"), "kind", "src", "dst", F.lit("is there twice")).alias("problem")))


def canonical_form(graphs: TraceGraphs) -> DataFrame:
    """(graph_key, part, item): what two builds of the same telemetry must agree on, raw text and provenance left out."""
    p = lambda c: F.struct(F.col(f"{c}.state"), F.col(f"{c}.mime"), F.col(f"{c}.value_json"))
    node = F.to_json(F.struct("pos", "node_id", "kind", "name", "operation", "started_at", "ended_at", "status", "status_note", p("inputs").alias("inputs"), p("outputs").alias("outputs"), "usage", "attributes_json"))
    out = graphs.nodes_df.select("graph_key", F.lit("node").alias("part"), node.alias("item"))
    out = out.unionByName(graphs.edges_df.select("graph_key", F.lit("edge").alias("part"), F.to_json(F.struct("src", "dst", "kind", "warrant", "basis")).alias("item")))
    notes = graphs.diagnostics_df.groupBy("graph_key", "code").agg(F.count(F.lit(1)).alias("n"))
    return out.unionByName(notes.select("graph_key", F.lit("diagnostic").alias("part"), F.to_json(F.struct("code", "n")).alias("item")))


def differences(a: TraceGraphs, b: TraceGraphs) -> DataFrame:
    """(side, part, item) that only one of a and b has."""
    x, y = (canonical_form(g).drop("graph_key") for g in (a, b))
    return x.exceptAll(y).withColumn("side", F.lit("left")).unionByName(y.exceptAll(x).withColumn("side", F.lit("right")))


def unaccounted(spans: DataFrame, graphs: TraceGraphs) -> DataFrame:
    """Spans (graph_key, record_index) of built graphs that are neither a node nor in a diagnostic; there must be none."""
    built = spans.join(graphs.graphs_df.where("error_code is null").select("graph_key"), "graph_key", "left_semi")
    kept = graphs.nodes_df.select("graph_key", F.col("raw_json"))
    told = graphs.diagnostics_df.select("graph_key", F.col("source_json").alias("raw_json"))
    return built.join(kept.unionByName(told), ["graph_key", "raw_json"], "left_anti")
