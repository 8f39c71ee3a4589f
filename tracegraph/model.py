"""One graph as Python values: for a graph that fits the driver, read from its document.

Tables are what this engine works on; these types are for code that takes a single small graph in hand. `Graph.of` collects it.
Enumerations are the closed sets of the schema, as strings.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping
from dataclasses import dataclass, field, fields
from enum import StrEnum
from typing import Any

from . import schema


def _closed(name: str, values: Iterable[str]) -> type[StrEnum]:
    return StrEnum(name, {v.upper(): v for v in values}, module=__name__)


NodeKind = _closed("NodeKind", schema.NODE_KINDS)
EdgeKind = _closed("EdgeKind", schema.EDGE_KINDS)
Warrant = _closed("Warrant", sorted(set(schema.WARRANTS.values())))
Status = _closed("Status", schema.STATUSES)
PayloadState = _closed("PayloadState", schema.PAYLOAD_STATES)
DiagnosticLevel = _closed("DiagnosticLevel", schema.LEVELS)


class _Part:
    """A dataclass made from an object of a document; keys it does not know are an error, as in any call."""

    @classmethod
    def of(cls, values: Mapping[str, Any] | None):
        if values is None:
            return None
        made = dict(values)
        for f in fields(cls):
            kind = _NESTED.get((cls.__name__, f.name))
            if kind is not None and made.get(f.name) is not None:
                made[f.name] = kind(made[f.name])
        return cls(**made)


@dataclass(frozen=True)
class Payload(_Part):
    state: PayloadState
    mime: str | None = None
    value: Any = None
    raw: str | None = None

    @property
    def has_content(self) -> bool:
        return self.state in schema.CONTENT_STATES


@dataclass(frozen=True)
class Usage(_Part):
    input_tokens: int | None = None
    output_tokens: int | None = None
    total_tokens: int | None = None
    extra: Mapping[str, int] = field(default_factory=dict)


@dataclass(frozen=True)
class RawRecord(_Part):
    source: Any = None
    source_id: str | None = None


@dataclass(frozen=True)
class Provenance(_Part):
    adapter_id: str
    adapter_version: str
    dialect_note: str | None = None


@dataclass(frozen=True)
class Node(_Part):
    id: str
    kind: NodeKind
    name: str
    operation: str | None
    started_at: float | None
    ended_at: float | None
    status: Status
    status_note: str | None
    inputs: Payload
    outputs: Payload
    usage: Usage | None
    attributes: Mapping[str, Any]
    raw: RawRecord
    provenance: Provenance


@dataclass(frozen=True)
class Edge(_Part):
    src: str
    dst: str
    kind: EdgeKind
    warrant: Warrant
    basis: str
    adapter: str | None = None


@dataclass(frozen=True)
class Diagnostic(_Part):
    code: str
    level: DiagnosticLevel
    message: str
    node_id: str | None = None
    source: Any = None
    adapter: str | None = None


@dataclass(frozen=True)
class Meta(_Part):
    engine_version: str
    adapters: tuple[Mapping[str, Any], ...]
    source_digest: str | None
    node_count: int
    edge_count: int
    diagnostic_count: int


@dataclass(frozen=True)
class Annotation(_Part):
    namespace: str
    node_id: str
    key: str
    value: Any


_NESTED: dict[tuple[str, str], Any] = {
    ("Payload", "state"): PayloadState, ("Node", "kind"): NodeKind, ("Node", "status"): Status, ("Node", "inputs"): Payload.of, ("Node", "outputs"): Payload.of,
    ("Node", "usage"): Usage.of, ("Node", "raw"): RawRecord.of, ("Node", "provenance"): Provenance.of, ("Edge", "kind"): EdgeKind, ("Edge", "warrant"): Warrant,
    ("Diagnostic", "level"): DiagnosticLevel, ("Meta", "adapters"): tuple,
}


class AnnotationStore:
    """The annotations of one graph by (namespace, node, key)."""

    def __init__(self, entries: Iterable[Annotation] = ()):
        self._at = {(a.namespace, a.node_id, a.key): a for a in entries}

    def __iter__(self) -> Iterator[Annotation]:
        return (self._at[k] for k in sorted(self._at))

    def __len__(self) -> int:
        return len(self._at)

    def get(self, namespace: str, node_id: str, key: str, default: Any = None) -> Any:
        found = self._at.get((namespace, node_id, key))
        return default if found is None else found.value

    def for_node(self, node_id: str, namespace: str) -> dict[str, Any]:
        return {k: a.value for (space, node, k), a in sorted(self._at.items()) if (space, node) == (namespace, node_id)}


@dataclass(frozen=True)
class Graph:
    """A whole graph on the driver; nodes in their order, edges and diagnostics in theirs."""

    trace_id: str
    nodes: tuple[Node, ...]
    edges: tuple[Edge, ...]
    diagnostics: tuple[Diagnostic, ...]
    annotations: AnnotationStore
    meta: Meta

    @classmethod
    def from_document(cls, document: Mapping[str, Any]) -> Graph:
        many = lambda kind, name: tuple(kind.of(x) for x in document[name])
        return cls(document["trace_id"], many(Node, "nodes"), many(Edge, "edges"), many(Diagnostic, "diagnostics"), AnnotationStore(many(Annotation, "annotations")), Meta.of(document["meta"]))

    @classmethod
    def of(cls, graphs) -> Graph:
        """The one graph that TraceGraphs holds, collected."""
        from .plans.document import to_document

        return cls.from_document(to_document(graphs))

    def node(self, node_id: str) -> Node | None:
        return next((n for n in self.nodes if n.id == node_id), None)

    def __len__(self) -> int:
        return len(self.nodes)
