"""Execution traces as property graphs in Spark DataFrames."""

from .model import (
    Annotation, AnnotationStore, Diagnostic, DiagnosticLevel, Edge, EdgeKind, Graph, Meta, Node, NodeKind, Payload, PayloadState, Provenance, RawRecord, Status, Usage, Warrant,
)
from .plans.build import TraceGraphs, build, build_all, build_graphs
from .plans.document import dump, dumps, to_document, validate
from .schema import ENGINE_VERSION as __version__
from .schema import SCHEMA_FROZEN, SCHEMA_VERSION, TraceGraphError
from .sources import openinference  # registers the dialect  # noqa: F401
from .sources.registry import default as registry

__all__ = [
    "Annotation", "AnnotationStore", "Diagnostic", "DiagnosticLevel", "Edge", "EdgeKind", "Graph", "Meta", "Node", "NodeKind", "Payload", "PayloadState", "Provenance",
    "RawRecord", "SCHEMA_FROZEN", "SCHEMA_VERSION", "Status", "TraceGraphError", "TraceGraphs", "Usage", "Warrant", "__version__", "build", "build_all",
    "build_graphs", "dump", "dumps", "registry", "to_document", "validate",
]
