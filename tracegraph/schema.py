"""Closed sets, fixed names and the schemas of the tables."""

from __future__ import annotations

SCHEMA_VERSION = "0.1"
SCHEMA_FROZEN = False
ENGINE_VERSION = "0.1.0"

# The model's closed sets.
NODE_KINDS = ("agent", "chain", "embedding", "llm", "retriever", "tool", "unknown")
EDGE_KINDS = ("call_result", "data", "link", "parent", "temporal")
WARRANTS = {"parent": "explicit", "call_result": "explicit", "data": "explicit", "link": "explicit", "temporal": "derived"}
STATUSES = ("ok", "error", "unset")
PAYLOAD_STATES = ("present", "empty", "absent", "redacted", "truncated")
CONTENT_STATES = ("present", "truncated")
LEVELS = ("info", "warning")
STATED_KINDS = ("parent", "call_result")  # those that order nodes

# How each kind of edge was established.
PARENT_BASIS = "span.parent_span_id"
CALL_BASIS = "tool_call_id"
RECEIVED_BASIS = "tool_call_id in tool-result message"
LINK_BASIS = "span.link"
TEMPORAL_BASIS = "sibling start_time ordering"
TIED_BASIS = "sibling start_time ordering (tied, broken by node_id)"

# What stands for an asker without a name of its own.
NO_NODE = "(no node on the diagnostic)"
NOT_HERE = "(node not in this graph)"
UNNAMED = "(unnamed %s)"

# Diagnostic codes, error codes.
DIAGNOSTIC_CODES = (
    "unknown_span_kind", "unmapped_attributes", "payload_parse_failed", "orphan_parent", "unpaired_call",
    "unpaired_result", "missing_timestamp", "nonmonotonic_time", "duplicate_source_id", "multi_trace_input",
    "malformed_record", "ordering_cycle",
)
ERROR_CODES = (
    "duplicate_node_id", "no_adapters_registered", "adapter_ambiguous", "adapter_unconfident",
    "adapter_detect_failed", "duplicate_adapter_id", "unknown_adapter",
)
DERIVED_PREFIX, DERIVED_LENGTH = "sw_", 16

PAYLOAD = "struct<state: string, mime: string, value_json: string, raw: string>"
DIAGNOSTIC = "struct<code: string, level: string, message: string, source_json: string>"
SPANS = f"""graph_key string, record_index bigint, line_no bigint, source_key string, span_id string, parent_id string,
  trace_id string, kind string, name string, operation string, started_at double, ended_at double, status string,
  status_note string, inputs {PAYLOAD}, outputs {PAYLOAD},
  usage struct<input_tokens: bigint, output_tokens: bigint, total_tokens: bigint, extra: map<string, bigint>>,
  call_ids array<string>, call_role string, links array<struct<span_id: string, trace_id: string, basis: string>>,
  data_edges array<struct<src: string, dst: string, basis: string>>, received_call_ids array<string>,
  attributes_json string, unmapped array<string>, raw_json string, dialect_note string, diagnostics array<{DIAGNOSTIC}>"""
EDGES = "graph_key string, src string, dst string, kind string, warrant string, basis string, adapter string"
DIAGNOSTICS = "graph_key string, code string, level string, message string, node_id string, source_json string, adapter string"
ANNOTATIONS = "graph_key string, namespace string, node_id string, key string, value_json string"


class TraceGraphError(Exception):
    """A deliberate refusal; code says which."""

    def __init__(self, message: str, code: str = "tracegraph_error"):
        super().__init__(message)
        self.code = code


class AdapterSelectionError(TraceGraphError):
    pass


class UnknownAdapterError(TraceGraphError):
    pass


class DuplicateNodeIdError(TraceGraphError):
    pass


#: The type that goes with each error code.
ERROR_TYPES = {"duplicate_node_id": "DuplicateNodeIdError", "unknown_adapter": "UnknownAdapterError"} | {
    c: "AdapterSelectionError" for c in ("no_adapters_registered", "adapter_ambiguous", "adapter_unconfident", "adapter_detect_failed", "duplicate_adapter_id")
}


def error_of(code: str, message: str) -> TraceGraphError:
    return globals()[ERROR_TYPES.get(code, "TraceGraphError")](message, code)
