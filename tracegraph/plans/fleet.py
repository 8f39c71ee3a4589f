"""The roll-up of many graphs as one report."""

from __future__ import annotations

from ..operators import rollup
from .build import TraceGraphs

UNATTRIBUTED = "a call that nothing answered names the node that asked, not the tool it asked for; so by_tool stays empty"


def report(g: TraceGraphs) -> dict:
    """Counts over all graphs; a refused one is listed and costs the others nothing. As many rows as labels are collected."""
    pairs = lambda df: {r[0]: r[1] for r in sorted(df.collect())}
    counts = rollup.counts(g.graphs_df).first().asDict()
    codes = pairs(rollup.diagnostic_counts(g.diagnostics_df))
    open_calls = codes.get("unpaired_call", 0)
    return {
        "traces": counts,
        "node_kinds": pairs(rollup.node_kinds(g.nodes_df)),
        "diagnostics": codes,
        "tools": {r["operation"]: {k: r[k] for k in ("calls", "errors", "ok", "unset")} for r in sorted(rollup.tools(g.nodes_df).collect())},
        "models": pairs(rollup.models(g.nodes_df)),
        "unfulfilled_calls": {"total": open_calls, "by_model": pairs(rollup.askers(g.nodes_df, g.diagnostics_df)), "by_tool": {}},
        "unfulfilled_results": codes.get("unpaired_result", 0),
        "unbuildable": [{"source": r["graph_key"], "code": r["error_code"], "type": r["error_type"]} for r in rollup.failures(g.graphs_df).collect()],
        "limits": [UNATTRIBUTED] if open_calls else [],
    }


def table(found: dict) -> list[str]:
    """The report as lines of fixed columns."""
    out = []
    for part in ("traces", "node_kinds", "diagnostics", "models"):
        out += [part, *(f"  {k:<32}{v:>10}" for k, v in found[part].items())]
    out += ["tools" + " " * 29 + "".join(f"{h:>10}" for h in ("calls", "errors", "ok", "unset"))]
    out += [f"  {k:<32}" + "".join(f"{v[h]:>10}" for h in ("calls", "errors", "ok", "unset")) for k, v in found["tools"].items()]
    calls = found["unfulfilled_calls"]
    out += [f"unfulfilled calls{calls['total']:>27}", *(f"  {k:<32}{v:>10}" for k, v in calls["by_model"].items())]
    out += [f"unfulfilled results{found['unfulfilled_results']:>25}"]
    out += ["unbuildable", *(f"  {x['source']}: {x['code']}" for x in found["unbuildable"])]
    return out + found["limits"]
