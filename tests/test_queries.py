"""A few registered queries against DuckDB; the rest of them is held against it by the same comparison."""

import importlib.util
import os

import pytest

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
NAMES = ["edge_counts_by_kind_warrant", "derived_ids", "call_result_edges", "temporal_edges_sliced", "topo_order_activity", "descendants_region", "paths_dialogue", "inspect_tallies", "fleet_failures", "diagnostics_ordered_rank", "roots", "topo_order_commerce", "shared_call_edges", "annotation_last_wins", "graph_coverage", "jsonl_digests", "jsonl_spans", "jsonl_diagnostics", "jsonl_malformed", "jsonl_array_scan", "jsonl_refused", "document_counts", "document_nodes", "document_validation", "unaccounted_records"]


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents pages conversations".split():
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    import __spark_entry__ as entry

    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(str(r[c]) for c in columns) for r in df.collect())
    r = duck.sql(entry.oracle_sql()[name])
    want = sorted(tuple(str(x[r.columns.index(c)]) for c in columns) for x in r.fetchall())
    assert sorted(r.columns) == columns and got == want


def test_entry_imports_with_or_without_the_llm_package():
    import __spark_entry__ as entry

    try:
        there = importlib.util.find_spec("tracegraph.llm.queries") is not None and importlib.util.find_spec("corpus_pipeline") is not None
    except ModuleNotFoundError:
        there = False
    assert ("pipeline" in entry.queries()) == there
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_ancestors_of_every_line(spark, duck):
    import __spark_entry__ as entry

    got = sorted(tuple(r) for r in entry.queries()["ancestors_lineitem"](spark, SF).select("start", "node_id", "depth").collect())
    assert got == sorted(duck.sql(entry.oracle_sql()["ancestors_lineitem"]).fetchall())
    orders = duck.sql("select count(distinct l_orderkey) from lineitem").fetchall()[0][0]
    assert len({n for _, n, depth in got if depth == 1}) == orders
