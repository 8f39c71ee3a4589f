"""Spans from relational tables: orders and their lines, a hierarchy, events, dialogues, payloads.

Each function gives SPANS-shaped columns of one view, lazily; columns that a plan does not use are pruned down to
the Parquet scan. Times are microseconds since 1970 of zone-less timestamps, as seconds, in no session's zone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from ..schema import SPANS



def _micros(column: str) -> Column:
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {column})")


def _spans(df: DataFrame, **columns: Column | str) -> DataFrame:
    """df as spans; what is not named is null, unset or empty."""
    given = {k: F.expr(v) if isinstance(v, str) else v for k, v in columns.items()}
    given.setdefault("source_key", given.get("span_id", F.lit(None)))
    given.setdefault("status", F.lit("unset"))
    given.setdefault("name", F.lit(""))
    given.setdefault("attributes_json", F.lit("{}"))
    out = []
    for f in StructType.fromDDL(SPANS).fields:
        c = given.get(f.name)
        if c is None and f.dataType.typeName() == "array":
            c = F.expr("array()")
        out.append((F.lit(None) if c is None else c).cast(f.dataType).alias(f.name))
    return df.select(*out)


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


LINE_KEY = "concat_ws('-', concat('l', l_orderkey), l_linenumber, l_partkey, l_suppkey, cast(l_quantity as bigint), t)"


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    lines = _read(spark, sf_dir, "lineitem").withColumn("t", _micros("l_shipdate"))
    return lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"])


def commerce(spark: SparkSession, sf_dir: str, without: str = "false", key: str = LINE_KEY, source_key: str | None = None) -> DataFrame:
    """A graph a customer: orders, and their lines below them. without: orders that are left out, so that their lines are orphans."""
    orders = _read(spark, sf_dir, "orders").where(f"not ({without})").withColumn("t", _micros("o_orderdate"))
    top = _spans(orders, graph_key="cast(o_custkey as string)", span_id="concat('o', o_orderkey)", trace_id="concat('c', o_custkey)", kind=F.lit("chain"), started_at="t / 1e6")
    below = _spans(
        _lines(spark, sf_dir), graph_key="cast(o_custkey as string)", span_id=key, source_key=source_key or key, parent_id="concat('o', l_orderkey)",
        trace_id="concat('c', o_custkey)", kind=F.lit("tool"), operation="l_returnflag", started_at="t / 1e6",
        ended_at=F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', o_orderdate) / 1e6"), status="if(l_linestatus = 'F', 'ok', 'unset')",
    )
    return top.unionByName(below)


def hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One graph: regions, nations, customers, orders."""

    def level(table, key, parent, start=None):
        return _spans(_read(spark, sf_dir, table), graph_key=F.lit("world"), span_id=key, parent_id=F.lit(None) if parent is None else parent, kind=F.lit("chain"), started_at=F.lit(None) if start is None else start)

    out = level("region", "concat('r', r_regionkey)", None)
    out = out.unionByName(level("nation", "concat('n', n_nationkey)", "concat('r', n_regionkey)"))
    out = out.unionByName(level("customer", "concat('c', c_custkey)", "concat('n', c_nationkey)"))
    return out.unionByName(level("orders", "concat('o', o_orderkey)", "concat('c', o_custkey)", _micros("o_orderdate") / 1e6))


EVENT_KINDS = {"click": "tool", "view": "retriever", "purchase": "llm", "signup": "agent"}


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph a user: events, all at the root. Errors have an unknown kind and another trace."""
    e = _read(spark, sf_dir, "events").withColumn("t", _micros("ts"))
    kind = F.coalesce(F.create_map(*[F.lit(x) for kv in EVENT_KINDS.items() for x in kv])[F.col("event_type")], F.lit("unknown"))
    note = F.struct(F.lit("unknown_span_kind").alias("code"), F.lit("warning").alias("level"), F.concat(F.lit("no known kind: "), "event_type").alias("message"), F.concat(F.lit('"'), "event_type", F.lit('"')).alias("source_json"))
    extra = F.expr("cast(map() as map<string, bigint>)")
    usage = F.struct(F.expr("cast(floor(value) as bigint)").alias("input_tokens"), F.expr("cast(get_json_object(props, '$.k') as bigint)").alias("output_tokens"), F.lit(None).cast("long").alias("total_tokens"), extra.alias("extra"))
    return _spans(
        e, graph_key="cast(user_id as string)", span_id="concat('e', event_id)", trace_id="concat(if(event_type = 'error', 'x', 'u'), user_id)", kind=kind, name="event_type",
        operation="event_type", started_at="t / 1e6", status="if(event_type = 'error', 'error', 'ok')", inputs=_payload(F.col("props"), F.lit("application/json")),
        usage=F.when(kind == "llm", usage), diagnostics=F.when(kind == "unknown", F.array(note)),
    )


def dialogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph a conversation. A user's turn asks call q<turn> and is shown the result of the one before; an
    assistant's answers that of the turn before; every turn links to the first, a user's also out of the graph."""
    c = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    link = lambda to: F.struct(to.alias("span_id"), F.lit(None).cast("string").alias("trace_id"), F.lit("span.link").alias("basis"))
    user = F.col("role") == "user"
    return _spans(
        c, graph_key="cast(conv_id as string)", span_id="concat('t', turn)", trace_id="concat('d', conv_id)", kind="case role when 'user' then 'agent' when 'assistant' then 'llm' else 'chain' end",
        operation=F.when(F.col("role") == "assistant", "assistant"), started_at="cast(turn as double)", inputs=_payload(F.col("text"), F.lit("text/plain")),
        call_ids=F.when(user, F.array(F.concat(F.lit("q"), "turn"))).when(F.col("role") == "assistant", F.array(F.concat(F.lit("q"), F.col("turn") - 1))).otherwise(F.expr("cast(array() as array<string>)")),
        call_role=F.when(user, "requester").when(F.col("role") == "assistant", "fulfiller"),
        links=F.when(user, F.array(link(F.lit("t0")), link(F.concat(F.lit("x"), "conv_id")))).otherwise(F.array(link(F.lit("t0")))),
        received_call_ids=F.when(user, F.array(F.concat(F.lit("q"), F.col("turn") - 2))).otherwise(F.expr("cast(array() as array<string>)")),
    )


def _payload(value: Column, mime: Column) -> Column:
    state = F.when(value.isNull(), "absent").when(value == "", "empty").otherwise("present")
    return F.struct(state.alias("state"), F.when(value.isNotNull(), mime).alias("mime"), F.lit(None).cast("string").alias("value_json"), value.alias("raw"))


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph a table: documents, pages and events as retrieved payloads."""
    def of(table, key, value, mime):
        return _spans(_read(spark, sf_dir, table), graph_key=F.lit(table), span_id=f"concat('{table[0]}', {key})", kind=F.lit("retriever"), inputs=_payload(F.col(value), F.lit(mime)))

    return of("documents", "doc_id", "text", "text/plain").unionByName(of("pages", "page_id", "html", "text/html")).unionByName(of("events", "event_id", "props", "application/json"))
