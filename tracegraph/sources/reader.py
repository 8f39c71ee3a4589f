"""Reading telemetry: JSON lines or a JSON array per input, every input a graph of its own.

`inputs` gives a row an input (graph_key, content); `parsed` turns each into rows: one a record with its span,
one a line that is no JSON, and one for the input with its digest, adapter or refusal. An input is parsed in one go
by one task, in pieces that do not depend on partitioning: record numbers come from its own lines.
"""

from __future__ import annotations

import hashlib
import json
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..schema import DIAGNOSTICS, SPANS, TraceGraphError
from . import registry as registries
from .registry import Registry

PARSED = (
    f"row string, {SPANS}, text string, parse_error string, source_digest string, adapter_id string, adapter_version string, "
    "declared_confidence double, error_code string, error_message string"
)
_BATCH = 500  # rows handed on at a time, of several inputs where those are small
_BYTES = 1 << 22  # of content, after which they are handed on too
ROWS = ("graph", "malformed", "span")

def _literal(spark: SparkSession, path: str) -> tuple[str, str] | None:
    """(path as a glob of itself, file name) of a path that names a file; None if there is none of that very name."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    try:
        at = hadoop(path)
        status = at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at)
    except Exception:  # the file system has its own errors for what is no path or not there
        return None
    if status.isDirectory():
        return None
    return "".join(f"\\{c}" if c in "*?[]{}\\" else c for c in status.getPath().toString()), at.getName()


def _bytes_of(spark: SparkSession, path: str) -> bytes:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = at.getFileSystem(spark._jsc.hadoopConfiguration()).open(at)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
    finally:
        stream.close()


def inputs(spark: SparkSession, *sources: str | bytes | Path) -> DataFrame:
    """(graph_key, content) of the sources: bytes are content, "-" is standard input, all else the path of a file, or
    a folder or glob where no file has that very name. Spark leaves out files whose names begin with _ or . ; those that are named
    as they are, and not by a glob, are read by the driver."""
    paths, given = [], []
    for i, s in enumerate(sources):
        if isinstance(s, bytes) or s == "-":
            given.append((f"input-{i}", s if isinstance(s, bytes) else sys.stdin.buffer.read()))
            continue
        named = _literal(spark, str(s))
        if named is not None and named[1][:1] in "_.":
            given.append((str(s), _bytes_of(spark, str(s))))
        else:
            paths.append(str(s) if named is None else named[0])
    out = spark.createDataFrame([(k, bytearray(c)) for k, c in given], "graph_key string, content binary") if given or not paths else None
    if paths:
        files = spark.read.format("binaryFile").load(paths).select(F.col("path").alias("graph_key"), "content")
        out = files if out is None else files.unionByName(out)
    return out


def records_of(content: bytes) -> tuple[list[tuple[int, object]], list[tuple[int | None, str, str]]]:
    """((line, value) of each record, (line, text, problem) of what is none). Lines count from 1, blank ones too."""
    good, bad = [], []
    if content.lstrip()[:1] == b"[":
        text = content.decode("utf-8", "replace")
        try:
            return [(i, v) for i, v in enumerate(json.loads(text), 1)], bad
        except (ValueError, RecursionError) as error:
            return [], [(None, text, f"the array is not readable: {error}")]
    for n, line in enumerate(content.split(b"\n"), 1):
        text = line.decode("utf-8", "replace").strip()
        if text:
            try:
                good.append((n, json.loads(text)))
            except (ValueError, RecursionError) as error:
                bad.append((n, text, f"line {n} is not readable: {error}"))
    return good, bad

def parsed(source: DataFrame, adapter: str | None = None, registry: Registry | None = None, kinds: tuple[str, ...] = ROWS) -> DataFrame:
    """PARSED rows of (graph_key, content). adapter: its id; else each input's is detected. kinds: the rows that are asked for, of ROWS;
    every record is read in any case, and spans are made of them only if asked for."""
    registry = registry or registries.default
    if adapter is not None:
        registry.get(adapter)

    schema = to_arrow_schema(StructType.fromDDL(PARSED))

    def rows(key: str, content: bytes):
        digest = hashlib.sha256(content).hexdigest()
        good, bad = records_of(content)
        about = {"row": "graph", "graph_key": key, "source_digest": digest}
        try:
            values = [v for _, v in good]
            chosen, confidence = (registry.get(adapter), None) if adapter is not None else registry.detect(values)
            about |= {"adapter_id": chosen.id, "adapter_version": chosen.version, "declared_confidence": confidence}
        except TraceGraphError as error:
            if "graph" in kinds:
                yield about | {"error_code": error.code, "error_message": str(error)}
            return
        if "graph" in kinds:
            yield about
        if "malformed" in kinds:
            for line, text, problem in bad:
                yield {"row": "malformed", "graph_key": key, "line_no": line, "text": text, "parse_error": problem, "adapter_id": chosen.id}
        if "span" in kinds:
            own = {"row": "span", "graph_key": key, "adapter_id": chosen.id, "adapter_version": chosen.version}
            for (line, _), span in zip(good, chosen.parse(values)):
                yield own | {"line_no": line} | span

    def run(batches):
        import pyarrow as pa

        held, size = [], 0
        for batch in batches:
            for key, content in zip(batch.column("graph_key").to_pylist(), batch.column("content")):
                content = content.as_py()
                size += len(content)
                for row in rows(key, content):
                    held.append(row)
                    if len(held) == _BATCH:
                        yield _arrow(held, schema)
                        held, size = [], 0
                if size >= _BYTES and held:
                    yield _arrow(held, schema)
                    held, size = [], 0
        if held:
            yield _arrow(held, schema)

    return source.select("graph_key", "content").mapInArrow(run, PARSED)

def _arrow(rows: list[dict], schema):
    """Rows as an Arrow batch: maps as Arrow wants them, and strings that UTF-8 cannot hold (lone surrogates) as their escapes."""
    import pyarrow as pa

    def fix(x):
        if isinstance(x, str):
            try:
                x.encode()
                return x
            except UnicodeEncodeError:
                return x.encode("utf-8", "backslashreplace").decode()
        if isinstance(x, (list, tuple)):
            return type(x)(fix(v) for v in x)
        if isinstance(x, dict):
            return {k: fix(v) for k, v in x.items()}
        return x

    for r in rows:
        if used := r.get("usage"):
            r["usage"] = used | {"extra": list(used["extra"].items())}
    try:
        return pa.RecordBatch.from_pylist(rows, schema)
    except UnicodeError:
        return pa.RecordBatch.from_pylist([fix(r) for r in rows], schema)

def spans_of(rows: DataFrame) -> DataFrame:
    """Spans with the adapter of their input; only inputs that are not refused have any."""
    return rows.where("row = 'span'").select(*_names(SPANS), "adapter_id", "adapter_version")

def graphs_of(rows: DataFrame) -> DataFrame:
    return rows.where("row = 'graph'").select("graph_key", "source_digest", "adapter_id", "adapter_version", "declared_confidence", "error_code", "error_message")

def malformed_of(rows: DataFrame) -> DataFrame:
    """DIAGNOSTICS rows of what could not be read."""
    from ..functions import json_text

    return rows.where("row = 'malformed'").select(
        "graph_key", F.lit("malformed_record").alias("code"), F.lit("warning").alias("level"), F.col("parse_error").alias("message"),
        F.lit(None).cast("string").alias("node_id"), json_text(F.col("text")).alias("source_json"), "adapter_id",
    ).toDF(*[f.split()[0] for f in DIAGNOSTICS.split(", ")])

def _names(ddl: str) -> list[str]:
    return StructType.fromDDL(ddl).names
