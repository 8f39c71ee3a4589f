"""Cutting lineage in a folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir of the session, or the one set on its context. Where neither
    is set, a new temporary folder if all runs on this machine (a local master), else an error: no other machine could read it."""
    sc = spark.sparkContext
    there = sc._jsc.sc().getCheckpointDir()
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None) or (there.get() if there.isDefined() else None)
    if found is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="checkpoints-")
    if not there.isDefined():
        sc.setCheckpointDir(found)
    return found


def settled(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read from there; survives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_made: list[str] = []  # paths of fresh_path


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder. What is written there is read as long as results are; see remove_tables."""
    _made.append(f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}")
    return _made[-1]


def remove_tables(spark: SparkSession) -> int:
    """Deletes what operators wrote under fresh_path in this process; results that are not written yet are lost. How many there were."""
    gone = 0
    while _made:
        path = spark._jvm.org.apache.hadoop.fs.Path(_made.pop())
        gone += bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True))
    return gone


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """Like settled(), as compressed Parquet: for tables of many rows, and those of which later steps read few columns."""
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
