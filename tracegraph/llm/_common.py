"""Helpers shared by the operators of this package."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import AtomicType, NullType

from ..functions.storage import fresh_path, remove_tables, settled, shared_dir, stored  # noqa: F401  operators take them from here

#: A word of the contracts is a run of bytes other than these ASCII spaces.
WORD = r"[^\x20\x09-\x0D]+"
DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the shared folder and forget how it was made; survives lost executors."""
    return settled(df)


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, on an array of unsigned 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = {_BASE: np.ones(1, np.uint64), _INVERSE: np.ones(1, np.uint64)}


def _power_table(base: int, n: int) -> np.ndarray:
    have = _powers[base]
    while len(have) < n:
        have = np.concatenate([have, have * np.uint64(pow(base, len(have), 1 << 64))])
    _powers[base] = have
    return have


def span_hashes(units: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of units[starts:ends] for many spans at once.

    A polynomial over the units, read off one running sum, brought to a common exponent
    and finished with the span's length; equal spans have equal hashes wherever they lie.
    """
    n = len(units)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((units.astype(np.uint64) + np.uint64(1)) * _power_table(_BASE, n)[:n], out=total[1:])
    value = (total[ends] - total[starts]) * _power_table(_INVERSE, n + 1)[starts]
    return mix64(value ^ ((ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))


def spans_of(flag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.diff(np.concatenate([[0], flag.view(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def column_bytes(array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow string array without nulls, and each row's offsets in them."""
    import pyarrow as pa

    if not pa.types.is_large_string(array.type):
        array = array.cast(pa.large_string())
    offsets = np.frombuffer(array.buffers()[1], np.int64)[array.offset : array.offset + len(array) + 1]
    data = array.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]] if len(offsets) else whole[:0], offsets - offsets[0]


def text_or_empty(batch, name: str = "text"):
    import pyarrow as pa
    import pyarrow.compute as pc

    return pc.fill_null(batch.column(name).cast(pa.large_string()), "")


def pieces_of(batch, rows_bytes: int = 1 << 20, name: str = "text"):
    """Slices of an Arrow batch of about rows_bytes of text each, so that memory does not follow the batch's size and arrays stay in cache."""
    import pyarrow as pa
    import pyarrow.compute as pc

    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(name)), 0)).astype(np.int64)
    part = np.cumsum(sizes) // rows_bytes
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(sizes)]])
    for a, b in zip(cuts[:-1], cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)
    pa.default_memory_pool().release_unused()  # a worker goes on to other stages


def row_key(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", name: str = "_th") -> DataFrame:
    """Adds _th, a hash of the text: with the id it names a row; repeated rows share it."""
    return df.withColumn(name, F.hash(F.coalesce(F.col(text_col), F.lit(""))))


class Sealed:
    """A table whose columns have names by place (c0, c1, ...), so that an operator's own columns clash with none of them.

    df is that table; seal["text"] is the name of its column text there, and opened(df) has the first names again."""

    def __init__(self, df: DataFrame):
        self.names = list(df.columns)
        self.columns = [f"c{i}" for i in range(len(self.names))]
        self.df = df.toDF(*self.columns)

    def __getitem__(self, name: str) -> str:
        return self.columns[self.names.index(name)]

    def free(self, name: str) -> str:
        """name, with underscores after it as long as the table has a column of that name."""
        taken = {x.lower() for x in self.names}
        while name.lower() in taken:
            name += "_"
        return name

    def opened(self, df: DataFrame, **more: str) -> DataFrame:
        """The columns of the table in df under their first names, then those of df that more names, under free names."""
        return df.select(*self.columns, *more.values()).toDF(*self.names, *map(self.free, more))


def row_hash(df: DataFrame):
    """A 64-bit hash of all columns of a row: equal rows have equal ones."""
    parts = []
    for i, f in enumerate(df.schema.fields):
        c = F.col(f"`{f.name}`")
        plain = isinstance(f.dataType, (AtomicType, NullType)) and f.dataType.typeName() != "variant"
        parts += [F.lit(i), c if plain else F.to_json(F.struct(c))]  # the number tells which columns are null
    return F.xxhash64(*parts)
