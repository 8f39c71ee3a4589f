"""Content-addressed store of token-id streams.

Each document's ids are cut where a rolling hash of the last ids says so; a chunk is stored once under the
SHA-256 of its bytes; a document's recipe lists its chunks; recipes lie in ascending doc_id order with the
running id count, and Merkle roots (over a document's chunks, a recipe part's documents, all parts) let a
reader verify what it rebuilds. Layout below the store's path, all Parquet:

  objects/kind=chunk   hash, n, ids (little-endian, `width` bytes an id); one row a hash
  objects/kind=recipe  doc_id, th, chunks, n_tokens, root; one row a document, in no order
  recipes              part, doc_id, th, start, n_tokens, chunks array<struct<hash, n>>, root; ascending
  manifest             part, docs, tokens, root; one row a recipe part, and part -1 for the whole

A task sends a chunk's bytes once; documents' rows are dealt by their id and not by a chunk they hold, so a chunk that
many share stands in no task more often than there are tasks.

Defined results: a null text is empty; an empty document has one chunk with only the end id; an empty table gives an empty
store, whose manifest has only part -1; repeated rows are kept, each with its own place; null doc_ids come first; rows of
one doc_id lie in the order of a hash of their text; other columns are ignored, whatever their names. A text is encoded in
slices of rows, but always whole, however long.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ._common import column_bytes, documents, fresh_path, mix64, pieces_of, row_key, span_hashes, text_or_empty

END_ID = 0
AVERAGE = 512  # ids a chunk, on average; a power of two
LONGEST = 8192
WINDOW = 16  # ids that the rolling hash sees; a power of two
MEMO = 2_000_000  # distinct units that a Python worker remembers, of 45 bytes or so each; beyond them it begins anew
RECENT = 1 << 17  # of them, those not yet merged with the others
LONG = 64  # bytes of a unit beyond which it is not remembered
SLICE = 1 << 20  # bytes of text worked on at a time
SENT = 200_000  # hashes of chunks that a task remembers having sent
HOT = 10_000  # documents that may meet a chunk by its hash in one task; more, and the chunk is one of those sent to all tasks
#: White space of the tokenizer's splitting pattern besides that of ASCII, and what some count as such.
_ODD = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_ODD_LEAD = np.zeros(256, bool)  # the first bytes of these
_ODD_LEAD[[0x1C, 0x1D, 0x1E, 0x1F, 0xC2, 0xE1, 0xE2, 0xE3]] = True
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_WORD = np.zeros(256, bool)  # ASCII letters and digits
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_MARK = np.zeros(256, bool)  # ASCII marks but the apostrophe, which may begin a match of letters
_MARK[[x for x in range(33, 127) if not _WORD[x] and x != 39]] = True


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def splits_at_spaces(spec: dict) -> bool:
    """Whether a tokenizer (its JSON) is byte-level BPE with the splitting pattern that never joins across the start of a
    run of white space, and changes nothing of a text before it splits it."""
    splitter, model = spec.get("pre_tokenizer") or {}, spec.get("model") or {}
    plain = spec.get("normalizer") is None and spec.get("post_processor") in (None, {"type": "ByteLevel"}) and spec.get("truncation") is None and spec.get("padding") is None
    split = splitter.get("type") == "ByteLevel" and splitter.get("use_regex", True) and not splitter.get("add_prefix_space", True)
    return bool(plain and split and model.get("type") == "BPE" and not model.get("dropout"))


class Memo:
    """What units (spans of bytes) are encoded as, found by arrays: a hash, and the first and last eight bytes, which must agree too."""

    def __init__(self, dtype: str):
        self.pool, self.used = np.zeros(1 << 16, dtype), 0
        self.main, self.recent = self._none(), self._none()

    @staticmethod
    def _none() -> tuple[np.ndarray, ...]:
        """Hashes (sorted), first bytes, last bytes, place in the pool, number of ids."""
        return (*(np.zeros(0, np.uint64) for _ in range(3)), np.zeros(0, np.int64), np.zeros(0, np.int32))

    def find(self, h: np.ndarray, head: np.ndarray, tail: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place, number of ids, and whether the unit is known."""
        at, n, hit = np.zeros(len(h), np.int64), np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        for keys, first, last, place, count in (self.main, self.recent):
            if len(keys):
                i = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                same = (keys[i] == h) & (first[i] == head) & (last[i] == tail)
                at[same], n[same], hit = place[i[same]], count[i[same]], hit | same
        return at, n, hit

    def put(self, ids: np.ndarray) -> int:
        """Appends ids to the pool; where they begin."""
        at, self.used = self.used, self.used + len(ids)
        if self.used > len(self.pool):
            self.pool = np.concatenate([self.pool[:at], np.zeros(max(len(self.pool), self.used - at), self.pool.dtype)])
        self.pool[at : self.used] = ids
        return at

    @staticmethod
    def _merged(a: tuple, b: tuple) -> tuple[np.ndarray, ...]:
        keys = np.concatenate([a[0], b[0]])
        order = np.argsort(keys, kind="stable")
        return tuple(np.concatenate([x, y])[order] for x, y in zip(a, b))

    def add(self, *columns: np.ndarray) -> None:
        order = np.argsort(columns[0], kind="stable")
        self.recent = self._merged(self.recent, tuple(c[order] for c in columns))
        if len(self.recent[0]) > RECENT:
            self.main, self.recent = self._merged(self.main, self.recent), self._none()

    def trim(self) -> None:
        """Forgets all once it holds MEMO units."""
        if len(self.main[0]) + len(self.recent[0]) > MEMO:
            self.__init__(self.pool.dtype)


class Encoder:
    """Encodes whole texts with a tokenizer of the tokenizers library.

    The splitting pattern of byte-level BPE never joins across the start of white space after what is none, and a match does
    not depend on what lies before it. So a unit (white space and the word after it) has the same ids wherever it stands:
    the distinct units of a slice are found by hash, and those not met before are encoded. A text with white space beyond ASCII or
    with a special token in it is one unit, and so is every text if the tokenizer is of another kind.
    """

    def __init__(self, vocabulary: str, dtype: str | None = None):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.dtype = dtype or ("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.splits = splits_at_spaces(json.loads(self.tokenizer.to_str()))
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.memo = Memo(self.dtype)
        if self.splits:
            (self.newline,) = self._encode(["\n"])[0]

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_units(self, units: list[bytes], plain: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of units, where those of each begin, and how many there are. Plain ones, which hold no white space but a space before a word, are
        encoded as the lines of a text and parted at its line feeds; the others one by one."""
        made, count, lines = [], np.zeros(len(units), np.int64), np.flatnonzero(plain)
        for a in range(0, len(lines), 256):
            some = lines[a : a + 256]
            data = np.array(self._encode([b"\n".join([units[k] for k in some.tolist()]).decode()])[0], self.dtype)
            at = np.flatnonzero(data == self.newline)
            count[some] = np.diff(np.concatenate([[-1], at, [len(data)]])) - 1
            made.append(np.delete(data, at))
        rest = np.flatnonzero(~plain)
        for k in rest.tolist():
            made.append(np.array(self._encode([units[k].decode()])[0], self.dtype))
            count[k] = len(made[-1])
        order = np.concatenate([lines, rest])
        at = np.cumsum(count[order])
        begin = np.empty(len(units), np.int64)
        begin[order] = at - count[order]
        return np.concatenate(made) if made else np.zeros(0, self.dtype), begin, count

    def __call__(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """texts: an Arrow string array without nulls. The ids of all, END_ID after each text, and where each one's end."""
        data, offsets = column_bytes(texts)
        n, size = len(offsets) - 1, len(data)
        space = _SPACE[data]
        start = space.copy()
        start[1:] &= ~space[:-1]
        start[1:] |= _MARK[data[1:]] & _WORD[data[:-1]]
        if size > 2:  # after one line feed between what is no white space
            start[2:] |= ~space[2:] & (data[1:-1] == 10) & ~space[:-2]
        whole = self._whole_rows(data, offsets)
        for row in np.flatnonzero(whole).tolist():
            start[offsets[row] : offsets[row + 1]] = False
        start[offsets[:-1][np.diff(offsets) > 0]] = True
        starts = np.flatnonzero(start)
        ends = np.concatenate([starts[1:], [size]])[: len(starts)]
        h, first, which = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
        a, b = starts[first], ends[first]
        head, tail = self._edges(data, a, b)
        at, count, hit = self.memo.find(h, head, tail)
        new = np.flatnonzero(~hit)
        if len(new):
            spaces = np.concatenate([[0], np.cumsum(space)])
            inside = spaces[b[new]] - spaces[a[new]]
            lead = data[a[new]]
            odd = whole[np.searchsorted(offsets, a[new], side="right") - 1]
            plain = ~odd & ((inside == 0) | (inside == 1) & (lead == 32) & (b[new] - a[new] > 1))
            raw = data.tobytes()
            ids, begin, count[new] = self._encode_units([raw[x:y] for x, y in zip(a[new].tolist(), b[new].tolist())], plain)
            at[new] = self.memo.put(ids) + begin
            short = new[b[new] - a[new] <= LONG]
            self.memo.add(h[short], head[short], tail[short], at[short], count[short].astype(np.int32))
        # the end id after each text is a unit of its own
        end_at = self.memo.put(np.array([END_ID], self.dtype))
        last = np.searchsorted(starts, offsets[1:])
        which = np.insert(which, last, len(h))
        at, count = np.append(at, end_at), np.append(count, 1)
        each = count[which]
        stop = np.cumsum(each)
        ids = self.memo.pool[np.repeat(at[which] - (stop - each), each) + np.arange(stop[-1] if len(stop) else 0)]
        self.memo.trim()
        return ids, stop[last + np.arange(n)]

    def _whole_rows(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Whether each text is one unit."""
        n = len(offsets) - 1
        whole = np.full(n, not self.splits)
        if not self.splits:
            return whole
        rows = np.unique(np.searchsorted(offsets, np.flatnonzero(_ODD_LEAD[data]), side="right") - 1)
        for row in rows.tolist():
            whole[row] = bool(_ODD.search(data[offsets[row] : offsets[row + 1]].tobytes().decode()))
        raw = data.tobytes()
        for s in self.special:
            at = raw.find(s)
            while at >= 0:
                whole[np.searchsorted(offsets, at, side="right") - 1] = True
                at = raw.find(s, at + 1)
        return whole

    @staticmethod
    def _edges(data: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first and the last eight bytes of spans, as numbers."""
        head, tail = np.zeros(len(a), np.uint64), np.zeros(len(a), np.uint64)
        for k in range(8):
            own = a + k < b
            head[own] |= data[a[own] + k].astype(np.uint64) << np.uint64(8 * k)
            tail[own] |= data[b[own] - 1 - k].astype(np.uint64) << np.uint64(8 * k)
        return head, tail


@functools.cache
def encoder(vocabulary: str) -> Encoder:
    return Encoder(vocabulary)


_GEAR = mix64(np.arange(1 << 16, dtype=np.uint64) + np.uint64(0x51ED270B))


def chunk_ends(ids: np.ndarray, stream_ends: np.ndarray) -> np.ndarray:
    """Where chunks end: after ids at which a hash of the last WINDOW ids has its low bits zero, at the end of
    each stream, and LONGEST ids after the last end. A cut depends on the WINDOW ids before it only, so equal passages are
    cut alike but for their first ids."""
    h = _GEAR[ids & 0xFFFF]
    width = 1
    while width < WINDOW:  # the hash of twice as many ids: that of the last half, and that of the half before it, shifted
        double = h.copy()
        double[width:] += h[:-width] << np.uint64(width)
        h, width = double, 2 * width
    ends = np.flatnonzero((h >> np.uint64(8)) & np.uint64(AVERAGE - 1) == 0) + 1
    ends = np.union1d(ends, stream_ends)
    gap = np.diff(np.concatenate([[0], ends]))
    long = np.flatnonzero(gap > LONGEST)
    more = [np.arange(ends[i] - gap[i] + LONGEST, ends[i], LONGEST) for i in long]
    return np.union1d(ends, np.concatenate(more)) if more else ends


class Merkle:
    """Root of a binary hash tree over leaves that are added one by one; a leaf without a neighbour rises as it is. Keeps a hash a level."""

    def __init__(self) -> None:
        self.n, self.peaks = 0, []

    def add(self, leaf: bytes) -> None:
        node, n = hashlib.sha256(b"\0" + leaf).digest(), self.n
        while n & 1:
            node, n = hashlib.sha256(b"\1" + self.peaks.pop() + node).digest(), n >> 1
        self.peaks.append(node)
        self.n += 1

    def root(self) -> bytes:
        if not self.peaks:
            return hashlib.sha256(b"").digest()
        node = self.peaks[-1]
        for left in reversed(self.peaks[:-1]):
            node = hashlib.sha256(b"\1" + left + node).digest()
        return node


def merkle(leaves) -> bytes:
    tree = Merkle()
    for leaf in leaves:
        tree.add(leaf)
    return tree.root()


CHUNK_LIST = "array<struct<hash: binary, n: int>>"
OBJECTS = f"kind string, hash binary, n int, ids binary, doc_id long, th int, chunks {CHUNK_LIST}, n_tokens long, root binary"
_CHUNK_COLUMNS, _RECIPE_COLUMNS = ("hash", "n", "ids"), ("doc_id", "th", "chunks", "n_tokens", "root")


def _objects(pa, kind: str, schema, rows: int, **columns):
    """Rows of one kind, null where the other kind has its columns."""
    made = [pa.array([kind] * rows) if f.name == "kind" else columns[f.name] if f.name in columns else pa.nulls(rows, f.type) for f in schema]
    return pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip(made, schema)], schema=schema)


def encoded_objects(docs: DataFrame, vocabulary: str) -> DataFrame:
    """OBJECTS rows of docs (doc_id, text, _th): a recipe for each, and the chunks, each once a task or a few times more."""

    schema = to_arrow_schema(StructType.fromDDL(OBJECTS))

    def run(batches):
        import pyarrow as pa

        entry = schema.field("chunks").type.value_type
        encode, sent = encoder(vocabulary), set()
        size = np.dtype(encode.dtype).itemsize
        for batch in batches:
            for part in pieces_of(batch, SLICE):
                values, stops = encode(text_or_empty(part))
                ends = chunk_ends(values, stops)
                starts = np.concatenate([[0], ends[:-1]])
                data = memoryview(values.tobytes())
                hashes = [hashlib.sha256(data[a * size : b * size]).digest() for a, b in zip(starts.tolist(), ends.tolist())]
                last = np.searchsorted(ends, stops) + 1  # chunks up to the end of each document
                first = np.concatenate([[0], last[:-1]])
                lists = pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], last]).astype(np.int32)),
                    pa.StructArray.from_arrays([pa.array(hashes, pa.binary()), pa.array((ends - starts).astype(np.int32))], fields=list(entry)),
                )
                n = np.diff(np.concatenate([[0], stops])).astype(np.int64)
                roots = pa.array([merkle(hashes[a:b]) for a, b in zip(first.tolist(), last.tolist())], pa.binary())
                yield _objects(pa, "recipe", schema, part.num_rows, doc_id=part.column("doc_id"), th=part.column("_th"), chunks=lists, n_tokens=pa.array(n), root=roots)
                new = []
                for k, h in enumerate(hashes):
                    if h not in sent:
                        sent.add(h)
                        new.append(k)
                if new:
                    ids = pa.array([bytes(data[starts[k] * size : ends[k] * size]) for k in new], pa.binary())
                    yield _objects(pa, "chunk", schema, len(new), hash=pa.array([hashes[k] for k in new], pa.binary()), n=pa.array((ends - starts)[new].astype(np.int32)), ids=ids)
                if len(sent) > SENT:
                    sent.clear()

    return docs.select("doc_id", "text", "_th").mapInArrow(run, OBJECTS)


def _once(objects: DataFrame) -> DataFrame:
    """objects with one row of each chunk; recipes are spread by their document and pass."""

    def run(batches):
        import pyarrow as pa

        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            h = batch.column("hash").to_pylist()
            new = [a is None or a != b for a, b in zip(h, [last, *h[:-1]])]
            last = h[-1]
            yield batch.filter(pa.array(new))

    key = F.coalesce(F.xxhash64("hash"), F.xxhash64("doc_id", "th"))
    dealt = objects.withColumn("deal", F.when(F.col("hash").isNull(), F.xxhash64("doc_id", "root")).otherwise(key))
    return dealt.repartition("deal").sortWithinPartitions("hash").drop("deal").mapInArrow(run, OBJECTS)


RECIPES = f"part int, doc_id long, th int, start long, n_tokens long, chunks {CHUNK_LIST}, root binary"
PARTS = "part int, docs long, tokens long, root binary, ok boolean"


def _rooted(rows: DataFrame) -> DataFrame:
    """PARTS rows of recipes: each part's root over its documents' roots in order, made again from their chunks' hashes; ok:
    whether documents have the roots they state, and starts follow one another."""

    def run(batches):
        import pyarrow as pa

        part, tree, tokens, ok, at = None, Merkle(), 0, True, None

        def row():
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([tree.n], pa.int64()), pa.array([tokens], pa.int64()), pa.array([tree.root()], pa.binary()), pa.array([ok])],
                [c.split()[0] for c in PARTS.split(", ")],
            )

        for batch in batches:
            lists = batch.column("chunks")
            hashes = lists.flatten().field("hash").to_pylist()
            sizes = np.asarray(lists.value_lengths()).astype(np.int64)
            ends = np.cumsum(sizes)
            columns = (batch.column(c).to_pylist() for c in ("part", "start", "n_tokens", "root"))
            for p, start, n, stated, a, b in zip(*columns, (ends - sizes).tolist(), ends.tolist()):
                if p != part:
                    if part is not None:
                        yield row()
                    part, tree, tokens, ok, at = p, Merkle(), 0, True, None
                made = merkle(hashes[a:b])
                ok = ok and made == stated and at in (None, start)
                tree.add(made)
                tokens, at = tokens + n, start + n
        if part is not None:
            yield row()

    ordered = rows.select("part", "start", "n_tokens", "root", "chunks").repartition("part").sortWithinPartitions("part", "start")
    return ordered.mapInArrow(run, PARTS)


def _whole(parts: DataFrame) -> DataFrame:
    """The manifest's row for all parts: a row a part, in order of part, is read by one task."""

    def run(batches):
        import pyarrow as pa

        tree, docs, tokens, ok = Merkle(), 0, 0, True
        for batch in batches:
            for d, n, r, good in zip(*(batch.column(c).to_pylist() for c in ("docs", "tokens", "root", "ok"))):
                tree.add(r)
                docs, tokens, ok = docs + d, tokens + n, ok and good
        values = ((-1, pa.int32()), (docs, pa.int64()), (tokens, pa.int64()), (tree.root(), pa.binary()), (ok, pa.bool_()))
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in values], [c.split()[0] for c in PARTS.split(", ")])

    return parts.repartition(1).sortWithinPartitions("part").mapInArrow(run, PARTS)


def write_store(docs: DataFrame, path: str, vocabulary: str | None = None) -> str:
    """Writes the store of docs (doc_id, text) and returns its path."""
    spark = docs.sparkSession
    keyed = row_key(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    rows = _once(encoded_objects(keyed, vocabulary or default_vocabulary()))
    rows.write.partitionBy("kind").option("compression", "zstd").parquet(f"{path}/objects")
    order = ["doc_id", "th", "root"]  # rows equal in these are alike
    laid = _objects_of(spark, path).where("kind = 'recipe'").select(*_RECIPE_COLUMNS).repartitionByRange(*order).sortWithinPartitions(*order)
    laid.withColumn("part", F.spark_partition_id()).write.option("compression", "zstd").parquet(f"{path}/sorted")
    laid = spark.read.schema(f"part int, doc_id long, th int, n_tokens long, chunks {CHUNK_LIST}, root binary").parquet(f"{path}/sorted")  # the parts are fixed now
    totals = laid.groupBy("part").agg(F.sum("n_tokens").alias("tokens"))  # a row a part
    base = totals.select("part", F.coalesce(F.sum("tokens").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    within = W.partitionBy("part").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    recipes = laid.join(F.broadcast(base), "part").withColumn("start", F.col("base") + F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))
    recipes.select(*(c.split()[0] for c in RECIPES.replace(CHUNK_LIST, "x").split(", "))).write.option("compression", "zstd").parquet(f"{path}/recipes")
    parts = _rooted(_recipes(spark, path))
    parts.write.parquet(f"{path}/manifest/of=parts")
    _whole(_manifest(spark, path, "parts")).write.parquet(f"{path}/manifest/of=all")
    return path


def _objects_of(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(OBJECTS).parquet(f"{path}/objects")


def _recipes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RECIPES).parquet(f"{path}/recipes")


def _manifest(spark: SparkSession, path: str, of: str) -> DataFrame:
    return spark.read.schema(PARTS).parquet(f"{path}/manifest/of={of}")


def _chunks(spark: SparkSession, path: str) -> DataFrame:
    return _objects_of(spark, path).where("kind = 'chunk'").select(*_CHUNK_COLUMNS)


def verified_parts(spark: SparkSession, path: str) -> DataFrame:
    """(part, ok): whether each recipe part, and all of them, have the roots that the manifest states, made again from the
    recipes' chunk lists; a part that is missing, or that the manifest does not know, is not ok. Part -1 stands for all."""
    again = _rooted(_recipes(spark, path))
    names = [c.split()[0] for c in PARTS.split(", ")]
    other = [F.col(c).alias(f"s_{c}") for c in names]

    def held(got: DataFrame, said: DataFrame) -> DataFrame:
        both = got.join(said.select(*other), F.col("part") == F.col("s_part"), "full")
        same = F.col("ok") & (F.col("root") == F.col("s_root")) & (F.col("docs") == F.col("s_docs")) & (F.col("tokens") == F.col("s_tokens"))
        return both.select(F.coalesce("part", "s_part").alias("part"), F.coalesce(same, F.lit(False)).alias("ok"))

    return held(again, _manifest(spark, path, "parts")).unionByName(held(_whole(again), _manifest(spark, path, "all")))


def read_documents(spark: SparkSession, path: str, doc_ids: DataFrame | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids array<int>) rebuilt from recipes and chunks; doc_ids: those wanted."""
    recipes = _recipes(spark, path)
    if doc_ids is not None:
        recipes = recipes.join(doc_ids.select("doc_id").distinct(), "doc_id", "left_semi")
    parts = recipes.select("doc_id", "start", "n_tokens", F.posexplode("chunks").alias("seq", "chunk")).withColumn("hash", F.col("chunk.hash"))
    both = parts.join(_chunks(spark, path), "hash")
    docs = both.groupBy("start", "n_tokens").agg(F.first("doc_id").alias("doc_id"), F.sort_array(F.collect_list(F.struct("seq", "n", "ids"))).alias("parts"))

    def rebuild(batches):
        import pyarrow as pa

        for batch in batches:
            made = []
            for ps in batch.column("parts"):
                ps = ps.as_py()
                made.append(np.concatenate([np.frombuffer(p["ids"], f"<u{len(p['ids']) // p['n']}") for p in ps]).astype(np.int32))
            ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in made])]).astype(np.int32)), pa.array(np.concatenate(made) if made else np.zeros(0, np.int32)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "start", "n_tokens")), ids], ["doc_id", "start", "n_tokens", "ids"])

    return docs.select("doc_id", "start", "n_tokens", "parts").mapInArrow(rebuild, "doc_id long, start long, n_tokens long, ids array<int>")


_REFLECTED = 0xEDB88320


@functools.cache
def _zero_tables() -> list[np.ndarray]:
    """For b = 0..40: four tables of 256 that carry a CRC over 2^b zero bytes."""
    byte = np.zeros(256, np.uint32)
    for i in range(256):
        c = i
        for _ in range(8):
            c = c >> 1 ^ (_REFLECTED if c & 1 else 0)
        byte[i] = c
    columns = np.array([(x >> 8) ^ int(byte[x & 255]) for x in (1 << i for i in range(32))], np.uint32)
    out = []
    for _ in range(41):
        tables = np.zeros((4, 256), np.uint32)
        for t in range(4):
            for i in range(8):
                tables[t][(np.arange(256) >> i & 1).astype(bool)] ^= columns[8 * t + i]
        out.append(tables)
        columns = _carry(tables, columns)
    return out


def _carry(tables: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return tables[0][crc & 255] ^ tables[1][crc >> 8 & 255] ^ tables[2][crc >> 16 & 255] ^ tables[3][crc >> 24]


def shift_crc(crc: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    """crc32 of A's part in crc32(A + B) where B has so many bytes: crc32(A + B) = shift_crc(crc32(A), len(B)) ^ crc32(B)."""
    crc = crc.astype(np.uint32)
    for b, tables in enumerate(_zero_tables()):
        on = (zeros >> b & 1).astype(bool)
        if on.any():
            crc[on] = _carry(tables, crc[on])
    return crc


def stream_checks(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, verified) of each recipe from the stored files.

    Every chunk is read and its hash verified where it lies; what moves is its CRC. A document's CRC over
    32-bit ids is joined from its chunks' by the rule for concatenations, so a long document never gathers in one task. The
    few chunks (fewer than 1,000, see `hot`) that a thousandth of all places or more hold are sent to all tasks, the others are
    joined by hash. verified: all chunks of the document are what their hashes say, and its recipe part and the
    whole store have the Merkle roots of the manifest.
    """

    def read(batches):
        import pyarrow as pa

        for batch in batches:
            raw = [x.as_buffer().to_pybytes() for x in batch.column("ids")]
            n = batch.column("n").to_pylist()
            crc = [zlib.crc32(x if len(x) == 4 * k else np.frombuffer(x, "<u2").astype("<u4").tobytes()) for x, k in zip(raw, n)]
            ok = [hashlib.sha256(x).digest() == h for x, h in zip(raw, batch.column("hash").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("hash"), pa.array(crc, pa.int64()), pa.array(ok)], ["hash", "crc", "ok"])

    checked = lambda chunks: chunks.mapInArrow(read, "hash binary, crc long, ok boolean")
    chunks, recipes = _chunks(spark, path), _recipes(spark, path)
    size = F.transform("chunks", lambda c: c["n"])
    # ids after each chunk of its document: all that the chunks up to it leave over
    upto = F.aggregate(size, F.struct(F.expr("cast(array() as array<bigint>)").alias("l"), F.lit(0).cast("long").alias("t")), lambda s, n: F.struct(F.concat(s["l"], F.array(s["t"] + n)).alias("l"), (s["t"] + n).alias("t")))["l"]
    few = F.size("chunks") <= 64  # longer lists by a window, as the sums above copy the list
    short = recipes.where(few).select("start", "n_tokens", F.explode(F.arrays_zip(F.col("chunks.hash").alias("hash"), upto.alias("upto"))).alias("c"))
    short = short.select("start", F.col("c.hash").alias("hash"), (4 * (F.col("n_tokens") - F.col("c.upto"))).alias("zeros"))
    each = recipes.where(~few).select("start", "n_tokens", F.posexplode("chunks").alias("seq", "c"))
    before = F.sum("c.n").over(W.partitionBy("start").orderBy("seq"))
    long = each.select("start", F.col("c.hash").alias("hash"), (4 * (F.col("n_tokens") - before)).alias("zeros"))
    places = short.unionByName(long)

    def carry(batches):
        import pyarrow as pa

        for batch in batches:
            moved = shift_crc(np.asarray(batch.column("crc")), np.asarray(batch.column("zeros")))
            yield pa.RecordBatch.from_arrays([batch.column("start"), batch.column("ok"), pa.array(moved.astype(np.int64))], ["start", "ok", "crc"])

    uses = recipes.select(F.explode("chunks.hash").alias("hash")).groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT)
    total = recipes.agg(F.sum(F.size("chunks"))).first()[0] or 0
    hot = uses.where(F.col("n") > total // 1000).select("hash").collect()  # fewer than 1,000
    found = lambda places, chunks: places.join(chunks, "hash", "left").select("start", "zeros", F.coalesce("crc", F.lit(0)).alias("crc"), F.coalesce("ok", F.lit(False)).alias("ok"))
    if hot:
        is_hot = F.col("hash").isin([bytes(r["hash"]) for r in hot])
        some = found(places.where(is_hot), F.broadcast(checked(chunks.where(is_hot))))
        both = found(places.where(~is_hot), checked(chunks.where(~is_hot))).unionByName(some)
    else:
        both = found(places, checked(chunks))
    moved = both.mapInArrow(carry, "start long, ok boolean, crc long")
    sums = moved.groupBy("start").agg(F.bit_xor("crc").alias("ids_crc32"), F.bool_and("ok").alias("chunks_ok"))
    held = verified_parts(spark, path)
    every = held.where("part = -1").select("ok").scalar()
    out = recipes.drop("chunks", "root").join(sums, "start").join(F.broadcast(held.where("part >= 0")), "part", "left")
    verified = F.col("chunks_ok") & F.coalesce("ok", F.lit(False)) & F.coalesce(every, F.lit(False))
    return out.select("doc_id", "start", "n_tokens", "ids_crc32", verified.alias("verified"))


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded, stored and read back: where each one's ids start, how many, their CRC, and whether all verifies."""
    path = write_store(documents(spark, sf_dir).select("doc_id", "text"), fresh_path(spark, "token-store"))
    return stream_checks(spark, path)
