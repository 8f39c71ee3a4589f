"""SimHash near-duplicates: pigeonhole blocks over 64-bit fingerprints, verified, and their components.

Fingerprints that differ in at most d of 64 bits agree on at least m - d of m blocks. Each distinct
fingerprint is keyed by every choice of m - d blocks; within a key, distances are verified. m grows with the
number of distinct fingerprints (d + 2, d + 3 or d + 4 blocks; for d = 4 keys of 21 to 32 bits), which changes the work, not the
result. Equal fingerprints are one row from the start; a key's rows yield a spanning forest of their verified
links, not all pairs; keys of more than HOT rows go on in blocks, a task for each pair of blocks. Components
come from contracting the links in rounds, each written to the shared folder.

Defined results: a null text is empty; a text without words has fingerprint zero, linked like any other;
repeated rows are alike; a null doc_id never names a component unless all its members have none; an empty table gives no
rows; a text is read whole, however long; other columns pass untouched through keep_one, whatever their names, and are ignored elsewhere.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from ._common import Sealed, cut, documents, pieces_of, row_hash, text_or_empty

DISTANCE = 4
SHINGLE = 4
SEED = 42
STAGE_SHINGLE = 5  # words, and
STAGE_DISTANCE = 5  # bits, of a near copy where no contract says otherwise
HOT = 4096
SMALL = 16  # rows of a key of which all links are named
_STEP = 1 << 16  # shingles counted at a time


def fingerprint(text: bytes, words: int = SHINGLE) -> int:
    """A bit is 1 if it is 1 in over half the XXH64 of the word shingles, repeats included."""
    from xxhash import xxh64_intdigest

    w = text.lower().split()
    if not w:
        return 0
    whole = b" ".join(w)
    n = max(1, len(w) - words + 1)
    gaps = np.flatnonzero(np.frombuffer(whole, np.uint8) == 32)
    starts = [0, *(gaps + 1).tolist()][:n]
    ends = [*gaps.tolist(), len(whole)][-n:]
    h = np.fromiter((xxh64_intdigest(whole[a:b], SEED) for a, b in zip(starts, ends)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for a in range(0, n, _STEP):
        ones += np.unpackbits(h[a : a + _STEP].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = SHINGLE) -> DataFrame:
    """(key, fp): fp as a signed long."""
    schema = StructType().add("key", df.schema[key].dataType).add("fp", "long")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part in pieces_of(batch):
                fp = [fingerprint(x.as_buffer().to_pybytes(), words) for x in text_or_empty(part).cast(pa.large_binary())]
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(np.array(fp, np.uint64).view(np.int64))], ["key", "fp"])

    return df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, schema).withColumnRenamed("key", key)


def block_count(n: int, distance: int = DISTANCE) -> int:
    """As few as give keys of so many bits that about 32 of n fingerprints or fewer share one; distance + 4 at most."""
    return next((m for m in (distance + 2, distance + 3) if n <= 32 << 64 * (m - distance) // m), distance + 4)


def keyed(fps: DataFrame, m: int, distance: int = DISTANCE) -> DataFrame:
    """(key, fp): a row for each choice of m - distance of m blocks."""
    bounds = [64 * i // m for i in range(m + 1)]
    blocks = [(bounds[i], bounds[i + 1] - bounds[i]) for i in range(m)]
    keys = []
    for number, chosen in enumerate(combinations(blocks, m - distance)):
        key, at = F.lit(number << 40).cast("long"), 0
        for start, width in chosen:
            key = key.bitwiseOR(F.shiftleft(F.shiftright("fp", start).bitwiseAND((1 << width) - 1), at))
            at += width
        keys.append(key)
    return fps.select(F.explode(F.array(*keys)).alias("key"), "fp")


def forest(fps: np.ndarray, distance: int = DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest of the fingerprints within distance of one another."""
    left, a, b = np.arange(len(fps)), [], []
    while len(left):
        heap, left = [left[0]], left[1:]
        while heap and len(left):
            at = heap.pop()
            near = np.bitwise_count(fps[left] ^ fps[at]) <= distance
            found = left[near]
            a += [at] * len(found)
            b += found.tolist()
            heap += found.tolist()
            left = left[~near]
    return fps[np.array(a, np.int64)], fps[np.array(b, np.int64)]


LINK = "a long, b long, block long"  # block null: a link. else: row b of hot key a, in that block


def _links_of(key: np.ndarray, fp: np.ndarray, distance: int):
    n = len(key)
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    sizes = np.diff(np.concatenate([first, [n]]))
    group = np.repeat(np.arange(len(first)), sizes)
    small = sizes[group] <= SMALL
    for d in range(1, SMALL):
        i = np.flatnonzero(small & (np.arange(n) - first[group] >= d))
        if not len(i):
            break
        i = i[np.bitwise_count(fp[i] ^ fp[i - d]) <= distance]
        yield fp[i - d], fp[i]
    for g in np.flatnonzero(sizes > SMALL):
        yield forest(fp[first[g] : first[g] + sizes[g]], distance)


def links(fps: DataFrame, m: int | None = None, distance: int = DISTANCE) -> DataFrame:
    """(a, b): links whose components are those of all pairs of fps (fp, distinct) within distance."""

    def out(a, b, block=None):
        import pyarrow as pa

        cols = [pa.array(np.ascontiguousarray(x).view(np.int64)) for x in (a, b)]
        return pa.RecordBatch.from_arrays([*cols, pa.array(np.full(len(a), block), pa.int64()) if block is not None else pa.nulls(len(a), pa.int64())], ["a", "b", "block"])

    def run(batches):
        key, fp, block = np.zeros(0, np.int64), np.zeros(0, np.uint64), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.concatenate([key, np.asarray(batch.column("key"))])
            fp = np.concatenate([fp, np.asarray(batch.column("fp")).view(np.uint64)])
            at = int(np.searchsorted(key, key[-1]))
            begin = 0
            if block and at:
                begin = int(np.searchsorted(key, key[0], side="right"))
                yield out(key[:begin], fp[:begin], block)
                block = 0
            if at > begin:
                for a, b in _links_of(key[begin:at], fp[begin:at], distance):
                    if len(a):
                        yield out(a, b)
            key, fp = key[at:], fp[at:]
            while len(key) > HOT:
                yield out(key[:HOT], fp[:HOT], block)
                key, fp, block = key[HOT:], fp[HOT:], block + 1
        if block:
            yield out(key, fp, block)
        elif len(key):
            for a, b in _links_of(key, fp, distance):
                if len(a):
                    yield out(a, b)

    def pair(group):
        import pyarrow as pa

        a, b = forest(np.unique(np.asarray(group.column("b").combine_chunks()).view(np.uint64)), distance)
        return pa.Table.from_batches([out(a, b).select(["a", "b"])])

    m = m or block_count(fps.count(), distance)
    rows = keyed(fps, m, distance).repartition("key").sortWithinPartitions("key", "fp")
    found = cut(rows.mapInArrow(run, LINK))
    hot = found.where("block is not null")
    blocks = hot.groupBy("a").agg(F.max("block").alias("last"))
    turns = F.expr("case when block = other then array(block) else array(least(block, other), greatest(block, other)) end")
    spread = hot.join(blocks, "a").withColumn("other", F.explode(F.expr("sequence(0L, last)"))).withColumn("t", turns)
    more = spread.select("a", "b", F.col("t")[0].alias("i"), F.element_at("t", -1).alias("j")).groupBy("a", "i", "j").applyInArrow(pair, "a long, b long")
    return found.where("block is null").select("a", "b").unionByName(more).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, root) of all ids in edges (a, b): equal roots where connected.

    Each round every node joins the neighbour (or itself) with the least hash of the round, and links between
    joined nodes are dropped; a constant share of the nodes goes each round, whatever the shape."""
    e, maps = cut(edges.where("a <> b")), []
    while not e.isEmpty():
        h = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(len(maps))).alias("h"), F.col(c).alias("to"))  # noqa: B023, E731
        both = e.select("a", h("b").alias("n")).unionByName(e.select(F.col("b").alias("a"), h("a").alias("n")))
        step = cut(both.groupBy("a").agg(F.min("n").alias("n")).select(F.col("a").alias("id"), F.least(F.col("n"), h("a"))["to"].alias("root")))
        maps.append(step)
        x, y = step.toDF("a", "x"), step.toDF("b", "y")
        e = cut(e.join(x, "a").join(y, "b").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    if not maps:
        return edges.select(F.col("a").alias("id"), F.col("a").alias("root")).limit(0)
    out = maps[0]
    for later in maps[1:]:
        out = out.join(later.toDF("root", "next"), "root", "left").select("id", F.coalesce("next", "root").alias("root"))
    return out


def near_duplicates(docs: DataFrame, key: str = "doc_id", words: int = SHINGLE, distance: int = DISTANCE, text: str = "text") -> DataFrame:
    """(key, fp, component_id) of each row of docs (key, text): fingerprints of shingles of so many words, linked at distance or fewer bits."""
    own = cut(fingerprints(docs, key, text, words))
    distinct = cut(own.groupBy("fp").agg(F.min(key).alias("least")))
    roots = components(links(distinct.select("fp"), distance=distance)).toDF("fp", "root")
    with_root = cut(distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")))
    least = with_root.groupBy("root").agg(F.min("least").alias("component_id"))
    of = with_root.join(least, "root").select("fp", "component_id")
    return own.join(of, "fp").select(key, "fp", "component_id")


def keep_one(docs: DataFrame, words: int = STAGE_SHINGLE, distance: int = STAGE_DISTANCE) -> DataFrame:
    """docs with one document of each component: the first by doc_id (null first), then by a hash of the text; of rows with equal
    id and text, whatever their other columns, the first by a hash of the whole row."""
    seal = Sealed(docs)
    key = F.struct(F.col(seal["doc_id"]).alias("i"), F.xxhash64(seal["text"]).alias("t"), row_hash(seal.df).alias("r"))
    keyed = seal.df.withColumn("k", key)
    n = near_duplicates(keyed.select("k", F.col(seal["text"]).alias("text")), "k", words, distance)
    kept = n.where(F.col("k") == F.col("component_id")).select("k").distinct()
    same = F.struct(*(F.coalesce(F.col(f"k.{c}").cast("string"), F.lit("")) for c in "itr"))
    once = keyed.withColumn("same", same).join(kept.select(same.alias("same")), "same", "left_semi")
    return seal.opened(once.dropDuplicates(["same"]))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint in hex and its component's least doc_id."""
    n = near_duplicates(documents(spark, sf_dir).select("doc_id", "text"))
    return n.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
