"""Line deduplication by an exact set-similarity join.

A line is the set of its words. Lines match at Jaccard 0.8 or more; a line goes if a line before it (by
doc_id, then line number) matches it. Steps, over all lines of all documents:

1. `word_table`: how often words occur, counted in 2^25 buckets and kept as two tables of fixed size (which
   buckets count 2 or more, 4 MB; a class of rarity for every 8 buckets, 4 MB), so that what is broadcast
   never grows. Any function of the word orders prefixes correctly; this one puts rare words first.
2. Each line sorts its words by rarity and sends its prefix (n - ceil(0.8 n) + 1 words), each as a row
   keyed by the word, and one row keyed by the whole set. A word whose bucket counts 1 stands in no other
   line and sends no row. Rows are dealt to parts by key; a task packs many rows of a part into one compressed value, and each
   part is unpacked and sorted by one task. Rows of keys that have more than HOT rows are taken out there, shuffled by key and sorted.
3. Within a key, rows of equal sets keep the first (those of one slice are told apart before, so a line that all documents have
   sends a row a slice). Rows that share a prefix word are compared by length,
   position and a bitmap of word parities (a bound on the symmetric difference). Each line names the
   earliest lines that pass. Keys of more than HOT rows are passed on in blocks, and each pair of blocks
   whose lengths can match is compared by a task of its own.
4. The words of the named lines are fetched and the Jaccard index is verified. A line that had more
   candidates under a key than it named, and of which none matched, asks again in a further round over only
   those keys, for which the lines under them are copied out once; rows carry a bitmap as long as their line needs: what passes it nearly always
   matches. It names more lines in each round and all in the last, so the result is exact and the number
   of rows follows the open lines and not the square of a group.

Words are compared by a 48-bit key (8 bits of rarity, 39 of hash, 1 for several lines), sets by a 63-bit sum of mixed keys with the
number of words and a bitmap of 64 bits or more. Two words of a pair of lines share a key by chance once in some 10^7 pairs of 100 words.
Defined results: null texts have one empty line; lines without words never match and always stay; of
repeated rows (same doc_id, an integer, and text) all stay or go alike; a null doc_id comes before all others; an empty table gives
no rows; a text is read whole, however long; columns besides doc_id and text pass untouched, whatever their names.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from ._common import Sealed, column_bytes, cut, documents, mix64, pieces_of, row_key, span_hashes, stored, text_or_empty

BUCKETS = 1 << 25
COARSE = 3  # bits: so many buckets share a class
SLICES = 64
HELD = 1 << 20  # buckets that a task counts at a time
HOT = 8192  # rows of a key that one task compares
SMALL = 48  # rows of a key that are compared with those of many other keys at once
PAIRS = 1 << 17  # pairs of rows of larger keys that are compared, or passed on, at once
NAMED = 2  # candidates that a line names within a key
LATER = (4, 64, None)  # candidates that an open line names in the rounds after the first
PACK = 1 << 18  # rows that a task packs at a time
UNPACKED = 1 << 20  # rows of a part that a task holds before it looks for hot keys
CHUNK = 1 << 16  # rows of several keys that are compared at once
NULL_ID = -(1 << 63)
_LOW48 = np.uint64((1 << 48) - 1)
LONG = 64  # bytes: hashes of longer words are read off one running sum


def needed(n):
    """ceil(0.8 n): words that a line of n shares with any match at least."""
    return (4 * n + 4) // 5


def _spans(texts) -> tuple[np.ndarray, ...]:
    """Of an Arrow string array: its bytes, each row with a line break after it, offsets of rows, starts and ends of words."""
    import pyarrow as pa
    import pyarrow.compute as pc

    data, offsets = column_bytes(pc.binary_join_element_wise(texts, *(pa.scalar(x, pa.large_string()) for x in ("", "\n"))))
    word = (data - np.uint8(9) > 4) & (data != 32)
    edge = np.flatnonzero(word[1:] != word[:-1]) + 1  # the last byte is a line break
    if len(word) and word[0]:
        edge = np.concatenate([[0], edge])
    return data, offsets, edge[::2], edge[1::2]


def _words(texts) -> tuple[np.ndarray, ...]:
    """Of an Arrow string array: hashes of words and the line of each; the row and the number in it of each line."""
    data, offsets, starts, ends = _spans(texts)
    breaks = np.flatnonzero(data == 10)
    line = np.searchsorted(breaks, starts)
    row = np.searchsorted(offsets[1:], breaks, side="right")
    first = np.searchsorted(breaks, offsets[:-1])
    return _word_hashes(data, starts, ends), line, row, np.arange(len(breaks)) - first[row]


def _word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[starts:ends] for many spans, none empty; equal spans have equal hashes wherever they lie."""
    long = np.flatnonzero(ends - starts > LONG)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))  # the 8 bytes from each place on
    left = ends - starts
    h = left.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    at, which = starts, slice(None)
    for k in range(0, LONG, 8):
        x = eight[at]
        x &= np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.maximum(8 - left, 0) * 8).astype(np.uint64)
        h[which] = mix64(h[which] ^ x)
        more = np.flatnonzero(left > 8)
        if not len(more):
            break
        which = more if k == 0 else which[more]
        at, left = at[more] + 8, left[more] - 8
    if len(long):  # these alone are summed
        sizes = ends[long] - starts[long]
        end = np.cumsum(sizes)
        units = data[np.arange(end[-1]) + np.repeat(starts[long] - end + sizes, sizes)]
        h[long] = span_hashes(units, end - sizes, end)
    return h


def _reduce_counts(rows: DataFrame, size: int, finish, tasks: int = SLICES) -> list[bytes]:
    """Sums (slice, packed) rows of bucket << 38 | count; what finish makes of each slice's counts, in order of slice.

    finish gives a fixed number of bytes, so what the driver gets does not grow."""
    per = size // SLICES

    def run(batches):
        import pyarrow as pa

        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, x in zip(batch.column("slice").to_pylist(), batch.column("packed")):
                got = np.frombuffer(x.as_buffer(), np.uint64)
                into = total.setdefault(k, np.zeros(per, np.int64))
                into[(got >> np.uint64(38)).astype(np.int64) - k * per] += (got & np.uint64((1 << 38) - 1)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([finish(x) for x in total.values()], pa.binary())], ["slice", "done"])

    got = {r["slice"]: bytes(r["done"]) for r in rows.repartition(tasks, "slice").mapInArrow(run, "slice int, done binary").collect()}
    blank = finish(np.zeros(per, np.int64))
    return [got.get(k, blank) for k in range(SLICES)]


def _packed_slices(at: np.ndarray, counts: np.ndarray, size: int):
    """at: buckets of `size`, ascending, and the count of each."""
    import pyarrow as pa

    per = size // SLICES
    packed = at.astype(np.uint64) << np.uint64(38) | np.minimum(counts.astype(np.int64), (1 << 38) - 1).astype(np.uint64)
    cuts = np.searchsorted(at, np.arange(SLICES + 1) * per)
    have = [k for k in range(SLICES) if cuts[k + 1] > cuts[k]]
    return pa.RecordBatch.from_arrays(
        [pa.array(have, pa.int32()), pa.array([packed[cuts[k] : cuts[k + 1]].tobytes() for k in have], pa.binary())], ["slice", "packed"]
    )


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of all parts, ascending, and their total counts."""
    at, times = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(at, kind="stable")
    at, times = at[order], times[order]
    begin = np.flatnonzero(np.concatenate([np.ones(min(1, len(at)), bool), at[1:] != at[:-1]]))
    return at[begin], np.add.reduceat(times, begin) if len(begin) else times


def rarity(counts: np.ndarray) -> np.ndarray:
    return np.minimum(255, np.ceil(6 * np.log2(np.maximum(counts, 1)))).astype(np.uint8)


def word_table(docs: DataFrame, text: str = "text") -> tuple[np.ndarray, np.ndarray, int]:
    """Over all texts: classes of rarity by coarse bucket, a bit for each bucket that counts 2 or more, and the number of words."""

    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            for part in pieces_of(batch):
                data, _, starts, ends = _spans(text_or_empty(part))
                at, times = np.unique((_word_hashes(data, starts, ends) & np.uint64(BUCKETS - 1)).astype(np.int32), return_counts=True)
                held.append((at, times))
                if sum(len(x) for x, _ in held) > HELD:
                    held = [_summed(held)]
                    if len(held[0][0]) > HELD // 2:  # sent on, and summed up later
                        yield _packed_slices(*held.pop(), BUCKETS)
        if held:
            yield _packed_slices(*_summed(held), BUCKETS)

    def finish(counts: np.ndarray) -> bytes:
        return rarity(counts.reshape(-1, 1 << COARSE).max(axis=1)).tobytes() + np.packbits(counts > 1).tobytes() + counts.sum().tobytes()

    made = _reduce_counts(docs.select(F.col(text).alias("text")).mapInArrow(run, "slice int, packed binary"), BUCKETS, finish)
    split = (BUCKETS // SLICES) >> COARSE
    parts = [np.frombuffer(x, np.uint8) for x in made]
    total = sum(int.from_bytes(x[-8:], "little") for x in made)
    return np.concatenate([x[:split] for x in parts]), np.concatenate([x[split:-8] for x in parts]), total


def _sets(texts, table: tuple[np.ndarray, np.ndarray, int]):
    """Yields, for up to 65,536 lines at a time that have words: row, line number, words in order of rarity (all lines'), where each line's begin, how many, and the set's hash.

    A word's lowest bit says whether it may stand in several lines."""
    classes, common, _ = table
    h, line, row, number = _words(texts)
    at = (h & np.uint64(BUCKETS - 1)).astype(np.int64)
    several = common[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1
    word = classes[at >> COARSE].astype(np.uint64) << np.uint64(40) | h >> np.uint64(25) << np.uint64(1) | several
    for base in range(0, len(row), 1 << 16):
        a, b = np.searchsorted(line, [base, base + (1 << 16)])
        if a == b:
            continue
        s = np.sort((line[a:b] - base).astype(np.uint64) << np.uint64(48) | word[a:b])
        s = s[np.concatenate([[True], s[1:] != s[:-1]])]
        of, w = (s >> np.uint64(48)).astype(np.int64), s & _LOW48
        begin = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
        n = np.diff(np.concatenate([begin, [len(of)]]))
        sid = mix64(np.add.reduceat(mix64(w + np.uint64(1)), begin) ^ n.astype(np.uint64)) >> np.uint64(1)
        at = of[begin] + base
        yield row[at], number[at], w, begin, n, sid


def _bitmaps(w: np.ndarray, begin: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parities of words by 64 places; for lines of more than 64 words also the second half of those by 128, whose halves xor to the first."""
    h = mix64(w)
    one = np.uint64(1) << (h & np.uint64(63))
    half = np.bitwise_xor.reduceat(np.where(h & np.uint64(64), one, np.uint64(0)), begin)
    return np.bitwise_xor.reduceat(one, begin), np.where(n > 64, half, np.uint64(0))


def _wide(w: np.ndarray) -> bytes:
    """Parities of a line's words in 512 to 32,768 bits, 8 or more a word; the first half xor the second is the bitmap of half the length."""
    size = min(32768, max(512, 1 << (8 * len(w) - 1).bit_length()))
    at = (mix64(w ^ np.uint64(0x5851F42D4C957F2D)) & np.uint64(size - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=size) & 1).astype(bool), bitorder="little").tobytes()


GONE = -1
#: shape: words in the line << 32 | place of the key's word in the prefix + 1, 0 for a whole set; GONE: a line that goes. at: _th << 32 | line number.
ROWS = "key long, shape long, sid long, bits long, half long, doc long, at long"


def _number(key, doc, at):
    """A number of a line's row under a key, for filters."""
    return mix64(mix64(key.view(np.uint64)) ^ doc.view(np.uint64)) ^ at.view(np.uint64)


def signatures(docs: DataFrame, table, wanted=None) -> DataFrame:
    """Rows to be matched: one for each word of each line's prefix, and one for each whole set; packed, see _packed.

    table: broadcast of word_table(). docs has doc_id, text and _th. wanted: broadcast of filters of keys and of
    (key, doc, at); docs are LINES then, only words' rows that the first lets through are made, as ROWS with the
    columns of ASKED, and those that the second lets through ask.
    """
    parts = parts_of(table.value[2])

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        held, count_held = [], 0
        for batch in batches:
            for part in pieces_of(batch):
                docs_of = np.asarray(pc.fill_null(part.column("doc_id").cast(pa.int64()), NULL_ID))
                places = np.asarray(part.column("_th")).astype(np.int64) << 32 if wanted is None else np.asarray(part.column("at"))
                for row, number, w, begin, n, sid in _sets(text_or_empty(part), table.value):
                    doc, place = docs_of[row], places[row] | (number if wanted is None else 0)
                    order = np.lexsort((place, doc, sid))
                    leads = np.concatenate([[True], sid[order][1:] != sid[order][:-1]])
                    once, exact = order[leads], np.arange(len(sid))
                    near = np.sort(once[n[once] >= 4])  # of three words or fewer, only equal sets match
                    count = n[near] - needed(n[near]) + 1
                    pos = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                    of = np.repeat(near, count)
                    word = w[begin[of] + pos]
                    use = (word & np.uint64(1)).astype(bool)
                    if wanted is not None:
                        use &= _let_through(wanted.value[0], word)
                        exact = exact[:0]
                    seen = np.flatnonzero(use)
                    pos, word, of = pos[seen], word[seen], of[seen]
                    k = np.concatenate([exact, of])
                    key = np.concatenate([-1 - sid.astype(np.int64)[exact], word.astype(np.int64)])
                    shape = n[k].astype(np.int64) << 32 | np.concatenate([np.zeros(len(exact), np.int64), pos + 1])
                    if wanted is None:  # of equal lines of a slice, all but the first go wherever they are dealt, and so to no one task
                        again = order[~leads]
                        key[again] = -1 - (mix64(_number(key[again], doc[again], place[again])) >> np.uint64(1)).astype(np.int64)
                        shape[again] = GONE
                    bits, half = (x.view(np.int64) for x in _bitmaps(w, begin, n))
                    cols = (key, shape, sid.astype(np.int64)[k], bits[k], half[k], doc[k], place[k])
                    if wanted is None:
                        held.append(np.stack(cols))
                        count_held += len(k)
                        if count_held >= PACK:
                            count_held = 0
                            yield _packed(held, parts)
                        continue
                    cols = [pa.array(c) for c in cols]
                    wide = {x: _wide(w[begin[x] : begin[x] + n[x]]) for x in np.unique(of).tolist()}
                    cols += [pa.array(_let_through(wanted.value[1], _number(word, doc[k], place[k]))), pa.array([wide[x] for x in of.tolist()], pa.binary())]
                    yield pa.RecordBatch.from_arrays(cols, COLUMNS + ASKED_COLUMNS)
        if held:
            yield _packed(held, parts)

    return docs.select("doc_id", "text", "_th" if wanted is None else "at").mapInArrow(run, PACKED if wanted is None else f"{ROWS}, {ASKED}")


PACKED = "part int, rows binary"
#: Bytes of rows that are compressed together, by column of ROWS: first and last of its 8, lowest first. Hashes are kept as they are.
_FRAMES = [(0, 0, 4, True), (0, 4, 8, True), (1, 0, 8, True), (2, 0, 8, False), (3, 0, 8, True), (4, 0, 8, True), (5, 0, 8, True), (6, 0, 4, True), (6, 4, 8, False)]


def parts_of(words: int) -> int:
    """Parts that the rows of a table of so many words are dealt to: some 10^6 rows in each of a large table's, up to 10^11 words."""
    return min(65535, max(64, int(words**0.5) // 80, words >> 22))


def _packed(held: list[np.ndarray], parts: int):
    """An Arrow batch of (part, rows): the held rows (ROWS, a column each line) dealt to parts by key, sorted, and those of a part as one value. Empties held.

    Keys are differences, bytes of one place lie together and are compressed. A whole set's key is told by its hash, and a
    line that goes needs no more than its place."""
    import pyarrow as pa

    rows = np.concatenate(held, axis=1)
    held.clear()
    key, shape = rows[0], rows[1]
    part = (mix64(key.view(np.uint64)) >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)
    rows[0] = np.where(key < 0, 0, key)
    rows[2:5, shape == GONE] = 0
    order = np.argsort(part << np.uint64(48) | rows[0].view(np.uint64))
    rows, part = rows[:, order].view(np.uint64), part[order]
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(part)), bool), part[1:] != part[:-1]]))
    apart = np.diff(rows[0], prepend=np.uint64(0))
    apart[first] = rows[0][first]
    rows[0] = apart
    codec, made = pa.Codec("zstd", compression_level=1), []
    for a, b in zip(first, np.append(first[1:], len(part))):
        planes = np.ascontiguousarray(rows[:, a:b]).view(np.uint8).reshape(len(rows), b - a, 8).transpose(0, 2, 1)
        frames = [planes[c, lo:hi].tobytes() for c, lo, hi, _ in _FRAMES]
        frames = [codec.compress(x, asbytes=True) if small else x for x, (*_, small) in zip(frames, _FRAMES)]
        made.append(np.array([b - a, *map(len, frames)], np.uint32).tobytes() + b"".join(frames))
    return pa.RecordBatch.from_arrays([pa.array(part[first].astype(np.int32)), pa.array(made, pa.binary())], ["part", "rows"])


def _unpacked(x) -> np.ndarray:
    """The rows of a value of _packed, a column of ROWS each line."""
    import pyarrow as pa

    codec = pa.Codec("zstd")
    n, *sizes = np.frombuffer(x, np.uint32, 1 + len(_FRAMES)).tolist()
    planes, at = np.empty((7, 8, n), np.uint8), 4 * (1 + len(_FRAMES))
    for size, (c, lo, hi, small) in zip(sizes, _FRAMES):
        frame = x[at : at + size]
        frame = codec.decompress(frame, (hi - lo) * n) if small else frame
        planes[c, lo:hi] = np.frombuffer(frame, np.uint8).reshape(hi - lo, n)
        at += size
    rows = np.ascontiguousarray(planes.transpose(0, 2, 1)).view(np.int64).reshape(7, n)
    rows[0] = np.cumsum(rows[0])
    whole = rows[1] & 0xFFFFFFFF == 0
    rows[0, whole] = -1 - rows[2, whole]
    return rows


BITMAPS = ("bits", "half")
ASKED = "asks boolean, wide binary"
COLUMNS, ASKED_COLUMNS = ([c.split()[0] for c in x.split(", ")] for x in (ROWS, ASKED))
#: kind 0: the line (doc, at) goes. 1: it may match the set `other`. 2: it may have more candidates than it named. 3: a row of a hot key, with its block in `other`. 4: the line has a row under a key of kind 2.
#: other_doc, other_at: a line that is the set `other`. Columns that a kind does not use are null.
USED = {0: ("doc", "at"), 1: ("sid", "doc", "at"), 2: ("key", "doc", "at"), 3: COLUMNS, 4: ("key", "doc", "at")}
OUT = f"kind int, {ROWS}, other long, other_doc long, other_at long"


def _reach(r: dict, i=slice(None)) -> tuple[np.ndarray, np.ndarray]:
    """Of rows i: 5 n - 9 p and 4 n, of n words and place p of the key's word. By length and position two rows can match if the
    first of each is at least the second of the other: ceil(4 (n + m) / 9) words must be common, and n - p are left."""
    n = r["shape"][i] >> 32
    return 5 * n - 9 * ((r["shape"][i] & 0xFFFFFFFF) - 1), 4 * n


def _passes(r: dict, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which of the rows i after j, which pass by length and position, can match by bitmaps."""
    some = np.flatnonzero(_after(r, i, j) & (r["sid"][i] != r["sid"][j]))
    both = (r["shape"][i[some]] >> 32) + (r["shape"][j[some]] >> 32)
    some = some[np.bitwise_count(r["bits"][i[some]] ^ r["bits"][j[some]]) <= both - 2 * ((4 * both + 8) // 9)]
    return some[_passes_too(r, i[some], j[some])]


def _passes_too(r: dict, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether rows i and j, which passed before, can match by the longer bitmaps they have."""
    n, m = r["shape"][i] >> 32, r["shape"][j] >> 32
    most = n + m - 2 * ((4 * (n + m) + 8) // 9)
    if "wide" not in r:
        a, b = r["half"][i], r["half"][j]
        second = np.where((a != 0) & (b != 0), a ^ b, np.uint64(0))
        return np.bitwise_count(second).astype(np.int64) + np.bitwise_count(r["bits"][i] ^ r["bits"][j] ^ second) <= most
    ok = np.zeros(len(i), bool)
    size = np.fromiter(map(len, r["wide"]), np.int64, len(r["wide"])) >> 3
    for a, b in sorted({*zip(size[i].tolist(), size[j].tolist())}):
        some = np.flatnonzero((size[i] == a) & (size[j] == b))
        sides = []
        for rows in (i[some], j[some]):
            which, at = np.unique(rows, return_inverse=True)
            x = np.frombuffer(b"".join(r["wide"][which].tolist()), np.uint64).reshape(len(which), -1)
            while x.shape[1] > min(a, b):
                x = x[:, : x.shape[1] // 2] ^ x[:, x.shape[1] // 2 :]
            sides.append((x, at))
        (x, at), (y, to) = sides
        step = (1 << 20) // min(a, b)
        for k in range(0, len(some), step):
            differ = np.bitwise_count(x[at[k : k + step]] ^ y[to[k : k + step]]).sum(axis=1, dtype=np.int64)
            ok[some[k : k + step]] = differ <= most[some[k : k + step]]
    return ok


def _after(r: dict, i, j) -> np.ndarray:
    return (r["doc"][i] > r["doc"][j]) | (r["doc"][i] == r["doc"][j]) & (r["at"][i] > r["at"][j])


def _in_large(r: dict, xs: np.ndarray, ys: np.ndarray, named: int | None):
    """Yields (later, earlier) rows of r among xs and ys that may match, `named` of them for each x at most, and the x that had more.

    What is held at once, and what is yielded, follows PAIRS and len(ys) and not the square of a key."""
    if "wide" in r:
        xs = xs[r["asks"][xs]]
    left, right, more, held = [], [], [], 0
    join = lambda z: np.concatenate(z) if z else np.zeros(0, np.int64)
    (reach, size), (y_reach, y_size) = _reach(r, xs), _reach(r, ys)
    order, by_size = np.argsort(size, kind="stable"), np.argsort(y_size, kind="stable")
    xs, reach, size = xs[order], reach[order], size[order]
    sizes, a = y_size[by_size], 0
    while a < len(xs):
        lo = np.searchsorted(sizes, 0.8 * size[a])
        step = max(1, PAIRS // max(1, np.searchsorted(sizes, 1.25 * size[a], side="right") - lo))
        while True:  # so many rows that they and all of fitting length are PAIRS at most
            b = min(len(xs), a + step)
            hi = np.searchsorted(sizes, 1.25 * size[b - 1], side="right")
            if step == 1 or (b - a) * (hi - lo) <= PAIRS:
                break
            step = max(1, step // 2)
        near = np.sort(by_size[lo:hi])  # the earliest first
        i, j = np.nonzero((reach[a:b, None] >= y_size[near]) & (y_reach[near] >= size[a:b, None]))
        some, other = xs[a:b], ys[near]
        a = b
        ok = _passes(r, some[i], other[j])
        i, j = i[ok], j[ok]
        if named is not None and len(i):
            nth = np.arange(len(i)) - np.searchsorted(i, i)
            more.append(some[i[nth == named]])
            i, j = i[nth < named], j[nth < named]
        left.append(some[i])
        right.append(other[j])
        held += len(i)
        if held >= PAIRS:
            yield join(left), join(right), join(more)
            left, right, more, held = [], [], [], 0
    yield join(left), join(right), join(more)


def _match(r: dict, named: int | None, small_key: int = SMALL):
    """r: rows sorted by key and place, whole keys only. Yields (kind, indexes of rows, those of the others)."""
    key, n = r["key"], len(r["key"])
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    sizes = np.diff(np.concatenate([first, [n]]))
    near = key[first] >= 0
    whole = np.repeat(first[~near], sizes[~near])
    i = np.flatnonzero(np.repeat(~near, sizes))
    said = r["shape"][i] == GONE
    # equal sets agree in their hash, and to be sure in number of words and parities, another 64 bits or more
    alike = (r["shape"][i] == r["shape"][whole]) & (r["bits"][i] == r["bits"][whole]) & (r["half"][i] == r["half"][whole])
    gone = said | alike & _after(r, i, whole)
    yield 0, i[gone], i[gone]
    small = near & (sizes <= small_key) & (sizes > 1)
    rows = np.flatnonzero(np.repeat(small, sizes))
    lead = np.repeat(first[small], sizes[small])
    if "wide" in r:
        rows, lead = rows[r["asks"][rows]], lead[r["asks"][rows]]
    said = np.zeros(len(rows), np.int64)
    reach, size = _reach(r)
    for d in range(small_key):  # the d-th row of each key with those after it, so the earliest are named first
        later = rows - lead > d
        full = later & (said >= named) if named is not None else np.zeros(len(rows), bool)
        if full.any():
            yield 2, rows[full], rows[full]
        rows, lead, said = (x[later & ~full] for x in (rows, lead, said))
        if not len(rows):
            break
        j = lead + d
        ok = np.flatnonzero((reach[rows] >= size[j]) & (reach[j] >= size[rows]))
        i, j = rows[ok], j[ok]
        some = _passes(r, i, j)
        said[ok[some]] += 1
        yield 1, i[some], j[some]
    for g in np.flatnonzero(near & (sizes > small_key)):
        own = np.arange(first[g], first[g] + sizes[g])
        for i, j, rest in _in_large(r, own, own, named):
            yield 1, i, j
            yield 2, rest, rest


def _table(batch) -> dict:
    t = {c: np.asarray(batch.column(c)) for c in COLUMNS}
    t |= {c: t[c].view(np.uint64) for c in BITMAPS}
    if "wide" in batch.schema.names:
        t["asks"] = np.asarray(batch.column("asks")).astype(bool)
        t["wide"] = np.empty(len(t["key"]), object)
        t["wide"][:] = batch.column("wide").to_pylist()
    return t


def _out(kind: int, r: dict, i: np.ndarray, j: np.ndarray | None = None, block: int = 0):
    """OUT rows of rows i and their others j; kind 3 has a block and no others."""
    import pyarrow as pa

    none = pa.nulls(len(i), pa.int64())
    cols = [pa.array(np.full(len(i), kind, np.int32)), *(pa.array((r[c].view(np.int64) if c in BITMAPS else r[c])[i]) if c in USED[kind] else none for c in COLUMNS)]
    cols.append(pa.array(np.full(len(i), block)) if kind == 3 else pa.array(r["sid"][j]) if kind == 1 else none)
    cols += [pa.array(r[c][j]) if kind == 1 else none for c in ("doc", "at")]
    names = ["kind", *COLUMNS, "other", "other_doc", "other_at"]
    if "wide" not in r:
        return pa.RecordBatch.from_arrays(cols, names)
    wide = pa.array(r["wide"][i].tolist(), pa.binary()) if kind == 3 else pa.nulls(len(i), pa.binary())
    return pa.RecordBatch.from_arrays([*cols, pa.array(r["asks"][i]), wide], names + ASKED_COLUMNS)


def _out_schema(rows: DataFrame) -> str:
    return f"{OUT}, {ASKED}" if "wide" in rows.columns else OUT


def matches(rows: DataFrame, named: int | None = NAMED, hot: int = HOT, small: int = SMALL) -> DataFrame:
    """OUT rows of signatures(); a task holds `hot` rows of one key, and a batch, at most."""

    def run(batches):
        held: dict | None = None  # the rows of the last key, which may go on
        block = 0  # blocks of it that are already passed on
        for batch in batches:
            if not batch.num_rows:
                continue
            r = _table(batch)
            if held is not None:
                r = {k: np.concatenate([held[k], v]) for k, v in r.items()}
            last = r["key"][-1]
            cut_at = int(np.searchsorted(r["key"], last))
            if cut_at:
                whole = {k: v[:cut_at] for k, v in r.items()}
                if block:  # the key that was passed on in blocks ends here
                    end = int(np.searchsorted(whole["key"], whole["key"][0], side="right"))
                    yield _out(3, whole, np.arange(end), block=block)
                    whole = {k: v[end:] for k, v in whole.items()}
                    block = 0
                if len(whole["key"]):
                    for kind, i, j in _match(whole, named, small):
                        if len(i):
                            yield _out(kind, whole, i, j)
            held = {k: v[cut_at:] for k, v in r.items()}
            if held["key"][0] < 0 and len(held["key"]) > 1:  # of equal sets, only the first is needed later
                for kind, i, j in _match(held, named, small):
                    if len(i):
                        yield _out(kind, held, i, j)
                held = {k: v[:1] for k, v in held.items()}
            while held["key"][0] >= 0 and len(held["key"]) > hot:
                yield _out(3, held, np.arange(hot), block=block)
                held = {k: v[hot:] for k, v in held.items()}
                block += 1
        if held is not None and block:
            yield _out(3, held, np.arange(len(held["key"])), block=block)
        elif held is not None:
            for kind, i, j in _match(held, named, small):
                if len(i):
                    yield _out(kind, held, i, j)

    return rows.repartition("key").sortWithinPartitions("key", "doc", "at").mapInArrow(run, _out_schema(rows))


def _sorted_shared(r: dict) -> dict:
    """Rows of keys that several rows have, sorted by key and place."""
    order = np.argsort(r["key"])
    key = r["key"][order]
    same = np.zeros(len(key) + 1, bool)
    same[1:-1] = key[1:] == key[:-1]
    order = order[same[1:] | same[:-1]]
    order = order[np.lexsort((r["at"][order], r["doc"][order], r["key"][order]))]
    return {c: v[order] for c, v in r.items()}


def _match_part(r: dict, named: int | None, hot: int, small: int, hot_keys: set, ends: bool):
    """Yields OUT rows of rows that share a part, and returns those to be held. ends: these are the part's last.

    Rows of hot keys, and of those that get hot, are passed on; before the end only these and equal sets are dealt with."""
    keys, sizes = np.unique(r["key"], return_counts=True)
    hot_keys.update(keys[(keys >= 0) & (sizes > hot)].tolist())
    if hot_keys and len(keys):
        passed = np.isin(r["key"], np.fromiter(hot_keys, np.int64, len(hot_keys)))
        if passed.any():
            yield _out(3, r, np.flatnonzero(passed))
            r = {c: v[~passed] for c, v in r.items()}
    if not ends:
        whole = {c: v[r["key"] < 0] for c, v in r.items()}
        order = np.lexsort((whole["at"], whole["doc"], whole["key"]))
        whole = {c: v[order] for c, v in whole.items()}
        for kind, i, j in _match(whole, named, small) if len(order) else ():
            if len(i):
                yield _out(kind, whole, i, j)
        first = np.concatenate([np.ones(min(1, len(order)), bool), whole["key"][1:] != whole["key"][:-1]])
        return {c: np.concatenate([whole[c][first], v[r["key"] >= 0]]) for c, v in r.items()}
    r = _sorted_shared(r)
    n = len(r["key"])
    first = np.flatnonzero(np.concatenate([np.ones(min(1, n), bool), r["key"][1:] != r["key"][:-1]]))
    cuts = np.unique(np.append(first[np.searchsorted(first, np.arange(0, n, CHUNK), side="right") - 1], n))
    for a, b in zip(cuts[:-1], cuts[1:]):
        some = {c: v[a:b] for c, v in r.items()}
        held, count, again = {0: [], 1: [], 2: []}, [0, 0, 0], np.zeros(b - a, bool)
        for kind, i, j in _match(some, named, small):
            held[kind].append((i, j))
            count[kind] += len(i)
            if kind == 2:
                again[i] = True
            if count[kind] >= CHUNK:
                yield _out(kind, some, *map(np.concatenate, zip(*held[kind])))
                held[kind], count[kind] = [], 0
        for kind in held:
            if count[kind]:
                yield _out(kind, some, *map(np.concatenate, zip(*held[kind])))
        if again.any():
            yield _out(4, some, np.flatnonzero(np.isin(some["key"], some["key"][again])))
    return {}


def packed_matches(rows: DataFrame, named: int | None = NAMED, hot: int = HOT, small: int = SMALL, most: int = UNPACKED) -> DataFrame:
    """OUT rows of signatures(), packed; rows of keys of more than `hot` are kind 3, not yet in blocks: matches() takes these.

    A task holds the rows of one part, without those of keys that are hot among the first `most` and each later doubling."""

    def run(batches):
        held: list[np.ndarray] = []
        hot_keys: set[int] = set()
        last, n, limit = None, 0, most

        def table():
            x = np.concatenate(held, axis=1)
            held.clear()
            r = {c: x[k].view(np.uint64) if c in BITMAPS else x[k] for k, c in enumerate(COLUMNS)}
            gone = r["shape"] == GONE
            return {c: v[~gone] for c, v in r.items()}, {c: v[gone] for c, v in r.items()}

        for batch in batches:
            for part, x in zip(batch.column("part").to_pylist(), batch.column("rows")):
                ends = part != last and n > 0
                if ends or n >= limit:
                    r, gone = table()
                    if len(gone["key"]):
                        yield _out(0, gone, np.arange(len(gone["key"])))
                    r = yield from _match_part(r, named, hot, small, hot_keys, ends)
                    n = 0
                    if not ends:
                        held.append(np.stack([r[c].view(np.int64) for c in COLUMNS]))
                        n = held[0].shape[1]
                        limit = max(limit, 2 * n)
                if part != last:
                    hot_keys.clear()
                    held.clear()
                    last, n, limit = part, 0, most
                held.append(_unpacked(x.as_buffer()))
                n += held[-1].shape[1]
        if held:
            r, gone = table()
            if len(gone["key"]):
                yield _out(0, gone, np.arange(len(gone["key"])))
            yield from _match_part(r, named, hot, small, hot_keys, True)

    return rows.repartition("part").sortWithinPartitions("part").mapInArrow(run, OUT)


def hot_matches(hot: DataFrame, named: int | None = NAMED) -> DataFrame:
    """OUT rows of the rows that matches() passed on: each pair of blocks of a key is a group of 2 * HOT rows at most."""
    n = F.shiftright("shape", 32)
    asks = F.max("asks") if "asks" in hot.columns else F.lit(True)
    blocks = hot.groupBy("key", "other").agg(F.min(n).alias("lo"), F.max(n).alias("hi"), asks.alias("asks"))
    a, b = blocks.select("key", F.col("other").alias("i"), F.col("lo").alias("lo_i"), F.col("hi").alias("hi_i")), blocks.withColumnRenamed("other", "j")
    pairs = a.join(b, "key").where("asks and i <= j and lo_i <= 1.25 * hi and lo <= 1.25 * hi_i").select("key", "i", "j")
    place = F.explode(F.expr("case when i = j then array(i) else array(i, j) end")).alias("other")
    rows = hot.join(pairs.select("key", "i", "j", place), ["key", "other"])

    def run(group):
        import pyarrow as pa

        i, j = group.column("i")[0].as_py(), group.column("j")[0].as_py()
        r = _table(group.combine_chunks())
        other = np.asarray(group.column("other"))
        order = np.lexsort((r["at"], r["doc"]))
        r, other = {c: v[order] for c, v in r.items()}, other[order]
        xs, ys = np.flatnonzero(other == j), np.flatnonzero(other == i)
        parts = ((_out(1, r, left, right), _out(2, r, more, more)) for left, right, more in _in_large(r, xs, ys, named))
        return pa.Table.from_batches([x for part in parts for x in part])

    return rows.groupBy("key", "i", "j").applyInArrow(run, _out_schema(hot))


FILTER = 1 << 23


def _filter_of(keys: DataFrame, *columns: str, among=None) -> np.ndarray:
    """2^23 bits in which that of each value, or (key, doc, at), is set: a filter of fixed size, exact steps follow it.

    among: broadcast of filters, of which the first lets through the keys whose rows' lines count, and no others do."""

    def run(batches):
        import pyarrow as pa

        bits = np.zeros(FILTER, np.uint8)
        for batch in batches:
            if among is not None:
                batch = batch.filter(pa.array(_let_through(among.value[0], np.asarray(batch.column("key")).view(np.uint64))))
                batch = batch.set_column(0, "key", pa.array(np.zeros(batch.num_rows, np.int64)))
            values = [np.asarray(batch.column(c)).view(np.uint64) for c in columns]
            values = values[0] if len(values) == 1 else _number(*values)
            bits[(mix64(values) & np.uint64(FILTER - 1)).astype(np.int64)] = 1
        at = np.flatnonzero(bits)
        yield _packed_slices(at, bits[at], FILTER)

    made = _reduce_counts(keys.select(*columns).mapInArrow(run, "slice int, packed binary"), FILTER, lambda counts: np.packbits(counts > 0).tobytes(), 8)
    return np.frombuffer(b"".join(made), np.uint8)


def _let_through(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    at = (mix64(values) & np.uint64(FILTER - 1)).astype(np.int64)
    return (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)


def _chosen(part, wanted: np.ndarray):
    """The lines of docs' rows, or of LINES, that the filter of (0, doc, at) lets through, as an Arrow string array, their doc and at; others are not split into words."""
    import pyarrow as pa
    import pyarrow.compute as pc

    doc = np.asarray(pc.fill_null(part.column("doc_id").cast(pa.int64()), NULL_ID))
    if "at" in part.schema.names:
        at = np.asarray(part.column("at"))
        have = _let_through(wanted, _number(np.zeros(len(doc), np.int64), doc, at))
        return text_or_empty(part).filter(pa.array(have)), doc[have], at[have]
    texts = pc.binary_join_element_wise(text_or_empty(part), *(pa.scalar(x, pa.large_string()) for x in ("", "\n")))
    data, offsets = column_bytes(texts)
    breaks = np.flatnonzero(data == 10)
    row = np.searchsorted(offsets[1:], breaks, side="right")
    number = np.arange(len(breaks)) - np.searchsorted(breaks, offsets[:-1])[row]
    th = np.asarray(part.column("_th")).astype(np.int64) << 32
    doc, at = doc[row], th[row] | number
    have = _let_through(wanted, _number(np.zeros(len(row), np.int64), doc, at))
    cuts = np.concatenate([[0], breaks + 1]).astype(np.int64)
    lines = pa.Array.from_buffers(pa.large_string(), len(breaks), [None, pa.py_buffer(cuts), pa.py_buffer(np.ascontiguousarray(data))])
    return lines.filter(pa.array(have)), doc[have], at[have]


def _lines_of(part, wanted: np.ndarray):
    return _chosen(part, wanted)[0]


LINES = "doc_id long, at long, text string"


def _lines(docs: DataFrame, wanted) -> DataFrame:
    """LINES of docs that the filter `wanted` lets through."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part in pieces_of(batch):
                lines, doc, at = _chosen(part, wanted.value)
                if len(lines):
                    yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(at), lines.cast(pa.string())], ["doc_id", "at", "text"])

    return docs.select("doc_id", "text", "_th").mapInArrow(run, LINES)


def _word_sets(docs: DataFrame, table, wanted) -> DataFrame:
    """(sid, words) of the lines (doc, at) that the filter `wanted` lets through, each set once."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part in pieces_of(batch):
                lines = _lines_of(part, wanted.value)
                if not len(lines):
                    continue
                for _, _, w, begin, n, sid in _sets(lines, table.value):
                    have = np.unique(sid, return_index=True)[1]
                    words = [w[begin[k] : begin[k] + n[k]].tobytes() for k in have]
                    yield pa.RecordBatch.from_arrays([pa.array(sid[have].astype(np.int64)), pa.array(words, pa.binary())], ["sid", "words"])

    return docs.select("doc_id", "text", "at" if "at" in docs.columns else "_th").mapInArrow(run, "sid long, words binary").groupBy("sid").agg(F.first("words").alias("words"))


def _asked(rows: DataFrame, wanted) -> DataFrame:
    """signatures(wanted=wanted), from those of a round before that asked for these keys and others."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            key, doc, at = (np.asarray(batch.column(c)) for c in ("key", "doc", "at"))
            asks = pa.array(_let_through(wanted.value[1], _number(key, doc, at)))
            have = pa.array(_let_through(wanted.value[0], key.view(np.uint64)))
            yield batch.set_column(batch.schema.get_field_index("asks"), "asks", asks).filter(have)

    return rows.mapInArrow(run, f"{ROWS}, {ASKED}")


def _verified(found: DataFrame, docs: DataFrame, table) -> DataFrame:
    """Of the (sid, other) pairs of OUT rows, those with a Jaccard index of 0.8 or more. Only lines of docs, or LINES, that stand in pairs are split."""
    spark = found.sparkSession
    links = found.where("kind = 1")
    pairs = links.select("sid", "other").distinct()
    places = links.select(F.lit(0).cast("long").alias("key"), "doc", "at").union(links.select(F.lit(0).cast("long"), "other_doc", "other_at"))
    sets = stored(_word_sets(docs, table, spark.sparkContext.broadcast(_filter_of(places, "key", "doc", "at"))), "sets")
    both = pairs.join(sets, "sid").join(sets.select(F.col("sid").alias("other"), F.col("words").alias("other_words")), "other")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            keep = []
            for a, b in zip(batch.column("words"), batch.column("other_words")):
                x, y = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
                z = np.sort(np.concatenate([x, y]))
                same = int((z[1:] == z[:-1]).sum())
                keep.append(5 * same >= 4 * (len(x) + len(y) - same))
            yield pa.RecordBatch.from_arrays([batch.column("sid").filter(pa.array(keep, pa.bool_())), batch.column("other").filter(pa.array(keep, pa.bool_()))], ["sid", "other"])

    return both.select("sid", "words", "other", "other_words").mapInArrow(run, "sid long, other long")


def removed_lines(docs: DataFrame, named: int = NAMED, hot: int = HOT, small: int = SMALL, later: tuple = LATER) -> DataFrame:
    """(doc, at): the lines of docs (doc_id, text, _th) that go."""
    sc = docs.sparkSession.sparkContext
    table = sc.broadcast(word_table(docs))
    rows = signatures(docs, table)

    def found_by(rows: DataFrame, named: int | None) -> DataFrame:
        if "part" in rows.columns:
            out = stored(packed_matches(rows, named, hot, small), "matches")
            passed = out.where("kind = 3")
            if passed.isEmpty():
                return out
            found = found_by(passed.select(COLUMNS), named)
            again = passed.join(found.where("kind = 2").select("key").distinct(), "key", "left_semi").withColumn("kind", F.lit(4))
            return out.where("kind != 3").unionByName(found).unionByName(again.select(out.columns))
        out = stored(matches(rows, named, hot, small), "matches")
        passed = out.where("kind = 3")
        if passed.isEmpty():
            return out
        return out.where("kind < 3").unionByName(stored(hot_matches(passed, named), "hot-matches"))

    place = ["doc", "at"]
    found = found_by(rows, named)
    under = found.where("kind = 4").select("key", *place)
    gone = lambda found, docs: found.where("kind = 1").join(stored(_verified(found, docs, table), "pairs"), ["sid", "other"]).select(*place)
    last = out = stored(found.where("kind = 0").select(*place).unionByName(gone(found, docs)), "gone")
    rows = None
    for named in later:  # lines that had more candidates under a key than they named, and no match yet
        more = cut(found.where("kind = 2").select("key", *place).distinct().join(last.distinct(), place, "left_anti"))
        if more.isEmpty():
            break
        asked = sc.broadcast((_filter_of(more, "key"), _filter_of(more, "key", *place)))
        if rows is None:  # keys of a round are among those of the round before, so texts are read, and lines split, for the first of them only
            lines = stored(_lines(docs, sc.broadcast(_filter_of(under, "key", *place, among=asked))), "lines")
            rows = stored(signatures(lines, table, asked), "asked")
        else:
            rows = _asked(rows, asked)
        found = found_by(rows, named)
        last = stored(gone(found, lines), "gone")
        out = out.unionByName(last)
    return out.distinct()


def line_decisions(docs: DataFrame, **limits) -> DataFrame:
    """(doc, th, removed): per document of docs (doc_id, text) with removals, its removed line numbers (from 0, ascending)."""
    gone = removed_lines(row_key(docs.select("doc_id", "text")), **limits)
    gone = gone.select("doc", F.shiftright("at", 32).cast("int").alias("th"), F.col("at").bitwiseAND(0xFFFFFFFF).cast("int").alias("line"))
    return gone.groupBy("doc", "th").agg(F.sort_array(F.collect_list("line")).alias("removed"))


def decided(docs: DataFrame, **limits) -> DataFrame:
    """docs with the array of the line numbers that go as their last column, `removed` under a free name (null: none)."""
    seal = Sealed(docs)
    doc_id, text = F.col(seal["doc_id"]), F.col(seal["text"])
    d = line_decisions(seal.df.select(doc_id.alias("doc_id"), text.alias("text")), **limits)
    keyed = row_key(seal.df, text_col=seal["text"], name="own_th")
    same = (F.coalesce(doc_id.cast("long"), F.lit(NULL_ID)) == F.col("doc")) & (F.col("own_th") == F.col("th"))
    return seal.opened(keyed.join(d, same, "left"), removed="removed")


def _without(text, gone):
    """text without the lines of numbers gone (ascending): runs between them are cut out whole, so time is linear."""
    lines = F.split(text, "\n", -1)
    bounds = F.concat(F.array(F.lit(-1)), gone, F.array(F.size(lines)))
    both = F.array(F.struct(lines.alias("lines"), bounds.alias("at")))  # bound by a lambda, so made once
    run = lambda x: lambda k: F.slice(x["lines"], F.get(x["at"], k) + 2, F.get(x["at"], k + 1) - F.get(x["at"], k) - 1)
    kept = F.transform(both, lambda x: F.flatten(F.transform(F.sequence(F.lit(0), F.size(x["at"]) - 2), run(x))))
    return F.array_join(kept[0], "\n")


def dedup_lines(docs: DataFrame, **limits) -> DataFrame:
    """docs with the later matching lines cut out of text; all rows stay, some with an empty text."""
    made = decided(docs, **limits)
    seal = Sealed(made)
    text, gone = F.col(seal["text"]), F.col(seal.columns[-1])
    changed = F.when(gone.isNull(), text).otherwise(_without(text, gone))
    names = list(docs.columns)
    return seal.df.withColumn(seal["text"], changed).select(*seal.columns[: len(names)]).toDF(*names)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its lines, how many stay, and which go (numbers from 0)."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    lines = F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    n = F.coalesce(lines, F.lit(1)).cast("long")
    small = row_key(docs).select("doc_id", "_th", n.alias("n_lines"))
    d = line_decisions(docs)
    out = small.join(d, (F.coalesce(F.col("doc_id"), F.lit(NULL_ID)) == F.col("doc")) & (F.col("_th") == F.col("th")), "left")
    removed = F.coalesce("removed", F.expr("cast(array() as array<int>)"))
    return out.select("doc_id", "n_lines", (F.col("n_lines") - F.size(removed)).alias("n_kept"), removed.alias("removed"))
