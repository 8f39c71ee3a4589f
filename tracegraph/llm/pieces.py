"""SentencePiece segmentation by forward filtering and backward sampling over the piece lattice.

A text, with a space put before it, is the lattice of all ways to write it in pieces of a SentencePiece
vocabulary (spaces as U+2581; a character without a piece as its UTF-8 bytes). A piece of rank r weighs
(r + 10) ** -alpha. No piece of such vocabularies goes on past the start of a space after a non-space, so the lattice falls
into units there, and a unit into parts where no piece reaches across. Forward sums are made once for each distinct unit of a batch; then every occurrence draws
its pieces from its end backward, each in proportion to the weight of all ways to get there. The random number
at a character is a hash of the row's key and the character's place in the text: equal rows give equal
segmentations, in any batch, order or retry. Decoding joins the pieces and drops the first space, without loss.

Defined results: a null text gives null ids, an empty one no ids; a null key is a key like others; repeated
rows are segmented alike; U+2581 in a text is written in bytes; lone surrogates cannot occur in Spark strings;
other columns pass untouched.
"""

from __future__ import annotations

import functools
import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StructType

from ._common import Sealed, documents, mix64, pieces_of, span_hashes

SPACE, MARK = 0x20, 0x2581
ALPHA = 1.0
OFFSET = 10.0
BYTE_COST = -14.0  # log weight of a byte
SLICE = 1 << 18  # bytes of text worked on at a time; the arrays of its characters and edges are many times that
LONG = 64  # characters of a part that are worked on with those of all others
FEW = 16  # parts that are written one by one


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Vocabulary:
    """The pieces as a trie of their reversed characters, and what each id stands for in bytes."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.bytes_of, self.byte_id, children, self.piece, self.rank = [b""] * n, np.full(256, -1, np.int32), {}, [-1], [0]
        seen = 0
        for i in range(n):
            if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                continue
            text = sp.id_to_piece(i)
            if sp.is_byte(i):
                b = int(text[3:5], 16)
                self.byte_id[b], self.bytes_of[i] = i, bytes([b])
                continue
            text = text.replace(chr(MARK), " ")
            if " " in text.lstrip(" "):
                raise ValueError(f"piece {i} spans words")
            self.bytes_of[i] = text.encode()
            node = 0
            for c in reversed(text):
                key = (node, ord(c))
                if key not in children:
                    children[key] = len(self.piece)
                    self.piece.append(-1)
                    self.rank.append(0)
                node = children[key]
            self.piece[node], self.rank[node] = i, seen
            seen += 1
        if (self.byte_id < 0).any():
            raise ValueError("the vocabulary lacks bytes")
        self.piece, self.rank = np.array(self.piece, np.int64), np.array(self.rank, np.float64)
        self.roots = np.full(0x110000, -1, np.int64)  # the first step, without a search
        for (node, c), child in children.items():
            if not node:
                self.roots[c] = child
        size = 1 << max(10, (4 * len(children)).bit_length())  # a quarter full at most: nearly all keys lie where they hash
        self.shift = np.uint64(64 - size.bit_length() + 1)
        self.keys, self.next = np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        keys = np.array([a << 21 | c for a, c in children], np.int64)
        for key, at, child in zip(keys.tolist(), self._slot(keys).tolist(), children.values()):
            while self.keys[at] >= 0:
                at = (at + 1) % size
            self.keys[at], self.next[at] = key, child
        self.sizes = np.array([len(x) for x in self.bytes_of], np.int64)
        self.offsets = np.cumsum(self.sizes) - self.sizes
        self.all_bytes = np.frombuffer(b"".join(self.bytes_of), np.uint8)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def step(self, node: np.ndarray, c: np.ndarray) -> np.ndarray:
        """The node that c leads to, or -1."""
        key = node << 21 | c
        at = self._slot(key)
        there = self.keys[at]
        out = np.where(there == key, self.next[at], -1)
        open_ = np.flatnonzero((there != key) & (there >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) % len(self.keys)
            there = self.keys[at[open_]]
            hit = there == key[open_]
            out[open_[hit]] = self.next[at[open_[hit]]]
            open_ = open_[~hit & (there >= 0)]
        return out


@functools.cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def _byte_lengths(c: np.ndarray) -> np.ndarray:
    return 1 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF)


class Lattice:
    """Edges of distinct units by the character at which they end: length, piece (-1: bytes), and the cumulated chance of each among those that end there."""

    def __init__(self, v: Vocabulary, units: np.ndarray, starts: np.ndarray, ends: np.ndarray, alpha: float):
        n = ends - starts
        self.begin = np.cumsum(n) - n
        total = int(n.sum())
        pos = np.arange(total) - np.repeat(self.begin, n)
        c = units[np.repeat(starts, n) + pos].astype(np.int64)
        node = np.where(c == MARK, -1, v.roots[c])
        at = np.arange(total)
        nodes, lengths, pieces, logs = [], [], [], []
        alone = np.zeros(total, bool)
        length = 1
        while len(at):
            live = node >= 0
            at, node = at[live], node[live]
            is_piece = v.piece[node] >= 0
            if length == 1:
                alone[at[is_piece]] = True
            nodes.append(at[is_piece])
            lengths.append(np.full(is_piece.sum(), length, np.int64))
            pieces.append(v.piece[node[is_piece]])
            logs.append(-alpha * np.log(v.rank[node[is_piece]] + OFFSET))
            more = pos[at] >= length
            at, node = at[more], node[more]
            back = c[at - length]
            node = np.where(back == MARK, -1, v.step(node, back)) if len(at) else node
            length += 1
        raw = np.flatnonzero(~alone)  # characters without a piece of their own
        nodes.append(raw)
        lengths.append(np.ones(len(raw), np.int64))
        pieces.append(np.full(len(raw), -1, np.int64))
        logs.append(BYTE_COST * _byte_lengths(c[raw]))
        node, length, piece, log = (np.concatenate(x) for x in (nodes, lengths, pieces, logs))
        order = np.argsort(node, kind="stable")  # runs in order: merged, not sorted
        node, length, piece, log = node[order], length[order], piece[order], log[order]
        # parts: a unit is cut before each character that no edge reaches over, as all ways pass there
        over = np.zeros(total + 2, np.int64)
        np.add.at(over, node - length + 2, 1)
        np.add.at(over, node + 1, -1)
        self.part = np.flatnonzero(np.cumsum(over[:total]) == 0)
        sizes = np.diff(np.concatenate([self.part, [total]]))
        self.part_size = sizes
        self.part_of_unit = np.searchsorted(self.part, np.concatenate([self.begin, [total]]))
        pos = np.arange(total) - np.repeat(self.part, sizes)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(node, minlength=total))])
        step = pos[node]
        near = np.flatnonzero(step < LONG)
        by_step = near[np.argsort(step[near].astype(np.int16), kind="stable")]
        cuts = np.concatenate([[0], np.cumsum(np.bincount(step[near]))]) if len(near) else [0]
        alpha_at = np.full(total, -np.inf)  # log weight of all ways up to and with this character
        chance = np.empty(len(node))
        for place, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):  # the forward sums, all parts at once
            edge = by_step[a:b]
            e_node, e_len = node[edge], length[edge]
            w = log[edge]
            inner = np.flatnonzero(e_len <= place)
            w[inner] += alpha_at[e_node[inner] - e_len[inner]]
            first = np.flatnonzero(np.concatenate([[True], e_node[1:] != e_node[:-1]]))
            count = np.diff(np.concatenate([first, [b - a]]))
            top = np.maximum.reduceat(w, first)
            x = np.exp(w - np.repeat(top, count))
            run = np.cumsum(x)
            run -= np.repeat(run[first] - x[first], count)
            whole = run[first + count - 1]
            run /= np.repeat(whole, count)
            run[first + count - 1] = 1.0
            chance[edge] = run
            alpha_at[e_node[first]] = top + np.log(whole)
        for k in np.flatnonzero(sizes > LONG).tolist():  # and what lies beyond LONG characters of a part, one by one
            self._walk(int(self.part[k]), int(sizes[k]), length, log, alpha_at, chance)
        self.length, self.piece, self.chance = length, piece, chance

    def _walk(self, begin: int, size: int, length: np.ndarray, log: np.ndarray, alpha_at: np.ndarray, chance: np.ndarray) -> None:
        """The forward sums of the part at begin, from its LONG-th character on: a few steps an edge, however long the part."""
        edges = self.first[begin + LONG : begin + size + 1]
        low = int(edges[0])
        lengths, logs, cuts = length[low : edges[-1]].tolist(), log[low : edges[-1]].tolist(), (edges - low).tolist()
        sums = alpha_at[begin : begin + LONG].tolist()
        out: list[float] = []
        for place in range(LONG, size):
            ways = [logs[e] + (sums[place - lengths[e]] if lengths[e] <= place else 0.0) for e in range(cuts[place - LONG], cuts[place - LONG + 1])]
            top = max(ways)
            run, runs = 0.0, []
            for w in ways:
                run += math.exp(w - top)
                runs.append(run)
            out += [r / run for r in runs[:-1]]
            out.append(1.0)
            sums.append(top + math.log(run))
        chance[low : edges[-1]] = out


    def write(self, begin: int, left: int, u: np.ndarray, out: np.ndarray) -> None:
        """Draws the pieces of the part at begin from its left-th character backward into out; u: the number drawn where that many are left."""
        edges = self.first[begin : begin + left + 1]
        low = int(edges[0])
        lengths, chances, cuts, draws = self.length[low : edges[-1]].tolist(), self.chance[low : edges[-1]].tolist(), (edges - low).tolist(), u.tolist()
        starts, chosen = [], []
        while left:
            edge = cuts[left - 1]
            while chances[edge] <= draws[left]:
                edge += 1
            left -= lengths[edge]
            starts.append(left)
            chosen.append(edge)
        out[starts] = self.piece[low + np.array(chosen, np.int64)]


def sample(v: Vocabulary, texts: list[str], seeds: np.ndarray, alpha: float = ALPHA) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, and where each text's end. seeds: an unsigned 64-bit integer a text."""
    data = "".join(" " + t for t in texts if t).encode("utf-32-le")
    units = np.frombuffer(data, np.uint32)
    sizes = np.array([len(t) + 1 if t else 0 for t in texts], np.int64)
    stops = np.cumsum(sizes)
    if not len(units):
        return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
    space = units == SPACE
    new = space.copy()
    new[1:] &= ~space[:-1]
    new[(stops - sizes)[sizes > 0]] = True
    starts = np.flatnonzero(new)
    ends = np.concatenate([starts[1:], [len(units)]])
    _, first, which = np.unique(span_hashes(units, starts, ends), return_index=True, return_inverse=True)
    lattice = Lattice(v, units, starts[first], ends[first], alpha)
    place = np.full(len(units), -2, np.int64)  # the piece that starts at each character
    begin, end = lattice.part_of_unit[which], lattice.part_of_unit[which + 1]
    of = np.repeat(np.arange(len(starts)), end - begin)  # the unit of each part
    part = np.arange(len(of)) - np.repeat(np.cumsum(end - begin) - end, end - begin)
    at, left = lattice.part[part], lattice.part_size[part].copy()  # the part's first node; characters still to be written
    base = starts[of] + at - lattice.begin[which[of]]
    row = np.searchsorted(stops, base, side="right")
    own = seeds[row] ^ mix64(seeds[row] + np.uint64(1))
    offset = (stops - sizes)[row]
    draw = lambda own, spot: (mix64(own + spot.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(11)).astype(np.float64) * 2.0**-53
    while len(at) > FEW:
        node = at + left - 1
        u = draw(own, base + left - offset)
        edge = lattice.first[node]
        low = np.flatnonzero(lattice.chance[edge] <= u)
        while len(low):
            edge[low] += 1
            low = low[lattice.chance[edge[low]] <= u[low]]
        left = left - lattice.length[edge]
        place[base + left] = lattice.piece[edge]
        go = left > 0
        if not go.all():
            at, left, base, own, offset = at[go], left[go], base[go], own[go], offset[go]
    for k in range(len(at)):  # the last few, which may be long, one by one
        lattice.write(int(at[k]), int(left[k]), draw(own[k], base[k] + np.arange(left[k] + 1) - offset[k]), place[base[k] : base[k] + left[k]])
    used = np.flatnonzero(place > -2)
    ids = place[used]
    size = np.ones(len(ids), np.int64)
    raw = np.flatnonzero(ids < 0)
    if len(raw):
        size[raw] = _byte_lengths(units[used[raw]])
        out = np.repeat(ids, size).astype(np.int32)
        written = "".join(map(chr, units[used[raw]].tolist())).encode()
        out[np.repeat(ids, size) < 0] = v.byte_id[np.frombuffer(written, np.uint8)]
    else:
        out = ids.astype(np.int32)
    total = np.concatenate([[0], np.cumsum(size)])
    return out, total[np.searchsorted(used, stops)]


def decode_all(v: Vocabulary, ids: np.ndarray, stops: np.ndarray) -> list[str]:
    """The texts that runs of ids stand for; stops: where each ends."""
    sizes = v.sizes[ids]
    ends = np.cumsum(sizes)
    at = np.repeat(v.offsets[ids] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)
    data = v.all_bytes[at].tobytes()
    cuts = np.concatenate([[0], ends])[stops].tolist()
    return [data[a:b].decode("utf-8", "replace")[1:] for a, b in zip([0, *cuts], cuts)]


def encode_sampled(df: DataFrame, key: str = "doc_id", text: str = "text", model: str | None = None, alpha: float = ALPHA, seed: int = 0, ids: str = "ids", check: str | None = None) -> DataFrame:
    """df with ids, a sampled segmentation of text seeded by seed and key (any type). check: a column that says
    whether the ids, decoded, are the text."""
    model = model or default_model()
    seal = Sealed(df)
    seeded = seal.df.withColumn("seed", F.xxhash64(F.lit(seed), F.col(seal[key])))
    text, columns = seal[text], seal.columns

    def run(batches):
        import pyarrow as pa

        v = vocabulary(model)
        for batch in batches:
            for part in pieces_of(batch, SLICE, text):
                texts = part.column(text).to_pylist()
                seeds = np.asarray(part.column("seed")).view(np.uint64)
                values, stops = sample(v, [t or "" for t in texts], seeds, alpha)
                offsets = pa.array(np.concatenate([[0], stops]).astype(np.int32))
                none = np.array([t is None for t in texts])
                made = pa.ListArray.from_arrays(offsets, pa.array(values), mask=pa.array(none)) if none.any() else pa.ListArray.from_arrays(offsets, pa.array(values))
                out = [*(part.column(c) for c in columns), made]
                if check:
                    same = [None if t is None else t == u for t, u in zip(texts, decode_all(v, values.astype(np.int64), stops))]
                    out.append(pa.array(same, pa.bool_()))
                yield pa.RecordBatch.from_arrays(out, [*columns, "ids", *(["same"] if check else [])])
            pa.default_memory_pool().release_unused()

    schema = StructType(list(seal.df.schema.fields)).add("ids", ArrayType(IntegerType()))
    made = seeded.mapInArrow(run, schema.add("same", BooleanType()) if check else schema)
    return seal.opened(made, **{ids: "ids"}, **({check: "same"} if check else {}))


def decoded(df: DataFrame, ids: str = "ids", text: str = "decoded", model: str | None = None) -> DataFrame:
    """df with the text that ids stand for."""
    model = model or default_model()
    seal = Sealed(df)
    ids = seal[ids]

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        v = vocabulary(model)
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                lists = part.column(ids)
                stops = np.cumsum(np.asarray(pc.fill_null(pc.list_value_length(lists), 0)).astype(np.int64))
                texts = decode_all(v, np.asarray(lists.flatten()).astype(np.int64), stops)
                yield part.append_column("text", pa.array(texts, pa.string(), mask=np.asarray(lists.is_null())))

    return seal.opened(seal.df.mapInArrow(run, StructType(list(seal.df.schema.fields)).add("text", "string")), **{text: "text"})


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's sampled ids, how many, and whether they decode to its text (null text: null)."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    both = decoded(encode_sampled(docs))
    n = F.when(F.col("ids").isNotNull(), F.size("ids")).cast("long")
    return both.select("doc_id", "ids", n.alias("n_pieces"), (F.col("decoded") == F.col("text")).alias("lossless"))
