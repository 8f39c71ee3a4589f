"""Each operator against brute force, on documents with nulls, empty and long texts, ties, repeats and odd columns."""

import functools
import hashlib
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracegraph.llm import lang_id, line_dedup, media, mixing, multiset, pieces, queries, revisits, simhash, token_store, url_filter


def by(rows, *keys):
    return sorted(rows, key=lambda r: tuple((r[k] is not None, r[k] if r[k] is not None else 0) for k in keys))


def ordered(corpus):
    return sorted({(d[0], d[1]) for d in corpus}, key=lambda d: (d[0] is not None, d[0] or 0))


@pytest.mark.parametrize("name", ["op1_media_columns", "op2_line_dedup", "op3_token_store", "op4_revisits", "op5_url_filter", "op6_mixing", "op7_language_id", "op8_simhash", "op9_sentencepiece", "op10_fingerprints", "pipeline"])
def test_empty_tables(spark, empty_dir, name):
    assert queries.QUERIES[name](spark, empty_dir).count() == 0


def test_media_round_trip(spark, sf_dir, corpus):
    got = media.op1_media_columns(spark, sf_dir).collect()
    want = []
    for d in corpus:
        raw = (d[1] or "").encode()
        padded = raw + b"\xff" * (max(576, -(-len(raw) // 576) * 576) - len(raw))
        want.append((d[0], len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-32:])))
    key = lambda t: (t[0] is not None, t[0] or 0, t[1], t[3])
    assert sorted((tuple(r[:5]) for r in got), key=key) == sorted(want, key=key)


def test_media_tables():
    data = media.mux(bytes(range(256)) * 9 * 200)
    (track,) = media.describe(data)
    assert (track["codec"], track["timescale"], track["duration"]) == ("raw ", 8000, 576 * 800)
    assert len(track["samples"]) == 800 and len(track["keyframes"]) == 50 and media.payload_of(data, track) == bytes(range(256)) * 9 * 200
    assert all(track["samples"][16 * i] == k for i, k in enumerate(track["keyframes"]))
    for bad in (b"", b"x" * 50, data[:200], data[:-1], data.replace(b"stsz", b"free")):
        with pytest.raises(media.Malformed):
            media.describe(bad)


@pytest.mark.parametrize("limits", [{}, {"named": 1, "hot": 5, "small": 2}])
def test_line_dedup(docs, corpus, limits):
    seen, want = [], {}
    for i, t in ordered(corpus):
        for k, line in enumerate((t or "").split("\n")):
            w = frozenset((line or "").encode().split())
            if w:
                if any(5 * len(w & y) >= 4 * len(w | y) for y in seen):
                    want.setdefault((i, t), []).append(k)
                seen.append(w)
    want = {k: v for k, v in want.items() if k[0] != 5}  # rows that share an id are in the order of a hash
    got = line_dedup.decided(docs, **limits)
    got = {(r["doc_id"], r["text"]): r["removed"] for r in got.where("removed is not null").collect() if r["doc_id"] != 5}
    assert got == want
    left = line_dedup.dedup_lines(docs, **limits)
    assert left.columns == docs.columns
    kept = lambda i, t: t if (i, t) not in want else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in want[i, t])
    assert {(r["doc_id"], r["text"]) for r in left.collect() if r["doc_id"] != 5} == {(d[0], kept(d[0], d[1])) for d in corpus if d[0] != 5}


@pytest.mark.parametrize("limits", [{}, {"hot": 7, "small": 3}, {"later": (1, 2, None)}, {"later": (3, None), "hot": 7}])
def test_line_dedup_asks_again(spark, limits):
    """A match behind many lines that pass the short bitmap and do not match, of a line that also has a copy."""
    rng = np.random.default_rng(3)
    often = [f"often{k}" for k in range(60)]  # so common that they come last, else the place of a word in its line tells
    texts = []
    for group in range(3):
        base = [f"g{group}w{k}" for k in range(100)]
        near = lambda n: " ".join([*rng.permutation(base)[n:], *rng.permutation(often)[:n]])  # noqa: E731, B023
        texts += [near(15) for _ in range(40)] + [near(5), " ".join(base)] + [near(15) for _ in range(5)] + [" ".join(base)] * 2
    texts.append(" ".join(often * 500))
    sets = [frozenset(t.split()) for t in texts]
    want = {i for i, x in enumerate(sets) if any(5 * len(x & y) >= 4 * len(x | y) for y in sets[:i])}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    assert {r["doc"] for r in line_dedup.line_decisions(docs, **limits).collect()} == want and 41 in want


@pytest.mark.parametrize("limits", [{}, {"named": 1, "hot": 5, "small": 2}])
def test_line_dedup_of_short_lines(spark, limits):
    """Lines of 1 to 6 words out of few, among them four words before and after five that contain them."""
    rng = np.random.default_rng(5)
    texts = ["a b c d", "a b c d e", "p q r s t", "s r q p", "a b c", "f g h", "f g h i"]
    texts += [" ".join(rng.permutation([f"w{k}" for k in range(12)])[: rng.integers(1, 7)]) for _ in range(150)]
    sets = [frozenset(t.split()) for t in texts]
    want = {i for i, x in enumerate(sets) if any(5 * len(x & y) >= 4 * len(x | y) for y in sets[:i])}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert {1, 3} <= want and not {4, 6} & want
    assert {r["doc"] for r in line_dedup.line_decisions(docs, **limits).collect()} == want


def test_line_dedup_splits_texts_once_for_all_later_rounds(spark, monkeypatch):
    made = []
    real = line_dedup.signatures
    monkeypatch.setattr(line_dedup, "signatures", lambda *a: made.append(len(a)) or real(*a))
    rng = np.random.default_rng(3)
    often, base = [f"often{k}" for k in range(60)], [f"w{k}" for k in range(100)]
    near = lambda n: " ".join([*rng.permutation(base)[n:], *rng.permutation(often)[:n]])
    texts = [near(12) for _ in range(40)] + [" ".join(base), near(5), " ".join(often * 500)]  # just below 0.8, so some pass the long bitmap
    sets = [frozenset(t.split()) for t in texts]
    want = {i for i, x in enumerate(sets) if any(5 * len(x & y) >= 4 * len(x | y) for y in sets[:i])}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc"] for r in line_dedup.line_decisions(docs, named=1, later=(1, 2, 3, None)).collect()}
    assert got == want and made == [2, 3]


def test_line_dedup_reads_only_the_lines_of_pairs():
    import pyarrow as pa

    texts, ids, th = ["a b\nc\n\nd", None, "", "e\nü f"], [4, None, 5, 6], [-7, 1, 0, 9]
    part = pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts), pa.array(th, pa.int32())], ["doc_id", "text", "_th"])
    places = [(4, -7, 0), (4, -7, 3), (6, 9, 1)]
    doc, at = np.array([x[0] for x in places], np.int64), np.array([x[1] << 32 | x[2] for x in places], np.int64)
    bits = np.zeros(line_dedup.FILTER, np.uint8)
    bits[(line_dedup.mix64(line_dedup._number(np.zeros(3, np.int64), doc, at)) & np.uint64(line_dedup.FILTER - 1)).astype(np.int64)] = 1
    assert line_dedup._lines_of(part, np.packbits(bits)).to_pylist() == ["a b\n", "d\n", "ü f\n"]
    assert not len(line_dedup._lines_of(part, np.packbits(bits * 0)))


def _line_rows(spark, texts, partitions):
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, _th int").repartition(partitions)
    return line_dedup.signatures(docs, spark.sparkContext.broadcast(line_dedup.word_table(docs)))


def test_rows_of_lines_are_dealt_packed(spark):
    """What is shuffled of a line's rows: few values, in three quarters of the 42 bytes a row that rows of their own took."""
    rng = np.random.default_rng(7)
    texts = ["\n".join(" ".join(rng.choice([f"w{k}" for k in range(3000)], 30)) for _ in range(20)) for _ in range(500)]
    made = _line_rows(spark, texts + texts[:50], 2).collect()
    rows = np.concatenate([line_dedup._unpacked(memoryview(r["rows"])) for r in made], axis=1)
    assert rows.shape[1] > 50_000 and len(made) <= 2 * 64
    assert sum(len(r["rows"]) for r in made) < 32 * rows.shape[1]


def test_packed_rows_come_back():
    rng = np.random.default_rng(2)
    n = 5000
    rows = rng.integers(-(1 << 62), 1 << 62, (7, n))
    rows[0, : n // 2], rows[1] = rng.integers(0, 1 << 48, n // 2), rng.integers(1, 99, n)
    rows[0, n // 2 :] = -1 - (rows[2, n // 2 :] & (1 << 62) - 1)
    rows[2, n // 2 :] = -1 - rows[0, n // 2 :]
    rows[1, n // 2 :] <<= 32  # whole sets
    made = line_dedup._packed([rows[:, :9].copy(), rows[:, 9:].copy()], 64)
    parts, back = made.column("part").to_pylist(), [line_dedup._unpacked(x.as_buffer()) for x in made.column("rows")]
    assert parts == sorted(set(parts)) and len(parts) == 64
    assert sorted(map(tuple, np.concatenate(back, axis=1).T.tolist())) == sorted(map(tuple, rows.T.tolist()))


def test_a_part_is_held_in_bounds(spark):
    """Where a part has more rows than are held at once, equal lines and hot keys come out the same."""
    rng = np.random.default_rng(4)
    texts = [" ".join(rng.choice([f"w{k}" for k in range(40)], 8)) for _ in range(120)] * 2 + [" ".join(f"b{k}" for k in range(20) if k != x % 20) + f" c{x}" for x in range(40)] + ["a b c d e"] * 30
    rows = _line_rows(spark, texts, 7).cache()

    def found(**limits):
        out = line_dedup.packed_matches(rows, None, **limits).collect()
        return sorted(tuple(-1 if x is None else x for x in r) for r in out if r["kind"] != 4)

    assert found(most=1) == found() and {r[0] for r in found()} == {0, 1}
    hot = found(hot=5, most=1)
    assert hot == found(hot=5) and {r[0] for r in hot} >= {0, 3}


def test_spans_of_words():
    import pyarrow as pa

    for texts in ([], [""], ["a"], [" a  b\n", "", "c\td"], ["", "x"], ["ü\x0bz\x00 ", "\n\n"]):
        data, offsets, starts, ends = line_dedup._spans(pa.array(texts, pa.large_string()))
        words = [bytes(data[a:b]) for a, b in zip(starts, ends)]
        assert words == [w for t in texts for w in t.encode().split()] and len(offsets) == len(texts) + 1


def test_hashes_of_words():
    words = [b"a", b"ab", b"a\0", b"12345678", b"123456789", b"\xff" * 8] + [b"xy" * k for k in range(2, 70)] + [b"xy" * k + b"x" for k in range(2, 70)]
    lines = [words, words[::-1]]
    hashes = []
    for line in lines:
        data = np.frombuffer(b" ".join(line), np.uint8)
        ends = np.cumsum([len(w) + 1 for w in line]) - 1
        hashes.append(dict(zip(line, line_dedup._word_hashes(data, ends - [len(w) for w in line], ends).tolist())))
    assert hashes[0] == hashes[1] and len(set(hashes[0].values())) == len(words)


@pytest.mark.parametrize("named", [2, None])
def test_memory_of_a_large_key(named):
    """What is held while a key's rows are compared, and each part that is passed on, does not follow the square of the key."""
    import tracemalloc

    n = 4096 if named else 1024
    same = lambda x, kind: np.full(n, x, kind)
    r = {"key": same(7, np.int64), "shape": same(100 << 32 | 1, np.int64), "sid": np.arange(n), "bits": same(5, np.uint64), "half": same(9, np.uint64), "doc": np.arange(n), "at": same(0, np.int64)}
    found, largest = [0, 0, 0], 0
    tracemalloc.start()
    for kind, i, _ in line_dedup._match(r, named):
        found[kind] += len(i)
        largest = max(largest, len(i))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == ([0, 2 * n - 3, n - 3] if named else [0, n * (n - 1) // 2, 0])
    assert peak < 40e6 and largest < 3e5


def test_memory_of_sampling():
    """A worker's arrays while a megabyte of text with few repeated words is segmented."""
    import tracemalloc

    import pyarrow as pa

    rng = np.random.default_rng(1)
    letters = np.array(list("etaoinshrdlucmwfgypbvk"))
    texts = [" ".join("".join(letters[rng.integers(0, 22, rng.integers(2, 12))]) for _ in range(300)) for _ in range(600)]
    v = pieces.vocabulary(pieces.default_model())
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    tracemalloc.start()
    for part in pieces.pieces_of(batch, pieces.SLICE):
        some = part.column("text").to_pylist()
        ids, stops = pieces.sample(v, some, np.arange(len(some)).astype(np.uint64))
        assert pieces.decode_all(v, ids.astype(np.int64), stops) == some
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150e6, peak


def test_token_store(spark, sf_dir, corpus, monkeypatch):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(token_store.default_vocabulary())
    path = token_store.write_store(spark.read.parquet(f"{sf_dir}/documents.parquet"), token_store.fresh_path(spark, "t"))
    got = sorted(token_store.stream_checks(spark, path).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == sorted((d[0] for d in corpus), key=lambda x: (x is not None, x or 0))
    ids = {(d[0], tuple(tok.encode(d[1] or "", add_special_tokens=False).ids + [0])) for d in corpus}
    crc = {(i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in ids}
    assert {(r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got} == crc and all(r["verified"] for r in got)
    at = 0
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
    assert {(r["doc_id"], tuple(r["ids"])) for r in token_store.read_documents(spark, path).collect()} == ids
    held = token_store.verified_parts(spark, path).collect()
    assert all(r["ok"] for r in held) and -1 in {r["part"] for r in held}
    chunks = spark.read.parquet(f"{path}/objects/kind=chunk")
    assert chunks.count() == chunks.select("hash").distinct().count()
    monkeypatch.setattr(token_store, "HOT", 1)  # so that the chunks of repeated documents go to all tasks
    assert sorted(map(tuple, got), key=lambda r: r[1]) == sorted(map(tuple, token_store.stream_checks(spark, path).collect()), key=lambda r: r[1])


@pytest.mark.parametrize("damage", ["chunk", "order", "lost"])
def test_a_damaged_store_does_not_verify(spark, sf_dir, damage):
    import shutil

    path = token_store.write_store(spark.read.parquet(f"{sf_dir}/documents.parquet"), token_store.fresh_path(spark, "t"))
    name = "recipes" if damage != "chunk" else "objects/kind=chunk"
    rows = spark.read.parquet(f"{path}/{name}")
    if damage == "chunk":
        rows = rows.withColumn("ids", F.when(F.col("n") > 100, F.reverse("ids")).otherwise(F.col("ids")))
    elif damage == "order":
        rows = rows.withColumn("chunks", F.reverse("chunks"))
    else:
        rows = rows.where("start > 0")
    rows.write.parquet(f"{path}/changed")
    local = path.removeprefix("file:")
    shutil.rmtree(f"{local}/{name}")
    shutil.move(f"{local}/changed", f"{local}/{name}")
    said = {r["verified"] for r in token_store.stream_checks(spark, path).collect()}
    assert said == ({True, False} if damage == "chunk" else {False})


def test_encoding_is_that_of_whole_texts():
    import pyarrow as pa
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(token_store.default_vocabulary())
    rng = np.random.default_rng(1)
    parts = [*"ab 1.\n\t\r\x0b\u00a0\u2003\u3000é好😀'(-", "<|endoftext|>", "\n\n", "  ", "'s", "'ll", "ing", "the", "x" * 70, "\x1c"]
    texts = ["".join(rng.choice(parts, rng.integers(0, 30))) for _ in range(3000)] + ["", " ", "\n", "word" * 5000]
    for encode in (token_store.encoder(token_store.default_vocabulary()), token_store.Encoder(token_store.default_vocabulary(), "<u4")):
        for again in range(2):  # from memory the second time
            ids, stops = encode(pa.array(texts, pa.large_string()))
            got = [ids[a:b].tolist() for a, b in zip([0, *stops[:-1]], stops)]
            assert got == [tok.encode(t, add_special_tokens=False).ids + [0] for t in texts]
        encode.splits = False
        ids, stops = encode(pa.array(texts[:50], pa.large_string()))
        assert [ids[a:b].tolist() for a, b in zip([0, *stops[:-1]], stops)] == got[:50]
        encode.splits = True


def test_tokenizers_of_other_kinds_get_whole_texts():
    import json

    import pyarrow as pa
    import public_tokenizers
    from tokenizers import Tokenizer

    other = public_tokenizers.path("word_bpe_49k.json")
    encode, tok = token_store.Encoder(other), Tokenizer.from_file(other)
    texts = ["One two  THREE", "", "a\nb's <|endoftext|> c"]
    ids, stops = encode(pa.array(texts, pa.large_string()))
    assert not encode.splits and [ids[a:b].tolist() for a, b in zip([0, *stops[:-1]], stops)] == [tok.encode(t, add_special_tokens=False).ids + [0] for t in texts]
    spec = json.loads(Tokenizer.from_file(token_store.default_vocabulary()).to_str())
    assert token_store.splits_at_spaces(spec)
    for change in ({"normalizer": {"type": "Lowercase"}}, {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True}}, {"pre_tokenizer": None}):
        assert not token_store.splits_at_spaces(spec | change)


def test_merkle_root_is_that_of_the_tree():
    def tree(leaves):
        level = [hashlib.sha256(b"\0" + x).digest() for x in leaves] or [hashlib.sha256(b"").digest()]
        while len(level) > 1:
            level = [hashlib.sha256(b"\1" + level[i] + level[i + 1]).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        return level[0]

    for n in range(40):
        leaves = [bytes([i]) for i in range(n)]
        assert token_store.merkle(leaves) == tree(leaves)


def test_crc_of_parts():
    a, b = b"some bytes", b"and others, more of them" * 40
    moved = token_store.shift_crc(np.array([zlib.crc32(a)]), np.array([len(b)]))
    assert int(moved[0]) ^ zlib.crc32(b) == zlib.crc32(a + b)


def test_chunks_are_cut_alike():
    ids = np.random.default_rng(1).integers(0, 50_000, 30_000)
    ends = token_store.chunk_ends(ids, np.array([30_000]))
    later = token_store.chunk_ends(np.concatenate([[7] * 100, ids]), np.array([30_100])) - 100
    assert set(ends[1:]) <= set(later) and len(ends) > 20
    assert np.diff(token_store.chunk_ends(np.zeros(50_000, np.int64), np.array([50_000]))).max() <= token_store.LONGEST


def test_revisits(spark):
    rows = [
        (1, "http://www.a.org/x/?b=2&a=1&utm_source=q#top", 10, "response", '"e1"', "d1", {"content-type": "t", "date": "1"}, "p1"),
        (2, "https://A.org/x?a=1&b=2", 20, "revisit", 'W/"e1"', None, {"date": "2", "content-type": "no"}, None),
        (3, "https://a.org/x?a=1&b=2", 30, "response", '"e2"', "d2", {"date": "3"}, "p2"),
        (4, "https://a.org/x?a=1&b=2", 40, "revisit", '"e1"', None, None, None),
        (5, "https://a.org/x?a=1&b=2", 40, "revisit", None, "d2", None, None),
        (6, "https://a.org/x?a=1&b=2", 40, "revisit", None, None, None, None),
        (7, "https://a.org/x?a=1&b=2", 5, "revisit", '"e1"', None, None, None),
        (8, None, 50, "revisit", '"e1"', None, None, None), (9, "http://b.org", None, "response", None, None, None, "p9"), (10, "", 1, "revisit", None, None, None, None),
    ]
    schema = "record_id long, url string, ts long, kind string, etag string, last_modified string, headers map<string, string>, digest string"
    got = {r["record_id"]: r for r in revisits.resolve_revisits(spark.createDataFrame(rows, schema), slices=4).collect()}
    assert {k: (r["outcome"], r["refers_to"]) for k, r in got.items()} == {
        2: ("resolved", 1), 4: ("changed", None), 5: ("resolved", 3), 6: ("unvalidated", 3), 7: ("no_response", None), 8: ("no_response", None), 10: ("no_response", None)
    }
    assert got[2]["headers"] == {"content-type": "t", "date": "2"} and got[2]["digest"] == "p1"


def _grams(text):
    code = lambda c: "abcdefghijklmnopqrstuvwxyz0/.-".find(c) + 1 or 31
    c = [0, 0, 0] + [code(x) for x in text.lower().translate(str.maketrans("123456789_", "000000000-"))]
    return [tuple(c[i - 3 : i + 1]) for i in range(3, len(c))]


def test_url_filter(spark):
    rng = np.random.default_rng(2)
    urls = [f"http://{rng.choice(['', 'www.', 'm.'])}{rng.choice(['ab', 'example', 'cd'])}.{rng.choice(['com', 'net', 'org'])}/{rng.choice(['en', 'es', 'fr'])}/{i}?q" for i in range(300)]
    urls += [None, "", "no scheme", "HTTP://EXAMPLE.com/en/x#y", "http://com", "http://com/", urls[0]]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r["page_id"]: r for r in url_filter.judge(df).collect()}
    assert len(got) == len(urls)
    n = len(urls)
    assert (got[n - 4]["host"], got[n - 4]["path"], got[n - 4]["rule"], got[n - 4]["verdict"]) == ("example.com", "/en/x", "example.com/en/", "block")
    assert [got[n - k]["rule"] for k in (3, 2)] == [None, "com/"] and [got[n - k]["host"] for k in (7, 6, 5)] == ["", "", ""]
    counts = [{}, {}]
    for i, u in enumerate(urls):
        if got[i]["rule"] and zlib.crc32(u.encode()) % 5:
            for g in _grams(got[i]["host"] + got[i]["path"]):
                counts[got[i]["verdict"] == "allow"][g] = counts[got[i]["verdict"] == "allow"].get(g, 0) + 1

    def prob(c, g, k):
        if k < 0:
            return 1 / 32
        low, same = prob(c, g, k - 1), {}
        for h, v in c.items():
            if h[3 - k : 3] == g[3 - k : 3]:
                same[h[3]] = same.get(h[3], 0) + v
        total = sum(same.values())
        return (same.get(g[3], 0) + len(same) * low) / (total + len(same)) if total else low

    def score(i):
        gs = _grams(got[i]["host"] + got[i]["path"])
        return sum(math.log(prob(counts[1], g, 3) / prob(counts[0], g, 3)) for g in gs) / len(gs) if gs else 0.0

    held = [(round(100 * score(i)), got[i]["verdict"] == "allow") for i, u in enumerate(urls) if got[i]["rule"] and not zlib.crc32(u.encode()) % 5]
    good, bad = sum(a for _, a in held), sum(not a for _, a in held)
    bins = sorted({b for b, _ in held})
    best = max((sum(a and b >= at for b, a in held) / good + sum(not a and b < at for b, a in held) / bad, -at) for at in [*bins, bins[-1] + 1])
    limit = -best[1] / 100 - 0.005
    judged = [i for i in range(n) if not got[i]["rule"]]
    assert good and bad and {got[i]["verdict"] for i in judged} == {"allow", "block"}
    for i in judged:
        want = score(i)
        assert abs(got[i]["score"] - want) < 1e-4 and got[i]["verdict"] == ("allow" if want >= limit else "block")


def test_mixing(spark, sf_dir, corpus):
    rows = mixing.op6_mixing(spark, sf_dir).collect()
    assert len(rows) == len(corpus) and all(r["taken"] <= 3 * r["size"] for r in rows)
    words = {}
    for d in corpus:
        words[d[3]] = words.get(d[3], 0) + len((d[1] or "").encode().split())
    names = sorted((s for s in words if s is not None)) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, free, left = {}, set(names), sum(words.values())
    while free:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if level * weight[s] > 3 * words[s]}
        if not full:
            target |= {s: level * weight[s] for s in free}
            break
        target |= {s: 3.0 * words[s] for s in full}
        left -= sum(3 * words[s] for s in full)
        free -= full
    got = {}
    for r in rows:
        key = (r["source_size"], round(r["target"], 6))
        got[key] = got.get(key, 0) + r["taken"]
    assert {k: round(k[1]) for k in got} == got and sorted(got) == sorted((words[s], round(target[s], 6)) for s in names)
    again = mixing.op6_mixing(spark, sf_dir).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, rows))


def test_language_id(spark, docs, sf_dir):
    rows = lang_id.op7_language_id(spark, sf_dir).join(docs.select("doc_id", "lang", "text").distinct(), "doc_id").collect()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1
        if r["text"] is None or not any(c.isalpha() for c in r["text"]):
            assert r["lang_pred"] == "und"
    known = [r for r in rows if r["held_out"] and r["lang"] and r["text"] and len(r["text"]) > 40]
    assert sum(r["lang_pred"] == r["lang"] for r in known) >= 0.95 * len(known)
    assert lang_id.train_model(docs.limit(0)) is None
    assert lang_id.reject_languages(docs).columns == docs.columns


def test_sharded_language_model(docs):
    """A model beyond the entries of a shard knows and says the same; a rare language is learned too."""
    rare = docs.limit(1).select(F.lit(1000).cast("long").alias("doc_id"), F.lit("zz").alias("lang"), F.lit("qwxyz jkvqz").alias("text"))
    train = lang_id.training_rows(docs).select("doc_id", "lang", "text").unionByName(rare)
    one, several = lang_id.train_model(train), lang_id.train_model(train, 300)
    assert several.langs == one.langs == ["de", "en", "zz"] and len(several.sent) > 3
    texts = docs.select(F.xxhash64("doc_id", "text").alias("k"), "text").distinct().unionByName(rare.select(F.lit(1).cast("long").alias("k"), "text"))
    got, want = ({r["k"]: r for r in lang_id.predict(texts, m, ["k"]).collect()} for m in (several, one))
    assert got.keys() == want.keys() and got[1]["lang_pred"] == "zz"
    for k, r in want.items():
        assert got[k]["lang_pred"] == r["lang_pred"] and abs((got[k]["cross_entropy"] or 0) - (r["cross_entropy"] or 0)) < 1e-4


def test_kneser_ney_adds_up(docs):
    model = lang_id.train_model(lang_id.training_rows(docs))
    letters = sorted({c for t in docs.where("text is not null").select("text").collect() for c in t["text"].lower() if c.isalpha()} | {chr(lang_id.EDGE)})
    for context in ("\1\1t", "the", "\1\1\1"):
        base = sum(ord(c) << 16 * (3 - i) for i, c in enumerate(context))
        p = np.exp(model.log_prob(np.array([base | ord(c) for c in letters], np.uint64)))
        assert (p.sum(axis=0) < 1.001).all() and (p.sum(axis=0) > 0.95).all()


def test_simhash(spark, sf_dir, corpus):
    import xxhash

    def brute(text):
        w = (text or "").encode().lower().split()
        if not w:
            return 0
        h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    want = sorted({(d[0] is not None, d[0] or 0, brute(d[1])) for d in corpus})
    fps = sorted({x[2] for x in want})
    root = {f: f for f in fps}
    for a in fps:
        for b in fps:
            if (a ^ b).bit_count() <= 4 and root[a] != root[b]:
                old, new = root[b], root[a]
                root = {k: new if v == old else v for k, v in root.items()}
    least = {r: min((i for ok, i, f in want if ok and root[f] == r), default=None) for r in set(root.values())}
    got = sorted({(r["doc_id"] is not None, r["doc_id"] or 0, int(r["fingerprint"], 16), r["component_id"]) for r in simhash.op8_simhash(spark, sf_dir).collect()}, key=lambda t: t[:3])
    assert got == [(*x, least[root[x[2]]]) for x in want]


def test_simhash_links_of_a_large_group(spark):
    rng = np.random.default_rng(4)
    near = np.uint64(0x1234567890ABCDEF) ^ np.unique(np.uint64(1) << rng.integers(0, 64, 400).astype(np.uint64) | np.uint64(1) << rng.integers(0, 64, 400).astype(np.uint64))
    fps = np.unique(np.concatenate([near, rng.integers(0, 1 << 63, 500).astype(np.uint64)]))
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    for m in (6, 7):
        got = {r["id"]: r["root"] for r in simhash.components(simhash.links(df, m)).collect()}
        assert len({got[int(x)] for x in near.view(np.int64)}) == 1
    chain = spark.createDataFrame([(i, i + 1) for i in range(300)], "a long, b long")
    assert simhash.components(chain).select("root").distinct().count() == 1


def test_keep_one(docs):
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    n = simhash.near_duplicates(docs.withColumn("k", F.struct("doc_id", F.hash("text").alias("h"))), "k", simhash.STAGE_SHINGLE, simhash.STAGE_DISTANCE)
    assert kept.count() == n.select("component_id").distinct().count()


def test_pieces(spark, docs):
    rows = pieces.decoded(pieces.encode_sampled(docs)).collect()
    assert all(r["decoded"] == r["text"] and (r["ids"] is None) == (r["text"] is None) for r in rows)
    again = {(r["doc_id"], r["text"]): r["ids"] for r in pieces.encode_sampled(docs.repartition(7), check="ok").where("ok or text is null").collect()}
    assert again == {(r["doc_id"], r["text"]): r["ids"] for r in rows}
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    assert all(sp.decode(r["ids"]) == r["text"] for r in rows if r["text"] and r["doc_id"] not in (71, 69))


def test_sampling_follows_the_lattice():
    v = pieces.vocabulary(pieces.default_model())
    n = 20_000
    ids, stops = pieces.sample(v, ["the"] * n, np.arange(n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    got = {}
    for a, b in zip([0, *stops[:-1]], stops):
        got[tuple(ids[a:b])] = got.get(tuple(ids[a:b]), 0) + 1 / n
    rank = {v.bytes_of[v.piece[k]].decode(): v.rank[k] for k in range(1, len(v.piece)) if v.piece[k] >= 0}
    weight = {}

    def walk(rest, path, w):
        if not rest:
            weight[path] = w
        for k in range(1, len(rest) + 1):
            if rest[:k] in rank:
                walk(rest[k:], (*path, rest[:k]), w / (rank[rest[:k]] + pieces.OFFSET))

    walk(" the", (), 1.0)
    total = sum(weight.values())
    for path, w in weight.items():
        share = sum(p for k, p in got.items() if tuple(v.bytes_of[i].decode() for i in k) == path)
        assert abs(share - w / total) < 0.015


def test_fingerprints(spark, sf_dir, corpus):
    rows = multiset.op10_fingerprints(spark, sf_dir).collect()
    own = sorted((d for d in set((d[0], d[1] or "") for d in corpus) if d[0] != 5), key=lambda d: (d[0] is not None, d[0] or 0))
    got = {(r["doc_id"], r["n_chars"]): r for r in rows}
    assert len(rows) == len(corpus)
    for (i, t), (j, u) in zip(own, own[1:] + own[:1]):
        if i == 4 or j == 6:
            continue  # the neighbour shares an id with others
        q = len(t) // 4
        assert got[i, len(t)]["edited_sha256"] == hashlib.sha256((t[: len(t) - q] + u[:q]).encode()).hexdigest()
    long = [r for r in rows if r["n_chars"] > 400 and r["doc_id"] not in (71, 72)]
    assert all(r["near_edited"] > r["near_next"] for r in long if r["doc_id"] not in range(60, 66)) and all(0 <= r["near_next"] <= 1 for r in rows)


def _vector(text):
    """(lanes of equality, number of runs, lanes of likeness) of a text, by definition."""
    import re
    import struct

    from xxhash import xxh64_intdigest

    seeded = lambda n, x: xxh64_intdigest(x.encode(), xxh64_intdigest(struct.pack("<i", n), 42))
    dense, runs, counts = [0] * 16, 0, [0] * 128
    for line in text.split("\n"):
        for seed in range(8):
            h = seeded(seed, line)
            dense[2 * seed] = (dense[2 * seed] + h) % 2**32
            dense[2 * seed + 1] = (dense[2 * seed + 1] + (h >> 32)) % 2**32
        words = [m.span() for m in re.finditer(r"[^ \t-\r]+", line)]
        for k in range(len(words)):
            run = line[words[k][0] : words[min(k + 2, len(words) - 1)][1]]
            runs += 1
            for half, h in enumerate((xxh64_intdigest(run.encode(), 42), seeded(1, run))):
                for bit in range(64):
                    counts[64 * (bit // 32) + 32 * half + bit % 32] += h >> bit & 1
    return dense, runs % 65536, [c % 65536 for c in counts]


def _likeness(v, w):
    if v == w:
        return 1.0
    a, b = ([(2 * c - x[1] + 32768) % 65536 - 32768 for c in x[2]] for x in (v, w))
    size = math.sqrt(sum(x * x for x in a) * sum(x * x for x in b))
    return max(0.0, min(0.999999, sum(x * y for x, y in zip(a, b)) / size)) if size else 0.0


def test_fingerprints_by_brute_force(spark, sf_dir, corpus):
    """Fingerprints, those of the edited texts, and both likenesses, from the texts by definition."""
    hexed = lambda v: "".join(f"{x:08x}" for x in v[0]) + ":" + f"{v[1]:04x}" + "".join(f"{x:04x}" for x in v[2])
    rows = {(r["doc_id"], r["n_chars"]): r for r in multiset.op10_fingerprints(spark, sf_dir).collect()}
    own = sorted((d for d in set((d[0], d[1] or "") for d in corpus) if d[0] != 5), key=lambda d: (d[0] is not None, d[0] or 0))
    vectors = [_vector(t) for _, t in own]
    for k, (i, t) in enumerate(own):
        r, (j, u) = rows[i, len(t)], own[(k + 1) % len(own)]
        assert r["fingerprint"] == hexed(vectors[k])
        if i == 4 or j == 6:
            continue  # the neighbour shares an id with others
        q = len(t) // 4
        edited = _vector(t[: len(t) - q] + u[:q])
        assert r["edited_fingerprint"] == hexed(edited) and abs(r["near_edited"] - _likeness(vectors[k], edited)) < 1e-9
        assert abs(r["near_next"] - _likeness(vectors[k], vectors[(k + 1) % len(own)])) < 1e-9


def test_paragraphs_are_put_in_and_taken_out(spark):
    rows = [("a", "one two\nthree\nfour five six"), ("b", "three"), ("c", "one two\nfour five six"), ("d", "three\nthree"), ("e", "three\nthree\nfour five six\none two")]
    v = multiset.vectors(spark.createDataFrame(rows, "k string, text string"), ["k"]).groupBy().pivot("k", list("abcde")).agg(F.first("vector"))
    same = v.select(
        (multiset.deleted(F.col("a"), F.col("b")) == F.col("c")).alias("out"), (multiset.inserted(F.col("c"), F.col("b")) == F.col("a")).alias("back"),
        (multiset.inserted(F.col("d"), F.col("c")) == F.col("e")).alias("order"), (multiset.deleted(multiset.deleted(F.col("e"), F.col("b")), F.col("b")) == F.col("c")).alias("twice"),
    ).first()
    assert all(same)


def test_multiset_is_a_sum(spark):
    rows = [("a", "one two three\nfour five"), ("b", "four five\none two three"), ("c", "one two three"), ("d", "four five"), ("e", "one two three\nfour six")]
    v = {r["k"]: r["vector"] for r in multiset.vectors(spark.createDataFrame(rows, "k string, text string"), ["k"]).collect()}
    assert v["a"] == v["b"] != v["e"]
    for part, size in (("dense", 32), ("counts", 16)):
        assert all((x + y - z) % (1 << size) == 0 for x, y, z in zip(v["c"][part], v["d"][part], v["a"][part]))


def test_likeness_after_a_shift(spark):
    """A word put before a long line, or left out of it, leaves nearly all its runs; the runs are those of brute force."""
    words = [f"w{k}" for k in range(300)]
    texts = {"whole": " ".join(words), "before": " ".join(["new", *words]), "without": " ".join(words[:30] + words[31:]), "other": " ".join(f"v{k}" for k in range(300)), "odd": " a  b\tc\r\n\nd e\n"}
    v = multiset.vectors(spark.createDataFrame(list(texts.items()), "k string, text string"), ["k"])
    assert {r["k"]: r["n"] for r in v.select("k", F.col("vector.runs").alias("n")).collect()} == {"whole": 300, "before": 301, "without": 299, "other": 300, "odd": 5}
    pairs = v.where("k = 'whole'").select(F.col("vector").alias("own")).crossJoin(v)
    near = {r["k"]: r["l"] for r in pairs.select("k", multiset.likeness(F.col("own"), F.col("vector")).alias("l")).collect()}
    assert near["whole"] == 1 and near["before"] > 0.9 and near["without"] > 0.9 and near["other"] < 0.4
    got = spark.createDataFrame([(texts["odd"],)], "t string").select(F.regexp_extract_all("t", F.lit(multiset.RUNS), F.lit(1))).first()[0]
    assert got == ["a  b\tc", "b\tc", "c", "d e", "e"]


def _stage_languages(spark, rows, frame):
    held = {(r["doc_id"], r["text"]): r["h"] for r in frame.select("doc_id", "text", lang_id.is_calibration(F.col("doc_id"), F.col("text")).alias("h")).collect()}
    train = [r for r in rows if r["lang"] is not None and r["text"] is not None and (r["doc_id"] is None or zlib.crc32(str(r["doc_id"]).encode()) % 5)]
    models = _kneser_ney([(r["lang"], r["text"]) for r in train if not held[r["doc_id"], r["text"]]])
    best = lambda r: min(e.values()) if (e := _entropies(models, r["text"])) else None
    limit = lang_id.MARGIN * max(x for r in train if held[r["doc_id"], r["text"]] and (x := best(r)) is not None)  # below 1,000 documents the quantile is the highest
    return [r for r in rows if (x := best(r)) is not None and x <= limit]


def _place(r):
    return (r["doc_id"] is not None, r["doc_id"] or 0)


def _stage_lines(rows):
    seen, out = [], []
    for r in sorted(rows, key=_place):
        kept = []
        for line in (r["text"] or "").split("\n"):
            w = frozenset(line.encode().split())
            if not w or not any(5 * len(w & y) >= 4 * len(w | y) for y in seen):
                kept.append(line)
            if w:
                seen.append(w)
        text = "\n".join(kept)
        if text.encode().split():
            out.append({**r, "text": text, "n_chars": len(text)})
    return out


def _stage_near(rows):
    fps = [simhash.fingerprint((r["text"] or "").encode(), 5) for r in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= simhash.STAGE_DISTANCE and root[i] != root[j]:
                old, new = root[i], root[j]
                root = [new if x == old else x for x in root]
    return {tuple(sorted({_place(rows[i]) for i in range(len(rows)) if root[i] == k})) for k in set(root)}


def _stage_mixing(rows):
    """(doc_id, text) as often as the mix takes them, in order of slots, from the definition of the schedule."""
    size = lambda r: len((r["text"] or "").encode().split())
    sources = sorted({r["source"] for r in rows if r["source"] is not None}) + [None] * any(r["source"] is None for r in rows)
    own = {s: [r for r in rows if r["source"] == s] for s in sources}
    total = {s: sum(map(size, own[s])) for s in sources}
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sources)}
    free, left, quota = set(sources), sum(total.values()), {}
    while free:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if level * weight[s] > 3 * total[s]}
        quota |= {s: 3 * total[s] for s in full} if full else {s: math.floor(level * weight[s] + 0.5) for s in free}
        left, free = left - sum(3 * total[s] for s in full), free - full if full else set()
    block, words = mixing.BLOCK, sum(quota.values())
    slots = {s: [] for s in sources}
    n = -(-words // block)
    for slot in range(n):
        u, run = slot * mixing.GOLDEN + 0.5, 0
        u -= math.floor(u)
        for s in sources:
            run += quota[s]
            if u < run / words or run == words:
                slots[s].append(slot)
                break
    for s in sources:
        slots[s] += [n + k for k in range(len(slots[s]), -(-quota[s] // block))]
    out = []
    for s in sources:
        at, order = 0, sorted(own[s], key=lambda r: (hashlib.md5((str(r["doc_id"]) if r["doc_id"] is not None else "text " + (r["text"] or "")).encode()).hexdigest(), r["doc_id"] or 0, size(r)))
        while at < quota[s]:
            for r in order:
                if at >= quota[s]:
                    break
                if size(r) and 2 * (min(at + size(r), quota[s]) - at) >= size(r):
                    out.append((slots[s][at // block], r["doc_id"], r["text"]))
                at += size(r)
    return sorted(out, key=lambda x: (x[0], x[1] is not None, x[1] or 0))


def test_pipeline(spark, sf_dir, corpus):
    """Every stage against a version of it made from its definition, on all that the stage before it kept."""
    import corpus_pipeline

    frame = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id is null or doc_id <> 5")  # of rows that share an id the order is a hash's
    made = []
    for name, stage in corpus_pipeline.STAGES[:4]:
        path = token_store.fresh_path(spark, f"test-{name}")
        stage(spark, frame, sf_dir).write.parquet(path)
        after = spark.read.parquet(path)
        assert after.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        before, rows = [r.asDict() for r in frame.collect()], [r.asDict() for r in after.collect()]
        full = lambda rs: sorted(map(repr, ([r[c] for c in after.columns] for r in rs)))
        if name == "language_id":
            assert full(rows) == full(_stage_languages(spark, before, frame)) and len(rows) < len(before)
        elif name == "line_dedup":
            assert full(rows) == full(_stage_lines(before))
        elif name == "near_dedup":
            assert sorted(map(_place, rows)) == sorted(group[0] for group in _stage_near(before)) and set(full(rows)) <= set(full(before))
        else:
            want = _stage_mixing(before)
            assert sorted((r["doc_id"] or -1, r["text"]) for r in rows) == sorted((i or -1, t) for _, i, t in want)
        frame = after
        made.append(rows)
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "ids", "lossless", "n_pieces"] and len(corpus_pipeline.STAGES) == 5
    rows = out.collect()
    v = pieces.vocabulary(pieces.default_model())
    seeds = {r["doc_id"]: r["s"] for r in out.select("doc_id", F.xxhash64(F.lit(0), "doc_id").alias("s")).collect()}
    ids, stops = pieces.sample(v, [r["text"] for r in rows], np.array([seeds[r["doc_id"]] for r in rows], np.int64).view(np.uint64))
    assert rows and all(r["lossless"] and r["n_pieces"] == len(r["ids"]) and r["ids"] == ids[a:b].tolist() for r, a, b in zip(rows, [0, *stops[:-1]], stops))


def test_the_mix_lies_in_the_order_of_its_slots(spark, docs):
    rows = [r.asDict() for r in mixing.mixed_documents(docs.where("doc_id <> 5").dropDuplicates()).collect()]
    want = _stage_mixing([r.asDict() for r in docs.where("doc_id <> 5").dropDuplicates().collect()])
    slots = {}
    for slot, i, t in want:
        slots.setdefault((i, t), []).append(slot)
    at = [slots[r["doc_id"], r["text"]].pop(0) for r in rows]
    assert at == sorted(at) and not any(slots.values())


CLASHING = ["score", "lang_pred", "cross_entropy", "_removed", "removed", "_t", "_th", "_id", "_times", "ids", "_seed", "seed", "media_info", "c0", "c7", "k", "r", "rank", "at", "size", "Text2", "lossless", "slot", "fp"]


def clashing(docs):
    """docs with columns of the names that operators use, of several types, which must come through as they are."""
    for i, c in enumerate(CLASHING):
        docs = docs.withColumn(c, F.concat(F.lit(f"{c} "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))) if i % 2 else F.col("doc_id") + i)
    return docs


def same_rows(got, docs, but=()):
    """Whether all rows of got are rows of docs, columns of `but` left out."""
    own = [c for c in docs.columns if c not in but]
    return got.select(own).subtract(docs.select(own)).isEmpty()


def test_columns_of_clashing_names_come_through(spark, docs):
    odd = clashing(docs)
    for f, but in ((lang_id.reject_languages, ()), (line_dedup.dedup_lines, ("text",)), (simhash.keep_one, ()), (mixing.mixed_documents, ())):
        got = f(odd)
        assert got.columns == odd.columns and got.count() > 0 and same_rows(got, odd, but)
        assert sorted(map(repr, f(docs).select("doc_id").collect())) == sorted(map(repr, got.select("doc_id").collect()))
    got = pieces.encode_sampled(odd, check="lossless")
    assert got.columns == [*odd.columns, "ids_", "lossless_"] and same_rows(got, odd)
    back = pieces.decoded(got, ids="ids_", text="size")
    assert back.columns[-1] == "size_" and back.where("not (size_ <=> text)").isEmpty()
    stored = media.store_payloads(odd).join(odd, "doc_id")
    got = media.media_columns(stored)
    assert got.columns == [*stored.columns, "media_info_"] and got.where("media_info_.codec is null").isEmpty()
    urls = odd.select(F.lit("http://a.org/x").alias("url"), "score", F.lit(1).alias("Host"), "_at" if "_at" in odd.columns else "at")
    assert url_filter.judge(urls).columns == [*urls.columns, "host_", "path", "rule", "verdict", "score_"]


def test_stages_of_empty_tables(spark, empty):
    for f in (lang_id.reject_languages, line_dedup.dedup_lines, simhash.keep_one, mixing.mixed_documents, pieces.encode_sampled):
        got = f(empty)
        assert got.columns[: len(empty.columns)] == empty.columns and got.count() == 0


def test_rejection(spark, docs, corpus):
    """What goes has no letters or is above the threshold, which is that of documents left out of the counts; nonsense goes."""
    kept = {(r["doc_id"], r["text"]) for r in lang_id.reject_languages(docs).collect()}
    model, limit = lang_id.train_with_threshold(lang_id.training_rows(docs))
    judged = lang_id.predict(docs.withColumn("id", F.col("doc_id")), model, ["id", "text"]).collect()
    assert kept == {(r["id"], r["text"]) for r in judged if r["lang_pred"] != "und" and r["cross_entropy"] <= limit} and 0 < limit < 100
    assert not {(70, "12 34 !!"), (67, None), (68, "")} & kept
    words = "the cat and the dog sat on the mat with some friends of theirs".split()
    many = spark.range(600).select(F.col("id").alias("doc_id"), F.concat_ws(" ", *[F.element_at(F.array(*map(F.lit, words)), (F.pmod(F.xxhash64("id", F.lit(k)), F.lit(len(words))) + 1).cast("int")) for k in range(30)]).alias("text"), F.lit("en").alias("lang"))
    odd = spark.createDataFrame([(1000, "ξψωφ ζηθκ λμνπ", None), (1001, "qzxv kjwq vxzj qqzz", None)], "doc_id long, text string, lang string")
    left = {r["doc_id"] for r in lang_id.reject_languages(many.unionByName(odd)).collect()}
    assert left == set(range(600))


def _kneser_ney(texts):
    """log p(last character | those before) of 4-grams in each language, from texts (lang, text) by definition."""
    from collections import Counter, defaultdict

    edge = chr(lang_id.EDGE)
    words = [(lang, w) for lang, t in texts for w in "".join(c if c.isalpha() else " " for c in t.lower()).split()]
    alphabet = len({c for _, w in words for c in w} | {edge}) + 1

    def p(counts, discount, context, g):
        k = len(g)
        if not k:
            return 1 / alphabet
        total, types = context[k].get(g[:-1], (0, 0))
        low = p(counts, discount, context, g[1:])
        return max(counts[k][g] - discount[k], 0) / total + discount[k] * types / total * low if total else low

    out = {}
    for lang in sorted({lang for lang, _ in texts}):
        counts = {4: Counter()}
        for of, w in words:
            if of == lang:
                padded = edge * 3 + w + edge
                counts[4].update(padded[i : i + 4] for i in range(len(padded) - 3))
        for k in (3, 2, 1):
            counts[k] = Counter(g[1:] for g in counts[k + 1])
        discount, context = {}, {}
        for k, c in counts.items():
            n1, n2 = (sum(v == x for v in c.values()) for x in (1, 2))
            discount[k] = max(0.1, min(0.95, n1 / (n1 + 2 * n2))) if n1 else 0.1
            context[k] = defaultdict(lambda: [0, 0])
            for g, v in c.items():
                context[k][g[:-1]][0] += v
                context[k][g[:-1]][1] += 1

        out[lang] = functools.partial(p, counts, discount, context)
    return out


def _entropies(models, text):
    """Cross-entropy a character of a text in each language; None without letters."""
    edge = chr(lang_id.EDGE)
    grams = [p[i : i + 4] for w in "".join(c if c.isalpha() else " " for c in (text or "").lower()).split() for p in [edge * 3 + w + edge] for i in range(len(p) - 3)]
    return {lang: -sum(math.log(p(g)) for g in grams) / len(grams) for lang, p in models.items()} if grams else None


def test_kneser_ney_by_brute_force(spark):
    """Probabilities of the model against interpolated Kneser-Ney made from the texts by its definition."""
    rng = np.random.default_rng(8)
    rows = [(lang, " ".join("".join(rng.choice(list(letters), rng.integers(1, 7))) for _ in range(rng.integers(1, 8)))) for lang, letters in (("aa", "abcde"), ("bb", "cdefü")) for _ in range(40)]
    model, want = lang_id.train_model(spark.createDataFrame(rows, "lang string, text string")), _kneser_ney(rows)
    edge = chr(lang_id.EDGE)
    letters = sorted({c for _, t in rows for c in t if c != " "} | {edge})
    grams = ["".join(rng.choice(letters, 4)) for _ in range(200)] + [edge * 3 + "c", "z" * 4]
    coded = np.array([sum(ord(c) << 16 * (3 - i) for i, c in enumerate(g)) for g in grams], np.uint64)
    for j, lang in enumerate(model.langs):
        assert np.allclose(model.log_prob(coded)[:, j], [math.log(want[lang](g)) for g in grams], atol=1e-4)


def test_long_texts_without_spaces(spark):
    """Units whose parts are long, and those of letters without pieces, in batches and alone: the same pieces, without loss."""
    v = pieces.vocabulary(pieces.default_model())
    rng = np.random.default_rng(0)
    texts = ["x" * 5000, "".join(map(chr, rng.integers(0x4E00, 0x9FFF, 3000))), "".join(rng.choice(list("etaoinshr"), 4000)), "the " * 30 + "e" * 200, "an" * 100]
    seeds = np.arange(5, dtype=np.uint64)
    ids, stops = pieces.sample(v, texts, seeds)
    assert pieces.decode_all(v, ids.astype(np.int64), stops) == texts
    for k, (a, b) in enumerate(zip([0, *stops[:-1]], stops)):
        alone, _ = pieces.sample(v, [texts[k]], seeds[k : k + 1])
        assert (alone == ids[a:b]).all()
    many = [t for t in texts[3:] for _ in range(40)]  # so many that all are drawn side by side
    ids, stops = pieces.sample(v, many, np.repeat(seeds[3:], 40))
    alone, end = pieces.sample(v, texts[4:], seeds[4:])
    assert (ids[stops[-2] : stops[-1]] == alone).all()


def test_forward_sums_of_long_parts():
    """Chances beyond LONG characters of a part are those of the sums by definition."""
    v = pieces.vocabulary(pieces.default_model())
    units = np.array([ord(c) for c in " " + "the" * 60], np.uint32)
    lattice = pieces.Lattice(v, units, np.array([0]), np.array([len(units)]), 1.0)
    text, sums = " " + "the" * 60, [1.0]
    rank = {v.bytes_of[v.piece[k]].decode(): v.rank[k] for k in range(1, len(v.piece)) if v.piece[k] >= 0}
    for end in range(1, len(text) + 1):
        ways = [(n, sums[end - n] / (rank[text[end - n : end]] + pieces.OFFSET)) for n in range(1, min(end, 20) + 1) if text[end - n : end] in rank]
        total = sum(w for _, w in ways)
        a, b = lattice.first[end - 1], lattice.first[end]
        assert lattice.length[a:b].tolist() == [n for n, _ in ways]
        assert np.allclose(lattice.chance[a:b], np.cumsum([w / total for _, w in ways]))
        sums.append(total)
        sums = [x * 1e3 for x in sums] if total < 1e-200 else sums


def test_media_columns_by_brute_force(spark, sf_dir, corpus):
    """feature, media_bytes and media_sha256 from a container that is read byte by byte here, and the keyframes' bytes."""
    import struct

    def find(data, path):
        a, b = 0, len(data)
        for kind in path:
            at = a
            while data[at + 4 : at + 8] != kind:
                at += struct.unpack(">I", data[at : at + 4])[0]
            a, b = at + 8, at + struct.unpack(">I", data[at : at + 4])[0]
        return data[a:b]

    rows = media.op1_media_columns(spark, sf_dir).collect()
    files = {(r["doc_id"], r["n_bytes"]): bytes(r["media"]) for r in media.store_payloads(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect()}
    assert len(rows) == len(corpus)
    for r in rows:
        data = files[r["doc_id"], r["n_bytes"]]
        assert (r["media_bytes"], r["media_sha256"]) == (len(data), hashlib.sha256(data).hexdigest())
        stbl = [b"moov", b"trak", b"mdia", b"minf", b"stbl"]
        each, n = struct.unpack(">II", find(data, [*stbl, b"stsz"])[4:12])
        keys = struct.unpack(f">{struct.unpack('>I', find(data, [*stbl, b'stss'])[4:8])[0]}I", find(data, [*stbl, b"stss"])[8:])
        first = struct.unpack(">I", find(data, [*stbl, b"stco"])[8:12])[0]
        ranges = [(first + each * (k - 1), each) for k in keys]  # chunks lie one after the other
        said = ",".join(f"{a}+{b}" for a, b in ranges)
        assert r["feature"] == f"codec=raw;seconds={each * n / 8000:.6f};samples={n};keyframes={len(keys)};ranges={zlib.crc32(said.encode()):08x}"
        assert [tuple(k) for k in r["media_info"]["keyframes"]] == ranges and each * n == r["payload_bytes"]
        assert data[first : first + r["n_bytes"]][:40] == data[data.index(b"mdat") + 4 :][: min(40, r["n_bytes"])]
