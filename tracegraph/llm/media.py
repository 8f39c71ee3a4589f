"""Media columns: ISO base media files as binary values, read without decoding their payloads.

`mux` stores samples of 8-bit PCM in an ISO container; `describe` walks the nested boxes of any such
file and decodes the sample tables of each track to codec, duration and the byte ranges of its
keyframes. Payload bytes are only addressed, never interpreted.

Defined results: a null payload counts as empty; an empty payload is stored as one padded block; bytes
that are not a readable container give a null description with a reason; an empty table gives no rows; a text is stored whole,
however long (up to 2 GB, which a value can have); other columns pass untouched, and where one is called media_info, the new one
gets underscores after its name.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ._common import Sealed, documents, pieces_of

BLOCK = 576  # bytes in a stored sample
PAD = b"\xff"
SAMPLE_RATE = 8000
KEY_EVERY = 16  # each so many samples, one is marked as a sync sample
_CHUNK = 64  # samples in a chunk
#: Boxes that hold only boxes.
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"dinf", b"stbl", b"edts", b"udta", b"mvex"}
_MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


class Malformed(ValueError):
    """The bytes are not a container that can be described."""


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind) + body


def _full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", version << 24 | flags), *parts)


def pad(payload: bytes, block: int = BLOCK) -> bytes:
    return payload + PAD * (-len(payload) % block or (0 if payload else block))


def mux(payload: bytes, block: int = BLOCK) -> bytes:
    """payload, a positive multiple of block bytes, as one track of 8-bit samples. Equal payloads give equal files."""
    n = len(payload) // block
    if not n or len(payload) % block:
        raise ValueError(f"the payload must be a positive multiple of {block} bytes")
    chunks = -(-n // _CHUNK)
    length = n * block
    entry = _box(b"raw ", struct.pack(">6xH8xHHHHI", 1, 1, 8, 0, 0, SAMPLE_RATE << 16))
    runs = struct.pack(">3I", 1, min(n, _CHUNK), 1)
    if n > _CHUNK and n % _CHUNK:
        runs += struct.pack(">3I", chunks, n % _CHUNK, 1)
    keys = range(1, n + 1, KEY_EVERY)
    head = _box(b"ftyp", b"isom", struct.pack(">I", 0x200), b"isomiso2mp41")

    def moov(first: int) -> bytes:
        wide = first + length > 0xFFFFFFFF
        at = [first + k * _CHUNK * block for k in range(chunks)]
        table = _full(
            b"co64" if wide else b"stco", struct.pack(f">I{chunks}{'Q' if wide else 'I'}", chunks, *at)
        )
        stbl = _box(
            b"stbl",
            _full(b"stsd", struct.pack(">I", 1), entry),
            _full(b"stts", struct.pack(">3I", 1, n, block)),
            _full(b"stsc", struct.pack(">I", len(runs) // 12), runs),
            _full(b"stsz", struct.pack(">2I", block, n)),
            _full(b"stss", struct.pack(f">I{len(keys)}I", len(keys), *keys)),
            table,
        )
        dinf = _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1)))
        minf = _box(b"minf", _full(b"smhd", bytes(4)), dinf, stbl)
        mdia = _box(
            b"mdia",
            _full(b"mdhd", struct.pack(">QQIQHH", 0, 0, SAMPLE_RATE, length, 0x55C4, 0), version=1),
            _full(b"hdlr", struct.pack(">I4s12x", 0, b"soun"), b"sound\0"),
            minf,
        )
        tkhd = _full(
            b"tkhd", struct.pack(">QQIIQ8xHHHH", 0, 0, 1, 0, length, 0, 0, 0x100, 0), _MATRIX, bytes(8), version=1, flags=7
        )
        mvhd = _full(
            b"mvhd", struct.pack(">QQIQIH10x", 0, 0, SAMPLE_RATE, length, 0x10000, 0x100), _MATRIX, bytes(24), struct.pack(">I", 2), version=1
        )
        return _box(b"moov", mvhd, _box(b"trak", tkhd, mdia))

    size = len(moov(0))
    if len(head) + size + 16 + length > 0xFFFFFFFF:
        size = len(moov(0xFFFFFFFF))
    wide = length + 8 > 0xFFFFFFFF
    data = struct.pack(">I4sQ", 1, b"mdat", 16 + length) if wide else struct.pack(">I4s", 8 + length, b"mdat")
    return b"".join((head, moov(len(head) + size + len(data)), data, payload))


def boxes(data: memoryview, start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(kind, first byte of the body, end) of each box between start and end; 64-bit and open sizes too."""
    while start < end:
        if end - start < 8:
            raise Malformed("a box header is cut off")
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1:
            if end - start < 16:
                raise Malformed("a box header is cut off")
            (size,) = struct.unpack_from(">Q", data, body)
            body += 8
        elif size == 0:
            size = end - start
        if kind == b"uuid":
            body += 16
        if start + size > end or body > start + size:
            raise Malformed(f"box {kind!r} leaves its parent")
        yield kind, body, start + size
        start += size


def tree(data: memoryview, start: int = 0, end: int | None = None, path: str = "", depth: int = 0):
    """(path, first, end) of all boxes, nested ones after their parent."""
    if depth > 16:
        raise Malformed("boxes are nested too deeply")
    for kind, a, b in boxes(data, start, len(data) if end is None else end):
        name = f"{path}/{kind.decode('latin-1')}"
        yield name, a, b
        if kind in CONTAINERS:
            yield from tree(data, a, b, name, depth + 1)


def _entries(data: memoryview, a: int, b: int, width: str, before: int = 4) -> list[tuple]:
    (n,) = struct.unpack_from(">I", data, a + before)
    step = struct.calcsize(">" + width)
    if a + before + 4 + n * step > b:
        raise Malformed("a table leaves its box")
    return [struct.unpack_from(">" + width, data, a + before + 4 + i * step) for i in range(n)]


def _track(data: memoryview, start: int, end: int) -> dict:
    found = {name: (a, b) for name, a, b in tree(data, start, end)}
    stbl = "/mdia/minf/stbl"
    for need in ("/mdia/mdhd", f"{stbl}/stsd", f"{stbl}/stts", f"{stbl}/stsc"):
        if need not in found:
            raise Malformed(f"{need} is missing")
    a, _ = found["/mdia/mdhd"]
    rate, ticks = struct.unpack_from(">IQ", data, a + 20) if data[a] == 1 else struct.unpack_from(">II", data, a + 12)
    a, b = found[f"{stbl}/stsd"]
    codec = next((kind for kind, _, _ in boxes(data, a + 8, b)), b"????")
    times = _entries(data, *found[f"{stbl}/stts"], "II")
    runs = _entries(data, *found[f"{stbl}/stsc"], "III")
    if f"{stbl}/stsz" in found:
        a, b = found[f"{stbl}/stsz"]
        each, count = struct.unpack_from(">II", data, a + 4)
        sizes = [each] * count if each else [x[0] for x in _entries(data, a, b, "I", before=8)]
    elif f"{stbl}/stz2" in found:
        a, b = found[f"{stbl}/stz2"]
        bits, count = data[a + 7], struct.unpack_from(">I", data, a + 8)[0]
        if bits == 4:
            sizes = [data[a + 12 + i // 2] >> (0 if i % 2 else 4) & 15 for i in range(count)]
        else:
            sizes = [x[0] for x in _entries(data, a, b, {8: "B", 16: "H"}[bits], before=8)]
    else:
        raise Malformed("the sample sizes are missing")
    if f"{stbl}/stco" in found:
        chunks = [x[0] for x in _entries(data, *found[f"{stbl}/stco"], "I")]
    elif f"{stbl}/co64" in found:
        chunks = [x[0] for x in _entries(data, *found[f"{stbl}/co64"], "Q")]
    else:
        raise Malformed("the chunk offsets are missing")
    keys = {x[0] for x in _entries(data, *found[f"{stbl}/stss"], "I")} if f"{stbl}/stss" in found else None
    ranges, at = [], 0
    for k, (first, per, _) in enumerate(runs):
        last = runs[k + 1][0] if k + 1 < len(runs) else len(chunks) + 1
        for chunk in range(first - 1, min(last - 1, len(chunks))):
            place = chunks[chunk]
            for _ in range(per):
                if at == len(sizes):
                    break
                if place + sizes[at] > len(data):
                    raise Malformed("a sample leaves the file")
                ranges.append((place, sizes[at]))
                place, at = place + sizes[at], at + 1
    if at != len(sizes) or sum(x[0] for x in times) != at:
        raise Malformed("the sample tables disagree")
    return {
        "codec": codec.decode("latin-1"),
        "timescale": rate,
        "duration": ticks,
        "samples": ranges,
        "keyframes": [r for i, r in enumerate(ranges, 1) if keys is None or i in keys],
    }


def describe(media: bytes) -> list[dict]:
    """One dict per track: codec, timescale, duration in its ticks, byte ranges of samples and keyframes."""
    data = memoryview(media)
    try:
        tracks = [(a, b) for name, a, b in tree(data) if name == "/moov/trak"]
        if not tracks:
            raise Malformed("there is no track")
        return [_track(data, a, b) for a, b in tracks]
    except (struct.error, IndexError, KeyError) as error:
        raise Malformed(str(error)) from error


def payload_of(media: bytes, track: dict) -> bytes:
    """The stored bytes of a track's samples; neighbouring samples are read at once."""
    parts, start, end = [], None, None
    for place, size in track["samples"]:
        if place != end:
            if start is not None:
                parts.append(media[start:end])
            start = end = place
        end += size
    parts.append(media[start:end] if start is not None else b"")
    return b"".join(parts)


STORED = "n_bytes long, media binary"


def store_payloads(df: DataFrame, key: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """(key, n_bytes, media): each whole text's UTF-8 bytes, padded to blocks, as an ISO media file."""
    schema = StructType().add("key", df.schema[key].dataType).add("n_bytes", "long").add("media", "binary")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part in pieces_of(batch, name="b"):
                raw = [x.as_buffer().to_pybytes() if x.is_valid else b"" for x in part.column("b")]
                media = pa.array([mux(pad(x, block), block) for x in raw], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array([len(x) for x in raw], pa.int64()), media], ["key", "n_bytes", "media"])

    return df.select(F.col(key).alias("key"), F.col(text).cast("binary").alias("b")).mapInArrow(run, schema).withColumnRenamed("key", key)


def media_columns(df: DataFrame, media: str = "media") -> DataFrame:
    """df with a struct `media_info` (see MEDIA_TYPE) of the first track of each file; null for a null file."""
    seal = Sealed(df)
    schema = StructType(list(seal.df.schema.fields)).add("info", StructType.fromDDL(MEDIA_TYPE))
    info_type = to_arrow_schema(schema).field("info").type
    media = seal[media]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part in pieces_of(batch, name=media):
                yield part.append_column("info", pa.array([info_of(x.as_buffer().to_pybytes()) if x.is_valid else None for x in part.column(media)], info_type))

    return seal.opened(seal.df.mapInArrow(run, schema), media_info="info")


def info_of(media: bytes) -> dict:
    """The media columns of a file, by name."""
    try:
        t = describe(media)[0]
    except Malformed as error:
        return {"problem": str(error)}
    return {
        "codec": t["codec"], "duration_s": t["duration"] / t["timescale"] if t["timescale"] else None, "timescale": t["timescale"], "n_samples": len(t["samples"]),
        "n_keyframes": len(t["keyframes"]), "keyframes": [{"offset": a, "size": n} for a, n in t["keyframes"]], "problem": None,
    }


MEDIA_TYPE = (
    "codec string, duration_s double, timescale bigint, n_samples bigint, n_keyframes bigint, "
    "keyframes array<struct<offset: bigint, size: bigint>>, problem string"
)


def op1_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document through a container and back: sizes and hashes of what was read, its features and its media columns.

    feature: codec, duration in seconds, samples, keyframes, and a CRC of the keyframes' byte ranges, all from media_info.
    """
    stored = media_columns(store_payloads(documents(spark, sf_dir)))
    info_type = stored.schema["media_info"].dataType
    columns = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    names = [c.split()[0] for c in columns.split(", ")]
    schema = StructType.fromDDL(columns).add("media_info", info_type)

    def read(batches):
        import pyarrow as pa

        for batch in batches:
            for part in pieces_of(batch, name="media"):
                rows = []
                for media, info in zip(part.column("media"), part.column("media_info").to_pylist()):
                    media = media.as_buffer().to_pybytes()
                    payload = payload_of(media, describe(media)[0])
                    ranges = ",".join(f"{k['offset']}+{k['size']}" for k in info["keyframes"])
                    rows.append(
                        (
                            len(payload),
                            hashlib.sha256(payload).hexdigest(),
                            zlib.crc32(payload[-32:]),
                            len(media),
                            hashlib.sha256(media).hexdigest(),
                            f"codec={info['codec'].strip()};seconds={info['duration_s']:.6f};samples={info['n_samples']};"
                            f"keyframes={info['n_keyframes']};ranges={zlib.crc32(ranges.encode()):08x}",
                        )
                    )
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
                made = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("n_bytes"), *made, part.column("media_info")], [*names, "media_info"])

    return stored.mapInArrow(read, schema)
