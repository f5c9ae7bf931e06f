"""Media columns: texts' bytes stored as 8-bit samples in ISO media containers, and containers read by their boxes.

`store_media` writes a binary column with one container (ftyp, moov, mdat) per row; `read_media` walks the nested boxes,
decodes the sample tables (stts, stss, stsc, stsz, stco or co64) of the first track that has them and gives codec,
duration and every keyframe's byte range from them; samples are located by the tables and never decoded.

Defined cases: a null text is empty, an empty one is a single block of spaces; rows repeated with one id give equal rows;
boxes may be nested to any depth; a container that breaks off, has no track with sample tables, or whose tables contradict each other, their boxes or the
file's size gives nulls (`parse`): no count is believed before its table is seen to fit its box.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from corpusmill.llm.shared import row_slices, utf8

#: Bytes of a sample, samples of a chunk, samples from one keyframe to the next, samples' clock ticks a second.
SAMPLE, CHUNK, KEY_EVERY, CLOCK = 192, 32, 16, 8_000
CODEC = b"raw "
#: Boxes that hold boxes.
NESTED = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts"}
STORED = "doc_id long, n_bytes long, media binary"
FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, codec string, duration_s double, n_keyframes long, first_key_offset long, first_key_bytes long, keyframes array<struct<offset:bigint,bytes:bigint>>"


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind) + body if len(body) < 2**32 - 8 else struct.pack(">I4sQ", 1, kind, 16 + len(body)) + body


def full(kind: bytes, *parts: bytes) -> bytes:
    return box(kind, bytes(4), *parts)


def container(payload: bytes) -> bytes:
    """A container of one sound track, whose samples are the payload's blocks of 192 bytes."""
    n = len(payload) // SAMPLE
    chunks, rest = divmod(n, CHUNK)
    runs = ([(1, CHUNK)] if chunks else []) + ([(chunks + 1, rest)] if rest else [])
    keys = np.arange(1, n + 1, KEY_EVERY, dtype=">u4")
    length = n * SAMPLE
    wide = length > 2**32 - 2**20

    def moov(first: int) -> bytes:
        at = first + np.arange(chunks + bool(rest), dtype=np.int64) * (CHUNK * SAMPLE)
        entry = struct.pack(">I4s6xH8xHHHHI", 36, CODEC, 1, 1, 8, 0, 0, CLOCK << 16)
        table = box(
            b"stbl", full(b"stsd", struct.pack(">I", 1), entry), full(b"stts", struct.pack(">III", 1, n, SAMPLE)), full(b"stss", struct.pack(">I", len(keys)), keys.tobytes()),
            full(b"stsc", struct.pack(">I", len(runs)), *[struct.pack(">III", a, b, 1) for a, b in runs]), full(b"stsz", struct.pack(">II", SAMPLE, n)),
            full(b"co64" if wide else b"stco", struct.pack(">I", len(at)), at.astype(">u8" if wide else ">u4").tobytes()),
        )
        head = full(b"mdhd", struct.pack(">IIIIHH", 0, 0, CLOCK, length & 0xFFFFFFFF, 0x55C4, 0))
        media = box(b"mdia", head, full(b"hdlr", struct.pack(">I4s12x", 0, b"soun"), b"samples\0"), box(b"minf", full(b"smhd", bytes(4)), table))
        unit = struct.pack(">9I", 1 << 16, 0, 0, 0, 1 << 16, 0, 0, 0, 1 << 30)
        movie = full(b"mvhd", struct.pack(">IIIIIH10x", 0, 0, CLOCK, length & 0xFFFFFFFF, 1 << 16, 1 << 8), unit, bytes(24), struct.pack(">I", 2))
        track = box(b"tkhd", struct.pack(">I", 3), struct.pack(">IIIII8xHHHH", 0, 0, 1, 0, length & 0xFFFFFFFF, 0, 0, 1 << 8, 0), unit, bytes(8))
        return box(b"moov", movie, box(b"trak", track, media))

    front = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2")
    size = len(front) + len(moov(0)) + (16 if wide else 8)
    return front + moov(size) + box(b"mdat", payload)


def walk(data: memoryview, start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(kind, start, end) of every box's body, nested ones after their holder."""
    ends = [end]  # of the boxes that hold this place
    while ends:
        if start + 8 > ends[-1]:
            start = ends.pop()
            continue
        size, kind = struct.unpack_from(">I4s", data, start)
        head = 8
        if size == 1 and start + 16 <= ends[-1]:
            size, head = struct.unpack_from(">Q", data, start + 8)[0], 16
        size = size or ends[-1] - start
        if size < head or start + size > ends[-1]:  # the rest of the holder can't be read
            start = ends.pop()
            continue
        yield kind, start + head, start + size
        if kind in NESTED:
            ends.append(start + size)
            start += head
        else:
            start += size


def counted(data: memoryview, at: tuple[int, int], dtype: str, cols: int) -> np.ndarray:
    """Rows of a box that holds flags, a count and the rows; ValueError where they don't fit the box."""
    start, end = at
    if start + 8 > end:
        raise ValueError("no count")
    n = struct.unpack_from(">I", data, start + 4)[0]
    if n * cols * np.dtype(dtype).itemsize > end - start - 8:
        raise ValueError("a count beyond its box")
    out = np.frombuffer(data, dtype, n * cols, start + 8)
    if dtype == ">u8" and n and out.max() > len(data):
        raise ValueError("an offset beyond the file")
    return out.astype(np.int64).reshape(-1, cols)


def sample_sizes(data: memoryview, at: tuple[int, int], samples: int) -> np.ndarray:
    """Sizes of the samples, whose number must be that of the times' table."""
    start, end = at
    if start + 12 > end:
        raise ValueError("no sizes")
    one, n = struct.unpack_from(">II", data, start + 4)
    if n != samples or n > len(data) or not one and 4 * n > end - start - 12:
        raise ValueError("a number of sizes that can't be")
    return np.full(n, one, np.int64) if one else np.frombuffer(data, ">u4", n, start + 12).astype(np.int64)


def track(data: memoryview, at: dict[bytes, tuple[int, int]]) -> dict:
    """Codec, duration, samples' places and sizes and keyframes of one track; ValueError where its tables contradict each other."""
    ticks = counted(data, at[b"stts"], ">u4", 2)
    sizes = sample_sizes(data, at[b"stsz"], int(ticks[:, 0].sum()))
    n = len(sizes)
    offsets = (counted(data, at[b"co64"], ">u8", 1) if b"co64" in at else counted(data, at[b"stco"], ">u4", 1))[:, 0]
    runs = counted(data, at[b"stsc"], ">u4", 3)
    chunks = np.diff(np.append(runs[:, 0], len(offsets) + 1))
    if (chunks < 0).any() or len(runs) and runs[0, 0] != 1 or len(offsets) and not len(runs) or int((chunks * runs[:, 1]).sum()) != n:
        raise ValueError("chunks that don't hold the samples")
    per = np.repeat(runs[:, 1], chunks)  # samples of each chunk
    chunk = np.repeat(np.arange(len(per)), per)
    before = np.cumsum(sizes) - sizes
    first = np.cumsum(per) - per
    places = offsets[chunk] + before - before[first[chunk]] if n else np.zeros(0, np.int64)
    keys = counted(data, at[b"stss"], ">u4", 1)[:, 0] - 1 if b"stss" in at else np.arange(n)
    if n and (int((places + sizes).max()) > len(data)) or len(keys) and (keys.min() < 0 or keys.max() >= n):
        raise ValueError("samples beyond the file")
    start, end = at[b"mdhd"]
    wide = start + 4 <= end and data[start] == 1
    if start + (24 if wide else 16) > end or at[b"stsd"][0] + 16 > at[b"stsd"][1]:
        raise ValueError("a short header")
    clock = struct.unpack_from(">I", data, start + (20 if wide else 12))[0]
    codec = bytes(data[at[b"stsd"][0] + 12 : at[b"stsd"][0] + 16]).decode("latin-1")
    return {"codec": codec, "duration": int((ticks[:, 0] * ticks[:, 1]).sum()), "clock": clock, "places": places, "sizes": sizes, "keys": keys, "chunks": len(offsets)}


def parse(media: bytes) -> dict | None:
    """Codec, duration, samples' offsets and sizes, keyframes of the first track with sample tables; None where there is none or it is broken."""
    data, tracks = memoryview(media), []
    for kind, a, b in walk(data, 0, len(data)):
        if kind == b"trak":
            tracks.append({})
        elif tracks:
            tracks[-1].setdefault(kind, (a, b))
    for at in tracks:
        if {b"stsd", b"stts", b"stsc", b"stsz", b"mdhd"} <= at.keys() and {b"stco", b"co64"} & at.keys():
            try:
                return track(data, at)
            except ValueError:
                return None
    return None


def stored_bytes(media: bytes, found: dict) -> bytes:
    """The samples' bytes in order: neighbours are taken together."""
    p, s = found["places"], found["sizes"]
    cut = np.concatenate([[0], np.flatnonzero(p[1:] != p[:-1] + s[:-1]) + 1, [len(p)]]) if len(p) else np.array([0])
    return b"".join(media[p[a] : p[b - 1] + s[b - 1]] for a, b in zip(cut[:-1], cut[1:], strict=True))


def store_media(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes, media: each text's UTF-8 bytes, with spaces up to a positive multiple of 192, in a container."""

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, offsets = utf8(batch.column(1))
            for a, z in row_slices(offsets, 4 << 20):
                b = batch.slice(a, z - a)
                raw = [t.as_buffer().to_pybytes() if t.is_valid else b"" for t in b.column(1)]
                media = [container(r + b" " * (SAMPLE - len(r) if not r else -len(r) % SAMPLE)) for r in raw]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(r) for r in raw], pa.int64()), pa.array(media, pa.binary())], [key, "n_bytes", "media"])

    return docs.selectExpr(f"cast(`{key}` as long) as `{key}`", f"cast(`{text}` as string) as `{text}`").mapInArrow(job, STORED.replace("doc_id", f"`{key}`", 1))


def read_media(media: DataFrame, key: str = "doc_id") -> DataFrame:
    """Features of each container, from its boxes alone, and checks of the stored bytes."""

    def features(n: int, m: bytes | None) -> tuple:
        found = parse(m) if m is not None else None
        if found is None:
            return (n, *[None] * 12)
        payload = stored_bytes(m, found)
        tail = payload[len(payload) - min(16, len(payload)) :]
        seconds, keys = found["duration"] / found["clock"] if found["clock"] else None, found["keys"]
        frames = [{"offset": a, "bytes": k} for a, k in zip(found["places"][keys].tolist(), found["sizes"][keys].tolist(), strict=True)]
        first = (frames[0]["offset"], frames[0]["bytes"]) if frames else (None, None)
        said = f"codec={found['codec'].strip()};duration={found['duration']}/{found['clock']};samples={len(found['sizes'])};chunks={found['chunks']};keyframes={len(keys)};first_key={first[0]}+{first[1]}"
        return n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(tail), len(m), hashlib.sha256(m).hexdigest(), said, found["codec"], seconds, len(keys), *first, frames

    names = [x.split()[0] for x in FEATURES.split(", ")]

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("offset", pa.int64()), ("bytes", pa.int64())]))]
        for b in batches:
            rows = [features(n.as_py(), m.as_buffer().to_pybytes() if m.is_valid else None) for n, m in zip(b.column(1), b.column(2), strict=True)]
            cols = list(zip(*rows, strict=True)) or [[]] * 13
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], [key, *names[1:]])

    return media.select(key, "n_bytes", "media").mapInArrow(job, FEATURES.replace("doc_id", f"`{key}`", 1))
