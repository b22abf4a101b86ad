"""ISO media containers: writing lossless sample tracks, and reading boxes without decoding payloads.

``mux`` stores bytes as one track of 8-bit samples; ``probe`` walks the nested boxes of any ISO media file,
decodes the sample tables and returns codec, duration and the byte ranges of key frames; samples are
only located, never decoded. Numbers are big-endian throughout, as the format has them.
"""

from __future__ import annotations

import hashlib
import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .common import staged, table

#: Bytes a sample, and samples from one key frame to the next, in files that this module writes.
SAMPLE, KEY_EVERY, CHUNK = 64, 16, 256
RATE = 8000
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf", b"mvex", b"moof", b"traf"}
IDENTITY = struct.pack(">9i", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", len(body) + 8, kind) + body


def full(kind: bytes, *parts: bytes, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", flags), *parts)


def padded(text: bytes) -> bytes:
    return text + bytes(-len(text) % SAMPLE or SAMPLE * (not text))


def mux(payload: bytes) -> bytes:
    """A file of one raw track: samples of 64 bytes, 64 8-bit units each, key frames every 16 samples."""
    n = len(payload) // SAMPLE
    chunks = -(-n // CHUNK)
    runs = [(1, CHUNK)] * (n >= CHUNK) + [(chunks, n % CHUNK)] * (n % CHUNK > 0)
    keys = range(1, n + 1, KEY_EVERY)
    entry = box(b"raw ", bytes(6), struct.pack(">HIIHHHHI", 1, 0, 0, 1, 8, 0, 0, RATE << 16))
    head = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2mp41")

    def moov(offset: int) -> bytes:
        tables = box(
            b"stbl",
            full(b"stsd", struct.pack(">I", 1), entry),
            full(b"stts", struct.pack(">III", 1, n, SAMPLE)),
            full(b"stss", struct.pack(f">I{len(keys)}I", len(keys), *keys)),
            full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", first, per, 1) for first, per in runs)),
            full(b"stsz", struct.pack(">II", SAMPLE, n)),
            full(b"co64", struct.pack(f">I{chunks}Q", chunks, *(offset + i * CHUNK * SAMPLE for i in range(chunks)))),
        )
        media = box(
            b"mdia",
            full(b"mdhd", struct.pack(">IIIIHH", 0, 0, RATE, n * SAMPLE, 0x55C4, 0)),
            full(b"hdlr", struct.pack(">I4s12x", 0, b"soun"), b"bytes\0"),
            box(b"minf", full(b"smhd", bytes(4)), box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1))), tables),
        )
        track = full(b"tkhd", struct.pack(">IIIII8xHHHH", 0, 0, 1, 0, n * SAMPLE, 0, 0, 0x100, 0), IDENTITY, bytes(8), flags=3)
        movie = full(b"mvhd", struct.pack(">IIIIIH10x", 0, 0, RATE, n * SAMPLE, 0x10000, 0x100), IDENTITY, bytes(24), struct.pack(">I", 2))
        return box(b"moov", movie, box(b"trak", track, media))

    data = struct.pack(">I4sQ", 1, b"mdat", len(payload) + 16)
    index = moov(len(head) + len(moov(0)) + len(data))
    return b"".join((head, index, data, payload))


def boxes(data: memoryview, start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(kind, first byte of the body, end) of each box from ``start``; a size of 0 reaches to the end, 1
    says that 64 bits follow. A box that overruns its parent ends the walk."""
    while start + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1 and start + 16 <= end:
            (size,) = struct.unpack_from(">Q", data, body)
            body += 8
        elif size == 0:
            size = end - start
        if size < body - start or start + size > end:
            return
        yield kind, body, start + size
        start += size


def uint(data: memoryview, at: int, end: int, size: int = 4) -> int:
    """A number, 0 where the box is cut before it."""
    return int.from_bytes(data[at : at + size], "big") if at + size <= end else 0


def numbers(data: memoryview, at: int, end: int, kind: str, per: int = 1) -> np.ndarray:
    """A table: a 32-bit count, then so many entries; cut where the box ends."""
    dtype = np.dtype(kind)
    n = max(0, min(uint(data, at, end), (end - at - 4) // (dtype.itemsize * per)))
    return np.frombuffer(data, dtype, n * per, at + 4).astype("int64").reshape(n, per) if n else np.zeros((0, per), "int64")


def _sized(data: memoryview, a: int, b: int) -> np.ndarray:
    """Sizes of samples; one size for all is no more entries than the file has bytes."""
    same, n = uint(data, a + 4, b), uint(data, a + 8, b)
    return np.full(min(n, len(data) // same), same, "int64") if same else numbers(data, a + 8, b, ">u4")[:, 0]


def _halved(data: memoryview, a: int, b: int) -> np.ndarray:
    bits = uint(data, a + 7, b, 1)
    if bits != 4:
        return numbers(data, a + 8, b, ">u2" if bits == 16 else ">u1")[:, 0]
    n = uint(data, a + 8, b)
    raw = np.frombuffer(data[a + 12 : b], "u1")[: (n + 1) // 2]
    return np.stack((raw >> 4, raw & 15), 1).reshape(-1)[:n].astype("int64")


def _track(data: memoryview, start: int, end: int) -> dict:
    none = np.zeros(0, "int64")
    t: dict = {"id": 0, "codec": None, "handler": None, "timescale": 0, "duration": 0, "keys": None, "sizes": none, "offsets": none, "runs": np.zeros((0, 3), "int64"), "times": np.zeros((0, 2), "int64")}
    stack = [(start, end)]
    while stack:
        for kind, a, b in boxes(data, *stack.pop()):
            long = uint(data, a, b, 1) == 1
            if kind in CONTAINERS:
                stack.append((a, b))
            elif kind == b"mdhd":
                t["timescale"], t["duration"] = uint(data, a + (20 if long else 12), b), uint(data, a + (24 if long else 16), b, 8 if long else 4)
            elif kind == b"hdlr":
                t["handler"] = bytes(data[a + 8 : min(b, a + 12)]).decode("latin-1")
            elif kind == b"tkhd":
                t["id"] = uint(data, a + (20 if long else 12), b)
            elif kind == b"stsd":
                t["codec"] = next((k.decode("latin-1").strip() for k, _, _ in boxes(data, a + 8, b)), None)
            elif kind == b"stts":
                t["times"] = numbers(data, a + 4, b, ">u4", 2)
            elif kind == b"stss":
                t["keys"] = numbers(data, a + 4, b, ">u4")[:, 0]
            elif kind == b"stsc":
                t["runs"] = numbers(data, a + 4, b, ">u4", 3)
            elif kind == b"stsz":
                t["sizes"] = _sized(data, a, b)
            elif kind == b"stz2":
                t["sizes"] = _halved(data, a, b)
            elif kind in (b"stco", b"co64"):
                t["offsets"] = numbers(data, a + 4, b, ">u4" if kind == b"stco" else ">u8")[:, 0]
    return t


def _located(t: dict) -> np.ndarray:
    """First byte of each sample: its chunk's offset and the sizes before it in the chunk. Chunks hold no more samples
    than there are sizes, whatever the table of runs says."""
    chunks, runs, n = len(t["offsets"]), t["runs"], len(t["sizes"])
    if not chunks or not len(runs) or not n:
        return np.zeros(0, "int64")
    ends = np.clip(np.append(runs[1:, 0], chunks + 1) - 1, 0, chunks)
    per = np.repeat(np.minimum(runs[:, 1], n), (ends - np.clip(runs[:, 0] - 1, 0, chunks)).clip(0))[:chunks]
    after = np.minimum(np.cumsum(per), n)
    first = np.concatenate(([0], after[:-1]))
    chunk = np.repeat(np.arange(len(per)), after - first)
    before = np.concatenate(([0], np.cumsum(t["sizes"])))
    return t["offsets"][chunk] + before[: len(chunk)] - before[first[chunk]]


#: A sample that depends on others, in the flags of fragments.
DEPENDS = 0x10000


def _fragment(data: memoryview, start: int, a: int, b: int, defaults: dict[int, tuple]) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """(track, ranges, whether each is a key frame, duration) of each run of samples of a fragment that begins at
    ``start``. What a run leaves out stands in the fragment's header, or in the movie's defaults."""
    for kind, c, d in boxes(data, a, b):
        if kind != b"traf":
            continue
        track, base, lasts, size, flags, at = 0, start, 0, 0, 0, None
        for k, e, f in boxes(data, c, d):
            given, e = uint(data, e, f) & 0xFFFFFF, e + 4
            if k == b"tfhd":
                track, e = uint(data, e, f), e + 4
                lasts, size, flags = defaults.get(track, (0, 0, 0))
                if given & 1:
                    base, e = uint(data, e, f, 8), e + 8
                e += 4 * (given >> 1 & 1)
                if given & 8:
                    lasts, e = uint(data, e, f), e + 4
                if given & 0x10:
                    size, e = uint(data, e, f), e + 4
                if given & 0x20:
                    flags = uint(data, e, f)
            elif k == b"trun":
                n, e = uint(data, e, f), e + 4
                first = at if at is not None else base
                if given & 1:
                    first, e = base + int.from_bytes(data[e : e + 4], "big", signed=True), e + 4
                lead = None
                if given & 4:
                    lead, e = uint(data, e, f), e + 4
                have = [bit for bit in (0x100, 0x200, 0x400, 0x800) if given & bit]
                most = (f - e) // (4 * len(have)) if have else len(data) // max(size, 1)
                n = max(0, min(n, most))
                rows = np.frombuffer(data, ">u4", n * len(have), e).astype("int64").reshape(n, len(have)) if have and n else np.zeros((n, len(have)), "int64")
                column = lambda bit, other: rows[:, have.index(bit)] if bit in have else np.full(n, other, "int64")  # noqa: B023, E731
                times, sizes, marks = column(0x100, lasts), column(0x200, size), column(0x400, flags)
                if lead is not None and n and 0x400 not in have:
                    marks[0] = lead
                ends = first + np.cumsum(sizes)
                yield track, np.stack((ends - sizes, sizes), 1), marks & DEPENDS == 0, int(times.sum())
                at = int(ends[-1]) if n else first


def probe(file: bytes) -> list[dict]:
    """One record a track: codec, handler, timescale, duration, samples (ranges as an [n, 2] array of
    offset and length) and keys, the ranges of its key frames (without a table of them, every sample is
    one). Samples of movie fragments follow those of the movie's own tables. What isn't an ISO media file has
    no tracks; tables that are cut, or that tell of more samples than the file can hold, are read as far as they go,
    and ranges beyond the file's end are left out."""
    data, found, defaults = memoryview(file), {}, {}
    for kind, a, b in boxes(data, 0, len(data)):
        if kind == b"moov":
            for k, c, d in boxes(data, a, b):
                if k == b"trak":
                    t = _track(data, c, d)
                    at = _located(t)
                    ranges = np.stack((at, t["sizes"][: len(at)]), 1)
                    keys = np.ones(len(at), bool) if t["keys"] is None else np.isin(np.arange(1, len(at) + 1), t["keys"])
                    total = int((t["times"][:, 0] * t["times"][:, 1]).sum())
                    found[t["id"], len(found)] = {"codec": t["codec"], "handler": t["handler"], "timescale": t["timescale"], "duration": t["duration"] or total, "parts": [(ranges, keys)]}
                elif k == b"mvex":
                    for m, e, f in boxes(data, c, d):
                        if m == b"trex":
                            defaults[uint(data, e + 4, f)] = (uint(data, e + 12, f), uint(data, e + 16, f), uint(data, e + 20, f))
        elif kind == b"moof":
            for track, ranges, keys, lasts in _fragment(data, a - 8, a, b, defaults):
                for (name, _), t in found.items():
                    if name == track:
                        t["parts"].append((ranges, keys))
                        t["more"] = t.get("more", 0) + lasts
    out = []
    for t in found.values():
        ranges, keys = (np.concatenate(x) for x in zip(*t.pop("parts"), strict=True))
        inside = (ranges[:, 0] >= 0) & (ranges[:, 0] + ranges[:, 1] <= len(data))
        t["duration"] += t.pop("more", 0)
        out.append(t | {"samples": ranges[inside], "keys": ranges[inside & keys]})
    return out


def read_back(file: bytes, track: dict) -> bytes:
    """The samples of a track, joined; neighbouring ranges are read as one."""
    r = track["samples"]
    if not len(r):
        return b""
    starts = np.flatnonzero(np.concatenate(([True], r[1:, 0] != r[:-1, 0] + r[:-1, 1])))
    ends = np.append(starts[1:], len(r)) - 1
    return b"".join(file[a:b] for a, b in zip(r[starts, 0].tolist(), (r[ends, 0] + r[ends, 1]).tolist(), strict=True))


def media_files(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: each text (null: empty) as a media file."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):  # bounds what a worker holds of files
                part = batch.slice(at, 64)
                raw = [(x.as_py() or "").encode("utf-8", "surrogatepass") for x in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([*map(len, raw)], pa.int64()), pa.array([mux(padded(x)) for x in raw], pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(write, "doc_id long, n_bytes long, media binary")


PROBED = "tracks array<struct<codec:string,handler:string,timescale:long,duration:long,samples:long,keyframes:array<struct<offset:long,length:long>>>>"


def probed(files: DataFrame, column: str = "media") -> DataFrame:
    """``files`` without ``column``, with tracks: an array of what ``probe`` finds."""
    kept = [c for c in files.columns if c != column]
    kind = pa.struct([("codec", pa.string()), ("handler", pa.string()), ("timescale", pa.int64()), ("duration", pa.int64()), ("samples", pa.int64()), ("keyframes", pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64())])))])
    schema = T.StructType([*files.select(*kept).schema, *T.StructType.fromDDL(PROBED)])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tracks = [[{**{k: t[k] for k in ("codec", "handler", "timescale", "duration")}, "samples": len(t["samples"]), "keyframes": [{"offset": a, "length": b} for a, b in t["keys"].tolist()]} for t in probe(x.as_py() or b"")] for x in batch.column(column)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(tracks, pa.list_(kind))], [*kept, "tracks"])

    return files.select(*kept, column).mapInArrow(read, schema)


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, codec string, duration double, keyframes array<struct<offset:long,length:long>>"
RANGES = pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64())]))


def digests(files: DataFrame) -> DataFrame:
    """What is read back from each stored file: the payload's and the file's digests, codec, duration in seconds and the key
    frames' byte ranges in the file; feature sums these up as JSON (the ranges' number, first, last and a checksum of all)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for doc, n, cell in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                file = cell.as_py()
                (t,) = probe(file)
                payload, keys = read_back(file, t), t["keys"]
                feature = {"codec": t["codec"], "seconds": t["duration"] / t["timescale"], "samples": len(t["samples"]), "keyframes": len(keys), "first": keys[0].tolist(), "last": keys[-1].tolist(), "ranges_crc32": zlib.crc32(keys.astype("<i8").tobytes())}
                rows.append((doc, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-SAMPLE:]), len(file), hashlib.sha256(file).hexdigest(), json.dumps(feature), t["codec"], feature["seconds"], [{"offset": a, "length": b} for a, b in keys.tolist()]))
            names = [x.split()[0] for x in DIGEST.split(", ")]
            kinds = [{"string": pa.string(), "long": pa.int64(), "double": pa.float64()}.get(x.split()[1], RANGES) for x in DIGEST.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * len(names), kinds, strict=True)], names)

    return files.select("doc_id", "n_bytes", "media").mapInArrow(read, DIGEST)


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored as a media file in a table, and what its boxes and samples say when it is read back.
    Null and empty texts are 64 bytes 0; null ids stay null; repeated rows and equal texts give equal values, a row each; texts of
    any length are stored whole; other columns, whatever they are called, are ignored; an empty table gives an empty result."""
    return digests(staged(media_files(table(spark, sf_dir, "documents")), "media", "zstd"))
