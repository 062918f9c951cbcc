"""Media columns: Matroska.

``packets`` parses a file: variable-length element ids and sizes (unknown sizes too), tracks, clusters, simple blocks and
block groups, all four lacings, and cues. It gives one row per frame: track, timestamp, byte range in the file, keyframe
flag, lacing, cluster and the encoding of its track: bytes to put in front (header stripping) or deflate. ``store`` writes bytes losslessly as 8-bit samples, one frame per ``FRAME`` bytes, laced into
blocks; ``read`` gets them back through the packet table. All work is per row and per file; nothing is shuffled.

Defined results: a null text or file is empty (an empty file has no packets); repeated rows, null ids and long texts are
rows like any other; an empty table gives no rows; input columns that clash with output columns are replaced. A file that
breaks the format makes ``parse`` and ``read`` raise ``ValueError`` with the place, and nothing else; in the packet table it
is one row with ``error`` and no packet, and other files go on. Frames of other encodings (encryption, other compressions)
are listed as they are stored, and ``read`` raises for them.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import struct_of, table

FRAME, RATE = 576, 8000
FRAME_NS = FRAME * 1_000_000_000 // RATE
FRAMES_PER_BLOCK, BLOCKS_PER_CLUSTER = 8, 32

# Element ids (fixed values of the format).
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
TIMESTAMP_SCALE, DURATION, TRACK_ENTRY, TRACK_NUMBER, TRACK_TYPE, CODEC_ID, DEFAULT_DURATION = 0x2AD7B1, 0x4489, 0xAE, 0xD7, 0x83, 0x86, 0x23E383
CLUSTER_TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, REFERENCE_BLOCK = 0xE7, 0xA3, 0xA0, 0xA1, 0xFB
CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
AUDIO, SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH, TRACK_UID, FLAG_LACING = 0xE1, 0xB5, 0x9F, 0x6264, 0x73C5, 0x9C
ENCODINGS, ENCODING, ENCODING_SCOPE, COMPRESSION, COMPRESSION_KIND, COMPRESSION_SETTINGS = 0x6D80, 0x6240, 0x5032, 0x5034, 0x4254, 0x4255
DOC_TYPE, DOC_TYPE_VERSION, DOC_TYPE_READ_VERSION = 0x4282, 0x4287, 0x4285
TOP_LEVEL = {0x114D9B74, INFO, TRACKS, CLUSTER, CUES, 0x1941A469, 0x1043A770, 0x1254C367}
NO_LACING, XIPH, FIXED, EBML_LACING = 0, 1, 2, 3
UNKNOWN = -1


# Writing


def _id(n: int) -> bytes:
    return n.to_bytes((n.bit_length() + 7) // 8, "big")


def size_bytes(n: int, width: int = 0) -> bytes:
    """A size in as few bytes as hold it (all ones is kept for an unknown size)."""
    while not width or n >= (1 << 7 * width) - 1:
        width += 1
    return (n | 1 << 7 * width).to_bytes(width, "big")


def element(n: int, body: bytes) -> bytes:
    return _id(n) + size_bytes(len(body)) + body


def uint(n: int, value: int) -> bytes:
    return element(n, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def block(track: int, offset: int, frames: list[bytes], lacing: int) -> bytes:
    """A simple block's body: keyframe, with its frames laced."""
    head = size_bytes(track) + struct.pack(">hB", offset, 0x80 | lacing << 1)
    if lacing == NO_LACING:
        return head + frames[0]
    sizes = [len(f) for f in frames[:-1]]
    if lacing == XIPH:
        lace = b"".join(b"\xff" * (s // 255) + bytes([s % 255]) for s in sizes)
    elif lacing == EBML_LACING:
        lace = size_bytes(sizes[0]) if sizes else b""
        for a, b in zip(sizes, sizes[1:], strict=False):
            width = 1
            while not -(1 << 7 * width - 1) < b - a < (1 << 7 * width - 1):
                width += 1
            lace += size_bytes(b - a + (1 << 7 * width - 1) - 1, width)
    else:
        lace = b""
    return head + bytes([len(frames) - 1]) + lace + b"".join(frames)


_HEAD = element(EBML, element(DOC_TYPE, b"matroska") + uint(DOC_TYPE_VERSION, 4) + uint(DOC_TYPE_READ_VERSION, 2))
_TRACKS = element(TRACKS, element(TRACK_ENTRY, uint(TRACK_NUMBER, 1) + uint(TRACK_UID, 1) + uint(TRACK_TYPE, 2) + uint(FLAG_LACING, 1) + element(CODEC_ID, b"A_PCM/INT/LIT") + uint(DEFAULT_DURATION, FRAME_NS) + element(AUDIO, element(SAMPLING_FREQUENCY, struct.pack(">d", RATE)) + uint(CHANNELS, 1) + uint(BIT_DEPTH, 8))))


def store(payload: bytes) -> bytes:
    """A Matroska file with the payload (a multiple of ``FRAME`` bytes) as 8-bit samples."""
    ms = FRAME_NS // 1_000_000
    n = len(payload) // FRAME
    body = [element(INFO, uint(TIMESTAMP_SCALE, 1_000_000) + element(DURATION, struct.pack(">d", n * ms))), _TRACKS]
    at, cues, per_cluster = sum(map(len, body)), [], FRAMES_PER_BLOCK * BLOCKS_PER_CLUSTER
    for first in range(0, n, per_cluster):
        blocks = [uint(CLUSTER_TIMESTAMP, first * ms)]
        for k, b in enumerate(range(first, min(n, first + per_cluster), FRAMES_PER_BLOCK)):
            frames = [payload[f * FRAME : (f + 1) * FRAME] for f in range(b, min(n, b + FRAMES_PER_BLOCK))]
            lacing = NO_LACING if len(frames) == 1 else (FIXED, EBML_LACING, XIPH)[k % 3]
            blocks.append(element(SIMPLE_BLOCK, block(1, (b - first) * ms, frames, lacing)))
        cluster = element(CLUSTER, b"".join(blocks))
        cues.append(element(CUE_POINT, uint(CUE_TIME, first * ms) + element(CUE_POSITIONS, uint(CUE_TRACK, 1) + uint(CUE_CLUSTER, at))))
        body.append(cluster)
        at += len(cluster)
    body.append(element(CUES, b"".join(cues)))
    return _HEAD + element(SEGMENT, b"".join(body))


# Reading


def _vint(data: bytes, at: int, end: int, marked: bool) -> tuple[int, int]:
    """A variable-length number and the place behind it; ids keep their length marker."""
    if at >= end:
        raise ValueError(f"the file ends within an element at byte {at}")
    first = data[at]
    width = 9 - first.bit_length()
    if width > 8 or at + width > end:
        raise ValueError(f"no element at byte {at}")
    if width == 1:
        return (first if marked else UNKNOWN if first == 0xFF else first & 0x7F), at + 1
    value = int.from_bytes(data[at : at + width], "big")
    if not marked:
        value &= (1 << 7 * width) - 1
        if value == (1 << 7 * width) - 1:
            value = UNKNOWN
    return value, at + width


def children(data: bytes, at: int, end: int, stop: frozenset | set = frozenset()) -> Iterator[tuple[int, int, int]]:
    """(id, body start, body end); an element of unknown size reaches to the end or to an id in ``stop``."""
    while at < end:
        n, body = _vint(data, at, end, True)
        if n in stop:
            return
        size, body = _vint(data, body, end, False)
        if size == UNKNOWN:
            inner, close = body, end
            ends = TOP_LEVEL | {SEGMENT, EBML} if n == CLUSTER else {EBML} if n == SEGMENT else set()
            while inner < end and ends:
                m, b = _vint(data, inner, end, True)
                if m in ends and not (n == SEGMENT and m != EBML):
                    close = inner
                    break
                s, b = _vint(data, b, end, False)
                if s == UNKNOWN:
                    inner = b  # its children follow; they are skipped one by one
                else:
                    inner = b + s
            size = close - body
        if body + size > end:
            raise ValueError(f"the element at byte {at} reaches beyond its parent")
        yield n, body, body + size
        at = body + size


def _uint(data: bytes, a: int, b: int) -> int:
    if b - a > 8:
        raise ValueError(f"a number of {b - a} bytes at byte {a}")
    return int.from_bytes(data[a:b], "big")


def _float(data: bytes, a: int, b: int) -> float:
    if b - a not in (0, 4, 8):
        raise ValueError(f"a fraction of {b - a} bytes at byte {a}")
    value = struct.unpack(">f" if b - a == 4 else ">d", data[a:b])[0] if b > a else 0.0
    if not abs(value) < 1 << 62:
        raise ValueError(f"no finite length at byte {a}")
    return value


def _encoding(data: bytes, a: int, b: int) -> tuple[str, bytes]:
    """How a track's frames are stored: plain, ``header`` with the bytes that go in front, ``zlib``, or ``other``."""
    found = []
    for n, c, d in children(data, a, b):
        if n != ENCODING:
            continue
        parts = {m: (x, y) for m, x, y in children(data, c, d)}
        if ENCODING_SCOPE in parts and not _uint(data, *parts[ENCODING_SCOPE]) & 1:
            continue  # not of frames
        if COMPRESSION not in parts:
            found.append(("other", b""))
            continue
        how = {m: (x, y) for m, x, y in children(data, *parts[COMPRESSION])}
        kind = _uint(data, *how[COMPRESSION_KIND]) if COMPRESSION_KIND in how else 0
        found.append({0: ("zlib", b""), 3: ("header", data[slice(*how.get(COMPRESSION_SETTINGS, (0, 0)))])}.get(kind, ("other", b"")))
    return ("plain", b"") if not found else found[0] if len(found) == 1 else ("other", b"")


@dataclass
class Media:
    """A parsed file. ``packets``: (track, timestamp ns, offset, size, keyframe, lacing, cluster). ``cues``: (time ns, track, cluster's offset in the file)."""

    scale: int = 1_000_000
    duration_ns: int = 0
    tracks: dict[int, dict] = field(default_factory=dict)
    packets: list[tuple] = field(default_factory=list)
    cues: list[tuple] = field(default_factory=list)
    clusters: list[int] = field(default_factory=list)


def lace_sizes(data: bytes, at: int, end: int, lacing: int) -> tuple[list[int], int]:
    """Frame sizes of a block and where its first frame starts; ``at`` is behind the block's flags."""
    if lacing == NO_LACING:
        return [end - at], at
    if at >= end:
        raise ValueError(f"no number of frames at byte {at}")
    n, at = data[at] + 1, at + 1
    if lacing == FIXED:
        if (end - at) % n:
            raise ValueError(f"frames of unequal size at byte {at}")
        return [(end - at) // n] * n, at
    sizes: list[int] = []
    for k in range(n - 1):
        if lacing == XIPH:
            size = 0
            while True:
                if at >= end:
                    raise ValueError(f"frame sizes reach beyond their block at byte {at}")
                size, more = size + data[at], data[at] == 255
                at += 1
                if not more:
                    break
        else:
            raw, after = _vint(data, at, end, False)
            if raw == UNKNOWN:
                raw = (1 << 7 * (after - at)) - 1
            size = raw if k == 0 else sizes[-1] + raw - ((1 << 7 * (after - at) - 1) - 1)
            at = after
        sizes.append(size)
    last = end - at - sum(sizes)
    if last < 0 or min(sizes, default=0) < 0:
        raise ValueError(f"frames reach beyond their block at byte {at}")
    return [*sizes, last], at


def _block(data: bytes, a: int, b: int, media: Media, time: int, key: bool | None) -> None:
    track, at = _vint(data, a, b, False)
    if at + 3 > b:
        raise ValueError(f"a block without a head at byte {a}")
    if not 0 <= track < 1 << 31:
        raise ValueError(f"no track number at byte {a}")
    offset, flags = struct.unpack_from(">hB", data, at)
    lacing = flags >> 1 & 3
    sizes, at = lace_sizes(data, at + 3, b, lacing)
    step = media.tracks.get(track, {}).get("default_ns", 0)
    start = (time + offset) * media.scale
    if abs(start) + len(sizes) * step >= 1 << 63:
        raise ValueError(f"a time out of range at byte {a}")
    key = bool(flags & 0x80) if key is None else key
    for k, size in enumerate(sizes):
        media.packets.append((track, start + k * step, at, size, key, lacing, len(media.clusters) - 1))
        at += size


def parse(data: bytes) -> Media:
    media = Media()
    for top, start, stop in children(data, 0, len(data)):
        if top != SEGMENT:
            continue
        cues = []
        for n, a, b in children(data, start, stop):
            if n == INFO:
                for m, c, d in children(data, a, b):
                    if m == TIMESTAMP_SCALE:
                        media.scale = _uint(data, c, d)
                    elif m == DURATION:
                        media.duration_ns = _float(data, c, d)
            elif n == TRACKS:
                for m, c, d in children(data, a, b):
                    if m == TRACK_ENTRY:
                        seen = {k: (x, y) for k, x, y in children(data, c, d)}
                        get = lambda k, seen=seen, default=0: _uint(data, *seen[k]) if k in seen else default
                        codec = seen.get(CODEC_ID)
                        media.tracks[get(TRACK_NUMBER)] = {"type": get(TRACK_TYPE), "codec": data[slice(*codec)].decode(errors="replace") if codec else "", "default_ns": get(DEFAULT_DURATION), "encoding": _encoding(data, *seen[ENCODINGS]) if ENCODINGS in seen else ("plain", b"")}
            elif n == CLUSTER:
                media.clusters.append(a)
                time = 0
                for m, c, d in children(data, a, b):
                    if m == CLUSTER_TIMESTAMP:
                        time = _uint(data, c, d)
                    elif m == SIMPLE_BLOCK:
                        _block(data, c, d, media, time, None)
                    elif m == BLOCK_GROUP:
                        parts = list(children(data, c, d))
                        key = all(k != REFERENCE_BLOCK for k, _, _ in parts)
                        for k, x, y in parts:
                            if k == BLOCK:
                                _block(data, x, y, media, time, key)
            elif n == CUES:
                for m, c, d in children(data, a, b):
                    if m == CUE_POINT:
                        when, found = 0, []
                        for k, x, y in children(data, c, d):
                            if k == CUE_TIME:
                                when = _uint(data, x, y)
                            elif k == CUE_POSITIONS:
                                part = {i: _uint(data, p, q) for i, p, q in children(data, x, y) if q - p <= 8}
                                found.append((part.get(CUE_TRACK, 0), start + part.get(CUE_CLUSTER, 0)))
                        cues += [(when, *f) for f in found]
        media.cues += [(when * media.scale, track, at) for when, track, at in cues]
        media.duration_ns = int(media.duration_ns * media.scale)
    return media


def frames(data: bytes, media: Media, track: int | None = None) -> list[bytes]:
    """The frames of one track or all, decoded, in order of time."""
    out = []
    for p in sorted((p for p in media.packets if track in (None, p[0])), key=lambda p: (p[1], p[2])):
        kind, head = media.tracks.get(p[0], {}).get("encoding", ("plain", b""))
        raw = data[p[2] : p[2] + p[3]]
        if kind == "zlib":
            try:
                raw = zlib.decompress(raw)
            except zlib.error as e:
                raise ValueError(f"a frame that can't be inflated at byte {p[2]}") from e
        elif kind == "other":
            raise ValueError(f"a frame of an unknown encoding at byte {p[2]}")
        out.append(head + raw)
    return out


def read(data: bytes, track: int = 1) -> bytes:
    """The track's frames in order of time."""
    return b"".join(frames(data, parse(data), track))


def padded(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode()
    return len(raw), raw + b"\xff" * (max(FRAME, -(-len(raw) // FRAME) * FRAME) - len(raw))


def features(media: Media, payload: bytes) -> str:
    """Packets, clusters and cues; length in ms; mean, root mean square around the middle, and crossings of the middle."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    crossings = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    length = media.duration_ns // 1_000_000
    return f"packets={len(media.packets)};clusters={len(media.clusters)};cues={len(media.cues)};ms={length};mean={x.mean():.4f};rms={np.sqrt((x * x).mean()):.4f};crossings={crossings}"


# Tables

PACKET = struct_of("packet int, track int, timestamp_ns long, offset long, size long, keyframe boolean, lacing int, cluster int, encoding string, header binary, error string")
DIGEST = struct_of("n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def _others(df: DataFrame, column: str, made: T.StructType) -> list[T.StructField]:
    return [f for f in df.schema.fields if f.name != column and f.name not in made.names]


def stored(docs: DataFrame, text_col: str = "text", media_col: str = "media") -> DataFrame:
    """``docs`` with each text's file in a binary column."""
    rest = [f for f in docs.schema.fields if f.name != media_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files = [store(padded(t.as_py())[1]) for t in batch.column(batch.schema.get_field_index(text_col))]
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(f.name)) for f in rest], pa.array(files, pa.binary())], names=[*[f.name for f in rest], media_col])

    return docs.select(*[f.name for f in rest]).mapInArrow(run, T.StructType([*rest, T.StructField(media_col, T.BinaryType())]))


def packets(files: DataFrame, media_col: str = "media") -> DataFrame:
    """One row per frame of each file, with the file's other columns; one row with ``error`` for a file that breaks the format."""
    rest = _others(files, media_col, PACKET)
    types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int32(), pa.string(), pa.binary(), pa.string()]

    def table_of(data: bytes) -> list[tuple]:
        try:
            media = parse(data)
        except ValueError as e:
            return [(*[None] * (len(types) - 1), str(e))]
        how = {t: v["encoding"] for t, v in media.tracks.items()}
        return [(k, *p, *how.get(p[0], ("plain", b"")), None) for k, p in enumerate(media.packets)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []
            for i, f in enumerate(batch.column(batch.schema.get_field_index(media_col))):
                found = table_of(f.as_py() or b"")
                rows += found
                at += [i] * len(found)
            kept = [batch.column(batch.schema.get_field_index(f.name)).take(pa.array(at, pa.int32())) for f in rest]
            yield pa.RecordBatch.from_arrays([*kept, *[pa.array([r[k] for r in rows], t) for k, t in enumerate(types)]], names=[*[f.name for f in rest], *PACKET.names])

    return files.select(*[f.name for f in rest], media_col).mapInArrow(run, T.StructType([*rest, *PACKET.fields]))


def digest(text: str | None) -> tuple:
    n, payload = padded(text)
    data = store(payload)
    media = parse(data)
    back = b"".join(frames(data, media))
    return n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(data), hashlib.sha256(data).hexdigest(), features(media, back)


def digests(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` without its text, with what reading its stored file back gives."""
    rest = _others(docs, text_col, DIGEST)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [digest(t.as_py()) for t in batch.column(batch.schema.get_field_index(text_col))]
            kept = [batch.column(batch.schema.get_field_index(f.name)) for f in rest]
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([*kept, *[pa.array([r[k] for r in rows], t) for k, t in enumerate(types)]], names=[*[f.name for f in rest], *DIGEST.names])

    return docs.select(*[f.name for f in rest], text_col).mapInArrow(run, T.StructType([*rest, *DIGEST.fields]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents").select("doc_id", "text"))
