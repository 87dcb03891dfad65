"""Media columns in Matroska: EBML elements, clusters, lacing, cues; packet tables read back from bytes.

``mux`` stores samples as laced SimpleBlocks of an 8-bit PCM track, ``demux`` parses any Matroska bytes
into packets (track, timestamp, byte range), and ``packet_table`` / ``media_digest`` apply them to columns.

Defined cases: a null text is the empty text; empty payloads are padded to one frame, so every row has
media; equal texts give equal bytes (nothing random or dated is written); extra columns are ignored;
damaged media raise ValueError in ``demux`` and give one row with a null track in ``packet_table``.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from millrace.llm._shared import batch_rows

# Fixed values of the Matroska format: element ids, and the ids whose content is again elements.
EBML, SEGMENT, INFO, TRACKS, TRACK, AUDIO = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0xAE, 0xE1
CLUSTER, CLUSTER_TIME, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1
CUES, CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
TIMESTAMP_SCALE, TRACK_NUMBER, CODEC_ID = 0x2AD7B1, 0xD7, 0x86
PARENTS = {EBML, SEGMENT, INFO, TRACKS, TRACK, AUDIO, CLUSTER, BLOCK_GROUP, CUES, CUE_POINT, CUE_POSITIONS}
NO_LACING, XIPH_LACING, FIXED_LACING, EBML_LACING = 0, 1, 2, 3

#: Bytes of a frame; at 8000 one-byte samples a second it lasts 72 ms.
FRAME = 576
RATE = 8000
FRAMES_A_BLOCK = 8
BLOCKS_A_CLUSTER = 16


@dataclass
class Packet:
    track: int
    timestamp: int  # in units of the timestamp scale
    start: int  # of the frame's bytes in the file
    end: int
    lacing: int


def vint(n: int) -> bytes:
    """An EBML size of the least width; all ones are reserved for the unknown size."""
    width = 1
    while n >= (1 << (7 * width)) - 1:
        width += 1
    return (n | 1 << (7 * width)).to_bytes(width, "big")


def element(eid: int, body: bytes) -> bytes:
    return eid.to_bytes((eid.bit_length() + 7) // 8, "big") + vint(len(body)) + body


def number(eid: int, n: int) -> bytes:
    return element(eid, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def _head() -> tuple[bytes, bytes]:
    ebml = element(EBML, number(0x4286, 1) + number(0x42F7, 1) + number(0x42F2, 4) + number(0x42F3, 8) + element(0x4282, b"matroska") + number(0x4287, 4) + number(0x4285, 2))
    info = element(INFO, number(TIMESTAMP_SCALE, 1_000_000) + element(0x4D80, b"millrace") + element(0x5741, b"millrace"))
    audio = element(AUDIO, element(0xB5, struct.pack(">d", RATE)) + number(0x9F, 1) + number(0x6264, 8))
    track = element(TRACK, number(TRACK_NUMBER, 1) + number(0x73C5, 1) + number(0x83, 2) + number(0x9C, 1) + element(CODEC_ID, b"A_PCM/INT/LIT") + audio)
    return ebml, info + element(TRACKS, track)


_EBML, _INFO_TRACKS = _head()


def _block(frames: list[bytes], offset: int, lacing: int) -> bytes:
    """A SimpleBlock: track, time offset in its cluster, key-frame flag and lacing, sizes, frames."""
    head = vint(1) + offset.to_bytes(2, "big", signed=True)
    if len(frames) == 1:
        return element(SIMPLE_BLOCK, head + b"\x80" + frames[0])
    body = b"".join(frames)
    count = bytes([len(frames) - 1])
    if lacing == FIXED_LACING:
        sizes = b""
    elif lacing == XIPH_LACING:
        sizes = b"".join(b"\xff" * (len(f) // 255) + bytes([len(f) % 255]) for f in frames[:-1])
    else:
        sizes, last = vint(len(frames[0])), len(frames[0])
        for f in frames[1:-1]:
            width, diff = 1, len(f) - last
            while not -(1 << (7 * width - 1)) < diff < 1 << (7 * width - 1):
                width += 1
            sizes += (diff + (1 << (7 * width - 1)) - 1 | 1 << (7 * width)).to_bytes(width, "big")
            last = len(f)
    return element(SIMPLE_BLOCK, head + bytes([0x80 | lacing << 1]) + count + sizes + body)


def mux(frames: list[bytes], frame_ms: int = FRAME * 1000 // RATE, lacing: int = FIXED_LACING, per_block: int = FRAMES_A_BLOCK, per_cluster: int = BLOCKS_A_CLUSTER) -> bytes:
    """A Matroska file of one 8-bit PCM track whose frames are the given bytes, in order.

    Fixed lacing needs frames of one size in a block; a block that hasn't gets EBML lacing instead.
    """
    clusters, cues, at = [], b"", len(_INFO_TRACKS)
    per = per_block * per_cluster
    for c in range(0, len(frames), per):
        begun, body = c * frame_ms, [number(CLUSTER_TIME, c * frame_ms)]
        for b in range(c, min(c + per, len(frames)), per_block):
            own = frames[b : min(b + per_block, c + per)]
            kind = EBML_LACING if lacing == FIXED_LACING and len({len(f) for f in own}) > 1 else lacing
            body.append(_block(own, b * frame_ms - begun, kind))
        clusters.append(element(CLUSTER, b"".join(body)))
        cues += element(CUE_POINT, number(CUE_TIME, begun) + element(CUE_POSITIONS, number(CUE_TRACK, 1) + number(CUE_CLUSTER, at)))
        at += len(clusters[-1])
    return _EBML + element(SEGMENT, b"".join([_INFO_TRACKS, *clusters, element(CUES, cues)]))


def _read_vint(data: bytes, at: int, keep_marker: bool = False) -> tuple[int, int]:
    """The number and the position after it; -1 for the reserved unknown size."""
    if at >= len(data) or not data[at]:
        raise ValueError(f"no EBML number at byte {at}")
    width = 9 - data[at].bit_length()
    if at + width > len(data):
        raise ValueError("the data end within an EBML number")
    n = int.from_bytes(data[at : at + width], "big")
    if keep_marker:
        return n, at + width
    n &= (1 << (7 * width)) - 1
    return (-1 if n == (1 << (7 * width)) - 1 else n), at + width


def elements(data: bytes, at: int, end: int) -> Iterator[tuple[int, int, int]]:
    """(id, start of content, end of content) of the elements between two positions."""
    while at < end:
        eid, at = _read_vint(data, at, keep_marker=True)
        size, at = _read_vint(data, at)
        stop = end if size < 0 else at + size
        if stop > end:
            raise ValueError(f"element {eid:#x} goes beyond its parent")
        yield eid, at, stop
        at = stop


def _frames(data: bytes, at: int, end: int) -> tuple[int, int, int, list[tuple[int, int]]]:
    """Of a block: track, time offset, lacing, byte ranges of its frames."""
    track, at = _read_vint(data, at)
    if at + 3 > end:
        raise ValueError("a block ends in its head")
    offset = int.from_bytes(data[at : at + 2], "big", signed=True)
    lacing, at = data[at + 2] >> 1 & 3, at + 3
    if lacing == NO_LACING:
        return track, offset, lacing, [(at, end)]
    count, at, sizes = data[at] + 1, at + 1, []
    if lacing == FIXED_LACING:
        if (end - at) % count:
            raise ValueError("fixed lacing with frames of several sizes")
        sizes = [(end - at) // count] * (count - 1)
    elif lacing == XIPH_LACING:
        for _ in range(count - 1):
            size = 0
            while True:
                size, at = size + data[at], at + 1
                if data[at - 1] != 255:
                    break
            sizes.append(size)
    else:
        for k in range(count - 1):
            before = at
            n, at = _read_vint(data, at)
            sizes.append(n if not k else sizes[-1] + n - (1 << (7 * (at - before) - 1)) + 1)
    ranges = []
    for size in sizes:
        ranges.append((at, at + size))
        at += size
    if at > end or min([0, *sizes]) < 0:
        raise ValueError("laced frames go beyond their block")
    return track, offset, lacing, [*ranges, (at, end)]


def demux(data: bytes) -> dict:
    """Packets, tracks, cues and the timestamp scale of a Matroska file; ValueError if it's damaged.

    Frames of a laced block share its timestamp. Cue positions are checked to be clusters.
    """
    out: dict = {"packets": [], "tracks": [], "cues": [], "scale": 1_000_000, "clusters": []}
    begun = 0
    segment = 0
    cue: list[int] = [0, 0, 0]
    todo = [elements(data, 0, len(data))]
    while todo:
        got = next(todo[-1], None)
        if got is None:
            todo.pop()
            continue
        eid, at, end = got
        if eid == SEGMENT:
            segment = at
        elif eid == CLUSTER:
            out["clusters"].append(at)
        elif eid in (SIMPLE_BLOCK, BLOCK):
            track, offset, lacing, ranges = _frames(data, at, end)
            out["packets"] += [Packet(track, begun + offset, a, b, lacing) for a, b in ranges]
        elif eid == CLUSTER_TIME:
            begun = int.from_bytes(data[at:end], "big")
        elif eid == TIMESTAMP_SCALE:
            out["scale"] = int.from_bytes(data[at:end], "big")
        elif eid == TRACK_NUMBER:
            out["tracks"].append([int.from_bytes(data[at:end], "big"), ""])
        elif eid == CODEC_ID and out["tracks"]:
            out["tracks"][-1][1] = data[at:end].decode("ascii", "replace")
        elif eid == CUE_TIME:
            cue = [int.from_bytes(data[at:end], "big"), 0, 0]
        elif eid == CUE_TRACK:
            cue[1] = int.from_bytes(data[at:end], "big")
        elif eid == CUE_CLUSTER:
            cue[2] = segment + int.from_bytes(data[at:end], "big")
            if data[cue[2] : cue[2] + 4] != CLUSTER.to_bytes(4, "big"):
                raise ValueError("a cue points at no cluster")
            out["cues"].append(tuple(cue))
        if eid in PARENTS:
            todo.append(elements(data, at, end))
    return out


def payload_of(text: str | None, frame: int = FRAME) -> tuple[int, bytes]:
    """Bytes of the text without padding, and the text in UTF-8 with bytes 255 up to a positive multiple of a frame."""
    data = (text or "").encode()
    return len(data), data + b"\xff" * (max(1, -(-len(data) // frame)) * frame - len(data))


def media_of(text: str | None) -> bytes:
    payload = payload_of(text)[1]
    return mux([payload[i : i + FRAME] for i in range(0, len(payload), FRAME)])


_DIGEST = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])


def _digest(doc_id: int | None, text: str | None) -> tuple:
    media = media_of(text)
    parsed = demux(media)
    packets = parsed["packets"]
    back = b"".join([media[p.start : p.end] for p in packets])
    samples = sum(back)
    feature = f"packets={len(packets)};clusters={len(parsed['clusters'])};cues={len(parsed['cues'])};last_ms={packets[-1].timestamp * parsed['scale'] // 1_000_000};mean={samples / len(back):.6f}"
    return doc_id, len((text or "").encode()), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature


def media_digest(docs: DataFrame) -> DataFrame:
    """Stores each whole text as media, reads the stored bytes back, and returns their digests by doc_id."""
    batch_rows(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [_digest(i, t.as_py()) for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * len(_DIGEST), _DIGEST, strict=True)], schema=_DIGEST)

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, schema)


def store(docs: DataFrame) -> DataFrame:
    """(doc_id, media): the Matroska bytes of each whole text."""
    batch_rows(docs.sparkSession, 500)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([media_of(t.as_py()) for t in b.column(1)], pa.binary())], ["doc_id", "media"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "doc_id long, media binary")


def packet_table(media: DataFrame) -> DataFrame:
    """A row for each packet of (doc_id, media); media that are null or damaged give one row with a null track and the error."""
    names = ["doc_id", "packet", "track", "timestamp_ns", "byte_start", "byte_end", "lacing", "error"]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for i, m in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                try:
                    parsed = demux(m.as_py() or b"")
                    if not parsed["packets"]:
                        raise ValueError("no packets")
                    rows += [(i, k, p.track, p.timestamp * parsed["scale"], p.start, p.end, p.lacing, None) for k, p in enumerate(parsed["packets"])]
                except (ValueError, IndexError) as e:
                    rows.append((i, 0, None, None, None, None, None, str(e)))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names)

    return media.selectExpr("cast(doc_id as long) doc_id", "media").mapInArrow(run, "doc_id long, packet int, track int, timestamp_ns long, byte_start long, byte_end long, lacing int, error string")
