"""Matroska media columns: a writer and a parser of EBML elements, clusters, blocks with lacing, and cues.

mux() lays frames out as SimpleBlocks with lacing in clusters and adds cues. parse() reads any such file into a packet
table (track, timestamp in ticks of the file's scale, byte range of each frame), the cue points and the tracks; it
follows element sizes of any length, unknown sizes of segments and clusters, block groups, and Xiph, EBML and fixed lacing.

Edge cases: null and empty texts become one frame of padding; texts of any length are whole (a document's file is held
once in memory); equal texts give equal files; an empty table gives no rows; extra columns are not read; damaged files
raise ValueError with the offset.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridweave.llm.common import documents

FRAME = 576
RATE = 8000

# Element ids of the Matroska specification.
EBML, EBML_VERSION, EBML_READ_VERSION, EBML_MAX_ID, EBML_MAX_SIZE, DOC_TYPE, DOC_TYPE_VERSION, DOC_TYPE_READ = 0x1A45DFA3, 0x4286, 0x42F7, 0x42F2, 0x42F3, 0x4282, 0x4287, 0x4285
SEGMENT, INFO, TIMESTAMP_SCALE, MUXING_APP, WRITING_APP = 0x18538067, 0x1549A966, 0x2AD7B1, 0x4D80, 0x5741
TRACKS, TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, FLAG_LACING, DEFAULT_DURATION, CODEC_ID = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x9C, 0x23E383, 0x86
AUDIO, SAMPLING, CHANNELS, BIT_DEPTH = 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER, TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1
CUES, CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
TOP = {CLUSTER, CUES, INFO, TRACKS, 0x114D9B74, 0x1941A469, 0x1043A770, 0x1254C367}
NO_LACING, XIPH, FIXED, EBML_LACING = 0, 1, 2, 3


def size_vint(n: int, width: int = 0) -> bytes:
    """A size as a variable-length integer; all ones are kept for an unknown size."""
    width = width or next(w for w in range(1, 9) if n < (1 << 7 * w) - 1)
    return (n | 1 << 7 * width).to_bytes(width, "big")


def element(ident: int, body: bytes) -> bytes:
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + size_vint(len(body)) + body


def number(ident: int, n: int) -> bytes:
    return element(ident, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def lace(frames: list[bytes], lacing: int) -> bytes:
    """The head of a lace (count and sizes) for 2 to 256 frames, or nothing without lacing."""
    if lacing == NO_LACING:
        return b""
    count, sizes = bytes([len(frames) - 1]), [len(f) for f in frames]
    if lacing == XIPH:
        return count + b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    if lacing == EBML_LACING:
        out = count + size_vint(sizes[0])
        for a, b in zip(sizes, sizes[1:-1], strict=False):
            width = next(w for w in range(1, 9) if abs(b - a) < (1 << 7 * w - 1) - 1)
            out += size_vint(b - a + (1 << 7 * width - 1) - 1, width)
        return out
    return count


def block(track: int, relative: int, frames: list[bytes], lacing: int) -> bytes:
    return size_vint(track) + struct.pack(">hB", relative, 0x80 | lacing << 1) + lace(frames, lacing) + b"".join(frames)


def mux(payload: bytes, frame: int = FRAME, per_block: int = 8, per_cluster: int = 64, lacing: int = FIXED) -> bytes:
    """An audio file of 8-bit samples: frames of equal length, laced in blocks; a cue for every cluster. Ticks are samples."""
    start = element(EBML, number(EBML_VERSION, 1) + number(EBML_READ_VERSION, 1) + number(EBML_MAX_ID, 4) + number(EBML_MAX_SIZE, 8) + element(DOC_TYPE, b"matroska") + number(DOC_TYPE_VERSION, 4) + number(DOC_TYPE_READ, 2))
    info = element(INFO, number(TIMESTAMP_SCALE, 10**9 // RATE) + element(MUXING_APP, b"gridweave") + element(WRITING_APP, b"gridweave"))
    audio = element(AUDIO, element(SAMPLING, struct.pack(">d", RATE)) + number(CHANNELS, 1) + number(BIT_DEPTH, 8))
    tracks = element(TRACKS, element(TRACK_ENTRY, number(TRACK_NUMBER, 1) + number(TRACK_UID, 1) + number(TRACK_TYPE, 2) + number(FLAG_LACING, 1) + number(DEFAULT_DURATION, frame * 10**9 // RATE) + element(CODEC_ID, b"A_PCM/INT/LIT") + audio))
    parts, cues, at = [info, tracks], [], len(info) + len(tracks)
    # Relative timestamps are 16-bit; a cluster's last block starts at most this many frames after its first.
    per_cluster = max(1, min(per_cluster, 32767 // frame // per_block * per_block))
    for c in range(0, len(payload), frame * per_cluster):
        blocks = [number(TIMESTAMP, c)]
        for b in range(c, min(len(payload), c + frame * per_cluster), frame * per_block):
            end = min(len(payload), b + frame * per_block, c + frame * per_cluster)
            frames = [payload[i : i + frame] for i in range(b, end, frame)]
            blocks.append(element(SIMPLE_BLOCK, block(1, b - c, frames, NO_LACING if len(frames) == 1 else EBML_LACING if len(frames[-1]) < frame else lacing)))
        cues.append(element(CUE_POINT, number(CUE_TIME, c) + element(CUE_TRACK_POSITIONS, number(CUE_TRACK, 1) + number(CUE_CLUSTER, at))))
        parts.append(element(CLUSTER, b"".join(blocks)))
        at += len(parts[-1])
    return start + element(SEGMENT, b"".join(parts) + element(CUES, b"".join(cues)))


@dataclass
class Media:
    """What a file holds: packets are (track, timestamp, start, length, cluster)."""

    packets: list[tuple[int, int, int, int, int]] = field(default_factory=list)
    cues: list[tuple[int, int, int]] = field(default_factory=list)
    tracks: dict[int, str] = field(default_factory=dict)
    durations: dict[int, int] = field(default_factory=dict)
    clusters: list[tuple[int, int]] = field(default_factory=list)
    scale: int = 1_000_000
    doc_type: str = ""


def vint(data: bytes, at: int, end: int, keep: bool = False) -> tuple[int, int, int]:
    """Value, offset after it and width of the variable-length integer at an offset. keep: with its length marker."""
    if at >= end or not data[at]:
        raise ValueError(f"no variable-length integer at {at}")
    width = 9 - data[at].bit_length()
    if at + width > end:
        raise ValueError(f"the integer at {at} is cut off")
    value = int.from_bytes(data[at : at + width], "big")
    return value if keep else value ^ 1 << 7 * width, at + width, width


def head(data: bytes, at: int, end: int) -> tuple[int, int, int | None]:
    """Id, body start and body end of the element at an offset; the end of an unknown size is None."""
    ident, body, _ = vint(data, at, end, keep=True)
    size, body, width = vint(data, body, end)
    if size == (1 << 7 * width) - 1:
        return ident, body, None
    if body + size > end:
        raise ValueError(f"element at {at} runs beyond its parent")
    return ident, body, body + size


def children(data: bytes, at: int, end: int) -> Iterator[tuple[int, int, int, int]]:
    """(id, element start, body start, body end) of each element.

    A segment or cluster of unknown size ends before the next element of its own or a higher level. Its elements are
    stepped over to find that, those of an unknown size being entered, so each byte range is walked once a level.
    """
    while at < end:
        ident, body, last = head(data, at, end)
        if last is None:
            if ident not in (SEGMENT, CLUSTER):
                raise ValueError(f"element of unknown size at {at}")
            beyond = {EBML, SEGMENT} if ident == SEGMENT else TOP | {EBML, SEGMENT}
            last = body
            while last < end:
                inner, start, stop = head(data, last, end)
                if inner in beyond:
                    break
                last = start if stop is None else stop
        yield ident, at, body, last
        at = last


def unlace(data: bytes, at: int, end: int, lacing: int) -> list[tuple[int, int]]:
    """(start, length) of each frame of a block's body."""
    if lacing == NO_LACING:
        return [(at, end - at)]
    if at >= end:
        raise ValueError(f"the lace at {at} is cut off")
    count, at = data[at] + 1, at + 1
    if lacing == FIXED:
        if (end - at) % count:
            raise ValueError(f"frames at {at} aren't of one size")
        return [(at + i * ((end - at) // count), (end - at) // count) for i in range(count)]
    sizes: list[int] = []
    for i in range(count - 1):
        if lacing == XIPH:
            n = 255
            total = 0
            while n == 255:
                if at >= end:
                    raise ValueError(f"the lace at {at} is cut off")
                n, at = data[at], at + 1
                total += n
            n = total
        else:
            n, at, width = vint(data, at, end)
            if i:
                n = sizes[-1] + n - (1 << 7 * width - 1) + 1
        sizes.append(n)
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError(f"lace sizes at {at} don't fit their block")
    out = []
    for n in sizes:
        out.append((at, n))
        at += n
    return out


def parse(data: bytes) -> Media:
    out = Media()
    uint = lambda a, b: int.from_bytes(data[a:b], "big")

    def text(a: int, b: int) -> str:
        try:
            return data[a:b].rstrip(b"\0").decode()
        except UnicodeDecodeError as e:
            raise ValueError(f"text at {a} isn't UTF-8") from e

    def frames(a: int, b: int, base: int, cluster: int) -> None:
        track, a, _ = vint(data, a, b)
        if a + 3 > b:
            raise ValueError(f"the block head at {a} is cut off")
        relative, flags = struct.unpack_from(">hB", data, a)
        step = out.durations.get(track, 0)
        for i, (start, n) in enumerate(unlace(data, a + 3, b, flags >> 1 & 3)):
            # A lace has one timestamp; its further frames follow at the track's default duration.
            out.packets.append((track, base + relative + i * step // out.scale, start, n, cluster))

    for top, _, a, b in children(data, 0, len(data)):
        if top == EBML:
            out.doc_type = next((text(x, y) for i, _, x, y in children(data, a, b) if i == DOC_TYPE), "matroska")
        if top != SEGMENT:
            continue
        for ident, begin, x, y in children(data, a, b):
            if ident == INFO:
                out.scale = next((uint(p, q) for i, _, p, q in children(data, x, y) if i == TIMESTAMP_SCALE), out.scale)
                if not out.scale:
                    raise ValueError(f"the timestamp scale at {x} is 0")
            elif ident == TRACKS:
                for i, _, p, q in children(data, x, y):
                    if i == TRACK_ENTRY:
                        known = {j: (r, s) for j, _, r, s in children(data, p, q)}
                        if TRACK_NUMBER not in known or CODEC_ID not in known:
                            raise ValueError(f"the track at {p} lacks its number or codec")
                        track = uint(*known[TRACK_NUMBER])
                        out.tracks[track] = text(*known[CODEC_ID])
                        out.durations[track] = uint(*known[DEFAULT_DURATION]) if DEFAULT_DURATION in known else 0
            elif ident == CLUSTER:
                base = 0
                out.clusters.append((begin, y - begin))
                for i, _, p, q in children(data, x, y):
                    if i == TIMESTAMP:
                        base = uint(p, q)
                    elif i == SIMPLE_BLOCK:
                        frames(p, q, base, begin - a)
                    elif i == BLOCK_GROUP:
                        for j, _, r, s in children(data, p, q):
                            if j == BLOCK:
                                frames(r, s, base, begin - a)
            elif ident == CUES:
                for i, _, p, q in children(data, x, y):
                    if i == CUE_POINT:
                        time, track, where = 0, 0, 0
                        for j, _, r, s in children(data, p, q):
                            if j == CUE_TIME:
                                time = uint(r, s)
                            elif j == CUE_TRACK_POSITIONS:
                                for k, _, t, u in children(data, r, s):
                                    track, where = (uint(t, u), where) if k == CUE_TRACK else (track, uint(t, u)) if k == CUE_CLUSTER else (track, where)
                        out.cues.append((time, track, where))
    return out


def pad(text: bytes, frame: int = FRAME) -> bytes:
    """The text and bytes 255 up to a positive multiple of the frame."""
    return text + b"\xff" * (frame * max(1, -(-len(text) // frame)) - len(text))


PACKETS = "doc_id long, track int, timestamp long, start long, length long, cluster long"
MEDIA = "doc_id long, n_bytes long, media binary"


def encode(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and the text's media file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [(t or "").encode() for t in part.column("text").to_pylist()]
                yield pa.record_batch([part.column("doc_id"), pa.array(map(len, texts), pa.int64()), pa.array([mux(pad(t)) for t in texts], pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, MEDIA)


def packets(media: DataFrame) -> DataFrame:
    """The packet table of a column of files: one row per frame."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, data in zip(batch.column("doc_id").to_pylist(), batch.column("media"), strict=True):
                found = parse(data.as_py()).packets
                cols = [[doc] * len(found), *(list(c) for c in zip(*found, strict=True))] if found else [[]] * 6
                yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), *[pa.int64()] * 4), strict=True)], names=[x.split()[0] for x in PACKETS.split(", ")])

    return media.select("doc_id", "media").mapInArrow(run, PACKETS)


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def digests(media: DataFrame) -> DataFrame:
    """Parses every file, reads the payload back by the packets' byte ranges, and describes both.

    feature: packets, clusters, cues that point at a cluster's start, last timestamp, track codec, mean level of the samples.
    """

    def one(doc: int | None, n: int, data: bytes) -> tuple:
        found = parse(data)
        payload = b"".join(data[s : s + k] for _, _, s, k, _ in found.packets)
        starts = {c for *_, c in found.packets}
        good = sum(where in starts for _, _, where in found.cues)
        feature = f"packets={len(found.packets)};clusters={len(found.clusters)};cues={good};last={found.packets[-1][1] if found.packets else 0};codec={found.tracks.get(1)};mean={sum(payload) // max(len(payload), 1)}"
        return doc, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data), hashlib.sha256(data).hexdigest(), feature

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        for b in batches:
            rows = [one(d, n, m.as_py()) for d, n, m in zip(b.column("doc_id").to_pylist(), b.column("n_bytes").to_pylist(), b.column("media"), strict=True)]
            cols = list(zip(*rows, strict=True)) or [[]] * 8
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in DIGEST.split(", ")])

    return media.mapInArrow(run, DIGEST)


def op3_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(encode(documents(spark, sf_dir)))
