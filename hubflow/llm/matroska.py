"""Media columns: Matroska files in a binary column, parsed into packets with track, time and byte range."""

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of the Matroska format: element ids, and which of them hold elements.
EBML, SEGMENT, INFO, TRACKS, TRACK, AUDIO, CLUSTER, GROUP, CUES, CUE, CUE_AT = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0xAE, 0xE1, 0x1F43B675, 0xA0, 0x1C53BB6B, 0xBB, 0xB7
SCALE, TRACK_NUMBER, TRACK_TYPE, CODEC, RATE, CHANNELS, DEPTH = 0x2AD7B1, 0xD7, 0x83, 0x86, 0xB5, 0x9F, 0x6264
TIMESTAMP, SIMPLE, BLOCK, REFERENCE, CUE_TIME, CUE_TRACK, CUE_POSITION = 0xE7, 0xA3, 0xA1, 0xFB, 0xB3, 0xF7, 0xF1
HOLDERS = {SEGMENT, INFO, TRACKS, TRACK, AUDIO, CLUSTER, GROUP, CUES, CUE, CUE_AT}
SEEK_HEAD, CHAPTERS, TAGS, ATTACHMENTS = 0x114D9B74, 0x1043A770, 0x1254C367, 0x1941A469
DOC_TYPE, NO_LACING, XIPH, FIXED, VARIABLE = 0x4282, 0, 1, 2, 3
UNKNOWN = -1


def read_id(data: bytes, at: int) -> tuple[int, int]:
    """An element id, its marker bit kept, and where its size begins."""
    if at >= len(data) or not data[at]:
        raise ValueError(f"no element at byte {at}")
    n = 9 - data[at].bit_length()
    return int.from_bytes(data[at : at + n]), at + n


def read_size(data: bytes, at: int) -> tuple[int, int]:
    """A variable-length integer without its marker bit, UNKNOWN where all its bits are set, and the next byte's place."""
    if at >= len(data) or not data[at]:
        raise ValueError(f"no size at byte {at}")
    n = 9 - data[at].bit_length()
    if at + n > len(data):
        raise ValueError(f"a size is cut at byte {at}")
    value = int.from_bytes(data[at : at + n]) & ((1 << 7 * n) - 1)
    return (UNKNOWN if value == (1 << 7 * n) - 1 else value), at + n


def write_size(value: int, n: int = 0) -> bytes:
    n = n or next(k for k in range(1, 9) if value < (1 << 7 * k) - 1)
    return (value | 1 << 7 * n).to_bytes(n)


def element(name: int, body: bytes) -> bytes:
    return name.to_bytes(-(-name.bit_length() // 8)) + write_size(len(body)) + body


def number(name: int, value: int) -> bytes:
    return element(name, value.to_bytes(max(1, -(-value.bit_length() // 8))))


def elements(data: bytes, at: int = 0, end: int | None = None, parent: int = 0):
    """(id, begin, end of the content, parent) of all elements in order, also of those inside others; one of unknown size ends with its holder."""
    end = len(data) if end is None else end
    while at < end:
        name, k = read_id(data, at)
        size, begin = read_size(data, k)
        stop = end if size == UNKNOWN else begin + size
        if stop > end:
            raise ValueError(f"element {name:X} at byte {at} ends beyond its holder")
        if size == UNKNOWN and name == CLUSTER:
            stop = cluster_end(data, begin, end)
        yield name, begin, stop, parent
        if name in HOLDERS:
            yield from elements(data, begin, stop, name)
        at = stop


def cluster_end(data: bytes, at: int, end: int) -> int:
    """The end of a cluster of unknown size: the next element that stands beside clusters."""
    while at < end:
        name, k = read_id(data, at)
        if name in (CLUSTER, CUES, INFO, TRACKS, SEEK_HEAD, CHAPTERS, TAGS, ATTACHMENTS):
            return at
        size, begin = read_size(data, k)
        at = begin + size
    return end


def laced(data: bytes, at: int, end: int, kind: int) -> list[tuple[int, int]]:
    """Byte ranges of the frames in a block, from behind its flags on."""
    if kind == NO_LACING:
        return [(at, end)]
    n, at = data[at] + 1, at + 1
    sizes: list[int] = []
    if kind == XIPH:
        for _ in range(n - 1):
            size = 0
            while data[at] == 255:
                size, at = size + 255, at + 1
            sizes.append(size + data[at])
            at += 1
    elif kind == VARIABLE:
        for i in range(n - 1):
            width = 9 - data[at].bit_length()
            value, at = read_size(data, at)
            sizes.append(value if not i else sizes[-1] + value - ((1 << 7 * width - 1) - 1))
    else:
        sizes = [(end - at) // n] * (n - 1)
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0 or kind == FIXED and len(set(sizes)) > 1:
        raise ValueError(f"lacing beyond its block at byte {at}")
    ends = np.cumsum(sizes).tolist()
    return [(at + e - s, at + e) for s, e in zip(sizes, ends, strict=True)]


def packets(data: bytes) -> list[tuple[int, int, int, int, bool, int, bool]]:
    """(track, time_ns, begin, end, keyframe, frame, cued) of every packet; frame: its place in its block, cued: whether a cue points to its cluster at that time.

    A simple block says itself whether it is a keyframe; a block in a group is one unless the group refers to another block.
    """
    group, refers = 0, False
    scale, cluster, cluster_at, segment, out, cues, cue, tracks = 1_000_000, 0, 0, 0, [], set(), [0, 0, 0], {}
    for name, begin, end, parent in elements(data):
        if name == SEGMENT:
            segment = begin
        elif name == SCALE:
            scale = int.from_bytes(data[begin:end])
        elif name == TRACK_NUMBER and parent == TRACK:
            tracks[int.from_bytes(data[begin:end])] = len(tracks)
        elif name == CLUSTER:
            cluster_at = begin
        elif name == TIMESTAMP:
            cluster = int.from_bytes(data[begin:end])
        elif name == GROUP:
            group, refers = len(out), False
        elif name == REFERENCE and parent == GROUP:
            refers = True
            out[group:] = [(*x[:4], False, *x[5:]) for x in out[group:]]
        elif name in (SIMPLE, BLOCK):
            track, at = read_size(data, begin)
            time = cluster + int.from_bytes(data[at : at + 2], signed=True)
            flags = data[at + 2]
            for i, (b, e) in enumerate(laced(data, at + 3, end, flags >> 1 & 3)):
                out.append((track, time * scale, b, e, not refers if name == BLOCK else bool(flags & 128), i, (cluster_at, track, time)))
        elif name in (CUE_TIME, CUE_TRACK, CUE_POSITION):
            cue[(CUE_TIME, CUE_TRACK, CUE_POSITION).index(name)] = int.from_bytes(data[begin:end])
            if name == CUE_POSITION:
                at = segment + cue[2]
                where, k = read_id(data, at)
                if where != CLUSTER:
                    raise ValueError(f"a cue points to byte {at}, where no cluster begins")
                cues.add((read_size(data, k)[1], cue[1], cue[0]))
    return [(*x[:6], x[6] in cues) for x in out]


def lace(frames: list[bytes], kind: int) -> bytes:
    """The part of a block behind its flags."""
    if kind == NO_LACING:
        (frame,) = frames
        return frame
    head = bytes([len(frames) - 1])
    sizes = [len(x) for x in frames]
    if kind == XIPH:
        head += b"".join(b"\xff" * (s // 255) + bytes([s % 255]) for s in sizes[:-1])
    elif kind == VARIABLE and len(frames) > 1:
        head += write_size(sizes[0])
        for a, b in zip(sizes[:-2], sizes[1:-1], strict=True):
            n = next(k for k in range(1, 9) if abs(b - a) < (1 << 7 * k - 1) - 1)
            head += write_size(b - a + (1 << 7 * n - 1) - 1, n)
    return head + b"".join(frames)


#: Frames of a written file: bytes of a frame, frames of a block, blocks of a cluster.
FRAME, LACED, CLUSTERED = 192, 64, 16
RATE_HZ = 8000


def audio_file(payload: bytes, kind: int = FIXED) -> bytes:
    """A Matroska file of one track of 8-bit samples at 8000 a second: frames of 192 bytes, laced in blocks, in clusters with a cue each."""
    head = element(EBML, element(DOC_TYPE, b"matroska"))
    info = element(INFO, number(SCALE, 1_000_000))
    audio = element(AUDIO, element(RATE, struct.pack(">d", RATE_HZ)) + number(CHANNELS, 1) + number(DEPTH, 8))
    tracks = element(TRACKS, element(TRACK, number(TRACK_NUMBER, 1) + number(TRACK_TYPE, 2) + element(CODEC, b"A_PCM/INT/LIT") + audio))
    body, cues, at, per_cluster, per_block = [info, tracks], [], len(info) + len(tracks), FRAME * LACED * CLUSTERED, FRAME * LACED
    for begin in range(0, len(payload), per_cluster):
        start = begin * 1000 // RATE_HZ
        blocks = [number(TIMESTAMP, start)]
        for b in range(begin, min(begin + per_cluster, len(payload)), per_block):
            block = payload[b : min(b + per_block, begin + per_cluster)]
            frames = [block[i : i + FRAME] for i in range(0, len(block), FRAME)]
            here = kind if len(frames) > 1 else NO_LACING
            blocks.append(element(SIMPLE, write_size(1) + (b * 1000 // RATE_HZ - start).to_bytes(2, signed=True) + bytes([128 | here << 1]) + lace(frames, here)))
        cues.append(element(CUE, number(CUE_TIME, start) + element(CUE_AT, number(CUE_TRACK, 1) + number(CUE_POSITION, at))))
        body.append(element(CLUSTER, b"".join(blocks)))
        at += len(body[-1])
    return head + element(SEGMENT, b"".join([*body, element(CUES, b"".join(cues))]))


def store_texts(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: each text's UTF-8, with spaces up to a positive multiple of 192 bytes, as the samples of a Matroska file. Null texts count as empty."""

    def store(batches):
        for batch in batches:
            texts = [(x or "").encode() for x in batch["text"].to_pylist()]
            media = [audio_file(x.ljust(max(FRAME, -(-len(x) // FRAME) * FRAME))) for x in texts]
            yield pa.record_batch([batch["doc_id"], pa.array([len(x) for x in texts], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(store, "doc_id long, n_bytes long, media binary")


PACKETS = "doc_id long, track int, packet long, time_ns long, begin long, end long, keyframe boolean, frame int, cued boolean, error string"


def packet_table(files: DataFrame) -> DataFrame:
    """A row for each packet of each file in files (doc_id, media): track, packet (its number in the file), time_ns of its block, byte range [begin, end), keyframe, frame (its place in a laced block), cued, error.

    A null or empty file has no packets. A file that can't be parsed gives one row whose error says why; its other
    columns but doc_id are null. Equal rows give equal packets, each for itself.
    """

    def parse(batches):
        for batch in batches:
            rows = []
            for doc, data in zip(batch["doc_id"].to_pylist(), batch["media"].to_pylist(), strict=True):
                try:
                    rows += [(doc, p[0], i, *p[1:], None) for i, p in enumerate(packets(data or b""))]
                except (ValueError, IndexError) as e:
                    rows.append((doc, *[None] * 8, str(e)))
                if len(rows) > 50_000:
                    yield to_batch(rows)
                    rows = []
            yield to_batch(rows)

    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.bool_(), pa.string()]
    names = [x.split()[0] for x in PACKETS.split(", ")]

    def to_batch(rows):
        return pa.record_batch([pa.array(x, k) for x, k in zip(zip(*rows, strict=True) if rows else [[]] * len(kinds), kinds, strict=True)], names=names)

    return files.select(F.col("doc_id").cast("long").alias("doc_id"), "media").mapInArrow(parse, PACKETS)


FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, packets long, clusters_cued long, feature string"


def features(files: DataFrame) -> DataFrame:
    """What the packets of each file in files (doc_id, n_bytes, media) hold: length and sha256 of their bytes in order, crc32 of the last 16, the same of the file, numbers of packets and of cued ones, and feature: mean and deviation of the samples and the share of steps of over 16 between neighbours, in this order."""

    def compute(batches):
        for batch in batches:
            out = []
            for doc, n, data in zip(batch["doc_id"].to_pylist(), batch["n_bytes"].to_pylist(), batch["media"].to_pylist(), strict=True):
                found = packets(data)
                payload = b"".join([data[p[2] : p[3]] for p in found])
                x = np.frombuffer(payload, np.uint8).astype(np.int64)
                steps = np.abs(np.diff(x)) > 16
                feature = f"{x.mean():.4f},{x.std():.4f},{steps.mean():.4f}"
                out.append((doc, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), len(found), sum(p[6] for p in found), feature))
            kinds = {"string": pa.string(), "long": pa.int64()}
            names, types = zip(*(x.split() for x in FEATURES.split(", ")), strict=True)
            yield pa.record_batch([pa.array(x, kinds[t]) for x, t in zip(zip(*out, strict=True) if out else [[]] * len(names), types, strict=True)], names=names)

    return files.mapInArrow(compute, FEATURES)


def op2_matroska(spark, sf_dir: str) -> DataFrame:
    return features(store_texts(spark.read.parquet(f"{sf_dir}/documents.parquet")))
