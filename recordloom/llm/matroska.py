"""Media columns: Matroska files in a binary column, and their packet and cue tables.

:func:`store` wraps a payload losslessly as 8-bit PCM in a Matroska file (EBML header, segment, info, tracks,
clusters of laced blocks, cues).  :func:`packets` parses any such column into one row for each frame: track,
timestamp, key flag, lacing, and the byte range in the file.  :func:`cues` gives the cue points, and
:func:`read_back` the payload with figures about the packets.  All are per-row work in Arrow batches, without a
shuffle.

Null media gives no packets.  A file that ends early, or whose sizes reach past their parent, raises
``ValueError`` in :func:`parse`; the table functions give such a file one row with ``error`` set instead.
Repeated rows give repeated results, an empty table an empty one.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.llm.common import texts, tidy

# Element ids of the Matroska specification.
EBML, DOCTYPE, SEGMENT, INFO, SCALE, DURATION = 0x1A45DFA3, 0x4282, 0x18538067, 0x1549A966, 0x2AD7B1, 0x4489
TRACKS, ENTRY, NUMBER, UID, KIND, LACING_FLAG, CODEC = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x9C, 0x86
AUDIO, RATE, CHANNELS, DEPTH, DEFAULT_DURATION = 0xE1, 0xB5, 0x9F, 0x6264, 0x23E383
CLUSTER, CLUSTER_TIME, SIMPLE_BLOCK, GROUP, BLOCK, REFERENCE = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1, 0xFB
CUES, CUE_POINT, CUE_TIME, CUE_PLACE, CUE_TRACK, CUE_CLUSTER = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
PARENTS = {SEGMENT, INFO, TRACKS, ENTRY, AUDIO, CLUSTER, GROUP, CUES, CUE_POINT, CUE_PLACE}
#: Elements that end an element of unknown size.
TOP = {CLUSTER, CUES, TRACKS, INFO}
LACES = ("none", "xiph", "fixed", "ebml")

#: The layout :func:`mux` writes: bytes of a frame, frames of a block, blocks of a cluster, samples a second.
FRAME, FRAMES, BLOCKS, SAMPLES_S = 512, 8, 8, 8000
BLOCK_UNIT = 64


def size_bytes(n: int, width: int = 0) -> bytes:
    """A size as a variable-length integer; all ones is kept for unknown sizes."""
    width = width or next(w for w in range(1, 9) if n < (1 << 7 * w) - 1)
    return (n | 1 << 7 * width).to_bytes(width, "big")


def element(key: int, body: bytes) -> bytes:
    return key.to_bytes((key.bit_length() + 7) // 8, "big") + size_bytes(len(body)) + body


def number(key: int, n: int) -> bytes:
    return element(key, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def real(key: int, x: float) -> bytes:
    return element(key, struct.pack(">d", x))


def laced(frames: list[bytes], how: str) -> bytes:
    """The lace header and frames of a block, after its flags."""
    sizes = [len(x) for x in frames]
    head = bytes([len(frames) - 1])
    if how == "none":
        head = b""
    elif how == "xiph":
        head += b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    elif how == "ebml":
        head += size_bytes(sizes[0])
        for before, n in zip(sizes, sizes[1:-1], strict=False):
            d = n - before
            width = next(w for w in range(1, 9) if abs(d) < 1 << 7 * w - 1)
            head += size_bytes(d + (1 << 7 * width - 1) - 1, width)
    return head + b"".join(frames)


def _prefix() -> bytes:
    head = element(EBML, number(0x4286, 1) + number(0x42F7, 1) + number(0x42F2, 4) + number(0x42F3, 8) + element(DOCTYPE, b"matroska") + number(0x4287, 4) + number(0x4285, 2))
    audio = element(AUDIO, real(RATE, SAMPLES_S) + number(CHANNELS, 1) + number(DEPTH, 8))
    return head, element(TRACKS, element(ENTRY, number(NUMBER, 1) + number(UID, 1) + number(KIND, 2) + number(LACING_FLAG, 1) + element(CODEC, b"A_PCM/INT/LIT") + audio))


HEAD, TRACK = _prefix()


def mux(payload: bytes, lacing: str = "auto") -> bytes:
    """A Matroska file of one track of 8-bit samples.  ``auto`` laces equal frames as fixed, unequal ones as EBML."""
    info = element(INFO, number(SCALE, 1_000_000) + real(DURATION, len(payload) * 1000 / SAMPLES_S) + element(0x4D80, b"recordloom") + element(0x5741, b"recordloom"))
    out, points = [info, TRACK], []
    place = len(info) + len(TRACK)
    span, whole = FRAME * FRAMES, FRAME * FRAMES * BLOCKS
    for start in range(0, len(payload), whole):
        time = start * 1000 // SAMPLES_S
        body = [number(CLUSTER_TIME, time)]
        for at in range(start, min(start + whole, len(payload)), span):
            frames = [payload[i : i + FRAME] for i in range(at, min(at + span, len(payload)), FRAME)]
            how = lacing if lacing != "auto" else "fixed" if len(frames[-1]) == FRAME else "ebml"
            how = "none" if len(frames) == 1 else how
            flags = 0x80 | LACES.index(how) << 1
            body.append(element(SIMPLE_BLOCK, b"\x81" + struct.pack(">hB", at * 1000 // SAMPLES_S - time, flags) + laced(frames, how)))
        cluster = element(CLUSTER, b"".join(body))
        points.append(element(CUE_POINT, number(CUE_TIME, time) + element(CUE_PLACE, number(CUE_TRACK, 1) + number(CUE_CLUSTER, place))))
        out.append(cluster)
        place += len(cluster)
    out.append(element(CUES, b"".join(points)))
    return HEAD + element(SEGMENT, b"".join(out))


@dataclass
class Media:
    """What :func:`parse` found.  packets: (track, ns, key, lacing, block, frame, offset, size); cues: (ns, track, offset)."""

    scale: int = 1_000_000
    duration: float = 0.0
    tracks: dict[int, dict] = field(default_factory=dict)
    clusters: int = 0
    blocks: int = 0
    packets: list[tuple] = field(default_factory=list)
    cues: list[tuple] = field(default_factory=list)


def vint(data: bytes, at: int, end: int, keep: bool = False) -> tuple[int, int]:
    """A variable-length integer and the place after it; -1 is the unknown size.  keep: with its marker, as ids have it."""
    if at >= end or not data[at]:
        raise ValueError(f"no variable-length integer at byte {at}")
    width = 9 - data[at].bit_length()
    if at + width > end:
        raise ValueError(f"the file ends inside an integer at byte {at}")
    n = int.from_bytes(data[at : at + width], "big")
    if not keep:
        n &= (1 << 7 * width) - 1
        n = -1 if n == (1 << 7 * width) - 1 else n
    return n, at + width


def elements(data: bytes, at: int, end: int) -> Iterator[tuple[int, int, int]]:
    """The elements from ``at`` to ``end``: id, first and last byte of the body."""
    while at < end:
        key, at = vint(data, at, end, keep=True)
        n, at = vint(data, at, end)
        if n < 0:
            stop = end
            if key == CLUSTER:
                for k, _, _, begin in _heads(data, at, end):
                    if k in TOP:
                        stop = begin
                        break
        else:
            stop = at + n
        if stop > end:
            raise ValueError(f"element {key:x} at byte {at} reaches past its parent")
        yield key, at, stop
        at = stop


def _heads(data: bytes, at: int, end: int):
    while at < end:
        begin = at
        key, at = vint(data, at, end, keep=True)
        n, at = vint(data, at, end)
        yield key, at, n, begin
        if n < 0:
            return
        at += n


def _frames(data: bytes, at: int, end: int, how: int) -> list[tuple[int, int]]:
    """Offset and size of each frame of a block."""
    if not how:
        return [(at, end - at)]
    if at >= end:
        raise ValueError("a laced block without a frame count")
    count, at = data[at] + 1, at + 1
    sizes: list[int] = []
    if how == 2:
        if (end - at) % count:
            raise ValueError("a fixed lace of unequal frames")
        sizes = [(end - at) // count] * (count - 1)
    elif how == 1:
        for _ in range(count - 1):
            n = 0
            while True:
                if at >= end:
                    raise ValueError("a lace ends early")
                n, at = n + data[at], at + 1
                if data[at - 1] != 255:
                    break
            sizes.append(n)
    elif count > 1:
        n, at = vint(data, at, end)
        sizes.append(n)
        for _ in range(count - 2):
            begin = at
            d, at = vint(data, at, end)
            if d < 0:
                d = (1 << 7 * (at - begin)) - 1
            n += d - ((1 << 7 * (at - begin) - 1) - 1)
            sizes.append(n)
    out = []
    for n in sizes:
        out.append((at, n))
        at += n
    if at > end or any(n < 0 for n in sizes):
        raise ValueError("a lace longer than its block")
    return [*out, (at, end - at)]


def parse(data: bytes) -> Media:
    """All packets and cues of a Matroska file."""
    m = Media()
    base = 0
    found = False

    def uint(a: int, b: int) -> int:
        return int.from_bytes(data[a:b], "big")

    def flt(a: int, b: int) -> float:
        if b - a not in (0, 4, 8):
            raise ValueError("a float of another size than 0, 4 or 8 bytes")
        return struct.unpack(">f" if b - a == 4 else ">d", data[a:b])[0] if b > a else 0.0

    def fits(n: int) -> int:
        if abs(n) >= 1 << 63:
            raise ValueError("a number beyond 64 bits")
        return n

    def block(a: int, b: int, time: int, key: bool | None) -> None:
        track, a = vint(data, a, b)
        if a + 3 > b:
            raise ValueError("a block without a header")
        rel, flags = struct.unpack(">hB", data[a : a + 3])
        how = flags >> 1 & 3
        for i, (at, n) in enumerate(_frames(data, a + 3, b, how)):
            m.packets.append((track, fits((time + rel) * m.scale), bool(flags & 0x80) if key is None else key, LACES[how], m.blocks, i, at, n))
        m.blocks += 1

    for top, a0, b0 in elements(data, 0, len(data)):
        if top != SEGMENT:
            continue
        found, base = True, a0
        for key, a, b in elements(data, a0, b0):
            if key == INFO:
                for k, x, y in elements(data, a, b):
                    if k == SCALE:
                        m.scale = uint(x, y)
                    elif k == DURATION:
                        m.duration = flt(x, y)
            elif key == TRACKS:
                for _, x, y in (e for e in elements(data, a, b) if e[0] == ENTRY):
                    t: dict = {}
                    for k, p, q in elements(data, x, y):
                        if k in (NUMBER, KIND, DEFAULT_DURATION):
                            t[k] = uint(p, q)
                        elif k == CODEC:
                            t["codec"] = data[p:q].decode("latin-1")
                        elif k == AUDIO:
                            for kk, pp, qq in elements(data, p, q):
                                t[kk] = flt(pp, qq) if kk == RATE else uint(pp, qq)
                    m.tracks[t.get(NUMBER, 0)] = t
            elif key == CLUSTER:
                time = 0
                m.clusters += 1
                for k, x, y in elements(data, a, b):
                    if k == CLUSTER_TIME:
                        time = uint(x, y)
                    elif k == SIMPLE_BLOCK:
                        block(x, y, time, None)
                    elif k == GROUP:
                        inside = list(elements(data, x, y))
                        whole = not any(e[0] == REFERENCE for e in inside)
                        for _, p, q in (e for e in inside if e[0] == BLOCK):
                            block(p, q, time, whole)
            elif key == CUES:
                for _, x, y in (e for e in elements(data, a, b) if e[0] == CUE_POINT):
                    when = 0
                    for k, p, q in elements(data, x, y):
                        if k == CUE_TIME:
                            when = uint(p, q)
                        elif k == CUE_PLACE:
                            inner = {kk: uint(pp, qq) for kk, pp, qq in elements(data, p, q)}
                            m.cues.append((fits(when * m.scale), fits(inner.get(CUE_TRACK, 0)), fits(base + inner.get(CUE_CLUSTER, 0))))
    if not found:
        raise ValueError("no segment")
    # Frames of a lace follow each other by the track's rate where it has one.
    for i, p in enumerate(m.packets):
        rate = m.tracks.get(p[0], {}).get(RATE, 0)
        if p[5] and rate and m.tracks[p[0]].get("codec", "").startswith("A_PCM"):
            width = max(1, m.tracks[p[0]].get(DEPTH, 8) // 8 * m.tracks[p[0]].get(CHANNELS, 1))
            before = m.packets[i - 1]
            step = before[7] // width * 1_000_000_000 / rate
            if not math.isfinite(step):
                raise ValueError("a rate that gives no time")
            m.packets[i] = (p[0], fits(before[1] + int(step)), *p[2:])
    return m


def padded(data: bytes, unit: int = BLOCK_UNIT) -> bytes:
    """``data`` and bytes 0 up to a positive multiple of ``unit``."""
    return data + bytes(-len(data) % unit or (0 if data else unit))


def store(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lacing: str = "auto") -> DataFrame:
    """``(id, n_bytes, media)``: each text's UTF-8 bytes, padded, as a Matroska file.  A null text is empty."""

    def each(batches):
        for b in batches:
            raw = [x.encode("utf-8", "surrogatepass") for x in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([len(x) for x in raw], pa.int64()), pa.array([mux(padded(x), lacing) for x in raw], pa.binary())], ["id", "n_bytes", "media"])

    src = texts(df, id_col, text_col)
    return src.mapInArrow(tidy(each), f"id {src.schema['id'].dataType.simpleString()}, n_bytes bigint, media binary")


def _feature(m: Media, payload: bytes) -> str:
    """Packets, clusters, blocks and cues, duration in ms, and mean, energy and zero crossings of the samples."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    crossings = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    return f"packets={len(m.packets)};clusters={m.clusters};blocks={m.blocks};cues={len(m.cues)};ms={m.duration:.3f};sum={int(x.sum())};energy={int((x * x).sum())};crossings={crossings}"


def read_back(df: DataFrame, id_col: str = "id", media_col: str = "media", keep: tuple[str, ...] = ()) -> DataFrame:
    """``(id, *keep, media_bytes, payload, feature, error)`` of a media column; the payload is the frames' bytes in order."""
    src = df.select(F.col(id_col).alias("id"), *keep, F.col(media_col).alias("media"))

    def each(batches):
        for b in batches:
            rows = []
            for data in b.column("media").to_pylist():
                try:
                    if data is None:
                        raise ValueError("no media")
                    m = parse(data)
                    payload = b"".join(data[p[6] : p[6] + p[7]] for p in m.packets)
                    rows.append((len(data), payload, _feature(m, payload), None))
                except ValueError as e:
                    rows.append((len(data or b""), None, None, str(e)))
            cols = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("id", *keep)), *(pa.array(list(c), t) for c, t in zip(cols, (pa.int64(), pa.binary(), pa.string(), pa.string()), strict=True))], ["id", *keep, "media_bytes", "payload", "feature", "error"])

    kinds = ", ".join(f"{c} {src.schema[c].dataType.simpleString()}" for c in ("id", *keep))
    return src.mapInArrow(tidy(each), f"{kinds}, media_bytes bigint, payload binary, feature string, error string")


def _table(df: DataFrame, id_col: str, media_col: str, names: list[tuple[str, pa.DataType]], rows_of, schema: str) -> DataFrame:
    src = df.select(F.col(id_col).alias("id"), F.col(media_col).alias("media"))

    def each(batches):
        for b in batches:
            ids, rows = [], []
            for i, data in enumerate(b.column("media").to_pylist()):
                if data is None:
                    continue
                try:
                    found = [(*r, None) for r in rows_of(parse(data))]
                except ValueError as e:
                    found = [(*[None] * len(names), str(e))]
                ids += [i] * len(found)
                rows += found
            cols = list(zip(*rows, strict=True)) or [[]] * (len(names) + 1)
            yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(ids, pa.int64())), *(pa.array(list(c), t) for c, t in zip(cols, [*(k for _, k in names), pa.string()], strict=True))], ["id", *(n for n, _ in names), "error"])

    return src.mapInArrow(tidy(each), f"id {src.schema['id'].dataType.simpleString()}, {schema}, error string")


def packets(df: DataFrame, id_col: str = "id", media_col: str = "media") -> DataFrame:
    """One row for each frame: track, timestamp in ns, key flag, lacing, block, frame of the block, byte range."""
    names = [("track", pa.int64()), ("ts_ns", pa.int64()), ("keyframe", pa.bool_()), ("lacing", pa.string()), ("block", pa.int64()), ("frame", pa.int32()), ("byte_offset", pa.int64()), ("byte_size", pa.int64())]
    return _table(df, id_col, media_col, names, lambda m: m.packets, "track bigint, ts_ns bigint, keyframe boolean, lacing string, block bigint, frame int, byte_offset bigint, byte_size bigint")


def cues(df: DataFrame, id_col: str = "id", media_col: str = "media") -> DataFrame:
    """One row for each cue point: time in ns, track, and the byte its cluster begins at."""
    return _table(df, id_col, media_col, [("ts_ns", pa.int64()), ("track", pa.int64()), ("byte_offset", pa.int64())], lambda m: m.cues, "ts_ns bigint, track bigint, byte_offset bigint")


def digest(docs: DataFrame) -> DataFrame:
    """The digest columns of every text of ``docs``: stored as Matroska, read back, and hashed."""
    back = read_back(store(docs).withColumn("media_sha256", F.sha2("media", 256)), keep=("n_bytes", "media_sha256"))
    return back.select(
        F.col("id").alias("doc_id"), "n_bytes", F.octet_length("payload").cast("bigint").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -64)")).alias("tail_crc32"), "media_bytes", "media_sha256", "feature",
    )
