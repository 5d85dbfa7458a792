"""MPEG audio columns: a muxer, and a parser of tags, frame headers, seek tables and checksums.

``parse`` reads any MPEG-1/2/2.5 stream of layers I-III without decoding sound: it skips an ID3v2 tag, finds
frames by their headers (a header counts if it is valid and a like header, a tag or the end follows; between
frames it resynchronises byte by byte), reads Xing/Info and VBRI tables, an ID3v1 tag, verifies the CRC-16 of
protected layer III frames, and gives exact durations (samples over rate, not bytes over bitrate) and the offset
of every frame.

``mux`` stores bytes without loss in a valid stream: layer III frames of digital silence, in which main data is
empty and the whole rest of a frame is ancillary data.  One frame holds up to 937 bytes at 320 kbit/s; the last
one takes the lowest bitrate that holds the rest, so the stream is of variable bitrate, with a Xing table.  The
payload's length stands in a private ID3v2 frame.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .wordarrays import slices

# kbit/s by (MPEG-1?, layer): header values 1..14
_BITRATES = {
    (True, 1): [32 * i for i in range(1, 15)],
    (True, 2): [32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384],
    (True, 3): [32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320],
    (False, 1): [32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256],
    (False, 2): [8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160],
}
_BITRATES[False, 3] = _BITRATES[False, 2]
_RATES = {3: [44100, 48000, 32000], 2: [22050, 24000, 16000], 0: [11025, 12000, 8000]}  # by version bits
_OWNER = b"quillspark.payload"

_CRC_TABLE = []
for _i in range(256):
    _c = _i << 8
    for _ in range(8):
        _c = (_c << 1 ^ (0x8005 if _c & 0x8000 else 0)) & 0xFFFF
    _CRC_TABLE.append(_c)


def crc16(data: bytes, crc: int = 0xFFFF) -> int:
    """The checksum of MPEG audio: polynomial 0x8005, bits from the top, start 0xFFFF."""
    for b in data:
        crc = (crc << 8 & 0xFFFF) ^ _CRC_TABLE[crc >> 8 ^ b]
    return crc


def _header_fields(h: int) -> dict | None:
    """What a header says, or None if it is no header."""
    version, layer_bits, bitrate, rate = h >> 19 & 3, h >> 17 & 3, h >> 12 & 15, h >> 10 & 3
    if h >> 21 != 0x7FF or version == 1 or layer_bits == 0 or bitrate in (0, 15) or rate == 3 or h & 3 == 2:
        return None
    layer, mpeg1 = 4 - layer_bits, version == 3
    kbps, hz = _BITRATES[mpeg1, layer][bitrate - 1], _RATES[version][rate]
    padding = h >> 9 & 1
    if layer == 1:
        samples, length = 384, (12 * kbps * 1000 // hz + padding) * 4
    else:
        samples = 576 if layer == 3 and not mpeg1 else 1152
        length = samples // 8 * kbps * 1000 // hz + padding
    mono = h >> 6 & 3 == 3
    side = ((17 if mono else 32) if mpeg1 else (9 if mono else 17)) if layer == 3 else 0
    return {"version": version, "layer": layer, "kbps": kbps, "hz": hz, "samples": samples, "length": length, "mono": mono, "side": side, "protected": not h >> 16 & 1}


_SEEN: dict[int, dict | None] = {}


def header(h: int) -> dict | None:
    if h not in _SEEN:
        if len(_SEEN) > 1 << 14:
            _SEEN.clear()
        _SEEN[h] = _header_fields(h)
    return _SEEN[h]


def _syncsafe(b: bytes) -> int | None:
    return None if any(x & 0x80 for x in b) else b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]


def id3v2(data: bytes, at: int = 0) -> tuple[int, dict[str, bytes]]:
    """(bytes the tag takes at ``at``, 0 if there is none; its frames by name, the first of a name)."""
    if data[at : at + 3] != b"ID3" or len(data) < at + 10 or data[at + 3] in (0xFF,) or (size := _syncsafe(data[at + 6 : at + 10])) is None:
        return 0, {}
    major, flags = data[at + 3], data[at + 5]
    end, p, frames = min(len(data), at + 10 + size), at + 10, {}
    if flags & 0x40 and major >= 3 and end - p >= 4:  # extended header
        extra = _syncsafe(data[p : p + 4]) or 0 if major == 4 else int.from_bytes(data[p : p + 4], "big") + 4
        p += extra
    head, name_size = (6, 3) if major == 2 else (10, 4)
    while p + head <= end and data[p] != 0:
        name = data[p : p + name_size].decode("latin-1")
        raw = data[p + name_size : p + name_size + (3 if major == 2 else 4)]
        n = (_syncsafe(raw) if major == 4 else int.from_bytes(raw, "big")) or 0
        if not name.isalnum() or p + head + n > end:
            break
        frames.setdefault(name, data[p + head : p + head + n])
        p += head + n
    return min(len(data) - at, 10 + size + 10 * bool(flags & 0x10 and major == 4)), frames


def _table(frame: bytes, f: dict) -> dict | None:
    """A Xing/Info or VBRI table of a first frame."""
    at = 4 + f["side"]  # the table stands after side information, whether or not a checksum is declared
    for place in (at, at + 2):
        if frame[place : place + 4] in (b"Xing", b"Info"):
            out = {"kind": frame[place : place + 4].decode(), "frames": None, "bytes": None, "toc": None}
            flags, p = int.from_bytes(frame[place + 4 : place + 8], "big"), place + 8
            for bit, name in ((1, "frames"), (2, "bytes")):
                if flags & bit:
                    out[name] = int.from_bytes(frame[p : p + 4], "big")
                    p += 4
            if flags & 4:
                out["toc"] = list(frame[p : p + 100])
            return out
    if frame[36:40] == b"VBRI" and len(frame) >= 62:
        size, frames, entries, scale, width = *struct.unpack(">II", frame[46:54]), *struct.unpack(">HHH", frame[54:60])
        raw = frame[62 : 62 + entries * width]
        toc = [int.from_bytes(raw[i : i + width], "big") * scale for i in range(0, len(raw), width)] if width else []
        return {"kind": "VBRI", "frames": frames, "bytes": size, "toc": toc}
    return None


def parse(data: bytes | None) -> dict:
    """Facts of a stream; empty or null bytes, and those without a frame, have no frames and duration 0.

    A frame cut off by the end of the data isn't counted.  ``resyncs`` counts the gaps between frames, ``lost_bytes``
    their bytes; a table frame counts in neither duration nor offsets.
    """
    data = data or b""
    at, tags = id3v2(data)
    end = len(data) - 128 if len(data) >= 128 + at and data[-128:-125] == b"TAG" else len(data)
    v1 = data[end + 3 : end + 33].split(b"\0")[0].decode("latin-1").rstrip() if end < len(data) else None
    out = {"tag_bytes": at, "tags": tags, "title_v1": v1, "table": None, "frames": [], "rates": set(), "samples": 0, "bad_crc": 0, "checked": 0, "resyncs": 0, "lost_bytes": 0, "micros": 0, "layer": None}
    seconds: dict[int, int] = {}
    like, gap, first = None, False, True
    while at + 4 <= end:
        h = int.from_bytes(data[at : at + 4], "big")
        f = header(h)
        ok = f is not None and at + f["length"] <= end and (like is None or (f["version"], f["layer"], f["hz"]) == like)
        if ok:
            to = at + f["length"]
            if like is None or gap:  # not in step: the next header must agree
                g = header(int.from_bytes(data[to : to + 4], "big")) if to + 4 <= end else None
                ok = to == end or g is not None and (g["version"], g["layer"], g["hz"]) == (f["version"], f["layer"], f["hz"])
        if not ok:
            if not gap:
                out["resyncs"] += 1
                gap = True
            next_sync = data.find(b"\xff", at + 1, end)
            next_sync = end if next_sync < 0 else next_sync
            out["lost_bytes"] += next_sync - at
            at = next_sync
            continue
        gap, like = False, (f["version"], f["layer"], f["hz"])
        if f["protected"] and f["layer"] == 3:
            out["checked"] += 1
            covered = data[at + 2 : at + 4] + data[at + 6 : at + 6 + f["side"]]
            out["bad_crc"] += crc16(covered) != int.from_bytes(data[at + 4 : at + 6], "big")
        table = _table(data[at:to], f) if first and f["layer"] == 3 else None
        first = False
        if table:
            out["table"] = table
        else:
            out["frames"].append((at, to, f["samples"], f))
            seconds[f["hz"]] = seconds.get(f["hz"], 0) + f["samples"]
            out["samples"] += f["samples"]
        out["rates"].add(f["kbps"])
        out["layer"] = f["layer"]
        at = to
    if at < end:
        out["lost_bytes"] += end - at
        out["resyncs"] += not gap
    out["micros"] = sum(n * 1_000_000 // hz for hz, n in seconds.items())
    return out


def _frame_header(kbps_index: int) -> bytes:
    return struct.pack(">I", 0x7FF << 21 | 3 << 19 | 1 << 17 | 0 << 16 | kbps_index << 12 | 1 << 10 | 3 << 6)


_HEADERS = [_frame_header(i) for i in range(1, 15)]
_FIELDS = [_header_fields(int.from_bytes(h, "big")) for h in _HEADERS]
_STARTS = [h + crc16(h[2:] + bytes(17)).to_bytes(2, "big") + bytes(17) for h in _HEADERS]  # mono: 17 bytes of side information
_ROOM = [f["length"] - 23 for f in _FIELDS]


def mux(payload: bytes) -> bytes:
    """A variable-bitrate layer III stream of silence at 48 kHz, mono, that carries ``payload``."""
    frames = []
    full, start = _ROOM[-1], _STARTS[-1]
    at = 0
    while len(payload) - at >= full:
        frames.append(start + payload[at : at + full])
        at += full
    if at < len(payload) or not frames:
        rest = payload[at:]
        k = next(i for i, room in enumerate(_ROOM) if room >= len(rest))
        frames.append(_STARTS[k] + rest + bytes(_ROOM[k] - len(rest)))
    if b"".join(frames[-2:])[-128:-125] == b"TAG":  # would be read as an ID3v1 tag: end with a frame of filling
        k = next(i for i, f in enumerate(_FIELDS) if f["length"] >= 128 + 4)
        frames.append(_STARTS[k] + bytes(_ROOM[k]))
    sizes = np.cumsum([0, *map(len, frames)])
    total = 240 + int(sizes[-1])
    # the table frame: 80 kbit/s, 240 bytes; entry i is where i percent of the frames have passed, in 256ths
    toc = bytes(min(255, (240 + int(sizes[len(frames) * i // 100])) * 256 // total) for i in range(100))
    xing = b"Xing" + struct.pack(">III", 7, len(frames), total) + toc
    k = next(i for i, f in enumerate(_FIELDS) if f["length"] == 240)
    table = _STARTS[k] + xing + bytes(_ROOM[k] - len(xing))
    private = _OWNER + b"\0" + struct.pack(">Q", len(payload))
    body = b"PRIV" + struct.pack(">I", len(private)) + b"\0\0" + private
    tag = b"ID3\3\0\0" + bytes((len(body) >> 7 * i) & 127 for i in (3, 2, 1, 0)) + body
    return tag + table + b"".join(frames)


def demux(data: bytes, facts: dict | None = None) -> bytes | None:
    """The payload of a stream that ``mux`` wrote; None for any other."""
    facts = facts or parse(data)
    private = facts["tags"].get("PRIV", b"")
    if not private.startswith(_OWNER + b"\0") or len(private) != len(_OWNER) + 9:
        return None
    n = struct.unpack(">Q", private[-8:])[0]
    parts = b"".join([data[at + 23 : to] for at, to, _, _ in facts["frames"]])
    return parts[:n] if len(parts) >= n else None


def feature(facts: dict) -> str:
    t = facts["table"] or {}
    return f"layer={facts['layer']};frames={len(facts['frames'])};samples={facts['samples']};micros={facts['micros']};kbps={'/'.join(map(str, sorted(facts['rates'])))};table={t.get('kind')}:{t.get('frames')}:{t.get('bytes')};crc={facts['checked']}:{facts['bad_crc']};resyncs={facts['resyncs']}:{facts['lost_bytes']};tag={facts['tag_bytes']}"


def padded(text: bytes, multiple: int = 192) -> bytes:
    """``text`` and spaces up to a positive multiple."""
    return text + b" " * (max(multiple, -(-len(text) // multiple) * multiple) - len(text))


_KIND = pa.struct([
    ("layer", pa.int32()), ("duration_micros", pa.int64()), ("samples", pa.int64()), ("frame_offsets", pa.list_(pa.int64())), ("frame_samples", pa.int32()), ("tag_bytes", pa.int32()),
    ("table_kind", pa.string()), ("table_frames", pa.int64()), ("table_bytes", pa.int64()), ("table_toc", pa.list_(pa.int64())), ("crc_checked", pa.int32()), ("crc_bad", pa.int32()), ("resyncs", pa.int32()), ("lost_bytes", pa.int64()), ("title_v1", pa.string()), ("kbps", pa.list_(pa.int32())),
])
FACTS = "struct<layer:int,duration_micros:long,samples:long,frame_offsets:array<long>,frame_samples:int,tag_bytes:int,table_kind:string,table_frames:long,table_bytes:long,table_toc:array<long>,crc_checked:int,crc_bad:int,resyncs:int,lost_bytes:long,title_v1:string,kbps:array<int>>"


def facts(media: Column) -> Column:
    """The facts of a binary column of streams; seek: frame_offsets[i] is where sample i * frame_samples starts."""

    @F.arrow_udf(FACTS)
    def read(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            rows = []
            for value in column:
                p = parse(value.as_py())
                t = p["table"] or {}
                rows.append({
                    "layer": p["layer"], "duration_micros": p["micros"], "samples": p["samples"], "frame_offsets": [a for a, *_ in p["frames"]], "frame_samples": p["frames"][0][2] if p["frames"] else None,
                    "tag_bytes": p["tag_bytes"], "table_kind": t.get("kind"), "table_frames": t.get("frames"), "table_bytes": t.get("bytes"), "table_toc": t.get("toc"),
                    "crc_checked": p["checked"], "crc_bad": p["bad_crc"], "resyncs": p["resyncs"], "lost_bytes": p["lost_bytes"], "title_v1": p["title_v1"], "kbps": sorted(p["rates"]),
                })
            yield pa.array(rows, _KIND)

    return read(media)


def store(text: Column, multiple: int = 192) -> Column:
    """A text column, padded with spaces, as streams; null texts are empty."""

    @F.arrow_udf("binary")
    def write(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            yield pa.array([mux(padded(v.as_py() or b"", multiple)) for v in column.cast(pa.binary())], pa.binary())

    return write(text.cast("string"))


def load(media: Column) -> Column:
    """The payload that ``store`` put in a stream, null for other streams."""

    @F.arrow_udf("binary")
    def read(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            yield pa.array([demux(v.as_py() or b"") for v in column], pa.binary())

    return read(media)


def _digests(multiple: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            rows = []
            for value in batch.column("text").cast(pa.binary()):
                text = value.as_py() or b""
                media = mux(padded(text, multiple))
                p = parse(media)
                back = demux(media, p)
                rows.append((len(text), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature(p)))
            names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            yield pa.RecordBatch.from_arrays([batch.column("doc"), *(pa.array(c) for c in zip(*rows))], names=["doc_id", *names])

    return run


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", multiple: int = 192) -> DataFrame:
    """Every row's text stored, read back and described, without the streams themselves.

    Null and empty texts are a payload of spaces.  Null ids and repeated rows stay.
    """
    d = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    return d.mapInArrow(_digests(multiple), "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
