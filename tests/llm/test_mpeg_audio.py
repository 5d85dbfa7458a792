"""Round trips, streams built by hand, damage, and a bitwise checksum."""

import hashlib
import random
import struct
import zlib

from pyspark.sql import functions as F

from quillspark.llm import mpeg_audio as M

SCHEMA = "doc_id long, text string, feature string"


def slow_crc(data):
    crc = 0xFFFF
    for b in data:
        for k in range(7, -1, -1):
            top = crc >> 15 ^ b >> k & 1
            crc = (crc << 1 & 0xFFFF) ^ (0x8005 if top else 0)
    return crc


def test_crc_equals_the_bitwise_form():
    rng = random.Random(0)
    for n in (0, 1, 2, 19, 34, 300):
        data = rng.randbytes(n)
        assert M.crc16(data) == slow_crc(data)


def test_round_trip_of_any_bytes():
    rng = random.Random(1)
    for n in (0, 1, 22, 192, 936, 937, 938, 937 * 3, 100_000):
        for payload in (rng.randbytes(n), b"\xff\xfb" * (n // 2), bytes(n)):
            media = M.mux(payload)
            p = M.parse(media)
            assert M.demux(media) == payload
            assert p["bad_crc"] == p["resyncs"] == p["lost_bytes"] == 0 and p["checked"] == len(p["frames"]) + 1
            assert p["table"]["frames"] == len(p["frames"]) and p["table"]["bytes"] == len(media) - p["tag_bytes"]
            assert p["micros"] == len(p["frames"]) * 24_000 and p["samples"] == 1152 * len(p["frames"])
            assert all(M.header(int.from_bytes(media[a : a + 4], "big"))["length"] == b - a for a, b, *_ in p["frames"])


def stream(version, layer, bitrate, rate, mode, n, pad=0):
    h = struct.pack(">I", 0x7FF << 21 | version << 19 | (4 - layer) << 17 | 1 << 16 | bitrate << 12 | rate << 10 | pad << 9 | mode << 6)
    length = M.header(int.from_bytes(h, "big"))["length"]
    return (h + bytes(length - 4)) * n, length


def test_versions_layers_and_durations():
    for version, layer, bitrate, rate, samples, length, hz in ((3, 3, 9, 0, 1152, 417, 44100), (3, 2, 8, 1, 1152, 384, 48000), (3, 1, 10, 2, 384, 480, 32000), (2, 3, 8, 0, 576, 208, 22050), (0, 3, 2, 2, 576, 144, 8000), (2, 2, 5, 1, 1152, 240, 24000)):
        data, size = stream(version, layer, bitrate, rate, 0, 7)
        p = M.parse(data)
        assert size == length and len(p["frames"]) == 7 and p["micros"] == 7 * samples * 1_000_000 // hz and p["layer"] == layer


def test_resynchronises_after_damage_and_ignores_tags():
    data, n = stream(3, 3, 9, 0, 0, 10)
    broken = b"ID3\4\0\0\0\0\0\5hello" + b"\xff\xfb junk \xff" + data[: 3 * n] + b"garbage\xff\xe0" + data[: 4 * n] + data[: n // 2] + b"TAG" + b"A title".ljust(125, b"\0")
    p = M.parse(broken)
    assert [b - a for a, b, *_ in p["frames"]] == [n] * 7 and p["resyncs"] == 3 and p["title_v1"] == "A title" and p["tag_bytes"] == 15
    flipped = bytearray(M.mux(b"x" * 5000))
    q = M.parse(bytes(flipped))
    flipped[q["frames"][2][0] + 8] ^= 1
    assert M.parse(bytes(flipped))["bad_crc"] == 1
    assert M.parse(b"")["frames"] == M.parse(None)["frames"] == M.parse(b"\xff" * 999)["frames"] == []
    assert M.demux(data) is None


def test_vbri_table():
    data, n = stream(3, 3, 9, 0, 0, 3)
    table = data[:36] + b"VBRI" + struct.pack(">HHHIIHHHH", 1, 0, 75, 4000, 3, 2, 10, 2, 1) + struct.pack(">HH", 41, 42)
    p = M.parse(table + bytes(n - len(table)) + data)
    assert p["table"] == {"kind": "VBRI", "frames": 3, "bytes": 4000, "toc": [410, 420]} and len(p["frames"]) == 3


def test_query_columns(spark):
    texts = [None, "", "a", "é" * 96, "x" * 193, "naïve text\n" * 20000] + ["copy"] * 5
    rows = [(i if i != 4 else None, t, "f") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = M.digests(df).collect()
    want = []
    for i, t, _ in rows:
        b = (t or "").encode()
        back = b + b" " * ((-len(b)) % 192 if b else 192)
        media = M.mux(back)
        want.append((i, len(b), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest()))
    assert sorted((tuple(r)[:7] for r in got), key=str) == sorted(want, key=str)
    assert len({r.feature for r in got if r.n_bytes == 4}) == 1
    media = df.select("doc_id", "text", M.store(F.col("text")).alias("media"))
    full = media.select("*", M.facts(F.col("media")).alias("f"), M.load(F.col("media")).alias("back")).collect()
    assert all(r.back.decode().rstrip(" ") == (r.text or "") and r.f.crc_bad == 0 and len(r.f.frame_offsets) == r.f.table_frames for r in full)
    assert M.digests(df.limit(0)).collect() == []


def test_payload_with_tag_where_an_id3v1_tag_would_start():
    for n in (192, 600, 937, 937 + 60, 937 + 128, 937 * 2):
        end = len(M.mux(bytes(n)))
        hit = 0
        for at in range(max(0, n - 1100), n - 2):
            payload = bytes(at) + b"TAG" + bytes(n - at - 3)
            media = M.mux(payload)
            p = M.parse(media)
            hit += len(media) != end
            assert M.demux(media) == payload and p["title_v1"] is None and p["lost_bytes"] == p["resyncs"] == 0
            assert p["table"]["frames"] == len(p["frames"]) and p["table"]["bytes"] == len(media) - p["tag_bytes"]
        assert hit <= 1
    payload = bytes(937 - 128) + b"TAG" + bytes(125)
    assert M.demux(M.mux(payload)) == payload
