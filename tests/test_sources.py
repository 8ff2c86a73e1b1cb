import random
import struct

import pytest

from quern.sources import codecs as C
from quern.sources import tables as T


def pairs(n=500):
    return [(C.record_key("MRT"[i % 3], i // 3), bytes([i % 256]) * (i % 40)) for i in range(n)]


def test_crc_and_table_round_trip():
    assert C.crc32c(b"123456789") == 0xE3069283
    rows = sorted(pairs())
    data = C.write_table(rows, 200)
    t = C.Table(data)
    assert list(t.entries()) == rows and t.validate() == len(rows) and len(t.blocks) > 5
    assert all(t.get(k) == v for k, v in rows) and t.get(b"M\xff\xff\xff") is None and t.get(b"zzz") is None
    assert t.get_many([rows[3][0], b"nope", rows[400][0]]) == dict([rows[3], rows[400]])
    assert t.approximate_offset(b"") == 0 and t.approximate_offset(b"zz") <= len(data)


def test_broken_tables_raise_only_format_errors():
    data = C.write_table(sorted(pairs(60)), 100)
    r = random.Random(1)
    for _ in range(300):
        broken = bytearray(data)
        broken[r.randrange(len(data) - 8)] ^= 1 << r.randrange(8)
        try:
            C.Table(bytes(broken)).validate()
        except C.FormatError:
            pass
    for n in range(0, len(data), 37):
        with pytest.raises(C.FormatError):
            C.Table(data[:n])
    with pytest.raises(C.InvalidInput):
        C.record_key("M", 1 << 24)


def test_messages():
    m = b"\x0a\x03abc\x70\xd0\x0f\x31" + struct.pack("<d", 2.5)
    assert C.track(m) == {"track_id": "abc", "catalog_id": "", "title": "", "artist": "", "knowledge_graph_id": "", "album": "", "duration_seconds": 2.5, "release_year": 2000}
    for bad in (b"\x0a\x05ab", b"\x03", b"\x00\x01", b"\xff" * 11, b"\x0a\x02\xff\xfe"):
        with pytest.raises(C.FormatError):
            C.track(bad)
    with pytest.raises(C.FormatError):
        C.only(C.message(b"\x0a\x00\x0a\x00"), 1, "bytes")
    assert C.packed_floats(struct.pack("<2f", 1, 2)) == [1, 2]


def test_prefix_codes():
    r = random.Random(2)
    code = C.PrefixCode.from_weights({**{s: 1000 // (s + 1) + 1 for s in range(40)}, 255: 5})
    for _ in range(100):
        ids, at = [], 0
        for _ in range(r.randint(0, 60)):
            at += r.choice([0, 1, 2, 39, 40, 300, 70_000])
            ids.append(at)
        got = code.decode(code.encode(ids)) if 0 not in [b - a for a, b in zip([0, *ids], ids)] or 0 in code.codes else ids
        assert got == ids
    for raw in (b"", b"\0\0\0"):
        with pytest.raises(C.FormatError):
            code.decode(raw)


def test_partitions():
    for numbers in ([], [1], [999, 0, 256, 513], list(range(0, 1000, 7))):
        assert C.partitions(C.pack_partitions(numbers)) == numbers
    for bad in (b"1234", C.pack_partitions([1000])):
        with pytest.raises(C.FormatError):
            C.partitions(bad)


def test_wav():
    pcm = C.deterministic_pcm(100)
    assert C.read_wav(C.write_wav(22_050, pcm), 22_050) == (22_050, pcm)
    stereo = bytearray(C.write_wav(8000, [3, -4, 5, 6]))
    stereo[22] = 2
    assert C.read_wav(bytes(stereo))[1] == [0, 5]
    for bad in (b"RIFF", C.write_wav(8000, pcm)[:30]):
        with pytest.raises(C.FormatError):
            C.read_wav(bad)
    with pytest.raises(C.FormatError):
        C.read_wav(C.write_wav(8000, pcm), 22_050)


def test_frames(spark, tmp_path):
    code = C.PrefixCode.from_weights({**{s: 9 for s in range(8)}, 255: 5})
    message = lambda ids, codes: b"\x0a" + bytes([len(codes)]) + codes + b"\x1a" + bytes([len(code.encode(ids))]) + code.encode(ids)
    rows = sorted([(C.record_key("M", i), b"\x0a\x02t" + str(i).encode()) for i in range(5)] + [(C.record_key("R", i), C.pack_partitions([i, i + 1, 7])) for i in range(5)] + [(C.record_key("T", 7), message([1, 1, 4], bytes(range(36))))])
    (tmp_path / "a.tbl").write_bytes(C.write_table(rows, 20))
    (tmp_path / "b.tbl").write_bytes(b"junk")
    content = T.files(spark, str(tmp_path), "*.tbl")
    got = {r["path"][-5:]: (r["entries"], bool(r["error"])) for r in T.validate_tables(content).collect()}
    assert got == {"a.tbl": (len(rows), False), "b.tbl": (0, True)}
    entries = T.scan_tables(content.where("path like '%a.tbl'"))
    assert [(bytes(r["key"]), bytes(r["value"])) for r in entries.collect()] == rows
    assert T.get(entries, rows[0][0]).count() == 1
    assert [r["track_id"] for r in T.tracks(entries).orderBy("id").collect()] == [f"t{i}" for i in range(5)]
    assert [(r["pos"], r["track_id"], r["code"][0]) for r in T.leaves(entries, code).orderBy("pos").collect()] == [(0, 1, 0), (1, 1, 12), (2, 4, 24)]
    assert {(r["track_id"], r["occurrence"], r["partition"]) for r in T.reverse(entries).collect()} == {(i, n, p) for i in range(5) for n, p in enumerate([i, i + 1, 7])}
    with pytest.raises(Exception, match="not a table"):
        T.scan_tables(content).collect()
    (tmp_path / "c.meta").write_text("sampleRate=16000\neventType=null\n")
    assert T.metadata_files(spark, str(tmp_path)).first()["entries"] == {"sampleRate": "16000", "eventType": "null"}
    (tmp_path / "d.wav").write_bytes(C.write_wav(16_000, [1, 2, 3]))
    assert T.wav_files(T.files(spark, str(tmp_path), "*.wav")).first()["samples"] == [1, 2, 3]
