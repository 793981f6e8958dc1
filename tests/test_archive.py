import struct

import pytest

from stratalith.functions.blake3 import blake3
from stratalith.sources import archive as a

FILES = [
    {"entry_path": "b/two.txt", "kind": "regular", "data": b"two " * 900, "uname": "u", "hardlink_group": 3, "xattrs": [{"name": "user.k", "value": b"\0v"}]},
    {"entry_path": "a.txt", "kind": "regular", "data": b"one"},
    {"entry_path": "b", "kind": "directory"},
    {"entry_path": "l", "kind": "symlink", "link_target": "a.txt"},
    {"entry_path": "dev", "kind": "char_device", "device_major": 1, "device_minor": 7},
]


def test_blake3_published_vectors():
    assert blake3(b"").hex() == "af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262"
    pattern = lambda n: bytes(i % 251 for i in range(n))
    assert blake3(pattern(1)).hex() == "2d3adedff11b61f14c886e35afa036736dcd87a74d27b5c1510225d0f592e213"
    assert blake3(pattern(1024)).hex() == "42214739f095a406f3fc83deb889744ac00df831c10daa55189b5d121c855af7"
    assert blake3(pattern(1025)).hex() == "d00278ae47eb27b34faecf67b4fe263f82d5412916c1ffd97c8cb7fb814b8444"


def test_blake3_side_by_side_equals_block_by_block():
    import struct as st

    from stratalith.functions import blake3 as module

    pattern = bytes(i * 7 % 251 for i in range(40_000))
    for n in (1025, 2048, 2049, 3072, 3073, 5000, 9 * 1024, 16 * 1024 + 1, 31_744, 40_000):
        assert module._many(pattern[:n]) == st.pack("<8I", *module._node(pattern[:n], 0, 8)), n


def test_round_trip_and_refusal():
    data = a.encode(FILES, dictionaries={5: b"dict"}, ledger={"b": 1, "a": [2, {"d": 1, "c": 2}]})
    done, refused = a.extract(data)
    assert done == {"a.txt": b"one", "b/two.txt": b"two " * 900} and refused == []
    parts = a.tail(data)
    assert parts["dictionaries"] == {5: b"dict"} and parts["ledger"] == b'{"a":[2,{"c":2,"d":1}],"b":1}'
    entries = {e["entry_path"]: e for e in a.decode_index(parts["index"])}
    assert entries["l"]["link_target"] == "a.txt" and entries["dev"]["device_minor"] == 7 and entries["b/two.txt"]["xattrs"] == FILES[0]["xattrs"]
    blocks = list(a.scan(data, parts["footer"]["blocks_end"]))
    at = blocks[1]["payload_offset"] + 3
    damaged = data[:at] + bytes([data[at] ^ 1]) + data[at + 1 :]
    done, refused = a.extract(damaged)
    assert refused == ["b/two.txt"] and set(done) == {"a.txt"}
    states = [(c["hash_status"], c["verified"]) for c in a.candidates(damaged)]
    assert states == [("match", True), ("mismatch", False)]
    assert [c["verified"] for c in a.candidates(b"junk" + data[: blocks[1]["header_offset"]] + b"BLK3")] == [True, False]


@pytest.mark.parametrize("where", [-1, -40, -100])
def test_damaged_tail_is_rejected(where):
    data = bytearray(a.encode(FILES))
    data[where] ^= 1
    with pytest.raises(ValueError):
        a.tail(bytes(data))


def test_old_index_versions():
    one = b"IDX1" + struct.pack("<II", 1, 1) + b"f" + struct.pack("<IqQI", 420, 9, 3, 1) + struct.pack("<IQQ", 4, 0, 3)
    (e,) = a.decode_index(one)
    assert (e["kind"], e["mode"], e["extents"]) == ("regular", 420, [{"block_id": 4, "offset": 0, "len": 3, "logical_offset": 0}])
    two = b"IDX2" + struct.pack("<II", 1, 1) + b"l" + struct.pack("<BIqQI", 1, 0, 0, 0, 0) + struct.pack("<I", 1) + b"t"
    assert a.decode_index(two)[0]["link_target"] == "t"
    with pytest.raises(ValueError):
        a.decode_index(one + b"x")


def test_sparse_assembly():
    entry = {"sparse": True, "size": 12, "extents": [{"block_id": 1, "offset": 1, "len": 2, "logical_offset": 8}, {"block_id": 1, "offset": 0, "len": 3, "logical_offset": 2}]}
    assert a.assemble(entry, {1: b"abcd"}) == b"\0\0abc\0\0\0bc\0\0"


def test_spark_tables(spark, tmp_path):
    files = spark.createDataFrame([("x", "a.txt", "regular", b"one"), ("x", "d", "directory", None), ("y", "b.txt", "regular", b"two" * 50)], "archive string, entry_path string, kind string, data binary")
    assert a.write(files, str(tmp_path)) == 2
    entries = a.read(spark, f"file://{tmp_path}", "entries").collect()
    assert sorted((r["archive"][-5:], r["entry_path"], r["size"]) for r in entries) == [("x.arc", "a.txt", 3), ("x.arc", "d", 0), ("y.arc", "b.txt", 150)]
    assert all(r["payload_ok"] for r in a.read(spark, f"file://{tmp_path}", "blocks").collect())
    assert a.read(spark, f"file://{tmp_path}", "candidates").where("verified").count() == 2
    assert a.read(spark, f"file://{tmp_path}", "footer").count() == 2
    assert a.read(spark, f"file://{tmp_path}", "ledger").count() == 0


def test_ranges_parse_an_archive_once(spark, monkeypatch):
    files = [(str(i % 2), f"f{i:02}", "regular", bytes(range(i, i + 40))) for i in range(60)] + [("0", "f00/", "directory", None), ("1", "empty", "regular", b"")]
    packed = a.pack(spark.createDataFrame(files, "archive string, entry_path string, kind string, data binary"))
    asked = [(x, p, at, n) for x, p, k, _ in files if k == "regular" for at, n in ((0, 1), (3, 6), (38, 9), (99, 1), (0, 0))]
    want = {(x, p, at, n): dict((f[1], f[3]) for f in files)[p][at : at + n] for x, p, at, n in asked}
    got = a.ranges_of(packed, spark.createDataFrame(asked, "archive string, entry_path string, offset long, length long")).collect()
    assert sorted((r["archive"], r["entry_path"], r["offset"], bytes(r["body"])) for r in got) == sorted((x, p, at, body) for (x, p, at, _), body in want.items())

    calls = {"tail": 0, "decode_index": 0, "scan": 0}
    for name in calls:
        monkeypatch.setattr(a, name, lambda *args, f=getattr(a, name), name=name: calls.__setitem__(name, calls[name] + 1) or f(*args))
    opened = a.Ranges(a.encode([{"entry_path": p, "kind": k, "data": d} for x, p, k, d in files if x == "0"]))
    assert all(opened.read(p, at, n) == body for (x, p, at, n), body in want.items() if x == "0")
    assert calls == {"tail": 1, "decode_index": 1, "scan": 1}
    with pytest.raises(ValueError):
        opened.read("f00/", 0, 1)
