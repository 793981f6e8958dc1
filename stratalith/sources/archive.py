"""Block archives: blocks, then a tail of dictionaries, index, ledger and footer.

``read`` gives any of the tables of TABLES for all archives under a path. Archives are
parsed in parallel, each by one task, because block numbers follow the order of the scan.
Catalogue tables never hand out payloads. ``encode`` and ``write`` make archives.

All integers are little-endian. A strict reader raises ValueError on the first violation;
the candidate scan never raises.
"""

from __future__ import annotations

import hashlib
import json
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.blake3 import blake3
from ..shipping import ship

# Fixed values of the format.
BLOCK, FOOTER, DICTIONARIES, LEDGER = b"BLK3", b"FTR4", b"DCT1", b"LDG1"
FIXED, MOST_HEADER = 36, 4096
PAYLOAD_HASH, RAW_HASH, USES_DICTIONARY, META = 1, 2, 4, 8
MOST_DICTIONARIES, MOST_DICTIONARY, MOST_DICTIONARY_BYTES, MOST_LEDGER = 65_535, 16 << 20, 256 << 20, 16 << 20
KINDS = ["regular", "symlink", "directory", "fifo", "char_device", "block_device"]
PROFILES = ["full", "basic", "payload_only"]
ZSTD = 1
_FOOTER = struct.Struct("<4sII7Q32s32s28s32s")
FOOTER_LENGTH = _FOOTER.size
_HEADER = struct.Struct("<4sHHIiIQQ")

_EXTENT = "struct<block_id: long, offset: long, len: long, logical_offset: long>"
TABLES = {
    "blocks": "block_id long, header_offset long, payload_offset long, codec long, level int, dict_id long, raw_len long, comp_len long, payload_hash string, is_meta boolean, payload_ok boolean",
    "candidates": "scan_offset long, header_status string, bounds_status string, hash_status string, decompression_status string, verified boolean, reasons array<string>",
    "verified": "block_id long, raw_len long, sha256 string",
    "records": "scan_offset long, raw_len long, json string",
    "footer": "version long, blocks_end long, dct_offset long, dct_len long, index_offset long, index_len long, ledger_offset long, ledger_len long, index_hash string",
    "dictionaries": "dict_id long, length long, hash string",
    "ledger": "json string, hash string",
    "entries": f"ordinal long, profile string, kind string, entry_path string, mode long, mtime long, size long, link_target string, uid long, gid long, uname string, gname string, hardlink_group long, sparse boolean, device_major long, device_minor long, extents array<{_EXTENT}>, xattrs array<struct<name: string, value: binary>>",
}


def check(ok: bool, what: str) -> None:
    if not ok:
        raise ValueError(what)


def header(data: bytes, at: int) -> dict:
    """Parse and validate the block header at an offset."""
    check(len(data) - at >= FIXED, "header_prefix_out_of_bounds")
    magic, size, flags, codec, level, dictionary, raw, comp = _HEADER.unpack_from(data, at)
    check(magic == BLOCK, "bad_magic")
    # the format's own rule: room for the payload hash is asked for twice
    least = FIXED + 64 * bool(flags & PAYLOAD_HASH) + 32 * bool(flags & RAW_HASH)
    check(not flags & ~15 and least <= size <= MOST_HEADER, "header_parse_failed")
    check(at + size <= len(data), "header_out_of_bounds")
    check(bool(flags & USES_DICTIONARY) == (dictionary != 0), "header_parse_failed")
    place, hashes = at + FIXED, {}
    for name, bit in (("payload_hash", PAYLOAD_HASH), ("raw_hash", RAW_HASH)):
        hashes[name] = bytes(data[place : place + 32]) if flags & bit else None
        place += 32 if flags & bit else 0
    check(not any(data[place : at + size]), "header_parse_failed")
    return {"header_len": size, "flags": flags, "codec": codec, "level": level, "dict_id": dictionary, "raw_len": raw, "comp_len": comp, **hashes}


def scan(data: bytes, end: int) -> Iterator[dict]:
    """The blocks from offset 0 to ``end``, numbered in order; fails closed."""
    at = number = 0
    while at < end:
        h = header(data[:end], at)
        payload = at + h["header_len"]
        check(payload + h["comp_len"] <= end, f"the payload of the block at {at} leaves the block region")
        yield h | {"block_id": number, "header_offset": at, "payload_offset": payload}
        at, number = payload + h["comp_len"], number + 1


def decompress(h: dict, payload: bytes, dictionaries: dict[int, bytes] | None = None) -> bytes:
    """A block's raw bytes, of exactly the stated length."""
    import zstandard

    check(h["codec"] == ZSTD, "unsupported_codec")
    known = dictionaries or {}
    check(not h["dict_id"] or h["dict_id"] in known, "dictionary_missing")
    decoder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(known[h["dict_id"]]) if h["dict_id"] else None)
    try:
        raw = decoder.decompress(payload, max_output_size=max(1, h["raw_len"]))
    except zstandard.ZstdError as e:
        raise ValueError("failed") from e
    check(len(raw) == h["raw_len"], "raw_length_mismatch")
    return raw


def candidates(data: bytes, dictionaries: dict[int, bytes] | None = None) -> Iterator[dict]:
    """Every place where a block's magic stands, with what can be said of it; never raises."""
    at = data.find(BLOCK)
    while at >= 0:
        row = {"scan_offset": at, "header_status": "invalid", "bounds_status": "unknown", "hash_status": "unavailable", "decompression_status": "not_attempted", "verified": False, "reasons": []}
        try:
            h = header(data, at)
        except ValueError as e:
            yield row | {"reasons": [str(e) if "bounds" in str(e) else "header_invalid"]}
        else:
            row["header_status"] = "valid"
            begin = at + h["header_len"]
            payload = data[begin : begin + h["comp_len"]]
            inside = len(payload) == h["comp_len"]
            row["bounds_status"] = "in_bounds" if inside else "out_of_bounds"
            reasons = [] if inside else ["payload_out_of_bounds"]
            if inside:
                if h["payload_hash"]:
                    row["hash_status"] = "match" if blake3(payload) == h["payload_hash"] else "mismatch"
                try:
                    raw = decompress(h, payload, dictionaries)
                    row["decompression_status"] = "success"
                    if h["raw_hash"] and blake3(raw) != h["raw_hash"]:
                        reasons.append("raw_hash_mismatch")
                except ValueError as e:
                    row["decompression_status"] = str(e)
            if row["hash_status"] == "mismatch":
                reasons.insert(0, "payload_hash_mismatch")
            if row["decompression_status"] == "dictionary_missing":
                reasons.append("dictionary_dependency_unsatisfied")
            if row["decompression_status"] != "success":
                reasons.append("decompression_not_successful")
            yield row | {"verified": not reasons, "reasons": reasons}
        at = data.find(BLOCK, at + 1)


def footer(data: bytes) -> dict:
    """Parse and validate the footer at the end."""
    check(len(data) >= FOOTER_LENGTH, "archive too short for a footer")
    raw = data[-FOOTER_LENGTH:]
    magic, version, flags, *numbers, index_hash, ledger_hash, reserved, own = _FOOTER.unpack(raw)
    f = dict(zip(("blocks_end", "dct_offset", "dct_len", "index_offset", "index_len", "ledger_offset", "ledger_len"), numbers, strict=True))
    check(magic == FOOTER, "bad footer magic")
    check(version == 1, f"unsupported footer version {version}")
    check(f["index_offset"] > 0 and f["index_len"] > 0 and any(index_hash), "the index is missing")
    for part in ("dct", "ledger"):
        check((f[f"{part}_len"] == 0) == (f[f"{part}_offset"] == 0), f"{part} offset and length disagree")
    check(bool(f["ledger_len"]) == any(ledger_hash), "ledger hash and length disagree")
    check(not any(reserved), "reserved bytes must be zero")
    check(blake3(raw[:-32]) == own, "footer hash mismatch")
    for part in ("dct", "index", "ledger"):
        check(f[f"{part}_offset"] == 0 or f[f"{part}_offset"] >= f["blocks_end"], f"{part} precedes the end of blocks")
    return f | {"version": version, "flags": flags, "index_hash": index_hash, "ledger_hash": ledger_hash}


def tail(data: bytes) -> dict:
    """Footer, index bytes, dictionaries and ledger; parts are in order and leave no gap before the footer."""
    f, end = footer(data), len(data) - FOOTER_LENGTH
    stop = f["index_offset"] + f["index_len"]
    check(stop <= end, "the index leaves the tail")
    check(f["dct_len"] == 0 or f["dct_offset"] + f["dct_len"] <= f["index_offset"], "dictionaries overlap the index")
    index = data[f["index_offset"] : stop]
    check(index[:3] == b"IDX" and blake3(index) == f["index_hash"], "index hash mismatch")
    out = {"footer": f, "index": index, "dictionaries": {}, "ledger": None}
    if f["dct_len"]:
        out["dictionaries"] = read_dictionaries(data[f["dct_offset"] : f["dct_offset"] + f["dct_len"]])
    if f["ledger_len"]:
        check(stop <= f["ledger_offset"], "the index overlaps the ledger")
        stop = f["ledger_offset"] + f["ledger_len"]
        out["ledger"] = read_ledger(data[f["ledger_offset"] : stop])
        check(blake3(out["ledger"]) == f["ledger_hash"], "ledger hash mismatch")
    check(stop == end, "unexpected bytes before the footer")
    return out


def read_dictionaries(part: bytes) -> dict[int, bytes]:
    check(part[:4] == DICTIONARIES, "bad dictionary magic")
    (count,) = struct.unpack_from("<I", part, 4)
    check(count <= MOST_DICTIONARIES, "too many dictionaries")
    at, out = 8, {}
    for _ in range(count):
        number, size, digest = struct.unpack_from("<II32s", part, at)
        check(number != 0 and number not in out, f"dictionary {number} is zero or stands twice")
        check(size <= MOST_DICTIONARY, "dictionary too large")
        body = part[at + 40 : at + 40 + size]
        check(len(body) == size and blake3(body) == digest, f"dictionary {number}: hash mismatch")
        out[number] = body
        check(sum(map(len, out.values())) <= MOST_DICTIONARY_BYTES, "dictionaries too large")
        at += 40 + size
    return out


def canonical_json(value) -> bytes:
    """Keys sorted at every level, no white space, arrays in order."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()


def read_ledger(part: bytes) -> bytes:
    check(part[:4] == LEDGER, "bad ledger magic")
    size, digest = struct.unpack_from("<Q32s", part, 4)
    body = part[44:]
    check(size <= MOST_LEDGER and len(body) == size, "ledger length mismatch")
    check(blake3(body) == digest, "ledger hash mismatch")
    check(canonical_json(json.loads(body)) == body, "the ledger is not canonical")
    return body


class _Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, form: str):
        size = struct.calcsize("<" + form)
        check(self.at + size <= len(self.data), "truncated index")
        (out,) = struct.unpack_from("<" + form, self.data, self.at)
        self.at += size
        return out

    def blob(self) -> bytes:
        size = self.take("I")
        check(self.at + size <= len(self.data), "truncated bytes")
        self.at += size
        return self.data[self.at - size : self.at]

    def text(self) -> str | None:
        return self.blob().decode() or None


def decode_index(data: bytes) -> list[dict]:
    """The entries of an index of version 1 to 7: each version adds fields to the one before."""
    check(len(data) >= 8 and data[:3] == b"IDX" and 0x31 <= data[3] <= 0x37, "bad index magic")
    version, r = data[3] - 0x30, _Reader(data)
    r.at = 4
    profile = "full"
    if version >= 7:
        tag = r.take("B")
        check(tag < len(PROFILES), "unknown profile")
        profile = PROFILES[tag]
    known = {1: 1, 2: 2, 3: 3, 4: 3}.get(version, 6)
    out = []
    for ordinal in range(r.take("I")):
        path = r.blob().decode()
        kind = r.take("B") if version >= 2 else 0
        check(kind < known, f"unknown entry kind {kind}")
        e = {"ordinal": ordinal, "profile": profile, "kind": KINDS[kind], "entry_path": path, "mode": r.take("I"), "mtime": r.take("q"), "size": r.take("Q")}
        e["extents"] = [{"block_id": r.take("I"), "offset": r.take("Q"), "len": r.take("Q"), "logical_offset": r.take("Q") if version >= 5 else 0} for _ in range(r.take("I"))]
        e["link_target"] = r.text() if version >= 2 else None
        e["xattrs"] = [{"name": r.blob().decode(), "value": r.blob()} for _ in range(r.take("I"))] if version >= 3 else []
        e |= {"uid": 0, "gid": 0, "uname": None, "gname": None, "hardlink_group": None, "sparse": False, "device_major": None, "device_minor": None}
        if version >= 4:
            e |= {"uid": r.take("I"), "gid": r.take("I"), "uname": r.text(), "gname": r.text(), "hardlink_group": r.take("Q") if r.take("B") else None}
        if version >= 5:
            e["sparse"] = bool(r.take("B"))
            if r.take("B"):
                e |= {"device_major": r.take("I"), "device_minor": r.take("I")}
        if version >= 6:
            for name in ("acl_access", "acl_default", "selinux_label", "linux_capability"):
                e[name] = r.blob() or None
        regular = e["kind"] == "regular"
        check(regular or not e["extents"], f"{e['kind']} entry has extents")
        check(e["kind"] != "directory" or e["size"] == 0, "directory entry has a size")
        check(not (regular and e["sparse"]) or bool(e["extents"]) or e["size"] == 0, "sparse entry has no extents")
        out.append(e)
    check(r.at == len(data), "index has trailing bytes")
    return out


def encode_index(entries: list[dict], profile: str = "full") -> bytes:
    """Version 7."""
    blob = lambda b: struct.pack("<I", len(b)) + b
    out = [b"IDX7", struct.pack("<BI", PROFILES.index(profile), len(entries))]
    for e in entries:
        out += [blob(e["entry_path"].encode()), struct.pack("<BIqQI", KINDS.index(e["kind"]), e.get("mode", 0), e.get("mtime", 0), e["size"], len(e["extents"]))]
        out += [struct.pack("<IQQQ", x["block_id"], x["offset"], x["len"], x["logical_offset"]) for x in e["extents"]]
        out += [blob((e.get("link_target") or "").encode()), struct.pack("<I", len(e.get("xattrs", ())))]
        out += [blob(x["name"].encode()) + blob(x["value"]) for x in e.get("xattrs", ())]
        out += [struct.pack("<II", e.get("uid", 0), e.get("gid", 0)), blob((e.get("uname") or "").encode()), blob((e.get("gname") or "").encode())]
        group, major = e.get("hardlink_group"), e.get("device_major")
        out += [b"\0" if group is None else struct.pack("<BQ", 1, group), struct.pack("<B", e.get("sparse", False)), b"\0" if major is None else struct.pack("<BII", 1, major, e["device_minor"])]
        out += [blob(e.get(n) or b"") for n in ("acl_access", "acl_default", "selinux_label", "linux_capability")]
    return b"".join(out)


def encode_block(raw: bytes, level: int = 3, dict_id: int = 0, dictionary: bytes | None = None, flags: int = PAYLOAD_HASH | RAW_HASH) -> bytes:
    import zstandard

    payload = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None).compress(raw)
    flags |= USES_DICTIONARY if dict_id else 0
    hashes = (blake3(payload) if flags & PAYLOAD_HASH else b"") + (blake3(raw) if flags & RAW_HASH else b"")
    size = FIXED + 64 * bool(flags & PAYLOAD_HASH) + 32 * bool(flags & RAW_HASH)
    return (_HEADER.pack(BLOCK, size, flags, ZSTD, level, dict_id, len(raw), len(payload)) + hashes).ljust(size, b"\0") + payload


def encode(files: list[dict], profile: str = "full", level: int = 3, dictionaries: dict[int, bytes] | None = None, ledger=None, records: list[bytes] = ()) -> bytes:
    """An archive of entries; ``data`` of a regular entry becomes one block, as does each metadata record. Entries are put in path order."""
    body, entries, number = [], [], 0
    for f in sorted(files, key=lambda f: f["entry_path"]):
        e = {**f, "extents": [], "size": len(f.get("data") or b"")}
        if f["kind"] == "regular" and f.get("data"):
            body.append(encode_block(f["data"], level))
            e["extents"] = [{"block_id": number, "offset": 0, "len": e["size"], "logical_offset": 0}]
            number += 1
        entries.append(e)
    body += [encode_block(r, level, flags=PAYLOAD_HASH | RAW_HASH | META) for r in records]
    blocks = b"".join(body)
    end, frame = len(blocks), b""
    dct = index_at = ledger_at = 0
    if dictionaries:
        dct = end
        frame += DICTIONARIES + struct.pack("<I", len(dictionaries)) + b"".join(struct.pack("<II", k, len(v)) + blake3(v) + v for k, v in dictionaries.items())
    dct_len, index_at, index = len(frame), end + len(frame), encode_index(entries, profile)
    frame += index
    digest, ledger_len = bytes(32), 0
    if ledger is not None:
        blob = canonical_json(ledger)
        digest, ledger_at, ledger_len = blake3(blob), end + len(frame), 44 + len(blob)
        frame += LEDGER + struct.pack("<Q", len(blob)) + digest + blob
    head = _FOOTER.pack(FOOTER, 1, 0, end, dct, dct_len, index_at, len(index), ledger_at, ledger_len, blake3(index), digest, bytes(28), bytes(32))[:-32]
    return blocks + frame + head + blake3(head)


def train_dictionaries(samples: DataFrame, by: str, most: int = 512, sample_bytes: int = 4096, size: int = 16_384) -> DataFrame:
    """by, samples, dictionary: a compression dictionary of each cohort from its first samples (by, place from 1, body); null where they are too few."""

    def f(key, frame):
        import pandas as pd
        import zstandard

        bodies = [bytes(b)[:sample_bytes] for b in frame.sort_values("place")["body"]]
        try:
            trained = zstandard.train_dictionary(size, bodies).as_bytes()
        except zstandard.ZstdError:
            trained = None
        return pd.DataFrame({"cohort": [str(key[0])], "samples": [len(bodies)], "dictionary": [trained]})

    return samples.where(F.col("place") <= most).groupBy(by).applyInPandas(f, "cohort string, samples long, dictionary binary")


def extract(data: bytes) -> tuple[dict[str, bytes], list[str]]:
    """Strict extraction: the files whose blocks all verify, and the paths refused. Each block is decoded once."""
    parts = tail(data)
    blocks = {h["block_id"]: h for h in scan(data, parts["footer"]["blocks_end"])}
    damaged = {k for k, h in blocks.items() if h["payload_hash"] and blake3(data[h["payload_offset"] : h["payload_offset"] + h["comp_len"]]) != h["payload_hash"]}
    raw: dict[int, bytes] = {}
    done, refused = {}, []
    for e in decode_index(parts["index"]):
        if e["kind"] != "regular":
            continue
        needed = {x["block_id"] for x in e["extents"]}
        if needed & damaged or needed - blocks.keys():
            refused.append(e["entry_path"])
            continue
        for k in needed - raw.keys():
            h = blocks[k]
            raw[k] = decompress(h, data[h["payload_offset"] : h["payload_offset"] + h["comp_len"]], parts["dictionaries"])
        done[e["entry_path"]] = assemble(e, raw)
    return done, refused


def assemble(entry: dict, raw: dict[int, bytes]) -> bytes:
    """A file from its extents by logical offset; holes of sparse files are zeros."""
    out, at = [], 0
    for x in sorted(entry["extents"], key=lambda x: x["logical_offset"]):
        check(entry["sparse"] or x["logical_offset"] in (at, 0), "extents leave a gap")
        out.append(bytes(max(0, x["logical_offset"] - at)))
        piece = raw[x["block_id"]][x["offset"] : x["offset"] + x["len"]]
        check(len(piece) == x["len"], "an extent leaves its block")
        out.append(piece)
        at = max(at, x["logical_offset"]) + x["len"]
    body = b"".join(out)
    return body + bytes(max(0, entry["size"] - len(body)))


def rows(data: bytes, table: str) -> Iterator[dict]:
    """The rows of a table of one archive."""
    if table == "candidates":
        yield from candidates(data)
        return
    if table == "records":
        # metadata blocks that verify, told apart by their schema; a scan needs no index
        for c in candidates(data):
            h = header(data, c["scan_offset"]) if c["header_status"] == "valid" else None
            if c["verified"] and h["flags"] & META:
                raw = decompress(h, data[c["scan_offset"] + h["header_len"] : c["scan_offset"] + h["header_len"] + h["comp_len"]])
                yield {"scan_offset": c["scan_offset"], "raw_len": len(raw), "json": raw.decode()}
        return
    parts = tail(data)
    f = parts["footer"]
    if table == "footer":
        yield f | {"index_hash": f["index_hash"].hex()}
    elif table == "dictionaries":
        yield from ({"dict_id": k, "length": len(v), "hash": blake3(v).hex()} for k, v in parts["dictionaries"].items())
    elif table == "ledger":
        if parts["ledger"]:
            yield {"json": parts["ledger"].decode(), "hash": f["ledger_hash"].hex()}
    elif table == "entries":
        yield from decode_index(parts["index"])
    elif table == "verified":
        # what can be exported: the raw bytes of blocks whose payload is the one that was hashed
        for h in scan(data, f["blocks_end"]):
            body = data[h["payload_offset"] : h["payload_offset"] + h["comp_len"]]
            if h["payload_hash"] and blake3(body) == h["payload_hash"]:
                yield {"block_id": h["block_id"], "raw_len": h["raw_len"], "sha256": hashlib.sha256(decompress(h, body, parts["dictionaries"])).hexdigest()}
    else:
        for h in scan(data, f["blocks_end"]):
            body = data[h["payload_offset"] : h["payload_offset"] + h["comp_len"]]
            yield h | {"payload_hash": h["payload_hash"] and h["payload_hash"].hex(), "is_meta": bool(h["flags"] & META), "payload_ok": blake3(body) == h["payload_hash"] if h["payload_hash"] else None}


def parse(contents: DataFrame, table: str) -> DataFrame:
    """A table of TABLES from rows (archive, content); an unreadable archive fails the query."""
    ship(contents.sparkSession)
    names = [c.split(" ", 1)[0] for c in _split(TABLES[table])]
    schema = f"archive string, {TABLES[table]}"
    kinds = contents.sparkSession.createDataFrame([], schema).toArrow().schema

    def f(batches):
        for batch in batches:
            for archive, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = [{"archive": archive} | {n: r.get(n) for n in names} for r in rows(content.as_py(), table)]
                if found:
                    yield pa.RecordBatch.from_pylist(found, kinds)

    return contents.select(F.col("archive").cast("string").alias("archive"), "content").mapInArrow(f, schema)


def discover(spark: SparkSession, path: str) -> DataFrame:
    """archive, content, length of the files under a path that begin or end as archives do."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.where(is_archive(F.col("content"))).select(F.col("path").alias("archive"), "content", "length").orderBy("archive")


def is_archive(content: Column) -> Column:
    """A block's magic at the beginning, or a footer's where the footer is."""
    return (F.substring(content, 1, 4) == F.lit(BLOCK)) | (F.substring(content, F.octet_length(content) - FOOTER_LENGTH + 1, F.lit(4)) == F.lit(FOOTER))


def read(spark: SparkSession, path: str, table: str) -> DataFrame:
    """A table of TABLES over all archives under a path, with the archive of each row; an unreadable archive fails the read."""
    return parse(spark.read.format("binaryFile").load(path).select(F.col("path").alias("archive"), "content"), table)


def pack(files: DataFrame, by: str = "archive", records: DataFrame | None = None, dictionaries: dict[int, bytes] | None = None, ledger: bool = False) -> DataFrame:
    """archive, content: one archive for each value of ``by`` from rows (entry_path, kind, data).

    ``records`` (archive, json) become metadata blocks; with a ledger the file map is written too.
    """
    ship(files.sparkSession)
    rows_ = files.select(F.col(by).alias("archive"), "entry_path", "kind", "data", F.lit(None).cast("string").alias("json"))
    if records is not None:
        none = [F.lit(None).cast(t).alias(n) for n, t in (("entry_path", "string"), ("kind", "string"), ("data", "binary"))]
        rows_ = rows_.unionByName(records.select("archive", *none, "json"))

    def f(key, frame):
        import pandas as pd

        entries = frame[frame["kind"].notna()]
        notes = sorted(x for x in frame["json"] if x is not None)
        held = [{"entry_path": p, "kind": k, "data": d} for p, k, d in zip(entries["entry_path"], entries["kind"], entries["data"], strict=True)]
        known = {"files": [{"path": e["entry_path"], "size": len(e["data"] or b"")} for e in sorted(held, key=lambda e: e["entry_path"]) if e["kind"] == "regular"]} if ledger else None
        return pd.DataFrame({"archive": [str(key[0])], "content": [encode(held, dictionaries=dictionaries, ledger=known, records=[x.encode() for x in notes])]})

    return rows_.groupBy("archive").applyInPandas(f, "archive string, content binary")


def extracted(contents: DataFrame) -> DataFrame:
    """archive, entry_path, size, sha256, verdict (safe or refused) of every regular file, by strict extraction."""
    ship(contents.sparkSession)

    def f(batches):
        for batch in batches:
            out = []
            for archive, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                done, refused = extract(content.as_py())
                out += [(archive, p, len(v), hashlib.sha256(v).hexdigest(), "safe") for p, v in done.items()] + [(archive, p, None, None, "refused") for p in refused]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()), strict=True)], ["archive", "entry_path", "size", "sha256", "verdict"])

    return contents.select("archive", "content").mapInArrow(f, "archive string, entry_path string, size long, sha256 string, verdict string")


class Ranges:
    """Ranges of the files of one archive, whose tail, index and block headers are read once."""

    def __init__(self, data: bytes):
        self.data, parts = data, tail(data)
        self.dictionaries, self.blocks_end = parts["dictionaries"], parts["footer"]["blocks_end"]
        self.entries: dict[str, dict] = {}
        for e in decode_index(parts["index"]):
            if e["kind"] == "regular":
                self.entries.setdefault(e["entry_path"], e)
        self.blocks: dict[int, dict] | None = None  # scanned when a range first touches one
        self.last: tuple[int, bytes] | None = None

    def block(self, number: int) -> bytes:
        """A block's raw bytes; the last one is held, for ranges in order."""
        if self.last is None or self.last[0] != number:
            h = self.blocks[number]
            self.last = number, decompress(h, self.data[h["payload_offset"] : h["payload_offset"] + h["comp_len"]], self.dictionaries)
        return self.last[1]

    def read(self, path: str, offset: int, length: int) -> bytes:
        """Bytes of a file, decoding only the blocks that the range touches."""
        entry = self.entries.get(path)
        check(entry is not None, f"{path} is no regular file")
        end = min(offset + length, entry["size"])
        touched = [x for x in entry["extents"] if x["logical_offset"] < end and x["logical_offset"] + x["len"] > offset]
        if touched and self.blocks is None:
            self.blocks = {h["block_id"]: h for h in scan(self.data, self.blocks_end)}
        out = bytearray(max(0, end - offset))  # what no extent holds is a hole
        for x in touched:
            raw = self.block(x["block_id"])
            a, b = max(offset, x["logical_offset"]), min(end, x["logical_offset"] + x["len"])
            at = x["offset"] + a - x["logical_offset"]
            out[a - offset : b - offset] = raw[at : at + b - a]
        return bytes(out)


def read_range(data: bytes, path: str, offset: int, length: int) -> bytes:
    """Bytes of a file, decoding only the blocks that the range touches."""
    return Ranges(data).read(path, offset, length)


#: Bytes of ranges that a task gathers before it hands them on.
RANGES_HELD = 4 << 20


def ranges_of(contents: DataFrame, wanted: DataFrame) -> DataFrame:
    """archive, entry_path, offset, body of the wanted ranges (archive, entry_path, offset, length); each archive is parsed once."""
    ship(contents.sparkSession)
    asked = wanted.groupBy(F.col("archive").cast("string").alias("_a")).agg(F.sort_array(F.collect_list(F.struct("entry_path", "offset", "length"))).alias("asked"))
    kinds = (pa.string(), pa.string(), pa.int64(), pa.binary())

    def f(batches):
        def batch_of(out):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["archive", "entry_path", "offset", "body"])

        for batch in batches:
            out, held = [], 0
            for archive, content, asked in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                file = Ranges(content.as_py())
                for q in asked.as_py():
                    body = file.read(q["entry_path"], q["offset"], q["length"])
                    out.append((archive, q["entry_path"], q["offset"], body))
                    held += len(body)
                    if held > RANGES_HELD:
                        yield batch_of(out)
                        out, held = [], 0
            if out:
                yield batch_of(out)

    return contents.join(asked, F.col("archive") == F.col("_a")).select("archive", "content", "asked").mapInArrow(f, "archive string, entry_path string, offset long, body binary")


def _split(schema: str) -> list[str]:
    """Top-level columns of a schema string."""
    out, depth, last = [], 0, 0
    for i, c in enumerate(schema):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(schema[last:i].strip())
            last = i + 1
    return [*out, schema[last:].strip()]


def write(files: DataFrame, folder: str, by: str = "archive") -> int:
    """Write one archive for each value of ``by`` from rows (entry_path, kind, data) into a folder that all executors mount; returns how many."""
    ship(files.sparkSession)

    def f(key, frame):
        import pathlib

        import pandas as pd

        target = pathlib.Path(folder) / f"{key[0]}.arc"
        target.parent.mkdir(parents=True, exist_ok=True)
        partial = target.with_suffix(".partial")
        partial.write_bytes(encode([{"entry_path": p, "kind": k, "data": d} for p, k, d in zip(frame["entry_path"], frame["kind"], frame["data"], strict=True)]))
        partial.replace(target)  # a task that runs again writes the same file
        return pd.DataFrame({"archive": [str(key[0])], "bytes": [target.stat().st_size]})

    return files.groupBy(by).applyInPandas(f, "archive string, bytes long").count()
