"""Damage: locked corruption of archives with a mutation log, and the damages of the survivability experiment.

Where a mutation lies follows from the archive's length alone, so ``mutations`` is column
expressions; ``corrupt`` applies it to the bytes in numpy, one archive a row, and gives digests
before and after.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..shipping import ship

# Locked seeds, magnitudes in bytes, and the factors that mix a damaged byte.
SEEDS = [1337, 2600, 65535]
MAGNITUDES = {"1B": 1, "256B": 256, "4KB": 4096}
SEED_FACTOR, OFFSET_FACTOR, ORDINAL_FACTOR, TAIL_MASK = 0x9E3779B9, 0x85EBCA6B, 0xC2B2AE35, 0xA5


def region(size: Column, target: Column) -> tuple[Column, Column]:
    """Begin and end of a target within an archive of a size: its first eighth, up to half, up to seven eighths, the rest."""
    header = F.greatest(F.floor(size / 8), F.lit(1))
    index = F.least(F.greatest(F.floor(size / 2), header + 1), size)
    payload = F.least(F.greatest(F.floor(size * 7 / 8), index + 1), size)
    begin = F.when(target == "header", 0).when(target == "index", F.least(header, size)).when(target == "payload", index).otherwise(payload)
    end = F.when(target == "header", F.least(header, size)).when(target == "index", index).when(target == "payload", payload).otherwise(size)
    none = size == 0
    return F.when(none, 0).otherwise(begin).cast("long"), F.when(none, 0).otherwise(end).cast("long")


def mutations(rows: DataFrame, size: str = "size") -> DataFrame:
    """Rows (corruption_type, target, magnitude_bytes, seed, size) with range_start, range_end and new_size; nothing is touched where the region is empty."""
    begin, end = region(F.col(size), F.col("target"))
    out = rows.withColumns({"_begin": begin, "_end": end})
    span = F.col("_end") - F.col("_begin")
    kind, want = F.col("corruption_type"), F.col("magnitude_bytes").cast("long")
    count = F.least(want, span)
    pick = lambda n: F.when(n >= span, F.col("_begin")).otherwise(F.col("_begin") + F.col("seed") % (span - n + 1))
    cut = F.least(want, F.greatest(F.col(size) - pick(F.lit(1)), F.lit(0)))
    start = F.when(kind == "truncation", F.col(size) - cut).when(kind == "tail_damage", F.col("_end") - count).otherwise(pick(count))
    stop = F.when(kind == "truncation", F.col(size)).when(kind == "tail_damage", F.col("_end")).otherwise(pick(count) + count)
    some = span > 0
    out = out.withColumns({"range_start": F.when(some, start).cast("long"), "range_end": F.when(some, stop).cast("long")})
    shorter = F.when(some & (kind == "truncation"), F.col("range_start")).otherwise(F.col(size))
    return out.withColumn("new_size", shorter.cast("long")).drop("_begin", "_end")


def masks(seed: int, offsets: np.ndarray) -> np.ndarray:
    """The byte that each place is damaged with, by seed, offset and order."""
    with np.errstate(over="ignore"):
        mixed = np.uint64(seed) * np.uint64(SEED_FACTOR) + offsets.astype(np.uint64) * np.uint64(OFFSET_FACTOR) + np.arange(len(offsets), dtype=np.uint64) * np.uint64(ORDINAL_FACTOR)
    return ((mixed ^ (mixed >> np.uint64(16)) ^ (mixed >> np.uint64(32))) & np.uint64(255)).astype(np.uint8)


def damaged(data: bytes, kind: str, seed: int, start: int | None, stop: int | None) -> bytes:
    """The bytes after a mutation of a range."""
    if start is None:
        return data
    if kind == "truncation":
        return data[:start]
    out = np.frombuffer(data, np.uint8).copy()
    part, places = out[start:stop], np.arange(start, stop)
    if kind == "bit_flip":
        part ^= (1 << ((seed + np.arange(stop - start)) % 8)).astype(np.uint8)
    elif kind == "byte_overwrite":
        part[:] = masks(seed, places)
    elif kind == "zero_fill":
        part[:] = 0
    elif kind == "tail_damage":
        part ^= masks(seed, places) ^ np.uint8(TAIL_MASK)
    else:
        raise ValueError(f"unknown corruption {kind}")
    return out.tobytes()


def corrupt(rows: DataFrame, key: str, content: str = "content") -> DataFrame:
    """key, range_start, range_end, new_size, before, after (SHA-256) and the damaged content: the mutation log of every row."""
    ship(rows.sparkSession)
    placed = mutations(rows.withColumn("_size", F.octet_length(content).cast("long")), "_size")

    def f(batches):
        for b in batches:
            if b.num_rows:
                seeds = b.column(2).to_pylist()
                if set(seeds) - set(SEEDS):
                    raise ValueError(f"seeds must be of {SEEDS}")
                raw = [x.as_py() or b"" for x in b.column(6)]
                out = [damaged(*x) for x in zip(raw, b.column(1).to_pylist(), seeds, b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True)]
                sha = lambda xs: pa.array([hashlib.sha256(x).hexdigest() for x in xs], pa.string())
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(3), b.column(4), b.column(5), sha(raw), sha(out), pa.array(out, pa.binary())], ["key", "range_start", "range_end", "new_size", "before", "after", "content"])

    told = placed.select(F.col(key).cast("string").alias("key"), "corruption_type", F.col("seed").cast("long").alias("seed"), "range_start", "range_end", "new_size", F.col(content).alias("content"))
    return told.mapInArrow(f, "key string, range_start long, range_end long, new_size long, before string, after string, content binary")


# Masks of the survivability damages.
FLIP, FLIP_PERIOD, FILL, FILL_PERIOD = 0xA5, 17, 0x55, 101


def clobber(data: np.ndarray, start: int, length: int, mode: str) -> None:
    """Damage a range in place: zeros, every second byte zero, flipped bits or a pattern."""
    part = data[start : start + length]
    k = np.arange(len(part))
    if mode == "delete":
        part[:] = 0
    elif mode == "truncate":
        part[::2] = 0
    elif mode == "bitflip":
        part ^= (FLIP ^ (k % FLIP_PERIOD)).astype(np.uint8)
    else:
        part[:] = (FILL + k % FILL_PERIOD).astype(np.uint8)


def damage_payload(content: bytes, how: str, seed: int, tail: int) -> bytes:
    """A payload damage of the survivability experiment: blocks are a sixteenth of what lies between the first 64 bytes and the tail."""
    size = len(content)
    begin, end = min(64, size), max(0, size - (tail + 128))
    if begin >= end or how == "none":
        return content
    data, span = np.frombuffer(content, np.uint8).copy(), end - begin
    block = max(span // 16, 64)
    at = begin + min(seed % 7 * block // 2, max(0, span - 1))
    if how == "single_block_delete":
        clobber(data, at, block, "delete")
    elif how == "sparse_delete":
        for k in range(4):
            clobber(data, at + k * (block // 2), block // 3, "delete")
    elif how == "cluster_delete":
        clobber(data, at, block * 3 // 2, "delete")
    elif how == "block_reorder":
        other = min(at + block, max(0, end - block))
        if other > at and other + block <= end:
            first, second = data[at : at + block].copy(), data[other : other + block].copy()
            data[at : at + block] = second
            data[other : other + block] = first
    elif how == "duplicate_block_insert":
        stop = min(at + block, end)
        into = min(stop + block // 2, end)
        return b"".join([content[:into], content[at:stop], content[into:]])
    return data.tobytes()
