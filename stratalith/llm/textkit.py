"""Vectorised UTF-8 text primitives shared by the operators.

Text columns reach Python as Arrow buffers. Everything here works on those bytes in
slices of bounded size (``slices``), so a worker's memory depends on the slice limit and
on the longest single text, never on the number of rows.

Fingerprints absorb 8 bytes at a time by ``absorb``: a bijection of the state for every input
and of the input for every state, whose multiplications and shifts no polynomial identity
survives (a polynomial modulo 2**64 is equal for a Thue-Morse string and its complement,
whatever its base). The length is part of the state, so a span's fingerprint depends on its
bytes alone. Different spans collide by chance only, with odds of 2**-64 a pair.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

#: Bytes of text that are expanded to numpy columns at a time.
SLICE_BYTES = 1 << 19
#: Bytes of a span that are absorbed one after the other; longer ones go block by block, then by their blocks' fingerprints.
BLOCK_BYTES = 512

_SEED, _A, _B = np.uint64(0xD6E8FEB86659FD93), np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: What is left of a word of 8 bytes of which the first 0..8 belong to a span.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finisher: every output bit depends on every input bit."""
    with np.errstate(over="ignore"):
        h = h ^ (h >> np.uint64(31))
        h = h * np.uint64(0x7FB5D329728EA185)
        h = h ^ (h >> np.uint64(27))
        h = h * np.uint64(0x81DADEF4BC2DD44D)
        return h ^ (h >> np.uint64(33))


def absorb(h: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The state after an input of 8 bytes."""
    with np.errstate(over="ignore"):
        h = (h ^ x) * _A
        h ^= h >> np.uint64(32)
        h *= _B
        h ^= h >> np.uint64(29)
        return h


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Fingerprints of all runs of k fingerprints."""
    n = max(0, len(h) - k + 1)
    out = np.full(n, _SEED + np.uint64(k))
    for j in range(k):
        out = absorb(out, h[j : j + n])
    return mix(out)


def repeated(h: np.ndarray, times: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the fingerprints that stand at least so many times in h, and those fingerprints."""
    cell = (h >> np.uint64(46)).astype(np.int64)
    likely = np.flatnonzero(np.bincount(cell, minlength=1 << 18)[cell] >= times)  # few are left to be sorted
    names, back, count = np.unique(h[likely], return_inverse=True, return_counts=True)
    return likely[count[back] >= times], names[count >= times]


class Bytes:
    """Fingerprints of spans of a column of bytes."""

    def __init__(self, data: np.ndarray):
        padded = np.zeros(len(data) + 8, np.uint8)
        padded[: len(data)] = data
        self.words = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))

    def span(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Fingerprints of bytes a..b-1."""
        size = b - a
        with np.errstate(over="ignore"):
            h = mix(size.astype(np.uint64) + _SEED)
        long = size > BLOCK_BYTES
        if long.any():
            at = np.flatnonzero(long)
            per = -(-size[at] // BLOCK_BYTES)
            cuts = np.concatenate([[0], np.cumsum(per)])
            first = np.repeat(a[at] - BLOCK_BYTES * cuts[:-1], per) + BLOCK_BYTES * np.arange(cuts[-1])
            blocks = self.span(first, np.minimum(first + BLOCK_BYTES, np.repeat(b[at], per)))
            h[at] = absorb(h[at], Bytes(blocks.view(np.uint8)).span(8 * cuts[:-1], 8 * cuts[1:]))
        live = np.flatnonzero((size > 0) & ~long)
        at, left = a[live], size[live]
        while len(live):
            h[live] = absorb(h[live], self.words[at] & _FIRST[np.minimum(left, 8)])
            more = left > 8
            live, at, left = live[more], at[more] + 8, left[more] - 8
        return mix(h)

    def windows(self, k: int) -> np.ndarray:
        """Fingerprints of all windows of k bytes, as ``span`` gives them."""
        n = max(0, len(self.words) - k)
        with np.errstate(over="ignore"):
            h = np.full(n, mix(np.uint64(k) + _SEED))
        for j in range(0, k, 8):
            x = self.words[j : j + n]
            h = absorb(h, x if k - j >= 8 else x & _FIRST[k - j])
        return mix(h)


def table(pattern_bytes) -> np.ndarray:
    """A 256-entry boolean lookup that holds the given byte values."""
    out = np.zeros(256, bool)
    out[list(pattern_bytes)] = True
    return out


#: Bytes of words [^\x20\x09-\x0D]+ (white space is ASCII, so UTF-8 bytes decide).
WORD = ~table([0x20, *range(0x09, 0x0E)])
#: Bytes of words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after A-Z are lower-cased.
ALNUM = ~table([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets (one more than rows, from 0) of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    n, kind = len(column), np.int64 if wide else np.int32
    if n == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.empty(0, np.uint8)
    return raw, at - at[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most limit bytes each; a longer row stands alone."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(n, max(last, first + 1))
        yield first, last
        first = last


class Words:
    """Word spans of a slice of texts: starts, ends (byte positions) and how many each row has."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, letters: np.ndarray):
        inside = np.zeros(len(data) + 1, bool)
        inside[:-1] = letters[data]
        begins = inside[:-1].copy()
        begins[1:] &= ~inside[:-2]
        edges = offsets[:-1][offsets[:-1] < len(data)]
        begins[edges] = inside[edges]
        stops = inside[:-1] & ~inside[1:]
        edges = offsets[1:][offsets[1:] > 0] - 1
        stops[edges] = inside[edges]
        self.starts = np.flatnonzero(begins)
        self.ends = np.flatnonzero(stops) + 1
        self.bounds = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.bounds)

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def windows(self, k: int) -> np.ndarray:
        """First word of every window of k words that stays within its row."""
        n = len(self.starts)
        fits = np.zeros(n, bool)
        left = np.repeat(self.bounds[1:], self.counts) - np.arange(n)
        fits[left >= k] = True
        return np.flatnonzero(fits)


def per_row(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of a per-byte or per-word column over each row."""
    sums = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def release() -> None:
    """Give freed memory back to the system: a worker that later stages reuse keeps nothing."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def map_texts(df: DataFrame, schema: str | T.StructType, f: Callable[..., Iterator[pa.RecordBatch]], columns: list[str | Column], state: Callable | None = None) -> DataFrame:
    """Run f over slices of bounded bytes of the given columns; the text is the last column.

    ``state`` makes what f gets beside the slices, once a task.
    """

    def run(batches):
        own = () if state is None else (state(),)
        for batch in batches:
            offsets = strings(batch.column(batch.num_columns - 1))[1]
            for a, b in slices(offsets):
                yield from f(batch.slice(a, b - a), *own)
        del own
        release()

    return df.select(*columns).mapInArrow(run, schema)


def keep_rows(df: DataFrame, text: str, verdict: Callable[[pa.Array], np.ndarray]) -> DataFrame:
    """The rows of df whose own text the verdict keeps, with all their columns, whatever these are called."""
    schema = df.schema

    def f(batch):
        kept = np.flatnonzero(verdict(batch.column(batch.num_columns - 1)))
        if len(kept):
            yield batch.select(range(batch.num_columns - 1)).take(pa.array(kept))

    # columns go through Python by place: a name may stand twice
    numbered = df.toDF(*(f"c{k}" for k in range(len(schema))))
    at = [field.name for field in schema].index(text)
    columns = [F.col(f"c{k}") for k in range(len(schema))]
    out = map_texts(numbered, T.StructType([T.StructField(f"c{k}", field.dataType) for k, field in enumerate(schema)]), f, [*columns, F.col(f"c{at}").cast("string").alias("text")])
    return out.toDF(*(field.name for field in schema))
