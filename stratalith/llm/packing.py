"""Best-fit decreasing packing of tokenised documents into sequences of a fixed capacity.

1. ``pieces`` tokenises every document where it lies (the ids of a word's letters, digits and
   marks do not depend on their neighbours, so each distinct part is tokenised once), ends
   it with id 0 and cuts what is longer than a sequence.
2. Lengths run from 1 to the capacity, so the corpus enters the packing as a histogram of
   at most ``capacity`` counts. ``plan`` places pieces in decreasing length: a segment
   tree over remaining capacities finds the tightest open bin in O(log capacity); equal
   pieces that go to equal bins are placed as one run. This is exactly best-fit
   decreasing over all pieces, whatever their number, and the plan's size depends on the
   capacity only.
3. Every piece gets its rank among pieces of its length (ranks within small hashed groups
   plus the counts of earlier groups, so no length gathers in one task) and looks its
   place up in the plan.

Null and empty texts are the single id 0. Repeated rows are packed as often as they
stand. Extra columns are ignored. An empty table gives an empty table.
"""

from __future__ import annotations

import os
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from . import storage, textkit as tk

CAPACITY = 2048
#: Pieces of words whose ids a worker remembers.
CACHE_WORDS = 500_000
#: Parts that the tokenizer is handed at a time.
LEARN_PARTS = 4096
#: Pieces of a rank group, about.
GROUP_ROWS = 50_000


#: ASCII bytes by kind: 1 letters, 2 digits, 3 marks; 0 tells nothing.
_KIND = np.zeros(256, np.uint8)
_KIND[0x21:0x7F], _KIND[0x30:0x3A], _KIND[0x41:0x5B], _KIND[0x61:0x7B] = 3, 2, 1, 1
#: Apostrophes (contractions cross kinds) and the lead bytes of Greek (a sigma's lower case depends on what follows marks).
_WHOLE = tk.table([0x27, 0xCE, 0xCF])


def _parts(data: np.ndarray, words: tk.Words) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of word parts that are tokenised alone: ASCII neighbours of different kinds, and digits, never share a token."""
    if not len(words.starts):
        return words.starts, words.ends
    kind = _KIND[data]
    inner = np.zeros(len(data), bool)
    inner[1:] = (kind[1:] > 0) & (kind[:-1] > 0) & ((kind[1:] != kind[:-1]) | (kind[1:] == 2))
    held = np.concatenate([[0], np.cumsum(_WHOLE[data])])
    whole = np.flatnonzero(held[words.ends] > held[words.starts])
    for a, b in zip(words.starts[whole].tolist(), words.ends[whole].tolist(), strict=True):
        inner[a:b] = False
    inner[words.starts] = False
    cut = np.flatnonzero(inner)
    return np.sort(np.concatenate([words.starts, cut])), np.sort(np.concatenate([words.ends, cut]))


@lru_cache(maxsize=1)
def _tokenizer(path: str):
    """One tokenizer a process: what a dropped one has cached is not given back (some 33 MB each).

    It runs without threads of its own: a task has a core, and threads on words cost twice the CPU time.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
    return tokenizer


class Encoder:
    """Token ids of slices of texts, with the ids of known word parts kept; white space parts words.

    What is kept is a few arrays: ``cache`` parts of about 16 bytes and their ids.
    """

    def __init__(self, path: str, cache: int = CACHE_WORDS):
        self.tokenizer = _tokenizer(path)
        self.limit = cache
        self._clear()

    def _clear(self) -> None:
        self.keys, self.begin, self.size = np.empty(0, np.uint64), np.empty(0, np.int32), np.empty(0, np.int32)
        self.flat = np.empty(0, np.uint32)

    def _learn(self, keys: np.ndarray, texts: list[str]) -> None:
        """Keep the ids of new parts; keys are sorted."""
        found, sizes = [self.flat], []
        for k in range(0, len(texts), LEARN_PARTS):
            ids = [e.ids for e in self.tokenizer.encode_batch(texts[k : k + LEARN_PARTS], add_special_tokens=False)]
            sizes += map(len, ids)
            found.append(np.fromiter((x for own in ids for x in own), np.uint32, sum(map(len, ids))))
        size = np.array(sizes, np.int32)
        begin = len(self.flat) + np.concatenate([[0], np.cumsum(size)[:-1]])
        self.flat = np.concatenate(found)
        at = np.searchsorted(self.keys, keys)
        self.keys, self.begin, self.size = np.insert(self.keys, at, keys), np.insert(self.begin, at, begin.astype(np.int32)), np.insert(self.size, at, size)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the rows in order, each row ended by 0, and the row bounds."""
        data, offsets = tk.strings(column)
        data = tk.LOWER[data]  # the tokenizer lower-cases
        starts, ends = _parts(data, tk.Words(data, offsets, tk.WORD))
        in_row = np.searchsorted(starts, offsets)
        keys, first, back = np.unique(tk.Bytes(data).span(starts, ends), return_index=True, return_inverse=True)
        if len(self.keys) > self.limit:
            self._clear()
        slot = np.searchsorted(self.keys, keys)
        new = np.ones(len(keys), bool)
        held = slot < len(self.keys)
        new[held] = self.keys[slot[held]] != keys[held]
        if new.any():
            raw, at = data.tobytes(), first[new]
            self._learn(keys[new], [raw[a:b].decode("utf-8", "replace") for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)])
            slot = np.searchsorted(self.keys, keys)
        begin, size = self.begin[slot][back].astype(np.int64), self.size[slot][back].astype(np.int64)
        row = tk.per_row(size, in_row) + 1
        bounds = np.concatenate([[0], np.cumsum(row)])
        out = np.zeros(int(bounds[-1]), "<u4")
        text = np.ones(len(out), bool)
        text[bounds[1:] - 1] = False
        total = int(size.sum())
        out[text] = self.flat[np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(total)]
        return out, bounds


@lru_cache(maxsize=1)
def _encoder(path: str) -> Encoder:
    """One encoder a process: parts that an earlier task has learned need not be learned again."""
    return Encoder(path)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: every document as pieces of at most ``capacity`` ids."""

    def f(batch, encoder):
        ids, bounds = encoder.encode(batch.column(1))
        size = np.diff(bounds)
        per = -(-size // capacity)
        rows = np.repeat(np.arange(len(size)), per)
        piece = np.arange(len(rows)) - np.repeat(np.cumsum(per) - per, per)
        start = piece * capacity
        length = np.minimum(capacity, size[rows] - start)
        at = bounds[rows] + start
        raw = memoryview(ids.tobytes())
        crc = np.fromiter((zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at.tolist(), (at + length).tolist(), strict=True)), np.int64, len(rows))
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return tk.map_texts(docs, "doc_id long, piece int, start long, length long, ids_crc32 long", f, [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")], lambda: _encoder(path))


class CapacityTree:
    """Segment tree over remaining capacities 0..capacity: how many runs of open bins have each."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.node = [0] * (2 * self.size)

    def add(self, remaining: int, change: int) -> None:
        k = remaining + self.size
        while k:
            self.node[k] += change
            k >>= 1

    def tightest(self, need: int) -> int | None:
        """The least remaining capacity of at least ``need`` that some open bin has."""
        k = need + self.size
        while not self.node[k]:
            while k & 1:  # a right child: what follows is beyond the parent
                k >>= 1
            if not k:
                return None
            k += 1
        while k < self.size:
            k = 2 * k if self.node[2 * k] else 2 * k + 1
        return k - self.size


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Rows (length, first rank, pieces, first bin, pieces a bin, offset of a bin's first piece), by length and rank.

    Pieces of a length are numbered from 0; the i-th of a row goes to bin first + i // a-bin,
    at offset + i % a-bin lengths.
    """
    tree, runs, bins, out = CapacityTree(capacity), {}, 0, []

    def opened(first: int, count: int, remaining: int) -> None:
        if remaining and count:
            runs.setdefault(remaining, []).append((first, count))
            tree.add(remaining, 1)

    for length in sorted(histogram, reverse=True):
        if not 1 <= length <= capacity:
            raise ValueError(f"a piece of length {length} does not fit {capacity}")
        left, rank = histogram[length], 0
        while left:
            room = tree.tightest(length)
            if room is None:
                room, first, count = capacity, bins, -(-left // (capacity // length))
                bins += count
            else:
                first, count = runs[room].pop()
                tree.add(room, -1)
            each = min(left, room // length)
            used = min(count, left // each)
            out.append((length, rank, used * each, first, each, capacity - room))
            opened(first, used, room - each * length)
            opened(first + used, count - used, room)
            rank, left = rank + used * each, left - used * each
    return np.array(sorted(out), np.int64).reshape(-1, 6)


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of all documents with sequence_id and offset; sequences have no gaps."""
    table = storage.store(pieces(docs, path or tokenizer_path(), capacity), "pieces")
    histogram = {r["length"]: r["count"] for r in table.groupBy("length").count().collect()}  # at most ``capacity`` rows
    if not histogram:
        return table.select("*", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    places = plan(histogram, capacity)
    key = places[:, 0] << 44 | places[:, 1]
    groups = max(1, -(-sum(histogram.values()) // GROUP_ROWS))
    keyed = table.withColumn("_group", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(groups)).cast("int"))
    earlier = Window.partitionBy("length").orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    base = keyed.groupBy("_group", "length").count().select(F.col("_group").alias("_g"), F.col("length").alias("_l"), F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("_base"))
    within = Window.partitionBy("_group", "length").orderBy("doc_id", "piece", "ids_crc32")
    ranked = keyed.withColumn("_rank", F.row_number().over(within) - 1).join(base, (F.col("_group") == F.col("_g")) & (F.col("length") == F.col("_l")))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def place(batches):
        for b in batches:
            length, rank = b.column(3).to_numpy(), b.column(5).to_numpy()
            at = np.searchsorted(key, length << 44 | rank, "right") - 1
            i, each = rank - places[at, 1], places[at, 4]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(5)), pa.array(places[at, 3] + i // each), pa.array(places[at, 5] + i % each * length)], [*columns, "sequence_id", "offset"])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return ranked.select(*columns, (F.col("_base") + F.col("_rank")).cast("long").alias("_rank")).mapInArrow(place, schema)
