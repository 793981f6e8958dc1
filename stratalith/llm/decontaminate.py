"""Benchmark decontamination: a prefix-filtered set join over item-sized windows.

Every benchmark item gives windows of ``window`` consecutive words (an item with fewer
words, but at least one, is a single window). A window is found in a document only if
all its words stand there in order, so the required overlap is the whole window and the
prefix of a window, in the global order of words by rarity, is its single rarest word.

1. Words of the items are counted in all documents; rarity orders them.
2. Each window is indexed under its rarest word, with that word's place in the window.
3. A document word that equals a prefix word proposes the window at one exact place
   (positional bound); a proposal that would begin before the document's first word or
   end after its last is dropped (length bound).
4. Survivors are verified on all words in order.

Documents are never shuffled. The items' words are a stored table; it is read in blocks of at
most ``block_words`` words (one longer item is a block of its own), and each block's index is
broadcast, meets all documents and is dropped. So neither the driver
nor a task ever holds more than two blocks, whatever the benchmark's size; what several blocks
find meets by document.

Null or empty texts have no words and are never hit; items without words and items with a
null id are ignored; repeated items and repeated item ids count once per id; extra columns,
whatever they are called, are ignored by ``hits`` and kept by ``remove_contaminated``, which
judges every row by its own text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, functions as F

from . import storage, textkit as tk

#: Words of a window.
WINDOW = 10
#: Words of benchmark items that are sent to the executors at a time.
BLOCK_WORDS = 1 << 18


def _hashes(column: pa.Array) -> tuple[tk.Words, np.ndarray]:
    raw, offsets = tk.strings(column)
    data = tk.LOWER[raw]
    words = tk.Words(data, offsets, tk.ALNUM)
    return words, tk.Bytes(data).span(words.starts, words.ends)


def _item_words(items: DataFrame) -> DataFrame:
    """item_id, words array<long>: the word fingerprints of every item with words."""

    def f(batch):
        words, h = _hashes(batch.column(1))
        keep = np.flatnonzero(words.counts)
        lists = pa.ListArray.from_arrays(pa.array(words.bounds.astype(np.int32)), pa.array(h.view(np.int64)))
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep)), lists.take(pa.array(keep))], ["item_id", "words"])

    return tk.map_texts(items, "item_id string, words array<long>", f, [F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")])


def _rarity(docs: DataFrame, vocabulary: np.ndarray) -> dict[int, int]:
    """How often each item word stands in the documents; at most one row per item word returns."""

    def f(batches):
        total = np.zeros(len(vocabulary), np.int64)
        for batch in batches:
            column = batch.column(0)
            for a, b in tk.slices(tk.strings(column)[1]):
                _, h = _hashes(column.slice(a, b - a))
                at = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
                total += np.bincount(at[vocabulary[at] == h], minlength=len(vocabulary))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(vocabulary[seen].view(np.int64)), pa.array(total[seen])], ["word", "n"])

    counts = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(f, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {r["word"] & (1 << 64) - 1: r["n"] for r in counts.collect()}


class Index:
    """Windows of a block of items under their rarest word: a few arrays of fixed-size rows."""

    def __init__(self, items: list[tuple[str, np.ndarray]], rarity: dict[int, int], window: int):
        self.ids = sorted({i for i, _ in items})
        place = {x: k for k, x in enumerate(self.ids)}
        found: dict[bytes, set[int]] = {}
        for name, words in items:
            for k in range(max(1, len(words) - window + 1)):
                found.setdefault(words[k : k + window].tobytes(), set()).add(place[name])
        rows = []
        for key, owners in found.items():
            words = np.frombuffer(key, np.uint64)
            rare = min(range(len(words)), key=lambda j: (rarity.get(int(words[j]), 0), int(words[j]), j))
            rows.append((int(words[rare]), rare, words, sorted(owners)))
        rows.sort(key=lambda r: r[0])
        self.prefix = np.array([r[0] for r in rows], np.uint64)
        self.place = np.array([r[1] for r in rows], np.int64)
        self.size = np.array([len(r[2]) for r in rows], np.int64)
        self.words = np.zeros((len(rows), window), np.uint64)
        for k, r in enumerate(rows):
            self.words[k, : len(r[2])] = r[2]
        self.owner_at = np.cumsum([0, *(len(r[3]) for r in rows)])
        self.owners = np.array([x for r in rows for x in r[3]], np.int64)

    def find(self, words: tk.Words, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First word and window of every verified occurrence."""
        if not len(self.prefix) or not len(h):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        low = np.searchsorted(self.prefix, h, "left")
        low[low == len(self.prefix)] = 0
        at = np.flatnonzero(self.prefix[low] == h)
        low = low[at]
        many = np.searchsorted(self.prefix, h[at], "right") - low
        word = np.repeat(at, many)
        found = np.repeat(low, many) + np.arange(len(word)) - np.repeat(np.cumsum(many) - many, many)
        row = np.searchsorted(words.bounds, word, "right") - 1
        first = word - self.place[found]
        fits = (first >= words.bounds[row]) & (first + self.size[found] <= words.bounds[row + 1])
        first, found = first[fits], found[fits]
        for j in range(self.words.shape[1]):
            same = (j >= self.size[found]) | (h[np.minimum(first + j, len(h) - 1)] == self.words[found, j])
            first, found = first[same], found[same]
        return first, found


def _blocks(items: Iterator[tuple[str, np.ndarray]], limit: int) -> Iterator[list[tuple[str, np.ndarray]]]:
    block, n = [], 0
    for item in items:
        if block and n + len(item[1]) > limit:
            yield block
            block, n = [], 0
        block.append(item)
        n += len(item[1])
    if block:
        yield block


def indexes(docs: DataFrame, items: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> Iterator[Broadcast]:
    """The index of one block of items after the other, by the rarity of words in docs."""
    table = storage.store(_item_words(items.where("item_id is not null")), "items")
    rows = ((r["item_id"], np.array(r["words"], np.int64).view(np.uint64)) for r in table.toLocalIterator())
    for block in _blocks(rows, block_words):
        vocabulary = np.unique(np.concatenate([w for _, w in block]))
        yield docs.sparkSession.sparkContext.broadcast(Index(block, _rarity(docs, vocabulary), window))


def _found(index: Index, words: tk.Words, h: np.ndarray) -> tuple[np.ndarray, dict[int, set[str]]]:
    """Which words an index covers, and the ids of the items whose windows stand in each row."""
    first, found = index.find(words, h)
    hit = np.zeros(len(h) + 1, np.int64)
    np.add.at(hit, first, 1)
    np.add.at(hit, first + index.size[found], -1)
    owned: dict[int, set[str]] = {}
    row = np.searchsorted(words.bounds, first, "right") - 1
    for r, w in zip(row.tolist(), found.tolist(), strict=True):
        owned.setdefault(r, set()).update(index.ids[x] for x in index.owners[index.owner_at[w] : index.owner_at[w + 1]])
    return np.cumsum(hit[:-1]) > 0, owned


_HITS = "doc_id long, n_words long, n_hit long, item_ids array<string>, hit_words array<long>"


def hits(docs: DataFrame, items: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, n_words, n_hit, item_ids (sorted array), hit_words (array of word places that are hit).

    One row per input row, in input partitions.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def met(sent: Broadcast | None, every: bool) -> DataFrame:
        def f(batch):
            words, h = _hashes(batch.column(1))
            covered, owned = _found(sent.value, words, h) if sent else (np.zeros(len(h), bool), {})
            n_hit = tk.per_row(covered, words.bounds)
            keep = np.arange(batch.num_rows) if every else np.flatnonzero(n_hit)
            spots = np.flatnonzero(covered)
            spots -= np.repeat(words.bounds[:-1], n_hit)
            places = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n_hit[keep])]).astype(np.int32)), pa.array(spots.astype(np.int64)))
            ids = pa.array([sorted(owned.get(r, ())) for r in keep.tolist()], pa.list_(pa.string()))
            own = [batch.column(0).take(pa.array(keep)), pa.array(words.counts[keep].astype(np.int64)), pa.array(n_hit[keep]), ids, places]
            yield pa.RecordBatch.from_arrays([*own, batch.column(1).take(pa.array(keep))][: 5 + (not every)], ["doc_id", "n_words", "n_hit", "item_ids", "hit_words", "text"][: 5 + (not every)])

        found = tk.map_texts(texts, _HITS + (", text string" if not every else ""), f, ["doc_id", "text"])
        # rows are told apart by id and text: rows with the same of both have the same hits
        return found if every else found.select("doc_id", F.xxhash64("text").alias("h1"), F.crc32(F.col("text").cast("binary")).alias("h2"), "n_words", "item_ids", "hit_words")

    sent = indexes(texts, items, window, block_words)
    first, second = next(sent, None), next(sent, None)
    if second is None:
        return met(first, True)
    parts = []
    for block in chain((first, second), sent):
        parts.append(storage.store(met(block, False), "hits"))
        block.destroy()
    merged = reduce(DataFrame.unionByName, parts).groupBy("doc_id", "h1", "h2").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("item_ids")))).alias("item_ids"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("hit_words")))).alias("hit_words"))
    merged = merged.select(F.col("doc_id").alias("_id"), F.col("h1").alias("_h1"), F.col("h2").alias("_h2"), F.col("item_ids").alias("_items"), F.col("hit_words").alias("_words"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2"))
    counted = texts.select("doc_id", F.xxhash64("text").alias("h1"), F.crc32(F.col("text").cast("binary")).alias("h2"), _word_count().alias("n_words"))
    out = counted.join(merged, same, "left").withColumns({"item_ids": F.coalesce("_items", F.array().cast("array<string>")), "hit_words": F.coalesce("_words", F.array().cast("array<long>"))})
    return out.select("doc_id", "n_words", F.size("hit_words").cast("long").alias("n_hit"), "item_ids", "hit_words")


def _word_count() -> Column:
    """How many words a text has, on the JVM side."""
    return F.coalesce(F.size(F.regexp_extract_all(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(r"([^\x00-\x2F\x3A-\x60\x7B-\x7F]+)"), 1)), F.lit(0)).cast("long")


def digest(found: DataFrame) -> DataFrame:
    """The per-document report of a hits() table."""
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "item_ids").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def remove_contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows in whose text no benchmark window occurs, with all their columns."""
    at = docs.columns.index("text")
    texts = docs.toDF(*(f"c{k}" for k in range(len(docs.columns)))).select(F.col(f"c{at}").cast("string").alias("text"))
    sent = indexes(texts, items, window, block_words)
    out, last = docs, next(sent, None)
    for block in sent:
        out = storage.store(_clean(out, last), "clean")
        last.destroy()
        last = block
    return out if last is None else _clean(out, last)


def _clean(docs: DataFrame, sent: Broadcast) -> DataFrame:
    def verdict(column):
        words, h = _hashes(column)
        return tk.per_row(_found(sent.value, words, h)[0], words.bounds) == 0

    return tk.keep_rows(docs, "text", verdict)


def plain(text: str | None, items: list[tuple[str, str | None]], window: int = WINDOW) -> tuple[int, int, int, str, bool]:
    """The same report for one text by direct comparison, for tests."""
    import re

    split = lambda s: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), s or ""))
    words, hit, owners = split(text), set(), set()
    for name, item in items:
        own = split(item)
        for k in range(max(1, len(own) - window + 1) if own else 0):
            part = own[k : k + window]
            for i in range(len(words) - len(part) + 1):
                if words[i : i + len(part)] == part:
                    hit.update(range(i, i + len(part)))
                    owners.add(str(name))
    return len(words), len(hit), len(owners), hashlib.sha256(",".join(sorted(owners)).encode()).hexdigest(), bool(hit)
