"""Exact removal of repeated byte strings by merging Burrows-Wheeler transforms of shards.

A byte goes if it is covered by a string of ``LENGTH`` bytes that also starts earlier (at a
smaller id, or earlier in the same text). All strings are judged on the input.

1. Anchors. Every string of LENGTH bytes has a minimizer: the least fingerprint among its
   ``ANCHOR``-byte windows. Equal strings have equal minimizers at equal places, so each
   text is cut down to about one anchor in 35 bytes, with the fingerprint of the bytes
   around it (its context: all LENGTH-strings that hold the anchor).
2. Copies. Anchors are dealt by fingerprint and stream in order. Of equal contexts only the
   first goes on; every string of the others starts earlier elsewhere. Anchors that stand
   once, or with one context, need nothing more. An anchor that stands ``HOT_IN_SLICE`` times
   in a slice of texts is hot: its task passes on the first of equal contexts only, deals them
   by context over ``PARTS`` parts, and marks the anchor, so that rows of other tasks join
   them; firsts are then found by an aggregation over (anchor, context). So neither a common
   line nor a large group of copies meets in one task.
3. Merge. The contexts of an anchor are aligned at it. The rows of a task come as shards.
   Each shard has its positional Burrows-Wheeler transform: at a column, its strings in
   the order of the bytes before that column, last byte first. The transforms are merged
   by refining the interleave of the shards: one stable pass over the interleaved symbols
   moves the interleave on by one column, without comparing or sorting strings. The
   lengths of common prefixes (read backwards) move with it: 1 + the least length in
   between, 0 where the symbol changes. Maximal intervals with lengths of at least LENGTH
   are the repeated strings ending at the column; all but the first of each go.
4. Anchors with more than ``MOST_CONTEXTS`` different contexts are dealt once more by their
   whole strings instead: each task passes on its first occurrence of every string, and
   marks the others itself. So no task holds more contexts than that of one anchor.
5. Removal. Marked runs are collected per text, merged and cut out.

Null and empty texts have no bytes and nothing to remove. Rows with a null id are returned
as they are and count as no earlier text. Rows with the same id count as one place: a
repeated row does not remove its own copy. Extra columns, whatever they are called, are kept
by ``remove`` and ignored by ``report``; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from . import storage, textkit as tk

LENGTH, ANCHOR = 100, 24
#: Most different contexts of an anchor that are merged in one task.
MOST_CONTEXTS = 100_000
#: Contexts of a task, about.
TASK_CONTEXTS = 50_000
#: Places of an anchor in a slice of texts that make it hot, the parts its contexts are dealt to, and the hot contexts a task remembers.
HOT_IN_SLICE, PARTS, REMEMBERED = 16, 256, 200_000
_PAD = 0xFF  # stands in no UTF-8 text
_MOST = np.uint64((1 << 64) - 1)


def _slide(x: np.ndarray, w: int, f) -> np.ndarray:
    """f over every run of w values, for f = np.minimum or np.maximum; len(x) is a multiple of w, the last w are padding."""
    b = x.reshape(-1, w)
    ahead = f.accumulate(b, 1).ravel()
    behind = f.accumulate(b[:, ::-1], 1)[:, ::-1].ravel()
    n = len(x) - w
    return f(behind[:n], ahead[w - 1 : n + w - 1])


def anchors(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, k: int = ANCHOR) -> tuple[np.ndarray, np.ndarray, np.ndarray, tk.Bytes]:
    """Places of the anchors of a slice, their rows and fingerprints."""
    spans = tk.Bytes(data)
    h = spans.windows(k)
    n, w = len(h), length - k + 1
    none = np.empty(0, np.int64)
    if not n:
        return none, none, np.empty(0, np.uint64), spans
    left = np.repeat(offsets[1:], np.diff(offsets))[:n] - np.arange(n)
    h = np.where(left >= k, h, _MOST)
    size = (-(-n // w) + 1) * w
    x = np.full(size, _MOST, np.uint64)
    x[:n] = h
    least = _slide(x, w, np.minimum)[:n]
    # an anchor is the least of some string that lies in its row: the largest such minimum around it is its own value
    y = np.zeros((-(-(n + w) // w) + 1) * w, np.uint64)
    y[w - 1 : w - 1 + n] = np.where(left >= length, least, 0)
    at = np.flatnonzero((_slide(y, w, np.maximum)[:n] == h) & (left >= k))
    return at, np.searchsorted(offsets, at, "right") - 1, h[at], spans


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")


#: The context that marks a hot anchor for the part of rows that are not dealt by context, with place -1; it comes first in order.
_MARK = np.iinfo(np.int64).min


def find_anchors(docs: DataFrame, length: int, k: int, hot: int = HOT_IN_SLICE) -> DataFrame:
    """anchor, part, context (fingerprints), doc, at; part is 0, over 0 where the anchor is hot, or -1 for copies (of no anchor)."""

    def f(batch, known):
        data, offsets = tk.strings(batch.column(1))
        at, row, h, spans = anchors(data, offsets, length, k)
        low, high = np.maximum(at - (length - k), offsets[row]), np.minimum(at + length, offsets[row + 1])
        with np.errstate(over="ignore"):
            context = tk.mix(spans.span(low, high) + (at - low).astype(np.uint64)).view(np.int64)
        doc, at, anchor = batch.column(0).to_numpy()[row], at - offsets[row], h.view(np.int64)
        part = np.zeros(len(at), np.int32)
        busy, marks = tk.repeated(h, hot)
        if len(busy):
            order = busy[np.lexsort((at[busy], doc[busy], context[busy], anchor[busy]))]
            new = np.ones(len(order), bool)
            new[1:] = (anchor[order][1:] != anchor[order][:-1]) | (context[order][1:] != context[order][:-1])
            first = order[new]
            head = first[np.cumsum(new) - 1]
            part[order] = 1 + (context[order] & (PARTS - 1)).astype(np.int32)
            late = (doc[order] != doc[head]) | (at[order] != at[head])
            for i, a, c, d, p in zip(first.tolist(), anchor[first].tolist(), context[first].tolist(), doc[first].tolist(), at[first].tolist(), strict=True):
                before = known.get((a, c))
                if before is not None and before < (d, p):
                    part[i] = -1
                elif before is not None or len(known) < REMEMBERED:
                    known[a, c] = d, p
            part[order[late]] = -1
            with np.errstate(over="ignore"):  # copies are dealt evenly
                gone = part < 0
                anchor = np.where(gone, tk.mix(doc.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + at.astype(np.uint64)).view(np.int64), anchor)
            anchor, part, context = np.concatenate([anchor, marks.view(np.int64)]), np.concatenate([part, np.zeros(len(marks), np.int32)]), np.concatenate([context, np.full(len(marks), _MARK)])
            doc, at = np.concatenate([doc, np.zeros(len(marks), np.int64)]), np.concatenate([at, np.full(len(marks), -1)])
        yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(part), pa.array(context), pa.array(doc), pa.array(at.astype(np.int32))], ["anchor", "part", "context", "doc", "at"])

    return tk.map_texts(_texts(docs), "anchor long, part int, context long, doc long, at int", f, ["doc_id", "text"], dict)


_COPY, _MERGE, _HOT = 0, 1, 2
_SIFTED = ["kind", "anchor", "context", "doc", "at"]


def sift(found: DataFrame, most: int) -> DataFrame:
    """kind, anchor, context, doc, at: anchors whose strings all start earlier (_COPY), first contexts to merge (_MERGE) or of a hot anchor (_HOT).

    Only hot rows name anchor and context.
    """

    def f(batches):
        held = [np.empty(0, np.int64)] * 5
        hot: tuple | None = None  # the (anchor, part) in work that is known as hot

        def batch(kind, rows, named):
            n = len(rows[3])
            names = (rows[0], rows[2]) if named else (np.zeros(n, np.int64),) * 2
            return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), pa.array(names[0]), pa.array(names[1]), pa.array(rows[3]), pa.array(rows[4].astype(np.int32))], _SIFTED)

        def split(rows):
            """First rows of their (anchor, part, context), and copies of them elsewhere."""
            anchor, part, context, doc, at = rows
            new = np.ones(len(anchor), bool)
            new[1:] = (anchor[1:] != anchor[:-1]) | (part[1:] != part[:-1]) | (context[1:] != context[:-1])
            head = np.flatnonzero(new)[np.cumsum(new) - 1]
            copy = ~new & ((doc != doc[head]) | (at != at[head])) & (at >= 0)
            copy |= part < 0
            return new & (part >= 0), copy

        def closed(rows):
            """Rows of whole buckets."""
            new, copy = split(rows)
            if copy.any():
                yield batch(_COPY, [x[copy] for x in rows], False)
            rows = [x[new] for x in rows]
            anchor, part, _, _, at = rows
            if not len(anchor):
                return
            begin = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (part[1:] != part[:-1])]))
            size = np.diff(np.append(begin, len(anchor)))
            warm = (at[begin] < 0) | (part[begin] > 0) | (size > most)
            if hot is not None:
                warm |= (anchor[begin] == hot[0]) & (part[begin] == hot[1])
            real = at >= 0
            many = np.repeat(warm, size) & real
            several = np.repeat(~warm & (size > 1), size)
            if many.any():
                yield batch(_HOT, [x[many] for x in rows], True)
            if several.any():
                yield batch(_MERGE, [x[several] for x in rows], False)

        for b in batches:
            rows = [np.concatenate([x, b.column(i).to_numpy()]) for i, x in enumerate(held)]
            if not len(rows[0]):
                continue
            same = (rows[0] == rows[0][-1]) & (rows[1] == rows[1][-1])
            cut = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0
            if cut:
                yield from closed([x[:cut] for x in rows])
            held = [x[cut:] for x in rows]
            if hot is not None and (held[0][0], held[1][0]) != hot:
                hot = None
            if len(held[0]) > 4 * most:  # a bucket in work: only firsts are held on to, and no more than most of them
                new, copy = split(held)
                if copy.any():
                    yield batch(_COPY, [x[copy] for x in held], False)
                marked = held[4][0] < 0
                held = [x[new] for x in held]
                if len(held[0]) > most or marked:
                    hot = int(held[0][0]), int(held[1][0])
                    real = held[4] >= 0
                    real[-1] = False
                    yield batch(_HOT, [x[real] for x in held], True)
                    held = [x[-1:] for x in held]
        if len(held[0]):
            yield from closed(held)

    dealt = found.repartition("anchor", "part").sortWithinPartitions("anchor", "part", "context", "doc", "at")
    return dealt.mapInArrow(f, "kind int, anchor long, context long, doc long, at int")


def settle(hot: DataFrame, most: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of the contexts of hot anchors: copies, firsts to merge and firsts to deal by string (doc, at).

    Equal contexts meet by aggregation. Anchors with more than ``most`` contexts are at most
    one in so many rows, so their list is sent to all tasks; no other key has more rows.
    """
    first = storage.store(hot.groupBy("anchor", "context").agg(F.min(F.struct("doc", "at")).alias("top"), F.count("*").alias("n")), "firsts")
    again = first.where("n > 1").select(F.col("anchor").alias("_a"), F.col("context").alias("_c"), "top")
    copies = hot.join(again, (F.col("anchor") == F.col("_a")) & (F.col("context") == F.col("_c"))).where("doc <> top.doc or at <> top.at").select("doc", "at")
    sizes = storage.store(first.groupBy(F.col("anchor").alias("_a")).agg(F.count("*").alias("m")).where("m > 1"), "sizes")
    large = F.broadcast(sizes.where(F.col("m") > most).select("_a"))
    small = sizes.where(F.col("m") <= most).select("_a")
    place = [F.col("top.doc").alias("doc"), F.col("top.at").alias("at")]
    merged = first.join(large, F.col("anchor") == F.col("_a"), "left_anti").join(small, F.col("anchor") == F.col("_a"), "left_semi").select(*place)
    return copies, merged, first.join(large, F.col("anchor") == F.col("_a"), "left_semi").select(*place)


def cut_contexts(docs: DataFrame, wanted: DataFrame, length: int, k: int) -> DataFrame:
    """anchor, doc, at, context: the bytes around the wanted places, padded to one width beyond the text."""
    reach = length - k
    width = reach + length
    side = wanted.groupBy(F.col("doc").alias("_doc")).agg(F.collect_set("at").alias("ats"))

    def f(batch):
        data, offsets = tk.strings(batch.column(2))
        per = np.diff(batch.column(1).offsets.to_numpy())
        at = batch.column(1).flatten().to_numpy().astype(np.int64)
        row = np.repeat(np.arange(batch.num_rows), per)
        spot = offsets[row] + at
        h = tk.Bytes(data).span(spot, spot + k)
        doc = batch.column(0).to_numpy()[row]
        for a in range(0, len(spot), 8192):
            part = slice(a, a + 8192)
            places = spot[part, None] - reach + np.arange(width)
            inside = (places >= offsets[row[part], None]) & (places < offsets[row[part] + 1, None])
            m = np.where(inside, data[np.clip(places, 0, len(data) - 1)], np.uint8(_PAD))
            cuts = pa.array(np.arange(len(m) + 1, dtype=np.int32) * width)
            body = pa.Array.from_buffers(pa.binary(), len(m), [None, cuts.buffers()[1], pa.py_buffer(np.ascontiguousarray(m))])
            yield pa.RecordBatch.from_arrays([pa.array(h[part].view(np.int64)), pa.array(doc[part]), pa.array(at[part].astype(np.int32)), body], ["anchor", "doc", "at", "context"])

    # neither side has a bound: texts are dealt by id, at every size
    return tk.map_texts(_texts(docs).join(side, F.col("doc_id") == F.col("_doc")), "anchor long, doc long, at int, context binary", f, ["doc_id", "ats", "text"])


class _Least:
    """Range minima of a column of small lengths by doubling."""

    def __init__(self, values: np.ndarray, reach: int):
        self.levels = [values]
        span = 1
        while 2 * span <= reach:
            x = self.levels[-1]
            self.levels.append(np.minimum(x[:-span], x[span:]))
            span *= 2

    def over(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Minima of values[first..last], both included."""
        level = np.frexp((last - first + 1).astype(np.float64))[1] - 1
        out = np.empty(len(first), self.levels[0].dtype)
        for k in np.flatnonzero(np.bincount(level)).tolist():
            at = np.flatnonzero(level == k)
            x = self.levels[k]
            out[at] = np.minimum(x[first[at]], x[last[at] - (1 << k) + 1])
        return out


def merge(columns: np.ndarray, shard: np.ndarray, rank: np.ndarray, length: int, reach: int) -> np.ndarray:
    """Mark strings of ``length`` symbols that stand under a smaller rank at the same columns.

    ``columns`` is (width, rows): the symbols of every row column by column; ``shard`` the
    shard of each row; ``rank`` the order of occurrence. Returns (width + 1, rows) steps: +1
    where a marked string begins, -1 where it has ended.
    """
    width, n = columns.shape
    steps = np.zeros((width + 1, n), np.int8)
    # rows by shard: the transforms of all shards side by side, and the interleave of shards
    own = np.argsort(shard, kind="stable")
    counts = np.bincount(shard)
    z = shard[own].astype(np.uint16)
    of_shard = z.copy()
    common = np.zeros(n, np.int32)  # with the row before, in interleaved order, back from the column
    pad_low = (columns[:reach] == _PAD).sum(0)
    high = width - (columns[reach:] == _PAD).sum(0)
    largest = np.iinfo(rank.dtype).max
    for k in range(width):
        # what the shards' transforms hold at this column
        symbols = columns[k][own]
        # interleave them, shard by shard in the order of each
        by_shard = np.argsort(z, kind="stable")
        merged = np.empty(n, np.uint8)
        merged[by_shard] = symbols
        # refine: one stable pass over the symbols moves interleave and common lengths on
        order = np.argsort(merged, kind="stable")
        z, sorted_ = z[order], merged[order]
        same = np.flatnonzero(sorted_[1:] == sorted_[:-1]) + 1
        longest = np.zeros(n, np.int32)
        if len(same):
            first, last = order[same - 1] + 1, order[same]
            near = first == last
            longest[same[near]] = common[last[near]] + 1
            far = ~near
            if far.any():
                longest[same[far]] = _Least(common, int((last[far] - first[far]).max()) + 1).over(first[far], last[far]) + 1
        common = longest
        # each shard's own transform moves on alike
        own = own[np.argsort(of_shard * np.uint16(256) + symbols, kind="stable") if len(counts) <= 256 else np.lexsort((symbols, of_shard))]
        if k + 1 >= length:
            begin = k + 1 - length
            by_shard = np.argsort(z, kind="stable")
            rows = np.empty(n, np.int64)
            rows[by_shard] = own
            head = common < length
            head[0] = True
            start = np.flatnonzero(head)
            if len(start) == n:
                continue
            whole = (pad_low[rows] <= begin) & (high[rows] >= k + 1)
            r = rank[rows]
            least = np.minimum.reduceat(np.where(whole, r, largest), start)[np.cumsum(head) - 1]
            late = rows[whole & (r > least)]
            steps[begin, late] += 1
            steps[k + 1, late] -= 1
    return steps


def merge_contexts(contexts: DataFrame, rows: int, length: int, k: int) -> DataFrame:
    """doc, a, b: runs of bytes that are covered by strings that start earlier, from all contexts of each anchor."""
    reach = length - k
    width = reach + length

    def f(batches):
        docs, ats, bodies, shards = [], [], [], []
        for number, b in enumerate(batches):
            docs.append(b.column(1).to_numpy())
            ats.append(b.column(2).to_numpy().astype(np.int64))
            body, _ = tk.strings(b.column(3))
            bodies.append(np.ascontiguousarray(body.reshape(-1, width).T))
            shards.append(np.full(b.num_rows, number, np.uint16))
        if not docs:
            return
        doc, at, shard = np.concatenate(docs), np.concatenate(ats), np.concatenate(shards)
        columns = np.concatenate(bodies, 1)
        del bodies
        order = np.lexsort((at, doc))
        new = np.ones(len(doc), bool)
        new[1:] = (doc[order][1:] != doc[order][:-1]) | (at[order][1:] != at[order][:-1])
        rank = np.empty(len(doc), np.int32)
        rank[order] = np.cumsum(new)
        steps = merge(columns, shard, rank, length, reach)
        covered = np.cumsum(steps, 0, dtype=np.int16) > 0
        edge = np.zeros((width + 1, len(doc)), np.int8)
        edge[0] = covered[0]
        edge[1:] = covered[1:].astype(np.int8) - covered[:-1].astype(np.int8)
        row, begin = np.nonzero(edge.T == 1)
        row2, end = np.nonzero(edge.T == -1)
        yield pa.RecordBatch.from_arrays([pa.array(doc[row]), pa.array(at[row] - reach + begin), pa.array(at[row2] - reach + end)], ["doc", "a", "b"])

    tasks = max(1, -(-rows // TASK_CONTEXTS))
    return contexts.repartition(tasks, "anchor").select("anchor", "doc", "at", "context").mapInArrow(f, "doc long, a long, b long")


def deal_strings(contexts: DataFrame, length: int, k: int) -> DataFrame:
    """string (fingerprint, null if already marked), doc, a: all strings of the contexts of hot anchors."""
    reach = length - k
    width = reach + length

    def f(batches):
        for b in batches:
            doc, at = b.column(1).to_numpy(), b.column(2).to_numpy().astype(np.int64)
            body, _ = tk.strings(b.column(3))
            n = len(doc)
            pads = np.concatenate([np.zeros((n, 1), np.int32), np.cumsum(body.reshape(n, width) == _PAD, 1)], 1)
            row, begin = np.nonzero(pads[:, length:] == pads[:, : width - length + 1])
            h = tk.Bytes(body).span(row * width + begin, row * width + begin + length)
            place = at[row] - reach + begin
            order = np.lexsort((place, doc[row], h))
            h, d, p = h[order], doc[row][order], place[order]
            first = np.ones(len(h), bool)
            first[1:] = h[1:] != h[:-1]
            head = np.flatnonzero(first)[np.cumsum(first) - 1] if len(h) else np.empty(0, np.int64)
            late = (d != d[head]) | (p != p[head])
            keep = first | late
            yield pa.RecordBatch.from_arrays([pa.array(h[keep].view(np.int64), mask=late[keep]), pa.array(d[keep]), pa.array(p[keep])], ["string", "doc", "a"])

    return contexts.mapInArrow(f, "string long, doc long, a long")


def repeated_runs(docs: DataFrame, length: int = LENGTH, k: int = ANCHOR, most: int = MOST_CONTEXTS, hot: int = HOT_IN_SLICE) -> DataFrame:
    """doc, a, b: byte runs covered by strings that start earlier; runs may overlap and reach beyond the text."""
    sifted = storage.store(sift(find_anchors(docs, length, k, hot), most), "sifted")
    _collect_garbage(docs)
    kinds = {r["kind"]: r["count"] for r in sifted.groupBy("kind").count().collect()}
    copies, merged, dealt = (sifted.where(F.col("kind") == k).select("doc", "at") for k in (_COPY, _MERGE, -1))
    if kinds.get(_HOT, 0):
        more = settle(sifted.where(F.col("kind") == _HOT).select("anchor", "context", "doc", "at"), most)
        copies, merged, dealt = copies.unionByName(more[0]), storage.store(merged.unionByName(more[1]), "to_merge"), storage.store(more[2], "to_deal")
    runs = copies.select("doc", (F.col("at") - (length - k)).cast("long").alias("a"), (F.col("at") + length).cast("long").alias("b"))
    if n := merged.count():
        contexts = cut_contexts(docs, merged, length, k)
        runs = runs.unionByName(storage.store(merge_contexts(contexts, n, length, k), "merged"))
    if kinds.get(_HOT, 0) and dealt.limit(1).count():
        strings = storage.store(deal_strings(cut_contexts(docs, dealt, length, k), length, k), "strings")
        least = strings.where("string is not null").groupBy(F.col("string").alias("_s")).agg(F.min(F.struct("doc", "a")).alias("top"))
        late = strings.where("string is not null").join(least, F.col("string") == F.col("_s")).where((F.col("doc") != F.col("top.doc")) | (F.col("a") != F.col("top.a")))
        marked = strings.where("string is null").select("doc", "a").unionByName(late.select("doc", "a"))
        runs = runs.unionByName(marked.select("doc", "a", (F.col("a") + length).alias("b")))
    return runs


def _collect_garbage(df: DataFrame) -> None:
    """Let Spark's cleaner drop the shuffle files of tables that are stored by now."""
    df.sparkSession._jvm.System.gc()


def _spans(docs: DataFrame, **how) -> DataFrame:
    """_doc, runs (sorted array of a << 31 | b): one row per text with something to remove."""
    with storage.scratch() as keep:
        runs = repeated_runs(docs, **how)
        packed = runs.select("doc", F.shiftleft(F.greatest("a", F.lit(0)).cast("long"), 31).bitwiseOR(F.col("b").cast("long")).alias("run"))
        stored = storage.store(packed.groupBy(F.col("doc").alias("_doc")).agg(F.sort_array(F.collect_set("run")).alias("runs")), "runs")
        keep.append(stored)
    _collect_garbage(docs)
    return stored


def _apply(size: int, runs: np.ndarray) -> list[tuple[int, int]]:
    """Maximal removed runs of a text of a size."""
    a, b = runs >> 31, np.minimum(runs & ((1 << 31) - 1), size)
    out: list[tuple[int, int]] = []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        if out and x <= out[-1][1]:
            if y > out[-1][1]:
                out[-1] = (out[-1][0], y)
        else:
            out.append((x, y))
    return out


def _removed(docs: DataFrame, schema, columns: list, build, **how) -> DataFrame:
    """build over the given columns, the runs and the text of every row; columns are told apart by place, whatever their names."""
    at = {name: k for k, name in reversed(list(enumerate(docs.columns)))}
    numbered = docs.toDF(*(f"c{k}" for k in range(len(docs.columns))))
    ids, text = F.col(f"c{at['doc_id']}").cast("long"), F.col(f"c{at['text']}").cast("string")
    spans = _spans(numbered.select(ids.alias("doc_id"), text.alias("text")), **how)
    joined = numbered.join(spans, ids == F.col("_doc"), "left")

    def f(batch):
        yield build(batch, [(t, [] if r is None else _apply(len(t), r)) for t, r in zip((x.as_buffer() or b"" for x in batch.column(batch.num_columns - 1).cast(pa.binary())), _runs(batch.column(batch.num_columns - 2)), strict=True)])

    return tk.map_texts(joined, schema, f, [*(F.col(f"c{at[c]}") if isinstance(c, str) else F.col(f"c{c}") for c in columns), "runs", text.alias("_text")])


def _runs(column: pa.ListArray):
    values, cuts, known = column.values.to_numpy(), column.offsets.to_numpy(), column.is_valid().to_numpy(zero_copy_only=False)
    return [values[a:b] if ok else None for a, b, ok in zip(cuts[:-1].tolist(), cuts[1:].tolist(), known.tolist(), strict=True)]


def _rest(text, cuts: list[tuple[int, int]]) -> bytes:
    view, at, out = memoryview(text), 0, []
    for a, b in cuts:
        out.append(view[at:a])
        at = b
    return b"".join([*out, view[at:]])


def report(docs: DataFrame, **how) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256: one row per input row."""

    def build(batch, texts):
        size, gone, spans, sha = [], [], [], []
        for text, cuts in texts:
            size.append(len(text))
            gone.append(sum(b - a for a, b in cuts))
            spans.append(len(cuts))
            sha.append(hashlib.sha256(_rest(text, cuts)).hexdigest())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, pa.int64()), pa.array(sha, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return _removed(rows, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", ["doc_id"], build, **how)


def remove(docs: DataFrame, **how) -> DataFrame:
    """The documents with repeated bytes cut out of ``text`` and n_chars counted anew, with all their columns.

    A character of which only some bytes are left is dropped. Null texts stay null.
    """
    fields = docs.schema.fields
    names = [f.name for f in fields]
    text = names.index("text")
    others = [k for k in range(len(fields)) if k != text]

    def build(batch, texts):
        kept = [_rest(t, c).decode("utf-8", "ignore") if c else None for t, c in texts]
        whole = batch.column(batch.num_columns - 1).to_pylist()
        new = [w if k is None else k for w, k in zip(whole, kept, strict=True)]
        return pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(others))), pa.array(new, pa.string())], [f"c{k}" for k in [*others, text]])

    schema = T.StructType([*(T.StructField(f"c{k}", fields[k].dataType) for k in others), T.StructField(f"c{text}", T.StringType())])
    out = _removed(docs, schema, others, build, **how)
    if "n_chars" in names:
        n, t = f"c{names.index('n_chars')}", f"c{text}"
        out = out.withColumn(n, F.when(F.col(t).isNull(), F.col(n)).otherwise(F.length(t)).cast(docs.schema["n_chars"].dataType))
    return out.select(*(f"c{k}" for k in range(len(fields)))).toDF(*names)
