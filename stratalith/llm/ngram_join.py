"""N-gram Jaccard join with PartEnum signatures.

A document is the set of its distinct word n-grams. Equal sets are one class, whose
representative is the least id; only representatives go on.

Signatures. Sizes are dealt into bands; a set signs for its own band and, if a partner can
be that large, for the next. Within a band, sets with Jaccard similarity of at least the
threshold differ in at most k features. The feature domain is parted into n1 parts and
each of those into n2; by pigeonhole one part has at most k2 of the differences, so some
n2 - k2 of its sub-parts agree. Every subset of n2 - k2 sub-parts of every part is a
signature: similar sets share at least one, whatever the data. n1, n2 and k2 are chosen by
cost: few possible differences take all subsets of parts, more take pairs out of three
sub-parts, and from eight on single sub-parts, as pairs would cost 1.4 times the signatures.
Then there are more sub-parts than the k + 1 that are needed, and a set signs only those
with at least t features, for the largest t that leaves k + 1: of two similar sets, the one
with the larger t has one among them that agrees, and the other signs that too.

Candidates. Representatives are dealt by signature and stream through their buckets in
order; equal buckets are kept once. A signature that stands ``HOT_IN_SLICE`` times in a slice
is hot: its members are dealt over ``LANES`` lanes and a mark tells the other tasks' members.
Each bucket (each lane of a hot one) first checks its members against its least one, and the
least ones of lanes against the least of all. What that connects needs no further check; a
bucket whose other members still lie in different components is checked exhaustively, in
blocks of bounded size, each block pair a row group of its own. No pair list of a bucket is
ever made, and none is left unchecked. Joins on keys that may be hot are salted.

Links are verified on the sets. Components are those of the verified links.

Texts without words (and null texts) have the empty set and link with nothing; texts with
fewer words than an n-gram are a set of one. Rows with a null id keep their own row with a
null component. Repeated rows fall into the class of their set; extra columns, whatever they
are called, are ignored, and kept by ``keep_one``; an empty table gives an empty table.
"""

from __future__ import annotations

from itertools import combinations
from math import floor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import components, skew, storage, textkit as tk

WORDS, PERCENT = 3, 90
#: Ratio of the largest to the least size of a band.
BAND = 1.5
#: Parts beyond the k + 1 that the pigeonhole needs, so that light parts need no signature.
SPARE = 1.25
#: Least bits of a parity sketch; larger sets have the power of two that is at least twice their size.
SKETCH = 512
#: Members of a block of a bucket that is checked exhaustively.
BLOCK = 1024
#: Candidate ids that are broadcast to the documents; beyond that they are joined by a shuffle.
MOST_SENT = 1_000_000
#: Places of a signature in a slice that make it hot, the lanes of a hot one, and the most members of a bucket that a task holds at a time.
HOT_IN_SLICE, LANES, MOST_HELD = 16, 256, 200_000
#: Buckets whose repetition a task notices by itself.
REMEMBERED = 100_000
_BAND, _SUBSET = np.uint64(0xA24BAED4963EE407), np.uint64(0x9FB21C651E98DF25)


def bands(largest: int, band: float = BAND) -> list[tuple[int, int]]:
    """(least, largest) size of each band up to a size."""
    out, low = [], 1
    while low <= largest:
        high = max(low, floor(low * band))
        out.append((low, high))
        low = high + 1
    return out


def scheme(high: int, percent: int) -> tuple[int, int, int, int]:
    """n1, n2, k2 and k of a band whose largest size is ``high``."""
    k = 2 * high * (100 - percent) // (100 + percent)
    if k <= 2:
        return 1, k + 2 if k else 1, k, k
    if k < 8:
        return -(-(k + 1) // 2), 3, 1, k
    return -(-int(SPARE * (k + 1)) // 2), 2, 1, k


def shingles(column: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram fingerprints of a slice, sorted within each row, and the row bounds."""
    data, offsets = tk.strings(column)
    data = tk.LOWER[data]
    w = tk.Words(data, offsets, tk.WORD)
    h = tk.Bytes(data).span(w.starts, w.ends)
    at = w.windows(words)
    rows = w.rows()[at]
    grams = tk.grams(h, words)[at]
    for k in range(1, words):  # texts with fewer words
        short = np.flatnonzero(w.counts == k)
        if len(short):
            grams = np.concatenate([grams, tk.grams(h, k)[w.bounds[short]]])
            rows = np.concatenate([rows, short])
    order = np.lexsort((grams, rows))
    grams, rows = grams[order], rows[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (rows[1:] != rows[:-1])
    grams, rows = grams[new], rows[new]
    return grams, np.searchsorted(rows, np.arange(len(offsets)))


def signatures(grams: np.ndarray, bounds: np.ndarray, percent: int, band: float = BAND) -> tuple[np.ndarray, np.ndarray]:
    """All signatures of the rows' sets, and their row bounds."""
    size = np.diff(bounds)
    n = len(size)
    limits = bands(int(size.max(initial=1)) * 2 + 2, band)
    lows = np.array([a for a, _ in limits])
    own = np.searchsorted(lows, size, "right") - 1
    found_rows, found = [], []
    with np.errstate(over="ignore"):
        mixed = tk.mix(grams + np.uint64(0x5851F42D4C957F2D))
        for step in (0, 1):
            which = own + step
            # a partner of size s has at most s * 100 / percent features
            signs = np.flatnonzero((size > 0) & (np.array([limits[min(b, len(limits) - 1)][0] for b in which]) * percent <= size * 100 if step else size > 0))
            for b in np.unique(which[signs]):
                rows = signs[which[signs] == b]
                n1, n2, k2, k = scheme(limits[b][1], percent)
                per = size[rows]
                pick = np.repeat(bounds[rows] - np.concatenate([[0], np.cumsum(per)[:-1]]), per) + np.arange(per.sum())
                g = grams[pick]
                part = (((g >> np.uint64(32)) * np.uint64(n1 * n2)) >> np.uint64(32)).astype(np.int64)
                spot = np.repeat(np.arange(len(rows)), per) * (n1 * n2) + part
                sums = np.zeros(len(rows) * n1 * n2, np.uint64)
                np.add.at(sums, spot, mixed[pick])
                sums = sums.reshape(len(rows), n1, n2)
                held = np.bincount(spot, minlength=sums.size).reshape(len(rows), n1, n2)
                if n2 - k2 == 1 and n2 > 1:
                    heaviest = -np.partition(-held.reshape(len(rows), -1), k, axis=1)[:, k]  # k + 1 parts hold as many
                else:
                    heaviest = np.zeros(len(rows), np.int64)
                for number, subset in enumerate(combinations(range(n2), n2 - k2)):
                    s = np.full((len(rows), n1), np.uint64(int(b) + 1)) * _BAND
                    weight = np.zeros((len(rows), n1), np.int64)
                    for j in subset:
                        s = tk.mix(s + sums[:, :, j] + np.uint64(j + 1) * _SUBSET)
                        weight += held[:, :, j]
                    s = tk.mix(s + (np.arange(n1, dtype=np.uint64) * np.uint64(64) + np.uint64(number)) * _SUBSET)
                    of, at = np.nonzero(weight >= heaviest[:, None])
                    found_rows.append(rows[of])
                    found.append(s[of, at])
    if not found:
        return np.empty(0, np.uint64), np.zeros(n + 1, np.int64)
    rows, out = np.concatenate(found_rows), np.concatenate(found)
    order = np.argsort(rows, kind="stable")
    return out[order], np.searchsorted(rows[order], np.arange(n + 1))


def _lists(values: np.ndarray, bounds: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values.view(np.int64)))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def measure(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n, s1, s2 (fingerprints of the whole set) of every row."""

    def f(batch):
        grams, bounds = shingles(batch.column(1), words)
        with np.errstate(over="ignore"):
            sums = []
            for salt in (1, 2):
                total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(tk.mix(grams * np.uint64(2) + np.uint64(salt)), dtype=np.uint64)])
                sums.append((total[bounds[1:]] - total[bounds[:-1]]).view(np.int64))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(bounds)), pa.array(sums[0]), pa.array(sums[1])], ["doc_id", "n", "s1", "s2"])

    return tk.map_texts(_texts(docs), "doc_id long, n long, s1 long, s2 long", f, ["doc_id", "text"])


def sign(docs: DataFrame, copies: DataFrame, words: int, percent: int, hot: int = HOT_IN_SLICE) -> DataFrame:
    """sig, part, doc: the signatures of all rows but copies (_doc), whose sets others stand for.

    part // 2 is the lane of a hot signature's member, or 0; an even part is a mark, not a member.
    """
    copies = F.broadcast(copies) if copies.count() <= MOST_SENT else copies
    rows = _texts(docs).where("doc_id is not null").join(copies, F.col("doc_id") == F.col("_doc"), "left_anti")

    def f(batch):
        grams, bounds = shingles(batch.column(1), words)
        found, cuts = signatures(grams, bounds, percent)
        doc = np.repeat(batch.column(0).to_numpy(), np.diff(cuts))
        part = np.ones(len(found), np.int32)
        busy, marks = tk.repeated(found, hot)
        part[busy] = 2 * (1 + (tk.mix(doc[busy].view(np.uint64)) % np.uint64(LANES)).astype(np.int32)) + 1
        sig, part, doc = np.concatenate([found, marks]), np.concatenate([part, np.zeros(len(marks), np.int32)]), np.concatenate([doc, np.zeros(len(marks), np.int64)])
        yield pa.RecordBatch.from_arrays([pa.array(sig.view(np.int64)), pa.array(part), pa.array(doc)], ["sig", "part", "doc"])

    return tk.map_texts(rows, "sig long, part int, doc long", f, ["doc_id", "text"])


def _buckets(signed: DataFrame, most: int = MOST_HELD) -> DataFrame:
    """bucket, doc, center, hot, of every signature shared by several representatives; equal buckets once.

    A hot bucket is named by its signature and has a center in each lane; others are named by their members.
    """

    def f(batches):
        held = [np.empty(0, np.int64)] * 3
        seen: set[int] = set()
        stream: tuple[int, int, int] | None = None  # signature, lane and center of a bucket beyond MOST_HELD, in work

        def made(name, doc, center, hot):
            return pa.RecordBatch.from_arrays([pa.array(name), pa.array(doc), pa.array(center), pa.array(hot)], ["bucket", "doc", "center", "hot"])

        def out(sig, part, doc):
            """The buckets of complete runs."""
            once = np.ones(len(sig), bool)
            once[1:] = (sig[1:] != sig[:-1]) | (part[1:] != part[:-1]) | (doc[1:] != doc[:-1])
            sig, part, doc = sig[once], part[once], doc[once]
            lane = part >> 1
            head = np.flatnonzero(np.concatenate([[True], (sig[1:] != sig[:-1]) | (lane[1:] != lane[:-1])]))
            size = np.diff(np.append(head, len(sig)))
            marked = part[head] % 2 == 0
            hot = marked | (lane[head] > 0)
            member = part % 2 == 1
            first = np.minimum(head + marked, len(sig) - 1)
            with np.errstate(over="ignore"):
                sums = np.add.reduceat(np.where(member, tk.mix(doc.view(np.uint64)), np.uint64(0)), head)
            name = np.where(hot, tk.mix(sig[head].view(np.uint64)), sums).view(np.int64)
            many = hot | (size > 1)
            for k in np.flatnonzero(many & ~hot).tolist():
                key = int(name[k])
                if key in seen:
                    many[k] = False
                elif len(seen) < REMEMBERED:
                    seen.add(key)
            row = np.repeat(many, size) & member
            if not row.any():
                return None
            return made(np.repeat(name, size)[row], doc[row], np.repeat(doc[first], size)[row], np.repeat(hot, size)[row])

        for batch in batches:
            held = [np.concatenate([x, batch.column(i).to_numpy()]) for i, x in enumerate(held)]
            sig, part, doc = held
            if not len(sig):
                continue
            same = (sig == sig[-1]) & (part >> 1 == part[-1] >> 1)
            cut = 0 if same.all() else len(same) - int(np.argmin(same[::-1]))
            if stream is not None:
                n = int(np.argmin((sig == stream[0]) & (part >> 1 == stream[1]))) if cut or (sig[-1], part[-1] >> 1) != stream[:2] else len(sig)
                if n:
                    yield made(np.full(n, tk.mix(np.uint64(stream[0] & (1 << 64) - 1)).view(np.int64)), doc[:n], np.full(n, stream[2]), np.ones(n, bool))
                if n == len(sig):
                    held = [x[:0] for x in held]
                    continue
                stream, cut = None, cut - n
                sig, part, doc = held = [x[n:] for x in held]
            if cut > 0 and (rows := out(sig[:cut], part[:cut], doc[:cut])) is not None:
                yield rows
            sig, part, doc = held = [x[max(0, cut) :] for x in held]
            if len(sig) > most:
                k = int(np.argmax(part % 2 == 1))  # marks come first
                if part[k] % 2:
                    stream = int(sig[0]), int(part[0] >> 1), int(doc[k])
                    n = len(sig) - k
                    yield made(np.full(n, tk.mix(np.uint64(stream[0] & (1 << 64) - 1)).view(np.int64)), doc[k:], np.full(n, stream[2]), np.ones(n, bool))
                    held = [x[:0] for x in held]
        if len(held[0]) and (rows := out(*held)) is not None:
            yield rows

    dealt = signed.repartition(F.col("sig"), F.shiftright("part", 1)).sortWithinPartitions("sig", "part", "doc")
    return dealt.mapInArrow(f, "bucket long, doc long, center long, hot boolean").distinct()


def _wanted(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The texts of the wanted ids (doc)."""
    ids = ids.select(F.col("doc").alias("_doc"))
    if ids.count() <= MOST_SENT:
        ids = F.broadcast(ids)
    return _texts(docs).join(ids, F.col("doc_id") == F.col("_doc"), "left_semi")


def _sketches(docs: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """doc, size, sketch: set sizes of the wanted ids and the parity of their features in as many buckets as fit the size."""

    def f(batch):
        grams, bounds = shingles(batch.column(1), words)
        size = np.diff(bounds)
        bits = np.maximum(SKETCH, 1 << np.ceil(np.log2(np.maximum(1, 2 * size))).astype(np.int64))
        begin = np.concatenate([[0], np.cumsum(bits)])
        spot = np.repeat(begin[:-1], size) + (grams & np.repeat(bits - 1, size).astype(np.uint64)).astype(np.int64)
        packed = np.packbits((np.bincount(spot, minlength=begin[-1]) & 1).astype(bool))
        sketch = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer((begin // 8).astype(np.int32)), pa.py_buffer(packed)])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size), sketch], ["doc", "size", "sketch"])

    return tk.map_texts(_wanted(docs, ids), "doc long, size long, sketch binary", f, ["doc_id", "text"]).dropDuplicates(["doc"])


def _sets(docs: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """doc, grams: the sets of the wanted ids; a repeated row's set stands twice."""

    def f(batch):
        grams, bounds = shingles(batch.column(1), words)
        yield pa.RecordBatch.from_arrays([batch.column(0), _lists(grams, bounds)], ["doc", "grams"])

    return tk.map_texts(_wanted(docs, ids), "doc long, grams array<long>", f, ["doc_id", "text"])


def near(apart: np.ndarray, na: np.ndarray, nb: np.ndarray, percent: int) -> np.ndarray:
    """Whether sizes and bits between parity sketches leave room for the threshold: sets differ in no fewer features than sketches in bits."""
    room = (na + nb) * (100 - percent) >= apart * (100 + percent)
    return room & (np.minimum(na, nb) * 100 >= np.maximum(na, nb) * percent)


def _bits(column: pa.Array) -> list[np.ndarray]:
    data, offsets = tk.strings(column)
    return [data[a:b].view(np.uint64) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]


def fold(sketch: np.ndarray, words: int) -> np.ndarray:
    """The same set's sketch in fewer buckets: buckets are hashes modulo their number, a power of two."""
    return np.bitwise_xor.reduce(sketch.reshape(-1, words), axis=0)


def _close(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that sketches and sizes do not rule out."""
    one = sketches.select(F.col("doc").alias("_a"), F.col("size").alias("na"), F.col("sketch").alias("ka"))
    two = sketches.select(F.col("doc").alias("_b"), F.col("size").alias("nb"), F.col("sketch").alias("kb"))

    def f(batches):
        for b in batches:
            if b.num_rows:
                na, nb = b.column(2).to_numpy(), b.column(3).to_numpy()
                apart = np.array([int(np.bitwise_count(fold(x, k) ^ fold(y, k)).sum()) for x, y in zip(_bits(b.column(4)), _bits(b.column(5)), strict=True) for k in (min(len(x), len(y)),)])
                keep = pa.array(near(apart, na, nb, percent))
                yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], ["a", "b"])

    both = skew.join(pairs, one, {"a": "_a"}).join(two, F.col("b") == F.col("_b"))
    return both.select("a", "b", "na", "nb", "ka", "kb").mapInArrow(f, "a long, b long")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets reach the threshold."""
    left = sets.select(F.col("doc").alias("_a"), F.col("grams").alias("_ga"))
    right = sets.select(F.col("doc").alias("_b"), F.col("grams").alias("_gb"))
    both = skew.join(pairs, left, {"a": "_a"}).join(right, F.col("b") == F.col("_b"))
    shared = F.size(F.array_intersect("_ga", "_gb"))
    return both.where(shared * 100 >= (F.size("_ga") + F.size("_gb") - shared) * percent).select("a", "b").distinct()


def matches(first: list[np.ndarray], second: list[np.ndarray], percent: int) -> np.ndarray:
    """Whether each pair of two lists of sorted sets reaches the threshold."""
    na, nb = np.array([len(x) for x in first]), np.array([len(x) for x in second])
    a, b = np.concatenate(first), np.concatenate(second)
    common = np.intersect1d(a, b)
    ia, ib = np.searchsorted(common, a), np.searchsorted(common, b)
    ha, hb = ia < len(common), ib < len(common)
    ha[ha], hb[hb] = common[ia[ha]] == a[ha], common[ib[hb]] == b[hb]
    ra, rb = np.repeat(np.arange(len(na)), na)[ha], np.repeat(np.arange(len(nb)), nb)[hb]
    ia, ib = ia[ha], ib[hb]
    shared = np.zeros((len(na), len(nb)), np.float32)
    for low in range(0, len(common), 4096):
        x, y = np.zeros((len(na), 4096), np.float32), np.zeros((len(nb), 4096), np.float32)
        pa_, pb_ = (ia >= low) & (ia < low + 4096), (ib >= low) & (ib < low + 4096)
        x[ra[pa_], ia[pa_] - low] = 1
        y[rb[pb_], ib[pb_] - low] = 1
        shared += x @ y.T
    return shared * 100 >= (na[:, None] + nb[None, :] - shared) * percent


def _exhausted(docs: DataFrame, open_: DataFrame, sketches: DataFrame, words: int, percent: int) -> DataFrame:
    """All links across components within the open buckets (bucket, doc, comp), block by block."""
    parts = open_.groupBy(F.col("bucket").alias("k"), "comp").agg(F.count("*").alias("m"))
    # a bucket's largest component needs no check within
    sizes = parts.groupBy("k").agg(F.max_by("comp", F.struct("m", -F.col("comp"))).alias("top"), F.max("m").alias("major"), F.sum("m").alias("m"))
    blocks = lambda n: F.greatest(F.lit(1), F.ceil(n / BLOCK)).cast("int")
    sizes = sizes.select("k", "top", blocks(F.col("m") - F.col("major")).alias("minors"), blocks(F.col("major")).alias("majors"))
    rows = skew.join(open_, sizes, {"bucket": "k"})
    # blocks 0 .. minors - 1 hold the smaller components, the others the largest
    rows = rows.withColumn("in_top", F.col("comp") == F.col("top"))
    rows = rows.withColumn("mine", F.when(F.col("in_top"), F.col("minors") + F.pmod(F.xxhash64("doc"), "majors")).otherwise(F.pmod(F.xxhash64("doc"), "minors")).cast("int"))
    # a row goes to the block pairs (i, j), i <= j, of which its block is one and i is a smaller one's
    last = F.when(F.col("in_top"), F.col("minors")).otherwise(F.col("minors") + F.col("majors")) - 1
    pairs = F.transform(F.sequence(F.lit(0), last), lambda o: F.struct(F.least(F.col("mine"), o).alias("i"), F.greatest(F.col("mine"), o).alias("j")))
    dealt = rows.withColumn("p", F.explode(pairs)).select("bucket", "p.i", "p.j", "mine", "doc", "comp")
    sketched = dealt.join(sketches.withColumnRenamed("doc", "_d"), F.col("doc") == F.col("_d")).select("bucket", "i", "j", "mine", "doc", "comp", "size", "sketch")

    def filter_(batches):
        """The rows of each block pair that sketches leave with a partner in another component."""
        group, key = [], None

        def out():
            mine, doc, comp, size = (np.array([r[c] for r in group]) for c in range(4))
            least = min(len(r[4]) for r in group)
            bits = np.stack([fold(r[4], least) for r in group])
            one = np.flatnonzero(mine == key[1])
            two = one if key[1] == key[2] else np.flatnonzero(mine == key[2])
            left = np.zeros(len(group), bool)
            for x in one.tolist():
                apart = np.bitwise_count(bits[two] ^ bits[x]).sum(1, dtype=np.int64)
                hit = two[near(apart, size[two], size[x], percent) & (comp[two] != comp[x])]
                left[hit] = True
                left[x] |= len(hit) > 0
            at = np.flatnonzero(left)
            keys = [pa.array([k] * len(at), t) for k, t in zip(key, (pa.int64(), pa.int32(), pa.int32()), strict=True)]
            return pa.RecordBatch.from_arrays([*keys, pa.array(mine[at].astype(np.int32)), pa.array(doc[at]), pa.array(comp[at])], ["bucket", "i", "j", "mine", "doc", "comp"])

        for batch in batches:
            if not batch.num_rows:
                continue
            head, bits = list(zip(*(batch.column(k).to_pylist() for k in range(7)), strict=True)), _bits(batch.column(7))
            for (bucket, i, j, mine, doc, comp, size), sketch in zip(head, bits, strict=True):
                if (bucket, i, j) != key:
                    if group:
                        yield out()
                    group, key = [], (bucket, i, j)
                group.append((mine, doc, comp, size, sketch))
        if group:
            yield out()

    schema = "bucket long, i int, j int, mine int, doc long, comp long"
    left = sketched.repartition(storage.wide(docs.sparkSession), "bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "doc").mapInArrow(filter_, schema)
    left = storage.store(left, "left")
    sets = _sets(docs, left.select("doc").distinct(), words)
    full = left.join(sets.select(F.col("doc").alias("_d"), "grams"), F.col("doc") == F.col("_d")).select("bucket", "i", "j", "mine", "doc", "comp", "grams")
    ordered = full.repartition(storage.wide(docs.sparkSession), "bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "doc")

    def f(batches):
        group, key = [], None

        def out():
            one = [r for r in group if r[0] == key[1]]
            two = one if key[1] == key[2] else [r for r in group if r[0] == key[2]]
            if not one or not two:
                return None
            hit = matches([r[3] for r in one], [r[3] for r in two], percent)
            hit &= np.array([r[2] for r in one])[:, None] != np.array([r[2] for r in two])[None, :]
            x, y = np.nonzero(hit)
            a, b = np.array([r[1] for r in one])[x], np.array([r[1] for r in two])[y]
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

        for batch in batches:
            head = list(zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True))
            for (bucket, i, j, mine, doc, comp), grams in zip(head, batch.column(6), strict=True):
                if (bucket, i, j) != key:
                    if group and (rows_ := out()) is not None:
                        yield rows_
                    group, key = [], (bucket, i, j)
                group.append((mine, doc, comp, grams.values.to_numpy()))
        if group and (rows_ := out()) is not None:
            yield rows_

    return ordered.mapInArrow(f, "a long, b long").distinct()


def join(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, hot: int = HOT_IN_SLICE, most: int = MOST_HELD) -> DataFrame:
    """doc_id, n_shingles, component_id, n_class (rows with an equal set): one row per input row."""
    with storage.scratch() as keep:
        signed, classes, found = _linked(_texts(docs), words, percent, hot, most)
        label = found.where("node <> component").select(F.col("node").alias("_node"), F.col("component").alias("_component"))
        # of classes only those with several rows or another component need to be joined back
        told = classes.join(label, F.col("doc") == F.col("_node"), "left").select(F.col("n").alias("_n"), F.col("s1").alias("_s1"), F.col("s2").alias("_s2"), F.coalesce("_component", "doc").alias("_c"), F.col("size").alias("_size"))
        out = skew.join(signed.where("doc_id is not null"), told, {"n": "_n", "s1": "_s1", "s2": "_s2"}, "left").unionByName(signed.where("doc_id is null"), allowMissingColumns=True)
        result = out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("_c", "doc_id").alias("component_id"), F.coalesce("_size", F.lit(1)).cast("long").alias("n_class"))
        stored = storage.store(result, "joined")
        keep.append(stored)
    return stored


def _linked(docs: DataFrame, words: int, percent: int, hot: int, most: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The sets of all rows, the classes of equal sets, and the components of those that link (node, component)."""
    signed = storage.store(measure(docs, words), "measured")
    sets_of = signed.where("n > 0 and doc_id is not null")
    classes = storage.store(sets_of.groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("doc"), F.max("doc_id").alias("last"), F.count("*").alias("size")), "classes")
    several = classes.where("doc < last").select(F.col("n").alias("_n"), F.col("s1").alias("_s1"), F.col("s2").alias("_s2"), "doc")
    copies = skew.join(sets_of, several, {"n": "_n", "s1": "_s1", "s2": "_s2"}).where("doc_id <> doc").select(F.col("doc_id").alias("_doc"))
    copies = storage.store(copies.distinct(), "copies")
    buckets = storage.store(_buckets(sign(docs, copies, words, percent, hot), most), "buckets")
    docs.sparkSession._jvm.System.gc()  # the cleaner drops the shuffle files of signatures
    sketches = storage.store(_sketches(docs, buckets.select("doc").distinct(), words), "sketches")
    pairs = buckets.where("doc <> center").select(F.col("center").alias("a"), F.col("doc").alias("b"))
    lanes = buckets.where("hot").select("bucket", "center").distinct()
    least = lanes.groupBy(F.col("bucket").alias("_b")).agg(F.min("center").alias("a"))
    between = lanes.join(least, F.col("bucket") == F.col("_b")).where("a < center").select("a", F.col("center").alias("b"))
    pairs = storage.store(pairs.unionByName(between).distinct(), "proposed")
    pairs = storage.store(_close(pairs, sketches, percent), "pairs")
    sets = storage.store(_sets(docs, pairs.select(F.col("a").alias("doc")).union(pairs.select("b")).distinct(), words), "sets")
    links = storage.store(_verified(pairs, sets, percent), "verified")
    storage.drop(sets)
    found = components.connected(links)

    # buckets whose members beside the center lie in several components
    rest = buckets.where("doc <> center or hot").join(found, F.col("doc") == F.col("node"), "left").select("bucket", "doc", F.coalesce("component", "doc").alias("comp"))
    rest = storage.store(rest, "rest")
    several = rest.groupBy(F.col("bucket").alias("_b")).agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("_b")
    open_ = storage.store(skew.join(rest, several, {"bucket": "_b"}, "left_semi"), "open")
    more = storage.store(_exhausted(docs, open_, sketches, words, percent), "more")
    if more.limit(1).count():
        found = components.connected(links.unionByName(more))
    return signed, classes, found


def keep_one(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The documents with the least id of their component, with all their columns.

    Rows with a null id stay; of repeated rows with the id that stays, all stay.
    """
    names = docs.columns
    numbered = docs.toDF(*(f"c{k}" for k in range(len(names))))
    at = f"c{names.index('doc_id')}"
    rows = numbered.select(F.col(at).alias("doc_id"), F.col(f"c{names.index('text')}").alias("text"))
    gone = join(rows, words, percent).where("component_id <> doc_id").select(F.col("doc_id").alias("gone")).distinct()
    gone = F.broadcast(gone) if gone.count() <= MOST_SENT else gone  # texts are not shuffled for a list that can be sent
    return numbered.join(gone, F.col(at).cast("long") == F.col("gone"), "left_anti").toDF(*names)
