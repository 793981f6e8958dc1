"""Masked pseudo-likelihood: a bidirectional window network scores every token from both sides.

The log probability of a token given its ``SIDE`` neighbours on either side is

    log softmax(h O + c)[class(token)] + log softmax(h I_class + c_class)[slot(token)],  h = tanh(sum_j E[neighbour_j] * P_j + b)

Words are hashed to ``VOCABULARY`` ids. Ids are put into classes by their counts in the whole
corpus: the ``OWN`` most frequent have classes of their own, the others share ``BINS`` classes
of ``SLOTS`` ids each, in order of frequency. Both factors are decided by the neighbours, so the
probabilities of all ids sum to one. Biases start at the smoothed corpus shares, and ids that
were never a neighbour have the embedding 0.

Training takes all documents. They are dealt to shards and ordered within by a hash of their
words, so the result does not depend on partitions. In each of ``ROUNDS`` rounds every document
is masked anew: ``MASKED`` of its tokens, chosen by a hash, are predicted from both sides. Every
shard starts from the same weights and trains in numpy; the shards' weights are averaged by
tokens, in fixed-size blocks, and the average starts the next round. Scoring predicts every token
of every document; a document's score is the sum of its tokens' conditional log probabilities.

Ids are tokenised once and stored, two bytes a token. Shards are at most ``MOST_SHARDS``, so
what is averaged is bounded beside the corpus.

Null and empty texts have no tokens, the sum 0 and a null mean. Repeated rows are scored alike;
extra columns, whatever they are called, are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

from . import storage, textkit as tk

VOCABULARY, WIDTH, SIDE = 1 << 14, 16, 2
#: Ids with a class of their own, and classes of the others and ids of each.
OWN, BINS = 32, 128
SLOTS = -(-(VOCABULARY - OWN) // BINS)
CLASSES = OWN + BINS
#: Share of a document's tokens that a round masks, and how often weights are averaged.
MASKED, ROUNDS = 0.15, 2
MINIBATCH, RATE = 4096, 0.2
#: Tokens of a shard, at least, and the most shards.
SHARD_TOKENS, MOST_SHARDS = 1 << 22, 4096
#: Tokens that are trained on or scored at a time.
HELD_TOKENS = 1 << 17
_BLOCK = 1 << 15
_OFFSETS = [*range(-SIDE, 0), *range(1, SIDE + 1)]


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word ids of a slice, each row's bounds and a hash of its words."""
    data, offsets = tk.strings(column)
    data = tk.LOWER[data]
    words = tk.Words(data, offsets, tk.WORD)
    h = tk.Bytes(data).span(words.starts, words.ends)
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(tk.mix(h + np.uint64(1)), dtype=np.uint64)])
    return (h >> np.uint64(64 - (VOCABULARY.bit_length() - 1))).astype(np.uint16), words.bounds, tk.mix(sums[words.bounds[1:]] - sums[words.bounds[:-1]])


def neighbours(ids: np.ndarray, bounds: np.ndarray, wanted: np.ndarray | None = None) -> np.ndarray:
    """(tokens, 2 * SIDE) ids around each wanted token; VOCABULARY stands beyond a document's edge."""
    size = np.diff(bounds)
    first, last = np.repeat(bounds[:-1], size), np.repeat(bounds[1:], size)
    at = np.arange(len(ids)) if wanted is None else wanted
    first, last = first[at], last[at]
    out = np.full((len(at), len(_OFFSETS)), VOCABULARY, np.int32)
    for j, d in enumerate(_OFFSETS):
        inside = (at + d >= first) & (at + d < last)
        out[inside, j] = ids[at[inside] + d]
    return out


@dataclass
class Corpus:
    """Class and slot of every id, and the log shares of classes and of slots in them."""

    klass: np.ndarray
    slot: np.ndarray
    prior: np.ndarray
    within: np.ndarray

    @classmethod
    def of(cls, counts: np.ndarray) -> Corpus:
        order = np.argsort(-counts, kind="stable")
        rank = np.empty(VOCABULARY, np.int64)
        rank[order] = np.arange(VOCABULARY)
        klass = np.where(rank < OWN, rank, OWN + (rank - OWN) // SLOTS).astype(np.int32)
        slot = np.where(rank < OWN, 0, (rank - OWN) % SLOTS).astype(np.int32)
        mass = np.bincount(klass, counts + 0.5, CLASSES)
        within = np.full((BINS, SLOTS), -1e9, np.float32)
        rare = klass >= OWN
        within[klass[rare] - OWN, slot[rare]] = np.log((counts[rare] + 0.5) / mass[klass[rare]])
        return cls(klass, slot, np.log(mass / mass.sum()).astype(np.float32), within)

    def unigram(self) -> np.ndarray:
        """Log shares of all ids, without context."""
        rare = self.klass >= OWN
        return self.prior[self.klass] + np.where(rare, self.within[np.maximum(self.klass - OWN, 0), self.slot], 0)


def _sums(ids: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids that occur and the sums of their rows."""
    order = np.argsort(ids, kind="stable")
    ids = ids[order]
    first = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
    return ids[first], np.add.reduceat(rows[order], first, axis=0)


def _groups(klass: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of shared classes by class, where each class begins and ends, and which it is."""
    deep = np.flatnonzero(klass >= OWN)
    deep = deep[np.argsort(klass[deep].astype(np.uint16), kind="stable")]
    cut = np.flatnonzero(np.diff(klass[deep], prepend=-1))
    return deep, np.append(cut, len(deep)), klass[deep[cut]] - OWN


class Network:
    SHAPES = ((VOCABULARY + 1, WIDTH), (2 * SIDE, WIDTH), (WIDTH,), (WIDTH, CLASSES), (CLASSES,), (BINS, WIDTH, SLOTS), (BINS, SLOTS))

    def __init__(self, flat: np.ndarray):
        self.flat, self.parts, at = flat, [], 0
        for shape in self.SHAPES:
            size = int(np.prod(shape))
            self.parts.append(flat[at : at + size].reshape(shape))
            at += size
        self.embed, self.place, self.bias, self.out, self.prior, self.inner, self.tilt = self.parts

    @classmethod
    def start(cls, corpus: Corpus) -> Network:
        rng = np.random.default_rng(5)
        m = cls(np.zeros(sum(int(np.prod(s)) for s in cls.SHAPES), np.float32))
        m.place[:] = rng.normal(1, 0.1, m.place.shape)
        m.out[:] = rng.normal(0, 0.3, m.out.shape)
        m.inner[:] = rng.normal(0, 0.1, m.inner.shape)
        m.prior[:], m.tilt[:] = corpus.prior, corpus.within
        return m

    def hidden(self, around: np.ndarray) -> np.ndarray:
        s = np.zeros((len(around), WIDTH), np.float32) + self.bias
        for j in range(around.shape[1]):
            s += self.embed[around[:, j]] * self.place[j]
        return np.tanh(s)

    def log_probability(self, around: np.ndarray, ids: np.ndarray, corpus: Corpus) -> np.ndarray:
        """log p(id | neighbours) of every token."""
        h, klass, slot = self.hidden(around), corpus.klass[ids], corpus.slot[ids]
        z = h @ self.out + self.prior
        out = z[np.arange(len(z)), klass] - _log_sum(z)
        deep, cuts, which = _groups(klass)
        for k, a, b in zip(which.tolist(), cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            rows = deep[a:b]
            y = h[rows] @ self.inner[k] + self.tilt[k]
            out[rows] += y[np.arange(b - a), slot[rows]] - _log_sum(y)
        return out.astype(np.float64)

    def train(self, around: np.ndarray, ids: np.ndarray, corpus: Corpus, grads: list[np.ndarray]) -> None:
        """Adaptive gradient steps over the tokens, in minibatches."""
        for a in range(0, len(ids), MINIBATCH):
            near, token = around[a : a + MINIBATCH], ids[a : a + MINIBATCH]
            klass, slot = corpus.klass[token], corpus.slot[token]
            h = self.hidden(near)
            d = _error(h @ self.out + self.prior, klass)
            dh = d @ self.out.T
            deep, cuts, which = _groups(klass)
            for k, x, y in zip(which.tolist(), cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                rows = deep[x:y]
                own = h[rows]
                e = _error(own @ self.inner[k] + self.tilt[k], slot[rows])
                dh[rows] += e @ self.inner[k].T
                self._move(self.inner[k], own.T @ e, grads[5][k])
                self._move(self.tilt[k], e.sum(0), grads[6][k])
            ds = dh * (1 - h**2)
            flat_ids, each = _sums(near.ravel().astype(np.uint16), (ds[:, None, :] * self.place).reshape(-1, WIDTH))
            dp = np.stack([(ds * self.embed[near[:, j]]).sum(0) for j in range(near.shape[1])])
            for part, grad, kept in ((self.place, dp, grads[1]), (self.bias, ds.sum(0), grads[2]), (self.out, h.T @ d, grads[3]), (self.prior, d.sum(0), grads[4])):
                self._move(part, grad, kept)
            grads[0][flat_ids] += each**2
            self.embed[flat_ids] -= RATE * each / np.sqrt(grads[0][flat_ids])

    @staticmethod
    def _move(part: np.ndarray, grad: np.ndarray, kept: np.ndarray) -> None:
        kept += grad * grad
        part -= RATE * grad / np.sqrt(kept)


def _log_sum(z: np.ndarray) -> np.ndarray:
    top = z.max(initial=0)
    if top < 60:  # no exponential overflows
        return np.log(np.exp(z) @ np.ones(z.shape[1], np.float32))
    top = z.max(1)
    return top + np.log(np.exp(z - top[:, None]).sum(1))


def _error(z: np.ndarray, want: np.ndarray) -> np.ndarray:
    """The gradient of the mean log loss of a softmax over a minibatch, by its inputs."""
    if z.max(initial=0) >= 60:
        z -= z.max(1, keepdims=True)
    np.exp(z, out=z)
    z *= (1 / MINIBATCH / (z @ np.ones(z.shape[1], np.float32)))[:, None]
    z[np.arange(len(want)), want] -= np.float32(1 / MINIBATCH)
    return z


def encode(docs: DataFrame) -> DataFrame:
    """doc_id, u (hash of the words), n, ids (two bytes each): one row per input row."""

    def f(batch):
        ids, bounds, u = tokens(batch.column(1))
        cuts = pa.array((bounds * 2).astype(np.int32))
        body = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, cuts.buffers()[1], pa.py_buffer(ids.tobytes())])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(u.view(np.int64)), pa.array(np.diff(bounds)), body], ["doc_id", "u", "n", "ids"])

    rows = [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")]
    return tk.map_texts(docs, "doc_id long, u long, n long, ids binary", f, rows)


def count(encoded: DataFrame) -> np.ndarray:
    """How often each id stands in all documents."""

    def f(batches):
        total = np.zeros(VOCABULARY, np.int64)
        for batch in batches:
            total += np.bincount(tk.strings(batch.column(0))[0].view(np.uint16), minlength=VOCABULARY)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["id", "n"])

    rows = encoded.select("ids").mapInArrow(f, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()  # at most VOCABULARY rows
    out = np.zeros(VOCABULARY)
    for r in rows:
        out[r["id"]] = r["n"]
    return out


def _held(column: pa.Array):
    """(first row, last row, ids, bounds) of runs of rows with about HELD_TOKENS tokens."""
    raw, offsets = tk.strings(column)
    for a, b in tk.slices(offsets, 2 * HELD_TOKENS):
        yield a, b, raw[offsets[a] : offsets[b]].view(np.uint16), (offsets[a : b + 1] - offsets[a]) // 2


def _masked(u: np.ndarray, bounds: np.ndarray, turn: int, share: float) -> np.ndarray:
    """The tokens that a round masks, by hashes of their places."""
    size = np.diff(bounds)
    place = np.arange(int(bounds[-1])) - np.repeat(bounds[:-1], size)
    h = tk.mix(tk.absorb(np.repeat(u, size), (place * (ROUNDS + 1) + turn).astype(np.uint64)))
    return np.flatnonzero(h < np.uint64(int(share * float(1 << 64)) - 1 if share < 1 else (1 << 64) - 1))


def fit(encoded: DataFrame, rounds: int = ROUNDS, masked: float = MASKED, shard_tokens: int = SHARD_TOKENS) -> tuple[Network, Corpus]:
    counts = count(encoded)
    corpus = Corpus.of(counts)
    network = Network.start(corpus)
    shards = int(np.clip(counts.sum() // shard_tokens, 1, MOST_SHARDS))
    context = encoded.sparkSession.sparkContext
    schema = "block long, shard int, n long, weights binary"
    for turn in range(rounds):
        sent = context.broadcast((network.flat, corpus))

        def learn(batches, turn=turn, sent=sent):
            flat, own_corpus = sent.value
            now, own, grads, seen = None, None, None, 0

            def out():
                blocks = range(0, len(flat), _BLOCK)
                return pa.RecordBatch.from_arrays([pa.array([k // _BLOCK for k in blocks]), pa.array([now] * len(blocks), pa.int32()), pa.array([seen] * len(blocks)), pa.array([own.flat[k : k + _BLOCK].tobytes() for k in blocks], pa.binary())], ["block", "shard", "n", "weights"])

            # what is trained on at a time goes by the order of rows, not by batches
            rows: list[tuple[int, bytes]] = []
            size = 0

            def step():
                ids = np.frombuffer(b"".join(r[1] for r in rows), np.uint16)
                bounds = np.concatenate([[0], np.cumsum([len(r[1]) // 2 for r in rows])])
                at = _masked(np.array([r[0] for r in rows], np.int64).view(np.uint64), bounds, turn, masked)
                at = at[np.random.default_rng(len(ids)).permutation(len(at))]
                own.train(neighbours(ids, bounds, at), ids[at], own_corpus, grads)
                return len(at)

            for batch in batches:
                for shard, u, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                    if shard != now:
                        if rows:
                            seen += step()
                            rows, size = [], 0
                        if seen:
                            yield out()
                        now, own, seen = shard, Network(flat.copy()), 0
                        grads = [np.full(p.shape, 1e-6, np.float32) for p in own.parts]
                    rows.append((u, body.as_py()))
                    size += len(rows[-1][1])
                    if size >= 2 * HELD_TOKENS:
                        seen += step()
                        rows, size = [], 0
            if rows:
                seen += step()
            if seen:
                yield out()
            tk.release()

        def average(batches):
            sums: dict[int, list] = {}
            for batch in batches:
                for k, n, w in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
                    own = sums.setdefault(k, [0, 0.0])
                    own[0] += n
                    own[1] = own[1] + n * np.frombuffer(w, np.float32).astype(np.float64)
            if sums:
                yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([(s / n).astype(np.float32).tobytes() for n, s in sums.values()], pa.binary())], ["block", "weights"])

        dealt = encoded.where("n > 0").select(F.pmod("u", F.lit(shards)).cast("int").alias("shard"), "u", "ids").repartition(shards, "shard").sortWithinPartitions("shard", "u", "ids")
        blocks = -(-len(network.flat) // _BLOCK)
        got = dealt.mapInArrow(learn, schema).repartition(blocks, "block").sortWithinPartitions("block", "shard").mapInArrow(average, "block long, weights binary").collect()  # the weights once
        sent.destroy()
        if got:
            network = Network(np.concatenate([np.frombuffer(r["weights"], np.float32) for r in sorted(got, key=lambda r: r["block"])]).copy())
    return network, corpus


def score(encoded: DataFrame, network: Network, corpus: Corpus) -> DataFrame:
    """doc_id, n_tokens, log_likelihood, mean_log_likelihood: one row per input row, without a shuffle."""
    sent: Broadcast = encoded.sparkSession.sparkContext.broadcast((network.flat, corpus))

    def run(batches):
        own, own_corpus = Network(sent.value[0]), sent.value[1]
        for batch in batches:
            for a, b, ids, bounds in _held(batch.column(1)):
                each = np.empty(len(ids))
                around = neighbours(ids, bounds)
                for k in range(0, len(ids), HELD_TOKENS // 16):
                    part = slice(k, k + HELD_TOKENS // 16)
                    each[part] = own.log_probability(around[part], ids[part], own_corpus)
                sums = np.concatenate([[0.0], np.cumsum(each)])
                n = np.diff(bounds)
                total = sums[bounds[1:]] - sums[bounds[:-1]]
                mean = pa.array(total / np.maximum(1, n), mask=n == 0)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(n.astype(np.int64)), pa.array(np.where(n, total, 0.0)), mean], ["doc_id", "n_tokens", "log_likelihood", "mean_log_likelihood"])
        tk.release()

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, n_tokens long, log_likelihood double, mean_log_likelihood double")


def pseudo_likelihood(docs: DataFrame, **fitting) -> DataFrame:
    """Train on docs and score every document."""
    encoded = storage.store(encode(docs), "encoded")
    return score(encoded, *fit(encoded, **fitting))
