"""Quality classifier: a second-order factorisation machine over hashed words and structure statistics.

A text's inputs are its words hashed into ``BUCKETS`` (damped counts of unit length), the
transformed structure statistics of ``textstats`` and, as metadata, its length in bytes.
Every input i has a weight w_i and a low-rank vector v_i; all pairs interact through

    sum_{i<j} <v_i, v_j> x_i x_j = 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)

which costs time linear in the inputs. The score is the logistic of bias + linear +
pairwise terms.

Learning takes at most about ``FIT_ROWS`` labelled rows (chosen by a hash of the id), so
the labels that are broadcast and the task that fits have a bound that does not depend on
the tables. Scoring reads texts once, without a shuffle.

Null and empty texts are scored from the statistics of an empty text. Labels without a
text, and null labels, are not learned from; with no labels every score is 0.5. A null id is
not held out. Repeated rows are scored alike; extra columns, whatever they are called, are
ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import textkit as tk
from .language_id import held_out
from .textstats import NAMES, Stats

BUCKETS, RANK = 1 << 15, 8
#: Most labelled rows that are learned from, about.
FIT_ROWS = 12_000
#: Passes over the rows: so many, or more where rows are few, to make LEAST_STEPS steps.
EPOCHS, LEAST_STEPS, RATE, DECAY, MINIBATCH = 6, 500, 0.15, 1e-5, 256
#: Score from which a text is predicted good.
THRESHOLD = 0.3

_DENSE = len(NAMES) + 1
#: Rough centre and spread of the statistics, so that all inputs are of like size.
_CENTRE = np.array([5.5, 1.5, 0.2, 0.4, 0.1, 0.2, 0.8, 0.1, 7.0])
_SPREAD = np.array([1.2, 0.2, 1.0, 0.7, 0.4, 0.6, 0.6, 0.4, 1.5])


def inputs(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row pointers, input numbers and values; the dense statistics come after the hashed words."""
    s = Stats(column)
    n = len(s.n_words)
    key = s.words.rows().astype(np.int64) * BUCKETS + (s.hashes >> np.uint64(64 - (BUCKETS.bit_length() - 1))).astype(np.int64)
    key, count = np.unique(key, return_counts=True)
    rows, feature = key // BUCKETS, key % BUCKETS
    value = np.log1p(count)
    value /= np.sqrt(np.bincount(rows, value**2, n))[rows]
    size = np.diff(tk.strings(column)[1])
    dense = (np.column_stack([s.vectors(), np.log1p(size)]) - _CENTRE) / _SPREAD * 0.5
    per = np.bincount(rows, minlength=n)
    at = np.concatenate([[0], np.cumsum(per + _DENSE)])
    ids, x = np.empty(at[-1], np.int64), np.empty(at[-1], np.float32)
    word = np.ones(at[-1], bool)
    tail = (at[1:, None] - _DENSE + np.arange(_DENSE)).ravel()
    word[tail] = False
    ids[word], x[word] = feature, value
    ids[tail], x[tail] = np.tile(np.arange(BUCKETS, BUCKETS + _DENSE), n), dense.clip(-3, 3).ravel()
    return at, ids, x


class Machine:
    def __init__(self, bias: float, w: np.ndarray, v: np.ndarray):
        self.bias, self.w, self.v = bias, w, v

    def margin(self, at: np.ndarray, ids: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bias + linear + pairwise term of every row, and the factor sums."""
        vx = self.v[ids] * x[:, None]
        sums = np.add.reduceat(vx, at[:-1])
        return self.bias + np.add.reduceat(self.w[ids] * x, at[:-1]) + 0.5 * (sums**2 - np.add.reduceat(vx**2, at[:-1])).sum(1), sums

    def score(self, column: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(*inputs(column))[0].clip(-40, 40).astype(np.float64)))


def train(at: np.ndarray, ids: np.ndarray, x: np.ndarray, y: np.ndarray) -> Machine:
    """Adaptive gradient descent on the log loss, in minibatches; deterministic for the order given."""
    rng = np.random.default_rng(7)
    size = BUCKETS + _DENSE
    share = np.clip(y.mean(), 0.01, 0.99)
    m = Machine(float(np.log(share / (1 - share))), np.zeros(size, np.float32), rng.normal(0, 0.02, (size, RANK)).astype(np.float32))
    gw, gv, gb = np.full(size, 1e-3), np.full((size, RANK), 1e-3), 1e-3
    for _ in range(max(EPOCHS, -(-LEAST_STEPS * MINIBATCH // len(y)))):
        order = rng.permutation(len(y))
        for k in range(0, len(order), MINIBATCH):
            rows = order[k : k + MINIBATCH]
            per = at[rows + 1] - at[rows]
            pick = np.repeat(at[rows] - np.concatenate([[0], np.cumsum(per)[:-1]]), per) + np.arange(per.sum())
            own, i, xi = np.concatenate([[0], np.cumsum(per)]), ids[pick], x[pick]
            margin, sums = m.margin(own, i, xi)
            g = (1 / (1 + np.exp(-margin.clip(-40, 40))) - y[rows]) / len(rows)
            each = np.repeat(g, per) * xi
            used, back = np.unique(i, return_inverse=True)
            dw = np.bincount(back, each) + DECAY * m.w[used]
            inner = np.repeat(sums, per, axis=0) - m.v[i] * xi[:, None]
            dv = np.stack([np.bincount(back, each * inner[:, f]) for f in range(RANK)], 1) + DECAY * m.v[used]
            gb += g.sum() ** 2
            gw[used] += dw**2
            gv[used] += dv**2
            m.bias -= RATE * float(g.sum() / np.sqrt(gb))
            m.w[used] -= (RATE * dw / np.sqrt(gw[used])).astype(np.float32)
            m.v[used] -= (RATE * 0.3 * dv / np.sqrt(gv[used])).astype(np.float32)
    return m


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Machine | None:
    """Learn ``quality`` of labels on the texts of docs, from at most about ``rows`` rows."""
    good = labels.where("doc_id is not null and quality is not null").select(F.col("doc_id").cast("long").alias("_id"), F.col("quality").cast("double").alias("_y")).dropDuplicates(["_id"])
    share = rows / max(1, good.count())
    if share < 1:
        good = good.where(F.pmod(F.xxhash64(F.col("_id") + F.lit(11)), F.lit(1 << 20)) < int(share * (1 << 20)))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows_in = texts.join(F.broadcast(good), F.col("doc_id") == F.col("_id")).select("_id", "_y", "text")

    def featurise(batch):
        at, ids, x = inputs(batch.column(2))
        cut = pa.array(at.astype(np.int32))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(cut, pa.array(ids.astype(np.int32))), pa.ListArray.from_arrays(cut, pa.array(x))], ["_id", "_y", "ids", "x"])

    def learn(batches):
        parts = [(b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2), b.column(3)) for b in batches]
        if not sum(len(p[0]) for p in parts):
            return
        key, y = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        per = np.concatenate([np.diff(p[2].offsets.to_numpy()) for p in parts])
        ids, x = np.concatenate([p[2].flatten().to_numpy() for p in parts]).astype(np.int64), np.concatenate([p[3].flatten().to_numpy() for p in parts])
        at = np.concatenate([[0], np.cumsum(per)])
        order = np.argsort(key, kind="stable")
        pick = np.repeat(at[order] - np.concatenate([[0], np.cumsum(per[order])[:-1]]), per[order]) + np.arange(at[-1])
        m = train(np.concatenate([[0], np.cumsum(per[order])]), ids[pick], x[pick], y[order])
        yield pa.RecordBatch.from_arrays([pa.array([m.bias]), pa.array([m.w.tobytes()], pa.binary()), pa.array([m.v.tobytes()], pa.binary())], ["bias", "w", "v"])

    table = tk.map_texts(rows_in, "_id long, _y double, ids array<int>, x array<float>", featurise, ["_id", "_y", "text"])
    got = table.repartition(1).mapInArrow(learn, "bias double, w binary, v binary").collect()  # one row of a fixed size
    return Machine(got[0]["bias"], np.frombuffer(got[0]["w"], np.float32), np.frombuffer(got[0]["v"], np.float32).reshape(-1, RANK)) if got else None


def score(docs: DataFrame, machine: Machine | None) -> DataFrame:
    """doc_id, score: one row per input row."""

    def run(batch):
        s = machine.score(batch.column(1)) if machine else np.full(batch.num_rows, 0.5)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s)], ["doc_id", "score"])

    return tk.map_texts(docs, "doc_id long, score double", run, [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")])


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Learn from labels that are not held out and score every row: doc_id, held_out, score, predicted."""
    machine = fit(docs, labels.where(~held_out()))
    out = score(docs, machine)
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
