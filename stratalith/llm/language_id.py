"""Language identification of mixed-language text.

1. ``fit`` counts hashed character n-grams of the words of labelled documents, per
   language, in the executors (a fixed number of buckets, so what returns to the driver
   has a fixed size), and the scripts in which each language is written.
2. A word's script, read off its lead bytes, narrows the candidates to the languages
   seen in that script; each candidate scores the word by the sum of its n-grams' log
   probabilities.
3. Viterbi over the words of a document, with a fixed penalty for a switch, labels every
   word; runs of one label are the spans. All documents of a slice advance together.

The document's language is the one that labels most letters (ties: the first by name);
the score is the share of those letters times the mean posterior of the label within
the document, from 0 to 1.

Null or empty texts and texts without a letter give ``und`` with score 0 and no spans.
Words without letters take the label of their neighbours. Rows with a null language are
not learned from; if nothing can be learned every text is ``und``. Rows with a null id are not
held out. Repeated rows are predicted alike; extra columns, whatever they are called, are
ignored, and kept by ``keep_identified``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import textkit as tk

#: Hash buckets of character n-grams, and the most cells of the (buckets, languages) table that is sent to all tasks: beyond 256 languages buckets are fewer.
BUCKETS, CELLS = 1 << 16, 1 << 24
#: Labelled documents learned from, at most about so many (chosen by a hash of the text).
FIT_ROWS = 40_000
#: Words of a segment of a document that is labelled at a time, and the most languages for which that pays.
SEGMENT, MOST_ENTRIES = 64, 12
#: Cost of a switch between neighbouring words, in nats.
SWITCH = 12.0
#: Weight of unseen n-grams.
SMOOTHING = 0.5
#: First code points of script ranges and their names; a range ends where the next begins.
SCRIPTS = [
    (0x0000, "common"), (0x0041, "latin"), (0x005B, "common"), (0x0061, "latin"), (0x007B, "common"), (0x00C0, "latin"), (0x0250, "common"),
    (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"), (0x0900, "devanagari"), (0x0980, "indic"),
    (0x0E00, "thai"), (0x0E80, "other"), (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "common"),
    (0x3040, "kana"), (0x3100, "han"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other"), (0x20000, "han"),
]
_NAMES = sorted({n for _, n in SCRIPTS} - {"common"})
_STARTS = np.array([c for c, _ in SCRIPTS])
_SCRIPT = np.array([-1 if n == "common" else _NAMES.index(n) for _, n in SCRIPTS])


def _code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of lead bytes and their code points."""
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    padded = np.concatenate([data, np.zeros(3, np.uint8)]).astype(np.int64)
    b = padded[lead]
    code = b.copy()
    two, three, four = (b >= 0xC0) & (b < 0xE0), (b >= 0xE0) & (b < 0xF0), b >= 0xF0
    tail = lambda k, rows: padded[lead[rows] + k] & 0x3F
    code[two] = (b[two] & 0x1F) << 6 | tail(1, two)
    code[three] = (b[three] & 0x0F) << 12 | tail(1, three) << 6 | tail(2, three)
    code[four] = (b[four] & 0x07) << 18 | tail(1, four) << 12 | tail(2, four) << 6 | tail(3, four)
    return lead, code


class Texts:
    """Lower-cased bytes and the words of a slice: a letter is an ASCII letter or any byte beyond ASCII; digits, marks and white space part words."""

    def __init__(self, column: pa.Array):
        raw, self.offsets = tk.strings(column)
        self.data = tk.LOWER[raw]
        self.words = tk.Words(self.data, self.offsets, LETTER_BYTES)


class Features:
    """The n-gram buckets of chosen words (all, if none are chosen), and each word's script and letters."""

    def __init__(self, texts: Texts, buckets: int, chosen: np.ndarray | None = None):
        self.data, w = texts.data, texts.words
        starts, ends = (w.starts, w.ends) if chosen is None else (w.starts[chosen], w.ends[chosen])
        lead, code = _code_points(self.data)
        script = _SCRIPT[np.searchsorted(_STARTS, code, "right") - 1]
        at = np.searchsorted(lead, starts), np.searchsorted(lead, ends)
        n = len(starts)
        known = np.concatenate([[0], np.cumsum(script >= 0)])
        self.letters = known[at[1]] - known[at[0]]
        # the script of a word is that of its first letter
        spots = np.flatnonzero(script >= 0)
        first = np.searchsorted(spots, at[0])
        self.script = np.full(n, -1)
        has = self.letters > 0
        self.script[has] = script[spots[first[has]]]
        # n-grams: every run of 1 to 4 bytes of the word with its edges; byte runs cross code points, which costs nothing
        size = ends - starts + 2
        self.begin = np.concatenate([[0], np.cumsum(size)])
        flat = np.full(int(self.begin[-1]), 0x20, np.uint8)
        inner = np.ones(len(flat), bool)
        inner[self.begin[:-1]] = inner[self.begin[1:] - 1] = False
        flat[inner] = self.data[_spans(starts, ends)]
        self.grams: list[np.ndarray] = []
        x = flat.astype(np.uint32)
        last = np.repeat(self.begin[1:], size)
        place = np.arange(len(flat))
        h = x.copy()
        for k in (2, 3, 4):
            nxt = np.zeros(len(x), np.uint32)
            nxt[: len(x) - k + 1] = x[k - 1 :]
            h = h * np.uint32(0x01000193) + nxt + np.uint32(k)
            g = h ^ (h >> np.uint32(15))
            g = (g * np.uint32(0x9E3779B1)) >> np.uint32(32 - (buckets.bit_length() - 1))
            g[place + k > last] = buckets  # a run that leaves its word counts for nothing
            self.grams.append(g)

    def sums(self, weights: np.ndarray) -> np.ndarray:
        """Per word, the sum over its n-grams of a (buckets + 1, languages) table."""
        n = len(self.begin) - 1
        out = np.zeros((n, weights.shape[1]), np.float32)
        if not n:
            return out
        for g in self.grams:
            for j in range(weights.shape[1]):
                out[:, j] += np.add.reduceat(weights[:, j][g], self.begin[:-1])
        return out


LETTER_BYTES = tk.table([*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)])


def _spans(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    size = ends - starts
    return np.repeat(starts - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(int(size.sum())) if len(starts) else np.empty(0, np.int64)


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # (buckets + 1, languages), log probabilities; the last row is 0
    written: np.ndarray  # (scripts, languages), whether a language is seen in a script
    switch: float = SWITCH


def fit(docs: DataFrame, buckets: int = BUCKETS, rows: int = FIT_ROWS, smoothing: float = SMOOTHING, switch: float = SWITCH) -> Model:
    """Learn from text and non-null lang of docs, at most about ``rows`` of them, chosen by a hash of the text."""
    sizes = docs.where("lang is not null").groupBy(F.col("lang").cast("string").alias("lang")).count().agg(F.count("*"), F.coalesce(F.sum("count"), F.lit(0))).first()
    while buckets > 256 and buckets * sizes[0] > CELLS:
        buckets //= 2
    good = docs.where("lang is not null and text is not null").select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    share = rows / max(1, sizes[1])
    if share < 1:
        good = good.where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < int(share * (1 << 20)))

    def count(batches):
        names: list[str] = []
        grams, scripts = np.zeros((0, buckets + 1)), np.zeros((0, len(_NAMES)))
        for batch in batches:
            for a, b in tk.slices(tk.strings(batch.column(1))[1], 1 << 19):
                lang = batch.column(0).slice(a, b - a).to_pylist()
                texts = Texts(batch.column(1).slice(a, b - a))
                f = Features(texts, buckets)
                for x in dict.fromkeys(lang):
                    if x not in names:
                        names.append(x)
                        grams = np.vstack([grams, np.zeros((1, buckets + 1))])
                        scripts = np.vstack([scripts, np.zeros((1, len(_NAMES)))])
                which = np.array([names.index(x) for x in lang])[texts.words.rows()]
                letters = which[f.script >= 0], f.script[f.script >= 0]
                np.add.at(scripts, letters, f.letters[f.script >= 0])
                each = np.repeat(which, np.diff(f.begin))
                for g in f.grams:
                    grams += np.bincount(each * (buckets + 1) + g, minlength=grams.size).reshape(grams.shape)
        for x, g, s in zip(names, grams, scripts, strict=True):
            at = np.flatnonzero(g[:buckets])
            yield pa.RecordBatch.from_arrays([pa.array([x] * len(at)), pa.array(at), pa.array(g[at])], ["lang", "feature", "n"])
            at = np.flatnonzero(s)
            yield pa.RecordBatch.from_arrays([pa.array([x] * len(at), pa.string()), pa.array(at + buckets), pa.array(s[at])], ["lang", "feature", "n"])

    counted = good.mapInArrow(count, "lang string, feature long, n double").groupBy("lang", "feature").agg(F.sum("n").alias("n"))
    table = counted.groupBy("lang").agg(F.collect_list(F.struct("feature", "n")).alias("c")).collect()
    languages = sorted(r["lang"] for r in table)
    weights, written = np.zeros((buckets + 1, len(languages)), np.float32), np.zeros((len(_NAMES), len(languages)))
    for r in table:
        j = languages.index(r["lang"])
        feature, n = np.array([x["feature"] for x in r["c"]]), np.array([x["n"] for x in r["c"]])
        gram = feature < buckets
        full = np.full(buckets, smoothing)
        full[feature[gram]] += n[gram]
        weights[:buckets, j] = np.log(full / full.sum())
        written[feature[~gram] - buckets, j] = n[~gram]
    # a language is written in a script that has a thousandth of its letters
    seen = written >= 0.001 * np.maximum(1, written.sum(0))
    return Model(languages, weights, seen, switch)


def _walk(scores: np.ndarray, begin: np.ndarray, size: np.ndarray, best: np.ndarray, switch: float, keep: bool) -> tuple[np.ndarray, np.ndarray | None, np.ndarray | None]:
    """Advance from ``best`` (segments, ..., labels) over each segment's words; segments in decreasing size.

    If kept, also whether each label of a word came by a switch, and from which label.
    """
    best = best.copy()
    back = source = None
    if keep:
        back, source = np.zeros(scores.shape, bool), np.zeros(len(scores), np.int32)
    active = np.searchsorted(-size, -np.arange(int(size.max(initial=0))), "left")  # segments with more than t words
    for t, m in enumerate(active.tolist()):
        at, v = begin[:m] + t, best[:m]
        jump = v.max(-1, keepdims=True) - switch
        if keep:
            source[at], back[at] = v.argmax(-1), v < jump
        np.maximum(v, jump, out=v)
        v += scores[at] if v.ndim == 2 else scores[at][:, None, :]
    return best, back, source


def _viterbi(scores: np.ndarray, counts: np.ndarray, switch: float) -> np.ndarray:
    """Best label of every word; scores (words, languages) with the rows of a document together.

    Documents are cut into segments that all advance together: first from every label before
    them (where languages are few enough for that), which gives the best score between any two
    labels; then documents choose the labels at their segments' ends; then the words between.
    """
    n, k = scores.shape
    label = np.zeros(n, np.int32)
    if not n:
        return label
    length = SEGMENT if k <= MOST_ENTRIES else int(counts.max())
    per = -(-counts // length)
    first = np.concatenate([[0], np.cumsum(per)])
    within = np.arange(first[-1]) - np.repeat(first[:-1], per)
    begin = np.repeat(np.concatenate([[0], np.cumsum(counts)[:-1]]), per) + within * length
    size = np.minimum(length, np.repeat(counts, per) - within * length)
    order = np.argsort(-size, kind="stable")
    entry = np.full((len(size), k), -np.inf)
    entry[within == 0] = 0
    docs = np.flatnonzero(per)
    docs = docs[np.argsort(-per[docs], kind="stable")]
    most = int(per.max())
    longer = np.searchsorted(-per[docs], -np.arange(most), "left")  # documents with more than q segments
    if most > 1:
        between = np.empty((len(size), k, k))
        between[order] = _walk(scores, begin[order], size[order], np.broadcast_to(np.where(np.eye(k, dtype=bool), 0, -np.inf), (len(size), k, k)), switch, False)[0]
        reach = np.empty((len(size), k))  # best scores before each segment
        now = np.zeros((len(docs), k))
        for q, m in enumerate(longer.tolist()):
            at = first[docs[:m]] + q
            reach[at] = now[:m]
            v = (now[:m, :, None] + between[at]).max(1)  # a document begins with any label at no cost
            now[:m] = v - v.max(1, keepdims=True)
        out = now.argmax(1)
        leave = np.empty(len(size), np.int64)
        for q in range(most - 1, -1, -1):
            m = int(longer[q])
            at = first[docs[:m]] + q
            leave[at] = out[:m]
            if q:
                before = (reach[at] + between[at, :, out[:m]]).argmax(1)
                entry[at, before] = 0
                out[:m] = before
    ended, back, source = _walk(scores, begin[order], size[order], entry[order], switch, True)
    state = ended.argmax(1) if most == 1 else leave[order]
    active = np.searchsorted(-size[order], -np.arange(int(size.max())), "left")
    for t in range(len(active) - 1, -1, -1):
        m = int(active[t])
        at = begin[order[:m]] + t
        s = state[:m]
        label[at] = s
        state[:m] = np.where(back[at, s], source[at], s)
    return label


def _distinct(words: tk.Words, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One place of every distinct word, and the distinct word of every word."""
    _, first, back = np.unique(tk.Bytes(data).span(words.starts, words.ends), return_index=True, return_inverse=True)
    return first, back


def _label(column: pa.Array, model: Model) -> tuple[Texts, np.ndarray, np.ndarray]:
    f = Texts(column)
    # a distinct word is scored once
    first, back = _distinct(f.words, f.data)
    g = Features(f, len(model.weights) - 1, first)
    scores = g.sums(model.weights)
    allowed = np.where((g.script >= 0)[:, None], model.written[np.maximum(g.script, 0)], True)
    allowed |= ~allowed.any(1, keepdims=True)  # a script that no language is written in narrows nothing
    scores[~allowed] = scores[~allowed] - np.float32(1e3)
    scores[g.letters == 0] = 0
    f.letters = g.letters[back]
    scores = scores[back]
    return f, scores, _viterbi(scores.astype(np.float64), f.words.counts, model.switch)


def _letterless(column: pa.Array) -> np.ndarray:
    """Rows without a letter; one without ASCII letters may hold marks only, which no script range tells from letters."""
    data, offsets = tk.strings(column)
    und = tk.per_row(LETTER_BYTES[data] & (data < 0x80), offsets) == 0
    for r in np.flatnonzero(und).tolist():
        und[r] = not any(c.isalpha() for c in column[r].as_py() or "")
    return und


def labels(column: pa.Array, model: Model) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """The language, score and spans of every text."""
    names, k, n = model.languages, len(model.languages), len(column)
    if not k:
        kind = pa.list_(pa.struct([("first_word", pa.int64()), ("words", pa.int64()), ("lang", pa.string())]))
        return np.full(n, "und", object), np.zeros(n), pa.array([[]] * n, kind)
    f, scores, label = _label(column, model)
    rows = f.words.rows()
    letters = np.bincount(rows * k + label, f.letters, n * k).reshape(n, k)
    total = letters.sum(1)
    best = letters.argmax(1)
    # mean posterior of the winner over the words it labels, scaled by its share of letters
    own = label == best[rows]
    s = scores - scores.max(1, keepdims=True)
    p = 1 / np.exp(s - s[np.arange(len(s)), label][:, None]).clip(max=1e30).sum(1)
    mean = np.bincount(rows, p * own * f.letters, n) / np.maximum(1, np.bincount(rows, own * f.letters, n))
    score = np.clip(mean * letters[np.arange(n), best] / np.maximum(1, total), 0, 1)
    und = _letterless(column)
    best, score = np.where(total == 0, 0, best), np.where(und, 0.0, np.where(total == 0, 1 / k, score))
    pred = np.array(names, object)[best]
    pred[und] = "und"
    new = np.ones(len(label), bool)
    new[1:] = (label[1:] != label[:-1]) | (rows[1:] != rows[:-1])
    head = np.flatnonzero(new)
    size = np.diff(np.append(head, len(label)))
    cuts = np.searchsorted(rows[head], np.arange(n + 1))
    spans = pa.StructArray.from_arrays([pa.array(head - f.words.bounds[rows[head]]), pa.array(size), pa.array(np.array(names, object)[label[head]], pa.string())], ["first_word", "words", "lang"])
    return pred, score, pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), spans)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, spans array<struct<first_word, words, lang>>: one row per input row, without a shuffle."""
    schema = "doc_id long, lang_pred string, score double, spans array<struct<first_word: long, words: long, lang: string>>"

    def run(batch):
        pred, score, spans = labels(batch.column(1), model)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pred, pa.string()), pa.array(score), spans], ["doc_id", "lang_pred", "score", "spans"])

    return tk.map_texts(docs, schema, run, [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")])


def held_out(doc_id: str = "doc_id"):
    """Whether a document is kept from learning: crc32 of its id as text is divisible by 5. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def identify(docs: DataFrame, **fitting) -> DataFrame:
    """Learn from the rows that are not held out and predict every row: doc_id, held_out, lang_pred, score, n_spans, mixed."""
    rows = docs.select("doc_id", "text", "lang")
    out = predict(rows, fit(rows.where(~held_out()), **fitting))
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", F.size("spans").cast("long").alias("n_spans"), (F.size(F.array_distinct("spans.lang")) > 1).alias("mixed"))


def keep_identified(docs: DataFrame, **fitting) -> DataFrame:
    """Rows with an identified language, with all their columns; ``und`` goes. Every row is judged by its own text."""
    model = fit(docs.select("doc_id", "text", "lang").where(~held_out()), **fitting)

    def verdict(column):
        return np.array([x != "und" for x in labels(column, model)[0]], bool)

    return tk.keep_rows(docs, "text", verdict)
