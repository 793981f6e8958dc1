"""Counts and structure statistics of texts, for slices of Arrow string columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from . import textkit as tk

#: Characters counted as symbols.
SYMBOLS = tk.table(b"#*$%&|<>")
#: Words of a repeat window.
REPEAT_WINDOW = 8
_UPPER = tk.table(range(0x41, 0x5B))
_DIGIT = tk.table(range(0x30, 0x3A))
_OTHER = tk.table(b"!\"'()+,-./:;=?@[\\]^_`{}~")
_ROW = np.uint64(0x9FB21C651E98DF25)

#: Words and characters of prior that a profile's rates are smoothed by, so that short texts vary little more than long ones.
PRIOR_WORDS, PRIOR_CHARS = 10, 50
#: Statistics of a profile, in order. All vary among ordinary texts, so their scatter is an estimate and not a floor.
PROFILE = ["words", "word_length", "word_spread", "marks", "upper", "distinct"]
#: Transformed statistics, in the order of ``vectors``.
NAMES = ["words", "word_length", "symbols", "upper", "dup_lines", "repeats", "marks", "digits"]


def _by_row(h: np.ndarray, rows: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return tk.mix(h + rows.astype(np.uint64) * _ROW)


def _lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the \\n-split lines; a text with no line break is one line."""
    breaks = np.flatnonzero(data == 0x0A)
    starts = np.sort(np.concatenate([offsets[:-1], breaks + 1]), kind="stable")
    ends = np.sort(np.concatenate([offsets[1:], breaks]), kind="stable")
    per = np.diff(np.searchsorted(breaks, offsets)) + 1
    return starts, ends, np.repeat(np.arange(len(per)), per)


class Stats:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words per row, and what the transforms need."""

    def __init__(self, column: pa.Array):
        data, offsets = tk.strings(column)
        n = len(offsets) - 1
        words = self.words = tk.Words(data, offsets, tk.WORD)
        spans = tk.Bytes(data)
        self.hashes = spans.span(words.starts, words.ends)
        rows = words.rows()
        inside = tk.WORD[data]
        self.n_words = words.counts.astype(np.int64)
        self.data, self.rows = data, rows
        self.word_chars = tk.per_row(inside & ((data & 0xC0) != 0x80), offsets)
        self.n_symbols = tk.per_row(SYMBOLS[data], offsets)
        self.upper = tk.per_row(_UPPER[data], offsets)
        self.digits = tk.per_row(_DIGIT[data], offsets)
        self.marks = tk.per_row(_OTHER[data], offsets)

        starts, ends, of = _lines(data, offsets)
        self.n_lines = np.bincount(of, minlength=n)
        held = np.concatenate([[0], np.cumsum(inside)])
        full = held[ends] > held[starts]
        starts, ends, of = starts[full], ends[full], of[full]
        _, first = np.unique(_by_row(spans.span(starts, ends), of), return_index=True)
        self.n_dup_lines = np.bincount(of, minlength=n) - np.bincount(of[first], minlength=n)

        at = words.windows(REPEAT_WINDOW)
        self.n_repeat_words = np.zeros(n, np.int64)
        if len(at):
            key = _by_row(tk.grams(self.hashes, REPEAT_WINDOW)[at], rows[at])
            order = np.argsort(key)
            same = np.zeros(len(key) + 1, bool)
            same[1:-1] = key[order[1:]] == key[order[:-1]]
            again = at[order[same[1:] | same[:-1]]]
            edge = np.zeros(len(rows) + 1, np.int64)
            np.add.at(edge, again, 1)
            np.add.at(edge, again + REPEAT_WINDOW, -1)
            self.n_repeat_words = tk.per_row(np.cumsum(edge[:-1]) > 0, words.bounds)

    def vectors(self) -> np.ndarray:
        """(rows, len(NAMES)) transformed statistics, finite for every text."""
        words, chars = np.maximum(1, self.n_words), np.maximum(1, self.word_chars)
        return np.stack([
            np.log1p(self.n_words), np.log(chars / words), np.log1p(50 * self.n_symbols / chars), np.log1p(20 * self.upper / chars),
            np.log1p(10 * self.n_dup_lines / np.maximum(1, self.n_lines)), np.log1p(10 * self.n_repeat_words / words),
            np.log1p(20 * self.marks / chars), np.log1p(20 * self.digits / chars),
        ], 1)

    def profiles(self) -> np.ndarray:
        """(rows, len(PROFILE)) transformed statistics, finite for every text."""
        n, words = len(self.n_words), self.n_words + PRIOR_WORDS
        lead = np.concatenate([[0], np.cumsum((self.data & 0xC0) != 0x80)])
        size = (lead[self.words.ends] - lead[self.words.starts]).astype(np.float64)
        mean = (self.word_chars + 5.0 * PRIOR_WORDS) / words
        spread = (np.bincount(self.rows, (size - mean[self.rows]) ** 2, n) + 9.0 * PRIOR_WORDS) / words
        chars = self.word_chars + PRIOR_CHARS
        first = np.unique(_by_row(self.hashes, self.rows), return_index=True)[1]
        distinct = np.bincount(self.rows[first], minlength=n) + PRIOR_WORDS
        rate = lambda k: np.log((k + 0.02 * PRIOR_CHARS) / chars)
        return np.stack([np.log1p(self.n_words), np.log(mean), np.log(spread) / 2, rate(self.n_symbols + self.marks + self.digits), rate(self.upper), np.log(distinct / words)], 1)
