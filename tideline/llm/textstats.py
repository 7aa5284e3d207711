"""Counts of characters, words and lines of a batch of texts, as running sums that any span can read."""

from __future__ import annotations

import numpy as np

from tideline.llm import textbatch as tb

SYMBOL_BYTES = b"#*$%&|<>"
CLASSES = {
    "chars": tb.LEAD, "symbols": tb.flags(SYMBOL_BYTES), "upper": tb.flags(bytes(range(65, 91))), "lower": tb.flags(bytes(range(97, 123))),
    "digits": tb.flags(b"0123456789"), "stops": tb.flags(b".,;:!?"), "shouts": tb.flags(b"!"), "pipes": tb.flags(b"|"), "marks": tb.flags(b"@/"),
    "spaces": tb.SPACE, "wide": np.array([b >= 0xC0 for b in range(256)], np.uint8),
}
ENDS_SENTENCE = tb.flags(b".!?")


class Stats:
    """One chunk of texts: its words, its lines with a word, and sums of character classes."""

    def __init__(self, buf: np.ndarray, off: np.ndarray):
        self.buf, self.off = buf, off
        self.starts, self.ends = tb.words(buf, off)
        self.first_word = tb.bounds(off, self.starts)
        self.word_hash = tb.hashes(buf, self.starts, self.ends)
        lines = tb.lines(buf, off)
        many = np.searchsorted(self.starts, lines[1]) - np.searchsorted(self.starts, lines[0])
        self.line_starts, self.line_ends = lines[0][many > 0], lines[1][many > 0]
        self.line_words = many[many > 0]
        self.first_line = tb.bounds(off, self.line_starts)
        self._sums: dict[str, np.ndarray] = {}

    def sums(self, kind: str) -> np.ndarray:
        if kind not in self._sums:
            total = np.zeros(len(self.buf) + 1, np.int32 if len(self.buf) < 1 << 30 else np.int64)
            np.cumsum(CLASSES[kind][self.buf], out=total[1:])
            self._sums[kind] = total
        return self._sums[kind]

    def texts(self, kind: str) -> np.ndarray:
        total = self.sums(kind)
        return (total[self.off[1:]] - total[self.off[:-1]]).astype(np.int64)

    def in_lines(self, kind: str) -> np.ndarray:
        total = self.sums(kind)
        return (total[self.line_ends] - total[self.line_starts]).astype(np.int64)

    def line_text(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.off) - 1), np.diff(self.first_line))

    def n_words(self) -> np.ndarray:
        return np.diff(self.first_word)

    def word_chars(self) -> np.ndarray:
        return self.texts("chars") - self.texts("spaces")

    def repeated_lines(self) -> np.ndarray:
        """Marks each line that equals an earlier one of its text."""
        return ~first_of(tb.hashes(self.buf, self.line_starts, self.line_ends), self.line_text())

    def distinct_words(self) -> np.ndarray:
        text = np.repeat(np.arange(len(self.off) - 1), self.n_words())
        return np.bincount(text[first_of(self.word_hash, text)], minlength=len(self.off) - 1)

    def repeated_words(self, size: int = 5) -> np.ndarray:
        """Words of each text that lie in a window of ``size`` words found twice or more in the text."""
        value, at, text = tb.windows(self.word_hash, self.first_word, size)
        _, inverse, many = np.unique(scoped(value, text), return_inverse=True, return_counts=True)
        hit = at[many[inverse] > 1]
        cover = np.zeros(len(self.word_hash) + size + 1, np.int64)
        np.add.at(cover, hit, 1)
        np.add.at(cover, hit + size, -1)
        return tb.per_text(np.cumsum(cover)[: len(self.word_hash)] > 0, self.first_word)


def scoped(value: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Hashes made to differ between texts."""
    return value ^ tb.mix(text.astype(np.uint64) + np.uint64(0xA5A5A5A5))


def first_of(value: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Marks the first place of each value in each text."""
    first = np.zeros(len(value), bool)
    first[np.unique(scoped(value, text), return_index=True)[1]] = True
    return first


def share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return part / np.maximum(whole, 1)
