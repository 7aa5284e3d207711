"""Texts cut where no tokenizer merge can reach across, so that each distinct piece is worked on once.

A cut lies before a single space or line feed between other characters, and before ASCII punctuation (other than the
apostrophe) that follows a letter. Both public byte-pair vocabularies split there in any case: their patterns let a space only
begin a piece, and never join letters with punctuation. White space that is not a single byte stays whole inside a piece.
"""

from __future__ import annotations

import numpy as np

from tideline.llm import textbatch as tb

CONTROL = np.array([b <= 0x20 or b == 0x7F for b in range(256)])
LETTER = np.array([chr(b).isascii() and chr(b).isalpha() for b in range(256)])
PUNCTUATION = np.array([33 <= b < 127 and not chr(b).isalnum() and b != 39 for b in range(256)])
#: Lead bytes of the multi-byte white space characters (U+0085, U+00A0, U+1680, U+2000 to U+205F, U+3000).
WIDE = np.array([b in (0xC2, 0xE1, 0xE2, 0xE3) for b in range(256)])


def cuts(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Start of every segment, in order; each text that is not empty starts one."""
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64)
    at = np.flatnonzero((buf == 32) | (buf == 10))
    at = at[(at > 0) & (at < n - 1)]
    before, after = buf[at - 1], buf[at + 1]
    wide = WIDE[buf[np.maximum(at - 2, 0)]] | WIDE[buf[np.maximum(at - 3, 0)]]
    at = at[~(CONTROL[before] | CONTROL[after] | WIDE[after] | ((before >= 0x80) & wide))]
    mark = np.flatnonzero(PUNCTUATION[buf])
    mark = mark[mark > 0]
    last = buf[mark - 1]
    latin = (buf[np.maximum(mark - 2, 0)] == 0xC3) & (last >= 0x80) & (last != 0x97) & (last != 0xB7) & (mark > 1)
    mark = mark[LETTER[last] | latin]
    begin = off[:-1][off[1:] > off[:-1]]
    cut = np.zeros(n, bool)
    cut[at], cut[mark], cut[begin] = True, True, True
    return np.flatnonzero(cut)


class Memory:
    """Results of distinct segments by hash, kept over the batches of a worker up to a fixed number of segments.

    A result is a run of values; ``table`` and ``of`` hold the runs one after another. When a batch would exceed the bound,
    all earlier results are dropped and only the batch's own are kept.
    """

    def __init__(self, solve, most: int = 1_000_000):
        self.solve, self.most = solve, most
        self._clear()

    def _clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.place = np.zeros(0, np.int64)
        self.ends = np.zeros(1, np.int64)
        self.values = np.zeros(0, np.uint32)

    def _find(self, wanted: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.keys, wanted)
        at[at == len(self.keys)] = 0
        hit = self.keys[at] == wanted if len(self.keys) else np.zeros(len(wanted), bool)
        return np.where(hit, self.place[at] if len(self.keys) else 0, -1)

    def _add(self, raw: bytes, wanted, found, starts, ends) -> None:
        new = np.flatnonzero(found < 0)
        if not len(new):
            return
        counts, values = self.solve([raw[s:e].decode("utf-8") for s, e in zip(starts[new].tolist(), ends[new].tolist())])
        base = len(self.ends) - 1
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(counts)])
        self.values = np.concatenate([self.values, np.asarray(values, np.uint32)])
        at = np.searchsorted(self.keys, wanted[new])
        self.keys = np.insert(self.keys, at, wanted[new])
        self.place = np.insert(self.place, at, base + np.arange(len(new)))

    def look(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The place of each span's result: ``values[self.ends[p]:self.ends[p + 1]]``."""
        if not len(starts):
            return np.zeros(0, np.int64)
        hashed = tb.hashes(buf, starts, ends)
        wanted, first, inverse = np.unique(hashed, return_index=True, return_inverse=True)
        found = self._find(wanted)
        if len(self.keys) + int((found < 0).sum()) > self.most:
            self._clear()
            found = np.full(len(wanted), -1)
        self._add(buf.tobytes(), wanted, found, starts[first], ends[first])
        return self._find(wanted)[inverse]


def gather(memory: Memory, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All values of the places in order, and the number of each."""
    counts = memory.ends[place + 1] - memory.ends[place]
    ends = np.cumsum(counts)
    index = np.arange(ends[-1] if len(ends) else 0) + np.repeat(memory.ends[place] - (ends - counts), counts)
    return memory.values[index], counts


class Encoder:
    """Token ids of whole texts by a ``tokenizers`` file, exactly as the library gives them."""

    def __init__(self, path: str, most: int = 1_000_000):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.memory = Memory(self._solve, most)

    def _solve(self, pieces: list[str]):
        done = [x.ids for x in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
        counts = np.fromiter(map(len, done), np.int64, len(done))
        return counts, np.fromiter((i for ids in done for i in ids), np.uint32, int(counts.sum()))

    def whole(self, raw: bytes) -> np.ndarray:
        """One text in one call, for texts that hold the string of an added token."""
        return np.array(self.tokenizer.encode(raw.decode("utf-8"), add_special_tokens=False).ids, np.uint32)

    def encode(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and where each text's ids begin."""
        starts = cuts(buf, off)
        ends = np.append(starts[1:], len(buf))
        ids, counts = gather(self.memory, self.memory.look(buf, starts, ends))
        total = np.zeros(len(starts) + 1, np.int64)
        np.cumsum(counts, out=total[1:])
        begin = total[tb.bounds(off, starts)]
        raw = buf.tobytes()
        if any(s in raw for s in self.special):
            parts, n = [], len(off) - 1
            for i in range(n):
                text = raw[off[i] : off[i + 1]]
                parts.append(self.whole(text) if any(s in text for s in self.special) else ids[begin[i] : begin[i + 1]])
            begin = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
            ids = np.concatenate(parts)
        return ids, begin
