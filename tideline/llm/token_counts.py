"""Token counts by rank-synchronous array merging.

The distinct pre-tokens of a batch lie one after another in one symbol array. In each round every pre-token finds its pair of
lowest merge rank and joins all occurrences of it at once, left to right; the rounds end when no pre-token holds a known pair,
and the symbols that are left are its tokens. No tokenizer encodes anything here: the library only splits a piece of text into
pre-tokens, so that the Unicode tables are its own.

Null and empty texts have 0 tokens. The string of an added token counts as one token, as the library's default has it.
"""

from __future__ import annotations

import heapq
import json
import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from tideline.llm import textbatch as tb
from tideline.llm.frames import texts
from tideline.llm.segments import Memory, cuts, gather

NO_RANK = np.int64(1 << 40)
#: Symbols from which a sequence is merged on its own: the rounds of many short ones share their arrays, a long one has far more.
LONG = 4096


class Merges:
    """The merge table of a byte-pair vocabulary file as sorted arrays."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        tokenizer = Tokenizer.from_file(path)
        self.split = tokenizer.pre_tokenizer.pre_tokenize_str
        if tokenizer.normalizer is not None or spec["model"]["type"] != "BPE" or spec["model"].get("end_of_word_suffix"):
            raise ValueError("a byte-level vocabulary without normaliser is needed")
        added = [t["content"] for t in spec["added_tokens"]]
        self.added = [a.encode() for a in added]
        self.added_pattern = re.compile(b"|".join(re.escape(a.encode()) for a in sorted(added, key=len, reverse=True))) if added else None
        vocab = spec["model"]["vocab"]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        self.width = max(vocab.values()) + 1
        key = np.array([vocab[a] * self.width + vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(key, kind="stable")
        self.key, self.rank, self.made = key[order], order.astype(np.int64), made[order]
        self.symbol = {c: i for c, i in vocab.items() if len(c) == 1}

    def look(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair (NO_RANK if unknown) and its row in the table."""
        wanted = left * self.width + right
        at = np.minimum(np.searchsorted(self.key, wanted), len(self.key) - 1)
        return np.where(self.key[at] == wanted, self.rank[at], NO_RANK), at


def surviving_of_one(symbols: np.ndarray, merges: Merges) -> int:
    """Symbols left of one long sequence. Each round still merges all pairs of the lowest rank at once, but only looks at the
    places that earlier rounds have named for it, and names new ones beside its merges; the work follows the merges made."""
    n = len(symbols)
    symbol, nxt, prv, here = symbols.copy(), np.arange(1, n + 1), np.arange(-1, n - 1), np.ones(n, bool)
    places: dict[int, list[np.ndarray]] = {}
    waiting: list[int] = []

    def name(at: np.ndarray) -> None:
        rank, _ = merges.look(symbol[at], symbol[nxt[at]])
        order = np.argsort(rank, kind="stable")
        rank, at = rank[order], at[order]
        cut = np.flatnonzero(np.diff(rank, prepend=-1))
        for a, z in zip(cut.tolist(), [*cut[1:].tolist(), len(rank)]):
            r = int(rank[a])
            if r == NO_RANK:
                break
            if r not in places:
                places[r] = []
                heapq.heappush(waiting, r)
            places[r].append(at[a:z])

    name(np.arange(n - 1))
    while waiting:
        lowest = heapq.heappop(waiting)
        at = np.unique(np.concatenate(places.pop(lowest)))
        at = at[here[at]]
        at = at[nxt[at] < n]
        rank, row = merges.look(symbol[at], symbol[nxt[at]])
        at, row = at[rank == lowest], row[rank == lowest]
        if not len(at):
            continue
        # where a pair's right symbol begins the next pair, every second pair of the run is taken, from the left
        first = np.append(True, nxt[at[:-1]] != at[1:])
        begin = np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))
        taken = (np.arange(len(at)) - begin) % 2 == 0
        at, row = at[taken], row[taken]
        right = nxt[at]
        after = nxt[right]
        symbol[at], here[right], nxt[at] = merges.made[row], False, after
        inside = after < n
        prv[after[inside]] = at[inside]
        before = prv[at]
        beside = np.unique(np.concatenate([before[before >= 0], at[inside]]))
        name(beside)
    return int(here.sum())


def surviving(symbols: np.ndarray, lengths: np.ndarray, merges: Merges) -> np.ndarray:
    """Symbols left of each sequence when no merge applies any more. Every length is at least 1."""
    left = lengths.copy()
    ends = np.cumsum(lengths)
    for i in np.flatnonzero(lengths >= LONG):
        left[i] = surviving_of_one(symbols[ends[i] - lengths[i] : ends[i]], merges)
    together = (lengths > 1) & (lengths < LONG)
    alive = np.flatnonzero(together)
    keep = np.repeat(together, lengths)
    symbols, size = symbols[keep], lengths[alive]
    while len(alive):
        ends = np.cumsum(size)
        starts = ends - size
        rank, row = merges.look(symbols[:-1], symbols[1:])
        rank, row = np.append(rank, NO_RANK), np.append(row, 0)
        rank[ends - 1] = NO_RANK
        lowest = np.minimum.reduceat(rank, starts)
        live = lowest < NO_RANK
        hit = (rank < NO_RANK) & (rank == np.repeat(lowest, size))
        # a run of equal symbols hits at each place; every second one is taken, from the left
        run = np.flatnonzero(hit)
        first = np.ones(len(run), bool)
        first[1:] = (np.diff(run) > 1) | (np.isin(run[1:], starts) if len(run) > 1 else False)
        begin = np.maximum.accumulate(np.where(first, np.arange(len(run)), 0))
        taken = run[(np.arange(len(run)) - begin) % 2 == 0]
        symbols[taken] = merges.made[row[taken]]
        stay = np.ones(len(symbols), bool)
        stay[taken + 1] = False
        gone = np.zeros(len(symbols) + 1, np.int64)
        np.cumsum(~stay, out=gone[1:])
        size = size - (gone[ends] - gone[starts])
        left[alive] = size
        stay &= np.repeat(live, ends - starts)
        symbols, alive, size = symbols[stay], alive[live], size[live]
        done = size == 1
        if done.any():
            symbols = symbols[np.repeat(~done, size)]
            alive, size = alive[~done], size[~done]
    return left


class Counter:
    """Counts tokens of batches of texts; each distinct piece of text is merged once."""

    def __init__(self, path: str):
        self.merges = Merges(path)
        self.memory = Memory(self._solve)

    def _solve(self, pieces: list[str]):
        place: dict[str, int] = {}
        use, many = [], []
        split = self.merges.split
        for piece in pieces:
            parts = split(piece)
            many.append(len(parts))
            for part, _ in parts:
                use.append(place.setdefault(part, len(place)))
        table = self.merges.symbol
        lengths = np.fromiter(map(len, place), np.int64, len(place))
        symbols = np.fromiter((table[c] for part in place for c in part), np.int64, int(lengths.sum()))
        tokens = surviving(symbols, lengths, self.merges)
        total = np.zeros(len(use) + 1, np.int64)
        np.cumsum(tokens[np.array(use, np.int64)], out=total[1:])
        ends = np.cumsum(many)
        return np.ones(len(pieces), np.int64), total[ends] - total[ends - np.array(many)]

    def _plain(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        starts = cuts(buf, off)
        got, _ = gather(self.memory, self.memory.look(buf, starts, np.append(starts[1:], len(buf))))
        total = np.zeros(len(starts) + 1, np.int64)
        np.cumsum(got, dtype=np.int64, out=total[1:])
        first = tb.bounds(off, starts)
        return total[first[1:]] - total[first[:-1]]

    def count(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        raw = buf.tobytes()
        if not any(a in raw for a in self.merges.added):
            return self._plain(buf, off)
        # the added strings are cut out; what lies between them is counted as texts of their own
        sections, owner, extra = [], [], np.zeros(len(off) - 1, np.int64)
        for i in range(len(off) - 1):
            parts = self.merges.added_pattern.split(raw[off[i] : off[i + 1]])
            extra[i] = len(parts) - 1
            sections += parts
            owner += [i] * len(parts)
        cut = np.concatenate([[0], np.cumsum([len(s) for s in sections])]).astype(np.int64)
        counts = self._plain(np.frombuffer(b"".join(sections), np.uint8), cut)
        return extra + np.bincount(np.array(owner), counts, len(extra)).astype(np.int64)


_COUNTERS: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    """One counter for each vocabulary and Python worker."""
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(path)
    return _COUNTERS[path]


def token_counts(docs: DataFrame, path: str, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id, ``n_bytes``, ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens).

    A null text counts as empty. Repeated rows each give a row. No shuffle; whole texts.
    """
    source = texts(docs, id_col, text_col)
    schema = T.StructType([T.StructField(id_col, source.schema["_id"].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])

    def work(batches):
        own = counter(path)
        for batch in batches:
            for lo, hi, buf, off in tb.chunks(batch.column(1)):
                n = own.count(buf, off)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(np.diff(off)), pa.array(n), pa.array(n > limit)], names=schema.names)

    return source.mapInArrow(work, schema)
