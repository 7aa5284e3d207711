"""Removal of passages that an earlier document holds, by Aho-Corasick automata of repeated phrases.

A window is ``window`` consecutive words of one document; a word goes if a window that covers it also starts in a document with a
smaller id. Three steps:

1. Confirm: every window is represented by the PHRASE_WORDS words inside it whose hash is smallest, so equal windows have the
   same phrase. Phrases of one document only are out; the others are confirmed as repeated. Spark counts them; their hashes
   go into a bitmap of fixed size (2 ** FILTER_BITS bits), which may let more through but holds every repeated phrase.
2. Locate: a task compiles the confirmed phrases of a chunk of texts into one automaton (a shard of the phrases), and streams the
   chunk's documents through it. What it finds are the only places where a window can be repeated: a window without an
   occurrence is unique. Windows around occurrences are keyed by their phrase and by two hashes of their words.
3. Decide: inside a chunk, a window that a smaller id of the chunk holds goes at once; each window's smallest holder is sent, packed
   with the others of its phrase's part, to be compared with the holders in other chunks. A phrase that holds more than
   1 / HOT_SHARES of all rows is compared in SALTS groups first. Removed word ranges then meet their documents in one join by id.

A part gets at most one holder per chunk and window; parts are as many as the phrases ask for. Phrases are compared as text by the
automata; windows meet only under the same phrase and are told apart by 96 bits.

Defined results: null and empty texts have no words and an empty rest; documents with a null id are neither changed nor a reason to
change others; rows of the same id never remove each other's words, equal rows get equal results; texts may have any length; an empty
table gives an empty result. Only the id and the text are read, so other columns cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tideline.llm import cellfilter, textbatch as tb
from tideline.llm.frames import staged

PHRASE_WORDS = 10
FILTER_BITS = 26
CHUNK_BYTES = 2 << 20
PART_PHRASES = 50_000
HOT_SHARES = 4096
HOT_ROWS = 1000
SALTS = 64

_NONE = np.uint64(2**64 - 1)
PACK = "part int, salt int, ids binary, keys binary, starts binary, sizes binary, low binary, high binary"
RANGES = "doc long, text_key long, start long, stop long"


class Chunk:
    """Words of some texts, and the phrase that represents each window."""

    def __init__(self, buf: np.ndarray, off: np.ndarray, window: int):
        self.buf, self.off = buf, off
        self.s, self.e = tb.words(buf, off)
        self.hash = tb.hashes(buf, self.s, self.e)
        self.first = tb.bounds(off, self.s)
        self.n, self.window = len(self.s), window
        text = np.repeat(np.arange(len(off) - 1), np.diff(self.first))
        self.left = self.first[1:][text] - np.arange(self.n)  # words from here to the end of the text
        value = np.full(self.n, _NONE)
        got, at, _ = tb.windows(self.hash, self.first, min(PHRASE_WORDS, window))
        value[at] = got
        self.phrase = value
        self.starts = np.flatnonzero(self.left >= window)  # of windows
        self.text = text

    def least(self, value: np.ndarray) -> np.ndarray:
        """The smallest value among the phrases inside each window."""
        reach, span, out = self.window - min(PHRASE_WORDS, self.window) + 1, 1, value
        while 2 * span <= reach:
            out = np.minimum(out, np.concatenate([out[span:], np.full(min(span, len(out)), _NONE)]))
            span *= 2
        return np.minimum(out[self.starts], out[np.minimum(self.starts + reach - span, self.n - 1)])

    def spaced(self) -> tuple[np.ndarray, np.ndarray]:
        """All words with one space behind each, and where each word begins."""
        size = self.e - self.s
        begin = np.zeros(self.n + 1, np.int64)
        np.cumsum(size + 1, out=begin[1:])
        out = np.full(begin[-1], 32, np.uint8)
        inside = tb.SPACE[self.buf] == 0
        out[np.arange(int(size.sum())) + np.repeat(np.arange(self.n), size)] = self.buf[inside]
        return out, begin


def _phrases(window: int):
    """Every chunk's phrases with the smallest and largest id that hold them."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy()
            for lo, hi, buf, off in tb.chunks(b.column(2), CHUNK_BYTES):
                c = Chunk(buf, off, window)
                key, doc = c.least(c.phrase), ids[lo:hi][c.text[c.starts]]
                new = np.ones(len(key), bool)
                new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
                key, doc = key[new], doc[new]
                order = np.argsort(key, kind="stable")
                key, doc = key[order], doc[order]
                head = np.flatnonzero(np.diff(key, prepend=key[:1] + np.uint64(1))) if len(key) else np.zeros(0, np.int64)
                if len(head):
                    yield pa.RecordBatch.from_arrays([pa.array(key[head].view(np.int64)), pa.array(np.minimum.reduceat(doc, head)), pa.array(np.maximum.reduceat(doc, head))], names=["phrase", "lo", "hi"])

    return find


def located(c: Chunk, wanted: np.ndarray) -> np.ndarray:
    """The hash of a wanted phrase at every word where the automaton finds it, else the largest hash.

    The phrases at the words in ``wanted`` are compiled as text, with a space before, between and behind words.
    """
    out = np.full(c.n, _NONE)
    if not wanted.any():
        return out
    flat, begin = c.spaced()
    long = min(PHRASE_WORDS, c.window)
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for p in np.flatnonzero(wanted).tolist():
        automaton.add_word(" " + flat[begin[p] : begin[p + long]].tobytes().decode("latin-1"), 0)
    automaton.make_automaton()
    mine = np.unique(c.text[wanted])
    for a, z in zip(c.first[mine].tolist(), c.first[mine + 1].tolist()):
        stream = " " + flat[begin[a] : begin[z]].tobytes().decode("latin-1")
        ends = np.array([end for end, _ in automaton.iter(stream)], np.int64)
        at = np.searchsorted(begin, ends + begin[a], "left") - long  # a match ends with the space behind its last word
        out[at] = c.phrase[at]
    return out


def _runs(flag: np.ndarray, segment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of every run of flagged windows of one segment."""
    at = np.flatnonzero(flag)
    if not len(at):
        return at, at
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (segment[at[1:]] != segment[at[:-1]])
    return at[new], at[np.append(np.flatnonzero(new)[1:] - 1, len(at) - 1)]


def _decide(low: np.ndarray, high: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every window: whether a smaller id holds it too, and whether it is its smallest holder's."""
    order = np.lexsort((doc, high, low))
    lo, hi, d = low[order], high[order], doc[order]
    new = np.ones(len(lo), bool)
    new[1:] = (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])
    head = np.flatnonzero(new)
    later = np.empty(len(lo), bool)
    later[order] = d > np.repeat(d[head], np.diff(np.append(head, len(lo))))
    return later, ~later


def _packed(part, salt, ids, keys, starts, low, high, keep) -> Iterator[tuple]:
    """Kept windows as one row per (part, salt): segments of consecutive starts, and the hashes of their windows."""
    at = np.flatnonzero(keep)
    at = at[np.lexsort((starts[at], keys[at], ids[at], salt[at], part[at]))]
    if not len(at):
        return
    p, s, i, k, w = part[at], salt[at], ids[at], keys[at], starts[at]
    group = np.flatnonzero(np.concatenate([[True], (p[1:] != p[:-1]) | (s[1:] != s[:-1])]))
    new = np.concatenate([[True], (p[1:] != p[:-1]) | (s[1:] != s[:-1]) | (i[1:] != i[:-1]) | (k[1:] != k[:-1]) | (w[1:] != w[:-1] + 1)])
    head = np.flatnonzero(new)
    size = np.diff(np.append(head, len(at))).astype(np.int32)
    for a, z in zip(group.tolist(), [*group[1:].tolist(), len(at)]):
        seg = slice(np.searchsorted(head, a), np.searchsorted(head, z))
        h = head[seg]
        yield int(p[a]), int(s[a]), i[h].tobytes(), k[h].tobytes(), w[h].tobytes(), size[seg].tobytes(), low[at[a:z]].tobytes(), high[at[a:z]].tobytes()


def _locator(window: int, bitmap, bits: int, parts: int, hot: np.ndarray):
    """Rows of ranges that the chunk itself decides (part -1), and the packed smallest holders for the others."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, keys = b.column(0).to_numpy(), b.column(1).to_numpy()
            for lo, hi, buf, off in tb.chunks(b.column(2), CHUNK_BYTES):
                c = Chunk(buf, off, window)
                key = c.least(c.phrase)
                wanted = np.zeros(c.n, bool)
                asked = np.unique(key[cellfilter.holds(bitmap.value, key, bits)]) if len(key) else key
                if len(asked):
                    spot = np.minimum(np.searchsorted(asked, c.phrase), len(asked) - 1)
                    wanted = asked[spot] == c.phrase
                phrase = c.least(located(c, wanted))
                open_ = np.flatnonzero(phrase != _NONE)
                if not len(open_):
                    continue
                start = c.starts[open_]
                low, high = _window_hashes(c.hash, start, window)
                text = c.text[start]
                doc, key, at = ids[lo:hi][text], keys[lo:hi][text], start - c.first[text]
                phrase = phrase[open_]
                later, first = _decide(low, high, doc)
                yield _ranges(doc, key, at, text, later, window)
                part = (tb.mix(phrase) % np.uint64(parts)).astype(np.int32)
                salt = np.where(np.isin(phrase, hot), 1 + int(tb.mix(np.array([doc[0]]).astype(np.uint64))[0] % np.uint64(SALTS)), 0).astype(np.int32)
                yield _rows(_packed(part, salt, doc, key, at, low, high, first))

    return find


def _window_hashes(word: np.ndarray, start: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """64 and 32 bits of the words of each window, from running sums."""
    n = len(word)
    out = []
    for seed in (0x2545F4914F6CDD1D, 0x9E6C63D0876A9A63):
        up, down = np.full(n + 1, seed, np.uint64), np.full(n + 1, pow(seed, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        np.cumprod(up, out=up)
        np.cumprod(down, out=down)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(tb.mix(word ^ np.uint64(seed)) * up[:n], out=total[1:])
        out.append(tb.mix((total[start + window] - total[start]) * down[start]))
    return out[0], (out[1] >> np.uint64(32)).astype(np.uint32)


_PACK = pa.schema([("part", pa.int32()), ("salt", pa.int32()), *[(n, pa.binary()) for n in ("ids", "keys", "starts", "sizes", "low", "high")]])
_BOTH = pa.schema([*_PACK, ("doc", pa.int64()), ("text_key", pa.int64()), ("start", pa.int64()), ("stop", pa.int64())])
BOTH = f"{PACK}, {RANGES}"


def _ranges(doc, key, at, text, later, window) -> pa.RecordBatch:
    """Removed word ranges of the windows in ``later``; windows are in order of text and start."""
    segment = np.cumsum(np.concatenate([[False], (text[1:] != text[:-1]) | (at[1:] != at[:-1] + 1)]))
    a, z = _runs(later, segment)
    n = len(a)
    none = [pa.nulls(n, f.type) for f in _PACK][1:]
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, -1, np.int32)), *none, pa.array(doc[a]), pa.array(key[a]), pa.array(at[a]), pa.array(at[z] + window)], schema=_BOTH)


def _rows(packed: Iterator[tuple]) -> pa.RecordBatch:
    cols = list(zip(*packed)) or [[]] * len(_PACK)
    arrays = [pa.array(list(c), f.type) for c, f in zip(cols, _PACK)]
    return pa.RecordBatch.from_arrays([*arrays, *[pa.nulls(len(arrays[0]), pa.int64())] * 4], schema=_BOTH)


def _judge(window: int, level: int):
    """Compares the holders of one group; the first level sends the smallest on, under no salt."""

    def work(group: pa.Table) -> pa.Table:
        join = lambda name, kind: np.frombuffer(b"".join(group[name].to_pylist()), kind)
        size = join("sizes", np.int32)
        seg = np.repeat(np.arange(len(size)), size)
        doc, key = join("ids", np.int64)[seg], join("keys", np.int64)[seg]
        at = join("starts", np.int64)[seg] + np.arange(len(seg)) - np.repeat(np.cumsum(size) - size, size)
        low, high = join("low", np.uint64), join("high", np.uint32)
        later, first = _decide(low, high, doc)
        out = [_ranges(doc, key, at, seg, later, window)]
        if level == 1:
            part = np.full(len(seg), group["part"][0].as_py(), np.int32)
            out.append(_rows(_packed(part, np.zeros_like(part), doc, key, at, low, high, first)))
        return pa.Table.from_batches(out)

    return work


def removed_ranges(docs: DataFrame, window: int, bits: int = FILTER_BITS) -> DataFrame:
    """``doc, text_key, start, stop``: word ranges to remove of ``doc, text_key, text`` rows."""
    spark = docs.sparkSession
    seen = docs.mapInArrow(_phrases(window), "phrase long, lo long, hi long").groupBy("phrase").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.count("*").alias("rows"))
    repeated = staged(seen.filter("lo < hi").select("phrase", "rows"), "phrases")
    many, rows = repeated.agg(F.count("*"), F.sum("rows")).first()
    bitmap = spark.sparkContext.broadcast(cellfilter.collected_bits(repeated, F.col("phrase"), bits))
    hot = np.array([r[0] for r in repeated.filter(F.col("rows") > max(HOT_ROWS, (rows or 0) // HOT_SHARES)).select("phrase").collect()], np.int64).view(np.uint64)
    found = staged(docs.mapInArrow(_locator(window, bitmap, bits, max(1, -(-(many or 0) // PART_PHRASES) * 8), hot), BOTH), "holders")
    packs = [c.split()[0] for c in PACK.split(", ")]
    ranges = [c.split()[0] for c in RANGES.split(", ")]
    salted = found.filter("salt > 0").select(*packs).groupBy("part", "salt").applyInArrow(_judge(window, 1), BOTH)
    salted = staged(salted, "salted")
    open_ = found.filter("salt = 0").select(*packs).unionByName(salted.filter("salt = 0").select(*packs))
    last = open_.groupBy("part").applyInArrow(_judge(window, 2), BOTH)
    decided = found.filter("part = -1").select(*ranges).unionByName(salted.filter("part = -1").select(*ranges))
    return decided.unionByName(last.select(*ranges))


RESULT = "doc_id long, n_words long, n_removed long, kept_text string, kept_sha256 string"


def _remover(window: int, with_text: bool):
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, buf, off in tb.chunks(b.column(1), CHUNK_BYTES):
                c = Chunk(buf, off, window)
                step = np.zeros(c.n + 1, np.int64)
                lists = b.column(2).slice(lo, hi - lo)
                pairs = lists.flatten()
                if len(pairs):
                    sizes = np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
                    base = np.repeat(c.first[:-1], sizes)
                    np.add.at(step, base + pairs.field("start").to_numpy(), 1)
                    np.add.at(step, base + pairs.field("stop").to_numpy(), -1)
                gone = np.cumsum(step)[: c.n] > 0
                flat, begin = c.spaced()
                kept = flat[np.repeat(~gone, np.diff(begin))]
                ends = np.zeros(c.n + 1, np.int64)
                np.cumsum(np.where(gone, 0, np.diff(begin)), out=ends[1:])
                texts = [kept[a : max(a, z - 1)].tobytes() for a, z in zip(ends[c.first[:-1]].tolist(), ends[c.first[1:]].tolist())]
                total = np.zeros(c.n + 1, np.int64)
                np.cumsum(gone, out=total[1:])
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, hi - lo), pa.array(np.diff(c.first)), pa.array(total[c.first[1:]] - total[c.first[:-1]]),
                     pa.array([t.decode() for t in texts], pa.string()) if with_text else pa.nulls(hi - lo, pa.string()), pa.array([hashlib.sha256(t).hexdigest() for t in texts])],
                    names=["doc_id", "n_words", "n_removed", "kept_text", "kept_sha256"],
                )

    return apply


def without_repeats(docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True, bits: int = FILTER_BITS) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_text, kept_sha256`` of every document; kept words are joined by one space."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc"), F.xxhash64(F.col(f"`{text_col}`").cast("string")).alias("text_key"), F.col(f"`{text_col}`").cast("string").alias("text"))
    ranges = removed_ranges(rows.filter("doc IS NOT NULL"), window, bits)
    lists = staged(ranges, "ranges").groupBy("doc", "text_key").agg(F.collect_list(F.struct("start", "stop")).alias("ranges"))
    named = rows.filter("doc IS NOT NULL").join(lists, ["doc", "text_key"], "left").select("doc", "text", "ranges")
    nameless = rows.filter("doc IS NULL").select("doc", "text", F.lit(None).cast("array<struct<start:bigint,stop:bigint>>").alias("ranges"))
    return named.unionByName(nameless).mapInArrow(_remover(window, with_text), RESULT)
