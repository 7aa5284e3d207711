"""Collocations of two to four words by stripes.

A prefix of 0 to 3 words keys a stripe: the associative counter of the words that follow it, with one slot for occurrences that no
counted word follows. Tasks build stripes for a chunk of texts, Spark merges them element by element. The one structure gives
the extensions (a phrase's count is its slot in the stripe of its prefix), the prefix totals (a stripe's sum is the prefix's count,
which the scores divide by) and the subsumption maxima (a phrase inside a longer one is that one's prefix or its last words).

Stripes are built by prefix length. A phrase of the next length can only be frequent if both its parts without the first and
without the last word are, so texts are read once per length and hold their words against a bitmap of the frequent phrases. The
bitmap has ``2 ** FILTER_BITS`` bits at any size of the input; where it is too full it lets rare phrases through, which the counts
then remove: it never loses one. Counting is on the words themselves, not on hashes.

A stripe that may hold many rows (the root, and prefixes with more than 1 / HOT_SHARES of all words) is cut into segments by the
hash of the next word. Merging needs one shuffle per length: stripes move, their elements are summed where they arrive.

Defined results: null texts have no words; a null language is ``und``, as is a language of that name; repeated rows count again;
words and whole texts have any length; without candidates the result is empty. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window as W

from tideline.llm import cellfilter, textbatch as tb
from tideline.llm.frames import staged

LONGEST = 4
FILTER_BITS = 25
ROOT_SEGMENTS = 1024
HOT_SHARES = 4096
CHUNK_BYTES = 6 << 20
RANK_BUCKETS = 256

BREAK = tb.flags(b".,;:!?\n\x0b\x0c\r")
GAP = BREAK | tb.flags(b" \t")
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: A stripe as it moves: its words and their counts, space-joined in one order; the slot without a word comes first, as an empty word.
STRIPE = "lang string, prefix string, seg int, nexts string, counts string"


def _spans(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    buf, off = tb.column_bytes(column)
    return buf, off[:-1], off[1:]


def _start(langs: pa.Array) -> np.ndarray:
    """Hash of the empty phrase of each language."""
    return tb.mix(tb.hashes(*_spans(langs), tb.EXACT))


def _step(value: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of a phrase from that of its prefix and that of its last word."""
    return tb.mix(value * np.uint64(tb._BASE) + word)


def phrase_hashes(langs: pa.Array, phrases: pa.Array) -> np.ndarray:
    """Hashes of space-joined phrases, as the stripes hash them."""
    buf, off = tb.column_bytes(phrases)
    s, e = tb.runs(buf != 32, off)
    word, first = tb.hashes(buf, s, e, tb.EXACT), tb.bounds(off, s)
    value, many = _start(langs), np.diff(first)
    for k in range(int(many.max(initial=0))):
        rows = np.flatnonzero(many > k)
        value[rows] = _step(value[rows], word[first[rows] + k])
    return value


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        value = phrase_hashes(b.column(0), b.column(1)).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(value), b.column(2)], names=["hash", "f"])


class Words:
    """The words of a chunk of texts: codes in a vocabulary, hashes, languages and pieces."""

    def __init__(self, buf: np.ndarray, off: np.ndarray, langs: pa.Array):
        inside = GAP[buf] == 0
        s, e = tb.runs(inside, off)
        ends = np.zeros(len(s) + 1, np.int64)
        np.cumsum(e - s, out=ends[1:])
        words = pa.LargeStringArray.from_buffers(len(s), pa.py_buffer(ends), pa.py_buffer(LOWER[buf[inside]]))
        coded = words.dictionary_encode()
        self.vocab, self.code = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
        self.hash = tb.hashes(*_spans(self.vocab), tb.EXACT) if len(self.vocab) else np.zeros(0, np.uint64)
        text = tb.owner(off, s)
        breaks = np.zeros(len(buf) + 1, np.int64)
        np.cumsum(BREAK[buf], out=breaks[1:])
        self.piece = (breaks[s] + text).astype(np.int32)
        named = langs.dictionary_encode()
        self.langs, self.lang = named.dictionary, named.indices.to_numpy().astype(np.int64)[text]
        self.n = len(s)

    def phrases(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the phrase of that size at every word, and whether it lies in one piece."""
        many = max(self.n - max(size, 1) + 1, 0)
        value = _start(self.langs)[self.lang[:many]]
        for k in range(size):
            value = _step(value, self.hash[self.code[k : k + many]])
        whole = self.piece[:many] == self.piece[size - 1 :][:many] if size else np.ones(many, bool)
        return value, whole


def stripes_of(words: Words, size: int, bitmap: np.ndarray | None, bits: int, hot: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
    """The stripes of one chunk for prefixes of that many words."""
    value, fine = words.phrases(size)
    if size:
        fine &= cellfilter.holds(bitmap, value, bits)
    at = np.flatnonzero(fine)
    follows = np.zeros(len(at), bool)
    if size:
        near = at + 1 < len(fine)
        follows[near] = fine[at[near] + 1] & (words.piece[np.minimum(at[near] + size, words.n - 1)] == words.piece[at[near]])
    else:
        follows[:] = True
    following = np.where(follows, words.code[np.minimum(at + size, words.n - 1)] + 1, 0)

    vocab = len(words.vocab) + 1
    prefix = words.lang[at]
    for k in range(size):
        _, prefix = np.unique(prefix * vocab + words.code[at + k], return_inverse=True)
    known, where, prefix = np.unique(prefix, return_index=True, return_inverse=True)
    pairs, count = np.unique(prefix * vocab + following, return_counts=True)
    owner, following = pairs // vocab, pairs % vocab
    if size:
        many = np.ones(len(known), np.int64)
        if len(hot[0]):
            mine = value[at[where]]
            spot = np.minimum(np.searchsorted(hot[0], mine), len(hot[0]) - 1)
            many = np.where(hot[0][spot] == mine, hot[1][spot], 1)
    else:
        many = np.full(len(known), ROOT_SEGMENTS, np.int64)
    seg = np.where(following > 0, (words.hash[following - 1] % many[owner].astype(np.uint64)).astype(np.int64), 0)
    order = np.lexsort((seg, owner))
    owner, seg, following, count = owner[order], seg[order], following[order], count[order]
    head = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (seg[1:] != seg[:-1])])) if len(owner) else np.zeros(0, np.int64)

    place = at[where[owner[head]]]
    parts = [words.vocab.take(pa.array(words.code[place + k])).cast(pa.string()) for k in range(size)]
    text = pc.binary_join_element_wise(*parts, " ") if size else pa.array([""] * len(head), pa.string())
    offsets = pa.array(np.append(head, len(owner)), pa.int32())
    names = pa.concat_arrays([pa.array([""], pa.large_string()), words.vocab]).take(pa.array(following)).cast(pa.string())
    lang = words.langs.take(pa.array(words.lang[place])).cast(pa.string())
    joined = [pc.binary_join(pa.ListArray.from_arrays(offsets, v), " ") for v in (names, pa.array(count).cast(pa.string()))]
    arrays = [lang, text, pa.array(seg[head], pa.int32()), *joined]
    return pa.RecordBatch.from_arrays(arrays, names=["lang", "prefix", "seg", "nexts", "counts"])


def _builder(size: int, bitmap, bits: int, hot):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, buf, off in tb.chunks(b.column(1), CHUNK_BYTES):
                words = Words(buf, off, b.column(0).slice(lo, hi - lo))
                if words.n:
                    yield stripes_of(words, size, None if bitmap is None else bitmap.value, bits, hot)

    return build


def merged(stripes: DataFrame, least: int) -> DataFrame:
    """Stripes summed element by element, ``lang, prefix, seg, next, a``; elements below ``least`` join the slot without a word."""
    each_slot = F.inline(F.arrays_zip(F.split("nexts", " ").alias("next"), F.split("counts", " ").alias("many")))
    here = stripes.repartition("lang", "prefix", "seg").select("lang", "prefix", "seg", each_slot)
    key = ["lang", "prefix", "seg"]
    each = here.groupBy(*key, "next").agg(F.sum(F.col("many").cast("long")).alias("a"))
    return each.groupBy(*key, F.when(F.col("a") >= least, F.col("next")).otherwise("").alias("next")).agg(F.sum("a").alias("a"))


def stripe_levels(texts: DataFrame, least: int, longest: int = LONGEST, bits: int = FILTER_BITS) -> list[DataFrame]:
    """The merged stripes of ``lang, text`` rows for prefixes of 0, 1, ... words, each a written table."""
    spark, levels, bitmap, hot = texts.sparkSession, [], None, (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    share = 1
    for size in range(longest):
        built = texts.mapInArrow(_builder(size, bitmap, bits, hot), STRIPE)
        levels.append(staged(merged(built, least), f"stripes-{size}"))
        if size == 0:
            share = max(1, (levels[0].agg(F.sum("a")).first()[0] or 0) // HOT_SHARES)
        if size + 1 < longest:
            frequent = extensions(levels[size]).select("lang", "phrase", "a").mapInArrow(_hashed, "hash long, f long")
            bitmap = spark.sparkContext.broadcast(cellfilter.collected_bits(frequent, F.col("hash"), bits))
            many = sorted((r["hash"] & (2**64 - 1), min(HOT_SHARES, r["f"] // share + 1)) for r in frequent.filter(F.col("f") > share).collect())
            hot = np.array([h for h, _ in many], np.uint64), np.array([m for _, m in many], np.int64)
    return levels


def extensions(level: DataFrame) -> DataFrame:
    """``lang, phrase, a, head``: every frequent phrase of a level and its prefix."""
    phrase = F.when(F.col("prefix") == "", F.col("next")).otherwise(F.concat_ws(" ", "prefix", "next"))
    return level.filter("next <> ''").select("lang", phrase.alias("phrase"), "a", F.col("prefix").alias("head"))


def totals(level: DataFrame) -> DataFrame:
    """``lang, part, f``: the sum of every stripe, which is its prefix's count."""
    return level.groupBy("lang", F.col("prefix").alias("part")).agg(F.sum("a").alias("f"))


def subsumption(levels: list[DataFrame]) -> DataFrame:
    """``lang, phrase, longer``: the largest count of a candidate that is one word longer at either end."""
    rows = None
    for level in levels:
        found = extensions(level)
        tail = F.expr("substring(phrase, instr(phrase, ' ') + 1)")
        both = found.select("lang", F.col("head").alias("phrase"), "a").unionByName(found.select("lang", tail.alias("phrase"), "a"))
        rows = both if rows is None else rows.unionByName(both)
    return rows.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))


def _counted(parts: DataFrame, known: DataFrame, words: int) -> DataFrame:
    """The parts with their counts; parts with a large share of all words, at most HOT_SHARES per length, are looked up by broadcast."""
    common = known.filter(F.col("f") > max(1, words // HOT_SHARES))
    easy = parts.join(F.broadcast(common), ["lang", "part"])
    rest = parts.join(F.broadcast(common.select("lang", "part")), ["lang", "part"], "left_anti").join(known, ["lang", "part"])
    return easy.unionByName(rest)


def collocations(docs: DataFrame, least: int = 30, top: int = 2000, subsumed: tuple[int, int] = (80, 100), scale: int = 2_000_000, bits: int = FILTER_BITS, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score`` of each language's best phrases.

    A phrase cut after ``k`` words scores ``floor(scale * a / (l + r))``; its weakest cut counts. A phrase is dropped when a longer
    candidate around it keeps ``subsumed`` of its count; as counts only fall with length, one word more at either end decides.
    """
    texts = docs.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"), F.col(f"`{text_col}`").cast("string").alias("text"))
    levels = stripe_levels(texts, least, bits=bits)
    sums = levels[0].groupBy("lang").agg(F.sum("a").alias("n"))
    words = levels[0].agg(F.sum("a")).first()[0] or 0
    found, known = None, None
    for level in levels[1:]:
        found = extensions(level) if found is None else found.unionByName(extensions(level))
        known = totals(level) if known is None else known.unionByName(totals(level))

    cuts = found.select("lang", "phrase", "a", F.split("phrase", " ").alias("w")).select("*", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"))
    sides = F.array(F.struct(F.lit(True).alias("left"), F.expr("array_join(slice(w, 1, k), ' ')").alias("part")), F.struct(F.lit(False).alias("left"), F.expr("array_join(slice(w, k + 1, size(w)), ' ')").alias("part")))
    parts = cuts.select("lang", "phrase", "a", "k", F.inline(sides))
    both = _counted(parts, staged(known, "totals"), words).groupBy("lang", "phrase", "a", "k").agg(F.max(F.when(F.col("left"), F.col("f"))).alias("l"), F.max(F.when(~F.col("left"), F.col("f"))).alias("r"))
    score = F.expr(f"(CAST(a AS DECIMAL(20, 0)) * {scale}BD) div CAST(l + r AS DECIMAL(20, 0))")
    cut = both.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))

    part, whole = subsumed
    scored = cut.join(subsumption(levels[2:]), ["lang", "phrase"], "left").filter(f"longer IS NULL OR {whole} * longer < {part} * a").select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    best = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    bucket = F.pmod(F.xxhash64("phrase"), F.lit(RANK_BUCKETS))
    some = scored.withColumn("_b", bucket).withColumn("_r", F.row_number().over(W.partitionBy("lang", "_b").orderBy(*best))).filter(F.col("_r") <= top)
    ranked = some.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*best))).filter(F.col("rank") <= top)
    return ranked.join(F.broadcast(sums), "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
