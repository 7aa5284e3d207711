"""Collocations, repeated passages and the conversation trie against plain Python."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from llm.conftest import WORD, collected, frame, odd_rows
from tideline.llm import cellfilter, collocations, prefix_trie, repeated_phrases

# --- collocations -----------------------------------------------------------------------------------------------------


def plain_collocations(rows, least, top):
    """Counts of all phrases, then scores, subsumption and ranks straight from the definition."""
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in (text or ""))
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f[lang].update(tuple(w[i : i + m]) for m in range(1, 5) for i in range(len(w) - m + 1))
    out = []
    for lang, c in f.items():
        held = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        gone = {q[i : i + m] for q, b in held.items() for m in range(2, len(q)) for i in range(len(q) - m + 1) if 100 * b >= 80 * held[q[i : i + m]]}
        best = []
        for p, a in held.items():
            if p not in gone:
                score, k = min((2_000_000 * a // (c[p[:k]] + c[p[k:]]), k) for k in range(1, len(p)))
                best.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, i, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(best)[:top], 1)]
    return sorted(out)


def prose(many, seed):
    """Texts of few words, so that phrases of every length repeat; one word makes up a third."""
    rng, words = random.Random(seed), ["The", "cat", "sat", "on", "É", "mat", "日本", "x-1", "a\x1cb"]
    return " ".join(rng.choice(words) if rng.random() < 0.6 else "the" + rng.choice(["", "", ".", ",", "\n", "\t"]) for _ in range(many))


@pytest.mark.parametrize("bits, shares, chunk", [(25, 4096, 8 << 20), (6, 5, 500)])
def test_collocations_equal_plain_counts(spark, monkeypatch, bits, shares, chunk):
    """Also where the bitmap lets nearly all through, stripes are cut into segments, and chunks hold single texts."""
    monkeypatch.setattr(collocations, "HOT_SHARES", shares)
    monkeypatch.setattr(collocations, "CHUNK_BYTES", chunk)
    rows = [(i, prose(200, i), ["en", "de", None, "und"][i % 4], "s", 1) for i in range(24)] + odd_rows()
    got = sorted(tuple(r) for r in collocations.collocations(frame(spark, rows).repartition(3), least=4, top=40, bits=bits).collect())
    assert got == plain_collocations([(r[2], r[1]) for r in rows], 4, 40) and len(got) > 60


def test_collocations_of_odd_rows(odd, spark):
    got = sorted(tuple(r) for r in collocations.collocations(odd, least=2, top=2000).collect())
    assert got == (plain_collocations([(r[2], r[1]) for r in odd_rows()], 2, 2000) if got or odd.count() else [])


def test_stripe_sums_are_prefix_counts(spark):
    """The one structure: a stripe's sum is the slot of its prefix in the stripe one word shorter."""
    docs = spark.createDataFrame([("en", prose(400, i)) for i in range(6)], "lang string, text string")
    levels = collocations.stripe_levels(docs, 5)
    for low, high in zip(levels, levels[1:]):
        slots = {(r["lang"], r["phrase"]): r["a"] for r in collocations.extensions(low).collect()}
        sums = {(r["lang"], r["part"]): r["f"] for r in collocations.totals(high).collect()}
        assert {k: v for k, v in sums.items() if k in slots} == slots


def test_scores_pass_64_bits(spark):
    rows = spark.createDataFrame([(9_000_000_000_000_000_000, 2)], "a long, k long").selectExpr("(CAST(a AS DECIMAL(20, 0)) * 2000000BD) div CAST(a AS DECIMAL(20, 0)) AS s")
    assert rows.first()["s"] == 2_000_000


# --- repeated passages ------------------------------------------------------------------------------------------------


def plain_removal(rows, window):
    first, out = {}, []
    split = [(r[0], WORD.findall(r[1] or "")) for r in rows]
    for i, w in split:
        for k in range(len(w) - window + 1 if i is not None else 0):
            key = tuple(w[k : k + window])
            first[key] = min(first.get(key, i), i)
    for i, w in split:
        gone = set()
        for k in range(len(w) - window + 1 if i is not None else 0):
            if first[tuple(w[k : k + window])] < i:
                gone.update(range(k, k + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), kept, hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def planted(window):
    """A passage in a third of all documents, shared edges, copies, chains of overlaps, and repeats inside one document."""
    rng = random.Random(3)
    some = lambda n: [f"w{rng.randrange(10**6)}é" for _ in range(n)]
    hot, a, b, loop = some(window + 7), some(3 * window), some(3 * window), some(window // 2)
    rows = [(i, some(rng.randrange(2 * window)) + hot + some(rng.randrange(window))) for i in range(100, 130)]
    rows += [(1, a), (2, a[5:] + b[:-5]), (3, b), (4, a + b), (5, a), (6, a[: window - 1]), (7, a[:window]), (8, loop * 9), (9, loop * 5 + a[7 : 7 + window]), (-4, b[3:]), (None, a)]
    rows += [(k, some(rng.randrange(3 * window))) for k in range(200, 230)]
    return [(i, rng.choice([" ", "\n", " \t"]).join(w), "en", "s", 1) for i, w in rows]


@pytest.mark.parametrize("window, bits, chunk, hot", [(50, 26, 8 << 20, False), (50, 8, 2000, True), (12, 26, 3000, True), (4, 12, 900, False)])
def test_removal_equals_plain_windows(spark, monkeypatch, window, bits, chunk, hot):
    """Also with a full bitmap, chunks of few texts, and phrases that are compared in groups first."""
    monkeypatch.setattr(repeated_phrases, "CHUNK_BYTES", chunk)
    if hot:
        monkeypatch.setattr(repeated_phrases, "HOT_SHARES", 1_000_000)
        monkeypatch.setattr(repeated_phrases, "HOT_ROWS", 2)
    rows = planted(window) + odd_rows()
    got = sorted((tuple(r) for r in repeated_phrases.without_repeats(frame(spark, rows).repartition(3), window=window, bits=bits).collect()), key=str)
    assert got == plain_removal(rows, window) and sum(r[2] for r in got) > 10 * window


def test_removal_of_odd_rows(odd):
    got = sorted((tuple(r) for r in repeated_phrases.without_repeats(odd, window=50).collect()), key=str)
    assert got == (plain_removal(odd_rows(), 50) if got or odd.count() else [])


def test_bitmap_holds_what_went_in(spark):
    import numpy as np
    from pyspark.sql import functions as F

    rows = spark.range(1000).select(F.xxhash64("id").alias("h"))
    bits = cellfilter.collected_bits(rows, F.col("h"), 18)
    inside = np.array([r["h"] for r in rows.collect()], np.int64)
    outside = np.array([r["h"] for r in spark.range(5000, 15000).select(F.xxhash64("id").alias("h")).collect()], np.int64)
    assert cellfilter.holds(bits, inside, 18).all() and cellfilter.holds(bits, outside, 18).mean() < 0.01


# --- conversation trie ------------------------------------------------------------------------------------------------


def plain_trie(rows):
    turns = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            key = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest()
            turns[c].append(((t is not None, t or 0, key), (role, text)))
    turns = {c: [x for _, x in sorted(v)] for c, v in turns.items()}
    path, nodes, kids = {}, defaultdict(list), Counter()
    for c, v in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        path[c] = tuple(turns.get(c - c % 5, [])[:h] + v[h:])
        for d in range(len(path[c]) + 1):
            nodes[path[c][:d]].append(c)
    kids.update(p[:-1] for p in nodes if p)
    leaves, saved = Counter(), Counter()
    for p, m in nodes.items():
        for d in range(len(p) + 1):
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1].encode()) if p else 0
            leaves[p[:d]] += not kids[p]
    ends = {p: ",".join(map(str, sorted(c for c in m if len(path[c]) == len(p)))) for p, m in nodes.items()}
    return sorted(((min(m), len(p), min(nodes[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p], hashlib.sha256(ends[p].encode()).hexdigest()) for p, m in nodes.items()), key=str)


CONV = "conv_id long, turn long, role string, text string"


def talks():
    """A common first turn, one conversation that a third of all ids repeat, nulls, ties, repeated rows and a very long one."""
    rng, rows = random.Random(5), []
    for c in range(-20, 120):
        say = ["hi", "yes", "né", "", None, "no " * 40]
        many = 3 if c % 3 == 0 else rng.randrange(7)
        rows += [(c, t, ["user", "bot", None][t % 3], "same" if c % 3 == 0 else "start" if t == 0 else rng.choice(say)) for t in range(many)]
    rows += [(7, None, "user", "before"), (7, 1, "user", "tie"), (7, 1, "bot", "tie"), (7, 1, "bot", "tie"), (None, 0, "user", "nobody"), (300, 5, "a", "x" * 100_000)]
    rows += [(500, t, "user", f"turn {t}") for t in range(300)] + [(505, t, "user", f"turn {t % 250}") for t in range(300)]
    return rows


@pytest.mark.parametrize("shard_turns", [20_000, 60, 3])
def test_trie_equals_plain_trie(spark, monkeypatch, shard_turns):
    """With one shard, with some, and with nearly every node in the skeleton."""
    monkeypatch.setattr(prefix_trie, "SHARD_TURNS", shard_turns)
    rows = talks()
    df = spark.createDataFrame(rows, CONV).selectExpr("*", "1 AS depth", "'x' AS path", "2 AS shard").repartition(3)
    assert sorted((tuple(r) for r in prefix_trie.conversation_trie(df).collect()), key=str) == plain_trie(rows)


def test_trie_of_nothing_and_of_turnless(spark):
    assert collected(prefix_trie.conversation_trie(spark.createDataFrame([], CONV))) == []
    lone = next(c for c in range(1, 999) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 1)
    only = [(lone, 0, "user", "gone")]
    assert [tuple(r) for r in prefix_trie.conversation_trie(spark.createDataFrame(only, CONV)).collect()] == plain_trie(only)
    assert plain_trie(only)[0][1:6] == (0, None, 1, 0, 1)


def test_skeleton_holds_every_node_in_two_shards():
    key = lambda s: b"".join(hashlib.md5(x.encode()).digest() for x in s)
    paths = sorted({key("abc"[: k % 4] + "de" * (k % 3)) for k in range(40)})
    borders = [(paths[len(paths) // 3], 4), (paths[2 * len(paths) // 3], 1)]
    found = prefix_trie.skeleton_of(borders)
    rows = [(p, i) for p in paths for i in range(6)]
    where = {r: sum(b <= r for b in borders) for r in rows}
    for d in range(8):
        shards = defaultdict(set)
        for r in rows:
            if len(r[0]) >= 16 * d:
                shards[r[0][: 16 * d]].add(where[r])
        assert all(p in found for p, s in shards.items() if len(s) > 1)
