import numpy as np
import pytest
from pyspark.sql import functions as F

from llm.conftest import PROSE, WORD, collected, frame, odd_rows
from tideline.llm import multi_index, ngram_join
from tideline.llm.components import components

# --- multi-index ------------------------------------------------------------------------------------------------------


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def exact(rows, every, top):
    good = {}
    for i, v, _ in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good[i] = max(good.get(i, []), [float(np.float32(x)) for x in v])
    ids = sorted(good)
    x = np.array([good[i] for i in ids])
    out = {}
    for q in ids:
        if q % every == 0:
            s = (x * np.array(good[q])).sum(1)
            order = [k for k in sorted(range(len(ids)), key=lambda k: (-s[k], ids[k])) if ids[k] != q][:top]
            out[q] = [(ids[k], s[k]) for k in order]
    return out


def clustered(n, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, 16))
    return [(i, [float(x) for x in (centres[i % 12] + 0.4 * rng.normal(size=16)).astype(np.float32)], 0) for i in range(n)]


def test_recall_against_brute_force(spark):
    rows = clustered(1500)
    want = exact(rows, 20, 20)
    got = {}
    for r in collected(multi_index.nearest_rows(vectors(spark, rows), 20, 20, words=16, probe=0.35)):
        got.setdefault(r["query_id"], []).append(r)
    assert got.keys() == want.keys()
    for q, mine in got.items():
        mine.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, 21)) and q not in {r["vec_id"] for r in mine}
    hits = sum(len({r["vec_id"] for r in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 20 * len(want)


def test_all_cells_give_the_exact_answer_with_ties(spark):
    rows = clustered(400)
    rows += [(1000 + i, rows[7][1], 0) for i in range(60)]  # more ties than places
    rows += [(5000, None, 0), (5020, [0.0] * 16, 0), (5040, [float("nan")] * 16, 0), (5060, [None] + [1.0] * 15, 0), (5080, [float("inf")] * 16, 0), (5100, [], 0), (None, rows[1][1], 0), (20, rows[20][1], 0)]
    got = collected(multi_index.nearest_rows(vectors(spark, rows).withColumn("id", F.lit("clash")), 20, 20, words=8, probe=1.0))
    want = exact([r for r in rows if r[1] != []], 20, 20)
    assert len(got) == 20 * len(want)
    for r in got:
        i, score = want[r["query_id"]][r["rank"] - 1]
        assert r["vec_id"] == i and r["score"] == pytest.approx(score, abs=1e-12)


def test_recall_of_the_registered_query(spark, sf):
    """Production parameters on the given vectors; larger tables are in the README."""
    rows = [(r["vec_id"], r["embedding"], 0) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want = exact(rows, 20, 20)
    got = {}
    for r in collected(multi_index.nearest_rows(vectors(spark, rows), every=20, top=20)):
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    assert got.keys() == want.keys()
    hits = sum(len(got[q] & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * sum(len(v) for v in want.values())


def test_every_block_meets_all_its_queries(spark, monkeypatch):
    # many more queries than rows of a block, and batches that end inside blocks and between rows and queries
    rows = clustered(500, 3)
    monkeypatch.setattr(multi_index, "ROWS_PER_BLOCK", 20)
    monkeypatch.setattr(multi_index, "MOST_PER_BLOCK", 20)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = collected(multi_index.nearest_rows(vectors(spark, rows), 1, 3, words=6, probe=1.0))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = exact(rows, 1, 3)
    assert {(r["query_id"], r["rank"]): r["vec_id"] for r in got} == {(q, k + 1): i for q, best in want.items() for k, (i, _) in enumerate(best)}


def test_few_rows_and_none(spark):
    few = [(20 * i, [1.0, float(i)], 0) for i in range(4)] + [(7, [1.0, 2.0, 3.0], 0)]
    got = collected(multi_index.nearest_rows(vectors(spark, few), 20, 20))
    assert len(got) == 4 * 3
    assert multi_index.nearest_rows(vectors(spark, []), 20, 20).count() == 0


def test_blocks_change_nothing(spark, monkeypatch):
    rows = clustered(600)
    whole = sorted(map(str, collected(multi_index.nearest_rows(vectors(spark, rows), 20, 5, words=8, probe=1.0))))
    monkeypatch.setattr(multi_index, "ROWS_PER_BLOCK", 37)
    monkeypatch.setattr(multi_index, "QUERIES_PER_BLOCK", 5)
    assert sorted(map(str, collected(multi_index.nearest_rows(vectors(spark, rows), 20, 5, words=8, probe=1.0)))) == whole


def test_walk_takes_cells_by_falling_sum():
    rng = np.random.default_rng(4)
    a, b, sizes = rng.normal(size=9), rng.normal(size=7), rng.integers(0, 4, (9, 7))
    cells = multi_index.walk(a, b, sizes, 10**9)
    assert sorted(cells) == sorted((int(i), int(j)) for i, j in np.argwhere(sizes > 0))
    sums = [a[i] + b[j] for i, j in cells]
    assert sums == sorted(sums, reverse=True)
    some = multi_index.walk(a, b, sizes, 20)
    assert some == cells[: len(some)] and sum(sizes[c] for c in some) >= 20 > sum(sizes[c] for c in some[:-1])


# --- n-gram join ------------------------------------------------------------------------------------------------------

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def plain_components(rows):
    """By all pairs; ids of copies are gathered first."""
    sets = [(r["doc_id"], shingles(r["text"])) for r in rows]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and 5 * min(len(a), len(b)) >= 4 * max(len(a), len(b)) and 100 * len(a & b) >= 80 * len(a | b):
                parent[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(sets):
        if doc is not None:
            least[find(i)] = min(least.get(find(i), doc), doc)
    return sorted(str((doc, len(s), least.get(find(i)) if s else doc)) for i, (doc, s) in enumerate(sets))


def check_join(docs):
    got = collected(ngram_join.jaccard_components(docs))
    assert sorted(str((g["doc_id"], g["n_shingles"], g["component_id"])) for g in got) == plain_components(docs.collect())


def test_join_of_odd_rows(spark, odd):
    check_join(odd)


def near_copies(n, words=60, seed=0, edits=4):
    """Texts around one original: pairs lie on both sides of the threshold."""
    rng = np.random.default_rng(seed)
    base = [f"w{k}" for k in rng.integers(0, 10_000, words)]
    out = []
    for _ in range(n):
        mine = list(base)
        for _ in range(int(rng.integers(0, edits))):
            at = int(rng.integers(0, len(mine)))
            mine[at : at + 1] = [[], [f"e{rng.integers(0, 9999)}"], [mine[at], "extra"]][int(rng.integers(0, 3))]
        out.append(" ".join(mine))
    return out


def corpus(seed=0):
    rng = np.random.default_rng(seed)
    passage = " ".join(f"p{k}" for k in range(60))
    texts = near_copies(60, 60, seed) + near_copies(40, 25, seed + 1, 3) + near_copies(30, 200, seed + 2, 30) + near_copies(20, 7, seed + 3, 2)
    texts += [" ".join(f"r{k}" for k in rng.integers(0, 50_000, 80)) + " " + passage for _ in range(60)]  # one passage, else unlike
    texts += [passage + f" tail{k % 9}" for k in range(30)]
    texts += [" ".join(f"s{k}" for k in rng.integers(0, 5, int(n))) for n in rng.integers(1, 9, 40)]
    return [(int(i) * 3 + 1, t, "en", "a", 0) for i, t in zip(rng.permutation(len(texts)), texts)]


@pytest.mark.parametrize("seed", [0, 7])
def test_join_equals_all_pairs(spark, seed):
    check_join(frame(spark, corpus(seed)))


def test_second_round_alone_is_whole(spark, monkeypatch):
    # tiny blocks: the first round loses pairs across cuts, and every hot shingle is cut into pairs of blocks
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    monkeypatch.setattr(ngram_join, "BRIDGES", 0)
    check_join(frame(spark, corpus(3)))


def test_large_families_are_bridged(spark, monkeypatch):
    # one group of near copies far above a block: its parts still meet in the first round
    monkeypatch.setattr(ngram_join, "BLOCK", 20)
    monkeypatch.setattr(ngram_join, "BRIDGES", 4)
    docs = frame(spark, [(i, t, "en", "a", 0) for i, t in enumerate(near_copies(150, 120, 2, 3))])
    check_join(docs)


def test_given_documents(spark, sf):
    check_join(spark.read.parquet(f"{sf}/documents.parquet"))


def test_tree_bound_loses_no_pair():
    rng = np.random.default_rng(5)
    base = rng.poisson(2.0, (30, 32))
    points = np.repeat(base, 10, axis=0) + (rng.random((300, 32)) < 0.05)
    sizes = points.sum(1)
    tree = ngram_join.CountTree(points.astype(np.int32), sizes)
    a, b, bound = tree.candidates(np.arange(300))
    over = np.minimum(points[:, None], points[None]).sum(2)
    want = {(i, j) for i, j in np.argwhere(180 * over >= 80 * (sizes[:, None] + sizes[None])) if i != j}
    assert set(zip(a.tolist(), b.tolist())) == want and (bound == over[a, b]).all()


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(40)]
    star = [(100, 100 + k) for k in range(1, 50)]
    edges = spark.createDataFrame(chain + star + [(300, 200), (200, 250), (7, 7)], "a long, b long")
    got = {r["node"]: r["label"] for r in components(edges).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 150), 100), 200: 200, 250: 200, 300: 200}
    assert components(edges.limit(0)).count() == 0


def test_odd_rows_hold_copies():
    assert sum(r[1] == PROSE for r in odd_rows()) == 3
