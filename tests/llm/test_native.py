import datetime
import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from llm.conftest import WORD, collected, frame
from tideline.llm import mixing, slots, url_lists
from tideline.llm.queries import ORACLES, QUERIES
from tideline.session import run_dir


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_equal_their_sql(spark, con, sf, name):
    df = QUERIES[name](spark, sf)
    cur = con.execute(ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(str(tuple(r[names.index(c)] for c in df.columns)) for r in cur.fetchall())
    assert sorted(str(tuple(r)) for r in df.collect()) == want


@pytest.mark.parametrize("name", ["op2_temporal_list_join", "op3_systematic_mix", "op6_virtual_slots"])
def test_native_plans_hold_no_python(spark, sf, name):
    plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


# --- mixing -----------------------------------------------------------------------------------------------------------


def words(text):
    return len(WORD.findall(text or ""))


def plain_targets(sizes, weights, most):
    """Share by weight, stop what is above its cap, share the rest again until none is above."""
    keys = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {k: weights[i % len(weights)] for i, k in enumerate(keys)}
    target, left, open_ = {}, float(sum(sizes.values())), set(keys)
    while open_:
        total = sum(weight[k] for k in open_)
        over = {k for k in open_ if left * weight[k] / total >= most * sizes[k]}
        if not over:
            return target | {k: left * weight[k] / total for k in open_}
        target |= {k: float(most * sizes[k]) for k in over}
        left -= sum(most * sizes[k] for k in over)
        open_ -= over
    return target


def check_mix(rows, got):
    sizes = {}
    for r in rows:
        sizes[r["source"]] = sizes.get(r["source"], 0) + words(r["text"])
    target = plain_targets(sizes, (5, 2, 1), 3)
    assert len(got) == len(rows)
    of = {}
    for r in rows:
        of.setdefault(r["doc_id"], []).append((words(r["text"]), r["source"]))
    taken = dict.fromkeys(sizes, 0)
    for g in got:
        assert any(g["size"] == n and g["source_size"] == sizes[s] and abs(g["target"] - target[s]) <= 1e-6 * max(1, target[s]) for n, s in of[g["doc_id"]])
        assert 0 <= g["copies"] <= 3 and g["taken"] == g["copies"] * g["size"]
        for s in {s for n, s in of[g["doc_id"]] if g["source_size"] == sizes[s]}:
            taken[s] += g["taken"] / len({s for n, s in of[g["doc_id"]] if g["source_size"] == sizes[s]})
    return sizes, target, taken


def test_mix_of_odd_rows(spark, odd):
    got = collected(mixing.mix_plan(odd))
    check_mix(odd.collect(), got)
    assert sorted(map(str, collected(mixing.mix_plan(odd.repartition(3))))) == sorted(map(str, got))
    back = mixing.mixed_documents(odd)
    assert back.columns == odd.columns
    assert back.count() == sum(g["copies"] for g in got)


def test_mix_nears_its_targets(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("source", F.when(F.col("doc_id") % 3 > 0, F.lit("hot")).otherwise(F.col("source")))
    rows = docs.collect()
    sizes, target, taken = check_mix(rows, collected(mixing.mix_plan(docs)))
    largest = {s: max(words(r["text"]) for r in rows if r["source"] == s) for s in sizes}
    for s in sizes:
        assert abs(taken[s] - target[s]) <= 2 * largest[s]
    assert sum(target.values()) == pytest.approx(sum(sizes.values()))


def test_mix_of_one_hot_size(spark):
    # equal sizes only: ranks come from buckets alone, and each rank is used once
    docs = frame(spark, [(i, "four words in all", "en", "a" if i % 5 else "b", 0) for i in range(3000)])
    got = collected(mixing.mix_plan(docs))
    for source, keep in (("a", lambda i: i % 5), ("b", lambda i: not i % 5)):
        mine = [g for g in got if keep(g["doc_id"])]
        assert abs(sum(g["taken"] for g in mine) - mine[0]["target"]) <= 4, source
        assert len({g["copies"] for g in mine}) <= 2


# --- slots ------------------------------------------------------------------------------------------------------------


def test_shards_of_odd_rows(spark, odd):
    got = collected(slots.sharded(odd, run_dir(spark, "slots-test"), 24))
    rows = odd.collect()
    assert sorted(str((g["doc_id"], g["size"], g["text_crc32"])) for g in got) == sorted(str((r["doc_id"], len((r["text"] or "").encode()) + 8, zlib.crc32((r["text"] or "").encode()))) for r in rows)
    for shard in {g["shard"] for g in got}:
        assert 0 <= shard < 24
        assert sorted(g["slot"] for g in got if g["shard"] == shard) == list(range(sum(g["shard"] == shard for g in got)))
    assert all(g["law"] == "bytes" and g["grown_shard"] is None for g in got)


def test_shards_are_balanced_and_versions_stay(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    path = run_dir(spark, "slots-test")
    got = collected(slots.sharded(docs, path, 8))
    per = [sum(g["size"] for g in got if g["shard"] == s) for s in range(8)]
    assert max(per) - min(per) <= 0.05 * sum(per) / 8
    first = {r["vslot"]: r["shard"] for r in slots.load_map(spark, path, 1).collect()}
    newest = {r["vslot"]: r["shard"] for r in slots.load_map(spark, path).collect()}
    assert first == {v: v % 8 for v in range(slots.SLOTS)}
    assert newest.keys() == first.keys() and all(newest[g["vslot"]] == g["shard"] for g in got)
    records = slots.records_of(docs)
    loads = slots.slot_bytes(records)
    slots.save_map(slots.rebalanced(slots.load_map(spark, path), loads, 9), path, 3)
    grown = {r["vslot"]: r["shard"] for r in slots.load_map(spark, path).collect()}
    moved = [v for v in grown if grown[v] != newest[v]]
    weight = {r["vslot"]: r["slot_bytes"] for r in loads.collect()}
    assert 0 < sum(weight.get(v, 0) for v in moved) <= 0.4 * sum(weight.values())
    nine = [sum(weight.get(v, 0) for v in grown if grown[v] == s) for s in range(9)]
    assert max(nine) - min(nine) <= 0.1 * sum(nine) / 9
    assert {r["vslot"]: r["shard"] for r in slots.load_map(spark, path, 2).collect()} == newest


def test_slots_are_the_same_for_ids_everywhere(spark):
    docs = frame(spark, [(i, "x" * i, "en", "a", 0) for i in range(300)])
    a = {r["_id"]: r["vslot"] for r in slots.records_of(docs).collect()}
    b = {r["_id"]: r["vslot"] for r in slots.records_of(docs.withColumn("text", F.lit("other")).repartition(5)).collect()}
    assert a == b and len(set(a.values())) > 280


# --- url lists --------------------------------------------------------------------------------------------------------


def day(n):
    return datetime.date(2024, 1, 1) + datetime.timedelta(days=n)


ENTRIES = [
    ("host", "a.example.com", "block", day(10)), ("host", "a.example.com", "remove", day(40)), ("host", "a.example.com", "block", day(100)),
    ("domain", "example.com", "block", day(20)), ("folder", "a.example.com/ok", "allow", day(15)), ("page", "a.example.com/ok/bad", "block", day(15)),
    ("host", "b.example.com", "allow", day(5)), ("host", "b.example.com", "block", day(5)), ("host", None, "block", day(1)), ("host", "c.org", "block", None),
    ("host", "c.org", "unknown", day(1)), ("domain", "example.com", "block", day(25)),
]
URLS = ["https://a.example.com/", "http://user:pw@A.Example.com:8080/ok/page?q=1#x", "https://a.example.com/ok/bad", "http://b.example.com", "http://c.org/x", "not a url", "", None, "ftp://example.com/y", "http://deep.b.example.com/z"]


def plain_verdict(url, on):
    """The entry that decides, by walking over every entry."""
    import re

    m = re.match(r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)([^?#]*)", url or "")
    if not m or on is None:
        return 0, None
    host = re.sub(r":\d*$", "", m[1].split("@")[-1]).lower()
    if not host:
        return 0, None
    labels = host.split(".")
    keys = [("page", host + m[2], 4000), ("host", host, 2000)] + [("domain", ".".join(labels[i:]), 1000 + len(labels) - i) for i in range(len(labels) - 1)]
    folder = re.match(r"^/([^/]+)", m[2])
    keys += [("folder", f"{host}/{folder[1]}", 3000)] if folder else []
    hits = []
    for kind, pattern, level in keys:
        rank = {"remove": 0, "allow": 1, "block": 2}
        own = sorted((d, rank[a]) for k, p, a, d in ENTRIES if (k, p) == (kind, pattern) and d is not None and a in rank and d <= on)
        if own and own[-1][1]:
            action = own[-1][1]
            hits.append((level, kind, pattern, "block" if action == 2 else "allow"))
    return len(hits), max(hits) if hits else None


def test_verdicts_equal_a_walk_over_all_entries(spark):
    rows = [(100 * i + n, url, day(n)) for i, url in enumerate(URLS) for n in (0, 9, 10, 16, 22, 31, 39, 40, 60, 99, 100, 200)] + [(-1, URLS[0], None), (None, URLS[0], day(12)), (7, URLS[0], day(12)), (7, URLS[0], day(12))]
    captures = spark.createDataFrame(rows, "page_id long, url string, on_day date").withColumn("kind", F.lit("clash")).withColumn("level", F.lit(1))
    entries = spark.createDataFrame(ENTRIES, "kind string, pattern string, action string, on_date date")
    got = collected(url_lists.verdicts(captures, entries, "page_id", "url", "on_day"))
    assert sorted(str((g["page_id"], g["url"], g["on_day"])) for g in got) == sorted(str(r) for r in rows)
    for g in got:
        many, hit = plain_verdict(g["url"], g["on_day"])
        assert g["n_active"] == many, g
        assert (g["kind"], g["pattern"], g["action"]) == (hit[1:] if hit else (None, None, None)), g
        assert g["kept"] == (not hit or hit[3] != "block")


def test_no_captures_or_no_entries(spark):
    captures = spark.createDataFrame([(1, URLS[0], day(3))], "page_id long, url string, on_day date")
    entries = spark.createDataFrame(ENTRIES, "kind string, pattern string, action string, on_date date")
    assert url_lists.verdicts(captures.limit(0), entries, "page_id", "url", "on_day").count() == 0
    assert [r["kept"] for r in collected(url_lists.verdicts(captures, entries.limit(0), "page_id", "url", "on_day"))] == [True]


def test_intervals_merge_and_end(spark):
    entries = spark.createDataFrame(ENTRIES, "kind string, pattern string, action string, on_date date")
    got = {(r["pattern"], r["action"], r["valid_from"], r["valid_to"]) for r in url_lists.intervals(entries).collect()}
    assert ("a.example.com", "block", day(10), day(40)) in got and ("a.example.com", "block", day(100), None) in got
    assert ("example.com", "block", day(20), None) in got and ("b.example.com", "block", day(5), None) in got
    assert hashlib.md5(b"").hexdigest() and len(got) == 6
