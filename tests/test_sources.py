import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from tideline.operators import joins, survival
from tideline.session import run_dir
from tideline.sources import series, shards, vintages
from tideline.streaming import cube


def line(**v):
    f = [""] * vintages.N_FIELDS
    for k, x in v.items():
        f[vintages.POSITIONS[k]] = str(x)
    return "|".join(f)


def write_lines(spark, folder, name, lines):
    spark.createDataFrame([(x,) for x in lines], "v string").coalesce(1).write.text(f"{folder}/vintage={name}")


def test_raw_scan_is_lenient(spark):
    folder = run_dir(spark, "raw")
    write_lines(spark, folder, "2018Q1", [
        line(loan_id=1, mmyyyy=122018, note_rate="3.25", upb="100.5", fico="", purpose="R", zbc=""),
        line(loan_id=1, mmyyyy=12019, note_rate="bad", upb="0", fico=700, purpose="", zbc=1),
        line(loan_id=2, mmyyyy="1201", note_rate=3, upb=1),       # odd-length period
        line(loan_id="", mmyyyy=12019, note_rate=3, upb=1),       # no loan
        line(loan_id=3, mmyyyy="xx", note_rate=3, upb=1),         # not a number
    ])
    df = vintages.scan_vintage(spark, f"{folder}/vintage=2018Q1", ["loan_id", "mmyyyy", "note_rate", "upb", "fico", "purpose", "zbc"])
    got = sorted((r.loan_id, r.yyyymm, r.note_rate, r.upb, r.fico, r.purpose, r.zbc, r.vintage) for r in df.collect())
    assert got == [(1, 201812, 3.25, 100.5, None, "R", None, "2018Q1"), (1, 201901, None, 0.0, 700, None, 1, "2018Q1")]


def test_scan_reads_only_the_selected_fields(spark):
    folder = run_dir(spark, "raw")
    write_lines(spark, folder, "2018Q1", [line(loan_id=1, mmyyyy=12019)])
    plan = vintages.scan_vintage(spark, f"{folder}/vintage=2018Q1", ["loan_id", "mmyyyy"])._jdf.queryExecution().executedPlan().toString()
    schema = plan.split("ReadSchema: ")[1].split(">")[0]
    assert "f1:" in schema and "f2:" in schema and "f7:" not in schema


def test_missing_vintages_are_skipped(spark):
    folder = run_dir(spark, "raw")
    for v in ("2018Q1", "2018Q2"):
        write_lines(spark, folder, v, [line(loan_id=1, mmyyyy=12019)])
    df = vintages.scan_all(spark, folder, ["2018Q2", "2099Q4"], columns=["loan_id"])
    assert [r.vintage for r in df.collect()] == ["2018Q2"]


def test_wide_home_prices_average_over_a_zip3(spark):
    wide = spark.createDataFrame([(1001, 10.0, None), (1002, 20.0, 30.0)], "RegionName bigint, `2019-01-31` double, `2019-02-28` double")
    assert rows(series.hpi_wide_to_long(wide)) == [(10, 201901, 15.0), (10, 201902, 30.0)]


def test_shards_resume_and_replace(spark):
    folder = run_dir(spark, "shards")
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "vintage string, x int")
    keys = spark.createDataFrame([("a",), ("b",), ("c",)], "vintage string")
    shards.write_missing(df, folder, keys.filter("vintage = 'a'"))
    # a half-written shard without a manifest entry is replaced, not doubled
    df.filter("vintage = 'b'").unionByName(df.filter("vintage = 'b'")).write.mode("append").partitionBy("vintage").parquet(f"{folder}/data")
    done = shards.write_missing(df, folder, keys)
    assert rows(done, "vintage", "n_rows", "is_empty") == [("a", 2, False), ("b", 1, False), ("c", 0, True)]
    assert rows(shards.read_shards(spark, folder, "x int, vintage string"), "vintage", "x") == [("a", 1), ("a", 2), ("b", 3)]
    assert shards.write_missing(df, folder, keys).count() == 3


def test_gate_blocks_a_large_change(spark):
    folder = run_dir(spark, "gate")
    old = spark.createDataFrame([(1, 10.0)], "k int, v double")
    shards.publish(old, folder, 1)
    new = spark.createDataFrame([(1, 99.0)], "k int, v double")
    gate = shards.consistency_gate(old, new, ["k"], "v", 1.0)
    assert not gate.first().accept
    with pytest.raises(Exception, match="changed too much"):
        shards.publish(new, folder, 2, gate)


def test_streamed_cube_equals_batch_with_late_files(spark):
    inbox, state = run_dir(spark, "inbox"), run_dir(spark, "cube")
    files = [
        [(1, 201901, 90.0), (1, 201902, 0.0), (2, 201901, 50.0)],
        [(1, 201903, 80.0), (2, 201902, 40.0), (3, 201902, 10.0)],   # loan 1 was not paid off after all
        [(1, 201904, 0.0), (2, 201901, 50.0)],                        # late duplicate month of loan 2
    ]
    every = []
    for i, part in enumerate(files):
        every += part
        text = [line(loan_id=l, mmyyyy=(ym % 100) * 10000 + ym // 100, note_rate=3.0, upb=u) for l, ym, u in part]
        spark.createDataFrame([(x,) for x in text], "v string").coalesce(1).write.mode("append").text(inbox)
        cube.run_available(vintages.stream_vintages(spark, inbox, 1, ["loan_id", "mmyyyy", "note_rate", "upb"]), state)
        want = survival.realized_cpr_balance(spark.createDataFrame([(l, ym, u, 3.0) for l, ym, u in every], "loan_id bigint, yyyymm bigint, upb double, note_rate double"))
        cols = ["coupon_bucket", "yyyymm", "n_atrisk", "n_prepay", "upb_atrisk", "upb_prepay"]
        assert rows(cube.cube(spark, state), *cols) == rows(want, *cols)


def test_a_replayed_batch_changes_nothing(spark):
    state = run_dir(spark, "cube")
    df = spark.createDataFrame([(1, 201901, 90.0, 3.0), (1, 201902, 0.0, 3.0)], "loan_id bigint, yyyymm bigint, upb double, note_rate double")
    merge = cube.merge_batch(state)
    merge(df, 0)
    once = rows(cube.cube(spark, state))
    merge(df, 0)
    assert rows(cube.cube(spark, state)) == once


PANEL = "loan_id bigint, yyyymm bigint, upb double, note_rate double"
CELL = ["coupon_bucket", "yyyymm", "n_atrisk", "n_prepay", "upb_atrisk", "upb_prepay"]


def files_read(spark, state, loans, **size):
    """Files and buckets that a batch of these loans would read."""
    known = cube.heads(spark, state)
    where = spark.createDataFrame([(x,) for x in loans], "loan_id bigint").select(F.pmod(F.xxhash64("loan_id"), F.lit(size["buckets"]))).distinct()
    found = cube.bucket_rows(spark, state, known[max(known)], [r[0] for r in where.collect()]).inputFiles()
    return len(found), {f.split("bucket=")[1].split("/")[0] for f in found}


def test_a_batch_reads_its_own_buckets_and_never_more_than_the_fold(spark):
    state, size = run_dir(spark, "cube"), {"buckets": 4, "fold": 3}
    merge = cube.merge_batch(state, **size)
    every = [(loan, 200001, 100.0 + loan, 3.0) for loan in range(1, 41)]
    merge(spark.createDataFrame(every, PANEL), 0)
    for i in range(1, 21):  # one loan, month by month; a paid-off loan comes back in the middle
        row = (7, 200001 + i % 12 + 100 * (i // 12), 0.0 if i in (5, 20) else 100.0 - i, 3.0)
        every.append(row)
        merge(spark.createDataFrame([row], PANEL), i)
        known = cube.heads(spark, state)
        assert len(known) <= 2 and all(len(v) <= 3 for v in known[i].values())
        if i % 6 == 0:
            n, where = files_read(spark, state, [7], **size)
            assert n <= 3 and len(where) == 1
    assert files_read(spark, state, range(1, 41), **size)[1] == {"0", "1", "2", "3"}
    assert rows(cube.cube(spark, state), *CELL) == rows(survival.realized_cpr_balance(spark.createDataFrame(every, PANEL)), *CELL)


def test_a_fold_can_be_replayed_and_unread_versions_go(spark):
    state, size = run_dir(spark, "cube"), {"buckets": 1, "fold": 2}
    merge = cube.merge_batch(state, **size)
    parts = [[(i % 3, 201901 + i, 50.0 + i, 3.0), (9, 201901 + i, 0.0 if i == 5 else 70.0, 4.0)] for i in range(6)]
    for i, part in enumerate(parts):
        df = spark.createDataFrame(part, PANEL)
        merge(df, i)
        if i > 1:
            merge(df, i)  # its own version is there already, whole
    want = survival.realized_cpr_balance(spark.createDataFrame(sum(parts, []), PANEL))
    assert rows(cube.cube(spark, state), *CELL) == rows(want, *CELL)
    kept = {r[0] for r in spark.read.parquet(f"{state}/months").select("version").distinct().collect()}
    known = cube.heads(spark, state)
    assert set(known) == {4, 5} and kept == {v for h in known.values() for vs in h.values() for v in vs}


def test_an_empty_batch_and_another_bucket_count(spark):
    state = run_dir(spark, "cube")
    none = spark.createDataFrame([], PANEL)
    cube.merge_batch(state, 4)(none, 0)
    assert cube.cube(spark, state).count() == 0
    cube.merge_batch(state, 4)(spark.createDataFrame([(1, 201901, 10.0, 3.0), (None, 201901, 1.0, 3.0)], PANEL), 1)
    once = rows(cube.cube(spark, state))
    cube.merge_batch(state, 4)(none, 2)
    assert rows(cube.cube(spark, state)) == once and len(once) == 1
    with pytest.raises(ValueError, match="4 buckets"):
        cube.merge_batch(state, 8)(none, 3)


@pytest.mark.parametrize("loan", ["id % 20", "CASE WHEN id < 850 THEN 1L ELSE id END"])
def test_one_layout_for_even_and_hot_loans(spark, loan):
    df = spark.range(900).selectExpr(f"{loan} AS loan_id", "201901 + id AS yyyymm", "1.0D AS upb", "3.0D AS note_rate", "'2018Q' || (1 + id % 2) AS vintage")
    spark.sql("DROP TABLE IF EXISTS panel_layout")
    vintages.to_panel_table(df, "panel_layout")
    t = spark.table("panel_layout")
    assert t.count() == 900
    assert "PartitionFilters: [isnotnull(vintage" in t.filter("vintage = '2018Q1'")._jdf.queryExecution().executedPlan().toString()
    kinds = {r["col_name"]: r["data_type"] for r in spark.sql("DESCRIBE EXTENDED panel_layout").collect()}
    assert "Num Buckets" not in kinds
    spark.sql("DROP TABLE panel_layout")


def test_a_key_that_turns_empty_keeps_no_old_rows(spark):
    folder = run_dir(spark, "shards")
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "vintage string, x int")
    # a run that died between data and manifest
    df.write.partitionBy("vintage").parquet(f"{folder}/data/run-dead")
    keys = spark.createDataFrame([("a",), ("b",)], "vintage string")
    done = shards.write_missing(df.filter("vintage = 'b'"), folder, keys)
    assert rows(done.select("vintage", "n_rows", "is_empty")) == [("a", 0, True), ("b", 1, False)]
    assert rows(shards.read_shards(spark, folder, "x int, vintage string")) == [(3, "b")]


def test_gate_refuses_without_a_common_key(spark):
    kind = "k int, v double"
    old, new = spark.createDataFrame([(1, 1.0)], kind), spark.createDataFrame([(2, 1.0)], kind)
    accept = lambda a, b: shards.consistency_gate(a, b, ["k"], "v", 0.5).first()["accept"]
    assert not accept(old, new) and accept(old.limit(0), new) and accept(old, old)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_month_table_is_joined_and_windowed_without_an_exchange(spark):
    """A loan with a third of all raw rows is one row per month before it is laid out."""
    raw = spark.range(6000).selectExpr("IF(id % 3 = 0, 1L, id % 97) AS loan_id", "201901 + id % 11 AS yyyymm", "CAST(IF(id % 11 = 10, 0, 100 - id % 7) AS DOUBLE) AS upb", "3.0D AS note_rate")
    months = vintages.to_month_table(survival.loan_months(raw), "month_layout", run_dir(spark, "tables"), 8)
    assert months.groupBy("loan_id").count().agg(F.max("count")).first()[0] == 11
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        state = survival.last_appearance(months, upb="month_upb", rate="month_rate").select("loan_id", "last_rate", "payoff_ym")
        met = joins.loan_state_join(months, state)
        windowed = survival.with_loan_state(months)
        for df in (met, windowed):
            assert "Exchange" not in plan_of(df) and "SelectedBucketsCount: 8" in plan_of(df)
        loose = survival.loan_months(raw)
        assert "Exchange" in plan_of(survival.with_loan_state(loose))
        assert rows(windowed) == rows(survival.with_loan_state(loose), *windowed.columns)
        plain = joins.loan_state_join(loose, survival.last_appearance(raw).select("loan_id", "last_rate", "payoff_ym"))
        assert rows(met) == rows(plain, *met.columns)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE month_layout")


def test_a_small_table_picks_the_files_of_its_vintages(spark):
    df = spark.range(400).selectExpr("id AS loan_id", "201901 + id % 9 AS yyyymm", "concat(2010 + id % 8, 'Q1') AS vintage")
    vintages.to_panel_table(df, "panel_pruned", run_dir(spark, "tables"))
    wanted = spark.createDataFrame([(f"{y}Q1", y) for y in range(2005, 2020)], "vintage string, year int").filter("year IN (2011, 2016)")
    got = vintages.of_vintages(spark.table("panel_pruned"), wanted)
    assert "dynamicpruning" in plan_of(got)
    assert got.groupBy("vintage").count().orderBy("vintage").collect() == [("2011Q1", 50), ("2016Q1", 50)]
    spark.sql("DROP TABLE panel_pruned")


def test_shards_of_many_runs_are_one_scan(spark):
    folder = run_dir(spark, "shards")
    df = spark.range(60).selectExpr("id", "concat('v', id % 6) AS vintage")
    for many in (2, 4, 6):
        shards.write_missing(df, folder, df.filter(f"CAST(substr(vintage, 2) AS INT) < {many}").select("vintage").distinct())
    got = shards.read_shards(spark, folder, "id bigint, vintage string")
    assert rows(got) == rows(df) and plan_of(got).count("FileScan") == 1
