import random

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from tideline.functions import bins, rates
from tideline.operators import joins, selection, sequences, survival

SCHEMA = "loan_id bigint, yyyymm bigint, upb double, note_rate double"


def panel(spark, data):
    return spark.createDataFrame(data, SCHEMA)


def brute_balance(data):
    """Plain-Python balance-weighted cells for unique (loan, month) rows."""
    loans = {}
    for lid, ym, upb, rate in data:
        loans.setdefault(lid, []).append((ym, upb, rate))
    cells = {}
    for hist in loans.values():
        hist.sort()
        seen = [h for h in hist if h[2] is not None]
        if not seen:
            continue
        last, prior = seen[-1], seen[-2] if len(seen) > 1 else None
        pm = last[0] if last[1] == 0 else None
        pb = prior[1] if pm and prior else None
        cb = round(seen[0][2] * 2) / 2
        for ym, upb, _ in hist:
            pay = pm is not None and ym == pm
            if pm is not None and ym > pm:
                continue
            w = pb if pay else upb
            if w is None or w < 0:
                continue
            c = cells.setdefault((cb, ym), [0, 0, 0.0, 0.0])
            c[0] += 1
            c[2] += w
            if pay:
                c[1] += 1
                c[3] += w
    return {k: v for k, v in cells.items() if v[2] > 0}


EDGE = [
    (1, 201812, 100.0, 3.0), (1, 201901, 90.0, 3.0), (1, 201902, 0.0, 3.0),      # plain payoff
    (2, 201902, 0.0, 3.0),                                                          # payoff with no earlier row
    (3, 201901, None, 3.0), (3, 201902, 0.0, 3.0),                                  # payoff after a NULL balance
    (4, 201901, -5.0, 3.0), (4, 201902, 50.0, 3.0),                                 # negative balance
    (5, 201901, 70.0, 3.5), (5, 201902, None, 3.5),                                 # NULL last balance is censored
    (6, 201901, 40.0, 2.25), (6, 201905, 0.0, 9.0),                                 # gap, rate taken from the first row
    (7, 201901, 10.0, None),                                                        # never a rate
]


def test_balance_weighted_cells_on_edge_panel(spark):
    out = survival.realized_cpr_balance(panel(spark, EDGE))
    got = {(r.coupon_bucket, r.yyyymm): [r.n_atrisk, r.n_prepay, r.upb_atrisk, r.upb_prepay] for r in out.collect()}
    assert got == brute_balance(EDGE)


def test_balance_weighted_cells_on_random_panel(spark):
    rng = random.Random(5)
    data = []
    for lid in range(200):
        months = sorted(rng.sample(range(201801, 201813), rng.randint(1, 9)))
        rate = rng.choice([2.25, 2.5, 2.75, 3.0, 3.25])
        for i, m in enumerate(months):
            last = i == len(months) - 1
            data.append((lid, m, 0.0 if last and rng.random() < 0.4 else rng.choice([100.0, 55.5, None, -1.0, 80.25]), rate))
    out = survival.realized_cpr_balance(panel(spark, data))
    got = {(r.coupon_bucket, r.yyyymm): [r.n_atrisk, r.n_prepay, round(r.upb_atrisk, 6), round(r.upb_prepay, 6)] for r in out.collect()}
    want = {k: [v[0], v[1], round(v[2], 6), round(v[3], 6)] for k, v in brute_balance(data).items()}
    assert got == want


def test_count_cells_include_payoff_month(spark):
    out = survival.realized_cpr_count(panel(spark, EDGE[:3]))
    assert rows(out, "yyyymm", "n_atrisk", "n_prepay") == [(201812, 1, 0), (201901, 1, 0), (201902, 1, 1)]


def test_last_appearance_over_split_files(spark):
    whole = panel(spark, EDGE)
    a, b = panel(spark, EDGE[::2]), panel(spark, EDGE[1::2])
    assert rows(survival.last_appearance(whole).fillna(-1)) == rows(survival.last_appearance(b.unionByName(a)).fillna(-1))
    assert rows(survival.realized_cpr_balance(whole)) == rows(survival.realized_cpr_balance(b.unionByName(a).repartition(7)))


def test_payoff_month_is_moved_by_a_later_file(spark):
    first = panel(spark, [(1, 201901, 90.0, 3.0), (1, 201902, 0.0, 3.0)])
    both = first.unionByName(panel(spark, [(1, 201903, 80.0, 3.0), (1, 201904, 0.0, 3.0)]))
    assert rows(survival.payoff_balance(first)) == [(1, 201902, 90.0)]
    assert rows(survival.payoff_balance(both)) == [(1, 201904, 80.0)]


def test_duplicate_months_count_every_row_once(spark):
    data = [(1, 201901, 100.0, 3.0), (1, 201901, 100.0, 3.0), (1, 201902, 0.0, 3.0)]
    out = survival.realized_cpr_balance(panel(spark, data))
    assert rows(out, "yyyymm", "n_atrisk", "n_prepay", "upb_atrisk") == [(201901, 2, 0, 200.0), (201902, 1, 1, 100.0)]


def test_a_hot_loan_stays_exact(spark):
    hot = spark.range(30000).selectExpr("1L AS loan_id", "201801L + id % 6 AS yyyymm", "10.0D AS upb", "3.0D AS note_rate")
    rest = spark.range(1000).selectExpr("id + 2 AS loan_id", "201801L + id % 6 AS yyyymm", "5.0D AS upb", "3.0D AS note_rate")
    out = survival.realized_cpr_balance(hot.unionByName(rest))
    assert sum(r.n_atrisk for r in out.collect()) == 31000
    moved = survival.loan_months(hot.unionByName(rest))
    assert moved.filter("loan_id = 1").count() == 6


def test_age_levels_add_up_and_use_origination(spark):
    data = [(i, 201901 + m, 100.0 + i, 3.0, 201301 if i % 2 else 201812) for i in range(10) for m in range(3)]
    df = spark.createDataFrame(data, SCHEMA + ", orig_ym bigint")
    from tideline.functions import periods

    aged = df.withColumn("age_group", bins.seasoning_group(periods.months_between_ym("orig_ym", "yyyymm")))
    cells = survival.realized_cpr_balance(aged, keys=("age_group",))
    assert {r.age_group for r in cells.collect()} == {0, 60}
    total = survival.realized_cpr_balance(df)
    up = survival.rollup_speeds(cells, ["coupon_bucket", "yyyymm"])
    rec = joins.reconcile(total, up, ["coupon_bucket", "yyyymm"], ["upb_atrisk", "n_atrisk"])
    assert all(r.max_abs_diff == 0 and r.n_only_old == r.n_only_new == 0 for r in rec.collect())


def test_ever_event_is_code_one_only(spark):
    df = spark.createDataFrame([(1, 201901, None), (1, 201902, 1), (2, 201901, 9), (3, 201901, None)], "loan_id bigint, yyyymm bigint, zbc bigint")
    assert rows(survival.ever_event(df, F.col("zbc") == 1)) == [(1, 1), (2, 0), (3, 0)]
    assert rows(survival.with_ever_event(df, F.col("zbc") == 1), "loan_id", "prepaid") == [(1, 1), (1, 1), (2, 0), (3, 0)]


def test_label_is_cut_at_the_cutoff(spark):
    df = spark.createDataFrame([(1, 201901, None), (1, 201903, 1)], "loan_id bigint, yyyymm bigint, zbc bigint")
    cut = selection.cutoff(df, 201902)
    assert rows(survival.ever_event(cut, F.col("zbc") == 1)) == [(1, 0)]


def test_last_known_is_per_column(spark):
    df = spark.createDataFrame([(1, 201901, 5, "a"), (1, 201902, None, "b"), (1, 201903, None, None)], "loan_id bigint, yyyymm bigint, x int, y string")
    assert rows(survival.last_known(df, ["x", "y"])) == [(1, 5, "b")]


def test_cohort_rows_may_belong_to_several(spark):
    df = spark.createDataFrame([(1, "2018Q1"), (2, "2013Q1"), (3, "2001Q1")], "loan_id bigint, vintage string")
    out = survival.cohort_members(df, {"a": ["2013Q1", "2018Q1"], "b": ["2018Q1"]})
    assert rows(out, "loan_id", "cohort") == [(1, "a"), (1, "b"), (2, "a")]


def test_sequence_numbers_after_dropping_missing_features(spark):
    data = [(1, 201901 + i, None if i == 2 else float(i), 1 if i == 4 else None, 1) for i in range(5)]
    df = spark.createDataFrame(data, "loan_id bigint, yyyymm bigint, x double, zbc bigint, prepaid int")
    r = sequences.build_sequences(df, ["x"], F.col("zbc") == 1, max_steps=6).first()
    assert [s[0] for s in r.seq] == [0.0, 1.0, 3.0, 4.0, 0.0, 0.0]
    assert r.mask == [True] * 4 + [False] * 2 and r.event_step == 3 and r.label == 1.0


def test_event_beyond_the_window_keeps_the_label(spark):
    data = [(1, 201901 + i, float(i), 1 if i == 4 else None, 1) for i in range(5)]
    df = spark.createDataFrame(data, "loan_id bigint, yyyymm bigint, x double, zbc bigint, prepaid int")
    r = sequences.build_sequences(df, ["x"], F.col("zbc") == 1, max_steps=3).first()
    assert r.event_step == -1 and r.label == 1.0


def test_scaler_uses_population_std_of_training_rows(spark):
    df = spark.createDataFrame([(1.0, 7.0), (3.0, 7.0)], "a double, b double")
    st = sequences.scaler_stats(df, ["a", "b"])
    out = sequences.scale(df, st, ["a", "b"])
    assert rows(out) == [(-1.0, 0.0), (1.0, 0.0)]
    assert rows(sequences.unscale(out, st, ["a", "b"])) == rows(df)


def test_person_period_weights_match_the_batch_scheme(spark):
    df = spark.createDataFrame([(1, i, 1 if i == 2 else None) for i in range(3)] + [(2, i, None) for i in range(4)], "loan_id bigint, yyyymm bigint, zbc bigint")
    steps = sequences.person_period(sequences.timesteps(df), F.col("zbc") == 1)
    w = selection.person_period_weights(steps)
    total = {r.loan_id: r.s for r in w.groupBy("loan_id").agg(F.sum("weight").alias("s")).collect()}
    assert total[1] == pytest.approx(0.5 + 0.25) and total[2] == pytest.approx(0.25)


def test_oversample_copies_events(spark):
    df = spark.createDataFrame([(1, 1), (2, 0)], "id int, y int")
    assert rows(selection.oversample(df, F.col("y") == 1, 3), "id", "copy") == [(1, 0), (1, 1), (1, 2), (2, 0)]


def test_survival_cdf_ends_on_a_sure_event(spark):
    df = spark.createDataFrame([(1, 0.1), (1, 0.2), (2, 1.0), (2, 0.5)], "loan_id bigint, h double")
    got = dict((r.loan_id, r.cdf) for r in sequences.survival_cdf(df, "h").collect())
    assert got[1] == pytest.approx(1 - 0.9 * 0.8) and got[2] == 1.0


def test_latest_rows_are_limited_before_the_shuffle(spark):
    df = spark.range(1000).selectExpr("id % 3 AS g", "id AS o")
    plan = selection.latest_rows(df, 2, ["g"], "o")._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_steps_are_limited_before_the_shuffle(spark):
    df = spark.range(1000).selectExpr("id % 3 AS loan_id", "id AS yyyymm")
    plan = sequences.timesteps(df)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_prices_are_looked_up_without_moving_the_panel(spark):
    from tideline.operators import joins

    panel = spark.createDataFrame([(1, 7, 201901, 201902), (2, 7, 201801, 201902), (3, None, 201901, 201902), (4, 8, 201901, None)], "loan_id int, zip3 int, orig_ym int, yyyymm int")
    hpi = spark.createDataFrame([(7, 201901, 10.0), (7, 201902, 11.0)], "zip3 int, yyyymm int, hpi double")
    out = joins.hpi_double_lookup(panel, hpi)
    assert rows(out, "loan_id", "hpi_orig", "hpi_now") == [(1, 10.0, 11.0), (2, None, 11.0), (3, None, None), (4, None, None)]
    plan = joins.hpi_double_lookup(panel, hpi)._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" not in plan and plan.count("BroadcastHashJoin") == 1, plan


def test_a_repeated_lookup_key_stops_the_job(spark):
    from tideline.operators import joins

    panel = spark.createDataFrame([(1, 201901)], "loan_id int, yyyymm int")
    market = spark.createDataFrame([(201901, 4.0), (201901, 4.1)], "yyyymm int, rate_30yr double")
    with pytest.raises(Exception, match="repeated lookup key"):
        joins.rate_lookup(panel, market).collect()
