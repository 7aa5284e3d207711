import numpy as np
import pytest
from pyspark.sql import Window as W, functions as F

from tideline.functions import rates
from tideline.operators import quality, regression
from tideline.plans import factors, mapping, rates_study, scurve


def sample(n, k, seed=0, groups=1):
    rng = np.random.default_rng(seed)
    out = []
    for g in range(groups):
        x = rng.normal(size=(n, k)) + 100  # far from zero: cross-products must be centred
        y = x @ np.arange(1, k + 1) + rng.normal(size=n) + 5
        out.append((x, y))
    return out


def frame(spark, data):
    k = data[0][0].shape[1]
    rows = [(g, i, float(y[i]), *map(float, x[i])) for g, (x, y) in enumerate(data) for i in range(len(y))]
    return spark.createDataFrame(rows, "g int, i int, y double, " + ", ".join(f"x{j} double" for j in range(k)))


def numpy_ols(x, y):
    X = np.column_stack([np.ones(len(y)), x])
    co, *_ = np.linalg.lstsq(X, y, rcond=None)
    r = y - X @ co
    se = np.sqrt(np.diag(r @ r / (len(y) - X.shape[1]) * np.linalg.pinv(X.T @ X)))
    return co, se, 1 - r @ r / ((y - y.mean()) ** 2).sum()


@pytest.mark.parametrize("k", [1, 2, 3, 4, 5])
def test_grouped_fit_equals_lstsq(spark, k):
    data = sample(40, k, k, groups=2)
    names = [f"x{j}" for j in range(k)]
    out = {r.g: r for r in regression.ols(frame(spark, data), "y", names, ["g"]).collect()}
    for g, (x, y) in enumerate(data):
        co, se, r2 = numpy_ols(x, y)
        assert out[g].b0 == pytest.approx(co[0], rel=1e-6) and out[g].se0 == pytest.approx(se[0], rel=1e-6)
        for j, n in enumerate(names):
            assert out[g][f"b_{n}"] == pytest.approx(co[j + 1], rel=1e-7)
            assert out[g][f"se_{n}"] == pytest.approx(se[j + 1], rel=1e-6)
        assert out[g].r2 == pytest.approx(r2)


def test_missing_rows_drop_and_small_groups_are_null(spark):
    df = spark.createDataFrame([(1, 1.0, 1.0), (1, 2.0, 2.0), (1, None, 3.0), (1, 3.0, 3.5), (2, 1.0, 1.0)], "g int, y double, x double")
    out = {r.g: r for r in regression.ols(df, "y", ["x"], ["g"]).collect()}
    assert out[1].n == 3 and out[1].b_x is not None
    assert out[2].b_x is None and out[2].se_x is None


def test_singular_design_is_null(spark):
    df = spark.createDataFrame([(float(i), float(i), 2.0 * i) for i in range(10)], "y double, a double, b double")
    r = regression.ols(df, "y", ["a", "b"]).first()
    assert r.b_a is None and r.b_b is None


def test_no_intercept_r2_is_centred_and_can_be_negative(spark):
    df = spark.createDataFrame([(10.0, 1.0), (11.0, -1.0), (12.0, 1.0)], "y double, x double")
    r = regression.ols(df, "y", ["x"], intercept=False).first()
    assert r.b_x == pytest.approx(11 / 3) and r.r2 < 0


def test_rolling_and_expanding_windows(spark):
    (x, y), = sample(30, 2, 3)
    df = frame(spark, [(x, y)])
    names = ["x0", "x1"]
    roll = regression.ols_window(df, "y", names, W.orderBy("i").rowsBetween(-11, 0), ["i"])
    past = regression.ols_window(df, "y", names, W.orderBy("i").rowsBetween(W.unboundedPreceding, -1), ["i"])
    r = {v.i: v for v in roll.collect()}
    p = {v.i: v for v in past.collect()}
    assert r[20].b_x1 == pytest.approx(numpy_ols(x[9:21], y[9:21])[0][2], rel=1e-6)
    assert p[20].b_x0 == pytest.approx(numpy_ols(x[:20], y[:20])[0][1], rel=1e-6)
    assert p[0].b_x0 is None


def test_leave_one_out_equals_refit(spark):
    (x, y), = sample(15, 3, 4)
    out = {r.i: r for r in regression.leave_one_out(frame(spark, [(x, y)]), "y", ["x0", "x1", "x2"], ["i"]).collect()}
    for i in (0, 7, 14):
        keep = np.arange(15) != i
        co = numpy_ols(x[keep], y[keep])[0]
        assert out[i].b_x1 == pytest.approx(co[2], rel=1e-6)


def test_condition_number_equals_numpy(spark):
    (x, y), = sample(24, 3, 6)
    df = frame(spark, [(x - 100, y)]).selectExpr("i AS mi", "i AS yyyymm", "y AS dpmms", "x0 AS dy2", "x1 AS dy5", "x2 AS dy10")
    r = rates_study.rolling_pass_through(df, 24, 3).first()
    assert r.cond == pytest.approx(np.linalg.cond(x - 100), rel=1e-8)


def test_clustered_errors_equal_the_sandwich(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 2))
    y = x @ [1.0, -2.0] + rng.normal(size=60)
    g = np.repeat(np.arange(12), 5)
    X = np.column_stack([np.ones(60), x])
    inv = np.linalg.inv(X.T @ X)
    co = inv @ X.T @ y
    e = y - X @ co
    scores = np.array([(X[g == k] * e[g == k, None]).sum(0) for k in range(12)])
    tc = co / np.sqrt(np.diag(inv @ scores.T @ scores @ inv))
    tp = co / np.sqrt(np.diag(inv @ (X.T @ (e[:, None] ** 2 * X)) @ inv))
    df = spark.createDataFrame([(int(g[i]), float(y[i]), float(x[i, 0]), float(x[i, 1])) for i in range(60)], "g int, y double, a double, b double")
    out = {r.term: r for r in factors.clustered_errors(df, "y", ["a", "b"], "g").collect()}
    for j, n in enumerate(["one", "a", "b"]):
        assert out[n].t_cluster == pytest.approx(tc[j]) and out[n].t_plain == pytest.approx(tp[j])


def test_level_slope_with_a_flat_month(spark):
    data = [(1, 1, 0.10, 0.12, 0.0), (1, 1, 0.20, 0.22, 0.0), (1, 1, 0.30, 0.32, 0.0), (2, 2, 0.1, 0.1, 0.0), (2, 2, 0.2, 0.3, 1.0), (2, 2, 0.3, 0.5, 2.0), (3, 3, 0.1, 0.1, 0.5)]
    df = spark.createDataFrame(data, "yyyymm int, mi int, forecast_cpr double, realized_cpr double, incentive double")
    out = {r.yyyymm: r for r in factors.level_slope_factors(df).collect()}
    assert out[1].f_level == pytest.approx(0.02) and out[1].f_slope == 0.0
    assert out[2].f_slope == pytest.approx(0.1) and 3 not in out


def test_scaling_the_factors_leaves_t_unchanged(spark):
    rng = np.random.default_rng(8)
    fac = [(m, m, float(rng.normal()), float(rng.normal())) for m in range(40)]
    ret = [(m, float(c), float(0.3 * c * fac[m][2] + 0.1 * c * c * fac[m][3] + rng.normal() * 0.1)) for m in range(40) for c in range(1, 8)]
    f = spark.createDataFrame(fac, "yyyymm int, mi int, f_level double, f_slope double")
    r = spark.createDataFrame(ret, "yyyymm int, coupon double, excess_return double")

    def t(ff):
        lam = factors.fama_macbeth_empirical(r, factors.empirical_betas(r, ff), rho_max=0.999)
        return regression.one_sample_t(lam, "lambda_x").first()

    a, b = t(f), t(f.withColumn("f_level", F.col("f_level") * 10))
    assert a.t == pytest.approx(b.t, rel=1e-6) and a.n == 40


def test_collinear_loadings_fall_back_to_one_factor(spark):
    betas = spark.createDataFrame([(float(c), float(c), 2.0 * c + 1e-6 * c * c) for c in range(1, 7)], "coupon double, b_x double, b_y double")
    r = spark.createDataFrame([(m, float(c), 0.5 * c) for m in range(3) for c in range(1, 7)], "yyyymm int, coupon double, excess_return double")
    out = factors.fama_macbeth_empirical(r, betas).collect()
    assert len(out) == 3 and all(v.mode == "single_factor" and v.lambda_y is None and v.lambda_x == pytest.approx(0.5) for v in out)


def cells(spark, months=60, coupons=6, seed=3):
    rng = np.random.default_rng(seed)
    rows = []
    for m in range(months):
        for c in range(coupons):
            inc = float(rng.uniform(-3, 2))
            f = float(1 / (1 + np.exp(-(-2 + 0.5 * inc + 0.2 * rng.normal()))))
            y = float(1 / (1 + np.exp(-(-0.2 + 1.1 * np.log(f / (1 - f)) + 0.05 * inc + 0.2 * rng.normal()))))
            rows.append((2.5 + 0.5 * c, 201000 + m, m, f, y, float(rng.uniform(1, 9)), inc))
    return rows, spark.createDataFrame(rows, "coupon double, yyyymm int, mi int, forecast_cpr double, cpr_upb double, upb_atrisk double, inc double")


@pytest.mark.parametrize("spec", list(mapping.SMOOTH))
def test_expanding_maps_equal_weighted_lstsq(spark, spec):
    rows, df = cells(spark)
    out = mapping.search(mapping.cells(df), [spec], min_months=24).filter("mi = 50").collect()
    a = np.array(rows)
    family, names = mapping.SMOOTH[spec]
    tr = (lambda v: np.log(v)) if family == "log" else (lambda v: np.log(v / (1 - v)))
    back = np.exp if family == "log" else (lambda v: 1 / (1 + np.exp(-v)))

    def design(b):
        t, inc = tr(b[:, 3]), b[:, 6]
        cols = {"t": t, "inc": inc, "inc2": inc ** 2, "inc_t": inc * t}
        return np.column_stack([np.ones(len(b)), *[cols[n] for n in names]])

    hist, test = a[a[:, 2] < 49], a[a[:, 2] == 50]
    s = np.sqrt(hist[:, 5] / hist[:, 5].mean())
    beta, *_ = np.linalg.lstsq(design(hist) * s[:, None], tr(hist[:, 4]) * s, rcond=None)
    want = {c: v for c, v in zip(test[:, 0], back(design(test) @ beta))}
    assert len(out) == 6
    for r in out:
        assert r.mapped_cpr == pytest.approx(want[r.coupon], rel=1e-6)


def test_bucketed_map_falls_back_to_the_pooled_line(spark):
    rows, df = cells(spark)
    sub = [r for r in rows if r[6] <= 1.5 or r[2] >= 48]  # almost no history above 1.5
    df = spark.createDataFrame(sub, df.schema)
    out = mapping.search(mapping.cells(df), ["logit", "bucketed_logit"], min_months=24).filter("mi = 50")
    pairs = {}
    for r in out.collect():
        pairs.setdefault((r.coupon, r.inc), {})[r.spec] = r.mapped_cpr
    top = [v for (c, inc), v in pairs.items() if inc > 1.5]
    low = [v for (c, inc), v in pairs.items() if -1.5 < inc < 1.5]
    assert all(v["logit"] == pytest.approx(v["bucketed_logit"]) for v in top)
    assert any(abs(v["logit"] - v["bucketed_logit"]) > 1e-6 for v in low)


def test_bucketed_map_equals_own_line(spark):
    rows, df = cells(spark, months=80)
    out = mapping.search(mapping.cells(df), ["bucketed_logit"], min_months=24).filter("mi = 70").collect()
    a = np.array(rows)
    lg = lambda v: np.log(v / (1 - v))
    edges = [-99.0, -2.5, -1.5, -0.5, 0.5, 1.5, 99.0]
    checked = 0
    for r in out:
        b = next(i for i in range(6) if edges[i] < r.inc <= edges[i + 1])
        h = a[(a[:, 2] < 69) & (a[:, 6] > edges[b]) & (a[:, 6] <= edges[b + 1])]
        if len(h) < mapping.MIN_BUCKET_N:
            continue
        s = np.sqrt(h[:, 5])
        X = np.column_stack([np.ones(len(h)), lg(h[:, 3])])
        co, *_ = np.linalg.lstsq(X * s[:, None], lg(h[:, 4]) * s, rcond=None)
        assert r.mapped_cpr == pytest.approx(1 / (1 + np.exp(-(co[0] + co[1] * lg(r.model_cpr)))), rel=1e-6)
        checked += 1
    assert checked >= 4


def test_asof_map_and_refusal(spark):
    rows, df = cells(spark)
    fit = {r.mi: r for r in mapping.fit_asof(df, min_months=36).collect()}
    assert min(fit) == 37 + 0 and fit[50].n_months == 49
    bad = df.withColumn("cpr_upb", 1 - F.col("cpr_upb"))
    with pytest.raises(Exception, match="slope"):
        mapping.refuse_negative_slope(mapping.fit_asof(bad)).collect()


def brute_scurve(x, y, floor=None):
    best = None
    for k in scurve.K_GRID:
        for x0 in scurve.X0_GRID:
            g = 1 / (1 + np.exp(-k * (x - x0)))
            fs = [floor] if floor is not None else np.linspace(*scurve.FLOOR_BOX, 300)
            for f in fs:
                s = np.clip((g @ (y - f * (1 - g))) / (g @ g), *scurve.SAT_BOX)
                sse = ((y - f - (s - f) * g) ** 2).sum()
                if best is None or sse < best[0]:
                    best = (sse, k, x0, f, s)
    return best


@pytest.mark.parametrize("shift", [0.0, -0.2])
def test_scurve_box_fit_beats_a_fine_grid(spark, shift):
    rng = np.random.default_rng(1)
    x = rng.uniform(-4, 2, 80)
    y = np.clip(0.05 + 0.2 / (1 + np.exp(-3 * (x - 0.4))) + rng.normal(size=80) * 0.01 + shift, -0.2, 1)
    df = spark.createDataFrame([("s", float(a), float(b)) for a, b in zip(x, y)], "s string, x double, y double")
    r = scurve.fit_by_scope(df, "x", "y", ["s"]).first()
    sse, k, x0, f, s = brute_scurve(x, y)
    g = 1 / (1 + np.exp(-r.k * (x - r.x0)))
    mine = ((y - r.floor - (r.sat - r.floor) * g) ** 2).sum()
    assert mine <= sse + 1e-12 and mine == pytest.approx(sse, rel=1e-3)
    assert 0.005 <= r.floor <= 0.15 and 0.05 <= r.sat <= 0.60


def test_scurve_asof_sees_only_the_past(spark):
    rng = np.random.default_rng(4)
    data = [(m, float(rng.uniform(-4, 2))) for m in range(30) for _ in range(5)]
    df = spark.createDataFrame([(m, x, float(0.05 + 0.2 / (1 + np.exp(-3 * (x - 0.4))))) for m, x in data], "mi int, x double, y double")
    wild = df.withColumn("y", F.when(F.col("mi") >= 20, 0.9).otherwise(F.col("y")))
    a = {r.mi: r for r in scurve.fit_asof(df, "x", "y").collect()}
    b = {r.mi: r for r in scurve.fit_asof(wild, "x", "y").collect()}
    assert a[20].sat == pytest.approx(b[20].sat) and a[25].sat != pytest.approx(b[25].sat)
    assert a[20].k == 3.0 and a[20].x0 == 0.4 and a[20].floor == pytest.approx(0.05)


def test_bootstrap_error_is_near_the_textbook_value(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(size=400)
    df = spark.createDataFrame([(f"k{i}", float(x), 1.0) for i, x in enumerate(v)], "k string, v double, w double")
    r = rates_study.bootstrap_mean(df, "v", "w", "k", 300).first()
    assert r.mean == pytest.approx(v.mean()) and r.se == pytest.approx(v.std() / 20, rel=0.15) and r.weighted_se == pytest.approx(r.se)


def test_guards_raise(spark):
    df = spark.createDataFrame([(3.5, 3.0), (4.25, 3.5)], "note_rate double, coupon double")
    with pytest.raises(Exception, match="offset"):
        quality.require(quality.spread_convention(df), quality.spread_ok(0.5), "offset mismatch").collect()
    dup = quality.duplicate_keys(spark.createDataFrame([(1,), (1,)], "k int"), ["k"])
    with pytest.raises(Exception, match="dup"):
        quality.require(dup, F.col("n_duplicated") == 0, "dup").collect()


def test_logit_fit_equals_newton_in_numpy(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(500, 3))
    y = (rng.random(500) < 1 / (1 + np.exp(-(0.3 + x @ [1.0, -0.5, 0.2])))).astype(float)
    w = rng.random(500) + 0.5
    b, design = np.zeros(4), np.c_[np.ones(500), x]
    for _ in range(30):
        p = 1 / (1 + np.exp(-design @ b))
        b = b + np.linalg.solve((design * (w * p * (1 - p))[:, None]).T @ design, design.T @ (w * (y - p)))
    df = spark.createDataFrame([(*map(float, r), float(t), float(v)) for r, t, v in zip(x, y, w)], "a double, b double, c double, y double, w double")
    assert regression.logit_fit(df, "y", ["a", "b", "c"], "w") == pytest.approx(b.tolist(), abs=1e-9)


def test_pair_vol_takes_the_next_coupon_that_is_present(spark):
    from tideline.plans.hedging import pair_vol

    data = [(200001 + m, c, float(np.sin(m * c))) for m in range(24) for c in (2.5, 3.0, 4.0)]  # 3.5 is missing
    got = {(r["hi"], r["lo"]): r["n"] for r in pair_vol(spark.createDataFrame(data, "yyyymm int, coupon double, hedged double")).collect()}
    assert got == {(3.0, 2.5): 24, (4.0, 3.0): 24, (4.0, 2.5): 24}


def test_a_planted_negative_slope_stops_the_job(spark):
    from tideline.plans import mapping

    fit = spark.createDataFrame([(1, 0.1, 0.9), (2, 0.1, -0.2)], "mi int, a double, b double")
    with pytest.raises(Exception, match="slope is not positive"):
        mapping.refuse_negative_slope(fit).collect()
