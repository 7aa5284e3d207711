"""2.F window, sequence and model-data operators."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from tideline.catalog.logitsql import logit_ctes
from tideline.catalog.memo import written
from tideline.catalog.registry import R, query, rnd
from tideline.catalog.selection import LABELS, RET, excess, labels
from tideline.catalog.survival import AGE, FVR, forecast_realized
from tideline.functions import periods, rates
from tideline.operators import joins, ordering, scoring, selection, sequences, series, survival
from tideline.plans import hazard
from tideline.plans.panel import feature_panel
from tideline.session import cut_lineage

COUPONS = [2.5, 3.0, 3.5, 4.0, 4.5, 5.0, 5.5, 6.0, 6.5]
# fixed values: a test score for survival curves, AUC and calibration
HAZARD = {"intercept": -5.2, "incentive": 0.9, "age": 0.02}


def event():
    return F.col("zbc") == 1


def features(fx):
    return feature_panel(fx.loan, fx.market_rate, fx.hpi)


FEAT = f"""ft AS MATERIALIZED (SELECT l.loan_id, l.yyyymm, l.vintage, l.zbc, l.upb, l.note_rate, l.note_rate - m.rate_30yr AS refi_incentive, l.fico::DOUBLE AS fico, l.ltv AS original_ltv,
 l.orig_upb / nullif((l.orig_upb / nullif(l.ltv/100, 0)) * (n.hpi / nullif(o.hpi, 0)), 0) * 100 AS current_ltv, l.orig_upb AS original_upb, ({AGE.replace('mi -', 'l.mi -')})::DOUBLE AS loan_age, l.dti::DOUBLE AS dti,
 CASE purpose WHEN 'C' THEN 1.0 WHEN 'P' THEN 2.0 ELSE 0.0 END::DOUBLE AS purpose_enc, CASE property_type WHEN 'PU' THEN 1 WHEN 'CO' THEN 2 WHEN 'MH' THEN 3 ELSE 0 END::DOUBLE AS property_enc,
 CAST(max(CASE WHEN zbc = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY loan_id) AS BIGINT) AS prepaid
 FROM f_loan l LEFT JOIN f_market_rate m ON l.yyyymm = m.yyyymm LEFT JOIN f_hpi o ON l.zip3=o.zip3 AND l.orig_ym=o.yyyymm LEFT JOIN f_hpi n ON l.zip3=n.zip3 AND l.yyyymm=n.yyyymm)"""
STEPS = """s AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY loan_id ORDER BY yyyymm) AS r FROM f_loan),
k AS MATERIALIZED (SELECT *, r - 1 AS t FROM s WHERE r <= 33),
e AS MATERIALIZED (SELECT loan_id, coalesce(min(CASE WHEN zbc = 1 THEN t END), -1) AS event_step, max(t) AS mt FROM k GROUP BY 1)"""


@query("F1_timestep", "f_loan", f"WITH {STEPS} SELECT loan_id, yyyymm, t FROM k")
def _(fx):
    return rnd(sequences.timesteps(fx.loan).select("loan_id", "yyyymm", "t"))


NAMES = ", ".join(sequences.FEATURES)


@query("F2_build_sequences", "f_loan f_market_rate f_hpi", f"""WITH {FEAT},
s AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY loan_id ORDER BY yyyymm) AS r FROM ft WHERE {" AND ".join(f"{f} IS NOT NULL" for f in sequences.FEATURES)}),
g AS (SELECT loan_id, max(prepaid)::DOUBLE AS label, coalesce(min(CASE WHEN zbc = 1 THEN r - 1 END), -1) AS event_step FROM s WHERE r <= 33 GROUP BY 1),
x AS (SELECT g.loan_id, label, event_step, t FROM g, (SELECT unnest(range(0, 33)) AS t))
SELECT x.loan_id, label, event_step, CAST(x.t AS BIGINT) AS t, r IS NOT NULL AS mask, {", ".join(f"{R(f'coalesce({f}, 0)', 4)} AS {f}" for f in sequences.FEATURES)} FROM x LEFT JOIN s ON s.loan_id = x.loan_id AND s.r = x.t + 1""")
def _(fx):
    """Padded nine-feature matrix and mask of every loan, one row per step."""
    seq = sequences.build_sequences(features(fx), sequences.FEATURES, event(), dtype="double")
    rows = seq.select("loan_id", "label", "event_step", F.posexplode(F.arrays_zip("mask", "seq")).alias("t", "s"))
    cells = [F.col("s.seq")[i].alias(f) for i, f in enumerate(sequences.FEATURES)]
    return rnd(rows.select("loan_id", "label", "event_step", "t", "s.mask", *cells), 4)


@query("F3_event_step", "f_loan", f"WITH {STEPS} SELECT loan_id, min(t) AS event_step FROM k WHERE zbc = 1 GROUP BY 1")
def _(fx):
    return rnd(sequences.event_step(sequences.timesteps(fx.loan), event(), ["loan_id"]))


SCALED = ["refi_incentive", "original_ltv", "current_ltv", "dti"]


def scaled(fx):
    """Scaler fitted on vintages up to 1995, applied to all."""
    df = features(fx).na.drop(subset=SCALED)
    st = sequences.scaler_stats(df.filter("vintage <= '1995Q4'"), SCALED)
    return df, st


@query("F4_standard_scale", "f_loan f_market_rate f_hpi", f"""WITH {FEAT}, g AS (SELECT * FROM ft WHERE refi_incentive IS NOT NULL AND current_ltv IS NOT NULL),
st AS (SELECT {", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in SCALED)} FROM g WHERE vintage <= '1995Q4')
SELECT loan_id, yyyymm, {", ".join(f"{R(f'({c}-m_{c})/s_{c}')} AS {c}" for c in SCALED)} FROM g, st""")
def _(fx):
    df, st = scaled(fx)
    return rnd(sequences.scale(df, st, SCALED).select("loan_id", "yyyymm", *SCALED))


@query("F5_inverse_scale", "f_loan f_market_rate f_hpi", f"""WITH {FEAT} SELECT loan_id, yyyymm, {", ".join(f"{R(c)} AS {c}" for c in SCALED)} FROM ft WHERE refi_incentive IS NOT NULL AND current_ltv IS NOT NULL""")
def _(fx):
    df, st = scaled(fx)
    return rnd(sequences.unscale(sequences.scale(df, st, SCALED), st, SCALED).select("loan_id", "yyyymm", *SCALED))


HASH = "('0x' || substr(md5(CAST({0} AS VARCHAR) || '|42'), 1, 13))::BIGINT"


@query("F6_stratified_split", "f_loan", f"""WITH {LABELS}
SELECT loan_id, prepaid, CASE WHEN row_number() OVER (PARTITION BY prepaid ORDER BY {HASH.format('loan_id')}, loan_id) <= round(count(*) OVER (PARTITION BY prepaid)*0.8) THEN 'train' ELSE 'test' END AS split FROM lab""")
def _(fx):
    return selection.stratified_split(labels(fx), "prepaid", "loan_id").select("loan_id", "prepaid", "split")


def hazard_rows(fx):
    """First 33 observed months per loan with the linear hazard of that month."""
    df = joins.rate_lookup(sequences.timesteps(fx.loan), fx.market_rate, how="inner")
    z = rates.hazard_index(F.col("note_rate") - F.col("rate_30yr"), F.col("t") + 1, HAZARD)
    return df.withColumn("z", z).withColumn("h", rates.sigmoid("z"))


HAZ = f"""{STEPS}, hz AS (SELECT k.*, -5.2 + 0.9*(note_rate - rate_30yr) + 0.02*(t+1) AS z, 1/(1+exp(-(-5.2 + 0.9*(note_rate - rate_30yr) + 0.02*(t+1)))) AS h FROM k JOIN f_market_rate m ON k.yyyymm = m.yyyymm)"""


@query("F7_survival_cdf", "f_loan f_market_rate", f"WITH {HAZ} SELECT loan_id, count(*) AS n_steps, {R('1-exp(sum(ln(1-h)))', 8)} AS cdf FROM hz GROUP BY 1")
def _(fx):
    return rnd(sequences.survival_cdf(hazard_rows(fx), "h"), 8)


AUC_SQL = "r AS (SELECT *, rank() OVER (ORDER BY sc) + (count(*) OVER (PARTITION BY sc) - 1)/2.0 AS rk FROM q) SELECT CAST(sum(y) AS BIGINT) AS n_pos, CAST(sum(1-y) AS BIGINT) AS n_neg, " + R("(sum(rk*y) - sum(y)*(sum(y)+1)/2)/(sum(y)*sum(1-y))", 8) + " AS auc FROM r"


@query("F8_auc", "f_loan f_market_rate", f"WITH {HAZ}, {LABELS}, q AS (SELECT round(1-exp(sum(ln(1-h))), 10) AS sc, max(prepaid) AS y FROM hz JOIN lab USING (loan_id) GROUP BY loan_id), {AUC_SQL}")
def _(fx):
    cdf = sequences.survival_cdf(hazard_rows(fx), "h").withColumn("cdf", F.round("cdf", 10))
    return rnd(ordering.auc(cdf.join(labels(fx), "loan_id"), "cdf", "prepaid"), 8)


@query("F9_survival_curves", "f_path", f"""
WITH p AS (SELECT path_id, t, rate/210 AS p FROM f_path), c AS (SELECT *, exp(sum(ln(1-p)) OVER (PARTITION BY path_id ORDER BY t)) AS s FROM p)
SELECT path_id, CAST(t AS BIGINT) AS t, {R("s/(1-p)*p", 10)} AS hazard, {R("1-s", 10)} AS cdf, {R("s", 10)} AS survival FROM c""")
def _(fx):
    """One array fold per path, unfolded to (path, step) rows for the report."""
    out = sequences.survival_curves(fx.path.withColumn("p", F.col("rate") / 210), "p")
    z = F.arrays_zip("hazard", "cdf", "survival")
    return rnd(out.select("path_id", F.posexplode(z).alias("i", "r")).select(
        "path_id", (F.col("i") + 1).cast("bigint").alias("t"), "r.hazard", "r.cdf", "r.survival"), 10)


MODEL_FEATURES = sequences.FEATURES
HASH_SPLIT = f"""zf_lab AS (SELECT loan_id, CAST(max(CASE WHEN zbc=1 THEN 1 ELSE 0 END) AS BIGINT) AS prepaid FROM f_loan GROUP BY 1),
zf_split AS MATERIALIZED (SELECT loan_id, prepaid, CASE WHEN row_number() OVER (PARTITION BY prepaid ORDER BY {HASH.format('loan_id')}, loan_id) <= round(count(*) OVER (PARTITION BY prepaid)*0.8) THEN 'train' ELSE 'test' END AS split FROM zf_lab)"""
X = [f"x{i}" for i in range(1, 10)]
KNOWN = " AND ".join(f"{c} IS NOT NULL" for c in MODEL_FEATURES)
Z0 = "b0 + " + " + ".join(f"b{i}*({f}-m{i})/s{i}" for i, f in enumerate(MODEL_FEATURES, 1))
OTHERS = [i for i, f in enumerate(MODEL_FEATURES, 1) if f not in ("refi_incentive", "loan_age")]
I_INC, I_AGE = MODEL_FEATURES.index("refi_incentive") + 1, MODEL_FEATURES.index("loan_age") + 1
#: The fitted and calibrated index: hx has h0..h2 (cells) and g0..g9 (all features).
FIT = f"""{FEAT.replace('ft AS', 'zf_ft AS')}, {HASH_SPLIT},
zf_all AS MATERIALIZED (SELECT * FROM (SELECT f.* EXCLUDE (prepaid), split, row_number() OVER (PARTITION BY f.loan_id ORDER BY yyyymm) - 1 AS t FROM zf_ft f JOIN zf_split USING (loan_id) WHERE {KNOWN}) WHERE t < 33),
zf_e AS (SELECT loan_id, coalesce(min(t) FILTER (zbc = 1), -1) AS es, max(t) AS mt FROM zf_all GROUP BY 1),
zf_o AS MATERIALIZED (SELECT zf_all.*, es, CASE WHEN es >= 0 THEN es ELSE mt END AS last_t, CAST(t = es AS DOUBLE) AS y FROM zf_all JOIN zf_e USING (loan_id)),
zf_p AS (SELECT * FROM zf_o WHERE split = 'train' AND t <= last_t),
zf_n AS (SELECT count(DISTINCT loan_id) AS na, count(DISTINCT CASE WHEN es >= 0 THEN loan_id END) AS ne FROM zf_p),
zf_m AS MATERIALIZED (SELECT {", ".join(f"avg({f}) AS m{i}, stddev_pop({f}) AS s{i}" for i, f in enumerate(MODEL_FEATURES, 1))} FROM zf_p),
zf_w AS (SELECT zf_p.*, (CASE WHEN es >= 0 THEN 0.5/ne ELSE 0.0 END + 0.5/na)/(last_t + 1) AS w0 FROM zf_p, zf_n),
zf_r AS MATERIALIZED (SELECT y, w0/avg(w0) OVER () AS w, {", ".join(f"({f}-m{i})/s{i} AS x{i}" for i, f in enumerate(MODEL_FEATURES, 1))} FROM zf_w, zf_m),
{logit_ctes("zf_r", X, "zb")},
zf_z AS MATERIALIZED (SELECT y, 1.0 AS w, {Z0} AS x1 FROM zf_o, zf_m, zb12 WHERE split = 'train'),
{logit_ctes("zf_z", ["x1"], "zc")},
hx AS MATERIALIZED (SELECT a*(b0 {"".join(f" - b{i}*m{i}/s{i}" for i in (I_INC, I_AGE))}) + b AS h0, a*b{I_INC}/s{I_INC} AS h1, a*b{I_AGE}/s{I_AGE} AS h2,
 a*(b0 {"".join(f" - b{i}*m{i}/s{i}" for i in range(1, 10))}) + b AS g0, {", ".join(f"a*b{i}/s{i} AS g{i}" for i in range(1, 10))}
 FROM zb12, zf_m, (SELECT b0 AS b, b1 AS a FROM zc12))"""
FITV = "f_loan f_market_rate f_hpi"
INDEX_SQL = "(g0 + " + " + ".join(f"g{i}*{f}" for i, f in enumerate(MODEL_FEATURES, 1)) + ")"


def cell_index_sql(inc: str, age: str = "t") -> str:
    """Fitted index of a cell; the columns of hx must be in scope."""
    return f"(h0 + h1*({inc}) + h2*({age}))"


def known_steps(fx):
    """First 33 months with all nine features."""
    return sequences.timesteps(features(fx).na.drop(subset=MODEL_FEATURES)).drop("prepaid")


def split_steps(fx, split: str):
    ids = selection.stratified_split(labels(fx), "prepaid", "loan_id").filter(F.col("split") == split).select("loan_id")
    return known_steps(fx).join(ids, "loan_id")


def fitted(fx):
    """The hazard index fitted on the train loans, saved to the shared folder and
    read from there by every later query of the session."""

    def fit(path):
        # read for the fit, its weights and its calibration
        steps = cut_lineage(split_steps(fx, "train").select("loan_id", "t", "zbc", *MODEL_FEATURES))
        hazard.fit_index(sequences.person_period(steps, event()), sequences.observed_steps(steps, event()), MODEL_FEATURES).save(fx.spark, path)

    return hazard.HazardIndex.load(fx.spark, written(fx, "hazard-index", fit), MODEL_FEATURES)


def held_out_auc(fx, model):
    """AUC of the cumulative event probability on the held-out loans."""
    test = known_steps(fx).join(selection.stratified_split(labels(fx), "prepaid", "loan_id").filter("split = 'test'").select("loan_id"), "loan_id")
    scored = sequences.person_period(test, event()).withColumn("h", rates.sigmoid(model.index()))
    cdf = sequences.survival_cdf(scored, "h").withColumn("cdf", F.round("cdf", 10))
    return ordering.auc(cdf.join(labels(fx), "loan_id"), "cdf", "prepaid")


@query("F10_hazard_fit", FITV, f"""WITH {FIT},
q AS (SELECT round(1-exp(sum(ln(1-1/(1+exp(-{INDEX_SQL}))))), 10) AS sc, any_value(prepaid) AS y FROM zf_o JOIN zf_split USING (loan_id), hx WHERE zf_o.split = 'test' AND t <= last_t GROUP BY loan_id),
rk AS (SELECT *, rank() OVER (ORDER BY sc) + (count(*) OVER (PARTITION BY sc) - 1)/2.0 AS rk FROM q), au AS (SELECT (sum(rk*y) - sum(y)*(sum(y)+1)/2)/(sum(y)*sum(1-y)) AS auc FROM rk)
SELECT u.feature, {R("u.standard", 5)} AS standard, {R("u.coef", 8)} AS coef, {R("auc", 6)} AS test_auc FROM au, (
 SELECT unnest(['', {", ".join(f"'{f}'" for f in MODEL_FEATURES)}]) AS feature, unnest([b0, {", ".join(f"b{i}" for i in range(1, 10))}]) AS standard, unnest([g0, {", ".join(f"g{i}" for i in range(1, 10))}]) AS coef FROM zb12, hx) u""")
def _(fx):
    """Nine-feature logistic hazard: coefficients on standardised features, the
    calibrated raw-scale index, and its AUC on held-out loans."""
    m = fitted(fx)
    rows = [("", m.standard[0], m.intercept)] + [(f, b, m.coef[f]) for f, b in zip(m.features, m.standard[1:])]
    table = fx.spark.createDataFrame(rows, "feature string, standard double, coef double")
    auc = held_out_auc(fx, m).select("auc")
    return rnd(table.withColumn("test_auc", auc.scalar()), 8, standard=5, test_auc=6)


@query("F10b_hazard_learners")
def _(fx):
    """Logistic (Spark ML) and boosted hazards on person-period rows, AUC by
    survival CDF on the held-out loans."""
    split = selection.stratified_split(labels(fx), "prepaid", "loan_id")
    steps = sequences.person_period(known_steps(fx), event())
    return rnd(hazard.hazard_comparison(steps, split, MODEL_FEATURES))


SNAP = ["fico", "original_ltv", "dti", "loan_age", "refi_incentive", "current_ltv", "original_upb"]


def snapshot_rows(fx):
    """Last known features of each loan with label, region and split."""
    snap = survival.last_known(features(fx), SNAP).na.drop()
    region = fx.table("customer").select(F.col("c_custkey").alias("loan_id"), F.col("c_nationkey").cast("double").alias("zip3"))
    df = snap.join(labels(fx), "loan_id").join(region, "loan_id")
    return selection.stratified_split(df, "prepaid", "loan_id")


SETS = {"base": SNAP, "with_region": [*SNAP, "zip3"]}


def snap_fit_sql(name: str, cols: list[str]) -> str:
    """Standardised balanced logistic on the train loans and its test AUC."""
    xs = [f"x{i}" for i in range(1, len(cols) + 1)]
    z = "b0 + " + " + ".join(f"b{i}*({c}-m{i})/s{i}" for i, c in enumerate(cols, 1))
    return f"""{name}m AS MATERIALIZED (SELECT avg(prepaid) AS pm, {", ".join(f"avg({c}) AS m{i}, stddev_samp({c}) AS s{i}" for i, c in enumerate(cols, 1))} FROM sn WHERE split = 'train'),
{name}r AS MATERIALIZED (SELECT prepaid::DOUBLE AS y, CASE WHEN prepaid = 1 THEN 0.5/pm ELSE 0.5/(1-pm) END AS w, {", ".join(f"({c}-m{i})/s{i} AS x{i}" for i, c in enumerate(cols, 1))} FROM sn, {name}m WHERE split = 'train'),
{logit_ctes(name + "r", xs, name + "b")},
{name}q AS (SELECT round({z}, 9) AS sc, prepaid AS y FROM sn, {name}m, {name}b12 WHERE split = 'test'),
{name}k AS (SELECT *, rank() OVER (ORDER BY sc) + (count(*) OVER (PARTITION BY sc) - 1)/2.0 AS rk FROM {name}q)"""


def last_sql(c: str) -> str:
    return f"arg_max({c}, yyyymm) AS {c}"


@query("F11_snapshot_models", FITV, f"""WITH {FEAT}, {HASH_SPLIT},
lk AS (SELECT loan_id, {", ".join(last_sql(c) for c in SNAP)} FROM ft GROUP BY 1),
sj AS (SELECT lk.*, c_nationkey::DOUBLE AS zip3, prepaid FROM lk JOIN zf_lab USING (loan_id) JOIN customer ON c_custkey = loan_id WHERE {" AND ".join(f"{c} IS NOT NULL" for c in SNAP)}),
sn AS MATERIALIZED (SELECT *, CASE WHEN row_number() OVER (PARTITION BY prepaid ORDER BY {HASH.format('loan_id')}, loan_id) <= round(count(*) OVER (PARTITION BY prepaid)*0.8) THEN 'train' ELSE 'test' END AS split FROM sj),
{", ".join(snap_fit_sql("s" + n[0], c) for n, c in SETS.items())}
{" UNION ALL ".join(f"SELECT '{n}' AS features, 'logistic' AS model, CAST(sum(y) AS BIGINT) AS n_pos, CAST(sum(1-y) AS BIGINT) AS n_neg, {R('(sum(rk*y) - sum(y)*(sum(y)+1)/2)/(sum(y)*sum(1-y))', 5)} AS auc FROM s{n[0]}k" for n in SETS)}""")
def _(fx):
    """Balanced logistic on last-observation rows, with and without the region."""
    return rnd(hazard.snapshot_models(snapshot_rows(fx), SETS, kinds=("logistic",)), 5)


@query("F11b_snapshot_learners")
def _(fx):
    """Forest, boosting and net on the same rows."""
    return rnd(hazard.snapshot_models(snapshot_rows(fx), SETS, kinds=("random_forest", "boosted_trees", "perceptron")))


@query("F12_person_period", "f_loan", f"WITH {STEPS} SELECT loan_id, t, CAST(t = event_step AS BIGINT) AS y FROM k JOIN e USING (loan_id)")
def _(fx):
    return rnd(sequences.observed_steps(sequences.timesteps(fx.loan), event()).select("loan_id", "t", "y"))


def newton_sql(rows: str) -> str:
    """Logistic regression of y on x by 25 Newton steps over grouped rows."""
    return f"""{rows}, nt(i, a, b) AS (SELECT 0, 0.0::DOUBLE, 0.0::DOUBLE UNION ALL
 SELECT i+1, a + (hbb*ga - hab*gb)/(haa*hbb-hab*hab), b + (haa*gb - hab*ga)/(haa*hbb-hab*hab) FROM (
  SELECT any_value(i) AS i, any_value(a) AS a, any_value(b) AS b, sum(n*x*(y-p)) AS ga, sum(n*(y-p)) AS gb, sum(n*x*x*p*(1-p)) AS haa, sum(n*x*p*(1-p)) AS hab, sum(n*p*(1-p)) AS hbb
  FROM (SELECT nt.i, nt.a, nt.b, g.x, g.y, g.n, 1/(1+exp(-(nt.a*g.x+nt.b))) AS p FROM nt, g WHERE nt.i < 25) q HAVING count(*) > 0) z)
"""


@query("F13_platt_fit", "f_loan f_market_rate", newton_sql(f"WITH RECURSIVE {HAZ}, g AS MATERIALIZED (SELECT z AS x, CAST(t = event_step AS DOUBLE) AS y, count(*)::DOUBLE AS n FROM hz JOIN e USING (loan_id) GROUP BY 1, 2)")
       + f"SELECT {R('a', 4)} AS a, {R('b', 4)} AS b, 'loan_step' AS calibration_target FROM nt WHERE i = 25")
def _(fx):
    steps = sequences.observed_steps(hazard_rows(fx), event())
    return rnd(hazard.platt_fit(steps, "z", "y", "loan_step"), 4)


@query("F13b_platt_fit_loan", "f_loan f_market_rate", newton_sql(f"WITH RECURSIVE {HAZ}, {LABELS}, g AS MATERIALIZED (SELECT 1-exp(sum(ln(1-h))) AS x, max(prepaid)::DOUBLE AS y, 1.0::DOUBLE AS n FROM hz JOIN lab USING (loan_id) GROUP BY loan_id)")
       + f"SELECT {R('a', 4)} AS a, {R('b', 4)} AS b, 'loan' AS calibration_target FROM nt WHERE i = 25")
def _(fx):
    cdf = sequences.survival_cdf(hazard_rows(fx), "h").join(labels(fx), "loan_id")
    return rnd(hazard.platt_fit(cdf, "cdf", "prepaid", "loan"), 4)


@query("F14_reliability_table", "f_loan f_market_rate", f"""WITH {HAZ}, q AS MATERIALIZED (SELECT round(1/(1+exp(-(0.8*z-1.0))), 10) AS p, CAST(t = event_step AS DOUBLE) AS y FROM hz JOIN e USING (loan_id)),
ed AS (SELECT {", ".join(f"quantile_cont(p, {i/10}) AS q{i}" for i in range(1, 10))} FROM q)
SELECT CAST({" + ".join(f"(p >= q{i})::INT" for i in range(1, 10))} AS BIGINT) AS bin, count(*) AS n, {R("avg(p)", 8)} AS mean_pred, {R("avg(y)", 8)} AS mean_actual FROM q, ed GROUP BY 1""")
def _(fx):
    steps = sequences.observed_steps(hazard_rows(fx), event())
    df = steps.withColumn("p", F.round(rates.platt("z", 0.8, -1.0), 10))
    return rnd(scoring.reliability_table(df, "p", "y"), 8)


BASE = [f for f in MODEL_FEATURES if f not in ("refi_incentive", "current_ltv", "loan_age")]


@query("F15_score_grid", FITV, f"""WITH {FIT}, b AS (SELECT {", ".join(f"avg({f}) AS {f}" for f in BASE)} FROM zf_ft),
g AS (SELECT *, {INDEX_SQL} AS z FROM b, hx, (SELECT unnest([-2.0,-1,0,1,2])::DOUBLE AS refi_incentive), (SELECT unnest([60.0,80,100])::DOUBLE AS current_ltv), (SELECT unnest([6.0,18,30])::DOUBLE AS loan_age))
SELECT refi_incentive, current_ltv, loan_age, {R("1/(1+exp(-z))", 8)} AS hazard, {R("1-pow(1-1/(1+exp(-z)),12)", 7)} AS cpr FROM g""")
def _(fx):
    """Response surface of the fitted index at the panel's mean loan."""
    base = features(fx).agg(*[F.avg(f).alias(f) for f in BASE])
    axes = {"refi_incentive": [-2, -1, 0, 1, 2], "current_ltv": [60, 80, 100], "loan_age": [6, 18, 30]}
    return rnd(hazard.score_grid(base, axes, fitted(fx)).select(*axes, "hazard", "cpr"), 8, cpr=7)


def cell_path_sql(inc: str, start: str = "0") -> str:
    return f"list_transform(range(1, 34), lambda t: 1-pow(1-1/(1+exp(-(h0+h1*({inc})+h2*({start}+t)))),12))"


@query("F16_coupon_forecast", FITV, f"""WITH {FIT} SELECT yyyymm, coupon, {R("coupon+0.5-rate_30yr")} AS incentive, {R("list_avg(" + cell_path_sql("coupon+0.5-rate_30yr") + ")")} AS forecast_cpr
FROM f_market_rate, hx, (SELECT unnest({COUPONS})::DOUBLE AS coupon)""")
def _(fx):
    out = hazard.coupon_forecast(fx.market_rate, COUPONS, fitted(fx).cell(), rates.SERVICING_SPREAD)
    return rnd(out.select("yyyymm", "coupon", "incentive", "forecast_cpr"))


def at_sql(inc: str) -> str:
    return f"1-pow(1-1/(1+exp(-(h0+h1*({inc})+h2*t))),12)"


@query("F17_rate_sensitivity", FITV + " f_path", f"""WITH {FIT}, g AS (SELECT coupon, t, coupon+0.5-rate AS i, h0, h1, h2 FROM f_path, hx, (SELECT unnest({COUPONS})::DOUBLE AS coupon)),
c AS (SELECT coupon, {at_sql("i")} AS b, {at_sql("i+0.25")} AS u, {at_sql("i-0.25")} AS d, {at_sql("0")} AS z FROM g)
SELECT coupon, {R("avg(b)")} AS mean_cpr, {R("avg(z)")} AS atm_cpr, {R("(avg(u)-avg(d))/0.5")} AS rate_sens FROM c GROUP BY 1""")
def _(fx):
    return rnd(hazard.rate_sensitivity(fx.path, COUPONS, fitted(fx).cell(), rates.SERVICING_SPREAD))


@query("F18_population_forecast", FITV, f"""WITH {FIT}, a AS (SELECT loan_id, arg_max_null(upb, yyyymm) AS upb, arg_max_null(note_rate, yyyymm) AS nr, min(orig_ym) AS o FROM f_loan WHERE yyyymm <= 199906 GROUP BY 1),
p AS (SELECT upb, nr, (1999 - o//100)*12 + 6 - o%100 AS age, (SELECT max(rate_30yr) FROM f_market_rate WHERE yyyymm = 199906) AS m, h0, h1, h2 FROM a, hx WHERE upb > 0)
SELECT round_even((nr-0.5)*2,0)/2 AS coupon, count(*) AS n_loans, {R("sum(upb)", 2)} AS upb, {R("sum(upb*list_avg(" + cell_path_sql("nr-m", "age") + "))/sum(upb)")} AS forecast_cpr FROM p GROUP BY 1""")
def _(fx):
    return rnd(hazard.population_forecast(fx.loan, fx.market_rate, fitted(fx).cell(), 199906), upb=2)


@query("E28_rolling_forecast_cpr", FITV, f"""
WITH {FIT}, a AS (SELECT loan_id, arg_min(note_rate, yyyymm) AS note, max(CASE WHEN zbc = 1 THEN 1.0 ELSE 0 END) AS realized FROM f_loan WHERE yyyymm BETWEEN 199901 AND 199912 GROUP BY 1),
h AS (SELECT loan_id, 1/(1+exp(-{INDEX_SQL})) AS h, row_number() OVER (PARTITION BY loan_id ORDER BY yyyymm DESC) AS rd FROM zf_ft, hx WHERE yyyymm <= 199812)
SELECT round_even((note-0.5)*2,0)/2 AS coupon, count(*) AS n_loans, CAST(sum(realized) AS BIGINT) AS n_prepaid, {R("100*avg(1-pow(1-least(greatest(h,0),1-1e-7),12))", 4)} AS forecast_cpr, {R("100*avg(realized)", 4)} AS realized_cpr
FROM h JOIN a USING (loan_id) WHERE rd = 1 GROUP BY 1""")
def _(fx):
    """Fitted hazard at each loan's last month up to the cutoff against next-year payoffs."""
    from tideline.plans.forecasts import rolling_forecast

    scored = features(fx).withColumn("h", rates.sigmoid(fitted(fx).index()))
    return rnd(rolling_forecast(scored, cutoff_year=1998), 4)


# ------------------------------------------------------------ series operators


@query("F19_pct_change_total_return", "f_price f_curve_daily f_market_rate", f"WITH {RET} SELECT coupon, yyyymm, {R('total_return', 9)} AS total_return FROM tr")
def _(fx):
    return rnd(series.total_returns(fx.price).select("coupon", "yyyymm", "total_return"), 9)


@query("F20_treasury_return", "f_price f_curve_daily f_market_rate", f"WITH {RET} SELECT yyyymm, {R('dy_avg', 9)} AS dy_avg, {R('treasury_return', 12)} AS treasury_return FROM ts")
def _(fx):
    me = series.month_end(fx.curve_daily, ["y5", "y10"])
    return rnd(series.treasury_returns(me).select("yyyymm", "dy_avg", "treasury_return"), 9, treasury_return=12)


@query("F21_diff", "f_price", f"SELECT coupon, yyyymm, {R('price - lag(price) OVER (PARTITION BY coupon ORDER BY mi)')} AS d_price FROM f_price")
def _(fx):
    return rnd(fx.price.select("coupon", "yyyymm", series.diff("price", by=["coupon"]).alias("d_price")))


@query("F22_rolling_windows", "f_market_rate", f"""WITH d AS (SELECT mi, rate_30yr, lead(rate_30yr) OVER (ORDER BY mi) - rate_30yr AS ch FROM f_market_rate),
n AS (SELECT mi, rate_30yr, (ch - avg(ch) OVER ())/stddev_pop(ch) OVER () AS z, row_number() OVER (ORDER BY mi) AS rn, count(*) OVER () AS k FROM d WHERE ch IS NOT NULL),
w AS (SELECT mi, rate_30yr, z, list(z) OVER (ORDER BY mi ROWS BETWEEN CURRENT ROW AND 11 FOLLOWING) AS v, rn, k FROM n)
SELECT mi, rate_30yr AS start_rate, {R("v[1]")} AS w_first, {R("v[12]")} AS w_last, {R("list_sum(v)")} AS w_sum FROM w WHERE rn <= k - 11""")
def _(fx):
    """Overlapping 12-change windows of normalised rate changes, start rate kept."""
    from pyspark.sql import Window as W

    nxt = F.lead("rate_30yr").over(W.orderBy("mi"))
    d = fx.market_rate.withColumn("ch", nxt - F.col("rate_30yr")).filter(F.col("ch").isNotNull())
    st = d.agg(F.avg("ch").alias("m"), F.stddev_pop("ch").alias("s")).select(F.struct("*"))
    z = d.withColumn("_s", st.scalar()).withColumn("z", (F.col("ch") - F.col("_s.m")) / F.col("_s.s"))
    out = series.rolling_arrays(z, "z", 12, keep=["rate_30yr"])
    total = F.aggregate("window", F.lit(0.0), lambda a, x: a + x)
    return rnd(out.select("mi", F.col("rate_30yr").alias("start_rate"), F.col("window")[0].alias("w_first"), F.col("window")[11].alias("w_last"), total.alias("w_sum")))


@query("F23_gradient", "f_loan f_forecast", f"""{FVR}, b AS (SELECT floor(inc/0.25)*0.25 AS g, avg(inc) AS x, avg(cpr_upb) AS y FROM fr GROUP BY 1),
l AS (SELECT *, lag(x) OVER w AS x0, lead(x) OVER w AS x2, lag(y) OVER w AS y0, lead(y) OVER w AS y2 FROM b WINDOW w AS (ORDER BY g))
SELECT g, {R("CASE WHEN x0 IS NULL THEN (y2-y)/(x2-x) WHEN x2 IS NULL THEN (y-y0)/(x-x0) ELSE ((x-x0)*(x-x0)*y2 + ((x2-x)*(x2-x)-(x-x0)*(x-x0))*y - (x2-x)*(x2-x)*y0)/((x-x0)*(x2-x)*(x2-x0)) END")} AS slope FROM l""")
def _(fx):
    b = forecast_realized(fx).groupBy((F.floor(F.col("inc") / 0.25) * 0.25).alias("g")).agg(F.avg("inc").alias("x"), F.avg("cpr_upb").alias("y"))
    return rnd(b.select("g", series.gradient("x", "y", "g").alias("slope")))


@query("F24_cum_discount", "f_path", f"SELECT path_id, CAST(t AS BIGINT) AS t, {R('exp(sum(ln(1+rate/1200)) OVER (PARTITION BY path_id ORDER BY t))')} AS cum_disc FROM f_path")
def _(fx):
    return rnd(fx.path.select("path_id", "t", series.discount_factor(F.col("rate"), "t", ["path_id"]).alias("cum_disc")))


@query("F28_hist_spread", "f_market_rate f_curve_daily", f"""WITH me AS (SELECT yyyymm, arg_max(y10, d) AS y10 FROM f_curve_daily GROUP BY 1), s AS (SELECT m.yyyymm, rate_30yr - y10 AS sp FROM f_market_rate m JOIN me USING (yyyymm))
SELECT coalesce(CAST(decade AS VARCHAR), 'all') AS decade, count(*) AS n, {R("avg(sp)", 12)} AS spread FROM (SELECT yyyymm//1000*10 AS decade, sp FROM s) GROUP BY GROUPING SETS ((decade), ())""")
def _(fx):
    me = series.month_end(fx.curve_daily, ["y10"]).select("yyyymm", "y10")
    s = fx.market_rate.join(F.broadcast(me), "yyyymm").withColumn("sp", F.col("rate_30yr") - F.col("y10"))
    out = s.withColumn("decade", F.floor(F.col("yyyymm") / 1000) * 10).rollup("decade").agg(F.count(F.lit(1)).alias("n"), F.avg("sp").alias("spread"))
    return rnd(out.withColumn("decade", F.coalesce(F.col("decade").cast("string"), F.lit("all"))), 12)


@query("F29_ar1_residualize", "f_price", f"""WITH l AS (SELECT *, lag(price) OVER (PARTITION BY coupon ORDER BY mi) AS pl FROM f_price), f AS (SELECT coupon, regr_slope(price, pl) AS rho, regr_intercept(price, pl) AS alpha FROM l GROUP BY 1)
SELECT coupon, yyyymm, {R("rho")} AS rho, {R("price - (alpha + rho*pl)")} AS resid FROM l JOIN f USING (coupon)""")
def _(fx):
    return rnd(series.ar1_residualize(fx.price, "price", by=["coupon"]).select("coupon", "yyyymm", "rho", "resid"))


@query("F30_lag1_autocorr", "f_price", f"""WITH l AS (SELECT *, lag(price) OVER (PARTITION BY coupon ORDER BY mi) AS pl FROM f_price)
SELECT coupon, count(*) AS n, {R("corr(price, pl)")} AS autocorr FROM l GROUP BY 1""")
def _(fx):
    return rnd(series.lag1_autocorr(fx.price, "price", by=["coupon"]))


@query("F31_standardize", "f_price", f"""SELECT coupon, yyyymm, {R("(price - avg(price) OVER ())/stddev_samp(price) OVER ()")} AS price_z FROM f_price""")
def _(fx):
    return rnd(series.standardize(fx.price, ["price"]).select("coupon", "yyyymm", "price_z"))
