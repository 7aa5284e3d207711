"""Expanding-window maps from model speed to realized speed.

Cells are (month, coupon): a bounded calendar table. History before each cutoff
is a running sum of month totals, so no cutoff is ever paired with every row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tideline.functions import bins, rates
from tideline.operators import regression
from tideline.session import cut_lineage

LO, HI = rates.CPR_LO, rates.CPR_HI

# fixed values: regressors per specification (t = transformed model speed)
SMOOTH = {
    "loglog": ("log", ["t"]),
    "loglog_inc": ("log", ["t", "inc"]),
    "loglog_interact": ("log", ["t", "inc", "inc_t"]),
    "loglog_quad": ("log", ["t", "inc", "inc2", "inc_t"]),
    "logit": ("logit", ["t"]),
    "logit_inc": ("logit", ["t", "inc"]),
    "logit_interact": ("logit", ["t", "inc", "inc_t"]),
    "logit_quad": ("logit", ["t", "inc", "inc2", "inc_t"]),
}
BUCKETED = {"bucketed": "log", "bucketed_logit": "logit"}
MIN_BUCKET_N = 20
MIN_MONTHS = 36
LAG_MONTHS = 1


def forward(family: str, c: Column) -> Column:
    return F.log(rates.clip(c, LO, HI)) if family == "log" else rates.logit(c)


def backward(family: str, v: Column) -> Column:
    return F.exp(v) if family == "log" else rates.sigmoid(v)


def cells(panel: DataFrame, zero_mode: str = "drop", eps: float = 0.002, min_weight: float = 0.0) -> DataFrame:
    """Usable cells: positive model speed, enough balance, zero speeds dropped or
    floored. ``panel``: coupon, yyyymm, mi, forecast_cpr, cpr_upb, upb_atrisk, inc."""
    df = panel.filter((F.col("forecast_cpr") > 0) & (F.col("upb_atrisk") >= min_weight))
    if zero_mode == "drop":
        df = df.filter(F.col("cpr_upb") > 0)
    else:
        df = df.withColumn("cpr_upb", F.greatest("cpr_upb", F.lit(eps)))
    return df.withColumn("inc_bucket", bins.bin_label("inc", bins.MAPPING_EDGES, bins.MAPPING_LABELS, "right"))


def _regressors(family: str) -> dict[str, Column]:
    t = forward(family, F.col("forecast_cpr"))
    return {"t": t, "inc": F.col("inc"), "inc2": F.col("inc") * F.col("inc"), "inc_t": F.col("inc") * t}


def weighted_history(
    df: DataFrame, y: Column, xs: dict[str, Column], weight: Column, by: list[str] = [],
    lag: int = LAG_MONTHS, min_months: int = MIN_MONTHS,
) -> DataFrame:
    """Weighted fit of y on xs using months < month - lag, for every month.

    Variables are centred on the grand weighted mean first (one scalar row), so
    the running cross-products keep their digits; the fit itself re-centres.
    """
    names = list(xs)
    mean = lambda c: F.sum(weight * c) / F.sum(weight)
    centre = df.agg(mean(y).alias("y"), *[mean(c).alias(n) for n, c in xs.items()]).select(F.struct("*"))
    base = df.withColumn("_c", centre.scalar())
    d = {n: c - F.col(f"_c.{n}") for n, c in xs.items()} | {"y": y - F.col("_c.y")}
    base = base.withColumns({f"_d_{n}": c for n, c in d.items()}).withColumn("_w", weight)
    sums = {"w": F.col("_w"), "cnt": F.lit(1)}
    keys = [*names, "y"]
    for i, a in enumerate(keys):
        sums[f"q_{a}"] = F.col("_w") * F.col(f"_d_{a}")
        for b in keys[i:]:
            sums[f"q_{a}_{b}"] = F.col("_w") * F.col(f"_d_{a}") * F.col(f"_d_{b}")
    hist = regression.expanding_history(base, "mi", lag, sums, by, {f"c_{k}": f"_c.{k}" for k in keys})
    n = F.col("cnt")
    per_w = lambda c: F.try_divide(c, F.nullif("w", F.lit(0.0)))
    cols = {"n": n, "my": F.col("c_y") + per_w(F.col("q_y"))}
    second = lambda a, b: F.col(f"q_{a}_{b}") - per_w(F.col(f"q_{a}") * F.col(f"q_{b}"))
    cols["yy"] = second("y", "y")
    cols["tss"] = cols["yy"]
    for i, a in enumerate(names):
        cols[f"m_{a}"] = F.col(f"c_{a}") + per_w(F.col(f"q_{a}"))
        cols[f"sy_{a}"] = second(a, "y")
        for b in names[i:]:
            cols[f"s_{a}_{b}"] = second(a, b)
    framed = hist.select(*by, "mi", "n_months", *[c.alias(k) for k, c in cols.items()])
    framed = framed.filter(F.col("n_months") >= min_months) if min_months else framed
    fit = regression.solve(framed, names, len(names) + 1)
    b0 = F.col("my")
    for a in names:
        b0 = b0 - F.col(f"b_{a}") * F.col(f"m_{a}")
    return fit.select(*by, "mi", "n", "n_months", b0.alias("b0"), *[f"b_{a}" for a in names])


def fit_asof(panel: DataFrame, min_months: int = MIN_MONTHS, lag: int = LAG_MONTHS) -> DataFrame:
    """(intercept a, slope b) of the weighted logit map per month; a slope that is
    not positive is for ``refuse_negative_slope`` to stop, since it would invert
    bump responses. The cells are read twice, so they are checkpointed."""
    panel = cut_lineage(panel)
    df = panel.filter((F.col("forecast_cpr") > 0) & (F.col("cpr_upb") > 0))
    fit = regression.weighted_line(
        df, rates.logit("forecast_cpr"), rates.logit("cpr_upb"), F.col("upb_atrisk"), "mi", lag, min_months)
    return fit.filter(F.col("slope").isNotNull()).select(
        "mi", F.col("intercept").alias("a"), F.col("slope").alias("b"), "n_months", "n_train")


def refuse_negative_slope(fit: DataFrame) -> DataFrame:
    ok = F.when(F.col("b") > 0, F.col("b")).otherwise(
        F.raise_error(F.lit("mapping slope is not positive")).cast("double"))
    return fit.withColumn("b", ok)


# fixed values of the safety screen: slice of incentive, widening in log speed, points and least cells of a slice
SUPPORT_STEP, SUPPORT_MARGIN, SUPPORT_POINTS, SUPPORT_CELLS = 0.25, 0.35, 40, 3
TERMS = ["t", "inc", "inc2", "inc_t"]


def coefficients(panel: DataFrame, specs: list[str] | None = None, min_months: int = MIN_MONTHS, lag: int = LAG_MONTHS, by: list[str] = []) -> DataFrame:
    """Every specification's map as of every scored month: spec, family, mi, inc_bucket (NULL: all), b0 and one slope per
    term. ``by`` keys panels of their own (a sweep's grid column)."""
    specs = specs or ["identity", *SMOOTH, *BUCKETED]
    w = F.col("upb_atrisk")
    history = lambda family, names: weighted_history(
        panel, forward(family, F.col("cpr_upb")), {n: c for n, c in _regressors(family).items() if n in names}, w, by, lag, min_months)
    shape = lambda df, spec, family, bucket, b0, slopes: df.select(
        *by, "mi", F.lit(spec).alias("spec"), F.lit(family).alias("family"), bucket.alias("inc_bucket"), b0.alias("b0"),
        *[slopes.get(n, F.lit(0.0)).alias(f"b_{n}") for n in TERMS])
    parts = []
    for spec in specs:
        if spec == "identity":
            parts.append(shape(history("log", ["t"]), spec, "identity", F.lit(None).cast("string"), F.lit(0.0), {"t": F.lit(1.0)}))
        elif spec in SMOOTH:
            family, names = SMOOTH[spec]
            parts.append(shape(history(family, names), spec, family, F.lit(None).cast("string"), F.col("b0"), {n: F.col(f"b_{n}") for n in names}))
        else:
            family = BUCKETED[spec]
            own = _bucket_history(panel, family, w, lag, by)
            pooled = history(family, ["t"]).select(*by, "mi", F.col("b0").alias("p0"), F.col("b_t").alias("p1"))
            each = pooled.withColumn("inc_bucket", F.explode(F.array(*[F.lit(x) for x in bins.MAPPING_LABELS])))
            both = each.join(F.broadcast(own), [*by, "mi", "inc_bucket"], "left")
            enough = (F.col("n_cells") >= MIN_BUCKET_N) & F.col("o1").isNotNull()
            pick = lambda a, b: F.when(enough, F.col(a)).otherwise(F.col(b))
            parts.append(shape(both, spec, family, F.col("inc_bucket"), pick("o0", "p0"), {"t": pick("o1", "p1")}))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def applied(speed: Column, inc: Column) -> Column:
    """Mapped speed by the coefficients of the row."""
    value = lambda t: F.col("b0") + F.col("b_t") * t + F.col("b_inc") * inc + F.col("b_inc2") * (inc * inc) + F.col("b_inc_t") * (inc * t)
    on = lambda family: backward(family, value(forward(family, speed)))
    return F.when(F.col("family") == "identity", speed).when(F.col("family") == "log", on("log")).otherwise(on("logit"))


def search(panel: DataFrame, specs: list[str] | None = None, min_months: int = MIN_MONTHS, lag: int = LAG_MONTHS,
           by: list[str] = [], coefs: DataFrame | None = None) -> DataFrame:
    """Out-of-sample mapped speed of every specification for every scored cell:
    rows (spec, month, coupon) with mapped and realized speed, log error, weight.

    The cells come from the whole loan panel and every specification reads them,
    so they are checkpointed once.
    """
    panel = cut_lineage(panel) if coefs is None else panel
    coefs = coefficients(panel, specs, min_months, lag, by) if coefs is None else coefs
    named = coefs.withColumnRenamed("inc_bucket", "_bucket")
    cells_ = panel.select(*by, "yyyymm", "mi", "coupon", "inc", "inc_bucket", "forecast_cpr", "cpr_upb", "upb_atrisk")
    met = cells_.join(F.broadcast(named), [*by, "mi"]).filter(F.col("_bucket").isNull() | (F.col("_bucket") == F.col("inc_bucket")))
    out = met.withColumn("raw_cpr", applied(F.col("forecast_cpr"), F.col("inc")))
    clipped = rates.clip("raw_cpr", LO, HI)
    return out.select(
        *by, "spec", "yyyymm", "mi", "coupon", "inc", "inc_bucket", F.col("forecast_cpr").alias("model_cpr"),
        F.col("cpr_upb").alias("real_cpr"), clipped.alias("mapped_cpr"),
        (F.log("cpr_upb") - F.log(clipped)).alias("log_err"), F.col("upb_atrisk"),
        ((F.col("raw_cpr") >= 1) | (F.col("raw_cpr") <= 0)).alias("clamped"))


def support(panel: DataFrame) -> DataFrame:
    """Where a map must be sound: per slice of incentive (inc, the middle; inc_bucket) an array of model speeds between the
    least and the largest seen there, widened on both sides. Slices with few cells say nothing; the last border is open."""
    at = F.floor(F.col("inc") / SUPPORT_STEP)
    log = lambda c: F.log(c)
    slices = panel.groupBy(at.alias("slice")).agg(
        F.count(F.lit(1)).alias("n"), log(F.min("forecast_cpr")).alias("lo"), log(F.max("forecast_cpr")).alias("hi"))
    top = panel.agg(F.ceil(F.max("inc") / SUPPORT_STEP)).scalar()
    kept = slices.filter((F.col("n") >= SUPPORT_CELLS) & (F.col("slice") < top))
    wide = F.col("hi") - F.col("lo") + 2 * SUPPORT_MARGIN
    speeds = F.transform(F.sequence(F.lit(0), F.lit(SUPPORT_POINTS - 1)), lambda i: F.exp(F.col("lo") - SUPPORT_MARGIN + wide * i / (SUPPORT_POINTS - 1)))
    named = kept.select(((F.col("slice") + 0.5) * SUPPORT_STEP).alias("inc"), speeds.alias("speeds"))
    return named.withColumn("inc_bucket", bins.bin_label("inc", bins.MAPPING_EDGES, bins.MAPPING_LABELS, "right"))


def safety(panel: DataFrame, coefs: DataFrame) -> DataFrame:
    """Per specification: whether its map rises with the model speed and stays inside (0, 1) on the whole support at every
    cutoff, the cutoffs where it does not, and the incentive of the largest value outside.

    The support is one array row; each map of a cutoff reads it, and one fold over a slice's points finds both."""
    slices = support(panel).agg(F.collect_list(F.struct("inc", "inc_bucket", "speeds")).alias("s")).select("s")
    each = coefs.withColumnRenamed("inc_bucket", "_bucket").withColumn("_s", F.explode(slices.scalar()))
    each = each.filter(F.col("_bucket").isNull() | (F.col("_bucket") == F.col("_s.inc_bucket"))).select("*", F.col("_s.inc").alias("inc"), F.col("_s.speeds").alias("speeds"))
    state = lambda last, up, inside, top: F.struct(last.alias("last"), up.alias("up"), inside.alias("inside"), top.alias("top"))

    def step(acc, speed):
        v = applied(speed, F.col("inc"))
        rises = acc["last"].isNull() | (v > acc["last"])
        return state(v, acc["up"] & rises, acc["inside"] & (v > 0) & (v < 1), F.greatest(acc["top"], v))

    none = F.lit(None).cast("double")
    folded = each.withColumn("_f", F.aggregate("speeds", state(none, F.lit(True), F.lit(True), none), step)).filter(F.col("_f.last").isNotNull())
    by_cutoff = folded.groupBy("spec", "mi").agg(
        F.every("_f.up").alias("up"), F.every("_f.inside").alias("inside"),
        F.max(F.when(~F.col("_f.inside"), F.struct(F.col("_f.top").alias("top"), F.col("inc").alias("inc")))).alias("worst"))
    return by_cutoff.groupBy("spec").agg(
        F.every("up").alias("monotone"), F.every("inside").alias("in_range"), F.count_if(~F.col("up") | ~F.col("inside")).alias("n_unsafe"),
        F.max("worst")["inc"].alias("worst_inc"))


def best_safe(scores: DataFrame, screen: DataFrame) -> DataFrame:
    """The specification with the smallest log error among those that are safe at every cutoff; no map where none is."""
    safe = scores.join(F.broadcast(screen), "spec").filter((F.col("spec") == "identity") | (F.col("monotone") & F.col("in_range")))
    last = F.col("spec") == "identity"
    return safe.agg(F.min(F.struct(last.alias("last"), "log_rmse", "spec")).alias("b")).filter("b IS NOT NULL").select("b.spec", "b.log_rmse")


def weight_sweep(panel: DataFrame, least: list[float], min_months: int = MIN_MONTHS, lag: int = LAG_MONTHS) -> DataFrame:
    """The best specification beside no map when only cells of a least balance count: the least balances are a grid column,
    so one pass fits all of them."""
    from tideline.operators import scoring

    grid = panel.withColumn("min_upb", F.explode(F.array(*[F.lit(float(v)) for v in least]))).filter(F.col("upb_atrisk") >= F.col("min_upb"))
    grid = cut_lineage(grid)
    many = grid.groupBy("min_upb").agg(F.count(F.lit(1)).alias("cells"))
    coefs = coefficients(grid, None, min_months, lag, ["min_upb"])
    scores = scoring.weighted_scores(search(grid, by=["min_upb"], coefs=coefs), "upb_atrisk", ["min_upb", "spec"])
    named = F.col("spec") == "identity"
    best = scores.groupBy("min_upb").agg(F.max(F.when(named, F.col("log_rmse"))).alias("identity"), F.min(F.when(~named, F.struct(F.round("log_rmse", 9).alias("r"), "spec", "log_rmse"))).alias("b"))
    out = best.join(F.broadcast(many), "min_upb").select("min_upb", "cells", "identity", F.col("b.log_rmse").alias("best"), F.col("b.spec").alias("best_spec"))
    return out.withColumn("reduction_pct", 100 * (F.col("identity") - F.col("best")) / F.col("identity"))


def _bucket_history(panel: DataFrame, family: str, w: Column, lag: int, by: list[str]) -> DataFrame:
    """The line of each incentive bucket. Months without a bucket's own cells are filled in with a zero
    weight row so that every scored month sees the bucket's history."""
    xs = {"t": forward(family, F.col("forecast_cpr"))}
    y = forward(family, F.col("cpr_upb"))
    labels = F.array(*[F.lit(x) for x in bins.MAPPING_LABELS])
    months = panel.groupBy(*by, "mi").agg(F.max("forecast_cpr").alias("forecast_cpr"), F.max("cpr_upb").alias("cpr_upb"))
    filler = months.withColumn("inc_bucket", F.explode(labels)).withColumn("_real", F.lit(0))
    rows = panel.select(*by, "mi", "inc_bucket", "forecast_cpr", "cpr_upb", "upb_atrisk").withColumn("_real", F.lit(1))
    full = rows.unionByName(filler.withColumn("upb_atrisk", F.lit(0.0)))
    key = [*by, "inc_bucket"]
    counts = regression.expanding_history(full, "mi", lag, {"n_cells": F.col("_real")}, key)
    fit = weighted_history(full, y, xs, w, key, lag, 0)
    return fit.select("mi", *key, F.col("b0").alias("o0"), F.col("b_t").alias("o1")).join(counts.select("mi", *key, "n_cells"), ["mi", *key])
