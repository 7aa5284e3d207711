"""Scenario pricing: positions x scenarios are rows, one fold prices a row.

Scenario curves are bootstrapped once per (date, scenario) and shared by all
coupons of the date; the pairing is an equi-join on the date.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tideline.functions import cashflow, curves, rates
from tideline.plans.hazard import hazard_cpr_path
from tideline.session import cut_lineage

H = curves.BUMP_PP
# fixed values: terminal curve used when a position carries no fitted parameters
TERMINAL = {"floor": 0.0459, "sat": 0.2204, "k": 3.0, "x0": 0.4}
MODEL_MONTHS = 33
TENTS = {"tent_2": "krd2", "tent_5": "krd5", "tent_10": "krd10"}


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """One task per core for fold work: the rows are few and small but each costs
    hundreds of steps, so size-based coalescing would leave cores idle."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * n, *[F.col(k) for k in keys])


def scenario(name: str, shape: str = "none", size: float = 0.0, rate_move: float = 0.0, model: bool = True,
             terminal: bool = True, form: str = "base", scale: float = 1.0) -> dict:
    """One scenario: curve bump, market-rate move, which speed segments see the
    move, how the response is grafted, and a scale on the terminal speed."""
    return dict(scenario=name, shape=shape, size=float(size), rate_move=float(rate_move), model=model,
                terminal=terminal, form=form, scale=float(scale))


def two_sided(name: str, shape: str, pass_through: float = 0.0, **kw) -> list[dict]:
    return [scenario(f"{name}{tag}", shape, s * H, s * H * pass_through, **kw) for tag, s in (("+", 1), ("-", -1))]


def tent_scenarios(pass_through: dict[str, float] | None = None, **kw) -> list[dict]:
    """Base plus both sides of the three tents. By default only the 10-year tent
    moves the mortgage rate."""
    through = pass_through or {"tent_2": 0.0, "tent_5": 0.0, "tent_10": 1.0}
    out = [scenario("base", **kw)]
    for shape, name in TENTS.items():
        out += two_sided(name, shape, through[shape], **kw)
    return out


def local_scenarios(spanning: bool = False, key: str = "10yr") -> list[dict]:
    """Base plus the 5- and 10-year bumps, localized or spanning."""
    kind = "span" if spanning else "local"
    move = lambda tenor: 1.0 if key in ("any", tenor) else 0.0
    return [scenario("base"), *two_sided("krd5", f"{kind}_5", move("5yr")), *two_sided("krd10", f"{kind}_10", move("10yr"))]


def _as_struct(s: dict) -> Column:
    return F.struct(*[F.lit(v).alias(k) for k, v in s.items()])


def scenario_curves(month_curves: DataFrame, scenarios: list[dict], method: str = "standard") -> DataFrame:
    """(date, scenario) rows with the scenario fields and monthly discount factors.

    Scenarios that bump the curve alike share one bootstrap.
    """
    shapes = sorted({(s["shape"], s["size"]) for s in scenarios})
    keys = F.array(*[F.struct(F.lit(sh).alias("shape"), F.lit(sz).alias("size")) for sh, sz in shapes])
    c = month_curves.select("yyyymm", *curves.TENORS, F.explode(keys).alias("_b")).select("*", "_b.shape", "_b.size").drop("_b")
    c = curves.bumped(c)
    if method == "standard":
        c = curves.bootstrap_zeros(c).withColumn("disc", cashflow.discounts(curves.monthly_zeros()))
    elif method == "exact":
        c = curves.bootstrap_exact(c).withColumn("disc", cashflow.discounts(curves.monthly_zeros_from_logdf()))
    else:
        raise ValueError(method)
    by_shape = {key: F.array(*[_as_struct(s) for s in scenarios if (s["shape"], s["size"]) == key]) for key in shapes}
    pick = None
    for (sh, sz), arr in by_shape.items():
        hit = (F.col("shape") == sh) & (F.col("size") == sz)
        pick = F.when(hit, arr) if pick is None else pick.when(hit, arr)
    return c.select("yyyymm", "disc", F.explode(pick).alias("s"))


def terminal_speed(incentive: Column, params: dict | None = None) -> Column:
    p = params or TERMINAL
    return rates.scurve(incentive, p["floor"], p["sat"], p["k"], p["x0"])


def speed_path(coef: dict[str, float], spread: float = rates.SERVICING_SPREAD, params: dict | None = None, map_mode: str = "off") -> Column:
    """360 monthly speeds of a (position, scenario) row with columns coupon, pmms
    and the scenario struct ``s`` (plus a, b when a map is applied)."""
    note = F.col("coupon") + spread
    i0 = note - F.col("pmms")
    i1 = i0 - F.col("s.rate_move")
    im = F.when(F.col("s.model"), i1).otherwise(i0)
    it = F.when(F.col("s.terminal"), i1).otherwise(i0)
    own = hazard_cpr_path(im, coef)
    base = hazard_cpr_path(i0, coef)
    s0, s1 = terminal_speed(i0, params), terminal_speed(i1, params)
    graft = lambda by, f: cashflow.let(by, lambda g: F.transform(base, lambda p: rates.clip(f(p, g), 0.0, 0.99)))
    path = (
        F.when(F.col("s.form") == "add", graft(s1 - s0, lambda p, g: p + g))
        .when(F.col("s.form") == "mult", graft(s1 / F.greatest(s0, F.lit(1e-9)), lambda p, g: p * g))
        .otherwise(own)
    )
    if map_mode != "off":
        path = cashflow.map_path(path, F.col("a"), F.col("b"), map_mode, base)
    return cashflow.extend(path, terminal_speed(it, params) * F.col("s.scale"))


def scenario_prices(
    month_curves: DataFrame, positions: DataFrame, scenarios: list[dict], coef: dict[str, float],
    params: dict | None = None, map_mode: str = "off", method: str = "standard", frozen_cpr: float | None = None,
) -> DataFrame:
    """(yyyymm, coupon, scenario, price). ``positions``: yyyymm, coupon, pmms."""
    sc = scenario_curves(month_curves, scenarios, method)
    df = spread(sc.join(positions, "yyyymm"), "yyyymm", "coupon", "s.scenario")
    path = cashflow.flat(F.lit(frozen_cpr)) if frozen_cpr is not None else speed_path(coef, params=params, map_mode=map_mode)
    return df.select("yyyymm", "coupon", F.col("s.scenario").alias("scenario"), cashflow.price(F.col("coupon"), path, F.col("disc")).alias("price"))


def durations(prices: DataFrame, names: list[str], by: list[str] = ["yyyymm", "coupon"], base: str = "base") -> DataFrame:
    """Two-sided durations (P- - P+)/(2 P0 h) per scenario name."""
    at = lambda s: F.max(F.when(F.col("scenario") == s, F.col("price")))
    wide = prices.groupBy(*by).agg(at(base).alias("price"), *[at(f"{n}{t}").alias(f"_{n}{t}") for n in names for t in "+-"])
    return wide.select(*by, "price", *[
        ((F.col(f"`_{n}-`") - F.col(f"`_{n}+`")) / (2 * F.col("price") * (H / 100))).alias(n) for n in names])


def hedge_panel(prices_wide: DataFrame, krds: DataFrame, basis: DataFrame) -> DataFrame:
    """Return-month panel: durations known at the previous priced month, the
    month's return, income and curve shocks, and the hedged return.

    ``prices_wide``: coupon, yyyymm, mi, price. ``krds``: coupon, yyyymm and
    durations at the information month. ``basis``: yyyymm and shocks.
    """
    from tideline.operators import joins, series
    from tideline.plans.hedging import hedged_returns

    ret = series.total_returns(prices_wide)
    ret = joins.prior_row(prices_wide, "mi", {"info_ym": "yyyymm"}, ["coupon"]).select("coupon", "yyyymm", "info_ym").join(
        ret, ["coupon", "yyyymm"])
    info = krds.withColumnRenamed("yyyymm", "info_ym").withColumnRenamed("price", "model_price")
    return hedged_returns(ret.join(info, ["coupon", "info_ym"]).join(F.broadcast(basis), "yyyymm")).filter(F.col("d_level").isNotNull())


def long_run_speed(month_curves: DataFrame, targets: DataFrame, rounds: int = 40, lo: float = 0.001, hi: float = 0.60) -> DataFrame:
    """Flat lifetime speed whose duration equals the target, by bisection inside
    the row (duration falls in speed). ``targets``: yyyymm, coupon, target."""
    scen = [scenario("base"), *two_sided("par", "parallel")]
    sc = scenario_curves(month_curves, scen)
    at = lambda s: F.max(F.when(F.col("s.scenario") == s, F.col("disc")))
    z = sc.groupBy("yyyymm").agg(at("base").alias("z0"), at("par+").alias("zu"), at("par-").alias("zd"))
    df = spread(z.join(targets, "yyyymm"), "yyyymm", "coupon")

    def dur(c):
        p = lambda zz: cashflow.price(F.col("coupon"), cashflow.flat(c), F.col(zz))
        return (p("zd") - p("zu")) / (2 * p("z0") * (H / 100))

    start = F.struct(F.lit(lo).alias("lo"), F.lit(hi).alias("hi"))

    def halve(acc, _):
        mid = (acc["lo"] + acc["hi"]) / 2
        up = dur(mid) > F.col("target")
        return F.struct(F.when(up, mid).otherwise(acc["lo"]).alias("lo"), F.when(up, acc["hi"]).otherwise(mid).alias("hi"))

    solved = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, halve, lambda a: (a["lo"] + a["hi"]) / 2)
    return df.select("yyyymm", "coupon", "target", solved.alias("flat_cpr"))


# ---------------------------------------------------------- loans along rate paths


def packed_paths(paths: DataFrame, treasury_gap: float, chunk: int = 256) -> DataFrame:
    """Distinct rate paths with their multiplicity, about ``chunk`` to a row, each
    as mortgage-rate and short-rate arrays. Any number of paths is handled."""
    arr = paths.groupBy("path_id").agg(F.array_sort(F.collect_list(F.struct("t", "rate"))).alias("p"))
    distinct = arr.select(F.transform("p", lambda e: e["rate"]).alias("m")).groupBy("m").agg(F.count(F.lit(1)).alias("n"))
    n_chunks = distinct.agg(F.ceil(F.count(F.lit(1)) / chunk))
    keyed = distinct.withColumn("_k", n_chunks.scalar()).withColumn("chunk_id", F.pmod(F.xxhash64("m"), F.col("_k")))
    item = F.struct("m", "n", F.transform("m", lambda r: r - treasury_gap).alias("r"))
    return keyed.groupBy("chunk_id").agg(F.array_sort(F.collect_list(item)).alias("paths"))


def loan_profiles(loans: DataFrame) -> DataFrame:
    """Loans reduced to what the price depends on: (note rate, active months);
    prices are per 100 of balance, so balances only weigh."""
    return loans.groupBy("note_rate", "n_active").agg(F.count(F.lit(1)).alias("n_loans"), F.sum("upb").alias("upb"))


def with_path_flows(profiles: DataFrame, chunks: DataFrame, coef: dict[str, float]) -> DataFrame:
    """(profile, chunk) rows with the cash flows along each path of the chunk."""
    n = chunks.agg(F.max("chunk_id"))
    df = profiles.withColumn("_n", n.scalar()).withColumn("chunk_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_n"))))
    # no hint: Spark broadcasts the chunks only when their measured size allows
    df = df.join(chunks, "chunk_id").drop("_n", "chunk_id")

    def flows(p):
        hz = F.transform(p["m"], lambda r, i: rates.sigmoid(
            coef["intercept"] + coef["incentive"] * (F.col("note_rate") - r) + coef["age"] * (i + 1)))
        return F.struct(cashflow.path_cashflows(F.col("note_rate"), hz).alias("f"), p["r"].alias("r"), p["n"].alias("n"))

    df = spread(df, "note_rate", "n_active")
    return df.withColumn("flows", F.transform("paths", flows)).drop("paths")


def _over_paths(value) -> Column:
    """Multiplicity-weighted sum over the paths of a chunk."""
    return F.aggregate("flows", F.lit(0.0), lambda acc, p: acc + p["n"] * value(p))


def _n_paths() -> Column:
    return F.aggregate("flows", F.lit(0).cast("bigint"), lambda acc, p: acc + p["n"])


def mc_loan_price(profiles: DataFrame, chunks: DataFrame, coef: dict[str, float]) -> DataFrame:
    """Mean and spread over paths of the price per 100, terminal balance included."""
    keys = profiles.columns
    df = with_path_flows(profiles, chunks, coef)
    # deviation from par keeps the squares small
    dev = F.transform("flows", lambda p: F.struct(p["n"].alias("n"), (cashflow.discounted(
        p["f"]["cf"], p["r"], F.lit(0.0), F.col("n_active"), p["f"]["bal"]) - 100).alias("v")))
    df = df.select(*keys, dev.alias("flows"))
    df = df.select(*keys, _over_paths(lambda p: p["v"]).alias("_s"), _over_paths(lambda p: p["v"] * p["v"]).alias("_q"), _n_paths().alias("_n"))
    mean = F.sum("_s") / F.sum("_n")
    return df.groupBy(*keys).agg(
        (100 + mean).alias("model_price"), F.sqrt(F.greatest(F.sum("_q") / F.sum("_n") - mean * mean, F.lit(0.0))).alias("price_std"))


def _price_at(spread: Column) -> Column:
    return _over_paths(lambda p: cashflow.discounted(p["f"]["cf"], p["r"], spread, F.col("n_active")))


# fixed values: search range in basis points
OAS_LO, OAS_HI = -500.0, 2000.0


def _oas_curve(flows: DataFrame, bounds: DataFrame, keys: list[str], weigh: bool, points: int) -> DataFrame:
    """Mean price on ``points`` spreads between lo and hi, per key. The spreads are
    evaluated inside the row; only (key, spread, sum) rows leave it. Without keys
    ``bounds`` is one row."""
    rows = flows.join(bounds.select(*keys, "lo", "hi"), keys) if keys else flows.withColumn("_b", bounds.select(F.struct("lo", "hi")).scalar()).select(*flows.columns, "_b.lo", "_b.hi")
    steps = F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: F.col("lo") + (F.col("hi") - F.col("lo")) * i / F.lit(float(points - 1)))
    w = F.col("upb") if weigh else F.lit(1.0)
    sums = F.transform(steps, lambda s: F.struct(s.alias("spread"), (w * _price_at(s)).alias("s")))
    g = rows.select(*keys, (w * _n_paths()).alias("_w"), F.explode(sums).alias("_p"))
    return g.groupBy(*keys, F.col("_p.spread").alias("spread")).agg((F.sum("_p.s") / F.sum("_w")).alias("p"))


def _bracket(curve: DataFrame, keys: list[str], market: Column) -> DataFrame:
    above = F.col("p") >= market
    out = curve.groupBy(*keys).agg(
        F.max(F.when(above, F.struct("spread", "p"))).alias("a"), F.min(F.when(~above, F.struct("spread", "p"))).alias("b"))
    # outside the range one side is missing: stay at the bound and flag it
    return out.select(
        *keys, F.coalesce("a.spread", "b.spread").alias("lo"), F.coalesce("b.spread", "a.spread").alias("hi"),
        F.col("a.p").alias("p_lo"), F.col("b.p").alias("p_hi"))


def _interpolate(market: Column) -> Column:
    return F.coalesce(
        F.col("lo") + (F.col("hi") - F.col("lo")) * (F.col("p_lo") - market) / (F.col("p_lo") - F.col("p_hi")), F.col("lo"))


def oas_solve(profiles: DataFrame, chunks: DataFrame, coef: dict[str, float], market: str, passes: int = 6, points: int = 11) -> DataFrame:
    """Spread at which the mean path value equals the market price, per profile:
    a spread grid that zooms into its bracket (to 0.0025 bp, then a straight line:
    within 1e-9 bp, where 0.25 bp would leave 1.5e-6 and turn rounded digits).
    Prices beyond the search range are flagged at the bound."""
    keys = profiles.columns
    # the flows do not depend on the spread: built once, written, read by every pass
    flows = cut_lineage(with_path_flows(profiles, chunks, coef))
    rows = profiles.withColumn("lo", F.lit(OAS_LO)).withColumn("hi", F.lit(OAS_HI))
    for _ in range(passes):
        curve = _oas_curve(flows, rows, keys, False, points)
        rows = cut_lineage(_bracket(curve, keys, F.col(market)))
    found = F.col("p_lo").isNotNull() & F.col("p_hi").isNotNull()
    return rows.select(*keys, _interpolate(F.col(market)).alias("oas_bp"), found.alias("converged"))


def pool_oas(profiles: DataFrame, chunks: DataFrame, coef: dict[str, float], market_price: float, passes: int = 6, points: int = 11) -> DataFrame:
    """Pool spread from balance-weighted prices, by the same zooming grid; every
    pass is one aggregate over (profile, chunk) rows. A price beyond the search
    range is flagged at the bound."""
    flows = cut_lineage(with_path_flows(profiles, chunks, coef))
    bracket = profiles.sparkSession.range(1).select(F.lit(OAS_LO).alias("lo"), F.lit(OAS_HI).alias("hi"))
    for _ in range(passes):
        bracket = cut_lineage(_bracket(_oas_curve(flows, bracket, [], True, points), [], F.lit(market_price)))
    found = F.col("p_lo").isNotNull() & F.col("p_hi").isNotNull()
    return bracket.select(_interpolate(F.lit(market_price)).alias("pool_oas_bp"), found.alias("converged"))
