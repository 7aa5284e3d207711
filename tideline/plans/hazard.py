"""Discrete-time hazard models with Spark ML, their calibration and scoring.

A network on one accelerator is replaced by models that Spark trains over
person-period rows wherever they live.
"""

from __future__ import annotations

from functools import partial
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline
from pyspark.ml.classification import (
    LogisticRegression,
    MultilayerPerceptronClassifier,
    RandomForestClassifier,
)
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from tideline.functions import rates
from tideline.functions.cashflow import let, mean
from tideline.operators import boosting, ordering, regression, selection, sequences
from tideline.session import cut_lineage


def hazard_pipeline(features: list[str], label: str = "y", weight: str = "weight") -> Pipeline:
    """Assembler plus logistic classifier on person-period rows."""
    vec = VectorAssembler(inputCols=features, outputCol="_x", handleInvalid="error")
    return Pipeline(stages=[vec, LogisticRegression(featuresCol="_x", labelCol=label, weightCol=weight, maxIter=100, regParam=0.0)])


class HazardIndex:
    """A fitted and calibrated linear hazard index: raw-scale coefficients per
    feature, training means, and the Platt map that was folded into them."""

    def __init__(self, features: list[str], intercept: float, coef: dict[str, float], means: dict[str, float], standard: list[float], platt: tuple[float, float]):
        self.features, self.intercept, self.coef, self.means, self.standard, self.platt = features, intercept, coef, means, standard, platt

    def index(self, overrides: dict[str, Column] | None = None) -> Column:
        """Calibrated logit of the monthly hazard of a row with the features."""
        z = F.lit(self.intercept)
        for f in self.features:
            z = z + F.lit(self.coef[f]) * (overrides or {}).get(f, F.col(f))
        return z

    def cell(self) -> dict[str, float]:
        """Index of a (month, coupon) cell in incentive and age, the other features
        at their training means."""
        rest = sum(self.coef[f] * self.means[f] for f in self.features if f not in ("refi_incentive", "loan_age"))
        return {"intercept": self.intercept + rest, "incentive": self.coef["refi_incentive"], "age": self.coef["loan_age"]}

    def save(self, spark, path: str) -> None:
        rows = [("", self.intercept, 0.0, self.standard[0])] + [(f, self.coef[f], self.means[f], b) for f, b in zip(self.features, self.standard[1:])]
        rows.append(("platt", self.platt[0], self.platt[1], 0.0))
        spark.createDataFrame(rows, "feature string, coef double, mean double, standard double").coalesce(1).write.parquet(path)

    @classmethod
    def load(cls, spark, path: str, features: list[str]) -> "HazardIndex":
        rows = {r["feature"]: r for r in spark.read.parquet(path).collect()}
        standard = [rows[""]["standard"], *[rows[f]["standard"] for f in features]]
        return cls(features, rows[""]["coef"], {f: rows[f]["coef"] for f in features}, {f: rows[f]["mean"] for f in features}, standard, (rows["platt"]["coef"], rows["platt"]["mean"]))


def fit_index(steps: DataFrame, observed: DataFrame, features: list[str]) -> HazardIndex:
    """Logistic hazard on weighted person-period rows, calibrated by Platt's map
    on all observed steps, as one linear index.

    Both inputs are read once per Newton step, so they are checkpointed; a flat
    feature gets no weight.
    """
    rows = cut_lineage(selection.person_period_weights(steps).select(*features, F.col("y").cast("double").alias("y"), "weight"))
    stats = rows.agg(F.count(F.lit(1)).alias("n"), F.avg("weight").alias("w"), *[F.avg(f).alias(f"m_{f}") for f in features], *[F.stddev_pop(f).alias(f"s_{f}") for f in features]).first()
    mean = {f: float(stats[f"m_{f}"]) for f in features}
    sd = {f: float(stats[f"s_{f}"]) for f in features}
    used = [f for f in features if sd[f] > 0]
    unit = rows.select("y", (F.col("weight") / stats["w"]).alias("w"), *[((F.col(f) - mean[f]) / sd[f]).alias(f) for f in used])
    beta = dict(zip(["", *used], regression.logit_fit(unit, "y", used, "w")))
    raw = {f: beta.get(f, 0.0) / sd[f] if sd[f] > 0 else 0.0 for f in features}
    start = beta[""] - sum(raw[f] * mean[f] for f in features)
    z = F.lit(start)
    for f in features:
        z = z + F.lit(raw[f]) * F.col(f)
    steps_z = cut_lineage(observed.select(z.alias("z"), F.col("y").cast("double").alias("y")))
    b, a = regression.logit_fit(steps_z, "y", ["z"])
    return HazardIndex(features, a * start + b, {f: a * raw[f] for f in features}, mean, [beta[""], *[beta.get(f, 0.0) for f in features]], (a, b))


def score(model, df: DataFrame, name: str = "p") -> DataFrame:
    """Event probability column; everything else unchanged."""
    if isinstance(model, boosting.BoostedTrees):
        return df.withColumn(name, model.probability())
    out = model.transform(df).withColumn(name, vector_to_array("probability")[1])
    return out.drop("_x", "rawPrediction", "probability", "prediction")


def fit_hazard(steps: DataFrame, features: list[str], kind: str = "logistic", rounds: int = 300):
    """Fit on weighted person-period rows (half-and-half batch in expectation); ``rounds`` of boosting."""
    train = selection.person_period_weights(steps)
    total = train.agg(F.avg("weight"))
    scaled = train.withColumn("_m", total.scalar()).withColumn("weight", F.col("weight") / F.col("_m")).select(*features, "y", "weight")
    if kind == "logistic":
        return hazard_pipeline(features).fit(scaled)
    if kind == "boosted":
        return boosting.fit(cut_lineage(scaled), features, "y", "weight", rounds)
    raise ValueError(kind)


def evaluate_hazard(scored: DataFrame, labels: DataFrame, by: list[str] = [], hazard: str = "p") -> DataFrame:
    """AUC of the loan's cumulative event probability over its observed steps."""
    cdf = sequences.survival_cdf(scored, hazard, by=by)
    return ordering.auc(cdf.join(labels, "loan_id"), "cdf", "prepaid", by)


def hazard_comparison(steps: DataFrame, split: DataFrame, features: list[str], kinds=("logistic", "boosted"), rounds: int = 300) -> DataFrame:
    """Fit each kind on the train loans and report its held-out AUC.

    Trainers pass over their input many times, so it is checkpointed once.
    """
    tagged = cut_lineage(steps.join(split.select("loan_id", "split"), "loan_id"))
    train, test = tagged.filter("split = 'train'"), tagged.filter("split = 'test'")
    scored = None
    for kind in kinds:
        rows = score(fit_hazard(train, features, kind, rounds), test).select(F.lit(kind).alias("model"), "loan_id", "t", "p")
        scored = rows if scored is None else scored.unionByName(rows)
    return evaluate_hazard(scored, split.select("loan_id", "prepaid"), ["model"])


def platt_fit(df: DataFrame, score_col: str, label: str, target: str) -> DataFrame:
    """Near-unregularised logistic of the label on one score: (a, b) plus the
    calibration target, so maps of different objects cannot be mixed up."""
    vec = VectorAssembler(inputCols=[score_col], outputCol="_x")
    lr = LogisticRegression(featuresCol="_x", labelCol=label, regParam=0.0, maxIter=500, tol=1e-12)
    rows = df.filter(F.col(score_col).isNotNull()).select(score_col, F.col(label).cast("double").alias(label))
    model = lr.fit(vec.transform(rows))
    spark = df.sparkSession
    one = [(float(model.coefficients[0]), float(model.intercept), target)]
    return spark.createDataFrame(one, "a double, b double, calibration_target string")


def apply_platt(df: DataFrame, params: DataFrame, score_col: str, target: str, name: str = "p_cal") -> DataFrame:
    """Apply a fitted map; refuses parameters fitted for another target."""
    packed = params.select(F.struct("*"))
    out = df.withColumn("_pl", packed.scalar())
    same = F.when(F.col("_pl.calibration_target") == target, F.col("_pl.a")).otherwise(
        F.raise_error(F.lit(f"calibration is not for {target}")).cast("double"))
    return out.withColumn(name, rates.platt(score_col, same, F.col("_pl.b"))).drop("_pl")


SNAPSHOT_KINDS = ("logistic", "random_forest", "boosted_trees", "perceptron")


def snapshot_models(
    tagged: DataFrame, feature_sets: dict[str, list[str]], label: str = "prepaid", kinds: tuple[str, ...] = SNAPSHOT_KINDS,
    trees: int = 200, rounds: int = 300, depth: int = 6, min_leaf: int = 50, layers: tuple[int, ...] = (128, 64),
) -> DataFrame:
    """Class-balanced classifiers on one row per loan and their test AUC, per
    feature set. ``tagged`` carries a train/test ``split`` column. The sizes of
    forest, boosting and net are parameters."""
    frac = tagged.filter("split = 'train'").agg(F.avg(F.col(label).cast("double")))
    w = F.when(F.col(label) == 1, 0.5 / F.col("_p")).otherwise(0.5 / (1 - F.col("_p")))
    rows = cut_lineage(tagged.withColumn("_p", frac.scalar()).withColumn("w", w).drop("_p"))
    train, test = rows.filter("split = 'train'"), rows.filter("split = 'test'")
    fits = []
    for set_name, features in feature_sets.items():
        prep = Pipeline(stages=[
            VectorAssembler(inputCols=features, outputCol="_raw"),
            StandardScaler(inputCol="_raw", outputCol="_x", withMean=True, withStd=True),
        ]).fit(train)
        tr, te = cut_lineage(prep.transform(train).select("_x", label, "w")), prep.transform(test).select("_x", label)
        common = dict(featuresCol="_x", labelCol=label)
        models = {
            "logistic": LogisticRegression(weightCol="w", maxIter=500, tol=1e-12, **common),
            "random_forest": RandomForestClassifier(weightCol="w", numTrees=trees, maxDepth=depth, minInstancesPerNode=min_leaf, seed=42, **common),
            "perceptron": MultilayerPerceptronClassifier(layers=[len(features), *layers, 2], maxIter=50, seed=42, **common),
        }
        for name in kinds:
            # trees ask only for the order of a feature, so boosting reads the columns as they are
            fit = partial(boosting.fit, train, features, label, "w", rounds, depth) if name == "boosted_trees" else partial(models[name].fit, tr)
            fits.append((set_name, name, test if name == "boosted_trees" else te, fit))
    # the fits do not depend on each other, and most of their many jobs are short: they share the executors
    run = inheritable_thread_target(tagged.sparkSession)
    with ThreadPool(len(fits)) as pool:
        fitted = pool.map(lambda fit: run(fit)(), [f[-1] for f in fits])
    scored = None
    for (set_name, name, rows, _), model in zip(fits, fitted):
        p = score(model, rows).select(F.lit(set_name).alias("features"), F.lit(name).alias("model"), "p", label)
        scored = p if scored is None else scored.unionByName(p)
    return ordering.auc(scored, "p", label, ["features", "model"])


def hazard_cpr_path(incentive: Column, coef: dict[str, float], start_age: Column | int = 0, steps: int = 33) -> Column:
    """Annualised speeds for ``steps`` months at a constant incentive: an array
    built inside the row from a linear hazard index."""
    start = F.lit(start_age) if isinstance(start_age, int) else start_age
    fixed = coef["intercept"] + coef["incentive"] * incentive + coef["age"] * start
    return let(fixed, lambda z: F.transform(
        F.sequence(F.lit(1), F.lit(steps)), lambda t: rates.smm_to_cpr(rates.sigmoid(z + coef["age"] * t))))


array_mean = mean


def coupon_forecast(
    market: DataFrame, coupons: list[float], coef: dict[str, float], spread: float
) -> DataFrame:
    """(month, coupon) -> mean of the annualised path at the month's incentive."""
    from tideline.operators import joins

    g = joins.grid(market, coupon=coupons).withColumn("note_rate", F.col("coupon") + spread)
    g = g.withColumn("incentive", F.col("note_rate") - F.col("rate_30yr"))
    # the path depends on the incentive alone: score each distinct value once
    once = g.select("incentive").distinct().withColumn(
        "forecast_cpr", array_mean(hazard_cpr_path(F.col("incentive"), coef)))
    return g.join(once, "incentive")


def rate_sensitivity(
    paths: DataFrame, coupons: list[float], coef: dict[str, float], spread: float, delta: float = 0.25
) -> DataFrame:
    """Per coupon: mean speed over all path points, central difference in the
    incentive, and the at-the-money baseline."""
    from tideline.operators import joins

    # collapse equal (step, rate) points before the coupon grid multiplies them
    points = paths.groupBy("t", "rate").agg(F.count(F.lit(1)).alias("w"))
    g = joins.grid(points, coupon=coupons)
    inc = F.col("coupon") + spread - F.col("rate")
    cpr = lambda x: rates.smm_to_cpr(rates.sigmoid(coef["intercept"] + coef["incentive"] * x + coef["age"] * F.col("t")))
    mean = lambda c: F.sum(F.col("w") * c) / F.sum("w")
    return g.groupBy("coupon").agg(
        mean(cpr(inc)).alias("mean_cpr"), mean(cpr(F.lit(0.0))).alias("atm_cpr"),
        (mean(cpr(inc + delta) - cpr(inc - delta)) / (2 * delta)).alias("rate_sens"))


def population_forecast(
    loans: DataFrame, market: DataFrame, coef: dict[str, float], asof: int, steps: int = 33
) -> DataFrame:
    """Balance-weighted speed by coupon over the loans alive at ``asof``, each on
    a flat rate path from its own age. Loans of equal (bucket, rate, age) share a
    path, so balances are summed before paths are built."""
    from tideline.functions import periods

    alive = (
        selection.cutoff(loans, asof).groupBy("loan_id")
        .agg(F.max_by(F.struct("upb", "note_rate", "orig_ym"), "yyyymm").alias("s"))
        .filter(F.col("s.upb") > 0)
    )
    rate = market.filter(F.col("yyyymm") == asof).agg(F.max("rate_30yr"))
    profile = (
        alive.select("s.upb", "s.note_rate", periods.months_between_ym("s.orig_ym", F.lit(asof)).alias("age"))
        .groupBy("note_rate", "age")
        .agg(F.sum("upb").alias("upb"), F.count(F.lit(1)).alias("n"))
        .withColumn("market", rate.scalar())
    )
    path = array_mean(hazard_cpr_path(F.col("note_rate") - F.col("market"), coef, F.col("age"), steps))
    scored = profile.withColumn("cpr", path)
    return scored.groupBy(rates.coupon_bucket_net("note_rate").alias("coupon")).agg(
        F.sum("n").alias("n_loans"), F.sum("upb").alias("upb"),
        (F.sum(F.col("upb") * F.col("cpr")) / F.sum("upb")).alias("forecast_cpr"))


def score_grid(base: DataFrame, axes: dict[str, list[float]], model: HazardIndex) -> DataFrame:
    """Response sweep of a fitted index: every combination of the axes with the
    other features held at the one-row ``base``."""
    from tideline.operators import joins

    h = rates.sigmoid(model.index())
    return joins.grid(base, **axes).withColumn("hazard", h).withColumn("cpr", rates.smm_to_cpr(h))
