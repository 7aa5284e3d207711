"""Hazard models on planted signals."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.functions import rates
from tideline.operators import ordering
from tideline.plans import hazard
from tideline.session import run_dir


def person_rows(loans=400, seed=0):
    """Monthly rows whose event chance is a known index of two features."""
    rng = np.random.default_rng(seed)
    out = []
    for loan in range(loans):
        a, b = rng.normal(), rng.normal()
        for t in range(20):
            event = rng.random() < 1 / (1 + np.exp(-(-3.0 + 1.2 * a - 0.8 * b)))
            out.append((loan, t, float(a), float(b), int(event)))
            if event:
                break
    return out


@pytest.fixture(scope="module")
def steps(spark):
    df = spark.createDataFrame(person_rows(), "loan_id int, t int, a double, b double, y int")
    per = df.groupBy("loan_id").agg(F.max("y").alias("event_loan"), F.count(F.lit(1)).alias("n_steps"))
    return df.join(per, "loan_id").withColumn("flat", F.lit(1.0)).cache()


def test_index_finds_the_planted_signal(spark, steps):
    model = hazard.fit_index(steps, steps, ["a", "b", "flat"])
    assert model.coef["a"] == pytest.approx(1.2, abs=0.25) and model.coef["b"] == pytest.approx(-0.8, abs=0.25) and model.coef["flat"] == 0.0
    assert model.intercept == pytest.approx(-3.0, abs=0.4)  # calibration undoes the balancing weights
    mean = steps.agg(F.avg(rates.sigmoid(model.index())).alias("p"), F.avg("y").alias("y")).first()
    assert mean["p"] == pytest.approx(mean["y"], rel=1e-6)


def test_index_survives_saving(spark, steps):
    model = hazard.fit_index(steps, steps, ["a", "b"])
    path = run_dir(spark, "index-test")
    model.save(spark, path)
    back = hazard.HazardIndex.load(spark, path, ["a", "b"])
    assert (back.intercept, back.coef, back.means, back.platt, back.standard) == (model.intercept, model.coef, model.means, model.platt, model.standard)


def test_learners_rank_held_out_loans(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1200, 2))
    p = 1 / (1 + np.exp(-(2.0 * x[:, 0] - 1.5 * x[:, 1])))
    data = [(float(u), float(v), int(rng.random() < q), "train" if i % 4 else "test") for i, ((u, v), q) in enumerate(zip(x, p))]
    df = spark.createDataFrame(data, "a double, b double, prepaid int, split string")
    out = hazard.snapshot_models(df, {"both": ["a", "b"]}, trees=20, rounds=5, min_leaf=5, layers=(8,))
    auc = {r["model"]: r["auc"] for r in out.collect()}
    truth = ordering.auc(df.filter("split = 'test'").withColumn("s", 2.0 * F.col("a") - 1.5 * F.col("b")), "s", "prepaid").first()["auc"]
    assert set(auc) == set(hazard.SNAPSHOT_KINDS) and all(v > truth - 0.06 for v in auc.values())
