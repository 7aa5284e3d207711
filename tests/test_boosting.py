"""Boosting by histogram jobs: Spark ML's trees, one job a level."""

import threading

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tideline.operators import boosting
from tideline.plans import hazard


def rows(n=3000, seed=3):
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.integers(0, 30, n), rng.integers(0, 7, n), np.zeros(n)])
    p = 1 / (1 + np.exp(-(0.2 * x[:, 0] - 3 - 0.8 * (x[:, 1] == 2) + 1.1 * (x[:, 1] > 4))))
    return [(float(a), float(b), float(c), int(rng.random() < q), float(w)) for (a, b, c), q, w in zip(x, p, 0.5 + rng.random(n))]


@pytest.fixture(scope="module")
def planted(spark):
    return spark.createDataFrame(rows(), "a double, b double, flat double, y int, w double").cache()


def test_same_trees_as_spark_where_bins_hold_single_values(spark, planted, monkeypatch):
    names = ["a", "b", "flat"]
    gbt = GBTClassifier(featuresCol="_x", labelCol="y", weightCol="w", maxIter=6, maxDepth=4, seed=1)
    vec = VectorAssembler(inputCols=names, outputCol="_x")
    want = gbt.fit(vec.transform(planted)).transform(vec.transform(planted)).withColumn("q", vector_to_array("probability")[1])
    monkeypatch.setattr(boosting, "FEW", 700)  # several partitions
    monkeypatch.setattr(boosting, "CUT", 2)  # lineage is cut on the way
    model = boosting.fit(planted, names, "y", "w", 6, 4)
    both = want.withColumn("p", model.probability()).agg(F.max(F.abs(F.col("p") - F.col("q"))).alias("d"), F.stddev("p").alias("s")).first()
    assert both["d"] < 1e-9 and both["s"] > 0.1


def test_a_level_is_one_job(spark, planted):
    spark.sparkContext.setJobGroup("boosting", "")
    before = len(spark.sparkContext.statusTracker().getJobIdsForGroup("boosting"))
    boosting.fit(planted, ["a", "b"], "y", "w", 8, 3)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("boosting")) - before
    assert jobs <= 8 * 3 + 20


def test_few_or_equal_values(spark):
    df = spark.createDataFrame([(1.0, 0, 1.0), (1.0, 1, 1.0), (1.0, 1, 2.0)], "a double, y int, w double")
    p = [r.p for r in df.withColumn("p", boosting.fit(df, ["a"], "y", "w", 1).probability()).collect()]
    assert p == pytest.approx([1 / (1 + np.exp(-2 * 0.5))] * 3)


def test_hazards_boost_with_it(spark, planted, monkeypatch):
    seen = []
    monkeypatch.setattr(boosting, "fit", lambda df, *args: seen.append(args))
    steps = planted.withColumn("loan_id", F.monotonically_increasing_id()).withColumn("event_loan", F.col("y")).withColumn("n_steps", F.lit(1))
    hazard.fit_hazard(steps, ["a", "b"], "boosted", 300)
    assert seen == [(["a", "b"], "y", "weight", 300)]


def test_snapshot_learners_are_fitted_side_by_side(spark, planted, monkeypatch):
    """Neither fit can end before the other has begun."""
    meet, fit = threading.Barrier(2), boosting.fit

    def waits(*args):
        meet.wait(60)
        return fit(*args)

    monkeypatch.setattr(boosting, "fit", waits)
    df = planted.withColumn("prepaid", F.col("y")).withColumn("split", F.when(F.col("a") % 3 == 0, "test").otherwise("train"))
    out = hazard.snapshot_models(df, {"one": ["a"], "two": ["a", "b"]}, kinds=("boosted_trees",), rounds=2, depth=2).collect()
    assert {r.features for r in out} == {"one", "two"} and all(r.auc > 0.6 for r in out)
