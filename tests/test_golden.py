"""Published results recomputed from their published inputs."""

import pytest
from pyspark.sql import functions as F

from tideline.functions import rates

# fixed values: coupon, speed, level loading, slope loading at a 6.19 par rate and a 0.75 spread
LOADINGS = [
    (2.5, 0.0112, 13.944419, 0.0),
    (3.0, 0.0117, 10.393859, 0.0),
    (3.5, 0.0127, 7.559535, 0.0),
    (4.0, 0.0144, 5.276193, 0.0),
    (5.5, 0.024, 1.016784, 0.00061),
    (6.0, 0.0283, 0.238554, 0.001336),
    (6.5, 0.0329, -0.334019, -0.003541),
]

# fixed values: at risk, prepaid, monthly and annual speed
SPEEDS = [
    (197903617, 4, 2e-08, 0.0),
    (19762793, 215, 1.088e-05, 0.000131),
    (28111525, 4658, 0.0001657, 0.001987),
]


def test_loadings(spark):
    df = spark.createDataFrame(LOADINGS, "coupon double, phi double, bx double, by double")
    out = df.withColumn("r", F.lit(6.19)).select(
        "bx", "by", rates.beta_level("coupon", "phi", "r").alias("x"), rates.beta_slope("coupon", "phi", "r", 0.75).alias("y"))
    for r in out.collect():
        assert r.x == pytest.approx(r.bx, abs=1e-5) and r.y == pytest.approx(r.by, abs=1e-6)


def test_speeds(spark):
    df = spark.createDataFrame(SPEEDS, "n bigint, p bigint, smm double, cpr double")
    out = df.select("smm", "cpr", (F.col("p") / F.col("n")).alias("s")).withColumn("c", rates.smm_to_cpr("s"))
    for r in out.collect():
        assert r.s == pytest.approx(r.smm, abs=5e-9) and r.c == pytest.approx(r.cpr, abs=5e-7)
