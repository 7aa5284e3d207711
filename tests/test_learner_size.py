"""The registered learners have the operator's full size."""

import inspect

import pytest

import __spark_entry__ as entry
from tideline.plans import hazard


@pytest.mark.parametrize("name, plan", [("F10b_hazard_learners", "hazard_comparison"), ("F11b_snapshot_learners", "snapshot_models")])
def test_registered_learners_boost_300_rounds(spark, sf, monkeypatch, name, plan):
    seen, signature = {}, inspect.signature(getattr(hazard, plan))

    def spy(*args, **kwargs):
        call = signature.bind(*args, **kwargs)
        call.apply_defaults()
        seen.update(call.arguments)
        return spark.createDataFrame([("m", 0.5)], "model string, auc double")

    monkeypatch.setattr(hazard, plan, spy)
    entry.queries()[name](spark, sf).collect()
    assert seen["rounds"] == 300 and seen.get("trees", 200) == 200
