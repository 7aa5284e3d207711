"""The checkpointed steps of the hazard fit hold what it reads and nothing more."""

import pytest

from tideline.catalog import memo, sequences
from tideline.fixtures.views import Fixtures
from tideline.plans import hazard


def test_fit_checkpoints_only_what_it_reads(spark, sf, monkeypatch):
    seen = []

    def spy(steps, observed, names):
        seen.append(set(observed.columns))
        raise RuntimeError("seen")

    memo.forget()
    monkeypatch.setattr(hazard, "fit_index", spy)
    with pytest.raises(RuntimeError, match="seen"):
        sequences.fitted(Fixtures(spark, sf))
    assert seen == [{"loan_id", "t", "zbc", "event_step", "y", *sequences.MODEL_FEATURES}]
