"""The margin of the first cut follows the norms of the vectors."""

import numpy as np
import pytest

from tideline.llm import multi_index


@pytest.mark.parametrize("scale", [1e-9, 1.0, 1e8])
def test_rows_within_rounding_of_the_last_place_are_rescored(scale):
    rng = np.random.default_rng(2)
    v = rng.normal(size=64) * scale
    rows = np.stack([rng.permutation(v) for _ in range(400)])  # the same inner product but for rounding
    queries = np.full((1, 64), 0.1 * scale)
    ids = np.arange(400)
    exact = np.zeros(400)
    for d in range(64):
        exact += queries[0, d] * rows[:, d]
    want = sorted(ids, key=lambda i: (-exact[i], i))[:5]
    q, r, score = multi_index.best(queries, np.array([-1]), rows, ids, np.ones((1, 1), bool), np.zeros(400, int), 5)
    assert list(r) == want and list(score) == [exact[i] for i in want]
