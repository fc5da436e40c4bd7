"""The largest values of a dimension that equal the first edge of its levels (multiples of LEVELS) are added, too."""

import numpy as np
import pytest

from tallyloom.llm.topk import LEVELS, ImpactBlock


@pytest.mark.parametrize("largest", [16, 32, 64])
def test_each_posting_is_in_one_segment(largest):
    rows = np.random.default_rng(largest).integers(-largest, largest + 1, (300, 4))
    rows[0], rows[1] = largest, -largest
    block = ImpactBlock(np.arange(300), rows)
    assert (np.diff(block.cuts, axis=1).sum(axis=1) == len(rows)).all()
    for d in range(4):
        for level in range(LEVELS):
            own = np.abs(block.values[d, block.cuts[d, level] : block.cuts[d, level + 1]])
            assert (own <= block.edges[d, level]).all()


@pytest.mark.parametrize("largest", [16, 32, 64])
def test_the_largest_component_decides(largest):
    """Rows with the largest value, of either sign, in one dimension; without it, others would be the best."""
    rng = np.random.default_rng(largest)
    rows = rng.integers(-3, 4, (2000, 8))
    top, bottom = rng.choice(2000, 40, replace=False).reshape(2, 20)
    rows[top, 0], rows[bottom, 0] = largest, -largest
    rows[bottom, 1] = largest // 2
    ids = np.arange(2000)
    block = ImpactBlock(ids, rows)
    for query in ([4, 1, 0, 1, -1, 2, 1, 0], [-4, 3, 1, 0, 0, 1, -2, 1], [4, 4, 1, 1, 1, 1, 1, 1]):
        query = np.array(query)
        scores = rows @ query
        best = np.lexsort((ids, -scores))[:5]
        got_ids, got = block.search(-1, query, 5)
        assert got_ids.tolist() == best.tolist() and got.tolist() == scores[best].tolist()
