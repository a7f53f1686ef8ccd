"""Pairs at the threshold must share a cell, however many pivots there are."""

import numpy as np
import pytest

from tabulon.llm import embeddings


def recall(pivots: int, dim: int, pairs: int, cosine: float = embeddings.THRESHOLD) -> float:
    rng = np.random.default_rng(3)
    points, a = (embeddings.unit(rng.standard_normal((n, dim))) for n in (pivots, pairs))
    other = rng.standard_normal((pairs, dim))
    other = embeddings.unit(other - (other * a).sum(1, keepdims=True) * a)
    b = cosine * a + np.sqrt(1 - cosine**2) * other
    near = [embeddings.nearest_cells(x, points) for x in (a, b)]
    return float((near[0][:, :, None] == near[1][:, None, :]).any((1, 2)).mean())


@pytest.mark.parametrize("pivots", [12, 300, 3000, 8000])
def test_pairs_at_the_threshold_meet(pivots):
    assert recall(pivots, 64, 4000) >= 0.999


def test_cells_rise_with_pivots():
    assert embeddings.cells_among(embeddings.MAX_PIVOTS) > embeddings.cells_among(300) > embeddings.CELLS
    assert embeddings.pivots_for(10) == 8 and embeddings.pivots_for(10**9) == embeddings.MAX_PIVOTS
