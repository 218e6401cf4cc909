"""Cap filters at several widths and thresholds."""

import numpy as np
import pytest

from auditweave.llm import embed_dedup
from auditweave.llm.vectors import unit


@pytest.mark.parametrize("width,threshold,rows", [(64, 0.9, 2_000), (64, 0.9, 50_000), (64, 0.9, 2_000_000), (128, 0.9, 50_000), (384, 0.9, 50_000), (128, 0.7, 50_000)])
def test_pairs_at_the_threshold_share_a_filter(width, threshold, rows):
    codes = embed_dedup.codes_for(rows)
    rng = np.random.default_rng(width)
    x = unit(rng.normal(size=(300, width)))
    apart = rng.normal(size=x.shape)
    apart = unit(apart - (apart * x).sum(1, keepdims=True) * x)
    cap = embed_dedup.cap_of(width, threshold, codes)
    found = [set(zip(*map(np.ndarray.tolist, embed_dedup.filters_of(v, cap, codes)[:2]))) for v in (x, threshold * x + np.sqrt(1 - threshold**2) * apart)]
    print(width, threshold, "cap", round(cap, 4), "filters a vector", len(found[0]) / 300, "missed", 300 - len({r for r, _ in found[0] & found[1]}))
    assert {r for r, _ in found[0] & found[1]} == set(range(300))


def test_rounded_products_lose_no_pair():
    rng = np.random.default_rng(4)
    x = unit(rng.normal(size=(90, 24)))
    y = unit(x + 0.1 * rng.normal(size=x.shape))
    both = np.concatenate((x[:40], y[:40], x[40:]))
    starts = np.array([0, 80, 90, 91, len(both)])
    i, j = embed_dedup.close_pairs(embed_dedup.rounded(both), starts, 0.9)
    cos = both @ both.T
    assert (cos[i, j] >= 0.88).all()
    want = {(a, a + 40) for a in range(40) if cos[a, a + 40] >= 0.9}
    found = set(zip(np.minimum(i, j).tolist(), np.maximum(i, j).tolist()))
    assert want <= found  # alone in their trees: no other pair of this bucket is near
