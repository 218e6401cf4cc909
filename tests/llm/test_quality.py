import numpy as np

from auditweave.llm import quality
from auditweave.llm.common import WordHashes


def test_features_use_all_indices():
    index, _ = quality.features(" ".join(f"w{i}" for i in range(50_000)), WordHashes())
    assert index[0] == 0 and 1 <= index[1:].min() and index.max() < 1 << quality.BITS
    assert abs((index % 2).mean() - 0.5) < 0.02 and len(np.unique(index)) == len(index) > 75_000
