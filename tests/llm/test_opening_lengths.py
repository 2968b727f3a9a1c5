"""Packing: every choice of opening lengths is tried."""

from itertools import combinations

import numpy as np

from pointloom.llm import packing


def test_the_best_of_all_subsets_of_lengths():
    better = 0
    for seed in range(40):
        rng = np.random.default_rng(seed)
        sizes = rng.integers(1, rng.choice([600, 1500, 4097]), 300)
        ordered = sizes[np.argsort(-sizes, kind="stable")]
        costs = {c: packing.best_fit(ordered, c, packing.LENGTHS)[2] for n in range(1, 5) for c in combinations(packing.LENGTHS, n)}
        got = sum(map(packing.cost, packing.pack_group(sizes)[2]))
        assert len(costs) == 15 and got == min(costs.values())
        better += got < min(v for c, v in costs.items() if len(c) in (1, 4))
    assert better
