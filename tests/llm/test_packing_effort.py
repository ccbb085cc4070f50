"""The genetic search goes on where best fit alone is above the lower bound."""

import numpy as np

from auditframe.llm import packing


def test_generations_improve_hard_blocks():
    sizes = np.random.default_rng(5).integers(500, 1100, 4096)
    used = []
    for seed in (0, 1):
        elite = packing.evolve(sizes, [], seed, 2048)
        genes = packing.evolve(sizes, [elite], seed + 2, 2048)
        assert np.bincount(genes, sizes).max() <= 2048
        used.append(int(genes.max()) + 1)
    assert max(used) <= 1707  # 1,710 and 1,723 with three members and four generations
