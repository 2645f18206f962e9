"""Near copies where buckets are full of them, and where a large table makes items meet by chance."""

import tracemalloc

import numpy as np

from strandline.llm import near, simhash


def test_memory_of_a_bucket_of_copies():
    """All pairs of one bucket are within the radius: they aren't held at once."""
    rng = np.random.default_rng(0)
    values = rng.integers(0, 2**64, (1, 2), np.uint64) ^ (np.uint64(1) << rng.integers(0, 64, (3000, 2)).astype(np.uint64))
    tracemalloc.start()
    try:
        label = simhash.linked(np.array([3000]), values, 38)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert not label.any() and peak < 150e6


def test_only_similar_sets_are_within_the_radius():
    """Sets of similarity 0.8 lie within the radius, those of 0.3 don't, however often they meet."""
    rng = np.random.default_rng(2)

    def within(shared, each, pairs=1500):
        sets = [np.unique(np.concatenate([c, rng.integers(0, 2**64, each, np.uint64)])) for c in rng.integers(0, 2**64, (pairs, shared), np.uint64) for _ in range(2)]
        fp = near.fingerprints(sets)[:, : near.PLANES // 64]
        return (np.bitwise_count(fp[::2] ^ fp[1::2]).sum(1) <= near.RADIUS).mean()

    assert within(320, 40) == 1  # 320 of 400
    assert within(120, 140) < 0.01  # 120 of 400
