"""The bound by parities loses no pair and tells unlike sets of any size apart."""

import numpy as np

from spindrift.llm import simhash


def test_parities_bound_what_only_one_set_has():
    rng = np.random.default_rng(3)
    spared = 0
    for n in (1, 2, 9, 200, 511, 3000):
        for m in (n, n + n // 5, 2 * n):
            for common in (0, n // 2, n - n // 10, n):
                h = rng.integers(-(2**63), 2**63 - 1, n + m - common)
                x, y = h[:n], np.concatenate([h[:common], h[n:]])
                unlike, both = len(x) + len(y) - 2 * common, len(x) + len(y)
                got = simhash._unlike(simhash._parities(x), simhash._parities(y))
                assert got <= unlike
                if n >= 200 and 3 * unlike > both:
                    assert 9 * got > both
                    spared += 1
    assert spared > 10
