"""The sums behind the latent space of `leaks`, against plain ones."""

import numpy as np
import pytest

from voxloom.llm import decontamination as dc


@pytest.mark.parametrize("lengths", [[0], [5], [32, 33, 0, 1, 700], [1] * 300])
def test_passages_meet_their_buckets(lengths):
    r = np.random.default_rng(3)
    bits, lengths = 5, np.array(lengths)
    words = (r.integers(0, 1 << 16, int(lengths.sum())) ** 2).astype(np.uint32)
    dense = []
    for text in np.split(words >> np.uint32(32 - bits), np.cumsum(lengths)[:-1]):
        dense += [np.isin(np.arange(1 << bits), text[i : i + dc.PASSAGE]) for i in range(0, len(text), dc.PASSAGE)]
    dense = np.array(dense, np.float64).reshape(-1, 1 << bits)
    values = np.r_[r.standard_normal((1 << bits, 3)), np.zeros((1, 3))].astype(np.float32)
    rows, total = dc.passages(lengths, words, bits), np.ones((1 << bits, 3), np.float32)
    seen = dc.row_sums(rows, values)
    dc.spread(rows, seen, total)
    assert np.allclose(seen, dense @ values[:-1], atol=1e-4)
    assert np.allclose(total, 1 + dense.T @ (dense @ values[:-1]), rtol=1e-4, atol=1e-3)


@pytest.mark.parametrize("n", [1, 30, 31, 32, 64_000])
def test_running_sums_keep_their_digits(n):
    r = np.random.default_rng(4)
    values, at = r.standard_normal((500, 8)).astype(np.float32) + 1, r.integers(0, 500, n)
    exact = np.r_[np.zeros((1, 8)), np.cumsum(values[at].astype(np.float64), axis=0)]
    # one running float32 sum is off by more than 2 in the end
    assert np.abs(dc.running_sums(values, at)[: n + 1] - exact).max() < 0.1
