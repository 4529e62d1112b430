"""Median slopes by counting, against all pairs."""

import time

import numpy as np
import pytest

from gaugeworks.operators import robust as R


def test_pairs_are_counted():
    rng = np.random.default_rng(1)
    for n in (1, 2, 5, 40, 300):
        for z in (rng.integers(0, 6, n).astype(float), rng.random(n), np.zeros(n)):
            assert R.pairs_not_rising(z) == sum(z[j] <= z[i] for i in range(n) for j in range(i + 1, n))


@pytest.mark.parametrize("n", [50, 401, 1200])
def test_median_slope_equals_all_pairs(monkeypatch, n):
    rng = np.random.default_rng(n)
    lines = [rng.random(n) * 100, rng.integers(0, n // 2, n).astype(float), np.repeat([1.0, 2.0], [n - 1, 1])]
    heights = [rng.standard_normal(n) * 10, rng.integers(0, 5, n).astype(float), np.zeros(n), rng.standard_cauchy(n) * 1e6]
    for x in lines:
        for y in (3 * x + h for h in heights):
            want = np.median(np.concatenate([np.zeros(0), *R.slope_blocks(np.sort(x), y[np.argsort(x, kind="stable")], 1e-9)]))
            with monkeypatch.context() as m:
                m.setattr(R, "HELD", 0)
                m.setattr(R, "SQUARE_ROWS", 0)
                assert R.slopes_median(x, y) == pytest.approx(want, rel=1e-9, abs=1e-9)
    with monkeypatch.context() as m:
        m.setattr(R, "HELD", 0)
        m.setattr(R, "SQUARE_ROWS", 0)
        assert R.slopes_median(np.ones(n), np.arange(n, dtype=float)) is None


def test_a_long_key_takes_no_square():
    rng = np.random.default_rng(3)
    x = rng.random(100_000) * 1e4
    began = time.process_time()
    slope = R.slopes_median(x, 2.5 * x + rng.standard_normal(len(x)) * 50)
    assert abs(slope - 2.5) < 1e-2 and time.process_time() - began < 60
