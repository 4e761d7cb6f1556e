"""Published values of the tail functions."""

import numpy as np
import pytest

from minekit.functions import special


def test_t_tail_and_quantile():
    assert special.t_quantile(0.975, 10) == pytest.approx(2.2281388520, abs=1e-8)
    assert special.t_quantile(0.975, 1) == pytest.approx(12.7062047364, abs=1e-6)
    assert special.t_two_sided(2.2281388520, 10) == pytest.approx(0.05, abs=1e-9)
    assert special.t_two_sided(0.0, 5) == pytest.approx(1.0)


def test_beta_is_symmetric():
    x = np.linspace(0.01, 0.99, 23)
    assert np.allclose(special.beta_cdf(2.5, 4.0, x) + special.beta_cdf(4.0, 2.5, 1 - x), 1.0)
    assert np.allclose(special.beta_cdf(1.0, 1.0, x), x)


def test_binomial_interval_and_tail():
    low, high = special.binomial_interval(8, 10)
    assert low == pytest.approx(0.4439045, abs=1e-6) and high == pytest.approx(0.9747893, abs=1e-6)
    low, high = special.binomial_interval(0, 10)
    assert low == 0.0 and high == pytest.approx(0.3084971, abs=1e-6)
    assert special.binomial_upper_tail(8, 10, 0.5) == pytest.approx(56 / 1024, abs=1e-10)


def test_large_counts_stay_accurate():
    # about normal: p = 0.5, one standard deviation above the mean
    assert special.binomial_upper_tail(500_500, 1_000_000, 0.5) == pytest.approx(0.15890, abs=5e-4)


def test_chi_squared_tail():
    assert special.chi_squared_tail(3.841458821, 1) == pytest.approx(0.05, abs=1e-8)
    assert special.chi_squared_tail(7.814727903, 3) == pytest.approx(0.05, abs=1e-8)
