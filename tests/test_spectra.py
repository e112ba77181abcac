"""Kernels of the spectrum against what they must do to plain waves, and a written-out transform."""

import numpy as np
import pytest

from stepwright.functions import feature_kernels as K
from stepwright.functions import kernels as N


def test_halving_keeps_low_waves_and_stops_high_ones():
    t = np.arange(400)
    low, high = np.sin(2 * np.pi * 0.03 * t), np.sin(2 * np.pi * 0.35 * t)
    assert np.abs(N.halved(low) - low[::2])[20:-20].max() < 0.02
    assert np.abs(N.halved(high))[20:-20].max() < 0.01
    both = N.halved(np.array([low, high]))
    assert np.allclose(both[0], N.halved(low)) and np.allclose(both[1], N.halved(high))
    # a level passes but for the filter's ripple of 0.05 decibels each way, as the published design has it
    assert np.allclose(N.halved(np.full(50, 3.0)), 3.0 * 10 ** (-0.1 / 20)) and np.array_equal(N.halved(np.arange(6.0)), [0, 2, 4])


@pytest.mark.parametrize("size,n", [(16, 24), (16, 9), (15, 32), (15, 6), (16, 8), (8, 16), (1, 5), (7, 7)])
def test_fourier_resampling_is_exact_for_waves_below_the_limit(size, n):
    t, u = np.arange(size) / size, np.arange(n) / n
    k = 1 if min(size, n) > 2 else 0
    wave = lambda v: 2.0 + 0.5 * np.cos(2 * np.pi * k * v) - 0.25 * np.sin(2 * np.pi * k * v)
    assert np.allclose(N.fourier(wave(t), n), wave(u))


def test_fourier_resampling_of_nothing():
    assert N.fourier(np.zeros(0), 4).tolist() == [0, 0, 0, 0]


def test_spectrum_of_a_wave_and_of_flat_series():
    t = np.arange(64)
    power, centre, width, entropy, top = K.spectral(5 + np.cos(2 * np.pi * 8 * t / 64))
    assert power == pytest.approx(32.0**2) and centre == pytest.approx(0.125) and width == pytest.approx(0, abs=1e-6) and entropy == pytest.approx(0, abs=1e-6) and top == 0.125
    assert K.spectral(np.full(10, 3.3)) == [0.0] * 5 and K.spectral(np.array([1.0])) == [0.0] * 5
