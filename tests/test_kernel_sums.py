"""Kernel sums by box moments against direct sums."""

import math

import numpy as np
import pytest

from footfall.operators import intensity

WINDOW = (0.0, 0.0, 20000.0, 10000.0)


@pytest.mark.parametrize("nx,ny", [(160, 64), (40, 20), (5, 3), (1, 1)])
@pytest.mark.parametrize("h", [4.0, 60.0, 300.0, 1500.0, 40000.0])
def test_sums_equal_direct_ones(nx, ny, h):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.random(2000) * 20000, np.full(300, 777.0), [0.0, 20000.0, -5000.0]])
    y = np.concatenate([rng.random(2000) * 10000, np.full(300, 9999.0), [0.0, 10000.0, 30.0]])
    u = intensity.centres(WINDOW, nx, ny)
    found = intensity.KernelSums(u[:nx, 0], u[::nx, 1], h)
    for at in range(0, len(x), 500):  # moments of one box add up
        found.add(x[at : at + 500], y[at : at + 500])
    want = (np.exp(-((x[:, None] - u[:, 0]) ** 2 + (y[:, None] - u[:, 1]) ** 2) / (2 * h * h)) / (2 * math.pi * h * h)).sum(axis=0)
    bound = len(x) * 2 * intensity.MISSED / (2 * math.pi * h * h)
    assert np.abs(found.values() - want).max() <= max(bound, 1e-13 * want.max())


def test_order_follows_from_the_bound():
    assert intensity.moment_order(1e-3) < intensity.moment_order(1e-9) < intensity.moment_order(1e-15) < 30


def test_hermite_functions():
    t = np.linspace(-3, 3, 7)
    got = intensity.hermite(t, 4)
    e = np.exp(-t * t)
    assert np.allclose(got, [e, 2 * t * e, (4 * t**2 - 2) * e, (8 * t**3 - 12 * t) * e])


def test_no_points():
    assert (intensity.KernelSums(np.arange(3.0), np.arange(2.0), 1.0).values() == 0).all()
