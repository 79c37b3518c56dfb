"""Kernels against plain definitions."""

import cmath
import math

import numpy as np
import pandas as pd
import pytest

from tidewater.operators import kernels as K
from tidewater.plans.registry import OPERATORS

rng = np.random.default_rng(7)
X = rng.normal(100, 5, 300)


def run(k, *x):
    return [np.asarray(a) for a in k.block(*x)]


def test_weighted_moments_are_those_of_pandas():
    x, y = pd.Series(X), pd.Series(rng.normal(50, 3, 300))
    e = x.ewm(alpha=0.1, adjust=True)
    np.testing.assert_allclose(run(K.EwMean(alpha=0.1), X)[0], e.mean())
    np.testing.assert_allclose(run(K.EwVar(alpha=0.1), X)[0], e.var(), rtol=1e-7)
    np.testing.assert_allclose(run(K.EwCov(alpha=0.1), X, y.to_numpy())[0], e.cov(y), rtol=1e-6, atol=1e-8)
    np.testing.assert_allclose(run(K.EwCorr(alpha=0.1), X, y.to_numpy())[0], e.corr(y), rtol=1e-6, atol=1e-8)
    assert np.allclose(run(K.EwMean(span=9), X)[0], x.ewm(span=9).mean()) and np.allclose(run(K.EwMean(halflife=3), X)[0], x.ewm(halflife=3).mean()) and np.allclose(run(K.EwMean(com=3), X)[0], x.ewm(com=3).mean())


@pytest.mark.parametrize("cls,args,low,high", [(K.Butter, (3, 0.2), (0.0, 1), (0.95, 0)), (K.ButterHighpass, (3, 0.2), (0.95, 1), (0.0, 0)), (K.ButterBandpass, (2, 0.1, 0.3), (math.sqrt(0.03), None), (0.9, 0)), (K.ButterBandstop, (2, 0.1, 0.3), (0.95, 1), (None, 0))])
def test_butterworth_response(cls, args, low, high):
    k = cls(*args)

    def gain(f):
        z = cmath.exp(-1j * math.pi * f)
        return abs(sum(b * z**i for i, b in enumerate(k.b)) / sum(a * z**i for i, a in enumerate(k.a)))

    for f in args[1:]:
        assert gain(f) == pytest.approx(1 / math.sqrt(2), rel=1e-6)
    if low[0] is not None and low[1] is not None:
        assert gain(low[0]) == pytest.approx(low[1], abs=0.01)
    if high[0] is not None:
        assert gain(high[0]) == pytest.approx(high[1], abs=0.01)


def test_recursive_filter_is_its_difference_equation():
    k = K.Butter(2, 0.3)
    y = run(k, X)[0]
    for t in range(2, 50):
        want = sum(k.b[i] * X[t - i] for i in range(3)) - sum(k.a[i] * y[t - i] for i in (1, 2))
        assert y[t] == pytest.approx(want)


def test_wilder_family():
    w, out = 5, run(K.WilderRSI(5, "strict"), X)[0]
    d = np.diff(X)
    up, down = np.maximum(d, 0), np.maximum(-d, 0)
    a, b = up[:w].mean(), down[:w].mean()
    assert np.isnan(out[:w]).all() and out[w] == pytest.approx(100 * a / (a + b))
    for t in range(w, len(d)):
        a, b = (a * (w - 1) + up[t]) / w, (b * (w - 1) + down[t]) / w
        assert out[t + 1] == pytest.approx(100 * a / (a + b))
    assert run(K.WilderRSI(2, "strict"), np.ones(5))[0][-1] == 50


def test_kama():
    n, out = 4, run(K.Kama(4, 2, 30), X)[0]
    value = X[n - 1]
    for t in range(n, len(X)):
        er = abs(X[t] - X[t - n]) / np.abs(np.diff(X[t - n : t + 1])).sum()
        value += (er * (2 / 3 - 2 / 31) + 2 / 31) ** 2 * (X[t] - value)
        assert out[t] == pytest.approx(value)
    assert np.isnan(out[:n]).all()


def test_hampel_feeds_back():
    x = np.array([1.0, 1.1, 0.9, 1.0, 9.0, 1.05, 0.95, 1.0])
    assert run(K.Hampel(5, 3.0, "cleaned", "strict"), x)[0][4] == pytest.approx(1.0)
    assert run(K.Hampel(5, 3.0, "flag", "strict"), x)[0][4:].tolist() == [1, 0, 0, 0]
    assert np.isnan(run(K.Hampel(5, 3.0, "nan", "strict"), x)[0][4])
    assert run(K.ImpulseClip(3, 4.0, "flag", "strict"), np.array([1, 1.1, 1.0, 1.1, 9, 1.0, 1.1]))[0][4:6].tolist() == [1, 0]


def test_sigma_clip():
    x = np.concatenate([rng.normal(0, 1, 60), [50.0], rng.normal(0, 1, 20)])
    out = run(K.SigmaClip(20, -3.0, 3.0, "clipped", "strict"), x)[0]
    assert out[60] < 6 and np.isnan(out[:19]).all() and out[30] == x[30]
    mean, std = K.truncated_normal(-1.0, 1.0)
    draws = rng.normal(size=400_000)
    draws = draws[np.abs(draws) < 1]
    assert mean == pytest.approx(0) and std == pytest.approx(draws.std(), rel=0.01)


def test_kalman_and_hawkes():
    k, state, v = K.KalmanFilter(0.1, 2.0, 1.0, 3.0), 1.0, 3.0
    for z in X[:30]:
        p = v + 0.1
        gain = p / (p + 2.0)
        state, v = state + gain * (z - state), (1 - gain) * p
        assert k.step(z) == pytest.approx(state)
    h = K.Hawkes(0.5, 2.0, 1.0)
    assert [h.step(x) for x in (1, 0, 0)] == [1, 2, 1.5]


def test_bayesian_regression_learns_the_line():
    x = rng.normal(size=3000)
    y = 2 + 3 * x + rng.normal(0, 0.1, 3000)
    slope, intercept, mean, std = run(K.BayesianRegression(alpha=0.01), y, x)
    assert slope[-1] == pytest.approx(3, abs=0.1) and intercept[-1] == pytest.approx(2, abs=0.1)
    assert abs(mean[-1] - y[-1]) < 5 * std[-1]


def test_vpin_splits_trades():
    k = K.Vpin(10.0, 2)
    assert math.isnan(k.step(6, 2))
    assert k.step(12, 0) == pytest.approx((6 + 10) / 2 / 10)
    assert k.buy == k.sell == 0


def test_hurst_of_noise_is_near_a_half():
    out = run(K.Hurst(256, 4, "rs"), rng.normal(size=2000))[0]
    assert np.nanmean(out) == pytest.approx(0.5, abs=0.08) and np.isnan(out[:255]).all()
    assert run(K.Hurst(64, 4, "rs"), np.cumsum(rng.normal(size=400)))[0][-1] > 0.7


def test_cycle_finds_the_period():
    t = np.arange(600)
    price = 100 + 5 * np.sin(2 * np.pi * t / 20)
    assert np.nanmean(run(K.DominantCycle(), price)[0][200:]) == pytest.approx(20, abs=1.5)
    phase = run(K.CyclePhase(), price)[0]
    assert np.isnan(phase[:40]).all() and (0 <= phase[40:]).all() and (phase[40:] < 360).all()
    mama, fama = run(K.Mama(fast_limit=0.5, slow_limit=0.05), price)
    assert mama[40] == fama[40] == price[40] and np.nanmin(mama) >= price.min() and np.nanmax(mama) <= price.max()
    assert set(np.unique(run(K.TrendMode(phase_rate_frac=0.5), price)[0][40:])) <= {0.0, 1.0}


def test_directional_movement():
    h, low, c = X + 1, X - 1, X
    out = run(K.Directional(5), h, low, c)
    up, down = np.diff(h), -np.diff(low)
    plus = np.where((up > down) & (up > 0), up, 0)
    s = plus[:4].sum() * 0.8 + plus[4]
    assert out[0][5] == pytest.approx(s) and np.isnan(out[0][:5]).all()
    assert out[0][6] == pytest.approx(s * 0.8 + plus[5]) and np.isnan(out[5][:9]).all() and not np.isnan(out[5][9])


@pytest.mark.parametrize("name,params,n_in", [
    *[("Hampel", {"window_size": k, "n_sigma": s, "output": o, "start_policy": p}, 1) for k in (1, 5, 20) for s in (1.0, 3.0) for o in ("cleaned", "flag", "nan") for p in ("strict", "expanding", "zero")],
    ("_Wilder", {"window_size": 7}, 1), ("_WilderRSI", {"window_size": 7, "start_policy": "strict"}, 1), ("_WilderRSI", {"window_size": 7, "start_policy": "zero"}, 1),
    ("_Directional", {"window_size": 6}, 3), ("HawkesIntensity", {"decay": 0.7, "alpha": 0.4, "mu": 0.1}, 1),
], ids=str)
def test_blocks_equal_steps(name, params, n_in):
    rng = np.random.default_rng(3)
    x = [rng.standard_t(2, 900).round(1) for _ in range(3)]
    x = [np.maximum(np.maximum(x[0], x[1]), x[2]), np.minimum(np.minimum(x[0], x[1]), x[2]), x[2]][-n_in:] if n_in == 3 else x[:1]
    spec = OPERATORS[name]
    one, many, whole = (spec.build(**params) for _ in range(3))
    rows = [one.step(*r) for r in zip(*(v.tolist() for v in x), strict=True)]
    want = np.array(rows, float).reshape(900, -1).T
    cuts = [0, 1, 2, 5, 5, 6, 40, 300, 900]
    parts = [many.block(*(v[s:e] for v in x)) for s, e in zip(cuts, cuts[1:], strict=False)]
    for i, w in enumerate(want):
        np.testing.assert_allclose(np.concatenate([p[i] for p in parts]), w, rtol=1e-9, atol=1e-10)
        np.testing.assert_allclose(whole.block(*x)[i] if i == 0 else w, w, rtol=1e-9, atol=1e-10)


def test_exponential_moments_of_series_without_spread():
    """Sums of squares that cancel leave neither a slope nor a spread where all values are equal."""
    from tidewater.operators import kernels as k

    x, y = np.array([6.7, 14.7]), np.array([7.675, 7.675])
    for name in ("EwBeta", "EwAlpha", "EwSpread", "EwCorr"):
        assert np.isnan(getattr(k, name)(alpha=0.25).block(x, y)[0]).all(), name
    for v in (20.58, 7.675, 0.1):
        assert k.EwStd(alpha=0.25).block(np.full(60, v))[0][1:].tolist() == [0.0] * 59
    assert (k.EwStd(alpha=0.25).block(np.array([20.055, 20.0575] * 9))[0][1:] > 0.001).all()
