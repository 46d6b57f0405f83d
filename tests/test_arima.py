"""ARIMA by exact likelihood: equal to the dense Gaussian one, also with missing hours; planted orders are found."""

import numpy as np
import pytest

from hostpulse.operators import arima


def dense_loglik(y, d, ar, ma):
    """Concentrated Gaussian log-likelihood from the covariance matrix of all known values."""
    weights = np.zeros(3000)
    for k in range(3000):
        own = 1.0 if k == 0 else (ma[k - 1] if k <= len(ma) else 0.0)
        weights[k] = own + sum(ar[i] * weights[k - 1 - i] for i in range(min(len(ar), k)))
    n = len(y) - d
    lags = np.array([weights[: 3000 - h] @ weights[h:] for h in range(n)])
    cov = lags[np.abs(np.subtract.outer(np.arange(n), np.arange(n)))]
    known, z = np.isfinite(y)[d:], y[d:]
    if d:
        summed = np.tril(np.ones((n, n)))
        cov, z = summed @ cov @ summed.T, z - y[0]
    cov, z = cov[np.ix_(known, known)], z[known]
    inverse = np.linalg.inv(cov)
    if not d:
        z = z - inverse.sum(0) @ z / inverse.sum()
    var = z @ inverse @ z / len(z)
    return -0.5 * (len(z) * (np.log(2 * np.pi * var) + 1) + np.linalg.slogdet(cov)[1])


@pytest.mark.parametrize("d", [0, 1])
@pytest.mark.parametrize("ar, ma", [([0.5], [0.3]), ([0.4, -0.2, 0.3], [0.5, 0.2]), ([], [0.6, 0.1]), ([0.95], []), ([], [])])
@pytest.mark.parametrize("missing", [[], [3, 4, 30, 190, 191, 192, 239]])
def test_likelihood_equals_the_dense_one(d, ar, ma, missing):
    rng = np.random.default_rng(5)
    y = np.cumsum(rng.normal(size=240)) + 3
    y[missing] = np.nan
    rows = np.zeros((1, 3)), np.zeros((1, 2))
    rows[0][0, : len(ar)], rows[1][0, : len(ma)] = ar, ma
    assert arima._filtered(y, d, *rows)["loglik"][0] == pytest.approx(dense_loglik(y, d, ar, ma), abs=1e-3)


def planted(n, ar, ma, seed):
    e = np.random.default_rng(seed).normal(size=n + 2)
    w = np.zeros(n)
    for t in range(n):
        w[t] = e[t + 2] + sum(a * w[t - 1 - i] for i, a in enumerate(ar) if t > i) + sum(m * e[t + 1 - j] for j, m in enumerate(ma))
    return w


def test_planted_orders_are_found():
    assert arima.best_model(planted(900, [0.6], [0.4], 1) + 5)["order"] == (1, 0, 1)
    assert arima.best_model(np.cumsum(planted(900, [0.6], [], 2)))["order"][1] == 1
    assert arima.best_model(planted(900, [0.3, 0.5], [], 3))["order"] == (2, 0, 0)


def test_fit_is_a_maximum():
    y = planted(400, [0.7, -0.3], [0.5], 8)
    model = arima.estimate(y, (2, 0, 1))
    best = dense_loglik(y, 0, model["ar"], model["ma"])
    assert model["loglik"] == pytest.approx(best, abs=1e-3)
    for i in range(3):
        for h in (-0.05, 0.05):
            moved = np.concatenate([model["ar"], model["ma"]])
            moved[i] += h
            assert dense_loglik(y, 0, moved[:2], moved[2:]) < best + 1e-6
    assert (np.diff(np.subtract(*arima.predict(model, y, 30)[2:0:-1])) >= -1e-9).all()


def test_missing_hours_are_skipped_not_closed_up():
    whole = planted(1200, [0.9], [], 4) + 20
    known = np.random.default_rng(9).random(1200) < 0.5
    known[[0, -1]] = True
    y = np.where(known, whole, np.nan)
    assert arima.estimate(y, (1, 0, 0))["ar"][0] == pytest.approx(0.9, abs=0.04)
    assert arima.estimate(y[known], (1, 0, 0))["ar"][0] < 0.86
    clock = 1704067200 + 3600 * np.flatnonzero(known)
    assert np.array_equal(arima.by_hour(clock, whole[known]), y, equal_nan=True)


def test_level_and_constant_series_have_finite_forecasts():
    flat = np.full(60, 7.0)
    for order in ((0, 0, 0), (1, 1, 1)):
        mid, low, high = arima.predict(arima.estimate(flat, order), flat, 5)
        assert mid == pytest.approx([7.0] * 5, abs=1e-3) and np.isfinite(low).all() and (low <= high).all()
    assert arima.best_model(flat) is not None and arima.estimate(flat[:4], (2, 1, 2)) is None
    assert arima.best_model(np.full(40, np.nan)) is None


def test_held_out_values_are_covered():
    inside = []
    for seed in range(40):
        y = planted(324, [0.7], [0.3], 100 + seed)
        model = arima.estimate(y[:300], (1, 0, 1))
        _, low, high = arima.predict(model, y[:300], 24)
        inside.append(((low <= y[300:]) & (y[300:] <= high)).mean())
    assert np.mean(inside) == pytest.approx(0.95, abs=0.05)
