"""ARIMA per series by exact likelihood: state-space form, Kalman filter, order by AIC, forecast with an interval.

One series per group. Input is hourly, so a group is bounded by the hours a series has
existed, not by its raw samples. Hours without a value are skipped by the filter, not closed up. All orders
of a series are fitted in one batch, so that a step of the filter is one small array operation for all of them.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostpulse.session import spread

SERIES = ("host", "measurement")
FORECAST_COLUMNS = (
    "step bigint, ds bigint, yhat double, yhat_lower double, yhat_upper double, model_order string, aic double"
)
MAX_AR = {"load_average": 3}
#: Lags of the state: AR up to 3, MA up to 2.
LAGS = 3
#: Partial autocorrelations stay within tanh(BOUND) = 0.99 of zero, so every fit is stationary and invertible.
BOUND = 2.65
ROUNDS = 8
#: Log-likelihood that a round must add for the search of an order to go on; AIC sees twice of it.
GAIN = 0.005
#: Steps that a steady filter takes at once, a power of two.
BLOCK = 64
LONG = 8


def _coefficients(partial: np.ndarray) -> np.ndarray:
    """Autoregressive coefficients of rows of partial autocorrelations (Durbin and Levinson); zeros at the end stay zeros."""
    out = np.zeros_like(partial)
    for k in range(partial.shape[1]):
        last = partial[:, k : k + 1]
        out[:, :k] = out[:, :k] - last * out[:, :k][:, ::-1]
        out[:, k] = partial[:, k]
    return out


def _partials(ar: np.ndarray) -> np.ndarray:
    """The inverse of ``_coefficients`` for one row; what is not stationary is drawn back into the bound."""
    ar, out = ar.astype(float).copy(), np.zeros(len(ar))
    for k in range(len(ar) - 1, -1, -1):
        out[k] = np.clip(ar[k], -0.95, 0.95)
        ar = (ar[:k] + out[k] * ar[:k][::-1]) / (1 - out[k] ** 2)
    return out


def _block(move: np.ndarray, gain: np.ndarray, sight: np.ndarray) -> tuple[np.ndarray, ...]:
    """What a steady filter does in BLOCK steps at once: errors and the next state, each from the state and from the values."""
    size, m, _ = move.shape
    closed = move - gain * sight
    rows, columns = np.empty((size, BLOCK, m)), np.empty((size, m, BLOCK))
    row, column, power = np.tile(sight, (size, 1, 1)), gain, closed
    for j in range(BLOCK):
        rows[:, j], columns[:, :, BLOCK - 1 - j] = row[:, 0], column[:, :, 0]
        row, column = row @ closed, closed @ column
    answers = (rows @ gain)[:, :, 0]
    lag = np.subtract.outer(np.arange(BLOCK), np.arange(BLOCK)) - 1
    back = np.where(lag >= 0, answers[:, np.maximum(lag, 0)], 0.0)
    for _ in range(int(np.log2(BLOCK))):
        power = power @ power
    return rows, back, power, columns


def _filtered(y: np.ndarray, d: int, ar: np.ndarray, ma: np.ndarray) -> dict:
    """Kalman filter over one series for a batch of coefficients, all with the same d.

    For d = 0 the state is the ARMA state from its stationary law and the mean is the one of generalised least squares. For d = 1
    the last level is a state of its own with a diffuse start: the first value sets it and enters no likelihood.
    The variance is concentrated out. ``y`` begins with a value; nan is a missing hour.
    """
    size, m = len(ar), LAGS + d
    move, shock = np.zeros((size, m, m)), np.zeros((size, m))
    move[:, d:, d] = ar
    for i in range(LAGS - 1):
        move[:, d + i, d + i + 1] = 1.0
    shock[:, d], shock[:, d + 1 :] = 1.0, ma
    if d:
        move[:, 0, 0] = move[:, 0, 1] = 1.0
    noise = shock[:, :, None] * shock[:, None, :]
    inner = move[:, d:, d:]
    pairs = np.einsum("bij,bkl->bikjl", inner, inner).reshape(size, LAGS**2, LAGS**2)
    cov = np.zeros((size, m, m))
    cov[:, d:, d:] = np.linalg.solve(np.eye(LAGS**2) - pairs, noise[:, d:, d:].reshape(size, -1, 1)).reshape(size, LAGS, LAGS)
    state = np.zeros((size, m, 1 if d else 2))  # second column: the filter's answer to a constant one
    if d:
        state[:, 0, 0] = y[0]
    turned = move.transpose(0, 2, 1)
    sight = np.zeros(m)
    sight[: d + 1] = 1.0
    inputs = np.column_stack([y] if d else [y, np.ones(len(y))])
    known = np.isfinite(y)
    gap = np.append(np.flatnonzero(~known), len(y))
    errors, variances = [], []
    steady, many = False, None
    t = d
    while t < len(y):
        if not known[t]:
            state, steady, many = move @ state, False, None
            cov = move @ cov @ turned + noise
            t += 1
            continue
        if steady and gap[np.searchsorted(gap, t)] - t >= BLOCK:
            many = many or _block(move, gain, sight)
            block = inputs[t : t + BLOCK]
            errors.append(block - many[0] @ state - many[1] @ block)
            state = many[2] @ state + many[3] @ block
            variances.append(np.repeat(var[:, None], BLOCK, 1))
            t += BLOCK
            continue
        if not steady:
            seen = cov @ sight
            var = seen @ sight
            gain = move @ (seen / var[:, None])[:, :, None]
            after = move @ cov @ turned + noise - gain * var[:, None, None] * gain.transpose(0, 2, 1)
            steady = t % 4 == 0 and bool(np.abs(after - cov).max() < 1e-8)
            cov = after
        error = inputs[t] - (state[:, 0] + state[:, 1] if d else state[:, 0])
        state = move @ state + gain * error[:, None, :]
        errors.append(error[:, None, :])
        variances.append(var[:, None])
        t += 1
    e, f = np.concatenate(errors, 1), np.concatenate(variances, 1)
    n = e.shape[1]
    if d:
        mean = np.zeros(size)
        square = (e[:, :, 0] ** 2 / f).sum(1)
        last = state[:, :, 0]
    else:
        mean = (e[:, :, 0] * e[:, :, 1] / f).sum(1) / (e[:, :, 1] ** 2 / f).sum(1)
        square = ((e[:, :, 0] - mean[:, None] * e[:, :, 1]) ** 2 / f).sum(1)
        last = state[:, :, 0] - mean[:, None] * state[:, :, 1]
    var = np.maximum(square / n, 1e-12)
    loglik = -0.5 * (n * (np.log(2 * np.pi * var) + square / (n * var)) + np.log(f).sum(1))
    return {"loglik": loglik, "var": var, "mean": mean, "state": last, "cov": cov, "move": move, "noise": noise, "n": n}


def _coefficients_of(u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    partial = np.tanh(u)
    return _coefficients(partial[:, :LAGS]), -_coefficients(partial[:, LAGS:])


def _lags(w: np.ndarray, n: int, start: int) -> np.ndarray:
    return np.column_stack([w[start - i : len(w) - i] for i in range(1, n + 1)]) if n else np.empty((len(w) - start, 0))


def _first_guess(y: np.ndarray, orders: Sequence[tuple[int, int, int]]) -> np.ndarray:
    """Where the search starts, a row per order: a long autoregression supplies the shocks that the MA terms regress on."""
    d = orders[0][1]
    seen = y[np.isfinite(y)]
    w = np.diff(seen) if d else seen - seen.mean()
    long = min(LONG, len(w) // 4)
    x = _lags(w, long, long)
    shocks = np.concatenate([np.zeros(long), w[long:] - x @ np.linalg.lstsq(x, w[long:], rcond=None)[0]])
    out = np.zeros((len(orders), 2 * LAGS - 1))
    for row, (p, _, q) in zip(out, orders):
        start = max(p, long + q if q else 0)
        x = np.hstack([_lags(w, p, start), _lags(shocks, q, start)])
        if p + q:
            beta = np.linalg.lstsq(x, w[start:], rcond=None)[0]
            row[:p], row[LAGS : LAGS + q] = _partials(beta[:p]), _partials(-beta[p:])
    return np.arctanh(out)


def _fit(y: np.ndarray, orders: Sequence[tuple[int, int, int]]) -> list[dict]:
    """Maximum likelihood for orders of one d, all in one batch: BFGS within bounds, three step lengths at once."""
    d, size, width = orders[0][1], len(orders), 2 * LAGS - 1
    free = np.zeros((size, width), dtype=bool)
    for row, (p, _, q) in zip(free, orders):
        row[:p] = row[LAGS : LAGS + q] = True

    def cost(u: np.ndarray) -> np.ndarray:
        got = _filtered(y, d, *_coefficients_of(u))
        return -got["loglik"] / got["n"]

    def slope(u: np.ndarray, here: np.ndarray, mask: np.ndarray) -> np.ndarray:
        out = np.zeros(u.shape)
        row, col = np.nonzero(mask)
        if len(row):
            ends = u[row]
            ends[np.arange(len(row)), col] += 1e-5
            out[row, col] = (cost(ends) - here[row]) / 1e-5
        return out

    known = np.isfinite(y).sum()
    u = np.clip(_first_guess(y, orders), -BOUND, BOUND)
    zero, now = cost(np.concatenate([np.zeros_like(u), u])).reshape(2, size)
    worse = zero < now
    u[worse], now[worse] = 0.0, zero[worse]
    # An AR and an MA term that cancel leave no slope: start beside the ridge.
    flat = worse & (free.sum(1) > 1)
    u[flat] = np.where(free[flat], 0.1, 0.0)
    now[flat] = cost(u[flat]) if flat.any() else now[flat]
    curve = np.repeat(np.eye(width)[None], size, 0)
    grad = slope(u, now, free)
    open_ = np.arange(size)
    lengths = np.array([1.0, 0.3, 0.05])
    for _ in range(ROUNDS):
        open_ = open_[np.abs(grad[open_]).max(1) > 1e-4]
        if not len(open_):
            break
        way = -np.einsum("bij,bj->bi", curve[open_], grad[open_])
        way *= np.minimum(1.0, 1.5 / np.maximum(np.abs(way).max(1), 1e-12))[:, None]
        tried = np.clip(u[open_][:, None] + lengths[None, :, None] * way[:, None], -BOUND, BOUND)
        value = cost(tried.reshape(-1, width)).reshape(len(open_), -1)
        best = np.nanargmin(np.where(np.isfinite(value), value, np.inf), 1)
        index = np.arange(len(open_))
        better = value[index, best] < now[open_] - GAIN / known
        open_, tried, value = open_[better], tried[index, best][better], value[index, best][better]
        if not len(open_):
            break
        step, old = tried - u[open_], grad[open_]
        u[open_], now[open_] = tried, value
        grad[open_] = slope(u[open_], now[open_], free[open_])
        change = grad[open_] - old
        along = (step * change).sum(1)
        for i, s, g, a in zip(open_, step, change, along):
            if a > 1e-12:
                left = np.eye(width) - np.outer(s, g) / a
                curve[i] = left @ curve[i] @ left.T + np.outer(s, s) / a
            else:
                curve[i] = np.eye(width)
    ar, ma = _coefficients_of(u)
    got = _filtered(y, d, ar, ma)
    return [
        {
            "order": (p, d, q), "ar": ar[i, :p], "ma": ma[i, :q], "const": float(got["mean"][i] * (1 - ar[i].sum())),
            "mean": float(got["mean"][i]), "var": float(got["var"][i]), "loglik": float(got["loglik"][i]),
            "aic": float(2 * (p + q + 1 + (0 if d else 1)) - 2 * got["loglik"][i]),
            "state": got["state"][i], "cov": got["cov"][i], "move": got["move"][i], "noise": got["noise"][i],
        }
        for i, (p, _, q) in enumerate(orders)
    ]


def _fitted(y: np.ndarray, orders: Sequence[tuple[int, int, int]]) -> list[dict]:
    """Fits of the orders that the series has values enough for; leading missing hours are cut."""
    known = np.flatnonzero(np.isfinite(y))
    if not len(known):
        return []
    y = y[known[0] :]
    out = []
    for d in (0, 1):
        usable = [o for o in orders if o[1] == d and len(known) - d >= 3 * (o[0] + o[2] + 2)]
        if usable:
            out += [m for m in _fit(y, usable) if np.isfinite(m["aic"])]
    return out


def estimate(y: np.ndarray, order: tuple[int, int, int]) -> dict | None:
    """One order by exact maximum likelihood; nan is a missing hour. AR up to 3, d up to 1, MA up to 2."""
    return next(iter(_fitted(np.asarray(y, dtype=float), [order])), None)


def best_model(y: np.ndarray, max_ar: int = 2) -> dict | None:
    """Lowest AIC over p up to ``max_ar``, d up to 1 and q up to 2."""
    found = _fitted(np.asarray(y, dtype=float), list(product(range(max_ar + 1), range(2), range(3))))
    return min(found, key=lambda m: m["aic"]) if found else None


def predict(model: dict, y: np.ndarray, periods: int, width: float = 0.95) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean path after the last hour of ``y`` and its interval, from the filter's last state and covariance."""
    d, state, cov = model["order"][1], model["state"], model["cov"]
    seen = np.zeros(len(state))
    seen[: d + 1] = 1.0
    mid, var = np.zeros(periods), np.zeros(periods)
    for k in range(periods):
        mid[k], var[k] = seen @ state, seen @ cov @ seen
        state, cov = model["move"] @ state, model["move"] @ cov @ model["move"].T + model["noise"]
    mid = mid + model["mean"]
    reach = NormalDist().inv_cdf(0.5 + width / 2) * np.sqrt(model["var"] * np.maximum(var, 0.0))
    return mid, mid - reach, mid + reach


def by_hour(clock: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Values on the grid of hours from the first to the last, nan where an hour has none; of several the last counts."""
    place = (clock - clock[0]) // 3600
    out = np.full(int(place[-1]) + 1, np.nan)
    out[place] = value
    return out


def forecast(
    series: DataFrame, periods: int | str = 24, minimum: int = 30, by: Sequence[str] = SERIES, clock: str = "clock"
) -> DataFrame:
    """Hourly forecast per series of (keys, clock, value, data_type) rows; short series are absent.

    ``periods`` is a number of hours, or the column that holds each series' own. Where no order can be estimated the last value is carried on, ten percent either way.
    """
    keys = list(by)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(clock)
        y = by_hour(pdf[clock].to_numpy(dtype="int64"), pdf["value"].to_numpy(dtype=float))
        model = best_model(y, MAX_AR.get(pdf["data_type"].iloc[0], 2))
        ahead = int(pdf["_periods"].iloc[0])
        steps = np.arange(1, ahead + 1, dtype="int64")
        if model is None:
            mid = np.full(ahead, y[-1])
            low, high, order, aic = mid * 0.9, mid * 1.1, None, np.nan
        else:
            mid, low, high = predict(model, y, ahead)
            order, aic = ",".join(map(str, model["order"])), model["aic"]
        return pd.DataFrame(
            {
                **{k: pdf[k].iloc[0] for k in keys},
                "step": steps, "ds": int(pdf[clock].iloc[-1]) + steps * 3600,
                "yhat": mid, "yhat_lower": low, "yhat_upper": high, "model_order": order, "aic": aic,
            }
        )

    enough = series.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") >= minimum).select(*keys)
    series = series.withColumn("_periods", F.col(periods) if isinstance(periods, str) else F.lit(periods))
    known = series.where(F.col("value").isNotNull()).join(enough, keys, "left_semi")
    key_types = ", ".join(f"{k} string" for k in keys)
    return spread(known.select(*keys, clock, "value", "data_type", "_periods"), *keys).groupBy(*keys).applyInPandas(
        one, f"{key_types}, {FORECAST_COLUMNS}"
    )
