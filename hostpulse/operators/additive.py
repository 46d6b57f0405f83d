"""Additive seasonal regression per series: fit by summed normal equations, forecast with an interval.

The model is trend with changepoints, daily and weekly seasons and a season that acts in
business hours only. Fitting needs only X'X and X'y, which add up over rows: every chunk
of a series contributes one small matrix, so a long or hot series is fitted from matrices
made in parallel and only the 50-column solve is done per series. Slope changes have Laplace
priors, so most of them are exactly zero; the interval holds the noise and the slope changes to come.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostpulse.session import spread

CHANGEPOINTS = 25
CHANGEPOINT_RANGE = 0.8
DAILY_ORDER, WEEKLY_ORDER, BUSINESS_ORDER = 4, 3, 3
WIDTH = 2 + CHANGEPOINTS + 2 * (DAILY_ORDER + WEEKLY_ORDER + BUSINESS_ORDER)
DAY, WEEK = 86400.0, 7 * 86400.0
SQUEEZE = 1e-3

SERIES = ("host", "measurement")
MODEL_COLUMNS = (
    "beta array<double>, sigma double, first_clock bigint, last_clock bigint, level double, growth string, "
    "cap double, floor double, business_hours boolean, interval_width double, data_type string, rows bigint"
)


#: Rows of a series whose sums are taken together.
BLOCK_ROWS = 50_000


def _fourier(clock: np.ndarray, period: float, order: int) -> list[np.ndarray]:
    angle = 2 * np.pi * np.asarray(clock, dtype=float)[:, None] / period * np.arange(1, order + 1)
    return [np.sin(angle), np.cos(angle)]


def design(clock: np.ndarray, first: float, last: float, business: np.ndarray) -> np.ndarray:
    """One row per time: level, slope, slope changes, seasons."""
    t = (np.asarray(clock, dtype=float) - first) / max(last - first, 1.0)
    turns = np.linspace(0, CHANGEPOINT_RANGE, CHANGEPOINTS + 1)[1:]
    work = np.asarray(business, dtype=float)[:, None]
    return np.hstack(
        [
            np.ones((len(t), 1)),
            t[:, None],
            np.maximum(t[:, None] - turns, 0.0),
            *_fourier(clock, DAY, DAILY_ORDER),
            *_fourier(clock, WEEK, WEEKLY_ORDER),
            *[f * work for f in _fourier(clock, DAY, BUSINESS_ORDER)],
        ]
    )


def _business(clock: np.ndarray, enabled: bool) -> np.ndarray:
    hour, day = (clock // 3600) % 24, (clock // 86400 + 3) % 7
    return ((hour >= 9) & (hour <= 17) & (day < 5)) & bool(enabled)


def _to_scale(y: np.ndarray, growth: str, cap: float, floor: float, level: float) -> np.ndarray:
    if growth != "logistic":
        return y / level
    share = np.clip((y - floor) / (cap - floor), SQUEEZE, 1 - SQUEEZE)
    return np.log(share / (1 - share))


def _from_scale(v: np.ndarray, growth: str, cap: float, floor: float, level: float) -> np.ndarray:
    if growth != "logistic":
        return v * level
    return floor + (cap - floor) / (1 + np.exp(-v))


def _chunk_sums(pdf: pd.DataFrame) -> pd.DataFrame:
    """Normal-equation sums of one chunk of one series."""
    one = pdf.iloc[0]
    floor = 0.0 if pd.isna(one["floor"]) else one["floor"]
    clock = pdf["ds"].to_numpy()
    x = design(clock, one["first_clock"], one["last_clock"], _business(clock, one["business_hours"]))
    y = _to_scale(pdf["y"].to_numpy(), one["growth"], one["cap"], floor, one["level"])
    return pd.DataFrame(
        {
            **{k: [one[k]] for k in SERIES},
            "gram": [(x.T @ x).ravel()],
            "moment": [x.T @ y],
            "square": [float(y @ y)],
            "n": [len(y)],
        }
    )


def ridge(gram: np.ndarray, moment: np.ndarray, square: float, n: int, prior: np.ndarray) -> tuple[np.ndarray, float]:
    """Coefficients under independent normal priors with the given stds, and the residual std."""
    def solve(noise: float) -> tuple[np.ndarray, float]:
        beta = np.linalg.solve(gram + np.diag(noise / prior**2), moment)
        return beta, _residual(gram, moment, square, n, beta)

    _, noise = solve(1e-4)
    beta, noise = solve(max(noise, 1e-8))
    return beta, float(np.sqrt(noise))


def _residual(gram: np.ndarray, moment: np.ndarray, square: float, n: int, beta: np.ndarray) -> float:
    return max(square - 2 * beta @ moment + beta @ gram @ beta, 1e-12) / max(n - 1, 1)


#: Rounds in which the noise and the coefficients are fitted in turn.
NOISE_ROUNDS = 4


def sparse_minimum(gram: np.ndarray, moment: np.ndarray, penalty: float) -> np.ndarray:
    """The d that minimises d'Gd/2 - m'd + penalty * sum|d|, by search over active sets and signs.

    G must be positive definite. One coordinate enters at a time, the one with the steepest descent; the quadratic with the
    signs held is then solved exactly, and where a sign would turn the best point on the way is taken instead. The
    value falls with every step, so no set of signs comes twice and the end is exact: coordinates are zero or optimal.
    """
    d, sign = np.zeros(len(moment)), np.zeros(len(moment))

    def value(x: np.ndarray) -> float:
        return float(x @ gram @ x / 2 - moment @ x + penalty * np.abs(x).sum())

    for _ in range(50 * len(moment)):
        slope = gram @ d - moment
        idle = np.where(d == 0, np.abs(slope), 0.0)
        enters = int(np.argmax(idle))
        if idle[enters] <= penalty * (1 + 1e-9) + 1e-12:
            break
        sign[enters] = -np.sign(slope[enters])
        while sign.any():
            on = np.flatnonzero(sign)
            goal = np.zeros_like(d)
            goal[on] = np.linalg.solve(gram[np.ix_(on, on)], moment[on] - penalty * sign[on])
            if (np.sign(goal[on]) == sign[on]).all():
                d = goal
                break
            turns = [j for j in on if d[j] != 0 and np.sign(goal[j]) != np.sign(d[j])]
            points = [goal]
            for j in turns:
                point = d + d[j] / (d[j] - goal[j]) * (goal - d)
                point[j] = 0.0
                points.append(point)
            best = min(points, key=value)
            if value(best) >= value(d):  # nothing left to gain in this arithmetic
                return d
            d, sign = best, np.sign(best)
    return d


def posterior_mode(
    gram: np.ndarray, moment: np.ndarray, square: float, n: int, prior: np.ndarray, sparse: np.ndarray
) -> tuple[np.ndarray, float]:
    """The likeliest coefficients and the residual std from the summed normal equations.

    ``prior`` holds the scale of each coefficient's prior: Laplace where ``sparse`` is set, normal elsewhere. The normal
    ones are eliminated (they are linear in the rest), which leaves a small sparse problem. Noise and coefficients are
    fitted in turn for a fixed number of rounds, the first time with all priors normal.
    """
    free = ~sparse

    beta, sigma = ridge(gram, moment, square, n, prior)
    noise = sigma**2
    for _ in range(NOISE_ROUNDS):
        noise = max(noise, 1e-8)
        inner = gram[np.ix_(free, free)] + np.diag(noise / prior[free] ** 2)
        cross = gram[np.ix_(free, sparse)]
        both = np.linalg.solve(inner, np.column_stack((cross, moment[free])))
        rest = gram[np.ix_(sparse, sparse)] - cross.T @ both[:, :-1]
        # Slope changes no row tells apart would leave the choice open: a trace of a square penalty settles it.
        rest += np.eye(len(rest)) * max(1e-9 * np.trace(rest) / len(rest), 1e-12)
        weight = noise / prior[sparse]
        # Scaled so that all have one penalty.
        d = sparse_minimum(rest / np.outer(weight, weight), (moment[sparse] - cross.T @ both[:, -1]) / weight, 1.0) / weight
        beta[sparse], beta[free] = d, both[:, -1] - both[:, :-1] @ d
        noise = _residual(gram, moment, square, n, beta)
    return beta, float(np.sqrt(noise))


def _solve(pdf: pd.DataFrame) -> pd.DataFrame:
    """Add a series' chunk sums and solve."""
    one = pdf.iloc[0]
    gram = np.sum([np.asarray(g) for g in pdf["gram"]], axis=0).reshape(WIDTH, WIDTH)
    moment = np.sum([np.asarray(m) for m in pdf["moment"]], axis=0)
    prior = np.concatenate(
        [
            [5.0, 5.0],
            np.full(CHANGEPOINTS, one["changepoint_scale"]),
            np.full(WIDTH - 2 - CHANGEPOINTS, one["seasonality_scale"]),
        ]
    )
    n = int(pdf["n"].sum())
    sparse = np.zeros(WIDTH, bool)
    sparse[2 : 2 + CHANGEPOINTS] = True
    beta, sigma = posterior_mode(gram, moment, float(pdf["square"].sum()), n, prior, sparse)
    keep = ["first_clock", "last_clock", "level", "growth", "cap", "floor", "business_hours", "interval_width", "data_type"]
    return pd.DataFrame(
        {**{k: [one[k]] for k in SERIES}, "beta": [beta], "sigma": [sigma], **{k: [one[k]] for k in keep}, "rows": [n]}
    )


def fit(frame: DataFrame, profiles: DataFrame, minimum: int = 20, by: Sequence[str] = SERIES) -> DataFrame:
    """Coefficients per series from rows (keys, ds, y); series with fewer than ``minimum`` rows are absent."""
    keys = list(by)
    span = frame.groupBy(*keys).agg(
        F.min("ds").alias("first_clock"),
        F.max("ds").alias("last_clock"),
        F.greatest(F.max(F.abs("y")), F.lit(1e-8)).alias("level"),
        F.count("*").alias("_rows"),
    ).where(F.col("_rows") >= minimum)
    config = profiles.select(
        *keys, "growth", "cap", "floor", "business_hours", "interval_width", "data_type",
        "changepoint_scale", "seasonality_scale",
    )
    setup = span.join(config, keys)
    rows = frame.select(*keys, "ds", "y").join(
        setup.drop("changepoint_scale", "seasonality_scale", "interval_width", "data_type"), keys
    )
    # Sums may be taken over any parts of a series; only one of very many rows is cut at all.
    block = F.pmod(F.xxhash64("ds"), F.ceil(F.col("_rows") / BLOCK_ROWS)).alias("_block")
    key_types = ", ".join(f"{k} string" for k in keys)
    sums = (
        spread(rows.withColumn("_block", block).drop("_rows"), *keys, "_block")
        .groupBy(*keys, "_block")
        .applyInPandas(_chunk_sums, f"{key_types}, gram array<double>, moment array<double>, square double, n bigint")
    )
    return spread(sums.join(setup.drop("_rows"), keys), *keys).groupBy(*keys).applyInPandas(_solve, f"{key_types}, {MODEL_COLUMNS}")


#: Simulated futures per series, and steps that are simulated at a time.
PATHS, STEPS = 1_000, 512


def simulated_band(t: np.ndarray, changes: np.ndarray, sigma: float, width: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper quantile of what may be added to the trend at the scaled times ``t`` (ascending, past 1).

    The slope goes on changing as often as it could in the past (``CHANGEPOINTS`` over the range they cover) and by
    Laplace steps as large as the fitted ones on average; each value has its own noise.
    The same seed gives the same band.
    """
    rng = np.random.default_rng(seed)
    size = float(np.abs(changes).mean()) + 1e-8
    reach = max(float(t[-1]) - 1.0, 0.0)
    counts = rng.poisson(len(changes) * reach, PATHS)
    path = np.repeat(np.arange(PATHS), counts)
    when = 1.0 + reach * rng.random(len(path))
    step = rng.laplace(0.0, size, len(path))
    at = np.searchsorted(t, when)  # the first time that the change acts on
    slope, offset = np.zeros(PATHS), np.zeros(PATHS)
    low, high = np.empty(len(t)), np.empty(len(t))
    for a in range(0, len(t), STEPS):
        block = t[a : a + STEPS]
        here = (at >= a) & (at < a + len(block))
        slopes, offsets = np.zeros((PATHS, len(block))), np.zeros((PATHS, len(block)))
        np.add.at(slopes, (path[here], at[here] - a), step[here])
        np.add.at(offsets, (path[here], at[here] - a), step[here] * when[here])
        slopes, offsets = slope[:, None] + slopes.cumsum(1), offset[:, None] + offsets.cumsum(1)
        slope, offset = slopes[:, -1], offsets[:, -1]
        futures = slopes * block - offsets + rng.normal(0.0, sigma, slopes.shape)
        low[a : a + len(block)], high[a : a + len(block)] = np.quantile(futures, [0.5 - width / 2, 0.5 + width / 2], axis=0)
    return np.minimum(low, 0.0), np.maximum(high, 0.0)


def _forecast_rows(model: pd.Series, steps: np.ndarray) -> pd.DataFrame:
    clock = model["last_clock"] + steps * 3600
    floor = 0.0 if pd.isna(model["floor"]) else model["floor"]
    x = design(clock, model["first_clock"], model["last_clock"], _business(clock, model["business_hours"]))
    beta = np.asarray(model["beta"])
    mid = x @ beta
    seed = zlib.crc32("\x1f".join(str(model[k]) for k in SERIES).encode("utf-8", "surrogatepass"))
    below, above = simulated_band(x[:, 1], beta[2 : 2 + CHANGEPOINTS], model["sigma"], model["interval_width"], seed)
    scale = (model["growth"], model["cap"], floor, model["level"])
    out = {name: _from_scale(v, *scale) for name, v in (("yhat", mid), ("yhat_lower", mid + below), ("yhat_upper", mid + above))}
    if model["data_type"] == "percentage":
        out = {name: np.clip(v, 0.0, 100.0) for name, v in out.items()}
    return pd.DataFrame({**{k: model[k] for k in SERIES}, "step": steps, "ds": clock, **out})


def forecast(models: DataFrame, periods: int | str = 24, by: Sequence[str] = SERIES) -> DataFrame:
    """Hourly forecast after each series' last sample: step, ds, yhat, yhat_lower, yhat_upper.

    The interval widens with the horizon as far as the fitted slope changes make the trend uncertain.

    ``periods`` is a number of hours, or the column that holds each series' own.
    """
    models = models.withColumn("_periods", F.col(periods) if isinstance(periods, str) else F.lit(periods))

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, model in batch.iterrows():
                yield _forecast_rows(model, np.arange(1, int(model["_periods"]) + 1, dtype="int64"))

    key_types = ", ".join(f"{k} string" for k in by)
    return models.mapInPandas(
        rows, f"{key_types}, step bigint, ds bigint, yhat double, yhat_lower double, yhat_upper double"
    )
