"""Chunked series operators equal pandas on series cut into many small chunks."""

import numpy as np
import pandas as pd
import pytest

from hostpulse.operators import chunks, cleaning, windows


@pytest.fixture
def small_chunks(monkeypatch):
    for fn in (chunks.halo, chunks.with_position, chunks.with_neighbours, chunks.chunk_of):
        defaults = tuple(600 if d == chunks.CHUNK_SECONDS else d for d in fn.__defaults__)
        monkeypatch.setattr(fn, "__defaults__", defaults)
    monkeypatch.setattr(chunks, "CHUNK_SECONDS", 600)


@pytest.fixture
def frame():
    rng = np.random.default_rng(7)
    parts = []
    for host, n in (("a", 400), ("b", 37), ("c", 1)):
        clock = np.sort(rng.choice(np.arange(1, 40000), n, replace=False))
        value = np.where(rng.random(n) < 0.3, np.nan, rng.normal(10, 3, n))
        parts.append(pd.DataFrame({"host": host, "clock": clock, "value": value}))
    return pd.concat(parts, ignore_index=True)


def _spark(spark, frame):
    rows = [(h, int(c), None if np.isnan(v) else float(v)) for h, c, v in frame.itertuples(index=False)]
    return spark.createDataFrame(rows, "host string, clock bigint, value double")


def _same(df, frame, column, expected):
    got = df.toPandas().sort_values(["host", "clock"])[column].to_numpy(dtype=float)
    np.testing.assert_allclose(got, np.asarray(expected, dtype=float), rtol=1e-9, atol=1e-9)


def test_lags_and_changes(spark, small_chunks, frame):
    known = frame.assign(value=frame["value"].fillna(0.5))
    by_host = known.groupby("host")["value"]
    got = windows.lagged(_spark(spark, known), by=("host",), periods=[1, 12])
    _same(got, known, "value_lag_1", by_host.shift(1))
    _same(got, known, "value_lag_12", by_host.shift(12))
    first = by_host.transform("first")
    filled = windows.lagged_filled(_spark(spark, known), by=("host",), periods=[3])
    _same(filled, known, "value_lag_3", by_host.shift(3).fillna(first))
    _same(windows.changed(_spark(spark, known), by=("host",)), known, "value_diff", by_host.diff())


def test_row_rolling(spark, small_chunks, frame):
    known = frame.assign(value=frame["value"].fillna(0.5))
    got = windows.rolling_by_rows(_spark(spark, known), by=("host",), rows=[10])
    by_host = known.groupby("host")["value"]
    _same(got, known, "value_rolling_mean_10", by_host.transform(lambda s: s.rolling(10, min_periods=1).mean()))
    _same(got, known, "value_rolling_std_10", by_host.transform(lambda s: s.rolling(10, min_periods=1).std().fillna(0)))


def test_time_rolling(spark, small_chunks, frame):
    known = frame.assign(value=frame["value"].fillna(0.5))
    got = windows.rolling_by_time(_spark(spark, known), by=("host",), minutes=[60])
    expected = []
    for _, part in known.groupby("host"):
        s = pd.Series(part["value"].to_numpy(), index=pd.to_datetime(part["clock"], unit="s"))
        expected += list(s.rolling("60min").max())
    _same(got, known, "value_rolling_max_60m", expected)


def test_smoothing(spark, small_chunks, frame):
    by_host = frame.groupby("host")["value"]
    expected = by_host.transform(lambda s: s.rolling(3, center=True, min_periods=1).median())
    _same(windows.smoothed(_spark(spark, frame), by=("host",)), frame, "value", expected)


def test_fill_and_interpolation(spark, small_chunks, frame):
    by_host = frame.groupby("host")["value"]
    filled = cleaning.filled(_spark(spark, frame), by=("host",))
    _same(filled, frame, "value", by_host.transform(lambda s: s.ffill().bfill().fillna(0)))
    expected = []
    for _, part in frame.groupby("host"):
        s = pd.Series(part["value"].to_numpy(), index=pd.to_datetime(part["clock"], unit="s"))
        expected += list(s.interpolate(method="time"))
    _same(cleaning.interpolated(_spark(spark, frame), by=("host",)), frame, "value", expected)


def test_positions_and_folds(spark, small_chunks, frame):
    got = chunks.with_position(_spark(spark, frame), ["host"], "clock")
    _same(got, frame, "position", frame.groupby("host").cumcount() + 1)
    folds = windows.fold_by_time(_spark(spark, frame)).toPandas().groupby("host")["fold"].value_counts()
    assert folds["a"].to_dict() == {0: 133, 1: 133, 2: 134}
    parts = windows.split_by_time(_spark(spark, frame), by=("host",)).toPandas()
    assert (parts[parts.host == "a"]["part"] == "train").sum() == 320
