"""Windows in time equal sums over each window's own rows, however the rows are cut into chunks and batches."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from hostpulse.operators import features, windows

BIG = 2**62


def _expected(rows, seconds):
    """(mean, std, max, min) of the values of (t - seconds, t]; nan counts as the largest value."""
    out = {}
    for host, clock, value, _ in rows:
        own = [v for h, c, v, _ in rows if h == host and clock - seconds < c <= clock and v is not None]
        if not own:
            out[host, clock] = (None,) * 4
            continue
        real = [v for v in own if not math.isnan(v)]
        low, high = min(real) if real else math.nan, math.nan if len(real) < len(own) else max(own)
        mean = math.fsum(own) / len(own) if all(map(math.isfinite, own)) else float(np.sum(own))
        std = None
        if len(own) > 1:
            same = low == high or (math.isnan(low) and math.isnan(high))
            std = 0.0 if same else float(np.std(own, ddof=1)) if all(map(math.isfinite, own)) else math.nan
        out[host, clock] = (mean, std, high, low)
    return out


@pytest.fixture
def rows():
    rng = np.random.default_rng(3)
    made = []
    for host, n in (("a", 500), (None, 60), ("c", 1)):
        for clock in rng.integers(-9000, 20000, n):  # some times twice
            drawn = rng.random()
            value = None if drawn < 0.1 else math.nan if drawn < 0.12 else math.inf if drawn < 0.13 else 1e12 if drawn < 0.15 else rng.normal(5, 1)
            made.append((host, int(clock), value, BIG + int(rng.integers(9))))
    return made


@pytest.mark.parametrize("batch", [7, 10_000])
def test_windows_of_odd_values(spark, rows, monkeypatch, batch):
    monkeypatch.setattr(windows, "ROLLING_CHUNK_SECONDS", 600)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        df = spark.createDataFrame(rows, "host string, clock bigint, value double, n bigint")
        found = windows.rolling_by_time(df, ("value", "n"), [5, 60], by=("host",))
        assert dict(found.dtypes)["n_rolling_max_5m"] == "bigint"
        got = found.collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert len(got) == len(rows)
    for m in (5, 60):
        want = _expected(rows, m * 60)
        for r in got:
            for kind, w in zip(("mean", "std", "max", "min"), want[r.host, r.clock]):
                g = r[f"value_rolling_{kind}_{m}m"]
                assert g is None if w is None else g == pytest.approx(w, rel=1e-9, nan_ok=True), (m, kind, r.host, r.clock)
            own = [n for h, c, _, n in rows if h == r.host and r.clock - m * 60 < c <= r.clock]
            assert (r[f"n_rolling_max_{m}m"], r[f"n_rolling_min_{m}m"]) == (max(own), min(own))


def test_no_window_is_added_up_anew(spark):
    """A range frame of the engine costs every row all rows of its window."""
    df = spark.range(100).select(F.lit("a").alias("host"), F.col("id").alias("clock"), F.col("id").cast("double").alias("value"))
    for made in (windows.rolling_by_time(df, by=("host",)), features.rolling_lag_set(df, ["value"])):
        assert "RangeFrame" not in made._jdf.queryExecution().executedPlan().toString()
