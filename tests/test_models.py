"""Properties of the models whose numbers no SQL can give."""

import numpy as np
import pandas as pd
import pytest

from hostpulse.operators import additive, arima, ensemble, failures, isolation, neighbours, profiles

FEATURES = ["x", "y"]


@pytest.fixture(scope="module")
def cloud():
    rng = np.random.default_rng(1)
    points = rng.normal(0, 1, (500, 2)).round(3)
    points[:10] = rng.normal(0, 1, (10, 2)) * 0.3 + np.array([9.0, -9.0])
    points[100:160] = points[100]  # copies
    return pd.DataFrame({"host": "h", "clock": np.arange(500), "x": points[:, 0], "y": points[:, 1]})


def _brute(points, k):
    d = np.sqrt(((points[:, None] - points[None]) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    return np.sort(d, axis=1)[:, :k]


@pytest.mark.parametrize("block", [4096, 40])
def test_neighbours_equal_brute_force(spark, cloud, monkeypatch, block):
    """Also with many cells and blocks, where hot cells are split."""
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", block)
    got = neighbours.k_nearest(spark.createDataFrame(cloud), FEATURES, 5).toPandas().sort_values(["clock", "rank"])
    expected = _brute(cloud[FEATURES].to_numpy(), 5)
    np.testing.assert_allclose(got["distance"].to_numpy().reshape(500, 5), expected, atol=1e-9)


def test_outlier_factor_equals_brute_force(spark, cloud, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 100)
    unique = cloud.drop_duplicates(FEATURES).reset_index(drop=True)
    x, k = unique[FEATURES].to_numpy(), 20
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, axis=1)[:, :k]
    reach = np.maximum(np.sort(d, axis=1)[:, k - 1][near], np.take_along_axis(d, near, 1))
    density = 1 / (reach.mean(axis=1) + 1e-10)
    expected = density[near].mean(axis=1) / density
    df = spark.createDataFrame(unique)
    model = neighbours.fit_lof(df, FEATURES, k)
    got = neighbours.as_points(df, FEATURES).join(model, ["host", "point"]).toPandas().sort_values("clock")
    np.testing.assert_allclose(got["lof"], expected, rtol=1e-6)
    far = spark.createDataFrame([("h", 1, 30.0, 30.0), ("h", 2, 0.0, 0.0)], "host string, clock bigint, x double, y double")
    scores = {r["clock"]: r["lof_score"] for r in neighbours.lof_scores(far, model, FEATURES, k).collect()}
    assert scores[1] < scores[2] < 0


def test_forest_finds_planted_points(spark, cloud):
    df = spark.createDataFrame(cloud)
    forest = isolation.fit_forest(df, FEATURES)
    assert forest.count() == 100
    scored = isolation.forest_scores(df, forest, FEATURES)
    out = scored.toPandas().sort_values("if_score")
    assert out["if_score"].between(-1, 0).all()
    assert set(out["clock"].head(10)) == set(range(10))
    flags = isolation.flagged(scored, isolation.score_offsets(scored, "if_score", 0.1), "if_score", "flag").toPandas()
    assert abs(flags["flag"].mean() - 0.1) < 0.03


def test_same_forest_every_time(spark, cloud):
    df = spark.createDataFrame(cloud)
    a, b = (isolation.forest_scores(df, isolation.fit_forest(df, FEATURES), FEATURES).toPandas() for _ in range(2))
    pd.testing.assert_frame_equal(
        a.sort_values("clock").reset_index(drop=True), b.sort_values("clock").reset_index(drop=True)
    )


def test_imputation_equals_brute_force(spark, cloud, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 60)
    rng = np.random.default_rng(5)
    data = cloud.assign(z=cloud["x"] * 2 + rng.normal(0, 0.01, 500), w=rng.normal(0, 1, 500))
    gaps = data.copy()
    gaps.loc[rng.choice(500, 80, replace=False), "z"] = np.nan
    columns = ["x", "y", "z", "w"]
    rows = [tuple(None if isinstance(v, float) and np.isnan(v) else v for v in r) for r in gaps.itertuples(index=False)]
    df = spark.createDataFrame(rows, "host string, clock bigint, x double, y double, z double, w double")
    got = neighbours.knn_imputed(df, columns).toPandas().sort_values("clock")
    x = gaps[columns].to_numpy()
    known = np.flatnonzero(~np.isnan(x[:, 2]))
    for i in np.flatnonzero(np.isnan(x[:, 2])):
        shared = [0, 1, 3]
        d = ((x[known][:, shared] - x[i, shared]) ** 2).sum(axis=1)
        assert got["z"].iloc[i] == pytest.approx(x[known[np.argsort(d, kind="stable")[:5]], 2].mean())


def test_oversampling_balances(spark, cloud):
    data = cloud.assign(label=[1] * 40 + [0] * 460)
    out = neighbours.oversampled(spark.createDataFrame(data), FEATURES, "label").toPandas()
    assert out["label"].value_counts().to_dict() == {0: 460, 1: 460}
    made = out[out["clock"].isna()]
    few = data[data.label == 1]
    assert len(made) == 420 and made["x"].between(few["x"].min(), few["x"].max()).all()


def test_ridge_equals_least_squares():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 5))
    y = x @ np.arange(1.0, 6.0) + rng.normal(0, 0.1, 300)
    beta, sigma = additive.ridge(x.T @ x, x.T @ y, float(y @ y), 300, np.full(5, 1e6))
    np.testing.assert_allclose(beta, np.linalg.lstsq(x, y, rcond=None)[0], rtol=1e-6)
    assert sigma == pytest.approx(0.1, rel=0.2)


def _trend_problem(seed, turns=()):
    """Normal equations of a noisy trend with the given (changepoint, slope change) pairs."""
    rng = np.random.default_rng(seed)
    clock = 1704067200 + np.arange(24 * 40) * 3600
    x = additive.design(clock, clock[0], clock[-1], np.zeros(len(clock)))
    beta = np.zeros(additive.WIDTH)
    beta[:2] = 0.5, 0.2
    beta[2 + additive.CHANGEPOINTS] = 0.1
    for k, change in turns:
        beta[2 + k] = change
    y = x @ beta + rng.normal(0, 0.02, len(clock))
    prior = np.concatenate([[5.0, 5.0], np.full(additive.CHANGEPOINTS, 0.05), np.full(additive.WIDTH - 2 - additive.CHANGEPOINTS, 10.0)])
    sparse = np.zeros(additive.WIDTH, bool)
    sparse[2 : 2 + additive.CHANGEPOINTS] = True
    return x, y, prior, sparse


@pytest.mark.parametrize("turns", [(), ((9, 1.5),), ((3, -0.8), (17, 1.1))])
def test_slope_changes_are_optimal_under_laplace_priors(turns):
    x, y, prior, sparse = _trend_problem(5, turns)
    beta, sigma = additive.posterior_mode(x.T @ x, x.T @ y, float(y @ y), len(y), prior, sparse)
    noise = sigma**2
    slope = x.T @ (y - x @ beta)
    d, pull = beta[sparse], slope[sparse] * prior[sparse] / noise
    assert (np.abs(pull) <= 1.01).all()  # nothing that is zero would leave it
    assert np.abs(pull[d != 0] - np.sign(d[d != 0])).max(initial=0) < 0.01  # the rest is where both slopes meet
    np.testing.assert_allclose(slope[~sparse] / noise, (beta / prior**2)[~sparse], rtol=0.01, atol=0.5)
    assert sigma == pytest.approx(0.02, rel=0.1)
    if not turns:
        assert (d == 0).sum() >= 20 and np.abs(d).sum() < 0.05  # noise alone moves few, and hardly
    for k, change in turns:
        assert d[max(k - 1, 0) : k + 2].sum() == pytest.approx(change, rel=0.25)
    assert (d == 0).sum() >= 12


def test_sparse_minimum_equals_a_search_over_all_signs():
    from itertools import product

    rng = np.random.default_rng(3)
    for _ in range(20):
        root, m = rng.normal(size=(6, 4)), rng.normal(size=4) * 2
        g = root.T @ root

        def value(d):
            return d @ g @ d / 2 - m @ d + 0.7 * np.abs(d).sum()

        best = 0.0
        for signs in product((-1, 0, 1), repeat=4):
            sign, on = np.array(signs, float), np.flatnonzero(signs)
            d = np.zeros(4)
            if len(on):
                d[on] = np.linalg.solve(g[np.ix_(on, on)], m[on] - 0.7 * sign[on])
            best = min(best, value(d))
        assert value(additive.sparse_minimum(g, m, 0.7)) == pytest.approx(best, abs=1e-9)


def test_band_widens_by_what_the_trend_may_do():
    t = 1 + np.arange(1, 1201) / 960
    low, high = additive.simulated_band(t, np.array([0.0] * 23 + [0.8, -0.8]), 0.02, 0.8, 7)
    again = additive.simulated_band(t, np.array([0.0] * 23 + [0.8, -0.8]), 0.02, 0.8, 7)
    assert (low == again[0]).all() and (high == again[1]).all()
    width = high - low
    assert width[:24].mean() == pytest.approx(2 * 1.2816 * 0.02, rel=0.1)
    assert width[-24:].mean() > 3 * width[:24].mean() and width[600:624].mean() > 1.5 * width[:24].mean()
    # Changes come at a known rate with a known variance, so the spread of the trend is known: rate * 2 s^2 * h^3 / 3.
    reach = t[-1] - 1
    std = np.sqrt(25 * 2 * 0.064**2 * reach**3 / 3 + 0.02**2)
    assert width[-1] == pytest.approx(2 * 1.2816 * std, rel=0.15)
    still = additive.simulated_band(t, np.zeros(25), 0.02, 0.8, 7)
    assert (still[1] - still[0])[-24:].mean() == pytest.approx(2 * 1.2816 * 0.02, rel=0.1)


def test_held_out_values_fall_into_the_band_as_often_as_promised():
    inside = []
    for seed in range(30):
        x, y, prior, sparse = _trend_problem(100 + seed)
        beta, sigma = additive.posterior_mode(x.T @ x, x.T @ y, float(y @ y), len(y), prior, sparse)
        clock = 1704067200 + np.arange(24 * 40, 24 * 43) * 3600
        ahead = additive.design(clock, 1704067200, 1704067200 + (24 * 40 - 1) * 3600, np.zeros(len(clock)))
        truth = ahead[:, 0] * 0.5 + ahead[:, 1] * 0.2 + ahead[:, 2 + additive.CHANGEPOINTS] * 0.1
        truth = truth + np.random.default_rng(seed).normal(0, 0.02, len(clock))
        low, high = additive.simulated_band(ahead[:, 1], beta[sparse], sigma, 0.8, seed)
        inside.append(((truth >= ahead @ beta + low) & (truth <= ahead @ beta + high)).mean())
    assert np.mean(inside) == pytest.approx(0.8, abs=0.05)


@pytest.mark.parametrize("ranges", [4096, 3])
def test_each_class_gives_its_rounded_fifth(spark, monkeypatch, ranges):
    monkeypatch.setattr(failures, "HASH_RANGES", ranges)
    sizes = {0: 503, 1: 57, 2: 2, 3: 3, None: 13}
    rows = [(c, i // 2, f"h{i % 3}") for c, n in sizes.items() for i in range(n)] + [(4, 1, "copy")] * 200
    df = spark.createDataFrame(rows, "label int, x int, part string").repartition(5)
    got = failures.stratified_split(df.withColumnRenamed("part", "host"), "label", ["host", "x"]).toPandas()
    assert sorted(got.columns) == ["host", "label", "part", "x"] and len(got) == len(rows)
    test = got[got["part"] == "test"].groupby("label", dropna=False).size()
    for c, n in {**sizes, 4: 200}.items():
        want = (2 * n + 5) // 10
        have = test[test.index.isna()].sum() if c is None else test.get(c, 0)
        assert have == want
    assert failures.stratified_split(df.limit(0), "label", ["x"]).count() == 0


def _known_series(hours=24 * 14):
    t = np.arange(hours)
    rng = np.random.default_rng(2)
    value = 50 + 0.02 * t + 10 * np.sin(2 * np.pi * t / 24) + rng.normal(0, 0.3, hours)
    return pd.DataFrame({"host": "h", "measurement": "proc_num", "clock": 1704067200 + t * 3600, "value": value})


def test_additive_forecast_of_a_known_series(spark):
    df = spark.createDataFrame(_known_series())
    profile = profiles.metric_profiles(df)
    models = additive.fit(profiles.regression_frame(df, profile), profile)
    got = additive.forecast(models, 48).toPandas().sort_values("step")
    t = 24 * 14 + np.arange(48)
    truth = 50 + 0.02 * t + 10 * np.sin(2 * np.pi * t / 24)
    assert np.abs(got["yhat"] - truth).mean() < 1.0
    assert (got["yhat_lower"] < got["yhat"]).all() and (got["yhat"] < got["yhat_upper"]).all()
    assert list(got["ds"]) == list(1704067200 + t * 3600)


def test_percentages_stay_in_bounds(spark):
    data = _known_series().assign(measurement="system_cpu_util_user")
    data["value"] = np.clip(data["value"] + 45, 0, 100)
    df = spark.createDataFrame(data)
    profile = profiles.metric_profiles(df)
    got = additive.forecast(additive.fit(profiles.regression_frame(df, profile), profile)).toPandas()
    assert got[["yhat", "yhat_lower", "yhat_upper"]].stack().between(0, 100).all()


def test_arima_recovers_an_autoregression():
    rng = np.random.default_rng(4)
    y = np.zeros(600)
    for i in range(1, 600):
        y[i] = 2.0 + 0.8 * y[i - 1] + rng.normal()
    model = arima.estimate(y, (1, 0, 0))
    assert model["ar"][0] == pytest.approx(0.8, abs=0.06)
    mid, low, high = arima.predict(model, y, 200)
    assert mid[-1] == pytest.approx(10.0, abs=1.5)
    assert (np.diff(high - low) >= -1e-9).all()
    assert arima.best_model(np.cumsum(rng.normal(size=400)))["order"][1] == 1


def test_short_series_have_no_forecast(spark):
    df = spark.createDataFrame(_known_series(15)).selectExpr("*", "'generic' AS data_type")
    assert arima.forecast(df).count() == 0
    profile = profiles.metric_profiles(df)
    assert additive.fit(profiles.regression_frame(df, profile), profile).count() == 0


def test_classifier_beats_the_base_rate(spark, cloud):
    data = cloud.assign(failure=(cloud["x"] + cloud["y"] > 1).astype("int32"))
    df = failures.stratified_split(spark.createDataFrame(data), "failure", ["clock"])
    weighted = failures.class_weights(df, "failure")
    model = failures.fit_classifier(weighted.where("part = 'train'"), FEATURES, "failure", "class_weight", trees=20)
    judged = failures.failure_scores(model, weighted.where("part = 'test'"))
    quality = ensemble.supervised_metrics(judged, "failure", "failure_prediction", ["host"]).first()
    assert quality["accuracy"] > 0.9 and quality["recall"] > 0.7
    assert judged.where("time_to_failure_hours < 1 OR time_to_failure_hours > 72").count() == 0
