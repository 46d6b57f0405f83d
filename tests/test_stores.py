"""A version of a model is there whole or not at all; older ones are kept by count."""

import pytest

from hostpulse.plans import stores
from hostpulse.plans.forecasting import Forecasters
from hostpulse.sources import commits


def model(spark, mark):
    frame = spark.createDataFrame([("h", "m", float(mark))], "host string, measurement string, x double")
    return Forecasters(frame, frame, frame, frame)


def mark(forecasters):
    return {getattr(forecasters, n).first().x for n in ("profiles", "models", "quality", "prepared")}


def test_the_latest_version_by_its_time_and_any_by_name(spark, tmp_path):
    root = str(tmp_path)
    for k, version in enumerate(["9.0_20240101_000000", "1.0_20240301_000000", "2.0_20240201_000000"]):
        stores.save_forecasters(spark, model(spark, k), root, version, 10 + k)
    assert mark(stores.load_forecasters(spark, root)) == {1.0}
    assert mark(stores.load_forecasters(spark, root, "9.0_20240101_000000")) == {0.0}
    rows = stores.catalogue(spark, root, ["forecasters"]).collect()
    assert sorted((r.version, r.training_samples) for r in rows) == [
        ("1.0_20240301_000000", 11), ("2.0_20240201_000000", 12), ("9.0_20240101_000000", 10)
    ]
    with pytest.raises(ValueError, match="no committed version"):
        stores.load_forecasters(spark, root, "3.0")


def test_a_save_that_was_cut_off_is_invisible_and_swept(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    stores.save_forecasters(spark, model(spark, 1), root, "1.0_20240101_000000", 5)
    with monkeypatch.context() as m:
        m.setattr(commits, "commit", lambda *a, **k: (_ for _ in ()).throw(KeyboardInterrupt()))
        with pytest.raises(KeyboardInterrupt):
            stores.save_forecasters(spark, model(spark, 2), root, "2.0_20240102_000000", 5)
    assert mark(stores.load_forecasters(spark, root)) == {1.0}
    assert len(list((tmp_path / "forecasters").iterdir())) == 2
    assert commits.sweep(spark, root, "forecasters") == 0  # may still be at work
    assert commits.sweep(spark, root, "forecasters", hours=0) == 1
    assert mark(stores.load_forecasters(spark, root)) == {1.0}
    stores.save_forecasters(spark, model(spark, 3), root, "2.0_20240102_000000", 5)
    assert mark(stores.load_forecasters(spark, root)) == {3.0}


def test_two_savers_of_one_version_give_one(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    root = str(tmp_path)

    def save(k):
        try:
            stores.save_forecasters(spark, model(spark, k), root, "1.0_20240101_000000", k)
            return k
        except commits.VersionExists:
            return None

    with ThreadPoolExecutor(4) as pool:
        won = [k for k in pool.map(save, range(4)) if k is not None]
    assert len(won) == 1
    assert mark(stores.load_forecasters(spark, root)) == {float(won[0])}
    assert stores.catalogue(spark, root, ["forecasters"]).count() == 1
    assert len(list((tmp_path / "forecasters").iterdir())) == 1


def test_five_backups_stay(spark, tmp_path):
    root = str(tmp_path)
    versions = [f"1.0_202401{day:02d}_000000" for day in range(1, 9)]
    for k, version in enumerate(versions):
        stores.save_forecasters(spark, model(spark, k), root, version, k)
    kept = {r.version for r in stores.catalogue(spark, root, ["forecasters"]).collect()}
    assert kept == set(versions[2:]) and len(list((tmp_path / "forecasters").iterdir())) == 6
    assert mark(stores.load_forecasters(spark, root, versions[2])) == {2.0}
