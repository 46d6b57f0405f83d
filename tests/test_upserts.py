"""The last write of a key wins, whatever the batches, and a day has few files."""

import random
from concurrent.futures import ThreadPoolExecutor

import pytest

from hostpulse.sources import commits, upserts

SCHEMA = "host string, measurement string, clock long, value double, sent long"
DAY = 86_400


def points(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).coalesce(1)


def held(spark, path, **days):
    return {(r.host, r.measurement, r.clock): r.value for r in upserts.read(spark, path, **days).collect()}


def test_replays_with_other_values_keep_the_last_and_days_stay_small(spark, tmp_path):
    path, rng, want = str(tmp_path / "store"), random.Random(1), {}
    for batch in range(7):
        rows = [(f"h{rng.randrange(3)}", "m", rng.randrange(40) * DAY // 16, rng.random(), k) for k in range(60)]
        rows.append(("h0", "m", None, float(batch), 1))
        rows.append(("h1", "m", 5, -1.0, None))
        assert upserts.upsert(points(spark, rows), path, "sent", batch=batch, changes=3)
        for h, m, c, v, _ in sorted(rows, key=lambda r: (r[4] is not None, r[4] or 0)):
            want[h, m, c] = v
        # The same batch again, with values that must not come in.
        assert not upserts.upsert(points(spark, [(h, m, c, 99.0, k) for h, m, c, _, k in rows]), path, "sent", batch=batch)
        assert held(spark, path) == want
        state = upserts._state(spark, path)
        per_day = [sum(f[0] == d for f in state["folders"]) for d in {f[0] for f in state["folders"]}]
        assert max(per_day) <= 3
    assert held(spark, path, first="1970-01-02", last="1970-01-02") == {
        k: v for k, v in want.items() if k[2] is not None and DAY <= k[2] < 2 * DAY
    }
    assert upserts.vacuum(spark, path, keep=1) > 0
    assert held(spark, path) == want


def test_a_write_cut_off_before_its_commit_is_invisible(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "store")
    with pytest.raises(ValueError, match="no committed write"):
        upserts.read(spark, path)
    assert upserts.upsert(points(spark, [("h", "m", 1, 1.0, 1)]), path, "sent", batch=0)
    with monkeypatch.context() as m:
        m.setattr(commits, "put_once", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()))
        with pytest.raises(KeyboardInterrupt):
            upserts.upsert(points(spark, [("h", "m", 1, 2.0, 1)]), path, "sent", batch=1)
    assert held(spark, path) == {("h", "m", 1): 1.0}
    assert upserts.upsert(points(spark, [("h", "m", 1, 3.0, 1)]), path, "sent", batch=1)
    assert held(spark, path) == {("h", "m", 1): 3.0}
    assert upserts.upsert(points(spark, []), path, "sent", batch=2)
    assert held(spark, path) == {("h", "m", 1): 3.0}


def test_writers_at_the_same_time_lose_nothing(spark, tmp_path):
    path = str(tmp_path / "store")

    def write(k):
        return upserts.upsert(points(spark, [(f"h{k}", "m", 1, float(k), 1)]), path, "sent", writer=f"w{k}", batch=0, changes=2)

    with ThreadPoolExecutor(4) as pool:
        assert all(pool.map(write, range(4)))
    assert held(spark, path) == {(f"h{k}", "m", 1): float(k) for k in range(4)}
