"""The stateful rule equals the batch rule, over batches, restarts, late and silent keys."""

import random
import time

import pytest

from hostpulse.operators import indicators
from hostpulse.streaming import alerts, pipelines

ROWS = "host string, clock bigint, value double"


@pytest.fixture()
def store(spark):
    with alerts.state_store(spark):
        yield


def _written(spark, path, batches):
    for rows in batches:
        spark.createDataFrame(rows, ROWS).coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)  # file order follows modification time


def _run(spark, tmp_path, **kw):
    stream = spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    pipelines.finished(pipelines.write_files(alerts.held_rule(stream, **kw), out, str(tmp_path / "ck")))
    return [tuple(r) for r in spark.read.parquet(out).select("host", "clock", "value", "state").collect()]


@pytest.mark.parametrize("seed", range(100))
def test_batches_do_not_matter(seed):
    rng = random.Random(seed)
    rows = [(i * 60, rng.choice([None, 1.0, 9.0, 9.0, 9.0])) for i in range(50)]
    whole, _, _ = alerts.judged([c for c, _ in rows], [v for _, v in rows], None, None, 5, 180)
    got, since, last, a = [], None, None, 0
    while a < len(rows):
        b = a + rng.randint(1, 12)
        part = rng.sample(rows[a:b], len(rows[a:b]))
        out, since, last = alerts.judged([c for c, _ in part], [v for _, v in part], since, last, 5, 180)
        got += out
        a = b
    assert got == whole


def test_equals_the_batch_rule_after_a_restart(spark, tmp_path, store):
    rng = random.Random(1)
    rows = [(h, 1000 + i * 100, float(rng.choice([1, 9, 9, 9]))) for h in ("g", "h", "k") for i in range(24)]
    batches = [[r for r in rows if lo <= r[1] < lo + 600] for lo in range(1000, 3400, 600)]
    _written(spark, str(tmp_path / "in"), batches[:2])
    _run(spark, tmp_path, limit=5, hold=300)
    _written(spark, str(tmp_path / "in"), batches[2:])
    got = _run(spark, tmp_path, limit=5, hold=300)  # goes on from the checkpoint
    whole = indicators.alert_state(spark.createDataFrame(rows, ROWS), 5, 300).select("host", "clock", "value", "state")
    assert sorted(got) == sorted(tuple(r) for r in whole.collect())
    assert {s for *_, s in got} == {"ok", "pending", "firing"}


def test_late_and_silent_keys(spark, tmp_path, store):
    batches = [
        [("a", 1000, 9.0), ("b", 1000, 9.0)],
        [("a", 1300, 9.0), ("a", 900, 1.0)],  # the second is older than what was judged: no state, and the run goes on
        [("a", 9000, 9.0)],  # now b has been silent for long
        [("a", 9100, None)],
        [("b", 9200, 9.0)],  # begins anew
    ]
    _written(spark, str(tmp_path / "in"), batches)
    got = sorted(_run(spark, tmp_path, limit=5, hold=300, idle=3600), key=str)
    assert got == sorted([
        ("a", 1000, 9.0, "pending"), ("b", 1000, 9.0, "pending"), ("a", 1300, 9.0, "firing"), ("a", 9000, 9.0, "firing"),
        ("a", 9100, None, "ok"), ("b", 4600, None, "silent"), ("b", 9200, 9.0, "pending"),
    ], key=str)
