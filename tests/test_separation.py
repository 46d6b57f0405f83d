"""The separation score equals that of all pairs."""

import numpy as np
import pandas as pd
import pytest

from hostpulse.operators import separation


def _plain(x, label):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    out = []
    for i, own in enumerate(label):
        same = label == own
        if same.sum() == 1:
            out.append(0.0)
            continue
        a, b = d[i][same].sum() / (same.sum() - 1), d[i][~same].mean()
        out.append((b - a) / max(a, b) if max(a, b) > 0 else 0.0)
    return float(np.mean(out))


@pytest.mark.parametrize("block", [4096, 37])
def test_score_is_that_of_all_pairs(spark, block):
    rng = np.random.default_rng(3)
    frames, want = [], {}
    for host, n, share in (("a", 300, 0.2), ("b", 60, 0.5), ("one", 40, 0.0), ("few", 8, 0.5), ("lone", 30, 0.0)):
        x = np.round(rng.normal(0, 1, (n, 3)), 1)
        label = (rng.random(n) < share).astype(int)
        x[label == 1] += 3
        if host == "a":
            x[50:120], label[50:120] = x[50], label[50]  # copies
        if host == "lone":
            label[7] = 1
        frames.append(pd.DataFrame(x, columns=list("xyz")).assign(host=host, is_anomaly=label))
        want[host] = (n, None if host in ("one", "few") else _plain(x, label))
    got = {r.host: (r.rows, r.silhouette_score) for r in separation.silhouette(spark.createDataFrame(pd.concat(frames)), list("xyz"), block_rows=block).collect()}
    assert got.keys() == want.keys()
    for host, (n, score) in want.items():
        assert got[host][0] == n
        assert got[host][1] == (None if score is None else pytest.approx(score, abs=1e-9)), host


def test_nulls_and_no_rows(spark):
    rows = [("h", float(i), None, i % 2) for i in range(20)] + [("h", 1.0, 1.0, None)] + [("same", 1.0, 1.0, i % 2) for i in range(12)]
    df = spark.createDataFrame(rows, "host string, x double, y double, is_anomaly int")
    got = {r.host: (r.rows, r.silhouette_score) for r in separation.silhouette(df, ["x", "y"]).collect()}
    x = np.array([[float(i), 0.0] for i in range(20)])
    assert got == {"h": (20, pytest.approx(_plain(x, np.arange(20) % 2))), "same": (12, 0.0)}
    assert separation.silhouette(df.limit(0), ["x", "y"]).count() == 0
