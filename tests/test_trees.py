"""The tree search equals a search over all pairs and looks at few of them."""

import numpy as np
import pandas as pd
import pytest

from hostpulse.operators import neighbours, trees


def _frame(spark, x, host="h", first=0):
    rows = [(host, "", p, p, 1) for p in x.tolist()]
    return spark.createDataFrame(rows, "host string, _known string, point array<double>, order array<double>, weight bigint")


def _brute(q, x, k):
    d = np.zeros((len(q), len(x)))
    for j in range(q.shape[1]):
        d += (q[:, j, None] - x[None, :, j]) ** 2
    d = np.sqrt(d)
    by_point = np.lexsort(x.T[::-1])
    near = np.argsort(d[:, by_point], axis=1, kind="stable")[:, :k]
    return [[(d[i, by_point[j]], *x[by_point[j]]) for j in row] for i, row in enumerate(near)]


@pytest.mark.parametrize("fan", ["one level", "three levels"])
def test_search_equals_all_pairs(spark, monkeypatch, fan):
    if fan == "three levels":
        monkeypatch.setattr(trees, "DEPTH", 2)
        monkeypatch.setattr(trees, "SAMPLE", 64)
    rng = np.random.default_rng(2)
    x = np.unique(np.round(np.concatenate([rng.normal(0, 1, (500, 3)), rng.normal(5, 0.1, (200, 3)), [[50, 50, 50]]]), 1), axis=0)  # many ties
    q = np.unique(np.round(rng.normal(1, 3, (150, 3)), 1), axis=0)
    other = np.unique(rng.integers(0, 3, (20, 3)).astype(float), axis=0)
    refs = _frame(spark, x).unionByName(_frame(spark, other, "g"))
    asked = _frame(spark, q).unionByName(_frame(spark, q[:30], "g")).unionByName(_frame(spark, q[:2], "nobody")).drop("weight")
    found, pairs = trees.nearest(asked, refs, ["host"], 3, 4, 40)
    got = {(r.host, *r.point): [(n.distance, *n.point) for n in r.found] for r in found.collect()}
    want = {("h", *p): n for p, n in zip(q.tolist(), _brute(q, x, 4))} | {("g", *p): n for p, n in zip(q[:30].tolist(), _brute(q[:30], other, 4))}
    assert got == want
    leaves = pairs.where("host = 'h'").select("_r_leaf").distinct().count()
    assert 10 < leaves


def test_few_references_and_no_references(spark):
    x = np.array([[1.0, 2.0], [3.0, 4.0]])
    found, _ = trees.nearest(_frame(spark, x), None, ["host"], 2, 5, 100)
    assert {tuple(r.point): len(r.found) for r in found.collect()} == {(1.0, 2.0): 2, (3.0, 4.0): 2}
    empty = _frame(spark, x).limit(0)
    assert trees.nearest(empty, None, ["host"], 2, 5, 100)[0].count() == 0
    assert trees.nearest(_frame(spark, x).drop("weight"), empty, ["host"], 2, 5, 100)[0].count() == 0


def test_blocks_meet_few_leaves_however_many_there_are(spark):
    per_block = []
    for n in (2_000, 16_000):
        x = np.random.default_rng(n).normal(0, 1, (n, 2))
        _, pairs = trees.nearest(_frame(spark, x), None, ["host"], 2, 5, 200)
        leaves = pairs.select("_r_leaf").distinct().count()
        assert leaves > n / 200
        per_block.append(pairs.count() / pairs.select(*trees.BLOCK).distinct().count())
    assert per_block[1] < 1.5 * per_block[0] and per_block[1] < 10


def test_equal_points_are_dealt_out(spark):
    """Copies cannot be cut; they are asked for in several blocks."""
    data = pd.DataFrame({"host": "h", "clock": range(400), "x": 1.0, "y": [None if i % 2 else float(i) for i in range(400)]})
    gaps = spark.createDataFrame(data.astype({"y": "float64"}).replace({np.nan: None}), "host string, clock bigint, x double, y double")
    neighbours_rows, old = 50, neighbours.BLOCK_ROWS
    try:
        neighbours.BLOCK_ROWS = neighbours_rows
        got = neighbours.knn_imputed(gaps, ["x", "y"], 5).toPandas().sort_values("clock")
    finally:
        neighbours.BLOCK_ROWS = old
    assert (got["y"][got["clock"] % 2 == 1] == 4.0).all()  # the five earliest: 0, 2, 4, 6, 8


@pytest.mark.parametrize("rows", [20, 4096])
def test_imputation_with_many_patterns(spark, monkeypatch, rows):
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", rows)
    rng = np.random.default_rng(rows)
    n, names = 250, ["a", "b", "c", "d"]
    x = np.round(rng.normal(0, 1, (n, 4)), 1)
    x[rng.random((n, 4)) < 0.3] = np.nan
    x[7] = np.nan
    df = pd.DataFrame(x, columns=names).assign(host="h", clock=np.arange(n))
    got = neighbours.knn_imputed(
        spark.createDataFrame(df.replace({np.nan: None}).astype(object).where(df.notna(), None).values.tolist(), "a double, b double, c double, d double, host string, clock bigint"),
        names, 3,
    ).toPandas().sort_values("clock")[names].to_numpy()
    want = x.copy()
    known = ~np.isnan(x)
    for i in range(n):
        for c in np.flatnonzero(~known[i]):
            both = known[i] & known
            total = np.zeros(n)
            for d in range(4):
                total += np.where(both[:, d], (np.nan_to_num(x[i, d]) - np.nan_to_num(x[:, d])) ** 2, 0.0)
            shared = both.sum(axis=1)
            ok = np.flatnonzero(known[:, c] & (shared > 0))
            near = ok[np.argsort(total[ok] / shared[ok], kind="stable")[:3]]
            want[i, c] = x[near, c].mean() if len(near) else np.nanmean(x[:, c])
    np.testing.assert_allclose(got, want, atol=1e-9)
