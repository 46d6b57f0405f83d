"""Budgets follow the weights, shortages go to siblings first, and leaves take the beginning of their epochs."""

import hashlib
import random

import pytest

from hostpulse.llm import mixing


def test_shortage_goes_to_siblings_before_ancestors():
    supply = {("a", "x"): 10, ("a", "y"): 100, ("b", "z"): 100}
    got = mixing.budgets(supply, lambda p: 1.0, 100, 1)
    assert got == pytest.approx({("a", "x"): 10, ("a", "y"): 40, ("b", "z"): 50})
    got = mixing.budgets({("a", "x"): 10, ("a", "y"): 20, ("b", "z"): 100}, lambda p: 1.0, 100, 1)
    assert got == pytest.approx({("a", "x"): 10, ("a", "y"): 20, ("b", "z"): 70})


@pytest.mark.parametrize("seed", range(30))
def test_budgets_use_all_there_is(seed):
    rng = random.Random(seed)
    supply = {(d, i, s): rng.randint(0, 500) for d in "ab" for i in "xyz" for s in range(3) if rng.random() < 0.8}
    weights = {}
    total = rng.randint(0, 4000)
    got = mixing.budgets(supply, lambda p: weights.setdefault(p, rng.choice([0.0, 0.5, 1.0, 3.0])), total, 2)
    assert all(got.get(p, 0) <= 2 * n + 1e-6 for p, n in supply.items())
    free = sum(2 * n for p, n in supply.items() if all(weights[p[: k + 1]] > 0 for k in range(3)))
    assert sum(got.values()) == pytest.approx(min(total, free))


def brute(rows, weight, total, epochs, seed):
    leaves = {}
    for r in rows:
        leaves.setdefault(r[1:3], []).append(r)
    supply = {k: sum(r[3] or 0 for r in v) for k, v in leaves.items()}
    share = mixing.budgets(supply, weight, float(sum(supply.values()) if total is None else total), epochs)
    out = []
    for k, v in leaves.items():
        budget = int(share.get(k, 0) + 1e-6)
        if not budget:
            continue
        full, rest = divmod(budget, supply[k])
        order = sorted(v, key=lambda r: (hashlib.md5(f"{seed}/{full}/{'null' if r[0] is None else r[0]}".encode()).hexdigest(), r[3] or 0))
        run = 0
        for r in order:
            run += r[3] or 0
            c = min(epochs, full + (run <= rest))
            if c:
                out.append((r[0], r[1], r[2], r[3], c))
    return sorted(out, key=str)


@pytest.mark.parametrize("ranges", [1, 4, 1024])
@pytest.mark.parametrize("total", [None, 300, 10**9, 0])
def test_table(spark, ranges, total):
    rng = random.Random(7)
    rows = [(i, rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "s3"]), rng.choice([None, 1, 5, 40])) for i in range(150)]
    rows += [(3, "en", "s1", 5)] * 4 + [(None, "de", "s2", 7), (999, "zz", "s9", 0)]
    weight = lambda p: {"en": 3.0, "de": 1.0, None: 0.5}.get(p[0], 1.0) if len(p) == 1 else 1.0
    docs = spark.createDataFrame([(*r, 9) for r in rows], "doc_id long, lang string, source string, n long, Copies int").repartition(5)
    got = mixing.mix(docs, ["lang", "source"], "n", weight, total, epochs=2, seed=3, ranges=ranges)
    assert sorted(((r.doc_id, r.lang, r.source, r.n, r.copies) for r in got.collect()), key=str) == brute(rows, weight, total, 2, 3)
    assert mixing.mix(docs.limit(0), ["lang"], "n", weight).count() == 0


def test_words(spark):
    df = spark.createDataFrame([("a  b\tc\x0bd\re",), (None,), ("",), (" x y z",)], "text string")
    assert [r[0] for r in df.select(mixing.word_tokens()).collect()] == [5, 0, 0, 2]
