"""Fingerprints and components equal those of all pairs."""

import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from hostpulse.llm import simhash
from hostpulse.llm.queries import op11_simhash


def plain_fingerprint(text):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        t = t.replace(c, " ")
    w = [x for x in t.split(" ") if x]
    if not w:
        return 0
    s = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if len(w) >= 3 else [" ".join(w)]
    h = [xxhash.xxh64(x.encode(), seed=42).intdigest() for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(fps, budget=3):
    """Per fingerprint the index of the first it is linked with."""
    label = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= budget and label[i] != label[j]:
                a, b = min(label[i], label[j]), max(label[i], label[j])
                label = [a if x == b else x for x in label]
    return label


def clouds(rng, n):
    """Fingerprints in clouds of all densities, many near the budget's edge."""
    out = []
    while len(out) < n:
        centre = rng.getrandbits(64)
        for _ in range(rng.choice([1, 2, 5, 30])):
            x = centre
            for b in rng.sample(range(64), rng.choice([0, 1, 2, 3, 4, 5])):
                x ^= 1 << b
            out.append(x)
            if rng.random() < 0.3:
                centre = x
    return list(dict.fromkeys(out[:n]))


@pytest.mark.parametrize("text", ["", None, " \n", "One", "one two", "One\x0btwo  THREE", "É é Ä", "a b c a b c a b c", "w " * 500, "漢字 かな x y"])
def test_fingerprints(text):
    assert simhash.fingerprint(text or "") == plain_fingerprint(text)


def test_long_texts_are_hashed_in_blocks(monkeypatch):
    text = " ".join(str(random.Random(2).randint(0, 99)) for _ in range(1000))
    for block in (1, 3, 997, 998, 999, 5000):
        monkeypatch.setattr(simhash, "_BLOCK", block)
        assert simhash.fingerprint(text) == plain_fingerprint(text)


@pytest.mark.parametrize("seed", range(20))
@pytest.mark.parametrize("at_once,waiting", [(1, 1 << 22), (7, 5), (1 << 16, 100), (1 << 16, 1 << 22)])
def test_a_trie_joined_with_itself_finds_the_links_its_order_suits(seed, at_once, waiting):
    rng = random.Random(seed)
    fps = sorted(clouds(rng, 150))
    # Nodes that share 16 bits, as a task gets them.
    x = np.array(fps, np.uint64)
    trie = simhash.Leaves(x)
    front = x >> np.uint64(48)
    cuts = np.flatnonzero(np.diff(front)) + 1
    lo, hi = np.append(0, cuts), np.append(cuts, len(x))
    trie.join(np.stack([lo, hi, lo, hi], 1), at_once=at_once, waiting=waiting)
    suited = [(i, j) for i in range(len(fps)) for j in range(i) if fps[i] >> 48 == fps[j] >> 48
              and bin((fps[i] ^ fps[j]) >> 32).count("1") <= 1 and bin(fps[i] ^ fps[j]).count("1") <= 3]
    assert all(trie.label[i] == trie.label[j] for i, j in suited)
    whole = plain_components(fps)
    assert all(whole[i] == whole[trie.label[i]] for i in range(len(fps)))


def test_a_dense_cloud_costs_no_pair_of_all_leaves():
    rng = np.random.default_rng(1)
    x = np.unique((rng.integers(0, 1 << 14, 12_000).astype(np.uint64)) << np.uint64(8))  # all near each other
    trie = simhash.Leaves(x)
    looked = []
    shared = trie.shared
    trie.shared = lambda lo, hi: (looked.append(len(lo)), shared(lo, hi))[1]
    trie.join(np.array([[0, len(x), 0, len(x)]]))
    assert len(set(trie.label.tolist())) == 1
    assert sum(looked) < 40 * len(x)


@pytest.mark.parametrize("order", simhash.ORDERS)
def test_orders_turn_back(spark, order):
    fps = [0, 1, -1, 2**63 - 1, -(2**63), 0x0123456789ABCDEF]
    got = [r.v for r in spark.createDataFrame([(f,) for f in fps], "fp long").select(simhash.turned(F.col("fp"), order).alias("v")).collect()]
    assert simhash.turned_back(np.array(got, np.int64).view(np.uint64), order).view(np.int64).tolist() == fps


@pytest.mark.parametrize("most", [3, 40, 1 << 19])
def test_components_are_those_of_all_pairs(spark, monkeypatch, most):
    """Small ``most`` sends large nodes down to pairs of their descendants."""
    rng = random.Random(most)
    fps = clouds(rng, 400) + [0, 2**64 - 1, 2**63, 2**63 + 1]
    fps += [fps[0] ^ 1 ^ 1 << 20 ^ 1 << 40, fps[1] ^ 7 << 16, fps[2] ^ 0x8000800080000000]
    fps = list(dict.fromkeys(fps))
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    ids = rng.sample(range(10_000), len(fps))
    rows = list(zip(ids, signed)) + [(20_000 + i, s) for i, s in enumerate(signed[:50])] + [(None, signed[3]), (None, 77)]
    monkeypatch.setattr(simhash, "document_fingerprints", lambda docs: docs)
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, fp long").repartition(5), most).collect()
    fps.append(77)
    least = {}
    label = dict(zip(np.array(fps, np.uint64).view(np.int64).tolist(), plain_components(fps)))
    for d, f in rows:
        if d is not None:
            least[label[f]] = min(d, least.get(label[f], d))
    assert Counter(tuple(r) for r in got) == Counter((d, f, least.get(label[f])) for d, f in rows)


def test_table(spark):
    base = " ".join(f"w{i}" for i in range(400))
    texts = {
        9: base, 4: base.upper(), 7: base + " more", 1: None, 2: "", 3: "  \n", 8: "alone", 30: "x" * 200_000 + " y z", 31: "quite other words in here " * 9,
    }
    rows = [(i, t, i) for i, t in texts.items()] + [(9, base, 5), (None, base, 0), (None, "nobody", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, FP int").repartition(4)
    got = simhash.near_duplicates(docs)
    assert got.columns == ["doc_id", "fp", "component_id"]
    found = Counter((r.doc_id, r.fp % 2**64, r.component_id) for r in got.collect())
    fps = sorted({plain_fingerprint(t) for _, t, _ in rows})
    label = dict(zip(fps, plain_components(fps)))
    least = {}
    for d, t, _ in rows:
        f = plain_fingerprint(t)
        if d is not None:
            least[label[f]] = min(d, least.get(label[f], d))
    assert found == Counter((d, plain_fingerprint(t), least.get(label[plain_fingerprint(t)])) for d, t, _ in rows)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_query_on_the_whole_table(spark):
    folder = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()}
    fps = sorted({plain_fingerprint(t) for t in docs.values()})
    label = dict(zip(fps, plain_components(fps)))
    least = {}
    for d, t in docs.items():
        k = label[plain_fingerprint(t)]
        least[k] = min(d, least.get(k, d))
    want = {(d, f"{plain_fingerprint(t):016x}", least[label[plain_fingerprint(t)]]) for d, t in docs.items()}
    assert {tuple(r) for r in op11_simhash(spark, folder).collect()} == want
