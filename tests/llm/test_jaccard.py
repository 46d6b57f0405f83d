"""Components equal those of all pairs; filters and boundary lose no link."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from hostpulse.llm import jaccard
from hostpulse.llm.components import components


def shingles(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in low.replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    top = list(range(len(rows)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                top[find(i)] = find(j)
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((d, len(sets[i]), min(ids) if ids and sets[i] else d))
    return sorted(out, key=str)


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(14):
        words = rng.choices(vocabulary, k=rng.choice([3, 5, 6, 8, 9, 12, 20, 40, 60, 150, 400]))
        for _ in range(rng.choice([1, 2, 5, 12])):
            copy = list(words)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            if rng.random() < 0.3:
                copy = copy[: max(1, int(len(copy) * rng.choice([0.97, 0.9, 0.85])))]
            texts.append(" ".join(copy).upper() if rng.random() < 0.2 else " ".join(copy))
    shared = " ".join(rng.choices(vocabulary, k=30))
    texts += [shared + " " + " ".join(rng.choices(vocabulary, k=60)) for _ in range(25)]
    rows = [(i * 3, t) for i, t in enumerate(rng.sample(texts, len(texts)))]
    return rows + [(1, None), (4, ""), (7, " \n\t"), (10, "one"), (13, "One"), (None, texts[0]), (0, rows[0][1]), (3, texts[5])]


@pytest.mark.parametrize("seed, light", [(0, None), (1, 0), (2, 10_000)])
def test_components_are_those_of_all_pairs(spark, monkeypatch, seed, light):
    rows = corpus(seed)
    if light is not None:
        monkeypatch.setattr(jaccard, "boundary", lambda *_: light if light < 200 else 120)
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n_shingles int").repartition(6)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.join_similar(docs).collect()), key=str)
    assert got == brute(rows)


def test_one_row_of_each_group_stays(spark):
    rows = corpus(9)
    docs = spark.createDataFrame([(d, t, i) for i, (d, t) in enumerate(rows)], "doc_id long, text string, k_rows int").repartition(5)
    kept = jaccard.one_of_each_group(docs).collect()
    comp = brute(rows)
    groups = {c for d, n, c in comp if n}
    named = [r.doc_id for r in kept if shingles(r.text)]
    assert sorted(named, key=str) == sorted(groups, key=str)
    assert sorted(r.doc_id for r in kept if not shingles(r.text)) == [1, 4, 7]
    assert jaccard.one_of_each_group(docs.limit(0)).count() == 0
    again = spark.createDataFrame([(1, "a b c d e f", 1)] * 5 + [(2, None, 1)] * 3, docs.schema)
    assert sorted(r.doc_id for r in jaccard.one_of_each_group(again).collect()) == [1, 2]


def test_filters_keep_every_similar_pair():
    rng = random.Random(3)
    for _ in range(400):
        n = rng.choice([2, 3, 4, 5, 9, 17, 40, 99, 230])
        a = set(rng.sample(range(10**6), n))
        b = set(a)
        for _ in range(rng.randint(0, max(1, n // 8))):
            if rng.random() < 0.5 and len(b) > 1:
                b.discard(rng.choice(sorted(b)))
            else:
                b.add(rng.randrange(10**6))
        if a == b or 100 * len(a & b) < 80 * len(a | b):
            continue
        x, y = sorted(a), sorted(b)
        (pa, ha), (pb, hb) = (tuple(int(v) for v in jaccard.prefix_sizes(np.array(len(s)))) for s in (x, y))
        assert len(set(x[:pa]) & set(y[:pb])) >= 2
        both = len(set(x[:ha]) & set(y[:hb]))
        assert both >= jaccard.heavy_need(np.array(len(x))) and both >= jaccard.heavy_need(np.array(len(y)))


def test_boundary_is_the_cheapest():
    histogram = [(n, 100) for n in range(1, 300)]

    def cost(x):
        total = 0.0
        for n, c in histogram:
            p2, ph = (int(v) for v in jaccard.prefix_sizes(np.array(n)))
            total += c * (p2 * (p2 - 1) / 2 * (n <= x) + 2 * ph * (n >= jaccard.least_overlap(x + 1)))
        return total

    assert cost(jaccard.boundary(histogram)) == min(cost(x) for x in range(300))
    assert jaccard.boundary([]) == 0


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(150)] + [(i, i + 1) for i in range(1000, 1060)] + [(5, 5)]
    top = {x: x for pair in links for x in pair}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        top[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in top if any(x in p and p[0] != p[1] for p in links)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_each_class_finds_one_text(spark):
    texts = [f"word{i} and a few more of them {i}" for i in range(30)]
    rows = [(None, t) for t in texts] + [(7, t + " again") for t in texts] + [(None, texts[0])] * 5 + [(8, "the same row twice or more")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    keyed = docs.select("doc_id", F.xxhash64("text").alias("rep_key")).groupBy("doc_id", "rep_key").agg(F.count(F.lit(1)).alias("rep_rows"))
    wanted = keyed.select(F.col("rep_key").alias("class"), F.col("doc_id").alias("rep"), "rep_key", "rep_rows")
    got = jaccard.class_texts(docs, wanted).withColumn("own", F.xxhash64("text") == F.col("class")).collect()
    assert len(got) == wanted.count() == 61 and all(r.own for r in got)


def near_copies(seed, n, words, edits):
    """A text and copies with so many words replaced that most copies link with the text but not with each other, or barely."""
    rng = random.Random(seed)
    base = [f"b{seed}x{i}" for i in range(words)]
    texts = [" ".join(base)]
    for k in range(n):
        copy = list(base)
        for i in rng.sample(range(words), rng.choice(edits)):
            copy[i] = f"e{seed}x{k}x{i}"
        if rng.random() < 0.2:
            del copy[rng.randrange(len(copy)) :][: rng.randint(0, 5)]
        texts.append(" ".join(copy))
        if rng.random() < 0.15:  # a copy of the copy
            copy[rng.randrange(len(copy))] = f"again{k}"
            texts.append(" ".join(copy))
    return texts


def test_near_copies_below_the_threshold_make_no_pairs(spark, monkeypatch):
    texts = near_copies(1, 300, 140, [2, 3, 4, 4, 5, 5, 6]) + near_copies(2, 60, 60, [1, 2, 3])
    rows = [(i, t) for i, t in enumerate(random.Random(4).sample(texts, len(texts)))]
    made = []
    inside = jaccard.about_centre
    monkeypatch.setattr(jaccard, "about_centre", lambda *a: (lambda df: (made.append(df.count()), df)[1])(inside(*a)))
    outside = jaccard.across
    monkeypatch.setattr(jaccard, "across", lambda *a: (lambda df: (made.append(df.count()), df)[1])(outside(*a)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.join_similar(docs).collect()), key=str)
    want = brute(rows)
    assert got == want
    groups = len({c for _, _, c in want})
    assert groups > 100  # most texts stay alone
    assert sum(made) < 4 * len(rows), made
