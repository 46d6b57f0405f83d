"""Runs equal those of a plain search over all periods and places."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from hostpulse.llm import runs
from hostpulse.llm.queries import op13_periodic_runs, planted


def plain(words, least=12):
    """All maximal runs: for every period the maximal stretches of words that equal the one a period on."""
    found, n = {}, len(words)
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            if words[i] != words[i + p]:
                i += 1
                continue
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j + p - i >= max(least, 2 * p):
                found.setdefault((i, j + p), p)  # the smallest period comes first
            i = j + 1
    return sorted((s, e - s, p) for (s, e), p in found.items())


def fast(texts, least=12):
    ids = {}
    flat = np.array([ids.setdefault(w, len(ids)) for t in texts for w in t], np.int64)
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    first = np.cumsum([0] + [len(t) for t in texts])
    out = [[] for _ in texts]
    for s, n, p in zip(*(x.tolist() for x in runs.runs(flat, owner, least))):
        out[owner[s]].append((s - int(first[owner[s]]), n, p))
    return out


def thue_morse(n):
    return [str(bin(i).count("1") % 2) for i in range(n)]


def fibonacci(n):
    a, b = "a", "ab"
    while len(b) < n:
        a, b = b, b + a
    return list(b[:n])


@pytest.mark.parametrize("seed", range(150))
def test_runs_are_those_of_a_plain_search(seed):
    rng = random.Random(seed)
    texts = []
    for _ in range(rng.randint(1, 6)):
        t = []
        while len(t) < rng.choice([0, 5, 30, 120, 400]):
            block = [rng.choice("abcdefgh"[: rng.randint(1, 8)]) for _ in range(rng.randint(1, 30))]
            t += (block * rng.randint(1, 9))[: rng.randint(1, 200)]
            if rng.random() < 0.5:
                t += [f"u{rng.random()}" for _ in range(rng.randint(0, 5))]
        texts.append(t)
    least = rng.choice([12, 12, 3, 5, 20])
    assert fast(texts, least) == [plain(t, least) for t in texts]


@pytest.mark.parametrize("text", [[], ["a"] * 11, ["a"] * 12, ["a"] * 1000, thue_morse(600), fibonacci(700), list("abc") * 150 + list("abd") * 40, [str(i) for i in range(500)] * 3])
def test_special_words(text):
    assert fast([text, text[:20], text])[0] == plain(text)
    assert fast([text], 2)[0] == plain(text, 2)


def test_the_same_in_many_texts():
    t = list("abcdefg") * 20
    assert fast([t] * 50) == [plain(t)] * 50


def collapsed(words):
    gone = {i for s, n, p in plain(words) for i in range(s + p, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def test_table(spark):
    line = " ".join("abcdefghijklm")
    texts = [
        None, "", " \t\n ", "one", line * 3, "\n".join([line] * 5), f"x {line} {line} {line} y", "é " * 40, "漢字　かな " * 9 + "ende", "w\x0bw\x0cw " * 30,
        "buy now " * 20000 + "end", " ".join(map(str, range(3000))),
    ]
    rows = [(i, t, i) for i, t in enumerate(texts)] + [(4, texts[4], 0), (None, texts[5], 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, RUNS int")
    found = runs.periodic_runs(docs)
    assert found.columns == ["doc_id", "n_words", "runs", "collapsed"]
    got = Counter((r.doc_id, r.n_words, tuple(tuple(x) for x in r.runs), r.collapsed) for r in found.collect() if r.doc_id != 10)
    want = Counter()
    for i, t, _ in rows:
        w = [x.decode() for x in (t or "").encode().split()]
        if i != 10:
            want[i, len(w), tuple(plain(w)), collapsed(w)] += 1
    assert got == want
    huge = found.filter("doc_id = 10").first()
    assert [tuple(x) for x in huge.runs] == [(0, 40000, 2)] and huge.collapsed == "buy now end"
    assert runs.periodic_runs(docs.limit(0)).count() == 0


def test_planted_ends_are_found(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(str(rng.randint(0, 10**6)) for _ in range(rng.randint(0, 300)))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    hits = 0
    for r in runs.periodic_runs(docs, edit=planted).collect():
        words = [w.decode() for w in planted(r.doc_id, rows[r.doc_id][1].encode().split())]
        assert [tuple(x) for x in r.runs] == plain(words)
        assert r.collapsed == collapsed(words)
        hits += bool(r.runs)
    assert hits > 10


def test_query_on_the_whole_table(spark):
    folder = "/root/testdata/sf0.001"
    want = set()
    for d, text in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect():
        w = [x.decode() for x in (text or "").encode().split()]
        n, h = len(w), zlib.crc32(str(d).encode())
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        if len(w) > 3000:
            continue  # the plain search takes the square of the words
        found = plain(w)
        best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
        facts = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else 4 * (None,)
        lines = "".join(f"{s},{k},{p}\n" for s, k, p in found)
        want.add((d, len(found), *facts, *(hashlib.sha256(x.encode()).hexdigest() for x in (lines, collapsed(w)))))
    got = {tuple(r) for r in op13_periodic_runs(spark, folder).collect()}
    assert len(want) > 150 and want <= got and len({r[1] > 0 for r in want}) == 2
