"""Removed bytes are those of the definition; sorting puts equal strings together."""

import hashlib
import random

import numpy as np
import pytest

from hostpulse.llm import suffixes
from hostpulse.llm.deepshallow import BlindTrie, sort_strings


def brute(rows, length=50):
    key = lambda d: (d is None, d or 0)
    first = {}
    for d, t in rows:
        raw = (t or "").encode()
        for p in range(len(raw) - length + 1):
            w = raw[p : p + length]
            first[w] = min(first.get(w, key(d)), key(d))
    out = []
    for d, t in rows:
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        for p in range(len(raw) - length + 1):
            if first[raw[p : p + length]] < key(d):
                gone[p : p + length] = True
        spans = int(gone[:1].sum()) + int((gone[1:] & ~gone[:-1]).sum())
        kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
        out.append((d, len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus(seed):
    rng = random.Random(seed)
    letters = rng.choice(["ab", "abcdé ", "abcdefghijklmnop \n"])
    passages = ["".join(rng.choices(letters, k=k)) for k in (49, 50, 51, 80, 200, 400)] + ["a" * 120, "ab" * 70]
    texts = []
    for _ in range(30):
        parts = [rng.choice(passages) if rng.random() < 0.5 else "".join(rng.choices(letters, k=rng.randint(0, 90))) for _ in range(rng.randint(0, 6))]
        text = "".join(parts)
        if text and rng.random() < 0.3:
            at = rng.randrange(len(text))
            text = text[:at] + "Z" + text[at + 1 :]
        texts.append(text)
    rows = [(i * 2, t) for i, t in enumerate(texts)]
    return rows + [(1, texts[3]), (3, texts[3]), (5, None), (7, ""), (None, texts[4]), (None, texts[4] + texts[5]), (8, texts[6]), (8, texts[7]), (8, texts[7])]


@pytest.mark.parametrize("seed", range(6))
def test_removed_bytes(spark, monkeypatch, seed):
    if seed % 2:
        monkeypatch.setattr(suffixes, "SLICE", 700)
        monkeypatch.setattr(suffixes, "_PIECE", 300)
    rows = corpus(seed)
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n_bytes int").repartition(5)
    got = suffixes.remove_repeats(docs).drop("cuts").collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)


def test_empty_table(spark):
    assert suffixes.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("seed", range(8))
def test_equal_windows_share_their_part(seed):
    rng = random.Random(seed)
    data = np.frombuffer(bytes(rng.choices(b"ab" if seed % 2 else b"abcdefgh", k=3000)) * 2, np.uint8)
    h, x, y = suffixes.window_runs(data)
    assert x[0] == 0 and y[-1] == len(data) - 49 and (x[1:] == y[:-1]).all()
    seen = {}
    for hash_, a, b in zip(h.tolist(), x.tolist(), y.tolist()):
        for p in range(a, b):
            assert seen.setdefault(data[p : p + 50].tobytes(), hash_) == hash_


@pytest.mark.parametrize("seed", range(20))
def test_strings_are_sorted(seed):
    rng = np.random.default_rng(seed)
    rows = rng.integers(97, 99, (rng.integers(1, 400), 50)).astype(np.uint8)
    rows[:, : rng.integers(0, 48)] = 97
    groups = rng.integers(0, 4, len(rows))
    order, new = sort_strings(rows, groups)
    keys = [(int(groups[i]), rows[i].tobytes()) for i in order]
    assert keys == sorted(keys)
    assert new.tolist() == [i == 0 or keys[i] != keys[i - 1] for i in range(len(keys))]


def test_blind_trie_orders():
    rng = random.Random(2)
    texts = [bytes(rng.choices(b"\x00\x01\xff", k=6)) for _ in range(300)]
    trie = BlindTrie()
    for i, t in enumerate(texts):
        trie.insert(i, t)
    found = trie.ordered()
    assert [texts[r[0]] for r in found] == sorted(set(texts))
    assert all(len({texts[i] for i in r}) == 1 for r in found)
    assert sorted(i for r in found for i in r) == list(range(300))
