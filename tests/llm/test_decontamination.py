"""Leaked windows are found up to the edit budget, clean texts left alone, places right."""

import random

import numpy as np
import pytest

from hostpulse.llm import decontamination as dec


def prose(rng, n):
    return " ".join("".join(rng.choices("abcdefghijklmnoprstuvw", k=rng.randint(2, 8))) for _ in range(n))


def edited(rng, text, edits):
    for _ in range(edits):
        at = rng.randrange(1, len(text) - 1)
        kind = rng.random()
        text = text[:at] + ("" if kind < 0.3 else rng.choice("xyz")) + text[at + (kind < 0.7) :]
    return text


def distance_anywhere(p, r):
    cost = [0] * (len(r) + 1)
    for i, c in enumerate(p):
        row = [i + 1]
        for j, d in enumerate(r):
            row.append(min(cost[j] + (c != d), cost[j + 1] + 1, row[j] + 1))
        cost = row
    return min(cost)


@pytest.mark.parametrize("seed", range(60))
def test_alignment_is_the_least_number_of_edits(seed):
    rng = random.Random(seed)
    p = "".join(rng.choices("abc", k=rng.randint(1, 25)))
    r = "".join(rng.choices("abc", k=rng.randint(0, 40)))
    best = distance_anywhere(p, r)
    got = dec.align(p, r, best)
    assert got is not None and got[0] == best and (best == 0 or dec.align(p, r, best - 1) is None)
    assert distance_anywhere(p, r[got[1] : got[2]]) == best


def test_qgrams_tell_strings_apart():
    rng = random.Random(1)
    for q in range(1, 12):
        text = "".join(rng.choices("ab", k=300))
        h = dec.qgrams(dec.codes_of(text), q)
        seen = {}
        for i, x in enumerate(h.tolist()):
            assert seen.setdefault(text[i : i + q], x) == x
        assert len(set(seen.values())) == len(seen) and len(h) == 300 - q + 1


@pytest.mark.parametrize("seed", range(12))
def test_windows_within_the_budget_are_found(seed):
    rng = random.Random(seed)
    items = [(i, prose(rng, rng.choice([8, 20, 45]))) for i in range(20)]
    index = dec.build_index(items)
    texts, want = [], []
    for k in range(30):
        item, text = rng.choice(items)
        t = dec.normalised(text)
        at = rng.randrange(0, max(1, len(t) - 150))
        part = t[at : at + 150]
        body = edited(rng, part, rng.choice([0, 0, 3, 6]))
        texts.append(f"{prose(rng, 40)} {body} {prose(rng, 30)}")
        hit = any(distance_anywhere(w, texts[-1]) <= e for w, i, e in zip(index.texts, index.items, index.edits) if i == item)
        want.append((k, item) if hit else None)
    found = {(o, i) for o, i, *_ in dec.leaks_in(index, texts)}
    assert {w for w in want if w} <= found
    for o, i in found:
        assert any(distance_anywhere(w, texts[o]) <= e for w, j, e in zip(index.texts, index.items, index.edits) if i == j)


def test_places():
    for text in ["", "  a  B\n\nc ", "Straße İx  y", "\t", "ab"]:
        norm, at = dec.normalised(text), dec.places(text)
        assert len(at) == len(norm) + 1
        assert all(c == " " or c in text[p].lower() for c, p in zip(norm, at))


@pytest.mark.parametrize("block", [dec.BLOCK_CHARS, 600])
def test_table(spark, block):
    rng = random.Random(5)
    items = [(i, prose(rng, 40)) for i in range(6)] + [(6, None), (None, "x" * 90), (7, "short"), (0, prose(rng, 40))]
    bench = spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, doc_id int")
    one = items[1][1]
    rows = [(1, f"pre {one.upper()} post"), (2, None), (3, ""), (4, prose(rng, 300)), (5, "x" * 200), (6, "A  " + one.replace(" ", "\n") + one), (None, one), (6, "same"), (1, f"pre {one.upper()} post")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, item_id int")
    got = dec.find_leaks(docs, bench, block_chars=block).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(1, 1), (6, 1), (None, 1)}
    r = next(r for r in got if r.doc_id == 1)
    assert rows[0][1][r.start : r.end] == one.upper() and r.edits == 0
    assert sorted(str(r.text) for r in dec.without_leaks(docs, bench, block_chars=block).collect()) == sorted(str(t) for t in [None, "", rows[3][1], "x" * 200, "same"])
    assert dec.find_leaks(docs.limit(0), bench).count() == 0 and dec.find_leaks(docs, bench.limit(0)).count() == 0
    assert np.isclose(dec.without_leaks(docs, bench.limit(0)).count(), len(rows))


@pytest.mark.parametrize("edits", ["none", "spread", "mixed"])
@pytest.mark.parametrize("long", [100, 110, 128])
def test_passages_are_found_wherever_they_begin(edits, long):
    rng = random.Random(long)
    item = dec.normalised(prose(rng, 60))
    index = dec.build_index([(1, prose(rng, 60)), (7, item)])
    texts = []
    for at in range(len(item) - long + 1):
        part = item[at : at + long]
        if edits == "spread":
            part = "".join("#" if i % 9 == 8 and i < 90 else c for i, c in enumerate(part))
        elif edits == "mixed":
            part = edited(rng, part, 10)
        texts.append(f"{prose(rng, 20)}{part}{prose(rng, 20)}")
    assert {(o, i) for o, i, *_ in dec.leaks_in(index, texts)} == {(o, 7) for o in range(len(texts))}


def test_short_items_are_found_on_word_borders():
    items = [(1, "Is it so?"), (2, "the answer  is forty-two"), (3, "yes"), (4, "(a)"), (5, "is it so?"), (6, "x")]
    for owned in (items, [*items, (9, prose(random.Random(1), 40))]):
        index = dec.build_index(owned)
        texts = [dec.normalised(t) for t in ["He said: is it so? Yes.", "this it so?", "", "the answer is forty-twos", "well the answer is forty-two", "yesterday eyes", "b(a)c", "yes", "xx", "x", "ax x"]]
        assert {(o, i, texts[o][a:b]) for o, i, a, b, *_ in dec.leaks_in(index, texts)} == {
            (0, 1, "is it so?"), (0, 5, "is it so?"), (0, 3, "yes"), (4, 2, "the answer is forty-two"), (6, 4, "(a)"), (7, 3, "yes"), (9, 6, "x"), (10, 6, "x")}
