"""Outputs equal a plain version by slicing, and the texts come back from them."""

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from hostpulse.llm import fim


def plain(doc_id, text, seed=1):
    """n, form, prefix length, middle length, output by slicing."""
    t = text or ""
    d = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(d[i : i + 8], 16) for i in (0, 8, 16, 24))
    if not t or any(s in t for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return len(t), "plain", None, None, t
    a, b = sorted((h1 % (len(t) + 1), h2 % (len(t) + 1)))
    p, m, s = t[:a], t[a:b], t[b:]
    if h4 % 100 < 20:
        return len(t), "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return len(t), "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("units,piece", [(1 << 20, 1 << 18), (100, 7), (64, 1)])
def test_table(spark, monkeypatch, units, piece):
    monkeypatch.setattr(fim, "_UNITS", units)
    monkeypatch.setattr(fim, "_SLICE", piece)
    rng = random.Random(3)
    atoms = ["a", "é", "漢", "🙂", " ", "\n", "<", ">", "<P", "S>", "<M", "P>", "word "]
    texts = ["".join(rng.choice(atoms) for _ in range(rng.randint(0, 60))) for _ in range(300)]
    texts += [None, "", "x", "🙂", "a<P>b", "<S>", "é" * 5000, "one\n" * 2000, "é" * 50]
    rows = [(i * 7 - 50, t, i) for i, t in enumerate(texts)] + [(1, "again", 0), (1, "again", 0), (None, "no id", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, Form int").repartition(3)
    made = fim.fill_in_middle(docs)
    assert made.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    got = Counter(tuple(r) for r in made.withColumn("text", fim.restored(F.col("output"), F.col("form"))).collect())
    assert got == Counter((i, *plain(i, t), t or "") for i, t, _ in rows)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    assert fim.fill_in_middle(docs.limit(0)).count() == 0


def test_a_very_long_text(spark):
    text = "".join(random.Random(1).choice("abcé漢\n ") for _ in range(700_000))
    docs = spark.createDataFrame([(i, text) for i in range(3)], "doc_id long, text string")
    assert sorted(tuple(r) for r in fim.fill_in_middle(docs).collect()) == [(i, *plain(i, text)) for i in range(3)]


def test_other_names_and_shares(spark):
    docs = spark.createDataFrame([(i, "abc" * i, i) for i in range(50)], "key int, body string, text int")
    made = fim.fill_in_middle(docs, "key", "body", seed=9, sentinels=("<a>", "<b>", "<c>"), cut_percent=100, suffix_first_percent=100)
    assert made.columns == ["key", "text", "n", "form", "prefix_chars", "middle_chars", "output"]
    for r in made.withColumn("back", fim.restored(F.col("output"), F.col("form"), ("<a>", "<b>", "<c>"))).collect():
        assert r.back == "abc" * r.key and r.form == ("spm" if r.key else "plain")


@pytest.mark.parametrize("marks", [("<P>", "<P>", "<M>"), ("P", "<S>", "<M>"), ("<P>>", "<S>", "<M>")])
def test_sentinels_that_could_arise_are_refused(spark, marks):
    with pytest.raises(ValueError):
        fim.fill_in_middle(spark.createDataFrame([(1, "a")], "doc_id long, text string"), sentinels=marks)
