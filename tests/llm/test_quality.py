"""Base measures equal their definitions; the trained model holds on labels it has not seen."""

import random
import re

import pytest
from pyspark.sql import functions as F

from hostpulse.llm import quality

DATA = "/root/testdata/sf0.01"


def measures(text):
    words = re.findall("[^ \t\n\x0b\x0c\r]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    hit = set()
    for i, w in enumerate(windows):
        if windows.count(w) > 1:
            hit |= {i, i + 1, i + 2}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search("[^ \t\n\x0b\x0c\r]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(len(w) for w in words), sum(c in "#*$%&|<>" for c in text), dup, len(hit)


@pytest.mark.parametrize("seed", range(60))
def test_base_measures(seed):
    rng = random.Random(seed)
    text = "".join(rng.choice(["a", "b ", "c\n", " a", "é x", "#", "\t", "\n\n", "a b c ", "|<>", "\x1c"]) for _ in range(rng.randint(0, 120)))
    assert quality.base_measures(text) == measures(text)


def test_word_hashes_depend_on_the_word_only():
    import numpy as np

    def words(t):
        return quality.word_hashes(np.frombuffer(t.encode(), np.uint8))[1].tolist()

    one = dict(zip("alpha beta ga é".split(), words("alpha beta ga é")))
    assert words("  é\nbeta\t\talpha ga beta ") == [one[w] for w in "é beta alpha ga beta".split()]
    assert len({*one.values()}) == 4 and words("") == words(" \n") == []


def test_model_holds_on_other_labels(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    taught = labels.filter("doc_id % 2 = 0")
    model = quality.train(docs, taught)
    rows = quality.apply_rules(docs, model).join(labels.filter("doc_id % 2 = 1"), "doc_id").filter("NOT base_failed").collect()
    good, bad = [r for r in rows if r.quality == 1], [r for r in rows if r.quality == 0]
    assert len(good) > 50 and len(bad) > 5
    assert sum(r.kept for r in good) / len(good) > 0.97
    assert sum(not r.kept for r in bad) / len(bad) > 0.8
    mean = sum(r.p_good for r in rows) / len(rows)
    assert abs(mean - len(good) / len(rows)) < 0.08


def test_table(spark):
    words = " ".join(f"word{i}" for i in range(60))
    rows = [(1, words, 1), (2, None, 1), (2, "", 2), (None, words, 3), (4, "same same same " * 30, 4), (4, "same same same " * 30, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, Kept int")
    none = quality.train(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert none is None
    got = quality.apply_rules(docs, none).collect()
    assert len(got) == len(rows)
    assert [r.kept for r in got if r.text == words] == [True, True]
    assert all(r.base_failed and not r.kept for r in got if r.text != words)
    assert quality.apply_rules(docs.limit(0), none).count() == 0
    labels = spark.createDataFrame([(1, 1), (1, 0), (4, 0), (4, None), (None, 1), (9, 1)], "doc_id long, quality int")
    assert quality.train(docs, labels) is None  # document 1 has a bad label, 9 has no text: one class only
    assert quality.apply_rules(docs, none).select(F.count("p_good")).first()[0] == 0
