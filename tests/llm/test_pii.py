"""Base spans equal the plain patterns; reliabilities and classifier separate what they should."""

import random
import re

import numpy as np
import pytest

from hostpulse.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain(text):
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in CARD.finditer(text):
        d = re.sub("[^0-9]", "", m.group())
        if 14 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0:
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in PHONE.finditer(text) if 10 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return sorted(out, key=lambda s: (s[1], pii.RANK[s[0]]))


@pytest.mark.parametrize("seed", range(200))
def test_base_spans_are_those_of_the_patterns(seed):
    rng = random.Random(seed)
    atoms = ["a.b@c.de", "@", ".", "1.2.3.4", "300.1.1.1", "4111 1111 1111 1111", "+1 (017) 555-7713", "+", "-", " ", "é", "x@y", "12", "..", "a@b.c@d.e", "5927243074273351"]
    text = "".join(rng.choice(atoms) for _ in range(rng.randint(0, 30)))
    assert pii.base_spans(text) == plain(text)


@pytest.mark.parametrize("text", ["1" * 100_000, "a" * 100_000 + "@", "+1" + "(" * 100_000, "1." * 50_000, "@" * 100_000, "a@" * 50_000])
def test_long_runs_end(text):
    pii.candidates(text, pii.base_spans(text))


def test_reliabilities_find_the_liar():
    rng = np.random.default_rng(1)
    truth = rng.random(5000) < 0.3
    good = np.stack([np.where(rng.random(5000) < 0.9, truth, ~truth) for _ in range(3)], 1)
    votes = np.where(np.column_stack([good, rng.random(5000) < 0.5]), 1, -1)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    q, p = pii.reliabilities(["k"] * len(patterns), patterns, counts.astype(float))
    gap = np.abs(p[:, 2, 1] - p[:, 2, 0])
    assert gap[:3].min() > 0.6 > 0.3 > gap[3]


def test_table(spark):
    rows = [
        (1, "write to ann.lee@mail.example.com or +1 (017) 555-7713", 1), (2, None, 1), (None, "", 2), (3, "call (212) 555-0187 now", 3),
        (3, "call (212) 555-0187 now", 3), (4, 'token = "1eb9c654e721b4f812088970e66a6345cee33dd6"', 4), (5, "Version 2.0 of 2004", 5),
        (6, "see 10.0.0.1, card 4111 1111 1111 1111", 6), (7, "phone +44 20 7946 0958 mail a@b.org", 7),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, Spans int")
    got = {r.doc_id: r for r in pii.find_personal_data(docs).collect()}
    assert (got[1].n_email, got[1].n_phone, got[6].n_ip, got[6].n_card, got[7].n_phone) == (1, 1, 1, 1, 1)
    assert got[2].spans == got[5].spans == got[None].spans == ""
    assert got[4].spans == "secret:9:49"
    for i, text, _ in rows:
        mine = {s for s in got[i].spans.split(",") if s}
        assert {f"{k}:{a}:{b}" for k, a, b in plain(text or "")} <= mine
    assert pii.find_personal_data(docs.limit(0)).count() == 0
    assert pii.find_personal_data(docs).count() == len(rows)


def test_classifier_is_fitted_on_all_candidates(spark):
    hot = {"phone": "call (212) 555-0187 now\n", "email": "mail a@b.org\n", "ip": "host 10.0.0.1\n", "card": "visa 4111 1111 1111 1111\n"}
    texts = [t * 4_100 for t in hot.values()]
    texts += ['token = "1eb9c654e721b4f812088970e66a6345cee33dd6"', "key: aaaaaaaaaaaaaaaa1", "isbn 123-456-7890", "ann (at) example (dot) com", "1234 5678 9012 3456", "x1 1:2:3:4:5:6:7:8"] * 3
    told = [pii.candidates(t, pii.base_spans(t)) for t in texts]
    flat = [c for cs in told for c in cs]
    counts = {}
    for c in flat:
        counts[c[0], tuple(c[4])] = counts.get((c[0], tuple(c[4])), 0) + 1
    keys = sorted(counts)
    q, _ = pii.reliabilities([k for k, _ in keys], np.array([v for _, v in keys]), np.array([counts[k] for k in keys], float))
    belief = dict(zip(keys, q))
    x, y = np.array([c[5] for c in flat]), np.array([belief[c[0], tuple(c[4])] for c in flat])
    x1, w = np.hstack([x, np.ones((len(x), 1))]), np.zeros(x.shape[1] + 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-x1 @ w))
        w = w - np.linalg.solve((x1 * (p * (1 - p))[:, None]).T @ x1 / len(x1) + 1e-3 * np.eye(len(w)), x1.T @ (p - y) / len(x1) + 1e-3 * w)
    want = [{f"{k}:{a}:{b}" for k, a, b, base, _, f in cs if base or np.dot(f, w[:-1]) + w[-1] >= 0} for cs in told]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: {s for s in r.spans.split(",") if s} for r in pii.find_personal_data(docs).collect()}
    assert [got[i] for i in range(len(texts))] == want


@pytest.mark.parametrize("text, span", [
    ("password: correcthorsebattery", ("secret", 10, 29)), ("ann (AT) example (DOT) com", ("email", 0, 26)), ("ann [AT] example.com", ("email", 0, 20)),
    ("ann (at) example.com", ("email", 0, 20)), ("abcd:abcd:abcd:abcd:abcd:abcd:abcd:abcd", ("ip", 0, 39)), ("TOKEN=" + "aB-" * 400, ("secret", 6, 1206)),
])
def test_candidates_do_not_depend_on_an_unrelated_digit(text, span):
    for t in (text, text + " 7"):
        assert [c[:3] for c in pii.candidates(t, pii.base_spans(t))] == [span]
