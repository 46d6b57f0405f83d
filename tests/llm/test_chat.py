"""Snapshots that begin a longer conversation go, the rest is rendered whole."""

import pytest

from hostpulse.llm import chat


def expected(turns):
    convs = {}
    for c, turn, role, text in turns:
        if c is not None:
            convs.setdefault(c, []).append((turn, role, text))
    low = lambda x: (x is not None, x if x is not None else 0)
    convs = {c: [(r, t) for _, r, t in sorted(v, key=lambda x: (low(x[0]), (x[1] is not None, x[1] or ""), (x[2] is not None, x[2] or "")))] for c, v in convs.items()}
    out = {}
    for c, v in convs.items():
        if not any(d != c and w[: len(v)] == v and (len(w) > len(v) or d < c) for d, w in convs.items()):
            out[c] = (len(v), "".join(f"<|{r if r is not None else 'unknown'}|>\n{t or ''}\n" for r, t in v))
    return out


@pytest.mark.parametrize("block, part", [(1024, 512), (2, 512), (1, 2)])
def test_collapse(spark, block, part):
    turns = [
        (1, 0, "user", "hi"), (1, 1, "bot", "yes"), (2, 0, "user", "hi"), (3, 0, "user", "hi"), (3, 1, "bot", "yes"), (3, 2, "user", "more"),
        (4, 0, "user", None), (5, 0, "user", ""), (5, 1, None, "x"), (6, 0, "user", "alone"), (7, 0, "user", "alone"), (8, 0, "bot", "hi"),
        (None, 0, "user", "lost"), (9, 3, "user", "gap"), (9, 5, "bot", "ok"), (10, 0, "user", "gap"), (10, 0, "zzz", "tie"), (11, None, "user", "hi"),
        *[(20, k, "user", f"t{k}") for k in range(9)], *[(21, k, "user", f"t{k}") for k in range(7)],
    ]
    df = spark.createDataFrame([(*t, 1) for t in turns], "conv_id long, turn int, role string, text string, n int").repartition(5)
    got = {}
    for r in sorted(chat.rendered(df, part, block).collect(), key=lambda r: (r.conv_id, r.part)):
        n, text = got.get(r.conv_id, (r.n_turns, ""))
        got[r.conv_id] = (n, text + r.chat)
    assert got == expected(turns)
    assert chat.rendered(df.limit(0)).count() == 0
