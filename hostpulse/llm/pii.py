"""Personal data by weak supervision.

Base spans follow four fixed patterns. Beyond them, looser candidates of every text are voted on by labelers: patterns,
gazetteers and the words around. Expectation-maximisation over the counts of all vote patterns of the corpus estimates
how reliable each labeler is; the posteriors train a logistic span classifier, which decides on the candidates.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostpulse.llm.common import PIECE, extended, fresh_name, pieces, texts_of
from hostpulse.session import materialised

KINDS = ["email", "ip", "card", "phone"]
#: Kinds only the method adds come after the base kinds.
MORE_KINDS = ["secret"]
RANK = {k: i for i, k in enumerate(KINDS + MORE_KINDS)}

# Gazetteers of the labelers.
TOP_DOMAINS = "com org net edu gov io co de fr es uk eu info biz ch at it nl be se us ca au in jp cn ru br mx example".split()
CALLING_CODES = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 56 57 61 62 63 64 65 66 81 82 84 86 90 91".split()
NAMES_OF_SECRETS = "token key apikey api_key secret password passwd pwd auth bearer credential".split()
WORDS_AROUND = {
    "email": "mail email e-mail contact write correo courriel".split(),
    "ip": "ip host server address addr from client".split(),
    "card": "card visa mastercard amex credit pay carte karte tarjeta".split(),
    "phone": "call tel phone fax mobile cell telefon telefono".split(),
    "secret": NAMES_OF_SECRETS,
}
WORDS_AGAINST = "version v release section isbn issn page figure table chapter rfc licence license".split()

_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile("[^0-9]+")
_HINT = re.compile("[0-9@]")

#: Kind, what every match holds (a text without it is passed over), and the pattern itself.
_LOOSE = [
    ("email", re.compile(r"[(\[](?:at|AT)[)\]]"), re.compile(r"[A-Za-z0-9_%+-]{1,64} ?[(\[](?:at|AT)[)\]] ?[A-Za-z0-9-]{1,64}(?:\.| ?[(\[](?:dot|DOT)[)\]] ?)[A-Za-z]{2,24}")),
    ("ip", re.compile(r":[0-9A-Fa-f]{1,4}:"), re.compile(r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])")),
    ("card", re.compile(r"[0-9]{4}"), re.compile(r"(?<![0-9])[0-9]{4}(?:[ -]?[0-9]{4}){2}[ -]?[0-9]{1,7}(?![0-9])")),
    ("phone", re.compile(r"[0-9]{3}"), re.compile(r"(?<![0-9+])(?:[0-9]{1,3}[ .-])?\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])")),
    ("secret", re.compile(r"[=:]"), re.compile(r"(?i)(?:token|key|secret|password|passwd|pwd)\"? ?[=:] ?\"?([A-Za-z0-9_+/=-]{12,}+)")),
]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the four base kinds in order of start, then kind; code points, end exclusive."""
    spans = []
    if not _HINT.search(text):
        return spans
    done, at = 0, text.find("@")
    while at >= 0:  # from every @ outwards, so that long runs without one cost nothing
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            spans.append(("email", start, m.end()))
            done = m.end()
        else:
            done = at + 1
        at = text.find("@", at + 1)
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            spans.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = _DIGITS.sub("", m.group()) if m.end() - m.start() <= 64 else ""
        if 14 <= len(digits) <= 19 and luhn(digits):
            spans.append(("card", *m.span()))
    for m in _PHONE.finditer(text):
        if 10 <= len(_DIGITS.sub("", m.group())) <= 15:
            spans.append(("phone", *m.span()))
    spans.sort(key=lambda s: (s[1], RANK[s[0]]))
    return spans


def votes(kind: str, span: str, before: str, after: str, base: bool) -> list[int]:
    """One vote per labeler: 1 personal data, -1 not, 0 none. ``before`` and ``after`` are the text around the span."""
    words = re.findall(r"[a-z_-]+", before.lower())
    digits = _DIGITS.sub("", span)
    shape = {
        "email": "@" in span, "ip": span.count(".") == 3 or span.count(":") == 7, "card": len(digits) == 16,
        "phone": "(" in span or span.startswith("+"), "secret": bool(re.fullmatch(r"[0-9a-f]{32,}|[A-Za-z0-9_+/=-]{20,}", span)),
    }[kind]
    if kind == "email":
        listed = 1 if span.rsplit(".", 1)[-1].strip(" )]").lower() in TOP_DOMAINS else 0
    elif kind == "phone":
        listed = 1 if any(digits.startswith(c) for c in CALLING_CODES) and len(digits) > 10 else 0
    elif kind == "card":
        listed = 1 if digits[:1] in ("3", "4", "5", "6") else -1
    elif kind == "secret":
        listed = 1 if words and words[-1] in NAMES_OF_SECRETS else 0
    else:
        listed = -1 if span.startswith(("0.", "127.")) else 0
    check = (1 if luhn(digits) else -1) if kind == "card" else 0
    spread = len(set(span)) / max(1, min(len(span), 16))
    return [
        1 if base else 0, 1 if shape else -1, listed, check,
        1 if any(w in WORDS_AROUND[kind] for w in words[-4:]) else 0,
        -1 if words and words[-1] in WORDS_AGAINST else 0,
        -1 if spread < 0.25 else (1 if kind == "secret" and spread >= 0.6 else 0),
        -1 if after[:1].isalnum() or before[-1:].isalnum() else 0,
    ]


def candidates(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int, bool, list[int], list[float]]]:
    """Base spans and looser ones that no base span overlaps: kind, start, end, base, votes, features."""
    found = [(k, a, b, True) for k, a, b in base]
    taken = sorted((a, b) for _, a, b in base)
    for kind, held, pattern in _LOOSE:
        if not held.search(text):
            continue
        i = 0
        for m in pattern.finditer(text):
            a, b = m.span(m.lastindex or 0)
            while i < len(taken) and taken[i][1] <= a:
                i += 1
            if i == len(taken) or taken[i][0] >= b:
                found.append((kind, a, b, False))
    out = []
    for kind, a, b, is_base in found:
        span, before, after = text[a:b], text[max(0, a - 40) : a], text[b : b + 8]
        v = votes(kind, span, before, after, is_base)
        out.append((kind, a, b, is_base, v, features(kind, span, v)))
    return out


def features(kind: str, span: str, v: list[int]) -> list[float]:
    """What the span classifier sees: the kind, the votes but the one that only base spans get, and the span's shape."""
    n = max(1, len(span))
    return [
        *[float(kind == k) for k in RANK], *[float(x) for x in v[1:]],
        sum(c.isdigit() for c in span) / n, sum(not c.isalnum() for c in span) / n, min(n, 64) / 64,
    ]


def reliabilities(kinds: list[str], patterns: np.ndarray, counts: np.ndarray, rounds: int = 100):
    """EM for labelers that err independently given the class, each kind with its own share of true spans.

    Returns the posterior of every pattern and P(vote | class) per labeler (axes: labeler, vote + 1, class).
    """
    names = sorted(set(kinds))
    which = np.array([names.index(k) for k in kinds])
    q = 1 / (1 + np.exp(-patterns.sum(1)))
    hot = np.stack([patterns == x for x in (-1, 0, 1)], 2).astype(float)
    for _ in range(rounds):
        w = np.stack([(1 - q) * counts, q * counts], 1)
        p = np.einsum("nlv,nc->lvc", hot, w) + 0.5
        p /= p.sum(1, keepdims=True)
        share = np.zeros((len(names), 2))
        np.add.at(share, which, w)
        share = (share + 1) / (share + 1).sum(1, keepdims=True)
        log = np.log(share)[which] + np.einsum("nlv,lvc->nc", hot, np.log(p))
        new = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -500, 500)))
        if np.abs(new - q).max() < 1e-9:
            break
        q = new
    return q, p


def slopes(w: np.ndarray, x: np.ndarray, y: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Gradient and curvature of the logistic loss at ``w``, summed over rows that stand for ``n`` candidates each; one flat array."""
    x = np.hstack([x, np.ones((len(x), 1))])
    p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
    return np.concatenate([x.T @ (n * (p - y)), ((x * (n * p * (1 - p))[:, None]).T @ x).ravel()])


def fit_classifier(total_slopes: Callable[[np.ndarray], np.ndarray], width: int, total: float, l2: float = 1e-3, rounds: int = 50) -> np.ndarray:
    """Logistic regression on soft labels by Newton steps; the last weight is the intercept.

    ``total_slopes`` gives the sum of ``slopes`` over all rows, which stand for ``total`` candidates.
    """
    w = np.zeros(width + 1)
    for _ in range(rounds):
        s = total_slopes(w) / total
        g = s[: len(w)] + l2 * w
        h = s[len(w) :].reshape(len(w), -1) + l2 * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


_KEYS = ["kind", "start", "end", "base", "votes", "features"]
_CANDIDATE = "kind: string, start: long, end: long, base: boolean, votes: array<int>, features: array<double>"


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find_personal_data(docs: DataFrame, text: str = "text", accept: float = 0.5) -> DataFrame:
    """``docs`` without its text, with n_email, n_ip, n_card, n_phone, base_sha256 and spans.

    The counts and the hash are those of the base spans; ``spans`` also holds candidates the classifier accepts. All candidates of
    all texts are voted on and counted, and the classifier is fitted on all of them: equal ones are one row with a count, and each
    Newton step sums over these rows in their tasks, so that the driver sees their sums only. A null text counts as empty and has no spans. Repeated rows get equal results. Columns of ``docs`` that clash with new names
    are replaced. Without any candidate there is no classifier and nothing is added.
    """
    new = [*[f"n_{k}" for k in KINDS], "base_sha256", "spans"]
    others = [c for c in docs.columns if c.lower() not in (text.lower(), *new)]
    body, found = fresh_name(docs, "body"), fresh_name(docs, "found")
    rows = docs.select(*[F.col(f"`{c}`") for c in others], F.col(f"`{text}`").alias(body))
    plain = rows.drop(body).schema
    names = plain.names
    added = rows.sparkSession.createDataFrame(
        [], ", ".join(f"n_{k} long" for k in KINDS) + f", base_sha256 string, spans string, {found} array<struct<{_CANDIDATE}>>"
    ).schema
    arrow = pa.list_(pa.struct([
        ("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()),
        ("votes", pa.list_(pa.int32())), ("features", pa.list_(pa.float64())),
    ]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, body, PIECE):
            texts = texts_of(b, body)
            base = [base_spans(t) for t in texts]
            lists = [joined(x) for x in base]
            new = {f"n_{k}": pa.array([sum(s[0] == k for s in x) for x in base], pa.int64()) for k in KINDS}
            new["base_sha256"] = pa.array([hashlib.sha256(s.encode()).hexdigest() for s in lists], pa.string())
            new["spans"] = pa.array(lists, pa.string())
            new[found] = pa.array([[dict(zip(_KEYS, c)) for c in candidates(t, x)] for t, x in zip(texts, base)], arrow)
            yield extended(b, names, new)

    whole = type(plain)(plain.fields + added.fields)
    scanned = materialised(rows.mapInArrow(scan, whole), "pii")
    each = scanned.select(F.explode(found).alias("c")).select("c.*")
    alike = materialised(each.groupBy("kind", "votes", "features").agg(F.count(F.lit(1)).alias("n")), "pii-alike")
    patterns = alike.groupBy("kind", "votes").agg(F.sum("n").alias("n")).collect()  # at most 3^8 per kind
    if not patterns:
        return scanned.drop(found)
    patterns.sort(key=lambda r: (r.kind, r.votes))
    q, _ = reliabilities([r.kind for r in patterns], np.array([r.votes for r in patterns]), np.array([r.n for r in patterns], float))
    belief = {(r.kind, tuple(r.votes)): p for r, p in zip(patterns, q)}

    def total_slopes(w: np.ndarray) -> np.ndarray:
        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    y = np.array([belief[k, tuple(v)] for k, v in zip(b.column("kind").to_pylist(), b.column("votes").to_pylist())])
                    s = slopes(w, np.array(b.column("features").to_pylist()), y, b.column("n").to_numpy().astype(float))
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(s))), pa.array(s)], names=["place", "s"])

        sums = alike.mapInArrow(part, "place long, s double").groupBy("place").agg(F.sum("s").alias("s")).collect()
        return np.array([r.s for r in sorted(sums, key=lambda r: r.place)])

    width = 3 + len(RANK) + len(patterns[0].votes) - 1
    weights = fit_classifier(total_slopes, width, sum(r.n for r in patterns))

    left = scanned.drop(found, "spans").columns

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans = []
            for text_spans, cs in zip(b.column("spans").to_pylist(), b.column(found).to_pylist()):
                extra = [c for c in cs if not c["base"]]
                if extra:
                    z = np.array([c["features"] for c in extra]) @ weights[:-1] + weights[-1]
                    own = [(c["kind"], c["start"], c["end"]) for c in cs if c["base"]]
                    own += [(c["kind"], c["start"], c["end"]) for c, s in zip(extra, z) if 1 / (1 + np.exp(-s)) >= accept]
                    own = [k for k, _ in groupby(sorted(own, key=lambda s: (s[1], RANK[s[0]], s[2])))]
                    text_spans = joined(own)
                spans.append(text_spans)
            yield extended(b, left, {"spans": pa.array(spans, pa.string())})

    return scanned.mapInArrow(decide, scanned.select(*left, "spans").schema)
