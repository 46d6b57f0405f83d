"""Quality rules: fixed base rules and a calibrated logistic regression on hashed word and character n-grams.

A text's features are, per family (characters in threes and fours, words alone and in pairs), the shares of its n-grams
that fall into each bucket, so its score is the mean weight of its n-grams plus an intercept. All n-grams of the whole text
count, in array operations over batches of texts.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostpulse.llm.common import PIECE, WORD, extended, mixed, pieces, slices, texts_of

#: Buckets of a family, as a power of two.
BITS = 16
FAMILIES = 4
#: Labelled documents the model is fitted on, per class: the smallest by hash. Every fifth of them calibrates.
SAMPLE = 1_000
#: Fixed thresholds on the calibrated probability of good quality: kept from KEEP on, marked ``high`` from HIGH on.
KEEP, HIGH = 0.5, 0.9
MIN_WORDS = 50
#: Characters whose n-grams are counted at a time.
_SLICE = 1 << 18

_WORDS = re.compile(WORD)
_SYMBOLS = str.maketrans("", "", "#*$%&|<>")
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def repeated_words(words: list[str]) -> int:
    """Words inside three-word windows that occur twice or more, first occurrences included."""
    n = len(words)
    if n < 4:
        return 0
    windows = list(zip(words, words[1:], words[2:]))
    count = Counter(windows)
    if len(count) == len(windows):
        return 0
    total, past = 0, 0  # past: end of the words already counted
    for i, w in enumerate(windows):
        if count[w] > 1:
            total += i + 3 - max(i, past)
            past = i + 3
    return total


def base_measures(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = _WORDS.findall(text)
    lines = [x for x in text.split("\n") if _WORDS.search(x)]
    return (
        len(words), sum(map(len, words)), len(text) - len(text.translate(_SYMBOLS)), len(lines) - len(set(lines)),
        repeated_words(words),
    )


def base_failed(n_words: int, word_chars: int, n_symbols: int, n_dup_lines: int, n_repeat_words: int) -> bool:
    return n_words < MIN_WORDS or 100 * n_repeat_words > 50 * n_words


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _BASE, dtype=np.uint64)
    out[:1] = 1
    with np.errstate(over="ignore"):
        return np.cumprod(out)


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and 64-bit hash of every word of a byte array; a word's hash depends on its bytes only."""
    gap = _SPACE[data]
    edge = np.diff(np.concatenate(([True], gap, [True])).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(starts):
        return starts, np.zeros(0, np.uint64)
    # Bytes times powers by place in the word, at most 64 places to a block, so that one small table of powers serves.
    place = np.arange(len(data)) - np.repeat(starts, np.diff(np.append(starts, len(data)))) if starts[0] == 0 else None
    if place is None:
        head = starts[0]
        place = np.concatenate((np.zeros(head, np.int64), np.arange(head, len(data)) - np.repeat(starts, np.diff(np.append(starts, len(data))))))
    powers = _powers(int((ends - starts).max()) + 1)
    with np.errstate(over="ignore"):
        terms = (data.astype(np.uint64) + np.uint64(1)) * powers[np.minimum(place, len(powers) - 1)]
        terms[gap] = 0
        h = np.add.reduceat(terms, starts)
    return starts, mixed(h)


def grams(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per family the text number and the bucket of every n-gram of ``texts``."""
    raw = [t.encode("utf-8", "replace") for t in texts]
    sizes = np.array([len(r) for r in raw])
    data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    bounds = np.cumsum(sizes + 1)
    shift, out = np.uint64(64 - BITS), []
    wide = data.astype(np.uint64)
    with np.errstate(over="ignore"):
        for n in (3, 4):
            key = np.zeros(max(0, len(wide) - n + 1), np.uint64)
            for k in range(n):
                key = (key << np.uint64(8)) | wide[k : len(wide) - n + 1 + k]
            owner = np.searchsorted(bounds, np.arange(len(key)), side="right")
            inside = np.arange(len(key)) + n <= (bounds - 1)[np.minimum(owner, len(bounds) - 1)]
            out.append((owner[inside], ((key * _BASE) >> shift)[inside].astype(np.int64)))
        starts, h = word_hashes(data)
        owner = np.searchsorted(bounds, starts, side="right")
        out.append((owner, (h >> shift).astype(np.int64)))
        same = owner[1:] == owner[:-1]
        pair = mixed(h[:-1] * np.uint64(3) + h[1:])
        out.append((owner[1:][same], (pair >> shift).astype(np.int64)[same]))
    return out


@dataclass
class Model:
    """Weights per family and bucket, and the calibration: P(good) = sigmoid(slope * score + offset)."""

    weights: np.ndarray
    slope: float
    offset: float

    def scores(self, texts: list[str]) -> np.ndarray:
        out = np.zeros(len(texts))
        for w, (owner, bucket) in zip(self.weights, grams(texts)):
            total = np.bincount(owner, weights=w[bucket], minlength=len(texts))
            out += total / np.maximum(1, np.bincount(owner, minlength=len(texts)))
        return out

    def probabilities(self, texts: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.scores(texts) + self.offset, -30, 30)))


def fit(texts: list[str], good: np.ndarray, weight: np.ndarray, rounds: int = 120, rate: float = 2.0, l2: float = 1e-6) -> Model:
    """Logistic regression by Adam on four fifths of the rows, calibrated by Platt's method on the last fifth.

    ``weight`` makes up for classes that were sampled at different rates.
    """
    n = len(texts)
    rows, cols, vals = [], [], []
    for a, b in slices([len(t) for t in texts], _SLICE):
        for f, (owner, bucket) in enumerate(grams(texts[a:b])):
            key, count = np.unique(owner * (1 << BITS) + bucket, return_counts=True)
            own = key >> BITS
            rows.append((own + a).astype(np.int32))
            cols.append(((key & ((1 << BITS) - 1)) + (f << BITS)).astype(np.int32))
            vals.append((count / np.bincount(owner, minlength=b - a)[own]).astype(np.float32))
    rows, cols, vals = np.concatenate(rows), np.concatenate(cols), np.concatenate(vals)
    test = np.arange(n) % 5 == 4
    if not 0 < good[test].sum() < test.sum() or not 0 < good[~test].sum() < (~test).sum():
        test = np.zeros(n, bool)
    w = np.zeros(FAMILIES << BITS)
    m, v, b, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0, 0.0
    share = np.where(test, 0.0, weight)
    share = share / np.where(good > 0, share[good > 0].sum(), share[good == 0].sum()) / 2  # both classes count alike
    for step in range(1, rounds + 1):
        z = np.bincount(rows, weights=vals * w[cols], minlength=n) + b
        d = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - good) * share
        g, gb = np.bincount(cols, weights=vals * d[rows], minlength=len(w)) + l2 * w, d.sum()
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        fix = np.sqrt(1 - 0.99**step) / (1 - 0.9**step)
        w -= rate * fix * m / (np.sqrt(v) + 1e-9)
        b -= rate * fix * mb / (np.sqrt(vb) + 1e-9)
    z = np.bincount(rows, weights=vals * w[cols], minlength=n) + b
    held = test if test.any() else np.ones(n, bool)
    slope, offset = platt(z[held], good[held], weight[held])
    return Model(w.reshape(FAMILIES, -1).astype(np.float32), slope, offset + slope * b)


def platt(z: np.ndarray, good: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the sigmoid that fits the classes best, by Newton steps; the slope is never negative."""
    scale = max(1e-9, float(np.abs(z).mean()))
    x = np.stack([z / scale, np.ones_like(z)], 1)
    p = np.zeros(2)
    up, down = (weight * good).sum(), (weight * (1 - good)).sum()
    target = np.where(good > 0, (up + 1) / (up + 2), 1 / (down + 2))
    for _ in range(100):
        q = 1 / (1 + np.exp(-np.clip(x @ p, -30, 30)))
        g = x.T @ (weight * (q - target)) / weight.sum() + 1e-4 * p
        h = (x * (weight * q * (1 - q))[:, None]).T @ x / weight.sum() + 1e-4 * np.eye(2)
        step = np.linalg.solve(h, g)
        p -= step
        if np.abs(step).max() < 1e-9:
            break
    return max(0.0, float(p[0])) / scale, float(p[1])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    """Fit on at most ``sample`` labelled documents per class that pass the base rules; None unless both classes occur.

    A document labelled more than once is good only if all its labels are; null ids and qualities are ignored. The
    chosen ids are few, so they are sent to the documents instead of the other way round. Of documents that share an id
    the smallest text counts.
    """
    spark = docs.sparkSession
    once = (
        labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id")
        .agg(F.min(F.when(F.col("quality") > 0, 1).otherwise(0)).alias("good"))
    )
    sizes = {r.good: r.n for r in once.groupBy("good").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2:
        return None
    chosen = [
        (r.doc_id, r.good)
        for c in (0, 1)
        for r in once.filter(F.col("good") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).collect()
    ]
    ids = spark.createDataFrame(chosen, "doc_id long, good int")  # at most twice ``sample`` rows
    found = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(
        F.first("good").alias("good"), F.min(F.coalesce("text", F.lit(""))).alias("text")
    )

    def fit_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = list(batches)
        if not parts:
            return
        all_rows = pd.concat(parts).sort_values("doc_id", key=lambda s: mixed(s.to_numpy().astype(np.uint64)))
        good = all_rows["good"].to_numpy().astype(float)
        rate = np.where(good > 0, sizes[1] / max(1.0, good.sum()), sizes[0] / max(1.0, (1 - good).sum()))
        # The model judges what passes the base rules only, so it learns from that.
        passed = np.array([not base_failed(*base_measures(t)) for t in all_rows["text"]], bool)
        all_rows, good, rate = all_rows[passed], good[passed], rate[passed]
        if not 0 < good.sum() < len(good):
            return
        m = fit(list(all_rows["text"]), good, rate * len(good) / rate.sum())
        yield pd.DataFrame({"weights": [m.weights.tobytes()], "slope": [m.slope], "offset": [m.offset]})

    got = found.coalesce(1).mapInPandas(fit_all, "weights binary, slope double, offset double").collect()
    if not got:
        return None
    return Model(np.frombuffer(got[0].weights, np.float32).reshape(FAMILIES, -1), got[0].slope, got[0].offset)


def apply_rules(docs: DataFrame, model: Model | None, text: str = "text", keep: float = KEEP, high: float = HIGH) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, p_good and band.

    A null text has no words and fails the base rules, as does one of under 50 words or with over half of its words in
    repeated three-word windows. Others are kept if the calibrated probability reaches ``keep``; without a model the base
    rules alone decide and p_good is null. ``band`` is ``high``, ``fair`` or ``low``. Repeated rows get equal verdicts.
    Columns of ``docs`` that clash with new names are replaced; all others, the text too, stay as they are.
    """
    new = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_good", "band"]
    rows = docs.drop(*[c for c in docs.columns if c.lower() in new])
    names = rows.columns
    spark = docs.sparkSession
    # A fixed 1 MB. Plain values, as tasks that read them may not have this package.
    sent = spark.sparkContext.broadcast(None if model is None else (model.weights, model.slope, model.offset))
    added = spark.createDataFrame(
        [], "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
        "kept boolean, p_good double, band string"
    ).schema

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = None if sent.value is None else Model(*sent.value)
        for b in pieces(batches, text, PIECE):
            texts = texts_of(b, text)
            measures = np.array([base_measures(t) for t in texts], dtype="int64").reshape(-1, 5)
            failed = np.array([base_failed(*x) for x in measures.tolist()], bool)
            p = np.full(len(texts), np.nan)
            if m is not None:
                for i, j in slices([len(t) for t in texts], _SLICE):
                    p[i:j] = m.probabilities(texts[i:j])
            cols = {c: pa.array(measures[:, k]) for k, c in enumerate(new[:5])}
            cols["base_failed"] = pa.array(failed)
            cols["kept"] = pa.array(~failed & ((p >= keep) if m is not None else True))
            cols["p_good"] = pa.array(p, from_pandas=True)
            cols["band"] = pa.array(np.where(failed | (p < keep), "low", np.where(p >= high, "high", "fair")).tolist(), pa.string())
            yield extended(b, names, cols)

    return rows.mapInArrow(judge, type(added)(rows.schema.fields + added.fields))
