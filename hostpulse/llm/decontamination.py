"""Benchmark decontamination by the q-gram lemma.

Passages of WINDOW characters of benchmark items are looked for, wherever in the item they begin. A passage of m characters that
occurs in a text with at most e edits shares at least m - q + 1 - q * e of its q-grams with the text, on diagonals (place in
the text less place in the item) at most e apart. Shared q-grams are counted in bands of diagonals that overlap by half, so
that each occurrence lies whole in one; passages that reach the bound are verified by a banded alignment of the windows in
them. Windows have WINDOW - STEP + 1 characters and begin every STEP characters of the item, so that each passage holds a
whole one, which may have as many edits as the passage. Short items are searched for as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostpulse.llm.common import PIECE, mixed, pieces, slices, texts_of

#: Length of the passages looked for, step of windows, length of a q-gram, and edits a passage may have per character.
WINDOW, STEP, Q, RATE = 100, 10, 8, 0.1
#: Items under so many characters are too short for edits: they are found verbatim, on word borders.
LEAST = 32
#: Characters of benchmark items that one pass over the documents looks for.
BLOCK_CHARS = 16 << 20
_GAP = 0x110000  # no character
_BITS = 22
_SLICE = 2 << 20
_FACTOR = 0x9E3779B97F4A7C15


def normalised(text: str) -> str:
    """Lower case, runs of white space as one blank."""
    return " ".join(text.split()).lower()


def places(text: str) -> list[int]:
    """For every character of the normalised text, and its end, the place in ``text`` it comes from."""
    out, last, any_word = [], 0, False
    blank = False
    for i, c in enumerate(text):
        if c.isspace():
            blank = any_word
            continue
        if blank:
            out.append(last)
        out.extend([i] * len(c.lower()))
        last, any_word, blank = i + 1, True, False
    return [*out, last]


def qgrams(codes: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit hash of the q characters from each place on."""
    n = max(0, len(codes) - q + 1)
    done, have, power, step = np.zeros(n, np.uint64), 0, codes.astype(np.uint64), 1
    factor = _FACTOR
    with np.errstate(over="ignore"):
        while True:  # blocks of 1, 2, 4 ... characters make up q
            if q & step:
                done = done * np.uint64(pow(factor, 1, 1 << 64)) + power[have : have + n]
                have += step
            step *= 2
            if step > q:
                break
            power = power[: len(power) - step // 2] * np.uint64(factor) + power[step // 2 :]
            factor = factor * factor % (1 << 64)
    return mixed(done)


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


@dataclass
class Index:
    """Windows of benchmark items and where their q-grams are."""

    texts: list[str]
    items: list[int]
    edits: np.ndarray
    #: Per window: its start in the item. Per item: length, the length and edits of its passages and their bound, the length of its
    #: windows, and its first window.
    starts: np.ndarray
    lengths: np.ndarray
    passage: np.ndarray
    budget: np.ndarray
    bound: np.ndarray
    size: np.ndarray
    windows: np.ndarray
    q: int
    keys: np.ndarray
    first: np.ndarray
    item: np.ndarray
    place: np.ndarray
    seen: np.ndarray
    #: Short items with their number and owners, and by length of a beginning: its hashes in order and the lengths of the items.
    short: dict[str, tuple[int, list[int]]]
    heads: dict[int, tuple[np.ndarray, list[int]]]


def build_index(items: list[tuple[int, str]], window: int = WINDOW, step: int = STEP, q: int = Q, rate: float = RATE) -> Index | None:
    texts, owners, starts, whole, windows, sizes = [], [], [], [], [], []
    short: dict[str, tuple[int, list[int]]] = {}
    size = window - step + 1
    if int(window * rate) > (size - q) // q:
        raise ValueError(f"windows of {size} characters with {int(window * rate)} edits need not hold a whole {q}-gram: take a smaller step")
    for item, text in items:
        t = normalised(text or "")
        if len(t) < LEAST:
            if t:
                short.setdefault(t, (len(short), []))[1].append(item)
            continue
        m = len(t) if len(t) <= window else size
        whole.append(t)
        windows.append(len(texts))
        sizes.append(m)
        for s in sorted({*range(0, len(t) - m + 1, step), len(t) - m}):
            texts.append(t[s : s + m])
            owners.append(item)
            starts.append(s)
    if not texts and not short:
        return None
    heads = {}
    for n in sorted({min(len(t), q) for t in short}):
        own = [t for t in short if min(len(t), q) == n]
        heads[n] = np.unique(np.concatenate([qgrams(codes_of(t[:n]), n) for t in own])), sorted({len(t) for t in own})
    lengths = np.array([len(t) for t in whole], int)
    passage, sizes, windows = np.minimum(lengths, window), np.array(sizes, int), np.array(windows, int)
    budget = np.minimum((passage * rate).astype(int), (sizes - q) // q)
    edits = np.repeat(budget, np.diff(np.append(windows, len(texts))))
    grams = [qgrams(codes_of(t), q) for t in whole]
    h = np.concatenate([np.zeros(0, np.uint64), *grams])
    which = np.repeat(np.arange(len(whole)), [len(g) for g in grams])
    place = np.concatenate([np.zeros(0, np.int64), *[np.arange(len(g)) for g in grams]])
    order = np.argsort(h, kind="stable")
    keys, first = np.unique(h[order], return_index=True)
    seen = np.zeros(1 << _BITS, bool)
    seen[keys >> np.uint64(64 - _BITS)] = True
    return Index(
        texts, owners, edits, np.array(starts, int), lengths, passage, budget, passage - q + 1 - q * budget, sizes, windows, q,
        keys, np.append(first, len(h)), which[order], place[order], seen, short, heads,
    )


@cache
def word_codes() -> np.ndarray:
    """For every code point, and _GAP, whether it is a letter or digit."""
    return np.array([chr(c).isalnum() for c in range(_GAP)] + [False])


def verbatim(index: Index, texts: list[str]) -> Iterator[tuple[int, int, int, list[int]]]:
    """(text, number, start, items) of the short items, where no letter or digit of the item goes on before or after it."""
    if not index.short:
        return
    gap = np.array([_GAP], np.uint32)
    data = np.concatenate([gap] + [x for t in texts for x in (codes_of(t), gap)])
    starts = np.cumsum([1] + [len(t) + 1 for t in texts])[:-1]
    word = word_codes()[data]
    inside = np.concatenate((word[1:] & word[:-1], [False]))  # no border between a place and the next
    for n, (keys, lengths) in index.heads.items():
        h = qgrams(data, n)
        at = np.flatnonzero(keys[np.minimum(np.searchsorted(keys, h), len(keys) - 1)] == h)
        at = at[(at > 0) & ~inside[at - 1]]
        for a, o in zip(at.tolist(), (np.searchsorted(starts, at, side="right") - 1).tolist()):
            start = a - int(starts[o])
            for m in lengths:
                if start + m <= len(texts[o]) and not inside[a + m - 1]:
                    told = index.short.get(texts[o][start : start + m])
                    if told is not None:
                        yield o, told[0], start, told[1]


def counted(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order and how often each occurs, by sorting."""
    values = np.sort(values)
    edge = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1]))) if len(values) else np.zeros(0, np.int64)
    return values[edge], np.diff(np.append(edge, len(values)))


def candidates(index: Index, texts: list[str]) -> Iterator[tuple[int, int, int]]:
    """(text, window, first diagonal) of the windows in every passage that shares enough q-grams within a band."""
    if not index.texts:
        return
    codes = [codes_of(t) for t in texts]
    gap = np.array([_GAP], np.uint32)
    data = np.concatenate([x for c in codes for x in (c, gap)])
    starts = np.cumsum([0] + [len(c) + 1 for c in codes])[:-1]
    h = qgrams(data, index.q)
    at = np.flatnonzero(index.seen[h >> np.uint64(64 - _BITS)])
    j = np.minimum(np.searchsorted(index.keys, h[at]), len(index.keys) - 1)
    same = index.keys[j] == h[at]
    at, j = at[same], j[same]
    owner = np.searchsorted(starts, at, side="right") - 1
    enough = np.bincount(owner, minlength=len(texts)) >= index.bound.min()
    at, j, owner = at[enough[owner]], j[enough[owner]], owner[enough[owner]]
    if not len(at):
        return
    many = index.first[j + 1] - index.first[j]
    total = int(many.sum())
    entry = np.arange(total) - np.repeat(np.cumsum(many) - many, many) + np.repeat(index.first[j], many)
    it, own = index.item[entry], np.repeat(owner, many)
    # A (text, item) pair with too few shared q-grams in all has no passage with enough.
    code = own * len(index.lengths) + it
    pair, count = counted(code)
    pair = pair[count >= index.bound[pair % len(index.lengths)]]
    if not len(pair):
        return
    inverse = np.minimum(np.searchsorted(pair, code), len(pair) - 1)
    live = pair[inverse] == code
    it, entry, inverse = it[live], entry[live], inverse[live]
    place = index.place[entry]
    band = (np.repeat(at - starts[owner], many)[live] - place) // np.maximum(1, index.budget[it])
    # Every band of diagonals overlaps the next by half; a place of the item counts once in each.
    least, most, places_ = int(band.min()) - 1, int(band.max()) + 1, int(index.place.max()) + 1
    spot = inverse * (most - least + 1) - least
    keys, _ = counted(np.concatenate((spot + band, spot + band - 1)) * places_ + np.concatenate((place, place)))
    group, place = keys // places_, keys % places_
    it = pair[group // (most - least + 1)] % len(index.lengths)
    # A passage with enough holds a place and, as many places on as the bound says, another one near enough.
    here = np.arange(len(keys))
    far = here + index.bound[it] - 1
    here, far = here[far < len(keys)], far[far < len(keys)]
    near = (group[here] == group[far]) & (place[far] - place[here] <= index.passage[it[here]] - index.q)
    here, far = here[near], far[near]
    if not len(here):
        return
    group, it = group[here], it[here]
    low = np.maximum(0, place[far] + index.q - index.passage[it])
    high = np.minimum(index.lengths[it], place[here] + index.passage[it]) - index.size[it]
    wide = int(index.lengths.max()) + 1
    of_window = np.searchsorted(index.windows, np.arange(len(index.texts)), side="right") - 1
    spots = of_window * wide + index.starts
    a, b = np.searchsorted(spots, it * wide + low), np.searchsorted(spots, it * wide + high, side="right")
    many = np.maximum(0, b - a)
    win = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many) + np.repeat(a, many)
    told, _ = counted(np.repeat(group, many) * len(index.texts) + win)
    group, win = told // len(index.texts), told % len(index.texts)
    own, band = pair[group // (most - least + 1)] // len(index.lengths), group % (most - least + 1) + least
    for o, w, d in zip(own.tolist(), win.tolist(), (band * np.maximum(1, index.edits[win]) + index.starts[win]).tolist()):
        yield o, w, d


def align_band(patterns: np.ndarray, regions: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(edits, start, end) of the best occurrence of each pattern on the diagonals of its region.

    Patterns are rows of m codes; the region of a pattern on w diagonals has m + w - 1 codes, and a cell of the alignment
    lies at (row, diagonal). An occurrence may start and end on any of the diagonals.
    """
    k, m = patterns.shape
    w = regions.shape[1] - m + 1
    steps = np.arange(w, dtype=np.int32)
    cost, start = np.zeros((k, w), np.int32), np.tile(steps, (k, 1))
    for i in range(m):
        best, origin = cost + (regions[:, i : i + w] != patterns[:, i : i + 1]), start
        if w > 1:  # a character of the pattern left out: one diagonal down
            skip = cost[:, 1:] + 1 < best[:, :-1]
            best[:, :-1] = np.where(skip, cost[:, 1:] + 1, best[:, :-1])
            origin = origin.copy()
            origin[:, :-1] = np.where(skip, start[:, 1:], start[:, :-1])
        # Characters of the text left over: the least of best[d] + (c - d) over d <= c.
        run = np.minimum.accumulate(best - steps, axis=1)
        source = np.maximum.accumulate(np.where(best - steps == run, steps, 0), axis=1)
        cost, start = run + steps, np.take_along_axis(origin, source, axis=1)
    end = cost.argmin(1)
    rows = np.arange(k)
    return cost[rows, end], start[rows, end], end + m


def align(pattern: str, region: str, limit: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the best occurrence of the pattern anywhere in the region, None if over ``limit`` edits."""
    p, r = codes_of(pattern), codes_of(region)
    wide = np.full(2 * len(p) + len(r), _GAP, np.uint32)
    wide[len(p) : len(p) + len(r)] = r
    edits, start, end = (int(x[0]) for x in align_band(p[None, :], wide[None, :]))
    start, end = (min(max(0, x - len(p)), len(r)) for x in (start, end))
    return (edits, start, max(start, end)) if edits <= limit else None


def verified(index: Index, texts: list[str], found: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, int, int, int]]:
    """(text, window, start, end, edits) of the candidates that hold their window within its budget.

    A verbatim occurrence needs no alignment; the others of one shape are aligned together.
    """
    shapes: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
    for o, w, first in found:
        pattern, e = index.texts[w], int(index.edits[w])
        lo = first - e
        at = texts[o].find(pattern, max(0, lo), max(0, lo) + 5 * e + 1 + len(pattern))
        if at >= 0:
            yield o, w, at, at + len(pattern), 0
        else:
            shapes.setdefault((len(pattern), e), []).append((o, w, lo))
    for (m, e), rows in shapes.items():
        for i in range(0, len(rows), 2_048):
            part = rows[i : i + 2_048]
            regions = np.full((len(part), m + 4 * e), _GAP, np.uint32)
            for k, (o, _, lo) in enumerate(part):
                text = codes_of(texts[o][max(0, lo) : max(0, lo + m + 4 * e)])
                regions[k, max(0, -lo) : max(0, -lo) + len(text)] = text
            patterns = np.stack([codes_of(index.texts[w]) for _, w, _ in part])
            for (o, w, lo), edits, start, end in zip(part, *(x.tolist() for x in align_band(patterns, regions))):
                if edits <= e:
                    start = min(max(0, lo + start), len(texts[o]))
                    yield o, w, start, max(start, min(lo + end, len(texts[o]))), edits


def leaks_in(index: Index, texts: list[str]) -> Iterator[tuple[int, int, int, int, int, int]]:
    """(text, item, start, end, windows, edits) of each region that holds verified windows; places in the normalised text."""
    hits: dict[tuple[int, int], set[tuple[int, int, int, int]]] = {}
    for a, b in slices([len(t) for t in texts], _SLICE):
        for o, w, start, end, edits in verified(index, texts[a:b], list(candidates(index, texts[a:b]))):
            hits.setdefault((a + o, index.items[w]), set()).add((start, end, w, edits))
        length = {number: len(t) for t, (number, _) in index.short.items()}
        for o, number, start, items in verbatim(index, texts[a:b]):
            for item in items:
                hits.setdefault((a + o, item), set()).add((start, start + length[number], len(index.texts) + number, 0))
    for (o, item), spans in sorted(hits.items()):
        start = end = None
        windows, most = set(), 0
        for s, t, w, e in sorted(spans):
            if end is not None and s > end:
                yield o, item, start, end, len(windows), most
                start, end, windows, most = None, None, set(), 0
            start, end = (s, t) if start is None else (start, max(end, t))
            windows.add(w)
            most = max(most, e)
        yield o, item, start, end, len(windows), most


def indexes(docs: DataFrame, benchmark: DataFrame, window: int, step: int, q: int, rate: float, block_chars: int) -> Iterator:
    """The index of each block of benchmark items, sent to the tasks."""
    spark = docs.sparkSession
    items = benchmark.filter("item_id IS NOT NULL AND text IS NOT NULL").select("item_id", "text")
    chars = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    overlap = max(2, -(-window // step))  # windows that a character of an item lies in
    blocks = max(1, -(-int(chars) // max(1, block_chars // overlap)))
    for k in range(blocks):
        part = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect()  # the windows have about block_chars
        index = build_index([(r.item_id, r.text) for r in part], window, step, q, rate)
        if index is not None:
            yield spark.sparkContext.broadcast(vars(index))  # plain values, as tasks that read them may not have this package


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, step: int = STEP, q: int = Q, rate: float = RATE,
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """doc_id, item_id, start, end, windows, edits: regions of documents that hold windows of benchmark items.

    Each passage of ``window`` characters of an item (the whole item where it is shorter), at whatever place of the item it begins, is
    found wherever it occurs with at most ``rate`` edits per character, after lower-casing and joining of white space; a region that is
    found holds ``window - step + 1`` characters of the item with at most the edits of a passage. Items under LEAST characters are
    found verbatim where they begin and end on word borders. Places are code points of the text as it is. A null text or item has no characters. Rows that share a doc_id or item_id are searched
    each, and equal result rows come once. Other columns are ignored. Benchmarks over ``block_chars``
    characters are looked for block by block, so an index of bounded size goes to the tasks whatever the benchmark's size.
    """
    spark = docs.sparkSession
    result = "doc_id long, item_id long, start long, end long, windows int, edits int"
    found = spark.createDataFrame([], result)
    names = found.columns
    kinds = [pa.int64()] * 4 + [pa.int32()] * 2
    for sent in indexes(docs, benchmark, window, step, q, rate, block_chars):

        def search(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for b in pieces(batches, "text", PIECE):
                texts, ids = texts_of(b), b.column("doc_id").to_pylist()
                rows: list[list] = [[] for _ in names]
                where: dict[int, list[int]] = {}
                for o, item, start, end, windows, edits in leaks_in(Index(**sent.value), [normalised(t) for t in texts]):
                    at = where.setdefault(o, where.get(o) or places(texts[o]))
                    for col, v in zip(rows, (ids[o], item, at[start], at[end - 1] + 1, windows, edits)):
                        col.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds)], names=names)

        found = found.unionByName(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(search, result))
    return found.distinct()


def without_leaks(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, step: int = STEP, q: int = Q, rate: float = RATE,
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """The rows of ``docs`` in which ``find_leaks`` finds nothing, all columns as they are."""
    for sent in indexes(docs, benchmark, window, step, q, rate, block_chars):

        def clean(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for b in pieces(batches, "text", PIECE):
                leaked = {o for o, *_ in leaks_in(Index(**sent.value), [normalised(t) for t in texts_of(b)])}
                yield b.filter(pa.array([i not in leaked for i in range(b.num_rows)], pa.bool_()))

        docs = docs.mapInArrow(clean, docs.schema)
    return docs
