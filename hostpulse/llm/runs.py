"""Periodic runs of words, found on a grammar-compressed text.

A run of period q repeats each of its words q places on. So each stretch of half the least length of a run comes again in it, and
words in no stretch that comes again are in no run: they are cut away, which leaves segments, and this is repeated within the
segments. The word ids of the segments of a batch are then compressed by Re-Pair: in each round, every pair that is the most frequent of the
pairs it overlaps is replaced by a nonterminal. What is left of a segment at the end is paired up evenly. Each nonterminal is a place
where two parts meet; the runs across it are found once, from the words that equal the last before it or the first after it, which give the
possible periods, and by doubling steps over prefix hashes. They hold wherever the nonterminal is derived, and the intervals of one
period that overlap by a period are one maximal run.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostpulse.llm.common import PIECE, fresh_name, mixed, pieces, slices, texts_of

#: Words of the shortest run.
LEAST = 12
#: Primes and bases of the prefix hashes; both must agree.
_HASHES = ((2_147_483_647, 1_367_130_551), (2_147_483_629, 914_583_107))
#: Words below nonterminals that are looked at together.
_WINDOWS = 1 << 20


def expanded(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For counts c0, c1, ...: the owner of each of their sum of places, and the place's number within the owner."""
    owner = np.repeat(np.arange(len(counts)), counts)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)


def repeated(ids: np.ndarray, segment: np.ndarray, size: int) -> np.ndarray:
    """Whether each word is in a stretch of ``size`` words that comes twice or more in its segment."""
    n = len(ids) - size + 1
    if n < 2:
        return np.zeros(len(ids), bool)
    with np.errstate(over="ignore"):
        key = segment[:n].astype(np.uint64)
        for k in range(size):
            key = key * np.uint64(0x9E3779B97F4A7C15) + mixed(ids[k : k + n].astype(np.uint64) + np.uint64(1))
    at = np.flatnonzero(segment[:n] == segment[size - 1 :])
    at = at[np.argsort(key[at])]
    same = key[at[1:]] == key[at[:-1]]
    again = np.zeros(len(at), bool)
    again[1:] |= same
    again[:-1] |= same
    edge = np.zeros(len(ids) + 1, np.int64)
    np.add.at(edge, at[again], 1)
    np.add.at(edge, at[again] + size, -1)
    return np.cumsum(edge[:-1]) > 0


def segments(ids: np.ndarray, text: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """Places of the words that may be in a run, and the number of the segment each is in. Runs lie within segments."""
    where, segment = np.arange(len(ids)), text
    while len(where):
        alive = repeated(ids[where], segment, (least + 1) // 2)
        if alive.all():
            break
        kept, old = where[alive], segment[alive]
        fresh = np.append(True, (np.diff(kept) != 1) | (np.diff(old) != 0))[: len(kept)]
        number = np.cumsum(fresh) - 1
        long_enough = np.bincount(number, minlength=1)[number] >= least if len(kept) else np.zeros(0, bool)
        where, segment = kept[long_enough], number[long_enough]
    return where, segment


def _chosen(priority: np.ndarray) -> np.ndarray:
    """Places whose pair comes before both it overlaps; every second of pairs that overlap their like. Negative: no pair."""
    fresh = np.append(True, np.diff(priority) != 0)
    number = np.cumsum(fresh) - 1
    first = np.flatnonzero(fresh)
    value = priority[first]
    best = (value >= 0) & (value > np.append(-1, value[:-1])) & (value > np.append(value[1:], -1))
    return np.flatnonzero(best[number] & ((np.arange(len(priority)) - first[number]) % 2 == 0))


def nonterminals(ids: np.ndarray, segment: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The grammar as (start, middle, end) of one place of each nonterminal of at least ``least`` words, and all places where
    they are derived: number of the nonterminal, start."""
    symbol, start = ids.copy(), np.arange(len(ids))
    size = np.ones(len(ids), np.int64)
    nodes, owners, places = [np.zeros((0, 3), np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    names, made = int(ids.max()) + 1 if len(ids) else 0, 0

    def add(at: np.ndarray, number: np.ndarray, total: int) -> None:
        """Note the pairs at ``at``, of the new nonterminals 0 to ``total`` by ``number``."""
        nonlocal made
        one = np.zeros(total, np.int64)
        one[number] = at
        node = np.stack([start[one], start[one + 1], start[one + 1] + size[one + 1]], 1)
        large = node[:, 2] - node[:, 0] >= least
        renamed = np.cumsum(large) - 1 + made
        nodes.append(node[large])
        owners.append(renamed[number[large[number]]])
        places.append(start[at[large[number]]])
        made += int(large.sum())

    while len(symbol) > 1:
        pair = segment[1:] == segment[:-1]
        at = np.flatnonzero(pair)
        code = symbol[at] * names + symbol[at + 1]
        kinds, kind, count = np.unique(code, return_inverse=True, return_counts=True)
        rank = np.empty(len(kinds), np.int64)
        rank[np.lexsort((mixed(kinds.astype(np.uint64)), count))] = np.arange(len(kinds))
        priority = np.full(len(pair), -1)
        priority[at] = np.where(count[kind] > 1, rank[kind], -1)
        best = _chosen(priority)
        if not len(best):
            break
        _, number = np.unique(priority[best], return_inverse=True)
        total = int(number.max()) + 1
        add(best, number, total)
        symbol[best] = names + number
        size[best] += size[best + 1]
        names += total
        stay = np.ones(len(symbol), bool)
        stay[best + 1] = False
        symbol, start, size, segment = symbol[stay], start[stay], size[stay], segment[stay]
    while len(segment) > 1:  # what is left of each segment: neighbours two by two
        _, place = expanded(np.bincount(segment)[np.unique(segment)])
        best = np.flatnonzero((segment[1:] == segment[:-1]) & (place[:-1] % 2 == 0))
        if not len(best):
            break
        add(best, np.arange(len(best)), len(best))
        size[best] += size[best + 1]
        stay = np.ones(len(segment), bool)
        stay[best + 1] = False
        start, size, segment = start[stay], size[stay], segment[stay]
    return np.concatenate(nodes), np.concatenate(owners), np.concatenate(places)


class Stretches:
    """Equality of stretches of words by prefix hashes."""

    def __init__(self, ids: np.ndarray):
        self.sums, self.powers = [], []
        for prime, base in _HASHES:
            power = np.ones(len(ids) + 1, np.uint64)
            done = 1
            while done < len(power):  # powers by doubling
                step = np.uint64(pow(base, done, prime))
                more = power[: len(power) - done][:done]
                power[done : done + len(more)] = more * step % np.uint64(prime)
                done *= 2
            word = mixed(ids.astype(np.uint64) + np.uint64(1)) % np.uint64(prime)
            total = np.cumsum(word * power[:-1] % np.uint64(prime), dtype=np.uint64) % np.uint64(prime)
            self.sums.append(np.append(np.uint64(0), total))
            self.powers.append(power)

    def equal(self, x: np.ndarray, shift: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether the ``size`` words from ``x`` on equal those ``shift`` places further on."""
        out = np.ones(len(x), bool)
        for (prime, _), sums, powers in zip(_HASHES, self.sums, self.powers):
            p = np.uint64(prime)
            one = (sums[x + size] + p - sums[x]) % p * powers[shift] % p
            out &= one == (sums[x + shift + size] + p - sums[x + shift]) % p
        return out

    def reach(self, x: np.ndarray, shift: np.ndarray, most: np.ndarray, back: bool) -> np.ndarray:
        """How many words, at most ``most``, equal those ``shift`` places on, from ``x`` on, or before ``x`` with ``back``."""
        low = np.zeros(len(x), np.int64)
        step = 1 << max(0, int(most.max(initial=0)).bit_length() - 1)
        while step:
            new = low + step
            fits = np.flatnonzero(new <= most)
            if len(fits):
                begin = x[fits] - new[fits] if back else x[fits]
                good = fits[self.equal(begin, shift[fits], new[fits])]
                low[good] = new[good]
            step >>= 1
        return low


def crossing(ids: np.ndarray, stretches: Stretches, nodes: np.ndarray, least: int = LEAST) -> np.ndarray:
    """Runs across the middle of each node within the node: rows of (node, start, end, smallest period)."""
    found = [np.zeros((0, 4), np.int64)]
    for a, b in slices((nodes[:, 2] - nodes[:, 0]).tolist(), _WINDOWS):
        low, mid, high = nodes[a:b].T
        half = (high - low) // 2
        for right in (True, False):
            # A run holds a period's length of words on one side at least: a word there equals the one across the middle.
            owner, place = expanded(np.minimum(half, high - mid if right else mid - low))
            period = place + 1
            pivot = (mid - 1)[owner] if right else mid[owner] - period
            same = ids[pivot] == ids[pivot + period]
            owner, period, pivot = owner[same], period[same], pivot[same]
            start = pivot - stretches.reach(pivot, period, pivot - low[owner], back=True)
            end = pivot + period + stretches.reach(pivot, period, high[owner] - pivot - period, back=False)
            good = end - start >= np.maximum(least, 2 * period)
            found.append(np.stack([owner[good] + a, start[good], end[good], period[good]], 1))
    rows = np.concatenate(found)
    rows = rows[np.lexsort((rows[:, 3], rows[:, 2], rows[:, 1], rows[:, 0]))]
    # Other periods of the same stretch are multiples of the smallest.
    return rows[np.append(True, (np.diff(rows[:, :3], axis=0) != 0).any(1))[: len(rows)]]


def merged(start: np.ndarray, end: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of intervals: those of a period that overlap by a period are one."""
    if not len(start):
        return start, end, period
    order = np.lexsort((start, period))
    start, end, period = start[order], end[order], period[order]
    reach = np.maximum.accumulate(end + period * (int(end.max()) + 1)) - period * (int(end.max()) + 1)  # within the period
    fresh = np.append(True, (np.diff(period) != 0) | (start[1:] + period[1:] > reach[:-1]))
    first = np.flatnonzero(fresh)
    return start[first], np.maximum.reduceat(end, first), period[first]


def runs(ids: np.ndarray, text: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and smallest period of all maximal runs of ``ids`` of at least ``least`` words and two periods.

    ``text`` numbers the texts, one after another; a run lies within one. In order of start, then period.
    """
    where, segment = segments(ids, text, least)
    if not len(where):
        return tuple(np.zeros(0, np.int64) for _ in range(3))
    _, own = np.unique(ids[where], return_inverse=True)
    nodes, owner, place = nonterminals(own, segment, least)
    across = crossing(own, Stretches(own), nodes, least)
    # Each run of a nonterminal at each place where it is derived.
    count = np.bincount(across[:, 0], minlength=len(nodes))
    which, k = expanded(count[owner])
    row = across[(np.cumsum(count) - count)[owner[which]] + k]
    shift = place[which] - nodes[row[:, 0], 0]
    start, end, period = merged(row[:, 1] + shift, row[:, 2] + shift, row[:, 3])
    order = np.lexsort((period, start))
    return where[start[order]], (end - start)[order], period[order]


def periodic_runs(
    docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST,
    edit: Callable[[int | None, list[bytes]], list[bytes]] | None = None,
) -> DataFrame:
    """``docs`` without its text, with n_words, runs (start, length, period; by start, then period) and collapsed.

    Words are runs without white space; starts are word numbers from 0. A run is a stretch of at least ``least`` words and two
    of its smallest periods that cannot be longer. ``collapsed`` joins by one space the words that no run holds after its first
    period. Null and empty texts have no words and no runs. Repeated rows come out alike. Columns of ``docs`` that clash with
    the new names are replaced, all others stay. An empty table gives an empty result. ``edit`` may change a row's words, given its
    integer ``key``, before they are looked at.
    """
    new = {"n_words": "long", "runs": "array<struct<start:bigint,length:bigint,period:bigint>>", "collapsed": "string"}
    others = [c for c in docs.columns if c.lower() not in {text.lower(), *new}]
    id_, body = fresh_name(docs, "run_key"), fresh_name(docs, "run_body")
    rows = docs.select(
        *[F.col(f"`{c}`") for c in others], F.col(f"`{key}`").cast("long").alias(id_), F.col(f"`{text}`").alias(body)
    )

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, body, PIECE):
            words = [t.encode("utf-8", "surrogatepass").split() for t in texts_of(b, body)]  # of bytes: at the white space of ASCII
            if edit is not None:
                words = [edit(k, w) for k, w in zip(b.column(id_).to_pylist(), words)]
            known: dict[bytes, int] = {}
            sizes = np.array([len(w) for w in words], np.int64)
            ids = np.fromiter((known.setdefault(x, len(known)) for w in words for x in w), np.int64, int(sizes.sum()))
            owner, _ = expanded(sizes)
            start, length, period = runs(ids, owner, least)
            edge = np.zeros(len(ids) + 1, np.int64)
            np.add.at(edge, start + period, 1)
            np.add.at(edge, start + length, -1)
            stay = (np.cumsum(edge[:-1]) == 0).tolist()
            first = np.cumsum(sizes) - sizes
            collapsed = [
                b" ".join([x for x, k in zip(w, stay[a : a + len(w)]) if k]).decode("utf-8", "surrogatepass") for a, w in zip(first.tolist(), words)
            ]
            own = owner[start] if len(start) else start
            lists = pa.ListArray.from_arrays(
                np.append(0, np.cumsum(np.bincount(own, minlength=len(words)))).astype(np.int32),
                pa.StructArray.from_arrays([pa.array(start - first[own]), pa.array(length), pa.array(period)], names=["start", "length", "period"]),
            )
            columns = [pa.array(sizes), lists, pa.array(collapsed, pa.string())]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in others], *columns], names=[*others, *new])

    kept = rows.drop(id_, body).withColumns({c: F.lit(None).cast(kind) for c, kind in new.items()}).schema
    return rows.mapInArrow(find, kept)
