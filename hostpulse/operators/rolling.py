"""Rolling windows in time over sorted rows: what tasks do with their batches.

Sums come from runs of 2^k rows that are merged in pairs, never from differences of running totals, so a large value leaves no
trace in windows that do not hold it.
"""

from __future__ import annotations

from collections.abc import Callable, Collection, Iterator, Sequence

import numpy as np
import pyarrow as pa


def _axis(table: pa.Table, keys: Sequence[str], clock: str, gap: int) -> tuple[np.ndarray, int]:
    """One growing time over all groups, more than ``gap`` apart, and where the last group begins."""
    n = table.num_rows
    turn = np.zeros(n, bool)
    turn[0] = True
    for c in keys:
        code = table.column(c).combine_chunks().dictionary_encode()
        code = code.indices.fill_null(-1).to_numpy(zero_copy_only=False)
        turn[1:] |= code[1:] != code[:-1]
    time = table.column(clock).to_numpy().astype(np.int64)
    first = np.flatnonzero(turn)
    last = np.append(first[1:], n) - 1
    length = time[last] - time[first] + gap + 1
    moved = np.append(0, np.cumsum(length[:-1])) - time[first]
    return time + np.repeat(moved, last - first + 1), int(first[-1])


def _moments(a: tuple, b: tuple) -> tuple:
    """Count, sum and squared deviations of two neighbouring runs as one."""
    (n, s, q), (m, t, r) = a, b
    both = (n > 0) & (m > 0)
    gap = np.where(both, s / np.maximum(n, 1) - t / np.maximum(m, 1), 0.0)
    return n + m, s + t, q + r + np.where(both, gap * gap * (n * m / np.maximum(n + m, 1)), 0.0)


def _windows(x: np.ndarray, known: np.ndarray, low: np.ndarray, high: np.ndarray) -> list[np.ma.MaskedArray]:
    """Mean, std, max and min of the known ones among ``x[low:high]`` of each window."""
    real = x.dtype.kind == "f"
    value = np.where(known, x, 0).astype(float)
    finite = np.isfinite(value)
    run = (known.astype(float), value, np.where(finite, 0.0, np.nan))
    least, most = (-np.inf, np.inf) if real else (np.iinfo(np.int64).min, np.iinfo(np.int64).max)
    top = np.where(known, x, least)
    bottom = np.where(known & ~np.isnan(value), x, most)  # nan is the largest value
    seen = np.concatenate([[0], np.cumsum(known & ~np.isnan(value))])
    total = tuple(np.zeros(len(low)) for _ in run)
    peak, dip = np.full(len(low), least, x.dtype), np.full(len(low), most, x.dtype)
    size, at, step = high - low, low.copy(), 1
    while True:  # a level of runs; each window takes those that its number of rows has a bit for
        now = np.flatnonzero(size & step)
        if len(now):
            place = at[now]
            merged = _moments(tuple(t[now] for t in total), tuple(r[place] for r in run))
            for t, m in zip(total, merged):
                t[now] = m
            peak[now] = np.maximum(peak[now], top[place])
            dip[now] = np.minimum(dip[now], bottom[place])
            at[now] += step
        if not (size >= 2 * step).any():
            break
        run = _moments(tuple(r[:-step] for r in run), tuple(r[step:] for r in run))
        top, bottom = np.maximum(top[:-step], top[step:]), np.minimum(bottom[:-step], bottom[step:])
        step *= 2
    n, s, q = total
    if real:
        dip = np.where((n > 0) & (seen[high] == seen[low]), np.nan, dip)
    equal = (peak == dip) | ((peak != peak) & (dip != dip))
    std = np.where(equal, 0.0, np.sqrt(q / np.maximum(n - 1, 1)))
    return [
        np.ma.MaskedArray(s / np.maximum(n, 1), n < 1), np.ma.MaskedArray(std, n < 2),
        np.ma.MaskedArray(peak, n < 1), np.ma.MaskedArray(dip, n < 1),
    ]


def _column(table: pa.Table, c: str, whole: bool) -> tuple[np.ndarray, np.ndarray]:
    column = table.column(c).combine_chunks().cast(pa.int64() if whole else pa.float64())
    return column.fill_null(0).to_numpy(zero_copy_only=False), column.is_valid().to_numpy(zero_copy_only=False)


def time_windows(
    keys: Sequence[str], clock: str, columns: Sequence[str], seconds: Sequence[int], whole: Collection[str], names: Sequence[str]
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for ``mapInArrow`` over rows sorted by keys and clock. Columns in ``whole`` are integers; ``names`` are those of
    mean, std, max and min by column and length.

    It keeps the rows that later windows reach. The last rows of a batch wait for those of the same time.
    """
    span = max(seconds)

    def made(table: pa.Table, time: np.ndarray, done: int, end: int) -> Iterator[pa.RecordBatch]:
        now = time[done:end]
        high = np.searchsorted(time, now, "right")
        out = []
        low = np.concatenate([np.searchsorted(time, now - s, "right") for s in seconds])
        for c in columns:
            with np.errstate(invalid="ignore", over="ignore"):
                four = _windows(*_column(table, c, c in whole), low, np.tile(high, len(seconds)))
            for i in range(len(seconds)):
                own = slice(i * len(now), (i + 1) * len(now))
                out += [pa.array(a.data[own], mask=np.ma.getmaskarray(a)[own], from_pandas=False) for a in four]
        part = table.slice(done, end - done)
        yield from pa.Table.from_arrays([*part.columns, *out], names=[*table.column_names, *names]).combine_chunks().to_batches()

    def rolled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, done = None, 0  # rows that are still needed, and how many of them have their windows
        for batch in batches:
            if not batch.num_rows:
                continue
            fresh = pa.Table.from_batches([batch])
            kept = fresh if kept is None else pa.concat_tables([kept, fresh])
            time, begin = _axis(kept, keys, clock, span)
            end = int(np.searchsorted(time, time[-1], "left"))
            if end > done:
                yield from made(kept, time, done, end)
                done = end
            first = max(int(np.searchsorted(time, time[-1] - span, "right")), begin)
            kept, done = kept.slice(first).combine_chunks(), done - first
        if kept is not None:
            yield from made(kept, _axis(kept, keys, clock, span)[0], done, kept.num_rows)

    return rolled
