"""Removal of long repeated strings between documents by sorting suffixes.

A string of LENGTH bytes counts as repeated if it also starts in a document with a smaller id. Sorting all suffixes of a corpus
would move many times its size, so only suffixes that can have a partner are sorted: every window of LENGTH bytes is
known by the least of the hashes of its GRAM-byte parts, which equal windows share. Parts found in one document only are
dropped; for the rest the windows they stand for are brought together, and their suffixes are put in order by deep-shallow
sorting, after which equal windows lie side by side and are compared in full.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hostpulse.llm.common import mixed, pieces
from hostpulse.llm.common import written as materialised
from hostpulse.llm.deepshallow import sort_strings

LENGTH, GRAM = 50, 16
#: Bytes of text worked on at a time, and bytes of the corpus for each bucket of hashes.
SLICE, BUCKET_BYTES = 2 << 20, 4 << 20
_PIECE = 8 << 20
#: Suffixes that are sorted at a time, and occurrences that are judged at a time.
_SUFFIXES, _OCCURRENCES = 50_000, 20_000
_LAST = (1 << 63) - 1


def window_runs(data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first window, past the last window) of each run of windows that share their least part.

    Of parts with equal hashes in a window the first counts, so equal windows have equal hashes at equal places.
    """
    n = len(data) - length + 1
    if n <= 0:
        e = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), e, e
    with np.errstate(over="ignore"):
        h, factor, have = data.astype(np.uint64) + np.uint64(1), 0x9E3779B97F4A7C15, 1
        while have < gram:  # gram is a power of two
            h = h[: len(h) - have] * np.uint64(factor) + h[have:]
            factor, have = factor * factor % (1 << 64), 2 * have
        h = mixed(h)
    shift = np.uint64(24)
    least = (h >> shift << shift) | np.arange(len(h), dtype=np.uint64)
    width, have = length - gram + 1, 1
    while 2 * have <= width:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if have < width:
        least = np.minimum(least[: n], least[width - have : width - have + n])
    at = (least[:n] & np.uint64((1 << 24) - 1)).astype(np.int64)
    edge = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    # Least hashes are small numbers; hashed again they fall into all buckets alike.
    return mixed(h[at[edge]] ^ np.uint64(0x5851F42D4C957F2D)), edge, np.append(edge[1:], n)


def runs_of(data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """window_runs of a text of any size, piece by piece."""
    if len(data) <= _PIECE:
        return window_runs(data, length, gram)
    parts = []
    for a in range(0, len(data) - length + 1, _PIECE):
        h, x, y = window_runs(data[a : a + _PIECE + length - 1], length, gram)
        parts.append((h, x + a, y + a))
    return tuple(np.concatenate(p) for p in zip(*parts))


def batch_runs(raw: list[bytes], length: int = LENGTH, gram: int = GRAM):
    """Owner, hash, first and past window (within the owner) of all runs of a slice of texts."""
    if sum(map(len, raw)) > _PIECE or len(raw) == 1:
        parts = [runs_of(np.frombuffer(r, np.uint8), length, gram) for r in raw]
        owner = np.repeat(np.arange(len(raw)), [len(p[0]) for p in parts])
        return (owner, *(np.concatenate(x) for x in zip(*parts)))
    data = np.frombuffer(b"".join(raw), np.uint8)
    sizes = np.array([len(r) for r in raw])
    starts = np.cumsum(sizes) - sizes
    h, x, y = window_runs(data, length, gram)
    # Runs are cut at the borders of texts; windows across a border are dropped.
    owner = np.searchsorted(starts, x, side="right") - 1
    last = np.searchsorted(starts, y - 1, side="right") - 1
    cross = np.flatnonzero(owner != last)
    extra = [(o, i) for i in cross.tolist() for o in range(owner[i] + 1, last[i] + 1)]
    owner = np.concatenate((owner, np.array([o for o, _ in extra], np.int64)))
    pick = np.concatenate((np.arange(len(h)), np.array([i for _, i in extra], np.int64)))
    h, x, y = h[pick], np.maximum(x[pick], starts[owner]), np.minimum(y[pick], (starts + sizes - length + 1)[owner])
    live = x < y
    owner, h, x, y = owner[live], h[live], x[live], y[live]
    return owner, h, x - starts[owner], y - starts[owner]


def bucket_bits(total_bytes: int, bucket_bytes: int = BUCKET_BYTES) -> int:
    return max(4, min(31, int(np.ceil(np.log2(max(1, total_bytes / bucket_bytes))))))


def _split(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and the 32 bits after it."""
    return (h >> np.uint64(64 - bits)).astype(np.int64), (h >> np.uint64(32 - bits)).astype(np.uint32)


def _encoded(batch: pa.RecordBatch) -> list[bytes]:
    return [(t or "").encode("utf-8", "surrogatepass") for t in batch.column("text").to_pylist()]


def _batch(**columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        for i in range(0, b.num_rows, 64):  # few at a time: a row may be large
            yield from b.slice(i, 64).to_pylist()


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[dict]]]:
    """Rows of one bucket after the other, from rows that are in the order of buckets."""
    held, rows = None, []
    for r in _rows(batches):
        if held is not None and r["bucket"] != held:
            yield held, rows
            rows = []
        held = r["bucket"]
        rows.append(r)
    if rows:
        yield held, rows


def repeated_parts(docs: DataFrame, bits: int, length: int, gram: int) -> DataFrame:
    """o, t, parts: per document the hashes of its least parts that some other document has too."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text", SLICE):
            raw, o, t = _encoded(b), b.column("o").to_numpy(zero_copy_only=False), b.column("t").to_numpy(zero_copy_only=False)
            owner, h, _, _ = batch_runs(raw, length, gram)
            pair = np.unique(np.stack((h, owner.astype(np.uint64))), axis=1) if len(h) else np.zeros((2, 0), np.uint64)
            bucket, low = _split(pair[0], bits)
            names = np.stack((o, t)).astype(np.int64)
            # Named by its documents, so that a task that runs again names it alike.
            name = int.from_bytes(hashlib.blake2b(names.tobytes(), digest_size=8).digest(), "big", signed=True)
            edge = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))) if len(bucket) else np.zeros(0, int)
            ends = np.append(edge[1:], len(bucket))
            own = pair[1].astype(np.uint32)
            rows = [(int(bucket[p]), name, low[p:q].tobytes(), own[p:q].tobytes(), None) for p, q in zip(edge, ends)]
            rows.append((name % (1 << bits), name, None, None, names.tobytes()))
            yield _batch(**{
                c: pa.array([r[k] for r in rows], kind) for k, (c, kind) in enumerate(
                    (("bucket", pa.int64()), ("slice", pa.int64()), ("low", pa.binary()), ("owner", pa.binary()), ("names", pa.binary()))
                )
            })

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in _buckets(batches):
            parts = [r for r in rows if r["low"] is not None]
            out = [(r["slice"], None, None, r["names"]) for r in rows if r["low"] is None]
            if parts:
                low = np.concatenate([np.frombuffer(r["low"], np.uint32) for r in parts])
                order = np.argsort(low, kind="stable")
                s = low[order]
                same = s[1:] == s[:-1]
                again = np.zeros(len(low), bool)
                again[order] = np.concatenate(([False], same)) | np.concatenate((same, [False]))
                at = 0
                for r in parts:
                    own = np.frombuffer(r["owner"], np.uint32)
                    keep = again[at : at + len(own)]
                    if keep.any():
                        full = (np.uint64(bucket) << np.uint64(32)) | low[at : at + len(own)][keep].astype(np.uint64)
                        out.append((r["slice"], own[keep].tobytes(), full.tobytes(), None))
                    at += len(own)
            yield _batch(**{c: pa.array([r[k] for r in out], kind) for k, (c, kind) in enumerate(
                (("slice", pa.int64()), ("owner", pa.binary()), ("part", pa.binary()), ("names", pa.binary()))
            )})

    def regroup(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(rows):
            names = next((np.frombuffer(r["names"], np.int64).reshape(2, -1) for r in rows if r["names"] is not None), None)
            own = [np.frombuffer(r["owner"], np.uint32) for r in rows if r["owner"] is not None]
            if names is None or not own:
                return None
            own, part = np.concatenate(own), np.concatenate([np.frombuffer(r["part"], np.uint64) for r in rows if r["part"] is not None])
            order = np.lexsort((part, own))
            own, part = own[order], part[order]
            edge = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
            ends = np.append(edge[1:], len(own))
            return _batch(
                o=pa.array(names[0][own[edge]]), t=pa.array(names[1][own[edge]]),
                parts=pa.array([part[p:q].tobytes() for p, q in zip(edge, ends)], pa.binary()),
            )

        held, rows = None, []
        for r in _rows(batches):
            if held is not None and r["slice"] != held:
                if (got := flush(rows)) is not None:
                    yield got
                rows = []
            held = r["slice"]
            rows.append(r)
        if rows and (got := flush(rows)) is not None:
            yield got

    cuts = docs.mapInArrow(cut, "bucket long, slice long, low binary, owner binary, names binary")
    met = cuts.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(meet, "slice long, owner binary, part binary, names binary")
    found = met.repartition("slice").sortWithinPartitions("slice").mapInArrow(regroup, "o long, t long, parts binary")
    return found.dropDuplicates(["o", "t"])


def flagged(rows: list[dict], length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """o, v, start, end of the removed stretches of one bucket; a row holds the runs of one slice."""
    key = np.concatenate([np.frombuffer(r["key"], np.uint32) for r in rows])
    o, v = (np.concatenate([np.frombuffer(r[c], np.int64) for r in rows]) for c in ("o", "v"))
    start, size = np.concatenate([np.frombuffer(r["start"], np.int64) for r in rows]), np.concatenate([np.frombuffer(r["size"], np.uint8) for r in rows]).astype(np.int64)
    content = b"".join(zlib.decompress(r["content"]) for r in rows)
    at = np.cumsum(size) - size
    order = np.argsort(key, kind="stable")
    edge = np.concatenate(([True], np.diff(key[order].astype(np.int64)) != 0))
    group = np.empty(len(key), np.int64)
    group[order] = np.cumsum(edge) - 1
    groups = int(edge.sum())
    low, high = np.full(groups, _LAST), np.full(groups, -1 - _LAST)
    np.minimum.at(low, group, o)
    np.maximum.at(high, group, o)
    live = np.flatnonzero((low < high)[group])  # some other document has the part too
    # Equal runs of a group are one string with the least of their ids.
    ids: dict[tuple[int, bytes], int] = {}
    which = np.array([ids.setdefault((g, content[a : a + s]), len(ids)) for g, a, s in zip(group[live].tolist(), at[live].tolist(), size[live].tolist())], np.int64)
    if not len(which):
        return
    least = np.full(len(ids), _LAST)
    np.minimum.at(least, which, o[live])
    strings = [s for _, s in ids]
    of_group = np.array([g for g, _ in ids])
    windows = np.array([len(s) for s in strings]) - length + 1
    first = np.cumsum(windows) - windows
    floor = np.repeat(least, windows)  # the least id that has each window
    many = np.bincount(of_group, minlength=groups)[of_group] > 1
    crowd = np.flatnonzero(many)
    crowd = crowd[np.argsort(of_group[crowd], kind="stable")]  # a group's strings together
    data = np.frombuffer(b"".join(strings), np.uint8)
    begin = np.cumsum([len(s) for s in strings]) - np.array([len(s) for s in strings])
    border = np.flatnonzero(np.concatenate(([True], np.diff(of_group[crowd]) != 0))) if len(crowd) else np.zeros(0, int)
    load = windows[crowd].cumsum()
    every = np.lib.stride_tricks.sliding_window_view(data, length)
    lo = 0
    while lo < len(crowd):  # so many whole groups at a time that their suffixes stay small
        past = np.searchsorted(load, (load[lo - 1] if lo else 0) + _SUFFIXES, side="right")
        k = np.searchsorted(border, max(past, lo + 1), side="left")
        hi = int(border[k]) if k < len(border) else len(crowd)
        c = crowd[lo:hi]
        lo = hi
        w = windows[c]
        inner = np.arange(int(w.sum())) - np.repeat(np.cumsum(w) - w, w)
        place = np.repeat(begin[c], w) + inner
        slot = np.repeat(first[c], w) + inner
        rank, new = sort_strings(every[place], np.repeat(of_group[c], w))
        run = np.cumsum(new) - 1
        best = np.minimum.reduceat(floor[slot[rank]], np.flatnonzero(new))
        floor[slot[rank]] = best[run]
    # Windows of every occurrence that some smaller id has.
    for a in range(0, len(which), _OCCURRENCES):
        own, of = which[a : a + _OCCURRENCES], live[a : a + _OCCURRENCES]
        w = windows[own]
        inner = np.arange(int(w.sum())) - np.repeat(np.cumsum(w) - w, w)
        owner = np.repeat(of, w)
        hit = floor[np.repeat(first[own], w) + inner] < o[owner]
        owner, inner = owner[hit], inner[hit]
        if len(owner):
            cut = np.concatenate(([True], (owner[1:] != owner[:-1]) | (inner[1:] != inner[:-1] + 1)))
            edge = np.flatnonzero(cut)
            ends = np.append(edge[1:], len(owner)) - 1
            who = owner[edge]
            yield o[who], v[who], start[who] + inner[edge], start[who] + inner[ends] + length


def stretches(docs: DataFrame, parts: DataFrame, bits: int, length: int, gram: int) -> DataFrame:
    """o, v, cuts: per document the stretches to remove, as pairs of start and end, sorted and merged.

    ``parts`` has o, t, v, parts; v numbers the texts that share an o, and costs a shuffle less than t.
    """
    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text", SLICE):
            raw, o, v = _encoded(b), b.column("o").to_numpy(zero_copy_only=False), b.column("v").to_numpy(zero_copy_only=False)
            wanted = [np.frombuffer(p, np.uint64) for p in b.column("parts").to_pylist()]
            owner, h, x, y = batch_runs(raw, length, gram)
            full = h >> np.uint64(32 - bits)
            keep = np.zeros(len(h), bool)
            order = np.argsort(owner, kind="stable")
            ends = np.searchsorted(owner[order], np.arange(len(raw) + 1))
            for k in range(len(raw)):
                own = order[ends[k] : ends[k + 1]]
                keep[own] = np.isin(full[own], wanted[k], assume_unique=False)
            owner, h, x, y = owner[keep], h[keep], x[keep], y[keep]
            bucket, low = _split(h, bits)
            order = np.argsort(bucket, kind="stable")
            owner, x, y, bucket, low = owner[order], x[order], y[order], bucket[order], low[order]
            edge = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))) if len(bucket) else np.zeros(0, int)
            rows = []
            for p, q in zip(edge, np.append(edge[1:], len(bucket))):
                own = owner[p:q]
                rows.append((
                    int(bucket[p]), low[p:q].tobytes(), o[own].tobytes(), v[own].tobytes(), x[p:q].tobytes(),
                    (y[p:q] - x[p:q] + length - 1).astype(np.uint8).tobytes(),
                    zlib.compress(b"".join([raw[d][a : b_ + length - 1] for d, a, b_ in zip(own.tolist(), x[p:q].tolist(), y[p:q].tolist())]), 3),
                ))
            yield _batch(**{c: pa.array([r[k] for r in rows], pa.int64() if c == "bucket" else pa.binary()) for k, c in enumerate(
                ("bucket", "key", "o", "v", "start", "size", "content")
            )})

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _buckets(batches):
            for o, v, a, b in flagged(rows, length):
                home = (mixed(o.view(np.uint64) * np.uint64(3) + v.view(np.uint64)) % np.uint64(1 << bits)).astype(np.int64)
                order = np.argsort(home, kind="stable")
                edge = np.flatnonzero(np.concatenate(([True], np.diff(home[order]) != 0)))
                parts_ = [order[p:q] for p, q in zip(edge, np.append(edge[1:], len(order)))]
                yield _batch(bucket=pa.array([int(home[p[0]]) for p in parts_], pa.int64()), **{
                    c: pa.array([x[p].astype(np.int64).tobytes() for p in parts_], pa.binary()) for c, x in (("o", o), ("v", v), ("a", a), ("b", b))
                })

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _buckets(batches):
            o, v, a, b = (np.concatenate([np.frombuffer(r[c], np.int64) for r in rows]) for c in ("o", "v", "a", "b"))
            order = np.lexsort((a, v, o))
            o, v, a, b = o[order], v[order], a[order], b[order]
            edge = np.flatnonzero(np.concatenate(([True], (o[1:] != o[:-1]) | (v[1:] != v[:-1]))))
            cuts = [merged(a[p:q], b[p:q]).tobytes() for p, q in zip(edge, np.append(edge[1:], len(o)))]
            yield _batch(o=pa.array(o[edge]), v=pa.array(v[edge]), cuts=pa.array(cuts, pa.binary()))

    with_parts = docs.join(parts.select(F.col("o").alias("p_o"), F.col("t").alias("p_t"), "v", "parts"), (F.col("o") == F.col("p_o")) & (F.col("t") == F.col("p_t")))
    gathered = with_parts.select("o", "v", "text", "parts").mapInArrow(
        gather, "bucket long, key binary, o binary, v binary, start binary, size binary, content binary"
    )
    judged = gathered.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(judge, "bucket long, o binary, v binary, a binary, b binary")
    return judged.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(merge, "o long, v long, cuts binary")


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Stretches in order of their start, those that touch joined, as rows (start, end)."""
    reach = np.maximum.accumulate(b)
    new = np.concatenate(([True], a[1:] > reach[:-1]))
    edge = np.flatnonzero(new)
    return np.stack((a[edge], reach[np.append(edge[1:], len(a)) - 1]), 1).astype(np.int64)


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and cuts (start, end) for every row of ``docs`` (doc_id, text).

    Every byte that a string of ``length`` bytes covers which also starts in a document with a smaller doc_id is removed, as judged on
    the input. Matches never cross documents; a null text is empty. Rows that share a doc_id do not remove from each
    other; rows without one come after all others, and not from each other. Exact copies are told by xxhash64 and length, and follow from the
    row with the smallest id. Other columns are ignored. An empty table gives an empty result. ``cuts`` holds 64-bit pairs; it is null
    where nothing is removed, and where the whole text is, being a copy.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("o"),
        F.coalesce("text", F.lit("")).alias("text"),
    ).withColumn("t", F.xxhash64("text", F.octet_length("text")))
    slim = materialised(
        rows.select("doc_id", "o", "t", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("whole")),
        "suffixes",
    )
    total = slim.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    bits = bucket_bits(int(total))
    texts = rows.select("o", "t", "text")
    firsts = slim.groupBy("t").agg(F.min("o").alias("o"))
    # Texts that share an id are numbered; those without one, which may be many, keep their hash as number.
    unnamed = F.when(F.col("o") == _LAST, F.col("t"))
    place = F.row_number().over(Window.partitionBy("o", unnamed).orderBy("t")) - 1
    firsts = firsts.withColumn("v", F.coalesce(unnamed, place.cast("long")))
    firsts = materialised(firsts, "suffixes-firsts")
    parts = materialised(repeated_parts(texts, bits, length, gram).join(firsts, ["t", "o"]).select("o", "t", "v", "parts"), "suffixes-parts")
    cuts = materialised(stretches(texts, parts, bits, length, gram), "suffixes-cuts")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text", SLICE):
            removed, spans, digests = [], [], []
            for raw, cut in zip(_encoded(b), b.column("cuts").to_pylist()):
                c = np.frombuffer(cut, np.int64).reshape(-1, 2)
                h, at = hashlib.sha256(), 0
                for x, y in c.tolist():
                    h.update(raw[at:x])
                    at = y
                h.update(raw[at:])
                removed.append(int((c[:, 1] - c[:, 0]).sum()))
                spans.append(len(c))
                digests.append(h.hexdigest())
            yield _batch(
                c_o=b.column("o"), c_t=b.column("t"), cuts=b.column("cuts"), n_removed=pa.array(removed, pa.int64()), n_spans=pa.array(spans, pa.int64()),
                kept_sha256=pa.array(digests, pa.string()),
            )

    c = cuts.join(firsts, ["o", "v"]).select(F.col("o").alias("k_o"), F.col("t").alias("k_t"), "cuts")
    cut_texts = texts.join(c, (F.col("o") == F.col("k_o")) & (F.col("t") == F.col("k_t"))).select("o", "t", "text", "cuts")
    done = cut_texts.mapInArrow(apply, "c_o long, c_t long, cuts binary, n_removed long, n_spans long, kept_sha256 string").dropDuplicates(["c_o", "c_t"])
    named = slim.join(firsts.select(F.col("t").alias("f_t"), F.col("o").alias("f_o")), F.col("t") == F.col("f_t"))
    out = named.join(done, (F.col("o") == F.col("c_o")) & (F.col("t") == F.col("c_t")), "left")
    copy = (F.col("o") > F.col("f_o")) & (F.col("n_bytes") >= length)
    return out.select(
        "doc_id", "n_bytes", F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(copy, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copy, hashlib.sha256().hexdigest()).otherwise(F.coalesce("kept_sha256", "whole")).alias("kept_sha256"),
        F.when(~copy, F.col("cuts")).alias("cuts"),
    )
