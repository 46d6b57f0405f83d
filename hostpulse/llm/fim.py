"""Fill-in-the-middle by array operations.

A batch of texts becomes one list array of units (code points). Its elements, flat, know their text by the parent index and their
place by their number less that of the text's first unit. Two cuts per text give every unit a role; the units of a role are
filtered, put back into lists and joined, and the pieces of all texts are put together as the form says, all in arrays.
Long texts pass in slices that go on counting, so a batch is never much larger than its bound.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hostpulse.llm.common import fresh_name, pieces, slices, texts_of

#: Marks before prefix, suffix and middle.
SENTINELS = ("<P>", "<S>", "<M>")
#: Of a hundred texts, those that are cut, and of a hundred of these, those whose suffix comes first.
CUT_PERCENT, SUFFIX_FIRST_PERCENT = 90, 20
SEED = 1
#: Bytes of text that become units at a time, and code points of a slice.
_UNITS, _SLICE = 1 << 20, 1 << 18


def draws(key: int | None, seed: int = SEED) -> tuple[int, ...]:
    """The four numbers that decide what happens to a text: the first four groups of eight digits of a hash."""
    digits = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    return tuple(int(digits[8 * i : 8 * i + 8], 16) for i in range(4))


def units(texts: pa.StringArray) -> pa.ListArray:
    """Per text the list of its code points."""
    sizes = np.append(0, np.cumsum(pc.binary_length(texts).to_numpy()))
    body = texts.buffers()[2]
    data = np.frombuffer(body if body is not None else b"", np.uint8)[: sizes[-1]]
    first = (data & 0xC0) != 0x80  # the first byte of a code point
    starts = np.append(np.flatnonzero(first), len(data)).astype(np.int32)
    flat = pa.StringArray.from_buffers(len(starts) - 1, pa.py_buffer(starts), pa.py_buffer(data))
    return pa.ListArray.from_arrays(np.append(0, np.cumsum(first))[sizes].astype(np.int32), flat)


def joined_by_list(flat: pa.Array, parent: pa.Array, n: int) -> pa.Array:
    """The elements of each of ``n`` lists, which follow each other by ``parent``, joined."""
    sizes = np.bincount(parent.to_numpy(), minlength=n)
    return pc.binary_join(pa.ListArray.from_arrays(np.append(0, np.cumsum(sizes)).astype(np.int32), flat), "")


def cut(texts: pa.StringArray, first: np.ndarray, low: np.ndarray, high: np.ndarray) -> list[pa.Array]:
    """Prefix, middle and suffix of each text; ``first`` is the number of its first unit, ``low`` and ``high`` those of its cuts."""
    lists = units(texts)
    flat, parent = pc.list_flatten(lists), pc.list_parent_indices(lists)
    shift = pa.array(first - lists.offsets.to_numpy()[:-1])
    ordinal = pc.add(pa.array(np.arange(len(flat))), pc.take(shift, parent))
    before_low = pc.less(ordinal, pc.take(pa.array(low), parent))
    before_high = pc.less(ordinal, pc.take(pa.array(high), parent))
    roles = (before_low, pc.and_not(before_high, before_low), pc.invert(before_high))
    return [joined_by_list(flat.filter(r), parent.filter(r), len(texts)) for r in roles]


def cut_all(texts: list[str], low: np.ndarray, high: np.ndarray) -> list[pa.Array]:
    """``cut`` of texts of any length, in slices."""
    owner, first, parts = [], [], []
    for i, t in enumerate(texts):
        for a in range(0, max(1, len(t)), _SLICE):
            owner.append(i)
            first.append(a)
            parts.append(t[a : a + _SLICE])
    owner, first = np.array(owner, np.int64), np.array(first, np.int64)
    found = [
        cut(pa.array(parts[a:b], pa.string()), first[a:b], low[owner[a:b]], high[owner[a:b]])
        for a, b in slices([max(64, len(p)) for p in parts], _UNITS)
    ]
    whole = pa.array(owner)
    return [joined_by_list(pa.concat_arrays([f[k] for f in found]), whole, len(texts)) for k in range(3)]


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that an output was made from."""
    p, s, m = sentinels
    def between(body: Column, mark: str) -> tuple[Column, Column]:
        return F.substring_index(body, mark, 1), F.substring_index(body, mark, -1)

    prefix, rest = between(F.substr(output, F.lit(len(p) + 1)), s)
    suffix, middle = between(rest, m)
    suffix_2, rest_2 = between(F.substr(output, F.lit(len(s) + 1)), p)
    prefix_2, middle_2 = between(rest_2, m)
    return (
        F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(prefix_2, middle_2, suffix_2)).otherwise(output)
    )


def fill_in_middle(
    docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = SEED, sentinels: tuple[str, str, str] = SENTINELS,
    cut_percent: int = CUT_PERCENT, suffix_first_percent: int = SUFFIX_FIRST_PERCENT,
) -> DataFrame:
    """``docs`` without its text, with n, form, prefix_chars, middle_chars and output.

    Texts are cut into code points. What happens to a text follows from ``seed`` and its integer ``key`` alone, so repeated rows come out
    alike and a rerun gives the same. ``form`` is ``plain`` (the text as it is), ``psm`` or ``spm``; the lengths are null for plain ones.
    Null and empty texts, and texts that hold a sentinel, stay plain. A null key draws as one without digits. Columns of ``docs``
    that clash with the new names are replaced, all others stay. An empty table gives an empty result. Sentinels are in angle brackets,
    so that none can arise where pieces meet.
    """
    if len(set(sentinels)) < 3 or not all(re.fullmatch("<[^<>]+>", s) for s in sentinels):
        raise ValueError("sentinels must be three different names in angle brackets")
    p, s, m = sentinels
    marks = re.compile("|".join(map(re.escape, sentinels)))
    new = {"n": "long", "form": "string", "prefix_chars": "long", "middle_chars": "long", "output": "string"}
    others = [c for c in docs.columns if c.lower() not in {text.lower(), *new}]
    id_, body = fresh_name(docs, "fim_key"), fresh_name(docs, "fim_body")
    rows = docs.select(
        *[F.col(f"`{c}`") for c in others], F.col(f"`{key}`").cast("long").alias(id_), F.col(f"`{text}`").alias(body)
    )

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, body, _UNITS):
            texts = texts_of(b, body)
            drawn = [draws(k, seed) for k in b.column(id_).to_pylist()]
            n = np.array([len(t) for t in texts], np.int64)
            h = np.array(drawn, np.int64).reshape(-1, 4)
            ends = np.sort(h[:, :2] % (n + 1)[:, None], axis=1)
            whole = (n == 0) | (h[:, 2] % 100 >= cut_percent) | np.array([bool(marks.search(t)) for t in texts], bool)
            form = np.where(whole, "plain", np.where(h[:, 3] % 100 < suffix_first_percent, "spm", "psm"))
            chosen = np.flatnonzero(~whole)
            prefix, middle, suffix = cut_all([texts[i] for i in chosen], ends[chosen, 0], ends[chosen, 1]) if len(chosen) else 3 * [pa.array([], pa.string())]
            made = pc.if_else(
                pa.array(form[chosen] == "psm", pa.bool_()),
                pc.binary_join_element_wise(p, prefix, s, suffix, m, middle, ""),
                pc.binary_join_element_wise(s, suffix, p, prefix, m, middle, ""),
            )
            # The cut texts first, then the others, taken in the order of the rows.
            place = np.empty(len(texts), np.int64)
            place[chosen] = np.arange(len(chosen))
            place[whole] = len(chosen) + np.arange(whole.sum())
            plain = pa.array([texts[i] for i in np.flatnonzero(whole)], pa.string())
            output = pa.concat_arrays([made, plain]).take(pa.array(place))
            columns = [
                pa.array(n), pa.array(form.tolist(), pa.string()), pa.array(ends[:, 0], mask=whole),
                pa.array(ends[:, 1] - ends[:, 0], mask=whole), output,
            ]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in others], *columns], names=[*others, *new])

    kept = rows.drop(id_, body).withColumns({c: F.lit(None).cast(kind) for c, kind in new.items()}).schema
    return rows.mapInArrow(make, kept)
