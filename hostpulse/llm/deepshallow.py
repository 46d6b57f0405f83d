"""Deep-shallow sorting of fixed-length byte strings.

The strings are sorted by multikey quicksort, in array steps over words of eight bytes, to a shallow depth. Groups that still
agree there have long common prefixes; each is ordered by a blind trie, which branches only where strings differ and
compares a new string in full with one leaf only.
"""

from __future__ import annotations

import numpy as np

#: Words of eight bytes the array steps look at.
SHALLOW_WORDS = 2


class BlindTrie:
    """Strings (rows of bytes of equal length) in a binary trie over bit positions; equal strings share a leaf."""

    def __init__(self) -> None:
        self.root: list | None = None

    def insert(self, row: int, text: bytes) -> None:
        """Leaves are [None, text, rows]; inner nodes are [bit, zero side, one side]."""
        if self.root is None:
            self.root = [None, text, [row]]
            return
        node = self.root
        while node[0] is not None:
            bit = node[0]
            node = node[1 + (text[bit >> 3] >> (7 - (bit & 7)) & 1)]
        if node[1] == text:
            node[2].append(row)
            return
        at = next(i for i, (x, y) in enumerate(zip(text, node[1])) if x != y)
        bit = 8 * at + 8 - (text[at] ^ node[1][at]).bit_length()
        side = text[at] >> (7 - (bit & 7)) & 1
        above, node = None, self.root
        while node[0] is not None and node[0] < bit:
            above = node
            way = 1 + (text[node[0] >> 3] >> (7 - (node[0] & 7)) & 1)
            node = node[way]
        leaf = [None, text, [row]]
        new = [bit, node, leaf] if side else [bit, leaf, node]
        if above is None:
            self.root = new
        else:
            above[way] = new

    def ordered(self) -> list[list[int]]:
        """Rows in the order of their strings, equal ones together."""
        out, stack = [], [self.root] if self.root else []
        while stack:
            node = stack.pop()
            if node[0] is None:
                out.append(node[2])
            else:
                stack += [node[2], node[1]]
        return out


def sort_strings(text: np.ndarray, groups: np.ndarray | None = None, shallow: int = SHALLOW_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows of a byte matrix by (group, string), and for each place whether it begins a new string."""
    n, width = text.shape
    group = np.zeros(n, np.int64) if groups is None else groups.astype(np.int64)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, bool)
    words = -(-width // 8)
    padded = np.zeros((n, words * 8), np.uint8)
    padded[:, :width] = text
    keys = padded.view(">u8")
    order = np.argsort(group, kind="stable")
    new = np.concatenate(([True], np.diff(group[order]) != 0))
    for w in range(min(shallow, words)):  # one level of the multikey quicksort: equal parts are split by the next word
        part = np.cumsum(new) - 1
        k = keys[order, w].astype(np.uint64)
        step = np.lexsort((k, part))
        order, k = order[step], k[step]
        new = np.concatenate(([True], (part[1:] != part[:-1]) | (k[1:] != k[:-1])))
    if shallow >= words:
        return order, new
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, n))
    # Pairs are compared at once; larger groups go through a trie each.
    two = first[size == 2]
    if len(two):
        x, y = order[two], order[two + 1]
        a, b = keys[x], keys[y]
        differ = a != b
        other = differ.any(1)
        where = differ.argmax(1)
        swap = other & (a[np.arange(len(two)), where] > b[np.arange(len(two)), where])
        order[two[swap]], order[two[swap] + 1] = y[swap], x[swap]
        new[two[other] + 1] = True
    for f, s in zip(first[size > 2].tolist(), size[size > 2].tolist()):
        trie = BlindTrie()
        for row in order[f : f + s].tolist():
            trie.insert(row, text[row].tobytes())
        at = f
        for rows in trie.ordered():
            order[at : at + len(rows)] = rows
            new[at] = True
            at += len(rows)
    return order, new
