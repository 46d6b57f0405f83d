"""SimHash near-duplicates by a binary trie that is joined with itself.

Equal fingerprints are one leaf. Two fingerprints with at most three differing bits have at most one of them in one half, and
in that half a quarter without any. So the bits are put in four orders, each with another quarter in front; in the order that
suits a pair it shares the first 16 bits and differs in at most one of the first 32. Each order is a trie whose nodes of depth
16 are joined with themselves: pairs of nodes are walked together from there, the bits in which their paths differ add up, and
a pair of nodes goes as soon as they exceed the budget, or once both lie in one component, where it can add nothing. Nodes with
too many leaves for one task are split further down into pairs of nodes, each its own task input, under the same budget.

A task gives one link per fingerprint at most: to the first of its component as far as the task can see. Components over all
tasks follow from these links.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hostpulse.llm.common import PIECE, pieces, texts_of
from hostpulse.llm.common import written as materialised
from hostpulse.llm.components import components

#: Words of a shingle, seed of its hash, bits in which linked fingerprints may differ.
SHINGLE, SEED, BUDGET = 3, 42, 3
#: Differing bits that the order of bits that suits a pair leaves in its first half, and bits that it shares in front.
HALF_BUDGET, SHARED = 1, 16
#: The quarters of 16 bits in each order.
ORDERS = ((0, 1, 2, 3), (1, 0, 2, 3), (2, 3, 0, 1), (3, 2, 0, 1))
#: Leaves that one task holds of a pair of nodes, pairs of nodes that it walks at a time, and those that may wait.
LEAVES, PAIRS, WAITING = 1 << 19, 1 << 16, 1 << 22
#: Bits by which large nodes are split, and shingles that are hashed at a time.
STEP, _BLOCK = 8, 1 << 16

_hash = partial(xxhash.xxh64_intdigest, seed=SEED)


def fingerprint(text: str) -> int:
    """The SimHash of a text: a bit is 1 if it is set in over half of its shingles' hashes. 0 without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z, and the white space of ASCII
    if not words:
        return 0
    n = max(1, len(words) - SHINGLE + 1)
    ones = np.zeros(64, np.int64)
    for a in range(0, n, _BLOCK):
        own = words[a : a + _BLOCK + SHINGLE - 1]
        joined = map(b" ".join, zip(*(own[k:] for k in range(SHINGLE)))) if len(words) >= SHINGLE else [b" ".join(own)]
        h = np.fromiter(map(_hash, joined), "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def document_fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp: the fingerprint of each row's whole text, as a signed 64-bit number."""
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text", PIECE):
            found = np.array([fingerprint(t) for t in texts_of(b)], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(build, "doc_id long, fp long")


def _bit_length(v: np.ndarray) -> np.ndarray:
    """Places of the highest bit that is set, from 1; 0 for 0."""
    return np.frexp((v & ~(v >> np.uint64(1))).astype(np.float64))[1]  # without its second bit a number is not rounded up


class Leaves:
    """Sorted fingerprints as the leaves of a binary trie. A node is a range of them; equal labels are one component."""

    def __init__(self, x: np.ndarray):
        self.x, self.label = x, np.arange(len(x))
        self.ends = self.label + 1  # end of the stretch of equal labels that a leaf is in

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        """Merge the components of leaves."""
        while True:
            la, lb = self.label[a], self.label[b]
            differ = la != lb
            if not differ.any():
                break
            parent = np.arange(len(self.x))
            np.minimum.at(parent, np.maximum(la, lb)[differ], np.minimum(la, lb)[differ])
            while not np.array_equal(up := parent[parent], parent):
                parent = up
            self.label = parent[self.label]
        change = np.append(np.flatnonzero(np.diff(self.label)) + 1, len(self.x))
        self.ends = change[np.searchsorted(change, np.arange(len(self.x)), side="right")]

    def shared(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Bits that all leaves of a node share in front."""
        return 64 - _bit_length(self.x[lo] ^ self.x[hi - 1])

    def middle(self, lo: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """Where the second child of a node begins that branches at ``depth``."""
        bit = np.uint64(1) << (63 - depth).astype(np.uint64)
        return np.searchsorted(self.x, (self.x[lo] | bit) & ~(bit - np.uint64(1)))

    def join(self, pairs: np.ndarray, budget: int = BUDGET, at_once: int = PAIRS, waiting: int = WAITING) -> None:
        """Link the leaves below pairs of nodes, rows of (lo, hi, lo, hi), that differ in at most ``budget`` bits.

        Pairs wait by the bits they differ in so far and those with the fewest come first, so most of the far ones fall into one
        component before they are looked at. Past ``waiting`` of them the far ones are worked off first.
        """
        pools: list[list[np.ndarray]] = [[pairs], *([] for _ in range(budget))]

        def put(bits: int, more: np.ndarray) -> None:
            if len(more):
                pools[bits].append(more)

        while any(pools):
            full = sum(len(x) for pool in pools for x in pool) > waiting
            bits = (max if full else min)(k for k, pool in enumerate(pools) if pool)
            part, n = [], 0
            while pools[bits] and n < at_once:
                part.append(pools[bits].pop())
                n += len(part[-1])
            pairs = np.concatenate(part)
            put(bits, pairs[at_once:])
            pairs = pairs[:at_once]
            a, a_end, b, b_end = pairs.T
            pairs = pairs[(self.label[a] != self.label[b]) | (self.ends[a] < a_end) | (self.ends[b] < b_end)]
            a, a_end, b, b_end = pairs.T
            deep_a, deep_b = self.shared(a, a_end), self.shared(b, b_end)
            depth = np.minimum(deep_a, deep_b)
            # The bits of both paths as far as they go; at the full depth nothing is masked.
            beyond = (np.uint64(1) << (np.uint64(64) - depth.astype(np.uint64)) % np.uint64(64)) - np.uint64(1)
            differ = (self.x[a] ^ self.x[b]) & ~beyond
            count = np.bitwise_count(differ)
            near = (count <= budget) & (np.bitwise_count(differ >> np.uint64(32)) <= HALF_BUDGET)
            for k in range(bits + 1, budget + 1):
                put(k, pairs[near & (count == k)])
            now = near & (count <= bits)
            pairs, deep_a, deep_b, depth = pairs[now], deep_a[now], deep_b[now], depth[now]
            met = depth == 64
            if met.any():
                self.link(pairs[met, 0], pairs[met, 2])
                pairs, deep_a, deep_b = pairs[~met], deep_a[~met], deep_b[~met]
            own = pairs[:, 0] == pairs[:, 2]
            if own.any():
                lo, hi = pairs[own, 0], pairs[own, 1]
                mid = self.middle(lo, deep_a[own])
                put(min(1, budget), np.stack([lo, mid, mid, hi], 1))
                selves = np.concatenate([np.stack([lo, mid, lo, mid], 1), np.stack([mid, hi, mid, hi], 1)])
                put(0, selves[selves[:, 1] - selves[:, 0] > 1])
            first = ~own & (deep_a <= deep_b)
            for side, which, deep in ((0, first, deep_a), (2, ~own & ~first, deep_b)):
                if which.any():
                    low = pairs[which].copy()
                    high = low.copy()
                    low[:, side + 1] = high[:, side] = self.middle(low[:, side], deep[which])
                    put(bits, np.concatenate([low, high]))


def _quarter(value: Column, k: int) -> Column:
    return F.shiftrightunsigned(value, 48 - 16 * k).bitwiseAND(F.lit(0xFFFF).cast("long"))


def turned(fp: Column, order: tuple[int, ...]) -> Column:
    """The bits of a fingerprint with its quarters in another order."""
    out = F.lit(0).cast("long")
    for place, k in enumerate(order):
        out = out.bitwiseOR(F.shiftleft(_quarter(fp, k), 48 - 16 * place))
    return out


def turned_back(values: np.ndarray, order: tuple[int, ...]) -> np.ndarray:
    out = np.zeros_like(values)
    for place, k in enumerate(order):
        out |= ((values >> np.uint64(48 - 16 * place)) & np.uint64(0xFFFF)) << np.uint64(48 - 16 * k)
    return out


def _front(value: Column, depth: int) -> Column:
    return F.shiftrightunsigned(value, 64 - depth)


_UNIT = ["turn", "depth", "a", "b"]


def units(leaves: DataFrame, most: int) -> DataFrame:
    """turn, depth, a, b, value: the leaves below each pair of nodes (a, b) of a depth that one task joins.

    ``leaves`` has turn and value. A pair with over ``most`` leaves gives way to the pairs of its nodes' descendants, ``STEP`` bits
    further down, that are within the budget. At the full depth a node is one leaf.
    """
    head = _front(F.col("value"), SHARED)
    sizes = leaves.groupBy("turn", head.alias("a")).agg(F.count(F.lit(1)).alias("n"))
    large = materialised(sizes.filter(F.col("n") > most), "simhash-large")
    plain = leaves.select("turn", F.lit(SHARED).alias("depth"), head.alias("a"), head.alias("b"), "value")
    if large.isEmpty():
        return plain
    # The large nodes number one in ``most`` leaves at most.
    known = large.select("turn", "a")
    out = [plain.join(known, ["turn", "a"], "left_anti").select(*_UNIT, "value")]
    rest = materialised(leaves.withColumn("a", head).join(known, ["turn", "a"], "left_semi").drop("a"), "simhash-rest")
    open_ = large.select("turn", "a", F.col("a").alias("b"))
    for depth in range(SHARED + STEP, 65, STEP):
        nodes = rest.groupBy("turn", _front(F.col("value"), depth).alias("node")).agg(F.count(F.lit(1)).alias("n"))
        nodes = materialised(nodes.withColumn("up", F.shiftrightunsigned("node", STEP)), "simhash-nodes")
        left = nodes.select("turn", F.col("up").alias("a"), F.col("node").alias("x"), F.col("n").alias("n_x"))
        right = nodes.select("turn", F.col("up").alias("b"), F.col("node").alias("y"), F.col("n").alias("n_y"))
        differ = F.col("x").bitwiseXOR(F.col("y"))
        near = (F.bit_count(differ) <= BUDGET) & (F.bit_count(F.shiftrightunsigned(differ, max(0, depth - 32))) <= HALF_BUDGET)
        pairs = open_.join(left, ["turn", "a"]).join(right, ["turn", "b"]).filter((F.col("x") <= F.col("y")) & near)
        pairs = materialised(pairs.select("turn", F.col("x").alias("a"), F.col("y").alias("b"), (F.col("n_x") + F.col("n_y")).alias("n")), "simhash-pairs")
        small = pairs if depth == 64 else pairs.filter(F.col("n") <= most)
        members = small.select(
            "turn", "a", "b", F.explode(F.array_distinct(F.array("a", "b"))).alias("node")
        )
        placed = rest.withColumn("node", _front(F.col("value"), depth)).join(members, ["turn", "node"])
        out.append(placed.select("turn", F.lit(depth).alias("depth"), "a", "b", "value"))
        open_ = pairs.filter(F.col("n") > most).select("turn", "a", "b")
        if open_.isEmpty():
            break
    whole = out[0]
    for more in out[1:]:
        whole = whole.unionByName(more)
    return whole


def unit_links(rows: DataFrame, most: int) -> DataFrame:
    """a, b: a link from each fingerprint to the first of its component within a unit, where that is another."""
    def walk(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Links of whole units. Those that join a node with itself are joined together, others one by one."""
        found = []
        same = keys[:, 2] == keys[:, 3]
        for turn in np.unique(keys[:, 0]):
            own = same & (keys[:, 0] == turn)
            groups = [own] if own.any() else []
            crossed = ~same & (keys[:, 0] == turn)
            at = np.flatnonzero(crossed)
            for part in np.split(at, np.flatnonzero((np.diff(keys[at], axis=0) != 0).any(1)) + 1) if len(at) else []:
                groups.append(part)
            for group in groups:
                x = np.sort(values[group])
                depth = keys[group][:, 1] if group is own else keys[group[0], 1]
                if group is own:
                    front = keys[own][np.argsort(values[own], kind="stable")]
                    cuts = np.flatnonzero((np.diff(front[:, 1:3], axis=0) != 0).any(1)) + 1
                    lo, hi = np.concatenate(([0], cuts)), np.append(cuts, len(x))
                    pairs = np.stack([lo, hi, lo, hi], 1)[hi - lo > 1]
                else:
                    second = keys[group[0], 2:4].astype(np.uint64).max() << np.uint64(64 - int(depth))
                    mid = np.searchsorted(x, second)
                    pairs = np.array([[0, mid, mid, len(x)]])
                trie = Leaves(x)
                trie.join(pairs)
                moved = trie.label != np.arange(len(x))
                order = ORDERS[int(turn)]
                found.append((turned_back(x[moved], order), turned_back(x[trie.label[moved]], order)))
        if not found:
            return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links() -> pa.RecordBatch:
            a, b = walk(np.concatenate(keys), np.concatenate(values))
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        keys, values, held = [], [], 0
        for batch in batches:
            own = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in _UNIT], 1)
            new = batch.column("value").to_numpy().view(np.uint64)
            if held + len(new) > most and held:
                # What precedes the last unit is whole.
                joined = np.concatenate([*keys, own])
                cut = np.flatnonzero((joined != joined[-1]).any(1))
                cut = int(cut[-1]) + 1 if len(cut) else 0
                if cut:
                    all_values = np.concatenate([*values, new])
                    rest_keys, rest_values = joined[cut:], all_values[cut:]
                    keys, values = [joined[:cut]], [all_values[:cut]]
                    yield links()
                    keys, values, held = [rest_keys], [rest_values], len(rest_values)
                    continue
            keys.append(own)
            values.append(new)
            held += len(new)
        if held:
            yield links()

    dealt = rows.select(F.col("turn").cast("int").alias("turn"), "depth", "a", "b", "value").repartition(*_UNIT).sortWithinPartitions(*_UNIT)
    return dealt.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, most: int = LEAVES) -> DataFrame:
    """doc_id, fp, component_id for every row of ``docs`` (doc_id, text).

    Two rows link when their fingerprints (64 bits, as a signed number) differ in at most three bits; ``component_id`` is the smallest
    doc_id that links lead to, its own included. A-Z count as a-z, words are runs without white space, fewer words than a
    shingle are one shingle, and null texts and texts without words have fingerprint 0, which links like any other. Repeated
    rows each keep a row of the result. Rows without doc_id take part, but name no component. Other columns are ignored. An empty table
    gives an empty result. ``most`` bounds the fingerprints that a task holds, not those that are joined.
    """
    rows = materialised(document_fingerprints(docs), "simhash-rows")
    leaves = materialised(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "simhash-leaves")
    values = leaves.select(F.posexplode(F.array(*[turned(F.col("fp"), o) for o in ORDERS])).alias("turn", "value"))
    links = materialised(unit_links(units(values, most), most), "simhash-links")
    parts = components(links, "simhash-parts")
    grouped = leaves.join(parts, F.col("fp") == F.col("node"), "left").select("fp", "least", "n", "component")
    named = grouped.filter("component IS NOT NULL").groupBy("component").agg(F.min("least").alias("component_id"))
    named = grouped.join(named, "component").select("fp", "component_id").unionByName(
        grouped.filter("component IS NULL AND n > 1").select("fp", F.col("least").alias("component_id"))
    )
    named = named.select(F.col("fp").alias("named"), "component_id")
    return rows.join(named, F.col("fp") == F.col("named"), "left").select(
        "doc_id", "fp", F.coalesce("component_id", "doc_id").alias("component_id")
    )
