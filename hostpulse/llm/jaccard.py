"""Exact n-gram Jaccard join by a size-aware heavy-light scheme.

A document's set is its distinct five-word shingles. Equal sets form a class; only classes are joined. With the shingles of a
set in one global order, two sets that are similar share c of their first n - ceil(t n) + c shingles. Small (light) sets
enumerate all pairs of that prefix (c = 2), so that one shared pair makes a candidate. Large (heavy) sets post the prefix to
inverted lists with a c that grows with n, and candidates must share a number of postings. The boundary is where the total
number of rows, as counted over the sets, is least.

Lists are only ever scanned in order, and a scan first links each set to one centre, so that a list of thousands of near
copies costs thousands of links and not their square. The sets that the centres left in different components may still link.
Within a cluster, which is what the first links connect, they are compared by what sets each apart from the cluster's centre, and
across clusters on their whole sets, so no link between components is missed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hostpulse.llm.common import PIECE, fresh_name, mixed, pieces, slices, texts_of
from hostpulse.llm.components import components
from hostpulse.llm.quality import word_hashes
from hostpulse.llm.common import written as materialised

#: Words of a shingle, and the similarity in hundredths from which two sets link.
SHINGLE, PERCENT = 5, 80
_SLICE = 1 << 20
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def shingle_sets(texts: list[str], size: int = SHINGLE) -> Iterator[np.ndarray]:
    """Per text the sorted 64-bit hashes of its distinct shingles."""
    mults = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) for k in range(size)], np.uint64)
    for a, b in slices([len(t) for t in texts], _SLICE):
        raw = [t.encode("utf-8", "surrogatepass") for t in texts[a:b]]
        data = _LOWER[np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)]
        starts, words = word_hashes(data)
        ends = np.cumsum([len(r) + 1 for r in raw])
        cut = np.searchsorted(starts, np.concatenate(([0], ends)))
        with np.errstate(over="ignore"):
            n = max(0, len(words) - size + 1)
            sums = np.zeros(n, np.uint64)
            for k in range(size):
                sums += mixed(words[k : k + n] + mults[k]) * mults[k]
            grams = mixed(sums)
            for i in range(len(raw)):
                lo, hi = cut[i], cut[i + 1]
                if hi - lo >= size:
                    yield np.unique(grams[lo : hi - size + 1])
                elif hi > lo:
                    few = mixed(words[lo:hi] + mults[: hi - lo]) * mults[: hi - lo]
                    yield mixed(np.array([few.sum() + np.uint64(hi - lo)], np.uint64))
                else:
                    yield np.zeros(0, np.uint64)


def set_id(shingles: np.ndarray) -> int | None:
    """Id of a set's class; None for the empty set, which links with nothing."""
    if not len(shingles):
        return None
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "big", signed=True)


def least_overlap(n, percent: int = PERCENT):
    """Shingles a set of n must share with any set it links to."""
    return (percent * n + 99) // 100


def heavy_c(n):
    """Shared prefix shingles that heavy sets of n are filtered by."""
    return np.maximum(1, n // 20)


def heavy_need(n, percent: int = PERCENT):
    """Postings a heavy set of n shares with any set it links to, whichever of the two is smaller."""
    return heavy_c(least_overlap(n, percent))


def prefix_sizes(n, percent: int = PERCENT):
    """Lengths of the light and of the heavy prefix."""
    rest = n - least_overlap(n, percent)
    return np.minimum(n, rest + 2), np.minimum(n, rest + heavy_c(n))


def boundary(histogram: list[tuple[int, int]], percent: int = PERCENT) -> int:
    """The largest size that counts as light: the total cost of rows is least there.

    A light set costs a row for every pair of its prefix. A heavy set costs two for every posting: one to make it and one to scan
    it. Light sets that a heavy one can link to are posted too.
    """
    if not histogram:
        return 0
    n = np.array([x for x, _ in histogram])
    count = np.array([c for _, c in histogram], float)
    p2, ph = prefix_sizes(n, percent)
    light, heavy = count * p2 * (p2 - 1) / 2, 2.0 * count * ph
    best = min([0, *n.tolist()], key=lambda x: (light[n <= x].sum() + heavy[n >= least_overlap(x + 1, percent)].sum(), x))
    return int(best)


_SETS = "doc_id long, text_key long, n_shingles long, class long, prefix binary"


def _signed(a: np.ndarray) -> np.ndarray:
    return a.view(np.int64)


def document_sets(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text", PIECE):
            sizes, ids, heads = [], [], []
            for s in shingle_sets(texts_of(b)):
                sizes.append(len(s))
                ids.append(set_id(s))
                heads.append(s[: max(int(x) for x in prefix_sizes(len(s), percent))].tobytes())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("text_key"), pa.array(sizes, pa.int64()), pa.array(ids, pa.int64()), pa.array(heads, pa.binary())],
                names=["doc_id", "text_key", "n_shingles", "class", "prefix"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_key"))
    return rows.mapInArrow(build, _SETS)


def postings(sets: DataFrame, light: int, percent: int = PERCENT) -> DataFrame:
    """token, class, heavy: pairs of the prefix of light sets, and the prefix of heavy sets."""
    post = least_overlap(light + 1, percent)

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tokens, owners, kinds = [], [], []
            seen: set[int] = set()
            for n, c, head in zip(b.column("n_shingles").to_pylist(), b.column("class").to_pylist(), b.column("prefix").to_pylist()):
                if c in seen:  # copies need posting once
                    continue
                seen.add(c)
                h = np.frombuffer(head, np.uint64)
                p2, ph = (int(x) for x in prefix_sizes(n, percent))
                if 2 <= n <= light:
                    i, j = np.triu_indices(p2, 1)
                    with np.errstate(over="ignore"):
                        tokens.append(mixed(h[i] * np.uint64(3) + mixed(h[j])))
                    owners.append(np.full(len(i), c, np.int64))
                    kinds.append(np.zeros(len(i), bool))
                if n >= post and n > 1:
                    tokens.append(h[:ph])
                    owners.append(np.full(ph, c, np.int64))
                    kinds.append(np.ones(ph, bool))
            if tokens:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(_signed(np.concatenate(tokens))), pa.array(np.concatenate(owners)), pa.array(np.concatenate(kinds))],
                    names=["token", "class", "heavy"],
                )

    return sets.filter("class IS NOT NULL").select("n_shingles", "class", "prefix").mapInArrow(
        spell, "token long, class long, heavy boolean"
    )


def shared_postings(posted: DataFrame) -> DataFrame:
    """Postings of tokens that at least two classes have, with the length of their list."""
    whole = Window.partitionBy("token", "heavy")
    return (
        posted.withColumn("before", F.lag("class").over(whole.orderBy("class"))).filter("before IS NULL OR before < class")
        .withColumn("df", F.count(F.lit(1)).over(whole)).filter("df > 1").select("token", "heavy", "class", "df")
    )


def first_links(shared: DataFrame, sizes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Pairs (a, b): for each class the one centre it shares most lists with.

    A list's centre is the class whose own lists are longest in all. That is the text that copies were made from, if it is there:
    a copy's changes are found nowhere else.
    """
    weight = shared.groupBy("class").agg(F.sum("df").alias("weight"))
    centre = F.max(F.struct("weight", "class")).over(Window.partitionBy("token", "heavy"))["class"]
    led = shared.join(weight, "class").withColumn("centre", centre)
    other = sizes.select(F.col("class").alias("centre"), F.col("n").alias("centre_n"))
    return (
        led.filter("class <> centre").groupBy("class", "centre").agg(F.count(F.lit(1)).alias("k"))
        .join(sizes, "class").join(other, "centre").filter(_similar_sizes(F.col("n"), F.col("centre_n"), percent))
        .groupBy("class").agg(F.max(F.struct("k", "centre")).alias("best"))
        .select(F.col("class").alias("a"), F.col("best.centre").alias("b"))
    )


def _spread_need(n: Column, percent: int = PERCENT) -> Column:
    """heavy_need as a column."""
    return F.greatest(F.lit(1), F.floor(F.floor((n * percent + 99) / 100) / 20)).cast("long")


def _similar_sizes(a: Column, b: Column, percent: int = PERCENT) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def class_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """text, class: one row for each class in ``wanted`` (class, rep, rep_key, rep_rows), found by the id and the hash of the text of its
    document. Rows without an id, or that share one, come to the class of their own text only, and repeated rows once."""
    # Merged at every size, as it must be at a large one: neither side has a bound.
    same = F.col("doc_id").eqNullSafe(F.col("rep")) & (F.xxhash64("text") == F.col("rep_key"))
    wanted = wanted.select("class", "rep", "rep_key", "rep_rows")
    found = docs.select("doc_id", "text").join(wanted.hint("merge"), same).select("text", "class", "rep_rows")
    if wanted.filter("rep_rows > 1").isEmpty():
        return found.select("text", "class")
    again = found.filter("rep_rows > 1").groupBy("class").agg(F.min("text").alias("text"))
    return found.filter("rep_rows = 1").select("text", "class").unionByName(again)


def class_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """class, shingles of the classes in ``wanted`` (as class_texts takes it), made again from the text of a document of each."""
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text", PIECE):
            got = [(c, s.tobytes()) for c, s in zip(b.column("class").to_pylist(), shingle_sets(texts_of(b))) if set_id(s) == c]
            yield pa.RecordBatch.from_arrays(
                [pa.array([c for c, _ in got], pa.int64()), pa.array([s for _, s in got], pa.binary())], names=["class", "shingles"]
            )

    return class_texts(docs, wanted).mapInArrow(build, "class long, shingles binary")


def _beside(pairs: DataFrame, sets: DataFrame, per_task: int = 2_000) -> DataFrame:
    """b, salt, member, shingles: the sets of all a of the pairs (a, b) after that of their b (member null), dealt out by b and salt.

    A b with very many a is sent to several tasks.
    """
    salts = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / per_task).cast("int").alias("salts"))
    salts = salts.select(F.col("b").alias("s_b"), "salts")
    pairs = pairs.join(salts, F.col("b") == F.col("s_b")).select("a", "b", F.pmod(F.xxhash64("a"), F.col("salts")).cast("int").alias("salt"))
    members = pairs.hint("merge").join(sets, F.col("a") == F.col("class")).select("b", "salt", F.col("a").alias("member"), "shingles")
    centres = salts.hint("merge").join(sets, F.col("s_b") == F.col("class")).select(
        F.col("s_b").alias("b"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(None).cast("long").alias("member"), "shingles"
    )
    return members.unionByName(centres).repartition("b", "salt").sortWithinPartitions("b", "salt", F.col("member").asc_nulls_first())


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]]:
    """Per batch of ``_beside`` the pairs: a, b, set of a, set of b, and whether each shingle of a is one of b's."""
    key = centre = None
    for batch in pieces(batches, "shingles", PIECE):
        met = []
        for b, salt, a, raw in zip(*(batch.column(k).to_pylist() for k in range(4))):
            s = np.frombuffer(raw, np.uint64)
            if a is None:
                key, centre = (b, salt), s
            elif key == (b, salt):
                at = np.minimum(np.searchsorted(centre, s), len(centre) - 1)
                met.append((a, b, s, centre, centre[at] == s))
        yield met


def verified(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT, per_task: int = 2_000) -> DataFrame:
    """The pairs (a, b) of classes that link: 100 * intersection >= percent * union. Each a is compared beside its b."""
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for met in _compared(batches):
            links = [(a, b) for a, b, s, c, same in met if 100 * (both := int(same.sum())) >= percent * (len(s) + len(c) - both)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], names=["a", "b"]
            )

    return _beside(pairs, sets, per_task).mapInArrow(compare, "a long, b long")


def differences(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """class, centre, differing, linked, token: for each pair (a, b), with b as the centre, a row for every shingle that only one of the
    two has; how many these are, and whether the two link. Sets that are not near, which differ in more shingles than a has, have no rows."""
    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for met in _compared(batches):
            own: list[list] = [[], [], [], []]
            tokens = []
            for a, b, s, c, same in met:
                both = int(same.sum())
                if len(c) > 2 * both:
                    continue
                apart = np.setxor1d(s, c, assume_unique=True)
                tokens.append(apart)
                for column, value in zip(own, (a, b, len(apart), 100 * both >= percent * (len(s) + len(c) - both))):
                    column.append(value)
            sizes = np.array(own[2], np.int64)
            kinds = (np.int64, np.int64, np.int64, bool)
            columns = [pa.array(np.repeat(np.array(v, k), sizes)) for v, k in zip(own, kinds)]
            flat = np.concatenate(tokens) if tokens else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(_signed(flat))], names=["class", "centre", "differing", "linked", "token"])

    return _beside(pairs, sets).mapInArrow(tell, "class long, centre long, differing long, linked boolean, token long")


def clusters(first: DataFrame) -> DataFrame:
    """class, centre: of the classes that ``first`` (a, b) connects, directly or not, the one that most chose."""
    parts = components(first, "jaccard-clusters")
    chosen = first.groupBy("b").agg(F.count(F.lit(1)).alias("votes"))
    centres = chosen.join(parts, F.col("b") == F.col("node")).groupBy("component").agg(F.max(F.struct("votes", "b")).alias("best"))
    return parts.join(centres, "component").select(F.col("node").alias("class"), F.col("best.b").alias("centre"))


def join_similar(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, text_key (xxhash64 of the text), n_shingles, class, component_id for every row of ``docs`` (doc_id, text).

    Two documents link when 100 * intersection >= ``percent`` * union of their shingle sets; ``component_id`` is the smallest doc_id
    that links lead to, its own included. A-Z count as a-z; words are runs without white space; fewer words than a shingle
    make one shingle of the whole sequence. Null texts and texts without words have no shingles, no class and link with nothing.
    Repeated rows are rows of one class. Rows without doc_id take part, but name no component. Other columns are ignored. An
    empty table gives an empty result. Sets and shingles are told apart by 64-bit hashes.
    """
    sets = materialised(document_sets(docs, percent), "jaccard-sets")
    classes = materialised(
        sets.filter("class IS NOT NULL").groupBy("class", "doc_id", "text_key").agg(F.first("n_shingles").alias("n"), F.count(F.lit(1)).alias("rows"))
        .groupBy("class").agg(
            F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key", "rows")).alias("least"),
            F.first("n").alias("n"), F.sum("rows").alias("copies"),
        ).select(
            "class", F.col("least.doc_id").alias("rep"), F.col("least.text_key").alias("rep_key"), F.col("least.rows").alias("rep_rows"), "n", "copies"
        ), "jaccard-classes",
    )
    light = boundary([(r.n, r.c) for r in classes.groupBy("n").agg(F.count(F.lit(1)).alias("c")).collect()], percent)
    shared = materialised(shared_postings(postings(sets, light, percent)), "jaccard-shared")
    # Only classes with enough shared postings can link at all.
    need = F.when(F.col("heavy"), _spread_need(F.col("n"), percent)).otherwise(1)
    many = shared.groupBy("class", "heavy").agg(F.count(F.lit(1)).alias("many")).join(classes, "class").filter(F.col("many") >= need)
    able = materialised(many.select("class", "heavy", "rep", "rep_key", "rep_rows", "n"), "jaccard-able")
    one = able.drop("heavy").distinct()
    own_sets = materialised(class_sets(docs, one), "jaccard-shingles")
    first = materialised(first_links(shared, one, percent), "jaccard-first")
    links = materialised(verified(first, own_sets, percent), "jaccard-links")
    parts = components(links, "jaccard-parts")
    open_ = open_classes(shared, able, parts, clusters(first), percent)
    # A cluster with one such class has no pair of them. Classes that are not near their centre are left to the search across clusters.
    several = open_.groupBy("centre").agg(F.count(F.lit(1)).alias("members")).filter("members > 1").select("centre")
    members = open_.filter("class <> centre").join(several, "centre", "left_semi")
    apart = materialised(differences(members.select(F.col("class").alias("a"), F.col("centre").alias("b")), own_sets, percent), "jaccard-apart")
    near = apart.groupBy("class").agg(F.first("centre").alias("near"))
    open_ = open_.join(near, "class", "left").select("class", "n", "part", F.coalesce("near", "class").alias("centre"))
    # Pairs within a cluster and those across clusters, and the links to the centres.
    pairs = about_centre(apart, open_, percent).unionByName(across(open_, own_sets, percent))
    rest = verified(pairs, own_sets, percent).unionByName(
        apart.filter("linked").select(F.col("class").alias("a"), F.col("centre").alias("b")).distinct()
    )
    rest = materialised(rest, "jaccard-rest")
    if not rest.isEmpty():
        parts = components(links.unionByName(rest), "jaccard-parts")
    grouped = classes.join(parts, F.col("class") == F.col("node"), "left").select(
        "class", "rep", "copies", F.coalesce("component", "class").alias("component"), F.col("component").isNotNull().alias("linked")
    )
    least = grouped.filter("linked").groupBy("component").agg(F.min("rep").alias("component_id"))
    named = grouped.filter("linked").select("class", "component").join(least, "component").select("class", "component_id").unionByName(
        grouped.filter("NOT linked AND copies > 1").select("class", F.col("rep").alias("component_id"))
    )
    named = named.select(F.col("class").alias("named"), "component_id")
    return sets.join(named, F.col("class") == F.col("named"), "left").select(
        "doc_id", "text_key", "n_shingles", "class", F.coalesce("component_id", "doc_id").alias("component_id")
    )


def one_of_each_group(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest doc_id, and of rows that share it that of the smallest text_key.

    Rows whose texts have no words link with nothing and all stay, but repeated rows (equal id and text) leave one. Rows without doc_id
    stay only where their component has no row with one; of them too one of each component stays.
    """
    found = join_similar(docs, percent)
    group = [F.coalesce("component_id", "class"), F.when(F.col("class").isNull(), F.col("text_key"))]
    kept = found.groupBy(*[g.alias(f"g{i}") for i, g in enumerate(group)], F.col("component_id").isNull().alias("g2")).agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("first")
    ).select(F.col("first.doc_id").alias("k_id"), F.col("first.text_key").alias("k_key"))
    rows = found.groupBy("doc_id", "text_key").agg(F.count(F.lit(1)).alias("k_rows"))
    k_id, k_key, k_rows = (fresh_name(docs, c) for c in ("k_id", "k_key", "k_rows"))
    kept = kept.distinct().join(rows, F.col("k_id").eqNullSafe(F.col("doc_id")) & F.col("k_key").eqNullSafe(F.col("text_key")))
    kept = materialised(kept.select(F.col("k_id").alias(k_id), F.col("k_key").alias(k_key), F.col("k_rows").alias(k_rows)), "jaccard-kept")
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(k_id)) & F.xxhash64("text").eqNullSafe(F.col(k_key))
    left = docs.join(kept, same)
    once = left.filter(F.col(k_rows) == 1).select(*[F.col(f"`{c}`") for c in docs.columns])
    again = left.filter(F.col(k_rows) > 1).dropDuplicates([k_id, k_key]).select(*[F.col(f"`{c}`") for c in docs.columns])
    return once.unionByName(again)


def open_classes(shared: DataFrame, able: DataFrame, parts: DataFrame, centres: DataFrame, percent: int = PERCENT) -> DataFrame:
    """class, n, part, centre: the classes that share as many postings with other components as a link across needs. ``centre`` is
    that of their cluster; a class that is in none is its own."""
    nodes = able.join(parts, F.col("class") == F.col("node"), "left").select(
        "class", "heavy", "n", F.coalesce("component", "class").alias("part")
    )
    rows = shared.select("token", "heavy", "class").join(nodes, ["class", "heavy"])
    lists = rows.groupBy("token", "heavy").agg(F.min("part").alias("p0"), F.max("part").alias("p1"))
    spread = rows.join(lists.filter("p0 < p1").select("token", "heavy"), ["token", "heavy"], "left_semi")
    need = F.when(F.col("heavy"), _spread_need(F.col("n"), percent)).otherwise(1)
    enough = spread.groupBy("class", "heavy").agg(F.first("n").alias("n"), F.first("part").alias("part"), F.count(F.lit(1)).alias("many"))
    enough = enough.filter(F.col("many") >= need).groupBy("class").agg(F.first("n").alias("n"), F.first("part").alias("part"))
    return materialised(
        enough.join(centres, "class", "left").select("class", "n", "part", F.coalesce("centre", "class").alias("centre")), "jaccard-open"
    )


def _overlap(a: Column, b: Column, percent: int = PERCENT) -> Column:
    """Shingles that two sets of these sizes must share to link."""
    return F.ceil((a + b) * percent / (100 + percent))


def _limit(a: Column, b: Column, percent: int = PERCENT) -> Column:
    """Shingles that only one of two linked sets of these sizes may have."""
    return a + b - 2 * _overlap(a, b, percent)


def about_centre(apart: DataFrame, open_: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Pairs (a, b) of classes of one cluster that may link, found by what sets them apart from its centre C.

    A xor B = (A xor C) xor (B xor C), so the two link only if so many shingles of their differences are common that what is left fits
    the limit. Where one of them does not link with C, at least one is common: A xor C alone is larger than the limit leaves. (Where both
    do, they are in one component.) A shingle that no other difference has sets the two apart, and so does each that comes before the
    first common one in the order of both, rarest first. So random edits, which are alone in their difference, leave no pair.
    """
    whole = Window.partitionBy("centre", "token")
    rows = apart.withColumn("df", F.count(F.lit(1)).over(whole)).withColumn("own", F.count_if("linked").over(whole)).filter("df > 1 AND own < df")
    own = Window.partitionBy("class")
    rows = rows.drop("own").join(open_.select("class", "n", "part"), "class")
    rows = rows.withColumn("place", F.row_number().over(own.orderBy("df", "token")) - 1).withColumn(
        "alone", F.col("differing") - F.count(F.lit(1)).over(own)
    )
    widest = F.floor(F.col("n") * 100 / percent)
    kept = rows.filter(F.col("place") + F.col("alone") <= _limit(F.col("n"), widest, percent)).drop("df")
    kept = materialised(kept, "jaccard-about")
    other = kept.select(*[F.col(c).alias(f"{c}_2") for c in kept.columns])
    left = _limit(F.col("n"), F.col("n_2"), percent) - F.col("alone") - F.col("alone_2")
    return kept.join(
        other, (F.col("centre") == F.col("centre_2")) & (F.col("token") == F.col("token_2")) & (F.col("class") < F.col("class_2"))
        & (F.col("part") != F.col("part_2")) & ~(F.col("linked") & F.col("linked_2")) & (F.col("place") + F.col("place_2") <= left)
        & (F.abs(F.col("differing") - F.col("differing_2")) <= _limit(F.col("n"), F.col("n_2"), percent))
        & _similar_sizes(F.col("n"), F.col("n_2"), percent),
    ).select(F.col("class").alias("b"), F.col("class_2").alias("a")).distinct()


def across(open_: DataFrame, own_sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Pairs (a, b) of classes of different components and clusters that may link.

    The classes are compared on their whole sets, of which only the shingles count that two clusters have: a class keeps the rarest
    of these, so many that a partner with which it shares enough must have one of them, and it goes if it has fewer than it must
    share. Two classes are a pair only if they would link even if all shared shingles of the one with fewer were the other's too:
    their other shingles count as different, which they are.
    """
    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "shingles", _SLICE):
            raw = b.column("shingles").to_pylist()
            size = np.array([len(r) // 8 for r in raw], np.int64)
            rows = {c: pa.array(np.repeat(b.column(c).to_numpy(), size)) for c in ("class", "centre")}
            yield pa.RecordBatch.from_arrays(
                [pa.array(_signed(np.frombuffer(b"".join(raw), np.uint64))), *rows.values()], names=["token", *rows]
            )

    whole = own_sets.join(open_.hint("merge"), "class").select("class", "centre", "shingles").mapInArrow(
        spell, "token long, class long, centre long"
    )
    of_token = Window.partitionBy("token")
    whole = whole.withColumn("c0", F.min("centre").over(of_token)).withColumn("c1", F.max("centre").over(of_token)).withColumn(
        "df", F.count(F.lit(1)).over(of_token)).filter("c0 < c1").drop("c0", "c1", "centre")
    whole = materialised(whole, "jaccard-spread").join(open_.hint("merge"), "class")
    # A class that was read twice, its document being a repeated row, keeps twice as many rows, so still all it must.
    own = Window.partitionBy("class")
    least = F.floor((F.col("n") * percent + 99) / 100)
    kept = (
        whole.withColumn("rank", F.row_number().over(own.orderBy("df", "token"))).withColumn("many", F.count(F.lit(1)).over(own))
        .filter(F.col("rank") <= F.col("many") - least + 1)
        .groupBy("class", "n", "part", "centre", F.least("many", "n").alias("m"))
        .agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("list"))
        .withColumn("list", F.array_distinct(F.col("list.token")))
        .select("*", F.explode("list").alias("token"))
    )
    kept = materialised(kept, "jaccard-across")
    other = kept.select(*[F.col(c).alias(f"{c}_2") for c in ("token", "class", "n", "part", "centre", "m", "list")])
    can_link = F.least("m", "m_2") * 100 >= (F.col("n") - F.col("m") + F.col("n_2") - F.col("m_2") + F.greatest("m", "m_2")) * percent
    # Beyond the list of the class whose list ends first, fewer shingles are left than it must share.
    both = F.array_intersect("list", "list_2")
    most = F.greatest(*[F.floor((F.col(c) * percent + 99) / 100) for c in ("n", "n_2")])
    enough = F.size(both) >= _overlap(F.col("n"), F.col("n_2"), percent) - most + 1
    # Of all lists that a pair has in common the first makes the pair, so each comes once.
    return kept.join(
        other, (F.col("token") == F.col("token_2")) & (F.col("class") < F.col("class_2")) & (F.col("part") != F.col("part_2"))
        & (F.col("centre") != F.col("centre_2")) & can_link & enough & (F.get(both, F.lit(0)) == F.col("token")),
    ).select(F.col("class").alias("b"), F.col("class_2").alias("a"))
