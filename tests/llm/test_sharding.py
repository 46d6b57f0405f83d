"""Shards are even, slots gapless, and few keys move."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from hostpulse.llm import sharding


def placed(counts, shards, **kw):
    out = {}
    for tick, a, b, shard, slot in sharding.place(counts, shards, **kw):
        for k in range(a, b):
            out[tick, k] = (shard, slot + k - a)
    return out


@pytest.mark.parametrize("counts", [{}, {5: 1}, {5: 1000}, {t: t % 7 for t in range(500)}, {0: 10, 8191: 33, 17: 400}])
@pytest.mark.parametrize("shards", [1, 3, 40])
def test_rows_differ_by_one_and_slots_have_no_gap(counts, shards):
    out = placed(counts, shards)
    assert len(out) == sum(counts.values())
    load = Counter(s for s, _ in out.values())
    assert not out or max(load.values()) - min(load[s] for s in range(shards)) <= 1
    for s in range(shards):
        assert sorted(x for y, x in out.values() if y == s) == list(range(load[s]))


def test_with_slack_no_shard_exceeds_it_and_few_move():
    counts = {t: 20 for t in range(8192)}
    total = sum(counts.values())
    old, new = placed(counts, 40, slack=0.25), placed(counts, 41, slack=0.25)
    assert max(Counter(s for s, _ in old.values()).values()) <= 1.25 * total / 40 + 1
    assert sum(old[k][0] != new[k][0] for k in old) < 0.2 * total


def test_keys_stay_on_their_own_node_while_there_is_room():
    counts = {t: 1 for t in range(0, 8192, 64)}
    spots = sharding.ring(10)
    for tick, _, _, shard, _ in sharding.place(counts, 10, slack=9.0):
        assert shard == next((s for t, s in spots if t >= tick), spots[0][1])


def test_table(spark):
    rows = [(i, f"t{i}", i) for i in range(500)] + [(7, "same", 0)] * 300 + [(None, None, 1)] * 40
    docs = spark.createDataFrame(rows, "doc_id long, text string, Slot int").repartition(7)
    got = sharding.assign_shards(docs, "doc_id", 40).collect()
    assert sorted(((r.doc_id is None, r.doc_id or 0, r.text or "") for r in got)) == sorted((i is None, i or 0, t or "") for i, t, _ in rows)
    load = Counter(r.shard for r in got)
    assert len(load) == 40 and max(load.values()) - min(load.values()) <= 1
    assert all(sorted(r.slot for r in got if r.shard == s) == list(range(load[s])) for s in range(40))
    assert sharding.assign_shards(docs.limit(0), "doc_id", 4).count() == 0


def walked(ticks, shards):
    """Shard of each row (given by its tick, in order), walked one by one with no ranges: the law of ``place`` in its plainest form."""
    spots = sharding.ring(shards)
    room = [len(ticks) // shards + (s < len(ticks) % shards) for s in range(shards)]
    seen, rows = Counter(), []
    for t in ticks:
        first = next((i for i, (at, _) in enumerate(spots) if at >= t), 0)
        rows.append([t, seen[t], first, 0])
        seen[t] += 1
    out, waiting = {}, rows
    while waiting:
        left = []
        for row in sorted(waiting, key=lambda r: (r[3], r[0], r[1])):
            shard = spots[row[2]][1]
            if room[shard]:
                room[shard] -= 1
                out[row[0], row[1]] = shard
            else:
                left.append(row)
        for row in left:
            while True:
                row[2], row[3] = (row[2] + 1) % len(spots), row[3] + 1
                if room[spots[row[2]][1]]:
                    break
        waiting = left
    return out


@pytest.mark.parametrize("counts", [{5: 400, 6: 3}, {t: t % 5 for t in range(0, 8192, 7)}, {0: 10, 8191: 333, 17: 400, 4000: 90}])
@pytest.mark.parametrize("shards", [1, 3, 40])
def test_ranges_equal_a_walk_row_by_row(counts, shards):
    walk = walked([t for t, n in counts.items() for _ in range(n)], shards)
    assert {k: s for k, (s, _) in placed(counts, shards).items()} == walk


def test_shards_and_slots_do_not_depend_on_the_read_split(spark):
    rows = [(i % 400, f"t{i}", None) for i in range(900)] + [(7, "same", 0)] * 200 + [(None, f"n{i}", 1) for i in range(500)]
    rows.append((1, "long " * 200_000, 2))
    docs = spark.createDataFrame(rows, "doc_id long, text string, part int")

    def spots(df):
        out = {}
        for r in sharding.assign_shards(df, "doc_id", 40).select("doc_id", F.md5("text").alias("text"), "part", "shard", "slot").collect():
            out.setdefault((r.doc_id, r.text, r.part), set()).add((r.shard, r.slot))
        return out

    one = spots(docs.coalesce(1))
    assert sum(map(len, one.values())) == len(rows)
    assert one == spots(docs.repartition(7)) == spots(docs.orderBy(F.desc("text")).repartition(3))
