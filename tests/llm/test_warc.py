"""Archives come back as written; damage costs the damaged records only and is reported."""

import base64
import hashlib
import random

import pytest

from hostpulse.llm import warc


def archive(n, packed=True):
    rng = random.Random(n)
    parts = []
    for i in range(n):
        data = warc.record(str(i), f"http://x/{i}", bytes(rng.choices(range(256), k=200 + i)) + b"WARC/1.1\r\n\x1f\x8b\x08", i, None)
        parts.append(warc.packed(data) + warc.SEPARATOR if packed else data)
    return parts


@pytest.mark.parametrize("packed", [True, False])
def test_whole_archives(packed):
    parts = archive(30, packed)
    found = list(warc.salvage(b"".join(parts)))
    assert [f.headers["x-page-id"] for f in found] == [str(i) for i in range(30)]


@pytest.mark.parametrize("packed", [True, False])
@pytest.mark.parametrize("seed", range(25))
def test_damage_is_a_gap_and_later_records_come_back(packed, seed):
    rng = random.Random(seed)
    parts = archive(20, packed)
    bad = rng.randrange(20)
    kind = rng.choice(["flip", "cut", "junk", "end"])
    if kind == "flip":
        at = rng.randrange(20, len(parts[bad]) - 40)
        parts[bad] = parts[bad][:at] + bytes([parts[bad][at] ^ 0x55]) + parts[bad][at + 1 :]
    elif kind == "cut":
        parts[bad] = parts[bad][: len(parts[bad]) // 2]
    elif kind == "junk":
        parts.insert(bad, b"\x1f\x8b\x08 junk WARC/1.1\r\nno: header\r\n" * 3)
    else:
        parts[-1], bad = parts[-1][:40], 19
    data = b"".join(parts)
    found = list(warc.salvage(data))
    good = [f for f in found if f.headers is not None]
    gaps = [f for f in found if f.headers is None]
    want = [str(i) for i in range(20) if i != bad or kind == "junk"]
    if not (kind == "flip" and len(good) == 20):  # a flip in a header field that nothing checks
        assert [f.headers["x-page-id"] for f in good] == want
        assert gaps and all(g.reason and g.length > 0 for g in gaps)
    spots = [(f.offset, f.offset + f.length) for f in found]
    assert spots == sorted(spots) and all(b <= c for (_, b), (c, _) in zip(spots, spots[1:]))


def test_table(spark, tmp_path):
    rows = [(5, "http://a", "same"), (3, "http://b", "same"), (9, None, "same"), (1, "x\r\ny", None), (2, "", ""), (7, "u", "é" * 1000), (None, "n", "only"), (4, "q", "twice"), (4, "q", "twice"), (None, "n", "same")]
    pages = spark.createDataFrame([(*r, 0) for r in rows], "page_id long, url string, html string, payload int").repartition(4)
    warc.write_archives(pages, str(tmp_path / "w"), records=2)
    got = warc.read_archives(spark, str(tmp_path / "w")).collect()
    assert len(got) == len(rows) and all(r.gap_reason is None for r in got)
    by = {}
    for r in got:
        by.setdefault(r.page_id, []).append(r)
    assert by["3"][0].warc_type == "response" and bytes(by["3"][0].payload) == b"same"
    assert [(by[p][0].warc_type, by[p][0].refers_to_page_id, by[p][0].payload_bytes) for p in ("5", "9")] == [("revisit", "3", 4)] * 2
    assert by["1"][0].warc_type == "response" and by["2"][0].refers_to_page_id == "1"
    assert sorted(r.warc_type for r in by["4"]) == ["response", "revisit"]
    assert by["7"][0].payload_digest == base64.b32encode(hashlib.sha1(("é" * 1000).encode()).digest()).decode()
    assert sorted((r.warc_type, r.refers_to_page_id) for r in by[None]) == [("response", None), ("revisit", "3")]
    warc.write_archives(pages.limit(0), str(tmp_path / "none"))
    assert warc.read_archives(spark, str(tmp_path / "none")).count() == 0


def test_smaller_payloads_are_all_responses(spark, tmp_path):
    pages = spark.createDataFrame([(1, "a", "xx"), (2, "a", "xx"), (3, "a", "long one"), (4, "a", "long one")], "page_id long, url string, html string")
    warc.write_archives(pages, str(tmp_path / "w"), least=5)
    assert sorted((r.page_id, r.warc_type) for r in warc.read_archives(spark, str(tmp_path / "w")).collect()) == [
        ("1", "response"), ("2", "response"), ("3", "response"), ("4", "revisit")]


def test_long_urls_come_back(spark, tmp_path):
    rows = [(1, "http://x/" + "a" * 70_000, "one"), (2, "data:" + "é " * 200_000, "two"), (3, "u", "three")]
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), str(tmp_path / "w"))
    got = warc.read_archives(spark, str(tmp_path / "w")).collect()
    assert sorted((r.page_id, r.gap_reason, bytes(r.payload)) for r in got) == [("1", None, b"one"), ("2", None, b"two"), ("3", None, b"three")]
    assert next(r for r in got if r.page_id == "1").target_uri == rows[0][1]


def test_damage_inside_a_member_costs_one_record():
    parts = archive(9, packed=False)
    parts[4] = parts[4][:-30] + bytes([parts[4][-30] ^ 0x55]) + parts[4][-29:]
    member = warc.packed(b"".join(parts))
    after = warc.packed(archive(10, packed=False)[9])
    found = list(warc.salvage(member + after))
    assert [f.headers["x-page-id"] if f.headers else "gap" for f in found] == ["0", "1", "2", "3", "gap", "5", "6", "7", "8", "9"]
    assert (found[4].offset, found[4].length, found[4].inner) == (0, len(member), sum(map(len, parts[:4]))) and found[4].reason


@pytest.mark.parametrize("cut", [True, False])
@pytest.mark.parametrize("last", [True, False])
def test_records_ahead_of_the_damage_of_a_member_come_back(cut, last):
    parts = archive(12, packed=False)
    ahead, member = warc.packed(b"".join(parts[:6])), warc.packed(b"".join(parts))
    member = member[: len(member) * 2 // 3] if cut else member[: len(member) * 2 // 3] + b"\xff" * 40 + member[len(member) * 2 // 3 + 40 :]
    found = list(warc.salvage(member + (b"" if last else warc.packed(archive(13, packed=False)[12]))))
    pages = [f.headers["x-page-id"] for f in found if f.headers is not None]
    assert len(ahead) < len(member) and pages[:6] == [str(i) for i in range(6)] and ("12" in pages) == (not last)
    gap = next(f for f in found if f.headers is None)
    assert gap.offset == 0 and gap.reason and gap.inner >= sum(map(len, parts[:6]))
