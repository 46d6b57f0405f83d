"""Line protocol read back: escapes, types, broken lines, day pruning, streams; split relational reads cover each row once."""

import pytest
from pyspark.sql import functions as F

from hostpulse.sources import lines

LINES = [
    ("cpu,host=h-1,unit=% value=1.5 1706659200", ("cpu", {"host": "h-1", "unit": "%"}, {"value": "1.5"}, 1706659200)),
    ("cpu value=3i,other=t 5", ("cpu", {}, {"value": "3i", "other": "t"}, 5)),
    (r"my\ name,a\,b=c\=d\ e value=-2e3 -7", ("my name", {"a,b": "c=d e"}, {"value": "-2e3"}, -7)),
    (r'log,host=x text="a, b=\"c\" d",value=1 9', ("log", {"host": "x"}, {"text": r'"a, b=\"c\" d"', "value": "1"}, 9)),
    ("m,a=1,a=2 value=1,value=2 3", ("m", {"a": "2"}, {"value": "2"}, 3)),
    ("no_time value=1", None), ("no_field 12", None), ("m,broken value=1 12", None), ("m value= 12", None),
    ("m value=1 99999999999999999999", None), ("m value=1 12 13", None), ("größe,host=ü value=1u 4", ("größe", {"host": "ü"}, {"value": "1u"}, 4)),
    ("m,t=" + "x" * 20_000 + " value=1 1", ("m", {"t": "x" * 20_000}, {"value": "1"}, 1)),
]


def test_lines_are_parsed_or_marked(spark):
    rows = [(i, line) for i, (line, _) in enumerate(LINES)] + [(90, None), (91, ""), (92, "  "), (93, "# comment")]
    got = {r.n: r for r in lines.parse_lines(spark.createDataFrame(rows, "n int, value string")).collect()}
    assert sorted(got) == list(range(len(LINES)))
    for i, (line, want) in enumerate(LINES):
        r = got[i]
        assert (r._broken == line and r.measurement is None and r.tags is None) if want is None else (
            r._broken is None and (r.measurement, r.tags, r.fields, r.clock) == want
        ), line


def test_numbers_and_precisions(spark):
    texts = [("1.5", 1.5), ("-3i", -3.0), ("7u", 7.0), ("t", 1.0), ("FALSE", 0.0), (".5", 0.5), ("1e3", 1000.0), ('"1"', None), ("nan", None), (None, None)]
    got = spark.createDataFrame(texts, "t string, want double").select("want", lines.number(F.col("t")).alias("got"))
    assert [r.got for r in got.collect()] == [w for _, w in texts]
    df = spark.createDataFrame([("m value=1 1706659200999",), ("m value=1 -1",)], "value string")
    assert [r.clock for r in lines.parse_lines(df, precision="ms").collect()] == [1706659200, -1]


DAY = 86400
START = 1706659200 - 1706659200 % DAY


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("lines") / "store")
    rows = spark.range(4000).select(
        F.lit("cpu").alias("measurement"), F.concat(F.lit("h"), F.col("id") % 3).alias("host"), F.col("id").cast("string").alias("item_id"),
        F.lit("numeric").alias("data_type"), F.when(F.col("id") % 5 > 0, "%").alias("unit"), (F.col("id") / 7).alias("value"),
        (F.lit(START) + F.col("id") * 300).alias("clock"),
    )
    lines.write_dated(rows, path)
    lines.write_dated(rows.where(F.col("clock") < START + DAY).withColumn("value", F.lit(-1.0)), path, batch="1")
    lines.write_dated(rows.where(F.col("clock") < START + DAY).withColumn("value", F.lit(-2.0)), path, batch="1")
    return path, rows


def test_bounds_reach_the_folders(spark, stored):
    path, rows = stored
    start, end = START + 3 * DAY + 1000, START + 5 * DAY
    got = lines.read(spark, path, start, end)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "date" in plan[plan.index("PartitionFilters") :].split("]")[0]
    days = {f.split("date=")[1][:10] for f in got.inputFiles()}
    assert len(days) >= 2
    scanned = got.select("date").distinct().count()
    assert scanned == 2
    columns = ["measurement", "host", "item_id", "data_type", "unit", "value", "clock"]
    same = rows.where(F.col("clock").between(start, end - 1)).select(columns)
    back = lines.points(got).select(columns)
    assert back.count() == same.count() and back.exceptAll(same).count() == 0


def test_a_batch_replaces_itself(spark, stored):
    path, rows = stored
    again = lines.points(lines.read(spark, path)).where("batch = '1'")
    assert again.count() == DAY // 300 and again.where("value <> -2").count() == 0
    assert lines.points(lines.read(spark, path)).where("batch = '0'").count() == 4000


def test_the_stream_reads_the_same(spark, stored, tmp_path):
    path, _ = stored
    query = lines.points(lines.stream(spark, path, START + DAY, files=3)).writeStream.format("parquet").option(
        "checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "out"))
    query.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    want = lines.points(lines.read(spark, path, START + DAY)).select(got.columns)
    assert got.count() == want.count() == 4000 - DAY // 300 and got.exceptAll(want).count() == 0


@pytest.mark.parametrize("start, end, parts", [(0, 100, 7), (-50, 51, 10), (5, 5, 4), (0, 3, 10), (0, 10**12, 3)])
def test_each_row_meets_one_range(spark, start, end, parts):
    values = [None, start - 9, start, start + 1, (start + end) // 2, end - 1, end, end + 9, *range(0, 100, 3)]
    df = spark.createDataFrame([(v,) for v in values], "clock long")
    tests = lines.range_predicates("clock", start, end, parts)
    assert len(tests) == max(1, min(parts, end - start))
    met = df.select(sum(F.expr(f"CASE WHEN {p} THEN 1 ELSE 0 END") for p in tests).alias("n"))
    assert {r.n for r in met.collect()} == {1}
    with pytest.raises(ValueError):
        lines.range_predicates("clock", start, end, 0)
