"""Lines and payloads are parsed once per row, with the results of the patterns applied one after the other."""

import re

from pyspark.sql import functions as F

from hostpulse.functions import text
from hostpulse.sources import ingest, lines

ODD = [
    ("m,a=1 t=\"x\ny\",value=2 5", ("m", {"a": "1"}, {"t": '"x\ny"', "value": "2"}, 5)),
    ("m value=1 5\n", ("m", {}, {"value": "1"}, 5)), ("m value=1 5\u0085", ("m", {}, {"value": "1"}, 5)),
    ("\nm value=1 5", None), ("a\nb\n5\nvalue=1", None), ("m,a=1\nvalue=1 5", None),
    ("m,a=1,b=2,a=3 x=1,value=2 5", ("m", {"b": "2", "a": "3"}, {"x": "1", "value": "2"}, 5)),
    (r"m,a=1,a\=b=2,a=3 value=1 5", ("m", {"a=b": "2", "a": "3"}, {"value": "1"}, 5)),
    ('m t="a,b=c",value=1 5', ("m", {}, {"t": '"a,b=c"', "value": "1"}, 5)), ("m   value=1   5  ", ("m", {}, {"value": "1"}, 5)),
    ("m$1,a=$2 value=$3 5", ("m$1", {"a": "$2"}, {"value": "$3"}, 5)),
]


def test_odd_lines(spark):
    rows = [(i, line) for i, (line, _) in enumerate(ODD)]
    got = {r.n: r for r in lines.parse_lines(spark.createDataFrame(rows, "n int, value string")).collect()}
    for i, (line, want) in enumerate(ODD):
        r = got[i]
        found = None if r.measurement is None else (r.measurement, r.tags, r.fields, r.clock)
        assert found == want and r._broken == (line if want is None else None), line


def test_a_line_is_matched_once(spark, tmp_path):
    (tmp_path / "date=2024-01-31" / "batch=0").mkdir(parents=True)
    (tmp_path / "date=2024-01-31" / "batch=0" / "a.txt").write_text("m,host=h value=1 5\n")
    made = lines.points(lines.read(spark, str(tmp_path)))
    assert made._jdf.queryExecution().executedPlan().toString().count(lines._LINE) == 1
    assert [(r.measurement, r.host, r.value, r.clock) for r in made.collect()] == [("m", "h", 1.0, 5)]


def test_a_payload_is_parsed_once(spark):
    raw = spark.createDataFrame([("{\"itemid\":1,\"clock\":5,\"value\":2,\"item_key\":\"k\",\"table_type\":\"history\"}",), ("no",), (None,)], "raw string")
    routed = ingest.route_events(ingest.parse_events(raw))
    assert sorted(r.route for r in routed.collect()) == ["broken", "invalid", "stored"]
    plan = ingest.stored_points(ingest.route_events(ingest.parse_events(raw.repartition(2))))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("from_json") == 1


def test_names(spark):
    keys = ["vm.memory[a,,b]", "__a__b__", "___", "a", "ü.é", "a_b", "_a\n", "\U0001F600x\U0001F600", "a-_-b", " ", "9"]

    def stepwise(k):
        for pattern, by in ((r"[^a-zA-Z0-9_]", "_"), (r"__+", "_"), (r"^_+", ""), (r"_+$", "")):
            k = re.sub(pattern, by, k)
        return k

    df = spark.createDataFrame([(k,) for k in keys], "k string").select("k", text.measurement_name(F.col("k")).alias("name"))
    assert {r.k: r.name for r in df.collect()} == {k: stepwise(k) for k in keys}
