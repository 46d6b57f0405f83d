"""Line protocol as a source: dated text folders, batch and stream, and split relational reads.

A line is ``name,tag=value,... field=value,... time``. Reading is Spark's text reader and column functions, so files are found,
split and listed as Spark does it anywhere, and a time bound prunes the day folders before any line is read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hostpulse.session import computed_once
from hostpulse.sources import ingest

STORED = "value string, date date, batch string"
#: Units of a line's time in one second.
PRECISIONS = {"s": 1, "ms": 1_000, "us": 1_000_000, "ns": 1_000_000_000}
#: Runs of plain characters are taken whole, so that a match goes no deeper than a line has escapes and pairs.
_KEY = r"(?:[^\s,=\\]++|\\.)++"
_PLAIN = r"(?:[^\s,=\"\\]++|\\.)++"
_TEXT = r'"(?:[^"\\]++|\\.)*+"'
_FIELD = f"{_KEY}=(?:{_TEXT}|{_PLAIN})"
_LINE = rf"^((?:[^\s,\\]++|\\.)++)((?:,{_KEY}={_KEY})*) +({_FIELD}(?:,{_FIELD})*) +(-?[0-9]+)\s*$"
POINT_TAGS = ("host", "item_id", "data_type", "unit")


def _unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([ ,=\"\\])", "$1")


def _pairs(text: Column, pattern: str, escaped: bool) -> Column:
    """Key and value pairs as a map, values with their escapes resolved or not; of a key that comes again the last value counts.

    Where nothing is escaped or quoted and no key comes again, commas and equal signs alone divide the text.
    """
    keys = F.split(F.regexp_replace(text, "=[^,]*", ""), ",")
    plain = ~F.contains(text, F.lit("\\")) & ~F.contains(text, F.lit('"')) & (F.size(F.array_distinct(keys)) == F.size(keys))
    return (
        F.when(text == "", F.create_map().cast("map<string,string>"))
        .when(plain, F.str_to_map(text, F.lit(","), F.lit("=")))
        .otherwise(_pairs_in_full(text, pattern, escaped))
    )


def _pairs_in_full(text: Column, pattern: str, escaped: bool) -> Column:
    halves = rf"^({_KEY})=((?s:.*))$"
    told = _unescaped if escaped else (lambda c: c)
    found = F.transform(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        lambda p: F.struct(
            _unescaped(F.regexp_extract(p, halves, 1)).alias("key"),
            told(F.regexp_extract(p, halves, 2)).alias("value"),
        ),
    )
    last = F.filter(found, lambda p, i: ~F.exists(F.slice(found, i + 2, F.size(found)), lambda q: q["key"] == p["key"]))
    return F.map_from_entries(last)


def parse_lines(lines: DataFrame, raw: str = "value", precision: str = "s") -> DataFrame:
    """Columns ``measurement``, ``tags``, ``fields`` (text as written), ``clock`` (seconds, floored) and ``_broken`` in place of the line.

    Backslashes escape blanks, commas, equal signs and quotes. A line that is no point keeps its text in ``_broken`` and is null
    otherwise; so is one without a time, as the store would have to invent it. Blank lines, comments and nulls are left out.
    """
    text, unit = F.col(raw), PRECISIONS[precision]
    rest = [F.col(c) for c in lines.columns if c != raw]
    kept = lines.where(text.isNotNull() & ~text.rlike(r"^\s*(#|$)"))
    # One match cuts a line: name, tags and time hold no line break, so fields, which may, come last. No point has a break after
    # its name, so what is equal to its line was not cut.
    cut = computed_once(kept.select(*rest, text.alias("_line")), F.regexp_replace("_line", _LINE + "(?s:.*)", "$1\n$2\n$4\n$3"), "_cut")
    good, part = F.col("_cut") != F.col("_line"), F.split("_cut", "\n", 4)
    parsed = cut.select(
        *rest, "_line",
        F.when(good, _unescaped(F.get(part, F.lit(0)))).alias("_name"),
        F.when(good, _pairs(F.substr(F.get(part, F.lit(1)), F.lit(2)), f"{_KEY}={_KEY}", True)).alias("_tags"),
        F.when(good, _pairs(F.get(part, F.lit(3)), _FIELD, False)).alias("_fields"),
        F.when(good, F.get(part, F.lit(2)).try_cast("bigint")).alias("_clock"),
    )
    out = computed_once(parsed, F.struct("_name", "_tags", "_fields", "_clock", "_line"), "_p")
    broken = F.col("_p._clock").isNull()  # no match, or a time beyond 64 bits
    return out.select(
        *rest,
        *[F.when(~broken, F.col(f"_p.{c}")).alias(n) for c, n in (("_name", "measurement"), ("_tags", "tags"), ("_fields", "fields"))],
        F.expr(f"(_p._clock - pmod(_p._clock, {unit}L)) div {unit}L").alias("clock"),
        F.when(broken, F.col("_p._line")).alias("_broken"),
    )


def number(field: Column) -> Column:
    """A field as a double: floats, integers (``3i``), unsigned ones (``3u``), truth as 1 and 0; other text is null."""
    return (
        F.when(field.rlike(r"^[-+]?([0-9]+[iu]|[0-9]+\.?[0-9]*([eE][-+]?[0-9]+)?|\.[0-9]+([eE][-+]?[0-9]+)?)$"),
               F.regexp_replace(field, "[iu]$", "").try_cast("double"))
        .when(field.rlike(r"^(t|T|true|True|TRUE)$"), 1.0)
        .when(field.rlike(r"^(f|F|false|False|FALSE)$"), 0.0)
    )


def points(parsed: DataFrame, tags: tuple[str, ...] = POINT_TAGS, field: str = "value") -> DataFrame:
    """Stored points of parsed lines: one column per tag (null where a line lacks it) and the number of one field."""
    rest = [c for c in parsed.columns if c not in ("measurement", "tags", "fields", "clock", "_broken")]
    return parsed.where(F.col("_broken").isNull() & F.map_contains_key("fields", F.lit(field))).select(
        "measurement", *[F.col("tags")[t].alias(t) for t in tags], number(F.col("fields")[field]).alias("value"), "clock", *rest
    )


def write_dated(points_: DataFrame, path: str, batch: str = "0") -> None:
    """Lines in one folder per day and batch. A batch that is written again replaces itself on the days it has."""
    tagged = points_.select("*", F.to_date(F.timestamp_seconds("clock")).alias("date"))
    line = ingest.line_protocol(tagged, keep=("date",)).withColumnRenamed("line", "value")
    line.withColumn("batch", F.lit(batch)).hint("rebalance", "date").write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy("date", "batch").text(path)


def _bounded(stored: DataFrame, start: int | None, end: int | None) -> DataFrame:
    """Days that can hold times in [start, end)."""
    for bound, low in ((start, True), (None if end is None else end - 1, False)):
        if bound is not None:
            day = F.to_date(F.timestamp_seconds(F.lit(bound)))
            stored = stored.where(F.col("date") >= day if low else F.col("date") <= day)
    return stored


def _timed(parsed: DataFrame, start: int | None, end: int | None) -> DataFrame:
    if start is not None:
        parsed = parsed.where(F.col("_broken").isNotNull() | (F.col("clock") >= start))
    return parsed if end is None else parsed.where(F.col("_broken").isNotNull() | (F.col("clock") < end))


def read(spark: SparkSession, path: str, start: int | None = None, end: int | None = None) -> DataFrame:
    """Parsed lines of the dated folders with times in [start, end); broken lines of these days stay, marked."""
    return _timed(parse_lines(_bounded(spark.read.schema(STORED).text(path), start, end)), start, end)


def stream(spark: SparkSession, path: str, start: int | None = None, files: int = 1_000) -> DataFrame:
    """The same as a stream of newly written files, at most ``files`` a batch."""
    stored = spark.readStream.schema(STORED).option("maxFilesPerTrigger", files).text(path)
    return _timed(parse_lines(_bounded(stored, start, None)), start, None)


def range_predicates(column: str, start: int, end: int, parts: int) -> list[str]:
    """Conditions for a relational read in ``parts`` tasks: even ranges of [start, end), what lies outside with the first and the last.

    Every row meets exactly one, rows without a value the first. Pass them as ``predicates`` to ``spark.read.jdbc``.
    """
    if parts < 1 or end < start:
        raise ValueError("at least one part, and an end that is not before the start")
    parts = max(1, min(parts, end - start))
    cuts = [start + (end - start) * i // parts for i in range(1, parts)]
    if not cuts:
        return ["1 = 1"]
    inner = [f"{column} >= {a} AND {column} < {b}" for a, b in zip(cuts, cuts[1:])]
    return [f"{column} < {cuts[0]} OR {column} IS NULL", *inner, f"{column} >= {cuts[-1]}"]
