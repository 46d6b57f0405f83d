"""The monitoring relations, derived by Spark from the ``events`` table.

``events`` stands for raw samples of ten hosts and five items per host. Every view is a
lazy DataFrame over the whole table.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hostpulse.session import materialised, prepare

AS_OF = 1706659200  # 2024-01-31 00:00:00 UTC, the fixed "now" of the derived data
HOUR = 3600
SAMPLE_TYPE = "host-metrics"

ITEM_KEYS = {
    "click": "system.cpu.util[,user]",
    "view": "vm.memory.utilization",
    "purchase": 'net.if.out["eth0"]',
    "signup": "proc.num[,,run]",
    "error": "system.cpu.load[all,avg1]",
}
MEASUREMENTS = {
    "click": "system_cpu_util_user",
    "view": "vm_memory_utilization",
    "purchase": "net_if_out_eth0",
    "signup": "proc_num_run",
    "error": "system_cpu_load_all_avg1",
}
ITEM_UNITS = {"click": "%", "view": "%", "purchase": "bps", "signup": "", "error": ""}
METRICS = list(MEASUREMENTS.values())


def _by_type(texts: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in texts.items() for x in kv]), F.col("event_type"))


class Tables:
    """Views over one data folder; each is built once per instance and never cached."""

    def __init__(self, spark: SparkSession, folder: str, start: int | None = None, whole: Tables | None = None):
        self.spark = prepare(spark)
        self.folder = folder
        self._start, self._whole = start, whole
        self._written: dict[str, DataFrame] = {}

    def since(self, start: int) -> Tables:
        """The same views of samples from ``start`` on. The bound is on the stored time, so the scan prunes by it.

        Hosts, items, triggers and functions stay those of all samples.
        """
        return Tables(self.spark, self.folder, start, self)

    def written(self, view: str) -> DataFrame:
        """A view written once and read back, for operators that pass over their input several times."""
        if view not in self._written:
            self._written[view] = materialised(getattr(self, view), view)
        return self._written[view]

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def base(self) -> DataFrame:
        """One raw sample per row."""
        events = self.table("events")
        if self._start is not None:
            events = events.where(F.col("ts") >= F.timestamp_seconds(F.lit(self._start)).cast(dict(events.dtypes)["ts"]))
        return base_samples(events)

    @cached_property
    def dimensions(self) -> DataFrame:
        """Hosts with their items, a row per item: one pass over all samples, written once."""
        if self._whole is not None:
            return self._whole.dimensions
        return materialised(self.base.select("hostid", "host", "itemid", "key_", "event_type").distinct(), "dimensions")

    @cached_property
    def samples(self) -> DataFrame:
        """Stored samples: one per series and second, the latest written wins."""
        from hostpulse.operators.dedupe import latest_per_second

        return latest_per_second(self.base.select("host", "measurement", "clock", "value", "event_id"), "event_id").drop(
            "event_id"
        )

    @cached_property
    def hosts(self) -> DataFrame:
        return self.dimensions.select("hostid", "host").distinct().select(
            "hostid",
            "host",
            F.concat(F.lit("Host "), F.col("hostid")).alias("name"),
            (F.col("hostid") == 9).cast("int").alias("status"),
        )

    @cached_property
    def items(self) -> DataFrame:
        return self.dimensions.select(
            "itemid",
            "hostid",
            "key_",
            F.col("key_").alias("name"),
            _by_type(ITEM_UNITS).alias("units"),
            (F.col("itemid") == 84).cast("int").alias("status"),
        )

    @cached_property
    def history(self) -> DataFrame:
        return self.base.where(F.col("event_type").isin("click", "view", "error")).select(
            "itemid", "clock", "value", F.lit(0).alias("ns"), "event_id"
        )

    @cached_property
    def history_uint(self) -> DataFrame:
        return self.base.where(F.col("event_type").isin("purchase", "signup")).select(
            "itemid", "clock", F.floor("value").cast("bigint").alias("value"), F.lit(0).alias("ns"), "event_id"
        )

    @cached_property
    def triggers(self) -> DataFrame:
        watched = self.items.where(F.col("key_").isin(ITEM_KEYS["click"], ITEM_KEYS["error"]))
        return watched.select(
            (F.lit(1000) + F.col("itemid")).alias("triggerid"),
            F.concat(F.lit("High "), F.col("name")).alias("description"),
            F.concat(F.lit("last("), F.col("key_"), F.lit(")>100")).alias("expression"),
            (F.col("itemid") % 6).cast("int").alias("priority"),
            F.lit(0).alias("status"),
        )

    @cached_property
    def functions(self) -> DataFrame:
        """One function per trigger, two where the trigger watches processor load."""
        one = self.triggers.select(
            (F.col("triggerid") * 10).alias("functionid"), "triggerid", (F.col("triggerid") - 1000).alias("itemid")
        )
        second = self.triggers.where(F.contains("description", F.lit("cpu.load"))).select(
            (F.col("triggerid") * 10 + 1).alias("functionid"), "triggerid", (F.col("triggerid") - 1000).alias("itemid")
        )
        return one.unionByName(second)

    @cached_property
    def problems(self) -> DataFrame:
        """Trigger events: watched samples above 100."""
        hit = F.col("event_type").isin("error", "click") & (F.col("value") > 100)
        return self.base.where(hit).select(
            F.col("event_id").alias("eventid"),
            (F.lit(1000) + F.col("itemid")).alias("objectid"),
            "clock",
            F.lit(1).alias("value"),
            F.least(F.lit(5), F.floor(F.col("value") / 80)).cast("int").alias("severity"),
            (F.col("event_id") % 2).cast("int").alias("acknowledged"),
            F.when(F.col("event_id") % 7 == 0, 3).otherwise(0).alias("source"),
        )

    @cached_property
    def alerts(self) -> DataFrame:
        """One notification per trigger event of severity 2 and above."""
        return self.problems.where(F.col("severity") >= 2).select(
            (F.col("eventid") * 10).alias("alertid"),
            "eventid",
            (F.col("clock") + 30).alias("clock"),
            F.lit("ops@example.org").alias("sendto"),
            F.lit("Problem").alias("subject"),
            F.lit("over 100").alias("message"),
            F.lit(1).alias("status"),
        )

    @cached_property
    def alert_times(self) -> DataFrame:
        """Host and time of each alert, for labelling."""
        return (
            self.alerts.select("eventid", F.col("clock").alias("alert_clock"))
            .join(self.problems.select("eventid", "objectid"), "eventid")
            .join(self.triggers.select(F.col("triggerid").alias("objectid"), (F.col("triggerid") - 1000).alias("itemid")), "objectid")
            .join(self.items.select("itemid", "hostid"), "itemid")
            .join(self.hosts.select("hostid", "host"), "hostid")
            .select("host", "alert_clock")
        )

    @cached_property
    def hourly(self) -> DataFrame:
        """Hourly means in long form: the usual input of windows, features and detectors."""
        return self.base.groupBy(
            "host", "measurement", F.expr(f"clock div {HOUR}L * {HOUR}L").alias("clock")
        ).agg(F.round(F.avg("value"), 8).alias("value"))

    @cached_property
    def wide(self) -> DataFrame:
        """Hourly means in sparse wide form."""
        return self.hourly.groupBy("host", "clock").pivot("measurement", METRICS).agg(F.first("value"))

    @cached_property
    def raw(self) -> DataFrame:
        """JSON payloads with broken lines, missing values and unknown table types."""
        number = F.when(F.col("event_id") % 33 == 0, F.lit("")).otherwise(
            F.concat(F.lit(',"value":'), F.col("value").cast("string"))
        )
        kind = (
            F.when(F.col("event_id") % 41 == 0, "trends")
            .when(F.col("event_type").isin("purchase", "signup"), "history_uint")
            .otherwise("history")
        )
        payload = F.concat(
            F.lit(f'{{"type":"{SAMPLE_TYPE}","itemid":'), F.col("itemid"), F.lit(',"clock":'), F.col("clock"), number,
            F.lit(',"ns":0,"item_key":"'), F.translate("key_", '"', ""), F.lit('","units":"%","hostname":"'),
            F.col("host"), F.lit('","table_type":"'), kind, F.lit('"}'),
        )
        return self.base.select(
            "event_id", F.when(F.col("event_id") % 50 == 0, F.lit("not json")).otherwise(payload).alias("raw")
        )

    @cached_property
    def scores(self) -> DataFrame:
        """Given detector outputs per sample, for votes, confidence, severity and KPIs."""
        a, b = (F.col("event_id") * 37) % 101, (F.col("event_id") * 53) % 97
        return self.base.select(
            "event_id", "host", "clock",
            (a.cast("double") / 100).alias("if_score"),
            (b.cast("double") / 96).alias("lof_score"),
            (a < 10).cast("int").alias("if_flag"),
            (b < 10).cast("int").alias("lof_flag"),
            (F.col("value") > 100).cast("int").alias("stat_flag"),
            (F.col("event_type") == "error").cast("int").alias("label"),
        )

    @cached_property
    def forecast(self) -> DataFrame:
        """Given forecasts per host, metric, model and hour."""
        return self.hourly.select(
            "host",
            F.col("measurement").alias("metric"),
            F.when(F.col("clock") % 7200 == 0, "additive").otherwise("arima").alias("model"),
            F.col("clock").alias("ds"),
            F.col("value").alias("yhat"),
            (F.col("value") - 5).alias("yhat_lower"),
            (F.col("value") + 5).alias("yhat_upper"),
        )

    @cached_property
    def registry(self) -> DataFrame:
        """Model versions of different age; the models of one metric are all old."""
        day = F.when((F.col("hostid") < 5) & (F.col("event_type") != "view"), "30_2").otherwise("28_0")
        return self.base.select(
            F.col("measurement").alias("model_name"),
            F.concat(F.lit("1.0_202401"), day, F.col("hostid") % 4, F.lit("0000")).alias("version"),
            F.col("hostid").alias("training_samples"),
        ).distinct()


def base_samples(events: DataFrame) -> DataFrame:
    """Samples from ``events`` rows, batch or stream."""
    type_index = F.element_at(
        F.create_map(*[F.lit(x) for i, t in enumerate(ITEM_KEYS, start=1) for x in (t, i)]), F.col("event_type")
    )
    hostid = F.col("user_id") % 10
    return events.select(
        "event_id",
        F.unix_seconds(F.col("ts").cast("timestamp")).alias("clock"),
        hostid.alias("hostid"),
        F.concat(F.lit("host-"), hostid).alias("host"),
        (hostid * 10 + type_index).alias("itemid"),
        _by_type(ITEM_KEYS).alias("key_"),
        _by_type(MEASUREMENTS).alias("measurement"),
        "event_type",
        "value",
    )


# The same views in DuckDB, put in front of every check query.
ORACLE_VIEWS = """
base AS (
  SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS clock, user_id % 10 AS hostid,
         concat('host-', user_id % 10) AS host,
         (user_id % 10) * 10 + CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 WHEN 'purchase' THEN 3
                                               WHEN 'signup' THEN 4 WHEN 'error' THEN 5 END AS itemid,
         CASE event_type WHEN 'click' THEN 'system.cpu.util[,user]' WHEN 'view' THEN 'vm.memory.utilization'
              WHEN 'purchase' THEN 'net.if.out["eth0"]' WHEN 'signup' THEN 'proc.num[,,run]'
              WHEN 'error' THEN 'system.cpu.load[all,avg1]' END AS key_,
         CASE event_type WHEN 'click' THEN 'system_cpu_util_user' WHEN 'view' THEN 'vm_memory_utilization'
              WHEN 'purchase' THEN 'net_if_out_eth0' WHEN 'signup' THEN 'proc_num_run'
              WHEN 'error' THEN 'system_cpu_load_all_avg1' END AS measurement,
         event_type, value
  FROM events),
samples AS (
  SELECT host, measurement, clock, arg_max(value, event_id) AS value FROM base GROUP BY ALL),
hosts AS (
  SELECT DISTINCT hostid, host, concat('Host ', hostid) AS name, CASE WHEN hostid = 9 THEN 1 ELSE 0 END AS status
  FROM base),
items AS (
  SELECT DISTINCT itemid, hostid, key_, key_ AS name,
         CASE event_type WHEN 'click' THEN '%' WHEN 'view' THEN '%' WHEN 'purchase' THEN 'bps' ELSE '' END AS units,
         CASE WHEN itemid = 84 THEN 1 ELSE 0 END AS status FROM base),
history AS (
  SELECT itemid, clock, value, 0 AS ns, event_id FROM base WHERE event_type IN ('click', 'view', 'error')),
history_uint AS (
  SELECT itemid, clock, CAST(floor(value) AS BIGINT) AS value, 0 AS ns, event_id FROM base
  WHERE event_type IN ('purchase', 'signup')),
triggers AS (
  SELECT 1000 + itemid AS triggerid, concat('High ', name) AS description,
         concat('last(', key_, ')>100') AS expression, CAST(itemid % 6 AS INTEGER) AS priority, 0 AS status
  FROM items WHERE key_ IN ('system.cpu.util[,user]', 'system.cpu.load[all,avg1]')),
functions AS (
  SELECT triggerid * 10 AS functionid, triggerid, triggerid - 1000 AS itemid FROM triggers
  UNION ALL
  SELECT triggerid * 10 + 1, triggerid, triggerid - 1000 FROM triggers WHERE contains(description, 'cpu.load')),
problems AS (
  SELECT event_id AS eventid, 1000 + itemid AS objectid, clock, 1 AS value,
         CAST(least(5, floor(value / 80)) AS INTEGER) AS severity, CAST(event_id % 2 AS INTEGER) AS acknowledged,
         CASE WHEN event_id % 7 = 0 THEN 3 ELSE 0 END AS source
  FROM base WHERE event_type IN ('error', 'click') AND value > 100),
alerts AS (
  SELECT eventid * 10 AS alertid, eventid, clock + 30 AS clock, 'ops@example.org' AS sendto, 'Problem' AS subject,
         'over 100' AS message, 1 AS status FROM problems WHERE severity >= 2),
alert_times AS (
  SELECT h.host, a.clock AS alert_clock FROM alerts a JOIN problems p ON a.eventid = p.eventid
  JOIN triggers t ON t.triggerid = p.objectid JOIN items i ON i.itemid = t.triggerid - 1000
  JOIN hosts h ON h.hostid = i.hostid),
hourly AS (
  SELECT host, measurement, clock - clock % 3600 AS clock, round(avg(value), 8) AS value FROM base
  GROUP BY host, measurement, clock - clock % 3600),
wide AS (
  SELECT host, clock,
         max(CASE WHEN measurement = 'system_cpu_util_user' THEN value END) AS system_cpu_util_user,
         max(CASE WHEN measurement = 'vm_memory_utilization' THEN value END) AS vm_memory_utilization,
         max(CASE WHEN measurement = 'net_if_out_eth0' THEN value END) AS net_if_out_eth0,
         max(CASE WHEN measurement = 'proc_num_run' THEN value END) AS proc_num_run,
         max(CASE WHEN measurement = 'system_cpu_load_all_avg1' THEN value END) AS system_cpu_load_all_avg1
  FROM hourly GROUP BY host, clock),
raw AS (
  SELECT event_id, CASE WHEN event_id % 50 = 0 THEN 'not json' ELSE concat('{"type":"host-metrics","itemid":', itemid,
         ',"clock":', clock, CASE WHEN event_id % 33 = 0 THEN '' ELSE concat(',"value":', value) END,
         ',"ns":0,"item_key":"', replace(key_, '"', ''), '","units":"%","hostname":"', host, '","table_type":"',
         CASE WHEN event_id % 41 = 0 THEN 'trends' WHEN event_type IN ('purchase', 'signup') THEN 'history_uint'
              ELSE 'history' END, '"}') END AS raw FROM base),
scores AS (
  SELECT event_id, host, clock, CAST((event_id * 37) % 101 AS DOUBLE) / 100 AS if_score,
         CAST((event_id * 53) % 97 AS DOUBLE) / 96 AS lof_score,
         CASE WHEN (event_id * 37) % 101 < 10 THEN 1 ELSE 0 END AS if_flag,
         CASE WHEN (event_id * 53) % 97 < 10 THEN 1 ELSE 0 END AS lof_flag,
         CASE WHEN value > 100 THEN 1 ELSE 0 END AS stat_flag,
         CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS label FROM base),
forecast AS (
  SELECT host, measurement AS metric, CASE WHEN clock % 7200 = 0 THEN 'additive' ELSE 'arima' END AS model,
         clock AS ds, value AS yhat, value - 5 AS yhat_lower, value + 5 AS yhat_upper FROM hourly),
registry AS (
  SELECT DISTINCT measurement AS model_name, concat('1.0_202401', CASE WHEN hostid < 5 AND event_type <> 'view' THEN '30_2' ELSE '28_0' END,
         hostid % 4, '0000') AS version, hostid AS training_samples FROM base)
"""
