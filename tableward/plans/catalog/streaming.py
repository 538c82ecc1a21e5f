"""Streams read from the given tables, each run until it has seen everything."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import functions as F

from tableward.operators import freshness as FR
from tableward.plans.catalog.bronze import BLANK, GROUP_SPEC, SPEC, group_findings_sql, tidy
from tableward.plans.catalog.freshness import PER_TICK, SLA_SQL, slas, span
from tableward.plans.catalog.models import rounded
from tableward.plans.catalog.rules import good_customers as _rules_loaded  # noqa: F401
from tableward.plans.inputs import DIRTY_EVENTS, dirty_events
from tableward.plans.registry import REGISTRY, Tables, query
from tableward.sources.folders import scratch_folder
from tableward.streaming import metrics as SM
from tableward.streaming import state as ST
from tableward.streaming import validate as SV


class Streams(Tables):
    """The same tables as file streams."""

    def __getattr__(self, name):
        schema = getattr(Tables(self.spark, self.folder), name).schema
        return SV.file_stream(self.spark, self.folder, schema, pattern=f"{name}.parquet", files_per_batch=1)


def drained(t, stream, mode: str = "append"):
    """Run a stream to its end into a folder and read that back."""
    folder = scratch_folder(t.spark, "stream")
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}-checkpoint")
    writer.format("parquet").trigger(availableNow=True).start(folder).awaitTermination()
    return t.spark.read.schema(stream.schema).parquet(folder)


BATCH = REGISTRY["validate_batch"].sql


@query("stream_validate", BATCH)
def stream_validate(t):
    folder = scratch_folder(t.spark, "stream")
    stream = Streams(t.spark, t.folder).events
    SV.validate_stream(stream, SPEC, ["event_id"], folder, f"{folder}-checkpoint",
                       prepare=lambda rows: dirty_events(type("Batch", (), {"events": rows}))).awaitTermination()
    return tidy(t.spark.read.parquet(f"{folder}/findings").drop("batch_id"))


@query("stream_validate_files", group_findings_sql("CAST(event_id % 3 AS INTEGER)"))
def stream_validate_files(t):
    """One micro-batch of three files, each with a result of its own."""
    folder = scratch_folder(t.spark, "stream")
    events = t.events.withColumn("part", (F.col("event_id") % 3).cast("int"))
    for part in range(3):
        events.filter(F.col("part") == part).drop("part").coalesce(1).write.parquet(f"{folder}/in/part-{part}")
    stream = SV.file_stream(t.spark, f"{folder}/in/*", t.events.schema, file_column="file")
    SV.validate_stream(stream, GROUP_SPEC, ["event_id"], folder, f"{folder}-checkpoint", by=["file"],
                       prepare=lambda rows: with_file(rows)).awaitTermination()
    found = t.spark.read.parquet(f"{folder}/findings").drop("batch_id")
    return tidy(found.withColumn("g", F.regexp_extract("file", r"part-(\d)/", 1).cast("int")).drop("file"))


def with_file(rows):
    """Dirty events that keep the file they came from."""
    names = rows.select("event_id", "file")
    return dirty_events(type("Batch", (), {"events": rows})).join(names, "event_id")


@query("stream_missed_deliveries", f"""WITH {SLA_SQL}{PER_TICK},
judged AS (SELECT *, lead(tick) OVER (PARTITION BY sla_id ORDER BY tick) AS following FROM per_tick),
n AS (SELECT *, row_number() OVER (PARTITION BY sla_id ORDER BY tick) AS pos FROM judged WHERE following <= (SELECT date_trunc('milliseconds', max(ts)) FROM events)),
i AS (SELECT *, pos - row_number() OVER (PARTITION BY sla_id ORDER BY tick) AS run FROM n WHERE arrivals = 0)
SELECT source, sla_id, min(tick) AS first_missed, max(tick) AS last_missed, count(*) AS consecutive_misses, CASE WHEN count(*) >= 2 THEN 'FR-005' END AS failure_code FROM i GROUP BY source, sla_id, run""")
def stream_missed_deliveries(t):
    """Runs of misses as a stream counts them, sources that never deliver included."""
    with rocksdb(t.spark):
        found = drained(t, ST.stream_misses(Streams(t.spark, t.folder).events, slas(t), FR.calendar(slas(t), *span(t)), "event_type", "ts"))
    longest = found.groupBy("source", "sla_id", "first_missed").agg(F.max_by(F.struct("last_missed", "consecutive_misses", "failure_code"), "consecutive_misses").alias("run"))
    made = longest.select("source", "sla_id", "first_missed", "run.*")
    return made.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("first_missed", "last_missed")})


@query("stream_state_transition", REGISTRY["rule_state_transition"].sql)
def stream_state_transition(t):
    folder = scratch_folder(t.spark, "stream")
    ST.stream_transitions(
        Streams(t.spark, t.folder).orders, "o_custkey", "o_orderdate", "o_orderkey", "o_orderstatus", {"F": ["O"], "O": ["P", "F"]},
        folder, f"{folder}-checkpoint").awaitTermination()
    return t.spark.read.parquet(f"{folder}/steps").drop("batch")


ALLOWED = {"F": ["O"], "O": ["P", "F"]}


@query("stream_steps", REGISTRY["rule_state_transition"].sql)
def stream_steps(t):
    """Orders of the first half are the state that the stream of the second half starts from."""
    found, _ = stepped(t)
    return found


@query("stream_states", """
SELECT o_custkey, max_by(o_orderdate, (o_orderdate, o_orderkey)) AS at, max_by(o_orderkey, (o_orderdate, o_orderkey)) AS id,
  max_by(o_orderstatus, (o_orderdate, o_orderkey)) AS state FROM orders GROUP BY 1""")
def stream_states(t):
    """The newest state of every customer, read from the state store of the query above."""
    _, checkpoint = stepped(t)
    with rocksdb(t.spark):
        states = ST.newest_states(t.spark, checkpoint, "o_custkey")
        return states.withColumn("at", F.col("at").cast("timestamp_ntz"))


def stepped(t):
    """Two runs of one query, the second from the state that the first left behind."""
    folder = scratch_folder(t.spark, "stream")
    middle = t.orders.agg(F.percentile_approx("o_orderdate", 0.5).alias("x")).scalar()
    parts = {"1": F.col("o_orderdate") < middle, "2": F.col("o_orderdate") >= middle}
    with rocksdb(t.spark):
        for name, part in parts.items():
            t.orders.filter(part).write.parquet(f"{folder}/in/{name}")
            stream = SV.file_stream(t.spark, f"{folder}/in/*", t.orders.schema)
            steps = ST.stream_steps(stream, "o_custkey", "o_orderdate", "o_orderkey", "o_orderstatus", ALLOWED)
            steps.writeStream.format("parquet").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start(
                f"{folder}/out").awaitTermination()
    return t.spark.read.schema(steps.schema).parquet(f"{folder}/out"), f"{folder}/checkpoint"


@contextmanager
def rocksdb(spark):
    """The state store that custom state needs."""
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider, None)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(provider) if before is None else spark.conf.set(provider, before)


@query("stream_silence", """
WITH last AS (SELECT event_type, max(ts) AS last FROM events GROUP BY 1), m AS (SELECT max(ts) AS now FROM events)
SELECT event_type, date_trunc('milliseconds', last) AS last_arrival, severity, 'FR-001' AS failure_code FROM last, m, (VALUES ('WARNING', 10), ('CRITICAL', 20)) v(severity, minutes)
WHERE date_trunc('milliseconds', last) + to_minutes(minutes) <= date_trunc('milliseconds', now)""")
def stream_silence(t):
    """Sources that were silent for long when the stream ended; event time is the clock."""
    with rocksdb(t.spark):
        found = drained(t, ST.stream_silence(Streams(t.spark, t.folder).events, "event_type", "ts", 10, 20))
    return found.withColumn("last_arrival", F.col("last_arrival").cast("timestamp_ntz"))


def newest(t, stream):
    """Run a stream with complete output to its end; the last micro-batch's table."""
    folder = scratch_folder(t.spark, "stream")

    def keep(rows, number):
        rows.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    stream.writeStream.outputMode("complete").foreachBatch(keep).option(
        "checkpointLocation", f"{folder}-checkpoint").trigger(availableNow=True).start().awaitTermination()
    batches = t.spark.read.parquet(folder)
    return batches.filter(F.col("batch") == batches.agg(F.max("batch").alias("b")).scalar()).drop("batch")


WINDOWS = """
SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY AS window_end, event_type, count(*) AS rows, round(avg(CAST(value IS NULL AS INTEGER)), 6) AS null_rate,
  round(avg(value), 6) AS mean, round(avg(CAST(coalesce(value > 150, false) AS INTEGER)), 6) AS outlier_rate FROM (SELECT * REPLACE (CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS value) FROM events) GROUP BY 1, 2, 3"""


def with_gaps(events):
    return events.withColumn("value", F.when(F.col("event_id") % 7 == 0, None).otherwise(F.col("value")))


@query("stream_window_quality", WINDOWS)
def stream_window_quality(t):
    windows = SV.window_quality(with_gaps(Streams(t.spark, t.folder).events), "ts", "value", "1 day", groups=["event_type"],
                                outlier=F.coalesce(F.col("value") > 150, F.lit(False)))
    return rounded(newest(t, windows), "null_rate", "mean", "outlier_rate")


@query("stream_sessions", """
WITH g AS (SELECT user_id, ts, CASE WHEN date_diff('microsecond', lag(ts) OVER (PARTITION BY user_id ORDER BY ts), ts) < 21600000000 THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM g)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 6 HOUR AS session_end, count(*) AS rows FROM s GROUP BY user_id, n""")
def stream_sessions(t):
    events = Streams(t.spark, t.folder).events.withColumn("ts", F.col("ts").cast("timestamp"))
    found = newest(t, SV.stream_sessions(events, "ts", "user_id", "6 hours", "40 days"))
    return found.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("session_start", "session_end")})


@query("table_sessions", REGISTRY["stream_sessions"].sql)
def table_sessions(t):
    return SV.sessions(t.events, "ts", "user_id", 6 * 3600)


@query("stream_last_arrival", "SELECT event_type, max(ts) AS last_arrival, count(*) AS arrivals FROM events GROUP BY 1")
def stream_last_arrival(t):
    return newest(t, SV.last_arrivals(Streams(t.spark, t.folder).events, "event_type", "ts"))


@query("stream_observed", f"""WITH {DIRTY_EVENTS}
SELECT check_name, failure_code, field, CAST(n AS BIGINT) AS affected_count, total AS total_count FROM (
  SELECT 'null_required' AS check_name, 'DV-002' AS failure_code, 'value' AS field, count(*) FILTER (WHERE value IS NULL) AS n, count(*) AS total FROM dirty
  UNION ALL SELECT 'null_required', 'DV-002', 'event_type', count(*) FILTER (WHERE {BLANK.format('event_type')}), count(*) FROM dirty
  UNION ALL SELECT 'type', 'DV-003', 'value_text', count(*) FILTER (WHERE try_cast(value_text AS DOUBLE) IS NULL), count(*) FROM dirty
  UNION ALL SELECT 'range', 'DV-004', 'value', count(*) FILTER (WHERE value < 0 OR value > 1000), count(*) FROM dirty)""")
def stream_observed(t):
    """Counts that a listener saw while the stream was written, over all its micro-batches."""
    folder = scratch_folder(t.spark, "stream")
    for part in range(3):
        t.events.filter(F.col("event_id") % 3 == part).coalesce(1).write.parquet(f"{folder}/in/part-{part}")
    stream = SV.file_stream(t.spark, f"{folder}/in/*", t.events.schema, files_per_batch=1)
    rows = dirty_events(type("Batch", (), {"events": stream}))
    seen = SM.run_watched(t.spark, rows, SPEC, f"{folder}/out", f"{folder}-checkpoint")
    return seen.groupBy("check_name", "failure_code", "field").agg(
        F.sum("affected_count").alias("affected_count"), F.sum("total_count").alias("total_count"))
