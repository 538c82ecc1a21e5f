"""Layer 4: freshness, deadlines, pipelines, dependencies."""

from __future__ import annotations

from pyspark.sql import functions as F

from tableward.functions import severity as S
from tableward.operators import freshness as FR
from tableward.plans.inputs import LEVEL, case_bands
from tableward.plans.registry import query

AS_OF = "2024-01-31 00:30:00"
SLAS = (
    FR.Sla("sla-click", "click", "0 * * * *", 60, 90, expected_count=400),
    FR.Sla("sla-view", "view", "*/15 * * * *", 15, 30),
    FR.Sla("sla-purchase", "purchase", "0 6 * * *", 1440, 2880, expected_count=66),
    FR.Sla("sla-signup", "signup", "30 8-18/2 * * 1-5", 60, 90),
    FR.Sla("sla-error", "error", "0 0 1,15 * 1", 60, 90),
    FR.Sla("sla-refund", "refund", "0 * * * *", 60, 90),
    FR.Sla("sla-audit", "audit", "not a schedule", 60, 90),
    FR.Sla("sla-off", "retired", "0 * * * *", 60, 90, enabled=False),
)
DUE = """CASE source WHEN 'click' THEN minute(t) = 0 WHEN 'refund' THEN minute(t) = 0 WHEN 'view' THEN minute(t) % 15 = 0
  WHEN 'purchase' THEN hour(t) = 6 AND minute(t) = 0 WHEN 'signup' THEN minute(t) = 30 AND hour(t) IN (8, 10, 12, 14, 16, 18) AND dayofweek(t) BETWEEN 1 AND 5
  WHEN 'error' THEN hour(t) = 0 AND minute(t) = 0 AND (day(t) IN (1, 15) OR dayofweek(t) = 1) ELSE false END"""
SLA_SQL = f"""
as_of AS (SELECT TIMESTAMP '{AS_OF}' AS now),
sla AS (SELECT * FROM (VALUES ('sla-click', 'click', 60, 90), ('sla-view', 'view', 15, 30), ('sla-purchase', 'purchase', 1440, 2880), ('sla-signup', 'signup', 60, 90),
  ('sla-error', 'error', 60, 90), ('sla-refund', 'refund', 60, 90), ('sla-audit', 'audit', 60, 90)) v(sla_id, source, warn, crit)),
arrived AS (SELECT event_type AS source, max(ts) AS last_arrival FROM events GROUP BY 1),
cal AS (SELECT sla_id, source, t AS tick FROM sla, (SELECT unnest(generate_series(date_trunc('minute', (SELECT min(ts) FROM events)), (SELECT max(ts) FROM events), INTERVAL 1 MINUTE)) AS t)
  WHERE t >= (SELECT min(ts) FROM events) AND {DUE}),
expected AS (SELECT sla.*, CASE WHEN source = 'audit' THEN now - INTERVAL 1 HOUR ELSE
    (SELECT max(t) FROM (SELECT unnest(generate_series(TIMESTAMP '2023-12-20', TIMESTAMP '{AS_OF}' - INTERVAL 1 MINUTE, INTERVAL 1 MINUTE)) AS t) WHERE {DUE}) END AS expected_at FROM sla, as_of),
delays AS (SELECT e.*, last_arrival, now, greatest(0, floor(date_diff('microsecond', expected_at, coalesce(last_arrival, now)) / 1e6))::BIGINT AS delay_seconds,
    CASE WHEN last_arrival IS NULL THEN 0 ELSE greatest(0, date_diff('second', expected_at, now)) END::BIGINT AS now_seconds
  FROM expected e LEFT JOIN arrived USING (source), as_of)"""


def as_of():
    return F.lit(AS_OF).cast("timestamp_ntz")


def arrivals(t):
    return t.events.select(F.col("event_type").alias("source"), "ts")


def slas(t):
    return FR.sla_table(t.spark, SLAS)


def span(t):
    edge = lambda f: t.events.agg(f("ts").alias("x")).scalar()
    return edge(F.min), edge(F.max)


@query("freshness_status", f"""WITH {SLA_SQL}
SELECT source, sla_id, warn AS warning_minutes, last_arrival, age_seconds, status, CASE WHEN status <> 'OK' THEN 'FR-001' END AS failure_code FROM (
  SELECT *, CASE WHEN age_seconds IS NULL OR age_seconds / 60.0 >= crit THEN 'CRITICAL' WHEN age_seconds / 60.0 >= warn THEN 'WARNING' ELSE 'OK' END AS status
  FROM (SELECT *, CAST(floor(date_diff('microsecond', last_arrival, now) / 1e6) AS BIGINT) AS age_seconds FROM delays))""")
def freshness_status(t):
    return FR.freshness_status(slas(t).filter("enabled"), FR.last_arrivals(arrivals(t)), as_of())


@query("sla_calendar", f"WITH {SLA_SQL} SELECT sla_id, source, tick FROM cal")
def sla_calendar(t):
    return FR.calendar(slas(t), *span(t))


@query("sla_status", f"""WITH {SLA_SQL}
SELECT source, sla_id, expected_at, last_arrival, delay_seconds, status,
  concat_ws(',', CASE status WHEN 'BREACHED' THEN 'FR-002' WHEN 'AT_RISK' THEN 'FR-003' END, CASE WHEN last_arrival IS NULL AND date_diff('second', expected_at, now) > 1800 THEN 'FR-005' END) AS failure_codes
FROM (SELECT *, CASE WHEN delay_seconds / 60.0 >= warn THEN 'BREACHED' WHEN delay_seconds / 60.0 >= warn / 2.0 THEN 'AT_RISK' ELSE 'ON_TRACK' END AS status FROM delays)""")
def sla_status(t):
    return FR.sla_status(slas(t), FR.last_arrivals(arrivals(t)), as_of()).withColumn(
        "failure_codes", F.array_join("failure_codes", ","))


@query("sla_status_fixed", f"""WITH {SLA_SQL}
SELECT source, sla_id, expected_at, now_seconds AS delay_seconds, CASE WHEN now_seconds / 60.0 > 30 THEN 'FR-002' WHEN now_seconds / 60.0 > 15 THEN 'FR-003' END AS failure_code,
  CASE WHEN now_seconds / 60.0 > 30 THEN 'CRITICAL' WHEN now_seconds / 60.0 > 15 THEN 'WARNING' END AS severity FROM delays""")
def sla_status_fixed(t):
    return FR.sla_status_fixed(slas(t), FR.last_arrivals(arrivals(t)), as_of())


PER_TICK = """,
came AS (SELECT sla_id, date_trunc('minute', ts) AS at FROM events JOIN sla ON event_type = source),
placed AS (SELECT e.sla_id, c.tick FROM came e ASOF JOIN cal c ON e.sla_id = c.sla_id AND e.at >= c.tick),
per_tick AS (SELECT cal.source, cal.sla_id, cal.tick, count(placed.tick) AS arrivals FROM cal LEFT JOIN placed ON cal.sla_id = placed.sla_id AND cal.tick = placed.tick GROUP BY ALL)"""


@query("arrivals_per_tick", f"WITH {SLA_SQL}{PER_TICK} SELECT source, sla_id, tick, arrivals FROM per_tick")
def arrivals_per_tick(t):
    return FR.arrivals_per_tick(slas(t), arrivals(t), *span(t))


@query("missed_deliveries", f"""WITH {SLA_SQL}{PER_TICK},
n AS (SELECT *, row_number() OVER (PARTITION BY sla_id ORDER BY tick) AS pos FROM per_tick),
i AS (SELECT *, pos - row_number() OVER (PARTITION BY sla_id ORDER BY tick) AS run FROM n WHERE arrivals = 0)
SELECT source, sla_id, min(tick) AS first_missed, max(tick) AS last_missed, count(*) AS consecutive_misses, CASE WHEN count(*) >= 2 THEN 'FR-005' END AS failure_code FROM i GROUP BY source, sla_id, run""")
def missed_deliveries(t):
    return FR.missed_deliveries(FR.arrivals_per_tick(slas(t), arrivals(t), *span(t)))


@query("arrival_volume", f"""
WITH b AS (SELECT event_type AS source, strftime(ts, '%Y-%m-%d') AS batch, count(*) AS records, CASE event_type WHEN 'click' THEN 400 ELSE 66 END::BIGINT AS expected_count
  FROM events WHERE event_type IN ('click', 'purchase') GROUP BY ALL),
s AS (SELECT *, abs(records - expected_count) * 100.0::DOUBLE / expected_count AS pct FROM b WHERE records <> expected_count),
c AS (SELECT *, {case_bands('pct', S.COUNT)} AS score FROM s)
SELECT source, batch, records, expected_count, round(pct, 6) AS deviation_pct, score AS severity_score, {LEVEL.format('score')} AS severity FROM c""")
def arrival_volume(t):
    batches = arrivals(t).groupBy("source", F.date_format("ts", "yyyy-MM-dd").alias("batch")).agg(
        F.count(F.lit(1)).alias("records"))
    return FR.arrival_volume(slas(t), batches).withColumn("deviation_pct", F.round("deviation_pct", 6))


# Order lines read as stages of a run per order.
RUN_AS_OF = "2001-09-01"
STAGES = """
stages AS (SELECT l_orderkey AS pipeline_id, 's' || l_linenumber AS stage, l_linenumber AS seq, l_partkey AS p, l_suppkey AS s, l_extendedprice AS x,
  CASE WHEN l_returnflag = 'N' AND l_linestatus = 'O' THEN NULL ELSE l_shipdate END AS started_at,
  CASE WHEN l_linestatus = 'F' THEN l_shipdate + to_hours(CAST(l_quantity AS INTEGER)) END AS completed_at,
  CASE WHEN l_returnflag = 'R' THEN 'FAILED' WHEN l_linestatus = 'F' THEN 'COMPLETED' WHEN l_returnflag = 'N' THEN 'PENDING' ELSE 'RUNNING' END AS status FROM lineitem)"""
STAGE_ORDER = ["seq", "p", "s", "x"]


def stages(t):
    finished = F.col("l_linestatus") == "F"
    return t.lineitem.select(
        F.col("l_orderkey").alias("pipeline_id"), F.concat(F.lit("s"), "l_linenumber").alias("stage"),
        F.col("l_linenumber").alias("seq"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"),
        F.col("l_extendedprice").alias("x"),
        F.when((F.col("l_returnflag") == "N") & ~finished, None).otherwise(F.col("l_shipdate")).alias("started_at"),
        F.when(finished, F.col("l_shipdate") + F.make_dt_interval(F.lit(0), F.col("l_quantity").cast("int"))).alias("completed_at"),
        F.when(F.col("l_returnflag") == "R", "FAILED").when(finished, "COMPLETED")
        .when(F.col("l_returnflag") == "N", "PENDING").otherwise("RUNNING").alias("status"))


RUNS = """,
runs AS (SELECT pipeline_id, min(started_at) AS started_at, CASE WHEN bool_and(completed_at IS NOT NULL) THEN max(completed_at) END AS completed_at, bool_or(status = 'FAILED') AS failed FROM stages GROUP BY 1),
timed AS (SELECT *, date_diff('second', started_at, coalesce(completed_at, TIMESTAMP '2001-09-01')) AS dur FROM runs)"""
THRESHOLD = 50_000_000


def run_as_of():
    return F.lit(RUN_AS_OF).cast("timestamp_ntz")


@query("jobrun_latency", f"""WITH {STAGES}{RUNS}
SELECT pipeline_id, dur AS duration_seconds, dur - {THRESHOLD} AS overage_seconds, 'FR-008' AS failure_code, CASE WHEN dur - {THRESHOLD} < {THRESHOLD} THEN 'WARNING' ELSE 'CRITICAL' END AS severity FROM timed WHERE dur > {THRESHOLD}""")
def jobrun_latency(t):
    return FR.latency_spikes(FR.runs(stages(t)), F.lit(THRESHOLD), run_as_of())


@query("jobrun_e2e", f"""WITH {STAGES}
SELECT pipeline_id, CAST(sum(date_diff('second', started_at, completed_at)) AS BIGINT) AS stage_seconds, max(date_diff('second', started_at, completed_at)) AS longest_stage,
  date_diff('second', min(started_at), max(completed_at)) AS span_seconds FROM stages GROUP BY 1""")
def jobrun_e2e(t):
    return FR.end_to_end(stages(t))


@query("jobrun_latency_baseline", f"""WITH {STAGES},
e AS (SELECT pipeline_id, status, date_diff('second', min(started_at), max(completed_at)) AS span_seconds FROM stages GROUP BY 1, 2)
SELECT status, count(*) AS runs, avg(span_seconds) AS mean_seconds, quantile_disc(span_seconds, 0.95) AS p95_seconds FROM e GROUP BY 1""")
def jobrun_latency_baseline(t):
    return FR.latency_baseline(FR.end_to_end(stages(t), ["status"]), ["status"])


@query("jobrun_stalled", f"""WITH {STAGES},
l AS (SELECT *, lead(stage) OVER w AS next_stage, lead(started_at) OVER w AS next_start FROM stages WINDOW w AS (PARTITION BY pipeline_id ORDER BY seq, p, s, x)),
h AS (SELECT * FROM l WHERE completed_at IS NOT NULL AND next_stage IS NOT NULL AND next_start IS NULL AND date_diff('second', completed_at, TIMESTAMP '2001-09-01') > 600)
SELECT pipeline_id, stage AS after_stage, next_stage AS stalled_stage, 'FR-004' AS failure_code, 'WARNING' AS severity FROM h
QUALIFY row_number() OVER (PARTITION BY pipeline_id ORDER BY seq, p, s, x) = 1""")
def jobrun_stalled(t):
    return FR.stalled_stages(stages(t), STAGE_ORDER, run_as_of())


@query("jobrun_failed", f"""WITH {STAGES}
SELECT pipeline_id, stage, coalesce(date_diff('second', started_at, completed_at), 0) AS duration_seconds, 'FR-006' AS failure_code, 'CRITICAL' AS severity FROM stages WHERE status = 'FAILED'""")
def jobrun_failed(t):
    return FR.failed_stages(stages(t))


@query("jobrun_fold", f"""WITH {STAGES},
ev AS (SELECT pipeline_id, stage, started_at AS ts, 'RUNNING' AS status FROM stages WHERE started_at IS NOT NULL
  UNION ALL SELECT pipeline_id, stage, completed_at, CASE WHEN status = 'FAILED' THEN 'FAILED' ELSE 'COMPLETED' END FROM stages WHERE completed_at IS NOT NULL)
SELECT pipeline_id, stage, arg_max(status, (ts, status)) AS status, min(ts) FILTER (WHERE status = 'RUNNING') AS started_at, max(ts) FILTER (WHERE status <> 'RUNNING') AS completed_at FROM ev GROUP BY 1, 2""")
def jobrun_fold(t):
    ended = F.when(F.col("status") == "FAILED", "FAILED").otherwise("COMPLETED")
    events = stages(t).select("pipeline_id", "stage", F.inline(F.array(
        F.struct(F.col("started_at").alias("ts"), F.lit("RUNNING").alias("new_status")),
        F.struct(F.col("completed_at").alias("ts"), ended.alias("new_status")))))
    return FR.fold_stages(events.filter("ts IS NOT NULL").withColumnRenamed("new_status", "status"))


DEPS = """
deps AS (SELECT o_orderkey AS source, 'd' || l_suppkey || '-' || l_partkey AS dependency_id, l_linenumber AS seq, l_linestatus = 'O' AS blocking,
  CASE l_returnflag WHEN 'N' THEN 'OK' WHEN 'R' THEN 'LATE' ELSE 'FAILED' END AS status,
  greatest(0, date_diff('second', o_orderdate, l_shipdate))::BIGINT AS delay_seconds FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def dependencies(t):
    from tableward.functions.predicates import seconds_between

    return t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_orderkey").alias("source"),
        F.concat(F.lit("d"), "l_suppkey", F.lit("-"), "l_partkey").alias("dependency_id"),
        F.col("l_linenumber").alias("seq"), (F.col("l_linestatus") == "O").alias("blocking"),
        F.when(F.col("l_returnflag") == "N", "OK").when(F.col("l_returnflag") == "R", "LATE").otherwise("FAILED").alias("status"),
        F.greatest(F.lit(0), seconds_between(F.col("l_shipdate"), F.col("o_orderdate"))).cast("bigint").alias("delay_seconds"))


@query("dependency_delay", f"""WITH {DEPS}
SELECT source, dependency_id, delay_seconds, 'FR-007' AS failure_code, CASE WHEN blocking THEN 'CRITICAL' ELSE 'WARNING' END AS severity FROM deps WHERE delay_seconds > 0 AND status <> 'OK'""")
def dependency_delay(t):
    return FR.late_dependencies(dependencies(t))


@query("dependency_gate", f"""WITH {DEPS}
SELECT source, NOT bool_or(blocking AND status <> 'OK') AS can_proceed, arg_min(dependency_id, (seq, dependency_id)) FILTER (WHERE blocking AND status <> 'OK') AS blocked_by,
  count(*) FILTER (WHERE delay_seconds > 0 AND status <> 'OK') AS late FROM deps GROUP BY source""")
def dependency_gate(t):
    return FR.dependency_gate(dependencies(t), ["seq", "dependency_id"])


@query("score_freshness", f"""WITH {SLA_SQL}, {STAGES}{RUNS}, {DEPS},
f AS (SELECT CASE WHEN age IS NULL OR age / 60.0 >= crit THEN 0 WHEN age / 60.0 >= warn THEN 50 ELSE 100 - 50 * (age / 60.0::DOUBLE) / warn END AS pts FROM (SELECT *, CAST(floor(date_diff('microsecond', last_arrival, now) / 1e6) AS BIGINT) AS age FROM delays)),
s AS (SELECT CASE WHEN last_arrival IS NULL OR delay_seconds / 60.0 >= warn THEN 0 WHEN delay_seconds / 60.0 >= warn / 2.0 THEN 50 ELSE 100 END AS pts FROM delays),
p AS (SELECT CASE WHEN failed OR ov > 1 THEN 0 WHEN ov > 0 THEN 50 * (1 - ov) ELSE 100 END AS pts FROM (SELECT *, (dur - {THRESHOLD}) / CAST({THRESHOLD} AS DOUBLE) AS ov FROM timed)),
d AS (SELECT avg(CASE WHEN status = 'OK' OR delay_seconds <= 0 THEN 100.0::DOUBLE ELSE 0 END) * CASE WHEN bool_or(blocking AND status <> 'OK' AND delay_seconds > 0) THEN 0.5::DOUBLE ELSE 1 END AS pts FROM deps GROUP BY source)
SELECT 'freshness' AS component, round(avg(pts), 4) AS score FROM f UNION ALL SELECT 'sla', round(avg(pts), 4) FROM s UNION ALL SELECT 'pipeline', round(avg(pts), 4) FROM p UNION ALL SELECT 'dependency', round(avg(pts), 4) FROM d""")
def score_freshness(t):
    live, last = slas(t).filter("enabled"), FR.last_arrivals(arrivals(t))
    parts = {
        "freshness": FR.freshness_score(FR.freshness_status(live, last, as_of())),
        "sla": FR.sla_score(FR.sla_status(live, last, as_of())),
        "pipeline": FR.pipeline_score(FR.runs(stages(t)), F.lit(THRESHOLD), run_as_of()),
        "dependency": FR.dependency_score(dependencies(t)),
    }
    rows = [df.select(F.lit(name).alias("component"), F.round("score", 4).alias("score")) for name, df in parts.items()]
    out = rows[0]
    for row in rows[1:]:
        out = out.unionByName(row)
    return out


@query("score_watcher", f"""WITH {SLA_SQL}, f AS (SELECT CASE WHEN now_seconds / 60.0 > 30 THEN 'CRITICAL' WHEN now_seconds / 60.0 > 15 THEN 'WARNING' END AS severity FROM delays)
SELECT greatest(0.0::DOUBLE, 100.0::DOUBLE - sum(CASE severity WHEN 'CRITICAL' THEN 30 WHEN 'WARNING' THEN 15 ELSE 0 END)) AS score FROM f""")
def score_watcher(t):
    found = FR.sla_status_fixed(slas(t), FR.last_arrivals(arrivals(t)), as_of())
    return found.agg(S.layer_score(F.col("severity"), "watcher").alias("score"))
