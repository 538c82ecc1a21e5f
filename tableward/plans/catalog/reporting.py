"""Sources and sinks, scores, and the tables behind the reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from tableward.functions import severity as S
from tableward.model import CODE_TEXT
from tableward.operators import bronze as B
from tableward.operators import health as H
from tableward.operators import reporting as RP
from tableward.operators import statistics as D
from tableward.plans.catalog.bronze import SPEC, SPLIT
from tableward.plans.catalog.models import halves, rounded
from tableward.plans.inputs import ANOMALY_FEED, LEVEL, anomaly_feed, case_bands, dirty_events
from tableward.plans.registry import query
from tableward.sources import readers, sinks
from tableward.sources.folders import scratch_folder

FEED = f"WITH {ANOMALY_FEED}"
NOW = "2024-01-31"


def now():
    return F.lit(NOW).cast("timestamp_ntz")


# Sources and sinks ----------------------------------------------------------------------------

@query("scan_csv_roundtrip", """
SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE p_name END AS p_name, CAST(p_size AS VARCHAR) AS p_size FROM part""")
def scan_csv_roundtrip(t):
    folder = scratch_folder(t.spark, "csv")
    t.part.select("p_partkey", F.when(F.col("p_partkey") % 9 == 0, "").otherwise(F.col("p_name")).alias("p_name"),
                  "p_size").write.option("header", True).csv(folder)
    return readers.read_csv_text(t.spark, folder)


@query("scan_csv_typed", "SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice FROM part")
def scan_csv_typed(t):
    folder = scratch_folder(t.spark, "csv")
    t.part.write.option("header", True).csv(folder)
    return readers.read_csv_typed(t.spark, folder, t.part.schema)


@query("scan_json_envelope", "SELECT conv_id, turn, role FROM conversations")
def scan_json_envelope(t):
    folder = scratch_folder(t.spark, "json")
    record = F.struct("conv_id", "turn", "role")
    t.conversations.select(F.array(record).alias("records")).write.json(folder)
    return readers.read_json_batch(t.spark, folder, "jsonl")


def _documents(t, shape):
    """Pretty-printed JSON documents of at most 500 records, one per file."""
    folder = scratch_folder(t.spark, "json")
    record = F.struct("conv_id", "turn", "role")
    piles = t.conversations.groupBy(F.floor(F.col("conv_id") / 60).alias("pile")).agg(F.collect_list(record).alias("r"))
    piles.select("pile", F.to_json(shape(F.col("r")), {"pretty": "true"}).alias("value")).write.partitionBy(
        "pile").text(folder)
    return readers.read_json_batch(t.spark, folder).select("conv_id", "turn", "role")


JSON_ROWS = "SELECT conv_id, turn, role FROM conversations"


@query("scan_json_array", JSON_ROWS)
def scan_json_array(t):
    return _documents(t, lambda r: r)


@query("scan_json_data", JSON_ROWS)
def scan_json_data(t):
    return _documents(t, lambda r: F.struct(r.alias("data")))


@query("scan_json_single", "SELECT max(conv_id) AS conv_id, max(turn) AS turn, min(role) AS role FROM conversations")
def scan_json_single(t):
    folder = scratch_folder(t.spark, "json")
    one = t.conversations.agg(F.struct(F.max("conv_id").alias("conv_id"), F.max("turn").alias("turn"), F.min("role").alias("role")).alias("r"))
    one.select(F.to_json("r", {"pretty": "true"}).alias("value")).write.text(folder)
    return readers.read_json_batch(t.spark, folder).select("conv_id", "turn", "role")


@query("history_scan", FEED + """
SELECT anomaly_id, batch_id, severity, detected_at FROM feed WHERE CAST(detected_at AS DATE) BETWEEN DATE '2024-01-10' AND DATE '2024-01-20' AND severity = 'WARNING'
ORDER BY detected_at DESC LIMIT 50""")
def history_scan(t):
    folder = scratch_folder(t.spark, "history")
    sinks.append_by_day(anomaly_feed(t), folder, "detected_at")
    return readers.read_history(t.spark, folder, "2024-01-10", "2024-01-20", "severity = 'WARNING'",
                                "detected_at", 50).select("anomaly_id", "batch_id", "severity", "detected_at")


@query("result_sink", FEED + " SELECT CAST(detected_at AS DATE) AS date, count(*) AS rows FROM feed GROUP BY 1")
def result_sink(t):
    folder = scratch_folder(t.spark, "results")
    sinks.append_by_day(anomaly_feed(t), folder, "detected_at")
    return readers.read_history(t.spark, folder).groupBy("date").agg(F.count(F.lit(1)).alias("rows"))


@query("audit_sink", """
SELECT CAST(event_id AS VARCHAR) AS audit_id, event_type, 'B' || user_id AS batch_id FROM events WHERE event_type IN ('error', 'signup')""")
def audit_sink(t):
    folder = scratch_folder(t.spark, "audit")
    rows = t.events.select(F.col("event_id").cast("string").alias("audit_id"), "event_type",
                           F.concat(F.lit("B"), "user_id").alias("batch_id"), "ts")
    sinks.append_audit(rows, folder)
    return readers.read_audit(t.spark, folder, "audit_id string, event_type string, batch_id string, ts timestamp_ntz",
                              ["error", "signup"]).select("audit_id", "event_type", "batch_id")


@query("quarantine_release", SPLIT + """
SELECT 'day-' || strftime(ts, '%d') AS batch_id, CAST(event_id AS VARCHAR) AS row_key,
  concat_ws(',', CASE WHEN h1 OR h2 THEN 'DV-002' END, CASE WHEN h3 THEN 'DV-003' END, CASE WHEN h4 THEN 'DV-004' END) AS failure_codes
FROM flagged WHERE (h1 OR h2 OR h3 OR h4) AND event_type <> 'click'""")
def quarantine_release(t):
    held, released = scratch_folder(t.spark, "held"), scratch_folder(t.spark, "released")
    rows = B.quarantine(dirty_events(t), SPEC, ["event_id"]).withColumn(
        "batch_id", F.concat(F.lit("day-"), F.date_format(F.col("record.ts"), "dd")))
    sinks.append_quarantine(rows, held)
    keys = t.spark.read.parquet(held).filter(F.get_json_object("record", "$.event_type") == "click")
    left = sinks.release(t.spark, held, released, keys)
    return left.select("batch_id", "row_key", F.array_join("failure_codes", ",").alias("failure_codes"))


@query("quarantine_release_twice", """
WITH rows AS (
  SELECT CASE WHEN event_id % 5 <> 0 THEN event_type || CASE WHEN event_id % 7 = 0 THEN '|x' ELSE '' END END AS a,
    CASE WHEN event_id % 3 <> 0 THEN user_id END AS b, event_id, event_type FROM events)
SELECT 'all' AS batch_id, coalesce(replace(replace(a, chr(92), chr(92) || chr(92)), '|', chr(92) || '|'), chr(92) || 'N') || '|'
    || coalesce(CAST(b AS VARCHAR), chr(92) || 'N') || '|' || event_id AS row_key, count(*) AS times
FROM rows WHERE event_type IN ('click', 'view') GROUP BY ALL""")
def quarantine_release_twice(t):
    """Released rows of keys with nulls and bars, after two calls that overlap."""
    held, released = scratch_folder(t.spark, "held"), scratch_folder(t.spark, "released")
    e = F.col("event_id")
    rows = t.events.withColumns({
        "a": F.when(e % 5 != 0, F.concat("event_type", F.when(e % 7 == 0, "|x").otherwise(""))), "b": F.when(e % 3 != 0, F.col("user_id"))})
    always = B.BatchSpec(count=B.CountSpec(minimum=1 << 40))  # a finding that hits every row
    sinks.append_quarantine(B.quarantine(rows, always, ["a", "b", "event_id"]).withColumn("batch_id", F.lit("all")), held)
    kind = F.get_json_object("record", "$.event_type")
    for wanted in (["click"], ["click", "view"], ["view"]):
        sinks.release(t.spark, held, released, t.spark.read.parquet(held).filter(kind.isin(wanted)))
    return t.spark.read.parquet(released).groupBy("batch_id", "row_key").agg(F.count(F.lit(1)).alias("times"))


@query("baseline_store", "SELECT event_type AS key, count(*) AS n FROM events WHERE ts < TIMESTAMP '2024-01-16' GROUP BY 1")
def baseline_store(t):
    folder = scratch_folder(t.spark, "baselines")
    first, second = halves(t)
    sinks.save_baseline(D.categorical_baseline(second, "model_id"), folder, "first")  # replaced below
    for name, rows in (("first", first), ("second", second)):
        sinks.save_baseline(D.categorical_baseline(rows, "model_id"), folder, name)
    sinks.save_baseline(D.numeric_baseline(t.events, "value"), folder, "values")
    return sinks.load_baseline(t.spark, folder, "first").select("key", "n")


CODES = " ".join(f"WHEN '{c}' THEN '{text}'" for c, text in CODE_TEXT.items())
TIER = """CASE left(failure_code, 2) WHEN 'DV' THEN 'bronze' WHEN 'SC' THEN 'silver_schema' WHEN 'BL' THEN 'silver_business' WHEN 'FR' THEN 'silver_freshness'
  WHEN 'ML' THEN 'gold_model_health' ELSE 'gold_ethics' END"""
LAYER = "CASE left(failure_code, 2) WHEN 'DV' THEN 1 WHEN 'SC' THEN 2 WHEN 'BL' THEN 3 WHEN 'FR' THEN 4 WHEN 'ML' THEN 5 ELSE 6 END"


@query("export_anomalies", FEED + f"""
SELECT {TIER} AS tier, CAST({LAYER} AS INTEGER) AS layer, severity, failure_code, CASE failure_code {CODES} END AS description, detected_at FROM feed""")
def export_anomalies(t):
    folder = scratch_folder(t.spark, "export")
    rows = RP.export_rows(anomaly_feed(t))
    sinks.export_csv(rows, folder)
    return readers.read_csv_typed(t.spark, folder, rows.schema)


@query("export_summary", FEED + """
SELECT '{"total":' || count(*) || ',"critical":' || count(*) FILTER (WHERE severity = 'CRITICAL') || ',"warning":' || count(*) FILTER (WHERE severity = 'WARNING') ||
  ',"info":' || count(*) FILTER (WHERE severity = 'INFO') || ',"batches":' || count(DISTINCT batch_id) || '}' AS document FROM feed""")
def export_summary(t):
    return RP.export_summary(anomaly_feed(t))


# Filters and lookups --------------------------------------------------------------------------

@query("anomaly_filter", FEED + f"""
SELECT anomaly_id, failure_code, severity, source, detected_at FROM feed WHERE severity IN ('CRITICAL', 'WARNING') AND {LAYER} IN (2, 5)
  AND detected_at BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-25' AND source IN ('view', 'click', 'error')""")
def anomaly_filter(t):
    day = lambda d: F.lit(d).cast("timestamp_ntz")
    return RP.filtered(anomaly_feed(t), ["CRITICAL", "WARNING"], [2, 5], day("2024-01-05"), day("2024-01-25"),
                       ["view", "click", "error"]).select("anomaly_id", "failure_code", "severity", "source", "detected_at")


@query("anomaly_unacked", FEED + """
SELECT anomaly_id, severity FROM feed WHERE anomaly_id NOT IN (SELECT 'A' || event_id FROM events WHERE event_type IN ('view', 'signup') AND value < 50)""")
def anomaly_unacked(t):
    handled = t.events.filter("event_type IN ('view', 'signup') AND value < 50").select(
        F.concat(F.lit("A"), "event_id").alias("anomaly_id"))
    return RP.unacknowledged(anomaly_feed(t), handled).select("anomaly_id", "severity")


@query("drill_down", """
SELECT concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS row_key, l_quantity, l_discount FROM lineitem WHERE l_quantity > 40 AND l_discount < 0.03 ORDER BY row_key, l_quantity LIMIT 20""")
def drill_down(t):
    from tableward.functions.predicates import row_key
    from tableward.plans.catalog.rules import LINE_KEY, _check

    return RP.drill_down(t.lineitem, row_key(*LINE_KEY), _check(t, "bulk_discount"), ["l_quantity", "l_discount"])


def _impact_case(pick) -> str:
    return " ".join(f"WHEN '{c}' THEN {pick(e)}" for c, e in RP.IMPACT.items())


def _text(entry) -> str:
    open_fields = any(p in entry[1] for p in ("{expected_type}", "{min_found}", "{examples}", "{details}"))
    text = (entry[0] if open_fields else entry[1]).replace("'", "''")
    for name, value in {"{count}": "' || affected_count || '", "{percentage}": "' || CAST(affected_count AS DOUBLE) || '",
                        "{field}": "' || source || ', value' || '", "{expected}": "expected", "{actual}": "actual"}.items():
        text = text.replace(name, value)
    return f"'{text}'"


@query("impact_report", FEED + f"""
SELECT anomaly_id, failure_code, CASE failure_code {_impact_case(_text)} ELSE 'cause ' || source END AS business_description,
  CASE failure_code {_impact_case(lambda e: "'" + ','.join(e[2]) + "'")} ELSE 'Data processing,Reporting' END AS affected_processes,
  CASE failure_code {_impact_case(lambda e: "'" + ','.join(e[3]) + "'")} ELSE 'Review affected records,Contact data team if issue persists' END AS recommended_actions,
  CASE WHEN severity = 'CRITICAL' THEN 'All Customers' WHEN affected_count > 100 THEN 'Enterprise,Small Business' ELSE 'Affected Records Only' END AS affected_segments,
  CASE WHEN severity = 'CRITICAL' THEN 'High' WHEN severity = 'INFO' THEN 'Low' ELSE CASE failure_code {_impact_case(lambda e: "'" + e[4] + "'")} ELSE 'Medium' END END AS estimated_impact FROM feed""")
def impact_report(t):
    causes = anomaly_feed(t).withColumn("root_cause", F.concat(F.lit("cause "), "source")).withColumn(
        "details", F.lit(None).cast("map<string,string>"))
    lists = ["affected_processes", "recommended_actions", "affected_segments"]
    return RP.impact_report(causes).withColumns({c: F.array_join(c, ",") for c in lists})


@query("alerts", FEED + """
SELECT anomaly_id, batch_id, severity, '[' || severity || '] ' || failure_code || ': ' || source || ' (' || affected_count || ' records affected in batch ' || batch_id || ')' AS message,
  CAST(CASE severity WHEN 'CRITICAL' THEN 2 ELSE 1 END AS INTEGER) AS priority FROM feed WHERE severity <> 'INFO'""")
def alerts(t):
    return RP.alerts(anomaly_feed(t).withColumn("root_cause", F.col("source")))


# Scores ---------------------------------------------------------------------------------------

@query("severity_score", FEED + f""",
g AS (SELECT source, failure_code, CAST(sum(affected_count) AS BIGINT) AS affected, count(*) AS occurrences, count(*) * 1000 AS total, date_diff('microsecond', min(detected_at), TIMESTAMP '{NOW}') // 1000000 / 3600.0 AS hours FROM feed GROUP BY 1, 2),
s AS (SELECT *, {case_bands('affected / CAST(total AS DOUBLE) * 100', S.IMPACT)} * 0.4::DOUBLE + {case_bands('occurrences', S.FREQUENCY)} * 0.3::DOUBLE + {case_bands('hours', S.RECENCY, True)} * 0.3::DOUBLE AS score FROM g)
SELECT source, failure_code, affected, occurrences, round(score, 6) AS score, {LEVEL.format('round(score, 9)')} AS severity FROM s""")
def severity_score(t):
    return rounded(H.severity_scores(anomaly_feed(t), ["source", "failure_code"], F.count(F.lit(1)) * 1000, now()), "score")


COMPONENT = """CASE failure_code WHEN 'DV-002' THEN 'completeness' WHEN 'DV-003' THEN 'accuracy' WHEN 'DV-004' THEN 'accuracy' WHEN 'DV-005' THEN 'consistency' WHEN 'DV-006' THEN 'consistency'
  WHEN 'DV-007' THEN 'integrity' WHEN 'DV-008' THEN 'integrity' ELSE 'timeliness' END"""
HEALTH = f"""
bronze_feed AS (SELECT * FROM feed WHERE failure_code LIKE 'DV-%'),
pen AS (SELECT batch_id, {COMPONENT} AS comp, CASE severity WHEN 'CRITICAL' THEN 30 WHEN 'WARNING' THEN 15 ELSE 5 END * CASE WHEN affected_count > 0 THEN least(2.0::DOUBLE, 1 + affected_count / 200.0::DOUBLE) ELSE 1 END / 20 AS p FROM bronze_feed),
subjects AS (SELECT DISTINCT 'B' || user_id AS batch_id FROM events UNION SELECT 'part-' || p_partkey FROM part),
comp AS (SELECT batch_id, {', '.join(f"greatest(0.0::DOUBLE, 100 - coalesce(sum(p) FILTER (WHERE comp = '{c}'), 0) * 20) AS {c}" for c in H.COMPONENTS)}, count(comp) AS active_anomalies FROM subjects LEFT JOIN pen USING (batch_id) GROUP BY 1),
health AS (SELECT *, {' + '.join(f'{c} * {w}::DOUBLE' for c, (w, _) in H.COMPONENTS.items())} AS overall_score FROM comp)"""


def subjects(t):
    """Batches that ran: those with findings, and one per part without any."""
    return anomaly_feed(t).select("batch_id").union(t.part.select(F.concat(F.lit("part-"), "p_partkey"))).distinct()


def health(t):
    bronze = anomaly_feed(t).filter("failure_code LIKE 'DV-%'")
    return H.batch_health(bronze, ["batch_id"], F.lit(200), subjects(t))


@query("health_score", FEED + f", {HEALTH} SELECT batch_id, active_anomalies, {', '.join(f'round({c}, 6) AS {c}' for c in H.COMPONENTS)}, round(overall_score, 6) AS overall_score FROM health")
def health_score(t):
    return rounded(health(t), *H.COMPONENTS, "overall_score")


@query("health_summary", FEED + f""", {HEALTH},
c AS (SELECT batch_id, count(*) FILTER (WHERE severity = 'CRITICAL') AS cr, count(*) FILTER (WHERE severity = 'WARNING') AS wa FROM bronze_feed GROUP BY 1)
SELECT batch_id, CASE WHEN s >= 90 AND cr + wa = 0 THEN 'All systems healthy. No issues detected in the past 24 hours.' WHEN s >= 70 THEN 'Systems operating normally with ' || wa || ' minor issues under review.'
  WHEN s >= 50 THEN (cr + wa) || ' data quality issues detected. Some reports may be affected.' WHEN cr = 0 THEN 'ATTENTION: ' || cr || ' critical issues require immediate review. Review recommended.'
  ELSE 'ALERT: Major data quality problems detected. ' || cr || ' critical issues affecting data validation.' END AS summary,
  CASE WHEN s >= 90 THEN 'Excellent' WHEN s >= 70 THEN 'Good' WHEN s >= 50 THEN 'Fair' WHEN s >= 30 THEN 'Poor' ELSE 'Critical' END AS status
FROM (SELECT batch_id, round(overall_score, 9) AS s FROM health) JOIN c USING (batch_id)""")
def health_summary(t):
    counts = anomaly_feed(t).filter("failure_code LIKE 'DV-%'").groupBy("batch_id").agg(
        F.count_if(F.col("severity") == "CRITICAL").alias("cr"), F.count_if(F.col("severity") == "WARNING").alias("wa"))
    score = F.round("overall_score", 9)
    return health(t).join(counts, "batch_id").select(
        "batch_id", RP.health_summary(score, F.col("cr"), F.col("wa")).alias("summary"), H.status_label(score).alias("status"))


@query("staleness_message", f"""
SELECT source, CASE WHEN h < 1 THEN 'Data is current (updated within the last hour).' ELSE 'Customer data may not reflect orders from the last ' || CAST(floor(h) AS BIGINT) || ' hours.' END AS message
FROM (SELECT event_type AS source, date_diff('microsecond', max(ts), TIMESTAMP '{NOW}') // 1000000 / 3600.0 AS h FROM events GROUP BY 1)""")
def staleness_message(t):
    from tableward.functions.predicates import seconds_between

    last = t.events.groupBy(F.col("event_type").alias("source")).agg(F.max("ts").alias("last"))
    return last.select("source", RP.staleness_message(seconds_between(now(), F.col("last")) / 3600.0).alias("message"))


def _layers(group: str, source: str = "feed") -> str:
    points = {2: ("schema", 30, 10, 2), 3: ("business", 25, 10, 2), 4: ("freshness", 30, 15, 0), 5: ("model", 25, 10, 2), 6: ("ethics", 30, 12, 3)}
    scores = ", ".join(
        f"greatest(0.0::DOUBLE, 100 - coalesce(sum(CASE severity WHEN 'CRITICAL' THEN {c} WHEN 'WARNING' THEN {w} ELSE {i} END) FILTER (WHERE {LAYER} = {k} AND failure_code IS NOT NULL), 0)) AS {n}"
        for k, (n, c, w, i) in points.items())
    return f"""layers AS (SELECT {group} {scores}, count(*) FILTER (WHERE severity = 'CRITICAL' AND {LAYER} BETWEEN 2 AND 4) AS silver_blocking,
  count(*) FILTER (WHERE severity = 'CRITICAL' AND {LAYER} BETWEEN 5 AND 6) AS gold_blocking, bool_or(severity = 'CRITICAL') AS crit, bool_or(severity = 'CRITICAL' AND {LAYER} = 2) AS blocked, count(failure_code) AS anomalies FROM {source} {'GROUP BY ALL' if group else ''})"""


def _trend(x: str) -> str:
    return (f"CASE WHEN {x}_score - lag({x}_score) OVER w > 1 THEN 'improving' WHEN {x}_score - lag({x}_score) OVER w < -1 THEN 'degrading' ELSE 'stable' END AS {x}_trend")


CLEAN_DAYS = """,
fed AS (SELECT batch_id, severity, failure_code, detected_at FROM feed UNION ALL SELECT DISTINCT batch_id, NULL, NULL, TIMESTAMP '2023-12-31' FROM feed)"""


@query("tier_health", FEED + CLEAN_DAYS + f", {_layers('batch_id, CAST(detected_at AS DATE) AS day,', 'fed')}" + f""",
tiers AS (SELECT batch_id, day, least("schema", business, freshness) AS silver_score, silver_blocking, least(model, ethics) AS gold_score, gold_blocking FROM layers)
SELECT *, {_trend('silver')}, {_trend('gold')} FROM tiers WINDOW w AS (PARTITION BY batch_id ORDER BY day)""")
def tier_health(t):
    # Every batch was also checked the day before the history starts, without findings.
    clean = anomaly_feed(t).select("batch_id", F.lit("2023-12-31").cast("date").alias("day"))
    return H.tier_health(anomaly_feed(t).withColumn("day", F.to_date("detected_at")), ["batch_id"], "day", clean)


CLEAN_PARTS = """,
fed AS (SELECT batch_id, severity, failure_code FROM feed UNION ALL SELECT 'part-' || p_partkey, NULL, NULL FROM part)"""


@query("batch_result", FEED + CLEAN_PARTS + f", {_layers('batch_id,', 'fed')}" + """
SELECT batch_id, NOT coalesce(crit, false) AS passed, coalesce(blocked, false) AS blocked, anomalies, round(("schema" + business + freshness) / 3, 6) AS silver_overall, silver_health, least(model, ethics) AS gold_overall,
  CASE WHEN silver_health >= 90 THEN 'Excellent' WHEN silver_health >= 70 THEN 'Good' WHEN silver_health >= 50 THEN 'Fair' WHEN silver_health >= 30 THEN 'Poor' ELSE 'Critical' END AS status_label
FROM (SELECT *, least("schema", business, freshness) AS silver_health FROM layers)""")
def batch_result(t):
    return rounded(H.batch_results(anomaly_feed(t), ["batch_id"], subjects(t)), "silver_overall")


@query("layer_health", FEED + f", {_layers('')}, l AS (SELECT * FROM layers)" + f""",
bpen AS (SELECT {COMPONENT} AS comp, CASE severity WHEN 'CRITICAL' THEN 30 WHEN 'WARNING' THEN 15 ELSE 5 END AS p FROM feed WHERE failure_code LIKE 'DV-%'),
bh AS (SELECT {' + '.join(f"greatest(0.0::DOUBLE, 100 - coalesce(sum(p) FILTER (WHERE comp = '{c}'), 0)) * {w}::DOUBLE" for c, (w, _) in H.COMPONENTS.items())} AS score FROM bpen),
r AS (SELECT CAST(1 AS INTEGER) AS layer, 'bronze' AS name, score FROM bh UNION ALL SELECT 2, 'schema', "schema" FROM l UNION ALL SELECT 3, 'business', business FROM l UNION ALL SELECT 4, 'freshness', freshness FROM l
  UNION ALL SELECT 5, 'model', model FROM l UNION ALL SELECT 6, 'ethics', ethics FROM l)
SELECT layer, name, round(score, 6) AS score, round((SELECT min(score) FROM r), 6) AS overall FROM r""")
def layer_health(t):
    return rounded(H.layer_health(anomaly_feed(t)), "score", "overall")


@query("health_trend", f"""
WITH h AS (SELECT event_type AS scope, ts, least(100.0::DOUBLE, value) AS score FROM events WHERE ts >= TIMESTAMP '{NOW}' - INTERVAL 500 HOUR AND ts <= TIMESTAMP '{NOW}'),
k AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY scope ORDER BY ts DESC, score DESC) <= 100)
SELECT scope, ts, score, round(score - lag(score) OVER w, 6) AS delta, CASE WHEN score - lag(score) OVER w > 1 THEN 'improving' WHEN score - lag(score) OVER w < -1 THEN 'degrading' ELSE 'stable' END AS trend
FROM k WINDOW w AS (PARTITION BY scope ORDER BY ts, score)""")
def health_trend(t):
    history = t.events.select(F.col("event_type").alias("scope"), "ts", F.least(F.lit(100.0), "value").alias("score"))
    return rounded(H.recent_history(history, ["scope"], "ts", "score", now(), hours=500), "delta")


@query("anomaly_stats", FEED + f"""
SELECT 'severity' AS scope, severity AS value, count(*) AS n FROM feed GROUP BY 2 UNION ALL SELECT 'batch_id', batch_id, count(*) FROM feed GROUP BY 2
UNION ALL SELECT 'failure_code', failure_code, count(*) FROM feed GROUP BY 2 UNION ALL SELECT 'layer', CAST({LAYER} AS VARCHAR), count(*) FROM feed GROUP BY 2 UNION ALL SELECT 'total', '*', count(*) FROM feed""")
def anomaly_stats(t):
    return H.anomaly_counts(anomaly_feed(t))


@query("column_breakdown", FEED + """,
x AS (SELECT source AS field, affected_count, severity FROM feed UNION ALL SELECT 'value', affected_count, severity FROM feed)
SELECT field, count(*) AS issues, CAST(sum(affected_count) AS BIGINT) AS rows, CASE max(CASE severity WHEN 'CRITICAL' THEN 2 WHEN 'WARNING' THEN 1 ELSE 0 END) WHEN 2 THEN 'CRITICAL' WHEN 1 THEN 'WARNING' ELSE 'INFO' END AS worst FROM x GROUP BY 1""")
def column_breakdown(t):
    return H.column_breakdown(anomaly_feed(t))


@query("cost_attribution", FEED + " SELECT source, count(*) AS anomalies, count(*) * 12.5::DOUBLE AS compute_cost, count(*) * 75.0::DOUBLE AS labour_cost, count(*) * 87.5::DOUBLE AS total_cost FROM feed GROUP BY 1")
def cost_attribution(t):
    return RP.cost_attribution(anomaly_feed(t))


# Timeline -------------------------------------------------------------------------------------

RESULTS = """
results AS (SELECT 'R' || o_custkey AS result_id, 'B' || o_custkey AS batch_id, max(o_orderdate) AS validated_at, max(o_totalprice) < 400000 AS passed FROM orders GROUP BY o_custkey),
audit AS (SELECT 'L' || event_id AS audit_id, event_type, CASE WHEN value > 200 THEN 'ERROR' WHEN value > 100 THEN 'warning' ELSE 'DEBUG' END AS level, 'B' || user_id AS batch_id, ts FROM events WHERE event_type = 'error'),
timeline AS (
  SELECT 'val_' || result_id AS event_id, 'validation_complete' AS event_type, validated_at AS ts, CASE WHEN passed THEN 'INFO' ELSE 'CRITICAL' END AS severity, batch_id, CAST(1 AS INTEGER) AS layer, CAST(NULL AS VARCHAR) AS anomaly_id FROM results
  UNION ALL SELECT 'anom_' || anomaly_id, 'anomaly_detected', detected_at, severity, batch_id, {layer}, anomaly_id FROM feed
  UNION ALL SELECT 'audit_' || audit_id, event_type, ts, CASE upper(level) WHEN 'ERROR' THEN 'CRITICAL' WHEN 'WARNING' THEN 'WARNING' ELSE 'INFO' END, batch_id, 1, NULL FROM audit)""".format(layer=LAYER)


def results(t):
    return t.orders.groupBy("o_custkey").agg(
        F.max("o_orderdate").alias("validated_at"), (F.max("o_totalprice") < 400000).alias("passed"),
    ).select(F.concat(F.lit("R"), "o_custkey").alias("result_id"), F.concat(F.lit("B"), "o_custkey").alias("batch_id"), "validated_at", "passed")


def events_of(t):
    audit = t.events.filter("event_type = 'error'").select(
        F.concat(F.lit("L"), "event_id").alias("audit_id"), "event_type",
        F.when(F.col("value") > 200, "ERROR").when(F.col("value") > 100, "warning").otherwise("DEBUG").alias("level"),
        F.concat(F.lit("B"), "user_id").alias("batch_id"), "ts")
    return RP.timeline(results(t), anomaly_feed(t), audit)


@query("timeline", FEED + f", {RESULTS} SELECT * FROM timeline")
def timeline(t):
    return events_of(t).orderBy(F.col("ts").desc(), "event_id")


@query("event_details", FEED + f""", {RESULTS}
SELECT event_id, e.event_type, e.ts, e.severity, e.batch_id, layer, e.anomaly_id, result_id AS related_result, passed, failure_code, affected_count
FROM timeline e LEFT JOIN results USING (batch_id) LEFT JOIN feed ON feed.anomaly_id = e.anomaly_id""")
def event_details(t):
    return RP.event_details(events_of(t), results(t), anomaly_feed(t))


@query("timeline_groups", """
WITH RECURSIVE ev AS (SELECT 'W' || dayofweek(ts) AS batch_id, ts FROM events),
anchors AS (SELECT batch_id, max(ts) AS anchor FROM ev GROUP BY 1
  UNION ALL SELECT a.batch_id, (SELECT max(ts) FROM ev WHERE ev.batch_id = a.batch_id AND ts < a.anchor - INTERVAL 60 SECOND) FROM anchors a WHERE a.anchor IS NOT NULL)
SELECT a.batch_id, a.anchor AS group_ts, min(ev.ts) AS oldest_ts, count(*) AS events, 'common_cause' AS correlation_type, count(*) || ' related events' AS title
FROM anchors a JOIN ev ON ev.batch_id = a.batch_id AND ev.ts BETWEEN a.anchor - INTERVAL 60 SECOND AND a.anchor GROUP BY 1, 2 HAVING count(*) > 1""")
def timeline_groups(t):
    return RP.event_groups(t.events.select(F.concat(F.lit("W"), F.dayofweek("ts") - 1).alias("batch_id"), "ts"))
