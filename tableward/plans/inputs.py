"""Inputs derived from the given tables, in Spark and as SQL common table expressions.

The tables hold few faults of their own, so faults are put in by key arithmetic: every row
stays, some values change.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dirty_events(t) -> DataFrame:
    e = F.col("event_id")
    return t.events.select(
        "event_id", "ts", "user_id",
        F.when(e % 89 == 0, "  ").otherwise(F.col("event_type")).alias("event_type"),
        F.when(e % 7 == 0, None).when(e % 71 == 0, -F.col("value")).otherwise(F.col("value")).alias("value"),
        F.when(e % 13 == 0, "n/a").otherwise(F.col("value").cast("string")).alias("value_text"),
        F.when(e % 50 == 0, F.unhex(F.lit("61FF"))).otherwise(F.col("props").cast("binary")).alias("raw"),
        "props",
    )


DIRTY_EVENTS = """
dirty AS (
  SELECT event_id, ts, user_id,
    CASE WHEN event_id % 89 = 0 THEN '  ' ELSE event_type END AS event_type,
    CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 71 = 0 THEN -value ELSE value END AS value,
    CASE WHEN event_id % 13 = 0 THEN 'n/a' ELSE CAST(value AS VARCHAR) END AS value_text,
    event_id % 50 = 0 AS bad_bytes, props
  FROM events)"""


def anomaly_feed(t) -> DataFrame:
    """A history of findings: one per event, spread over all layers and severities."""
    k = F.get_json_object("props", "$.k").cast("int")
    prefix = (
        F.when(k < 40, "DV").when(k < 55, "SC").when(k < 70, "BL")
        .when(k < 80, "FR").when(k < 90, "ML").otherwise("ET")
    )
    return t.events.select(
        F.concat(F.lit("A"), F.col("event_id")).alias("anomaly_id"),
        F.concat(F.lit("B"), F.col("user_id")).alias("batch_id"),
        F.concat(prefix, F.lit("-00"), (k % 8 + 1)).alias("failure_code"),
        F.when(F.col("value") >= 150, "CRITICAL").when(F.col("value") >= 50, "WARNING")
        .otherwise("INFO").alias("severity"),
        k.cast("bigint").alias("affected_count"),
        F.array("event_type", F.lit("value")).alias("affected_fields"),
        F.col("event_type").alias("source"),
        F.col("ts").alias("detected_at"),
    )


ANOMALY_FEED = """
feed AS (
  SELECT 'A' || event_id AS anomaly_id, 'B' || user_id AS batch_id,
    CASE WHEN k < 40 THEN 'DV' WHEN k < 55 THEN 'SC' WHEN k < 70 THEN 'BL'
         WHEN k < 80 THEN 'FR' WHEN k < 90 THEN 'ML' ELSE 'ET' END || '-00' || (k % 8 + 1) AS failure_code,
    CASE WHEN value >= 150 THEN 'CRITICAL' WHEN value >= 50 THEN 'WARNING' ELSE 'INFO' END AS severity,
    CAST(k AS BIGINT) AS affected_count, event_type AS source, ts AS detected_at
  FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k FROM events))"""


def prediction_log(t) -> DataFrame:
    """Events read as predictions: the second half of the month is the current period."""
    k = F.get_json_object("props", "$.k").cast("int")
    current = F.col("ts") >= F.lit("2024-01-16").cast("timestamp_ntz")
    drifted = F.when(current & F.col("event_type").isin("view", "error"), F.col("value") * 1.5)
    return t.events.select(
        F.col("event_type").alias("model_id"), "ts",
        F.when(current, "current").otherwise("baseline").alias("period"),
        F.coalesce(drifted, F.col("value")).alias("prediction"),
        (F.when(current, k * 0.7).otherwise(k * 1.0) / 100.0).alias("confidence"),
        (F.when(current, F.col("value") * 3).otherwise(F.col("value"))).alias("latency_ms"),
        F.when(current, k < 25).otherwise(k < 10).alias("is_error"),
        F.col("user_id").cast("double").alias("f_user"),
        k.cast("double").alias("f_k"),
    )


PREDICTION_LOG = """
log AS (
  SELECT event_type AS model_id, ts,
    CASE WHEN cur THEN 'current' ELSE 'baseline' END AS period,
    CASE WHEN cur AND event_type IN ('view', 'error') THEN value * 1.5::DOUBLE ELSE value END AS prediction,
    CASE WHEN cur THEN k * 0.7::DOUBLE ELSE k * 1.0::DOUBLE END / 100.0::DOUBLE AS confidence,
    CASE WHEN cur THEN value * 3 ELSE value END AS latency_ms,
    CASE WHEN cur THEN k < 25 ELSE k < 10 END AS is_error,
    CAST(user_id AS DOUBLE) AS f_user, CAST(k AS DOUBLE) AS f_k
  FROM (SELECT *, ts >= TIMESTAMP '2024-01-16' AS cur,
          CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k FROM events))"""


# SQL text helpers -----------------------------------------------------------------------------

def case_bands(value: str, table, below: bool = False) -> str:
    bands, rest = table
    op = "<=" if below else ">="
    quote = lambda v: f"'{v}'" if isinstance(v, str) else f"{v}::DOUBLE"
    arms = " ".join(f"WHEN {value} {op} {b} THEN {quote(s)}" for b, s in bands)
    return f"CASE {arms} ELSE {quote(rest)} END"


LEVEL = "CASE WHEN {0} >= 70 THEN 'CRITICAL' WHEN {0} >= 40 THEN 'WARNING' ELSE 'INFO' END"


def finding_sql(name: str, code: str, field: str, n: str, total: str, source: str, score: str,
                tolerance: float = 0.0, level: str = LEVEL) -> str:
    """One finding row; ``score`` is SQL over ``pct`` and ``n``."""
    return f"""
SELECT '{name}' AS check_name, '{code}' AS failure_code, '{field}' AS field,
  CAST(n AS BIGINT) AS affected_count, CAST(total AS BIGINT) AS total_count,
  round(pct, 6) AS affected_pct,
  CASE WHEN failed THEN score END AS severity_score,
  CASE WHEN failed THEN {level.format('score')} END AS severity, failed
FROM (SELECT *, n > 0 AND pct > {tolerance} AS failed, {score} AS score FROM (
  SELECT *, n * 100.0::DOUBLE / total AS pct FROM (
    SELECT {n} AS n, {total} AS total FROM {source})))"""


# A registry of contracts ------------------------------------------------------------------------

CONTRACT_COLUMN_NAMES = (
    "contract_id", "version", "source", "additional_properties", "column_name", "column_type",
    "criticality", "nullable", "is_unique", "min_length", "max_length", "minimum", "maximum",
    "pattern", "enum_values",
)


def contract_registry(t) -> DataFrame:
    """One contract per part in two versions, one column per line number seen in that version."""
    p = F.col("l_partkey")
    old = F.col("l_linestatus") == "F"
    facts = t.lineitem.groupBy("l_partkey", "l_linestatus", "l_linenumber").agg(
        F.min("l_returnflag").alias("flag"), F.max("l_discount").alias("discount"),
        F.max("l_quantity").cast("int").alias("high"), F.min("l_quantity").cast("int").alias("low"),
        F.max("l_tax").alias("tax"))
    newer = F.when(p % 4 == 0, "2.0.0").otherwise(
        F.concat(F.lit("1."), p % 3 + p % 2, F.lit("."), p % 5))
    return facts.select(
        F.concat(F.lit("C"), p).alias("contract_id"),
        F.when(old, F.concat(F.lit("1."), p % 3, F.lit(".0"))).otherwise(newer).alias("version"),
        F.concat(F.lit("source-"), p % 50).alias("source"),
        F.when(old, p % 6 != 0).otherwise(p % 4 != 0).alias("additional_properties"),
        F.concat(F.lit("c"), F.col("l_linenumber")).alias("column_name"),
        F.when(F.col("flag") == "A", "integer").when(F.col("flag") == "N", "number").otherwise("string").alias("column_type"),
        F.when(F.col("discount") >= 0.08, "required").otherwise("optional").alias("criticality"),
        (F.col("tax") < 0.06).alias("nullable"), (F.col("high") == 50).alias("is_unique"),
        F.when(F.col("low") >= 10, F.col("low")).alias("min_length"), F.col("high").alias("max_length"),
        F.when(F.col("low") < 20, F.col("low").cast("double")).alias("minimum"),
        (F.col("high") * 10.0).alias("maximum"),
        F.when(F.col("high") % 5 == 0, "^[A-Z]").when(F.col("high") % 5 == 1, "^[a-z]").alias("pattern"),
        F.when(F.col("low") % 3 == 0, F.array(F.lit("x"), F.lit("y")))
        .when(F.col("low") % 3 == 1, F.array(F.lit("x"))).alias("enum_values"),
        "l_linestatus",
    )


CONTRACT_REGISTRY = """
registry AS (
  SELECT 'C' || p AS contract_id,
    CASE WHEN st = 'F' THEN '1.' || (p % 3) || '.0' WHEN p % 4 = 0 THEN '2.0.0' ELSE '1.' || (p % 3 + p % 2) || '.' || (p % 5) END AS version,
    'source-' || (p % 50) AS source,
    CASE WHEN st = 'F' THEN p % 6 <> 0 ELSE p % 4 <> 0 END AS additional_properties,
    'c' || l_linenumber AS column_name,
    CASE flag WHEN 'A' THEN 'integer' WHEN 'N' THEN 'number' ELSE 'string' END AS column_type,
    CASE WHEN discount >= 0.08 THEN 'required' ELSE 'optional' END AS criticality,
    tax < 0.06 AS nullable, high = 50 AS is_unique,
    CASE WHEN low >= 10 THEN low END AS min_length, high AS max_length,
    CASE WHEN low < 20 THEN CAST(low AS DOUBLE) END AS minimum, high * 10.0::DOUBLE AS maximum,
    CASE WHEN high % 5 = 0 THEN '^[A-Z]' WHEN high % 5 = 1 THEN '^[a-z]' END AS pattern,
    CASE WHEN low % 3 = 0 THEN ['x', 'y'] WHEN low % 3 = 1 THEN ['x'] END AS enum_values,
    st AS l_linestatus
  FROM (SELECT l_partkey AS p, l_linestatus AS st, l_linenumber, min(l_returnflag) AS flag, max(l_discount) AS discount,
      CAST(max(l_quantity) AS INTEGER) AS high, CAST(min(l_quantity) AS INTEGER) AS low, max(l_tax) AS tax
    FROM lineitem GROUP BY ALL))"""
