"""Feeds and reports over results, anomalies and audit rows."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableward.functions import chains
from tableward.model import CRITICAL, INFO, WARNING, describe, layer_of, severity_rank, tier_of
from tableward.session import cut_lineage

# Grouping runs in Python workers, which need not have this package installed.
register_pickle_by_value(chains)

# Failure code -> business wording of the impact report.
IMPACT = {
    "DV-001": ("The expected number of records was not received.",
               "Expected {expected} records but received {actual}. This may indicate missing or duplicate data transfers.",
               ("Data reconciliation", "Reporting accuracy"),
               ("Verify source system data extraction", "Check for transfer errors or timeouts", "Compare with source system counts"),
               "Medium"),
    "DV-002": ("Required information is missing from records.",
               "{field} is missing in {count} records ({percentage}% of batch). Affected records cannot be processed.",
               ("Customer data completeness", "Order processing", "Regulatory reporting"),
               ("Identify source of missing data", "Check upstream data entry processes", "Review affected records manually"),
               "High"),
    "DV-003": ("Data format does not match expected type.",
               "{field} contains invalid data type in {count} records. Expected {expected_type} but found {actual_type}.",
               ("Data integration", "Automated processing"),
               ("Review source data format", "Check for encoding issues", "Validate data entry forms"),
               "Medium"),
    "DV-004": ("Data values are outside acceptable limits.",
               "{field} contains out-of-range values ({min_found} to {max_found}). Expected range: {expected_min} to {expected_max}.",
               ("Financial calculations", "Inventory management", "Performance metrics"),
               ("Verify business rules for valid ranges", "Check for data entry errors", "Review automated calculations"),
               "High"),
    "DV-005": ("Data does not match expected format or pattern.",
               "{field} format is invalid in {count} records. Examples: {examples}.",
               ("Email communications", "Phone contact", "Address verification"),
               ("Review data entry validation", "Check for copy-paste errors", "Validate import mappings"),
               "Low"),
    "DV-006": ("Identical records found in the dataset.",
               "{count} duplicate records detected. This may cause double-counting in reports.",
               ("Financial reporting", "Customer counts", "Inventory tracking"),
               ("Identify duplicate source", "Review deduplication logic", "Check for double-submission"),
               "High"),
    "DV-007": ("Character encoding issues detected in data.",
               "Invalid characters found in {count} records. This may affect display and searchability.",
               ("Customer communications", "Search functionality", "Data export"),
               ("Check source system encoding settings", "Verify file transfer settings", "Review international character handling"),
               "Low"),
    "DV-008": ("Data structure does not match expected format.",
               "Schema mismatch detected: {details}. Data cannot be processed until resolved.",
               ("Data pipeline", "Integration systems", "All downstream processes"),
               ("Contact source system team", "Review schema change history", "Update integration mappings"),
               "Critical"),
}
# What codes without an entry get.
DEFAULT_PROCESSES = ("Data processing", "Reporting")
DEFAULT_ACTIONS = ("Review affected records", "Contact data team if issue persists")
# Cost of handling one anomaly.
COST_COMPUTE, COST_LABOUR = 12.5, 75.0


def filtered(anomalies: DataFrame, severities: Sequence[str] = (), layers: Sequence[int] = (),
             since: Column | None = None, until: Column | None = None, sources: Sequence[str] = ()) -> DataFrame:
    """Conjunction of the filters given; each reaches the scan where the storage can use it."""
    if severities:
        anomalies = anomalies.filter(F.col("severity").isin(*severities))
    if layers:
        anomalies = anomalies.filter(layer_of(F.col("failure_code")).isin(*layers))
    if since is not None:
        anomalies = anomalies.filter(F.col("detected_at") >= since)
    if until is not None:
        anomalies = anomalies.filter(F.col("detected_at") <= until)
    if sources:
        anomalies = anomalies.filter(F.col("source").isin(*sources))
    return anomalies


def unacknowledged(anomalies: DataFrame, acknowledged: DataFrame) -> DataFrame:
    return anomalies.join(acknowledged.select("anomaly_id"), "anomaly_id", "left_anti")


def drill_down(df: DataFrame, key: Column, violations: DataFrame, fields: Sequence[str], rows: int = 20) -> DataFrame:
    """The first rows behind one anomaly, with the affected fields only."""
    keyed = df.withColumn("row_key", key)
    return keyed.join(violations.select("row_key"), "row_key", "left_semi").select(
        "row_key", *fields).orderBy("row_key").limit(rows)


def impact_report(anomalies: DataFrame) -> DataFrame:
    """Anomalies in business words.

    A template whose placeholders cannot all be filled, from the anomaly or its ``details``,
    gives way to the plain description.
    """
    spark = anomalies.sparkSession
    dimension = spark.createDataFrame(
        [(k, d, t, list(p), list(a), i) for k, (d, t, p, a, i) in IMPACT.items()],
        "failure_code string, _description string, _template string, _processes array<string>, "
        "_actions array<string>, _impact string")
    joined = anomalies.join(F.broadcast(dimension), "failure_code", "left")
    n = F.col("affected_count")
    fields = F.when(F.size("affected_fields") > 0, F.array_join("affected_fields", ", ")).otherwise("Field")
    standard = {
        "{count}": n.cast("string"), "{percentage}": F.round(n.cast("double"), 1).cast("string"),
        "{field}": fields, "{expected}": F.lit("expected"), "{actual}": F.lit("actual"),
        "{root_cause}": F.col("root_cause"),
    }
    # Values of the anomaly itself win over the fixed words, so they go in first.
    text = F.coalesce("_template", F.lit("{root_cause}"))
    text = F.aggregate(F.map_entries(F.coalesce("details", F.create_map().cast("map<string,string>"))), text,
                       lambda acc, e: F.replace(acc, F.concat(F.lit("{"), e["key"], F.lit("}")), e["value"]))
    for name, value in standard.items():
        text = F.replace(text, F.lit(name), value)
    plain = F.coalesce("_description", F.concat(F.lit("Data quality issue detected: "), "root_cause"))
    words = lambda xs: F.array(*[F.lit(x) for x in xs])
    critical, info = F.col("severity") == CRITICAL, F.col("severity") == INFO
    return joined.select(
        "anomaly_id", "failure_code",
        F.when(text.rlike(r"\{[a-z_]+\}"), plain).otherwise(text).alias("business_description"),
        F.coalesce("_processes", words(DEFAULT_PROCESSES)).alias("affected_processes"),
        F.coalesce("_actions", words(DEFAULT_ACTIONS)).alias("recommended_actions"),
        F.when(critical, words(["All Customers"])).when(n > 100, words(["Enterprise", "Small Business"]))
        .otherwise(words(["Affected Records Only"])).alias("affected_segments"),
        F.when(critical, "High").when(info, "Low").otherwise(F.coalesce("_impact", F.lit("Medium"))).alias("estimated_impact"))


def alerts(anomalies: DataFrame) -> DataFrame:
    """Warnings and critical findings with their message, most urgent first by ``priority``."""
    message = F.format_string("[%s] %s: %s (%s records affected in batch %s)", "severity", "failure_code",
                              "root_cause", F.col("affected_count").cast("string"), "batch_id")
    return anomalies.filter(F.col("severity").isin(WARNING, CRITICAL)).select(
        "anomaly_id", "batch_id", "severity", message.alias("message"),
        severity_rank(F.col("severity")).alias("priority"))


def health_summary(score: Column, critical: Column, warning: Column) -> Column:
    """One sentence about a scope."""
    text = lambda c: c.cast("string")
    return (
        F.when((score >= 90) & (critical + warning == 0),
               "All systems healthy. No issues detected in the past 24 hours.")
        .when(score >= 70, F.concat(F.lit("Systems operating normally with "), text(warning), F.lit(" minor issues under review.")))
        .when(score >= 50, F.concat(text(critical + warning), F.lit(" data quality issues detected. Some reports may be affected.")))
        .when(critical == 0, F.concat(F.lit("ATTENTION: "), text(critical), F.lit(" critical issues require immediate review. Review recommended.")))
        .otherwise(F.concat(F.lit("ALERT: Major data quality problems detected. "), text(critical),
                            F.lit(" critical issues affecting data validation.")))
    )


def staleness_message(hours: Column) -> Column:
    return F.when(hours < 1, "Data is current (updated within the last hour).").otherwise(
        F.concat(F.lit("Customer data may not reflect orders from the last "), F.floor(hours).cast("string"), F.lit(" hours.")))


def cost_attribution(anomalies: DataFrame, by: str = "source") -> DataFrame:
    n = F.count(F.lit(1))
    return anomalies.groupBy(by).agg(
        n.alias("anomalies"), (n * COST_COMPUTE).alias("compute_cost"), (n * COST_LABOUR).alias("labour_cost"),
        (n * (COST_COMPUTE + COST_LABOUR)).alias("total_cost"))


def export_rows(anomalies: DataFrame) -> DataFrame:
    """The columns of the compliance export."""
    code = F.col("failure_code")
    return anomalies.select(tier_of(code).alias("tier"), layer_of(code).alias("layer"), "severity", "failure_code",
                            describe(code).alias("description"), "detected_at")


def export_summary(anomalies: DataFrame) -> DataFrame:
    """The compliance document: one JSON text over all anomalies."""
    is_ = lambda s: F.count_if(F.col("severity") == s)
    return anomalies.agg(
        F.count(F.lit(1)).alias("total"), is_(CRITICAL).alias("critical"), is_(WARNING).alias("warning"),
        is_(INFO).alias("info"), F.count_distinct("batch_id").alias("batches"),
    ).select(F.to_json(F.struct("total", "critical", "warning", "info", "batches")).alias("document"))


# Timeline -------------------------------------------------------------------------------------

# Audit log level -> severity.
LOG_LEVELS = {"CRITICAL": CRITICAL, "ERROR": CRITICAL, "WARNING": WARNING, "INFO": INFO, "DEBUG": INFO}


def timeline(results: DataFrame, anomalies: DataFrame, audit: DataFrame) -> DataFrame:
    """Results, anomalies and audit rows as events of one shape."""
    code = F.col("failure_code")
    level = F.lit(INFO)
    for name, severity in LOG_LEVELS.items():
        level = F.when(F.upper("level") == name, severity).otherwise(level)
    done = results.select(
        F.concat(F.lit("val_"), "result_id").alias("event_id"), F.lit("validation_complete").alias("event_type"),
        F.col("validated_at").alias("ts"), F.when(F.col("passed"), INFO).otherwise(CRITICAL).alias("severity"),
        "batch_id", F.lit(1).alias("layer"), F.lit(None).cast("string").alias("anomaly_id"))
    found = anomalies.select(
        F.concat(F.lit("anom_"), "anomaly_id").alias("event_id"), F.lit("anomaly_detected").alias("event_type"),
        F.col("detected_at").alias("ts"), "severity", "batch_id", layer_of(code).alias("layer"), "anomaly_id")
    logged = audit.select(
        F.concat(F.lit("audit_"), "audit_id").alias("event_id"), "event_type", "ts", level.alias("severity"),
        "batch_id", F.lit(1).alias("layer"), F.lit(None).cast("string").alias("anomaly_id"))
    return done.unionByName(found).unionByName(logged)


def event_details(events: DataFrame, results: DataFrame, anomalies: DataFrame) -> DataFrame:
    """Each event with the result of its batch and the anomaly it is about."""
    outcome = results.select("batch_id", F.col("result_id").alias("related_result"), "passed")
    cause = anomalies.select("anomaly_id", "failure_code", "affected_count")
    return events.join(outcome, "batch_id", "left").join(cause, "anomaly_id", "left")


def _micros(ts: Column) -> Column:
    """Microseconds since 1970, independent of the session time zone."""
    days = F.datediff(ts, F.lit("1970-01-01").cast("date")).cast("bigint")
    second = (F.extract(F.lit("SECOND"), ts) * 1_000_000).cast("bigint")
    return ((days * 24 + F.hour(ts)) * 60 + F.minute(ts)) * 60_000_000 + second


def event_groups(events: DataFrame, width_seconds: int = 60) -> DataFrame:
    """Greedy groups per batch: the newest event left takes every event up to a minute older.

    Where a group starts depends on the one before it, all the way from the newest event of the
    batch.  Distinct times are cut into ranges of equal row counts, whatever their density, so that
    no batch has to fit one task: each range first tells, for every way the scan can enter it, how
    the scan leaves (a few rows); these are chained per batch; then each range labels its own times.
    """
    width = width_seconds * 1_000_000
    times = events.filter(F.col("batch_id").isNotNull() & (F.col("batch_id") != "")).groupBy(
        "batch_id", _micros(F.col("ts")).alias("us")).agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("ts"))
    chunked = cut_lineage(times.repartitionByRange("batch_id", "us").withColumn(
        "chunk", F.spark_partition_id().cast("bigint")))

    def leave(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        batch, chunk = key
        ordered = np.sort(pdf["us"].to_numpy())
        # Later ranges hold later times only, so the scan enters above the last time here.
        steps = chains.transfer(ordered, int(ordered[-1]) + 1, width)
        return pd.DataFrame({"batch_id": batch, "chunk": chunk, "start": [s for s, _ in steps],
                             "leaving": [e for _, e in steps]})

    def chain(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        bound, rows = chains.END, []
        for chunk, part in sorted(pdf.groupby("chunk"), key=lambda x: -x[0]):
            rows.append((key[0], chunk, bound))
            part = part.sort_values("start")
            bound = chains.enter(list(zip(part["start"].tolist(), part["leaving"].tolist())), bound)
        return pd.DataFrame(rows, columns=["batch_id", "chunk", "bound"])

    def mark(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("us")
        pdf["anchor"] = chains.label(pdf["us"].to_numpy(), int(pdf["bound"].iloc[0]), width)
        return pdf[["batch_id", "us", "anchor", "n", "ts"]]

    by_chunk = ["batch_id", "chunk"]
    steps = chunked.select(*by_chunk, "us").groupBy(*by_chunk).applyInPandas(
        leave, "batch_id string, chunk long, start long, leaving long")
    bounds = steps.groupBy("batch_id").applyInPandas(chain, "batch_id string, chunk long, bound long")
    marked = chunked.join(bounds, by_chunk).groupBy(*by_chunk).applyInPandas(
        mark, "batch_id string, us long, anchor long, n long, ts timestamp_ntz")
    return marked.groupBy("batch_id", "anchor").agg(
        F.max("ts").alias("group_ts"), F.min("ts").alias("oldest_ts"), F.sum("n").alias("events"),
    ).filter("events > 1").select(
        "batch_id", "group_ts", "oldest_ts", "events", F.lit("common_cause").alias("correlation_type"),
        F.concat(F.col("events").cast("string"), F.lit(" related events")).alias("title"))


