"""Failure codes, severities and the layers they belong to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# Failure code -> description.
CODE_TEXT = {
    "DV-001": "Actual record count differs from expected",
    "DV-002": "Unexpected null or missing values in required field",
    "DV-003": "Field value does not match expected data type",
    "DV-004": "Numeric value outside allowed range",
    "DV-005": "Value does not match expected pattern/format",
    "DV-006": "Exact duplicate record found",
    "DV-007": "Invalid character encoding detected",
    "DV-008": "Record structure does not match expected schema",
    "SC-001": "Required column absent from data",
    "SC-002": "Unexpected column present in data",
    "SC-003": "Column data type differs from contract",
    "SC-004": "Numeric precision insufficient for declared contract",
    "SC-005": "Primary/foreign key or uniqueness violated",
    "SC-006": "Schema version incompatible with consumer expectation",
    "SC-007": "Non-backward-compatible schema modification detected",
    "SC-008": "API/data contract signature differs from registered version",
    "BL-001": "Related fields have logically incompatible values",
    "BL-002": "Referenced entity does not exist",
    "BL-003": "Derived/aggregated value does not match inputs",
    "BL-004": "Entity moved to impossible state",
    "BL-005": "Date/time value violates business time rules",
    "BL-006": "Value breaks explicit business constraint",
    "BL-007": "Statistical profile significantly different from baseline",
    "BL-008": "Record has no valid parent/owner",
    "FR-001": "Time since last update exceeds freshness threshold",
    "FR-002": "Delivery deadline missed",
    "FR-003": "Delivery at risk (threshold proximity exceeded)",
    "FR-004": "Processing duration exceeds expected window",
    "FR-005": "Expected data arrival did not occur",
    "FR-006": "Scheduled pipeline execution failed",
    "FR-007": "Upstream dependency late, blocking downstream",
    "FR-008": "End-to-end time significantly above baseline",
    "ML-001": "Model predictions drifting from expected distribution",
    "ML-002": "Input feature distribution shift detected",
    "ML-003": "Model age exceeds recommended retraining interval",
    "ML-004": "Prediction confidence scores degrading over time",
    "ML-005": "Model inference latency exceeds threshold",
    "ML-006": "Model error rate increased significantly",
    "ML-007": "Input data schema incompatible with model expectations",
    "ML-008": "Model performance indicates retraining required",
    "ET-001": "Outcome disparity across demographic groups detected",
    "ET-002": "Fairness metric threshold violated",
    "ET-003": "Disproportionate impact on protected class identified",
    "ET-004": "Model decision lacks sufficient explainability",
    "ET-005": "Data usage may violate consent constraints",
    "ET-006": "Personally identifiable information exposure risk",
    "ET-007": "Decision audit trail incomplete or missing",
    "ET-008": "Regulatory compliance requirement not met",
}

# Code prefix -> (tier, layer number).
LAYERS = {
    "DV": ("bronze", 1),
    "SC": ("silver_schema", 2),
    "BL": ("silver_business", 3),
    "FR": ("silver_freshness", 4),
    "ML": ("gold_model_health", 5),
    "ET": ("gold_ethics", 6),
}

CRITICAL, WARNING, INFO = "CRITICAL", "WARNING", "INFO"

# One row shape for the findings of all six layers.
ANOMALY_DDL = (
    "batch_id string, tier string, layer int, failure_code string, severity string, "
    "severity_score double, check_name string, rule_id string, subject string, "
    "affected_fields array<string>, affected_count bigint, affected_pct double, "
    "sample_keys array<string>, blocking boolean, expected string, actual string, "
    "explanation string, detected_at timestamp, details map<string,string>"
)


def _lookup(code: Column, pick) -> Column:
    prefix = F.substring(code, 1, 2)
    chain = None
    for key, entry in LAYERS.items():
        cond, value = prefix == key, F.lit(pick(entry))
        chain = F.when(cond, value) if chain is None else chain.when(cond, value)
    return chain


def tier_of(code: Column) -> Column:
    return F.coalesce(_lookup(code, lambda e: e[0]), F.lit("unknown"))


def layer_of(code: Column) -> Column:
    return F.coalesce(_lookup(code, lambda e: e[1]), F.lit(0))


def describe(code: Column) -> Column:
    pairs = [F.lit(x) for kv in CODE_TEXT.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), code), F.lit("Unknown failure"))


def severity_rank(severity: Column) -> Column:
    return F.when(severity == CRITICAL, 2).when(severity == WARNING, 1).otherwise(0)


def severity_name(rank: Column) -> Column:
    return F.when(rank == 2, CRITICAL).when(rank == 1, WARNING).otherwise(INFO)


def _case(pick) -> str:
    arms = " ".join(f"WHEN '{key}' THEN {pick(entry)!r}" for key, entry in LAYERS.items())
    return f"CASE left(failure_code, 2) {arms} END"


def as_anomalies(df: DataFrame, batch_id: str, as_of: str, **columns: Column) -> DataFrame:
    """Project findings onto the shared anomaly row.

    ``df`` supplies any subset of the anomaly columns by name, ``columns`` adds to or overrides
    them; what neither gives is null.
    """
    given = df.withColumns(columns) if columns else df
    derived = {
        "batch_id": f"'{batch_id}'", "detected_at": f"'{as_of}'", "blocking": "false",
        "tier": _case(lambda e: e[0]), "layer": _case(lambda e: e[1]),
    }
    return given.selectExpr(*[
        f"CAST({f'`{f.name}`' if f.name in given.columns else derived.get(f.name, 'NULL')} "
        f"AS {f.dataType.simpleString()}) AS {f.name}"
        for f in StructType.fromDDL(ANOMALY_DDL).fields
    ])
