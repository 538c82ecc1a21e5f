"""Whole validations: all layers over one table, all checks over one prediction log."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from tableward.functions import severity as S
from tableward.model import CRITICAL, WARNING, as_anomalies
from tableward.model import LAYERS as LAYERS_BY_CODE
from tableward.operators import bronze as B
from tableward.operators import checks as U
from tableward.operators import contracts as C
from tableward.operators import ethics as E
from tableward.operators import freshness as FR
from tableward.operators import models as M
from tableward.operators import references as J
from tableward.operators import rules as R
from tableward.operators import statistics as D
from tableward.session import cut_lineage
from tableward.sources.definitions import contract_table


@dataclass(frozen=True)
class ReferenceCheck:
    field: str
    reference: DataFrame
    key: str
    allow_null: bool = False


@dataclass(frozen=True)
class Suite:
    """What to check.  Whatever is left out is not checked."""

    keys: tuple[str, ...]
    bronze: B.BatchSpec = field(default_factory=B.BatchSpec)
    contract: C.Contract | None = None
    rules: tuple[R.Rule, ...] = ()
    sets: dict[str, tuple[DataFrame, str]] = field(default_factory=dict)  # reference sets of rules: table, key
    registered: DataFrame | None = None  # contract_id, version, contract_hash
    foreign: dict[str, tuple[DataFrame, str]] = field(default_factory=dict)  # by the contract's foreign_key
    references: tuple[ReferenceCheck, ...] = ()
    baselines: dict[str, DataFrame] = field(default_factory=dict)
    slas: DataFrame | None = None
    arrivals: DataFrame | None = None
    column_mapping: dict[str, str] = field(default_factory=dict)
    personal_data: bool = True
    checks: tuple[U.Check | str, ...] = ()  # checks of the user, or names of registered ones


@dataclass(frozen=True)
class TierRun:
    anomalies: DataFrame
    layers: DataFrame
    blocked: bool
    skipped: tuple[tuple[str, str], ...] = ()  # rules and checks that could not run, with the reason


# Counted with everything else, emitted under their layer.
PERSONAL = ("_personal_name", "_personal_data", "_minors")


def _one(column: str) -> Column:
    return F.array(F.col(column))


def _counted(df: DataFrame, suite: Suite, added: Sequence[U.Check]) -> list[Row]:
    """Everything that is a count over rows, bronze, contract, built-in rules and checks of the user alike,
    from one aggregate; at most one fetched row per check."""
    checks = B.row_checks(df, suite.bronze)
    if suite.bronze.outliers:
        checks += B.outlier_checks(df, suite.bronze.outliers, suite.bronze.z_threshold)
    if suite.contract:
        checks += C.contract_checks(df, suite.contract)
    checks += R.auto_checks(df, suite.column_mapping)
    if suite.personal_data:
        checks += E.personal_checks(df)
    wide, made = U.fused(df, added)
    # A column named like personal data is reported even without values.
    return B.profile(wide, checks + made, suite.bronze.count).filter("failed OR check_name = '_personal_name'").collect()


def _contract_sets(df: DataFrame, suite: Suite) -> list[Row]:
    """Contract findings that need more than a row: hash, repeated values, foreign keys.

    At most one row per constraint is fetched, as they decide whether later layers run.
    """
    contract, spark, found = suite.contract, df.sparkSession, []
    if suite.registered is not None:
        submitted = C.contract_hashes(contract_table(spark, [contract]))
        found += [("SC-008", contract.id, CRITICAL, None) for _ in C.verify_hashes(submitted, suite.registered).collect()]
    present = [c for c in contract.columns if c.name in df.columns]
    unique = [c for c in present if c.unique]
    level = {c.name: CRITICAL if c.required else WARNING for c in present}
    if unique:
        found += [("SC-005", r["column_name"], level[r["column_name"]], r["affected_count"]) for r in C.unique_findings(
            df, [[c.name] for c in unique]).filter("affected_count > 0").collect()]
    for c in present:
        if c.foreign_key in suite.foreign:
            reference, key = suite.foreign[c.foreign_key]
            n = J.broken_references(df, c.name, reference, key, suite.keys, allow_null=c.nullable).count()
            if n:
                found.append(("SC-005", c.name, level[c.name], n))
    return [Row(check_name="contract", failure_code=code, field=name, severity=severity, affected_count=n)
            for code, name, severity, n in found]


def _set_rule(df: DataFrame, rule: R.Rule, suite: Suite) -> DataFrame:
    """Violations of a rule that needs more than a row: (rule_id, failure_code, severity, violations)."""
    name = rule.fields[0]
    if rule.kind in ("referential", "orphan"):
        reference, key = suite.sets[rule.reference]
        broken = J.broken_references(df, name, reference, key, suite.keys, allow_null=rule.kind == "orphan")
    else:
        # Only what a step needs is shuffled.
        steps = df.select(*dict.fromkeys([rule.entity, *rule.order, name]))
        broken = R.state_transitions(steps, rule.entity, list(rule.order), name, dict(rule.transitions))
    return broken.agg(F.count(F.lit(1)).alias("violations")).filter("violations > 0").select(
        F.lit(rule.id).alias("rule_id"), F.lit(rule.failure_code).alias("failure_code"),
        F.lit(rule.severity).alias("severity"), "violations")


def _business(df: DataFrame, suite: Suite, rules: Sequence[R.Rule], emit, as_of: Column) -> list[DataFrame]:
    parts = []
    of_rows = [r for r in rules if r.of_rows]
    if of_rows:
        found = R.check_rules(df, of_rows, suite.keys, as_of)
        parts.append(emit(R.rollup(found), check_name=F.lit("rule"), affected_count=F.col("violations")))
    for rule in rules:
        if not rule.of_rows and rule.kind != "distribution":
            parts.append(emit(_set_rule(df, rule, suite), check_name=F.lit("rule"), affected_count=F.col("violations")))
    for check in suite.references:
        broken = J.broken_references(df, check.field, check.reference, check.key, suite.keys, check.allow_null)
        parts.append(emit(J.reference_summary(broken, f"check-{check.field}"), check_name=F.lit("reference"),
                          affected_fields=_one("field"), affected_count=F.col("violations")))
    for column, baseline in suite.baselines.items():
        if "bin_no" in baseline.columns:
            shift = D.baseline_psi(baseline, D.assign_bins(df, column, baseline), "bin_no")
        else:
            shift = D.baseline_psi(baseline, D.categorical_baseline(df, column).select("key", "n"), "key")
        parts.append(emit(shift.filter("severity IS NOT NULL"), check_name=F.lit("distribution"),
                          failure_code=F.lit("BL-007"), rule_id=F.lit(f"distrib-{column}"),
                          affected_fields=F.array(F.lit(column)), actual=F.col("psi")))
    return parts


def _freshness(suite: Suite, emit, as_of: Column) -> DataFrame:
    last = FR.last_arrivals(suite.arrivals)
    slas = suite.slas.filter("enabled")
    status = FR.freshness_status(slas, last, as_of).filter("failure_code IS NOT NULL").withColumn("severity", F.col("status"))
    late = FR.sla_status_fixed(slas, last, as_of).filter("failure_code IS NOT NULL")
    parts = [status, late, FR.open_misses(slas, last, as_of)]
    found = reduce(DataFrame.unionByName, [p.select("source", "sla_id", "failure_code", "severity") for p in parts])
    return emit(found, check_name=F.lit("freshness"), subject=F.col("source"), rule_id=F.col("sla_id"))


def _ethics(df: DataFrame, rows: Sequence[Row], emit) -> list[DataFrame]:
    """Personal data and minors from the counted ``rows``, and groups out of balance."""
    found = df.sparkSession.createDataFrame([r for r in rows if r["check_name"] in PERSONAL], B.FINDING_DDL).coalesce(1)
    by_age = F.col("check_name") == "_minors"
    counted = found.select(
        F.when(by_age, "minors").otherwise("personal_data").alias("check_name"), "failure_code", "field", "affected_count",
        F.when(by_age, F.col("severity")).otherwise(CRITICAL).alias("severity"),
        F.when(by_age, F.col("severity_score")).otherwise(85.0).alias("severity_score"))
    parts = [emit(counted, affected_fields=_one("field"))]
    if E.named_like(df.columns, E.PROTECTED_NAMES):
        parts.append(emit(E.protected_imbalance(df), check_name=F.lit("imbalance"), affected_fields=_one("attribute"),
                          actual=F.col("ratio"), severity_score=F.lit(60.0)))
    return parts


def run_tiers(df: DataFrame, suite: Suite, batch_id: str, as_of: str) -> TierRun:
    """All layers over one table, as anomalies of one shape and a score per layer.

    Blocking contract findings stop the business and freshness layers: they are then reported as
    not evaluated, without a score, and their jobs are not submitted.  The decision reads one
    row.
    """
    now = F.lit(as_of).cast("timestamp_ntz")

    def emit(findings: DataFrame, **columns) -> DataFrame:
        return as_anomalies(findings, batch_id, as_of, **columns)

    added, unfit = U.resolve_checks(df, suite.checks)
    rows = _counted(df, suite, added)
    sets = _contract_sets(df, suite) if suite.contract else []
    rules, skipped = R.resolve_rules(df, suite.rules, now, list(suite.sets), list(suite.baselines))
    blocked = any(r["severity"] == CRITICAL for r in sets) or any(r["check_name"] == "contract" and r["severity"] == CRITICAL for r in rows)

    if blocked:
        later = {c.name for c in added if c.code[:2] in ("BL", "FR")}
        added = [c for c in added if c.name not in later]
        rows = [r for r in rows if r["check_name"] != "auto_logic" and r["check_name"] not in later]
    counted = emit(df.sparkSession.createDataFrame([r for r in rows if r["check_name"] not in PERSONAL], B.FINDING_DDL).coalesce(1), affected_fields=_one("field"),
                   blocking=(F.col("check_name") == "contract") & (F.col("severity") == CRITICAL))
    evaluated, parts = {1}, [counted]
    if sets:
        parts.append(emit(df.sparkSession.createDataFrame(
            sets, "check_name string, failure_code string, field string, severity string, affected_count bigint").coalesce(1),
            affected_fields=_one("field"), blocking=F.col("severity") == CRITICAL))
    if suite.contract:
        evaluated.add(2)
    if suite.bronze.duplicates:
        repeated = B.duplicate_finding(df, suite.bronze.duplicates).filter("failed")
        parts.append(emit(repeated, affected_fields=_one("field")))
    if not blocked:
        evaluated.add(3)
        parts += _business(df, suite, rules, emit, now)
        if suite.slas is not None and suite.arrivals is not None:
            evaluated.add(4)
            parts.append(_freshness(suite, emit, now))
    if any(c.plan for c in added):
        parts.append(emit(U.plan_findings(df, added).filter("failed"), affected_fields=_one("field")))
    evaluated |= {LAYERS_BY_CODE[c.code[:2]][1] for c in added}
    if suite.personal_data:
        evaluated.add(6)
        parts += _ethics(df, rows, emit)
    anomalies = reduce(DataFrame.unionByName, parts)
    # Written, so that findings and scores come from one evaluation.
    anomalies = cut_lineage(anomalies)
    return TierRun(anomalies, layer_table(anomalies, evaluated), blocked, (*skipped, *unfit))


# Layer -> (name, penalties).
LAYERS = {1: ("bronze", "schema"), 2: ("schema", "schema"), 3: ("business", "business"),
          4: ("freshness", "watcher"), 5: ("model", "model"), 6: ("ethics", "upload_ethics")}


def layer_table(anomalies: DataFrame, evaluated: set[int]) -> DataFrame:
    """Score and count per layer; a layer that was not evaluated has none."""
    in_layer = lambda n: F.when(F.col("layer") == n, F.col("severity"))
    wide = anomalies.agg(
        *[S.layer_score(in_layer(n), p).alias(f"s{n}") for n, (_, p) in LAYERS.items()],
        *[F.count_if(F.col("layer") == n).alias(f"c{n}") for n in LAYERS])
    return wide.select(F.inline(F.array(*[
        F.struct(F.lit(n).alias("layer"), F.lit(name).alias("name"), F.lit(n in evaluated).alias("evaluated"),
                 (F.col(f"s{n}") if n in evaluated else F.lit(None).cast("double")).alias("score"),
                 F.col(f"c{n}").alias("anomalies"))
        for n, (name, _) in LAYERS.items()])))


def run_models(log: DataFrame, as_of: str, features: Sequence[str], trained: DataFrame | None = None,
               expected: DataFrame | None = None, actual: DataFrame | None = None,
               ethics: Sequence[DataFrame] = ()) -> DataFrame:
    """All checks of all models of a prediction log, one row per finding.

    ``log``: model_id, period, prediction, confidence, latency_ms, is_error and the features.
    ``trained``: model_id and trained_at.  ``expected`` and ``actual``: features of the models as
    (model_id, feature, type).  ``ethics``: findings of the ethics layer as (model_id, failure_code,
    severity); they count whether or not model health blocks.

    The log is read twice: for the means and for the counts per value, which all distances share.
    """
    marked = log.withColumn("_current", F.col("period") == "current")
    means = cut_lineage(M.period_means(log, "model_id", "period", ["confidence", "latency_ms", "is_error"]))
    counts = cut_lineage(D.feature_counts(marked, ["model_id"], sorted({"prediction", *features}), "_current"))
    psis = cut_lineage(D.drift_psi(counts, ["model_id", "feature"], "value", None))
    drift = D.prediction_drift(counts.filter("feature = 'prediction'").drop("feature"), ["model_id"], "value", None,
                               psi=psis.filter("feature = 'prediction'").drop("feature"))
    feature = D.feature_drift(psis.filter(F.col("feature").isin(*features)), ["model_id"], len(features))
    checks = [
        drift.select("model_id", F.lit("ML-001").alias("failure_code"), "severity"),
        feature.select("model_id", F.lit("ML-002").alias("failure_code"), "severity"),
        M.confidence_drop(means, "model_id", "confidence"), M.latency_spike(means, "model_id", "latency_ms"),
        M.error_rate(means, "model_id", "is_error"),
    ]
    if trained is not None:
        checks.append(M.staleness(trained, "model_id", "trained_at", F.lit(as_of).cast("timestamp_ntz")))
    if expected is not None and actual is not None:
        checks.append(M.compatibility(expected, actual, "model_id"))
    named = lambda df: df.select("model_id", "failure_code", "severity")
    # Used twice below; a few rows per model.
    found = cut_lineage(reduce(DataFrame.unionByName, map(named, checks)))
    raised = lambda *codes: F.bool_or(F.col("failure_code").isin(*codes) & F.col("severity").isNotNull())
    signals = found.groupBy("model_id").agg(
        raised("ML-001", "ML-002").alias("drift_detected"), raised("ML-003").alias("model_stale"),
        F.bool_or((F.col("failure_code") == "ML-006") & (F.col("severity") == CRITICAL)).alias("high_error_rate")).join(
        means.select("model_id", (1.0 - F.col("is_error_cur")).alias("performance")), "model_id")
    retrain = M.retraining(signals, "model_id", "performance", ["drift_detected", "model_stale", "high_error_rate"])
    every = reduce(DataFrame.unionByName, [found, named(retrain), *map(named, ethics)])
    return every.filter("severity IS NOT NULL")


def model_layers(found: DataFrame, models: DataFrame) -> DataFrame:
    """Health, ethics and overall (least) score of every model of ``models``, with or without findings."""
    every = found.select("model_id", "failure_code", "severity").unionByName(
        models.select("model_id").distinct(), allowMissingColumns=True)
    of = lambda start: F.when(F.col("failure_code").startswith(start), F.col("severity"))
    scored = every.groupBy("model_id").agg(
        S.layer_score(of("ML-"), "model").alias("health_score"), S.layer_score(of("ET-"), "ethics").alias("ethics_score"),
        F.count("failure_code").alias("findings"),
        F.coalesce(F.bool_or(of("ML-") == CRITICAL), F.lit(False)).alias("blocked_by_health"))
    return scored.withColumn("overall_score", F.least("health_score", "ethics_score"))
