"""Fairness, personal data and governance (layer 6)."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableward.model import CRITICAL, WARNING
from tableward.operators.bronze import RowCheck

# Patterns of personal data in values, in the order they are tried.
PII_PATTERNS = {
    "email": r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}",
    "phone": r"(\+\d{1,3}[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}",
    "ssn": r"\b\d{3}[-\s]?\d{2}[-\s]?\d{4}\b",
    "credit_card": r"\b(?:\d{4}[-\s]?){3}\d{4}\b",
    "ip_address": r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b",
}
# Longer numbers are masked before patterns that would match a part of them.
MASK_ORDER = ("email", "credit_card", "ip_address", "ssn", "phone")

# Column names of personal data, in the audit and in the automatic check.
AUDIT_NAMES = (
    "ssn", "social_security", "national_id", "email", "phone", "telephone", "mobile", "address",
    "street", "zip", "postal", "birth", "dob", "date_of_birth", "name", "first_name", "last_name",
    "full_name", "driver_license", "passport", "credit_card", "account_number", "bank",
    "ip_address", "mac_address", "biometric", "fingerprint", "face_id", "medical", "health",
    "diagnosis", "salary", "income", "wage", "race", "ethnicity", "religion", "gender",
    "sexual_orientation",
)
SENSITIVE_NAMES = (
    "email", "phone", "telephone", "mobile", "ssn", "social_security", "address", "street", "zip",
    "postal", "credit_card", "card_number", "passport", "driver_license", "ip", "ip_address",
)
PROTECTED_NAMES = (
    "gender", "sex", "race", "ethnicity", "religion", "nationality", "age", "disability",
    "marital_status", "sexual_orientation",
)
# Model types that explain themselves, and how much stricter a risk level is.
INTERPRETABLE = ("logistic_regression", "decision_tree", "linear_regression")
RISK_FACTOR = {"low": 1.0, "medium": 1.5, "high": 2.0, "unacceptable": 3.0}


# Fairness -------------------------------------------------------------------------------------

def parity(df: DataFrame, groups: Sequence[str], prediction: str) -> DataFrame:
    """Positive rate per group."""
    return df.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n"), F.avg((F.col(prediction) == 1).cast("double")).alias("positive_rate"))


def odds(df: DataFrame, groups: Sequence[str], prediction: str, actual: str) -> DataFrame:
    """True and false positive rate and precision per group; an empty denominator gives 0."""
    p, a = F.col(prediction) == 1, F.col(actual) == 1
    cells = df.groupBy(*groups).agg(
        F.count_if(p & a).alias("tp"), F.count_if(~p & a).alias("fn"),
        F.count_if(p & ~a).alias("fp"), F.count_if(~p & ~a).alias("tn"))
    rate = lambda x, y: F.coalesce(F.try_divide(F.col(x), F.col(x) + F.col(y)), F.lit(0.0))
    return cells.select(*groups, rate("tp", "fn").alias("tpr"), rate("fp", "tn").alias("fpr"),
                        rate("tp", "fp").alias("precision"))


def _ratio(low: Column, high: Column) -> Column:
    return F.when(high == 0, 1.0).otherwise(low / high)


def disparate_pairs(rates: DataFrame, attribute: Sequence[str], group: str, value: str,
                    threshold: float = 0.8) -> DataFrame:
    """Pairs of groups whose smaller value is under ``threshold`` of the larger.

    ``rates`` has one row per group, however many rows the data has.  Only violating pairs are
    produced, each once, with the names in order.
    """
    low = rates.select(*[F.col(a).alias(f"_{a}") for a in attribute],
                       F.col(group).alias("_low"), F.col(value).alias("_v"))
    pairs = rates.join(low, [F.col(a) == F.col(f"_{a}") for a in attribute]
                       + [F.col("_v") < F.col(value) * threshold])
    swap = F.col("_low") > F.col(group)
    pick = lambda x, y: F.when(swap, x).otherwise(y)
    return pairs.select(
        *attribute, pick(F.col(group), F.col("_low")).alias("group_a"), pick(F.col("_low"), F.col(group)).alias("group_b"),
        pick(F.col(value), F.col("_v")).alias("value_a"), pick(F.col("_v"), F.col(value)).alias("value_b"),
        _ratio(F.col("_v"), F.col(value)).alias("disparity_ratio"))


def against_best(rates: DataFrame, attribute: Sequence[str], group: str, value: str,
                 threshold: float = 0.8) -> DataFrame:
    """Groups under ``threshold`` of their attribute's best group: at most one row per group, where
    all violating pairs (``disparate_pairs``) may be quadratic in the groups."""
    best = rates.groupBy(*[F.col(a).alias(f"_{a}") for a in attribute]).agg(
        F.max(F.struct(value, group)).alias("_b"))
    joined = rates.join(best, [F.col(a) == F.col(f"_{a}") for a in attribute])
    ratio = _ratio(F.col(value), F.col(f"_b.{value}"))
    return joined.select(*attribute, F.col(group).alias("grp"), F.col(f"_b.{group}").alias("best"), F.col(value).alias("value"),
                         F.col(f"_b.{value}").alias("best_value"), ratio.alias("disparity_ratio")).filter(
        F.col("disparity_ratio") < threshold)


def fairness(rates: DataFrame, attribute: Sequence[str], value: str, threshold: float = 0.8) -> DataFrame:
    """Verdict per attribute (ET-002): the worst pair is the smallest against the largest value."""
    spread = rates.groupBy(*attribute).agg(
        F.count(F.lit(1)).alias("groups"), _ratio(F.min(value), F.max(value)).alias("min_ratio"))
    ratio = F.col("min_ratio")
    bad = (ratio < threshold) & (F.col("groups") >= 2)
    return spread.select(
        *attribute, "groups", "min_ratio", F.when(bad, "ET-002").alias("failure_code"),
        F.when(bad & (ratio < 0.5), CRITICAL).when(bad, WARNING).alias("severity"),
        F.when(bad & (ratio < 0.5), 30.0).when(bad, 60.0).otherwise(100.0).alias("score"))


def bias(df: DataFrame, attributes: Sequence[str], prediction: str, threshold: float = 0.8) -> DataFrame:
    """All protected attributes in one pass (ET-001), and their joint impact when critical (ET-003)."""
    long = df.select(prediction, *[F.col(a).cast("string").alias(a) for a in attributes]).unpivot(
        [prediction], list(attributes), "attribute", "grp").filter("grp IS NOT NULL")
    verdicts = fairness(parity(long, ["attribute", "grp"], prediction), ["attribute"], "positive_rate", threshold)
    total = verdicts.filter("failure_code IS NOT NULL").agg(
        F.count(F.lit(1)).alias("n"), F.min("min_ratio").alias("min_ratio"),
        F.array_join(F.array_sort(F.collect_list("attribute")), ",").alias("attributes"))
    critical = F.col("min_ratio") < 0.5
    severity = F.when(critical, CRITICAL).otherwise(WARNING)
    codes = F.when(critical, F.array(F.lit("ET-001"), F.lit("ET-003"))).otherwise(F.array(F.lit("ET-001")))
    return total.filter("n > 0").select(
        F.explode(codes).alias("failure_code"), severity.alias("severity"), "attributes", "min_ratio",
        (F.col("min_ratio") * 100).alias("bias_score"))


def calibration(df: DataFrame, groups: Sequence[str], score: str, actual: str, bins: int = 10) -> DataFrame:
    """Mean score against observed rate per group and score bin."""
    number = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).cast("int")
    return df.groupBy(*groups, number.alias("score_bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean_score"),
        F.avg((F.col(actual) == 1).cast("double")).alias("observed_rate"))


# Personal data --------------------------------------------------------------------------------

def _may_hold_address(column: Column) -> Column:
    return F.contains(column, F.lit("@"))


def _may_hold_number(column: Column) -> Column:
    """Necessary for every numeric pattern, and much cheaper than any of them."""
    return column.rlike(r"[0-9][0-9.]")


# Necessary for the numeric patterns, but for addresses: three digits and two more behind at most a bracket and a
# separator; and for addresses: a number between two dots.
_LONG_NUMBER, _DOTTED_NUMBER = r"[0-9]{3}\)?[-.\s]?[0-9]{2}", r"[0-9]\.[0-9]{1,3}\.[0-9]"
# A text that holds a match also holds one of these shorter forms, which need no optional or repeated start.
_PRESENT = {**PII_PATTERNS, "email": r"[a-zA-Z0-9._%+-]@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}",
            "phone": r"\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}"}


def first_pattern(column: Column) -> Column:
    """Name of the first pattern found in the text; later ones are not evaluated."""
    numbers = F.lit(None).cast("string")
    for name in reversed([n for n in PII_PATTERNS if n != "email"]):
        numbers = F.when(column.rlike(_PRESENT[name]), name).otherwise(numbers)
    email = _may_hold_address(column) & column.rlike(_PRESENT["email"])
    worth = _may_hold_number(column) & (column.rlike(_LONG_NUMBER) | column.rlike(_DOTTED_NUMBER))
    return F.when(email, "email").otherwise(F.when(worth, numbers))


def name_tokens(name: str) -> str:
    """The words of a column name joined by underscores: split at case changes and separators."""
    spaced = re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", name)
    return "_" + re.sub(r"[^a-z0-9]+", "_", spaced.lower()).strip("_") + "_"


def named_like(columns: Sequence[str], terms: Sequence[str], loose: bool = False) -> dict[str, str]:
    """Columns whose name holds one of the terms, as whole words unless ``loose``."""
    found = {}
    for column in columns:
        text = column.lower() if loose else name_tokens(column)
        hit = next((t for t in terms if (t if loose else f"_{t}_") in text), None)
        if hit:
            found[column] = hit
    return found


def readable(df: DataFrame) -> list[str]:
    """Columns whose values may be personal data: text, whole numbers and decimals (card and
    telephone numbers)."""
    return [c for c, kind in df.dtypes if kind in ("string", "int", "bigint") or kind.startswith(("decimal", "char", "varchar"))]


def pii_scan(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows per column and pattern over the whole table; only hits are shuffled.

    Any scalar column may be named; its text form is searched.
    """
    columns = columns or readable(df)
    if not columns:
        return df.sparkSession.createDataFrame([], "field string, pattern string, rows bigint")
    hits = F.array(*[F.struct(F.lit(c).alias("field"), first_pattern(F.col(c).cast("string")).alias("pattern"))
                     for c in columns])
    return df.select(F.inline(hits)).filter("pattern IS NOT NULL").groupBy("field", "pattern").agg(
        F.count(F.lit(1)).alias("rows"))


def pii_volume(df: DataFrame, column: str) -> DataFrame:
    """Occurrences per pattern, several in one text counted each."""
    worth = lambda n: _may_hold_address(F.col(column)) if n == "email" else _may_hold_number(F.col(column))
    wide = df.agg(*[F.sum(F.when(worth(n), F.regexp_count(column, F.lit(p)))).alias(n) for n, p in PII_PATTERNS.items()])
    return wide.select(F.inline(F.array(*[
        F.struct(F.lit(n).alias("pattern"), F.coalesce(F.col(n), F.lit(0)).cast("bigint").alias("occurrences"))
        for n in PII_PATTERNS])))


def masked(column: Column) -> Column:
    """The text with every find replaced by the name of its pattern."""
    def replaced(text: Column, names) -> Column:
        for name in names:
            text = F.regexp_replace(text, PII_PATTERNS[name], f"[{name.upper()}]")
        return text

    safe = F.when(_may_hold_address(column), replaced(column, MASK_ORDER[:1])).otherwise(column)
    return F.when(_may_hold_number(column), replaced(safe, MASK_ORDER[1:])).otherwise(safe)


def pseudonym(column: Column, salt: str = "") -> Column:
    return F.sha2(F.concat(F.lit(salt), column.cast("string")), 256)


def personal_checks(df: DataFrame) -> list[RowCheck]:
    """Personal data and minors as row checks, so that they are counted in one aggregate with others: values of
    columns named like personal data, finds in the other columns, and people under 18 per age column."""
    named = named_like(df.columns, SENSITIVE_NAMES)
    level = lambda score, n: F.lit(CRITICAL)
    fixed = lambda pct, extra, n: F.lit(85.0)
    found = [RowCheck("_personal_name", "ET-006", c, F.col(f"`{c}`").isNotNull(), fixed, level=level) for c in named]
    found += [RowCheck("_personal_data", "ET-006", c, first_pattern(F.col(f"`{c}`").cast("string")).isNotNull(), fixed, level=level)
              for c in readable(df) if c not in named]
    few = lambda n, one, other: F.when(n < 100, one).otherwise(other)
    return found + [
        RowCheck("_minors", "ET-005", c, F.coalesce(_minor(c), F.lit(False)), lambda pct, extra, n: few(n, 70.0, 85.0),
                 level=lambda score, n: few(n, WARNING, CRITICAL)) for c in age_columns(df)]


def sensitive_columns(df: DataFrame, loose: bool = False) -> DataFrame:
    """Columns named like personal data, with how many values they hold."""
    named = named_like(df.columns, SENSITIVE_NAMES, loose)
    if not named:
        return df.sparkSession.createDataFrame([], "field string, matched string, filled bigint")
    wide = df.agg(*[F.count(c).alias(f"n{i}") for i, c in enumerate(named)])
    return wide.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("field"), F.lit(m).alias("matched"), F.col(f"n{i}").alias("filled"))
        for i, (c, m) in enumerate(named.items())])))


def pii_exposure(fields: DataFrame, loose: bool = False) -> DataFrame:
    """Exposure of datasets (ET-006).

    ``fields`` holds one row per (dataset, field) with the dataset's safeguards
    ``encrypted``, ``masked`` and ``access_controlled``.  Names match whole words unless ``loose``.
    """
    if loose:
        text, mark = F.lower("field"), ""
    else:
        spaced = F.lower(F.regexp_replace("field", r"([a-z0-9])(?=[A-Z])", "$1_"))
        words = F.regexp_replace(F.regexp_replace(spaced, r"[^a-z0-9]+", "_"), r"^_+|_+$", "")
        text, mark = F.concat(F.lit("_"), words, F.lit("_")), "_"
    # One pass over the name, compiled; a search term by term is interpreted for every row.
    personal = text.rlike(f"{mark}(?:{'|'.join(map(re.escape, AUDIT_NAMES))}){mark}")
    sets = fields.groupBy("dataset_id").agg(
        F.count_if(personal).alias("pii_fields"), F.bool_and("encrypted").alias("encrypted"),
        F.bool_and("masked").alias("masked"), F.bool_and("access_controlled").alias("access_controlled"))
    n, open_pii = F.col("pii_fields"), (F.col("pii_fields") > 0) & ~F.col("masked")
    score = F.greatest(F.lit(0.0), 100.0 - F.least(F.lit(30.0), n * 5.0)
                       - F.when(F.col("encrypted"), 0.0).otherwise(25.0) - F.when(open_pii, 20.0).otherwise(0.0)
                       - F.when(F.col("access_controlled"), 0.0).otherwise(25.0))
    scored = sets.withColumn("score", score)
    failed = (F.col("score") < 70) | open_pii
    critical = (F.col("score") < 40) | ((n > 0) & ~F.col("encrypted"))
    return scored.select("dataset_id", "pii_fields", "score", F.when(failed, "ET-006").alias("failure_code"),
                         F.when(failed & critical, CRITICAL).when(failed, WARNING).alias("severity"))


def protected_imbalance(df: DataFrame, loose: bool = False, limit: float = 0.05) -> DataFrame:
    """Protected columns with a group under 5 or over 95 percent; the smallest such group."""
    named = list(named_like(df.columns, PROTECTED_NAMES, loose))
    if not named:
        return df.sparkSession.createDataFrame(
            [], "attribute string, grp string, ratio double, failure_code string, severity string")
    long = df.select(*[F.col(c).cast("string").alias(c) for c in named]).unpivot(
        [], named, "attribute", "grp").filter("grp IS NOT NULL")
    counts = long.groupBy("attribute", "grp").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy("attribute").agg(F.sum("n").alias("total"))
    ratio = F.col("n") / F.col("total")
    extreme = counts.join(totals, "attribute").withColumn("ratio", ratio).filter(
        (F.col("ratio") < limit) | (F.col("ratio") > 1 - limit))
    return extreme.groupBy("attribute").agg(F.min(F.struct("ratio", "grp")).alias("s")).select(
        "attribute", F.col("s.grp").alias("grp"), F.col("s.ratio").alias("ratio"),
        F.lit("ET-001").alias("failure_code"), F.lit(WARNING).alias("severity"))


def age_columns(df: DataFrame, loose: bool = False) -> list[str]:
    return list(named_like(df.columns, ("age",), loose))


def _minor(age: str) -> Column:
    value = F.col(f"`{age}`").try_cast("double")
    return (value > 0) & (value < 18)


def minors(df: DataFrame, age: str) -> DataFrame:
    """Rows of people under 18 (ET-005)."""
    n = F.col("minors")
    return df.agg(F.count_if(_minor(age)).alias("minors")).filter("minors > 0").select(
        "minors", F.lit("ET-005").alias("failure_code"),
        F.when(n < 100, WARNING).otherwise(CRITICAL).alias("severity"),
        F.when(n < 100, 70.0).otherwise(85.0).alias("severity_score"))


# Governance -----------------------------------------------------------------------------------

def consent(usage: DataFrame, consents: DataFrame, as_of: Column) -> DataFrame:
    """Data use against consent (ET-005), per dataset.

    ``usage``: dataset_id, source, intended_use.  ``consents``: source, purposes, given_at,
    explicit.  Every source without matching consent is a violation; consent older than a year
    and consent that is only implied add one each.
    """
    joined = usage.join(consents.withColumn("_known", F.lit(True)), "source", "left")
    covered = F.array_contains("purposes", F.col("intended_use")) | F.array_contains("purposes", F.lit("all"))
    per_set = joined.groupBy("dataset_id").agg(
        F.count_if(F.col("_known") & ~covered).alias("not_covered"),
        F.count_if(F.col("_known").isNull()).alias("no_record"),
        F.coalesce(F.bool_or(F.extract(F.lit("DAY"), as_of - F.col("given_at")) > 365), F.lit(False)).alias("outdated"),
        F.coalesce(F.bool_or(~F.col("explicit")), F.lit(False)).alias("implied"))
    n = (F.col("not_covered") + F.col("no_record") + F.col("outdated").cast("bigint")
         + F.col("implied").cast("bigint"))
    critical = (F.col("violations") >= 3) | F.col("implied")
    return per_set.withColumn("violations", n).filter("violations > 0").select(
        "dataset_id", "violations", "not_covered", "no_record", "outdated", "implied",
        F.lit("ET-005").alias("failure_code"), F.when(critical, CRITICAL).otherwise(WARNING).alias("severity"),
        F.when(critical, 20.0).otherwise(60.0).alias("score"))


def explainability(registry: DataFrame, minimum: float = 50.0) -> DataFrame:
    """Points for explanation artefacts (ET-004); self-explaining model types get more."""
    # Points per artefact.
    points = {"feature_importance": 25, "shap_values": 30, "local_explanations": 25, "model_card": 20}
    score = F.lit(0)
    for name, worth in points.items():
        score = score + F.when(F.col(f"has_{name}"), worth).otherwise(0)
    plain = F.lower("model_type").isin(*INTERPRETABLE)
    score = F.when(plain, F.least(F.lit(100), score + 20)).otherwise(score).cast("double")
    missing = F.array_compact(F.array(*[F.when(~F.col(f"has_{n}"), F.lit(n)) for n in points]))
    return registry.withColumn("score", score).filter(F.col("score") < minimum).select(
        "model_id", "score", F.array_join(missing, ",").alias("missing"), F.lit("ET-004").alias("failure_code"),
        F.when(F.col("score") < 25, CRITICAL).otherwise(WARNING).alias("severity"))


# Kinds of logs an audit trail needs.
LOG_KINDS = ("prediction_logs", "input_logs", "decision_logs", "access_logs")


def audit_trail(events: DataFrame, minimum_days: int = 365, registry: DataFrame | None = None) -> DataFrame:
    """Completeness and span of the logs of each model (ET-007), measured from audit events
    (model_id, kind, ts).  Models of ``registry`` without any event are the worst case."""
    if registry is not None:
        events = events.unionByName(registry.select("model_id").distinct(), allowMissingColumns=True)
    seen = events.groupBy("model_id").agg(
        *[F.coalesce(F.bool_or(F.col("kind") == k), F.lit(False)).alias(k) for k in LOG_KINDS],
        F.coalesce(F.extract(F.lit("DAY"), F.max("ts") - F.min("ts")), F.lit(0)).cast("int").alias("retention_days"))
    present = F.lit(0)
    for k in LOG_KINDS:
        present = present + F.col(k).cast("int")
    scored = seen.withColumn("completeness", present / len(LOG_KINDS) * 100)
    kept = F.col("retention_days") >= minimum_days
    full = F.col("completeness")
    failed = ~((full >= 75) & kept)
    return scored.select(
        "model_id", "completeness", "retention_days",
        (full * 0.7 + F.when(kept, 30.0).otherwise(0.0)).alias("score"),
        F.when(failed, "ET-007").alias("failure_code"),
        F.when(failed & ((full < 50) | ~F.col("prediction_logs")), CRITICAL).when(failed, WARNING).alias("severity"))


def compliance(checks: DataFrame) -> DataFrame:
    """Pass rate per model against a bar that rises with its risk level (ET-008).

    ``checks``: model_id, risk_level, passed.
    """
    factor = F.lit(1.0)
    for name, value in RISK_FACTOR.items():
        factor = F.when(F.col("risk") == name, value).otherwise(factor)
    rates = checks.groupBy("model_id").agg(
        F.lower(F.max("risk_level")).alias("risk"), F.avg(F.col("passed").cast("double")).alias("rate"))
    banned = F.col("risk") == "unacceptable"
    failed = (F.col("rate") < 1.0 - F.lit(0.1) / factor) | banned
    return rates.filter(failed).select(
        "model_id", F.col("risk").alias("risk_level"), "rate", F.lit("ET-008").alias("failure_code"),
        F.when(banned | (F.col("rate") < 0.5), CRITICAL).otherwise(WARNING).alias("severity"))
