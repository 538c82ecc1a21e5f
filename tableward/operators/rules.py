"""Business rules (layer 3).

Rules are Spark SQL text over the columns of one row.  All rules of a set are evaluated in one
scan: an array of violation structs per row, nulls removed, then exploded.

A row that a rule cannot evaluate (zero divisor, text that is no number, missing element) has a null
there and ends no job: a boolean rule or sequence is violated, a calculation passes, a condition does
not hold.  A sum or product of whole numbers that may pass 64 bits is to be written on decimals.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableward.functions.ordered import null_safe, top_per_group, with_neighbour
from tableward.functions.predicates import first_identifier, row_key
from tableward.model import CRITICAL, INFO, WARNING, severity_name, severity_rank
from tableward.operators.bronze import RowCheck, profile
from tableward.session import undefined_as_null

# Rule type -> failure code used when a rule names none.
RULE_CODES = {
    "crossfield": "BL-001", "referential": "BL-002", "calculation": "BL-003",
    "state_transition": "BL-004", "temporal": "BL-005", "domain": "BL-006",
    "distribution": "BL-007", "orphan": "BL-008",
}


@dataclass(frozen=True)
class Rule:
    """One rule; which fields matter depends on ``kind``.

    crossfield, domain: ``expression`` must hold.  calculation: the first of ``fields`` must equal
    ``expression`` within ``tolerance``, or without fields both sides of an equation ``a == b``.
    temporal: ``check`` is ``no_future`` (or ``not_future``) or ``sequence`` over ``fields``.
    state_transition: the field holds one of ``allowed``, or per ``entity`` in ``order`` its steps
    are those of ``transitions``.  referential, orphan: the field is in the set ``reference``.
    distribution: the field follows its stored baseline.
    """

    id: str
    kind: str
    expression: str = ""
    name: str = ""
    fields: tuple[str, ...] = ()
    severity: str = WARNING
    code: str = ""
    condition: str | None = None
    tolerance: float = 0.001
    check: str = ""
    enabled: bool = True
    priority: int = 0
    reference: str = ""
    allowed: tuple[str, ...] = ()
    transitions: tuple[tuple[str, tuple[str, ...]], ...] = ()
    entity: str = ""
    order: tuple[str, ...] = ()

    @property
    def of_rows(self) -> bool:
        """Whether a row alone decides."""
        return self.kind in ("crossfield", "domain", "calculation", "temporal") or (
            self.kind == "state_transition" and not self.transitions)

    @property
    def failure_code(self) -> str:
        return self.code or RULE_CODES[self.kind]


def comparison(column: Column, operator: str, operand) -> Column:
    """A declarative comparison as a column expression."""
    simple = {
        "==": lambda: column == operand, "!=": lambda: column != operand,
        ">": lambda: column > operand, ">=": lambda: column >= operand,
        "<": lambda: column < operand, "<=": lambda: column <= operand,
        "in": lambda: column.isin(*operand), "not_in": lambda: ~column.isin(*operand),
        "between": lambda: column.between(*operand), "matches": lambda: column.rlike(operand),
    }
    return simple[operator]()


def breaks_calculation(actual: Column, expected: Column, tolerance: float = 0.001) -> Column:
    """Beyond tolerance; null on either side passes."""
    return F.coalesce(F.abs(actual - expected) > tolerance, F.lit(False))


def breaks_sequence(*columns: Column) -> Column:
    """Some value is smaller than the non-null value before it; gaps are skipped."""
    kept = F.array_compact(F.array(*columns))
    return (F.size(kept) >= 2) & (kept != F.array_sort(kept))


def violated(rule: Rule, as_of: Column | None = None) -> Column:
    """True on rows that break the rule; a rule whose condition does not hold passes."""
    if rule.kind in ("crossfield", "domain"):
        broken = ~F.coalesce(F.expr(rule.expression), F.lit(False))
    elif rule.kind == "calculation":
        sides = [f"`{rule.fields[0]}`", rule.expression] if rule.fields else rule.expression.split("==")
        if len(sides) != 2:
            raise ValueError(f"rule {rule.id}: a calculation names a field or is an equation")
        left, right = (F.expr(nested_sums(s)) for s in sides)
        broken = breaks_calculation(left, right, rule.tolerance)
    elif rule.kind == "state_transition" and not rule.transitions:
        if not (rule.fields and rule.allowed):
            raise ValueError(f"rule {rule.id}: no field, or neither transitions nor allowed values")
        broken = F.coalesce(~F.col(rule.fields[0]).isin(*rule.allowed), F.lit(False))
    elif rule.kind == "temporal" and rule.check in ("no_future", "not_future"):
        broken = F.lit(False)
        for name in rule.fields:
            broken = broken | F.coalesce(F.col(name) > as_of, F.lit(False))
    elif rule.kind == "temporal" and rule.check == "sequence":
        broken = breaks_sequence(*[F.col(c) for c in rule.fields])
    else:
        raise ValueError(f"rule {rule.id} of kind {rule.kind} is not a row rule")
    if rule.condition:
        broken = broken & F.coalesce(F.expr(rule.condition), F.lit(False))
    return broken


def nested_sums(expression: str) -> str:
    """``sum(items.amount)`` over the elements of an array column of the row."""
    return re.sub(r"\bsum\(\s*(\w+(?:\.\w+)+)\s*\)", r"aggregate(\1, 0D, (a, x) -> a + coalesce(x, 0))", expression)


def resolve_rules(df: DataFrame, rules: Sequence[Rule], as_of: Column | None = None,
                  sets: Sequence[str] = (), baselines: Sequence[str] = ()) -> tuple[list[Rule], list[tuple[str, str]]]:
    """Active rules that the table's columns and the given sets can answer, and the others with the
    reason.  Only plans are analysed; no job runs."""
    fit, skipped = [], []
    for r in active(rules):
        missing = [c for c in (*r.fields, *([r.entity] if r.entity else []), *r.order) if c not in df.columns]
        reason = f"no column {', '.join(missing)}" if missing else ""
        if not reason and r.kind in ("referential", "orphan") and r.reference not in sets:
            reason = f"no reference set {r.reference or '(unnamed)'}"
        elif not reason and r.kind == "distribution" and not set(r.fields) & set(baselines):
            reason = "no baseline"
        elif not reason and r.kind == "state_transition" and r.transitions and not (r.entity and r.order and r.fields):
            reason = "transitions need a field, an entity and an order"
        elif not reason and r.of_rows:
            try:
                with undefined_as_null(df.sparkSession):
                    df.select(violated(r, as_of))
            except (AnalysisException, ParseException, ValueError) as e:
                reason = str(e).splitlines()[0][:200]
        elif not reason and r.kind not in RULE_CODES:
            reason = f"unknown kind {r.kind}"
        if reason:
            skipped.append((r.id, reason))
        else:
            fit.append(r)
    return fit, skipped


def active(rules: Sequence[Rule]) -> list[Rule]:
    """Enabled rules, highest priority first."""
    return sorted([r for r in rules if r.enabled], key=lambda r: -r.priority)


def check_rules(df: DataFrame, rules: Sequence[Rule], keys: Sequence[str] = (),
                as_of: Column | None = None) -> DataFrame:
    """Long violations of all active row rules, from one scan.

    Without ``keys`` a row goes by the first of its usual identifier columns that is not null.
    """
    identity = row_key(*keys) if keys else first_identifier(df.columns)
    hits = [
        F.when(violated(r, as_of), F.struct(
            F.lit(r.id).alias("rule_id"), F.lit(r.failure_code).alias("failure_code"),
            F.lit(r.severity).alias("severity"), F.lit(",".join(r.fields)).alias("fields")))
        for r in active(rules)
    ]
    with undefined_as_null(df.sparkSession):
        return df.select(identity.alias("row_key"), F.inline(F.array_compact(F.array(*hits))))


def rule_report(df: DataFrame, rules: Sequence[Rule], as_of: Column | None = None) -> DataFrame:
    """Evaluated, passed and failed rows per rule, disabled rules as skipped; one aggregate."""
    ordered = sorted(rules, key=lambda r: -r.priority)
    counts = []
    for i, r in enumerate(ordered):
        if r.enabled:
            counts.append(F.count_if(violated(r, as_of)).alias(f"f{i}"))
    with undefined_as_null(df.sparkSession):
        wide = df.agg(F.count(F.lit(1)).alias("total"), *counts)
    rows = []
    for i, r in enumerate(ordered):
        failed = F.col(f"f{i}") if r.enabled else F.lit(0).cast("bigint")
        seen = F.col("total") if r.enabled else F.lit(0).cast("bigint")
        rows.append(F.struct(
            F.lit(r.id).alias("rule_id"), F.lit(r.priority).alias("priority"),
            F.lit(not r.enabled).alias("skipped"), seen.alias("evaluated"),
            (seen - failed).alias("passed"), failed.alias("failed")))
    return wide.select(F.inline(F.array(*rows)))


def rollup(found: DataFrame, by: Sequence[str] = ("rule_id",), samples: int = 5,
           base: float = 30.0) -> DataFrame:
    """Violations to one anomaly per rule or code: count, worst severity, score, sample keys.

    The samples are the smallest keys.  The planner prunes each task to ``samples`` rows a group
    before they are shuffled, so no group's rows are gathered, however many there are.
    """
    names = [c for c in ("failure_code",) if c not in by]
    counted = found.groupBy(*by).agg(
        *[F.max(c).alias(c) for c in names], severity_name(F.max(severity_rank(F.col("severity")))).alias("severity"),
        F.count(F.lit(1)).alias("violations"))
    if samples:
        lowest = top_per_group(found.select(*by, "row_key"), list(by), [F.col("row_key")], samples).groupBy(
            *[F.col(b).alias(f"_b_{b}") for b in by]).agg(F.array_sort(F.collect_list("row_key")).alias("sample_keys"))
        counted = counted.join(lowest, null_safe(counted, lowest, [(b, f"_b_{b}") for b in by])).drop(
            *[f"_b_{b}" for b in by])
    return counted.withColumn("severity_score", F.least(F.lit(100.0), base + F.col("violations") * 10.0))


def child_sums(parents: DataFrame, parent_key: str, total: str, children: DataFrame,
               child_key: str, amount: Column, tolerance: float = 0.001) -> DataFrame:
    """Parents whose total differs from the sum over their children, 0 where there are none.
    Children are summed before the join, so a parent with very many of them costs one row."""
    sums = children.groupBy(F.col(child_key).alias(parent_key)).agg(F.sum(amount).alias("child_sum"))
    joined = parents.join(sums, parent_key, "left").fillna(0.0, ["child_sum"])
    return joined.filter(breaks_calculation(F.col(total), F.col("child_sum"), tolerance))


def state_transitions(df: DataFrame, key: str, order: list[str], state: str,
                      allowed: dict[str, Sequence[str]]) -> DataFrame:
    """Steps between consecutive states of a key that ``allowed`` does not list."""
    return disallowed(with_neighbour(df, [key], order, {"previous_state": state}), state, allowed)


def disallowed(stepped: DataFrame, state: str, allowed: dict[str, Sequence[str]]) -> DataFrame:
    """Rows whose step from ``previous_state`` is not allowed, with the reason."""
    chain = None
    for source, targets in allowed.items():
        permitted = F.col(state).isin(*targets) if targets else F.lit(False)
        hit = F.col("previous_state") == source
        chain = F.when(hit, permitted) if chain is None else chain.when(hit, permitted)
    known = F.col("previous_state").isin(*allowed)
    return (
        stepped.filter(F.col("previous_state").isNotNull())
        .filter(~F.coalesce(chain, F.lit(False)))
        .withColumn("reason", F.when(known, "not_allowed").otherwise("unknown_state"))
    )


@dataclass(frozen=True)
class AutoRule:
    name: str
    title: str
    fields: tuple[str, ...]
    broken: str


# Rules applied whenever the columns they name exist.
AUTO_RULES = (
    AutoRule("age_income_logic", "Young age with high income", ("age", "income"),
             "{age} < 16 AND {income} > 50000"),
    AutoRule("age_range_logic", "Invalid age value", ("age",), "{age} < 0 OR {age} > 120"),
    AutoRule("negative_income", "Negative income value", ("income",), "{income} < 0"),
    AutoRule("zero_days_with_purchases", "Purchases with zero platform time",
             ("days_on_platform", "purchases"), "{days_on_platform} = 0 AND {purchases} > 0"),
    AutoRule("excessive_purchases_rate", "Unrealistic purchase rate",
             ("days_on_platform", "purchases"),
             "{days_on_platform} > 0 AND {purchases} / greatest(1, {days_on_platform}) > 5"),
    AutoRule("quantity_total_mismatch", "Quantity and total price mismatch",
             ("quantity", "unit_price", "total"), "abs({quantity} * {unit_price} - {total}) > 0.01"),
    AutoRule("end_before_start", "End date before start date", ("start_date", "end_date"),
             "CAST({end_date} AS STRING) < CAST({start_date} AS STRING)"),
)


def auto_severity(n: Column) -> Column:
    return F.when(n > 50, CRITICAL).when(n > 10, WARNING).otherwise(INFO)


def auto_checks(df: DataFrame, mapping: dict[str, str] | None = None) -> list[RowCheck]:
    """Built-in rules over the columns present; ``mapping`` renames rule fields to columns."""
    mapping = mapping or {}
    types = dict(df.dtypes)
    where = {f: mapping.get(f, f) for rule in AUTO_RULES for f in rule.fields}
    usable = [r for r in AUTO_RULES if all(where[f] in types for f in r.fields)]

    def reading(field: str) -> str:
        column = f"`{where[field]}`"
        return column if field.endswith("_date") else f"coalesce(try_cast({column} AS DOUBLE), 0.0D)"

    def test(rule: AutoRule) -> Column:
        present = " AND ".join(f"`{where[f]}` IS NOT NULL" for f in rule.fields)
        body = rule.broken.format(**{f: reading(f) for f in rule.fields})
        return F.expr(f"({present}) AND ({body})")

    return [
        RowCheck("auto_logic", "BL-006", r.name, test(r), lambda pct, extra, n: F.least(F.lit(80.0), 30.0 + n * 2.0),
                 level=lambda score, n: auto_severity(n))
        for r in usable
    ]


def auto_logic(df: DataFrame, mapping: dict[str, str] | None = None) -> DataFrame:
    checks = auto_checks(df, mapping)
    if not checks:
        return df.sparkSession.createDataFrame(
            [], "rule_id string, rule_name string, failure_code string, violations bigint, "
                "records bigint, severity string, severity_score double")
    titles = F.create_map(*[F.lit(x) for r in AUTO_RULES for x in (r.name, r.title)])
    return profile(df, checks).filter("failed").select(
        F.concat(F.lit("auto_"), "field").alias("rule_id"), titles[F.col("field")].alias("rule_name"), "failure_code",
        F.col("affected_count").alias("violations"), F.col("total_count").alias("records"), "severity", "severity_score")
