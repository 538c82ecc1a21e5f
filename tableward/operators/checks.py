"""Checks that users add: predicates, measures and plans, run beside the built-in ones.

Predicates and measures of all checks share one aggregate over one scan with whatever else is counted.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableward.functions import severity as S
from tableward.model import LAYERS
from tableward.operators.bronze import FINDING_DDL, RowCheck, profile
from tableward.session import undefined_as_null


@dataclass(frozen=True)
class Check:
    """One check; exactly one of ``rows``, ``measure`` and ``plan`` is given, each a function of the table.

    ``rows`` gives a predicate, true on violating rows; a row that it cannot evaluate does not violate.
    ``measure`` gives a value per row; ``aggregate`` of it must lie within ``limits`` (either end may be None), else
    every row is affected.  The aggregate of no values is null and within all limits.
    ``plan`` gives the violating rows as a DataFrame of its own (joins, groups).
    ``score`` is fixed, or the share of rows in percent; severity follows from it unless ``severity`` is given.
    """

    name: str
    code: str
    field: str = "*"
    needs: tuple[str, ...] = ()
    rows: Callable[[DataFrame], Column] | None = None
    measure: Callable[[DataFrame], Column] | None = None
    aggregate: Callable[[Column], Column] = F.avg
    limits: tuple[float | None, float | None] = (None, None)
    plan: Callable[[DataFrame], DataFrame] | None = None
    tolerance: float = 0.0
    score: float | None = None
    severity: str | None = None

    def problem(self) -> str:
        """Why the definition itself cannot run, or nothing."""
        if sum(x is not None for x in (self.rows, self.measure, self.plan)) != 1:
            return "needs exactly one of rows, measure and plan"
        if self.code[:2] not in LAYERS:
            return f"unknown layer of code {self.code}"
        if self.measure is not None and self.limits == (None, None):
            return "a measure needs a limit"
        return ""

    def outside(self, value: Column) -> Column:
        low, high = self.limits
        tests = [value < low] if low is not None else []
        tests += [value > high] if high is not None else []
        return F.coalesce(reduce(lambda a, b: a | b, tests), F.lit(False))

    def scored(self, pct: Column) -> Column:
        return F.lit(float(self.score)) if self.score is not None else F.least(pct, F.lit(100.0))

    def levelled(self, score: Column) -> Column:
        return F.lit(self.severity) if self.severity else S.level(score)


REGISTRY: dict[str, Check] = {}


def register(check: Check) -> Check:
    """Make a check known by its name, so that suites can name it."""
    if check.problem():
        raise ValueError(f"check {check.name}: {check.problem()}")
    if check.name in REGISTRY:
        raise ValueError(f"check {check.name} is registered twice")
    REGISTRY[check.name] = check
    return check


def resolve_checks(df: DataFrame, checks: Sequence[Check | str]) -> tuple[list[Check], list[tuple[str, str]]]:
    """Checks that the table can answer, and the others with the reason.  Only plans are analysed.

    Names are looked up among the registered ones.  A check is foreign code: whatever it raises here is its
    reason to be skipped, and no other check is touched.
    """
    fit, skipped = [], []
    for given in checks:
        check = REGISTRY.get(given) if isinstance(given, str) else given
        if check is None:
            skipped.append((given, "no check of this name"))
            continue
        missing = [c for c in check.needs if c not in df.columns]
        reason = f"no column {', '.join(missing)}" if missing else check.problem()
        if not reason:
            try:
                with undefined_as_null(df.sparkSession):
                    if check.plan:
                        check.plan(df).schema  # noqa: B018
                    elif check.rows:
                        df.filter(check.rows(df)).schema  # noqa: B018
                    else:
                        df.select(check.measure(df).alias("_v")).agg(check.aggregate(F.col("_v"))).schema  # noqa: B018
            except Exception as error:  # noqa: BLE001
                reason = f"{type(error).__name__}: {(str(error).splitlines() or [''])[0][:200]}"
        if reason:
            skipped.append((check.name, reason))
        else:
            fit.append(check)
    return fit, skipped


def fused(df: DataFrame, checks: Sequence[Check]) -> tuple[DataFrame, list[RowCheck]]:
    """The table with one column per predicate or measure, and the row checks that read them.

    The columns are analysed so that a row without a value has a null and ends no job; the aggregate that
    the row checks join keeps the session's setting.
    """
    own = [c for c in checks if not c.plan]
    prefix = "_check"
    while any(c.startswith(prefix) for c in df.columns):
        prefix = f"_{prefix}"
    with undefined_as_null(df.sparkSession):
        wide = df.select("*", *[(c.rows or c.measure)(df).alias(f"{prefix}{i}") for i, c in enumerate(own)]) if own else df
    made = []
    for i, c in enumerate(own):
        value = F.col(f"{prefix}{i}")
        common = {"name": c.name, "code": c.code, "field": c.field, "tolerance": c.tolerance,
                  "score": lambda pct, extra, n, c=c: c.scored(pct), "level": lambda score, n, c=c: c.levelled(score)}
        if c.rows:
            made.append(RowCheck(violated=F.coalesce(value, F.lit(False)), **common))
        else:
            made.append(RowCheck(violated=F.lit(False), extra=c.aggregate(value), breached=c.outside, **common))
    return wide, made


def plan_findings(df: DataFrame, checks: Sequence[Check]) -> DataFrame:
    """Findings of checks with plans of their own; the share is of the table's rows."""
    planned = [c for c in checks if c.plan]
    if not planned:
        return df.sparkSession.createDataFrame([], FINDING_DDL)
    with undefined_as_null(df.sparkSession):
        tables = [df, *[c.plan(df) for c in planned]]
        counts = [rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(i).alias("i"), "n") for i, rows in enumerate(tables)]
    wide = reduce(DataFrame.unionByName, counts).groupBy().pivot("i", list(range(len(tables)))).agg(F.first("n"))
    rows = []
    for i, c in enumerate(planned, 1):
        n, total = F.col(f"`{i}`"), F.col("`0`")
        pct = F.when(total > 0, n / total * 100.0).otherwise(F.when(n > 0, 100.0).otherwise(0.0))
        failed = (n > 0) & (pct > c.tolerance)
        rows.append(F.struct(
            F.lit(c.name).alias("check_name"), F.lit(c.code).alias("failure_code"), F.lit(c.field).alias("field"),
            n.cast("bigint").alias("affected_count"), total.cast("bigint").alias("total_count"), pct.cast("double").alias("affected_pct"),
            F.when(failed, c.scored(pct)).alias("severity_score"), F.when(failed, c.levelled(c.scored(pct))).alias("severity"),
            failed.alias("failed")))
    return wide.select(F.inline(F.array(*rows)))


def run_checks(df: DataFrame, checks: Sequence[Check | str]) -> tuple[DataFrame, list[tuple[str, str]]]:
    """One finding per check that can run, clean ones included, and the others with the reason."""
    fit, skipped = resolve_checks(df, checks)
    wide, made = fused(df, fit)
    return profile(wide, made).unionByName(plan_findings(df, fit)), skipped
