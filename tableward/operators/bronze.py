"""Row and column quality of one batch (layer 1).

Row-level checks are predicates.  All of them are counted in one aggregate over one scan, so
only partial sums are shuffled.  Duplicates add one group-by, outliers one more scan.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from tableward.functions import predicates as P
from tableward.functions import severity as S
from tableward.model import CRITICAL

FINDING_DDL = (
    "check_name string, failure_code string, field string, affected_count bigint, "
    "total_count bigint, affected_pct double, severity_score double, severity string, failed boolean"
)
# Wider aggregates fall out of code generation.
SLICE = 200


@dataclass(frozen=True)
class CountSpec:
    minimum: int | None = None
    maximum: int | None = None
    exact: int | None = None


@dataclass(frozen=True)
class TypeSpec:
    column: str
    expected: str
    nullable: bool = True


@dataclass(frozen=True)
class RangeSpec:
    column: str
    minimum: object = None
    maximum: object = None
    inclusive_min: bool = True
    inclusive_max: bool = True


@dataclass(frozen=True)
class FormatSpec:
    column: str
    pattern: str


@dataclass(frozen=True)
class DuplicateSpec:
    keys: tuple[str, ...] = ()
    case_sensitive: bool = True
    tolerance: float = 0.5


@dataclass(frozen=True)
class BatchSpec:
    """Everything the bronze layer checks on one batch."""

    count: CountSpec | None = None
    required: tuple[str, ...] = ()
    optional: tuple[str, ...] = ()
    null_tolerance: float = 5.0
    types: tuple[TypeSpec, ...] = ()
    ranges: tuple[RangeSpec, ...] = ()
    dates: tuple[RangeSpec, ...] = ()
    formats: tuple[FormatSpec, ...] = ()
    encodings: tuple[str, ...] = ()
    duplicates: DuplicateSpec | None = None
    outliers: tuple[str, ...] = ()
    z_threshold: float = 3.0


@dataclass(frozen=True)
class RowCheck:
    """A predicate true on violating rows, and how its share of rows is scored."""

    name: str
    code: str
    field: str
    violated: Column
    score: Callable[[Column, Column, Column], Column]  # (percent, extra aggregate, count)
    extra: Column = field(default_factory=lambda: F.max(F.lit(None).cast("double")))
    tolerance: float = 0.0
    level: Callable[[Column, Column], Column] = lambda score, n: S.level(score)
    breached: Callable[[Column], Column] | None = None  # of the extra aggregate: then all rows are affected

    @property
    def id(self) -> str:
        return f"{self.name}:{self.field}"


def _share(n: Column, total: Column) -> Column:
    return F.when(total > 0, n / total * 100.0).otherwise(0.0)


def null_checks(df: DataFrame, required: Sequence[str] = (), optional: Sequence[str] = (),
                tolerance: float = 5.0) -> list[RowCheck]:
    """Required fields tolerate no blank, other fields ``tolerance`` percent.

    With no field named at all, every column is checked as an optional one.
    """
    types = dict(df.dtypes)
    if not required and not optional:
        optional = df.columns
    required_checks = [
        RowCheck("null_required", "DV-002", c, P.blank(F.col(c), types[c]),
                 lambda pct, *_: S.banded(pct, S.NULL_REQUIRED))
        for c in required
    ]
    optional_checks = [
        RowCheck("null_optional", "DV-002", c, P.blank(F.col(c), types[c]),
                 lambda pct, *_: S.banded(pct, S.NULL_OPTIONAL), tolerance=tolerance)
        for c in optional
    ]
    return required_checks + optional_checks


def type_checks(df: DataFrame, specs: Sequence[TypeSpec]) -> list[RowCheck]:
    types = dict(df.dtypes)
    return [
        RowCheck("type", "DV-003", s.column,
                 P.type_mismatch(F.col(s.column), types[s.column], s.expected, s.nullable),
                 lambda pct, *_: S.banded(pct, S.TYPE))
        for s in specs
    ]


def range_checks(specs: Sequence[RangeSpec]) -> list[RowCheck]:
    def build(s: RangeSpec) -> RowCheck:
        bad = P.outside_number(F.col(s.column), s.minimum, s.maximum,
                               inclusive_min=s.inclusive_min, inclusive_max=s.inclusive_max)
        extra = F.max(F.lit(None).cast("double"))
        if s.minimum is not None and s.maximum is not None and s.maximum > s.minimum:
            value = F.col(s.column).try_cast("double")
            deviation = F.greatest(F.lit(s.minimum) - value, value - F.lit(s.maximum), F.lit(0.0))
            extra = F.max(F.when(bad, deviation / float(s.maximum - s.minimum)))
        return RowCheck("range", "DV-004", s.column, bad,
                        lambda pct, deviation, _: S.range_score(pct, deviation), extra)

    return [build(s) for s in specs]


def date_range_checks(specs: Sequence[RangeSpec]) -> list[RowCheck]:
    return [
        RowCheck("date_range", "DV-004", s.column,
                 P.outside(F.col(s.column), s.minimum, s.maximum,
                           inclusive_min=s.inclusive_min, inclusive_max=s.inclusive_max),
                 lambda pct, *_: S.banded(pct, S.RANGE))
        for s in specs
    ]


def format_checks(specs: Sequence[FormatSpec]) -> list[RowCheck]:
    return [
        RowCheck("format", "DV-005", s.column, P.mismatched(F.col(s.column), s.pattern),
                 lambda pct, *_: S.banded(pct, S.FORMAT))
        for s in specs
    ]


def encoding_check(df: DataFrame, columns: Sequence[str]) -> list[RowCheck]:
    """One check over all named columns: a row counts once however many fields are bad."""
    if not columns:
        return []
    types = dict(df.dtypes)
    bad = reduce(lambda a, b: a | b, [P.badly_encoded(F.col(c), types[c]) for c in columns])
    return [RowCheck("encoding", "DV-007", ",".join(columns), bad,
                     lambda pct, *_: S.banded(pct, S.ENCODING))]


def row_checks(df: DataFrame, spec: BatchSpec) -> list[RowCheck]:
    nulls = null_checks(df, spec.required, spec.optional, spec.null_tolerance) \
        if spec.required or spec.optional else []
    return [
        *nulls,
        *type_checks(df, spec.types),
        *range_checks(spec.ranges),
        *date_range_checks(spec.dates),
        *format_checks(spec.formats),
        *encoding_check(df, spec.encodings),
    ]


def _finding(name: str, code: str, field_name: str, n: Column, total: Column, pct: Column,
             failed: Column, score: Column, level=lambda score, n: S.level(score)) -> Column:
    return F.struct(
        F.lit(name).alias("check_name"), F.lit(code).alias("failure_code"),
        F.lit(field_name).alias("field"), n.cast("bigint").alias("affected_count"),
        total.cast("bigint").alias("total_count"), pct.cast("double").alias("affected_pct"),
        F.when(failed, score).alias("severity_score"),
        F.when(failed, level(score, n)).alias("severity"), failed.alias("failed"),
    )


def _count_row(n: Column, spec: CountSpec) -> Column:
    """Record count against exact, minimum and maximum; a failure affects every row."""
    failures, deviations = [], []
    if spec.exact is not None:
        failures.append(n != spec.exact)
        deviations.append(F.abs(n - spec.exact) / spec.exact * 100 if spec.exact else F.lit(None))
    else:
        if spec.minimum is not None:
            low = n < spec.minimum
            deviations.append(F.when(low, (spec.minimum - n) / spec.minimum * 100))
        if spec.maximum is not None:
            high = n > spec.maximum
            deviations.append(F.when(high, (n - spec.maximum) / spec.maximum * 100))
    if spec.minimum is not None:
        failures.append(n < spec.minimum)
    if spec.maximum is not None:
        failures.append(n > spec.maximum)
    failed = reduce(lambda a, b: a | b, failures, F.lit(False))
    rest = 50.0 if spec.exact == 0 else S.COUNT[1]
    deviation = F.coalesce(*deviations, F.lit(None)).cast("double")
    score = F.when(deviation.isNull(), F.lit(rest)).otherwise(S.banded(deviation, S.COUNT))
    return _finding("count", "DV-001", "*", F.when(failed, n).otherwise(0), n,
                    F.when(failed, 100.0).otherwise(0.0), failed, score)


def _check_row(c: RowCheck, n: Column, extra: Column, total: Column) -> Column:
    if c.breached:
        failed = c.breached(extra)
        n, pct = F.when(failed, total).otherwise(0), F.when(failed, 100.0).otherwise(0.0)
    else:
        pct = _share(n, total)
        failed = (n > 0) & (pct > c.tolerance)
    return _finding(c.name, c.code, c.field, n, total, pct, failed, c.score(pct, extra, n), c.level)


def profile(df: DataFrame, checks: Sequence[RowCheck], count: CountSpec | None = None) -> DataFrame:
    """One finding per check, clean ones included, from a single fused aggregate."""
    if not checks and not count:
        return df.sparkSession.createDataFrame([], FINDING_DDL)
    slices = []
    for start in range(0, max(len(checks), 1), SLICE):
        part = checks[start:start + SLICE]
        wide = df.agg(
            F.count(F.lit(1)).alias("total"),
            *[F.count_if(c.violated).alias(f"n{i}") for i, c in enumerate(part)],
            *[c.extra.alias(f"x{i}") for i, c in enumerate(part)],
        )
        rows = [_count_row(F.col("total"), count)] if count and start == 0 else []
        for i, c in enumerate(part):
            rows.append(_check_row(c, F.col(f"n{i}"), F.col(f"x{i}"), F.col("total")))
        slices.append(wide.select(F.inline(F.array(*rows))))
    return reduce(DataFrame.unionByName, slices)


def profile_groups(df: DataFrame, by: Sequence[str], checks: Sequence[RowCheck], count: CountSpec | None = None) -> DataFrame:
    """``profile`` of every group of rows (file, day, source), from one fused aggregate over one scan.

    Partial sums are made per task and group, so a group of any size is counted by all tasks.
    """
    if not checks and not count:
        return df.select(*by).limit(0).join(df.sparkSession.createDataFrame([], FINDING_DDL))
    slices = []
    for start in range(0, max(len(checks), 1), SLICE):
        part = checks[start:start + SLICE]
        wide = df.groupBy(*by).agg(
            F.count(F.lit(1)).alias("_total"), *[F.count_if(c.violated).alias(f"_n{i}") for i, c in enumerate(part)],
            *[c.extra.alias(f"_x{i}") for i, c in enumerate(part)])
        rows = [_count_row(F.col("_total"), count)] if count and start == 0 else []
        for i, c in enumerate(part):
            rows.append(_check_row(c, F.col(f"_n{i}"), F.col(f"_x{i}"), F.col("_total")))
        slices.append(wide.select(*by, F.inline(F.array(*rows))))
    return reduce(DataFrame.unionByName, slices)


def count_finding(df: DataFrame, spec: CountSpec) -> DataFrame:
    return profile(df, [], spec)


def duplicate_keys(df: DataFrame, spec: DuplicateSpec) -> list[Column]:
    """What rows are compared by.  Whole rows are compared by a digest of their JSON, so that 16
    bytes a row are shuffled rather than the row."""
    types = dict(df.dtypes)
    fold = not spec.case_sensitive
    values = [
        (F.lower(F.col(c)) if fold and types[c] == "string" else F.col(c)).alias(c)
        for c in spec.keys or df.columns
    ]
    if not spec.keys:
        return [F.unhex(F.md5(F.to_json(F.struct(*values)))).alias("_k0")]
    return [v.alias(f"_k{i}") for i, v in enumerate(values)]


def duplicate_groups(df: DataFrame, spec: DuplicateSpec) -> DataFrame:
    """Key values held by more than one row, with the number of rows."""
    keys = duplicate_keys(df, spec)
    return (
        df.select(*keys).groupBy(*[f"_k{i}" for i in range(len(keys))])
        .agg(F.count(F.lit(1)).alias("members")).filter(F.col("members") > 1)
    )


def duplicate_finding(df: DataFrame, spec: DuplicateSpec) -> DataFrame:
    """Rows in groups of two or more.  Members are summed from group sizes, never joined back,
    so a value repeated millions of times costs one partial sum per task."""
    keys = duplicate_keys(df, spec)
    sizes = (
        df.select(*keys).groupBy(*[f"_k{i}" for i in range(len(keys))])
        .agg(F.count(F.lit(1)).alias("m"))
    )
    totals = sizes.agg(
        F.coalesce(F.sum("m"), F.lit(0)).alias("total"),
        F.coalesce(F.sum(F.when(F.col("m") > 1, F.col("m"))), F.lit(0)).alias("n"),
        F.count_if(F.col("m") > 1).alias("groups"),
    )
    n, total, groups = F.col("n"), F.col("total"), F.col("groups")
    pct = _share(n, total)
    failed = (pct > spec.tolerance) & (n > 0)
    score = S.duplicate_score(pct, groups)
    finding = _finding("duplicate", "DV-006", ",".join(spec.keys) or "*", n, total, pct,
                       failed, score)
    return totals.select(finding.alias("f"), "groups").select("f.*", "groups")


def finite(column: Column) -> Column:
    number = column.try_cast("double")
    return F.when(
        ~F.isnan(number) & (F.abs(number) < float("inf")), number
    )


def outlier_statistics(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: a struct of population moments per column, over finite values only."""
    return df.agg(*[
        F.struct(
            F.avg(finite(F.col(c))).alias("mean"), F.stddev_pop(finite(F.col(c))).alias("std"),
            F.min(finite(F.col(c))).alias("low"), F.max(finite(F.col(c))).alias("high"),
            F.count(finite(F.col(c))).alias("n"), F.count(F.lit(1)).alias("rows"),
        ).alias(c)
        for c in columns
    ])


def outlier_moments(df: DataFrame, columns: Sequence[str], min_records: int = 30) -> dict[str, Row]:
    """The statistics row, fetched; columns with too few values or no spread are left out."""
    row = outlier_statistics(df, columns).first()
    return {
        c: row[c] for c in columns
        if row[c]["rows"] >= min_records and row[c]["n"] >= min_records and row[c]["std"]
    }


def z_score(column: str, moments: Row) -> Column:
    return F.abs((finite(F.col(column)) - moments["mean"]) / moments["std"])


def outlier_predicates(df: DataFrame, columns: Sequence[str], threshold: float = 3.0,
                       min_records: int = 30) -> dict[str, Column]:
    """Per column a predicate true on outliers.

    A first scan fetches one row of moments; in the second they are constants, so that every
    use shares one evaluation and no row is joined.
    """
    moments = outlier_moments(df, columns, min_records)
    return {
        c: F.coalesce(z_score(c, moments[c]) > threshold, F.lit(False)) if c in moments else F.lit(False)
        for c in columns
    }


def outlier_checks(df: DataFrame, columns: Sequence[str], threshold: float = 3.0,
                   min_records: int = 30) -> list[RowCheck]:
    return _outlier_row_checks(outlier_predicates(df, columns, threshold, min_records))


def _outlier_row_checks(predicates: dict[str, Column]) -> list[RowCheck]:
    return [
        RowCheck("outlier", "DV-004", c, bad, lambda pct, _, n: S.outlier_score(pct, n),
                 level=lambda score, n: S.outlier_level(score))
        for c, bad in predicates.items()
    ]


# Names never treated as measures.
ID_LIKE = ("id", "index", "unnamed: 0", "_id", "row_id")


def numeric_share(df: DataFrame) -> DataFrame:
    """Per column the share of values that read as numbers, over the whole table."""
    types = dict(df.dtypes)
    names = [c for c in df.columns if c.lower() not in ID_LIKE]

    def readable(c: str) -> Column:
        kind = types[c].split("(")[0]
        if kind in P.NATIVE_TYPES["float"] or kind == "boolean":
            return F.col(c).isNotNull()
        if kind == "string":
            return P.coercible(F.col(c), "float")
        return F.lit(False)

    wide = df.agg(F.count(F.lit(1)).alias("total"),
                  *[F.count_if(readable(c)).alias(f"n{i}") for i, c in enumerate(names)])
    rows = [
        F.struct(F.lit(c).alias("field"), F.col(f"n{i}").alias("numeric_count"),
                 F.col("total").alias("total_count"),
                 (F.col(f"n{i}") > F.col("total") * 0.8).alias("is_numeric"))
        for i, c in enumerate(names)
    ]
    return wide.select(F.inline(F.array(*rows)))


def validate_batch(df: DataFrame, spec: BatchSpec) -> DataFrame:
    """All findings of the bronze layer for one batch, failed and clean.

    Scans: one for the moments of outlier columns, one for every count, one for duplicates.
    """
    checks = row_checks(df, spec)
    if spec.outliers:
        checks += outlier_checks(df, spec.outliers, spec.z_threshold)
    findings = profile(df, checks, spec.count)
    if spec.duplicates:
        findings = findings.unionByName(duplicate_finding(df, spec.duplicates).drop("groups"))
    return findings


def _same_group(left: DataFrame, right: DataFrame, by: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[c].eqNullSafe(right[f"_g_{c}"]) for c in by])


def with_group_moments(df: DataFrame, by: Sequence[str], columns: Sequence[str], min_records: int = 30) -> DataFrame:
    """Adds ``_z_<column>``: how many deviations a value lies from its group's mean; null where a group has
    too few values or no spread.  One row of moments a group is joined."""
    moments = df.groupBy(*[F.col(c).alias(f"_g_{c}") for c in by]).agg(*[
        F.struct(F.avg(finite(F.col(c))).alias("mean"), F.stddev_pop(finite(F.col(c))).alias("std"),
                 F.count(finite(F.col(c))).alias("n")).alias(f"_m_{c}") for c in columns])
    joined = df.join(moments, _same_group(df, moments, by), "left")
    z = {f"_z_{c}": F.when((F.col(f"_m_{c}.n") >= min_records) & (F.col(f"_m_{c}.std") > 0),
                           F.abs(finite(F.col(c)) - F.col(f"_m_{c}.mean")) / F.col(f"_m_{c}.std")) for c in columns}
    return joined.withColumns(z).select(*df.columns, *z)


def duplicate_findings(df: DataFrame, spec: DuplicateSpec, by: Sequence[str]) -> DataFrame:
    """``duplicate_finding`` of every group of rows; rows repeat only within their group."""
    keys = duplicate_keys(df.drop(*by) if not spec.keys else df, spec)
    sizes = df.select(*by, *keys).groupBy(*by, *[f"_k{i}" for i in range(len(keys))]).agg(F.count(F.lit(1)).alias("_m"))
    totals = sizes.groupBy(*by).agg(F.sum("_m").alias("_total"), F.coalesce(F.sum(F.when(F.col("_m") > 1, F.col("_m"))), F.lit(0)).alias("_n"),
                                    F.count_if(F.col("_m") > 1).alias("_groups"))
    n, total = F.col("_n"), F.col("_total")
    pct = _share(n, total)
    failed = (pct > spec.tolerance) & (n > 0)
    finding = _finding("duplicate", "DV-006", ",".join(spec.keys) or "*", n, total, pct, failed, S.duplicate_score(pct, F.col("_groups")))
    return totals.select(*by, finding.alias("_f")).select(*by, "_f.*")


def validate_groups(df: DataFrame, spec: BatchSpec, by: Sequence[str]) -> DataFrame:
    """``validate_batch`` of every group of rows, each judged on its own: the group's columns and its findings.

    Scans: one for the moments of outlier columns, one for every count, one for duplicates, however many
    groups there are.  Nothing is fetched.
    """
    checks, rows = row_checks(df, spec), df
    if spec.outliers:
        rows = with_group_moments(df, by, spec.outliers)
        checks += _outlier_row_checks({c: F.coalesce(F.col(f"_z_{c}") > spec.z_threshold, F.lit(False)) for c in spec.outliers})
    findings = profile_groups(rows, by, checks, spec.count)
    if spec.duplicates:
        findings = findings.unionByName(duplicate_findings(df, spec.duplicates, by))
    return findings


def quarantine_groups(df: DataFrame, spec: BatchSpec, by: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """``quarantine`` of every group of rows, with the group's columns.

    The severities of a group's checks come by one joined row a group; a row is held by the checks that it
    breaks and that are CRITICAL in its group.
    """
    spec_rows = replace(spec, outliers=())
    found = validate_groups(df, spec_rows, by).filter(F.col("severity") == CRITICAL)
    critical = found.groupBy(*[F.col(c).alias(f"_g_{c}") for c in by]).agg(
        F.collect_set(F.concat_ws(":", "check_name", "field")).alias("_critical"))
    marked = df.join(critical, _same_group(df, critical, by)).select(*df.columns, "_critical")
    hits = [(c.violated, c.code, c.id) for c in row_checks(df, spec)] + [(F.lit(True), "DV-001", "count:*")]
    if spec.duplicates:
        names = duplicate_keys(marked.drop(*by, "_critical") if not spec.duplicates.keys else marked, spec.duplicates)
        keyed = marked.select("*", *names)
        own = [f"_k{i}" for i in range(len(names))]
        repeated = keyed.groupBy(*by, *own).agg(F.count(F.lit(1)).alias("_m")).filter("_m > 1").select(
            *[F.col(c).alias(f"_g_{c}") for c in (*by, *own)], F.lit(True).alias("_repeated"))
        marked = keyed.join(repeated, _same_group(keyed, repeated, [*by, *own]), "left").select(*marked.columns, "_repeated")
        hits.append((F.col("_repeated"), "DV-006", f"duplicate:{','.join(spec.duplicates.keys) or '*'}"))
    found = F.array_compact(F.array(*[
        F.when(test & F.array_contains("_critical", name), F.struct(F.lit(code).alias("code"), F.lit(name).alias("reason")))
        for test, code, name in hits]))
    return marked.withColumn("_hits", found).filter(F.size("_hits") > 0).select(
        *by, P.row_key(*keys).alias("row_key"), F.struct(*df.columns).alias("record"),
        F.array_sort(F.array_distinct(F.col("_hits.code"))).alias("failure_codes"), F.array_join("_hits.reason", "; ").alias("reason"))


def violations(df: DataFrame, checks: Sequence[RowCheck], keys: Sequence[str]) -> DataFrame:
    """Long form, one row per violating (row, check).  Stays distributed."""
    hits = [
        F.when(c.violated, F.struct(
            F.lit(c.name).alias("check_name"), F.lit(c.code).alias("failure_code"),
            F.lit(c.field).alias("field")))
        for c in checks
    ]
    return df.select(P.row_key(*keys).alias("row_key"),
                     F.inline(F.array_compact(F.array(*hits))))


def critical_checks(df: DataFrame, spec: BatchSpec) -> set[str]:
    """Which checks are CRITICAL for this batch; at most one fetched row per check.

    Outliers never are, so their two passes are left out.
    """
    rows = validate_batch(df, replace(spec, outliers=())).filter(F.col("severity") == CRITICAL).select("check_name", "field").collect()
    return {f"{r['check_name']}:{r['field']}" for r in rows}


def hit_codes(df: DataFrame, spec: BatchSpec) -> DataFrame:
    """Adds ``codes`` and ``reasons``: what CRITICAL findings say about each row.

    Severity belongs to the whole batch and is settled first.  Rows are then flagged in place,
    by the critical checks only; a join happens only when duplicates are critical, against the
    repeated keys.
    """
    critical = critical_checks(df, spec)
    hits = [(c.violated, c.code, c.id) for c in row_checks(df, spec) if c.id in critical]
    if "count:*" in critical:
        hits.append((F.lit(True), "DV-001", "count:*"))
    marked = df
    repeats = spec.duplicates and f"duplicate:{','.join(spec.duplicates.keys) or '*'}"
    if repeats in critical:
        keys = duplicate_keys(df, spec.duplicates)
        groups = duplicate_groups(df, spec.duplicates)
        repeated = groups.select(*[F.col(f"_k{i}").alias(f"_r{i}") for i in range(len(keys))],
                                 F.lit(True).alias("_repeated"))
        keyed = df.select("*", *keys)
        on = reduce(lambda a, b: a & b, [
            F.col(f"_k{i}").eqNullSafe(F.col(f"_r{i}")) for i in range(len(keys))])
        marked = keyed.join(repeated, on, "left").select(*df.columns, "_repeated")
        hits.append((F.col("_repeated"), "DV-006", repeats))
    kind = "array<struct<code:string,reason:string>>"
    found = F.array_compact(F.array(*[
        F.when(test, F.struct(F.lit(code).alias("code"), F.lit(name).alias("reason")))
        for test, code, name in hits])) if hits else F.array().cast(kind)
    return marked.select(*df.columns, found.alias("_hits")).select(
        *df.columns,
        F.array_sort(F.array_distinct(F.col("_hits.code"))).alias("codes"),
        F.col("_hits.reason").alias("reasons"),
    )


def quarantine(df: DataFrame, spec: BatchSpec, keys: Sequence[str]) -> DataFrame:
    """Rows hit by at least one CRITICAL finding, once each, with codes and reasons."""
    return hit_codes(df, spec).filter(F.size("codes") > 0).select(
        P.row_key(*keys).alias("row_key"),
        F.struct(*df.columns).alias("record"),
        F.col("codes").alias("failure_codes"),
        F.array_join("reasons", "; ").alias("reason"),
    )


def clean(df: DataFrame, spec: BatchSpec) -> DataFrame:
    """The complement of the quarantine."""
    return hit_codes(df, spec).filter(F.size("codes") == 0).select(*df.columns)


def quarantine_statistics(quarantined: DataFrame) -> DataFrame:
    """Counts by code, by batch and in total; a row with two codes counts under both."""
    coded = quarantined.select("batch_id", "row_key", F.explode("failure_codes").alias("code"))
    by_code = coded.groupBy("code").agg(F.count(F.lit(1)).alias("rows")).select(
        F.lit("code").alias("scope"), F.col("code").alias("value"), "rows")
    rest = quarantined.groupingSets([["batch_id"], []], "batch_id").agg(
        F.count(F.lit(1)).alias("rows"), F.grouping("batch_id").alias("_all"))
    rest = rest.select(
        F.when(F.col("_all") == 1, "total").otherwise("batch").alias("scope"),
        F.when(F.col("_all") == 1, "*").otherwise(F.col("batch_id")).alias("value"), "rows")
    return by_code.unionByName(rest)
