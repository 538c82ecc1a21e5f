"""Schema contracts (layer 2): conformance, hashes, versions and changes between versions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tableward.functions import predicates as P
from tableward.model import CRITICAL, INFO, WARNING
from tableward.operators.bronze import RowCheck, profile


@dataclass(frozen=True)
class ContractColumn:
    name: str
    type: str = "string"
    required: bool = False
    nullable: bool = True
    unique: bool = False
    min_length: int | None = None
    max_length: int | None = None
    minimum: float | None = None
    maximum: float | None = None
    pattern: str | None = None
    enum: tuple | None = None
    precision: int | None = None
    scale: int | None = None
    foreign_key: str | None = None


@dataclass(frozen=True)
class Contract:
    id: str
    version: str
    source: str
    columns: tuple[ContractColumn, ...]
    additional_properties: bool = False


# Contract type -> Spark type names that carry it, and how text must read.
TYPE_NAMES = {
    "string": ("string",),
    "integer": ("tinyint", "smallint", "int", "bigint"),
    "number": ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal"),
    "boolean": ("boolean",),
    "array": ("array",),
    "object": ("struct", "map"),
    "null": ("void",),
    "date": ("date",),
    "datetime": ("timestamp", "timestamp_ntz"),
}
TEXT_FORMS = {"integer": "integer", "number": "float", "boolean": "boolean"}


def _base(kind: str) -> str:
    return kind.split("(")[0].split("<")[0]


def wrong_type(value: Column, actual: str, expected: str, nullable: bool = True) -> Column:
    """Null passes when nullable; text passes when it reads as the type, dates included."""
    if _base(actual) in TYPE_NAMES[expected]:
        wrong = F.lit(False)
    elif actual == "string" and expected in TEXT_FORMS:
        wrong = ~P.coercible(value, TEXT_FORMS[expected])
    elif actual == "string" and expected == "date":
        wrong = P.any_layout(value, ("yyyy-MM-dd",)).isNull()
    elif actual == "string" and expected == "datetime":
        wrong = value.try_cast("timestamp").isNull()
    else:
        wrong = F.lit(True)
    return F.when(value.isNull(), F.lit(not nullable)).otherwise(wrong)


def breaks_constraint(value: Column, actual: str, c: ContractColumn) -> Column:
    """Length and pattern apply to text, bounds to numbers, the enumeration to any value."""
    tests = []
    if actual == "string" and c.type in ("string", "date", "datetime"):
        if c.min_length is not None:
            tests.append(F.char_length(value) < c.min_length)
        if c.max_length is not None:
            tests.append(F.char_length(value) > c.max_length)
        if c.pattern is not None:
            tests.append(~value.rlike(c.pattern))
    if c.type in ("integer", "number"):
        number = value.try_cast("double")
        if c.minimum is not None:
            tests.append(number < c.minimum)
        if c.maximum is not None:
            tests.append((number > c.maximum) & ~F.isnan(number))
    if c.enum is not None:
        tests.append(~value.isin(*c.enum))
    broken = reduce(lambda a, b: a | F.coalesce(b, F.lit(False)), tests, F.lit(False))
    return F.coalesce(value.isNotNull() & broken, F.lit(False))


def loses_precision(value: Column, precision: int, scale: int) -> Column:
    """More digits, or more decimal places, than declared.

    A number is read in its shortest decimal form with at least one decimal place; magnitudes
    that this form writes with an exponent count as a loss.
    """
    plain = F.abs(value).cast("decimal(38,16)").cast("string")
    whole = F.substring_index(plain, ".", 1)
    places = F.regexp_replace(F.substring_index(plain, ".", -1), "0+$", "")
    places = F.when(places == "", "0").otherwise(places)
    digits = F.length(whole) + F.length(places)
    exponent = (F.abs(value) >= 1e16) | ((F.abs(value) < 1e-4) & (value != 0))
    return F.coalesce(exponent | (digits > precision) | (F.length(places) > scale), F.lit(False))


def _severity(required: bool) -> str:
    return CRITICAL if required else WARNING


def contract_checks(df: DataFrame, contract: Contract) -> list[RowCheck]:
    """The contract as row checks with a severity of their own, ready to share a scan with
    others.  One check per code and column."""
    types = dict(df.dtypes)

    def check(code: str, name: str, severity: str, test: Column) -> RowCheck:
        return RowCheck("contract", code, name, test, lambda *_: F.lit(None).cast("double"),
                        level=lambda score, n: F.lit(severity))

    checks = []
    for c in contract.columns:
        if c.name not in types:
            if c.required:
                checks.append(check("SC-001", c.name, CRITICAL, F.lit(True)))
            continue
        value, kind, severity = F.col(c.name), types[c.name], _severity(c.required)
        checks.append(check("SC-003", c.name, severity, wrong_type(value, kind, c.type, c.nullable)))
        checks.append(check("SC-005", c.name, severity, breaks_constraint(value, kind, c)))
        if c.precision is not None and c.scale is not None:
            checks.append(check("SC-004", c.name, severity, loses_precision(value, c.precision, c.scale)))
    if not contract.additional_properties:
        declared = {c.name for c in contract.columns}
        checks += [check("SC-002", n, INFO, F.lit(True)) for n in df.columns if n not in declared]
    return checks


def validate_contract(df: DataFrame, contract: Contract) -> DataFrame:
    """One finding per (code, column) with violations, from one aggregate over one scan."""
    return profile(df, contract_checks(df, contract)).filter("failed").select(
        "failure_code", F.col("field").alias("column_name"), "severity",
        (F.col("severity") == CRITICAL).alias("blocking"), "affected_count")


def validate_open(df: DataFrame, column: str, contract: Contract) -> DataFrame:
    """Presence checks on rows kept as maps: keys may differ from row to row."""
    required = [c.name for c in contract.columns if c.required]
    declared = F.array(*[F.lit(c.name) for c in contract.columns])
    keys = F.map_keys(column)
    missing = F.array_compact(F.array(*[
        F.when(~F.coalesce(F.map_contains_key(column, n), F.lit(False)),
               F.struct(F.lit("SC-001").alias("failure_code"), F.lit(n).alias("column_name")))
        for n in required]))
    hits = missing
    if not contract.additional_properties:
        extra = F.transform(F.array_except(keys, declared), lambda k: F.struct(
            F.lit("SC-002").alias("failure_code"), k.alias("column_name")))
        hits = F.concat(missing, F.coalesce(extra, F.array().cast(
            "array<struct<failure_code:string,column_name:string>>")))
    found = df.select(F.inline(hits)).groupBy("failure_code", "column_name").agg(
        F.count(F.lit(1)).alias("affected_count"))
    critical = F.col("failure_code") == "SC-001"
    return found.select(
        "failure_code", "column_name", F.when(critical, CRITICAL).otherwise(INFO).alias("severity"),
        critical.alias("blocking"), "affected_count")


def unique_findings(df: DataFrame, columns: Sequence[Sequence[str]]) -> DataFrame:
    """Repeated values per uniqueness constraint; nulls do not count as repeated.

    All constraints are counted by grouping sets from one scan.
    """
    used = list(dict.fromkeys(n for names in columns for n in names))
    marks = [sum(1 << (len(used) - 1 - i) for i, n in enumerate(used) if n not in names) for names in columns]
    sets = {mark: tuple(F.col(f"`{n}`") for n in dict.fromkeys(names)) for mark, names in zip(marks, columns, strict=True)}
    sizes = df.groupingSets(list(sets.values()), *[F.col(f"`{n}`") for n in used]).agg(
        F.count(F.lit(1)).alias("_m"), F.grouping_id().alias("_set")).filter("_m > 1")
    wide, rows = [], []
    for i, (mark, names) in enumerate(zip(marks, columns, strict=True)):
        hit = reduce(lambda a, b: a & b, [F.col(f"`{n}`").isNotNull() for n in names], F.col("_set") == mark)
        wide += [F.count_if(hit).alias(f"g{i}"), F.coalesce(F.sum(F.when(hit, F.col("_m"))), F.lit(0)).alias(f"a{i}")]
        rows.append(F.struct(F.lit("SC-005").alias("failure_code"), F.lit(",".join(names)).alias("column_name"),
                             F.col(f"g{i}").alias("groups"), F.col(f"a{i}").alias("affected_count")))
    return sizes.agg(*wide).select(F.inline(F.array(*rows)))


# Registry tables: one row per (contract, version, column) -------------------------------------

CONSTRAINTS = ("enum_values", "max_length", "maximum", "min_length", "minimum", "nullable", "pattern")


def contract_hashes(columns: DataFrame) -> DataFrame:
    """SHA-256 of the canonical JSON of each contract: keys sorted, absent values left out."""
    column = F.struct(
        F.col("column_type"),
        F.struct(*[F.col(c) for c in CONSTRAINTS], F.col("is_unique").alias("unique")).alias("constraints"),
        F.col("criticality"), F.col("column_name").alias("name"))
    gathered = columns.groupBy("contract_id", "version", "source", "additional_properties").agg(
        F.array_sort(F.collect_list(F.struct("column_name", column.alias("c")))).alias("cs"))
    canonical = F.to_json(F.struct(
        F.col("additional_properties"), F.transform("cs", lambda x: x["c"]).alias("columns"),
        F.col("contract_id").alias("id"), F.col("source"), F.col("version")))
    return gathered.select("contract_id", "version", F.sha2(canonical, 256).alias("contract_hash"))


def schema_hashes(columns: DataFrame) -> DataFrame:
    """The structural variant: types and constraints by property name, required names, openness."""
    prop = F.struct(
        F.col("enum_values").alias("enum"), F.col("max_length").alias("maxLength"), "maximum",
        F.col("min_length").alias("minLength"), "minimum", "pattern", F.col("column_type").alias("type"))
    needed = (F.col("criticality") == "required") & ~F.col("nullable")
    gathered = columns.groupBy("contract_id", "version", "additional_properties").agg(
        F.array_sort(F.collect_list(F.struct("column_name", prop.alias("p")))).alias("ps"),
        F.array_sort(F.collect_list(F.when(needed, F.col("column_name")))).alias("required"))
    canonical = F.to_json(F.struct(
        F.col("additional_properties").alias("additionalProperties"),
        F.map_from_entries("ps").alias("properties"), F.col("required"), F.lit("object").alias("type")))
    return gathered.select("contract_id", "version", F.sha2(canonical, 256).alias("schema_hash"))


def verify_hashes(submitted: DataFrame, registered: DataFrame) -> DataFrame:
    """Submitted contracts that differ from the registered ones or are not registered."""
    known = registered.select("contract_id", "version", F.col("contract_hash").alias("expected_hash"))
    joined = submitted.join(known, ["contract_id", "version"], "left")
    issue = F.when(F.col("expected_hash").isNull(), "Contract not registered").when(
        F.col("expected_hash") != F.col("contract_hash"), "Contract hash mismatch")
    return joined.select("contract_id", "version", F.lit("SC-008").alias("failure_code"),
                         F.lit(CRITICAL).alias("severity"), F.lit(True).alias("blocking"),
                         issue.alias("issue")).filter(F.col("issue").isNotNull())


def version_parts(version: Column) -> Column:
    """Numeric parts for ordering; text that is no version sorts as 0.0.0."""
    valid = version.rlike(r"^\d+(\.\d+)*$")
    parts = F.transform(F.split(version, r"\."), lambda x: x.try_cast("int"))
    return F.when(valid, parts).otherwise(F.array(F.lit(0), F.lit(0), F.lit(0)))


def latest_versions(versions: DataFrame) -> DataFrame:
    return versions.select("contract_id", "version").distinct().groupBy("contract_id").agg(
        F.max_by("version", version_parts(F.col("version"))).alias("latest_version"),
        F.count(F.lit(1)).alias("versions"))


def contracts_for_source(versions: DataFrame) -> DataFrame:
    """The newest contract of each source, ties broken by contract id."""
    order = F.struct(version_parts(F.col("version")), F.col("contract_id"))
    return versions.select("source", "contract_id", "version").distinct().groupBy("source").agg(
        F.max_by(F.struct("contract_id", "version"), order).alias("c")).select("source", "c.*")


def compare_versions(pairs: DataFrame, current: str, expected: str) -> DataFrame:
    """Adds ``direction`` (-1, 0, 1), ``is_major``, ``is_downgrade`` and the SC-006 severity."""
    a, b = version_parts(F.col(current)), version_parts(F.col(expected))
    direction = F.when(a > b, 1).when(a < b, -1).otherwise(0)
    major = a[0] != b[0]
    return pairs.select(
        "*", direction.alias("direction"), major.alias("is_major"), (direction < 0).alias("is_downgrade"),
        F.when(direction == 0, None).when(major, WARNING).otherwise(INFO).alias("severity"),
        (~major).alias("is_compatible"))


COMPARED = ("column_type", "criticality", "additional_properties", *CONSTRAINTS)


def align_versions(old: DataFrame, new: DataFrame) -> DataFrame:
    """Columns of two versions side by side (``o``, ``n``), over contracts that have both.

    Each side is read once.  Facts about a whole contract come from a window over its columns,
    as many rows as its schema is wide: whether it accepts further columns in either version,
    and which row may report that.
    """
    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select("contract_id", "column_name", F.struct(*[F.col(c) for c in COMPARED]).alias(name))

    joined = side(old, "o").join(side(new, "n"), ["contract_id", "column_name"], "full_outer")
    contract = W.partitionBy("contract_id")
    return joined.select(
        "*", F.max(F.col("o").isNotNull()).over(contract).alias("_has_old"),
        F.max(F.col("n").isNotNull()).over(contract).alias("_has_new"),
        F.max("o.additional_properties").over(contract).alias("_was_open"),
        F.max("n.additional_properties").over(contract).alias("_is_open"),
        (F.col("column_name") == F.min("column_name").over(contract)).alias("_reports"),
    ).filter("_has_old AND _has_new")


def _changes(aligned: DataFrame, tests: Sequence[tuple]) -> DataFrame:
    """``tests``: change type, condition, description, and the column when it is another one."""
    hits = [F.when(F.coalesce(test, F.lit(False)), F.struct(
        F.lit(column[0]).alias("column_name") if column else F.col("column_name"),
        F.lit(kind).alias("change_type"), text.alias("description"))) for kind, test, text, *column in tests]
    return aligned.select("contract_id", F.inline(F.array_compact(F.array(*hits))))


def contract_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    status = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").when(
        F.col("o").eqNullSafe(F.col("n")), "unchanged").otherwise("changed")
    return align_versions(old, new).select("contract_id", "column_name", status.alias("status"))


def _text(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def breaking_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Changes after which data or readers of the old version may fail (SC-007)."""
    o, n = F.col("o"), F.col("n")
    both = o.isNotNull() & n.isNotNull()
    was, now = o["criticality"] == "required", n["criticality"] == "required"
    widened = (o["column_type"] == "integer") & (n["column_type"] == "number")
    raised = lambda c: both & n[c].isNotNull() & (o[c].isNull() | (n[c] > o[c]))
    lost = F.array_except(o["enum_values"], n["enum_values"])
    narrowed = "constraint_narrowed"
    return _changes(align_versions(old, new), [
        ("removed_required_column", n.isNull() & was, F.lit("required column removed")),
        ("breaking_type_change", both & (o["column_type"] != n["column_type"]) & ~widened,
         _text("type changed from ", o["column_type"], " to ", n["column_type"])),
        (narrowed, both & (n["max_length"] < o["max_length"]),
         _text("maxLength narrowed from ", o["max_length"], " to ", n["max_length"])),
        (narrowed, raised("min_length"), _text("minLength increased to ", n["min_length"])),
        (narrowed, both & (n["maximum"] < o["maximum"]),
         _text("maximum narrowed from ", o["maximum"], " to ", n["maximum"])),
        (narrowed, raised("minimum"), _text("minimum increased to ", n["minimum"])),
        (narrowed, both & n["pattern"].isNotNull() & o["pattern"].isNull(), F.lit("pattern constraint added")),
        (narrowed, both & (n["pattern"] != o["pattern"]), F.lit("pattern constraint changed")),
        (narrowed, both & (F.size(n["enum_values"]) > 0) & (F.size(lost) > 0),
         _text("enum values removed: ", F.array_join(F.array_sort(lost), ","))),
        (narrowed, both & o["nullable"] & ~n["nullable"], F.lit("nullable changed from true to false")),
        ("made_required", both & ~was & now, F.lit("changed from optional to required")),
        ("additional_properties_disabled", F.col("_reports") & F.col("_was_open") & ~F.col("_is_open"),
         F.lit("additionalProperties changed from true to false"), "__schema__"),
    ])


def nonbreaking_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    o, n = F.col("o"), F.col("n")
    both = o.isNotNull() & n.isNotNull()
    was, now = o["criticality"] == "required", n["criticality"] == "required"
    widened = "constraint_widened"
    return _changes(align_versions(old, new), [
        ("added_optional_column", o.isNull() & ~now, F.lit("optional column added")),
        ("made_optional", both & was & ~now, F.lit("changed from required to optional")),
        (widened, both & (n["max_length"] > o["max_length"]),
         _text("maxLength widened from ", o["max_length"], " to ", n["max_length"])),
        (widened, both & o["min_length"].isNotNull()
         & (n["min_length"].isNull() | (n["min_length"] < o["min_length"])),
         F.lit("minLength constraint relaxed")),
        (widened, both & (n["maximum"] > o["maximum"]),
         _text("maximum widened from ", o["maximum"], " to ", n["maximum"])),
        (widened, both & ~o["nullable"] & n["nullable"], F.lit("nullable changed from false to true")),
    ])
