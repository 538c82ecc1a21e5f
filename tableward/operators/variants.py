"""Contracts of records without a schema: JSON whose fields and types change from row to row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableward.model import CRITICAL, INFO, WARNING
from tableward.operators.contracts import Contract

# Contract type -> kinds of variant values that carry it.
CARRIERS = {
    "string": ("STRING",), "integer": ("BIGINT",), "number": ("BIGINT", "DECIMAL", "DOUBLE", "FLOAT"),
    "boolean": ("BOOLEAN",), "array": ("ARRAY",), "object": ("OBJECT",), "null": ("VOID",), "date": ("DATE", "STRING"),
    "datetime": ("TIMESTAMP", "TIMESTAMP_NTZ", "STRING"),
}


def as_variant(df: DataFrame, column: str, into: str = "value") -> DataFrame:
    """JSON text as variants; text that is no JSON is null there."""
    return df.withColumn(into, F.try_parse_json(F.col(column)))


def kind(value: Column) -> Column:
    """The outermost type of a variant, without its precision or fields."""
    return F.regexp_extract(F.schema_of_variant(value), "^([A-Z_]+)", 1)


def observed_schema(df: DataFrame, column: str) -> DataFrame:
    """(schema): the narrowest schema that holds every row, merged on the way by one aggregate."""
    return df.agg(F.schema_of_variant_agg(column).alias("schema"))


def observed_fields(df: DataFrame, column: str) -> DataFrame:
    """(field, kind, rows) of the top-level fields of variant objects, from one scan.

    Two more rows tell of the records themselves: field null, kind ``OBJECT`` or whatever else came (``UNREADABLE``
    for nulls).  Partial counts are made per task, so what is shuffled is one row per task, field and kind.
    """
    value = F.col(column)
    record = F.struct(F.lit(None).cast("string").alias("field"),
                      F.when(value.isNull(), "UNREADABLE").otherwise(kind(value)).alias("kind"))
    # An object is a map of variants, whatever its fields; other values are none.
    entries = F.map_entries(F.try_variant_get(value, "$", "map<string,variant>"))
    fields = F.transform(entries, lambda e: F.struct(e["key"].alias("field"), F.coalesce(kind(e["value"]), F.lit("VOID")).alias("kind")))
    found = F.concat(F.array(record), F.coalesce(fields, F.array().cast("array<struct<field:string,kind:string>>")))
    return df.select(F.inline(found)).groupBy("field", "kind").agg(F.count(F.lit(1)).alias("rows"))


def diff_contract(observed: DataFrame, contract: Contract) -> DataFrame:
    """What ``observed_fields`` says against a contract: (failure_code, column_name, severity, blocking, affected_count).

    SC-001: records without a required field.  SC-002: records with a field that is not declared, unless the contract
    allows them.  SC-003: records where a field has another type, a null where none may be, or that are no objects
    (column ``*``).  An empty table has no findings.
    """
    spark = observed.sparkSession
    accepted = [(c.name, c.required, c.nullable, list(CARRIERS[c.type])) for c in contract.columns]
    declared = spark.createDataFrame(accepted, "column_name string, required boolean, nullable boolean, kinds array<string>")
    fits = F.array_contains("kinds", F.col("kind")) | (F.col("nullable") & (F.col("kind") == "VOID"))
    known = observed.filter("field IS NOT NULL").join(declared, F.col("field") == F.col("column_name"), "left")
    per_field = known.groupBy("field").agg(
        F.sum("rows").alias("present"), F.sum(F.when(F.col("column_name").isNotNull() & ~fits, F.col("rows")).otherwise(0)).alias("wrong"),
        F.first("column_name").isNull().alias("extra"))
    records = observed.filter("field IS NULL").agg(
        F.coalesce(F.sum(F.when(F.col("kind") == "OBJECT", F.col("rows"))), F.lit(0)).alias("objects"),
        F.coalesce(F.sum(F.when(F.col("kind") != "OBJECT", F.col("rows"))), F.lit(0)).alias("others"))
    objects = records.select("objects").scalar()
    seen = declared.join(per_field, F.col("column_name") == F.col("field"), "left").withColumn("objects", objects)
    level = F.when(F.col("required"), CRITICAL).otherwise(WARNING)
    missing = seen.filter("required").select(
        F.lit("SC-001").alias("failure_code"), "column_name", F.lit(CRITICAL).alias("severity"),
        (F.col("objects") - F.coalesce("present", F.lit(0))).alias("affected_count"))
    wrong = seen.select(F.lit("SC-003").alias("failure_code"), "column_name", level.alias("severity"),
                        F.coalesce("wrong", F.lit(0)).alias("affected_count"))
    unreadable = records.select(F.lit("SC-003").alias("failure_code"), F.lit("*").alias("column_name"),
                                F.lit(CRITICAL).alias("severity"), F.col("others").alias("affected_count"))
    found = missing.unionByName(wrong).unionByName(unreadable)
    if not contract.additional_properties:
        found = found.unionByName(per_field.filter("extra").select(
            F.lit("SC-002").alias("failure_code"), F.col("field").alias("column_name"), F.lit(INFO).alias("severity"),
            F.col("present").alias("affected_count")))
    return found.filter("affected_count > 0").select(
        "failure_code", "column_name", "severity", (F.col("severity") == CRITICAL).alias("blocking"),
        F.col("affected_count").cast("bigint").alias("affected_count"))


def validate_variants(df: DataFrame, column: str, contract: Contract) -> DataFrame:
    """``diff_contract`` of a table of variants: one scan for the fields, all else on a row per field and type."""
    return diff_contract(observed_fields(df, column), contract)
