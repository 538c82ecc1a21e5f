"""Reference data and referential integrity (layer 3).

Joins carry no broadcast hint: adaptive execution broadcasts a reference that turns out small
and splits hot partitions of one that does not.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableward.functions.predicates import row_key

# Text that marks a reference record as active.
ACTIVE_WORDS = ("true", "yes", "1", "active")


def load_reference(df: DataFrame, key: str, load_order: Sequence[str]) -> DataFrame:
    """One record per key: null keys dropped, the last loaded duplicate wins."""
    position = F.struct(*load_order)
    return (
        df.filter(F.col(key).isNotNull())
        .groupBy(F.col(key).cast("string").alias("ref_key"))
        .agg(F.max_by(F.struct(*df.columns), position).alias("record"))
    )


def is_active(column: Column) -> Column:
    """A missing flag means active."""
    return F.coalesce(F.lower(F.trim(column.cast("string"))).isin(*ACTIVE_WORDS), F.lit(True))


def broken_references(df: DataFrame, field: str, reference: DataFrame, ref_key: str,
                      keys: Sequence[str], allow_null: bool = False) -> DataFrame:
    """Rows whose key is not in the reference, and null keys unless allowed."""
    known = reference.select(F.col(ref_key).cast("string").alias("_ref")).filter("_ref IS NOT NULL")
    rows = df.select(row_key(*keys).alias("row_key"), F.lit(field).alias("field"),
                     F.col(field).cast("string").alias("value"))
    missing = rows.filter(F.col("value").isNotNull()).join(
        known, F.col("value") == F.col("_ref"), "left_anti").withColumn("reason", F.lit("not_found"))
    if allow_null:
        return missing
    # Null keys match nothing; shuffled with the rest they would all meet in one task.
    return missing.union(rows.filter(F.col("value").isNull()).withColumn("reason", F.lit("null_fk")))


def orphans(df: DataFrame, parent_field: str, parents: DataFrame, parent_key: str) -> DataFrame:
    """Rows with a non-null parent that does not exist."""
    valid = parents.select(F.col(parent_key).alias("_parent"))
    return df.filter(F.col(parent_field).isNotNull()).join(
        valid, F.col(parent_field) == F.col("_parent"), "left_anti")


def childless(parents: DataFrame, parent_key: str, children: DataFrame, child_field: str) -> DataFrame:
    used = children.select(F.col(child_field).alias("_used"))
    return parents.join(used, F.col(parent_key) == F.col("_used"), "left_anti")


def reference_summary(broken: DataFrame, rule_id: str, code: str = "BL-002") -> DataFrame:
    """The anomaly of one reference check."""
    return broken.groupBy("field").agg(
        F.count(F.lit(1)).alias("violations"),
        F.count_if(F.col("reason") == "null_fk").alias("null_keys"),
    ).select(
        F.lit(rule_id).alias("rule_id"), F.lit(code).alias("failure_code"), "field",
        F.lit("CRITICAL").alias("severity"), "violations", "null_keys",
        F.least(F.lit(100.0), 40.0 + F.col("violations") * 10.0).alias("severity_score"))


def foreign_key_candidates(columns: Sequence[str], references: Sequence[str]) -> list[tuple[str, str]]:
    """Columns named ``<x>_id`` paired with the first reference whose name starts with ``<x>``."""
    pairs = []
    for column in columns:
        if column.endswith("_id") and column != "id":
            stem = column[:-3].lower()
            match = next((r for r in references if r.lower().startswith(stem)), None)
            if match:
                pairs.append((column, match))
    return pairs


def inclusion(df: DataFrame, column: str, reference: DataFrame, ref_key: str, ref_name: str) -> DataFrame:
    """How much of a column's distinct values the reference covers.  Distinct first, join after."""
    values = df.select(F.col(column).cast("string").alias("v")).filter("v IS NOT NULL").distinct()
    known = reference.select(F.col(ref_key).cast("string").alias("r"), F.lit(1).alias("hit")).distinct()
    return values.join(known, F.col("v") == F.col("r"), "left").agg(
        F.count(F.lit(1)).alias("distinct_keys"), F.count("hit").alias("matched_keys"),
    ).select(
        F.lit(column).alias("column_name"), F.lit(ref_name).alias("reference"),
        "distinct_keys", "matched_keys",
        F.when(F.col("distinct_keys") > 0, F.col("matched_keys") / F.col("distinct_keys"))
        .otherwise(0.0).alias("coverage"))


def discover_foreign_keys(df: DataFrame, references: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Coverage of every column/reference pair the naming rule suggests."""
    found = [
        inclusion(df, column, *references[name], name)
        for column, name in foreign_key_candidates(df.columns, list(references))
    ]
    if not found:
        return df.sparkSession.createDataFrame(
            [], "column_name string, reference string, distinct_keys bigint, "
                "matched_keys bigint, coverage double")
    return reduce(DataFrame.unionByName, found)


def one_per_key(side: DataFrame, key: str) -> DataFrame:
    """A reference side that repeats no key, so that a join repeats no row: the greatest record stays.

    Use ``load_reference`` before where the order of loading decides.
    """
    rest = [c for c in side.columns if c != key]
    return side.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(*rest)).alias("_r")).select(key, "_r.*")


def lookup(df: DataFrame, field: str, reference: DataFrame, ref_key: str, active: Column,
           columns: Sequence[str]) -> DataFrame:
    """Each row with the reference columns, whether the key was found, and whether it is active."""
    side = one_per_key(reference.select(
        F.col(ref_key).cast("string").alias("_ref"), *columns,
        is_active(active).alias("_active"), F.lit(True).alias("_found")), "_ref")
    joined = df.join(side, F.col(field).cast("string") == F.col("_ref"), "left")
    return joined.select(
        *df.columns, *columns, F.coalesce("_found", F.lit(False)).alias("found"),
        F.coalesce("_active", F.lit(False)).alias("active"))


def cascade(df: DataFrame, levels: Sequence[tuple[str, DataFrame, str, Sequence[str]]]) -> DataFrame:
    """Follow references level by level; ``broken_at`` names the first that fails.

    A level is (key column so far, reference, its key, columns to carry on).  A missing level
    leaves the next key null, so later levels need no case of their own.
    """
    joined, tests = df, []
    for i, (field, reference, key, carried) in enumerate(levels):
        side = one_per_key(reference.select(F.col(key).alias(f"_key{i}"), *carried, F.lit(True).alias(f"_hit{i}")),
                           f"_key{i}")
        joined = joined.join(side, F.col(field) == F.col(f"_key{i}"), "left")
        tests.append(F.when(F.col(f"_hit{i}").isNull(), F.lit(field)))
    return joined.select(*df.columns, F.coalesce(*tests).alias("broken_at"))
