"""Which columns hold only values of another column, over whole sets of tables at once."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableward.operators.sketches import short_text, value_text

#: Values are compared within one of these kinds only.
KINDS: tuple[tuple[str, tuple[type, ...]], ...] = (
    ("whole", (T.ByteType, T.ShortType, T.IntegerType, T.LongType)),
    ("fraction", (T.FloatType, T.DoubleType)),
    ("decimal", (T.DecimalType,)),
    ("text", (T.StringType, T.CharType, T.VarcharType)),
    ("time", (T.TimestampType, T.TimestampNTZType)),
    ("date", (T.DateType,)),
    ("boolean", (T.BooleanType,)),
    ("binary", (T.BinaryType,)),
)


def kind_of(data_type: T.DataType) -> str | None:
    """The kind of a column; nested columns have none and take no part."""
    if isinstance(data_type, T.DecimalType):
        return f"decimal{data_type.scale}"  # equal numbers of different scale are different texts
    return next((name for name, types in KINDS if isinstance(data_type, types)), None)


def column_values(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(kind, value, column) of every filled cell, one scan a table; columns are named ``table.column``."""
    parts = []
    for name, df in tables.items():
        cells: list[Column] = [
            F.struct(F.lit(kind_of(f.dataType)).alias("kind"), short_text(value_text(df, f.name)).alias("value"),
                     F.lit(f"{name}.{f.name}").alias("column"))
            for f in df.schema.fields if kind_of(f.dataType)]
        if cells:
            parts.append(df.select(F.inline(F.array(*cells))).filter("value IS NOT NULL"))
    if not parts:
        raise ValueError("no table has a column whose values can be compared")
    return reduce(DataFrame.unionByName, parts)


def shared_columns(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(columns, values): how many distinct values occur in exactly this set of columns.

    The only shuffle of data is by (kind, value).  Each task first unites the columns of a value it has
    seen, so that a value in a third of all cells is one short list a task, never longer than there are columns.
    """
    sets = column_values(tables).groupBy("kind", "value").agg(F.collect_set("column").alias("columns"))
    return sets.groupBy(F.array_sort("columns").alias("columns")).agg(F.count(F.lit(1)).alias("values"))


def inclusions(tables: Mapping[str, DataFrame], least: float = 1.0) -> DataFrame:
    """Pairs of columns where at least the share ``least`` of the distinct values of ``column_name`` occur in
    ``reference``: (column_name, reference, distinct_values, matched_values, coverage, reference_values).

    No name rule and no scan per pair: pairs come from the sets of columns that share values, so pairs without a
    common value cost nothing.  Columns without values include nothing and are in nothing.  Empty tables give no rows.
    """
    if not 0 < least <= 1:
        raise ValueError(f"a share over 0 and up to 1, not {least}")
    sets = shared_columns(tables)
    each = sets.select(F.explode("columns").alias("column_name"), "columns", "values")
    both = each.select("column_name", F.explode("columns").alias("reference"), "values").groupBy(
        "column_name", "reference").agg(F.sum("values").alias("matched_values"))
    own = both.filter("column_name = reference").select(F.col("column_name").alias("_c"), F.col("matched_values").alias("_n"))
    sized = both.filter("column_name <> reference").join(
        own.select(F.col("_c").alias("column_name"), F.col("_n").alias("distinct_values")), "column_name").join(
        own.select(F.col("_c").alias("reference"), F.col("_n").alias("reference_values")), "reference")
    coverage = F.col("matched_values") / F.col("distinct_values")
    return sized.withColumn("coverage", coverage).filter(F.col("coverage") >= least).select(
        "column_name", "reference", "distinct_values", "matched_values", "coverage", "reference_values")


def key_candidates(found: DataFrame, sizes: DataFrame) -> DataFrame:
    """Inclusions whose reference repeats no value, as foreign keys can point there.

    ``sizes``: (column_name, filled) of the columns, as ``distinct_sketches`` gives them per table.
    """
    unique = sizes.select(F.col("column_name").alias("_c"), F.col("filled").alias("_filled"))
    return found.join(unique, found["reference"] == unique["_c"]).filter(
        F.col("_filled") == F.col("reference_values")).select(*found.columns)
