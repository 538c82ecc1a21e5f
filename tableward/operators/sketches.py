"""Profiles kept as sketches: distinct values per column and day, quantiles per model and day.

A sketch is a few KB whatever it has seen, and sketches of parts unite into the sketch of the whole.
A month is then read from thirty small rows a group instead of from its rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableward.operators.bronze import finite


def distinct_error(precision: int, deviations: float = 3.0) -> float:
    """Relative error of a distinct count that ``deviations`` standard deviations allow."""
    return deviations * 1.04 / 2 ** (precision / 2)


def rank_error(k: int) -> float:
    """How far the rank of a quantile may be off, at 99 % confidence (published bound of the sketch)."""
    return 2.296 / k ** 0.9723


def value_text(df: DataFrame, column: str) -> Column:
    """A value as text that is equal where values are equal; null stays null.

    Both zeros are one value.  The mark in front keeps the empty text, which sketches skip.
    """
    kind, value = df.schema[column].dataType, F.col(f"`{column}`")
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        value = F.when(value == 0, F.lit(0).cast(kind)).otherwise(value)
    if isinstance(kind, (T.ArrayType, T.StructType)):
        return F.when(value.isNotNull(), F.concat(F.lit("="), F.to_json(F.struct(value))))
    if isinstance(kind, T.BinaryType):
        return F.concat(F.lit("="), F.hex(value))
    return F.concat(F.lit("="), value.cast("string"))


def distinct_sketches(df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), precision: int = 12) -> DataFrame:
    """Per group and column: (rows, filled, sketch of its values).

    One aggregate over one scan; a task sends one sketch (at most 2 ** precision bytes) per group and
    column.  Nulls are counted in ``rows`` only.  A column without values has the sketch of nothing.
    An empty table has no rows here unless there is no group: then every column has one row of zeros.
    """
    wide = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.count(F.col(f"`{c}`")).alias(f"_n{i}") for i, c in enumerate(columns)],
        *[F.hll_sketch_agg(value_text(df, c), precision).alias(f"_s{i}") for i, c in enumerate(columns)])
    parts = [F.struct(F.lit(c).alias("field"), F.col("_rows").alias("rows"), F.col(f"_n{i}").alias("filled"),
                      F.col(f"_s{i}").alias("sketch")) for i, c in enumerate(columns)]
    return wide.select(*by, F.inline(F.array(*parts)))


def unite_distinct(stored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Sketches of parts as sketches of wholes, per column and what ``by`` keeps apart.

    Sketches of one store share a precision; others are refused by the aggregate.
    """
    return stored.groupBy(*by, "field").agg(
        F.sum("rows").alias("rows"), F.sum("filled").alias("filled"), F.hll_union_agg("sketch").alias("sketch"))


def distinct_counts(stored: DataFrame) -> DataFrame:
    """What sketches say: distinct values, their share of the filled rows, and the share of blank rows."""
    rest = [c for c in stored.columns if c != "sketch"]
    counted = stored.select(*rest, F.hll_sketch_estimate("sketch").alias("distinct_values"))
    return counted.select(
        "*", F.when(F.col("filled") > 0, F.least(F.lit(1.0), F.col("distinct_values") / F.col("filled"))).alias("distinct_share"),
        F.when(F.col("rows") > 0, 1 - F.col("filled") / F.col("rows")).alias("null_share"))


def exact_distinct(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Distinct values per group and column without error: one shuffle of (group, column, value).

    Values are compared as in the sketches, and long ones travel as a digest.
    """
    pairs = F.array(*[F.struct(F.lit(c).alias("field"), short_text(value_text(df, c)).alias("_v")) for c in columns])
    values = df.select(*by, F.inline(pairs)).filter("_v IS NOT NULL").distinct()
    return values.groupBy(*by, "field").agg(F.count(F.lit(1)).alias("distinct_values"))


def short_text(value: Column) -> Column:
    """Texts of over 64 characters as a digest of 65, so that no short one equals it."""
    return F.when(F.length(value) > 64, F.concat(F.lit("#"), F.sha2(value, 256))).otherwise(value)


def quantile_sketches(df: DataFrame, value: str, by: Sequence[str] = (), k: int = 200) -> DataFrame:
    """Per group: (n, least, greatest, sketch) of the finite values; groups without any have null sketches."""
    number = finite(F.col(f"`{value}`"))
    return df.select(*by, number.alias("_v")).groupBy(*by).agg(
        F.count("_v").alias("n"), F.min("_v").alias("least"), F.max("_v").alias("greatest"),
        F.kll_sketch_agg_double("_v", k).alias("sketch")).withColumn("sketch", F.when(F.col("n") > 0, F.col("sketch")))


def unite_quantiles(stored: DataFrame, by: Sequence[str] = (), k: int = 200) -> DataFrame:
    """Sketches of parts (days) as sketches of wholes (months).  Groups without values keep a null sketch."""
    return stored.groupBy(*by).agg(
        F.sum("n").alias("n"), F.min("least").alias("least"), F.max("greatest").alias("greatest"),
        F.kll_merge_agg_double("sketch", k).alias("sketch")).withColumn("sketch", F.when(F.col("n") > 0, F.col("sketch")))


def read_quantiles(stored: DataFrame, shares: Mapping[str, float]) -> DataFrame:
    """One column per share; null where a group has no values.  0 and 1 are the exact ends."""
    rest = [c for c in stored.columns if c != "sketch"]

    def at(share: float) -> Column:
        if share in (0.0, 1.0):
            return F.col("least" if share == 0.0 else "greatest")
        return F.when(F.col("sketch").isNotNull(), F.kll_sketch_get_quantile_double("sketch", F.lit(float(share))))

    return stored.select(*rest, *[at(share).alias(name) for name, share in shares.items()])


def share_above(stored: DataFrame, limit: float) -> DataFrame:
    """The share of values beyond a limit (such as a latency objective) from sketches alone, as ``above``."""
    rest = [c for c in stored.columns if c != "sketch"]
    rank = F.kll_sketch_get_rank_double("sketch", F.lit(float(limit)))
    return stored.select(*rest, F.when(F.col("sketch").isNotNull(), 1 - rank).alias("above"))


def quantile_ranks(df: DataFrame, value: str, by: Sequence[str], read: DataFrame, shares: Mapping[str, float]) -> DataFrame:
    """The true ranks of read quantiles, to judge a store by its rows: per group and share
    (``quantile``, ``below``, ``upto``), the shares of finite values under and up to it.

    One aggregate over the rows; ``read`` is one row a group.
    """
    # Without a group the one reading is met by a key that all rows have.
    own = read.select(*[F.col(c).alias(f"_g_{c}") for c in by], *[F.col(c).alias(f"_q_{c}") for c in shares], F.lit(1).alias("_g__all"))
    rows = df.select(*by, finite(F.col(f"`{value}`")).alias("_v"), F.lit(1).alias("_all")).filter("_v IS NOT NULL")
    met = [rows[c].eqNullSafe(own[f"_g_{c}"]) for c in (*by, *(() if by else ("_all",)))]
    joined = rows.join(own if by else F.broadcast(own), met)
    counted = joined.groupBy(*by).agg(
        F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col("_v") < F.col(f"_q_{s}")).alias(f"_b_{s}") for s in shares],
        *[F.count_if(F.col("_v") <= F.col(f"_q_{s}")).alias(f"_u_{s}") for s in shares])
    parts = [F.struct(F.lit(s).alias("quantile"), (F.col(f"_b_{s}") / F.col("_n")).alias("below"),
                      (F.col(f"_u_{s}") / F.col("_n")).alias("upto")) for s in shares]
    return counted.select(*by, F.inline(F.array(*parts)))
