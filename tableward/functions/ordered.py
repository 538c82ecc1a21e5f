"""Order-dependent helpers that never put one key's rows into one task.

A window over a key holds all rows of that key in one task.  Keys here may own a large share of
the table, so neighbours and running sums are computed on slices of a key, and only one row per
slice takes part in the step across slices.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tableward.session import cut_lineage


def null_safe(left: DataFrame, right: DataFrame, pairs) -> Column:
    return reduce(lambda a, b: a & b, [left[a].eqNullSafe(right[b]) for a, b in pairs])


def with_neighbour(df: DataFrame, keys: list[str], order: list[str], columns: dict[str, str],
                   following: bool = False) -> DataFrame:
    """Add, per key, the value that ``columns`` had one row earlier (or later) in ``order``.

    ``columns`` maps new names to source columns.  Rows are range-partitioned by key and order, so
    a key with many rows spreads over many tasks.  The row at the edge of a part takes its
    neighbour from the nearest part of the key: one row per key and part is handed on, and stands
    in as a first (or last) row that is dropped again.  The checkpoint keeps the parts the same
    for both uses.
    """
    step = F.lead if following else F.lag
    payload = F.struct(*[F.col(c).alias(n) for n, c in columns.items()])
    ranged = cut_lineage(
        df.repartitionByRange(*[F.col(c) for c in [*keys, *order]])
        .withColumns({"_part": F.spark_partition_id(), "_own": payload, "_real": F.lit(True)}))
    sort = F.struct(*order)
    edges = ranged.groupBy(*keys, "_part").agg((F.min_by if following else F.max_by)("_own", sort).alias("_own"))
    handed = edges.select(
        *keys, "_part", step("_own").over(W.partitionBy(*keys).orderBy("_part")).alias("_own"), F.lit(False).alias("_real")
    ).filter("_own IS NOT NULL")
    inside = W.partitionBy(*keys, "_part").orderBy(
        F.col("_real").desc() if following else F.col("_real").asc(), *[F.col(c) for c in order])
    near = ranged.unionByName(handed, allowMissingColumns=True).withColumn("_near", step("_own").over(inside))
    return near.filter("_real").select(*df.columns, *[F.col("_near")[n].alias(n) for n in columns])


def running_totals(counts: DataFrame, groups: list[str], value: str, weights: list[str]) -> DataFrame:
    """Running sums ``cum_*`` (inclusive) and totals ``all_*`` of ``weights`` along ``value``
    within ``groups``.

    ``counts`` has one row per (groups, value).  Rows are range-partitioned by the ordering
    itself, so a group of any size spreads over many tasks; sums are taken inside each partition
    and shifted by the totals of the partitions before it.  The partition id must stay the same
    for both uses, hence the checkpoint.
    """
    ranged = cut_lineage(
        counts.repartitionByRange(*[F.col(c) for c in [*groups, value]])
        .withColumn("_part", F.spark_partition_id())
    )
    inside = W.partitionBy(*groups, "_part").orderBy(value).rowsBetween(W.unboundedPreceding, 0)
    local = ranged.select("*", *[F.sum(w).over(inside).alias(f"_in_{w}") for w in weights])
    totals = ranged.groupBy(*groups, "_part").agg(*[F.sum(w).alias(f"_sum_{w}") for w in weights])
    before = W.partitionBy(*groups).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    shifts = totals.select(
        *groups, "_part",
        *[F.coalesce(F.sum(f"_sum_{w}").over(before), F.lit(0)).alias(f"_off_{w}") for w in weights],
        *[F.sum(f"_sum_{w}").over(W.partitionBy(*groups)).alias(f"all_{w}") for w in weights],
    )
    # A null group is a group of its own.
    shifts = shifts.select(*[F.col(g).alias(f"_g_{g}") for g in groups], F.col("_part").alias("_g_part"),
                           *[c for c in shifts.columns if c not in (*groups, "_part")])
    same = null_safe(local, shifts, [(g, f"_g_{g}") for g in groups]) if groups else F.lit(True)
    return local.join(shifts, same & (F.col("_part") == F.col("_g_part"))).select(
        *groups, value, *weights,
        *[(F.col(f"_in_{w}") + F.col(f"_off_{w}")).alias(f"cum_{w}") for w in weights],
        *[f"all_{w}" for w in weights],
    )


def exact_percentiles(df: DataFrame, groups: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Per group the least value that each share of the rows does not exceed, with ``runs`` and
    ``mean_seconds``.

    Ranks are running sums over ranges of (group, value), so a group of any size is ranked by many
    tasks.  Null values do not count; a group of null values alone has nulls.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count(F.lit(1)).alias("n"))
    ranked = running_totals(counts, groups, value, ["n"])
    reached = lambda q: F.col("cum_n") >= F.greatest(F.ceil(F.lit(q) * F.col("all_n")), F.lit(1))
    found = ranked.groupBy(*[F.col(g).alias(f"_p_{g}") for g in groups]).agg(
        *[F.min(F.when(reached(q), F.col(value))).alias(n) for n, q in shares.items()])
    sizes = df.groupBy(*groups).agg(F.count(F.lit(1)).alias("runs"), F.avg(value).alias("mean_seconds"))
    return sizes.join(found, null_safe(sizes, found, [(g, f"_p_{g}") for g in groups]), "left").select(
        *groups, "runs", "mean_seconds", *shares)


def top_per_group(df: DataFrame, groups: list[str], order: list[Column], k: int) -> DataFrame:
    """At most ``k`` rows per group.  The planner prunes to ``k`` before the shuffle."""
    window = W.partitionBy(*groups).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(window)).filter(F.col("_rank") <= k).drop("_rank")
