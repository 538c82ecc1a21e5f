"""Shards of near-equal bytes by recursive weighted medians (a k-d tree over metadata).

The unit that is placed is a group of equal texts, so copies share a shard.  A group that weighs
more than a small part of a shard is first dealt into salted parts, as it may not fit into one.
Every node of the tree is split along its widest dimension (extent relative to the whole table) at
the weighted median.  Medians come from histograms: each round counts the weight of up to 2048
buckets per node, and the next round looks into the bucket that holds the median, until that
bucket is light or cannot be divided.  Only the histograms of at most ``shards`` nodes reach the
driver.

Contract: a null text weighs one byte and counts as empty.  Metadata are compared whole, as places
among their distinct values; null is the empty text.  Texts of
any length are weighed whole.  Ties on a dimension are ordered by the hash of the text.  Repeated
rows get slots of their own.  An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tableward.functions.ordered import running_totals
from tableward.llm.common import cut_lineage

#: Bits of a dimension's value and of the tie-breaking hash in a sort key, and of one histogram.
VALUE_BITS, TIE_BITS, ROUND_BITS = 21, 34, 11
#: A group heavier than this part of a shard is dealt into salted parts.
LARGE_PART = 1 / 64
#: A histogram bucket this light, relative to its node, may stay whole.
TOLERANCE = 0.0005
#: Rows of one numbering task.
SLOT_ROWS = 100_000


def _ranked(rows: DataFrame, column: str) -> DataFrame:
    """``column`` replaced by the place of its value among the distinct ones, in byte order."""
    values = rows.select(column).distinct().withColumn("_one", F.lit(1).cast("long"))
    places = running_totals(values, [], column, ["_one"]).select(F.col(column).alias("_value"), F.col("cum__one").cast("double").alias("_place"))
    return rows.join(places, F.col(column) == F.col("_value")).withColumn(column, F.col("_place")).drop("_value", "_place")


def _sort_key(dims: list[str], bounds: dict[str, tuple[float, float]]) -> dict[str, Column]:
    top = (1 << VALUE_BITS) - 1
    tie = F.shiftrightunsigned(F.xxhash64("_unit", F.lit(7)), 64 - TIE_BITS)
    keys = {}
    for d in dims:
        lo, hi = bounds[d]
        value = F.floor((F.col(d) - F.lit(lo)) / F.lit((hi - lo) or 1.0) * F.lit(top)).cast("long")
        keys[d] = F.shiftleft(value, TIE_BITS) + tie
    return keys


def _median_cuts(units: DataFrame, nodes: dict[int, dict]) -> dict[int, int]:
    """For every node the key at which its share of the weight lies below."""
    bits = VALUE_BITS + TIE_BITS
    state = {n: {"low": 0, "shift": bits, "before": 0, "done": False} for n in nodes}
    while not all(s["done"] for s in state.values()):
        open_nodes = {n: s for n, s in state.items() if not s["done"]}
        for s in open_nodes.values():
            s["next"] = max(0, s["shift"] - ROUND_BITS)
        rule, inside = F.lit(None).cast("long"), F.lit(False)
        for n, s in open_nodes.items():
            here = ((F.col("_node") == n) & (F.col("_key") >= F.lit(s["low"]))
                    & (F.col("_key") < F.lit(s["low"] + (1 << s["shift"]))))
            rule = F.when(here, F.shiftright(F.col("_key") - F.lit(s["low"]), s["next"])).otherwise(rule)
            inside = inside | here
        counted = (units.filter(inside).groupBy("_node", rule.alias("_bucket"))
                   .agg(F.sum("_weight").alias("w")).collect())
        for n, s in open_nodes.items():
            wanted, below = nodes[n]["share"], s["before"]
            for bucket, w in sorted((r["_bucket"], r["w"]) for r in counted if r["_node"] == n):
                if below + w >= wanted:
                    low = s["low"] + (bucket << s["next"])
                    if s["next"] == 0 or w <= TOLERANCE * nodes[n]["weight"]:
                        # The nearer border of the bucket.
                        near = wanted - below <= below + w - wanted
                        s |= {"done": True, "cut": low if near else low + (1 << s["next"])}
                    else:
                        s |= {"low": low, "shift": s["next"], "before": below}
                    break
                below += w
            else:
                s |= {"done": True, "cut": s["low"] + (1 << s["shift"])}
    return {n: s["cut"] for n, s in state.items()}


def kd_tree_nodes(units: DataFrame, dims: list[str], shards: int) -> DataFrame:
    """``units`` (``_unit``, ``_weight`` and ``dims``) plus ``shard``."""
    found = units.agg(*[F.min(d).alias(f"lo_{d}") for d in dims], *[F.max(d).alias(f"hi_{d}") for d in dims]).first()
    bounds = {d: (found[f"lo_{d}"] or 0.0, found[f"hi_{d}"] or 0.0) for d in dims}
    keys = _sort_key(dims, bounds)
    node = F.lit(0)
    leaves = {0: shards}  # first shard of a node -> shards below it
    while any(k > 1 for k in leaves.values()):
        at = units.withColumn("_node", node)
        seen = {r["_node"]: r for r in at.groupBy("_node").agg(
            F.sum("_weight").alias("w"), *[F.min(d).alias(f"lo_{d}") for d in dims],
            *[F.max(d).alias(f"hi_{d}") for d in dims]).collect()}
        nodes = {}
        for n, k in leaves.items():
            if k > 1 and n in seen:
                widths = {d: (seen[n][f"hi_{d}"] - seen[n][f"lo_{d}"]) / ((bounds[d][1] - bounds[d][0]) or 1.0)
                          for d in dims}
                nodes[n] = {"dim": max(dims, key=lambda d: widths[d]), "weight": seen[n]["w"],
                            "share": seen[n]["w"] * (k // 2) / k}
        if not nodes:
            break
        key = F.lit(None).cast("long")
        for n, s in nodes.items():
            key = F.when(F.col("_node") == n, keys[s["dim"]]).otherwise(key)
        # Written, as the next rounds read it several times.
        placed = cut_lineage(at.withColumn("_key", key))
        cuts = _median_cuts(placed, nodes)
        step = F.col("_node")
        for n, cut in cuts.items():
            step = F.when((F.col("_node") == n) & (F.col("_key") >= F.lit(cut)), F.lit(n + leaves[n] // 2)).otherwise(step)
        units, node = placed.withColumn("_shard", step).drop("_node", "_key"), F.col("_shard")
        leaves = {n + off: part for n, k in leaves.items()
                  for off, part in ([(0, k // 2), (k // 2, k - k // 2)] if k > 1 else [(0, k)])}
    return units.withColumn("shard", node.cast("int")).drop("_shard")


def with_slots(df: DataFrame, order: list[str], rows: int) -> DataFrame:
    """``slot``, gapless from 0 within ``shard``.

    Rows are numbered in parts of a shard, and the parts' counts shift them.
    """
    parts = max(16, rows // SLOT_ROWS)
    dealt = df.withColumn("_part", F.pmod(F.xxhash64(*order), F.lit(parts)).cast("int"))
    counts = dealt.groupBy("shard", "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy("shard").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    shifts = counts.select("shard", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    inside = W.partitionBy("shard", "_part").orderBy(*order)
    return (dealt.withColumn("_rn", F.row_number().over(inside) - 1).join(shifts, ["shard", "_part"])
            .withColumn("slot", (F.col("_rn") + F.col("_shift")).cast("long")).drop("_rn", "_shift", "_part"))


def kd_shards(df: DataFrame, key: str, text: str, metadata: list[str], shards: int | None = None,
              target_bytes: int | None = None) -> DataFrame:
    """One row per row of ``df``: ``key``, ``size``, ``text_crc32``, ``law``, ``shard``, ``slot``.

    Either the number of shards or the bytes that a leaf should reach is given.
    """
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = cut_lineage(df.select(
        F.col(key).alias("_key_id"), (F.octet_length(whole) + 1).cast("long").alias("size"),
        F.crc32(whole.cast("binary")).alias("text_crc32"), F.xxhash64(whole).alias("_text"),
        *[F.coalesce(F.col(m).cast("string"), F.lit("")).alias(f"_m{i}") for i, m in enumerate(metadata)]))
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes")).first()
    weight = total["bytes"] or 0
    if shards is None:
        shards = max(1, -(-weight // target_bytes))
    limit = max(1, int(weight / shards * LARGE_PART))
    groups = rows.groupBy("_text").agg(F.sum("size").alias("_w"))
    # At most shards / LARGE_PART groups weigh this much.
    large = groups.filter(F.col("_w") > limit).select(
        "_text", F.ceil(F.col("_w") / F.lit(limit)).cast("long").alias("_parts"))
    for i in range(len(metadata)):
        rows = _ranked(rows, f"_m{i}")
    rows = rows.join(F.broadcast(large), "_text", "left").withColumn("_unit", F.when(
        F.col("_parts").isNotNull(), F.xxhash64("_text", F.pmod(F.xxhash64("_key_id", F.lit(3)), F.col("_parts")))
    ).otherwise(F.col("_text"))).drop("_parts")
    dims = ["_d_size", *[f"_d{i}" for i in range(len(metadata))]]
    units = rows.groupBy("_unit").agg(
        F.sum("size").alias("_weight"), F.log2(F.max("size").cast("double")).alias("_d_size"),
        *[F.min(f"_m{i}").alias(f"_d{i}") for i in range(len(metadata))])
    placed = kd_tree_nodes(cut_lineage(units), dims, shards).select("_unit", "shard")
    numbered = with_slots(cut_lineage(rows.join(placed, "_unit")), ["_key_id", "_unit"], total["n"])
    return numbered.select(F.col("_key_id").alias(key), "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
                           "slot")
