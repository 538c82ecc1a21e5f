"""Scores over anomalies: severity, batch, layer and tier health, and their history."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tableward.functions import severity as S
from tableward.functions.ordered import top_per_group
from tableward.functions.predicates import seconds_between
from tableward.model import CRITICAL, INFO, WARNING, layer_of, severity_name, severity_rank

# Health component -> (weight, failure codes that lower it).
COMPONENTS = {
    "completeness": (0.25, ("DV-002",)),
    "accuracy": (0.25, ("DV-003", "DV-004")),
    "consistency": (0.20, ("DV-005", "DV-006")),
    "integrity": (0.15, ("DV-007", "DV-008")),
    "timeliness": (0.15, ("DV-001",)),
}
# Points an anomaly takes off its component.
PENALTY = {CRITICAL: 30.0, WARNING: 15.0, INFO: 5.0}


def component_of(code: Column) -> Column:
    """Codes outside the list weigh on timeliness."""
    chain = F.when(F.lit(False), "")
    for name, (_, codes) in COMPONENTS.items():
        chain = chain.when(code.isin(*codes), name)
    return chain.otherwise("timeliness")


def severity_scores(anomalies: DataFrame, groups: Sequence[str], total: Column, as_of: Column) -> DataFrame:
    """Impact, frequency and recency of each kind of anomaly over its history.

    ``total`` is an aggregate expression for the records the affected ones came from.
    """
    facts = anomalies.groupBy(*groups).agg(
        F.sum("affected_count").alias("affected"), total.alias("total"),
        F.count(F.lit(1)).alias("occurrences"), F.min("detected_at").alias("_first"))
    pct = F.when(F.col("total") > 0, F.col("affected") / F.col("total") * 100)
    hours = seconds_between(as_of, F.col("_first")) / 3600.0
    score = S.weighted_severity(pct, F.col("occurrences"), hours)
    return facts.select(*groups, "affected", "occurrences", score.alias("score")).withColumn(
        "severity", S.level(F.col("score")))


def with_clean(anomalies: DataFrame, groups: Sequence[str], batches: DataFrame | None) -> DataFrame:
    """Findings marked ``_real``, and a row that is not for every batch of ``batches``, so that a
    batch without findings is a group too."""
    marked = anomalies.withColumn("_real", F.lit(True))
    if batches is None:
        return marked
    clean = batches.select(*groups).distinct().withColumn("_real", F.lit(False))
    return marked.unionByName(clean, allowMissingColumns=True)


def _penalty(total_records: Column) -> Column:
    base = F.lit(10.0)
    for name, points in PENALTY.items():
        base = F.when(F.col("severity") == name, points).otherwise(base)
    scaled = (total_records > 0) & (F.col("affected_count") > 0)
    share = F.try_divide(F.col("affected_count"), total_records)
    return F.when(scaled, base * F.least(F.lit(2.0), 1.0 + share)).otherwise(base)


def batch_health(anomalies: DataFrame, groups: Sequence[str], total_records: Column,
                 batches: DataFrame | None = None) -> DataFrame:
    """Five component scores and their weighted mean, from one aggregate.

    A penalty doubles at most, with the share of affected records.  Of ``batches`` every one has a
    row; without findings it scores 100.
    """
    penalty = _penalty(total_records)
    component = F.when(F.col("_real"), component_of(F.col("failure_code")))
    lost = with_clean(anomalies, groups, batches).groupBy(*groups).agg(
        *[F.sum(F.when(component == c, penalty)).alias(f"_{c}") for c in COMPONENTS],
        F.count_if("_real").alias("active_anomalies"))
    scores = lost.select(*groups, "active_anomalies", *[
        F.greatest(F.lit(0.0), 100.0 - F.coalesce(f"_{c}", F.lit(0.0))).alias(c) for c in COMPONENTS])
    overall = sum((F.col(c) * w for c, (w, _) in COMPONENTS.items()), F.lit(0.0))
    total = sum(w for w, _ in COMPONENTS.values())
    return scores.withColumn("overall_score", overall / total)


def status_label(score: Column) -> Column:
    return S.banded(score, S.STATUS)


def trend(current: Column, previous: Column) -> Column:
    delta = current - previous
    return F.when(delta > 1.0, "improving").when(delta < -1.0, "degrading").otherwise("stable")


LAYER_NAMES = {2: "schema", 3: "business", 4: "freshness", 5: "model", 6: "ethics"}
# Points per CRITICAL / WARNING / INFO where a layer is scored from anomalies alone.
LAYER_PENALTIES = {2: "schema", 3: "business", 4: "watcher", 5: "model", 6: "ethics"}


def layer_scores(anomalies: DataFrame, groups: Sequence[str], *more: Column,
                 batches: DataFrame | None = None) -> DataFrame:
    """A score per silver and gold layer; a layer without findings scores 100, and so does every
    layer of a batch of ``batches`` that has none.

    ``more`` aggregates join the same pass.
    """
    layer = F.when(F.col("_real"), layer_of(F.col("failure_code")))
    lost = []
    for number, name in LAYER_NAMES.items():
        points = dict(zip((CRITICAL, WARNING, INFO), S.PENALTIES[LAYER_PENALTIES[number]]))
        value = F.lit(0.0)
        for severity, p in points.items():
            value = F.when(F.col("severity") == severity, p).otherwise(value)
        lost.append(F.greatest(F.lit(0.0), 100.0 - F.coalesce(F.sum(F.when(layer == number, value)), F.lit(0.0))).alias(name))
    critical = F.col("severity") == CRITICAL
    return with_clean(anomalies, groups, batches).groupBy(*groups).agg(
        *lost, F.count_if(critical & layer.between(2, 4)).alias("silver_blocking"),
        F.count_if(critical & layer.between(5, 6)).alias("gold_blocking"), *more)


def tier_health(anomalies: DataFrame, scope: Sequence[str], ts: str, batches: DataFrame | None = None) -> DataFrame:
    """Silver and gold health as the minimum of their layers, with the trend per scope.

    ``batches`` (scope, ts) have a row each, with or without findings, and take part in the trend.

    The window runs over one row per scope and time, not over anomalies.
    """
    scores = layer_scores(anomalies, [*scope, ts], batches=batches)
    tiers = scores.select(
        *scope, ts, F.least("schema", "business", "freshness").alias("silver_score"), "silver_blocking",
        F.least("model", "ethics").alias("gold_score"), "gold_blocking")
    before = W.partitionBy(*scope).orderBy(ts)
    return tiers.select("*", *[
        trend(F.col(f"{x}_score"), F.lag(f"{x}_score").over(before)).alias(f"{x}_trend") for x in ("silver", "gold")])


def batch_results(anomalies: DataFrame, groups: Sequence[str], batches: DataFrame | None = None) -> DataFrame:
    """Passed without CRITICAL findings, blocked by blocking ones; ``batches`` have a row each.

    The silver result is the mean of its layers, unlike silver health, which is their minimum.
    """
    critical = F.col("severity") == CRITICAL
    scores = layer_scores(
        anomalies, groups, (~F.coalesce(F.bool_or(critical), F.lit(False))).alias("passed"),
        F.coalesce(F.bool_or(critical & (layer_of(F.col("failure_code")) == 2)), F.lit(False)).alias("blocked"),
        F.count_if("_real").alias("anomalies"), batches=batches)
    mean = (F.col("schema") + F.col("business") + F.col("freshness")) / 3.0
    lowest = F.least("schema", "business", "freshness")
    return scores.select(
        *groups, "passed", "blocked", "anomalies", mean.alias("silver_overall"), lowest.alias("silver_health"),
        F.least("model", "ethics").alias("gold_overall"), status_label(lowest).alias("status_label"))


def recent_history(history: DataFrame, scope: Sequence[str], ts: str, score: str, as_of: Column,
                   hours: int = 168, keep: int = 100) -> DataFrame:
    """The last ``keep`` scores per scope, ``hours`` back, with the step from the one before.

    The top-k is pruned before its shuffle; the window then sees at most ``keep`` rows a scope.
    """
    window = history.filter((F.col(ts) >= as_of - F.make_dt_interval(F.lit(0), F.lit(hours))) & (F.col(ts) <= as_of))
    kept = top_per_group(window, list(scope), [F.col(ts).desc(), F.col(score).desc()], keep)
    order = W.partitionBy(*scope).orderBy(ts, score)
    previous = F.lag(score).over(order)
    return kept.select(*scope, ts, score, (F.col(score) - previous).alias("delta"),
                       trend(F.col(score), previous).alias("trend"))


def anomaly_counts(anomalies: DataFrame) -> DataFrame:
    """Counts by severity, batch, code, layer and in total, in one pass over the anomalies."""
    tagged = anomalies.select("severity", "batch_id", "failure_code",
                              layer_of(F.col("failure_code")).cast("string").alias("layer"))
    names = ["severity", "batch_id", "failure_code", "layer"]
    sets = tagged.groupingSets([[n] for n in names] + [[]], *names).agg(
        F.count(F.lit(1)).alias("n"), F.grouping_id(*names).alias("_g"))
    scope = F.when(F.col("_g") == 15, "total")
    value = F.when(F.col("_g") == 15, "*")
    for i, n in enumerate(names):
        mask = 15 - (1 << (len(names) - 1 - i))
        scope, value = scope.when(F.col("_g") == mask, n), value.when(F.col("_g") == mask, F.col(n))
    return sets.select(scope.alias("scope"), value.alias("value"), "n")


def column_breakdown(anomalies: DataFrame) -> DataFrame:
    """Issues, affected rows and worst severity per field."""
    return anomalies.select(F.explode("affected_fields").alias("field"), "affected_count", "severity").groupBy("field").agg(
        F.count(F.lit(1)).alias("issues"), F.sum("affected_count").alias("rows"),
        severity_name(F.max(severity_rank(F.col("severity")))).alias("worst"))


def layer_health(anomalies: DataFrame) -> DataFrame:
    """One row per layer with its score and counts, and the overall minimum on each; one aggregate."""
    bronze = F.col("_real") & (layer_of(F.col("failure_code")) == 1)
    component = F.when(bronze, component_of(F.col("failure_code")))
    lost = [F.sum(F.when(component == c, _penalty(F.lit(0)))).alias(f"_{c}") for c in COMPONENTS]
    wide = layer_scores(anomalies, [], *lost)
    score = sum((F.greatest(F.lit(0.0), 100.0 - F.coalesce(f"_{c}", F.lit(0.0))) * w for c, (w, _) in COMPONENTS.items()), F.lit(0.0))
    scores = {1: ("bronze", score / sum(w for w, _ in COMPONENTS.values()))} | {k: (v, F.col(v)) for k, v in LAYER_NAMES.items()}
    lowest = F.least(*[x for _, x in scores.values()])
    return wide.select(F.inline(F.array(*[
        F.struct(F.lit(k).alias("layer"), F.lit(name).alias("name"), x.alias("score"), lowest.alias("overall"))
        for k, (name, x) in scores.items()])))
