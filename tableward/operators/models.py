"""Model health (layer 5) from a prediction log split into a baseline and a current period."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableward.functions.ordered import exact_percentiles
from tableward.model import CRITICAL, INFO, WARNING


def _verdict(df: DataFrame, code: str, critical: Column, warning: Column, scores, blocking: bool,
             *columns) -> DataFrame:
    critical, warning = (F.coalesce(c, F.lit(False)) for c in (critical, warning))
    return df.select(
        *columns, F.lit(code).alias("failure_code"),
        F.when(critical, CRITICAL).when(warning, WARNING).alias("severity"),
        (critical & F.lit(blocking)).alias("blocking"),
        F.when(critical, scores[0]).when(warning, scores[1]).otherwise(100.0).alias("score"))


def staleness(registry: DataFrame, model: str, trained_at: str, as_of: Column,
              maximum: int = 90, warning: int = 60) -> DataFrame:
    """Days since the last training (ML-003)."""
    ages = registry.groupBy(model).agg(F.max(trained_at).alias("_t")).select(
        model, F.extract(F.lit("DAY"), as_of - F.col("_t")).cast("int").alias("age_days"))
    age = F.col("age_days")
    return _verdict(ages, "ML-003", age >= maximum, age >= warning, (50.0, 75.0), False, model, "age_days")


def period_means(log: DataFrame, model: str, period: str, measures: Sequence[str]) -> DataFrame:
    """Means per model of each measure in both periods, from one aggregate."""
    base, cur = F.col(period) == "baseline", F.col(period) == "current"
    return log.groupBy(model).agg(*[
        F.avg(F.when(when, F.col(m).cast("double"))).alias(f"{m}_{name}")
        for m in measures for name, when in (("base", base), ("cur", cur))])


def confidence_drop(means: DataFrame, model: str, measure: str) -> DataFrame:
    """Mean confidence falls by .1 or .2 (ML-004)."""
    df = means.withColumn("drop", F.col(f"{measure}_base") - F.col(f"{measure}_cur"))
    drop = F.col("drop")
    return _verdict(df, "ML-004", drop >= 0.2, drop >= 0.1, (40.0, 70.0), True, model, "drop")


def latency_spike(means: DataFrame, model: str, measure: str, limit_ms: float = 1000.0) -> DataFrame:
    """Mean latency at 2 or 5 times the baseline, or beyond the limit (ML-005)."""
    base, cur = F.col(f"{measure}_base"), F.col(f"{measure}_cur")
    df = means.withColumn("ratio", F.when(base > 0, cur / base).otherwise(1.0)).withColumn("current_ms", cur)
    ratio = F.col("ratio")
    return _verdict(df, "ML-005", (ratio >= 5.0) | (cur >= limit_ms), ratio >= 2.0, (30.0, 65.0), True,
                    model, "ratio", "current_ms")


def latency_percentiles(log: DataFrame, model: str, period: str, latency: str,
                        probabilities=(0.5, 0.95, 0.99)) -> DataFrame:
    """Exact latency percentiles per model and period: the least value that a share does not exceed."""
    shares = {f"p{int(q * 100)}": q for q in probabilities}
    return exact_percentiles(log, [model, period], latency, shares).select(model, period, *shares)


def error_rate(means: DataFrame, model: str, measure: str) -> DataFrame:
    """Error share up by .05 or .1, or at .2 (ML-006)."""
    cur = F.col(f"{measure}_cur")
    df = means.withColumn("increase", cur - F.col(f"{measure}_base")).withColumn("current_rate", cur)
    rise = F.col("increase")
    return _verdict(df, "ML-006", (rise >= 0.1) | (cur >= 0.2), rise >= 0.05, (25.0, 60.0), True,
                    model, "increase", "current_rate")


def compatibility(expected: DataFrame, actual: DataFrame, model: str) -> DataFrame:
    """Expected against actual features, as rows (model, feature, type) (ML-007)."""
    joined = expected.select(model, "feature", F.col("type").alias("want")).join(
        actual.select(model, "feature", F.col("type").alias("have")), [model, "feature"], "full_outer")
    missing, extra = F.col("have").isNull(), F.col("want").isNull()
    counts = joined.groupBy(model).agg(
        F.count_if(missing).alias("missing"), F.count_if(extra).alias("extra"),
        F.count_if(F.col("want") != F.col("have")).alias("mismatched"))
    return _verdict(counts, "ML-007", F.col("missing") > 0, F.col("mismatched") > 0, (20.0, 60.0), True,
                    model, "missing", "extra", "mismatched")


def retraining(signals: DataFrame, model: str, performance: str, flags: Sequence[str],
               threshold: float = 0.7) -> DataFrame:
    """How many signals ask for retraining (ML-008): one INFO, two WARNING, more CRITICAL.

    ``flags`` name boolean columns; low performance is a signal of its own.
    """
    raised = F.array_compact(F.array(
        F.when(F.col(performance) < threshold, F.lit("low_performance")),
        *[F.when(F.coalesce(F.col(f), F.lit(False)), F.lit(f)) for f in flags]))
    df = signals.withColumn("_raised", raised)
    n = F.size("_raised")
    return df.select(
        model, F.array_join("_raised", ",").alias("signals"), n.alias("signal_count"),
        F.lit("ML-008").alias("failure_code"),
        F.when(n >= 3, CRITICAL).when(n == 2, WARNING).when(n == 1, INFO).alias("severity"),
        F.when(n >= 3, 30.0).when(n == 2, 55.0).when(n == 1, 75.0).otherwise(100.0).alias("score"))
