"""Distributions: baselines, and distances between a baseline and a current sample.

Every function works on any number of groups at once.  Inputs are long: group columns, a value,
and a flag that is true on current rows.  Rows are reduced to counts per bin or per distinct
value before anything is ordered or joined.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableward.functions.ordered import null_safe, running_totals
from tableward.model import CRITICAL, INFO, WARNING
from tableward.session import cut_lineage

# Floor of a share in baseline comparison, and in histogram comparison.
BASELINE_FLOOR = 1e-4
HISTOGRAM_FLOOR = 1e-10


def _ones() -> Column:
    return F.count(F.lit(1))


# Baselines of one column ----------------------------------------------------------------------

def numeric_baseline(df: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """Equal-frequency bins by exact rank: bin number, edges, share.

    Equal values share the rank of the first of them and so fall into one bin.  Fewer rows than
    bins give no bins.
    """
    counts = (
        df.select(F.col(column).cast("double").alias("v")).filter("v IS NOT NULL")
        .groupBy("v").agg(_ones().alias("n"))
    )
    ranked = running_totals(counts, [], "v", ["n"])
    total = F.col("all_n")
    size = F.floor(total / bins)
    number = F.least(F.floor((F.col("cum_n") - F.col("n")) / size), F.lit(bins - 1)).cast("int")
    placed = ranked.filter(total >= bins).select(number.alias("bin_no"), "v", "n", total.alias("t"))
    edges = placed.groupBy("bin_no").agg(
        F.min("v").alias("low"), F.max("v").alias("high"), F.sum("n").alias("n"),
        F.max("t").alias("t"),
    ).select("bin_no", "low", "high", "n", (F.col("n") / F.col("t")).alias("freq"))
    # Written, so that users of the baseline do not build it again.
    return cut_lineage(edges)


def categorical_baseline(df: DataFrame, column: str) -> DataFrame:
    counts = df.filter(F.col(column).isNotNull()).groupBy(
        F.col(column).cast("string").alias("key")).agg(_ones().alias("n"))
    total = counts.agg(F.sum("n").alias("t")).scalar()
    return counts.select("key", "n", (F.col("n") / total).alias("freq"))


def assign_bins(df: DataFrame, column: str, baseline: DataFrame) -> DataFrame:
    """Counts per baseline bin: the first bin whose upper edge reaches the value, else the last.

    The few edges become constants of one expression.
    """
    edges = [(r["high"], r["bin_no"]) for r in baseline.select("high", "bin_no").collect()]
    if not edges:
        return df.sparkSession.createDataFrame([], "bin_no int, n bigint")
    edges.sort()
    value = F.col(column).cast("double")
    number = F.lit(edges[-1][1])
    for high, bin_no in reversed(edges):
        number = F.when(value <= high, bin_no).otherwise(number)
    return df.filter(value.isNotNull()).groupBy(number.alias("bin_no")).agg(_ones().alias("n"))


def updated_baseline(baseline: DataFrame, df: DataFrame, column: str) -> DataFrame:
    """Same edges, counts of old and new rows added up."""
    added = assign_bins(df, column, baseline)
    merged = baseline.select("bin_no", "n").unionByName(added).groupBy("bin_no").agg(F.sum("n").alias("n"))
    total = merged.agg(F.sum("n").alias("t")).scalar()
    return merged.join(baseline.select("bin_no", "low", "high"), "bin_no").select(
        "bin_no", "low", "high", "n", (F.col("n") / total).alias("freq"))


def baseline_psi(expected: DataFrame, current: DataFrame, key: str) -> DataFrame:
    """Stability index between two frequency tables aligned on ``key``; one row."""
    total = current.agg(F.sum("n").alias("t")).scalar()
    shares = current.select(key, (F.col("n") / total).alias("actual"))
    floor = F.lit(BASELINE_FLOOR)
    a = F.greatest(F.coalesce("actual", floor), floor)
    e = F.greatest(F.coalesce("freq", floor), floor)
    return (
        expected.select(key, "freq").join(shares, key, "full_outer")
        .agg(F.coalesce(F.sum((a - e) * F.ln(a / e)), F.lit(0.0)).alias("psi"))
        .select("psi", shift_severity(F.col("psi")).alias("severity"),
                F.least(F.lit(100), F.floor(F.col("psi") * 200)).cast("double").alias("severity_score"))
    )


def shift_severity(psi: Column) -> Column:
    return F.when(psi >= 0.25, CRITICAL).when(psi >= 0.1, WARNING)


def null_rate_shift(baseline: DataFrame, current: DataFrame, columns: Sequence[str],
                    limit: float = 0.1) -> DataFrame:
    """Change of the null share per column; one aggregate over each side."""
    rates = lambda df: df.agg(F.struct(*[
        F.avg(F.col(c).isNull().cast("double")).alias(c) for c in columns]).alias("r")).scalar()
    before, after = rates(baseline), rates(current)
    rows = [F.struct(F.lit(c).alias("field"), before[c].alias("baseline_rate"),
                     after[c].alias("current_rate"), F.abs(after[c] - before[c]).alias("change"),
                     (F.abs(after[c] - before[c]) > limit).alias("shifted")) for c in columns]
    return baseline.sparkSession.range(1).select(F.inline(F.array(*rows)))


# Histograms over many groups ------------------------------------------------------------------

def _attach(df: DataFrame, stats: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Join per-group statistics to rows; once written their size is known to the planner, which
    broadcasts few groups and splits hot ones of many."""
    side = stats.select(*[F.col(g).alias(f"_g_{g}") for g in groups],
                        *[c for c in stats.columns if c not in groups])
    side = cut_lineage(side)
    return df.join(side, null_safe(df, side, [(g, f"_g_{g}") for g in groups])).drop(
        *[f"_g_{g}" for g in groups])


def value_counts(df: DataFrame, groups: Sequence[str], value: str, current: str) -> DataFrame:
    """Rows of both samples per distinct value: (groups, value, b, c), null values left out.

    All distances below can be taken from this table, so a log is read once for all of them.
    """
    return df.filter(F.col(value).isNotNull()).groupBy(*groups, value).agg(
        F.count_if(~F.col(current)).alias("b"), F.count_if(F.col(current)).alias("c"))


def _counted(df: DataFrame, groups: Sequence[str], value: str, current: str | None) -> DataFrame:
    """``df`` itself where it holds counts already (no ``current``)."""
    return df if current is None else value_counts(df, groups, value, current)


def histogram(df: DataFrame, groups: Sequence[str], value: str, current: str | None, bins: int = 10,
              pooled: bool = False) -> DataFrame:
    """Counts per (group, bin) of both samples, in equal-width bins.

    Bins span the baseline, or both samples when ``pooled``; values outside count towards the
    sample size only.  Small samples get as many bins as the smaller one has rows; a sample with
    a single value spans half a unit to each side.
    """
    rows = _counted(df, groups, value, current)
    inside = F.lit(True) if pooled else F.col("b") > 0
    stats = rows.groupBy(*groups).agg(
        F.min(F.when(inside, F.col(value))).alias("_lo"), F.max(F.when(inside, F.col(value))).alias("_hi"),
        F.sum("b").alias("n_base"), F.sum("c").alias("n_cur"),
    ).withColumn("_k", F.least("n_base", "n_cur", F.lit(bins))).filter("_k >= 2")
    point = F.col("_lo") == F.col("_hi")
    stats = stats.withColumns({
        "_lo": F.when(point, F.col("_lo") - 0.5).otherwise(F.col("_lo")),
        "_hi": F.when(point, F.col("_hi") + 0.5).otherwise(F.col("_hi"))})
    v, lo, hi, k = F.col(value), F.col("_lo"), F.col("_hi"), F.col("_k")
    position = F.floor((v - lo) / (hi - lo) * k)
    number = F.when((v >= lo) & (v <= hi), F.least(position, k - 1)).otherwise(-1)
    return _attach(rows, stats, groups).groupBy(*groups, number.cast("int").alias("bin")).agg(
        F.sum("b").alias("base"), F.sum("c").alias("cur"),
        F.max("n_base").alias("n_base"), F.max("n_cur").alias("n_cur"), F.max("_k").alias("bins"))


def _divergence(left: Column, right: Column) -> Column:
    return left * F.ln(left / right)


def drift_psi(df: DataFrame, groups: Sequence[str], value: str, current: str | None, bins: int = 10) -> DataFrame:
    """Stability index; a bin empty on both sides adds nothing, so it need not be listed."""
    clip = lambda x: F.greatest(F.lit(HISTOGRAM_FLOOR), F.least(F.lit(1 - HISTOGRAM_FLOOR), x))
    b, c = clip(F.col("base") / F.col("n_base")), clip(F.col("cur") / F.col("n_cur"))
    term = F.when(F.col("bin") >= 0, (c - b) * F.ln(c / b)).otherwise(0.0)
    return histogram(df, groups, value, current, bins).groupBy(*groups).agg(F.sum(term).alias("psi"))


def drift_divergence(df: DataFrame, groups: Sequence[str], value: str, current: str | None,
                     bins: int = 10) -> DataFrame:
    """Jensen-Shannon (capped at 1) and Kullback-Leibler divergence of current from baseline."""
    binned = histogram(df, groups, value, current, bins, pooled=True)
    k, eps = F.col("bins"), F.lit(HISTOGRAM_FLOOR)
    p = (F.col("base") / F.col("n_base") + eps) / (1 + eps * k)
    q = (F.col("cur") / F.col("n_cur") + eps) / (1 + eps * k)
    m = (p + q) / 2
    sums = binned.groupBy(*groups).agg(
        F.sum((_divergence(p, m) + _divergence(q, m)) / 2).alias("js"),
        F.sum(_divergence(q, p)).alias("kl"))
    return sums.select(*groups, F.least("js", F.lit(1.0)).alias("js"), "kl")


def cumulative(df: DataFrame, groups: Sequence[str], value: str, current: str | None) -> DataFrame:
    """Both empirical distribution functions at and just below every distinct value."""
    counts = _counted(df, groups, value, current)
    steps = running_totals(counts, list(groups), value, ["b", "c"])
    share = lambda n, w: F.when(F.col(f"all_{w}") > 0, n / F.col(f"all_{w}"))
    return steps.select(
        *groups, value, share(F.col("cum_b"), "b").alias("f_base"), share(F.col("cum_c"), "c").alias("f_cur"),
        share(F.col("cum_b") - F.col("b"), "b").alias("f_base_below"),
        share(F.col("cum_c") - F.col("c"), "c").alias("f_cur_below"))


def drift_ks(df: DataFrame, groups: Sequence[str], value: str, current: str | None) -> DataFrame:
    """Exact two-sample Kolmogorov-Smirnov statistic; 0 when a sample is empty."""
    gap = F.abs(F.col("f_base") - F.col("f_cur"))
    return cumulative(df, groups, value, current).groupBy(*groups).agg(
        F.coalesce(F.max(gap), F.lit(0.0)).alias("ks"))


def drift_wasserstein(df: DataFrame, groups: Sequence[str], value: str, current: str | None) -> DataFrame:
    """Exact first Wasserstein distance.

    The area between both distribution functions, written as a sum over values that needs no
    next value: with G = |F_base - F_cur|, sum of x * (G below x - G at x).
    """
    at = F.abs(F.col("f_base") - F.col("f_cur"))
    below = F.abs(F.col("f_base_below") - F.col("f_cur_below"))
    return cumulative(df, groups, value, current).groupBy(*groups).agg(
        F.sum(F.col(value) * (below - at)).alias("wasserstein"))


def drift_chi2(df: DataFrame, groups: Sequence[str], category: str, current: str) -> DataFrame:
    """Chi-squared statistic of the category by period table."""
    cells = df.filter(F.col(category).isNotNull()).groupBy(*groups, category).agg(
        F.count_if(~F.col(current)).alias("b"), F.count_if(F.col(current)).alias("c"))
    sizes = cells.groupBy(*groups).agg(F.sum("b").alias("n_base"), F.sum("c").alias("n_cur"))
    joined = _attach(cells, sizes, groups)
    row, n = F.col("b") + F.col("c"), F.col("n_base") + F.col("n_cur")
    eb, ec = row * F.col("n_base") / n, row * F.col("n_cur") / n
    term = (F.col("b") - eb) ** 2 / eb + (F.col("c") - ec) ** 2 / ec
    return joined.groupBy(*groups).agg(F.sum(term).alias("chi2"), (_ones() - 1).alias("freedom"))


def prediction_drift(df: DataFrame, groups: Sequence[str], value: str, current: str | None,
                     psi_limit: float = 0.25, ks_limit: float = 0.2, psi: DataFrame | None = None) -> DataFrame:
    """The three metrics of a prediction column and their verdict (ML-001).

    ``psi`` may bring the stability index when it is already known.
    """
    if current is not None:
        df, current = cut_lineage(value_counts(df, groups, value, current)), None
    index = psi if psi is not None else drift_psi(df, groups, value, current)
    # Stacked and grouped, not joined: a null group is one group.
    parts = [index.select(*groups, "psi"), drift_ks(df, groups, value, current),
             drift_divergence(df, groups, value, current).drop("kl")]
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    metrics = stacked.groupBy(*groups).agg(*[F.coalesce(F.max(m), F.lit(0.0)).alias(m) for m in ("psi", "ks", "js")])
    psi_, ks = F.col("psi"), F.col("ks")
    detected = (psi_ >= psi_limit) | (ks >= ks_limit)
    severity = F.when((psi_ >= 0.5) | (ks >= 0.4), CRITICAL).when(
        (psi_ >= 0.25) | (ks >= 0.2), WARNING).otherwise(INFO)
    return metrics.select(*groups, "psi", "ks", "js", detected.alias("drift_detected"),
                          F.when(detected, severity).alias("severity"))


def feature_counts(df: DataFrame, groups: Sequence[str], features: Sequence[str], current: str) -> DataFrame:
    """Counts per (group, feature, value) of both samples, from one unpivoted pass."""
    long = df.select(*groups, current, *[F.col(f).cast("double").alias(f) for f in features]).unpivot(
        [*groups, current], list(features), "feature", "value")
    return value_counts(long, [*groups, "feature"], "value", current)


def feature_psi(df: DataFrame, groups: Sequence[str], features: Sequence[str], current: str) -> DataFrame:
    """Stability index of every feature of every group."""
    counts = cut_lineage(feature_counts(df, groups, features, current))
    return drift_psi(counts, [*groups, "feature"], "value", None)


def feature_drift(psis: DataFrame, groups: Sequence[str], total: int, limit: float = 0.25) -> DataFrame:
    """Indices of ``total`` features rolled up per model (ML-002).

    The mean and maximum run over features with both periods; the ratio over all features.
    """
    drifted = F.col("psi") >= limit
    per_model = psis.groupBy(*groups).agg(
        F.count_if(drifted).alias("drifted"), F.max("psi").alias("max_psi"), F.avg("psi").alias("avg_psi"),
        F.array_join(F.array_sort(F.collect_list(F.when(drifted, F.col("feature")))), ",").alias("affected"))
    ratio = F.col("drifted") / total
    severity = F.when((ratio >= 0.5) | (F.col("max_psi") >= 0.5), CRITICAL).when(
        (ratio >= 0.2) | (F.col("max_psi") >= 0.25), WARNING).otherwise(INFO)
    return per_model.select(*groups, "drifted", "max_psi", "avg_psi", ratio.alias("drift_ratio"), "affected",
                            F.when(F.col("drifted") > 0, severity).alias("severity"))
