import numpy as np
import pytest
from pyspark.sql import functions as F

from tableward.operators import statistics as D


@pytest.fixture(scope="module")
def samples():
    rng = np.random.default_rng(7)
    return np.round(rng.normal(0, 1, 900), 1), np.round(rng.normal(0.4, 1.3, 700), 1)


@pytest.fixture(scope="module")
def frame(spark, samples):
    rows = [("m", float(v), flag) for flag, part in zip((False, True), samples) for v in part]
    return spark.createDataFrame(rows, "g string, v double, cur boolean")


def test_psi_matches_histograms(frame, samples):
    base, cur = samples
    counts, edges = np.histogram(base, bins=10)
    clip = lambda x: np.clip(x, 1e-10, 1 - 1e-10)
    b, c = clip(counts / len(base)), clip(np.histogram(cur, bins=edges)[0] / len(cur))
    want = float(np.sum((c - b) * np.log(c / b)))
    assert D.drift_psi(frame, ["g"], "v", "cur").first()["psi"] == pytest.approx(want, abs=0.02)


def test_ks_and_wasserstein_match_sorting(frame, samples):
    base, cur = (np.sort(s) for s in samples)
    points = np.sort(np.concatenate([base, cur]))
    f = np.searchsorted(base, points, "right") / len(base)
    g = np.searchsorted(cur, points, "right") / len(cur)
    assert D.drift_ks(frame, ["g"], "v", "cur").first()["ks"] == pytest.approx(float(np.max(np.abs(f - g))))
    area = float(np.sum(np.abs(f - g)[:-1] * np.diff(points)))
    assert D.drift_wasserstein(frame, ["g"], "v", "cur").first()["wasserstein"] == pytest.approx(area)


@pytest.mark.parametrize("partitions", [1, 7])
def test_same_sample_has_no_distance(frame, partitions):
    same = frame.filter("NOT cur").withColumn("cur", F.explode(F.array(F.lit(False), F.lit(True)))).repartition(partitions)
    assert D.drift_psi(same, ["g"], "v", "cur").first()["psi"] == pytest.approx(0)
    assert D.drift_ks(same, ["g"], "v", "cur").first()["ks"] == 0
    assert D.drift_divergence(same, ["g"], "v", "cur").first()["js"] == pytest.approx(0)
    assert D.drift_chi2(same, ["g"], "v", "cur").first()["chi2"] == pytest.approx(0)


def test_constant_sample_and_tiny_sample(spark):
    rows = [("c", 1.0, f) for f in (False, True) for _ in range(20)] + [("t", 1.0, False), ("t", 2.0, True)]
    df = spark.createDataFrame(rows, "g string, v double, cur boolean")
    got = {r["g"]: r["psi"] for r in D.drift_psi(df, ["g"], "v", "cur").collect()}
    assert got == {"c": pytest.approx(0)}


def test_baseline_bins_and_self_comparison(frame, samples):
    base = frame.filter("NOT cur")
    bins = D.numeric_baseline(base, "v")
    rows = bins.orderBy("bin_no").collect()
    assert sum(r["n"] for r in rows) == len(samples[0]) and sum(r["freq"] for r in rows) == pytest.approx(1)
    assert all(a["high"] < b["low"] for a, b in zip(rows, rows[1:]))
    assert D.baseline_psi(bins, D.assign_bins(base, "v", bins), "bin_no").first()["psi"] == pytest.approx(0)
    assert D.numeric_baseline(base.limit(5), "v").count() == 0


def test_value_holding_a_third_of_the_rows(spark):
    df = spark.range(9000).select(F.when(F.col("id") % 3 == 0, 5.0).otherwise(F.col("id").cast("double")).alias("v"))
    rows = D.numeric_baseline(df, "v").collect()
    assert sum(r["n"] for r in rows) == 9000 and max(r["n"] for r in rows) >= 3000


def test_categorical_shift(spark):
    old = spark.createDataFrame([("a",)] * 50 + [("b",)] * 50, "k string")
    new = spark.createDataFrame([("a",)] * 90 + [("c",)] * 10, "k string")
    psi = D.baseline_psi(D.categorical_baseline(old, "k"), D.categorical_baseline(new, "k").select("key", "n"), "key").first()
    want = sum((a - e) * np.log(a / e) for a, e in ((.9, .5), (1e-4, .5), (.1, 1e-4)))
    assert psi["psi"] == pytest.approx(want) and psi["severity"] == "CRITICAL" and psi["severity_score"] == 100
    assert D.baseline_psi(D.categorical_baseline(old, "k"), D.categorical_baseline(old, "k").select("key", "n"), "key").first()["severity"] is None


def test_running_totals_over_many_partitions(spark):
    from tableward.functions.ordered import running_totals

    counts = spark.range(5000).select((F.col("id") % 3).alias("g"), F.col("id").alias("v"), F.lit(1).alias("n"))
    rows = running_totals(counts.repartition(7), ["g"], "v", ["n"]).collect()
    assert all(r["cum_n"] == r["v"] // 3 + 1 for r in rows) and len(rows) == 5000
