from functools import reduce

import pytest
from pyspark.sql import functions as F

from tableward.operators import bronze as B

ROWS = [
    ("1", "Alice", "alice@example.com", "100.5", "10", "2024-01-01 10:00:00"),
    ("2", "Bob", "not-an-email", "-50", "0", "2024-01-01 11:00:00"),
    ("3", "  ", "c@example.com", "5", "2", "2024-01-01 12:00:00"),
    ("4", "Dan", "d@example.com", "2000000", "3", "2024-01-02"),
    ("5", "Eve", "e@example.com", "5", "2", "not-a-date"),
    ("1", "Alice", "alice@example.com", "100.5", "10", "2024-01-01 10:00:00"),
]
SPEC = B.BatchSpec(
    count=B.CountSpec(1, 100_000), required=("name",), types=(B.TypeSpec("created_at", "datetime"),),
    ranges=(B.RangeSpec("amount", 0, 1_000_000), B.RangeSpec("quantity", 1, 10_000)),
    formats=(B.FormatSpec("email", "email"),), duplicates=B.DuplicateSpec(), outliers=("amount",))


@pytest.fixture(scope="module")
def batch(spark):
    names = ["id", "name", "email", "amount", "quantity", "created_at"]
    return spark.createDataFrame(ROWS, ", ".join(f"{n} string" for n in names))


def test_findings_of_a_faulty_batch(batch):
    found = {(r["check_name"], r["field"]): r for r in B.validate_batch(batch, SPEC).collect()}
    expected = {
        ("null_required", "name"): (1, 70.0, "CRITICAL"), ("type", "created_at"): (1, 75.0, "CRITICAL"),
        ("range", "amount"): (2, 70.0, "CRITICAL"), ("range", "quantity"): (1, 55.0, "WARNING"),
        ("format", "email"): (1, 35.0, "INFO"), ("duplicate", "*"): (2, 70.0, "CRITICAL"),
    }
    for key, (count, score, severity) in expected.items():
        row = found[key]
        assert (row["affected_count"], row["severity_score"], row["severity"]) == (count, score, severity)
    # Too few rows for outliers, and the count is within bounds.
    assert not found[("outlier", "amount")]["failed"] and not found[("count", "*")]["failed"]


def test_quarantine_and_clean_rows_make_up_the_batch(batch):
    held = B.quarantine(batch, SPEC, ["id"])
    assert held.count() == 6 and B.clean(batch, SPEC).count() == 0
    codes = {r["row_key"]: list(r["failure_codes"]) for r in held.collect()}
    assert codes["3"] == ["DV-002"] and codes["4"] == ["DV-004"] and codes["1"] == ["DV-006"]


def test_critical_count_quarantines_everything(batch):
    spec = B.BatchSpec(count=B.CountSpec(exact=100))
    assert B.quarantine(batch, spec, ["id"]).count() == 6


@pytest.mark.parametrize("spec, score", [
    (B.CountSpec(exact=0), 50.0), (B.CountSpec(exact=8), 55.0), (B.CountSpec(minimum=7), 30.0),
    (B.CountSpec(maximum=3), 75.0), (B.CountSpec(minimum=6, maximum=6), None),
])
def test_count_scores(batch, spec, score):
    assert B.count_finding(batch, spec).first()["severity_score"] == score


def test_nan_is_no_range_violation_and_no_outlier(spark):
    df = spark.range(100).select(F.when(F.col("id") == 1, float("nan")).when(F.col("id") == 2, float("inf")).when(
        F.col("id") == 3, 1000.0).otherwise(F.col("id") % 7).alias("v"))
    ranged = B.profile(df, B.range_checks([B.RangeSpec("v", 0, 500)])).first()
    assert ranged["affected_count"] == 2  # infinity and 1000
    outliers = B.profile(df, B.outlier_checks(df, ["v"])).first()
    assert outliers["affected_count"] == 1


def test_type_coercion(spark):
    texts = ["1", " 2 ", "-3", "1.5", "1e3", "nan", "x", "1d", "yes", "TRUE", "2024-1-5", "2024-01-05T10:00:00Z"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    from tableward.functions.predicates import coercible

    row = df.agg(*[F.sort_array(F.collect_list(F.when(coercible(F.col("t"), k), F.col("t")))).alias(k)
                   for k in ("integer", "float", "boolean", "datetime")]).first()
    assert row["integer"] == sorted(["1", " 2 ", "-3"])
    assert row["float"] == sorted(["1", " 2 ", "-3", "1.5", "1e3", "nan"])
    assert row["boolean"] == sorted(["1", "yes", "TRUE"])
    assert row["datetime"] == sorted(["2024-1-5", "2024-01-05T10:00:00Z"])


@pytest.mark.parametrize("name, good, bad", [
    ("email", "A@b.co", "a@b"), ("phone_us", "(555) 123-4567", "12345"), ("zipcode_us", "12345-6789", "1234"),
    ("uuid", "123e4567-e89b-12d3-a456-426614174000", "123e4567"), ("ipv4", "1.2.3.4", "1.2.3"),
    ("date_iso", "2024-01-01", "2024/01/01"), ("datetime_iso", "2024-01-01T00:00:00+02", "2024-01-01"),
    ("url", "HTTPS://x.y", "x.y"),
])
def test_named_formats(spark, name, good, bad):
    df = spark.createDataFrame([(good,), (bad,), (None,)], "t string")
    row = B.profile(df, B.format_checks([B.FormatSpec("t", name)])).first()
    assert row["affected_count"] == 1


def test_more_checks_than_one_aggregate_takes(spark):
    df = spark.range(10).select(*[F.lit(None).cast("string").alias(f"c{i}") for i in range(B.SLICE + 5)])
    rows = B.profile(df, B.null_checks(df, df.columns)).collect()
    assert len(rows) == B.SLICE + 5 and all(r["affected_count"] == 10 for r in rows)


def test_result_does_not_depend_on_partitions(batch):
    one, seven = (sorted(map(str, B.validate_batch(batch.repartition(n), SPEC).collect())) for n in (1, 7))
    assert one == seven


def test_one_value_holding_a_third_of_the_rows(spark):
    df = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"))
    row = B.duplicate_finding(df, B.DuplicateSpec(("k",))).first()
    assert (row["affected_count"], row["groups"]) == (10_000, 1)


def test_whole_rows_with_nulls_and_case(spark):
    rows = [(1, None, "a"), (1, None, "A"), (1, "x", "a"), (1, "x", "a"), (None, None, None), (None, None, None)]
    df = spark.createDataFrame(rows, "i int, s string, t string")
    assert B.duplicate_finding(df, B.DuplicateSpec()).first()["affected_count"] == 4
    assert B.duplicate_finding(df, B.DuplicateSpec(case_sensitive=False)).first()["affected_count"] == 6


def test_statistics_of_the_quarantine(spark):
    rows = [("b1", "1", ["DV-002", "DV-003"]), ("b1", "2", ["DV-002"]), ("b2", "3", ["DV-003"])]
    df = spark.createDataFrame(rows, "batch_id string, row_key string, failure_codes array<string>")
    got = {(r["scope"], r["value"]): r["rows"] for r in B.quarantine_statistics(df).collect()}
    assert got == {("code", "DV-002"): 2, ("code", "DV-003"): 2, ("batch", "b1"): 2, ("batch", "b2"): 1, ("total", "*"): 3}


def test_profile_is_one_scan(batch):
    plan = B.profile(batch, B.row_checks(batch, SPEC))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan") == 1 and plan.count("Exchange") == 1


def test_slices_cover_all(batch):
    parts = [B.profile(batch, [c]) for c in B.row_checks(batch, SPEC)]
    assert reduce(lambda a, b: a.unionByName(b), parts).count() == len(B.row_checks(batch, SPEC))
