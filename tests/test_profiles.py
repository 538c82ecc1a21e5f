"""Sketches kept and united, inclusions between columns, records without a schema."""

import math

import pytest
from pyspark.sql import functions as F

from tableward.operators import contracts as C
from tableward.operators import inclusions as I
from tableward.operators import sketches as K
from tableward.operators import variants as V


def test_ten_days_united_count_as_their_rows(spark):
    df = spark.range(200_000).select((F.col("id") % 10).alias("day"), (F.col("id") * 7919 % 60_000).alias("n"),
                                     F.when(F.col("id") % 3 > 0, F.concat(F.lit("u"), F.col("id") % 37)).alias("s"))
    days = K.distinct_sketches(df, ["n", "s"], ["day"]).cache()
    united = {r.field: r for r in K.distinct_counts(K.unite_distinct(days)).collect()}
    exact = {r.field: r.distinct_values for r in K.exact_distinct(df, ["n", "s"]).collect()}
    assert exact == {"n": 60_000, "s": 37}
    assert abs(united["n"].distinct_values - 60_000) <= 60_000 * K.distinct_error(12)
    assert united["s"].distinct_values == 37 and united["s"].rows == 200_000
    assert math.isclose(united["s"].null_share, df.filter("s IS NULL").count() / 200_000)
    # Uniting in steps is uniting at once.
    pairs = K.unite_distinct(days.withColumn("half", F.col("day") % 2), ["half"])
    assert {r.field: r.distinct_values for r in K.distinct_counts(K.unite_distinct(pairs)).collect()} == {f: r.distinct_values for f, r in united.items()}


def test_values_in_sketches_are_equal_where_values_are(spark):
    rows = [("", 0.0, [1]), (None, -0.0, [1]), ("=", 1.5, None), ("x" * 70, float("nan"), [2])]
    df = spark.createDataFrame(rows, "s string, d double, a array<int>")
    counted = {r.field: (r.filled, r.distinct_values) for r in K.distinct_counts(K.distinct_sketches(df, ["s", "d", "a"])).collect()}
    assert counted == {"s": (3, 3), "d": (4, 3), "a": (3, 2)}
    assert {r.field: r.distinct_values for r in K.exact_distinct(df, ["s", "d", "a"]).collect()} == {"s": 3, "d": 3, "a": 2}
    none = K.distinct_counts(K.distinct_sketches(df.limit(0), ["s"])).first()
    assert (none.rows, none.filled, none.distinct_values, none.null_share) == (0, 0, 0, None)
    assert K.distinct_sketches(df.limit(0), ["s"], ["d"]).count() == 0


def test_a_month_of_latencies_from_sketches(spark):
    df = spark.range(90_000).select((F.col("id") % 30).alias("day"), F.when(F.col("id") % 50 > 0, F.pow(F.col("id") * 7919 % 90_001, F.lit(1.5))).alias("ms"))
    days = K.quantile_sketches(df, "ms", ["day"], k=400)
    shares = {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    read = K.read_quantiles(K.unite_quantiles(days, k=400), shares).cache()
    row = read.first()
    assert row.p0 == row.least and row.p100 == row.greatest and row.n == 88_200
    for r in K.quantile_ranks(df, "ms", [], read, {"p50": 0.5, "p95": 0.95}).collect():
        assert r.below - 2 * K.rank_error(400) <= shares[r.quantile] <= r.upto + 2 * K.rank_error(400)
    over = K.share_above(K.unite_quantiles(days, k=400), row.p95).first().above
    assert abs(over - 0.05) < 0.02


def test_latencies_that_are_none(spark):
    df = spark.createDataFrame([("a", None), ("a", float("nan")), ("b", 5.0), ("b", float("inf")), (None, 2.0)], "m string, ms double")
    read = {r.m: (r.n, r.p50) for r in K.read_quantiles(K.unite_quantiles(K.quantile_sketches(df, "ms", ["m"]), ["m"]), {"p50": 0.5}).collect()}
    assert read == {"a": (0, None), "b": (1, 5.0), None: (1, 2.0)}
    above = {r.m: r.above for r in K.share_above(K.quantile_sketches(df, "ms", ["m"]), 3.0).collect()}
    assert above == {"a": None, "b": 1.0, None: 0.0}
    assert K.read_quantiles(K.unite_quantiles(K.quantile_sketches(df.limit(0), "ms", ["m"]), ["m"]), {"p50": 0.5}).count() == 0


def test_inclusions_against_sets(spark):
    a = spark.createDataFrame([(1, "1", 1.0), (2, "x", 2.0), (2, None, 0.0), (None, "", -0.0)], "k long, s string, d double")
    b = spark.createDataFrame([(i, str(i)) for i in range(5)], "id int, code string")
    long = spark.createDataFrame([("y" * 200,), ("y" * 201,)], "s string")
    tables = {"a": a, "b": b, "long": long, "longer": long.limit(1).union(long)}
    made = {(r.column_name, r.reference): (r.distinct_values, r.matched_values, r.reference_values) for r in I.inclusions(tables, 0.01).collect()}
    columns = {f"{t}.{c}": {(I.kind_of(df.schema[c].dataType), v + 0.0 if isinstance(v, float) else v) for v in [r[0] for r in df.select(c).collect()] if v is not None}
               for t, df in tables.items() for c in df.columns}
    assert made == {(x, y): (len(columns[x]), len(columns[x] & columns[y]), len(columns[y])) for x in columns for y in columns
                    if x != y and columns[x] & columns[y]}
    whole = {(r.column_name, r.reference) for r in I.inclusions(tables).collect()}
    assert whole == {("a.k", "b.id"), ("long.s", "longer.s"), ("longer.s", "long.s")}
    sizes = spark.createDataFrame([("b.id", 5), ("long.s", 2), ("longer.s", 3)], "column_name string, filled long")
    assert {(r.column_name, r.reference) for r in I.key_candidates(I.inclusions(tables), sizes).collect()} == {("a.k", "b.id"), ("longer.s", "long.s")}
    assert I.inclusions({"a": a.limit(0), "b": b.limit(0)}).count() == 0


def test_inclusions_take_one_shuffle_of_values(spark):
    df = spark.range(100).selectExpr("id", "id % 7 AS hot", "cast(id AS string) AS s")
    plan = I.shared_columns({"t": df})._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 2 and "Join" not in plan


@pytest.mark.parametrize("least", [0, 1.5])
def test_inclusions_want_a_share(spark, least):
    with pytest.raises(ValueError, match="share"):
        I.inclusions({"t": spark.range(1)}, least)


CONTRACT = C.Contract("c", "1.0.0", "s", (C.ContractColumn("id", "integer", required=True, nullable=False), C.ContractColumn("v", "number")))


def test_variants_against_a_contract(spark):
    texts = ['{"id":1,"v":2}', '{"id":"a","v":2.5}', '{"v":null}', '{"id":null,"w":1}', "{}", "3", "nope", None, '{"id":5,"v":{"id":1}}']
    df = V.as_variant(spark.createDataFrame([(t,) for t in texts], "t string"), "t")
    found = {(r.failure_code, r.column_name): (r.severity, r.affected_count) for r in V.validate_variants(df, "value", CONTRACT).collect()}
    assert found == {("SC-001", "id"): ("CRITICAL", 2), ("SC-003", "id"): ("CRITICAL", 2), ("SC-003", "v"): ("WARNING", 1),
                     ("SC-002", "w"): ("INFO", 1), ("SC-003", "*"): ("CRITICAL", 3)}
    assert V.validate_variants(df.limit(0), "value", CONTRACT).count() == 0
    assert "id" in V.observed_schema(df.filter("t LIKE '{%'"), "value").first().schema


def test_open_contract_allows_more_fields(spark):
    df = V.as_variant(spark.createDataFrame([('{"id":1,"w":1}',)], "t string"), "t")
    open_one = C.Contract("c", "1.0.0", "s", CONTRACT.columns, additional_properties=True)
    assert V.validate_variants(df, "value", open_one).count() == 0
