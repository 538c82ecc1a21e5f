import datetime as dt

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tableward.functions.ordered import with_neighbour
from tableward.operators import references as J
from tableward.operators import rules as R


@pytest.fixture(scope="module")
def orders(spark):
    rows = [
        ("O1", "CUST-001", 100.0, 10.0, "2024-01-01", "2024-01-02"),
        ("O2", "CUST-999", 100.0, 150.0, "2024-01-05", "2024-01-02"),
        ("O3", None, None, 5.0, "2024-01-01", None),
    ]
    return spark.createDataFrame(rows, "order_id string, customer_id string, total double, discount double, "
                                       "start_date string, end_date string")


def test_null_operand_breaks_a_boolean_rule_but_not_a_calculation(orders):
    rules = [R.Rule("discount", "crossfield", "discount <= total", severity="CRITICAL"),
             R.Rule("only_large", "domain", "discount < 0", condition="total > 1000"),
             R.Rule("twice", "calculation", "discount * 2", fields=("total",), tolerance=1000.0)]
    hits = {(r["rule_id"], r["row_key"]) for r in R.check_rules(orders, rules, ["order_id"]).collect()}
    assert hits == {("discount", "O2"), ("discount", "O3")}


def test_rows_without_keys_go_by_their_first_identifier(orders):
    rule = R.Rule("r", "domain", "false")
    named = orders.withColumn("id", F.when(F.col("order_id") == "O1", "X"))
    assert [r["row_key"] for r in R.check_rules(named, [rule]).collect()] == ["X", "O2", "O3"]


def test_report_lists_disabled_rules_and_orders_by_priority(orders):
    rules = [R.Rule("a", "domain", "total > 0"), R.Rule("b", "domain", "total > 0", enabled=False, priority=9)]
    rows = R.rule_report(orders, rules).collect()
    assert [(r["rule_id"], r["skipped"], r["evaluated"], r["failed"]) for r in rows] == [("b", True, 0, 0), ("a", False, 3, 1)]


def test_sequence_skips_gaps(spark):
    days = [dt.date(2024, 1, i) for i in (1, 2, 3)]
    df = spark.createDataFrame([(1, days[0], None, days[1]), (2, days[2], None, days[1]), (3, None, None, days[0])],
                               "id int, a date, b date, c date")
    rule = R.Rule("seq", "temporal", fields=("a", "b", "c"), check="sequence")
    assert [r["row_key"] for r in R.check_rules(df, [rule], ["id"]).collect()] == ["2"]


def test_rollup_scores_and_samples(spark):
    found = spark.range(1000).select(F.format_string("%04d", "id").alias("row_key"), F.lit("r").alias("rule_id"),
                                     F.lit("BL-001").alias("failure_code"), F.lit("WARNING").alias("severity"))
    row = R.rollup(found).first()
    assert row["violations"] == 1000 and row["severity_score"] == 100.0
    assert row["sample_keys"] == ["0000", "0001", "0002", "0003", "0004"]


def test_auto_rules_need_their_columns(spark, orders):
    found = {r["rule_id"]: r["violations"] for r in R.auto_logic(orders).collect()}
    assert found == {"auto_end_before_start": 1}
    assert R.auto_logic(spark.range(3)).count() == 0
    people = spark.createDataFrame([("10", "60000"), ("130", "-1"), ("x", "5")], "age string, income string")
    found = {r["rule_id"]: r["violations"] for r in R.auto_logic(people).collect()}
    assert found == {"auto_age_income_logic": 1, "auto_age_range_logic": 1, "auto_negative_income": 1}


@pytest.mark.parametrize("following", [False, True])
def test_neighbours_across_slices_of_a_hot_key(spark, following):
    df = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, F.lit(None)).otherwise(
            F.concat(F.lit("k"), F.col("id") % 50)).alias("k"),
        "id", (F.col("id") * 7919 % 1000).alias("at"))
    order = ["at", "id"]
    got = with_neighbour(df, ["k"], order, {"p": "id"}, following)
    step = (F.lead if following else F.lag)("id")
    want = df.withColumn("p", step.over(W.partitionBy("k").orderBy(*order)))
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_state_transitions(spark):
    rows = [("a", 1, "PENDING"), ("a", 2, "CONFIRMED"), ("a", 3, "PENDING"), ("b", 1, "LOST"), ("b", 2, "PENDING")]
    df = spark.createDataFrame(rows, "k string, t int, s string")
    allowed = {"PENDING": ["CONFIRMED"], "CONFIRMED": ["SHIPPED"]}
    got = {(r["k"], r["t"]): r["reason"] for r in R.state_transitions(df, "k", ["t"], "s", allowed).collect()}
    assert got == {("a", 3): "not_allowed", ("b", 2): "unknown_state"}


def test_references(spark, orders):
    customers = spark.createDataFrame([("CUST-001", "yes"), ("CUST-002", "no")], "id string, active string")
    broken = {(r["row_key"], r["reason"]) for r in J.broken_references(orders, "customer_id", customers, "id", ["order_id"]).collect()}
    assert broken == {("O2", "not_found"), ("O3", "null_fk")}
    allowed = J.broken_references(orders, "customer_id", customers, "id", ["order_id"], allow_null=True)
    assert [r["row_key"] for r in allowed.collect()] == ["O2"]
    assert [r["order_id"] for r in J.orphans(orders, "customer_id", customers, "id").collect()] == ["O2"]
    found = {r["order_id"]: (r["found"], r["active"]) for r in J.lookup(
        orders, "customer_id", customers, "id", F.col("active"), []).collect()}
    assert found == {"O1": (True, True), "O2": (False, False), "O3": (False, False)}
    assert J.foreign_key_candidates(["id", "customer_id", "x_id"], ["orders", "Customers"]) == [("customer_id", "Customers")]


def test_last_duplicate_reference_wins(spark):
    df = spark.createDataFrame([("a", 1, "old"), ("a", 2, "new"), (None, 3, "lost")], "k string, seq int, v string")
    assert [(r["ref_key"], r["record"]["v"]) for r in J.load_reference(df, "k", ["seq"]).collect()] == [("a", "new")]


def test_repeated_reference_keys_repeat_no_row(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id int, k string")
    reference = spark.createDataFrame([("a", "x", "yes"), ("a", "y", "no"), (None, "z", "yes")], "key string, v string, active string")
    found = {r["id"]: (r["v"], r["found"]) for r in J.lookup(df, "k", reference, "key", F.col("active"), ["v"]).collect()}
    assert found == {1: ("y", True), 2: (None, False), 3: (None, False)}
    broken = {r["id"]: r["broken_at"] for r in J.cascade(df, [("k", reference, "key", ["v"])]).collect()}
    assert broken == {1: None, 2: "k", 3: "k"}


def test_parents_without_children_are_checked(spark):
    parents = spark.createDataFrame([(1, 10.0), (2, 5.0), (3, 0.0)], "p int, total double")
    children = spark.createDataFrame([(1, 4.0), (1, 6.0)], "c int, amount double")
    found = R.child_sums(parents, "p", "total", children, "c", F.col("amount")).collect()
    assert [(r["p"], r["child_sum"]) for r in found] == [(2, 0.0)]
