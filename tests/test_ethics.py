import pytest
from pyspark.sql import functions as F

from tableward.operators import ethics as E
from tableward.plans.registry import Tables, load_all


def test_names_match_whole_words_unless_loose():
    columns = ["page", "language", "zip_code", "clientIp", "shipping", "Age", "description"]
    assert set(E.named_like(columns, E.SENSITIVE_NAMES)) == {"zip_code", "clientIp"}
    assert set(E.named_like(columns, E.PROTECTED_NAMES)) == {"Age"}
    assert "shipping" in E.named_like(columns, E.SENSITIVE_NAMES, loose=True)


TEXTS = ["mail a.b@c.org or 555-123-4567", "call (555) 123-4567", "ssn 123-45-6789", "card 4111 1111 1111 1111",
         "host 10.0.0.1", "nothing 12 here", "@ alone", None, "Übung 1.5 ok", "4111111111111111"]


def test_first_pattern_in_order(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    got = [r["p"] for r in df.select(E.first_pattern(F.col("t")).alias("p")).collect()]
    assert got == ["email", "phone", "ssn", "credit_card", "ip_address", None, None, None, None, "phone"]


def test_short_forms_find_what_the_patterns_find(spark):
    """The cheaper tests decide as the patterns themselves do, in their order."""
    numbers = ["(555)123-4567", "+1 555.123.4567", "1234 5678", "1234-5678-9012-3456", "1.2.3.4", "10.20.300.4", "1.2.3", "1234.56",
               "12 34 56", "999999999", "9999999999", "123-45-6789", "123 456789", "555)\n123 4567", "a@b", "x.y@z.co", "é@b.org", "%@-.ab"]
    texts = [f"{a}{gap}{b}" for a in numbers for gap in (" ", "", "x", "é", "-") for b in numbers]
    whole = F.coalesce(*[F.when(F.col("t").rlike(p), n) for n, p in E.PII_PATTERNS.items()])
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", E.first_pattern(F.col("t")).alias("got"), whole.alias("want"))
    assert rows.filter("NOT got <=> want").collect() == []
    assert {r.want for r in rows.select("want").distinct().collect()} == {*E.PII_PATTERNS, None}


def test_masking_leaves_no_pattern(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string").select(E.masked(F.col("t")).alias("m"))
    got = [r["m"] for r in df.collect()]
    assert got[0] == "mail [EMAIL] or [PHONE]" and got[3] == "card [CREDIT_CARD]" and got[7] is None and got[9] == "[CREDIT_CARD]"
    assert df.filter(E.first_pattern(F.col("m")).isNotNull()).count() == 0


def test_pairs_are_exactly_the_violating_ones(spark):
    rates = spark.createDataFrame([("x", "a", 0.9), ("x", "b", 0.5), ("x", "c", 0.0), ("x", "d", 0.0)], "attribute string, g string, v double")
    got = {(r["group_a"], r["group_b"], round(r["disparity_ratio"], 3)) for r in E.disparate_pairs(rates, ["attribute"], "g", "v").collect()}
    assert got == {("a", "b", 0.556), ("a", "c", 0.0), ("a", "d", 0.0), ("b", "c", 0.0), ("b", "d", 0.0)}
    verdict = E.fairness(rates, ["attribute"], "v").first()
    assert (verdict["severity"], verdict["score"], verdict["min_ratio"]) == ("CRITICAL", 30.0, 0.0)


@pytest.mark.parametrize("values, severity", [([1, 1, 1, 1], None), ([1, 0, 1, 1], "WARNING"), ([1, 0, 0, 0], "CRITICAL")])
def test_bias(spark, values, severity):
    # Group a always gets a positive prediction, group b as given: b/a is the disparity.
    share = values + [1] * (0 if severity == "CRITICAL" else 0)
    rows = [("a", 1)] * 4 + [("b", v) for v in share]
    got = E.bias(spark.createDataFrame(rows, "sex string, p int"), ["sex"], "p").collect()
    assert {r["severity"] for r in got} == ({severity} if severity else set())
    assert len(got) == {None: 0, "WARNING": 1, "CRITICAL": 2}[severity]


def test_imbalance_and_minors(spark):
    df = spark.range(100).select(F.when(F.col("id") < 3, "x").otherwise("y").alias("gender"), F.col("id").alias("age"))
    row = E.protected_imbalance(df).filter("attribute = 'gender'").first()
    assert (row["grp"], row["ratio"]) == ("x", 0.03)
    assert E.minors(df, "age").first()["minors"] == 17


def test_exposure_scores(spark):
    rows = [("d1", "email", True, True, True), ("d2", "email", True, False, True), ("d3", "price", False, False, True),
            ("d4", "email", False, False, False)]
    df = spark.createDataFrame(rows, "dataset_id string, field string, encrypted boolean, masked boolean, access_controlled boolean")
    got = {r["dataset_id"]: (r["score"], r["severity"]) for r in E.pii_exposure(df).collect()}
    assert got == {"d1": (95.0, None), "d2": (75.0, "WARNING"), "d3": (75.0, None), "d4": (25.0, "CRITICAL")}


def test_exposure_counts_whole_words(spark):
    rows = [(n, f, True, True, True) for n, f in enumerate(["filename", "name", "firstName", "race_time", "trace", "user-Email", "zipped", None])]
    df = spark.createDataFrame(rows, "dataset_id int, field string, encrypted boolean, masked boolean, access_controlled boolean")
    found = lambda **how: {r.dataset_id for r in E.pii_exposure(df, **how).filter("pii_fields > 0").collect()}
    assert found() == {1, 2, 3, 5} and found(loose=True) == {0, 1, 2, 3, 4, 5, 6}


def test_exposure_of_orders_takes_one_shuffle(spark, tmp_path):
    """Repeated lines, missing quantities and orders without a key; names are judged without a search per term."""
    rows = [(1, 1, 1.0), (1, 1, 1.0), (1, 2, 5.0), (2, 1, None), (2, 3, 7.0), (None, 1, 1.0), (3, 1, None), (4, 7, 49.0)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_quantity double").write.parquet(str(tmp_path / "lineitem.parquet"))
    found = load_all()["pii_exposure"].build(Tables(spark, str(tmp_path)))
    # Places 2 (ZIP), 7 (weight); none and 2 (ZIP); 2 (ZIP); none; 0 (email_address).
    assert {r.dataset_id: (r.pii_fields, r.score, r.severity) for r in found.collect()} == {
        1: (1, 95.0, None), 2: (1, 95.0, None), None: (1, 45.0, "WARNING"), 3: (0, 75.0, None), 4: (1, 75.0, "WARNING")}
    plan = load_all()["pii_exposure"].build(Tables(spark, str(tmp_path)))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "exists(" not in plan
