"""Layer 6: fairness, personal data, governance."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableward.functions import severity as S
from tableward.operators import ethics as E
from tableward.plans.catalog.models import log, rounded
from tableward.plans.inputs import PREDICTION_LOG
from tableward.plans.registry import query

JUDGED = """judged AS (SELECT d.doc_id, lang, source, quality AS prediction, 1 - toxic AS actual FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"""


def judged(t):
    return t.labels.join(t.documents, "doc_id").select(
        "doc_id", "lang", "source", F.col("quality").alias("prediction"), (1 - F.col("toxic")).alias("actual"))


RATES = f"""WITH {JUDGED},
par AS (SELECT lang, count(*) AS n, avg(CAST(prediction = 1 AS INTEGER)) AS positive_rate FROM judged GROUP BY 1),
cell AS (SELECT lang, count(*) FILTER (WHERE prediction = 1 AND actual = 1) AS tp, count(*) FILTER (WHERE prediction <> 1 AND actual = 1) AS fn,
  count(*) FILTER (WHERE prediction = 1 AND actual <> 1) AS fp, count(*) FILTER (WHERE prediction <> 1 AND actual <> 1) AS tn FROM judged GROUP BY 1),
odds AS (SELECT lang, coalesce(tp / nullif(CAST(tp + fn AS DOUBLE), 0), 0) AS tpr, coalesce(fp / nullif(CAST(fp + tn AS DOUBLE), 0), 0) AS fpr, coalesce(tp / nullif(CAST(tp + fp AS DOUBLE), 0), 0) AS precision FROM cell)"""


@query("fairness_parity", RATES + " SELECT lang, n, round(positive_rate, 6) AS positive_rate FROM par")
def fairness_parity(t):
    return rounded(E.parity(judged(t), ["lang"], "prediction"), "positive_rate")


@query("fairness_odds", RATES + " SELECT lang, round(tpr, 6) AS tpr, round(fpr, 6) AS fpr FROM odds")
def fairness_odds(t):
    return rounded(E.odds(judged(t), ["lang"], "prediction", "actual").drop("precision"), "tpr", "fpr")


@query("fairness_precision", RATES + " SELECT lang, round(precision, 6) AS precision FROM odds")
def fairness_precision(t):
    return rounded(E.odds(judged(t), ["lang"], "prediction", "actual").select("lang", "precision"), "precision")


@query("fairness_pairs", f"""WITH {JUDGED}, par AS (SELECT source, avg(CAST(prediction = 1 AS INTEGER)) AS v FROM judged GROUP BY 1)
SELECT 'source' AS attribute, a.source AS group_a, b.source AS group_b, round(a.v, 6) AS value_a, round(b.v, 6) AS value_b, round(CASE WHEN greatest(a.v, b.v) = 0 THEN 1 ELSE least(a.v, b.v) / greatest(a.v, b.v) END, 6) AS disparity_ratio
FROM par a JOIN par b ON a.source < b.source WHERE least(a.v, b.v) < 0.8 * greatest(a.v, b.v)""")
def fairness_pairs(t):
    rates = E.parity(judged(t), ["source"], "prediction").withColumn("attribute", F.lit("source"))
    return rounded(E.disparate_pairs(rates, ["attribute"], "source", "positive_rate"), "value_a", "value_b", "disparity_ratio")


@query("fairness_against_best", f"""WITH {JUDGED}, par AS (SELECT source, avg(CAST(prediction = 1 AS INTEGER)) AS v FROM judged GROUP BY 1),
best AS (SELECT source AS best, v AS best_value FROM par ORDER BY v DESC, source DESC LIMIT 1)
SELECT 'source' AS attribute, source AS grp, best, round(v, 6) AS value, round(best_value, 6) AS best_value, round(CASE WHEN best_value = 0 THEN 1 ELSE v / best_value END, 6) AS disparity_ratio
FROM par, best WHERE CASE WHEN best_value = 0 THEN 1 ELSE v / best_value END < 0.8""")
def fairness_against_best(t):
    rates = E.parity(judged(t), ["source"], "prediction").withColumn("attribute", F.lit("source"))
    return rounded(E.against_best(rates, ["attribute"], "source", "positive_rate"), "value", "best_value", "disparity_ratio")


@query("fairness_check", RATES + """,
m AS (SELECT 'parity' AS metric, count(*) AS groups, min(positive_rate) AS lo, max(positive_rate) AS hi FROM par UNION ALL SELECT 'equalized_odds', count(*), min(tpr), max(tpr) FROM odds),
r AS (SELECT metric, groups, CASE WHEN hi = 0 THEN 1 ELSE lo / hi END AS min_ratio FROM m)
SELECT metric, groups, round(min_ratio, 6) AS min_ratio, CASE WHEN min_ratio < 0.8 THEN 'ET-002' END AS failure_code,
  CASE WHEN min_ratio < 0.5 THEN 'CRITICAL' WHEN min_ratio < 0.8 THEN 'WARNING' END AS severity, CASE WHEN min_ratio < 0.5 THEN 30.0::DOUBLE WHEN min_ratio < 0.8 THEN 60.0::DOUBLE ELSE 100.0::DOUBLE END AS score FROM r""")
def fairness_check(t):
    parity = E.parity(judged(t), ["lang"], "prediction").select(F.lit("parity").alias("metric"), F.col("positive_rate").alias("v"))
    odds = E.odds(judged(t), ["lang"], "prediction", "actual").select(F.lit("equalized_odds").alias("metric"), F.col("tpr").alias("v"))
    return rounded(E.fairness(parity.unionByName(odds), ["metric"], "v"), "min_ratio")


@query("bias_report", f"""WITH {JUDGED},
g AS (SELECT 'lang' AS attribute, lang AS grp, avg(CAST(prediction = 1 AS INTEGER)) AS v FROM judged GROUP BY 2 UNION ALL SELECT 'source', source, avg(CAST(prediction = 1 AS INTEGER)) FROM judged GROUP BY 2),
a AS (SELECT attribute, min(v) / nullif(max(v), 0) AS r FROM g GROUP BY 1 HAVING count(*) >= 2), bad AS (SELECT * FROM a WHERE r < 0.8),
s AS (SELECT min(r) AS min_ratio, string_agg(attribute, ',' ORDER BY attribute) AS attributes FROM bad HAVING count(*) > 0)
SELECT code AS failure_code, CASE WHEN min_ratio < 0.5 THEN 'CRITICAL' ELSE 'WARNING' END AS severity, attributes, round(min_ratio, 6) AS min_ratio, round(min_ratio * 100, 6) AS bias_score
FROM s, (VALUES ('ET-001'), ('ET-003')) c(code) WHERE code = 'ET-001' OR min_ratio < 0.5""")
def bias_report(t):
    return rounded(E.bias(judged(t), ["lang", "source"], "prediction"), "min_ratio", "bias_score")


@query("fairness_calibration", f"""WITH {PREDICTION_LOG}
SELECT model_id, CAST(least(floor(confidence * 10), 9) AS INTEGER) AS score_bin, count(*) AS n, round(avg(confidence), 6) AS mean_score, round(avg(CAST(is_error AS INTEGER)), 6) AS observed_rate FROM log GROUP BY 1, 2""")
def fairness_calibration(t):
    scored = log(t).withColumn("outcome", F.col("is_error").cast("int"))
    return rounded(E.calibration(scored, ["model_id"], "confidence", "outcome"), "mean_score", "observed_rate")


# Personal data --------------------------------------------------------------------------------

def _first(column: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({column}, '{p}') THEN '{n}'" for n, p in E.PII_PATTERNS.items()) + " END"


@query("pii_scan", f"""
SELECT 'documents' AS dataset, 'text' AS field, p AS pattern, count(*) AS rows FROM (SELECT {_first('text')} AS p FROM documents) WHERE p IS NOT NULL GROUP BY p
UNION ALL SELECT 'conversations', 'text', p, count(*) FROM (SELECT {_first('text')} AS p FROM conversations) WHERE p IS NOT NULL GROUP BY p
UNION ALL SELECT 'pages', 'html', p, count(*) FROM (SELECT {_first('html')} AS p FROM pages) WHERE p IS NOT NULL GROUP BY p
UNION ALL SELECT 'pages', 'url', p, count(*) FROM (SELECT {_first('url')} AS p FROM pages) WHERE p IS NOT NULL GROUP BY p""")
def pii_scan(t):
    parts = [E.pii_scan(df, columns).select(F.lit(name).alias("dataset"), "field", "pattern", "rows") for name, df, columns in (
        ("documents", t.documents, ["text"]), ("conversations", t.conversations, ["text"]), ("pages", t.pages, ["url", "html"]))]
    return reduce(DataFrame.unionByName, parts)


@query("pii_rows", f"SELECT doc_id, {_first('text')} AS pattern FROM documents WHERE {_first('text')} IS NOT NULL")
def pii_rows(t):
    return t.documents.select("doc_id", E.first_pattern(F.col("text")).alias("pattern")).filter("pattern IS NOT NULL")


@query("pii_volume", " UNION ALL ".join(
    f"SELECT '{n}' AS pattern, CAST(coalesce(sum(len(regexp_extract_all(text, '{p}'))), 0) AS BIGINT) AS occurrences FROM documents" for n, p in E.PII_PATTERNS.items()))
def pii_volume(t):
    return E.pii_volume(t.documents, "text")


def _mask(column: str) -> str:
    for name in E.MASK_ORDER:
        column = f"regexp_replace({column}, '{E.PII_PATTERNS[name]}', '[{name.upper()}]', 'g')"
    return column


@query("pii_mask", f"SELECT doc_id, {_mask('text')} AS text, sha256('s' || doc_id) AS pseudonym FROM documents")
def pii_mask(t):
    return t.documents.select("doc_id", E.masked(F.col("text")).alias("text"), E.pseudonym(F.col("doc_id"), "s").alias("pseudonym"))


@query("pii_columns", """
SELECT 'customerEmail' AS field, 'email' AS matched, count(c_name) AS filled FROM customer
UNION ALL SELECT 'zip_code', 'zip', count(c_mktsegment) FROM customer UNION ALL SELECT 'client-ip', 'ip', count(CASE WHEN c_acctbal > 0 THEN 1 END) FROM customer""")
def pii_columns(t):
    df = t.customer.select(
        F.col("c_name").alias("customerEmail"), F.col("c_mktsegment").alias("zip_code"),
        F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("client-ip"), F.col("c_custkey").alias("shipping_id"))
    return E.sensitive_columns(df)


# Field names handed out to the lines of an order; each order is a dataset.
FIELD_NAMES = ("email_address", "order_ref", "ZIP", "unit_price", "full_name", "created_on", "Salary_Band", "weight")
EXPOSED = """
f AS (SELECT DISTINCT l_orderkey AS dataset_id, list_extract([{names}], CAST((l_linenumber + CAST(l_quantity AS INTEGER)) % 8 + 1 AS INTEGER)) AS field, l_orderkey % 3 <> 0 AS encrypted, l_orderkey % 4 <> 0 AS masked, l_orderkey % 5 <> 0 AS access_controlled
  FROM lineitem)""".format(names=", ".join(f"'{n}'" for n in FIELD_NAMES))


@query("pii_exposure", f"""WITH {EXPOSED},
s AS (SELECT dataset_id, count(*) FILTER (WHERE lower(field) IN ('email_address', 'zip', 'full_name', 'salary_band')) AS pii_fields, bool_and(encrypted) AS enc, bool_and(masked) AS msk, bool_and(access_controlled) AS acc FROM f GROUP BY 1),
r AS (SELECT *, greatest(0.0::DOUBLE, 100 - least(30, pii_fields * 5) - CASE WHEN enc THEN 0 ELSE 25 END - CASE WHEN pii_fields > 0 AND NOT msk THEN 20 ELSE 0 END - CASE WHEN acc THEN 0 ELSE 25 END) AS score FROM s),
v AS (SELECT *, score < 70 OR (pii_fields > 0 AND NOT msk) AS failed FROM r)
SELECT dataset_id, pii_fields, score, CASE WHEN failed THEN 'ET-006' END AS failure_code,
  CASE WHEN failed AND (score < 40 OR (pii_fields > 0 AND NOT enc)) THEN 'CRITICAL' WHEN failed THEN 'WARNING' END AS severity FROM v""")
def pii_exposure(t):
    # The field names of an order are gathered as bits, so that its lines are shuffled once, as one number per task.
    places = F.array(*[F.lit(i) for i in range(len(FIELD_NAMES))])
    place = F.element_at(places, ((F.col("l_linenumber") + F.col("l_quantity").cast("int")) % 8 + 1).cast("int"))
    held = t.lineitem.groupBy(F.col("l_orderkey").alias("dataset_id")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1), F.coalesce(place, F.lit(len(FIELD_NAMES))))).alias("held"))
    given = F.array(*[F.when(F.col("held").bitwiseAND(F.lit(1 << i)) != 0, F.struct(F.lit(n).cast("string").alias("field")))
                      for i, n in enumerate((*FIELD_NAMES, None))])
    s = F.col("dataset_id")
    fields = held.select(s, F.inline(F.array_compact(given))).select(
        "dataset_id", "field", (s % 3 != 0).alias("encrypted"), (s % 4 != 0).alias("masked"), (s % 5 != 0).alias("access_controlled"))
    return E.pii_exposure(fields)


@query("protected_imbalance", """
WITH c AS (SELECT CAST(c_nationkey AS VARCHAR) AS grp, count(*) AS n FROM customer GROUP BY 1), r AS (SELECT grp, n / CAST(sum(n) OVER () AS DOUBLE) AS ratio FROM c)
SELECT 'nationality' AS attribute, grp, round(ratio, 6) AS ratio, 'ET-001' AS failure_code, 'WARNING' AS severity FROM r WHERE ratio < 0.05 OR ratio > 0.95 ORDER BY r.ratio, grp LIMIT 1""")
def protected_imbalance(t):
    people = t.customer.select(F.col("c_nationkey").alias("nationality"), F.col("c_mktsegment").alias("gender"), F.col("c_custkey").alias("page"))
    return rounded(E.protected_imbalance(people), "ratio")


@query("minor_rows", """
SELECT n AS minors, 'ET-005' AS failure_code, CASE WHEN n < 100 THEN 'WARNING' ELSE 'CRITICAL' END AS severity, CASE WHEN n < 100 THEN 70.0::DOUBLE ELSE 85.0::DOUBLE END AS severity_score
FROM (SELECT count(*) FILTER (WHERE p_size > 0 AND p_size < 18) AS n FROM part) WHERE n > 0""")
def minor_rows(t):
    return E.minors(t.part, "p_size")


# Governance -----------------------------------------------------------------------------------

@query("consent_check", """
WITH u AS (SELECT l_orderkey AS dataset_id, l_partkey AS source, CASE WHEN l_returnflag = 'R' THEN 'marketing' ELSE 'analytics' END AS intended_use FROM lineitem),
c AS (SELECT p_partkey AS source, CASE WHEN p_type = 'ECONOMY' THEN ['all'] WHEN p_size > 25 THEN ['analytics'] ELSE ['analytics', 'marketing'] END AS purposes,
  TIMESTAMP '2024-01-01' - to_days(p_size * 8) AS given_at, p_retailprice > 950 AS explicit FROM part WHERE p_brand <> 'Brand#7'),
j AS (SELECT u.*, c.source IS NOT NULL AS known, purposes, given_at, explicit, list_contains(purposes, intended_use) OR list_contains(purposes, 'all') AS covered FROM u LEFT JOIN c ON u.source = c.source),
d AS (SELECT dataset_id, count(*) FILTER (WHERE known AND NOT covered) AS not_covered, count(*) FILTER (WHERE NOT known) AS no_record, coalesce(bool_or(date_diff('day', given_at, TIMESTAMP '2024-01-01') > 365), false) AS outdated, coalesce(bool_or(NOT explicit), false) AS implied FROM j GROUP BY 1),
v AS (SELECT *, not_covered + no_record + outdated::INT + implied::INT AS violations FROM d)
SELECT dataset_id, CAST(violations AS BIGINT) AS violations, not_covered, no_record, outdated, implied, 'ET-005' AS failure_code, CASE WHEN violations >= 3 OR implied THEN 'CRITICAL' ELSE 'WARNING' END AS severity,
  CASE WHEN violations >= 3 OR implied THEN 20.0::DOUBLE ELSE 60.0::DOUBLE END AS score FROM v WHERE violations > 0""")
def consent_check(t):
    now = F.lit("2024-01-01").cast("timestamp_ntz")
    usage = t.lineitem.select(F.col("l_orderkey").alias("dataset_id"), F.col("l_partkey").alias("source"),
                              F.when(F.col("l_returnflag") == "R", "marketing").otherwise("analytics").alias("intended_use"))
    words = lambda *w: F.array(*[F.lit(x) for x in w])
    consents = t.part.filter("p_brand <> 'Brand#7'").select(
        F.col("p_partkey").alias("source"),
        F.when(F.col("p_type") == "ECONOMY", words("all")).when(F.col("p_size") > 25, words("analytics"))
        .otherwise(words("analytics", "marketing")).alias("purposes"),
        (now - F.make_dt_interval(F.col("p_size") * 8)).alias("given_at"), (F.col("p_retailprice") > 950).alias("explicit"))
    return E.consent(usage, consents, now)


@query("governance_explain", """
WITH m AS (SELECT p_partkey AS model_id, CASE p_type WHEN 'ECONOMY' THEN 'Decision_Tree' ELSE 'neural_network' END AS kind, p_size % 2 = 0 AS a, p_size % 3 = 0 AS b, p_size % 5 < 2 AS c, p_retailprice > 1000 AS d FROM part),
s AS (SELECT *, CAST(CASE WHEN kind = 'Decision_Tree' THEN least(100, pts + 20) ELSE pts END AS DOUBLE) AS score FROM (SELECT *, CASE WHEN a THEN 25 ELSE 0 END + CASE WHEN b THEN 30 ELSE 0 END + CASE WHEN c THEN 25 ELSE 0 END + CASE WHEN d THEN 20 ELSE 0 END AS pts FROM m))
SELECT model_id, score, concat_ws(',', CASE WHEN NOT a THEN 'feature_importance' END, CASE WHEN NOT b THEN 'shap_values' END, CASE WHEN NOT c THEN 'local_explanations' END, CASE WHEN NOT d THEN 'model_card' END) AS missing,
  'ET-004' AS failure_code, CASE WHEN score < 25 THEN 'CRITICAL' ELSE 'WARNING' END AS severity FROM s WHERE score < 50""")
def governance_explain(t):
    size = F.col("p_size")
    registry = t.part.select(
        F.col("p_partkey").alias("model_id"), F.when(F.col("p_type") == "ECONOMY", "Decision_Tree").otherwise("neural_network").alias("model_type"),
        (size % 2 == 0).alias("has_feature_importance"), (size % 3 == 0).alias("has_shap_values"),
        (size % 5 < 2).alias("has_local_explanations"), (F.col("p_retailprice") > 1000).alias("has_model_card"))
    return E.explainability(registry)


AUDITED = """
m AS (SELECT user_id AS model_id FROM events UNION SELECT c_custkey FROM customer),
a AS (SELECT model_id, coalesce(bool_or(event_type = 'view' AND value > 100), false) AS p, coalesce(bool_or(event_type = 'click' AND value > 60), false) AS i,
  coalesce(bool_or(event_type = 'purchase' AND value > 100), false) AS d, coalesce(bool_or(event_type = 'signup' AND value > 100), false) AS x,
  CAST(coalesce(date_diff('second', min(ts), max(ts)) // 86400, 0) AS INTEGER) AS retention_days FROM m LEFT JOIN events ON user_id = model_id GROUP BY 1),
b AS (SELECT *, (p::INT + i::INT + d::INT + x::INT) * 25.0::DOUBLE AS completeness FROM a),
audit AS (SELECT model_id, completeness, retention_days, round(completeness * 0.7::DOUBLE + CASE WHEN retention_days >= 25 THEN 30 ELSE 0 END, 6) AS score, CASE WHEN NOT ok THEN 'ET-007' END AS failure_code,
  CASE WHEN NOT ok THEN CASE WHEN completeness < 50 OR NOT p THEN 'CRITICAL' ELSE 'WARNING' END END AS severity FROM (SELECT *, completeness >= 75 AND retention_days >= 25 AS ok FROM b))"""


def audit_findings(t):
    kinds = {"view": "prediction_logs", "click": "input_logs", "purchase": "decision_logs", "signup": "access_logs"}
    kind = reduce(lambda c, kv: F.when(F.col("event_type") == kv[0], kv[1]).otherwise(c), kinds.items(), F.lit("other"))
    bar = F.when(F.col("event_type") == "click", 60).otherwise(100)
    # Smaller events are logs of another kind: they count for the span alone.
    kind = F.when(F.col("value") > bar, kind).otherwise("other")
    events = t.events.select(F.col("user_id").alias("model_id"), kind.alias("kind"), "ts")
    registry = t.customer.select(F.col("c_custkey").alias("model_id"))
    return rounded(E.audit_trail(events, 25, registry), "score")


@query("governance_audit", f"WITH {AUDITED} SELECT * FROM audit")
def governance_audit(t):
    return audit_findings(t)


@query("score_ethics", f"""WITH {AUDITED}
SELECT model_id, greatest(0.0::DOUBLE, 100.0::DOUBLE - sum(CASE severity WHEN 'CRITICAL' THEN 30 WHEN 'WARNING' THEN 12 ELSE 0 END)) AS score,
  greatest(0.0::DOUBLE, 100.0::DOUBLE - sum(CASE severity WHEN 'CRITICAL' THEN 30 WHEN 'WARNING' THEN 15 ELSE 0 END)) AS upload_score FROM audit GROUP BY 1""")
def score_ethics(t):
    severity = F.col("severity")
    return audit_findings(t).groupBy("model_id").agg(
        S.layer_score(severity, "ethics").alias("score"), S.layer_score(severity, "upload_ethics").alias("upload_score"))


@query("governance_compliance", """
WITH c AS (SELECT l_suppkey AS model_id, CASE l_suppkey % 5 WHEN 0 THEN 'low' WHEN 1 THEN 'Medium' WHEN 2 THEN 'high' WHEN 3 THEN 'unacceptable' ELSE 'unknown' END AS risk_level, l_discount < 0.1 AS passed FROM lineitem),
r AS (SELECT model_id, lower(max(risk_level)) AS risk_level, avg(passed::INT) AS rate FROM c GROUP BY 1),
m AS (SELECT *, 1.0 - 0.1 / CASE risk_level WHEN 'medium' THEN 1.5::DOUBLE WHEN 'high' THEN 2.0 WHEN 'unacceptable' THEN 3.0 ELSE 1.0 END AS bar FROM r)
SELECT model_id, risk_level, round(rate, 6) AS rate, 'ET-008' AS failure_code, CASE WHEN risk_level = 'unacceptable' OR rate < 0.5 THEN 'CRITICAL' ELSE 'WARNING' END AS severity FROM m WHERE rate < bar OR risk_level = 'unacceptable'""")
def governance_compliance(t):
    s = F.col("l_suppkey") % 5
    checks = t.lineitem.select(
        F.col("l_suppkey").alias("model_id"),
        F.when(s == 0, "low").when(s == 1, "Medium").when(s == 2, "high").when(s == 3, "unacceptable").otherwise("unknown").alias("risk_level"),
        (F.col("l_discount") < 0.1).alias("passed"))
    return rounded(E.compliance(checks), "rate")
