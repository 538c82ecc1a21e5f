"""Distributions (layer 3) and model health (layer 5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tableward.functions import severity as S
from tableward.operators import models as M
from tableward.operators import statistics as D
from tableward.plans.inputs import PREDICTION_LOG, prediction_log
from tableward.plans.registry import query


def log(t):
    return prediction_log(t).withColumn("cur", F.col("period") == "current")


def rounded(df, *columns, places=6):
    return df.withColumns({c: F.round(c, places) for c in columns})


LOG = f"WITH {PREDICTION_LOG}, b AS (SELECT * FROM log WHERE period = 'baseline'), c AS (SELECT * FROM log WHERE period = 'current')"
BINS = """,
ranked AS (SELECT prediction AS v, rank() OVER (ORDER BY prediction) - 1 AS r, (SELECT count(*) FROM b) AS n FROM b),
bins AS (SELECT CAST(least(r // (n // 10), 9) AS INTEGER) AS bin_no, min(v) AS low, max(v) AS high, count(*) AS n, count(*) / CAST(max(ranked.n) AS DOUBLE) AS freq FROM ranked GROUP BY 1)"""
ASSIGN = """,
assigned AS (SELECT coalesce((SELECT min(bin_no) FROM bins WHERE high >= prediction), (SELECT max(bin_no) FROM bins)) AS bin_no FROM c),
current AS (SELECT bin_no, count(*) AS n, count(*) / CAST((SELECT count(*) FROM c) AS DOUBLE) AS actual FROM assigned GROUP BY 1)"""


def halves(t):
    rows = log(t)
    return rows.filter("NOT cur"), rows.filter("cur")


@query("baseline_numeric", LOG + BINS + " SELECT bin_no, low, high, n, round(freq, 6) AS freq FROM bins")
def baseline_numeric(t):
    return rounded(D.numeric_baseline(halves(t)[0], "prediction"), "freq")


@query("baseline_categorical", LOG + " SELECT model_id AS key, count(*) AS n, round(count(*) / CAST((SELECT count(*) FROM b) AS DOUBLE), 6) AS freq FROM b GROUP BY 1")
def baseline_categorical(t):
    return rounded(D.categorical_baseline(halves(t)[0], "model_id"), "freq")


@query("baseline_update", LOG + BINS + ASSIGN + """
SELECT bin_no, low, high, CAST(bins.n + coalesce(current.n, 0) AS BIGINT) AS n,
  round((bins.n + coalesce(current.n, 0)) / CAST((SELECT count(*) FROM log) AS DOUBLE), 6) AS freq FROM bins LEFT JOIN current USING (bin_no)""")
def baseline_update(t):
    base, current = halves(t)
    return rounded(D.updated_baseline(D.numeric_baseline(base, "prediction"), current, "prediction"), "freq")


PSI_TAIL = """,
x AS (SELECT greatest(coalesce(actual, 1e-4), 1e-4) AS a, greatest(coalesce(freq, 1e-4), 1e-4) AS e FROM {0} FULL OUTER JOIN {1} USING ({2})),
s AS (SELECT sum((a - e) * ln(a / e)) AS psi FROM x)
SELECT round(psi, 6) AS psi, CASE WHEN psi >= 0.25 THEN 'CRITICAL' WHEN psi >= 0.1 THEN 'WARNING' END AS severity, CAST(least(100, floor(psi * 200)) AS DOUBLE) AS severity_score FROM s"""


@query("psi_numeric", LOG + BINS + ASSIGN + PSI_TAIL.format("bins", "current", "bin_no"))
def psi_numeric(t):
    base, current = halves(t)
    bins = D.numeric_baseline(base, "prediction")
    return rounded(D.baseline_psi(bins, D.assign_bins(current, "prediction", bins), "bin_no"), "psi")


@query("psi_categorical", """
WITH old AS (SELECT o_orderpriority AS key, count(*) / CAST((SELECT count(*) FROM orders WHERE o_orderdate < TIMESTAMP '1999-01-01') AS DOUBLE) AS freq
  FROM orders WHERE o_orderdate < TIMESTAMP '1999-01-01' GROUP BY 1),
late AS (SELECT CASE WHEN o_totalprice > 200000 AND o_orderpriority <> '5-LOW' THEN '1-URGENT' ELSE o_orderpriority END AS key FROM orders WHERE o_orderdate >= TIMESTAMP '1999-01-01'),
new AS (SELECT key, count(*) / CAST((SELECT count(*) FROM late) AS DOUBLE) AS actual FROM late GROUP BY 1)""" + PSI_TAIL.format("old", "new", "key"))
def psi_categorical(t):
    border = F.lit("1999-01-01").cast("timestamp_ntz")
    old = t.orders.filter(F.col("o_orderdate") < border)
    late = t.orders.filter(F.col("o_orderdate") >= border).select(
        F.when((F.col("o_totalprice") > 200000) & (F.col("o_orderpriority") != "5-LOW"), "1-URGENT")
        .otherwise(F.col("o_orderpriority")).alias("key"))
    expected = D.categorical_baseline(old, "o_orderpriority")
    return rounded(D.baseline_psi(expected, D.categorical_baseline(late, "key").select("key", "n"), "key"), "psi")


@query("null_rate_shift", """
WITH e AS (SELECT ts < TIMESTAMP '2024-01-16' AS old, CASE WHEN event_id % 5 = 0 AND ts >= TIMESTAMP '2024-01-16' THEN NULL ELSE value END AS value, event_type FROM events),
r AS (SELECT 'value' AS field, avg(CAST(value IS NULL AS INTEGER)) FILTER (WHERE old) AS x, avg(CAST(value IS NULL AS INTEGER)) FILTER (WHERE NOT old) AS y FROM e
  UNION ALL SELECT 'event_type', avg(CAST(event_type IS NULL AS INTEGER)) FILTER (WHERE old), avg(CAST(event_type IS NULL AS INTEGER)) FILTER (WHERE NOT old) FROM e)
SELECT field, round(x, 6) AS baseline_rate, round(y, 6) AS current_rate, round(abs(y - x), 6) AS change, abs(y - x) > 0.1 AS shifted FROM r""")
def null_rate_shift(t):
    late = F.col("ts") >= F.lit("2024-01-16").cast("timestamp_ntz")
    gaps = t.events.withColumn("value", F.when((F.col("event_id") % 5 == 0) & late, None).otherwise(F.col("value")))
    return rounded(D.null_rate_shift(gaps.filter(~late), gaps.filter(late), ["value", "event_type"]),
                   "baseline_rate", "current_rate", "change")


def _histogram(pooled: bool, source: str = "log", group: str = "model_id", value: str = "prediction") -> str:
    inside = "" if pooled else "FILTER (WHERE period = 'baseline')"
    return f"""
st AS (SELECT {group}, min({value}) {inside} AS lo0, max({value}) {inside} AS hi0, count(*) FILTER (WHERE period = 'baseline') AS nb, count(*) FILTER (WHERE period = 'current') AS nc FROM {source} GROUP BY {group}),
st2 AS (SELECT *, CASE WHEN lo0 = hi0 THEN lo0 - 0.5 ELSE lo0 END AS lo, CASE WHEN lo0 = hi0 THEN hi0 + 0.5 ELSE hi0 END AS hi, least(nb, nc, 10) AS k FROM st),
grid AS (SELECT st2.*, unnest(range(0, k)) AS bin FROM st2 WHERE k >= 2),
placed AS (SELECT {group}, period, least(CAST(floor(({value} - lo) / (hi - lo) * k) AS BIGINT), k - 1) AS bin FROM {source} JOIN st2 USING ({group}) WHERE {value} BETWEEN lo AND hi),
h AS (SELECT {group}, bin, any_value(nb) AS nb, any_value(nc) AS nc, any_value(k) AS k, count(*) FILTER (WHERE period = 'baseline') AS b, count(*) FILTER (WHERE period = 'current') AS c
  FROM grid LEFT JOIN placed USING ({group}, bin) GROUP BY {group}, bin)"""


PSI = """
psi AS (SELECT {0}, sum((c1 - b1) * ln(c1 / b1)) AS psi FROM (
  SELECT {0}, greatest(1e-10, least(1 - 1e-10, b / CAST(nb AS DOUBLE))) AS b1, greatest(1e-10, least(1 - 1e-10, c / CAST(nc AS DOUBLE))) AS c1 FROM h) GROUP BY {0})"""
ECDF = """
vals AS (SELECT model_id, prediction AS v, count(*) FILTER (WHERE period = 'baseline') AS b, count(*) FILTER (WHERE period = 'current') AS c FROM log GROUP BY ALL),
ecdf AS (SELECT model_id, v, sum(b) OVER w / CAST(sum(b) OVER (PARTITION BY model_id) AS DOUBLE) AS fb, sum(c) OVER w / CAST(sum(c) OVER (PARTITION BY model_id) AS DOUBLE) AS fc,
  lead(v) OVER (PARTITION BY model_id ORDER BY v) AS nv FROM vals WINDOW w AS (PARTITION BY model_id ORDER BY v))"""
JS = """
js AS (SELECT model_id, least(1.0::DOUBLE, sum(p * ln(p / ((p + q) / 2)) + q * ln(q / ((p + q) / 2))) / 2) AS js, sum(q * ln(q / p)) AS kl FROM (
  SELECT model_id, (b / CAST(nb AS DOUBLE) + 1e-10) / (1 + 1e-10 * k) AS p, (c / CAST(nc AS DOUBLE) + 1e-10) / (1 + 1e-10 * k) AS q FROM h) GROUP BY model_id)"""
START = f"WITH {PREDICTION_LOG},"


@query("drift_psi", f"{START}{_histogram(False)}, {PSI.format('model_id')} SELECT model_id, round(psi, 6) AS psi FROM psi")
def drift_psi(t):
    return rounded(D.drift_psi(log(t), ["model_id"], "prediction", "cur"), "psi")


@query("drift_ks", f"{START}{ECDF} SELECT model_id, round(max(abs(fb - fc)), 6) AS ks FROM ecdf GROUP BY 1")
def drift_ks(t):
    return rounded(D.drift_ks(log(t), ["model_id"], "prediction", "cur"), "ks")


@query("drift_js", f"{START}{_histogram(True)}, {JS} SELECT model_id, round(js, 6) AS js FROM js")
def drift_js(t):
    return rounded(D.drift_divergence(log(t), ["model_id"], "prediction", "cur").drop("kl"), "js")


@query("drift_kl", f"{START}{_histogram(True)}, {JS} SELECT model_id, round(kl, 6) AS kl FROM js")
def drift_kl(t):
    return rounded(D.drift_divergence(log(t), ["model_id"], "prediction", "cur").drop("js"), "kl")


@query("drift_wasserstein", f"{START}{ECDF} SELECT model_id, round(sum(abs(fb - fc) * (nv - v)), 6) AS wasserstein FROM ecdf GROUP BY 1")
def drift_wasserstein(t):
    return rounded(D.drift_wasserstein(log(t), ["model_id"], "prediction", "cur"), "wasserstein")


@query("drift_chi2", """
WITH x AS (SELECT o_orderstatus AS g, o_orderpriority AS k, count(*) FILTER (WHERE o_orderdate < TIMESTAMP '1999-01-01') AS b, count(*) FILTER (WHERE o_orderdate >= TIMESTAMP '1999-01-01') AS c FROM orders GROUP BY ALL),
y AS (SELECT *, sum(b) OVER (PARTITION BY g) AS nb, sum(c) OVER (PARTITION BY g) AS nc FROM x),
z AS (SELECT *, CAST((b + c) * nb AS DOUBLE) / (nb + nc) AS eb, CAST((b + c) * nc AS DOUBLE) / (nb + nc) AS ec FROM y)
SELECT g AS o_orderstatus, round(sum((b - eb) ** 2 / eb + (c - ec) ** 2 / ec), 6) AS chi2, count(*) - 1 AS freedom FROM z GROUP BY g""")
def drift_chi2(t):
    rows = t.orders.withColumn("cur", F.col("o_orderdate") >= F.lit("1999-01-01").cast("timestamp_ntz"))
    return rounded(D.drift_chi2(rows, ["o_orderstatus"], "o_orderpriority", "cur"), "chi2")


H2 = _histogram(True).replace("st AS", "pst AS").replace("FROM st)", "FROM pst)").replace("st2", "pst2").replace("grid", "pgrid").replace("placed", "pplaced").replace("\nh AS", "\nph AS")
DRIFT = f"""{START}{_histogram(False)}, {PSI.format('model_id')}, {ECDF}, {H2}, {JS.replace('FROM h)', 'FROM ph)')},
ks AS (SELECT model_id, max(abs(fb - fc)) AS ks FROM ecdf GROUP BY 1),
drift AS (SELECT model_id, psi, ks, js, psi >= 0.25 OR ks >= 0.2 AS drift_detected,
  CASE WHEN psi >= 0.5 OR ks >= 0.4 THEN 'CRITICAL' WHEN psi >= 0.25 OR ks >= 0.2 THEN 'WARNING' END AS severity FROM psi JOIN ks USING (model_id) JOIN js USING (model_id))"""


@query("prediction_drift", DRIFT + " SELECT model_id, round(psi, 6) AS psi, round(ks, 6) AS ks, round(js, 6) AS js, drift_detected, severity FROM drift")
def prediction_drift(t):
    return rounded(D.prediction_drift(log(t), ["model_id"], "prediction", "cur"), "psi", "ks", "js")


LONG = """
long AS (SELECT model_id, period, 'prediction' AS feature, prediction AS value FROM log UNION ALL SELECT model_id, period, 'confidence', confidence FROM log
  UNION ALL SELECT model_id, period, 'latency_ms', latency_ms FROM log UNION ALL SELECT model_id, period, 'f_user', f_user FROM log)"""
FEATURES = ["prediction", "confidence", "latency_ms", "f_user"]


@query("feature_drift", f"{START}{LONG}, {_histogram(False, 'long', 'model_id, feature', 'value')}, {PSI.format('model_id, feature')}" + """,
r AS (SELECT model_id, count(*) FILTER (WHERE psi >= 0.25) AS drifted, max(psi) AS max_psi, avg(psi) AS avg_psi, coalesce(string_agg(feature, ',' ORDER BY feature) FILTER (WHERE psi >= 0.25), '') AS affected FROM psi GROUP BY 1)
SELECT model_id, drifted, round(max_psi, 6) AS max_psi, round(avg_psi, 6) AS avg_psi, drifted / 4.0::DOUBLE AS drift_ratio, affected,
  CASE WHEN drifted > 0 THEN CASE WHEN drifted / 4.0 >= 0.5 OR max_psi >= 0.5 THEN 'CRITICAL' ELSE 'WARNING' END END AS severity FROM r""")
def feature_drift(t):
    return rounded(D.feature_drift(D.feature_psi(log(t), ["model_id"], FEATURES, "cur"), ["model_id"], len(FEATURES)), "max_psi", "avg_psi")


# Model health ---------------------------------------------------------------------------------

MEANS = """
means AS (SELECT model_id, avg(confidence) FILTER (WHERE period = 'baseline') AS conf_b, avg(confidence) FILTER (WHERE period = 'current') AS conf_c,
  avg(latency_ms) FILTER (WHERE period = 'baseline') AS lat_b, avg(latency_ms) FILTER (WHERE period = 'current') AS lat_c,
  avg(CAST(is_error AS INTEGER)) FILTER (WHERE period = 'baseline') AS err_b, avg(CAST(is_error AS INTEGER)) FILTER (WHERE period = 'current') AS err_c FROM log GROUP BY 1)"""


def means(t):
    return M.period_means(log(t), "model_id", "period", ["confidence", "latency_ms", "is_error"])


@query("model_staleness", """
WITH r AS (SELECT o_custkey AS model_id, CAST(date_diff('day', max(o_orderdate), TIMESTAMP '2001-10-01') AS INTEGER) AS age_days FROM orders GROUP BY 1)
SELECT model_id, age_days, 'ML-003' AS failure_code, CASE WHEN age_days >= 90 THEN 'CRITICAL' WHEN age_days >= 60 THEN 'WARNING' END AS severity, false AS blocking,
  CASE WHEN age_days >= 90 THEN 50.0::DOUBLE WHEN age_days >= 60 THEN 75.0::DOUBLE ELSE 100.0::DOUBLE END AS score FROM r""")
def model_staleness(t):
    trained = t.orders.select(F.col("o_custkey").alias("model_id"), "o_orderdate")
    return M.staleness(trained, "model_id", "o_orderdate", F.lit("2001-10-01").cast("timestamp_ntz"))


def _health_sql(code: str, columns: str, critical: str, warning: str, scores: tuple, source: str = "means") -> str:
    return f"""SELECT model_id, {columns}, '{code}' AS failure_code, CASE WHEN {critical} THEN 'CRITICAL' WHEN {warning} THEN 'WARNING' END AS severity, coalesce({critical}, false) AS blocking,
  CASE WHEN {critical} THEN {scores[0]}::DOUBLE WHEN {warning} THEN {scores[1]}::DOUBLE ELSE 100.0::DOUBLE END AS score FROM {source}"""


CONF = _health_sql("ML-004", "round(conf_b - conf_c, 6) AS drop", "conf_b - conf_c >= 0.2", "conf_b - conf_c >= 0.1", (40.0, 70.0))
LAT = _health_sql("ML-005", "round(lat_c / lat_b, 6) AS ratio, round(lat_c, 6) AS current_ms", "(lat_c / lat_b >= 5 OR lat_c >= 1000)", "lat_c / lat_b >= 2", (30.0, 65.0))
ERR = _health_sql("ML-006", "round(err_c - err_b, 6) AS increase, round(err_c, 6) AS current_rate", "(err_c - err_b >= 0.1 OR err_c >= 0.2)", "err_c - err_b >= 0.05", (25.0, 60.0))


@query("model_confidence", f"{START}{MEANS} {CONF}")
def model_confidence(t):
    return rounded(M.confidence_drop(means(t), "model_id", "confidence"), "drop")


@query("model_latency", f"{START}{MEANS} {LAT}")
def model_latency(t):
    return rounded(M.latency_spike(means(t), "model_id", "latency_ms"), "ratio", "current_ms")


@query("model_latency_percentiles", f"""WITH {PREDICTION_LOG}
SELECT model_id, period, quantile_disc(latency_ms, 0.5) AS p50, quantile_disc(latency_ms, 0.95) AS p95, quantile_disc(latency_ms, 0.99) AS p99
FROM log GROUP BY 1, 2""")
def model_latency_percentiles(t):
    return M.latency_percentiles(log(t), "model_id", "period", "latency_ms")


@query("model_error_rate", f"{START}{MEANS} {ERR}")
def model_error_rate(t):
    return rounded(M.error_rate(means(t), "model_id", "is_error"), "increase", "current_rate")


@query("model_compat", """
WITH e AS (SELECT l_suppkey AS model_id, 'f' || l_linenumber AS feature, max(CASE WHEN l_tax > 0.06 THEN 'double' ELSE 'bigint' END) AS type FROM lineitem WHERE l_linestatus = 'F' GROUP BY ALL),
a AS (SELECT l_suppkey AS model_id, 'f' || l_linenumber AS feature, max(CASE WHEN l_tax > 0.07 THEN 'double' ELSE 'bigint' END) AS type FROM lineitem WHERE l_quantity > 45 GROUP BY ALL),
means AS (SELECT model_id, count(*) FILTER (WHERE a.type IS NULL) AS missing, count(*) FILTER (WHERE e.type IS NULL) AS extra, count(*) FILTER (WHERE a.type <> e.type) AS mismatched
  FROM e FULL OUTER JOIN a USING (model_id, feature) GROUP BY 1)
""" + _health_sql("ML-007", "missing, extra, mismatched", "missing > 0", "mismatched > 0", (20.0, 60.0)))
def model_compat(t):
    def features(rows, limit):
        return rows.groupBy(F.col("l_suppkey").alias("model_id"), F.concat(F.lit("f"), "l_linenumber").alias("feature")).agg(
            F.max(F.when(F.col("l_tax") > limit, "double").otherwise("bigint")).alias("type"))
    return M.compatibility(features(t.lineitem.filter("l_linestatus = 'F'"), 0.06),
                           features(t.lineitem.filter("l_quantity > 45"), 0.07), "model_id")


def signals(t):
    """Flags per model from the other checks; performance is the share of right predictions."""
    rows, averages = log(t), means(t)
    drift = D.prediction_drift(rows, ["model_id"], "prediction", "cur")
    stale = M.staleness(rows, "model_id", "ts", F.lit("2024-03-31 00:30:00").cast("timestamp_ntz"))
    errors = M.error_rate(averages, "model_id", "is_error")
    return (
        averages.select("model_id", (1.0 - F.col("is_error_cur")).alias("performance"))
        .join(drift.select("model_id", F.col("drift_detected").alias("drift_detected")), "model_id", "left")
        .join(stale.select("model_id", F.col("severity").isNotNull().alias("model_stale")), "model_id", "left")
        .join(errors.select("model_id", F.coalesce(F.col("severity") == "CRITICAL", F.lit(False)).alias("high_error_rate")),
              "model_id", "left")
    )


RETRAIN = f"""{DRIFT}, {MEANS},
stale AS (SELECT model_id, date_diff('second', max(ts), TIMESTAMP '2024-03-31 00:30:00') // 86400 >= 60 AS model_stale FROM log GROUP BY 1),
retrain AS (SELECT model_id, concat_ws(',', CASE WHEN 1 - err_c < 0.7 THEN 'low_performance' END, CASE WHEN drift_detected THEN 'drift_detected' END, CASE WHEN model_stale THEN 'model_stale' END,
    CASE WHEN err_c - err_b >= 0.1 OR err_c >= 0.2 THEN 'high_error_rate' END) AS signals,
  CAST((1 - err_c < 0.7)::INT + drift_detected::INT + model_stale::INT + (err_c - err_b >= 0.1 OR err_c >= 0.2)::INT AS INTEGER) AS signal_count
  FROM means JOIN drift USING (model_id) JOIN stale USING (model_id))"""


@query("model_retrain", RETRAIN + """
SELECT model_id, signals, signal_count, 'ML-008' AS failure_code, CASE WHEN signal_count >= 3 THEN 'CRITICAL' WHEN signal_count = 2 THEN 'WARNING' WHEN signal_count = 1 THEN 'INFO' END AS severity,
  CASE WHEN signal_count >= 3 THEN 30.0::DOUBLE WHEN signal_count = 2 THEN 55.0::DOUBLE WHEN signal_count = 1 THEN 75.0::DOUBLE ELSE 100.0::DOUBLE END AS score FROM retrain""")
def model_retrain(t):
    return M.retraining(signals(t), "model_id", "performance", ["drift_detected", "model_stale", "high_error_rate"])


@query("score_model", f"""{START}{MEANS}, f AS (SELECT model_id, severity FROM ({CONF}) UNION ALL SELECT model_id, severity FROM ({LAT}) UNION ALL SELECT model_id, severity FROM ({ERR}))
SELECT model_id, greatest(0.0::DOUBLE, 100.0::DOUBLE - sum(CASE severity WHEN 'CRITICAL' THEN 25 WHEN 'WARNING' THEN 10 WHEN 'INFO' THEN 2 ELSE 0 END)) AS score FROM f GROUP BY 1""")
def score_model(t):
    averages = means(t)
    found = [check.select("model_id", "severity") for check in (
        M.confidence_drop(averages, "model_id", "confidence"), M.latency_spike(averages, "model_id", "latency_ms"),
        M.error_rate(averages, "model_id", "is_error"))]
    return found[0].unionByName(found[1]).unionByName(found[2]).groupBy("model_id").agg(
        S.layer_score(F.col("severity"), "model").alias("score"))
