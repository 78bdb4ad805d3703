"""Queries for data quality (Q-01..Q-19, D-50)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillroll.operators import quality as Q
from tillroll.operators import sales as S
from tillroll.plans.registry import plan
from tillroll.plans.tables import AS_OF, EVENTS_AS_OF

_GAP = """gap AS (SELECT order_id, CASE WHEN order_id % 50 <> 0 THEN customer_id END AS customer_id, CASE WHEN order_id % 3 <> 0 THEN total_amount::DOUBLE END AS amount,
  CASE WHEN order_id % 200 <> 0 THEN order_date END AS created_at, payment_method FROM ord)"""


def gaps(t):
    k = F.col("order_id")
    return t.ord.select(k, F.when(k % 50 != 0, F.col("customer_id")).alias("customer_id"), F.when(k % 3 != 0, F.col("total_amount").cast("double")).alias("amount"),
                        F.when(k % 200 != 0, F.col("order_date")).alias("created_at"), "payment_method")


_LIM = {"order_id": ("critical", 0), "customer_id": ("critical", 0), "amount": ("medium", 20), "created_at": ("high", 1), "payment_method": ("medium", 20)}
_COMP = " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) FILTER ({c} IS NULL) AS null_count, (count(*) FILTER ({c} IS NULL) * 20000 + count(*)) // (2 * count(*)) / 100.0::DOUBLE AS null_percentage, '{s}' AS severity, "
                           f"{v}.0::DOUBLE AS threshold, (count(*) FILTER ({c} IS NULL) * 20000 + count(*)) // (2 * count(*)) / 100.0::DOUBLE <= {v} AS passed FROM gap" for c, (s, v) in _LIM.items())


@plan("q02_completeness", f"WITH {_GAP} {_COMP}")
def _(t):
    return Q.completeness(gaps(t))


@plan("q02_completeness_total", f"WITH {_GAP}, c AS ({_COMP}) SELECT round(100 - avg(null_percentage), 2) AS overall_completeness, count(*) FILTER (NOT passed) AS issues FROM c")
def _(t):
    return Q.completeness_total(gaps(t))


def _rules_sql(table, rules):
    return " UNION ALL ".join(f"SELECT '{n}' AS rule, count(*) FILTER (NOT coalesce({r}, FALSE)) AS failed_records, count(*) AS total_records, (count(*) FILTER (NOT coalesce({r}, FALSE)) * 20000 + count(*)) // (2 * count(*)) / 100.0::DOUBLE AS failed_pct, "
                              f"count(*) FILTER (NOT coalesce({r}, FALSE)) = 0 AS passed FROM {table}" for n, r in rules.items())


_ACC = {"amount_positive": "total_amount > 100000", "known_status": "order_status IN ('F', 'O')", "method_pattern": "regexp_matches(payment_method, '^[1-4]-')"}


@plan("q03_accuracy", _rules_sql("ord", _ACC))
def _(t):
    return Q.rule_check(t.ord, {"amount_positive": "total_amount > 100000", "known_status": F.col("order_status").isin("F", "O"), "method_pattern": F.col("payment_method").rlike("^[1-4]-")})


@plan("q03_duplicate_rows", """SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT customer_id, order_status, payment_method FROM ord)) AS duplicates, count(*) AS total FROM ord""")
def _(t):
    return Q.duplicate_rows(t.ord.select("customer_id", "order_status", "payment_method"))


_SPK = "spk AS (SELECT (CASE WHEN order_id % 15 = 0 THEN total_amount * 9 ELSE total_amount END)::DOUBLE AS amount, (order_id % 90)::DOUBLE AS score FROM ord)"


def spiked(t):
    return t.ord.select(F.when(F.col("order_id") % 15 == 0, F.col("total_amount") * 9).otherwise(F.col("total_amount")).cast("double").alias("amount"),
                        (F.col("order_id") % 90).cast("double").alias("score"))


@plan("q03_extreme_outliers", f"WITH {_SPK}, o AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) FILTER ({c} NOT BETWEEN q[1] - 3 * (q[2] - q[1]) AND q[2] + 3 * (q[2] - q[1])) AS outliers, count(*) AS total FROM spk, (SELECT quantile_cont({c}, [0.25, 0.75]) AS q FROM spk)"
    for c in ("amount", "score")) + ") SELECT *, outliers::DOUBLE / total AS outlier_share, outliers::DOUBLE / total > 0.05 AS flagged FROM o")
def _(t):
    return Q.extreme_outliers(spiked(t))


@plan("q04_consistency", """WITH a AS (SELECT CASE WHEN order_id % 40 = 0 THEN 'soon' ELSE strftime(order_date, '%Y-%m-%d') END AS d, CASE WHEN order_id % 2 = 0 THEN lower(payment_method) ELSE payment_method END AS m,
    CASE WHEN order_id % 9 = 0 THEN 'a b' ELSE order_id::VARCHAR END AS i FROM ord)
  SELECT 'date_format' AS "check", 'd' AS column_name, count(*) FILTER (try_cast(d AS TIMESTAMP) IS NULL) AS failed, FALSE AS passed FROM a
  UNION ALL SELECT 'case_variants', 'm', count(DISTINCT m) - count(DISTINCT lower(m)), FALSE FROM a UNION ALL SELECT 'id_pattern', 'i', count(*) FILTER (NOT regexp_matches(i, '^[a-zA-Z0-9_-]+$')), FALSE FROM a""")
def _(t):
    k = F.col("order_id")
    rows = t.ord.select(F.when(k % 40 == 0, "soon").otherwise(F.date_format("order_date", "yyyy-MM-dd")).alias("d"),
                        F.when(k % 2 == 0, F.lower("payment_method")).otherwise(F.col("payment_method")).alias("m"), F.when(k % 9 == 0, "a b").otherwise(k.cast("string")).alias("i"))
    return Q.consistency(rows, ["d"], ["m"], ["i"])


@plan("q05_configured_rules", _rules_sql("ord", {"dated_before_cutoff": "order_date < '2001-01-01'", "amount_range": "total_amount >= 5000 AND total_amount <= 490000"}))
def _(t):
    return Q.rule_check(t.ord, {"dated_before_cutoff": "order_date < '2001-01-01'", "amount_range": Q.range_rule("total_amount", 5000, 490000)})


def _prof(c, kind):
    n = f"{c}::DOUBLE" if kind == "num" else "NULL::DOUBLE"
    s = f"length({c})::INTEGER" if kind == "text" else "NULL::INTEGER"
    return (f"SELECT '{c}' AS column_name, count(*) AS row_count, count(*) FILTER ({c} IS NULL) AS null_count, count(DISTINCT {c}) AS unique_count, min({n}) AS min, max({n}) AS max, round(avg({n}), 4) AS mean, "
            f"round(stddev_samp({n}), 4) AS std, min({s}) AS min_length, max({s}) AS max_length, round(avg({s}), 4) AS avg_length, round(quantile_cont({n}, 0.25), 4) AS q1, round(quantile_cont({n}, 0.5), 4) AS median, "
            f"round(quantile_cont({n}, 0.75), 4) AS q3, (count(*) FILTER ({c} IS NULL) * 20000 + count(*)) // (2 * count(*)) / 100.0::DOUBLE AS null_percentage FROM gap")


@plan("q06_profile", f"WITH {_GAP} " + " UNION ALL ".join(_prof(c, k) for c, k in (("order_id", "num"), ("customer_id", "num"), ("amount", "num"), ("created_at", "ts"), ("payment_method", "text"))))
def _(t):
    return Q.profile(gaps(t))


@plan("q06_top_values", """WITH c AS (SELECT 'category' AS column_name, category AS value, count(*) AS n FROM prd GROUP BY ALL UNION ALL SELECT 'brand', brand, count(*) FROM prd GROUP BY ALL)
  SELECT *, (row_number() OVER (PARTITION BY column_name ORDER BY n DESC, value))::INTEGER AS position FROM c QUALIFY position <= 5""")
def _(t):
    return Q.top_values(t.prd, ["category", "brand"])


@plan("q07_correlations", """WITH c AS (SELECT 'quantity' AS column1, 'item_total' AS column2, round(corr(quantity::DOUBLE, item_total::DOUBLE), 6) AS correlation FROM itm
  UNION ALL SELECT 'quantity', 'discount', round(corr(quantity::DOUBLE, discount::DOUBLE), 6) FROM itm UNION ALL SELECT 'item_total', 'discount', round(corr(item_total::DOUBLE, discount::DOUBLE), 6) FROM itm)
  SELECT *, abs(correlation) > 0.8 AS high FROM c""")
def _(t):
    return Q.correlations(t.itm, ["quantity", "item_total", "discount"])


_FACT = """fct AS (SELECT quantity - event_id % 4 AS quantity_ordered, event_id % 3 AS quantity_shipped, event_id % 2 AS quantity_returned, 0 AS quantity_cancelled, total_amount_vnd AS gross_sales_amount_vnd,
  total_amount_vnd - discount_amount_vnd AS net_sales_amount_vnd, discount_amount_vnd FROM sev)"""


@plan("q08_constraints", f"WITH {_FACT} " + _rules_sql("fct", Q.CONSTRAINTS["fact_sales"]))
def _(t):
    k = F.col("event_id")
    rows = t.sev.select((F.col("quantity") - k % 4).alias("quantity_ordered"), (k % 3).alias("quantity_shipped"), (k % 2).alias("quantity_returned"), F.lit(0).alias("quantity_cancelled"),
                        F.col("total_amount_vnd").alias("gross_sales_amount_vnd"), (F.col("total_amount_vnd") - F.col("discount_amount_vnd")).alias("net_sales_amount_vnd"), "discount_amount_vnd")
    return Q.rule_check(rows, Q.CONSTRAINTS["fact_sales"])


@plan("q08_voucher_constraints", _rules_sql("vch", Q.CONSTRAINTS["vouchers"]))
def _(t):
    return Q.rule_check(t.vch, Q.CONSTRAINTS["vouchers"])


def messages(t):
    """Order messages as JSON with planted defects: broken text, missing and extra fields, wrong types and values."""
    k = F.col("order_id")
    status = F.when(k % 10 == 3, "lost").otherwise("shipped")
    ident = F.when(k % 10 == 4, F.concat(F.lit("bad id "), k)).otherwise(k.cast("string"))
    body = F.concat(F.lit('{"order_id":"'), ident, F.lit('",'), F.when(k % 10 == 5, F.concat(F.lit('"customer_id":'), "customer_id", F.lit(","))).when(k % 10 == 6, "").otherwise(
        F.concat(F.lit('"customer_id":"'), "customer_id", F.lit('",'))), F.lit('"order_status":"'), status, F.lit('",'),
        F.when(k % 10 == 7, '"note":"x",').otherwise(""), F.lit('"order_approved_at":null,"timestamp":"'), F.date_format("order_date", "yyyy-MM-dd"), F.lit('"}'))
    return t.ord.select(k, F.when(k % 10 == 8, F.substring(body, 1, 20)).otherwise(body).alias("payload"))


_ERR = """SELECT order_id, CASE order_id % 10 WHEN 3 THEN 'enum:order_status' WHEN 4 THEN 'pattern:order_id' WHEN 5 THEN 'type:customer_id' WHEN 6 THEN 'required:customer_id' WHEN 7 THEN 'additional:note' WHEN 8 THEN 'malformed' ELSE '' END AS errors FROM ord"""


@plan("q09_contract_strict", f"SELECT order_id, errors, '' AS warnings, errors = '' AS is_valid FROM ({_ERR})")
def _(t):
    return _joined(Q.check_contract(messages(t), "payload", Q.CONTRACTS["orders"]))


@plan("q09_contract_moderate", f"""SELECT order_id, CASE WHEN order_id % 10 IN (5, 6, 8) THEN errors ELSE '' END AS errors, CASE WHEN order_id % 10 IN (3, 4, 7) THEN errors ELSE '' END AS warnings, order_id % 10 NOT IN (5, 6, 8) AS is_valid FROM ({_ERR})""")
def _(t):
    from dataclasses import replace
    return _joined(Q.check_contract(messages(t), "payload", replace(Q.CONTRACTS["orders"], level="moderate")))


def _joined(df):
    return df.select("order_id", F.array_join("errors", ",").alias("errors"), F.array_join("warnings", ",").alias("warnings"), "is_valid")


@plan("q10_z_anomalies", f"WITH {_SPK}, s AS (SELECT avg(amount) AS a, stddev_pop(amount) AS d, avg(score) AS a2, stddev_pop(score) AS d2 FROM spk) " + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) FILTER (abs({c} - {a}) > 3 * {d}) AS anomaly_count, (count(*) FILTER (abs({c} - {a}) > 3 * {d}) * 20000 + count(*)) // (2 * count(*)) / 100.0::DOUBLE AS anomaly_percentage FROM spk, s" for c, a, d in (("amount", "a", "d"), ("score", "a2", "d2"))))
def _(t):
    return Q.z_anomalies(spiked(t), ["amount", "score"])


@plan("q10_busy_hours", """WITH g AS (SELECT hour(ts)::INTEGER AS hour_of_day, count(*) AS n FROM act GROUP BY 1) SELECT * FROM g WHERE n > (SELECT avg(n) + 1.0 * stddev_samp(n) FROM g)""")
def _(t):
    return Q.busy_hours(t.act, "ts", 1.0)


@plan("q11_sql_check", "SELECT 'no_negative_totals' AS check_name, count(*)::DOUBLE AS value, count(*) = 0 AS passed FROM ord WHERE total_amount < 1000")
def _(t):
    return Q.sql_check(t.spark, "no_negative_totals", "SELECT count(*) FROM {o} WHERE total_amount < 1000", views={"o": t.ord})


@plan("q12_score", f"WITH {_GAP}, c AS ({_COMP}) SELECT count(*) AS total_checks, count(*) FILTER (passed) AS passed_checks, count(*) FILTER (passed) * 100.0::DOUBLE / count(*) AS quality_score, CASE WHEN count(*) FILTER (passed) * 100.0 / count(*) >= 80 THEN 'good' WHEN count(*) FILTER (passed) * 100.0 / count(*) >= 60 THEN 'warning' ELSE 'critical' END AS status FROM c")
def _(t):
    return Q.score(Q.completeness(gaps(t)))


@plan("q13_freshness", f"""SELECT 'orders' AS table_name, max(order_date) AS latest, floor((epoch(TIMESTAMP '{AS_OF}') - epoch(max(order_date))) / 60)::BIGINT AS age_minutes, 120 AS limit_minutes, (epoch(TIMESTAMP '{AS_OF}') - epoch(max(order_date))) / 60 <= 120 AS fresh FROM ord
  UNION ALL SELECT 'items', max(ship_date), floor((epoch(TIMESTAMP '{AS_OF}') - epoch(max(ship_date))) / 60)::BIGINT, 30, floor((epoch(TIMESTAMP '{AS_OF}') - epoch(max(ship_date))) / 60) <= 30 FROM itm WHERE ship_date < '2001-07-30'""")
def _(t):
    return Q.freshness({"orders": (t.ord, "order_date", 120), "items": (t.itm.where("ship_date < '2001-07-30'"), "ship_date", 30)}, AS_OF)


@plan("q13_freshness_decision", """WITH a AS (SELECT count(*) FILTER (order_date >= TIMESTAMP '2001-08-01' - INTERVAL 30 DAY) AS f FROM ord), b AS (SELECT count(*) FILTER (ship_date >= TIMESTAMP '2001-08-01' - INTERVAL 30 DAY) AS f FROM itm WHERE ship_date < '2001-01-01')
  SELECT ((a.f > 0)::INTEGER + (b.f > 0)::INTEGER) * 100.0::DOUBLE / 2 AS quality_score, a.f + b.f AS total_fresh_records, CASE WHEN ((a.f > 0)::INTEGER + (b.f > 0)::INTEGER) = 2 THEN 'proceed' WHEN ((a.f > 0)::INTEGER + (b.f > 0)::INTEGER) = 1 THEN 'proceed_with_caution' ELSE 'skip_processing' END AS recommendation FROM a, b""")
def _(t):
    return Q.freshness_decision(S.freshness_ratio({"orders": (t.ord, "order_date"), "items": (t.itm.where("ship_date < '2001-01-01'"), "ship_date")}, AS_OF, 30))


def _drift_sql(c):
    return (f"SELECT '{c}' AS column_name, a.m AS reference_mean, a.s AS reference_std, b.m AS current_mean, b.s AS current_std, coalesce(abs(b.m - a.m) / nullif(abs(a.m), 0), 0) AS mean_change, coalesce(abs(b.s - a.s) / nullif(abs(a.s), 0), 0) AS std_change "
            f"FROM (SELECT avg({c}) AS m, stddev_samp({c}) AS s FROM dr WHERE NOT cur) a, (SELECT avg({c}) AS m, stddev_samp({c}) AS s FROM dr WHERE cur) b")


_DRIFT = f"""dr AS (SELECT (CASE WHEN order_date >= '2000-01-01' THEN total_amount * 1.3 ELSE total_amount END)::DOUBLE AS amount, (order_id % 90)::DOUBLE AS score, order_date >= '2000-01-01' AS cur FROM ord),
  d0 AS ({_drift_sql('amount')} UNION ALL {_drift_sql('score')}), dd AS (SELECT column_name, round(reference_mean, 6) AS reference_mean, round(reference_std, 6) AS reference_std, round(current_mean, 6) AS current_mean, round(current_std, 6) AS current_std,
  round(mean_change, 6) AS mean_change, round(std_change, 6) AS std_change, mean_change > 0.1 OR std_change > 0.1 AS drift_detected FROM d0)"""


def drifted(t):
    def part(test, factor):
        return t.ord.where(test).select((F.col("total_amount") * F.lit(factor).cast("decimal(3,1)")).cast("double").alias("amount"), (F.col("order_id") % 90).cast("double").alias("score"))
    return Q.drift(part("order_date < '2000-01-01'", "1.0"), part("order_date >= '2000-01-01'", "1.3"), ["amount", "score"])


@plan("q14_drift", f"WITH {_DRIFT} SELECT * FROM dd")
def _(t):
    return drifted(t)


@plan("q14_drift_summary", f"WITH {_DRIFT} SELECT count(*) AS total_features, count(*) FILTER (drift_detected) AS drifted_features, count(*) FILTER (drift_detected) * 100.0::DOUBLE / count(*) AS drift_percentage FROM dd")
def _(t):
    return Q.drift_summary(drifted(t))


@plan("q16_dimension_completeness", f"WITH {_GAP} " + " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) AS total, count({c}) AS filled, count({c})::DOUBLE / count(*) AS completeness FROM gap" for c in ("customer_id", "amount", "created_at")))
def _(t):
    return Q.dimension_completeness(gaps(t), ["customer_id", "amount", "created_at"])


@plan("q16_price_consistency", """SELECT 'price_consistency' AS check_name, count(*) AS total_checked, count(*) FILTER (abs(unit_price_vnd + CASE WHEN event_id % 8 = 0 THEN 500 ELSE 0 END - unit_price_usd * 24000) < 100) AS valid_count,
  count(*) FILTER (abs(unit_price_vnd + CASE WHEN event_id % 8 = 0 THEN 500 ELSE 0 END - unit_price_usd * 24000) < 100)::DOUBLE / count(*) AS accuracy_rate FROM sev""")
def _(t):
    rows = t.sev.withColumn("vnd", F.col("unit_price_vnd") + F.when(F.col("event_id") % 8 == 0, 500).otherwise(0))
    return Q.accuracy_rate(rows, "price_consistency", Q.price_consistent("vnd", "unit_price_usd"))


@plan("q17_uniqueness_rates", """WITH a AS (SELECT customer_id % 1400 AS k, CASE WHEN customer_id % 60 = 0 THEN ' ' ELSE customer_name END AS n, CASE WHEN customer_id % 12 = 0 THEN 'nobody' ELSE 'c' || customer_id || '@mail.vn' END AS e FROM cst),
  r AS (SELECT (count(*) - count(DISTINCT k))::DOUBLE / count(*) AS d, count(*) FILTER (trim(n) = '')::DOUBLE / count(*) AS m, count(*) FILTER (NOT contains(e, '@'))::DOUBLE / count(*) AS b FROM a)
  SELECT 'duplicate_rate' AS check_name, d AS rate, 0.01::DOUBLE AS threshold, d <= 0.01 AS passed FROM r UNION ALL SELECT 'empty_rate', m, 0.02, m <= 0.02 FROM r UNION ALL SELECT 'bad_email_rate', b, 0.05, b <= 0.05 FROM r""")
def _(t):
    k = F.col("customer_id")
    rows = t.cst.select((k % 1400).alias("k"), F.when(k % 60 == 0, " ").otherwise(F.col("customer_name")).alias("n"), F.when(k % 12 == 0, "nobody").otherwise(F.concat(F.lit("c"), k, F.lit("@mail.vn"))).alias("e"))
    return Q.uniqueness_rates(rows, "k", "n", "e")


@plan("q18_reconcile", """WITH s AS (SELECT 0 AS step, 'raw' AS stage, count(*) AS n FROM ord UNION ALL SELECT 1, 'clean', count(*) FROM ord WHERE order_id % 29 <> 0 UNION ALL SELECT 2, 'lines', count(*) FROM itm)
  SELECT *, CASE WHEN step > 0 THEN least(100, n * 100.0::DOUBLE / lag(n) OVER (ORDER BY step)) END AS success_rate FROM s""")
def _(t):
    return Q.reconcile({"raw": t.ord, "clean": t.ord.where("order_id % 29 <> 0"), "lines": t.itm})


@plan("q19_recent_results", f"""SELECT activity_type AS check_name, count(*) AS total, count(*) FILTER (value < 50) AS passed, count(*) FILTER (NOT value < 50) AS failed, count(*) FILTER (value < 50) * 100.0::DOUBLE / count(*) AS success_rate
  FROM act WHERE ts >= TIMESTAMP '{EVENTS_AS_OF}' - INTERVAL 100 HOUR GROUP BY 1""")
def _(t):
    results = t.act.select(F.col("activity_type").alias("check_name"), F.col("ts").alias("checked_at"), (F.col("value") < 50).alias("passed"))
    return Q.recent_results(results, EVENTS_AS_OF, 100)


@plan("d50_feature_summary", f"WITH {_GAP} SELECT column_name, null_percentage, unique_count, min, max, mean, std FROM (" + " UNION ALL ".join(_prof(c, k) for c, k in (("customer_id", "num"), ("amount", "num"))) + ")")
def _(t):
    return Q.profile(gaps(t).select("customer_id", "amount")).select("column_name", "null_percentage", "unique_count", "min", "max", "mean", "std")


