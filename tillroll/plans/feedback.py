"""Queries for feedback (D-31..D-41). The lexicon and extra keywords are words that occur in the given texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillroll.functions import text as X
from tillroll.operators import feedback as B
from tillroll.plans.functions import sql_fold
from tillroll.operators.table_functions import register_table_functions
from tillroll.plans.registry import plan

NOW = "2024-01-31 00:00:00"
LEXICON = B.LEXICON | {"the": 0.25, "and": 0.25, "of": -0.5, "is": -1.0, "der": 0.5, "die": -0.75, "ist": 0.5, "le": 0.5, "la": -0.5, "et": 0.25, "el": 0.5, "de": -0.5, "que": 0.25}
TOPICS = ["the and", "der", "la", "of the", "que", "nothing here"]


def analysed(t):
    clv = t.raw("customer").select(F.col("c_custkey").alias("customer_id"), (F.col("c_acctbal") * 1000).alias("clv_prediction"))
    return B.analyse(t.fbk, clv, LEXICON)


_CLEAN = f"lower({sql_fold(chr(39).join(['regexp_replace(text, ', '[^\\p{L}\\p{N}_\\s\\x{00C0}-\\x{017F}\\x{1EA0}-\\x{1EF9}]', ', ', ' ', ', ', 'g', ')']))})"
_LEXSQL = "map {" + ", ".join(f"'{k}': {v}::DOUBLE" for k, v in LEXICON.items()) + "}"


def _hits(words):
    return "(" + " + ".join(f"contains(clean, '{w}')::INTEGER" for w in words) + ")"


_CATS = "[" + ", ".join(f"CASE WHEN {_hits(w)} >= 2 THEN '{k}' END" for k, w in B.CATEGORIES.items()) + "]"
_WORDS = "list_filter(string_split(clean, ' '), lambda w: w <> '')"
_ANA = f"""cl AS (SELECT *, {_CLEAN} AS clean FROM fbk),
  lx AS (SELECT {_LEXSQL} AS m), raw AS (SELECT cl.*, list_sum(list_transform({_WORDS}, lambda w: coalesce(m[w], 0.0::DOUBLE))) AS r0 FROM cl, lx),
  sc AS (SELECT *, round(coalesce(r0, 0) / sqrt(coalesce(r0, 0) * coalesce(r0, 0) + 15), 6) AS sentiment_score FROM raw),
  lb AS (SELECT sc.*, CASE WHEN sentiment_score >= 0.8 THEN 'very_positive' WHEN sentiment_score >= 0.3 THEN 'positive' WHEN sentiment_score >= -0.3 THEN 'neutral' WHEN sentiment_score >= -0.8 THEN 'negative'
    ELSE 'very_negative' END AS sentiment_label, c_acctbal * 1000 AS clv FROM sc LEFT JOIN customer ON c_custkey = customer_id),
  pr AS (SELECT *, CASE WHEN sentiment_label IN ('negative', 'very_negative') AND coalesce(clv, 0) > 5000000 THEN 'critical' WHEN sentiment_label IN ('negative', 'very_negative') THEN 'high'
    WHEN sentiment_label = 'neutral' THEN 'medium' ELSE 'low' END AS priority, list_filter({_CATS}, lambda x: x IS NOT NULL) AS c0 FROM lb),
  ana AS (SELECT *, priority IN ('critical', 'high') AS action_required, CASE WHEN len(c0) > 0 THEN c0 ELSE ['general'] END AS categories FROM pr)"""
_CNT = """count(*) AS total_feedback, count(*) FILTER (sentiment_label IN ('positive', 'very_positive')) AS positive_count, count(*) FILTER (sentiment_label IN ('negative', 'very_negative')) AS negative_count,
  count(*) FILTER (sentiment_label = 'neutral') AS neutral_count, sum(sentiment_score::DECIMAL(18,6))::DOUBLE / count(*) AS avg_sentiment"""


@plan("d31_clean_text", f"SELECT feedback_id, {_CLEAN} AS clean FROM fbk")
def _(t):
    return t.fbk.select("feedback_id", X.clean_feedback("text").alias("clean"))


@plan("d32_categories", f"WITH {_ANA} SELECT feedback_id, array_to_string(categories, ',') AS categories FROM ana")
def _(t):
    return t.fbk.withColumn("clean", X.clean_feedback("text")).select("feedback_id", F.array_join(B.categories(F.col("clean")), ",").alias("categories"))


@plan("d33_emotions", "WITH cl AS (SELECT feedback_id, " + _CLEAN + " AS clean FROM fbk) SELECT feedback_id, " + ", ".join(
    f"least({_hits(w)} / 3.0::DOUBLE, 1.0::DOUBLE) AS {k}" for k, w in B.EMOTIONS.items()) + " FROM cl")
def _(t):
    rows = t.fbk.withColumn("clean", X.clean_feedback("text")).select("feedback_id", B.emotions(F.col("clean")).alias("e"))
    return rows.select("feedback_id", *[F.col("e")[k].alias(k) for k in B.EMOTIONS])


@plan("d34_sentiment", f"WITH {_ANA} SELECT feedback_id, sentiment_score, sentiment_label, abs(sentiment_score) AS confidence FROM ana")
def _(t):
    return B.sentiment(t.fbk, "feedback_id", "text", LEXICON)


@plan("d35_priority", f"WITH {_ANA} SELECT feedback_id, priority, action_required FROM ana")
def _(t):
    return analysed(t).select("feedback_id", "priority", "action_required")


_S = f"created_at >= TIMESTAMP '{NOW}' - INTERVAL "


@plan("d36_sentiment_distribution", f"WITH {_ANA} SELECT sentiment_label, count(*) AS n, sum(sentiment_score::DECIMAL(18,6))::DOUBLE / count(*) AS avg_sentiment FROM ana WHERE {_S} 30 DAY GROUP BY 1")
def _(t):
    return B.distribution(analysed(t), NOW, 30)


@plan("d36_priority_mix", f"WITH {_ANA} SELECT priority, count(*) AS n, sum(sentiment_score::DECIMAL(18,6))::DOUBLE / count(*) AS avg_sentiment FROM ana WHERE {_S} 30 DAY GROUP BY 1")
def _(t):
    return B.distribution(analysed(t), NOW, 30, "priority")


@plan("d36_category_breakdown", f"WITH {_ANA}, x AS (SELECT *, unnest(categories) AS category FROM ana WHERE {_S} 30 DAY) SELECT category, {_CNT} FROM x GROUP BY 1")
def _(t):
    return B.category_breakdown(analysed(t), NOW, 30)


_GRAM2 = "list_transform(range(1, greatest(len(w), 1)::BIGINT), lambda i: w[i] || ' ' || w[i + 1])"
_GRAM3 = "list_transform(range(1, greatest(len(w) - 1, 1)::BIGINT), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])"
_PHR = f"""ph AS (SELECT feedback_id, created_at, source, unnest(list_distinct(list_concat({_GRAM2}, {_GRAM3}))) AS phrase
  FROM (SELECT feedback_id, created_at, source, {_WORDS} AS w FROM (SELECT *, {_CLEAN} AS clean FROM fbk)))"""


@plan("d36_top_phrases", f"WITH {_PHR} SELECT phrase, count(*) AS frequency FROM ph GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def _(t):
    return B.top_phrases(t.fbk, 10)


@plan("d37_daily_sentiment", f"""WITH {_ANA} SELECT created_at::DATE AS date, {_CNT}, count(*) FILTER (action_required) AS action_required_count, count(*) FILTER (priority = 'critical') AS critical_count
  FROM ana WHERE {_S} 30 DAY GROUP BY 1""")
def _(t):
    return B.daily_sentiment(analysed(t), NOW)


@plan("d37_product_sentiment", f"""WITH {_ANA}, g AS (SELECT product_id, {_CNT}, count(*) FILTER (action_required) AS issues_count, max(created_at) AS last_feedback_date FROM ana WHERE {_S} 90 DAY GROUP BY 1)
  SELECT prd.product_id, category, coalesce(total_feedback, 0) AS total_feedback, coalesce(positive_count, 0) AS positive_count, coalesce(negative_count, 0) AS negative_count, coalesce(neutral_count, 0) AS neutral_count,
  avg_sentiment, coalesce(issues_count, 0) AS issues_count, last_feedback_date FROM prd LEFT JOIN g USING (product_id)""")
def _(t):
    return B.product_sentiment(t.prd, analysed(t), NOW)


@plan("d37_weekly_categories", f"WITH {_ANA}, x AS (SELECT *, unnest(categories) AS category FROM ana WHERE {_S} 84 DAY) SELECT category, date_trunc('week', created_at)::DATE AS week, {_CNT} FROM x GROUP BY 1, 2")
def _(t):
    return B.weekly_categories(analysed(t), NOW)


@plan("d37_customer_patterns", f"""WITH {_ANA} SELECT customer_id, {_CNT}, count(*) FILTER (action_required) AS action_required_count, min(created_at) AS first_feedback_date, max(created_at) AS last_feedback_date
  FROM ana WHERE {_S} 365 DAY GROUP BY 1 HAVING count(*) >= 2""")
def _(t):
    return B.customer_patterns(analysed(t), NOW)


@plan("d38_daily_metrics", f"""WITH {_ANA}, x AS (SELECT *, unnest(categories) AS category FROM ana WHERE created_at::DATE BETWEEN DATE '2024-01-01' AND DATE '2024-01-30'),
  p AS (SELECT date, source, category, count(DISTINCT g) AS distinct_phrases FROM (SELECT created_at::DATE AS date, source, category, unnest({_GRAM2}) AS g
    FROM (SELECT *, {_WORDS} AS w FROM x)) GROUP BY 1, 2, 3),
  g AS (SELECT created_at::DATE AS date, source, category, {_CNT} FROM x GROUP BY 1, 2, 3) SELECT g.*, coalesce(distinct_phrases, 0) AS distinct_phrases FROM g LEFT JOIN p USING (date, source, category)""")
def _(t):
    return B.daily_metrics(analysed(t), "2024-01-01", "2024-01-30")


_BAD = "sentiment_label IN ('negative', 'very_negative')"


_ANOMALIES = f"""WITH {_ANA}, r AS (SELECT count(*) FILTER ({_BAD} AND NOT n)::DOUBLE / count(*) FILTER (NOT n) AS base, count(*) FILTER ({_BAD} AND n)::DOUBLE / count(*) FILTER (n) AS now
    FROM (SELECT *, {_S} 1 DAY AS n FROM ana WHERE {_S} 30 DAY))
  SELECT 'negative_spike' AS alert_type, CASE WHEN now > base * 2 THEN 'critical' ELSE 'high' END AS severity,
    'Negative feedback rate increased to ' || round(now * 100, 1) || '% (baseline: ' || round(base * 100, 1) || '%)' AS description, NULL::BIGINT AS product_id FROM r WHERE now > base * 0.5
  UNION ALL SELECT 'product_quality_decline', 'high', 'Product ' || product_id || ' has ' || count(*) FILTER ({_BAD}) || ' negative reviews in last 24h', product_id FROM ana WHERE {_S} 1 DAY
    GROUP BY product_id HAVING count(*) FILTER ({_BAD}) >= 1"""


@plan("d39_anomalies", _ANOMALIES)
def _(t):
    return B.anomalies(analysed(t), NOW, 0.5, 1)


@plan("u08_sentiment_anomalies", _ANOMALIES)
def _(t):
    register_table_functions(t.spark, feedback_analysis=analysed(t))
    return t.spark.sql(f"SELECT * FROM detect_sentiment_anomalies(TIMESTAMP_NTZ '{NOW}', 0.5D, 1)")


@plan("d40_topic_trends", f"""WITH {_PHR}, tp AS (SELECT unnest([{', '.join(repr(x) for x in TOPICS)}]) AS topic)
  SELECT topic, count(*) FILTER ({_S} 7 DAY) AS frequency_last_7d, count(*) FILTER ({_S} 30 DAY) AS frequency_last_30d, max(created_at) AS last_mentioned,
  count(*) FILTER ({_S} 7 DAY) > count(*) FILTER ({_S} 30 DAY) / 4 AS is_trending FROM ph JOIN tp ON contains(phrase, topic) GROUP BY 1""")
def _(t):
    return B.topic_trends(t.fbk, TOPICS, NOW)


@plan("d41_action_list", f"""WITH {_ANA} SELECT feedback_id, priority, created_at, sentiment_label FROM ana WHERE action_required AND {_S} 7 DAY
  ORDER BY CASE priority WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END DESC, created_at DESC, feedback_id LIMIT 50""")
def _(t):
    return B.action_list(analysed(t).select("feedback_id", "priority", "created_at", "sentiment_label", "action_required"), NOW).drop("action_required")


@plan("d41_product_summary", f"""WITH {_ANA} SELECT product_id, count(*) AS total_feedback, sum(sentiment_score::DECIMAL(18,6))::DOUBLE / count(*) AS avg_sentiment, count(*) FILTER (sentiment_label = 'very_positive') AS very_positive,
  count(*) FILTER (sentiment_label = 'positive') AS positive, count(*) FILTER (sentiment_label = 'neutral') AS neutral, count(*) FILTER (sentiment_label = 'negative') AS negative,
  count(*) FILTER (sentiment_label = 'very_negative') AS very_negative FROM ana GROUP BY 1""")
def _(t):
    return B.product_summary(analysed(t))
