"""Feedback texts: cleaning, categories, emotions, lexicon sentiment, priority, reports, anomalies, topics.

Whole texts are read, never prefixes. Tokens are counted per text before they meet the lexicon, so a long
or repetitive text adds one row per distinct word.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tillroll.functions import text as X
from tillroll.functions.numbers import ratio
from tillroll.operators.frequent import most_frequent
from tillroll.session import pin

# Keyword lists.
CATEGORIES = {
    "product_quality": ["chất lượng", "sản phẩm", "hàng", "tốt", "xấu", "đẹp", "kém", "tệ", "tuyệt vời", "quality", "product", "item", "good", "bad",
                        "excellent", "poor", "terrible", "amazing"],
    "shipping": ["giao hàng", "vận chuyển", "ship", "nhanh", "chậm", "đúng hẹn", "trễ", "shipping", "delivery", "fast", "slow", "on time", "late", "quick"],
    "customer_service": ["nhân viên", "phục vụ", "tư vấn", "hỗ trợ", "thái độ", "nhiệt tình", "service", "support", "staff", "help", "attitude", "friendly", "rude"],
    "pricing": ["giá", "tiền", "đắt", "rẻ", "phù hợp", "hợp lý", "khuyến mãi", "price", "cost", "expensive", "cheap", "reasonable", "discount", "promotion"],
    "website_ux": ["website", "web", "app", "giao diện", "dễ dùng", "khó dùng", "lỗi", "website", "app", "interface", "easy", "difficult", "bug", "error", "user-friendly"],
}
EMOTIONS = {
    "joy": ["happy", "pleased", "satisfied", "hài lòng", "vui", "tuyệt vời"],
    "anger": ["angry", "frustrated", "annoyed", "tức giận", "bực mình", "khó chịu"],
    "sadness": ["disappointed", "sad", "upset", "thất vọng", "buồn", "tiếc"],
    "fear": ["worried", "concerned", "anxious", "lo lắng", "sợ", "băn khoăn"],
    "surprise": ["surprised", "amazed", "shocked", "ngạc nhiên", "bất ngờ"],
}
POSITIVE, NEGATIVE = ("positive", "very_positive"), ("negative", "very_negative")
# Default word weights; callers pass their own for their language.
LEXICON = {"good": 1.0, "great": 1.5, "excellent": 2.0, "amazing": 2.0, "happy": 1.5, "fast": 0.5, "friendly": 1.0, "easy": 0.5, "tốt": 1.0, "đẹp": 1.0,
           "vui": 1.0, "bad": -1.0, "poor": -1.0, "terrible": -2.0, "slow": -0.5, "rude": -1.5, "angry": -1.5, "error": -1.0, "late": -0.5, "xấu": -1.0,
           "tệ": -1.5, "buồn": -1.0}
# Customers whose values may be broadcast; phrases of one Arrow batch.
BROADCAST_ROWS, BATCH_PHRASES = 500_000, 1 << 17


def categories(clean: Column, table: Mapping[str, Sequence[str]] = CATEGORIES, at_least: int = 2) -> Column:
    """D-32: categories with enough keyword hits, else ``general``."""
    found = F.array_compact(F.array(*[F.when(X.keyword_hits(clean, words) >= at_least, name) for name, words in table.items()]))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("general")))


def emotions(clean: Column, table: Mapping[str, Sequence[str]] = EMOTIONS) -> Column:
    """D-33: emotion -> min(hits / 3, 1)."""
    pairs = []
    for name, words in table.items():
        pairs += [F.lit(name), F.least(X.keyword_hits(clean, words) / 3.0, F.lit(1.0))]
    return F.create_map(*pairs)


def sentiment_label(score: Column) -> Column:
    return (F.when(score >= 0.8, "very_positive").when(score >= 0.3, "positive").when(score >= -0.3, "neutral")
            .when(score >= -0.8, "negative").otherwise("very_negative"))


def sentiment(df: DataFrame, key: str, text: str, lexicon: Mapping[str, float] = LEXICON) -> DataFrame:
    """D-34: lexicon score in -1..1, label and confidence.

    The raw sum s of word weights is normalised as s / sqrt(s^2 + 15). The weights are a map literal that is
    looked up inside the projection: no explode, no shuffle, whole texts.
    """
    return _with_sentiment(df.select(key, X.clean_feedback(text).alias("clean")), "clean", lexicon).drop("clean")


def _with_sentiment(df: DataFrame, clean: str, lexicon: Mapping[str, float]) -> DataFrame:
    """``df`` with score, label and confidence of its cleaned texts."""
    table = F.create_map(*[F.lit(x) for kv in lexicon.items() for x in (kv[0], float(kv[1]))])
    raw = F.aggregate(F.split(clean, " "), F.lit(0.0), lambda a, w: a + F.coalesce(F.try_element_at(table, w), F.lit(0.0)))
    score = F.col("_raw") / F.sqrt(F.col("_raw") * F.col("_raw") + 15)
    out = df.withColumn("_raw", raw).withColumn("sentiment_score", F.round(score, 6)).drop("_raw")
    return out.withColumn("sentiment_label", sentiment_label(F.col("sentiment_score"))).withColumn("confidence", F.abs("sentiment_score"))


def priority(label: Column, clv: Column, high_value: float = 5000000) -> Column:
    """D-35."""
    negative = label.isin(*NEGATIVE)
    return (F.when(negative & (F.coalesce(clv, F.lit(0.0)) > high_value), "critical").when(negative, "high")
            .when(label == "neutral", "medium").otherwise("low"))


def _phrases(sizes: Sequence[int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function over batches whose last column is a text with single blanks: one row per distinct phrase of a text."""
    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, phrases = [], []
            for i, text in enumerate(batch.columns[-1].to_pylist()):
                tokens = [w for w in text.split(" ") if w] if text else []
                found: dict[str, None] = {}
                for n in sizes:
                    grams = tokens
                    for shift in range(1, n):
                        grams = [f"{a} {b}" for a, b in zip(grams, tokens[shift:])]
                    found.update(dict.fromkeys(grams))
                at += [i] * len(found)
                phrases += found
                if len(phrases) >= BATCH_PHRASES:
                    yield rows(batch, at, phrases)
                    at, phrases = [], []
            if phrases:
                yield rows(batch, at, phrases)

    def rows(batch: pa.RecordBatch, at: list[int], phrases: list[str]) -> pa.RecordBatch:
        kept = [c.take(pa.array(at, pa.int32())) for c in batch.columns[:-1]]
        return pa.RecordBatch.from_arrays([*kept, pa.array(phrases, pa.string())], names=[*batch.schema.names[:-1], "phrase"])

    return explode


def explode_phrases(df: DataFrame, text: str, keep: Sequence[str], sizes: Sequence[int] = (2, 3), longest: int | None = None, cleaned: bool = False) -> DataFrame:
    """D-41: distinct word pairs and triples of each text, one row each; with ``longest`` only those of at most so many characters.

    Arrow batches: array functions with lambdas take about twice as long. ``cleaned`` texts have single blanks already.
    """
    rows = df.select(*keep, (F.col(text) if cleaned else X.collapse(text)).alias("phrase"))
    phrases = rows.mapInArrow(_phrases(sizes), StructType([*rows.schema.fields[:-1], StructField("phrase", StringType())]))
    return phrases if longest is None else phrases.where(F.length("phrase") <= longest)


def _met_by_key(rows: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """``rows`` as joined with their own ``columns`` on ``key``: without null keys, and rows of one key meet each other's. Only rows of repeated keys are moved."""
    twice = pin(rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1").select(key))
    if twice.isEmpty():
        return rows.where(F.col(key).isNotNull())
    again = rows.join(twice, key, "left_semi")
    met = again.drop(*columns).join(again.select(key, *columns), key)
    return rows.where(F.col(key).isNotNull()).join(twice, key, "left_anti").unionByName(met)


def analyse(feedback: DataFrame, clv: DataFrame, lexicon: Mapping[str, float] = LEXICON) -> DataFrame:
    """D-31..D-35 together: one analysed row per feedback. Scores are computed where the text is; the values of the customers that occur come to it, so texts are not moved if these are few."""
    rows = _with_sentiment(feedback.withColumn("clean", X.clean_feedback("text")), "clean", lexicon)
    scored = _met_by_key(rows, "feedback_id", ["sentiment_score", "sentiment_label", "confidence"])
    clv = pin(clv.join(feedback.select("customer_id").distinct(), "customer_id", "left_semi"))
    scored = scored.join(F.broadcast(clv) if clv.count() <= BROADCAST_ROWS else clv, "customer_id", "left")
    p = priority(F.col("sentiment_label"), F.col("clv_prediction"))
    return scored.withColumns({"categories": categories(F.col("clean")), "emotions": emotions(F.col("clean")), "priority": p,
                               "action_required": p.isin("critical", "high")})


def _counts() -> list[Column]:
    label = F.col("sentiment_label")
    return [F.count("*").alias("total_feedback"), F.count_if(label.isin(*POSITIVE)).alias("positive_count"),
            F.count_if(label.isin(*NEGATIVE)).alias("negative_count"), F.count_if(label == "neutral").alias("neutral_count")]


def _mean() -> Column:
    return ratio(F.sum(F.col("sentiment_score").cast("decimal(18,6)")), F.count("sentiment_score")).alias("avg_sentiment")


def _since(as_of: str, days: int) -> Column:
    return F.col("created_at") >= F.expr(f"TIMESTAMP_NTZ '{as_of}' - INTERVAL {days} DAY")


def distribution(analysed: DataFrame, as_of: str, days: int, by: str = "sentiment_label") -> DataFrame:
    """D-36: rows per label or priority and the mean score."""
    return analysed.where(_since(as_of, days)).groupBy(by).agg(F.count("*").alias("n"), _mean())


def category_breakdown(analysed: DataFrame, as_of: str, days: int) -> DataFrame:
    """D-36: category by positive, negative, neutral."""
    rows = analysed.where(_since(as_of, days)).withColumn("category", F.explode_outer("categories"))
    return rows.groupBy("category").agg(*_counts(), _mean())


def top_phrases(feedback: DataFrame, k: int = 10, text: str = "text") -> DataFrame:
    """D-36, D-41: phrases found in the most texts; only those of heavy counters are shuffled."""
    return most_frequent(explode_phrases(feedback.select(X.clean_feedback(text).alias("_clean")), "_clean", [], cleaned=True), "phrase", k, "frequency")


def daily_sentiment(analysed: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """D-37."""
    return analysed.where(_since(as_of, days)).groupBy(F.to_date("created_at").alias("date")).agg(
        *_counts(), _mean(), F.count_if("action_required").alias("action_required_count"), F.count_if(F.col("priority") == "critical").alias("critical_count"))


def product_sentiment(products: DataFrame, analysed: DataFrame, as_of: str, days: int = 90) -> DataFrame:
    """D-37: per product, products without feedback included."""
    g = analysed.where(_since(as_of, days)).groupBy("product_id").agg(*_counts(), _mean(), F.count_if("action_required").alias("issues_count"), F.max("created_at").alias("last_feedback_date"))
    out = products.select("product_id", "category").join(g, "product_id", "left")
    return out.fillna(0, ["total_feedback", "positive_count", "negative_count", "neutral_count", "issues_count"])


def weekly_categories(analysed: DataFrame, as_of: str, weeks: int = 12) -> DataFrame:
    """D-37."""
    rows = analysed.where(_since(as_of, weeks * 7)).withColumn("category", F.explode_outer("categories"))
    return rows.groupBy("category", F.to_date(F.date_trunc("week", "created_at")).alias("week")).agg(*_counts(), _mean())


def customer_patterns(analysed: DataFrame, as_of: str, days: int = 365, at_least: int = 2) -> DataFrame:
    """D-37."""
    return analysed.where(_since(as_of, days)).groupBy("customer_id").agg(
        *_counts(), _mean(), F.count_if("action_required").alias("action_required_count"), F.min("created_at").alias("first_feedback_date"),
        F.max("created_at").alias("last_feedback_date")).where(F.col("total_feedback") >= at_least)


def daily_metrics(analysed: DataFrame, first: str, last: str) -> DataFrame:
    """D-38: per day, source and category with the number of distinct key phrases.

    Feedback and phrases are counted apart, so a text with many phrases counts once (G-10).
    """
    day = F.to_date("created_at")
    rows = analysed.where(day.between(F.lit(first).cast("date"), F.lit(last).cast("date"))).withColumn("date", day).withColumn("category", F.explode_outer("categories"))
    keys = ["date", "source", "category"]
    phrases = explode_phrases(rows, "clean", keys, (2,), cleaned=True).groupBy(*keys).agg(F.countDistinct("phrase").alias("distinct_phrases"))
    return rows.groupBy(*keys).agg(*_counts(), _mean()).join(phrases, keys, "left").fillna(0, ["distinct_phrases"])


def anomalies(analysed: DataFrame, as_of: str, factor: float = 1.5, at_least: int = 3) -> DataFrame:
    """D-39: spike of the negative rate of the last day against 30 days, and products with several negatives."""
    bad = F.col("sentiment_label").isin(*NEGATIVE)
    new = _since(as_of, 1)
    r = analysed.where(_since(as_of, 30)).agg(
        ratio(F.count_if(bad & ~new), F.count_if(~new)).alias("base"), ratio(F.count_if(bad & new), F.count_if(new)).alias("now"))
    text = F.concat(F.lit("Negative feedback rate increased to "), F.round(F.col("now") * 100, 1).cast("string"), F.lit("% (baseline: "),
                    F.round(F.col("base") * 100, 1).cast("string"), F.lit("%)"))
    spike = r.where(F.col("now") > F.col("base") * factor).select(
        F.lit("negative_spike").alias("alert_type"), F.when(F.col("now") > F.col("base") * 2, "critical").otherwise("high").alias("severity"),
        text.alias("description"), F.lit(None).cast("bigint").alias("product_id"))
    p = analysed.where(new & F.col("product_id").isNotNull()).groupBy("product_id").agg(F.count_if(bad).alias("n")).where(F.col("n") >= at_least)
    issues = p.select(F.lit("product_quality_decline").alias("alert_type"), F.lit("high").alias("severity"),
                      F.concat(F.lit("Product "), F.col("product_id"), F.lit(" has "), F.col("n"), F.lit(" negative reviews in last 24h")).alias("description"), "product_id")
    return spike.unionByName(issues)


def topic_trends(feedback: DataFrame, topics: Sequence[str], as_of: str, text: str = "text") -> DataFrame:
    """D-40: how many phrases mention each topic in 7 and 30 days, and whether it is trending.

    The topics are a fixed list, so each phrase filters that list and explodes the matches: no join.
    ``is_trending`` uses the new counts (G-11).
    """
    phrases = explode_phrases(feedback.select("created_at", X.clean_feedback(text).alias("_clean")), "_clean", ["created_at"], cleaned=True)
    hit = F.filter(F.array(*[F.lit(x) for x in topics]), lambda x: F.col("phrase").contains(F.lower(x)))
    g = phrases.select("created_at", F.explode_outer(hit).alias("topic")).where("topic IS NOT NULL").groupBy("topic").agg(
        F.count_if(_since(as_of, 7)).alias("frequency_last_7d"), F.count_if(_since(as_of, 30)).alias("frequency_last_30d"), F.max("created_at").alias("last_mentioned"))
    return g.withColumn("is_trending", F.col("frequency_last_7d") > F.col("frequency_last_30d") / 4.0)


def action_list(analysed: DataFrame, as_of: str, days: int = 7, limit: int = 50) -> DataFrame:
    """D-41: feedback that needs action, most urgent first; the limit is the list length asked for."""
    rank = F.when(F.col("priority") == "critical", 4).when(F.col("priority") == "high", 3).when(F.col("priority") == "medium", 2).otherwise(1)
    return analysed.where(F.col("action_required") & _since(as_of, days)).orderBy(rank.desc(), F.desc("created_at"), "feedback_id").limit(limit)


def product_summary(analysed: DataFrame) -> DataFrame:
    """D-41: counts per label and mean score for every product with feedback."""
    labels = ("very_positive", "positive", "neutral", "negative", "very_negative")
    return analysed.groupBy("product_id").agg(F.count("*").alias("total_feedback"), _mean(), *[F.count_if(F.col("sentiment_label") == x).alias(x) for x in labels])
