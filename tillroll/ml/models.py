"""Spark ML pipelines: preparation, regression, classification, clustering, forecast, metrics, scoring, storage."""

from __future__ import annotations

import datetime
import json
import math
import statistics
from collections.abc import Mapping, Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import BinaryClassificationEvaluator, ClusteringEvaluator, MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import PCA, Imputer, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.stat import Summarizer
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillroll.functions.numbers import pct, ratio
from tillroll.operators.ordering import quantiles, rank_by_value
from tillroll.operators.windows import lag_features, rolling_means

SEED = 42


# ---- preparation ------------------------------------------------------------------------------------

def preparation(numeric: Sequence[str], categorical: Sequence[str] = (), scale: bool = True, output: str = "features") -> list:
    """M-01: label codes in alphabetical order, median fill, one vector, standardised."""
    stages: list = []
    if categorical:
        stages.append(StringIndexer(inputCols=list(categorical), outputCols=[f"{c}_encoded" for c in categorical], stringOrderType="alphabetAsc", handleInvalid="keep"))
    stages.append(Imputer(strategy="median", inputCols=list(numeric), outputCols=[f"{c}_filled" for c in numeric]))
    inputs = [f"{c}_filled" for c in numeric] + [f"{c}_encoded" for c in categorical]
    raw = f"{output}_raw" if scale else output
    stages.append(VectorAssembler(inputCols=inputs, outputCol=raw, handleInvalid="keep"))
    if scale:
        stages.append(StandardScaler(inputCol=raw, outputCol=output, withMean=True, withStd=True))
    return stages


def prepare(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str] = ()) -> tuple[PipelineModel, DataFrame]:
    """M-01: fitted preparation and the prepared rows."""
    doubles = df.withColumns({c: F.col(c).cast("double") for c in numeric})
    model = Pipeline(stages=preparation(numeric, categorical)).fit(doubles)
    return model, model.transform(doubles)


def split(df: DataFrame, key: str, test_pct: int = 20) -> tuple[DataFrame, DataFrame]:
    """Train and test rows by a hash of the key: the same split on every run and after recomputation."""
    bucket = F.pmod(F.xxhash64(F.col(key), F.lit(SEED)), F.lit(100))
    return df.where(bucket >= test_pct), df.where(bucket < test_pct)


# ---- regression and classification ------------------------------------------------------------------

def regressors(label: str, trees: int = 20, depth: int = 6) -> dict[str, object]:
    return {"linear": LinearRegression(labelCol=label, regParam=0.01), "random_forest": RandomForestRegressor(labelCol=label, numTrees=trees, maxDepth=depth, seed=SEED),
            "boosted": GBTRegressor(labelCol=label, maxIter=trees, maxDepth=min(depth, 5), seed=SEED)}


Folds = list[tuple[DataFrame, DataFrame]]


def time_cuts(rows: DataFrame, by: str, folds: int = 3) -> list[datetime.date]:
    """M-09: days at which folds begin: ``folds`` + 1 blocks of as many rows each, whole days. Equal cuts are one."""
    days = rows.select(F.unix_date(F.to_date(by)).cast("double").alias("d")).dropna()
    found = quantiles(days, ["d"], [k / (folds + 1) for k in range(1, folds + 1)]).first()
    numbers = sorted({math.ceil(found[f"q{k}"]) for k in range(folds)}) if found else []
    return [datetime.date(1970, 1, 1) + datetime.timedelta(days=n) for n in numbers]


def time_folds(rows: DataFrame, by: str, folds: int = 3) -> Folds:
    """M-09: expanding windows: a fold learns from all days before its cut and is judged on the days from there to the next cut. Rows without a time take no part."""
    day, cuts = F.to_date(by), time_cuts(rows, by, folds)
    return [(rows.where(day < F.lit(c)), rows.where((day >= F.lit(c)) & (day < F.lit(e)) if e else day >= F.lit(c))) for c, e in zip(cuts, [*cuts[1:], None])]


def row_folds(rows: DataFrame, folds: int = 3) -> Folds:
    """M-02: folds by a hash of the row, for rows without a time; the same on every run. Equal rows share a fold."""
    fold = F.pmod(F.xxhash64(*rows.columns, F.lit(SEED)), F.lit(folds))
    return [(rows.where(fold != k), rows.where(fold == k)) for k in range(folds)]


def fold_errors(folds: Folds, label: str, candidates: Mapping[str, object], prep: Sequence, metric: str = "mae") -> list[tuple[str, int, float]]:
    """M-02, M-09: (model, fold, error). Preparation is fitted anew on each fold's learning rows. A fold that has no rows to learn from or to judge is left out."""
    judge, out = RegressionEvaluator(labelCol=label, metricName=metric), []
    for k, (learn, held) in enumerate(folds):
        if learn.isEmpty() or held.isEmpty():
            continue
        ready = Pipeline(stages=list(prep)).fit(learn)
        a, b = ready.transform(learn).cache(), ready.transform(held).cache()
        try:
            out.extend((name, k, float(judge.evaluate(estimator.fit(a).transform(b)))) for name, estimator in candidates.items())
        finally:
            a.unpersist()
            b.unpersist()
    return out


def fold_report(spark, errors: Sequence[tuple[str, int, float]]) -> DataFrame:
    """M-09, M-18: folds, mean and spread (sample standard deviation, null for one fold) of the error per model, the best first."""
    rows = spark.createDataFrame(list(errors), "model string, fold int, error double")  # one row per model and fold
    return rows.groupBy("model").agg(F.count("*").alias("folds"), F.avg("error").alias("mean_error"), F.stddev_samp("error").alias("std_error")).orderBy("mean_error", "model")


def fit_best(train: DataFrame, label: str, candidates: Mapping[str, object], prep: Sequence, metric: str = "mae", by: str | None = None, folds: int = 3) -> tuple[str, PipelineModel, dict[str, float]]:
    """M-02, M-07, M-09: the candidate with the lowest mean error over folds of the training rows, fitted on all of them.

    Folds expand in time if ``by`` names a time column, else they come from a hash. Test rows stay unseen. Without a usable fold the first candidate by name is fitted.
    """
    errors = fold_errors(time_folds(train, by, folds) if by else row_folds(train, folds), label, candidates, prep, metric)
    scores = {name: statistics.fmean(e) for name in candidates if (e := [x for n, _, x in errors if n == name])}
    best = min(scores or candidates, key=lambda n: (scores.get(n, 0.0), n))
    return best, Pipeline(stages=[*prep, candidates[best]]).fit(train), scores


def balanced_weights(df: DataFrame, label: str, name: str = "weight") -> DataFrame:
    """M-06: weight n / (classes * rows of the class)."""
    g = df.groupBy(label).agg(F.count("*").alias("_n"))
    every = Window.partitionBy(F.lit(1))  # one row per class
    w = g.select(label, (F.sum("_n").over(every) / (F.count("*").over(every) * F.col("_n"))).alias(name))
    return df.join(w, label)


def fit_classifier(train: DataFrame, label: str, prep: Sequence, kind: str = "random_forest", weight: str | None = None, trees: int = 20, depth: int = 6) -> PipelineModel:
    """M-06, M-08, M-15: forest, logistic regression or boosted trees."""
    common = {"labelCol": label, **({"weightCol": weight} if weight else {})}
    estimator = {"random_forest": lambda: RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=SEED, **common),
                 "logistic": lambda: LogisticRegression(maxIter=50, regParam=0.01, **common), "boosted": lambda: GBTClassifier(maxIter=trees, seed=SEED, **common)}[kind]()
    return Pipeline(stages=[*prep, estimator]).fit(train)


def churn_rows(features: DataFrame, days: int = 90, leaky: bool = False) -> DataFrame:
    """M-06: label 1 after ``days`` without an order; the recency that defines it is removed unless ``leaky``."""
    out = features.withColumn("label", (F.col("recency") > days).cast("double"))
    return out if leaky else out.drop("recency")


def tier_label(df: DataFrame, column: str, name: str = "label") -> DataFrame:
    """M-15: quartile 0..3 of a column."""
    e = quantiles(df, [column], [0.25, 0.5, 0.75]).select(F.struct("q0", "q1", "q2")).scalar()
    x = F.col(column).cast("double")
    tier = F.when(x <= F.col("_e.q0"), 0.0).when(x <= F.col("_e.q1"), 1.0).when(x <= F.col("_e.q2"), 2.0).otherwise(3.0)
    return df.withColumn("_e", e).withColumn(name, tier).drop("_e")


def demand_label(df: DataFrame, column: str, share: float = 0.7, name: str = "label") -> DataFrame:
    """M-15: 1 for the top part above the quantile."""
    e = quantiles(df, [column], [share]).select("q0").scalar()
    return df.withColumn("_e", e).withColumn(name, (F.col(column).cast("double") > F.col("_e")).cast("double")).drop("_e")


def grid_search(train: DataFrame, label: str, prep: Sequence, trees: Sequence[int] = (5, 10), depths: Sequence[int] = (3, 5), folds: int = 3):
    """M-16: cross-validated grid over a forest; folds come from a hash of the row, not from a random draw."""
    forest = RandomForestRegressor(labelCol=label, seed=SEED)
    grid = ParamGridBuilder().addGrid(forest.numTrees, list(trees)).addGrid(forest.maxDepth, list(depths)).build()
    fold = F.pmod(F.xxhash64(*[F.col(c) for c in train.columns]), F.lit(folds)).cast("int")
    search = CrossValidator(estimator=Pipeline(stages=[*prep, forest]), estimatorParamMaps=grid, evaluator=RegressionEvaluator(labelCol=label, metricName="mae"),
                            numFolds=folds, seed=SEED, foldCol="_fold", parallelism=2)
    return search.fit(train.withColumn("_fold", fold))


def grid_report(spark, model) -> DataFrame:
    """M-16, M-18: mean and standard deviation over the folds of the error per parameter combination."""
    rows = [(json.dumps({p.name: v for p, v in params.items()}, sort_keys=True), float(m), float(s)) for params, m, s in zip(model.getEstimatorParamMaps(), model.avgMetrics, model.stdMetrics)]
    return spark.createDataFrame(rows, "parameters string, mean_mae double, std_mae double")


def f_scores(df: DataFrame, names: Sequence[str], label: str, classify: bool = False) -> DataFrame:
    """M-17: F score per feature: from the correlation with a numeric label, or between / within classes."""
    rows = df.select(*[F.col(c).cast("double").alias(c) for c in names], F.col(label).cast("double").alias("_y")).dropna()
    if not classify:
        r2 = lambda c: F.pow(F.corr(c, "_y"), 2)
        cells = [F.struct(F.lit(c).alias("feature"), F.try_divide(r2(c) * (F.count("*") - 2), 1 - r2(c)).alias("f_score")) for c in names]
        return rows.agg(F.array(*cells).alias("_c")).select(F.explode("_c").alias("_f")).select("_f.*")
    stats = rows.groupBy("_y").agg(F.count("*").alias("_n"), *[F.avg(c).alias(f"{c}_m") for c in names], *[F.var_pop(c).alias(f"{c}_v") for c in names])
    centre = rows.agg(F.struct(*[F.avg(c).alias(c) for c in names]).alias("c")).scalar()
    n = F.col("_n")
    cells = [F.struct(F.lit(c).alias("feature"), F.try_divide(
        F.sum(n * F.pow(F.col(f"{c}_m") - F.col("_c")[c], 2)) / (F.count("*") - 1), F.sum(n * F.col(f"{c}_v")) / (F.sum(n) - F.count("*"))).alias("f_score")) for c in names]
    return stats.withColumn("_c", centre).agg(F.array(*cells).alias("_a")).select(F.explode("_a").alias("_f")).select("_f.*")


def select_features(df: DataFrame, names: Sequence[str], label: str, classify: bool = False, at_least: int = 3) -> DataFrame:
    """M-17: features whose F score reaches the median, at least three. One row per named feature."""
    scored = f_scores(df, names, label, classify)
    median = scored.agg(F.percentile("f_score", 0.5).alias("m")).scalar()  # as many values as named features
    w = Window.orderBy(F.desc("f_score"), "feature")
    return scored.withColumn("_m", median).select("feature", "f_score", ((F.row_number().over(w) <= at_least) | (F.col("f_score") >= F.col("_m"))).alias("selected"))


# ---- clustering -------------------------------------------------------------------------------------

def best_kmeans(df: DataFrame, features: Sequence[str], ks: Sequence[int] = range(3, 8)) -> tuple[PipelineModel, DataFrame, dict[int, float]]:
    """M-03: standardise, try each k, keep the best silhouette."""
    model, ready = prepare(df, features)
    ready = ready.cache()
    judge = ClusteringEvaluator(predictionCol="cluster")
    fits, scores = {}, {}
    for k in ks:
        fits[k] = KMeans(k=k, seed=SEED, predictionCol="cluster").fit(ready)
        scores[k] = judge.evaluate(fits[k].transform(ready))
    best = max(scores, key=lambda k: (scores[k], -k))
    out = fits[best].transform(ready)
    return PipelineModel(stages=[*model.stages, fits[best]]), out, scores


def cluster_profiles(df: DataFrame) -> DataFrame:
    """M-03: size, means and medians of the measures, spread of the spend, and a name per cluster from the 0.8 / 0.7 / 0.3 quantiles of all customers. Names and limits are fixed values."""
    measures = [c for c in ("monetary", "frequency", "recency", "avg_order_value", "total_items", "lifetime_days") if c in df.columns]
    q = quantiles(df, ["monetary", "frequency", "recency"], [0.3, 0.7, 0.8]).agg(
        F.map_from_entries(F.collect_list(F.struct("column_name", F.struct("q0", "q1", "q2")))).alias("m")).scalar()
    g = df.groupBy("cluster").agg(F.count("*").alias("segment_size"), *[F.round(F.avg(c), 2).alias(f"{c}_mean") for c in measures], F.round(F.stddev_samp("monetary"), 2).alias("monetary_std"))
    medians = quantiles(df, measures, [0.5], ["cluster"]).groupBy("cluster").pivot("column_name", measures).agg(F.first("q0"))
    g = g.join(medians.select("cluster", *[F.round(c, 2).alias(f"{c}_median") for c in measures]), "cluster")
    at = lambda c, e: F.col("_q")[c][e]
    name = (F.when((F.col("monetary_mean") > at("monetary", "q2")) & (F.col("recency_mean") < at("recency", "q0")), "VIP_Active")
            .when(F.col("monetary_mean") > at("monetary", "q2"), "VIP_At_Risk").when(F.col("frequency_mean") > at("frequency", "q1"), "Loyal_Regular")
            .when(F.col("recency_mean") > at("recency", "q1"), "Lost_Customers").otherwise(F.concat(F.lit("Regular_Segment_"), F.col("cluster"))))
    return g.withColumn("_q", q).withColumn("segment_name", name).drop("_q")


def calinski_harabasz(df: DataFrame, features: str = "features", cluster: str = "cluster") -> DataFrame:
    """M-04: between and within sums of squares from per-cluster mean, variance and count vectors."""
    m = Summarizer.metrics("mean", "variance", "count")
    g = df.groupBy(cluster).agg(m.summary(F.col(features)).alias("s")).select(F.col("s.count").alias("n"), vector_to_array("s.mean").alias("mean"), vector_to_array("s.variance").alias("var"))
    centre = df.agg(Summarizer.mean(F.col(features)).alias("c")).select(vector_to_array("c").alias("c")).scalar()
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y)
    rows = g.withColumn("_c", centre).select(
        "n", (F.col("n") * total(F.zip_with("mean", "_c", lambda a, b: (a - b) * (a - b)))).alias("between"), ((F.col("n") - 1) * total(F.col("var"))).alias("within"))
    s = rows.agg(F.sum("n").alias("n"), F.count("*").alias("k"), F.sum("between").alias("b"), F.sum("within").alias("w"))
    return s.select(F.col("k").alias("clusters"), F.try_divide(F.col("b") / (F.col("k") - 1), F.col("w") / (F.col("n") - F.col("k"))).alias("calinski_harabasz"))


def two_components(df: DataFrame, features: str = "features") -> DataFrame:
    """M-05."""
    out = PCA(k=2, inputCol=features, outputCol="_p").fit(df).transform(df).withColumn("_p", vector_to_array("_p"))
    return out.withColumns({"pc1": F.col("_p")[0], "pc2": F.col("_p")[1]}).drop("_p")


# ---- forecast ---------------------------------------------------------------------------------------

PAST = ["y_lag_1", "y_lag_7", "y_lag_30", "y_ma_7", "y_ma_30"]
PRODUCT = ["price", "rating", "review_count"]
FORECAST_FEATURES = [*PAST, "year", "month", "weekday", "weekend", "day_of_year", *PRODUCT]


def _calendar(df: DataFrame) -> DataFrame:
    return df.withColumns({"year": F.year("day"), "month": F.month("day"), "weekday": F.weekday("day"), "weekend": (F.weekday("day") >= 5).cast("int"), "day_of_year": F.dayofyear("day")})


def forecast_features(series: DataFrame) -> DataFrame:
    """M-09: lags, rolling means of the rows before, calendar, product figures. The series has one row per category and day; without price, rating or review_count these are 0."""
    series = series.withColumns({c: F.col(c).cast("double") if c in series.columns else F.lit(0.0) for c in PRODUCT})
    past = lag_features(series, "category")
    means = rolling_means(past.withColumn("_y", F.col("y")).withColumn("y", F.col("y_lag_1")), "category", full=False).withColumn("y", F.col("_y")).drop("_y")
    return _calendar(means)


def forecast_split(series: DataFrame, share: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """M-09: rows with all lags, cut in time at the share of the days."""
    rows = forecast_features(series).dropna(subset=["y_lag_30"]).withColumns({c: F.col(c).cast("double") for c in FORECAST_FEATURES})
    days = rows.agg(F.min("day").alias("a"), F.max("day").alias("b")).select(F.date_add("a", (F.datediff("b", "a") * F.lit(share)).cast("int")).alias("d")).first()["d"]
    return rows.where(F.col("day") < F.lit(days)), rows.where(F.col("day") >= F.lit(days))


def fit_forecast(series: DataFrame, share: float = 0.8, trees: int = 20) -> tuple[str, PipelineModel, dict[str, float], DataFrame]:
    """M-09: chronological split, three models, best by MAE over expanding folds of the days before it; also the test rows, which no choice has seen."""
    train, test = forecast_split(series, share)
    name, model, scores = fit_best(train, "y", regressors("y", trees), preparation(FORECAST_FEATURES, ["category"], scale=False), by="day")
    return name, model, scores, test


def project(series: DataFrame, model: PipelineModel, days: int = 30) -> DataFrame:
    """M-09: the next days per category; never negative. Lags and rolling means, unknown for these days, are the mean of the last 30 days, product figures the last ones."""
    rows = forecast_features(series)
    ends = rows.groupBy("category").agg(F.max("day").alias("_end"))
    recent = rows.join(ends, "category").where(F.col("day") > F.date_sub("_end", 30)).groupBy("category").agg(F.avg(F.col("y").cast("double")).alias("_mean"))
    last = rows.groupBy("category").agg(F.max_by(F.struct("day", *PRODUCT), "day").alias("r")).select("category", "r.*").join(recent, "category").select("*", *[F.col("_mean").alias(c) for c in PAST]).drop("_mean")
    future = last.withColumn("day", F.explode(F.sequence(F.date_add("day", 1), F.date_add("day", days))))
    future = _calendar(future).withColumns({c: F.col(c).cast("double") for c in FORECAST_FEATURES})
    return model.transform(future).select("category", "day", F.greatest(F.lit(0.0), F.col("prediction")).alias("predicted_sales"))


# ---- metrics, scoring, storage ----------------------------------------------------------------------

def regression_metrics(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """M-18: MAE, MSE, RMSE, R2 and MAPE as one aggregate."""
    y, p = F.col(label).cast("double"), F.col(prediction).cast("double")
    e = y - p
    g = df.agg(F.avg(F.abs(e)).alias("mae"), F.avg(e * e).alias("mse"), F.sum(e * e).alias("_r"), (F.var_pop(y) * F.count(y)).alias("_t"),
               (F.avg(F.abs(F.try_divide(e, y))) * 100).alias("mape"))
    return g.select("mae", "mse", F.sqrt("mse").alias("rmse"), F.coalesce(1 - F.try_divide(F.col("_r"), F.col("_t")), F.lit(0.0)).alias("r2"), "mape")


def confusion(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """M-18: rows per (label, prediction)."""
    return df.groupBy(F.col(label).cast("double").alias("label"), F.col(prediction).cast("double").alias("prediction")).agg(F.count("*").alias("n"))


def classification_metrics(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """M-18: accuracy and weighted precision, recall, F1 from the confusion counts."""
    m = confusion(df, label, prediction)
    hit = F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0)
    rows = m.groupBy("label").agg(F.sum("n").alias("support"), F.sum(hit).alias("tp"))
    cols = m.groupBy(F.col("prediction").alias("label")).agg(F.sum("n").alias("predicted"))
    c = rows.join(cols, "label", "left")
    precision, recall = F.coalesce(ratio(F.col("tp"), F.col("predicted")), F.lit(0.0)), ratio(F.col("tp"), F.col("support"))
    c = c.select("support", "tp", precision.alias("p"), recall.alias("r"))
    f1 = F.coalesce(F.try_divide(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r")), F.lit(0.0))
    weighted = lambda x: F.sum(x * F.col("support")) / F.sum("support")
    return c.agg(ratio(F.sum("tp"), F.sum("support")).alias("accuracy"), weighted(F.col("p")).alias("precision"), weighted(F.col("r")).alias("recall"), weighted(f1).alias("f1"))


def area_under_curve(df: DataFrame, label: str = "label") -> float:
    return BinaryClassificationEvaluator(labelCol=label).evaluate(df)


def area_rows(df: DataFrame, label: str, score: str) -> DataFrame:
    """M-18: area under the ROC curve as one row: the share of (positive, negative) pairs in the right order, ties half."""
    ranked = rank_by_value(df.select((F.col(label) > 0).cast("int").alias("_y"), F.col(score).cast("double").alias("_s")).where(F.col("_y").isNotNull()), "_s")
    g = ranked.agg(F.count("*").alias("n"), F.sum("_y").alias("p"), F.sum(F.when(F.col("_y") == 1, F.col("percent_rank_avg"))).alias("r"))
    return g.select((F.try_divide(F.col("r") * F.col("n") - F.col("p") * (F.col("p") + 1) / 2, F.col("p") * (F.col("n") - F.col("p")))).alias("area_under_curve"))


def accuracy(df: DataFrame, label: str = "label") -> float:
    return MulticlassClassificationEvaluator(labelCol=label, metricName="accuracy").evaluate(df)


def importances(model: PipelineModel, features: str = "features", top: int = 20) -> list[tuple[str, float]]:
    """M-19: feature names and weights, largest first."""
    names = next(s for s in model.stages if isinstance(s, VectorAssembler)).getInputCols()
    weights = model.stages[-1].featureImportances.toArray()
    return sorted(((n, float(w)) for n, w in zip(names, weights)), key=lambda x: (-x[1], x[0]))[:top]


def importance_rows(spark, model: PipelineModel, top: int = 20) -> DataFrame:
    return spark.createDataFrame(importances(model, top=top), "feature string, importance double")


def score(model: PipelineModel, df: DataFrame, key: str, inputs: Sequence[str]) -> DataFrame:
    """M-20: prediction, confidence (of the class predicted), probability of class 1, stable id and the inputs as a map."""
    out = model.transform(df)
    one = vector_to_array("probability")[1] if "probability" in out.columns else F.lit(None).cast("double")
    sure = F.array_max(vector_to_array("probability")) if "probability" in out.columns else F.lit(None).cast("double")
    pairs = [x for c in inputs for x in (F.lit(c), F.col(c).cast("string"))]
    ident = F.concat(F.lit("PRED_"), F.substring(F.sha2(F.col(key).cast("string"), 256), 1, 16))
    return out.select(key, ident.alias("prediction_id"), "prediction", sure.alias("confidence"), one.alias("probability"), F.create_map(*pairs).alias("inputs"))


def risk_level(p: Column) -> Column:
    """M-20: of the probability of class 1."""
    return F.when(p >= 0.7, "high").when(p >= 0.4, "medium").otherwise("low")


def clv_level(v: Column) -> Column:
    """M-20."""
    return F.when(v > 500, "high").when(v > 200, "medium").otherwise("low")


def save(model: PipelineModel, path: str, metadata: Mapping[str, object], spark) -> None:
    """M-21: the pipeline and a JSON row of metadata next to it."""
    model.write().overwrite().save(f"{path}/model")
    spark.createDataFrame([(json.dumps(dict(metadata), sort_keys=True),)], "metadata string").write.mode("overwrite").text(f"{path}/metadata")


def load(path: str, spark) -> tuple[PipelineModel, dict[str, object]]:
    """M-21."""
    return PipelineModel.load(f"{path}/model"), json.loads(spark.read.text(f"{path}/metadata").first()[0])


def prediction_errors(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """M-22: error and percentage error per row."""
    y, p = F.col(label).cast("double"), F.col(prediction).cast("double")
    return df.withColumns({"prediction_error": p - y, "abs_pct_error": pct(F.abs(p - y), F.abs(y))})
