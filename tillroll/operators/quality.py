"""Data quality: schema, completeness, accuracy, consistency, rules, contracts, profile, drift, anomalies.

Each check is one aggregate over all columns at once; results are rows (check, column, figures).
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillroll.functions import text as X
from tillroll.functions.numbers import pct, pct2, ratio
from tillroll.operators.clean import DatasetSpec, iqr_bounds, numeric_columns
from tillroll.operators.ordering import quantiles


def _long(df: DataFrame, columns: Sequence[str], figures: Mapping[str, Callable[[str], Column]]) -> DataFrame:
    """Aggregate ``figures`` for every column in one pass and turn the one row into one row per column."""
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), *[fn(c).alias(n) for n, fn in figures.items()]) for c in columns])
    return df.agg(cells.alias("_c")).select(F.explode("_c").alias("_r")).select("_r.*")


def schema_issues(df: DataFrame, spec: DatasetSpec) -> DataFrame:
    """Q-01: missing and extra columns and wrong type classes."""
    rows = [("missing_column", c, "") for c in spec.expected if c not in df.columns]
    rows += [("extra_column", c, "") for c in df.columns if c not in spec.expected]
    kinds = {"numeric": T.NumericType, "datetime": (T.DateType, T.TimestampType, T.TimestampNTZType)}
    for c, want in spec.types.items():
        if c in df.columns and not isinstance(df.schema[c].dataType, kinds[want]):
            rows.append(("wrong_type", c, f"expected {want}, found {df.schema[c].dataType.simpleString()}"))
    return df.sparkSession.createDataFrame(rows, "issue string, column_name string, detail string")


# Parts of column names and the null share they allow.
CRITICAL_COLUMNS = ("id", "customer_id", "product_id", "order_id")
IMPORTANT_COLUMNS = ("timestamp", "created_at", "processed_at")


def _severity(column: str) -> tuple[str, float]:
    if any(k in column.lower() for k in CRITICAL_COLUMNS):
        return "critical", 0.0
    if any(k in column.lower() for k in IMPORTANT_COLUMNS):
        return "high", 1.0
    return "medium", 20.0


def completeness(df: DataFrame) -> DataFrame:
    """Q-02: null share per column against the limit of its class."""
    out = _long(df, df.columns, {"null_count": lambda c: F.count_if(F.col(c).isNull()), "total": lambda c: F.count("*")})
    grade = F.create_map(*[F.lit(x) for c in df.columns for x in (c, _severity(c)[0])])
    limit = F.create_map(*[F.lit(x) for c in df.columns for x in (c, _severity(c)[1])])
    return out.select("column_name", "null_count", pct2(F.col("null_count"), F.col("total")).alias("null_percentage"),
                      F.element_at(grade, F.col("column_name")).alias("severity"), F.element_at(limit, F.col("column_name")).alias("threshold")).withColumn(
        "passed", F.col("null_percentage") <= F.col("threshold"))


def completeness_total(df: DataFrame) -> DataFrame:
    """Q-02: 100 minus the mean null share."""
    return completeness(df).agg(F.round(100 - F.avg("null_percentage"), 2).alias("overall_completeness"), F.count_if(~F.col("passed")).alias("issues"))


def rule_check(df: DataFrame, rules: Mapping[str, Column | str]) -> DataFrame:
    """Q-03, Q-05, Q-08: rows that break each rule; a rule that is null for a row counts as broken."""
    tests = {n: F.expr(r) if isinstance(r, str) else r for n, r in rules.items()}
    cells = F.array(*[F.struct(F.lit(n).alias("rule"), F.count_if(~F.coalesce(t, F.lit(False))).alias("failed_records"), F.count("*").alias("total_records")) for n, t in tests.items()])
    out = df.agg(cells.alias("_c")).select(F.explode("_c").alias("_r")).select("_r.*")
    return out.withColumn("failed_pct", pct2(F.col("failed_records"), F.col("total_records"))).withColumn("passed", F.col("failed_records") == 0)


def range_rule(column: str, low: float | None = None, high: float | None = None) -> Column:
    """Q-05: inside the range; null passes, as a comparison with null does in the source."""
    c = F.col(column)
    test = F.lit(True)
    if low is not None:
        test = test & ~F.coalesce(c < low, F.lit(False))
    if high is not None:
        test = test & ~F.coalesce(c > high, F.lit(False))
    return test


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Q-03: rows that repeat an earlier one."""
    return df.groupBy(*df.columns).agg(F.count("*").alias("_n")).agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicates"), F.coalesce(F.sum("_n"), F.lit(0)).alias("total"))


def extreme_outliers(df: DataFrame, columns: Sequence[str] | None = None, share: float = 0.05) -> DataFrame:
    """Q-03: values outside 3 IQR per column; flagged above the allowed share."""
    columns = list(columns or numeric_columns(df))
    b = iqr_bounds(df, columns, 3.0).agg(F.map_from_entries(F.collect_list(F.struct("column_name", F.struct("low", "high")))).alias("m")).scalar()
    rows = df.select(*columns).withColumn("_b", b)
    def outside(c: str) -> Column:
        lim = F.try_element_at("_b", F.lit(c))
        return F.count_if(~F.col(c).cast("double").between(lim["low"], lim["high"]))
    out = _long(rows, columns, {"outliers": outside, "total": lambda c: F.count("*")})
    return out.withColumn("outlier_share", ratio(F.col("outliers"), F.col("total"))).withColumn("flagged", F.col("outlier_share") > share)


def consistency(df: DataFrame, dates: Sequence[str] = (), texts: Sequence[str] = (), ids: Sequence[str] = ()) -> DataFrame:
    """Q-04: unreadable dates, values that differ only by case, ids off the pattern."""
    cells = []
    for c in dates:
        bad = F.count_if(F.col(c).isNotNull() & F.try_to_timestamp(F.col(c)).isNull())
        cells.append(F.struct(F.lit("date_format").alias("check"), F.lit(c).alias("column_name"), bad.alias("failed")))
    for c in texts:
        cells.append(F.struct(F.lit("case_variants").alias("check"), F.lit(c).alias("column_name"), (F.countDistinct(c) - F.countDistinct(F.lower(c))).alias("failed")))
    for c in ids:
        cells.append(F.struct(F.lit("id_pattern").alias("check"), F.lit(c).alias("column_name"), F.count_if(~X.matches(F.col(c).cast("string"), X.ID)).alias("failed")))
    return df.agg(F.array(*cells).alias("_c")).select(F.explode("_c").alias("_r")).select("_r.*").withColumn("passed", F.col("failed") == 0)


def profile(df: DataFrame, approximate: bool = False) -> DataFrame:
    """Q-06, D-50: nulls, distinct values, min, max, mean, std, quartiles and text lengths per column.

    Distinct values are counted from (column, value) pairs, folded in each task; ``approximate`` replaces them by sketches in the one pass.
    """
    numbers = set(numeric_columns(df))
    texts = {f.name for f in df.schema if isinstance(f.dataType, T.StringType)}
    num = lambda c: F.col(c).cast("double") if c in numbers else F.lit(None).cast("double")
    size = lambda c: F.length(c) if c in texts else F.lit(None).cast("int")
    sketch = {"unique_count": lambda c: F.approx_count_distinct(F.col(c))} if approximate else {}
    out = _long(df, df.columns, {
        "row_count": lambda c: F.count("*"), "null_count": lambda c: F.count_if(F.col(c).isNull()), **sketch,
        "min": lambda c: F.min(num(c)), "max": lambda c: F.max(num(c)), "mean": lambda c: F.round(F.avg(num(c)), 4), "std": lambda c: F.round(F.stddev_samp(num(c)), 4),
        "min_length": lambda c: F.min(size(c)), "max_length": lambda c: F.max(size(c)), "avg_length": lambda c: F.round(F.avg(size(c)), 4)})
    if not approximate:
        pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in df.columns]))
        values = df.select(pairs.alias("_p")).select("_p.*").where("value IS NOT NULL").groupBy("column_name", "value").agg(F.count("*").alias("n"))
        out = out.join(values.groupBy("column_name").agg(F.count("*").alias("unique_count")), "column_name", "left").withColumn("unique_count", F.coalesce("unique_count", F.lit(0)))
    if numbers:
        q = quantiles(df, sorted(numbers), [0.25, 0.5, 0.75]).select("column_name", *[F.round(f"q{i}", 4).alias(n) for i, n in enumerate(("q1", "median", "q3"))])
        out = out.join(q, "column_name", "left")
    return out.withColumn("null_percentage", pct2(F.col("null_count"), F.col("row_count")))


def top_values(df: DataFrame, columns: Sequence[str], k: int = 5) -> DataFrame:
    """Q-06: the k most frequent values per column."""
    from tillroll.operators.windows import top_k_per_group
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in columns]))
    g = df.select(pairs.alias("_p")).select("_p.*").where("value IS NOT NULL").groupBy("column_name", "value").agg(F.count("*").alias("n"))
    return top_k_per_group(g, "column_name", "value", F.col("n"), k).drop("score")


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Q-07: correlation of every column pair in one aggregate."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1:]]
    cells = F.array(*[F.struct(F.lit(a).alias("column1"), F.lit(b).alias("column2"), F.round(F.corr(F.col(a).cast("double"), F.col(b).cast("double")), 6).alias("correlation")) for a, b in pairs])
    out = df.agg(cells.alias("_c")).select(F.explode("_c").alias("_r")).select("_r.*")
    return out.withColumn("high", F.abs("correlation") > 0.8)


# Q-08: constraints of the warehouse tables as rules.
CONSTRAINTS = {
    "fact_sales": {"quantity_positive": "quantity_ordered > 0", "shipped_le_ordered": "quantity_shipped <= quantity_ordered",
                   "returned_le_shipped": "quantity_returned <= quantity_shipped", "cancelled_le_ordered": "quantity_cancelled <= quantity_ordered",
                   "gross_ge_net": "gross_sales_amount_vnd >= net_sales_amount_vnd", "net_not_negative": "net_sales_amount_vnd >= 0", "discount_not_negative": "discount_amount_vnd >= 0"},
    "vouchers": {"valid_date_range": "end_date > start_date", "valid_discount": "discount_value > 0", "valid_limit": "usage_limit IS NULL OR usage_limit > 0",
                 "known_type": "voucher_type IN ('percentage', 'fixed_amount', 'free_shipping', 'buy_x_get_y')",
                 "known_target": "target_type IN ('all_customers', 'customer_segment', 'specific_customers', 'new_customers')"},
    "feedback": {"score_range": "sentiment_score BETWEEN -1 AND 1", "known_label": "sentiment_label IN ('very_positive', 'positive', 'neutral', 'negative', 'very_negative')",
                 "known_priority": "priority IN ('low', 'medium', 'high', 'critical')"},
    "classification": {"recency_score": "recency_score BETWEEN 1 AND 5", "frequency_score": "frequency_score BETWEEN 1 AND 5", "monetary_score": "monetary_score BETWEEN 1 AND 5",
                       "churn_range": "churn_probability BETWEEN 0 AND 1"},
}


@dataclass(frozen=True)
class Field:
    """One property of a JSON contract."""

    type: str = "string"
    pattern: str | None = None
    minimum: float | None = None
    enum: tuple[str, ...] = ()
    min_length: int | None = None
    max_length: int | None = None
    nullable: bool = False


@dataclass(frozen=True)
class Contract:
    """Q-09: required fields, properties, whether other fields are allowed, and the level."""

    required: tuple[str, ...]
    fields: Mapping[str, Field]
    additional: bool = False
    level: str = "strict"
    ranges: Mapping[str, tuple[float | None, float | None]] = field(default_factory=dict)


_KEY = Field(pattern=X.ID)
_SOURCE = Field(enum=("olist", "synthetic", "api"))
_COUNT, _SIZE = Field("integer", minimum=0), Field("number", minimum=0)
_TIME, _OPTIONAL = Field(), Field(nullable=True)
# The default topic contracts.
CONTRACTS = {
    "products": Contract(("product_id", "timestamp"), {
        "product_id": _KEY, "product_category_name": Field(), "product_name_length": _COUNT, "product_description_length": _COUNT, "product_photos_qty": _COUNT,
        "product_weight_g": _SIZE, "product_length_cm": _SIZE, "product_height_cm": _SIZE, "product_width_cm": _SIZE, "timestamp": _TIME, "source": _SOURCE}),
    "customers": Contract(("customer_id", "timestamp"), {
        "customer_id": _KEY, "customer_unique_id": Field(), "customer_zip_code_prefix": Field(pattern="^[0-9]{5}$"), "customer_city": Field(),
        "customer_state": Field(min_length=2, max_length=2), "timestamp": _TIME, "source": _SOURCE}),
    "orders": Contract(("order_id", "customer_id", "order_status", "timestamp"), {
        "order_id": _KEY, "customer_id": _KEY, "order_status": Field(enum=("delivered", "shipped", "processing", "invoiced", "canceled", "unavailable", "approved")),
        "order_purchase_timestamp": _TIME, **{c: _OPTIONAL for c in ("order_approved_at", "order_delivered_carrier_date", "order_delivered_customer_date", "order_estimated_delivery_date")},
        "timestamp": _TIME, "source": _SOURCE}),
    "customer_create": Contract(("customer_id", "email", "first_name", "last_name", "country"), {
        "customer_id": Field(max_length=50), "email": Field(max_length=255), "first_name": Field(max_length=100), "last_name": Field(max_length=100),
        "phone": Field(nullable=True, max_length=20), "country": Field(max_length=100), "state": Field(nullable=True, max_length=100),
        "city": Field(nullable=True, max_length=100), "marketing_consent": Field("boolean")}),
}
def _type_ok(kind: str, schema: Column, text: Column) -> Column:
    number = schema.rlike("^(BIGINT|DECIMAL|DOUBLE)")
    return {"string": schema == "STRING", "boolean": schema == "BOOLEAN", "number": number,
            "integer": number & (text.try_cast("double") == F.floor(text.try_cast("double")))}[kind]


def check_contract(df: DataFrame, json_text: str, contract: Contract) -> DataFrame:
    """Q-09: adds ``errors`` (``kind:field``), ``warnings`` and ``is_valid`` for a JSON text column.

    The text is parsed once to a variant, which keeps the JSON types: ``"5"`` and ``5`` differ as the
    contract demands. strict: everything is an error; moderate: only malformed, required, type and range;
    lenient: only malformed and range (required and type become warnings, the rest is ignored).
    """
    # Each step is exploded from an array of one, so Spark keeps its values instead of computing them anew for every test that uses them.
    once = lambda rows, **values: rows.select("*", F.explode(F.array(F.struct(*[v.alias(k) for k, v in values.items()]))).alias("_v")).select(*rows.columns, "_v.*")
    rows = once(df, _doc=F.try_parse_json(json_text), _keys=F.json_object_keys(json_text))
    wanted = [*contract.fields, *[n for n in contract.ranges if n not in contract.fields]]
    value = lambda n, kind: F.try_variant_get("_doc", f"$.{n}", kind)
    rows = once(rows, **{f"_f{i}": F.struct(F.array_contains("_keys", n).alias("there"), F.schema_of_variant(value(n, "variant")).alias("kind"), value(n, "string").alias("text"))
                         for i, n in enumerate(wanted)})
    tests = [F.when(F.col("_doc").isNull() | F.col("_keys").isNull(), "malformed")]
    tests += [F.when(~F.array_contains("_keys", n), f"required:{n}") for n in contract.required]
    for i, (name, f) in enumerate(contract.fields.items()):
        there, kind, text = (F.col(f"_f{i}")[p] for p in ("there", "kind", "text"))
        fits = F.coalesce(_type_ok(f.type, kind, text), F.lit(False))
        blank = F.coalesce(kind == "VOID", F.lit(True))
        tests.append(F.when(there & ~fits & ~(F.lit(f.nullable) & blank), f"type:{name}"))
        ok = there & fits
        if f.pattern:
            tests.append(F.when(ok & ~text.rlike(f.pattern), f"pattern:{name}"))
        if f.minimum is not None:
            tests.append(F.when(ok & (text.try_cast("double") < f.minimum), f"minimum:{name}"))
        if f.enum:
            tests.append(F.when(ok & ~text.isin(list(f.enum)), f"enum:{name}"))
        if f.min_length is not None:
            tests.append(F.when(ok & (F.length(text) < f.min_length), f"minLength:{name}"))
        if f.max_length is not None:
            tests.append(F.when(ok & (F.length(text) > f.max_length), f"maxLength:{name}"))
    for name, (low, high) in contract.ranges.items():
        v = F.col(f"_f{wanted.index(name)}")["text"].try_cast("double")
        out = F.lit(False)
        if low is not None:
            out = out | F.coalesce(v < low, F.lit(False))
        if high is not None:
            out = out | F.coalesce(v > high, F.lit(False))
        tests.append(F.when(out, f"range:{name}"))
    found = F.array_compact(F.array(*tests))
    if not contract.additional:
        extra = F.transform(F.array_except("_keys", F.array(*[F.lit(n) for n in contract.fields])), lambda n: F.concat(F.lit("additional:"), n))
        found = F.concat(found, F.coalesce(extra, F.array().cast("array<string>")))
    rows = rows.withColumn("_found", found)
    kind_of = lambda e: F.split(e, ":")[0]
    hard = {"strict": None, "moderate": ["malformed", "required", "type", "range"], "lenient": ["malformed", "range"]}[contract.level]
    if hard is None:
        errors, warnings = F.col("_found"), F.array().cast("array<string>")
    else:
        errors = F.filter("_found", lambda e: kind_of(e).isin(hard))
        soft = F.filter("_found", lambda e: ~kind_of(e).isin(hard))
        warnings = soft if contract.level == "moderate" else F.filter("_found", lambda e: kind_of(e).isin("required", "type"))
    return rows.select(*df.columns, errors.alias("errors"), warnings.alias("warnings")).withColumn("is_valid", F.size("errors") == 0)


def z_anomalies(df: DataFrame, columns: Sequence[str], z: float = 3.0) -> DataFrame:
    """Q-10: values more than z population standard deviations from the mean, for columns with over 10 values."""
    stats = _long(df, columns, {"n": lambda c: F.count(c), "mean": lambda c: F.avg(F.col(c).cast("double")), "sd": lambda c: F.stddev_pop(F.col(c).cast("double"))})
    m = stats.agg(F.map_from_entries(F.collect_list(F.struct("column_name", F.struct("n", "mean", "sd")))).alias("m")).scalar()
    rows = df.select(*columns).withColumn("_m", m)
    def far(c: str) -> Column:
        s = F.try_element_at("_m", F.lit(c))
        return F.count_if((s["n"] > 10) & (F.abs(F.col(c).cast("double") - s["mean"]) > s["sd"] * z))
    out = _long(rows, columns, {"anomaly_count": far, "total": lambda c: F.count("*")})
    return out.select("column_name", "anomaly_count", pct2(F.col("anomaly_count"), F.col("total")).alias("anomaly_percentage"))


def busy_hours(df: DataFrame, ts: str, k: float = 2.0) -> DataFrame:
    """Q-10: hours of the day with more rows than mean + k std."""
    g = df.groupBy(F.hour(ts).alias("hour_of_day")).agg(F.count("*").alias("n"))
    limit = g.agg((F.avg("n") + F.lit(k) * F.stddev_samp("n")).alias("limit")).scalar()
    return g.where(F.col("n") > limit)


_OPS = {">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, "==": lambda a, b: a == b, "!=": lambda a, b: a != b}


def sql_check(spark: SparkSession, name: str, query: str, expected: float = 0, operator: str = "==", views: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """Q-11: one-value SQL check compared with the expected value; by default any value but 0 fails."""
    result = spark.sql(query, args=None, **(views or {}))
    return result.select(F.lit(name).alias("check_name"), F.col(result.columns[0]).cast("double").alias("value")).withColumn(
        "passed", _OPS[operator](F.col("value"), F.lit(float(expected))))


CHECKS: dict[str, Callable[[DataFrame], DataFrame]] = {}


def register_check(name: str):
    """U-04: register a custom check ``DataFrame -> DataFrame`` of result rows."""
    def keep(fn: Callable[[DataFrame], DataFrame]):
        CHECKS[name] = fn
        return fn
    return keep


def run_checks(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """U-04: results of registered checks as one frame with the check's name."""
    out = None
    for n in names:
        part = CHECKS[n](df).withColumn("check_name", F.lit(n))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def score(results: DataFrame, by: Sequence[str] = (), good: float = 80, warn: float = 60) -> DataFrame:
    """Q-12: share of passed checks and the status."""
    g = results.groupBy(*by).agg(F.count("*").alias("total_checks"), F.count_if("passed").alias("passed_checks"))
    s = pct(F.col("passed_checks"), F.col("total_checks"), 0)
    return g.withColumn("quality_score", s).withColumn("status", F.when(s >= good, "good").when(s >= warn, "warning").otherwise("critical"))


def freshness(tables: Mapping[str, tuple[DataFrame, str, int]], as_of: str) -> DataFrame:
    """Q-13: age of the newest row per table against a limit in minutes."""
    out = None
    now = F.lit(as_of).cast("timestamp_ntz").cast("timestamp")
    for name, (df, ts, limit) in tables.items():
        age = (F.unix_timestamp(now) - F.unix_timestamp(F.max(ts).cast("timestamp"))) / 60.0
        part = df.agg(F.max(ts).alias("latest"), age.alias("age_minutes")).select(F.lit(name).alias("table_name"), "latest", F.floor("age_minutes").alias("age_minutes"), F.lit(limit).alias("limit_minutes"))
        out = part if out is None else out.unionByName(part)
    return out.withColumn("fresh", F.col("age_minutes") <= F.col("limit_minutes"))


def freshness_decision(ratios: DataFrame) -> DataFrame:
    """Q-13: share of sources with fresh rows and the path to take."""
    s = pct(F.count_if(F.col("fresh_ratio") > 0), F.greatest(F.count("*"), F.lit(1)))
    return ratios.agg(s.alias("quality_score"), F.sum("fresh_rows").alias("total_fresh_records")).withColumn(
        "recommendation", F.when(F.col("quality_score") >= 70, "proceed").when(F.col("quality_score") >= 40, "proceed_with_caution").otherwise("skip_processing"))


def drift(reference: DataFrame, current: DataFrame, columns: Sequence[str], threshold: float = 0.1) -> DataFrame:
    """Q-14: relative change of mean and std per column."""
    figures = {"mean": lambda c: F.avg(F.col(c).cast("double")), "std": lambda c: F.stddev_samp(F.col(c).cast("double"))}
    ref = _long(reference, columns, figures).withColumnsRenamed({"mean": "reference_mean", "std": "reference_std"})
    cur = _long(current, columns, figures).withColumnsRenamed({"mean": "current_mean", "std": "current_std"})
    change = lambda a, b: F.coalesce(F.try_divide(F.abs(F.col(b) - F.col(a)), F.abs(F.col(a))), F.lit(0.0))
    out = ref.join(cur, "column_name").withColumns({"mean_change": change("reference_mean", "current_mean"), "std_change": change("reference_std", "current_std")})
    out = out.withColumn("drift_detected", (F.col("mean_change") > threshold) | (F.col("std_change") > threshold))
    return out.withColumns({c: F.round(c, 6) for c in ("reference_mean", "reference_std", "current_mean", "current_std", "mean_change", "std_change")})


def drift_summary(drifts: DataFrame) -> DataFrame:
    """Q-14."""
    return drifts.agg(F.count("*").alias("total_features"), F.count_if("drift_detected").alias("drifted_features")).withColumn(
        "drift_percentage", pct(F.col("drifted_features"), F.col("total_features"), 0))


def dimension_completeness(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Q-16: filled share per column."""
    return _long(df, columns, {"total": lambda c: F.count("*"), "filled": lambda c: F.count(c)}).withColumn("completeness", ratio(F.col("filled"), F.col("total"), 0))


def accuracy_rate(df: DataFrame, name: str, test: Column) -> DataFrame:
    """Q-16: share of rows for which the test holds (price consistency, phone format)."""
    return df.agg(F.lit(name).alias("check_name"), F.count("*").alias("total_checked"), F.count_if(test).alias("valid_count")).withColumn(
        "accuracy_rate", ratio(F.col("valid_count"), F.col("total_checked"), 0))


def price_consistent(vnd: str, usd: str, rate: int = 24000) -> Column:
    """Q-16."""
    return F.abs(F.col(vnd) - F.col(usd) * rate) < 100


# Limits on duplicates, empty strings and bad e-mail addresses.
RATE_LIMITS = {"duplicate_rate": 0.01, "empty_rate": 0.02, "bad_email_rate": 0.05}


def uniqueness_rates(df: DataFrame, key: str, text: str, email: str) -> DataFrame:
    """Q-17: duplicate keys, empty strings and malformed addresses against their limits."""
    n = F.count("*")
    rates = {"duplicate_rate": ratio(n - F.countDistinct(key), n, 0), "empty_rate": ratio(F.count_if(F.trim(text) == ""), n, 0),
             "bad_email_rate": ratio(F.count_if(~X.matches(email, X.EMAIL)), n, 0)}
    cells = F.array(*[F.struct(F.lit(k).alias("check_name"), v.alias("rate"), F.lit(RATE_LIMITS[k]).alias("threshold")) for k, v in rates.items()])
    return df.agg(cells.alias("_c")).select(F.explode("_c").alias("_r")).select("_r.*").withColumn("passed", F.col("rate") <= F.col("threshold"))


def reconcile(stages: Mapping[str, DataFrame]) -> DataFrame:
    """Q-18: rows per stage and the capped success rate against the stage before."""
    out = None
    for i, (name, df) in enumerate(stages.items()):
        part = df.agg(F.count("*").alias("n")).select(F.lit(i).alias("step"), F.lit(name).alias("stage"), "n")
        out = part if out is None else out.unionByName(part)
    before = out.select((F.col("step") + 1).alias("step"), F.col("n").alias("before"))
    rate = F.least(F.lit(100.0), pct(F.col("n"), F.col("before"), 0))
    return out.join(before, "step", "left").withColumn("success_rate", F.when(F.col("step") == 0, F.lit(None)).otherwise(rate)).select("step", "stage", "n", "success_rate")


def health(stages: DataFrame) -> DataFrame:
    """Q-18: mean success rate."""
    return stages.agg(F.avg("success_rate").alias("health_score"))


def recent_results(results: DataFrame, as_of: str, hours: int) -> DataFrame:
    """Q-19: passed, failed and success rate of the last hours."""
    rows = results.where(F.col("checked_at") >= F.expr(f"TIMESTAMP_NTZ '{as_of}' - INTERVAL {hours} HOUR"))
    return rows.groupBy("check_name").agg(F.count("*").alias("total"), F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed"),
                                          pct(F.count_if("passed"), F.count("*")).alias("success_rate"))
