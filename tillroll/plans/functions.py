"""Queries for the scalar functions (F-01..F-18) and the time dimension (D-44)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillroll.functions import dates as D
from tillroll.functions import text as X
from tillroll.plans.registry import plan
from tillroll.plans.tables import EVENTS_AS_OF

_FOLD = r"trim(regexp_replace({c}, '[\s\p{{Z}}]+', ' ', 'g'))"
_WORDS = r"list_filter(string_split(regexp_replace({c}, '[\s\p{{Z}}]+', ' ', 'g'), ' '), lambda w: w <> '')"


def sql_title(c: str) -> str:
    return (f"coalesce(list_aggregate(list_transform(regexp_extract_all({c}, '\\p{{L}}+|[^\\p{{L}}]+'), "
            f"lambda r: CASE WHEN r[1] = 'ß' THEN 'Ss' ELSE upper(r[1]) END || lower(r[2:])), 'string_agg', ''), '')")


def sql_fold(c: str) -> str:
    return _FOLD.format(c=c)


def sql_words(c: str) -> str:
    return _WORDS.format(c=c)


@plan("f01_strings", f"""SELECT doc_id, {sql_fold('text')} AS folded, lower(lang) AS lang_lower, len({sql_words('text')})::INTEGER AS n_words,
  {sql_words('text')}[1] AS first_word, length(text)::INTEGER AS n_chars, lpad(doc_id::VARCHAR, 8, '0') AS padded,
  concat_ws('-', lang, source) AS tag, contains(text, 'the') AS has_the, text ILIKE '%THE %' AS like_the,
  md5({sql_title('text')}) AS title_hash FROM documents""")
def _(t):
    return t.raw("documents").select(
        "doc_id", X.collapse("text").alias("folded"), F.lower("lang").alias("lang_lower"), X.word_count("text").alias("n_words"),
        X.first_word("text").alias("first_word"), F.length("text").alias("n_chars"), X.zero_pad("doc_id", 8).alias("padded"),
        F.concat_ws("-", "lang", "source").alias("tag"), F.col("text").contains("the").alias("has_the"),
        F.col("text").ilike("%THE %").alias("like_the"), F.md5(X.title_case("text")).alias("title_hash"))


@plan("f02_text_features", f"""SELECT product_id, length(product_name)::INTEGER AS name_length, len({sql_words('product_name')})::INTEGER AS name_word_count,
  length(replace(product_name, ' ', ''))::DOUBLE / len({sql_words('product_name')}) AS avg_word_length,
  regexp_matches(product_name, '[0-9]')::INTEGER AS name_contains_numbers,
  regexp_matches(product_name, '[^a-zA-Z0-9\\s]')::INTEGER AS name_has_special_chars,
  price::DOUBLE / (len({sql_words('product_name')}) + 1) AS price_per_word FROM prd""")
def _(t):
    return t.prd.select("product_id", *[c.alias(n) for n, c in X.text_features("product_name", "price").items()])


@plan("f03_patterns", f"""SELECT page_id, regexp_replace(html, '<[^>]*>', ' ', 'g') AS plain, regexp_matches(url, '{X.URL}') AS is_url,
  regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, regexp_matches(page_id::VARCHAR, '{X.ID}') AS is_id,
  regexp_matches('user' || page_id || '@mail' || (page_id % 7) || '.com', '{X.EMAIL}') AS is_email,
  regexp_matches('+84 ' || (page_id * 1000003), '{X.PHONE}') AS is_phone FROM pages""")
def _(t):
    k = F.col("page_id")
    mail = F.concat(F.lit("user"), k, F.lit("@mail"), k % 7, F.lit(".com"))
    return t.raw("pages").select(
        "page_id", F.regexp_replace("html", "<[^>]*>", " ").alias("plain"), X.matches("url", X.URL).alias("is_url"),
        F.regexp_extract("url", "^https?://([^/?#]+)", 1).alias("host"), X.matches(k.cast("string"), X.ID).alias("is_id"),
        X.matches(mail, X.EMAIL).alias("is_email"), X.matches(F.concat(F.lit("+84 "), k * 1000003), X.PHONE).alias("is_phone"))


@plan("f04_date_parts", """SELECT event_id, year(ts)::INTEGER AS year, month(ts)::INTEGER AS month, day(ts)::INTEGER AS day, hour(ts)::INTEGER AS hour,
  quarter(ts)::INTEGER AS quarter, weekofyear(ts)::INTEGER AS iso_week, dayofyear(ts)::INTEGER AS day_of_year, (isodow(ts) - 1)::INTEGER AS weekday,
  (isodow(ts) >= 6)::INTEGER AS is_weekend, (day(ts) = 1)::INTEGER AS is_month_start, (ts::DATE = last_day(ts))::INTEGER AS is_month_end,
  CASE WHEN month(ts) IN (12, 1, 2) THEN 'Winter' WHEN month(ts) < 6 THEN 'Spring' WHEN month(ts) < 9 THEN 'Summer' ELSE 'Fall' END AS season FROM act""")
def _(t):
    return t.act.select("event_id", *[c.alias(n) for n, c in D.date_parts(F.col("ts")).items()])


@plan("f05_date_arithmetic", """SELECT order_id, date_trunc('quarter', order_date)::DATE AS quarter_start, last_day(order_date)::DATE AS month_end,
  (order_date + INTERVAL 3 MONTH)::DATE AS in_three_months, date_diff('day', order_date, TIMESTAMP '2001-08-01')::INTEGER AS age_days,
  floor((epoch(TIMESTAMP '2001-08-01 12:30:00') - epoch(order_date)) / 86400)::BIGINT AS whole_days,
  order_date + INTERVAL 90 MINUTE AS later FROM ord""")
def _(t):
    d = F.col("order_date")
    return t.ord.select(
        "order_id", F.to_date(F.date_trunc("quarter", d)).alias("quarter_start"), F.last_day(d).alias("month_end"),
        F.add_months(d, 3).alias("in_three_months"), F.datediff(F.lit("2001-08-01").cast("date"), d).alias("age_days"),
        D.whole_days(d, F.lit("2001-08-01 12:30:00").cast("timestamp")).alias("whole_days"),
        (d + F.expr("INTERVAL 90 MINUTE")).alias("later"))


@plan("f06_time_key", "SELECT order_id, (year(order_date) * 10000 + month(order_date) * 100 + day(order_date))::INTEGER AS time_key FROM ord")
def _(t):
    return t.ord.select("order_id", D.time_key(F.col("order_date")).alias("time_key"))


_MD = "(month(order_date) * 100 + day(order_date))"


@plan("f07_season_flags", f"""SELECT order_id, {_MD} BETWEEN 120 AND 220 AS is_tet_season, {_MD} IN (909, 1010, 1111, 1212) AS is_shopping_festival,
  {_MD} IN (101, 430, 501, 902) AS is_vietnamese_holiday, month(order_date) = 8 AS is_ghost_month, {_MD} = 915 AS is_mid_autumn,
  {_MD} BETWEEN 1220 AND 1231 AS is_christmas_season, dayofweek(order_date) IN (0, 6) AS is_weekend,
  NOT (dayofweek(order_date) IN (0, 6) OR {_MD} IN (101, 430, 501, 902)) AS is_business_day,
  NOT (dayofweek(order_date) IN (0, 6) OR month(order_date) IN (6, 7, 8)) AS is_school_day,
  {_MD} BETWEEN 115 AND 215 AS tet_jan15_feb15, {_MD} BETWEEN 115 AND 220 AS tet_jan15_feb20, {_MD} BETWEEN 121 AND 220 AS tet_jan21_feb20 FROM ord""")
def _(t):
    d = F.col("order_date")
    return t.ord.select("order_id", *[c.alias(n) for n, c in D.season_flags(d).items()],
                        D.in_season(d, D.TET_JAN15_FEB15).alias("tet_jan15_feb15"),
                        D.in_season(d, D.TET_JAN15_FEB20).alias("tet_jan15_feb20"),
                        D.in_season(d, D.TET_JAN21_FEB20).alias("tet_jan21_feb20"))


@plan("f08_math", """SELECT product_id, round(ln(1 + price::DOUBLE), 6) AS log_price, round(log10(price::DOUBLE), 6) AS log10_price,
  least(price, 1000)::DOUBLE AS capped, greatest(stock_quantity, 10)::INTEGER AS floored, coalesce(price::DOUBLE / nullif(stock_quantity % 5, 0), 0) AS safe_ratio,
  (stock_quantity // 7)::INTEGER AS whole_sevens, round(price::DECIMAL(18,2), 0)::DOUBLE AS rounded FROM prd""")
def _(t):
    p = F.col("price")
    return t.prd.select(
        "product_id", F.round(F.log1p(p.cast("double")), 6).alias("log_price"), F.round(F.log10(p.cast("double")), 6).alias("log10_price"),
        F.least(p, F.lit(1000).cast("decimal(18,2)")).cast("double").alias("capped"), F.greatest("stock_quantity", F.lit(10)).alias("floored"),
        F.coalesce(F.try_divide(p.cast("double"), F.col("stock_quantity") % 5), F.lit(0.0)).alias("safe_ratio"),
        F.floor(F.col("stock_quantity") / 7).cast("int").alias("whole_sevens"), F.round(p, 0).cast("double").alias("rounded"))


@plan("f09_nulls", """SELECT order_id, nullif(payment_method, '5-LOW') AS method, coalesce(nullif(payment_method, '5-LOW'), 'none') AS filled,
  CASE WHEN total_amount < 0 THEN NULL ELSE total_amount::DOUBLE END AS non_negative, total_amount::DOUBLE / nullif(order_id % 3, 0) AS ratio FROM ord""")
def _(t):
    m = F.nullif(F.col("payment_method"), F.lit("5-LOW"))
    return t.ord.select("order_id", m.alias("method"), F.coalesce(m, F.lit("none")).alias("filled"),
                        F.when(F.col("total_amount") >= 0, F.col("total_amount").cast("double")).alias("non_negative"),
                        F.try_divide(F.col("total_amount").cast("double"), F.col("order_id") % 3).alias("ratio"))


@plan("f10_arrays", """WITH a AS (SELECT voucher_id, unnest(target_segments) AS segment, list_contains(target_segments, 'BUILDING') AS hits,
    array_to_string(target_segments, ', ') AS joined, target_segments[1:1] AS head FROM vch)
  SELECT c.customer_id, a.voucher_id, a.segment, a.hits, a.joined, a.head[1] AS head FROM cst c JOIN a ON a.segment = c.customer_segment""")
def _(t):
    a = t.vch.select("voucher_id", F.explode("target_segments").alias("customer_segment"),
                     F.array_contains("target_segments", "BUILDING").alias("hits"), F.array_join("target_segments", ", ").alias("joined"),
                     F.slice("target_segments", 1, 1)[0].alias("head"))
    return t.cst.select("customer_id", "customer_segment").join(a, "customer_segment").withColumnRenamed("customer_segment", "segment")


@plan("f11_json", """SELECT event_id, (props->>'$.k')::BIGINT AS k, '{"id":' || event_id || ',"type":"' || activity_type || '"}' AS packed,
  (('{"id":' || event_id || ',"type":"' || activity_type || '"}')::JSON->>'$.type') AS unpacked,
  json_array_length(('[' || (props->>'$.k') || ',1,2]')::JSON)::INTEGER AS n_items FROM act""")
def _(t):
    packed = F.to_json(F.struct(F.col("event_id").alias("id"), F.col("activity_type").alias("type")))
    k = F.from_json("props", "k BIGINT")["k"]
    return t.act.select("event_id", k.alias("k"), packed.alias("packed"), F.get_json_object(packed, "$.type").alias("unpacked"),
                        F.size(F.from_json(F.concat(F.lit("["), k, F.lit(",1,2]")), "array<int>")).alias("n_items"))


@plan("f12_map_codes", """SELECT order_id, CASE order_status WHEN 'F' THEN 'Finished' WHEN 'O' THEN 'Open' ELSE order_status END AS status_label,
  CASE order_status WHEN 'F' THEN 1.0 WHEN 'O' THEN 0.5 ELSE 0.0 END::DOUBLE AS status_weight FROM ord""")
def _(t):
    s = F.col("order_status")
    weights = F.map_from_arrays(F.array(F.lit("F"), F.lit("O")), F.array(F.lit(1.0), F.lit(0.5)))
    return t.ord.select("order_id", X.map_code(s, {"F": "Finished", "O": "Open"}, s).alias("status_label"),
                        F.coalesce(F.try_element_at(weights, s), F.lit(0.0)).alias("status_weight"))


@plan("f13_content_hash", """SELECT page_id, sha256('{"page_id": ' || page_id || ', "url": ' || to_json(url)::VARCHAR || '}') AS hash FROM pages""")
def _(t):
    return t.raw("pages").select("page_id", X.content_hash(["page_id", "url"]).alias("hash"))


@plan("f14_stable_id", "SELECT order_id, 'ORD_' || substr(sha256(order_id || chr(1) || customer_id), 1, 16) AS id FROM ord")
def _(t):
    return t.ord.select("order_id", X.stable_id("ORD_", "order_id", "customer_id").alias("id"))


@plan("f15_human_bytes", """WITH d AS (SELECT doc_id, n_chars::DOUBLE * pow(1024, doc_id % 6) AS b FROM documents)
  SELECT doc_id, CASE WHEN b < 1024 THEN format('{:.2f} B', b) WHEN b / 1024 < 1024 THEN format('{:.2f} KB', b / 1024) WHEN b / 1048576 < 1024 THEN format('{:.2f} MB', b / 1048576)
  WHEN b / 1073741824 < 1024 THEN format('{:.2f} GB', b / 1073741824) WHEN b / 1099511627776 < 1024 THEN format('{:.2f} TB', b / 1099511627776) ELSE format('{:.2f} PB', b / 1125899906842624) END AS size FROM d""")
def _(t):
    return t.raw("documents").select("doc_id", X.human_bytes(F.col("n_chars").cast("double") * F.pow(F.lit(1024.0), F.col("doc_id") % 6)).alias("size"))


@plan("f16_casts", """SELECT doc_id, TRY_CAST(substr(text, 1, 4) AS INTEGER) AS as_int, TRY_CAST(CASE doc_id % 4 WHEN 0 THEN '2024-02-30' WHEN 1
  THEN '2024-02-29' WHEN 2 THEN 'soon' ELSE NULL END AS DATE) AS as_date, TRY_CAST(CASE doc_id % 3 WHEN 0 THEN '12.5' WHEN 1 THEN 'x' ELSE '7' END AS DOUBLE) AS as_double
  FROM documents""")
def _(t):
    k = F.col("doc_id")
    day = F.when(k % 4 == 0, "2024-02-30").when(k % 4 == 1, "2024-02-29").when(k % 4 == 2, "soon")
    num = F.when(k % 3 == 0, "12.5").when(k % 3 == 1, "x").otherwise("7")
    return t.raw("documents").select("doc_id", F.substring("text", 1, 4).try_cast("int").alias("as_int"),
                                     day.try_cast("date").alias("as_date"), num.try_cast("double").alias("as_double"))


@plan("f17_iso_timestamps", f"""SELECT event_id, CASE event_id % 4 WHEN 0 THEN ts::TIMESTAMP WHEN 1 THEN ts::TIMESTAMP ELSE TIMESTAMP '{EVENTS_AS_OF}' END AS parsed
  FROM (SELECT event_id, date_trunc('second', ts) AS ts FROM act)""")
def _(t):
    iso = F.date_format(F.date_trunc("second", "ts"), "yyyy-MM-dd'T'HH:mm:ss")
    k = F.col("event_id") % 4
    text = F.when(k == 0, F.concat(iso, F.lit("Z"))).when(k == 1, iso).when(k == 2, F.replace(iso, F.lit("T"), F.lit(" "))).otherwise("noT")
    return t.act.select("event_id", X.parse_iso(text, F.lit(EVENTS_AS_OF).cast("timestamp_ntz")).alias("parsed"))


@plan("f18_hashtags", r"""SELECT doc_id, array_to_string(regexp_extract_all('#' || lang || ' ' || text || ' #' || source, '#[\p{L}\p{N}_]+'), '|') AS tags FROM documents""")
def _(t):
    whole = F.concat(F.lit("#"), F.col("lang"), F.lit(" "), F.col("text"), F.lit(" #"), F.col("source"))
    return t.raw("documents").select("doc_id", F.array_join(X.hashtags(whole), "|").alias("tags"))


def _pick_sql(values, number):
    return "[" + ", ".join(f"'{v}'" for v in values) + f"][{number}]"


_D = "d"
_DMD = "(month(d) * 100 + day(d))"


def _label_sql(names):
    return "CASE " + " ".join(f"WHEN {_DMD} = {m * 100 + x} THEN '{v}'" for (m, x), v in names.items()) + " END"


@plan("d44_time_dimension", f"""WITH days AS (SELECT DISTINCT order_date::DATE AS d FROM ord) SELECT d AS date_value, (dayofweek(d) + 1)::INTEGER AS day_of_week,
  {_pick_sql(D.DAYS_VI, 'dayofweek(d) + 1')} AS day_name_vietnamese, {_pick_sql(D.DAYS_EN, 'dayofweek(d) + 1')} AS day_name_english,
  day(d)::INTEGER AS day_of_month, dayofyear(d)::INTEGER AS day_of_year, weekofyear(d)::INTEGER AS week_of_year,
  date_trunc('week', d)::DATE AS week_start_date, (date_trunc('week', d) + INTERVAL 6 DAY)::DATE AS week_end_date, month(d)::INTEGER AS month_number,
  {_pick_sql(D.MONTHS_VI, 'month(d)')} AS month_name_vietnamese, {_pick_sql(D.MONTHS_EN, 'month(d)')} AS month_name_english,
  'T' || month(d) AS month_short_vietnamese, date_trunc('month', d)::DATE AS month_start_date, last_day(d)::DATE AS month_end_date,
  quarter(d)::INTEGER AS quarter_number, 'Quý ' || quarter(d) AS quarter_name_vietnamese, 'Q' || quarter(d) AS quarter_name_english,
  date_trunc('quarter', d)::DATE AS quarter_start_date, (date_trunc('quarter', d) + INTERVAL 3 MONTH - INTERVAL 1 DAY)::DATE AS quarter_end_date,
  year(d)::INTEGER AS year_number, date_trunc('year', d)::DATE AS year_start_date, (date_trunc('year', d) + INTERVAL 1 YEAR - INTERVAL 1 DAY)::DATE AS year_end_date,
  {_DMD} IN (101, 430, 501, 902) AS is_vietnamese_holiday, {_label_sql({k: v[0] for k, v in D.HOLIDAYS.items()})} AS vietnamese_holiday_name,
  {_label_sql({k: v[1] for k, v in D.HOLIDAYS.items()})} AS holiday_type, {_DMD} BETWEEN 115 AND 215 AS is_tet_season, month(d) = 8 AS is_ghost_month,
  {_DMD} = 915 AS is_mid_autumn, {_DMD} BETWEEN 1220 AND 1231 AS is_christmas_season, {_DMD} IN (909, 1010, 1111, 1212) AS is_shopping_festival,
  {_label_sql(D.FESTIVAL_NAMES)} AS shopping_festival_name, dayofweek(d) IN (0, 6) AS is_weekend,
  NOT (dayofweek(d) IN (0, 6) OR {_DMD} IN (101, 430, 501, 902)) AS is_business_day, NOT (dayofweek(d) IN (0, 6) OR month(d) IN (6, 7, 8)) AS is_school_day,
  year(d)::INTEGER AS fiscal_year, quarter(d)::INTEGER AS fiscal_quarter, month(d)::INTEGER AS fiscal_month FROM days""")
def _(t):
    days = t.ord.select(F.to_date("order_date").alias("d")).distinct()
    return D.with_calendar(days, "d")
