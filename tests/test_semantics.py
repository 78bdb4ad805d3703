"""Edge cases of cleaning, text, discount, quality and catalogue operators on small hand-made frames."""

from dataclasses import replace

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tillroll.functions import dates as D
from tillroll.functions import text as X
from tillroll.operators import clean as C
from tillroll.operators import joins as J
from tillroll.operators import load as L
from tillroll.operators import presence as PR
from tillroll.operators import quality as Q
from tillroll.operators import sales as S
from tillroll.operators import vouchers as V
from tillroll.operators import windows as W


def one(df):
    return df.first()[0]


def values(spark, column, rows, kind="string"):
    return [r[0] for r in spark.createDataFrame([(r,) for r in rows], f"v {kind}").select(column).collect()]


def test_text_rules(spark):
    assert values(spark, X.title_case("v"), ["o'neil town", "straße", "nguyễn văn a"]) == ["O'Neil Town", "Straße", "Nguyễn Văn A"]
    assert values(spark, X.zero_pad("v", 5), ["12", "1234567"]) == ["00012", "1234567"]
    assert values(spark, X.slug("v"), [None, "_Home & Garden!"]) == ["unknown", "home___garden"]
    assert values(spark, X.phone_number("v"), ["84 901-234", "0901", "77"]) == ["+84901234", "+84901", "+8477"]
    assert values(spark, X.clean_feedback("v"), ["Tốt!!  RẤT nhanh :)"]) == ["tốt rất nhanh"]
    assert values(spark, X.hashtags("v"), ["#a b #c_1"]) == [["#a", "#c_1"]]
    assert values(spark, X.ngrams(X.words("v"), 3), ["a b c d", "a b"]) == [["a b c", "b c d"], []]
    assert values(spark, X.human_bytes("v"), [1023, 1536], "bigint") == ["1023.00 B", "1.50 KB"]


def test_calendar_edges(spark):
    days = ["2024-02-29", "2024-12-31", "2024-01-19", "2024-01-20", "2024-02-20", "2024-02-21"]
    rows = spark.createDataFrame([(d,) for d in days], "s string").select(F.to_date("s").alias("d"))
    assert [r[0] for r in rows.select(D.time_key(F.col("d"))).collect()][0] == 20240229
    assert [r[0] for r in rows.select(D.in_season(F.col("d"))).collect()] == [False, False, False, True, True, False]
    assert [r[0] for r in rows.select(F.weekofyear("d")).collect()][1] == 1
    assert D.time_dimension(spark).count() == 4018
    assert len(D.time_dimension(spark).columns) == 38


def messy(spark):
    rows = []
    for i in range(1000):
        price = f"{10 + i % 200}.50"
        if i % 50 == 1:
            price = "$1,234.50"
        elif i % 50 == 2:
            price = "€99.00"
        elif i % 50 == 3:
            price = "-5.00"
        elif i % 40 == 7:
            price = None
        rating = [4.0, 8.0, -1.0, None][0 if i % 25 else (i // 25) % 4]
        rows.append((f"P{i:04d}", f" item  {i % 9} ", ["electronics", "Books", None][i % 3 if i % 30 == 2 else i % 2], price, rating, i % 300, f"2024-01-{1 + i % 28:02d} 10:00:00"))
    rows += [(*r[:-1], "2023-12-31 00:00:00") for r in rows[:50]]
    return spark.createDataFrame(rows, "product_id string, name string, category string, price string, rating double, num_reviews int, scraped_date string").withColumn(
        "scraped_date", F.col("scraped_date").cast("timestamp_ntz"))


def test_cleaning_chain(spark):
    steps = C.cleaning_steps(messy(spark))
    out = steps["clean"].toPandas()
    report = C.cleaning_report(steps).first()
    assert report["original_rows"] == 1050 and report["duplicates_removed"] == 50
    assert out["product_id"].is_unique and (out["price"] > 0).all()
    assert out["rating"].dropna().between(0, 5).all()
    assert not out["name"].str.contains("  ").any() and out["name"].str.startswith("Item").all()
    assert out["category"].notna().all() and dict(steps["typed"].dtypes)["price"] == "double"
    assert report["final_rows"] == len(out) == steps["unique"].count() - report["rows_removed"] + report["duplicates_removed"]


def test_repair_types_and_fill(spark):
    df = spark.createDataFrame([("1,5", "x", "2024-01-01"), ("7", "y", "2024-01-02"), (None, "y", None)], "n string, s string, d string")
    out = C.repair_types(df)
    assert dict(out.dtypes) == {"n": "double", "s": "string", "d": "timestamp"}
    filled = C.fill_missing(out.select("n", "s")).collect()
    assert filled[2]["n"] == 11.0  # "1,5" reads as 15 once the comma is removed
    empty = C.fill_missing(spark.createDataFrame([(None, "a")], "z string, b string")).first()
    assert empty["z"] == "Unknown"


def test_winsorise_against_pandas(spark):
    pdf = pd.DataFrame({"row_id": range(20), "v": [float(i) for i in range(19)] + [500.0]})
    out = C.winsorise(spark.createDataFrame(pdf)).toPandas().sort_values("row_id")
    q1, q3 = pdf["v"].quantile(0.25), pdf["v"].quantile(0.75)
    assert out["v"].max() == pytest.approx(q3 + 1.5 * (q3 - q1)) and out["row_id"].max() == 19


def test_rules_and_specs(spark):
    df = spark.createDataFrame([("r1", "o1", 5), ("r2", "o2", 0), (None, "o3", 3), ("r4", "o4", None)], "review_id string, order_id string, review_score int")
    assert [r["review_id"] for r in C.apply_rules(df, C.DATASETS["reviews"]).collect()] == ["r1"]
    issues = {(r["issue"], r["column_name"]) for r in Q.schema_issues(df, C.DATASETS["reviews"]).collect()}
    assert issues == {("missing_column", "review_comment_title"), ("missing_column", "review_comment_message")}
    wrong = df.withColumn("review_score", F.col("review_score").cast("string"))
    assert ("wrong_type", "review_score") in {(r["issue"], r["column_name"]) for r in Q.schema_issues(wrong, C.DATASETS["reviews"]).collect()}


def test_discount_edges(spark):
    rows = [("percentage", 10.0, 500.0, 10000.0), ("percentage", 10.0, None, 10000.0), ("fixed_amount", 900.0, None, 400.0), ("free_shipping", 1.0, None, 20000.0), ("buy_x_get_y", 5.0, None, 100.0)]
    df = spark.createDataFrame(rows, "k string, v double, c double, a double")
    got = [r[0] for r in df.select(V.discount(F.col("k"), F.col("v"), F.col("c"), F.col("a"))).collect()]
    assert got == [500.0, 1000.0, 400.0, 20000.0, 0.0]


def test_contract_levels(spark):
    good = '{"product_id":"a-1","product_photos_qty":2,"product_weight_g":1.5,"timestamp":"2024-01-01","source":"api"}'
    bad = ['{"product_id":"a 1","timestamp":"t"}', '{"timestamp":"t"}', '{"product_id":5,"timestamp":"t"}', '{"product_id":"a","timestamp":"t","product_photos_qty":-1}',
           '{"product_id":"a","timestamp":"t","product_photos_qty":1.5}', '{"product_id":"a","timestamp":"t","source":"web"}', '{"product_id":"a","timestamp":"t","x":1}', '{"product_id":', None]
    want = ["pattern:product_id", "required:product_id", "type:product_id", "minimum:product_photos_qty", "type:product_photos_qty", "enum:source", "additional:x", "malformed", "malformed"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([good, *bad])], "i int, t string")
    contract = Q.CONTRACTS["products"]
    rows = Q.check_contract(df, "t", contract).orderBy("i").collect()
    assert rows[0]["is_valid"] and [r["errors"] for r in rows[1:]] == [[w] for w in want]
    lenient = Q.check_contract(df, "t", replace(contract, level="lenient")).orderBy("i").collect()
    assert [r["is_valid"] for r in lenient] == [True] * 8 + [False] * 2 and lenient[2]["warnings"] == ["required:product_id"]
    ranged = Q.check_contract(df, "t", replace(contract, level="lenient", ranges={"product_weight_g": (None, 1.0)})).orderBy("i").first()
    assert ranged["errors"] == ["range:product_weight_g"]


def test_custom_checks_and_sql_check(spark):
    @Q.register_check("row_limit")
    def limit(df):
        return df.agg((F.count("*") < 3).alias("passed"))
    df = spark.createDataFrame([(1,), (2,)], "v int")
    assert Q.run_checks(df, ["row_limit"]).first()["passed"]
    got = Q.sql_check(spark, "sum", "SELECT sum(v) FROM {d}", 2, ">", {"d": df}).first()
    assert got["value"] == 3.0 and got["passed"]


def test_metric_query_whitelist(spark):
    df = spark.createDataFrame([(1,)], "v int")
    with pytest.raises(ValueError):
        S.metric_query(df, "v", "sum); drop", "ts", "2024-01-01", "2024-01-02")


def test_group_stats_keep_null_group_only_on_left(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), (None, 9.0)], "g string, v double")
    assert J.group_stats_back(df, "g", "v").count() == 3 and J.group_stats_back(df, "g", "v", "inner").count() == 2
    single = J.group_stats_back(spark.createDataFrame([("a", 1.0)], "g string, v double"), "g", "v").first()
    assert single["v_std"] is None and single["v_median"] == 1.0


def test_scd2_keeps_one_current_row_without_overlap(spark):
    dim = spark.createDataFrame([(1, "A", "2024-01-01"), (2, "A", "2024-01-01"), (3, None, "2024-01-01"), (4, "D", "2024-01-01")], "k int, s string, e string").select(
        "k", "s", F.to_date("e").alias("effective_date"), F.lit(None).cast("date").alias("expiry_date"), F.lit(True).alias("is_current"))
    snap = spark.createDataFrame([(1, "A"), (2, "B"), (3, "C"), (5, "N")], "k int, s string")
    once = L.scd2_merge(dim, snap, "k", ["s"], "2024-02-01")
    rows = {(r["k"], r["s"], str(r["effective_date"]), str(r["expiry_date"]), r["is_current"]) for r in once.collect()}
    assert rows == {(1, "A", "2024-01-01", "None", True), (2, "A", "2024-01-01", "2024-01-31", False), (2, "B", "2024-02-01", "None", True),
                    (3, None, "2024-01-01", "2024-01-31", False), (3, "C", "2024-02-01", "None", True), (4, "D", "2024-01-01", "None", True), (5, "N", "2024-02-01", "None", True)}
    again = L.scd2_merge(once, snap, "k", ["s"], "2024-03-01")
    assert sorted(map(str, again.collect())) == sorted(map(str, once.collect()))


def test_upsert_is_idempotent_and_counts(spark):
    target = spark.createDataFrame([(1, "a", 0), (2, "b", 4)], "k int, v string, n bigint")
    rows = spark.createDataFrame([(2, "B", 1), (2, "B2", 2), (3, "c", 1)], "k int, v string, t int")
    out = L.upsert(target, rows, ["k"], ["t"], "n")
    assert sorted(tuple(r) for r in out.collect()) == [(1, "a", 0), (2, "B2", 5), (3, "c", 0)]
    plain = L.upsert(target.drop("n"), rows, ["k"], ["t"])
    assert sorted(tuple(r) for r in L.upsert(plain, rows, ["k"], ["t"]).collect()) == sorted(tuple(r) for r in plain.collect())


def test_changes_delete_and_order(spark):
    target = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    changes = spark.createDataFrame([(1, "x", "U", 1), (1, "y", "U", 3), (1, "z", "U", 2), (2, None, "D", 1), (3, "n", "I", 1), (3, None, "D", 2)], "k int, v string, op string, lsn int")
    assert [tuple(r) for r in L.apply_changes(target, changes, ["k"]).collect()] == [(1, "y")]


def test_validity_join_matches_brute_force(spark):
    left = spark.createDataFrame([(i, f"2024-{1 + i % 12:02d}-{1 + i % 28:02d}") for i in range(60)], "i int, t string").select("i", F.col("t").cast("timestamp_ntz").alias("t"))
    right = spark.createDataFrame([(j, f"2024-{1 + j % 6:02d}-15", f"2024-{1 + j % 6 + j % 5:02d}-20") for j in range(20)], "j int, a string, b string").select(
        "j", F.col("a").cast("timestamp_ntz").alias("a"), F.col("b").cast("timestamp_ntz").alias("b"))
    got = {(r["i"], r["j"]) for r in J.validity_join(left, "t", right, "a", "b").collect()}
    ls, rs = left.collect(), right.collect()
    assert got == {(x["i"], y["j"]) for x in ls for y in rs if y["a"] <= x["t"] <= y["b"]}


def test_validity_join_keeps_open_intervals_and_survives_long_ones(spark):
    day = lambda s: F.lit(s).cast("timestamp_ntz")
    left = spark.createDataFrame([(1, "2024-01-10"), (2, "2024-05-01")], "i int, t string").select("i", F.col("t").cast("timestamp_ntz").alias("t"))
    right = spark.createDataFrame([(1, "2024-02-01", None), (2, None, "2024-02-01"), (3, "0001-01-01", "9999-12-31"), (4, None, None)], "j int, a string, b string").select(
        "j", F.col("a").cast("timestamp_ntz").alias("a"), F.col("b").cast("timestamp_ntz").alias("b"))
    got = {(r["i"], r["j"]) for r in J.validity_join(left, "t", right, "a", "b").collect()}
    assert got == {(2, 1), (1, 2), (1, 3), (2, 3), (1, 4), (2, 4)}
    assert J.validity_join(left.where(F.col("t") < day("1900-01-01")), "t", right, "a", "b").count() == 0


def test_second_change_of_a_day_replaces_the_version(spark):
    dim = spark.createDataFrame([(1, "a", "2024-01-01", None, True)], "k int, v string, e string, x string, is_current boolean").select("k", "v", F.to_date("e").alias("effective_date"), F.to_date("x").alias("expiry_date"), "is_current")
    once = L.scd2_merge(dim, spark.createDataFrame([(1, "b")], "k int, v string"), "k", ["v"], "2024-05-05")
    twice = L.scd2_merge(once, spark.createDataFrame([(1, "c")], "k int, v string"), "k", ["v"], "2024-05-05")
    got = sorted((r["v"], str(r["effective_date"]), str(r["expiry_date"]), r["is_current"]) for r in twice.collect())
    assert got == [("a", "2024-01-01", "2024-05-04", False), ("c", "2024-05-05", "None", True)]


def test_late_rows_do_not_overwrite_newer_state(spark):
    target = spark.createDataFrame([(1, "new", 10, 3)], "k int, v string, t int, n bigint")
    rows = spark.createDataFrame([(1, "late", 5), (2, "first", 1)], "k int, v string, t int")
    assert sorted(tuple(r) for r in L.upsert(target, rows, ["k"], ["t"], "n").collect()) == [(1, "new", 10, 3), (2, "first", 1, 0)]


def test_trends_see_products_below_the_shown_ranking(spark):
    from tillroll.operators import products as P
    products = spark.range(1, 131).select(F.col("id").alias("product_id"), F.concat(F.lit("p"), "id").alias("product_name"), F.lit("c").alias("category"), F.lit(10).alias("stock_quantity"))
    day = lambda n, sold: products.select("product_id", F.expr(f"TIMESTAMP_NTZ '2024-01-0{n} 10:00:00'").alias("order_date"), sold.cast("decimal(18,2)").alias("quantity"), F.lit(1).cast("decimal(18,2)").alias("item_total"))
    sales = day(1, 200 - F.col("product_id")).unionByName(day(2, F.when(F.col("product_id") == 120, 500).otherwise(200 - F.col("product_id"))))
    board = {r["product_id"]: r for r in P.dashboard(products, P.rankings(products, sales)).where("date = DATE '2024-01-02'").collect()}
    assert len(board) == 100 and (board[120]["rank_position"], board[120]["previous_rank"], board[120]["growth_percentage"]) == (1, 120, 525.0)


def test_long_phrases_count(spark):
    from tillroll.operators.feedback import explode_phrases
    df = spark.createDataFrame([(1, f"{'a' * 40} {'b' * 40} c")], "id int, text string")
    assert {r["phrase"] for r in explode_phrases(df, "text", ["id"]).collect()} == {f"{'a' * 40} {'b' * 40}", f"{'b' * 40} c", f"{'a' * 40} {'b' * 40} c"}
    assert {r["phrase"] for r in explode_phrases(df, "text", ["id"], longest=50).collect()} == {f"{'b' * 40} c"}


def test_risk_follows_the_probability_of_the_class(spark):
    from tillroll.ml import models as M
    df = spark.createDataFrame([(i, float(i % 10), float(i % 10 > 7)) for i in range(200)], "customer_id int, x double, label double")
    out = M.score(M.fit_classifier(df, "label", M.preparation(["x"], scale=False), trees=5), df, "customer_id", ["x"]).withColumn("risk", M.risk_level(F.col("probability")))
    assert {(r["prediction"], r["risk"]) for r in out.collect()} == {(0.0, "low"), (1.0, "high")}


def test_validity_join_on_one_hot_day_and_intervals_of_centuries(spark):
    """All rows at one time fall into many slices; long, short, empty and reversed intervals, null times, and a left join."""
    stamp = lambda c: F.col(c).cast("timestamp_ntz").alias(c)
    left = spark.createDataFrame([(i, "2024-03-01 12:00:00") for i in range(300)] + [(300 + i, f"20{i:02d}-01-01") for i in range(40)] + [(999, None)], "i int, t string").select("i", stamp("t"))
    spans = [(0, "1500-01-01", "2500-01-01"), (1, "2024-03-01 12:00:00", "2024-03-01 12:00:00"), (2, "2024-03-01 12:00:01", None), (3, None, "2005-01-01"), (4, "2030-01-01", "2001-01-01"), (5, "2003-01-01", "2003-12-31")]
    right = spark.createDataFrame(spans, "j int, a string, b string").select("j", stamp("a"), stamp("b"))
    ls, rs = left.collect(), right.collect()
    want = sorted((x["i"], y["j"]) for x in ls for y in rs if x["t"] is not None and (y["a"] is None or y["a"] <= x["t"]) and (y["b"] is None or x["t"] <= y["b"]))
    for slices in (64, 7):
        assert sorted((r["i"], r["j"]) for r in J.validity_join(left, "t", right, "a", "b", slices=slices).collect()) == want
    met = {i for i, _ in want}
    outer = J.validity_join(left, "t", right, "a", "b", "left").collect()
    assert sorted(r["i"] for r in outer if r["j"] is None) == sorted(x["i"] for x in ls if x["i"] not in met)


@pytest.mark.parametrize("ahead", [1, 3])
def test_next_in_slices_with_a_key_in_all_slices(spark, ahead):
    rows = [("hot", i, f"v{i}") for i in range(400)] + [(f"k{i % 30}", i, f"w{i}") for i in range(90)] + [(None, i, f"n{i}") for i in range(120)]
    df = spark.createDataFrame(rows, "k string, at int, v string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {(r["k"], r["at"]): r["next_v"] for r in W.next_in_slices(df, ["k"], ["at"], ["v"], ahead).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    series = {}
    for k, at, v in sorted(rows, key=lambda r: r[1]):
        series.setdefault(k, []).append((at, v))
    assert got == {(k, at): s[n + ahead][1] if n + ahead < len(s) else None for k, s in series.items() for n, (at, _) in enumerate(s)}


def test_a_new_day_is_appended_without_the_old_rows(spark, tmp_path):
    """Stored bitmaps of the old days and the new day's rows give the same counts as all rows; negative, far apart and null members too."""
    rows = [(f"2024-01-{1 + i % 20:02d}", m) for i, m in enumerate([*range(0, 90_000, 700), -5, -70_000, 2**40, 7, 7, 7, None] * 2)]
    df = spark.createDataFrame(rows, "day string, m bigint").withColumn("day", F.to_date("day"))
    new = spark.createDataFrame([("2024-02-01", 7), ("2024-02-01", 123_456), ("2024-02-01", None)], "day string, m bigint").withColumn("day", F.to_date("day"))
    PR.presence(df, ["day"], "m").write.parquet(f"{tmp_path}/old")
    stored = PR.merged(spark.read.parquet(f"{tmp_path}/old"), PR.presence(new, ["day"], "m"))
    every = df.unionByName(new)
    assert PR.members(PR.coarser(stored)).first()[0] == every.select("m").where("m IS NOT NULL").distinct().count()
    want = {(r["day"], r["n"]) for r in every.groupBy("day").agg(F.countDistinct("m").alias("n")).collect()}
    assert {(r["day"], r["members"]) for r in PR.members(stored, ["day"]).collect()} == want
    kept = {str(r["month"]): (r["active"], r["retained"]) for r in PR.retention(stored, "day").collect()}
    assert kept["2024-02-01"] == (2, 1) and kept["2024-01-01"][1] == 0
    assert PR.members(PR.presence(df.limit(0), ["day"], "m")).first()[0] == 0


def test_most_frequent_when_counters_overflow(spark):
    from collections import Counter

    from tillroll.operators.frequent import counters, most_frequent
    # Item i has 1 + i % 40 rows, so every place has ties; 300 items are more than the counters hold.
    values = [f"v{i}" for i in range(300) for _ in range(1 + i % 40)] + [None] * 500
    df = spark.createDataFrame([(v,) for v in values], "v string").repartition(7)
    want = sorted(((v, n) for v, n in Counter(v for v in values if v).items()), key=lambda x: (-x[1], x[0]))
    for buckets, first in ((1, 1), (4, 1), (64, 1), (64, 3), (1 << 18, 32)):
        for k in (1, 5, 12, 400):
            assert [tuple(r) for r in most_frequent(df, "v", k, buckets=buckets, first=first).collect()] == want[:k], (buckets, first, k)
    assert counters(df, "v", 4).count() == 4
    assert most_frequent(df.where("v IS NULL"), "v", 3).collect() == []


def test_table_functions_are_called_from_sql(spark):
    from datetime import date

    from tillroll.operators.table_functions import register_table_functions
    day = date(2024, 1, 2)
    ranking = spark.createDataFrame([(1, day, 40), (1, date(2024, 1, 1), 10), (2, day, 8), (3, day, 4), (4, day, 30)], "product_id bigint, date date, sales_volume bigint")
    scores = spark.createDataFrame([(1, 60.0), (2, 12.0), (3, 90.0), (4, 5.0)], "product_id bigint, velocity_score double")
    register_table_functions(spark, bestseller_rankings=ranking, velocity_scores=scores)
    rows = spark.sql("SELECT * FROM detect_trending_products(DATE '2024-01-02') ORDER BY product_id").collect()
    assert [tuple(r) for r in rows] == [(1, 60.0, 1.0, "explosive"), (2, 12.0, 0.4, "moderate")]
    # A later table of the same name is what the function reads from then on.
    register_table_functions(spark, bestseller_rankings=ranking.limit(0), velocity_scores=scores)
    assert spark.sql("SELECT * FROM detect_trending_products(DATE '2024-01-02')").collect() == []
    with pytest.raises(ValueError):
        register_table_functions(spark, other=ranking)


def test_phrases_are_those_of_array_functions(spark):
    from tillroll.operators import feedback as B
    rows = [(1, "a b  a b a"), (2, None), (3, ""), (4, " x "), (5, "\u00e9t\u00e9\u00a0y\tz y z"), (6, " ".join(f"w{i % 700}" for i in range(1500)))]
    df = spark.createDataFrame(rows, "id int, text string").withColumn("at", F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00'"))
    tokens = df.select("id", "at", X.words("text").alias("w"))
    want = tokens.select("id", "at", F.explode(F.array_distinct(F.concat(X.ngrams(F.col("w"), 2), X.ngrams(F.col("w"), 3)))).alias("phrase"))
    found = B.explode_phrases(df, "text", ["id", "at"])
    assert sorted(found.collect()) == sorted(want.collect()) and found.dtypes == want.dtypes
    assert "array_distinct" not in found._jdf.queryExecution().optimizedPlan().toString()  # lambdas over arrays took most of the time


def test_cleaned_texts_are_those_of_two_passes(spark):
    odd = ["", " ", None, "A\u00a0\u2003B", "x\u00d7\u00f7y", "\u1ea0\u1ef9 \u0301e", "a_b-c..d\te\n", "\U0001d54f \u0660\u00b2", "\x0b\x1c\x85z"]
    df = spark.createDataFrame([(x,) for x in odd], "v string")
    two = F.lower(X.collapse(F.regexp_replace("v", X.KEPT_LETTERS, " ")))
    assert [r[0] for r in df.select(X.clean_feedback("v")).collect()] == [r[0] for r in df.select(two).collect()]


def test_analysed_feedback_does_not_move_texts(spark):
    from tillroll.operators import feedback as B
    rows = [(1, "good good", 1), (2, "bad", 1), (2, "great", 2), (None, "good", 1), (3, None, 7)]
    make = lambda r: spark.createDataFrame([(i, t, c, "s") for i, t, c in r], "feedback_id int, text string, customer_id int, source string").withColumn("created_at", F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00'"))
    clv = spark.createDataFrame([(1, 9e6), (1, 1.0), (5, 2.0)], "customer_id int, clv_prediction double")
    got = sorted((r["feedback_id"], r["text"] or "", r["sentiment_score"], r["priority"]) for r in B.analyse(make(rows), clv).collect())
    score = {k: r["sentiment_score"] for k, r in ((r["feedback_id"], r) for r in B.sentiment(make(rows[:1] + rows[4:]), "feedback_id", "text").collect())}
    two = sorted(r["sentiment_score"] for r in B.sentiment(make(rows[1:3]), "feedback_id", "text").collect())
    assert [x[:3] for x in got if x[0] != 2] == [(1, "good good", score[1])] * 2 + [(3, "", score[3])]  # null keys meet nothing, two values of a customer are two rows
    assert [x[:3] for x in got if x[0] == 2] == [(2, "bad", two[0])] * 2 + [(2, "bad", two[1])] * 2 + [(2, "great", two[0]), (2, "great", two[1])]
    assert "Join Inner" not in B.analyse(make(rows[:2]), clv)._jdf.queryExecution().optimizedPlan().toString()
    day = B.daily_metrics(B.analyse(make([(1, "a b a b c", 1), (2, "b c d", 9)]), clv.limit(1)), "2024-01-01", "2024-01-01").collect()
    assert [(r["total_feedback"], r["distinct_phrases"]) for r in day] == [(2, 4)]


def test_group_performance_in_slices(spark, monkeypatch):
    items = spark.createDataFrame([(o, o % 3, p) for o in range(40) for p in range(o % 4 + 1)] + [(None, 1, 1), (1, 1, None)], "order_id int, line int, product_id int").withColumn("item_total", F.lit(2).cast("decimal(18,2)"))
    orders = spark.createDataFrame([(o, o % 7 if o % 5 else None) for o in range(39)], "order_id int, customer_id int")
    sides = {"product_id": spark.createDataFrame([(0, "a"), (1, "a"), (2, "b"), (2, "c")], "product_id int, g string"),
             "customer_id": spark.createDataFrame([(c, "ab"[c % 2]) for c in range(6)] + [(1, "c")], "customer_id int, g string")}
    monkeypatch.setattr(S, "SLICE_ROWS", 10)
    for on, side in sides.items():
        rows = items.join(orders, "order_id").join(side, on)
        want = rows.groupBy("g").agg(F.countDistinct("order_id"), F.sum("item_total").cast("double"), F.count_distinct("customer_id"))
        found = S.group_performance(items, orders, side, on, "g")
        # A null customer is one of the counted rows.
        nulls = {r[0] for r in rows.where("customer_id IS NULL").select("g").distinct().collect()}
        assert sorted((r["g"], r["orders"], r["revenue"], r["unique_customers"] - (r["g"] in nulls)) for r in found.collect()) == sorted(tuple(r) for r in want.collect())
        assert "hashpartitioning(order_id#" in found._jdf.queryExecution().executedPlan().toString() and ", 11)" in found._jdf.queryExecution().executedPlan().toString()
