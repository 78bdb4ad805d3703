"""Sliced ranks, quantiles, shifts and sums against pandas, with a third of the rows in one group."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tillroll.operators import ordering as O
from tillroll.operators import windows as W
from tillroll.operators.sessions import sessionize


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(7)
    n = 3000
    group = np.where(rng.random(n) < 0.34, "hot", rng.choice(list("abcdefgh"), n))
    value = np.where(rng.random(n) < 0.4, 5.0, rng.integers(0, 60, n).astype(float))
    pdf = pd.DataFrame({"id": range(n), "g": group, "v": value})
    return pdf, spark.createDataFrame(pdf).repartition(7)


def collected(df, *order):
    return df.toPandas().sort_values(list(order)).reset_index(drop=True)


def test_row_numbers_per_group(skewed):
    pdf, df = skewed
    got = collected(O.number_rows(df, [F.col("v"), F.col("id")], ["g"]), "id")
    want = pdf.sort_values(["g", "v", "id"]).groupby("g").cumcount().sort_index() + 1
    assert got["rn"].tolist() == want.tolist()
    assert got["n_rows"].tolist() == pdf.groupby("g")["id"].transform("count").tolist()


def test_null_keys_form_a_group(spark):
    df = spark.createDataFrame([(1, None), (2, None), (3, "x")], "id int, g string")
    got = collected(O.number_rows(df, [F.col("id")], ["g"]), "id")
    assert got["rn"].tolist() == [1, 2, 1]


def test_percent_rank_averages_ties(skewed):
    pdf, df = skewed
    got = collected(W.percent_rank(df, "v", ["g"]), "id")
    want = pdf.groupby("g")["v"].rank(pct=True)
    assert np.allclose(got["pct_rank"], want)


def test_quantiles_match_pandas(skewed):
    pdf, df = skewed
    got = O.quantiles(df, ["v"], [0.25, 0.5, 0.9], ["g"]).toPandas().set_index("g").sort_index()
    want = pdf.groupby("g")["v"].quantile([0.25, 0.5, 0.9]).unstack().sort_index()
    assert np.allclose(got[["q0", "q1", "q2"]].to_numpy(float), want.to_numpy(float))


def test_even_median_all_null_and_single_row(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 4.0), ("b", None), ("c", 9.0)], "g string, v double")
    got = {r["g"]: r["q0"] for r in O.quantiles(df, ["v"], [0.5], ["g"]).collect()}
    assert got == {"a": 2.5, "c": 9.0}


def test_shift_and_running_sum(skewed):
    pdf, df = skewed
    order = [F.col("v"), F.col("id")]
    s = pdf.sort_values(["g", "v", "id"])
    lead = collected(O.shift(df, ["id"], order, ["g"]), "id")["next_id"]
    want = s.groupby("g")["id"].shift(-1).sort_index()
    assert lead.fillna(-1).tolist() == want.fillna(-1).tolist()
    lag = collected(O.shift(df, ["id"], order, ["g"], -2, "prev_"), "id")["prev_id"]
    assert lag.fillna(-1).tolist() == s.groupby("g")["id"].shift(2).sort_index().fillna(-1).tolist()
    run = collected(O.running_sum(df, "v", order, ["g"], "r", "t"), "id")
    assert np.allclose(run["r"], s.groupby("g")["v"].cumsum().sort_index())
    assert np.allclose(run["t"], pdf.groupby("g")["v"].transform("sum"))


@pytest.mark.parametrize("n", [7, 10, 41])
def test_rank_quintiles_differ_from_ntile(spark, n):
    pdf = pd.DataFrame({"id": range(n), "v": [i // 3 for i in range(n)]})
    df = spark.createDataFrame(pdf)
    want = pd.qcut(pdf["v"].rank(method="first"), 5, labels=[1, 2, 3, 4, 5]).astype(int)
    assert collected(W.rank_quintile(df, "v", "id", "q"), "id")["q"].tolist() == want.tolist()
    tiles = collected(W.ntile_score(df, "v", "id", "q"), "id")["q"].value_counts().sort_index().tolist()
    assert tiles == [len(a) for a in np.array_split(range(n), 5)]


def test_value_bins_merge_equal_edges(spark):
    pdf = pd.DataFrame({"id": range(12), "v": [1] * 8 + [2, 3, 4, 5]})
    got = collected(W.value_bins(spark.createDataFrame(pdf), "v", "b", ["Small", "Medium", "Large"]), "id")["b"]
    want = pd.qcut(pdf["v"], 3, duplicates="drop").cat.codes
    assert got.map({"Small": 0, "Medium": 1, "Large": 2}).tolist() == want.tolist()


def test_cut_is_right_closed_and_drops_the_lowest_edge(spark):
    df = spark.createDataFrame([(0.0,), (2.0,), (2.1,), (4.5,), (5.0,), (5.1,), (None,)], "v double")
    got = [r["b"] for r in df.select(W.fixed_bins(F.col("v"), [0.0, 2.0, 3.0, 4.0, 4.5, 5.0], list("abcde")).alias("b")).collect()]
    assert got == [None, "a", "b", "d", "e", None, None]


def test_mode_takes_the_lowest_on_ties(spark):
    df = spark.createDataFrame([("x", 2), ("x", 1), ("x", 2), ("x", 1), ("y", 3)], "g string, v int")
    assert {r["g"]: r["mode"] for r in O.mode_value(df, "v", ["g"]).collect()} == {"x": 1, "y": 3}


def test_rolling_needs_full_window(spark):
    df = spark.createDataFrame([("c", f"2024-01-0{i}", float(i)) for i in range(1, 6)], "category string, day string, y double")
    full = collected(W.rolling_means(df, "category", [3]), "day")["y_ma_3"]
    part = collected(W.rolling_means(df, "category", [3], full=False), "day")["y_ma_3"]
    assert full.isna().tolist() == [True, True, False, False, False]
    assert part.tolist() == [1.0, 1.5, 2.0, 3.0, 4.0]


def test_sessions_of_a_hot_user(spark):
    rng = np.random.default_rng(3)
    n = 2000
    ts = pd.Timestamp("2024-01-01") + pd.to_timedelta(np.sort(rng.integers(0, 400000, n)), unit="s")
    pdf = pd.DataFrame({"id": range(n), "u": np.where(rng.random(n) < 0.5, 1, rng.integers(2, 9, n)), "ts": ts})
    df = spark.createDataFrame(pdf).withColumn("ts", F.col("ts").cast("timestamp_ntz")).repartition(5)
    got = collected(sessionize(df, "u", "ts", "id", 5), "id")["session_no"]
    gap = pdf.groupby("u")["ts"].diff()
    want = (gap.isna() | (gap >= pd.Timedelta(minutes=5))).astype(int).groupby(pdf["u"]).cumsum()
    assert got.tolist() == want.tolist()


def test_top_k_is_limited_before_the_shuffle_for_any_k(skewed):
    _, df = skewed
    for k in (3, 1500):
        plan = W.top_k_per_group(df, "g", "id", F.col("v"), k)._jdf.queryExecution().executedPlan().toString()
        assert "WindowGroupLimit" in plan and "Partial" in plan
    rows = W.top_k_per_group(df, "g", "id", F.col("v"), 1500).count()
    assert rows == sum(min(1500, r["count"]) for r in df.groupBy("g").count().collect())
