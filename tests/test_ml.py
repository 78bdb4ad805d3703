"""Models: metric floors, storage round trip, exact neighbours against brute force."""

import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tillroll.ml import models as M
from tillroll.ml import recommend as R


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(1)
    n = 600
    pdf = pd.DataFrame({"id": range(n), "a": rng.normal(size=n), "b": rng.normal(size=n), "c": rng.choice(list("xyz"), n)})
    pdf["y"] = 3 * pdf["a"] - 2 * pdf["b"] + pdf["c"].map({"x": 0, "y": 2, "z": 4}) + rng.normal(scale=0.1, size=n)
    pdf["label"] = (pdf["a"] + pdf["b"] > 0).astype(float)
    return spark.createDataFrame(pdf)


def test_regression_floor_and_round_trip(spark, rows, tmp_path):
    train, test = M.split(rows, "id")
    assert train.count() + test.count() == 600 and 60 < test.count() < 180
    name, model, scores = M.fit_best(train, "y", M.regressors("y", 10, 6), M.preparation(["a", "b"], ["c"], scale=False))
    metrics = M.regression_metrics(model.transform(test), "y", "prediction").first()
    assert metrics["r2"] >= 0.6 and name == min(scores, key=scores.get)
    M.save(model, f"{tmp_path}/m", {"name": name, "rows": 600}, spark)
    loaded, meta = M.load(f"{tmp_path}/m", spark)
    assert meta == {"name": name, "rows": 600}
    assert [r["prediction"] for r in loaded.transform(test).orderBy("id").collect()] == [r["prediction"] for r in model.transform(test).orderBy("id").collect()]


def test_folds_expand_in_time_and_choose_without_the_test_rows(spark):
    days = [d for d in range(1, 21) for _ in range(1 + 9 * (d == 10))]  # one hot day
    rows = spark.createDataFrame([(i, n, float(n), 2.0 * n) for i, n in enumerate(days)], "id int, n int, x double, y double").withColumn("day", F.date_add(F.lit("2020-01-01"), F.col("n") - 1))
    folds = M.time_folds(rows, "day", 3)
    held = []
    for learn, judged in folds:
        a, b = [r["day"] for r in learn.collect()], [r["day"] for r in judged.collect()]
        assert a and b and max(a) < min(b)
        held += b
    assert len(held) == rows.where(F.col("day") >= F.lit(min(held))).count()  # every later row is judged once
    errors = M.fold_errors(folds, "y", {"linear": M.regressors("y")["linear"]}, M.preparation(["x"], scale=False))
    assert [k for _, k, _ in errors] == list(range(len(folds)))
    report = M.fold_report(spark, errors).first()
    assert report["folds"] == len(folds) and report["mean_error"] == pytest.approx(np.mean([e for _, _, e in errors])) and report["std_error"] == pytest.approx(np.std([e for _, _, e in errors], ddof=1))
    one_day = rows.withColumn("day", F.lit("2020-01-01").cast("date"))
    assert M.fold_errors(M.time_folds(one_day, "day"), "y", M.regressors("y"), M.preparation(["x"], scale=False)) == []
    name, model, scores = M.fit_best(one_day, "y", M.regressors("y", 2, 2), M.preparation(["x"], scale=False), by="day")
    assert name == "boosted" and scores == {} and model.transform(rows).count() == rows.count()
    assert sum(b.count() for _, b in M.row_folds(rows)) == rows.count()


def test_classifier_floor_importance_and_scores(rows):
    train, test = M.split(M.balanced_weights(rows, "label"), "id")
    model = M.fit_classifier(train, "label", M.preparation(["a", "b"], scale=False), weight="weight")
    out = model.transform(test)
    got = M.classification_metrics(out, "label", "prediction").first()
    assert got["accuracy"] >= 0.8 and got["f1"] >= 0.75 and M.accuracy(out) == pytest.approx(got["accuracy"]) and M.area_under_curve(out) > 0.85
    top = M.importances(model)
    assert {n for n, _ in top} == {"a_filled", "b_filled"} and sum(w for _, w in top) == pytest.approx(1.0)
    scored = M.score(model, test, "id", ["a"]).first()
    assert 0.5 <= scored["confidence"] <= 1 and scored["prediction_id"].startswith("PRED_") and "a" in scored["inputs"]


def test_churn_label_is_not_a_feature(spark):
    df = spark.createDataFrame([(1, 100.0), (2, 10.0)], "id int, recency double")
    assert "recency" not in M.churn_rows(df).columns and "recency" in M.churn_rows(df, leaky=True).columns


def test_clusters_and_index(spark):
    rng = np.random.default_rng(2)
    pts = np.concatenate([rng.normal(c, 0.2, (60, 3)) for c in ((0, 0, 0), (5, 5, 5), (0, 8, 1))])
    df = spark.createDataFrame(pd.DataFrame(pts, columns=["recency", "frequency", "monetary"]))
    _, out, scores = M.best_kmeans(df, ["recency", "frequency", "monetary"], range(2, 5))
    assert max(scores, key=scores.get) == 3 and sorted(r["segment_size"] for r in M.cluster_profiles(out).collect()) == [60, 60, 60]
    x = np.array([r[0] for r in out.select(vector_to_array("features")).collect()])
    c = np.array([r[0] for r in out.select("cluster").collect()])
    centre = x.mean(axis=0)
    between = sum((c == k).sum() * ((x[c == k].mean(axis=0) - centre) ** 2).sum() for k in set(c))
    within = sum(((x[c == k] - x[c == k].mean(axis=0)) ** 2).sum() for k in set(c))
    assert M.calinski_harabasz(out).first()["calinski_harabasz"] == pytest.approx((between / 2) / (within / (len(x) - 3)))


def test_neighbours_are_exact_with_a_hot_token(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(i, f"t{t}", float(1 + rng.integers(0, 4))) for i in range(90) for t in {0, *rng.integers(1, 15, 3)} if t or i % 3 == 0]
    weights = spark.createDataFrame(rows, "id bigint, token string, w double")
    monkeypatch.setattr(R, "HEAD_ROWS", 2)
    got = {(r["id"], r["position"]): (r["other"], r["similarity"]) for r in R.top_similar(R.unit_vectors(weights, "id", "token", "w"), "id", 4).collect()}
    m = pd.DataFrame(rows, columns=["id", "t", "w"]).pivot_table(index="id", columns="t", values="w", aggfunc="sum", fill_value=0)
    v = m.to_numpy() / np.linalg.norm(m.to_numpy(), axis=1, keepdims=True)
    sims = np.round(v @ v.T, 6)
    ids = m.index.to_numpy()
    want = {}
    for i, own in enumerate(ids):
        order = [j for j in np.lexsort((ids, -sims[i])) if j != i and sims[i, j] > 0][:4]
        want.update({(own, n + 1): (ids[j], sims[i, j]) for n, j in enumerate(order)})
    assert got == want


def test_neighbours_of_clusters_meet_few_pairs(spark):
    """Clusters that share a hot token: exact, and far fewer pairs than all; a vector held by a third of the keys stays one group."""
    rng = np.random.default_rng(9)
    rows = [(i, "hot", 1.0) for i in range(600)] + [(i, f"c{i % 40}-{t}", float(1 + rng.integers(0, 3))) for i in range(600) for t in {0, 1, *rng.integers(2, 9, 3)}]
    rows += [(1000 + i, t, 2.0) for i in range(300) for t in ("hot", "same")]
    vectors = R.unit_vectors(spark.createDataFrame(rows, "id bigint, token string, w double"), "id", "token", "w")
    groups = R.pin(R.fold_equal(vectors, "id", 4))
    n = groups.count()
    assert n <= 601 and R.similar_candidates(groups, 4).count() < 0.1 * n * n / 2
    m = pd.DataFrame(rows, columns=["id", "t", "w"]).pivot_table(index="id", columns="t", values="w", aggfunc="sum", fill_value=0)
    v = m.to_numpy() / np.linalg.norm(m.to_numpy(), axis=1, keepdims=True)
    sims, ids, want = np.round(v @ v.T, 6), m.index.to_numpy(), set()
    for i, own in enumerate(ids):
        want |= {(own, ids[j], n + 1) for n, j in enumerate([j for j in np.lexsort((ids, -sims[i])) if j != i and sims[i, j] > 0][:4])}
    assert {(r["id"], r["other"], r["position"]) for r in R.top_similar(vectors, "id", 4).collect()} == want


def test_factors_skip_seen_items_for_light_and_heavy_users(spark):
    rng = np.random.default_rng(0)
    big = 2**40
    pairs = {(u + big, int(p) + big) for u in range(20) for p in rng.integers(0, 40, 6)} | {(99 + big, p + big) for p in range(30)}
    ratings = spark.createDataFrame([(u, p, float(1 + (u + p) % 5)) for u, p in pairs], "customer_id bigint, product_id bigint, rating float")
    out = R.unseen_recommendations(R.fit_factors(ratings, 4, 3), ratings, 5).collect()
    assert not {(r["customer_id"], r["product_id"]) for r in out} & pairs
    per = pd.Series([r["customer_id"] for r in out]).value_counts()
    assert (per == 5).all() and len(per) == 21


def test_hybrid_falls_back_to_popular(spark):
    recent = spark.createDataFrame([(1, 10)], "customer_id bigint, product_id bigint")
    similar = spark.createDataFrame([(10, 11, 0.5, 1), (10, 12, 0.4, 2)], "product_id bigint, other bigint, similarity double, position int")
    collab = spark.createDataFrame([(1, 11, 2.0)], "customer_id int, product_id int, predicted_rating double")
    popular = spark.createDataFrame([(7, 9.0), (8, 3.0)], "product_id bigint, score double")
    users = spark.createDataFrame([(1,), (2,)], "customer_id bigint")
    got = {(r["customer_id"], r["product_id"]): r["hybrid_score"] for r in R.hybrid(recent, similar, collab, popular, users, 5).collect()}
    assert got == {(1, 11): 1.55, (1, 12): 0.12, (2, 7): 9.0, (2, 8): 3.0}


def _nearest(rows, k):
    m = pd.DataFrame(rows, columns=["id", "t", "w"]).pivot_table(index="id", columns="t", values="w", aggfunc="sum", fill_value=0)
    v = m.to_numpy() / np.linalg.norm(m.to_numpy(), axis=1, keepdims=True)
    sims, ids, want = np.round(v @ v.T, 6), m.index.to_numpy(), set()
    for i, own in enumerate(ids):
        want |= {(own, ids[j], n + 1) for n, j in enumerate([j for j in np.lexsort((ids, -sims[i])) if j != i and sims[i, j] > 0][:k])}
    return want


def test_neighbours_by_short_lists_shuffle_no_pairs(spark, monkeypatch):
    """Random purchases: every vector meets the short lists of its tokens, no pair goes through the bounds."""
    rng = np.random.default_rng(3)
    rows = [(i, f"t{t}", float(1 + rng.integers(0, 9))) for i in range(200) for t in set(rng.integers(0, 120, 8).tolist())] + [(900 + i, t, 1.0) for i in range(12) for t in ("t1", "t2")]
    monkeypatch.setattr(R, "BLOCK_ROWS", 50)
    monkeypatch.setattr(R, "similar_candidates", lambda *a: pytest.fail("pairs are shuffled"))
    vectors = R.unit_vectors(spark.createDataFrame(rows, "id bigint, token string, w double"), "id", "token", "w")
    assert {(r["id"], r["other"], r["position"]) for r in R.top_similar(vectors, "id", 5).collect()} == _nearest(rows, 5)


def test_neighbours_by_short_lists_come_in_waves(spark, monkeypatch):
    """Blocks get their lists wave after wave, each wave's result is pinned; a vector of many keys is one group, keys of one vector each name the others."""
    rng = np.random.default_rng(6)
    rows = [(i, f"t{t}", float(1 + rng.integers(0, 9))) for i in range(200) for t in set(rng.integers(0, 120, 8).tolist())] + [(900 + i, t, 1.0) for i in range(12) for t in ("t1", "t2")]
    rows += [(800 + i, t, 3.0) for i in range(3) for t in ("t3", "t4")]
    for name, value in (("BLOCK_ROWS", 20), ("WAVE_ROWS", 500), ("WAVE_PART", 0)):
        monkeypatch.setattr(R, name, value)
    waves, pin = [], R.pin

    def kept(df):
        out = pin(df)
        if out.columns == ["g", "other", "similarity"]:
            waves.append({r["g"] for r in out.collect()})
        return out

    monkeypatch.setattr(R, "pin", kept)
    vectors = R.unit_vectors(spark.createDataFrame(rows, "id bigint, token string, w double"), "id", "token", "w")
    assert {(r["id"], r["other"], r["position"]) for r in R.top_similar(vectors, "id", 5).collect()} == _nearest(rows, 5)
    assert len(waves) > 3 and sum(map(len, waves)) == len(set.union(*waves)) == 202


@pytest.mark.parametrize("entries", [0, 90])
def test_neighbours_with_long_lists_keep_to_the_bounds(spark, monkeypatch, entries):
    """With a hot token all vectors or those of long lists look for their neighbours by bounds; both ways together are exact."""
    rng = np.random.default_rng(4)
    rows = [(i, f"t{t}", float(1 + rng.integers(0, 4))) for i in range(120) for t in {0, *rng.integers(1, 40, 3).tolist()} if t or i % 3 == 0]
    monkeypatch.setattr(R, "LIST_ROWS", entries)
    vectors = R.unit_vectors(spark.createDataFrame(rows, "id bigint, token string, w double"), "id", "token", "w")
    assert {(r["id"], r["other"], r["position"]) for r in R.top_similar(vectors, "id", 4).collect()} == _nearest(rows, 4)


def test_factor_recommendations_meet_only_parts_that_reach_the_bound(spark, monkeypatch):
    """The best unseen items of the given factors, ties by item, also of users who have seen all long items, without a score of every pair."""
    rng = np.random.default_rng(8)
    vu, vi = rng.random((30, 3)).astype("float32"), (rng.random((64, 3)) * rng.choice([0.05, 1.0, 3.0], 64)[:, None]).astype("float32")
    vi[40:44] = vi[40]
    vu[7] = 0
    frame = lambda v: spark.createDataFrame([(n + 1, x.tolist()) for n, x in enumerate(v)], "id int, features array<float>")

    class Model:
        userFactors, itemFactors = frame(vu), frame(vi)

    longest = np.argsort(-np.linalg.norm(vi, axis=1))
    pairs = {(u, int(i)) for u in range(30) for i in rng.integers(0, 64, 5)} | {(5, int(i)) for i in longest[:30]} | {(6, i) for i in range(62)}
    number = lambda n, a, b: spark.createDataFrame([(x + 1000, x + 1) for x in range(n)], f"{a} bigint, {b} int")
    ratings = spark.createDataFrame([(u + 1000, i + 1000, 1.0) for u, i in pairs], "customer_id bigint, product_id bigint, rating float")
    for name, value in (("HEAD_ITEMS", 8), ("PART_ITEMS", 8), ("PART_USERS", 12)):
        monkeypatch.setattr(R, name, value)
    got = {(r["customer_id"], r["position"]): (r["product_id"], r["predicted_rating"]) for r in R.unseen_recommendations(R.Factors(Model, number(30, "customer_id", "_u"), number(64, "product_id", "_i")), ratings, 4).collect()}
    scores, want = (vu.astype("float64") @ vi.T.astype("float64")).astype("float32"), {}
    for u in range(30):
        order = [i for i in np.lexsort((np.arange(64), -scores[u])) if (u, i) not in pairs][:4]
        want.update({(u + 1000, n + 1): (i + 1000, pytest.approx(float(scores[u, i]))) for n, i in enumerate(order)})
    assert got == want


class _Lines:
    """Stand-in tables of a few products over 270 days; ``read`` counts the sales lines that pass."""

    def __init__(self, spark):
        self.spark, self.read = spark, spark.sparkContext.accumulator(0)
        self.rows = [(o, o % 7, o % 4, datetime.datetime(2000, 11, 5) + datetime.timedelta(days=o % 270), 1 + o % 5) for o in range(900)]
        read = self.read

        def count(batches):
            for b in batches:
                read.add(len(b))
                yield b

        lines = spark.createDataFrame(self.rows, "order_id bigint, customer_id bigint, product_id bigint, order_date timestamp_ntz, quantity int").withColumns(
            {"quantity": F.col("quantity").cast("decimal(18,2)"), "item_total": (F.col("quantity") * 10).cast("decimal(18,2)")})
        self.sales = lines.mapInPandas(count, lines.schema)
        self.prd = spark.createDataFrame([(i, f"p{i}", f"c{i % 2}", "b", 5.0 + i, 3) for i in range(4)], "product_id bigint, product_name string, category string, brand string, price double, stock_quantity int").withColumn("price", F.col("price").cast("decimal(18,2)"))
        self.act = spark.createDataFrame([("view", '{"k": 1}', datetime.datetime(2001, 7, 1))], "activity_type string, props string, ts timestamp_ntz")


@pytest.mark.parametrize("name,reports", [("m09_forecast", 1), ("m09_fold_errors", 1), ("m15_quantity_model", 1), ("d19_compare_periods", 2), ("d23_category_comparison", 1), ("d25_seller_insights", 3)])
def test_lines_are_read_once_a_report(spark, monkeypatch, name, reports):
    """Models, folds, rankings and ranks read a small pinned table, not all order lines again."""
    from tillroll.plans import load_plans
    monkeypatch.setattr(M, "regressors", lambda label, *a: {"linear": M.LinearRegression(labelCol=label, regParam=0.01)})
    t = _Lines(spark)
    load_plans()[name].build(t).collect()
    assert 0 < t.read.value <= reports * len(t.rows)


def test_ratings_are_joined_once(spark, monkeypatch):
    """The numberings and the lists of rated items read pinned ratings: they are not joined anew each time."""
    from types import SimpleNamespace

    from tillroll.plans import load_plans
    sales = spark.createDataFrame([(1, 2), (1, 2), (2, 3)], "customer_id int, product_id int")
    seen = []

    def fit(ratings, pinned):
        seen.append(pinned)
        raise StopIteration

    monkeypatch.setattr(R, "fit_factors", fit)
    for name in ("m11_factor_recommendations", "m12_hybrid"):
        with pytest.raises(StopIteration):
            load_plans()[name].build(SimpleNamespace(sales=sales))
    for ratings in seen:
        assert "Aggregate" not in ratings._jdf.queryExecution().optimizedPlan().toString()
        assert sorted(tuple(r) for r in ratings.collect()) == [(1, 2, 2.0), (2, 3, 1.0)]


@pytest.mark.parametrize("name", ["m11_factor_recommendations", "m12_hybrid"])
def test_factorisation_has_more_blocks_for_more_ratings(spark, monkeypatch, name):
    """A task holds the ratings of one block, so their number follows the ratings; the fit reads pinned rows, whose joins' shuffle files can go."""
    from types import SimpleNamespace

    from tillroll.plans import load_plans
    rng = np.random.default_rng(2)
    sales = spark.createDataFrame([(int(u), int(p)) for u, p in rng.integers(0, 30, (400, 2))], "customer_id int, product_id int")
    n, seen = sales.distinct().count(), []

    def recommend(factors, ratings, k):
        seen.append(factors.model)
        raise StopIteration

    monkeypatch.setattr(R, "unseen_recommendations", recommend)
    for most, blocks in ((20, -(-n // 20)), (n, 10)):
        monkeypatch.setattr(R, "BLOCK_RATINGS", most)
        with pytest.raises(StopIteration):
            load_plans()[name].build(SimpleNamespace(sales=sales))
        for factors in (seen[-1].userFactors, seen[-1].itemFactors):
            assert factors.rdd.getNumPartitions() == blocks and factors.count() == 30
            assert "ShuffledRowRDD" not in factors._jdf.queryExecution().toRdd().toDebugString()
