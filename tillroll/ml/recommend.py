"""Recommendations: exact sparse-vector neighbours, TF-IDF content, matrix factorisation, hybrid, metrics at k."""

from __future__ import annotations

import functools
from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.ml.recommendation import ALS, ALSModel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillroll.functions.numbers import ratio
from tillroll.operators.ordering import number_rows
from tillroll.session import pin, release

#: Entries per token that a vector first looks at, tokens it looks under, steps of weight and remaining norm that split a token's list.
HEAD_ROWS, HEAD_TOKENS, STEPS = 16, 8, 8
#: Similarities are compared rounded to six decimals, so thresholds give way by more than a rounding.
SLACK = 1e-6
#: Below this threshold nearly all lists must be met anyway; then hits are followed down to a part of it, so that their sums sieve the pairs.
LOW, LOW_PART = 0.3, 0.25
#: A vector whose tokens' lists hold at most so many entries meets them all; so many such vectors are one task's work.
LIST_ROWS, BLOCK_ROWS = 16384, 1024
#: Entries that the blocks of one wave are sent: so many, or so many times the entries of all lists if that is more. Waves follow one another, so shuffle files hold the lists of one only.
WAVE_ROWS, WAVE_PART = 1 << 25, 2
#: Items whose scores first bound a user's best from below, items of one part, users that meet a part together.
HEAD_ITEMS, PART_ITEMS, PART_USERS = 4096, 1 << 16, 1 << 16
#: A task of the factorisation holds the ratings of one block of users or items and the factors they meet: blocks at least, ratings of one on average.
BLOCKS, BLOCK_RATINGS = 10, 1 << 20


def unit_vectors(weights: DataFrame, key: str, token: str, value: str) -> DataFrame:
    """Weights scaled to length one per key, as one sparse vector (tokens and weights in order of the token) per key; keys without a weight other than 0 are left out."""
    rows = weights.select(key, F.col(token).cast("string").alias("t"), F.col(value).cast("double").alias("w")).where("t IS NOT NULL AND w <> 0")
    rows = rows.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("t", "w"))).alias("vector"))
    # Summed in the order of the tokens: equal vectors stay equal to the last bit.
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, e: s + e["w"] * e["w"]))
    return rows.withColumn("_norm", norm).select(key, F.transform("vector", lambda e: F.struct(e["t"].alias("t"), (e["w"] / F.col("_norm")).alias("w"))).alias("vector"))


def _entries(groups: DataFrame) -> DataFrame:
    """One row per group and token: df, weight, norm of what comes after the token and of it and what comes after, rarest tokens first."""
    rows = groups.select("g", "size", F.explode("vector").alias("e")).select("g", "size", "e.t", "e.w")
    rows = rows.join(rows.groupBy("t").agg(F.count("*").alias("df")), "t")
    after = Window.partitionBy("g").orderBy("df", "t").rowsBetween(1, Window.unboundedFollowing)  # one vector
    rest = F.sqrt(F.coalesce(F.sum(F.col("w") * F.col("w")).over(after), F.lit(0.0)))
    return rows.withColumn("rest", rest).withColumn("from_here", F.sqrt(F.col("rest") * F.col("rest") + F.col("w") * F.col("w")))


def _dot(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """g, other, size (of other), similarity of the pairs (g, other), from the whole vectors."""
    a = groups.select("g", F.col("vector").alias("_a"))
    b = groups.select(F.col("g").alias("other"), "size", F.map_from_entries("vector").alias("_b"))
    dot = F.aggregate("_a", F.lit(0.0), lambda s, e: s + e["w"] * F.coalesce(F.try_element_at("_b", e["t"]), F.lit(0.0)))
    return pairs.join(a, "g").join(b, "other").select("g", "other", "size", dot.alias("similarity"))


def _thresholds(groups: DataFrame, entries: DataFrame, k: int, of: DataFrame) -> DataFrame:
    """(g, least): a lower bound of the k-th best similarity of the rows of every group in ``of``, 0 if k rows weren't met.

    A vector meets the ``HEAD_ROWS`` heaviest entries (k + 1 at least) of its heaviest tokens and of its commonest one; the 2 k that have most in common there are compared as a whole.
    They are real neighbours, so any k of them bound the k-th best from below.
    """
    heads = entries.withColumn("_r", F.row_number().over(Window.partitionBy("t").orderBy(F.desc("w"), "g"))).where(F.col("_r") <= max(HEAD_ROWS, k + 1)).select("t", F.col("g").alias("other"), F.col("w").alias("w2"))
    own = Window.partitionBy("g")
    asks = entries.join(of, "g", "left_semi").withColumns({"_h": F.row_number().over(own.orderBy(F.desc("w"), "t")), "_c": F.row_number().over(own.orderBy(F.desc("df"), "t"))})
    shared = asks.where(f"_h <= {HEAD_TOKENS} OR _c = 1").select("g", "t", "w").join(heads, "t").where("g <> other").groupBy("g", "other").agg(F.sum(F.col("w") * F.col("w2")).alias("_s"))
    most = F.row_number().over(own.orderBy(F.desc("_s"), "other"))
    pairs = shared.withColumn("_n", most).where(F.col("_n") <= 2 * k).select("g", "other")
    seen = _dot(pairs, groups).where("similarity > 0").select("g", F.col("size").alias("n"), "similarity").unionByName(groups.join(of, "g", "left_semi").select("g", (F.col("size") - 1).alias("n"), F.lit(1.0).alias("similarity")))
    upto = F.sum("n").over(Window.partitionBy("g").orderBy(F.desc("similarity")).rowsBetween(Window.unboundedPreceding, 0))
    return seen.withColumn("_upto", upto).groupBy("g").agg(F.coalesce(F.max(F.when(F.col("_upto") >= k, F.col("similarity"))), F.lit(0.0)).alias("least"))


def similar_candidates(groups: DataFrame, k: int, of: DataFrame | None = None) -> DataFrame:
    """(g, other): every pair whose similarity may be among the k best of g, for all groups or those in ``of``; see ``top_similar``."""
    entries = pin(_entries(groups))
    part = F.when(F.col("least") >= LOW, 1.0).otherwise(LOW_PART) * F.col("least") - SLACK
    least = pin(_thresholds(groups, entries, k, groups.select("g") if of is None else of).withColumn("part", part))
    step = [F.floor(F.col(c) * STEPS).alias(f"_{c}") for c in ("w", "rest")]
    lists = entries.select("t", F.col("g").alias("other"), F.col("w").alias("w2"), F.col("rest").alias("rest2"), *step)
    parts = lists.groupBy("t", "_w", "_rest").agg(F.max("w2").alias("top_w"), F.max("rest2").alias("top_rest"))
    probes = entries.join(least, "g").where("from_here >= part").select("g", "t", "w", "rest", "part")
    probes = probes.join(parts, "t").where("w * top_w + rest * top_rest >= part").drop("top_w", "top_rest")
    hits = probes.join(lists, ["t", "_w", "_rest"]).where("g <> other AND w * w2 + rest * rest2 >= part")
    met = hits.groupBy("g", "other").agg(F.sum(F.col("w") * F.col("w2")).alias("found"), F.min(F.col("rest") * F.col("rest2")).alias("open"))
    # What is not in the sum comes after the last hit and, at the first token where it is shared, was worth less than ``part``.
    open_ = F.least(F.col("open"), F.greatest(F.col("part"), F.lit(0.0)))
    return met.join(least, "g").where(F.col("found") + open_ >= F.col("least") - 2 * SLACK).select("g", "other")


def fold_equal(vectors: DataFrame, key: str, k: int) -> DataFrame:
    """One row per distinct vector: g, vector, keys (its k + 1 smallest: no row ever names more), size (of keys), whole (no other key holds it)."""
    order = Window.partitionBy("vector").orderBy(key)
    first = vectors.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k + 1)
    groups = first.groupBy("vector").agg(F.sort_array(F.collect_list(key)).alias("keys"), (F.count("*") <= k).alias("whole"))
    return groups.withColumns({"size": F.size("keys"), "g": F.monotonically_increasing_id()})


def _meet_all(keep: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """Of a block's vectors (g, t, w) and the lists (token, others, weights) of their tokens the ``keep`` most similar vectors of each, and those as similar as the last."""
    def meet(own: pd.DataFrame, lists: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(own) and len(lists):
            others, weights = [np.asarray(x) for x in lists["others"]], [np.asarray(x) for x in lists["weights"]]
            own = own.assign(at=pd.Index(lists["token"]).get_indexer(own["t"])).query("at >= 0").sort_values(["g", "t"])
            g, at, w = own["g"].to_numpy(), own["at"].to_numpy(), own["w"].to_numpy()
            starts = np.flatnonzero(np.r_[True, g[1:] != g[:-1]]) if len(g) else []
            for a, b in zip(starts, [*starts[1:], len(g)]):
                met, place = np.unique(np.concatenate([others[i] for i in at[a:b]]), return_inverse=True)
                s = np.bincount(place, np.concatenate([weights[i] * x for i, x in zip(at[a:b], w[a:b])]))
                s[met == g[a]] = -1.0
                least = np.partition(s, len(s) - keep)[len(s) - keep] if len(s) > keep else 0.0
                good = np.flatnonzero((s >= least - SLACK) & (s > 0))
                found.append((np.full(len(good), g[a]), met[good], s[good]))
        columns = [np.concatenate(x) for x in zip(*found)] if found else [np.empty(0, "int64"), np.empty(0, "int64"), np.empty(0)]
        return pd.DataFrame(dict(zip(("g", "other", "similarity"), columns)))
    return meet


def _similar_by_lists(groups: DataFrame, lists: DataFrame, met: DataFrame, k: int) -> DataFrame:
    """(g, other, similarity): at least the k + 1 most similar groups of those in ``groups``, whose tokens are in few vectors. ``lists``: others and weights of the tokens t; ``met``: entries and tokens of all groups.

    Each block of groups gets the lists of its tokens, packed; no pair is shuffled. Blocks are worked off in waves whose results are pinned, so the disk holds what one wave is sent.
    """
    n, entries, rows = met.agg(F.count(F.when(F.col("met") <= LIST_ROWS, 1)), F.sum(F.when(F.col("met") <= LIST_ROWS, F.col("met"))), F.sum("tokens")).first()
    blocks = n // BLOCK_ROWS + 1
    waves = min(blocks, (entries or 0) // max(WAVE_ROWS, WAVE_PART * (rows or 0)) + 1)
    found = []
    for wave in range(waves):
        block = F.pmod(F.xxhash64("g"), F.lit(blocks))
        own = groups.withColumn("block", block).where(F.col("block") % waves == wave).select("g", "block", F.explode("vector").alias("e")).select("g", "block", "e.t", "e.w")
        # The two sides of a cogroup must not share columns.
        sent = own.groupBy(F.col("t").alias("token")).agg(F.collect_set("block").alias("_blocks")).join(lists, F.col("token") == F.col("t")).select(F.explode("_blocks").alias("_block"), "token", "others", "weights")
        found.append(pin(own.groupBy("block").cogroup(sent.groupBy("_block")).applyInPandas(_meet_all(k + 1), "g bigint, other bigint, similarity double")))
        del own, sent
        release(groups)
    return functools.reduce(DataFrame.unionByName, found)


def _near(groups: DataFrame, k: int) -> DataFrame:
    """(g, other, similarity rounded to six decimals, above 0): at least the k + 1 best of every group."""
    rows = groups.select("g", F.explode("vector").alias("e")).select("g", "e.t", "e.w")
    df = pin(rows.groupBy("t").agg(F.count("*").alias("df")))
    met = pin(rows.join(df, "t").groupBy("g").agg(F.sum("df").alias("met"), F.count("*").alias("tokens")))
    shared = rows.join(df.where(f"df BETWEEN 2 AND {LIST_ROWS}").select("t"), "t")
    # Dealt by token once: the waves don't move the lists again to look them up.
    lists = pin(shared.groupBy("t").agg(F.collect_list(F.struct("g", "w")).alias("l")).select("t", F.col("l.g").alias("others"), F.col("l.w").alias("weights")))
    del df, shared
    release(groups)
    far = met.where(F.col("met") > LIST_ROWS).select("g")
    if far.isEmpty():
        out = _similar_by_lists(groups, lists, met, k)
    else:
        out = _similar_by_lists(groups.join(far, "g", "left_anti"), lists, met, k).unionByName(_dot(pin(similar_candidates(groups, k, far)), groups).drop("size"))
    return out.withColumn("similarity", F.round("similarity", 6)).where("similarity > 0")


def top_similar(vectors: DataFrame, key: str, k: int) -> DataFrame:
    """M-10, M-14: the exact k nearest vectors by cosine (rounded to six decimals), ties by key; pairs that share nothing are left out. Weights must not be negative, keys are unique.

    Equal vectors are one group. A vector whose tokens are in few vectors (``LIST_ROWS`` entries in all) meets them all: its block gets the lists of its tokens. Every other vector first gets a lower bound of its k-th best similarity from some real neighbours. Then it looks into the lists of its tokens, rarest first: at a token, a pair
    that has met under no rarer one is worth at most the product of the two weights plus the product of the norms of what comes after (Cauchy-Schwarz), so only lists and entries
    that still reach the bound are met, and tokens after which too little norm is left are never looked up. Lists are split by steps of weight and remaining norm, so a hot token is
    many keys, of which most are ruled out by their largest values. What the shared tokens sum up to, plus what the rest may add, leaves few pairs for the exact product.
    """
    vectors = pin(vectors.select(key, "vector"))
    release(vectors)
    groups = pin(fold_equal(vectors, key, k))
    crowds = groups.where("NOT whole").select("g", "vector")
    # Only keys of large groups are looked up by their vector.
    crowded = None if crowds.isEmpty() else vectors.join(crowds, "vector").select("g", key)
    del vectors
    release(groups)
    near = _near(groups, k).unionByName(groups.select("g", F.col("g").alias("other"), F.lit(1.0).alias("similarity")))
    named = near.join(groups.select(F.col("g").alias("other"), "keys"), "other").select("g", "similarity", F.element_at("keys", 1).alias("_first"), "keys")
    best = named.withColumn("_n", F.row_number().over(Window.partitionBy("g").orderBy(F.desc("similarity"), "_first"))).where(F.col("_n") <= k + 1)
    rows = best.select("g", "similarity", F.explode("keys").alias("other"))
    rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy("g").orderBy(F.desc("similarity"), "other"))).where(F.col("_n") <= k + 1)
    lists = rows.groupBy("g").agg(F.array_sort(F.collect_list(F.struct((-F.col("similarity")).alias("s"), "other"))).alias("best"))
    members = groups.where("whole").select("g", F.explode("keys").alias(key))
    members = members if crowded is None else members.unionByName(crowded)
    # Each key leaves itself out of its group's k + 1 best.
    own = members.join(lists, "g").select(key, F.slice(F.filter("best", lambda e: e["other"] != F.col(key)), 1, k).alias("best"))
    out = own.select(key, F.posexplode("best").alias("p", "e"))
    return out.select(key, F.col("e.other").alias("other"), (-F.col("e.s")).alias("similarity"), (F.col("p") + 1).alias("position"))


def tfidf_weights(products: DataFrame, key: str = "product_id", columns: tuple[str, ...] = ("product_name", "category", "brand")) -> DataFrame:
    """M-10: smoothed TF-IDF (ln((1 + n) / (1 + df)) + 1) of the joined texts."""
    text = F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in columns])
    tokens = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}_]+"), lambda x: F.length(x) >= 2)
    tf = products.select(key, F.explode(tokens).alias("token")).groupBy(key, "token").agg(F.count("*").alias("tf"))
    n = products.agg(F.count("*").alias("n")).scalar()
    df = tf.groupBy("token").agg(F.count("*").alias("df"))
    idf = F.log((1 + n) / (1 + F.col("df"))) + 1
    return tf.join(df, "token").select(key, "token", (F.col("tf") * idf).alias("weight"))


def similar_products(products: DataFrame, k: int = 10, key: str = "product_id", columns: tuple[str, ...] = ("product_name", "category", "brand")) -> DataFrame:
    """M-10: most similar products by text."""
    return top_similar(unit_vectors(tfidf_weights(products, key, columns), key, "token", "weight"), key, k)


def similar_customers(sales: DataFrame, k: int = 5) -> DataFrame:
    """M-14: customers with the most similar purchase quantities."""
    bought = sales.groupBy("customer_id", "product_id").agg(F.sum("quantity").cast("double").alias("q"))
    return top_similar(unit_vectors(bought, "customer_id", "product_id", "q"), "customer_id", k)


def interactions(sales: DataFrame) -> DataFrame:
    """Ratings 1..5 from the number of purchases of a product."""
    return sales.groupBy("customer_id", "product_id").agg(F.least(F.count("*"), F.lit(5)).cast("float").alias("rating"))


class Factors(NamedTuple):
    """A factorisation and the dense numbers it knows users and items by, so ids may have any size."""

    model: ALSModel
    users: DataFrame
    items: DataFrame


def dense_ids(df: DataFrame, key: str, name: str) -> DataFrame:
    """(key, name): the distinct keys numbered from 1."""
    return pin(number_rows(df.select(key).where(F.col(key).isNotNull()).distinct(), [F.col(key)], (), name, "_n").select(key, F.col(name).cast("int").alias(name)))


def fit_factors(ratings: DataFrame, rank: int = 10, rounds: int = 5, pinned: DataFrame | None = None) -> Factors:
    """M-11: non-negative factorisation. ``pinned``: the same ratings, for the numberings, which read them several times; the factors' last digits depend on the order of ``ratings``.

    Users and items are dealt into more blocks the more ratings there are. Every round is checkpointed: shuffle files of earlier ones are removed.
    """
    known = ratings if pinned is None else pinned
    users, items = dense_ids(known, "customer_id", "_u"), dense_ids(known, "product_id", "_i")
    known = pin(ratings.join(users, "customer_id").join(items, "product_id").select("_u", "_i", "rating"))
    release(known)
    blocks = max(BLOCKS, -(-known.count() // BLOCK_RATINGS))
    als = ALS(userCol="_u", itemCol="_i", ratingCol="rating", rank=rank, maxIter=rounds, nonnegative=True, seed=42, coldStartStrategy="drop",
              numUserBlocks=blocks, numItemBlocks=blocks, checkpointInterval=1)
    return Factors(als.fit(known), users, items)


def _head_bounds(head: pd.DataFrame, k: int):
    """A function over rows (_u, f, seen): adds least (a bound from below of the user's k-th best unseen score, with room for rounding; -1 if the items of ``head`` give none), norm and cap (k + number of items seen)."""
    ids, factors = head["_i"].to_numpy(), np.stack([np.asarray(x, "float32") for x in head["f"]])
    order = np.argsort(ids)
    ids, factors = ids[order], factors[order]
    longest = float(np.linalg.norm(factors.astype("float64"), axis=1).max())

    def bounds(batches):
        for rows in batches:
            if not len(rows):
                continue
            users = np.stack([np.asarray(x, "float32") for x in rows["f"]])
            norm, least = np.linalg.norm(users.astype("float64"), axis=1), np.full(len(rows), -1.0)
            for a in range(0, len(rows), 512):
                s = users[a:a + 512] @ factors.T
                for j, seen in enumerate(rows["seen"].iloc[a:a + 512]):
                    at = np.searchsorted(ids, seen)
                    at = at[(at < len(ids)) & (ids[np.minimum(at, len(ids) - 1)] == seen)]
                    s[j, at] = -np.inf
                if len(ids) >= k:
                    best = np.partition(s, len(ids) - k, axis=1)[:, len(ids) - k]
                    least[a:a + 512] = np.where(np.isfinite(best), best, -1.0)
            least = np.where(least < 0, -1.0, least - 1e-5 * norm * longest)
            yield pd.DataFrame({"_u": rows["_u"], "f": rows["f"], "norm": norm, "least": least, "cap": k + rows["seen"].map(len)})
    return bounds


def _best_of_part() -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """A function, sent to the tasks by value: (_u, _i, predicted_rating) of the users' scores in one part of the items that reach ``least``, the ``cap`` best of a user."""
    def scores(users: np.ndarray, items: np.ndarray) -> np.ndarray:
        # Summed in double, so they don't depend on what is asked for together.
        return np.einsum("ij,ij->i", users, items, dtype="float64").astype("float32")

    def best(users: pd.DataFrame, items: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(users) and len(items):
            items = items.sort_values("length", ascending=False)
            ids, far, vi = items["_i"].to_numpy(), items["length"].to_numpy(), np.stack([np.asarray(x, "float32") for x in items["vi"]])
            # Users that need the longest items come last, so a step of items meets the first of them only.
            users = users.assign(need=users["least"] / users["norm"].clip(lower=1e-300)).sort_values("need")
            vu = np.stack([np.asarray(x, "float32") for x in users["f"]])
            uid, cap, need = users["_u"].to_numpy(), users["cap"].to_numpy(), users["need"].to_numpy()
            for a in range(0, len(users), 256):
                us, least, held, n = vu[a:a + 256], users["least"].to_numpy()[a:a + 256].astype("float64"), [], 0

                def cut(held, least):
                    row, col, s = (np.concatenate(x) for x in zip(*held))
                    order = np.lexsort((ids[col], -s, row))
                    row, col, s = row[order], col[order], s[order]
                    place = np.arange(len(row)) - np.searchsorted(row, row)
                    keep, last = place < cap[a + row], place == cap[a + row] - 1
                    # Only a score as good as the last one kept can still get in.
                    least[row[last]] = np.maximum(least[row[last]], s[last] * (1 - 1e-5) - 1e-30)
                    return [(row[keep], col[keep], s[keep])]

                for c in range(0, len(ids), 2048):
                    m = int(np.searchsorted(need[a:a + 256], far[c], side="right"))
                    if not m:
                        break
                    row, col = np.divmod(np.flatnonzero(us[:m] @ vi[c:c + 2048].T >= least[:m, None].astype("float32")), min(2048, len(ids) - c))
                    if len(row):
                        held.append((row, col + c, scores(us[row], vi[col + c])))
                        n += len(row)
                        if n > 1 << 20:
                            held = cut(held, least)
                            n = len(held[0][0])
                if held:
                    row, col, s = cut(held, least)[0]
                    found.append((uid[a + row], ids[col], s.astype("float64")))
        columns = [np.concatenate(x) for x in zip(*found)] if found else [np.empty(0, "int32"), np.empty(0, "int32"), np.empty(0)]
        return pd.DataFrame(dict(zip(("_u", "_i", "predicted_rating"), columns)))
    return best


def unseen_recommendations(factors: Factors, ratings: DataFrame, k: int = 10) -> DataFrame:
    """M-11: the k best items a user has not rated, ties by item.

    A score is at most the product of the lengths of both factors. The longest items give every user a lower bound of the k-th best unseen score; items are dealt by length into parts,
    and a user meets only the parts that can reach the bound, in blocks of users and items. A user takes from a part at most k more than the items rated, so the anti-join always leaves
    k, if that many exist.
    """
    model, users, items = factors
    seen = pin(ratings.join(users, "customer_id").join(items, "product_id").select("_u", "_i").distinct())
    length = F.sqrt(F.aggregate("f", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    goods = model.itemFactors.select(F.col("id").alias("_i"), F.col("features").alias("f")).withColumn("norm", length)
    goods = pin(number_rows(goods, [F.desc("norm"), F.col("_i")]).withColumn("part", F.floor((F.col("rn") - 1) / PART_ITEMS).cast("int")).select("_i", "f", "norm", "rn", "part"))
    head = goods.where(F.col("rn") <= HEAD_ITEMS).select("_i", "f").toPandas()  # at most HEAD_ITEMS rows
    if not len(head):
        return ratings.limit(0).select("customer_id", "product_id", F.lit(0.0).alias("predicted_rating"), F.lit(0).alias("position"))
    people = model.userFactors.select(F.col("id").alias("_u"), F.col("features").alias("f")).join(seen.groupBy("_u").agg(F.collect_list("_i").alias("seen")), "_u")
    people = pin(people.mapInPandas(_head_bounds(head, k), "_u int, f array<float>, norm double, least double, cap bigint"))
    tops = goods.groupBy(F.col("part").alias("_p")).agg(F.max("norm").alias("top")).withColumnRenamed("_p", "part")  # one row per part
    blocks = people.count() // PART_USERS + 1
    asks = people.join(F.broadcast(tops), F.col("norm") * F.col("top") >= F.col("least")).withColumn("block", F.col("_u") % blocks)
    cells = pin(asks.select(F.col("part").alias("_part"), F.col("block").alias("_block")).distinct())
    sent = goods.join(cells, F.col("part") == F.col("_part")).select("_part", "_block", "_i", F.col("f").alias("vi"), F.col("norm").alias("length"))
    out = asks.groupBy("part", "block").cogroup(sent.groupBy("_part", "_block")).applyInPandas(
        _best_of_part(), "_u int, _i int, predicted_rating double")
    fresh = out.join(seen, ["_u", "_i"], "left_anti")
    w = Window.partitionBy("_u").orderBy(F.desc("predicted_rating"), "_i")  # numbers of items are in the order of their ids
    best = fresh.withColumn("position", F.row_number().over(w)).where(F.col("position") <= k)
    return best.join(users, "_u").join(items, "_i").select("customer_id", "product_id", "predicted_rating", "position")


def hybrid(recent: DataFrame, similar: DataFrame, collaborative: DataFrame, popular: DataFrame, users: DataFrame, k: int = 10, content_weight: float = 0.3, neighbours: int = 5) -> DataFrame:
    """M-12: the first ``neighbours`` content neighbours of the last items x 0.3 plus collaborative x 0.7, summed per product.

    Users without any score get the popular list (product_id, score), whose length the caller fixes; it
    is attached as one array literal.
    """
    content = recent.join(similar.where(F.col("position") <= neighbours).select("product_id", "other", "similarity"), "product_id").select(
        "customer_id", F.col("other").alias("product_id"), (F.col("similarity") * content_weight).alias("s"))
    collab = collaborative.select(F.col("customer_id").cast("bigint").alias("customer_id"), F.col("product_id").cast("bigint").alias("product_id"),
                                  (F.col("predicted_rating") * (1 - content_weight)).alias("s"))
    scored = pin(content.unionByName(collab).groupBy("customer_id", "product_id").agg(F.round(F.sum("s"), 6).alias("hybrid_score")))
    w = Window.partitionBy("customer_id").orderBy(F.desc("hybrid_score"), "product_id")
    best = scored.withColumn("position", F.row_number().over(w)).where(F.col("position") <= k)
    top = popular.orderBy(F.desc("score"), "product_id").limit(k).agg(F.collect_list(F.struct("product_id", "score")).alias("p")).scalar()
    cold = users.select("customer_id").join(scored.select("customer_id"), "customer_id", "left_anti")
    cold = cold.withColumn("_p", top).select("customer_id", F.posexplode("_p").alias("i", "r")).select(
        "customer_id", F.col("r.product_id").cast("bigint").alias("product_id"), F.col("r.score").cast("double").alias("hybrid_score"), (F.col("i") + 1).alias("position"))
    return best.unionByName(cold)


def recent_items(sales: DataFrame, n: int = 5) -> DataFrame:
    """The last n distinct products of a customer."""
    last = sales.groupBy("customer_id", "product_id").agg(F.max("order_date").alias("t"))
    w = Window.partitionBy("customer_id").orderBy(F.desc("t"), "product_id")
    return last.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n).select("customer_id", "product_id")


def metrics_at_k(recommended: DataFrame, actual: DataFrame, k: int) -> DataFrame:
    """M-13: precision, recall and F1 at k per user."""
    r, a = recommended.select("customer_id", "product_id").distinct(), actual.select("customer_id", "product_id").distinct()
    h = r.join(a, ["customer_id", "product_id"]).groupBy("customer_id").agg(F.count("*").alias("hits"))
    n = a.groupBy("customer_id").agg(F.count("*").alias("relevant"))
    users = r.select("customer_id").distinct().join(n, "customer_id").join(h, "customer_id", "left")
    hits = F.coalesce("hits", F.lit(0))
    p, c = hits / F.lit(float(k)), ratio(hits, F.col("relevant"))
    f1 = F.coalesce(F.try_divide(2 * p * c, p + c), F.lit(0.0))
    return users.select("customer_id", hits.alias("hits"), p.alias("precision_at_k"), c.alias("recall_at_k"), f1.alias("f1_at_k"))


def mean_metrics(per_user: DataFrame) -> DataFrame:
    """M-13: averages over users."""
    return per_user.agg(F.count("*").alias("users"), *[F.round(F.avg(c), 6).alias(c) for c in ("precision_at_k", "recall_at_k", "f1_at_k")])


