"""Hard negatives, the mix of sources and ranked search on small made cases, against brute force."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tests.llm.test_operators import ODD, clash, docs_of
from tillroll.llm import common, curriculum, hard_negatives, ranked_search


@pytest.fixture(autouse=True)
def prepared(spark):
    common.ready(spark)


# Hard negatives

VECTORS = "vec_id bigint, label int, vec array<bigint>"
NAMES = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def brute_negatives(rows, every):
    rows = {(i, y, tuple(v)) for i, y, v in rows if i is not None and y is not None and v is not None and None not in v}
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for i, y, v in rows:
        if i % every:
            continue
        scored = [(-dot(v, w), j, z) for j, z, w in rows]
        for s, j, _ in sorted(x for x in scored if x[2] == y and x[1] != i)[:5]:
            band = sorted(x for x in scored if x[2] != y and -50 * s <= -100 * x[0] <= -95 * s)[:3]
            out += [(i, j, k + 1, n, -s, -t) for k, (t, n, _) in enumerate(band)]
    return sorted(out)


def mined(spark, rows, every):
    found = hard_negatives.mined(clash(spark.createDataFrame(rows, VECTORS).withColumnRenamed("label", "y")).withColumn("label", F.col("y")), F.col("vec_id") % every == 0)
    return sorted(tuple(r[c] for c in NAMES) for r in found.collect())


def clustered(seed, n, dims=12):
    r = random.Random(seed)
    centres = [[r.gauss(0, 60) for _ in range(dims)] for _ in range(8)]
    return [(i, r.randrange(4), [round(x + r.gauss(0, 25)) for x in r.choice(centres)]) for i in range(n)]


@pytest.mark.parametrize("bucket_batch, block", [(1000, 16 << 20), (17, 1500)])
def test_negatives_equal_brute_force(spark, monkeypatch, bucket_batch, block):
    monkeypatch.setattr(hard_negatives, "BLOCK_BYTES", block)
    monkeypatch.setattr(hard_negatives, "SEEDS", 60)
    rows = clustered(3, 400)
    rows += [(1000 + i, i % 2, [40] * 12) for i in range(120)]  # a hot vector under two labels
    rows += [rows[0]] * 50 + [(None, 1, [1] * 12), (9000, None, [1] * 12), (9050, 1, None), (9100, 2, [None] * 12), (9150, 3, [0] * 12), (9200, 1, []), (9250, 2, [70, 80])]
    monkeypatch.setattr(hard_negatives, "ready", lambda s: s.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(bucket_batch)))
    try:
        assert mined(spark, rows, 10) == brute_negatives(rows, 10)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def test_focus_ranges_lose_nothing_and_sieve():
    """All rows that reach the threshold are candidates; in clustered vectors most others aren't."""
    import numpy as np
    rows = [v for _, _, v in clustered(5, 600)]
    vectors = np.array(rows, np.int64)
    bucket = hard_negatives.Bucket(vectors, [[i] for i in range(600)], np.zeros(600, np.int64))
    unit = vectors / np.linalg.norm(vectors, axis=1)[:, None]
    kept = 0
    for a in range(0, 600, 7):
        scores = vectors @ vectors[a]
        least = np.sort(scores)[-10]
        focus = np.argsort(-np.abs(unit[a]))[None, :3]
        lo, hi = bucket.ranges(focus, unit[a][focus], np.array([least / (np.linalg.norm(vectors[a]) * bucket.longest)]))
        found = set(bucket.candidates(focus[0], lo[0], hi[0]).tolist())
        assert set(np.flatnonzero(scores >= least).tolist()) <= found
        kept += len(found)
    assert kept < 0.7 * 86 * 600


def test_negatives_of_nothing(spark):
    assert mined(spark, [], 10) == [] and mined(spark, [(1, 0, [3, 4]), (2, 1, [3, 4])], 10) == [] and mined(spark, [(10, 0, [3, 4])], 10) == []


def test_large_components_stay_exact(spark):
    rows = [(0, 0, [2**28, 3]), (1, 0, [2**28, 1]), (2, 1, [2**28 * 9 // 10, 7]), (3, 1, [2**28 * 9 // 10, 6])]
    assert mined(spark, rows, 10) == brute_negatives(rows, 10)


# Mix of sources

def brute_targets(sizes):
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, (s or "").encode())))}
    target, open_, left = {}, set(sizes), 1.5 * sum(sizes.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        above = {s for s in open_ if weight[s] * level >= 2 * sizes[s]}
        target |= {s: 2.0 * sizes[s] for s in above} if above else {s: weight[s] * level for s in open_}
        left -= sum(2 * sizes[s] for s in above)
        open_ = open_ - above if above else set()
    return target


def mix_docs(spark):
    r = random.Random(8)
    rows = [(i, "w " * r.randrange(1, 60), "big" if i % 3 == 0 else r.choice(["a", "b", "c", "é", None])) for i in range(900)]
    rows += [(None, "x y z", "a"), (None, None, "b"), (5000, "same row", "c"), (5001, "", "only empty"), (5002, None, "only empty")] + [(5000, "same row", "c")] * 40
    return rows, spark.createDataFrame(rows, "doc_id bigint, text string, source string")


def test_mix_reaches_its_targets(spark):
    rows, docs = mix_docs(spark)
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    want = brute_targets(sizes)
    placed = curriculum.placed(clash(docs).withColumn("size", F.lit("x"))).collect()
    assert len(placed) == len(rows) and abs(sum(want.values()) - 1.5 * sum(sizes.values())) < 1e-6
    taken, longest = defaultdict(int), defaultdict(int)
    for r in placed:
        assert r["size"] == len((r["text"] or "").split()) and r["source_size"] == sizes[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6
        assert len(r["positions"]) <= 2 and r["positions"] == sorted(r["positions"]) and all(0 <= p <= 1 for p in r["positions"])
        taken[r["source"]] += r["size"] * len(r["positions"])
        longest[r["source"]] = max(longest[r["source"]], r["size"])
    assert all(abs(taken[s] - want[s]) <= longest[s] / 2 + 1e-6 for s in want)
    key = lambda r: tuple(-1 if x is None else x for x in r)
    again = [sorted((key(r) for r in curriculum.digests(d).collect())) for d in (docs, docs.repartition(7))]
    assert again[0] == again[1]


def test_mix_is_sorted_and_follows_the_schedules(spark):
    rows, docs = mix_docs(spark)
    mix = curriculum.mixed(docs).collect()
    positions = [r["position"] for r in mix]
    assert positions == sorted(positions)
    sources = sorted({s for *_, s in rows}, key=lambda s: (s is None, (s or "").encode()))
    for turn, s in enumerate(sources):
        words = [(r["position"], len((r["text"] or "").split())) for r in mix if r["source"] == s]
        total = sum(n for _, n in words)
        if total < 500:
            continue
        knots = curriculum.SCHEDULES[turn % 3]
        area = lambda x: sum(((min(x, b) - a) * (u + u + (v - u) * (min(x, b) - a) / (b - a)) / 2) for (a, u), (b, v) in zip(knots, knots[1:]) if x > a)  # noqa: B023, E731
        for x in (0.25, 0.5, 0.75):
            assert abs(sum(n for p, n in words if p < x) / total - area(x) / area(1)) < 60 / total + 0.01


def test_mix_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string, source string")
    assert curriculum.digests(empty).collect() == [] and curriculum.mixed(empty).collect() == []
    bare = curriculum.digests(spark.createDataFrame([(1, None, None), (2, "", "a")], empty.schema)).collect()
    assert [(r["size"], r["target"], r["taken"]) for r in bare] == [(0, 0.0, 0)] * 2


def test_hot_row_is_spread(spark):
    """A third of all rows are one row: its copies lie in several slices and are all there."""
    docs = spark.createDataFrame([(7, "a b", "s")] * 3000 + [(i, "c", "s") for i in range(100, 3100)], "doc_id bigint, text string, source string")
    out = curriculum.digests(docs).collect()
    assert len(out) == 6000 and abs(sum(r["taken"] for r in out) - 1.5 * 9000) <= 1


def test_schedule_is_inverted():
    with pytest.raises(ValueError):
        curriculum.time_of(F.lit(0.5), [(0.0, 1.0), (0.9, 1.0)])


# Ranked search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_search(docs, items, k=50):
    counts = [(i, Counter(terms(t))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n_docs, n_terms = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c in counts:
            m = 100 - 50 + (50 * sum(c.values()) * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(terms(text)) if t in c)
            scored += [(-s, i is None, i or 0, i)] if s else []
        out += [(item, r + 1, i, -s) for r, (s, _, _, i) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def searched(docs, items, k=50):
    return sorted((tuple(r) for r in ranked_search.ranked(docs, items, k).collect()), key=str)


@pytest.mark.parametrize("shard, first, block", [(20_000, 64, 8 << 20), (40, 1, 300)])
def test_search_equals_brute_force(spark, monkeypatch, shard, first, block):
    for name, value in (("SHARD_DOCS", shard), ("FIRST_BLOCK", first), ("BLOCK_BYTES", block)):
        monkeypatch.setattr(ranked_search, name, value)
    monkeypatch.setattr(ranked_search, "ready", lambda s: s.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(min(1000, shard // 2))))
    r = random.Random(11)
    words = [f"w{int(r.paretovariate(0.6)) % 300}" for _ in range(20_000)]
    docs = [(i, " ".join(r.choices(words, k=r.randrange(1, 40)))) for i in range(300)] + ODD + [(900 + i, "tie, TIE! tie") for i in range(70)] + [(980, "É Straße naïve—tie x1y2 \x00 q\x7fq"), (-5, "a_b a-b ÀB")]
    items = [(i, " ".join(r.choices(words, k=r.randrange(1, 12)))) for i in range(20)] + [(50, None), (51, ""), (52, "tie"), (52, "tie"), (None, "Tie straße É"), (53, "nowhere?"), (54, "a A b word six")]
    try:
        for k in (50, 3):
            got = searched(clash(docs_of(spark, docs)), clash(spark.createDataFrame(items, "item_id bigint, text string")), k)
            assert got == brute_search(docs, items, k)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def test_reading_stops_early(monkeypatch):
    """A rare term settles the best documents long before a common term's list is read to the end."""
    import numpy as np
    n = 20_000
    of = np.concatenate([np.arange(n), np.arange(0, n, 1000)])
    t = np.concatenate([np.zeros(n, int), np.ones(20, int)])
    shard = ranked_search.Shard(np.arange(n), np.full(n, 9), of, t, np.where(of % 1000, 1, 50), np.array([1, 9000]), n, 9 * n)

    class Counted(np.ndarray):
        read = 0

        def __getitem__(self, key):
            if isinstance(key, slice):
                Counted.read += key.stop - key.start
            return np.asarray(self)[key]

    shard.docs = shard.docs.view(Counted)
    at, _ = shard.best([0, 1], 5)
    assert at.tolist() == [0, 1000, 2000, 3000, 4000] and Counted.read < 500


def test_search_of_nothing(spark):
    docs, items = docs_of(spark, []), spark.createDataFrame([(1, "a")], "item_id bigint, text string")
    assert searched(docs, items) == [] and searched(docs_of(spark, ODD), items.where("false")) == [] and searched(docs_of(spark, [(1, None), (2, "")]), items) == []
