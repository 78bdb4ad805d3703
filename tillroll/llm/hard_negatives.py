"""Hard negatives by exact inner products: length buckets with sorted coordinate lists, feasible value ranges for an anchor's focus coordinates, exact verification.

Vectors are arrays of whole numbers. An anchor's positives are the rows of its label with the largest inner products; the negatives of a positive are the best rows of other labels whose
score lies in a band below the positive's score. Equal scores come in order of the id.

Rows of one label and vector are one group that keeps its ``positives + 1`` smallest ids: no more can ever be named, since an anchor leaves out only itself. Groups are range-partitioned by label
and length, so a slice of up to ``BUCKET`` neighbours is a length bucket. For every coordinate a bucket sorts its rows by the value of the normalised vectors. An anchor with threshold t skips a
bucket whose longest vector cannot reach t. Else, with c = t / (its length * the bucket's greatest length), a partner's value at coordinate f must lie between cos(x + y) and cos(x - y), where
cos x is the anchor's own value at f and cos y = c. The ranges of the ``FOCUS`` coordinates with the anchor's largest values are looked up in the sorted lists; the narrowest one gives candidates,
the others sieve them, what is left is verified exactly. Where no range leaves out half of a bucket the whole bucket is verified at once.

The threshold is the k-th best score so far in a task; a first pass over about ``SEEDS`` rows gives every anchor a start (any rows give a valid lower bound, so nothing depends on the choice).
Anchors are a query set: they are sent to the tasks in blocks of ``BLOCK_BYTES``, one pass over all rows a block, whose rows are written to the shared folder.

Defined results: a row without an id, label or vector, or with a component that is null, NaN or infinite, takes no part. Rows equal in id, label and vector count once; a row is never a positive of
an anchor with its own id. Shorter vectors are taken as if filled with zeros (an empty vector scores 0 everywhere). Long vectors need memory of a batch of 1,000 only. Ties go to the smaller id.
Empty tables, or no anchor, give an empty result. Other columns of the input are not looked at. A hundred times a score must fit a 64-bit integer.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillroll.llm.common import ready
from tillroll.session import pin, shared_folder

BUCKET, FOCUS, SEEDS, BLOCK_BYTES = 1000, 3, 2000, 16 << 20
#: Slack of the comparisons of real numbers; they only ever let more rows through to the exact check.
SLACK = 1e-9


def matrix(vectors: pa.Array) -> np.ndarray:
    """Rows of whole numbers; shorter ones are filled with zeros."""
    lengths = np.diff(vectors.offsets.to_numpy())
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    width = int(lengths.max(initial=0))
    if (lengths == width).all():
        return flat.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width), np.int64)
    out[np.arange(width) < lengths[:, None]] = flat
    return out


def widen(m: np.ndarray, width: int) -> np.ndarray:
    return m if m.shape[1] >= width else np.pad(m, ((0, 0), (0, width - m.shape[1])))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows; in doubles where every sum stays below 2^53."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    if float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < 2.0 ** 53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


class Bucket:
    """Neighbours in length, with a sorted list of every coordinate that is asked for."""

    def __init__(self, vectors: np.ndarray, ids: list[list[int]], labels: np.ndarray) -> None:
        self.vectors, self.ids, self.labels = vectors, ids, labels
        self.first = np.array([i[0] for i in ids], np.int64)
        lengths = np.sqrt((vectors.astype(np.float64) ** 2).sum(axis=1))
        self.longest = float(lengths.max(initial=0.0))
        self.unit = vectors / np.where(lengths > 0, lengths, 1.0)[:, None]
        self.lists: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def sorted_list(self, f: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Values in order, the rows in that order, and the place of every row in it."""
        if f not in self.lists:
            order = np.argsort(self.unit[:, f], kind="stable")
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            self.lists[f] = self.unit[order, f], order, place
        return self.lists[f]

    def ranges(self, focus: np.ndarray, values: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ends of the feasible stretches of the sorted lists: one row per anchor, one column per focus coordinate; ``least`` is the cosine needed."""
        need = np.clip(least, -1, 1)[:, None]
        spread = np.sqrt(np.maximum(0.0, (1 - need ** 2) * (1 - values ** 2)))
        low = np.where(values < -need, -1.0, values * need - spread) - SLACK
        high = np.where(values > need, 1.0, values * need + spread) + SLACK
        lo, hi = np.zeros(focus.shape, np.int64), np.full(focus.shape, len(self.vectors), np.int64)
        for f in np.unique(focus):
            at = np.nonzero(focus == f)
            ordered = self.sorted_list(int(f))[0]
            lo[at], hi[at] = np.searchsorted(ordered, low[at], "left"), np.searchsorted(ordered, high[at], "right")
        return lo, hi

    def candidates(self, focus: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Rows that lie in all ranges of one anchor, from the narrowest list on."""
        by_width = np.argsort(hi - lo, kind="stable")
        f = by_width[0]
        found = self.sorted_list(int(focus[f]))[1][lo[f]:hi[f]]
        for g in by_width[1:]:
            place = self.sorted_list(int(focus[g]))[2][found]
            found = found[(place >= lo[g]) & (place < hi[g])]
        return found


class Anchors:
    """A block of anchors: one row per wish (anchor, highest and lowest score allowed), sorted by anchor; ``same`` asks for the anchor's label, else for all other labels."""

    def __init__(self, keys: np.ndarray, labels: np.ndarray, vectors: np.ndarray, of: np.ndarray, wish: np.ndarray, low: np.ndarray, high: np.ndarray, same: bool, k: int) -> None:
        self.keys, self.labels, self.vectors, self.of, self.wish, self.low, self.high, self.same, self.k = keys, labels, vectors, of, wish, low, high, same, k

    def searched(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The k best groups of every wish among the rows of a task: wish, score, ids."""
        # Scores of a band are compared as hundredths, in whole numbers.
        low = self.low.copy()
        best: list[list[tuple[int, int, list[int]]]] = [[] for _ in self.wish]
        lengths = np.sqrt((self.vectors.astype(np.float64) ** 2).sum(axis=1))
        unit = self.vectors / np.where(lengths > 0, lengths, 1.0)[:, None]
        focus = np.argsort(-np.abs(unit), axis=1, kind="stable")[:, :FOCUS]
        focus_values = np.take_along_axis(unit, focus, axis=1)
        first_wish = np.searchsorted(self.of, np.arange(len(self.keys) + 1))
        by_label = np.argsort(self.labels, kind="stable")
        sorted_labels = self.labels[by_label]

        def keep(a: int, bucket: Bucket, rows: np.ndarray, scores: np.ndarray) -> None:
            for w in range(first_wish[a], first_wish[a + 1]):
                ok = (scores * 100 >= low[w]) & (scores * 100 <= self.high[w])
                ok = np.flatnonzero(ok if self.same else ok & (bucket.labels[rows] != self.labels[a]))
                if not len(ok):
                    continue
                if len(ok) > self.k:
                    ok = ok[np.lexsort((bucket.first[rows[ok]], -scores[ok]))[: self.k]]
                best[w] = sorted(best[w] + [(-int(scores[i]), bucket.ids[rows[i]][0], bucket.ids[rows[i]]) for i in ok])[: self.k]
                if len(best[w]) == self.k:
                    low[w] = max(low[w], -100 * best[w][-1][0])

        for batch in batches:
            labels = batch.column("label").to_numpy()
            if not len(labels):
                continue
            starts = np.flatnonzero(np.diff(labels, prepend=labels[0] - 1))
            # Positives have the label in common; a bucket for negatives may span labels.
            for i, j in zip(starts, [*starts[1:], len(labels)]) if self.same else [(0, len(labels))]:
                part = batch.slice(i, j - i)
                if self.same:
                    asked = by_label[np.searchsorted(sorted_labels, labels[i], "left"):np.searchsorted(sorted_labels, labels[i], "right")]
                else:
                    asked = np.flatnonzero(self.labels != labels[i]) if len(starts) == 1 else np.arange(len(self.labels))
                if not len(asked):
                    continue
                vectors = widen(matrix(part.column("vec")), self.vectors.shape[1])
                own = widen(self.vectors, vectors.shape[1])
                bucket = Bucket(vectors, part.column("ids").to_pylist(), labels[i:j])
                need = np.minimum.reduceat(low, first_wish[:-1])[asked] / 100 if len(low) else low
                reach = lengths[asked] * bucket.longest
                asked, need, reach = (x[need <= reach * (1 + SLACK) + SLACK] for x in (asked, need, reach))
                if not len(asked):
                    continue
                whole = np.ones(len(asked), bool)
                if focus.shape[1]:
                    cosine = np.where((need > 0) & (reach > 0), need / np.where(reach > 0, reach, 1.0), -1.0)
                    lo, hi = bucket.ranges(focus[asked], focus_values[asked], cosine)
                    whole = (hi - lo).min(axis=1) * 2 > len(vectors)
                    for n in np.flatnonzero(~whole):
                        found = bucket.candidates(focus[asked[n]], lo[n], hi[n])
                        if len(found):
                            keep(asked[n], bucket, found, products(own[asked[n]][None], vectors[found])[0])
                every, at_once = np.arange(len(vectors)), 256
                rest = asked[whole]
                for s in range(0, len(rest), at_once):
                    for a, scores in zip(rest[s:s + at_once], products(own[rest[s:s + at_once]], vectors)):
                        keep(a, bucket, every, scores)
        found = [(int(self.wish[w]), -s, ids) for w, rows in enumerate(best) for s, _, ids in rows]
        for s in range(0, len(found), 10_000):
            here = found[s:s + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in here], pa.int64()), pa.array([f[1] for f in here], pa.int64()), pa.array([f[2] for f in here], pa.list_(pa.int64()))], names=["wish", "score", "ids"])


def _search(spark: SparkSession, groups: DataFrame, seeds: DataFrame, wishes: DataFrame, same: bool, k: int, folder: str) -> DataFrame:
    """wish, score, ids of the k best groups of every wish; ``wishes`` (pinned) holds wish, key, label, vec, low and high (hundredths of a score)."""
    size = wishes.agg(F.sum(F.size("vec") * 8 + 64)).first()[0] or 0
    blocks = -(-size // BLOCK_BYTES)
    schema = "wish bigint, score bigint, ids array<bigint>"
    spark.createDataFrame([], schema).write.parquet(f"{folder}/none")
    for b in range(blocks):
        rows = wishes.where(F.pmod(F.xxhash64("key"), F.lit(blocks)) == b).toArrow().combine_chunks()
        if not rows.num_rows:
            continue
        rows = rows.sort_by([("key", "ascending"), ("wish", "ascending")])
        key = rows.column("key").to_numpy()
        first = np.flatnonzero(np.diff(key, prepend=key[0] - 1))
        block = Anchors(key[first], rows.column("label").to_numpy()[first], matrix(rows.column("vec").combine_chunks().take(pa.array(first))), np.cumsum(np.isin(np.arange(len(key)), first)) - 1,
                        rows.column("wish").to_numpy(), rows.column("low").to_numpy().copy(), rows.column("high").to_numpy(), same, k)

        def search(df: DataFrame) -> DataFrame:
            found = df.mapInArrow(lambda batches, s=spark.sparkContext.broadcast(block): s.value.searched(batches), schema)
            order = Window.partitionBy("wish").orderBy(F.desc("score"), F.element_at("ids", 1))
            return found.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k)

        start = search(seeds).where(F.col("_n") == k).select("wish", "score").toArrow()
        at = np.searchsorted(block.wish, start.column("wish").to_numpy(), sorter=(order := np.argsort(block.wish)))
        block.low[order[at]] = np.maximum(block.low[order[at]], 100 * start.column("score").to_numpy())
        search(groups).drop("_n").write.parquet(f"{folder}/block-{b}")
    return spark.read.schema(schema).parquet(f"{folder}/*")


def mined(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for every anchor and each of its first ``positives`` positives the first ``negatives``
    rows of other labels whose score is between ``low`` and ``high`` hundredths of the positive's.

    ``vectors`` holds vec_id, label (integer) and vec (array of whole numbers); ``is_anchor`` is a condition on them.
    """
    spark = vectors.sparkSession
    ready(spark)
    folder = f"{shared_folder(spark).rstrip('/')}/negatives-{uuid.uuid4().hex}"
    rows = vectors.where("vec_id IS NOT NULL AND label IS NOT NULL AND vec IS NOT NULL AND NOT exists(vec, x -> x IS NULL)").select(
        F.col("vec_id").cast("bigint").alias("id"), F.col("label").cast("bigint").alias("label"), F.col("vec").cast("array<bigint>").alias("vec"), is_anchor.alias("anchor")).dropDuplicates(["id", "label", "vec"])
    order = Window.partitionBy("label", "vec").orderBy("id")
    first = rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= positives + 1)
    groups = first.groupBy("label", "vec").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    length = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    groups = pin(groups.withColumn("length", length).repartitionByRange("label", F.desc("length"), "vec").sortWithinPartitions("label", F.desc("length")))
    total = groups.count()
    seeds = groups.where(F.pmod(F.xxhash64("vec"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, SEEDS / max(total, 1))))

    # Anchors of one label and vector are searched once.
    anchors = pin(rows.where("anchor").select("id", "label", "vec"))
    keys = pin(anchors.select("label", "vec").distinct().withColumn("key", F.monotonically_increasing_id()))
    anchors = anchors.join(keys, ["label", "vec"]).select(F.col("id").alias("anchor_id"), "key")
    best = _search(spark, groups, seeds, keys.select(F.col("key").alias("wish"), "key", "label", "vec", F.lit(-(2**63)).cast("bigint").alias("low"), F.lit(2**63 - 1).cast("bigint").alias("high")), True, positives + 1, f"{folder}/positives")
    named = best.select(F.col("wish").alias("key"), F.col("score").alias("positive_score"), F.explode("ids").alias("positive_id"))
    ranked = Window.partitionBy("key").orderBy(F.desc("positive_score"), "positive_id")
    named = named.withColumn("_n", F.row_number().over(ranked)).where(F.col("_n") <= positives + 1).drop("_n")
    # An anchor leaves out itself; at most positives + 1 rows are held per anchor.
    own = Window.partitionBy("key", "anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    chosen = pin(anchors.join(named, "key").where("anchor_id <> positive_id").withColumn("_n", F.row_number().over(own)).where(F.col("_n") <= positives).drop("_n"))

    wishes = chosen.select("key", "positive_score").distinct().withColumn("wish", F.monotonically_increasing_id())
    wishes = pin(wishes.join(keys, "key").select("wish", "key", "label", "vec", "positive_score", (F.col("positive_score") * low).alias("low"), (F.col("positive_score") * high).alias("high")))
    found = _search(spark, groups, seeds, wishes.drop("positive_score"), False, negatives, f"{folder}/negatives")
    found = found.select("wish", F.col("score").alias("negative_score"), F.explode("ids").alias("negative_id"))
    by_score = Window.partitionBy("wish").orderBy(F.desc("negative_score"), "negative_id")
    found = found.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= negatives)
    found = found.join(wishes.select("wish", "key", "positive_score"), "wish").drop("wish")
    return chosen.join(found, ["key", "positive_score"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
