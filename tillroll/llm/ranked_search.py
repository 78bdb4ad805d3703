"""Ranked search without random access: impact-sorted lists are read in turn, every document has an interval of possible scores, reading ends when the best are settled.

A pass over the whole texts counts the terms that queries ask for; its rows (document, length, terms, counts) are written once. Number and total length of the documents and the documents per term come
from them. Then every task turns its documents into shards of up to ``SHARD_DOCS`` documents and ``SHARD_POSTINGS`` postings. In a shard a term's list is sorted by impact (largest first), and a query reads
the lists of its terms from the front, in blocks that double. A document's lower score is the sum of the impacts read; its upper score adds, for each list in which it has not been met, the last impact
read there. Documents whose upper score is below the k-th lower one are left out. Reading ends when no document that has not been met can reach the k-th lower score, and lower and upper score
of all that are left agree; so membership, ties and scores are exact. The best k of the shards are merged by Spark (row numbers, limited in each task before the shuffle).

Queries are a stated set: they go to the tasks in blocks of ``BLOCK_BYTES`` of text, one pass over the documents a block.

Terms are runs of letters and digits (all characters beyond ASCII count as such); only A-Z are lower-cased. Defined results: a null or empty text has no term and does not count as a document. Repeated
rows are documents of their own and get ranks of their own, as do repeated items. A null doc_id comes after the others among equal scores. Equal scores go by ascending doc_id. Queries without terms, and
empty tables, give no rows. Very long texts are read whole, one at a time. Other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillroll.llm.common import ready
from tillroll.session import pin

SHARD_DOCS, SHARD_POSTINGS, FIRST_BLOCK, BLOCK_BYTES = 20_000, 2_000_000, 64, 8 << 20
#: Bytes to terms: A-Z become a-z, other ASCII characters but letters and digits become blanks.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: bytes | None) -> list[bytes]:
    return text.translate(FOLD).split() if text else []


def counted(docs: DataFrame, places: dict[bytes, int]) -> DataFrame:
    """doc_id, n (all terms), terms (places of those in ``places``), counts of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(places)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = shared.value.get
        for batch in batches:
            n, terms, counts = [], [], []
            for text in batch.column("text").cast(pa.binary()):
                words = terms_of(text.as_py())
                here = np.fromiter(map(place, words, repeat(-1)), np.int32, len(words))
                found, times = np.unique(here[here >= 0], return_counts=True)
                n.append(len(words))
                terms.append(found)
                counts.append(times.astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int64()))], names=["doc_id", "n", "terms", "counts"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n bigint, terms array<int>, counts array<bigint>")


class Shard:
    """Impact-sorted lists of some documents."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray, of: np.ndarray, terms: np.ndarray, counts: np.ndarray, weights: np.ndarray, n_docs: int, n_terms: int) -> None:
        self.ids = ids
        m = 100 - 50 + (50 * lengths * n_docs) // n_terms
        impact = weights[terms] * ((1_000_000_000 * counts) // (1000 * counts + 20 * m[of]))
        order = np.lexsort((of, -impact, terms))
        self.docs, self.impacts = of[order], impact[order]
        self.start = np.concatenate([[0], np.cumsum(np.bincount(terms, minlength=len(weights)))])

    def best(self, terms: list[int], k: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents (their places) and exact scores of the k best with a score above 0, ties by the id."""
        lists = [(self.start[t], self.start[t + 1]) for t in terms if self.start[t + 1] > self.start[t] and self.impacts[self.start[t]] > 0]
        n = len(self.ids)
        lower, met = np.zeros(n, np.int64), np.zeros((len(lists), n), bool)
        at, ceiling = [a for a, _ in lists], np.array([self.impacts[a] for a, _ in lists], np.int64)
        block, left = FIRST_BLOCK, np.empty(0, np.int64)
        entering = True
        while lists:
            for i, (_, end) in enumerate(lists):
                stop = min(at[i] + block, end)
                if stop > at[i]:
                    docs = self.docs[at[i]:stop]
                    lower[docs] += self.impacts[at[i]:stop]
                    met[i, docs] = True
                    at[i] = stop
                    ceiling[i] = self.impacts[stop - 1] if stop < end else 0
            block *= 2
            if entering:
                left = np.flatnonzero(lower)
            scores = lower[left]
            least = np.partition(scores, len(scores) - k)[len(scores) - k] if len(scores) >= k else 0
            if entering and ceiling.sum() < max(least, 1):
                entering = False  # what has not been met stays out
            upper = scores + ceiling.sum() - ceiling @ met[:, left]
            if not entering:
                stays = upper >= least
                left, scores, upper = left[stays], scores[stays], upper[stays]
                if (upper == scores).all():
                    break
        scores = lower[left]
        order = np.lexsort((self.ids[left], -scores))[:k]
        return left[order], scores[order]


def ranked(docs: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the k best documents of every item."""
    spark = docs.sparkSession
    ready(spark)
    asked = items.where("text IS NOT NULL").select(F.col("item_id").cast("bigint").alias("item_id"), "text")
    blocks = max(1, -(-(asked.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0) // BLOCK_BYTES))
    found = None
    for b in range(blocks):
        part = _block(docs, asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect(), k)
        part = part if blocks == 1 else pin(part)
        found = part if found is None else found.unionByName(part)
    return found


def _block(docs: DataFrame, rows: list, k: int) -> DataFrame:
    spark = docs.sparkSession
    schema = "item bigint, doc_id bigint, score bigint"
    item_ids = [r["item_id"] for r in rows]
    items = [list(dict.fromkeys(terms_of(r["text"].encode()))) for r in rows]
    places = {t: i for i, t in enumerate(dict.fromkeys(t for terms in items for t in terms))}
    queries = [[places[t] for t in terms] for terms in items]
    names = spark.createDataFrame(list(enumerate(item_ids)), "item bigint, item_id bigint")
    counts = pin(counted(docs, places)) if places else None
    n_docs, n_terms = counts.where("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first() if counts else (0, 0)
    if n_docs:
        df = np.zeros(len(places), np.int64)
        for t, n in counts.select(F.explode("terms").alias("t")).groupBy("t").count().collect():
            df[t] = n
        weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in df], np.int64)
        shared = spark.sparkContext.broadcast((queries, weights))

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            asked, weight = shared.value

            def settled(held: list[pa.RecordBatch]) -> pa.RecordBatch:
                table = pa.Table.from_batches(held).combine_chunks()
                ids = table.column("doc_id").combine_chunks()
                key = ids.fill_null(2**63 - 1).to_numpy()
                terms, times = table.column("terms").combine_chunks(), table.column("counts").combine_chunks()
                of = np.repeat(np.arange(len(key)), np.diff(terms.offsets.to_numpy()))
                shard = Shard(key, table.column("n").to_numpy(), of, terms.flatten().to_numpy(), times.flatten().to_numpy(), weight, n_docs, n_terms)
                best = [shard.best(q, k) for q in asked]
                at = np.concatenate([d for d, _ in best]).astype(np.int64)
                return pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(asked)), [len(d) for d, _ in best]), pa.int64()), ids.take(pa.array(at)),
                                                   pa.array(np.concatenate([s for _, s in best]), pa.int64())], names=["item", "doc_id", "score"])

            held, docs_, postings = [], 0, 0
            for batch in batches:
                if not batch.num_rows:
                    continue
                here = len(batch.column("terms").flatten())
                if held and (docs_ + batch.num_rows > SHARD_DOCS or postings + here > SHARD_POSTINGS):
                    yield settled(held)
                    held, docs_, postings = [], 0, 0
                held, docs_, postings = [*held, batch], docs_ + batch.num_rows, postings + here
            if held:
                yield settled(held)

        found = counts.where(F.size("terms") > 0).mapInArrow(search, schema)
    else:
        found = spark.createDataFrame([], schema)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return found.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
