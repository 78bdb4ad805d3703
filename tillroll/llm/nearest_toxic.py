"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over block-max inverted indexes.

Fitting, on a sample of at most about ``sample`` labelled documents (all of them if there are fewer; the bound is what is broadcast): Spark
counts, for every term (word, and first four and five letters of a longer word), the labelled documents that hold it by label. All terms of the sample stay, however few documents
hold them. A term's weight is its idf times ``floor`` plus its evidence: the exponent of Chernoff's bound for the chance that its documents bear the label so often, 0 if they bear it
no more often than all do, as a share of the largest. So there is no edge that a term falls over, at any share of the label and any size of the table. Near copies count as one example.
Examples become vectors of unit length. They are dealt into ``PARTS`` parts of alike ones and, in that order, into blocks of ``BLOCK``. For the ``HEADS`` terms of the largest weight each block knows
the largest weight in it, for the other terms the largest norm.

Scoring a text: the ``COMMON`` commonest terms of a part stand in a dense table, all other postings in inverted lists. What the tables give is a lower bound of each cosine, the k-th largest one of
the k-th cosine. The bound of a block is the product of the text's weights with the block's largest weights, and of the norms of the rest (Cauchy-Schwarz). If only a few blocks reach the k-th they are
opened from the largest bound down. Else the lists are summed up for all examples within ``SLACK``, and for those that may be among the nearest the
table's part is summed again in double precision. Examples are kept in single precision; the k nearest of them are exact (ties by the smaller example id). They
vote with weight cos / (1.05 - cos). Votes are calibrated by an isotonic curve fitted on the examples, each scored without itself. A text without any of the
words (an empty or null text too) gets the share of toxic ones among such examples, or among all if there is none.

Without a labelled example of either kind every text gets the share of the label (0 without labels). Repeated rows are scored one by one.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.llm.common import arrow_rows, labelled_sample, release
from tillroll.session import pin

BLOCK = 64
HEADS = 512
#: Parts of alike examples, and commonest terms of a part that stand in a table.
PARTS, COMMON = 5, 1024
#: Blocks that are opened one by one, else all lists are read; error of a cosine in single precision; texts whose common terms are multiplied at once; words a worker remembers.
FEW, SLACK, AT_ONCE, REMEMBERED = 12, 1e-5, 256, 500_000
#: Different words of texts whose vectors are made together (a longer text is made alone).
WORDS_AT_ONCE = 200_000
find_words = re.compile(r"\w+").findall


def terms_in(text: str) -> Counter:
    """Counts of the terms of a text: lower-cased words, and ``abcd~`` and ``abcde~`` for how longer ones begin."""
    out: Counter = Counter()
    for w, n in Counter(find_words(text.lower())).items():
        for t in terms_of_word(w):
            out[t] += n
    return out


def terms_of_word(w: str) -> tuple[str, ...]:
    return (w, w[:4] + "~", w[:5] + "~") if len(w) > 5 else (w, w[:4] + "~") if len(w) == 5 else (w,)


class ToxicIndex:
    """The fitted examples; small (bounded by the sample), sent to the tasks with the function that uses it."""

    def __init__(self, words: list[str] | np.ndarray, idf: np.ndarray, ids: list[int], rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, k: int, base: float) -> None:
        """``words`` or their 64-bit names; ``rows`` hold places of words and 1 + log(count), which become vectors of unit length."""
        self.names = names_of(words) if isinstance(words, list) else words
        self.idf, self.ids, self.labels, self.k, self.base = idf, np.array(ids, np.int64), labels, k, base
        self.start = np.concatenate([[0], np.cumsum([len(t) for t, _ in rows])]).astype(np.int64)
        self.terms = np.concatenate([t.astype(np.int32) for t, _ in rows]) if rows else np.empty(0, np.int32)
        self.values = np.concatenate([v for _, v in rows]) if rows else np.empty(0, np.float32)
        self.scale = np.array([1 / np.sqrt(((v * idf[t]) ** 2).sum()) for t, v in rows])
        self.curve: tuple[list[float], list[float]] = ([0.0, 1.0], [0.0, 1.0])
        self.built, self.sent = False, None

    def build(self) -> None:
        """What is derived from the examples: made where it is used, so that it isn't sent."""
        if self.built:
            return
        n, n_words = len(self.ids), len(self.names)
        self.place = np.argsort(self.names, kind="stable").astype(np.int32)
        self.sorted = self.names[self.place]
        of = np.repeat(np.arange(n, dtype=np.int32), np.diff(self.start))
        weights = (self.values * self.idf[self.terms] * self.scale[of]).astype(np.float32)
        self.weights = weights
        part = self._alike(of, weights)
        self.order = np.argsort(part, kind="stable")  # examples that are alike lie in the same blocks
        spot = np.empty(n, np.int32)
        spot[self.order] = np.arange(n)
        of = spot[of]
        self.head = self._places(np.argsort(-self.idf, kind="stable"), n_words, HEADS)
        n_blocks = -(-n // BLOCK)
        self.block_max = np.zeros((min(HEADS, n_words), n_blocks))
        at = np.flatnonzero(self.head[self.terms] >= 0)
        np.maximum.at(self.block_max, (self.head[self.terms[at]], of[at] // BLOCK), weights[at])
        rest = np.sqrt(np.bincount(of, np.where(self.head[self.terms] < 0, weights, 0) ** 2, n))
        self.rest_max = np.array([rest[b * BLOCK:(b + 1) * BLOCK].max() for b in range(n_blocks)])
        ends = np.searchsorted(part[self.order], np.arange(PARTS + 1))
        self.parts, rare = [], np.ones(len(of), bool)
        for lo, hi in zip(ends.tolist(), ends[1:].tolist()):
            if hi > lo:
                at = np.flatnonzero((of >= lo) & (of < hi))
                terms = self.terms[at]
                common = self._places(np.argsort(-np.bincount(terms, minlength=n_words), kind="stable"), n_words, COMMON)
                at, terms = at[common[terms] >= 0], terms[common[terms] >= 0]
                table = np.zeros((hi - lo, min(COMMON, n_words)), np.float32)
                table[of[at] - lo, common[terms]] = weights[at]
                rare[at] = False
                self.parts.append((lo, hi, common, table))
        rare = np.flatnonzero(rare)
        rare = rare[np.argsort(self.terms[rare], kind="stable")]
        self.list_start = np.concatenate([[0], np.cumsum(np.bincount(self.terms[rare], minlength=n_words))])
        self.list_of, self.list_weight = of[rare], weights[rare]
        self.buffer, self.built = np.zeros(n_words), True
        # Words a worker remembers: the place of each in ``n_of_word``, which bounds the places of its terms in ``of_word``.
        self.known, self.of_word, self.n_of_word = {}, np.empty(0, np.int32), np.zeros(1, np.int64)
        self.heads = {"": -1}  # places of the beginnings met so far, by the beginning; a word without one has ""

    def _alike(self, of: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """The part of every example: rounds of nearest centres over the commonest terms, from centres far apart. It decides on speed only."""
        n = len(self.ids)
        if not n:
            return np.empty(0, np.int64)
        common = self._places(np.argsort(-np.bincount(self.terms, minlength=len(self.names)), kind="stable"), len(self.names), HEADS)
        table = np.zeros((n, HEADS), np.float32)
        at = np.flatnonzero(common[self.terms] >= 0)
        table[of[at], common[self.terms[at]]] = weights[at]
        table /= np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1e-9)
        seeds = table[:: max(1, n // 500)]
        centres = seeds[:1]
        while len(centres) < PARTS:
            centres = np.concatenate([centres, seeds[[np.argmin((seeds @ centres.T).max(axis=1))]]])
        for _ in range(5):
            part = np.argmax(table @ centres.T, axis=1)
            for c in range(PARTS):
                if (part == c).any():
                    mean = table[part == c].mean(axis=0)
                    centres[c] = mean / max(np.linalg.norm(mean), 1e-9)
        return part

    @staticmethod
    def _places(order: np.ndarray, n: int, most: int) -> np.ndarray:
        out = np.full(n, -1, np.int16)
        out[order[:most]] = np.arange(min(most, n))
        return out

    def __getstate__(self) -> bytes:
        sent = {x: getattr(self, x) for x in ("names", "idf", "ids", "labels", "k", "base", "start", "values", "scale", "curve")}
        return zlib.compress(pickle.dumps(sent | {"steps": np.diff(self.terms, prepend=np.int32(0))}, protocol=5), 1)

    def __setstate__(self, state: bytes) -> None:
        self.__dict__ = pickle.loads(zlib.decompress(state)) | {"built": False, "sent": None}
        self.terms = np.cumsum(self.__dict__.pop("steps"), dtype=np.int32)

    def learn_words(self, words: list[str]) -> None:
        """Remembers the places of the terms of words not met before; all at once, since names are made by the batch."""
        if len(self.known) + len(words) > REMEMBERED:
            self.known.clear()
            self.heads = {"": -1}
            self.of_word, self.n_of_word = np.empty(0, np.int32), np.zeros(1, np.int64)
        four = [w[:4] if len(w) > 4 else "" for w in words]
        five = [w[:5] if len(w) > 5 else "" for w in words]
        fresh = list(set(four).union(five) - self.heads.keys())
        self.heads.update(zip(fresh, self.places_of([h + "~" for h in fresh]).tolist()))
        n, head = len(words), self.heads.__getitem__
        places = np.empty((n, 3), np.int32)
        places[:, 0] = self.places_of(words)
        places[:, 1] = np.fromiter(map(head, four), np.int32, n)
        places[:, 2] = np.fromiter(map(head, five), np.int32, n)
        found = places >= 0
        first = len(self.known)
        self.known.update(zip(words, range(first, first + n)))
        self.of_word = np.concatenate([self.of_word, places[found]])
        self.n_of_word = np.concatenate([self.n_of_word, self.n_of_word[-1] + np.cumsum(found.sum(axis=1))])

    def places_of(self, terms: list[str]) -> np.ndarray:
        """The places of terms, -1 for unknown ones."""
        if not terms:
            return np.empty(0, np.int32)
        names = names_of(terms)
        at = np.minimum(np.searchsorted(self.sorted, names), len(self.sorted) - 1)
        return np.where(self.sorted[at] == names, self.place[at], np.int32(-1))

    def vectors(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        if not len(self.names):
            return [(np.empty(0, np.int64), np.empty(0))] * len(texts)
        self.build()
        counted = [Counter(find_words(t.lower())) for t in texts]
        fresh = set().union(*counted) - self.known.keys()
        if fresh:
            if len(self.known) + len(fresh) > REMEMBERED:
                fresh = set().union(*counted)
            self.learn_words(list(fresh))
        out, begin, n = [], 0, 0
        for end, found in enumerate(counted, 1):
            n += len(found)
            if n >= WORDS_AT_ONCE or end == len(counted):
                out += self._unit_rows(counted[begin:end], n)
                begin, n = end, 0
        return out

    def _unit_rows(self, counted: list[Counter], n: int) -> list[tuple[np.ndarray, np.ndarray]]:
        words = np.fromiter(map(self.known.__getitem__, chain.from_iterable(counted)), np.int64, n)
        counts = np.fromiter(chain.from_iterable(map(Counter.values, counted)), np.float64, n)
        of = np.arange(len(counted)).repeat([len(c) for c in counted])
        first = self.n_of_word[words]
        size = self.n_of_word[words + 1] - first
        ends = size.cumsum()
        terms = self.of_word[np.arange(int(ends[-1]) if n else 0) + (first - (ends - size)).repeat(size)]
        keys, back = np.unique(of.repeat(size) * len(self.names) + terms, return_inverse=True)
        of, terms = np.divmod(keys, len(self.names))
        w = (1 + np.log(np.bincount(back, counts.repeat(size), len(keys)))) * self.idf[terms]
        w /= np.sqrt(np.bincount(of, w * w, len(counted)))[of]
        cuts = np.searchsorted(of, np.arange(1, len(counted)))
        return list(zip(np.split(terms, cuts), np.split(w, cuts)))

    def vector(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        return self.vectors([text])[0]

    def exact(self, at: np.ndarray, query: np.ndarray) -> np.ndarray:
        """Cosines of the examples at these positions; ``query`` holds the text's weights."""
        first = self.start[at]
        size = self.start[at + 1] - first
        before = size.cumsum() - size
        pick = np.arange(size.sum()) + (first - before).repeat(size)
        return np.add.reduceat(query[self.terms[pick]] * self.weights[pick], before)

    def exact_rest(self, spots: np.ndarray, terms: np.ndarray, weights: np.ndarray, listed: np.ndarray) -> np.ndarray:
        """The same for places in the order of the parts, where the sums over the lists are known: the tables' rows in double precision."""
        out = listed[spots]
        for lo, hi, common, table in self.parts:
            here = ((spots >= lo) & (spots < hi)).nonzero()[0]
            if len(here):
                place = common[terms]
                known = (place >= 0).nonzero()[0]
                out[here] += weights[known] @ table[(spots[here] - lo)[:, None], place[known]].astype(np.float64).T
        return out

    def common_part(self, vectors: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """For every vector the products with all examples over the common terms of their part."""
        self.build()
        out = np.empty((len(vectors), len(self.ids)), np.float32)
        sizes = [len(terms) for terms, _ in vectors]
        terms, weights = np.concatenate([t for t, _ in vectors]), np.concatenate([w for _, w in vectors]).astype(np.float32)
        of = np.repeat(np.arange(len(vectors)), sizes)
        for lo, hi, common, table in self.parts:
            place = common[terms]
            known = (place >= 0).nonzero()[0]
            q = np.zeros((len(vectors), table.shape[1]), np.float32)
            q[of[known], place[known]] = weights[known]
            out[:, lo:hi] = q @ table.T
        return out

    def listed(self, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """What the inverted lists add: the terms that are not common in an example's part."""
        first = self.list_start[terms]
        size = self.list_start[terms + 1] - first
        ends = size.cumsum()
        pick = np.arange(ends[-1]) + (first - (ends - size)).repeat(size)
        return np.bincount(self.list_of[pick], self.list_weight[pick] * weights.repeat(size), len(self.ids)).astype(np.float64, copy=False)  # whole numbers if nothing is listed

    def nearest(self, terms: np.ndarray, weights: np.ndarray, leave: int = -1, common: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Positions and cosines of the k nearest examples with a positive cosine, the nearest first; ``common`` is the row of ``common_part`` if that is known."""
        self.build()
        place = self.head[terms]
        known = place >= 0
        bounds = weights[known] @ self.block_max[place[known]] + np.sqrt((weights[~known] ** 2).sum()) * self.rest_max
        query = self.buffer
        query[terms] = weights
        at, cos, n = np.empty(0, np.int64), np.empty(0), len(self.ids)

        def add(new: np.ndarray, got: np.ndarray) -> None:
            nonlocal at, cos
            new, got = new[new != leave], got[new != leave]
            if len(new):
                at, cos = np.concatenate([at, new[got > 0]]), np.concatenate([cos, got[got > 0]])
                best = np.lexsort((self.ids[at], -np.round(cos, 12)))[: self.k]
                at, cos = at[best], cos[best]

        # What the tables give is a lower bound of every cosine, the k-th of these one of the k-th cosine: blocks that cannot reach it stay closed.
        near = self.common_part([(terms, weights)])[0] if common is None else common
        if leave >= 0:
            near[self.order == leave] = 0
        least = max(np.partition(near, n - self.k)[n - self.k] - SLACK, 0.0) if n > self.k else 0.0
        open_ = ((bounds >= least - SLACK) & (bounds > 0)).nonzero()[0]
        if len(open_) <= FEW:
            for b in open_[np.argsort(-bounds[open_], kind="stable")].tolist():
                if len(at) >= self.k and bounds[b] < cos[self.k - 1] - 1e-6:
                    break
                block = self.order[b * BLOCK:(b + 1) * BLOCK]
                add(block, self.exact(block, query))
        else:
            listed = self.listed(terms, weights)
            near += listed
            if leave >= 0:
                near[self.order == leave] = 0
            if n > self.k:
                least = max(least, np.partition(near, n - self.k)[n - self.k] - SLACK)
            spots = (near >= max(least - SLACK, 1e-300)).nonzero()[0]
            add(self.order[spots], self.exact_rest(spots, terms, weights, listed))
        query[terms] = 0
        return at, np.minimum(cos, 1.0)

    def vote(self, at: np.ndarray, cos: np.ndarray) -> float:
        w = cos / (1.05 - cos)
        return float((w * self.labels[at]).sum() / w.sum())

    def score(self, text: str) -> tuple[float, list[int], list[float]]:
        return next(self.scores([text]))

    def scores(self, texts: Iterable[str], curve: tuple[list[float], list[float]] | None = None) -> Iterator[tuple[float, list[int], list[float]]]:
        texts, curve = list(texts), curve or self.curve
        for i in range(0, len(texts), AT_ONCE):
            vectors = self.vectors(texts[i:i + AT_ONCE])
            for (terms, weights), common in zip(vectors, self.common_part(vectors)):
                at, cos = self.nearest(terms, weights, common=common) if len(terms) else ([], [])
                yield (float(np.interp(self.vote(at, cos), *curve)), self.ids[at].tolist(), cos.round(6).tolist()) if len(at) else (self.base, [], [])

    def row(self, e: int) -> tuple[np.ndarray, np.ndarray]:
        here = slice(self.start[e], self.start[e + 1])
        terms = self.terms[here].astype(np.int64)
        return terms, self.values[here] * self.idf[terms] * self.scale[e]

    def broadcast(self, spark: SparkSession):
        """Sent once; the curve travels with the functions."""
        if self.sent is None:
            self.sent = spark.sparkContext.broadcast(self)
        return self.sent

    def calibrate(self, spark: SparkSession) -> None:
        """Isotonic regression of the label on the vote without the example itself (adjacent violators pooled)."""
        shared = self.broadcast(spark)

        def votes_of(batch: pa.RecordBatch) -> dict:
            index, votes, rows = shared.value, [], batch.column("id").to_pylist()
            for i in range(0, len(rows), AT_ONCE):
                vectors = [index.row(e) for e in rows[i:i + AT_ONCE]]
                for e, (terms, weights), common in zip(rows[i:i + AT_ONCE], vectors, index.common_part(vectors)):
                    at, cos = index.nearest(terms, weights, e, common)
                    votes.append(index.vote(at, cos) if len(at) else None)
            return {"id": batch.column("id"), "vote": pa.array(votes, pa.float64())}

        n = len(self.ids)
        votes = [(r["vote"], float(self.labels[r["id"]])) for r in arrow_rows(spark.range(0, n, 1, max(1, n // 500)), votes_of, "id bigint, vote double").collect() if r["vote"] is not None]
        pools: list[list[float]] = []
        for v, y in sorted(votes):
            pools.append([v, y, 1.0])
            while len(pools) > 1 and pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]:
                a = pools.pop()
                pools[-1] = [pools[-1][0] + a[0], pools[-1][1] + a[1], pools[-1][2] + a[2]]
        if len(pools) > 1:
            self.curve = ([p[0] / p[2] for p in pools], [p[1] / p[2] for p in pools])


def unit(terms: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(terms):
        return terms, counts
    w = (1 + np.log(counts)) * idf[terms]
    return terms, w / np.sqrt((w * w).sum())


def fit(docs: DataFrame, labels: DataFrame, learn: Column, label: str = "toxic", sample: int = 4_000, k: int = 15, floor: float = 0.01) -> ToxicIndex:
    """Index of the examples in a sample of at most about ``sample`` labelled documents, over all their terms."""
    rows = labelled_sample(docs, labels, label, learn, sample)
    counted = arrow_rows(rows.select("doc_id", "text", "label"), _counts, "doc_id bigint, label int, kin bigint, terms array<bigint>, counts array<int>")
    # Copies of one text are one example, else its words would pass for signs of the label.
    counted = pin(counted.groupBy("label", "kin").agg(F.min_by(F.struct("doc_id", "terms", "counts"), "doc_id").alias("e")).select("e.doc_id", "label", "e.terms", "e.counts"))
    release(counted)
    totals = {r["label"]: r["n"] for r in counted.groupBy("label").agg(F.count("*").alias("n")).collect()}
    one, zero = sum(n for y, n in totals.items() if y), totals.get(0, 0)
    if not one or not zero:
        return ToxicIndex([], np.empty(0), [], [], np.empty(0), k, 1.0 if one else 0.0)
    of_word = counted.select("label", F.explode("terms").alias("word")).groupBy("word").agg(F.count("*").cast("int").alias("df"), F.sum(F.when(F.col("label") != 0, 1).otherwise(0)).cast("int").alias("a"))
    found = of_word.toArrow()
    names, df, share = found.column("word").to_numpy(), found.column("df").to_numpy(), found.column("a").to_numpy() / found.column("df").to_numpy()
    del found
    order = np.argsort(names)
    names, df, share = names[order], df[order], share[order]
    weight = (np.log((1 + one + zero) / (1 + df)) + 1) * (floor + evidence(df, share, one / (one + zero)))
    # Common terms get small numbers: what a text looks up lies close together.
    by_df = np.argsort(-df, kind="stable")
    number = np.empty(len(df), np.int32)
    number[by_df] = np.arange(len(df))
    examples = counted.toArrow()
    y, ids_ = examples.column("label").to_pylist(), examples.column("doc_id").to_pylist()
    terms, counts = examples.column("terms"), examples.column("counts")
    vectors, ids, labels_, bare = [], [], [], [0, 0]
    # Examples of one label lie in the same blocks, so that bounds part them.
    for i in sorted(range(examples.num_rows), key=lambda i: (y[i] == 0, ids_[i])):
        at = number[np.searchsorted(names, terms[i].values.to_numpy())]
        if not len(at):
            bare[y[i] != 0] += 1
            continue
        order = np.argsort(at)
        vectors.append((at[order], (1 + np.log(counts[i].values.to_numpy()[order])).astype(np.float32)))
        ids.append(ids_[i])
        labels_.append(float(y[i] != 0))
    del terms, counts, examples
    index = ToxicIndex(names[by_df], weight[by_df], ids, vectors, np.array(labels_), k, bare[1] / sum(bare) if sum(bare) else one / (one + zero))
    del vectors
    index.calibrate(docs.sparkSession)
    return index


def evidence(df: np.ndarray, share: np.ndarray, base: float) -> np.ndarray:
    """For each term, as a share of the largest: how improbable it is that its documents bear the label so often by chance; 0 up to the share ``base`` of all."""
    with np.errstate(divide="ignore", invalid="ignore"):
        exponent = np.where(share > 0, share * np.log(share / base), 0.0) + np.where(share < 1, (1 - share) * np.log((1 - share) / (1 - base)), 0.0)
    out = np.where(share > base, df * exponent, 0.0)
    return out / max(out.max(), 1e-300)


def kin_of(counts: Counter) -> int:
    """The same for most pairs of near copies: two min-hashes over the long words. Other texts that share two least words get the same kin too and are then one example."""
    h = pd.util.hash_array(np.array([t for t in counts if len(t) > 5 and t[-1] != "~"] or list(counts) or [""], dtype=object), categorize=False)
    return int((h.min(keepdims=True) ^ (h * np.uint64(0x9E3779B97F4A7C15)).min(keepdims=True) * np.uint64(0xBF58476D1CE4E5B9)).view(np.int64)[0])


def names_of(words: list[str]) -> np.ndarray:
    return pd.util.hash_array(np.array(words, dtype=object), categorize=False).view(np.int64)


def _counts(batch: pa.RecordBatch) -> dict:
    counts = [terms_in(t) for t in batch.column("text").to_pylist()]
    return {"doc_id": batch.column("doc_id"), "label": batch.column("label"), "kin": pa.array([kin_of(c) for c in counts], pa.int64()),
            "terms": pa.array([names_of(list(c)) for c in counts], pa.list_(pa.int64())), "counts": pa.array([list(c.values()) for c in counts], pa.list_(pa.int32()))}


def scored(docs: DataFrame, index: ToxicIndex) -> DataFrame:
    """doc_id, score, neighbours (ids of the voting examples, nearest first), cosines for every row."""
    shared, curve = index.broadcast(docs.sparkSession), index.curve

    def one(batch: pa.RecordBatch) -> dict:
        found = list(shared.value.scores((t or "" for t in batch.column("text").to_pylist()), curve))
        return {"doc_id": batch.column("doc_id"), "score": pa.array([f[0] for f in found], pa.float64()), "neighbours": pa.array([f[1] for f in found], pa.list_(pa.int64())), "cosines": pa.array([f[2] for f in found], pa.list_(pa.float64()))}

    return arrow_rows(docs.select("doc_id", "text"), one, "doc_id bigint, score double, neighbours array<bigint>, cosines array<double>")


def without_toxic(docs: DataFrame, index: ToxicIndex, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score below ``least``; all columns stay."""
    shared, curve = index.broadcast(docs.sparkSession), index.curve
    at = docs.columns.index("text")

    def run(batches):
        for b in batches:
            keep = pa.array([f[0] < least for f in shared.value.scores((t or "" for t in b.column(at).to_pylist()), curve)], pa.bool_())
            yield b.filter(keep)

    return docs.mapInArrow(run, docs.schema)
