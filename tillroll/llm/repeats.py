"""Substring deduplication by recompression.

Words of a document are symbols; each round pairs neighbours (a left symbol followed by a right one; a bit of the symbol's name tells the side) and names the pair by a
hash of its parts. A name depends on nothing but the words it stands for, so equal passages get equal interior symbols in every document, without a
dictionary to agree on. A run of one word never pairs with itself and stays a row of equal symbols, which needs no place to start from.
Two rounds are made: such a symbol has at most four words and follows from its words and three on either side. So each window of 13 words, wherever it stands, holds a symbol whose
making lies wholly inside it (the one over its middle word), and equal windows hold the same ones. The least of their names, taken over the words that
determine them (7 to 10 words), is the window's key; runs of windows share one.

1. Documents with the same text are one: all but the smallest id repeat it wholly.
2. Keys of all windows are dealt by name; those in two documents mark the stretches that may repeat.
3. Windows in marked stretches only are named by all their words and dealt by name: a window whose name starts in a document with a smaller id is a repeat.
   What one batch of documents can tell by itself about a key or name is settled there, and such rows are spread over all tasks, so a frequent passage makes no hot key.
4. The words of repeats are taken out of their documents.

Windows are compared as they are in the input. Names have 64 bits. Rows of a name stream past in order, so a passage shared by a third of all documents needs no memory. A row without doc_id
keeps its words and repeats nothing; null text has no words; rows with one id never repeat each other, whether their texts are equal or not.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.llm.common import SPACE, arrow_rows, give_back, release, small_enough, words_of
from tillroll.session import pin

WINDOW = 13
AROUND = 3
_gaps = re.compile(f"({SPACE})")


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Odd factors of the places in a name, from a rule.
PLACES = _mix(np.arange(1, 33, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def word_names(words: list[str]) -> np.ndarray:
    """64-bit names of words."""
    if not words:
        return np.empty(0, np.uint64)
    codes, distinct = pd.factorize(np.array(words, dtype=object))
    return _mix(pd.util.hash_array(distinct, categorize=False))[codes]


def recompress(names: np.ndarray, starts: np.ndarray, doc: np.ndarray, salt: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One round: names, first words and documents of the symbols after pairing."""
    if not len(names):
        return names, starts, doc
    right = (_mix(names + np.uint64(salt)) & np.uint64(1)).astype(bool)
    joined = np.zeros(len(names), bool)
    joined[:-1] = ~right[:-1] & right[1:] & (doc[:-1] == doc[1:])
    first = np.ones(len(names), bool)
    first[1:] = ~joined[:-1]
    at = np.flatnonzero(first)
    new = names[at].copy()
    two = joined[at]
    new[two] = _mix(names[at[two]] * PLACES[0] + names[at[two] + 1] * PLACES[1] + np.uint64(salt))
    return new, starts[at], doc[at]


def named(names: np.ndarray, at: np.ndarray, size: np.ndarray | int) -> np.ndarray:
    """Names of stretches of ``size`` words from ``at``."""
    total = np.zeros(len(at), np.uint64)
    most = int(size) if np.isscalar(size) else int(size.max(initial=0))
    for j in range(most):
        part = names[np.minimum(at + j, len(names) - 1)] * PLACES[j]
        total += part if np.isscalar(size) else np.where(j < size, part, np.uint64(0))
    return _mix(total + (np.uint64(size) if np.isscalar(size) else size.astype(np.uint64)))


def window_keys(names: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For documents of ``sizes`` words one after the other: key, document, first window and number of windows of every run of windows with one key."""
    none = np.empty(0, np.int64)
    begin = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    n = len(names)
    windows = np.flatnonzero(np.arange(n) + WINDOW <= (begin + sizes)[doc]) if n else none
    if not len(windows):
        return np.empty(0, np.uint64), none, none, none
    symbols, start, of = recompress(names, np.arange(n), doc, 1)
    symbols, start, of = recompress(symbols, start, of, 2)
    end = np.append(start[1:], n)
    # Names of what determines a symbol; at the edge of a document they are not needed, since no window reaches there.
    context = np.maximum(start - AROUND, 0)
    key = named(names, context, np.minimum(end + AROUND, n) - context)
    over = np.zeros(n, np.int64)
    over[start[1:]] = 1
    over = np.cumsum(over)  # the symbol over each word
    a = windows + AROUND
    first = over[a] + (start[over[a]] < a)
    z = windows + WINDOW - AROUND - 1
    last = over[z] - (end[over[z]] > z + 1)
    best = key[first]
    for k in range(1, WINDOW - 2 * AROUND):
        j = np.minimum(first + k, len(key) - 1)
        best = np.where((first + k <= last) & (key[j] < best), key[j], best)
    new = np.ones(len(windows), bool)
    new[1:] = (best[1:] != best[:-1]) | (doc[windows[1:]] != doc[windows[:-1]])
    runs = np.flatnonzero(new)
    return best[runs], doc[windows[runs]], windows[runs] - begin[doc[windows[runs]]], np.diff(np.append(runs, len(windows)))


def _texts(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    words, sizes = [], []
    for t in batch.column("text").to_pylist():
        w = words_of(t or "")
        words.extend(w)
        sizes.append(len(w))
    return word_names(words), np.array(sizes, np.int64)


def _spread(n: int, seed: int) -> np.ndarray:
    """Names without meaning for rows that need not meet others."""
    return _mix(np.arange(n, dtype=np.uint64) + np.uint64(seed & (1 << 62)))


def _groups(*sorted_: np.ndarray) -> np.ndarray:
    """Where the groups of equal values begin."""
    new = np.ones(len(sorted_[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in sorted_])
    return np.flatnonzero(new)


def _keys(batch: pa.RecordBatch) -> dict:
    """Rows of window keys. Of a key that two documents of the batch have, two rows go to meet others; the rest is settled, and spread over all tasks."""
    key, doc, lo, n = window_keys(*_texts(batch))
    order = np.lexsort((doc, key))
    edge = _groups(key[order])
    last = np.append(edge[1:], len(key))[: len(edge)] - 1
    shared = doc[order[edge]] != doc[order[last]]
    settled = np.zeros(len(key), bool)
    settled[order] = np.repeat(shared, last - edge + 1)
    settled[order[edge]] = settled[order[last]] = False
    key[settled] = _spread(int(settled.sum()), int(key[0]) if len(key) else 0)
    at = pa.array(doc)
    return {"key": pa.array(key.view(np.int64)), "doc_id": batch.column("doc_id").take(at), "variant": batch.column("variant").take(at), "lo": pa.array(lo.astype(np.int32)), "n": pa.array(n.astype(np.int32)), "settled": pa.array(settled)}


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows in order of key and doc_id those of keys that two documents have. Held back between batches: rows of one key in one document."""
    held: pa.Table | None = None
    hot = None  # a key known to be shared
    for batch in batches:
        t = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        key, doc = t.column("key").to_numpy(), t.column("doc_id").to_numpy()
        edge = _groups(key)
        last = np.append(edge[1:], len(key)) - 1
        shared = doc[edge] != doc[last]
        if hot is not None and key[0] == hot:
            shared[0] = True
        hot = key[-1] if shared[-1] else None
        keep = np.repeat(shared, last - edge + 1) | t.column("settled").to_numpy()
        held = None
        if not shared[-1]:
            held = t.slice(int(edge[-1]))
            keep[edge[-1]:] = False
        if keep.any():
            yield from t.filter(pa.array(keep)).select(["doc_id", "variant", "lo", "n"]).combine_chunks().to_batches()
    if held is not None:
        yield from held.filter(held.column("settled")).select(["doc_id", "variant", "lo", "n"]).combine_chunks().to_batches()


def _later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows in order of name and doc_id those behind the first document of their name."""
    name = owner = None
    for batch in batches:
        key, doc = batch.column("key").to_numpy(), batch.column("doc_id").to_numpy()
        edge = _groups(key)
        first = doc[edge]
        if name is not None and key[0] == name:
            first = first.copy()
            first[0] = owner
        name, owner = key[-1], first[-1]
        later = (doc > np.repeat(first, np.diff(np.append(edge, len(key))))) | batch.column("settled").to_numpy(zero_copy_only=False)
        if later.any():
            yield from pa.Table.from_batches([batch]).filter(pa.array(later)).select(["doc_id", "variant", "at", "more"]).combine_chunks().to_batches()


def _windows(batch: pa.RecordBatch) -> dict:
    """Rows of window names, one for a name in a document (further places in ``more``). Those behind a smaller document of the batch are settled."""
    names, sizes = _texts(batch)
    begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    at, doc = [], []
    for i, spans in enumerate(batch.column("spans").to_pylist()):
        marked = np.zeros(int(sizes[i]) + 1, np.int64)
        for s in spans:
            if s["lo"] + s["n"] <= sizes[i]:
                marked[s["lo"]] += 1
                marked[s["lo"] + s["n"]] -= 1
        found = np.flatnonzero(np.cumsum(marked)[:max(0, int(sizes[i]) - WINDOW + 1)])
        at.append(found)
        doc.append(np.full(len(found), i))
    at, doc = np.concatenate(at), np.concatenate(doc)
    name = named(names, at + begin[doc], WINDOW) if len(at) else np.empty(0, np.uint64)
    ids = batch.column("doc_id").to_numpy(zero_copy_only=False)[doc].astype(np.int64)
    order = np.lexsort((at, doc, ids, name))
    name, ids, doc, at = name[order], ids[order], doc[order], at[order]
    one = _groups(name, doc)
    stop = np.append(one[1:], len(name))[: len(one)]
    more: list[list[int] | None] = [None] * len(one)
    for g in np.flatnonzero(stop - one > 1).tolist():
        more[g] = at[one[g] + 1:stop[g]].tolist()
    name, ids, doc, at = name[one].copy(), ids[one], pa.array(doc[one]), at[one]
    edge = _groups(name)
    settled = ids > np.repeat(ids[edge], np.diff(np.append(edge, len(name))))
    name[settled] = _spread(int(settled.sum()), int(name[0]) if len(name) else 0)
    return {"key": pa.array(name.view(np.int64)), "doc_id": pa.array(ids), "variant": batch.column("variant").take(doc), "at": pa.array(at.astype(np.int32)), "more": pa.array(more, pa.list_(pa.int32())), "settled": pa.array(settled)}


def _digest() -> Column:
    return F.md5(F.coalesce("text", F.lit("")))


def _variant(rows: DataFrame, mixed: DataFrame | None) -> DataFrame:
    """``rows`` (doc_id, digest, ...) with variant: 0, or for an id that bears several texts a number of the text."""
    if mixed is None:
        return rows.withColumn("variant", F.lit(0).cast("bigint"))
    return rows.join(small_enough(mixed), "doc_id", "left").withColumn("variant", F.when(F.col("several"), F.xxhash64("digest")).otherwise(F.lit(0).cast("bigint"))).drop("several")


def repeats(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(digest, first): texts held by several rows and their smallest id; (doc_id, variant, places): starts of repeated windows, whole copies left out; (doc_id, several): ids with several texts, None without such. All written."""
    rows = docs.select("doc_id", "text", _digest().alias("digest")).where(F.col("doc_id").isNotNull())
    facts = pin(rows.select("doc_id", "digest"))
    copies = pin(facts.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("_last")).where("first < _last").select("digest", "first"))
    mixed = pin(facts.groupBy("doc_id").agg(F.min("digest").alias("_a"), F.max("digest").alias("_b")).where("_a < _b").select("doc_id", F.lit(True).alias("several")))
    mixed = None if mixed.isEmpty() else mixed
    own = rows.join(small_enough(copies), "digest", "left").where("first IS NULL OR doc_id = first")
    own = _variant(own, mixed).select("doc_id", "variant", "text")
    keys = arrow_rows(own, _keys, "key bigint, doc_id bigint, variant bigint, lo int, n int, settled boolean")
    marked = keys.repartition("key").sortWithinPartitions("key", "doc_id").mapInArrow(_shared, "doc_id bigint, variant bigint, lo int, n int")
    marked = pin(marked.groupBy("doc_id", "variant").agg(F.collect_list(F.struct("lo", "n")).alias("spans")))  # as many as a document has windows
    del keys
    release(docs)
    windows = arrow_rows(own.join(small_enough(marked.select("doc_id").distinct()), "doc_id", "left_semi").join(marked, ["doc_id", "variant"]), _windows, "key bigint, doc_id bigint, variant bigint, at int, more array<int>, settled boolean")
    later = windows.repartition("key").sortWithinPartitions("key", "doc_id").mapInArrow(_later, "doc_id bigint, variant bigint, at int, more array<int>")
    del windows
    later = pin(later.groupBy("doc_id", "variant").agg(F.concat(F.collect_list("at"), F.flatten(F.collect_list("more"))).alias("places")))
    release(docs)
    return copies, later, mixed


def _covered(n: int, places: list[int] | None, whole: bool) -> np.ndarray:
    """Which of ``n`` words are in a repeat."""
    if whole:
        return np.full(n, n >= WINDOW)
    marked = np.zeros(n + WINDOW + 1, np.int64)
    if places:
        p = np.array([x for x in places if x + WINDOW <= n], np.int64)
        np.add.at(marked, p, 1)
        np.add.at(marked, p + WINDOW, -1)
    return np.cumsum(marked)[:n] > 0


def _judged(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns of ``keep``, _text, _places and _whole (a copy of a row with a smaller id)."""
    copies, later, mixed = repeats(docs)
    rows = docs.select(*(F.col(c).alias(f"_kept_{c}") for c in keep), F.col("text").alias("_text"), "doc_id", _digest().alias("digest"))
    rows = _variant(rows, mixed).join(small_enough(copies), "digest", "left").join(later, ["doc_id", "variant"], "left")
    return rows.select(*(F.col(f"_kept_{c}").alias(c) for c in keep), "_text", F.col("places").alias("_places"), F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)).alias("_whole"))


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (kept words joined by one space) for every row."""
    def one(batch: pa.RecordBatch) -> dict:
        n, removed, sha = [], [], []
        for t, places, whole in zip(*(batch.column(c).to_pylist() for c in ("_text", "_places", "_whole"))):
            words = words_of(t or "")
            if whole or places:
                gone = _covered(len(words), places, whole)
                removed.append(int(gone.sum()))
                kept = [w for w, g in zip(words, gone.tolist()) if not g]
            else:
                removed.append(0)
                kept = words
            n.append(len(words))
            sha.append(hashlib.sha256(" ".join(kept).encode()).hexdigest())
        return {"doc_id": batch.column("doc_id"), "n_words": pa.array(n, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array(sha, pa.string())}

    return arrow_rows(_judged(docs, ["doc_id"]), one, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string")


def cut(text: str, gone: list[bool]) -> str:
    """``text`` without the words marked in ``gone``; gaps between kept neighbours stay, others become a line break if they held one, else a space."""
    out: list[str] = []
    gap, word, lost = "", 0, False
    for i, part in enumerate(_gaps.split(text)):
        if i % 2:
            gap = part if not lost and not gap else "\n" if "\n" in gap + part else " "
        elif part:
            if gone[word]:
                lost = True
            else:
                out.extend([gap if out or not lost else "", part])
                gap, lost = "", False
            word += 1
    return "".join(out) + (gap if not lost else "")


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with the repeated words taken out of text; rows and other columns stay."""
    names = docs.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            for t, places, whole in zip(*(b.column(c).to_pylist() for c in ("_text", "_places", "_whole"))):
                if whole or places:
                    gone = _covered(len(words_of(t or "")), places, whole).tolist()
                    t = cut(t or "", gone) if any(gone) else t
                texts.append(t)
            columns = [b.column(n) for n in names if n != "text"]
            columns.insert(at, pa.array(texts, pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=names)
        give_back()

    return _judged(docs, [n for n in names if n != "text"]).mapInArrow(run, docs.schema)
