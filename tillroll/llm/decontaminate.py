"""Benchmark decontamination: size-partitioned MinHash containment search, then exact shingle containment.

Shingles are five consecutive words (lower-cased runs of letters and digits); a shorter text is one shingle. An item is found in a
document if at least ``percent`` of the item's distinct shingles occur in it. With ``short_inside`` an item of one to four words is also found where its
words stand in a row inside a document, else only in a document that is the same sequence.

MinHash side: an item of q shingles needs ceil(percent * q) of them, so any document that holds the item has one of the q - need + 1
shingles that come first under one random order (a hash). That bottom sketch is all that is searched; its length follows from the item's size,
and items are partitioned by the power of two of their size. A document too small for all items of a partition is not searched in it. The search
loses nothing; candidates are verified on the shingles themselves.

Null text counts as empty; an item or document without words is never found. Repeated rows of a table count once. Texts of any length are searched whole; extra columns are
left aside, or kept by ``without_items``. Empty tables give no finds. Only DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.llm.common import let, small_enough
from tillroll.session import pin

N = 5


def _words(text: str) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), "[^\\p{L}\\p{N}]+"), lambda w: w != "")


def _runs(words: Column, size: int, name) -> Column:
    return F.transform(F.slice(words, 1, F.greatest(F.size(words) - (size - 1), F.lit(0))), lambda w, i: name(w, *(F.get(words, i + k) for k in range(1, size))))


def _windows(words: Column, name, short: list[int]) -> Column:
    """Windows of five words (the whole of a shorter text) and those of the sizes in ``short``."""
    whole = F.when(F.size(words) >= N, _runs(words, N, name)).when(F.size(words) > 0, F.array(name(F.array_join(words, " "))))
    return F.concat(whole, *(_runs(words, k, lambda *x: name(F.concat_ws(" ", *x))) for k in short)) if short else whole


def _hashes(text: str, short: list[int]) -> Column:
    return let(_words(text), lambda w: _windows(w, F.xxhash64, short))


def _strings(text: str, short: list[int]) -> Column:
    return F.array_distinct(let(_words(text), lambda w: _windows(w, lambda *x: F.concat_ws(" ", *x), short)))


def find_items(docs: DataFrame, items: DataFrame, percent: int = 80, short_inside: bool = True) -> DataFrame:
    """(doc_id, row, item_id, n_item_shingles, n_found) for every document and item of which at least ``percent`` is in it.

    ``row`` is a hash of id and text that tells rows with one id apart.
    """
    row = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit("")))
    docs = docs.select("doc_id", "text", row.alias("row"))
    tests = items.select("item_id", _strings("text", []).alias("item")).where(F.size("item") > 0).dropDuplicates()
    tests = tests.withColumn("n_item_shingles", F.size("item").cast("bigint")).withColumn("need", F.ceil(F.col("n_item_shingles") * percent / 100).cast("bigint"))
    tests = pin(tests.withColumn("part", F.floor(F.log2("n_item_shingles")).cast("int")))
    # Sizes of the items below five words: four at most.
    in_words = F.size(F.split(F.get("item", F.lit(0)), " "))
    short = sorted(r[0] for r in tests.where(in_words < N).select(in_words).distinct().collect()) if short_inside else []
    # The hash that a document's window has: of its five words, or of the whole short text.
    hashed = F.transform("item", lambda s: F.when(F.size(F.split(s, " ")) == N, F.xxhash64(*(F.get(F.split(s, " "), F.lit(k)) for k in range(N)))).otherwise(F.xxhash64(s)))
    bottom = F.slice(F.sort_array(hashed), 1, (F.col("n_item_shingles") - F.col("need") + 1).cast("int"))
    # An item's text is a row of the table, but the sketch is what grows: it is counted before it is broadcast.
    least = tests.groupBy("part").agg(F.min("need").alias("least"))
    sketch = pin(tests.select("part", F.explode(bottom).alias("h")).distinct().join(least, "part"))
    hits = docs.select("row", "doc_id", _hashes("text", short).alias("hs")).where(F.size("hs") > 0).select("row", F.size("hs").alias("n"), F.explode("hs").alias("h"))
    hits = hits.join(small_enough(sketch), "h").where("n >= least").select("row", "part", "h").distinct()
    by_hash = pin(tests.select("part", "item_id", F.explode(F.array_distinct(bottom)).alias("h")))
    pairs = pin(hits.join(small_enough(by_hash), ["part", "h"]).select("row", "item_id").distinct())
    found = docs.join(small_enough(pairs.select("row").distinct()), "row").select("doc_id", "row", _strings("text", short).alias("doc")).dropDuplicates(["doc_id", "row"])
    found = found.join(pairs, "row").join(small_enough(tests.select("item_id", "item", "n_item_shingles", "need"), 20_000), "item_id")
    found = found.withColumn("n_found", F.size(F.array_intersect("doc", "item")).cast("bigint")).where("n_found >= need")
    return found.select("doc_id", "row", "item_id", "n_item_shingles", "n_found")


def without_items(docs: DataFrame, items: DataFrame, percent: int = 80) -> DataFrame:
    """``docs`` without the rows in which an item was found; all columns stay. Items below five words take only documents that are the same
    sequence: a one-word item would take every document that uses the word."""
    row = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit("")))
    bad = pin(find_items(docs, items, percent, short_inside=False).select(F.col("row").alias("_bad")).distinct())
    return docs.withColumn("_row", row).join(small_enough(bad), F.col("_row") == F.col("_bad"), "left_anti").drop("_row")
