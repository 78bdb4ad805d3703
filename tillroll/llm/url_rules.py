"""URL filter by association rules.

Given rules of (verdict, host, path) decide the URLs they fit: a rule fits its host and all subdomains if the path starts with the rule's path, the
longest wins. The URLs so decided are the labels from which FP-growth learns for the rest: each is a transaction of its
tokens (host labels, domain, path parts, query keys and values) and its verdict. Tokens that stand in the same labelled URLs, such as the parts of one template, are
one item, a class: every choice of members would give the same rule, so a URL holds a class if it holds a member, and no rule is lost. Rules that conclude the verdict with enough support and confidence are
pruned of those that a more general rule with as much confidence makes superfluous. A remaining rule is listed under its rarest token; a URL looks up its own
tokens in that inverted index and keeps the rules wholly inside it. The most confident rule decides (then the better supported, then ``block``); no rule: ``allow``.

Null URLs and those without ``://`` have empty host and path, no tokens, verdict ``allow``. Repeated rows are judged one by one. Work is done once per
distinct URL without a given rule; a URL held by many rows meets them in a join whose skewed side Spark splits. Very long URLs are taken whole. Empty
tables give empty results; other columns stay.
"""

from __future__ import annotations

import math
import string

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.llm.common import small_enough
from tillroll.session import pin

VERDICT = "verdict:"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)\\A.*?://([^/?#]*)", 1), string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)\\A.*?://[^/?#]*([^?#]*)", 1)


def tokens_of(url: Column) -> Column:
    """Distinct tokens of a URL; numbers in the path count as ``0``."""
    labels = F.filter(F.split(host_of(url), "\\."), lambda x: x != "")
    parts = F.filter(F.split(F.regexp_replace(F.lower(path_of(url)), "[0-9]+", "0"), "[/.]"), lambda x: x != "")
    pairs = F.filter(F.split(F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)\\A.*?://[^?#]*\\?([^#]*)", 1), "&"), lambda x: x != "")
    return F.array_distinct(F.concat(
        F.transform(labels, lambda x: F.concat(F.lit("host:"), x)),
        F.when(F.size(labels) >= 2, F.array(F.concat(F.lit("domain:"), F.array_join(F.slice(labels, -2, 2), ".")))).otherwise(F.array().cast("array<string>")),
        F.transform(parts, lambda x: F.concat(F.lit("path:"), x)),
        F.transform(pairs, lambda x: F.concat(F.lit("query:"), F.regexp_replace(x, "[0-9]+", "0")))))


def given_rule(rules: list[tuple[str, str, str]], host: Column, path: Column) -> Column:
    """Struct (rule, verdict) of the longest fitting rule, null if none fits."""
    fitting = [F.when(((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p)), F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))) for v, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))]
    return F.coalesce(*fitting)


def inside(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """Rows of ``sets`` (key, tokens) with each rule (key_token, antecedent, ...) whose antecedent they hold, by the inverted index."""
    looked_up = sets.select("key", "tokens", F.explode("tokens").alias("key_token")).join(small_enough(rules), "key_token")
    return looked_up.where(F.size(F.array_except("antecedent", "tokens")) == 0)


def classes(rows: DataFrame, min_support: float) -> DataFrame:
    """(token, cls) of the frequent tokens; tokens that stand in the same rows have one class, named by the first of them.

    There are at most (tokens of a URL) / ``min_support`` frequent tokens.
    """
    least = math.ceil(min_support * rows.count())
    sets = rows.groupBy("tokens").agg(F.count(F.lit(1)).alias("n")).select("n", F.xxhash64("tokens").alias("a"), F.xxhash64("tokens", F.lit(1)).alias("b"), F.explode("tokens").alias("token"))
    held = pin(sets.groupBy("token").agg(F.sum("n").alias("freq"), F.count(F.lit(1)).alias("sets"), F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b")).where(F.col("freq") >= least))
    same = ["freq", "sets", "a", "b"]
    return pin(held.join(held.groupBy(*same).agg(F.min("token").alias("cls")), same).select("token", "cls"))


def in_classes(sets: DataFrame, known: DataFrame) -> DataFrame:
    """``sets`` (tokens and columns that tell the sets apart) with the classes of their tokens; sets without any have an empty array."""
    keys = [c for c in sets.columns if c != "tokens"]
    return sets.select(*keys, F.explode_outer("tokens").alias("token")).join(small_enough(known), "token", "left").groupBy(*keys).agg(F.collect_set("cls").alias("tokens"))


def mine(labelled: DataFrame, min_support: float, min_confidence: float) -> tuple[DataFrame, DataFrame]:
    """key_token, antecedent, verdict, confidence, support of the pruned rules over classes from (tokens, verdict), and the classes."""
    rows = pin(labelled.select(F.monotonically_increasing_id().alias("id"), "tokens", "verdict"))
    known = classes(rows, min_support)
    items = pin(in_classes(rows, known).select(F.concat("tokens", F.array(F.concat(F.lit(VERDICT), "verdict"))).alias("items")))
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(items)
    frequent = model.freqItemsets.where(F.size("items") == 1).select(F.col("items")[0].alias("token"), "freq")
    rules = model.associationRules.where(F.startswith(F.col("consequent")[0], F.lit(VERDICT)) & ~F.exists("antecedent", lambda x: F.startswith(x, F.lit(VERDICT))))
    rules = rules.select(F.array_sort("antecedent").alias("antecedent"), F.substring(F.col("consequent")[0], len(VERDICT) + 1, 100).alias("verdict"), "confidence", "support")
    rarest = rules.select("antecedent", F.explode("antecedent").alias("token")).join(frequent, "token").groupBy("antecedent").agg(F.min_by("token", F.struct("freq", "token")).alias("key_token"))
    rules = pin(rules.dropDuplicates(["antecedent", "verdict"]).join(rarest, "antecedent"))
    specific = rules.select(F.struct("antecedent", "verdict", "confidence").alias("key"), F.col("antecedent").alias("tokens"))
    needless = inside(specific, rules).where((F.size("antecedent") < F.size("tokens")) & (F.col("verdict") == F.col("key.verdict")) & (F.col("confidence") >= F.col("key.confidence")))
    return pin(rules.join(needless.select("key.antecedent", "key.verdict").distinct(), ["antecedent", "verdict"], "left_anti")), known


def filter_urls(pages: DataFrame, rules: list[tuple[str, str, str]], url: str = "url", min_support: float = 0.01, min_confidence: float = 0.8) -> DataFrame:
    """``pages`` with host, path, rule (null if none was given) and verdict; columns of these names are replaced."""
    keep = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    known = pages.select(*keep, host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path")).withColumn("_given", given_rule(rules, F.col("host"), F.col("path")))
    decided = known.where(F.col("_given").isNotNull()).select(tokens_of(F.col(url)).alias("tokens"), F.col("_given.verdict").alias("verdict"))
    open_ = known.where(F.col("_given").isNull()).select(F.col(url).alias("key")).where(F.col(url).isNotNull()).distinct().withColumn("tokens", tokens_of(F.col("key")))
    if decided.isEmpty():
        learned = open_.select(F.col("key").alias("_url"), F.lit("allow").alias("_learned"))
    else:
        rules_, known_ = mine(decided, min_support, min_confidence)
        found = inside(in_classes(open_, known_), rules_)
        learned = found.groupBy("key").agg(F.max_by("verdict", F.struct("confidence", "support", "verdict")).alias("_learned")).withColumnRenamed("key", "_url")
    # Rows with a given rule do not take part in the join: they have no key and would meet in one task.
    by_rule = known.where(F.col("_given").isNotNull()).withColumn("_learned", F.lit(None).cast("string"))
    by_url = known.where(F.col("_given").isNull()).join(learned, F.col(url) == F.col("_url"), "left").drop("_url")
    out = by_rule.unionByName(by_url)
    return out.select(*keep, "host", "path", F.col("_given.rule").alias("rule"), F.coalesce("_given.verdict", "_learned", F.lit("allow")).alias("verdict"))
