"""Quality rules, line first: bad lines go, then documents that lose too much text.

Only DataFrame functions; every value of a document is computed within its row, so no shuffle and no hot key.

A line with a word fails if it
  - is navigation: at least a fifth of its words are separators (``|``, ``>``, ``»``, ``·``),
  - is noisy: over a tenth of its characters are of ``#*$%&|<>``, or it holds ``!!`` twice or more,
  - is boilerplate: it names cookies, scripts, licences, rights, subscriptions and the like,
  - lacks closing punctuation and has fewer than ``MIN_OPEN_WORDS`` words,
  - repeats an earlier line.
A document is rejected if the failed lines hold more than ``max_lost`` percent of its word characters.

Null text counts as empty: no words, base_failed true. Repeated rows are judged one by one; a null doc_id stays null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.llm.common import SPACE, let

SYMBOLS = "#*$%&|<>"
MIN_OPEN_WORDS = 4
BOILERPLATE = "(lorem ipsum|javascript|cookie|privacy policy|terms of use|terms of service|all rights reserved|licensed under|copyright|subscribe|sign up|click here)"
SEPARATORS = ["|", ">", "»", "·"]
CLOSED = r"[.!?…。！？:;\"'”’»)\]][\x20\x09-\x0D]*\z"
SHOUT = "!!"


def _words(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def _triples(words: Column) -> Column:
    """A hash of each window of three words; empty below three words."""
    return F.when(F.size(words) >= 3, F.transform(F.slice(words, 1, F.greatest(F.size(words) - 2, F.lit(0))), lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))).otherwise(F.array().cast("array<bigint>"))


def _repeated_words(words: Column) -> Column:
    """Words inside windows of three that occur twice or more."""
    def among(hashes: Column) -> Column:
        any_twice = let(F.sort_array(hashes), lambda s: F.exists(F.transform(s, lambda h, i: F.coalesce(h == F.get(s, i + 1), F.lit(False))), lambda x: x))
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        starts = let(pairs, lambda s: F.sort_array(F.transform(F.filter(s, lambda x, i: F.coalesce(x["h"] == F.get(s, i + 1)["h"], F.lit(False)) | F.coalesce((i > 0) & (x["h"] == F.get(s, i - 1)["h"]), F.lit(False))), lambda x: x["i"])))
        covered = let(starts, lambda p: F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3)))), F.lit(0).cast("bigint"), lambda a, x: a + x))
        return F.when(any_twice, covered).otherwise(F.lit(0).cast("bigint"))
    return let(_triples(words), among)


def _line_ok(line: Column) -> Column:
    chars = F.length(line)
    symbols = chars - F.length(F.translate(line, SYMBOLS, ""))
    shouts = chars - F.length(F.replace(line, F.lit(SHOUT), F.lit("")))
    rest = (symbols * 10 <= chars) & (shouts < 4) & ~F.lower(line).rlike(BOILERPLATE)
    return let(_words(line), lambda w: let(F.size(F.filter(w, lambda x: x.isin(SEPARATORS))), lambda n: ((n * 5 < F.size(w)) | (n == 0)) & ((F.size(w) >= MIN_OPEN_WORDS) | line.rlike(CLOSED)))) & rest


def line_quality(docs: DataFrame, text: str = "text", max_lost: int = 50) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, cleaned (kept lines), lost_pct, kept."""
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda l: l.rlike("[^\\x20\\x09-\\x0D]"))
    facts = let(_words(body), lambda w: F.struct(F.size(w).cast("bigint").alias("n_words"), F.length(F.array_join(w, "")).cast("bigint").alias("word_chars"), _repeated_words(w).alias("n_repeat_words")))
    cleaned = let(lines, lambda l: F.struct((F.size(l) - F.size(F.array_distinct(l))).cast("bigint").alias("n_dup_lines"), F.array_join(F.filter(F.array_distinct(l), _line_ok), "\n").alias("cleaned")))
    out = docs.withColumns({"_facts": facts, "_lines": cleaned, "n_symbols": (F.length(body) - F.length(F.translate(body, SYMBOLS, ""))).cast("bigint")})
    kept_chars = F.length(F.regexp_replace("_lines.cleaned", SPACE, ""))
    out = out.withColumns({
        "n_words": F.col("_facts.n_words"), "word_chars": F.col("_facts.word_chars"), "n_dup_lines": F.col("_lines.n_dup_lines"), "n_repeat_words": F.col("_facts.n_repeat_words"),
        "cleaned": F.col("_lines.cleaned"), "kept_chars": kept_chars.cast("bigint")}).drop("_facts", "_lines")
    failed = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & ((F.col("word_chars") - F.col("kept_chars")) * 100 <= F.col("word_chars") * max_lost))
