"""A mix of sources that changes over training: each source's weight schedule is integrated, its cumulative demand inverted, documents are sorted by the training position this gives.

Sources share ``share`` times all words by weight (``weights`` in turn, sources in code point order, a null source last). A target stops at ``most`` times the words of its source; the rest is shared
again by weight, which ends at one level for all that are not stopped: sources are taken in order of size / weight, and one is stopped if its limit is within its part of what is left.

The documents of a source lie one after the other in the order of an md5 of their id (``seed`` changes it), once around for each pass. The copy whose middle lies at word c of its source is taken
if c is below the target. A schedule is a list of (time, weight) knots, straight in between, times from 0 to 1; ``schedules`` go to the sources in turn. Its integral up to time x, as a part of the whole,
times the target is the source's demand until x; the copy's position is the time at which demand reaches c. So each source is spent as its schedule says, and at most half a document is missing or too much.

Running sums go by range slices (``ordering.running_sum``), so a source may hold any share of the rows. The table of sources (one row each) is sorted in one task.

Defined results: a null or empty text has size 0 and takes no words. Null ids come first in the order, equal ids by size; repeated rows are documents of their own. All sizes 0: all targets 0.
Empty tables give empty results. Columns of the input that are called like those of a result give way to it. Long texts are counted whole. DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillroll.llm.common import WORD, small_enough
from tillroll.operators.ordering import join_null_safe, running_sum
from tillroll.session import pin

WEIGHTS = (5, 2, 1)
#: Falling, level and rising demand.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (0.5, 0.75), (1.0, 2.25)))


def time_of(part: Column, knots: Sequence[tuple[float, float]]) -> Column:
    """The time at which the integral of the schedule reaches ``part`` (0 to 1) of the whole."""
    areas = [(t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(knots, knots[1:])]
    if knots[0][0] != 0 or knots[-1][0] != 1 or min(w for _, w in knots) < 0 or not sum(areas):
        raise ValueError("a schedule runs from 0 to 1 with weights of 0 or more, not all 0")
    out, before = F.lit(knots[-1][0]), sum(areas)
    # From the last stretch to the first: nested conditions, evaluated row by row.
    for ((t0, w0), (t1, w1)), area in reversed(list(zip(zip(knots, knots[1:]), areas))):
        before -= area
        need = part * F.lit(sum(areas)) - F.lit(before)
        slope = (w1 - w0) / (t1 - t0)
        # Root of w0 x + slope x^2 / 2 = need, in the form that also holds for slope 0.
        x = F.try_divide(2 * need, F.lit(w0) + F.sqrt(F.greatest(F.lit(0.0), F.lit(w0 * w0) + F.lit(2 * slope) * need)))
        out = F.when(need <= area, F.lit(t0) + F.least(F.coalesce(x, F.lit(0.0)), F.lit(t1 - t0))).otherwise(out) if area else out
    return out


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size, turn (place in the order of sources, from 0), target; ``sizes`` holds source and source_size, one row each."""
    place = F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1
    rows = sizes.withColumn("turn", place).withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("turn") % len(weights) + 1).cast("int")))
    by_need = Window.orderBy(F.col("source_size") / F.col("w"), "turn")
    before, after = by_need.rowsBetween(Window.unboundedPreceding, -1), by_need.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy()
    rows = rows.withColumns({"all_words": F.sum("source_size").over(whole), "spent": F.coalesce(F.sum("source_size").over(before), F.lit(0)), "rest": F.sum("w").over(after)})
    stopped = F.col("source_size") * most * F.col("rest") <= F.col("w") * (F.col("all_words") * share - F.col("spent") * most)
    rows = rows.withColumn("stopped", stopped)
    kept = F.sum(F.when(F.col("stopped"), F.col("source_size")).otherwise(0)).over(whole)
    free = F.sum(F.when(F.col("stopped"), 0.0).otherwise(F.col("w"))).over(whole)
    rows = rows.withColumn("level", F.try_divide(F.col("all_words") * share - kept * most, free))
    target = F.when(F.col("stopped"), F.col("source_size") * most).otherwise(F.col("w") * F.col("level"))
    return rows.select("source", "source_size", "turn", target.cast("double").alias("target"))


def placed(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.5, most: float = 2.0, schedules: Sequence[Sequence[tuple[float, float]]] = SCHEDULES, seed: str = "mix", carry: Sequence[str] | None = None) -> DataFrame:
    """The columns ``carry`` of docs (all by default) with size, source_size, target and positions (one per copy taken, ascending by pass)."""
    carry = list(docs.columns) if carry is None else list(carry)
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    rows = docs.select(F.struct(*carry).alias("doc"), F.col("doc_id").alias("id"), F.col("source").alias("source"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"), key.alias("key"), F.monotonically_increasing_id().alias("tie"))
    # Equal rows change places freely; the tie lets a range end between them.
    rows = pin(running_sum(rows, "size", [F.col("key"), F.asc_nulls_first("id"), F.col("size"), F.col("tie")], ["source"], "upto", "source_size"))
    of_source = pin(targets(rows.groupBy("source").agg(F.max("source_size").alias("source_size")), weights, share, most))
    rows = join_null_safe(rows.drop("source_size"), small_enough(of_source), ["source"])
    passes = F.sequence(F.lit(0), F.lit(int(-(-most // 1)) - 1))
    middle = F.col("upto") - F.col("size") / 2
    copies = F.filter(F.transform(passes, lambda e: e * F.col("source_size") + middle), lambda c: c < F.col("target"))
    turn = F.col("turn") % len(schedules)

    def position(c: Column) -> Column:
        out = time_of(c / F.col("target"), schedules[-1])
        for i in range(len(schedules) - 1):
            out = F.when(turn == i, time_of(c / F.col("target"), schedules[i])).otherwise(out)
        return out

    clear = [c for c in carry if c not in ("size", "source_size", "target", "positions")]
    return rows.withColumn("positions", F.transform(copies, position)).select(*[F.col("doc")[c].alias(c) for c in clear], "size", "source_size", "target", "positions")


def mixed(docs: DataFrame, **settings) -> DataFrame:
    """The mix in training order: the columns of docs, copy (from 0) and position (0 to 1), one row per copy taken; range-partitioned and sorted by position."""
    rows = placed(docs, **settings)
    keep = [c for c in docs.columns if c in rows.columns and c not in ("copy", "position", "size", "source_size", "target", "positions")]
    rows = rows.select(*keep, F.posexplode("positions").alias("copy", "position"))
    return rows.repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id", "copy")


def digests(docs: DataFrame, **settings) -> DataFrame:
    """doc_id, size, source_size, target, taken (words, repeats counted), first_position and last_position of every row."""
    rows = placed(docs, carry=["doc_id"], **settings)
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.size("positions")).alias("taken"),
                       F.round(F.try_element_at("positions", F.lit(1)), 6).alias("first_position"), F.round(F.try_element_at("positions", F.lit(-1)), 6).alias("last_position"))
