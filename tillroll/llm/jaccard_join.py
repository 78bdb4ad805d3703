"""Exact n-gram Jaccard self-join with signature trees.

Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z; a document's set holds its distinct shingles of ``n`` words (the whole sequence if it has
fewer, nothing without words). Two documents link if 100 * intersection >= percent * union. The result names for every document its component.

1. Sets that are equal link all their documents; one of them stands for all from here on.
2. Which sets can link at all: take any order of all shingles; two sets that link have one in common among the first size - ceil(percent * size / 100) + 1 of each. Let shingles come first that only
   one set holds. A set with that many of them links with no other and is done, which shows in a part of the shingles already (a hash chooses it). The texts of the others are read again.
3. Round one finds most components: sets are put into size classes, the space of shingles is cut into parts, and sets meet under the names of a few parts. Sets that share a name, directly or
   through others, are a family (connected components of ids); its families are joined in blocks.
   Round two loses no link between two components. Now shingles come first that only one component holds, then the others from rare to frequent; sets whose first ones are all their component's are
   done, the rest is asked again among itself, and then meets under those of the first shingles that different components hold. So passages and lines that many documents share bring sets together only if
   these have little else. Families of up to one block are blocks; in larger ones the sets of each name meet by themselves, in large groups the members of the commonest component against the rest.
   Thousands of near copies that are one component by then cost nothing more.
4. A block is joined by a signature tree: leaves are sets with a bitmap of their shingles, a node has the OR of its children's bitmaps and their range of sizes. Two nodes are
   traversed together only if their largest possible overlap (common bits, and shingles that share a bit) reaches what their smallest sizes ask for, and only while
   they hold different components. Pairs of leaves are verified on the shingles themselves (64-bit names).

Null text is empty. Empty sets link with nothing. A row without doc_id takes part, but cannot name a component: if it stands alone its component is null. Repeated rows
are equal sets.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillroll.llm.common import SPACE, arrow_rows, components, give_back, release, small_enough, words_of
from tillroll.llm.repeats import _mix, named, word_names
from tillroll.session import pin

CUTS = 4
FIRST_PARTS = 8
SLICES = 2
#: Sets of a block, and shingles of a block (32 MB): whichever is reached first.
BLOCK, BLOCK_SHINGLES = 2048, 4 << 20
WAVE = 1.0
#: Characters of the texts whose words are named at once; a word takes about ten times its length while it is.
TEXTS = 1 << 20
LEAF = 24
FAN = 8
BITS = 4096


class Classes:
    """Size classes for a threshold, and the number of parts in each."""

    def __init__(self, percent: int, most: int = 1 << 40) -> None:
        self.percent, self.edges, self._spare = percent, [1], {}
        while self.edges[-1] < most:
            a = self.edges[-1]
            self.edges.append(max(a + 1, a * 100 // percent + 1))  # the next class starts above all partners of this one's smallest set

    def of(self, size: int) -> int:
        return int(np.searchsorted(self.edges, size, side="right")) - 1

    def differing(self, c: int) -> int:
        """Most shingles in one of two linked sets only, the smaller of them in class ``c``."""
        a = self.edges[c + 1] - 1
        return (a + a * 100 // self.percent) * (100 - self.percent) // (100 + self.percent)

    def spare(self, c: int) -> int:
        """Parts beyond those that may differ: a little more than the smallest sets of the class leave empty by chance."""
        if c not in self._spare:
            d, n = self.differing(c), 1
            while n < 2 * d + 8:
                empty = (d + 1 + n) * math.exp(-self.edges[c] / (d + 1 + n))
                if n >= empty + 2 * math.sqrt(empty) + 1:
                    break
                n += 1
            self._spare[c] = n
        return self._spare[c]


def _sets(texts: list[str | None], n: int) -> list[np.ndarray]:
    """The sets of a batch of texts; words of about ``TEXTS`` characters are named at once."""
    out: list[np.ndarray] = []
    words: list[str] = []
    sizes: list[int] = []

    def name() -> None:
        h, at = word_names(words), 0
        for size in sizes:
            own = h[at:at + size]
            at += size
            out.append(own[:0] if not size else np.unique(named(own, np.arange(size - n + 1), n) if size >= n else named(own, np.zeros(1, np.int64), size)))
        words.clear()
        sizes.clear()

    chars = 0
    for t in texts:
        chars += len(t or "")
        if sizes and chars > TEXTS:
            name()
            chars = len(t or "")
        w = words_of((t or "").encode().lower().decode())  # of bytes, so A-Z only
        words.extend(w)
        sizes.append(len(w))
    name()
    return out


def thinned(shingles: np.ndarray, percent: int) -> np.ndarray:
    """The part of a set that a hash chooses: one and a half times as many as come first, so that most sets can be told to be done from it."""
    return shingles[_mix(shingles + np.uint64(percent)) % np.uint64(1000) < np.uint64(min(1000, 16 * (100 - percent)))]


def part_names(shingles: np.ndarray, classes: Classes) -> tuple[np.ndarray, np.ndarray]:
    """Names under which a set meets others, of its own class and of the one below, and which of them are of the first parts."""
    names, first = [np.empty(0, np.uint64)], [np.empty(0, bool)]
    c = classes.of(len(shingles)) if len(shingles) else -1
    for k in (c, c - 1):
        if k < 0 or not (d := classes.differing(k)):
            continue  # only equal sets could link
        spare = classes.spare(k)
        parts = d + 1 + spare
        for cut in range(CUTS):
            salt = np.uint64((k + 1) * CUTS + cut)
            part = (_mix(shingles ^ salt) % np.uint64(parts)).astype(np.int64)
            total = np.zeros(parts, np.uint64)
            np.add.at(total, part, _mix(shingles + np.uint64(parts)))
            empty = np.bincount(part, minlength=parts) == 0
            sparse = empty.sum() > spare
            use = np.arange(parts) if sparse and cut == CUTS - 1 else np.flatnonzero(~empty)
            names.append(_mix(total[use] + _mix(use.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + salt)))
            first.append((use < FIRST_PARTS) & (cut == 0))
            if not sparse:
                break
    return np.concatenate(names), np.concatenate(first)


class Leaves:
    """The sets of a block and what the tree needs of each."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.sets = sets
        self.size = np.array([len(s) for s in sets])
        self.bits = np.zeros((len(sets), BITS // 64), np.uint64)
        for i, s in enumerate(sets):
            np.bitwise_or.at(self.bits[i], ((s >> np.uint64(6)) % np.uint64(BITS // 64)).astype(np.int64), np.uint64(1) << (s & np.uint64(63)))
        self.hidden = self.size - np.bitwise_count(self.bits).sum(1).astype(np.int64)  # shingles that share a bit with another


class Node:
    def __init__(self, leaves: Leaves, members: list[int], comps: list[int]) -> None:
        self.members = members
        self.low, self.high = int(leaves.size[members].min()), int(leaves.size[members].max())
        self.bits = np.bitwise_or.reduce(leaves.bits[members], 0)
        self.hidden = int(leaves.hidden[members].max())
        self.children: list[Node] = []
        if len(members) > LEAF:
            step = -(-len(members) // FAN)
            self.children = [Node(leaves, members[i:i + step], comps) for i in range(0, len(members), step)]


def block_links(sets: list[np.ndarray], comps: list[int], sides: list[int], percent: int) -> list[tuple[int, int]]:
    """Pairs (i, j) whose links connect what the linked sets of different components connect. Sides: 0 and 1 are joined with each other only, 2 with all."""
    leaves = Leaves(sets)
    parent = list(range(len(sets)))
    of_comp: dict[int, int] = {}
    for i, c in enumerate(comps):
        parent[i] = of_comp.setdefault(c, i)

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    links: list[tuple[int, int]] = []

    def compare(i: int, j: int) -> None:
        a, b = sets[i], sets[j]
        if sides[i] + sides[j] < 2 and sides[i] == sides[j] or not len(a) or not len(b) or root(i) == root(j):
            return
        same = len(np.intersect1d(a, b, assume_unique=True))
        if 100 * same >= percent * (len(a) + len(b) - same):
            links.append((i, j))
            parent[root(i)] = root(j)

    def visit(u: Node, v: Node) -> None:
        if 100 * u.high < percent * v.low or 100 * v.high < percent * u.low:
            return
        most = int(np.bitwise_count(u.bits & v.bits).sum()) + min(u.hidden, v.hidden)
        if (100 + percent) * most < percent * (u.low + v.low):
            return
        first = root(u.members[0])
        if all(root(i) == first for i in u.members) and all(root(i) == first for i in v.members):
            return
        if u.children and (not v.children or len(u.members) >= len(v.members)):
            for k, x in enumerate(u.children):
                for y in (u.children[k:] if u is v else [v]):
                    visit(x, y)
        elif v.children:
            for y in v.children:
                visit(u, y)
        else:
            others = np.array(v.members)
            for k, i in enumerate(u.members):
                js = others[k + 1:] if u is v else others
                size, own = leaves.size[js], leaves.size[i]
                common = np.bitwise_count(leaves.bits[js] & leaves.bits[i]).sum(1).astype(np.int64) + np.minimum(leaves.hidden[js], leaves.hidden[i])
                for j in js[((100 + percent) * common >= percent * (size + own)) & (100 * np.minimum(size, own) >= percent * np.maximum(size, own))].tolist():
                    compare(i, j)

    order = sorted(range(len(sets)), key=lambda i: (len(sets[i]), comps[i]))
    if order:
        tree = Node(leaves, order, comps)
        visit(tree, tree)
    return links


def _blocks_of(n: int, percent: int):
    """Streams rows in order of block, takes the shingles of their texts and joins the block; one block is in memory at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: int | None = None
        rows: dict[int, tuple[int, int, np.ndarray]] = {}

        def links() -> tuple[list[int], list[int]]:
            ids = sorted(rows)
            found = block_links([rows[i][2] for i in ids], [rows[i][0] for i in ids], [rows[i][1] for i in ids], percent) if len(ids) > 1 else []
            return [ids[i] for i, _ in found], [ids[j] for _, j in found]

        give_back()
        for batch in batches:
            a, b = [], []
            for block, row, comp, side, digest, own in zip(*(batch.column(c).to_pylist() for c in ("block", "row", "comp", "side", "digest")), _sets(batch.column("text").to_pylist(), n)):
                if block != now:
                    x, y = links()
                    a += x
                    b += y
                    now, rows = block, {}
                if row not in rows and hashlib.blake2b(own.tobytes(), digest_size=16).digest() == digest:  # rows of one id may hold other texts
                    rows[row] = (comp, side, own)
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
        a, b = links()
        rows = {}
        give_back()
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _meetings(sets: DataFrame, first: bool) -> DataFrame | None:
    """block, row, comp, side of the sets to hold against each other; None if there are none.

    Sets that meet under open names, directly or through others, are a family. A family of up to ``BLOCK`` sets and ``BLOCK_SHINGLES`` shingles is one block, so each of its sets is sent once.
    In the second round a larger one falls apart into the sets of each of its names.
    """
    def blocks(sets_: str, shingles: str, part: int = 1):
        """How many blocks of a ``part``-th of the bounds hold so many sets with so many shingles."""
        return F.greatest(F.lit(1), F.ceil(F.col(sets_) / max(1, BLOCK // part)), F.ceil(F.col(shingles) / max(1, BLOCK_SHINGLES // part))).cast("int")

    names = sets.select("row", "comp", F.col("size").alias("shingles"), F.explode("first_names" if first else "all_names").alias("name"))
    open_ = None
    for slice_ in range(SLICES):  # one after the other, so that only a part of the names lies in shuffle files at a time
        some = names.where(F.pmod("name", F.lit(SLICES)) == slice_)
        some = pin(some.groupBy("name").agg(F.min("comp").alias("_a"), F.max("comp").alias("_b"), F.min("row").alias("head")).where("_a < _b").select("name", "head"))
        release(sets)
        open_ = some if open_ is None else open_.unionByName(some)
    met = pin(names.join(small_enough(open_), "name").select("row", "comp", "shingles", "head", *([] if first else ["name"])).distinct())
    release(sets)
    if met.isEmpty():
        return None
    families = components(met.select(F.col("row").alias("a"), F.col("head").alias("b"))).select(F.col("id").alias("row"), F.col("component").alias("family"))
    families = pin(met.select("row", "comp", "shingles").distinct().join(families, "row"))

    def with_chunks(members: DataFrame) -> DataFrame:
        sizes = members.groupBy("family").agg(F.count("*").alias("size"), F.sum("shingles").alias("of_family")).select("family", "size", blocks("size", "of_family").alias("chunks"))
        return pin(members.join(small_enough(pin(sizes)), "family"))

    members = with_chunks(families)
    release(sets)
    whole = members.where("chunks = 1").select(F.xxhash64("family", F.lit(0), F.lit(0)).alias("block"), "row", "comp", F.lit(2).alias("side"))
    large = members.where("chunks > 1")
    if large.isEmpty():
        return whole
    if first:
        # Blocks of a large family, each with the same few of its sets, through which they come together.
        chunk = F.pmod(F.xxhash64("row", F.lit(9)), F.col("chunks")).cast("int")
        heads = large.where(F.pmod(F.xxhash64("row", F.lit(3)), F.ceil(F.col("size") / 8).cast("bigint")) == 0).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        return whole.unionByName(large.withColumn("chunk", chunk).unionByName(heads).select(F.xxhash64("family", "chunk", F.lit(1)).alias("block"), "row", "comp", F.lit(2).alias("side")).distinct())
    # Names with the same sets are one.
    met = met.join(large.select("row").distinct(), "row", "left_semi")
    same = met.groupBy("name").agg(F.count("*").alias("n"), F.min("row").alias("a"), F.max("row").alias("b"), F.bit_xor(F.xxhash64("row")).alias("x"), F.bit_xor(F.xxhash64("row", F.lit(1))).alias("y"))
    one = pin(same.groupBy("n", "a", "b", "x", "y").agg(F.min("name").alias("name")).select("name"))
    members = with_chunks(met.join(small_enough(one), "name", "left_semi").select(F.col("name").alias("family"), "row", "comp", "shingles"))
    release(sets)
    whole = whole.unionByName(members.where("chunks = 1").select(F.xxhash64("family", F.lit(0), F.lit(4)).alias("block"), "row", "comp", F.lit(2).alias("side")))
    large = members.where("chunks > 1")
    if large.isEmpty():
        return whole
    # The commonest component of a name against the rest, and the rest among itself.
    by_comp = large.groupBy("family", "comp").agg(F.count("*").alias("n"), F.sum("shingles").alias("w"))
    most = by_comp.groupBy("family").agg(F.max_by(F.struct("comp", "n", "w"), F.struct("n", "comp")).alias("c"), F.sum("n").alias("n_all"), F.sum("w").alias("w_all"))
    most = most.select("family", F.col("c.comp").alias("common"), F.col("c.n").alias("n"), F.col("c.w").alias("w"), (F.col("n_all") - F.col("c.n")).alias("n_rest"), (F.col("w_all") - F.col("c.w")).alias("w_rest"))
    most = pin(most.select("family", "common", blocks("n", "w", 2).alias("m"), blocks("n_rest", "w_rest", 2).alias("s")))
    large = large.join(small_enough(most), "family")
    common = large.where("comp = common").withColumn("chunk", F.pmod(F.xxhash64("row", F.lit(9)), F.col("m")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("s") - 1)))
    common = common.select(F.xxhash64("family", "chunk", "other", F.lit(2)).alias("block"), "row", "comp", F.lit(0).alias("side"))
    rest = large.where("comp <> common").withColumn("other", F.pmod(F.xxhash64("row", F.lit(9)), F.col("s")).cast("int"))
    against = rest.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("m") - 1))).select(F.xxhash64("family", "chunk", "other", F.lit(2)).alias("block"), "row", "comp", F.lit(1).alias("side"))
    among = rest.withColumn("peer", F.explode(F.sequence(F.lit(0), F.col("s") - 1))).select(F.xxhash64("family", F.least("other", "peer"), F.greatest("other", "peer"), F.lit(3)).alias("block"), "row", "comp", F.lit(2).alias("side"))
    return whole.unionByName(common).unionByName(against).unionByName(among)


def _firsts(percent: int) -> Column:
    """How many shingles of a set come first: two linked sets have one of these in common, in any order of all shingles."""
    return F.floor(F.col("size") * (100 - percent) / 100) + 1


def _undone(sets: DataFrame, percent: int) -> DataFrame:
    """row, key, text_hash, digest, size of the sets that may link with another. The rest have more shingles to themselves, among those thinned out, than two linked sets may differ by."""
    each = sets.select("row", F.explode("thinned").alias("name"))
    own = None
    for slice_ in range(SLICES):
        some = each.where(F.pmod("name", F.lit(SLICES)) == slice_).groupBy("name").agg(F.min("row").alias("row"), F.max("row").alias("_b")).where("row = _b")
        some = pin(some.groupBy("row").agg(F.count("*").alias("own")))
        release(sets)
        own = some if own is None else own.unionByName(some)
    own = own.groupBy("row").agg(F.sum("own").alias("own"))
    left = sets.select("row", "key", "text_hash", "digest", "size").join(own, "row", "left").where(F.coalesce("own", F.lit(0)) < _firsts(percent))
    return pin(left.drop("own"))


def _open(sets: DataFrame) -> DataFrame:
    """row, name and n (sets that hold it) of the shingles that different components hold."""
    each = sets.select("row", "comp", F.explode("shingles").alias("name"))
    out = None
    for slice_ in range(SLICES):
        some = each.where(F.pmod("name", F.lit(SLICES)) == slice_)
        held = pin(some.groupBy("name").agg(F.min("comp").alias("_a"), F.max("comp").alias("_b"), F.count("*").alias("n")).where("_a < _b").select("name", "n"))
        some = pin(some.join(small_enough(held), "name").select("row", "name", "n"))
        del held
        release(sets)
        out = some if out is None else out.unionByName(some)
    return out


def _first_open(sets: DataFrame, percent: int) -> DataFrame:
    """row, comp, size, all_names of the sets that may link with another component; all_names: the shingles held by several components that are among a set's first."""
    for last in (False, True):
        open_ = _open(sets)
        # What comes first beyond the shingles that one component holds.
        few = sets.select("row", "size").join(open_.groupBy("row").agg(F.count("*").alias("_open")), "row").select("row", (_firsts(percent) - F.col("size") + F.col("_open")).alias("_k")).where("_k > 0")
        few = pin(few)
        if not last:  # among fewer sets fewer shingles are held by several components
            sets = pin(sets.join(small_enough(few.select("row")), "row", "left_semi"))
        release(sets)
    ranked = open_.join(small_enough(few), "row").withColumn("_r", F.row_number().over(Window.partitionBy("row").orderBy("n", "name"))).where("_r <= _k")
    names = ranked.groupBy("row").agg(F.collect_list("name").alias("all_names"))
    out = pin(sets.select("row", "comp", "size").join(names, "row"))
    del open_, few, ranked, names
    release(sets)
    return out


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in arrays])]).astype(np.int32)), pa.array(np.concatenate(arrays).view(np.int64)))


def _links(meetings: DataFrame, docs: DataFrame, sets: DataFrame, shingles: int, n: int, percent: int) -> DataFrame:
    """Verified links (a, b) between rows. The texts travel to the blocks, which take the shingles: these would be larger and do not compress.

    A set in several blocks travels several times, so blocks go in waves of about ``WAVE`` of all ``shingles``; shuffle files of a wave are gone before the next.
    """
    meetings = pin(meetings.join(sets.select("row", "key", "digest", "size"), "row"))
    waves, found = max(1, math.ceil((meetings.agg(F.sum("size")).first()[0] or 0) / shingles / WAVE)), None
    for wave in range(waves):
        now = meetings.where(F.pmod(F.xxhash64("block", F.lit(5)), F.lit(waves)) == wave).drop("size")
        texts = docs.join(small_enough(now), "key")
        blocks = texts.select("block", "row", "comp", "side", "digest", "text").repartition("block").sortWithinPartitions("block")
        links = pin(blocks.mapInArrow(_blocks_of(n, percent), "a bigint, b bigint"))
        del texts, blocks
        release(docs)
        found = links if found is None else found.unionByName(links)
    return found


def joined(docs: DataFrame, n: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, text_hash, row_digest, n_shingles, component_id for every row of ``docs`` (doc_id, text); row_digest is null for empty sets, else the same for equal sets."""
    release(docs)
    docs = docs.select("doc_id", "text", F.coalesce("doc_id", F.xxhash64("text")).alias("key"))
    classes = Classes(percent)

    def digest(s: np.ndarray) -> bytes | None:
        return hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None

    def facts(batch: pa.RecordBatch) -> dict:
        found = _sets(batch.column("text").to_pylist(), n)
        return {"doc_id": batch.column("doc_id"), "key": batch.column("key"), "text_hash": batch.column("text_hash"),
                "digest": pa.array([digest(s) for s in found], pa.binary()), "size": pa.array([len(s) for s in found], pa.int64()), "thinned": _lists([thinned(s, percent) for s in found])}

    def names(batch: pa.RecordBatch) -> dict:
        found = _sets(batch.column("text").to_pylist(), n)
        found = [s if digest(s) == d else s[:0] for s, d in zip(found, batch.column("digest").to_pylist())]
        parts = [part_names(s, classes) for s in found]
        return {**{c: batch.column(c) for c in ("row", "key", "digest", "size")}, "first_names": _lists([x[f] for x, f in parts]), "shingles": _lists(found)}

    every = pin(arrow_rows(docs.withColumn("text_hash", F.xxhash64("text")), facts, "doc_id bigint, key bigint, text_hash bigint, digest binary, size bigint, thinned array<bigint>").withColumn("row", F.monotonically_increasing_id()))
    rows = pin(every.drop("thinned"))
    distinct = pin(rows.where(F.col("digest").isNotNull()).groupBy("digest").agg(F.min("row").alias("row"), F.min("doc_id").alias("label"), F.min("size").alias("size")))
    left = _undone(every.join(small_enough(distinct.select("row")), "row", "left_semi"), percent)
    del every
    release(docs)
    texts = docs.withColumn("text_hash", F.xxhash64("text")).join(small_enough(left), ["key", "text_hash"]).dropDuplicates(["row"])
    sets = pin(arrow_rows(texts.select("row", "key", "digest", "size", "text"), names, "row bigint, key bigint, digest binary, size bigint, first_names array<bigint>, shingles array<bigint>").where(F.size("shingles") > 0).withColumn("comp", F.col("row")))
    del texts, left
    release(docs)
    shingles, comps = distinct.agg(F.sum("size")).first()[0] or 1, None
    for first in (True, False):
        if comps is not None:
            sets = sets.drop("comp").join(small_enough(comps.select(F.col("id").alias("row"), F.col("component").alias("comp"))), "row", "left").withColumn("comp", F.coalesce("comp", "row"))
        meetings = _meetings(sets if first else _first_open(sets, percent), first)
        if meetings is None:
            continue
        links = _links(meetings, docs, sets, shingles, n, percent)
        del meetings
        release(docs)
        if comps is not None:
            links = links.unionByName(comps.select(F.col("id").alias("a"), F.col("component").alias("b")))
        comps = pin(components(links))
        release(docs)
    named_ = distinct if comps is None else distinct.join(comps.select(F.col("id").alias("row"), "component"), "row", "left")
    named_ = named_.withColumn("component", F.col("row") if comps is None else F.coalesce("component", "row"))
    labels = named_.groupBy("component").agg(F.min("label").alias("component_id"))
    named_ = pin(named_.join(labels, "component").select("digest", "component_id"))
    out = rows.select("doc_id", "text_hash", "digest", F.col("size").alias("n_shingles")).join(named_, "digest", "left")
    return out.select("doc_id", "text_hash", F.col("digest").alias("row_digest"), "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def one_per_component(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stand for their component: of linked documents the one with the smallest id (of rows with that id one), and every document without words."""
    found = joined(docs, n, percent).where(F.col("row_digest").isNotNull())
    found = pin(found.groupBy("doc_id", "text_hash").agg(F.min("component_id").alias("component_id"), F.count("*").alias("rows")).where("rows > 1 OR doc_id > component_id OR doc_id IS NULL AND component_id IS NOT NULL"))
    dropped = found.where("doc_id > component_id OR doc_id IS NULL AND component_id IS NOT NULL").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"))
    kept = docs.join(small_enough(pin(dropped)), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_hash")), "left_anti")
    if found.where("rows > 1").isEmpty():
        return kept
    return kept.withColumn("_n", F.row_number().over(Window.partitionBy("doc_id", F.xxhash64("text")).orderBy(F.lit(0)))).where(F.expr("_n = 1") | (F.length(F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), SPACE, " "))) == 0)).drop("_n")
