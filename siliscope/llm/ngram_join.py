"""Prefix-tree join of review comments by the Jaccard likeness of their word n-grams, exact, with components of the links.

1. Every comment becomes a set of 64-bit n-gram hashes. Equal sets are one from here on, told apart by a 128-bit digest.
2. In the order of the hashes, the first a n-grams of a set, a being (1-t+0.05) n, share at least the smaller of ``a - (n - o)`` and
   ``a' - (n' - o)`` with the first a' of a set of n' n-grams that links to it at likeness t by an overlap o. Sets that share fewer
   than the least of these over all n' and o with all others together are left out.
3. The whole sets of the rest are counted and put into the global order, rarest n-gram first. N-grams of one set alone
   are dropped and only kept as a number; a set that is left with less than t of its size can link to none.
4. Two linked sets share one of their first ``s - ceil(t n) + 1`` n-grams. Of the sets that share such an n-gram each is paired
   with the one that has the fewest n-grams of its own, which links most families of near copies at a cost that grows with their size.
5. Only where an n-gram still joins sets of different components are pairs listed, block against block, and then
   only those whose sizes and remaining lengths allow a link.
6. Pairs are settled in prefix trees: the sets to compare with one set are stored in a trie in the global order; one
   traversal carries the overlap of shared beginnings and leaves a branch when what remains cannot reach the bound.

No step holds a group that grows with the table: counts are combined before shuffles, joins are by n-gram or by id and may be split when
skewed, and trees and blocks are of bounded size.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siliscope.llm.common import runs, small_batches, tasks, text_of
from siliscope.llm.graph import connected
from siliscope.llm.shingles import text_sets
from siliscope.operators.ordering import row_index
from siliscope.sources.staging import release, stage

BATCH_TEXTS = 1000
MARGIN = 5  # percent of a set that the first thinning looks at beyond what a linked set may lack
TREE_SETS = 128  # sets per prefix tree
BLOCK_SETS = 512  # sets per block where pairs are listed
STRIDE = 32  # n-grams between two looks at the bound
#: bits of the table that thins the second reading of the texts; 8 MB whatever the input, and only a help: where it is full
#: everything passes and the exact join behind it does all the work
TABLE_BITS = 1 << 26


def _digest(grams: np.ndarray) -> bytes:
    return hashlib.blake2b(grams.tobytes(), digest_size=16).digest()


def _few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of at most BATCH_TEXTS rows, so that a task holds the sets of few texts at a time."""
    for batch in batches:
        for lo in range(0, batch.num_rows, BATCH_TEXTS):
            yield batch.slice(lo, BATCH_TEXTS)


def _described(width: int, percent: int):
    """Rows of id, size, n-grams needed among the first ones and digest of each comment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _few(batches):
            sets = [(len(s), _digest(s) if len(s) else None, _head(len(s), percent)[1]) for s in text_sets(batch.column("text"), width)]
            yield pa.RecordBatch.from_pydict({"id": batch.column("id"), "n": pa.array([n for n, _, _ in sets], pa.int32()),
                                              "need": pa.array([k for _, _, k in sets], pa.int32()),
                                              "digest": pa.array([d for _, d, _ in sets], pa.binary())})

    return run


def _head(n: int, percent: int) -> tuple[int, int]:
    """How many n-grams of a set are looked at first, and how many of them are among the first of any set that links to it.

    Of the first ones of two sets at least ``first - lacking`` on either side are common to both, in one order, so the smaller
    count is shared; ``lacking`` is what the whole set has beyond the least overlap that links the two sizes.
    """
    first = min(n, (100 - percent + MARGIN) * n // 100 + 1)
    if not n:
        return first, 1
    sizes = np.arange(-(-percent * n // 100), 100 * n // percent + 1)  # of the sets that may link to this one
    own = first - (100 * n - percent * sizes) // (100 + percent)
    theirs = np.minimum(sizes, (100 - percent + MARGIN) * sizes // 100 + 1) - (100 * sizes - percent * n) // (100 + percent)
    return first, max(1, int(np.minimum(own, theirs).min()))


def _heads(width: int, percent: int, table=None):
    """Rows of digest and first n-grams; with a table of bits, of comments that have enough n-grams with a bit, and only those."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _few(batches):
            digests, heads = [], []
            for grams in text_sets(batch.column("text"), width):
                if not len(grams):
                    continue
                first, need = _head(len(grams), percent)
                head = grams[:first]
                if table is not None:
                    place = (head & np.uint64(TABLE_BITS - 1)).astype(np.int64)
                    head = head[(table.value[place >> 6] >> (place & 63).astype(np.uint64)) & np.uint64(1) == 1]
                    if len(head) < need:
                        continue
                digests.append(_digest(grams))
                heads.append(head.view(np.int64))
            yield pa.RecordBatch.from_pydict({"digest": pa.array(digests, pa.binary()), "head": pa.array(heads, pa.list_(pa.int64()))})

    return run


def _bit_table(grams: DataFrame) -> np.ndarray:
    """A bit for every n-gram at its last digits; at most TABLE_BITS / 64 words reach the driver."""
    place = F.col("gram").bitwiseAND(F.lit(TABLE_BITS - 1))
    words = grams.select(F.shiftright(place, 6).cast("int").alias("w"), F.expr("shiftleft(1L, cast(gram & 63 AS int))").alias("b")).groupBy("w").agg(
        F.bit_or("b").alias("b")).toArrow()
    table = np.zeros(TABLE_BITS >> 6, np.uint64)
    table[words.column("w").to_numpy()] = words.column("b").to_numpy().view(np.uint64)
    return table


def _whole(width: int):
    """The whole sets of comments, each under the number of its digest; a comment whose set is another one is left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _few(batches):
            rows = [(d, s) for d, want, s in zip(batch.column("d").to_pylist(), batch.column("digest").to_pylist(),
                                                 text_sets(batch.column("text"), width)) if len(s) and _digest(s) == want]
            yield pa.RecordBatch.from_pydict({
                "id": pa.array([d for d, _ in rows], pa.int64()), "grams": pa.array([s.view(np.int64) for _, s in rows], pa.list_(pa.int64()))})

    return run


class PrefixTree:
    """Sets of n-grams in one global order, stored by shared beginnings.

    A node is (n-grams of its edge, children, largest set size below, smallest full size below, members that end here).
    """

    def __init__(self, members: list[tuple[int, int, list[int]]]):
        """``members``: (id, full size, n-grams in the global order)."""
        self.root = self._build(sorted(members, key=lambda m: m[2]), 0)

    def _build(self, members, depth: int):
        first, last = members[0][2], members[-1][2]  # sorted, so what these two share all share
        stop, most = depth, min(len(first), len(last))
        while stop < most and first[stop] == last[stop]:
            stop += 1
        ends = [(m[0], m[1]) for m in members if len(m[2]) == stop]
        children, lo = [], len(ends)
        while lo < len(members):
            hi = lo
            while hi < len(members) and members[hi][2][stop] == members[lo][2][stop]:
                hi += 1
            children.append(self._build(members[lo:hi], stop))
            lo = hi
        return first[depth:stop], children, max(len(m[2]) for m in members), min(m[1] for m in members), ends

    def linked(self, size: int, grams: set[int], percent: int) -> Iterator[int]:
        """Ids of the members whose Jaccard likeness to a set of this full size reaches the bound."""
        whole = 100 + percent
        todo = [(self.root, 0, 0)]
        while todo:
            (edge, children, longest, smallest, ends), depth, overlap = todo.pop()
            least = -((-percent * (size + smallest)) // whole)  # overlap that any link below needs at least
            for at in range(0, len(edge), STRIDE):
                part = edge[at:at + STRIDE]
                overlap += sum(map(grams.__contains__, part))
                depth += len(part)
                if overlap + min(longest - depth, len(grams) - overlap) < least:
                    break
            else:
                for member, n in ends:
                    if 100 * overlap >= percent * (size + n - overlap):
                        yield member
                if overlap + min(longest - depth, len(grams) - overlap) >= least:
                    todo += [(child, depth, overlap) for child in children]


def _settle(percent: int):
    """Rows sorted by pivot, salt and kind: the pivot's set (kind 0), then the sets to compare with it."""

    def links(pivot, members) -> list[tuple[int, int]]:
        if pivot is None or not members:
            return []
        own, size, grams = pivot
        return [(own, other) for other in PrefixTree(members).linked(size, set(grams), percent)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, pivot, members, out = None, None, [], []
        for batch in batches:
            cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("pivot", "salt", "kind", "id", "n")]
            grams = batch.column("grams")
            for lo, hi in runs(cols[0], cols[1]):
                now = (int(cols[0][lo]), int(cols[1][lo]))
                if now != key:
                    out += links(pivot, members)
                    key, pivot, members = now, None, []
                for i in range(lo, hi):
                    row = (int(cols[3][i]), int(cols[4][i]), grams[i].as_py())
                    if cols[2][i] == 0:
                        pivot = row
                    else:
                        members.append(row)
                if len(members) >= 4 * TREE_SETS and pivot is not None:
                    out += links(pivot, members)
                    members = []
        out += links(pivot, members)
        yield pa.RecordBatch.from_pydict({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    return run


def _settled(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the (pivot, id) pairs that are links. A pivot with many partners is dealt to several trees by salt."""
    many = pairs.groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / TREE_SETS).cast("int").alias("salts"))
    salted = stage(pairs.join(many, "pivot").select(
        "pivot", "id", F.pmod(F.xxhash64("id"), F.col("salts")).cast("int").alias("salt")))
    others = salted.join(sets, "id").select("pivot", "salt", F.lit(1).alias("kind"), "id", "n", "grams")
    pivots = salted.select("pivot", "salt").distinct().join(sets.withColumnRenamed("id", "pivot"), "pivot").select(
        "pivot", "salt", F.lit(0).alias("kind"), F.col("pivot").alias("id"), "n", "grams")
    dealt = pivots.unionByName(others).repartition(tasks(pairs), "pivot", "salt").sortWithinPartitions("pivot", "salt", "kind")
    return dealt.mapInArrow(_settle(percent), "a long, b long")


def _feasible(percent: int):
    """Rows sorted by n-gram, block pair and side. The pairs of a block pair that may still reach the bound, of different components.

    A pair is listed at its first common n-gram if anywhere: there nothing before adds to the overlap.
    """
    whole = 100 + percent

    def pairs(c: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        left, right = (c[2] == 0, c[2] == 1) if c[0][0] != c[1][0] else (slice(None), slice(None))
        total = c[4][left][:, None] + c[4][right][None, :]
        rest = c[5] - c[6]
        fit = np.minimum(rest[left][:, None], rest[right][None, :]) * whole >= percent * total
        x, y = np.nonzero(fit & (c[7][left][:, None] != c[7][right][None, :]))
        a, b = c[3][left][x], c[3][right][y]
        return np.minimum(a, b), np.maximum(a, b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        names = ("i", "j", "side", "id", "n", "s", "pos", "component", "gram")

        def flush(columns, cuts):
            found = [pairs([x[lo:hi] for x in columns]) for lo, hi in cuts if hi - lo > 1]
            if found:
                yield pa.RecordBatch.from_pydict({"pivot": np.concatenate([f[0] for f in found]), "id": np.concatenate([f[1] for f in found])})

        for batch in batches:
            now = [batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in names]
            columns = now if held is None else [np.concatenate(x) for x in zip(held, now)]
            cuts = list(runs(columns[8], columns[0], columns[1]))
            if not cuts:
                continue
            yield from flush(columns, cuts[:-1])
            held = [x[cuts[-1][0]:] for x in columns]  # the last block pair may go on in the next batch
        if held is not None:
            yield from flush(held, [(0, len(held[0]))])

    return run


def join(reviews: DataFrame, percent: int = 85, width: int = 4, review_case_id: str = "review_case_id",
         comment: str = "safe_comment") -> DataFrame:
    """Number of n-grams and component of every comment, linked where 100 * intersection >= percent * union.

    Returns the id, ``n_shingles`` and ``component_id``, the smallest id reachable over links, itself included, one row per input
    row. Ids are whole numbers or texts, as the project's own are; a null id takes part as the largest of all. Empty and missing
    comments are linked with nothing and are components of their own. Rows that repeat an id are one node of the links; such a row
    shows its own set's size and the id's component. Other columns are ignored. Texts are read four times and shuffled once, to be
    joined with the few that may have a partner; text ids are numbered in their order first, which shuffles them once more.
    """
    if not isinstance(reviews.schema[review_case_id].dataType, T.StringType):
        return _join_numbers(reviews, percent, width, review_case_id, comment)
    named = reviews.select(F.col(f"`{review_case_id}`").alias("name"), F.col(f"`{comment}`").alias("text"))
    numbers = stage(row_index(named.filter("name IS NOT NULL").select("name").distinct(), ["name"], "number"))
    joined = _join_numbers(named.join(numbers, "name", "left"), percent, width, "number", "text")
    of = numbers.withColumnsRenamed({"number": "component_id", "name": "component"})
    return joined.join(numbers, "number", "left").join(of, "component_id", "left").select(
        F.col("name").alias(review_case_id), "n_shingles", F.col("component").alias("component_id"))


def _join_numbers(reviews: DataFrame, percent: int, width: int, review_case_id: str, comment: str) -> DataFrame:
    """``join`` over whole numbers."""
    small_batches(reviews)
    none = 2 ** 63 - 1
    texts = reviews.select(F.coalesce(F.col(review_case_id).cast("long"), F.lit(none)).alias("id"), text_of(comment).alias("text"))
    slim = stage(texts.mapInArrow(_described(width, percent), "id long, n int, need int, digest binary"), slim=True)
    kinds = slim.filter("n > 0").groupBy("digest").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("need").alias("need"), F.count(F.lit(1)).alias("copies")).withColumn(
        "d", F.xxhash64("digest"))  # a set goes by the number d from here on
    # equal sets repeat the same rows: an n-gram counts as shared when sets of two digests have it
    head_rows = lambda table=None: texts.mapInArrow(_heads(width, percent, table), "digest binary, head array<long>").select(
        F.xxhash64("digest").alias("d"), F.explode("head").alias("gram"))
    shared = stage(head_rows().groupBy("gram").agg(F.min("d").alias("lo"), F.max("d").alias("hi")).filter("lo <> hi").select("gram"))
    table = reviews.sparkSession.sparkContext.broadcast(_bit_table(shared))
    held = head_rows(table).join(shared, "gram").groupBy("d").agg(F.count(F.lit(1)).alias("hits"))
    ids = stage(held.join(kinds, "d").filter(F.col("hits") >= F.col("need") * F.col("copies")).select("d", "id", "digest", "n"))
    # the whole set of one comment for each set that is left; rows that repeat that comment do no harm below
    sets = stage(texts.join(ids.select("d", "id", "digest"), "id").mapInArrow(_whole(width), "id long, grams array<long>"))
    rows = sets.select("id", F.explode("grams").alias("gram"))
    counts = rows.groupBy("gram").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    ordered = rows.join(counts, "gram").groupBy("id").agg(F.array_sort(F.collect_set(F.struct("df", "gram"))).alias("g")).select(
        "id", F.col("g.gram").alias("grams"), F.size("g").alias("s"))
    trees = stage(ordered.join(ids.select(F.col("d").alias("id"), "n"), "id").filter(F.col("s") * 100 >= F.col("n") * percent))
    release(shared, sets)
    # the part of each set that a linked set must share one n-gram of
    part = F.col("s") - F.ceil(F.col("n") * percent / 100).cast("int") + 1
    prefix = stage(trees.select("id", "n", "s", F.posexplode(F.slice("grams", F.lit(1), part)).alias("pos", "gram")))
    own = F.struct(((F.col("n") - F.col("s")) / F.col("n")).alias("own"), F.col("id").alias("id"))
    hubs = prefix.groupBy("gram").agg(F.min(own).alias("hub"), F.count(F.lit(1)).alias("c")).filter("c > 1").select(
        "gram", F.col("hub.id").alias("pivot"))
    pairs = stage(prefix.join(hubs, "gram").filter("id <> pivot").select("pivot", "id").distinct())
    nodes = trees.select("id", "n", "grams")
    links = stage(_settled(pairs, nodes, percent))
    groups = connected(links)
    labelled = prefix.join(groups.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    mixed = labelled.groupBy("gram").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("c")).filter(
        "lo <> hi").select("gram", F.ceil(F.col("c") / BLOCK_SETS).cast("int").alias("blocks"))
    open_rows = labelled.join(mixed, "gram").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    # block i meets every block j >= i: a row is on the left of its own block's pairs and on the right of earlier blocks' pairs
    b = F.col("block")
    sides = open_rows.withColumn("pair", F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.struct(
        F.least(x, b).alias("i"), F.greatest(x, b).alias("j"), F.when(x < b, 1).otherwise(0).alias("side")))))
    placed = sides.select("gram", "pair.*", "id", "n", "s", "pos", "component").repartition(tasks(reviews), "gram", "i", "j")
    more = placed.sortWithinPartitions("gram", "i", "j").mapInArrow(_feasible(percent), "pivot long, id long").distinct()
    late = _settled(stage(more.join(pairs, ["pivot", "id"], "left_anti")), nodes, percent)
    # back to comments: the smallest id of each set; equal sets are linked without a comparison
    of = lambda c: ids.select(F.col("d").alias(c), F.col("id").alias(f"{c}_id"))
    found = links.unionByName(late).join(of("a"), "a").join(of("b"), "b").select(F.col("a_id").alias("a"), F.col("b_id").alias("b"))
    same = kinds.select("digest", F.col("id").alias("rep"))
    equal = slim.join(same, "digest").filter("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b"))
    final = connected(found.unionByName(equal))
    return slim.join(final.withColumnRenamed("node", "id"), "id", "left").select(
        F.when(F.col("id") < none, F.col("id")).alias(review_case_id), F.col("n").cast("long").alias("n_shingles"),
        F.when(F.coalesce("component", "id") < none, F.coalesce("component", "id")).alias("component_id"))
