"""Exact ranked lexical search by inner products over sparse term vectors in ball trees.

A comment is the vector of its term parts, (10**9 tf) div (1000 tf + 20 m), a request the vector of its terms' weights, and the
score is their inner product. Comments meet requests in blocks: a task holds one block of requests and one slice of the comments,
builds a ball tree over the slice and visits subtrees best first. A subtree has a centroid and, for every band of terms, the
radius of its comments around it: one radius over all terms would be far too wide for a request that uses a few. No
comment below can score more than  q.centroid + sum of |q in band| radius of band;  a subtree whose bound, raised by more than the
rounding of its doubles, stays below the k-th best score so far is left out whole. Leaves are scored in whole numbers.

Two rounds: every ``FLOOR_SLICES``-th slice is searched first, and its k-th best scores are the floors the others start from.
Slices and blocks have fixed sizes, so their number grows with the tables, never their size.

Only terms that requests use matter. Which ones those are travels as a bit table of fixed size (1 MB), whose false positives only
make vectors longer: a task drops terms its block of requests does not use.
"""
from __future__ import annotations

import heapq
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siliscope.llm.common import pieces, runs, small_batches
from siliscope.sources.staging import release, stage

K = 50
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
SLICE = 4096
FLOOR_SLICES = 16
#: terms of a block of requests; a longer request is a block of its own
BLOCK_TERMS = 16384
LEAF = 32
#: half of the bands hold one frequent term each, the others share the rest evenly
BANDS = 1024
BITS = 23
#: cells of the dense part of centroids held at once
CENTROID_CELLS = 1 << 21
#: distances are taken over parts scaled by this power of the terms' weights, which leaves every inner product as it is
SCALE_POWER = 0.5
#: words remembered by a task while it looks terms up
REMEMBERED = 1 << 18

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def terms_of(text: Column) -> Column:
    """All terms of a text in order, A-Z lower-cased; none for a missing text."""
    lower = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(lower, F.lit(TERM), F.lit(0))


def _bit(term: Column) -> Column:
    return F.shiftrightunsigned(F.crc32(term.cast("binary")), 32 - BITS)


def _bit_table(vocabulary: DataFrame) -> bytes:
    """The terms' bits, at most 2**BITS: the driver receives one row per 32 bits that are set."""
    at = _bit(F.col("term"))
    words = vocabulary.select(F.shiftrightunsigned(at, 5).alias("w"), (at % 32).cast("int").alias("b")).groupBy("w").agg(
        F.bit_or(F.expr("shiftleft(1L, b)")).alias("bits")).collect()
    table = np.zeros(1 << (BITS - 5), "<u4")
    for row in words:
        table[row.w] = row.bits
    return table.tobytes()


def _count_terms(spread, id_type: pa.DataType):
    """Per comment: its number of terms, and those terms that requests may use with their frequencies."""
    schema = pa.schema([("id", id_type), ("n", pa.int64()), ("terms", pa.list_(pa.string())), ("tf", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(np.frombuffer(spread.value, np.uint8), bitorder="little").tobytes()
        shift, known, crc = 32 - BITS, {}, zlib.crc32
        for batch in batches:
            n, terms, tf, ends = [], [], [], [0]
            for raw in batch.column("raw"):
                found = Counter(raw.as_buffer().to_pybytes().translate(_FOLD).split())
                n.append(found.total())
                for term, times in found.items():
                    asked = known.get(term)
                    if asked is None:
                        if len(known) >= REMEMBERED:
                            known.clear()
                        asked = known[term] = bits[crc(term) >> shift]
                    if asked:
                        terms.append(term)
                        tf.append(times)
                ends.append(len(terms))
            offsets = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").cast(id_type), pa.array(n, pa.int64()),
                 pa.ListArray.from_arrays(offsets, pa.array(terms, pa.binary()).cast(pa.string())),
                 pa.ListArray.from_arrays(offsets, pa.array(tf, pa.int64()))], schema=schema)

    return run


def bands_of(mass: np.ndarray) -> np.ndarray:
    """The band of every term, given in how many comments of the slice it occurs."""
    order = np.argsort(-mass, kind="stable")
    out = np.empty(len(mass), np.int64)
    own = min(len(mass), BANDS // 2)
    out[order[:own]] = np.arange(own)
    rest = order[own:]
    out[rest] = own + np.arange(len(rest)) * (BANDS - own) // max(1, len(rest))
    return out


class BallTree:
    """A slice of comments as sparse rows, and its subtrees: which rows, centroid and radii.

    Every row has at least one term. ``scale`` multiplies the parts where distances are taken.
    """

    def __init__(self, cols: np.ndarray, parts: np.ndarray, starts: np.ndarray, scale: np.ndarray):
        self.scale = scale
        self.bands = bands_of(np.bincount(cols, minlength=len(scale)))
        lengths = np.diff(starts)
        by_band = np.lexsort((self.bands[cols], np.repeat(np.arange(len(lengths)), lengths)))
        self.cols, self.parts, self.starts = cols[by_band], parts[by_band], starts
        self._values = self.parts * scale[self.cols]
        self._squares = np.add.reduceat(self._values ** 2, starts[:-1])
        self.members, self.children, self.spans = np.arange(len(lengths)), [], []
        self._split()
        self.cols, self._values, _, take = self._gather(self.members)
        self.parts, self._squares = self.parts[take], self._squares[self.members]
        self.starts = np.concatenate([[0], np.cumsum(lengths[self.members])])

    def _gather(self, members: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        lengths = self.starts[members + 1] - self.starts[members]
        ends = np.cumsum(lengths)
        take = np.repeat(self.starts[members] - (ends - lengths), lengths) + np.arange(ends[-1])
        return self.cols[take], self._values[take], ends - lengths, take

    def _split(self) -> None:
        """Two far apart rows part a subtree in halves by which is nearer; spans are (first, end) among the members."""
        todo, buffer = [(0, len(self.members), -1)], np.zeros(len(self.scale))
        while todo:
            lo, hi, parent = todo.pop()
            at = len(self.spans)
            self.spans.append((lo, hi))
            self.children.append([])
            if parent >= 0:
                self.children[parent].append(at)
            if hi - lo <= LEAF:
                continue
            members = self.members[lo:hi]
            cols, values, edges, _ = self._gather(members)
            squares, mid = self._squares[members], (hi - lo) // 2

            def nearness(i: int) -> np.ndarray:
                own = slice(self.starts[members[i]], self.starts[members[i] + 1])
                buffer[self.cols[own]] = self._values[own]
                out = squares - 2 * np.add.reduceat(values * buffer[cols], edges)
                buffer[self.cols[own]] = 0
                return out

            first = int(nearness(0).argmax())
            to_first = nearness(first)
            order = np.argpartition(to_first - nearness(int(to_first.argmax())), mid)
            self.members[lo:hi] = members[order]
            todo += [(lo, lo + mid, at), (lo + mid, hi, at)]

    def _radii(self, lo: int, hi: int, centre: np.ndarray) -> np.ndarray:
        """Per band an upper bound of the squared distance from the centre. Entries of a row lie by band, so runs of equal
        bands are its parts there; where a row has none, the distance is the centre's own length."""
        own = slice(self.starts[lo], self.starts[hi])
        cols, values = self.cols[own], self._values[own]
        band = self.bands[cols]
        new = np.ones(len(band), bool)
        new[1:] = band[1:] != band[:-1]
        new[self.starts[lo:hi] - self.starts[lo]] = True
        at = np.flatnonzero(new)
        far = np.zeros(BANDS)
        np.maximum.at(far, band[at], np.add.reduceat(values * (values - 2 * centre[cols]), at))
        squares = np.bincount(self.bands, centre ** 2, BANDS)
        return far + squares + 1e-9 * (far.max() + squares.max())

    def bounds(self, requests: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Upper bound of the score of any comment below a node: requests x nodes, never below the truth."""
        out = np.zeros((len(requests), len(self.spans)))
        scaled = [w / self.scale[c] for c, w in requests]
        by_band = np.sqrt(np.array([np.bincount(self.bands[c], q ** 2, BANDS) for (c, _), q in zip(requests, scaled)]))
        step = max(1, CENTROID_CELLS // len(self.scale))
        for first in range(0, len(self.spans), step):
            block = range(first, min(first + step, len(self.spans)))
            centres, radii = np.zeros((len(block), len(self.scale))), np.zeros((BANDS, len(block)))
            for j, at in enumerate(block):
                lo, hi = self.spans[at]
                own = slice(self.starts[lo], self.starts[hi])
                centres[j] = np.bincount(self.cols[own], self._values[own], len(self.scale)) / (hi - lo)
                radii[:, j] = np.sqrt(self._radii(lo, hi, centres[j]))
            for i, (cols, _) in enumerate(requests):
                out[i, block.start:block.stop] = centres[:, cols] @ scaled[i]
            out[:, block.start:block.stop] += by_band @ radii
        return out * (1 + 1e-9) + 1

    def best(self, cols: np.ndarray, weights: np.ndarray, bounds: np.ndarray, floor: int, k: int, ranks: np.ndarray,
             dense: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores and member places of the k best, ties to the smaller rank of the id; none scores 0 or below ``floor``."""
        dense[cols] = weights
        scores, places = np.zeros(0, np.int64), np.zeros(0, np.int64)
        queue = [(-bounds[0], 0)]
        while queue:
            bound, at = heapq.heappop(queue)
            if -bound < floor:
                break
            if self.children[at]:
                for child in self.children[at]:
                    if bounds[child] >= floor:
                        heapq.heappush(queue, (-bounds[child], child))
                continue
            lo, hi = self.spans[at]
            own = slice(self.starts[lo], self.starts[hi])
            found = np.add.reduceat(dense[self.cols[own]] * self.parts[own], self.starts[lo:hi] - self.starts[lo])
            hold = np.flatnonzero(found >= max(floor, 1))
            if len(hold):
                scores, places = np.concatenate([scores, found[hold]]), np.concatenate([places, hold + lo])
                if len(scores) > k:
                    keep = np.lexsort((ranks[places], -scores))[:k]
                    scores, places = scores[keep], places[keep]
                    floor = max(floor, int(scores[-1]))
        dense[cols] = 0
        return scores, places


def _search(k: int, id_type: pa.DataType, request_type: pa.DataType):
    schema = pa.schema([("request", request_type), ("id", id_type), ("score", pa.int64())])

    def slice_rows(requests: pa.RecordBatch, comments: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked_terms, asked_ends = requests.column("terms").flatten().to_pylist(), requests.column("terms").offsets.to_numpy()
        number: dict[str, int] = {}
        asked_cols = np.array([number.setdefault(t, len(number)) for t in asked_terms], np.int64)
        asked_weights = requests.column("values").flatten().to_numpy()
        of_term = np.zeros(len(number))
        of_term[asked_cols] = asked_weights
        cols, parts, lengths, ids = [], [], [], []
        for batch in comments:
            lists = batch.column("terms")
            found = np.array([number.get(t, -1) for t in lists.flatten().to_pylist()], np.int64)
            kept = found >= 0
            before = np.concatenate([[0], np.cumsum(kept)])
            edges = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            lengths.append(np.diff(before[edges]))
            cols.append(found[kept])
            parts.append(batch.column("values").flatten().to_numpy()[kept])
            ids.append(batch.column("id"))
        lengths, held = np.concatenate(lengths), pa.concat_arrays(ids)
        some = np.flatnonzero(lengths)
        if not len(some):
            return
        held = held.take(pa.array(some))
        starts = np.concatenate([[0], np.cumsum(lengths[some])])
        scale = np.where(of_term > 0, np.maximum(of_term, 1.0) ** SCALE_POWER, 1.0)
        tree = BallTree(np.concatenate(cols), np.concatenate(parts), starts, scale)
        by_id = np.array(held.to_pylist(), object if pa.types.is_string(id_type) else np.int64)
        ranks = np.empty(len(by_id), np.int64)
        ranks[np.argsort(by_id, kind="stable")] = np.arange(len(by_id))
        ranks = ranks[tree.members]
        vectors = [(asked_cols[a:b], asked_weights[a:b]) for a, b in zip(asked_ends[:-1] - asked_ends[0], asked_ends[1:] - asked_ends[0])]
        bounds, floors = tree.bounds([(c, w.astype(float)) for c, w in vectors]), requests.column("floor").to_numpy()
        dense, which, places, scores = np.zeros(len(number), np.int64), [], [], []
        for i, (c, w) in enumerate(vectors):
            s, p = tree.best(c, w, bounds[i], int(floors[i]), k, ranks, dense)
            which.append(np.full(len(s), i))
            places.append(tree.members[p])
            scores.append(s)
        which, places = np.concatenate(which), np.concatenate(places)
        yield pa.RecordBatch.from_arrays(
            [requests.column("id").take(pa.array(which)).cast(request_type), held.take(pa.array(places)).cast(id_type),
             pa.array(np.concatenate(scores), pa.int64())], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, requests, comments = None, [], []

        def done() -> Iterator[pa.RecordBatch]:
            if requests and comments:
                yield from slice_rows(pa.Table.from_batches(requests).combine_chunks().to_batches()[0], comments)

        for batch in batches:
            block, part, kind = (batch.column(c).to_numpy() for c in ("block", "slice", "kind"))
            for lo, hi in runs(block, part, kind):
                now = (int(block[lo]), int(part[lo]))
                if now != key:
                    yield from done()
                    key, requests, comments = now, [], []
                rows = batch.slice(lo, hi - lo)
                if kind[lo] == 0:
                    requests.append(_renamed(rows, "request", request_type))
                else:
                    comments.append(_renamed(rows, "id", id_type))
        yield from done()

    return run


def _renamed(rows: pa.RecordBatch, name: str, kind: pa.DataType) -> pa.RecordBatch:
    """A plain batch with the id under one name and lists whose offsets begin at 0."""
    lists = []
    for column in (rows.column("terms"), rows.column("values")):
        offsets = column.offsets.to_numpy()
        lists.append(pa.ListArray.from_arrays(pa.array(offsets - offsets[0], pa.int32()), column.flatten()))
    return pa.RecordBatch.from_arrays([rows.column(name).cast(kind), *lists, rows.column("floor")], ["id", "terms", "values", "floor"])


def _kind(df: DataFrame, column: str) -> tuple[T.DataType, str, pa.DataType]:
    kind = df.schema[column].dataType
    return (kind, "string", pa.string()) if isinstance(kind, T.StringType) else (kind, "bigint", pa.int64())


def search(comments: DataFrame, requests: DataFrame, k: int = K, comment_id: str = "review_case_id", request_id: str = "line_no",
           text: str = "safe_comment") -> DataFrame:
    """The k best-scoring review comments for every request.

    ``comments`` and ``requests`` hold an id and a text each. Returns ``line_no, rank, review_case_id, score`` (under the
    names of the two ids): ranks from 1, highest score first, equal scores by ascending comment id, only scores above 0.

    N counts the comments with at least one term, L their terms with repeats, n those of one comment, df the comments that
    hold a term, tf its occurrences in a comment. A term weighs w = floor(1000 ln((2 N + 2) / (2 df + 1))), a comment has
    m = 50 + (50 n N) div L, and its score is the sum over the request's distinct terms of w ((10**9 tf) div (1000 tf + 20 m)).

    Rows with a null id take no part on either side. A null text has no terms. Comments that repeat an id each stand for
    themselves; requests that repeat an id are one request with the terms of all. Requests without terms or hits, and empty
    tables, give no rows. Other columns are ignored.
    """
    spark = comments.sparkSession
    small_batches(comments)
    kind, id_name, id_type = _kind(comments, comment_id)
    asked_kind, asked_name, asked_type = _kind(requests, request_id)
    asked = stage(requests.select(F.col(f"`{request_id}`").cast(asked_name).alias("request"), F.explode(terms_of(F.col(f"`{text}`"))).alias("term"))
                  .filter("request IS NOT NULL").distinct(), slim=True)
    spread = spark.sparkContext.broadcast(_bit_table(asked))
    counted = stage(comments.select(F.col(f"`{comment_id}`").cast(id_name).alias("id"),
                                    F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary").alias("raw")).filter("id IS NOT NULL")
                    .mapInArrow(_count_terms(spread, id_type), f"id {id_name}, n bigint, terms array<string>, tf array<bigint>"))
    whole = counted.agg(F.count(F.when(F.col("n") > 0, 1)).alias("N"), F.coalesce(F.sum("n"), F.lit(0)).alias("L"),
                        F.count(F.when(F.size("terms") > 0, 1)).alias("held")).first()
    schema = T.StructType([T.StructField(request_id, asked_kind), T.StructField("rank", T.IntegerType()),
                           T.StructField(comment_id, kind), T.StructField("score", T.LongType())])
    if whole.held == 0:
        release(asked, counted)
        return spark.createDataFrame([], schema)
    spread_df = counted.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weight = F.floor(F.lit(1000.0) * F.log((F.lit(2.0 * whole.N + 2)) / (F.lit(2.0) * F.col("df") + 1)))
    weighed = asked.join(spread_df, "term").groupBy("request").agg(F.collect_list(F.struct("term", weight.alias("w"))).alias("q"))
    weighed = weighed.select("request", F.col("q.term").alias("terms"), F.col("q.w").alias("values"), F.size("q").alias("size"))
    weighed = stage(_in_blocks(weighed), slim=True)
    blocks = weighed.agg(F.max("block")).first()[0]
    if blocks is None:
        release(asked, counted, weighed)
        return spark.createDataFrame([], schema)
    blocks += 1
    slices = pieces(whole.held, SLICE)
    m = F.expr(f"50 + (50 * n * {whole.N}L) div {whole.L}L")
    vectors = counted.filter(F.size("terms") > 0).withColumn("m", m).select(
        F.pmod(F.xxhash64("id", "n"), F.lit(slices)).cast("int").alias("slice"), "id", "terms",
        F.expr("transform(tf, t -> (1000000000L * t) div (1000 * t + 20 * m))").alias("values"))

    def found(requests_now: DataFrame, chosen: Column, numbers: list[int]) -> DataFrame:
        nothing = F.lit(None)
        ask = requests_now.select("block", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"), F.lit(0).alias("kind"),
                                  "request", nothing.cast(id_name).alias("id"), "terms", "values", "floor").filter(chosen)
        hold = vectors.filter(chosen).select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "slice", F.lit(1).alias("kind"),
                                             nothing.cast(asked_name).alias("request"), "id", "terms", "values", F.lit(0).cast("bigint").alias("floor"))
        placed = ask.unionByName(hold).repartition(blocks * len(numbers), "block", "slice").sortWithinPartitions("block", "slice", "kind")
        return placed.mapInArrow(_search(k, id_type, asked_type), f"request {asked_name}, id {id_name}, score bigint")

    order = Window.partitionBy("request").orderBy(F.desc("score"), "id")
    in_first = F.col("slice") % FLOOR_SLICES == 0
    first = stage(found(weighed.withColumn("floor", F.lit(1).cast("bigint")), in_first, list(range(0, slices, FLOOR_SLICES)))
                  .withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k), slim=True)
    result = first.drop("rank")
    rest = [i for i in range(slices) if i % FLOOR_SLICES]
    if rest:
        floors = first.filter(F.col("rank") == k).select("request", F.col("score").alias("least"))
        higher = weighed.join(floors, "request", "left").withColumn("floor", F.coalesce("least", F.lit(1).cast("bigint"))).drop("least")
        result = result.unionByName(found(higher, ~in_first, rest))
    return result.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
        F.col("request").cast(asked_kind).alias(request_id), "rank", F.col("id").cast(kind).alias(comment_id), "score")


def _in_blocks(weighed: DataFrame) -> DataFrame:
    """Requests in blocks of at most about BLOCK_TERMS terms: hash buckets whose number follows from the total."""
    total = weighed.agg(F.coalesce(F.sum(F.col("size").cast("bigint")), F.lit(0))).first()[0]
    return weighed.withColumn("block", F.pmod(F.xxhash64("request"), F.lit(pieces(int(total), BLOCK_TERMS))).cast("int")).drop("size")
