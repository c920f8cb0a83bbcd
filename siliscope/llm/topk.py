"""Exact top-k search by inner product over integer feature vectors, in vertical layout with remaining-mass bounds.

Queries and references meet in blocks: a task holds one block of queries and streams one share of the references through
it. A batch of references is laid out dimension by dimension; the inner products grow one block of dimensions at a time.
What is still to come is at most |rest of query| * |rest of reference|, so after each block of dimensions those
references whose upper bound lies under the k-th best lower bound are dropped and the others are compacted. The k-th best
score found so far is carried from batch to batch. A task returns at most k rows per query; these meet once more.

Nothing is broadcast or collected. References are copied once per block of queries, queries once per share of references.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siliscope.llm.common import pieces, runs, tasks

QUERY_BLOCK = 4096
REFERENCE_SHARE = 2048
DIMENSION_BLOCK = 8
EXACT_FLOAT = 2.0 ** 53


def quantised(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of every component as long; null if the vector or a component is null, NaN or infinite."""
    x = F.transform(vector, lambda v: v.cast("double"))
    fit = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.when(vector.isNotNull() & fit, F.transform(x, lambda v: F.floor(v * scale)))


class _Block:
    """One block of queries and the k best references of each so far."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.ids, self.k = ids, k
        self.best_scores: list[np.ndarray] = [np.empty(0, np.int64)] * len(ids)
        self.best_ids: list[np.ndarray] = [np.empty(0, ids.dtype)] * len(ids)
        order = np.argsort(-np.abs(vectors).sum(0), kind="stable")  # heavy dimensions first
        self.cuts = [order[i:i + DIMENSION_BLOCK] for i in range(0, len(order), DIMENSION_BLOCK)]
        self.vectors = vectors
        self.largest = float(np.abs(vectors).max(initial=0))

    @staticmethod
    def _rest(columns: list[np.ndarray]) -> list[np.ndarray]:
        """Length of what is left of each vector after each block of dimensions."""
        mass = [np.square(c.astype(float)).sum(0) for c in columns]
        return [np.sqrt(sum(mass[i:], np.zeros(columns[0].shape[1]))) * (1 + 1e-12) for i in range(1, len(columns) + 1)]

    def meet(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        if not self.cuts:  # vectors without components
            for i in range(len(self.ids)):
                self._take(i, np.zeros(len(ids), np.int64), ids)
            return
        # whole numbers below 2**53 are exact in a double; larger ones are summed as longs
        total = self.largest * float(np.abs(vectors).max(initial=0)) * vectors.shape[1]
        kind = np.float64 if total < EXACT_FLOAT else np.int64
        columns = [np.ascontiguousarray(vectors[:, c].T.astype(kind)) for c in self.cuts]
        rest, own_rest = self._rest(columns), self._rest([self.vectors[:, c].T for c in self.cuts])
        at = {x: [] for x in self.ids.tolist()}
        for j, x in enumerate(ids.tolist()):
            if x in at:
                at[x].append(j)
        for i, own in enumerate(self.ids.tolist()):
            floor = self.best_scores[i][-1] if len(self.best_scores[i]) == self.k else -np.inf
            alive, kept = None, columns
            if at[own]:
                alive = np.delete(np.arange(len(ids)), at[own])
                kept = [c[:, alive] for c in columns]
            sums = np.zeros(len(ids) if alive is None else len(alive), kind)
            for b in range(len(columns)):
                sums += self.vectors[i, self.cuts[b]].astype(kind) @ kept[b]
                if not len(sums):
                    break
                slack = own_rest[b][i] * (rest[b] if alive is None else rest[b][alive])
                slack = slack + 1e-9 * (np.abs(sums) + slack)
                if len(sums) >= self.k:
                    floor = max(floor, np.partition(sums - slack, len(sums) - self.k)[len(sums) - self.k])
                hold = np.flatnonzero(sums + slack >= floor)
                if len(hold) < 0.7 * len(sums) or b == len(columns) - 1:
                    alive = hold if alive is None else alive[hold]
                    sums, kept = sums[hold], [None] * (b + 1) + [c[:, hold] for c in kept[b + 1:]]
            self._take(i, sums.astype(np.int64), ids if alive is None else ids[alive])

    def _take(self, i: int, scores: np.ndarray, ids: np.ndarray) -> None:
        """Keep the k best of old and new, ties to the smaller id."""
        hold = ids != self.ids[i]
        scores, ids = np.concatenate([self.best_scores[i], scores[hold]]), np.concatenate([self.best_ids[i], ids[hold]])
        if len(scores) > self.k:
            last = np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
            above, level = np.flatnonzero(scores > last), np.flatnonzero(scores == last)
            level = level[np.argsort(ids[level], kind="stable")[:self.k - len(above)]]
            pick = np.concatenate([above, level])
            scores, ids = scores[pick], ids[pick]
        by_id = np.argsort(ids, kind="stable")
        order = by_id[np.argsort(-scores[by_id], kind="stable")]
        self.best_scores[i], self.best_ids[i] = scores[order], ids[order]

    def rows(self, schema: pa.Schema) -> pa.RecordBatch:
        n = [len(s) for s in self.best_scores]
        return pa.RecordBatch.from_arrays([
            pa.array(np.repeat(self.ids, n), schema.types[0]),
            pa.array(np.concatenate(self.best_ids), schema.types[1]),
            pa.array(np.concatenate(self.best_scores), pa.int64())], schema=schema)


def _search(k: int, id_type: pa.DataType):
    schema = pa.schema([("query_sample_id", id_type), ("neighbor_sample_id", id_type), ("score", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, block, ids, vectors = None, None, [], []
        for batch in batches:
            dims, query_block, share, kind = (batch.column(c).to_numpy(zero_copy_only=False)
                                              for c in ("dims", "query_block", "share", "kind"))
            for lo, hi in runs(dims, query_block, share, kind):
                now = (int(dims[lo]), int(query_block[lo]), int(share[lo]))
                if now != key:
                    if block is not None:
                        yield block.rows(schema)
                    key, block, ids, vectors = now, None, [], []
                part = batch.slice(lo, hi - lo)
                # equal rows are neighbours here, so of rows that share an id the first is kept
                part_ids = np.array(part.column("id").to_pylist(), object if pa.types.is_string(id_type) else None)
                matrix = part.column("vector").flatten().to_numpy().reshape(hi - lo, now[0])
                if kind[lo] == 0:
                    ids.append(part_ids)
                    vectors.append(matrix)
                    continue
                if block is None and ids:
                    own = np.concatenate(ids)
                    _, first = np.unique(own, return_index=True)
                    block = _Block(own[first], np.concatenate(vectors)[first], k)
                if block is not None:
                    block.meet(part_ids, matrix)
        if block is not None:
            yield block.rows(schema)

    return run


def top_k(wafers: DataFrame, is_query: Column, k: int = 5, sample_id: str = "sample_id", vector: str = "features") -> DataFrame:
    """The k references with the largest integer inner product for every query wafer.

    ``wafers`` holds feature rows: an id and a vector of whole numbers (see ``quantised``). Rows marked by ``is_query``
    are queries; candidates are all rows of the same vector length but the query's own. Returns ``query_sample_id, rank,
    neighbor_sample_id, score``, ranks from 1, ties to the smaller id; fewer than k rows if there are fewer candidates.

    Rows with a null id or vector take no part. Rows that repeat an id are one record: the one with the smallest vector.
    An empty table or one without queries gives no rows; other columns are ignored.
    """
    rows = wafers.select(F.col(sample_id).alias("id"), F.col(vector).cast("array<bigint>").alias("vector"),
                         F.coalesce(is_query, F.lit(False)).alias("asks")).filter("id IS NOT NULL AND vector IS NOT NULL")
    # one record per id; the aggregate is partial first, so an id that repeats often does not travel
    rows = rows.groupBy("id").agg(F.min(F.struct("vector", "asks")).alias("r"), F.max("asks").alias("asks")).select(
        "id", "r.vector", "asks").withColumn("dims", F.size("vector"))
    slim = wafers.filter(F.col(sample_id).isNotNull()).agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(is_query, 1)).alias("q")).first()
    blocks = pieces(slim.q, QUERY_BLOCK)
    shares = max(1, min(pieces(slim.n, REFERENCE_SHARE), tasks(wafers) // blocks))
    spread = F.xxhash64("id")
    asked = rows.filter("asks").select(
        "dims", F.pmod(spread, F.lit(blocks)).cast("int").alias("query_block"),
        F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("share"), F.lit(0).alias("kind"), "id", "vector")
    held = rows.select(
        "dims", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("query_block"),
        F.pmod(F.shiftrightunsigned(spread, 20), F.lit(shares)).cast("int").alias("share"), F.lit(1).alias("kind"), "id", "vector")
    placed = asked.unionByName(held).repartition(blocks * shares, "query_block", "share").sortWithinPartitions(
        "query_block", "share", "dims", "kind")
    id_name = rows.schema["id"].dataType.simpleString()
    id_type = pa.string() if id_name == "string" else pa.int64()
    found = placed.withColumn("id", F.col("id").cast("string" if id_name == "string" else "bigint")).mapInArrow(
        _search(k, id_type), f"query_sample_id {'string' if id_name == 'string' else 'bigint'}, "
        f"neighbor_sample_id {'string' if id_name == 'string' else 'bigint'}, score bigint")
    best = Window.partitionBy("query_sample_id").orderBy(F.desc("score"), "neighbor_sample_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select(
        F.col("query_sample_id").cast(id_name), "rank", F.col("neighbor_sample_id").cast(id_name), "score")
