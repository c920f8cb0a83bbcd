"""Similar-wafer search: standardising, unit vectors and exact nearest neighbours.

The neighbour search is one plan for any size. References are assigned to the nearest of a bounded number of
pivots, about one for every CELL_ROWS rows. Neighbouring cells make up blocks of bounded size; a query first searches
the block of its own cell, which bounds its k-th distance, and then only the blocks with a cell that the triangle
inequality cannot rule out. Blocks meet as co-groups, so a vector moves once for every block it meets, not once for
every cell, and neither all pairs nor more than a block ever exist in one place. Equal vectors are searched once and
keep only the k+1 lowest ids as candidates, which leaves the result unchanged because ties go to the lower id.
"""
from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siliscope.sources.staging import stage

SIGMA_FLOOR = 1e-6
TIE_DIGITS = 9          # distances equal to this many digits are ties, the lower id comes first
BLOCK_ROWS = 32768
BLOCK_BYTES = 32 << 20  # the vectors of a block; long ones still come LONG_ROWS to a block
LONG_ROWS = 2048
PIECE_ROWS = 1024       # queries of a block that are searched in one task at least
CHUNK_VALUES = 1 << 22  # distances, or differences, a task holds at a time
PROBE_ROWS = 2048       # references that give a query without a bound its first one
CELL_ROWS = 256         # references per pivot
MAX_PIVOTS = 4096
PIVOT_BYTES = 64 << 20  # all pivots together, whatever the vector length


def finite_errors(df: DataFrame, names: list[str], id_col: str = "sample_id") -> DataFrame:
    """Cells of a feature table that are missing, not numeric or not finite, one row per problem."""
    long = df.select(F.col(id_col), *[F.col(n).cast("string").alias(n) for n in names]).unpivot(
        id_col, names, "feature", "raw")
    value = F.expr("try_cast(raw AS DOUBLE)")
    problem = (F.when(F.col("raw").isNull() | (F.trim("raw") == ""), "missing")
               .when(value.isNull(), "not numeric")
               .when(F.isnan(value) | (F.abs(value) == float("inf")), "not finite"))
    return long.withColumn("problem", problem).filter(F.col("problem").isNotNull())


def scaler(df: DataFrame, names: list[str], floor: float = SIGMA_FLOOR, flat_as_one: bool = False) -> DataFrame:
    """Mean and population deviation per feature as two arrays in one row.

    Searches floor the deviation; the encoder and PCA replace a flat feature's deviation by one instead.
    """
    def sigma(name: str) -> Column:
        sd = F.stddev_pop(name)
        return F.when(sd < floor, F.lit(1.0)).otherwise(sd) if flat_as_one else F.greatest(sd, F.lit(floor))
    return df.agg(F.array(*[F.avg(n) for n in names]).alias("mu"), F.array(*[sigma(n) for n in names]).alias("sd"))


def standardised(df: DataFrame, names: list[str], fitted: DataFrame | None = None, flat_as_one: bool = False,
                 id_col: str = "sample_id") -> DataFrame:
    """(id, vec): features scaled by the statistics of ``fitted`` (one row) or of the table itself."""
    stats = fitted if fitted is not None else scaler(df, names, flat_as_one=flat_as_one)
    row = stats.select(F.struct("mu", "sd").alias("s")).scalar()
    scaled = F.zip_with(F.zip_with(F.array(*[F.col(n).cast("double") for n in names]), F.col("_s.mu"),
                                   lambda v, m: v - m), F.col("_s.sd"), lambda v, s: v / s)
    return df.withColumn("_s", row).select(F.col(id_col).alias("id"), scaled.alias("vec"))


def vector_columns(df: DataFrame, vec: str, dim: int) -> tuple[DataFrame, list[str]]:
    names = [f"v{i:03d}" for i in range(dim)]
    return df.select("*", *[F.get(F.col(vec), F.lit(i)).cast("double").alias(n) for i, n in enumerate(names)]), names


def vector_scaler(vectors: DataFrame, flat_as_one: bool = False) -> DataFrame:
    """Mean and deviation of every position of long vectors, as two arrays per search space."""
    df = vectors if "space" in vectors.columns else vectors.withColumn("space", F.lit("all"))
    sd = F.stddev_pop("v")
    sd = F.when(sd < SIGMA_FLOOR, F.lit(1.0)).otherwise(sd) if flat_as_one else F.greatest(sd, F.lit(SIGMA_FLOOR))
    per = df.select("space", F.posexplode("vec").alias("pos", "v")).groupBy("space", "pos").agg(
        F.avg("v").alias("mu"), sd.alias("sd"))
    packed = per.groupBy("space").agg(F.array_sort(F.collect_list(F.struct("pos", "mu", "sd"))).alias("s"))
    return packed.select("space", F.col("s.mu").alias("mu"), F.col("s.sd").alias("sd"))


def standardised_vectors(vectors: DataFrame, fitted: DataFrame | None = None, flat_as_one: bool = False) -> DataFrame:
    """(id, vec[, space]) with every position scaled; for vectors too long to be handled as columns."""
    stats = fitted if fitted is not None else vector_scaler(vectors, flat_as_one)
    named = "space" in vectors.columns
    df = vectors if named else vectors.withColumn("space", F.lit("all"))
    # one row per search space
    scaled = df.join(F.broadcast(stats), "space").withColumn("vec", F.zip_with(
        F.zip_with("vec", "mu", lambda v, m: v - m), F.col("sd"), lambda v, s: v / s)).drop("mu", "sd")
    return scaled if named else scaled.drop("space")


def vector_norm(vec: Column) -> Column:
    return F.sqrt(F.aggregate(vec, F.lit(0.0), lambda acc, v: acc + v * v))


def unit_vector(vec: Column) -> Column:
    """Vector over its length, the length floored at 1e-12."""
    return F.transform(vec, lambda v: v / F.greatest(vector_norm(vec), F.lit(1e-12)))


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in vectors])


def _pivot_distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    sq = (x * x).sum(1)[:, None] + (pivots * pivots).sum(1)[None, :] - 2.0 * (x @ pivots.T)
    return np.sqrt(np.maximum(sq, 0.0))


def _best_of_block(queries: pd.DataFrame, refs: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k nearest references of each query of a block pair, exact and with ties settled by id; none beyond the query's bound.

    A matrix product tells which pairs can be within the bound, or within the k-th distance to some of the references; only
    these get their exact distance.
    """
    none = pd.DataFrame({"space": [], "query": [], "neighbor_id": [], "distance": []})
    if queries.empty or refs.empty:
        return none
    q, r = _matrix(queries["vec"]), _matrix(refs["vec"])
    known = ~np.isnan(r).any(1)  # a vector with a gap is no one's neighbour
    r, ids = r[known], refs["id"].to_numpy()[known]
    if not len(r):
        return none
    kk = min(k, len(r))
    qq = (q * q).sum(1)
    # |r|^2 - 2 q.r in one product
    left, right = np.hstack([-2.0 * q, np.ones((len(q), 1))]), np.vstack([r.T, (r * r).sum(1)])
    limits = queries["bound"].to_numpy(dtype=np.float64) ** 2
    order_of = np.empty(len(ids), dtype=np.int64)
    order_of[np.argsort(ids, kind="stable")] = np.arange(len(ids))
    spaces, names, out = queries["space"].to_numpy(), queries["query"].to_numpy(), [none]
    step, some = max(1, CHUNK_VALUES // len(r)), max(1, CHUNK_VALUES // r.shape[1])
    probe = min(len(r), max(PROBE_ROWS, kk))
    for s in range(0, len(q), step):
        sq, limit, own = left[s:s + step] @ right, limits[s:s + step], qq[s:s + step]
        free = np.isnan(limit)
        if free.any():
            limit[free] = np.maximum(np.partition(sq[free, :probe], kk - 1, axis=1)[:, kk - 1] + own[free], 0.0)
        slack = 1e-7 * (1.0 + limit + own)
        qi, ri = np.divmod(np.flatnonzero(sq <= (limit + slack - own)[:, None]), len(r))
        dist = np.empty(len(qi))
        for i in range(0, len(qi), some):
            dist[i:i + some] = np.sqrt(((q[s + qi[i:i + some]] - r[ri[i:i + some]]) ** 2).sum(1))
        order = np.lexsort((order_of[ri], np.round(dist, TIE_DIGITS), qi))
        qi, ri, dist = qi[order], ri[order], dist[order]
        starts = np.searchsorted(qi, np.arange(len(limit)))
        keep = np.arange(len(qi)) - starts[qi] < kk
        qi, ri, dist = qi[keep] + s, ri[keep], dist[keep]
        out.append(pd.DataFrame({"space": spaces[qi], "query": names[qi], "neighbor_id": ids[ri], "distance": dist}))
    return pd.concat(out[1:])


def _near_order(points: np.ndarray) -> np.ndarray:
    """The points in an order that keeps near ones together: halved along the widest axis again and again."""
    parts, done = [np.arange(len(points))], []
    while parts:
        part = parts.pop()
        if len(part) <= 2:
            done.append(part)
            continue
        axis = np.ptp(points[part], axis=0).argmax()
        part = part[np.argsort(points[part, axis], kind="stable")]
        parts += [part[len(part) // 2:], part[:len(part) // 2]]
    return np.concatenate(done)


class _Cells:
    """Pivots, radii and blocks per search space; bounded by the number of pivots, so it fits the driver."""

    def __init__(self, refs: DataFrame, spaces: dict[str, int], lengths: dict[str, int]):
        longest = max(lengths.values())
        self.rows = {s: min(BLOCK_ROWS, max(LONG_ROWS, BLOCK_BYTES // (8 * max(d, 1)))) for s, d in lengths.items()}
        afford = max(1, PIVOT_BYTES // (8 * max(longest, 1) * len(spaces)))
        counts = {s: min(MAX_PIVOTS, afford, max(1, math.ceil(n / CELL_ROWS))) for s, n in spaces.items()}
        # pivots are the rows with the smallest hashes; a bound on the hash leaves about twice as many, and 64 at least, to choose from
        share = {s: min(1.0, max(2 * counts[s], 64) / n) for s, n in spaces.items()}
        bound = F.element_at(F.create_map(*[F.lit(v) for s, x in share.items() for v in (s, int(x * (1 << 40)))]), F.col("space"))
        draw = F.pmod(F.xxhash64("id"), F.lit(1 << 40))
        chosen = refs.filter(draw < bound).select("space", draw.alias("draw"), F.col("id").cast("string").alias("name"), "vec").collect()
        self.pivots: dict[str, np.ndarray] = {}
        for s in spaces:
            rows = sorted((r for r in chosen if r["space"] == s), key=lambda r: (r["draw"], r["name"]))
            vectors = np.array([r["vec"] for r in rows], dtype=np.float64)
            whole = vectors[~np.isnan(vectors).any(1)]  # a pivot with a gap has no distances
            vectors = (whole if len(whole) else vectors)[:counts[s]]
            self.pivots[s] = vectors[_near_order(vectors)]
        self.radius: dict[str, np.ndarray] = {}
        self.starts: dict[str, list[int]] = {}  # the first cell of each block

    def assign(self, df: DataFrame) -> DataFrame:
        pivots = self.pivots

        @F.pandas_udf("cell int, to_pivot double")
        def nearest_pivot(space: pd.Series, vec: pd.Series) -> pd.DataFrame:
            cell, dist = np.zeros(len(vec), dtype=np.int32), np.zeros(len(vec))
            for s, index in space.groupby(space).groups.items():
                pos = space.index.get_indexer(index)
                d = _pivot_distances(_matrix(vec.iloc[pos]), pivots[s])
                cell[pos] = d.argmin(1)
                dist[pos] = d.min(1)
            return pd.DataFrame({"cell": cell, "to_pivot": dist})

        return df.withColumn("p", nearest_pivot("space", "vec")).select("*", "p.*").drop("p")

    def measure(self, refs: DataFrame) -> DataFrame:
        """Settle radii and blocks: (space, cell, first, parts), the blocks that share the rows of each cell.

        A block is a run of cells of bounded size; a cell of more rows is dealt out to blocks of its own.
        """
        size = {s: np.zeros(len(p), dtype=np.int64) for s, p in self.pivots.items()}
        self.radius = {s: np.zeros(len(p)) for s, p in self.pivots.items()}
        # a vector with a gap has no distance and is found by no one
        reach = F.max(F.nanvl("to_pivot", F.lit(0.0)))
        for row in refs.groupBy("space", "cell").agg(reach.alias("r"), F.count(F.lit(1)).alias("n")).collect():
            self.radius[row["space"]][row["cell"]] = row["r"]
            size[row["space"]][row["cell"]] = row["n"]
        table = []
        for s, sizes in size.items():
            starts, rows = [], self.rows[s]
            held = rows + 1
            for cell, n in enumerate(int(n) for n in sizes):
                parts = max(1, math.ceil(n / rows))
                if held + n > rows:
                    starts += [cell] * parts
                    held = 0
                held += n
                table.append((s, cell, len(starts) - parts, parts))
            self.starts[s] = starts
        return refs.sparkSession.createDataFrame(table, "space string, cell int, first int, parts int")

    def other_blocks(self, df: DataFrame) -> DataFrame:
        """Blocks beside the query's own that may hold a reference within ``bound`` of it."""
        pivots, radius, starts = self.pivots, self.radius, self.starts

        @F.pandas_udf(T.ArrayType(T.IntegerType()))
        def blocks(space: pd.Series, vec: pd.Series, bound: pd.Series, block: pd.Series) -> pd.Series:
            out: list = [None] * len(vec)
            for s, index in space.groupby(space).groups.items():
                pos = space.index.get_indexer(index)
                d = _pivot_distances(_matrix(vec.iloc[pos]), pivots[s])
                nearest = np.minimum.reduceat(d - radius[s][None, :] - 1e-6 * (1.0 + d), starts[s], axis=1)
                near = ~(nearest > bound.iloc[pos].fillna(np.inf).to_numpy(dtype=np.float64)[:, None])
                near[np.arange(len(pos)), block.iloc[pos].to_numpy()] = False
                for i, row in zip(pos, near):
                    out[i] = np.flatnonzero(row).astype(np.int32)
            return pd.Series(out)

        return df.withColumn("blocks", blocks("space", "vec", "bound", "block"))

    def block_join(self, queries: DataFrame, refs: DataFrame, k: int, id_type: str) -> DataFrame:
        """Meet the queries of a block with the references of it, in pieces of bounded size on the queries' side too."""
        # at most one row per block and space
        rows = F.element_at(F.create_map(*[F.lit(v) for s, n in self.rows.items() for v in (s, n)]), F.col("space"))
        # a few blocks still give every core a piece of the queries
        tasks = 2 * refs.sparkSession.sparkContext.defaultParallelism
        share = F.greatest(F.ceil(F.sum("n").over(Window.partitionBy(F.lit(0))) / tasks), F.lit(PIECE_ROWS))
        pieces = F.broadcast(queries.groupBy("space", "block").agg(F.count(F.lit(1)).alias("n"))
                             .select("space", "block", F.ceil(F.col("n") / F.least(rows, share)).cast("int").alias("pieces")))
        q = (queries.join(pieces, ["space", "block"])
             .withColumn("piece", F.pmod(F.xxhash64("query"), F.col("pieces")).cast("int"))
             .select("space", "block", "piece", "query", "bound", "vec"))
        r = (refs.join(pieces, ["space", "block"])
             .withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
             .select(*[F.col(c).alias(c) for c in ("space", "block", "piece", "id", "vec")]))

        def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            return _best_of_block(left, right, k)

        keys = ["space", "block", "piece"]
        return q.groupBy(*keys).cogroup(r.groupBy(*keys)).applyInPandas(
            search, f"space string, query string, neighbor_id {id_type}, distance double")


def nearest(queries: DataFrame, references: DataFrame, k: int, exclude_same_id: bool = False,
            staged: bool = False, keep_only_row: bool = False) -> DataFrame:
    """Exact k nearest references by Euclidean distance: (space, query_id, rank, neighbor_id, distance).

    Both tables hold (id, vec) and optionally ``space``, a key whose rows are searched on their own; vectors of one
    space have equal length. Rank order is (distance to nine digits, id). With ``keep_only_row`` a query whose space has
    no other reference than its own keeps that one.
    """
    if k < 1:
        raise ValueError("k must be a positive integer")
    same = queries is references

    def prepared(df: DataFrame) -> DataFrame:
        df = df if "space" in df.columns else df.withColumn("space", F.lit("all"))
        df = df.select("space", "id", F.transform("vec", lambda v: v.cast("double") + 0.0).alias("vec"))
        return df if staged else stage(df)

    refs_all = prepared(references)
    asks = refs_all if same else prepared(queries)
    id_type = refs_all.schema["id"].dataType.simpleString()
    depth = k + 1 if exclude_same_id else k
    copies = Window.partitionBy("space", "vec").orderBy("id")
    refs = refs_all.withColumn("copy", F.row_number().over(copies)).filter(F.col("copy") <= depth)
    gap = F.exists("vec", lambda v: v.isNull() | F.isnan(v))
    sizes = refs_all.groupBy("space").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("d"), F.count_if(~gap).alias("whole")).collect()
    if not sizes:
        raise ValueError("reference table is empty")
    cells = _Cells(refs_all, {r["space"]: r["n"] for r in sizes}, {r["space"]: r["d"] for r in sizes})
    refs = stage(cells.assign(refs))
    layout = F.broadcast(cells.measure(refs))  # a row per pivot

    def placed(df: DataFrame) -> DataFrame:
        return df.join(layout, ["space", "cell"]).withColumn(
            "block", F.col("first") + F.pmod(F.xxhash64("vec"), F.col("parts")).cast("int"))

    # equal vectors are asked once, under a 128-bit digest of the vector
    ask = refs.filter(F.col("copy") == 1) if same else stage(cells.assign(asks.select("space", "vec").distinct()))
    ask = placed(ask).select("space", "block", _digest().alias("query"), "vec")
    refs = placed(refs).select("space", "block", "id", "vec")
    # a space whose gaps leave fewer vectors than are asked for has no neighbours
    sparse = [r["space"] for r in sizes if r["whole"] < min(depth, r["n"])]
    if sparse:
        ask = ask.filter(~F.col("space").isin(sparse))
    best = stage(cells.block_join(ask.withColumn("bound", F.lit(None).cast("double")), refs, depth, id_type))
    wide = [s for s, starts in cells.starts.items() if len(starts) > 1]
    if wide:
        bound = best.groupBy("space", "query").agg(F.when(F.count(F.lit(1)) >= depth, F.max("distance")).alias("bound"))
        more = stage(cells.other_blocks(ask.filter(F.col("space").isin(wide)).join(bound, ["space", "query"], "left")))
        more = more.select("space", F.explode("blocks").alias("block"), "query", "vec", "bound")
        best = _merge(best.unionByName(cells.block_join(more, refs, depth, id_type)), depth)
    out = asks.withColumn("query", _digest()).select(
        "space", "query", F.col("id").alias("query_id")).join(best, ["space", "query"])
    if exclude_same_id:
        alone = [r["space"] for r in sizes if r["n"] == 1] if keep_only_row else []
        out = out.filter((F.col("query_id") != F.col("neighbor_id")) | F.col("space").isin(alone))
    rank = Window.partitionBy("space", "query_id").orderBy(F.round("distance", TIE_DIGITS), "neighbor_id")
    return (out.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= k)
            .select("space", "query_id", "rank", "neighbor_id", "distance"))


def _digest() -> Column:
    return F.concat(F.hex(F.xxhash64("space", "vec")), F.hex(F.xxhash64(F.lit("second"), "space", "vec")))


def _merge(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("space", "query").orderBy(F.round("distance", TIE_DIGITS), "neighbor_id")
    return found.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k).drop("place")


def self_neighbors(features: DataFrame, names: list[str], k: int, id_col: str = "sample_id") -> DataFrame:
    points = standardised(features, names, id_col=id_col)
    return nearest(points, points, k, exclude_same_id=True).drop("space")


def cross_neighbors(queries: DataFrame, references: DataFrame, names: list[str], k: int,
                    id_col: str = "sample_id") -> DataFrame:
    """Neighbours of one table in another; the scale is that of the references alone."""
    fitted = scaler(references, names)
    return nearest(standardised(queries, names, fitted, id_col=id_col),
                   standardised(references, names, fitted, id_col=id_col), k).drop("space")


def cosine_neighbors(queries: DataFrame, references: DataFrame, k: int, exclude_same_id: bool = True) -> DataFrame:
    """Most similar references by the cosine of (id, vec): (query_id, rank, neighbor_id, similarity).

    On unit vectors the cosine falls with the distance. A zero vector has cosine zero with everything; two extra
    coordinates give it that distance.
    """
    def lifted(df: DataFrame, zero_axis: int) -> DataFrame:
        zero = vector_norm(F.col("vec")) <= 1e-12
        extra = [F.when(zero, F.lit(float(a == zero_axis))).otherwise(F.lit(0.0)) for a in (0, 1)]
        return df.select("id", F.concat(unit_vector(F.col("vec")), F.array(*extra)).alias("vec"))

    found = nearest(lifted(queries, 0), lifted(references, 1), k, exclude_same_id, keep_only_row=True)
    return found.select("query_id", "rank", "neighbor_id",
                        (1.0 - F.col("distance") * F.col("distance") / 2.0).alias("similarity"))


def neighbors_in_spaces(features: DataFrame, spaces: dict[str, list[str]], k: int,
                        id_col: str = "sample_id") -> DataFrame:
    """One search per named column set, run as a single job over one feature table."""
    every = sorted({n for names in spaces.values() for n in names})
    at = {n: i for i, n in enumerate(every)}
    points = standardised(features, every, id_col=id_col)
    picks = F.array(*[F.struct(F.lit(s).alias("space"),
                               F.array(*[F.get("vec", F.lit(at[n])) for n in names]).alias("v"))
                      for s, names in spaces.items()])
    wide = points.select("id", F.explode(picks).alias("p")).select("p.space", "id", F.col("p.v").alias("vec"))
    return nearest(wide, wide, k, exclude_same_id=True)
