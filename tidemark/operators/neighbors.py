"""Nearest neighbours by dot product of unit vectors: one entity, or an exact top-k join of two sets.

The join never builds all pairs.  The pool is cut into cells around a few pivot vectors.  A query first
looks into its nearest cells until they hold ``k`` rows; the k-th similarity found is then a bound, and
by the triangle inequality on angles only cells that could still beat it are visited in a second round.
Queries and cells are compared in blocks of bounded size on both sides, so neither a hot cell nor a hot query
set grows a task; each block emits at most ``k`` rows per query.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import settings as S
from tidemark.functions.vectors import as_matrix, similarities
from tidemark.operators.ranking import top_n
from tidemark.session import cut, small_table

#: similarities are rounded so that equal vectors tie exactly wherever they are computed
SIM_DIGITS = 9
_ROWS_PER_CELL = 4096
_PIVOT_BYTES = 64 << 20          # what the pivots may weigh where they are gathered and sent to tasks
_ROWS_AT_ONCE, _POOL_AT_ONCE = 512, 4096      # rows of either side whose products are held at once
_TASKS_PER_CORE = 4
_SHIPPED_BYTES = 16 << 20        # what the vectors of one block may weigh
_ANGLE_SLACK = 2e-3     # arccos of a float32 unit vector with itself is off by up to 5e-4


# --- cells ------------------------------------------------------------------------------------
class _Cells:
    """Pivot vectors with the size and angle range of the pool rows nearest to each; bounded by the pivot count."""

    def __init__(self, pivots: np.ndarray):
        self.pivots = pivots
        self.count = np.zeros(len(pivots), dtype=np.int64)
        self.low = np.zeros(len(pivots))
        self.high = np.zeros(len(pivots))

    def angles(self, vectors: np.ndarray) -> np.ndarray:
        return np.arccos(np.clip(vectors @ self.pivots.T, -1.0, 1.0))

    def first_round(self, angles: np.ndarray, k: int) -> np.ndarray:
        """Mask of the nearest non-empty cells that together hold at least ``k`` pool rows."""
        order = np.argsort(angles + np.where(self.count > 0, 0.0, 10.0), axis=1, kind="stable")
        held = np.cumsum(self.count[order], axis=1)
        needed = np.concatenate([np.zeros((len(angles), 1), held.dtype), held[:, :-1]], axis=1) < k
        mask = np.zeros(angles.shape, dtype=bool)
        np.put_along_axis(mask, order, needed, axis=1)
        return mask & (self.count > 0)

    def second_round(self, angles: np.ndarray, bound: np.ndarray, k: int) -> np.ndarray:
        """Mask of the cells not seen yet whose closest possible row reaches ``bound``."""
        gap = np.maximum(np.maximum(angles - self.high, self.low - angles) - _ANGLE_SLACK, 0.0)
        return (np.cos(gap) >= bound[:, None]) & (self.count > 0) & ~self.first_round(angles, k)

    def within(self, angles: np.ndarray, reach: float) -> np.ndarray:
        """Mask of the cells that may hold a row at an angle of at most ``reach``."""
        gap = np.maximum(angles - self.high, self.low - angles) - _ANGLE_SLACK
        return (gap <= reach) & (self.count > 0)


def _list_of_cells(mask: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(mask.sum(axis=1))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.nonzero(mask)[1].astype(np.int32)))


def _in_chunks(rows: int, work: Callable[[slice], pa.Array], kind: pa.DataType) -> pa.Array:
    """Row-by-cell matrices are built for a few rows at a time."""
    parts = [work(slice(i, i + _ROWS_AT_ONCE)) for i in range(0, rows, _ROWS_AT_ONCE)]
    return pa.concat_arrays(parts) if parts else pa.array([], kind)


def _build_cells(pool: DataFrame, n_pool: int, cells: int | None) -> tuple[_Cells, DataFrame]:
    wanted = cells or max(1, n_pool // _ROWS_PER_CELL)
    width = len(pool.select("_v").head()[0])
    picked = pool.orderBy(F.xxhash64("_p"), "_p").select("_v").limit(
        max(1, min(wanted, _PIVOT_BYTES // (8 * width)))).toArrow()
    found = _Cells(np.unique(as_matrix(picked["_v"].combine_chunks()), axis=0))

    @F.arrow_udf("struct<cell:int,angle:double>")
    def nearest(values: pa.Array) -> pa.Array:
        matrix = as_matrix(values)

        def work(part: slice) -> pa.Array:
            angles = found.angles(matrix[part])
            best = angles.argmin(axis=1)
            return pa.StructArray.from_arrays(
                [pa.array(best.astype(np.int32)), pa.array(angles[np.arange(len(best)), best])], ["cell", "angle"])

        return _in_chunks(len(matrix), work, pa.struct([("cell", pa.int32()), ("angle", pa.float64())]))

    placed = pool.withColumn("_at", nearest("_v")).select("*", F.col("_at.cell").alias("_cell"), "_at.angle")
    for r in placed.groupBy("_cell").agg(
            F.count(F.lit(1)).alias("n"), F.min("angle").alias("low"), F.max("angle").alias("high")).collect():
        found.count[r["_cell"]], found.low[r["_cell"]], found.high[r["_cell"]] = r["n"], r["low"], r["high"]
    return found, placed.drop("_at", "angle")


# --- blocked top-k ----------------------------------------------------------------------------
class _Rows:
    """Vectors of an Arrow column as doubles, only those asked for at a time; the column itself is not copied."""

    def __init__(self, column: pa.ChunkedArray):
        self.chunks = [c.flatten().to_numpy(zero_copy_only=False).reshape(len(c), -1) for c in column.chunks if len(c)]
        self.ends = np.cumsum([len(c) for c in self.chunks])

    def at(self, rows: np.ndarray) -> np.ndarray:
        found = np.empty((len(rows), self.chunks[0].shape[1]))
        chunk = np.searchsorted(self.ends, rows, side="right")
        for c in np.unique(chunk):
            here = chunk == c
            found[here] = self.chunks[c][rows[here] - (self.ends[c] - len(self.chunks[c]))]
        return found


def _parts(queries: pa.Table, pool: pa.Table) -> tuple[Callable[[slice], np.ndarray], np.ndarray, list[tuple[int, slice]]]:
    """Which queries look at which parts of the pool: (mask of some queries by cell, pool rows in the order of cells, parts).

    A part is a column of the mask and a run of the ordered pool rows.  Without ``_cells`` all queries look at all rows.
    """
    if "_cells" not in queries.column_names:
        cells, order, ends = [0], np.arange(len(pool)), [len(pool)]

        def wants(some: slice) -> np.ndarray:
            return np.ones((some.stop - some.start, 1), dtype=bool)
    else:
        cell = pool["_cell"].to_numpy()
        order = np.argsort(cell, kind="stable")
        cells, counts = np.unique(cell, return_counts=True)
        ends = np.cumsum(counts).tolist()

        def wants(some: slice) -> np.ndarray:
            asked = queries["_cells"].slice(some.start, some.stop - some.start).combine_chunks()
            flat, row = asked.flatten().to_numpy(), np.repeat(np.arange(len(asked)), pc.list_value_length(asked).to_numpy())
            here = np.isin(flat, cells)
            mask = np.zeros((len(asked), len(cells)), dtype=bool)
            mask[row[here], np.searchsorted(cells, flat[here])] = True
            return mask
    starts = [0, *ends[:-1]]
    return wants, order, [(c, slice(i, min(i + _POOL_AT_ONCE, ends[c])))
                          for c in range(len(cells)) for i in range(starts[c], ends[c], _POOL_AT_ONCE)]


def _local_top_k(k: int, payload: bool):
    """Cogroup function: top ``k`` of one query block against the pool rows of one pool block that it asks for.

    Beside the two tables and the result it holds the products of ``_ROWS_AT_ONCE`` by ``_POOL_AT_ONCE`` rows only.
    """

    def run(queries: pa.Table, pool: pa.Table) -> pa.Table:
        asking, ids = queries["_q"].combine_chunks(), pool["_p"].combine_chunks()
        by_id = pc.sort_indices(ids).to_numpy().astype(np.int64)        # ties go to the smallest id
        names = ["_q", "_p", "sim", *(["_label"] if payload else [])]
        found = [pa.table([asking[:0], ids[:0], pa.array([], pa.float64()), *([pool["_label"].slice(0, 0)] if payload else [])], names)]
        if len(queries) and len(pool):
            labels = pool["_label"].combine_chunks() if payload else None
            wants, order, parts = _parts(queries, pool.drop_columns("_v").take(pa.array(by_id)))
            q, p = _Rows(queries["_v"]), _Rows(pool["_v"])
            for start in range(0, len(queries), _ROWS_AT_ONCE):
                stop = min(start + _ROWS_AT_ONCE, len(queries))
                block, asked = q.at(np.arange(start, stop)), wants(slice(start, stop))
                floor = np.full(len(block), -np.inf)            # what a row must reach to be among the first k
                r, c, s = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
                for cell, part in parts:
                    at = np.flatnonzero(asked[:, cell])
                    if not len(at):
                        continue
                    sim = block[at] @ p.at(by_id[order[part]]).T
                    least = floor[at]
                    if sim.shape[1] > k and np.isneginf(least).any():
                        kth = np.partition(sim, sim.shape[1] - k, axis=1)[:, sim.shape[1] - k]
                        least = np.maximum(least, kth - 2 * 10.0 ** -SIM_DIGITS)
                    i, j = np.nonzero(sim >= least[:, None])
                    r, c = np.concatenate([r, at[i]]), np.concatenate([c, order[part][j]])
                    s = np.concatenate([s, np.round(sim[i, j], SIM_DIGITS)])
                    best = np.lexsort((c, -s, r))
                    r, c, s = r[best], c[best], s[best]
                    place = np.arange(len(r)) - np.searchsorted(r, r, side="left")
                    last = place == k - 1
                    floor[r[last]] = s[last] - 2 * 10.0 ** -SIM_DIGITS
                    r, c, s = r[place < k], c[place < k], s[place < k]
                take_p = pa.array(by_id[c])
                found.append(pa.table([asking.take(pa.array(r + start)), ids.take(take_p), pa.array(s),
                                       *([labels.take(take_p)] if payload else [])], names))
        pa.default_memory_pool().release_unused()               # of the groups before; a reused worker would keep it
        return pa.concat_tables(found)

    return run


def _halls(counts: np.ndarray, asked: np.ndarray, n_queries: int, side: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """(hall of each cell, blocks of queries and of pool rows of each hall).  A hall is a run of cells with about ``side`` rows;
    a block has less than twice ``side`` rows."""
    _, hall = np.unique((np.cumsum(counts) - counts) // side, return_inverse=True)
    rows = np.bincount(hall, counts)
    probes = np.minimum(np.bincount(hall, asked), n_queries)
    return hall.astype(np.int32), [(h, max(1, int(m // side)), max(1, int(n // side))) for h, (m, n) in enumerate(zip(probes, rows))]


def _in_blocks(queries: DataFrame, cells: Column, pool: DataFrame, counts: np.ndarray, width: int, block_rows: int, run: Callable,
               schema: str) -> DataFrame:
    """``run`` over the queries and the pool rows of the cells that they ask for (``cells``, given to ``run`` as ``_cells``).

    Both sides are shipped in blocks, of ``block_rows`` rows or of more where there would be over ``_TASKS_PER_CORE``
    tasks a core: then a row is shipped as often however many rows there are.  A block's vectors weigh about
    ``_SHIPPED_BYTES`` at most.  A query is shipped once for all cells of a hall that it asks for.  ``cells`` and the halls
    are one Python step, and the pool's halls are joined: each further step would be another Python worker beside every task.
    """
    spark = queries.sparkSession
    asked = np.zeros(len(counts), dtype=np.int64)
    for r in queries.select(F.explode(cells).alias("_cell")).groupBy("_cell").agg(F.count(F.lit(1)).alias("n")).collect():
        asked[r["_cell"]] = r["n"]
    pairs = sum(int(m) * int(n) for m, n in zip(asked, counts))
    side = max(block_rows, min(math.isqrt(pairs // (_TASKS_PER_CORE * spark.sparkContext.defaultParallelism)), _SHIPPED_BYTES // (4 * width)))
    hall, blocks = _halls(counts, asked, queries.count(), side)
    plan = small_table(spark, blocks, "_hall int, _qblocks int, _pblocks int")
    halls = F.broadcast(small_table(spark, list(enumerate(hall.tolist())), "_cell int, _hall int"))

    def halls_asked(values: pa.Array) -> pa.Array:
        flat, row = values.flatten().to_numpy(), np.repeat(np.arange(len(values)), pc.list_value_length(values).to_numpy())
        at = np.lexsort((flat, row))
        flat, row = flat[at], row[at]
        fresh = np.ones(len(flat), dtype=bool)
        fresh[1:] = (row[1:] != row[:-1]) | (hall[flat[1:]] != hall[flat[:-1]])
        first = np.flatnonzero(fresh)
        inside = pa.ListArray.from_arrays(pa.array(np.append(first, len(flat)).astype(np.int32)), pa.array(flat.astype(np.int32)))
        ends = np.concatenate([[0], np.cumsum(np.bincount(row[first], minlength=len(values)))]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(hall[flat[first]]), inside], ["_hall", "_cells"]))

    @F.arrow_udf("array<struct<_hall:int,_cells:array<int>>>")
    def by_hall(values: pa.Array) -> pa.Array:
        return _in_chunks(len(values), lambda part: halls_asked(values[part]),
                          pa.list_(pa.struct([("_hall", pa.int32()), ("_cells", pa.list_(pa.int32()))])))

    def spread(df: DataFrame, key: str, own: str, other: str, own_name: str, other_name: str) -> DataFrame:
        mine = F.pmod(F.xxhash64(key), F.col(own)).cast("int").alias(own_name)
        theirs = F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(other_name)
        return df.join(plan, "_hall").select(*df.columns, mine, theirs)

    task = ["_hall", "_qb", "_pb"]
    asking = queries.withColumn("_at", F.explode(by_hall(cells))).select("_q", "_v", "_at._hall", "_at._cells")
    left = spread(asking, "_q", "_qblocks", "_pblocks", "_qb", "_pb").groupBy(*task)
    right = spread(pool.join(halls, "_cell"), "_p", "_pblocks", "_qblocks", "_pb", "_qb").groupBy(*task)
    return left.cogroup(right).applyInArrow(run, schema)


def knn_join(queries: DataFrame, pool: DataFrame, k: int = S.KNN_K, key: str = "job_id", vec: str = "vec",
             label: str | None = None, cells: int | None = None, block_rows: int = 4096) -> DataFrame:
    """Exact top ``min(k, pool)`` pool rows per query: (query_id, neighbor_id, sim, rank[, neighbor_label]).

    Vectors must have unit length.  ``label`` names a pool column that rides along, which saves a join.
    """
    id_type = dict(pool.dtypes)[key]
    q = queries.select(F.col(key).alias("_q"), F.col(vec).alias("_v"))
    p = pool.select(F.col(key).alias("_p"), F.col(vec).alias("_v"),
                    *([F.col(label).cast("long").alias("_label")] if label else []))
    schema = f"_q {dict(queries.dtypes)[key]}, _p {id_type}, sim double" + (", _label bigint" if label else "")
    n_pool = p.count()
    if n_pool == 0:
        return _named(queries.sparkSession.createDataFrame([], schema), k, label)
    found, placed = _build_cells(p, n_pool, cells)
    placed = cut(placed)                            # both rounds read it, and a join's null filter would place the rows twice

    @F.arrow_udf("array<int>")
    def first(values: pa.Array) -> pa.Array:
        matrix = as_matrix(values)
        return _in_chunks(len(matrix), lambda part: _list_of_cells(
            found.first_round(found.angles(matrix[part]), k)), pa.list_(pa.int32()))

    width = found.pivots.shape[1]
    near = _in_blocks(q, first("_v"), placed, found.count, width, block_rows, _local_top_k(k, bool(label)), schema)
    if int((found.count > 0).sum()) == 1:
        return _named(near, k, label)

    near = cut(top_n(near, ["_q"], [F.col("sim").desc(), F.col("_p").asc()], k))
    reached = near.groupBy("_q").agg(F.min("sim").alias("_bound"), F.count(F.lit(1)).alias("_have"))

    @F.arrow_udf("array<int>")
    def rest(values: pa.Array, bound: pa.Array) -> pa.Array:
        matrix, floor = as_matrix(values), bound.to_numpy(zero_copy_only=False)
        return _in_chunks(len(matrix), lambda part: _list_of_cells(
            found.second_round(found.angles(matrix[part]), floor[part], k)), pa.list_(pa.int32()))

    open_bound = F.when(F.col("_have") >= k, F.col("_bound") - 10.0 ** -SIM_DIGITS).otherwise(F.lit(-2.0))
    more = q.join(reached, "_q").select("_q", "_v", open_bound.alias("_floor"))
    far = _in_blocks(more, rest("_v", "_floor"), placed, found.count, width, block_rows, _local_top_k(k, bool(label)), schema)
    return _named(near.unionByName(far), k, label)


def _named(candidates: DataFrame, k: int, label: str | None) -> DataFrame:
    best = top_n(candidates, ["_q"], [F.col("sim").desc(), F.col("_p").asc()], k, rank="rank")
    return best.select(
        F.col("_q").alias("query_id"), F.col("_p").alias("neighbor_id"), "sim", "rank",
        *([F.col("_label").alias("neighbor_label")] if label else []))


# --- all links at a similarity ----------------------------------------------------------------
def _reaching(queries: pa.Table, pool: pa.Table, least: float):
    """(query rows, pool rows, mask of the pairs at ``least`` or more) for a few rows at a time."""
    if not len(queries) or not len(pool):
        return
    wants, order, parts = _parts(queries, pool)
    q, p, slack = _Rows(queries["_v"]), _Rows(pool["_v"]), 10.0 ** -SIM_DIGITS
    for start in range(0, len(queries), _ROWS_AT_ONCE):
        asked = wants(slice(start, min(start + _ROWS_AT_ONCE, len(queries))))
        for cell, part in parts:
            at = start + np.flatnonzero(asked[:, cell])
            if len(at):
                sim = q.at(at) @ p.at(order[part]).T
                mask = sim >= least + slack
                i, j = np.nonzero((sim >= least - slack) & ~mask)           # only these can be rounded to either side
                mask[i, j] = np.round(sim[i, j], SIM_DIGITS) >= least
                yield at, order[part], mask


def density_links(rows: DataFrame, least: float, min_weight: int, cells: int | None = None,
                  block_rows: int = 4096) -> DataFrame:
    """Links (src, dst) among dense rows of ``rows`` (id, vec, weight) at similarity ``least`` or more.

    A row is dense if the rows at ``least`` or more, itself included, weigh ``min_weight``.  Every pair that can
    reach ``least`` is compared, in blocks, and each pair of blocks gives a spanning forest of its links: no
    component is lost, and a dense crowd never becomes all its pairs.
    """
    id_type = dict(rows.dtypes)["id"]
    pool = cut(rows.select(F.col("id").alias("_p"), F.col("vec").alias("_v"), F.col("weight").cast("long").alias("_w")))
    n = pool.count()
    if not n:
        return rows.sparkSession.createDataFrame([], f"src {id_type}, dst {id_type}")
    found, placed = _build_cells(pool, n, cells)
    reach = math.acos(min(1.0, max(-1.0, least - 10.0 ** -SIM_DIGITS)))

    @F.arrow_udf("array<int>")
    def reachable(values: pa.Array) -> pa.Array:
        matrix = as_matrix(values)
        return _in_chunks(len(matrix), lambda part: _list_of_cells(
            found.within(found.angles(matrix[part]), reach)), pa.list_(pa.int32()))

    placed = cut(placed.withColumn("_cells", reachable("_v")))

    def weigh(queries: pa.Table, others: pa.Table) -> pa.Table:
        weight, total = others["_w"].to_numpy(), np.zeros(len(queries), dtype=np.int64)
        for at, met, mask in _reaching(queries, others, least):
            total[at] += mask @ weight[met]
        return pa.table({"_q": queries["_q"], "_near": pa.array(total)})

    probes = placed.select(F.col("_p").alias("_q"), F.col("_v").alias("_v"), F.col("_cells").alias("_cells"))
    width = found.pivots.shape[1]
    near = _in_blocks(probes, F.col("_cells"), placed.drop("_cells"), found.count, width, block_rows, weigh, f"_q {id_type}, _near bigint")
    dense = cut(near.groupBy("_q").agg(F.sum("_near").alias("_near")).where(F.col("_near") >= min_weight)
                .select(F.col("_q").alias("_p")).join(placed, "_p"))

    def link(queries: pa.Table, others: pa.Table) -> pa.Table:
        ids = pa.chunked_array([*queries["_q"].chunks, *others["_p"].chunks], queries["_q"].type).combine_chunks().dictionary_encode()
        index, names = ids.indices.to_numpy(), ids.dictionary
        left, right = index[:len(queries)], index[len(queries):]
        label = np.arange(len(names))
        for at, met, mask in _reaching(queries, others, least):
            i, j = np.nonzero(mask)
            label = linked_labels(label, left[at[i]], right[met[j]])
        moved = np.flatnonzero(label != np.arange(len(names)))
        return pa.table({"src": names.take(pa.array(moved)), "dst": names.take(pa.array(label[moved]))})

    # a pair of cells is looked at from the later one
    once = dense.select(F.col("_p").alias("_q"), F.col("_v").alias("_v"), F.filter("_cells", lambda c: c <= F.col("_cell")).alias("_cells"))
    return _in_blocks(once, F.col("_cells"), dense.select("_p", "_v", "_cell"), found.count, width, block_rows, link, f"src {id_type}, dst {id_type}")


def linked_labels(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """``label`` (each item's least known companion) after also linking items ``i`` with items ``j``."""
    while True:
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            return label
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        label = label.copy()
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(label, label[label]):
            label = label[label]


# --- vote -------------------------------------------------------------------------------------
def knn_vote(neighbors: DataFrame, k: int, vote_ratio: float = S.KNN_VOTE_RATIO,
             sim_floor: float = S.KNN_SIM_FLOOR) -> DataFrame:
    """Label each query by its neighbours: (query_id, cluster_id, sim, winner, votes).

    Noise neighbours cannot win but count in the denominator; ties go to the smallest label; the mean
    similarity of the winner is kept even when the vote is rejected.
    """
    valid = F.col("neighbor_label") != S.NOISE
    tally = neighbors.groupBy("query_id", "neighbor_label").agg(
        F.count(F.lit(1)).alias("votes"), F.avg("sim").alias("mean_sim"))
    won = tally.groupBy("query_id").agg(F.max_by(
        F.when(valid, F.struct("neighbor_label", "votes", "mean_sim")),
        F.when(valid, F.struct("votes", -F.col("neighbor_label")))).alias("_w"))
    noise = F.lit(S.NOISE).cast("long")
    accepted = (F.col("_w.votes") / F.lit(float(k)) >= vote_ratio) & (F.col("_w.mean_sim") >= sim_floor)
    return won.select(
        "query_id", F.when(accepted, F.col("_w.neighbor_label")).otherwise(noise).alias("cluster_id"),
        F.coalesce("_w.mean_sim", F.lit(0.0)).alias("sim"),
        F.coalesce("_w.neighbor_label", noise).alias("winner"),
        F.coalesce("_w.votes", F.lit(0)).alias("votes"))


def assign_by_knn(vectors: DataFrame, pool: DataFrame, k: int = S.KNN_K, vote_ratio: float = S.KNN_VOTE_RATIO,
                  sim_floor: float = S.KNN_SIM_FLOOR, key: str = "job_id", cells: int | None = None) -> DataFrame:
    """Labels of ``vectors`` by majority vote over the pool's ``cluster_id``: (key, cluster_id, sim)."""
    size = min(k, pool.count())
    voted = knn_vote(knn_join(vectors, pool, k, key=key, label="cluster_id", cells=cells), max(size, 1),
                     vote_ratio, sim_floor)
    return voted.select(F.col("query_id").alias(key), "cluster_id", "sim")


# --- one entity -------------------------------------------------------------------------------
def similar(vectors: DataFrame, entity: str, target: str | None = None, k: int = 10, details: DataFrame | None = None,
            include_self: bool = False, key: str = "job_id", vec: str = "vec",
            snapshot: str = "snapshot_date") -> DataFrame:
    """The ``k`` rows of the target snapshot closest to one entity, taken from its latest snapshot."""
    if k > 50:
        raise ValueError("k is at most 50")
    home = vectors.where(F.col(key) == entity).orderBy(F.col(snapshot).desc()).select(snapshot, vec).head()
    if home is None or home[1] is None:
        raise ValueError(f"no vector for {entity!r}")
    rows = vectors.where(F.col(snapshot) == (target or home[0]))
    if not include_self:
        rows = rows.where(F.col(key) != entity)
    scored = rows.select(
        snapshot, key, F.round(similarities(F.col(vec), np.array([home[1]]))[0], SIM_DIGITS).alias("similarity"))
    hits = top_n(scored, [snapshot], [F.col("similarity").desc(), F.col(key).asc()], k, rank="rank")
    return hits if details is None else hits.join(details, [snapshot, key], "left")
