"""A stored index of vectors: cells around pivots, written as partitions, with the ball of each cell in a side table.

``build_index`` places every vector once.  A lookup reads the balls, the nearest cells that hold enough rows and then
only the cells that can still beat the worst hit, so its reading follows the answer and not the table.  Results are
exact.  Layout under the index's folder: ``vectors`` (by snapshot and cell), ``balls`` and ``homes`` (key to cell, by hash).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import settings as S
from tidemark.functions.vectors import as_matrix, similarities
from tidemark.operators import neighbors
from tidemark.operators.approximate import blocks
from tidemark.operators.ranking import top_n
from tidemark.session import cut, small_table

HOME_BUCKETS = 256
ROWS_PER_CELL = 4096


def build_index(vectors: DataFrame, path: str, cells: int | None = None, key: str = "job_id", vec: str = "vec",
                snapshot: str = "snapshot_date", columns: list[str] | None = None) -> None:
    """Write the index of ``vectors`` (unit length) with ``columns`` beside them; rows without a vector are left out.

    ``cells`` is the number of pivots over all snapshots, by default one for each ROWS_PER_CELL rows, at most what the
    neighbour search lets a task hold.
    """
    rows = vectors.where(F.col(vec).isNotNull()).select(
        F.col(snapshot).alias("snapshot"), F.col(key).alias("_p"), F.col(vec).alias("_v"), *(columns or []))
    spark, n = vectors.sparkSession, rows.count()
    if not n:
        raise ValueError("an index needs at least one vector")
    found, placed = neighbors._build_cells(rows, n, cells)
    placed.repartition("snapshot", "_cell").sortWithinPartitions("snapshot", "_cell", "_p").withColumnRenamed("_cell", "cell").write.partitionBy(
        "snapshot", "cell").mode("overwrite").parquet(f"{path}/vectors")
    stored = spark.read.schema(_stored_schema(rows)).parquet(f"{path}/vectors")
    bucket = F.pmod(F.xxhash64("_p"), F.lit(HOME_BUCKETS)).cast("int").alias("bucket")
    stored.select("_p", "snapshot", "cell", bucket).repartition("bucket").sortWithinPartitions("bucket", "_p").write.partitionBy(
        "bucket").mode("overwrite").parquet(f"{path}/homes")
    pivots = small_table(spark, [(i, [float(x) for x in p]) for i, p in enumerate(found.pivots)], "cell int, pivot array<double>")
    angle = _own_angle(found.pivots)
    stored.groupBy("snapshot", "cell").agg(
        F.count(F.lit(1)).alias("n"), F.min(angle(F.col("_v"), F.col("cell"))).alias("low"), F.max(angle(F.col("_v"), F.col("cell"))).alias("high")
    ).join(pivots, "cell").coalesce(1).write.mode("overwrite").parquet(f"{path}/balls")


def _stored_schema(rows: DataFrame) -> str:
    types = [(c, t) for c, t in rows.dtypes if c != "snapshot"]
    return ", ".join(f"`{c}` {t}" for c, t in types) + f", snapshot {dict(rows.dtypes)['snapshot']}, cell int"


def _own_angle(pivots: np.ndarray):
    @F.arrow_udf("double")
    def angle(values: pa.Array, cell: pa.Array) -> pa.Array:
        own = pivots[cell.to_numpy()]
        return pa.array(np.arccos(np.clip(np.einsum("ij,ij->i", as_matrix(values), own), -1.0, 1.0)))

    return angle


class VectorIndex:
    """The stored index under ``path``.  The balls, whose number was fixed at the build, are held by the driver."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        table = spark.read.parquet(f"{path}/balls").toArrow()
        self.snapshot, self.cell = np.array(table["snapshot"].to_pylist(), dtype=object), table["cell"].to_numpy()
        self.n, self.low, self.high = (table[c].to_numpy() for c in ("n", "low", "high"))
        self.pivots = as_matrix(table["pivot"].combine_chunks())
        homes = spark.read.parquet(f"{path}/homes").schema
        self.types = {f.name: f.dataType.simpleString() for f in homes}
        # partition values come back as they were typed, not as they look
        stored = spark.read.parquet(f"{path}/vectors").schema
        self.schema = ", ".join(f"`{f.name}` {self.types['snapshot'] if f.name == 'snapshot' else f.dataType.simpleString()}" for f in stored)
        self.columns = [f.name for f in stored if f.name not in ("_p", "_v", "snapshot", "cell")]

    def rows(self, snapshot, cells: np.ndarray | None = None) -> DataFrame:
        """The stored rows of one snapshot, of ``cells`` only: a filter on partitions."""
        found = self.spark.read.schema(self.schema).parquet(f"{self.path}/vectors").where(F.col("snapshot") == snapshot)
        return found if cells is None else found.where(F.col("cell").isin([int(c) for c in cells]))

    def home(self, entity) -> tuple[object, np.ndarray]:
        """The latest snapshot of an entity and its vector there."""
        bucket = self.spark.range(1).select(F.pmod(F.xxhash64(F.lit(entity).cast(self.types["_p"])), F.lit(HOME_BUCKETS)).cast("int")).head()[0]
        at = self.spark.read.parquet(f"{self.path}/homes").where((F.col("bucket") == bucket) & (F.col("_p") == entity)).orderBy(
            F.col("snapshot").desc()).select("snapshot", "cell").head()
        if at is None:
            raise ValueError(f"no vector for {entity!r}")
        vector = self.rows(at[0], np.array([at[1]])).where(F.col("_p") == entity).select("_v").head()[0]
        return at[0], np.asarray(vector, dtype=np.float64)

    def _hits(self, snapshot, cells: np.ndarray, vector: np.ndarray, entity, k: int) -> DataFrame:
        rows = self.rows(snapshot, cells)
        if entity is not None:
            rows = rows.where(F.col("_p") != entity)
        scored = rows.select("_p", *self.columns, F.round(similarities(F.col("_v"), vector[None])[0], neighbors.SIM_DIGITS).alias("similarity"))
        return scored.orderBy(F.col("similarity").desc(), "_p").limit(k)

    def plan(self, vector: np.ndarray, snapshot, k: int, entity=None) -> tuple[np.ndarray, DataFrame | None]:
        """The cells that a lookup reads, and its hits; none if the snapshot has no row."""
        mine = np.flatnonzero(self.snapshot == snapshot)
        if not len(mine):
            return np.zeros(0, dtype=np.int64), None
        angle = np.arccos(np.clip(self.pivots[mine] @ vector, -1.0, 1.0))
        order = np.argsort(np.maximum(angle - self.high[mine], 0.0) + 1e-9 * angle, kind="stable")     # balls it lies in come first
        wanted = k + (entity is not None)
        first = mine[order[:int(np.searchsorted(np.cumsum(self.n[mine][order]), wanted)) + 1]]
        near = self._hits(snapshot, self.cell[first], vector, entity, k).toArrow()                       # k rows
        bound = near["similarity"].to_numpy().min() - 10.0 ** -neighbors.SIM_DIGITS if len(near) == k else -2.0
        gap = np.maximum(np.maximum(angle - self.high[mine], self.low[mine] - angle) - neighbors._ANGLE_SLACK, 0.0)
        more = np.setdiff1d(mine[np.cos(gap) >= bound], first)
        hits = self.spark.createDataFrame(near) if len(near) else None
        if len(more):
            rest = self._hits(snapshot, self.cell[more], vector, entity, k)
            hits = rest if hits is None else hits.unionByName(rest)
        return self.cell[np.concatenate([first, more])], hits


def similar_indexed(spark: SparkSession, path: str, entity, target=None, k: int = 10, include_self: bool = False) -> DataFrame:
    """:func:`neighbors.similar` from a stored index: (snapshot_date, job_id, similarity, rank) and the stored columns."""
    if k > 50:
        raise ValueError("k is at most 50")
    index = VectorIndex(spark, path)
    home, vector = index.home(entity)
    snapshot = home if target is None else target
    cells, hits = index.plan(vector, snapshot, k, None if include_self else entity)
    names = [F.lit(snapshot).cast(index.types["snapshot"]).alias("snapshot_date"), F.col("_p").alias("job_id"), "similarity"]
    if hits is None:
        hits = index.rows(snapshot, np.zeros(0)).select("_p", *index.columns, F.lit(0.0).alias("similarity")).limit(0)
    ranked = top_n(hits.select(*names, *index.columns), ["snapshot_date"], [F.col("similarity").desc(), F.col("job_id")], k, rank="rank")
    return ranked.select("snapshot_date", "job_id", "similarity", "rank", *index.columns)


def knn_indexed(queries: DataFrame, path: str, snapshot, k: int = S.KNN_K, key: str = "job_id", vec: str = "vec",
                label: str | None = None, block_rows: int = 4096) -> DataFrame:
    """:func:`neighbors.knn_join` against one snapshot of a stored index: nothing is placed or counted again.

    A query first looks into its nearest cells that hold ``k`` rows, then into those that can beat its bound.
    """
    index = VectorIndex(queries.sparkSession, path)
    mine = np.flatnonzero(index.snapshot == snapshot)
    found = neighbors._Cells(index.pivots[mine])
    found.count, found.low, found.high = index.n[mine], index.low[mine], index.high[mine]
    number = index.cell[mine]
    labelled = [F.col(label).cast("long").alias("_label")] if label else []
    pool = index.rows(snapshot).select("_p", "_v", F.col("cell").alias("_cell"), *labelled)
    q = queries.where(F.col(vec).isNotNull()).select(F.col(key).alias("_q"), F.col(vec).alias("_v"))
    schema = f"_q {dict(q.dtypes)['_q']}, _p {index.types['_p']}, sim double" + (", _label bigint" if label else "")
    if not len(mine):
        return neighbors._named(queries.sparkSession.createDataFrame([], schema), k, label)

    def listed(mask: np.ndarray) -> pa.Array:
        inside = neighbors._list_of_cells(mask)
        return pa.ListArray.from_arrays(inside.offsets, pa.array(number[inside.values.to_numpy()].astype(np.int32)))

    @F.arrow_udf("array<int>")
    def first(values: pa.Array) -> pa.Array:
        matrix = as_matrix(values)
        return neighbors._in_chunks(len(matrix), lambda part: listed(found.first_round(found.angles(matrix[part]), k)), pa.list_(pa.int32()))

    @F.arrow_udf("array<int>")
    def rest(values: pa.Array, bound: pa.Array) -> pa.Array:
        matrix, floor = as_matrix(values), bound.to_numpy(zero_copy_only=False)
        return neighbors._in_chunks(len(matrix), lambda part: listed(
            found.second_round(found.angles(matrix[part]), floor[part], k)), pa.list_(pa.int32()))

    run = neighbors._local_top_k(k, bool(label))
    near = cut(top_n(blocks(q.withColumn("_cell", F.explode(first("_v"))), pool, block_rows, run, schema), ["_q"],
                     [F.col("sim").desc(), F.col("_p").asc()], k))
    reached = near.groupBy("_q").agg(F.min("sim").alias("_bound"), F.count(F.lit(1)).alias("_have"))
    bound = F.when(F.col("_have") >= k, F.col("_bound") - 10.0 ** -neighbors.SIM_DIGITS).otherwise(F.lit(-2.0))
    more = q.join(reached, "_q").select("_q", "_v", F.explode(rest("_v", bound)).alias("_cell"))
    return neighbors._named(near.unionByName(blocks(more, pool, block_rows, run, schema)), k, label)
