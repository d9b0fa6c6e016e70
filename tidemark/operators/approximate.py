"""Approximate nearest neighbours of two sets through random hyperplanes.

A row's cell in a table is the sign pattern of its products with ``bits`` hyperplanes.  A pool vector is shipped once for
each table.  A query goes to the ``probes`` patterns that ask for the least change: flipping a bit costs the distance to its
plane.  How much is compared is the caller's choice of tables, bits and probes; nothing depends on the size of the data,
no pivots or statistics are gathered first, and a crowded cell is cut into blocks on both sides.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import settings as S
from tidemark.functions.vectors import as_matrix
from tidemark.operators.neighbors import _local_top_k, _named

MOST_BITS = 24
FLIPPED_BITS = 8                 # probes are chosen among the flips of a query's so many nearest planes
_ROWS_AT_ONCE = 2048
_A, _B, _STEP = 2654435761, 40503, 65537


def hyperplanes(planes: int, width: int) -> np.ndarray:
    """Normals with components in [-1, 1) from integer arithmetic modulo 2**32, so any engine can follow them."""
    n = np.arange(planes, dtype=np.uint64)[:, None] * np.uint64(_STEP) + np.arange(width, dtype=np.uint64)[None, :] + np.uint64(1)
    return ((n * n * np.uint64(_A) + n * np.uint64(_B)) % np.uint64(1 << 32)).astype(np.float64) / (1 << 31) - 1


def _patterns(vectors: np.ndarray, tables: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Sign patterns (rows, tables) and products (rows, tables, bits)."""
    products = (vectors @ hyperplanes(tables * bits, vectors.shape[1]).T).reshape(len(vectors), tables, bits)
    return ((products >= 0) * (1 << np.arange(bits, dtype=np.int64))).sum(axis=2), products


def _probed(vectors: np.ndarray, tables: int, bits: int, probes: int) -> np.ndarray:
    """Cells (rows, tables, probes) of each query, cheapest first; equal costs by the flipped pattern's number."""
    own, products = _patterns(vectors, tables, bits)
    m = min(bits, FLIPPED_BITS)
    near = np.argsort(np.abs(products), axis=2, kind="stable")[:, :, :m]
    cost = np.take_along_axis(np.abs(products), near, axis=2)
    subsets = (np.arange(1 << m)[:, None] >> np.arange(m)) & 1
    total = cost @ subsets.T
    flips = ((1 << near.astype(np.int64)) @ subsets.T)
    order = np.lexsort((flips, total), axis=2)[:, :, :probes]
    cells = own[:, :, None] ^ np.take_along_axis(flips, order, axis=2)
    return cells + (np.arange(tables, dtype=np.int64) << bits)[None, :, None]


def _cells(vec: str, tables: int, bits: int, probes: int | None):
    """Column of the cells of a vector: its own ones, or with ``probes`` those that a query looks into."""
    @F.arrow_udf("array<bigint>")
    def cells(values: pa.Array) -> pa.Array:
        matrix, parts = as_matrix(values), [np.zeros((0, tables * (probes or 1)), dtype=np.int64)]
        for i in range(0, len(matrix), _ROWS_AT_ONCE):
            some = matrix[i:i + _ROWS_AT_ONCE]
            found = _probed(some, tables, bits, probes) if probes else _patterns(some, tables, bits)[0] + (np.arange(tables) << bits)
            parts.append(found.reshape(len(some), -1))
        found = np.concatenate(parts)
        offsets = np.arange(len(found) + 1, dtype=np.int32) * found.shape[1]
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(found.ravel()))

    return cells(vec)


def blocks(probes: DataFrame, pool: DataFrame, block_rows: int, run, schema: str) -> DataFrame:
    """``run`` over the probes and pool rows of each cell, both sides in blocks of bounded size.

    How many blocks a cell has is joined to its rows, so no list of cells reaches the driver.
    """
    def many(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("_cell").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias(name))

    plan = many(probes, "_qblocks").join(many(pool, "_pblocks"), "_cell")

    def dealt(df: DataFrame, key: str, own: str, other: str, own_name: str, other_name: str) -> DataFrame:
        mine = F.pmod(F.xxhash64(key), F.col(own)).cast("int").alias(own_name)
        theirs = F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(other_name)
        return df.join(plan, "_cell").select(*df.columns, mine, theirs)

    task = ["_cell", "_qb", "_pb"]
    left = dealt(probes, "_q", "_qblocks", "_pblocks", "_qb", "_pb").groupBy(*task)
    right = dealt(pool, "_p", "_pblocks", "_qblocks", "_pb", "_qb").groupBy(*task)
    return left.cogroup(right).applyInArrow(run, schema)


def knn_approximate(queries: DataFrame, pool: DataFrame, k: int = S.KNN_K, tables: int = 4, bits: int = 12, probes: int = 16,
                    key: str = "job_id", vec: str = "vec", label: str | None = None, block_rows: int = 4096) -> DataFrame:
    """The ``k`` closest pool rows among those that share a probed cell: (query_id, neighbor_id, sim, rank[, neighbor_label]).

    Vectors have unit length.  A query whose cells hold fewer than ``k`` rows gets fewer; rows without a vector take no
    part.  More tables or probes raise the recall, more bits lower the work.
    """
    if not 1 <= bits <= MOST_BITS or not 1 <= probes <= 1 << min(bits, FLIPPED_BITS):
        raise ValueError(f"bits lie between 1 and {MOST_BITS}, probes between 1 and 2 ** min(bits, {FLIPPED_BITS})")
    id_type = dict(pool.dtypes)[key]
    labelled = [F.col(label).cast("long").alias("_label")] if label else []
    q = queries.where(F.col(vec).isNotNull()).select(F.col(key).alias("_q"), F.col(vec).alias("_v"))
    p = pool.where(F.col(vec).isNotNull()).select(F.col(key).alias("_p"), F.col(vec).alias("_v"), *labelled)
    probed = q.withColumn("_cell", F.explode(_cells("_v", tables, bits, probes)))
    placed = p.withColumn("_cell", F.explode(_cells("_v", tables, bits, None)))
    schema = f"_q {dict(queries.dtypes)[key]}, _p {id_type}, sim double" + (", _label bigint" if label else "")
    near = blocks(probed, placed, block_rows, _local_top_k(k, bool(label)), schema)
    return _named(near.distinct() if tables > 1 else near, k, label)             # a pair met in several tables
