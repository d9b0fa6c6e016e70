import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.operators import neighbors


def vectors(n, seed, dim=16, clusters=0, copies=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    if clusters:
        x = rng.normal(size=(clusters, dim))[np.arange(n) % clusters] + 0.15 * x
    if copies:
        x[:copies] = x[0]
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def frame(spark, x, start=0):
    return spark.createDataFrame(
        [(start + i, [float(v) for v in row], i % 4) for i, row in enumerate(x)], "job_id long, vec array<float>, cluster_id long")


def brute(q, p, k):
    sims = np.round(q.astype(np.float64) @ p.astype(np.float64).T, 9)
    order = np.lexsort((np.broadcast_to(np.arange(len(p)), sims.shape), -sims), axis=1)[:, :k]
    return {(i, int(j), r + 1) for i, row in enumerate(order) for r, j in enumerate(row)}


@pytest.mark.parametrize("cells,clusters,copies", [(1, 0, 0), (7, 0, 0), (9, 6, 0), (5, 3, 120), (300, 0, 0)])
def test_knn_join_is_exact(spark, cells, clusters, copies):
    q, p = vectors(90, 1, clusters=clusters), vectors(330, 2, clusters=clusters, copies=copies)
    found = neighbors.knn_join(frame(spark, q), frame(spark, p), 12, cells=cells, block_rows=50)
    assert {(r.query_id, r.neighbor_id, r["rank"]) for r in found.collect()} == brute(q, p, 12)


def test_blocks_grow_with_the_rows_and_cells_are_shipped_together(spark):
    """A row goes to about as many tasks however many rows and cells there are."""
    shipped = []
    for n in (40_000, 160_000):
        counts = np.full(n // 500, 500)
        side = int((n * n / 32) ** 0.5)
        hall, blocks = neighbors._halls(counts, np.full(len(counts), n), n, side)
        assert len(hall) == len(counts) and max(np.bincount(hall, counts)) < 2 * side
        shipped.append((sum(p for _, _, p in blocks), max(q for _, q, _ in blocks)))
    assert shipped[1] == shipped[0] and max(shipped[0]) <= 8
    q, p = vectors(700, 1), vectors(900, 2, clusters=5)
    seen = spark.sparkContext.accumulator(0)
    run = neighbors._local_top_k

    def counted(k, payload):
        inner = run(k, payload)

        def one(queries, pool):
            seen.add(1)
            return inner(queries, pool)
        return one

    neighbors._local_top_k = counted
    try:
        found = neighbors.knn_join(frame(spark, q), frame(spark, p), 7, cells=20, block_rows=4).collect()
    finally:
        neighbors._local_top_k = run
    assert {(r.query_id, r.neighbor_id, r["rank"]) for r in found} == brute(q, p, 7)
    assert 0 < seen.value < 2000                            # blocks of 4 rows would be tens of thousands


def test_a_block_is_not_copied_as_a_whole(spark):
    """What a task's Python holds beside its block does not grow with the block; a second Python step would be a second worker."""
    q, p = vectors(40, 1), vectors(200_000, 2)
    cell, ids = np.arange(len(p)) % 200, np.random.default_rng(3).permutation(len(p))
    asked = [[i, i + 50] for i in range(len(q))]

    def lists(x):
        return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))

    queries = pa.table({"_q": np.arange(len(q)), "_v": lists(q), "_cells": pa.array(asked, pa.list_(pa.int32()))})
    chunks = [slice(i, i + 10_000) for i in range(0, len(p), 10_000)]
    pool = pa.table({"_p": ids, "_v": pa.chunked_array([lists(p[c]) for c in chunks]), "_cell": cell.astype(np.int32)})
    want = set()
    for i, cells in enumerate(asked):
        rows = np.flatnonzero(np.isin(cell, cells))
        sims = np.round(p[rows].astype(np.float64) @ q[i].astype(np.float64), 9)
        want |= {(i, int(ids[rows[j]])) for j in np.lexsort((ids[rows], -sims))[:9]}
    tracemalloc.start()
    try:
        found = neighbors._local_top_k(9, False)(queries, pool)
        reached = tracemalloc.get_traced_memory()[1]
        tracemalloc.reset_peak()
        weighed = sum(int(mask.sum()) for _, _, mask in neighbors._reaching(queries, pool, 0.5))
        linked = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert set(zip(found["_q"].to_pylist(), found["_p"].to_pylist())) == want and len(found) == len(want) and weighed
    assert max(reached, linked) < p.size * 8                 # the vectors of the block as doubles, once
    join = neighbors.knn_join(frame(spark, vectors(30, 1)), frame(spark, vectors(90, 2)), 5, cells=6)
    assert join._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1       # of the queries


def test_clustered_pool_prunes_cells(spark):
    """On clustered data the second round visits few of the remaining cells."""
    p = vectors(400, 5, dim=32, clusters=8)
    found, placed = neighbors._build_cells(frame(spark, p).select(F.col("job_id").alias("_p"), F.col("vec").alias("_v")), 400, 40)
    angles = found.angles(p.astype(np.float64))
    sims = np.sort(p.astype(np.float64) @ p.astype(np.float64).T, axis=1)
    visited = found.first_round(angles, 5) | found.second_round(angles, sims[:, -5], 5)
    assert visited.sum() < 0.5 * visited.size


def test_pool_smaller_than_k_and_self_first(spark):
    p = vectors(4, 3)
    found = neighbors.knn_join(frame(spark, p), frame(spark, p), 15).collect()
    assert len(found) == 16
    assert all(r.query_id == r.neighbor_id for r in found if r["rank"] == 1)


def test_empty_pool(spark):
    p = frame(spark, vectors(3, 3))
    assert neighbors.knn_join(p, p.where("false"), 5).count() == 0


@pytest.mark.parametrize("labels,want", [
    ([1, 1, 1, -1, -1], (1, True, 1, 3)), ([1, 1, -1, -1, -1], (-1, True, 1, 2)), ([-1] * 5, (-1, False, -1, 0)),
    ([2, 2, 1, 1, -1], (-1, True, 1, 2))])
def test_vote(spark, labels, want):
    near = spark.createDataFrame([("q", float(9 - i) / 10, v) for i, v in enumerate(labels)],
                                 "query_id string, sim double, neighbor_label long")
    row = neighbors.knn_vote(near, 5, 0.60, 0.62).head()
    assert (row.cluster_id, row.sim > 0, row.winner, row.votes) == want


def test_vote_rejects_low_similarity(spark):
    near = spark.createDataFrame([("q", 0.5, 1)] * 5, "query_id string, sim double, neighbor_label long")
    row = neighbors.knn_vote(near, 5).head()
    assert row.cluster_id == -1 and row.sim == pytest.approx(0.5)


def test_similar(spark):
    p = vectors(30, 8)
    v = frame(spark, p).withColumn("job_id", F.col("job_id").cast("string")).withColumn("snapshot_date", F.lit("s1"))
    v = v.unionByName(v.where("job_id = '3'").withColumn("snapshot_date", F.lit("s2")))
    hits = neighbors.similar(v, "3", "s1", 4).orderBy("rank").collect()
    sims = p.astype(np.float64) @ p[3].astype(np.float64)
    want = [str(i) for i in np.argsort(-sims) if i != 3][:4]
    assert [r.job_id for r in hits] == want
    assert neighbors.similar(v, "3", "s1", 4, include_self=True).orderBy("rank").head().job_id == "3"
    with pytest.raises(ValueError):
        neighbors.similar(v, "missing")
    with pytest.raises(ValueError):
        neighbors.similar(v, "3", k=51)
