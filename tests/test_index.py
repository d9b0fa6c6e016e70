import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_neighbors import brute, frame, vectors
from tidemark.operators import approximate, neighbors, vector_index


def dated(spark, x, snapshot="s1", start=0):
    return frame(spark, x, start).withColumn("snapshot_date", F.lit(snapshot))


def files(path):
    return {os.path.join(d, f) for d, _, names in os.walk(f"{path}/vectors") for f in names if f.endswith(".parquet")}


@pytest.mark.parametrize("cells,clusters,copies", [(1, 0, 0), (12, 0, 0), (20, 10, 0), (8, 4, 150)])
def test_lookup_in_the_index_equals_a_scan(spark, folder, cells, clusters, copies):
    x = vectors(400, 3, clusters=clusters, copies=copies)
    rows = dated(spark, x[:250]).unionByName(dated(spark, x[150:], "s2", 150))
    vector_index.build_index(rows, folder, cells, columns=["cluster_id"])
    for entity, target, k in ((7, None, 10), (200, "s1", 5), (390, "s1", 50), (200, None, 3)):
        want = neighbors.similar(rows, entity, target, k).collect()
        got = vector_index.similar_indexed(spark, folder, entity, target, k).orderBy("rank").collect()
        assert [(r.job_id, r["rank"]) for r in got] == [(r.job_id, r["rank"]) for r in sorted(want, key=lambda r: r["rank"])]
        assert np.allclose([r.similarity for r in got], sorted((r.similarity for r in want), reverse=True), atol=1e-9)


def test_a_lookup_reads_few_files(spark, folder):
    x = vectors(900, 5, dim=32, clusters=30)
    vector_index.build_index(dated(spark, x), folder, 60)
    index = vector_index.VectorIndex(spark, folder)
    cells, hits = index.plan(x[4].astype(np.float64), "s1", 10, 4)
    assert hits.count() >= 10
    assert "PartitionFilters: [isnotnull(snapshot" in index.rows("s1", cells)._jdf.queryExecution().toString()
    read = {r[0] for r in index.rows("s1", cells).select(F.input_file_name()).distinct().collect()}
    assert len(read) < 0.5 * len(files(folder))


def test_lookup_edges(spark, folder):
    x = vectors(6, 1)
    rows = dated(spark, x).unionByName(frame(spark, x[:1], 99).withColumn("vec", F.lit(None).cast("array<float>")).withColumn("snapshot_date", F.lit("s1")))
    vector_index.build_index(rows, folder, 3)
    assert vector_index.similar_indexed(spark, folder, 2, "unknown").count() == 0
    assert vector_index.similar_indexed(spark, folder, 2, k=50).count() == 5
    assert vector_index.similar_indexed(spark, folder, 2, k=50, include_self=True).orderBy("rank").head()["job_id"] == 2
    with pytest.raises(ValueError):
        vector_index.similar_indexed(spark, folder, 99)
    with pytest.raises(ValueError):
        vector_index.similar_indexed(spark, folder, 2, k=51)
    with pytest.raises(ValueError):
        vector_index.build_index(rows.where("vec IS NULL"), folder)


@pytest.mark.parametrize("cells,clusters", [(9, 0), (15, 6)])
def test_batch_join_against_the_index_is_exact(spark, folder, cells, clusters):
    q, p = vectors(80, 1, clusters=clusters), vectors(300, 2, clusters=clusters)
    vector_index.build_index(dated(spark, p), folder, cells)
    found = vector_index.knn_indexed(frame(spark, q), folder, "s1", 9, block_rows=40)
    assert {(r.query_id, r.neighbor_id, r["rank"]) for r in found.collect()} == brute(q, p, 9)
    assert vector_index.knn_indexed(frame(spark, q), folder, "none", 9).count() == 0


def test_all_probes_are_exact_and_few_find_most(spark):
    q, p = vectors(60, 1, dim=32, clusters=12), vectors(600, 1, dim=32, clusters=12)
    every = approximate.knn_approximate(frame(spark, q), frame(spark, p), 8, tables=1, bits=3, probes=8, block_rows=64)
    assert {(r.query_id, r.neighbor_id, r["rank"]) for r in every.collect()} == brute(q, p, 8)
    some = approximate.knn_approximate(frame(spark, q), frame(spark, p), 8, tables=4, bits=6, probes=6).collect()
    truth = {(a, b) for a, b, _ in brute(q, p, 8)}
    assert len(truth & {(r.query_id, r.neighbor_id) for r in some}) >= 0.95 * len(truth)
    cells = approximate._patterns(p.astype(np.float64), 4, 6)[0] + (np.arange(4) << 6)
    probed = approximate._probed(q.astype(np.float64), 4, 6, 6)
    met = np.mean([[bool(set(a.ravel()) & set(b)) for b in cells] for a in probed])
    assert met < 0.6                                                         # pairs compared
    assert len({(r.query_id, r.neighbor_id) for r in some}) == len(some)       # a pair met in two tables counts once


def test_approximate_edges(spark):
    p = frame(spark, vectors(5, 1))
    none = p.limit(0)
    assert approximate.knn_approximate(none, p, 3).count() == 0 == approximate.knn_approximate(p, none, 3).count()
    with pytest.raises(ValueError):
        approximate.knn_approximate(p, p, 3, bits=2, probes=5)
