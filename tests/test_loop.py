import json
import tempfile
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import clean
from tidemark.plans.analysis import Options, run_analysis
from tidemark.plans.ingest import ingest_snapshot, rebuild_postings
from tidemark.plans.reports import Reports
from tidemark.plans.skills import run_concepts
from tidemark.schema import POSTINGS, SOURCE_COLUMNS
from tidemark.operators.concepts import anchor_vectors
from tidemark.sources import tables

SNAPS = ["2026-05-19", "2026-08-02", "2026-08-20-dev"]


def world(spark):
    """Nine stable groups, one group that appears in the second snapshot and stays."""
    rng = np.random.default_rng(11)
    centers = rng.normal(size=(10, 24))
    rows, vectors = [], []
    for s, snap in enumerate(SNAPS):
        for g in range(10):
            if g == 9 and s == 0:
                continue
            first = 0 if s == 0 else (8 if s == 1 else 16)
            span = range(first, first + 30) if g < 9 else range(0, 70)
            for i in span:
                job = f"g{g}-{i:03d}"
                noise = np.random.default_rng(g * 1000 + i).normal(size=24)
                v = centers[g] + 0.15 * noise * np.linalg.norm(centers[g]) / np.sqrt(24) * 1.0
                vectors.append((snap, job, [float(x) for x in v / np.linalg.norm(v)]))
                rows.append((snap, job, f"工程師{g}", f"c{g % 4}", f"公司{g % 4}", "14_design" if g % 2 else "01_management_hr_admin",
                             "負責 Python 與 AWS 維運的工作" if g == 9 else "一般行政與文書處理的工作", f"月薪 {30 + g},000元"))
    landing = spark.createDataFrame(rows, "snapshot_date string, job_id string, job_title string, company_id string, company_name string, industry_bucket string, description string, salary_desc string")
    return landing, spark.createDataFrame(vectors, "snapshot_date string, job_id string, vec array<float>")


@pytest.fixture(scope="module")
def built(spark):
    import tempfile
    base = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    landing, vectors = world(spark)
    for s in SNAPS:
        audit = ingest_snapshot(landing.where(F.col("snapshot_date") == s), s, f"{base}/postings").head()
        assert audit.n_kept == audit.n_read
    tables.replace_table(vectors, f"{base}/vectors", "snapshot_date")
    postings = tables.read_table(spark, f"{base}/postings", POSTINGS)
    options = Options(SNAPS[0], eps=0.8, residue_eps=0.8)
    assert run_analysis(postings, tables.read_table(spark, f"{base}/vectors"), base, options) == SNAPS
    anchors = anchor_vectors(vectors.where("job_id like 'g9%'").select(F.lit("雲端／DevOps").alias("concept"), "vec"))
    run_concepts(postings, vectors, SNAPS[1], anchors, base)
    return base, Reports(spark, base), options


def test_groups_keep_their_ids(spark, built):
    base, _, _ = built
    labels = tables.read_table(spark, f"{base}/job_cluster").withColumn("g", F.substring("job_id", 2, 1))
    assert labels.groupBy("g").agg(F.countDistinct("cluster_id").alias("n")).where("n > 1").count() == 0
    assert labels.where("cluster_id = -1").count() == 0
    assert labels.where("g = '9'").select("cluster_id").distinct().head()[0] == 9
    survivors = labels.where(F.col("snapshot_date") == SNAPS[1])
    assert survivors.where("sim < 1").count() > 0


def test_emergent_group_joins_catalog_and_pool(spark, built):
    base, reports, _ = built
    new = reports.table("clusters").where("kind = 'emergent'").collect()
    assert [(r.cluster_id, r.first_seen, r.label) for r in new] == [(9, SNAPS[1], "工程師9")]
    pool = tables.read_table(spark, f"{base}/pool")
    assert pool.where(F.col("snapshot_date") == SNAPS[1]).count() == 70 and pool.count() == 340
    assert {r.label for r in reports.table("clusters").where("kind = 'reference'").collect()} == {f"工程師{g}" for g in range(9)}


def test_reports(spark, built):
    base, reports, _ = built
    meta = reports.meta()
    assert meta["snapshots"] == SNAPS and meta["n_clusters_total"] == "10" and meta["cluster_method"].startswith("density")
    status = {r.cluster_id: r.status for r in reports.clusters(SNAPS[0], SNAPS[1]).collect()}
    assert status[9] == "新生" and status[0] == "萎縮"
    flow = {(r.from_cluster, r.to_cluster): r for r in reports.cluster_flow(SNAPS[0], SNAPS[1]).collect()}
    assert flow[(-998, 9)].n == 70 and flow[(-998, 9)].from_label is None and flow[(-998, 9)].to_label == "工程師9"
    assert flow[(0, 0)].n == 22 and flow[(0, -999)].n == 8
    assert reports.cluster_flow(include_self=False).where("kind = 'stayed'").count() == 0
    stable = reports.stability().head()
    assert (stable.n_survivors, stable.agreement, stable.noise_floor) == (9 * 22 + 70, 1.0, 0.0)
    assert reports.survival(dimension="職務類別").count() == 2
    assert reports.survival().head().category == "未分類"
    assert [r.snapshot_date for r in reports.timeline().collect()] == SNAPS
    assert reports.category_series("職務類別").count() == 6
    assert reports.category_composition(SNAPS[1], dimension="職務類別").head().n == 70
    assert reports.company_shift(min_jobs=3).count() == 4
    assert reports.cluster_series(9).count() == 2 and reports.cluster_series(top=2).select("cluster_id").distinct().count() == 2
    jobs = reports.cluster_jobs(9, SNAPS[2], 7).collect()
    assert len(jobs) == 7 and all(j.job_title == "工程師9" for j in jobs)
    assert reports.health().where("present").count() >= 15 and reports.dimension_list().count() == 2
    near = reports.similar("g9-000", SNAPS[1], 5).collect()
    assert len(near) == 5 and all(r.job_id.startswith("g9") and r.job_id != "g9-000" for r in near)
    for call in (lambda: reports.clusters(limit=3001), lambda: reports.cluster_series(top=61), lambda: reports.cluster_jobs(1, limit=501),
                 lambda: reports.survival(dimension="x"), lambda: reports.company_shift(limit=2001)):
        with pytest.raises(ValueError):
            call()


def test_concept_reports(spark, built):
    _, reports, _ = built
    assert reports.concept_meta()["n_digital_jobs"] == "70" and reports.concept_meta()["n_ai_jobs"] == "0"
    by = {r.concept: r for r in reports.concepts().collect()}
    assert by["雲端／DevOps"].n == 70 and by["雲端／DevOps"].median_salary == 39000.0 and by["軟體開發"].n == 70
    assert reports.concept_examples("雲端／DevOps").count() == 10 and reports.concept_candidates("雲端／DevOps").count() == 30
    assert reports.concept_cross(min_n=5).where("concept = '雲端／DevOps'").head().share_in_concept == 1.0
    assert reports.concept_jobs("軟體開發", 5).count() == 5
    assert reports.concept_salary().head().p50 == 39000.0


def test_rerun_reuses_reference_and_gives_the_same_tables(spark, built):
    base, reports, options = built
    before = sorted(map(tuple, tables.read_table(spark, f"{base}/job_cluster").collect()))
    flow = sorted(map(tuple, reports.table("cluster_flow").collect()))
    run_analysis(reports.table("postings"), reports.table("vectors"), base, options)
    assert sorted(map(tuple, tables.read_table(spark, f"{base}/job_cluster").collect())) == before
    assert sorted(map(tuple, reports.table("cluster_flow").collect())) == flow


def test_resume_runs_only_what_changed(spark, built, folder):
    base, reports, options = built
    postings, vectors = reports.table("postings"), reports.table("vectors")
    go_on = replace(options, resume=True)
    names = ("job_cluster", "clusters", "pool", "survival", "cluster_flow", "cluster_timeseries", "flow_category_cluster", "company_shift", "assignment_stability")

    def state(at):
        return {n: sorted(repr(sorted(r.asDict().items())) for r in tables.read_table(spark, f"{at}/{n}").collect()) for n in names}

    def steps(at):
        return int(Reports(spark, at).meta()["n_steps_run"])

    run_analysis(postings, vectors.where(F.col("snapshot_date") != SNAPS[2]), folder, go_on)
    assert steps(folder) == 2
    run_analysis(postings, vectors, folder, go_on)                              # one snapshot more
    assert steps(folder) == 1 and state(folder) == state(base)
    run_analysis(postings, vectors, folder, go_on)
    assert steps(folder) == 0 and state(folder) == state(base)
    fewer = vectors.where((F.col("snapshot_date") != SNAPS[1]) | ~F.col("job_id").startswith("g9"))
    run_analysis(postings, fewer, folder, go_on)                               # the middle one changes: no emergent group there
    assert steps(folder) == 2
    whole = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    run_analysis(postings, fewer, whole, options)
    assert state(folder) == state(whole)


def test_export(spark, built, folder):
    _, reports, _ = built
    reports.export(folder)
    core = {r.name: json.loads(r.document) for r in spark.read.json(f"{folder}/core").collect()}
    assert len(core["clusters"]) == 10 and len(core["timeline"]) == 3 and "cross/職務類別" in core
    jobs = {(r.name, r.group_key): json.loads(r.document) for r in spark.read.json(f"{folder}/jobs").collect()}
    assert len(jobs[("by_cluster", "9")]) == 30 and len(jobs[("by_concept", "軟體開發")]) == 70


def test_single_snapshot_compares_with_itself(spark, built, folder):
    base, reports, options = built
    one = reports.table("vectors").where(F.col("snapshot_date") == SNAPS[0])
    run_analysis(reports.table("postings"), one, folder, options)
    single = Reports(spark, folder)
    assert {r.status for r in single.clusters().collect()} == {"持平"} and single.cluster_flow().count() == 0
    assert single.stability().count() == 0


def test_rebuild_from_landing(spark, folder):
    landing, _ = world(spark)
    rebuild_postings({s: clean.align_columns(landing.where(F.col("snapshot_date") == s), SOURCE_COLUMNS) for s in SNAPS[:2]}, f"{folder}/p")
    assert tables.read_table(spark, f"{folder}/p", POSTINGS).select("snapshot_date").distinct().count() == 2
