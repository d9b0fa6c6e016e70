"""The snapshot loop: fit the reference once, carry its clusters forward, measure what changed.

Every finished snapshot leaves a row in ``loop_steps`` with a mark of all that it depended on: the options and the rows of its
own and of every earlier snapshot.  A run with ``resume`` keeps the snapshots whose marks still hold, starts at the first one that
changed, and measures again only that snapshot, the later ones and the pairs they are in.
"""

from __future__ import annotations

import hashlib
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import settings as S
from tidemark.operators import clusters, encode, neighbors, snapshots
from tidemark.schema import DERIVED, empty
from tidemark.session import cut, small_table
from tidemark.sources.meta import meta_dict, meta_frame
from tidemark.sources.tables import read_table, replace_table, table_exists, upsert_snapshot

_CARRIED = ["company_name", "bucket_label", "industry_class"]


@dataclass
class Options:
    reference: str
    refit: bool = False
    resume: bool = False                   # keep the finished snapshots that nothing has changed for
    k: int = S.KNN_K
    vote_ratio: float = S.KNN_VOTE_RATIO
    sim_floor: float = S.KNN_SIM_FLOOR
    eps: float | None = None               # density cut of the reference
    residue_eps: float | None = None       # density cut of the residue
    grid: list[int] = field(default_factory=lambda: list(S.K_GRID))
    n_init: int = 10
    min_df: int | None = None
    dimensions: dict[str, str] = field(default_factory=lambda: dict(S.DIMENSIONS))


def reference_labels(vectors: DataFrame, base: str, options: Options) -> tuple[DataFrame, dict]:
    """Stored labels while they are for exactly the reference rows, else a new fit."""
    spark = vectors.sparkSession
    path = f"{base}/reference_labels"
    if not options.refit and table_exists(spark, path):
        stored = read_table(spark, path, DERIVED["reference_labels"])
        ids = vectors.select("job_id")
        if stored.join(ids, "job_id", "left_anti").isEmpty() and ids.join(stored, "job_id", "left_anti").isEmpty():
            quality = clusters.cluster_quality(stored).head()
            meta = read_table(spark, f"{base}/analysis_meta", DERIVED["analysis_meta"])
            method = meta_dict(meta).get("cluster_method", "density")
            return stored, {"method": method, "noise_ratio": float(quality["noise_ratio"] or 0.0),
                            "n_clusters": int(quality["n_clusters"])}
    fit = clusters.fit_reference(vectors, eps=options.eps, grid=options.grid, n_init=options.n_init)
    replace_table(fit.labels.select("job_id", F.col("cluster_id").cast("long").alias("cluster_id")), path)
    return read_table(spark, path, DERIVED["reference_labels"]), {
        "method": fit.method, "noise_ratio": fit.noise_ratio, "n_clusters": fit.n_clusters}


_STEPS = "mark string, next_id bigint, snapshot_date string"
_CATALOG = DERIVED["clusters"] + ", snapshot_date string"
_STABILITY = DERIVED["assignment_stability"] + ", snapshot_date string"


def step_marks(postings: DataFrame, vectors: DataFrame, axis: list[str], options: Options) -> list[str]:
    """A mark for each snapshot of the axis, in which those before it are folded in; one pass over each table."""
    sums: dict[str, list[str]] = {label: [] for label in axis}
    for df in (postings, vectors):
        whole = F.sum(F.xxhash64(*[F.col(c) for c in sorted(df.columns)]).cast("decimal(38,0)"))
        for r in df.where(F.col("snapshot_date").isin(axis)).groupBy("snapshot_date").agg(F.count(F.lit(1)).alias("n"), whole.alias("h")).collect():
            sums[r["snapshot_date"]].append(f"{r['n']}:{r['h']}")
    mark = repr(sorted((k, v) for k, v in asdict(options).items() if k not in ("refit", "resume")))
    out = []
    for label in axis:
        mark = hashlib.sha256("|".join([mark, label, *sums[label]]).encode()).hexdigest()
        out.append(mark)
    return out


def run_analysis(postings: DataFrame, vectors: DataFrame, base: str, options: Options) -> list[str]:
    """Write all derived tables under ``base`` and return the time axis.

    Steps are sequential over snapshots because the pool of known vectors grows.  Each step ends in a
    written partition, which is also what the next step reads, so no lineage builds up.
    """
    spark = postings.sparkSession
    axis = snapshots.snapshot_axis(vectors, options.reference)
    keys = ["snapshot_date", "job_id"]

    def rows_of(label: str) -> DataFrame:
        return encode.join_vectors(
            postings.where(F.col("snapshot_date") == label), vectors.where(F.col("snapshot_date") == label), keys)

    def stored(name: str, schema: str) -> DataFrame:
        return read_table(spark, f"{base}/{name}", schema)

    marks = step_marks(postings, vectors, axis, options)
    held = {r["snapshot_date"]: r for r in stored("loop_steps", _STEPS).collect()}                     # one row a snapshot
    kept = 0
    while options.resume and not options.refit and kept < len(axis) and axis[kept] in held and held[axis[kept]]["mark"] == marks[kept]:
        kept += 1
    pool_path, assigned_path, meta = f"{base}/pool", f"{base}/job_cluster", meta_dict(stored("analysis_meta", DERIVED["analysis_meta"]))
    if kept:
        next_id = held[axis[kept - 1]]["next_id"]
        info = {"method": meta.get("cluster_method"), "noise_ratio": meta.get("noise_ratio"), "n_clusters": meta.get("n_reference_clusters")}
    else:
        reference = rows_of(options.reference)
        labels, info = reference_labels(reference.select("job_id", "vec"), base, options)
        info["noise_ratio"] = f"{info['noise_ratio']:.4f}"
        known = reference.join(labels, "job_id").withColumn("sim", F.lit(1.0))
        catalog = cut(clusters.cluster_catalog(known, "reference", options.reference, min_df=options.min_df))
        # a new run starts all of these from the reference alone
        replace_table(_pool_rows(known), pool_path, "snapshot_date")
        replace_table(known.select("job_id", "cluster_id", "sim", "snapshot_date"), assigned_path, "snapshot_date")
        replace_table(_dated(catalog, DERIVED["clusters"], axis[0]), f"{base}/catalog_steps", "snapshot_date")
        replace_table(empty(spark, _STABILITY), f"{base}/stability_steps", "snapshot_date")
        top = catalog.agg(F.max("cluster_id")).head()[0]
        next_id = 0 if top is None else int(top) + 1
        replace_table(_step(spark, marks[0], next_id, axis[0]), f"{base}/loop_steps", "snapshot_date")

    for i in range(max(kept, 1), len(axis)):
        previous, label = axis[i - 1], axis[i]
        rows = cut(rows_of(label))
        earlier = F.col("snapshot_date").isin(axis[:i])
        pool = read_table(spark, pool_path).where(earlier).select(F.col("pool_id").alias("job_id"), "vec", "cluster_id")
        voted = neighbors.assign_by_knn(rows.select("job_id", "vec"), pool, options.k, options.vote_ratio, options.sim_floor)
        before = read_table(spark, assigned_path).where(F.col("snapshot_date") == previous)
        inherited = cut(snapshots.inherit_labels(voted, before))
        stability = _dated(snapshots.assignment_stability(inherited, previous, label), DERIVED["assignment_stability"], label)
        upsert_snapshot(stability, f"{base}/stability_steps", label)
        labelled = rows.join(inherited.select("job_id", "cluster_id", "sim"), "job_id")
        residue = labelled.where(F.col("cluster_id") == S.NOISE)
        found = clusters.discover_residue(residue.select("job_id", "vec"), options.residue_eps)
        found = cut(clusters.renumber_from(found, next_id))
        n_new = int(clusters.cluster_quality(found).head()["n_clusters"])
        fresh, members = empty(spark, DERIVED["clusters"]), residue.where("false")
        if n_new:
            members = residue.drop("cluster_id").join(found, "job_id")
            fresh = clusters.cluster_catalog(members, "emergent", label, min_df=options.min_df)
            labelled = labelled.join(found.select("job_id", F.col("cluster_id").alias("_new")), "job_id", "left")
            labelled = labelled.withColumn("cluster_id", F.coalesce("_new", "cluster_id")).drop("_new")
            next_id += n_new
        # without new clusters the snapshot leaves these two tables, should an earlier run have put it there
        upsert_snapshot(_pool_rows(members.where(F.col("cluster_id") != S.NOISE)), pool_path, label)
        upsert_snapshot(_dated(fresh, DERIVED["clusters"], label), f"{base}/catalog_steps", label)
        upsert_snapshot(labelled.select("job_id", "cluster_id", "sim", "snapshot_date"), assigned_path, label)
        upsert_snapshot(_step(spark, marks[i], next_id, label), f"{base}/loop_steps", label)

    on_axis = F.col("snapshot_date").isin(axis)
    catalog = stored("catalog_steps", _CATALOG).where(on_axis).drop("snapshot_date")
    if kept < len(axis):
        _measure(postings, vectors, base, axis, options, kept)
    replace_table(catalog, f"{base}/clusters")
    replace_table(stored("stability_steps", _STABILITY).where(on_axis).drop("snapshot_date"), f"{base}/assignment_stability")
    meta = {
        "reference_snapshot": options.reference, "snapshots": axis, "latest_snapshot": axis[-1],
        "cluster_method": info["method"], "noise_ratio": str(info["noise_ratio"]),
        "n_reference_clusters": str(info["n_clusters"]), "n_clusters_total": str(catalog.count()), "n_steps_run": str(len(axis) - kept),
        "params": {"knn_k": options.k, "vote_ratio": options.vote_ratio, "sim_floor": options.sim_floor}}
    replace_table(meta_frame(spark, meta), f"{base}/analysis_meta")
    return axis


def _dated(rows: DataFrame, schema: str, label: str) -> DataFrame:
    """``rows`` in the order and types of ``schema``, under a snapshot."""
    typed = empty(rows.sparkSession, schema).schema
    return rows.select(*(F.col(f.name).cast(f.dataType) for f in typed), F.lit(label).alias("snapshot_date"))


def _step(spark: SparkSession, mark: str, next_id: int, label: str) -> DataFrame:
    return small_table(spark, [(mark, next_id, label)], _STEPS)


def _pool_rows(rows: DataFrame) -> DataFrame:
    pool_id = F.concat_ws("/", "snapshot_date", "job_id")
    return rows.select(pool_id.alias("pool_id"), "vec", F.col("cluster_id").cast("long").alias("cluster_id"), "snapshot_date")


def _measure(postings: DataFrame, vectors: DataFrame, base: str, axis: list[str], options: Options, kept: int = 0) -> None:
    """The derived measures.  Of the first ``kept`` snapshots, rows already stored stay as they are."""
    spark = postings.sparkSession
    keys = ["snapshot_date", "job_id"]
    sides = axis[max(kept - 1, 0):]                            # the changed snapshots and the one before them
    labels = read_table(spark, f"{base}/job_cluster").where(F.col("snapshot_date").isin(sides)).select(*keys, "cluster_id", "sim")
    wanted = list(dict.fromkeys(["company_id", *_CARRIED, *options.dimensions.values()]))
    narrow = labels.join(postings.select(*keys, *wanted), keys)
    changed = F.col("snapshot_date").isin(axis[kept:])

    def put(name: str, made: DataFrame, stays) -> None:
        if kept:
            typed = _dated(made, DERIVED[name], "").drop("snapshot_date") if "snapshot_date" not in made.columns else made
            made = read_table(spark, f"{base}/{name}", DERIVED[name]).where(stays).select(*typed.columns).unionByName(typed)
        replace_table(made, f"{base}/{name}")

    old = F.col("snapshot_date").isin(axis[:kept])
    pairs = list(zip(axis, axis[1:]))[:max(kept - 1, 0)]
    old_pair = F.struct("from_snapshot", "to_snapshot").isin([F.struct(F.lit(a), F.lit(b)) for a, b in pairs]) if pairs else F.lit(False)
    put("cluster_timeseries", snapshots.cluster_timeseries(labels.where(changed)), old)
    put("flow_category_cluster", snapshots.category_cluster_mix(narrow.where(changed), options.dimensions), old)
    put("survival", snapshots.survival(narrow, sides, options.dimensions), old_pair)
    put("cluster_flow", snapshots.cluster_flow(labels, sides), old_pair)
    moved = snapshots.company_shift(narrow.join(vectors.select(*keys, "vec"), keys), sides, _CARRIED)
    put("company_shift", moved, old_pair)
