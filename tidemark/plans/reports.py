"""Every served query as a method returning a DataFrame over the tables of one base folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import settings as S
from tidemark.operators import clean, concepts, neighbors, snapshots
from tidemark.schema import DERIVED, POSTINGS, VECTORS
from tidemark.session import small_table
from tidemark.sources import export, tables
from tidemark.sources.meta import meta_dict

TABLES = ["postings", "vectors", *DERIVED]
_MEMBER_COLUMNS = ["job_title", "company_name", "bucket_label", "industry_class", "city_name", "salary_desc", "job_url"]
_CONCEPT_COLUMNS = ["job_title", "company_name", "bucket_label", "industry_class", "city_name", "salary_month_min", "job_url"]


def _limited(value: int, most: int) -> int:
    if not 0 <= value <= most:
        raise ValueError(f"limit must be between 0 and {most}")
    return value


class Reports:
    """Reads ``<base>/<table>``; a table that was never written counts as empty."""

    def __init__(self, spark: SparkSession, base: str, dimensions: dict[str, str] | None = None):
        self.spark, self.base = spark, base
        self.dimensions = dict(dimensions or S.DIMENSIONS)

    def table(self, name: str) -> DataFrame:
        schema = {"postings": POSTINGS, "vectors": VECTORS, **DERIVED}.get(name)
        return tables.read_table(self.spark, f"{self.base}/{name}", schema)

    def _pair(self, start: str | None, end: str | None) -> tuple[str, str]:
        return snapshots.resolve_pair(self.meta().get("snapshots", []), start, end)

    def _reference(self) -> str:
        return str(meta_dict(self.table("concept_meta"))["snapshot"])

    # --- basics
    def health(self) -> DataFrame:
        return tables.list_tables(self.spark, self.base, TABLES)

    def meta(self) -> dict[str, object]:
        return meta_dict(self.table("analysis_meta"), json_keys=("snapshots",))

    def timeline(self) -> DataFrame:
        return snapshots.timeline(self.table("postings")).orderBy("snapshot_date")

    def dimension_list(self) -> DataFrame:
        rows = [(k, c, *S.DIMENSION_NOTES.get(k, (None, None))) for k, c in self.dimensions.items()]
        return small_table(self.spark, rows, "key string, column string, source string, caveat string")

    def category_series(self, dimension: str | None = None) -> DataFrame:
        column = clean.resolve_dimension(dimension, self.dimensions)
        return snapshots.category_series(self.table("postings"), column).orderBy("category", "snapshot_date")

    # --- clusters
    def clusters(self, start: str | None = None, end: str | None = None, limit: int = 600) -> DataFrame:
        first, last = self._pair(start, end)
        return snapshots.cluster_change(
            self.table("clusters"), self.table("cluster_timeseries"), first, last, _limited(limit, 3000))

    def cluster_series(self, cluster_id: int | None = None, top: int = 15) -> DataFrame:
        series = snapshots.cluster_series(
            self.table("cluster_timeseries"), self.table("clusters"), cluster_id, _limited(top, 60))
        return series.orderBy("label", "snapshot_date")

    def cluster_jobs(self, cluster_id: int, snapshot: str | None = None, limit: int = 50) -> DataFrame:
        return snapshots.cluster_members(
            self.table("job_cluster"), self.table("postings"), cluster_id, _MEMBER_COLUMNS, snapshot,
            _limited(limit, 500)).orderBy(F.col("sim").desc(), "snapshot_date", "job_id")

    # --- change between snapshots
    def cluster_flow(self, start: str | None = None, end: str | None = None, min_n: int = 5,
                     include_self: bool = True) -> DataFrame:
        first, last = self._pair(start, end)
        flow = self._between("cluster_flow", first, last).where(F.col("n") >= min_n)
        if not include_self:
            flow = flow.where(F.col("kind") != "stayed")
        return snapshots.with_cluster_labels(flow, self.table("clusters")).orderBy(
            F.col("n").desc(), "from_cluster", "to_cluster")

    def _between(self, name: str, start: str, end: str) -> DataFrame:
        return self.table(name).where((F.col("from_snapshot") == start) & (F.col("to_snapshot") == end))

    def stability(self, start: str | None = None, end: str | None = None) -> DataFrame:
        return self._between("assignment_stability", *self._pair(start, end))

    def survival(self, start: str | None = None, end: str | None = None, dimension: str | None = None) -> DataFrame:
        clean.resolve_dimension(dimension, self.dimensions)
        name = dimension or next(iter(self.dimensions))
        return self._between("survival", *self._pair(start, end)).where(F.col("dimension") == name).orderBy(
            F.col("churn_rate").desc_nulls_last(), "category")

    def company_shift(self, start: str | None = None, end: str | None = None, limit: int = 200,
                      min_jobs: int = 3) -> DataFrame:
        moved = self._between("company_shift", *self._pair(start, end)).where(
            (F.col("n_from") >= min_jobs) & (F.col("n_to") >= min_jobs)
        ).orderBy(F.col("shift_score").desc(), "company_id").limit(_limited(limit, 2000))
        return snapshots.with_cluster_labels(moved, self.table("clusters"))

    def category_composition(self, snapshot: str | None = None, min_n: int = 20, dimension: str | None = None) -> DataFrame:
        clean.resolve_dimension(dimension, self.dimensions)
        name = dimension or next(iter(self.dimensions))
        mix = self.table("flow_category_cluster").where((F.col("n") >= min_n) & (F.col("dimension") == name))
        if snapshot:
            mix = mix.where(F.col("snapshot_date") == snapshot)
        return mix.join(self.table("clusters").select("cluster_id", "label"), "cluster_id", "left").orderBy(
            F.col("n").desc(), "category", "cluster_id")

    # --- concepts
    def concepts(self) -> DataFrame:
        return self.table("concept_summary").orderBy(F.col("n").desc(), "concept")

    def concept_meta(self) -> dict[str, object]:
        return meta_dict(self.table("concept_meta"))

    def _tagged_postings(self) -> DataFrame:
        return self.table("postings").where(F.col("snapshot_date") == self._reference())

    def concept_cross(self, dimension: str | None = None, min_n: int = 1) -> DataFrame:
        """By default over the job category, or over the first dimension if that one is not among them."""
        usual = "職務類別" if "職務類別" in self.dimensions else next(iter(self.dimensions))
        column = clean.resolve_dimension(dimension or usual, self.dimensions)
        return concepts.concept_cross(self.table("concept_scores"), self._tagged_postings(), column, min_n).orderBy(
            "concept", F.col("n").desc(), "category")

    def concept_examples(self, concept: str | None = None) -> DataFrame:
        return self._ranked("concept_examples", concept)

    def concept_candidates(self, concept: str | None = None) -> DataFrame:
        return self._ranked("concept_candidates", concept)

    def _ranked(self, name: str, concept: str | None) -> DataFrame:
        rows = self.table(name)
        if concept:
            rows = rows.where(F.col("concept") == concept)
        return rows.orderBy("concept", F.col("anchor_similarity").desc(), "job_id")

    def concept_jobs(self, concept: str, limit: int = 100) -> DataFrame:
        return concepts.concept_members(
            self.table("concept_scores"), self._tagged_postings(), concept, _CONCEPT_COLUMNS, limit).orderBy(
            F.col("anchor_similarity").desc(), "job_id")

    def concept_salary(self) -> DataFrame:
        return concepts.concept_pay(self.table("concept_scores"), self._tagged_postings()).orderBy(
            F.col("p50").desc(), "concept")

    # --- neighbours
    def similar(self, job_id: str, snapshot: str | None = None, k: int = 10) -> DataFrame:
        details = self.table("postings").select("snapshot_date", "job_id", *_MEMBER_COLUMNS)
        return neighbors.similar(self.table("vectors"), job_id, snapshot, k, details).orderBy("rank")

    # --- static export
    def export(self, path: str) -> None:
        """All aggregates as nested JSON under ``path``: core reports, members per cluster and per concept."""
        core = {
            "timeline": self.timeline(), "clusters": snapshots.cluster_change(
                self.table("clusters"), self.table("cluster_timeseries"), *self._pair(None, None), None), "concepts": self.concepts(),
            "concept_salary": self.concept_salary(), "concept_examples": self.concept_examples(),
            "concept_candidates": self.concept_candidates(), "dimensions": self.dimension_list(),
            "meta": self.table("analysis_meta"), "concept_meta": self.table("concept_meta")}
        for d in self.dimensions:
            core[f"cross/{d}"] = self.concept_cross(d, min_n=5)
            core[f"category_series/{d}"] = self.category_series(d)
        documents = None
        for name, df in core.items():
            piece = export.nest(df, name)
            documents = piece if documents is None else documents.unionByName(piece)
        export.write_documents(documents, f"{path}/core")
        members = self.table("job_cluster").join(
            self.table("postings").select("snapshot_date", "job_id", *_MEMBER_COLUMNS), ["snapshot_date", "job_id"])
        by_cluster = export.nest_top(
            members.join(self.table("clusters").select("cluster_id"), "cluster_id", "left_semi"), "cluster_id",
            [F.col("sim").desc(), F.col("snapshot_date"), F.col("job_id")], export.TOP_PER_CLUSTER, "by_cluster")
        hits = self.table("concept_scores").drop("snapshot_date").join(
            self._tagged_postings().select("job_id", *_CONCEPT_COLUMNS), "job_id")
        by_concept = export.nest_top(
            hits, "concept", [F.round("anchor_similarity", concepts.TIE_DIGITS).desc(), F.col("job_id")],
            export.TOP_PER_CONCEPT, "by_concept")
        export.write_documents(by_cluster.unionByName(by_concept), f"{path}/jobs")


__all__ = ["Reports", "TABLES"]
