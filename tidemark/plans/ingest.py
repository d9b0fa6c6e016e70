"""From landing rows to the posting table: one snapshot, or a rebuild of all."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tidemark.operators import clean
from tidemark.session import cut
from tidemark.sources.tables import rebuild, upsert_snapshot


def ingest_snapshot(landing: DataFrame, snapshot: str, path: str, industry_classes: dict[str, str] | None = None,
                    bucket_labels: dict[str, str] | None = None) -> DataFrame:
    """Clean one snapshot, replace it in the posting table and return the audit row."""
    marked = cut(clean.clean_postings(landing, snapshot, industry_classes, bucket_labels, audit=True))
    upsert_snapshot(marked.where(~marked["_defect"]).drop("_defect"), path, snapshot)
    return clean.ingest_audit(landing, marked)


def rebuild_postings(landings: dict[str, DataFrame], path: str, industry_classes: dict[str, str] | None = None,
                     bucket_labels: dict[str, str] | None = None) -> None:
    rebuild([clean.clean_postings(df, s, industry_classes, bucket_labels) for s, df in landings.items()], path)
