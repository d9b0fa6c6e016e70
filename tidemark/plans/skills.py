"""The concept pass over one snapshot: scores, summary, examples, candidates, meta."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import settings as S
from tidemark.operators import concepts, encode
from tidemark.session import cut
from tidemark.sources.meta import meta_frame
from tidemark.sources.tables import replace_table

_SHOWN = ["job_title", "company_name", "bucket_label", "industry_class", "city_name", "salary_month_min", "job_url"]
_SHOWN_CANDIDATES = ["job_title", "company_name", "bucket_label", "job_url"]


def run_concepts(postings: DataFrame, vectors: DataFrame, snapshot: str, anchors: DataFrame, base: str,
                 patterns: dict[str, str] | None = None, flagged: Iterable[str] = S.AI_CONCEPTS) -> None:
    """Tag one snapshot and write the five concept tables under ``base``."""
    patterns = patterns or S.CONCEPT_PATTERNS
    flagged = list(flagged)
    at = F.col("snapshot_date") == snapshot
    rows = encode.join_vectors(postings.where(at), vectors.where(at), ["snapshot_date", "job_id"])
    text = F.concat(F.coalesce("job_title", F.lit("")), F.lit(" "), F.coalesce("description", F.lit("")))
    tagged = cut(concepts.tag_concepts(rows, text, patterns, concepts.collect_anchors(anchors, patterns)).select(
        "snapshot_date", "job_id", "description_len", *_SHOWN, "cells"))
    scores = concepts.concept_hits(tagged, ["snapshot_date", "job_id"])
    replace_table(scores, f"{base}/concept_scores")
    replace_table(concepts.concept_summary(tagged, flagged), f"{base}/concept_summary")
    replace_table(concepts.concept_examples(tagged, _SHOWN, "job_id"), f"{base}/concept_examples")
    replace_table(concepts.concept_candidates(tagged, _SHOWN_CANDIDATES, "job_id"), f"{base}/concept_candidates")
    counts = concepts.concept_counts(scores, flagged).head()
    meta = {"snapshot": snapshot, "n_jobs": str(tagged.count()), "method": "keyword", "ai_concepts": "、".join(flagged),
            "n_ai_jobs": str(counts["n_ai_jobs"]), "n_digital_jobs": str(counts["n_digital_jobs"])}
    replace_table(meta_frame(postings.sparkSession, meta), f"{base}/concept_meta")
