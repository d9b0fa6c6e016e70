"""The cleaning chain from landing rows to canonical posting rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import settings as S
from tidemark.functions import coerce, pay, text
from tidemark.operators.ranking import latest_per_key
from tidemark.schema import POSTINGS, SOURCE_COLUMNS

_TEXT_COLUMNS = [c for c in SOURCE_COLUMNS if c not in ("updated_at", "is_happiness")]


def align_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """Add the missing columns as null text so that two sources share one path."""
    missing = {c: F.lit(None).cast("string") for c in columns if c not in df.columns}
    return df.withColumns(missing) if missing else df


def align_and_union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def coerce_types(df: DataFrame) -> DataFrame:
    return df.withColumns({
        **{c: coerce.text_or_blank(F.col(c)) for c in _TEXT_COLUMNS},
        "updated_at": coerce.to_timestamp(F.col("updated_at")),
        "is_happiness": coerce.to_boolean(F.col("is_happiness"))})


def drop_stale_versions(df: DataFrame, key: str | list[str] = "job_id", updated: str = "updated_at") -> DataFrame:
    """Newest version per id, undated versions last; equal stamps are settled by a row hash."""
    keys = [key] if isinstance(key, str) else key
    tie = F.xxhash64(*[F.col(c) for c in sorted(df.columns)])
    return latest_per_key(df, keys, [F.col(updated).desc_nulls_last(), tie])


def has_defect(title: Column, length: Column, shortest: int = S.MIN_DESCRIPTION) -> Column:
    """Blank or test title, or a description under ``shortest`` characters; never null."""
    return text.is_blank_title(title) | F.coalesce(length < shortest, F.lit(True))


def lookup_class(name: Column, classes: dict[str, str] | None) -> Column:
    """Class of a trimmed name, ``未分類`` when unknown.  The name is never NFKC-normalised."""
    return F.coalesce(_map_lookup(text.strip(name), classes), F.lit(S.UNCLASSIFIED))


def lookup_bucket(key: Column, labels: dict[str, str]) -> Column:
    """Label of a bucket key; blank is ``未分類``, an unknown key passes through."""
    given = F.when(key != "", key)
    return F.coalesce(_map_lookup(given, labels), given, F.lit(S.UNCLASSIFIED))


def _map_lookup(key: Column, table: dict[str, str] | None) -> Column:
    if not table:
        return F.lit(None).cast("string")
    pairs = [F.lit(x) for item in table.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), key)


def join_lookup(df: DataFrame, key: str, table: DataFrame, table_key: str, table_value: str, out: str,
                default: str | None = None, pass_through: bool = False) -> DataFrame:
    """Dictionary held as a table: left join on the trimmed key, then a default or the key itself.

    ``table`` needs unique keys.  Its size decides the join: Spark broadcasts it only under the
    session's threshold.
    """
    lookup = table.select(F.col(table_key).cast("string").alias("_lk"), F.col(table_value).alias("_lv"))
    raw = text.strip(F.col(key).cast("string"))
    joined = df.withColumn("_k", F.when(raw != "", raw)).join(lookup, F.col("_k") == F.col("_lk"), "left")
    choices = [F.col("_lv"), *([F.col("_k")] if pass_through else []), *([F.lit(default)] if default else [])]
    return joined.withColumn(out, F.coalesce(*choices)).drop("_k", "_lk", "_lv")


def clean_postings(landing: DataFrame, snapshot: str, industry_classes: dict[str, str] | None = None,
                   bucket_labels: dict[str, str] | None = None, audit: bool = False) -> DataFrame:
    """Landing rows of one snapshot to canonical postings.

    Order matters: types, newest version per id, text cleaning, defect filter.  With ``audit`` the
    defective rows stay and are marked in ``_defect``, for :func:`ingest_audit`.
    """
    df = coerce_types(align_columns(landing, SOURCE_COLUMNS))
    return finish_postings(drop_stale_versions(df.select(*SOURCE_COLUMNS)), snapshot, industry_classes,
                           bucket_labels, audit)


def finish_postings(df: DataFrame, snapshot: str, industry_classes: dict[str, str] | None = None,
                    bucket_labels: dict[str, str] | None = None, audit: bool = False) -> DataFrame:
    """The stateless half of the chain (batch or streaming): everything after the dedupe."""
    labels = S.BUCKET_LABELS if bucket_labels is None else bucket_labels
    df = df.withColumns({
        "job_title": text.normalize_text(F.col("job_title")),
        "description": text.normalize_text(F.col("description"))})
    df = df.withColumn("description_len", F.length("description").cast("long"))
    defect = has_defect(F.col("job_title"), F.col("description_len"))
    df = df.withColumn("_defect", defect) if audit else df.where(~defect)
    df = df.withColumn("_pay", pay.parse_pay(F.col("salary_desc"))).withColumns({
        "snapshot_date": F.lit(snapshot),
        "industry_class": lookup_class(F.col("industry_name"), industry_classes),
        "bucket_label": lookup_bucket(F.col("industry_bucket"), labels),
        "salary_type": F.coalesce("_pay.kind", F.lit("")),
        "salary_min": F.col("_pay.lo"), "salary_max": F.col("_pay.hi"),
        "salary_month_min": F.col("_pay.month_min"),
        "text_for_embed": text.embedding_text(
            F.col("job_title"), F.col("industry_name"), F.col("description"))})
    kept = df.select(*([F.col("_defect")] if audit else []), *POSTINGS.names)
    return kept


def canonical_projection(df: DataFrame) -> DataFrame:
    """Exactly the canonical columns, in order, with pinned types; missing ones are null."""
    return df.select(*[
        (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in POSTINGS.fields])


def ingest_audit(raw: DataFrame, marked: DataFrame) -> DataFrame:
    """Rows read, removed as stale, dropped as defective and kept, with the keep rate (one row)."""
    checked = marked.agg(
        F.count(F.lit(1)).alias("_unique"), F.count(F.when(F.col("_defect"), 1)).alias("n_dropped"))
    joined = checked.withColumn("n_read", raw.agg(F.count(F.lit(1))).scalar())
    kept = F.col("_unique") - F.col("n_dropped")
    return joined.select(
        "n_read", (F.col("n_read") - F.col("_unique")).alias("n_stale"), "n_dropped", kept.alias("n_kept"),
        F.try_divide(kept, F.col("n_read")).alias("keep_rate"))


def resolve_dimension(name: str | None, dimensions: dict[str, str] | None = None) -> str:
    """Column behind a dimension name; the default when none is given."""
    table = S.DIMENSIONS if dimensions is None else dimensions
    wanted = name or next(iter(table))
    if wanted not in table:
        raise ValueError(f"unknown dimension {wanted!r}; choose one of {sorted(table)}")
    return table[wanted]
