"""Extra columns with the names of helper columns stay as they are, on every stage and operator."""

import pytest
from pyspark.sql import functions as F

from tests.llm.edge import CLASHING, documents
from tidemark.llm import blocks, langid, pii, sharding, simhash, suffixes, tiling, warc


def clashing(spark):
    rows = documents(spark).select("doc_id", "text", "lang", "source", "n_chars")
    return rows.select("*", *(F.concat(F.lit(f"own {c} "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))).alias(c) for c in CLASHING))


def stages(spark):
    items = spark.createDataFrame([(1, "one two three four five six seven")], "item_id long, text string")
    return {"language": langid.keep_identified, "near_copies": simhash.drop_near_duplicates, "decontamination": lambda d: tiling.drop_leaks(d, items),
            "personal_data": pii.redact_documents}


@pytest.mark.parametrize("name", ["language", "near_copies", "decontamination", "personal_data"])
def test_stages_keep_clashing_columns(spark, name):
    docs = clashing(spark)
    out = stages(spark)[name](docs)
    assert out.columns == docs.columns and [t for _, t in out.dtypes] == [t for _, t in docs.dtypes]
    got = out.collect()
    assert got or name == "language"
    for r in got:
        assert all(r[c] == f"own {c} {'none' if r.doc_id is None else r.doc_id}" for c in CLASHING)
    upper = docs.select("doc_id", "text", "lang", "source", "n_chars", *(F.col(c).alias(c.upper()) for c in CLASHING))
    assert stages(spark)[name](upper).columns == upper.columns


def test_operators_read_past_clashing_columns(spark):
    docs = clashing(spark)
    assert langid.identify(docs).count() == pii.find_personal_data(docs).count() == suffixes.remove_repeats(docs).count() == docs.count()
    assert {r._row for r in sharding.shuffle_shards(docs, 3).select("_row").collect()} == {r._row for r in docs.select("_row").collect()}
    pages = docs.select(F.col("doc_id").alias("page_id"), F.lit("u").alias("url"), F.col("text").alias("html"), *(F.col(c) for c in CLASHING))
    assert blocks.extract(pages).count() == docs.count()
    assert warc.captures_round_trip(pages.where("page_id IS NOT NULL")).count() == docs.where("doc_id IS NOT NULL").count()
