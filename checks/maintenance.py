"""Tables written and read back, key-value meta and samples over yearly snapshots (B1) and vectors (B2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.bindings import YEARLY, rounded, scratch, table, vector_snapshots, yearly
from checks.registry import check
from tidemark.operators import sampling
from tidemark.schema import DERIVED
from tidemark.sources import meta, tables


@check("replace_upsert", f"""WITH {YEARLY}
SELECT job_id, priority, CASE WHEN snapshot_date = '1996' THEN 'second' ELSE 'first' END AS run, snapshot_date
FROM b1 WHERE snapshot_date <> '1996' OR segment = 'BUILDING'""")
def replace_upsert(spark, folder):
    """Write all years, then put one year again with fewer rows: only that year changes."""
    path = f"{scratch(spark)}/table"
    b1 = yearly(spark, folder)
    tables.replace_table(b1.select("job_id", "priority", F.lit("first").alias("run"), "snapshot_date"), path, "snapshot_date")
    again = b1.where("snapshot_date = '1996' AND segment = 'BUILDING'")
    for _ in range(2):
        tables.upsert_snapshot(again.select("snapshot_date", "job_id", "priority", F.lit("second").alias("run")), path, "1996")
    return tables.read_table(spark, path)


@check("upsert_self_read", f"""WITH {YEARLY}
SELECT job_id, priority, CASE WHEN snapshot_date = '1996' THEN 2 ELSE 1 END AS run, snapshot_date FROM b1
WHERE snapshot_date <> '1996' OR segment = 'BUILDING'""")
def upsert_self_read(spark, folder):
    """One year computed from the table it is put into."""
    path = f"{scratch(spark)}/table"
    tables.replace_table(yearly(spark, folder).select("job_id", "priority", "segment", F.lit(1).alias("run"), "snapshot_date"), path, "snapshot_date")
    mine = tables.read_table(spark, path).where("snapshot_date = '1996' AND segment = 'BUILDING'")
    tables.upsert_snapshot(mine.withColumn("run", F.col("run") + 1), path, "1996")
    return tables.read_table(spark, path).drop("segment")


@check("upsert_empty_snapshot", f"""WITH {YEARLY}
SELECT snapshot_date, count(*) AS n FROM b1 WHERE snapshot_date NOT IN ('1996', '1997') GROUP BY 1""")
def upsert_empty_snapshot(spark, folder):
    """A snapshot put without rows goes, from the table and from its folder."""
    path = f"{scratch(spark)}/table"
    tables.replace_table(yearly(spark, folder).select("job_id", "snapshot_date"), path, "snapshot_date")
    for label in ("1996", "1997"):
        tables.upsert_snapshot(tables.read_table(spark, path).where("false"), path, label)
    tables.vacuum(spark, path)
    return tables.read_table(spark, path).groupBy("snapshot_date").agg(F.count(F.lit(1)).alias("n"))


@check("table_roundtrip", """
SELECT s.snapshot_date, vec_id AS job_id, round(list_sum(CAST(embedding AS DOUBLE[])), 6) AS total, 0 AS n_missing
FROM embeddings JOIN (VALUES ('s1'), ('s2')) s(snapshot_date)
  ON (s.snapshot_date = 's1' AND label <= 6) OR (s.snapshot_date = 's2' AND label >= 3)""")
def table_roundtrip(spark, folder):
    """Vectors partitioned by snapshot, rebuilt from two frames; a table never written reads as empty."""
    base = scratch(spark)
    v = vector_snapshots(spark, folder).select("snapshot_date", "job_id", "vec")
    tables.rebuild([v.where("snapshot_date = 's1'"), v.where("snapshot_date = 's2'")], f"{base}/vectors")
    missing = tables.read_table(spark, f"{base}/survival", DERIVED["survival"]).count()
    total = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return rounded(tables.read_table(spark, f"{base}/vectors").select(
        "snapshot_date", "job_id", total.alias("total"), F.lit(missing).alias("n_missing")))


@check("meta_map", """
SELECT 'n_' || o_orderpriority AS key, CAST(count(*) AS VARCHAR) AS value FROM orders GROUP BY 1""")
def meta_map(spark, folder):
    counts = table(spark, folder, "orders").groupBy(F.concat(F.lit("n_"), "o_orderpriority").alias("key")).agg(
        F.count(F.lit(1)).cast("string").alias("value"))
    return meta.meta_map(counts).select(F.explode("entries"))


@check("base_period_first_n", f"""WITH {YEARLY}
SELECT job_id, priority FROM b1 WHERE snapshot_date = '1996' ORDER BY job_id LIMIT 200""")
def base_period_first_n(spark, folder):
    rows = yearly(spark, folder).where("snapshot_date = '1996'")
    return sampling.first_by_id(rows, 200).select("job_id", "priority")


def _draw(key: str, seed: int) -> str:
    return f"((CAST('0x' || substr(md5(CAST({key} AS VARCHAR) || '|{seed}'), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0)"


def _weighted(rows: str, n: str, seed: int, key_seed: int) -> str:
    weight = f"(0.3 + {_draw('priority', seed)} * 1.7)"
    return f"SELECT job_id, priority FROM {rows} QUALIFY row_number() OVER (ORDER BY -ln({_draw('job_id', key_seed)}) / {weight}, job_id) <= {n}"


@check("sample_uniform", f"""WITH {YEARLY} SELECT snapshot_date, job_id FROM b1 WHERE {_draw('job_id', 2)} < 0.55""")
def sample_uniform(spark, folder):
    return sampling.sample_fraction(yearly(spark, folder), 0.55).select("snapshot_date", "job_id")


@check("sample_weighted", f"WITH {YEARLY}, y AS (SELECT * FROM b1 WHERE snapshot_date = '1996') {_weighted('y', '100', 7, 3)}")
def sample_weighted(spark, folder):
    rows = yearly(spark, folder).where("snapshot_date = '1996'")
    return sampling.sample_weighted(rows, 100, sampling.category_weight("priority", 7)).select("job_id", "priority")


@check("synth_snapshot", f"""WITH {YEARLY}, y AS (SELECT * FROM b1 WHERE snapshot_date = '1996'),
base AS (SELECT * FROM y ORDER BY job_id LIMIT 300), kept AS (SELECT * FROM base WHERE {_draw('job_id', 7)} < 0.55),
pool AS (SELECT * FROM y WHERE job_id NOT IN (SELECT job_id FROM base)),
fresh AS ({_weighted('pool', '300 - (SELECT count(*) FROM kept)', 7, 8)})
SELECT '1996-dev' AS snapshot_date, job_id FROM (SELECT job_id FROM kept UNION ALL SELECT job_id FROM fresh)""")
def synth_snapshot(spark, folder):
    rows = yearly(spark, folder).where("snapshot_date = '1996'")
    return sampling.synthetic_snapshot(rows, "1996-dev", 300, 300, category="priority").select("snapshot_date", "job_id")
