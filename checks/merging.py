"""Stored sketches and bitmaps over yearly snapshots (B1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.bindings import LONG, PAIRS, PRIORITY_SEGMENT, YEARLY, rounded, scratch, yearly
from checks.movement import _SURVIVAL
from checks.registry import check
from tidemark.operators import bitmaps, sketches, snapshots
from tidemark.session import cut
from tidemark.sources import tables


def _sketches(spark, folder):
    """Written a snapshot at a time, then read."""
    path, b1 = f"{scratch(spark)}/sketches", cut(yearly(spark, folder))
    made = sketches.group_sketches(b1, ["snapshot_date", "priority"], "pay", "company_id")
    tables.replace_table(made, path, "snapshot_date")
    return b1, tables.read_table(spark, path)


@check("pay_sketch_quantiles", f"""WITH {YEARLY}
SELECT priority AS category, count(pay) AS n_measured, TRUE AS p25_holds, TRUE AS p50_holds, TRUE AS p99_holds FROM b1 GROUP BY 1
UNION ALL SELECT 'all', count(pay), TRUE, TRUE, TRUE FROM b1""")
def pay_sketch_quantiles(spark, folder):
    """Sketches of all years merged; the true rank of each quantile lies within two per cent."""
    b1, stored = _sketches(spark, folder)
    points = {"p25": 0.25, "p50": 0.5, "p99": 0.99}
    each = sketches.sketch_quantiles(sketches.merged(stored, ["priority"]), ["priority"], points)
    whole = sketches.sketch_quantiles(sketches.merged(stored, []), [], points).select(F.lit("all").alias("priority"), "n_measured", *points)
    rows = b1.select("priority", "pay").unionByName(b1.select(F.lit("all").alias("priority"), "pay")).where("pay IS NOT NULL")
    ranked = rows.join(each.unionByName(whole), "priority").groupBy("priority", "n_measured")
    below = [(F.avg((F.col("pay") < F.col(p)).cast("double")), F.avg((F.col("pay") <= F.col(p)).cast("double")), q, p) for p, q in points.items()]
    return ranked.agg(*(((lo - 0.02 <= q) & (hi + 0.02 >= q)).alias(f"{p}_holds") for lo, hi, q, p in below)).withColumnRenamed("priority", "category")


@check("company_sketch_counts", f"""WITH {YEARLY}
SELECT priority AS category, count(*) AS n, count(DISTINCT company_id) AS exact, TRUE AS holds FROM b1 GROUP BY 1""")
def company_sketch_counts(spark, folder):
    b1, stored = _sketches(spark, folder)
    exact = b1.groupBy("priority").agg(F.countDistinct("company_id").alias("exact"))
    found = sketches.sketch_counts(sketches.merged(stored, ["priority"]), ["priority"]).join(exact, "priority")
    return found.select(F.col("priority").alias("category"), "n", "exact",
                        (F.abs(F.col("n_distinct") - F.col("exact")) <= F.greatest(F.lit(1.0), 0.03 * F.col("exact"))).alias("holds"))


def _words(spark, folder, dimensions):
    b1, store = cut(yearly(spark, folder)), bitmaps.Bitmaps(spark, scratch(spark))
    axis = snapshots.snapshot_axis(b1)
    for label in axis:
        store.upsert(b1.where(F.col("snapshot_date") == label), label, dimensions)
    return store.words(), axis


@check("survival_bitmap", f"WITH {YEARLY}, {LONG}, {PAIRS}, {_SURVIVAL}")
def survival_bitmap(spark, folder):
    return rounded(bitmaps.survival(*_words(spark, folder, PRIORITY_SEGMENT)))


@check("set_counts_bitmap", f"""WITH {YEARLY}, {PAIRS},
ends AS (SELECT p.from_snapshot, p.to_snapshot, segment, job_id, bool_or(snapshot_date = from_snapshot) AS a, bool_or(snapshot_date = to_snapshot) AS b
         FROM pairs p JOIN b1 ON snapshot_date IN (from_snapshot, to_snapshot) GROUP BY ALL)
SELECT from_snapshot, to_snapshot, segment AS category, count(*) FILTER (a) AS n_from, count(*) FILTER (b) AS n_to,
       count(*) FILTER (a AND b) AS n_both, count(*) AS n_either FROM ends GROUP BY ALL""")
def set_counts_bitmap(spark, folder):
    return bitmaps.set_counts(*_words(spark, folder, {"segment": "segment"})).drop("dimension")


@check("flow_bitmap", f"""WITH {YEARLY}, {PAIRS},
old AS (SELECT p.*, job_id, priority FROM pairs p JOIN b1 ON snapshot_date = from_snapshot),
new AS (SELECT p.*, job_id, priority FROM pairs p JOIN b1 ON snapshot_date = to_snapshot)
SELECT from_snapshot, to_snapshot, old.priority AS from_category, new.priority AS to_category, count(*) AS n
FROM old FULL JOIN new USING (from_snapshot, to_snapshot, job_id) GROUP BY ALL""")
def flow_bitmap(spark, folder):
    words, axis = _words(spark, folder, {"priority": "priority"})
    return bitmaps.flow(words, axis, "priority")
