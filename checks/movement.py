"""Series, survival, flow and cluster change over yearly customer snapshots (B1) and weekly events (B3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.bindings import (
    CATALOG, LONG, PAIRS, PRIORITY_SEGMENT, SERIES, YEARLY, rounded, scratch, table, yearly, yearly_catalog)
from checks.registry import check
from tidemark.operators import ranking, snapshots
from tidemark.plans.reports import Reports
from tidemark.session import cut
from tidemark.sources.meta import meta_frame
from tidemark.sources.tables import replace_table


@check("timeline", f"""WITH {YEARLY}
SELECT snapshot_date, count(*) AS n, round(median(pay), 6) AS median_salary,
       round(count(pay) / count(*), 6) AS salary_coverage, count(DISTINCT company_id) AS n_companies
FROM b1 GROUP BY 1""")
def timeline(spark, folder):
    return rounded(snapshots.timeline(yearly(spark, folder), "pay"))


@check("category_share_series", f"""WITH {YEARLY}
SELECT priority AS category, snapshot_date, count(*) AS n,
       round(count(*) / sum(count(*)) OVER (PARTITION BY snapshot_date), 6) AS share FROM b1 GROUP BY 1, 2""")
def category_share_series(spark, folder):
    return rounded(snapshots.category_series(yearly(spark, folder), "priority"))


@check("order_priority_share", """
SELECT o_orderpriority AS category, strftime(o_orderdate, '%Y') AS snapshot_date, count(*) AS n,
       round(count(*) / sum(count(*)) OVER (PARTITION BY strftime(o_orderdate, '%Y')), 6) AS share
FROM orders GROUP BY 1, 2""")
def order_priority_share(spark, folder):
    orders = table(spark, folder, "orders").withColumn("snapshot_date", F.date_format("o_orderdate", "yyyy"))
    return rounded(snapshots.category_series(orders, "o_orderpriority"))


@check("dedupe_latest", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
            ORDER BY l_shipdate DESC, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS rn FROM lineitem) WHERE rn = 1""")
def dedupe_latest(spark, folder):
    lines = table(spark, folder, "lineitem")
    order = [F.col("l_shipdate").desc(), "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
    newest = ranking.latest_per_key(lines, ["l_orderkey", "l_linenumber"], [F.col(c) if isinstance(c, str) else c for c in order])
    return newest.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")


_SURVIVAL = """per_pair AS (
  SELECT p.from_snapshot, p.to_snapshot, l.dimension, l.category, l.job_id,
         bool_or(l.snapshot_date = p.from_snapshot) AS was, bool_or(l.snapshot_date = p.to_snapshot) AS still
  FROM long l JOIN pairs p ON l.snapshot_date IN (p.from_snapshot, p.to_snapshot) GROUP BY ALL)
SELECT from_snapshot, to_snapshot, dimension, category, count(*) FILTER (was) AS n_from,
       count(*) FILTER (still) AS n_to, count(*) FILTER (was AND still) AS n_survived,
       count(*) FILTER (was AND NOT still) AS n_gone, count(*) FILTER (still AND NOT was) AS n_added,
       round(count(*) FILTER (was AND NOT still) / NULLIF(count(*) FILTER (was), 0), 6) AS churn_rate,
       round(count(*) FILTER (still AND NOT was) / NULLIF(count(*) FILTER (still), 0), 6) AS renewal_rate
FROM per_pair GROUP BY ALL"""


@check("survival", f"WITH {YEARLY}, {LONG}, {PAIRS}, {_SURVIVAL}")
def survival(spark, folder):
    b1 = cut(yearly(spark, folder))
    return rounded(snapshots.survival(b1, snapshots.snapshot_axis(b1), PRIORITY_SEGMENT))


@check("user_churn_weekly", f"""WITH b1 AS (
  SELECT DISTINCT strftime(date_trunc('week', ts), '%Y-%m-%d') AS snapshot_date, CAST(user_id AS VARCHAR) AS job_id,
         event_type FROM events),
long AS (SELECT snapshot_date, job_id, 'event_type' AS dimension, event_type AS category FROM b1), {PAIRS}, {_SURVIVAL}""")
def user_churn_weekly(spark, folder):
    weekly = table(spark, folder, "events").select(
        F.date_format(F.date_trunc("week", "ts"), "yyyy-MM-dd").alias("snapshot_date"),
        F.col("user_id").cast("string").alias("job_id"), "event_type")
    axis = snapshots.snapshot_axis(weekly)
    return rounded(snapshots.survival(weekly, axis, {"event_type": "event_type"}))


_FLOW = """ends AS (
  SELECT p.from_snapshot, p.to_snapshot, b.job_id,
         max(CASE WHEN b.snapshot_date = p.from_snapshot THEN cluster_id END) AS c0,
         max(CASE WHEN b.snapshot_date = p.to_snapshot THEN cluster_id END) AS c1
  FROM b1 b JOIN pairs p ON b.snapshot_date IN (p.from_snapshot, p.to_snapshot) GROUP BY ALL),
flow AS (SELECT from_snapshot, to_snapshot, coalesce(c0, -998) AS from_cluster, coalesce(c1, -999) AS to_cluster,
  CASE WHEN c1 IS NULL THEN 'gone' WHEN c0 IS NULL THEN 'added' WHEN c0 = c1 THEN 'stayed' ELSE 'moved' END AS kind,
  count(*) AS n FROM ends GROUP BY ALL)"""


@check("cluster_flow", f"WITH {YEARLY}, {PAIRS}, {_FLOW} SELECT * FROM flow")
def cluster_flow(spark, folder):
    b1 = cut(yearly(spark, folder))
    return snapshots.cluster_flow(b1, snapshots.snapshot_axis(b1))


@check("cluster_flow_labelled", f"""WITH {YEARLY}, {PAIRS}, {_FLOW}, {CATALOG}
SELECT f.*, a.label AS from_label, b.label AS to_label FROM flow f
LEFT JOIN catalog a ON a.cluster_id = f.from_cluster LEFT JOIN catalog b ON b.cluster_id = f.to_cluster
WHERE f.n >= 5 AND f.kind <> 'stayed'""")
def cluster_flow_labelled(spark, folder):
    b1 = cut(yearly(spark, folder))
    flow = snapshots.cluster_flow(b1, snapshots.snapshot_axis(b1)).where((F.col("n") >= 5) & (F.col("kind") != "stayed"))
    return snapshots.with_cluster_labels(flow, yearly_catalog(b1))


@check("cluster_timeseries", f"""WITH {YEARLY}, {SERIES}
SELECT snapshot_date, cluster_id, n, round(share, 6) AS share FROM series""")
def cluster_timeseries(spark, folder):
    return rounded(snapshots.cluster_timeseries(yearly(spark, folder)))


_MIX = """mix AS (SELECT category, cluster_id, count(*) AS n, snapshot_date, dimension,
  count(*) / sum(count(*)) OVER (PARTITION BY snapshot_date, dimension, category) AS share_in_category
  FROM long WHERE cluster_id <> -1 AND category IS NOT NULL GROUP BY 1, 2, 4, 5)"""


@check("category_cluster_mix", f"""WITH {YEARLY}, {LONG}, {_MIX}
SELECT category, cluster_id, n, snapshot_date, dimension, round(share_in_category, 6) AS share_in_category FROM mix""")
def category_cluster_mix(spark, folder):
    return rounded(snapshots.category_cluster_mix(yearly(spark, folder), PRIORITY_SEGMENT))


@check("category_composition", f"""WITH {YEARLY}, {LONG}, {_MIX}, {CATALOG}
SELECT category, cluster_id, n, snapshot_date, dimension, round(share_in_category, 6) AS share_in_category, label
FROM mix LEFT JOIN catalog USING (cluster_id) WHERE n >= 20 AND dimension = 'segment' AND snapshot_date = '1997'""")
def category_composition(spark, folder):
    b1 = cut(yearly(spark, folder))
    mix = snapshots.category_cluster_mix(b1.where("snapshot_date = '1997'"), PRIORITY_SEGMENT)
    labels = yearly_catalog(b1).select("cluster_id", "label")
    return rounded(mix.where("n >= 20 AND dimension = 'segment'").join(labels, "cluster_id", "left"))


_CHANGE = """a AS (SELECT * FROM series WHERE snapshot_date = '1996'), b AS (SELECT * FROM series WHERE snapshot_date = '1997'),
change AS (
SELECT c.cluster_id, c.label, c.first_seen, coalesce(a.n, 0) AS n_from, coalesce(b.n, 0) AS n_to,
       coalesce(b.n, 0) - coalesce(a.n, 0) AS delta, coalesce(a.share, 0) AS share_from, coalesce(b.share, 0) AS share_to,
       (coalesce(b.share, 0) - coalesce(a.share, 0)) * 100 AS share_delta_pp,
       CASE WHEN coalesce(a.n, 0) = 0 THEN NULL ELSE (coalesce(b.n, 0) - a.n) * 100.0 / a.n END AS growth_pct
FROM catalog c LEFT JOIN a USING (cluster_id) LEFT JOIN b USING (cluster_id))
SELECT cluster_id, label, first_seen, n_from, n_to, delta, round(share_from, 6) AS share_from,
       round(share_to, 6) AS share_to, round(share_delta_pp, 6) AS share_delta_pp, round(growth_pct, 6) AS growth_pct,
       CASE WHEN first_seen > '1996' THEN '新生' WHEN n_to = 0 THEN '消亡' WHEN share_delta_pp > 0.2 THEN '擴張'
            WHEN share_delta_pp < -0.2 THEN '萎縮' ELSE '持平' END AS status
FROM change ORDER BY abs(share_delta_pp) DESC, cluster_id LIMIT 600"""


@check("cluster_change", f"WITH {YEARLY}, {SERIES}, {CATALOG}, {_CHANGE}")
def cluster_change(spark, folder):
    b1 = cut(yearly(spark, folder))
    return rounded(snapshots.cluster_change(yearly_catalog(b1), snapshots.cluster_timeseries(b1), "1996", "1997"))


@check("cluster_series_top", f"""WITH {YEARLY}, {SERIES}, {CATALOG},
rng AS (SELECT cluster_id, max(share) - min(share) AS spread FROM series WHERE cluster_id >= 0 GROUP BY 1
        ORDER BY spread DESC, cluster_id LIMIT 3)
SELECT snapshot_date, cluster_id, n, round(share, 6) AS share, label
FROM series JOIN rng USING (cluster_id) JOIN catalog USING (cluster_id)""")
def cluster_series_top(spark, folder):
    b1 = cut(yearly(spark, folder))
    series = snapshots.cluster_series(snapshots.cluster_timeseries(b1), yearly_catalog(b1), top=3)
    return rounded(series.select("snapshot_date", "cluster_id", "n", "share", "label"))


@check("cluster_series_one", f"""WITH {YEARLY}, {SERIES}, {CATALOG}
SELECT snapshot_date, cluster_id, n, round(share, 6) AS share, label
FROM series JOIN catalog USING (cluster_id) WHERE cluster_id = 2""")
def cluster_series_one(spark, folder):
    b1 = cut(yearly(spark, folder))
    series = snapshots.cluster_series(snapshots.cluster_timeseries(b1), yearly_catalog(b1), cluster_id=2)
    return rounded(series.select("snapshot_date", "cluster_id", "n", "share", "label"))


@check("cluster_members", f"""WITH {YEARLY}
SELECT snapshot_date, job_id, priority, segment, round(sim, 6) AS sim FROM b1 WHERE cluster_id = 1
ORDER BY b1.sim DESC, snapshot_date, job_id LIMIT 50""")
def cluster_members(spark, folder):
    b1 = cut(yearly(spark, folder))
    members = snapshots.cluster_members(
        b1.select("snapshot_date", "job_id", "cluster_id", "sim"), b1.drop("sim", "cluster_id"), 1, ["priority", "segment"])
    return rounded(members.select("snapshot_date", "job_id", "priority", "segment", "sim"))


_INHERIT = """cur AS (
  SELECT job_id, sim, CASE WHEN cluster_id IN (1, 2) AND segment = 'BUILDING' THEN 3 ELSE cluster_id END AS fresh_cluster
  FROM b1 WHERE snapshot_date = '1997'),
prev AS (SELECT job_id, cluster_id AS before FROM b1 WHERE snapshot_date = '1996'),
kept AS (SELECT job_id, sim, fresh_cluster, prev.job_id IS NOT NULL AS survivor,
                CASE WHEN prev.job_id IS NOT NULL THEN before ELSE fresh_cluster END AS cluster_id
         FROM cur LEFT JOIN prev USING (job_id))"""


def _inherited(spark, folder):
    b1 = cut(yearly(spark, folder))
    moved = F.col("cluster_id").isin(1, 2) & (F.col("segment") == "BUILDING")
    fresh = b1.where("snapshot_date = '1997'").select(
        "job_id", "sim", F.when(moved, F.lit(3)).otherwise(F.col("cluster_id")).cast("long").alias("cluster_id"))
    return snapshots.inherit_labels(fresh, b1.where("snapshot_date = '1996'"))


@check("survivor_inheritance", f"""WITH {YEARLY}, {_INHERIT}
SELECT job_id, round(sim, 6) AS sim, fresh_cluster, survivor, cluster_id FROM kept""")
def survivor_inheritance(spark, folder):
    return rounded(_inherited(spark, folder))


@check("assignment_stability", f"""WITH {YEARLY}, {_INHERIT}
SELECT '1996' AS from_snapshot, '1997' AS to_snapshot, count(*) AS n_survivors,
       count(*) FILTER (fresh_cluster <> -1 AND cluster_id <> -1) AS n_comparable,
       round(avg(CASE WHEN fresh_cluster <> -1 AND cluster_id <> -1
                      THEN CASE WHEN fresh_cluster = cluster_id THEN 1.0 ELSE 0.0 END END), 6) AS agreement,
       round(1 - avg(CASE WHEN fresh_cluster <> -1 AND cluster_id <> -1
                      THEN CASE WHEN fresh_cluster = cluster_id THEN 1.0 ELSE 0.0 END END), 6) AS noise_floor
FROM kept WHERE survivor""")
def assignment_stability(spark, folder):
    return rounded(snapshots.assignment_stability(_inherited(spark, folder), "1996", "1997"))


@check("stability_lookup", f"""WITH {YEARLY}, {_INHERIT}
SELECT '1996' AS from_snapshot, '1997' AS to_snapshot, count(*) AS n_survivors FROM kept WHERE survivor""")
def stability_lookup(spark, folder):
    """The stored stability row of one pair, read back through the report; other pairs have none."""
    base = scratch(spark)
    replace_table(snapshots.assignment_stability(_inherited(spark, folder), "1996", "1997"), f"{base}/assignment_stability")
    replace_table(meta_frame(spark, {"snapshots": ["1995", "1996", "1997"]}), f"{base}/analysis_meta")
    reports = Reports(spark, base)
    pairs = reports.stability().unionByName(reports.stability("1995", "1996"))
    return pairs.select("from_snapshot", "to_snapshot", "n_survivors")


@check("snapshot_axis", f"WITH {YEARLY}, {PAIRS} SELECT * FROM pairs")
def snapshot_axis(spark, folder):
    return snapshots.adjacent_pairs(yearly(spark, folder))


@check("id_set_ops", f"""WITH {YEARLY}
SELECT job_id, CASE WHEN bool_or(snapshot_date = '1996') AND bool_or(snapshot_date = '1997') THEN 'both'
                    WHEN bool_or(snapshot_date = '1996') THEN 'before' ELSE 'after' END AS membership
FROM b1 WHERE snapshot_date IN ('1996', '1997') GROUP BY 1""")
def id_set_ops(spark, folder):
    b1 = cut(yearly(spark, folder))
    return snapshots.id_sets(b1.where("snapshot_date = '1996'"), b1.where("snapshot_date = '1997'"))


@check("pay_quantiles", """
SELECT o_orderpriority, round(quantile_cont(o_totalprice, 0.25), 6) AS p25, round(median(o_totalprice), 6) AS p50,
       round(quantile_cont(o_totalprice, 0.75), 6) AS p75, round(quantile_cont(o_totalprice, 0.99), 6) AS p99
FROM orders GROUP BY 1""")
def pay_quantiles(spark, folder):
    orders = table(spark, folder, "orders")
    return rounded(ranking.exact_quantiles(
        orders, ["o_orderpriority"], "o_totalprice", {"p25": 0.25, "p50": 0.5, "p75": 0.75, "p99": 0.99}))


@check("epoch_quantiles", """
SELECT event_type, round(quantile_cont(epoch(ts), 0.5), 3) AS p50, round(quantile_cont(epoch(ts), 0.99), 3) AS p99
FROM events GROUP BY 1""")
def epoch_quantiles(spark, folder):
    """Seconds since 1970 lie in very few value bins."""
    events = table(spark, folder, "events").select("event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    seconds = events.select("event_type", (F.col("us") / 1e6).alias("seconds"))
    return rounded(ranking.exact_quantiles(seconds, ["event_type"], "seconds", {"p50": 0.5, "p99": 0.99}), 3)
