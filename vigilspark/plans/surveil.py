"""Queries for vigilspark.operators.surveil."""

from pyspark.sql import functions as F

from vigilspark.operators import surveil as s
from vigilspark.plans.registry import query

_BASED = """(SELECT a.entity, a.year, a.week, a.n, avg(b.n) AS base FROM {notif} a LEFT JOIN {notif} b ON a.entity = b.entity AND a.week = b.week
AND b.year BETWEEN a.year - 5 AND a.year - 1 GROUP BY 1, 2, 3, 4)"""
_RATIO = "round(CASE WHEN base > 0 THEN n / base END, 2)"


@query("a1_weekly_baseline_ratio", f"SELECT entity, year, week, n, round(base, 6) AS base, {_RATIO} AS ratio FROM {_BASED}")
def _(v):
    return s.weekly_baseline_ratio(s.five_year_weekly_mean(v.notif)).withColumn("base", F.round("base", 6))


@query("a2_five_year_weekly_mean", """SELECT a.entity, a.year, a.week, a.n, round(avg(b.n), 6) AS base FROM {cust_weekly} a LEFT
JOIN {cust_weekly} b ON a.entity = b.entity AND a.week = b.week AND b.year BETWEEN a.year - 5 AND a.year - 1 GROUP BY 1, 2, 3, 4""")
def _(v):
    return s.five_year_weekly_mean(v.cust_weekly).withColumn("base", F.round("base", 6))


@query("a3_anomaly_rank", f"""
SELECT entity, year, week, n, round(base, 6) AS base, ratio, row_number() OVER (ORDER BY ratio DESC, entity) AS rank, weeks FROM (
SELECT *, row_number() OVER (PARTITION BY entity ORDER BY ratio DESC, year, week) AS k, count(*) OVER (PARTITION BY entity) AS weeks
FROM (SELECT *, {_RATIO} AS ratio FROM {_BASED} WHERE base >= 3)) WHERE k = 1""")
def _(v):
    ranked = s.anomaly_rank(s.five_year_weekly_mean(v.notif))
    return ranked.select("entity", "year", "week", "n", F.round("base", 6).alias("base"), "ratio", F.col("rank").cast("long").alias("rank"),
        F.size("series").cast("long").alias("weeks"))


_PAIRS = """(SELECT CASE a.agent WHEN 'A/F' THEN '1-URGENT' WHEN 'R/F' THEN '2-HIGH' WHEN 'N/O' THEN '3-MEDIUM'
WHEN 'N/F' THEN '5-LOW' ELSE '4-NOT SPECIFIED' END AS entity, a.year, a.week, CAST(sum(a.positives) AS BIGINT) AS right_value FROM {lab} a
GROUP BY 1, 2, 3)"""


def _lab_pairs(v):
    name = F.when(F.col("agent") == "A/F", "1-URGENT").when(F.col("agent") == "R/F", "2-HIGH").when(F.col("agent") == "N/O",
        "3-MEDIUM").when(F.col("agent") == "N/F", "5-LOW").otherwise("4-NOT SPECIFIED")
    return v.lab.groupBy(name.alias("entity"), "year", "week").agg(F.sum("positives").alias("right_value"))


_SPEARMAN = """(SELECT entity, count(*) AS n, sum(rx) AS sx, sum(ry) AS sy, sum(rx*rx) AS sxx, sum(ry*ry) AS syy, sum(rx*ry) AS sxy FROM (
SELECT entity, rank() OVER (PARTITION BY entity ORDER BY x) + (count(*) OVER (PARTITION BY entity, x) - 1) / 2.0 AS rx,
rank() OVER (PARTITION BY entity ORDER BY y) + (count(*) OVER (PARTITION BY entity, y) - 1) / 2.0 AS ry FROM
(SELECT a.entity, a.n AS x, b.right_value AS y FROM {notif} a JOIN """ + _PAIRS + """ b ON a.entity = b.entity AND a.year = b.year AND a.week = b.week)) GROUP BY entity)"""
_RHO = "CASE WHEN n >= 3 AND n*sxx - sx*sx > 0 AND n*syy - sy*sy > 0 THEN round((n*sxy - sx*sy) / sqrt((n*sxx - sx*sx) * (n*syy - sy*sy)), 3) END"


def _paired(v):
    left = v.notif.withColumnRenamed("n", "x")
    return left.join(_lab_pairs(v).withColumnRenamed("right_value", "y"), ["entity", "year", "week"])


@query("a4_grouped_spearman", f"SELECT entity, n, {_RHO} AS rho FROM {_SPEARMAN}")
def _(v):
    return s.grouped_spearman(_paired(v), ["entity"], "x", "y")


@query("a5_concordance_verdict", f"""SELECT entity, CASE WHEN n < 8 OR rho IS NULL THEN 'hold' WHEN rho >= 0.5 THEN 'agree' WHEN rho >= 0.2 THEN 'weak'
WHEN rho <= -0.2 THEN 'oppose' ELSE 'none' END AS verdict FROM (SELECT entity, n, {_RHO} AS rho FROM {_SPEARMAN})""")
def _(v):
    return s.grouped_spearman(_paired(v), ["entity"], "x", "y").select("entity", s.concordance_verdict(F.col("n"), F.col("rho")).alias("verdict"))


@query("a6_sum_series", """SELECT * FROM {notif} UNION ALL SELECT 'acute', year, week, CAST(sum(n) AS BIGINT) FROM {notif}
WHERE entity IN ('1-URGENT', '2-HIGH') GROUP BY 2, 3""")
def _(v):
    return s.sum_series(v.notif, "1-URGENT", "2-HIGH", "acute")


@query("j1_tolerance_join", "WITH r AS (SELECT * FROM " + _PAIRS + """ WHERE week % 3 <> 0), c AS (
SELECT a.entity, a.year, a.week, a.n AS left_value, r.week AS right_week, CAST(r.week - a.week AS INT) AS "offset", r.right_value,
row_number() OVER (PARTITION BY a.entity, a.year, a.week ORDER BY CASE r.week - a.week WHEN 0 THEN 0 WHEN -1 THEN 1 ELSE 2 END) AS k
FROM {notif} a JOIN r ON a.entity = r.entity AND a.year = r.year AND abs(r.week - a.week) <= 1) SELECT entity, year, week, left_value, right_week, "offset", right_value FROM c WHERE k = 1""")
def _(v):
    return s.tolerance_join(v.notif.withColumnRenamed("n", "left_value"), _lab_pairs(v).where("week % 3 <> 0"), "entity")


@query("j1_tolerance_counts", "WITH r AS (SELECT * FROM " + _PAIRS + """ WHERE week % 3 <> 0)
SELECT entity, count(*) AS pairs, count(*) FILTER (NOT exact) AS by_tolerance FROM (SELECT a.entity, bool_or(r.week = a.week) AS exact
FROM {notif} a JOIN r ON a.entity = r.entity AND a.year = r.year AND abs(r.week - a.week) <= 1 GROUP BY a.entity, a.year, a.week) GROUP BY 1""")
def _(v):
    return s.tolerance_counts(s.tolerance_join(v.notif.withColumnRenamed("n", "left_value"), _lab_pairs(v).where("week % 3 <> 0"), "entity"), "entity")


@query("a15_latest_revision", """SELECT l_partkey, l_suppkey, l_linenumber, l_orderkey, l_quantity FROM (SELECT *,
row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_linenumber DESC, l_orderkey DESC, l_quantity DESC) AS k FROM {lineitem}) WHERE k = 1""")
def _(v):
    rows = v.lineitem.select("l_partkey", "l_suppkey", "l_linenumber", "l_orderkey", "l_quantity")
    return s.latest_revision(rows, ["l_partkey", "l_suppkey"], ["l_linenumber", "l_orderkey", "l_quantity"])


@query("a16_week_gaps", """SELECT entity, year, min(week) AS first, max(week) AS last, count(DISTINCT week) AS weeks,
array_to_string(list_sort(list_filter(range(min(week), max(week) + 1), lambda w: NOT list_contains(list(week), w))), ',') AS missing FROM {cust_weekly} GROUP BY 1, 2""")
def _(v):
    return s.week_gaps(v.cust_weekly, ["entity", "year"]).withColumn("missing", F.array_join(F.col("missing").cast("array<string>"), ","))


@query("a33_panel_summary", """SELECT agent, latest, year, week, most
FROM (SELECT agent, positives AS latest, year, week, max(positives) OVER (PARTITION BY agent) AS most, row_number() OVER (PARTITION BY agent
ORDER BY year DESC, week DESC) AS k FROM {lab}) WHERE k = 1""")
def _(v):
    return s.panel_summary(v.lab, "agent", "positives")


@query("a33b_dominant_column", """SELECT l_orderkey, l_linenumber, CASE WHEN greatest(l_discount, l_tax) IS NULL THEN NULL
WHEN l_discount >= l_tax THEN 'l_discount' ELSE 'l_tax' END AS dominant FROM {lineitem}""")
def _(v):
    return v.lineitem.select("l_orderkey", "l_linenumber", s.dominant_column(["l_discount", "l_tax"]).alias("dominant"))


@query("w1_average_rank", """SELECT l_orderkey, l_linenumber, rank() OVER (PARTITION BY l_orderkey
ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_orderkey, l_quantity) - 1) / 2.0 AS mid FROM {lineitem}""")
def _(v):
    return s.average_rank(v.lineitem.select("l_orderkey", "l_linenumber", "l_quantity"), ["l_orderkey"], "l_quantity", "mid").drop("l_quantity")


@query("w5_carry_down", """SELECT event_id, last_value(CASE
WHEN event_id % 3 = 0 THEN event_type || event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS label
FROM {events}""")
def _(v):
    rows = v.events.select("event_id", "user_id", F.when(F.col("event_id") % 3 == 0, F.concat("event_type", F.col("event_id").cast("string"))).alias("label"))
    return s.carry_down(rows, "label", ["user_id"], ["event_id"]).drop("user_id")


@query("io14_collection_ledger", """SELECT l_suppkey AS issue, count(*) AS n_rows,
count(DISTINCT l_returnflag) AS n_blocks, bool_or(l_returnflag = 'R') AS has_imports FROM {lineitem} GROUP BY 1""")
def _(v):
    block = F.when(F.col("l_returnflag") == "R", "imports").otherwise(F.col("l_returnflag"))
    return s.collection_ledger(v.lineitem.select(F.col("l_suppkey").alias("issue"), block.alias("block")))
