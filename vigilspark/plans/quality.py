"""Queries for vigilspark.operators.quality."""

from pyspark.sql import functions as F

from vigilspark.operators import quality as q
from vigilspark.plans.registry import query


@query("d1_profile_table", " UNION ALL ".join(f"""SELECT '{c}' AS \"column\", count(*) AS rows, count({c}) AS filled, count(DISTINCT {c}) AS \"distinct\",
CAST(min({c}) AS VARCHAR) AS least, CAST(max({c}) AS VARCHAR) AS most FROM {{part}}""" for c in ("p_partkey", "p_name", "p_brand", "p_size")))
def _(v):
    return q.profile_table(v.part.select("p_partkey", "p_name", "p_brand", "p_size"))


@query("d1_year_bounds", """SELECT count(*) AS rows, 3 AS cols, CAST(min(least(year(o_orderdate), CASE
WHEN o_orderkey % 2 = 0 THEN 1988 END)) AS INT) AS first_year, 2031 AS last_year FROM {orders}""")
def _(v):
    note = F.when(F.col("o_orderkey") % 2 == 0, "seen in 1988 or 1987").otherwise("no year: 12345")
    return q.year_bounds(v.orders.select("o_orderdate", note.alias("note"), F.col("o_orderpriority").alias("2031")), ["o_orderdate", "note"])


@query("d1_year_cover", """SELECT * FROM (SELECT 2019 AS year, count(*) FILTER (p_size % 3 > 0) AS filled FROM {part} UNION ALL SELECT 2020,
count(*) FILTER (p_size % 4 > 1) FROM {part})""")
def _(v):
    wide = v.part.select("p_name", F.when(F.col("p_size") % 3 > 0, F.col("p_size")).alias("2019"),
        F.when(F.col("p_size") % 4 == 0, " ").when(F.col("p_size") % 4 == 1, "-").otherwise("7").alias("2020"))
    return q.year_cover(wide)


@query("d1_preview", """SELECT substring(CAST(p_partkey AS VARCHAR), 1, 5) AS p_partkey, substring(p_name, 1, 5) AS p_name FROM {part}
ORDER BY {part}.p_partkey LIMIT 4""")
def _(v):
    return q.preview(v.part.select("p_partkey", "p_name", "p_brand"), ["p_partkey"], 4, 2, 5)


@query("d2_check_year_columns",
    """SELECT * FROM (VALUES ('error', 'future year', '2003', NULL), ('warn', 'missing year', '1998', NULL), ('warn', 'missing year', '2002', NULL), ('warn', 'empty year', '2003', NULL), ('warn', 'empty year', '1994', NULL)) t(severity, \"check\", subject, detail)
WHERE (SELECT count(*) FROM {brand_annual}) > 0""")
def _(v):
    years = [1994, 1995, 1996, 1997, 1999, 2000, 2001, 2003]
    wide = v.brand_annual.groupBy("entity").pivot("year", years).agg(F.sum("value"))
    return q.check_year_columns(wide, years, 2002)


@query("d3_check_required", """SELECT 'error' AS severity, 'required' AS \"check\", CAST(p_partkey AS VARCHAR) AS subject, c AS detail
FROM {part}, (VALUES ('a'), ('b')) t(c) WHERE c = 'a' AND p_size % 4 = 0 OR c = 'b' AND p_size % 5 = 0""")
def _(v):
    return q.check_required(v.part.select("p_partkey", F.when(F.col("p_size") % 4 > 0, F.col("p_name")).alias("a"),
        F.when(F.col("p_size") % 5 == 0, " ").otherwise("x").alias("b")), "p_partkey", ["a", "b"])


@query("d3_check_foreign_key", """SELECT 'error' AS severity, 'unknown reference' AS \"check\", CAST(o_orderkey AS VARCHAR) AS subject,
CAST(o_custkey AS VARCHAR) AS detail FROM {orders} WHERE o_custkey NOT IN (SELECT c_custkey FROM {customer} WHERE c_mktsegment <> 'BUILDING')""")
def _(v):
    return q.check_foreign_key(v.orders, "o_orderkey", "o_custkey", v.customer.where("c_mktsegment <> 'BUILDING'"), "c_custkey")


_MARKS = "(SELECT p_brand AS category, p_name AS entity FROM {part} GROUP BY 1, 2)"


@query("d4_reconcile_declared", f"""SELECT category, declared, marks, entities, declared = marks AS agree, false AS verified FROM (SELECT category,
count(*) + CASE WHEN category = 'Brand#11' THEN 1 ELSE 0 END AS declared, count(*) AS marks, count(DISTINCT entity) AS entities FROM {_MARKS}
GROUP BY 1)""")
def _(v):
    marks = v.part.select(F.col("p_brand").alias("category"), F.col("p_name").alias("entity")).distinct()
    declared = marks.groupBy("category").agg((F.count("*") + F.when(F.col("category") == "Brand#11", 1).otherwise(0)).alias("declared"))
    return q.reconcile_declared(marks, declared)


@query("d4_publish_if_verified", f"SELECT * FROM {_MARKS} WHERE category <> 'Brand#11'")
def _(v):
    marks = v.part.select(F.col("p_brand").alias("category"), F.col("p_name").alias("entity")).distinct()
    true = marks.groupBy("category").agg(F.count("*").alias("declared"))
    wrong = true.where("category = 'Brand#11'").withColumn("declared", F.col("declared") + 1)
    held_back = q.publish_if_verified(marks.where("category = 'Brand#11'"), wrong)
    return q.publish_if_verified(marks.where("category <> 'Brand#11'"), true.where("category <> 'Brand#11'")).union(held_back)


@query("d5_self_consistency", """SELECT l_orderkey AS doc, count(*) FILTER (l_returnflag IN ('A', 'N')) AS kept,
count(*) FILTER (l_returnflag = 'R') AS dropped, count(*) FILTER (l_returnflag = 'R') > 0 AS needs_review FROM {lineitem} GROUP BY 1""")
def _(v):
    return q.self_consistency(v.lineitem.select(F.col("l_orderkey").alias("doc"), F.col("l_returnflag").alias("name")),
        v.orders.select(F.col("o_orderkey").alias("doc"), F.lit("a , N").alias("declared")))


@query("d6_check_pages", """SELECT s AS severity, c AS "check", CAST(page_id AS VARCHAR) AS subject, CASE
WHEN c = 'absolute link' THEN regexp_extract(html, '(?:href|src)="(/[^"]*)"', 1) END AS detail
FROM {pages}, (VALUES ('error', 'charset', '<meta[^>]*charset="?utf-8'), ('error', 'lang', '<html[^>]*\\slang='), ('warn', 'description', '<meta[^>]*name="description"'), ('error', 'absolute link', NULL)) t(s, c, p)
WHERE CASE WHEN c = 'absolute link' THEN regexp_matches(html, '(?:href|src)="/[^/]') ELSE NOT regexp_matches(html, p) END""")
def _(v):
    return q.check_pages(v.pages)


@query("d7_shared_target", """SELECT p_name AS file, string_agg(DISTINCT p_brand, ',' ORDER BY p_brand) AS labels FROM {part} GROUP BY 1 HAVING
count(DISTINCT p_brand) > 1""")
def _(v):
    return q.shared_target(v.part.select(F.col("p_name").alias("file"), F.col("p_brand").alias("label"))).withColumn("labels", F.array_join("labels", ","))


@query("d8_unsupported_values", """SELECT 'error' AS severity, 'unsupported' AS \"check\", CAST(c_custkey AS VARCHAR) AS subject, c_mktsegment AS detail
FROM {customer} WHERE c_custkey % 7 = 0 UNION ALL SELECT 'warn', 'blanket value', 'all', 'same' FROM {region} WHERE r_regionkey = 0""")
def _(v):
    values = v.customer.select(F.col("c_custkey").alias("entity"), F.col("c_mktsegment").alias("value"))
    blanket = v.customer.select(F.col("c_custkey").alias("entity"), F.lit("same").alias("value"),
        F.lit("all").alias("class")).union(v.customer.select("c_custkey", "c_name", F.lit("mixed")))
    return q.unsupported_values(values, values.where("entity % 7 > 0")).unionByName(q.blanket_values(blanket))


@query("d9_contradicting_links", """SELECT 'error' AS severity, 'contradicting link' AS \"check\", p_brand || p_partkey AS subject, CASE p_partkey % 3
WHEN 0 THEN 'all of grade 2' ELSE 'handbook (A, B)' END AS detail FROM {part} WHERE p_partkey % 3 = 0 AND p_size % 4 <> 2 OR p_partkey % 3 = 1""")
def _(v):
    k = F.col("p_partkey") % 3
    title = F.when(k == 0, "all of grade 2").when(k == 1, "handbook (A, B)").otherwise("plain")
    return q.contradicting_links(v.part.select(F.concat("p_brand", F.col("p_partkey").cast("string")).alias("entity"), (F.col("p_size") % 4).alias("grade"), title.alias("title")))


@query("d10_overlapping_dictionaries", "SELECT DISTINCT lower(c_mktsegment) AS word FROM {customer} WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
def _(v):
    return q.overlapping_dictionaries(v.customer.select(F.col("c_mktsegment").alias("word")), v.spark.createDataFrame([("Building",), ("machinery",), ("x",)], "word string"))


@query("d11_severity_report", """SELECT severity, \"check\", count(*) AS n FROM (SELECT CASE
WHEN p_size % 2 = 0 THEN 'error' ELSE 'warn' END AS severity, 'c' || p_size % 3 AS \"check\" FROM {part}) GROUP BY ROLLUP (severity, \"check\")""")
def _(v):
    findings = v.part.select(F.when(F.col("p_size") % 2 == 0, "error").otherwise("warn").alias("severity"),
        F.concat(F.lit("c"), (F.col("p_size") % 3).cast("string")).alias("check"))
    return q.severity_report(findings)
