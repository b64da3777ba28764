"""Queries for vigilspark.operators.series."""

from pyspark.sql import functions as F

from vigilspark.operators import series as s
from vigilspark.plans.registry import query


def _docs(v):
    return v.catalogue.withColumn("series", F.when(F.col("doc") % 10 == 0, "").otherwise(F.concat("name", F.lit("/"), "board")))


_S = "(SELECT *, CASE WHEN doc % 10 = 0 THEN '#' || doc ELSE name || '/' || board END AS series FROM {catalogue})"


@query("a17_series_rollup", f"""SELECT series, editions, first_year, last_year, latest, CASE
WHEN 2 * m > editions THEN f ELSE 'general' END AS field, titles FROM (
SELECT series, count(*) AS editions, min(year) AS first_year, max(year) AS last_year, arg_max(doc, CAST(year AS BIGINT) * 10000000000000 +
CAST(replace(posted, '-', '') AS BIGINT) % 10000 * 1000000000 + doc) AS latest,
CASE WHEN count(*) FILTER (field = 'infection') >=
count(*) FILTER (field = 'chronic') THEN 'infection' ELSE 'chronic' END AS f, greatest(count(*) FILTER (field = 'infection'),
count(*) FILTER (field = 'chronic')) AS m,
string_agg(title, '|' ORDER BY year DESC, posted, title, doc) AS titles FROM {_S} GROUP BY series)""")
def _(v):
    r = s.series_rollup(_docs(v), "general")
    return r.withColumn("titles", F.array_join(F.transform("edition_list", lambda e: e.title), "|")).drop("edition_list")


@query("a18_latest_per_series", """SELECT *, row_number() OVER (PARTITION BY entity ORDER BY CASE kind WHEN 'guide' THEN 0
WHEN 'manual' THEN 1 ELSE 2 END, year DESC, doc) AS place FROM (
SELECT board AS entity, name AS series, doc, year, kind, year < 2022 AS stale FROM (SELECT *, row_number() OVER (PARTITION BY board, name
ORDER BY year DESC, doc DESC) AS k FROM {catalogue}) WHERE k = 1) QUALIFY place <= 5""")
def _(v):
    return s.latest_per_series(v.catalogue.select(F.col("board").alias("entity"), F.col("name").alias("series"), "doc", "year", "kind"), 2023, ["guide", "manual"], 5)


@query("a19_facet_counts", "SELECT kind, board, count(*) AS n FROM {catalogue} GROUP BY GROUPING SETS ((kind), (board), ())")
def _(v):
    return s.facet_counts(v.catalogue, "kind", "board")


@query("a20_totals_with_exclusion", """SELECT year, CAST(sum(value) AS BIGINT) AS total, CAST(sum(CASE
WHEN entity <> 'Brand#11' THEN value ELSE 0 END) AS BIGINT) AS \"without\" FROM {brand_annual} GROUP BY 1""")
def _(v):
    wide = v.brand_annual.groupBy("entity").pivot("year", list(range(1995, 2002))).agg(F.sum("value"))
    long = wide.unpivot("entity", [str(y) for y in range(1995, 2002)], "year", "value").where("value IS NOT NULL").withColumn("year", F.col("year").cast("int"))
    return s.totals_with_exclusion(long, "year", "Brand#11")


@query("a21_unstable_denominators", """SELECT entity, min(value) AS least, max(value) AS most FROM {part_annual} WHERE value > 0
GROUP BY 1 HAVING max(value) >= 2 * min(value)""")
def _(v):
    return s.unstable_denominators(v.part_annual)


_SURGE = """(SELECT entity, year, value, previous, value * 1.0 / previous AS r FROM (SELECT a.entity, a.year, a.value, b.value AS previous
FROM {brand_annual} a JOIN {brand_annual} b ON a.entity = b.entity AND b.year = a.year - 1) WHERE previous >= 5 AND value >= 10
AND value * 1.0 / previous >= 1.02)"""


def _surges(v):
    return s.yoy_surges(v.brand_annual, 5, 10, 1.02)


@query("a22_yoy_surges", f"SELECT entity, year, value, previous, round(r, 4) AS ratio, round(least(96.0, 68 + 12 * log10(r)), 4) AS weight FROM {_SURGE}")
def _(v):
    return _surges(v)


@query("a23_year_leader", f"""SELECT year, entity, value FROM (SELECT b.*, row_number() OVER (PARTITION BY b.year ORDER BY b.value DESC, b.entity) AS k
FROM {{brand_annual}} b WHERE NOT EXISTS (SELECT 1 FROM {_SURGE} z WHERE z.entity = b.entity AND z.year = b.year)) WHERE k = 1""")
def _(v):
    return s.year_leader(v.brand_annual, _surges(v))


@query("a24_first_appearances", """SELECT name AS series, count(*) AS editions, arg_min(doc,
CAST(year AS BIGINT) * 10000000 + doc) AS doc, min(year) AS year, CAST(least(84, 52 + 2 * count(*)) AS BIGINT) AS weight FROM {catalogue}
GROUP BY 1 HAVING count(*) >= 3""")
def _(v):
    return s.first_appearances(v.catalogue.withColumnRenamed("name", "series"))


@query("a24b_busy_years", "SELECT year, count(*) AS n FROM {catalogue} GROUP BY 1 HAVING count(*) >= 30")
def _(v):
    return s.busy_years(v.catalogue)


@query("a25_edition_diff", """WITH x AS (SELECT DISTINCT name, year, board FROM {catalogue}), e AS (SELECT name, year, lag(year) OVER (PARTITION BY name
ORDER BY year) AS p FROM (SELECT DISTINCT name, year FROM x))
SELECT e.name, e.year AS edition, coalesce((SELECT string_agg(board, ',' ORDER BY board) FROM x a WHERE a.name = e.name AND a.year = e.year
AND e.p IS NOT NULL AND NOT EXISTS (SELECT 1 FROM x b WHERE b.name = e.name AND b.year = e.p AND b.board = a.board)), '') AS added FROM e""")
def _(v):
    d = s.edition_diff(v.catalogue.select("name", F.col("year").alias("edition"), F.col("board").alias("item")), "name")
    return d.withColumn("added", F.array_join("added", ","))


@query("a26_coverage_matrix", """SELECT vaccine, age, max(value) FILTER (year = 1996 AND value < 95) AS y1996, max(value) FILTER (year = 1997
AND value < 95) AS y1997, max(value) FILTER (year = 2005) AS y2005 FROM {coverage} WHERE value < 95 GROUP BY 1, 2""")
def _(v):
    rows = v.coverage.withColumn("anomaly", F.when(F.col("value") >= 95, "too high"))
    return s.coverage_matrix(rows, [1996, 1997, 2005]).select("vaccine", "age", *(F.col(str(y)).alias(f"y{y}") for y in (1996, 1997, 2005)))


@query("a27_immunity_threshold", """SELECT *, CAST(row_number() OVER (ORDER BY CASE verdict WHEN 'impossible' THEN 0 WHEN 'under' THEN 1
WHEN 'edge' THEN 2 WHEN 'over' THEN 3 ELSE 4 END, high DESC, vaccine) AS INT) AS place FROM (
SELECT vaccine, low, high, actual, actual_year, CASE WHEN low > 100 THEN 'impossible' WHEN actual IS NULL THEN 'none' WHEN actual >= high THEN 'over'
WHEN actual >= low THEN 'edge' ELSE 'under' END AS verdict FROM (
SELECT vaccine, round(100 * (1 - 1 / lo) / ve, 2) AS low, round(100 * (1 - 1 / (lo + 2)) / ve, 2) AS high, actual, actual_year FROM (
SELECT vaccine, CAST(2 + k % 9 AS DOUBLE) AS lo, CASE WHEN k % 4 = 0 THEN 0.5 ELSE 0.95 END AS ve, a AS actual, y AS actual_year FROM
(SELECT vaccine, CAST(substring(vaccine, 7) AS INT) AS k, arg_max(value, year) FILTER (age = CASE WHEN
CAST(substring(vaccine, 7) AS INT) % 5 = 4 THEN 9 ELSE 1 + CAST(substring(vaccine, 7) AS INT) % 2 END) AS a, max(year) FILTER (age = CASE WHEN
CAST(substring(vaccine, 7) AS INT) % 5 = 4 THEN 9 ELSE 1 + CAST(substring(vaccine, 7) AS INT) % 2 END) AS y FROM {coverage} GROUP BY 1))))""")
def _(v):
    k = F.substring("vaccine", 7, 9).cast("int")
    done = v.coverage.select("vaccine").distinct().withColumn("age", F.when(k % 5 == 4, 9).otherwise(1 + k % 2))
    df = s.latest_coverage(v.coverage, done).select("vaccine", (2 + k % 9).cast("double").alias("r0_lo"),
        F.when(k % 4 == 0, 0.5).otherwise(0.95).alias("ve"), "actual", "actual_year")
    return s.threshold_order(s.immunity_threshold(df.withColumn("r0_hi", F.col("r0_lo") + 2))).select("vaccine", "low", "high", "actual", "actual_year", "verdict", "place")


@query("a28_align_rate_and_cases", """WITH l AS (SELECT DISTINCT vaccine, '1-URGENT' AS condition FROM {coverage} WHERE vaccine < 'Brand#2' UNION
SELECT DISTINCT vaccine, '2-HIGH' FROM {coverage} WHERE vaccine > 'Brand#4'),
r AS (SELECT vaccine, year, value AS rate FROM {coverage} WHERE age = 1 AND (year +
CAST(substring(vaccine, 7) AS INT)) % 3 > 0), n AS (SELECT vaccine, count(DISTINCT year) AS y FROM r GROUP BY 1),
c AS (SELECT condition, arg_min(vaccine, printf('%03d', CAST(100 - y AS INT)) || vaccine) AS vaccine FROM l JOIN n USING (vaccine)
GROUP BY 1), j AS (SELECT a.entity AS condition, c.vaccine, a.year, a.value, r.rate FROM {annual} a JOIN c ON c.condition = a.entity LEFT
JOIN r ON r.vaccine = c.vaccine AND r.year = a.year)
SELECT condition, vaccine, count(*) AS years,
count(rate) AS with_rate, arg_min(year, year - value * 10000) AS peak_year, max(rate) FILTER (year = (SELECT arg_min(year, year - value * 10000)
FROM j z WHERE z.condition = j.condition)) AS peak_rate FROM j GROUP BY 1, 2""")
def _(v):
    c = v.coverage
    links = c.where("vaccine < 'Brand#2'").select("vaccine",
        F.lit("1-URGENT").alias("condition")).union(c.where("vaccine > 'Brand#4'").select("vaccine", F.lit("2-HIGH"))).distinct()
    rates = c.where((F.col("age") == 1) & ((F.col("year") + F.substring("vaccine", 7, 9).cast("int")) % 3 > 0)).select("vaccine", "year", F.col("value").alias("rate"))
    return s.align_rate_and_cases(links, rates, v.annual.select(F.col("entity").alias("condition"), "year", F.col("value").alias("n")))


@query("a29_lowest_per_year", """SELECT year, age, value FROM (SELECT year, age, value, row_number() OVER (PARTITION BY year ORDER BY value, age) AS k
FROM {coverage} WHERE vaccine = 'Brand#11') WHERE k = 1""")
def _(v):
    return s.lowest_per_year(v.coverage.where("vaccine = 'Brand#11'"))


@query("a30_event_history", f"""SELECT 'surge' AS theme, entity AS title, year, round(least(96.0, 68 + 12 * log10(r)), 4) AS weight,
CAST(NULL AS BIGINT) AS doc FROM {_SURGE} UNION ALL SELECT 'guide', name, min(year), CAST(least(84, 52 + 2 * count(*)) AS DOUBLE), arg_min(doc,
CAST(year AS BIGINT) * 10000000 + doc) FROM {{catalogue}} GROUP BY name HAVING count(*) >= 3""")
def _(v):
    guides = s.first_appearances(v.catalogue.withColumnRenamed("name", "series")).select(F.col("series").alias("title"), "year",
        F.col("weight").cast("double").alias("weight"), "doc")
    return s.event_history({"surge": _surges(v).select(F.col("entity").alias("title"), "year", "weight"), "guide": guides})


@query("a35_break_aware_compare", """WITH p AS (SELECT entity, a AS y1, a + 1 AS y2 FROM (SELECT DISTINCT entity FROM {annual}), range(1995, 2003) t(a))
SELECT p.entity, CAST(y1 AS INT) AS y1, CAST(y2 AS INT) AS y2, u.value AS v1, w.value AS v2, CASE WHEN u.value IS NULL OR w.value IS NULL THEN 'missing' WHEN p.entity < '3' AND y2 = 1998 OR p.entity > '4' AND y2 = 2000 THEN 'not comparable' WHEN y1 = 2001 OR y2 = 2001 THEN 'caution' ELSE 'comparable' END AS verdict
FROM p LEFT JOIN {annual} u ON u.entity = p.entity AND u.year = y1 LEFT JOIN {annual} w ON w.entity = p.entity AND w.year = y2""")
def _(v):
    entities = v.annual.select("entity").distinct()
    pairs = entities.withColumn("y1", F.explode(F.sequence(F.lit(1995), F.lit(2002)))).withColumn("y2", F.col("y1") + 1)
    breaks = entities.select("entity", F.when(F.col("entity") < "3", 1998).when(F.col("entity") > "4", 2000).alias("year")).where("year IS NOT NULL")
    return s.break_aware_compare(v.annual.withColumn("partial", F.col("year") == 2001), breaks, pairs)


@query("a36_edition_files", """SELECT year, until, CASE WHEN year >= 2020 THEN 'agency' WHEN year >= 2005 THEN 'centre' END AS body,
coalesce(string_agg(CASE p % 3 WHEN 1 THEN 'text' ELSE 'main' END || '=' || 'f' || p || '.pdf', ',' ORDER BY CASE p % 3
WHEN 1 THEN 'text' ELSE 'main' END, 'f' || p || '.pdf') FILTER (p % 3 > 0), '') AS links, count(*) AS files, count(*) FILTER (p % 4 = 0) AS hidden,
count(*) FILTER (p % 3 > 0) AS downloadable, array_to_string(list_sort(list(DISTINCT CASE p % 3 WHEN 0 THEN 'english'
WHEN 1 THEN 'text' ELSE 'main' END)), ',') AS kinds FROM (SELECT doc AS p, year, CASE WHEN doc % 2 = 0 THEN year + 1 END AS until FROM {catalogue})
GROUP BY 1, 2""")
def _(v):
    d = F.col("doc")
    span = F.when(d % 2 == 0, F.concat(F.col("year").cast("string"), F.lit("~"), (F.col("year") + 1).cast("string"))).otherwise(F.col("year").cast("string"))
    label = F.concat(span, F.lit(" white paper "), F.when(d % 3 == 0, "(English)").when(d % 3 == 1, "Text").otherwise(""))
    return s.edition_files(v.catalogue.select(label.alias("label"), (d % 4 == 0).alias("hidden"),
        F.when(d % 3 > 0, F.concat(F.lit("f"), d.cast("string"), F.lit(".pdf"))).otherwise("").alias("file")), [(2005, "centre"), (2020, "agency")]).withColumn(
        "links", F.array_join(F.transform("links", lambda x: F.concat(x.kind, F.lit("="), x.file)), ","))


@query("a37_coalesce_same_stem", """SELECT 'part' || k AS stem, min(p_partkey) AS place, arg_min(CASE
WHEN p_size % 2 = 0 THEN p_size END, p_partkey) FILTER (p_size % 2 = 0) AS rows, arg_max(p_type, length(p_type) * 1000000 + 0) AS x, string_agg(CASE
WHEN p_partkey % 2 = 0 THEN 'csv' ELSE 'json' END, ',' ORDER BY p_partkey) AS formats FROM (SELECT *, p_partkey % 50 AS k FROM {part}) GROUP BY k""".replace(" arg_max(p_type, length(p_type) * 1000000 + 0) AS x,", " max(length(p_type)) AS note_length,"))
def _(v):
    name = F.concat(F.lit("part"), (F.col("p_partkey") % 50).cast("string"), F.when(F.col("p_partkey") % 2 == 0, ".csv").otherwise(".json"))
    r = s.coalesce_same_stem(v.part.select(F.col("p_partkey").alias("place"), name.alias("name"),
        F.when(F.col("p_size") % 2 == 0, F.col("p_size")).alias("rows"), F.col("p_type").alias("note")))
    return r.withColumn("note_length", F.length("note").cast("long")).drop("note")


@query("w2_quota_top_k", """WITH t AS (SELECT year, board AS theme, doc AS id, doc * 37 % 101 AS weight FROM {catalogue}), r AS (SELECT *,
row_number() OVER (PARTITION BY year, theme ORDER BY weight DESC, id) AS k FROM t),
p AS (SELECT *, row_number() OVER (PARTITION BY year ORDER BY CASE WHEN k <= 3 THEN 0 WHEN k <= 5 THEN 1 ELSE 2 END, weight DESC, id) AS j FROM r)
SELECT year, theme, id, weight, row_number() OVER (PARTITION BY year ORDER BY weight DESC, id) AS place FROM p WHERE j <= 10""")
def _(v):
    return s.quota_top_k(v.catalogue.select("year", F.col("board").alias("theme"), F.col("doc").alias("id"), (F.col("doc") * 37 % 101).alias("weight")), "year", "theme")


@query("w3_fuzzy_dedup_by_weight", """SELECT id, year FROM (SELECT doc AS id, year,
row_number() OVER (PARTITION BY year, lpad(CAST(doc % 40 AS VARCHAR), 2, '0') ORDER BY doc * 37 % 101 DESC, doc) AS k FROM {catalogue}) WHERE k = 1""")
def _(v):
    # Equal bases differ by punctuation and by what follows the first 24 characters only.
    title = F.concat(F.lit("The Very Long Exhibits "), F.lpad((F.col("doc") % 40).cast("string"), 2, "0"), F.lit(" xyz: "), F.col("doc").cast("string"))
    return s.fuzzy_dedup_by_weight(v.catalogue.select(F.col("doc").alias("id"), "year", title.alias("title"), (F.col("doc") * 37 % 101).alias("weight"))).select("id", "year")


@query("w4_primary_document", """SELECT board AS entity, doc FROM (SELECT *, row_number() OVER (PARTITION BY board ORDER BY CASE
WHEN year < 2006 THEN 1 ELSE 0 END, CASE WHEN kind = 'guide' THEN 0 ELSE 1 END, doc % 3, CASE WHEN doc % 20 <= 2 THEN 0
WHEN doc % 20 <= 9 THEN 1 ELSE 2 END, year DESC, doc % 20, doc) AS k FROM {catalogue}) WHERE k = 1""")
def _(v):
    d = F.col("doc")
    rows = v.catalogue.select(F.col("board").alias("entity"), "doc", "year", (F.col("year") < 2006).alias("old"),
        F.when(F.col("kind") == "guide", "direct").otherwise("group").alias("how"), (d % 3).alias("tier"), (d % 20).alias("scope"))
    return s.primary_document(rows).select("entity", "doc")


@query("t1_retain_newest", "SELECT event_id AS id, {date:ts} AS date FROM {events} ORDER BY {date:ts} DESC, user_id DESC, event_id LIMIT 400")
def _(v):
    items = v.events.select(F.col("event_id").alias("id"), F.date_format("ts", "yyyy-MM-dd").alias("date"), F.col("user_id").alias("first_seen"))
    return s.retain_newest(items).select("id", "date")


@query("t3_severity_order", """SELECT c_custkey, c_mktsegment, row_number() OVER (ORDER BY CASE c_mktsegment WHEN 'MACHINERY' THEN 0
WHEN 'BUILDING' THEN 1 ELSE 2 END, c_acctbal, c_custkey) AS place FROM {customer}""")
def _(v):
    return s.severity_order(v.customer.select("c_custkey", "c_mktsegment", "c_acctbal"), "c_mktsegment", ["MACHINERY", "BUILDING"],
        [F.col("c_acctbal"), F.col("c_custkey")]).drop("c_acctbal")


@query("e3_catalogue_reconcile", """SELECT l_orderkey AS k, CASE WHEN l_orderkey % 10 = 0 THEN 'orphan'
WHEN l_orderkey % 10 = 1 THEN 'count differs' END AS state FROM (SELECT DISTINCT l_orderkey FROM {lineitem}) WHERE l_orderkey % 10 IN (0, 1)
UNION ALL SELECT -n_nationkey - 1, 'missing' FROM {nation}""")
def _(v):
    have = v.lineitem.select(F.col("l_orderkey").alias("k"))
    listed = have.groupBy("k").agg(F.count("*").alias("n")).where("k % 10 <> 0").withColumn("n", F.when(F.col("k") % 10 == 1, F.col("n") + 1).otherwise(F.col("n")))
    return s.catalogue_reconcile(listed.union(v.nation.select((-F.col("n_nationkey").cast("long") - 1), F.lit(1).cast("long"))), have, "k")


@query("e4_keep_previous", """SELECT o_orderkey, 'new' AS origin FROM {orders} WHERE o_orderkey % 3 = 0 UNION ALL SELECT o_orderkey, 'old' FROM {orders}
WHERE o_orderkey % 2 = 0 AND o_orderkey % 3 <> 0""")
def _(v):
    o = v.orders.select("o_orderkey")
    return s.keep_previous(o.where("o_orderkey % 3 = 0").withColumn("origin", F.lit("new")), o.where("o_orderkey % 2 = 0").withColumn("origin", F.lit("old")), "o_orderkey")


@query("e5_signature_twins", """SELECT p_brand, p_type, p_size, string_agg(p_partkey, ',' ORDER BY p_partkey) AS members FROM {part}
GROUP BY 1, 2, 3 HAVING count(*) > 1""")
def _(v):
    return s.signature_twins(v.part, "p_partkey", ["p_brand", "p_type", "p_size"]).withColumn("members", F.array_join(F.col("members").cast("array<string>"), ","))
