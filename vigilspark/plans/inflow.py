"""Queries for vigilspark.operators.inflow."""

from pyspark.sql import functions as F

from vigilspark.functions.clean import norm_key
from vigilspark.operators import inflow as i
from vigilspark.plans.registry import query


@query("j2_resolve_names", """SELECT n_nationkey, CASE WHEN n_nationkey % 9 = 8 THEN NULL ELSE n_nationkey END AS code, n_nationkey % 9 = 8 AS ignored
FROM {nation}""")
def _(v):
    shape = F.when(F.col("n_nationkey") % 9 == 8, "Stateless").when(F.col("n_nationkey") % 3 == 0,
        F.regexp_replace(F.lower("n_name"), "_", " ")).when(F.col("n_nationkey") % 3 == 1,
            F.regexp_replace("n_name", "_(.*)", "($1)")).otherwise(F.concat(F.lit("Rep. of "), "n_name"))
    names = v.nation.select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("code"))
    aliases = v.nation.select(F.concat(F.lit("Rep of "), "n_name").alias("name"), F.col("n_nationkey").alias("code"))
    return i.require_resolved(i.resolve_names(v.nation.select("n_nationkey", shape.alias("label")), "label", names, aliases, ["Stateless"], norm_key), "label").drop("label")


@query("j3_assemble_entity_table", """
SELECT coalesce(e.country, a.country, d.country) AS country, e.entries, a.direct, d.designated, e.country IS NOT NULL AS has_entries, a.country IS NOT NULL AS has_air, d.country IS NOT NULL AS has_designation
FROM (SELECT country, CAST(sum(n) AS BIGINT) AS entries FROM {entries} GROUP BY 1) e FULL JOIN (SELECT country, CAST(sum(total - transit) AS BIGINT) AS direct FROM {arrivals} WHERE year = 1998 AND total % 5 <> 0 GROUP BY 1) a ON e.country = a.country
FULL JOIN (SELECT country, count(*) AS designated FROM {designation} GROUP BY 1) d ON coalesce(e.country, a.country) = d.country WHERE coalesce(e.country, a.country, d.country) <> 'NATION_3'""")
def _(v):
    return i.assemble_entity_table({
        "entries": v.entries.groupBy("country").agg(F.sum("n").alias("entries")),
        "air": v.arrivals.where("year = 1998 AND total % 5 <> 0").groupBy("country").agg(F.sum(F.col("total") - F.col("transit")).alias("direct")),
        "designation": v.designation.groupBy("country").agg(F.count("*").alias("designated")),
    }, "country", "NATION_3")


@query("j3_display_names", """SELECT n_name AS country, CASE WHEN n_nationkey % 5 = 0 THEN 'Rep. ' || n_nationkey
WHEN n_nationkey % 3 = 0 THEN n_name ELSE lower(n_name) END AS name FROM {nation}""")
def _(v):
    usual = v.nation.where("n_nationkey % 3 > 0").select(F.col("n_name").alias("country"), F.lower("n_name").alias("name"))
    other = v.nation.where("n_nationkey % 5 = 0").select(F.col("n_name").alias("country"), F.concat(F.lit("Rep. "), F.col("n_nationkey").cast("string")).alias("name"))
    return i.display_names(v.nation.select(F.col("n_name").alias("country")), "country", usual, other)


@query("j4_designation_match", """SELECT r.country, r.condition, r.n, d.country IS NOT NULL AS hit FROM (SELECT country, condition,
CAST(sum(n) AS BIGINT) AS n FROM {imports} WHERE condition <> '5-LOW' GROUP BY 1, 2) r LEFT JOIN {designation} d ON r.country = d.country
AND r.condition = d.condition""")
def _(v):
    return i.designation_match(v.imports, v.designation, v.designation.where("condition <> '5-LOW'").select("condition").distinct())


@query("j5_list_membership_flags", """SELECT n_name AS country, n_name IN (SELECT country FROM {designation}
WHERE level = 'priority') AS priority, n_name IN (SELECT country FROM {designation} WHERE level = 'general') AS general FROM {nation}""")
def _(v):
    d = v.designation
    return i.list_membership_flags(v.nation.select(F.col("n_name").alias("country")), "country", {k: d.where(F.col("level") == k) for k in ("priority", "general")})


@query("j21_wide_kinds_merge", """SELECT l_suppkey, CAST(sum(l_quantity) AS BIGINT) AS total, CAST(sum(CASE
WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) AS BIGINT) AS transit FROM {lineitem} GROUP BY 1""")
def _(v):
    q = F.col("l_quantity").cast("long")
    rows = v.lineitem.select("l_suppkey", F.lit("total").alias("kind"), q.alias("value")).union(v.lineitem.where("l_returnflag = 'R'").select("l_suppkey", F.lit("transit"), q))
    return i.wide_kinds_merge(rows, ["l_suppkey"], ["total", "transit"])


@query("j23_notices_mentioning", """SELECT n_name AS entity, o_orderkey, effective
FROM (SELECT o_orderkey, {date:o_orderdate} AS effective, 'notice on NATION_' || o_custkey % 30 || '.' AS note FROM {orders}) o
JOIN {nation} ON contains(note, n_name || '.') WHERE effective > '2001-01-01'""")
def _(v):
    notices = v.orders.select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("effective"),
        F.concat(F.lit("notice on NATION_"), (F.col("o_custkey") % 30).cast("string"), F.lit(". key "), F.col("o_orderkey").cast("string")).alias("note"))
    hits = i.notices_mentioning(v.nation.select(F.concat("n_name", F.lit(".")).alias("entity")), notices, "2001-01-01")
    return hits.select(F.rtrim(F.col("entity"), F.lit(".")).alias("entity"), F.regexp_extract("note", r"key (\d+)", 1).cast("long").alias("o_orderkey"), "effective")


@query("a7_imports_by_country", """SELECT country, CAST(sum(n) AS BIGINT) AS n, string_agg(condition || '=' || n, ','
ORDER BY n DESC, condition) AS conditions, CAST(min(f) AS INT) AS first, CAST(max(l) AS INT) AS last FROM (
SELECT country, condition, CAST(sum(n) AS BIGINT) AS n, min(year * 100 + week) AS f, max(year * 100 + week) AS l FROM {imports} GROUP BY 1, 2)
GROUP BY 1""")
def _(v):
    cell = lambda x: F.concat(x.condition, F.lit("="), x.n.cast("string"))
    code = lambda c: (F.col(f"{c}.year") * 100 + F.col(f"{c}.week")).cast("int").alias(c)
    return i.imports_by_country(v.imports).select("country", "n", F.array_join(F.transform("conditions", cell), ",").alias("conditions"), code("first"), code("last"))


@query("a8_monthly_entries", """SELECT c.country, m.month, coalesce(e.n, 0) AS n FROM (SELECT DISTINCT country FROM {entries}
WHERE month BETWEEN '1996-11' AND '1998-02') c CROSS JOIN (SELECT strftime(d, '%Y-%m') AS month
FROM range(DATE '1996-11-01', DATE '1998-02-02', INTERVAL 1 MONTH) t(d)) m LEFT JOIN {entries} e ON e.country = c.country AND e.month = m.month""")
def _(v):
    return i.monthly_entries(v.entries, "1996-11", "1998-02")


@query("a8_entry_totals", """SELECT CAST(sum(n) FILTER (country NOT LIKE '%1') AS BIGINT) AS total,
CAST(sum(n) FILTER (country LIKE '%1') AS BIGINT) AS unmapped FROM {entries} WHERE month BETWEEN '1996-11' AND '1998-02'""")
def _(v):
    return i.entry_totals(v.entries.withColumn("country", F.when(~F.endswith("country", F.lit("1")), F.col("country"))), "1996-11", "1998-02")


@query("a9_direct_arrivals", """SELECT country, CAST(sum(flights) AS BIGINT) AS flights, CAST(sum(total) AS BIGINT) AS total,
CAST(sum(transit) AS BIGINT) AS transit, CAST(sum(total - transit) AS BIGINT) AS direct, string_agg(year || ':' || (total - transit), ' '
ORDER BY year) AS years FROM {arrivals} GROUP BY 1""")
def _(v):
    years = F.array_join(F.transform("years", lambda y: F.concat(y.year.cast("string"), F.lit(":"), y.direct.cast("string"))), " ")
    return i.direct_arrivals(v.arrivals).withColumn("years", years)


_RATES = """(SELECT e.country, CAST(e.entries AS BIGINT) AS denominator, CASE WHEN k % 5 = 0 THEN 0 ELSE r.n END AS n FROM (SELECT country,
sum(n) AS entries, CAST(substring(country, 8) AS INT) AS k FROM {entries} GROUP BY 1) e JOIN (SELECT country, CAST(sum(n) AS BIGINT) AS n
FROM {imports} WHERE condition = '1-URGENT' GROUP BY 1) r ON e.country = r.country)"""


def _rates(v):
    e = v.entries.groupBy("country").agg(F.sum("n").alias("denominator"))
    r = v.imports.where("condition = '1-URGENT'").groupBy("country").agg(F.sum("n").alias("n"))
    n = F.when(F.substring("country", 8, 9).cast("int") % 5 == 0, 0).otherwise(F.col("n"))
    df = e.join(r, "country").withColumn("n", n)
    rate, state = i.rate_per_million(F.col("n"), F.col("denominator"))
    return df.withColumn("rate", rate).withColumn("state", state)


_RATED = f"""(SELECT *, CASE WHEN n > 0 AND denominator > 0 THEN round(n * 1000000.0 / denominator, 2) END AS rate, CASE
WHEN denominator <= 0 THEN 'no denominator' WHEN n = 0 THEN 'none seen' ELSE 'rate' END AS state FROM {_RATES})"""


@query("a10_rate_per_million", f"SELECT * FROM {_RATED}")
def _(v):
    return _rates(v)


@query("a11_nearest_rank_bins", f"""SELECT p, bound FROM (SELECT rate AS bound, row_number() OVER (ORDER BY rate) - 1 AS i, count(*) OVER () AS n
FROM {_RATED} WHERE rate > 0) JOIN (VALUES (0.25), (0.5), (0.75)) q(p) ON i = least(n - 1, floor(p * n))""")
def _(v):
    return i.nearest_rank_bins(_rates(v), "rate", [0.25, 0.5, 0.75])


@query("a12_rank_flips", f"""SELECT *, abs(by_count - by_rate) AS flip FROM (SELECT country, n, rate,
row_number() OVER (ORDER BY n DESC, country) AS by_count, row_number() OVER (ORDER BY rate DESC NULLS LAST, country) AS by_rate FROM {_RATED})""")
def _(v):
    return i.rank_flips(_rates(v).select("country", "n", "rate"), "country", "n", "rate")


@query("a13_ends_by_ratio", """WITH r AS (SELECT l_partkey, round(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) * 1.0 / count(*), 6) AS ratio,
count(*) AS base FROM {lineitem} GROUP BY 1), k AS (SELECT * FROM r WHERE base > 10)
SELECT * FROM (SELECT *, row_number() OVER (ORDER BY ratio, l_partkey) AS place, 'low' AS "end" FROM k) WHERE place <= 5 UNION ALL SELECT *
FROM (SELECT *, row_number() OVER (ORDER BY ratio DESC, l_partkey) AS place, 'high' AS "end" FROM k) WHERE place <= 5""")
def _(v):
    r = v.lineitem.groupBy("l_partkey").agg(F.round(F.count_if(F.col("l_returnflag") == "R") / F.count("*"), 6).alias("ratio"), F.count("*").alias("base"))
    return i.ends_by_ratio(r, "l_partkey", "ratio", "base", 10)


@query("a14_coverage_counts", """SELECT count(*) AS rows, count(*) FILTER (o_totalprice > 200000) AS large,
count(*) FILTER (o_orderstatus = 'F') AS done, count(*) FILTER (o_orderpriority = '1-URGENT' AND o_orderstatus <> 'F') AS waiting FROM {orders}""")
def _(v):
    rows = v.orders.select((F.col("o_totalprice") > 200_000).alias("large"), (F.col("o_orderstatus") == "F").alias("done"),
        ((F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderstatus") != "F")).alias("waiting"))
    return i.coverage_counts(rows, ["large", "done", "waiting"])


@query("a31_designation_by_entity", "SELECT country, string_agg(condition, ',' ORDER BY condition) AS conditions FROM {designation} GROUP BY 1")
def _(v):
    conditions = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    wide = i.pairs_to_marks(v.designation, "country", "condition", conditions).na.fill("")
    pairs = i.marks_to_pairs(wide, "country").withColumnRenamed("category", "condition")
    return i.designation_by_entity(pairs).withColumn("conditions", F.array_join("conditions", ","))


@query("d12_out_of_domain", "SELECT DISTINCT o_orderpriority FROM {orders} WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '5-LOW')")
def _(v):
    return i.out_of_domain(v.orders, "o_orderpriority", ["1-URGENT", "2-HIGH", "5-LOW"])


_TOP = "(SELECT country FROM (SELECT country, sum(total - transit) AS direct FROM {arrivals} GROUP BY 1) ORDER BY direct DESC, country LIMIT 4)"
_SETS = f"""(SELECT 'base' AS scenario, country, condition FROM {{designation}} UNION ALL
SELECT 'flights', country, condition FROM {{designation}} WHERE country IN (SELECT country FROM {{arrivals}} WHERE year = 1997 AND total % 3 = 0)
UNION ALL
SELECT 'reported', d.country, d.condition FROM {{designation}} d WHERE EXISTS (SELECT 1 FROM {{imports}} i WHERE i.country = d.country
AND i.condition = d.condition AND i.year = 1999) UNION ALL
SELECT 'priority', country, condition FROM {{designation}} WHERE level = 'priority' UNION ALL SELECT 'without', country, condition
FROM {{designation}} WHERE condition <> '2-HIGH' UNION ALL
SELECT 'more', country, condition FROM (SELECT country, condition FROM {{designation}} UNION SELECT t.country, d.condition FROM {_TOP} t CROSS
JOIN (SELECT DISTINCT condition FROM {{designation}}) d))"""


def _entities(v):
    return v.arrivals.where("year < 1999 AND total % 2 = 0").groupBy("country").agg(F.sum(F.col("total") - F.col("transit")).alias("direct"))


def _sets(v):
    direct = v.arrivals.groupBy("country").agg(F.sum(F.col("total") - F.col("transit")).alias("direct"))
    return i.scenario_sets(v.designation, v.arrivals.where("year = 1997 AND total % 3 = 0").select("country"),
        v.imports.where("year = 1999").select("country", "condition"), "2-HIGH", i.top_entities(direct, "direct", "country", 4))


@query("e1_scenario_sets", f"SELECT * FROM {_SETS}")
def _(v):
    return _sets(v)


@query("e2_scenario_diff", f"""WITH s AS {_SETS} SELECT country, condition, 'added' AS change FROM (SELECT country, condition FROM s
WHERE scenario = 'more' EXCEPT SELECT country, condition FROM s WHERE scenario = 'without') UNION ALL SELECT country, condition, 'removed'
FROM (SELECT country, condition FROM s WHERE scenario = 'without' EXCEPT SELECT country, condition FROM s WHERE scenario = 'more')""")
def _(v):
    s = _sets(v)
    return i.scenario_diff(s.where("scenario = 'without'"), s.where("scenario = 'more'"))


@query("e2_scenario_gains", f"""WITH s AS {_SETS}, b AS (SELECT country, condition FROM {{designation}} WHERE level = 'priority'), e AS (SELECT country,
sum(total - transit) AS direct FROM {{arrivals}} WHERE year < 1999 AND total % 2 = 0 GROUP BY 1),
c AS (SELECT scenario, country FROM s WHERE country NOT IN (SELECT country FROM b) GROUP BY 1, 2)
SELECT scenario, count(*) FILTER (b.country IS NULL) AS added, (SELECT count(*) FROM b) - count(b.country) AS removed, (SELECT count(*) FROM c
WHERE c.scenario = s.scenario) AS new_countries,
CAST(coalesce((SELECT sum(direct) FROM c JOIN e USING (country) WHERE c.scenario = s.scenario), 0) AS BIGINT) AS new_direct FROM s LEFT
JOIN b ON s.country = b.country AND s.condition = b.condition GROUP BY 1""")
def _(v):
    return i.scenario_gains(_sets(v), v.designation.where("level = 'priority'"), _entities(v))


@query("a38_entity_list", f"""WITH s AS {_SETS}, e AS (SELECT n_name AS country, coalesce(direct, 0) AS direct, coalesce(entries, 0) AS entries
FROM {{nation}} LEFT JOIN (SELECT country, sum(total - transit) AS direct FROM {{arrivals}} WHERE year < 1999 AND total % 2 = 0
GROUP BY 1) a ON a.country = n_name
LEFT JOIN (SELECT country, sum(n) AS entries FROM {{entries}} WHERE month < '1997' GROUP BY 1) m ON m.country = n_name)
SELECT k.scenario, k.condition, string_agg(e.country, ',' ORDER BY s.country IS NULL, direct DESC, entries DESC, e.country) AS countries
FROM (SELECT DISTINCT scenario, condition FROM s) k CROSS JOIN e
LEFT JOIN s ON s.scenario = k.scenario AND s.condition = k.condition AND s.country = e.country GROUP BY 1, 2""")
def _(v):
    entered = v.entries.where("month < '1997'").groupBy("country").agg(F.sum("n").alias("entries"))
    entities = v.nation.select(F.col("n_name").alias("country")).join(_entities(v), "country", "left").join(entered, "country", "left")
    return i.entity_list(_sets(v), entities).withColumn("countries", F.array_join("countries", ","))


@query("a32_scenario_metrics", f"""WITH s AS {_SETS}, c AS (SELECT country, condition, sum(n) AS n FROM {{imports}} WHERE year = 1999
GROUP BY 1, 2), e AS (SELECT country, sum(total - transit) AS direct FROM {{arrivals}} WHERE year < 1999 AND total % 2 = 0 GROUP BY 1),
p AS (SELECT scenario, count(*) AS pairs, CAST(coalesce(sum(n), 0) AS BIGINT) AS covered_n, count(n) AS covered_pairs FROM s LEFT
JOIN c USING (country, condition) GROUP BY 1),
k AS (SELECT scenario, count(*) AS countries, CAST(coalesce(sum(direct), 0) AS BIGINT) AS direct, count(*) FILTER (direct IS NULL) AS without_flights
FROM (SELECT DISTINCT scenario, country FROM s) LEFT JOIN e USING (country) GROUP BY 1)
SELECT *, round(100.0 * covered_n / (SELECT sum(n) FROM c), 2) AS covered_share, round(CASE
WHEN direct <> 0 THEN covered_n * 1000000.0 / direct END, 2) AS covered_per_million FROM p JOIN k USING (scenario)""")
def _(v):
    return i.scenario_metrics(_sets(v), v.imports.where("year = 1999"), _entities(v))


@query("a38_scenario_by_condition", f"""WITH s AS {_SETS}, c AS (SELECT country, condition, sum(n) AS n FROM {{imports}} GROUP BY 1, 2)
SELECT s.scenario, s.condition, count(*) AS designated, (SELECT count(*) FROM s b WHERE b.scenario = 'base' AND b.condition = s.condition) AS in_base,
CAST(coalesce((SELECT sum(n) FROM c WHERE c.condition = s.condition), 0) AS BIGINT) AS reported_n, CAST(coalesce(sum(c.n), 0) AS BIGINT) AS covered_n
FROM s LEFT JOIN c ON s.country = c.country AND s.condition = c.condition GROUP BY 1, 2""")
def _(v):
    return i.scenario_by_condition(_sets(v), v.designation, v.imports)


@query("t2_top_entities", "SELECT c_custkey, c_acctbal FROM {customer} ORDER BY c_acctbal DESC, c_custkey LIMIT 20")
def _(v):
    return i.top_entities(v.customer.select("c_custkey", "c_acctbal"), "c_acctbal", "c_custkey", 20)
