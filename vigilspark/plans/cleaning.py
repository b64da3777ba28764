"""Queries for vigilspark.functions.clean (P1 to P16)."""

from pyspark.sql import functions as F

from vigilspark.functions import clean as c
from vigilspark.plans.registry import query


@query("p1_clean_number", """
SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN NULL ELSE CAST(p_partkey * 1000 + p_size AS DOUBLE) END AS value,
       CASE WHEN p_size % 7 = 0 OR p_size % 5 = 0 THEN NULL ELSE CAST(p_partkey * 1000 + p_size AS BIGINT) END AS whole FROM {part}""")
def _(v):
    number = F.format_number(F.col("p_partkey") * 1000 + F.col("p_size"), 0)
    cell = F.when(F.col("p_size") % 7 == 0, F.element_at(F.array(F.lit("-"), F.lit("–"), F.lit(" "), F.lit("")), (F.col("p_size") % 4 + 1).cast("int"))).otherwise(number)
    return v.part.select("p_partkey", c.clean_number(cell).alias("value"), c.clean_number(F.when(F.col("p_size") % 5 == 0, F.lit("n/a")).otherwise(cell), True).alias("whole"))


@query("p2_valid_ranges", """SELECT l_orderkey, l_linenumber, week, pct FROM (SELECT l_orderkey, l_linenumber,
CAST(l_quantity AS INT) + 5 AS week, l_discount * 1200 AS pct FROM {lineitem}) WHERE week BETWEEN 1 AND 53 AND pct BETWEEN 0 AND 100""")
def _(v):
    rows = v.lineitem.select("l_orderkey", "l_linenumber", (F.col("l_quantity").cast("int") + 5).alias("week"), (F.col("l_discount") * 1200).alias("pct"))
    return c.valid_ranges(rows, {"week": (1, 53), "pct": (0, 100)})


@query("p3_flag_impossible", """SELECT o_orderkey, measure, value, CASE WHEN measure = 'rate' AND value > 100 THEN 'rate over 100' WHEN measure = 'count'
AND value > 200000 THEN 'count too large' END AS anomaly FROM (SELECT o_orderkey, CASE
WHEN o_orderkey % 2 = 0 THEN 'rate' ELSE 'count' END AS measure, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice / 3000 ELSE o_totalprice END AS value
FROM {orders})""")
def _(v):
    even = F.col("o_orderkey") % 2 == 0
    rows = v.orders.select("o_orderkey", F.when(even, "rate").otherwise("count").alias("measure"),
        F.when(even, F.col("o_totalprice") / 3000).otherwise(F.col("o_totalprice")).alias("value"))
    return c.flag_impossible(rows, [("rate", "rate over 100", 100), ("count", "count too large", 200_000)])


@query("p4_keep_drop", "SELECT p_partkey, p_name FROM {part} WHERE regexp_matches(p_name, 'a') AND NOT regexp_matches(p_name, 'e.*o')")
def _(v):
    return c.keep_drop(v.part.select("p_partkey", "p_name"), "p_name", "a", "e.*o")


@query("p5_classify_first", """SELECT p_partkey, CASE WHEN regexp_matches(p_type, 'STEEL|BRASS') THEN 'alloy'
WHEN regexp_matches(p_type, '^S') THEN 'standard' WHEN regexp_matches(p_type, 'TIN') THEN 'tin' ELSE 'other' END AS class FROM {part}""")
def _(v):
    return v.part.select("p_partkey", c.classify_first(F.col("p_type"), [("alloy", "STEEL|BRASS"), ("standard", "^S"), ("tin", "TIN")], "other").alias("class"))


@query("p6_classify_multi", """SELECT p_partkey, g.grp AS \"group\"
FROM {part}, (VALUES ('first', '^[A-M]'), ('last', '[N-Z]$'), ('vowel', '[AEIOU]')) g(grp, pat) WHERE regexp_matches(p_type, g.pat)""")
def _(v):
    return c.classify_multi(v.part.select("p_partkey", "p_type"), "p_type", [("first", "^[A-M]"), ("last", "[N-Z]$"), ("vowel", "[AEIOU]")]).drop("p_type")


@query("p7_classify_keywords", """SELECT doc_id, CASE WHEN contains(text, 'whst') OR contains(text, 'inor') THEN 'strong'
WHEN contains(text, 'the') THEN 'weak' ELSE 'none' END AS class FROM {documents}""")
def _(v):
    return v.documents.select("doc_id", c.classify_keywords(F.col("text"), ["whst", "inor"], ["the"], "strong", "weak", "none").alias("class"))


@query("p8_norm_key", """SELECT n_nationkey, lower(replace(n_name, '_', '')) AS marks, lower(n_name) AS spaces, lower(n_name) AS brackets, lower(replace(n_name, '_', '')) AS alnum
FROM {nation}""")
def _(v):
    shapes = F.element_at(F.array(F.regexp_replace("n_name", "_", " "), F.regexp_replace("n_name", "_(.*)", " ($1)"),
        F.regexp_replace("n_name", "_", " · ")), (F.col("n_nationkey") % 3 + 1).cast("int"))
    return v.nation.select("n_nationkey", c.norm_key(shapes, "marks").alias("marks"), c.norm_key(F.concat(F.lit(" "), "n_name"), "spaces").alias("spaces"),
                           c.norm_key(F.concat(F.lit("("), "n_name", F.lit(") ")), "brackets").alias("brackets"), c.norm_key(shapes, "alnum").alias("alnum"))


@query("p9_series_key", """SELECT doc, lower(regexp_replace(name, '[^A-Za-z0-9]+', '', 'g')) || 'guideline' AS series_key, name || ' guideline (' || board || ')' AS series_title
FROM {catalogue}""")
def _(v):
    return v.catalogue.select("doc", c.series_key(F.col("title")).alias("series_key"), c.series_title(F.col("title")).alias("series_title"))


@query("p10_plausible_year", "SELECT doc, CASE WHEN year BETWEEN 2005 AND 2020 THEN year WHEN doc % 5 = 0 THEN 0 ELSE 2030 END AS year FROM {catalogue}")
def _(v):
    date = F.when(F.col("doc") % 5 == 0, F.lit("")).otherwise(F.lit("2030-01-02"))
    title = F.concat(F.lit("220902 no. 12345 of "), F.col("title"))
    return v.catalogue.select("doc", c.plausible_year(title, date, 2005, 2020).alias("year"))


@query("p11_infer_week_year", "SELECT DISTINCT week, CASE WHEN week > 8 THEN 2000 ELSE 2001 END AS year FROM {notif}")
def _(v):
    return v.notif.select("week").distinct().select("week", c.infer_week_year(F.col("week"), F.lit(2), F.lit(2001)).alias("year"))


@query("p12_canonical_name", """SELECT l_orderkey, l_linenumber, CASE
WHEN l_returnflag IN ('A', 'R') THEN 'settled' ELSE l_returnflag END AS flag, l_returnflag AS flag_raw FROM {lineitem}""")
def _(v):
    variants = v.spark.createDataFrame([("A", "settled"), ("R", "settled")], "variant string, canonical string")
    return c.canonical_name(v.lineitem.select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("flag")), "flag", variants)


@query("p13_period_filter", "SELECT * FROM {entries} WHERE month BETWEEN '1996-03' AND '1998-02'")
def _(v):
    return c.period_filter(v.entries, "month", "1996-03", "1998-02")


@query("p14_pack_code", """SELECT doc, CASE WHEN doc % 4 = 0 THEN 'https://other.example/' || doc ELSE 'd' || doc END AS code, CASE
WHEN doc % 4 = 0 THEN 'https://other.example/' || doc ELSE url END AS url FROM {catalogue}""")
def _(v):
    prefix = "https://example.org/doc?id="
    url = F.when(F.col("doc") % 4 == 0, F.concat(F.lit("https://other.example/"), F.col("doc").cast("string"))).otherwise(F.col("url"))
    code = c.pack_code(url, prefix, "d")
    return v.catalogue.select("doc", code.alias("code"), c.unpack_code(code, prefix, "d").alias("url"))


@query("p15_dictionary_encode", "SELECT p_partkey, p_name, CAST(dense_rank() OVER (ORDER BY p_name) - 1 AS INT) AS code FROM {part}")
def _(v):
    return c.dictionary_encode(v.part.select("p_partkey", "p_name"), "p_name", "code")


@query("p16_faceted_filter", """
SELECT name, kind, field, last_year FROM (SELECT name, min(kind) AS kind, min(field) AS field, max(year) AS last_year, list(title) AS titles FROM {catalogue} GROUP BY name)
WHERE kind IN ('guide', 'manual') AND last_year >= 2024 AND len(list_filter(titles, lambda t: contains(lower(t), '2010'))) > 0 AND len(list_filter(titles, lambda t: contains(lower(t), 'guideline'))) > 0""")
def _(v):
    series = v.catalogue.groupBy("name").agg(F.min("kind").alias("kind"), F.min("field").alias("field"), F.max("year").alias("last_year"), F.collect_list("title").alias("titles"))
    return c.faceted_filter(series, ["guide", "manual"], None, "current", 2025, ["2010", "Guideline"]).drop("titles")
