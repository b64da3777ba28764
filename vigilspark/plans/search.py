"""Queries for vigilspark.operators.search: the corpus is parts (records) and nations (hubs)."""

from pyspark.sql import functions as F

from vigilspark.operators import index
from vigilspark.operators import search as s
from vigilspark.plans.registry import ORACLES, query

_CORPUS = "(SELECT n_nationkey AS id, n_name AS name, true AS hub, NULL AS year FROM {nation} UNION ALL SELECT 1000 + doc, title, false, year FROM {catalogue})"
#: Every catalogue row whose id is divisible by 100, and every nation, against all rows.
_QUERIES = """(SELECT doc AS query_id, concat(' ', board, ' ', split_part(name, ' ', 2), ' ') AS q FROM {catalogue} WHERE doc % 100 = 0 UNION ALL
SELECT -1 - n_nationkey, lower(n_name) FROM {nation})"""


def _corpus(v):
    return v.nation.select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"), F.lit(True).alias("hub"), F.lit(None).cast("int").alias("year")).union(
        v.catalogue.select(1000 + F.col("doc"), "title", F.lit(False), "year"))


def _queries(v):
    words = F.concat(F.lit(" "), "board", F.lit(" "), F.split("name", " ")[1], F.lit(" "))
    return v.catalogue.where("doc % 100 = 0").select(F.col("doc").alias("query_id"),
        words.alias("q")).union(v.nation.select((-1 - F.col("n_nationkey")).cast("long"), F.lower("n_name")))


@query("q1_build_search_records", """SELECT 'country' AS kind, n_name AS title, n_regionkey AS region, NULL AS year FROM {nation} UNION ALL
SELECT 'guide', title, NULL, year FROM {catalogue} UNION ALL SELECT 'person', c_name, NULL, NULL FROM {customer}""")
def _(v):
    return s.build_search_records({"country": v.nation.select(F.col("n_name").alias("title"), F.col("n_regionkey").alias("region")),
        "guide": v.catalogue.select("title", "year"), "person": v.customer.select(F.col("c_name").alias("title"))})


@query("q2_build_hubs", """SELECT n_name AS entity, coalesce((SELECT string_agg(p_brand || p_partkey, ',' ORDER BY p_size, p_brand || p_partkey)
FROM {part} WHERE p_partkey % 30 = n_nationkey), '') AS links, lower(n_name) || ' alias' || n_regionkey AS q FROM {nation}""")
def _(v):
    entities = v.nation.select(F.col("n_name").alias("entity"), F.concat(F.lit("alias"), F.col("n_regionkey").cast("string")).alias("alias"))
    links = v.part.select(F.concat(F.lit("NATION_"), (F.col("p_partkey") % 30).cast("string")).alias("entity"), F.col("p_size").alias("rank"),
        F.concat("p_brand", F.col("p_partkey").cast("string")).alias("label"))
    return s.build_hubs(entities, links).withColumn("links", F.array_join("links", ","))


@query("q3_expand_entry_terms", """SELECT p_partkey AS term, CASE WHEN p_size % 3 = 0 THEN NULL ELSE e END AS entity
FROM {part}, (VALUES ('a'), ('b')) t(e) WHERE p_size % 3 > 0 OR e = 'a'""")
def _(v):
    entities = F.when(F.col("p_size") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("a"), F.lit("b")))
    return s.expand_entry_terms(v.part.select(F.col("p_partkey").alias("term"), entities.alias("entities")))


_WORDS = "len(list_filter(string_split_regex(trim(lower(q)), '\\s+'), lambda w: NOT contains(lower(name), w))) = 0"


@query("q4_score_search", f"""SELECT query_id, place, id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id
ORDER BY score DESC, length(name), year DESC NULLS LAST, id) AS place FROM (
SELECT query_id, id, name, year, CASE WHEN starts_with(lower(name), trim(lower(q))) THEN 3 ELSE 1 END + CASE WHEN hub
AND lower(name) = trim(lower(q)) THEN 5 ELSE 0 END AS score FROM {_CORPUS} c JOIN {_QUERIES} q ON {_WORDS})) WHERE place <= 10""")
def _(v):
    return s.score_search(_queries(v), _corpus(v))


@query("q5_match_query_entities", """WITH t AS (SELECT o_orderkey AS query_id, unnest(['on', lower(CASE
WHEN o_orderkey % 3 = 0 THEN n_name || 'x' ELSE n_name END)]) AS t FROM {orders} JOIN {customer} ON o_custkey = c_custkey
JOIN {nation} ON c_nationkey = n_nationkey),
h AS (SELECT query_id, n_name AS name, CASE WHEN t = lower(n_name) THEN length(n_name) + 10
WHEN starts_with(t, lower(n_name)) THEN length(n_name) + 5 ELSE length(n_name) END AS score FROM t JOIN {nation} ON contains(t, lower(n_name)))
SELECT query_id, name, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, name) AS k FROM h) WHERE k = 1""")
def _(v):
    rows = v.orders.join(v.customer, F.col("o_custkey") == F.col("c_custkey")).join(v.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    q = F.concat(F.lit("on "), "n_name", F.when(F.col("o_orderkey") % 3 == 0, "x").otherwise(""))
    return s.match_query_entities(rows.select(F.col("o_orderkey").alias("query_id"), q.alias("q")), v.nation.select(F.col("n_name").alias("name")))


_INTENTS = [(0, "tion", "trend"), (1, "que ", "cover"), (2, "the ", "index"), (3, "der ", "cover"), (4, "re", "map"), (5, "la", "trend")]


@query("q5_parse_queries", """SELECT o_orderkey AS query_id, CASE substring(o_orderpriority, 1, 1) WHEN '1' THEN 'urgent' WHEN '2' THEN 'high'
WHEN '5' THEN 'low' END AS name, CASE WHEN o_orderkey % 4 > 0 THEN n_name END AS country, CASE WHEN o_orderkey % 3 > 0 THEN
CAST(year(o_orderdate) AS INT) END AS year
FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey""")
def _(v):
    rows = v.orders.join(v.customer, F.col("o_custkey") == F.col("c_custkey")).join(v.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    k = F.col("o_orderkey")
    q = F.concat(F.lower(F.regexp_replace("o_orderpriority", r"^\d-", "")), F.lit("? "), F.when(k % 4 > 0, F.lower("n_name")).otherwise(""),
        F.when(k % 3 > 0, F.date_format("o_orderdate", " yyyy-MM")).otherwise(" 123"))
    names = v.spark.createDataFrame([("urgent",), ("high",), ("low",)], "name string")
    return s.parse_queries(rows.select(k.alias("query_id"), q.alias("q")), names, v.nation.select(F.col("n_name").alias("name")))


@query("q6_route_intents", f"""WITH i(place, word, url) AS (VALUES {', '.join(map(str, _INTENTS))}),
h AS (SELECT doc_id, url, min(place) AS place FROM {{documents}} JOIN i ON contains(lower(text), word) GROUP BY 1, 2)
SELECT doc_id AS query_id, array_to_string(urls, ',') AS urls FROM {{documents}} LEFT JOIN (SELECT doc_id, list(url ORDER BY place)[1:3] AS urls
FROM h GROUP BY 1) USING (doc_id)""")
def _(v):
    queries = v.documents.select(F.col("doc_id").alias("query_id"), F.col("text").alias("q"))
    return s.route_intents(queries, v.spark.createDataFrame(_INTENTS, "place int, word string, url string")).withColumn("urls", F.array_join("urls", ","))


@query("q7_autocomplete", f"""SELECT prefix, name, tier, place FROM (SELECT *, row_number() OVER (PARTITION BY prefix
ORDER BY tier, length(name), name) AS place FROM (
SELECT prefix, name, min(CASE WHEN hub AND starts_with(lower(name), lower(prefix)) THEN 0 WHEN hub THEN 1 ELSE 2 END) AS tier FROM {_CORPUS}
JOIN (SELECT DISTINCT substring(board, 1, 7) AS prefix FROM {{catalogue}} WHERE doc % 100 = 0 UNION SELECT substring(n_name, 1, 7)
FROM {{nation}}) p ON contains(lower(name), lower(prefix)) GROUP BY 1, 2)) WHERE place <= 8""")
def _(v):
    prefixes = v.catalogue.where("doc % 100 = 0").select(F.substring("board", 1, 7).alias("prefix")).union(v.nation.select(F.substring("n_name", 1, 7)))
    return s.autocomplete(prefixes.distinct(), _corpus(v))


def _index(v):
    """The corpus as a stored index, in two deliveries."""
    path = v.folder("index")
    corpus = _corpus(v)
    index.create_index(corpus.where("id % 3 > 0"), path, 16)
    index.add_delivery(corpus.where("id % 3 = 0"), path, 1)
    return path


@query("q4_index_search", ORACLES["q4_score_search"])
def _(v):
    return index.search_index(_queries(v), _index(v), v.folder("search"))


@query("q7_index_complete", ORACLES["q7_autocomplete"])
def _(v):
    prefixes = v.catalogue.where("doc % 100 = 0").select(F.substring("board", 1, 7).alias("prefix")).union(v.nation.select(F.substring("n_name", 1, 7)))
    return index.complete_index(prefixes.distinct(), _index(v), v.folder("search"))


@query("q8_suggest_similar", """SELECT query_id, name, place FROM (SELECT query_id, name, row_number() OVER (PARTITION BY query_id
ORDER BY name) AS place FROM (SELECT DISTINCT p_name AS name FROM {part}) JOIN (SELECT doc AS query_id, upper(split_part(name, ' ', 2)) || CASE
WHEN doc % 200 = 0 THEN ' ' || board ELSE '' END AS q FROM {catalogue}
WHERE doc % 100 = 0) q ON contains(lower(name), substring(lower(q), 1, 2)) OR contains(lower(q), substring(lower(name), 1, 2))) WHERE place <= 6""")
def _(v):
    q = F.concat(F.upper(F.split("name", " ")[1]), F.when(F.col("doc") % 200 == 0, F.concat(F.lit(" "), "board")).otherwise(""))
    return s.suggest_similar(v.catalogue.where("doc % 100 = 0").select(F.col("doc").alias("query_id"), q.alias("q")), v.part.select(F.col("p_name").alias("name")).distinct())


@query("q9_facet_results", """WITH h AS (SELECT doc % 7 AS query_id, CASE
WHEN doc % 11 = 0 THEN 'hub' ELSE kind END AS kind, doc AS id, doc * 31 % 17 AS score FROM {catalogue}),
m AS (SELECT * FROM h UNION ALL SELECT query_id, 'hub', id, 9 FROM (SELECT DISTINCT doc % 7 AS query_id, 11 * (1 + doc % 7) AS id FROM {catalogue}) r
WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.kind = 'hub' AND h.query_id = r.query_id AND h.id = r.id))
SELECT query_id, kind, id, score, n, place, CASE kind WHEN 'hub' THEN 0 WHEN 'guide' THEN 1 ELSE 2 END AS kind_rank FROM (SELECT *,
count(*) OVER (PARTITION BY query_id, kind) AS n,
row_number() OVER (PARTITION BY query_id, kind ORDER BY kind = 'hub' AND query_id <> id % 7 DESC, score DESC, id) AS place FROM m) WHERE place <= CASE
WHEN kind = 'hub' THEN 4 ELSE 5 END""")
def _(v):
    d = F.col("doc")
    known = v.catalogue.select((d % 7).alias("query_id"), (11 * (1 + d % 7)).alias("id"), F.lit(9).cast("long").alias("score")).distinct()
    return s.facet_results(v.catalogue.select((d % 7).alias("query_id"), F.when(d % 11 == 0, "hub").otherwise(F.col("kind")).alias("kind"),
        d.alias("id"), (d * 31 % 17).alias("score")), ["hub", "guide"], recognised=known)
