"""Queries for vigilspark.operators.match."""

from pyspark.sql import functions as F

from vigilspark.operators import match as m
from vigilspark.plans.registry import query

_DOCS = "(SELECT doc, lower(title) AS norm FROM {catalogue})"
_NAMES = "(SELECT p_name AS entity, lower(p_name) AS key FROM {part} GROUP BY 1, 2)"


def _keys(v):
    return v.part.select(F.col("p_name").alias("entity"), F.lower("p_name").alias("key")).distinct()


def _docs(v):
    return v.catalogue.select("doc", F.lower("title").alias("norm"))


@query("j6_match_entities_in_text", f"SELECT doc, entity FROM {_DOCS} JOIN {_NAMES} ON contains(norm, key)")
def _(v):
    return m.match_entities_in_text(_docs(v), _keys(v)).select("doc", "entity")


# Names are those of parts and their single words: a word that stands only inside a part's name is buried.
@query("j7_suppress_buried", """WITH names AS (SELECT p_name AS n FROM {part} UNION SELECT split_part(p_name, ' ', 1) FROM {part} UNION
SELECT split_part(p_name, ' ', 2) FROM {part}),
d AS (SELECT p_partkey AS doc, CASE p_partkey % 4 WHEN 0 THEN p_name || ' or a ' || split_part(p_name, ' ', 2)
WHEN 1 THEN split_part(p_name, ' ', 1) || 'er ' || p_name
WHEN 2 THEN p_name ELSE split_part(p_name, ' ', 2) || ' ' || p_name END || ' ' || lower(p_type) AS norm FROM {part}),
x AS (SELECT doc, m.n AS entity, norm, list(l.n ORDER BY length(l.n) DESC, l.n) FILTER (l.n IS NOT NULL) AS longs FROM d
JOIN names m ON contains(norm, m.n) LEFT JOIN names l ON contains(l.n, m.n) AND length(l.n) > length(m.n) AND contains(norm, l.n) GROUP BY 1, 2, 3)
SELECT doc, entity FROM x WHERE contains(list_reduce(list_concat([norm], coalesce(longs,
CAST([] AS VARCHAR[]))), lambda a, b: replace(a, b, chr(1))), entity)""")
def _(v):
    words = F.split("p_name", " ")
    k = F.col("p_partkey") % 4
    title = F.when(k == 0, F.concat("p_name", F.lit(" or a "), words[1])).when(k == 1, F.concat(words[0], F.lit("er "), "p_name")).when(k == 2,
        F.col("p_name")).otherwise(F.concat(words[1], F.lit(" "), "p_name"))
    docs = v.part.select(F.col("p_partkey").alias("doc"), F.concat(title, F.lit(" "), F.lower("p_type")).alias("norm"))
    keys = v.part.select(F.explode(F.concat(F.array("p_name"), words)).alias("key")).distinct().select(F.col("key").alias("entity"), "key")
    return m.suppress_buried(m.match_entities_in_text(docs, keys), keys).select("doc", "entity")


@query("j8_suppress_mislisted",
    f"""WITH t AS (SELECT *, regexp_extract(title, 'grade ([0-9]+)', 1) AS stated, list_transform(string_split(regexp_extract(title, '[(]([^)]*)[)]', 1), ','), lambda x: trim(x)) AS listed
FROM {{titled}})
SELECT p_partkey, entity FROM t WHERE stated = CAST(grade AS VARCHAR) OR NOT (stated <> '' AND NOT contains(title, entity) OR len(listed) >= 2
AND NOT list_contains(listed, entity))""")
def _(v):
    return m.suppress_mislisted(v.titled.select("p_partkey", "entity", "grade", "title")).select("p_partkey", "entity")


@query("j9_longest_match", """SELECT doc, name FROM (SELECT c.doc, t.n AS name, row_number() OVER (PARTITION BY c.doc
ORDER BY length(t.n) DESC, t.n) AS k FROM {catalogue} c JOIN (SELECT DISTINCT p_name AS n FROM {part} UNION
SELECT DISTINCT string_split(p_name, ' ')[1] FROM {part}) t ON contains(c.title, t.n)) WHERE k = 1""")
def _(v):
    names = v.part.select(F.col("p_name").alias("name")).union(v.part.select(F.split("p_name", " ")[0])).distinct()
    return m.longest_match(v.catalogue.select("doc", "title"), names)


@query("j14_prefix_fallback_join", """SELECT s_suppkey AS id, s_suppkey % 2 = 0 AS exact, CASE
WHEN s_suppkey % 2 = 0 THEN n_nationkey ELSE (SELECT min(n_nationkey) FROM {nation} b
WHERE substring(b.n_name, 1, 8) = substring(n.n_name, 1, 8)) END AS value FROM {supplier} JOIN {nation} n ON s_nationkey = n_nationkey""")
def _(v):
    n = v.nation
    left = v.supplier.join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("id"),
        F.when(F.col("s_suppkey") % 2 == 0, F.col("n_name")).otherwise(F.concat(F.substring("n_name", 1, 8), F.lit("*"))).alias("key"))
    right = n.select(F.col("n_name").alias("key"), F.col("n_nationkey").alias("value"), F.col("n_nationkey").alias("place"))
    return m.prefix_fallback_join(left, right, 8).select("id", (F.col("how") == "exact").alias("exact"), "value")


@query("j15_superseded_by", """SELECT doc, CASE WHEN contains(title, 'Brand#1') AND year < 2015 THEN 'A'
WHEN contains(title, 'Brand#12') OR contains(title, 'Brand#3') AND year < 2020 THEN 'B' END AS by FROM {catalogue}""")
def _(v):
    rules = v.spark.createDataFrame([(0, "Brand#1", "A", 2015, "old"), (1, "Brand#12", "B", None, "merged"), (2, "Brand#3", "B", 2020, "new")],
        "place int, key string, by string, since int, why string")
    return m.superseded_by(v.catalogue.select("doc", "title", "year"), rules).select("doc", "by")


@query("j16_multi_key_match", "SELECT n_nationkey AS left_id, CASE WHEN n_nationkey % 5 <> 0 THEN n_nationkey END AS right_id FROM {nation}")
def _(v):
    name = F.lower("n_name")
    left = v.nation.select(F.col("n_nationkey").alias("id"), F.array(F.lit(""), F.when(F.col("n_nationkey") % 5 == 0,
        "unknown").otherwise(F.regexp_replace(name, "_", " ")), F.lit("x")).alias("keys"))
    right = v.nation.select(F.col("n_nationkey").alias("id"), F.array(name, F.regexp_replace(name, "_", " "), F.lit("")).alias("keys"))
    pairs, rest = m.multi_key_match(left, right)
    return pairs.unionByName(rest.withColumn("right_id", F.lit(None).cast("int")))


@query("j17_as_of_version", """SELECT l_orderkey, l_linenumber, version, CASE version WHEN 1 THEN '1995-01-01' WHEN 2 THEN '1996-07-01'
WHEN 3 THEN '1998-02-15' WHEN 4 THEN '2000-12-31' ELSE '' END > made AS stale FROM (SELECT l_orderkey, l_linenumber, (SELECT max(version)
FROM (VALUES (1, '1995-01-01'), (2, '1996-07-01'), (3, '1998-02-15'), (4, '2000-12-31')) t(version, effective)
WHERE effective <= {date:l_shipdate}) AS version, CASE WHEN l_linenumber % 2 = 0 THEN '1996-12-31' ELSE '1994-12-31' END AS made FROM {lineitem})""")
def _(v):
    versions = v.spark.createDataFrame([(1, "1995-01-01"), (2, "1996-07-01"), (3, "1998-02-15"), (4, "2000-12-31")],
        "version int, effective string").withColumn("flag", F.explode(F.array(*map(F.lit, "ANR"))))
    made = F.when(F.col("l_linenumber") % 2 == 0, "1996-12-31").otherwise("1994-12-31")
    days = v.lineitem.select(F.col("l_returnflag").alias("flag"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("day"), made.alias("made"), "l_orderkey", "l_linenumber")
    return m.as_of_version(versions, days, "flag", "made").drop("flag", "day", "made")


@query("j18_current_phase", """SELECT o_custkey,
CAST(max_by(o_orderpriority, o_orderkey) FILTER (o_orderpriority IN ('1-URGENT', '2-HIGH')) AS VARCHAR) AS status FROM {orders} GROUP BY 1""")
def _(v):
    phases = v.orders.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", F.col("o_orderpriority").alias("status")))).alias("phases"))
    return phases.select("o_custkey", m.current_phase(F.col("phases"), ["1-URGENT", "2-HIGH"]).alias("status"))


@query("j19_evidence_gate", """SELECT c_custkey AS entity, c_custkey % 3 = 0 AS ok, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment END AS value, CASE
WHEN c_custkey % 3 = 0 THEN 'cited' WHEN c_custkey % 3 = 1 THEN 'confirmed absent' ELSE 'not yet checked' END AS status FROM {customer}""")
def _(v):
    third = F.col("c_custkey") % 3
    entities = v.customer.select(F.col("c_custkey").alias("entity"))
    ledger = v.customer.where(third == 0).select(F.col("c_custkey").alias("entity"), F.col("c_mktsegment").alias("value"), F.col("c_name").alias("doc_id"))
    gate = m.evidence_gate(entities, ledger, v.customer.where(third == 1).select(F.col("c_custkey").alias("entity")))
    return gate.select("entity", "evidence.ok", "evidence.value", "evidence.status")


@query("j20_merge_catalogues", """WITH c AS (SELECT name || '/' || board AS series, year, title, url, doc, CASE
WHEN doc % 3 = 0 THEN 'b' ELSE 'a' END AS source FROM {catalogue})
SELECT series, year, coalesce(arg_min(title, url) FILTER (source = 'a'), arg_min(title, url)) AS title,
coalesce(min(url) FILTER (source = 'a'), min(url)) AS url,
CASE WHEN count(DISTINCT source) = 2 THEN 'a+b' ELSE min(source) END AS sources, CASE WHEN
count(DISTINCT source) = 2 THEN min(url) FILTER (source = 'b') END AS url2 FROM c GROUP BY 1, 2""")
def _(v):
    rows = v.catalogue.select(F.concat("name", F.lit("/"), "board").alias("series"), "year", "title", "url", "doc")
    a = rows.where("doc % 3 <> 0").drop("doc").withColumn("source", F.lit("a"))
    return m.merge_catalogues(a, rows.where("doc % 3 = 0").drop("doc").withColumn("source", F.lit("b")))


@query("j22_attach_corrections", """SELECT doc, name AS entity, 'title' AS how FROM {catalogue} WHERE doc % 2 = 0 UNION ALL
SELECT doc, unnest([name, board]), 'manual' FROM {catalogue} WHERE doc % 11 = 0""")
def _(v):
    c = v.catalogue
    manual = c.where("doc % 11 = 0").select("doc", F.when(F.col("doc") % 2 == 0, F.concat("name", F.lit("; "), "board")).otherwise(F.concat("name",
        F.lit(","), "board")).alias("covers"))
    return m.attach_corrections(c.where("doc % 2 = 0").select("doc", F.col("name").alias("entity")), manual)


@query("j24_match_common_prefix", """WITH a AS (SELECT DISTINCT p_type AS name FROM {part}), b AS (SELECT DISTINCT p_type AS match FROM {part}
WHERE length(p_type) % 2 = 0),
s AS (SELECT name, match, len(list_filter(range(1, CAST(least(length(name), length(match)) + 1 AS BIGINT)), lambda i: substring(name, 1,
CAST(i AS INT)) = substring(match, 1, CAST(i AS INT)))) AS n FROM a JOIN b ON substring(name, 1, 2) = substring(match, 1, 2)),
t AS (SELECT name, min(match) AS match, count(*) AS c FROM s QUALIFY 1 = 1 GROUP BY name, n HAVING n = (SELECT max(n) FROM s z WHERE z.name = s.name))
SELECT a.name, CASE WHEN c = 1 THEN match END AS match FROM a LEFT JOIN t USING (name)""".replace(" QUALIFY 1 = 1", ""))
def _(v):
    types = v.part.select(F.col("p_type").alias("name")).distinct()
    return m.match_common_prefix(types, types.where(F.length("name") % 2 == 0))




_KEYWORDS = [(0, "thatin", "one"), (1, "tion", "two"), (2, "of the", "three"), (3, "re", "two"), (4, "que", "four"), (5, "unter", "five"),
    (6, "la", "six"), (7, "hehely", "one"), (8, "inoran", "seven")]

_FULL_NAMES = [(0, "The", "eight"), (1, "Is", "nine"), (2, "le", "two"), (3, "an", "ten")]


@query("j10_tag_keywords", f"""WITH k(place, word, label) AS (VALUES {', '.join(map(str, _KEYWORDS))}),
h AS (SELECT doc_id, label, min(place) AS place FROM {{documents}} JOIN k ON regexp_matches(lower(text), '(^|[^\\p{{L}}\\p{{N}}_])' || word)
GROUP BY 1, 2),
n(place, word, label) AS (VALUES {', '.join(map(str, _FULL_NAMES))}),
f AS (SELECT doc_id, min(place) AS place, label FROM {{documents}} JOIN n ON contains(string_split(text, chr(10))[1], word) GROUP BY 1, 3),
u AS (SELECT doc_id, label, min(place) AS place FROM (SELECT doc_id, label, place FROM h UNION ALL SELECT doc_id, label, place + 100 FROM f)
GROUP BY 1, 2)
SELECT doc_id AS id, coalesce(array_to_string(labels, ','), '') AS labels FROM {{documents}} LEFT JOIN (SELECT doc_id, list(label
ORDER BY place)[1:4] AS labels FROM u GROUP BY 1) USING (doc_id)""")
def _(v):
    words = v.spark.createDataFrame(_KEYWORDS, "place int, word string, label string")
    names = v.spark.createDataFrame(_FULL_NAMES, "place int, word string, label string")
    items = v.documents.select(F.col("doc_id").alias("id"), "text", F.split("text", "\n")[0].alias("title"))
    return m.tag_keywords(items, words, names=names).select("id", F.array_join("labels", ",").alias("labels"))


@query("j11_tag_broader_groups", """WITH t AS (SELECT doc_id, lower(text) AS text, list_filter(['tion', 'que', 'thatin'], lambda x: contains(text, x || ' ')) AS labels
FROM {documents}),
g(place, word, "group", candidates) AS (VALUES (0, 'ion', 'ions', ['tion', 'que']), (1, 'th', 'ths', ['thatin']), (2, 'der', 'ders',
CAST([] AS VARCHAR[])), (3, 'le', 'les', ['que', 'thatin'])),
h AS (SELECT doc_id, list("group" ORDER BY place)[1:2] AS maybe FROM t JOIN g ON contains(text, word) AND (CASE
WHEN len(candidates) = 0 THEN len(labels) = 0 ELSE NOT list_has_any(labels, candidates) END) GROUP BY 1)
SELECT doc_id AS id, coalesce(array_to_string(maybe, ','), '') AS maybe FROM {documents} LEFT JOIN h USING (doc_id)""")
def _(v):
    labels = F.filter(F.array(*map(F.lit, ("tion", "que", "thatin"))), lambda x: F.col("text").contains(F.concat(x, F.lit(" "))))
    groups = v.spark.createDataFrame([(0, "ion", "ions", ["tion", "que"]), (1, "th", "ths", ["thatin"]), (2, "der", "ders", []),
        (3, "le", "les", ["que", "thatin"])], "place int, word string, group string, candidates array<string>")
    return m.tag_broader_groups(v.documents.select(F.col("doc_id").alias("id"), "text", labels.alias("labels")), groups).select("id", F.array_join("maybe", ",").alias("maybe"))


_PLACES = ["small ring", "ring gear", "gear", "ring", "red bolt", "bolt", "hot", "small", "cold", "cold gear", "bolt cutter"]
_REGIONS = ["hot", "red r"]


def _tier(text, least, cap):
    """Names of at least so many characters in a text, each blanked out once, longest first; by id."""
    count = len([p for p in _PLACES if len(p) >= least])
    return f"""(WITH n AS (SELECT list(p ORDER BY length(p) DESC, p) AS names FROM (SELECT unnest({_PLACES}) AS p) WHERE length(p) >= {least}),
k AS (SELECT id, i, names[i] AS name, list_reduce(list_concat([lower({text})], names[1:i - 1]), lambda a, b: regexp_replace(a, '\\b' || b || '\\b', repeat(' ',
CAST(length(b) AS INT)))) AS masked FROM t, n, range(1, {count + 1}) r(i))
SELECT id, list(name ORDER BY i) FILTER (regexp_matches(masked, '\\b' || name || '\\b'))[1:{cap}] AS found FROM k GROUP BY 1)"""


@query("j12_tag_places_masked", f"""WITH t AS (SELECT a.p_partkey AS id, concat(CASE
WHEN a.p_size % 4 = 0 THEN 'Rings and Bolts of ' || a.p_brand ELSE a.p_name END, CASE WHEN a.p_size % 3 = 0 THEN ', ' ELSE ' ' END, CASE
WHEN a.p_size % 4 > 0 THEN upper(coalesce(b.p_name, '')) ELSE '' END) AS title,
concat(coalesce(b.p_name, ''), CASE WHEN a.p_size % 5 = 0 THEN 's of ' ELSE ' by ' END, a.p_name) AS summary FROM {{part}} a LEFT
JOIN {{part}} b ON b.p_partkey = a.p_partkey + 1)
SELECT t.id, array_to_string(list_sort(coalesce(a.found, b.found,
CAST([] AS VARCHAR[]))), ',') AS places, contains(lower(title), '{_REGIONS[0]}') OR contains(lower(title), '{_REGIONS[1]}') AS multi
FROM t JOIN {_tier('title', 4, 4)} a USING (id) JOIN {_tier("title || ' ' || summary", 5, 3)} b USING (id)""")
def _(v):
    after = v.part.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("next"))
    plain = F.col("p_size") % 4 > 0
    following = F.coalesce("next", F.lit(""))
    title = F.concat(F.when(plain, F.col("p_name")).otherwise(F.concat(F.lit("Rings and Bolts of "), "p_brand")),
        F.when(F.col("p_size") % 3 == 0, ", ").otherwise(" "), F.when(plain, F.upper(following)).otherwise(""))
    summary = F.concat(following, F.when(F.col("p_size") % 5 == 0, "s of ").otherwise(" by "), "p_name")
    items = v.part.join(after, "p_partkey", "left").select(F.col("p_partkey").alias("id"), title.alias("title"), summary.alias("summary"))
    names = v.spark.createDataFrame([(p, p) for p in _PLACES], "name string, code string")
    found = m.tag_places_masked(items, names, v.spark.createDataFrame([(r,) for r in _REGIONS], "name string"))
    return found.select("id", F.array_join(F.array_sort("places"), ",").alias("places"), "multi")


@query("j13_join_item_context", """WITH i AS (SELECT o_orderkey AS id, n_name AS country, o_orderpriority AS condition FROM {orders}
JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey)
SELECT id, i.country, CASE WHEN d.level IS NOT NULL THEN i.condition END AS condition, coalesce(d.level, 'none') AS level FROM i LEFT
JOIN {designation} d ON i.country = d.country AND i.condition = d.condition""")
def _(v):
    items = v.orders.join(v.customer, F.col("o_custkey") == F.col("c_custkey")).join(v.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("o_orderkey").alias("id"), F.array("n_name").alias("places"), F.array("o_orderpriority").alias("labels"))
    return m.join_item_context(items, v.designation)
