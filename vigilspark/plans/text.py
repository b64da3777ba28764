"""Queries for vigilspark.functions.text: texts are composed from columns, so the columns are the answer."""

from pyspark.sql import functions as F

from vigilspark.functions import text as t
from vigilspark.plans.registry import query


def _s(col):
    return F.col(col).cast("string")


@query("x1_html_to_text", "SELECT p_partkey, p_name || ' & ' || p_type || ' < ' || p_size AS text FROM {part}")
def _(v):
    html = F.concat(F.lit("<html><style>b{}</style><script>x='</b>'</script><b>"), "p_name", F.lit("</b>\n &amp; <i>"), "p_type",
        F.lit("</i>&nbsp;&lt;<br/> "), _s("p_size"), F.lit("</html>"))
    return v.part.select("p_partkey", t.html_to_text(html).alias("text"))


@query("x1_pages_to_text", """SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script.*?</script>', ' ', 'g'), '(?is)<style.*?</style>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&middot;', '·'), '&copy;', '©'), '&quot;', '"'), '&amp;', '&'), '[ \\t\\n\\r\\f]+', ' ', 'g')) AS text
FROM {pages}""")
def _(v):
    return v.pages.select("page_id", t.html_to_text(F.col("html")).alias("text"))


@query("x2_first_sentences", """SELECT p_partkey, CASE WHEN length(s) > 40 THEN rtrim(substring(s, 1, 39)) || '…' ELSE s END AS text
FROM (SELECT p_partkey, 'A ' || p_name || ' v.2 is. B ' || p_type || '!' AS s FROM {part})""")
def _(v):
    text = F.concat(F.lit(" A "), "p_name", F.lit(" v.2 is. B "), "p_type", F.lit("! And more. Yes."))
    return v.part.select("p_partkey", t.first_sentences(text, 2, 40).alias("text"))


@query("x3_extract_as_of", "SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE {date:o_orderdate} END AS day FROM {orders}")
def _(v):
    month = F.when(F.col("o_orderkey") % 7 == 0, "Brumaire").otherwise(F.date_format("o_orderdate", "MMMM"))
    return v.orders.select("o_orderkey", t.extract_as_of(F.concat(F.lit("x. As of "), F.date_format("o_orderdate", "d"), F.lit(" "), month,
        F.date_format("o_orderdate", " yyyy"), F.lit(", y"))).alias("day"))


@query("x4_extract_counts", """SELECT o_orderkey, o_custkey * 7 AS confirmed, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_custkey END AS deaths, CASE
WHEN o_orderkey % 2 = 0 THEN o_custkey % 100 / 10.0 END AS cfr, o_orderkey AS suspected, o_custkey AS cases, o_orderkey AS states FROM {orders}""")
def _(v):
    k = F.col("o_orderkey")
    n = lambda c: F.format_number(c, 0)
    text = F.concat(F.lit("A total of "), n(F.col("o_custkey") * 7), F.lit(" confirmed cases"),
        F.when(k % 3 == 1, F.concat(F.lit(", including "), n(F.col("o_custkey")), F.lit(" deaths"))).when(k % 3 == 2,
            F.concat(F.lit(" with "), n(F.col("o_custkey")), F.lit(" related deaths"))).otherwise(""),
                    F.when(k % 2 == 0, F.concat(F.lit(" (CFR: "), (F.col("o_custkey") % 100 / 10).cast("string"), F.lit("%)"))).otherwise(""),
                        F.lit(" and "), n(k), F.lit(" suspected cases."))
    notice = F.concat(F.lit("Cases: "), n(F.col("o_custkey")), F.lit(" States: "), n(k))
    c, m = t.extract_counts(text), t.extract_notice_counts(notice)
    return v.orders.select("o_orderkey", c.confirmed.alias("confirmed"), c.deaths.alias("deaths"), c.cfr.alias("cfr"), c.suspected.alias("suspected"),
        m.cases.alias("cases"), m.states.alias("states"))


@query("x5_extract_risk", """SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'moderate' ELSE 'very high' END AS global, CASE
WHEN c_custkey % 2 = 0 THEN 'high' END AS regional FROM {customer}""")
def _(v):
    k = F.col("c_custkey")
    level = F.when(k % 3 == 0, "low").when(k % 3 == 1, "moderate").otherwise("very high")
    text = F.concat(F.lit("Nothing is high here. The risk is assessed as "), level, F.lit(" at the global level"),
        F.when(k % 2 == 0, ", and high at the regional level").otherwise(""), F.lit(". The risk globally stays low."))
    risk = t.extract_risk(text)
    return v.customer.select("c_custkey", F.try_element_at(risk, F.lit("global")).alias("global"), F.try_element_at(risk, F.lit("regional")).alias("regional"))


@query("x6_extract_travel_advice",
    """WITH t AS (SELECT p_partkey AS k, lower(p_name || ': ' || ['WHO advises ', 'The office recommends ', 'It warns ', 'Nobody advises '][1 + p_partkey % 4] || ['against ', '', 'against any ', 'the '][1 + p_size % 4] || ['travel or trade', 'application of travel', 'trade', 'application of any travel'][1 + (p_partkey + p_size) % 4] || ' restrictions') AS s
FROM {part})
SELECT k AS p_partkey, CASE WHEN regexp_matches(s, '(advises|recommends) against (any |the )?(application of )?(any )?travel') THEN 'against'
WHEN regexp_matches(s, '(advises|recommends) (any |the )?travel') THEN 'advises' END AS advice FROM t""")
def _(v):
    pick = lambda place, *words: F.array(*map(F.lit, words))[(place % 4).cast("int")]
    text = F.concat("p_name", F.lit(": "), pick(F.col("p_partkey"), "WHO advises ", "The office recommends ", "It warns ", "Nobody advises "),
        pick(F.col("p_size"), "against ", "", "against any ", "the "),
                    pick(F.col("p_partkey") + F.col("p_size"), "travel or trade", "application of travel", "trade", "application of any travel"), F.lit(" restrictions"))
    return v.part.select("p_partkey", t.extract_travel_advice(text).alias("advice"))


_GLOSSARY = sorted(["of the", "the", "of", "thatin", "la", "the orantion", "rewh", "and the", "re", "hehely"], key=lambda x: (-len(x), x))
_EDGE = "[^\\p{L}\\p{N}_]"


@query("x7_find_terms", f"""WITH RECURSIVE g AS (SELECT {_GLOSSARY} AS terms), f(doc_id, i, text, found) AS (SELECT doc_id, 0, text, CAST([] AS VARCHAR[])
FROM {{documents}} UNION ALL
SELECT doc_id, i + 1, regexp_replace(text, '(?i)(^|{_EDGE})' || terms[i + 1] || '($|{_EDGE})', '\\1' || chr(1) || '\\2'),
CASE WHEN regexp_matches(text, '(?i)(^|{_EDGE})' || terms[i + 1] || '($|{_EDGE})') THEN list_append(found, regexp_extract(text, '(?i)(^|{_EDGE})(' || terms[i + 1] || ')($|{_EDGE})', 2)) ELSE found END
FROM f, g WHERE i < {len(_GLOSSARY)})
SELECT doc_id, array_to_string(found[1:4], '|') AS terms FROM f WHERE i = {len(_GLOSSARY)}""")
def _(v):
    terms = v.spark.createDataFrame([(x,) for x in _GLOSSARY], "term string")
    return t.find_terms(v.documents.select("doc_id", "text"), "text", terms, 4).select("doc_id", F.array_join("terms", "|").alias("terms"))


@query("x8_extract_figures", """SELECT p_partkey, 'http://x.org/' || p_partkey || '.png=' || p_name || ';https://x.org/b.png=' || p_type || ';http://x.org/c.png=' ||
CASE WHEN p_size % 2 = 0 THEN 'Figure 2. Cases of ' || p_brand ELSE 'map' END AS figures FROM {part}""")
def _(v):
    url = F.concat(F.lit('<img src="http://x.org/'), _s("p_partkey"), F.lit('.png" alt="'))
    html = F.concat(url, F.lit('no"> <figcaption><b>'), "p_name", F.lit('</b></figcaption><img src="/local.png" alt="l"><img alt="'), "p_type",
        F.lit('" src="https://x.org/b.png"><p>'), F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("See Figure 2. Cases of <b>"), "p_brand",
            F.lit("</b></p>"))).otherwise("Figures differ</p>"), F.lit('<img src="http://x.org/c.png" alt="map">'), url, F.lit('again">'))
    return v.part.select("p_partkey", F.array_join(F.transform(t.extract_figures(html), lambda f: F.concat(f.url, F.lit("="), f.caption)), ";").alias("figures"))


@query("x9_extract_tables", """SELECT p_partkey, 'Sizes of ' || p_brand AS caption, 'name,size,size;' || p_name || ',' || p_size || ',x;' || p_name || ',y,z' AS cells
FROM {part}""")
def _(v):
    html = F.concat(F.lit("<table><tr><td>one row</td></tr></table><table><tr><td><table class=x><caption>Sizes of <i>"), "p_brand",
        F.lit("</i></caption><tr><th>name</th><th colspan='2'>size</th></tr><tr><td rowspan=\"2\"><b>"), "p_name", F.lit("</b></td>\n<td> "), _s("p_size"),
                    F.lit("</td><td>x<tr><td>y<td>z</table></td></tr></table>"))
    found = t.extract_tables(html)[0]
    return v.part.select("p_partkey", found.caption.alias("caption"), F.array_join(F.transform(found["rows"], lambda r: F.array_join(r, ",")), ";").alias("cells"))


@query("x10_extract_key_points", """SELECT p_partkey, p_name || '|' || p_brand AS points, CASE WHEN p_size % 5 > 0 THEN
CAST(p_size % 5 AS INT) END AS level FROM {part}""")
def _(v):
    title = F.concat(F.when(F.col("p_size") % 5 > 0, F.concat(F.lit("Level "), (F.col("p_size") % 5).cast("string"), F.lit(" - "))).otherwise("Sea level - "), "p_name")
    html = F.concat(F.lit("<ul><li>menu</li></ul><h2 id=k> Key Points </h2>\n<ul class=y><li>"), "p_name", F.lit("</li><li><a href=x>"), "p_brand",
        F.lit("</a></li></ul><ul><li>z</li></ul>"))
    return v.part.select("p_partkey", F.array_join(t.extract_key_points(html, "key points"), "|").alias("points"), t.extract_level(title).alias("level"))


@query("x11_extract_article_meta",
    """SELECT o_orderkey, o_orderpriority AS department, {date:o_orderdate} AS date, 'It is ' || o_orderstatus || '. It stays.' AS summary, 'a.pdf|' || o_orderkey || '.hwp' AS files
FROM {orders}""")
def _(v):
    html = F.concat(F.lit("<dt>Department</dt> <dd> "), "o_orderpriority", F.lit("</dd><span>"), F.date_format("o_orderdate", "yyyy.MM.dd"),
        F.lit('</span><div class="body"><p>It is '), "o_orderstatus",
            F.lit('. It stays.</p> <p>More.</p></div><a class="file" href=1>a.pdf</a><a class="file">'), _s("o_orderkey"), F.lit('.hwp</a><a class="file">a.pdf</a>'))
    m = t.extract_article_meta(html)
    return v.orders.select("o_orderkey", m.department.alias("department"), m.date.alias("date"), m.summary.alias("summary"), F.array_join(m.files, "|").alias("files"))


@query("x12_compose_summary", """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL
WHEN o_orderkey % 3 = 1 THEN (o_custkey % 900) || ' confirmed cases in NATION as of 2024-01-02.' ELSE (o_custkey % 900) || ' confirmed cases and ' || (o_orderkey % 100) || ' deaths.' END AS summary
FROM {orders}""")
def _(v):
    k = F.col("o_orderkey")
    one = k % 3 == 1
    return v.orders.select("o_orderkey", t.compose_summary(F.when(k % 3 > 0, F.col("o_custkey") % 900), F.when(k % 3 == 2, k % 100),
        F.when(one, "2024-01-02").otherwise(""), F.when(one, "NATION").otherwise("")).alias("summary"))


@query("x13_parse_duration_range", """SELECT p_partkey, CASE WHEN p_partkey % 3 = 2 THEN p_size / 24.0 ELSE CAST(p_size AS DOUBLE) END AS low, CASE
WHEN p_partkey % 3 = 2 THEN p_size / 24.0 ELSE p_size + 10.0 END AS high, CASE WHEN p_partkey % 3 = 0 THEN p_size + 2.0 END AS usual_low, CASE
WHEN p_partkey % 3 = 0 THEN p_size + 4.0 END AS usual_high FROM {part}""")
def _(v):
    n = lambda d: (F.col("p_size") + d).cast("string")
    k = F.col("p_partkey") % 3
    text = F.when(k == 0, F.concat(n(0), F.lit("~"), n(10), F.lit(" days (usually "), n(2), F.lit("~"), n(4), F.lit(")"))).when(k == 1,
        F.concat(n(0), F.lit("-"), n(10), F.lit(" days"))).otherwise(F.concat(n(0), F.lit(" hours")))
    return v.part.select("p_partkey", F.explode(F.array(t.parse_duration_range(text))).alias("r")).select("p_partkey", "r.*")


@query("x14_explode_counted_list", "SELECT o_orderkey, unnest(['A b', o_orderpriority]) AS name, unnest([3, CAST(o_custkey AS INT)]) AS n FROM {orders}")
def _(v):
    text = F.concat(F.lit("A b(3),  "), "o_orderpriority", F.lit(" ("), _s("o_custkey"), F.lit(")"))
    return v.orders.select("o_orderkey", F.explode(t.counted_list(text)).alias("c")).select("o_orderkey", "c.*")


@query("x15_split_outside_parens", "SELECT p_partkey, p_name || ' (x,y)|' || p_type AS parts FROM {part}")
def _(v):
    return v.part.select("p_partkey", F.array_join(t.split_outside_parens(F.concat("p_name", F.lit(" (x,y), "), "p_type")), "|").alias("parts"))


@query("x18_expand_keys", """WITH n AS (SELECT p_partkey AS k, lower(p_name) AS base, ['', ' syndrome', ' fever', ' virus infection', ' INFECTION'][1 + p_partkey % 5] AS tail,
CASE WHEN p_size % 3 = 0 THEN '' ELSE ' (' || upper(substring(p_name, 1, 1 + p_size % 4)) || ')' END AS inner_, lower(p_type) AS alias FROM {part})
SELECT k AS p_partkey, array_to_string(list_sort(list_distinct(list_filter([lower(base || inner_ || tail), lower(base || tail), base, CASE
WHEN contains(inner_, ' )') OR contains(trim(inner_), ' ') THEN '' ELSE lower(trim(inner_, ' ()')) END, alias, 'x', base], lambda x: length(x) >= 2))), '|') AS keys
FROM n""")
def _(v):
    inner = F.when(F.col("p_size") % 3 == 0, "").otherwise(F.concat(F.lit(" ("), F.upper(F.expr("substring(p_name, 1, 1 + p_size % 4)")), F.lit(")")))
    tail = F.array(*map(F.lit, ("", " syndrome", " fever", " virus infection", " INFECTION")))[(F.col("p_partkey") % 5).cast("int")]
    keys = t.expand_keys(F.concat("p_name", inner, tail), F.array("p_type", F.lit("x"), F.col("p_name")))
    return v.part.select("p_partkey", F.array_join(F.array_sort(keys), "|").alias("keys"))


@query("x19_glossary_gaps", """WITH w AS (SELECT unnest(['zoonosis', 'the', 'que', 'vector']) AS word), d AS (SELECT unnest(['the', 'vector']) AS word), u AS (SELECT word,
count(DISTINCT doc_id) AS pages FROM {documents} JOIN (SELECT * FROM w UNION SELECT * FROM d) ON contains(lower(text), word) GROUP BY 1)
SELECT word, pages, 'undefined' AS state FROM u WHERE word IN (SELECT word FROM w) AND word NOT IN (SELECT word FROM d) UNION ALL
SELECT word, 0, 'unused' FROM d WHERE word NOT IN (SELECT word FROM u)""")
def _(v):
    word = lambda *w: v.spark.createDataFrame([(x,) for x in w], "word string")
    return t.glossary_gaps(v.documents.select(F.col("doc_id").alias("page_id"), "text"), word("zoonosis", "the", "que", "vector"), word("the", "Vector"))
