"""Queries for vigilspark.sources: files and pages are composed from columns and parsed back."""

from pyspark.sql import functions as F

from vigilspark.plans.registry import query
from vigilspark.sources import files, pages as p


def _folder(v) -> str:
    return v.folder("ledgers")


def _s(col):
    return F.col(col).cast("string")


@query("io1_read_ledger_csv", "SELECT c_custkey, c_name, round(c_acctbal, 2) AS c_acctbal FROM {customer}")
def _(v):
    path = _folder(v)
    v.customer.select("c_custkey", F.concat("c_name", F.lit("é")).alias("c_name"), "c_acctbal").write.option("header", True).option("encoding", "ISO-8859-1").csv(path)
    return files.read_ledger_csv(v.spark, path, "c_custkey long, c_name string, c_acctbal double", "ISO-8859-1").select("c_custkey",
        F.replace("c_name", F.lit("é"), F.lit("")).alias("c_name"), F.round("c_acctbal", 2).alias("c_acctbal"))


@query("io2_read_ledger_json", "SELECT s_suppkey, s_name FROM {supplier}")
def _(v):
    path = _folder(v)
    ledgers = v.supplier.groupBy(F.floor(F.col("s_suppkey") / 200).alias("part")).agg(F.collect_list(F.struct("s_suppkey", "s_name")).alias("records"))
    ledgers.write.partitionBy("part").json(path)  # one document a file
    return files.read_ledger_json(v.spark, path, "records array<struct<s_suppkey:long,s_name:string>>", "records")


@query("io12_write_ledger", "SELECT p_partkey, p_size, p_brand FROM {part}")
def _(v):
    path = _folder(v)
    files.write_ledger(v.part.select("p_partkey", "p_size", "p_brand"), path, "parquet", ["p_partkey"], ["p_brand"])
    return v.spark.read.parquet(path)


@query("io13_guarded_overwrite", "SELECT s_suppkey, 'kept' AS state FROM {supplier}")
def _(v):
    path = _folder(v)
    files.guarded_overwrite(v.supplier.select("s_suppkey", F.lit("kept").alias("state")), path, 1)
    try:
        files.guarded_overwrite(v.supplier.where("s_suppkey < 0").select("s_suppkey", F.lit("lost").alias("state")), path, 1)
    except files.TooFewRows:
        pass
    return v.spark.read.parquet(path)


@query("io3_parse_rss", """SELECT 's' || (o_orderkey % 7) AS source, o_orderpriority || ' & ' || o_orderkey AS title, 'http://x.org/' || o_orderkey AS link,
CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE {date:o_orderdate} END AS date, 'On ' || o_custkey AS summary FROM {orders}""")
def _(v):
    k = F.col("o_orderkey")
    day = F.when(k % 5 == 0, "soon").when(k % 5 < 3, F.date_format("o_orderdate", "EEE, dd MMM yyyy HH:mm:ss 'GMT'")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    item = F.concat(F.lit("<item><title><![CDATA["), "o_orderpriority", F.lit(" &amp; "), _s("o_orderkey"), F.lit("]]></title>\n<link>http://x.org/"),
        _s("o_orderkey"), F.lit("</link><pubDate>"), day, F.lit("</pubDate><description><p>On <b>"), _s("o_custkey"), F.lit("</b></p></description></item>"))
    feeds = v.orders.select(F.concat(F.lit("s"), (k % 7).cast("string")).alias("source"), F.floor(k / 200).alias("batch"),
        item.alias("i")).groupBy("source", "batch").agg(F.concat(F.lit("<rss><title>feed</title>"), F.array_join(F.collect_list("i"), " "), F.lit("</rss>")).alias("body"))
    return p.parse_rss(feeds)


@query("io4_parse_api_items", """SELECT 'api:' || o_orderkey AS id, 'api' AS source, o_orderpriority AS title, {date:o_orderdate} AS date, CASE
WHEN o_orderkey % 2 = 0 THEN 'over' ELSE 'sum' || o_custkey END AS summary FROM {orders}""")
def _(v):
    item = F.struct(_s("o_orderkey").alias("Id"), F.col("o_orderpriority").alias("Title"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("PublicationDate"),
                    F.when(F.col("o_orderkey") % 2 == 0, "").otherwise(F.concat(F.lit("<p>sum"), _s("o_custkey"), F.lit("</p>"))).alias("Summary"), F.lit("over").alias("Overview"))
    bodies = v.orders.groupBy("o_custkey").agg(F.collect_list(item).alias("value")).select(F.to_json(F.struct("value")).alias("body"))
    return p.parse_api_items(bodies, "api")


@query("io5_parse_board_listing", """SELECT CAST(o_orderkey AS VARCHAR) AS article_id, o_orderpriority || ' notice' AS title, {date:o_orderdate} AS date
FROM {orders}""")
def _(v):
    row = F.concat(F.lit("<tr><td><a href=\"/view?id="), _s("o_orderkey"), F.lit("\">"), "o_orderpriority",
        F.lit(" notice <span>NEW</span></a></td><td>"), F.date_format("o_orderdate", "yyyy.MM.dd"), F.lit("</td></tr>"))
    pages = v.orders.groupBy(F.floor(F.col("o_orderkey") / 200)).agg(F.concat(F.lit("<table><tr><th>title</th></tr>"), F.array_join(F.collect_list(row), "\n")).alias("html"))
    return p.parse_board_listing(pages.union(pages))  # every id is delivered twice


@query("io6_parse_html_table_long", """SELECT p_partkey AS page_id, label, kind, \"column\", value
FROM (SELECT p_partkey, p_size, unnest(['A', 'A', 'B', 'B']) AS label, unnest(['rate', 'rate', 'count', 'count']) AS kind, unnest(['2019', '2020', '2019', '2020']) AS \"column\", unnest([p_size + 0.5, NULL, 1000.0 + p_size, p_size * 1.0]) AS value
FROM {part})""")
def _(v):
    size = lambda f: (F.col("p_size") + f).cast("string")
    html = F.concat(F.lit("<table><caption>other</caption><tr><td>rate</td><td>9</td></tr></table><table><tr><td>layout<table id=t><caption> Uptake </caption><tr><th>group</th><th>kind</th><th>2019</th><th>2020</th></tr><tr><td class=\"group\" rowspan=2>A</td><td>rate</td><td>"), size(0.5),
                    F.lit("</td><td>-</td></tr><tr><td>note</td><td>x</td><td>y</td></tr><tr><td class=\"group\">B</td><td>other</td><td>1</td><td>1</td></tr><tr><td>count</td><td>"), F.format_number(F.col("p_size") + 1000, 0), F.lit("</td><td>"), size(0), F.lit("</td></tr></table></td></tr></table>"))
    return p.parse_html_table_long(v.part.select(F.col("p_partkey").alias("page_id"), html.alias("html")), "Uptake", ["rate", "count"])


@query("io7_parse_markdown_cards", """SELECT p_partkey AS file, p_name AS entity, p_brand AS alias, p_type AS type,
CAST(p_size AS VARCHAR) AS size, 'first|second' AS notes FROM {part}""")
def _(v):
    text = F.concat(F.lit("# Title\n- stray\n### Contents\n- **type**: none\n## Section\n### "), "p_name", F.lit(" ("), "p_brand",
        F.lit(")\n- **type**: "), "p_type", F.lit("\n- first\n\n- **size** : "), _s("p_size"), F.lit("\n- second\n- **type**: again\n## End\n- third"))
    c = p.parse_markdown_cards(v.part.select(F.col("p_partkey").alias("file"), text.alias("text")))
    return c.select("file", "entity", "alias", F.try_element_at("fields", F.lit("type")).alias("type"),
        F.try_element_at("fields", F.lit("size")).alias("size"), F.array_join("notes", "|").alias("notes"))


def _letters():
    return F.translate(_s("s_suppkey"), "0123456789", "abcdefghij")


@query("io8_parse_weekly_table_lines", """WITH s AS (SELECT s_suppkey AS k, translate(CAST(s_suppkey AS VARCHAR), '0123456789', 'abcdefghij') AS w
FROM {supplier})
SELECT k AS doc, CAST(1 + k % 3 AS VARCHAR) AS grade, 'Pox ' || w AS name, array_to_string(list_transform(range(8), lambda i: CASE
WHEN i = k % 8 THEN '' ELSE CAST(i * k * 1000 AS VARCHAR) END), ',') AS "values", 8 AS n_values, NULL AS partial FROM s
UNION ALL SELECT k, CAST(CASE WHEN k % 4 = 0 THEN 1 + k % 3 ELSE 4 END AS VARCHAR), CASE
WHEN k % 2 = 0 THEN 'Long ' ELSE '' END || 'Fever ' || w, (k + 3) || ',' || (k + 4), 3 + k % 5, 3 + k % 5 FROM s
UNION ALL SELECT k, CAST(CASE WHEN k % 4 = 0 THEN 1 + k % 3 ELSE 4 END AS VARCHAR), 'Late', k || ',', 3, 3 FROM s WHERE k % 5 <> 0""")
def _(v):
    k, w = F.col("s_suppkey"), _letters()
    numbers = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.when(i == k % 8, "-").otherwise(F.format_number(i * k * 1000, 0)))
    fewer = F.transform(F.sequence(F.lit(3), (5 + k % 5).cast("int")), lambda i: (k + i).cast("string"))
    line = lambda *parts: F.concat(*(x if not isinstance(x, str) else F.lit(x) for x in parts))
    lines = F.concat_ws("\n", F.lit("Weekly table"), line("Grade ", (1 + k % 3).cast("string")), line("Pox ", w, " ", F.array_join(numbers, " ")), F.lit("Total 1 2 3 4"),
                        F.when(k % 4 != 0, "Grade 4"), F.when(k % 2 == 0, "Long"), line("Fever ", w, " ", F.array_join(fewer, " ")),
                            line("Pox ", w, " 9 9 9"), line("Only two ", w, " 1 2"))
    last = F.when(k % 5 == 0, line("By region\nLate ", k.cast("string"), " - 2")).otherwise(line("Late ", k.cast("string"), " - 2"))
    pages = F.array(F.struct(F.lit(1).alias("page_no"), lines.alias("text")), F.struct(F.lit(2).alias("page_no"), last.alias("text")),
        F.struct(F.lit(3).alias("page_no"), F.lit("By region\nTyphus 1 2 3").alias("text")))
    rows = p.parse_weekly_table_lines(v.supplier.select(k.alias("doc"), F.explode(pages).alias("x")).select("doc", "x.*"), r"^Grade (\d)", ["Total"], "By region")
    return rows.withColumn("values", F.array_join(F.transform("values", lambda x: F.coalesce(x.cast("long").cast("string"), F.lit(""))), ","))


@query("io9_parse_weekly_pair_table", """WITH r AS (SELECT s_suppkey AS k, i, (s_suppkey * 7 + i * 5) % 60 AS week, CASE
WHEN (s_suppkey + i) % 4 = 0 THEN 3 ELSE 2 END AS pairs, (s_suppkey * i) % 130 / 1.25 AS pct FROM {supplier}, range(1, 7) t(i)),
y AS (SELECT *, max(CASE WHEN i IN (1, 4) THEN 2018 + k % 3 + i END) OVER (PARTITION BY k ORDER BY i) AS year FROM r)
SELECT k AS doc, CAST(year AS INT) AS year, CAST(week AS INT) AS week, agent, CAST(CASE WHEN agent = 'a' THEN k * 1000 + i ELSE i END AS BIGINT) AS n,
CAST(CASE WHEN agent = 'a' THEN pct ELSE 50 END AS DOUBLE) AS pct FROM y, (VALUES ('a'), ('b')) a(agent) WHERE pairs = 2 AND week BETWEEN 1 AND 53
AND pct <= 100""")
def _(v):
    k = F.col("s_suppkey")

    def line(i):
        pct = (k * i) % 130 / 1.25
        pairs = F.concat(F.format_number(k * 1000 + i, 0), F.lit(" ("), pct.cast("string"), F.lit(") "), i.cast("string"), F.lit(" (50)"),
            F.when((k + i) % 4 == 0, " 1 (1)").otherwise(""))
        return F.concat(F.when(i.isin(1, 4), F.concat((2018 + k % 3 + i).cast("string"), F.lit(" "))).otherwise(" "), ((k * 7 + i * 5) % 60).cast("string"), F.lit(" "), pairs)
    text = F.concat(F.lit("year week a b\n"), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(6)), line), "\n"))
    found = p.parse_weekly_pair_table(v.supplier.select(k.alias("doc"), text.alias("text")), ["a", "b"])
    return found.withColumn("n", F.col("n").cast("long"))


@query("io10_parse_sentinel_indicators", """SELECT s_suppkey AS doc, s_suppkey / 10.0 AS ili, CAST(s_suppkey AS DOUBLE) AS clinics, CASE
WHEN s_suppkey % 2 = 0 THEN 6.5 END AS threshold FROM {supplier}""")
def _(v):
    text = F.concat(F.lit("The rate of influenza-like illness was "), (F.col("s_suppkey") / 10).cast("string"), F.lit(" per 1,000 at "),
        F.format_number("s_suppkey", 0), F.lit(" clinics"), F.when(F.col("s_suppkey") % 2 == 0, " (threshold 6.5)").otherwise(""), F.lit("."))
    return p.parse_sentinel_indicators(v.supplier.select(F.col("s_suppkey").alias("doc"), text.alias("text")),
        {"ili": r"illness was ([\d.]+)", "clinics": r"at ([\d,]+) clinics", "threshold": r"threshold ([\d.]+)"})


@query("io17_parse_listing_with_hidden", """SELECT p_partkey AS page_id, (p_partkey + i) % 3 = 0 AS hidden, p_name || ' ' || i AS label, CASE
WHEN p_size % (i + 1) = 0 THEN p_brand || i || '.png' ELSE '' END AS cover,
CASE WHEN (p_size + i) % 2 = 0 THEN p_partkey || '-' || i || '.pdf' END AS file FROM {part}, range(1, 6) t(i) WHERE i <= 1 + p_partkey % 5""")
def _(v):
    def item(i):
        n = i.cast("string")
        image = F.when(F.col("p_size") % (i + 1) == 0, F.concat(F.lit('<img class="c" src="'), "p_brand", n, F.lit('.png">'))).otherwise("")
        link = F.concat(F.lit('<a href="'), F.when((F.col("p_size") + i) % 2 == 0, F.concat(_s("p_partkey"), F.lit("-"), n, F.lit(".pdf"))).otherwise(""), F.lit('">get</a>'))
        text = F.concat(F.lit("<li class=x>"), image, F.lit("<b>"), "p_name", F.lit(" <i>"), n, F.lit("</i></b>"), link, F.lit("</li>"))
        return F.when((F.col("p_partkey") + i) % 3 == 0, F.concat(F.lit("<!-- "), text, F.lit(" -->"))).otherwise(text)
    html = F.concat(F.lit("<ul>"), F.array_join(F.transform(F.sequence(F.lit(1), (1 + F.col("p_partkey") % 5).cast("int")), item), "\n"), F.lit("</ul>"))
    return p.parse_listing_with_hidden(v.part.select(F.col("p_partkey").alias("page_id"), html.alias("html")))


@query("io18_report_header", """SELECT doc, CAST(regexp_extract(first(text ORDER BY page_no), 'Vol. ([0-9]+)', 1) AS INT) AS volume,
CAST(regexp_extract(first(text ORDER BY page_no), 'No. ([0-9]+)', 1) AS INT) AS number,
right(first(text ORDER BY page_no), 10) AS date, min(page_no) FILTER (contains(text, 'weekly status') AND contains(text, 'notified')
AND NOT contains(text, 'contents')) AS page FROM {report} GROUP BY 1""")
def _(v):
    return p.report_header(v.report, ["weekly status", "notified"], ["contents"])


@query("io11_grep_pages", """SELECT doc, page_no FROM (SELECT doc, page_no, row_number() OVER (PARTITION BY doc ORDER BY page_no) AS k FROM {report}
WHERE contains(text, 'weekly status')) WHERE k <= 2""")
def _(v):
    return p.grep_pages(v.report, "weekly status", 2)


@query("x16_parse_specimen_rows", """WITH r AS (SELECT s_suppkey AS k, i, CASE
WHEN i = 1 OR (s_suppkey + i) % 3 = 0 THEN ['PCR', 'Culture', 'ELISA'][1 + (s_suppkey + i) % 3] || (i % 2) END AS m, CASE
WHEN (s_suppkey * i) % 3 = 0 THEN (i - s_suppkey % 20) || '°C' END AS t FROM {supplier}, range(1, 6) x(i) WHERE i <= 2 + s_suppkey % 4)
SELECT k AS doc, last_value(m IGNORE NULLS) OVER w AS method, 'Sample' || i AS name, CASE
WHEN k % 2 = 0 THEN 'day ' || i ELSE '' END AS "when", ['EDTA tube', 'SST', 'cup'][1 + (k * i) % 3] AS container, CASE
WHEN (k + i) % 2 = 0 THEN (1 + (k + i) % 9) || ' mL' ELSE '' END AS amount, last_value(t IGNORE NULLS) OVER w AS temp
FROM r WINDOW w AS (PARTITION BY k ORDER BY i)""")
def _(v):
    k = F.col("s_suppkey")

    def lines(i):
        method = F.when((i == 1) | ((k + i) % 3 == 0), F.concat(F.lit("Method: "), F.array(*map(F.lit,
            ("PCR", "Culture", "ELISA")))[((k + i) % 3).cast("int")], (i % 2).cast("string"), F.lit("\n"))).otherwise("")
        when = F.when(k % 2 == 0, F.concat(F.lit("day "), i.cast("string"), F.lit(" "))).otherwise("")
        amount = F.when((k + i) % 2 == 0, F.concat(F.lit(" "), (1 + (k + i) % 9).cast("string"), F.lit(" mL"))).otherwise("")
        temp = F.when((k * i) % 3 == 0, F.concat(F.lit(" "), (i - k % 20).cast("string"), F.lit("°C"))).otherwise("")
        return F.concat(method, F.lit("Sample"), i.cast("string"), F.lit(" "), when, F.array(*map(F.lit, ("EDTA tube", "SST", "cup")))[((k * i) % 3).cast("int")], amount, temp)
    text = F.concat(F.array_join(F.transform(F.sequence(F.lit(1), (2 + k % 4).cast("int")), lines), "\n"), F.lit("\nfree text"))
    rows = v.supplier.select(k.alias("doc"), F.posexplode(F.split(text, "\n")).alias("no", "line"))
    return p.parse_specimen_rows(rows, ["EDTA tube", "SST", "cup"], r"^Method: (\w+)").drop("no")


@query("x17_split_sections", """WITH s AS (SELECT *, CASE WHEN starts_with(text, 'Part: ') THEN substring(text, 7) END AS t, sum(CASE
WHEN starts_with(text, 'Part: ') THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY page_no) AS section FROM {report})
SELECT doc, CAST(section AS BIGINT) AS section, max(t) AS title, min(page_no) AS first_page, max(page_no) AS last_page FROM s WHERE section > 0
GROUP BY 1, 2""")
def _(v):
    return p.split_sections(v.report, r"^Part: (.*)$")


@query("io15_emit_feed", """SELECT event_id AS id, {date:ts} AS date, CASE
WHEN event_id % 2 = 0 THEN '[' || event_type || '] ' ELSE '' END || 'Item ' || event_id AS title FROM {events}
ORDER BY {date:ts} DESC, event_id LIMIT 30""")
def _(v):
    even = F.col("event_id") % 2 == 0
    items = v.events.select(F.col("event_id").alias("id"), F.date_format("ts", "yyyy-MM-dd").alias("date"),
        F.when(even, F.array("event_type")).otherwise(F.array().cast("array<string>")).alias("labels"), F.concat(F.lit("Item "), _s("event_id")).alias("title"))
    return p.emit_feed(items, 30).drop("xml")


@query("io16_emit_digest", """SELECT '2024-01-10: ' || sum(n) || ' new' AS subject, CAST(sum(n) AS BIGINT) AS n, string_agg(event_type || '=' || n, ','
ORDER BY event_type || '=' || n) AS sources FROM (SELECT event_type, count(*) AS n FROM {events} WHERE {date:ts} = '2024-01-10' GROUP BY 1)""")
def _(v):
    return p.emit_digest(v.events.select(F.date_format("ts", "yyyy-MM-dd").alias("first_seen"), F.col("event_type").alias("source")), "2024-01-10")
