"""Registry of queries: each has a function (views) -> DataFrame, and SQL for DuckDB where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vigilspark.operators.order import folder

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "benchmark", "conversations")
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Domain tables built from the given ones; written once for both dialects.
STAND_INS = {
    "notif": """SELECT o_orderpriority AS entity, {isoyear:o_orderdate} AS year, {week:o_orderdate} AS week, CAST(count(*) AS BIGINT) AS n FROM {orders}
GROUP BY 1, 2, 3""",
    "cust_weekly": """SELECT o_custkey AS entity, {isoyear:o_orderdate} AS year, {week:o_orderdate} AS week, CAST(count(*) AS BIGINT) AS n FROM {orders}
GROUP BY 1, 2, 3""",
    "lab": """SELECT concat(l_returnflag, '/', l_linestatus) AS agent, {isoyear:l_shipdate} AS year, {week:l_shipdate} AS week,
CAST(count(*) AS BIGINT) AS specimens, CAST(sum(CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END) AS BIGINT) AS positives FROM {lineitem}
GROUP BY 1, 2, 3""",
    "imports": """SELECT {isoyear:o_orderdate} AS year, {week:o_orderdate} AS week, o_orderpriority AS condition, n_name AS country,
CAST(count(*) AS BIGINT) AS n FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey GROUP BY 1, 2, 3, 4""",
    "entries": """SELECT {month:o_orderdate} AS month, n_name AS country, CAST(count(*) AS BIGINT) AS n FROM {orders}
JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey GROUP BY 1, 2""",
    "arrivals": """SELECT CAST({year:l_shipdate} AS INT) AS year, n_name AS country, CAST(count(*) AS BIGINT) AS flights,
CAST(sum(l_quantity) AS BIGINT) AS total, CAST(sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) AS BIGINT) AS transit FROM {lineitem}
JOIN {supplier} ON l_suppkey = s_suppkey JOIN {nation} ON s_nationkey = n_nationkey GROUP BY 1, 2""",
    "designation": """SELECT n_name AS country, condition, CASE WHEN (n_nationkey + k) % 6 = 0 THEN 'priority' ELSE 'general' END AS level FROM {nation}
JOIN (SELECT o_orderpriority AS condition, CAST(substring(o_orderpriority, 1, 1) AS INT) AS k FROM {orders}
GROUP BY 1, 2) d ON (n_nationkey * 7 + k * 3) % 4 = 0""",
    "annual": "SELECT o_orderpriority AS entity, CAST({year:o_orderdate} AS INT) AS year, CAST(count(*) AS BIGINT) AS value FROM {orders} GROUP BY 1, 2",
    "brand_annual": """SELECT p_brand AS entity, CAST({year:l_shipdate} AS INT) AS year, CAST(count(*) AS BIGINT) AS value FROM {lineitem}
JOIN {part} ON l_partkey = p_partkey GROUP BY 1, 2""",
    "catalogue": """SELECT p_partkey AS doc,
CAST(2002 + p_partkey % 24 AS INT) AS year, concat(CAST(2002 + p_partkey % 24 AS {string}), ' ', p_name, ' guideline (', p_brand, ')') AS title, p_name AS name, concat(CAST(2002 + p_partkey % 24 AS {string}), '-', lpad(CAST(1 + p_partkey % 12 AS {string}), 2, '0'), '-15') AS posted, p_brand AS board,
CASE WHEN p_size % 3 = 0 THEN 'manual' WHEN p_size % 3 = 1 THEN 'guide' ELSE 'notice' END AS kind, CASE
WHEN p_size % 5 < 3 THEN 'infection' ELSE 'chronic' END AS field, concat('https://example.org/doc?id=', CAST(p_partkey AS {string})) AS url
FROM {part}""",
    "titled": """SELECT p_partkey, p_brand AS entity, p_size % 4 + 1 AS grade, concat('handbook', CASE
WHEN p_partkey % 3 = 0 THEN '' ELSE concat(' of grade ', CAST(p_partkey % 5 AS {string})) END,
CASE p_partkey % 7 WHEN 0 THEN '' WHEN 1 THEN concat(' (', p_brand, ')') WHEN 2 THEN concat(' (', p_brand, ', Brand#1)') ELSE concat(' (Brand#',
CAST(p_size % 25 AS {string}), ', Brand#', CAST(p_partkey % 26 AS {string}), ')') END,
CASE WHEN p_partkey % 11 = 0 THEN concat(' on ', p_brand) ELSE '' END) AS title FROM {part}""",
    "part_annual": "SELECT l_partkey AS entity, CAST({year:l_shipdate} AS INT) AS year, CAST(count(*) AS BIGINT) AS value FROM {lineitem} GROUP BY 1, 2",
    # Reports of pages: a header, the contents, then three to five pages whose texts depend on both numbers.
    "report": """SELECT s_suppkey AS doc, page_no, CASE WHEN page_no = 1 THEN concat('Weekly report Vol. ', CAST(s_suppkey AS {string}), ' No. ',
CAST(s_suppkey % 53 + 1 AS {string}), ', ', CAST(2010 + s_suppkey % 15 AS {string}), '-0', CAST(1 + s_suppkey % 9 AS {string}), '-1',
CAST(s_suppkey % 10 AS {string}))
WHEN page_no = 2 THEN 'contents: weekly status of notified conditions' WHEN (s_suppkey + page_no) % 3 = 0 THEN concat('Part: Section ',
CAST(s_suppkey % 7 + page_no AS {string}), CASE WHEN s_suppkey % 2 = 0 THEN ' weekly status' ELSE '' END)
WHEN (s_suppkey * page_no) % 4 IN (1, 2) THEN concat('weekly status of notified conditions in ', s_name) ELSE concat('text of ', s_name) END AS text
FROM {supplier} JOIN (SELECT CAST(r_regionkey + 1 AS INT) AS page_no FROM {region} UNION ALL SELECT CAST(r_regionkey + 6 AS INT) FROM {region}
WHERE r_regionkey < 2) p ON page_no <= 5 + s_suppkey % 3""",
    "coverage": """SELECT p_brand AS vaccine, CAST(p_size % 4 AS INT) AS age, CAST({year:l_shipdate} AS INT) AS year, round(100.0 * sum(CASE
WHEN l_discount >= 0.02 THEN 1 ELSE 0 END) / count(*), 2) AS value FROM {lineitem} JOIN {part} ON l_partkey = p_partkey GROUP BY 1, 2, 3""",
    "feed": "SELECT user_id AS id, event_type AS source, {date:ts} AS day, CAST(floor(value) AS INT) % 5 AS level, event_id FROM {events}",
}
_SPARK = {"isoyear": "CAST(extract(YEAROFWEEK FROM {0}) AS INT)", "week": "CAST(weekofyear({0}) AS INT)", "month": "date_format({0}, 'yyyy-MM')",
    "year": "year({0})", "date": "date_format({0}, 'yyyy-MM-dd')"}
_DUCK = {"isoyear": "CAST(isoyear({0}) AS INT)", "week": "CAST(weekofyear({0}) AS INT)", "month": "strftime({0}, '%Y-%m')", "year": "year({0})",
    "date": "strftime({0}, '%Y-%m-%d')"}


def _render(sql: str, functions: dict[str, str], tables: dict[str, str], string: str) -> str:
    for name, form in functions.items():
        while (at := sql.find(f"{{{name}:")) >= 0:
            end = sql.index("}", at)
            sql = sql[:at] + form.format(sql[at + len(name) + 2:end]) + sql[end + 1:]
    for name, value in tables.items():
        sql = sql.replace(f"{{{name}}}", value)
    return sql.replace("{string}", string)


class Views:
    """The given tables and the stand-ins of one directory, as lazy DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def folder(self, kind: str) -> str:
        return folder(self.spark, kind)

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        if name not in STAND_INS:
            raise AttributeError(name)
        sql = _render(STAND_INS[name], _SPARK, {}, "STRING")
        used = {t: getattr(self, t) for t in TABLES if f"{{{t}}}" in sql}
        return self.spark.sql(sql, **used)


def query(name: str, oracle: str | None = None):
    """Register a query; ``{stand_in}`` in the SQL stands for that stand-in as a subquery."""
    def add(build: Callable[[Views], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: build(Views(spark, sf_dir))
        if oracle:
            tables = {t: t for t in TABLES}
            stand_ins = {k: "(" + _render(v, _DUCK, tables, "VARCHAR") + ")" for k, v in STAND_INS.items()}
            ORACLES[name] = _render(oracle, _DUCK, {**stand_ins, **tables}, "VARCHAR")
        return build
    return add
