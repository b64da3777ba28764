"""Checks of published data: each returns rows (severity, check, subject, detail), and none collects."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilspark.operators import match


def finding(severity: str, check: str, subject: Column, detail: Column) -> list[Column]:
    return [F.lit(severity).alias("severity"), F.lit(check).alias("check"), subject.cast("string").alias("subject"), detail.cast("string").alias("detail")]


def profile_table(df: DataFrame) -> DataFrame:
    """(column, rows, filled, distinct, least, most) in one pass."""
    measures = [F.struct(F.lit(c).alias("column"), F.count("*").alias("rows"), F.count(c).alias("filled"), F.countDistinct(c).alias("distinct"),
        F.min(c).cast("string").alias("least"), F.max(c).cast("string").alias("most")) for c in df.columns]
    return df.agg(F.array(*measures).alias("_m")).select(F.explode("_m").alias("_m")).select("_m.*")


def year_columns(df: DataFrame) -> list[str]:
    """Columns whose name is a year."""
    return [c for c in df.columns if re.fullmatch(r"(19|20)\d{2}", c.strip())]


def year_bounds(df: DataFrame, columns: list[str]) -> DataFrame:
    """(rows, cols, first_year, last_year): the first year in each value of ``columns``, and the columns named by a year."""
    years = [F.regexp_extract(F.col(c).cast("string"), r"((?:19|20)\d{2})", 1).try_cast("int") for c in columns]
    named = [int(c.strip()) for c in year_columns(df)]
    ends = lambda f, pick: pick(*([f(y) for y in years] + [F.lit(n) for n in (min(named),
        max(named))] if named else [f(y) for y in years] + [F.lit(None).cast("int")] * 2))
    return df.agg(F.count("*").alias("rows"), F.lit(len(df.columns)).alias("cols"), ends(F.min, F.least).alias("first_year"), ends(F.max, F.greatest).alias("last_year"))


def year_cover(df: DataFrame) -> DataFrame:
    """(year, filled): rows with a value, not blank and no dash, in each column named by a year."""
    full = lambda c: ~F.coalesce(F.trim(F.col(f"`{c}`").cast("string")), F.lit("")).isin("", "-")
    counts = [F.struct(F.lit(int(c.strip())).alias("year"), F.count_if(full(c)).alias("filled")) for c in year_columns(df)]
    none = F.array().cast("array<struct<year:int,filled:bigint>>")
    return df.agg((F.array(*counts) if counts else none).alias("_y")).select(F.explode("_y").alias("_y")).select("_y.*")


def preview(df: DataFrame, order: list[str], rows: int = 4, columns: int = 8, width: int = 60) -> DataFrame:
    """The first rows and columns as texts."""
    return df.orderBy(*order).limit(rows).select(*(F.substring(F.col(c).cast("string"), 1, width).alias(c) for c in df.columns[:columns]))


def check_year_columns(wide: DataFrame, years: list[int], this_year: int) -> DataFrame:
    """Future year: error; newest year over two years old, missing years between, all-empty years: warnings."""
    known = [y for y in years if y <= this_year]
    gaps = [y for y in range(min(years), max(years)) if y not in years]
    fixed = [("error", "future year", y) for y in years if y > this_year] + [("warn", "missing year", y) for y in gaps]
    if known and this_year - max(known) > 2:
        fixed.append(("warn", "stale", max(known)))
    counted = wide.agg(*(F.count_if(F.trim(F.col(str(y)).cast("string")) != "").alias(str(y)) for y in years)).unpivot([], [str(y) for y in years], "subject", "_n")
    empty = counted.where("_n = 0").select(*finding("warn", "empty year", F.col("subject"), F.lit(None)))
    rows = wide.sparkSession.createDataFrame([(s, c, str(y), None) for s, c, y in fixed], "severity string, check string, subject string, detail string")
    return rows.unionByName(empty)


def check_required(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """A finding for every empty required field."""
    empty = F.filter(F.array(*(F.when(F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == ""), F.lit(c)) for c in columns)), lambda x: x.isNotNull())
    return df.select(F.col(key).alias("_k"), F.explode(empty).alias("_c")).select(*finding("error", "required", F.col("_k"), F.col("_c")))


def check_foreign_key(df: DataFrame, key: str, column: str, known: DataFrame, known_column: str) -> DataFrame:
    orphans = df.where(F.col(column).isNotNull()).join(known.select(F.col(known_column).alias(column)).distinct(), column, "left_anti")
    return orphans.select(*finding("error", "unknown reference", F.col(key), F.col(column)))


def reconcile_declared(marks: DataFrame, declared: DataFrame) -> DataFrame:
    """Declared count, marks and distinct entities a category, and whether all agree in all categories."""
    got = marks.groupBy("category").agg(F.count("*").alias("marks"), F.countDistinct("entity").alias("entities"))
    rows = declared.join(got, "category", "full_outer").na.fill(0, ["marks", "entities"])
    agree = F.coalesce((F.col("declared") == F.col("marks")) & (F.col("marks") == F.col("entities")), F.lit(False))
    gate = rows.agg(F.bool_and(agree).alias("verified"))
    return rows.withColumn("agree", agree).join(F.broadcast(gate), F.lit(True))


def publish_if_verified(marks: DataFrame, declared: DataFrame) -> DataFrame:
    """The marks, or nothing at all if a single category doesn't reconcile."""
    gate = reconcile_declared(marks, declared).select("verified").distinct()
    return marks.join(F.broadcast(gate.where("verified")), F.lit(True), "left_semi")


def self_consistency(rows: DataFrame, declared: DataFrame) -> DataFrame:
    """Per document: rows whose name its own declared list holds, rows dropped, and whether a review is needed."""
    lists = declared.select("doc", F.transform(F.split("declared", ","), lambda x: F.lower(F.trim(x))).alias("_d"))
    joined = rows.join(lists, "doc", "left").withColumn("_in", F.coalesce(F.array_contains("_d", F.lower("name")), F.lit(False)))
    return joined.groupBy("doc").agg(F.count_if("_in").alias("kept"), F.count_if(~F.col("_in")).alias("dropped")).withColumn("needs_review", F.col("dropped") > 0)


def check_pages(pages: DataFrame, relative_only: bool = True) -> DataFrame:
    """Charset, language, title, description, root-absolute links and repeated ids of each page (page_id, html)."""
    h = F.col("html")
    ids = F.regexp_extract_all(h, F.lit(r'(?i)\sid="([^"]+)"'), 1)
    problems = F.array(
        F.when(~h.rlike(r'(?i)<meta[^>]*charset="?utf-8'), F.struct(F.lit("error").alias("s"), F.lit("charset").alias("c"), F.lit(None).cast("string").alias("d"))),
        F.when(~h.rlike(r"(?i)<html[^>]*\slang="), F.struct(F.lit("error").alias("s"), F.lit("lang").alias("c"), F.lit(None).cast("string").alias("d"))),
        F.when(F.trim(F.regexp_extract(h, r"(?is)<title>(.*?)</title>", 1)) == "", F.struct(F.lit("error").alias("s"), F.lit("title").alias("c"),
            F.lit(None).cast("string").alias("d"))),
        F.when(~h.rlike(r'(?i)<meta[^>]*name="description"'), F.struct(F.lit("warn").alias("s"), F.lit("description").alias("c"), F.lit(None).cast("string").alias("d"))),
        F.when(F.lit(relative_only) & h.rlike(r'(?i)(?:href|src)="/(?!/)'), F.struct(F.lit("error").alias("s"), F.lit("absolute link").alias("c"),
            F.regexp_extract(h, r'(?i)(?:href|src)="(/[^"]*)"', 1).alias("d"))),
        F.when(F.size(ids) > F.size(F.array_distinct(ids)), F.struct(F.lit("error").alias("s"), F.lit("repeated id").alias("c"), F.lit(None).cast("string").alias("d"))))
    return pages.select(F.col("page_id").cast("string").alias("subject"), F.explode(F.filter(problems,
        lambda p: p.isNotNull())).alias("_p")).select(F.col("_p.s").alias("severity"), F.col("_p.c").alias("check"), "subject", F.col("_p.d").alias("detail"))


def shared_target(df: DataFrame) -> DataFrame:
    """Files that more than one label links to."""
    return df.groupBy("file").agg(F.array_sort(F.collect_set("label")).alias("labels")).where(F.size("labels") > 1)


def unsupported_values(values: DataFrame, ledger: DataFrame) -> DataFrame:
    """Published values (entity, value, class) that no ledger row supports."""
    return values.join(ledger.select("entity", "value").distinct(), ["entity", "value"], "left_anti").select(*finding("error", "unsupported", F.col("entity"), F.col("value")))


def blanket_values(values: DataFrame, least: int = 3) -> DataFrame:
    """A class of ``least`` or more entities that all have one and the same value."""
    return values.groupBy("class").agg(F.countDistinct("entity").alias("n"), F.countDistinct("value").alias("_v"),
        F.min("value").alias("value")).where((F.col("n") >= least) & (F.col("_v") == 1)).select(*finding("warn", "blanket value", F.col("class"), F.col("value")))


def contradicting_links(df: DataFrame) -> DataFrame:
    """Primary documents (title, entity, grade) that name another grade or a list without the entity.

    Each row is judged by its own grade: what names the same entity and title may have another."""
    return df.where(match.mislisted()).select(*finding("error", "contradicting link", F.col("entity"), F.col("title")))


def overlapping_dictionaries(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select(F.lower("word").alias("word")).intersect(b.select(F.lower("word").alias("word")))


def severity_report(findings: DataFrame) -> DataFrame:
    """Counts by severity and check, by severity, and overall."""
    return findings.rollup("severity", "check").agg(F.count("*").alias("n"))


def passed(findings: DataFrame) -> DataFrame:
    return findings.agg((F.count_if(F.col("severity") == "error") == 0).alias("passed"))
