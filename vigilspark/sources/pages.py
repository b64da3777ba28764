"""Feeds, listings, tables and report pages to rows; built-in functions, but for the grids of tables.

Pages have (page_id or doc, page_no, text); patterns are arguments, so layouts aren't fixed here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilspark.functions.clean import clean_number
from vigilspark.functions.tables import table_grids
from vigilspark.functions.text import html_to_text
from vigilspark.operators.surveil import carry_down


def _tag(item: Column, name: str) -> Column:
    return F.regexp_replace(F.regexp_extract(item, rf"(?s)<{name}\b[^>]*>(.*?)</{name}>", 1), r"(?s)^\s*<!\[CDATA\[(.*?)\]\]>\s*$", "$1")


def parse_rss(feeds: DataFrame, cap: int = 320) -> DataFrame:
    """(source, body) to items: title, link, date, summary.  RFC 822 or ISO dates; another date is empty."""
    item = F.explode(F.regexp_extract_all("body", F.lit(r"(?s)(<item\b.*?</item>)"), 1))
    when = F.trim(F.regexp_replace(_tag(F.col("_i"), "pubDate"), r"^\w{3}, ", ""))
    date = F.coalesce(F.try_to_timestamp(when, F.lit("d MMM yyyy HH:mm:ss Z")), F.try_to_timestamp(when, F.lit("d MMM yyyy HH:mm:ss z")),
        F.try_to_timestamp(F.substring(when, 1, 10), F.lit("yyyy-MM-dd")))
    return feeds.select("source", item.alias("_i")).select(
        "source", html_to_text(_tag(F.col("_i"), "title")).alias("title"), F.trim(_tag(F.col("_i"), "link")).alias("link"),
        F.coalesce(F.date_format(date, "yyyy-MM-dd"), F.lit("")).alias("date"), F.substring(html_to_text(_tag(F.col("_i"), "description")), 1, cap).alias("summary"))


def parse_api_items(df: DataFrame, source: str, cap: int = 320) -> DataFrame:
    """JSON bodies with a ``value`` array to items; the summary falls back to the overview."""
    schema = "value array<struct<Id:string,Title:string,PublicationDate:string,Summary:string,Overview:string>>"
    v = F.explode(F.from_json("body", schema)["value"])
    return df.select(v.alias("_v")).select(F.concat(F.lit(f"{source}:"), F.col("_v.Id")).alias("id"), F.lit(source).alias("source"),
        F.trim("_v.Title").alias("title"), F.substring("_v.PublicationDate", 1, 10).alias("date"),
                                           F.substring(html_to_text(F.coalesce(F.nullif("_v.Summary", F.lit("")), "_v.Overview", F.lit(""))), 1, cap).alias("summary"))


def parse_board_listing(pages: DataFrame, badge: str = "NEW") -> DataFrame:
    """Listing pages to (article_id, title, date), one row an id; rows without a link go."""
    row = F.explode(F.split("html", r"(?i)<tr\b"))
    rows = pages.select(row.alias("_r")).select(F.regexp_extract("_r", r'href="[^"]*?(?:id=|/)(\d+)"', 1).alias("article_id"),
                                               F.trim(F.regexp_replace(html_to_text(F.regexp_extract("_r", r"(?is)<a\b[^>]*>(.*?)</a>", 1)), rf"\s*\b{badge}$", "")).alias("title"),
                                               F.regexp_replace(F.regexp_extract("_r", r"(\d{4}[.-]\d{2}[.-]\d{2})", 1), r"\.", "-").alias("date"))
    return rows.where("article_id <> ''").groupBy("article_id").agg(F.min(F.struct("date", "title")).alias("_m")).select("article_id", "_m.title", "_m.date")


def parse_html_table_long(pages: DataFrame, caption: str, kinds: list[str]) -> DataFrame:
    """The captioned table of each page (page_id, html) as cells (page_id, label, kind, column, value).

    The first row names the columns.  A row as long as it begins with its label, also by a cell that spans rows; a
    shorter one takes the label of the row above.  Only rows of the given kinds are measures.  Tables may be nested."""
    tables = pages.select("page_id", F.explode(table_grids(F.col("html"))).alias("_t")).where(F.rlike("_t.caption", F.lit(rf"^(?is)\s*{caption}\s*$")))
    rows = tables.select("page_id", F.get("_t.rows", F.lit(0)).alias("_h"), F.posexplode(F.slice("_t.rows", 2, 1 << 20)).alias("_n", "_r"))
    whole = F.size("_r") == F.size("_h")
    rows = rows.withColumn("label", F.when(whole, F.nullif(F.get("_r", F.lit(0)), F.lit("")))).withColumn("_c", F.when(whole, F.slice("_r", 2, 1 << 20)).otherwise(F.col("_r")))
    rows = carry_down(rows, "label", ["page_id"], ["_n"]).where(F.get("_c", F.lit(0)).isin(kinds))
    cells = F.explode(F.arrays_zip(F.slice("_h", 3, 1 << 20).alias("h"), F.slice("_c", 2, 1 << 20).alias("c")))
    return rows.select("page_id", "label", F.get("_c", F.lit(0)).alias("kind"), cells.alias("_z")).select("page_id", "label", "kind",
        F.col("_z.h").alias("column"), clean_number(F.col("_z.c")).alias("value"))


def parse_markdown_cards(files: DataFrame, skip: str = "(?i)^contents") -> DataFrame:
    """(file, text) to cards: ``### name (alias)`` heads a card, ``- **field**: value`` fills it, ``- note`` adds a
    note; another header closes it, a head that matches ``skip`` opens none."""
    lines = files.select("file", F.posexplode(F.split("text", "\n")).alias("no", "line"))
    head = F.regexp_extract("line", r"^###\s+(.*\S)\s*$", 1)
    opened = F.when(head != "", F.when(head.rlike(skip), "").otherwise(F.concat(F.col("no").cast("string"), F.lit("\t"), head))).when(F.col("line").rlike(r"^#{1,2}\s"), "")
    rows = carry_down(lines.withColumn("_card", opened), "_card", ["file"], ["no"]).where("_card <> ''")
    field = F.regexp_extract("line", r"^-\s+\*\*(.+?)\*\*\s*:\s*(.*\S)\s*$", 1)
    note = F.when(field == "", F.nullif(F.regexp_extract("line", r"^-\s+(?!\*\*)(.*\S)\s*$", 1), F.lit("")))
    rows = rows.withColumn("_f", field).withColumn("_v", F.regexp_extract("line", r"^-\s+\*\*(.+?)\*\*\s*:\s*(.*\S)\s*$", 2)).withColumn("_note", note)
    entries = F.array_sort(F.collect_list(F.when(F.col("_f") != "", F.struct("no", "_f", "_v"))))
    # The first value of a field counts.
    first = F.filter(entries, lambda e: ~F.exists(entries, lambda o: (o["_f"] == e["_f"]) & (o["no"] < e["no"])))
    name = F.regexp_replace("_card", r"^\d+\t", "")
    return rows.groupBy("file", "_card").agg(F.map_from_entries(F.transform(first, lambda e: F.struct(e["_f"], e["_v"]))).alias("fields"),
                                             F.transform(F.array_sort(F.collect_list(F.when(F.col("_note").isNotNull(), F.struct("no", "_note")))),
                                                 lambda x: x["_note"]).alias("notes")).select(
        "file", F.trim(F.regexp_replace(name, r"\s*\([^)]*\)\s*$", "")).alias("entity"), F.regexp_extract(name, r"\(([^)]*)\)\s*$", 1).alias("alias"), "fields", "notes")


def parse_weekly_table_lines(pages: DataFrame, grade: str, skip: list[str], stop: str, columns: int = 8) -> DataFrame:
    """Report lines (doc, page_no, text) to rows (doc, grade, name, values, n_values, partial).

    A line is a name and 3 to ``columns`` value tokens; a grade line carries down; a line without numbers prefixes
    the next name; the first row of a name wins; exactly ``columns`` values are kept whole, otherwise the first two
    and a ``partial`` count; everything from the page that matches ``stop`` is left out."""
    first_stop = F.min(F.when(F.col("text").rlike(stop), F.col("page_no"))).over(Window.partitionBy("doc"))
    kept = pages.withColumn("_s", first_stop).where(F.col("_s").isNull() | (F.col("page_no") < F.col("_s")))
    lines = kept.select("doc", "page_no", F.posexplode(F.split("text", "\n")).alias("no", "line")).withColumn("line", F.trim("line")).where("line <> ''")
    order = ["page_no", "no"]
    bare = ~F.col("line").rlike(r"\d") & (F.lit(True) if not skip else ~F.col("line").rlike("|".join(skip)))
    lines = lines.withColumn("_prefix", F.lag(F.when(bare, F.col("line"))).over(Window.partitionBy("doc").orderBy(*order)))
    token = r"(?:[\d,]+(?:\.\d+)?|[-–—])"
    lines = carry_down(lines.withColumn("grade", F.nullif(F.regexp_extract("line", grade, 1), F.lit(""))), "grade", ["doc"], order).where(~F.col("line").rlike(grade))
    for word in skip:
        lines = lines.where(~F.col("line").contains(word))
    lines = lines.withColumn("_v", F.regexp_extract_all(F.regexp_extract("line", rf"^\D*?\s((?:{token}\s*){{3,{columns}}})$", 1), F.lit(rf"({token})"), 1))
    own = F.trim(F.regexp_extract("line", rf"^(\D*?)\s(?:{token}\s*){{3,{columns}}}$", 1))
    rows = lines.where(F.size("_v") >= 3).withColumn("name", F.concat_ws(" ", "_prefix", own))
    rows = rows.withColumn("_k", F.row_number().over(Window.partitionBy("doc", "name").orderBy(*order))).where("_k = 1")
    n = F.size("_v")
    whole = n == columns
    values = F.transform(F.when(whole, F.col("_v")).otherwise(F.slice("_v", 1, 2)), lambda x: clean_number(x))
    return rows.select("doc", "grade", "name", values.alias("values"), n.alias("n_values"), F.when(~whole, n).alias("partial"))


def parse_weekly_pair_table(pages: DataFrame, columns: list[str]) -> DataFrame:
    """Lines ``[year] week n (pct) n (pct) ...`` with exactly one pair a column to (doc, year, week, agent, n, pct).

    Rows with another number of pairs, a week outside 1 to 53 or a pct outside 0 to 100 go; a year carries down."""
    lines = pages.select("doc", F.posexplode(F.split("text", "\n")).alias("no", "line"))
    pair = r"([\d,]+)\s*\(([\d.]+)\)"
    rows = lines.withColumn("year", F.regexp_extract("line", r"^\s*(\d{4})\s+\d{1,2}\s", 1).try_cast("int")).withColumn("week",
        F.regexp_extract("line", r"^\s*(?:\d{4}\s+)?(\d{1,2})\s", 1).try_cast("int"))
    rows = carry_down(rows, "year", ["doc"], ["no"]).withColumn("_n", F.regexp_extract_all("line", F.lit(pair), 1)).withColumn("_p",
        F.transform(F.regexp_extract_all("line", F.lit(pair), 2), lambda x: x.try_cast("double")))
    rows = rows.where((F.size("_n") == len(columns)) & F.col("week").between(1, 53) & F.forall("_p", lambda p: p.between(0, 100)))
    cells = F.explode(F.arrays_zip(F.array(*map(F.lit, columns)).alias("a"), F.col("_n").alias("n"), F.col("_p").alias("p")))
    return rows.select("doc", "year", "week", cells.alias("_z")).select("doc", "year", "week", F.col("_z.a").alias("agent"),
        clean_number(F.col("_z.n"), True).alias("n"), F.col("_z.p").alias("pct"))


def parse_sentinel_indicators(pages: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """One number an indicator from a document's prose; null where the pattern doesn't match."""
    return pages.select("doc", *(clean_number(F.regexp_extract("text", p, 1)).alias(name) for name, p in patterns.items()))


def parse_listing_with_hidden(pages: DataFrame) -> DataFrame:
    """List items (label, cover, file) of each page; those inside a comment are hidden."""
    part = F.posexplode(F.split("html", r"<!--|-->"))
    items = pages.select("page_id", part.alias("_n", "_p")).select("page_id", (F.col("_n") % 2 == 1).alias("hidden"),
        F.explode(F.regexp_extract_all("_p", F.lit(r"(?is)<li\b[^>]*>(.*?)</li>"), 1)).alias("_i"))
    return items.select("page_id", "hidden", html_to_text(F.regexp_extract("_i", r"(?is)<b>(.*?)</b>", 1)).alias("label"),
        F.regexp_extract("_i", r'(?i)<img[^>]*src="([^"]*)"', 1).alias("cover"),
                        F.nullif(F.regexp_extract("_i", r'(?i)<a[^>]*href="([^"]*)"', 1), F.lit("")).alias("file"))


def report_header(pages: DataFrame, needles: list[str], excluded: list[str]) -> DataFrame:
    """Per document: volume, number and date of the first page, and the first page with all needles and nothing excluded."""
    fits = F.lit(True)
    for w in needles:
        fits = fits & F.col("text").contains(w)
    for w in excluded:
        fits = fits & ~F.col("text").contains(w)
    first = pages.groupBy("doc").agg(F.min_by("text", "page_no").alias("_t"), F.min(F.when(fits, F.col("page_no"))).alias("page"))
    read = lambda p: F.regexp_extract("_t", p, 1)
    return first.select("doc", read(r"(?i)vol(?:ume)?\.?\s*(\d+)").try_cast("int").alias("volume"),
        read(r"(?i)\bno\.?\s*(\d+)").try_cast("int").alias("number"), read(r"(\d{4}-\d{2}-\d{2})").alias("date"), "page")


def grep_pages(pages: DataFrame, word: str, limit: int) -> DataFrame:
    """Up to ``limit`` pages of each document that hold the word."""
    hits = pages.where(F.col("text").contains(word))
    return hits.withColumn("_k", F.row_number().over(Window.partitionBy("doc").orderBy("page_no"))).where(F.col("_k") <= limit).select("doc", "page_no")


def parse_specimen_rows(lines: DataFrame, containers: list[str], method: str) -> DataFrame:
    """Lines (doc, no, line) to specimens: name, when, container, amount, temp; the container word is the anchor, a
    method line and a temperature carry down."""
    anchor = "|".join(containers)
    rows = lines.withColumn("method", F.nullif(F.regexp_extract("line", method, 1), F.lit(""))).withColumn("temp",
        F.nullif(F.regexp_extract("line", r"(-?\d+\s*°C)", 1), F.lit("")))
    rows = carry_down(carry_down(rows, "method", ["doc"], ["no"]), "temp", ["doc"], ["no"])
    form = rf"^(\S+)\s+(.*?)\s*({anchor})\b(?:\s+([\d.]+\s*mL))?"
    part = lambda i: F.trim(F.regexp_extract("line", form, i))
    return rows.where(F.col("line").rlike(rf"^\S+\s.*\b(?:{anchor})\b")).select("doc", "no", "method", part(1).alias("name"), part(2).alias("when"),
        part(3).alias("container"), part(4).alias("amount"), "temp")


def split_sections(pages: DataFrame, tag: str) -> DataFrame:
    """Pages whose text matches ``tag`` start a section; (doc, section, title, first_page, last_page)."""
    title = F.nullif(F.regexp_extract("text", tag, 1), F.lit(""))
    number = F.sum(F.when(title.isNotNull(), 1).otherwise(0)).over(Window.partitionBy("doc").orderBy("page_no"))
    rows = pages.withColumn("section", number).withColumn("_t", title).where("section > 0")
    return rows.groupBy("doc", "section").agg(F.max("_t").alias("title"), F.min("page_no").alias("first_page"), F.max("page_no").alias("last_page"))


def emit_feed(items: DataFrame, n: int) -> DataFrame:
    """The newest n items as feed rows."""
    newest = items.orderBy(F.col("date").desc(), "id").limit(n)
    tags = F.when(F.size("labels") > 0, F.concat(F.lit("["), F.array_join("labels", ", "), F.lit("] "))).otherwise("")
    escape = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    title = F.concat(tags, F.col("title"))
    return newest.select("id", "date", title.alias("title"), F.concat(F.lit("<item><title>"), escape(title), F.lit("</title><pubDate>"), "date",
        F.lit("</pubDate></item>")).alias("xml"))


def emit_digest(items: DataFrame, day: str) -> DataFrame:
    """One row: the subject with the number of items first seen on the day, and their titles by source."""
    rows = items.where(F.col("first_seen") == day)
    by = rows.groupBy("source").agg(F.count("*").alias("n"))
    return by.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.array_join(F.array_sort(F.collect_list(F.concat("source", F.lit("="),
        F.col("n").cast("string")))), ",").alias("sources")).select(
        F.concat(F.lit(f"{day}: "), F.col("n").cast("string"), F.lit(" new")).alias("subject"), "n", "sources")
