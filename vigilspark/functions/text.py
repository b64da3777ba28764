"""Column functions that read facts out of text and HTML; patterns are arguments or plain English forms."""

from __future__ import annotations

import re
from html.entities import name2codepoint

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilspark.functions.tables import table_grids
from vigilspark.operators.contain import contained
from vigilspark.operators.spans import allocated, longest_first, occurrences

REFERENCE = r"&(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);"
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]


def html_to_text(col: Column) -> Column:
    """Scripts and styles out, tags to spaces, entities decoded, spaces squeezed."""
    return _squeezed(unescape(_untagged(col)))


def _untagged(col: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(col, r"(?is)<(script|style)\b.*?</\1\s*>", " "), r"(?s)<[^>]*>", " ")


def _squeezed(col: Column) -> Column:
    return F.trim(F.regexp_replace(col, r"[\s\u00a0]+", " "))


def _once(value: Column, then) -> Column:
    """``then(value)`` with the value computed once a row, however often ``then`` names it."""
    return F.transform(F.array(value), then)[0]


def unescape(col: Column) -> Column:
    """Character references decoded, by number or by HTML 4 name; unknown ones stay as they are."""
    names = F.create_map(*(F.lit(x) for name, code in [*name2codepoint.items(), ("apos", 39)] for x in (name, chr(code))))

    def character(ref: Column) -> Column:
        digits = F.when(F.lower(F.substring(ref, 2, 1)) == "x", F.conv(F.substring(ref, 3, 7), 16, 10)).otherwise(F.substring(ref, 2, 7))
        code = digits.try_cast("int")
        real = ((code > 0) & (code < 0xD800)) | ((code > 0xDFFF) & (code <= 0x10FFFF))
        number = F.when(ref.startswith("#") & real, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))
        return F.coalesce(number, F.try_element_at(names, ref), F.concat(F.lit("&"), ref, F.lit(";")))
    between, refs = F.split(col, REFERENCE), F.regexp_extract_all(col, F.lit(REFERENCE), 1)
    parts = F.zip_with(between, F.transform(refs, character), lambda text, mark: F.concat(F.coalesce(text, F.lit("")), F.coalesce(mark, F.lit(""))))
    return F.when(col.contains("&") & col.contains(";"), F.array_join(parts, "")).otherwise(col)


def first_sentences(col: Column, n: int, cap: int) -> Column:
    """The first n sentences (a full stop, question or exclamation mark before a capital), cut at ``cap`` characters."""
    text = F.array_join(F.slice(F.split(F.trim(col), r"(?<=[.!?])\s+(?=\p{Lu})"), 1, n), " ")
    return F.when(F.length(text) > cap, F.concat(F.rtrim(F.substring(text, 1, cap - 1)), F.lit("…"))).otherwise(text)


def extract_as_of(col: Column) -> Column:
    """'As of 7 March 2024' -> 2024-03-07; an unknown month -> empty."""
    part = lambda i: F.regexp_extract(col, r"(?i)\bas of (\d{1,2}) ([A-Za-z]+) (\d{4})", i)
    month = F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(part(2)))
    return F.when(month > 0, F.concat_ws("-", part(3), F.lpad(month.cast("string"), 2, "0"), F.lpad(part(1), 2, "0"))).otherwise("")


def _number(col: Column, pattern: str) -> Column:
    return F.regexp_replace(F.regexp_extract(col, pattern, 1), ",", "").try_cast("long")


def extract_counts(col: Column) -> Column:
    """Struct of confirmed, deaths (the 'including n deaths' form first), cfr and suspected; null where absent."""
    return F.struct(
        _number(col, r"(?i)(\d[\d,]*) (?:laboratory-)?confirmed").alias("confirmed"),
        F.coalesce(_number(col, r"(?i)including (\d[\d,]*) deaths?"), _number(col, r"(?i)(\d[\d,]*) (?:related )?deaths?")).alias("deaths"),
        F.regexp_extract(col, r"(?i)(?:CFR|case fatality (?:rate|ratio))[^0-9%]{0,12}([\d.]+)\s*%", 1).try_cast("double").alias("cfr"),
        _number(col, r"(?i)(\d[\d,]*) suspected").alias("suspected"))


def extract_notice_counts(col: Column) -> Column:
    """Struct of an outbreak notice: cases, hospitalised, deaths, states."""
    return F.struct(_number(col, r"(?i)cases:\s*(\d[\d,]*)").alias("cases"), _number(col, r"(?i)hospitali[sz]ations:\s*(\d[\d,]*)").alias("hospitalised"),
                    _number(col, r"(?i)deaths:\s*(\d[\d,]*)").alias("deaths"), _number(col, r"(?i)states:\s*(\d[\d,]*)").alias("states"))


def extract_risk(col: Column) -> Column:
    """Map of scope -> level from clauses of sentences with 'risk'; the first level of a scope wins."""
    clauses = F.flatten(F.transform(F.filter(F.split(col, r"(?<=[.!?])\s+"), lambda s: F.lower(s).contains("risk")), lambda s: F.split(s, r"[,;]| and ")))
    read = F.transform(clauses, lambda c: F.struct(
        F.coalesce(F.nullif(F.regexp_extract(F.lower(c), r"\b(global|regional|national|local)\b", 1), F.lit("")),
            F.nullif(F.regexp_replace(F.regexp_extract(F.lower(c), r"\b(globally|regionally|nationally|locally)\b", 1), "ly$", ""), F.lit(""))).alias("scope"),
        F.regexp_extract(F.lower(c), r"\b(very high|high|moderate|low)\b", 1).alias("level")))
    kept = F.filter(read, lambda r: r.scope.isNotNull() & (r.level != ""))
    first = F.filter(kept, lambda r, i: ~F.exists(F.slice(F.transform(kept, lambda k: k.scope), F.lit(1), i), lambda s: s == r.scope))
    return F.map_from_entries(first)


def extract_travel_advice(col: Column) -> Column:
    """'against' if travel or trade restrictions are advised against, 'advises' if restrictions are advised, else null."""
    text = F.lower(col)
    return F.when(text.rlike(r"(?:advises|recommends) against (?:any |the )?(?:application of )?(?:any )?travel"),
        "against").when(text.rlike(r"(?:advises|recommends) (?:any |the )?travel"), "advises")


def find_terms(df: DataFrame, column: str, glossary: DataFrame, cap: int = 14, name: str = "terms") -> DataFrame:
    """Terms of the glossary (term) in the text, longest first, whole words, no overlap, one hit each, as spelled there.

    What a longer term has taken isn't free for a shorter one; case doesn't count."""
    known = glossary.select(F.lower("term").alias("word")).distinct()
    found = occurrences(df.withColumn("_low", _lower_in_place(F.col(column))), "_low", known, "_spans")
    terms = F.transform(allocated(F.col("_spans"), longest_first, lambda s: s.word, cap), lambda s: F.substring(F.col(column), s.start + 1, s.end - s.start))
    return found.withColumn(name, terms).drop("_low", "_spans")


def _lower_in_place(text: Column) -> Column:
    """Lower case, but for the one letter that gets longer by it, so that places stay."""
    return F.lower(F.translate(text, "\u0130", "I"))


def extract_figures(col: Column, cap: int = 4) -> Column:
    """Distinct http images as (url, caption): the caption is what the text before the image says from "Figure 1." or the
    like on, else the figcaption's text, else alt.  The text before are 420 characters at most, since the last image."""
    text = lambda html: _once(_untagged(html), lambda t: _squeezed(unescape(t)))
    filled = lambda value: _once(value, lambda v: F.when(v != "", v))

    def url(part):  # a part begins within an image's tag
        return F.regexp_extract(F.regexp_extract(part, r"^([^>]*)>", 1), r'(?i)src="(https?://[^"]+)"', 1)

    def caption(before, part, first):
        said = text(F.right(F.when(first, before).otherwise(F.regexp_replace(before, r"^[^>]*>", "")), F.lit(420)))
        below = F.regexp_extract(part, r"(?is)^[^>]*>\s*<figcaption>(.*?)</figcaption>", 1)
        return F.coalesce(filled(F.trim(F.regexp_extract(said, r"((?:Figure|Fig\.|Map|Table)\s*\d+[.:].*)$", 1))), filled(text(below)),
            F.regexp_extract(F.regexp_extract(part, r"^([^>]*)>", 1), r'(?i)alt="([^"]*)"', 1))

    def figures(parts, urls):  # captions are read of the images that are kept, not of all
        wanted = F.slice(F.array_remove(F.array_distinct(urls), ""), 1, cap)
        return F.transform(wanted, lambda u: _once(F.array_position(urls, u).cast("int"), lambda i: F.struct(u.alias("url"),
            caption(parts[i - 1], parts[i], i == 1).alias("caption"))))
    return _once(F.split(col, r"(?i)<img\b"), lambda parts: _once(F.transform(F.slice(parts, F.lit(2), F.size(parts)), url), lambda urls: figures(parts, urls)))


def extract_tables(col: Column, tables: int = 2, rows: int = 14, columns: int = 8, width: int = 60, caption: int = 160) -> Column:
    """The first tables of at least two rows as (caption, rows), each row its cells' texts; spanned cells are repeated."""
    kept = F.filter(F.transform(table_grids(col), lambda t: F.struct(
        F.substring(F.coalesce(t.caption, F.lit("")), 1, caption).alias("caption"),
        F.slice(F.transform(F.filter(t.rows, lambda r: F.exists(r, lambda c: c != "")),
            lambda r: F.slice(F.transform(r, lambda c: F.substring(c, 1, width)), 1, columns)), 1, rows).alias("rows"))),
        lambda t: F.size(t["rows"]) >= 2)
    return F.slice(kept, 1, tables)


def extract_key_points(col: Column, heading: str, cap: int = 5) -> Column:
    """Texts of the list items after a heading."""
    block = F.regexp_extract(col, rf"(?is)<h\d[^>]*>\s*{heading}\s*</h\d>\s*<ul\b[^>]*>(.*?)</ul>", 1)
    return F.slice(F.transform(F.regexp_extract_all(block, F.lit(r"(?is)<li\b[^>]*>(.*?)</li>"), 1), html_to_text), 1, cap)


def extract_level(title: Column) -> Column:
    """The number of the level that a title states, else null."""
    return F.regexp_extract(title, r"(?i)\blevel\s*(\d)", 1).try_cast("int")


def extract_article_meta(col: Column, cap: int = 4) -> Column:
    """Struct of department, date, summary (two sentences) and attachment names."""
    return F.struct(
        F.trim(F.regexp_extract(col, r"(?i)<dt>Department</dt>\s*<dd>([^<]*)</dd>", 1)).alias("department"),
        F.regexp_replace(F.regexp_extract(col, r"(\d{4}[.-]\d{2}[.-]\d{2})", 1), r"\.", "-").alias("date"),
        first_sentences(html_to_text(F.regexp_extract(col, r"(?is)<div class=\"body\">(.*?)</div>", 1)), 2, 320).alias("summary"),
        F.slice(F.array_distinct(F.regexp_extract_all(col, F.lit(r'(?i)<a class="file"[^>]*>([^<]+)</a>'), 1)), 1, cap).alias("files"))


def compose_summary(confirmed: Column, deaths: Column, as_of: Column, place: Column) -> Column:
    """A sentence from the facts that are there; null without any count."""
    count = F.when(confirmed.isNotNull(), F.concat(F.format_number(confirmed, 0), F.lit(" confirmed cases")))
    dead = F.when(deaths.isNotNull(), F.concat(F.format_number(deaths, 0), F.lit(" deaths")))
    body = F.nullif(F.concat_ws(" and ", count, dead), F.lit(""))
    return F.when(body.isNotNull(), F.concat(F.concat_ws(" ", body, F.when(place != "", F.concat(F.lit("in "), place)),
        F.when(as_of != "", F.concat(F.lit("as of "), as_of))), F.lit(".")))


def parse_duration_range(col: Column) -> Column:
    """'7~21 days (usually 10~12)' -> low, high and typical ends in days; hours are divided by 24."""
    unit = F.when(F.lower(col).contains("hour"), 24.0).otherwise(1.0)
    def ends(text):
        numbers = F.transform(F.regexp_extract_all(text, F.lit(r"(\d+(?:\.\d+)?)"), 1), lambda x: x.cast("double") / unit)
        return F.get(numbers, F.lit(0)), F.coalesce(F.get(numbers, F.lit(1)), F.get(numbers, F.lit(0)))
    low, high = ends(F.regexp_replace(col, r"\([^)]*\)", ""))
    usual_low, usual_high = ends(F.regexp_extract(col, r"\([^)\d]*([\d.]+(?:\s*[~-]\s*[\d.]+)?)[^)]*\)", 1))
    return F.struct(low.alias("low"), high.alias("high"), usual_low.alias("usual_low"), usual_high.alias("usual_high"))


def counted_list(col: Column) -> Column:
    """'A(1), B(2)' -> array of (name, n)."""
    names = F.regexp_extract_all(col, F.lit(r"\s*([^,(]+?)\s*\((\d+)\)"), 1)
    numbers = F.regexp_extract_all(col, F.lit(r"\s*([^,(]+?)\s*\((\d+)\)"), 2)
    return F.zip_with(names, numbers, lambda a, b: F.struct(a.alias("name"), b.cast("int").alias("n")))


def split_outside_parens(col: Column) -> Column:
    return F.transform(F.split(col, r",(?![^(]*\))"), lambda x: F.trim(x))


def expand_keys(name: Column, aliases: Column) -> Column:
    """Search keys: name, base without brackets, bracketed acronyms, base without a common suffix, aliases; from two characters."""
    base = F.trim(F.regexp_replace(name, r"\s*\([^)]*\)", ""))
    inner = F.regexp_extract_all(name, F.lit(r"\(([A-Za-z0-9-]+)\)"), 1)
    plain = F.trim(F.regexp_replace(base, r"(?i)\s+(?:condition|virus infection|infection|syndrome|fever)$", ""))
    keys = F.concat(F.array(name, base, plain), inner, F.coalesce(aliases, F.array().cast("array<string>")))
    return F.array_distinct(F.filter(F.transform(keys, lambda k: F.lower(F.trim(k))), lambda k: F.length(k) >= 2))


def glossary_gaps(pages: DataFrame, watched: DataFrame, terms: DataFrame) -> DataFrame:
    """(word, pages, state): watched words on pages without a definition, and definitions no page uses."""
    listed = lambda df, state: df.select(F.lower("word").alias("word"), F.lit(state).alias("state"))
    every = listed(watched, "undefined").unionByName(listed(terms, "unused")).groupBy("word").agg(F.max("state").alias("state"))  # a definition counts
    used = contained(pages.select("page_id", F.lower("text").alias("_t")), every, "_t", "word", ["page_id"]).groupBy("word").agg(F.countDistinct("page_id").alias("pages"))
    found = every.join(used, "word", "left").where(F.col("pages").isNull() == (F.col("state") == "unused"))
    return found.select("word", F.coalesce("pages", F.lit(0)).alias("pages"), "state")
