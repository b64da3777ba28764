"""Column functions that clean, normalise and classify; patterns and dictionaries come from the caller."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilspark.operators.order import numbered

#: Cell texts that mean "nothing reported".
MISSING = r"^[\s\-‐-―−]*$"


def clean_number(col: Column, as_int: bool = False) -> Column:
    """'1,234' -> 1234; blanks, dashes and what isn't a number -> null."""
    text = F.regexp_replace(F.trim(col), ",", "")
    return F.when(~F.trim(col).rlike(MISSING), text).try_cast("long" if as_int else "double")


def valid_ranges(df: DataFrame, rules: dict[str, tuple[float, float]]) -> DataFrame:
    """Rows whose columns lie in their inclusive ranges."""
    for name, (low, high) in rules.items():
        df = df.where(F.col(name).between(low, high))
    return df


def flag_impossible(df: DataFrame, rules: list[tuple[str, str, float]], name: str = "anomaly") -> DataFrame:
    """Keep every row; ``anomaly`` names the first rule (measure, reason, largest) that ``value`` breaks."""
    reason = F.lit(None).cast("string")
    for measure, why, largest in reversed(rules):
        reason = F.when((F.col("measure") == measure) & (F.col("value") > largest), why).otherwise(reason)
    return df.withColumn(name, reason)


def keep_drop(df: DataFrame, column: str, keep: str | None = None, drop: str | None = None) -> DataFrame:
    """Rows that match ``keep`` and don't match ``drop``."""
    if keep:
        df = df.where(F.col(column).rlike(keep))
    return df.where(~F.col(column).rlike(drop)) if drop else df


def classify_first(col: Column, patterns: list[tuple[str, str]], default: str) -> Column:
    """Name of the first (name, pattern) that matches."""
    return F.coalesce(*(F.when(col.rlike(p), F.lit(name)) for name, p in patterns), F.lit(default))


def classify_multi(df: DataFrame, column: str, patterns: list[tuple[str, str]], name: str = "group") -> DataFrame:
    """A row for each (name, pattern) that matches; rows that match none go."""
    hits = F.filter(F.array(*(F.when(F.col(column).rlike(p), F.lit(g)) for g, p in patterns)), lambda x: x.isNotNull())
    return df.withColumn(name, F.explode(hits))


def classify_keywords(col: Column, strong: list[str], weak: list[str], strong_class: str, weak_class: str, default: str) -> Column:
    """Any strong word decides, else any weak one."""
    def has(words):
        hit = F.lit(False)
        for w in words:
            hit = hit | col.contains(w)
        return hit
    return F.when(has(strong), strong_class).when(has(weak), weak_class).otherwise(default)


#: What each matching profile strips before comparing.
PROFILES = {
    "spaces": r"\s+",
    "brackets": r"[\s()\[\]{}]+",
    "marks": r"[\s()\[\]{}·\-_‐–—/,.]+",
    "alnum": r"[^\p{L}\p{N}]+",
}


def norm_key(col: Column, profile: str = "marks") -> Column:
    """Key for matching names: the profile's characters removed, lower case."""
    return F.lower(F.regexp_replace(col, PROFILES[profile], ""))


def series_key(title: Column) -> Column:
    """Editions of one title share it: brackets, years, edition words and punctuation removed."""
    key = F.regexp_replace(title, r"[(\[][^)\]]*[)\]]", " ")
    key = F.regexp_replace(F.lower(key), r"(?:19|20)\d\d|\b(?:\d+(?:st|nd|rd|th)\s+)?(?:edition|ed|revised|rev|version|ver)\b\.?|\bv?\d+(?:\.\d+)+\b", " ")
    return F.regexp_replace(key, r"[^\p{L}\p{N}]+", "")


def series_title(title: Column) -> Column:
    """Display title: only a leading year and a trailing edition go."""
    return F.trim(F.regexp_replace(F.regexp_replace(title, r"^\s*(?:19|20)\d\d\s*", ""), r"(?i)\s*[(\[]?(?:\d+(?:st|nd|rd|th)\s+)?edition[)\]]?\s*$", ""))


def plausible_year(title: Column, date: Column, low: int, high: int) -> Column:
    """First four-digit year of the title within the bounds, else the date's year, else 0."""
    years = F.filter(F.transform(F.regexp_extract_all(title, F.lit(r"(?<!\d)(\d{4})(?!\d)"), 1), lambda x: x.cast("int")), lambda y: y.between(low, high))
    return F.coalesce(F.get(years, F.lit(0)), F.substring(date, 1, 4).try_cast("int"), F.lit(0))


def infer_week_year(week: Column, base_week: Column, base_year: Column) -> Column:
    """A week without a year: far past the base week means the year before."""
    return F.when(week > base_week + 6, base_year - 1).otherwise(base_year)


def canonical_name(df: DataFrame, column: str, mapping: DataFrame) -> DataFrame:
    """Replace spelling variants by ``mapping`` (variant, canonical); the original stays in ``<column>_raw``."""
    known = mapping.select(F.col("variant").alias(column), F.col("canonical").alias("_canonical"))
    return df.join(known, column, "left").withColumn(f"{column}_raw", F.col(column)).withColumn(column, F.coalesce("_canonical", column)).drop("_canonical")


def period_filter(df: DataFrame, column: str, low: str, high: str) -> DataFrame:
    return df.where(F.col(column).between(low, high))


def pack_code(url: Column, prefix: str, mark: str) -> Column:
    """URLs that are ``prefix`` and a number become ``mark`` and the number; others stay."""
    number = F.regexp_extract(url, "^" + prefix.replace(".", r"\.").replace("?", r"\?") + r"(\d+)$", 1)
    return F.when(number != "", F.concat(F.lit(mark), number)).otherwise(url)


def unpack_code(code: Column, prefix: str, mark: str) -> Column:
    return F.when(code.rlike(f"^{mark}\\d+$"), F.concat(F.lit(prefix), F.substring(code, len(mark) + 1, 1 << 20))).otherwise(code)


def dictionary_encode(df: DataFrame, column: str, name: str) -> DataFrame:
    """The place of each value in the sorted list of distinct values, from 0."""
    words = df.where(F.col(column).isNotNull()).select(column).distinct()
    coded = numbered(words, name, [F.col(column)]).withColumn(name, F.col(name) - 1)
    return df.join(coded, column, "left")


def faceted_filter(df: DataFrame, kinds: list[str] | None, fields: list[str] | None, newest: str | None, this_year: int, words: list[str]) -> DataFrame:
    """AND of facets over series rows (kind, field, last_year, titles); a word may be in any edition's title."""
    if kinds:
        df = df.where(F.col("kind").isin(kinds))
    if fields:
        df = df.where(F.col("field").isin(fields))
    if newest:
        current = F.col("last_year") >= this_year - 1
        df = df.where(current if newest == "current" else ~current)
    for w in words:
        df = df.where(F.exists("titles", lambda t: F.lower(t).contains(w.lower())))
    return df
