"""Series of editions, yearly tables, coverage, exhibits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilspark.operators.order import numbered, stored


def series_rollup(docs: DataFrame, default_field: str) -> DataFrame:
    """Per series: editions (newest first), first and last year, and the field that more than half of them have.

    ``docs`` has series, doc, year, posted, title, field.  An empty series key stands for the document itself."""
    key = F.when(F.col("series") == "", F.concat(F.lit("#"), F.col("doc").cast("string"))).otherwise(F.col("series"))
    keyed = docs.withColumn("series", key)
    fields = keyed.groupBy("series", "field").agg(F.count("*").alias("_n"))
    major = fields.groupBy("series").agg(F.max_by("field", "_n").alias("_f"), F.max("_n").alias("_m"), F.sum("_n").alias("_t"))
    edition = F.struct((-F.col("year")).alias("k"), F.col("posted"), "title", "doc")
    rolled = keyed.groupBy("series").agg(F.count("*").alias("editions"), F.min("year").alias("first_year"), F.max("year").alias("last_year"),
                                         F.max_by("doc", F.struct("year", "posted", "doc")).alias("latest"), F.array_sort(F.collect_list(edition)).alias("edition_list"))
    return rolled.join(major, "series").withColumn("field", F.when(2 * F.col("_m") > F.col("_t"), F.col("_f")).otherwise(default_field)).drop("_f", "_m", "_t")


def latest_per_series(docs: DataFrame, this_year: int, kinds: list[str], k: int) -> DataFrame:
    """Newest edition of each series (entity, series, kind, year, doc), stale if older than last year; by kind, then
    year, the first k of each entity."""
    newest = docs.groupBy("entity", "series").agg(F.max_by(F.struct("doc", "year", "kind"), F.struct("year", "doc")).alias("_d")).select("entity", "series", "_d.*")
    rank = F.coalesce(*(F.when(F.col("kind") == name, F.lit(i)) for i, name in enumerate(kinds)), F.lit(len(kinds)))
    place = F.row_number().over(Window.partitionBy("entity").orderBy(rank, F.col("year").desc(), "doc"))
    return newest.withColumn("stale", F.col("year") < this_year - 1).withColumn("place", place).where(F.col("place") <= k)


def facet_counts(df: DataFrame, a: str, b: str) -> DataFrame:
    """Counts by ``a``, by ``b`` and overall; the facet that is not counted by is null."""
    return df.groupingSets([[F.col(a)], [F.col(b)], []], a, b).agg(F.count("*").alias("n"))


def totals_with_exclusion(df: DataFrame, group: str, excluded: str) -> DataFrame:
    return df.groupBy(group).agg(F.sum("value").alias("total"), F.sum(F.when(F.col("entity") != excluded, F.col("value")).otherwise(0)).alias("without"))


def unstable_denominators(df: DataFrame, factor: float = 2) -> DataFrame:
    """Series whose largest value is ``factor`` times the smallest or more, over values above 0."""
    return df.where("value > 0").groupBy("entity").agg(F.min("value").alias("least"), F.max("value").alias("most")).where(F.col("most") >= factor * F.col("least"))


def yoy_surges(df: DataFrame, min_previous: float = 5, min_current: float = 100, ratio: float = 3) -> DataFrame:
    """Years with ``ratio`` times the year before or more, with an exhibit weight."""
    window = Window.partitionBy("entity").orderBy("year")
    last = F.when(F.lag("year").over(window) == F.col("year") - 1, F.lag("value").over(window))
    rows = df.withColumn("previous", last).where((F.col("previous") >= min_previous) & (F.col("value") >= min_current))
    rows = rows.withColumn("ratio", F.col("value") / F.col("previous")).where(F.col("ratio") >= ratio)
    return rows.withColumn("weight", F.round(F.least(F.lit(96.0), 68 + 12 * F.log10("ratio")), 4)).withColumn("ratio", F.round("ratio", 4))


def year_leader(df: DataFrame, surges: DataFrame) -> DataFrame:
    """Per year the largest value among entities that didn't surge that year; the first name on ties."""
    return df.join(surges.select("entity", "year"), ["entity", "year"], "left_anti").groupBy("year").agg(
        F.min_by(F.struct("entity", "value"), F.struct((-F.col("value")).alias("k"), "entity")).alias("_b")).select("year", "_b.*")


def first_appearances(docs: DataFrame, min_editions: int = 3) -> DataFrame:
    """First edition of each long series, with an exhibit weight."""
    rows = docs.groupBy("series").agg(F.count("*").alias("editions"), F.min_by(F.struct("doc", "year"),
        F.struct("year", "doc")).alias("_d")).where(F.col("editions") >= min_editions)
    return rows.select("series", "editions", "_d.*", F.least(F.lit(84), 52 + 2 * F.col("editions")).alias("weight"))


def busy_years(docs: DataFrame, least: int = 30) -> DataFrame:
    return docs.groupBy("year").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def edition_diff(df: DataFrame, key: str) -> DataFrame:
    """Items (key, edition, item) of each edition that the one before lacked; empty for the first."""
    sets = df.groupBy(key, "edition").agg(F.collect_set("item").alias("items"))
    before = F.lag("items").over(Window.partitionBy(key).orderBy("edition"))
    return sets.withColumn("added", F.when(before.isNotNull(), F.array_sort(F.array_except("items", before))).otherwise(F.array().cast("array<string>"))).drop("items")


def coverage_matrix(df: DataFrame, years: list[int]) -> DataFrame:
    """age x vaccine x year; anomalous cells are left out and missing ones null."""
    return df.where("anomaly IS NULL").groupBy("vaccine", "age").pivot("year", years).agg(F.max("value"))


def latest_coverage(cells: DataFrame, done: DataFrame) -> DataFrame:
    """(vaccine, actual, actual_age, actual_year): the latest year's value at the age (``done``: vaccine, age) at which the
    vaccine's course is complete; null where that age was never measured."""
    at = cells.join(done.select("vaccine", "age"), ["vaccine", "age"]).where("value IS NOT NULL")
    latest = at.groupBy("vaccine").agg(F.max_by(F.struct("value", "year"), "year").alias("_l"))
    return done.join(latest, "vaccine", "left").select("vaccine", F.col("_l.value").alias("actual"), F.col("age").alias("actual_age"), F.col("_l.year").alias("actual_year"))


def threshold_order(df: DataFrame) -> DataFrame:
    """``df`` with ``place``: by verdict, impossible first, then the higher need first, then by vaccine."""
    return severity_order(df, "verdict", ["impossible", "under", "edge", "over", "none"], [-F.col("high"), F.col("vaccine")])


def immunity_threshold(df: DataFrame) -> DataFrame:
    """Needed coverage 100 (1 - 1/R0) / VE for both ends of R0, and the verdict on the actual one, in this order:
    impossible (the low need exceeds 100), none (nothing measured), over, edge, under."""
    need = lambda r0: F.round(100 * (1 - 1 / F.col(r0)) / F.col("ve"), 2)
    df = df.withColumn("low", need("r0_lo")).withColumn("high", need("r0_hi"))
    verdict = F.when(F.col("low") > 100, "impossible").when(F.col("actual").isNull(), "none").when(F.col("actual") >= F.col("high"),
        "over").when(F.col("actual") >= F.col("low"), "edge").otherwise("under")
    return df.withColumn("verdict", verdict)


def align_rate_and_cases(links: DataFrame, rates: DataFrame, cases: DataFrame) -> DataFrame:
    """Per condition the linked vaccine with the longest series; its rate in every year with cases, and the peak year's."""
    length = rates.groupBy("vaccine").agg(F.countDistinct("year").alias("_y"))
    chosen = links.join(length, "vaccine").groupBy("condition").agg(F.min_by("vaccine", F.struct((-F.col("_y")).alias("k"), "vaccine")).alias("vaccine"))
    rows = cases.join(chosen, "condition").join(rates, ["vaccine", "year"], "left")
    return rows.groupBy("condition", "vaccine").agg(F.count("*").alias("years"), F.count("rate").alias("with_rate"),
        F.min_by(F.struct("year", "rate"), F.struct((-F.col("n")).alias("k"), "year")).alias("_p")).select(
        "condition", "vaccine", "years", "with_rate", F.col("_p.year").alias("peak_year"), F.col("_p.rate").alias("peak_rate"))


def lowest_per_year(df: DataFrame) -> DataFrame:
    return df.groupBy("year").agg(F.min_by(F.struct("age", "value"), F.struct("value", "age")).alias("_l")).select("year", "_l.*")


def event_history(sources: dict[str, DataFrame]) -> DataFrame:
    """Typed events under one schema; columns that a source lacks are null."""
    out = None
    for theme, df in sources.items():
        df = df.withColumn("theme", F.lit(theme))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def break_aware_compare(series: DataFrame, breaks: DataFrame, pairs: DataFrame) -> DataFrame:
    """Two years of an entity: not comparable over a break, caution with a partial side, missing with an absent one."""
    side = lambda n: series.select("entity", F.col("year").alias(f"y{n}"), F.col("value").alias(f"v{n}"), F.col("partial").alias(f"p{n}"))
    per = breaks.groupBy("entity").agg(F.collect_set("year").alias("_breaks"))
    rows = pairs.join(side(1), ["entity", "y1"], "left").join(side(2), ["entity", "y2"], "left").join(per, "entity", "left")
    broken = F.coalesce(F.exists("_breaks", lambda b: (b > F.col("y1")) & (b <= F.col("y2"))), F.lit(False))
    verdict = F.when(F.col("v1").isNull() | F.col("v2").isNull(), "missing").when(broken, "not comparable").when(F.col("p1") | F.col("p2"), "caution").otherwise("comparable")
    return rows.select("entity", "y1", "y2", "v1", "v2", verdict.alias("verdict"))


def edition_files(labels: DataFrame, bodies: list[tuple[int, str]] = ()) -> DataFrame:
    """File labels to editions: year or span and kind from the label; files, hidden and downloadable counts, the files that
    can be downloaded as (kind, file), and the issuing body: the last of ``bodies`` (first year, name) that had begun."""
    lower = F.lower("label")
    rows = labels.select("*", F.regexp_extract("label", r"((?:19|20)\d\d)", 1).try_cast("int").alias("year"),
                         F.regexp_extract("label", r"(?:19|20)\d\d\s*[-~]\s*((?:19|20)\d\d)", 1).try_cast("int").alias("until"),
                         F.when(lower.contains("english"), "english").when(lower.contains("text"), "text").otherwise("main").alias("kind"))
    body = F.coalesce(*(F.when(F.col("year") >= since, F.lit(name)) for since, name in sorted(bodies, reverse=True)), F.lit(None).cast("string"))
    links = F.array_sort(F.collect_list(F.when(F.col("file") != "", F.struct("kind", "file"))))
    return rows.groupBy("year", "until").agg(body.alias("body"), links.alias("links"), F.count("*").alias("files"),
        F.count_if("hidden").alias("hidden"), F.count_if(F.col("file") != "").alias("downloadable"),
                                             F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"))


def coalesce_same_stem(files: DataFrame) -> DataFrame:
    """Files (place, name, rows, note) of one stem as one entry: first reported rows, longest note, formats in order."""
    rows = files.withColumn("stem", F.regexp_replace("name", r"\.[^.]+$", "")).withColumn("_f", F.regexp_extract("name", r"\.([^.]+)$", 1))
    return rows.groupBy("stem").agg(F.min("place").alias("place"), F.min_by("rows", F.when(F.col("rows").isNotNull(), F.col("place"))).alias("rows"),
                                    F.max_by("note", F.struct(F.length("note"), "note")).alias("note"),
                                    F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "_f"))), lambda x: x["_f"]), ",").alias("formats"))


def quota_top_k(df: DataFrame, group: str, theme: str, k: int = 10, caps: tuple[int, ...] = (3, 5)) -> DataFrame:
    """Up to k rows a group by weight: first at most 3 of a theme, then up to 5, then the rest; re-ranked by weight.

    The passes add in weight order only, so a row's tier is its rank within its theme."""
    order = [F.col("weight").desc(), F.col("id")]
    in_theme = F.row_number().over(Window.partitionBy(group, theme).orderBy(*order))
    tier = F.lit(len(caps))
    for i, cap in reversed(list(enumerate(caps))):
        tier = F.when(in_theme <= cap, i).otherwise(tier)
    tiered = df.withColumn("_tier", tier)
    picked = tiered.withColumn("_p", F.row_number().over(Window.partitionBy(group).orderBy("_tier", *order))).where(F.col("_p") <= k)
    return picked.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(*order))).drop("_tier", "_p")


def fuzzy_dedup_by_weight(df: DataFrame, width: int = 24) -> DataFrame:
    """Per year keep the heaviest of titles of which one's normalised beginning contains the other's; greedy.

    Equal beginnings leave their heaviest.  A beginning meets those that it contains at its substrings, width * (width +
    1) / 2 at most, by an equi-join, so links are no more than that a beginning.  What the pass from the heaviest
    down keeps is found in rounds: a beginning without a heavier one beside it stays, and those beside it go.
    A null title counts as an empty one, which every title contains."""
    base = F.coalesce(F.substring(F.regexp_replace(F.lower("title"), r"[^\p{L}\p{N}]+", ""), 1, width), F.lit(""))
    order = F.struct((-F.col("weight")).alias("w"), "id")
    heads = stored(df.withColumn("_base", base).groupBy("year", "_base").agg(
        F.min_by(F.struct(*(F.col(c) for c in df.columns)), order).alias("_row"), F.min(order).alias("_order")), "heads")
    node = F.struct("year", "_order", F.col("_base").alias("base"))  # in this order the heavier one is the smaller struct
    size = F.length("_base")
    inner = F.array_distinct(F.concat(F.array(F.lit("")), F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(size, F.lit(1))), lambda i: F.transform(
        F.sequence(F.lit(1), F.greatest(size - i + 1, F.lit(1))), lambda n: F.substring(F.col("_base"), i, n))))))
    long = heads.select("year", node.alias("a"), F.explode(F.filter(inner, lambda s: F.length(s) < size)).alias("_part"))
    short = heads.select(F.col("year").alias("_year"), node.alias("b"), F.col("_base").alias("_part"))
    links = stored(long.join(short, (long["_part"] == short["_part"]) & F.col("year").eqNullSafe(F.col("_year"))).select(
        F.least("a", "b").alias("heavy"), F.greatest("a", "b").alias("light")), "links")
    gone = None
    while not links.isEmpty():
        # Of what is still linked, those that are nobody's lighter one stay.
        stay = links.select("heavy").join(links.select("light"), F.col("heavy") == F.col("light"), "left_anti").distinct()
        lost = stored(links.join(stay.withColumnRenamed("heavy", "_s"), F.col("heavy") == F.col("_s"), "left_semi").select("light").distinct(), "lost")
        gone = lost if gone is None else gone.union(lost)
        out = lost.withColumnRenamed("light", "_l")
        links = stored(links.join(out, F.col("light") == F.col("_l"), "left_anti").join(out, F.col("heavy") == F.col("_l"), "left_anti"), "links")
    kept = heads if gone is None else heads.join(gone, node == F.col("light"), "left_anti")
    return kept.select("_row.*")


def primary_document(df: DataFrame) -> DataFrame:
    """One document an entity by six keys: very old or superseded last, direct before group, title tier, scope
    bucket (<= 2, <= 9, more), newest year, scope."""
    bucket = F.when(F.col("scope") <= 2, 0).when(F.col("scope") <= 9, 1).otherwise(2)
    order = [F.col("old").cast("int"), (F.col("how") != "direct").cast("int"), F.col("tier"), bucket, F.col("year").desc(), F.col("scope"), F.col("doc")]
    return df.withColumn("_r", F.row_number().over(Window.partitionBy("entity").orderBy(*order))).where("_r = 1").drop("_r")


def retain_newest(items: DataFrame, keep: int = 400) -> DataFrame:
    return items.orderBy(F.col("date").desc(), F.col("first_seen").desc(), "id").limit(keep)


def severity_order(df: DataFrame, column: str, order: list[str], then: list[Column]) -> DataFrame:
    """Sorted by the place of ``column`` in ``order`` (others last), then by ``then``."""
    place = F.coalesce(*(F.when(F.col(column) == x, F.lit(i)) for i, x in enumerate(order)), F.lit(len(order)))
    return numbered(df, "place", [place, *then])


def signature_twins(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Groups of entities that the given columns don't tell apart."""
    return df.groupBy(*columns).agg(F.sort_array(F.collect_list(key)).alias("members")).where(F.size("members") > 1)


def keep_previous(new: DataFrame, old: DataFrame, key: str) -> DataFrame:
    """New rows, and the old ones that weren't seen again."""
    return new.unionByName(old.join(new.select(key), key, "left_anti").select(*new.columns))


def catalogue_reconcile(listed: DataFrame, have: DataFrame, key: str) -> DataFrame:
    """(key, state): missing, orphan or count differs; rows that agree have none."""
    a = listed.select(key, F.col("n").alias("_listed"))
    b = have.groupBy(key).agg(F.count("*").alias("_have"))
    state = F.when(F.col("_have").isNull(), "missing").when(F.col("_listed").isNull(), "orphan").when(F.col("_listed") != F.col("_have"), "count differs")
    return a.join(b, key, "full_outer").select(key, state.alias("state")).where("state IS NOT NULL")
