"""Inflow: countries resolved, four sources assembled, rates, coverage, scenarios."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigilspark.operators.contain import contained
from vigilspark.operators.order import numbered


class Unresolved(ValueError):
    """Names that no dictionary resolves."""


def resolve_names(df: DataFrame, column: str, names: DataFrame, aliases: DataFrame, ignored: list[str], key) -> DataFrame:
    """``code`` by normalised name, then by alias; ignored labels get null and ``ignored`` true.

    ``names`` and ``aliases`` have (name, code); ``key`` normalises a column.  Of several codes of one
    normalised name the smallest is taken.  See require_resolved."""
    by_name = names.groupBy(key(F.col("name")).alias("_k")).agg(F.min("code").alias("_by_name"))
    by_alias = aliases.groupBy(key(F.col("name")).alias("_k")).agg(F.min("code").alias("_by_alias"))
    out = df.withColumn("_k", key(F.col(column))).join(by_name, "_k", "left").join(by_alias, "_k", "left")
    skip = F.col(column).isin(ignored) if ignored else F.lit(False)
    return out.withColumn("code", F.when(~skip, F.coalesce("_by_name", "_by_alias"))).withColumn("ignored", skip).drop("_k", "_by_name", "_by_alias")


def unresolved(df: DataFrame, column: str) -> DataFrame:
    return df.where("code IS NULL AND NOT ignored").groupBy(column).agg(F.count("*").alias("n_rows"))


def require_resolved(df: DataFrame, column: str) -> DataFrame:
    """``df``, or Unresolved with up to 20 names."""
    bad = [r[0] for r in unresolved(df, column).orderBy(column).limit(20).collect()]
    if bad:
        raise Unresolved(f"no code for {bad}")
    return df


def display_names(df: DataFrame, key: str, names: DataFrame, overrides: DataFrame) -> DataFrame:
    """``df`` with ``name``: the override (key, name) of an entity, else its usual name, else the key itself."""
    named = lambda of, c: of.groupBy(key).agg(F.min("name").alias(c))
    both = df.join(named(names, "_usual"), key, "left").join(named(overrides, "_override"), key, "left")
    return both.withColumn("name", F.coalesce("_override", "_usual", F.col(key).cast("string"))).drop("_usual", "_override")


def assemble_entity_table(sources: dict[str, DataFrame], key: str, home: str | None = None) -> DataFrame:
    """Full outer join of sources on ``key`` without the home entity, with a has_<source> flag each; see display_names."""
    out = None
    for name, df in sources.items():
        df = df.withColumn(f"has_{name}", F.lit(True))
        out = df if out is None else out.join(df, key, "full_outer")
    for name in sources:
        out = out.withColumn(f"has_{name}", F.coalesce(f"has_{name}", F.lit(False)))
    return out if home is None else out.where(F.col(key) != home)


def designation_match(reports: DataFrame, designations: DataFrame, scope: DataFrame) -> DataFrame:
    """(condition, country, n, hit) of the conditions in scope, misses by n first."""
    marked = designations.select("country", "condition").distinct().withColumn("hit", F.lit(True))
    return reports.join(scope, "condition", "left_semi").groupBy("country", "condition").agg(F.sum("n").alias("n")).join(marked,
        ["country", "condition"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def list_membership_flags(df: DataFrame, key: str, lists: dict[str, DataFrame]) -> DataFrame:
    for name, members in lists.items():
        df = df.join(members.select(key).distinct().withColumn(name, F.lit(True)), key, "left").withColumn(name, F.coalesce(name, F.lit(False)))
    return df


def wide_kinds_merge(df: DataFrame, keys: list[str], kinds: list[str]) -> DataFrame:
    """Rows (keys, kind, value) to one row a key with a column for each kind; a missing kind is 0."""
    return df.groupBy(*keys).agg(*(F.sum(F.when(F.col("kind") == k, F.col("value")).otherwise(0)).alias(k) for k in kinds))


def notices_mentioning(entities: DataFrame, notices: DataFrame, after: str) -> DataFrame:
    """(entity, effective, note) of the notices after a date whose note names the entity."""
    return contained(notices.where(F.col("effective") > after), entities.select("entity").distinct(), "note", "entity").select("entity", "effective", "note")


def imports_by_country(df: DataFrame) -> DataFrame:
    """Per country: n, conditions by n (desc, name), first and last (year, week)."""
    by = df.groupBy("country", "condition").agg(F.sum("n").alias("n"), F.min(F.struct("year", "week")).alias("first"), F.max(F.struct("year", "week")).alias("last"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "condition", "n"))), lambda x: F.struct(x.condition.alias("condition"), x.n.alias("n")))
    return by.groupBy("country").agg(F.sum("n").alias("n"), ordered.alias("conditions"), F.min("first").alias("first"), F.max("last").alias("last"))


def monthly_entries(df: DataFrame, low: str, high: str) -> DataFrame:
    """(country, month, n) for every month of the period, 0 where nothing is reported."""
    inside = df.where(F.col("month").between(low, high))
    months = F.transform(F.sequence(F.to_date(F.lit(low + "-01")), F.to_date(F.lit(high + "-01")), F.expr("interval 1 month")), lambda d: F.date_format(d, "yyyy-MM"))
    by = inside.groupBy("country").agg(F.map_from_entries(F.collect_list(F.struct("month", "n"))).alias("m"))
    return by.withColumn("month", F.explode(months)).select("country", "month", F.coalesce(F.try_element_at("m", F.col("month")), F.lit(0)).alias("n"))


def entry_totals(df: DataFrame, low: str, high: str) -> DataFrame:
    """(total, unmapped): entries within the period with a country, and those whose label has none; one row."""
    inside = F.when(F.col("month").between(low, high), F.col("n")).otherwise(0)
    known = F.col("country").isNotNull()
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return df.agg(total(F.when(known, inside)).alias("total"), total(F.when(~known, inside)).alias("unmapped"))


def direct_arrivals(df: DataFrame) -> DataFrame:
    """Per country: flights, total, transit, direct = total - transit, and direct by year."""
    by = df.groupBy("country", "year").agg(*(F.sum(c).alias(c) for c in ("flights", "total", "transit")))
    return by.groupBy("country").agg(*(F.sum(c).alias(c) for c in ("flights", "total", "transit")), F.sum(F.col("total") - F.col("transit")).alias("direct"),
                                     F.array_sort(F.collect_list(F.struct("year", (F.col("total") - F.col("transit")).alias("direct")))).alias("years"))


def rate_per_million(n: Column, denominator: Column) -> tuple[Column, Column]:
    """Rate to two places and its state; a zero numerator is null with a state of its own, not 0."""
    rate = F.when((n > 0) & (denominator > 0), F.round(n * 1e6 / denominator, 2))
    state = F.when(denominator.isNull() | (denominator <= 0), "no denominator").when(n.isNull() | (n == 0), "none seen").otherwise("rate")
    return rate, state


#: Buckets that a histogram of nearest_rank_bins cuts a bracket into.
_CUTS = 1024


def nearest_rank_bins(df: DataFrame, column: str, probs: list[float]) -> DataFrame:
    """(p, bound): values at index min(n - 1, int(p * n)) of the ascending non-zero values.

    Nothing is sorted: a histogram over the values' range tells which bucket holds a wanted index, and the next one cuts that
    bucket, from its smallest to its largest value, until they are equal.  A pass counts for all ``probs`` at once."""
    seen = df.where(F.col(column) > 0).select(F.col(column).alias("v"))
    n, low, high = seen.agg(F.count("*"), F.min("v"), F.max("v")).first()
    # Brackets: (p, index within the bracket, its lowest value, its highest); a row for each of ``probs``.
    open_ = [(p, min(n - 1, int(p * n)), low, high) for p in probs] if n else []
    found = []
    while open_ := [b for b in open_ if b[2] != b[3] or found.append((b[0], b[2]))]:
        ends = sorted({(b[2], b[3]) for b in open_})
        share = lambda a, b: (F.col("v").cast("double") - F.lit(float(a))) / F.lit(float(b) - float(a)) * _CUTS
        cell = F.array_compact(F.array(*(F.when(F.col("v").between(F.lit(a), F.lit(b)),
            F.struct(F.lit(i).alias("i"), F.floor(share(a, b)).cast("int").alias("cut"))) for i, (a, b) in enumerate(ends))))
        cells = seen.select("v", F.explode(cell).alias("c")).groupBy("c.i", "c.cut").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
        cells = cells.withColumn("below", F.sum("n").over(Window.partitionBy("i").orderBy("cut")) - F.col("n"))  # _CUTS + 1 rows
        wanted = [((F.col("i") == ends.index((b[2], b[3]))) & F.lit(b[1]).between(F.col("below"), F.col("below") + F.col("n") - 1), k) for k, b in enumerate(open_)]
        hits = cells.select("low", "high", "below", F.explode(F.array_compact(F.array(*(F.when(hit, F.lit(k)) for hit, k in wanted)))).alias("k")).collect()
        open_ = [(open_[h.k][0], open_[h.k][1] - h.below, h.low, h.high) for h in hits]
    return df.sparkSession.createDataFrame(found, T.StructType([T.StructField("p", T.DoubleType()), T.StructField("bound", df.schema[column].dataType)]))


def rank_flips(df: DataFrame, key: str, count: str, rate: str) -> DataFrame:
    """Rank by count, rank by rate, and their difference, largest first."""
    a = numbered(df, "by_count", [F.col(count).desc(), F.col(key)])
    b = numbered(a, "by_rate", [F.col(rate).desc_nulls_last(), F.col(key)])
    return b.withColumn("flip", F.abs(F.col("by_count") - F.col("by_rate"))).orderBy(F.col("flip").desc(), key)


def ends_by_ratio(df: DataFrame, key: str, ratio: str, denominator: str, least: float, k: int = 5) -> DataFrame:
    """The k lowest and k highest ratios among rows with enough denominator."""
    rows = df.where(F.col(denominator) > least)

    def end(name: str, *order: Column) -> DataFrame:  # the window is over the k rows of the limit
        return rows.orderBy(*order).limit(k).withColumn("place", F.row_number().over(Window.orderBy(*order))).withColumn("end", F.lit(name))
    return end("low", F.col(ratio), F.col(key)).unionByName(end("high", F.col(ratio).desc(), F.col(key)))


def coverage_counts(df: DataFrame, flags: list[str]) -> DataFrame:
    return df.agg(F.count("*").alias("rows"), *(F.count_if(f).alias(f) for f in flags))


def designation_by_entity(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("country").agg(F.sort_array(F.collect_set("condition")).alias("conditions"))


def marks_to_pairs(wide: DataFrame, key: str) -> DataFrame:
    """Wide marks (one column a category, blank = not a member) to (key, category)."""
    columns = [c for c in wide.columns if c != key]
    return wide.unpivot(key, columns, "category", "mark").where(F.trim("mark") != "").select(key, "category")


def pairs_to_marks(pairs: DataFrame, key: str, category: str, categories: list[str]) -> DataFrame:
    return pairs.groupBy(key).pivot(category, categories).agg(F.max(F.lit("x")))


def out_of_domain(df: DataFrame, column: str, domain: list[str]) -> DataFrame:
    return df.where(~F.col(column).isin(domain)).select(column).distinct()


def require_domain(df: DataFrame, column: str, domain: list[str]) -> DataFrame:
    """``df``, or ValueError with up to 20 values outside the domain."""
    bad = [r[0] for r in out_of_domain(df, column, domain).orderBy(column).limit(20).collect()]
    if bad:
        raise ValueError(f"{column} outside its domain: {bad}")
    return df


def scenario_sets(base: DataFrame, with_flights: DataFrame, reported: DataFrame, dropped: str, extra: DataFrame) -> DataFrame:
    """(scenario, country, condition): base and five variants of it; ``extra`` is crossed with the base's conditions,
    a handful of rows on both sides.  Each pair is marked with the scenarios it belongs to, in one pass."""
    there = lambda df, *keys: df.select(*keys).distinct().withColumn("_".join(("_in", *keys)), F.lit(True))
    marked = base.join(there(with_flights, "country"), "country", "left").join(there(reported, "country", "condition"), ["country", "condition"], "left")
    sets = F.array_compact(F.array(
        F.lit("base"), F.when(F.col("_in_country"), "flights"), F.when(F.col("_in_country_condition"), "reported"),
        F.when(F.col("level") == "priority", "priority"), F.when(F.col("condition") != dropped, "without")))
    pairs = base.select("country", "condition")
    conditions = pairs.agg(F.collect_set("condition").alias("_all"))  # one row
    more = pairs.union(extra.select("country").join(F.broadcast(conditions)).select("country", F.explode("_all"))).distinct()
    return marked.select(F.explode(sets).alias("scenario"), "country", "condition").union(more.select(F.lit("more"), "country", "condition"))


def scenario_diff(base: DataFrame, other: DataFrame) -> DataFrame:
    """(country, condition, change): pairs added to and removed from the base."""
    keys = ["country", "condition"]
    a, b = base.select(*keys), other.select(*keys)
    return b.join(a, keys, "left_anti").withColumn("change", F.lit("added")).unionByName(a.join(b, keys, "left_anti").withColumn("change", F.lit("removed")))


def scenario_gains(scenarios: DataFrame, base: DataFrame, entities: DataFrame) -> DataFrame:
    """(scenario, added, removed, new_countries, new_direct): pairs against the base, and the countries that the base has
    under no condition with their passengers, each country once."""
    keys = ["country", "condition"]
    pairs = scenarios.select("scenario", *keys).distinct()
    in_base = base.select(*keys).distinct()
    size = in_base.agg(F.count("*").alias("_size"))  # one row
    marked = pairs.join(in_base.withColumn("_in", F.lit(True)), keys, "left").join(in_base.select("country").distinct().withColumn("_known", F.lit(True)), "country", "left")
    by_country = marked.groupBy("scenario", "country").agg(F.count("*").alias("pairs"), F.count("_in").alias("common"), F.bool_or(F.col("_known").isNull()).alias("new"))
    direct = F.sum(F.when(F.col("new"), F.col("direct")))
    per = by_country.join(entities.select("country", "direct"), "country", "left").groupBy("scenario").agg(
        F.sum(F.col("pairs") - F.col("common")).alias("added"), F.sum("common").alias("_common"), F.count_if("new").alias("new_countries"),
            F.coalesce(direct, F.lit(0)).alias("new_direct"))
    return per.join(F.broadcast(size)).select("scenario", "added", (F.col("_size") - F.col("_common")).alias("removed"), "new_countries", "new_direct")


def entity_list(scenarios: DataFrame, entities: DataFrame) -> DataFrame:
    """(scenario, condition, countries): all countries of ``entities`` (country, direct, entries), the designated ones first,
    then by passengers and by entries.  ``entities`` is a table of countries and goes to every task as one row."""
    order = F.struct((-F.coalesce("direct", F.lit(0))).alias("d"), (-F.coalesce("entries", F.lit(0))).alias("e"), "country")
    every = entities.agg(F.transform(F.array_sort(F.collect_list(order)), lambda x: x.country).alias("_all"))
    per = scenarios.groupBy("scenario", "condition").agg(F.collect_set("country").alias("_on"))
    first = F.filter("_all", lambda c: F.array_contains("_on", c))
    return per.join(F.broadcast(every)).select("scenario", "condition", F.concat(first, F.array_except("_all", "_on")).alias("countries"))


def scenario_metrics(scenarios: DataFrame, reports: DataFrame, entities: DataFrame) -> DataFrame:
    """One row a scenario; each country's passengers count once in it."""
    covered = reports.groupBy("country", "condition").agg(F.sum("n").alias("n"))
    by_country = scenarios.join(covered, ["country", "condition"], "left").groupBy("scenario", "country").agg(
        F.count("*").alias("pairs"), F.sum("n").alias("covered_n"), F.count("n").alias("covered_pairs"))
    none = lambda c: F.coalesce(F.sum(c), F.lit(0))
    by_scenario = by_country.join(entities, "country", "left").groupBy("scenario").agg(
        F.sum("pairs").alias("pairs"), none("covered_n").alias("covered_n"), F.sum("covered_pairs").alias("covered_pairs"),
        F.count("*").alias("countries"), none("direct").alias("direct"), F.count_if(F.col("direct").isNull()).alias("without_flights"))
    total = covered.agg(F.sum("n").alias("total"))  # one row
    return by_scenario.join(F.broadcast(total)).select(
        "*", F.round(100.0 * F.col("covered_n") / F.col("total"), 2).alias("covered_share"),
        F.round(F.try_divide(F.col("covered_n") * 1e6, F.col("direct")), 2).alias("covered_per_million")).drop("total")


def scenario_by_condition(scenarios: DataFrame, base: DataFrame, reports: DataFrame) -> DataFrame:
    """(scenario, condition): designated countries against the base, reported n and the part that is covered."""
    pairs = scenarios.groupBy("scenario", "condition").agg(F.count("*").alias("designated"))
    in_base = base.groupBy("condition").agg(F.count("*").alias("in_base"))
    n = reports.groupBy("country", "condition").agg(F.sum("n").alias("n"))
    reported = n.groupBy("condition").agg(F.sum("n").alias("reported_n"))
    covered = scenarios.join(n, ["country", "condition"]).groupBy("scenario", "condition").agg(F.sum("n").alias("covered_n"))
    return pairs.join(in_base, "condition", "left").join(reported, "condition", "left").join(covered, ["scenario", "condition"], "left").na.fill(0,
        ["in_base", "reported_n", "covered_n"])


def top_entities(df: DataFrame, metric: str, key: str, k: int) -> DataFrame:
    return df.orderBy(F.col(metric).desc(), key).limit(k)
