"""Unified search: records, hubs, scoring, intents, completion."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigilspark.operators.contain import contained


def build_search_records(axes: dict[str, DataFrame]) -> DataFrame:
    """Records of several kinds under one schema (title, year, url, ...), each with its kind."""
    out = None
    for kind, df in axes.items():
        df = df.withColumn("kind", F.lit(kind))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def build_hubs(entities: DataFrame, links: DataFrame) -> DataFrame:
    """One row an entity: its links in order of rank, and the text to search."""
    by = links.groupBy("entity").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "label"))), lambda x: x.label).alias("links"))
    return entities.join(by, "entity", "left").select("entity", F.coalesce("links", F.array().cast("array<string>")).alias("links"),
        F.lower(F.concat_ws(" ", "entity", "alias")).alias("q"))


def expand_entry_terms(terms: DataFrame) -> DataFrame:
    """A record a linked entity, or one record with none."""
    return terms.select("term", F.explode_outer("entities").alias("entity"))


def score_search(queries: DataFrame, corpus: DataFrame, k: int = 10) -> DataFrame:
    """Top k a query (query_id, q): prefix 3, contains 1, all words 1, an exact hub 5 more; then shorter, newer, id.

    Equal texts of queries are one search, and so are records of equal name: of those the newest k are enough.  A search meets the
    names of the corpus (id, name, hub, year) at its longest word; the other words are checked then."""
    q = queries.select("query_id", F.lower(F.trim("q")).alias("_q")).where("_q <> ''")
    longest = F.array_max(F.transform(F.split("_q", r"\s+"), lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    text = F.col("_t")
    words = F.forall(F.split("_q", r"\s+"), lambda w: text.contains(w))
    score = F.when(text.startswith(F.col("_q")), 3).when(text.contains(F.col("_q")), 1).when(words, 1).otherwise(0) + F.when(F.col("hub") & (text == F.col("_q")), 5).otherwise(0)
    named = corpus.select("id", "name", F.coalesce("hub", F.lit(False)).alias("hub"), "year")
    newer = [F.col("year").desc_nulls_last(), F.col("id")]
    better = [F.col("score").desc(), F.length("name")]

    def first(rows, name, place, order, *by):
        return rows.withColumn(name, place.over(Window.partitionBy(*by).orderBy(*order))).where(F.col(name) <= k)
    records = first(named, "_k", F.row_number(), newer, "name", "hub").drop("_k")
    hits = contained(named.select("name", "hub").distinct().withColumn("_t", F.lower("name")), q.select("_q").distinct().withColumn("_w", longest), "_t", "_w").where(words)
    # Names beyond the k-th have no answer, but for those that are as good as it.
    names = first(hits.select("_q", "name", "hub", score.alias("score")), "_k", F.rank(), better, "_q").drop("_k")
    best = first(names.join(records, ["name", "hub"]), "_k", F.row_number(), better + newer, "_q").drop("_k")
    return first(q.join(best, "_q"), "place", F.row_number(), better + newer, "query_id").select("query_id", "place", "id", "score")


def match_query_entities(queries: DataFrame, names: DataFrame) -> DataFrame:
    """Best entity a query by token: equal length + 10, starts with length + 5, contains (from 4 characters) length."""
    tokens = queries.select("query_id", F.explode(F.split(F.lower("q"), r"\s+")).alias("_t")).where(F.length("_t") >= 2)
    n = F.col("_n")
    score = F.when(F.col("_t") == n, F.length(n) + 10).when(F.startswith(F.col("_t"), n), F.length(n) + 5).when((F.length(n) >= 4) & F.contains(F.col("_t"), n), F.length(n))
    hits = contained(tokens, names.select("name", F.lower("name").alias("_n")).distinct(), "_t", "_n").withColumn("_s", score).where("_s IS NOT NULL")
    return hits.groupBy("query_id").agg(F.min_by(F.struct("name", "_s"), F.struct((-F.col("_s")).alias("k"), "name")).alias("_b")).select("query_id",
        F.col("_b.name").alias("name"), F.col("_b._s").alias("score"))


def parse_queries(queries: DataFrame, names: DataFrame, countries: DataFrame) -> DataFrame:
    """(query_id, name, country, year): the entity and the country that a query names best, and its first year."""
    best = lambda known, c: match_query_entities(queries, known).select("query_id", F.col("name").alias(c))
    year = F.regexp_extract("q", r"((?:19|20)\d{2})", 1).try_cast("int")
    return queries.select("query_id", year.alias("year")).join(best(names, "name"), "query_id", "left").join(best(countries, "country"), "query_id",
        "left").select("query_id", "name", "country", "year")


def route_intents(queries: DataFrame, intents: DataFrame, k: int = 3) -> DataFrame:
    """The first k distinct destinations whose words (place, word, url) the query holds; null without any."""
    hits = contained(queries.withColumn("_q", F.lower("q")), intents, "_q", "word")
    first = hits.groupBy("query_id",
        "url").agg(F.min("place").alias("place")).groupBy("query_id").agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("place", "url"))),
            lambda x: x.url), 1, k).alias("urls"))
    return queries.select("query_id").join(first, "query_id", "left")


def autocomplete(prefixes: DataFrame, corpus: DataFrame, k: int = 8) -> DataFrame:
    """Distinct names a prefix: hubs that start with it, hubs that contain it, then other records that contain it."""
    p, text = F.col("_p"), F.col("_t")
    tier = F.when(F.col("hub") & text.startswith(p), 0).when(F.col("hub"), 1).otherwise(2)
    hits = contained(corpus.withColumn("_t", F.lower("name")), prefixes.select("prefix", F.lower("prefix").alias("_p")).distinct(), "_t",
        "_p").groupBy("prefix", "name").agg(F.min(tier).alias("tier"))
    return hits.withColumn("place", F.row_number().over(Window.partitionBy("prefix").orderBy("tier", F.length("name"), "name"))).where(F.col("place") <= k)


def suggest_similar(queries: DataFrame, names: DataFrame, k: int = 6) -> DataFrame:
    """Names that hold the query's first two characters, or whose first two the query holds; by name, the first k.

    The first k names of every pair of characters are enough for that, so a pair that most names hold stays short."""
    first = lambda c: F.substring(F.lower(c), 1, 2)
    pairs = lambda c: F.array_distinct(F.concat(F.array(first(c)), F.transform(
        F.sequence(F.lit(1), F.greatest(F.length(c) - 1, F.lit(1))), lambda i: F.substring(F.lower(c), i, F.lit(2)))))

    def shortest(rows: DataFrame) -> DataFrame:
        place = F.row_number().over(Window.partitionBy("_p").orderBy("name"))
        return rows.where("_p <> ''").withColumn("_k", place).where(F.col("_k") <= k).drop("_k")
    names = names.select("name").distinct()
    inside = shortest(names.select("name", F.explode(pairs("name")).alias("_p"))).join(queries.select("query_id", first("q").alias("_p")), "_p")
    begun = shortest(names.select("name", first("name").alias("_p"))).join(queries.select("query_id", F.explode(pairs("q")).alias("_p")), "_p")
    hits = inside.select("query_id", "name").union(begun.select("query_id", "name")).distinct()
    return hits.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("name"))).where(F.col("place") <= k).select("query_id", "name", "place")


def facet_results(hits: DataFrame, kinds: list[str], cap: int = 5, hub_cap: int = 4, recognised: DataFrame | None = None) -> DataFrame:
    """Hits a query and kind with their counts, kinds in the given order, the first ``cap`` of each (hubs ``hub_cap``).

    A hub that is ``recognised`` (query_id, id, score) in a query but isn't among its hits is put before the others."""
    hits = hits.withColumn("_missed", F.lit(0))
    if recognised is not None:
        missed = recognised.join(hits.where("kind = 'hub'").select("query_id", "id"), ["query_id", "id"], "left_anti")
        hits = hits.unionByName(missed.withColumn("kind", F.lit("hub")).withColumn("_missed", F.lit(1)), allowMissingColumns=True)
    place = F.row_number().over(Window.partitionBy("query_id", "kind").orderBy(F.col("_missed").desc(), F.col("score").desc(), "id"))
    count = F.count("*").over(Window.partitionBy("query_id", "kind"))
    rank = F.coalesce(*(F.when(F.col("kind") == x, F.lit(i)) for i, x in enumerate(kinds)), F.lit(len(kinds)))
    return hits.withColumn("n", count).withColumn("place", place).withColumn("kind_rank",
        rank).where(F.col("place") <= F.when(F.col("kind") == "hub", hub_cap).otherwise(cap)).drop("_missed")
