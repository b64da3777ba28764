"""A stored index for search and completion: suffixes in sorted ranges, postings in blocks, best first.

Two tables below a folder, each delivery of records in a partition of its own:

* ``dictionary``: (suffix, term, start, lists) for every suffix of every word of a name, so that "contains" is a range
  of suffixes.  Suffixes lie in ``SLICES`` ranges by their first bytes, cut once when the index is created.
  ``lists`` says for each list of the term how many records it has and how short the shortest name of each tier is.
* ``postings``: (term, first, hub, block, docs), ``BLOCK`` records a block, shortest names first, a row for each length in a block.  ``first`` lists hold
  the records whose name begins with the term.  Blocks lie in tiers of 1, 7, 56, 448 ... blocks.

A search reads the slices of the dictionary that its words fall into, takes each query's rarest word, and reads the
postings tier by tier, in each round only for the queries whose k-th best answer a shorter or better one may
still replace, by the bounds of the lists' next tiers.  Nothing else of the corpus is read, and no answer is
missed: the last round reads what is left.  Ids of a new delivery must be new."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SLICES = 64
BLOCK = 128
#: Blocks of a tier are so many times those of all tiers before it.
GROWTH = 7
#: Blocks of a list that are written to one file of a tier.
FILE = 512
#: Words meet suffixes at their first characters: a word at the longest of these lengths that it has.
HEADS = (8, 4, 2, 1)
_MAX_BROADCAST_BYTES = 8 << 20


def _lead(text: Column, filler: str = "0") -> Column:
    """The first seven bytes as a number; with filler F the largest number of what begins so."""
    return F.conv(F.rpad(F.hex(F.substring(text.cast("binary"), 1, 7)), 14, filler), 16, 10).cast("double")


def _slice(lead: Column, cuts: list[float]) -> Column:
    return F.coalesce(F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= lead)), F.lit(0)) if cuts else F.lit(0)


def _terms(records: DataFrame) -> DataFrame:
    """(term, first, hub, name, length, year, id): the distinct words of every name."""
    words = F.array_distinct(F.filter(F.split(F.lower("name"), r"\s+"), lambda w: w != ""))
    return records.select("id", "name", F.coalesce("hub", F.lit(False)).alias("hub"), "year", F.length("name").alias("length"), F.explode(words).alias("term")).withColumn(
        "first", F.startswith(F.lower("name"), F.col("term")))


def _suffixes(term: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(term)), lambda i: F.struct(F.substring(term, i, F.length(term)).alias("suffix"), (i == 1).alias("start")))


def _tier(block: Column) -> Column:
    return F.ceil(F.log(GROWTH + 1.0, block + 1) - 1e-9).cast("int")


def create_index(records: DataFrame, path: str, slices: int = SLICES) -> None:
    """Cut the ranges by the suffixes of ``records`` (id, name, hub, year) and write them as the first delivery."""
    terms = _terms(records).select("term").distinct()
    leads = terms.select(F.explode(_suffixes(F.col("term"))).alias("s")).select(_lead(F.col("s.suffix")).alias("lead"))
    cuts = leads.agg(F.percentile_approx("lead", [i / slices for i in range(1, slices)], 100 * slices).alias("cuts"))
    cuts.select(F.coalesce(F.array_distinct("cuts"), F.array().cast("array<double>")).alias("cuts")).write.parquet(f"{path}/cuts")
    add_delivery(records, path, 0)


def _cuts(spark: SparkSession, path: str) -> list[float]:
    return list(spark.read.parquet(f"{path}/cuts").first()[0])  # fewer than the slices


def add_delivery(records: DataFrame, path: str, delivery: int) -> None:
    """Add records with new ids; nothing that is there is read or written again, a repeated delivery replaces itself."""
    cuts = _cuts(records.sparkSession, path)
    listed = _terms(records)
    # Pieces of a list by length first, so that a word in every name is no single window.
    piece = ["term", "first", "hub", "length"]
    before = F.coalesce(F.sum("n").over(Window.partitionBy("term", "first", "hub").orderBy("length").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = listed.groupBy(*piece).agg(F.count("*").alias("n")).withColumn("before", before)
    place = F.col("before") + F.row_number().over(Window.partitionBy(*piece).orderBy("id")) - 1
    block = F.floor(place / BLOCK)
    docs = F.sort_array(F.collect_list(F.struct("length", "id", "year", "name"))).alias("docs")
    # A block's records of one length are a row, so that the rows of a piece stay where they were placed.
    blocks = listed.join(sizes.drop("n"), piece).withColumn("block", block).groupBy(*piece, "block").agg(docs).drop("length")
    blocks = blocks.withColumn("tier", _tier(F.col("block"))).withColumn("slice", _slice(_lead(F.col("term")), cuts))
    blocks.repartition("slice", "tier", F.floor(F.col("block") / FILE)).sortWithinPartitions("slice", "tier", "term").write.mode("overwrite").partitionBy("slice",
        "tier").parquet(f"{path}/postings/delivery={delivery}")
    # What a piece has in each tier follows from its place and size.
    low, high = (F.when(t >= 0, F.pow(F.lit(GROWTH + 1.0), t) * BLOCK).otherwise(0).cast("long") for t in (F.col("tier") - 1, F.col("tier")))
    shares = sizes.withColumn("tier", F.explode(F.sequence(*(_tier(F.floor(x / BLOCK)) for x in (F.col("before"), F.col("before") + F.col("n") - 1)))))
    shares = shares.withColumn("n", F.least(F.col("before") + F.col("n"), high) - F.greatest(F.col("before"), low))
    tiers = shares.groupBy("term", "first", "hub", "tier").agg(F.sum("n").alias("n"), F.min("length").alias("shortest"))
    lists = tiers.groupBy("term").agg(F.sort_array(F.collect_list(F.struct("first", "hub", "tier", "n", "shortest"))).alias("lists"))
    rows = lists.select("term", "lists", F.explode(_suffixes(F.col("term"))).alias("s")).select("s.suffix", "term", "s.start", "lists")
    rows.withColumn("slice", _slice(_lead(F.col("suffix")), cuts)).repartition("slice").sortWithinPartitions("slice",
        "suffix").write.mode("overwrite").partitionBy("slice").parquet(
        f"{path}/dictionary/delivery={delivery}")


def _head(word: Column, each) -> Column:
    return F.coalesce(*(F.when(F.length(word) >= n, each(n)) for n in HEADS))


def matching_terms(words: DataFrame, path: str) -> DataFrame:
    """(word, delivery, term, start, lists) of the terms that contain a word; ``start``: that begin with it.

    Only the slices that the words fall into are read."""
    spark = words.sparkSession
    cuts = _cuts(spark, path)
    words = words.where(F.length("word") > 0).select("word").distinct().withColumn("size", F.octet_length("word"))
    spans = words.select("size", _head(F.col("word"), F.lit).alias("n"), F.explode(F.sequence(_slice(_lead(F.col("word")), cuts),
        _slice(_lead(F.col("word"), "F"), cuts))).alias("slice"))
    seen = spans.agg(F.collect_set("slice"), F.collect_set("n"), F.coalesce(F.sum("size"), F.lit(0))).first()  # slices, lengths of heads, bytes
    entries = spark.read.parquet(f"{path}/dictionary").where(F.col("slice").isin(seen[0]))
    heads = F.array(*(F.when(F.length("suffix") >= n, F.struct(F.lit(n).alias("n"), F.substring("suffix", 1, n).alias("head"))) for n in (seen[1] or [1])))
    entries = entries.withColumn("h", F.explode(F.array_compact(heads))).select("delivery", "suffix", "term", "start", "lists", "h.*")
    asked = words.select("word", _head(F.col("word"), F.lit).alias("n"), _head(F.col("word"), lambda n: F.substring("word", 1, n)).alias("head"))
    asked = F.broadcast(asked) if seen[2] <= _MAX_BROADCAST_BYTES else asked
    found = entries.join(asked, ["n", "head"]).where(F.startswith(F.col("suffix"), F.col("word")))
    return found.groupBy("word", "delivery", "term").agg(F.bool_or("start").alias("start"), F.first("lists").alias("lists"))


def _answers(queries: DataFrame, path: str, scratch: str, k: int, score: Column, order: list[Column], bound, same: str) -> DataFrame:
    """The k best of each query (query_id, q, word) among the records whose name has its words.

    ``score`` of a record (name, hub, ...), larger first, then ``order``, which begins with the name's length; ``same`` tells
    answers apart.  ``bound(entry)``: the best score that the rest of a list may have."""
    spark = queries.sparkSession
    q = queries.select("query_id", "q", F.explode(F.array_distinct(F.filter(F.split("q", r"\s+"), lambda w: w != ""))).alias("word"))
    known = matching_terms(q, path)
    records = F.aggregate("lists", F.lit(0).cast("long"), lambda n, e: n + e["n"])
    known.write.parquet(f"{scratch}/terms")
    known = spark.read.parquet(f"{scratch}/terms")
    # A word without a term is the rarest: its query has no answer.
    counts = known.withColumn("r", records).groupBy("word").agg(F.sum("r").alias("r"))
    rarest = q.join(counts, "word", "left").groupBy("query_id", "q").agg(F.min_by("word", F.struct(F.coalesce("r", F.lit(0)), "word")).alias("word"))
    open_lists = rarest.join(known, "word").withColumn("e", F.explode("lists")).select("query_id", "q", "word", "delivery", "term", "start", "e.*")
    open_lists.write.parquet(f"{scratch}/lists")
    lists = spark.read.parquet(f"{scratch}/lists")
    last = lists.agg(F.max("tier")).first()[0]
    columns = [same, "id", "name", "hub", "year", "length"]
    best = None
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), *order))
    for tier in range((last or 0) + 1):
        asked = lists.where(F.col("tier") == tier)
        if best is not None:
            # Open: fewer than k answers, or a list whose next tiers may hold a better one than the k-th.
            kth = best.where(F.col("place") == k).select("query_id", F.col("score").alias("kth"), F.col("length").alias("kth_length"))
            rest = lists.where(F.col("tier") >= tier).withColumn("bound", bound).join(kth, "query_id", "left")
            better = F.col("kth").isNull() | (F.col("bound") > F.col("kth")) | ((F.col("bound") == F.col("kth")) & (F.col("shortest") <= F.col("kth_length")))
            asked = asked.join(rest.where(better).select("query_id").distinct(), "query_id", "left_semi")
            asked.write.parquet(f"{scratch}/asked{tier}")
            asked = spark.read.parquet(f"{scratch}/asked{tier}")
            if asked.isEmpty():
                continue
        slices = [r[0] for r in asked.select(_slice(_lead(F.col("term")), _cuts(spark, path)).alias("s")).distinct().collect()]  # at most SLICES
        blocks = spark.read.parquet(f"{path}/postings").where((F.col("tier") == tier) & F.col("slice").isin(slices)).select("delivery", "term", "first", "hub", "docs")
        read = asked.select("query_id", "q", "delivery", "term", "first", "hub").distinct().join(blocks, ["delivery", "term", "first", "hub"])
        hits = read.select("query_id", "q", "hub", F.explode("docs").alias("d")).select("query_id", "q", "hub", "d.*")
        text = F.lower("name")
        hits = hits.where(F.forall(F.split("q", r"\s+"), lambda w: text.contains(w))).withColumn("score", score).where("score IS NOT NULL")
        found = hits.select("query_id", "score", *dict.fromkeys(columns))
        found = found if best is None else found.unionByName(best.drop("place"))
        # Equal answers count once, with their best score.
        once = found.groupBy("query_id", same).agg(F.min_by(F.struct(*(c for c in found.columns if c not in ("query_id", same))),
            F.struct((-F.col("score")).alias("s"), "length", "id")).alias("r")).select("query_id", same, "r.*")
        once.withColumn("place", place).where(F.col("place") <= k).write.parquet(f"{scratch}/best{tier}")
        best = spark.read.parquet(f"{scratch}/best{tier}")
    return best


def search_index(queries: DataFrame, path: str, scratch: str, k: int = 10) -> DataFrame:
    """score_search over a stored index: (query_id, place, id, score).  ``scratch`` is a new folder for its rounds.

    Equal texts are one search."""
    spark = queries.sparkSession
    queries = queries.select("query_id", F.lower(F.trim("q")).alias("q")).where("q <> ''")
    queries.select(F.col("q").alias("query_id"), "q").distinct().write.parquet(f"{scratch}/texts")
    text = F.lower("name")
    score = F.when(text.startswith(F.col("q")), 3).otherwise(1) + F.when(F.col("hub") & (text == F.col("q")), 5).otherwise(0)
    # A query can begin a name only in a first list, if its word is its first one; and be a whole one only while names are as short as it.
    one, leads = ~F.col("q").rlike(r"\s"), F.get(F.split("q", r"\s+"), F.lit(0)) == F.col("word")
    begins = F.when(one, F.col("first") & F.col("start")).when(leads, F.col("first") & (F.col("term") == F.col("word"))).otherwise(True)
    bound = F.when(begins, 3).otherwise(1) + F.when(begins & F.col("hub") & (F.col("shortest") <= F.length("q")), 5).otherwise(0)
    order = [F.col("length"), F.col("year").desc_nulls_last(), F.col("id")]
    best = _answers(spark.read.parquet(f"{scratch}/texts"), path, scratch, k, score, order, bound, "id")
    found = queries.join(best.select(F.col("query_id").alias("q"), "score", "length", "year", "id"), "q")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), *order))
    return found.withColumn("place", place).where(F.col("place") <= k).select("query_id", "place", "id", "score")


def complete_index(prefixes: DataFrame, path: str, scratch: str, k: int = 8) -> DataFrame:
    """autocomplete over a stored index: (prefix, name, tier, place).  ``scratch`` is a new folder for its rounds."""
    asked = prefixes.select(F.col("prefix").alias("query_id"), F.lower("prefix").alias("q")).where("trim(q) <> ''").distinct()
    text = F.lower("name")
    score = F.when(text.contains(F.col("q")), F.when(F.col("hub") & text.startswith(F.col("q")), 0).when(F.col("hub"), -1).otherwise(-2))
    bound = F.when(F.col("hub"), 0).otherwise(-2)
    best = _answers(asked, path, scratch, k, score, [F.col("length"), F.col("name")], bound, "name")
    return best.select(F.col("query_id").alias("prefix"), "name", (-F.col("score")).alias("tier"), "place")
