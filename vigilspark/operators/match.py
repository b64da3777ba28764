"""Matching names, titles and versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilspark.operators.contain import contained
from vigilspark.operators.order import carried
from vigilspark.operators.spans import allocated, longest_first, occurrences


def match_entities_in_text(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """(doc, norm, entity, key) for every normalised key (two characters or more) that the normalised title contains."""
    keys = keys.select("entity", "key").where(F.length("key") >= 2).distinct()
    return contained(docs.select("doc", "norm"), keys, "norm", "key")


def suppress_buried(matches: DataFrame, names: DataFrame) -> DataFrame:
    """Drop a hit whose matched keys all lie only inside longer names of other entities that the title holds.

    Those names are blanked out of the title; a key that is still there stands by itself."""
    longer = names.select(F.col("entity").alias("_other"), F.col("key").alias("_long")).distinct()
    held = contained(matches.select("doc", "norm").distinct(), longer, "norm", "_long").select("doc", F.col("norm").alias("_norm"), "_other", "_long")
    # Only the names within one title meet each other.
    same = (F.col("doc") == F.col("_doc")) & F.col("norm").eqNullSafe(F.col("_norm"))
    within = same & (F.col("_other") != F.col("entity")) & F.col("_long").contains(F.col("key")) & (F.length("_long") > F.length("key"))
    left = matches.join(held.withColumnRenamed("doc", "_doc"), within, "left")
    per = left.groupBy("doc", "entity", "key", "norm").agg(F.collect_set("_long").alias("_longs"))
    longest_first = F.transform(F.array_sort(F.transform("_longs", lambda x: F.struct((-F.length(x)).alias("n"), x.alias("name")))), lambda x: x["name"])
    masked = F.aggregate(longest_first, F.col("norm"), lambda text, name: F.replace(text, name, F.lit("\x01")))
    return per.withColumn("_free", masked.contains(F.col("key"))).groupBy("doc", "entity").agg(F.bool_or("_free").alias("_free"),
        F.array_sort(F.collect_set("key")).alias("keys")).where("_free").drop("_free")


def mislisted() -> Column:
    """Whether a title states another grade than its row's, or lists two or more other entities in brackets; null if that hangs on an
    unknown grade.  An entity without a name is named nowhere."""
    stated = F.regexp_extract("title", r"grade (\d+)", 1)
    listed = F.transform(F.split(F.regexp_extract("title", r"\(([^)]*)\)", 1), ","), lambda x: F.trim(x))
    named = F.coalesce(F.col("title").contains(F.col("entity")), F.lit(False))
    other_grade = (stated != "") & (stated != F.col("grade").cast("string")) & ~named
    not_listed = (F.size(listed) >= 2) & ~F.exists(listed, lambda x: x.eqNullSafe(F.col("entity")))
    same_grade = (stated != "") & (stated == F.col("grade").cast("string"))
    return ~same_grade & (other_grade | not_listed)


def suppress_mislisted(matches: DataFrame) -> DataFrame:
    """Drop hits (title, entity, grade) whose title states another grade, or lists two or more other entities in brackets."""
    return matches.where(~mislisted())


def longest_match(docs: DataFrame, names: DataFrame) -> DataFrame:
    """(doc, name): the longest name in the title, the first in order on ties."""
    hits = contained(docs, names.select("name").distinct(), "title", "name")
    return hits.groupBy("doc").agg(F.min_by("name", F.struct((-F.length("name")).alias("l"), "name")).alias("name"))


def prefix_fallback_join(left: DataFrame, right: DataFrame, n: int) -> DataFrame:
    """Left rows (id, key) with ``value`` and ``how``: the right row (key, value, place) of equal key, else the
    first one that shares the first n characters."""
    exact = right.groupBy("key").agg(F.min_by("value", "place").alias("_exact"))
    near = right.where(F.length("key") >= n).groupBy(F.substring("key", 1, n).alias("_p")).agg(F.min_by("value", "place").alias("_near"))
    prefix = F.when(F.length("key") >= n, F.substring("key", 1, n))
    out = left.join(exact, "key", "left").withColumn("_p", prefix).join(near, "_p", "left")
    return out.select("id", "key", F.coalesce("_exact", "_near").alias("value"), F.when(F.col("_exact").isNotNull(),
        "exact").when(F.col("_near").isNotNull(), "prefix").alias("how"))


def superseded_by(docs: DataFrame, rules: DataFrame) -> DataFrame:
    """``docs`` (doc, title, year) with ``by`` and ``why`` of the first rule (place, key, by, since, why) that applies."""
    applies = F.col("year").isNull() | F.col("since").isNull() | (F.col("year") < F.col("since"))
    found = contained(docs, rules, "title", "key").where(applies).groupBy("doc").agg(F.min_by(F.struct("by", "why"), "place").alias("_r"))
    return docs.join(found, "doc", "left").select(*docs.columns, F.col("_r.by").alias("by"), F.col("_r.why").alias("why"))


def multi_key_match(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (id, keys array) of both sides that share a key, as (left_id, right_id); and the unmatched left ids."""
    a = left.select(F.col("id").alias("left_id"), F.explode("keys").alias("k")).where("k <> ''")
    b = right.select(F.col("id").alias("right_id"), F.explode("keys").alias("k")).where("k <> ''")
    pairs = a.join(b, "k").select("left_id", "right_id").distinct()
    return pairs, left.join(pairs, left.id == pairs.left_id, "left_anti").select(F.col("id").alias("left_id"))


def as_of_version(versions: DataFrame, dates: DataFrame, key: str, table_day: str | None = None) -> DataFrame:
    """``dates`` (key, day) with the version in force: the last one effective on or before the day.  With ``table_day``, a
    column of ``dates``, also ``stale``: the version in force is newer than that day's table.

    Versions and days are united and sorted once; no range join.  The last version is carried from range to range,
    so a key of all rows is in many tasks."""
    empty = lambda c, of: F.lit(None).cast(of.schema[c].dataType).alias(c)
    rest = [c for c in dates.columns if c not in (key, "day")]
    both = versions.select(key, F.col("effective").alias("_t"), "version", F.lit(0).alias("_o"), empty("day", dates), *(empty(c, dates) for c in rest)).unionByName(
        dates.select(key, F.col("day").cast(versions.schema["effective"].dataType).alias("_t"), empty("version", versions), F.lit(1).alias("_o"), "day", *rest))
    own = F.when(F.col("_o") == 0, F.struct(F.col(key).alias("key"), "version", F.col("_t").alias("effective")))
    order = [F.col(key), F.col("_t"), F.col("_o"), F.col("version"), F.col("_tie")]  # the last one parts equal days
    found = carried(both.withColumn("_tie", F.monotonically_increasing_id()), order, {"_v": own}).where("_o = 1")
    mine = F.col("_v.key").eqNullSafe(F.col(key))
    out = found.select(key, "day", F.when(mine, F.col("_v.version")).alias("version"), *rest, F.when(mine, F.col("_v.effective")).alias("_since"))
    stale = [] if table_day is None else [F.coalesce(F.col("_since") > F.col(table_day), F.lit(False)).alias("stale")]
    return out.select(key, "day", "version", *rest, *stale)


def current_phase(phases: Column, formal: list[str]) -> Column:
    """Status of the last phase, in array order, that is a formal grade."""
    kept = F.filter(phases, lambda p: p.status.isin(formal))
    return F.try_element_at(kept, F.lit(-1)).status


def evidence_gate(entities: DataFrame, ledger: DataFrame, absent: DataFrame) -> DataFrame:
    """``entities`` with a struct: the value and its citation, or a gap with its reason; nothing is inferred."""
    out = entities.join(ledger.select("entity", "value", "doc_id"), "entity", "left").join(absent.select("entity").distinct().withColumn("_absent", F.lit(True)), "entity", "left")
    there = F.col("value").isNotNull()
    return out.select(*entities.columns, F.struct(there.alias("ok"), "value", F.when(there, F.col("doc_id")).alias("doc_id"),
        F.when(there, "cited").when(F.col("_absent"), "confirmed absent").otherwise("not yet checked").alias("status")).alias("evidence"))


def merge_catalogues(first: DataFrame, second: DataFrame) -> DataFrame:
    """Full merge on (series, year): the first catalogue's fields win, sources are listed, a second URL is kept."""
    both = first.withColumn("_p", F.lit(0)).unionByName(second.withColumn("_p", F.lit(1)))
    order = F.struct("_p", "url")
    return both.groupBy("series", "year").agg(F.min_by("title", order).alias("title"), F.min_by("url", order).alias("url"),
        F.array_join(F.array_sort(F.collect_set("source")), "+").alias("sources"),
                                              F.min(F.when(F.col("_p") == 1, F.col("url"))).alias("_second")).withColumn("url2", F.nullif("_second", "url")).drop("_second")


def attach_corrections(matches: DataFrame, manual: DataFrame) -> DataFrame:
    """Hand-written rows (doc, covers: entities split on ; or ,) added as direct links."""
    rows = manual.select("doc", F.explode(F.split("covers", r"\s*[;,]\s*")).alias("entity")).where("entity <> ''").withColumn("how", F.lit("manual"))
    return matches.select("doc", "entity").withColumn("how", F.lit("title")).unionByName(rows)


def match_common_prefix(names: DataFrame, canon: DataFrame, least: int = 2) -> DataFrame:
    """(name, match): the canonical name with the longest common prefix, of ``least`` characters; a tie at the top is no match.

    In one sorted order the best is next to the name, and so is what ties with it: two neighbours on
    either side are compared, carried over the ends of ranges."""
    known = canon.select(F.col("name").alias("_c")).where("_c IS NOT NULL").distinct()
    beside = carried(known, [F.col("_c")], {"_p": F.col("_c")}, {"_n": F.col("_c")}, itself=False)
    both = beside.select(F.col("_c").alias("_s"), F.lit(0).alias("_o"), F.struct("_c", "_p").alias("_down"), F.struct("_c", "_n").alias("_up")).unionByName(
        names.select(F.col("name").alias("_s")).where("_s IS NOT NULL").distinct().withColumn("_o", F.lit(1)), allowMissingColumns=True)
    found = carried(both, [F.col("_s"), F.col("_o")], {"_a": F.col("_down")}, {"_b": F.col("_up")}).where("_o = 1")
    shared = lambda c: F.coalesce(F.array_max(F.filter(F.sequence(F.lit(0), F.least(F.length("_s"), F.length(c))),
        lambda i: F.substring("_s", F.lit(1), i) == F.substring(c, F.lit(1), i))), F.lit(0))
    near = F.array(*(F.struct(shared(F.col(c)).alias("n"), F.col(c).alias("name")) for c in ("_a._c", "_a._p", "_b._c", "_b._n")))
    top = F.filter(near, lambda x: x.n == F.array_max(F.transform(near, lambda y: y.n)))
    best = F.when((F.size(top) == 1) & (top[0].n >= least), top[0]["name"])
    return found.select(F.col("_s").alias("name"), best.alias("match")).unionByName(
        names.where("name IS NULL").select("name", F.lit(None).cast("string").alias("match")).distinct())


def tag_keywords(items: DataFrame, keywords: DataFrame, cap: int = 4, names: DataFrame | None = None) -> DataFrame:
    """``items`` (id, text) with ``labels``: of the keywords (place, word, label) that start a word, in order, distinct, then
    of the full ``names`` (place, word, label) that the column ``title`` holds as they are spelled, capped."""
    lowered = occurrences(items.withColumn("_t", F.lower("text")), "_t", keywords.select("word", "place", "label"), "_k", right=False)
    hits = _in_order("_k")
    if names is not None:
        lowered = occurrences(lowered, "title", names.select("word", "place", "label"), "_n", left=False, right=False)
        hits = F.concat(hits, _in_order("_n"))
    return lowered.withColumn("labels", F.coalesce(F.slice(F.array_distinct(hits), 1, cap), F.array().cast("array<string>"))).select(*items.columns, "labels")


def _in_order(spans: str) -> Column:
    placed = F.array_sort(F.array_distinct(F.transform(spans, lambda s: F.struct(s.place.alias("place"), s.label.alias("label")))))
    return F.transform(placed, lambda x: x.label)


def tag_broader_groups(tagged: DataFrame, groups: DataFrame, cap: int = 2) -> DataFrame:
    """``maybe``: group words (place, word, group, candidates) in the text none of whose candidates is tagged;
    a group without candidates counts only if nothing is tagged."""
    hits = contained(tagged.withColumn("_t", F.lower("text")), groups, "_t", "word")
    free = F.when(F.size("candidates") == 0, F.size("labels") == 0).otherwise(~F.arrays_overlap("labels", "candidates"))
    maybe = hits.where(free).groupBy("id").agg(F.slice(F.transform(F.array_sort(F.collect_set(F.struct("place", "group"))), lambda x: x.group), 1, cap).alias("maybe"))
    return tagged.join(maybe, "id", "left").withColumn("maybe", F.coalesce("maybe", F.array().cast("array<string>")))


def tag_places_masked(items: DataFrame, names: DataFrame, regions: DataFrame | None = None, least: tuple[int, int] = (4, 5), caps: tuple[int, int] = (4, 3)) -> DataFrame:
    """``items`` (title, summary) with ``places``: codes of the ``names`` (name, code) in the title, the longest name first,
    whose place isn't free for the next ones; if the title has none, those in title and summary.  ``least`` characters of a name and
    ``caps`` on different codes are for either.  ``multi``: the title holds one of the ``regions`` (name).

    A name takes its first free occurrence, with no letter, digit or underscore beside it; case doesn't count."""
    known = names.select(F.lower("name").alias("word"), "code").distinct()
    lowered = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    # One pass over both: a title ends at a space, so what ends within it stands in the title by itself.
    found = items.withColumn("_title", lowered("title"))
    found = occurrences(found.withColumn("_text", F.concat("_title", F.lit(" "), lowered("summary"))), "_text", known, "_spans")
    titled = lambda spans: F.filter(spans, lambda s: s.end <= F.length("_title"))
    multi = F.lit(False)
    if regions is not None:
        found = occurrences(found, "_text", regions.select(F.lower("name").alias("word")).distinct(), "_regions", left=False, right=False)
        multi = F.size(titled(F.col("_regions"))) > 0
    found = found.withColumn("places", _codes(titled(F.col("_spans")), least[0], caps[0])).withColumn("multi", multi)
    places = F.when(F.size("places") == 0, _codes(F.col("_spans"), least[1], caps[1])).otherwise(F.col("places"))
    return found.withColumn("places", places).select(*items.columns, "places", "multi")


def _codes(spans: Column, least: int, cap: int) -> Column:
    long = F.filter(spans, lambda s: F.length(s.word) >= least)
    return F.array_distinct(F.transform(allocated(long, longest_first, lambda s: s.code, cap), lambda s: s.code))


def join_item_context(items: DataFrame, designations: DataFrame) -> DataFrame:
    """A row an item, place and label with the designation's level; one fallback row for a place without any."""
    pairs = items.select("id", F.explode("places").alias("country"), "labels").select("id", "country", F.explode("labels").alias("condition"))
    known = designations.select("country", "condition", "level")
    hits = pairs.join(known, ["country", "condition"])
    places = items.select("id", F.explode("places").alias("country")).distinct()
    none = places.join(hits.select("id", "country"), ["id", "country"], "left_anti")
    return hits.select("id", "country", "condition", "level").unionByName(none.select("id", "country", F.lit(None).cast("string").alias("condition"), F.lit("none").alias("level")))
