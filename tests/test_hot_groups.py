"""Groups of all rows: results equal plain passes, and no range holds them whole."""

import os
import random
import time

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from vigilspark.operators import inflow, match, order, search, series, surveil


def same(a, b):
    assert sorted(map(tuple, a.collect()), key=repr) == sorted(map(tuple, b.collect()), key=repr)


def test_places_sums_and_carried_values(spark):
    r = random.Random(1)
    rows = [(i, r.choice([None, 1.0, 1.0, 2.5]), r.choice([None, "a", "b"])) for i in range(500)]
    df = spark.createDataFrame(rows, "id int, x double, s string")
    by = [F.col("x").asc_nulls_first(), F.col("id")]
    plain = Window.orderBy(*by)
    same(order.numbered(df, "k", by), df.withColumn("k", F.row_number().over(plain)))
    same(order.running_sum(df, "id", "k", by), df.withColumn("k", F.coalesce(F.sum("id").over(plain.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))))
    for itself in (True, False):
        got = order.carried(df, by, {"b": F.col("s")}, {"a": F.col("s")}, itself)
        back = Window.orderBy(F.col("x").desc_nulls_last(), F.col("id").desc()).rowsBetween(Window.unboundedPreceding, 0 if itself else -1)
        want = df.withColumn("b", F.last("s", True).over(plain.rowsBetween(Window.unboundedPreceding, 0 if itself else -1))).withColumn("a", F.last("s", True).over(back))
        same(got, want)
    ranges = order.in_ranges(df, by).groupBy("_range").count().collect()
    assert len(ranges) == 4 and max(x["count"] for x in ranges) < 250


def test_ranks_of_one_group(spark):
    r = random.Random(2)
    df = spark.createDataFrame([("g" if i % 50 else None, r.randrange(9), r.randrange(4), i) for i in range(600)], "g string, x int, y int, id int")
    w = Window.partitionBy("g")
    plain = df.withColumn("k", F.rank().over(w.orderBy("x")) + (F.count("*").over(Window.partitionBy("g", "x")) - 1) / 2.0)
    same(surveil.average_rank(df, ["g"], "x", "k"), plain)
    ranked = plain.withColumn("ky", F.rank().over(w.orderBy("y")) + (F.count("*").over(Window.partitionBy("g", "y")) - 1) / 2.0)
    want = {x.g: (x.n, x.rho) for x in ranked.groupBy("g").agg(F.count("*").alias("n"), F.round(F.corr("k", "ky"), 3).alias("rho")).collect()}
    assert {x.g: (x.n, x.rho) for x in surveil.grouped_spearman(df, ["g"], "x", "y").collect()} == want


@pytest.mark.parametrize("values", [[5.0] * 300, [10.0 ** (i % 40 - 20) for i in range(300)], [0.0, -1.0], list(range(1, 8)) * 30, [float(i * i % 97) for i in range(900)]])
def test_order_statistics_without_ranks(spark, values):
    probs = [0.0, 0.25, 0.5, 0.75, 0.99, 1.0]
    seen = sorted(v for v in values if v > 0)
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double")
    want = [(p, seen[min(len(seen) - 1, int(p * len(seen)))]) for p in probs] if seen else []
    assert sorted(map(tuple, inflow.nearest_rank_bins(df, "v", probs).collect())) == want


def slow_dedup(rows):
    kept = []
    for year, title, weight, doc in sorted(rows, key=lambda x: (-x[2], x[3])):
        base = "".join(c for c in (title or "").lower() if c.isalnum())[:24]
        if not any(y == year and (base in other or other in base) for y, other in kept):
            kept.append((year, base))
            yield doc


def test_one_year_of_titles(spark):
    r = random.Random(3)
    rows = [(r.choice([2020] * 9 + [None]), r.choice(["", "the ", "x"]) + "".join(r.choice("abc -") for _ in range(r.randrange(30))), r.randrange(6),
        i) for i in range(500)] + [(2021, None, 1, 900), (2021, "q", 2, 901)]
    df = spark.createDataFrame(rows, "year int, title string, weight int, id int")
    assert sorted(x.id for x in series.fuzzy_dedup_by_weight(df).collect()) == sorted(slow_dedup(rows))
    assert series.fuzzy_dedup_by_weight(df.limit(0)).count() == 0


def test_one_prefix_of_names(spark):
    r = random.Random(4)
    word = lambda: "ab" + "".join(r.choice("xyz") for _ in range(r.randrange(7)))
    names, canon = [word() for _ in range(150)] + ["", "a", "zz", None], [word() for _ in range(80)] + ["ab", "q", ""]
    got = match.match_common_prefix(spark.createDataFrame([(x,) for x in names], "name string"), spark.createDataFrame([(x,) for x in canon], "name string"))

    def slow(name):
        if name is None:
            return None
        lengths = {c: len(os.path.commonprefix([name, c])) for c in set(canon)}
        best = max(lengths.values())
        top = [c for c, n in lengths.items() if n == best]
        return top[0] if best >= 2 and len(top) == 1 else None

    assert {x.name: x.match for x in got.collect()} == {n: slow(n) for n in names}


def test_versions_of_one_key(spark):
    r = random.Random(5)
    day = lambda: f"2020-{r.randrange(1, 13):02d}-{r.randrange(1, 28):02d}"
    versions = [(k, i, day()) for i, k in enumerate(["a", "a", "a", "b", None])]
    dates = [(r.choice(["a"] * 8 + ["b", "c", None]), day(), "2020-06-15", i) for i in range(400)] + [("a", "2020-01-01", "2020-06-15", 1000 + i) for i in range(200)]
    got = match.as_of_version(spark.createDataFrame(versions, "k string, version int, effective string"),
        spark.createDataFrame(dates, "k string, day string, made string, id int"), "k", "made")

    def slow(k, on):
        known = [(e, v) for key, v, e in versions if key == k and e <= on]
        return max(known) if known else (None, None)

    want = {i: (slow(k, on)[1], (slow(k, on)[0] or "") > made) for k, on, made, i in dates}
    assert {x.id: (x.version, x.stale) for x in got.collect()} == want


def slow_search(queries, rows, k=10):
    for query in {i for i, _ in queries}:
        hits = []
        for i, q in queries:
            q = (q or "").strip(" ").lower()
            for id_, name, hub, year in rows if i == query and q else []:
                if name is not None and all(w in name.lower() for w in q.split()):
                    score = (3 if name.lower().startswith(q) else 1) + (5 if hub and name.lower() == q else 0)
                    hits.append((-score, len(name), -(year or 0), id_))
        yield from ((query, place, x[3], -x[0]) for place, x in enumerate(sorted(hits)[:k], 1))


def test_equal_queries_and_names_are_searched_once(spark):
    r = random.Random(3)
    rows = [(i, r.choice(["An a", "an A", "an a", "ban an", "Ana", None, "", "b"]), r.choice([True, False, None]), r.choice([None, 1, 2])) for i in range(300)]
    asked = [(i % 9, r.choice([" an ", "An A", "a an", "b", "zz", "", None])) for i in range(20)] + [(3, "an"), (3, "an")]
    corpus, queries = "id long, name string, hub boolean, year int", "query_id long, q string"
    got = search.score_search(spark.createDataFrame(asked, queries), spark.createDataFrame(rows, corpus))
    assert sorted(map(tuple, got.collect())) == sorted(slow_search(asked, rows))
    # 30,000 x 30,000 hits, if each query and record were met by itself.
    many = spark.range(30000)
    start = time.monotonic()
    found = search.score_search(many.select(F.col("id").alias("query_id"), F.lit("an a").alias("q")), many.select("id", F.lit("an a").alias("name"),
        F.lit(False).alias("hub"), F.lit(2000).alias("year")))
    assert found.groupBy("place", "id", "score").count().orderBy("place").collect() == [(i + 1, i, 3, 30000) for i in range(10)]
    assert time.monotonic() - start < 30
