"""A stored index answers as a search of the whole corpus does, and reads less of it."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from vigilspark.operators import index, search


def corpus(seed, n):
    r = random.Random(seed)
    parts = ["an", "ana", "banana", "nab", "ba", "é", "co", "Cola", "x1", "a"]
    rows = [(i, " ".join(r.choice(parts) + r.choice(["", "s", "ba"]) for _ in range(r.randrange(1, 5))), r.random() < 0.2, r.choice([None, 2000, 2001, 2002])) for i in range(n)]
    return [*rows, (n, "", False, 2000), (n + 1, "  an  ba ", True, None), (n + 2, None, False, None)]


@pytest.mark.parametrize("block", [2, 128])
def test_index_equals_search(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(index, "BLOCK", block)
    schema = "id long, name string, hub boolean, year int"
    first, second = corpus(1, 150), [(1000 + i, *x) for i, *x in corpus(2, 80)]
    path = f"file://{tmp_path}/index"
    index.create_index(spark.createDataFrame(first, schema), path, 4)
    index.add_delivery(spark.createDataFrame(second, schema), path, 1)
    whole = spark.createDataFrame(first + second, schema)
    words = ["an", "a", "ban", "banana", "an ba", "cola x1", "zzz", "ana zzz", "é", "x1", "  BA ", "nab a", ""]
    queries = spark.createDataFrame(list(enumerate(words)), "query_id long, q string")
    got = index.search_index(queries, path, f"file://{tmp_path}/search")
    want = search.score_search(queries, whole)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    prefixes = queries.select(F.col("q").alias("prefix")).where("q <> '  BA '")
    done = index.complete_index(prefixes, path, f"file://{tmp_path}/complete", 5)
    asked = search.autocomplete(prefixes.where("trim(prefix) <> ''"), whole, 5).select("prefix", "name", "tier", "place")
    assert sorted(map(tuple, done.collect())) == sorted(map(tuple, asked.collect()))


def test_index_stops_when_no_better_answer_is_left(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(index, "BLOCK", 2)
    rows = [(i, "x" * (i % 40) + " common", False, 2000) for i in range(400)]
    path = f"file://{tmp_path}/index"
    index.create_index(spark.createDataFrame(rows, "id long, name string, hub boolean, year int"), path, 4)
    tiers = spark.read.parquet(f"{path}/postings").agg(F.max("tier")).first()[0]
    queries = spark.createDataFrame([(1, "common")], "query_id long, q string")
    got = index.search_index(queries, path, f"file://{tmp_path}/search", 3)
    assert [tuple(r)[1:] for r in got.orderBy("place").collect()] == [(1, 0, 1), (2, 40, 1), (3, 80, 1)]
    read = {p.name for p in Path(tmp_path, "search").iterdir() if p.name.startswith("best")}
    assert tiers >= 2 and f"best{tiers}" not in read


def test_equal_queries_are_one_search(spark, tmp_path):
    schema = "id long, name string, hub boolean, year int"
    whole = spark.createDataFrame([*corpus(4, 80), (200, "An Ba", None, 2003), (201, "ban", None, 1)], schema)
    path = f"file://{tmp_path}/index"
    index.create_index(whole, path, 4)
    asked = [(i, q) for i in range(30) for q in ([" an ba ", "An BA"] if i == 7 else ["an ba" if i % 2 else "ban"])]
    queries = spark.createDataFrame([*asked, (7, "an ba"), (31, None)], "query_id long, q string")
    got = index.search_index(queries, path, f"file://{tmp_path}/search")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, search.score_search(queries, whole).collect()))
    assert got.where("id = 200").count() == 17  # of 14 queries, and three times of query 7, which asks it three times
    assert spark.read.parquet(f"{tmp_path}/search/lists").select("query_id").distinct().count() == 2


def test_words_that_begin_no_name_stop_early(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(index, "BLOCK", 2)
    rows = [(i, "x" * (1 + i % 40) + " common word", False, 2000) for i in range(400)] + [(1000 + i, f"word {i}", False, 2000) for i in range(900)]
    path = f"file://{tmp_path}/index"
    index.create_index(spark.createDataFrame(rows, "id long, name string, hub boolean, year int"), path, 4)
    lists = spark.read.parquet(f"{path}/postings").where("term = 'common'").agg(F.max("tier")).first()[0]
    got = index.search_index(spark.createDataFrame([(1, "common word")], "query_id long, q string"), path, f"file://{tmp_path}/search", 3)
    assert [tuple(r)[1:] for r in got.orderBy("place").collect()] == [(1, 0, 1), (2, 40, 1), (3, 80, 1)]
    assert lists >= 2 and f"best{lists}" not in {p.name for p in Path(tmp_path, "search").iterdir()}


def test_dictionary_tells_what_postings_hold(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(index, "BLOCK", 3)
    path = f"file://{tmp_path}/index"
    rows = corpus(5, 900)
    index.create_index(spark.createDataFrame(rows, "id long, name string, hub boolean, year int"), path, 4)
    held = spark.read.parquet(f"{path}/postings").select("term", "first", "hub", "tier", "block", F.explode("docs").alias("d"))
    told = spark.read.parquet(f"{path}/dictionary").where("start").select("term", F.explode("lists").alias("e")).select("term", "e.*")
    assert sorted(map(tuple, held.groupBy("term", "first", "hub", "tier").agg(F.count("*"), F.min("d.length")).collect())) == sorted(map(tuple, told.collect()))
    full = held.groupBy("term", "first", "hub", "block").agg(F.count("*").alias("n"), F.max("d.length").alias("most"), F.min("d.length").alias("least"), F.max("tier").alias("tier")).collect()
    each = {}
    for r in sorted(full, key=lambda r: r.block):
        each.setdefault((r.term, r["first"], r.hub), []).append(r)
    for blocks in each.values():
        assert [r.block for r in blocks] == list(range(len(blocks))) and all(r.n == 3 for r in blocks[:-1])
        assert all(a.most <= b.least and a.tier <= b.tier for a, b in zip(blocks, blocks[1:]))
    assert held.where("tier > 1").count() and held.select("d.id", "term").distinct().count() == held.count()
    assert {r.id for r in held.select("d.id").distinct().collect()} == {i for i, name, *_ in rows if name and name.strip()}
