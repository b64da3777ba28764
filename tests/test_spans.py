"""Spans of a dictionary's words, by automaton and by join, against a search of every word."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from vigilspark.functions import text as t
from vigilspark.operators import contain, match, spans


def slow_places(text, names, least, cap):
    found = []
    for name, code in sorted(names, key=lambda n: (-len(n[0]), n[0])):
        hit = len(name) >= least and re.search(rf"(?<!\w){re.escape(name)}(?!\w)", text)
        if hit:
            text = text[:hit.start()] + " " * len(name) + text[hit.end():]
            found += [] if code in found else [code]
            if len(found) >= cap:
                break
    return found


def test_places_by_title_then_summary(spark):
    r = random.Random(2)
    names = [("new guinea", "B"), ("guinea", "A"), ("papua new guinea", "C"), ("west papua", "D"), ("niger", "E"), ("nigeria", "F"),
        ("the niger", "E"), ("mali", "G"), ("old x", "H"), ("x old x", "I")]
    words = ["Papua", "new", "Guinea", "guinea", "west", "niger", "nigeria", "the", "Mali", "mali.", "old", "x", "-", "region", "ünd"]
    rows = [(i, " ".join(r.choice(words) for _ in range(r.randrange(0, 6))), " ".join(r.choice(words) for _ in range(r.randrange(0, 9)))) for i in range(300)]
    rows += [(900, None, "mali"), (901, "mali", None), (902, None, None)]
    df = spark.createDataFrame(rows, "id int, title string, summary string")
    got = match.tag_places_masked(df, spark.createDataFrame(names, "name string, code string"), spark.createDataFrame([("region",)], "name string"))
    for row in got.collect():
        title = (row.title or "").lower()
        want = slow_places(title, names, 4, 4) or slow_places(f"{title} {(row.summary or '').lower()}", names, 5, 3)
        assert row.places == want and row.multi == ("region" in title), row


@pytest.mark.parametrize("left, right", [(True, True), (True, False), (False, False)])
def test_occurrences_by_automaton_and_by_join(spark, left, right):
    words = ["ab", "a", "b ab", "é", "abc", "xyz", "c"]
    texts = ["ab abc b ab", "é ab é", "", None, "zzz", "ab abc b ab", "a_ab ab"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    known = spark.createDataFrame([(w, i) for i, w in enumerate([*words, "ab", None, ""])], "word string, n int")
    want = {i: sorted((m.start(), m.start() + len(w), n) for n, w in enumerate([*words, "ab"])
                      for m in re.finditer((r"(?<!\w)" if left else "") + "(?=" + re.escape(w) + (r"(?!\w)" if right else "") + ")", text or "")) for i, text in enumerate(texts)}
    for most in (spans.MAX_AUTOMATON_BYTES, 0):
        got = spans.occurrences(df, "text", known, "found", left, right, most).select("id", "found").collect()
        assert {r.id: sorted((s.start, s.end, s.n) for s in r.found) for r in got} == want
    assert spans.occurrences(df, "text", known.limit(0), "found").where("size(found) > 0").count() == 0


def test_many_names_take_no_longer(spark):
    items = spark.range(400).select("id", F.concat(F.lit("n"), F.col("id") * 7, F.lit(" beside m"), F.col("id")).alias("title"), F.lit("none here").alias("summary"))

    def seconds(names):
        started = time.time()
        assert match.tag_places_masked(items, names).where("size(places) > 0").count() > 300
        return time.time() - started

    names = spark.range(100_000).select(F.concat(F.lit("n"), "id").alias("name"), F.col("id").cast("string").alias("code"))
    seconds(names.limit(3000))
    assert seconds(names) < 30
    found = t.find_terms(items, "title", names.select(F.col("name").alias("term"))).where("id = 3").first()
    assert found.terms == ["n21"]


@pytest.mark.parametrize("few, most", [(64, 8 << 20), (0, 8 << 20), (0, 0)])
def test_few_words_are_found_as_many_are(spark, monkeypatch, few, most):
    monkeypatch.setattr(contain, "FEW_WORDS", few)
    monkeypatch.setattr(contain, "MAX_BROADCAST_BYTES", most)
    texts = [(i, x) for i, x in enumerate(["", None, "a", "the vector", "the Vector", "zoonosis of vectors", "éa\nb", "zoonosi", "the vector"])]
    words = ["vector", "zoonosis", "a", "éa", "a\nb", "the vec", "x", "", None, "vector"]
    got = contain.contained(spark.createDataFrame(texts, "id int, t string"), spark.createDataFrame([(w,) for w in words], "w string"), "t", "w", ["id"])
    assert sorted(map(tuple, got.select("id", "w").collect())) == sorted((i, w) for i, x in texts for w in words if x and w and w in x)


def test_few_glossary_words_cut_no_page_into_pieces(spark):
    pages = spark.createDataFrame([(1, "The Vector."), (1, "que"), (2, "que que"), (3, None), (None, "lone")], "page_id int, text string")
    word = lambda *w: spark.createDataFrame([(x,) for x in w], "word string")
    got = t.glossary_gaps(pages, word("Que", "the", "zoonosis", "lone", "", None), word("THE", "the", "ghost", "vector"))
    assert sorted(map(tuple, got.collect())) == [("ghost", 0, "unused"), ("lone", 0, "undefined"), ("que", 2, "undefined")]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and plan.count("LogicalRDD [page_id") == 1
