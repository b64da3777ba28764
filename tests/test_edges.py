"""Small invented fixtures, one for each edge case."""

import pytest
from pyspark.sql import functions as F

from vigilspark.functions import clean as c
from vigilspark.functions import text as t
from vigilspark.operators import inflow, match, quality, series, surveil
from vigilspark.sources import files
from vigilspark.sources import pages as p
from vigilspark.streaming import feed


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_dash_and_comma_numbers(spark):
    df = spark.createDataFrame([("1,234",), ("-",), ("–",), ("",), (None,), ("x",)], "v string")
    assert [r[0] for r in df.select(c.clean_number(F.col("v"), True)).collect()] == [1234, None, None, None, None, None]


def test_week_without_a_year(spark):
    df = spark.createDataFrame([(52,), (8,), (9,)], "w int")
    assert [r[0] for r in df.select(c.infer_week_year(F.col("w"), F.lit(2), F.lit(2024))).collect()] == [2023, 2024, 2023]


def test_bad_years_fall_back_to_the_date(spark):
    df = spark.createDataFrame([("no. 220902", "2022-09-02"), ("plan 2090", "2022-01-01"), ("2019 plan", "2022-01-01"), ("x", "")], "t string, d string")
    assert [r[0] for r in df.select(c.plausible_year(F.col("t"), F.col("d"), 2000, 2030)).collect()] == [2022, 2022, 2019, 0]


def test_editions_share_a_key(spark):
    df = spark.createDataFrame([("2023 Measles guide (2nd edition)",), ("Measles guide, revised 2021",), ("Measles  Guide",)], "t string")
    assert len({r[0] for r in df.select(c.series_key(F.col("t"))).collect()}) == 1


def test_revision_later_issue_wins(spark):
    df = spark.createDataFrame([("a", 1, 1, 10), ("a", 1, 4, 12), ("b", 1, 1, 7)], "e string, week int, issue int, n int")
    assert rows(surveil.latest_revision(df, ["e", "week"], ["issue"]), "e") == [("a", 1, 4, 12), ("b", 1, 1, 7)]


def test_tolerance_prefers_the_week_before_and_stays_in_the_year(spark):
    left = spark.createDataFrame([("a", 2024, w, w) for w in (10, 11, 1)], "k string, year int, week int, left_value int")
    right = spark.createDataFrame([("a", 2024, w, w * 10) for w in (10, 12, 52)], "k string, year int, week int, right_value int")
    assert rows(surveil.tolerance_join(left, right, "k").select("week", "right_week", "offset"), "week") == [(10, 10, 0), (11, 10, -1)]


def test_spearman_ties_few_and_constant(spark):
    data = [("t", 1, 1), ("t", 1, 2), ("t", 2, 2), ("t", 3, 3)] + [("f", 1, 1), ("f", 2, 2)] + [("c", 1, 5), ("c", 2, 5), ("c", 3, 5)]
    df = spark.createDataFrame(data, "g string, x int, y int")
    got = {r["g"]: (r["n"], r["rho"]) for r in surveil.grouped_spearman(df, ["g"], "x", "y").collect()}
    assert got["f"] == (2, None) and got["c"] == (3, None) and got["t"][1] == 0.833


@pytest.mark.parametrize("rho, n, verdict", [(0.5, 8, "agree"), (0.2, 9, "weak"), (0.19, 9, "none"), (-0.19, 9, "none"), (-0.2, 9, "oppose"), (0.9, 7, "hold"), (None, 20, "hold")])
def test_verdict_bands(spark, rho, n, verdict):
    df = spark.createDataFrame([(n, rho)], "n int, rho double")
    assert df.select(surveil.concordance_verdict(F.col("n"), F.col("rho"))).first()[0] == verdict


def test_zero_numerator_is_a_state_not_a_rate(spark):
    df = spark.createDataFrame([(0, 10.0), (2, 1e6), (2, None)], "n int, d double")
    assert rows(df.select(*inflow.rate_per_million(F.col("n"), F.col("d")))) == [(None, "none seen"), (2.0, "rate"), (None, "no denominator")]


def test_unresolved_names_raise_and_ignored_ones_do_not(spark):
    df = spark.createDataFrame([("Aland",), ("A. land",), ("Nowhere",), ("Other",)], "name string")
    names = spark.createDataFrame([("a-land", 1)], "name string, code int")
    got = inflow.resolve_names(df, "name", names, names.limit(0), ["Other"], c.norm_key)
    with pytest.raises(inflow.Unresolved, match="Nowhere"):
        inflow.require_resolved(got, "name")
    assert inflow.require_resolved(got.where("name <> 'Nowhere'"), "name").where("ignored").count() == 1


def test_buried_keys(spark):
    docs = spark.createDataFrame([(1, "monkeypox"), (2, "monkeypox and pox"), (3, "pox")], "doc int, norm string")
    keys = spark.createDataFrame([("pox", "pox"), ("monkeypox", "monkeypox")], "entity string, key string")
    got = match.suppress_buried(match.match_entities_in_text(docs, keys), keys)
    assert rows(got.select("doc", "entity"), "doc", "entity") == [(1, "monkeypox"), (2, "monkeypox"), (2, "pox"), (3, "pox")]


def test_bracket_lists_and_grades(spark):
    df = spark.createDataFrame([("Guide (A, B)", "C", 4), ("Guide (A)", "C", 4), ("Guide (A, B)", "A", 4), ("All of grade 1", "C", 4),
        ("All of grade 4 (A, B)", "C", 4)], "title string, entity string, grade int")
    assert rows(match.suppress_mislisted(df).select("title", "entity"), "title") == [("All of grade 4 (A, B)", "C"), ("Guide (A)", "C"), ("Guide (A, B)", "A")]


def test_a_row_of_equal_name_and_title_hides_no_contradiction(spark):
    """Brand#1 and 345, Brand#13 and 45 are spelled alike."""
    df = spark.createDataFrame([("Brand#1345", 2, "all of grade 2"), ("Brand#1345", 3, "all of grade 2"), ("x", None, "all of grade 2"), (None, 2, "all of grade 2"),
        (None, 1, "all of grade 2"), ("x", 1, "plain"), ("x", 1, None)], "entity string, grade int, title string")
    assert sorted(rows(quality.contradicting_links(df).select("subject", "detail")), key=repr) == [("Brand#1345", "all of grade 2"), (None, "all of grade 2")]


def test_keywords_are_bounded_on_the_left_only(spark):
    items = spark.createDataFrame([(1, "Brucellosis found"), (2, "paratyphoid found")], "id int, text string")
    words = spark.createDataFrame([(0, "brucell", "brucellosis"), (1, "typhoid", "typhoid")], "place int, word string, label string")
    assert [r["labels"] for r in match.tag_keywords(items, words).orderBy("id").collect()] == [["brucellosis"], []]


def test_common_prefix_ties_are_no_match(spark):
    names = spark.createDataFrame([("abcd",), ("abx",), ("zz",)], "name string")
    canon = spark.createDataFrame([("abce",), ("abyy",), ("abzz",)], "name string")
    assert rows(match.match_common_prefix(names, canon), "name") == [("abcd", "abce"), ("abx", None), ("zz", None)]


def test_quota_passes(spark):
    df = spark.createDataFrame([(1, "a", i, 100 - i) for i in range(12)] + [(1, "b", 20 + i, 10 - i) for i in range(3)], "year int, theme string, id int, weight int")
    got = series.quota_top_k(df, "year", "theme").collect()
    assert len(got) == 10 and sum(r["theme"] == "b" for r in got) == 3 and [r["place"] for r in sorted(got, key=lambda r: -r["weight"])] == list(range(1, 11))


def test_surge_limits(spark):
    def one(previous, current):
        return series.yoy_surges(spark.createDataFrame([("a", 2000, previous), ("a", 2001, current)], "entity string, year int, value int")).count()
    assert [one(4, 500), one(30, 99), one(100, 299), one(5, 100), one(100, 300)] == [0, 0, 0, 1, 1]
    gap = spark.createDataFrame([("a", 2000, 10), ("a", 2002, 500)], "entity string, year int, value int")
    assert series.yoy_surges(gap).count() == 0


def test_edition_difference(spark):
    df = spark.createDataFrame([("s", 1, "a"), ("s", 2, "a"), ("s", 2, "b"), ("s", 3, "b")], "k string, edition int, item string")
    assert [r["added"] for r in series.edition_diff(df, "k").orderBy("edition").collect()] == [[], ["b"], []]


def test_changes_need_both_sides_and_presence(spark):
    df = spark.createDataFrame([(1, "d1", 1, ""), (1, "d2", 2, "x"), (1, "d4", 3, "y"), (2, "d1", 4, "a")], "id int, day string, seq int, title string")
    assert rows(feed.detect_changes(df, ["title"])) == [(1, "d4", ["title"])]


def test_quiet_only_beyond_twice_the_cadence(spark):
    items = spark.createDataFrame([("a", "2024-01-01"), ("b", "2024-01-02")], "source string, date string")
    sources = spark.createDataFrame([("a", 2), ("b", 2), ("c", 9)], "source string, cadence int")
    assert [(r["source"], r["quiet"]) for r in feed.source_freshness(items, sources, "2024-01-06").orderBy("source").collect()] == [("a", True), ("b", False), ("c", True)]


def test_nothing_is_published_unless_all_counts_agree(spark):
    marks = spark.createDataFrame([("x", f"e{i}") for i in range(4)], "category string, entity string")
    assert quality.publish_if_verified(marks, spark.createDataFrame([("x", 5)], "category string, declared int")).count() == 0
    assert quality.publish_if_verified(marks, spark.createDataFrame([("x", 4)], "category string, declared int")).count() == 4


def test_brackets_in_a_list(spark):
    df = spark.createDataFrame([("A (x,y), B",)], "v string")
    assert df.select(t.split_outside_parens(F.col("v"))).first()[0] == ["A (x,y)", "B"]


def test_captions_are_read_once_and_only_of_kept_images(spark):
    html = ("<p>Map 1. North</p>" + '<img src="/own.png" alt="a">' * 40 + '<p>Table 7: T &amp; U</p><img alt="b" src="http://x/1"><img src="http://x/2" alt="c"> <figcaption><i>two</i>'
        "</figcaption>" + '<img src="http://x/1" alt="again"><img src="http://x/3"><IMG SRC="https://x/4" ALT=""><img src="http://x/5" alt="d">' * 40)
    df = spark.createDataFrame([(html,), ("none",), ("",), (None,), ('<img src="http://x/1" alt="q">',)], "h string").select(t.extract_figures(F.col("h")).alias("f"))
    assert [None if f is None else [tuple(x) for x in f] for f, in df.collect()] == [[("http://x/1", "Table 7: T & U"), ("http://x/2", "two"), ("http://x/3", ""), ("https://x/4", "")],
        [], [], None, [("http://x/1", "q")]]
    plan = spark.createDataFrame([(html,)], "h string").repartition(2).select(t.extract_figures(F.col("h")).alias("f"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("figcaption>(.*?)") == 1 and plan.count("(?:Figure|Fig") == 1


def test_pct_and_week_out_of_range(spark):
    df = spark.createDataFrame([("d", "2024 5 1 (10) 2 (101)\n2024 54 1 (1) 2 (2)\n2024 6 1 (1) 2 (2)")], "doc string, text string")
    assert p.parse_weekly_pair_table(df, ["a", "b"]).select("week").distinct().collect()[0][0] == 6


def test_guarded_overwrite_keeps_the_old_ledger(spark, tmp_path):
    path = f"file://{tmp_path}/ledger"
    files.guarded_overwrite(spark.range(5), path, 3)
    with pytest.raises(files.TooFewRows):
        files.guarded_overwrite(spark.range(2), path, 3)
    assert spark.read.parquet(path).count() == 5


def test_ledger_with_a_byte_order_mark(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿name,n\nx,1\n".encode())
    assert rows(files.read_ledger_csv(spark, f"file://{tmp_path}/a.csv", "name string, n int")) == [("x", 1)]


def test_ledger_json_over_many_lines(spark, tmp_path):
    (tmp_path / "a.json").write_text('{\n "rows": [\n {"a": 1},\n {"a": 2}]\n}')
    assert rows(files.read_ledger_json(spark, f"file://{tmp_path}/a.json", "rows array<struct<a:int>>", "rows")) == [(1,), (2,)]
