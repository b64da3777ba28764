"""Grids of awkward tables."""

from pyspark.sql import functions as F

from vigilspark.functions.tables import table_grids

PAGES = {
    "plain": ("<table><caption>A &amp; b</caption><tr><th>x<th>y<tr><td>1<td>2</table>", [("A & b", 0, [["x", "y"], ["1", "2"]])]),
    "nested": ("<table><tr><td>a<table><tr><td>i</td></tr></table>b</td><td>c</td></tr></table>", [(None, 0, [["a b", "c"]]), (None, 1, [["i"]])]),
    "spans": ("<table><tr><td rowspan=3>r<td colspan=2>c<td>d<tr><td>1<td rowspan=2>s<td>2<tr><td>3<td>4</table>",
        [(None, 0, [["r", "c", "c", "d"], ["r", "1", "s", "2"], ["r", "3", "s", "4"]])]),
    "gap": ("<table><tr><td>a<td>b<td rowspan=3>z<tr><td>c<tr><td>d<td>e</table>", [(None, 0, [["a", "b", "z"], ["c"], ["d", "e", "z"]])]),
    "broken": ("<tr><td>no table</td></tr><table><td>first</td><tr>", [(None, 0, [["first"], []])]),
    "hidden": ("<table><tr><td>a<!-- <td>no --><script>'</td>'</script>b&nbsp; c</td></tr></table></table>", [(None, 0, [["a b c"]])]),
    "huge": ("<table><tr><td colspan=99999999>x<td rowspan=0>y</table>", [(None, 0, [["x"] * 1000 + ["y"]])]),
    "none": ("", []), "null": (None, []),
}


def test_grids(spark):
    df = spark.createDataFrame([(k, page) for k, (page, _) in PAGES.items()], "k string, html string")
    got = {r.k: [(t.caption, t.depth, [list(x) for x in t.rows]) for t in r.t] for r in df.select("k", table_grids(F.col("html")).alias("t")).collect()}
    assert got == {k: want for k, (_, want) in PAGES.items()}
