"""Weekly surveillance: baselines, anomalies, paired axes, revisions, gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilspark.operators.order import numbered, running_sum


def weekly_baseline_ratio(df: DataFrame) -> DataFrame:
    """``ratio`` = n / base to two places; null without a base or with base 0."""
    return df.withColumn("ratio", F.round(F.try_divide(F.col("n").cast("double"), F.nullif(F.col("base"), F.lit(0.0))), 2))


def five_year_weekly_mean(df: DataFrame, years: int = 5) -> DataFrame:
    """``base``: mean of the same ISO week in the previous years; missing years are left out."""
    window = Window.partitionBy("entity", "week").orderBy("year").rangeBetween(-years, -1)
    return df.withColumn("base", F.avg("n").over(window))


def anomaly_rank(df: DataFrame, min_base: float = 3) -> DataFrame:
    """Each entity's week of largest ratio (earliest on ties) among weeks with enough base, largest first,
    with the entity's series of such weeks."""
    rows = weekly_baseline_ratio(df.where(F.col("base") >= min_base)).where(F.col("ratio").isNotNull())
    key = F.struct("ratio", (-F.col("year")).alias("y"), (-F.col("week")).alias("w"))
    cell = F.struct("year", "week", "n", "ratio")
    peaks = rows.groupBy("entity").agg(F.max_by(F.struct("year", "week", "n", "base", "ratio"), key).alias("peak"), F.sort_array(F.collect_list(cell)).alias("series"))
    ranked = numbered(peaks, "rank", [F.col("peak.ratio").desc(), F.col("entity")])
    return ranked.select("entity", "peak.*", "rank", "series")


def average_rank(df: DataFrame, group: list[str], column: str, name: str) -> DataFrame:
    """Rank from 1 with the mean rank for ties.

    Equal values are counted first; the counts of all groups add up in one order over ranges, less what stood before the group.
    So a group of all rows, or a value of all rows, is spread over tasks like any other."""
    cells = df.groupBy(*group, column).agg(F.count("*").alias("_ties"))
    summed = running_sum(cells, "_ties", "_below", [*(F.col(c).asc_nulls_first() for c in group), F.col(column).asc_nulls_first()])
    start = summed.groupBy(*group).agg(F.min("_below").alias("_start"))
    ranks = _rejoin(summed, start, group).withColumn(name, F.col("_below") - F.col("_start") + (F.col("_ties") + 1) / 2.0)
    return _rejoin(df, ranks.select(*group, column, name), [*group, column])


def _rejoin(df: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` with the other columns of ``found``, by keys that may be null."""
    named = found.select(*(F.col(c).alias(f"_key_{c}") for c in keys), *(c for c in found.columns if c not in keys))
    same = F.lit(True)
    for c in keys:
        same = same & df[c].eqNullSafe(F.col(f"_key_{c}"))
    return df.join(named, same).drop(*(f"_key_{c}" for c in keys))


def grouped_spearman(df: DataFrame, group: list[str], x: str, y: str, min_n: int = 3) -> DataFrame:
    """(group, n, rho): rank correlation with mid-ranks, three places; null under ``min_n`` pairs or without variance.

    Equal pairs of values are one weighted row."""
    cells = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*group, x, y).agg(F.count("*").alias("_w"))
    ranks = {}
    for column, name in ((x, "_rx"), (y, "_ry")):
        by_value = cells.groupBy(*group, column).agg(F.sum("_w").alias("_ties"))
        summed = running_sum(by_value, "_ties", "_below", [*(F.col(c).asc_nulls_first() for c in group), F.col(column)])
        start = summed.groupBy(*group).agg(F.min("_below").alias("_start"))
        ranks[column] = _rejoin(summed, start, group).select(*group, column, (F.col("_below") - F.col("_start") + (F.col("_ties") + 1) / 2.0).alias(name))
    ranked = _rejoin(_rejoin(cells, ranks[x], [*group, x]), ranks[y], [*group, y])
    sums = ranked.groupBy(*group).agg(F.sum("_w").alias("n"), *(F.sum(F.col("_w") * e).alias(a) for a, e in (
        ("sx", F.col("_rx")), ("sy", F.col("_ry")), ("sxx", F.col("_rx") ** 2), ("syy", F.col("_ry") ** 2), ("sxy", F.col("_rx") * F.col("_ry")))))
    vx, vy = F.col("n") * F.col("sxx") - F.col("sx") ** 2, F.col("n") * F.col("syy") - F.col("sy") ** 2
    rho = (F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")) / F.sqrt(vx * vy)
    return sums.select(*group, "n", F.when((F.col("n") >= min_n) & (vx > 0) & (vy > 0), F.round(rho, 3)).alias("rho"))


def concordance_verdict(n: Column, rho: Column, min_pairs: int = 8) -> Column:
    return (F.when((n < min_pairs) | rho.isNull(), "hold").when(rho >= 0.5, "agree").when(rho >= 0.2, "weak").when(rho <= -0.2, "oppose").otherwise("none"))


def sum_series(df: DataFrame, a: str, b: str, name: str) -> DataFrame:
    """``df`` with one more entity: a + b week by week, a missing side counting 0."""
    both = df.where(F.col("entity").isin(a, b)).groupBy("year", "week").agg(F.sum("n").alias("n"))
    return df.select("entity", "year", "week", "n").unionByName(both.select(F.lit(name).alias("entity"), "year", "week", "n"))


def tolerance_join(left: DataFrame, right: DataFrame, key: str, tolerance: int = 1) -> DataFrame:
    """Pair weeks: the same one, else the week before, then the week after, of the same year.

    Each right row is offered under every offset, so this stays an equi-join.  ``offset`` 0 is exact."""
    order = [0] + [s * d for d in range(1, tolerance + 1) for s in (-1, 1)]
    offsets = F.array(*(F.struct(F.lit(d).alias("offset"), F.lit(p).alias("priority")) for p, d in enumerate(order)))
    offered = right.withColumn("_o", F.explode(offsets)).withColumn("_right_week", F.col("week")).withColumn("week", F.col("week") - F.col("_o.offset"))
    value = F.struct(F.col("_o.priority").alias("p"), F.col("_o.offset").alias("offset"), F.col("_right_week").alias("right_week"), F.col("right_value"))
    best = offered.groupBy(key, "year", "week").agg(F.min(value).alias("_m"))
    return left.join(best, [key, "year", "week"]).select(key, "year", "week", "left_value", F.col("_m.right_week").alias("right_week"),
        F.col("_m.offset").alias("offset"), F.col("_m.right_value").alias("right_value"))


def tolerance_counts(paired: DataFrame, key: str) -> DataFrame:
    """(key, pairs, by_tolerance): how many weeks tolerance_join paired, and how many of them with another week."""
    return paired.groupBy(key).agg(F.count("*").alias("pairs"), F.count_if(F.col("offset") != 0).alias("by_tolerance"))


def latest_revision(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of the rows of one key the one of the latest issue; partial aggregation, no sort."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, "_r.*")


def week_gaps(df: DataFrame, group: list[str]) -> DataFrame:
    """First, last and number of weeks, and the weeks between that are missing."""
    return df.groupBy(*group).agg(F.min("week").alias("first"), F.max("week").alias("last"), F.countDistinct("week").alias("weeks"),
                                  F.array_sort(F.array_except(F.sequence(F.min("week"), F.max("week")), F.collect_set("week"))).alias("missing"))


def panel_summary(df: DataFrame, group: str, value: str) -> DataFrame:
    """Latest reported value with its week, and the maximum."""
    when = F.struct("year", "week")
    return df.where(F.col(value).isNotNull()).groupBy(group).agg(
        F.max_by(value, when).alias("latest"), F.max(when).alias("_w"), F.max(value).alias("most")).select(group, "latest",
            F.col("_w.year").alias("year"), F.col("_w.week").alias("week"), "most")


def dominant_column(columns: list[str]) -> Column:
    """Name of the column with the largest value; the first of them on ties; null if all are null."""
    top = F.greatest(*columns)
    return F.coalesce(*(F.when(F.col(c) == top, F.lit(c)) for c in columns))


def carry_down(df: DataFrame, column: str, partition: list[str], order: list[str], name: str | None = None) -> DataFrame:
    """The last value at or above each row."""
    window = Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name or column, F.last(column, ignorenulls=True).over(window))


def collection_ledger(rows: DataFrame) -> DataFrame:
    """Per issue: rows of each block and whether the block is there; ``rows`` has issue and block."""
    return rows.groupBy("issue").agg(F.count("*").alias("n_rows"), F.countDistinct("block").alias("n_blocks"), F.max(F.col("block") == "imports").alias("has_imports"))
