"""Places, sums and carried values in a global order, without one task for all rows or for a hot group.

Rows are range-partitioned by their order and written once, each with its range and its place in it; a window works
inside a range, and one row a range tells what came before.  The order may end in any column that tells equal rows
apart, so that ranges can part them."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}


def folder(spark: SparkSession, kind: str) -> str:
    """A new folder under spark.checkpoint.dir.  Only a local run may do without that setting: executors of a cluster
    don't share their disks."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = _LOCAL.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="vigilspark-"))
    return f"{base.rstrip('/')}/{kind}/{uuid.uuid4().hex}"


def stored(df: DataFrame, kind: str = "stored") -> DataFrame:
    """``df`` written to the shared folder and reread: computed once, and lineage ends there."""
    path = folder(df.sparkSession, kind)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def in_ranges(df: DataFrame, order: list[Column]) -> DataFrame:
    """``df`` in ``order``, with ``_range`` and ``_at``, a number that grows along the order."""
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = df.repartitionByRange(tasks, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    return stored(sorted_, "ranges").withColumn("_range", F.shiftright("_at", 33))  # the upper bits are the range's number


def numbered(df: DataFrame, name: str, order: list[Column]) -> DataFrame:
    """``df`` with ``name``: each row's place from 1 in ``order``."""
    rows = in_ranges(df, order)
    before = _before(rows.groupBy("_range").agg(F.count("*").alias("_n")), "_n")
    place = F.col("_sum") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1
    return rows.join(F.broadcast(before), "_range").withColumn(name, place.cast("int")).drop("_range", "_at", "_sum")


def running_sum(df: DataFrame, column: str, name: str, order: list[Column]) -> DataFrame:
    """``df`` with ``name``: the sum of ``column`` over all rows before each one in ``order``."""
    rows = in_ranges(df, order)
    before = _before(rows.groupBy("_range").agg(F.sum(column).alias("_n")), "_n")
    inside = F.sum(column).over(Window.partitionBy("_range").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1))
    return rows.join(F.broadcast(before), "_range").withColumn(name, F.col("_sum") + F.coalesce(inside, F.lit(0))).drop("_range", "_at", "_sum")


def _before(per_range: DataFrame, column: str) -> DataFrame:
    """(_range, _sum): sums over the ranges before; a row a range."""
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    return per_range.select("_range", F.coalesce(F.sum(column).over(earlier), F.lit(0)).alias("_sum"))


def carried(df: DataFrame, order: list[Column], before: dict[str, Column] | None = None, after: dict[str, Column] | None = None, itself: bool = True) -> DataFrame:
    """``df`` with columns of the last value that isn't null before each row in ``order`` (the first one after it for
    ``after``), the row's own included if ``itself``."""
    rows = in_ranges(df, order)
    out = rows
    for values, end, way in ((before or {}, F.max_by, F.col("_at").asc()), (after or {}, F.min_by, F.col("_at").desc())):
        if not values:
            continue
        tails = rows.groupBy("_range").agg(*(end(v, F.when(v.isNotNull(), F.col("_at"))).alias(f"_{c}") for c, v in values.items()))
        beyond = Window.orderBy(F.col("_range").asc() if end is F.max_by else F.col("_range").desc()).rowsBetween(Window.unboundedPreceding, -1)
        tails = tails.select("_range", *(F.last(f"_{c}", ignorenulls=True).over(beyond).alias(f"_{c}") for c in values))  # a row a range
        inside = Window.partitionBy("_range").orderBy(way).rowsBetween(Window.unboundedPreceding, 0 if itself else -1)
        out = out.withColumns({c: F.last(v, ignorenulls=True).over(inside) for c, v in values.items()}).join(F.broadcast(tails), "_range")
        out = out.withColumns({c: F.coalesce(c, f"_{c}") for c in values}).drop(*(f"_{c}" for c in values))
    return out.drop("_range", "_at")
